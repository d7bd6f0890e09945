"""License scans with templates: optional and replaceable regions compiled into token automata."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpaudit.llm.common import LETTERS_AND_DIGITS, arrow_map, as_bytes, plain_words, values

#: Phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit",
}

#: Template markup. ``<<optional>> ... <</optional>>`` may be left out and can be nested; ``<<var;a;b>>`` stands for
#: a to b words of any wording; every other word is mandatory.
TEMPLATES = {
    "MIT": (
        "<<optional>>this <<var;1;3>> is<</optional>> released under the <<optional>>terms of the<</optional>> "
        "MIT License"
    ),
    "MIT-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this <<var;1;6>> and associated "
        "documentation files <<optional>>the software<</optional>> to deal in the <<var;1;6>> without restriction"
    ),
    "Apache-2.0": (
        "licensed under the Apache License <<optional>>version<</optional>> 2 0 <<optional>>the license<</optional>>"
    ),
    "GPL-notice": (
        "<<optional>>this <<var;1;3>> is<</optional>> licensed under the GNU General Public License "
        "<<optional>>version <<var;1;1>><</optional>>"
    ),
    "GPL-text": (
        "<<var;2;8>> is free software you can redistribute it and or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation"
    ),
    "CC-BY": (
        "<<optional>>this <<var;1;3>> is<</optional>> licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> "
        "<<optional>>Creative Commons<</optional>> <<optional>>attribution<</optional>> CC BY "
        "<<optional>><<var;2;2>><</optional>> <<optional>>license<</optional>>"
    ),
}
_MARK = re.compile(r"<<(/?optional|var;(\d+);(\d+))>>")


@dataclass
class Automaton:
    """States over words. ``depth[s]``: mandatory words that lie behind state s."""

    label: str
    words: list[dict[bytes, int]] = field(default_factory=list)
    anything: list[int | None] = field(default_factory=list)
    silent: list[list[int]] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    final: int = 0
    mandatory: list[bytes] = field(default_factory=list)

    def state(self, depth: int) -> int:
        self.words.append({})
        self.anything.append(None)
        self.silent.append([])
        self.depth.append(depth)
        return len(self.words) - 1

    def closure(self, states: set[int]) -> set[int]:
        open_states = list(states)
        while open_states:
            for following in self.silent[open_states.pop()]:
                if following not in states:
                    states.add(following)
                    open_states.append(following)
        return states

    def run(self, words: Sequence[bytes], start: int) -> tuple[int | None, int]:
        """Where the longest accepted text from ``start`` ends, and the mandatory words passed on the way."""
        states, end, passed = self.closure({0}), None, 0
        for place in range(start, len(words)):
            word, after = words[place], set()
            for state in states:
                following = self.words[state].get(word)
                if following is not None:
                    after.add(following)
                if self.anything[state] is not None:
                    after.add(self.anything[state])
            if not after:
                break
            states = self.closure(after)
            passed = max(passed, max(self.depth[s] for s in states))
            if self.final in states:
                end = place
        return end, passed

    @property
    def anchor(self) -> bytes:
        """The longest mandatory word: a text without it holds no match."""
        return max(self.mandatory, key=len)


def compiled(label: str, template: str) -> Automaton:
    """The automaton of a template. Raises on markup that doesn't close and on templates without a mandatory word."""
    automaton = Automaton(label)
    current, opened, place = automaton.state(0), [], 0

    def literal(text: str, current: int) -> int:
        for word in plain_words(text.encode()):
            counted = not opened
            if counted:
                automaton.mandatory.append(word)
            following = automaton.state(automaton.depth[current] + counted)
            automaton.words[current][word] = following
            current = following
        return current

    for mark in _MARK.finditer(template):
        current = literal(template[place:mark.start()], current)
        place = mark.end()
        if mark[1] == "optional":
            entry = automaton.state(automaton.depth[current])
            automaton.silent[current].append(entry)
            opened.append(entry)
            current = entry
        elif mark[1] == "/optional":
            if not opened:
                raise ValueError(f"{label}: a region is closed that isn't open")
            leave = automaton.state(automaton.depth[current])
            automaton.silent[opened.pop()].append(leave)
            automaton.silent[current].append(leave)
            current = leave
        else:
            least, most = int(mark[2]), int(mark[3])
            skips = []
            for n in range(most):
                if n >= least:
                    skips.append(current)
                following = automaton.state(automaton.depth[current])
                automaton.anything[current] = following
                current = following
            for state in skips:
                automaton.silent[state].append(current)
    current = literal(template[place:], current)
    if opened or not automaton.mandatory:
        raise ValueError(f"{label}: an open region, or no mandatory word")
    automaton.final = current
    return automaton


def _starts(automaton: Automaton, words: list[bytes]) -> list[int]:
    """Places where the automaton can begin; a leading replaceable region begins so many words before its literal."""
    first = automaton.closure({0})
    if any(automaton.anything[s] is not None for s in first):
        lead = automaton.mandatory[0]
        reach = 0
        state = 0
        while automaton.anything[state] is not None:
            state, reach = automaton.anything[state], reach + 1
        return sorted({max(0, p - back) for p, w in enumerate(words) if w == lead for back in range(reach, 0, -1)})
    literals = {w for s in first for w in automaton.words[s]}
    return [p for p, w in enumerate(words) if w in literals]


def _template_matches(automaton: Automaton, words: list[bytes], spaced: bytes) -> tuple[list[tuple], float]:
    """Accepted texts from the left, not overlapping, and the largest share of the mandatory words passed in order."""
    if b" " + automaton.anchor + b" " not in spaced:
        return [], 0.0
    found, share, free = [], 0.0, 0
    for start in _starts(automaton, words):
        if start < free:
            continue
        end, passed = automaton.run(words, start)
        share = max(share, passed / len(automaton.mandatory))
        if end is not None:
            found.append((automaton.label, start, end))
            free = end + 1
    return found, share


def _phrase_places(phrases: list[tuple[bytes, str]], spaced: bytes) -> list[tuple[str, int, int]]:
    found = []
    for phrase, label in phrases:
        place = spaced.find(phrase)
        while place >= 0:
            first = spaced.count(b" ", 0, place)
            found.append((label, first, first + phrase.count(b" ") - 2))
            place = spaced.find(phrase, place + 1)
    return found


_PLACE = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()),
]))


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES,
) -> DataFrame:
    """``key``, ``n_words``, ``phrase_places``, ``template_places`` and ``score`` of every text, as a map.

    Words are lower-cased runs of ASCII letters, digits and characters beyond ASCII. A place has its label, first and
    last word, counted from 0. A template accepts a text whose mandatory words all stand in order, with nothing between
    them but its own optional and replaceable regions; accepted texts of one template don't overlap, leftmost and
    longest first. ``score`` is 1 with an accepted template; else the largest share of a template's mandatory words
    that was passed in order, and 0.5 at least where a phrase stands.

    NULL and empty texts have no words, no places and score 0. NULL or repeated keys stay rows of their own. Other
    columns are not read, so their names can't clash. Texts of any length are scanned whole.
    """
    wanted = [(b" " + b" ".join(plain_words(p.encode())) + b" ", label) for p, label in phrases.items()]
    automata = [compiled(label, template) for label, template in templates.items()]
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("phrase_places", _PLACE), T.StructField("template_places", _PLACE),
        T.StructField("score", T.DoubleType()),
    ])

    def scan(batch: pa.RecordBatch) -> list[tuple]:
        rows = []
        for name, data in zip(values(batch, key), as_bytes(batch, text)):
            words = (data or b"").translate(LETTERS_AND_DIGITS).split()
            spaced = b" " + b" ".join(words) + b" "
            phrase_places = sorted(_phrase_places(wanted, spaced), key=lambda p: p[1:])
            template_places, score = [], 0.5 if phrase_places else 0.0
            for automaton in automata:
                found, share = _template_matches(automaton, words, spaced)
                template_places += found
                score = max(score, share)
            rows.append((
                name, len(words), [dict(zip(("label", "first", "last"), p)) for p in phrase_places],
                [dict(zip(("label", "first", "last"), p)) for p in template_places], score,
            ))
        return rows

    return arrow_map(docs.select(key, text), scan, schema)
