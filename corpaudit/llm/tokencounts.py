"""Token counts that follow edits: a segment tree of pre-tokens per document, re-encoded only where edits touch it."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpaudit.llm.common import arrow_map, values

#: Where every machine keeps the rank file; pass another path to use another vocabulary.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits texts into pre-tokens before the merges of that file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters behind a pre-token's end that can decide where it ends (white space looks past its last character).
CONTEXT = 2
LEAF = 64
REMEMBERED = 200_000

#: What the default edits mask: addresses, long numbers, keys.
MASKS = (
    (re.compile(r"[^\s@]+@[^\s@]+\.[A-Za-z]+"), "<EMAIL>"),
    (re.compile(r"\b[0-9a-f]{18,}\b|\bAKIA[0-9A-Z]{16}\b"), "<KEY>"),
    (re.compile(r"(?<![\w.])\d[\d .-]{8,}\d(?![\w.])"), "<NUMBER>"),
)
Edit = tuple[int, int, str]


def mask_edits(text: str) -> list[Edit]:
    """Edits that replace personal data and keys, in order, without overlap; the earlier and then the longer wins."""
    found = sorted(
        ((m.start(), -m.end(), mask) for pattern, mask in MASKS for m in pattern.finditer(text)), key=lambda e: e[:2]
    )
    edits, free = [], 0
    for start, end, mask in found:
        if start >= free:
            edits.append((start, -end, mask))
            free = -end
    return edits


class Encoder:
    """Pre-tokens of a text and tokens of a pre-token. Counts of frequent pre-tokens are remembered."""

    def __init__(self, ranks: str = RANKS, pattern: str = PATTERN):
        with open(ranks, "rb") as file:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.split = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def tokens(self, piece: str) -> int:
        count = self.known.get(piece)
        if count is None:
            count = len(self.encoding.encode_ordinary(piece))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = count
        return count


@lru_cache(maxsize=4)
def encoder(ranks: str, pattern: str) -> Encoder:
    return Encoder(ranks, pattern)


class TokenTree:
    """A document as leaves of some pre-tokens under a binary tree of character and token sums."""

    def __init__(self, text: str, coder: Encoder):
        self.coder = coder
        pieces = coder.split(text)
        leaves = [pieces[i:i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.texts = ["".join(leaf) for leaf in leaves]
        self.pieces = len(pieces)
        self.sizes = [len(leaf) for leaf in leaves]
        self.base = 1
        while self.base < len(leaves):
            self.base *= 2
        self.chars, self.counts = [0] * (2 * self.base), [0] * (2 * self.base)
        for i, leaf in enumerate(leaves):
            self.chars[self.base + i] = len(self.texts[i])
            self.counts[self.base + i] = sum(map(coder.tokens, leaf))
        for node in range(self.base - 1, 0, -1):
            self._pull(node)

    def _pull(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.counts[node] = self.counts[2 * node] + self.counts[2 * node + 1]

    def _set(self, leaf: int, text: str, pieces: list[str]) -> None:
        self.pieces += len(pieces) - self.sizes[leaf]
        self.texts[leaf], self.sizes[leaf] = text, len(pieces)
        node = self.base + leaf
        self.chars[node], self.counts[node] = len(text), sum(map(self.coder.tokens, pieces))
        while node > 1:
            node //= 2
            self._pull(node)

    @property
    def total(self) -> int:
        return self.counts[1]

    def text(self) -> str:
        return "".join(self.texts)

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where that leaf begins; past the end, the last leaf."""
        if char >= self.chars[1]:
            last = len(self.texts) - 1
            return last, self.chars[1] - self.chars[self.base + last]
        node, begin = 1, 0
        while node < self.base:
            node *= 2
            if char >= begin + self.chars[node]:
                begin += self.chars[node]
                node += 1
        return node - self.base, begin

    def edit(self, start: int, end: int, text: str) -> int:
        """Replaces characters ``start`` to ``end``; returns how many pre-tokens were encoded anew.

        Encoding starts at a leaf that begins ``CONTEXT`` characters or more before the edit: earlier pre-tokens can't
        see it. It goes on to the first old leaf border behind the edit where a pre-token ends as well, judged with the
        text behind that border; from there on nothing changes, as a pre-token doesn't depend on what stands before it.
        """
        start = min(max(start, 0), self.chars[1])
        end = min(max(end, start), self.chars[1])
        first, begin = self._leaf_at(max(0, start - CONTEXT))
        last, last_begin = self._leaf_at(end)
        old = "".join(self.texts[first:last + 1])
        new = old[:start - begin] + text + old[end - begin:]
        while True:
            behind, look = last + 1, ""
            while behind < len(self.texts) and len(look) <= CONTEXT:
                look += self.texts[behind]
                behind += 1
            pieces, length = [], 0
            for piece in self.coder.split(new + look):
                if length >= len(new):
                    break
                pieces.append(piece)
                length += len(piece)
            if length == len(new):
                break
            last += 1
            new += self.texts[last]
        for leaf in range(first + 1, last + 1):
            self._set(leaf, "", [])
        self._set(first, new, pieces)
        return len(pieces)

    def apply(self, edits: Iterable[Edit]) -> int:
        """Edits given in the positions of the original text, applied from the last to the first. What an edit shares
        with the one before it is left to that one."""
        clipped, free = [], 0
        for start, end, text in sorted(edits, key=lambda e: (e[0], e[1])):
            start = max(start, free)
            end = max(end, start)
            clipped.append((start, end, text))
            free = end
        return sum(self.edit(*edit) for edit in reversed(clipped))


def edited_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", edits: str | None = None,
    make_edits: Callable[[str], list[Edit]] = mask_edits, ranks: str = RANKS, pattern: str = PATTERN,
) -> DataFrame:
    """Token counts before and after each document's edits, as a map.

    ``edits`` names a column of arrays of (start, end, text) in characters; without it ``make_edits`` derives them from
    the text. Result: ``key``, ``n_pretokens``, ``n_tokens``, ``n_edits``, ``n_reencoded`` (pre-tokens encoded again),
    ``n_tokens_after``, and the leaves of the edited tree (``leaf_chars``, ``leaf_tokens``), from which later edits can
    find their place without counting the document again.

    NULL and empty texts have no tokens, and edits of theirs only insert. A NULL list of edits is an empty one. Edits
    beyond the text are moved to its end, overlaps go to the earlier edit. Repeated rows and NULL keys stay rows of
    their own. Other columns are not read. ``ranks`` must be at the same path on every machine.
    """
    schema = T.StructType(
        [T.StructField(key, docs.schema[key].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_tokens_after")]
        + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("leaf_chars", "leaf_tokens")]
    )

    def count(name, content: str, own: list[Edit]) -> tuple:
        tree = TokenTree(content, encoder(ranks, pattern))
        pieces, tokens = tree.pieces, tree.total
        again = tree.apply(own)
        leaves = slice(tree.base, tree.base + len(tree.texts))
        return name, pieces, tokens, len(own), again, tree.total, tree.chars[leaves], tree.counts[leaves]

    def run(batch: pa.RecordBatch) -> list[tuple]:
        contents = [t or "" for t in values(batch, text)]
        if edits is None:
            lists = [make_edits(t) for t in contents]
        else:
            lists = [[(e["start"], e["end"], e["text"] or "") for e in own or []] for own in values(batch, edits)]
        return [count(*row) for row in zip(values(batch, key), contents, lists)]

    return arrow_map(docs.select(key, text, *([edits] if edits else [])), run, schema)
