"""Quality rules: Jensen-Shannon distance of a text's character classes and common words to its language's reference."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from corpaudit.llm.common import LETTERS_AND_DIGITS, arrow_map, as_bytes, short_batches, values

#: Languages with a list of common words, by the code used in ``lang``.
LANGUAGES = {"en": "english", "de": "german", "es": "spanish", "fr": "french"}

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_STARTS = np.ones(256, bool)
_STARTS[128:192] = False  # continuation bytes

CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "symbol", "other", "two_byte", "longer")


def _class_of(byte: int) -> int | None:
    if 128 <= byte < 192:
        return None
    if byte >= 192:
        return CLASSES.index("two_byte" if byte < 224 else "longer")
    c = chr(byte)
    name = (
        "lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "line" if c == "\n"
        else "space" if c in " \t\r\v\f" else "stop" if c in ".,;:!?'\"()-" else "symbol" if c in "#*$%&|<>@/\\_+=~^{}[]" else "other"
    )
    return CLASSES.index(name)


#: Byte counts times this are class counts.
_TO_CLASS = np.zeros((256, len(CLASSES)))
for _byte in range(256):
    if (_number := _class_of(_byte)) is not None:
        _TO_CLASS[_byte, _number] = 1


@dataclass(frozen=True)
class Rules:
    """A text is compared from the minimum length on. The limit is ``distance + slack / sqrt(length)``, since the
    distance of a short text from its own language is large by chance alone."""

    min_chars: int = 200
    class_distance: float = 0.30
    class_slack: float = 0.6
    min_words: int = 50
    word_distance: float = 0.45
    word_slack: float = 2.2
    base_min_words: int = 10
    base_repeat_share: float = 0.2


def common_words(spark: SparkSession) -> dict[str, list[bytes]]:
    """Spark ML's stop words, cut at the characters that end words here."""
    lists = {}
    for code, name in LANGUAGES.items():
        texts = b" ".join(w.lower().encode() for w in StopWordsRemover.loadDefaultStopWords(name))
        lists[code] = sorted(set(texts.translate(LETTERS_AND_DIGITS).split()))
    return lists


def _class_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return counts, counts @ _TO_CLASS


def _word_counts(data: bytes, places: dict[bytes, int]) -> np.ndarray:
    """Counts of the common words and, last, of all others."""
    found = Counter(data.translate(LETTERS_AND_DIGITS).split())
    counts = np.zeros(len(places) + 1)
    total = 0
    for word, n in found.items():
        total += n
        place = places.get(word)
        if place is not None:
            counts[place] = n
    counts[-1] = total - counts[:-1].sum()
    return counts


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """The distance, 0 to 1 (logarithms to base 2), of two count vectors. 1 where one of them is empty."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        both = np.where(p > 0, p * np.log2(p / middle), 0).sum() + np.where(q > 0, q * np.log2(q / middle), 0).sum()
    return float(np.sqrt(max(0.0, both / 2)))


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside a window of ``width`` words that stands twice or more in the text. Exact: windows are compared as
    tuples of word numbers, packed into one integer, or ranked pair by pair where that would overflow."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    size = len(numbers)
    if size == len(words):
        return 0
    keys, bound = ids[:n], size
    for offset in range(1, width):
        if bound > (1 << 62) // size:
            keys = np.unique(keys, return_inverse=True)[1].astype(np.int64)
            bound = n
        keys, bound = keys * size + ids[offset:offset + n], bound * size
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    return int(np.minimum(np.diff(starts), width).sum()) + width


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, repeats = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            repeats += 1
        elif line.strip():
            seen.add(line)
    return repeats


_REFERENCE = T.StructType([
    T.StructField("language", T.StringType()), T.StructField("classes", T.ArrayType(T.DoubleType())),
    T.StructField("words", T.ArrayType(T.DoubleType())),
])


def language_references(
    docs: DataFrame, lists: dict[str, list[bytes]], text: str = "text", lang: str = "lang"
) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Class and common-word counts over all texts of each listed language: one row per task and language, summed on
    the executors. The driver gets one row per listed language, whatever the corpus."""
    places = {code: {w: i for i, w in enumerate(words)} for code, words in lists.items()}

    def run(batches):
        sums = {code: [np.zeros(len(CLASSES)), np.zeros(len(words) + 1)] for code, words in places.items()}
        for batch in batches:
            for code, data in zip(values(batch, lang), as_bytes(batch, text)):
                if data and code in sums:
                    sums[code][0] += _class_counts(data)[1]
                    sums[code][1] += _word_counts(data, places[code])
        yield pa.RecordBatch.from_pylist([
            {"language": code, "classes": list(classes), "words": list(words)} for code, (classes, words) in sums.items()
        ])

    parts = short_batches(docs.select(F.col(lang).cast("string").alias(lang), text)).mapInArrow(run, _REFERENCE)
    flat = parts.select("language", F.posexplode(F.concat("classes", "words")).alias("place", "n"))
    rows = flat.groupBy("language", "place").agg(F.sum("n").alias("n")).collect()
    references = {code: np.zeros(len(CLASSES) + len(words) + 1) for code, words in lists.items()}
    for row in rows:
        references[row["language"]][row["place"]] = row["n"]
    return {code: (both[:len(CLASSES)], both[len(CLASSES):]) for code, both in references.items()}


def quality_rules(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rules: Rules = Rules()
) -> DataFrame:
    """Counts, distances and verdicts of every text.

    Two maps over the table: the first sums the references (one small row per task and language), the second compares.
    ``class_distance`` and ``word_distance`` are NULL below the minimum lengths. A text in a language without a
    reference, or without a language, is compared with all references and gets its smallest distances. ``kept`` is
    false if ``base_failed`` or a distance is above its limit.

    NULL and empty texts have no words and fail the base rule. Repeated rows and NULL keys stay rows of their own, equal
    texts of one language get equal results; an empty table gives no rows; other columns are not read.
    """
    lists = common_words(docs.sparkSession)
    references = {
        code: pair for code, pair in language_references(docs, lists, text, lang).items() if pair[0].sum()
    }
    places = {code: {w: i for i, w in enumerate(lists[code])} for code in references}
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType(
        [T.StructField(key, docs.schema[key].dataType)] + [T.StructField(c, T.LongType()) for c in counts]
        + [T.StructField("class_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType())]
        + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    )

    def judge(name, code, data: bytes) -> tuple:
        words = data.split()
        by_byte, classes = _class_counts(data)
        chars = int(by_byte[_STARTS].sum())
        repeats = repeated_words(words)
        base_failed = len(words) < rules.base_min_words or repeats > rules.base_repeat_share * len(words)
        class_distance = word_distance = None
        against = [code] if code in references else list(references)
        if against and chars >= rules.min_chars:
            class_distance = min(jensen_shannon(classes, references[c][0]) for c in against)
        if against and len(words) >= rules.min_words:
            word_distance = min(jensen_shannon(_word_counts(data, places[c]), references[c][1]) for c in against)
        failed = base_failed or (
            class_distance is not None and class_distance > rules.class_distance + rules.class_slack / chars**0.5
        ) or (
            word_distance is not None and word_distance > rules.word_distance + rules.word_slack / len(words)**0.5
        )
        return (
            name, len(words), chars - int(by_byte[_SPACE].sum()), int(by_byte[_SYMBOLS].sum()), duplicate_lines(data),
            repeats, class_distance, word_distance, base_failed, not failed,
        )

    def run(batch: pa.RecordBatch) -> list[tuple]:
        return [
            judge(name, code, data or b"")
            for name, code, data in zip(values(batch, key), values(batch, lang), as_bytes(batch, text))
        ]

    return arrow_map(docs.select(key, text, F.col(lang).cast("string").alias(lang)), run, schema)
