"""Benchmark decontamination by winnowing: shared fingerprints of documents and benchmark items, extended and verified."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from corpaudit.llm.common import (
    WordHashes, arrow_map, as_bytes, gram_hashes, hash_filter, in_filter, plain_words, values, winnowed, without,
    written,
)

#: Words of a window; every shared run of so many words is found.
WINDOW = 13
#: Words of a fingerprint. Each window of WINDOW words has WINDOW - GRAM + 1 of them and keeps its least.
GRAM = 5
#: Size of the filter of benchmark fingerprints that tasks get: 1 MB however large the benchmark is. A full filter
#: lets more rows through to the join, which decides.
FILTER_BITS = 1 << 23

_FINGERPRINT = [
    T.StructField("hash", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("n", T.IntegerType()),
    T.StructField("left", T.IntegerType()), T.StructField("context", T.BinaryType()),
]
_HASHES = WordHashes()


def _fingerprints(words: list[bytes], short: list[int], bits: np.ndarray | None = None) -> list[tuple]:
    """(hash, place, words of the gram, words of context to its left, context) of one text.

    ``short``: lengths of whole-item grams, all of whose places are taken. ``bits`` filters hashes. The context has
    all words that a window around the gram can reach.
    """
    numbers = _HASHES.numbers(words)
    found = []
    reach = WINDOW - GRAM
    grams = gram_hashes(numbers, GRAM)
    places = winnowed(grams, WINDOW - GRAM + 1)
    for n, around, at, hashes in [(GRAM, reach, places, grams[places])] + [(n, 0, None, gram_hashes(numbers, n)) for n in short]:
        signed = hashes.view(np.int64)
        picked = np.arange(len(hashes)) if bits is None else np.flatnonzero(in_filter(bits, hashes))
        for i in picked.tolist():
            place = i if at is None else int(at[i])
            left = min(around, place)
            found.append((int(signed[i]), place, n if not around else -n, left, b" ".join(words[place - left:place + n + around])))
    return found


def _extended(document: tuple, item: tuple) -> tuple[int, int] | None:
    """First and past-the-last word of the run around a common gram that both share, if it is a whole window."""
    (_, place, n, left, context), (_, _, _, item_left, item_context) = document, item
    a, b, whole = context.split(b" "), item_context.split(b" "), n > 0
    n = abs(n)
    if a[left:left + n] != b[item_left:item_left + n]:
        return None
    if whole:
        return place, place + n
    back = 0
    while back < left and back < item_left and a[left - back - 1] == b[item_left - back - 1]:
        back += 1
    forth, ahead = 0, min(len(a) - left, len(b) - item_left) - n
    while forth < ahead and a[left + n + forth] == b[item_left + n + forth]:
        forth += 1
    return (place - back, place + n + forth) if back + n + forth >= WINDOW else None


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", keep: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Documents with their word counts, and the spans they share with the benchmark.

    First: ``row`` (unique), ``key``, ``keep``, ``n_words``. Second: ``row``, ``start``, ``end`` (word places, end excluded),
    ``item`` (the item's id as text, '' for NULL). Each span lies in a shared run of ``WINDOW`` words, or is an item of
    fewer words; together they cover every document word inside an occurrence of a window.

    Winnowing keeps the least gram of every window of both sides; since a window's pick depends on its words alone, two
    equal windows keep the same gram, which the join on hashes finds. The run is then extended over the words carried
    along and compared word by word, so hash collisions can't make a hit. A filter of fixed size, made from the
    benchmark, keeps most document fingerprints from the shuffle. Equal items are one until the end. A gram that very
    many documents have meets few benchmark rows, and adaptive skew handling splits its documents.

    NULL and empty texts have no words; an empty benchmark gives no spans. Repeated rows and NULL keys stay rows of
    their own. Other columns are not read. The word counts and fingerprints are written to the shared folder once.
    """
    items = arrow_map(
        benchmark.select(item_key, item_text),
        lambda batch: [
            (i, b" ".join(plain_words(data))) for i, data in zip(values(batch, item_key), as_bytes(batch, item_text))
        ],
        T.StructType([T.StructField("item", benchmark.schema[item_key].dataType), T.StructField("words", T.BinaryType())]),
    ).filter(F.length("words") > 0)
    items = written(items.select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), "words", F.sha2("words", 256).alias("wording")))
    wordings = items.select("wording", "words").distinct()

    def of_item(batch: pa.RecordBatch) -> list[tuple]:
        rows = []
        for wording, data in zip(values(batch, "wording"), values(batch, "words")):
            words = data.split(b" ")
            found = _fingerprints(words, []) if len(words) >= WINDOW else [f for f in _fingerprints(words, [len(words)]) if f[2] > 0]
            rows += [(wording, *f) for f in found]
        return rows

    keys = written(arrow_map(wordings, of_item, T.StructType([T.StructField("wording", T.StringType()), *_FINGERPRINT])))
    bits = hash_filter(keys.select("hash"), FILTER_BITS)
    short = sorted(r["n"] for r in keys.filter("n > 0").select("n").distinct().collect())  # lengths below WINDOW

    def of_document(batch: pa.RecordBatch) -> list[tuple]:
        rows = []
        for *own, data in zip(*(values(batch, c) for c in (key, *keep)), as_bytes(batch, text)):
            words = plain_words(data)
            rows.append((*own, len(words), [dict(zip(("hash", "place", "n", "left", "context"), f)) for f in _fingerprints(words, short, bits)]))
        return rows

    schema = T.StructType([
        *(docs.schema[c] for c in (key, *keep)), T.StructField("n_words", T.LongType()),
        T.StructField("found", T.ArrayType(T.StructType(_FINGERPRINT))),
    ])
    counted = written(arrow_map(docs.select(key, *keep, text), of_document, schema).withColumn("row", F.monotonically_increasing_id()))
    found = counted.select("row", F.inline("found"))
    other = keys.select(
        "hash", "n", "wording", F.col("left").alias("item_left"), F.col("context").alias("item_context"),
    )
    met = found.join(other, ["hash", "n"])

    def extend(batch: pa.RecordBatch) -> list[tuple]:
        rows = []
        columns = ("row", "wording", "place", "n", "left", "context", "item_left", "item_context")
        for row, wording, place, n, left, context, item_left, item_context in zip(*(values(batch, c) for c in columns)):
            span = _extended((None, place, n, left, context), (None, None, None, item_left, item_context))
            if span:
                rows.append((row, *span, wording))
        return rows

    spans = arrow_map(met, extend, T.StructType([
        T.StructField("row", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("wording", T.StringType()),
    ]))
    spans = written(spans.distinct())
    return counted.select("row", key, *keep, "n_words"), spans.join(items.select("wording", "item").distinct(), "wording")


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", every: int = 20, keep: Sequence[str] = (),
) -> DataFrame:
    """``key``, ``keep``, ``n_words``, ``n_hit``, ``items`` (sorted as text) and ``contaminated`` of every document.

    A word is hit inside any occurrence of a window; ``contaminated`` says that one word in ``every`` or more
    is hit, and at least one. Edge cases as in ``contaminated_spans``.
    """
    counted, spans = contaminated_spans(docs, benchmark, key, text, item_key, item_text, keep)
    ordered = Window.partitionBy("row").orderBy("start", "end")
    before = F.coalesce(F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = (
        spans.select("row", "start", "end").distinct()
        .withColumn("new", F.greatest(F.col("end") - F.greatest("start", before), F.lit(0)))
        .groupBy("row").agg(F.sum("new").alias("n_hit"))
    )
    items = spans.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return counted.join(hits.join(items, "row"), "row", "left").select(
        key, *keep, "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (every * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones. Edge cases as in ``contaminated_spans``."""
    marked = docs.select(
        F.struct(*docs.columns).alias("whole"), F.col(key).alias("own"), F.col(text).alias("said"),
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("mark"),
    )
    gone = written(contamination(marked, benchmark, "own", "said", keep=["id", "mark"]).filter("contaminated").select("id", "mark"))
    return without(marked, gone, ["id", "mark"]).select("whole.*")
