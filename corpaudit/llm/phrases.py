"""Collocations by partitioned mining: shards are mined completely at lowered support, what is frequent in any of them is
counted in all of them.

A phrase that stands ``support`` times in all of ``S`` shards stands ``support / S`` times in some shard at least. So the
union over the shards of what reaches that share holds every frequent phrase, and counting that union once more over
everything gives exact numbers. A shard is as many tasks' rows as its share of the corpus takes; it is mined by length:
pairs of frequent words first, then whatever is made of locally frequent pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpaudit.llm.common import Scratch, WordHashes, as_bytes, hash_filter, in_filter, mixed_bits, short_batches, to_batch, values

#: Shards that the corpus is cut into, however large it is: local support is ``support / SHARDS``. With a shard per task,
#: local support would fall to one as the corpus grows, and every phrase would be a candidate.
SHARDS = 8
#: Words that a task counts at a time, about, which bounds its memory.
RUN_WORDS = 6_000_000
#: Bits of a phrase's hash that a pack holds; the bits above them are its bucket. Phrases of a bucket and shard, about.
CELL_BITS, PACKED = 40, 1 << 20
#: Bits of the filters that tasks get: at least and at most. Filters spare work; counts decide.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
#: The language of texts without one.
UNKNOWN = "und"


def _piece_table() -> bytes:
    ends = b".,;:!?\n\x0b\x0c\r"
    return bytes(255 if b in ends else b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Lower-cases A-Z; ends of pieces become a byte that UTF-8 never has.
_PIECES = _piece_table()
_END = b"\xff"


def piece_words(data: bytes | None) -> list[bytes]:
    """Words between blanks and tabs, with ``_END`` between pieces."""
    return (data or b"").translate(_PIECES).replace(_END, b" \xff ").split()


class _Codes(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Shard:
    """The words of one language in a run of rows, as numbers; 0 ends a piece."""

    def __init__(self):
        self.codes = _Codes({_END: 0})
        self.texts: list[np.ndarray] = []

    def add(self, words: list[bytes]) -> None:
        self.texts.append(np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words)))
        self.texts.append(np.zeros(1, np.int32))

    def numbers(self) -> tuple[np.ndarray, list[bytes]]:
        return np.concatenate(self.texts) if self.texts else np.zeros(0, np.int32), list(self.codes)


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[dict[str, Shard]]:
    """Runs of rows with about ``most`` words at most, and a whole text more, by language."""
    shards: dict[str, Shard] = {}
    held = 0
    for batch in batches:
        for lang, data in zip(values(batch, "lang"), as_bytes(batch, "text")):
            words = piece_words(data)
            if words:
                if lang not in shards:
                    shards[lang] = Shard()
                shards[lang].add(words)
                held += len(words)
            if held >= most:
                yield shards
                shards, held = {}, 0
    if shards:
        yield shards


def _hashes(words: list[bytes], lang: str) -> np.ndarray:
    """A number per word and language; those of a phrase are chained by ``_chained``."""
    table = WordHashes()
    own = mixed_bits(table.numbers([lang.encode()]))[0]
    return mixed_bits(table.numbers(words) ^ own)


def _chained(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed_bits(prefix * np.uint64(0x9E3779B97F4A7C15) + word)


def _levels(numbers: np.ndarray, longest: int, frequent) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Places of the frequent phrases of 1, 2, ... words: ``length``, one place and the count of each.

    A phrase is looked at where both its parts without the last and the first word are frequent. It is told apart
    exactly, by the numbers of these two parts. ``frequent(length, places, counts)`` tells which of the found stay.
    """
    words = np.bincount(numbers)
    words[:1] = 0
    first = np.zeros(len(words), np.int64)
    first[numbers[::-1]] = np.arange(len(numbers) - 1, -1, -1)
    known = np.flatnonzero(words)
    stay = known[frequent(1, first[known], words[known])]
    yield 1, first[stay], words[stay]
    ids = np.zeros(len(words), np.int64)
    ids[stay] = np.arange(1, len(stay) + 1)
    at = ids[numbers]
    for length in range(2, longest + 1):
        places = np.flatnonzero((at[:-1] > 0) & (at[1:] > 0))
        keys = at[places] << 32 | at[places + 1]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        counts = np.diff(np.append(starts, len(keys)))
        stay = frequent(length, places[order[starts]], counts)
        yield length, places[order[starts[stay]]], counts[stay]
        numbered = np.zeros(len(starts), np.int64)
        numbered[stay] = np.arange(1, int(stay.sum()) + 1)
        at = np.zeros(len(at) - 1, np.int64)
        at[places[order]] = np.repeat(numbered, counts)
        if not at.any():
            return


@dataclass(frozen=True)
class _Words:
    """What mining needs to know of the words: a filter of the frequent ones."""

    filter: np.ndarray


def _bits(count: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * count).bit_length()))


def _phrase_hashes(hashes: np.ndarray, numbers: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    found = hashes[numbers[places]]
    for step in range(1, length):
        found = _chained(found, hashes[numbers[places + step]])
    return found


def word_counts(texts: DataFrame) -> DataFrame:
    """``lang``, ``phrase`` (one word), ``f``: how often it stands in all texts."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("phrase", T.BinaryType()), T.StructField("f", T.LongType())])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards in _shards(batches, RUN_WORDS):
            for lang, shard in shards.items():
                numbers, words = shard.numbers()
                counts = np.bincount(numbers, minlength=len(words)).tolist()
                if len(words) > 1:
                    yield to_batch([(lang, word, n) for word, n in zip(words[1:], counts[1:])], target)

    found = short_batches(texts).mapInArrow(run, schema)
    return found.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))


def _cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The top ``bits`` of hashes, by which phrases are counted in a shard and asked for in filters."""
    return hashes >> np.uint64(64 - bits)


def _packed(cells: np.ndarray, most: int) -> list[tuple[int, bytes, bytes]]:
    """Buckets with their distinct cells, 5 bytes each, and how often each stands, ``most`` at most."""
    kept, counts = np.unique(cells, return_counts=True)
    buckets = (kept >> np.uint64(CELL_BITS)).astype(np.int64)
    starts = np.flatnonzero(np.diff(buckets, prepend=-1))
    raw = kept.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CELL_BITS // 8]
    counts = np.minimum(counts, most).astype(np.uint8 if most < 256 else np.uint32)
    return [(int(buckets[a]), raw[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(starts, np.append(starts[1:], len(kept)))]


def _frequent_cells(bucket: int, cells: list[bytes], counts: list[bytes], least: int) -> np.ndarray:
    """The cells of a shard's bucket that stand ``least`` times or more in all its packs."""
    raw = np.frombuffer(b"".join(cells), np.uint8).reshape(-1, CELL_BITS // 8)
    whole = np.zeros((len(raw), 8), np.uint8)
    whole[:, :CELL_BITS // 8] = raw
    found, inverse = np.unique(whole.view("<u8").ravel(), return_inverse=True)
    sums = np.bincount(inverse, np.frombuffer(b"".join(counts), np.uint8 if least < 256 else np.uint32), len(found))
    return found[sums >= least] | np.uint64(bucket) << np.uint64(CELL_BITS)


def _pairs(hashes: np.ndarray, numbers: np.ndarray, known: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Where two frequent words follow each other in a piece, and the pair's hash at every place."""
    stay = in_filter(known.filter, hashes)
    stay[0] = False
    at, own = stay[numbers], hashes[numbers]
    return at[:-1] & at[1:], _chained(own[:-1], own[1:])


def _locally_frequent(texts: DataFrame, known, least: int, longest: int, bits: int, pairs=None) -> DataFrame:
    """``hash`` of the cells that stand ``least`` times or more in some shard: of pairs of frequent words, or with the filter
    ``pairs`` of all longer phrases whose pairs all pass it.

    A task's rows all belong to one of ``SHARDS`` shards; what it finds is counted in the task, and shipped as packs of
    cells to the task that holds a range of the shard's cells.
    """
    out = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("bucket", T.IntegerType()),
        T.StructField("cells", T.BinaryType()), T.StructField("counts", T.BinaryType()),
    ])
    target = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % SHARDS
        for shards in _shards(batches, RUN_WORDS):
            for lang, run_of in shards.items():
                numbers, words = run_of.numbers()
                hashes = _hashes(words, lang)
                there, chained = _pairs(hashes, numbers, known.value)
                if pairs is None:
                    found = _cells(chained[there], bits)
                else:
                    linked = there.copy()
                    linked[there] = in_filter(pairs.value, mixed_bits(_cells(chained[there], bits)))
                    found, own, at = [], hashes[numbers], linked
                    for length in range(3, longest + 1):
                        at = at[:-1] & linked[length - 2:]
                        chained = _chained(chained[:-1], own[length - 1:])
                        found.append(_cells(chained[at], bits))
                    found = np.concatenate(found) if found else np.zeros(0, np.uint64)
                if len(found):
                    yield to_batch([(shard, *row) for row in _packed(found, least)], target)

    def frequent(table: pa.Table) -> pa.Table:
        cells = _frequent_cells(table.column("bucket")[0].as_py(), table.column("cells").to_pylist(), table.column("counts").to_pylist(), least)
        return pa.table({"hash": pa.array(mixed_bits(cells).view(np.int64), pa.int64())})

    return short_batches(texts).mapInArrow(run, out).groupBy("shard", "bucket").applyInArrow(frequent, "hash long")


def _counted(texts: DataFrame, known, candidates, longest: int, bits: int) -> DataFrame:
    """``lang``, ``phrase``, ``f`` of all phrases of two words or more that pass the candidates' filter, in all texts."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("phrase", T.BinaryType()), T.StructField("f", T.LongType())])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_words, wanted = known.value.filter, candidates.value
        for shards in _shards(batches, RUN_WORDS):
            for lang, shard in shards.items():
                numbers, words = shard.numbers()
                hashes = _hashes(words, lang)

                def frequent(length: int, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
                    found = _phrase_hashes(hashes, numbers, places, length)
                    return in_filter(frequent_words, found) if length == 1 else in_filter(wanted, mixed_bits(_cells(found, bits)))

                for length, places, counts in _levels(numbers, longest, frequent):
                    if length == 1:
                        continue
                    for start in range(0, len(places), 50_000):
                        part = places[start:start + 50_000]
                        spans = numbers[part[:, None] + np.arange(length)].tolist()
                        yield to_batch([
                            (lang, b" ".join([words[c] for c in span]), n) for span, n in zip(spans, counts[start:start + 50_000].tolist())
                        ], target)

    found = short_batches(texts).mapInArrow(run, schema)
    return found.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))


def frequent_phrases(
    docs: DataFrame, scratch: Scratch, text: str = "text", lang: str = "lang", support: int = 100, longest: int = 5
) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to ``longest`` words that stand ``support`` times or more: ``lang``, ``phrase``, ``words``,
    ``f``; and ``lang``, ``n`` of all words. Both are tables in the shared folder.

    The driver gets a number per language and filters of bounded size. Candidates are told apart by their words when
    they are counted, so hashes that collide only make more of them.
    """
    share = docs.sparkSession.sparkContext.broadcast
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    words = scratch.written(word_counts(texts))
    totals = scratch.written(words.groupBy("lang").agg(F.sum("f").alias("n")))
    frequent = words.filter(F.col("f") >= support)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words = values(batch, "lang"), as_bytes(batch, "phrase")
            for lang in set(langs):
                own = _hashes([word for word, other in zip(words, langs) if other == lang], lang)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["hash"])

    kept = short_batches(frequent.select("lang", "phrase")).mapInArrow(hashed, "hash long")
    known = share(_Words(hash_filter(kept, _bits(frequent.count()))))
    every = totals.agg(F.sum("n")).first()[0] or 0
    bits = CELL_BITS + min(24, max(2, math.ceil(math.log2(max(1, every) / SHARDS / PACKED))))
    least = -(-support // SHARDS)
    local = scratch.written(_locally_frequent(texts, known, least, min(2, longest), bits).distinct())
    pairs = share(hash_filter(local, _bits(local.count())))
    if longest > 2:
        local = local.unionByName(scratch.written(_locally_frequent(texts, known, least, longest, bits, pairs).distinct()))
    candidates = share(hash_filter(local, _bits(local.count())))
    phrases = _counted(texts, known, candidates, longest, bits).filter(F.col("f") >= support)
    whole = frequent.withColumn("words", F.lit(1)).unionByName(phrases.withColumn("words", F.size(F.split("phrase", " "))))
    found = scratch.written(whole.select("lang", "phrase", "words", "f"))
    for shared in (known, pairs, candidates):
        shared.destroy()
    return found, totals


def scored(found: DataFrame, totals: DataFrame, per: int = 1000) -> DataFrame:
    """Phrases of two words or more with their worst cut: ``lang``, ``phrase``, ``words``, ``a``, ``l``, ``r``, ``n``, ``score``.

    The score of a cut is floor(per * a * n / (l * r)) in decimals of 38 digits; the lowest counts, then the shortest
    first part. Parts of a frequent phrase are frequent, so they stand in ``found`` themselves.
    """
    long = found.filter("words > 1").join(totals, "lang").withColumn("parts", F.split("phrase", " "))
    cut = long.select("lang", "phrase", "words", F.col("f").alias("a"), "n", "parts", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    joined = lambda start, length: F.array_join(F.slice("parts", start, length), " ")
    cut = cut.select(
        "lang", "phrase", "words", "a", "n", "k", joined(F.lit(1), F.col("k")).alias("first"),
        joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"),
    )
    left = found.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    number = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.expr("(a_ * n_ * p_) div (l_ * r_)")
    both = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumns(
        {f"{c}_": number(c) for c in ("a", "n", "l", "r")} | {"p_": F.lit(per).cast("decimal(4,0)")}
    ).withColumn("score", score)
    worst = F.min(F.struct("score", "k", "l", "r")).alias("worst")
    return both.groupBy("lang", "phrase", "words", "a", "n").agg(worst).select(
        "lang", "phrase", "words", "a", F.col("worst.l").alias("l"), F.col("worst.r").alias("r"), "n", F.col("worst.score").alias("score"))


def _covered(found: DataFrame) -> DataFrame:
    """Phrases inside a longer one that is as frequent. A phrase between the two is at least as frequent as the longer
    one, so those of one word more tell."""
    parts = F.split("phrase", " ")
    shorter = F.array(
        F.array_join(F.slice(parts, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(parts, F.lit(2), F.col("words") - 1), " "))
    longer = found.filter("words > 2").select("lang", F.explode(shorter).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return found.filter("words > 1").join(longer, ["lang", "phrase"]).filter(F.col("most") >= F.col("f")).select("lang", "phrase")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", support: int = 100, longest: int = 5, top: int = 2000
) -> DataFrame:
    """Each language's ``top`` phrases: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Ordered by score, then count, then the phrase's bytes. NULL and empty texts have no words, a NULL language is
    ``und``. Ties are settled by the phrase, which is unique in its language; repeated rows count each time. Texts are
    counted whole, however long. An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch()
    found, totals = frequent_phrases(docs, scratch, text, lang, support, longest)
    kept = scored(found, totals).join(_covered(found), ["lang", "phrase"], "left_anti")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
