"""What the operators of this package share: words as bytes, Arrow maps, folders that all executors see."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpaudit.session import checkpointed

#: Rows that a Python function gets at a time; keeps a task's memory to a few hundred texts.
SLICE = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task passes to Python at a time, at most. Spark's own setting suits short rows; texts can be long.
BATCH_ROWS = 1_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches held to ``BATCH_ROWS`` rows (a smaller setting stays)."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_SETTING)) <= BATCH_ROWS:
        conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return df


def _byte_table(keep: Callable[[int], bool]) -> bytes:
    lowered = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return bytes(b if keep(b) else 32 for b in lowered)


#: Lower-cases A-Z and blanks every ASCII character that is neither a letter nor a digit.
LETTERS_AND_DIGITS = _byte_table(lambda b: b >= 128 or 48 <= b <= 57 or 97 <= b <= 122)
#: Lower-cases A-Z only.
LOWER = _byte_table(lambda b: True)


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and any character beyond ASCII."""
    return (text or b"").translate(LETTERS_AND_DIGITS).split()


def blank_words(text: bytes | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return (text or b"").translate(LOWER).split()


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], list[tuple]], schema: StructType) -> DataFrame:
    """``function`` turns a batch of at most ``SLICE`` rows into result rows, one tuple each, in schema order."""
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                rows = function(batch.slice(start, SLICE))
                if rows:
                    yield to_batch(rows, target)

    return short_batches(df).mapInArrow(run, schema)


def to_batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=field.type) for values, field in zip(columns, target)], schema=target
    )


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column's values as UTF-8."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name under the checkpoint folder, which every executor can reach."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        checkpointed(spark.range(1))  # takes the session's setting, or makes a folder on a local master
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: its lineage ends there."""
    return Scratch().written(df)


class Scratch:
    """Tables in the shared folder that are deleted when what was made from them is written itself."""

    def __init__(self):
        self.folders: list[tuple[SparkSession, str]] = []

    def written(self, df: DataFrame) -> DataFrame:
        spark, folder = df.sparkSession, shared_folder(df.sparkSession)
        df.write.parquet(folder)
        self.folders.append((spark, folder))
        return spark.read.schema(df.schema).parquet(folder)

    def clear(self) -> None:
        for spark, folder in self.folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if self.folders:
            unused_dropped(self.folders[0][0])
        self.folders = []


def unused_dropped(spark: SparkSession) -> None:
    """Has the executors drop shuffle files and broadcasts of plans that nothing refers to any more.

    Spark's cleaner learns of such plans from the driver's garbage collection alone, which may not come for long: an
    operator of many rounds would keep all rounds' files until then.
    """
    gc.collect()
    spark._jvm.System.gc()


#: Distinct words whose hashes a worker remembers before it starts afresh.
REMEMBERED = 150_000


class WordHashes(dict):
    """64-bit hash of a word's bytes, the same on every machine; ``numbers`` gives those of a text as an array."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed_bits(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits (the finaliser of a public hash; a one-to-one map)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` word hashes."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(count, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[i:i + count]
        return mixed_bits(h)


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of every window of ``width``, by doubling."""
    span = 1
    while span * 2 <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    rest = width - span
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


#: Low bits of a key that hold its place, so that the leftmost of equal hashes is the least.
PLACE_BITS = 28


def winnowed(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places picked by at least one window of ``width`` hashes: the leftmost least one (the top bits decide).

    The pick depends on the window's hashes alone, so equal windows pick the same places in every text.
    """
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    keys = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    places = (window_minima(keys, width) & mask).astype(np.int64)
    return places[np.flatnonzero(np.diff(places, prepend=-1))]


def hash_filter(hashes: DataFrame, size: int) -> np.ndarray:
    """``size`` bits with two set for each ``hash``, or-ed on the executors: size / 64 rows at most come to the driver,
    however many hashes there are. A full filter lets everything through; it only saves work for what decides later."""
    probes = F.array(F.expr(f"hash & {size - 1}L"), F.expr(f"shiftrightunsigned(hash, 32) & {size - 1}L"))
    rows = (
        hashes.select(F.explode(probes).alias("bit"))
        .groupBy(F.expr("bit div 64").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow()
    )
    words = np.zeros(size // 64, np.int64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return words.view(np.uint64)


#: Bits that a filter has for each of its hashes, if it may grow: about one in twenty of other hashes passes then.
BITS_PER_HASH = 8


def grown_filter(hashes: DataFrame, least: int, most: int) -> np.ndarray:
    """``hash_filter`` of ``least`` bits, or of as many more, up to ``most``, as the number of ``hashes`` asks for. A filter
    whose size stays the same fills up as tables grow, until all pass. ``hashes`` is read twice: a written table."""
    wanted, bits = BITS_PER_HASH * hashes.count(), least
    while bits < min(wanted, most):
        bits *= 2
    return hash_filter(hashes, bits)


def in_filter(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits, found = np.uint64(64 * len(words) - 1), np.ones(len(hashes), bool)
    for probe in (hashes & bits, (hashes >> np.uint64(32)) & bits):
        found &= (words[probe >> np.uint64(6)] >> (probe & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def passing(df: DataFrame, hash_column: str, words: np.ndarray, wanted: bool = True) -> DataFrame:
    """The rows whose hash is in a filter, or (``wanted`` false) those whose hash isn't: together, every row once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.array(values(batch, hash_column), np.int64).view(np.uint64)
            kept = batch.filter(pa.array(in_filter(words, hashes) == wanted))
            if kept.num_rows:
                yield kept

    return short_batches(df).mapInArrow(run, df.schema)


def without(docs: DataFrame, gone: DataFrame, columns: list[str], size: int = 1 << 23) -> DataFrame:
    """``docs`` without the rows whose ``columns`` (no NULLs) stand in ``gone``. A filter of fixed size, made from
    ``gone``, lets rows that are surely kept pass by; only the others are joined and shuffled."""
    hashed = docs.withColumn("_hash", F.xxhash64(*columns))
    words = hash_filter(gone.select(F.xxhash64(*columns).alias("hash")), size)
    left = passing(hashed, "_hash", words).join(gone.select(*columns).distinct(), columns, "left_anti").select(*docs.columns)
    return passing(hashed, "_hash", words, wanted=False).select(*docs.columns).unionByName(left)
