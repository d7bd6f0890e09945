"""A convolutional text classifier in numpy: hashed word embeddings, filters of several widths, max pooling.

All labelled rows are fitted or calibrated on, whole. They are dealt into pieces of about ``Settings.piece_rows`` rows; in
every epoch each piece's task trains on its rows from the parameters of the epoch before, and the steps of all pieces are
averaged per parameter by a shuffle. The driver holds the parameters, whose number is a setting, and no row.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from corpaudit.llm.common import SLICE, WordHashes, arrow_map, as_bytes, plain_words, short_batches, values
from corpaudit.operators.ranks import prefix_sums
from corpaudit.session import checkpointed

_HASHES = WordHashes()


@dataclass(frozen=True)
class Settings:
    """``buckets`` is the size of either embedding table, whatever the vocabulary; ``piece_rows`` the labelled rows that a
    task trains on, about."""

    buckets: int = 1 << 17
    dims: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    piece_rows: int = 4000
    epochs: int = 4
    rate: float = 0.05
    decay: float = 1e-4
    min_rows: int = 4
    precision: float = 0.98
    least_threshold: float = 0.25
    min_positives: int = 10
    seed: int = 7


def word_rows(data: bytes | None, buckets: int) -> np.ndarray:
    """Each word's rows in the two embedding tables: two slices of its hash, so that two words seldom share both."""
    h = _HASHES.numbers(plain_words(data))
    size = np.uint64(buckets)
    return np.stack([h % size, size + (h >> np.uint64(32)) % size]).astype(np.int32)


@dataclass
class ConvolutionalClassifier:
    """Scores of texts given as word rows. ``scale`` and ``shift`` calibrate, ``thresholds`` hold verdicts by language."""

    settings: Settings
    table: np.ndarray = None
    kernels: list[np.ndarray] = field(default_factory=list)  # per width: filters x width x 2 dims
    biases: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray = None
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def _embedded(self, rows: np.ndarray) -> np.ndarray:
        """Words by both tables' dimensions, with blank words behind the text for filters that reach over its end."""
        s = self.settings
        x = np.zeros((rows.shape[1] + max(s.widths) - 1, 2 * s.dims), np.float32)
        x[:rows.shape[1], :s.dims] = self.table[rows[0]]
        x[:rows.shape[1], s.dims:] = self.table[rows[1]]
        return x

    def _pooled(self, x: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The largest answer of every filter over the whole text, 0 at least, and where it stands."""
        pooled, places = [], []
        for width, kernel, bias in zip(self.settings.widths, self.kernels, self.biases):
            answers = x[:n] @ kernel[:, 0].T
            for offset in range(1, width):
                answers += x[offset:offset + n] @ kernel[:, offset].T
            place = answers.argmax(axis=0)
            places.append(place)
            pooled.append(np.maximum(answers[place, np.arange(len(place))] + bias, 0))
        return np.concatenate(pooled), places

    def raw(self, rows: np.ndarray) -> float:
        if not rows.shape[1]:
            return float(self.bias)
        pooled, _ = self._pooled(self._embedded(rows), rows.shape[1])
        return float(pooled @ self.weights + self.bias)

    def score(self, rows: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.raw(rows) + self.shift, -40, 40))))

    def threshold(self, language: str | None) -> float:
        return self.thresholds.get(language, self.thresholds.get(None, 0.5))


def _evidence(counts: np.ndarray, totals: np.ndarray, settings: Settings) -> np.ndarray:
    """Per embedding row, the log odds of the label, drawn towards 0 by their standard error; 0 for rare rows. ``counts``
    are the texts of either label that have the row, ``totals`` all of them."""
    clean, toxic = counts + 0.5
    odds = np.log(toxic / (totals[1] + 1.0)) - np.log(clean / (totals[0] + 1.0))
    shrunk = np.sign(odds) * np.maximum(np.abs(odds) - np.sqrt(1 / toxic + 1 / clean), 0)
    return np.where(counts.sum(axis=0) >= settings.min_rows, shrunk, 0).astype(np.float32)


def _counted(texts: Iterator[tuple[np.ndarray, int]], settings: Settings) -> np.ndarray:
    counts = np.zeros((2, 2 * settings.buckets), np.int64)
    for rows, label in texts:
        counts[label, np.unique(rows)] += 1
    return counts


@dataclass
class _Training:
    """A model with Adagrad's sums of squares. Steps list both as matrices of ``dims`` columns: the rows of the embedding
    tables, then all other parameters in a row."""

    model: ConvolutionalClassifier
    importance: np.ndarray
    squares: list[np.ndarray]
    bias_square: float = 1e-2

    @classmethod
    def begun(cls, counts: np.ndarray, totals: np.ndarray, settings: Settings) -> "_Training":
        """The first dimension of the tables starts as the word rows' evidence, all else is random."""
        s, rng, deep = settings, np.random.default_rng(settings.seed), 2 * settings.dims
        model = ConvolutionalClassifier(s)
        model.table = rng.normal(0, 0.05, (2 * s.buckets, s.dims)).astype(np.float32)
        model.table[:, 0] = _evidence(counts, totals, s) / 2
        for width in s.widths:
            kernel = rng.normal(0, 0.1, (s.filters, width, deep)).astype(np.float32)
            kernel[:, :, 0] += 0.5
            kernel[:, :, s.dims] += 0.5
            model.kernels.append(kernel)
            model.biases.append(np.zeros(s.filters, np.float32))
        model.weights = np.full(s.filters * len(s.widths), 0.1, np.float32)
        model.bias = -1.0
        squares = [np.full_like(p, 1e-2) for p in (model.table, *model.kernels, *model.biases, model.weights)]
        share = totals / max(1, totals.sum())
        return cls(model, 0.5 / np.maximum(share, 1e-9), squares)

    def _lists(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        m = self.model
        return [m.table, *m.kernels, *m.biases, m.weights], self.squares

    def _small(self) -> tuple[np.ndarray, np.ndarray]:
        """What follows the embedding tables in the list of parameters, and its sums of squares."""
        dims, packed = self.model.settings.dims, []
        for arrays, bias in zip(self._lists(), (self.model.bias, self.bias_square)):
            rest = np.concatenate([*(a.ravel() for a in arrays[1:]), [bias]])
            packed.append(np.pad(rest, (0, -len(rest) % dims)).reshape(-1, dims).astype(np.float64))
        return packed[0], packed[1]

    def steps_from(self, before: "_Training") -> tuple[np.ndarray, list[np.ndarray]]:
        """The places that moved since ``before``, and their steps: of parameters, then of squares. The tables are compared
        as they are; only rows that moved are taken out."""
        tables = [(a[0], b[0]) for a, b in zip(self._lists(), before._lists())]
        smalls = list(zip(self._small(), before._small()))
        moved = [np.flatnonzero((after != old).any(axis=1)) for after, old in (tables[1], smalls[1])]
        steps = [
            np.concatenate([after[at].astype(np.float64) - old[at] for (after, old), at in zip((table, small), moved)])
            for table, small in zip(tables, smalls)
        ]
        return np.concatenate([moved[0], len(tables[0][0]) + moved[1]]), steps

    def move(self, places: np.ndarray, steps: Sequence[np.ndarray]) -> None:
        """Adds the steps of parameters and of squares at the places."""
        size, ends = len(self.model.table), []
        inside = places < size
        for arrays, small, step in zip(self._lists(), self._small(), steps):
            arrays[0][places[inside]] = arrays[0][places[inside]].astype(np.float64) + step[inside]
            small[places[~inside] - size] += step[~inside]
            rest, at = small.ravel(), 0
            for a in arrays[1:]:
                a[...] = rest[at:at + a.size].reshape(a.shape)
                at += a.size
            ends.append(float(rest[at]))
        self.model.bias, self.bias_square = ends

    def step(self, rows: np.ndarray, label: int) -> None:
        """One text by Adagrad; gradients reach the words under each filter's largest answer."""
        model, s, n = self.model, self.model.settings, rows.shape[1]
        if not n:
            return
        x = model._embedded(rows)
        pooled, places = model._pooled(x, n)
        z = float(pooled @ model.weights + model.bias)
        slope = float(self.importance[label]) * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label)
        to_pooled = slope * model.weights * (pooled > 0)
        steps = [s.decay * k for k in model.kernels], [None] * len(s.widths)
        touched, moves = [], []
        for j, width in enumerate(s.widths):
            part = to_pooled[j * s.filters:(j + 1) * s.filters]
            spots = places[j][:, None] + np.arange(width)
            steps[0][j] += part[:, None, None] * x[spots]
            steps[1][j] = part
            inside = spots < n
            move = part[:, None, None] * model.kernels[j]
            at = spots[inside]
            touched += [rows[0, at], rows[1, at]]
            moves += [move[inside][:, :s.dims], move[inside][:, s.dims:]]
        gradients = [*steps[0], *steps[1], slope * pooled + s.decay * model.weights]
        for parameter, square, gradient in zip((*model.kernels, *model.biases, model.weights), self.squares[1:], gradients):
            square += gradient * gradient
            parameter -= s.rate * gradient / np.sqrt(square)
        self.bias_square += slope * slope
        model.bias -= s.rate * slope / self.bias_square**0.5
        where, inverse = np.unique(np.concatenate(touched), return_inverse=True)
        total = np.zeros((len(where), s.dims), np.float32)
        np.add.at(total, inverse, np.concatenate(moves))
        self.squares[0][where] += total * total
        model.table[where] -= s.rate * total / np.sqrt(self.squares[0][where])


def fitted(texts: Sequence[np.ndarray], labels: Sequence[int], settings: Settings) -> ConvolutionalClassifier:
    """Trains on texts at hand, one at a time in a seeded order."""
    labels, rng = np.asarray(labels, np.int64), np.random.default_rng(settings.seed)
    counts = _counted(zip(texts, labels), settings)
    training = _Training.begun(counts, np.bincount(labels, minlength=2), settings)
    for _ in range(settings.epochs):
        for i in rng.permutation(len(texts)):
            training.step(texts[i], labels[i])
    return training.model


#: Rows of raw answers that a task of the scaling's steps takes, about.
ANSWER_ROWS = 400_000
#: Steps are added up as whole numbers of these parts, so that the order of the sum doesn't show.
_PARTS = (2.0**32, 2.0**24)


def _packed(texts: DataFrame) -> DataFrame:
    """``_text`` as compressed bytes: a checkpoint holds rows as they are, and every epoch reads them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [None if data is None else zlib.compress(data, 1) for data in as_bytes(batch, "_text")]
            yield batch.set_column(0, "_text", pa.array(packed, pa.binary()))

    return short_batches(texts).mapInArrow(run, "_text binary, _lang string, _label int, _fits boolean")


def _labelled(batches: Iterator[pa.RecordBatch], settings: Settings, fits: bool) -> Iterator[list[tuple]]:
    """Lists of (word rows, label, language) of the texts to fit, or (``fits`` false) to calibrate on."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            part = part.filter(pa.array([f == fits for f in values(part, "_fits")], pa.bool_()))
            yield [
                (word_rows(None if data is None else zlib.decompress(data), settings.buckets), label, language)
                for data, label, language in zip(values(part, "_text"), values(part, "_label"), values(part, "_lang"))
            ]


def _row_counts(pieces: DataFrame, settings: Settings) -> np.ndarray:
    """In how many texts to fit of either label an embedding row stands: a row for each of them comes to the driver."""
    s = settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counted(((rows, label) for part in _labelled(batches, s, True) for rows, label, _ in part), s)
        used = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(counts[0, used]), pa.array(counts[1, used])], names=["place", "clean", "toxic"])

    found = short_batches(pieces).mapInArrow(run, "place int, clean long, toxic long").groupBy("place").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    counts = np.zeros((2, 2 * s.buckets), np.int64)
    for row, name in enumerate(("clean", "toxic")):
        counts[row, found["place"].to_numpy()] = found[name].to_numpy()
    return counts


def _epoch(pieces: DataFrame, training: _Training, epoch: int) -> None:
    """Every piece trains on its own from where ``training`` stands; a parameter's new value is the mean of the pieces that
    moved it. One row per ``dims`` parameters comes to the driver."""
    s = training.model.settings
    shared = pieces.sparkSession.sparkContext.broadcast(training)
    names = [f"{kind}{i}" for kind in ("move", "square") for i in range(s.dims)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = copy.deepcopy(shared.value)  # a worker may keep the shared object for its next piece
        rng = np.random.default_rng((s.seed, epoch, TaskContext.get().partitionId()))
        for part in _labelled(batches, s, True):
            for i in rng.permutation(len(part)):
                own.step(part[i][0], part[i][1])
        moved, steps = own.steps_from(shared.value)
        columns = [pa.array(c) for matrix, parts in zip(steps, _PARTS) for c in np.rint(matrix * parts).astype(np.int64).T]
        made = pa.RecordBatch.from_arrays([pa.array(moved, pa.int32()), *columns], names=["place", *names])
        for start in range(0, made.num_rows, 10_000):
            yield made.slice(start, 10_000)

    moves = short_batches(pieces).mapInArrow(run, ", ".join(["place int", *(f"{n} long" for n in names)]))
    scale = lambda n: _PARTS[n.startswith("square")]
    merged = moves.groupBy("place").agg(
        *[(F.sum(n) / F.count(F.lit(1)) / F.lit(scale(n))).cast("float").alias(n) for n in names]).toArrow()
    training.move(merged["place"].to_numpy(), [
        np.stack([merged[f"{kind}{i}"].to_numpy() for i in range(s.dims)], axis=1) for kind in ("move", "square")])
    shared.destroy()


def _scaled(raws: DataFrame) -> tuple[float, float]:
    """Logistic scaling of the raw answers by Newton steps: every step sums five numbers per partition."""
    a, b = 1.0, 0.0
    for _ in range(100):  # a convex objective; the ridge keeps separable rows finite
        def sums(batches: Iterator[pa.RecordBatch], a: float = a, b: float = b) -> Iterator[pa.RecordBatch]:
            found = np.zeros(5)
            for batch in batches:
                x, y = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("raw", "label"))
                p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
                w = p * (1 - p)
                found += [((p - y) * x).sum(), (p - y).sum(), (w * x * x).sum(), (w * x).sum(), w.sum()]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in found], names=list("abcde"))

        # Exact sums: the order in which partitions arrive doesn't show.
        rows = raws.mapInArrow(sums, "a double, b double, c double, d double, e double").collect()
        g1, g2, h1, h2, h3 = (math.fsum(r[i] for r in rows) for i in range(5))
        step = np.linalg.solve(
            np.array([[h1 + 1e-2, h2], [h2, h3 + 1e-2]]), np.array([g1 + 1e-2 * (a - 1), g2 + 1e-2 * b]))
        size = min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        a, b = a - size * float(step[0]), b - size * float(step[1])
        if np.abs(step).max() < 1e-8:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def _thresholds(scores: DataFrame, settings: Settings) -> dict[str | None, float]:
    """For each language (and None: all rows) with enough positives the lowest threshold whose precision on these rows reaches
    the wanted one, ``least_threshold`` at the lowest; equal scores stand or fall together. One row per language."""
    s = settings
    own = F.when(F.col("lang").isNotNull(), F.concat(F.lit("="), F.col("lang")))
    grouped = scores.select(F.explode(F.filter(F.array(F.lit(""), own), lambda g: g.isNotNull())).alias("own"), "score", "label")
    ranked = checkpointed(prefix_sums(grouped, ["own"]).filter(F.col("total_pos") >= s.min_positives))
    good = F.col("cum_pos") / F.col("cum_n") >= s.precision
    lasts = ranked.groupBy("own").agg(F.min(F.when(good, F.col("score"))).alias("last"))
    found = ranked.join(F.broadcast(lasts), "own").groupBy("own", "last").agg(
        F.max(F.when(F.col("score") < F.col("last"), F.col("score"))).alias("following"))
    thresholds = {None: 0.5}
    for r in found.collect():
        language = r["own"][1:] if r["own"] else None
        if r["last"] is None:
            thresholds[language] = 0.5
        else:
            thresholds[language] = max((r["last"] + (r["following"] or 0.0)) / 2, s.least_threshold)
    return thresholds


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", target: str = "toxic",
    settings: Settings = Settings(),
) -> ConvolutionalClassifier | None:
    """Fits on labelled rows and calibrates on others; None without labelled rows of both classes.

    A row's part is crc32(key as text) mod 5: 0 is held out and never read here, 1 calibrates, the rest fits: all of them,
    whole. A key labelled twice is toxic if any label says so; NULL labels are none. A key that repeats in ``docs`` has a
    row for each. Pieces and sums don't depend on how the tables are partitioned.
    """
    s = settings
    part = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5
    known = labels.filter(F.col(target).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(
        (F.max(target) > 0).cast("int").alias("_label")
    ).filter(part != 0).withColumn("_fits", part != 1)
    # Two rows at most.
    sizes = docs.select(key).join(known.filter("_fits"), key).groupBy("_label").count().collect()
    totals = np.zeros(2, np.int64)
    for row in sizes:
        totals[row["_label"]] = row["count"]
    if not totals.all():
        return None
    count = math.ceil(totals.sum() / s.piece_rows)
    texts = docs.filter(F.col(key).isNotNull() & (part != 0)).select(key, text, F.col(lang).cast("string").alias("_lang"))
    joined = texts.repartition(count, key).join(known.repartition(count, key), key)
    ordered = joined.sortWithinPartitions(F.md5(F.col(key).cast("string")), text, "_lang").select(F.col(text).alias("_text"), "_lang", "_label", "_fits")
    pieces = checkpointed(_packed(ordered))
    training = _Training.begun(_row_counts(pieces, s), totals, s)
    for epoch in range(s.epochs):
        _epoch(pieces, training, epoch)
    model = training.model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _labelled(batches, s, False):
            yield pa.RecordBatch.from_arrays([
                pa.array([language for _, _, language in part], pa.string()), pa.array([label for _, label, _ in part], pa.int32()),
                pa.array([shared.value.raw(rows) for rows, _, _ in part], pa.float64()),
            ], names=["lang", "label", "raw"])

    # A few numbers a row: written in few files, which every step of the scaling reads. Sorted, so that sums agree in reruns.
    raws = short_batches(pieces).mapInArrow(answers, "lang string, label int, raw double")
    raws = checkpointed(raws.repartition(math.ceil(totals.sum() / ANSWER_ROWS)).sortWithinPartitions("raw", "label", "lang"))
    shared.destroy()
    model.scale, model.shift = _scaled(raws)
    z = F.least(F.greatest(F.col("raw") * model.scale + model.shift, F.lit(-40.0)), F.lit(40.0))
    model.thresholds = _thresholds(raws.select("lang", "label", (1 / (1 + F.exp(-z))).alias("score")), s)
    return model


def toxicity_scores(
    docs: DataFrame, model: ConvolutionalClassifier | None, key: str = "doc_id", text: str = "text", lang: str | None = "lang",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``key``, ``keep``, ``score`` and ``toxic`` of every whole text, as a map.

    The score depends on the text alone. ``toxic`` compares it with the threshold of the text's language, or with the
    one of all rows for languages without their own (NULL too). Without a model, scores are 0 and nothing is toxic.

    NULL and empty texts get the score of a text without any evidence. Repeated rows and NULL keys stay rows of their
    own; columns that aren't named are not read. The model goes to the tasks with the function; its size is a parameter.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    columns = [key, *keep]
    schema = T.StructType(
        [docs.schema[c] for c in columns] + [T.StructField("score", T.DoubleType()), T.StructField("toxic", T.BooleanType())]
    )

    def run(batch: pa.RecordBatch) -> list[tuple]:
        own = shared.value
        languages = values(batch, "_lang")
        scores = [0.0 if own is None else own.score(word_rows(d, own.settings.buckets)) for d in as_bytes(batch, text)]
        verdicts = [own is not None and s >= own.threshold(x) for s, x in zip(scores, languages)]
        return list(zip(*(values(batch, c) for c in columns), scores, verdicts))

    language = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    return arrow_map(docs.select(*dict.fromkeys([*columns, text]), language.alias("_lang")), run, schema)
