"""A quality classifier that learns from documents' labels which passages matter: gated attention over passages.

A document is a bag of passages. Each is encoded, a gate weighs it against the document's others, and the weighted sum of
the encodings is what gets the score. Only documents have labels; the weights follow from them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from corpaudit.llm.common import arrow_map, as_bytes, mixed_bits, values


@dataclass(frozen=True)
class Settings:
    """``fit_rows`` per class bound the labelled rows that are used, in the order of md5(key); texts of more than
    ``fit_passages`` passages are scored, but not fitted on. Both bound what the driver holds, whatever the corpus."""

    words: int = 48
    buckets: int = 64
    encoded: int = 24
    gates: int = 12
    fit_rows: int = 2500
    fit_passages: int = 128
    epochs: int = 12
    rate: float = 0.003
    decay: float = 1e-4
    seed: int = 11


def _classes() -> np.ndarray:
    """A class for every byte: blanks, line ends, small and capital letters, digits, five kinds of signs, beyond ASCII."""
    table = np.full(256, 8, np.uint8)
    table[128:] = 10
    table[list(b" \t")] = 0
    table[list(b"\n\x0b\x0c\r")] = 1
    table[97:123], table[65:91], table[48:58] = 2, 3, 4
    table[list(b".?")], table[list(b",;:'-")], table[list(b"!")] = 5, 6, 7
    table[list(b"#*$%&|<>=_~^@+\\/{}[]")] = 9
    return table


_CLASS, _CLASSES = _classes(), 11
_LETTER = np.isin(_CLASS, (2, 3, 10))
_SPACE = _CLASS <= 1
_SMALL = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
_FACTOR = 0x9E3779B97F4A7C15
#: Numbers per passage besides the hashed words.
_PLAIN = _CLASSES + 11


def _word_hashes(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: a polynomial of its bytes, read off running sums."""
    n = len(letters)
    with np.errstate(over="ignore"):
        factor = np.full(n + 1, _FACTOR, np.uint64)
        factor[0] = 1
        powers = np.cumprod(factor, dtype=np.uint64)
        factor[1:] = np.uint64(pow(_FACTOR, -1, 1 << 64))
        inverse = np.cumprod(factor, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((letters + np.uint64(1)) * powers[:n], dtype=np.uint64)])
        return mixed_bits((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _repeated(hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes come more than once."""
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def passage_vectors(data: bytes | None, settings: Settings) -> np.ndarray:
    """A row of numbers for every passage of ``words`` words: byte classes, word shapes, repetition, hashed words.

    A text without words has one empty passage.
    """
    s = settings
    raw = np.frombuffer(data or b"", np.uint8)
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    if not n:
        return np.zeros((1, _PLAIN + s.buckets), np.float32)
    passages = -(-n // s.words)
    passage = np.arange(n) // s.words
    firsts = np.arange(0, n, s.words)
    sizes = np.diff(np.append(firsts, n)).astype(np.float64)
    cuts = np.append(starts[firsts], len(raw))
    cuts[0] = 0
    of_byte = np.repeat(np.arange(passages), np.diff(cuts))
    classes = np.bincount(of_byte * _CLASSES + _CLASS[raw], minlength=passages * _CLASSES).reshape(passages, -1)
    shares = classes / np.maximum(1, classes.sum(axis=1, keepdims=True))

    hashes = _word_hashes(_SMALL[raw], starts, ends)
    lengths = ends - starts
    opening, closing = _CLASS[raw[starts]], _CLASS[raw[ends - 1]]
    lettered = np.add.reduceat(_LETTER[raw].astype(np.int64), starts) > 0
    same = np.concatenate([[False], hashes[1:] == hashes[:-1]])
    with np.errstate(over="ignore"):
        threes = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7) if n > 2 else hashes[:0]
    again = np.zeros(n, bool)
    again[:len(threes)] = _repeated(threes)
    pairs = np.unique(passage.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    distinct = np.bincount((pairs >> np.uint64(40)).astype(np.int64), minlength=passages)

    def mean(found: np.ndarray) -> np.ndarray:
        return np.add.reduceat(found.astype(np.float64), firsts) / sizes

    plain = np.column_stack([
        shares, np.log1p(sizes), mean(lengths) / 10, mean(lengths == 1), mean(lengths > 15), mean(opening == 3), mean(~lettered),
        mean(same), distinct / sizes, mean(again), mean(closing >= 5) - mean(closing == 10), mean(closing == 9),
    ])
    bucket = (hashes % np.uint64(s.buckets)).astype(np.int64)
    words = np.bincount(passage * s.buckets + bucket, minlength=passages * s.buckets).reshape(passages, -1) / sizes[:, None]
    return np.concatenate([plain, words], axis=1).astype(np.float32)


@dataclass
class AttentionClassifier:
    """``parts`` are the encoder, the two layers of the gate, the gate's weights and the output; numbers are centred."""

    settings: Settings
    centre: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray] = field(default_factory=dict)

    def prepared(self, vectors: np.ndarray) -> np.ndarray:
        return np.clip((vectors - self.centre) / self.scale, -8, 8)

    def forward(self, x: np.ndarray) -> tuple:
        p = self.parts
        h = np.tanh(x @ p["encode"] + p["encode_bias"])
        t, g = np.tanh(h @ p["value"]), 1 / (1 + np.exp(-np.clip(h @ p["gate"], -30, 30)))
        e = (t * g) @ p["weigh"]
        a = np.exp(e - e.max())
        a /= a.sum()
        z = a @ h
        return h, t, g, a, z, float(z @ p["out"] + p["out_bias"][0])

    def judged(self, vectors: np.ndarray) -> tuple[float, np.ndarray]:
        """The score, and how much each passage counts (the sum is 1)."""
        *_, attention, _, logit = self.forward(self.prepared(vectors))
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30)))), attention

    def gradients(self, x: np.ndarray, label: int, weight: float) -> dict[str, np.ndarray]:
        p = self.parts
        h, t, g, a, z, logit = self.forward(x)
        slope = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label)
        to_z = slope * p["out"]
        to_a = h @ to_z
        to_e = a * (to_a - a @ to_a)
        to_tg = to_e[:, None] * p["weigh"]
        to_t, to_g = to_tg * g * (1 - t * t), to_tg * t * g * (1 - g)
        to_h = (a[:, None] * to_z + to_t @ p["value"].T + to_g @ p["gate"].T) * (1 - h * h)
        return {
            "encode": x.T @ to_h, "encode_bias": to_h.sum(axis=0), "value": h.T @ to_t, "gate": h.T @ to_g,
            "weigh": (t * g).T @ to_e, "out": slope * z, "out_bias": np.array([slope]),
        }


def fitted(texts: Sequence[np.ndarray], labels: Sequence[int], weights: Sequence[float], settings: Settings) -> AttentionClassifier:
    """Trains by Adam on batches of eight documents in a seeded order; all parts move, by the documents' labels alone."""
    s = settings
    rng = np.random.default_rng(s.seed)
    rows = np.concatenate(texts).astype(np.float64)
    model = AttentionClassifier(s, rows.mean(axis=0).astype(np.float32), np.maximum(rows.std(axis=0), 1e-3).astype(np.float32))
    width = rows.shape[1]
    del rows
    model.parts = {
        "encode": rng.normal(0, 0.6 / width**0.5, (width, s.encoded)), "encode_bias": np.zeros(s.encoded),
        "value": rng.normal(0, s.encoded**-0.5, (s.encoded, s.gates)), "gate": rng.normal(0, s.encoded**-0.5, (s.encoded, s.gates)),
        "weigh": rng.normal(0, s.gates**-0.5, s.gates), "out": rng.normal(0, s.encoded**-0.5, s.encoded), "out_bias": np.zeros(1),
    }
    first = {name: np.zeros_like(part) for name, part in model.parts.items()}
    second = {name: np.zeros_like(part) for name, part in model.parts.items()}
    prepared = [model.prepared(text) for text in texts]
    step, steps = 0, s.epochs * -(-len(texts) // 8)
    for _ in range(s.epochs):
        order = rng.permutation(len(texts))
        for start in range(0, len(order), 8):
            batch = order[start:start + 8]
            total = {name: s.decay * part for name, part in model.parts.items()}
            for i in batch:
                for name, gradient in model.gradients(prepared[i], labels[i], weights[i]).items():
                    total[name] = total[name] + gradient / len(batch)
            step += 1
            rate = s.rate * (1 - step / (steps + 1)) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for name, part in model.parts.items():
                first[name] += 0.1 * (total[name] - first[name])
                second[name] += 0.001 * (total[name] ** 2 - second[name])
                part -= rate * first[name] / (np.sqrt(second[name]) + 1e-8)
    return model


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", target: str = "quality",
    settings: Settings = Settings(),
) -> AttentionClassifier | None:
    """Fits on the labelled rows for which ``learn`` (of the key) holds; None without rows of both classes.

    A class beyond ``fit_rows`` rows is represented by those with the smallest md5(key), weighted up to its size, so that
    scores are probabilities of the whole. A key labelled twice is 0 if any label says so, NULL labels are none; of a key
    that repeats in ``docs`` one row is taken. Keys and labels are read under names of their own.
    """
    s = settings
    known = labels.select(F.col(key).alias("id"), F.col(target).alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    known = known.withColumnRenamed("id", key).filter(learn).withColumnRenamed(key, "id")
    known = known.groupBy("id").agg((F.min("label") > 0).cast("int").alias("label"))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    known = known.join(texts.select("id"), "id", "left_semi").withColumn("order", F.md5(F.col("id").cast("string")))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    chosen = known.filter("label = 1").orderBy("order", "id").limit(s.fit_rows).unionByName(
        known.filter("label = 0").orderBy("order", "id").limit(s.fit_rows))

    def encoded(batch: pa.RecordBatch) -> list[tuple]:
        rows = []
        for own, order, label, data in zip(*(values(batch, c) for c in ("id", "order", "label")), as_bytes(batch, "text")):
            vectors = passage_vectors(data, s)
            if len(vectors) <= s.fit_passages:
                rows.append((own, order, label, vectors.astype(np.float16).tobytes()))
        return rows

    sample = texts.join(F.broadcast(chosen), "id").select("id", "order", "label", "text")  # 2 * fit_rows rows
    schema = T.StructType([*sample.schema.fields[:3], T.StructField("vectors", T.BinaryType())])
    found = arrow_map(sample, encoded, schema).groupBy("id", "order", "label").agg(F.min("vectors").alias("vectors")).toArrow()
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("order", "label", "vectors"))))
    used = np.bincount([label for _, label, _ in rows], minlength=2)
    if not used.all():
        return None
    size = _PLAIN + s.buckets
    weight = [sizes[c] / used[c] * used.sum() / sum(sizes.values()) for c in (0, 1)]
    return fitted(
        [np.frombuffer(v, np.float16).reshape(-1, size).astype(np.float32) for _, _, v in rows],
        [label for _, label, _ in rows], [weight[label] for _, label, _ in rows], s,
    )


def quality_scores(
    docs: DataFrame, model: AttentionClassifier | None, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """``key``, ``keep``, ``score``, ``n_passages`` and ``heaviest``, the place of the passage that counts most, of every
    whole text, as a map.

    The score depends on the text alone. NULL and empty texts have one empty passage. Without a model, scores are 1.
    Repeated rows and NULL keys stay rows of their own; columns that aren't named are not read, and the text is read
    under a name of its own unless it is kept. The model goes to the tasks by broadcast; its size is a parameter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    settings = Settings() if model is None else model.settings
    columns = list(dict.fromkeys([key, *keep]))
    schema = T.StructType([
        *(docs.schema[c] for c in columns), T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.LongType()),
        T.StructField("heaviest", T.LongType()),
    ])

    def run(batch: pa.RecordBatch) -> list[tuple]:
        own, rows = shared.value, []
        texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
        kept = [batch.column(i).to_pylist() for i in range(len(columns))]
        for *first, data in zip(*kept, texts):
            vectors = passage_vectors(data, settings)
            if own is None:
                rows.append((*first, 1.0, len(vectors), 0))
            else:
                score, attention = own.judged(vectors)
                rows.append((*first, score, len(vectors), int(attention.argmax())))
        return rows

    return arrow_map(docs.select(*columns, F.col(text).alias("text")), run, schema)
