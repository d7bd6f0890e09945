"""A Merkle manifest of a dataset whose nodes keep midstates of SHA-256.

A node hashes its children's digests as hexadecimal text, 64 characters each: exactly one block of SHA-256. So the state
before a child is eight words, which can be stored. A node keeps one for each child slot. When a child is replaced,
hashing resumes at that slot's state with the replacement and the siblings on its right; those on its left aren't
hashed again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpaudit.llm.common import SLICE, Scratch, short_batches, to_batch, values

#: Children of a node, at most.
BRANCH = 16
#: Bytes of a digest, and of a midstate.
SIZE = 32


def _root_bits(count: int, power: int) -> np.ndarray:
    """The first 32 bits behind the point of the first primes' square or cube roots, as the standard asks for."""
    primes = [p for p in range(2, 400) if all(p % q for q in range(2, math.isqrt(p) + 1))][:count]
    found = []
    for prime in primes:
        wanted, root = prime << 32 * power, 0
        for bit in reversed(range(36)):
            if (root | 1 << bit) ** power <= wanted:
                root |= 1 << bit
        found.append(root & 0xFFFFFFFF)
    return np.array(found, np.uint32)


_ROUNDS, _START = _root_bits(64, 3), _root_bits(8, 2)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x >> np.uint32(by) | x << np.uint32(32 - by)


def resumed(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The states (8 x n words) after one more block (16 x n words) each."""
    w = list(blocks)
    for t in range(16, 64):
        low, high = w[t - 15], w[t - 2]
        low = _turned(low, 7) ^ _turned(low, 18) ^ low >> np.uint32(3)
        high = _turned(high, 17) ^ _turned(high, 19) ^ high >> np.uint32(10)
        w.append(w[t - 16] + low + w[t - 7] + high)
    a, b, c, d, e, f, g, h = states
    for t in range(64):
        one = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ e & (f ^ g)) + _ROUNDS[t] + w[t]
        two = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + (a & b | c & (a | b))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return states + np.stack([a, b, c, d, e, f, g, h])


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def hexadecimal(digests: np.ndarray) -> np.ndarray:
    """Digests (n x 32 bytes) as lowercase text (n x 64 bytes)."""
    return np.stack([_HEX[digests >> 4], _HEX[digests & 15]], axis=-1).reshape(*digests.shape[:-1], 2 * SIZE)


def _blocks(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(hexadecimal(digests)).view(">u4").astype(np.uint32).T


def _as_bytes(states: np.ndarray) -> np.ndarray:
    """States (8 x n words) as n x 32 bytes."""
    return np.ascontiguousarray(states.T).astype(">u4").view(np.uint8).reshape(-1, SIZE)


def _as_states(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data).view(">u4").astype(np.uint32).reshape(-1, 8).T


def finished(states: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Digests of messages of so many children's texts, from the states behind them."""
    closing = np.zeros((16, len(children)), np.uint32)
    closing[0], closing[15] = 0x80000000, children.astype(np.uint32) * np.uint32(512)
    return _as_bytes(resumed(states, closing))


def nodes_over(children: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of nodes and their states before each child (n x ``BRANCH`` x 32 bytes, zeros behind the last).

    ``children`` is n x ``BRANCH`` x 32 bytes, ``sizes`` tells how many of them there are.
    """
    states = np.repeat(_START[:, None], len(sizes), axis=1)
    kept = np.zeros((len(sizes), BRANCH, SIZE), np.uint8)
    for slot in range(int(sizes.max(initial=0))):
        there = np.flatnonzero(sizes > slot)
        kept[there, slot] = _as_bytes(states[:, there])
        states[:, there] = resumed(states[:, there], _blocks(children[there, slot]))
    return finished(states, sizes), kept


def refolded(
    current: np.ndarray, places: np.ndarray, sizes: np.ndarray, midstates: np.ndarray, children: np.ndarray, rows: np.ndarray
) -> np.ndarray:
    """Digests of parents after the child at ``places`` became ``current``: from the midstate of that place on, with the
    siblings on its right (``children[rows]``) only."""
    states = resumed(_as_states(midstates), _blocks(current))
    for step in range(1, BRANCH):
        there = np.flatnonzero(places + step < sizes)
        if len(there):
            states[:, there] = resumed(states[:, there], _blocks(children[rows[there], places[there] + step]))
    return finished(states, sizes)


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 in hexadecimal of fields, each as ``-`` if NULL, else its UTF-8 length in bytes, ``:`` and its text."""
    fields = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*fields), 256)


def _numbered(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``position`` in their ``tree`` by ``order`` and the tree's ``total``.

    Rows are dealt out by range of tree and order, so a large tree is spread over many tasks; each numbers its own runs,
    and what stands before a run is the sum of a row per earlier task.
    """
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    schema = T.StructType([*rows.schema.fields, T.StructField("piece", T.IntegerType()), T.StructField("place", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, last, place = TaskContext.get().partitionId(), None, -1
        for batch in batches:
            places = []
            for tree in values(batch, "tree"):
                place = place + 1 if tree == last else 0
                last = tree
                places.append(place)
            arrays = [*batch.columns, pa.array([piece] * len(places), pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, schema=to_arrow_schema(schema))

    runs = scratch.written(dealt.mapInArrow(number, schema))
    sizes = runs.groupBy("tree", "piece").agg(F.count(F.lit(1)).alias("n"))
    whole, before = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.written(sizes.select(
        "tree", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("total")
    ))
    return runs.join(starts, ["tree", "piece"]).withColumn("position", F.col("start") + F.col("place")).drop("piece", "place", "start")


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The digests in the list column ``nodes`` as rows x ``BRANCH`` x 32 bytes, and how many there are in each row."""
    lists = batch.column(batch.schema.get_field_index("nodes"))
    sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    found = np.zeros((len(sizes), BRANCH, SIZE), np.uint8)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    slots = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    found[rows, slots] = np.frombuffer(b"".join(lists.flatten().field("digest").to_pylist()), np.uint8).reshape(-1, SIZE)
    return found, sizes


def _parents(nodes: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Every run of ``BRANCH`` nodes as a row: ``tree``, ``position``, ``total`` (of the nodes in the tree), ``nodes``
    (their digests and ``keep``, in order), ``digest`` and ``states``. A tree's only node stays what it is: no states."""
    own = F.struct(F.col("position").alias("place"), "digest", *keep)
    runs = nodes.groupBy("tree", F.expr(f"position div {BRANCH}").alias("_run"), "total").agg(F.array_sort(F.collect_list(own)).alias("nodes"))
    runs = runs.select("tree", F.col("_run").alias("position"), "total", "nodes")
    schema = T.StructType([*runs.schema.fields, T.StructField("digest", T.BinaryType()), T.StructField("states", T.BinaryType())])
    target = to_arrow_schema(schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            children, sizes = _matrix(batch)
            digests, states = nodes_over(children, sizes)
            alone = np.array(values(batch, "total")) == 1
            digests[alone] = children[alone, 0]
            kept = [b"" if lone else s[:n].tobytes() for lone, s, n in zip(alone, states, sizes)]
            arrays = [*batch.columns, pa.array([d.tobytes() for d in digests], pa.binary()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, target)], schema=target)

    return short_batches(runs).mapInArrow(hashed, schema)


@dataclass(frozen=True)
class Forest:
    """Trees by level. A row is a node over at most ``BRANCH`` nodes of the level below; the leaves are in the first."""

    levels: list[DataFrame]

    def tops(self) -> DataFrame:
        """``tree`` and the ``digest`` of its uppermost node."""
        found = [level.filter(F.col("total") <= BRANCH).select("tree", "digest") for level in self.levels]
        top = found[0]
        for other in found[1:]:
            top = top.unionByName(other)
        return top

    def with_paths(self, above: DataFrame, scratch: Scratch) -> DataFrame:
        """The first level's rows with ``path``, what is above them, nearest first, and ``above``'s other columns.

        ``above`` has ``tree`` and the ``path`` of the tree's uppermost node. An element is the ``place`` in the parent,
        the parent's ``children`` and its midstate before that place.
        """
        extra = [c for c in above.columns if c not in ("tree", "path")]
        higher = None
        for level in reversed(self.levels):
            found = level.filter(F.col("total") <= BRANCH).join(above, "tree")
            if higher is not None:
                parents = higher.select("tree", F.col("position").alias("_up"), F.struct("nodes", "states", "path", *extra).alias("_parent"))
                below = level.filter(F.col("total") > BRANCH).withColumn("_up", F.expr(f"position div {BRANCH}"))
                below = below.join(parents, ["tree", "_up"])
                place = F.expr(f"cast(position % {BRANCH} as int)")
                step = path_step(place, F.col("_parent.nodes"), F.col("_parent.states"))
                found = found.unionByName(below.select(
                    *level.columns, F.concat(F.array(step), "_parent.path").alias("path"), *[F.col(f"_parent.{c}").alias(c) for c in extra]
                ))
            higher = scratch.written(found) if level is not self.levels[0] else found
        return higher


_PATH = "array<struct<place:int,children:array<binary>,state:binary>>"


def path_step(place: Column, nodes: Column, states: Column) -> Column:
    return F.struct(
        place.alias("place"), F.transform(nodes, lambda n: n["digest"]).alias("children"),
        F.substring(states, place * SIZE + 1, F.lit(SIZE)).alias("state"),
    )


def forest(leaves: DataFrame, order: list[str], keep: Sequence[str], scratch: Scratch) -> Forest:
    """Trees over ``leaves`` (``tree``, ``digest`` as 32 bytes, ``order``, ``keep``), each by ``order``. The driver learns
    the largest tree's number of leaves, nothing else; a level is a table in the shared folder."""
    numbered = _numbered(leaves, order, scratch)
    levels = [scratch.written(_parents(numbered, keep))]
    most = levels[0].agg(F.max("total")).first()[0] or 0
    while most > BRANCH:
        most = -(-most // BRANCH)
        nodes = levels[-1].filter(F.col("total") > BRANCH).select(
            "tree", "position", F.ceil(F.col("total") / BRANCH).alias("total"), "digest")
        levels.append(scratch.written(_parents(nodes, [])))
    return Forest(levels)


@dataclass(frozen=True)
class Manifest:
    """``trees`` over a dataset's rows by group, ``top`` over the groups' subroots. Its tables are in the shared folder
    until ``clear`` is called."""

    trees: Forest
    top: Forest
    scratch: Scratch
    key_field: T.StructField

    def subroots(self) -> DataFrame:
        """``tree`` (the group's name behind ``=``, or nothing for NULL) and its ``subroot`` in hexadecimal."""
        return self.trees.tops().select("tree", F.lower(F.hex("digest")).alias("subroot"))

    def root(self) -> DataFrame:
        """The dataset's ``root``: one row, none for an empty table."""
        return self.top.tops().select(F.lower(F.hex("digest")).alias("root"))

    def clear(self) -> None:
        self.scratch.clear()

    def folded(self) -> DataFrame:
        """A row per leaf: the key, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (the digest of all siblings on its
        way up), ``folded_root``, what the root becomes with the leaf's replacement, and ``verified``, whether it stays.

        A leaf without a replacement folds back to the root itself. Siblings on the left are never hashed again.
        """
        tops = self.top.tops().select("tree", F.col("digest").alias("root"), F.array().cast(_PATH).alias("path"))
        groups = self.top.with_paths(tops, self.scratch)
        each = groups.select("total", "nodes", "states", "path", "root", F.posexplode("nodes").alias("place", "node"))
        own = F.when(F.col("total") > 1, F.array(path_step(F.col("place"), F.col("nodes"), F.col("states")))).otherwise(F.array().cast(_PATH))
        above = self.scratch.written(each.select(
            F.col("node.group").alias("tree"), F.concat(own, "path").alias("path"), "root", F.col("node.digest").alias("subroot")))
        runs = self.trees.with_paths(above, self.scratch)
        schema = T.StructType([
            self.key_field, *(T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")),
            T.StructField("verified", T.BooleanType()),
        ])
        target = to_arrow_schema(schema)

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE):
                    yield to_batch(_folded_rows(batch.slice(start, SLICE)), target)

        return short_batches(runs).mapInArrow(fold, schema)


def _text(digest: np.ndarray) -> str:
    return digest.tobytes().hex()


def _others(children: bytes, place: int) -> bytes:
    return children[:2 * SIZE * place] + children[2 * SIZE * (place + 1):]


def _folded_rows(batch: pa.RecordBatch) -> list[tuple]:
    children, sizes = _matrix(batch)
    hashed = np.array(values(batch, "total")) > 1
    nodes = batch.column(batch.schema.get_field_index("nodes")).flatten()
    rows = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    leaves = children[rows, places]
    current = leaves.copy()
    changes = nodes.field("change").to_pylist()
    changed = [i for i, change in enumerate(changes) if change is not None]
    if changed:
        current[changed] = np.frombuffer(b"".join(changes[i] for i in changed), np.uint8).reshape(-1, SIZE)

    def fold(there: np.ndarray, place: np.ndarray, size: np.ndarray, midstates: np.ndarray, siblings: np.ndarray) -> None:
        current[there] = refolded(current[there], place, size, midstates, siblings, rows[there])

    states = np.zeros((len(sizes), BRANCH, SIZE), np.uint8)
    for row, kept in enumerate(values(batch, "states")):
        found = np.frombuffer(kept, np.uint8).reshape(-1, SIZE)
        states[row, :len(found)] = found
    there = np.flatnonzero(hashed[rows])
    if len(there):
        fold(there, places[there], sizes[rows[there]], states[rows[there], places[there]], children)
    paths = values(batch, "path")
    for depth in range(max(map(len, paths), default=0)):
        deep = np.array([len(p) > depth for p in paths])
        place, size = np.zeros(len(paths), np.int64), np.zeros(len(paths), np.int64)
        siblings, midstates = np.zeros((len(paths), BRANCH, SIZE), np.uint8), np.zeros((len(paths), SIZE), np.uint8)
        for row in np.flatnonzero(deep).tolist():
            step = paths[row][depth]
            place[row], size[row] = step["place"], len(step["children"])
            siblings[row, :size[row]] = np.frombuffer(b"".join(step["children"]), np.uint8).reshape(-1, SIZE)
            midstates[row] = np.frombuffer(step["state"], np.uint8)
        there = np.flatnonzero(deep[rows])
        fold(there, place[rows[there]], size[rows[there]], midstates[rows[there]], siblings)
    higher = [b"".join(_others(b"".join(step["children"]).hex().encode(), step["place"]) for step in path) for path in paths]
    own = [children[row, :n].tobytes().hex().encode() for row, n in enumerate(sizes)]
    proofs = [
        hashlib.sha256((_others(own[row], place) if hashed[row] else b"") + higher[row]).hexdigest()
        for row, place in zip(rows.tolist(), places.tolist())
    ]
    roots, subroots = values(batch, "root"), values(batch, "subroot")
    return [
        (key, _text(leaf), subroots[row].hex(), roots[row].hex(), proof, _text(new), new.tobytes() == roots[row])
        for key, leaf, row, proof, new in zip(nodes.field("key").to_pylist(), leaves, rows.tolist(), proofs, current)
    ]


def manifest(
    docs: DataFrame, columns: Sequence[str], group: str = "source", key: str = "doc_id",
    changes: dict[str, Column] | None = None, changed: Column | None = None,
) -> Manifest:
    """Hash trees over all rows of ``docs``: a tree per ``group``, its leaves by ``key``, and one over the groups' subroots
    by the group's name (NULL first).

    ``columns`` make a leaf. Where ``changed`` holds, ``changes`` (column to expression) make the leaf's replacement for
    ``folded``. NULL keys come first and have no replacement (``changed`` is NULL for them unless it says otherwise); rows equal in group
    and key follow in the order of their digests, so that any partitioning gives the same trees. Repeated rows are
    leaves of their own. NULL and empty fields differ. An empty table has no rows in any level. Other columns are not
    read, and none of them can clash: what is read gets new names first.
    """
    scratch = Scratch()
    replacement = F.lit(None).cast("string")
    if changes is not None:
        replacement = F.when(F.lit(True) if changed is None else changed, leaf_digest([changes.get(c, F.col(c)) for c in columns]))
    leaves = scratch.written(docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"), F.col(key).alias("key"),
        F.unhex(leaf_digest([F.col(c) for c in columns])).alias("digest"), F.unhex(replacement).alias("change"),
        F.monotonically_increasing_id().alias("row"),  # repeated rows in one key needn't meet in one task
    ))
    trees = forest(leaves, ["key", "digest", "row"], ["key", "change"], scratch)
    groups = trees.tops().select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    return Manifest(trees, forest(groups, ["group"], ["group"], scratch), scratch, T.StructField(key, docs.schema[key].dataType))
