"""Exact Jaccard join of word-shingle sets by partitioning the universe of shingles.

Two sets of sizes x and y with similarity t or more differ in H = floor((x + y) * (1 - t) / (1 + t)) elements at most.
Hash the universe into m segments, count a segment that may differ in one element twice: if m + q = H + 1, where q
segments are compared up to one deletion and the others exactly, some segment must agree (pigeonhole). Signatures of
agreeing segments are the join keys; what they find is verified on the sets.

Unrelated sets agree where both have nothing. So a surplus of e segments is added, m + q = H + 1 + e: then e + 1 segments
agree, and a set with at most e segments that say next to nothing agrees with every similar set in one that says more. Such
sets leave the empty signatures out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpaudit.llm.common import (
    Scratch, WordHashes, arrow_map, as_bytes, blank_words, gram_hashes, grown_filter, hash_filter, in_filter, mixed_bits,
    passing, short_batches, to_batch, unused_dropped, values, without, written,
)
from corpaudit.operators.components import connected_components

#: Sizes of one band differ by about this factor; by more where similar sets can, so that they are neighbours at most.
BAND = 1.2
#: Nodes of a signature that one task compares with each other, and bits of their bitmaps, at most; larger groups are split
#: into pairs of blocks.
BLOCK, BLOCK_BITS = 512, 1 << 27
#: Up to so many elements (as powers of two), a bitmap has twice and once as many bits as the band's largest set needs to
#: the next power of two; half as many beyond. What sets differ in is told from chance by a share of their size, and the
#: share's error falls as sets grow; short sets need sparser bitmaps, or such as differ in much look alike.
SPARSE, EVEN = 9, 11
#: Signatures of a node that the first round looks at. It only has to find most of the links; later rounds find the rest.
SAMPLED = 4
#: Bits of the filters that tasks get: of documents to read again, and of shared signatures (4 MB, and up to 16 MB for the
#: signatures of all documents, by their number). Full filters let more rows through to the joins, which decide.
FILTER_BITS = 1 << 23
SIGNATURE_BITS, MOST_BITS = 1 << 25, 1 << 27
#: Signatures that a task packs together, and that a bucket of the count holds, about.
PACKED, COUNTED = 1 << 20, 1 << 22
_HASHES = WordHashes()


@dataclass(frozen=True)
class Scheme:
    """How sets are cut when the larger one of a pair lies in a band of sizes (``low`` to ``high``, both included)."""

    number: int
    low: int
    high: int
    segments: int
    deletions: int
    surplus: int = 0

    @property
    def bits(self) -> int:
        """Length of the parity bitmap: a power of two, so that longer ones can be folded."""
        power = (self.high - 1).bit_length()
        return max(64, 1 << power + (1 if power <= SPARSE else 0 if power <= EVEN else -1))


def most_different(x: int, y: int, percent: int) -> int:
    """How many elements sets of these sizes can differ in and still be similar."""
    return (x + y) * (100 - percent) // (100 + percent)


def bands(percent: int, largest: int) -> list[tuple[int, int]]:
    """Bands from 1 on, and one more than ``largest`` needs."""
    ratio, found, low = max(BAND, 100 / percent), [], 1
    while True:
        high = max(low, int(low * ratio))
        found.append((low, high))
        if low > largest:
            return found
        low = high + 1


#: What a pair that meets by chance costs (two bitmaps shipped), in signatures (two bytes counted); and how many shingles
#: two unrelated sets share, about.
PAIR_COST, SHARED = 30, 0.05


def allocated(number: int, low: int, high: int, rows: int, percent: int) -> Scheme:
    """The cheapest segments for a band: one-deletion neighbourhoods let segments be larger, so that fewer pairs agree
    by chance, but each gives a signature per element; a surplus lets sets do without their empty segments.

    The cost is signatures of all rows plus expected chance pairs. With a mean of ``k`` elements, two sets have nothing in
    an exact segment with chance exp(-2k), next to nothing in one up to a deletion with exp(-2k) * (1 + 2k). That counts
    where both have more such segments than the surplus, and for the few shingles that unrelated sets share.
    """
    needed, best = most_different(high, high, percent) + 1, None
    for surplus in range(13 if needed > 1 else 1):
        whole = needed + surplus
        segments = np.unique(np.linspace((whole + 1) // 2, whole, 40).astype(np.int64)).astype(np.float64)
        deletions = whole - segments
        mean = low / segments
        signatures = segments - deletions + deletions * (high / segments + 1)
        alike = np.exp(-2 * mean) * (segments - deletions + deletions * (1 + 2 * mean))
        thin = np.exp(-mean) * (segments - deletions + deletions * (1 + mean))
        term = np.exp(-thin)
        more = 1 - term
        for i in range(1, surplus + 1):
            term = term * thin / i
            more = more - term
        chance = alike * (np.maximum(more, 0) ** 2 + SHARED / segments)
        cost = rows * signatures + rows * float(rows) / 2 * chance * PAIR_COST
        at = int(np.argmin(cost))
        if best is None or cost[at] < best[0]:
            best = cost[at], Scheme(number, low, high, int(segments[at]), int(deletions[at]), surplus)
    return best[1]


def shingle_set(data: bytes | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``width`` words; of the whole text if it has fewer words."""
    words = blank_words(data)
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(_HASHES.numbers(words), min(width, len(words))))


def signatures(elements: np.ndarray, scheme: Scheme) -> np.ndarray:
    """A signature for every segment, and for one-deletion segments one for every element left out; without those of
    nothing, if the set has no more thin segments (empty, or with one element that may be left out) than the surplus.

    A subset's hash is the sum of its elements' hashes, so leaving one out is a subtraction. The low byte holds the
    scheme's number."""
    spread = mixed_bits(elements + np.uint64(2 * scheme.number + 1))
    segment = (spread % np.uint64(scheme.segments)).astype(np.int64)
    sums = mixed_bits(np.arange(1, scheme.segments + 1, dtype=np.uint64))
    np.add.at(sums, segment, mixed_bits(spread))
    sizes = np.bincount(segment, minlength=scheme.segments)
    thin = np.count_nonzero(sizes[:scheme.deletions] <= 1) + np.count_nonzero(sizes[scheme.deletions:] == 0)
    told = sizes > 0 if thin <= scheme.surplus else np.ones(len(sizes), bool)
    found = [sums[told]]
    if scheme.deletions:
        near = segment < scheme.deletions
        if thin <= scheme.surplus:
            near &= sizes[segment] > 1
        found.append(sums[segment[near]] - mixed_bits(spread[near]))
    return np.unique(mixed_bits(np.concatenate(found)) & ~np.uint64(255) | np.uint64(scheme.number)).view(np.int64)


def parity(elements: np.ndarray, bits: int) -> bytes:
    """One bit per hash bucket: whether it holds an odd number of elements. Two sets differ in as many elements at
    least as their bitmaps differ in bits."""
    odd = np.bincount((elements >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(bitmap: bytes, bits: int) -> np.ndarray:
    words = np.frombuffer(bitmap, np.uint64)
    while len(words) * 64 > bits:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def _schemes(docs: DataFrame, text: str, percent: int) -> tuple[list[Scheme], int]:
    """Schemes allocated by how many texts have about a band's size, by their word counts, and all words' number; a
    handful of rows come to the driver. The counts decide costs alone, never which pairs are found."""
    words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    step = F.floor(F.log(F.greatest(words, F.lit(1)).cast("double")) / math.log(BAND)).cast("int")
    found = docs.select(step.alias("step"), words.alias("n")).groupBy("step").agg(
        F.count(F.lit(1)).alias("rows"), F.max("n").alias("most"), F.sum("n").alias("words")
    ).collect()
    largest = max((r["most"] for r in found), default=1)
    rows = {r["step"]: r["rows"] for r in found}
    schemes = []
    for number, (low, high) in enumerate(bands(percent, largest)):
        step = int(math.log(low) / math.log(BAND))
        near = sum(rows.get(s, 0) for s in (step - 1, step, step + 1))
        schemes.append(allocated(number, low, high, near, percent))
    if len(schemes) > 256:
        raise ValueError("more bands than a signature can number")
    return schemes, sum(r["words"] for r in found)


def node_of(elements: np.ndarray) -> int:
    """A set's node: a hash of all its elements."""
    node = xxhash.xxh3_64_intdigest(elements.tobytes())
    return node - (1 << 64) if node >> 63 else node


def used_schemes(n: int, schemes: list[Scheme], percent: int) -> list[Scheme]:
    """The scheme of a size's own band, and the next one's if a set there can be similar."""
    own = schemes[np.searchsorted([s.low for s in schemes], n, side="right") - 1]
    return [own, schemes[own.number + 1]] if n * 100 >= percent * (own.high + 1) else [own]


def set_signatures(elements: np.ndarray, used: list[Scheme]) -> np.ndarray:
    """All signatures of a set; none where no difference is allowed, as similar sets are equal there, so one node."""
    found = [signatures(elements, s) for s in used if s.segments + s.deletions - s.surplus > 1]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


#: Bits of a signature's hash that a pack tells; the bits above them are its bucket.
CELL_BITS = 28
_STEP = 65_535


def cells_of(found: np.ndarray, bits: int) -> np.ndarray:
    """The top ``bits`` of the signatures' hashes, by which they are counted and filtered."""
    return mixed_bits(found.view(np.uint64)) >> np.uint64(64 - bits)


def packs(cells: np.ndarray) -> list[tuple[int, bytes]]:
    """Buckets and their sorted cells as gaps of 2 bytes each (a full step, which is no cell, where a gap is longer);
    what comes several times stands twice, which tells all."""
    kept, counts = np.unique(cells, return_counts=True)
    kept = np.repeat(kept, np.minimum(counts, 2))
    buckets = (kept >> np.uint64(CELL_BITS)).astype(np.int64)
    own = (kept & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)
    starts = np.flatnonzero(np.diff(buckets, prepend=-1))
    gaps = np.diff(own, prepend=0)
    gaps[starts] = own[starts]
    steps = gaps // _STEP
    ends = np.cumsum(steps + 1)
    coded = np.full(int(ends[-1]) if len(ends) else 0, _STEP, np.uint16)
    coded[ends - 1] = gaps % _STEP
    firsts = (ends - steps - 1)[starts]
    return [(int(buckets[i]), coded[a:b].tobytes()) for i, a, b in zip(starts, firsts, np.append(firsts[1:], len(coded)))]


def shared_cells(bucket: int, found: list[bytes]) -> np.ndarray:
    """The cells that come twice or more in a bucket's packs."""
    cells = []
    for pack in found:
        coded = np.frombuffer(pack, np.uint16)
        cells.append(np.cumsum(coded, dtype=np.int64)[coded != _STEP])
    kept, counts = np.unique(np.concatenate(cells), return_counts=True)
    return kept[counts > 1].astype(np.uint64) | np.uint64(bucket) << np.uint64(CELL_BITS)


def _shared_filter(
    docs: DataFrame, text: str, width: int, percent: int, schemes: list[Scheme], words: int
) -> tuple[np.ndarray, int]:
    """A filter that every signature of two nodes or more passes, and the bits of a cell it is asked for.

    Signatures are many and most stand alone, so they are counted in packs: tasks drop copies of sets and of signatures
    that they saw, sort the rest into buckets by their top bits and ship about 2 bytes of each. There are as many buckets
    as keep one at about ``COUNTED`` signatures. Signatures with equal cells only let more rows through.
    """
    bits = CELL_BITS + min(24, max(5, math.ceil(math.log2(max(words, 1) / COUNTED))))
    out = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("pack", T.BinaryType())])
    target = to_arrow_schema(out)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, seen = [], 0, set()
        for batch in batches:
            for data in batch.column(0).cast(pa.binary()):
                elements = shingle_set(data.as_py(), width)
                if not len(elements) or (node := node_of(elements)) in seen:
                    continue
                seen.add(node)
                found.append(cells_of(set_signatures(elements, used_schemes(len(elements), schemes, percent)), bits))
                held += len(found[-1])
                if held >= PACKED or len(seen) >= PACKED:
                    yield to_batch(packs(np.concatenate(found)), target)
                    found, held, seen = [], 0, set()
        if held:
            yield to_batch(packs(np.concatenate(found)), target)

    def unpack(table: pa.Table) -> pa.Table:
        cells = shared_cells(table.column("bucket")[0].as_py(), table.column("pack").to_pylist())
        return pa.table({"hash": pa.array(mixed_bits(cells).view(np.int64), pa.int64())})

    made = short_batches(docs.select(text)).mapInArrow(pack, out)
    scratch = Scratch()
    hashes = scratch.written(made.groupBy("bucket").applyInArrow(unpack, "hash long"))
    filled = grown_filter(hashes, SIGNATURE_BITS, MOST_BITS)
    scratch.clear()
    return filled, bits


_COUNTED = T.StructType([
    T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()), T.StructField("bitmap", T.BinaryType()),
    T.StructField("signatures", T.ArrayType(T.LongType())),
])
_PAIR = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
_CANDIDATE = T.StructType([*_PAIR.fields, T.StructField("sig", T.LongType())])


def _counted(
    docs: DataFrame, key: str, text: str, width: int, percent: int, schemes: list[Scheme], keep: Sequence[str],
    words: np.ndarray, bits: int,
) -> DataFrame:
    """Documents with their set's size, node, bitmap and such signatures as pass the filter ``words``."""
    def describe(data: bytes | None) -> tuple:
        elements = shingle_set(data, width)
        n = len(elements)
        if not n:
            return 0, None, None, []
        used = used_schemes(n, schemes, percent)
        found = set_signatures(elements, used)
        found = found[in_filter(words, mixed_bits(cells_of(found, bits)))]
        return n, node_of(elements), parity(elements, used[-1].bits) if len(found) else None, found

    def run(batch: pa.RecordBatch) -> list[tuple]:
        return [(*own, *describe(data)) for *own, data in zip(*(values(batch, c) for c in (key, *keep)), as_bytes(batch, text))]

    return arrow_map(docs.select(key, *keep, text), run, T.StructType([*(docs.schema[c] for c in (key, *keep)), *_COUNTED.fields]))


def _grouped(rows: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Runs of rows with equal first three columns."""
    group, current = [], None
    for batch in rows:
        for row in zip(*(values(batch, n) for n in names)):
            if row[:3] != current and group:
                yield group
                group = []
            current = row[:3]
            group.append(row)
    if group:
        yield group


def _sampled(nodes: DataFrame) -> DataFrame:
    """``sig``, ``node`` of a few of each node's signatures, by hash, so that similar nodes mostly pick the same ones."""
    ordered = F.array_sort(F.transform("signatures", lambda sig: F.struct(F.xxhash64(sig).alias("place"), sig.alias("sig"))))
    return nodes.select(F.explode(F.slice(ordered, 1, SAMPLED)).alias("own"), "node").select("own.sig", "node")


def _between(members: DataFrame, scratch: Scratch) -> DataFrame:
    """``sig``, ``node`` of the signatures whose nodes aren't all in one cluster. ``members`` has ``cluster`` too. A filter of
    fixed size keeps most others from the join, which decides."""
    seen = members.groupBy("sig").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"))
    across = scratch.written(seen.filter("low != high").select("sig"))
    words = hash_filter(across.select(F.xxhash64("sig").alias("hash")), SIGNATURE_BITS)
    kept = passing(members.select("sig", "node", F.xxhash64("sig").alias("hash")), "hash", words)
    return kept.select("sig", "node").join(across, "sig")


def _near_pairs(members: DataFrame, nodes: DataFrame, schemes: list[Scheme], percent: int, forest: bool) -> DataFrame:
    """Pairs ``u`` < ``v`` of nodes that share a signature, can be similar by their sizes and bitmaps, and are in
    different clusters. With ``forest``, as few of them as connect each group, and in rows without a pair the ``sig`` of
    the groups that have more of them.

    ``members`` has ``sig``, ``node``; ``nodes`` has ``node``, ``n_shingles``, ``bitmap``, ``cluster``. Groups above ``BLOCK`` nodes, or
    fewer where bitmaps are long, are dealt out as pairs of blocks, so that a task holds two blocks at a time.
    """
    per_block = F.array(*[F.lit(max(8, min(BLOCK, BLOCK_BITS // s.bits))) for s in schemes])
    blocks = (
        members.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("sig", F.ceil(F.col("n") / F.get(per_block, F.expr("cast(sig & 255 as int)"))).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        members.join(blocks, "sig").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("sig", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node")
        .join(nodes, "node").select("sig", "a", "b", "own", "node", "n_shingles", "bitmap", "cluster")
        .repartition("sig", "a", "b").sortWithinPartitions("sig", "a", "b", "node")
    )
    names = ("sig", "a", "b", "own", "node", "n_shingles", "bitmap", "cluster")
    target = to_arrow_schema(_CANDIDATE)

    def compare(group: list[tuple]) -> list[tuple]:
        sig, a, b = group[0][:3]
        bits = schemes[sig & 255].bits
        maps = np.stack([_folded(r[6], bits) for r in group])
        sizes = np.array([r[5] for r in group], np.int64)
        clusters = np.array([r[7] for r in group], np.int64)
        block = np.array([r[3] for r in group])
        roots, more = clusters.copy(), False
        found = []
        for i in range(1, len(group)):
            odd = np.bitwise_count(maps[:i] ^ maps[i]).sum(axis=1, dtype=np.int64)
            near = (odd <= (sizes[:i] + sizes[i]) * (100 - percent) // (100 + percent)) & (clusters[:i] != clusters[i])
            near &= (np.minimum(sizes[:i], sizes[i]) * 100 >= percent * np.maximum(sizes[:i], sizes[i]))
            if a != b:
                near &= block[:i] != block[i]  # pairs inside a block are compared where both are that block
            for j in np.flatnonzero(near).tolist():
                if forest:
                    if roots[j] == roots[i]:
                        more = True
                        continue
                    roots[roots == roots[i]] = roots[j]
                found.append((*sorted((group[i][4], group[j][4])), None))
        return [*found, (None, None, sig)] if more else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: set[tuple] = set()
        for group in _grouped(batches, names):
            if len(group) > 1:
                pairs.update(compare(group))
            if len(pairs) >= 50_000:
                yield to_batch(list(pairs), target)
                pairs = set()
        if pairs:
            yield to_batch(list(pairs), target)

    return short_batches(dealt).mapInArrow(run, _CANDIDATE).distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """The pairs whose sets are similar: ``u``, ``v``, as long rows of sets joined and intersected.

    Sets are made again for the nodes' first documents. A filter of fixed size keeps most other documents out; the
    joins decide.
    """
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    firsts = nodes.join(ends, "node", "left_semi").select(F.xxhash64("first").alias("hash"))
    words = hash_filter(firsts, FILTER_BITS)

    def wanted(batch: pa.RecordBatch) -> list[tuple]:
        hashes = np.array(values(batch, "_hash"), np.int64).view(np.uint64)
        rows = []
        for passed, data in zip(in_filter(words, hashes), as_bytes(batch, text)):
            if passed:
                elements = shingle_set(data, width)
                if len(elements):
                    rows.append((node_of(elements), elements.tobytes()))
        return rows

    made = arrow_map(
        docs.select(text, F.xxhash64(F.col(key)).alias("_hash")), wanted,
        T.StructType([T.StructField("node", T.LongType()), T.StructField("elements", T.BinaryType())]),
    )
    sets = written(made.join(ends, "node", "left_semi").groupBy("node").agg(F.first("elements").alias("elements")))
    left = sets.select(F.col("node").alias("u"), F.col("elements").alias("one"))
    right = sets.select(F.col("node").alias("v"), F.col("elements").alias("two"))

    def similar(batch: pa.RecordBatch) -> list[tuple]:
        rows = []
        for u, v, one, two in zip(*(values(batch, c) for c in ("u", "v", "one", "two"))):
            x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                rows.append((u, v))
        return rows

    return written(arrow_map(pairs.join(left, "u").join(right, "v"), similar, _PAIR))


def similar_sets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90, keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Documents with their set's node, and the links that connect the nodes.

    First: ``key``, ``keep``, ``n_shingles``, ``node`` (NULL without words), one row per document. Second: ``u``, ``v``,
    verified links between different sets. Equal sets are one node, told apart by a 64-bit hash of all their elements,
    which are 64-bit hashes of the shingles' words.

    Links are looked for in three rounds. The first verifies a forest of the groups that a few signatures of each node
    make; the second a forest of every signature's group that isn't in one cluster by then; the third every pair of the
    groups where the forest left some out that is still between different clusters. So large groups of near copies cost a few links per copy, and no link that would
    connect two clusters is missed; pairs inside one cluster are not all listed.

    NULL and empty texts have an empty set and no node. Repeated rows and NULL keys stay rows of their own. An empty
    table gives no rows; other columns are not read.
    """
    schemes, words = _schemes(docs, text, percent)
    scratch, early = Scratch(), Scratch()
    # Signatures are made twice, as most of them stand alone and needn't be kept.
    shared, bits = _shared_filter(docs, text, width, percent, schemes, words)
    wide = early.written(_counted(docs, key, text, width, percent, schemes, keep, shared, bits))
    counted = written(wide.select(key, *keep, "n_shingles", "node"))
    nodes = scratch.written(wide.filter("node IS NOT NULL").groupBy("node").agg(
        F.min(key).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("bitmap").alias("bitmap"),
        F.first("signatures").alias("signatures"),
    ))
    early.clear()
    plain = nodes.filter("bitmap IS NOT NULL").select("node", "n_shingles", "bitmap")
    members, placed = _sampled(nodes), plain.withColumn("cluster", F.col("node"))
    links = tested = None
    for forest in (True, True, False):
        near = scratch.written(_near_pairs(members, placed, schemes, percent, forest))
        pairs = near.filter("u IS NOT NULL").select("u", "v")
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        found = _verified(pairs, nodes, docs, key, text, width, percent)
        links = found if links is None else links.unionByName(found)
        if not forest:
            break
        clusters = connected_components(links)
        placed = scratch.written(plain.join(clusters, "node", "left").withColumn("cluster", F.coalesce("cluster", "node")))
        own = placed.select("node", "cluster")
        if tested is None:
            every = nodes.select("node", "signatures").join(own, "node").select(F.explode("signatures").alias("sig"), "node", "cluster")
        else:  # the second round saw every group, the third looks at those that had more to tell
            every = members.join(near.filter("sig IS NOT NULL").select("sig").distinct(), "sig").join(own, "node")
        tested = pairs if tested is None else tested.unionByName(pairs)
        members = scratch.written(_between(every, scratch))
        unused_dropped(docs.sparkSession)
    scratch.clear()
    return counted, links


def clustered(counted: DataFrame, links: DataFrame) -> DataFrame:
    """The documents of ``similar_sets`` with ``cluster``, the node that stands for all that links lead to."""
    return counted.join(connected_components(links), "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` with one row of each group that links make: the one with the smallest key (NULL last), then the smallest
    hash of its text. Of rows equal in key and text one stays. Documents without words are linked with nothing and stay,
    one for each key and text. Edge cases as in ``similar_sets``."""
    marked = docs.select(
        F.struct(*docs.columns).alias("whole"), F.col(key).alias("own"), F.col(text).alias("said"),
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("mark"),
    )
    placed = clustered(*similar_sets(marked, "own", "said", width, percent, keep=["id", "mark"]))
    place = F.struct(F.col("own").isNull().alias("late"), F.col("own"), F.col("mark"), F.col("id"))
    best = placed.filter("cluster IS NOT NULL").groupBy("cluster").agg(F.min(place).alias("best"))
    stay = best.select("best.id", "best.mark")
    gone = placed.filter("cluster IS NOT NULL").select("id", "mark").distinct().join(stay, ["id", "mark"], "left_anti")
    repeated = placed.groupBy("id", "mark").count().filter("count > 1").select("id", "mark")
    gone, repeated = written(gone), written(repeated.join(gone, ["id", "mark"], "left_anti"))
    rest = without(marked, gone.unionByName(repeated), ["id", "mark"])
    words = hash_filter(repeated.select(F.xxhash64("id", "mark").alias("hash")), FILTER_BITS)
    again = passing(marked.withColumn("hash", F.xxhash64("id", "mark")), "hash", words)
    once = again.join(repeated, ["id", "mark"], "left_semi").groupBy("id", "mark").agg(F.first("whole").alias("whole"))
    return rest.select("whole.*").unionByName(once.select("whole.*"))


def similarity_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90
) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id``: the smallest key that similar sets lead to, the row's own included.

    A document without words is its own component. NULL keys never are the smallest while another key is there. Other
    edge cases as in ``similar_sets``.
    """
    placed = clustered(*similar_sets(docs, key, text, width, percent))
    smallest = placed.filter("cluster IS NOT NULL").groupBy("cluster").agg(F.min(key).alias("component_id"))
    found = placed.join(smallest, "cluster", "left")
    own = F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return found.select(key, "n_shingles", own.alias("component_id"))
