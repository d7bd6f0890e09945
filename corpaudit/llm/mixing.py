"""Mixing sources to target weights that change during training.

A source's schedule gives its weight at every moment of training, 0 to 1. The schedule's integral is the share of its
tokens that is due by then; inverting it turns the place of each copy of a document in its source's token stream into its
moment. What all sources' integrals have due by a moment is the position in training, in tokens: from position to position
the sources' rates add up to 1. Sorting the copies by range of moments gives the training order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpaudit.functions.hashing import seeded_hash
from corpaudit.llm.common import written

#: Words of a text.
WORD = r"[^\x20\x09-\x0D]+"
#: (moment, weight) knots, linear between them; a source takes the schedule of its rank, repeating.
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
WEIGHTS = (1.0, 2.0, 3.0)
MOST_REPEATS = 3
#: Documents that share one running sum at most, about; more documents of a source mean more blocks.
BLOCK = 2_000
#: Words of the mix that share one running sum of the training order, about; a longer mix means more ranges.
RANGE_WORDS = 2_000_000


def word_count(text: Column) -> Column:
    """Runs of other than ASCII white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most_repeats: float = MOST_REPEATS
) -> DataFrame:
    """``source``, ``source_size``, ``source_rank``, ``target`` from ``source``, ``source_size``: one row per source.

    Sources in code point order, NULL last, take the weights in turn and share the sum of all sizes. Targets stop at
    ``most_repeats`` times the source's size; what is above goes to the others by weight until none is above. That is
    the level L with target = min(weight * L, cap) and the right sum: with sources in order of cap / weight, the first
    k are at their caps, and L = (total - caps so far) / (weights left) for the first k whose L is below the next
    source's cap / weight. The windows see one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    capped_first = Window.orderBy("_ratio", "source_rank")
    before = capped_first.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        sizes.withColumn("source_rank", rank.cast("long")).withColumn("_weight", weight)
        .withColumn("_cap", most_repeats * F.col("source_size").cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_left", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.col("_left"))
    )
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "source_rank", "_level"))).over(everything)
    target = F.least(F.col("_weight") * F.coalesce(level["_level"], F.lit(0.0)), F.col("_cap"))
    return rows.select("source", "source_size", "source_rank", target.alias("target"))


def _pieces(knots: Sequence[tuple[float, float]]) -> tuple[list[tuple[float, float, float, float, float]], float]:
    """A schedule's linear pieces, each with the integral before it, and the whole integral."""
    pieces, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        pieces.append((t0, t1, w0, w1, area))
        area += (t1 - t0) * (w0 + w1) / 2
    return pieces, area


def _share(moment: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The share of the schedule's integral that is due by the moment."""
    pieces, area = _pieces(knots)
    due = F.lit(area)
    for t0, t1, w0, w1, before in reversed(pieces):
        passed = moment - t0
        due = F.when(moment <= t1, before + passed * w0 + passed * passed * ((w1 - w0) / (t1 - t0) / 2)).otherwise(due)
    return due / area


def _moment(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The moment by which the share of the schedule's integral is due: per piece, a quadratic equation's root."""
    pieces, area = _pieces(knots)
    if area <= 0 or min(w for _, w in knots) < 0 or [knots[0][0], knots[-1][0]] != [0.0, 1.0]:
        raise ValueError("a schedule runs from 0 to 1, isn't negative and has a positive integral")
    due, moment = share * area, F.lit(1.0)
    for t0, t1, w0, w1, before in reversed(pieces):
        slope, rest = (w1 - w0) / (t1 - t0), F.greatest(due - before, F.lit(0.0))
        root = F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0)))
        bottom = F.lit(w0) + root
        step = F.when(bottom > 0, 2 * rest / bottom).otherwise(F.lit(0.0))
        piece_end = before + (t1 - t0) * (w0 + w1) / 2
        moment = F.when(due <= piece_end, F.least(t0 + step, F.lit(t1))).otherwise(moment)
    return moment


def mixed(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0,
    weights: Sequence[float] = WEIGHTS, most_repeats: float = MOST_REPEATS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
) -> DataFrame:
    """``key``, ``size``, ``source_size``, ``target``, ``taken``, ``first_moment``, ``source_rank``, ``stream_start`` of every
    document.

    A source's stream is its documents in seeded hash order, over and over. The mix takes the stream's first ``target``
    words, rounded: so many whole rounds, then documents up to the last word, of which the last one may be taken in
    part. ``taken`` counts a document's words with repeats. ``first_moment`` is the moment at which its first word is
    due (NULL if none is taken), ``stream_start`` the words of the stream ahead of it. ``training_order`` has its copies.

    The texts are read once: keys, sizes and hashes are written, and all else is made from them.
    Running sums go over blocks of a source's hash order, as many as its rows ask for, then within blocks, so no task
    has a source to itself. Sources are joined by rank of their name, one row each.

    NULL texts have size 0, empty ones too. NULL is a source of its own. Ties in the hash (repeated rows or keys) are
    ordered by key and text, and rows that agree in both can be told apart by nothing, so their sums are the same set
    in any order. An empty table gives no rows. Other columns are not read.
    """
    hashed = seeded_hash(seed, F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = written(docs.select(
        F.col(key).alias("_key"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
        hashed.alias("_hash"), F.xxhash64(text).alias("_text"),
    ))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    targets = source_targets(totals.select("source", "source_size"), weights, most_repeats)
    per_source = totals.select(F.col("source").alias("_s"), (F.col("_rows") / BLOCK + 1).cast("long").alias("_blocks")).join(
        targets, F.col("source").eqNullSafe(F.col("_s"))
    ).drop("source")
    placed = rows.join(per_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn(
        "_block", (F.conv(F.substring("_hash", 1, 12), 16, 10).cast("double") / float(16**12) * F.col("_blocks")).cast("long")
    )
    by_block = placed.groupBy("source_rank", "_block").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("source_rank").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = by_block.select("source_rank", "_block", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_begin"))
    inside = Window.partitionBy("source_rank", "_block").orderBy("_hash", "_key", "_text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_begin") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    due = F.round("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("_due") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.greatest(F.least(F.col("_due") - F.col("_rounds") * F.col("source_size") - F.col("_start"), F.col("size")), F.lit(0))
    share = F.when(F.col("_due") > 0, F.col("_start") / F.col("_due"))
    return (
        placed.join(begins, ["source_rank", "_block"]).withColumn("_start", start).withColumn("_due", due)
        .withColumn("_rounds", rounds).withColumn("taken", F.col("_rounds") * F.col("size") + rest)
        .select(
            F.col("_key").alias(key), "size", "source_size", "target", "taken",
            F.when(F.col("taken") > 0, _by_source(share, schedules)).alias("first_moment"), "source_rank",
            F.col("_start").alias("stream_start"),
        )
    )


def _by_source(share: Column, schedules: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """The moment of a share in the schedule of the row's source."""
    moment = F.lit(None).cast("double")
    for number, knots in enumerate(schedules):
        moment = F.when(F.col("source_rank") % len(schedules) == number, _moment(share, knots)).otherwise(moment)
    return moment


def taken_copies(
    mix: DataFrame, key: str = "doc_id", schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES
) -> DataFrame:
    """Every copy that the mix takes: ``key``, ``source_rank``, ``stream_start``, ``copy`` (from 0), ``words`` it takes,
    ``first_moment`` (its own), ``position`` and ``place``.

    ``position`` is what all sources' schedules have due by the copy's moment, in words; ``place`` the words that stand
    ahead of it in the training order, in which copies follow one another whole. Both run from 0 to the words of the mix.

    Places are running sums over ranges of moments, as many as the mix's words ask for, then within ranges. The sources'
    rates add up to a constant by position, so ranges hold about as many words each.
    """
    # One row per source; summed in their order, so that reruns agree to the last bit.
    sources = mix.groupBy("source_rank").agg(F.first("target").alias("target"))
    ordered = Window.partitionBy().orderBy("source_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = lambda number: F.when(F.col("source_rank") % len(schedules) == number, F.col("target")).otherwise(0.0)
    demands = sources.select(
        F.sum(F.round("target").cast("long")).over(ordered).alias("_words"),
        F.array(*[F.sum(own(number)).over(ordered) for number in range(len(schedules))]).alias("_demand"),
    ).limit(1)
    due, n = F.round("target").cast("long"), F.col("copy")
    begin = F.col("stream_start") + n * F.col("source_size")
    copies = mix.filter("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")) - 1)))
    moments = copies.select(
        key, "source_rank", "stream_start", "copy", F.least(F.col("size"), F.col("taken") - n * F.col("size")).alias("words"),
        _by_source(begin / due, schedules).alias("first_moment"),
    ).crossJoin(F.broadcast(demands))  # one row
    position = sum((F.col("_demand")[i] * _share(F.col("first_moment"), knots) for i, knots in enumerate(schedules)), F.lit(0.0))
    ranges = F.ceil(F.col("_words") / F.lit(RANGE_WORDS))
    placed = written(moments.select(
        key, "source_rank", "stream_start", "copy", "words", "first_moment", position.alias("position"),
        F.least(F.floor(F.col("first_moment") * ranges), ranges - 1).alias("_range"),
    ))
    ahead = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = placed.groupBy("_range").agg(F.sum("words").alias("_sum")).select(
        "_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_begin"))
    inside = Window.partitionBy("_range").orderBy("first_moment", "source_rank", "stream_start", "copy").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(begins), "_range").withColumn(
        "place", F.col("_begin") + F.coalesce(F.sum("words").over(inside), F.lit(0))).drop("_range", "_begin")


def training_order(
    mix: DataFrame, key: str = "doc_id", schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES
) -> DataFrame:
    """The copies taken (``taken_copies``), range-sorted into the training order: one sorted run per partition."""
    return taken_copies(mix, key, schedules).orderBy("place")


def ordered_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``mixed``, and of every document ``copies``, the places ``first_place`` and ``last_place`` of its first and last copy
    in the training order, and the ``last_position`` due; NULL if none is taken.

    A document with words has its place in its source's stream to itself, so copies find it by that.
    """
    mix = written(mixed(docs, key, text, source))
    by = ["source_rank", "stream_start"]
    found = training_order(mix, key).groupBy(*by).agg(
        F.count(F.lit(1)).alias("copies"), F.min("place").alias("first_place"), F.max("place").alias("last_place"),
        F.max("position").alias("last_position"),
    )
    with_some = mix.filter("taken > 0").join(found, by)
    none = mix.filter("taken = 0").select(
        "*", F.lit(0).cast("long").alias("copies"), F.lit(None).cast("long").alias("first_place"),
        F.lit(None).cast("long").alias("last_place"), F.lit(None).cast("double").alias("last_position"))
    columns = [*mix.columns, "copies", "first_place", "last_place", "last_position"]
    return with_some.select(*columns).unionByName(none.select(*columns))
