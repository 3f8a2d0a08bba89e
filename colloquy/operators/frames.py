"""Building blocks that keep ordered work spread out when one key is very large.

A window partitioned by a session or a label puts all rows of that key into
one task. The helpers here give the same results with bounded groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.session import materialize

CHUNK = "_chunk"
CARRIED = "_carried"
HASH_DIGITS = 3


def count_rows() -> Column:
    return F.count(F.lit(1))


def with_carry(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, parts: int | None = None) -> DataFrame:
    """Cut the rows, in order, into ranges and carry up to ``n`` earlier rows of a key into each.

    Rows are partitioned by ranges of ``(keys, order)``, so a key of any size and
    any spread over time falls into as many ranges as its rows need. Only the first
    and the last key of a range can go on in another one; their last ``n`` rows
    there are the edge rows handed on, ``2 n`` a range at most. The result has the
    input columns plus ``_chunk`` and ``_carried``; a window over ``(keys, _chunk)``
    with a frame of at most ``n`` preceding rows gives, on rows with
    ``_carried = false``, what a window over ``keys`` alone would give. Null keys
    are one key. ``parts`` fixes the number of ranges; else the shuffle settings do.
    """
    columns = df.columns
    line = [*keys, *order]
    ranged = df.repartitionByRange(parts, *line) if parts else df.repartitionByRange(*line)
    # Written, because bounds are sampled: every reader must see the same ranges.
    cut = materialize(ranged.withColumn(CHUNK, F.spark_partition_id()), "ranges")
    key = F.struct(*keys)
    ends = cut.groupBy(F.col(CHUNK).alias("_range")).agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    at_edge = cut.join(ends, F.col(CHUNK) == F.col("_range")).where(
        key.eqNullSafe(F.col("_first")) | key.eqNullSafe(F.col("_last"))
    )
    newest_first = [F.col(c).desc() for c in order]
    tails = (
        at_edge.withColumn("_back", F.row_number().over(W.partitionBy(*keys, CHUNK).orderBy(*newest_first)))
        .where(F.col("_back") <= n)
    )
    along = W.partitionBy(*keys).orderBy(*order)
    previous = F.lag(CHUNK).over(along)
    heads = (
        tails
        .withColumn("_before", F.collect_list(F.struct(*columns)).over(along.rowsBetween(-n, -1)))
        .withColumn("_starts", previous.isNotNull() & (previous != F.col(CHUNK)))
        .where("_starts")
        .select(CHUNK, F.inline("_before"))
    )
    return (
        cut.withColumn(CARRIED, F.lit(False))
        .unionByName(heads.withColumn(CARRIED, F.lit(True)))
    )


def chunk_window(keys: Sequence[str], order: Sequence[str]) -> W:
    """The window to use on the result of :func:`with_carry`."""
    return W.partitionBy(*keys, CHUNK).orderBy(*order)


def hash_rank(df: DataFrame, strata: str, hashed: str) -> DataFrame:
    """Add ``rank``, the exact ascending rank of a hex hash, and ``size``, per stratum.

    Equals ``row_number() over (partition by strata order by hashed)``, but a
    stratum is ranked in 4,096 equal slices: rows are ranked inside their hash
    prefix, and the counts of the lower prefixes are added. The counts table
    has at most 4,096 rows per stratum.
    """
    prefix = "_prefix"
    cut = df.withColumn(prefix, F.substring(F.col(hashed), 1, HASH_DIGITS))
    counts = cut.groupBy(strata, prefix).agg(count_rows().alias("_n"))
    below = W.partitionBy(strata).orderBy(prefix).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        F.col(strata).alias("_s"), F.col(prefix).alias("_p"),
        F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_start"),
        F.sum("_n").over(W.partitionBy(strata)).alias("size"),
    )
    within = F.row_number().over(W.partitionBy(strata, prefix).orderBy(hashed))
    return (
        cut.withColumn("_within", within)
        .join(starts, F.col(strata).eqNullSafe(F.col("_s")) & (F.col(prefix) == F.col("_p")))
        .withColumn("rank", (F.col("_start") + F.col("_within")).cast("long"))
        .drop(prefix, "_within", "_s", "_p", "_start")
    )


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows per distinct value: counted on the map side, so hot groups shrink first."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(count_rows().alias("_n"))


def quantile(value: str, q: float) -> Column:
    """Exact linear-interpolated quantile of a :func:`value_counts` frame."""
    return F.percentile(value, F.lit(q), F.col("_n"))


def _same(keys: Sequence[str], prefix: str) -> Column:
    """Equality of key columns, nulls included, with their prefixed namesakes."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys], F.lit(True))


def ranked_quantiles(counted: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float]) -> DataFrame:
    """``keys, quantile, q``: exact linear-interpolated quantiles of a :func:`value_counts` frame.

    For measures with any number of distinct values. Those are sorted in ranges, over all
    groups; the rows of each range are counted, which tells the range that holds a
    wanted rank, and only those ranges are read again to find the value there. No task
    holds more than one range, and no group is gathered.
    """
    sorted_values = materialize(
        counted.select(*keys, value, "_n").repartitionByRange(*keys, value)
        .sortWithinPartitions(*keys, value).withColumn("_range", F.spark_partition_id()), "sorted-values",
    )
    sizes = sorted_values.groupBy(*keys, "_range").agg(F.sum("_n").alias("_rows"))
    line = W.partitionBy(*keys).orderBy("_range")
    starts = sizes.withColumns({
        "_before": F.coalesce(F.sum("_rows").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "_total": F.sum("_rows").over(W.partitionBy(*keys)),
    })
    wanted = F.array(*[F.lit(float(q)) for q in quantiles])
    place = F.col("quantile") * (F.col("_total") - 1)
    targets = (
        starts.select(*keys, "_range", "_before", "_rows", "_total", F.explode(wanted).alias("quantile"))
        .select("*", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("_rank"), place.alias("_place"))
        .where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_rows")))
    )
    targets = materialize(targets, "wanted-ranks").select(
        *[F.col(k).alias(f"_t{k}") for k in keys], F.col("_range").alias("_t_range"), "quantile", "_rank", "_place", "_before",
    )
    ranges = targets.select(*[f"_t{k}" for k in keys], "_t_range").distinct()
    read = sorted_values.join(ranges, _same([*keys, "_range"], "_t"), "left_semi").withColumn(
        "_upto", F.sum("_n").over(W.partitionBy(*keys, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    found = read.join(targets, _same([*keys, "_range"], "_t")).where(
        (F.col("_rank") >= F.col("_before") + F.col("_upto") - F.col("_n")) & (F.col("_rank") < F.col("_before") + F.col("_upto"))
    )
    part = F.col("_place") - F.floor("_place")
    share = F.when(F.col("_rank") == F.floor("_place"), 1.0 - part).otherwise(part)
    return found.groupBy(*keys, "quantile").agg(F.sum(F.col(value) * share).alias("q"))


def describe(df: DataFrame, by: Sequence[str], values: Sequence[str], continuous: bool = False) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max, one row per metric.

    One shuffle carries (group, metric, distinct value, count) rows; everything
    else, the few means first, is computed from those counts. Measures on a fixed grid (lengths,
    rounded scores) have few distinct values in a group, and a task holds those; for ``continuous``
    ones the quartiles are found by rank (:func:`ranked_quantiles`).
    """
    metrics = F.array(*[
        F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values
    ])
    long = df.select(*by, F.inline(metrics))
    keys = [*by, "metric"]
    counted = value_counts(long, keys, "value")
    counted = materialize(counted, "value-counts") if continuous else counted
    n = F.sum("_n")
    total = F.sum(F.col("value") * F.col("_n"))
    # Squares of distances from the mean: squares of large values would cancel.
    means = counted.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg((total / n).alias("_mean"))
    same = _same(keys, "_")
    away = F.col("value") - F.col("_mean")
    spread = F.when(n > 1, F.sqrt(F.sum(away * away * F.col("_n")) / (n - 1)))
    moments = [
        n.alias("count"),
        F.round(total / n, 4).alias("mean"),
        F.round(spread, 4).alias("std"),
        F.round(F.min("value"), 4).alias("min"),
    ]
    most = F.round(F.max("value"), 4).alias("max")
    quartiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    rows = counted.join(means, same).groupBy(*by, "metric")
    if not continuous:
        return rows.agg(*moments, *[F.round(quantile("value", q), 4).alias(name) for name, q in quartiles.items()], most)
    found = ranked_quantiles(counted, keys, "value", list(quartiles.values())).groupBy(*[F.col(k).alias(f"_q{k}") for k in keys]).agg(
        *[F.round(F.max(F.when(F.col("quantile") == q, F.col("q"))), 4).alias(name) for name, q in quartiles.items()]
    )
    columns = [*keys, "count", "mean", "std", "min", *quartiles, "max"]
    return rows.agg(*moments, most).join(found, _same(keys, "_q")).select(*columns)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins from min to max; the last bin is closed on the right.

    Empty bins are kept. When all values are equal the range is widened by one
    half on each side.
    """
    spark = df.sparkSession
    counted = value_counts(df, [], value)
    low, high = F.min(value).cast("double"), F.max(value).cast("double")
    same = low == high
    bounds = counted.agg(
        F.struct(
            F.when(same, low - 0.5).otherwise(low).alias("lo"),
            F.when(same, high + 0.5).otherwise(high).alias("hi"),
        ).alias("b")
    ).scalar()
    placed = counted.withColumn("_b", bounds).select(
        F.least(
            F.floor((F.col(value) - F.col("_b.lo")) / (F.col("_b.hi") - F.col("_b.lo")) * bins),
            F.lit(bins - 1),
        ).cast("long").alias("bin"),
        "_n",
    ).groupBy("bin").agg(F.sum("_n").alias("n"))
    edges = spark.range(bins).select(F.col("id").alias("bin"), bounds.alias("_b"))
    width = (F.col("_b.hi") - F.col("_b.lo")) / bins
    return (
        edges.join(placed, "bin", "left")
        .select(
            "bin",
            F.round(F.col("_b.lo") + F.col("bin") * width, 4).alias("left_edge"),
            F.round(F.col("_b.lo") + (F.col("bin") + 1) * width, 4).alias("right_edge"),
            F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        )
    )


def share_of_total(counts: DataFrame, n: str = "n", alias: str = "pct", scale: int = 100, digits: int = 2) -> DataFrame:
    """Add each row's share; the total is a scalar subquery, not a window."""
    total = counts.agg(F.sum(n).alias("t")).scalar()
    return counts.withColumn(alias, F.round(F.lit(scale) * F.col(n) / total, digits))
