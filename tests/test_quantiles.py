"""Exact quantiles by rank, against Spark's own percentile and plain sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import frames

QUANTILES = [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]


def test_many_distinct_values_and_a_hot_group(spark):
    rows = spark.range(1_000_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 1000 == 1, "few").otherwise("hot").alias("g"),
        (F.rand(3) * F.when(F.col("id") % 7 == 0, 0).otherwise(100)).alias("v"),
    )
    counted = frames.value_counts(rows, ["g"], "v").cache()
    got = {(r.g, r["quantile"]): r.q for r in frames.ranked_quantiles(counted, ["g"], "v", QUANTILES).collect()}
    want = rows.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(q) for q in QUANTILES])).alias("q")).collect()
    assert len(got) == 3 * len(QUANTILES)
    for row in want:
        for q, value in zip(QUANTILES, row.q):
            assert got[row.g, q] == pytest.approx(value, abs=1e-9)


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 9, [1.0, 1.0, 1.0, 7.0], [-1.5, 0.0, 2.25, 9.0, 9.0, 11.0, 100.0]])
def test_small_groups(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = {r["quantile"]: r.q for r in frames.ranked_quantiles(frames.value_counts(df, [], "v"), [], "v", QUANTILES).collect()}
    assert got == {q: pytest.approx(float(np.quantile(values, q))) for q in QUANTILES}


def test_both_ways_of_describing_agree(spark):
    df = spark.createDataFrame([(None, 1.0, None), ("a", 2.5, 4.0), ("a", 2.5, None), ("a", 9.0, None), ("b", None, None)], "g string, x double, y double")
    one, two = (sorted(map(str, frames.describe(df, ["g"], ["x", "y"], continuous=c).collect())) for c in (False, True))
    assert one == two and len(one) == 3
    assert frames.describe(df.limit(0), ["g"], ["x"], continuous=True).count() == 0
