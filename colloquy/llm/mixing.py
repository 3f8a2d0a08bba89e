"""Mixing sources to target weights by Poisson replication, with DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import uniform, whole_text
from colloquy.session import materialize

#: Words reserved for the result.
COPY, POSITION = "copy_no", "shuffle_key"
#: Steps begin at 0 where the span would begin below this number.
FAR = 32
#: A document is exploded into runs of so many copies, then each run into its copies, so that no array grows with the count.
RUN = 4096


def poisson_steps(rates: DataFrame) -> DataFrame:
    """``_source, _rate, _first, _steps``: the distribution function of a Poisson variable at ``_first``, ``_first`` + 1, ...

    The steps span the mean plus and minus twelve deviations and 24, from 0 for means
    below about 270; outside them lies less than 2^-52. They are summed up as rows of
    a window, so their number grows with the root of the mean, and so does the work.
    """
    rate = F.col("_rate")
    reach = 12 * F.sqrt(rate) + 24
    low = F.floor(rate - reach)
    # The logarithm of a factorial by Stirling's series, exact to 1e-12 from 32 on.
    first = F.when(low >= FAR, low).otherwise(F.lit(0)).cast("long")
    n = F.col("_first").cast("double")
    far = n - rate + n * F.log(rate / n) - F.log(2 * math.pi * n) / 2 - 1 / (12 * n) + 1 / (360 * n * n * n)
    start = F.when(n > 0, far).otherwise(-rate)
    last = F.when(rate > 0, (rate + reach).cast("long")).otherwise(F.lit(0).cast("long"))
    so_far = W.partitionBy("_source").orderBy("_k").rowsBetween(W.unboundedPreceding, W.currentRow)
    log_p = F.sum(F.when(F.col("_k") == n, start).otherwise(F.log(rate / F.col("_k")))).over(so_far)
    walked = (
        rates.withColumn("_first", first).withColumn("_k", F.explode(F.sequence("_first", last)))
        .withColumn("_log_p", log_p).withColumn("_total", F.sum(F.exp("_log_p")).over(so_far))
    )
    return walked.groupBy("_source", "_rate", "_first").agg(F.sort_array(F.collect_list("_total")).alias("_steps"))


def source_rates(
    docs: DataFrame, weights: Mapping[str, float] | None, total_repetitions: float, source: str = "source",
) -> DataFrame:
    """Mean repetitions per document of each source, and the steps of its distribution.

    With ``W`` the share a source shall have, ``N`` all documents and ``n`` those
    of the source, the mean is ``total_repetitions * N * W / n``. Shares come from
    ``weights``, scaled over the sources present; without weights all sources are
    equal. A source without weight gets none. A null source is one source, named
    by ``None`` in ``weights``.
    """
    counts = docs.groupBy(F.col(source).alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    weighted = counts.withColumn("_weight", weight)
    all_rows, all_weight = weighted.agg(F.sum("_n").alias("n"), F.sum("_weight").alias("w")).first()
    if not all_weight:
        return poisson_steps(weighted.select("_source", F.lit(0.0).alias("_rate")))
    rate = F.lit(float(total_repetitions) * all_rows) * F.col("_weight") / F.lit(float(all_weight)) / F.col("_n")
    return poisson_steps(weighted.select("_source", rate.alias("_rate")))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    total_repetitions: float = 1.0,
    seed: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    shuffled: bool = True,
) -> DataFrame:
    """Repeat each document so that sources reach their target shares, in a global random order.

    A number in [0, 1), hashed from the id and ``seed``, is put through the
    inverse of the Poisson distribution with the source's mean; the document is
    exploded into so many rows, and the rows are ordered over the whole table by
    a hash of id, copy and seed. A run again gives the same rows.

    Counts per source combine before their shuffle. The table of sources is
    written, so that Spark knows its size when it plans the join: it broadcasts
    a small one and else shuffles and splits the hot source. One full shuffle of
    the texts remains: the global order asked for.

    Returns the columns of ``docs`` with ``copy_no`` (from 1) and
    ``shuffle_key``; columns of those names in ``docs`` give way. Rows with a
    null id hash their text in its place, and so do not all share one number.
    Repeated rows with one id get the same count. Null text stays null. An empty
    table gives an empty table.
    """
    columns = [c for c in docs.columns if c not in (COPY, POSITION)]
    rates = materialize(source_rates(docs, weights, total_repetitions, source), "rates")
    name = F.coalesce(F.col(doc_id).cast("string"), F.md5(whole_text(text).cast("binary")))
    rates = rates.withColumnsRenamed({"_source": "_mix_source", "_first": "_mix_first", "_steps": "_mix_steps"})
    times = F.col("_mix_times")
    past = F.least(times, (F.col("_mix_run") + 1) * RUN)
    counted = (
        docs.join(rates, F.col(source).eqNullSafe(F.col("_mix_source")))
        .withColumn("_mix_u", uniform(name, F.lit(str(seed))))
        .withColumn("_mix_times", F.col("_mix_first") + F.size(F.filter("_mix_steps", lambda step: step <= F.col("_mix_u"))))
        .where("_mix_times > 0")
        .withColumn("_mix_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((times - 1) / RUN))))
        .withColumn(COPY, F.explode(F.sequence((F.col("_mix_run") * RUN + 1).cast("int"), past.cast("int"))))
        .withColumn(POSITION, uniform(name, F.col(COPY).cast("string"), F.lit(f"order{seed}")))
        .select(*columns, COPY, POSITION)
    )
    return counted.orderBy(POSITION) if shuffled else counted
