"""Corpus audit and validation. Input: ``doc_id, text, label`` unless stated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions.constants import LABELS, LONG_QUANTILE, SHORT_WORDS
from colloquy.operators import frames
from colloquy.operators.frames import count_rows
from colloquy.session import materialize



def missing_and_blank(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null and blank cells per column, in one pass over the data."""
    sums = df.agg(
        count_rows().alias("rows"),
        *[F.sum(F.col(c).isNull().cast("long")).alias(f"null_{c}") for c in columns],
        *[
            F.sum((T.is_blank(F.col(c).cast("string")) & F.col(c).isNotNull()).cast("long")).alias(f"blank_{c}")
            for c in columns
        ],
    )
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("rows"),
            F.coalesce(F.col(f"null_{c}"), F.lit(0)).cast("long").alias("missing"),
            F.coalesce(F.col(f"blank_{c}"), F.lit(0)).cast("long").alias("blank"),
        )
        for c in columns
    ])
    return sums.select(F.inline(rows))


def text_lengths(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumns({
        "char_count": T.char_count(text),
        "word_count": T.word_count(text),
        "punct_count": T.punctuation_count(text),
    })


def duplicate_counts(df: DataFrame, columns: Sequence[str], text: str = "text") -> DataFrame:
    """Repeats by whole row, by text and by normalized text.

    Only digests are shuffled, with counts already combined on the map side, so
    one text holding a third of all rows costs no more than any other.
    """
    keyed = (
        ("row", T.row_digest(list(columns))),
        ("text", T.digest(text)),
        ("normalized", T.digest(T.normalize(text))),
    )
    keys = F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in keyed])
    groups = df.select(F.inline(keys)).groupBy("kind", "key").agg(count_rows().alias("n"))
    return groups.groupBy("kind").agg(
        count_rows().alias("groups"),
        F.sum(F.col("n") - 1).alias("repeats"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("rows_sharing"),
    )


def label_conflicts(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Normalized texts that carry more than one label, by hex digest."""
    return (
        df.select(F.sha2(T.normalize(text), 256).alias("text_key"), label)
        .groupBy("text_key").agg(F.countDistinct(label).alias("n_labels"))
        .where(F.col("n_labels") > 1)
    )


def conflict_examples(df: DataFrame, n: int = 10, text: str = "text", label: str = "label") -> DataFrame:
    """The first ``n`` rows, by id, whose text carries several labels."""
    conflicts = label_conflicts(df, text, label).select("text_key")
    return (
        df.withColumn("text_key", F.sha2(T.normalize(text), 256))
        .join(conflicts, "text_key", "left_semi")
        .orderBy("doc_id").limit(n)
        .select("doc_id", text, label)
    )


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and percentage per label, with the largest-to-smallest ratio."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(count_rows().alias("n"))
    ratio = counts.agg(F.round(F.max("n") / F.min("n"), 3).alias("r")).scalar()
    return frames.share_of_total(counts).withColumn("imbalance_ratio", ratio)


def token_frequency(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(F.explode(T.audit_tokens(text)).alias("token")).groupBy("token").agg(count_rows().alias("n"))


def vocab_stats(df: DataFrame, text: str = "text", approximate: bool = False) -> DataFrame:
    """Vocabulary size, token total, and words that occur once.

    ``approximate`` estimates the vocabulary without shuffling tokens; rare
    words then stay null because they need exact counts.
    """
    if approximate:
        return df.select(F.explode(T.audit_tokens(text)).alias("token")).agg(
            F.approx_count_distinct("token").alias("vocab_size"),
            count_rows().alias("total_tokens"),
            F.lit(None).cast("long").alias("rare_words"),
            F.lit(None).cast("double").alias("rare_pct"),
        )
    once = F.sum((F.col("n") == 1).cast("long"))
    return token_frequency(df, text).agg(
        count_rows().alias("vocab_size"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens"),
        F.coalesce(once, F.lit(0)).alias("rare_words"),
        F.round(F.try_divide(100 * once, count_rows()), 2).alias("rare_pct"),
    )


def top_tokens(df: DataFrame, n: int = 20, text: str = "text") -> DataFrame:
    """The ``n`` most frequent tokens; ties go to the smaller token."""
    return token_frequency(df, text).orderBy(F.col("n").desc(), "token").limit(n)


def punct_share(df: DataFrame, text: str = "text") -> DataFrame:
    """Percentage of rows with an exclamation or a question mark."""
    def share(mark: str) -> Column:
        return F.round(100 * F.avg(F.contains(F.col(text), F.lit(mark)).cast("double")), 2)

    return df.agg(
        count_rows().alias("rows"), share("!").alias("pct_exclaim"), share("?").alias("pct_question")
    )


def describe_lengths(df: DataFrame, by: Sequence[str] = (), text: str = "text") -> DataFrame:
    return frames.describe(text_lengths(df, text), list(by), ["char_count", "word_count", "punct_count"])


def _word_counts(df: DataFrame, text: str) -> DataFrame:
    return frames.value_counts(df.select(T.word_count(text).alias("word_count")), [], "word_count")


def _long_threshold(counts: DataFrame) -> Column:
    """The 95 % quantile of counted lengths as a scalar subquery."""
    return counts.agg(frames.quantile("word_count", LONG_QUANTILE).alias("q")).scalar()


def long_threshold(df: DataFrame, text: str = "text") -> Column:
    """The 95 % quantile of word counts as a scalar subquery."""
    return _long_threshold(_word_counts(df, text))


def length_outliers(df: DataFrame, text: str = "text") -> DataFrame:
    """Short, long and noisy row counts, computed from one count per length.

    Blank rows have zero words, so ``word_count < 2`` already covers them; rows
    without text are reported by :func:`missing_and_blank`.
    """
    counts = materialize(_word_counts(df, text), "lengths")
    wc = F.col("word_count")
    rows = counts.withColumn("long_words", _long_threshold(counts))
    return rows.agg(
        F.coalesce(F.sum(F.when(wc <= SHORT_WORDS, F.col("_n"))), F.lit(0)).alias("short_rows"),
        F.round(F.max("long_words"), 1).alias("long_words"),
        F.coalesce(F.sum(F.when(wc >= F.col("long_words"), F.col("_n"))), F.lit(0)).alias("long_rows"),
        F.coalesce(F.sum(F.when(wc < 2, F.col("_n"))), F.lit(0)).alias("noisy_rows"),
    )


def length_outlier_examples(df: DataFrame, text: str = "text") -> DataFrame:
    """First rows by id of each kind: five short, three long, five noisy."""
    rows = df.select("doc_id", T.word_count(text).alias("word_count"))
    wc = F.col("word_count")
    limit = long_threshold(df, text)

    def heads(kind: str, condition: Column, n: int) -> DataFrame:
        return (
            rows.where(condition).orderBy("doc_id").limit(n)
            .select(F.lit(kind).alias("kind"), "doc_id", "word_count")
        )

    return (
        heads("short", wc <= SHORT_WORDS, 5)
        .unionByName(heads("long", wc >= limit, 3))
        .unionByName(heads("noisy", wc < 2, 5))
    )


def length_histogram(df: DataFrame, column: str = "word_count", bins: int = 30, text: str = "text") -> DataFrame:
    return frames.histogram(text_lengths(df, text).select(column), column, bins)


def box_stats(df: DataFrame, by: str = "label", value: str = "word_count", text: str = "text") -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges, and outlier counts."""
    counts = frames.value_counts(text_lengths(df, text).select(by, value), [by], value)
    quartiles = counts.groupBy(by).agg(
        frames.quantile(value, 0.25).alias("q1"),
        frames.quantile(value, 0.50).alias("q2"),
        frames.quantile(value, 0.75).alias("q3"),
    )
    v, reach = F.col(value), 1.5 * (F.col("q3") - F.col("q1"))
    low_ok, high_ok = v >= F.col("q1") - reach, v <= F.col("q3") + reach
    return (
        counts.join(quartiles, by)
        .groupBy(by, "q1", "q2", "q3")
        .agg(
            F.sum("_n").alias("n"),
            F.min(F.when(low_ok, v)).alias("lo"),
            F.max(F.when(high_ok, v)).alias("hi"),
            F.coalesce(F.sum(F.when(~(low_ok & high_ok), F.col("_n"))), F.lit(0)).alias("n_outliers"),
        )
        .select(
            by, "n",
            F.round("q1", 4).alias("q1"), F.round("q2", 4).alias("median"), F.round("q3", 4).alias("q3"),
            F.round(F.least(F.col("lo").cast("double"), F.col("q1")), 4).alias("whisker_low"),
            F.round(F.greatest(F.col("hi").cast("double"), F.col("q3")), 4).alias("whisker_high"),
            "n_outliers",
        )
    )


def label_set_diff(df: DataFrame, expected: Sequence[str] = LABELS, label: str = "label") -> DataFrame:
    """Labels found but not expected, and expected but not found."""
    spark = df.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in expected])).alias("label"))
    found = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct()
    return (
        found.subtract(wanted).select(F.lit("unexpected").alias("kind"), "label")
        .unionByName(wanted.subtract(found).select(F.lit("missing").alias("kind"), "label"))
    )


def validate_corpus(
    df: DataFrame, columns: Sequence[str], text: str = "text", label: str = "label",
    expected: Sequence[str] = LABELS,
) -> DataFrame:
    """One-row report with a ``passed`` flag; duplicates alone do not fail it.

    The corpus is read once: every row gives its digests, its label and whether
    anything in it is blank, and all of the report comes from the counts of
    those.
    """
    any_blank = F.lit(False)
    for c in columns:
        any_blank = any_blank | T.is_blank(F.col(c).cast("string"))

    def fact(kind: str, key: Column, of: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.cast("binary").alias("key"), of.cast("string").alias("label"))

    none = F.lit(None).cast("string")
    facts = F.array(
        fact("row", T.row_digest(list(columns)), none), fact("text", T.digest(T.normalize_strict(text)), F.col(label)),
        fact("label", F.lit(None).cast("string"), F.col(label)), fact("blank", any_blank.cast("string"), none),
    )
    counted = df.select(F.inline(facts)).groupBy("kind", "key", "label").agg(count_rows().alias("n"))
    keys = counted.groupBy("kind", "key").agg(
        F.sum("n").alias("n"), F.count("label").alias("labels"),
        F.collect_set(F.when(F.col("kind") == "label", F.col("label"))).alias("found"),
    )

    def total(kind: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0)).cast("long")

    known = F.array(*[F.lit(x) for x in expected])
    found = F.flatten(F.collect_list(F.when(F.col("kind") == "label", F.col("found"))))
    report = keys.agg(
        total("blank", F.col("n")).alias("rows"),
        total("blank", F.when(F.col("key") == F.lit("true").cast("binary"), F.col("n"))).alias("missing_or_blank_rows"),
        total("row", F.col("n") - 1).alias("exact_duplicate_rows"),
        total("text", F.col("n") - 1).alias("normalized_duplicate_rows"),
        F.array_join(F.array_sort(F.array_except(found, known)), ",").alias("invalid_labels"),
        F.array_join(F.array_sort(F.array_except(known, found)), ",").alias("missing_labels"),
        total("text", (F.col("labels") > 1).cast("long")).alias("conflicting_texts"),
    )
    return report.withColumn(
        "passed",
        (F.col("missing_or_blank_rows") == 0) & (F.col("invalid_labels") == "")
        & (F.col("missing_labels") == "") & (F.col("conflicting_texts") == 0),
    )


def require_valid(report: DataFrame) -> dict:
    """Strict mode: return the one-row report as a dict, or raise."""
    row = report.first().asDict()
    if not row["passed"]:
        raise ValueError(f"corpus validation failed: {row}")
    return row
