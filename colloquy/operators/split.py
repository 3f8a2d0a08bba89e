"""Leak-free stratified splitting and folds. Input: ``doc_id, text, label``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions.constants import EVAL_FRACTION, FOLDS, SPLIT_SEED, VALIDATION_FRACTION
from colloquy.operators import frames
from colloquy.operators.frames import count_rows
from colloquy.session import materialize


def seeded_hash(key: Column, seed: int = SPLIT_SEED) -> Column:
    """The shuffle order: an MD5 of seed and key."""
    return F.md5(F.concat(F.lit(str(seed)), key))


def text_key(text: str = "text") -> Column:
    """Digest of the normalized text; missing text counts as empty."""
    return F.md5(F.coalesce(T.normalize(text), F.lit("")))


def _held(fraction: float) -> Column:
    """True for the lowest ``ceil(fraction * size)`` ranks of a stratum."""
    return F.col("rank") <= F.ceil(F.lit(fraction) * F.col("size"))


def text_groups(df: DataFrame, text: str = "text", label: str = "label", row_id: str = "doc_id") -> DataFrame:
    """One row per normalized text with its first label in row order.

    The key is a digest, and copies combine on the map side.
    """
    first = F.min(F.when(F.col(label).isNotNull(), F.struct(row_id, label)))
    return (
        df.select(text_key(text).alias("text_key"), row_id, label)
        .groupBy("text_key").agg(first[label].alias("group_label"), count_rows().alias("copies"))
    )


def group_split(
    df: DataFrame, fraction: float = EVAL_FRACTION, seed: int = SPLIT_SEED, exact: bool = True,
    text: str = "text", label: str = "label", row_id: str = "doc_id",
) -> DataFrame:
    """Split groups of equal text by label, then give every row its group's side.

    ``exact`` takes precisely ``ceil(fraction * n)`` groups per label. Without
    it a hash threshold decides, which needs no ranking or join at all.
    """
    keyed = df.withColumn("text_key", text_key(text))
    if not exact:
        position = F.conv(F.substring(seeded_hash(F.col("text_key"), seed), 1, 8), 16, 10).cast("long")
        held = position < F.lit(int(fraction * (1 << 32)))
        return keyed.withColumn("split", F.when(held, "evaluation").otherwise("train"))
    # Written once: the ranking reads its narrow input twice.
    groups = materialize(text_groups(df, text, label, row_id).withColumn("_h", seeded_hash(F.col("text_key"), seed)), "groups")
    sides = frames.hash_rank(groups, "group_label", "_h").select(
        "text_key", F.when(_held(fraction), "evaluation").otherwise("train").alias("split")
    )
    return keyed.join(sides, "text_key")


def split_overlap(split: DataFrame, text: str = "text") -> DataFrame:
    """Normalized texts on both sides; empty for a leak-free split."""
    def side(name: str) -> DataFrame:
        return split.where(F.col("split") == name).select(text_key(text).alias("text_key"))

    return side("train").intersect(side("evaluation"))


def rows_on_side(df: DataFrame, groups: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose normalized text is among the chosen groups."""
    return df.withColumn("text_key", text_key(text)).join(groups, "text_key", "left_semi")


def split_distribution(split: DataFrame, label: str = "label") -> DataFrame:
    """Rows and percentage per label on each side."""
    train = F.sum((F.col("split") == "train").cast("long"))
    held = F.sum((F.col("split") == "evaluation").cast("long"))
    counts = split.groupBy(label).agg(train.alias("train_n"), held.alias("eval_n"))
    total = counts.agg(F.struct(F.sum("train_n").alias("train"), F.sum("eval_n").alias("eval")).alias("t")).scalar()
    return counts.withColumn("_t", total).select(
        label, "train_n", F.round(100 * F.col("train_n") / F.col("_t.train"), 2).alias("train_pct"),
        "eval_n", F.round(100 * F.col("eval_n") / F.col("_t.eval"), 2).alias("eval_pct"),
    )


def stratified_folds(
    df: DataFrame, folds: int = FOLDS, seed: int = SPLIT_SEED, label: str = "label", row_id: str = "doc_id"
) -> DataFrame:
    """Deal the shuffled rows of each label over the folds in turn."""
    hashed = df.withColumn("_h", seeded_hash(F.col(row_id).cast("string"), seed))
    ranked = frames.hash_rank(hashed, label, "_h")
    return ranked.withColumn("fold", ((F.col("rank") - 1) % folds).cast("int")).drop("rank", "size", "_h")


def row_split(
    df: DataFrame, fraction: float = VALIDATION_FRACTION, seed: int = SPLIT_SEED,
    label: str = "label", row_id: str = "doc_id",
) -> DataFrame:
    """Row-level stratified validation slice."""
    hashed = df.withColumn("_h", seeded_hash(F.col(row_id).cast("string"), seed))
    side = F.when(_held(fraction), "validation").otherwise("train")
    return frames.hash_rank(hashed, label, "_h").withColumn("split", side).drop("rank", "size", "_h")
