"""Exact duplicates by progressive refinement, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import whole_text
from colloquy.session import materialize

PREFIX_BYTES = 256


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per document: id, length in bytes, hash of the first bytes, SHA-256 of the whole text."""
    whole = whole_text(text)
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.octet_length(whole).alias("length"),
        F.xxhash64(F.substring(whole.cast("binary"), 1, PREFIX_BYTES)).alias("head"),
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"),
    )


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has. Counts combine before the shuffle, so a hot key costs a row per task."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of equal texts; of each group the row with the largest id stays.

    Texts are narrowed down by length, then by length and a hash of the first
    ``PREFIX_BYTES`` bytes; only rows that still share both are compared by the
    digest of the whole text. The text itself is read in one scan and never
    shuffled: the steps work on rows of 56 bytes, written once. The groups are
    written before rows meet them again, so that Spark can split that join where
    one group is large.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256`` for every row.
    Null text equals empty text. A null id is smaller than any other and stays
    only in a group without ids. Repeated rows with one id are all kept or all
    dropped. No other column of ``docs`` is read.
    """
    rows = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    by_length = _shared(rows, ["length"])
    close = rows.join(by_length, "length", "left_semi")
    by_head = materialize(_shared(close, ["length", "head"]), "heads")
    close = rows.join(by_head, ["length", "head"], "left_semi")
    groups = materialize(
        close.groupBy("length", "head", "digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups",
    )
    columns = ["doc_id", "digest", "keep_id", "group_size"]
    grouped = close.join(groups, ["length", "head", "digest"]).select(*columns)
    single = (
        rows.join(by_head, ["length", "head"], "left_anti")
        .select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    )
    return grouped.unionByName(single).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
