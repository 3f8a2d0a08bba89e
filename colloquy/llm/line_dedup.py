"""Repeated lines: two Bloom filters find the suspects, and only those are confirmed exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import SPACES, modest_batches, whole_text
from colloquy.session import materialize

SHARDS = 64
PROBES = 2
LEAST_BITS, MOST_BITS = 2**20, 2**29
TEXT_BYTES_PER_BIT = 8


def filter_bits(docs: DataFrame, text: str = "text", most_bits: int = MOST_BITS) -> int:
    """Size of each filter: a power of two near one bit for 8 bytes of text, within fixed bounds.

    ``most_bits`` (64 MB by default) is all that is ever sent to the executors.
    Beyond it filters fill up and suspect more lines; the result stays the same.
    """
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    bits = LEAST_BITS
    while bits < min(most_bits, size // TEXT_BYTES_PER_BIT):
        bits *= 2
    return bits


def keys_of(text: str | None, min_chars: int) -> list[bytes]:
    """Distinct keys of at least ``min_chars`` code points, A-Z lower-cased."""
    stripped = (line.strip(SPACES) for line in (text or "").split("\n"))
    return list({key.encode().lower() for key in stripped if len(key) >= min_chars})


def positions(keys: list[bytes], bits: int) -> np.ndarray:
    """Filter bits of each key, one row per key; all bits of a key lie in one shard."""
    hashes = np.array([xxhash.xxh3_64_intdigest(key) for key in keys], dtype=np.uint64)
    width = np.uint64(bits // SHARDS)
    shard = (hashes >> np.uint64(58)) * width
    return np.stack([shard + (hashes >> np.uint64(28 * i)) % width for i in range(PROBES)], axis=1).astype(np.int64)


def _seen_bits(min_chars: int, bits: int):
    """For each task, the bits that its documents set once or more, and twice or more, by shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            found = [keys_of(text, min_chars) for text in batch["text"]]
            at = positions([key for keys in found for key in keys], bits)
            at, counts = np.unique(at, axis=0, return_counts=True)
            new = np.unique(at)
            again = [twice, at[counts > 1].ravel(), new[np.isin(new, once, assume_unique=True)]]
            once, twice = np.union1d(once, new), np.unique(np.concatenate(again))
        width = bits // SHARDS
        rows = [
            (shard, own.astype(np.uint32).tobytes(), repeated.astype(np.uint32).tobytes())
            for shard, own, repeated in _by_shard(once, twice, width)
        ]
        yield pd.DataFrame(rows, columns=["shard", "once", "twice"])

    return run


def _by_shard(once: np.ndarray, twice: np.ndarray, width: int):
    for shard in np.unique(once // width):
        low, high = shard * width, (shard + 1) * width
        own = once[np.searchsorted(once, low):np.searchsorted(once, high)] - low
        repeated = twice[np.searchsorted(twice, low):np.searchsorted(twice, high)] - low
        yield int(shard), own, repeated


def _merged(bits: int):
    """Join what the tasks have seen, shard by shard: a bit that two tasks set is set twice."""
    width = bits // SHARDS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for shard, own, repeated in zip(batch["shard"], batch["once"], batch["twice"]):
                if shard not in shards:
                    shards[shard] = np.zeros(width, bool), np.zeros(width, bool)
                once, twice = shards[shard]
                own = np.frombuffer(own, np.uint32)
                twice[own[once[own]]] = True
                twice[np.frombuffer(repeated, np.uint32)] = True
                once[own] = True
        rows = [(shard, np.packbits(twice).tobytes()) for shard, (_, twice) in shards.items()]
        yield pd.DataFrame(rows, columns=["shard", "bits"])

    return run


def twice_seen(docs: DataFrame, text: str, min_chars: int, bits: int) -> bytes:
    """The filter of line keys that at least two documents hold (and a few others).

    Each task notes the bits of its own documents; what it sends on are bit
    positions. A once-seen and a twice-seen filter are merged from them for each
    of 64 shards; only the twice-seen one, of a fixed size, goes to the driver.
    """
    seen = docs.select(F.col(text).alias("text")).mapInPandas(
        _seen_bits(min_chars, bits), "shard int, once binary, twice binary"
    )
    merged = seen.repartition(SHARDS, "shard").mapInPandas(_merged(bits), "shard int, bits binary")
    whole = bytearray(bits // 8)
    size = bits // SHARDS // 8
    for row in merged.toLocalIterator():
        whole[row.shard * size:(row.shard + 1) * size] = row.bits
    return bytes(whole)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _suspects(filter_: Broadcast, bits: int, min_chars: int):
    """Digests of a text's lines that the twice-seen filter holds."""

    @F.pandas_udf("array<binary>")
    def suspects(texts: pd.Series) -> pd.Series:
        packed = np.frombuffer(filter_.value, np.uint8)
        out = []
        for text in texts:
            keys = keys_of(text, min_chars)
            if keys:
                at = positions(keys, bits)
                hit = ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
                keys = [_digest(key) for key, is_hit in zip(keys, hit) if is_hit]
            out.append(keys)
        return pd.Series(out)

    return suspects


def _without(min_chars: int):
    @F.pandas_udf("struct<text string, n_dropped bigint>")
    def without(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out = []
        for text, drop in zip(texts, drops):
            gone = {bytes(x) for x in drop} if drop is not None else set()
            lines = text.split("\n")
            kept = [
                line for line in lines
                if len(key := line.strip(SPACES)) < min_chars or _digest(key.encode().lower()) not in gone
            ] if gone else lines
            out.append(("\n".join(kept), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_dropped"])

    return without


def dedup_lines(
    docs: DataFrame,
    min_chars: int = 40,
    min_docs: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """Drop lines that many documents repeat, except in the document with the largest id.

    A line's key is the line without ASCII white space at both ends, A-Z
    lower-cased. Keys of at least ``min_chars`` code points held by at least
    ``min_docs`` documents lose all their lines but those of the largest id.

    Two Bloom filters tell which keys two documents may share. Only the digests
    of those are shuffled, counted and confirmed by digest; only documents that
    hold one are shuffled to be rewritten, all others pass through. Counts
    combine before the shuffle, so a line in a third of all documents costs a row
    per task, and its join with the confirmed keys can be split by Spark.

    Returns the columns of ``docs``, ``text`` replaced, with ``n_lines`` (before)
    and ``n_dropped``; columns of those names in ``docs`` give way. Null text
    counts as one empty line and becomes empty. Rows with one id are one
    document; rows with a null id are one document too, smaller than any other.
    """
    modest_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    bits = filter_bits(docs, text, most_bits)
    filter_ = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, text, min_chars, bits))
    suspects = _suspects(filter_, bits, min_chars)
    marked = docs.select(
        *columns, whole_text(text).alias("_line_text"), F.col(doc_id).alias("_line_doc"),
    ).withColumn("_line_suspects", suspects("_line_text"))
    suspected = materialize(
        marked.where(F.size("_line_suspects") > 0)
        .select("_line_doc", F.explode("_line_suspects").alias("_line_key")), "suspects",
    )
    repeated = materialize(
        suspected.groupBy("_line_key", "_line_doc").agg(F.lit(1).alias("_one"))
        .groupBy("_line_key").agg(F.count(F.lit(1)).alias("_docs"), F.max("_line_doc").alias("_keeper"))
        .where(F.col("_docs") >= min_docs).drop("_docs"), "repeated",
    )
    drops = (
        suspected.join(repeated, "_line_key")
        .where(~F.col("_line_doc").eqNullSafe(F.col("_keeper")))
        .groupBy(F.col("_line_doc").alias("_drop_doc")).agg(F.collect_set("_line_key").alias("_drop_keys"))
    )
    rewritten = (
        marked.where(F.size("_line_suspects") > 0).drop("_line_suspects")
        .join(drops, F.col("_line_doc").eqNullSafe(F.col("_drop_doc")), "left")
        .withColumn("_line_new", _without(min_chars)("_line_text", "_drop_keys"))
    )
    untouched = marked.where(F.size("_line_suspects") == 0).withColumn(
        "_line_new", F.struct(F.col("_line_text").alias("text"), F.lit(0).cast("long").alias("n_dropped"))
    )
    lines = F.length("_line_text") - F.length(F.replace("_line_text", F.lit("\n"))) + 1

    def finished(df: DataFrame) -> DataFrame:
        return df.select(
            *[F.col("_line_new.text").alias(text) if c == text else F.col(c) for c in columns],
            lines.cast("long").alias("n_lines"), F.col("_line_new.n_dropped").alias("n_dropped"),
        )

    return finished(rewritten).unionByName(finished(untouched))
