"""Shared pieces of the operators in this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"


def whole_text(text: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """16 hashed bytes of id and text: repeated rows share one key, and a null id is a value of its own."""
    return F.unhex(F.md5(F.concat(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("none")), F.lit("\n"), whole_text(text),
    ).cast("binary")))


def id_text(doc_id: str = "doc_id") -> Column:
    """The id as text: in pandas, integers beside a null would turn into floats and lose digits."""
    return F.col(doc_id).cast("string")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends only on ``parts``: 52 bits of their MD5 digest."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def words(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def stable_hash(values: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings, the same in every process."""
    if not values:
        return np.zeros(0, dtype=np.uint64)
    return pd.util.hash_array(np.array(values, dtype=object), categorize=True)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (multiply and shift)."""
    out = x >> np.uint64(32)
    out ^= x
    out *= np.uint64(0x9FB21C651E98DF25)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash for each ``k`` consecutive values; none if there are fewer."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, np.uint64(k))
    for j in range(k):
        total = mixed(total) + hashes[j:j + n]
    return mixed(total)


def slices(sizes: Sequence[int], most: int) -> Iterator[slice]:
    """Consecutive slices whose sizes add up to at most ``most``; a larger single item stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def release_memory() -> None:
    """Give memory that this process no longer uses back to the system.

    Python workers are reused from task to task; without this each keeps the most it ever needed.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, in a worker whose unused memory is given back before and after."""
    def tidied(batches: Iterator) -> Iterator:
        release_memory()
        try:
            yield from run(batches)
        finally:
            release_memory()

    return tidied


def modest_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python 1,000 rows at a time, unless the session already chose another number.

    With Spark's own 10,000 rows, a batch of long texts takes most of an executor's memory.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, "1000")


@contextmanager
def batches_of(spark: SparkSession, most: int) -> Iterator[None]:
    """What is run in here hands at most so many rows at a time to Python."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    own = int(before)
    spark.conf.set(setting, str(min(own, most) if own > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
