"""Benchmark decontamination: pigeonhole pieces, exact piece hits, Myers distance."""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import defaultdict
from collections.abc import Callable

import ahocorasick
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import modest_batches

ERROR_RATE = 0.05
#: Characters of test items that are searched for together; more items take more passes over the documents.
BLOCK_CHARS = 1_000_000
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
#: In a Python worker: the automaton of the block of items in use, by the digest of the block.
_automaton: dict[bytes, ahocorasick.Automaton] = {}


def normalized(text: str | None) -> str:
    """Lower case, one space between words."""
    return _SPACE.sub(" ", (text or "").lower()).strip(" ")


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` disjoint pieces with their offsets: ``errors`` edits leave one of them whole."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(pattern: str, text: str, most: int, from_start: bool = False) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a part of ``text``, and the first end of such a part.

    Bit-parallel: one integer holds the vertical differences of a whole column.
    The part may start anywhere, or at 0 with ``from_start``. ``(most + 1, -1)``
    if none is within ``most``.
    """
    masks: dict[str, int] = defaultdict(int)
    for i, ch in enumerate(pattern):
        masks[ch] |= 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    rises, falls, score = full, 0, len(pattern)
    best, end = most + 1, -1
    for j, ch in enumerate(text, 1):
        equal = masks.get(ch, 0)
        across = (((equal & rises) + rises) ^ rises) | equal
        right_rises, right_falls = falls | (full & ~(across | rises)), rises & across
        if right_rises & top:
            score += 1
        elif right_falls & top:
            score -= 1
        right_rises, right_falls = (right_rises << 1) | from_start, right_falls << 1
        down = equal | falls
        rises = (right_falls | ~(down | right_rises)) & full
        falls = right_rises & down & full
        if score < best:
            best, end = score, j
    return best, end


def find_items(text: str | None, items: list[tuple], automaton: ahocorasick.Automaton) -> list[tuple]:
    """``(item, distance, start, end)`` of each item found in a text; the closest place, the first of equals."""
    body = normalized(text)
    starts: dict[int, list[int]] = defaultdict(list)
    for last, hits in automaton.iter(body):
        for index, offset, size in hits:
            starts[index].append(last - size + 1 - offset)
    found = []
    for index, places in starts.items():
        name, item, errors = items[index]
        best = (errors + 1, -1, -1)
        places.sort()
        first = previous = places[0]
        for place in [*places[1:], None]:
            if place is not None and place - previous <= 2 * errors + 1:
                previous = place
                continue
            low = max(0, first - errors)
            distance, end = myers(item, body[low:previous + len(item) + errors], errors)
            if distance < best[0]:
                end += low
                back = body[max(0, end - len(item) - errors):end][::-1]
                best = (distance, end - myers(item[::-1], back, errors, from_start=True)[1], end)
            first = previous = place
        if best[0] <= errors:
            found.append((name, *best))
    return found


def block_of(items: list[tuple]) -> tuple[bytes, list[tuple]]:
    """Items with a digest of all of them in their order; workers outlive a job, so an address does not tell blocks apart."""
    return hashlib.sha256(pickle.dumps(items)).digest(), items


def _built(block_id: bytes, items: list[tuple]) -> ahocorasick.Automaton:
    if block_id not in _automaton:
        _automaton.clear()
        known: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        for index, (_, item, errors) in enumerate(items):
            for offset, piece in pieces(item, errors):
                known[piece].append((index, offset, len(piece)))
        automaton = ahocorasick.Automaton()
        for piece, where in known.items():
            automaton.add_word(piece, where)
        automaton.make_automaton()
        _automaton[block_id] = automaton
    return _automaton[block_id]


def leak_finders(
    benchmark: DataFrame, error_rate: float = ERROR_RATE, item_id: str = "item_id", text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> list[Callable[[Column], Column]]:
    """Functions from a text column to its leaks, one for each block of test items.

    Items are dealt into blocks of about ``block_chars`` characters by hash, so
    what is sent to the executors at once keeps its size however many items
    there are. Items without text are left out.
    """
    spark = benchmark.sparkSession
    modest_batches(spark)
    known = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where(F.length(F.trim("text")) > 0)
    size = known.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-size // block_chars))
    result = T.ArrayType(T.StructType([
        T.StructField("item_id", known.schema["item_id"].dataType), T.StructField("distance", T.IntegerType()),
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    ]))
    finders = []
    for block in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).distinct().collect()
        items = [(row.item_id, item, int(len(item) * error_rate)) for row in rows if (item := normalized(row.text))]
        if not items:
            continue
        shared = spark.sparkContext.broadcast(block_of(items))
        finders.append(_finder(shared, result))
    return finders


def _finder(shared: Broadcast, result: T.DataType) -> Callable[[Column], Column]:
    @F.pandas_udf(result)
    def finder(texts: pd.Series) -> pd.Series:
        block_id, items = shared.value
        automaton = _built(block_id, items)
        return pd.Series([find_items(text, items, automaton) for text in texts])

    return finder


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Test items that occur in documents with at most ``error_rate`` edits per character.

    Items and whole texts are lower-cased with single spaces. An item of ``n``
    characters may differ by ``e = floor(n * error_rate)`` edits; of its
    ``e + 1`` pieces one must occur as it is, which one automaton finds in a pass
    over the text. Around each hit Myers' algorithm gives the exact distance. No
    row is shuffled, and work grows with documents times blocks of items.

    Returns ``doc_id, item_id, distance, start, end`` (place in the normalized
    text) for each row of ``docs`` and item found in it. Null and empty texts
    hold nothing, items without text are never found, repeated rows and repeated
    items give repeated results, and a null id stays null.
    """
    finders = leak_finders(benchmark, error_rate, item_id, item_text, block_chars)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    leaks = F.array() if not finders else F.concat(*[finder(F.col("_text")) for finder in finders])
    if not finders:
        kind = benchmark.schema[item_id].dataType.simpleString()
        leaks = leaks.cast(f"array<struct<item_id:{kind},distance:int,start:int,end:int>>")
    return base.select("doc_id", F.explode(leaks).alias("leak")).select("doc_id", "leak.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, text: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, in whose text no test item is found (see :func:`find_leaks`)."""
    for finder in leak_finders(benchmark, error_rate):
        docs = docs.where(F.size(finder(F.col(text))) == 0)
    return docs
