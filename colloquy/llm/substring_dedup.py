"""Repeated passages: MinHash banding of paragraphs, and anchored passages for copies inside other text."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from colloquy.llm.common import mixed, modest_batches, row_key, runs, slices, stable_hash, tidy, whole_text
from colloquy.llm.components import connected_components
from colloquy.llm.near_dedup import WORDS, linked_components
from colloquy.session import materialize

#: Words of an anchored passage. One anchor falls into any ``SPAN`` shingles, so every copy of
#: ``PASSAGE_WORDS + SPAN - 1`` words (51) or more holds an anchored passage as a whole.
PASSAGE_WORDS, SPAN = 24, 28
BAND_ROWS, RECALL = 2, 0.999
_BLOCK = 500_000


def bands_for(similarity: float, recall: float = RECALL, rows: int = BAND_ROWS) -> int:
    """Bands of ``rows`` coordinates with which a pair of that similarity shares one with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))


BANDS = bands_for(0.75)
_SEEDS = mixed(np.arange(101, 101 + BANDS * BAND_ROWS, dtype=np.uint64))
BAND_KEYS = [f"band_{i}" for i in range(BANDS)]


def _bands(hashes: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` shingles from ``first`` on, one 64-bit key for each band of its MinHash signature.

    Runs may overlap, as a block does its lines: each shingle is hashed once for all of them.
    """
    # Every other minimum is that of a gap between two runs; the value added stands after the last one.
    bounds = np.stack([first, first + counts], axis=1).ravel()
    padded = np.append(hashes, np.uint64(0))
    least = np.stack([np.minimum.reduceat(mixed(padded ^ seed), bounds)[::2] for seed in _SEEDS], axis=1)
    least = least.reshape(len(first), BANDS, BAND_ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), least.shape[:2])
    for row in range(BAND_ROWS):
        key = mixed(key + least[:, :, row])
    return key.view(np.int64)


def _anchors(hashes: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Places that hold the least hash of some ``SPAN`` neighbouring shingles of one text; the first of equals.

    ``alive`` says where ``SPAN`` shingles from a place on belong to one text. A
    place depends on nothing but the words around it, so copies have the same
    ones wherever they stand. Minima of longer and longer windows are made from
    two shorter ones each.
    """
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    order = ((hashes >> bits) << bits) | np.arange(len(hashes), dtype=np.uint64)
    width, least = 1, order
    while width < SPAN:
        step = min(width, SPAN - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    # Windows move to the right, and so do the places of their minima: equal ones are neighbours.
    at = (least[alive[:len(least)]] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return at[np.append(True, at[1:] != at[:-1])[:len(at)]]


def _run_hash(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on."""
    total = np.full(len(at), np.uint64(n))
    for j in range(n):
        total = mixed(total) + hashes[at + j]
    return mixed(total).view(np.int64)


def _distinct(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many different hashes each of consecutive runs of ``counts`` hashes has."""
    bits = np.uint64(len(counts).bit_length())
    high = np.uint64(64) - bits
    keys = np.sort((np.repeat(np.arange(len(counts), dtype=np.uint64), counts) << high) | (hashes >> bits))
    found, ends = counts.copy(), np.cumsum(counts)
    # Only a run with equal keys can have equal hashes.
    for i in np.unique(keys[1:][keys[1:] == keys[:-1]] >> high).astype(np.int64):
        found[i] = len(np.unique(hashes[ends[i] - counts[i]:ends[i]]))
    return found


def _lines_and_blocks(start: np.ndarray, size: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, words and text of each line, and of each block of two lines or more that no blank line parts."""
    written = np.flatnonzero(size > 0)
    begins = np.ones(len(written), dtype=bool)
    begins[1:] = (np.diff(written) > 1) | (np.diff(text[written]) > 0)
    at = np.flatnonzero(begins)
    lines = np.diff(np.append(at, len(written)))
    words_of = np.add.reduceat(size[written], at) if len(at) else at
    blocks, words_of = written[at[lines > 1]], words_of[lines > 1]
    both, sizes = np.concatenate([written, blocks]), np.concatenate([size[written], words_of])
    enough = sizes >= WORDS
    return start[both[enough]], sizes[enough], text[both[enough]]


def parts_of(texts: list[str]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Paragraphs (``text, at, n_words, n, digest`` and band keys) and anchored passages (without ``n`` and bands) of some texts.

    Paragraphs are lines, and blocks of several lines between blank ones, of a
    shingle or more; the same words are one digest on one line or on many. ``text`` is the number of the text, ``at`` the place of
    the first word in it, ``n`` the number of different shingles.
    """
    lines = [[line.encode().lower().split() for line in text.split("\n")] for text in texts]
    hashes = stable_hash([word for text in lines for line in text for word in line])
    per_text = np.array([sum(map(len, text)) for text in lines], dtype=np.int64)
    text_start = np.cumsum(per_text) - per_text
    line_size = np.array([len(line) for text in lines for line in text], dtype=np.int64)
    line_start = np.cumsum(line_size) - line_size
    line_text = np.repeat(np.arange(len(lines)), [len(text) for text in lines])
    fives = runs(hashes, WORDS)

    first, size, owner = _lines_and_blocks(line_start, line_size, line_text)
    paragraphs = pd.DataFrame({"text": owner, "at": first - text_start[owner], "n_words": size})
    if len(first):
        counts = size - WORDS + 1
        begins = np.cumsum(counts) - counts
        within = np.arange(counts.sum()) - np.repeat(begins, counts)
        own = fives[np.repeat(first, counts) + within]
        paragraphs["n"] = _distinct(own, counts)
        paragraphs[BAND_KEYS] = _bands(fives, first, counts)
        order = mixed(own + mixed(np.arange(counts.max(), dtype=np.uint64))[within])
        paragraphs["digest"] = mixed(np.add.reduceat(order, begins) + size.astype(np.uint64)).view(np.int64)

    before = PASSAGE_WORDS // 2
    text_of = np.repeat(np.arange(len(lines)), per_text)
    reach = SPAN + WORDS - 2
    alive = np.zeros(len(fives), dtype=bool)
    if len(hashes) > reach:
        alive[:len(hashes) - reach] = text_of[:-reach] == text_of[reach:]
    at = _anchors(mixed(fives), alive) if alive.any() else np.zeros(0, np.int64)
    at = at - before
    at = at[(at >= 0) & (at + PASSAGE_WORDS <= len(hashes))]
    owner = text_of[at + before]
    inside = (at >= text_start[owner]) & (at + PASSAGE_WORDS <= text_start[owner] + per_text[owner])
    at, owner = at[inside], owner[inside]
    passages = pd.DataFrame({
        "text": owner, "at": at - text_start[owner], "n_words": PASSAGE_WORDS, "digest": _run_hash(hashes, at, PASSAGE_WORDS),
    })
    return paragraphs, _united(passages)


def _united(passages: pd.DataFrame) -> pd.DataFrame:
    """Places of one passage that overlap in one text, as one: a text that repeats a few words has it at very many."""
    # They come by text and place, so those of one digest stay in that order.
    order = np.argsort(passages["digest"].to_numpy(), kind="stable")
    text, at, n_words, digest = (passages[c].to_numpy()[order] for c in ("text", "at", "n_words", "digest"))
    apart = np.ones(len(order), dtype=bool)
    apart[1:] = (text[1:] != text[:-1]) | (digest[1:] != digest[:-1]) | (at[1:] >= at[:-1] + n_words[:-1])
    first = np.flatnonzero(apart)
    last = np.append(first[1:], len(order))[:len(first)] - 1
    return pd.DataFrame({"text": text[first], "at": at[first], "n_words": at[last] + n_words[last] - at[first], "digest": digest[first]})


_NUMBERS = ["at", "n_words", "digest", "n", *BAND_KEYS]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for part in slices([len(text) for text in texts], _BLOCK):
            for found in parts_of(texts[part]):
                if len(found):
                    own = pa.array(found["text"].to_numpy() + part.start)
                    columns = {name: batch.column(name).take(own) for name in ("key", "doc_id")}
                    for name in _NUMBERS:
                        columns[name] = pa.array(found[name].to_numpy()) if name in found else pa.nulls(len(found), pa.int64())
                    yield pa.RecordBatch.from_pydict(columns)


def _paragraphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The wanted paragraphs of each text, by digest."""
    for batch in batches:
        rows = []
        for text, wanted in zip(batch["text"], batch["wanted"]):
            tokens = text.encode().lower().split()
            rows += [(digest, b" ".join(tokens[at:at + n]).decode()) for at, n, digest in map(dict.values, wanted)]
        yield pd.DataFrame(rows, columns=["digest", "text"])


def _row_number(doc_id: str, text: str) -> Column:
    """The first 64 bits of the row's key as a number, in the order of the bytes.

    Places and bands are numbers, too, so that Spark groups and shuffles them without sorting bytes.
    """
    first = F.substring(F.hex(row_key(doc_id, text)), 1, 16)
    return F.conv(first, 16, -10).cast("long").bitwiseXOR(F.lit(-2**63))


def similar_paragraphs(docs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``digest, cluster`` of paragraphs that are linked with a different one."""
    # What has one digest has the same words, so the same bands; key and place are those of one of them.
    nodes = paragraphs.groupBy(F.col("digest").alias("node")).agg(
        *[F.min(name).alias(name) for name in ("n", "n_words", *BAND_KEYS)], F.first("key").alias("key"), F.first("at").alias("at"))
    nodes = materialize(nodes, "paragraphs")
    postings = nodes.select("node", "n", F.explode(F.array(*BAND_KEYS)).alias("key"))
    sizes = materialize(postings.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    # Most paragraphs share no band. Those that do have at most one row a band each, so the sum is over few.
    shared = postings.join(sizes.hint("shuffle_hash"), "key")
    lists = materialize(shared.withColumn("score", F.sum("size").over(Window.partitionBy("node"))), "lists")

    def bodies_of(wanted: DataFrame) -> DataFrame:
        places = (
            nodes.join(wanted, "node", "left_semi").groupBy("key")
            .agg(F.collect_list(F.struct("at", "n_words", F.col("node").alias("digest"))).alias("wanted"))
        )
        # A digest has one place. Repeated rows meet it each, and are one before their words are cut out.
        met = docs.select("key", "text").join(places.hint("shuffle_hash"), "key")
        once = met.groupBy("key").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
        return once.mapInPandas(tidy(_paragraphs), "digest long, text string").withColumnRenamed("digest", "node")

    return linked_components(lists, bodies_of, 1).select(F.col("node").alias("digest"), F.col("component").alias("cluster"))


def _minus(start: int, end: int, kept: list[tuple[int, int]], ends: list[int]) -> list[tuple[int, int]]:
    """What is left of a span without the kept ones, which are in order and apart; ``ends`` are theirs."""
    left = []
    for a, b in kept[bisect_right(ends, start):]:
        if a >= end:
            break
        if a > start:
            left.append((start, a))
        start = max(start, b)
    return left + [(start, end)] * (start < end)


def stretches_of(places: list[tuple]) -> list[tuple]:
    """``(start, end, head, n_docs, removed, units)`` of one document, from ``(at, end, unit, holders, n_docs, kept)``.

    Overlapping places of units with the same holders are one stretch. What the
    document keeps for others is taken out of what is removed from it; a stretch
    of which nothing is left to remove stays.
    """
    stretches: list[list] = []
    for at, end, unit, holders, n_docs, kept in sorted(places, key=lambda x: (x[3], x[0])):
        if stretches and stretches[-1][3] == holders and at < stretches[-1][1]:
            stretches[-1][1] = max(end, stretches[-1][1])
            stretches[-1][2].add(unit)
        else:
            stretches.append([at, end, {unit}, holders, n_docs, kept])
    own: list[tuple[int, int]] = []
    for start, end in sorted((x[0], x[1]) for x in stretches if x[5]):
        if own and start <= own[-1][1]:
            own[-1] = (own[-1][0], max(end, own[-1][1]))
        else:
            own.append((start, end))
    ends, rows = [end for _, end in own], []
    for start, end, units, _, n_docs, kept in stretches:
        left = [] if kept else _minus(start, end, own, ends)
        for i, (a, b) in enumerate(left or [(start, end)]):
            rows.append((a, b, min(units), n_docs, bool(left), [] if i else sorted(units)))
    return rows


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["doc_id", "start_word", "end_word", "head", "n_docs", "removed", "units"]
    for batch in batches:
        rows = [
            (doc_id, *row)
            for doc_id, places in zip(batch["doc_id"].array, batch["places"])
            for row in stretches_of([tuple(place.values()) for place in places])
        ]
        yield pd.DataFrame(rows, columns=columns)


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages that stand in more than one document, with the spans to remove.

    Paragraphs (lines, and blocks of lines between blank ones, of five words or
    more) are banded by MinHash, equal ones once, with as many bands of two coordinates as find a pair at 0.75 with probability 0.999;
    paragraphs that collide are confirmed by the Jaccard similarity of their
    whole five-word shingle sets. Copies inside other text are found by passages
    of 24 words at anchored places: any copy of 51 words or more holds one.

    Each component of similar paragraphs is kept by its holder of the smallest id
    and removed from the others; so is each passage, not counting places inside a
    similar paragraph that is removed. Passages that overlap and
    have the same holders are one cluster, so a span holds repeated words only.
    What a document keeps for one passage is not removed from it for another:
    every removed passage stays whole with its keeper (a similar paragraph in the
    keeper's words). Holders are counted on the map side before each shuffle.

    Returns one row per document and stretch, all places of it: ``doc_id,
    cluster`` (16 hex digits), ``start_word, end_word``, ``n_docs`` that hold the
    cluster and ``removed``. A stretch that is kept in part gives a row for each
    part to remove; one that is kept as a whole has false, as with the keeper.
    Documents without repeats give no row. Rows with one id and one text are one
    document, and so are not repeats of each other; a null id counts as larger
    than any other. Null and empty texts have no passage.
    """
    modest_batches(docs.sparkSession)
    base = docs.select(_row_number(doc_id, text).alias("key"), F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    kind = docs.schema[doc_id].dataType
    schema = StructType([StructField("key", LongType()), StructField("doc_id", kind), *[StructField(name, LongType()) for name in _NUMBERS]])
    parts = materialize(base.mapInArrow(tidy(_parts), schema), "parts")
    paragraphs = parts.where(F.col("n").isNotNull())
    similar = materialize(similar_paragraphs(base, paragraphs), "similar")
    first = materialize(similar.groupBy("cluster").agg(F.min("digest").alias("unit")), "first")
    alike = similar.join(first, "cluster").select("digest", "unit")
    again = (
        parts.groupBy("digest").agg(F.min("key").alias("low"), F.max("key").alias("high"))
        .where("low <> high").select("digest", F.col("digest").alias("unit"), F.lit(False).alias("similar"))
    )
    marked = alike.withColumn("similar", F.lit(True)).unionByName(again.join(similar, "digest", "left_anti"))
    marked = materialize(marked, "marked")
    repeated = materialize(
        parts.join(marked.hint("shuffle_hash"), "digest").select("key", "doc_id", "at", (F.col("at") + F.col("n_words")).alias("end"), "unit", "similar").distinct(),
        "repeated",
    )
    one = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "key")

    def holders_of(places: DataFrame, name: str) -> DataFrame:
        held = places.groupBy("unit", "key").agg(F.first("doc_id").alias("doc_id")).groupBy("unit").agg(
            F.count(F.lit(1)).alias("n_docs"), F.min(one)["key"].alias("keeper"), F.bit_xor(F.xxhash64("key")).alias("all")
        )
        held = held.where("n_docs > 1").select("unit", "n_docs", "keeper", F.xxhash64("n_docs", "keeper", "all").alias("holders"))
        return materialize(held, name)

    keepers = holders_of(repeated.where("similar"), "keepers").select("unit", "keeper")
    gone = F.max(F.when(F.col("key") != F.col("keeper"), F.col("end"))).over(Window.partitionBy("key").orderBy("at"))
    others = repeated.where(~F.col("similar")).withColumn("keeper", F.lit(None).cast("long"))
    live = repeated.where("similar").join(keepers, "unit", "left").unionByName(others).withColumn("gone", gone)
    live = materialize(live.where(F.col("similar") | F.coalesce(F.col("gone") < F.col("end"), F.lit(True))).drop("keeper", "gone"), "live")
    holders = holders_of(live, "holders")
    placed = live.join(holders.hint("shuffle_hash"), "unit").groupBy("key").agg(
        F.first("doc_id").cast("string").alias("doc_id"),
        F.collect_list(F.struct("at", "end", "unit", "holders", "n_docs", (F.col("key") == F.col("keeper")).alias("kept"))).alias("places"),
    )
    stretches = materialize(placed.select("doc_id", "places").mapInPandas(
        tidy(_stretches),
        "doc_id string, start_word long, end_word long, head long, n_docs long, removed boolean, units array<bigint>",
    ), "stretches")
    clusters = connected_components(stretches.select(F.col("head").alias("a"), F.explode("units").alias("b")).distinct())
    return stretches.join(clusters, F.col("head") == F.col("node")).select(
        F.col("doc_id").cast(kind).alias("doc_id"), F.lower(F.lpad(F.hex("component"), 16, "0")).alias("cluster"),
        "start_word", "end_word", "n_docs", "removed",
    )
