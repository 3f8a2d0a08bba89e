"""Phrases that occur together more often than their parts would by chance.

Texts are read once and kept as blocks: the words of a block, ranked by their
frequency in it, and the text as a sequence of those ranks. Counting goes up one
word at a time. Neighbouring ranks are pairs; the pairs that may be frequent are
ranked in turn, and neighbouring ranks of overlapping pairs are phrases of three
words, and so on.

Pairs are counted in tiles of ``TILE`` x ``TILE`` ranks. A few tiles hold most
pairs: those are counted in a dense array that is addressed by the pair itself,
with one ``bincount``; the pairs of all other tiles are sorted and counted as
runs. What blocks count is added up by Spark, with the words themselves as key.

Before a block grows phrases of ``k`` words it drops those of ``k - 1`` words that
are rare in the whole corpus, by a Bloom filter of the frequent ones. Only such
filters, of a bounded size, go to the executors; a false hit costs a few rows and
changes no count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import batches_of, mixed, release_memory, stable_hash, tidy, whole_text
from colloquy.session import materialize

LEAST_COUNT, LONGEST = 100, 5
#: Bytes of text in a block; a longer text makes a longer block, of four bytes a word.
BLOCK_BYTES = 6 << 20
#: So many input partitions of blocks are counted by one task: what it counts more than once leaves it as one row.
BLOCK_PARTITIONS = 4
#: Texts, and blocks, that are handed to a worker at once.
TEXTS_AT_ONCE, BLOCKS_AT_ONCE = 500, 2
#: Longer texts are cut into words by so many bytes at a time.
SLICE_BYTES = 1 << 20
#: Side of a tile in ranks, and the pairs from which on a tile is counted densely.
TILE, DENSE_PAIRS = 512, 1 << 13
#: Filters have about 16 bits for each frequent phrase, at most 64 MB; fuller ones let more rare phrases pass.
LEAST_BITS, MOST_BITS, SHARDS, PROBES = 1 << 16, 1 << 29, 64, 4
BREAK = -1
UNKNOWN = "und"

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _BREAKS, b"abcdefghijklmnopqrstuvwxyz " + b"\xff" * len(_BREAKS)
)


# --- Texts to blocks -------------------------------------------------------------------------

class _Numbers(dict):
    """Words to the numbers of their first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _slices(text: bytes) -> Iterator[bytes]:
    """The folded text in slices that end between words. The byte 0xFF, which no text has, stands for a break."""
    folded = text.translate(_TABLE)
    start = 0
    while len(folded) - start > SLICE_BYTES:
        end = start + SLICE_BYTES
        stops = [x for x in (folded.find(b" ", end), folded.find(b"\xff", end)) if x >= 0]
        end = min(stops) if stops else len(folded)
        yield folded[start:end]
        start = end
    yield folded[start:]


class _Block:
    """Texts of one language as numbers into a vocabulary of their own; ``BREAK`` between pieces."""

    def __init__(self) -> None:
        self.numbers, self.runs, self.size = _Numbers({b"\xff": 0}), [], 0

    def add(self, text: bytes) -> None:
        for part in _slices(text):
            words = part.replace(b"\xff", b" \xff ").split()
            self.runs.append(np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int32, count=len(words)))
        self.runs.append(np.zeros(1, dtype=np.int32))
        self.size += len(text)

    def row(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words by falling count, their counts, and the text as places in that list."""
        ids = np.concatenate(self.runs)
        counts = np.bincount(ids, minlength=len(self.numbers))
        counts[0] = 0
        order = np.argsort(-counts[1:], kind="stable") + 1
        place = np.full(len(counts), BREAK, dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        words = list(self.numbers)
        return [words[i] for i in order], counts[order], place[ids]


def _blocks(texts: DataFrame, block_bytes: int) -> DataFrame:
    """``lang, n_words, words, counts, ids``: the texts, packed by language as they come, the last three compressed.

    A block ends at ``block_bytes`` of text; when all open blocks together have twice that, the largest ends.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, _Block] = {}
        size = 0

        def close(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal size
            block = opened.pop(lang)
            size -= block.size
            words, counts, ids = block.row()
            if words:
                packed = [zstandard.compress(x, 1) for x in (b" ".join(words), counts.astype(np.int64).tobytes(), ids.tobytes())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([int(counts.sum())], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)],
                    names=["lang", "n_words", "words", "counts", "ids"],
                )

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang, text = lang.as_py(), text.as_py()
                block = opened.setdefault(lang, _Block())
                block.add(text)
                size += len(text)
                if block.size >= block_bytes:
                    yield from close(lang)
                elif size >= 2 * block_bytes:
                    yield from close(max(opened, key=lambda x: opened[x].size))
        for lang in list(opened):
            yield from close(lang)

    return texts.mapInArrow(tidy(run), "lang string, n_words long, words binary, counts binary, ids binary")


def _unpacked(rows: pa.RecordBatch) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
    """Language, words, their counts and the sequence of each block, one block at a time."""
    for i in range(rows.num_rows):
        words, counts, ids = (zstandard.decompress(rows.column(c)[i].as_py()) for c in ("words", "counts", "ids"))
        yield rows.column("lang")[i].as_py(), words.split(b" "), np.frombuffer(counts, np.int64), np.frombuffer(ids, np.int32)


def _rows_of(lang: str, phrases: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(n), 1 << 16):
        part = phrases[start:start + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), part, pa.array(n[start:start + (1 << 16)])], names=["lang", "phrase", "n"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, phrase, n`` of the words of each block."""
    for batch in batches:
        for lang, words, counts, _ in _unpacked(batch):
            yield from _rows_of(lang, pa.array(words, pa.binary()), counts)


# --- Filters of frequent phrases -------------------------------------------------------------

def _hashes(words: np.ndarray, phrases: np.ndarray, lang: str) -> np.ndarray:
    """One hash for each row of ``phrases``, which are places in ``words``, the hashes of words."""
    total = np.full(len(phrases), stable_hash([lang.encode()])[0])
    for column in phrases.T:
        total = mixed(total) + words[column]
    return mixed(total)


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Filter bits of each hash, one row per hash; all bits of a hash lie in one shard."""
    width = np.uint64(bits // SHARDS)
    shard = (hashes >> np.uint64(58)) * width
    again = mixed(hashes)
    return np.stack([shard + ((hashes + np.uint64(i) * again) & (width - np.uint64(1))) for i in range(PROBES)], axis=1).astype(np.int64)


def _held(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    packed = np.frombuffer(filter_, np.uint8)
    at = _positions(hashes, len(packed) * 8)
    return ((packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _filter_of(frequent: DataFrame, size: int, rows: int, most_bits: int) -> bytes:
    """A Bloom filter of ``lang, phrase`` rows of ``size`` words; its shards are made by tasks."""
    bits = LEAST_BITS
    while bits < min(most_bits, 16 * rows):
        bits *= 2
    width = bits // SHARDS

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            words = stable_hash([w for phrase in batch.column(1).to_pylist() for w in phrase.split(b" ")])
            places = np.arange(len(words)).reshape(len(langs), size)
            for lang in sorted(set(langs)):
                at = np.unique(_positions(_hashes(words, places[[x == lang for x in langs]], lang), bits))
                shards = np.unique(at // width)
                own = [(at[(at >= s * width) & (at < (s + 1) * width)] - s * width).astype(np.uint32).tobytes() for s in shards]
                yield pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), pa.array(own, pa.binary())], names=["shard", "at"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Shards come one after the other, and only one is held.
        own, flags = None, None

        def packed() -> pa.RecordBatch:
            bits_ = np.packbits(flags, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([bits_], pa.binary())], names=["shard", "bits"])

        for batch in batches:
            for shard, at in zip(batch.column(0).to_pylist(), batch.column(1)):
                if shard != own:
                    if own is not None:
                        yield packed()
                    own, flags = shard, np.zeros(width, bool)
                flags[np.frombuffer(at.as_py(), np.uint32)] = True
        if own is not None:
            yield packed()

    parts = frequent.select("lang", "phrase").mapInArrow(sent, "shard int, at binary").repartition("shard").sortWithinPartitions("shard")
    whole = bytearray(bits // 8)
    for row in parts.mapInArrow(merged, "shard int, bits binary").toLocalIterator():
        whole[row.shard * width // 8:(row.shard + 1) * width // 8] = row.bits
    return bytes(whole)


# --- Pairs in tiles --------------------------------------------------------------------------

def count_pairs(ids: np.ndarray, tile: int = TILE, dense_pairs: int = DENSE_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring ids ``a, b`` of a sequence, and how often each pair occurs; a break is no neighbour."""
    a, b = ids[:-1], ids[1:]
    both = (a >= 0) & (b >= 0)
    a, b = a[both], b[both]
    if not len(a):
        return a, b, a
    side = int(b.max()) // tile + 1
    tiles, member, sizes = np.unique(a // tile * side + b // tile, return_inverse=True, return_counts=True)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in np.flatnonzero(sizes >= dense_pairs):
        row, column = divmod(int(tiles[k]), side)
        inside = member == k
        counts = np.bincount((a[inside] - row * tile) * tile + (b[inside] - column * tile), minlength=tile * tile)
        at = np.flatnonzero(counts)
        found.append((at // tile + row * tile, at % tile + column * tile, counts[at]))
    sparse = (sizes < dense_pairs)[member]
    if sparse.any():
        x, y = a[sparse], b[sparse]
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        starts = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        found.append((x[starts], y[starts], np.diff(np.append(starts, len(x)))))
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*found))


def compact(ids: np.ndarray) -> np.ndarray:
    """The sequence without ids that have no neighbour, and with one break for several."""
    known = np.concatenate(([False], ids >= 0, [False]))
    beside = known[1:-1] & (known[:-2] | known[2:])
    ids = np.where(beside, ids, BREAK)
    again = np.append(False, (ids[1:] == BREAK) & (ids[:-1] == BREAK)) if len(ids) else np.zeros(0, dtype=bool)
    return ids[~again]


def ranked_pairs(ids: np.ndarray, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of neighbouring pairs, named by rank of frequency, and the words of each.

    ``phrases`` has the words of each id; two neighbours overlap in all words but the first and the last.
    """
    both = (ids[:-1] >= 0) & (ids[1:] >= 0)
    codes, member, counts = np.unique(ids[:-1][both] * len(phrases) + ids[1:][both], return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(codes), dtype=np.int64)
    rank[order] = np.arange(len(codes))
    new = np.full(len(ids) - 1 if len(ids) else 0, BREAK, dtype=np.int64)
    new[both] = rank[member]
    first, second = codes[order] // max(len(phrases), 1), codes[order] % max(len(phrases), 1)
    return new, np.concatenate((phrases[first], phrases[second][:, -1:]), axis=1)


def grow(words: list[bytes], lang: str, ids: np.ndarray, filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of one word more than there are filters, as places in ``words``, and their counts in a block."""
    hashes = stable_hash(words)
    phrases = np.arange(len(words))[:, None]
    for size, filter_ in enumerate(filters, 1):
        if size > 1:
            ids, phrases = ranked_pairs(ids, phrases)
        kept = _held(filter_, _hashes(hashes, phrases, lang))
        rank = np.append(np.where(kept, np.cumsum(kept) - 1, BREAK), BREAK)
        ids, phrases = compact(rank[ids]), phrases[kept]
    a, b, n = count_pairs(ids)
    return np.concatenate((phrases[a], phrases[b][:, -1:]), axis=1), n


def _grown(blocks: DataFrame, filters: list[Broadcast]) -> DataFrame:
    """``lang, phrase, n``: what each block counts of phrases of one word more than there are filters."""
    spark = blocks.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x.value for x in filters]
        for batch in batches:
            release_memory()
            for lang, words, _, ids in _unpacked(batch):
                places, n = grow(words, lang, ids.astype(np.int64), held)
                known = pa.array(words, pa.binary())
                for start in range(0, len(n), 1 << 16):
                    columns = places[start:start + (1 << 16)].T
                    phrases = pc.binary_join_element_wise(*[known.take(pa.array(column)) for column in columns], b" ")
                    yield from _rows_of(lang, phrases, n[start:start + (1 << 16)])

    few = max(blocks.rdd.getNumPartitions() // BLOCK_PARTITIONS, spark.sparkContext.defaultParallelism)
    return blocks.coalesce(few).mapInArrow(tidy(run), "lang string, phrase binary, n long")


# --- Phrases ---------------------------------------------------------------------------------

def frequent_phrases(
    docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, lang: str = "lang", text: str = "text",
    block_bytes: int = BLOCK_BYTES, most_bits: int = MOST_BITS,
) -> tuple[list[DataFrame], DataFrame]:
    """Tables ``lang, phrase, f`` of phrases of 1, 2, ... words that occur ``least`` times in their language, and ``lang, n_words``."""
    texts = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), whole_text(text).cast("binary").alias("text"),
    )
    spark = docs.sparkSession
    with batches_of(spark, TEXTS_AT_ONCE):
        blocks = materialize(_blocks(texts, block_bytes), "word-blocks")
    n_words = materialize(blocks.groupBy("lang").agg(F.sum("n_words").alias("n_words")), "language-words")
    counted = blocks.mapInArrow(tidy(_words), "lang string, phrase binary, n long")
    levels: list[DataFrame] = []
    filters: list[Broadcast] = []
    for size in range(1, longest + 1):
        frequent = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        with batches_of(spark, BLOCKS_AT_ONCE):
            levels.append(materialize(frequent, f"phrases-{size}"))
        rows = levels[-1].count()
        if not rows:
            break
        if size < longest:
            # Each filter goes out once, as a broadcast of its own.
            filters.append(spark.sparkContext.broadcast(_filter_of(levels[-1], size, rows, most_bits)))
            counted = _grown(blocks, list(filters))
    return levels, n_words


def _exact(*factors: Column) -> Column:
    product = F.lit(1).cast("decimal(38,0)")
    for factor in factors:
        product = product * factor.cast("decimal(19,0)")
    return product.cast("decimal(38,0)")


def _weakest_cut(size: int) -> Column:
    """The cut with the lowest score, the first of equal ones: ``score, k, l, r``. Products are decimals of 38 digits."""
    cuts = []
    for k in range(1, size):
        l, r = F.element_at("heads", k), F.element_at("tails", size - k)
        score = F.call_function("div", _exact(F.lit(1000), F.col("f"), F.col("n_words")), _exact(l, r))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    return F.array_min(F.array(*cuts))


def _less(size: int, side: int) -> Column:
    """A phrase of ``size`` words without its last word (``side`` 1) or its first (-1)."""
    return F.substring_index("phrase", " ", side * (size - 1))


def collocations(
    docs: DataFrame, top: int | None = 2000, least: int = LEAST_COUNT, longest: int = LONGEST, lang: str = "lang", text: str = "text",
    block_bytes: int = BLOCK_BYTES, most_bits: int = MOST_BITS,
) -> DataFrame:
    """The best-scored phrases of 2 to ``longest`` words of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase's score is ``1000 * a * n / (l * r)``, rounded down, at the cut into
    two parts where that is lowest: ``a``, ``l`` and ``r`` count the phrase and
    the parts, ``n`` all words of the language. A phrase that lies inside a
    longer one with the same count is left out; a longer one with one more word then has that count, too, so only those are
    looked up.

    Order: score and ``a`` falling, then phrase in byte order; ``top=None`` gives all.
    A-Z are lower-cased; texts are cut into pieces at ``.,;:!?`` and line ends,
    pieces into words at spaces and tabs. Null texts are empty, rows without
    a language belong to ``und``, repeated rows count each time. No rows, or none frequent
    enough, give an empty table. Other columns are not read.
    """
    levels, n_words = frequent_phrases(docs, least, longest, lang, text, block_bytes, most_bits)
    levels = [level.withColumn("phrase", F.col("phrase").cast("string")) for level in levels]
    none = F.array().cast("array<long>")
    known = levels[0].withColumns({"heads": none, "tails": none})
    parts = []
    for size in range(2, len(levels) + 1):
        # The counts of all beginnings and endings, from those of the two phrases of one word less.
        shorter = known.select("lang", F.col("phrase").alias("_part"), F.concat("heads", F.array("f")).alias("_heads"),
                               F.concat("tails", F.array("f")).alias("_tails"))
        known = materialize(
            levels[size - 1].withColumns({"_begin": _less(size, 1), "_end": _less(size, -1)})
            .join(shorter.select("lang", F.col("_part").alias("_begin"), F.col("_heads").alias("heads")), ["lang", "_begin"])
            .join(shorter.select("lang", F.col("_part").alias("_end"), F.col("_tails").alias("tails")), ["lang", "_end"])
            .select("lang", "phrase", "f", "heads", "tails"), f"parts-{size}",
        )
        level = known
        if size < len(levels):
            longer = levels[size]
            around = longer.select("lang", F.explode(F.array(_less(size + 1, 1), _less(size + 1, -1))).alias("phrase"), "f")
            held = around.groupBy("lang", "phrase").agg(F.max("f").alias("_around"))
            level = level.join(held, ["lang", "phrase"], "left").where(F.coalesce("_around", F.lit(0)) < F.col("f"))
        parts.append(level.join(n_words, "lang").select(
            "lang", "phrase", F.col("f").alias("a"), F.col("n_words").alias("n"), _weakest_cut(size).alias("cut"),
        ))
    if not parts:
        cut = F.lit(None).cast("struct<score:bigint,k:int,l:bigint,r:bigint>")
        parts = [levels[0].where("false").select("lang", "phrase", F.col("f").alias("a"), F.col("f").alias("n"), cut.alias("cut"))]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    rows = every.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    if top is not None:
        # First the best of each of 64 slices: a language with most of the phrases is ranked in many tasks.
        slice_no = F.pmod(F.xxhash64("phrase"), F.lit(64))
        best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
        rows = rows.withColumn("_slice", slice_no)
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*best))).where(F.col("_r") <= top)
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
        return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return rows
