"""Vector compression by product codes: each part of a vector becomes the index of its nearest codebook entry.

Codebooks are refined in rounds. A round needs, for each part position, every
distinct part with the number of vectors that have it. Those are kept sorted, so
a stretch of them is a lexicographic trie: parts with equal first components
stand side by side. The trie is walked depth first; a branch carries the
distances of its prefix to all entries, and each component adds to them once for
all parts below. Leaves take the nearest entry and add their weighted components
to its sum.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors that are coded at once: what a task holds beside its input.
ROWS_AT_ONCE = 4096

Codebooks = list[np.ndarray]


# --- The trie --------------------------------------------------------------------------------

def sorted_distinct(parts: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, the summed weight of each, and the distinct row of every input row."""
    n, width = parts.shape
    weights = np.ones(n, dtype=np.int64) if weights is None else weights
    if not n or not width:
        return parts[:min(n, 1)], np.array([weights.sum()] if n else [], dtype=np.int64), np.zeros(n, dtype=np.int64)
    order = np.lexsort(parts.T[::-1])
    rows = parts[order]
    new = np.ones(n, dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return rows[new], np.add.reduceat(weights[order], np.flatnonzero(new)), place


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of ``book`` and its squared distance, for each of the sorted distinct ``parts``.

    Ties go to the lower index. A node of the trie is a run of rows that share
    their first components; ``along`` holds the distances of that prefix to all
    entries. Children with one row are leaves and finished together; the others
    are visited one after the other, the last one first.
    """
    n, width = parts.shape
    index, distance = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if not n or not len(book):
        return index, distance
    # Component in which a row first differs from the row before it.
    differs = np.full(n + 1, -1, dtype=np.int64)
    if n > 1:
        differs[1:n] = (parts[1:] != parts[:-1]).argmax(axis=1)

    def finish(rows: np.ndarray, depth: int, along: np.ndarray) -> None:
        step = parts[rows, None, depth:] - book[None, :, depth:]
        total = along + np.einsum("nej,nej->ne", step, step)
        best = total.argmin(axis=1)
        index[rows], distance[rows] = best, total[np.arange(len(rows)), best]

    stack = [(0, n, 0, np.zeros(len(book), dtype=np.int64))]
    while stack:
        low, high, depth, along = stack.pop()
        if high - low == 1:
            finish(np.array([low]), depth, along)
            continue
        # A branch without forks is one edge.
        fork = int(differs[low + 1:high].min())
        if fork > depth:
            step = parts[low, None, depth:fork] - book[:, depth:fork]
            along = along + np.einsum("ej,ej->e", step, step)
        starts = np.concatenate(([low], low + 1 + np.flatnonzero(differs[low + 1:high] == fork)))
        ends = np.append(starts[1:], high)
        alone = ends - starts == 1
        if alone.any():
            finish(starts[alone], fork, along)
        for start, end in zip(starts[~alone], ends[~alone]):
            step = parts[start, fork] - book[:, fork]
            stack.append((int(start), int(end), fork + 1, along + step * step))
    return index, distance


def entry_sums(parts: np.ndarray, weights: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed weight and weighted component sums of the parts nearest to each entry."""
    index, _ = nearest(parts, book)
    counts = np.zeros(len(book), dtype=np.int64)
    sums = np.zeros(book.shape, dtype=np.int64)
    np.add.at(counts, index, weights)
    np.add.at(sums, index, parts * weights[:, None])
    return counts, sums


# --- Vectors ---------------------------------------------------------------------------------

def edges(length: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin and end; as equal as can be."""
    return [i * length // parts for i in range(parts + 1)]


def most_component(length: int) -> int:
    """Integer components up to this size keep every squared distance of a vector within 64 bits."""
    return math.isqrt((1 << 62) // max(length, 1)) // 2


def _kept(vector: str) -> Column:
    """Neither null nor with a component that is null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def _codable(vector: Column, length: int, scale: int) -> Column:
    small = F.forall(vector, lambda x: F.abs(x) * scale < float(most_component(length)))
    return (F.size(vector) == length) & small


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    """Rows of a list column of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def _floors(values: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(values.astype(np.float64) * scale).astype(np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def distinct_parts(vectors: DataFrame, length: int, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """``position, part, weight``: the distinct parts of each position, sorted, each with the number of vectors that have it.

    Parts that a batch holds more than once leave it as one row with a weight, so a vector with
    many copies is no burden; a range of the order then meets in one task and
    is written as one sorted run.
    """
    bounds = edges(length, parts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            whole = _floors(_matrix(batch.column(0), length), scale)
            for position in range(parts):
                rows, weights, _ = sorted_distinct(whole[:, bounds[position]:bounds[position + 1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), position, dtype=np.int32)), _lists(rows), pa.array(weights)],
                    names=["position", "part", "weight"],
                )

    found = vectors.select("vector").mapInArrow(cut, "position int, part array<long>, weight long")
    return (
        found.repartitionByRange("position", "part").groupBy("position", "part").agg(F.sum("weight").alias("weight"))
        .sortWithinPartitions("position", "part")
    )


def _lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width or 1, dtype=np.int32) if width else np.zeros(n + 1, dtype=np.int32), pa.array(rows.ravel()))


def _refined(table: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one more round; the driver meets one row per entry."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [(np.zeros(len(b), dtype=np.int64), np.zeros(b.shape, dtype=np.int64)) for b in books]
        for batch in batches:
            position = batch.column("position").to_numpy(zero_copy_only=False)
            weight = batch.column("weight").to_numpy(zero_copy_only=False)
            for p in np.unique(position):
                at = np.flatnonzero(position == p)
                part = _matrix(batch.column("part").take(pa.array(at)), books[p].shape[1]).astype(np.int64)
                # A read task may get several sorted runs: they are one trie only after a sort.
                rows, weights, _ = sorted_distinct(part, weight[at])
                counts, sums = entry_sums(rows, weights, books[p])
                totals[p][0][:] += counts
                totals[p][1][:] += sums
        for p, (counts, sums) in enumerate(totals):
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), p, dtype=np.int32)), pa.array(used.astype(np.int32)),
                 pa.array(counts[used]), _lists(sums[used])],
                names=["position", "entry", "n", "sums"],
            )

    partial = table.mapInArrow(add, "position int, entry int, n long, sums array<long>")
    rows = (
        partial.select("position", "entry", "n", F.posexplode("sums").alias("axis", "total"))
        .groupBy("position", "entry", "axis").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    )
    new = [b.copy() for b in books]
    for row in rows:
        new[row.position][row.entry, row.axis] = row.total // row.n
    return new


def fit_codebooks(
    embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> Codebooks:
    """One codebook per part position, fitted on all vectors that :func:`encode` gives a code.

    The first entries are the parts of the smallest ids (of rows with one id,
    the smallest vector; null ids begin none). Each round assigns every part
    to its nearest entry and replaces an entry by the floor of the mean of its
    parts; an entry without parts stays. With fewer ids than ``entries`` there
    are fewer entries, with no vector at all there are none.
    """
    kept = embeddings.where(_kept(vector)).select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector").alias("n")).first()
    if first is None:
        return [np.zeros((0, 0), dtype=np.int64) for _ in range(parts)]
    length = first.n
    usable = kept.where(_codable(F.col("vector"), length, scale))
    ids = usable.where(F.col("vec_id").isNotNull()).select("vec_id").distinct().orderBy("vec_id").limit(entries)
    starts = usable.join(ids, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").collect()
    begun = _floors(np.array([row.vector for row in starts], dtype=np.float64).reshape(len(starts), length), scale)
    bounds = edges(length, parts)
    books = [np.ascontiguousarray(begun[:, bounds[p]:bounds[p + 1]]) for p in range(parts)]
    if not starts or not length:
        return books
    table = materialize(distinct_parts(usable, length, parts, scale), "vector-parts")
    for _ in range(rounds):
        books = _refined(table, books)
    return books


def books_digest(books: Codebooks) -> str:
    """SHA-256 of all components in decimal, by position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def encode(embeddings: DataFrame, books: Codebooks, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Every row whose vector has only finite components, with ``code`` and ``error``.

    Each part takes the index of its nearest entry, written as two hex digits
    (entries up to 256); ``error`` is the sum of the squared distances.
    Vectors of another length than the codebooks', vectors with components
    too large for exact sums (:func:`most_component`), and all vectors where there is no
    entry keep their row with null in both. Input columns stay; columns named
    ``code`` or ``error`` are replaced. Rows are independent: no shuffle, and ids may be
    null or repeated.
    """
    length, parts = sum(b.shape[1] for b in books), len(books)
    bounds = np.cumsum([0] + [b.shape[1] for b in books])
    other = [c for c in embeddings.columns if c not in ("code", "error")]
    known = F.lit(bool(len(books[0])) if books else False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexed = np.array([f"{i:02x}" for i in range(256)], dtype=object)
        for batch in _batches(batches):
            column = batch.column(batch.num_columns - 1)
            at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            codes, errors = np.full(batch.num_rows, None, dtype=object), np.full(batch.num_rows, None, dtype=object)
            if len(at):
                whole = _floors(_matrix(column.take(pa.array(at)), length), scale)
                text, error = np.full(len(at), "", dtype=object), np.zeros(len(at), dtype=np.int64)
                for p, book in enumerate(books):
                    rows, _, place = sorted_distinct(whole[:, bounds[p]:bounds[p + 1]])
                    index, distance = nearest(rows, book)
                    text = text + hexed[index[place]]
                    error += distance[place]
                codes[at], errors[at] = text, error
            made = [*batch.columns[:-1], pa.array(codes, pa.string()), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=[*other, "code", "error"])

    whole = F.col(vector).cast("array<double>")
    usable = F.when(known & _codable(whole, length, scale), whole)
    rows = embeddings.where(_kept(vector)).select(*other, usable.alias("_vector"))
    schema = rows.drop("_vector").schema.add("code", "string").add("error", "long")
    return rows.mapInArrow(run, schema)


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Add ``label_error``: the errors summed over rows with an equal label, rows without a label together.

    The sums are written before the rows meet them, so that Spark can split the join where one label has most rows.
    """
    sums = materialize(
        coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors",
    )
    return coded.drop("label_error").join(sums, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
