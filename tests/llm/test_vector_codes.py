"""Product codes against brute force on whole results; the trie against plain distances."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def _fit(rows, parts, entries, rounds):
    """Plain loops over all vectors and entries."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [[math.floor(float(np.float32(x)) * 4096) for x in r[1]] for r in kept]
    cut = [[w[p * len(w) // parts:(p + 1) * len(w) // parts] for p in range(parts)] for w in whole]
    first = {}
    for r, c in sorted(zip(kept, cut), key=lambda x: ((x[0][0] is None, x[0][0] or 0), [float(np.float32(v)) for v in x[0][1]])):
        if r[0] is not None:
            first.setdefault(r[0], c)
    books = [[list(c[p]) for c in list(first.values())[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = defaultdict(list)
            for c in cut:
                own[near(c[p], book)[1]].append(c[p])
            books[p] = [[sum(x) // len(own[i]) for x in zip(*own[i])] if own[i] else e for i, e in enumerate(book)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    return books, [(r[0], r[2], "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f)) for r, f in zip(kept, found)]


def _rows(seed, n, width):
    rng = random.Random(seed)
    grid = [-1.5, -0.25, 0.0, 1e-5, -1e-5, 0.125, 0.7, 3.0]
    rows = [(i, [rng.choice(grid) if rng.random() < 0.8 else rng.uniform(-1, 1) for _ in range(width)], rng.choice([1, 2, None])) for i in range(n)]
    rows += [(n + i, rows[4][1], 7) for i in range(n)]
    rows += [(3, rows[2][1], 1), (3, rows[3][1], 1), (None, rows[1][1], None), (None, None, 4), (-5, None, 1), (-6, [None] * width, 2),
             (-7, [float("nan")] * width, 1), (-8, [float("inf")] + [0.0] * (width - 1), 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width, parts, entries, rounds, n", [(16, 8, 16, 6, 120), (10, 4, 5, 3, 60), (8, 8, 16, 2, 5), (24, 2, 3, 0, 40)])
def test_equal_to_brute_force(spark, width, parts, entries, rounds, n):
    rows = _rows(n, n, width)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({"code": F.lit(3), "part": F.lit("x"), "weight": F.lit(2)})
    books = V.fit_codebooks(frame, parts, entries, rounds)
    want_books, want = _fit(rows, parts, entries, rounds)
    assert [b.tolist() for b in books] == want_books
    coded = V.encode(frame, books)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in coded.select("vec_id", "label", "code", "error").collect()), key=key) == sorted(want, key=key)
    sums = defaultdict(int)
    for _, label, _, error in want:
        sums[label] += error
    assert {(r.label, r.label_error) for r in V.with_label_error(coded).collect()} == set(sums.items())
    text = ",".join(str(x) for b in want_books for e in b for x in e)
    assert V.books_digest(books) == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("spread", [2, 5, 4000])
def test_trie(spread):
    rng = np.random.default_rng(spread)
    parts = rng.integers(-spread, spread, (3000, 6))
    weights = rng.integers(1, 9, 3000)
    book = rng.integers(-spread, spread, (16, 6))
    rows, summed, place = V.sorted_distinct(parts, weights)
    assert (rows[place] == parts).all() and summed.sum() == weights.sum()
    assert rows.tolist() == sorted(set(map(tuple, parts.tolist())), key=tuple) or rows.tolist() == [list(x) for x in sorted(set(map(tuple, parts.tolist())))]
    index, distance = V.nearest(rows, book)
    plain = ((rows[:, None, :] - book[None]) ** 2).sum(-1)
    assert (index == plain.argmin(1)).all() and (distance == plain.min(1)).all()
    counts, sums = V.entry_sums(rows, summed, book)
    for e in range(16):
        assert counts[e] == summed[index == e].sum() and (sums[e] == (rows * summed[:, None])[index == e].sum(0)).all()


def test_vectors_without_a_code(spark):
    rows = [(1, [0.5] * 8, 1), (2, [0.25] * 7, 1), (3, [], 1), (4, [3e38] * 8, None), (5, [0.25] * 8, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    books = V.fit_codebooks(frame)
    got = {r.vec_id: (r.code, r.error) for r in V.encode(frame, books).collect()}
    assert got == {1: ("00" * 8, 0), 2: (None, None), 3: (None, None), 4: (None, None), 5: ("01" * 8, 0)}
    assert {r.label: r.label_error for r in V.with_label_error(V.encode(frame, books)).collect()} == {1: 0, None: 0}


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1)], [(1, [None], 1)], [(None, [1.0] * 8, 1)]):
        frame = spark.createDataFrame(rows, SCHEMA)
        books = V.fit_codebooks(frame)
        coded = V.with_label_error(V.encode(frame, books)).collect()
        assert [r.code for r in coded] == [None] * (rows[:1] == [(None, [1.0] * 8, 1)])
    empty = spark.createDataFrame([(1, [], 1)], SCHEMA)
    assert [(r.code, r.error) for r in V.encode(empty, V.fit_codebooks(empty)).collect()] == [("00" * 8, 0)]
