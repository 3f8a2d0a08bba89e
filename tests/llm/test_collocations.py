"""Phrases against brute force: counts, cuts, what is dropped, order; tiles against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import collocations as C

DOCS = "doc_id long, text string, lang string"


def _brute(rows, least, longest, top):
    counts, words = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, found in counts.items():
        frequent = {p: f for p, f in found.items() if f >= least}
        rows = []
        for p, a in frequent.items():
            if len(p) < 2:
                continue
            inside = (q for q, f in frequent.items() if len(q) > len(p) and f >= a)
            if any(q[i:i + len(p)] == p for q in inside for i in range(len(q) - len(p) + 1)):
                continue
            cut = min((1000 * a * words[lang] // (frequent[p[:k]] * frequent[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-cut[0], -a, " ".join(p).encode(), frequent[p[:cut[1]]], frequent[p[cut[1]:]]))
        rows.sort()
        out += [(lang, i, p.decode(), -a, l, r, words[lang], -s) for i, (s, a, p, l, r) in enumerate(rows[:top], 1)]
    return sorted(out)


def _rows(seed):
    rng = random.Random(seed)
    vocabulary = ["of", "The", "new", "york", "CITY", "\u00c9t\u00e9", "a\u00a0b", "x\x1cy", "state", "\U0001f600", "in", "at"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randrange(0, 60)):
            words += rng.choice([["new", "York", "city", "of"], ["New", "york"], [rng.choice(vocabulary)], [rng.choice(vocabulary)]])
        ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!", "; ", "\x0b", "? "]
        text = "".join(w + rng.choice(ends) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "en", None, "und", "d\u00e9"])))
    return rows + [(1, None, "en"), (2, "", None), (2, "", None), (None, "new york city", "en"), (None, "new york city", "en"), (9, " .,\n ", "zz")]


@pytest.mark.parametrize("least, longest, top, block", [(4, 5, 2000, 1 << 24), (7, 5, 20, 3000), (3, 3, 5, 1), (1, 2, 4000, 500)])
def test_equal_to_brute_force(spark, least, longest, top, block):
    rows = _rows(least)
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({"phrase": F.lit(1), "block": F.lit("x"), "n": F.lit(None).cast("int")})
    got = C.collocations(docs, top, least, longest, block_bytes=block)
    assert sorted(tuple(r) for r in got.collect()) == _brute(rows, least, longest, top)


def test_full_filters_change_nothing(spark):
    rows = _rows(11)
    docs = spark.createDataFrame(rows, DOCS)
    got = C.collocations(docs, None, 4, 4, most_bits=1 << 16).drop("rank")
    assert sorted(tuple(r) for r in got.collect()) == sorted(r[:1] + r[2:] for r in _brute(rows, 4, 4, 10**6))


def test_long_text_and_hot_phrase(spark):
    rows = [(1, "alpha beta " * 150_000 + "w" * 3_000_000, "en")] + [(i, "alpha beta gamma", "en") for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(tuple(r) for r in C.collocations(docs).collect()) == _brute(rows, 100, 5, 2000)


def test_nothing_frequent(spark):
    docs = spark.createDataFrame([(1, "a b c", "en")], DOCS)
    for few in (docs, docs.limit(0), spark.createDataFrame([(1, None, None)], DOCS)):
        got = C.collocations(few)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.count() == 0


@pytest.mark.parametrize("tile, dense", [(4, 3), (512, 1), (3, 10**9), (1, 2)])
def test_tiles(tile, dense):
    rng = np.random.default_rng(tile)
    ids = np.minimum(rng.geometric(0.1, 5000) - 2, 60)
    a, b, n = C.count_pairs(ids, tile, dense)
    want = Counter((int(x), int(y)) for x, y in zip(ids[:-1], ids[1:]) if x >= 0 and y >= 0)
    assert Counter(dict(zip(zip(a.tolist(), b.tolist()), n.tolist()))) == want and len(a) == len(want)
    assert [len(x) for x in C.count_pairs(np.array([3, -1, 4]))] == [0, 0, 0] == [len(x) for x in C.count_pairs(np.zeros(0, np.int64))]


def test_compacted_sequences_keep_their_pairs():
    ids = np.array([-1, -1, 5, -1, 3, 4, -1, -1, -1, 7, 8, 9, -1, 2])
    assert C.compact(ids).tolist() == [-1, 3, 4, -1, 7, 8, 9, -1]
    assert C.compact(np.zeros(0, np.int64)).tolist() == []


def test_few_texts_and_blocks_reach_a_worker_at_once(spark, monkeypatch):
    """With Spark's own 10,000 rows a task would hold all of its blocks, and a Python worker with it."""
    setting, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, C.materialize
    before = spark.conf.get(setting)

    def recorded(df, name):
        seen[name] = int(spark.conf.get(setting))
        return write(df, name)

    monkeypatch.setattr(C, "materialize", recorded)
    docs = spark.createDataFrame([(i, "new york city", "en") for i in range(9)], DOCS)
    levels, _ = C.frequent_phrases(docs, 5, 3)
    assert [level.count() for level in levels] == [3, 2, 1]
    assert seen["word-blocks"] <= C.TEXTS_AT_ONCE < 10000
    assert all(seen[f"phrases-{size}"] <= C.BLOCKS_AT_ONCE < 10 for size in (1, 2, 3))
    assert spark.conf.get(setting) == before
