import math
import random
from collections import Counter
from difflib import SequenceMatcher
import re

import pytest

from colloquy.operators import similarity as S
from colloquy.sources import derived as D
from pyspark.sql import functions as F

WORDS = "the of and a feel sad happy today work home never always river stone light dark why can you".split()


def brute_tfidf(queries, bank):
    def grams(t):
        w = re.findall(r"\b\w\w+\b", t.lower())
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    docs = [grams(b) for b in bank]
    df = Counter(t for d in docs for t in d)
    idf = {t: math.log((1 + len(bank)) / (1 + n)) + 1 for t, n in df.items()}

    def unit(g):
        v = {t: n * idf[t] for t, n in g.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    vectors = [unit(d) for d in docs]
    return [[sum(w * v.get(t, 0.0) for t, w in unit(grams(q)).items()) for v in vectors] for q in queries]


def brute_jaccard(queries, bank):
    def score(a, b):
        a, b = set(a.lower().split()), set(b.lower().split())
        return len(a & b) / len(a | b) if a | b else 0.0

    return [[score(q, b) for b in bank] for q in queries]


def brute_chars(queries, bank):
    return [[SequenceMatcher(None, q.lower(), b.lower()).ratio() for b in bank] for q in queries]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)

    def sentence(n):
        # Two words are in almost every text.
        return " ".join(["the", "of"] + [rng.choice(WORDS) for _ in range(n)])

    bank = [sentence(rng.randint(1, 9)) for _ in range(50)]
    bank += [bank[3]] * 25 + [bank[7].upper()] * 5
    queries = [sentence(rng.randint(1, 8)) for _ in range(40)]
    queries += [bank[3]] * 30 + [bank[10], "zzz qqq flibbertigibbet", "", "the", "of the", "a"]
    return queries, bank


@pytest.mark.parametrize("measure, brute", [
    (S.tfidf_best, brute_tfidf), (S.jaccard_best, brute_jaccard),
])
def test_best_equals_all_pairs(spark, texts, measure, brute):
    queries, bank = texts
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
    b = spark.createDataFrame(list(enumerate(bank)), "bank_pos long, text string")
    got = {r.query_id: (r.bank_pos, r.score) for r in measure(q, b).collect()}
    assert len(got) == len(queries)
    for i, scores in enumerate(brute(queries, bank)):
        rounded = [round(s, 10) for s in scores]
        best = max(rounded)
        assert got[i][1] == pytest.approx(best, abs=1e-9), (i, queries[i])
        assert got[i][0] == rounded.index(best), (i, queries[i])


def _char_texts():
    rng = random.Random(12)
    bank = ["".join(rng.choices("abcde ", k=rng.randint(0, 40))) for _ in range(60)] + ["", "a", "ab", "abc", "abab", "x" * 30]
    # From 200 characters on the common ones start no match.
    bank += [" ".join(rng.choices(WORDS, k=50)) + "qz"[i % 2] for i in range(6)]
    queries = []
    for text in bank:
        for edits in (rng.randint(0, 3), rng.randint(0, 3), len(text) // 3, len(text)):
            chars = list(text)
            for _ in range(edits):
                at = rng.randrange(len(chars) + 1)
                chars[at:at + rng.randint(0, 1)] = rng.choices("abcde", k=rng.randint(0, 2))
            queries.append("".join(chars))
    return queries + ["qqzz", "zebra", "ZZZ", "", "0123", "abc" * 40], bank


@pytest.mark.parametrize("slice_chars", [1 << 14, 150])
def test_characters_equal_all_pairs(spark, monkeypatch, slice_chars):
    monkeypatch.setattr(S, "SLICE_CHARS", slice_chars)
    queries, bank = _char_texts()
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
    b = spark.createDataFrame(list(enumerate(bank)), "bank_pos long, text string")
    got = {r.query_id: (r.bank_pos, r.score) for r in S.char_best(q, b).collect()}
    assert len(got) == len(queries)
    levels = set()
    for i, scores in enumerate(brute_chars(queries, bank)):
        rounded = [round(x, 10) for x in scores]
        assert got[i] == (rounded.index(max(rounded)), pytest.approx(max(rounded), abs=1e-9)), queries[i]
        levels.add(int(10 * max(rounded)))
    assert min(levels) == 0 and len(levels & {1, 2, 3}) > 1 and levels >= {4, 5, 6, 7, 8, 9, 10}


def test_character_sweep_equals_all_pairs(spark, sf):
    asked, stored = D.bank_queries(spark, sf), D.bank(spark, sf)
    rows, bank = asked.collect(), sorted(stored.collect(), key=lambda r: r.bank_pos)
    best = []
    for row, scores in zip(rows, brute_chars([r.text for r in rows], [r.text for r in bank])):
        rounded = [round(x, 10) for x in scores]
        best.append((max(rounded), bank[rounded.index(max(rounded))].label == row.label))
    scored = S.char_best(asked, stored)
    for row in S.threshold_sweep(scored, stored).collect():
        hits = [right for score, right in best if score >= row.threshold]
        assert (row.n_matched, row.unmatched_rate) == (len(hits), round(1 - len(hits) / len(best), 4))
        assert row.match_accuracy == (round(sum(hits) / len(hits), 4) if hits else None)
    stats = S.best_score_stats(scored).first()
    scores = [s for s, _ in best]
    assert stats.mean_best_score == pytest.approx(sum(scores) / len(scores), abs=1e-4) and stats.min_best_score == round(min(scores), 4)


def _candidates(spark, queries, bank):
    asked = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(queries)], "qid long, qtext string, q int")
    stored = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(bank)], "bid long, btext string, b int")
    return S.char_candidates(asked, stored).count()


def test_few_pairs_are_compared(spark):
    sf = "/root/testdata/sf0.1"
    queries, bank = ([r.text.lower() for r in side(spark, sf).collect()] for side in (D.bank_queries, D.bank))
    assert _candidates(spark, queries, bank) < 0.05 * len(queries) * len(bank)
    rng = random.Random(2)
    short = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(2000)] for _ in range(2)]
    assert _candidates(spark, *short) < 4000
    comparer = S.Comparer(list(range(2000)), short[1])
    for text, shared in zip(short[0][:50], S.overlaps(short[0][:50], short[1])):
        want = max(round(SequenceMatcher(None, text, b).ratio(), 10) for b in short[1])
        assert comparer.best(text, shared, 0.0, 0.0, 2.0)[0] == want
    # The bounds leave a small part of the pairs.
    assert comparer.compared < 0.05 * 50 * 2000


def test_sweep_and_choice(spark):
    scored = spark.createDataFrame([(1, "a", 0, 0.95), (2, "a", 1, 0.55), (3, "b", 1, 0.30), (4, "b", 0, 0.0)],
                                   "query_id long, label string, bank_pos long, score double")
    bank = spark.createDataFrame([(0, "a"), (1, "b")], "bank_pos long, label string")
    sweep = S.threshold_sweep(scored, bank)
    got = {r.threshold: tuple(r)[1:] for r in sweep.collect()}
    assert len(got) == 14
    assert got[0.3] == (3, 0.6667, 0.25, 0.25) and got[0.35] == (2, 0.5, 0.25, 0.5) and got[0.95] == (1, 1.0, 0.0, 0.75)
    matched = [got[t][0] for t in sorted(got)]
    assert matched == sorted(matched, reverse=True)
    assert S.choose_threshold(sweep).first().threshold == 0.3
    none = S.threshold_sweep(scored.withColumn("score", scored.score * 0), bank).where("threshold = 0.5").first()
    assert tuple(none)[1:] == (0, None, None, 1.0)
    stats = S.best_score_stats(scored).first()
    assert (stats.min_best_score, stats.max_best_score) == (0.0, 0.95)


def test_no_all_pairs_in_the_plan(spark, texts):
    q = spark.createDataFrame(list(enumerate(texts[0])), "query_id long, text string")
    b = spark.createDataFrame(list(enumerate(texts[1])), "bank_pos long, text string")
    for measure in (S.tfidf_best, S.jaccard_best, S.char_best):
        plan = measure(q, b)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_queries_without_text_and_empty_banks_keep_their_rows(spark):
    asked = spark.createDataFrame([(1, None, "a"), (2, "red fox", "a")], "query_id long, text string, label string")
    bank = spark.createDataFrame([(1, "red fox jumps", "a", "r"), (2, None, "b", "s")], "bank_pos long, text string, label string, reply string")
    for best in (S.tfidf_best, S.jaccard_best, S.char_best):
        got = {r.query_id: r for r in best(asked, bank).collect()}
        # By characters a missing text equals a missing text; the other measures see nothing shared.
        assert got[1].score == (1.0 if best is S.char_best else 0.0) and got[2].score > 0 and got[2].bank_pos == 1
        none = S.best_match(best(asked, bank.limit(0)), bank.limit(0), 0.6).collect()
        assert len(none) == 2 and not any(r.matched for r in none)


def test_common_words_read_blocks_not_whole_lists(spark, monkeypatch):
    """All texts are made of ten words; a list of one word holds most of the bank."""
    rng = random.Random(1)
    words = "the of and you to it is in that for".split()
    bank, asked = ([" ".join(rng.choice(words) for _ in range(rng.randint(3, 12))) for _ in range(n)] for n in (900, 60))
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    b = spark.createDataFrame(list(enumerate(bank)), "bank_pos long, text string")
    met, plain = [], S._met
    monkeypatch.setattr(S, "_met", lambda *a: met.append(plain(*a)) or met[0])
    got = {r.query_id: (r.bank_pos, r.score) for r in S.tfidf_best(q, b).collect()}
    for i, scores in enumerate(brute_tfidf(asked, bank)):
        rounded = [round(s, 10) for s in scores]
        assert got[i][1] == pytest.approx(max(rounded), abs=1e-9) and got[i][0] == rounded.index(max(rounded))
    assert met[0].count() < 0.45 * len(set(asked)) * len(set(bank))
