"""Language, toxicity and language-model operators: held-out accuracy, brute force, awkward inputs."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.llm import language, lm_score, near_dedup, queries, substring_dedup, toxicity
from colloquy.llm.common import documents

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_languages_on_held_out_documents(spark):
    rows = queries.op6_language(spark, SF).join(documents(spark, SF).select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == documents(spark, SF).count()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0.0 <= r.score <= 1.0 for r in rows) and {r.lang_pred for r in rows} <= {"en", "de", "fr", "es", "und"}


def test_language_edges(spark):
    rows = [(1, "der hund und die katze " * 5, "de"), (2, "the dog and the cat " * 5, "en"), (3, None, "en"), (4, "123 !!", None),
            (5, "", "de"), (None, "the cat and the dog", "en"), (6, "the dog", None), (7, "und die katze " * 50_000, None), (2, "the dog and the cat " * 5, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"draw": F.lit(1), "passage": F.lit("x"), "rank": F.lit(0)})
    model = language.fit_languages(docs)
    got = {r.doc_id: r for r in language.predict_languages(docs, model).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == "und" and got[3].score == 0.0
    assert got[6].lang_pred == got[None].lang_pred == "en" and got[7].lang_pred == "de"
    nothing = language.fit_languages(docs.limit(0))
    assert {r.lang_pred for r in language.predict_languages(docs, nothing).collect()} == {"und"}
    assert language.predict_languages(docs.limit(0), model).count() == 0


def model_truth(rows, order, mass):
    tokens = {i: [w.encode().lower() for w in WORD.findall(t or "")] for i, (_, t, _) in enumerate(rows)}
    counts = Counter()
    for i, (_, _, train) in enumerate(rows):
        if train:
            line = ["<s>", *tokens[i], "</s>"]
            for n in range(1, order + 1):
                counts.update(tuple(line[j:j + n]) for j in range(len(line) - n + 1))
    seen = sum(v for k, v in counts.items() if len(k) == 1 and k != ("<s>",))
    types = sum(1 for k in counts if len(k) == 1 and k != ("<s>",))
    out = {}
    for i, (doc_id, _, train) in enumerate(rows):
        line = ["<s>", *tokens[i], "</s>"]
        base = score = 0.0
        for j in range(1, len(line)):
            p = b = (counts[line[j],] + 0.1) / (seen + 0.1 * (types + 1))
            for n in range(2, min(order, j + 1) + 1):
                gram = tuple(line[j - n + 1:j + 1])
                p = (counts[gram] + mass * p) / (counts[gram[:-1]] + mass)
            base, score = base + math.log10(b), score + math.log10(p)
        out[i] = (doc_id, len(line) - 1, sum(counts[w,] > 0 for w in line[1:]), seen, base, score)
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 2_000)
    rng = random.Random(5)
    rows = [(i, " ".join(f"W{rng.randrange(40)}" for _ in range(rng.randint(0, 60))), i % 4 > 0) for i in range(80)]
    rows += [(90, None, True), (91, "", False), (92, "Ärger ärger unseen", False), (None, "w1 w2", True), (None, "w1 w2", True),
             (93, "w1 " * 20_000, False), (5, rows[5][1], True), (94, "w3", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").withColumns({"key": F.lit(1), "block": F.lit(2)})
    got = lm_score.score_documents(docs, F.col("learn"), order=order, mass=7.0).collect()
    want = sorted(model_truth([(a, b, bool(c)) for a, b, c in rows], order, 7.0).values(), key=lambda r: (str(r[0]), r[1:]))
    have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=lambda r: (str(r[0]), r[1:]))
    assert [r[:4] for r in have] == [r[:4] for r in want]
    assert all(a[4:] == pytest.approx(b[4:], abs=1e-6) for a, b in zip(have, want))


def test_score_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    untrained = {r.doc_id: r for r in lm_score.score_documents(docs, F.lit(False)).collect()}
    assert untrained[1].score == untrained[1].base_score == 0.0 and untrained[1].n_known == 0 and untrained[2].n_tokens == 1
    assert lm_score.score_documents(docs.limit(0), F.lit(True)).count() == 0


def test_model_beats_the_base_on_held_out_documents(spark):
    row = queries.op9_lm_score(spark, SF).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert row.s > row.b


def test_large_ids_beside_null_ids_keep_their_digits(spark):
    big = 2**62 + 1
    docs = spark.createDataFrame([(big, "one two three"), (None, "four five")], "doc_id long, text string").coalesce(1)
    model = language.fit_languages(docs.withColumn("lang", F.lit("en")))
    for df in (
        language.predict_languages(docs, model), lm_score.score_documents(docs, F.lit(True)), near_dedup.near_duplicates(docs),
        substring_dedup.repeated_passages(docs.unionByName(docs.select("doc_id", F.repeat(F.concat("text", F.lit(" word ")), 60).alias("text")))),
    ):
        assert df.schema["doc_id"].dataType.simpleString() == "bigint"
        assert {r.doc_id for r in df.collect()} <= {big, None}


def labelled(spark):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        bad = i % 6 == 0
        words = [f"n{rng.randrange(300)}" for _ in range(rng.randint(20, 60))]
        words += rng.sample(["vile", "nasty", "rotten"], rng.randint(1, 3)) if bad else []
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(bad != (rng.random() < 0.02)), int(i % 5 == 0)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, toxic int, low int")


def test_chain_on_unseen_documents(spark):
    rows, df = labelled(spark)
    labels = df.select("doc_id", F.col("low").alias("low_quality"), "toxic").where("doc_id < 600")
    docs = df.select("doc_id", "text").withColumns({"key": F.lit(1), "words": F.lit("x"), "toxicity": F.lit(2), "label": F.lit(3)})
    chain = toxicity.fit_chain(docs, labels)
    assert [len(w) for w in chain.weights] == [toxicity.SHAPES + len(chain.places) + i for i in range(2)]
    got = {r.doc_id: r.toxicity.toxic for r in toxicity.score_toxicity(docs, chain).collect()}
    bad = {i for i, text, *_ in rows if re.search("vile|nasty|rotten", text)}
    unseen = [i for i in got if i >= 600]
    assert sum((got[i] >= 0.5) == (i in bad) for i in unseen) / len(unseen) > 0.98
    kept = toxicity.drop_toxic(docs, chain)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i] < 0.5}


def test_chain_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "vile"), (3, "word " * 100_000), (3, "word")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (2, None, 0), (None, 1, 1)], "doc_id long, low_quality int, toxic int")
    for some in (labels, labels.limit(0)):
        chain = toxicity.fit_chain(docs, some)
        rows = toxicity.score_toxicity(docs, chain).collect()
        assert len(rows) == 5 and all(0.0 <= p <= 1.0 for r in rows for p in r.toxicity)
    assert toxicity.score_toxicity(docs.limit(0), chain).count() == 0


def test_fit_rows_bound_the_sample(spark):
    _, df = labelled(spark)
    labels = df.select("doc_id", F.col("low").alias("low_quality"), "toxic")
    rows = toxicity.labelled_rows(df.select("doc_id", "text"), labels, toxicity.CATEGORIES, 200, "doc_id", "text")
    assert 140 < rows.count() < 260
