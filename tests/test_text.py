import hashlib
import re
import string

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as T

SAMPLES = [
    "- hi", "  Hello,   WORLD! ", "", "   ", "i’m don't", "Été déjà, ça va? ²", "a\tb\nc", "x_y 1,000.5",
    " no-break  space ", "tabs\t\tand  spaces", "!?!", "Go. For now. For now.",
]


def py_normalize(t):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", t.lower().strip()))


def py_strict(t):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", t.lower())).strip()


def py_audit_tokens(t):
    return re.sub(r"[^\w\s']", " ", t.lower()).split()


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SAMPLES)], "i int, t string")
    tokens = T.model_tokens("t")
    return df.select(
        "i", T.normalize("t").alias("norm"), T.normalize_strict("t").alias("strict"),
        T.audit_tokens("t").alias("audit"), T.word_count("t").alias("wc"), T.char_count("t").alias("cc"),
        T.punctuation_count("t").alias("pc"), T.token_set("t").alias("ts"), tokens.alias("mt"),
        T.ngrams_1_2(tokens).alias("ng"), T.strip("t").alias("strip"), T.is_blank("t").alias("blank"),
        T.hash_mod(F.col("t"), 2).alias("m2"), T.hash_mod(F.col("t"), 1000003).alias("mbig"),
    ).orderBy("i").collect()


@pytest.mark.parametrize("i", range(len(SAMPLES)))
def test_matches_python(got, i):
    t, row = SAMPLES[i], got[i]
    big = int(hashlib.sha256(t.encode()).hexdigest(), 16)
    tokens = re.findall(r"\b\w\w+\b", t.lower())
    assert row.norm == py_normalize(t)
    assert row.strict == py_strict(t)
    assert row.audit == py_audit_tokens(t)
    assert row.wc == len(t.split())
    assert row.cc == len(t)
    assert row.pc == sum(c in string.punctuation for c in t)
    assert sorted(row.ts) == sorted(set(t.lower().split()))
    assert row.mt == tokens
    assert row.ng == tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]
    assert row.strip == t.strip()
    assert row.blank == (t.strip() == "")
    assert (row.m2, row.mbig) == (big % 2, big % 1000003)


def test_leading_dash_differs_between_normalizers(got):
    assert got[0].norm == " hi" and got[0].strict == "hi"


def test_strip_reasoning(spark):
    texts = ["<think>hidden</think>Visible response", "<THINK>a\nb</think>\n ok ", "<think>open", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.strip_reasoning("t")).collect()] == ["Visible response", "ok", "<think>open", None]


def test_quality_gate(spark):
    df = spark.createDataFrame([("Hi ", "hi"), ("", "x"), (None, "x"), ("ok", "x"), ("ok", None)], "r string, m string")
    assert [r[0] for r in df.select(T.passes_quality_gate("r", "m")).collect()] == [False, False, False, True, True]


def test_repeated_tail(spark):
    texts = ["Go. For now. For now. For now.", "One. Two.", "", "A. A. B.", "Same! Same!"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", T.sentences("t"))
    df = df.withColumn("run", T.tail_run(F.col("p")))
    rows = df.select("run", T.repaired_tail(F.col("p"), F.col("run")).alias("fixed")).collect()
    assert [r.run for r in rows] == [3, 1, 0, 1, 2]
    assert [r.fixed for r in rows] == ["Go. For now.", "One. Two.", "", "A. A. B.", "Same!"]
