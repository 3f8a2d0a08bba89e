"""Exact dedup, mixing and licences against brute force, with the awkward inputs."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from colloquy.llm import exact_dedup, licenses, mixing

DOCS = "doc_id long, text string, source string, n_chars long"
ROWS = [
    (1, "same text", "a", 9), (7, "same text", "b", 9), (5, "same text", None, 9), (2, None, "a", None), (3, "", "a", 0),
    (4, "x" * 300 + "y", "b", 301), (6, "x" * 300 + "z", "b", 301), (None, "same text", "a", 9), (8, "only", None, 4),
    (8, "only", None, 4), (9, "é", "c", 1), (10, "ab", "c", 2),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def test_exact_groups(docs):
    clash = docs.withColumns({"length": F.lit(1), "head": F.lit(2), "digest": F.lit("x"), "keep_id": F.lit(0)})
    got = Counter(tuple(r) for r in exact_dedup.exact_dedup(clash).collect())
    groups = defaultdict(list)
    for doc_id, text, *_ in ROWS:
        groups[text or ""].append(doc_id)
    want = Counter()
    for text, ids in groups.items():
        keep = max(i for i in ids if i is not None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        want.update((i, keep, len(ids), i == keep, digest) for i in ids)
    assert got == want


def test_exact_dedup_of_nothing(docs):
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def _times(u, rate):
    total, k, p = math.exp(-rate), 0, math.exp(-rate)
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_mixing_inverts_the_distribution(docs):
    clash = docs.withColumns({"copy_no": F.lit("x"), "shuffle_key": F.lit("y"), "times": F.lit(3)})
    out = mixing.mix_sources(clash, {"a": 2.0, "b": 1.0, None: 1.0}, total_repetitions=2.0, seed=5)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "times", "copy_no", "shuffle_key"]
    n = Counter(source for _, _, source, _ in ROWS)
    rate = {s: 2.0 * len(ROWS) * w / 4.0 / n[s] for s, w in {"a": 2.0, "b": 1.0, None: 1.0}.items()} | {"c": 0.0}
    want = Counter()
    for doc_id, text, source, _ in ROWS:
        name = str(doc_id) if doc_id is not None else hashlib.md5(text.encode()).hexdigest()
        u = int(hashlib.md5(f"{name}|5".encode()).hexdigest()[:13], 16) / 2**52
        want.update({(doc_id, text): _times(u, rate[source])})
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == +want
    keys = [r.shuffle_key for r in rows]
    assert keys == sorted(keys) and {r.copy_no for r in rows if r.doc_id == 8} <= set(range(1, 99))


def test_mixing_reaches_shares(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"),
                                      F.when(F.col("id") % 10 == 0, "few").otherwise("many").alias("source"))
    n = {r.source: r["count"] for r in mixing.mix_sources(docs, shuffled=False).groupBy("source").count().collect()}
    assert abs(n["few"] / sum(n.values()) - 0.5) < 0.02
    again = mixing.mix_sources(docs, shuffled=False)
    assert again.exceptAll(mixing.mix_sources(docs, shuffled=False)).count() == 0


def test_mixing_edges(docs, spark):
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs, {"nowhere": 1.0}).count() == 0
    one = spark.createDataFrame([(1, "t", "a")], "doc_id long, text string, source string")
    assert abs(mixing.mix_sources(one, total_repetitions=2000.0).count() - 2000) < 400


GRANT, NOTICE, WARRANTY = (licenses.SENTENCES[f"mit.{x}"] for x in ("grant", "notice", "warranty"))


def test_steps_of_small_and_large_means(spark):
    """Against sums of the density; past 32 deviations' room the steps begin near the mean."""
    means = [0.0, 0.5, 30.0, 269.0, 300.0, 5000.0, 1e6, 1e8]
    rates = spark.createDataFrame([(str(m), m) for m in means] + [(None, 2.0)], "_source string, _rate double")
    got = {r["_source"]: r for r in mixing.poisson_steps(rates).collect()}
    assert len(got) == len(means) + 1 and got["0.0"]["_steps"] == [1.0]
    for m in means[1:]:
        row = got[str(m)]
        assert len(row["_steps"]) < 25 * math.sqrt(m) + 60 and abs(row["_steps"][-1] - 1) < 1e-6
        if m > 5000:
            middle = row["_steps"][int(m) - row["_first"]]
            assert abs(middle - 0.5 - 2 / (3 * math.sqrt(2 * math.pi * m))) < 1e-6
            continue
        total = 0.0
        for k in range(row["_first"] + len(row["_steps"])):
            total += math.exp(k * math.log(m) - m - math.lgamma(k + 1))
            if k >= row["_first"]:
                assert abs(total - row["_steps"][k - row["_first"]]) < 1e-10


def test_one_document_repeated_a_million_times(spark):
    one = spark.createDataFrame([(1, "a", "rare")], "doc_id long, text string, source string")
    row = mixing.mix_sources(one, total_repetitions=1e6, shuffled=False).selectExpr(
        "count(*) AS n", "max(copy_no) AS last", "count(DISTINCT copy_no) AS copies").first()
    assert row.n == row.last == row.copies and abs(row.n - 1e6) < 6000


def test_licences_by_order(spark):
    rows = [
        (1, f"Intro.\n{GRANT}:\n{NOTICE.capitalize()}. Something else!\n{WARRANTY}.", "MIT", 3),
        (2, f"{WARRANTY}. {NOTICE}. {GRANT}.", "", 3),
        (3, "Text.\nLicensed under the Apache License, Version 2.0.", "Apache-2.0", 1),
        (4, "All rights reserved.\nRELEASED under the MIT License!", "MIT,Proprietary", 2),
        (5, None, "", 0), (6, "", "", 0), (7, "word. " * 30_000 + "All rights reserved.", "Proprietary", 1),
        (None, "All rights reserved.", "Proprietary", 1), (None, "nothing", "", 0), (8, "x", "", 0), (8, "x", "", 0),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumns(
        {"sentence": F.lit("mit license"), "key": F.lit(1), "found": F.lit(2)}
    )
    got = Counter((r.doc_id, r.licenses, r.n_sentences) for r in licenses.scan_licenses(docs).collect())
    assert got == Counter({(i, name, n) for i, _, name, n in rows})
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_no_python_on_the_main_path(docs):
    for df in (exact_dedup.exact_dedup(docs), mixing.mix_sources(docs), licenses.scan_licenses(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


MIT = '''The MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY.
'''
GPL = '''This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
'''
APACHE = '''Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
'''


def _commented(text, sign):
    return "".join(f"{sign} {line}".rstrip() + "\n" for line in text.splitlines())


def test_wrapped_licences(spark):
    rows = [
        (1, MIT, "MIT", "mit.grant,mit.notice,mit.warranty"), (2, GPL, "GPL-3.0-or-later", "gpl.free,gpl.hope,gpl.see"),
        (3, APACHE, "Apache-2.0", "apache.header,apache.use,apache.obtain,apache.basis"),
        (4, "/*\n" + _commented(APACHE, " *") + " */\nint x;", "Apache-2.0", "apache.header,apache.use,apache.obtain,apache.basis"),
        (5, _commented(GPL, "#") + "|#|", "GPL-3.0-or-later", "gpl.free,gpl.hope,gpl.see"),
        (6, MIT.replace("\n", "\r\n"), "MIT", "mit.grant,mit.notice,mit.warranty"),
        (7, " ".join(GPL.split()), "GPL-3.0-or-later", "gpl.free,gpl.hope,gpl.see"),
        (8, "MIT\n\nLicense. All rights.\nReserved", "", ""), (9, "Not all rights\nreserved", "", ""),
        (10, "Notice:\nlicensed under the Apache License, Version 2.0\n(the \"License\"); all rights\nreserved", "Apache-2.0,Proprietary",
         "apache.licensed,apache.header,rights"),
        (11, "MIT License\nreleased under\nthe MIT License\nin 2020", "MIT", "mit.name,mit.released"),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {(r.doc_id, r.licenses, r.sentence_ids) for r in licenses.scan_licenses(docs).collect()}
    assert got == {(i, names, ids) for i, _, names, ids in rows}
