"""Decontamination, line dedup, repeated passages and near duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.llm import decontaminate, line_dedup, near_dedup, substring_dedup
from colloquy.llm.common import stable_hash
from colloquy.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def distance(a, b, anchored):
    row = list(range(len(b) + 1)) if anchored else [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


@pytest.mark.parametrize("anchored", [False, True])
def test_myers_equals_the_full_table(anchored):
    rng = random.Random(4)
    for _ in range(400):
        a, b = ("".join(rng.choices("abc", k=rng.randint(1, 14))) for _ in range(2))
        row = distance(a, b, anchored)[1:]
        assert decontaminate.myers(a, b, 99, anchored) == (min(row), row.index(min(row)) + 1)


def test_leaks(spark):
    rng = random.Random(1)
    item = " ".join(words(rng, 30))
    edited = item[:40] + "#" + item[42:90] + item[91:]
    broken = "".join(ch if i % 9 else "#" for i, ch in enumerate(item))
    rows = [
        (1, f"Before.\n{item.upper()} after"), (2, f"x {edited} y"), (3, broken), (4, None), (5, ""), (6, "short"),
        (7, " ".join(words(rng, 60_000)) + f" {item}"), (None, item), (8, item), (8, item),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit(1), "leak": F.lit(2)})
    items = spark.createDataFrame([(10, item), (11, None), (12, "  "), (13, " ".join(words(rng, 20)))], "item_id long, text string")
    found = decontaminate.find_leaks(docs, items).collect()
    assert Counter(r.doc_id for r in found) == Counter([1, 2, 7, None, 8, 8]) and {r.item_id for r in found} == {10}
    by = {r.doc_id: r for r in found}
    assert by[1].distance == 0 and by[1].end - by[1].start == len(item) and by[2].distance == min(distance(item, edited, False))
    kept = decontaminate.drop_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    many = decontaminate.find_leaks(docs, items, block_chars=50).collect()
    assert Counter(map(tuple, many)) == Counter(map(tuple, found))
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0


def line_truth(rows, min_chars=40, min_docs=5):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").encode().lower()

    held = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line).decode()) >= min_chars:
                held[key(line)].add(doc_id)
    keeper = {k: max(-1 if d is None else d for d in v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == doc_id]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("most_bits", [2**20, 2**10])
def test_line_dedup(spark, most_bits, monkeypatch):
    monkeypatch.setattr(line_dedup, "LEAST_BITS", min(line_dedup.LEAST_BITS, most_bits))
    rng = random.Random(2)
    common = [" ".join(words(rng, 12)) for _ in range(6)]
    accents = "é" * 39
    rows = []
    for i in range(60):
        lines = [" ".join(words(rng, rng.randint(1, 14))) for _ in range(rng.randint(1, 6))]
        lines += [("  " + c.upper() + "\t") if i % 2 else c for c in rng.sample(common, rng.randint(0, 3))]
        lines += [accents, accents + "é"] if i % 7 == 0 else []
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, common[0]), (None, common[0] + "\n" + common[1]), (5, rows[5][1]),
             (103, "\n".join([common[0]] * 3000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_dropped": F.lit("x"), "key": F.lit(1)})
    got = line_dedup.dedup_lines(docs.repartition(5), most_bits=most_bits)
    assert got.columns == ["doc_id", "text", "key", "n_lines", "n_dropped"]
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == line_truth(rows)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def shingle_set(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_truth(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        known = [x for x in ids[find(i)] if x is not None]
        name = min(known) if known and sets[i] else doc_id
        out.append((doc_id, len(sets[i]), name, doc_id == name))
    return Counter(out)


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def near_rows():
    """A tight group with many borderline pairs, short texts, copies, a common passage, and the awkward rows."""
    rng = random.Random(3)
    base, passage = words(rng, 120), words(rng, 40)
    rows = [(i, " ".join(edited(rng, base, rng.randint(0, 7)))) for i in range(90)]
    rows += [(200 + i, " ".join(passage + words(rng, 60))) for i in range(30)]
    rows += [(300 + i, " ".join(base[: rng.randint(80, 120)])) for i in range(12)]
    rows += [(400, None), (401, ""), (402, "  \n"), (403, "one two"), (404, "ONE\ttwo"), (405, "one two three four five"),
             (None, rows[0][1]), (None, "alone here with no id at all"), (406, rows[1][1]), (406, rows[1][1]), (406, "other text under the id"),
             (407, " ".join(words(rng, 30_000)))]
    return rows


def test_near_duplicates(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "n": F.lit(2), "keys": F.lit("x")})
    got = near_dedup.near_duplicates(docs.repartition(3))
    assert Counter(tuple(r) for r in got.collect()) == near_truth(rows)
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = sum(n for (doc_id, _, name, _), n in near_truth(rows).items() if doc_id == name)
    assert kept.count() == want
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_signature_agreement_estimates_similarity():
    rng = random.Random(9)
    base = words(rng, 400)
    a, b = near_dedup.shingles(" ".join(base)), near_dedup.shingles(" ".join(edited(rng, base, 12)))
    jaccard = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    agree = np.mean(near_dedup.signature(a) == near_dedup.signature(b))
    assert abs(agree - jaccard) < 0.3 and len(set(near_dedup.signature(a))) == near_dedup.COORDINATES


def test_hashes_are_the_same_everywhere():
    assert stable_hash([b"word", b"other"]).tolist() == stable_hash([b"other", b"word"]).tolist()[::-1]
    assert hashlib.sha256(stable_hash([b"word"]).tobytes()).hexdigest()[:8] == hashlib.sha256(stable_hash([b"word", b"word"])[:1].tobytes()).hexdigest()[:8]


def test_repeated_passages(spark):
    rng = random.Random(6)
    passage, paragraph = words(rng, 55), words(rng, 70)
    rows = [(i, " ".join(words(rng, 200))) for i in range(20)]
    rows += [(100 + i, " ".join(words(rng, 30 + i) + passage + words(rng, 25))) for i in range(6)]
    rows += [(200 + i, "\n".join([" ".join(words(rng, 20)), " ".join(edited(rng, paragraph, min(i, 1))), "end"])) for i in range(4)]
    rows += [(300, None), (301, ""), (302, "few words"), (None, " ".join(words(rng, 10) + passage)), (303, rows[0][1] + " more"),
             (304, " ".join(words(rng, 40_000))), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit(1), "at": F.lit(2)})
    got = substring_dedup.repeated_passages(docs.repartition(3)).collect()
    held = defaultdict(set)
    for r in got:
        held[r.cluster].add(r.doc_id)
    want = {*range(100, 106), None}, {*range(200, 204)}, {0, 303}
    found = {r.doc_id for r in got}
    assert found == set().union(*want)
    assert all(any(group <= ids for ids in held.values()) for group in want)
    for cluster in held:
        rows_of = [r for r in got if r.cluster == cluster]
        assert [r.doc_id for r in rows_of if not r.removed] == [min(x for x in held[cluster] if x is not None)]
        assert {r.n_docs for r in rows_of} == {len(rows_of)}
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0


def test_every_long_copy_holds_an_anchored_passage():
    rng = random.Random(8)
    size = substring_dedup.PASSAGE_WORDS + substring_dedup.SPAN - 1
    for _ in range(200):
        passage = words(rng, size)
        texts = [" ".join(words(rng, rng.randint(0, 60)) + passage + words(rng, rng.randint(0, 60))) for _ in range(2)]
        a, b = (set(substring_dedup.parts_of([t])[1]["digest"]) for t in texts)
        assert a & b
    together = substring_dedup.parts_of(texts * 3)[1]
    assert together.groupby("text")["digest"].apply(set).tolist() == [
        set(substring_dedup.parts_of([t])[1]["digest"]) for t in texts * 3
    ]


def test_components(spark):
    rng = random.Random(11)
    pairs = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1700)] + [(i, i + 1) for i in range(5000, 5400)] + [(9000, 9000)]
    parent = {x: x for pair in pairs for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    links = spark.createDataFrame(pairs, "a long, b long")
    assert {tuple(r) for r in connected_components(links).collect()} == {(x, find(x)) for x in parent}
    assert connected_components(links.limit(0)).count() == 0


def test_bands_reach_the_recall():
    assert 1 - (1 - 0.75**2) ** substring_dedup.BANDS >= substring_dedup.RECALL


def removed_words(rows):
    gone = defaultdict(set)
    for r in rows:
        if r.removed:
            gone[r.doc_id].update(range(r.start_word, r.end_word))
    return gone


def test_spans_hold_repeated_words_only_and_every_passage_stays(spark):
    rng = random.Random(21)
    header, footer = words(rng, 60), words(rng, 60)
    own = {i: words(rng, 40) for i in range(1, 6)}
    texts = {i: header + own[i] + footer for i in own} | {i: header + footer for i in (6, 7)}
    x, y = words(rng, 90), words(rng, 90)
    y = x[60:] + y[60:] + words(rng, 60)  # the last words of X are the first of Y
    texts |= {11: words(rng, 30) + x + words(rng, 30), 12: x + y[30:], 13: words(rng, 30) + y + words(rng, 30)}
    twice = words(rng, 60)
    texts |= {21: words(rng, 5) + twice, 22: twice + words(rng, 45) + twice}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = substring_dedup.repeated_passages(docs).collect()
    gone = removed_words(got)
    assert not any(gone[i] & set(range(60, 100)) for i in own)
    assert all(gone[i] & set(range(60)) and gone[i] & set(range(100, 160)) for i in range(2, 6)) and not gone[1]
    assert gone[22] & set(range(60)) and gone[22] & set(range(105, 165)) and not gone[22] & set(range(60, 105))
    # Every passage that some document loses stands whole, with nothing taken out of it, in another.
    kept = set()
    for i, t in texts.items():
        kept |= {tuple(t[a:a + 24]) for a in range(len(t) - 23) if not gone[i] & set(range(a, a + 24))}
    parts = {i: substring_dedup.parts_of([" ".join(t)])[1] for i, t in texts.items()}
    for i, found in parts.items():
        for at in found["at"]:
            if set(range(at, at + 24)) <= gone[i]:
                assert tuple(texts[i][at:at + 24]) in kept
    assert gone[12] and gone[13]


def test_short_and_wrapped_paragraphs_are_compared(spark):
    rng = random.Random(22)
    line, block, five = words(rng, 45), words(rng, 48), words(rng, 5)
    other, edited_block = [*line], [*block]
    other[22], edited_block[24] = "changed", "changed"
    wrapped = "\n".join(" ".join(block[a:a + 8]) for a in range(0, 48, 8))
    rewrapped = "\n".join(" ".join(edited_block[a:a + 11]) for a in range(0, 48, 11))

    def within(text):
        return "\n\n".join([" ".join(words(rng, 20)), text, " ".join(words(rng, 20))])

    texts = [" ".join(line), " ".join(other), wrapped, rewrapped, " ".join(edited_block), " ".join(five), " ".join(five)]
    docs = spark.createDataFrame([(i, within(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    gone = removed_words(substring_dedup.repeated_passages(docs).collect())
    assert gone == {1: set(range(20, 65)), 3: set(range(20, 68)), 4: set(range(20, 68)), 6: set(range(20, 25))}


def test_an_automaton_belongs_to_its_items(spark):
    kind = "array<struct<item_id:bigint,distance:int,start:int,end:int>>"
    items = []
    for text in ("the first of two items", "another item at the same address"):
        items[:] = [(1, text, 0)]
        finder = decontaminate._finder(SimpleNamespace(value=decontaminate.block_of(items)), kind)
        assert list(finder.func(pd.Series([f"x {text} y"])))[0] == [(1, 0, 2, 2 + len(text))]


def test_distinct_shingles_of_runs():
    rng = np.random.default_rng(3)
    counts = np.array([1, 50, 7, 400, 1, 30])
    hashes = rng.integers(0, 60, counts.sum()).astype(np.uint64) << np.uint64(57) >> np.uint64(rng.integers(0, 9))
    runs = np.split(hashes, np.cumsum(counts)[:-1])
    assert substring_dedup._distinct(hashes, counts).tolist() == [len(set(run.tolist())) for run in runs]


def test_texts_too_unlike_in_size_are_not_paired(spark, monkeypatch):
    """A paragraph and a part of it share bands, but no similarity of 0.75 is possible: their texts are not moved at all."""
    rng = random.Random(5)
    line = words(rng, 60)
    near = line[:30] + ["x"] + line[31:]
    rows = [(1, " ".join(line)), (2, " ".join(near)), (3, " ".join(line[:36])), (4, " ".join(words(rng, 30)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, write = {}, near_dedup.materialize

    def recorded(df, name):
        seen[name] = write(df, name)
        return seen[name]

    monkeypatch.setattr(near_dedup, "materialize", recorded)
    found = substring_dedup.repeated_passages(docs).where("removed").collect()
    assert {r.doc_id for r in found} >= {2}
    assert seen["tested"].count() == 1 and seen["bodies"].count() == 2


def test_rests_meet_by_their_rarest_shared_shingles(spark, monkeypatch):
    """No pair with enough in common is lost, and texts that share one frequent shingle only do not meet."""
    rng = np.random.default_rng(11)
    rows = [("h", i, i, 8, 2, [1000, *range(2000 + 6 * i, 2005 + 6 * i)]) for i in range(60)]
    for i in range(60, 120):
        rest = sorted(rng.choice(14, size=rng.integers(3, 7), replace=False).tolist())
        rows.append(("h", i, i if i % 9 else 60, len(rest) + 4, 4, rest))
    measured = spark.createDataFrame(rows, "hub string, node int, component int, n long, inside long, rest array<bigint>")
    want = set()
    for _, a, component, n_a, in_a, rest_a in rows:
        for _, b, other, n_b, in_b, rest_b in rows:
            common = len(set(rest_a) & set(rest_b))
            near = 100 * min(n_a, n_b) >= 75 * max(n_a, n_b)
            if a < b and component != other and common and near and 7 * (min(in_a, in_b) + common) >= 3 * (n_a + n_b):
                want.add((a, b))
    found = near_dedup.sharing_pairs(measured)
    assert len(want) > 20 and {tuple(r) for r in found.collect()} == want

    met = []
    monkeypatch.setattr(near_dedup, "materialize", lambda df, name: met.append((name, df.localCheckpoint())) or met[-1][1])
    near_dedup.sharing_pairs(measured).count()
    able = dict(met)["able"]
    assert able.where("node < 60").isEmpty()


def test_a_shingle_is_hashed_once_for_its_line_and_its_block(monkeypatch):
    rng = random.Random(31)
    lines = [words(rng, 12) for _ in range(40)]
    text = "\n".join(map(" ".join, lines)) + "\n\n" + " ".join(words(rng, 9))
    sizes, mix = [], substring_dedup.mixed
    monkeypatch.setattr(substring_dedup, "mixed", lambda x: sizes.append(x.size) or mix(x))
    found, _ = substring_dedup.parts_of([text, "", text])
    n_words = 2 * (40 * 12 + 9)
    assert sum(size > n_words for size in sizes) <= 1 and len(found) == 2 * 42
    for row in found.to_dict("records"):
        hashes = np.sort(near_dedup.shingles(" ".join(text.split()[row["at"]:row["at"] + row["n_words"]])))
        for band in range(substring_dedup.BANDS):
            key = np.array([band], dtype=np.uint64)
            for seed in substring_dedup._SEEDS[2 * band:2 * band + 2]:
                key = mix(key + mix(hashes ^ seed).min())
            assert key.view(np.int64)[0] == row[f"band_{band}"]
        assert row["n"] == len(hashes)


def test_shingle_sets_equal_those_of_single_texts():
    rng = random.Random(32)
    texts = [" ".join(words(rng, n)) for n in (0, 1, 4, 5, 6, 40, 0, 3)] + ["a " * 30, "A b c d e a b c d e", ""]
    for own, text in zip(near_dedup.shingle_sets(texts), texts, strict=True):
        assert own.tolist() == near_dedup.shingles(text).tolist()
    core = near_dedup.shingles(texts[5])[::3]
    for own in near_dedup.shingle_sets(texts):
        assert near_dedup._held(own, core).tolist() == np.isin(own, core).tolist()
        assert not near_dedup._held(own, core[:0]).any()


def test_paragraphs_are_grouped_without_sorting_and_listed_without_signatures(spark, monkeypatch):
    """A list longer than ``SHORT_LIST``: bands and places are grouped by hash, and a list needs no key but its own."""
    rng = random.Random(33)
    line = words(rng, 60)
    rows = [(f"d{i:02}", " ".join(words(rng, 9)) + "\n\n" + " ".join(line[:i] + ["x"] + line[i + 1:])) for i in range(20, 40)]
    rows += [(None, " ".join(line)), (rows[3][0], rows[3][1]), ("e", " ".join(words(rng, 50)))]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    plans, tables, write = {}, {}, near_dedup.materialize

    def recorded(df, name):
        plans.setdefault(name, df._jdf.queryExecution().sparkPlan().toString())
        tables.setdefault(name, write(df, name))
        return tables[name] if name == "parts" else write(df, name)

    for module in (near_dedup, substring_dedup):
        monkeypatch.setattr(module, "materialize", recorded)
    found = substring_dedup.repeated_passages(docs).collect()
    assert {r.doc_id for r in found if r.removed} == {None, *[f"d{i}" for i in range(21, 40)]}
    assert all(r.end_word - r.start_word == 60 and r.start_word in (0, 9) for r in found if r.removed)
    assert "SortAggregate" not in plans["paragraphs"] and "far" not in plans
    assert not any("array" in kind for _, kind in tables["lists"].dtypes)


def test_row_numbers_are_in_the_order_of_row_keys(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)] + [(None, "x"), (None, None)], "doc_id long, text string")
    keys = docs.select(substring_dedup.row_key().alias("key"), substring_dedup._row_number("doc_id", "text").alias("number")).collect()
    assert [r.number for r in sorted(keys, key=lambda r: bytes(r.key))] == sorted({r.number for r in keys})


def test_rests_shared_in_one_component_only_are_not_posted(spark, monkeypatch):
    rows = [("h", i, i % 2, 20, 10, [*range(8), 100 + i, 200 + i]) for i in range(6)]
    rows += [("h", 10 + i, 2, 20, 10, [*range(500, 510)]) for i in range(4)]
    measured = spark.createDataFrame(rows, "hub string, node int, component int, n long, inside long, rest array<bigint>")
    met = []
    monkeypatch.setattr(near_dedup, "materialize", lambda df, name: met.append((name, df.localCheckpoint())) or met[-1][1])
    found = {tuple(r) for r in near_dedup.sharing_pairs(measured).collect()}
    assert found == {(a, b) for a in range(6) for b in range(a + 1, 6) if (a + b) % 2}
    assert {r.node: sorted(r.common) for r in dict(met)["able"].collect()} == dict.fromkeys(range(6), [*range(8)])
