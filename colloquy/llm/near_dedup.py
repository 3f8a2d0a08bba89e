"""Near duplicates: an inverted join over MinHash coordinates, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import (
    id_text, mixed, modest_batches, runs, slices, stable_hash, tidy, whole_text, words,
)
from colloquy.llm.components import connected_components
from colloquy.session import materialize

WORDS = 5
#: Signature coordinates, and how many of them a pair must share to be looked at. At a similarity of 0.75 a pair
#: shares 24 of 32 in the mean; fewer than 12 has a probability near 1e-6.
COORDINATES, MATCHES = 32, 12
#: Coordinate lists of up to so many texts give all their pairs; longer ones are compared through a hub.
SHORT_LIST = 8
#: Hubs that a long list may have before what is far from all of them is compared text by text.
HUBS = 4
#: Texts of a hub's group that its core is taken from, and how many of them must hold a shingle of the core.
CORE_TEXTS, CORE_LEAST = 32, 2
_SEEDS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64))
#: Text handled at once in a task, in characters.
_BLOCK = 1_000_000


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of ``k``-word shingles; with fewer words the whole sequence is one; none without words."""
    hashes = stable_hash(words(text))
    return np.unique(runs(hashes, min(k, len(hashes)))) if len(hashes) else hashes


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """:func:`shingles` of each text; the words and the shingles of all are hashed at once."""
    lists = [words(text) for text in texts]
    hashes = stable_hash([w for one in lists for w in one])
    fives = runs(hashes, WORDS)
    sets, end = [], 0
    for size in map(len, lists):
        start, end = end, end + size
        if size >= WORDS:
            found = np.sort(fives[start:end - WORDS + 1])
            sets.append(found[np.append(True, found[1:] != found[:-1])])
        else:
            sets.append(runs(hashes[start:end], size) if size else hashes[:0])
    return sets


def signature(found: np.ndarray) -> np.ndarray:
    """For each coordinate, a 64-bit key of the coordinate and its least hashed shingle."""
    least = np.array([mixed(found ^ seed).min() for seed in _SEEDS])
    return mixed(least + _SEEDS).view(np.int64)


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in slices(batch["text"].str.len().tolist(), _BLOCK):
            block = batch.iloc[part]
            sets = shingle_sets(block["text"].tolist())
            keys = [signature(found) if len(found) else [] for found in sets]
            yield pd.DataFrame({"doc_id": block["doc_id"], "node": block["node"], "n": [len(found) for found in sets], "keys": keys})


def signed_documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per document: id, 16-byte digest of its text, size of its shingle set, signature keys."""
    base = docs.select(id_text(doc_id).alias("doc_id"), _node(text).alias("node"), whole_text(text).alias("text"))
    signed = base.mapInPandas(tidy(_signed), "doc_id string, node binary, n long, keys array<bigint>")
    return signed.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


def _node(text: str) -> Column:
    return F.unhex(F.md5(whole_text(text).cast("binary")))


def prefix_lists(nodes: DataFrame) -> DataFrame:
    """Posting lists ``key, size, node, score, n, keys`` that a pair with enough matches must meet in.

    Each text's coordinates are put in order of how many texts share them, rare
    ones first, and the ``MATCHES - 1`` commonest are skipped: two texts that
    agree in ``MATCHES`` coordinates share at least one of the others.
    Coordinates that no other text has are counted but need no list.
    """
    postings = nodes.select("node", F.explode("keys").alias("key"))
    sizes = materialize(postings.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    ordered = (
        postings.join(sizes, "key")
        .groupBy("node").agg(F.array_sort(F.collect_list(F.struct("size", "key"))).alias("common"))
    )
    own = F.lit(COORDINATES) - F.size("common")
    kept = F.slice("common", 1, F.greatest(F.lit(0), F.lit(COORDINATES - MATCHES + 1) - own))
    score = F.aggregate("common", F.lit(0).cast("long"), lambda total, x: total + x["size"])
    return (
        ordered.select("node", score.alias("score"), F.explode(kept).alias("posting"))
        .select("node", "score", "posting.key", "posting.size")
        .join(nodes.select("node", "n", "keys"), "node")
    )


def near_in_size(n_a: str, n_b: str) -> Column:
    """Whether two sets of these sizes can have a Jaccard similarity of 0.75 at all: as if one held the other."""
    return 100 * F.least(n_a, n_b) >= 75 * F.greatest(n_a, n_b)


def _matches(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b))


def _alike(a: str, b: str, least: int) -> Column:
    """Whether two members of a list have at least ``least`` keys in common: one they always have, that of the list."""
    return F.lit(True) if least == 1 else _matches(a, b) >= least


def short_pairs(lists: DataFrame, least: int) -> DataFrame:
    """Pairs of short lists with at least ``least`` matches and near in size."""
    short = lists.where(F.col("size") <= SHORT_LIST)
    left = short.select("key", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("keys").alias("keys_a"))
    right = short.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("keys").alias("keys_b"))
    return (
        left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & near_in_size("n_a", "n_b")
                  & _alike("keys_a", "keys_b", least))
        .select("a", "b").distinct()
    )


def stars(lists: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Hubs of long lists: ``key, hub, node, level, sized`` of the texts near one, and ``key, node, keys, levels`` of all texts.

    The first hub of a list is the member whose coordinates are the commonest,
    the one nearest to the middle of a group of copies. Where members are far
    from it (fewer than ``least`` matches), one of those is the next hub of the
    list, and so on ``HUBS`` times; every hub is held against the whole list. No member is far if one key will do.
    ``levels`` are the hubs of its list that a text is near, ``sized`` says whether it is near in size, too.
    """
    members = materialize(lists.where(F.col("size") > SHORT_LIST).select("key", "node", "score", "n", "keys"), "members")
    left, near = members, []
    for level in range(HUBS if least > 1 else 1):
        if level:
            left = materialize(left.join(hubs, "key").where(~_alike("keys", "hub_keys", least)).drop("hub", "hub_keys", "hub_n"), "far")
        hubs = materialize(
            left.groupBy("key").agg(F.max(F.struct("score", "node", "keys", "n")).alias("top"))
            .select("key", F.col("top.node").alias("hub"), F.col("top.keys").alias("hub_keys"), F.col("top.n").alias("hub_n")), "hubs",
        )
        rays = members.join(hubs, "key").where(_alike("keys", "hub_keys", least))
        near.append(rays.select("key", "hub", "node", F.lit(level).alias("level"), near_in_size("n", "hub_n").alias("sized")))
    near = materialize(reduce(DataFrame.unionByName, near), "near")
    levels = materialize(near.groupBy("key", "node").agg(F.collect_set("level").alias("levels")), "levels")
    placed = members.join(levels, ["key", "node"], "left").select(
        "key", "node", "keys", F.coalesce("levels", F.array().cast("array<int>")).alias("levels"),
    )
    return near, materialize(placed, "placed")


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _overlaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in slices((batch["text_a"].str.len() + batch["text_b"].str.len()).tolist(), _BLOCK):
            block = batch.iloc[part]
            texts = dict(zip(block["a"], block["text_a"])) | dict(zip(block["b"], block["text_b"]))
            sets = dict(zip(texts, shingle_sets(list(texts.values()))))
            pairs = [(sets[a], sets[b]) for a, b in zip(block["a"], block["b"])]
            united = [np.sort(np.concatenate(pair)) for pair in pairs]
            yield pd.DataFrame({
                "a": block["a"], "b": block["b"], "both": [np.count_nonzero(x[1:] == x[:-1]) for x in united],
                "n_a": [len(own) for own, _ in pairs], "n_b": [len(other) for _, other in pairs],
            })


def confirmed(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose whole shingle sets have a Jaccard similarity of 0.75 or more."""
    texts = (
        pairs.join(bodies.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .join(bodies.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    kind = _kind(pairs, "a")
    counted = texts.mapInPandas(tidy(_overlaps), f"a {kind}, b {kind}, both long, n_a long, n_b long")
    return counted.where("100 * both >= 75 * (n_a + n_b - both)").select("a", "b")


def _core(group: pd.DataFrame) -> pd.DataFrame:
    values, counts = np.unique(np.concatenate(shingle_sets(group["text"].tolist())), return_counts=True)
    least = min(CORE_LEAST, len(group))
    return pd.DataFrame({"hub": group["hub"].iloc[:1], "core": [values[counts >= least].tobytes()]})


def _held(own: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Which of some values are in ``core``, which is in order."""
    at = np.searchsorted(core, own)
    found = at < len(core)
    found[found] = core[at[found]] == own[found]
    return found


def _rests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in slices(batch["text"].str.len().tolist(), _BLOCK):
            block = batch.iloc[part]
            texts = dict(zip(block["node"], block["text"]))
            sets = dict(zip(texts, shingle_sets(list(texts.values()))))
            inside, rests, sizes = [], [], []
            for node, core in zip(block["node"], block["core"]):
                own = sets[node]
                rest = own[~_held(own, np.frombuffer(core, np.uint64))]
                sizes.append(len(own))
                inside.append(len(own) - len(rest))
                rests.append(rest.view(np.int64))
            yield pd.DataFrame({
                "hub": block["hub"], "node": block["node"], "n": sizes, "inside": inside, "rest": rests,
            })


def _placed_in(df: DataFrame, components: DataFrame) -> DataFrame:
    return df.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))


def measured_groups(rays: DataFrame, bodies: DataFrame, components: DataFrame) -> DataFrame:
    """``hub, node, n, inside, rest`` of the texts near a hub whose group falls into several components.

    The core of a group are the shingles that at least ``CORE_LEAST`` of some of
    its texts share; ``inside`` counts a text's shingles in it, ``rest`` lists
    the others.
    """
    near = _placed_in(rays.select("hub", "node").distinct(), components)
    open_hubs = materialize(
        near.groupBy("hub", "component").agg(F.lit(1).alias("_one"))
        .groupBy("hub").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("hub"), "open",
    )
    near = materialize(near.join(open_hubs, "hub").select("hub", "node"), "near")
    first = Window.partitionBy("hub").orderBy(F.xxhash64("node"), "node")
    core = materialize(
        near.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= CORE_TEXTS)
        .join(bodies, "node").select("hub", "text").groupBy("hub").applyInPandas(_core, f"hub {_kind(rays, 'hub')}, core binary"), "core",
    )
    return materialize(
        near.join(core, "hub").join(bodies, "node").select("hub", "node", "text", "core")
        .mapInPandas(tidy(_rests), f"hub {_kind(rays, 'hub')}, node {_kind(rays, 'node')}, n long, inside long, rest array<bigint>"), "rests",
    )


def core_stars(measured: DataFrame) -> DataFrame:
    """Pairs of each group's text nearest to its core with all others that can be similar to it."""
    middle = materialize(
        measured.groupBy("hub").agg(F.max(F.struct(
            (F.col("inside") / F.col("n")).alias("share"), F.col("inside").alias("inside_m"), F.col("n").alias("n_m"),
            F.col("node").alias("middle"),
        )).alias("top")).select("hub", "top.*"), "middle",
    )
    common = F.least("inside", "inside_m") + F.least(F.col("n") - F.col("inside"), F.col("n_m") - F.col("inside_m"))
    return (
        measured.drop("rest").join(middle, "hub")
        .where((F.col("node") != F.col("middle")) & (7 * common >= 3 * (F.col("n") + F.col("n_m"))))
        .select(F.least("node", "middle").alias("a"), F.greatest("node", "middle").alias("b")).distinct()
    )


def sharing_pairs(measured: DataFrame) -> DataFrame:
    """``node_a, node_b`` from two components of a group, with a common rest, that have enough of it in common.

    As sizes of linked sets differ by a quarter at most, a text needs at least
    ``3 (n + 3/4 n) / 7 - inside`` shingles of its rest in common with another
    one. So only the rarest of those that another component of the group has are
    posted, all but so many less one: of two texts with enough in common, the
    first common shingle is posted by both. From where they meet, each must have
    enough left. Pairs that meet are counted on whole rests.
    """
    # What many texts of a group have is in its core, so few hold the same shingle of their rests.
    holders = Window.partitionBy("hub", "shingle")
    postings = measured.select("hub", "node", F.xxhash64("component").alias("part"), F.explode("rest").alias("shingle"))
    shared = postings.select(
        "hub", "node", "shingle", F.count(F.lit(1)).over(holders).alias("size"),
        F.min("part").over(holders).alias("low"), F.max("part").over(holders).alias("high"),
    ).where("low <> high")
    common = shared.groupBy("hub", "node").agg(F.array_sort(F.collect_list(F.struct("size", "shingle")))["shingle"].alias("common"))
    fewest = F.greatest(F.lit(1), F.ceil(3 * (F.col("n") + F.ceil(F.col("n") * 0.75)) / 7) - F.col("inside"))
    able = common.join(measured.drop("rest"), ["hub", "node"]).withColumn("posted", (F.size("common") - fewest + 1).cast("int")).where("posted > 0")
    able = materialize(able, "able")

    def side(name: str) -> DataFrame:
        return able.select(
            "hub", *[F.col(c).alias(f"{c}_{name}") for c in ("node", "component", "n", "inside")], F.size("common").alias("own"),
            F.posexplode(F.slice("common", F.lit(1), F.col("posted"))).alias("place", "shingle"),
        ).withColumn(f"left_{name}", F.col("own") - F.col("place")).drop("own", "place")

    a, b = side("a"), side("b")
    need, inside = 3 * (F.col("n_a") + F.col("n_b")), F.least("inside_a", "inside_b")
    met = a.join(
        b, (a["hub"] == b["hub"]) & (a["shingle"] == b["shingle"]) & (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b"))
        & near_in_size("n_a", "n_b") & (7 * (inside + F.least("left_a", "left_b")) >= need),
    ).select(a["hub"], "node_a", "node_b", inside.alias("inside"), need.alias("need")).distinct()

    def rest(name: str) -> DataFrame:
        return able.select("hub", F.col("node").alias(f"node_{name}"), F.col("common").alias(f"common_{name}"))

    counted = met.join(rest("a"), ["hub", "node_a"]).join(rest("b"), ["hub", "node_b"])
    return counted.where(7 * (F.col("inside") + _matches("common_a", "common_b")) >= F.col("need")).select("node_a", "node_b")


def closing_pairs(measured: DataFrame, placed: DataFrame, components: DataFrame, least: int) -> DataFrame:
    """Pairs of long lists that the stars leave open and that may still be similar enough.

    Two texts of a group can have at most ``min(inside) + common rest`` shingles
    in common. So only pairs from two components are kept that share enough of
    their rests, or that differ so much in size that the core alone might do. Two
    texts of a list that are near no hub in common are compared by matches.
    Nothing that can be linked is left out.
    """
    measured = materialize(_placed_in(measured, components), "measured")
    main = materialize(
        measured.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("hub").agg(F.max(F.struct("rows", "component"))["component"].alias("main")), "main",
    )

    def side(name: str) -> DataFrame:
        return measured.select("hub", *[F.col(c).alias(f"{c}_{name}") for c in ("node", "component", "n", "inside")])

    inside = F.least("inside_a", "inside_b")
    sharing = sharing_pairs(measured)
    odd = side("a").join(main, "hub").where(F.col("component_a") != F.col("main")).withColumn(
        "n_b", F.explode(F.sequence(
            F.ceil(F.col("n_a") * 0.75), F.greatest(F.ceil(F.col("n_a") * 0.75) - 1, F.floor(7 * F.col("inside_a") / 3 - F.col("n_a"))),
            F.when(F.floor(7 * F.col("inside_a") / 3 - F.col("n_a")) >= F.ceil(F.col("n_a") * 0.75), F.lit(1)).otherwise(F.lit(-1)),
        ))
    )
    other = side("b")
    sized = odd.join(other, (odd["hub"] == other["hub"]) & (odd["n_b"] == other["n_b"])
                     & (F.col("component_a") != F.col("component_b")) & (7 * inside >= 3 * (odd["n_a"] + other["n_b"])))
    placed = materialize(_placed_in(placed, components), "placed")

    def member(name: str) -> DataFrame:
        return placed.select("key", *[F.col(c).alias(f"{c}_{name}") for c in ("node", "keys", "component", "levels")])

    far, other_member = member("a").where(~F.array_contains("levels_a", 0)), member("b")
    distant = far.join(
        other_member,
        (far["key"] == other_member["key"]) & (F.col("component_a") != F.col("component_b"))
        & ~F.arrays_overlap("levels_a", "levels_b") & _alike("keys_a", "keys_b", least),
    )
    found = sharing.unionByName(sized.select("node_a", "node_b")).unionByName(distant.select("node_a", "node_b"))
    return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def linked_components(lists: DataFrame, bodies_of: Callable[[DataFrame], DataFrame], least: int) -> DataFrame:
    """``node, component`` of all texts that have a link of similarity 0.75 or more.

    ``lists`` has ``key, size, node, score, n, keys``, with ``n`` the size of a text's shingle set; texts that share a list and
    at least ``least`` of their keys, and whose sizes allow a link, are confirmed on whole shingle sets. If ``least`` is 1,
    ``keys`` is not needed.
    ``bodies_of`` gives ``node, text`` for a table of wanted nodes. Lists of up
    to ``SHORT_LIST`` texts give all their pairs, longer ones a star and what
    :func:`closing_pairs` adds.
    """
    if "keys" not in lists.columns:
        lists = lists.withColumn("keys", F.lit(None).cast("array<bigint>"))
    pairs = materialize(short_pairs(lists, least), "pairs")
    rays, placed = stars(lists, least)
    tested = pairs.unionByName(
        rays.where(F.col("sized") & (F.col("hub") != F.col("node"))).select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    )
    tested = materialize(tested.distinct(), "tested")
    wanted = tested.select(F.explode(F.array("a", "b")).alias("node")).unionByName(placed.select("node")).distinct()
    bodies = materialize(bodies_of(wanted), "bodies")
    links = materialize(confirmed(tested, bodies), "links")
    measured = measured_groups(rays, bodies, connected_components(links))
    second = materialize(core_stars(measured).join(tested, ["a", "b"], "left_anti"), "second")
    links = materialize(links.unionByName(confirmed(second, bodies)), "links")
    tested = tested.unionByName(second)
    closing = closing_pairs(measured, placed, connected_components(links), least)
    closing = materialize(closing.join(tested, ["a", "b"], "left_anti"), "closing")
    more = materialize(confirmed(closing, bodies), "links")
    return connected_components(links.unionByName(more))


def grouped_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of documents connected by links of similarity 0.75 or more over five-word shingles.

    Equal texts are one node. Each node is posted under the values of 32 MinHash
    coordinates; lists are met with the commonest coordinates skipped, matches
    are counted on whole signatures, and pairs with at least 12 are confirmed on
    the whole shingle sets of their texts. A long list is not paired out: its
    texts are compared with a hub, and what the hub leaves open is closed by an
    exact bound (see :func:`closing_pairs`), so groups of thousands of copies
    cost rows in proportion.

    Returns ``doc_id, node, n_shingles, component_id, kept`` for every row. The
    component is named by its smallest id. A text without words has no shingle
    and is linked with nothing, not even its copies; null counts as empty. A null
    id is never the name of a component, unless no row of it has an id. Rows
    with one id but different texts stay apart unless they are similar. Other
    columns are not read.
    """
    modest_batches(docs.sparkSession)
    signed = materialize(signed_documents(docs, doc_id, text), "signed")
    nodes = signed.where("n > 0").groupBy("node").agg(
        F.first("keys").alias("keys"), F.first("n").alias("n"), F.min("doc_id").alias("first_id"))
    lists = materialize(prefix_lists(nodes), "lists")

    def bodies_of(wanted: DataFrame) -> DataFrame:
        # One row of each text, found by text and id together, so that copies are not gathered in one task.
        places = nodes.join(wanted, "node", "left_semi").select(F.col("node").alias("_node"), "first_id")
        texts = docs.select(_node(text).alias("node"), whole_text(text).alias("text"), F.col(doc_id).alias("_id"))
        one = texts.join(places, (F.col("node") == F.col("_node")) & F.col("_id").eqNullSafe(F.col("first_id")), "left_semi")
        return one.groupBy("node").agg(F.first("text").alias("text"))

    return _labelled(signed, linked_components(lists, bodies_of, MATCHES))


def _labelled(signed: DataFrame, components: DataFrame) -> DataFrame:
    rows = signed.select("doc_id", "node", "n")
    with_words = rows.where("n > 0").join(components, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    names = materialize(with_words.groupBy("component").agg(F.min("doc_id").alias("component_id")), "names")
    named = with_words.join(names, "component").select("doc_id", "node", "n", "component_id")
    alone = rows.where("n = 0").select("doc_id", "node", "n", F.col("doc_id").alias("component_id"))
    return named.unionByName(alone).select(
        "doc_id", "node", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row (see :func:`grouped_documents`)."""
    return grouped_documents(docs, doc_id, text).drop("node")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each near-duplicate group the rows with its smallest id, as they are.

    Only the ids of rows to drop are joined back; rows with one id and one text
    stay or go together.
    """
    grouped = grouped_documents(docs, doc_id, text)
    dropped = materialize(
        grouped.where(~F.col("kept")).select(F.col("doc_id").alias("_gone_id"), F.col("node").alias("_gone_node")).distinct(),
        "dropped",
    )
    return docs.join(dropped, F.col(doc_id).eqNullSafe(F.col("_gone_id")) & (_node(text) == F.col("_gone_node")), "left_anti")
