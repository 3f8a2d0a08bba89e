"""Best stored text for each query by TF-IDF cosine, token Jaccard or characters.

Comparing every query with every stored text does not scale, so all three
measures share one exact scheme:

1. Equal texts are handled once, on either side.
2. A few rare terms of a query lead to some good stored texts. The best exact
   score among them is a lower bound for the query.
3. A stored text can only reach that bound if it shares one of the query's
   rarer terms: the most common terms together cannot add up to it. Only the
   rarer ones (the prefix) are joined with the postings of the bank.
4. The candidates are scored exactly and the best one is kept.

For the cosine, step 3 works on blocks instead of whole terms: the postings of a
term are cut by weight, and each block knows its size and largest weight. A
query reads blocks in the order of what they can add per posting, until no text
outside them can reach the bound. What it has read gives a partial score; only
pairs that the unread blocks could still lift to the bound are finished. So a
query made of common words meets the texts in which those words weigh most, not
every text that has them.

Step 2 may look at any subset of the bank without changing the answer, because
step 3 finds everything that could beat the bound.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from colloquy.functions import text as T
from colloquy.session import materialize
from colloquy.operators.frames import count_rows

SEED_TERMS = 3
SEED_TEXTS = 4
SLACK = 1e-9
#: Postings a query may read to find its first bound, next to those of its rarest terms.
SEED_POSTINGS = 1024
#: Postings of a term are cut into blocks of weights that agree in floor(weight * LEVELS).
LEVELS = 64


def _key() -> Column:
    """Texts are compared in lower case; a missing one counts as empty."""
    return F.coalesce(F.lower("text"), F.lit(""))


def _distinct_bank(bank: DataFrame, key: Column) -> DataFrame:
    """Equal stored texts as one row: lowest position, number of copies."""
    return (
        bank.select("bank_pos", key.alias("btext"), T.digest(key).alias("bkey"))
        .groupBy("bkey").agg(F.min("bank_pos").alias("bank_pos"), count_rows().alias("copies"), F.first("btext").alias("btext"))
    )


def _distinct_queries(queries: DataFrame, key: Column) -> DataFrame:
    """Equal query texts as one row, identified by the lowest query id."""
    return (
        queries.select("query_id", key.alias("qtext"), T.digest(key).alias("qkey"))
        .groupBy("qkey").agg(F.min("query_id").alias("qid"), F.first("qtext").alias("qtext"))
    )


def _seeds(query_terms: DataFrame, postings: DataFrame, merit: Column) -> DataFrame:
    """A few promising stored texts per query, through its rarest terms.

    ``postings`` needs ``term, bid``; ``merit`` says which texts of a term to
    try first. Row counts are bounded by SEED_TERMS * SEED_TEXTS per query.
    """
    rare = F.row_number().over(W.partitionBy("qid").orderBy("df", "term"))
    best = F.row_number().over(W.partitionBy("term").orderBy(merit, "bid"))
    few_terms = query_terms.withColumn("_r", rare).where(F.col("_r") <= SEED_TERMS).select("qid", "term")
    few_texts = postings.withColumn("_b", best).where(F.col("_b") <= SEED_TEXTS).select("term", "bid")
    return few_terms.join(few_texts, "term").select("qid", "bid").distinct()


def _best(scored: DataFrame) -> DataFrame:
    """Highest score per query, lowest position on ties; a plain aggregate."""
    rank = F.struct((-F.round("score", 10)).alias("cost"), F.col("bank_pos"))
    return scored.groupBy("qid").agg(F.min(rank).alias("_m")).select(
        "qid", F.col("_m.bank_pos").alias("bank_pos"), (-F.col("_m.cost")).alias("score")
    )


def _back_to_rows(queries: DataFrame, key: Column, distinct: DataFrame, best: DataFrame, bank: DataFrame) -> DataFrame:
    """Give every query row the result of its text.

    Queries that share nothing with the bank score 0 and, like an arg-max over
    zeros, point at the first stored text.
    """
    first = bank.agg(F.min("bank_pos").alias("p")).scalar()
    found = distinct.join(best, "qid", "left").select(
        "qkey",
        F.coalesce("bank_pos", first).alias("bank_pos"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    return queries.withColumn("qkey", T.digest(key)).join(found, "qkey").drop("qkey")


# --- TF-IDF cosine ---------------------------------------------------------------------------

def tfidf_postings(bank: DataFrame) -> DataFrame:
    """Long TF-IDF table ``bid, copies, term, w`` of the distinct stored texts.

    Weights are tf * (ln((1+n)/(1+df)) + 1), scaled to unit length per text.
    Copies count towards n and df.
    """
    spread = _distinct_bank(bank, _key()).select(
        F.col("bank_pos").alias("bid"), "copies",
        F.explode(T.ngrams_1_2(T.model_tokens("btext"))).alias("term"),
    )
    tf = spread.groupBy("bid", "copies", "term").agg(count_rows().alias("tf"))
    total = bank.agg(count_rows().alias("n")).scalar()
    idf = tf.groupBy("term").agg(F.sum("copies").alias("df")).withColumn(
        "idf", F.log((1 + total) / (1 + F.col("df"))) + 1
    )
    raw = tf.join(idf, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norms = raw.groupBy("bid").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, "bid").select("bid", "term", "df", "idf", (F.col("raw") / F.col("norm")).alias("w"))


def tfidf_weights(bank: DataFrame) -> DataFrame:
    """TF-IDF weight of every term of every stored text."""
    postings = tfidf_postings(bank).select(F.col("bid").alias("rep_pos"), "term", "df", "w")
    texts = bank.select("bank_pos", T.digest(_key()).alias("bkey"))
    owners = _distinct_bank(bank, _key()).select("bkey", F.col("bank_pos").alias("rep_pos"))
    return (
        texts.join(owners, "bkey").join(postings, "rep_pos")
        .select("bank_pos", "term", "df", "w")
    )


@dataclass(frozen=True)
class TfidfIndex:
    """``postings``: bid, term, w, level. ``blocks``: term, level, postings ``n``, largest weight ``top``, df, idf."""

    postings: DataFrame
    blocks: DataFrame


def tfidf_index(bank: DataFrame) -> TfidfIndex:
    """Postings of the distinct stored texts, and their blocks; both written.

    A term has at most ``LEVELS + 1`` blocks, counted on the map side, whatever its frequency.
    """
    level = F.floor(F.col("w") * LEVELS).cast("int").alias("level")
    postings = materialize(tfidf_postings(bank).select("bid", "term", "df", "idf", "w", level), "postings")
    blocks = postings.groupBy("term", "level").agg(
        count_rows().alias("n"), F.max("w").alias("top"), F.first("df").alias("df"), F.first("idf").alias("idf"),
    )
    return TfidfIndex(postings.drop("df", "idf"), materialize(blocks, "posting-blocks"))


def _query_terms(distinct: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Unit-length query terms known to the bank."""
    spread = distinct.select("qid", F.explode(T.ngrams_1_2(T.model_tokens("qtext"))).alias("term"))
    raw = (
        spread.groupBy("qid", "term").agg(count_rows().alias("tf"))
        .join(vocabulary, "term")
        .withColumn("raw", F.col("tf") * F.col("idf"))
    )
    norms = raw.groupBy("qid").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, "qid").select("qid", "term", "df", (F.col("raw") / F.col("norm")).alias("w"))


def _cosines(pairs: DataFrame, query_terms: DataFrame, postings: DataFrame) -> DataFrame:
    """Exact cosine of each candidate pair, as a sum over its shared terms."""
    return (
        pairs.join(query_terms.select("qid", "term", F.col("w").alias("qw")), "qid")
        .join(postings.select("bid", "term", "w"), ["bid", "term"])
        .groupBy("qid", F.col("bid").alias("bank_pos"))
        .agg(F.sum(F.col("qw") * F.col("w")).alias("score"))
    )


def _ranked_blocks(terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """``qid, term, qw, level, top, reach, upto``: the blocks of each query's terms in reading order.

    ``reach`` is the most that a block and all those after it can add to a score. Two
    limits hold: the largest weights of the unread blocks, and the length of the
    query's part that has any. ``upto`` counts postings as far as the block.
    """
    of_term = W.partitionBy("qid", "term").orderBy(F.col("level").desc())
    below = F.lead("top").over(of_term)
    sized = terms.select("qid", "term", F.col("w").alias("qw")).join(blocks.select("term", "level", "n", "top"), "term").select(
        "qid", "term", "qw", "level", "n", "top",
        (F.col("qw") * (F.col("top") - F.coalesce(below, F.lit(0.0)))).alias("gain"),
        F.when(below.isNull(), F.col("qw") * F.col("qw")).otherwise(0.0).alias("length"),
    )
    # A block comes after the heavier ones of its term, so it is worth no more than they are.
    merit = F.min(F.col("gain") / F.col("n")).over(of_term.rowsBetween(W.unboundedPreceding, W.currentRow))
    last_first = W.partitionBy("qid").orderBy("merit", "term", "level").rowsBetween(W.unboundedPreceding, W.currentRow)
    reach = F.least(F.sum("gain").over(last_first), F.sqrt(F.sum("length").over(last_first)))
    upto = F.sum("n").over(W.partitionBy("qid")) - F.sum("n").over(last_first) + F.col("n")
    return sized.withColumn("merit", merit).select("qid", "term", "qw", "level", "top", reach.alias("reach"), upto.alias("upto"))


def _limit() -> Column:
    return F.coalesce("bound", F.lit(0.0)) - SLACK


def _first_bound(terms: DataFrame, ranked: DataFrame, postings: DataFrame) -> DataFrame:
    """``qid, bound``: the best exact score among a few texts, found by rare terms and in the first blocks."""
    begun = (
        ranked.where(F.col("upto") <= SEED_POSTINGS).join(postings, ["term", "level"])
        .groupBy("qid", "bid").agg(F.sum(F.col("qw") * F.col("w")).alias("part"))
    )
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.col("part").desc(), "bid"))
    ahead = begun.withColumn("_p", place).where(F.col("_p") <= SEED_TEXTS).select("qid", "bid")
    pairs = _seeds(terms, postings, F.col("w").desc()).unionByName(ahead).distinct()
    return _cosines(pairs, terms, postings).groupBy("qid").agg(F.max("score").alias("bound"))


def _met(marked: DataFrame, postings: DataFrame) -> DataFrame:
    """``qid, bid, part, open, bound``: pairs met in blocks that were read, the part of the score read and the most that is open.

    What a text can still get comes from terms in whose read blocks it was not, and
    from the rest of its unit length.
    """
    of_term = W.partitionBy("qid", "term")
    left = F.max(F.when(~F.col("read"), F.col("top"))).over(of_term)
    blocks = marked.withColumn("left", F.coalesce(left, F.lit(0.0)))
    square = F.when(F.col("left") > 0, F.col("qw") * F.col("qw")).otherwise(0.0)
    rest = marked.where(~F.col("read")).groupBy("qid", "term", "qw").agg(F.max("top").alias("left")).groupBy("qid").agg(
        F.sum(F.col("qw") * F.col("left")).alias("most"), F.sum(F.col("qw") * F.col("qw")).alias("length"),
    )
    pairs = blocks.where("read").withColumn("square", square).join(postings, ["term", "level"]).groupBy("qid", "bid", "bound").agg(
        F.sum(F.col("qw") * F.col("w")).alias("part"), F.sum(F.col("qw") * F.col("left")).alias("closed"),
        F.sum("square").alias("used"), F.sum(F.col("w") * F.col("w")).alias("filled"),
    )
    none = F.lit(0.0)
    length = F.greatest(F.coalesce("length", none) - F.col("used"), none) * F.greatest(1 - F.col("filled"), none)
    most = F.greatest(F.coalesce("most", none) - F.col("closed"), none)
    # A root turns rounding errors of 1e-16 into 1e-8, hence the small number under it.
    still = F.least(most, F.sqrt(length + 1e-14))
    return pairs.join(rest, "qid", "left").select("qid", "bid", "part", still.alias("open"), "bound")


def tfidf_best(queries: DataFrame, bank: DataFrame, index: TfidfIndex | None = None) -> DataFrame:
    """Best stored text per query by TF-IDF cosine over unigrams and bigrams.

    Adds ``bank_pos`` and ``score`` to the query rows. ``index`` is that of ``bank``,
    for example a saved one; without it, it is built.
    """
    key = _key()
    index = index or tfidf_index(bank)
    postings = index.postings
    vocabulary = index.blocks.groupBy("term").agg(F.first("df").alias("df"), F.first("idf").alias("idf"))
    distinct = _distinct_queries(queries, key)
    terms = materialize(_query_terms(distinct, vocabulary), "query-terms")
    ranked = materialize(_ranked_blocks(terms, index.blocks), "ranked-blocks")
    bound = _first_bound(terms, ranked, postings)
    marked = materialize(
        ranked.join(bound, "qid", "left").withColumn("read", F.col("reach") >= _limit()).drop("upto"), "marked-blocks",
    )
    met = materialize(_met(marked, postings), "met")
    # What was read of the best pair is a bound, too.
    better = met.groupBy("qid").agg(F.max("part").alias("better"))
    begun = met.join(better, "qid").where(F.col("part") + F.col("open") >= F.greatest(_limit(), F.col("better") - SLACK))
    begun = materialize(begun.select("qid", "bid", "part"), "begun")
    depth = marked.where(~F.col("read")).groupBy("qid", "term", "qw").agg(F.max("level").alias("depth"))
    added = (
        begun.select("qid", "bid").join(depth, "qid").join(postings, ["bid", "term"])
        .where(F.col("level") <= F.col("depth"))
        .groupBy("qid", "bid").agg(F.sum(F.col("qw") * F.col("w")).alias("more"))
    )
    scored = begun.join(added, ["qid", "bid"], "left").select(
        "qid", F.col("bid").alias("bank_pos"), (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("score")
    )
    best = _best(scored)
    return _back_to_rows(queries, key, distinct, best, bank)


# --- Token Jaccard ---------------------------------------------------------------------------

def _token_sides(bank: DataFrame, queries: DataFrame, key: Column, tokens: Column, qtokens: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Token arrays and long tables of both sides, with bank frequencies.

    Tokens the bank has never seen get frequency 0: they come first in the
    prefix order and cost nothing in the join.
    """
    stored = materialize(
        _distinct_bank(bank, key).select(F.col("bank_pos").alias("bid"), "btext", tokens.alias("btokens")), "bank-tokens"
    )
    distinct = _distinct_queries(queries, key)
    asked = materialize(distinct.withColumn("qtokens", qtokens), "query-tokens")
    postings = stored.select("bid", F.size("btokens").alias("bsize"), F.explode("btokens").alias("term"))
    frequency = postings.groupBy("term").agg(count_rows().alias("df"))
    terms = (
        asked.select("qid", F.size("qtokens").alias("qsize"), F.explode("qtokens").alias("term"))
        .join(frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    )
    return stored, asked, postings, materialize(terms, "query-token-df")


def _prefix_pairs(terms: DataFrame, postings: DataFrame, needed: Column, widest: Column) -> DataFrame:
    """Pairs sharing one of the ``qsize - needed + 1`` rarest query tokens.

    A stored text smaller than ``needed`` or larger than ``widest`` tokens
    cannot reach the bound and is left out of the join.
    """
    rare_first = F.row_number().over(W.partitionBy("qid").orderBy("df", "term"))
    prefix = (
        terms.withColumn("_r", rare_first)
        .where((F.col("_r") <= F.col("qsize") - needed + 1) & (F.col("df") > 0))
    )
    sized = prefix.select("qid", "term", needed.alias("_low"), widest.alias("_high"))
    return (
        sized.join(postings, "term")
        .where(F.col("bsize").between(F.col("_low"), F.col("_high")))
        .select("qid", "bid").distinct()
    )


def _with_sides(pairs: DataFrame, asked: DataFrame, stored: DataFrame) -> DataFrame:
    return pairs.join(asked, "qid").join(stored, "bid").withColumnRenamed("bid", "bank_pos")


def _jaccard() -> Column:
    both = F.size(F.array_intersect("qtokens", "btokens"))
    return both / (F.size("qtokens") + F.size("btokens") - both)


def jaccard_best(queries: DataFrame, bank: DataFrame) -> DataFrame:
    """Best stored text per query by Jaccard similarity of lower-case word sets."""
    key = _key()
    stored, asked, postings, terms = _token_sides(bank, queries, key, T.token_set("btext"), T.token_set("qtext"))
    seeds = _seeds(terms.where(F.col("df") > 0), postings, F.col("bsize").asc())
    bound = (
        _with_sides(seeds, asked, stored).withColumn("score", _jaccard())
        .groupBy("qid").agg(F.max("score").alias("bound"))
    )
    # A similarity of b needs at least b * qsize shared tokens.
    bounded = terms.join(bound, "qid", "left")
    b, q = F.coalesce("bound", F.lit(0.0)), F.col("qsize")
    needed = F.greatest(F.ceil(b * q - SLACK), F.lit(1))
    widest = F.when(b > 0, q / b + SLACK).otherwise(F.lit(float("inf")))
    pairs = _prefix_pairs(bounded, postings, needed, widest)
    best = _best(_with_sides(pairs, asked, stored).withColumn("score", _jaccard()))
    return _back_to_rows(queries, key, asked.select("qid", "qkey"), best, bank)


# --- Character similarity --------------------------------------------------------------------

GRAM = 3
#: Pairs with this ratio or a higher one are found by shared grams.
NEAR = 0.9
#: What the grams leave open is looked for in rounds: pairs whose ratio may reach the first bound, then the next, then all.
BOUNDS = (0.5, 0.25, 0.0)
#: Characters of each side that are compared at once.
SLICE_CHARS = 1 << 14


@F.pandas_udf(DoubleType())
def _sequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Matching-block ratio of (query, stored); Spark has no such expression."""
    for asked, stored in batches:
        matcher, scores = SequenceMatcher(), []
        for a, b in zip(asked, stored):
            matcher.set_seqs(a, b)
            scores.append(matcher.ratio())
        yield pd.Series(scores, dtype="float64")


def _gram_counts(texts: DataFrame, name: str, text: str, size: str) -> DataFrame:
    """``name, size, gram, count`` of the three-character pieces of each text."""
    grams = F.transform(F.sequence(F.lit(1), F.col(size) - GRAM + 1), lambda i: F.substring(text, i, GRAM))
    return (
        texts.where(F.col(size) >= GRAM).select(name, size, F.explode(grams).alias("gram"))
        .groupBy(name, size, "gram").agg(count_rows().alias("n"))
    )


def _needed(q: Column, b: Column) -> Column:
    """Grams that texts of ``q`` and ``b`` characters share at least when their ratio reaches ``NEAR``.

    The ratio counts characters matched in order, so at most ``(1 - NEAR) *
    (q + b)`` insertions and deletions lie between the texts, and each of them
    touches ``GRAM`` grams of the longer one.
    """
    return F.greatest(q, b) - GRAM + 1 - GRAM * F.floor((1 - NEAR) * (q + b) + SLACK)


def _with_deletions(side: DataFrame, name: str, text: str, size: str) -> DataFrame:
    """``name, size, key``: short texts, and what is left of them without one character."""
    less = F.transform(
        F.sequence(F.lit(1), F.col(size)),
        lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.col(size))),
    )
    # From 10 characters a pair on, one may be missing; a text that needs no gram has five at most.
    return side.where(F.col(size).between(1, 2 * GRAM)).select(
        name, size, F.explode(F.array_distinct(F.concat(F.array(text), less))).alias("key")
    )


def char_candidates(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """``qid, bid`` of all pairs that share as many grams as a ratio of ``NEAR`` needs.

    Grams are met rare ones first: the commonest grams of a query, which
    together cannot make up what any stored text would need, are left out of the
    join and only counted for pairs that the others leave open. Pairs of texts
    so short that they need no gram differ by one character at most and meet
    by what is left without it.
    """
    q_grams = materialize(_gram_counts(asked, "qid", "qtext", "q"), "query-grams")
    b_grams = materialize(_gram_counts(stored, "bid", "btext", "b"), "bank-grams")
    frequency = b_grams.groupBy("gram").agg(count_rows().alias("df"))
    q, b = F.col("q"), F.col("b")
    # The need is least for the longest or the shortest stored text that can reach the ratio.
    longest, shortest = F.floor(q * (2 - NEAR) / NEAR + SLACK), F.ceil(q * NEAR / (2 - NEAR) - SLACK)
    least = F.least(_needed(q, longest), _needed(q, shortest), _needed(q, q))
    common_first = W.partitionBy("qid").orderBy(F.col("df").desc(), F.col("gram").desc())
    ranked = materialize(
        q_grams.join(frequency, "gram")
        .withColumn("upto", F.sum("n").over(common_first.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .select("qid", "q", "gram", "n", (F.col("upto") >= F.greatest(least, F.lit(1))).alias("in_prefix"),
                F.when(F.col("upto") < F.greatest(least, F.lit(1)), F.col("n")).otherwise(0).alias("rest")), "ranked-grams",
    )
    rests = ranked.groupBy("qid").agg(F.sum("rest").alias("rest"))
    other = b_grams.select("bid", "b", "gram", F.col("n").alias("m"))
    begun = (
        ranked.where("in_prefix").join(other, "gram").where(b.between(shortest, longest))
        .groupBy("qid", "bid", "q", "b").agg(F.sum(F.least("n", "m")).alias("part"))
        .join(rests, "qid").where(F.col("part") + F.col("rest") >= _needed(q, b))
    )
    begun = materialize(begun, "begun-grams")
    added = (
        begun.select("qid", "bid").join(ranked.where(~F.col("in_prefix")).select("qid", "gram", "n"), "qid")
        .join(other.select("bid", "gram", "m"), ["bid", "gram"])
        .groupBy("qid", "bid").agg(F.sum(F.least("n", "m")).alias("more"))
    )
    by_grams = (
        begun.join(added, ["qid", "bid"], "left")
        .where(F.col("part") + F.coalesce("more", F.lit(0)) >= _needed(q, b)).select("qid", "bid")
    )
    short = _with_deletions(asked, "qid", "qtext", "q").join(_with_deletions(stored, "bid", "btext", "b"), "key")
    by_chars = short.where((_needed(q, b) <= 0) & (F.abs(q - b) <= 1)).select("qid", "bid")
    return by_grams.unionByName(by_chars).distinct()


def overlaps(asked: list[str], stored: list[str]) -> np.ndarray:
    """Characters that each pair of texts has in common, counted with repeats: no ratio matches more of them."""
    counts = [Counter(t) for t in asked], [Counter(t) for t in stored]
    shared = set().union(*counts[0]) & set().union(*counts[1])
    total = np.zeros((len(asked), len(stored)), dtype=np.int64)
    for ch in shared:
        a, b = (np.array([c[ch] for c in side]) for side in counts)
        total += np.minimum(a[:, None], b[None, :])
    return total


class _InOrder:
    """Longest common subsequence with one text, in bit-parallel steps: matching blocks are such a subsequence."""

    def __init__(self, text: str):
        self.size, self.masks = len(text), {}
        for i, ch in enumerate(text):
            self.masks[ch] = self.masks.get(ch, 0) | 1 << i

    def common(self, other: str) -> int:
        full = (1 << self.size) - 1
        left = full
        for ch in other:
            hit = left & self.masks.get(ch, 0)
            left = (left + hit | left - hit) & full
        return self.size - left.bit_count()


class Comparer:
    """Best ratios of queries over a slice of stored texts, each query's most promising texts first."""

    def __init__(self, bids: list[int], stored: list[str]):
        self.bids, self.stored, self.compared = np.array(bids), stored, 0
        self.sizes = np.array([len(t) for t in stored])
        self.matchers: dict[int, SequenceMatcher] = {}

    def _ratio(self, text: str, i: int) -> float:
        if i not in self.matchers:
            self.matchers[i] = SequenceMatcher(None, "", self.stored[i])
        matcher = self.matchers[i]
        matcher.set_seq1(text)
        self.compared += 1
        return matcher.ratio()

    def best(self, text: str, shared: np.ndarray, known: float, bound: float, done: float) -> tuple[float, int] | None:
        """Highest ratio and its lowest position, if it is at least ``known``.

        Only pairs that may reach ``bound`` are looked at, and not those that
        might have reached ``done``: an earlier round has compared them.
        """
        limit = 2.0 * shared / np.maximum(len(text) + self.sizes, 1)
        order = np.lexsort((self.bids, -limit))
        best, at, in_order = known, None, _InOrder(text)
        for i in order:
            if limit[i] <= 0 or limit[i] < max(best, bound) - SLACK:
                break
            reach = 2.0 * in_order.common(self.stored[i]) / (len(text) + self.sizes[i])
            if reach < max(best, bound) - SLACK or reach >= done:
                continue
            ratio = round(self._ratio(text, i), 10)
            if ratio > best or ratio == best and (at is None or self.bids[i] < at):
                best, at = ratio, int(self.bids[i])
        return None if at is None else (best, at)


def _searched(bound: float, done: float):
    """Rows of a block of queries beside a slice of the bank to ``qid, bank_pos, score``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for queries, stored in zip(batch["queries"], batch["stored"]):
                queries, stored = list(queries), list(stored)
                comparer = Comparer([s["bid"] for s in stored], [s["btext"] for s in stored])
                shared = overlaps([x["qtext"] for x in queries], comparer.stored)
                for x, row in zip(queries, shared):
                    hit = comparer.best(x["qtext"], row, x["known"], bound, done)
                    if hit and hit[0] > 0:
                        found.append((x["qid"], hit[1], hit[0]))
            yield pd.DataFrame(found, columns=["qid", "bank_pos", "score"]).astype({"qid": "int64", "bank_pos": "int64", "score": "float64"})

    return run


def _sliced(texts: DataFrame, size: str, key: str, row: list[str], alias: str) -> tuple[DataFrame, int]:
    """``slice, alias``: the texts dealt into slices of about ``SLICE_CHARS`` characters, and their number."""
    chars = texts.agg(F.sum(F.col(size) + 1).alias("n")).first().n or 0
    n = max(1, math.ceil(chars / SLICE_CHARS))
    slices = texts.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("slice")).agg(
        F.collect_list(F.struct(*row)).alias(alias)
    )
    return slices, n


def _search(asked: DataFrame, stored: DataFrame, found: DataFrame) -> DataFrame:
    """``qid, bank_pos, score``: the best of ``found`` and of all stored texts, for every query that shares a character with one.

    Queries that ``found`` has at ``NEAR`` or above are done. The others are
    held against the bank in rounds of falling bounds, block by slice. Two upper
    bounds come before a comparison: the common characters, then the longest common
    subsequence. A query leaves after the round whose bound its best ratio reaches.
    """
    spark = asked.sparkSession
    slices, n_slices = _sliced(stored, "b", "btext", ["bid", "btext"], "stored")
    slices = materialize(slices, "bank-slices")
    done = NEAR
    for bound in BOUNDS:
        open_queries = asked.join(found.where(F.col("score") >= done).select("qid"), "qid", "left_anti").join(
            found.select("qid", F.col("score").alias("known")), "qid", "left").fillna(0.0, ["known"])
        blocks, n_blocks = _sliced(open_queries.where("q > 0"), "q", "qtext", ["qid", "qtext", "known"], "queries")
        blocks = materialize(blocks, "query-blocks")
        if blocks.isEmpty():
            break
        tasks = min(n_blocks * n_slices, 8 * spark.sparkContext.defaultParallelism)
        pairs = blocks.select("queries", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("slice")).join(slices, "slice")
        # Nothing is known to have been compared before the first of these rounds.
        compared = 2.0 if bound == BOUNDS[0] else done
        better = pairs.repartition(tasks).select("queries", "stored").mapInPandas(
            _searched(bound, compared), "qid long, bank_pos long, score double"
        )
        found = materialize(_best(found.select("qid", "bank_pos", "score").unionByName(better)), "found")
        done = bound
    return found


def char_best(queries: DataFrame, bank: DataFrame) -> DataFrame:
    """Best stored text per query by matching-block character similarity.

    Adds ``bank_pos`` and ``score``; the lowest position wins a tie, and a query that shares
    no character with any text scores 0, like in the other measures. An empty
    text matches only an empty one, with a score of 1. Ids are integers.

    Pairs at ``NEAR`` or above are found by a join on shared grams; only what
    that leaves open is searched (:func:`_search`).
    """
    key = _key()
    stored = materialize(
        _distinct_bank(bank, key).select(F.col("bank_pos").alias("bid"), "btext", F.length("btext").alias("b")), "bank-texts"
    )
    asked = materialize(_distinct_queries(queries, key).withColumn("q", F.length("qtext")), "query-texts")
    pairs = char_candidates(asked, stored)
    blank = asked.where("q = 0").select("qid", "q").join(stored.where("b = 0").select("bid", "b"), F.col("q") == F.col("b"))
    compared = (
        pairs.unionByName(blank.select("qid", "bid")).join(asked, "qid").join(stored, "bid")
        .withColumn("score", _sequence_ratio("qtext", "btext"))
    )
    found = materialize(_best(compared.withColumnRenamed("bid", "bank_pos")), "near-texts")
    return _back_to_rows(queries, key, asked.select("qid", "qkey"), _search(asked, stored, found), bank)


# --- What to do with the scores --------------------------------------------------------------

def best_match(scored: DataFrame, bank: DataFrame, threshold: float) -> DataFrame:
    """Attach the label and reply of the best stored text and the decision.

    Every query keeps its row; an empty bank matches none.
    """
    stored = bank.select("bank_pos", F.col("label").alias("matched_label"), F.col("reply").alias("stored_reply"))
    hit = F.coalesce(F.round("score", 10) >= threshold, F.lit(False)) & F.col("bank_pos").isNotNull()
    return scored.join(stored, "bank_pos", "left").withColumns({
        "matched": hit,
        "matched_label": F.when(hit, F.col("matched_label")),
        "stored_reply": F.when(hit, F.col("stored_reply")),
    })


THRESHOLDS = tuple((30 + 5 * k) / 100 for k in range(14))


def threshold_sweep(scored: DataFrame, bank: DataFrame) -> DataFrame:
    """Matches, accuracy, false-match and unmatched rate at 14 thresholds.

    Queries are first counted by how many thresholds their score clears, so at
    most 30 rows are spread over the thresholds.
    """
    stored = bank.select("bank_pos", F.col("label").alias("bank_label"))
    levels = F.array(*[F.lit(t) for t in THRESHOLDS])
    cleared = F.size(F.filter(levels, lambda t: F.round(F.col("score"), 10) >= t))
    counts = (
        scored.join(stored, "bank_pos", "left")
        .groupBy(cleared.alias("cleared"), F.coalesce(F.col("label") == F.col("bank_label"), F.lit(False)).alias("right"))
        .agg(count_rows().alias("n"))
    )
    steps = counts.select("cleared", "right", "n", F.posexplode(levels).alias("step", "threshold"))
    hit = F.col("step") < F.col("cleared")
    n = F.sum("n")
    matched = F.sum(F.when(hit, F.col("n")).otherwise(0))
    right = F.sum(F.when(hit & F.col("right"), F.col("n")).otherwise(0))
    return steps.groupBy("threshold").agg(
        matched.alias("n_matched"),
        F.when(matched > 0, F.round(right / matched, 4)).alias("match_accuracy"),
        F.when(matched > 0, F.round((matched - right) / n, 4)).alias("false_match_rate"),
        F.when(matched > 0, F.round((n - matched) / n, 4)).otherwise(F.lit(1.0)).alias("unmatched_rate"),
    )


def best_score_stats(scored: DataFrame) -> DataFrame:
    """Distribution of the best scores, zeros included."""
    return scored.agg(
        F.round(F.avg("score"), 4).alias("mean_best_score"),
        F.round(F.stddev_pop("score"), 4).alias("std_best_score"),
        F.round(F.min("score"), 4).alias("min_best_score"),
        F.round(F.max("score"), 4).alias("max_best_score"),
    )


def choose_threshold(sweep: DataFrame) -> DataFrame:
    """Most accurate threshold that leaves at most half of the queries unmatched.

    Ties go to fewer unmatched queries, then to the lower threshold.
    """
    return (
        sweep.where(F.col("match_accuracy").isNotNull() & (F.col("unmatched_rate") <= 0.5))
        .orderBy(F.col("match_accuracy").desc(), "unmatched_rate", "threshold").limit(1)
    )
