"""Language-model scores by interpolated n-gram counts over the whole corpus, equal to those of a backoff automaton."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import id_text, mixed, modest_batches, row_key, slices, stable_hash, whole_text, words

ORDER = 2
#: Added to each token's count at the root of the automaton.
ADDED = 0.1
#: Weight of the shorter context, in counts: a state seen ``n`` times fails with probability ``MASS / (n + MASS)``.
MASS = 30.0
#: Text that documents are gathered to and n-grams are dealt out by, in bytes.
BLOCK_BYTES = 4_000_000
_START, _END = np.uint64(0x51AB5C1F20D6E3A1), np.uint64(0x7E4D9C0B36F815AF)


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, one start before and one end after each text, and the number of each text's tokens."""
    lists = [words(text) for text in texts]
    hashes = stable_hash([w for one in lists for w in one])
    sizes = np.array([len(one) + 2 for one in lists], dtype=np.int64)
    out = np.empty(int(sizes.sum()), dtype=np.uint64)
    starts = np.cumsum(sizes) - sizes
    inner = np.ones(len(out), dtype=bool)
    inner[starts] = inner[starts + sizes - 1] = False
    out[starts], out[starts + sizes - 1], out[inner] = _START, _END, hashes
    return out, sizes


def grams(tokens: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length up to ``order``, the key of the n-gram that ends at each token; 0 where the text has none."""
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys = [mixed(tokens)]
    for n in range(2, order + 1):
        before = np.concatenate([keys[-1][:1], keys[-1][:-1]])
        longer = mixed(before + mixed(tokens + np.uint64(n)))
        keys.append(np.where(place < n - 1, np.uint64(0), longer))
    return keys


def _spare_bits(buckets: int) -> np.uint64:
    """Low bits that keys do without, so that a key's offset in its bucket has 48 bits.

    Buckets grow with the corpus, and a bucket keeps its size; so the chance that
    two n-grams share a key stays near one in 10^9.
    """
    return np.uint64(max(0, 16 - (int(buckets).bit_length() - 1)))


def _cut(keys: np.ndarray, buckets: int) -> list[tuple[int, slice, bytes]]:
    """Equal ranges of sorted short keys: bucket, place in ``keys``, and 6 bytes of offset for each key."""
    spare = _spare_bits(buckets)
    starts = np.array([-(-(i << 32) // buckets) for i in range(buckets)], dtype=np.uint64) << (np.uint64(32) - spare)
    places = [*np.searchsorted(keys, starts).tolist(), len(keys)]
    out = []
    for i, (a, b) in enumerate(zip(places, places[1:])):
        if b > a:
            offsets = (keys[a:b] - starts[i]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            out.append((i, slice(a, b), offsets.tobytes()))
    return out


def _offsets(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _small(counts: np.ndarray) -> bytes:
    """Counts as one byte each, those from 255 on as 255 and again in full at the end; most counts are small."""
    large = counts[counts >= 255].astype("<u8").tobytes()
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + large


def _counts(packed: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(packed, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(packed, "<u8", offset=n).astype(np.int64)
    return counts


def _block_keys(group: pd.DataFrame, order: int, buckets: int):
    """Tokens of a block, its distinct short keys in order, and for each n-gram length the place of each token's key."""
    tokens, sizes = token_hashes(group["text"].tolist())
    by_length = grams(tokens, sizes, order)
    keys, at = np.unique(np.concatenate(by_length) >> _spare_bits(buckets), return_inverse=True)
    return tokens, sizes, [own != 0 for own in by_length], keys, np.split(at, order)


def _counted(order: int, buckets: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For one block, its distinct n-grams with their counts in training texts, cut into buckets."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        _, sizes, present, keys, places = _block_keys(group, order, buckets)
        learned = np.repeat(group["train"].to_numpy(dtype=bool), sizes)
        seen = np.concatenate([at[learned & own] for at, own in zip(places, present)])
        counts = np.bincount(seen, minlength=len(keys))
        rows = [(int(group["block"].iloc[0]), i, offsets, _small(counts[own])) for i, own, offsets in _cut(keys, buckets)]
        return pd.DataFrame(rows, columns=["block", "bucket", "keys", "counts"])

    return run


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    """For one bucket, the counts of its n-grams over all blocks, given back to each block in its own order."""
    sizes = [len(x) // 6 for x in group["keys"]]
    keys = np.concatenate([_offsets(x) for x in group["keys"]])
    counts = np.concatenate([_counts(x, n) for x, n in zip(group["counts"], sizes)])
    _, at = np.unique(keys, return_inverse=True)
    totals = np.bincount(at, weights=counts).astype(np.int64)[at]
    parts = [_small(part) for part in np.split(totals, np.cumsum(sizes)[:-1])]
    return pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "n": sizes, "totals": parts})


def _scored(
    order: int, buckets: int, mass: float, tokens_seen: int, types_seen: int,
) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Scores of the texts of one block, all tokens at once.

    No state is carried. What an automaton would give by the arc of a seen n-gram
    and the failure arcs from the longest context down to the root is computed as
    ``p(w | context) = (c(context w) + mass * p(w | shorter)) / (c(context) + mass)``.
    """
    root = tokens_seen + ADDED * (types_seen + 1)

    def run(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        tokens, sizes, present, _, places = _block_keys(group, order, buckets)
        answers = answers.sort_values("bucket")
        totals = np.concatenate([_counts(x, n) for x, n in zip(answers["totals"], answers["n"])])
        document = np.repeat(np.arange(len(sizes)), sizes)
        predicted = np.ones(len(tokens), dtype=bool)
        predicted[np.cumsum(sizes) - sizes] = False
        seen = [np.where(own, totals[at], 0) for at, own in zip(places, present)]
        base = (seen[0] + ADDED) / root
        chance = base
        for n in range(1, order):
            context = np.concatenate([[0], seen[n - 1][:-1]])
            chance = np.where(present[n], (seen[n] + mass * chance) / (context + mass), chance)

        def total(values: np.ndarray) -> np.ndarray:
            return np.bincount(document[predicted], weights=values[predicted], minlength=len(sizes))

        return pd.DataFrame({
            "doc_id": group["doc_id"], "train": group["train"], "n_tokens": sizes - 1,
            "n_known": total(seen[0] > 0).astype(np.int64),
            "base_score": total(np.log10(base)), "score": total(np.log10(chance)),
        })

    return run


def _words_seen(buckets: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per task, the distinct tokens of training texts by bucket, and (bucket -1) how many tokens there are."""

    def rows_of(found: np.ndarray, n: int) -> pd.DataFrame:
        rows = [(i, offsets, 0) for i, _, offsets in _cut(np.unique(found >> _spare_bits(buckets)), buckets)]
        return pd.DataFrame([*rows, (-1, b"", n)], columns=["bucket", "words", "tokens"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, n = np.zeros(0, np.uint64), 0
        for batch in batches:
            for part in slices(batch["text"].str.len().tolist(), BLOCK_BYTES):
                tokens, sizes = token_hashes(batch["text"].iloc[part].tolist())
                n += len(tokens) - len(sizes)
                found = np.union1d(found, mixed(tokens[tokens != _START]))
                if len(found) > 2_000_000:
                    yield rows_of(found, n)
                    found, n = found[:0], 0
        yield rows_of(found, n)

    return run


def _types(group: pd.DataFrame) -> pd.DataFrame:
    words_ = np.concatenate([_offsets(x) for x in group["words"]])
    return pd.DataFrame({"types": [len(np.unique(words_))], "tokens": [int(group["tokens"].sum())]})


def score_documents(
    docs: DataFrame, train: Column, order: int = ORDER, mass: float = MASS, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Log10 probability of every whole text, under a model learned from the rows where ``train`` holds.

    Tokens are the words between ASCII white space, A-Z lower-cased, and one end.
    N-grams up to ``order`` are counted over all training texts and smoothed: the
    states of the automaton are contexts, its arcs the seen n-grams, and a
    failure arc leads from each context to the shorter one.

    The model grows with the corpus, so it is never sent out whole. Documents
    are dealt by hash into blocks of about ``BLOCK_BYTES``; a block sends its
    distinct n-grams, with its own training counts, to buckets of equal key
    ranges; a bucket adds them up and gives every block the totals it asked for;
    then each block scores its texts. Blocks and buckets grow
    in number, not in size. A word or pair that is everywhere costs one key per
    block. N-grams are known by hashes of 55 bits and more.

    Returns ``doc_id, train, n_tokens, n_known`` (tokens seen in training),
    ``train_tokens, base_score`` (unigrams with 0.1 added) and ``score``. Null
    text counts as empty and has the end token alone. Null or repeated ids are
    rows like any other. Without training rows every token has the same chance.
    """
    modest_batches(docs.sparkSession)
    base = docs.select(
        id_text(doc_id).alias("doc_id"), whole_text(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"),
        row_key(doc_id, text).alias("key"),
    )
    size = base.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = max(1, -(-size // BLOCK_BYTES))
    words_seen = base.where("train").select("text").mapInPandas(_words_seen(parts), "bucket bigint, words binary, tokens bigint")
    seen = (
        words_seen.groupBy("bucket").applyInPandas(_types, "types bigint, tokens bigint")
        .agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).first()
    )
    tokens_seen, types_seen = seen.tokens or 0, seen.types or 0
    blocks = base.select("doc_id", "text", "train", F.pmod(F.xxhash64("key"), F.lit(parts)).alias("block"))
    counted = blocks.groupBy("block").applyInPandas(
        _counted(order, parts), "block bigint, bucket bigint, keys binary, counts binary"
    )
    totals = counted.groupBy("bucket").applyInPandas(_summed, "block bigint, bucket bigint, n bigint, totals binary")
    scored = blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInPandas(
        _scored(order, parts, mass, tokens_seen, types_seen),
        "doc_id string, train boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return scored.withColumns({
        "doc_id": F.col("doc_id").cast(docs.schema[doc_id].dataType), "train_tokens": F.lit(tokens_seen).cast("long"),
    })
