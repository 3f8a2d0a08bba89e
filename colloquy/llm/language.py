"""Language identification by compression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import id_text, modest_batches, uniform, whole_text

#: For each language, so many passages of so many characters make its dictionary; drawn by a hash of id and text.
PASSAGES, PASSAGE_CHARS = 256, 500
#: Languages there may be: with the two numbers above, the bound on what is sent to the executors (128 MB).
MOST_LANGUAGES = 1000
#: Texts are encoded in blocks of so many bytes, each against the fresh dictionary, or long texts would teach themselves.
BLOCK_BYTES = 768
#: Below this lead of the best language over the next, in saved bytes per byte, the prediction counts as rejected.
LEAST_LEAD = 0.02
LEVEL = 6
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionary of each language, and how many documents it was seen in."""

    dictionaries: dict[str, bytes]
    rows: dict[str, int]


def letters(text: str | None) -> bytes:
    """Lower-cased runs of letters with single spaces between them."""
    return " ".join(_LETTERS.findall((text or "").lower())).encode()


class Encoder:
    """Compressors of a model, made once for a task."""

    def __init__(self, model: LanguageModel):
        self.compressors, self.rows = {}, model.rows
        for lang, content in sorted(model.dictionaries.items()):
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            self.compressors[lang] = zstandard.ZstdCompressor(
                dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False
            )

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the lead is wide enough; ``und`` without a letter.

        Equal sizes go to the language seen in more documents. The score is the
        lead of the best language over the second, in bytes of output per byte of
        input, scaled so that ``LEAST_LEAD`` gives one half.
        """
        folded = letters(text)
        if not folded or not self.compressors:
            return UNKNOWN, 0.0, False
        blocks = [folded[i:i + BLOCK_BYTES] for i in range(0, len(folded), BLOCK_BYTES)]
        sizes = sorted(
            (sum(len(c.compress(b)) for b in blocks), -self.rows[lang], lang) for lang, c in self.compressors.items()
        )
        if len(sizes) == 1:
            return sizes[0][2], 1.0, True
        lead = (sizes[1][0] - sizes[0][0]) / len(folded)
        return sizes[0][2], lead / (lead + LEAST_LEAD), lead >= LEAST_LEAD


def fit_languages(docs: DataFrame, lang: str = "lang", text: str = "text") -> LanguageModel:
    """One dictionary per language from passages of its documents.

    For each non-null language ``PASSAGES`` documents are drawn by hash, each
    text once, and of each a passage at a hashed place. Ranking stops at that
    number within each task before anything is shuffled, so a language with most
    of the documents is no burden.
    """
    whole = whole_text(text)
    place = uniform(F.md5(whole.cast("binary")), F.lit("place"))
    passage = F.substring(whole, (place * F.greatest(F.lit(1), F.length(whole) - PASSAGE_CHARS)).cast("int") + 1, F.lit(PASSAGE_CHARS))
    known = docs.where(F.col(lang).isNotNull())
    rows = known.where(F.length(F.trim(whole)) > 0).select(
        F.col(lang).cast("string").alias("lang"), uniform(F.md5(whole.cast("binary")), F.lit("fit")).alias("draw"),
        passage.alias("passage"),
    ).groupBy("lang", "draw").agg(F.first("passage").alias("passage"))
    first = Window.partitionBy("lang").orderBy("draw", "passage")
    drawn = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= PASSAGES)
    content = drawn.groupBy("lang").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("draw", "passage"))), lambda x: x["passage"]), "\n").alias("content")
    )
    found = content.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages are labelled")
    counted = known.groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()
    return LanguageModel({row.lang: letters(row.content) for row in found}, {row.lang: row.n for row in counted})


def predict_languages(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` for every row.

    The whole text is encoded with each language's dictionary, and the smallest
    output wins; a narrow lead leaves ``accepted`` false. Null texts and texts
    without a letter are ``und`` with score 0, as is every text when no language
    was learned. Rows are independent: no shuffle, ids may be null or repeated.
    """
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        for batch in batches:
            rows = [encoder.predict(text) for text in batch["text"]]
            found = pd.DataFrame(rows, columns=["lang_pred", "score", "accepted"])
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), found], axis=1)

    base = docs.select(id_text(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = base.mapInPandas(run, "doc_id string, lang_pred string, score double, accepted boolean")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
