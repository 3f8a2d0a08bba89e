"""The registered query of each operator, and the SQL it must equal where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import (
    chat, collocations, decontaminate, exact_dedup, language, licenses, line_dedup, lm_score, mixing, near_dedup, substring_dedup,
    toxicity, vector_codes,
)
from colloquy.llm.common import documents
from colloquy.session import materialize

SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of ``benchmark`` found in ``documents``."""
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of ``documents`` that stand in more than one of them."""
    return substring_dedup.repeated_passages(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 code points or more that five documents hold."""
    done = line_dedup.dedup_lines(documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of ``documents`` brought to equal shares, 1.5 copies per document in the mean."""
    mixed = mixing.mix_sources(documents(spark, sf_dir), total_repetitions=1.5, seed=SEED)
    return mixed.select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"), mixing.COPY, mixing.POSITION)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document."""
    return licenses.scan_licenses(documents(spark, sf_dir))


def held_out(doc_id: str, folds: int) -> Column:
    """Whether the CRC-32 of the id as text is divisible by ``folds``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    docs = documents(spark, sf_dir)
    model = language.fit_languages(docs.where(~held_out("doc_id", 5)))
    found = language.predict_languages(docs, model)
    return found.select("doc_id", held_out("doc_id", 5).alias("held_out"), "lang_pred", "score", "accepted")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents``."""
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def toxicity_chain(spark: SparkSession, sf_dir: str) -> toxicity.Chain:
    """The chain low quality, toxic, fitted on ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.fit_chain(documents(spark, sf_dir), labels)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities of every document, and whether it is rejected as toxic."""
    scored = toxicity.score_toxicity(documents(spark, sf_dir), toxicity_chain(spark, sf_dir))
    return scored.select("doc_id", "toxicity.*").select(
        "doc_id", F.col("low_quality").alias("p_low_quality"), F.col("toxic").alias("p_toxic"),
        (F.col("toxic") >= 0.5).alias("rejected"),
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and backoff scores of every document, learned from nine tenths of them."""
    scored = lm_score.score_documents(documents(spark, sf_dir), ~held_out("doc_id", 10))
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of ``documents``."""
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and one of control strings, formatted, and what reading them back gives."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    awkward = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"),
    )
    return chat.digest_formatted(chat.format_conversations(turns.unionByName(awkward)), ordered=True)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of each language of ``documents``."""
    return collocations.collocations(documents(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all ``embeddings`` and their errors."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    books = vector_codes.fit_codebooks(rows)
    coded = materialize(vector_codes.encode(rows, books).select("vec_id", "label", "code", "error"), "vector-codes")
    done = vector_codes.with_label_error(coded)
    return done.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_decontamination, op2_substring_dedup, op3_line_dedup, op4_mixing, op5_licenses, op6_language, op7_near_dedup,
        op8_toxicity, op9_lm_score, op10_exact_dedup, op11_chat_format, op12_collocations, op13_vector_codes,
    )
}

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_LINES = rf"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, {_FOLD.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.*, coalesce(k.doc_id <> r.keeper, false) AS gone FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_NEAR = rf"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM tokens
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), named AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN named USING (doc_id) LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

_UNIFORM = "(('0x' || substr(md5({0}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"

_MIXING = f"""
WITH RECURSIVE rates AS (
  SELECT source, 1.5 * (SELECT count(*) FROM documents) / count(*)
         / (SELECT count(*) FROM (SELECT DISTINCT source FROM documents)) AS rate
  FROM documents GROUP BY source
), steps AS (
  SELECT source, rate, 0 AS k, -rate AS log_p, exp(-rate) AS total FROM rates
  UNION ALL
  SELECT source, rate, k + 1, log_p + ln(rate / (k + 1)), total + exp(log_p + ln(rate / (k + 1))) FROM steps
  WHERE k < CAST(floor(rate + 12 * sqrt(rate) + 24) AS INT)
), counted AS (
  SELECT d.doc_id, d.source, d.n_chars, d.text, count(s.k) AS times
  FROM documents d LEFT JOIN steps s
    ON s.source IS NOT DISTINCT FROM d.source
   AND s.total <= {_UNIFORM.format(f"d.doc_id || '|{SEED}'")}
  GROUP BY ALL
)
SELECT doc_id, source, n_chars, sha256(text) AS text_sha256, copy_no::INT AS copy_no,
       {_UNIFORM.format(f"doc_id || '|' || copy_no || '|order{SEED}'")} AS shuffle_key
FROM (SELECT *, unnest(range(1, times + 1)) AS copy_no FROM counted)
"""

_KNOWN = ", ".join(f"('{text}', '{name}')" for name, text in licenses.SENTENCES.items())


def _license_rule(name: str, rule: tuple[str, ...]) -> str:
    """Rows of documents in which the sentences of one rule occur in order."""
    tables = ", ".join(f"found f{i}" for i in range(len(rule)))
    tests = [f"f{i}.sentence_id = '{x}'" for i, x in enumerate(rule)]
    tests += [f"f{i}.doc_id = f0.doc_id AND f{i}.pos > f{i - 1}.pos" for i in range(1, len(rule))]
    return f"SELECT DISTINCT f0.doc_id, '{name}' AS license FROM {tables} WHERE {' AND '.join(tests)}"


_LICENSES = rf"""
WITH known(sentence, sentence_id) AS (VALUES {_KNOWN}),
pieces AS (
  SELECT doc_id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[.!?;:]+\s+|[.!?;:]+$|\n+') AS parts FROM documents)
), found AS (
  SELECT doc_id, pos, sentence_id FROM pieces
  JOIN known ON known.sentence = trim(regexp_replace(lower(piece), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))
), matched AS ({" UNION ".join(_license_rule(name, rule) for name, rule in licenses.RULES)})
SELECT d.doc_id,
  (SELECT count(*) FROM found f WHERE f.doc_id = d.doc_id)::INT AS n_sentences,
  coalesce((SELECT string_agg(sentence_id, ',' ORDER BY pos) FROM found f WHERE f.doc_id = d.doc_id), '') AS sentence_ids,
  coalesce((SELECT string_agg(license, ',' ORDER BY license) FROM matched m WHERE m.doc_id = d.doc_id), '') AS licenses
FROM documents d
"""

_EXACT = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')))::BIGINT
    AS formatted_chars
FROM turns GROUP BY conv_id
"""

_PHRASES = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece,
         regexp_extract_all(unnest(regexp_split_to_array({_FOLD.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
counted AS (
  {" UNION ALL ".join(f"""SELECT lang, {k} AS size, phrase, count(*) AS f FROM (
    SELECT lang, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) AS phrase
    FROM pieces WHERE len(w) >= {k}) GROUP BY lang, phrase HAVING count(*) >= 100""" for k in range(1, 6))}
), parts AS (SELECT *, string_split(phrase, ' ') AS w FROM counted),
cuts AS (
  SELECT p.lang, p.phrase, p.size, k, p.f AS a, l.f AS l, r.f AS r, t.n,
         ((1000::HUGEINT * p.f * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM parts WHERE size > 1) p
  JOIN counted l ON l.lang = p.lang AND l.phrase = array_to_string(p.w[1:k], ' ')
  JOIN counted r ON r.lang = p.lang AND r.phrase = array_to_string(p.w[k + 1:], ' ')
  JOIN totals t ON t.lang = p.lang
), weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM weakest c WHERE NOT EXISTS (
    SELECT 1 FROM counted x WHERE x.lang = c.lang AND x.size > c.size AND x.f >= c.a AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


def _code_rounds() -> str:
    """Codebooks after each round of assignment and means, and the last assignment."""
    steps = []
    for r in range(vector_codes.ROUNDS + 1):
        steps.append(f"""near{r} AS (
  SELECT vec_id, row_no, part, entry, distance FROM (
    SELECT v.vec_id, v.row_no, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x))::BIGINT AS distance
    FROM cells v JOIN books{r} b ON b.part = v.part AND b.place = v.place GROUP BY v.vec_id, v.row_no, v.part, b.entry)
  QUALIFY row_number() OVER (PARTITION BY row_no, part ORDER BY distance, entry) = 1
)""")
        if r < vector_codes.ROUNDS:
            steps.append(f"""books{r + 1} AS (
  SELECT b.part, b.entry, b.place, coalesce(m.x, b.x) AS x FROM books{r} b LEFT JOIN (
    SELECT part, entry, place, ((s - ((s % c) + c) % c) // c)::BIGINT AS x FROM (
      SELECT n.part, n.entry, v.place, sum(v.x)::HUGEINT AS s, count(*)::HUGEINT AS c
      FROM near{r} n JOIN cells v ON v.row_no = n.row_no AND v.part = n.part GROUP BY n.part, n.entry, v.place)
  ) m ON m.part = b.part AND m.entry = b.entry AND m.place = b.place
)""")
    return ",\n".join(steps)


_CODES = f"""
WITH vectors AS (
  SELECT row_number() OVER () AS row_no, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS (
  SELECT row_no, vec_id, (i - 1) // (len(embedding) // {vector_codes.PARTS}) AS part, (i - 1) % (len(embedding) // {vector_codes.PARTS}) AS place,
         floor({vector_codes.SCALE} * embedding[i]::DOUBLE)::BIGINT AS x
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM vectors)
), books0 AS (
  SELECT part, entry, place, x FROM cells JOIN (
    SELECT row_no, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM vectors ORDER BY vec_id LIMIT {vector_codes.ENTRIES}) USING (row_no)
),
{_code_rounds()}
SELECT v.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY v.label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) FROM books{vector_codes.ROUNDS}) AS codebooks_sha256
FROM vectors v JOIN (
  SELECT row_no, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error
  FROM near{vector_codes.ROUNDS} GROUP BY row_no
) c USING (row_no)
"""

ORACLES: dict[str, str] = {
    "op3_line_dedup": _LINES, "op4_mixing": _MIXING, "op5_licenses": _LICENSES,
    "op7_near_dedup": _NEAR, "op10_exact_dedup": _EXACT,
    "op11_chat_format": _CHAT, "op12_collocations": _PHRASES, "op13_vector_codes": _CODES,
}
