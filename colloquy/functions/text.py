"""Text expressions. Everything here stays inside the JVM.

Character classes are written as Unicode categories because Java's ``\\w`` and
``\\s`` are ASCII only, while the texts are multilingual.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
BLANK = r"\s\p{Z}\x85\x1C-\x1F"

# Classes are tried from left to right, so common characters come first.
NOT_WORD_OR_BLANK = f"[^a-z {WORD}{BLANK}]"
BLANKS = f"[{BLANK}]+"
# Runs that are not already one plain space; single spaces need no rewriting.
IRREGULAR_BLANKS = f"[{BLANK}]{{2,}}|[{BLANK}&&[^ ]]"
AUDIT_TOKEN = f"[a-z'{WORD}]+"
MODEL_TOKEN = f"[a-z{WORD}]{{2,}}"
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"
# The whitespace characters that stripping removes.
BLANK_CHARACTERS = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
REASONING_BLOCK = r"(?is)<think>.*?</think>\s*"
SENTENCE = r"([^.!?]+[.!?]*)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove leading and trailing whitespace of any kind; only the ends are read."""
    return F.trim(_col(c), F.lit(BLANK_CHARACTERS))


def is_blank(c: Column | str) -> Column:
    """True for null, empty or whitespace-only text."""
    c = _col(c)
    return c.isNull() | (strip(c) == "")


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, NOT_WORD_OR_BLANK, ""), IRREGULAR_BLANKS, " ")


def normalize(c: Column | str) -> Column:
    """Key used by the audit and the split: strip first, then drop punctuation.

    A leading dash therefore leaves one leading space behind.
    """
    return _bare(strip(F.lower(_col(c))))


def normalize_strict(c: Column | str) -> Column:
    """Key used by the validator: as :func:`normalize`, but stripped last."""
    return strip(_bare(F.lower(_col(c))))


def words(c: Column | str) -> Column:
    """Whitespace-separated tokens."""
    return F.filter(F.split(_col(c), BLANKS), lambda x: x != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c)).cast("long")


def char_count(c: Column | str) -> Column:
    return F.char_length(_col(c)).cast("long")


def punctuation_count(c: Column | str) -> Column:
    """Number of ASCII punctuation characters: the length lost by removing them."""
    c = _col(c)
    return (F.char_length(c) - F.char_length(F.regexp_replace(c, ASCII_PUNCTUATION, ""))).cast("long")


def token_set(c: Column | str) -> Column:
    """Distinct lower-case whitespace tokens."""
    return F.array_distinct(words(F.lower(_col(c))))


def audit_tokens(c: Column | str) -> Column:
    """Lower-case runs of word characters and ``'``; everything else separates."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(AUDIT_TOKEN), F.lit(0))


def model_tokens(c: Column | str) -> Column:
    """Lower-case word tokens of at least two characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(MODEL_TOKEN), F.lit(0))


def bigrams(tokens: Column) -> Column:
    """Adjacent token pairs joined by one space."""
    n = F.size(tokens)
    pairs = F.zip_with(
        F.slice(tokens, 1, n - 1), F.slice(tokens, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b)
    )
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def ngrams_1_2(tokens: Column) -> Column:
    """Unigrams followed by bigrams."""
    return F.concat(tokens, bigrams(tokens))


def digest(c: Column | str) -> Column:
    """32-byte SHA-256 of a text: shuffles move this instead of whole texts."""
    return F.unhex(F.sha2(_col(c), 256))


def row_digest(columns: list[str]) -> Column:
    """Digest of several columns; null and empty stay different."""
    return digest(F.to_json(F.struct(*[F.col(c) for c in columns])))


def hash_mod(c: Column, n: int) -> Column:
    """SHA-256 of ``c`` read as one large integer, modulo ``n`` (n < 2**31).

    Folds the 64 hex digits eight at a time so that no big integer is needed.
    """
    hexed = F.sha2(c, 256)
    base = (1 << 32) % n
    acc = F.lit(0).cast("long")
    for i in range(8):
        part = F.conv(F.substring(hexed, 1 + 8 * i, 8), 16, 10).cast("long")
        acc = (acc * base + part) % n
    return acc


def pick(options: Column, n: int, session_id: Column | str, message: Column | str) -> Column:
    """Reproducible choice from an array of ``n`` options."""
    key = F.concat(_col(session_id), F.lit(":"), _col(message))
    return F.element_at(options, (hash_mod(key, n) + 1).cast("int"))


def same_text(a: Column, b: Column) -> Column:
    """Equality ignoring case and outer whitespace."""
    return F.lower(strip(a)) == F.lower(strip(b))


def passes_quality_gate(reply: Column | str, message: Column | str) -> Column:
    """A reply must be non-blank and must not echo the message."""
    reply, message = _col(reply), _col(message)
    return ~is_blank(reply) & ~F.coalesce(same_text(reply, message), F.lit(False))


def strip_reasoning(c: Column | str) -> Column:
    """Drop ``<think>…</think>`` blocks and outer whitespace."""
    return strip(F.regexp_replace(_col(c), REASONING_BLOCK, ""))


def sentences(c: Column | str) -> Column:
    """Trimmed sentence fragments, each with its end marks."""
    found = F.regexp_extract_all(_col(c), F.lit(SENTENCE), 1)
    return F.filter(F.transform(found, strip), lambda s: s != "")


def tail_run(parts: Column) -> Column:
    """How often the last sentence repeats, without a break, at the end."""
    last = F.element_at(parts, -1)
    run = F.aggregate(
        parts,
        F.lit(0),
        lambda acc, s: F.when(s == last, acc + 1).otherwise(F.lit(0)),
    )
    return F.when(F.size(parts) > 0, run).otherwise(F.lit(0)).cast("long")


def repaired_tail(parts: Column, run: Column) -> Column:
    """The sentences with a repeated tail collapsed to one copy."""
    keep = (F.size(parts) - F.greatest(run - 1, F.lit(0))).cast("int")
    return F.array_join(F.slice(parts, F.lit(1), keep), " ")
