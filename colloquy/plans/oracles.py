"""Plain SQL for each query, run by an independent engine on the same tables.

The SQL states the obvious form of each result (windows over whole sessions,
all query/bank pairs), not the way the Spark jobs are laid out.
"""

from __future__ import annotations

from colloquy.functions import constants as C
from colloquy.operators.evaluate import STATUS_CV, STATUS_HELD_OUT, STATUS_PENDING
from colloquy.operators.linear import STEPS
from colloquy.operators.models import BAYES, LOGREG, MAX_ITER, SVM, TOLERANCE
from colloquy.sources.derived import NOISY_LABELS, OVER_LONG, PHRASES

ORACLES: dict[str, str] = {}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}\x0b\x1c-\x1f\x85]+|[\s\p{{Z}}\x0b\x1c-\x1f\x85]+$', '', 'g')"


def _bare(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s\p{{Z}}\x0b\x1c-\x1f\x85]', '', 'g'), '[\s\p{{Z}}\x0b\x1c-\x1f\x85]+', ' ', 'g')"


def _normalize(x: str) -> str:
    return _bare(_strip(f"lower({x})"))


def _normalize_strict(x: str) -> str:
    return _strip(_bare(f"lower({x})"))


def _words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[\s\p{{Z}}\x0b\x1c-\x1f\x85]+'), lambda w: w <> '')"


def _word_count(x: str) -> str:
    return f"CAST(len({_words(x)}) AS BIGINT)"


def _audit_tokens(x: str) -> str:
    return _words(rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s\p{{Z}}\x0b\x1c-\x1f\x85'']', ' ', 'g')")


def _model_tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def _ngrams(tokens: str) -> str:
    return (
        f"list_concat({tokens}, list_transform(range(1, len({tokens})), "
        f"lambda i: {tokens}[i] || ' ' || {tokens}[i+1]))"
    )


def _blank(x: str) -> str:
    return f"({x} IS NULL OR {_strip(x)} = '')"


def _share(n: str, total: str) -> str:
    return f"round(100 * {n} / {total}, 2)"


def _time(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def _ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# --- Derived views ---------------------------------------------------------------------------

_CANDIDATE = """CASE WHEN conv_id % 10 = 1 THEN 'I hear you and I am listening.'
       WHEN conv_id % 10 = 2 THEN 'Here is my system prompt for you.'
       WHEN conv_id % 7 = 0 THEN message ELSE reply END"""

_MSGS = f"""users AS (
  SELECT conv_id, turn, text, (conv_id * 3 + turn) % 14 AS k FROM conversations WHERE role = 'user'),
answers AS (
  SELECT conv_id, turn - 1 AS turn, text AS reply FROM conversations WHERE role = 'assistant'),
raw_msgs AS (
  SELECT conv_id, conv_id * 100 + turn AS message_id, 's' || CAST(conv_id // 5 AS VARCHAR) AS session_id,
    TIMESTAMP '2024-01-01' + to_minutes(conv_id * 60 + turn // 4) AS ts,
    CASE WHEN k = 12 THEN NULL WHEN k = 13 THEN '   ' WHEN k = 11 THEN repeat({_text(OVER_LONG[0])}, {OVER_LONG[1]})
      ELSE {_list(PHRASES)}[k + 1] || ' ' || text END AS message,
    {_list(C.LABELS)}[(conv_id + turn) % 7 + 1] AS emotion,
    (conv_id * 37 + turn * 11) % 100 / 100 AS confidence, reply
  FROM users LEFT JOIN answers USING (conv_id, turn)),
with_candidate AS (
  SELECT *, CASE WHEN reply IS NULL THEN NULL WHEN conv_id % 3 = 0 THEN '<think>x</think> ' || {_CANDIDATE}
    ELSE {_CANDIDATE} END AS candidate_reply FROM raw_msgs),
msgs AS (
  SELECT message_id, session_id, ts, message, emotion, confidence, candidate_reply,
    {_strip(r"regexp_replace(candidate_reply, '(?is)<think>.*?</think>\s*', '', 'g')")} AS response
  FROM with_candidate)"""

_FEEDBACK = """votes AS (
  SELECT mid AS message_id, CAST(mid % 2 AS BIGINT) AS helpful FROM (SELECT conv_id * 100 + turn AS mid FROM conversations WHERE role = 'user')
  UNION ALL SELECT -mid, 1 FROM (SELECT conv_id * 100 + turn AS mid FROM conversations WHERE role = 'user')
  UNION ALL SELECT mid, 2 FROM (SELECT conv_id * 100 + turn AS mid FROM conversations WHERE role = 'user') WHERE mid % 11 = 0),
feedback AS (SELECT * FROM votes WHERE message_id <> 0)"""

_LOG = """log AS (
  SELECT event_id, 'u' || CAST(user_id AS VARCHAR) AS session_id, ts,
    CASE event_type WHEN 'error' THEN 'validation_error' WHEN 'purchase' THEN 'faq_match'
      WHEN 'signup' THEN 'fallback' ELSE 'classifier_generated' END AS response_type,
    CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 5 = 0 THEN 'fear' ELSE event_type END AS emotion,
    CASE WHEN event_type <> 'error' THEN event_id % 100 / 100 END AS confidence,
    CASE WHEN event_type <> 'error' THEN round(value / 500, 4) END AS similarity,
    value / 1000 AS latency_seconds,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_length
  FROM events)"""

_CLEAN = "corpus AS (SELECT doc_id, text, lang AS label FROM documents)"
_NOISY = f"corpus AS (SELECT doc_id, text, {_list(NOISY_LABELS)}[doc_id % 8 + 1] AS label, source FROM documents)"
_PREDS = """preds AS (
  SELECT doc_id, text, lang AS label,
    CASE WHEN doc_id % 7 = 0 THEN 'en' WHEN doc_id % 11 = 0 THEN 'fr' ELSE lang END AS pred FROM documents)"""
_BANK = """bank AS (
  SELECT item_id AS bank_pos, text, 'c' || CAST(item_id % 5 AS VARCHAR) AS label,
    'Stored reply ' || CAST(item_id AS VARCHAR) AS reply FROM benchmark)"""
_ASKED = """asked AS (
  SELECT item_id AS query_id, 'c' || CAST(item_id % 5 AS VARCHAR) AS label,
    array_to_string(list_filter(string_split(text, ' '), lambda w, i: (i + item_id) % (2 + item_id % 6) <> 0), ' ') AS text
  FROM benchmark)"""

_VALID = f"""valid AS (
  SELECT * REPLACE ({_strip('message')} AS message) FROM msgs
  WHERE NOT {_blank('message')} AND length({_strip('message')}) <= {C.MAX_INPUT_CHARS})"""


def _over_sessions(frame: str) -> str:
    return f"OVER (PARTITION BY session_id ORDER BY ts, message_id {frame})"


# --- Scans -----------------------------------------------------------------------------------

ORACLES["corpus_scan"] = (
    "SELECT d.doc_id, d.text, d.lang AS label, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
)
ORACLES["log_scan"] = _ctes(_LOG) + f"SELECT * REPLACE ({_time('ts')} AS ts) FROM log"
ORACLES["session_messages"] = _ctes(_MSGS) + (
    f"SELECT message_id, session_id, {_time('ts')} AS ts, message, response FROM msgs WHERE session_id = 's3' ORDER BY ts, message_id"
)

# --- Text ------------------------------------------------------------------------------------

ORACLES["normalize_text"] = f"SELECT doc_id, {_normalize('text')} AS normalized FROM documents"
ORACLES["normalize_text_strict"] = f"SELECT doc_id, {_normalize_strict('text')} AS normalized FROM documents"
ORACLES["audit_tokens"] = f"SELECT doc_id, array_to_string({_audit_tokens('text')}, ' ') AS tokens FROM documents"

_LENGTHS = rf"""lengths AS (
  SELECT doc_id, label, CAST(length(text) AS BIGINT) AS char_count, {_word_count('text')} AS word_count,
    CAST(length(regexp_replace(text, '[^!-/:-@\[-`{{-~]', '', 'g')) AS BIGINT) AS punct_count FROM corpus)"""
ORACLES["text_lengths"] = _ctes(_CLEAN, _LENGTHS) + "SELECT doc_id, char_count, word_count, punct_count FROM lengths"
ORACLES["model_ngrams"] = (
    f"SELECT item_id, array_to_string({_ngrams('t')}, '|') AS ngrams FROM (SELECT item_id, {_model_tokens('text')} AS t FROM benchmark)"
)
ORACLES["token_sets"] = (
    f"SELECT item_id, array_to_string(list_sort(list_distinct({_words('lower(text)')})), ' ') AS tokens FROM benchmark"
)


def _pick(n: int, x: str = "session_id || ':' || message") -> str:
    digits = f"list_transform(range(1, 65), lambda i: instr('0123456789abcdef', substr(sha256({x}), i, 1)) - 1)"
    return f"CAST(list_reduce({digits}, lambda a, d: (a * 16 + d) % {n}, 0) AS BIGINT)"


def _template(label: str, banks: dict, default) -> str:
    cases = " ".join(f"WHEN {_text(k)} THEN {_list(v)}[{_pick(len(v))} + 1]" for k, v in banks.items())
    return f"CASE {label} {cases} ELSE {_list(default)}[{_pick(len(default))} + 1] END"


ORACLES["template_pick"] = _ctes(_MSGS, _VALID) + (
    f"SELECT message_id, {_pick(2)} AS pick_of_2, {_pick(7)} AS pick_of_7, "
    f"{_template('emotion', C.REPLIES, C.LOW_CONFIDENCE_REPLIES)} AS reply FROM valid"
)
ORACLES["quality_gate"] = _ctes(_MSGS) + (
    f"SELECT message_id, NOT {_blank('response')} AND coalesce(lower({_strip('response')}) <> lower({_strip('message')}), true) AS passes "
    f"FROM msgs WHERE NOT {_blank('message')}"
)
ORACLES["strip_think"] = _ctes(_MSGS) + "SELECT message_id, response AS clean_reply FROM msgs"
ORACLES["repeated_tail"] = rf"""WITH replies AS (
  SELECT doc_id, text || repeat(' For now.', doc_id % 4) AS text FROM documents),
parts AS (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda s: {_strip('s')}), lambda s: s <> '') AS p FROM replies),
runs AS (
  SELECT doc_id, p, CASE WHEN len(p) = 0 THEN 0 ELSE
    len(p) - coalesce(list_max(list_filter(range(1, len(p) + 1), lambda i: p[i] <> p[len(p)])), 0) END AS run FROM parts)
SELECT doc_id, CAST(run AS BIGINT) AS run, run >= 2 AS is_repeated,
  array_to_string(p[1:len(p) - greatest(run - 1, 0)], ' ') AS repaired FROM runs"""

# --- Messages --------------------------------------------------------------------------------

_REASON = (
    f"CASE WHEN {_blank('message')} THEN {_text(C.EMPTY_MESSAGE)} WHEN length({_strip('message')}) > {C.MAX_INPUT_CHARS} "
    f"THEN {_text(C.LONG_MESSAGE.format(limit=C.MAX_INPUT_CHARS))} END"
)
ORACLES["validate_messages"] = _ctes(_MSGS) + (
    f"SELECT message_id, {_REASON} AS reason, CASE WHEN {_REASON} IS NULL THEN {_strip('message')} END AS clean_message FROM msgs"
)


def _hit(pattern: str, x: str = "message") -> str:
    return f"regexp_matches({x}, {_text('(?i)' + pattern)})"


def _level(x: str = "message") -> str:
    cases = " ".join(
        f"WHEN {' OR '.join(_hit(p, x) for p in patterns)} THEN {_text(level)}" for level, patterns in C.RISK_PATTERNS
    )
    return f"CASE {cases} ELSE {_text(C.NORMAL)} END"


_SIGNALS = "CASE " + " ".join(
    f"WHEN {' OR '.join(_hit(p) for p in patterns)} THEN array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {_hit(p)} THEN {_text(p)} END" for p in patterns)
    + "], lambda s: s IS NOT NULL), ' & ')"
    for _, patterns in C.RISK_PATTERNS
) + " ELSE '' END"
ORACLES["safety_routing"] = _ctes(_MSGS, _VALID) + f"SELECT message_id, {_level()} AS level, {_SIGNALS} AS signals FROM valid"
ORACLES["safety_routing_folded_quotes"] = _ctes(_MSGS, _VALID) + (
    f"SELECT message_id, {_level('q')} AS level FROM (SELECT message_id, replace(replace(message, '‘', ''''), '’', '''') AS q FROM valid)"
)


def _any(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {_text(w)})" for w in needles) + ")"


_INTENT = (
    f"CASE WHEN {_any('lower(message)', C.NEED_WORDS)} THEN 'practical_need' "
    f"WHEN {_any('lower(message)', C.HELP_WORDS)} THEN 'support_request' "
    "WHEN contains(message, '?') OR " + " OR ".join(f"starts_with(lower(message), {_text(w)})" for w in C.QUESTION_STARTS)
    + f" THEN 'question' WHEN {_any('lower(message)', C.THANKS_WORDS)} THEN 'gratitude' ELSE 'check_in' END"
)
ORACLES["detect_intent"] = _ctes(_MSGS, _VALID) + f"SELECT message_id, {_INTENT} AS intent FROM valid"

_HISTORY = f"""past AS (
  SELECT *, list({{'id': message_id, 'm': message, 'r': response}}) {_over_sessions('ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING')} AS history
  FROM valid)"""
_REPLY_OK = (
    f"coalesce(length(response) BETWEEN {C.REPLY_MIN_CHARS} AND {C.REPLY_MAX_CHARS} "
    f"AND NOT {_any(f'lower(response)', C.BANNED_PHRASES)} "
    f"AND coalesce(lower({_strip('response')}) <> lower({_strip('message')}), true) "
    "AND len(list_filter(coalesce(history, []), lambda h: lower(h.r) = lower(response))) = 0, false)"
)
ORACLES["reply_validation"] = _ctes(_MSGS, _VALID, _HISTORY) + (
    f"SELECT message_id, {_REPLY_OK} AS reply_valid FROM past WHERE candidate_reply IS NOT NULL"
)
ORACLES["confidence_tiers"] = _ctes(_LOG) + """
SELECT CASE WHEN confidence IS NULL THEN NULL WHEN confidence < 0.5 THEN 'clarify'
  WHEN confidence < 0.8 THEN 'cautious' ELSE 'clear' END AS stance, count(*) AS n FROM log GROUP BY 1"""

_ROUTED = f"""routed AS (
  SELECT * FROM past),
judged AS (
  SELECT *, {_level()} AS risk_level, {_INTENT} AS intent, {_REPLY_OK} AS ok FROM routed)"""
_SAFE_REPLY = "CASE risk_level " + " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in C.SAFETY_REPLIES.items()) + " END"
_PRACTICAL = f"{_list(C.PRACTICAL_REPLIES)}[{_pick(2)} + 1]"
_LOW = f"{_list(C.LOW_CONFIDENCE_REPLIES)}[{_pick(2)} + 1]"
_LABELLED = _template("emotion", C.REPLIES, C.LOW_CONFIDENCE_REPLIES)
ORACLES["response_policy"] = _ctes(_MSGS, _VALID, _HISTORY, _ROUTED) + f"""
SELECT message_id, risk_level, intent,
  CASE WHEN risk_level <> 'normal' THEN 'safety_override' WHEN intent = 'practical_need' THEN 'practical_support'
    WHEN candidate_reply IS NULL THEN 'ollama_unavailable' WHEN ok THEN 'ollama_generated'
    ELSE 'ollama_validation_fallback' END AS response_type,
  CASE WHEN risk_level <> 'normal' THEN 'neutral' ELSE emotion END AS emotion,
  round(CASE WHEN risk_level <> 'normal' THEN 0.0 ELSE confidence END, 4) AS confidence,
  CASE WHEN risk_level <> 'normal' THEN {_SAFE_REPLY} WHEN intent = 'practical_need' THEN {_PRACTICAL}
    WHEN ok THEN response WHEN confidence < {C.LOW_CONFIDENCE} THEN {_LOW} ELSE {_LABELLED} END AS response
FROM judged"""
ORACLES["stored_messages"] = (
    _ctes(_MSGS, _VALID, _HISTORY, _ROUTED) + f"""
SELECT p.message_id, session_id, message, p.response, {_time('ts')} AS timestamp, p.emotion AS predicted_emotion, p.confidence,
  p.intent, p.risk_level, p.response_type, 'v1' AS model_version, round(length(message) / 10, 2) AS latency_ms
FROM judged JOIN ({ORACLES["response_policy"].split(_ctes(_MSGS, _VALID, _HISTORY, _ROUTED))[1]}) p USING (message_id)"""
)
_TEMPLATES_ONLY = _ctes(_MSGS, _VALID, f"judged AS (SELECT *, {_level()} AS risk_level, {_INTENT} AS intent FROM valid)") + f"""
SELECT message_id,
  CASE WHEN risk_level <> 'normal' THEN 'safety_override' WHEN intent = 'practical_need' THEN 'practical_support'
    ELSE 'llm_disabled' END AS response_type,
  CASE WHEN risk_level <> 'normal' THEN {_SAFE_REPLY} WHEN intent = 'practical_need' THEN {_PRACTICAL}
    WHEN confidence < {C.LOW_CONFIDENCE} THEN {_LOW} ELSE {_LABELLED} END AS response
FROM judged"""
ORACLES["response_policy_templates_only"] = _TEMPLATES_ONLY
ORACLES["stream_scoring"] = _TEMPLATES_ONLY
ORACLES["stream_quarantine"] = _ctes(_MSGS) + f"SELECT message_id, {_REASON} AS reason FROM msgs WHERE {_REASON} IS NOT NULL"
ORACLES["session_context"] = _ctes(_MSGS, _VALID, _HISTORY) + rf"""
SELECT message_id,
  CASE WHEN len(coalesce(history, [])) = 0 THEN '(none)' ELSE array_to_string(list_transform(history,
    lambda h: 'User: ' || coalesce(h.m, 'None') || chr(10) || 'Assistant: ' || coalesce(h.r, 'None')), chr(10)) END AS transcript,
  CASE WHEN confidence < 0.5 THEN {_text(C.STANCE_CLARIFY)} WHEN confidence < 0.8 THEN {_text(C.STANCE_CAUTIOUS)}
    ELSE {_text(C.STANCE_CLEAR)} END AS stance,
  printf('%.2f', confidence) AS confidence_text, emotion
FROM past"""
ORACLES["label_remap"] = _ctes(_LOG) + """
SELECT CASE emotion WHEN 'click' THEN 'joy' WHEN 'view' THEN 'surprise' WHEN 'purchase' THEN 'joy'
  WHEN 'fear' THEN 'fear' ELSE 'neutral' END AS label, count(*) AS n FROM log GROUP BY 1"""
ORACLES["session_last_n"] = _ctes(_MSGS) + f"""
SELECT session_id, message_id, {_time('ts')} AS ts FROM msgs
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, message_id DESC) <= {C.MEMORY_TURNS}"""
ORACLES["message_history"] = _ctes(_MSGS, _VALID, _HISTORY) + """
SELECT message_id, session_id, coalesce(array_to_string(list_transform(history, lambda h: CAST(h.id AS VARCHAR)), ','), '') AS history_ids FROM past"""
ORACLES["feedback_accept"] = _ctes(_MSGS, _FEEDBACK) + """
SELECT * FROM feedback WHERE helpful IN (0, 1) AND message_id IN (SELECT message_id FROM msgs)"""
ORACLES["feedback_reject"] = _ctes(_MSGS, _FEEDBACK) + """
SELECT message_id, helpful, CASE WHEN helpful NOT IN (0, 1) THEN 'invalid_vote' ELSE 'unknown_message' END AS reason
FROM feedback WHERE helpful NOT IN (0, 1) OR message_id NOT IN (SELECT message_id FROM msgs)"""
ORACLES["delete_session"] = _ctes(_MSGS) + "SELECT message_id, session_id FROM msgs WHERE session_id <> 's3'"
ORACLES["delete_session_count"] = _ctes(_MSGS) + "SELECT count(*) AS deleted_messages FROM msgs WHERE session_id = 's3'"
ORACLES["delete_session_cascade"] = _ctes(_MSGS, _FEEDBACK) + """
SELECT * FROM feedback WHERE message_id NOT IN (SELECT message_id FROM msgs WHERE session_id = 's3')"""
ORACLES["retention"] = (
    f"SELECT event_id, {_time('ts')} AS ts FROM events WHERE ts >= TIMESTAMP '2024-02-05 00:00:00' - INTERVAL {C.RETENTION_DAYS} DAY"
)

# --- Audit -----------------------------------------------------------------------------------


def _missing(view: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS missing, "
        f"count(*) FILTER ({c} IS NOT NULL AND {_strip(c)} = '') AS blank FROM {view}"
        for c in columns
    )


ORACLES["missing_and_blank"] = _ctes(_MSGS) + _missing("msgs", ["message", "candidate_reply", "session_id"])
ORACLES["missing_and_blank_documents"] = _missing("documents", ["text", "lang", "source"])


def _repeats(kind: str, keys: str) -> str:
    return (
        f"SELECT '{kind}' AS kind, count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS repeats, "
        f"CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS rows_sharing "
        f"FROM (SELECT count(*) AS n FROM corpus GROUP BY {keys})"
    )


ORACLES["duplicate_counts"] = _ctes(_NOISY) + " UNION ALL ".join([
    _repeats("row", "text, label"), _repeats("text", "text"), _repeats("normalized", _normalize("text")),
])
ORACLES["label_conflicts"] = _ctes(_NOISY) + (
    f"SELECT sha256({_normalize('text')}) AS text_key, count(DISTINCT label) AS n_labels FROM corpus GROUP BY 1 HAVING count(DISTINCT label) > 1"
)
ORACLES["conflict_examples"] = _ctes(_NOISY) + (
    f"SELECT doc_id, label FROM corpus WHERE {_normalize('text')} IN (SELECT {_normalize('text')} FROM corpus GROUP BY 1 "
    "HAVING count(DISTINCT label) > 1) ORDER BY doc_id LIMIT 10"
)
ORACLES["class_distribution"] = _ctes(_CLEAN, "c AS (SELECT label, count(*) AS n FROM corpus GROUP BY 1)") + (
    f"SELECT label, n, {_share('n', '(SELECT sum(n) FROM c)')} AS pct, round((SELECT max(n) / min(n) FROM c), 3) AS imbalance_ratio FROM c"
)


def _describe(metric: str, column: str, view: str, by: str = "") -> str:
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""SELECT {head}'{metric}' AS metric, count({column}) AS count, round(avg({column}), 4) AS mean,
  round(stddev_samp({column}), 4) AS std, round(CAST(min({column}) AS DOUBLE), 4) AS min,
  round(quantile_cont({column}, 0.25), 4) AS p25, round(quantile_cont({column}, 0.5), 4) AS p50,
  round(quantile_cont({column}, 0.75), 4) AS p75, round(CAST(max({column}) AS DOUBLE), 4) AS max
FROM {view} WHERE {column} IS NOT NULL{tail}"""


_MEASURES = ("char_count", "word_count", "punct_count")
ORACLES["describe_lengths"] = _ctes(_CLEAN, _LENGTHS) + " UNION ALL ".join(_describe(m, m, "lengths") for m in _MEASURES)
ORACLES["describe_by_label"] = _ctes(_CLEAN, _LENGTHS) + " UNION ALL ".join(_describe(m, m, "lengths", "label") for m in _MEASURES)

_TOKENS = f"freq AS (SELECT token, count(*) AS n FROM (SELECT unnest({_audit_tokens('text')}) AS token FROM documents) GROUP BY 1)"
ORACLES["token_frequency"] = _ctes(_TOKENS) + "SELECT token, n FROM freq"
ORACLES["vocab_stats"] = _ctes(_TOKENS) + """
SELECT count(*) AS vocab_size, CAST(sum(n) AS BIGINT) AS total_tokens, count(*) FILTER (n = 1) AS rare_words,
  round(100 * count(*) FILTER (n = 1) / count(*), 2) AS rare_pct FROM freq"""
ORACLES["top_tokens"] = _ctes(_TOKENS) + "SELECT token, n FROM freq ORDER BY n DESC, token LIMIT 20"
ORACLES["punct_share"] = """
SELECT count(*) AS rows, round(100 * avg(CASE WHEN contains(text, '!') THEN 1.0 ELSE 0.0 END), 2) AS pct_exclaim,
  round(100 * avg(CASE WHEN contains(text, '?') THEN 1.0 ELSE 0.0 END), 2) AS pct_question FROM documents"""
_P95 = "(SELECT quantile_cont(word_count, 0.95) FROM lengths)"
ORACLES["length_outliers"] = _ctes(_CLEAN, _LENGTHS) + f"""
SELECT count(*) FILTER (word_count <= 3) AS short_rows, round({_P95}, 1) AS long_words,
  count(*) FILTER (word_count >= {_P95}) AS long_rows, count(*) FILTER (word_count < 2) AS noisy_rows FROM lengths"""


def _heads(kind: str, condition: str, n: int) -> str:
    return f"(SELECT '{kind}' AS kind, doc_id, word_count FROM lengths WHERE {condition} ORDER BY doc_id LIMIT {n})"


ORACLES["length_outlier_examples"] = _ctes(_CLEAN, _LENGTHS) + " UNION ALL ".join([
    _heads("short", "word_count <= 3", 5), _heads("long", f"word_count >= {_P95}", 3), _heads("noisy", "word_count < 2", 5),
])


def _histogram(column: str, view: str, bins: int) -> str:
    return f"""bounds AS (SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi FROM {view}),
placed AS (
  SELECT least(CAST(floor(({column} - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1}) AS bin, count(*) AS n
  FROM {view}, bounds WHERE {column} IS NOT NULL GROUP BY 1)
SELECT b.bin, round(lo + b.bin * ((hi - lo) / {bins}), 4) AS left_edge, round(lo + (b.bin + 1) * ((hi - lo) / {bins}), 4) AS right_edge,
  coalesce(n, 0) AS n
FROM (SELECT unnest(range(0, {bins})) AS bin) b CROSS JOIN bounds LEFT JOIN placed p ON p.bin = b.bin"""


ORACLES["length_histogram"] = _ctes(_CLEAN, _LENGTHS, _histogram("word_count", "lengths", 30))
ORACLES["char_length_histogram"] = _ctes(_CLEAN, _LENGTHS, _histogram("char_count", "lengths", 30))
ORACLES["latency_histogram"] = _ctes(_LOG, _histogram("latency_seconds", "log", 20))
ORACLES["box_stats"] = _ctes(_CLEAN, _LENGTHS, """q AS (
  SELECT label, quantile_cont(word_count, 0.25) AS q1, quantile_cont(word_count, 0.5) AS q2, quantile_cont(word_count, 0.75) AS q3
  FROM lengths GROUP BY 1)""") + """
SELECT label, count(*) AS n, round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS median, round(any_value(q3), 4) AS q3,
  round(least(CAST(min(word_count) FILTER (word_count >= q1 - 1.5 * (q3 - q1)) AS DOUBLE), any_value(q1)), 4) AS whisker_low,
  round(greatest(CAST(max(word_count) FILTER (word_count <= q3 + 1.5 * (q3 - q1)) AS DOUBLE), any_value(q3)), 4) AS whisker_high,
  count(*) FILTER (word_count < q1 - 1.5 * (q3 - q1) OR word_count > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM lengths JOIN q USING (label) GROUP BY label"""
_EXPECTED = f"expected AS (SELECT unnest({_list(C.LABELS)}) AS label)"
ORACLES["label_set_diff"] = _ctes(_NOISY, _EXPECTED) + """
SELECT 'unexpected' AS kind, label FROM (SELECT label FROM corpus EXCEPT SELECT label FROM expected)
UNION ALL SELECT 'missing', label FROM (SELECT label FROM expected EXCEPT SELECT label FROM corpus)"""
ORACLES["validate_corpus"] = _ctes(_NOISY, _EXPECTED, f"""norm AS (SELECT {_normalize_strict('text')} AS key, label FROM corpus),
report AS (SELECT
  (SELECT count(*) FROM corpus) AS rows,
  (SELECT count(*) FROM corpus WHERE {_blank('text')} OR {_blank('label')} OR {_blank('source')}) AS missing_or_blank_rows,
  (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM corpus GROUP BY text, label, source)) AS exact_duplicate_rows,
  (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM norm GROUP BY key)) AS normalized_duplicate_rows,
  coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM (SELECT label FROM corpus EXCEPT SELECT label FROM expected)), '') AS invalid_labels,
  coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM (SELECT label FROM expected EXCEPT SELECT label FROM corpus)), '') AS missing_labels,
  (SELECT count(*) FROM (SELECT key FROM norm GROUP BY key HAVING count(DISTINCT label) > 1)) AS conflicting_texts)""") + """
SELECT *, missing_or_blank_rows = 0 AND invalid_labels = '' AND missing_labels = '' AND conflicting_texts = 0 AS passed FROM report"""

# --- Splits ----------------------------------------------------------------------------------


def _split_ctes(corpus: str) -> str:
    return _ctes(corpus, f"""keyed AS (SELECT *, md5({_normalize('text')}) AS text_key FROM corpus),
grouped AS (SELECT text_key, arg_min(label, doc_id) AS group_label FROM keyed GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY group_label ORDER BY md5('{C.SPLIT_SEED}' || text_key)) AS r,
  count(*) OVER (PARTITION BY group_label) AS size FROM grouped),
sides AS (SELECT text_key, CASE WHEN r <= ceil({C.EVAL_FRACTION} * size) THEN 'evaluation' ELSE 'train' END AS split FROM ranked),
marked AS (SELECT k.*, s.split FROM keyed k JOIN sides s USING (text_key))""")


ORACLES["group_split"] = _split_ctes(_CLEAN) + "SELECT doc_id, label, split FROM marked"
ORACLES["group_split_noisy"] = _split_ctes(_NOISY) + "SELECT doc_id, label, split FROM marked"
ORACLES["split_overlap"] = _split_ctes(_CLEAN) + """
SELECT text_key FROM marked WHERE split = 'train' INTERSECT SELECT text_key FROM marked WHERE split = 'evaluation'"""
ORACLES["split_membership"] = _split_ctes(_CLEAN) + "SELECT doc_id FROM marked WHERE split = 'evaluation'"
ORACLES["split_distribution"] = _split_ctes(_CLEAN) + """
SELECT label, count(*) FILTER (split = 'train') AS train_n,
  round(100 * count(*) FILTER (split = 'train') / (SELECT count(*) FROM marked WHERE split = 'train'), 2) AS train_pct,
  count(*) FILTER (split = 'evaluation') AS eval_n,
  round(100 * count(*) FILTER (split = 'evaluation') / (SELECT count(*) FROM marked WHERE split = 'evaluation'), 2) AS eval_pct
FROM marked GROUP BY label"""
_ROW_RANK = f"row_number() OVER (PARTITION BY label ORDER BY md5('{C.SPLIT_SEED}' || CAST(doc_id AS VARCHAR)))"
ORACLES["stratified_folds"] = _ctes(_CLEAN) + f"SELECT doc_id, label, ({_ROW_RANK} - 1) % {C.FOLDS} AS fold FROM corpus"
ORACLES["row_split"] = _ctes(_CLEAN) + (
    f"SELECT doc_id, label, CASE WHEN {_ROW_RANK} <= ceil({C.VALIDATION_FRACTION} * count(*) OVER (PARTITION BY label)) "
    "THEN 'validation' ELSE 'train' END AS split FROM corpus"
)

# --- Evaluation ------------------------------------------------------------------------------

ORACLES["error_by_length"] = _ctes(_PREDS, f"w AS (SELECT label <> pred AS wrong, {_word_count('text')} AS wc FROM preds)") + """
SELECT count(*) AS n, count(*) FILTER (wrong) AS n_errors, round(100 * count(*) FILTER (wrong) / count(*), 2) AS error_pct,
  count(*) FILTER (wrong AND wc <= 3) AS short_errors,
  count(*) FILTER (wrong AND wc >= (SELECT quantile_cont(wc, 0.95) FROM w)) AS long_errors FROM w"""
ORACLES["error_examples"] = _ctes(_PREDS) + "SELECT doc_id, label, pred FROM preds WHERE label <> pred ORDER BY doc_id LIMIT 10"
ORACLES["confusion_matrix"] = _ctes(_PREDS, "axis AS (SELECT label AS name FROM preds UNION SELECT pred FROM preds)") + """
SELECT a.name AS label, b.name AS pred, (SELECT count(*) FROM preds p WHERE p.label = a.name AND p.pred = b.name) AS n FROM axis a, axis b"""
ORACLES["confused_pairs"] = _ctes(_PREDS) + """
SELECT label, pred, count(*) AS n FROM preds WHERE label <> pred GROUP BY 1, 2 ORDER BY n DESC, label, pred LIMIT 5"""
_CLASSES = """axis AS (SELECT label AS name FROM preds UNION SELECT pred FROM preds),
counts AS (SELECT name, (SELECT count(*) FROM preds WHERE label = name) AS support,
  (SELECT count(*) FROM preds WHERE pred = name) AS predicted,
  (SELECT count(*) FROM preds WHERE pred = name AND label = name) AS hits FROM axis),
pr AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE hits / predicted END AS p, CASE WHEN support = 0 THEN 0.0 ELSE hits / support END AS r FROM counts),
classes AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM pr)"""
ORACLES["per_class_report"] = _ctes(_PREDS, _CLASSES) + """
SELECT name AS label, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, support FROM classes"""
ORACLES["overall_metrics"] = _ctes(_PREDS, _CLASSES) + """
SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(hits) / sum(support), 4) AS accuracy, round(avg(p), 4) AS macro_precision,
  round(avg(r), 4) AS macro_recall, round(avg(f), 4) AS macro_f1, round(sum(p * support) / sum(support), 4) AS weighted_precision,
  round(sum(r * support) / sum(support), 4) AS weighted_recall, round(sum(f * support) / sum(support), 4) AS weighted_f1 FROM classes"""
ORACLES["imbalance_report"] = _ctes(_PREDS, _CLASSES) + """
SELECT round(avg(f), 4) AS macro_f1, round(sum(f * support) / sum(support), 4) AS weighted_f1,
  round(avg(f) - sum(f * support) / sum(support), 4) AS f1_gap, round(min(f), 4) AS min_f1, round(max(f), 4) AS max_f1,
  round(max(support) / min(support) FILTER (support > 0), 3) AS imbalance_ratio FROM classes"""

# --- Sessions --------------------------------------------------------------------------------

ORACLES["log_volume"] = _ctes(_LOG) + """
SELECT CAST(sum(n) AS BIGINT) AS messages, count(*) AS sessions, round(avg(n), 4) AS mean_per_session, max(n) AS max_per_session
FROM (SELECT session_id, count(*) AS n FROM log GROUP BY 1)"""


def _shares(column: str) -> str:
    return _ctes(_LOG, f"c AS (SELECT {column}, count(*) AS n FROM log WHERE {column} IS NOT NULL GROUP BY 1)") + (
        f"SELECT {column}, n, {_share('n', '(SELECT sum(n) FROM c)')} AS pct FROM c"
    )


ORACLES["emotion_distribution"] = _shares("emotion")
ORACLES["response_type_share"] = _shares("response_type")
ORACLES["routing_rates"] = _ctes(_LOG) + """
SELECT count(*) AS n, round(avg(CASE WHEN response_type = 'faq_match' THEN 1.0 ELSE 0.0 END), 4) AS match_rate,
  round(avg(CASE WHEN response_type = 'fallback' THEN 1.0 ELSE 0.0 END), 4) AS fallback_rate,
  round(avg(similarity), 4) AS mean_similarity FROM log"""
ORACLES["describe_log"] = _ctes(_LOG) + " UNION ALL ".join(
    _describe(m, m, "log") for m in ("latency_seconds", "confidence", "input_length")
)
ORACLES["confidence_by_type"] = _ctes(_LOG) + _describe("confidence", "confidence", "log", "response_type")
_PAIRS = """known AS (SELECT session_id, emotion AS from_emotion,
  lead(emotion) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS to_emotion FROM log WHERE emotion IS NOT NULL),
pairs AS (SELECT * FROM known WHERE to_emotion IS NOT NULL)"""
ORACLES["emotion_transitions"] = _ctes(_LOG, _PAIRS) + "SELECT from_emotion, to_emotion, count(*) AS n FROM pairs GROUP BY 1, 2"
ORACLES["session_transitions"] = _ctes(_LOG, _PAIRS) + "SELECT session_id, from_emotion, to_emotion, count(*) AS n FROM pairs GROUP BY 1, 2, 3"
ORACLES["session_summary"] = _ctes(_LOG) + """
SELECT session_id, count(*) AS n_messages, round(avg(confidence), 4) AS mean_confidence,
  coalesce(round(count(*) FILTER (confidence < 0.45) / nullif(count(confidence), 0), 4), 0.0) AS uncertainty_rate FROM log GROUP BY 1"""
_LABEL_COUNTS = """counts AS (SELECT session_id, emotion, count(*) AS n, min(ts) AS first_ts, arg_min(event_id, ts) AS first_event
  FROM log WHERE emotion IS NOT NULL GROUP BY 1, 2)"""
ORACLES["session_label_counts"] = _ctes(_LOG, _LABEL_COUNTS) + "SELECT session_id, emotion, n, first_event FROM counts"
ORACLES["session_dominant"] = _ctes(_LOG, _LABEL_COUNTS) + """
SELECT session_id, emotion AS dominant_emotion, n AS n_dominant, count(*) OVER (PARTITION BY session_id) AS n_labels FROM counts
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first_ts, first_event) = 1"""
ORACLES["session_timeline"] = _ctes(_LOG) + f"SELECT session_id, {_time('ts')} AS ts, event_id, emotion, confidence FROM log"

# --- Similarity ------------------------------------------------------------------------------

_TFIDF = f"""bank_tokens AS (SELECT bank_pos, {_model_tokens('text')} AS t FROM bank),
bank_tf AS (SELECT bank_pos, term, count(*) AS tf FROM (SELECT bank_pos, unnest({_ngrams('t')}) AS term FROM bank_tokens) GROUP BY 1, 2),
idf AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM bank)) / (1 + count(*))) + 1 AS idf FROM bank_tf GROUP BY 1),
bank_raw AS (SELECT bank_pos, term, df, tf * idf AS raw FROM bank_tf JOIN idf USING (term)),
bank_w AS (SELECT bank_pos, term, df, raw / sqrt(sum(raw * raw) OVER (PARTITION BY bank_pos)) AS w FROM bank_raw)"""
_COSINE = f"""ask_tokens AS (SELECT query_id, {_model_tokens('text')} AS t FROM asked),
ask_tf AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({_ngrams('t')}) AS term FROM ask_tokens) GROUP BY 1, 2),
ask_raw AS (SELECT query_id, term, tf * idf AS raw FROM ask_tf JOIN idf USING (term)),
ask_w AS (SELECT query_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) AS w FROM ask_raw),
dots AS (SELECT query_id, bank_pos, round(sum(a.w * b.w), 10) AS score FROM ask_w a JOIN bank_w b USING (term) GROUP BY 1, 2)"""
_JACCARD = f"""ask_sets AS (SELECT query_id, list_distinct({_words('lower(text)')}) AS a FROM asked),
bank_sets AS (SELECT bank_pos, list_distinct({_words('lower(text)')}) AS b FROM bank),
sizes AS (SELECT query_id, bank_pos, len(list_intersect(a, b)) AS both_n, len(a) + len(b) AS all_n FROM ask_sets, bank_sets),
dots AS (SELECT query_id, bank_pos, round(both_n / (all_n - both_n), 10) AS score FROM sizes WHERE both_n > 0)"""
_TOP = """ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bank_pos) AS r FROM dots),
best AS (SELECT q.query_id, q.label, coalesce(d.bank_pos, (SELECT min(bank_pos) FROM bank)) AS bank_pos, coalesce(d.score, 0.0) AS score
  FROM asked q LEFT JOIN (SELECT * FROM ranked WHERE r = 1) d ON d.query_id = q.query_id)"""
_SWEEP = """n_all AS (SELECT count(*) AS n FROM best),
marked AS (SELECT (30 + 5 * k) / 100 AS threshold, score >= (30 + 5 * k) / 100 AS hit, best.label = bank.label AS good
  FROM best JOIN bank ON bank.bank_pos = best.bank_pos CROSS JOIN (SELECT unnest(range(0, 14)) AS k)),
sums AS (SELECT threshold, count(*) FILTER (hit) AS n_matched, count(*) FILTER (hit AND good) AS n_right, count(*) AS n FROM marked GROUP BY 1),
sweep AS (SELECT threshold, n_matched, CASE WHEN n_matched > 0 THEN round(n_right / n_matched, 4) END AS match_accuracy,
  CASE WHEN n_matched > 0 THEN round((n_matched - n_right) / n, 4) END AS false_match_rate,
  CASE WHEN n_matched > 0 THEN round((n - n_matched) / n, 4) ELSE 1.0 END AS unmatched_rate FROM sums)"""
_BY_COSINE = (_BANK, _ASKED, _TFIDF, _COSINE, _TOP)
_BY_JACCARD = (_BANK, _ASKED, _JACCARD, _TOP)
_CHOICE = """SELECT * FROM sweep WHERE match_accuracy IS NOT NULL AND unmatched_rate <= 0.5
ORDER BY match_accuracy DESC, unmatched_rate, threshold LIMIT 1"""
_STATS = """SELECT round(avg(score), 4) AS mean_best_score, round(stddev_pop(score), 4) AS std_best_score,
  round(min(score), 4) AS min_best_score, round(max(score), 4) AS max_best_score FROM best"""
ORACLES["tfidf_weights"] = _ctes(_BANK, _TFIDF) + "SELECT bank_pos, term, df, round(w, 4) AS w FROM bank_w"
ORACLES["tfidf_cosine_top1"] = _ctes(*_BY_COSINE) + "SELECT query_id, bank_pos, round(score, 4) AS score FROM best"
ORACLES["jaccard_top1"] = _ctes(*_BY_JACCARD) + "SELECT query_id, bank_pos, round(score, 4) AS score FROM best"
ORACLES["best_match"] = _ctes(*_BY_COSINE) + """
SELECT query_id, round(score, 4) AS score, score >= 0.6 AS matched, CASE WHEN score >= 0.6 THEN bank.label END AS matched_label,
  CASE WHEN score >= 0.6 THEN reply END AS stored_reply FROM best JOIN bank ON bank.bank_pos = best.bank_pos"""
ORACLES["threshold_sweep"] = _ctes(*_BY_COSINE, _SWEEP) + "SELECT * FROM sweep"
ORACLES["threshold_sweep_jaccard"] = _ctes(*_BY_JACCARD, _SWEEP) + "SELECT * FROM sweep"
ORACLES["threshold_choice"] = _ctes(*_BY_COSINE, _SWEEP) + _CHOICE
ORACLES["threshold_choice_jaccard"] = _ctes(*_BY_JACCARD, _SWEEP) + _CHOICE
ORACLES["best_score_stats"] = _ctes(*_BY_COSINE) + _STATS
ORACLES["best_score_stats_jaccard"] = _ctes(*_BY_JACCARD) + _STATS

# --- Streams ---------------------------------------------------------------------------------

ORACLES["stream_session_partials"] = _ctes(_LOG) + """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, session_id, emotion, count(*) AS n, count(confidence) AS n_confidence,
  round(sum(confidence), 4) AS sum_confidence, CAST(sum(CASE WHEN confidence < 0.45 THEN 1 WHEN confidence IS NOT NULL THEN 0 END) AS BIGINT) AS n_uncertain
FROM log GROUP BY 1, 2, 3"""
ORACLES["stream_once_per_message"] = _ctes(_LOG) + "SELECT event_id, session_id FROM log"

ORACLES["stream_append_new"] = ORACLES["stream_once_per_message"]
ORACLES["stream_session_transitions"] = ORACLES["session_transitions"]

ORACLES["stream_session_totals"] = _ctes(_LOG, _LABEL_COUNTS) + f"""
SELECT s.*, d.dominant_emotion FROM ({ORACLES["session_summary"].split(_ctes(_LOG))[1]}) s LEFT JOIN (
  SELECT session_id, emotion AS dominant_emotion FROM counts
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first_ts, first_event) = 1) d USING (session_id)"""

# --- Models ----------------------------------------------------------------------------------

_BAYES = f"""train AS (SELECT doc_id, label, text FROM marked WHERE split = 'train'),
held AS (SELECT doc_id, label, text FROM marked WHERE split = 'evaluation'),
train_tf AS (SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest({_ngrams('t')}) AS term FROM (SELECT doc_id, {_model_tokens('text')} AS t FROM train)) GROUP BY 1, 2),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM train)) / (1 + count(*))) + 1 AS idf FROM train_tf GROUP BY 1 HAVING count(*) >= 2),
train_w AS (SELECT doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS w FROM train_tf JOIN idf USING (term)),
class_terms AS (SELECT label, term, sum(w) AS total FROM train_w JOIN train USING (doc_id) GROUP BY 1, 2),
classes AS (SELECT label, ln(count(*) / (SELECT count(*) FROM train)) AS prior FROM train GROUP BY 1),
masses AS (SELECT c.label, prior, ln(coalesce((SELECT sum(total) FROM class_terms k WHERE k.label = c.label), 0) + (SELECT count(*) FROM idf)) AS mass FROM classes c),
held_tf AS (SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest({_ngrams('t')}) AS term FROM (SELECT doc_id, {_model_tokens('text')} AS t FROM held)) GROUP BY 1, 2),
held_w AS (SELECT doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS w FROM held_tf JOIN idf USING (term)),
joint AS (SELECT h.doc_id, m.label AS cls, m.prior
    + coalesce((SELECT sum(w.w * (ln(coalesce(k.total, 0) + 1) - m.mass)) FROM held_w w LEFT JOIN class_terms k
        ON k.term = w.term AND k.label = m.label WHERE w.doc_id = h.doc_id), 0) AS score FROM held h, masses m),
preds AS (SELECT j.doc_id, h.label, arg_max(j.cls, round(score, 10)) AS pred, 1 / sum(exp(score - top)) AS confidence
  FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM joint) j JOIN held h USING (doc_id) GROUP BY 1, 2)"""
_MARKED = _split_ctes(_CLEAN).removeprefix("WITH ").rstrip()
ORACLES["predict_nb"] = _ctes(_MARKED, _BAYES) + "SELECT doc_id, pred, round(confidence, 4) AS confidence FROM preds"
ORACLES["train_nb"] = ORACLES["overall_metrics"].replace(_PREDS, f"{_MARKED},\n{_BAYES.replace('classes AS', 'priors AS').replace('FROM classes c', 'FROM priors c')}")

_BANK_BAYES = _BAYES.replace(
    "train AS (SELECT doc_id, label, text FROM marked WHERE split = 'train')", "train AS (SELECT bank_pos AS doc_id, label, text FROM bank)"
).replace(
    "held AS (SELECT doc_id, label, text FROM marked WHERE split = 'evaluation')",
    f"held AS (SELECT query_id AS doc_id, '' AS label, {_strip('text')} AS text FROM asked)",
).replace("idf AS (SELECT", "nb_idf AS (SELECT").replace("JOIN idf", "JOIN nb_idf").replace("FROM idf", "FROM nb_idf")
_PICKED = f"{_list([C.FALLBACK_REPLY])}[1]"
_ROUTE_REPLY = "CASE p.pred " + " ".join(
    f"WHEN {_text(k)} THEN {_list(v)}[{_pick(len(v), chr(39) + 'q' + chr(39) + ' || q.query_id || ' + chr(39) + ':' + chr(39) + ' || t')} + 1]"
    for k, v in C.ROUTE_REPLIES.items()
) + f" ELSE {_PICKED} END"
ORACLES["hybrid_route"] = _ctes(*_BY_COSINE, _BANK_BAYES, f"""checked AS (
  SELECT q.query_id, {_strip('q.text')} AS t, {_blank('q.text')} AS blank, length({_strip('q.text')}) > {C.MAX_INPUT_CHARS} AS too_long,
    round(b.score, 4) AS similarity, b.score >= 0.6 AS matched, s.label AS matched_label, s.reply AS stored_reply
  FROM asked q JOIN best b USING (query_id) JOIN bank s ON s.bank_pos = b.bank_pos)""") + f"""
SELECT q.query_id, 'q' || q.query_id AS session_id, CASE WHEN blank OR too_long THEN NULL ELSE similarity END AS similarity,
  CASE WHEN blank OR too_long THEN NULL WHEN matched THEN matched_label ELSE p.pred END AS emotion,
  CASE WHEN blank OR too_long THEN NULL WHEN matched THEN similarity ELSE round(p.confidence, 4) END AS confidence,
  CASE WHEN blank OR too_long THEN {_text(C.VALIDATION_ERROR)} WHEN matched THEN {_text(C.STORED_MATCH)} ELSE {_text(C.CLASSIFIED)} END AS response_type,
  CASE WHEN blank THEN {_text(C.ROUTE_EMPTY_MESSAGE)} WHEN too_long THEN {_text(C.ROUTE_LONG_MESSAGE.format(limit=C.MAX_INPUT_CHARS))}
    WHEN matched THEN stored_reply ELSE {_ROUTE_REPLY} END AS response
FROM checked q LEFT JOIN preds p ON p.doc_id = q.query_id"""
ORACLES["saved_model_route"] = ORACLES["hybrid_route"]



def _learned(p: str, source: str, models: str, names: tuple[str, ...], fitted=None) -> list[str]:
    """Weights ``{p}w_<model>`` and intercepts ``{p}b_<model>`` from rows of ``source``; model ``g`` learns from folds other than ``g``."""
    parts = [f"""{p}rows AS MATERIALIZED (SELECT doc_id, label, text, fold FROM {source} WHERE label IS NOT NULL),
{p}inst AS (SELECT unnest({models}) AS g), {p}cls AS (SELECT DISTINCT label FROM {p}rows),
{p}sizes AS MATERIALIZED (SELECT g, count(*) AS n FROM {p}inst, {p}rows WHERE fold <> g GROUP BY g),
{p}tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest({_ngrams('t')}) AS term FROM (SELECT doc_id, {_model_tokens('text')} AS t FROM {p}rows)) GROUP BY 1, 2),
{p}idf AS MATERIALIZED (SELECT g, term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf
  FROM {p}tf JOIN {p}rows USING (doc_id) JOIN {p}sizes ON fold <> g GROUP BY g, term HAVING count(*) >= 2),
{p}x AS MATERIALIZED (SELECT g, doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY g, doc_id)) AS x
  FROM {p}tf JOIN {p}idf USING (term)),
{p}seen AS MATERIALIZED (SELECT g, doc_id, term, x, label AS y FROM {p}x JOIN {p}rows USING (doc_id) WHERE fold <> g),
{p}mean AS (SELECT g, term, sum(x) / any_value(n) AS s FROM {p}seen JOIN {p}sizes USING (g) GROUP BY 1, 2),
{p}curve AS MATERIALIZED (SELECT g, any_value(n) AS n, max(product) AS rho FROM (
  SELECT g, doc_id, sum(x * s) AS product FROM {p}seen JOIN {p}mean USING (g, term) GROUP BY 1, 2) JOIN {p}sizes USING (g) GROUP BY g)"""]
    for name in names:
        parts.append(_bayes_weights(p) if name == "nb" else (fitted or _descended)(p, name))
    return parts


def _bayes_weights(p: str) -> str:
    return f"""{p}totals AS (SELECT g, y AS label, term, sum(x) AS total FROM {p}seen GROUP BY 1, 2, 3),
{p}mass AS (SELECT i.g, c.label, ln(coalesce((SELECT sum(total) FROM {p}totals t WHERE t.g = i.g AND t.label = c.label), 0)
  + (SELECT count(*) FROM {p}idf d WHERE d.g = i.g)) AS mass FROM {p}inst i, {p}cls c),
{p}w_nb AS MATERIALIZED (SELECT m.g, d.term, m.label, ln(1 + coalesce(t.total, 0)) - m.mass AS w
  FROM {p}mass m JOIN {p}idf d USING (g) LEFT JOIN {p}totals t ON t.g = m.g AND t.label = m.label AND t.term = d.term),
{p}b_nb AS (SELECT g, label, ln(count(*) / any_value(n)) AS b FROM {p}rows JOIN {p}sizes ON fold <> g GROUP BY 1, 2)"""


def _descended(p: str, name: str) -> str:
    """The steps of gradient descent with momentum, one after the other."""
    q = f"{p}{name}_"
    if name == "lr":
        bend, shrink = 1.0, "1.0"
        pull = f"""SELECT g, doc_id, label, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY g, doc_id) - (y = label)::INT AS c
    FROM (SELECT *, max(z) OVER (PARTITION BY g, doc_id) AS top FROM (SELECT m.*, m + ahead AS z FROM {q}m{{t}} m JOIN {q}b{{t}} USING (g, label)))"""
    else:
        bend, shrink = 4.0, "(1 - 1.0 / (4.0 + 1.0 / n) / n)"
        pull = f"""SELECT g, doc_id, label, -2.0 * side * greatest(0.0, 1.0 - side * z) AS c FROM (
    SELECT g, doc_id, label, m + ahead AS z, CASE WHEN y = label THEN 1.0 ELSE -1.0 END AS side FROM {q}m{{t}} JOIN {q}b{{t}} USING (g, label))"""
    step, bias_step = f"(1.0 / ({bend} * rho + 1.0 / n))", f"(1.0 / ({bend} + 1.0 / n))"
    parts = [f"""{q}w0 AS MATERIALIZED (SELECT g, term, label, 0.0::DOUBLE AS w, 0.0::DOUBLE AS v FROM {p}idf, {p}cls),
{q}b0 AS MATERIALIZED (SELECT g, label, 0.0::DOUBLE AS b, 0.0::DOUBLE AS ahead FROM {p}inst, {p}cls)"""]
    for t in range(STEPS):
        keep = t / (t + 3.0)
        parts.append(f"""{q}m{t} AS MATERIALIZED (SELECT s.g, doc_id, y, w.label, sum(x * v) AS m
  FROM {p}seen s JOIN {q}w{t} w ON w.g = s.g AND w.term = s.term GROUP BY 1, 2, 3, 4),
{q}c{t} AS MATERIALIZED ({pull.format(t=t)}),
{q}d{t} AS MATERIALIZED (SELECT s.g, term, c.label, sum(x * c) AS d FROM {p}seen s JOIN {q}c{t} c ON c.g = s.g AND c.doc_id = s.doc_id GROUP BY 1, 2, 3),
{q}w{t + 1} AS MATERIALIZED (SELECT g, term, label, new AS w, new + {keep!r} * (new - w) AS v FROM (
  SELECT w.g, w.term, w.label, w.w, v * (1 - {step} / n) - coalesce(d, 0) * {step} / n AS new
  FROM {q}w{t} w JOIN {p}curve USING (g) LEFT JOIN {q}d{t} d ON d.g = w.g AND d.term = w.term AND d.label = w.label)),
{q}b{t + 1} AS MATERIALIZED (SELECT g, label, new AS b, new + {keep!r} * (new - b) AS ahead FROM (
  SELECT b.g, b.label, b.b, ahead * {shrink} - coalesce(d, 0) * {bias_step} / n AS new FROM {q}b{t} b JOIN {p}curve USING (g)
  LEFT JOIN (SELECT g, label, sum(c) AS d FROM {q}c{t} GROUP BY 1, 2) d ON d.g = b.g AND d.label = b.label))""")
    parts.append(f"{p}w_{name} AS (SELECT g, term, label, w FROM {q}w{STEPS}), {p}b_{name} AS (SELECT g, label, b FROM {q}b{STEPS})")
    return ",\n".join(parts)


def _converged(p: str, name: str) -> str:
    """Conjugate gradients on the summed loss plus half the squared weights, repeated until the gradient is small.

    A weight is a sum of ``x * a`` over rows, ``z`` the product of a row with the weights; ``d`` and ``u`` are the same for the
    direction, ``a + c`` and ``q`` for the gradient. ``b``, ``turn`` and ``slope`` are their intercepts.
    """
    q, lr = f"{p}{name}_", name == "lr"
    one, b_own = ("g", "0.0") if lr else ("g, label", "b")

    def pulled(rows: str, z: str) -> str:
        """The rows with ``c``, the pull of the loss at the margins ``z``, and ``p``, what its change is made from."""
        if lr:
            return f"""(SELECT *, p - (y = label)::INT AS c FROM (SELECT *, e / sum(e) OVER (PARTITION BY g, doc_id, y) AS p FROM (
    SELECT *, exp(m - max(m) OVER (PARTITION BY g, doc_id, y)) AS e FROM (SELECT *, {z} AS m FROM {rows}))))"""
        return f"""(SELECT *, -2.0 * side * greatest(0.0, 1.0 - side * m) AS c, 2.0 * (side * m < 1.0)::INT AS p
    FROM (SELECT *, {z} AS m, CASE WHEN y = label THEN 1.0 ELSE -1.0 END AS side FROM {rows}))"""

    def slopes(rows: str, far: str) -> str:
        """First and second derivative along the direction, for each problem."""
        s = "(nu + nt)"
        bend = f"p * {s} * ({s} - sum(p * {s}) OVER (PARTITION BY g, doc_id, y))" if lr else f"p * {s} * {s}"
        own = "" if lr else f" + any_value((b + {far} * nt) * nt)", "" if lr else " + any_value(nt * nt)"
        inner = pulled(f"(SELECT * EXCLUDE (c) FROM {rows})", f"z + b + {far} * {s}")
        return f"""SELECT {one}, sum((a + {far} * nd) * nu + c * {s}){own[0]} AS first, sum(nd * nu + bent){own[1]} AS second
    FROM (SELECT *, {bend} AS bent FROM {inner}) GROUP BY {one}"""

    return f"""{q}x AS MATERIALIZED (SELECT g, doc_id, y, term, sum(x) AS x FROM {p}seen GROUP BY 1, 2, 3, 4),
{q}s AS (
  SELECT -1 AS it, g, doc_id, y, label, 0.0::DOUBLE AS a, 0.0::DOUBLE AS z, 0.0::DOUBLE AS d, 0.0::DOUBLE AS u, 0.0::DOUBLE AS q, 0.0::DOUBLE AS b,
    0.0::DOUBLE AS turn, 0.0::DOUBLE AS slope, 0.0::DOUBLE AS mixed, 1.0::DOUBLE AS squares, 0.0::DOUBLE AS aim, true AS goes_on
  FROM (SELECT DISTINCT g, doc_id, y FROM {q}x), {p}cls
  UNION ALL
  SELECT * FROM (WITH now AS (SELECT * FROM {pulled(f"(SELECT * FROM {q}s WHERE goes_on AND it < {MAX_ITER - 1})", "z + b")}),
  way AS (SELECT it, g, doc_id, y, label, a, z, q, b, slope, squares, aim, c,
    mixed * d - a - c AS nd, mixed * u - q AS nu, mixed * turn - slope AS nt FROM now),
  begun AS ({slopes("way", "0.0")}),
  tried AS (SELECT w.*, CASE WHEN it >= 0 AND squares > aim THEN -first / second ELSE 0.0 END AS far, first AS down FROM way w JOIN begun USING ({one})),
  ended AS ({slopes("tried", "far")}),
  moved AS (SELECT t.it, t.g, doc_id, y, t.label, a + pace * nd AS a, z + pace * nu AS z, nd, nu, nt, b + pace * nt AS b, q, slope, squares, aim
    FROM (SELECT t.*, CASE WHEN far > 0 AND first > -down THEN far * down / (down - first) ELSE far END AS pace
      FROM tried t JOIN ended USING ({one})) t),
  there AS (SELECT *, a + c AS r FROM {pulled("moved", "z + b")}),
  w AS (SELECT g, term, label, sum(x * r) AS w FROM {q}x JOIN there USING (g, doc_id, y) GROUP BY ALL),
  k AS (SELECT g, doc_id, y, label, sum(x * w) AS k FROM {q}x JOIN w USING (g, term) GROUP BY ALL),
  tilt AS (SELECT g, label, sum(c) + any_value({b_own}) AS tilt, any_value(slope) AS gone FROM there GROUP BY ALL),
  tilts AS (SELECT {one}, sum(tilt * tilt) AS own, sum(tilt * gone) AS crossed FROM tilt GROUP BY ALL),
  dots AS (SELECT {one}, sum(r * k) AS own, sum(r * q) AS crossed FROM there JOIN k USING (g, doc_id, y, label) GROUP BY ALL),
  sums AS (SELECT {one}, d.own + t.own AS own, d.crossed + t.crossed AS crossed FROM dots d JOIN tilts t USING ({one}))
  SELECT it + 1, g, doc_id, y, label, a, z, nd, nu, k, b, nt, tilt,
    CASE WHEN it < 0 OR squares <= 0 THEN 0.0 ELSE greatest(0.0, (own - crossed) / squares) END, own,
    CASE WHEN it < 0 THEN {TOLERANCE ** 2!r} * own ELSE aim END, bool_or(own > CASE WHEN it < 0 THEN {TOLERANCE ** 2!r} * own ELSE aim END) OVER ()
  FROM there JOIN k USING (g, doc_id, y, label) JOIN tilt USING (g, label) JOIN sums USING ({one}))),
{q}end AS MATERIALIZED (SELECT * FROM {q}s WHERE it = (SELECT max(it) FROM {q}s)),
{p}w_{name} AS MATERIALIZED (SELECT g, term, label, sum(x * a) AS w FROM {q}x JOIN {q}end USING (g, doc_id, y) GROUP BY ALL),
{p}b_{name} AS (SELECT DISTINCT g, label, b FROM {q}end)"""


def _decided(name: str, p: str, model: str, rows: str, vectors: str) -> str:
    """``name``: doc_id, label, g, pred, confidence of ``rows`` (doc_id, label, g)."""
    return f"""{name} AS (SELECT doc_id, y AS label, g, arg_min(label, place) AS pred, 1 / sum(exp(score - top)) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 10) DESC, label) AS place, max(score) OVER (PARTITION BY doc_id) AS top FROM (
    SELECT r.doc_id, r.label AS y, r.g, b.label, any_value(b.b) + coalesce(sum(x.x * w.w), 0) AS score
    FROM {rows} r JOIN {p}b_{model} b ON b.g = r.g LEFT JOIN {vectors} x ON x.doc_id = r.doc_id AND x.g = r.g
    LEFT JOIN {p}w_{model} w ON w.g = x.g AND w.term = x.term AND w.label = b.label
    WHERE x.term IS NULL OR w.term IS NOT NULL GROUP BY 1, 2, 3, 4)) GROUP BY 1, 2, 3)"""


_HELD = f"""t_source AS (SELECT doc_id, label, text, -1 AS fold FROM marked WHERE split = 'train'),
held AS (SELECT doc_id, label, text, 0 AS g FROM marked WHERE split = 'evaluation'),
held_tf AS (SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest({_ngrams('t')}) AS term FROM (SELECT doc_id, {_model_tokens('text')} AS t FROM held)) GROUP BY 1, 2)"""
_HELD_X = """held_x AS MATERIALIZED (SELECT g, doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS x
  FROM held_tf JOIN t_idf USING (term))"""


def _judged(*names: str, fitted=None) -> list[str]:
    """The held-out side judged by models of the training side: ``preds_<model>``."""
    learned = _learned("t_", "t_source", "[0]", names, fitted)
    return [_MARKED, _HELD, *learned, _HELD_X, *[_decided(f"preds_{x}", "t_", x, "held", "held_x") for x in names]]


_METRICS = ORACLES["overall_metrics"].removeprefix(_ctes(_PREDS, _CLASSES))
ORACLES["score_confidence"] = _ctes(*_judged("svm")) + "SELECT doc_id, label, pred, round(confidence, 4) AS confidence FROM preds_svm"
ORACLES["predict_logreg"] = _ctes(*_judged("lr")) + "SELECT doc_id, pred, round(confidence, 4) AS confidence FROM preds_lr"
for _query, _model in (("train_svm", "svm"), ("train_logreg", "lr")):
    ORACLES[_query] = "WITH RECURSIVE " + _ctes(*_judged(_model, fitted=_converged), f"preds AS (SELECT * FROM preds_{_model})", _CLASSES).removeprefix("WITH ") + _METRICS

_STAND_INS = """models AS (
  SELECT 'first' AS model, doc_id % 5 AS fold, label, pred FROM preds
  UNION ALL SELECT 'second', doc_id % 5, label, CASE WHEN doc_id % 13 = 0 THEN 'de' ELSE label END FROM preds)"""
_SUMMARY = """names AS (SELECT DISTINCT model, fold, label AS name FROM models UNION SELECT DISTINCT model, fold, pred FROM models),
counted AS (SELECT n.model, n.fold, n.name, count(*) FILTER (m.label = n.name) AS support, count(*) FILTER (m.pred = n.name) AS predicted,
  count(*) FILTER (m.label = n.name AND m.pred = n.name) AS hits FROM names n JOIN models m ON m.model = n.model AND m.fold = n.fold GROUP BY 1, 2, 3),
rates AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE hits / predicted END AS p, CASE WHEN support = 0 THEN 0.0 ELSE hits / support END AS r FROM counted),
scored AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM rates),
folds AS (SELECT model, fold, sum(hits) / sum(support) AS accuracy, avg(f) AS macro_f1, sum(f * support) / sum(support) AS weighted_f1,
  avg(p) AS macro_precision, avg(r) AS macro_recall FROM scored GROUP BY 1, 2),
long AS (UNPIVOT folds ON accuracy, macro_f1, weighted_f1, macro_precision, macro_recall INTO NAME metric VALUE score),
summary AS (SELECT model, metric, round(avg(score), 4) AS mean, round(stddev_pop(score), 4) AS std,
  string_agg(printf('%.4f', round(score, 4)), ',' ORDER BY fold) AS fold_scores FROM long GROUP BY 1, 2)"""
ORACLES["fold_summary"] = _ctes(_PREDS, _STAND_INS, _SUMMARY) + "SELECT * FROM summary"
ORACLES["model_selection_stand_in"] = _ctes(_PREDS, _STAND_INS, _SUMMARY) + """
SELECT model, mean, std FROM summary WHERE metric = 'weighted_f1' ORDER BY mean DESC, std, model LIMIT 1"""
_COMPARED = """SELECT model, max(mean) FILTER (metric = 'accuracy') AS accuracy, max(mean) FILTER (metric = 'macro_f1') AS macro_f1,
  max(mean) FILTER (metric = 'weighted_f1') AS weighted_f1, max(std) FILTER (metric = 'accuracy') AS accuracy_std,
  max(std) FILTER (metric = 'macro_f1') AS macro_f1_std, max(std) FILTER (metric = 'weighted_f1') AS weighted_f1_std,
  {status} AS status FROM summary GROUP BY 1"""
ORACLES["model_comparison_stand_in"] = _ctes(_PREDS, _STAND_INS, _SUMMARY) + _COMPARED.format(status=_text(STATUS_CV)) + f"""
UNION ALL SELECT 'Fine-tuned transformer', NULL, NULL, NULL, NULL, NULL, NULL, {_text(STATUS_PENDING)}"""
_NAMES = {"lr": LOGREG, "svm": SVM, "nb": BAYES}
_CROSS, _CROSS_CONVERGED = ([
    _MARKED, "f_train AS (SELECT doc_id, label, text FROM marked WHERE split = 'train')",
    f"f_source AS (SELECT doc_id, label, text, ({_ROW_RANK} - 1) % {C.FOLDS} AS fold FROM f_train)",
    *_learned("f_", "f_source", f"range(0, {C.FOLDS})", tuple(_NAMES), fitted),
    "f_rows_g AS (SELECT doc_id, label, fold AS g FROM f_rows)", *[_decided(f"f_{x}", "f_", x, "f_rows_g", "f_x") for x in _NAMES],
    "models AS (" + " UNION ALL ".join(f"SELECT {_text(name)} AS model, g AS fold, label, pred FROM f_{x}" for x, name in _NAMES.items()) + ")",
    _SUMMARY,
] for fitted in (_descended, _converged))
_CHOSEN = "chosen AS (SELECT model, mean, std FROM summary WHERE metric = 'weighted_f1' ORDER BY mean DESC, std, model LIMIT 1)"
ORACLES["cv_summary"] = _ctes(*_CROSS) + "SELECT * FROM summary"
ORACLES["model_selection"] = _ctes(*_CROSS, _CHOSEN) + "SELECT * FROM chosen"
ORACLES["model_comparison"] = "WITH RECURSIVE " + _ctes(*_CROSS_CONVERGED).removeprefix("WITH ") + _COMPARED.format(status=_text(STATUS_CV)) + f"""
UNION ALL SELECT 'Fine-tuned transformer', NULL, NULL, NULL, NULL, NULL, NULL, {_text(STATUS_PENDING)}"""
ORACLES["holdout_eval"] = _ctes(
    *_CROSS, _CHOSEN, *_judged(*_NAMES)[1:],
    "preds AS (" + " UNION ALL ".join(
        f"SELECT doc_id, label, pred FROM preds_{x} WHERE (SELECT model FROM chosen) = {_text(name)}" for x, name in _NAMES.items()) + ")",
    _CLASSES,
) + _METRICS.replace("\nSELECT ", "\nSELECT (SELECT model FROM chosen) AS model, ", 1)
ORACLES["model_comparison_held_out"] = _ctes(_PREDS, _STAND_INS, _SUMMARY, _CLASSES) + _COMPARED.format(status=_text(STATUS_CV)) + f"""
UNION ALL SELECT 'chosen', round(sum(hits) / sum(support), 4), round(avg(f), 4), round(sum(f * support) / sum(support), 4),
  NULL, NULL, NULL, {_text(STATUS_HELD_OUT)} FROM classes"""

# --- Storage ---------------------------------------------------------------------------------

ORACLES["split_round_trip"] = f"SELECT split, label, count(*) AS n FROM ({ORACLES['row_split']}) GROUP BY 1, 2"
ORACLES["log_round_trip"] = _ctes(_LOG) + f"""
SELECT session_id, {_time('ts')} AS timestamp, input_length, similarity AS faq_similarity_score, emotion AS predicted_emotion,
  confidence AS classifier_confidence, response_type, latency_seconds FROM log"""
ORACLES["feedback_round_trip"] = f"""
SELECT message_id, helpful, '2024-02-05 00:00:00.000000' AS timestamp FROM ({ORACLES["feedback_accept"]})"""
ORACLES["delete_session_rewrite"] = _ctes(_MSGS, _VALID) + """
SELECT message_id, session_id, (SELECT count(*) FROM valid WHERE session_id = 's3') AS deleted_messages FROM valid WHERE session_id <> 's3'"""
ORACLES["retention_rewrite"] = _ctes(_MSGS, _VALID) + """
SELECT message_id, (SELECT count(*) FROM valid WHERE ts < TIMESTAMP '2024-01-01 08:00:00') AS deleted_messages
FROM valid WHERE ts >= TIMESTAMP '2024-01-01 08:00:00'"""
ORACLES["metrics_round_trip"] = _ctes(*_BY_COSINE, _SWEEP, f"choice AS ({_CHOICE})") + """
SELECT query_id, score >= (SELECT threshold FROM choice) AS matched, (SELECT threshold FROM choice) AS threshold FROM best"""
