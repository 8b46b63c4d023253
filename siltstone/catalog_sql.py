"""DuckDB SQL that gives the rows of the queries in siltstone.catalog, written from the definitions and not from the plans."""

from __future__ import annotations

from .catalog import GROUPS, LINES, QUERIES, RERANKED, SAID, K
from .functions.aliases import NAMES
from .functions.text import KEPT_UPPER
from .operators.answer import ASK, CHARS, CITED, SOURCES
from .operators.intent import DAY, FAILED, NEGATED, PATIENT, SEIZURE_WORDS, SPAN, SYMPTOMS, WORKED


def _text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_text, xs)) + "]"


def _any(col: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {_text(t)})" for t in terms) + ")"


_NORMAL = "coalesce(regexp_replace(lower(trim({0}, e' \\t\\n\\r')), '\\s+', ' ', 'g'), '')"
_CANONICAL = "CASE {0} " + " ".join(f"WHEN {_text(a)} THEN {_text(c)}" for c, names in NAMES.items() for a in names) + " ELSE {0} END"
_TERMS = "CASE {0} WHEN '' THEN []::VARCHAR[] " + " ".join(f"WHEN {_text(c)} THEN {_list(names)}" for c, names in NAMES.items()) + " ELSE [{0}] END"
_WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+')"
_STRIP = "regexp_replace({0}, '^[\\s\\p{{Z}}\\x0b\\x85]+|[\\s\\p{{Z}}\\x0b\\x85]+$', '', 'g')"

REGISTRY = """r AS (
  SELECT CAST(doc_id AS VARCHAR) AS row_id, CAST(100000 + doc_id % 37 AS VARCHAR) AS patient_id, strftime(DATE '2019-01-01' + CAST(doc_id % 1500 AS INTEGER), '%Y-%m-%d') AS note_date,
    'n' || doc_id AS note_id, replace(text, e'\\n', e'\\n\\n') AS note_text,
    CASE doc_id % 7 WHEN 0 THEN 'Keppra' WHEN 1 THEN 'levetiracetam' WHEN 2 THEN 'lamotrigine' WHEN 3 THEN 'Depakote' WHEN 4 THEN 'valproic acid' WHEN 5 THEN 'Levothyroxine' END AS medication,
    CASE doc_id % 3 WHEN 0 THEN '500 mg' WHEN 2 THEN '25 mg' END AS medication_dosage, CAST(doc_id % 4 + 0.5 AS DOUBLE) AS intake_times_per_day,
    CASE doc_id % 4 WHEN 0 THEN 'successful' WHEN 1 THEN 'refractory' WHEN 2 THEN 'unknown' END AS medication_effectiveness,
    CASE doc_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'unknown' END AS seizure_status, lang || ' | ' || source || '| ' AS seizure_symptoms, text, doc_id
  FROM documents)"""
CHUNKS = REGISTRY + """,
c AS (
  SELECT doc_id AS vector_id, patient_id || '_' || note_date || '_' || row_id || '_chunk_0' AS chunk_id, row_id AS source_row_id, patient_id, note_date, note_id, text, medication, medication_effectiveness,
    seizure_status, coalesce(seizure_status = 'positive', false) AS has_seizure_info, embedding
  FROM r LEFT JOIN embeddings ON vec_id = doc_id)"""
_VALUES = ", ".join("(" + ", ".join([*map(_text, q), str(k)]) + ")" for k, q in enumerate(QUERIES))
ASKED = f"""asked AS (
  SELECT * FROM (VALUES {_VALUES}) AS v(query_id, query, query_type, f_pid, f_med, f_ds, f_de, n) LEFT JOIN (SELECT vec_id, embedding FROM embeddings) ON vec_id = n)"""


def _intent(source: str) -> str:
    # classes as Unicode has them, which this dialect spells out
    wide = lambda p: p.replace("\\s", "[\\s\\p{Z}\\x0b\\x{85}]").replace("\\d", "\\p{Nd}")
    pid = ", ".join(f"nullif(regexp_extract(l, '{wide(p)}', 1), '')" for p in PATIENT)
    drug = "CASE " + " ".join(f"WHEN {_any('l', names)} THEN {_text(c)}" for c, names in NAMES.items()) + " END"
    span, day = wide(SPAN), wide(DAY)
    return f"""i AS (
  SELECT *, CASE WHEN patient_id IS NOT NULL THEN 'patient_specific' WHEN medication IS NOT NULL THEN 'cohort' ELSE 'general' END AS intent_type FROM (
    SELECT *, coalesce({pid}) AS patient_id, {drug} AS medication,
      coalesce(nullif(regexp_extract(l, '{span}', 1), ''), nullif(regexp_extract(l, '({day})', 1), '')) AS date_start, nullif(regexp_extract(l, '{span}', 2), '') AS date_end,
      array_to_string(list_filter({_list(SYMPTOMS)}, lambda s: contains(l, s)), '|') AS symptoms,
      CASE WHEN {_any('l', WORKED)} THEN 'successful' WHEN {_any('l', FAILED)} THEN 'refractory' END AS effectiveness,
      CASE WHEN {_any('l', SEIZURE_WORDS)} THEN CASE WHEN {_any('l', NEGATED)} THEN 'negative' ELSE 'positive' END END AS seizure_status
    FROM (SELECT *, lower(coalesce(query, '')) AS l FROM {source})))"""


SAID_TEXTS = "said AS (SELECT 'c-' || conv_id || '-' || turn AS query_id, text AS query FROM conversations UNION ALL SELECT query_id, query FROM asked)"
_MED = _NORMAL.format("want_medication")
WANT = (
    CHUNKS + ",\n" + ASKED + ",\n" + _intent("asked") + """,
w AS (SELECT *, coalesce(nullif(f_pid, ''), patient_id) AS want_patient_id, coalesce(nullif(f_med, ''), medication) AS want_medication,
        coalesce(nullif(f_ds, ''), date_start) AS ds, coalesce(nullif(f_de, ''), date_end) AS de FROM i)"""
)
SCOPE = (
    WANT + f""",
w2 AS (SELECT *, nullif({_MED}, '') AS med, strftime(try_strptime(ds, '%Y-%m-%d') - INTERVAL 90 DAY, '%Y-%m-%d') AS ws, strftime(try_strptime(de, '%Y-%m-%d') + INTERVAL 90 DAY, '%Y-%m-%d') AS we FROM w),
w3 AS (SELECT *, CASE WHEN med IS NOT NULL THEN {_TERMS.format('(' + _CANONICAL.format('med') + ')')} END AS terms FROM w2),
met AS (
  SELECT query_id, vector_id, w3.want_patient_id AS pid, med, ds, de,
    coalesce((ds IS NULL OR note_date >= ds) AND (de IS NULL OR note_date <= de) AND drug, false) AS base,
    coalesce((ws IS NULL OR note_date >= ws) AND (we IS NULL OR note_date <= we) AND drug, false) AS relaxed,
    coalesce((ds IS NULL OR note_date >= ds) AND (de IS NULL OR note_date <= de), false) AS nomed
  FROM (SELECT w3.*, c.vector_id, c.note_date, med IS NULL OR coalesce(len(list_filter(terms, lambda t: contains(lower(c.medication), t))) > 0, false) AS drug
        FROM w3 JOIN c ON w3.want_patient_id IS NULL OR c.patient_id = w3.want_patient_id) w3),
n AS (SELECT query_id, count(*) FILTER (base) AS b, count(*) FILTER (relaxed) AS x, count(*) FILTER (nomed) AS m FROM met GROUP BY query_id),
chosen AS (SELECT met.*, CASE WHEN b >= 10 OR coalesce(pid, med, ds, de) IS NULL THEN 'base' WHEN coalesce(ds, de) IS NOT NULL AND x >= 10 THEN 'relaxed' WHEN med IS NOT NULL AND m >= 10 THEN 'nomed' ELSE 'base' END AS choice
           FROM met JOIN n USING (query_id)),
s AS (SELECT query_id, vector_id, choice = 'relaxed' AS date_relaxed, choice = 'nomed' AS medication_dropped FROM chosen
      WHERE CASE choice WHEN 'base' THEN base WHEN 'relaxed' THEN relaxed ELSE nomed END)"""
)


def _dot(a: str, b: str) -> str:
    return f"round(list_dot_product(list_transform({a}, lambda z: CAST(z AS DOUBLE)), list_transform({b}, lambda z: CAST(z AS DOUBLE))), 9)"


def _ranked(source: str, score: str, k: int, name: str, part: str = "query_id") -> str:
    return f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {part} ORDER BY {score} DESC, vector_id) AS INTEGER) AS {name} FROM {source}) WHERE {name} <= {k}"


_PAIRS = "(SELECT query_id, c.vector_id, " + _dot("asked.embedding", "c.embedding") + " AS score_semantic FROM asked JOIN c ON asked.embedding IS NOT NULL AND c.embedding IS NOT NULL)"
_INSIDE = "(SELECT s.query_id, s.vector_id, " + _dot("asked.embedding", "c.embedding") + " AS score_semantic FROM s JOIN asked USING (query_id) JOIN c USING (vector_id) WHERE asked.embedding IS NOT NULL AND c.embedding IS NOT NULL)"
SEMANTIC = f"""v3 AS (SELECT * FROM ({_ranked(_PAIRS, 'score_semantic', 3 * K, 'r3')})),
sem AS ({_ranked('(SELECT v3.query_id, v3.vector_id, score_semantic FROM v3 SEMI JOIN s ON s.query_id = v3.query_id AND s.vector_id = v3.vector_id)', 'score_semantic', K, 'rank_semantic')})"""
PREFILTERED = f"sem AS ({_ranked(_INSIDE, 'score_semantic', K, 'rank_semantic')})"
_EXPANDED = (
    "concat_ws(' ', query, "
    + ", ".join(f"CASE WHEN {_any('q', names)} THEN concat_ws(' ', " + ", ".join(f"CASE WHEN q <> {_text(a)} THEN {_text(a)} END" for a in names) + ") END" for names in NAMES.values())
    + ")"
)


def _bm25(queries: str, scoped: str, docs: str, k: int) -> str:
    """queries: (query_id, query); scoped: (query_id, vector_id); docs: (vector_id, text)."""
    return f"""qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_WORDS.format('query')}) AS term FROM {queries}) GROUP BY ALL),
dt AS (SELECT vector_id, {_WORDS.format('text')} AS t FROM {docs}),
post AS (SELECT vector_id, dl, term, count(*) AS tf FROM (SELECT vector_id, len(t) AS dl, unnest(t) AS term FROM dt) GROUP BY ALL),
size AS (SELECT query_id, count(*) AS n_docs, avg(len(t)) AS avgdl FROM {scoped} sc JOIN dt USING (vector_id) GROUP BY query_id),
voc AS (SELECT query_id, term, count(*) AS n FROM {scoped} sc JOIN post USING (vector_id) GROUP BY ALL),
raw AS (SELECT query_id, term, avgdl, ln(n_docs - n + 0.5) - ln(n + 0.5) AS raw FROM voc JOIN size USING (query_id)),
idf AS (SELECT raw.query_id, term, avgdl, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw JOIN (SELECT query_id, avg(raw) AS mean FROM raw GROUP BY query_id) USING (query_id)),
hit AS (SELECT query_id, vector_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
        FROM qt JOIN idf USING (query_id, term) JOIN post USING (term) SEMI JOIN {scoped} sc ON sc.query_id = qt.query_id AND sc.vector_id = post.vector_id GROUP BY query_id, vector_id),
lex AS ({_ranked('(SELECT sc.query_id, sc.vector_id, coalesce(score, 0.0) AS score_lexical FROM ' + scoped + ' sc LEFT JOIN hit ON hit.query_id = sc.query_id AND hit.vector_id = sc.vector_id)', 'score_lexical', k, 'rank_lexical')})"""


LEXICAL = f"eq AS (SELECT query_id, {_EXPANDED} AS query FROM (SELECT query_id, query, {_NORMAL.format('query')} AS q FROM asked)),\n" + _bm25("eq", "s", "c", K)
_MM = "CASE WHEN min({0}) OVER w = max({0}) OVER w THEN {0} ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"
_NORM_MED = _NORMAL.format("medication")
_OVERLAP = "coalesce(common / nullif(len(qa) + len(qb) - common, 0), 0.0)"


def _final(semantic: str = SEMANTIC, ce: str = _OVERLAP) -> str:
    """All steps of the retrieval, with one of the two ways to search vectors and a reranker's score."""
    merged = SCOPE + ",\n" + semantic + ",\n" + LEXICAL + f""",
outer_join AS (SELECT query_id, vector_id, score_semantic, score_lexical, coalesce(score_semantic, 0) AS a, coalesce(score_lexical, 0) AS b FROM sem FULL JOIN lex USING (query_id, vector_id)),
scaled AS (SELECT *, {_MM.format('a')} AS score_semantic_norm, {_MM.format('b')} AS score_lexical_norm FROM outer_join WINDOW w AS (PARTITION BY query_id)),
merged AS ({_ranked('(SELECT *, round(0.6 * score_semantic_norm + 0.4 * score_lexical_norm, 9) AS score_combined_initial FROM scaled)', 'score_combined_initial', RERANKED, 'rank_initial')})"""
    return merged + f""",
pair AS (
  SELECT merged.*, c.* EXCLUDE (vector_id, embedding, text), text, asked.query, i.medication AS target, list_distinct({_WORDS.format('asked.query')}) AS qa, list_distinct({_WORDS.format('c.text')}) AS qb
  FROM merged JOIN c USING (vector_id) JOIN asked USING (query_id) JOIN i USING (query_id)),
scored AS (SELECT *, len(list_intersect(qa, qb)) AS common FROM pair),
flagged AS (
  SELECT *, {ce} AS score_ce, target IS NOT NULL AS has_target_med,
    coalesce(target IS NOT NULL AND list_contains({_TERMS.format('target')}, {_NORM_MED}), false) AS med_match_group FROM scored),
rk AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY score_ce DESC) + (count(*) OVER (PARTITION BY query_id, score_ce) - 1) / 2.0 AS rank_ce, count(*) OVER (PARTITION BY query_id) AS n_all FROM flagged),
fused AS (
  SELECT *, CASE WHEN n_all = 1 THEN 1.0 ELSE 1 - (rank_ce - 1) / (n_all - 1) END AS score_ce_norm,
    round(0.01 * has_seizure_info::INT + 0.01 * coalesce(medication_effectiveness = 'successful', false)::INT + 0.2 * med_match_group::INT
      - 0.05 * (has_target_med AND NOT med_match_group AND coalesce(trim(medication) <> '', false))::INT, 9)::DOUBLE AS score_boosts FROM rk),
final AS ({_ranked('(SELECT *, round(0.6::DOUBLE * score_ce_norm + 0.25::DOUBLE * score_semantic_norm + 0.15::DOUBLE * score_lexical_norm + score_boosts, 9) AS score_final FROM fused)', 'score_final', 10, 'rank')})"""


FINAL = _final()
MERGED = FINAL.partition(",\npair AS (")[0]
_BENCH = "bq AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query FROM benchmark), bd AS (SELECT doc_id AS vector_id, text FROM documents), bs AS (SELECT query_id, vector_id FROM bq, bd),\n" + _bm25("bq", "bs", "bd", K)
MEASURES = (
    _BENCH + """,
rel AS (SELECT query_id, CAST(query_id AS BIGINT) % 10 AS d, 'type' || (CAST(query_id AS BIGINT) % 10 % 3) AS intent_type FROM bq),
good AS (SELECT DISTINCT doc_id % 10 AS d, doc_id FROM labels WHERE quality = 1),
nr AS (SELECT query_id, intent_type, (SELECT count(*) FROM good WHERE good.d = rel.d) AS n_relevant FROM rel),
hits AS (SELECT lex.query_id, rank_lexical AS rank, (vector_id IN (SELECT doc_id FROM good WHERE good.d = rel.d))::INT AS hit FROM lex JOIN rel USING (query_id)),
run AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM hits),
agg AS (SELECT query_id, count(*) AS n_retrieved, sum(hit) FILTER (rank <= 10) AS h, min(rank) FILTER (hit = 1) AS f, sum(so_far / rank) FILTER (hit = 1) AS p FROM run GROUP BY query_id),
measures AS (SELECT query_id, intent_type, n_relevant, coalesce(n_retrieved, 0) AS n_retrieved, round(coalesce(h, 0) / 10.0, 9)::DOUBLE AS precision,
  round(CASE WHEN n_relevant > 0 THEN coalesce(h, 0) / n_relevant ELSE 0 END, 9)::DOUBLE AS recall, round(coalesce(1.0 / f, 0), 9)::DOUBLE AS rr,
  round(CASE WHEN n_relevant > 0 THEN coalesce(p, 0) / n_relevant ELSE 0 END, 9)::DOUBLE AS ap FROM nr LEFT JOIN agg USING (query_id))"""
)
STATS = (
    FINAL + """,
stats AS (
  SELECT query_id, count(*) AS num_retrieved, round(avg(score_final), 6) AS avg_score, min(score_final) AS min_score, max(score_final) AS max_score, round(stddev_samp(score_final), 6) AS score_std,
    arg_min(score_final, rank) AS top1_score, count(DISTINCT patient_id) AS unique_patients, count(DISTINCT medication) AS unique_medications,
    CAST(max(CAST(note_date AS DATE)) - min(CAST(note_date AS DATE)) AS INTEGER) AS date_range_days, round(avg(score_semantic_norm), 6) AS avg_semantic_score, round(avg(score_lexical_norm), 6) AS avg_lexical_score,
    round(avg(score_ce), 6) AS avg_ce_score FROM final GROUP BY query_id)"""
)
_TEXT_WINDOWS = "list_filter(list_concat(list_transform(range(0, CAST(ceil((length({0}) - 1200) / 1000.0) AS BIGINT) + 1), lambda k: substring({0}, k * 1000 + 1, 1200)), [substring({0}, length({0}) - 199, 200)]), lambda z: length(z) >= 200)"
CHUNKED = (
    "WITH RECURSIVE " + REGISTRY + f""",
p AS (SELECT row_id, list_filter(list_transform(string_split(note_text, e'\\n\\n'), lambda z: {_STRIP.format('z')}), lambda z: z <> '') AS p FROM r WHERE length(note_text) >= 50),
f AS (
  SELECT row_id, 0 AS i, []::VARCHAR[] AS done, '' AS buf FROM p
  UNION ALL
  SELECT row_id, i + 1, CASE WHEN length(x) > 1200 THEN list_concat(flushed, {_TEXT_WINDOWS.format('x')}) WHEN length(joined) <= 1200 THEN done ELSE flushed END,
    CASE WHEN length(x) > 1200 THEN '' WHEN length(joined) <= 1200 THEN joined ELSE x END
  FROM (SELECT f.*, p.p[i + 1] AS x, CASE WHEN buf = '' THEN done ELSE list_append(done, buf) END AS flushed, CASE WHEN buf = '' THEN p.p[i + 1] ELSE buf || e'\\n\\n' || p.p[i + 1] END AS joined
        FROM f JOIN p USING (row_id) WHERE i < len(p.p))),
packed AS (SELECT f.row_id, CASE WHEN buf = '' THEN done ELSE list_append(done, buf) END AS a FROM f JOIN p USING (row_id) WHERE i = len(p.p)),
led AS (SELECT row_id, list_filter(list_transform(a, lambda z, k: CASE WHEN k = 1 THEN z ELSE {_STRIP.format("substring(a[k - 1], greatest(length(a[k - 1]) - 199, 1)) || e'" + chr(92) + 'n' + chr(92) + "n' || z")} END), lambda z: length(z) >= 200) AS a FROM packed),
ch AS (SELECT row_id, unnest(a) AS chunk_text_full, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS chunk_index FROM led)"""
)
_FIX = f"CASE WHEN NOT regexp_full_match(w, '\\p{{L}}+') THEN w WHEN upper(w) IN ({', '.join(map(_text, KEPT_UPPER))}) THEN upper(w) WHEN w <> lower(w) AND w <> upper(w) THEN lower(w) ELSE w END"
_MEAN = lambda c, n: f"round(avg({c}), 6) AS {n}"
_EXTRACTED = """(VALUES (0, 'keppra', '500 mg', 2.0, 1, 'unknown', 'negative', '', 'po', 'tablet'), (1, 'lamictal', '25 mg', 1.0, 1, 'refractory', 'positive', 'focal|seizures', NULL, NULL),
  (2, 'valproic acid', '250 mg', 3.0, 1, 'successful', 'negative', '', NULL, NULL)) AS x(t, medication, medication_dosage, intake_times_per_day, drug_mention_count, medication_effectiveness, seizure_status, seizure_symptoms, route, form)"""

# The rewrites in this dialect, which looks neither behind nor ahead: what stands beside a match is taken along.
_W, _S = r"[\p{L}\p{M}\p{Nd}_]", r"[\t-\r \x{85}\p{Z}]"
_NOT_W = r"([^\p{L}\p{M}\p{Nd}_]|$)"


def _re(pattern: str, by: str):
    return lambda t: f"regexp_replace({t}, {_text(pattern.replace('<S>', _S).replace('<W>', _W).replace('<NOT_W>', _NOT_W))}, {_text(by)}, 'g')"


def _word(w: str) -> str:
    return f"regexp_matches(x, {_text('(?i)(^|[^' + _W[1:-1] + '])' + w + _NOT_W)})"


_SHORT = {
    "BID": "BID (twice daily)", "TID": "TID (three times daily)", "QID": "QID (four times daily)", "QD": "QD (once daily)", "QHS": "QHS (at bedtime)", "PRN": "PRN (as needed)", "PO": "PO (by mouth)",
    "IV": "IV (intravenous)", "SQ": "SQ (subcutaneous)", "IM": "IM (intramuscular)", "MIVF": "mIVF (intravenous fluids)",
}
_PIECES = _text(_W + "+|[^" + _W[1:-1] + "]+")


def _annotated(t: str) -> str:
    known = " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in _SHORT.items())
    hours = "regexp_full_match(w, '(?i)q\\p{Nd}+h')"
    return f"array_to_string(list_transform(regexp_extract_all({t}, {_PIECES}), lambda w: CASE WHEN {hours} THEN 'Q' || w[2:-2] || 'H (every ' || w[2:-2] || ' hours)' ELSE CASE upper(w) {known} ELSE w END END), '')"


STEPS = {
    "text_redaction": [_re(r"\*{2}[/-]\*{2}[/-]\*{4}", "[DATE-REDACTED]"), _re(r"\*{3,}", "[REDACTED]"), _re(r"(?i)(<W>)\[(?:REDACTED|DATE-REDACTED)\](<W>)", r"\1 [REDACTED] \2")],
    "text_blanks": [_re(r"[\x{A0}\x{2000}-\x{200B}\x{202F}\x{2060}]+", " "), _re(r"[\x{2013}\x{2014}]+", "-")],
    "text_questions": [_re(r"(?m)^<S>*\?+<S>*$", ""), _re(r"<S>\?<S>", "\n"), _re(r"\?{2,}([^\p{L}\p{M}\p{Nd}_?]|$)", r"\1"), _re(r"\?{2,}(\?<W>)", r"\1")],
    "text_bullets": [_re(r"(?m)^[\x{2022}\x{25AA}\x{25CF}>\-]<S>*", "")],
    "text_units": [*[_re(rf"(\p{{Nd}}+)<S>*(?i:{u})<NOT_W>", rf"\1 {u}\2") for u in ("mg", "mcg", "ml", "g", "l", "mcl")], _re(r"(\p{Nd}+)<S>*((?i:mg))<S>*/<S>*(\p{Nd}+)<S>*((?i:ml))<NOT_W>", r"\1 \2/\3 \4\5")],
    "text_headings": [_re(r"(?i)([A-Z](?:[A-Z/]|<S>){2,}:)<S>*", "\\1\n")],
    "text_vitals": [lambda t: f"array_to_string(list_transform(string_split({t}, e'\\n'), lambda x: CASE WHEN {_word('bp')} AND {_word('pulse')} THEN replace(x, ' | ', '. ') ELSE x END), e'\\n')"],
    "text_annotations": [_annotated],
    "text_tablets": [_re(r"(?i)Take<S>+(\p{Nd}+)<S>+tablet<S>*\((\p{Nd}+<S>*mg)<S>+total\)", r"Take \1 tablet of \2")],
    "text_spaces": [_re(r"(?m)[ \t]+$", ""), _re(r"\n{3,}", "\n\n"), _re(r"[\t\x0b-\r \x{85}\p{Z}]{2,}", " ")],
    "text_case": [lambda t: f"array_to_string(list_transform(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda w: {_FIX}), '')"],
    "text_tidy": [_re(r"(?m)[ \x{A0}]+$", ""), _re(r"\n{3,}", "\n\n"), lambda t: _STRIP.format(t)],
}
_LINE_ENDS = "replace(replace(replace({0}, e'\\r\\n', e'\\n'), e'\\r', e'\\n'), e'\\t', '    ')"
_NOTED = "(SELECT doc_id, " + _LINE_ENDS.format(f"coalesce(text, '') || e'\\n' || ({_list(LINES)})[1 + doc_id % {len(LINES)}]") + " AS text FROM documents)"


def _steps(text: str, *groups: str) -> str:
    for g in groups:
        for step in STEPS[g]:
            text = step(text)
    return text


_TURNS = f"""SELECT CAST(conv_id AS VARCHAR) AS patient_id, strftime(DATE '2020-01-01' + CAST(turn AS INTEGER), '%Y-%m-%d') AS note_date, turn, {_STRIP.format("coalesce(text, '') || e'" + chr(92) + "n' || (" + _list(SAID) + ")[1 + turn % 4]")} AS note_text FROM conversations"""
_NUMBERED = """k AS (SELECT *, CAST(row_number() OVER (PARTITION BY patient_id ORDER BY turn) AS INTEGER) AS note_idx FROM t WHERE note_text <> '') SELECT patient_id, note_idx, patient_id || '_' || note_date || '_' || lpad(CAST(note_idx AS VARCHAR), 3, '0') AS note_id, note_date, note_text FROM k"""
_FOUR = "query_id, vector_id, rank, score_final"

SQL: dict[str, str] = {
    "registry_scan": f"WITH {REGISTRY} SELECT * EXCLUDE (text, doc_id) FROM r",
    **{name: f"SELECT doc_id, {_steps('text', name)} AS text FROM {_NOTED}" for name in (*GROUPS, "text_tidy")},
    "text_chain": f"SELECT doc_id, {_steps('text', *GROUPS, 'text_case', 'text_tidy')} AS text FROM {_NOTED}",
    "text_minimal": "SELECT doc_id, regexp_replace(replace(replace(replace(coalesce(text, ''), e'\\r\\n', e'\\n'), e'\\r', e'\\n'), e'\\t', ' '), '(?m)[ \\x{A0}]+$', '', 'g') AS text FROM documents",
    "case_repair": f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda w: {_FIX}), '') AS text FROM documents",
    "tokenize": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {_WORDS.format('text')} AS t FROM documents)",
    "term_statistics": f"SELECT term, count(DISTINCT doc_id) AS df, CAST(count(*) AS BIGINT) AS cf FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents) GROUP BY term",
    "paragraph_windows": f"SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos, unnest(a) AS piece FROM (SELECT doc_id, CASE WHEN length(t) <= 1200 THEN [t] ELSE {_TEXT_WINDOWS.format('t')} END AS a FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))",
    "chunk_table": CHUNKED + f""" SELECT patient_id || '_' || note_date || '_' || row_id || '_chunk_' || chunk_index AS chunk_id, row_id AS source_row_id, patient_id, note_id, note_date, chunk_index, CAST(length(chunk_text_full) AS INTEGER) AS chunk_char_len,
  replace(substring(chunk_text_full, 1, 240), e'\\n', ' ') AS chunk_preview, chunk_text_full, medication, medication_dosage, intake_times_per_day, medication_effectiveness, seizure_status,
  array_to_string(list_filter(list_transform(string_split(seizure_symptoms, '|'), lambda z: trim(z)), lambda z: z <> ''), '|') AS seizure_symptoms, coalesce(seizure_status = 'positive', false) AS has_seizure_info FROM ch JOIN r USING (row_id)""",
    "symptom_split": f"WITH {REGISTRY}, a AS (SELECT row_id, list_filter(list_transform(string_split(seizure_symptoms, '|'), lambda z: trim(z)), lambda z: z <> '') AS a FROM r) SELECT row_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos, unnest(a) AS symptom FROM a",
    "alias_lookup": f"WITH {REGISTRY}, m AS (SELECT row_id, {_CANONICAL.format('(' + _NORM_MED + ')')} AS canonical FROM r) SELECT row_id, canonical, array_to_string({_TERMS.format('canonical')}, '|') AS terms FROM m",
    "intent_parse": f"WITH {ASKED}, {SAID_TEXTS}, {_intent('said')} SELECT query_id, intent_type, patient_id, medication, date_start, date_end, symptoms, effectiveness, seizure_status FROM i",
    "query_expand": f"WITH {ASKED}, {SAID_TEXTS} SELECT query_id, {_EXPANDED} AS expanded FROM (SELECT query_id, query, {_NORMAL.format('query')} AS q FROM said)",
    "scope_relax": f"WITH {SCOPE} SELECT * FROM s",
    "scope_filters": f"""WITH {SCOPE}, fl AS (SELECT query_id, bool_or(date_relaxed) AS dr, bool_or(medication_dropped) AS md FROM s GROUP BY query_id)
SELECT query_id, 'patient_id' AS name, want_patient_id AS value FROM w WHERE want_patient_id <> '' UNION ALL SELECT query_id, 'date_start', ds FROM w WHERE ds <> '' UNION ALL SELECT query_id, 'date_end', de FROM w WHERE de <> ''
UNION ALL SELECT query_id, 'medication', {_CANONICAL.format('(' + _MED + ')')} FROM w WHERE want_medication <> '' UNION ALL SELECT query_id, 'date_relaxed', 'true' FROM fl WHERE dr UNION ALL SELECT query_id, 'medication_dropped', 'true' FROM fl WHERE md""",
    "l2_normalize": "SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos, round(unnest(v) / (sqrt(list_sum(list_transform(v, lambda z: z * z))) + 1e-12), 6) AS value FROM (SELECT vec_id, list_transform(embedding, lambda z: CAST(z AS DOUBLE) * 3) AS v FROM embeddings)",
    "vector_topk": f"SELECT query_id, vector_id, rank_semantic, score_semantic FROM ({_ranked('(SELECT q.vec_id AS query_id, e.vec_id AS vector_id, ' + _dot('q.embedding', 'e.embedding') + ' AS score_semantic FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0)', 'score_semantic', 200, 'rank_semantic')})",
    "vector_topk_scoped": f"WITH {SCOPE}, {SEMANTIC} SELECT query_id, vector_id, rank_semantic, score_semantic FROM sem",
    "vector_topk_prefiltered": f"WITH {SCOPE} SELECT query_id, vector_id, rank_semantic, score_semantic FROM ({_ranked('(SELECT s.query_id, s.vector_id, ' + _dot('asked.embedding', 'c.embedding') + ' AS score_semantic FROM s JOIN asked USING (query_id) JOIN c USING (vector_id) WHERE asked.embedding IS NOT NULL AND c.embedding IS NOT NULL)', 'score_semantic', K, 'rank_semantic')})",
    "bm25_scoped": f"WITH {SCOPE}, {LEXICAL} SELECT query_id, vector_id, rank_lexical, round(score_lexical, 6) AS score_lexical FROM lex",
    "bm25_benchmark": f"WITH {_BENCH} SELECT query_id, vector_id, rank_lexical, round(score_lexical, 6) AS score_lexical FROM lex",
    "merge_minmax": f"WITH {MERGED} SELECT query_id, vector_id, rank_initial, score_semantic, score_lexical, round(score_semantic_norm, 6) AS score_semantic_norm, round(score_lexical_norm, 6) AS score_lexical_norm, score_combined_initial FROM merged",
    "average_ranks": """WITH x AS (SELECT doc_id, lang, length(text) % 50 AS score FROM documents), y AS (SELECT doc_id, lang, CAST(rank() OVER (PARTITION BY lang ORDER BY score DESC NULLS LAST) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS DOUBLE) AS rank_ce, count(*) OVER (PARTITION BY lang) AS n FROM x)
SELECT doc_id, rank_ce, round(CASE WHEN n = 1 THEN 1.0 ELSE 1 - (rank_ce - 1) / (n - 1) END, 6) AS score_ce_norm FROM y""",
    "retrieval": f"WITH {FINAL} SELECT query_id, vector_id, rank, chunk_id, med_match_group, has_target_med, CAST(rank_ce AS DOUBLE) AS rank_ce, round(score_ce, 6) AS score_ce, round(score_ce_norm, 6)::DOUBLE AS score_ce_norm, round(score_semantic_norm, 6) AS score_semantic_norm, round(score_lexical_norm, 6) AS score_lexical_norm, score_boosts, score_final FROM final",
    "retrieval_prefiltered": f"WITH {_final(PREFILTERED)} SELECT {_FOUR} FROM final",
    "retrieval_without_reranker": f"WITH {_final(ce='0.0::DOUBLE')} SELECT {_FOUR}, score_ce, CAST(rank_ce AS DOUBLE) AS rank_ce, score_ce_norm::DOUBLE AS score_ce_norm FROM final",
    "retrieval_fallback": f"WITH {FINAL}, lost AS ({_ranked(_PAIRS, 'score_semantic', 10, 'rank')}) SELECT {_FOUR} FROM final UNION ALL SELECT query_id, vector_id, rank, score_semantic FROM lost WHERE query_id NOT IN (SELECT query_id FROM s)",
    "registry_join": f"WITH {FINAL} SELECT query_id, rank, r.row_id, final.medication, r.medication AS medication_registry, r.patient_id AS patient_id_registry, r.note_id AS note_id_registry, CAST(length(r.note_text) AS INTEGER) AS note_chars FROM final LEFT JOIN r ON r.row_id = source_row_id",
    "audit_trail": f"""WITH {FINAL}, a AS (SELECT query_id, count(*) AS k FROM sem GROUP BY 1), b AS (SELECT query_id, count(*) AS k FROM lex GROUP BY 1), m2 AS (SELECT query_id, count(*) AS k FROM merged GROUP BY 1), f2 AS (SELECT query_id, count(*) AS k, arg_min(chunk_id, rank) AS t, arg_min(score_ce, rank) AS ce FROM final GROUP BY 1)
SELECT asked.query_id, coalesce(a.k, 0) AS semantic_candidates, coalesce(b.k, 0) AS lexical_candidates, coalesce(m2.k, 0) AS merged_candidates, coalesce(f2.k, 0) AS final_results, asked.query_id NOT IN (SELECT query_id FROM s) AS empty_scope,
  CAST(coalesce(f2.k, 0) AS INTEGER) AS n_breakdown, t AS top_chunk, round(ce, 6) AS top_ce FROM asked LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id) LEFT JOIN m2 USING (query_id) LEFT JOIN f2 USING (query_id)""",
    "prompt_answers": f"""WITH {FINAL}, g AS (SELECT query_id, string_agg('[' || rank || '] ' || substring(text, 1, {CHARS}), e'\\n\\n' ORDER BY rank) AS context, string_agg('[' || rank || '] ' || chunk_id, e'\\n' ORDER BY rank) AS sources, min(substring(text, 1, {CHARS})) FILTER (rank = 1) AS first FROM final WHERE rank <= {SOURCES} GROUP BY query_id)
SELECT query_id, 'Question: ' || query || e'\\n' || CASE WHEN want_patient_id <> '' THEN 'Patient ID: ' || want_patient_id || e'\\n' ELSE '' END || e'\\nContext:\\n' || coalesce(context, '') || e'\\n\\nReturn:\\n' || {_text(ASK)} || e'\\nSources:\\n' || coalesce(sources, '') AS prompt,
  CASE WHEN first IS NULL THEN {_STRIP.format(_text(ASK.partition('[1]')[2] + chr(10) + 'Sources:'))} || {_text(CITED)} ELSE {_STRIP.format('first')} || {_text(CITED)} END AS answer, replace(coalesce(sources, ''), e'\\n', '|') AS sources, coalesce(chunks, '') AS chunks
FROM w LEFT JOIN g USING (query_id) LEFT JOIN (SELECT query_id, string_agg(chunk_id, '|' ORDER BY rank) AS chunks FROM final GROUP BY query_id) USING (query_id)""",
    "ranking_measures": f"WITH {MEASURES} SELECT query_id, n_relevant, n_retrieved, precision, recall, rr, ap FROM measures",
    "measures_of_failed": f"WITH {MEASURES.replace('FROM lex JOIN rel USING (query_id)', 'FROM lex JOIN rel USING (query_id) WHERE CAST(lex.query_id AS BIGINT) % 3 <> 0')} SELECT query_id, n_relevant, n_retrieved, precision, recall, rr, ap FROM measures",
    "measure_summary": f"WITH {MEASURES} SELECT CASE WHEN grouping(intent_type) = 1 THEN 'overall' ELSE 'intent' END AS level, intent_type, count(*) AS num_queries, {', '.join(_MEAN(c, 'mean_' + c) for c in ('precision', 'recall', 'rr', 'ap'))}, {', '.join(f'round(median({c}), 6) AS median_{c}' for c in ('precision', 'recall', 'rr'))} FROM measures GROUP BY GROUPING SETS ((), (intent_type))",
    "score_statistics": f"WITH {STATS} SELECT * FROM stats",
    "statistics_by_type": f"WITH {STATS} SELECT query_type, count(*) AS queries, round(avg(avg_score), 6) AS avg_score, round(avg(num_retrieved), 6) AS avg_results, round(avg(top1_score), 6) AS avg_top1_score FROM stats JOIN asked USING (query_id) GROUP BY query_type",
    "statistics_overall": f"WITH {STATS} SELECT count(*) AS total_queries, count(num_retrieved) AS successful_queries, round(count(num_retrieved) / count(*), 6) AS success_rate, {_MEAN('num_retrieved', 'avg_results_per_query')}, {_MEAN('avg_score', 'avg_score_overall')}, {_MEAN('top1_score', 'avg_top1_score')}, {_MEAN('avg_semantic_score', 'avg_semantic_contribution')}, {_MEAN('avg_lexical_score', 'avg_lexical_contribution')}, {_MEAN('avg_ce_score', 'avg_ce_contribution')} FROM asked LEFT JOIN stats USING (query_id)",
    "statistics_matrix": f"""WITH {STATS} SELECT query_id, unnest(['results', 'average', 'best', 'steadiness', 'semantic', 'lexical', 'reranker']) AS metric, round(unnest([num_retrieved / 10, avg_score, top1_score, 1 - coalesce(score_std, 0), avg_semantic_score, avg_lexical_score, avg_ce_score]), 6) AS value FROM stats""",
    "score_points": f"WITH {FINAL} SELECT query_id, score_final AS score, count(*) AS n FROM final GROUP BY ALL",
    "export_rows": f"WITH {FINAL}, g AS (SELECT query_id, count(*) AS num_results, round(avg(score_final), 6) AS avg_final, arg_min(patient_id, rank) AS top_patient, min(medication) FILTER (rank = 1) AS top_medication, arg_min(score_final, rank) AS top_score FROM final GROUP BY query_id) SELECT query_id, coalesce(num_results, 0) AS num_results, avg_final, top_patient, top_medication, top_score FROM asked LEFT JOIN g USING (query_id)",
    "patient_summary": f"WITH {REGISTRY} SELECT patient_id, count(*) AS n_rows, count(DISTINCT medication) AS n_medications, min(note_date) AS first_date, max(note_date) AS last_date, count(*) FILTER (seizure_status = 'positive') AS n_positive, count(*) FILTER (seizure_status = 'negative') AS n_negative, count(*) FILTER (seizure_status = 'unknown') AS n_unknown FROM r GROUP BY patient_id",
    "top_medications": f"WITH {REGISTRY} SELECT medication, count(*) AS n_rows FROM r WHERE medication IS NOT NULL GROUP BY medication ORDER BY n_rows DESC, medication LIMIT 10",
    "top_medications_by_patient": f"WITH {REGISTRY}, g AS (SELECT patient_id, medication, count(*) AS n_rows FROM r WHERE medication IS NOT NULL GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY patient_id ORDER BY n_rows DESC, medication) AS INTEGER) AS place FROM g) WHERE place <= 3",
    "registry_totals": f"WITH {REGISTRY} SELECT count(*) AS n_rows, count(DISTINCT patient_id) AS n_patients, count(DISTINCT medication) AS n_medications, count(medication_dosage) AS n_dosage, count(intake_times_per_day) AS n_frequency, count(*) FILTER (medication_effectiveness = 'successful') AS n_successful, count(*) FILTER (medication_effectiveness = 'refractory') AS n_refractory FROM r",
    "chunk_totals": f"WITH {CHUNKS} SELECT count(*) AS n_chunks, count(DISTINCT patient_id) AS n_patients, count(DISTINCT source_row_id) AS n_source_rows, count(DISTINCT medication) AS n_medications, count(*) FILTER (has_seizure_info) AS n_seizure, round(100 * count(*) FILTER (has_seizure_info) / count(*), 6) AS pct_seizure FROM c",
    "type_distribution": f"WITH {ASKED}, {SAID_TEXTS}, {_intent('said')} SELECT intent_type, count(*) AS num_queries FROM i GROUP BY intent_type",
    "row_numbers": f"WITH {REGISTRY} SELECT patient_id, note_date, doc_id AS n, row_number() OVER (PARTITION BY patient_id ORDER BY note_date, doc_id) AS row_no FROM r",
    "vector_numbers": f"WITH {REGISTRY} SELECT patient_id, doc_id AS n, row_number() OVER (ORDER BY patient_id, doc_id) - 1 AS vector_id FROM r",
    "note_split": f"WITH t AS ({_TURNS}), {_NUMBERED}",
    "note_split_odd": f"WITH t AS (SELECT * FROM ({_TURNS}) WHERE turn % 4 <> 1 AND CAST(patient_id AS BIGINT) % 5 <> 0), {_NUMBERED}",
    "note_split_cleaned": f"WITH t AS (SELECT * REPLACE ({_steps(_LINE_ENDS.format('note_text'), *GROUPS, 'text_case', 'text_tidy')} AS note_text) FROM ({_TURNS})), {_NUMBERED}",
    "registry_build": f"""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS patient_id, strftime(DATE '2020-01-01' + CAST(turn AS INTEGER), '%Y-%m-%d') AS note_date, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
SELECT patient_id || '-' || row_number() OVER (PARTITION BY patient_id ORDER BY turn) AS row_id, patient_id || '_' || note_date || '_' || lpad(CAST(i AS VARCHAR), 3, '0') AS note_id, note_date, medication, medication_dosage, CAST(intake_times_per_day AS DOUBLE) AS intake_times_per_day,
  drug_mention_count, medication_effectiveness, seizure_status, seizure_symptoms, route, form FROM t JOIN {_EXTRACTED} ON turn % 4 = x.t""",
    "filters_json": "SELECT event_id, unnest(json_keys(props)) AS name, unnest(list_transform(json_keys(props), lambda z: json_extract_string(props, '$.' || z))) AS value FROM events",
    "unlinked_chunks": "SELECT 0::BIGINT AS n",
    "shared_between_patients": "SELECT 0::BIGINT AS n",
    "out_of_scope_results": "SELECT 0::BIGINT AS n",
}
