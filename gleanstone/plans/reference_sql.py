"""SQL twins of the engine's own queries, for DuckDB on the same tables."""

from __future__ import annotations

from gleanstone.config import NEGATIVE_WORDS, POSITIVE_WORDS, QUOTAS, SIGNAL_WEIGHTS
from gleanstone.functions.coerce import TRUNCATION_MARK
from gleanstone.functions.pii import EMAIL
from gleanstone.functions.stats import Z
from gleanstone.operators.signals import INJECTIONS, REFUSALS
from gleanstone.operators.similarity import PRIME, minhash_family

_WS = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(words: tuple[str, ...]) -> str:
    return ", ".join(map(_q, words))


_R = "r AS (SELECT DISTINCT ON (record_id) * FROM records)"
_FP = f"sha256(lower(trim(regexp_replace(input_text, '{_WS}+', ' ', 'g'))))"
_BLANK = lambda c: f"regexp_replace({c}, '{_WS}+|[\\x{{200B}}\\x{{FEFF}}]', '', 'g') = ''"
_REAL = "(regexp_full_match(ts_utc, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z') AND try_strptime(ts_utc, '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL)"
_FAULT = f"""CASE
    WHEN record_id IS NULL OR {_BLANK('record_id')} OR regexp_matches(record_id, '[\\r\\n]') THEN 'record_id'
    WHEN NOT coalesce({_REAL}, false) THEN 'ts_utc'
    WHEN input_text IS NULL OR {_BLANK('input_text')} THEN 'input_text'
    {' '.join(f"WHEN {_BLANK(c)} THEN '{c}'" for c in ('output_text', 'prompt_version', 'arm', 'error', 'feedback'))}
    {' '.join(f"WHEN {c} < 0 THEN '{c}'" for c in ('latency_ms', 'input_tokens', 'output_tokens', 'cost_micro_usd'))}
    WHEN (output_text IS NULL) = (error IS NULL) THEN 'outcome'
    WHEN len(list_filter(judge_verdicts, lambda v: v.criterion IS NULL OR v.passed IS NULL OR trim(v.criterion) = '')) > 0 THEN 'verdict'
    WHEN len(list_distinct(list_transform(judge_verdicts, lambda v: v.criterion))) < len(judge_verdicts) THEN 'verdict_twice'
    ELSE 'valid' END"""
_CONTEXT = """c AS (SELECT window_id,
    CASE WHEN count(latency_ms) >= 12 THEN quantile_disc(latency_ms, 0.95) END AS latency_p, count(latency_ms) AS latency_p_n,
    CASE WHEN count(input_text) >= 12 THEN quantile_disc(length(input_text), 0.95) END AS input_len_p, count(input_text) AS input_len_p_n,
    CASE WHEN count(output_text) >= 12 THEN quantile_disc(length(output_text), 0.95) END AS output_len_p, count(output_text) AS output_len_p_n
    FROM r GROUP BY window_id)"""
_DISAGREE = f"""o AS (SELECT {_FP} AS fingerprint, prompt_version AS version,
        array_to_string(list_sort(list_distinct(list(CASE WHEN error IS NOT NULL OR len(list_filter(judge_verdicts, lambda v: NOT v.passed)) > 0 THEN 'failed' ELSE 'passed' END))), '/') AS outcomes
        FROM r WHERE prompt_version IS NOT NULL GROUP BY ALL),
    v AS (SELECT fingerprint, array_to_string(list_sort(list(version || ' (' || outcomes || ')')), ', ') AS versions FROM o GROUP BY fingerprint HAVING count(*) >= 2 AND count(DISTINCT outcomes) >= 2)"""
_MATCH = lambda c, ps: "(" + " OR ".join(f"regexp_matches({c}, {_q('(?i)' + p)})" for _, p in ps) + ")"
_FIRES = {
    "error": "error IS NOT NULL",
    "judge_failure": "len(list_filter(judge_verdicts, lambda v: NOT v.passed)) > 0",
    "negative_feedback": f"lower(trim(feedback)) IN ({_words(NEGATIVE_WORDS)})",
    "feedback_conflict": f"lower(trim(feedback)) IN ({_words(POSITIVE_WORDS)}) AND (error IS NOT NULL OR len(list_filter(judge_verdicts, lambda v: NOT v.passed)) > 0)",
    "version_disagreement": "versions IS NOT NULL",
    "injection_pattern": _MATCH("input_text", INJECTIONS),
    "refusal_pattern": _MATCH("output_text", REFUSALS),
    "latency_outlier": "latency_ms >= latency_p",
    "length_outlier": "length(input_text) >= input_len_p OR length(output_text) >= output_len_p",
    "non_ascii_ratio": "length(regexp_replace(input_text, '[\\x00-\\x7F]', '', 'g')) / length(input_text) > 0.25",
    "tiny_input": "length(trim(input_text)) < 24",
}
_SCORED = f"""WITH {_R}, {_CONTEXT}, {_DISAGREE},
    f AS (SELECT r.window_id, r.record_id, {', '.join(f"coalesce({c}, false) AS s_{n}" for n, c in _FIRES.items())}
        FROM r JOIN c USING (window_id) LEFT JOIN v ON v.fingerprint = {_FP}),
    s AS (SELECT window_id, record_id, CAST({' + '.join(f"CASE WHEN s_{n} THEN {SIGNAL_WEIGHTS[n]} ELSE 0 END" for n in _FIRES)} AS INTEGER) AS score,
        list_filter([{', '.join(f"CASE WHEN s_{n} THEN '{n}' END" for n in SIGNAL_WEIGHTS if n in _FIRES)}], lambda x: x IS NOT NULL) AS names FROM f)"""
_WEIGHTS = "w(name, weight, place) AS (VALUES " + ", ".join(f"('{n}', {k}, {i})" for i, (n, k) in enumerate(SIGNAL_WEIGHTS.items())) + ")"
_RANKED = f"""WITH {_WEIGHTS}, s AS (SELECT DISTINCT ON (record_id) record_id, score, signals FROM scores WHERE score IS NOT NULL),
    g AS (SELECT record_id, min(cluster_id) AS cluster_id FROM candidates WHERE cluster_id IS NOT NULL GROUP BY record_id),
    t AS (SELECT u.record_id, arg_min(w.name, -w.weight * 100 + w.place) AS stratum FROM (SELECT record_id, unnest(signals) AS x FROM s) u JOIN w ON w.name = u.x.name GROUP BY u.record_id),
    k AS (SELECT s.record_id, s.score, coalesce(t.stratum, 'ordinary') AS stratum, g.cluster_id FROM s JOIN g USING (record_id) LEFT JOIN t USING (record_id))"""
_QUOTA = "q(stratum, quota) AS (VALUES " + ", ".join(f"('{n}', {k})" for n, k in QUOTAS.items()) + ")"
_NORM = f"trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\\[([a-z]+)_[0-9]+\\]', '[\\1]', 'g'), '\\p{{Nd}}+', ' ', 'g'), '{_WS}+', ' ', 'g'))"
_NORM_OF = lambda c: _NORM.replace("lower(text)", f"lower({c})")
_GRAMS = lambda w: f"CASE WHEN len({w}) <= 5 THEN [array_to_string({w}, ' ')] ELSE list_distinct(list_transform(range(1, len({w}) - 3), lambda i: array_to_string({w}[i:i+4], ' '))) END"
_DOCS = "d AS (SELECT DISTINCT ON (doc_id) * FROM documents WHERE text IS NOT NULL)"
_SETS = f"{_DOCS}, n AS (SELECT doc_id, source, string_split({_NORM}, ' ') AS w FROM d), g AS (SELECT doc_id, source, {_GRAMS('w')} AS grams FROM n WHERE w[1] <> ''), x AS (SELECT doc_id, source, unnest(grams) AS shingle FROM g), z AS (SELECT doc_id, len(grams) AS n FROM g)"
_GOLD = "coalesce({}.source = 'golden_drafts', false)"
_A, _B = minhash_family(4)
_WILSON = lambda h, n, s: f"(({h} / {n} + {Z * Z} / (2 * {n})) {s} {Z} * sqrt({h} / {n} * (1 - {h} / {n}) / {n} + {Z * Z} / (4.0 * {n} * {n}))) / (1 + {Z * Z} / {n})"
_PAIRS = "p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b USING (shingle) WHERE {} GROUP BY ALL), j AS (SELECT a, b, c / (za.n + zb.n - c) AS jaccard FROM p JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b)"

MINHASH = (
    f"WITH {_SETS}, h AS (SELECT doc_id, CAST(('0x' || substring(md5(shingle), 1, 15))::BIGINT AS HUGEINT) AS b FROM x) SELECT doc_id, "
    + ", ".join(f"CAST(min((b * {m}::HUGEINT + {o}::HUGEINT) % {PRIME}::HUGEINT) AS VARCHAR) AS h{i}" for i, (m, o) in enumerate(zip(_A, _B)))
    + " FROM h GROUP BY doc_id"
)

ORACLES = {
    "q_record_faults": f"WITH {_R} SELECT {_FAULT} AS fault, count(*) AS records FROM r GROUP BY 1",
    "q_fingerprint_dedupe": f"WITH {_R} SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY {_FP} ORDER BY received_at, record_id) AS n FROM r) WHERE n = 1",
    "q_duplicate_histogram": f"WITH {_R}, s AS (SELECT count(*) AS copies FROM r GROUP BY {_FP}) SELECT copies, count(*) AS texts FROM s GROUP BY copies",
    "q_distinct_inputs": f"WITH {_R} SELECT count(DISTINCT {_FP}) AS distinct_inputs FROM r",
    "q_percentile_context": f"WITH {_R}, {_CONTEXT} SELECT * FROM c",
    "q_version_disagreement": f"WITH {_R}, {_DISAGREE} SELECT fingerprint, versions FROM v",
    "q_scored": _SCORED + " SELECT window_id, record_id, score, array_to_string(names, ',') AS fired FROM s",
    "q_signal_histogram": _SCORED + " SELECT signal, count(*) AS records FROM (SELECT unnest(names) AS signal FROM s) GROUP BY signal",
    "q_strata_of_scores": _RANKED + " SELECT record_id, stratum FROM k",
    "q_quota_topk": _RANKED + f", {_QUOTA}, p AS (SELECT *, CAST(row_number() OVER (PARTITION BY stratum ORDER BY score DESC, record_id) AS INTEGER) AS place FROM k) SELECT stratum, record_id, place FROM p JOIN q USING (stratum) WHERE place <= quota",
    "q_cluster_topk": _RANKED + " SELECT cluster_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, record_id) AS n FROM k) WHERE n = 1",
    "q_orphan_scores": "SELECT DISTINCT record_id FROM scores WHERE record_id NOT IN (SELECT record_id FROM candidates WHERE record_id IS NOT NULL)",
    "q_error_rates": f"""WITH {_R}, m AS (SELECT window_id, count(*) AS n, count(error) AS h, 'error' AS measure FROM r WHERE window_id IS NOT NULL GROUP BY 1
        UNION ALL SELECT window_id, count(*), count(*) FILTER (WHERE lower(trim(feedback)) IN ({_words(NEGATIVE_WORDS)})), 'negative_feedback' FROM r WHERE window_id IS NOT NULL GROUP BY 1),
        p AS (SELECT lag(window_id) OVER w AS earlier, window_id AS later, measure, lag(n) OVER w AS n_a, lag(h) OVER w AS hits_a, n AS n_b, h AS hits_b FROM m WINDOW w AS (PARTITION BY measure ORDER BY window_id)),
        b AS (SELECT *, hits_a / n_a AS ra, hits_b / n_b AS rb, greatest({_WILSON('hits_a', 'n_a', '-')}, 0) AS la, least({_WILSON('hits_a', 'n_a', '+')}, 1) AS ha, greatest({_WILSON('hits_b', 'n_b', '-')}, 0) AS lb, least({_WILSON('hits_b', 'n_b', '+')}, 1) AS hb FROM p WHERE earlier IS NOT NULL)
        SELECT earlier, later, measure, n_a, hits_a, n_b, hits_b, round(ra, 6) AS rate_a, round(rb, 6) AS rate_b, round(la, 6) AS low_a, round(ha, 6) AS high_a, round(lb, 6) AS low_b, round(hb, 6) AS high_b, round(rb - ra, 6) AS delta, (lb > ha) OR (la > hb) AS separated FROM b""",
    "q_latency_shift": f"""WITH {_R}, t AS (SELECT window_id AS w, latency_ms AS v FROM r WHERE latency_ms IS NOT NULL AND window_id IS NOT NULL),
        n AS (SELECT w, count(*) AS n, CAST(median(v) AS DOUBLE) AS m FROM t GROUP BY w), p AS (SELECT lag(w) OVER (ORDER BY w) AS earlier, w AS later FROM n),
        c AS (SELECT earlier, later, v, count(*) FILTER (WHERE w = earlier) AS a, count(*) FILTER (WHERE w = later) AS b FROM p JOIN t ON t.w = p.earlier OR t.w = p.later WHERE earlier IS NOT NULL GROUP BY ALL),
        s AS (SELECT earlier, later, sum(a) OVER q AS ca, sum(b) OVER q AS cb, sum(a) OVER (PARTITION BY earlier, later) AS na, sum(b) OVER (PARTITION BY earlier, later) AS nb FROM c WINDOW q AS (PARTITION BY earlier, later ORDER BY v)),
        k AS (SELECT earlier, later, max(abs(ca / na - cb / nb)) AS ks FROM s GROUP BY ALL)
        SELECT earlier, later, round(ks, 6) AS ks, x.n AS n_first, y.n AS n_second, x.m AS median_a, y.m AS median_b FROM k JOIN n x ON x.w = earlier JOIN n y ON y.w = later""",
    "q_length_shift": f"""WITH {_R}, e AS (SELECT min(window_id) AS x, max(window_id) AS y FROM r), t AS (SELECT window_id AS w, length(input_text) AS v FROM r, e WHERE input_text IS NOT NULL AND window_id IN (x, y)),
        c AS (SELECT v, count(*) FILTER (WHERE w = x) AS a, count(*) FILTER (WHERE w = y) AS b FROM t, e GROUP BY v),
        n AS (SELECT sum(a) AS na, sum(b) AS nb FROM c), s AS (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb FROM c)
        SELECT round(max(abs(ca / na - cb / nb)), 6) AS ks, CAST(any_value(na) AS BIGINT) AS n_first, CAST(any_value(nb) AS BIGINT) AS n_second,
            (SELECT median(v) FROM t, e WHERE w = x)::DOUBLE AS median_a, (SELECT median(v) FROM t, e WHERE w = y)::DOUBLE AS median_b FROM s, n""",
    "q_coerced_counts": f"""WITH t AS (SELECT DISTINCT ON (ticket_id) ticket_id, duration_ms AS d, trim(duration_ms) AS s FROM support_tickets),
        u AS (SELECT ticket_id, d IS NULL OR {_BLANK('d')} AS absent, CASE WHEN regexp_full_match(s, '[+-]?[0-9]{{1,18}}') THEN try_cast(s AS BIGINT) WHEN try_cast(s AS DOUBLE) = floor(try_cast(s AS DOUBLE)) AND abs(try_cast(s AS DOUBLE)) < 9e18 THEN CAST(try_cast(s AS DOUBLE) AS BIGINT) END AS n FROM t)
        SELECT ticket_id, n AS duration, absent OR n IS NOT NULL AS ok FROM u""",
    "q_event_paths": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "q_epochs": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS from_seconds, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS from_millis FROM events",
    "q_case_ids": f"WITH {_R} SELECT record_id, 'gleanstone_' || trim(regexp_replace(lower(window_id), '[^a-z0-9]+', '_', 'g'), '_') || '_' || trim(regexp_replace(lower(record_id), '[^a-z0-9]+', '_', 'g'), '_') AS case_id FROM r",
    "q_truncations": f"WITH {_DOCS} SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || {_q(TRUNCATION_MARK)} ELSE text END AS cut FROM d",
    "q_shingle_stats": f'WITH {_SETS} SELECT doc_id, n AS "size" FROM z',
    "q_best_overlap": f"WITH {_SETS}, {_PAIRS.format('NOT ' + _GOLD.format('a') + ' AND ' + _GOLD.format('b'))} SELECT g.doc_id, round(coalesce(max(jaccard), 0), 6) AS best_overlap FROM g LEFT JOIN j ON j.a = g.doc_id WHERE NOT {_GOLD.format('g')} GROUP BY g.doc_id",
    "q_stale_goldens": f"WITH {_SETS}, {_PAIRS.format(_GOLD.format('a') + ' AND NOT ' + _GOLD.format('b'))} SELECT g.doc_id AS golden_id, round(coalesce(max(jaccard), 0), 6) AS best_overlap FROM g LEFT JOIN j ON j.a = g.doc_id WHERE {_GOLD.format('g')} GROUP BY g.doc_id HAVING coalesce(max(jaccard), 0) < 0.2",
    "q_redundant_goldens": f"WITH {_SETS}, {_PAIRS.format(_GOLD.format('a') + ' AND ' + _GOLD.format('b') + ' AND a.doc_id < b.doc_id')} SELECT a AS golden_id, b AS other, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.05",
    "q_email_spans": f"WITH {_R}, e AS (SELECT record_id, input_text, regexp_extract_all(input_text, {_q(EMAIL)}) AS m FROM r) SELECT record_id, CAST(len(m) AS INTEGER) AS emails, CAST(strpos(input_text, m[1]) - 1 AS INTEGER) AS first_at FROM e WHERE len(m) > 0",
}
