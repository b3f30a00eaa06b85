"""SQL twins of the queries of ``stages`` and of those of ``reference`` that need recursion, for DuckDB on the same tables."""

from __future__ import annotations

from gleanstone.config import NAME_ALLOWLIST, POSITIVE_WORDS, SIGNAL_WEIGHTS, Select
from gleanstone.functions import pii
from gleanstone.operators.emit import PREFIX
from gleanstone.operators.label import PLACEHOLDER_MARK
from gleanstone.plans.reference_sql import MINHASH, _BLANK, _CONTEXT, _DISAGREE, _FIRES, _FP, _NORM_OF, _QUOTA, _R, _RANKED, _SETS, _WILSON, _WS, ORACLES as PLAIN, _q, _words

_ABSENT = lambda c: f"({c} IS NULL OR {_BLANK(c)})"
_TRIM = lambda c: f"trim({c}, ' ')"
_ISO = r"^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*([Zz]|[+-]\d{2}:?\d{2})?$"
_PART = lambda c, k: f"regexp_extract({_TRIM(c)}, '{_ISO}', {k})"
_N = lambda c, k: f"try_cast(nullif({_PART(c, k)}, '') AS BIGINT)"
_ZONE = lambda c: f"replace({_PART(c, 7)}, ':', '')"


def _instant(c: str, naive_is_utc: bool) -> str:
    """Canonical UTC text of an ISO form or an epoch in seconds or milliseconds, else null."""
    size = f"(try_cast(substring({_ZONE(c)}, 2, 2) AS BIGINT) * 3600 + try_cast(substring({_ZONE(c)}, 4, 2) AS BIGINT) * 60)"
    offset = f"CASE WHEN lower({_ZONE(c)}) = 'z' THEN 0 WHEN {_ZONE(c)} = '' THEN {'0' if naive_is_utc else 'NULL'} WHEN {_ZONE(c)}[1] = '-' THEN -{size} ELSE {size} END"
    day = f"epoch(try_strptime({_PART(c, 1)} || '-' || {_PART(c, 2)} || '-' || {_PART(c, 3)}, '%Y-%m-%d'))"
    clock = f"CASE WHEN {_N(c, 4)} <= 23 AND {_N(c, 5)} <= 59 AND coalesce({_N(c, 6)}, 0) <= 59 THEN {_N(c, 4)} * 3600 + {_N(c, 5)} * 60 + coalesce({_N(c, 6)}, 0) END"
    epoch = f"CASE WHEN try_cast({_TRIM(c)} AS DOUBLE) >= 1e11 THEN floor(try_cast({_TRIM(c)} AS DOUBLE) / 1000) ELSE floor(try_cast({_TRIM(c)} AS DOUBLE)) END"
    seconds = f"CASE WHEN regexp_matches({_TRIM(c)}, '^\\d+(?:\\.\\d+)?$') THEN {epoch} WHEN regexp_matches({_TRIM(c)}, '{_ISO}') THEN {day} + {clock} - {offset} END"
    return f"(SELECT CASE WHEN s BETWEEN -62135596800 AND 253402300799 THEN strftime(make_timestamp(CAST(s AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END FROM (SELECT {seconds} AS s))"


_WHOLE = lambda c: f"CASE WHEN regexp_full_match({_TRIM(c)}, '[+-]?[0-9]{{1,18}}') THEN try_cast({_TRIM(c)} AS BIGINT) WHEN try_cast({_TRIM(c)} AS DOUBLE) = floor(try_cast({_TRIM(c)} AS DOUBLE)) AND abs(try_cast({_TRIM(c)} AS DOUBLE)) < 9e18 THEN CAST(try_cast({_TRIM(c)} AS DOUBLE) AS BIGINT) END"
_OR_NULL = lambda c: f"CASE WHEN NOT {_ABSENT(c)} THEN {c} END"
_TICKETS = f"""t AS (SELECT DISTINCT ON (ticket_id) * FROM support_tickets),
    u AS (SELECT ticket_id AS line_no, {_OR_NULL('ticket_id')} AS record_id, opened_at, {_instant('opened_at', True)} AS inst, {_OR_NULL('question')} AS input_text, {_OR_NULL('answer')} AS output_text,
        coalesce({_OR_NULL('variant')}, 'none') AS arm, duration_ms, {_WHOLE('duration_ms')} AS whole, {_OR_NULL('rating')} AS feedback FROM t),
    b AS (SELECT *, CASE WHEN {_ABSENT('opened_at')} THEN NULL ELSE inst END AS ts_utc, CASE WHEN {_ABSENT('duration_ms')} THEN NULL ELSE whole END AS latency_ms,
        CASE WHEN record_id IS NULL THEN 'missing_field:record_id' WHEN {_ABSENT('opened_at')} THEN 'missing_field:ts_utc' WHEN input_text IS NULL THEN 'missing_field:input_text'
            WHEN inst IS NULL THEN 'field_type:ts_utc' WHEN NOT {_ABSENT('duration_ms')} AND whole IS NULL THEN 'field_type:latency_ms'
            WHEN NOT {_ABSENT('duration_ms')} AND whole < 0 THEN 'invalid_record:latency_ms' WHEN output_text IS NULL THEN 'invalid_record:outcome' END AS fault FROM u)"""
_SPLIT = "nullif(split_part(coalesce(fault, ''), ':', 1), '') AS error_type, nullif(split_part(coalesce(fault, ''), ':', 2), '') AS detail"
_JUDGED = f"""jt AS (SELECT DISTINCT ON (request_id) * FROM judged_summaries),
    ju AS (SELECT request_id AS line_no, ts_utc AS raw, {_instant('ts_utc', False)} AS inst, {_OR_NULL('request_id')} AS record_id, {_OR_NULL('question')} AS input_text, {_OR_NULL('answer')} AS output_text, {_OR_NULL('error_type')} AS failed, latency_ms, verdicts FROM jt),
    jb AS (SELECT *, array_to_string(list_transform(verdicts, lambda v: v.criterion || '=' || CAST(v.ok AS VARCHAR)), '; ') AS told,
        CASE WHEN record_id IS NULL THEN 'missing_field:record_id' WHEN {_ABSENT('raw')} THEN 'missing_field:ts_utc' WHEN input_text IS NULL THEN 'missing_field:input_text' WHEN inst IS NULL THEN 'field_type:ts_utc'
            WHEN len(list_filter(verdicts, lambda v: v.criterion IS NULL OR v.ok IS NULL)) > 0 THEN 'field_type:judge_verdicts' WHEN latency_ms < 0 THEN 'invalid_record:latency_ms'
            WHEN (output_text IS NULL) = (failed IS NULL) THEN 'invalid_record:outcome' WHEN len(list_filter(verdicts, lambda v: {_BLANK('v.criterion')})) > 0 THEN 'invalid_record:verdict'
            WHEN len(list_distinct(list_transform(verdicts, lambda v: v.criterion))) < len(verdicts) THEN 'invalid_record:verdict_twice' END AS fault FROM ju)"""
_D, _W, _S = r"\p{Nd}", r"\p{L}\p{M}\p{Nd}\p{Pc}", r"[\s\x{85}\p{Z}]"
_OCTET = rf"(?:25[0-5]|2[0-4]{_D}|1{_D}{{2}}|[1-9]?{_D})"
_FIND = {
    "email": (pii.EMAIL, 0),
    "iban": (rf"(?:^|[^A-Za-z0-9])([A-Z]{{2}}{_D}{{2}}(?:[ ]?[A-Za-z0-9]{{4}}){{2,7}}(?:[ ]?[A-Za-z0-9]{{1,3}})?)(?:$|[^A-Za-z0-9])", 1),
    "card": (rf"(?:^|[^{_D}])({_D}(?:[ \-._]?{_D}){{12,18}})(?:$|[^{_D}])", 1),
    "ssn": (rf"(?:^|[^{_D}-])({_D}{{3}}-{_D}{{2}}-{_D}{{4}}|{_D}{{3}} {_D}{{2}} {_D}{{4}})(?:$|[^{_D}-])", 1),
    "ipv4": (rf"(?:^|[^{_D}.])({_OCTET}(?:\.{_OCTET}){{3}})(?:$|[^{_D}.]|\.(?:$|[^{_D}]))", 1),
    "phone": (rf"(?:^|[^{_W}.])((?:\+{_D}{{1,3}}[ -]?(?:\({_D}{{1,4}}\)[ -]?)?{_D}{{2,4}}(?:[ -]{_D}{{2,6}}){{1,4}}|\({_D}{{1,4}}\)[ -]?{_D}{{2,4}}(?:[ -]{_D}{{2,6}}){{1,4}}|{_D}{{2,4}}(?:[ -]{_D}{{2,6}}){{2,4}}))(?:$|[^{_W}])", 1),
    "address": (rf"(?:^|[^{_D}])({_D}{{1,5}}[A-Za-z]?{_S}+(?:(?:[A-Z][A-Za-z'\-]+{_S}+){{0,3}}(?:{pii.STREETS})(?:$|[^{_W}])|(?:{pii.STREETS_FIRST}){_S}+[A-Z][A-Za-z'\-]+))", 1),
    "name": (rf"(?:^|[^{_W}])((?i:{pii.HONORIFICS})\.?[ ]+[A-Z][A-Za-z'\-]+(?:[ ]+[A-Z][A-Za-z'\-]+)?)", 1),
}
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN CAST({_DIGITS}[-i] AS INTEGER) > 4 THEN 2 * CAST({_DIGITS}[-i] AS INTEGER) - 9 ELSE 2 * CAST({_DIGITS}[-i] AS INTEGER) END ELSE CAST({_DIGITS}[-i] AS INTEGER) END)) % 10 = 0"
_CHECK = {
    "iban": "length(replace(x, ' ', '')) BETWEEN 15 AND 34", "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}", "name": f"lower(x) NOT IN ({_words(tuple(a.lower() for a in NAME_ALLOWLIST))})",
    "phone": f"length({_DIGITS}) >= {pii.MIN_PHONE_DIGITS} AND NOT regexp_matches(x, {_q(pii.DATE_LIKE)})",
}
_FLAGS = ", ".join(f"len(list_filter(regexp_extract_all(input_text, {_q(p)}, {g}), lambda x: {_CHECK.get(c, 'true')})) > 0 AS {c}" for c, (p, g) in _FIND.items())
_MAIL = _q(pii.EMAIL)
_MAILS = f"""{_R}, f AS (SELECT record_id, unnest([{{'ord': 1000, 'field': 'input_text', 'text': input_text}}, {{'ord': 1001, 'field': 'output_text', 'text': output_text}}, {{'ord': 1002, 'field': 'feedback', 'text': feedback}}, {{'ord': 1003, 'field': 'error', 'text': error}}], recursive := true) FROM r),
    m AS (SELECT record_id, ord, field, text, regexp_extract_all(text, {_MAIL}) AS v, string_split_regex(text, {_MAIL}) AS p FROM f WHERE text IS NOT NULL),
    e AS (SELECT record_id, ord, i, lower(v[i]) AS c FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM m)),
    k AS (SELECT c, '[EMAIL_' || row_number() OVER (ORDER BY min(row(record_id, ord, i))) || ']' AS token FROM e GROUP BY c)"""
_GRAMS = lambda w, k: f"CASE WHEN len({w}) <= {k} THEN [array_to_string({w}, ' ')] ELSE list_distinct(list_transform(range(1, len({w}) - {k - 2}), lambda i: array_to_string({w}[i:i+{k - 1}], ' '))) END"
_GOLDENS = f"""gd AS (SELECT DISTINCT ON (doc_id) doc_id, string_split({_NORM_OF('text')}, ' ') AS w FROM documents WHERE text IS NOT NULL AND source = 'golden_drafts'),
    gs AS (SELECT doc_id, {_GRAMS('w', 2)} AS g FROM gd WHERE w[1] <> ''), gx AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM gs),
    rd AS (SELECT record_id, string_split({_NORM_OF('input_text')}, ' ') AS w FROM r WHERE input_text IS NOT NULL), rs AS (SELECT record_id, {_GRAMS('w', 2)} AS g FROM rd WHERE w[1] <> ''), rx AS (SELECT record_id, len(g) AS n, unnest(g) AS s FROM rs),
    ov AS (SELECT record_id, doc_id, count(*) / (any_value(rx.n) + any_value(gx.n) - count(*)) AS j FROM rx JOIN gx USING (s) GROUP BY ALL),
    best AS (SELECT rs.record_id, coalesce(max(j), 0) AS b FROM rs LEFT JOIN ov USING (record_id) GROUP BY rs.record_id)"""
_ALL_FIRES = {**_FIRES, "format_violation": "output_text IS NOT NULL AND NOT coalesce(json_valid(output_text), false)", "novelty": "coalesce(b, 0) < 0.3"}
_FULL = f"""WITH {_R}, {_CONTEXT}, {_DISAGREE}, {_GOLDENS},
    f AS (SELECT r.window_id, r.record_id, {', '.join(f"coalesce({_ALL_FIRES[n]}, false) AS s_{n}" for n in SIGNAL_WEIGHTS)} FROM r JOIN c USING (window_id) LEFT JOIN v ON v.fingerprint = {_FP} LEFT JOIN best ON best.record_id = r.record_id)
    SELECT window_id, record_id, CAST({' + '.join(f"CASE WHEN s_{n} THEN {w} ELSE 0 END" for n, w in SIGNAL_WEIGHTS.items())} AS INTEGER) AS score,
        array_to_string(list_filter([{', '.join(f"CASE WHEN s_{n} THEN '{n}' END" for n in SIGNAL_WEIGHTS)}], lambda x: x IS NOT NULL), ',') AS fired FROM f"""
_HEALTH = f"""{_R}, {_GOLDENS}, cv AS (SELECT record_id, b, b >= 0.06 AS covered FROM best), g AS (SELECT record_id, min(cluster_id) AS component FROM candidates WHERE cluster_id IS NOT NULL GROUP BY record_id),
    s AS (SELECT DISTINCT ON (record_id) record_id, score, signals FROM scores WHERE score IS NOT NULL),
    h AS (SELECT g.component, g.record_id, coalesce(covered, false) AS covered, coalesce(b, 0) AS b, score, signals FROM g LEFT JOIN cv USING (record_id) LEFT JOIN s USING (record_id))"""
_NAMES = "[" + ", ".join(f"'{n}'" for n in SIGNAL_WEIGHTS) + "]"
_GREEDY = f"""{_RANKED.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_QUOTA}, o AS (SELECT *, row_number() OVER (ORDER BY score DESC, record_id) AS rn FROM k),
    gr(n, rn, record_id, used, filled) AS (SELECT 0, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
        UNION ALL SELECT gr.n + 1, min(o.rn), arg_min(o.record_id, o.rn), list_append(any_value(gr.used), arg_min(o.cluster_id, o.rn)), list_append(any_value(gr.filled), arg_min(o.stratum, o.rn))
        FROM gr JOIN o ON o.rn > gr.rn JOIN q ON q.stratum = o.stratum WHERE gr.n < {Select().max_candidates} AND NOT list_contains(gr.used, o.cluster_id) AND len(list_filter(gr.filled, lambda x: x = o.stratum)) < q.quota GROUP BY gr.n),
    tk AS (SELECT gr.n AS rank, o.* FROM gr JOIN o ON o.rn = gr.rn WHERE gr.n > 0),
    full_cluster AS (SELECT cluster_id, min(rn) AS at FROM tk GROUP BY cluster_id), full_stratum AS (SELECT stratum, max(rn) AS at FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY rn) AS nth FROM tk) JOIN q USING (stratum) WHERE nth = quota GROUP BY stratum),
    ch AS (SELECT o.record_id, o.stratum, CAST(tk.rank AS INTEGER) AS rank, CASE WHEN tk.rank IS NOT NULL THEN NULL WHEN o.rn > c.at THEN 'cluster_cap' WHEN q.quota IS NULL OR q.quota = 0 OR o.rn > f.at THEN 'quota:' || o.stratum ELSE 'max_candidates' END AS reason
        FROM o LEFT JOIN tk ON tk.rn = o.rn LEFT JOIN full_cluster c ON c.cluster_id = o.cluster_id LEFT JOIN full_stratum f ON f.stratum = o.stratum LEFT JOIN q ON q.stratum = o.stratum)"""
_NOTE = f"{PLACEHOLDER_MARK} Placeholder criteria, nothing read this record."
_SLUG = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '_')"
_NEAR = lambda docs="true": f"""d AS (SELECT DISTINCT ON (doc_id) * FROM documents WHERE text IS NOT NULL AND {docs}), dn AS (SELECT doc_id, {_NORM_OF('text')} AS t FROM d),
    rp AS (SELECT t, min(doc_id) AS rep FROM dn GROUP BY t), mb AS (SELECT dn.doc_id, CASE WHEN dn.t = '' THEN dn.doc_id ELSE rp.rep END AS rep FROM dn JOIN rp USING (t)),
    ns AS (SELECT rep, {_GRAMS("string_split(t, ' ')", 5)} AS g FROM rp WHERE t <> ''), nx AS (SELECT rep, len(g) AS n, unnest(g) AS s FROM ns),
    ln AS (SELECT x.rep AS a, y.rep AS b, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS jaccard FROM nx x JOIN nx y ON x.s = y.s AND x.rep < y.rep GROUP BY x.rep, y.rep HAVING count(*) / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.8),
    eb AS (SELECT a, b FROM ln UNION SELECT b, a FROM ln), re(a, b) AS (SELECT a, b FROM eb UNION SELECT re.a, eb.b FROM re JOIN eb ON eb.a = re.b),
    cp AS (SELECT a AS rep, least(a, min(b)) AS comp FROM re GROUP BY a), cl AS (SELECT mb.doc_id, mb.rep, coalesce(cp.comp, mb.rep) AS comp FROM mb LEFT JOIN cp ON cp.rep = mb.rep)"""  # noqa: E731
_HALF = "(SELECT quantile_disc(doc_id, 0.5) FROM d)"
_MIN = MINHASH
_LG = lambda n, k: f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"
_FISHER = f"(SELECT sum(exp({_LG('a + b', 'x.k')} + {_LG('c + e', '(a + c - x.k)')} - {_LG('a + b + c + e', '(a + c)')})) FROM (SELECT unnest(range(CAST(greatest(0, a + c - (c + e)) AS BIGINT), CAST(a AS BIGINT) + 1)) AS k) x)"

ORACLES = {
    "q_ticket_records": f"WITH {_TICKETS} SELECT line_no, {_SPLIT}, " + ", ".join(f"CASE WHEN fault IS NULL THEN {c} END AS {c}" for c in ("record_id", "ts_utc", "input_text", "output_text", "arm", "latency_ms", "feedback")) + " FROM b",
    "q_judged_records": f"WITH {_JUDGED} SELECT line_no, {_SPLIT}, CASE WHEN fault IS NULL THEN coalesce(told, '') END AS verdicts, CASE WHEN fault IS NULL THEN inst END AS ts_utc FROM jb",
    "q_ingest_accounts": f"WITH {_TICKETS}, n AS (SELECT count(*) AS l, count(fault) AS i, count(DISTINCT CASE WHEN fault IS NULL THEN {_FP} END) AS w FROM b) SELECT l AS lines, CAST(0 AS BIGINT) AS blank, CAST(0 AS BIGINT) AS unparsed, i AS invalid, CAST(0 AS BIGINT) AS truncated, w AS written, l AS rows, l - i - w AS duplicates FROM n",
    "q_ingest_faults": f"WITH {_TICKETS}, {_JUDGED} SELECT split_part(fault, ':', 1) AS error_type, count(*) AS lines FROM (SELECT fault FROM b UNION ALL SELECT fault FROM jb) WHERE fault IS NOT NULL GROUP BY 1",
    "q_jsonl_lines": f"""WITH l AS (SELECT source_path, regexp_replace(regexp_replace(regexp_replace(line, '^\\x{{FEFF}}', ''), '^{_WS}+', ''), '{_WS}+$', '') AS t FROM raw_lines WHERE source_format = 'jsonl'),
        s AS (SELECT source_path, t = '' AS blank, t <> '' AND coalesce(json_valid(t), false) AND NOT regexp_matches(regexp_replace(t, '"(?:[^"\\\\]|\\\\.)*"', '""', 'g'), ',\\s*[}}\\]]') AND coalesce(json_type(CASE WHEN json_valid(t) THEN t END), '') = 'OBJECT' AS fine FROM l)
        SELECT source_path, count(*) AS lines, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND NOT fine) AS unparsed, count(*) FILTER (WHERE fine) AS objects FROM s GROUP BY source_path""",
    "q_sidecar_records": f"WITH {_R}, b AS (SELECT record_id, input_text, CASE WHEN input_text IS NULL OR sha256(input_text)[1] = '0' THEN 'sidecar_miss:input_text' WHEN {_BLANK('input_text')} THEN 'invalid_record:input_text' END AS fault FROM r) SELECT record_id AS line_no, {_SPLIT}, CASE WHEN fault IS NULL THEN CAST(length(input_text) AS INTEGER) END AS n FROM b",
    "q_chat_records": f"WITH {_R} SELECT record_id AS line_no, CASE WHEN {_BLANK('input_text')} THEN 'missing_field' END AS error_type, strftime(make_timestamp(CAST(floor(epoch(received_at)) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS ts_utc, CASE WHEN NOT {_BLANK('input_text')} THEN CAST(length(input_text) AS INTEGER) END AS asked, 'first' || chr(10) || record_id AS output_text, CASE WHEN arm IS NULL THEN 'b' WHEN NOT {_BLANK('arm')} THEN arm END AS prompt_version, 'x' || chr(10) || 'y' AS arm, 'z' AS feedback FROM r WHERE input_text IS NOT NULL",
    "q_new_inputs": f"WITH {_R}, w AS (SELECT min(window_id) AS first FROM r), n AS (SELECT window_id, record_id, received_at, {_FP} AS fp FROM r), kn AS (SELECT DISTINCT fp FROM n, w WHERE window_id = first AND fp IS NOT NULL), x AS (SELECT n.* FROM n CROSS JOIN w WHERE window_id <> first AND (fp IS NULL OR fp NOT IN (SELECT fp FROM kn))) SELECT window_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY received_at, record_id) AS k FROM x) WHERE k = 1",
    "q_pii_flags": f"WITH {_R}, f AS (SELECT record_id, {_FLAGS} FROM r WHERE input_text IS NOT NULL) SELECT * FROM f WHERE {' OR '.join(_FIND)}",
    "q_email_redacted": f"""WITH {_MAILS}, z AS (SELECT m.record_id, m.ord, m.field, string_agg(m.p[x.i] || coalesce(k.token, ''), '' ORDER BY x.i) AS text FROM m, LATERAL (SELECT unnest(range(1, len(m.p) + 1)) AS i) x LEFT JOIN k ON k.c = lower(m.v[x.i]) GROUP BY ALL),
        o AS (SELECT record_id, {', '.join(f"max(text) FILTER (WHERE field = '{c}') AS {c}" for c in ('input_text', 'output_text', 'feedback', 'error'))} FROM z GROUP BY record_id)
        SELECT * FROM o WHERE contains(coalesce(input_text, ''), '[EMAIL_') OR contains(coalesce(output_text, ''), '[EMAIL_') OR contains(coalesce(feedback, ''), '[EMAIL_') OR contains(coalesce(error, ''), '[EMAIL_')""",
    "q_email_report": f"WITH {_MAILS} SELECT 'EMAIL' AS pii_class, count(*) AS found, count(DISTINCT c) AS distinct_values FROM e HAVING count(*) > 0",
    "q_leaked_emails": f"WITH {_MAILS} SELECT field, 'EMAIL' AS pii_class, count(*) AS texts FROM m WHERE len(v) > 0 GROUP BY field",
    "q_minhash": _MIN,
    "q_minhash_estimates": f"WITH s AS ({_MIN}) SELECT a.doc_id, (" + " + ".join(f"CAST(a.h{i} = b.h{i} AS INTEGER)" for i in range(4)) + ") / 4 AS estimate FROM s a JOIN s b ON b.doc_id = a.doc_id + 1",
    "q_band_pairs": f"WITH s AS ({_MIN}) SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.doc_id < y.doc_id AND x.h0 = y.h0 AND x.h1 = y.h1 UNION SELECT x.doc_id, y.doc_id FROM s x JOIN s y ON x.doc_id < y.doc_id AND x.h2 = y.h2 AND x.h3 = y.h3",
    "q_near_duplicate_pairs": f"WITH RECURSIVE {_NEAR()} SELECT a, b, round(jaccard, 6) AS jaccard FROM ln",
    "q_near_duplicates": f"WITH RECURSIVE {_NEAR()}, dg AS (SELECT x, count(*) AS links FROM (SELECT a AS x FROM ln UNION ALL SELECT b FROM ln) GROUP BY x) SELECT doc_id, comp AS class_id, coalesce(links, 0) AS links FROM cl LEFT JOIN dg ON dg.x = doc_id",
    "q_clusters": f"WITH RECURSIVE {_NEAR()}, hd AS (SELECT comp, min(doc_id) AS representative_id, count(*) AS size FROM cl GROUP BY comp), mj AS (SELECT comp, min(jaccard) AS w FROM ln JOIN cl ON cl.doc_id = ln.a GROUP BY comp) SELECT printf('c-%04d', row_number() OVER (ORDER BY size DESC, representative_id)) AS cluster_id, representative_id, size AS \"size\", round(w, 6) AS min_link_jaccard FROM hd LEFT JOIN mj USING (comp)",
    "q_golden_coverage": f"WITH RECURSIVE {_NEAR('coalesce(source, chr(0)) <> ' + _q('golden_drafts'))}, bo AS ({PLAIN['q_best_overlap']}), pc AS (SELECT comp, bool_or(coalesce(best_overlap >= 0.2, false)) AS covered FROM cl LEFT JOIN bo USING (doc_id) GROUP BY comp), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE covered) AS h FROM pc) SELECT n AS clusters, h AS covered_clusters, round(h / n, 6) AS share, round(greatest({_WILSON('h', 'n', '-')}, 0), 6) AS low, round(least({_WILSON('h', 'n', '+')}, 1), 6) AS high FROM t",
    "q_scored_with_goldens": _FULL,
    "q_cluster_coverage": f"WITH {_HEALTH}, pc AS (SELECT component, bool_or(covered) AS covered FROM h GROUP BY component), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE covered) AS h FROM pc) SELECT n AS clusters, h AS covered_clusters, round(h / n, 6) AS share, round(greatest({_WILSON('h', 'n', '-')}, 0), 6) AS low, round(least({_WILSON('h', 'n', '+')}, 1), 6) AS high FROM t",
    "q_coverage_gaps": f"WITH {_HEALTH}, nm AS (SELECT component, list_distinct(list(x)) AS names FROM (SELECT component, unnest(list_transform(signals, lambda y: y.name)) AS x FROM h) GROUP BY component), pc AS (SELECT component, count(*) AS n, max(b) AS b, max(coalesce(score, 0)) AS score, bool_or(covered) AS covered FROM h GROUP BY component) SELECT component, n AS \"size\", round(b, 6) AS best_overlap, score, array_to_string(list_filter({_NAMES}, lambda y: list_contains(coalesce(names, []), y)), ',') AS signals FROM pc LEFT JOIN nm USING (component) WHERE NOT covered ORDER BY n DESC, score DESC, component LIMIT 10",
    "q_signal_coverage": f"WITH {_HEALTH}, fr AS (SELECT record_id, unnest(list_transform(signals, lambda y: y.name)) AS signal FROM s), ag AS (SELECT signal, count(*) AS firing, count(*) FILTER (WHERE coalesce(covered, false)) AS covered FROM fr LEFT JOIN cv USING (record_id) GROUP BY signal), nm AS (SELECT unnest({_NAMES}) AS signal, unnest(range(0, {len(SIGNAL_WEIGHTS)})) AS place) SELECT nm.signal, CAST(place AS INTEGER) AS place, coalesce(firing, 0) AS firing, coalesce(covered, 0) AS covered FROM nm LEFT JOIN ag USING (signal)",
    "q_covered_by_signal": f"WITH {_HEALTH}, pc AS (SELECT component, bool_or(covered) AS covered, bool_or(coalesce(len(list_filter(signals, lambda y: y.name <> 'novelty')) > 0, false)) AS told FROM h GROUP BY component), t AS (SELECT count(*) FILTER (WHERE told AND covered) AS a, count(*) FILTER (WHERE told AND NOT covered) AS b, count(*) FILTER (WHERE NOT told AND covered) AS c, count(*) FILTER (WHERE NOT told AND NOT covered) AS e FROM pc) SELECT a AS signalled_covered, a + b AS signalled, c AS ordinary_covered, c + e AS ordinary, round({_FISHER}, 6) AS p FROM t",
    "q_fisher": f"WITH {_R}, t AS (SELECT count(*) FILTER (WHERE error IS NOT NULL AND ok) AS a, count(*) FILTER (WHERE error IS NOT NULL AND NOT ok) AS b, count(*) FILTER (WHERE error IS NULL AND ok) AS c, count(*) FILTER (WHERE error IS NULL AND NOT ok) AS e FROM (SELECT error, lower(trim(feedback)) IN ({_words(POSITIVE_WORDS)}) AS ok FROM r WHERE feedback IS NOT NULL)) SELECT a AS failed_positive, b AS failed_other, c AS fine_positive, e AS fine_other, round({_FISHER}, 6) AS p FROM t",
    "q_novel_documents": f"WITH {_SETS}, p AS (SELECT a.doc_id, b.doc_id AS other, count(*) AS c FROM x a JOIN x b USING (shingle) WHERE a.doc_id > {_HALF} AND b.doc_id <= {_HALF} GROUP BY ALL), j AS (SELECT p.doc_id, max(c / (za.n + zb.n - c)) AS best FROM p JOIN z za ON za.doc_id = p.doc_id JOIN z zb ON zb.doc_id = p.other GROUP BY p.doc_id) SELECT g.doc_id, round(coalesce(best, 0), 6) AS best_overlap, coalesce(best, 0) < 0.4 AS novel FROM g LEFT JOIN j USING (doc_id) WHERE g.doc_id > {_HALF}",
    "q_greedy_select": _GREEDY + " SELECT record_id, rank, reason FROM ch",
    "q_greedy_strata": _GREEDY + " SELECT q.stratum, CAST(quota AS INTEGER) AS quota, count(rank) AS selected, greatest(quota - count(rank), 0) AS unfilled FROM q LEFT JOIN ch ON ch.stratum = q.stratum AND rank IS NOT NULL GROUP BY q.stratum, quota",
    "q_drops": _GREEDY + " SELECT reason, count(*) AS records FROM ch WHERE reason IS NOT NULL GROUP BY reason",
    "q_shortlist_cases": _GREEDY + f""", rr AS (SELECT DISTINCT ON (record_id) record_id, input_text FROM records) SELECT CAST(tk.rank AS INTEGER) AS rank, '{PREFIX}_win_' || {_SLUG('tk.record_id')} AS id, '{PREFIX},' || tk.stratum AS tags, CAST(4 AS INTEGER) AS criteria,
        'Placeholder criteria of a dry run; no model read this record.' || chr(10) || 'Mined and NOT REVIEWED: window win, record ' || tk.record_id || ', stratum ' || tk.stratum || ', score ' || tk.score || '.' || chr(10) || 'Signals: ' || tk.stratum || '.' || chr(10) || 'Criteria drafted by dry run and not yet read by a human.' || chr(10) || {_q("Drafter's note: " + _NOTE)} AS notes, CAST(length(input_text) AS INTEGER) AS input_chars FROM tk JOIN rr USING (record_id)""",
    "q_label_rows": _GREEDY + f" SELECT tk.record_id, tk.stratum, CAST(tk.score AS INTEGER) AS score, tk.stratum AS signals, CAST(4 AS INTEGER) AS criteria, {_q(_NOTE)} AS notes, CAST(NULL AS VARCHAR) AS draft_error, 'dry run' AS model_id, true AS dry_run, CAST(64 AS INTEGER) AS digest FROM tk JOIN (SELECT DISTINCT record_id FROM records) USING (record_id)",
    "q_run_verdicts": _GREEDY + """, e AS (SELECT CASE WHEN bool_and(naive_is_utc) THEN 'all' WHEN bool_or(naive_is_utc) THEN 'mixed' ELSE 'none' END AS expectation FROM field_mappings), x AS (SELECT CASE WHEN count(rank) = 0 THEN 2 WHEN count(*) FILTER (WHERE reason = 'max_candidates') > 0 THEN 1 ELSE 0 END AS code FROM ch),
        rc AS (SELECT DISTINCT ON (record_id) * FROM records), n AS (SELECT count(latency_ms) AS l, count(input_text) AS i FROM rc),
        y AS (SELECT unnest([CASE WHEN l < 12 THEN 'latency_outlier' END, CASE WHEN i < 12 THEN 'length_outlier' END, 'version_disagreement', 'novelty', CASE WHEN expectation <> 'all' THEN 'format_violation' END]) AS name FROM n, e)
        SELECT CAST((SELECT code FROM x) AS BIGINT) AS exit_code, expectation, (SELECT string_agg(name, ',' ORDER BY name) FROM y WHERE name IS NOT NULL) AS not_evaluated, CAST(1 + (expectation = 'mixed')::INTEGER AS BIGINT) AS blocking FROM e""",
    "q_dry_run_cases": _GREEDY + f" SELECT CAST(tk.rank AS INTEGER) AS rank, '{PREFIX}_win_' || {_SLUG('tk.record_id')} AS id, CAST(4 AS INTEGER) AS criteria, '{PREFIX},' || tk.stratum AS tags FROM tk JOIN (SELECT DISTINCT record_id FROM records) USING (record_id)",
    "q_window_rates": f"WITH {_R} SELECT window_id, count(*) AS requests, count(error) AS failures, count(*) FILTER (WHERE lower(trim(feedback)) IN ({_words(POSITIVE_WORDS)})) AS liked, CAST(median(latency_ms) AS DOUBLE) AS median, count(latency_ms) AS timed FROM r GROUP BY window_id HAVING count(latency_ms) > 0",
}
