"""SQL twins of the general training-data problems, for DuckDB on the same tables."""

from __future__ import annotations

from gleanstone.operators.timestamps import ABBREVIATIONS, MONTHS, SHARED

_DAYNAME = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d*)?)?\s*(?:([ap])\.?m\b\.?)?\s*(.*)$"
#: Forms with the groups of year, month, day (numbers or a name) and those from hour to zone; the third has day or month first.
_FORMS = (
    (rf"(?i)^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:t|,?\s+){_CLOCK}", (1, 2, 3), (4, 5, 6, 7, 8)),
    (r"(?i)^(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(\d{2})?(?:[.,]\d*)?()\s*(.*)$", (1, 2, 3), (4, 5, 6, 7, 8)),
    (rf"(?i)^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})(?:t|,?\s+){_CLOCK}", (3, 2, 1), (4, 5, 6, 7, 8)),
    (rf"(?i)^{_DAYNAME}(\d{{1,2}})[ -]([a-z]{{3,9}})\.?,?[ -](\d{{4}}),?\s+{_CLOCK}", (3, 2, 1), (4, 5, 6, 7, 8)),
    (rf"(?i)^{_DAYNAME}([a-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_CLOCK}", (3, 1, 2), (4, 5, 6, 7, 8)),
)
_q = lambda text: "'" + text.replace("'", "''") + "'"
_PICK = lambda k: "CASE " + " ".join(f"WHEN regexp_matches(v, {_q(p)}) THEN regexp_extract(v, {_q(p)}, {(*d, *c)[k]})" for p, d, c in _FORMS) + " END"
_MONTH = f"coalesce(try_cast(b AS INTEGER), nullif(list_position([{', '.join(map(_q, MONTHS))}], lower(b[1:3])), 0))"
_SHORT = "CASE upper(z) " + " ".join(f"WHEN '{a}' THEN {o}" for a, o in ABBREVIATIONS.items()) + " END"
_HOME = "CASE " + " ".join(f"WHEN upper(z) = '{a}' AND lower(naive_zone) = '{zone}' THEN {o}" for a, zones in SHARED.items() for zone, o in zones.items()) + " END"
_STATED = r"^([+\x{2212}-])(\d{2}):?(\d{2})(?::?(\d{2}))?(?:\s*\[[\w/+-]+\])?$"
_S = lambda k: f"coalesce(try_cast(nullif(regexp_extract(z, '{_STATED}', {k}), '') AS INTEGER), 0)"
_SIZE = f"({_S(2)} * 3600 + {_S(3)} * 60 + {_S(4)})"
_BRACKET = r"^\[?([A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+)\]?$"
#: Seconds east of UTC of a zone at an instant.
_AT = lambda u: f"(CAST(epoch(timezone(zone, to_timestamp({u}))) AS BIGINT) - ({u}))"

P3 = f"""WITH a AS (
        SELECT 'records' AS table_name, record_id AS row_key, mapping_name, ts_utc AS value FROM records
        UNION SELECT 'support_tickets', ticket_id, mapping_name, opened_at FROM support_tickets UNION SELECT 'judged_summaries', request_id, mapping_name, ts_utc FROM judged_summaries),
    p AS (SELECT a.table_name, a.row_key, regexp_replace(value, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS v, naive_is_utc, naive_zone, date_order FROM a LEFT JOIN (SELECT DISTINCT ON (mapping_name) * FROM field_mappings) m USING (mapping_name)
        WHERE value IS NOT NULL AND NOT regexp_full_match(value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z')),
    f AS (SELECT *, regexp_full_match(v, '\\d+(\\.\\d*)?') AS number, ltrim(regexp_extract(v, '^\\d+'), '0') AS digits, regexp_matches(v, {_q(_FORMS[2][0])}) AS loose, {', '.join(f'{_PICK(k)} AS {n}' for k, n in enumerate(('y', 'b', 'd', 'h', 'mi', 's', 'half', 'zone_part')))} FROM p),
    n AS (SELECT *, regexp_replace(zone_part, '\\s*\\(\\w+\\)$', '') AS z, {_MONTH} AS m, try_cast(d AS INTEGER) AS dd, try_cast(h AS INTEGER) AS hh FROM f),
    o AS (SELECT *, CASE WHEN NOT loose THEN false WHEN coalesce(date_order IN ('dmy', 'mdy'), false) THEN date_order = 'mdy' WHEN m <= 12 AND dd <= 31 AND dd <= 12 AND m <= 31 AND m <> dd THEN NULL ELSE (dd <= 12 AND m <= 31) AND NOT (m <= 12 AND dd <= 31) END AS swap,
        CASE WHEN coalesce(half, '') = '' THEN hh WHEN hh NOT BETWEEN 1 AND 12 THEN NULL WHEN lower(half) = 'a' THEN hh % 12 ELSE hh % 12 + 12 END AS hour FROM n),
    l AS (SELECT *, CASE WHEN number THEN CASE WHEN digits = '' THEN 0 WHEN length(digits) <= 11 THEN try_cast(digits AS BIGINT) ELSE try_cast(digits[1:length(digits) - CASE WHEN length(digits) <= 14 THEN 3 WHEN length(digits) <= 17 THEN 6 ELSE 9 END] AS BIGINT) END
        WHEN try_cast(y AS INTEGER) BETWEEN 1 AND 9999 AND swap IS NOT NULL AND hour <= 23 THEN CAST(epoch(try_strptime(y || '-' || CASE WHEN swap THEN dd ELSE m END || '-' || CASE WHEN swap THEN m ELSE dd END || ' ' || hour || ':' || mi || ':' || coalesce(nullif(s, ''), '0'), '%Y-%m-%d %H:%M:%S')) AS BIGINT) END AS local,
        CASE WHEN number THEN 0 WHEN z = '' AND coalesce(naive_is_utc, false) THEN 0 WHEN regexp_matches(z, '{_STATED}') THEN CASE WHEN {_S(3)} < 60 AND {_S(4)} < 60 AND {_SIZE} <= 64800 THEN CASE WHEN z[1] = '+' THEN {_SIZE} ELSE -{_SIZE} END END ELSE coalesce({_SHORT}, {_HOME}) END AS stated,
        CASE WHEN number THEN NULL WHEN z = '' AND NOT coalesce(naive_is_utc, false) THEN lower(naive_zone) ELSE nullif(lower(regexp_extract(z, {_q(_BRACKET)}, 1)), '') END AS wanted FROM o),
    k AS (SELECT l.*, tz.name AS zone FROM l LEFT JOIN (SELECT DISTINCT name, lower(name) AS low FROM pg_timezone_names()) tz ON tz.low = l.wanted),
    c AS (SELECT *, CASE WHEN wanted IS NULL THEN [local - stated] WHEN zone IS NOT NULL AND local IS NOT NULL THEN list_filter(list_distinct([local - {_AT('local - 86400')}, local - {_AT('local + 86400')}]), lambda u: CAST(epoch(timezone(zone, to_timestamp(u))) AS BIGINT) = local) END AS instants FROM k)
    SELECT DISTINCT table_name, row_key, strftime(make_timestamp(instants[1] * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS instant_utc FROM c WHERE len(instants) = 1 AND instants[1] BETWEEN -62135596800 AND 253402300799"""

ORACLES = {"p3_found": P3}
