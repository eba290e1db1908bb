"""DuckDB SQL for the queries, written on its own from the definitions (frames and self joins, no sweeps)."""

from __future__ import annotations

from ..functions.literals import clauses
from ..functions.patterns import ABUSE_CATEGORIES, KEYWORDS, SCANNING
from ..sources.derived import ACCESS_LOG, REPUTATION_ALL, REPUTATION_RAW
from ..params import DEFAULT
from .queries import FULL, LARGE, LOW

LINE = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d+) (\S+)( "([^"]*)" "([^"]*)")?'
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"{_OCTET}(\.{_OCTET}){{3}}"


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def path_of(url: str) -> str:
    return f"regexp_replace(regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"


BASE = f"""WITH access_log AS ({ACCESS_LOG}),
m AS (SELECT file_path, line_number, content AS raw_line, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS t FROM access_log),
x AS (SELECT *, regexp_extract(t, {q(LINE)}, ['ip','ln','ru','stamp','req','code','size','tail','ref','agent']) AS g, regexp_matches(t, {q(LINE)}) AS ok FROM m),
y AS (SELECT *, g.ip AS ip, try_strptime(split_part(g.stamp, ' ', 1), '%d/%b/%Y:%H:%M:%S') AS ts, try_cast(g.code AS BIGINT) AS status, CASE WHEN g.size <> '-' THEN try_cast(g.size AS BIGINT) END AS bytes_sent FROM x),
parsed AS (SELECT *, CASE WHEN t = '' THEN 'Empty log line' WHEN NOT ok THEN 'Line does not match a known log format'
    WHEN NOT (regexp_matches(ip, '^{V4}$') OR contains(ip, ':')) THEN 'Invalid IP address: ' || ip
    WHEN ts IS NULL THEN 'Invalid timestamp ''' || g.stamp || '''' WHEN status IS NULL OR status NOT BETWEEN 100 AND 599 THEN 'Invalid HTTP status code: ' || g.code
    WHEN g.size <> '-' AND bytes_sent IS NULL THEN 'Invalid bytes sent format: ' || g.size END AS error FROM y),
e AS (SELECT line_number, ip, CAST(ts AS TIMESTAMP) AS ts, CAST(epoch(ts) AS BIGINT) AS sec, g.req AS request_line, status, bytes_sent,
    CASE WHEN g.tail <> '' THEN nullif(g.agent, '-') END AS user_agent, CASE WHEN g.tail <> '' THEN nullif(g.ref, '-') END AS referer, nullif(g.ru, '-') AS remote_user,
    {path_of("regexp_split_to_array(trim(g.req), '\\s+')[2]")} AS path, row_number() OVER (PARTITION BY ip ORDER BY ts, line_number) AS pos,
    CASE WHEN status IN (401, 403) THEN 1 ELSE 0 END AS failed FROM parsed WHERE error IS NULL),
u AS (SELECT * FROM (SELECT line_number, 'request_line' AS field, request_line AS text FROM e UNION ALL SELECT line_number, 'user_agent', user_agent FROM e UNION ALL SELECT line_number, 'referer', referer FROM e) WHERE text <> ''),
d AS (SELECT *, CASE WHEN contains(text, '%') THEN url_decode(regexp_replace(replace(text, '+', '%2B'), '%([0-9A-Fa-f]{{2}})|%', CASE WHEN true THEN '%\\1' END, 'g')) ELSE text END AS decoded FROM u)"""
# RE2 has no lookahead: bad percent signs are protected by hand
BASE = BASE.replace("url_decode(regexp_replace(replace(text, '+', '%2B'), '%([0-9A-Fa-f]{2})|%', CASE WHEN true THEN '%\\1' END, 'g'))", "url_decode(replace(regexp_replace(replace(replace(text, '+', '%2B'), '%', chr(1)), chr(1) || '([0-9A-Fa-f]{2})', '%\\1', 'g'), chr(1), '%25'))")
REP = f"""rr AS (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(query_sec) AS query_ts FROM ({REPUTATION_RAW})),
cat AS (SELECT * FROM (VALUES {", ".join(f"({k}, {q(v)})" for k, v in ABUSE_CATEGORIES.items())}) AS t(code, name)),
ab AS (SELECT ip, provider, query_ts, CAST(body->>'$.data.abuseConfidencePercentage' AS BIGINT) AS confidence_score, body->>'$.data.countryCode' AS country_code, body->>'$.data.domain' AS organization, CAST(body->>'$.data.totalReports' AS BIGINT) AS abuse_reports, CAST(body->>'$.data.reports[0].categories[0]' AS INT) AS c1 FROM rr WHERE provider = 'abuseipdb'),
abuse2 AS (SELECT ip, provider, query_ts, confidence_score >= 50 AS is_malicious, confidence_score, country_code, organization, abuse_reports, CAST(NULL AS BIGINT) AS reputation_score,
    CASE WHEN c1 = 18 THEN 'Brute-Force' WHEN c1 < 18 THEN coalesce(n.name, 'Category ' || c1) || '|Brute-Force' ELSE 'Brute-Force|' || coalesce(n.name, 'Category ' || c1) END AS threat_types FROM ab LEFT JOIN cat n ON n.code = ab.c1),
vs AS (SELECT ip, provider, query_ts, body->>'$.data.attributes.country' AS country_code, body->>'$.data.attributes.as_owner' AS organization, CAST(body->>'$.data.attributes.reputation' AS BIGINT) AS reputation_score,
    CAST(body->>'$.data.attributes.last_analysis_stats.malicious' AS BIGINT) AS mal, CAST(body->>'$.data.attributes.last_analysis_stats.suspicious' AS BIGINT) AS sus, CAST(body->>'$.data.attributes.last_analysis_stats.harmless' AS BIGINT) + CAST(body->>'$.data.attributes.last_analysis_stats.undetected' AS BIGINT) AS rest FROM rr WHERE provider = 'virustotal'),
virus AS (SELECT ip, provider, query_ts, mal > 0 OR s >= 25 AS is_malicious, s AS confidence_score, country_code, organization, mal AS abuse_reports, reputation_score, '' AS threat_types FROM (SELECT *, CASE WHEN mal + sus + rest > 0 THEN CAST(trunc(CAST(mal + sus AS DOUBLE) / (mal + sus + rest) * 100) AS BIGINT) ELSE 0 END AS s FROM vs)),
latest AS (SELECT * FROM (SELECT * FROM abuse2 UNION ALL SELECT * FROM virus) QUALIFY row_number() OVER (PARTITION BY ip, provider ORDER BY query_ts DESC) = 1),
geo AS (SELECT e.*, a.country_code AS country FROM e ASOF JOIN (SELECT ip, query_ts, country_code FROM abuse2) a ON e.ip = a.ip AND e.ts >= a.query_ts)"""


def sql(body: str, rep: bool = False, more: str = "") -> str:
    return BASE + (",\n" + REP if rep else "") + (",\n" + more if more else "") + "\n" + body


def keyword(group: str) -> str:
    case = lambda out: "CASE " + " ".join(f"WHEN regexp_matches(decoded, {q('(?i)' + p)}) THEN {out(p, s)}" for p, s in KEYWORDS[group]) + " END"
    return f"SELECT line_number, field, {q(group)} AS pattern_type, {case(lambda p, s: s)} AS risk_score, {case(lambda p, s: f'regexp_extract(decoded, {q(chr(40) + chr(63) + chr(105) + chr(41) + p)}, 0)')} AS matched_text FROM d WHERE {case(lambda p, s: s)} IS NOT NULL"


def selectivity() -> str:
    """Of each pattern the texts that hold one literal of every clause, and those that it matches."""
    parts = []
    for kind, pattern, text in [(g, p, "decoded") for g in KEYWORDS for p, _ in KEYWORDS[g]] + [("scanning", p, "text") for p, _ in SCANNING]:
        holds = " AND ".join("(" + " OR ".join(f"contains(lower({text}), {q(x)})" for x in c) + ")" for c in clauses(pattern)) or "true"
        literals = q(" & ".join("|".join(c) for c in clauses(pattern)))
        parts.append(f"SELECT {q(kind)} AS kind, {q(pattern)} AS pattern, {literals} AS literals, count(*) AS texts, count(*) FILTER (WHERE {holds}) AS picked, count(*) FILTER (WHERE regexp_matches({text}, {q('(?i)' + pattern)})) AS matched FROM d")
    return " UNION ALL ".join(parts)


ALL_WORDS = " UNION ALL ".join(f"SELECT * FROM ({keyword(g)})" for g in KEYWORDS)
TITLE = "CASE pattern_type WHEN 'sql_injection' THEN 'Keyword Match - Sql Injection' WHEN 'xss' THEN 'Keyword Match - Xss' ELSE 'Keyword Match - Command Execution' END"
LAST_IN = "arg_max(line_number, line_number)"
LAST_TIME = "arg_max(line_number, pos)"


def windows(p, pick: int) -> str:
    return "(VALUES " + ", ".join(f"('{k}', {v[0]}, {v[pick]})" for k, v in p.windows.items()) + ") AS w(\"window\", size, least)"


def sliding(sizes: dict) -> str:
    """Most rows and failed rows of each address and window."""
    parts = [f"SELECT ip, '{k}' AS \"window\", max(c) AS max_requests, max(f) AS max_failed FROM (SELECT ip, count(*) OVER w AS c, sum(failed) OVER w AS f FROM e WINDOW w AS (PARTITION BY ip ORDER BY sec RANGE BETWEEN CURRENT ROW AND {v} FOLLOWING)) GROUP BY ip" for k, v in sizes.items()]
    return " UNION ALL ".join(parts)


def scan(sizes: int, least: int) -> str:
    return f"""SELECT a.ip, a.sec, a.pos, count(DISTINCT b.path) AS unique_paths, count(b.path) AS total_requests FROM e a JOIN e b ON a.ip = b.ip AND b.pos >= a.pos AND b.sec <= a.sec + {sizes}
    WHERE a.ip IN (SELECT ip FROM e GROUP BY ip HAVING count(*) >= 10) GROUP BY ALL HAVING count(DISTINCT b.path) >= {least}"""


MATCH = " UNION ALL ".join(f"SELECT ip, line_number, pos, {q(p)} AS pattern, {s} AS score FROM e WHERE regexp_matches(coalesce(user_agent, ''), {q('(?i)' + p)}) OR regexp_matches(request_line, {q('(?i)' + p)}) OR regexp_matches(coalesce(referer, ''), {q('(?i)' + p)})" for p, s in SCANNING if not p.endswith("$")) + " UNION ALL " + " UNION ALL ".join(f"SELECT ip, line_number, pos, {q(p)} AS pattern, {s} AS score FROM e WHERE regexp_matches(user_agent, {q('(?i)' + p)}) OR regexp_matches(request_line, {q('(?i)' + p)}) OR regexp_matches(referer, {q('(?i)' + p)})" for p, s in SCANNING if p.endswith("$"))
SIZES = lambda p: f"SELECT ip, count(*) AS total, count(*) FILTER (strlen(request_line) < {p.tiny_bytes}) AS tiny, count(*) FILTER (strlen(request_line) > {p.huge_bytes}) AS huge, avg(strlen(request_line)) AS avg_size, max(strlen(request_line)) AS max_size, {LAST_TIME} AS ref_line FROM e GROUP BY ip HAVING count(*) >= 10"
MULT = "(VALUES ('CN',1.3),('RU',1.4),('KP',1.5),('IR',1.4),('PK',1.2),('BD',1.2),('VN',1.2),('IN',1.1)) AS k(country, mult)"
FAILED_LOGIN = f"SELECT ip, count(*) AS failed_logins, CAST(least(70 + (count(*) - 5) * 5, 100) AS BIGINT) AS risk_score, {LAST_IN} AS ref_line FROM e WHERE failed = 1 GROUP BY ip HAVING count(*) >= 5"
HIGH = f"SELECT ip, count(*) AS requests, CAST(least(50 + count(*) - 50, 85) AS BIGINT) AS risk_score, {LAST_IN} AS ref_line FROM e GROUP BY ip HAVING count(*) >= 50"


def dos_windows(p) -> str:
    return " UNION ALL ".join(f"SELECT ip, sec, pos, '{k}' AS \"window\", {v} AS size, c - (pos - lo) AS c FROM (SELECT ip, sec, pos, count(*) OVER (PARTITION BY ip ORDER BY sec RANGE BETWEEN CURRENT ROW AND {v} FOLLOWING) AS c, min(pos) OVER (PARTITION BY ip, sec) AS lo FROM e)" for k, v in p.dos_windows.items())


def dos_periods(p) -> str:
    return f"SELECT ip, \"window\", sec, pos, c AS requests, size AS duration FROM ({dos_windows(p)}) WHERE c >= {p.dos_burst_threshold}"


def dos_pattern(p) -> str:
    least = p.dos_burst_threshold
    return f"""SELECT ip, "window", m AS max_burst, CAST(burst_periods AS BIGINT) AS burst_periods, CAST(least(80 + CAST(floor((m - {least}) / 10) AS BIGINT), 100) AS BIGINT) AS risk_score, ref_line
    FROM (SELECT *, sum(starts) OVER (PARTITION BY ip) AS burst_periods FROM (SELECT ip, "window", size, max(c) AS m, count(*) FILTER (c >= {least}) AS starts FROM ({dos_windows(p)}) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY ip ORDER BY m DESC, size) = 1)
    JOIN (SELECT ip, {LAST_TIME} AS ref_line FROM e GROUP BY ip) USING (ip) WHERE m >= {least}"""


def body(p, name: str) -> str:
    """The findings of a detector under parameters p."""
    return {
        "time_windowed_brute_force": f"SELECT s.ip, \"window\", CAST(max_failed AS BIGINT) AS max_failed, CAST(least(85 + 2 * max_failed, 100) AS BIGINT) AS risk_score, ref_line FROM ({sliding({k: v[0] for k, v in p.windows.items()})}) s JOIN {windows(p, 1)} USING (\"window\") JOIN (SELECT ip, max(line_number) AS ref_line FROM e WHERE failed = 1 GROUP BY ip) r ON r.ip = s.ip WHERE max_failed >= least",
        "request_burst_pattern": f"SELECT s.ip, \"window\", max_requests, CAST(least(75 + (max_requests - least) // 10, 95) AS BIGINT) AS risk_score, ref_line FROM ({sliding({k: v[0] for k, v in p.windows.items()})}) s JOIN {windows(p, 2)} USING (\"window\") JOIN (SELECT ip, max(line_number) AS ref_line FROM e GROUP BY ip) r ON r.ip = s.ip WHERE max_requests >= least",
        "path_enumeration": f"SELECT ip, max_paths, periods, total_paths, CAST(least(60 + 2 * max_paths, 90) AS BIGINT) AS risk_score, ref_line FROM (SELECT ip, max(unique_paths) AS max_paths, count(*) AS periods FROM ({scan(300, 10)}) GROUP BY ip) JOIN (SELECT ip, count(DISTINCT path) AS total_paths, {LAST_TIME} AS ref_line FROM e GROUP BY ip) USING (ip)",
        "scanning_tool_signature": f"SELECT ip, array_to_string(list_sort(list(DISTINCT pattern)), '|') AS patterns, array_to_string(list_sort(list(DISTINCT pattern || '=' || score)), '|') AS pattern_scores, count(*) AS matches, CAST(max(score) AS BIGINT) AS max_score, CAST(least(max(score) + 10, 95) AS BIGINT) AS risk_score, arg_max(line_number, pos) AS ref_line FROM ({MATCH}) GROUP BY ip",
        "vulnerability_scanning": f"SELECT ip, total, round(nf / total, 6) AS not_found_ratio, round(fb / total, 6) AS forbidden_ratio, sample_paths, CAST(least(65 + CAST(trunc(nf / total * 20) AS BIGINT), 85) AS BIGINT) AS risk_score, ref_line FROM (SELECT ip, count(*) AS total, count(*) FILTER (status = 404) AS nf, count(*) FILTER (status = 403) AS fb, {LAST_TIME} AS ref_line FROM e GROUP BY ip) LEFT JOIN (SELECT ip, string_agg(path, '|' ORDER BY pos) AS sample_paths FROM (SELECT * FROM e WHERE status = 404 AND path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ip ORDER BY pos) <= 10) GROUP BY ip) USING (ip) WHERE total >= 20 AND nf / total >= {p.vuln_ratio}",
        "user_agent_rotation": f"SELECT ip, agents, round(agents / greatest(span / 60.0, 1.0), 6) AS per_minute, sample_agents, CAST(least(65 + 3 * agents, 90) AS BIGINT) AS risk_score, ref_line FROM (SELECT ip, count(DISTINCT user_agent) AS agents, max(sec) - min(sec) AS span, {LAST_TIME} AS ref_line, array_to_string(list_sort(list(DISTINCT user_agent))[1:10], '|') AS sample_agents FROM e WHERE user_agent <> '' GROUP BY ip) WHERE agents >= 5",
        "automated_request_pattern": f"SELECT ip, tiny, round(tiny / total, 6) AS tiny_ratio, round(avg_size, 6) AS avg_size, CAST(least(60 + CAST(trunc(tiny / total * 30) AS BIGINT), 85) AS BIGINT) AS risk_score, ref_line FROM ({SIZES(p)}) WHERE tiny / total > {p.tiny_ratio} AND tiny > {p.tiny_count}",
        "large_request_pattern": f"SELECT ip, huge, round(huge / total, 6) AS huge_ratio, CAST(max_size AS BIGINT) AS max_size, CAST(least(70 + CAST(trunc(huge / total * 40) AS BIGINT), 95) AS BIGINT) AS risk_score, ref_line FROM ({SIZES(p)}) WHERE NOT (tiny / total > {p.tiny_ratio} AND tiny > {p.tiny_count}) AND huge / total > {p.huge_ratio} AND huge > {p.huge_count}",
        "automated_session_pattern": f"SELECT ip, gaps, round(avg_gap, 6) AS avg_gap, first_gaps, CAST(least(70 + gaps, 90) AS BIGINT) AS risk_score, ref_line FROM (SELECT ip, count(*) AS n, count(gap) AS gaps, count(DISTINCT CASE WHEN gap < {p.session_max_gap} THEN gap END) AS kinds, avg(gap) AS avg_gap, string_agg(CASE WHEN pos BETWEEN 2 AND 11 THEN CAST(gap AS VARCHAR) END, '|' ORDER BY pos) AS first_gaps, arg_max(line_number, pos) AS ref_line FROM (SELECT *, sec - lag(sec) OVER (PARTITION BY ip ORDER BY pos) AS gap FROM e) GROUP BY ip) WHERE n >= 5 AND kinds = 1 AND gaps >= {p.session_min_gaps}",
        "rapid_geographic_changes": f"SELECT ip, max(c) AS max_countries, count(*) AS periods, CAST(least(85 + 5 * max(c), 100) AS BIGINT) AS risk_score, any_value(ref_line) AS ref_line FROM (SELECT a.ip, a.pos, count(DISTINCT b.country) AS c FROM geo a JOIN geo b ON a.ip = b.ip AND b.pos >= a.pos AND b.sec <= a.sec + 3600 GROUP BY ALL) JOIN (SELECT ip, {LAST_TIME} AS ref_line FROM geo GROUP BY ip) USING (ip) WHERE c >= 3 GROUP BY ip",
        "high_risk_country_activity": f"SELECT ip, country, total, failed, round(rate, 6) AS rate, CAST(least(trunc(CASE WHEN rate > {p.country_requests_per_hour} / mult THEN 70 ELSE 65 END * mult), 95) AS BIGINT) AS risk_score, ref_line FROM (SELECT ip, country, CAST(any_value(mult) AS DOUBLE) AS mult, count(*) AS total, CAST(sum(failed) AS BIGINT) AS failed, count(*) / greatest((max(sec) - min(sec)) / 3600.0, 1.0) AS rate, sum(failed) / greatest((max(sec) - min(sec)) / 3600.0, 1.0) AS failed_rate, {LAST_TIME} AS ref_line FROM geo JOIN {MULT} USING (country) GROUP BY ip, country) WHERE rate > {p.country_requests_per_hour} / mult OR failed_rate > {p.country_failed_per_hour} / mult",
        "impossible_travel": f"SELECT ip, count(*) AS changes, array_to_string(list_sort(list_distinct(flatten(list([was, country])))), '|') AS countries, CAST(least(90 + 2 * count(*), 100) AS BIGINT) AS risk_score, arg_max(line_number, pos) AS ref_line FROM (SELECT *, sec - lag(sec) OVER (PARTITION BY ip ORDER BY pos) AS elapsed FROM (SELECT *, lag(country) OVER (PARTITION BY ip ORDER BY pos) AS was FROM geo) WHERE was IS NULL OR was <> country) WHERE was IS NOT NULL AND elapsed < 1800 GROUP BY ip",
    }[name]


def findings(p=DEFAULT) -> str:
    """The findings of all detectors in the common columns; tie tells apart what all other columns leave equal."""
    w = '"window"'
    each = [
        ("frequency", FAILED_LOGIN, "'Failed Login Pattern'", "failed_login_frequency", "'Detected ' || failed_logins || ' failed login attempts from IP ' || ip"),
        ("frequency", HIGH, "'High Request Frequency'", "high_frequency_requests", "'Detected ' || requests || ' requests from IP ' || ip"),
        ("frequency", body(p, "time_windowed_brute_force"), f"'Time-Windowed Brute Force (' || {w} || ')'", "time_windowed_brute_force", f"'Detected ' || max_failed || ' failed logins within ' || {w} || ' from IP ' || ip"),
        ("frequency", body(p, "request_burst_pattern"), f"'Request Burst Pattern (' || {w} || ')'", "time_windowed_burst", f"'Detected ' || max_requests || ' requests within ' || {w} || ' from IP ' || ip"),
        ("scanning", body(p, "path_enumeration"), "'Path Enumeration Scan'", "path_enumeration", "'Detected scanning of ' || max_paths || ' unique paths from IP ' || ip"),
        ("scanning", body(p, "scanning_tool_signature"), "'Scanning Tool Signature'", "scanning_tool_signature", "'Detected scanning tool signatures from IP ' || ip || ': ' || array_to_string(string_split(patterns, '|')[1:3], ', ')"),
        ("scanning", body(p, "vulnerability_scanning"), "'Vulnerability Scanning Pattern'", "vulnerability_scanning", "'Detected vulnerability scanning from IP ' || ip || printf(' (%.1f%% 404 responses)', not_found_ratio * 100)"),
        ("behavioral", dos_pattern(p), f"'DoS Burst Pattern (' || {w} || ')'", "dos_burst_pattern", f"'Detected ' || max_burst || ' requests in ' || {w} || ' from IP ' || ip"),
        ("behavioral", body(p, "user_agent_rotation"), "'User Agent Rotation'", "user_agent_rotation", "'Detected ' || agents || ' different user agents from IP ' || ip"),
        ("behavioral", body(p, "automated_request_pattern"), "'Automated Request Pattern'", "automated_request_pattern", "printf('Detected %.1f%% tiny requests from IP ', tiny_ratio * 100) || ip || ' (possible automation)'"),
        ("behavioral", body(p, "large_request_pattern"), "'Large Request Pattern'", "large_request_pattern", "printf('Detected %.1f%% large requests from IP ', huge_ratio * 100) || ip || ' (possible data exfiltration)'"),
        ("behavioral", body(p, "automated_session_pattern"), "'Automated Session Pattern'", "automated_session_pattern", "'Detected machine-like timing pattern from IP ' || ip || printf(' (avg %.1fs intervals)', avg_gap)"),
        ("geographic", body(p, "rapid_geographic_changes"), "'Rapid Geographic Changes'", "rapid_geographic_changes", "'Detected ' || max_countries || ' countries within 60 minutes from IP ' || ip"),
        ("geographic", body(p, "high_risk_country_activity"), "'High-Risk Country Activity (' || country || ')'", "high_risk_country_activity", "'Elevated activity from high-risk country ' || country || ': ' || total || ' requests, ' || failed || ' failed logins'"),
        ("geographic", body(p, "impossible_travel"), "'Impossible Travel Pattern'", "impossible_travel", "'Detected ' || changes || ' rapid country changes from IP ' || ip || ' (impossible travel)'"),
    ]
    windowed = {"time_windowed_brute_force", "time_windowed_burst", "dos_burst_pattern"}
    rows = [f"SELECT '{d}' AS detector, {title} AS finding_type, '{kind}' AS pattern_type, ip, {'country' if kind == 'high_risk_country_activity' else 'NULL'} AS country, {w if kind in windowed else 'NULL'} AS {w}, CAST(risk_score AS BIGINT) AS risk_score, {text} AS description, ref_line, '' AS tie FROM ({q_})" for d, q_, title, kind, text in each]
    text = "'Detected ' || replace(pattern_type, '_', ' ') || ' pattern in ' || field || ': ' || chr(39) || matched_text || chr(39)"
    rows.append(f"SELECT 'keyword', {TITLE}, pattern_type, e.ip, NULL, NULL, risk_score, {text}, k.line_number, field FROM ({ALL_WORDS}) k JOIN e ON e.line_number = k.line_number")
    return " UNION ALL ".join(rows)


#: Findings with the answers about their address, the composite score and its level. Numbers such as 4e-1 are doubles.
SCORED = """fi AS (SELECT f.*, e.ts AS ref_ts, e.request_line, e.user_agent, e.referer FROM (FINDINGS) f JOIN e ON e.line_number = f.ref_line),
lp AS (SELECT ip, bool_or(is_malicious) AS bad, max(CASE WHEN is_malicious THEN confidence_score / 1e2 * 4e-1 END) AS worst, coalesce(max(CASE WHEN provider = 'abuseipdb' THEN country_code END), max(CASE WHEN provider = 'virustotal' THEN country_code END)) AS cc, max(CASE WHEN provider = 'virustotal' THEN organization END) AS isp, string_agg('  ' || provider || ': ' || CASE WHEN is_malicious THEN 'malicious' ELSE 'clean' END || ' (' || confidence_score || '%)', chr(10) ORDER BY provider) AS answers FROM latest GROUP BY ip),
s0 AS (SELECT fi.*, lp.bad, lp.isp, lp.answers, coalesce(worst, 0e0) AS rep, CASE WHEN regexp_matches(pattern_type, 'brute_force|dos_burst|scanning|behavioral_anomaly') THEN 3e-1 WHEN regexp_matches(pattern_type, 'frequency|time_windowed|geographic') THEN 2e-1 ELSE 1e-1 END AS freq, CASE cc WHEN 'CN' THEN 1e-1 WHEN 'RU' THEN 15e-2 WHEN 'KP' THEN 2e-1 WHEN 'IR' THEN 15e-2 ELSE 0e0 END AS geo_w FROM fi LEFT JOIN lp USING (ip)),
s1 AS (SELECT *, CAST(least(trunc(risk_score + rep * 4e-1 * 100 + freq * 3e-1 * 100 + geo_w * 2e-1 * 100), 100) AS BIGINT) AS composite FROM s0),
sc AS (SELECT *, CASE WHEN composite >= 90 THEN 'Critical' WHEN composite >= 70 THEN 'High' WHEN composite >= 40 THEN 'Medium' ELSE 'Low' END AS level, row_number() OVER (ORDER BY composite DESC, risk_score DESC, detector, pattern_type, ip, ref_line, "window" NULLS FIRST, finding_type, tie) AS place FROM s1),
title AS (SELECT pattern_type, string_agg(upper(w[1]) || w[2:], ' ' ORDER BY k) AS shown FROM (SELECT pattern_type, unnest(string_split(pattern_type, '_')) AS w, unnest(range(len(string_split(pattern_type, '_')))) AS k FROM (SELECT DISTINCT pattern_type FROM fi)) GROUP BY pattern_type),
shown AS (SELECT sc.*, concat_ws(chr(10), '[' || level || '] ' || finding_type || ' - risk ' || composite, '  ' || description, '  IP: ' || ip, '  Time: ' || strftime(ref_ts, '%Y-%m-%d %H:%M:%S'), '  Pattern: ' || title.shown || coalesce(' (Window: ' || "window" || ')', ''), answers, '  ISP: ' || isp) AS report FROM sc JOIN title USING (pattern_type)),
threats AS (SELECT finding_type, count(*) AS n, min(place) AS best FROM sc GROUP BY finding_type ORDER BY n DESC, best LIMIT 3),
summary AS (SELECT min(ref_ts) AS period_start, max(ref_ts) AS period_end, count(*) AS findings, count(*) FILTER (composite >= 70) AS critical_high, count(DISTINCT finding_type) AS finding_types, (SELECT count(*) FROM e) AS entries FROM sc),
sev AS (SELECT count(*) AS total, count(*) FILTER (risk_score BETWEEN 80 AND 100) AS high, count(*) FILTER (risk_score BETWEEN 50 AND 79) AS medium, count(*) FILTER (risk_score BETWEEN 20 AND 49) AS low, count(*) FILTER (risk_score BETWEEN 1 AND 19) AS info FROM fi),
advice AS (SELECT list_filter([CASE WHEN count(*) FILTER (composite >= 70) > 0 THEN 'Investigate ' || count(*) FILTER (composite >= 70) || ' critical or high findings at once' END, CASE WHEN count(*) FILTER (contains(finding_type, 'Brute Force')) > 0 THEN 'Limit login attempts and lock accounts under attack' END, CASE WHEN count(*) FILTER (contains(finding_type, 'Scanning')) > 0 THEN 'Block scanners at the firewall' END, CASE WHEN count(*) FILTER (contains(finding_type, 'SQL')) > 0 THEN 'Review input checks against SQL injection' END, CASE WHEN count(*) FILTER (bad) > 0 THEN 'Block ' || count(*) FILTER (bad) || ' IPs with a malicious reputation' END], lambda x: x IS NOT NULL) AS list, count(*) FILTER (bad) AS malicious, count(DISTINCT CASE WHEN bad THEN ip END) AS malicious_ips FROM sc),
words AS (SELECT ip FROM fi UNION SELECT unnest(regexp_extract_all(concat_ws(' | ', request_line, user_agent, referer), 'WORD')) FROM fi),
ips AS (SELECT ip FROM words WHERE contains(ip, ':') OR regexp_matches(ip, '^V4$')),
pub AS (SELECT ip, contains(ip, ':') OR NOT regexp_matches(ip, '^(0|10|127)[.]|^169[.]254[.]|^172[.](1[6-9]|2[0-9]|3[01])[.]|^192[.]168[.]|^192[.]0[.][02][.]|^198[.]1[89][.]|^198[.]51[.]100[.]|^203[.]0[.]113[.]|^2[45][0-9][.]') AS public FROM ips)""".replace("FINDINGS", findings()).replace("WORD", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b").replace("V4", V4)
SEVERITY = "count(*) AS total, count(*) FILTER (risk_score BETWEEN 80 AND 100) AS high, count(*) FILTER (risk_score BETWEEN 50 AND 79) AS medium, count(*) FILTER (risk_score BETWEEN 20 AND 49) AS low, count(*) FILTER (risk_score BETWEEN 1 AND 19) AS info"


ITEM = "try_cast(regexp_extract(request_line, '/item/([0-9]+)[?]', 1) AS BIGINT)"
NO_ITEM = f"{ITEM} IS NULL"
KEPT = """detector, finding_type, pattern_type, fi.ip AS ip, country, "window", risk_score, 'access.log' AS ref_file, ref_line, description"""
_ASKED = [(p, c) for p in ("abuseipdb", "virustotal") for c in ("confidence_score", "is_malicious", "country_code")]
EACH = ", ".join(f"max(CASE WHEN provider = '{p}' THEN {c} END) AS {p}_{c}" for p, c in _ASKED)
ANSWERS = ", ".join(f"{p}_{c}" for p, c in _ASKED)


def scored(text: str) -> str:
    return sql(text, True, SCORED)


def oracle_sql() -> dict[str, str]:
    out = {
        "read_log_lines": sql("SELECT line_number, content, 'utf-8' AS encoding FROM access_log"),
        "decode_lines": sql("SELECT 'utf-8' AS encoding, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM access_log"),
        "decode_files": sql("SELECT CASE line_number % 3 WHEN 2 THEN content ELSE content || chr(233) END AS content, CASE line_number % 3 WHEN 1 THEN 'latin-1' ELSE 'utf-8' END AS encoding, false AS decode_error FROM access_log"),
        "ingestion_summary": sql("SELECT count(*) AS lines_processed, CAST(0 AS BIGINT) AS errors FROM access_log"),
        "write_findings": sql(f"SELECT ip, risk_score FROM ({FAILED_LOGIN})"),
        "parse_access_log": sql("SELECT line_number, ip, ts, request_line, status, user_agent, bytes_sent, referer, remote_user, path FROM e"),
        "parse_clf_timestamp": sql("SELECT ts, count(*) AS n FROM e GROUP BY ts"),
        "validate_ip": sql("SELECT line_number, error FROM parsed WHERE error LIKE 'Invalid IP%'"),
        "validate_status": sql("SELECT line_number, error FROM parsed WHERE error LIKE 'Invalid HTTP status%'"),
        "normalize_fields": sql("SELECT count(bytes_sent) AS bytes_sent, count(remote_user) AS remote_user, count(referer) AS referer, count(user_agent) AS user_agent FROM e"),
        "parse_errors": sql("SELECT line_number, error, CASE WHEN length(raw_line) > 100 THEN substr(raw_line, 1, 100) || '...' ELSE raw_line END AS raw_line FROM parsed WHERE error IS NOT NULL"),
        "parse_stats": sql("SELECT file_path, count(*) AS total, count(*) FILTER (error IS NULL) AS successful, count(error) AS errors, round(count(*) FILTER (error IS NULL) * 100.0 / count(*), 6) AS success_rate FROM parsed GROUP BY file_path"),
        "request_path": f"SELECT page_id, {path_of('url')} AS path FROM pages",
        "unpivot_targets": sql("SELECT * FROM u"),
        "url_decode_text": sql("SELECT line_number, decoded FROM d WHERE field = 'request_line'"),
        "keyword_sqli": sql(keyword("sql_injection")),
        "keyword_command_exec": sql(keyword("command_execution")),
        "keyword_xss": sql(keyword("xss")),
        "keyword_findings": sql(f"SELECT line_number, field, pattern_type, {TITLE} AS finding_type, risk_score, matched_text, 'Detected ' || replace(pattern_type, '_', ' ') || ' pattern in ' || field || ': ''' || matched_text || '''' AS description FROM ({ALL_WORDS})"),
        "pattern_selectivity": sql(selectivity()),
        "keyword_counts": sql(f"SELECT pattern_type, field, count(*) AS n FROM ({ALL_WORDS}) GROUP BY ALL"),
        "ip_status_distribution": sql("SELECT ip, string_agg(status || '=' || n, '|' ORDER BY status) AS statuses, CAST(sum(n) AS BIGINT) AS total FROM (SELECT ip, status, count(*) AS n FROM e GROUP BY ALL) GROUP BY ip"),
        "failed_login_pattern": sql(FAILED_LOGIN),
        "high_request_frequency": sql(HIGH),
        "sliding_window_stats": sql(f"SELECT s.ip, \"window\", CAST(max_requests AS BIGINT) AS max_requests, CAST(max_failed AS BIGINT) AS max_failed, total, paths, agents FROM ({sliding({'1min': 60, '5min': 300, '15min': 900, '1hour': 3600})}) s JOIN (SELECT ip, count(*) AS total, count(DISTINCT path) AS paths, count(DISTINCT nullif(user_agent, '')) AS agents FROM e GROUP BY ip) USING (ip)"),
        "burst_periods": sql(f"SELECT ip, sec, pos, c - (pos - lo) AS requests FROM (SELECT ip, sec, pos, count(*) OVER (PARTITION BY ip ORDER BY sec RANGE BETWEEN CURRENT ROW AND 60 FOLLOWING) AS c, min(pos) OVER (PARTITION BY ip, sec) AS lo FROM e) WHERE c - (pos - lo) >= {LOW.burst_period_requests}"),
        "time_windowed_brute_force": sql(body(LOW, "time_windowed_brute_force")),
        "request_burst_pattern": sql(body(LOW, "request_burst_pattern")),
        "scan_periods": sql(f"SELECT s.*, (SELECT array_to_string(list_sort(list(DISTINCT b.path)), '|') FROM e b WHERE b.ip = s.ip AND b.pos BETWEEN s.pos AND s.pos + 19 AND b.sec <= s.sec + 300) AS sample_paths FROM ({scan(300, 10)}) s"),
        "path_enumeration": sql(body(DEFAULT, "path_enumeration")),
        "scanning_tool_signature": sql(body(DEFAULT, "scanning_tool_signature")),
        "vulnerability_scanning": sql(body(LOW, "vulnerability_scanning")),
        "dos_burst_pattern": sql(dos_pattern(LOW)),
        "dos_burst_periods": sql(dos_periods(LOW)),
        "user_agent_rotation": sql(body(DEFAULT, "user_agent_rotation")),
        "automated_request_pattern": sql(body(LOW, "automated_request_pattern")),
        "large_request_pattern": sql(body(LARGE, "large_request_pattern")),
        "automated_session_pattern": sql(body(LOW, "automated_session_pattern")),
        "attach_country": sql("SELECT line_number, ip, country FROM geo", True),
        "rapid_geographic_changes": sql(body(DEFAULT, "rapid_geographic_changes"), True),
        "geo_change_periods": sql("SELECT a.ip, a.sec, a.pos, count(DISTINCT b.country) AS count, array_to_string(list_sort(list(DISTINCT b.country)), '|') AS countries FROM g a JOIN g b ON a.ip = b.ip AND b.pos >= a.pos AND b.sec <= a.sec + 3600 GROUP BY ALL HAVING count(DISTINCT b.country) >= 3", True, "g AS (SELECT ip, sec, country, row_number() OVER (PARTITION BY ip ORDER BY pos) AS pos FROM geo)"),
        "high_risk_country_activity": sql(body(LOW, "high_risk_country_activity"), True),
        "impossible_travel": sql(body(DEFAULT, "impossible_travel"), True),
        "normalize_abuseipdb": sql("SELECT * FROM abuse2", True),
        "normalize_virustotal": sql("SELECT * FROM virus", True),
        "latest_reputation": sql("SELECT ip, provider, query_ts, confidence_score, country_code FROM latest", True),
        "enrich_findings": sql(f"SELECT ip, risk_score, coalesce(string_agg(provider, '|' ORDER BY provider), '') AS providers_successful, CASE WHEN count(*) FILTER (provider = 'abuseipdb') = 0 THEN CASE WHEN count(provider) = 0 THEN 'abuseipdb|virustotal' ELSE 'abuseipdb' END WHEN count(provider) = 1 THEN 'virustotal' ELSE '' END AS providers_failed, max(CASE WHEN provider = 'abuseipdb' THEN confidence_score END) AS abuse_confidence FROM ({FAILED_LOGIN}) LEFT JOIN latest USING (ip) GROUP BY ip, risk_score", True),
        "malicious_findings": sql(f"SELECT ip, risk_score FROM ({FAILED_LOGIN}) WHERE ip IN (SELECT ip FROM latest WHERE is_malicious)", True),
        "unenriched_findings": sql(f"SELECT ip, risk_score FROM ({HIGH}) WHERE ip NOT IN (SELECT ip FROM latest WHERE provider = 'abuseipdb')", True),
        "requests_by_country": sql("SELECT country, count(*) AS requests, count(DISTINCT ip) AS ips FROM geo GROUP BY country", True),
        "top_user_agents": sql("SELECT user_agent, count(*) AS n FROM e WHERE user_agent <> '' GROUP BY 1 ORDER BY n DESC, user_agent LIMIT 10"),
        "top_referers": sql("SELECT referer, count(*) AS n FROM e WHERE referer <> '' GROUP BY 1 ORDER BY n DESC, referer LIMIT 10"),
        "error_analysis": sql("SELECT CAST(class AS BIGINT) AS class, status, errors, round(errors / (SELECT count(*) FROM e), 6) AS share FROM (SELECT status // 100 AS class, status, count(*) AS errors FROM e WHERE status >= 400 GROUP BY ROLLUP (class, status))"),
        "errors_by_path": sql("SELECT path, count(*) AS requests, count(*) FILTER (status BETWEEN 400 AND 499) AS client_errors, count(*) FILTER (status >= 500) AS server_errors FROM e GROUP BY path"),
        "requests_over_time": sql("SELECT date_trunc('minute', ts) AS start, count(*) AS requests, count(*) FILTER (status >= 400) AS errors FROM e GROUP BY 1"),
    }
    out |= {
        "file_inventory": sql("SELECT CAST(sum(strlen(content) + 1) AS BIGINT) AS file_size, count(*) AS line_count, CAST(0 AS BIGINT) AS empty_files, 'utf-8' AS encoding FROM access_log"),
        "all_findings": scored("SELECT detector, finding_type, count(*) AS n, CAST(sum(risk_score) AS BIGINT) AS risk FROM fi GROUP BY ALL"),
        "sorted_findings": scored("SELECT detector, pattern_type, ip, risk_score, ref_line FROM fi"),
        "severity_counts": scored("SELECT * FROM sev"),
        "detector_statistics": scored(f"SELECT detector, {SEVERITY}, entries_processed, processing_errors, (entries_processed - processing_errors) * 1e2 / entries_processed AS success_rate FROM fi, (SELECT count(*) AS entries_processed, count(*) FILTER (ip IS NULL OR ts IS NULL) AS processing_errors FROM e) GROUP BY ALL"),
        "detector_failures": sql(f"SELECT 'items' AS detector, line_number AS ref_line FROM e WHERE {NO_ITEM}"),
        "detector_statistics_with_failures": scored(f"SELECT detector, {SEVERITY}, (SELECT count(*) FROM e) AS entries_processed, errors AS processing_errors, round(((SELECT count(*) FROM e) - errors) * 1e2 / (SELECT count(*) FROM e), 6) AS success_rate FROM (SELECT detector, risk_score, 0 AS errors FROM fi WHERE detector IN ('keyword', 'frequency') UNION ALL SELECT 'items', {ITEM}, (SELECT count(*) FROM e WHERE {NO_ITEM}) FROM e WHERE {ITEM} >= 90) GROUP BY detector, errors"),
        "enrich_all_findings": scored(f"SELECT {KEPT}, 'abuseipdb|virustotal' AS providers_queried, coalesce(ok, '') AS providers_successful, CASE WHEN a.ip IS NULL THEN 'abuseipdb|virustotal' WHEN NOT has_a THEN 'abuseipdb' WHEN NOT has_v THEN 'virustotal' ELSE '' END AS providers_failed, {ANSWERS} FROM fi LEFT JOIN (SELECT ip AS aip, string_agg(provider, '|' ORDER BY provider) AS ok, bool_or(provider = 'abuseipdb') AS has_a, bool_or(provider = 'virustotal') AS has_v, {EACH}, ip FROM latest GROUP BY ip) a ON a.aip = fi.ip"),
        "malicious_all_findings": scored(f"SELECT {KEPT} FROM fi WHERE ip IN (SELECT ip FROM latest WHERE is_malicious)"),
        "unenriched_all_findings": scored(f"SELECT {KEPT} FROM fi WHERE ip NOT IN (SELECT ip FROM latest)"),
        "written_findings": scored(f"SELECT {KEPT}, ref_ts, request_line, status, user_agent, referer, bytes_sent FROM fi JOIN (SELECT line_number, status, bytes_sent FROM e) ON line_number = ref_line"),
        "pattern_type_counts": scored("SELECT pattern_type, count(*) AS n FROM fi GROUP BY pattern_type"),
        "extract_finding_ips": scored("SELECT ip FROM ips"),
        "public_ips": scored("SELECT ip FROM pub WHERE public"),
        "enrichment_stats": scored("SELECT ips_queried, skipped_private, CAST(successful_lookups AS BIGINT) AS successful_lookups, misses, (SELECT count(*) FROM fi WHERE ip IN (SELECT ip FROM latest)) AS findings_enriched, round(successful_lookups * 1e2 / ips_queried, 6) AS success_rate FROM (SELECT count(*) FILTER (public) AS ips_queried, count(*) FILTER (NOT public) AS skipped_private, coalesce(sum(CASE WHEN public THEN n END), 0) AS successful_lookups, count(*) FILTER (public AND n IS NULL) AS misses FROM pub LEFT JOIN (SELECT ip, count(*) AS n FROM latest GROUP BY ip) USING (ip))"),
        "composite_risk": scored("SELECT detector, pattern_type, ip, ref_line, risk_score, composite FROM sc"),
        "risk_level": scored("SELECT level, count(*) AS n FROM sc GROUP BY level"),
        "priority_findings": scored("SELECT finding_type, ip, composite, level FROM sc WHERE place <= 5"),
        "executive_summary": scored("SELECT * FROM summary"),
        "top_threats": scored("SELECT finding_type, n FROM threats"),
        "recommendations": scored("SELECT array_to_string(CASE WHEN len(list) > 0 THEN list ELSE ['No action needed; keep monitoring'] END, '|') AS recommendations, malicious, malicious_ips FROM advice"),
        "format_findings": scored("SELECT report FROM shown WHERE place <= 5"),
        "render_report": scored("SELECT 'Period: ' || strftime(period_start, '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(period_end, '%Y-%m-%d %H:%M:%S') || chr(10) || 'Entries: ' || entries || '  Findings: ' || findings || ' (high ' || high || ', medium ' || medium || ', low ' || low || ', info ' || info || ')' || chr(10) || chr(10) || 'Top threats:' || chr(10) || (SELECT string_agg('  ' || finding_type || ': ' || n, chr(10) ORDER BY n DESC, best) FROM threats) || chr(10) || chr(10) || (SELECT string_agg(report, chr(10) || chr(10) ORDER BY place) FROM shown WHERE place <= 5) || chr(10) || chr(10) || 'Recommendations:' || chr(10) || '  - ' || (SELECT array_to_string(list, chr(10) || '  - ') FROM advice) || chr(10) AS report FROM summary, sev"),
        "register_parser": sql("SELECT file_path, count(*) AS total, count(*) FILTER (error IS NULL OR regexp_matches(raw_line, '^garbage line [0-9]+$')) AS successful, count(*) FILTER (error IS NOT NULL AND NOT regexp_matches(raw_line, '^garbage line [0-9]+$')) AS errors FROM parsed GROUP BY file_path"),
        "register_detector": sql("SELECT 'Busy Address' AS finding_type, ip, CAST(33 AS BIGINT) AS risk_score, 'Busy: ' || ip AS description, max(line_number) AS ref_line, '{\"n\":' || count(*) || '}' AS details FROM e GROUP BY ip HAVING count(*) >= 10"),
        "register_provider": sql("SELECT provider, count(*) AS n, count(*) FILTER (is_malicious) AS malicious, CAST(sum(confidence_score) AS BIGINT) AS scores FROM (SELECT provider, is_malicious, confidence_score FROM abuse2 UNION ALL SELECT provider, is_malicious, confidence_score FROM virus UNION ALL SELECT 'mirror', confidence_score >= 90, confidence_score FROM abuse2) GROUP BY provider", True),
    }
    answers = "(SELECT ip, provider, query_ts AS valid_from, max(confidence_score) AS confidence_score, arg_max(country_code, (confidence_score, country_code)) AS country_code FROM (SELECT ip, provider, query_ts, confidence_score, country_code FROM abuse2 UNION ALL SELECT ip, provider, query_ts, confidence_score, country_code FROM virus) GROUP BY ALL)"
    spans = f"(SELECT *, lead(valid_from) OVER (PARTITION BY ip, provider ORDER BY valid_from) AS valid_to FROM {answers})"
    out |= {
        "register_line_parser": sql("SELECT line_number, '127.0.0.' || (n % 3) AS ip, 200 + n % 3 AS status, n * (n % 3 + 1) AS bytes_sent, CAST(n AS VARCHAR) AS path FROM (SELECT line_number, CAST(regexp_extract(raw_line, '^garbage line ([0-9]+)$', 1) AS BIGINT) AS n FROM parsed WHERE regexp_matches(raw_line, '^garbage line [0-9]+$'))"),
        "reputation_history": sql(f"SELECT ip, provider, valid_from, valid_to, confidence_score, country_code FROM {spans}", True),
        "attach_country_valid": sql(f"SELECT e.line_number, e.ip, s.country_code AS country FROM e JOIN {spans} s ON e.ip = s.ip AND s.provider = 'abuseipdb' AND e.ts >= s.valid_from AND (s.valid_to IS NULL OR e.ts < s.valid_to)", True),
        "publish_findings": out["written_findings"],
    }
    return out | {f"{name}_full": out[name].replace(REPUTATION_RAW, REPUTATION_ALL) for name in FULL if name in out}
