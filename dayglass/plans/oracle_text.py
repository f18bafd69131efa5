"""DuckDB twins of the registered queries, for the correctness check only.

`VIEWS` are shared building blocks; each oracle names what it needs and `_sql` puts the needed
views, in order, in front. They are written independently of the Spark plans: self-joins where
Spark slides windows, exact quantiles where it brackets medians, a recursive query for the
hash chain, and plain expectations for the tamper drills.
"""

from __future__ import annotations

import re

from ..config import FEATURES, WEIGHTS

SPLIT = "DATE '2024-01-18'"
HOURS = range(24)

VIEWS: dict[str, str] = {}
VIEWS["ev"] = """
  SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"""
VIEWS["act"] = """
  SELECT event_id, ts, day, user_id, k, value,
    CASE event_type WHEN 'signup' THEN 'logon' WHEN 'error' THEN 'device' WHEN 'purchase' THEN 'file'
                    WHEN 'view' THEN 'http' WHEN 'click' THEN 'email' END AS source,
    CASE WHEN k < 80 THEN 'PC-' || user_id || '-0' ELSE 'PC-' || user_id || '-' || (k % 5) END AS pc,
    CASE event_type WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'Logon' ELSE 'Logoff' END
                    WHEN 'error' THEN 'Connect'
                    WHEN 'purchase' THEN CASE WHEN k < 60 THEN 'Open' WHEN k < 85 THEN 'Write'
                                              WHEN k < 95 THEN 'Copy' ELSE 'Delete' END END AS activity,
    CASE WHEN event_type = 'error' THEN 'USB-' || user_id || '-' || (k % 8) END AS device_id,
    CASE WHEN event_type = 'purchase' THEN 'f/file_' || k || '.dat' END AS filename,
    CASE WHEN event_type IN ('purchase', 'click') THEN value END AS size_mb,
    CASE WHEN event_type = 'purchase' THEN k BETWEEN 85 AND 94 AND k % 2 = 1 END AS to_removable_media,
    CASE WHEN event_type = 'view' THEN 'https://site-' || (k % 12) || '.example/path' || k END AS url,
    CASE WHEN event_type = 'view' THEN 'site-' || (k % 12) || '.example' END AS domain,
    CASE WHEN event_type = 'view' THEN 'cat' || (k % 6) END AS category,
    CASE WHEN event_type = 'view' THEN CASE WHEN k >= 90 THEN value ELSE 0.0 END END AS upload_mb,
    CASE WHEN event_type = 'click' THEN CASE WHEN k % 5 = 0 THEN 'external' ELSE 'internal' END END AS to_domain_type,
    CASE WHEN event_type = 'click' THEN k % 3 END AS attachments
  FROM ev"""
VIEWS["dir"] = "SELECT c_custkey AS user_id, c_mktsegment AS role FROM customer"
VIEWS["ud"] = "SELECT DISTINCT user_id, day FROM act"
VIEWS["peak"] = f"""
  SELECT p.user_id, p.day, d.role, p.max_value, CASE WHEN p.day < {SPLIT} THEN 'train' ELSE 'test' END AS split,
         p.day >= {SPLIT} AND p.max_value >= 200 AS is_malicious,
         CASE WHEN p.day >= {SPLIT} AND p.max_value >= 200 THEN 'SCN_' || d.role END AS scenario_id
  FROM (SELECT user_id, day, max(value) AS max_value FROM ev GROUP BY ALL) p LEFT JOIN dir d USING (user_id)"""
VIEWS["fold"] = """
  SELECT user_id, day, count(*) AS n_events,
    coalesce((epoch_us(max(ts) FILTER (source = 'logon')) - epoch_us(min(ts) FILTER (source = 'logon'))) / 6e7, 0)
      AS session_duration_min,
    count(DISTINCT pc) AS n_pcs_used, count(DISTINCT device_id) AS n_device_connects,
    count(activity) FILTER (source = 'file') AS n_file_events,
    coalesce(sum(size_mb) FILTER (source = 'file'), 0) AS file_volume_mb,
    coalesce(sum(size_mb) FILTER (source = 'file' AND to_removable_media), 0) AS removable_mb,
    count(url) FILTER (source = 'http') AS n_http_events,
    coalesce(sum(upload_mb) FILTER (source = 'http'), 0) AS http_export_mb,
    count(size_mb) FILTER (source = 'email') AS n_email_events,
    coalesce(sum(size_mb) FILTER (source = 'email'), 0) AS email_volume_mb,
    count(*) FILTER (source = 'email' AND to_domain_type = 'external') AS email_external_count,
    count(*) FILTER (hour(ts) < 8 OR hour(ts) >= 18) / count(*) AS after_hours_ratio
  FROM act GROUP BY user_id, day"""
VIEWS["hour_ent"] = """
  SELECT a.user_id, a.day, entropy(hour(x.ts)) AS e
  FROM ud a JOIN act x ON x.user_id = a.user_id AND x.day BETWEEN a.day - 6 AND a.day GROUP BY a.user_id, a.day"""
VIEWS["dow_ent"] = """
  SELECT a.user_id, a.day, entropy(isodow(b.day)) AS e
  FROM ud a JOIN ud b ON b.user_id = a.user_id AND b.day BETWEEN a.day - 29 AND a.day GROUP BY a.user_id, a.day"""
VIEWS["seen"] = """
  SELECT user_id, 'host' AS kind, pc AS item, min(day) AS day FROM act GROUP BY ALL
  UNION ALL SELECT user_id, 'device', device_id, min(day) FROM act WHERE device_id IS NOT NULL GROUP BY ALL"""
VIEWS["flag"] = """
  SELECT s.user_id, s.day, max(CASE WHEN kind = 'host' THEN 1 ELSE 0 END) AS new_host_flag,
         max(CASE WHEN kind = 'device' THEN 1 ELSE 0 END) AS new_device_flag
  FROM seen s JOIN (SELECT user_id, min(day) AS start FROM ud GROUP BY ALL) f USING (user_id)
  WHERE s.day - f.start >= 7 GROUP BY s.user_id, s.day"""
VIEWS["tok"] = """
  SELECT user_id, day, 'url' AS kind, ts, event_id, domain AS token FROM act WHERE source = 'http'
  UNION ALL SELECT user_id, day, 'file', ts, event_id, activity FROM act WHERE source = 'file'"""
VIEWS["pair"] = """
  SELECT user_id, day, kind, token AS a,
         lead(token) OVER (PARTITION BY user_id, day, kind ORDER BY ts, event_id) AS b FROM tok"""
VIEWS["bicount"] = "SELECT kind, a, b, count(*) AS n FROM pair WHERE b IS NOT NULL GROUP BY ALL"
VIEWS["rare"] = """
  SELECT p.user_id, p.day, p.kind, avg(-log2(c.n / t.total)) AS r
  FROM pair p JOIN bicount c ON c.kind = p.kind AND c.a = p.a AND c.b = p.b
  JOIN (SELECT kind, sum(n) AS total FROM bicount GROUP BY ALL) t ON t.kind = p.kind GROUP BY ALL"""
VIEWS["feat"] = f"""
  SELECT f.user_id, f.day, d.role, p.is_malicious, p.scenario_id, p.split,
    he.e AS hour_entropy_7d, de.e AS dow_entropy_30d, f.after_hours_ratio, f.session_duration_min,
    f.file_volume_mb + f.email_volume_mb + f.http_export_mb AS data_volume_mb,
    f.removable_mb + f.http_export_mb AS export_volume_mb,
    CAST(coalesce(g.new_host_flag, 0) AS DOUBLE) AS new_host_flag,
    CAST(coalesce(g.new_device_flag, 0) AS DOUBLE) AS new_device_flag,
    coalesce(u.r, 0) AS url_bigram_rarity, coalesce(v.r, 0) AS file_bigram_rarity
  FROM fold f LEFT JOIN dir d USING (user_id) JOIN peak p USING (user_id, day)
  JOIN hour_ent he USING (user_id, day) JOIN dow_ent de USING (user_id, day)
  LEFT JOIN flag g USING (user_id, day)
  LEFT JOIN rare u ON u.user_id = f.user_id AND u.day = f.day AND u.kind = 'url'
  LEFT JOIN rare v ON v.user_id = f.user_id AND v.day = f.day AND v.kind = 'file'"""
VIEWS["melt"] = " UNION ALL ".join(
    f"SELECT user_id, day, role, split, {i} AS i, '{n}' AS feature, {w} AS weight, CAST({n} AS DOUBLE) AS x FROM feat"
    for i, (n, w) in enumerate(zip(FEATURES, WEIGHTS)))
VIEWS["rolestat"] = """
  SELECT role, i, feature, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std FROM melt
  WHERE split = 'train' GROUP BY ALL"""
VIEWS["popstat"] = """
  SELECT i, avg(x) AS mean, stddev_pop(x) AS std FROM melt WHERE split = 'train' GROUP BY ALL"""
VIEWS["zs"] = """
  SELECT m.user_id, m.day, m.i, m.feature, m.weight,
         (m.x - r.mean) / greatest(r.std, greatest(0.15 * p.std, 1e-9)) AS z
  FROM melt m JOIN rolestat r ON r.role = m.role AND r.i = m.i JOIN popstat p ON p.i = m.i"""
VIEWS["pull"] = """
  SELECT *, least(abs(z), 15 + ln(1 + greatest(abs(z) - 15, 0))) * weight AS w FROM zs"""
VIEWS["contrib"] = """
  SELECT user_id, day, feature, z, pct, row_number() OVER (PARTITION BY user_id, day ORDER BY pct DESC, i) - 1 AS place
  FROM (SELECT *, w / coalesce(nullif(sum(w) OVER (PARTITION BY user_id, day), 0), 1) * 100 AS pct FROM pull)"""


D = len(FEATURES)
VIEWS["covs"] = f"""
  SELECT a.role, a.i, b.i AS j, covar_samp(a.x, b.x) + CASE WHEN a.i = b.i THEN 1e-3 ELSE 0 END AS c
  FROM melt a JOIN melt b ON a.user_id = b.user_id AND a.day = b.day WHERE a.split = 'train' GROUP BY a.role, a.i, b.i"""
# rows of (covariance | identity), reduced column by column
VIEWS["solve"] = f"""
  SELECT role, 1 AS p, list(list_concat(cells, list_transform(range({D}), lambda j: CASE WHEN j = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) ORDER BY i) AS m
  FROM (SELECT role, i, list(c ORDER BY j) AS cells FROM covs GROUP BY role, i) GROUP BY role
  UNION ALL
  SELECT role, p + 1, list_transform(range(1, {D + 1}), lambda i: list_transform(range(1, {2 * D + 1}), lambda j:
    CASE WHEN i = p THEN m[p][j] / m[p][p] ELSE m[i][j] - m[i][p] * m[p][j] / m[p][p] END))
  FROM solve WHERE p <= {D}"""
VIEWS["inv"] = f"""
  SELECT role, i, j, m[i + 1][j + 1 + {D}] AS c FROM (SELECT role, m FROM solve WHERE p = {D + 1}),
    range({D}) a(i), range({D}) b(j)"""
VIEWS["dist"] = """
  SELECT x.user_id, x.day, x.role, x.split, sqrt(greatest(sum(x.d * y.d * c.c), 0)) AS d
  FROM (SELECT m.*, m.x - r.mean AS d FROM melt m JOIN rolestat r ON r.role = m.role AND r.i = m.i) x
  JOIN (SELECT m.*, m.x - r.mean AS d FROM melt m JOIN rolestat r ON r.role = m.role AND r.i = m.i) y
    ON x.user_id = y.user_id AND x.day = y.day
  JOIN inv c ON c.role = x.role AND c.i = x.i AND c.j = y.i GROUP BY ALL"""


def _baseline(rows: str, value: str, keys: str = "") -> str:
    """median, MAD and scale of a column, per key or over all rows."""
    by = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
  SELECT *, CASE WHEN mad > 0 THEN mad * 1.4826 WHEN std <> 0 THEN std ELSE 1.0 END AS scale FROM (
    SELECT {lead}count(*) AS n, any_value(m) AS baseline, quantile_cont(abs({value} - m), 0.5) AS mad,
           stddev_pop({value}) AS std
    FROM (SELECT *, quantile_cont({value}, 0.5) OVER ({by}) AS m FROM {rows} WHERE split = 'train') {group})"""


def _excess(value: str) -> str:
    return f"100 * (1 - exp(-greatest(0, {value} - baseline) / (2.5 * greatest(scale, 1e-9))))"


def _tier(score: str) -> str:
    return (f"CASE WHEN {score} >= 0 AND {score} < 40 THEN 'Low' WHEN {score} >= 40 AND {score} < 65 THEN 'Medium' "
            f"WHEN {score} >= 65 AND {score} < 85 THEN 'High' ELSE 'Critical' END")


VIEWS["base_dist"] = _baseline("dist", "d", "role")
VIEWS["base_all"] = _baseline("peak", "max_value")
VIEWS["base_role"] = _baseline("peak", "max_value", "role")
VIEWS["scored"] = f"""
  SELECT *, {_tier('risk_score')} AS risk_tier FROM (
    SELECT p.*, round({_excess('p.max_value')}, 6) AS risk_score FROM peak p, base_all)"""
VIEWS["by_role"] = f"""
  SELECT p.user_id, p.day, p.role, {_excess('p.max_value')} AS score FROM peak p LEFT JOIN base_role b ON b.role = p.role"""
VIEWS["vol"] = """
  SELECT f.user_id, f.day, p.split, p.is_malicious,
         f.file_volume_mb + f.email_volume_mb + f.http_export_mb AS v
  FROM fold f JOIN peak p USING (user_id, day)"""
VIEWS["base_vol"] = _baseline("vol", "v")
VIEWS["held"] = f"""
  SELECT user_id, day, CAST(is_malicious AS INTEGER) AS y, round({_excess('v')}, 6) AS s
  FROM vol, base_vol WHERE split = 'test'"""
def _curve(held: str) -> str:
    return f"""
  SELECT s AS score, n, pos, sum(n) OVER w AS cum_n, sum(pos) OVER w AS cum_pos
  FROM (SELECT s, count(*) AS n, sum(y) AS pos FROM {held} GROUP BY s)
  WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)"""


def _topk(held: str) -> str:
    return f"""
  SELECT c.share, c.k, sum(r.y) AS hits, any_value(c.p) AS p
  FROM (SELECT share, greatest(1, CAST(round_even(count(*) * share, 0) AS BIGINT)) AS k, sum(y) AS p
        FROM {held}, (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.02 AS DOUBLE)), (CAST(0.05 AS DOUBLE))) t(share) GROUP BY share) c
  JOIN (SELECT y, row_number() OVER (ORDER BY s DESC, sha256(user_id || '|' || day)) AS r FROM {held}) r ON r.r <= c.k
  GROUP BY c.share, c.k"""


VIEWS["curve"], VIEWS["topk"] = _curve("held"), _topk("held")
def _dec(rows: str) -> str:
    return f"""
  SELECT *, CASE risk_tier WHEN 'Low' THEN 'log_only' WHEN 'Medium' THEN 'stepup_flagged'
                 WHEN 'High' THEN CASE WHEN pass THEN 'stepup_required_passed' ELSE 'quarantined_after_failed_stepup' END
                 ELSE 'auto_quarantined' END AS action
  FROM (SELECT *, CAST('0x' || substr(sha256(user_id || '|' || day || ' 00:00:00'), 1, 2) AS INTEGER) / 255 < 0.97 AS pass
        FROM {rows})"""


VIEWS["dec"] = _dec("scored")
VIEWS["ent"] = "SELECT DISTINCT role, 'SECRET-' || role AS secret_id FROM dir WHERE role <> 'FURNITURE'"
VIEWS["lease"] = """
  SELECT d.*, e.secret_id, substr(sha256('lease|' || d.user_id || '|' || d.day || ' 00:00:00'), 1, 16) AS lease_id
  FROM dec d LEFT JOIN ent e USING (role)"""
def _num(value: str) -> str:
    return f"'\"' || CAST(CAST(round({value}, 6) AS DECIMAL(18,6)) AS VARCHAR) || '\"'"


_NUM = _num("risk_score")
_SECRET = "coalesce('\"' || secret_id || '\"', 'null')"


def _fan(rows: str, forest: str = "risk_score", peer: str = "risk_score", tops: str = "'null'", revoked: str = "'[]'") -> str:
    """The audit events of decided sessions; `revoked` is the text of the leases a lockout ended."""
    who = """"role":"' || role || '","user":"' || user_id || '"}'"""
    ended = f"CASE WHEN {revoked} <> '[]' THEN 1 ELSE 0 END"
    locked = f"""'{{"cause":"%s","revoked_leases":' || {revoked} || ',"risk_score":' || {_NUM} || ',"role":"' || role || '"%s,"tier":"%s","user":"' || user_id || '"}}'"""
    scenario = ""","scenario_id":' || coalesce('"' || scenario_id || '"', 'null') || '"""
    gone = f"""'{{"lease_ids":' || {revoked} || ',"reason":"%s","user":"' || user_id || '"}}' FROM {rows} WHERE {revoked} <> '[]' AND action = '%s'"""
    return f"""
  SELECT user_id, day, 0 AS step_no, 'session_scored' AS event_type,
    '{{"date":"' || day || ' 00:00:00","isolation_forest_score":' || {_num(forest)} || ',"peer_group_score":' || {_num(peer)} ||
    ',"risk_score":' || {_NUM} || ',"risk_tier":"' || risk_tier || '",{who} AS payload FROM {rows}
  UNION ALL SELECT user_id, day, 1, 'stepup_auth_flagged', '{{"risk_score":' || {_NUM} || ',{who} FROM {rows} WHERE risk_tier = 'Medium'
  UNION ALL SELECT user_id, day, 1, 'stepup_auth_required',
    '{{"enhanced_logging":true,"risk_score":' || {_NUM} || ',"role":"' || role || '","top_features":' || {tops} || ',"user":"' || user_id || '"}}'
    FROM {rows} WHERE risk_tier = 'High'
  UNION ALL SELECT user_id, day, 2, 'stepup_auth_result',
    '{{"passed":' || CASE WHEN pass THEN 'true' ELSE 'false' END || ',"tier":"' || risk_tier || '","user":"' || user_id || '"}}'
    FROM {rows} WHERE risk_tier IN ('Medium', 'High')
  UNION ALL SELECT user_id, day, 3, 'leases_revoked_bulk', {gone % ("locked out: tier High, challenge failed", "quarantined_after_failed_stepup")}
  UNION ALL SELECT user_id, day, 3 + {ended}, 'session_quarantined', {locked % ("stepup_auth_failed", "", "High")}
    FROM {rows} WHERE action = 'quarantined_after_failed_stepup'
  UNION ALL SELECT user_id, day, 1, 'leases_revoked_bulk', {gone % ("locked out: tier Critical", "auto_quarantined")}
  UNION ALL SELECT user_id, day, 1 + {ended}, 'session_quarantined', {locked % ("critical_score", scenario, "Critical")}
    FROM {rows} WHERE action = 'auto_quarantined'
  UNION ALL SELECT user_id, day, 3, 'lease_issued',
    '{{"expires_at":"' || CAST(day + 1 AS DATE) || ' 00:05:00","lease_id":"' || lease_id ||
    '","reason":"challenge answered, tier ' || risk_tier || '","role":"' || role || '","secret_id":' || {_SECRET} ||
    ',"ttl_seconds":300,"user":"' || user_id || '"}}' FROM {rows} WHERE action IN ('stepup_flagged', 'stepup_required_passed')
  UNION ALL SELECT user_id, day, 4, 'lease_redeemed',
    '{{"lease_id":"' || lease_id || '","secret_id":' || {_SECRET} || ',"user":"' || user_id || '"}}'
    FROM {rows} WHERE action IN ('stepup_flagged', 'stepup_required_passed')"""


VIEWS["fan"] = _fan("lease")
VIEWS["entry"] = """
  SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY user_id, step_no) - 1 AS seq
  FROM (SELECT *, CAST(CAST(day + 1 AS DATE) AS VARCHAR) || ' 00:00:00' AS event_time,
          day || '/' || CAST('0x' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 4) AS INTEGER) % 4 AS chain_id FROM fan)"""
_ENTRY = ("sha256('{\"event_type\":\"' || e.event_type || '\",\"payload\":' || e.payload || ',\"prev_hash\":\"' || %s || "
          "'\",\"seq\":' || e.seq || ',\"timestamp\":\"' || e.event_time || '\"}')")
_FIELDS = "e.chain_id, e.seq, e.event_time, e.event_type, e.payload"


def _chain(entries: str) -> str:
    zero = "repeat('0', 64)"
    return f"""
  SELECT {_FIELDS}, {zero} AS prev_hash, {_ENTRY % zero} AS entry_hash FROM {entries} e WHERE e.seq = 0
  UNION ALL SELECT {_FIELDS}, c.entry_hash, {_ENTRY % 'c.entry_hash'}
  FROM {entries}_chain c JOIN {entries} e ON e.chain_id = c.chain_id AND e.seq = c.seq + 1"""


VIEWS["entry_chain"] = _chain("entry")
VIEWS["head"] = """
  SELECT 'heads/' || split_part(c.chain_id, '/', 1) AS chain_id, split_part(c.chain_id, '/', 1) AS event_time,
         row_number() OVER (PARTITION BY split_part(c.chain_id, '/', 1) ORDER BY c.chain_id) - 1 AS seq,
         'chain_head' AS event_type, '{"chain_id":"' || c.chain_id || '","entries":' || n || ',"head_hash":"' || h || '"}' AS payload
  FROM (SELECT chain_id, count(*) AS n, max_by(entry_hash, seq) AS h FROM entry_chain GROUP BY ALL) c"""
VIEWS["head_chain"] = _chain("head")
VIEWS["dayhead"] = """
  SELECT 'days' AS chain_id, split_part(c.chain_id, '/', 2) AS event_time, row_number() OVER (ORDER BY c.chain_id) - 1 AS seq,
         'day_head' AS event_type, '{"chain_id":"' || c.chain_id || '","entries":' || n || ',"head_hash":"' || h || '"}' AS payload
  FROM (SELECT chain_id, count(*) AS n, max_by(entry_hash, seq) AS h FROM head_chain GROUP BY ALL) c"""
VIEWS["dayhead_chain"] = _chain("dayhead")
VIEWS["len"] = "SELECT chain_id, count(*) AS n, CAST(count(*) // 2 AS BIGINT) AS m FROM entry GROUP BY ALL"
# ---- ledgers; event_id rises with time, so it orders events
VIEWS["grants"] = """
  SELECT event_id AS lease_id, user_id, ts AS issued_at, ts + (k + 1) * INTERVAL 1 HOUR AS expires_at
  FROM ev WHERE event_type = 'signup'"""
VIEWS["latest"] = """
  SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (
           PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS lease_id
  FROM ev WHERE event_type IN ('signup', 'purchase', 'click')"""
VIEWS["tries"] = "SELECT event_id AS id, ts AS t_at, user_id, lease_id FROM latest WHERE event_type = 'purchase'"
VIEWS["singles"] = """
  SELECT event_id AS id, ts AS t_at, user_id, lease_id FROM latest
  WHERE event_type = 'click' AND k >= 90 AND lease_id IS NOT NULL"""
VIEWS["bulks"] = "SELECT event_id AS id, ts AS t_at, user_id FROM ev WHERE event_type = 'error' AND k >= 80"
VIEWS["state"] = """
  SELECT *, CASE WHEN f < coalesce(r, 9e18) THEN f END AS redeemed, CASE WHEN coalesce(f, 9e18) < r THEN NULL ELSE r END AS revoked
  FROM (SELECT *, least(s, b) AS r FROM (
    SELECT g.*,
      (SELECT min(id) FROM tries t WHERE t.lease_id = g.lease_id AND t.t_at <= g.expires_at) AS f,
      (SELECT min(id) FROM singles t WHERE t.lease_id = g.lease_id) AS s,
      (SELECT min(id) FROM bulks t WHERE t.user_id = g.user_id AND t.id > g.lease_id AND t.t_at <= g.expires_at) AS b
    FROM grants g))"""
VIEWS["asks"] = """
  SELECT event_id AS id, ts AS t_at, user_id, CASE k % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN '' ELSE 'approver-' || k END AS approver
  FROM ev WHERE event_type = 'click' AND k < 20"""
VIEWS["quars"] = "SELECT event_id AS id, ts AS t_at, user_id, 'error k=' || k AS reason FROM ev WHERE event_type = 'error' AND k >= 80"
VIEWS["asked"] = """
  SELECT *, approver <> '' AND approver <> CAST(user_id AS VARCHAR) AS named,
         (SELECT max(q.id) FROM quars q WHERE q.user_id = a.user_id AND q.id <= a.id) AS seg FROM asks a"""
VIEWS["resumed"] = """
  SELECT id AS request_id, t_at, user_id, approver, seg AS quarantine_id,
    CASE WHEN seg IS NULL OR id > coalesce(c, 9e18) THEN 'not_quarantined' WHEN id = c THEN 'approved'
         ELSE 'denied_missing_or_self' END AS outcome
  FROM (SELECT *, min(CASE WHEN named AND seg IS NOT NULL THEN id END) OVER (PARTITION BY user_id, seg) AS c FROM asked)"""
VIEWS["qledger"] = """
  SELECT q.user_id, q.n AS n_quarantines, q.id AS quarantine_id, epoch_us(q.t_at) AS quarantined_at, q.reason,
         epoch_us(r.t_at) AS released_at, r.approver AS released_by, CAST(r.t_at IS NULL AS BIGINT) AS active,
         coalesce(d.role, 'Unknown') AS role
  FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS rn
        FROM quars) q
  LEFT JOIN (SELECT * FROM resumed WHERE outcome = 'approved') r ON r.user_id = q.user_id AND r.quarantine_id = q.id
  LEFT JOIN dir d ON d.user_id = q.user_id WHERE q.rn = 1"""
VIEWS["resume_lease"] = """
  SELECT r.*, d.role, e.secret_id, substr(sha256('resume|' || request_id), 1, 16) AS lease_id
  FROM resumed r LEFT JOIN dir d USING (user_id) LEFT JOIN ent e ON e.role = d.role"""
VIEWS["resume_fan"] = f"""
  SELECT request_id, user_id, t_at, 0 AS step_no, 'second_person_approval_denied' AS event_type,
    '{{"approver":"' || approver || '","cause":"missing_or_self_approval","user":"' || user_id || '"}}' AS payload
    FROM resume_lease WHERE outcome = 'denied_missing_or_self'
  UNION ALL SELECT request_id, user_id, t_at, 0, 'second_person_approval',
    '{{"approver":"' || approver || '","role":"' || role || '","user":"' || user_id || '"}}' FROM resume_lease WHERE outcome = 'approved'
  UNION ALL SELECT request_id, user_id, t_at, 1, 'lease_issued',
    '{{"expires_at":"' || strftime(t_at + INTERVAL 300 SECOND, '%Y-%m-%d %H:%M:%S') || '","lease_id":"' || lease_id ||
    '","reason":"release approved by ' || approver || '","role":"' || role || '","secret_id":' || {_SECRET} ||
    ',"ttl_seconds":300,"user":"' || user_id || '"}}' FROM resume_lease WHERE outcome = 'approved'
  UNION ALL SELECT request_id, user_id, t_at, 2, 'quarantine_released',
    '{{"approved_by":"' || approver || '","lease_id":"' || lease_id || '","user":"' || user_id || '"}}'
    FROM resume_lease WHERE outcome = 'approved'"""

# ---- forest: the same hashes draw the samples and grow the trees, level by level
TREES, TREE_ROWS, LEVELS, SEED = 200, 256, 8, 42
_HEX = "CAST('0x' || substr(%s, %s, 12) AS BIGINT) / 281474976710656.0::DOUBLE"
VIEWS["fgrid"] = """
  SELECT m.user_id, m.day, m.split, list(round_even((m.x - p.mean) / CASE WHEN p.std = 0 THEN 1 ELSE p.std END * 1e6, 0) ORDER BY m.i) AS x
  FROM melt m JOIN popstat p ON p.i = m.i GROUP BY ALL"""
VIEWS["fsize"] = f"""
  SELECT *, least(1.0::DOUBLE, (2 * take + 20) / n) AS p, CAST(ceil(log2(greatest(take, 2))) AS INTEGER) AS deepest
  FROM (SELECT count(*) AS n, least({TREE_ROWS}, count(*)) AS take FROM fgrid WHERE split = 'train')"""
VIEWS["fkept"] = f"""
  SELECT *, len(list_filter(range({TREES}), lambda t: 1.0::DOUBLE - pow(1.0::DOUBLE - p, t + 1) <= u)) AS first
  FROM (SELECT g.*, f.p, f.take, '{SEED}|' || user_id || '|' || day AS name, {_HEX % (f"sha256('{SEED}|' || user_id || '|' || day)", 1)} AS u
        FROM fgrid g, fsize f WHERE split = 'train') WHERE u < 1.0::DOUBLE - pow(1.0::DOUBLE - p, {TREES})"""
VIEWS["fsample"] = f"""
  SELECT t, 0 AS node, x FROM (
    SELECT *, row_number() OVER (PARTITION BY t ORDER BY CASE WHEN t = first THEN u * p ELSE u END, user_id, day) AS place
    FROM (SELECT k.* EXCLUDE (u), r.t, {_HEX % ("sha256(name || '|' || t // 5)", "12 * (t % 5) + 1")} AS u FROM fkept k, range({TREES}) r(t) WHERE t >= first)
    WHERE t = first OR u < p) WHERE place <= take"""
_EACH = range(1, len(FEATURES) + 1)
for _level in range(LEVELS + 1):
    _rows = "fsample" if not _level else f"fl{_level}"
    VIEWS[f"fn{_level}"] = f"""
  SELECT t, node, n, f, lo[f] + place * (hi[f] - lo[f]) AS cut FROM (
    SELECT *, CASE WHEN rows.n > 1 AND {_level} < deepest AND len(usable) > 0 THEN usable[1 + CAST(floor(choice * len(usable)) AS INTEGER)] END AS f
    FROM (SELECT *, list_filter(range(1, {len(FEATURES) + 1}), lambda i: hi[i] > lo[i]) AS usable,
            {_HEX % (f"sha256('{SEED}|' || t || '|' || node)", 1)} AS choice, {_HEX % (f"sha256('{SEED}|' || t || '|' || node)", 13)} AS place
          FROM (SELECT t, node, count(*) AS n, [{", ".join(f"min(x[{i}])" for i in _EACH)}] AS lo, [{", ".join(f"max(x[{i}])" for i in _EACH)}] AS hi
                FROM {_rows} GROUP BY t, node)) rows, (SELECT deepest FROM fsize))"""
    if _level < LEVELS:
        VIEWS[f"fl{_level + 1}"] = f"""
  SELECT l.t, 2 * l.node + 1 + CASE WHEN l.x[d.f] > d.cut THEN 1 ELSE 0 END AS node, l.x
  FROM {_rows} l JOIN fn{_level} d ON d.t = l.t AND d.node = l.node WHERE d.f IS NOT NULL"""
    _here = f"(SELECT user_id, day, r.t, 0 AS node, x FROM fgrid, range({TREES}) r(t))" if not _level else f"fd{_level}"
    VIEWS[f"fd{_level + 1}"] = f"""
  SELECT h.user_id, h.day, h.t, h.x, d.n, CASE WHEN d.f IS NOT NULL THEN 2 * h.node + 1 + CASE WHEN h.x[d.f] > d.cut THEN 1 ELSE 0 END END AS node
  FROM {_here} h JOIN fn{_level} d ON d.t = h.t AND d.node = h.node"""
_PATH = ("CASE WHEN {0} <= 1 THEN 0.0::DOUBLE WHEN {0} = 2 THEN 1.0::DOUBLE ELSE 2 * (ln({0} - 1.0::DOUBLE) + 0.5772156649015329) - 2 * ({0} - 1.0::DOUBLE) / {0} END")
VIEWS["fleaf"] = " UNION ALL ".join(
    f"SELECT user_id, day, {k} + {_PATH.format('n')} AS path FROM fd{k + 1} WHERE node IS NULL" for k in range(LEVELS + 1))
VIEWS["fraw"] = f"""
  SELECT l.user_id, l.day, any_value(g.split) AS split, pow(2.0::DOUBLE, -avg(path) / any_value(CASE WHEN take <= 1 THEN 1 ELSE {_PATH.format('take')} END)) AS raw
  FROM fleaf l JOIN fgrid g ON g.user_id = l.user_id AND g.day = l.day, fsize GROUP BY l.user_id, l.day"""
VIEWS["base_raw"] = _baseline("fraw", "raw")
VIEWS["fscore"] = f"SELECT f.*, {_excess('raw')} AS score FROM fraw f, base_raw"
VIEWS["pscore"] = f"SELECT x.user_id, x.day, {_excess('x.d')} AS score FROM dist x JOIN base_dist b ON b.role = x.role"
VIEWS["risks"] = f"""
  SELECT *, {_tier('risk_score')} AS risk_tier FROM (
    SELECT t.user_id, t.day, t.role, t.split, t.is_malicious, t.scenario_id, f.score AS isolation_forest_score, p.score AS peer_group_score,
           0.5 * f.score + 0.5 * p.score AS risk_score
    FROM feat t JOIN fscore f ON f.user_id = t.user_id AND f.day = t.day JOIN pscore p ON p.user_id = t.user_id AND p.day = t.day)"""
VIEWS["top4"] = """
  SELECT user_id, day, list({'feature': feature, 'pct': round_even(pct, 1) + 0.0, 'z': round_even(z, 2) + 0.0, 'capped': abs(z) > 15,
           'direction': CASE WHEN z > 0 THEN 'above peer norm' ELSE 'below peer norm' END} ORDER BY place) AS tops
  FROM contrib WHERE place < 4 GROUP BY user_id, day"""


VIEWS["fheld"] = "SELECT user_id, day, CAST(is_malicious AS INTEGER) AS y, risk_score AS s FROM risks WHERE split = 'test'"
VIEWS["fcurve"], VIEWS["ftopk"] = _curve("fheld"), _topk("fheld")
VIEWS["fdec"] = _dec("risks") + " WHERE split = 'test'"


# ---- lockouts: quarantines by decision, approvals by request, intervals between them
def _lockouts(prefix: str, decided: str) -> None:
    VIEWS[f"{prefix}quar"] = f"""
  SELECT user_id, day, CAST(day - DATE '1970-01-01' AS BIGINT) AS id, CAST(day + 1 AS TIMESTAMP) AS t_at,
         CASE WHEN action = 'auto_quarantined' THEN 'tier Critical, scenario ' || coalesce(scenario_id, 'unnamed')
              ELSE 'tier High, challenge failed' END AS reason
  FROM {decided} WHERE action LIKE '%quarantined%'"""
    VIEWS[f"{prefix}free"] = f"""
  SELECT id, t_at, user_id, approver FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, seg ORDER BY t_at, id) AS rn FROM (
      SELECT a.*, (SELECT max(q.id) FROM {prefix}quar q WHERE q.user_id = a.user_id
                   AND (q.t_at < a.t_at OR (q.t_at = a.t_at AND q.id <= a.id))) AS seg
      FROM asks a WHERE approver <> '' AND approver <> CAST(user_id AS VARCHAR)) WHERE seg IS NOT NULL) WHERE rn = 1"""
    VIEWS[f"{prefix}lock"] = f"""
  SELECT l.*, r.t_at AS locked_until, r.approver AS released_by FROM (
    SELECT user_id, request_id, min(t_at) AS locked_from, count(*) AS n_quarantines, max(id) AS quarantine_id, arg_max(reason, id) AS reason
    FROM (SELECT q.*, (SELECT min(r.id) FROM {prefix}free r WHERE r.user_id = q.user_id
                       AND (r.t_at > q.t_at OR (r.t_at = q.t_at AND r.id >= q.id))) AS request_id FROM {prefix}quar q)
    GROUP BY user_id, request_id) l LEFT JOIN {prefix}free r ON r.id = l.request_id"""


_lockouts("s", "dec")
_lockouts("f", "fdec")
VIEWS["frevoked"] = """
  SELECT user_id, day, '["' || string_agg(lease_id, '","' ORDER BY lease_id) || '"]' AS ids FROM (
    SELECT q.user_id, q.day, substr(sha256('resume|' || r.id), 1, 16) AS lease_id FROM fquar q JOIN ffree r ON r.user_id = q.user_id
      AND r.t_at < q.t_at AND q.t_at <= r.t_at + INTERVAL 300 SECOND) GROUP BY ALL"""
VIEWS["flease"] = f"""
  SELECT d.*, e.secret_id, substr(sha256('lease|' || d.user_id || '|' || d.day || ' 00:00:00'), 1, 16) AS lease_id, coalesce(r.ids, '[]') AS revoked,
    '[' || array_to_string(list_transform(tops, lambda x: '{{"direction":"' || x.direction || '","feature":"' || x.feature ||
      '","pct_contribution":' || {_num('x.pct')} || ',"z_capped_for_display":' || x.capped || ',"z_score":' || {_num('x.z')} || '}}'), ',') || ']' AS tops_text
  FROM fdec d LEFT JOIN ent e USING (role) JOIN top4 t ON t.user_id = d.user_id AND t.day = d.day
  LEFT JOIN frevoked r ON r.user_id = d.user_id AND r.day = d.day"""
VIEWS["ffan"] = _fan("flease", "isolation_forest_score", "peer_group_score", "tops_text", "revoked")

# ---- the lease ledger as audit events
VIEWS["named"] = """
  SELECT g.*, coalesce(d.role, 'Unknown') AS role, e.secret_id FROM grants g LEFT JOIN dir d USING (user_id) LEFT JOIN ent e ON e.role = d.role"""
VIEWS["tried"] = """
  SELECT t.id, t.t_at, t.lease_id, t.user_id, n.secret_id,
    CASE WHEN s.revoked < t.id THEN 'revoked' WHEN s.redeemed < t.id THEN 'already_redeemed' WHEN t.t_at > s.expires_at THEN 'expired' ELSE 'redeemed' END AS outcome
  FROM tries t JOIN state s ON s.lease_id = t.lease_id JOIN named n ON n.lease_id = t.lease_id"""
VIEWS["levent"] = f"""
  SELECT user_id, issued_at AS t_at, lease_id AS id, 'lease_issued' AS event_type,
    '{{"expires_at":"' || strftime(expires_at, '%Y-%m-%d %H:%M:%S') || '","lease_id":"' || lease_id || '","reason":"granted on request","role":"' || role ||
    '","secret_id":' || {_SECRET} || ',"ttl_seconds":' || CAST((epoch_us(expires_at) - epoch_us(issued_at)) // 1000000 AS BIGINT) || ',"user":"' || user_id || '"}}' AS payload FROM named
  UNION ALL SELECT user_id, t_at, id, 'lease_redeemed', '{{"lease_id":"' || lease_id || '","secret_id":' || {_SECRET} || ',"user":"' || user_id || '"}}'
    FROM tried WHERE outcome = 'redeemed'
  UNION ALL SELECT user_id, t_at, id, 'lease_redeem_denied', '{{"cause":"' || outcome || '","lease_id":"' || lease_id || '"}}' FROM tried WHERE outcome <> 'redeemed'
  UNION ALL SELECT s.user_id, x.t_at, x.id, 'lease_revoked', '{{"lease_id":"' || x.lease_id || '","reason":"withdrawn' ||
    CASE WHEN s.revoked = x.id THEN '' ELSE ', no effect' END || '"}}' FROM singles x JOIN state s ON s.lease_id = x.lease_id
  UNION ALL SELECT b.user_id, b.t_at, b.id, 'leases_revoked_bulk', '{{"lease_ids":["' || string_agg(s.lease_id, '","' ORDER BY s.issued_at, s.lease_id) ||
    '"],"reason":"all leases withdrawn","user":"' || b.user_id || '"}}' FROM bulks b JOIN state s ON s.revoked = b.id GROUP BY b.user_id, b.t_at, b.id"""
VIEWS["lentry"] = """
  SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY t_at, id) - 1 AS seq
  FROM (SELECT *, strftime(t_at, '%Y-%m-%d %H:%M:%S') AS event_time,
          CAST(t_at AS DATE) || '/' || CAST('0x' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 4) AS INTEGER) % 4 AS chain_id FROM levent)"""
VIEWS["lentry_chain"] = _chain("lentry")


# views read by several others are computed once
ONCE = {"act", "ud", "peak", "fold", "feat", "melt", "zs", "pair", "scored", "held", "entry", "ev", "latest", "tries",
        "singles", "bulks", "quars", "asks", "resumed", "rolestat", "covs", "inv", "dist", "bicount", "head", "dayhead", "state", "fgrid", "fsize",
        "fkept", "fsample", "fraw", "risks", "dec", "fdec", "lentry", "tried", "squar", "sfree", "fquar", "ffree", *(f"f{k}{n}" for k in "lnd" for n in range(LEVELS + 2))}


def _needs(text: str) -> set[str]:
    direct = {v for v in VIEWS if re.search(rf"\b(?:FROM|JOIN|,)\s+{v}\b", text)}
    return direct


def _sql(body: str) -> str:
    wanted, todo = set(), [body]
    while todo:
        for v in _needs(todo.pop()) - wanted:
            wanted.add(v)
            todo.append(VIEWS[v])
    parts = [f"{v} AS {'MATERIALIZED ' if v in ONCE else ''}({VIEWS[v]})" for v in VIEWS if v in wanted]
    if not parts:
        return body
    recursive = "RECURSIVE " if wanted & {"entry_chain", "head_chain", "dayhead_chain", "lentry_chain", "solve"} else ""
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + body


def _r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n.split('.')[-1]}" for n in names)


DAY = "CAST(day AS VARCHAR) AS day"
KEY = f"user_id, {DAY}"
SCORED = (f"{KEY}, role, split, {_r('risk_score')}, risk_tier, CAST(is_malicious AS BIGINT) AS is_malicious")
ACTIVITY = (f"user_id, event_id, epoch_us(ts) AS ts, {DAY}, source, pc, activity, device_id, filename, {_r('size_mb')}, "
            f"CAST(to_removable_media AS BIGINT) AS to_removable_media, url, domain, category, {_r('upload_mb')}, "
            "to_domain_type, CAST(attachments AS BIGINT) AS attachments")
_DRILL = "SELECT e.chain_id, e.seq, '%s' AS error FROM entry e JOIN len l ON l.chain_id = e.chain_id WHERE %s"

def _report(held: str, curve: str, topk: str) -> str:
    tops = ", ".join(
        f"round_even((SELECT hits / greatest(p, 1) FROM {topk} WHERE round(share, 2) = 0.0{s}), 3) + 0.0 AS recall_top{s}pct, "
        f"round_even((SELECT hits / k FROM {topk} WHERE round(share, 2) = 0.0{s}), 3) + 0.0 AS precision_top{s}pct" for s in (1, 2, 5))
    return f"""SELECT h.n AS n_sessions, CAST(h.p AS BIGINT) AS n_malicious_labeled,
          '1:' || CAST(round_even((h.n - h.p) / greatest(h.p, 1), 0) AS BIGINT) AS imbalance_ratio,
          round_even(a.roc, 4) + 0.0 AS roc_auc, round_even(b.ap, 4) + 0.0 AS pr_auc, {tops}
        FROM (SELECT count(*) AS n, sum(y) AS p FROM {held}) h, (
          SELECT (sum(y * r) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS roc
          FROM (SELECT y, avg(rn) OVER (PARTITION BY s) AS r FROM (SELECT y, s, row_number() OVER (ORDER BY s) AS rn FROM {held}))) a, (
          SELECT sum(pos / p * cum_pos / cum_n) AS ap FROM {curve}, (SELECT sum(y) AS p FROM {held})) b"""


BODIES: dict[str, str] = {
    "q_activity_union": f"SELECT {ACTIVITY}, CAST(hour(ts) AS BIGINT) AS hour, CAST(isodow(day) - 1 AS BIGINT) AS dow FROM act",
    "q_activity_single_pass": f"SELECT {ACTIVITY} FROM act",
    "q_user_days": f"SELECT {KEY} FROM ud",
    "q_session_duration": f"SELECT {KEY}, {_r('session_duration_min')} FROM fold",
    "q_hosts_used": f"""SELECT {KEY}, pc, row_number() OVER (PARTITION BY user_id, day ORDER BY pc) AS place,
        count(*) OVER (PARTITION BY user_id, day) AS n_pcs_used FROM (SELECT DISTINCT user_id, day, pc FROM act)""",
    "q_devices_used": f"""SELECT {KEY}, device_id, row_number() OVER (PARTITION BY user_id, day ORDER BY device_id) AS place,
        count(*) OVER (PARTITION BY user_id, day) AS n_device_connects
        FROM (SELECT DISTINCT user_id, day, device_id FROM act WHERE device_id IS NOT NULL)""",
    "q_file_stats": f"SELECT {KEY}, n_file_events, {_r('file_volume_mb')}, round(removable_mb, 6) + 0.0 AS export_volume_mb FROM fold",
    "q_http_stats": f"SELECT {KEY}, n_http_events, {_r('http_export_mb')} FROM fold",
    "q_email_stats": f"SELECT {KEY}, n_email_events, {_r('email_volume_mb')}, email_external_count FROM fold",
    "q_sequences": f"""SELECT {KEY}, kind, row_number() OVER (PARTITION BY user_id, day, kind ORDER BY ts, event_id) AS place,
        token FROM tok""",
    "q_hour_histogram": f"SELECT {KEY}, " + ", ".join(
        f"count(*) FILTER (hour(ts) = {h}) AS h{h:02d}" for h in HOURS) + " FROM act GROUP BY user_id, day",
    "q_after_hours": f"SELECT {KEY}, {_r('after_hours_ratio')} FROM fold",
    "q_user_day": f"""SELECT user_id, CAST(day AS VARCHAR) AS day, n_events, n_pcs_used, n_device_connects, n_file_events,
        {_r('file_volume_mb')}, n_http_events, {_r('http_export_mb')}, n_email_events, {_r('email_volume_mb')},
        email_external_count, {_r('session_duration_min')}, round(removable_mb, 6) + 0.0 AS export_volume_mb, role,
        scenario_id, CAST(is_malicious AS BIGINT) AS is_malicious FROM fold JOIN peak USING (user_id, day)""",
    "q_labels": f"SELECT {KEY}, scenario_id, CAST(is_malicious AS BIGINT) AS is_malicious FROM peak",
    "q_volumes": f"""SELECT {KEY}, round(file_volume_mb + email_volume_mb + http_export_mb, 6) + 0.0 AS data_volume_mb,
        round(removable_mb + http_export_mb, 6) + 0.0 AS export_volume_mb FROM fold""",
    "q_entropy": f"SELECT {KEY}, round(entropy(hour(ts)), 6) + 0.0 AS entropy FROM act GROUP BY user_id, day",
    "q_hour_entropy_7d": f"SELECT {KEY}, round(e, 6) + 0.0 AS hour_entropy_7d FROM hour_ent",
    "q_dow_entropy_30d": f"SELECT {KEY}, round(e, 6) + 0.0 AS dow_entropy_30d FROM dow_ent",
    "q_new_flags": f"SELECT {KEY}, CAST(new_host_flag AS BIGINT) AS new_host_flag, CAST(new_device_flag AS BIGINT) AS new_device_flag FROM flag",
    "q_bigrams": "SELECT kind, a, b, n FROM bicount",
    "q_url_rarity": f"SELECT {KEY}, {_r('url_bigram_rarity')} FROM feat",
    "q_file_rarity": f"SELECT {KEY}, {_r('file_bigram_rarity')} FROM feat",
    "q_feature_matrix": f"""SELECT user_id, role, {DAY}, CAST(is_malicious AS BIGINT) AS is_malicious, scenario_id, split,
        {_r(*FEATURES)} FROM feat""",
    "q_robust_baseline": f"SELECT role, n, {_r('baseline', 'mad', 'std', 'scale')} FROM base_role",
    "q_excess_by_role": f"SELECT {KEY}, role, {_r('score', digits=4)} FROM by_role",
    "q_scaler": "SELECT user_id, CAST(day AS VARCHAR) AS day, " + ", ".join(
        f"round(max(CASE WHEN m.i = {i} THEN (m.x - p.mean) / CASE WHEN p.std = 0 THEN 1 ELSE p.std END END), 4) + 0.0 AS {n}"
        for i, n in enumerate(FEATURES)) + " FROM melt m JOIN popstat p ON p.i = m.i GROUP BY user_id, day",
    "q_role_stats": f"SELECT role, n, feature, {_r('mean', 'std', digits=4)} FROM rolestat",
    "q_role_cov": """SELECT a.role, a.feature AS feature_a, b.feature AS feature_b, round(covar_samp(a.x, b.x), 4) + 0.0 AS cov
        FROM melt a JOIN melt b ON a.user_id = b.user_id AND a.day = b.day AND a.i <= b.i WHERE a.split = 'train'
        GROUP BY a.role, a.feature, b.feature""",
    "q_mahalanobis_2d": """SELECT f.user_id, CAST(f.day AS VARCHAR) AS day, round(sqrt(greatest(
          (vv * dx * dx - 2 * uv * dx * dy + uu * dy * dy) / (uu * vv - uv * uv), 0)), 4) + 0.0 AS peer_distance
        FROM (SELECT f.*, f.data_volume_mb - s.mx AS dx, f.after_hours_ratio - s.my AS dy, s.* EXCLUDE (role) FROM feat f JOIN (
          SELECT role, avg(data_volume_mb) AS mx, avg(after_hours_ratio) AS my, var_samp(data_volume_mb) + 1e-3 AS uu,
                 var_samp(after_hours_ratio) + 1e-3 AS vv, covar_samp(data_volume_mb, after_hours_ratio) AS uv
          FROM feat WHERE split = 'train' GROUP BY role) s ON s.role = f.role) f""",
    "q_peer_score": f"""SELECT x.user_id, CAST(x.day AS VARCHAR) AS day, round(x.d, 4) + 0.0 AS peer_distance,
        round({_excess('x.d')}, 4) + 0.0 AS peer_group_score FROM dist x JOIN base_dist b ON b.role = x.role""",
    "q_forest_score": f"SELECT {KEY}, {_r('raw', digits=4)}, round(score, 4) + 0.0 AS isolation_forest_score FROM fscore",
    "q_scored": f"""SELECT f.user_id, CAST(f.day AS VARCHAR) AS day, f.role, f.split, CAST(f.is_malicious AS BIGINT) AS is_malicious, f.scenario_id,
        {_r('isolation_forest_score', 'peer_group_score', 'risk_score', digits=4)}, risk_tier,
        '[' || array_to_string(list_transform(tops, lambda x: '{{"feature":"' || x.feature || '","pct_contribution":' || x.pct || ',"z_score":' || x.z ||
          ',"z_capped_for_display":' || x.capped || ',"direction":"' || x.direction || '"}}'), ',') || ']' AS top_features
        FROM risks f JOIN top4 t ON t.user_id = f.user_id AND t.day = f.day""",
    "q_ensemble": f"SELECT s.user_id, CAST(s.day AS VARCHAR) AS day, round(0.5 * s.risk_score + 0.5 * b.score, 4) + 0.0 AS risk_score "
                  "FROM scored s JOIN by_role b ON b.user_id = s.user_id AND b.day = s.day",
    "q_tiers": f"SELECT {KEY}, {_r('risk_score')}, risk_tier FROM scored",
    "q_compressed_z": """SELECT user_id, CAST(day AS VARCHAR) AS day,
          round(sign(z) * least(abs(z), 1.5 + ln(1 + greatest(abs(z) - 1.5, 0))), 4) + 0.0 AS z
        FROM (SELECT p.user_id, p.day, (p.max_value - r.m) / r.s AS z FROM peak p JOIN (
          SELECT role, avg(max_value) AS m, stddev_pop(max_value) AS s FROM peak WHERE split = 'train' GROUP BY role) r
          ON r.role = p.role)""",
    "q_contributions": f"""SELECT {KEY}, place, feature, round_even(pct, 1) + 0.0 AS pct_contribution, round_even(z, 2) + 0.0 AS z_score,
        CAST(abs(z) > 15 AS BIGINT) AS z_capped_for_display,
        CASE WHEN z > 0 THEN 'above peer norm' ELSE 'below peer norm' END AS direction FROM contrib""",
    "q_role_counts": "SELECT role, count(*) AS n FROM dir GROUP BY role",
    "q_split_counts": "SELECT split, CAST(is_malicious AS BIGINT) AS is_malicious, count(*) AS n FROM peak GROUP BY ALL",
    "q_tier_counts": """SELECT s.split, t.risk_tier, count(x.user_id) AS n FROM (SELECT DISTINCT split FROM peak) s
        CROSS JOIN (VALUES ('Low'), ('Medium'), ('High'), ('Critical')) t(risk_tier)
        LEFT JOIN scored x ON x.split = s.split AND x.risk_tier = t.risk_tier GROUP BY ALL""",
    "q_action_counts": "SELECT action, count(*) AS n FROM dec GROUP BY action",
    "q_fpr": """SELECT split, count(*) AS n, round(avg(CASE WHEN risk_tier IN ('High', 'Critical') THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS fpr_high,
        round(avg(CASE WHEN risk_tier <> 'Low' THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS fpr_medium
        FROM scored WHERE split = 'train' OR NOT is_malicious GROUP BY split""",
    "q_score_curve": f"SELECT {_r('score')}, n, CAST(pos AS BIGINT) AS pos, CAST(cum_n AS BIGINT) AS cum_n, CAST(cum_pos AS BIGINT) AS cum_pos FROM curve",
    "q_roc_auc": """SELECT round((sum(y * r) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) + 0.0 AS roc_auc
        FROM (SELECT y, avg(rn) OVER (PARTITION BY s) AS r FROM (SELECT y, s, row_number() OVER (ORDER BY s) AS rn FROM held))""",
    "q_avg_precision": "SELECT round(sum(pos / p * cum_pos / cum_n), 6) + 0.0 AS pr_auc FROM curve, (SELECT sum(y) AS p FROM held)",
    "q_topk_recall": """SELECT share, k, CAST(hits AS BIGINT) AS hits, round(hits / greatest(p, 1), 6) + 0.0 AS recall_at_k,
        round(hits / k, 6) + 0.0 AS precision_at_k FROM topk""",
    "q_eval_report": _report("held", "curve", "topk"),
    "q_detection_report": _report("fheld", "fcurve", "ftopk"),
    "q_feed": f"""SELECT {DAY}, user_id, role, round(risk_score, 1) + 0.0 AS risk_score, risk_tier,
        CASE action WHEN 'stepup_flagged' THEN 'Step-up flagged' WHEN 'stepup_required_passed' THEN 'Step-up required (passed)'
             WHEN 'quarantined_after_failed_stepup' THEN 'Quarantined (step-up failed)' ELSE 'Auto-quarantined' END AS outcome
        FROM dec WHERE split = 'test' AND risk_tier <> 'Low'""",
    "q_high_risk": f"SELECT {SCORED} FROM scored WHERE risk_tier IN ('High', 'Critical')",
    "q_held_out": f"SELECT {SCORED} FROM scored WHERE split = 'test'",
    "q_top_sessions": f"""SELECT {SCORED} FROM (SELECT * FROM scored WHERE split = 'test'
        ORDER BY risk_score DESC, user_id, day LIMIT 15)""",
    "q_labelled_sessions": f"SELECT {SCORED}, scenario_id FROM scored WHERE is_malicious",
    "q_drilldown": f"""SELECT s.user_id, CAST(s.day AS VARCHAR) AS day, {_r('s.risk_score')}, s.risk_tier, c.place, c.feature,
        round_even(c.pct, 1) + 0.0 AS pct_contribution, round_even(c.z, 2) + 0.0 AS z_score, CAST(abs(c.z) > 15 AS BIGINT) AS z_capped_for_display,
        CASE WHEN c.z > 0 THEN 'above peer norm' ELSE 'below peer norm' END AS direction
        FROM scored s JOIN contrib c ON c.user_id = s.user_id AND c.day = s.day
        WHERE s.split = 'test' AND s.risk_tier <> 'Low' AND c.place < 4""",
    "q_stepup": f"""SELECT {KEY}, CAST(CAST('0x' || substr(sha256(user_id || '|' || day || ' 00:00:00'), 1, 2) AS INTEGER) <= 247
        AS BIGINT) AS passed FROM ud""",
    "q_decision_table": f"""SELECT user_id, role, {DAY}, risk_tier, {_r('risk_score')}, action,
        CAST(risk_tier IN ('Medium', 'High') AS BIGINT) AS stepup_required,
        CASE WHEN risk_tier IN ('Medium', 'High') THEN CAST(pass AS BIGINT) END AS stepup_passed,
        CAST(action LIKE '%quarantined%' AS BIGINT) AS quarantined,
        CASE action WHEN 'stepup_required_passed' THEN 'goes on, logged in detail'
             WHEN 'auto_quarantined' THEN 'locked until a second person approves and a new lease is granted' ELSE '' END AS notes
        FROM dec""",
    "q_policy_run": f"""SELECT {KEY}, CAST(step_no AS BIGINT) AS step_no, CAST(CAST(day + 1 AS DATE) AS VARCHAR) || ' 00:00:00' AS event_time,
        event_type, payload FROM ffan""",
    "q_policy_quarantines": """SELECT user_id, epoch_us(locked_from) AS locked_from, epoch_us(locked_until) AS locked_until, n_quarantines,
        quarantine_id, reason, request_id, released_by FROM slock""",
    "q_policy_locks": """SELECT d.user_id, CAST(d.day AS VARCHAR) AS day, d.action, CAST(l.locked_from IS NOT NULL AS BIGINT) AS locked,
        epoch_us(l.locked_from) AS locked_since
        FROM dec d LEFT JOIN slock l ON l.user_id = d.user_id AND l.locked_from < CAST(d.day + 1 AS TIMESTAMP)
          AND (l.locked_until IS NULL OR l.locked_until >= CAST(d.day + 1 AS TIMESTAMP))""",
    "q_ledger_events": """SELECT user_id, CAST(CAST(t_at AS DATE) AS VARCHAR) AS day, epoch_us(t_at) AS at_us, id AS ord, event_time, event_type, payload FROM lentry""",
    "q_ledger_chain": "SELECT * FROM lentry_chain",
    "q_decision_events": f"SELECT {KEY}, CAST(step_no AS BIGINT) AS step_no, event_time, event_type, payload FROM entry",
    "q_lease_grants": f"""SELECT lease_id, secret_id, user_id, role, {DAY}, 'challenge answered, tier ' || risk_tier AS reason,
        CAST(300 AS BIGINT) AS ttl_seconds, epoch_us(CAST(day + 1 AS TIMESTAMP)) AS issued_at,
        epoch_us(CAST(day + 1 AS TIMESTAMP)) + 300000000 AS expires_at
        FROM lease WHERE action IN ('stepup_flagged', 'stepup_required_passed')""",
    "q_lease_outcomes": """SELECT t.id AS attempt_id, epoch_us(t.t_at) AS at_us, t.lease_id, CASE WHEN s.lease_id IS NULL THEN 'unknown'
          WHEN s.revoked < t.id THEN 'revoked' WHEN s.redeemed < t.id THEN 'already_redeemed'
          WHEN t.t_at > s.expires_at THEN 'expired' ELSE 'redeemed' END AS outcome
        FROM tries t LEFT JOIN state s ON s.lease_id = t.lease_id""",
    "q_single_revokes": """SELECT t.id AS revoke_id, epoch_us(t.t_at) AS at_us, t.lease_id, CAST(coalesce(s.revoked = t.id, false) AS BIGINT) AS effective
        FROM singles t LEFT JOIN state s ON s.lease_id = t.lease_id""",
    "q_bulk_revoke": "SELECT b.id AS bulk_id, b.user_id, s.lease_id FROM bulks b JOIN state s ON s.revoked = b.id",
    "q_live_leases": """SELECT s.lease_id, s.user_id, epoch_us(s.issued_at) AS issued_at, epoch_us(s.expires_at) AS expires_at
        FROM state s LEFT JOIN ev r ON r.event_id = s.redeemed LEFT JOIN ev v ON v.event_id = s.revoked
        WHERE TIMESTAMP '2024-01-16 00:00:00' BETWEEN s.issued_at AND s.expires_at
          AND coalesce(r.ts > TIMESTAMP '2024-01-16 00:00:00', true) AND coalesce(v.ts > TIMESTAMP '2024-01-16 00:00:00', true)""",
    "q_resume_requests": "SELECT request_id, epoch_us(t_at) AS at_us, user_id, approver, quarantine_id, outcome FROM resumed",
    "q_resume_events": """SELECT request_id, user_id, CAST(CAST(t_at AS DATE) AS VARCHAR) AS day, CAST(step_no AS BIGINT) AS step_no,
        strftime(t_at, '%Y-%m-%d %H:%M:%S') AS event_time, event_type, payload FROM resume_fan""",
    "q_quarantine_ledger": "SELECT * FROM qledger",
    "q_active_quarantines": "SELECT * FROM qledger WHERE active = 1",
    "q_first_quarantines": f"""SELECT user_id, role, {DAY}, risk_tier, {_r('risk_score')}, action FROM (
        SELECT * FROM dec WHERE split = 'test' AND action LIKE '%quarantined%' ORDER BY day, user_id LIMIT 10)""",
    "q_quarantine_precision": """SELECT *, round(n_malicious_quarantined / nullif(n_quarantined, 0), 6) + 0.0 AS blended_precision,
          round(n_malicious_critical_only / nullif(n_critical_only, 0), 6) + 0.0 AS critical_only_precision
        FROM (SELECT count(*) AS n_quarantined, count(*) FILTER (is_malicious) AS n_malicious_quarantined,
          count(*) FILTER (action = 'auto_quarantined') AS n_critical_only,
          count(*) FILTER (action = 'auto_quarantined' AND is_malicious) AS n_malicious_critical_only,
          count(*) FILTER (action <> 'auto_quarantined') AS n_escalated_high
          FROM dec WHERE split = 'test' AND action LIKE '%quarantined%')""",
    "q_canonical_rows": f"""SELECT {KEY}, '{{"date":"' || day || ' 00:00:00","risk_score":' || {_NUM} || ',"role":"' || role ||
        '","scenario_id":' || coalesce('"' || scenario_id || '"', 'null') || ',"user":"' || user_id || '"}}' AS payload FROM scored""",
    "q_audit_seq": f"SELECT chain_id, seq, {KEY}, CAST(step_no AS BIGINT) AS step_no, event_type FROM entry",
    "q_hash_chain": "SELECT * FROM entry_chain",
    "q_chain_heads": "SELECT * FROM head_chain UNION ALL SELECT * FROM dayhead_chain",
    "q_verify": "SELECT chain_id, seq, CAST(1 AS BIGINT) AS ok, CAST(NULL AS VARCHAR) AS error FROM entry",
    "q_verify_summary": "SELECT count(*) AS total, count(*) AS verified, CAST(0 AS BIGINT) AS flagged FROM entry",
    "q_tamper_edit": _DRILL % ("hash mismatch", "e.seq = l.m"),
    "q_tamper_delete": _DRILL % ("chain break", "e.seq = l.m + 1"),
    "q_tamper_reorder": _DRILL % ("chain break", "l.m > 0 AND e.seq BETWEEN l.m - 1 AND l.m + 1"),
    "q_tamper_insert": _DRILL % ("chain break", "e.seq = l.m"),
    "q_tail_cut": """SELECT chain_id, n AS entries, nullif(n - 1, 0) AS found_entries, CAST(0 AS BIGINT) AS ok FROM len""",
    "q_audit_search": """SELECT * FROM entry_chain WHERE event_type LIKE '%stepup%' ORDER BY chain_id, seq LIMIT 100""",
    "q_audit_latest": "SELECT * FROM entry_chain ORDER BY chain_id DESC, seq DESC LIMIT 30",
    "q_audit_pick": """SELECT * FROM entry_chain ORDER BY
        CASE WHEN event_type = 'session_scored' AND payload LIKE '%"risk_tier":"Critical"%' THEN 0 ELSE 1 END, chain_id, seq LIMIT 1""",
}

ORACLES: dict[str, str] = {name: _sql(body) for name, body in BODIES.items()}
