"""Independent SQL for the registered queries, for DuckDB over the same tables.

Written from the semantics, with RE2 forms of the patterns and plain windows instead of the sliced
plans.  Every statement reads whole tables.
"""

from __future__ import annotations

# ---- RE2 forms of the normalisers ----------------------------------------------------------------
S = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def _message(x: str) -> str:
    hx = "[0-9a-fA-F]"
    rules = [
        (f"0x{hx}+", "<addr>"),
        (rf"\b{hx}{{8}}-{hx}{{4}}-{hx}{{4}}-{hx}{{4}}-{hx}{{12}}\b", "<uuid>"),
        (r"[\pL\pN_][\pL\pN_.+-]*@[\pL\pN_-]+\.([\pL\pN_.-]*[\pL\pN_])", "<email>"),
        (rf"\b{hx}{{16,}}\b", "<hex>"),
        ("''[^'']*''|\"[^\"]*\"", "<str>"),
        (r"(^|[^\pL\pN_.])\p{Nd}+", r"\1<num>"),
        (f"{S}+", " "),
    ]
    out = _strip(x)
    for pattern, to in rules:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"coalesce({_strip(out)}, '')"


def _function(x: str) -> str:
    f = _strip(x)
    return (
        f"CASE WHEN {x} IS NULL OR {x} = '' THEN '<anonymous>' "
        f"WHEN {f} IN ('?','<anonymous>','<unknown>','eval') OR ends_with({f}, '.<anonymous>') THEN '<anonymous>' "
        f"WHEN starts_with({f}, 'async ') THEN substr({f}, 7) ELSE {f} END"
    )


def _clean(x: str) -> str:
    p = f"replace({_strip(x)}, chr(92), '/')"
    for pattern, flags in (("^[a-z]+://", ""), ("[?#].*$", ""), (r"@\p{Nd}+\.\p{Nd}+\.\p{Nd}+", "g")):
        p = f"regexp_replace({p}, '{pattern}', '', '{flags}')"
    return p


def _anchor(p: str) -> str:
    marks = " ".join(
        f"WHEN strpos({p}, '{m}') > 0 THEN substr({p}, strpos({p}, '{m}') + 1)"
        for m in ("/src/", "/dist/", "/build/", "/lib/", "/app/")
    )
    return (
        f"CASE WHEN starts_with({p}, 'node:') THEN {p} "
        f"WHEN contains({p}, 'node_modules/') THEN regexp_extract({p}, '^.*(node_modules/.*)$', 1) "
        f"{marks} ELSE ltrim({p}, '/') END"
    )


# ---- shared tables -----------------------------------------------------------------------------------
EV = """ev AS (
  SELECT event_id AS seq, epoch_us(ts) AS received_us, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""

DEL = """del AS (
  SELECT seq, received_us, user_id, k, event_type,
    md5(CAST(seq - CASE WHEN seq % 17 = 16 THEN 1 ELSE 0 END AS VARCHAR)) AS event_id,
    CAST(received_us - k * 60000000 AS DOUBLE) / 1e6 AS timestamp,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'fatal' WHEN 'signup' THEN 'warning'
      WHEN 'click' THEN 'info' ELSE 'debug' END AS level,
    'p' || (user_id % 3) AS project,
    CASE WHEN event_type = 'view' AND k % 2 = 0 THEN 'GET /shop/' || (k % 3) END AS transaction,
    CASE WHEN event_type IN ('view','click') THEN
      'Shard db-' || (k % 7) || ' ' || event_type || ' slow ' || md5(CAST(user_id AS VARCHAR)) || ' v1.' || (k % 3) END AS message,
    event_type IN ('error','purchase','signup') AS has_exc,
    event_type IN ('error','purchase') AS has_stack,
    CASE event_type WHEN 'error' THEN 'E' || (k % 2) WHEN 'purchase' THEN 'PaymentError' END AS exc_type,
    CASE WHEN event_type IN ('error','purchase','signup') THEN
      'User ' || user_id || ' saw ''item' || k || ''' at 0x' || left(md5(CAST(k AS VARCHAR)), 8) || ' after ' || (k * 10) ||
      'ms  from u' || user_id || '@x' || k || '.io in s3' END AS exc_value,
    event_type || '/' || CASE event_type WHEN 'error' THEN (k % 2) || '/' || (k % 4)
      WHEN 'purchase' THEN CAST(k % 4 AS VARCHAR) ELSE CAST(k % 3 AS VARCHAR) END AS true_label
  FROM ev)"""

FRAMES = f"""raw_frames AS (
  SELECT seq, 0 AS position, 'handle' AS fn, '/srv/b' || (user_id % 5) || '/src/server/handler.js' AS file, CAST(NULL AS BOOLEAN) AS flag FROM del WHERE has_stack
  UNION ALL
  SELECT seq, 1, CASE WHEN k % 2 = 0 THEN 'async ' ELSE '' END || 'work' || (k % 4), 'src/lib/m' || (k % 4) || '.js?v=' || k, NULL FROM del WHERE has_stack
  UNION ALL
  SELECT seq, 2, 'next', '/h' || user_id || '/node_modules/express@4.' || (k % 3) || '.0/lib/router.js', CASE WHEN k % 2 = 0 THEN false END FROM del WHERE has_stack),
cleaned AS (SELECT *, {_clean("file")} AS path FROM raw_frames),
named AS (SELECT seq, position, {_function("fn")} AS fn, {_anchor("path")} AS module, flag FROM cleaned)"""

DEFAULT_IN_APP = "coalesce(flag, NOT (contains(module,'node_modules/') OR contains(module,'node:internal') OR contains(module,'internal/')))"
CUSTOM_IN_APP = "coalesce(flag, CASE WHEN contains(module,'express') THEN true ELSE NOT contains(module,'src/server/') END)"


def _fp(in_app: str = DEFAULT_IN_APP) -> str:
    return f"""{EV}, {DEL}, {FRAMES},
judged AS (SELECT *, {in_app} AS in_app FROM named),
picked AS (SELECT * FROM judged QUALIFY in_app OR NOT bool_or(in_app) OVER (PARTITION BY seq)),
stacks AS (SELECT seq, list(module || ':' || fn ORDER BY position) AS sigs, list(module ORDER BY position) AS modules,
  arg_max(fn || ' (' || module || ')', position) AS top FROM picked GROUP BY seq),
fp0 AS (SELECT d.*, s.sigs, s.modules, s.top,
  CASE WHEN has_stack THEN 'stacktrace' WHEN has_exc THEN 'type+message' ELSE 'message' END AS kind,
  {_message("CASE WHEN has_exc THEN exc_value ELSE message END")} AS norm
  FROM del d LEFT JOIN stacks s USING (seq)),
fp1 AS (SELECT *, array_to_string(CASE kind
    WHEN 'stacktrace' THEN list_concat(['type:' || coalesce(exc_type, '<none>')], sigs)
    WHEN 'type+message' THEN ['type:' || coalesce(exc_type, '<none>'), 'value:' || norm]
    ELSE ['message:' || norm] END, chr(10)) AS components FROM fp0),
fp AS (SELECT *, sha1(components) AS fingerprint, exc_type AS type,
  CASE kind WHEN 'stacktrace' THEN top WHEN 'type+message' THEN coalesce(exc_type, '<unknown>')
    ELSE coalesce(transaction, '<message>') END AS culprit,
  CASE WHEN exc_type IS NOT NULL THEN exc_type || ': ' || {_strip("exc_value")}
    WHEN message IS NOT NULL THEN left({_strip("message")}, 200) ELSE '<unknown error>' END AS title
  FROM fp1)"""


FP = _fp()
FIRST = f"""{FP},
firsts AS (SELECT * FROM fp QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY received_us, seq) = 1)"""


def _roll(source: str = "firsts", order: str = "received_us, seq", received: str = "received_us") -> str:
    return f"""SELECT project, fingerprint, count(*) AS count, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
  max(CASE WHEN rn = 1 THEN level END) AS level, max(CASE WHEN rn = 1 THEN type END) AS type,
  max(CASE WHEN rn = 1 THEN culprit END) AS culprit, max(CASE WHEN rn = 1 THEN title END) AS title,
  max(CASE WHEN rn = 1 THEN event_id END) AS sample_event_id,
  max(CASE WHEN rn = 1 THEN {received} END) AS first_received_us, max(CASE WHEN rn = 1 THEN seq END) AS first_seq
  FROM (SELECT *, row_number() OVER (PARTITION BY project, fingerprint ORDER BY {order}) AS rn FROM {source})
  GROUP BY project, fingerprint"""


ISS = f"""{FIRST},
roll AS ({_roll()}),
iss AS (SELECT *, row_number() OVER (ORDER BY first_received_us, first_seq) AS id FROM roll)"""

CHANGES = """changes AS (SELECT user_id % 60 + 1 AS issue_id,
  CASE k % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN 'ignored' WHEN 2 THEN 'unresolved' WHEN 3 THEN 'resolved' ELSE 'closed' END AS status,
  seq AS change_seq FROM ev)"""
LISTED = f"""{ISS}, {CHANGES},
latest AS (SELECT issue_id, arg_max(status, change_seq) AS status FROM changes
  WHERE status IN ('unresolved','resolved','ignored') GROUP BY issue_id),
listed AS (SELECT id, fingerprint, project, level, type, culprit, title, coalesce(l.status, 'unresolved') AS status,
  first_seen, last_seen, count, sample_event_id FROM iss LEFT JOIN latest l ON l.issue_id = iss.id)"""

W = 86_400_000_000
N = 8
ALERTS = f"""{ISS},
evals AS (SELECT f.seq, f.received_us, f.event_id, f.fingerprint, o.project AS ip, o.fingerprint AS ifp,
  f.seq = o.seq AS accepted FROM fp f JOIN firsts o USING (event_id)),
counted AS (SELECT *, CAST(sum(CASE WHEN accepted THEN 1 ELSE 0 END) OVER (PARTITION BY ip, ifp ORDER BY received_us
  RANGE BETWEEN {W} PRECEDING AND CURRENT ROW) AS BIGINT) AS c FROM evals),
lagged AS (SELECT *, lag(c) OVER (PARTITION BY ip, ifp ORDER BY received_us, seq) AS pc FROM counted),
new_alerts AS (SELECT first_received_us AS received_us, first_seq AS seq, 1 AS rule_order, 'new_issue' AS rule, id AS issue_id,
  project, title, 'first occurrence of this fingerprint' AS reason, CAST(first_received_us AS DOUBLE) / 1e6 AS "at" FROM iss),
crossed AS (SELECT l.received_us, l.seq, 2 AS rule_order, 'threshold' AS rule, i.id AS issue_id, i.project, i.title,
  c || ' events in 86400s (>= {N})' AS reason, CAST(l.received_us AS DOUBLE) / 1e6 AS "at"
  FROM lagged l JOIN iss i ON i.project = l.ip AND i.fingerprint = l.ifp WHERE c >= {N} AND (pc IS NULL OR pc < {N})),
feed AS (SELECT * FROM new_alerts UNION ALL SELECT * FROM crossed)"""

# ---- validation: what the planted defects must lead to -------------------------------------------------
BROKEN = f"""{FP}, docs AS (SELECT *, seq % 29 AS broken, seq % 3 = 0 AS lean FROM fp),
reasoned AS (SELECT *, CASE broken WHEN 1 THEN 'event_id' WHEN 2 THEN 'level' WHEN 3 THEN 'timestamp' WHEN 4 THEN 'payload'
  WHEN 5 THEN 'type:project' WHEN 6 THEN 'json' WHEN 8 THEN 'type:release' ELSE '' END AS reason FROM docs)"""

# ---- raw logs --------------------------------------------------------------------------------------------
RAW = f"""{EV}, rawlog AS (
  SELECT *, '/srv/b' || (user_id % 5) AS root, event_type IN ('view','click') AS is_message,
    CASE WHEN k % 4 = 0 THEN '' ELSE 'TypeError' END AS name,
    CASE WHEN k % 11 <> 0 THEN event_type || ' saw item' || k END AS message FROM ev),
spots AS (SELECT *, ':' || (user_id + 1) || ':' || (k + 1) AS spot FROM rawlog),
stacked AS (SELECT *, CASE WHEN NOT is_message AND k % 7 <> 0 THEN
    'E: saw item' || k || chr(10) ||
    '    at next (/h/node_modules/express@4.' || (k % 3) || '.0/lib/router.js' || spot || ')' || chr(10) ||
    '    at ' || CASE WHEN k % 2 = 0 THEN 'async ' ELSE '' END || 'work' || (k % 4) || ' (' ||
      CASE WHEN k % 3 = 0 THEN 'file://' ELSE '' END || root || '/src/lib/m' || (k % 4) || '.js' || spot || ')' || chr(10) ||
    CASE WHEN k % 5 = 0 THEN '    at ' || root || '2/boot.js' || spot
      ELSE '    at Object.<anonymous> (' || root || '2/boot.js' || spot || ')' END || chr(10) ||
    '    at handle (src/server/handler.js' || spot || ')' || chr(10) || '    at native code' || chr(10) ||
    '    at processTicksAndRejections (node:internal/process/task_queues' || spot || ')' END AS stack FROM spots),
lines AS (SELECT seq, root, unnest(string_split(stack, chr(10))) AS line, generate_subscripts(string_split(stack, chr(10)), 1) AS n FROM stacked WHERE stack IS NOT NULL),
hits AS (SELECT seq, root, n, regexp_extract(line, '^\\s*at\\s+(?:(.+?)\\s+\\()?(.+?):([0-9]+):([0-9]+)\\)?\\s*$', ['fn','file','line','col']) AS m
  FROM lines WHERE regexp_matches(line, '^\\s*at\\s+(?:(.+?)\\s+\\()?(.+?):([0-9]+):([0-9]+)\\)?\\s*$')),
parsed AS (SELECT seq, root, row_number() OVER (PARTITION BY seq ORDER BY n DESC) - 1 AS position, trim(m.fn) AS fn,
  regexp_replace(trim(m.file), '^file://', '') AS file, CAST(m.line AS BIGINT) AS lineno, CAST(m.col AS BIGINT) AS colno FROM hits),
attrs AS (SELECT seq, position, lineno, colno,
  CASE WHEN fn IN ('', '<anonymous>', 'Object.<anonymous>') THEN '<anonymous>' ELSE fn END AS function,
  CASE WHEN NOT regexp_matches(file, '^(node:|internal/|events\\.js|timers\\.js)') AND starts_with(file, root)
    THEN ltrim(substr(file, length(root) + 1), '/' || chr(92)) ELSE file END AS filename,
  NOT regexp_matches(file, '^(node:|internal/|events\\.js|timers\\.js)') AND NOT contains(file, 'node_modules')
    AND (starts_with(file, root) OR NOT starts_with(file, '/')) AS in_app FROM parsed)"""

LABELS = f"{FP}, pairs AS (SELECT true_label AS t, fingerprint AS p FROM fp)"
SOURCES = "pairs AS (SELECT source AS t, lang AS p FROM documents)"
MEASURES = """cells AS (SELECT t, p, count(*) AS n FROM pairs GROUP BY t, p),
ts AS (SELECT t, sum(n) AS n, count(*) AS width FROM cells GROUP BY t),
ps AS (SELECT p, sum(n) AS n, count(*) AS width FROM cells GROUP BY p),
tot AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM cells),
conf AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS tp,
  (SELECT sum(n * (n - 1) / 2) FROM ps) - (SELECT sum(n * (n - 1) / 2) FROM cells) AS fp,
  (SELECT sum(n * (n - 1) / 2) FROM ts) - (SELECT sum(n * (n - 1) / 2) FROM cells) AS fn,
  (SELECT n * (n - 1) / 2 FROM tot) AS every),
prf0 AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS recall FROM conf),
prf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM prf0),
ent AS (SELECT (SELECT -sum(ts.n / tot.n * ln(ts.n / tot.n)) FROM ts, tot) AS ht, (SELECT -sum(ps.n / tot.n * ln(ps.n / tot.n)) FROM ps, tot) AS hp,
  (SELECT -sum(cells.n / tot.n * ln(cells.n / CAST(ps.n AS DOUBLE))) FROM cells JOIN ps ON ps.p IS NOT DISTINCT FROM cells.p, tot) AS ht_p,
  (SELECT -sum(cells.n / tot.n * ln(cells.n / CAST(ts.n AS DOUBLE))) FROM cells JOIN ts ON ts.t IS NOT DISTINCT FROM cells.t, tot) AS hp_t),
hc AS (SELECT CASE WHEN ht = 0 THEN 1.0 ELSE 1 - ht_p / ht END AS h, CASE WHEN hp = 0 THEN 1.0 ELSE 1 - hp_t / hp END AS c, ht, hp FROM ent),
hcv AS (SELECT *, CASE WHEN h + c = 0 THEN 0.0 ELSE 2 * h * c / (h + c) END AS v FROM hc)"""
CONFUSION = """CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(every - tp - fp - fn AS DOUBLE) AS tn"""
REPORT = f"""SELECT CAST((SELECT n FROM tot) AS BIGINT) AS events, (SELECT count(*) FROM ts) AS true_groups, (SELECT count(*) FROM ps) AS predicted_clusters,
  round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, round(h, 4) AS homogeneity, round(c, 4) AS completeness,
  round(v, 4) AS v_measure, {CONFUSION},
  (SELECT count(*) FROM ps WHERE width > 1) AS false_merges, (SELECT count(*) FROM ts WHERE width > 1) AS false_splits,
  round((SELECT n FROM tot) / (SELECT count(*) FROM ps), 4) AS dedupe_ratio FROM prf, hcv"""


def _summary(table: str, value: str, keys: str, rounding: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    prefix = f"{keys}, " if keys else ""

    def rank(p: str) -> str:
        return rounding.format(f"CAST({p} AS DOUBLE) * (n - 1)")

    picks = ", ".join(
        f"round(max(CASE WHEN rn - 1 = {rank(p)} THEN v END), 4) AS {name}"
        for name, p in (("p50", "0.5"), ("p95", "0.95"), ("p99", "0.99"))
    )
    return f"""WITH r AS (SELECT {prefix}{value} AS v, row_number() OVER ({part} ORDER BY {value}) AS rn, count(*) OVER ({part}) AS n FROM {table} WHERE {value} IS NOT NULL)
SELECT {prefix}max(n) AS n, round(min(v), 4) AS min, {picks}, round(max(v), 4) AS max, round(avg(v), 4) AS mean FROM r {group}"""


DELIVERY_FIELDS = "event_id, seq, received_us, project, fingerprint, level, timestamp, type, culprit, title"
ROLL_FIELDS = (
    "project, fingerprint, count, first_seen, last_seen, level, type, culprit, title, sample_event_id, "
    "first_received_us, first_seq"
)
NEWEST = """SELECT *, row_number() OVER (PARTITION BY project, fingerprint ORDER BY timestamp DESC, event_id) AS position FROM firsts"""
ISSUE_FIELDS = "id, fingerprint, project, level, type, culprit, title, status, first_seen, last_seen, count, sample_event_id"
FEED_FIELDS = "received_us, seq, CAST(rule_order AS BIGINT) AS rule_order, rule, issue_id, project, title, reason, \"at\""

_LATE = f"""{FP},
late AS (SELECT * REPLACE (CAST(trunc(4000000000000000 - timestamp * 1e6) AS BIGINT) AS received_us) FROM fp),
lfirst AS (SELECT * FROM late QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY received_us, seq) = 1)"""

ORACLE: dict[str, str] = {
    "envelope_source": f"""WITH {BROKEN} SELECT seq, event_id, timestamp, 'node' AS platform, level,
      CASE WHEN broken = 7 AND lean THEN 'default' ELSE project END AS project, 'app@1.' || (k % 3) AS release, message, exc_type, exc_value,
      CAST(CASE WHEN has_stack THEN 3 ELSE 0 END AS BIGINT) AS frames, CASE WHEN NOT lean THEN k END AS extra_k,
      CASE WHEN NOT lean THEN CAST(user_id AS VARCHAR) END AS tag_user FROM reasoned WHERE reason = ''""",
    "event_sink": f"""WITH {ISS} SELECT f.event_id, i.id AS issue_id, f.fingerprint, f.project, f.level, f.timestamp,
      CAST(f.received_us AS DOUBLE) / 1e6 AS received_at, f.message, f.exc_type, strftime(make_timestamp(f.received_us), '%Y-%m-%d') AS day
      FROM firsts f JOIN iss i ON i.project = f.project AND i.fingerprint = f.fingerprint""",
    "issue_upsert_incremental": f"WITH {ISS} SELECT {ROLL_FIELDS} FROM roll",
    "alert_outbox": f"""WITH {ALERTS} SELECT received_us, seq, CAST(rule_order AS BIGINT) AS rule_order, 'http://sink/hook' AS url,
      rule, issue_id, project, title, reason, "at" FROM feed""",
    "envelope_defaults": f"""WITH {BROKEN} SELECT seq, CASE WHEN broken <> 6 THEN 'node' END AS platform,
      CASE broken WHEN 2 THEN 'explode' WHEN 6 THEN NULL ELSE level END AS level,
      CASE WHEN broken IN (5, 6) THEN NULL WHEN broken = 7 AND lean THEN 'default' ELSE project END AS project,
      CAST(CASE WHEN broken = 6 THEN NULL WHEN lean THEN 0 ELSE 1 END AS BIGINT) AS tags,
      CAST(CASE WHEN broken <> 6 THEN 0 END AS BIGINT) AS breadcrumbs,
      CASE WHEN broken = 6 THEN NULL WHEN lean THEN '{{}}' ELSE '{{"k":' || k || '}}' END AS extra FROM docs""",
    "validate_event_id": f"WITH {BROKEN} SELECT seq, broken NOT IN (1, 6) AS valid FROM docs",
    "validate_level": f"WITH {BROKEN} SELECT seq, broken NOT IN (2, 6) AS valid FROM docs",
    "validate_timestamp": f"WITH {BROKEN} SELECT seq, broken NOT IN (3, 6) AS valid FROM docs",
    "validate_payload": f"WITH {BROKEN} SELECT seq, broken NOT IN (4, 6) AS valid FROM docs",
    "validate_types": f"""WITH {BROKEN} SELECT seq, CASE broken WHEN 5 THEN 'project' WHEN 8 THEN 'release' WHEN 6 THEN 'json' ELSE '' END AS wrong
      FROM docs""",
    "validation_report": f"""WITH {BROKEN} SELECT CASE WHEN reason = '' THEN 'valid' ELSE reason END AS reason, count(*) AS rows
      FROM reasoned GROUP BY 1""",
    "issue_title": f"WITH {FP} SELECT seq, type, title FROM fp",
    "culprit": f"WITH {FP} SELECT seq, culprit FROM fp",
    "frame_in_app": f"WITH {FP} SELECT seq, CAST(position AS BIGINT) AS position, in_app FROM judged",
    "select_frames": f"WITH {_fp(CUSTOM_IN_APP)} SELECT seq, coalesce(array_to_string(modules, chr(10)), '') AS modules FROM fp",
    "frame_signature": f"WITH {FP} SELECT seq, CAST(position AS BIGINT) AS position, module || ':' || fn AS signature FROM named",
    "fingerprint": f"WITH {FP} SELECT seq, fingerprint, kind, components FROM fp",
    "fingerprint_kind": f"""WITH {FP} SELECT kind, count(*) AS deliveries, count(DISTINCT fingerprint) AS fingerprints FROM fp GROUP BY kind""",
    "fingerprint_custom_rules": f"WITH {_fp(CUSTOM_IN_APP)} SELECT seq, fingerprint, culprit FROM fp",
    "normalize_message": f"""SELECT 'd' || doc_id AS key, {_message("text")} AS normalized FROM documents
      UNION ALL SELECT 'c' || conv_id || '/' || turn, {_message("text")} FROM conversations""",
    "normalize_function": f"""WITH {EV}, named AS (SELECT seq, CASE k % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' eval '
      WHEN 3 THEN 'Object' || k || '.<anonymous>' WHEN 4 THEN 'async eval' WHEN 5 THEN ' ' || chr(9) || ' ' WHEN 6 THEN '?'
      WHEN 7 THEN ' async run' || user_id || chr(10) ELSE event_type || k END AS name FROM ev)
      SELECT seq, {_function("name")} AS normalized FROM named""",
    "normalize_module": f"""WITH {EV}, {DEL}, {FRAMES}, u AS (SELECT 'page' || page_id AS key, {_clean("url")} AS path FROM pages)
      SELECT key, {_anchor("path")} AS normalized FROM u UNION ALL SELECT 'frame' || seq || '/' || position, module FROM named""",
    "sql_normalize_message": f"""WITH t AS (SELECT doc_id, {_message("text")} AS message, {_function("source")} AS function,
      {_clean("'/srv/src/' || source || '/' || lang || '.js?v=' || doc_id")} AS path FROM documents)
      SELECT doc_id, message, function, {_anchor("path")} AS module, sha1('message:' || chr(10) || message) AS digest FROM t""",
    "new_events_anti_join": f"""WITH {FP}, mid AS (SELECT floor((min(received_us) + max(received_us)) / 2) AS m FROM fp),
      late AS (SELECT * FROM fp, mid WHERE received_us >= m AND event_id NOT IN (SELECT event_id FROM fp, mid WHERE received_us < m))
      SELECT event_id, seq, project, fingerprint FROM late QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY received_us, seq) = 1""",
    "events_with_issue": f"""WITH {ISS} SELECT f.seq, f.event_id, f.project, f.fingerprint, i.id AS issue_id, i.count AS issue_count
      FROM firsts f JOIN iss i ON i.project = f.project AND i.fingerprint = f.fingerprint""",
    "issue_detail": f"""WITH {LISTED}, newest AS ({NEWEST}) SELECT l.id, l.title, l.status, l.count, n.position, n.event_id, n.timestamp, n.message
      FROM listed l JOIN newest n ON n.project = l.project AND n.fingerprint = l.fingerprint WHERE n.position <= 50""",
    "issue_detail_one": f"""WITH {LISTED}, newest AS ({NEWEST}) SELECT l.id, l.title, n.position, n.event_id, n.timestamp, n.message
      FROM listed l JOIN newest n ON n.project = l.project AND n.fingerprint = l.fingerprint WHERE n.position <= 50 AND l.id = 1""",
    "issue_status": f"WITH {LISTED} SELECT id, project, fingerprint, status FROM listed",
    "status_rejects": f"""WITH {ISS}, {CHANGES}, judged_changes AS (SELECT c.*, CASE WHEN status NOT IN ('unresolved','resolved','ignored') THEN 'invalid status'
      WHEN i.id IS NULL THEN 'issue not found' END AS reject FROM changes c LEFT JOIN iss i ON i.id = c.issue_id)
      SELECT issue_id, status, change_seq, reject FROM judged_changes WHERE reject IS NOT NULL""",
    "dedupe_events": f"WITH {FIRST} SELECT {DELIVERY_FIELDS} FROM firsts",
    "dedupe_wide": f"WITH {FIRST} SELECT seq, event_id, project, level, message FROM firsts",
    "issue_rollup": f"WITH {ISS} SELECT {ROLL_FIELDS} FROM roll",
    "issue_ids": f"WITH {ISS} SELECT id, project, fingerprint, sample_event_id FROM iss",
    "store_counts": f"WITH {ISS} SELECT CAST(sum(count) AS BIGINT) AS events, count(*) AS issues FROM roll",
    "dedupe_ratio": f"""WITH {ISS} SELECT project, CAST(sum(count) AS BIGINT) AS events, count(*) AS issues,
      round(CAST(sum(count) AS DOUBLE) / count(*), 2) AS dedupe_ratio FROM roll GROUP BY project
      UNION ALL SELECT '*', CAST(sum(count) AS BIGINT), count(*), round(CAST(sum(count) AS DOUBLE) / count(*), 2) FROM roll""",
    "window_count_asof": f"""WITH {ISS}, recent AS (SELECT project, fingerprint, count(*) AS n FROM firsts
      WHERE received_us >= (SELECT max(received_us) FROM firsts) - {W} GROUP BY project, fingerprint)
      SELECT id AS issue_id, coalesce(n, 0) AS window_count FROM iss LEFT JOIN recent USING (project, fingerprint)""",
    "delivery_results": f"""WITH {ALERTS}, fired AS (SELECT seq, string_agg(rule, ',' ORDER BY rule) AS rules FROM feed GROUP BY seq)
      SELECT e.seq, e.event_id AS id, i.id AS issue_id, e.fingerprint, e.seq = i.first_seq AS new_issue, coalesce(rules, '') AS alerts
      FROM evals e JOIN iss i ON i.project = e.ip AND i.fingerprint = e.ifp LEFT JOIN fired ON fired.seq = e.seq""",
    "alerts_new_issue": f"WITH {ALERTS} SELECT {FEED_FIELDS} FROM new_alerts",
    "rolling_issue_count": f"""WITH {ALERTS} SELECT ip AS issue_project, ifp AS issue_fingerprint, seq, accepted, c AS window_count,
      pc AS previous_count FROM lagged""",
    "alerts_threshold": f"WITH {ALERTS} SELECT {FEED_FIELDS} FROM crossed",
    "alert_feed": f"WITH {ALERTS} SELECT {FEED_FIELDS} FROM feed ORDER BY received_us, seq, rule_order",
    "alerts_threshold_off": f"WITH {ALERTS} SELECT {FEED_FIELDS} FROM new_alerts ORDER BY received_us, seq",
    "issues_filtered": f"WITH {LISTED} SELECT {ISSUE_FIELDS} FROM listed WHERE project = 'p1' AND level = 'error' AND status = 'resolved'",
    "issues_sorted": f"WITH {LISTED} SELECT {ISSUE_FIELDS} FROM listed ORDER BY count DESC, id",
    "issues_page": f"""WITH {LISTED}, one_page AS (SELECT {ISSUE_FIELDS} FROM listed ORDER BY first_seen, id LIMIT 10 OFFSET 5)
      SELECT *, count(*) OVER () AS page_rows FROM one_page""",
    "issue_by_id": f"WITH {LISTED} SELECT {ISSUE_FIELDS} FROM listed WHERE id = 7",
    "issue_recent_events": f"WITH {FIRST}, newest AS ({NEWEST}) SELECT project, fingerprint, position, event_id, timestamp FROM newest WHERE position <= 50",
    "payload_roundtrip": f"""WITH {EV}, {DEL} SELECT seq, event_id, timestamp, level, message, exc_value, CASE WHEN has_stack THEN k + 20 END AS top_line,
      CAST(user_id AS VARCHAR) AS tag_user, k AS extra_k FROM del""",
    "issue_overview": f"""WITH {LISTED} SELECT id, status, count, level, project, title, culprit FROM listed ORDER BY last_seen DESC, id LIMIT 100""",
    "pair_confusion": f"WITH {LABELS}, {MEASURES} SELECT {CONFUSION} FROM conf",
    "pair_prf": f"WITH {LABELS}, {MEASURES} SELECT round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM prf",
    "merge_split_counts": f"""WITH {LABELS}, {MEASURES} SELECT (SELECT count(*) FROM ps WHERE width > 1) AS false_merges,
      (SELECT count(*) FROM ts WHERE width > 1) AS false_splits""",
    "split_groups": f"""WITH {FP} SELECT split_part(true_label, '/', 1) AS true_label, count(DISTINCT fingerprint) AS clusters FROM fp
      GROUP BY 1 HAVING count(DISTINCT fingerprint) > 1 ORDER BY 1""",
    "merged_clusters": f"""WITH {SOURCES}, {MEASURES} SELECT c.p AS pred_label, c.t AS true_label, ps.width AS labels
      FROM cells c JOIN ps ON ps.p IS NOT DISTINCT FROM c.p WHERE ps.width > 1 ORDER BY 1, 2""",
    "merged_clusters_nulls": f"""WITH pairs AS (SELECT source AS t, nullif(lang, 'en') AS p FROM documents), {MEASURES}
      SELECT c.p AS pred_label, c.t AS true_label, ps.width AS labels
      FROM cells c JOIN ps ON ps.p IS NOT DISTINCT FROM c.p WHERE ps.width > 1 ORDER BY 1, 2""",
    "label_entropy": f"WITH {LABELS}, {MEASURES} SELECT round(ht, 9) AS true_entropy, round(hp, 9) AS pred_entropy FROM ent",
    "homogeneity_completeness_v": f"""WITH {SOURCES}, {MEASURES} SELECT round(h, 9) AS homogeneity, round(c, 9) AS completeness,
      round(v, 9) AS v_measure FROM hcv""",
    "eval_report": f"WITH {LABELS}, {MEASURES} {REPORT}",
    "metric_summary": _summary("lineitem", "l_extendedprice", "l_returnflag, l_linestatus", "round_even({}, 0)"),
    "metric_summary_nulls": _summary(
        "(SELECT *, nullif(l_returnflag, 'A') AS flag FROM lineitem)", "l_extendedprice", "flag", "round_even({}, 0)"
    ),
    "metric_summary_halfup": _summary("events", "value", "", "floor({} + 0.5)"),
    "parse_stack": f"WITH {RAW} SELECT seq, position, fn AS function, file, lineno, colno FROM parsed",
    "frame_attributes": f"WITH {RAW} SELECT seq, position, function, filename, lineno, colno, in_app FROM attrs",
    "build_envelopes": f"""WITH {RAW},
      cl AS (SELECT *, {_clean("filename")} AS path FROM attrs), nm AS (SELECT seq, position, in_app, {_anchor("path")} AS module, {_function("function")} AS fn FROM cl),
      pk AS (SELECT * FROM nm QUALIFY in_app OR NOT bool_or(in_app) OVER (PARTITION BY seq)),
      st AS (SELECT seq, list(module || ':' || fn ORDER BY position) AS sigs FROM pk GROUP BY seq),
      nf AS (SELECT seq, count(*) AS frames FROM attrs GROUP BY seq),
      b AS (SELECT r.*, CASE WHEN NOT is_message THEN CASE WHEN name = '' THEN 'Error' ELSE name END END AS exc_type,
        CASE WHEN NOT is_message THEN coalesce(r.message, '') END AS exc_value,
        CASE WHEN is_message THEN r.message END AS msg, st.sigs, nf.frames FROM stacked r LEFT JOIN st USING (seq) LEFT JOIN nf USING (seq))
      SELECT seq, md5('raw' || chr(10) || seq) AS event_id, CAST(received_us AS DOUBLE) / 1e6 AS timestamp,
      CASE WHEN k % 13 = 0 THEN 'warning' ELSE CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'fatal' WHEN 'signup' THEN 'error' ELSE 'info' END END AS level,
      CASE WHEN user_id % 2 = 0 THEN 'p' || (user_id % 3) ELSE 'default' END AS project, msg AS message, exc_type, exc_value,
      CASE WHEN NOT is_message THEN coalesce(frames, 0) END AS frames,
      sha1(CASE WHEN sigs IS NOT NULL THEN array_to_string(list_concat(['type:' || exc_type], sigs), chr(10))
        WHEN NOT is_message THEN 'type:' || exc_type || chr(10) || 'value:' || {_message("exc_value")}
        ELSE 'message:' || {_message("msg")} END) AS fingerprint,
      CASE WHEN exc_type IS NOT NULL THEN CASE WHEN exc_value = '' THEN exc_type ELSE exc_type || ': ' || exc_value END
        WHEN msg IS NOT NULL THEN msg ELSE '<unknown error>' END AS title FROM b""",
    "breadcrumbs_asof": f"""WITH {EV}, c AS (SELECT 'c' || (user_id % 7) AS client, * FROM ev),
      crumbs AS (SELECT client, seq, event_type || ' ' || k AS message, row_number() OVER (PARTITION BY client ORDER BY seq) AS r FROM c WHERE event_type NOT IN ('error','purchase')),
      points AS (SELECT client, seq, event_type IN ('error','purchase') AS is_event,
        count(CASE WHEN event_type NOT IN ('error','purchase') THEN 1 END) OVER (PARTITION BY client ORDER BY seq) AS upto FROM c)
      SELECT p.client, p.seq, count(x.seq) AS n, coalesce(string_agg(x.message, '|' ORDER BY x.seq), '') AS messages
      FROM points p LEFT JOIN crumbs x ON x.client = p.client AND x.r <= p.upto AND x.r > p.upto - 5 WHERE p.is_event GROUP BY p.client, p.seq""",
    "stream_ingest": f"""WITH {BROKEN} SELECT seq, CASE WHEN reason = '' THEN fingerprint ELSE '' END AS fingerprint, reason AS reasons FROM reasoned""",
    "stream_dedupe": f"""WITH {ALERTS} SELECT seq, event_id, fingerprint, accepted, ip AS issue_project, ifp AS issue_fingerprint FROM evals""",
    "stream_rollup": f"WITH {ISS} SELECT {ROLL_FIELDS} FROM roll",
    "stream_alerts": f"WITH {ALERTS} SELECT {FEED_FIELDS} FROM feed",
    "stream_out_of_order": f"WITH {_LATE} {_roll('lfirst')}",
    "store_ingest": f"""WITH {FP}, edge AS (SELECT min(received_us) AS low, (max(received_us) - min(received_us)) // 4 + 1 AS width FROM fp),
      given AS (SELECT fp.*, CASE (received_us - low) // width WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE (received_us - low) // width END AS b FROM fp, edge),
      kept AS (SELECT * FROM given QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY b, received_us, seq) = 1),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY project, fingerprint ORDER BY b, received_us, seq) AS r,
        row_number() OVER (PARTITION BY project, fingerprint ORDER BY received_us, seq) AS first,
        count(*) OVER (PARTITION BY project, fingerprint) AS n FROM kept),
      ids AS (SELECT project, fingerprint, n, row_number() OVER (ORDER BY b, received_us, seq) AS id FROM ranked WHERE r = 1),
      titles AS (SELECT project, fingerprint, title FROM ranked WHERE first = 1)
      SELECT ids.project, ids.fingerprint, ids.n AS count, titles.title, ids.id, ids.n AS events
      FROM ids JOIN titles ON titles.project = ids.project AND titles.fingerprint = ids.fingerprint""",
}
