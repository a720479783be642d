"""The same results in SQL, straight from the driver tables.

Written from the meaning of each query, not from its Spark plan: resource counts,
for one, come from the source columns and never touch JSON.
"""

from __future__ import annotations

from stackquarry import catalog, wording

HAIKU, SONNET, TITAN, LLAMA = catalog.MODEL_PREFERENCE


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# ---- questions and routes ---------------------------------------------------

_METHOD = "CASE {n} % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'DELETE' ELSE 'PATCH' END"
_API = "'api-' || CASE WHEN {k} % 10 = 8 THEN {k} - 5 ELSE {k} END"

_LINES = """lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey AS part, l_suppkey AS supp,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS line_key FROM lineitem)"""

_API_TABLES = f"""apis AS (
  SELECT 'p' || (s_suppkey // 10) AS project, s_suppkey AS pos, 'a' || s_suppkey AS api_id,
         {_API.format(k='s_suppkey')} AS name FROM supplier),
first_api AS (
  SELECT project, wanted, api_id, name FROM (
    SELECT *, row_number() OVER (PARTITION BY project, wanted ORDER BY pos) AS rn
    FROM (SELECT *, name AS wanted FROM apis UNION ALL SELECT *, '' AS wanted FROM apis)) WHERE rn = 1),
route_rows AS (
  SELECT DISTINCT 'a' || l_suppkey AS api_id, l_suppkey AS supp, l_partkey AS part,
         'r' || l_partkey || '-' || (l_orderkey % 3) AS resource_id,
         l_partkey * 3 + l_orderkey % 3 AS pos, '/parts/' || l_partkey AS path,
         {_METHOD.format(n='l_linenumber')} AS method FROM lineitem),
first_route AS (
  SELECT *, CASE (part + supp) % 10 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'fn-' || part || ':live'
            WHEN 3 THEN '' ELSE 'fn-' || resource_id || '-' || method END AS fn
  FROM (SELECT *, row_number() OVER (PARTITION BY api_id, path, method ORDER BY pos) AS rn FROM route_rows)
  WHERE rn = 1)"""

_QUESTIONS = f"""questions AS (
  SELECT line_key AS question_id, 'p' || (supp // 10) AS project,
    CASE l_orderkey % 10
      WHEN 0 THEN 'Which API Lambda handles ' || m || ' /parts/' || part || ' on ghost-' || supp || '?'
      WHEN 1 THEN 'Which Lambda handles ' || m || ' /none/' || part || ' on ' || api || '?'
      WHEN 2 THEN 'Which Lambda handles ' || m || ' /parts/{{id}} on ' || api || '?'
      WHEN 3 THEN 'Which Lambda handles ' || m || ' /parts/' || part || ' on orders-' || supp || '?'
      WHEN 4 THEN 'lambda for ' || lower(m) || '  /parts/' || part || ' IN ' || api || ' gateway'
      ELSE 'Which Lambda handles ' || m || ' /parts/' || part || ' on ' || api || '?' END AS text
  FROM (SELECT *, {_METHOD.format(n='l_linenumber')} AS m, {_API.format(k='supp')} AS api FROM lines)),
parsed AS (
  SELECT *, CASE WHEN contains(lower(text), 'lambda')
                  AND (contains(lower(text), 'api') OR contains(lower(text), 'gateway'))
                 THEN 'api_gateway_lambda' ELSE 'unknown' END AS intent,
    upper(regexp_extract(text, {_text(r'(?i)(GET|POST|PUT|DELETE|PATCH)\s+([/\w-]+)\s+(?:on|in)\s+([\w-]+)')}, 1)) AS method,
    regexp_extract(text, {_text(r'(?i)(GET|POST|PUT|DELETE|PATCH)\s+([/\w-]+)\s+(?:on|in)\s+([\w-]+)')}, 2) AS path,
    regexp_extract(text, {_text(r'(?i)(GET|POST|PUT|DELETE|PATCH)\s+([/\w-]+)\s+(?:on|in)\s+([\w-]+)')}, 3) AS api
  FROM questions)"""

_ROUTE_QUERY = f"""WITH {_LINES}, {_API_TABLES}, {_QUESTIONS},
hits AS (
  SELECT q.question_id, q.project, q.intent, q.method, q.path, q.api, a.api_id, a.name AS api_name, r.fn,
         CASE WHEN q.intent = 'unknown' THEN NULL WHEN a.api_id IS NULL THEN 'api_missing'
              WHEN r.fn IS NULL THEN 'route_missing' ELSE 'found' END AS outcome
  FROM parsed q
  LEFT JOIN first_api a ON q.intent <> 'unknown' AND q.project = a.project AND q.api = a.wanted
  LEFT JOIN first_route r ON a.api_id = r.api_id AND q.path = r.path AND q.method = r.method)"""

API_ROUTE_LOOKUP = f"""{_ROUTE_QUERY}
SELECT question_id, intent, outcome, api_name, api_id,
  CASE WHEN outcome = 'found' THEN path END AS path,
  CASE WHEN outcome = 'found' THEN method END AS method,
  CASE WHEN outcome = 'found' THEN fn END AS lambda_name,
  CASE outcome WHEN 'api_missing' THEN 'API Gateway ''' || api || ''' not found'
    WHEN 'route_missing' THEN 'Path ''' || path || ''' with method ''' || method || ''' not found in API '''
      || api_name || '''' END AS message
FROM hits"""

AVAILABLE_APIS = f"""{_ROUTE_QUERY}
SELECT project, pos, name FROM apis
WHERE project IN (SELECT project FROM hits WHERE outcome = 'api_missing')"""

DISPATCH = f"""WITH {_LINES}, {_API_TABLES},
q AS (
  SELECT 'question ' || line_key AS query, l_orderkey % 4 AS kind, part,
    'p' || (supp // 10) AS project, {_API.format(k='supp')} AS api, {_METHOD.format(n='l_linenumber')} AS method
  FROM lines),
trig AS (SELECT l_partkey AS part, count(*) AS n FROM lineitem GROUP BY ALL),
cost AS (
  SELECT days, service, sum(cents) AS cents FROM (
    SELECT CAST(ts AS DATE) AS d, event_type || '-' || (user_id % 20) AS service,
           CAST(floor(value * 100) AS BIGINT) AS cents FROM events)
  CROSS JOIN (SELECT unnest([7, 14, 1000000]) AS days)
  WHERE d <= DATE '2024-01-20' AND d > DATE '2024-01-20' - days GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY days ORDER BY cents DESC, service) AS rk FROM cost),
tops AS (
  SELECT t.top, b.days, CAST(count(*) AS BIGINT) AS n, CAST(sum(cents) AS BIGINT) AS cents
  FROM best b CROSS JOIN (SELECT unnest([1, 2, 3]) AS top) t WHERE rk <= top GROUP BY ALL)
SELECT query, NOT (kind = 2 AND q.part % 50 = 0) AS success,
  CASE WHEN kind = 2 AND q.part % 50 = 0 THEN 'could not read period ''9999999 years''' END AS error,
  CASE WHEN kind = 2 AND q.part % 50 = 0 THEN NULL ELSE CASE kind
    WHEN 0 THEN CASE WHEN r.fn IS NULL
        THEN '{{"api_id":"' || a.api_id || '","api_name":"' || a.name || '","message":"Path ''/parts/' || q.part
          || ''' with method ''' || q.method || ''' not found in API ''' || a.name || '''"}}'
        ELSE '{{"api_id":"' || a.api_id || '","api_name":"' || a.name || '","lambda_name":"' || r.fn
          || '","method":"' || q.method || '","path":"/parts/' || q.part || '"}}' END
    WHEN 1 THEN '{{"lambda":"fn-' || q.part || '","trigger_count":' || coalesce(trig.n, 0) || '}}'
    WHEN 2 THEN '{{"amount_cents":' || tops.cents || ',"limit":"' || (1 + q.part % 3) || '","period":"'
          || CASE WHEN q.part % 50 = 1 THEN '1000000 days' ELSE (1 + q.part % 2) || ' weeks' END || '","services":' || tops.n || '}}'
    ELSE '{{"intent":"list_buckets","message":"Query intent not yet implemented"}}' END END AS data
FROM q
LEFT JOIN first_api a ON q.kind = 0 AND q.project = a.project AND q.api = a.wanted
LEFT JOIN first_route r ON a.api_id = r.api_id AND r.path = '/parts/' || q.part AND r.method = q.method
LEFT JOIN trig ON q.kind = 1 AND trig.part = q.part
LEFT JOIN tops ON q.kind = 2 AND tops.days = CASE WHEN q.part % 50 = 1 THEN 1000000 ELSE 7 * (1 + q.part % 2) END AND tops.top = 1 + q.part % 3"""

_TRIGGERS = """triggers AS (
  SELECT 'fn-' || l_partkey AS function_name,
    CASE l_linenumber % 3 WHEN 0 THEN 'apigateway' WHEN 1 THEN 'sqs' ELSE 's3' END AS source_type,
    'arn:aws:events:::src-' || l_suppkey AS source_arn FROM lineitem)"""

FUNCTION_TRIGGERS = f"""WITH {_TRIGGERS} SELECT * FROM triggers
WHERE function_name IN (SELECT 'fn-' || (p_partkey * 3) FROM part)"""

TRIGGER_COUNTS = """SELECT p_partkey AS question_id, 'fn-' || (p_partkey * 3) AS function_name,
  (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey * 3) AS trigger_count FROM part"""

TOP_COST = """WITH spend AS (
  SELECT CAST(ts AS DATE) AS d, event_type || '-' || (user_id % 20) AS service,
         sum(CAST(floor(value * 100) AS BIGINT)) AS cents FROM events GROUP BY ALL),
asked AS (
  SELECT c_custkey AS question_id, DATE '2024-01-05' + CAST(c_custkey % 25 AS INTEGER) AS as_of,
    CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 30 END AS days, 1 + c_custkey % 5 AS top FROM customer),
sums AS (
  SELECT question_id, top, service, sum(cents) AS cents FROM asked
  JOIN spend ON d <= as_of AND d > as_of - days GROUP BY ALL)
SELECT question_id, rank, service, amount_cents FROM (
  SELECT question_id, top, service, CAST(cents AS BIGINT) AS amount_cents,
    row_number() OVER (PARTITION BY question_id ORDER BY cents DESC, service) AS rank FROM sums)
WHERE rank <= top"""

_WORDS = " OR ".join(f"contains(q, {_text(w)})" for w in wording.ARCHITECTURE_WORDS)
ROUTE_TO_BACKEND = f"""SELECT req_id, CASE WHEN {_WORDS} THEN 'arch' ELSE 'general' END AS backend
FROM (SELECT conv_id * 100 + turn AS req_id,
  lower(text || CASE (conv_id + turn) % 6 WHEN 0 THEN ' on Lambda' WHEN 1 THEN ' in my VPC'
    WHEN 2 THEN ' as a Step  Function' WHEN 3 THEN ' as a Step Function' ELSE '' END) AS q
  FROM conversations WHERE role = 'user')"""

PARSE_QUERY = """SELECT req_id,
  CASE k WHEN 0 THEN 'lambda_triggers' WHEN 4 THEN 'cost_top' WHEN 6 THEN '' WHEN 7 THEN '' ELSE 'unknown' END AS intent,
  CASE k WHEN 0 THEN 'lambda' WHEN 6 THEN 's3' ELSE '' END AS service,
  CASE k WHEN 0 THEN 'list_triggers' ELSE '' END AS action,
  'q' || req_id AS raw_query,
  CAST(CASE k WHEN 0 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS BIGINT) AS n_params,
  CASE k WHEN 0 THEN 'f' || req_id END AS lambda
FROM (SELECT conv_id * 100 + turn AS req_id, (conv_id * 100 + turn) % 8 AS k FROM conversations)"""

FIRST_CHUNK = """WITH c AS (
  SELECT conv_id, turn, conv_id * 100 + turn AS r, (conv_id * 100 + turn) % 8 AS k FROM conversations),
f AS (SELECT conv_id, min(turn) AS turn FROM c WHERE k IN (0, 4, 7) GROUP BY ALL)
SELECT d.conv_id AS req_id, CAST(d.conv_id AS VARCHAR) AS raw_query,
  CASE c.k WHEN 0 THEN 'lambda_triggers' WHEN 4 THEN 'cost_top' WHEN 7 THEN '' ELSE 'unknown' END AS intent,
  CASE c.k WHEN 0 THEN 'f' || c.r END AS lambda
FROM (SELECT DISTINCT conv_id FROM conversations) d
LEFT JOIN f ON d.conv_id = f.conv_id LEFT JOIN c ON f.conv_id = c.conv_id AND f.turn = c.turn"""

# ---- resources and scans ----------------------------------------------------

_RES = f"""{_LINES}, res AS (
  SELECT 'c' || o_custkey AS project, 's' || o_orderkey AS stack, 'R' || line_key || '.' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY line_key) - 1) AS logical_id,
    part, (part + l_linenumber) % 7 AS kind,
    CASE (part + l_linenumber) % 7 WHEN 0 THEN 'AWS::Lambda::Function' WHEN 1 THEN 'AWS::ApiGateway::RestApi'
      WHEN 2 THEN 'AWS::S3::Bucket' WHEN 3 THEN 'AWS::DynamoDB::Table' WHEN 5 THEN 'AWS::IAM::Role' END AS type
  FROM lines JOIN orders ON o_orderkey = l_orderkey)"""

BY_TYPE = f"WITH {_RES} SELECT type, count(*) AS n FROM res WHERE type IS NOT NULL GROUP BY ALL"
TYPED = f"WITH {_RES} SELECT project, stack, logical_id, type FROM res WHERE type IS NOT NULL"
KEY = f"""WITH {_RES} SELECT project, stack, logical_id, type,
  CASE kind WHEN 0 THEN 'Lambda' WHEN 1 THEN 'API Gateway' WHEN 2 THEN 'S3 Bucket' ELSE 'DynamoDB Table' END AS kind,
  CASE kind WHEN 0 THEN 'fn-' || part WHEN 3 THEN 'table-' || part ELSE logical_id END AS friendly_name,
  CASE kind WHEN 0 THEN 'Lambda: fn-' || part || ' (' || logical_id || ')' WHEN 1 THEN 'API Gateway: ' || logical_id
    WHEN 2 THEN 'S3 Bucket: ' || logical_id ELSE 'DynamoDB Table: table-' || part || ' (' || logical_id || ')' END AS label
FROM res WHERE kind < 4"""
TOTALS = """SELECT 'c' || o_custkey AS project, 's' || o_orderkey AS stack, count(l_orderkey) AS resource_total,
  CAST(CASE WHEN o_orderkey % 3 = 1 THEN 2 ELSE 0 END AS BIGINT) AS output_total
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderkey"""
OUTPUTS = """SELECT 'c' || o_custkey AS project, 's' || o_orderkey AS stack, o.output_name
FROM orders CROSS JOIN (SELECT unnest(['Url', 'Name']) AS output_name) o WHERE o_orderkey % 3 = 1"""

SCAN = """WITH p AS (SELECT 'c' || c_custkey AS project, c_custkey % 8 AS k, c_custkey FROM customer),
r AS (
  SELECT project, CAST(NULL AS VARCHAR) AS stack, CAST(NULL AS VARCHAR) AS doc, CASE k WHEN 0 THEN 'no_build_output'
    WHEN 1 THEN 'manifest_unreadable' WHEN 2 THEN 'manifest_unparsable' ELSE 'no_stack' END AS error_code
  FROM p WHERE k < 4
  UNION ALL SELECT project, 'A', CASE WHEN k > 5 THEN '{"Resources":{"k' || c_custkey || '":{}}}' END,
    CASE k WHEN 4 THEN 'template_unreadable' WHEN 5 THEN 'template_unparsable' END FROM p WHERE k >= 4
  UNION ALL SELECT project, 'B', NULL, 'template_unreadable' FROM p WHERE k = 6)
SELECT *, CASE error_code
  WHEN 'no_build_output' THEN 'no supported IaC files found in ' || project
  WHEN 'manifest_unreadable' THEN 'could not read cdk manifest.json'
  WHEN 'manifest_unparsable' THEN 'could not parse cdk manifest.json'
  WHEN 'no_stack' THEN 'no aws:cloudformation:stack artifact found in cdk manifest'
  WHEN 'template_unreadable' THEN 'could not read template file ' || stack || '.json'
  WHEN 'template_unparsable' THEN 'could not parse template file ' || stack || '.json' END AS error FROM r"""

RESULTS = f"""SELECT 'scan ' || project AS query, CASE WHEN error IS NULL
  THEN '{{"query":"scan ' || project || '","data":' || doc || ',"success":true}}'
  ELSE '{{"query":"scan ' || project || '","data":null,"error":"' || error || '","success":false}}' END AS result
FROM ({SCAN})"""

SCAN_SUMMARY = f"""SELECT project, stack, 'total' AS section, 'resources' AS item, resource_total AS n FROM ({TOTALS})
UNION ALL SELECT project, stack, 'type', type, count(*) FROM ({TYPED}) GROUP BY ALL
UNION ALL SELECT project, stack, 'key', label, 1 FROM ({KEY})
UNION ALL SELECT project, stack, 'output', output_name, 1 FROM ({OUTPUTS})"""

ARTIFACTS = """SELECT 'c' || c_custkey AS project, s AS stack, s || '.json' AS template_file, 'A' AS first_stack
FROM customer CROSS JOIN (SELECT unnest(['A', 'B']) AS s)
WHERE c_custkey % 8 IN (4, 5, 6, 7) AND (s = 'A' OR c_custkey % 8 = 6)"""

SNAPSHOT = """SELECT 'c' || o_custkey AS project, strftime(o_orderdate, '%Y-%m-%d') AS scan_day,
  's' || o_orderkey AS logical_id
FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS newest FROM orders) WHERE o_orderdate = newest"""

SAVED = """SELECT 'c' || o_custkey AS project, CASE WHEN o_custkey % 5 = 0 THEN '2024-01-01' ELSE '2024-01-02' END AS scan_day,
  's' || o_orderkey AS logical_id FROM orders WHERE o_orderkey % 2 = CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE 1 END"""

# ---- redaction --------------------------------------------------------------

# RE2's \\b is ASCII-only, as in the definition of the patterns
_RE2 = [
    ("ARN", r"arn:[A-Za-z0-9\-_:/.]+"),
    ("ACCOUNT_ID", r"\b\d{12}\b"),
    ("IP", r"\b\d{1,3}(?:\.\d{1,3}){3}\b"),
    ("S3", r"s3://[A-Za-z0-9.\-_/]+"),
]

_SECRETS = """t0 AS (
  SELECT doc_id, 'Who calls arn:aws:lambda:us-east-1:' || (100000000000 + doc_id) || ':function:f' || doc_id
      || ' from 10.0.' || (doc_id % 256) || '.7?' AS q,
    CASE WHEN doc_id % 3 = 0 THEN text || ' {"a":"s3://logs-' || (100000000000 + doc_id) || '/x","b":"10.0.0.1","c":"'
      || (100000000000 + doc_id) || '"}' ELSE text END AS c,
    CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(idx BIGINT, tag VARCHAR, placeholder VARCHAR, original VARCHAR)[]) AS m
  FROM documents)"""


def _scrub_steps() -> str:
    steps = [_SECRETS]
    number = 0
    for column, other in (("q", "c"), ("c", "q")):
        for tag, pattern in _RE2:
            p = _text(pattern)
            steps.append(f"""t{number + 1} AS (
  SELECT doc_id, {other}, n + len(hits) AS n,
    array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || CASE WHEN i <= len(hits)
      THEN '[[{tag}_' || (n + i) || ']]' ELSE '' END), '') AS {column},
    list_concat(m, list_transform(range(1, len(hits) + 1), lambda i: {{'idx': n + i, 'tag': '{tag}',
      'placeholder': '[[{tag}_' || (n + i) || ']]', 'original': hits[i]}})) AS m
  FROM (SELECT *, regexp_extract_all({column}, {p}) AS hits, string_split_regex({column}, {p}) AS pieces FROM t{number}))""")
            number += 1
    return ", ".join(steps)


_SCRUB = _scrub_steps()
SCRUB_DOCUMENTS = f"WITH {_SCRUB} SELECT doc_id, q AS scrubbed_question, c AS scrubbed_context, n AS n_redactions FROM t8"
SCRUB_MAP = f"""WITH {_SCRUB} SELECT doc_id, e.idx AS idx, e.tag AS tag, e.placeholder AS placeholder,
  e.original AS original FROM (SELECT doc_id, unnest(m) AS e FROM t8)"""
ROUNDTRIP = f"WITH {_SECRETS} SELECT doc_id, c AS context FROM t0"
STORED = f"WITH {_SECRETS} SELECT doc_id, q AS question FROM t0"
STREAM_SCRUB = f"""WITH {_SCRUB} SELECT doc_id, 'arch' AS backend, q AS scrubbed_question, c AS scrubbed_context FROM t8"""

# ---- usage and budget -------------------------------------------------------

_USAGE = f"""priced AS (
  SELECT user_id, event_id AS req_id, ts, CAST(ts AS DATE) AS day,
    CASE event_id % 5 WHEN 0 THEN '{HAIKU}' WHEN 1 THEN '{SONNET}' WHEN 2 THEN '{TITAN}' WHEN 3 THEN '{LLAMA}'
      ELSE 'some-other-model' END AS model_id,
    i AS input_tokens, o AS output_tokens,
    CASE event_id % 5 WHEN 0 THEN i * 250 + o * 1250 WHEN 1 THEN i * 3000 + o * 15000 WHEN 2 THEN i * 130 + o * 170
      WHEN 3 THEN i * 990 + o * 990 ELSE 0 END AS cost_micro,
    CASE event_id % 5 WHEN 0 THEN i * 250 + 625000 WHEN 1 THEN i * 3000 + 7500000 WHEN 2 THEN i * 130 + 85000
      WHEN 3 THEN i * 990 + 495000 ELSE 10000 END AS est_micro,
    CASE user_id % 3 WHEN 0 THEN 500000 WHEN 1 THEN 2000000 ELSE 5000000 END AS limit_micro
  FROM (SELECT *, CAST(floor(value * 10) AS BIGINT) AS i,
          CAST(regexp_extract(props, '[0-9]+') AS BIGINT) * 5 AS o FROM events)),
daily AS (
  SELECT user_id, day, CAST(sum(cost_micro) AS BIGINT) AS cost_micro, count(*) AS requests,
    CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens FROM priced GROUP BY ALL)"""

REQUEST_COST = f"""WITH {_USAGE} SELECT req_id, model_id, cost_micro, est_micro, strftime(ts, '%Y-%m-%d') AS date_key,
  strftime(ts, '%Y%m%dT%H%M%SZ') AS batch_key FROM priced"""
FINE_COSTS = f"""WITH {_USAGE} SELECT req_id, 'm' || (req_id % 300) AS model_id,
  CASE WHEN k IS NULL THEN 0 ELSE CAST((input_tokens * (k % 1000 + 1) + output_tokens * (k % 777 + 1) * 5 + 500) // 1000 AS BIGINT) END AS cost_micro,
  CASE WHEN k IS NULL THEN 10000 ELSE CAST((input_tokens * (k % 1000 + 1) + 500 * (k % 777 + 1) * 5 + 500) // 1000 AS BIGINT) END AS est_micro
FROM priced LEFT JOIN (SELECT p_partkey AS k FROM part) ON k = req_id % 300"""
TOKENS = "SELECT doc_id, CAST(strlen(text) // 4 AS BIGINT) AS tokens FROM documents"
DAILY = f"WITH {_USAGE} SELECT * FROM daily"
REPORT = f"""WITH {_USAGE} SELECT *, limit_micro - cost_micro AS remaining_micro,
  CAST(cost_micro AS DOUBLE) / CAST(limit_micro AS DOUBLE) * 100.0::DOUBLE AS percent_used,
  CAST(cost_micro AS DOUBLE) / 1000000.0::DOUBLE / requests AS avg_cost,
  CAST(cost_micro AS DOUBLE) / CAST(limit_micro AS DOUBLE) * 100.0::DOUBLE > 80 AS warn,
  limit_micro - cost_micro < 10000 AS exceeded
FROM (SELECT *, CAST(CASE user_id % 3 WHEN 0 THEN 500000 WHEN 1 THEN 5000000 ELSE 900000 END AS BIGINT) AS limit_micro
      FROM daily)"""
RUNNING = f"""WITH {_USAGE} SELECT user_id, day, req_id, cost_micro,
  CAST(sum(cost_micro) OVER (PARTITION BY user_id, day ORDER BY ts, req_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent_micro
FROM priced"""
GATE = f"""WITH RECURSIVE {_USAGE},
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, req_id) AS rn FROM priced),
fold AS (
  SELECT user_id, day, rn, req_id, est_micro <= limit_micro AS admitted, CAST(0 AS BIGINT) AS spent_before_micro,
    CASE WHEN est_micro <= limit_micro THEN CAST(cost_micro AS BIGINT) ELSE 0 END AS spent
  FROM numbered WHERE rn = 1
  UNION ALL
  SELECT x.user_id, x.day, x.rn, x.req_id, f.spent + x.est_micro <= x.limit_micro, f.spent,
    f.spent + CASE WHEN f.spent + x.est_micro <= x.limit_micro THEN CAST(x.cost_micro AS BIGINT) ELSE 0 END
  FROM fold f JOIN numbered x ON x.user_id = f.user_id AND x.day = f.day AND x.rn = f.rn + 1)
SELECT user_id, day, req_id, admitted, spent_before_micro FROM fold"""
PRICE_OR_DEFAULT = f"""WITH {_USAGE} SELECT req_id, model_id,
  CAST(CASE req_id % 5 WHEN 1 THEN 3000 WHEN 2 THEN 130 WHEN 3 THEN 990 ELSE 250 END AS BIGINT) * 1000 AS input_nano,
  CAST(CASE req_id % 5 WHEN 1 THEN 15000 WHEN 2 THEN 170 WHEN 3 THEN 990 ELSE 1250 END AS BIGINT) * 1000 AS output_nano,
  CAST(CASE req_id % 5 WHEN 1 THEN 7 WHEN 2 THEN 8 WHEN 3 THEN 6 ELSE 9 END AS BIGINT) AS speed,
  CAST(CASE req_id % 5 WHEN 1 THEN 9 WHEN 2 THEN 6 WHEN 3 THEN 8 ELSE 7 END AS BIGINT) AS quality FROM priced"""

# ---- models and hosts -------------------------------------------------------

_HOSTS = """hosts AS (
  SELECT c_custkey AS host_id, 2 + (c_custkey % 4) * 2 AS cpu,
    CASE (c_custkey // 4) % 4 WHEN 0 THEN 3 WHEN 1 THEN 7 WHEN 2 THEN 16 ELSE 32 END AS ram,
    c_custkey % 3 = 0 AS gpu FROM customer),
needs AS (SELECT * FROM (VALUES ('llama3.2:3b', 8, 4, '3B', 100), ('llama3.2:1b', 4, 2, '1B', 80),
  ('phi3:mini', 4, 2, 'Mini', 70), ('llama3.2:8b', 16, 8, '8B', 120)) AS v(name, min_ram, min_cpu, size, priority)),
names AS (SELECT * FROM (VALUES (0, 'llama3.2:3b'), (1, 'llama3.2:1b'), (2, 'phi3:mini'), (3, 'llama3.2:8b'),
  (4, 'other:7b')) AS v(i, name)),
installed AS (SELECT host_id, name FROM hosts CROSS JOIN names WHERE (host_id + i) % 3 <> 0),
placed AS (
  SELECT h.host_id, coalesce(b.name, '') AS model FROM hosts h LEFT JOIN (
    SELECT * FROM (SELECT host_id, name, row_number() OVER (PARTITION BY host_id ORDER BY priority DESC) AS rn
      FROM installed JOIN needs USING (name) JOIN hosts USING (host_id) WHERE ram >= min_ram AND cpu >= min_cpu)
    WHERE rn = 1) b ON h.host_id = b.host_id)"""

PLACE = f"WITH {_HOSTS} SELECT * FROM placed"
MARK = f"""WITH {_HOSTS} SELECT i.host_id, i.name, CASE WHEN n.size IS NULL THEN i.name ELSE i.name || ' (' || n.size || ')' END AS label,
  i.name = p.model AS is_current, CAST(min_ram AS BIGINT) AS min_ram_gb, CAST(min_cpu AS BIGINT) AS min_cpus,
  CASE WHEN n.size IS NOT NULL THEN 'No' END AS gpu
FROM installed i JOIN placed p USING (host_id) LEFT JOIN needs n USING (name)"""
AVAILABLE = f"WITH {_HOSTS} SELECT host_id, name FROM installed WHERE name <> 'other:7b'"
MEMORY = """SELECT c_custkey AS host_id,
  CASE c_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 7
    ELSE ((c_custkey * 37 + 3) * 100000) // 1048576 END AS ram_gb,
  CASE c_custkey % 10 WHEN 0 THEN 'could not find MemTotal in meminfo' WHEN 1 THEN 'could not parse memory value' END AS error
FROM customer"""
SUMMARY = f"""WITH {_HOSTS} SELECT host_id, 'CPU: ' || cpu || ' cores, RAM: ' || ram || ' GB, '
  || CASE WHEN gpu THEN 'NVIDIA GPU' ELSE 'No GPU' END AS summary FROM hosts"""

_CHOICE = f"""WITH p AS (SELECT * FROM (VALUES (0, '{HAIKU}', 875000, 9, 7), (1, '{SONNET}', 10500000, 7, 9),
  (2, '{TITAN}', 215000, 8, 6), (3, '{LLAMA}', 1485000, 6, 8)) AS v(pos, model_id, est, speed, quality)),
b AS (SELECT c_custkey AS budget_id, CAST(floor(c_acctbal * 100) AS BIGINT) * 200 AS budget, c_custkey % 2 = 0 AS fast
      FROM customer),
other AS (SELECT budget_id, model_id, row_number() OVER (PARTITION BY budget_id ORDER BY
    CASE WHEN fast THEN speed ELSE quality END DESC, CASE WHEN fast THEN quality ELSE speed END DESC, pos) AS rn
  FROM b JOIN p ON est * 10 <= budget WHERE pos > 0)"""
SELECT_MODEL = f"""{_CHOICE} SELECT b.budget_id,
  CASE WHEN budget >= 8750000 OR budget < 2150000 THEN '{HAIKU}' ELSE '{TITAN}' END AS shipped,
  coalesce(o.model_id, '{TITAN}') AS without_default
FROM b LEFT JOIN other o ON b.budget_id = o.budget_id AND o.rn = 1"""

CHEAPEST = """SELECT brand, model_id FROM (
  SELECT p_brand AS brand, 'm' || p_partkey AS model_id,
    row_number() OVER (PARTITION BY p_brand ORDER BY p_size + floor(p_retailprice / 100), p_partkey) AS rn FROM part)
WHERE rn = 1"""
BEST = """SELECT brand, model_id FROM (
  SELECT p_brand AS brand, 'm' || p_partkey AS model_id,
    row_number() OVER (PARTITION BY p_brand ORDER BY floor(p_retailprice / 100) DESC, p_size, p_partkey) AS rn FROM part)
WHERE rn = 1"""
SELECT_OFFER = """WITH prices AS (
  SELECT p_partkey AS pos, 'm' || p_partkey AS model_id, CAST(floor(p_retailprice) AS BIGINT) * 1000 AS micro_in, p_size * 10000 AS micro_out,
    p_partkey % 97 AS speed, p_size AS quality FROM part),
steps AS (
  SELECT lim, max(best_speed) AS best_speed, max(best_quality) AS best_quality FROM (
    SELECT lim, max({'a': speed, 'b': quality, 'c': -pos, 'm': model_id}) OVER w AS best_speed,
      max({'a': quality, 'b': speed, 'c': -pos, 'm': model_id}) OVER w AS best_quality
    FROM (SELECT *, (micro_in * 2 + micro_out) * 5 AS lim FROM prices)
    WINDOW w AS (ORDER BY lim))
  GROUP BY lim),
asked AS (
  SELECT c_custkey AS budget_id, CAST(floor(c_acctbal * 100) AS BIGINT) * 200 AS lim, c_custkey % 2 = 0 AS speedy FROM customer),
met AS (SELECT a.*, s.best_speed, s.best_quality FROM asked a ASOF LEFT JOIN steps s ON a.lim >= s.lim),
known AS (
  SELECT arg_min(model_id, {'p': micro_in + micro_out, 'q': pos}) AS cheapest,
    max(CASE WHEN model_id = 'm7' THEN (micro_in * 2 + micro_out) * 5 END) AS default_at FROM prices)
SELECT budget_id,
  CASE WHEN best_speed IS NULL OR default_at <= lim THEN 'm7' WHEN speedy THEN best_speed.m ELSE best_quality.m END AS with_default,
  CASE WHEN best_speed IS NULL THEN cheapest WHEN speedy THEN best_speed.m ELSE best_quality.m END AS without_default
FROM met, known"""
TOP_OFFERS = """SELECT brand, rank, model_id, price FROM (
  SELECT p_brand AS brand, 'm' || p_partkey AS model_id, floor(p_retailprice / 100)::BIGINT AS price,
    row_number() OVER (PARTITION BY p_brand ORDER BY floor(p_retailprice / 100) DESC, p_partkey) AS rank,
    count(*) OVER (PARTITION BY p_brand) AS n FROM part)
WHERE rank <= floor(n / 100) + 1"""
WORKING = f"""SELECT 'a' || s_suppkey AS account, CASE WHEN s_suppkey % 9 > 5 THEN '{HAIKU}'
  WHEN (s_suppkey + 2) % 9 > 5 THEN '{SONNET}' WHEN (s_suppkey + 4) % 9 > 5 THEN '{TITAN}'
  WHEN (s_suppkey + 6) % 9 > 5 THEN '{LLAMA}' ELSE '' END AS model_id FROM supplier"""
PROVIDERS = """SELECT provider, pos, label, count(*) OVER (PARTITION BY provider) AS provider_total,
  count(*) OVER () AS grand_total
FROM (SELECT p_partkey AS pos, CASE WHEN p_partkey % 13 = 0 THEN 'Unknown' ELSE p_brand END AS provider,
  CASE WHEN p_partkey % 17 = 0 THEN 'Unknown' ELSE p_name END || ' ('
    || CASE WHEN p_partkey % 19 = 0 THEN 'Unknown' ELSE 'm' || p_partkey END || ')' AS label FROM part)"""

# ---- prompts and replies ----------------------------------------------------

_ASKED = """asked AS (
  SELECT conv_id * 100 + turn AS req_id, conv_id, turn, conv_id % 27 AS nation, text AS words,
    text || ' from arn:aws:lambda:us-east-1:1:function:f' || conv_id || ' at 10.0.0.' || turn AS question
  FROM conversations WHERE role = 'user')"""
_CONTEXT = """'{"Outputs":{},"Resources":{"F":{"Properties":{"FunctionName":"' || n_name || '"},"Type":"AWS::Lambda::Function"}}}'"""
_HEAD, _REST = wording.ANSWER_PROMPT.split("{context}")
_MIDDLE, _TAIL = _REST.split("{question}")
PROMPTS = f"""WITH {_ASKED}, p AS (
  SELECT req_id, question, {_text(_HEAD)} || {_CONTEXT} || {_text(_MIDDLE)} || question || {_text(_TAIL)} AS prompt
  FROM asked LEFT JOIN nation ON n_nationkey = nation)
SELECT req_id, md5(prompt) AS prompt_md5, CAST(strlen(prompt) // 4 AS BIGINT) AS prompt_tokens,
  md5({_text(wording.INTENT_PROMPT)} || question) AS intent_prompt_md5 FROM p"""

_KINDS = """calls AS (
  SELECT conv_id * 100 + turn AS req_id, text, CASE (conv_id + turn) % 9
    WHEN 0 THEN 'anthropic' WHEN 1 THEN 'titan' WHEN 2 THEN 'llama' WHEN 3 THEN 'sagemaker' WHEN 4 THEN 'openai'
    WHEN 5 THEN 'unsupported' WHEN 6 THEN 'broken' WHEN 7 THEN 'wrong' ELSE 'empty' END AS kind FROM conversations)"""
BODIES = f"""WITH {_KINDS} SELECT req_id, kind <> 'unsupported' AS supported,
  CASE kind WHEN 'unsupported' THEN 'unsupported Bedrock model: openai.gpt-4o' END AS error,
  CASE WHEN kind IN ('anthropic', 'broken', 'wrong') THEN '{{"anthropic_version":"bedrock-2023-05-31","max_tokens":4096,"prompt":'
      || CAST(to_json(text) AS VARCHAR) || ',"temperature":0.1,"top_p":1.0}}'
    WHEN kind = 'titan' THEN '{{"inputText":' || CAST(to_json(text) AS VARCHAR)
      || ',"textGenerationConfig":{{"maxTokenCount":4096,"temperature":0.1,"topP":1.0}}}}'
    WHEN kind = 'llama' THEN '{{"max_gen_len":4096,"prompt":' || CAST(to_json(text) AS VARCHAR) || ',"temperature":0.1,"top_p":1.0}}'
    WHEN kind = 'sagemaker' THEN '{{"max_tokens":4096,"prompt":' || CAST(to_json(text) AS VARCHAR) || ',"temperature":0.1}}'
    WHEN kind IN ('openai', 'empty') THEN '{{"max_tokens":4096,"messages":[{{"content":' || CAST(to_json(text) AS VARCHAR)
      || ',"role":"user"}}],"temperature":0.1}}' END AS body FROM calls"""
REPLIES = f"""WITH {_KINDS} SELECT req_id,
  CASE WHEN kind IN ('anthropic', 'titan', 'llama', 'sagemaker', 'openai')
    THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS text,
  CASE kind WHEN 'unsupported' THEN 'unsupported Bedrock model: openai.gpt-4o' WHEN 'broken' THEN 'failed to parse anthropic response'
    WHEN 'wrong' THEN 'failed to parse anthropic response' WHEN 'empty' THEN 'no response from model' END AS error FROM calls"""


def _clean(source: str, key: str, column: str) -> str:
    """CTEs that clean ``column`` of ``source``; the last is ``cleaned`` (key, answer)."""
    body = column
    for phrase in wording.FILLER_PHRASES:
        body = f"replace({body}, {_text(phrase)}, '')"
    trim = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
    noise = " OR ".join(
        "(" + " AND ".join(f"contains(l, {_text(w)})" for w in words) + ")" for words in wording.NOISE_LINES
    )
    weak = " OR ".join(f"contains(s, {_text(w)})" for w in wording.WEAK_SENTENCES)
    return f"""c1 AS (
  SELECT {key}, array_to_string(list_filter(list_transform(string_split({body}, chr(10)),
    lambda l: {trim.format('l')}), lambda l: l <> '' AND NOT ({noise})), chr(10)) AS a
  FROM (SELECT {key}, {trim.format(column)} AS {column} FROM {source})),
c2 AS (
  SELECT *, array_to_string(list_filter(list_transform(string_split(a, '.')[1:3], lambda s: {trim.format('s')}),
    lambda s: s <> '' AND NOT ({weak})), '. ') AS short FROM c1),
cleaned AS (
  SELECT {key}, {trim.format("CASE WHEN strlen(a) > 500 AND short <> '' THEN short || '.' ELSE a END")} AS answer FROM c2)"""


CLEAN = f"""WITH raw AS (
  SELECT conv_id * 100 + turn AS req_id, chr(10) || ' ' || CASE (conv_id + turn) % 4
      WHEN 0 THEN 'Based on the provided infrastructure context, ' WHEN 1 THEN 'So, in summary: ' ELSE '' END || text
    || CASE (conv_id + turn) % 3 WHEN 0 THEN chr(10) || chr(10) || chr(10) || ' SourceArn: z' || chr(10) || ' end. '
      WHEN 1 THEN chr(10) || ' Action: lambda:InvokeFunction' || chr(10) || '  DemoApi Permission' || chr(10) ELSE '' END AS reply
  FROM conversations WHERE role = 'assistant'), {_clean('raw', 'req_id', 'reply')}
SELECT * FROM cleaned"""


def _answers(backend: str) -> str:
    """The injected ARN and address are the only identifiers in these questions."""
    return f"""WITH {_ASKED}, echoed AS (
  SELECT req_id, 'So, in summary: ' || {backend} || ': ' || words || ' from [[ARN_1]] at [[IP_2]]' AS reply FROM asked),
{_clean('echoed', 'req_id', 'reply')}
SELECT req_id, {backend} AS backend,
  CASE WHEN nation < 25 THEN replace(replace(answer, '[[ARN_1]]', 'arn:aws:lambda:us-east-1:1:function:f' || conv_id),
    '[[IP_2]]', '10.0.0.' || turn) END AS answer,
  CASE WHEN nation >= 25 THEN {_text(wording.NO_SNAPSHOT)} END AS error
FROM cleaned JOIN asked USING (req_id)"""


ANSWERS = _answers("'arch'")
CLASSIFIED = _answers("CASE WHEN length(question) % 2 = 0 THEN 'even' ELSE 'odd' END")

GATED_ANSWERS = f"""WITH RECURSIVE {_ASKED}, echoed AS (
  SELECT req_id, 'So, in summary: arch: ' || words || ' from [[ARN_1]] at [[IP_2]]' AS reply FROM asked),
{_clean('echoed', 'req_id', 'reply')},
sized AS (
  SELECT req_id, conv_id, turn, conv_id % 10 AS user_id, conv_id % 3 AS day, answer,
    strlen({_text(_HEAD)} || {_CONTEXT} || {_text(_MIDDLE)} || words || ' from [[ARN_1]] at [[IP_2]]' || {_text(_TAIL)}) // 4 AS i,
    strlen(reply) // 4 AS o
  FROM asked JOIN nation ON n_nationkey = nation JOIN echoed USING (req_id) JOIN cleaned USING (req_id)),
numbered AS (
  SELECT *, CAST(i * 250 + 625000 AS BIGINT) AS est, CAST(i * 250 + o * 1250 AS BIGINT) AS cost,
    row_number() OVER (PARTITION BY user_id, day ORDER BY conv_id, turn) AS rn FROM sized),
fold AS (
  SELECT user_id, day, rn, req_id, est <= 1500000 AS admitted, CAST(0 AS BIGINT) AS before,
    CASE WHEN est <= 1500000 THEN cost ELSE 0 END AS cost FROM numbered WHERE rn = 1
  UNION ALL
  SELECT x.user_id, x.day, x.rn, x.req_id, f.before + f.cost + x.est <= 1500000, f.before + f.cost,
    CASE WHEN f.before + f.cost + x.est <= 1500000 THEN x.cost ELSE 0 END
  FROM fold f JOIN numbered x ON x.user_id = f.user_id AND x.day = f.day AND x.rn = f.rn + 1)
SELECT f.req_id, f.admitted, f.before AS spent_before_micro, f.cost AS cost_micro,
  CASE WHEN f.admitted THEN replace(replace(n.answer, '[[ARN_1]]', 'arn:aws:lambda:us-east-1:1:function:f' || n.conv_id),
    '[[IP_2]]', '10.0.0.' || n.turn) END AS answer
FROM fold f JOIN numbered n USING (req_id)
UNION ALL SELECT req_id, false, NULL, NULL, NULL FROM asked LEFT JOIN nation ON n_nationkey = nation WHERE n_nationkey IS NULL"""

# ---- accounts and pairs -----------------------------------------------------

_QUOTAS = """q AS (
  SELECT 'c' || c_custkey AS account, code AS quota_code, name AS quota_name,
    CASE (c_custkey + i * 3) % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.0::DOUBLE ELSE CAST((c_custkey + i) % 7 AS DOUBLE) END AS value
  FROM customer CROSS JOIN (VALUES (0, 'L-DB2E81BA', 'GPU Instances (G and VT)'),
    (1, 'L-1216C47A', 'Standard Instances (A,C,D,H,I,M,R,T,Z)'), (2, 'L-34B43A08', 'Spot Instances')) AS v(i, code, name))"""
QUOTA_STATUS = f"""WITH {_QUOTAS} SELECT *, CASE WHEN value IS NULL THEN 'could not check' WHEN value = 0 THEN 'BLOCKED'
  ELSE 'OK' END AS status FROM q"""
QUOTA_ADVICE = f"""WITH {_QUOTAS}, w AS (
  SELECT account, coalesce(max(value) FILTER (quota_code = 'L-DB2E81BA'), 0) AS gpu,
    coalesce(max(value) FILTER (quota_code = 'L-1216C47A'), 0) AS std FROM q GROUP BY ALL)
SELECT account, CASE WHEN gpu = 0 THEN 'request L-DB2E81BA to 4 vCPU' ELSE 'deploy g4dn.xlarge' END AS gpu_advice,
  CASE WHEN std = 0 THEN 'request L-1216C47A to 8 vCPU' ELSE 'deploy t3.medium' END AS standard_advice,
  CASE WHEN gpu <> 0 THEN 'gpu instance' WHEN std <> 0 THEN 'cpu instance, managed model or wait'
    ELSE 'managed model or request quota' END AS options FROM w"""
PENDING = """SELECT 'quota ' || o_orderpriority AS quota_name, o_totalprice AS desired_value, 'PENDING' AS status,
  strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders WHERE o_orderstatus = 'P'"""
STACK_VALUES = """SELECT 'c' || c_custkey AS stack,
  CASE WHEN c_custkey % 5 <> 0 THEN '10.0.0.' || (c_custkey % 256) END AS "PublicIP",
  CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 2 = 0 THEN 'http://host-' || c_custkey END AS "OllamaURL",
  CAST(NULL AS VARCHAR) AS "SSHCommand" FROM customer"""
RETENTION = "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 30 DAY"
COLLECT = """SELECT 'Lambda' AS "Type", p_name || '-' || p_partkey AS "FunctionName", 'arn:aws:lambda:::' || p_partkey AS "Arn" FROM part"""
PAIRS = f"""SELECT 'What triggers the ' || p_name || '-' || p_partkey || ' Lambda?' AS prompt,
  {_text(wording.PAIR_COMPLETION)} AS completion FROM part WHERE p_partkey % 4 <> 0"""
PAIR_TEXT = """SELECT 'Turn ' || r AS prompt, 'Turn ' || r || chr(10) || text AS text
FROM (SELECT conv_id * 100 + turn AS r, text FROM conversations) WHERE r % 7 <> 0 AND r % 11 <> 0 AND r % 5 <> 0 AND text <> ''"""
PAIR_FILES = """SELECT 'Turn ' || r AS prompt, text AS completion
FROM (SELECT conv_id * 100 + turn AS r, text FROM conversations) WHERE r % 7 <> 0 AND r % 11 <> 0 AND r % 5 <> 0 AND text <> ''"""
METADATA_FILES = """SELECT CASE WHEN p_partkey % 4 = 0 THEN 'Table' ELSE 'Lambda' END AS "Type",
  p_name || '-' || p_partkey AS "FunctionName", 'arn:aws:lambda:::' || p_partkey AS "Arn" FROM part"""
WRITTEN = """SELECT 'metadata' AS written, count(*) AS records FROM part
UNION ALL SELECT 'pairs', count(*) FROM conversations"""
TRUNCATE = """SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, md5(array_to_string(w, ' ')) AS kept_md5
FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')[1:1024] AS w FROM documents)"""

ORACLE: dict[str, str] = {
    "api_route_lookup": API_ROUTE_LOOKUP,
    "available_apis": AVAILABLE_APIS,
    "dispatch_intents": DISPATCH,
    "function_triggers": FUNCTION_TRIGGERS,
    "trigger_counts": TRIGGER_COUNTS,
    "top_cost": TOP_COST,
    "top_offers": TOP_OFFERS,
    "select_offer": SELECT_OFFER,
    "route_to_backend": ROUTE_TO_BACKEND,
    "parse_query_replies": PARSE_QUERY,
    "first_valid_chunk": FIRST_CHUNK,
    "resources_by_type": BY_TYPE,
    "typed_resources": TYPED,
    "key_resources": KEY,
    "resource_totals": TOTALS,
    "stack_outputs": OUTPUTS,
    "scan_outcomes": SCAN,
    "scan_results": RESULTS,
    "scan_summary": SCAN_SUMMARY,
    "stack_artifacts": ARTIFACTS,
    "latest_snapshot": SNAPSHOT,
    "saved_snapshots": SAVED,
    "scrub_documents": SCRUB_DOCUMENTS,
    "scrub_map": SCRUB_MAP,
    "unscrub_roundtrip": ROUNDTRIP,
    "unscrub_stored_map": STORED,
    "request_cost": REQUEST_COST,
    "fine_costs": FINE_COSTS,
    "token_estimates": TOKENS,
    "daily_usage": DAILY,
    "usage_report": REPORT,
    "running_spend": RUNNING,
    "budget_gate": GATE,
    "price_or_default": PRICE_OR_DEFAULT,
    "place_models": PLACE,
    "mark_current": MARK,
    "available_only": AVAILABLE,
    "host_memory": MEMORY,
    "host_summary": SUMMARY,
    "select_model": SELECT_MODEL,
    "cheapest_model": CHEAPEST,
    "best_model_per_brand": BEST,
    "first_working_model": WORKING,
    "models_by_provider": PROVIDERS,
    "context_prompt": PROMPTS,
    "request_bodies": BODIES,
    "extract_response": REPLIES,
    "clean_response": CLEAN,
    "answer_batch": ANSWERS,
    "classified_answers": CLASSIFIED,
    "answer_within_budget": GATED_ANSWERS,
    "quota_status": QUOTA_STATUS,
    "quota_recommendation": QUOTA_ADVICE,
    "pending_quotas": PENDING,
    "stack_output_values": STACK_VALUES,
    "retention": RETENTION,
    "collect_rows": COLLECT,
    "make_pairs": PAIRS,
    "pair_text": PAIR_TEXT,
    "pair_files": PAIR_FILES,
    "metadata_files": METADATA_FILES,
    "metadata_arrays": METADATA_FILES,
    "chunk_files": f"SELECT req_id, intent, raw_query FROM ({FIRST_CHUNK})",
    "written_counts": WRITTEN,
    "truncate_text": TRUNCATE,
    "stream_usage": DAILY,
    "stream_budget": GATE,
    "stream_scrub": STREAM_SCRUB,
    "stream_pairs": PAIRS,
    "stream_pair_counts": "SELECT count(*) AS pairs FROM part WHERE p_partkey % 4 <> 0",
}
