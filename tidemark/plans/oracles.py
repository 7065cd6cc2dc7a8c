"""What the registered queries must return, as DuckDB SQL over the base tables.

The statements compute from the base columns, never from the JSON that the
adapters build."""

from __future__ import annotations


def iso(us: str) -> str:
    """ISO text of microseconds since the epoch."""
    return (
        f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ({us}) % 1000000 = 0 THEN '' "
        f"ELSE '.' || lpad(CAST(({us}) % 1000000 AS VARCHAR), 6, '0') END || '+00:00'"
    )


def iso_s(s: str) -> str:
    return f"strftime(make_timestamp(({s}) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00'"


MS = "(epoch_us(ts) // 1000)"
MS_ISO = iso(f"{MS} * 1000")
TS = iso("epoch_us(ts)")

BINANCE = f"""SELECT {TS} AS ts, 'tick' AS record_type, 'binance_ws' AS source, 'BTCUSDT' AS symbol, value AS price, NULL AS warning,
  CAST({MS} AS VARCHAR) AS observed_at FROM events WHERE event_type = 'view'"""
REST = f"""SELECT {TS} AS ts, 'tick' AS record_type, 'binance_rest' AS source, 'BTCUSDT' AS symbol, value AS price, NULL AS warning,
  CAST(NULL AS VARCHAR) AS observed_at FROM events WHERE event_type = 'signup'"""
CHAINLINK = f"""SELECT {TS} AS ts,
  CASE WHEN event_type = 'error' THEN 'warning' ELSE 'tick' END AS record_type, 'polymarket_rtds' AS source,
  CASE WHEN event_type = 'error' THEN 'BTC/USD' ELSE 'btc/usd' END AS symbol,
  CASE WHEN event_type <> 'error' THEN value END AS price,
  CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 1 THEN 'non_json_message' ELSE 'rtds_reconnect' END END AS warning,
  CASE WHEN event_type <> 'error' THEN {MS_ISO} END AS source_ts,
  CASE event_type WHEN 'click' THEN 'crypto_prices_chainlink' WHEN 'purchase' THEN 'crypto_prices' END AS topic,
  CASE event_type WHEN 'click' THEN 'update' WHEN 'purchase' THEN 'subscribe' END AS type,
  CASE event_type WHEN 'click' THEN 'live_update' WHEN 'purchase' THEN 'snapshot_subscribe' ELSE CASE event_id % 3 WHEN 1 THEN 'non_json_message' END END AS message_family,
  CASE WHEN event_type = 'click' THEN value END AS full_accuracy,
  CASE WHEN event_type = 'error' AND event_id % 3 = 2 THEN 'closed' END AS error
  FROM events WHERE event_type IN ('click', 'purchase') OR (event_type = 'error' AND event_id % 3 <> 0)"""
TICK = "ts, record_type, source, symbol, price, warning"
UNION = f"""SELECT 'chainlink' AS family, {TICK} FROM ({CHAINLINK})
  UNION ALL SELECT 'binance', {TICK} FROM ({BINANCE}) UNION ALL SELECT 'binance', {TICK} FROM ({REST})"""

LINES = """lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS n FROM lineitem),
books AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS poll_id, l_orderkey, n,
    l_orderkey || CASE n WHEN 0 THEN '-yes' ELSE '-no' END AS token_id,
    CASE WHEN l_returnflag = 'R' THEN 'denied' WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'bad'
      WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'empty' ELSE 'good' END AS state,
    l_extendedprice AS b, l_extendedprice * (1 + l_tax - l_discount) AS a, l_quantity AS q
  FROM lines WHERE n < 2),
snaps AS (
  SELECT poll_id, token_id, CASE WHEN state = 'good' THEN b END AS best_bid, CASE WHEN state = 'good' THEN a END AS best_ask,
    CASE WHEN state = 'good' THEN (a + b) / 2 END AS mid, CASE WHEN state = 'good' THEN a - b END AS spread,
    CASE WHEN state = 'good' THEN q END AS bid_size, CASE WHEN state = 'good' THEN q END AS ask_size,
    state <> 'good' AS is_empty, state = 'good' AND b > a AS is_crossed, state = 'good' AS fetch_ok,
    CASE state WHEN 'denied' THEN 'http_failure' WHEN 'bad' THEN 'parse_failure' END AS error_kind,
    CASE state WHEN 'denied' THEN 403 ELSE 200 END AS http_status,
    CASE state WHEN 'denied' THEN 'HTTP 403' WHEN 'bad' THEN 'could not convert a level to numbers' END AS error
  FROM books)"""
QUOTES = f"""{LINES},
quoted AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS poll_id, o_orderkey, 'm' || o_orderkey AS market_id,
    {iso_s('1704067200 + o_orderkey % 86400')} AS ts, coalesce(y.fetch_ok, false) AS yes_ok, coalesce(n.fetch_ok, false) AS no_ok,
    y.mid AS yes_mid, n.mid AS no_mid, y.spread AS yes_spread, y.error_kind AS yk, y.error AS ye, n.error_kind AS nk, n.error AS ne
  FROM orders LEFT JOIN snaps y ON y.token_id = o_orderkey || '-yes' LEFT JOIN snaps n ON n.token_id = o_orderkey || '-no'
  WHERE o_orderkey % 7 <> 0),
stated AS (SELECT *, CASE WHEN yes_ok AND no_ok THEN 'ok' WHEN yes_ok OR no_ok THEN 'partial_failure' ELSE 'failed' END AS quote_capture_status FROM quoted),
failing AS (SELECT *, CASE quote_capture_status
    WHEN 'failed' THEN 'yes=' || coalesce(yk, ye, 'unknown') || '; no=' || coalesce(nk, ne, 'unknown')
    WHEN 'partial_failure' THEN 'partial_quote_failure yes=' || coalesce(yk, 'ok') || ' no=' || coalesce(nk, 'ok') END AS last_error FROM stated)"""

MARKETS = """m AS (
  SELECT event_id AS i, ts, epoch_us(ts) // 300000000 * 300 AS s, epoch_us(ts) // 300000000 * 300 + CASE WHEN event_id % 5 = 0 THEN 600 ELSE 300 END AS z,
    'm' || (epoch_us(ts) // 300000000 * 300) || '-' || (event_id % 4) AS market_id,
    CASE WHEN event_id % 4 = 0 THEN 'other-' ELSE 'btc-updown-5m-' END || (epoch_us(ts) // 300000000 * 300) AS slug,
    CASE WHEN event_id % 8 = 0 THEN 'Bitcoin up or down, 5 minute' ELSE 'Up or down' END AS title,
    event_id % 6 <> 0 AS tokens, event_id % 9 = 0 AS closed, event_id % 10 = 3 AS nested, event_id % 11 = 4 AS listed, event_id % 13 = 5 AS broken,
    event_id % 3 = 0 AS broad, event_id % 17 = 6 AS denied FROM events)"""
RESPONSES = MARKETS + """,
r AS (
  SELECT CAST(p.event_id AS VARCHAR) AS poll_id, epoch_us(p.ts) AS now, m.*, CASE WHEN broad THEN 'broad' ELSE 'slug' END AS phase,
    m.i - p.event_id + 8 + CASE WHEN broad THEN 100 ELSE 0 END AS attempt_seq, NOT denied AND NOT broken AS ok,
    NOT denied AND NOT broken AND NOT listed AS found
  FROM events p JOIN m ON m.i BETWEEN p.event_id - 8 AND p.event_id + 8 AND m.i <> p.event_id WHERE p.event_type = 'purchase'),
c AS (
  SELECT *, CASE WHEN closed THEN 'closed' WHEN s * 1000000 <= now AND now < z * 1000000 THEN 'open' END AS status,
    CASE WHEN s * 1000000 <= now AND now < z * 1000000 THEN 'active'
      WHEN now < s * 1000000 AND s * 1000000 <= now + 1800000000 THEN 'upcoming' END AS timing,
    CASE WHEN tokens THEN 'y' || market_id END AS token_yes, CASE WHEN tokens THEN 'n' || market_id END AS token_no
  FROM r WHERE found),
j AS (
  SELECT *, CASE WHEN slug LIKE 'other-%' AND title = 'Up or down' THEN 'not_in_family' WHEN timing IS NULL THEN 'outside_relevant_window'
      WHEN NOT tokens THEN 'missing_tokens' END AS exclusion,
    abs(z - s - 300) AS d, CASE WHEN timing = 'active' THEN 0 ELSE (s * 1000000 - now) // 1000000 END AS t,
    CASE WHEN slug LIKE 'btc-%' THEN 0 ELSE 5000 END AS sp, CASE WHEN tokens THEN 0 ELSE 7500 END AS tp, CASE WHEN status = 'open' THEN 0 ELSE 1000 END AS st
  FROM c),
phased AS (
  SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY poll_id, phase, market_id, slug, s, z ORDER BY attempt_seq) = 1),
hit AS (SELECT *, max(CASE WHEN phase = 'slug' AND exclusion IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY poll_id) AS h FROM phased),
k AS (
  SELECT *, CASE WHEN timing IS NULL THEN 35000 ELSE d + t + sp + tp + st END AS score,
    CASE WHEN timing IS NULL THEN 'outside_relevant_window' ELSE timing || '; duration_off_seconds=' || d || '; timing_penalty=' || t || '; slug_penalty=' || sp
      || '; token_penalty=' || tp || '; status_penalty=' || st END AS reason
  FROM hit WHERE phase = 'slug' OR h = 0
  QUALIFY row_number() OVER (PARTITION BY poll_id, market_id, slug, s, z ORDER BY attempt_seq) = 1),
best AS (SELECT * FROM k WHERE exclusion IS NULL QUALIFY row_number() OVER (PARTITION BY poll_id ORDER BY score, attempt_seq) = 1),
polls AS (SELECT poll_id, min(now) AS now, count(*) FILTER (ok) AS n_ok, count(*) FILTER (found) AS n_extracted FROM r GROUP BY 1),
decided AS (
  SELECT p.*, b.market_id, b.slug, b.token_yes, b.token_no, b.s, b.z, b.status, b.score, b.timing,
    CASE WHEN b.poll_id IS NOT NULL THEN b.reason WHEN n_ok = 0 THEN 'gamma_http_failure' WHEN n_extracted = 0 THEN 'no_candidates_found'
      ELSE 'rows_returned_but_filtered_out' END AS why
  FROM polls p LEFT JOIN best b USING (poll_id))"""
COUNTED = "(SELECT poll_id, count(*) AS n, count(*) FILTER (exclusion IS NULL) AS f FROM k GROUP BY 1)"

HOURS = f"""ticks AS (
  SELECT CASE WHEN event_type IN ('view', 'signup') THEN 'binance' ELSE 'chainlink' END AS family, date_trunc('hour', ts) AS h,
    CASE WHEN event_type = 'error' THEN 'warning' ELSE 'tick' END AS record_type
  FROM events WHERE event_type <> 'error' OR event_id % 3 <> 0),
hours AS (
  SELECT h, count(*) FILTER (family = 'chainlink') AS n_chainlink, count(*) FILTER (family = 'binance') AS n_binance, lead(h) OVER (ORDER BY h) AS nx
  FROM ticks GROUP BY h)"""
H_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S') || '+00:00'".format


def _asof(name: str, where: str) -> str:
    return f"ASOF LEFT JOIN (SELECT ts AS {name}_ts FROM events WHERE {where}) {name} ON a.ts >= {name}_ts"


def _age(name: str) -> str:
    return f"(epoch_us(a.ts) - epoch_us({name}_ts)) / 1e6"


_HEARTBEAT = f"""WITH {QUOTES}, {RESPONSES},
told AS (SELECT epoch_us(ts) AS t, event_id, event_type FROM events WHERE event_type <> 'error' OR event_id % 3 <> 0),
ch AS (SELECT t, event_type <> 'error' OR event_id % 3 <> 2 AS up FROM told WHERE event_type IN ('click', 'purchase', 'error')),
ce AS (SELECT t AS et FROM told WHERE event_type = 'error' AND event_id % 3 = 2),
bi AS (SELECT t AS bt, event_type = 'signup' AS rest FROM told WHERE event_type IN ('view', 'signup')),
ro AS (SELECT d.now AS rt, d.market_id, d.slug, b.title, d.status, {iso_s('d.s')} AS start_time, {iso_s('d.z')} AS end_time FROM decided d LEFT JOIN best b USING (poll_id)
  QUALIFY row_number() OVER (PARTITION BY d.now ORDER BY d.poll_id DESC) = 1),
qu AS (SELECT (1704067200 + o_orderkey % 86400) * 1000000 AS qt, last_error FROM failing QUALIFY row_number() OVER (PARTITION BY o_orderkey % 86400 ORDER BY poll_id DESC) = 1),
span AS (SELECT {{low}} AS low, {{high}} AS high),
a AS (SELECT (low + i) * 300000000 AS beat FROM span, unnest(generate_series(0, high - low)) AS u(i))
SELECT {iso('a.beat')} AS ts, 'heartbeat' AS record_type, 'store' AS output_dir, 'BTC' AS asset, market_id, slug, title, status, start_time AS market_start_time, end_time AS market_end_time,
  (beat - rt) / 1e6 AS router_seconds, (beat - ch.t) / 1e6 AS chainlink_seconds, (beat - bt) / 1e6 AS binance_seconds, (beat - qt) / 1e6 AS quotes_seconds,
  coalesce(up, false) AS chainlink_connected, CASE WHEN et IS NOT NULL THEN 'closed' END AS chainlink_last_error, bt IS NOT NULL AS binance_connected, coalesce(rest, false) AS binance_rest_fallback,
  CAST(NULL AS VARCHAR) AS binance_last_error, last_error AS quote_last_error
FROM a ASOF LEFT JOIN ro ON a.beat >= rt ASOF LEFT JOIN ch ON a.beat >= ch.t ASOF LEFT JOIN ce ON a.beat >= et ASOF LEFT JOIN bi ON a.beat >= bt ASOF LEFT JOIN qu ON a.beat >= qt"""
HEARTBEATS = _HEARTBEAT.format(low="(SELECT (min(epoch_us(ts)) + 299999999) // 300000000 FROM events)", high="(SELECT max(epoch_us(ts)) // 300000000 FROM events)")
#: From the first signal to the watermark, ten minutes before the last one.
HEARTBEATS_TOLD = _HEARTBEAT.format(
    low="(SELECT (min(x) + 299999999) // 300000000 FROM (SELECT min(t) AS x FROM told UNION ALL SELECT min(qt) FROM qu))",
    high="(SELECT (max(x) // 1000 - 600000) // 300000 FROM (SELECT max(t) AS x FROM told UNION ALL SELECT max(qt) FROM qu))",
)


SEGMENT_OF = "strftime(e.ts, '%Y-%m-%d') AS segment_date, strftime(e.ts, '%H') AS segment_hour"


def oracle_sql() -> dict[str, str]:
    found = _batch_sql()
    found["segment_listing"] = found["segment_catalog"]
    found["routed_market_stream"], found["quote_rows_stream"] = found["routed_market"], found["quote_rows"]
    # Answered: whole seconds up to the watermark, ten minutes behind the last view or purchase.
    found["latest_quote_stream"] = f"""SELECT q.* FROM ({found['latest_quote_asof']}) q JOIN events e USING (event_id)
        WHERE epoch_us(e.ts) <= (SELECT (max(epoch_us(ts)) // 1000 - 600000) // 1000 * 1000000 FROM events WHERE event_type IN ('view', 'purchase'))"""
    found["manifest_stream"] = f"""SELECT * FROM ({found['segment_manifest']}) WHERE segment_end_utc <> '2024-02-01T00:00:00+00:00'
        AND segment_end_utc <= (SELECT strftime(make_timestamp((max(epoch_us(ts)) // 1000 - 600000) * 1000), '%Y-%m-%dT%H:%M:%S') FROM events WHERE event_type <> 'error' OR event_id % 3 <> 0)"""
    return found


def _batch_sql() -> dict[str, str]:
    return {
        "ticks_binance": BINANCE,
        "ticks_rest": REST,
        "ticks_chainlink": CHAINLINK,
        "ticks_union": UNION,
        "transport_events": f"""WITH x AS (SELECT event_id, event_id % 5 AS k, ts, event_id % 5 < 2 OR (event_id % 5 = 2 AND event_id % 2 = 0) AS oracle,
            CASE WHEN event_id % 3 = 0 THEN 'lost ' || event_id END AS lost FROM events)
            SELECT CASE WHEN oracle THEN 'chainlink' ELSE 'binance' END AS family, {TS} AS ts, 'warning' AS record_type,
            CASE WHEN oracle THEN 'polymarket_rtds' WHEN k = 4 THEN 'binance_rest' ELSE 'binance_ws' END AS source,
            CASE WHEN oracle THEN 'BTC/USD' ELSE 'BTCUSDT' END AS symbol, CAST(NULL AS DOUBLE) AS price,
            ['rtds_reconnect', 'missing_poly_rtds_url', 'websockets_dependency_unavailable', 'ws_reconnect_rest_fallback', 'rest_poll_failed'][k + 1] AS warning,
            CASE WHEN k = 4 THEN coalesce(lost, 'price is not a number') ELSE lost END AS error,
            '{{"url":"wss://feed.invalid/ws"}}' AS raw_payload_fragment FROM x""",
        "ticks_deep": f"""SELECT {TS} AS ts, CASE WHEN event_id % 7 = 3 THEN 'warning' ELSE 'tick' END AS record_type,
            CASE WHEN event_id % 7 <> 3 THEN value END AS price, CASE WHEN event_id % 7 = 3 THEN 'unparsed_chainlink_payload' END AS warning FROM events WHERE event_type = 'click'""",
        "candidates_deep": """WITH e AS (SELECT event_id AS i, event_id % 12 AS l FROM events WHERE event_type = 'click'),
            x AS (SELECT i, unnest(CASE WHEN l = 0 THEN ['e', 'a', 'b'] ELSE ['u', 'm', 'e', 'a', 'b'] END) || i AS market_id,
              unnest(CASE WHEN l = 0 THEN [1, 2, 3] ELSE [1, 2, 3, 4, 5] END) AS nth FROM e)
            SELECT CAST(i AS VARCHAR) AS poll_id, market_id, CAST(nth AS INT) AS nth FROM x""",
        "response_diagnostics": f"""WITH {RESPONSES} SELECT poll_id, attempt_seq, phase, ok,
            CASE WHEN denied THEN 'http_failure' WHEN broken THEN 'parse_failure' END AS error_kind,
            CASE WHEN denied THEN 'HTTP 503' WHEN broken THEN 'body is not JSON' END AS error,
            NOT broad AS exact_slug_endpoint_used, true AS browser_like_headers_applied,
            CASE WHEN ok THEN false END AS payload_empty, CASE WHEN ok THEN 1 END AS n_rows,
            CASE WHEN ok AND NOT (nested AND NOT listed) THEN slug END AS first_slug,
            CASE WHEN ok AND NOT (nested AND NOT listed) THEN {iso_s('z')} END AS first_end FROM r""",
        "quote_snapshots": f"WITH {LINES} SELECT * FROM snaps",
        "crossed_books": f"WITH {LINES} SELECT token_id, best_bid, best_ask, spread FROM snaps WHERE is_crossed",
        "quote_rows": f"""WITH {QUOTES} SELECT poll_id, ts, yes_ok OR no_ok AS quote_capture_ok, quote_capture_status, market_id, yes_mid, no_mid, yes_spread,
            CAST(0 AS DOUBLE) AS max_age_seconds FROM stated""",
        "quote_errors": f"WITH {QUOTES} SELECT poll_id, quote_capture_status, last_error FROM failing",
        "quote_warnings": f"""SELECT CAST(o_orderkey AS VARCHAR) AS poll_id, {iso_s('1704067200 + o_orderkey % 86400')} AS ts,
            'no_active_market_for_quote_poll' AS warning, 'm' || o_orderkey AS market_id FROM orders WHERE o_orderkey % 7 = 0""",
        "quote_poll_failures": f"""SELECT CAST(o_orderkey AS VARCHAR) AS poll_id, {iso_s('1704067200 + o_orderkey % 86400')} AS ts, 'warning' AS record_type,
            CASE WHEN o_orderkey % 7 = 0 THEN 'no_active_market_for_quote_poll' ELSE 'quote_poll_failed' END AS warning, 'm' || o_orderkey AS market_id,
            CASE WHEN o_orderkey % 7 <> 0 THEN 'timeout ' || o_orderkey END AS error FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 3""",
        "latest_quote_asof": """WITH t AS (SELECT CAST(user_id % 50 AS VARCHAR) AS token_id, ts, max_by(value, event_id) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2),
            a AS (SELECT event_id, CAST(user_id % 50 AS VARCHAR) AS token_id, ts FROM events WHERE event_type = 'purchase'),
            x AS (SELECT a.event_id, a.token_id, t.v, (epoch_us(a.ts) - epoch_us(t.ts)) / 1e6 AS age FROM a ASOF LEFT JOIN t ON a.token_id = t.token_id AND a.ts >= t.ts)
            SELECT event_id, token_id, CASE WHEN age <= 20000 THEN v END AS best_bid, CASE WHEN age <= 20000 THEN v + 1 END AS best_ask,
            CASE WHEN age <= 20000 THEN age END AS age_seconds FROM x""",
        "candidate_slugs": """SELECT CAST(event_id AS VARCHAR) AS poll_id, epoch_us(ts) // 300000000 * 300 AS bucket,
            'eth-updown-5m-' || (epoch_us(ts) // 300000000 * 300 + o) AS slug, CAST((o // 300 + 1) * 4 + e AS INT) AS attempt_seq,
            ['slug_exact_market_path', 'slug_market_query', 'slug_exact_event_path', 'slug_event_query'][e + 1] AS source,
            ['/markets/slug/', '/markets', '/events/slug/', '/events'][e + 1] || CASE WHEN e % 2 = 0 THEN 'eth-updown-5m-' || (epoch_us(ts) // 300000000 * 300 + o) ELSE '' END AS path
            FROM events, unnest([-300, 0, 300, 600]) AS u(o), unnest([0, 1, 2, 3]) AS w(e) WHERE event_type = 'purchase'""",
        "normalized_candidates": f"""WITH {RESPONSES} SELECT poll_id, attempt_seq, phase, market_id, slug, title, token_yes, token_no, {iso_s('s')} AS start_time, {iso_s('z')} AS end_time,
            status, 'candidate.eventStartTime' AS start_source, 'candidate.endDate' AS end_source FROM c""",
        "deduped_candidates": f"""WITH {RESPONSES} SELECT poll_id, attempt_seq, market_id, slug, token_yes, {iso_s('z')} AS end_time FROM c
            QUALIFY row_number() OVER (PARTITION BY poll_id, market_id, slug, s, z ORDER BY attempt_seq) = 1""",
        "filter_waterfall": f"""WITH {RESPONSES} SELECT poll_id, count(*) AS normalized_total, count(*) FILTER (exclusion IS DISTINCT FROM 'not_in_family') AS family_match,
            count(*) FILTER (exclusion IS NULL OR exclusion = 'missing_tokens') AS time_relevant, count(*) FILTER (exclusion IS NULL) AS token_complete,
            0 AS parse_failure, count(*) FILTER (exclusion IS NULL) AS filtered_final, 0 AS excluded_missing_market_window,
            count(*) FILTER (exclusion = 'not_in_family') AS excluded_not_in_family, count(*) FILTER (exclusion = 'outside_relevant_window') AS excluded_outside_relevant_window,
            count(*) FILTER (exclusion = 'missing_tokens') AS excluded_missing_tokens FROM k GROUP BY 1""",
        "scored_candidates": f"""WITH {RESPONSES} SELECT poll_id, attempt_seq, market_id, exclusion, CASE WHEN exclusion IS NULL THEN timing END AS selection_bucket,
            CAST(score AS INT) AS score, reason FROM k""",
        "routed_market": f"""WITH {RESPONSES} SELECT d.poll_id, 'BTC' AS asset, market_id, slug, token_yes, token_no, {iso_s('s')} AS start_time, {iso_s('z')} AS end_time, status,
            CAST(score AS INT) AS routing_score, why AS routing_reason, timing AS selection_mode, n_ok, coalesce(n, 0) AS n_candidates, coalesce(f, 0) AS n_final
            FROM decided d LEFT JOIN {COUNTED} q USING (poll_id)""",
        "route_failures": f"WITH {RESPONSES} SELECT poll_id, why AS routing_reason, n_ok, n_extracted FROM decided WHERE score IS NULL",
        "route_results": f"""WITH {RESPONSES},
            numbered AS (SELECT *, row_number() OVER (PARTITION BY poll_id ORDER BY attempt_seq) AS n_all, row_number() OVER (PARTITION BY poll_id, exclusion ORDER BY attempt_seq) AS n_why FROM k),
            both_of AS (SELECT poll_id, count(*) AS n_both, count(*) FILTER (exclusion IS NULL) AS f_both, string_agg(slug, ',' ORDER BY attempt_seq) FILTER (n_all <= 8) AS first_slugs,
              coalesce(string_agg({iso_s('z')}, ',' ORDER BY attempt_seq) FILTER (exclusion IS NULL AND n_why <= 8), '') AS final_ends,
              coalesce(string_agg(slug, ',' ORDER BY attempt_seq) FILTER (exclusion = 'not_in_family' AND n_why <= 8), '') AS strangers FROM numbered GROUP BY 1),
            phases AS (SELECT poll_id, count(*) FILTER (phase = 'slug') AS n_slug, count(*) FILTER (phase = 'slug' AND exclusion IS NULL) AS f_slug, count(*) FILTER (phase = 'broad') AS n_broad FROM phased GROUP BY 1),
            sent AS (SELECT poll_id, max(broad) AS broad_attempted, string_agg(attempt_seq || ':' || CASE WHEN denied THEN 'http_failure' WHEN broken THEN 'parse_failure' ELSE 'ok' END
              || CASE WHEN ok THEN CASE WHEN found THEN ':1' ELSE ':0' END ELSE '' END, ',' ORDER BY attempt_seq) AS requests FROM r GROUP BY 1),
            b AS (SELECT poll_id, title, CASE WHEN broad THEN 'broad_market_open_scan:/markets' ELSE 'slug_exact_market_path:/markets/slug/' || slug END AS detection_source FROM best)
            SELECT d.poll_id, why AS routing_reason, detection_source, b.title, d.now // 300000000 * 300 AS bucket_ts,
              array_to_string(list_transform([-300, 0, 300, 600], lambda o: 'btc-updown-5m-' || (d.now // 300000000 * 300 + o)), ',') AS slugs, requests,
              coalesce(n_slug, 0) AS n_slug, coalesce(f_slug, 0) AS f_slug, broad_attempted, coalesce(n_broad, 0) AS n_broad, coalesce(n_both, 0) AS n_both, coalesce(f_both, 0) AS f_both,
              timing AS mode, first_slugs, final_ends, strangers
            FROM decided d JOIN sent USING (poll_id) LEFT JOIN phases USING (poll_id) LEFT JOIN both_of USING (poll_id) LEFT JOIN b USING (poll_id)""",
        "attempt_summary": f"""WITH {RESPONSES} SELECT poll_id, attempt_seq, ok, CASE WHEN ok THEN CASE WHEN found THEN 1 ELSE 0 END END AS extracted_candidate_count,
            CASE WHEN found THEN market_id END AS first_market_id FROM r""",
        "route_changes": f"""WITH {RESPONSES}, w AS (SELECT *, CASE WHEN score IS NOT NULL THEN concat_ws('|', market_id, slug, token_yes, token_no, s, z) END AS id FROM decided)
            SELECT poll_id, {iso('now')} AS ts, 'BTC' AS asset, 'market_route' AS record_type, market_id,
            id IS DISTINCT FROM lag(id) OVER (ORDER BY now, poll_id) AS market_changed FROM w""",
        "route_backfill": f"""WITH {MARKETS}, u AS (SELECT DISTINCT market_id, slug, title, tokens, s, z, closed FROM m),
            a AS (SELECT event_id, epoch_us(ts) AS now FROM events WHERE event_type = 'click'),
            x AS (SELECT event_id, u.*, CASE WHEN s * 1000000 <= now THEN 'active' ELSE 'upcoming' END AS bucket,
              abs(z - s - 300) + CASE WHEN s * 1000000 <= now THEN 0 ELSE (s * 1000000 - now) // 1000000 END + CASE WHEN slug LIKE 'btc-%' THEN 0 ELSE 5000 END
              + CASE WHEN closed THEN 1000 ELSE 0 END AS score
              FROM a JOIN u ON s * 1000000 - 1800000000 <= now AND now < z * 1000000 WHERE tokens AND (slug LIKE 'btc-%' OR title <> 'Up or down'))
            SELECT event_id AS instant_id, market_id, slug, CAST(score AS INT) AS score, bucket AS selection_bucket, n_relevant FROM (
              SELECT *, count(*) OVER (PARTITION BY event_id) AS n_relevant, row_number() OVER (PARTITION BY event_id ORDER BY score, s, market_id, slug, bucket) AS n FROM x)
            WHERE n = 1""",
        "catalogue_window_scan": f"""WITH {MARKETS} SELECT market_id, z AS end_s FROM (SELECT DISTINCT market_id, z FROM m WHERE NOT closed
            AND z BETWEEN 1705276800 - 604800 AND 1705276800 + 604800 ORDER BY z, market_id LIMIT 200 OFFSET 200)""",
        "heartbeat_freshness": f"""SELECT event_id AS id, {_age('router')} AS router_seconds, {_age('chainlink')} AS chainlink_seconds, {_age('binance')} AS binance_seconds,
            {_age('quotes')} AS quotes_seconds FROM (SELECT * FROM events WHERE event_type = 'signup') a
            {_asof('router', "event_type = 'purchase'")} {_asof('chainlink', "event_type = 'click'")} {_asof('binance', "event_type = 'view'")} {_asof('quotes', "event_type = 'error'")}""",
        "heartbeat_state": """WITH a AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase'),
            b AS (SELECT ts, event_type = 'signup' AS rest FROM events WHERE event_type IN ('view', 'signup')),
            c AS (SELECT ts, NOT (event_type = 'error' AND event_id % 3 = 2) AS up FROM events WHERE event_type IN ('click', 'purchase') OR (event_type = 'error' AND event_id % 3 <> 0)),
            d AS (SELECT ts, 'closed' AS error FROM events WHERE event_type = 'error' AND event_id % 3 = 2)
            SELECT a.event_id AS id, coalesce(up, false) AS chainlink_connected, d.error AS chainlink_last_error, rest IS NOT NULL AS binance_connected,
            coalesce(rest, false) AS binance_rest_fallback, CAST(NULL AS VARCHAR) AS binance_last_error
            FROM a ASOF LEFT JOIN b ON a.ts >= b.ts ASOF LEFT JOIN c ON a.ts >= c.ts ASOF LEFT JOIN d ON a.ts >= d.ts""",
        "heartbeat_market": f"""WITH {RESPONSES}, a AS (SELECT event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'),
            o AS (SELECT * FROM decided QUALIFY row_number() OVER (PARTITION BY now ORDER BY poll_id DESC) = 1)
            SELECT a.event_id AS id, market_id, slug, status FROM a ASOF LEFT JOIN o ON a.t >= o.now""",
        "heartbeat_quote_error": f"""WITH {QUOTES}, a AS (SELECT event_id, event_id % 86400 AS t FROM events WHERE event_type = 'click'),
            o AS (SELECT o_orderkey % 86400 AS t, last_error FROM failing QUALIFY row_number() OVER (PARTITION BY o_orderkey % 86400 ORDER BY poll_id DESC) = 1)
            SELECT a.event_id AS id, last_error AS quote_last_error FROM a ASOF LEFT JOIN o ON a.t >= o.t""",
        "heartbeat_cadence": """WITH span AS (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM events)
            SELECT low + i * 300000000 AS ts_us FROM span, unnest(generate_series(0, (high - low) // 300000000)) AS u(i)""",
        "heartbeat_rows": HEARTBEATS,
        "heartbeat_stream": HEARTBEATS_TOLD,
        "manifest_roundtrip": f"""WITH {HOURS} SELECT strftime(h, '%Y-%m-%d') AS segment_date, strftime(h, '%H') AS segment_hour, {H_ISO('h')} AS segment_start_utc,
            {H_ISO('nx')} AS segment_end_utc, true AS closed_cleanly, 'BTC' AS asset, 'store' AS output_root, n_chainlink, n_binance FROM hours WHERE nx IS NOT NULL""",
        "segment_manifest": f"""WITH {HOURS} SELECT {H_ISO('h')} AS segment_start_utc, {H_ISO("coalesce(nx, TIMESTAMP '2024-02-01')")} AS segment_end_utc, true AS closed_cleanly,
            'hourly-segment-rotation-v1' AS recorder_version, 'BTC' AS asset, n_chainlink, n_binance, 0 AS n_quotes, 0 AS n_meta, 0 AS n_heartbeat FROM hours""",
        "segment_catalog": f"""WITH {HOURS} SELECT strftime(h, '%Y-%m-%d') AS segment_date, strftime(h, '%H') AS segment_hour,
            CASE WHEN nx IS NULL THEN 'active' ELSE 'closed' END AS state, {H_ISO('nx')} AS segment_end_utc FROM hours""",
        "latest_segment": f"""WITH {HOURS} SELECT {H_ISO('h')} AS segment_start_utc, {H_ISO('nx')} AS segment_end_utc, n_binance FROM hours WHERE nx IS NOT NULL ORDER BY h DESC LIMIT 1""",
        "jsonl_roundtrip": f"""SELECT {TICK}, observed_at, substr(ts, 1, 10) AS segment_date, substr(ts, 12, 2) AS segment_hour FROM ({BINANCE} UNION ALL {REST})""",
        "hourly_counts_stream": f"WITH {HOURS} SELECT {H_ISO('h')} AS segment_start, family, record_type, count(*) AS n_rows FROM ticks GROUP BY h, family, record_type",
        "ticks_stream": f"SELECT *, substr(ts, 1, 10) AS segment_date, substr(ts, 12, 2) AS segment_hour FROM ({UNION})",
        "route_changes_stream": f"""WITH {RESPONSES}, w AS (SELECT *, CASE WHEN score IS NOT NULL THEN concat_ws('|', market_id, slug, token_yes, token_no, s, z) END AS id FROM decided)
            SELECT poll_id, {iso('now')} AS ts, 'BTC' AS asset, market_id, id IS DISTINCT FROM lag(id) OVER (ORDER BY now, poll_id) AS market_changed FROM w""",
    }
