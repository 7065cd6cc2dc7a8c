"""Schemas of landed and recorded tables, as DDL."""

RAW_FRAMES = "feed string, received_ts timestamp, raw string, event string, error string, url string"
BOOK_RESPONSES = (
    "poll_id string, poll_ts timestamp, asset string, token_id string, http_status int, transport string, failure string, error string, body string"
)
CATALOG_RESPONSES = (
    "poll_id string, poll_ts timestamp, asset string, phase string, attempt_seq int, source string, slug string, path string, "
    "params map<string,string>, headers_applied map<string,string>, http_status int, failure string, error string, body string"
)

CHAINLINK = (
    "ts string, received_ts string, record_type string, source string, source_ts string, symbol string, value double, price double, topic string, "
    "type string, message_family string, full_accuracy_value string, warning string, error string, raw_payload_fragment string"
)
BINANCE = (
    "ts string, record_type string, source string, symbol string, price double, observed_at string, warning string, error string, raw_payload_fragment string"
)
_SIDE = (
    "struct<fetch_ok:boolean,error_kind:string,http_status:int,transport:string,best_bid:double,best_ask:double,mid:double,spread:double,"
    "age_seconds:double,error:string>"
)
QUOTES = (
    "ts string, record_type string, source string, quote_capture_ok boolean, quote_capture_status string, market_id string, slug string, title string, "
    "condition_id string, token_yes string, token_no string, market_start_time string, market_end_time string, status string, "
    f"yes {_SIDE}, no {_SIDE}, quote_age_diagnostics struct<yes_age_seconds:double,no_age_seconds:double,max_age_seconds:double>, "
    "raw_payload_fragment string, warning string, error string, asset string"
)
META = (
    "ts string, record_type string, market_changed boolean, market struct<market_id:string,slug:string,title:string,condition_id:string,token_yes:string,"
    "token_no:string,start_time:string,end_time:string,status:string,detection_source:string,routing_reason:string,routing_score:int>, "
    "routing_reason string, detection_source string, diagnostics string, asset string"
)
HEARTBEAT = (
    "ts string, record_type string, output_dir string, active_market struct<market_id:string,slug:string,title:string,status:string,"
    "market_start_time:string,market_end_time:string>, freshness_seconds struct<router:double,chainlink:double,binance:double,quotes:double>, "
    "transport_state struct<chainlink_connected:boolean,chainlink_last_error:string,binance_connected:boolean,binance_rest_fallback:boolean,"
    "binance_last_error:string,quote_last_error:string>, asset string"
)
RECORDED = {"chainlink": CHAINLINK, "binance": BINANCE, "quotes": QUOTES, "meta": META, "heartbeat": HEARTBEAT}
PARTITIONS = "segment_date string, segment_hour string"
"""Texts: inference would turn hour 09 into 9 and the date into a DATE."""

SEGMENTS = (
    "segment_start_utc string, segment_end_utc string, closed_cleanly boolean, row_counts map<string,bigint>, recorder_version string, "
    "asset string, output_root string"
)
