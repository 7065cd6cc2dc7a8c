import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr as E


def values(spark, rows, column):
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string").select("i", column(F.col("s")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in got]


def as_python(text):
    """The reading that parse_datetime follows."""
    t = (text or "").strip().replace("Z", "+00:00") if (text or "").strip().endswith("Z") else (text or "").strip()
    if not t:
        return None
    try:
        at = datetime.fromisoformat(t)
    except ValueError:
        return None
    return at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)


def test_parse_datetime(spark):
    texts = [
        "2026-04-18T20:00:00Z", "2026-04-18T20:00:00+02:00", "2026-04-18 20:00:00.123456", "2026-04-18", "20260418", "20260418T200000Z", "2026-04-18T20:00Z",
        "2026-04-18T20:00:00,5Z", " 2026-04-18T20:00:00Z ", "2026", "2026-04", "2026-4-8", "20:00", "T20:00", "2026-04-18T20:00:00 UTC", "", None, "soon",
    ]
    got = values(spark, texts, E.parse_datetime)
    want = [as_python(t) for t in texts]
    assert [g and g.replace(tzinfo=timezone.utc) for g in got] == want


def test_iso_has_microseconds_only_where_there_are_some(spark):
    texts = ["2026-04-18T20:00:00Z", "2026-04-18T20:00:00.000120Z"]
    assert values(spark, texts, lambda s: E.iso(E.parse_datetime(s))) == [as_python(t).isoformat() for t in texts]


def test_float_text_follows_float_literals(spark):
    texts = ["1.5", " 2 ", "1_000", "1.5d", "1.5f", "0x1p3", "1__0", "-1e3", ".5", "5.", "inf", "x", ""]

    def python(t):
        try:
            return float(t)
        except ValueError:
            return None

    assert values(spark, texts, E.float_text) == [python(t) for t in texts]


def test_truthiness_is_not_coalesce(spark):
    rows = ['{"a":0,"b":"0"}', '{"a":"","b":[]}', '{"a":false,"b":{}}', '{"a":null,"b":2}', "7", '{"a":0.0,"b":true}']
    got = values(spark, rows, lambda s: E.first_text(E.parse(s), "a", "b"))
    assert got == ["0", None, None, "2", None, "true"]


def test_find_numeric_order_and_depth(spark):
    rows = ['{"value":"x","price":{"data":["y","3.5"]}}', '[{"a":1},{"value":true}]', '{"payload":{"data":[{"value":4}]}}', '"2"', '{"a":1}',
            '{"data":{"data":{"data":{"data":{"data":{"data":{"value":1}}}}}}}']
    keys = ("value", "price")
    assert values(spark, rows, lambda s: E.find_numeric(E.parse(s), keys)) == [3.5, 1.0, 4.0, 2.0, None, 1.0]


def _numeric(x, keys):
    """The search written as a recursion over parsed JSON."""
    if isinstance(x, (bool, int, float)):
        return float(x)
    if isinstance(x, str):
        try:
            return float(x)
        except ValueError:
            return None
    inner = [x.get(k) for k in (*keys, "data", "payload", "event", "price")] if isinstance(x, dict) else x if isinstance(x, list) else []
    return next((n for n in (_numeric(i, keys) for i in inner) if n is not None), None)


@pytest.mark.parametrize("seed", range(3))
def test_find_numeric_against_recursion(spark, seed):
    r = random.Random(seed)

    def tree(levels):
        if not levels or r.random() < 0.15:
            return r.choice([1, "2.5", "no", True, None, "[{", 'a"b\\', {}, []])
        if r.random() < 0.4:
            return [tree(levels - 1) for _ in range(r.randrange(3))]
        return {k: tree(levels - 1) for k in r.sample(["value", "price", "data", "payload", "event", "other", "x]"], r.randrange(1, 4))}

    rows = [json.dumps(tree(r.choice([2, 5, 14]))) for _ in range(120)]
    keys = ("value", "price")
    got = values(spark, rows, lambda s: E.find_numeric(E.parse(s), keys))
    assert got == [_numeric(json.loads(x), keys) for x in rows]


def test_source_time(spark):
    rows = ['1713470400123', '"1713470400"', '"soon"', '""', "null", "1713470400.9"]
    want = ["2024-04-18T20:00:00.123000+00:00", "2024-04-18T20:00:00+00:00", "soon", None, None, "2024-04-18T20:00:00+00:00"]
    assert values(spark, rows, lambda s: E.source_time(E.parse(s))) == want


def test_payload_rows(spark):
    rows = ['[{"a":1},2]', '{"markets":[{"a":1},{"b":2}]}', '{"a":1}', '"x"', '{"data":[]}']
    assert values(spark, rows, lambda s: F.size(E.payload_rows(E.parse(s)))) == [1, 2, 1, 0, 0]


def test_ages(spark):
    row = spark.sql("select timestamp '2024-01-01 00:00:10' a, timestamp '2024-01-01 00:00:04.5' b, cast(null as timestamp) n").select(
        E.seconds_since(F.col("a"), F.col("b")).alias("x"), E.seconds_since(F.col("b"), F.col("a")).alias("y"), E.seconds_since(F.col("a"), F.col("n")).alias("z"),
        E.age_text(F.lit(12.34)).alias("t"), E.age_text(F.lit(None).cast("double")).alias("u")).first()
    assert (row.x, row.y, row.z, row.t, row.u) == (5.5, 0.0, None, "12.3s", "n/a")


@pytest.mark.parametrize("text,size", [('["a","b"]', 2), ('"[1]"', 1), ('"x"', None), ("{}", None)])
def test_json_list(spark, text, size):
    got = values(spark, [text], lambda s: E.json_list(E.parse(s)))[0]
    assert (got if got is None else len(got)) == size
