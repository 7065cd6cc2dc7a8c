"""Column expressions over timestamps, numbers and VARIANT values.

They follow the recorder's reading of loosely typed JSON: values are chosen by
truthiness, numbers may be quoted, timestamps are ISO-8601 or epoch values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ISO = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)?)?$"
)
_FULL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$"
_FLOAT = r"^[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"
#: A decimal as most payloads write it.
PLAIN_NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"
#: Beginnings of texts that no falsy value has.
_SURE = r"^[a-eg-zA-Z1-9]"
_SPECIAL = r"^[+-]?(?i:inf|infinity|nan)$"


# --- VARIANT ----------------------------------------------------------------


def parse(raw: Column) -> Column:
    """VARIANT of a JSON text; NULL where it is none."""
    return F.try_parse_json(raw)


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a number type; NULL for NULL. Writes
    the schema of the whole value: the tests below are cheaper."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z_]+", 0)


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "struct<_:variant>").isNotNull()


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def is_number(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))


def is_true(v: Column) -> Column:
    """The JSON value true, not a text or number that reads like it."""
    return let(v, lambda x: (F.schema_of_variant(x) == "BOOLEAN") & F.try_variant_get(x, "$", "boolean"))


def let(x: Column, body) -> Column:
    """body(x) with x evaluated once and named, instead of copied into every use."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns computed once per row. The optimizer copies a plain
    column's expression into all its uses, and nested ones grow without bound; it
    does not copy through a generator."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def settled(rows: DataFrame, /, **columns: Column) -> DataFrame:
    """rows with columns computed once per row, as computed() does, by compiled code:
    a generator evaluates what it is given by interpretation, so it only passes on
    here what the projection below it has computed."""
    below = rows.withColumns({f"_{name}": c for name, c in columns.items()})
    kept = [F.col(c) for c in rows.columns if c not in columns]
    return below.select(*kept, F.inline(F.array(F.struct(*[F.col(f"_{name}").alias(name) for name in columns]))))


def get(v: Column, key: str) -> Column:
    """Member of an object (JSON null included); NULL for anything else."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def items(v: Column) -> Column:
    """Elements of an array; NULL for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def text(v: Column) -> Column:
    """Text of a scalar, JSON text of an array or object; NULL for JSON null."""
    return F.try_variant_get(v, "$", "string")


def is_truthy(v: Column) -> Column:
    """Not null, false, zero, or an empty text, list or object."""

    def told(t: Column) -> Column:
        # Texts of what is not truthy; the texts themselves are.
        zero = t.rlike("^-?[0.]") & (t.try_cast("double") == 0)
        like = t.isin("false", "[]", "{}") | F.coalesce(zero, F.lit(False))
        return t.isNotNull() & (t != "") & (~like | (F.schema_of_variant(v) == "STRING"))

    return F.coalesce(let(text(v), told), F.lit(False))


def first_truthy(*values: Column) -> Column:
    """The first truthy of several VARIANT values; coalesce would also take 0 or ''.
    Later values are not looked at once one is found."""
    return F.coalesce(*[let(v, lambda x: F.when(is_truthy(x), x)) for v in values])


def truthy(v: Column) -> Column:
    """v, or NULL where it is not truthy."""
    return first_truthy(v)


def first_text(v: Column, *keys: str) -> Column:
    """Text of the first truthy member."""
    return text(first_truthy(*[get(v, k) for k in keys]))


def quick_text(v: Column, *keys: str) -> Column:
    """first_text() by paths: texts that no falsy value has are taken as they are."""

    def one(key: str) -> Column:
        t = F.try_variant_get(v, f"$.{key}", "string")
        return F.when(t.rlike(_SURE), t).when(t.isNotNull(), first_text(v, key))

    return F.coalesce(*[one(k) for k in keys])


# --- numbers ----------------------------------------------------------------


def float_text(s: Column) -> Column:
    """A text as double by the rules of a float literal: signs, underscores
    between digits, exponents, inf and nan; no type suffixes, no hex."""
    plain = lambda t: F.when(t.rlike(_FLOAT), F.regexp_replace(t, "_", "")).when(t.rlike(_SPECIAL), t)
    return let(F.trim(s), plain).try_cast("double")


def number(v: Column) -> Column:
    """A scalar VARIANT as double; booleans count 1 and 0; NULL for the rest."""
    return let(
        v,
        lambda x: F.when(is_number(x), F.try_variant_get(x, "$", "double"))
        .when(is_string(x), float_text(text(x)))
        .when(F.schema_of_variant(x) == "BOOLEAN", F.when(F.try_variant_get(x, "$", "boolean"), 1.0).otherwise(0.0)),
    )


def quick_number(v: Column, key: str) -> Column:
    """number() of a member by its path: a plain decimal, a text or not, is read as it
    stands; anything else the general way."""
    t = F.try_variant_get(v, f"$.{key}", "string")
    return F.when(t.rlike(PLAIN_NUMBER), t.try_cast("double")).when(t.isNotNull(), number(get(v, key)))


def _spread(node: Column, keys: tuple[str, ...]) -> Column:
    members = F.array_compact(F.array(*[get(node, k) for k in dict.fromkeys((*keys, "data", "payload", "event", "price"))]))
    return F.when(is_object(node), members).when(is_array(node), F.try_variant_get(node, "$", "array<variant>")).otherwise(F.array(node))


def nesting(json: Column) -> Column:
    """Levels of lists and objects in a JSON text: 0 for a scalar, at least."""
    # Escaped characters go first, so that a text ends at the next quotation mark.
    texts = F.regexp_replace(F.regexp_replace(json, r"\\.", ""), '"[^"]*"', "")
    marks = F.regexp_replace(texts, r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at: Column, mark: Column) -> Column:
        now = at["now"] + F.when(mark.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(F.filter(F.split(marks, ""), lambda c: c != ""), start, step, lambda at: at["most"])


def unfolded(v: Column, start: Column, step) -> Column:
    """``start``, an array, after as many rounds of step(array) as v has levels: what
    is unfolded level by level has then come to its end, however deep it is."""
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), nesting(F.to_json(v))))
    return F.aggregate(rounds, start, lambda nodes, _: step(nodes))


def find_numeric(v: Column, keys: tuple[str, ...]) -> Column:
    """First number in depth-first order: an object's keys in the order given,
    then data, payload, event, price; a list's elements in order. At any depth; a
    scalar and an object's first key are looked at before anything is unfolded."""
    direct = lambda x: F.coalesce(number(x), number(get(x, keys[0])))
    level = lambda nodes: F.flatten(F.transform(nodes, lambda n: _spread(n, keys)))
    leaves = lambda x: unfolded(x, F.when(x.isNotNull(), F.array(x)), level)
    deep = lambda x: F.get(F.filter(F.transform(leaves(x), number), lambda n: n.isNotNull()), F.lit(0))
    return let(v, lambda x: F.coalesce(direct(x), F.when(is_object(x) | is_array(x), deep(x))))


def quick_find(v: Column, keys: tuple[str, ...]) -> Column:
    """find_numeric() by paths: a plain decimal at an object's first key is what the
    search meets first."""
    t = F.try_variant_get(v, f"$.{keys[0]}", "string")
    return F.when(t.rlike(PLAIN_NUMBER), t.try_cast("double")).when(v.isNotNull(), find_numeric(v, keys))


# --- time -------------------------------------------------------------------


def full_datetime(s: Column) -> Column:
    """parse_datetime() of a text of the full form; NULL for others."""
    return F.when(s.rlike(_FULL), s.try_cast("timestamp"))


def parse_datetime(s: Column) -> Column:
    """ISO-8601 text to a UTC instant; NULL for blanks and anything else.

    Not read: week dates, offsets with seconds, separators other than T or a
    space, and a zone right after a date."""

    def repaired(x: Column) -> Column:
        t = F.regexp_replace(x, ",", ".")
        t = F.regexp_replace(t, "^([0-9]{4})([0-9]{2})([0-9]{2})(?=$|[T ])", "$1-$2-$3")
        t = F.regexp_replace(t, "^(.{10}[T ][0-9]{2})([0-9]{2})([0-9]{2})?", "$1:$2:$3")
        t = F.regexp_replace(t, ":(?=$|[Z+.-])", "")
        t = F.regexp_replace(t, "^(.{10}[T ][0-9]{2})(?=$|[Z+-])", "$1:00")
        return F.regexp_replace(t, "^(.{10}[T ][0-9]{2}:[0-9]{2})(?=$|[Z+-])", "$1:00")

    # Most texts have the full form already.
    whole = lambda x: F.when(x.rlike(_FULL), x.try_cast("timestamp")).otherwise(let(repaired(x), lambda t: F.when(t.rlike(_ISO), t.try_cast("timestamp"))))
    return let(F.trim(s), whole)


def datetime_of(s: Column) -> Column:
    """parse_datetime() of a plain column: texts of the full form by compiled code."""
    return F.coalesce(full_datetime(s), parse_datetime(s))


def iso(ts: Column) -> Column:
    """ISO text in UTC, with microseconds only where there are some."""
    return let(
        ts,
        lambda t: F.concat(
            F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"),
            F.when(F.unix_micros(t) % 1_000_000 == 0, "").otherwise(F.date_format(t, ".SSSSSS")),
            F.lit("+00:00"),
        ),
    )


def iso_of(ts: Column) -> Column:
    """iso() of a plain column, compiled."""
    part = F.when(F.unix_micros(ts) % 1_000_000 == 0, "").otherwise(F.date_format(ts, ".SSSSSS"))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("+00:00"))


def iso_or_text(s: Column) -> Column:
    """ISO text of a timestamp text, or the text itself where it is none."""
    return F.when(F.trim(s) == "", None).otherwise(F.coalesce(iso(parse_datetime(s)), s))


def seconds_since(now: Column, then: Column) -> Column:
    """Age in seconds, at least 0; NULL if either is unknown."""
    age = (F.unix_micros(now) - F.unix_micros(then)) / 1e6
    return F.when(age.isNotNull(), F.greatest(F.lit(0.0), age))


def source_time(v: Column) -> Column:
    """Epoch seconds, or milliseconds above ten billion, to ISO text; other
    values as their text; NULL for null and ''."""

    def known(n: Column) -> Column:
        at = F.when(n > 10_000_000_000, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n))
        return F.when(n.between(-62_135_596_800, 253_402_300_799_000), iso(at))

    def one(x: Column) -> Column:
        n = F.when(is_number(x), F.try_variant_get(x, "$", "double").cast("long")).when(text(x).rlike("^[0-9]+$"), text(x).try_cast("long"))
        return F.when(text(x) != "", F.coalesce(let(n, known), text(x)))

    return let(v, one)


def quick_source_time(v: Column, *keys: str) -> Column:
    """source_time() of the first truthy member; whole seconds or milliseconds of up to
    15 digits at the first key are read by its path."""
    t = F.try_variant_get(v, f"$.{keys[0]}", "string")
    n = F.when(t.rlike("^[1-9][0-9]{0,14}$"), t.try_cast("long"))
    at = F.when(n.between(1, 10_000_000_000), F.timestamp_seconds(n)).when(n <= 253_402_300_799_000, F.timestamp_millis(n))
    whole = source_time(first_truthy(*[get(v, k) for k in keys]))
    return F.when(n <= 253_402_300_799_000, iso_of(at)).when(v.isNotNull(), whole)


def age_text(age: Column) -> Column:
    """12.3s, or n/a."""
    return F.when(age.isNull(), "n/a").otherwise(F.format_string("%.1fs", age))


# --- lists and payload rows ---------------------------------------------------


def json_list(v: Column) -> Column:
    """A list, or the text of a list, as array; else NULL."""
    return let(v, lambda x: F.coalesce(items(x), items(F.try_parse_json(F.when(is_string(x), text(x))))))


def payload_rows(v: Column) -> Column:
    """Objects of a list, or of the first list among items, data, markets and
    events; the payload itself if it is an object without one; else empty."""
    objects = lambda a: F.filter(a, is_object)
    none = F.array().cast("array<variant>")
    plain = is_object(v) & F.coalesce(*[get(v, k) for k in ("items", "data", "markets", "events")]).isNull()
    return F.when(plain, F.array(v)).otherwise(let(
        v,
        lambda x: F.when(is_array(x), objects(items(x)))
        .when(is_object(x), F.coalesce(objects(F.coalesce(*[items(get(x, k)) for k in ("items", "data", "markets", "events")])), F.array(x)))
        .otherwise(none),
    ))


def series_text(s: Column) -> Column:
    """Lower-case text without outer spaces; '' for NULL."""
    return F.lower(F.trim(F.coalesce(s, F.lit(""))))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
