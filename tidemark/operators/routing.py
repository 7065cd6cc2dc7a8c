"""Which market is current: catalogue responses to one routed market per poll.

Polls see only their own responses, so everything from candidates to the
selected market is one shuffle on poll_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PROFILES, SETTINGS, AssetProfile, Settings
from ..functions import expr as E
from ..sources.workdir import stored
from .asof import interval_join
from .diagnostics import classified, failure_reasons

IDENTITY = ["market_id", "slug", "condition_id", "token_yes", "token_no", "start_time", "end_time"]
# Labels and keys of the two sides.
_SIDES = {"yes": (("yes", "up"), ("yesTokenId", "tokenYes", "token_yes")), "no": (("no", "down"), ("noTokenId", "tokenNo", "token_no"))}
DEDUPE_KEY = ["market_id", "condition_id", "slug", "start", "end"]


# --- slugs and attempts -------------------------------------------------------


def bucket(ts: Column, seconds: int = SETTINGS.target_seconds) -> Column:
    return (F.floor(F.unix_seconds(ts) / seconds) * seconds).cast("long")


def profile_table(spark, profiles: tuple[AssetProfile, ...] = PROFILES) -> DataFrame:
    """One row per asset profile."""
    rows = [(p.asset, p.slug_prefix, list(p.keywords), list(p.five_minute_words)) for p in profiles]
    return spark.createDataFrame(rows, "asset string, slug_prefix string, keywords array<string>, five_minute_words array<string>")


def candidate_slugs(polls: DataFrame, profiles: tuple[AssetProfile, ...] = PROFILES) -> DataFrame:
    """polls (poll_id, poll_ts, asset) by the slugs of the bucket before, the
    current one and the two after, with the request order of each endpoint."""
    prefix = F.broadcast(profile_table(polls.sparkSession, profiles).select("asset", "slug_prefix"))  # one row per profile
    # Endpoints in request order.
    endpoints = [
        ("slug_exact_market_path", "/markets/slug/"), ("slug_market_query", "/markets"),
        ("slug_exact_event_path", "/events/slug/"), ("slug_event_query", "/events"),
    ]
    ends = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(p).alias("path")) for s, p in endpoints])
    slugs = polls.join(prefix, "asset").select(
        "poll_id", "poll_ts", "asset", bucket(F.col("poll_ts")).alias("bucket"), "slug_prefix",
        F.posexplode(F.sequence(F.lit(-300), F.lit(600), F.lit(300))).alias("slug_seq", "shift"),
    ).withColumn("slug", F.concat("slug_prefix", (F.col("bucket") + F.col("shift")).cast("string")))
    return slugs.select("poll_id", "poll_ts", "asset", "bucket", "slug_seq", "slug", F.posexplode(ends).alias("end_seq", "e")).select(
        "poll_id", "poll_ts", "asset", "bucket", "slug",
        (F.col("slug_seq") * len(endpoints) + F.col("end_seq")).alias("attempt_seq"),
        F.col("e.source").alias("source"),
        F.when(F.col("e.path").endswith("/"), F.concat("e.path", "slug")).otherwise(F.col("e.path")).alias("path"),
    )


def window_scan(catalogue: DataFrame, now: Column, *, page: int = 0, reach_seconds: int = 1800, settings: Settings = SETTINGS) -> DataFrame:
    """One page of open markets of a catalogue table (market_id, end_date,
    closed) that end within reach of now, by end and id."""
    low, high = now - F.make_interval(secs=F.lit(reach_seconds)), now + F.make_interval(secs=F.lit(reach_seconds))
    return (
        catalogue.where(~F.coalesce("closed", F.lit(False)) & F.col("end_date").between(low, high))
        .orderBy("end_date", "market_id")
        .offset(page * settings.page_limit)
        .limit(settings.page_limit)
    )


# --- candidates ---------------------------------------------------------------


def _objects(v: Column) -> Column:
    return F.filter(F.coalesce(E.items(v), F.array().cast("array<variant>")), E.is_object)


def _with_markets(node: Column) -> Column:
    """node, then its market and markets: objects, or objects of lists."""
    listed = lambda v: F.coalesce(E.items(v), F.when(v.isNotNull(), F.array(v)), F.array().cast("array<variant>"))
    below = F.concat(E.let(E.get(node, "market"), listed), E.let(E.get(node, "markets"), listed))
    return F.concat(F.array(node), F.filter(below, E.is_object))


def _flatten(node: Column) -> Column:
    """node, its markets, then the same of each of its events, in that order, at any
    depth. Entries wait with their events until their round unfolds them in place."""
    entry = lambda waits, v: F.struct(F.lit(waits).alias("waits"), v.alias("v"))
    opened = lambda v: F.concat(
        F.transform(_with_markets(v), lambda x: entry(False, x)), F.transform(_objects(E.get(v, "events")), lambda x: entry(True, x))
    )
    step = lambda nodes: F.flatten(F.transform(nodes, lambda x: F.when(x["waits"], opened(x["v"])).otherwise(F.array(x))))
    deep = lambda v: F.transform(E.unfolded(v, F.array(entry(True, v)), step), lambda x: x["v"])
    plain = F.coalesce(*[E.get(node, k) for k in ("events", "market", "markets")]).isNull()
    return F.when(plain, F.array(node)).otherwise(E.let(node, lambda v: F.when(E.is_array(E.get(v, "events")), deep(v)).otherwise(_with_markets(v))))


def _tokens(c: Column) -> Column:
    """struct(yes, no) from paired label and id lists, then from groups of token
    objects, then from flat keys; the first hit of each wins. An object without
    an id gives none."""
    lists = F.struct(E.json_list(E.get(c, "clobTokenIds")).alias("ids"), E.json_list(E.get(c, "outcomes")).alias("labels"))
    return E.let(lists, lambda x: _tokens_of(c, x["ids"], x["labels"]))


def _token_pair(c: Column) -> Column:
    """struct(labels, ids) of texts: paired lists of two, or texts of such; else NULLs
    inside. What _tokens() reads of the lists is their texts."""
    def texts(key: str) -> Column:
        read = lambda v: F.try_variant_get(v, "$", "array<string>")
        return F.coalesce(F.try_variant_get(c, f"$.{key}", "array<string>"), read(F.try_parse_json(F.try_variant_get(c, f"$.{key}", "string"))))

    return F.struct(texts("outcomes").alias("labels"), texts("clobTokenIds").alias("ids"))


def _tokens_by(pair: Column, c: Column) -> Column:
    """_tokens(c): both tokens of a pair of lists are taken as they are, an object
    without a key of tokens has none, and anything else goes the whole way."""
    labels, ids = pair["labels"], pair["ids"]
    at = lambda i: (F.lower(F.trim(F.get(labels, F.lit(i)))), F.nullif(F.get(ids, F.lit(i)), F.lit("")))
    (l0, i0), (l1, i1) = at(0), at(1)
    two = (F.size(labels) == 2) & (F.size(ids) == 2) & i0.isNotNull() & i1.isNotNull()
    straight = two & l0.isin(*_SIDES["yes"][0]) & l1.isin(*_SIDES["no"][0])
    crossed = two & l0.isin(*_SIDES["no"][0]) & l1.isin(*_SIDES["yes"][0])
    keys = ("clobTokenIds", "outcomes", "tokens", "outcomeTokens", *_SIDES["yes"][1], *_SIDES["no"][1])
    none = F.coalesce(*[E.get(c, k) for k in keys]).isNull()
    of = lambda yes, no: F.struct(yes.alias("yes"), no.alias("no"))
    null = F.lit(None).cast("string")
    yes = lambda x: F.coalesce(x, F.lit(False))
    return F.when(yes(straight), of(i0, i1)).when(yes(crossed), of(i1, i0)).when(none, of(null, null)).otherwise(_tokens(c))


def _tokens_of(c: Column, ids: Column, labels: Column) -> Column:
    empty = F.array().cast("array<variant>")
    group = lambda v: F.coalesce(E.items(v), F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), empty)
    pairs = F.transform(
        F.when(F.size(ids) == F.size(labels), F.arrays_zip(labels.alias("l"), ids.alias("i"))),
        lambda p: F.struct(E.series_text(E.text(E.truthy(p["l"]))).alias("label"), F.nullif(E.text(p["i"]), F.lit("")).alias("id")),
    )
    groups = F.concat(group(E.get(c, "tokens")), F.coalesce(labels, empty), group(E.get(c, "outcomeTokens")), F.coalesce(ids, empty))
    named = F.transform(
        F.filter(groups, E.is_object),
        lambda o: F.struct(
            E.series_text(E.first_text(o, "side", "name", "outcome", "label")).alias("label"), E.first_text(o, "id", "tokenId", "token_id", "assetId").alias("id")
        ),
    )
    sides = _SIDES

    def of(entries: Column, names: tuple[str, ...]) -> Column:
        return F.get(F.filter(entries, lambda e: e["label"].isin(*names) & e["id"].isNotNull()), F.lit(0))["id"]

    paired = E.let(pairs, lambda x: F.struct(*[of(x, names).alias(side) for side, (names, _) in sides.items()]))

    def filled(found: Column) -> Column:
        rest = F.when(found["yes"].isNull() | found["no"].isNull(), named)
        both = lambda n: F.struct(*[F.coalesce(found[k], of(n, names), E.first_text(c, *flat)).alias(k) for k, (names, flat) in sides.items()])
        return E.let(rest, both)

    return E.let(paired, filled)


def normalized(responses: DataFrame, *, expand_lists: bool = False) -> DataFrame:
    """Candidates of every answered catalogue request, in the order found.

    A payload that is a list gives none, unless ``expand_lists`` feeds each of
    its objects as a payload of its own. Candidates without id, slug, tokens and
    times are left out. nth numbers an attempt's candidates after its own dedupe."""
    return numbered(read_candidates(responses, expand_lists=expand_lists))


def read_candidates(responses: DataFrame, *, expand_lists: bool = False) -> DataFrame:
    """Every node of every answer as a row, with here: whether it is a candidate. A
    request without any has one row, so that its answer (ok) is told as well."""
    rows = classified(responses, book=False)
    single = F.when(E.is_object(F.col("v")), F.array("v"))
    payloads = F.coalesce(single, _objects(F.col("v"))) if expand_lists else single
    rows = rows.select("poll_id", "poll_ts", "asset", "phase", "attempt_seq", "source", "path", "ok", F.posexplode_outer(payloads).alias("payload_seq", "p"))
    rows = E.settled(rows, nodes=F.when(F.col("p").isNotNull(), _flatten(F.col("p"))))
    rows = rows.select("*", F.posexplode_outer("nodes").alias("candidate_seq", "c")).drop("nodes")
    c, p = F.col("c"), F.col("p")
    rows = E.settled(rows, e0=F.try_variant_get(p, "$.events[0]", "variant"))
    e0 = F.col("e0")
    starts = [
        ("candidate.eventStartTime", c, "eventStartTime"), ("candidate.startTime", c, "startTime"),
        ("payload.eventStartTime", p, "eventStartTime"), ("payload.startTime", p, "startTime"),
        ("events[0].startTime", e0, "startTime"), ("events[0].eventStartTime", e0, "eventStartTime"),
        ("candidate.startDate", c, "startDate"), ("events[0].startDate", e0, "startDate"), ("payload.startDate", p, "startDate"),
    ]
    ends = [("events[0].endDate", e0, "endDate"), ("candidate.endDate", c, "endDate"), ("payload.endDate", p, "endDate")]

    def chosen(sources) -> Column:
        # Where the candidate is the payload itself, the payload's keys are its own.
        texts = [(F.try_variant_get(v, f"$.{k}", "string"), name) for name, v, k in sources]
        told = lambda at, name: F.when(at.isNotNull(), F.struct(at.alias("at"), F.lit(name).alias("source")))
        return F.coalesce(*[told(F.coalesce(E.full_datetime(t), E.parse_datetime(t)), name) for t, name in texts])

    rows = E.settled(rows, s=chosen(starts), z=chosen(ends), pair=_token_pair(c))
    rows = E.settled(rows, own=_tokens_by(F.col("pair"), c))
    # The payload's tokens count where the candidate, unless it is the payload, lacks one.
    lacks = (F.col("candidate_seq") > 0) & (F.col("own.yes").isNull() | F.col("own.no").isNull())
    rows = E.settled(rows, top=F.when(lacks, _tokens(p)))
    rows = rows.select(
        "*", F.col("s.at").alias("start"), F.col("z.at").alias("end"),
        F.col("s.source").alias("start_source"), F.col("z.source").alias("end_source"),
        F.coalesce("own.yes", "top.yes").alias("token_yes"), F.coalesce("own.no", "top.no").alias("token_no"),
    )

    def pick(own: tuple[str, ...], top: tuple[str, ...]) -> Column:
        more = E.quick_text(p, *top)
        return F.coalesce(E.quick_text(c, *own), F.when(F.col("candidate_seq") > 0, more) if set(top) <= set(own) else more)

    raw = E.series_text(E.quick_text(c, "status", "state", "marketStatus"))
    in_window = F.coalesce((F.col("start") <= F.col("poll_ts")) & (F.col("poll_ts") < F.col("end")), F.lit(True))
    yes = lambda k: F.coalesce((F.try_variant_get(c, f"$.{k}", "string") == "true") & (F.schema_of_variant(E.get(c, k)) == "BOOLEAN"), F.lit(False))
    # States as the catalogue names them.
    status = (
        F.when(raw.isin("open", "active", "tradable", "trading"), "open")
        .when(raw.isin("closed", "resolved", "redeemed", "archived", "paused", "settled", "finalized"), raw)
        .when(yes("closed"), "closed")
        .when(yes("archived"), "archived")
        .when((yes("enableOrderBook") | yes("acceptingOrders") | yes("tradable") | yes("active")) & in_window, "open")
        .when(raw != "", raw)
    )
    own = ["poll_id", "poll_ts", "asset", "phase", "attempt_seq", "ok", "payload_seq", "candidate_seq"]
    told = rows.select(
        *own,
        pick(("id", "marketId", "market_id", "questionID"), ("marketId", "market_id")).alias("market_id"),
        pick(("conditionId", "condition_id", "condition"), ("conditionId", "condition_id")).alias("condition_id"),
        pick(("slug",), ("slug", "eventSlug")).alias("slug"),
        pick(("title", "question", "name"), ("title", "name")).alias("title"),
        "token_yes", "token_no", "start", "end", E.iso_of(F.col("start")).alias("start_time"), E.iso_of(F.col("end")).alias("end_time"),
        status.alias("status"), F.concat_ws(":", "source", "path").alias("detection_source"), "start_source", "end_source",
    )
    told = E.settled(told, **{c: F.col(c) for c in told.columns if c not in own})
    return told.withColumn("here", F.coalesce("market_id", "slug", "token_yes", "token_no", "start_time", "end_time").isNotNull())


def numbered(told: DataFrame) -> DataFrame:
    """The candidates of read_candidates(), without copies within an attempt; nth
    numbers the rest of an attempt."""
    first = Window.partitionBy("poll_id", "attempt_seq", *DEDUPE_KEY).orderBy("payload_seq", "candidate_seq")
    nth = Window.partitionBy("poll_id", "attempt_seq").orderBy("payload_seq", "candidate_seq")
    return (
        told.where("here").drop("here", "ok").withColumn("copy", F.row_number().over(first)).where("copy = 1").drop("copy")
        .withColumn("nth", F.row_number().over(nth))
    )


def deduped(candidates: DataFrame, within: list[str] | None = None) -> DataFrame:
    """First of the candidates with equal ids, slug and times (nulls equal) per
    poll, in request order. Runs before the filter: a first candidate without
    tokens hides later ones."""
    w = Window.partitionBy(*(within or ["poll_id"]), *DEDUPE_KEY).orderBy("attempt_seq", "payload_seq", "candidate_seq")
    return candidates.withColumn("copy", F.row_number().over(w)).where("copy = 1").drop("copy")


# --- filter and score ---------------------------------------------------------


def with_profile(candidates: DataFrame, profiles: tuple[AssetProfile, ...] = PROFILES) -> DataFrame:
    return candidates.join(F.broadcast(profile_table(candidates.sparkSession, profiles)), "asset", "left")  # one row per profile


def _has_prefix() -> Column:
    return F.coalesce(E.series_text(F.col("slug")).startswith(F.col("slug_prefix")), F.lit(False))


def in_family() -> Column:
    """The asset's slug prefix, or one of its words and a five-minute word in
    slug and title (as substrings)."""
    text = F.concat(E.series_text(F.col("slug")), F.lit(" "), E.series_text(F.col("title")))
    has = lambda words: F.coalesce(F.exists(words, lambda w: F.contains(text, w)), F.lit(False))
    return _has_prefix() | (has("keywords") & has("five_minute_words"))


def _timing(now: Column, settings: Settings) -> Column:
    ahead = (F.unix_micros("start") - F.unix_micros(now)) / 1e6
    return F.when((F.col("start") <= now) & (now < F.col("end")), "active").when((ahead > 0) & (ahead <= settings.upcoming_seconds), "upcoming")


def judged(candidates: DataFrame, *, now: str = "poll_ts", settings: Settings = SETTINGS) -> DataFrame:
    """Adds exclusion (the first test failed; NULL for survivors), selection_bucket,
    score and reason. Lower scores are better; closed markets only score worse."""
    moment = F.col(now)
    timing = _timing(moment, settings)
    tokens = (F.coalesce("token_yes", F.lit("")) != "") & (F.coalesce("token_no", F.lit("")) != "")
    no_window = F.col("start").isNull() | F.col("end").isNull()
    inverted = F.col("end") <= F.col("start")
    rows = with_profile(candidates).withColumn("timing", timing)
    exclusion = (
        F.when(no_window | inverted, "missing_market_window")
        .when(~in_family(), "not_in_family")
        .when(F.col("timing").isNull(), "outside_relevant_window")
        .when(~tokens, "missing_tokens")
    )
    seconds = lambda a, b: ((F.unix_micros(a) - F.unix_micros(b)) / 1e6).cast("int")
    parts = {
        "duration_off_seconds": F.abs(seconds("end", "start") - settings.target_seconds),
        "timing_penalty": F.when(F.col("timing") == "active", 0).otherwise(seconds("start", now)),
        "slug_penalty": F.when(_has_prefix(), 0).otherwise(5_000),
        "token_penalty": F.when(tokens, 0).otherwise(7_500),
        "status_penalty": F.when(F.lower(F.coalesce("status", F.lit(""))) == "open", 0).otherwise(1_000),
    }
    total = sum(parts.values(), F.lit(0))
    text = F.concat_ws("; ", "timing", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in parts.items()])
    broken = lambda a, b, c: F.when(no_window, a).when(inverted, b).when(F.col("timing").isNull(), c)
    return (
        rows.withColumn("exclusion", exclusion)
        .withColumn("score", F.coalesce(broken(50_000, 40_000, 35_000), total).cast("int"))
        .withColumn("reason", F.coalesce(broken(F.lit("missing_market_window"), F.lit("invalid_market_window"), F.lit("outside_relevant_window")), text))
        .withColumn("selection_bucket", F.when(F.col("exclusion").isNull(), F.col("timing")))
        .drop("timing", "slug_prefix", "keywords", "five_minute_words")
    )


def waterfall(rows: DataFrame, by: str = "poll_id") -> DataFrame:
    """How many candidates of a poll passed and failed each test, in their order."""
    out = {x: F.count_if(F.col("exclusion") == x) for x in ("missing_market_window", "not_in_family", "outside_relevant_window", "missing_tokens")}
    total = F.count(F.lit(1))
    family = total - out["missing_market_window"] - out["not_in_family"]
    return rows.groupBy(by).agg(
        total.alias("normalized_total"),
        family.alias("family_match"),
        (family - out["outside_relevant_window"]).alias("time_relevant"),
        F.count_if(F.col("exclusion").isNull()).alias("token_complete"),
        out["missing_market_window"].alias("parse_failure"),
        F.count_if(F.col("exclusion").isNull()).alias("filtered_final"),
        *[c.alias(f"excluded_{x}") for x, c in out.items()],
    )


def two_phase(rows: DataFrame) -> DataFrame:
    """Judged candidates of both phases: broad ones count only where no slug
    candidate of the poll survived. rows must be deduped within their phase."""
    w = Window.partitionBy("poll_id")
    hit = F.max(((F.col("phase") == "slug") & F.col("exclusion").isNull()).cast("int")).over(w)
    return rows.withColumn("slug_hit", F.coalesce(hit, F.lit(0)) == 1).where("phase = 'slug' or not slug_hit").drop("slug_hit")


def combined(candidates: DataFrame) -> DataFrame:
    """Candidates that a poll decides on: its slug phase, with the broad phase
    where that found nothing, deduped over both and judged."""
    return deduped(two_phase(judged(deduped(candidates, ["poll_id", "phase"]))))


def selected(rows: DataFrame) -> DataFrame:
    """Best survivor of each poll; the first in request order among equals."""
    w = Window.partitionBy("poll_id").orderBy("score", "attempt_seq", "payload_seq", "candidate_seq")
    return rows.where("exclusion is null").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def answered(told: DataFrame, found: DataFrame) -> DataFrame:
    """poll_id, attempt_seq, ok and extracted_candidate_count of every request, as
    attempt_summaries() has them, from read_candidates() and the candidates kept."""
    n = found.groupBy("poll_id", "attempt_seq").agg(F.count(F.lit(1)).alias("n"))
    sent = told.where("coalesce(payload_seq, 0) = 0 and coalesce(candidate_seq, 0) = 0").select("poll_id", "attempt_seq", "ok")
    counted = sent.join(n, ["poll_id", "attempt_seq"], "left")
    return counted.select("poll_id", "attempt_seq", "ok", F.when(F.col("ok"), F.coalesce("n", F.lit(0))).alias("extracted_candidate_count"))


def route(responses: DataFrame, polls: DataFrame | None = None) -> DataFrame:
    """One decision per poll: the routed market or NULLs with the reason, and
    the counts behind it. polls (poll_id, poll_ts, asset) adds polls that got no
    response at all."""
    told = stored(read_candidates(responses), "candidates").repartition("poll_id")
    found = numbered(told)
    judged_rows = combined(found)
    best = selected(judged_rows).select(
        "poll_id", "market_id", "slug", "title", "condition_id", "token_yes", "token_no", "start_time", "end_time", "status",
        "detection_source", F.col("score").alias("routing_score"), "reason", F.col("selection_bucket").alias("selection_mode"),
    )
    head = told.select("poll_id", "poll_ts", "asset")
    head = (head if polls is None else head.unionByName(polls.select("poll_id", "poll_ts", "asset"))).distinct()
    return (
        head.join(failure_reasons(answered(told, found)), "poll_id", "left")
        .join(waterfall(judged_rows).select("poll_id", F.col("normalized_total").alias("n_candidates"), F.col("filtered_final").alias("n_final")), "poll_id", "left")
        .join(best, "poll_id", "left")
        .withColumn("routing_reason", F.when(F.col("routing_score").isNotNull(), F.col("reason")).otherwise(F.coalesce("failure_reason", F.lit("gamma_http_failure"))))
        .drop("reason", "failure_reason")
        .na.fill(0, ["n_ok", "n_extracted", "n_candidates", "n_final"])
    )


def _identity() -> Column:
    """The seven fields of a decision's market, wrapped: NULL inside for none."""
    return F.struct(F.when(F.col("routing_score").isNotNull(), F.struct(*IDENTITY)).alias("i"))


def last_identities(decisions: DataFrame) -> DataFrame:
    """asset, identity: what the asset's last decision named."""
    last = F.max_by(_identity(), F.struct("poll_ts", "poll_id"))
    return decisions.groupBy("asset").agg(last.alias("identity"))


def route_rows(decisions: DataFrame, slice_seconds: int = 3600, before: DataFrame | None = None) -> DataFrame:
    """Decisions with market_changed: whether the seven identity fields differ from
    those of the asset's decision before, by time and poll_id. The first decision
    compares with ``before`` (last_identities() of what came earlier), or no market.

    An asset's rows are cut into time slices; the last identity of the slice before
    comes from a table with one row per slice, so no task holds an asset's history."""
    rows = decisions.withColumn("identity", _identity()).withColumn("slice", F.floor(F.unix_seconds("poll_ts") / slice_seconds))
    ends = rows.groupBy(F.col("asset").alias("e_asset"), F.col("slice").alias("e_slice")).agg(F.max_by("identity", F.struct("poll_ts", "poll_id")).alias("end"))
    carried = ends.withColumn("carried", F.lag("end").over(Window.partitionBy("e_asset").orderBy("e_slice")))
    if before is not None:
        old = before.select(F.col("asset").alias("b_asset"), F.col("identity").alias("b_identity"))
        carried = carried.join(old, F.col("e_asset").eqNullSafe(F.col("b_asset")), "left").withColumn("carried", F.coalesce("carried", "b_identity"))
    carried = carried.select("e_asset", "e_slice", "carried")
    w = Window.partitionBy("asset", "slice").orderBy("poll_ts", "poll_id")
    prior = F.coalesce(F.lag("identity").over(w), F.col("carried"))
    return (
        rows.join(carried, F.col("asset").eqNullSafe(F.col("e_asset")) & F.col("slice").eqNullSafe(F.col("e_slice")))
        .withColumn("market_changed", ~F.col("identity.i").eqNullSafe(prior["i"]))
        .withColumn("ts", E.iso(F.col("poll_ts")))
        .withColumn("record_type", F.lit("market_route"))
        .drop("identity", "slice", "e_asset", "e_slice", "carried")
    )


def backfill(instants: DataFrame, catalogue: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Best market of a catalogue (asset, market_id, slug, title, tokens, start,
    end, status) at every instant (instant_id, at, asset), where there is one."""
    pairs = interval_join(instants, catalogue, by=["asset"], ts="at", start="start", end="end", lead_seconds=settings.upcoming_seconds)
    rows = judged(pairs, now="at", settings=settings).where("exclusion is null")
    best = rows.groupBy("instant_id").agg(
        F.min(F.struct("score", "start", "market_id", "slug", "selection_bucket")).alias("b"), F.count(F.lit(1)).alias("n_relevant")
    )
    return best.select("instant_id", "n_relevant", "b.market_id", "b.slug", "b.score", "b.selection_bucket")
