"""The whole result of a routing poll: market, reason and nested diagnostics.

Lists in it are bounded: requests by what a poll sends, samples by their limit. They
are numbered first and only the first few are gathered, so no poll's candidates come
together in one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PROFILES, SETTINGS, AssetProfile
from ..sources.workdir import stored
from . import routing
from .diagnostics import attempt_summaries, attempts, failure_reasons

REQUEST = [
    "source", "slug", "path", "params", "exact_slug_endpoint_used", "http_status", "ok", "error_kind", "error", "browser_like_headers_applied", "headers_applied",
    "payload_empty", "payload_sample_rows",
]
COUNTS = ["normalized_total", "family_match", "time_relevant", "token_complete", "parse_failure", "filtered_final"]
EXCLUSIONS = ["missing_market_window", "not_in_family", "outside_relevant_window", "missing_tokens"]


def filter_summaries(judged: DataFrame, name: str, *, limit: int = SETTINGS.sample_limit) -> DataFrame:
    """poll_id and, as ``name``, the counts and exclusions of judged candidates with
    samples: the first ``limit`` in request order, of all, of those excluded for each
    reason, and of those left."""
    order = ["attempt_seq", "payload_seq", "candidate_seq"]
    rows = judged.withColumn("why", F.coalesce("exclusion", F.lit("")))
    rows = rows.withColumn("n_all", F.row_number().over(Window.partitionBy("poll_id").orderBy(*order)))
    rows = rows.withColumn("n_why", F.row_number().over(Window.partitionBy("poll_id", "why").orderBy(*order)))
    sample = F.struct("slug", "title", F.col("start_time").alias("start"), F.col("end_time").alias("end"))

    def some(number: str, which) -> Column:
        held = F.collect_list(F.when(which & (F.col(number) <= limit), F.struct(F.col(number).alias("n"), sample.alias("s"))))
        return F.transform(F.array_sort(held), lambda x: x["s"])

    samples = rows.groupBy("poll_id").agg(
        some("n_all", F.lit(True)).alias("normalized"), some("n_why", F.col("why") == "").alias("final_candidates"),
        F.struct(*[some("n_why", F.col("why") == x).alias(x) for x in EXCLUSIONS]).alias("excluded"),
    )
    counted = routing.waterfall(judged)
    summary = F.struct(
        F.struct(*COUNTS).alias("counts"), F.struct(*[F.col(f"excluded_{x}").alias(x) for x in EXCLUSIONS]).alias("exclusion_counts"),
        F.struct("normalized", "final_candidates", "excluded").alias("samples"),
    )
    return counted.join(samples, "poll_id").select("poll_id", summary.alias(name))


def request_diagnostics(responses: DataFrame, tried: DataFrame) -> DataFrame:
    """poll_id and its requests in the order sent, each with what it answered and the
    candidates found in it (how many, and the first few)."""
    key = ["poll_id", "attempt_seq"]
    sent = responses.select(*key, "params", "headers_applied").groupBy(*key).agg(F.first("params").alias("params"), F.first("headers_applied").alias("headers_applied"))
    found = F.struct("extracted_candidate_count", "sample_candidates").alias("normalization_result")
    rows = tried.join(sent, key).select("poll_id", "phase", "attempt_seq", F.struct("attempt_seq", *REQUEST, found).alias("r"))
    # Maps have no order of their own: the numbers are sorted, the requests looked up.
    held = rows.groupBy("poll_id").agg(
        F.array_sort(F.collect_list("attempt_seq")).alias("order"), F.map_from_entries(F.collect_list(F.struct("attempt_seq", "r"))).alias("of"),
        F.max((F.col("phase") == "broad").cast("int")).alias("broad"),
    )
    return held.select("poll_id", F.transform("order", lambda n: F.col("of")[n]).alias("request_diagnostics"), (F.col("broad") == 1).alias("broad_attempted"))


def route_results(responses: DataFrame, profiles: tuple[AssetProfile, ...] = PROFILES) -> DataFrame:
    """One row per poll of catalogue responses: poll_id, poll_ts, asset, market (NULL
    where none was found), routing_reason, detection_source, and diagnostics with the
    slugs tried, the requests, and the filter summary of the slug phase, of the broad
    phase, and of the candidates decided on."""
    # Four parts start from the responses: what they are made of is worked out once.
    responses = stored(responses, "responses")
    found = stored(routing.normalized(responses), "candidates")
    tried = stored(attempt_summaries(attempts(responses), found), "attempts")
    in_phase = stored(routing.judged(routing.deduped(found, ["poll_id", "phase"])), "judged")
    both = routing.deduped(routing.two_phase(in_phase))
    best = routing.selected(both).select(
        "poll_id", F.struct(
            "market_id", "slug", "title", "condition_id", "token_yes", "token_no", "start_time", "end_time", "status", "detection_source",
            F.col("reason").alias("routing_reason"), F.col("score").alias("routing_score"),
        ).alias("market"), F.col("selection_bucket").alias("selection_mode"),
    )
    head = responses.select("poll_id", "poll_ts", "asset").distinct()
    slugs = routing.candidate_slugs(head, profiles).groupBy("poll_id").agg(
        F.first("bucket").alias("bucket_ts"), F.array_sort(F.collect_set("slug")).alias("candidate_slugs_attempted")
    )
    rows = head.join(slugs, "poll_id", "left").join(request_diagnostics(responses, tried), "poll_id", "left").join(failure_reasons(tried).select("poll_id", "failure_reason"), "poll_id", "left")
    for name, judged in (("slug", in_phase.where("phase = 'slug'")), ("broad", in_phase.where("phase = 'broad'")), ("combined", both)):
        rows = rows.join(filter_summaries(judged, name), "poll_id", "left")
    rows = rows.join(best, "poll_id", "left")
    of = lambda name, count: F.coalesce(F.col(f"{name}.counts.{count}"), F.lit(0).cast("long"))
    phase = lambda name, *more: F.struct(*more, of(name, "normalized_total").alias("normalized_candidate_count"), of(name, "filtered_final").alias("filtered_candidate_count"), F.col(name).alias("filter_summary"))
    diagnostics = F.struct(
        F.unix_seconds("poll_ts").alias("now_utc_epoch"), "bucket_ts", "candidate_slugs_attempted", "request_diagnostics",
        phase("slug").alias("slug_phase_summary"), phase("broad", F.coalesce("broad_attempted", F.lit(False)).alias("attempted")).alias("broad_phase_summary"),
        F.struct(
            of("combined", "normalized_total").alias("normalized_candidate_count"), of("combined", "filtered_final").alias("filtered_candidate_count"),
            F.col("market.market_id").alias("selected_market_id"), F.col("market.slug").alias("selected_slug"), "selection_mode",
        ).alias("selection_summary"),
        F.col("combined").alias("combined_filter_summary"),
    )
    reason = F.coalesce("market.routing_reason", "failure_reason", F.lit("gamma_http_failure"))
    return rows.select("poll_id", "poll_ts", "asset", "market", reason.alias("routing_reason"), F.col("market.detection_source").alias("detection_source"), diagnostics.alias("diagnostics"))
