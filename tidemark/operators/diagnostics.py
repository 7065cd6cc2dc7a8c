"""Classify landed responses and summarise what they held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import expr as E


def classified(responses: DataFrame, *, book: bool, keep: int = SETTINGS.sample_chars) -> DataFrame:
    """Adds v (parsed body), ok, error_kind, error_text and response_text_sample.

    Order of tests: failures to get an answer, then the status (any but 200 for
    order books, 400 and above for the catalogue), then the body."""
    bad_status = (F.col("http_status") != 200) if book else (F.col("http_status") >= 400)
    lost = F.coalesce(F.col("failure").isin("transport", "unexpected") | bad_status, F.lit(False))
    responses = E.settled(responses, v=F.when(~lost, E.parse(F.col("body"))))
    v = F.col("v")
    error_kind = (
        F.when(F.col("failure") == "transport", "transport_failure")
        .when(F.col("failure") == "unexpected", "unexpected_failure")
        .when(bad_status, "http_failure")
        .when(v.isNull(), "parse_failure")
    )
    text = F.coalesce(
        F.col("error"),
        F.when(F.col("error_kind") == "http_failure", F.concat(F.lit("HTTP "), F.col("http_status").cast("string"))),
        F.when(F.col("error_kind") == "parse_failure", F.lit("body is not JSON")),
        F.when(F.col("error_kind").isNotNull(), F.col("error_kind")),
    )
    return (
        responses.withColumn("error_kind", error_kind)
        .withColumn("ok", F.col("error_kind").isNull())
        .withColumn("error_text", F.when(~F.col("ok"), text))
        .withColumn("response_text_sample", F.substring("body", 1, keep))
    )


def sample(rows: Column, limit: int = SETTINGS.sample_limit) -> Column:
    """slug, title, start and end of the first rows of an array of objects."""
    return F.transform(
        F.slice(rows, 1, limit),
        lambda r: F.struct(
            E.quick_text(r, "slug", "eventSlug").alias("slug"),
            E.quick_text(r, "question", "title", "name").alias("title"),
            E.iso_or_text(E.quick_text(r, "startDate", "start")).alias("start"),
            E.iso_or_text(E.quick_text(r, "endDate", "end")).alias("end"),
        ),
    )


def attempts(responses: DataFrame) -> DataFrame:
    """One row per catalogue request: flags and a sample of its rows."""
    rows = E.settled(classified(responses, book=False), rows=E.payload_rows(F.col("v")))
    exact = F.col("path").startswith("/markets/slug/") | F.col("path").startswith("/events/slug/")
    return rows.select(
        "poll_id", "poll_ts", "asset", "phase", "attempt_seq", "source", "slug", "path", "http_status", "ok", "error_kind",
        F.col("error_text").alias("error"),
        ((F.col("phase") == "slug") & exact).alias("exact_slug_endpoint_used"),
        (F.size(F.coalesce("headers_applied", F.create_map().cast("map<string,string>"))) > 0).alias("browser_like_headers_applied"),
        F.when(F.col("ok"), F.size("rows") == 0).alias("payload_empty"),
        F.when(F.col("ok"), F.size("rows")).alias("n_rows"),
        F.when(F.col("ok"), sample(F.col("rows"))).alias("payload_sample_rows"),
    )


def attempt_summaries(attempt_rows: DataFrame, candidates: DataFrame, limit: int = SETTINGS.sample_limit) -> DataFrame:
    """attempts with the number of candidates found in each and the first few."""
    fields = ["market_id", "slug", "title", "condition_id", "token_yes", "token_no", "start_time", "end_time", "status"]
    found = candidates.groupBy("poll_id", "attempt_seq").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("nth") <= limit, F.struct("nth", *fields)))).alias("c"),
    )
    return (
        attempt_rows.join(found, ["poll_id", "attempt_seq"], "left")
        .withColumn("extracted_candidate_count", F.when(F.col("ok"), F.coalesce("n", F.lit(0))))
        .withColumn("sample_candidates", F.transform("c", lambda s: s.dropFields("nth")))
        .drop("n", "c")
    )


def failure_reasons(attempt_rows: DataFrame) -> DataFrame:
    """Per poll: requests answered, candidates extracted, and why a poll without
    a market has none."""
    return (
        attempt_rows.groupBy("poll_id")
        .agg(F.count_if("ok").alias("n_ok"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("extracted_candidate_count"))), F.lit(0)).alias("n_extracted"))
        .withColumn(
            "failure_reason",
            F.when(F.col("n_ok") == 0, "gamma_http_failure").when(F.col("n_extracted") == 0, "no_candidates_found").otherwise("rows_returned_but_filtered_out"),
        )
    )
