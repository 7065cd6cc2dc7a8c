"""Document fingerprints: a Merkle tree over paragraphs and sections.

A section is a line; its paragraphs are runs of at most eight words with the
spaces around them. Paragraph digests give section digests, those give the
root: equal roots mean equal texts, and following the differing digests down
locates an edit. Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, text_bytes

#: Up to eight words with the spaces after each, or spaces alone.
PARAGRAPH = r"[^ ]+(?: +[^ ]+){0,7} *| +"
LEAF_HEX = 12
SECTION_HEX = 16
#: UTF-8 bytes of text that one bucket of neighbours should hold, about.
BUCKET_BYTES = 4 << 20
#: Buckets at most, so that their bounds in the plan stay below 200 kB at any size.
#: Beyond 80 GB buckets grow instead (5 GB each at 100 TB); their sort spills to disk.
MAX_BUCKETS = 20_000


def sections(text: Column) -> Column:
    """Array of arrays: the paragraph digests of every section."""
    return F.transform(
        F.split(text, "\n", -1),
        lambda line: F.transform(
            F.regexp_extract_all(line, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.substring(F.sha2(p, 256), 1, LEAF_HEX)
        ),
    )


def fingerprint(tree: Column) -> Column:
    """root:section(paragraph,…);section(…) of a tree from sections()."""
    branches = F.transform(tree, lambda s: F.array_join(s, ","))
    digests = F.transform(branches, lambda s: F.substring(F.sha2(s, 256), 1, SECTION_HEX))
    return F.concat(
        F.sha2(F.array_join(digests, ""), 256),
        F.lit(":"),
        F.array_join(F.transform(F.arrays_zip(digests.alias("d"), branches.alias("b")), lambda z: F.concat(z["d"], F.lit("("), z["b"], F.lit(")"))), ";"),
    )


def likeness(a: Column, b: Column) -> Column:
    """Twice the paragraphs in both over those of each (as sets); 1 if both are empty."""
    size = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(size == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / size)


def differing_sections(a: Column, b: Column) -> Column:
    """Positions (from 0) of the sections in which two trees differ."""
    span = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1)
    return F.filter(span, lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))


def _bucket_of(doc_id: Column, bounds: list[int]) -> Column:
    """Number of bounds that are at most doc_id, found in two steps of √n."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    count = lambda xs: F.size(F.filter(xs, lambda x: x <= doc_id))
    heads = F.array(*[F.lit(g[0]) for g in groups])
    inner = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
    at = count(heads)
    return F.when(at == 0, 0).otherwise((at - 1) * step + count(F.element_at(inner, F.greatest(at, F.lit(1)))))


def neighbours(docs: DataFrame) -> DataFrame:
    """bucket, ghost, doc_id, text: rows in buckets of neighbouring ids, the first
    row of each bucket standing as a ghost at the end of the one before it (and
    the very first row at the end of the last), so that every row's successor is
    in its own bucket. Texts are shuffled once, and never to one task."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("order_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size, _ = text_bytes(docs)
    n = max(shuffle_partitions(docs.sparkSession), min(size // BUCKET_BYTES, MAX_BUCKETS), 1)
    cuts = rows.agg(
        F.min("order_id").alias("low"),
        F.percentile_approx("order_id", [k / n for k in range(1, n)] or [0.5], F.lit(max(10_000, 10 * n))).alias("cuts"),
    ).first()
    low = cuts["low"] if cuts["low"] is not None else 0
    bounds = sorted({x for x in (cuts["cuts"] or []) if x > low})
    last = len(bounds)
    first_ids = F.array(*[F.lit(x) for x in bounds]) if bounds else F.array().cast("array<bigint>")
    bucket = _bucket_of(F.col("order_id"), bounds)
    rows = rows.withColumn("bucket", bucket)
    is_first = (F.col("bucket") > 0) & (F.get(first_ids, F.col("bucket") - 1) == F.col("order_id")) if bounds else F.lit(False)
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ghost"))
    places = (
        F.when(F.col("order_id") == low, F.array(here, F.struct(F.lit(last).alias("bucket"), F.lit(1).alias("ghost"))))
        .when(is_first, F.array(here, F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(1).alias("ghost"))))
        .otherwise(F.array(here))
    )
    return rows.withColumn("place", F.explode(places)).select("place.bucket", "place.ghost", "order_id", "doc_id", "text")


def fingerprints(docs: DataFrame, edit_share: float = 0.25) -> DataFrame:
    """Fingerprint of every text, of its edited form (the last share of its
    characters replaced by the first of the next document by id, the last
    document being followed by the first) and their likeness.

    Null text is empty; rows with equal ids follow each other by text; a single
    row is its own successor; an empty table gives no rows."""
    order = Window.partitionBy("bucket").orderBy("ghost", "order_id", "text")
    n_cut = F.floor(F.col("n_chars") * F.lit(edit_share)).cast("int")
    flat = lambda c: F.flatten(F.col(c))
    return (
        neighbours(docs)
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("next_text", F.lead("text").over(order))
        .withColumn("tree", sections(F.col("text")))
        .withColumn("leaves", flat("tree"))
        .withColumn("next_leaves", F.lead("leaves").over(order))
        .where("ghost = 0")
        .withColumn(
            "edited",
            F.concat(
                F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - n_cut).cast("int")),
                F.substring(F.col("next_text"), F.lit(1), n_cut),
            ),
        )
        .withColumn("edited_tree", sections(F.col("edited")))
        .select(
            "doc_id",
            "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            fingerprint(F.col("tree")).alias("fingerprint"),
            fingerprint(F.col("edited_tree")).alias("edited_fingerprint"),
            likeness(F.col("leaves"), flat("edited_tree")).alias("near_edited"),
            likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
            differing_sections(F.col("tree"), F.col("edited_tree")).alias("edited_sections"),
        )
    )
