"""The registered queries of this subpackage and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, jaccard_join, langid, manifest, merkle, mixing, oracles, packing, prefix_trie, quality_lines, secrets, suffix_dedup, toxicity, url_lists
from .common import documents


def crc_mod(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(crc_mod(3) != 1).select("doc_id", "lang", "text"))
    got = langid.classify(docs, model)
    return got.select("doc_id", (crc_mod(3) == 1).alias("held_out"), "lang_pred", "score", "rejected", "runner_up")


def list_events(pages: DataFrame) -> DataFrame:
    """Dated list derived from pages: every fourth host, every third first path part
    of a host, and all parent domains (chosen by digest) are added on a day of their
    own in January 2024; half of them, and all domains, are removed nine days later,
    and a third of the hosts come back after five more."""
    url = F.col("url")
    hosts = pages.select(url_lists.host_of(url).alias("host"), F.get(url_lists.path_parts(url), 0).alias("part")).where("host <> ''").distinct()
    keys = (
        hosts.select(F.col("host").alias("key"), F.lit("host").alias("rule"))
        .union(hosts.select(F.substring_index("host", ".", -2), F.lit("domain")))
        .union(hosts.where("part is not null").select(F.concat_ws("/", "host", "part"), F.lit("path")))
        .distinct()
    )
    number = F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("long")
    listed = keys.withColumn("x", number).where("x % 4 = 0 and rule = 'host' or x % 3 = 0 and rule = 'path' or rule = 'domain'")
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + 86400 * n)
    start = (F.floor(F.col("x") / 4) % 20).cast("long")
    events = F.array(
        F.struct(day(start).alias("at"), F.lit("add").alias("action")),
        F.when((F.floor(F.col("x") / 80) % 2 == 0) | (F.col("rule") == "domain"), F.struct(day(start + 9).alias("at"), F.lit("remove").alias("action"))),
        F.when((F.floor(F.col("x") / 80) % 6 == 0) & (F.col("rule") == "host"), F.struct(day(start + 14).alias("at"), F.lit("add").alias("action"))),
    )
    return (
        listed.withColumn("e", F.explode(events)).where("e is not null")
        .select("key", "rule", F.col("e.at").alias("at"), F.col("e.action").alias("action"))
    )


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    # Fetch times follow from page_id: one every 97 seconds, over 30 days and around again.
    fetched = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 97, F.lit(30 * 86400)))
    got = url_lists.filter_captures(pages.withColumn("fetched_at", fetched), url_lists.validity(list_events(pages)))
    return got.select(
        "page_id", "host", F.unix_seconds("fetched_at").alias("fetched_s"), "blocked", "matched_key", "rule",
        F.unix_seconds("valid_from").alias("valid_from_s"),
    )


def op4_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = jaccard_join.join_components(documents(spark, sf_dir), shingle_words=5, num=75, den=100)
    return got.select("doc_id", "n_shingles", "component_id", "class_size")


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = merkle.fingerprints(documents(spark, sf_dir))
    return got.withColumn("n_edited_sections", F.size("edited_sections").cast("long")).drop("edited_sections")


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(documents(spark, sf_dir), least=200)


def op9_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = backoff_lm.score(documents(spark, sf_dir), "crc32(cast(doc_id as string)) % 7 <> 2")
    return got.select(
        "doc_id", (~F.col("in_training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_lines.judge(documents(spark, sf_dir))
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_removed_lines", "n_removed_words",
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir)).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_layers"
    )


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sizes(documents(spark, sf_dir))
    got = mixing.take(sized, weights=(5.0, 2.0, 1.0), budget_ratio=1.5, max_repeats=2)
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    text = F.when(crc_mod(2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = manifest.prove(docs, {"leaf": manifest.leaf(docs, columns), "changed": manifest.leaf(docs, columns, text=text)})
    root = manifest.folded(F.col("changed"), F.col("proof"), F.col("spot"))
    got = got.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"), root.alias("folded_root"))
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod(5) != 0).select("doc_id", F.col("toxic").alias("label"))
    got = toxicity.score(docs, toxicity.fit(docs, labels))
    return got.select("doc_id", (crc_mod(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_restored")


def queries() -> dict:
    return {
        "op1_language": op1_language,
        "op2_line_frequency": op2_line_frequency,
        "op3_url_lists": op3_url_lists,
        "op4_partenum": op4_partenum,
        "op5_merkle": op5_merkle,
        "op6_pack": op6_pack,
        "op7_secrets": op7_secrets,
        "op8_suffix": op8_suffix,
        "op9_backoff": op9_backoff,
        "op10_mix": op10_mix,
        "op11_manifest": op11_manifest,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_toxicity": op13_toxicity,
    }


OP3_SQL = r"""
WITH hosted AS (
  SELECT page_id, 1704067200 + (page_id * 97) % (30 * 86400) AS fetched_s,
    regexp_replace(regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '(:[0-9]*|\.)+$', '') AS host,
    regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/$', '') AS path,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1) <> '' AS has_path
  FROM pages),
keys AS (
  SELECT host AS key, 'host' AS rule FROM hosted WHERE host <> ''
  UNION SELECT array_to_string(list_slice(string_split(host, '.'), -2, -1), '.'), 'domain' FROM hosted WHERE host <> ''
  UNION SELECT host || '/' || string_split(path, '/')[1], 'path' FROM hosted WHERE host <> '' AND has_path),
numbered AS (SELECT key, rule, CAST('0x' || substr(md5(key), 1, 6) AS BIGINT) AS x FROM keys),
listed AS (
  SELECT *, (x // 4) % 20 AS start FROM numbered
  WHERE x % 4 = 0 AND rule = 'host' OR x % 3 = 0 AND rule = 'path' OR rule = 'domain'),
events AS (
  SELECT key, rule, 1704067200 + 86400 * start AS moment, 'add' AS action FROM listed
  UNION ALL SELECT key, rule, 1704067200 + 86400 * (start + 9), 'remove' FROM listed WHERE (x // 80) % 2 = 0 OR rule = 'domain'
  UNION ALL SELECT key, rule, 1704067200 + 86400 * (start + 14), 'add' FROM listed WHERE (x // 80) % 6 = 0 AND rule = 'host'),
spans AS (SELECT key, rule, action, moment AS valid_from, lead(moment) OVER (PARTITION BY rule, key ORDER BY moment) AS valid_to FROM events),
met AS (
  SELECT h.page_id, s.key, s.rule, s.valid_from,
    row_number() OVER (PARTITION BY h.page_id ORDER BY CASE s.rule WHEN 'path' THEN 0 WHEN 'host' THEN 1 ELSE 2 END, length(s.key) DESC) AS n
  FROM hosted h JOIN spans s ON s.action = 'add'
    AND (h.host = s.key AND s.rule <> 'path'
      OR s.rule = 'domain' AND ends_with(h.host, '.' || s.key)
      OR s.rule = 'path' AND h.has_path AND starts_with(h.host || '/' || h.path || '/', s.key || '/'))
    AND s.valid_from <= h.fetched_s AND (s.valid_to IS NULL OR h.fetched_s < s.valid_to))
SELECT h.page_id, h.host, h.fetched_s, m.key IS NOT NULL AS blocked, m.key AS matched_key, m.rule, m.valid_from AS valid_from_s
FROM hosted h LEFT JOIN met m ON m.page_id = h.page_id AND m.n = 1
"""


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | {"op3_url_lists": OP3_SQL}
