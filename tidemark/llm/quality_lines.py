"""Quality rules with cross-document line frequency.

Lines are normalised (white space folded, lower case) and hashed; the number of
distinct documents per host and line is counted; lines above the limit of their
host are removed, and a document left with too little of its text is rejected.
Counts combine on the map side, so a line that a third of all documents share
crosses the network once per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, lean, materialise

#: A table of frequent lines up to this many rows is broadcast; a larger one is
#: shuffled, each of its lines (they are the hot ones) over so many tasks.
BROADCAST_ROWS = 20_000
SALTS = 16


_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_SYMBOLS = b"#*$%&|<>"


def line_hash(parts: list[bytes]) -> int:
    """Hash of a line, given its words."""
    import xxhash

    return xxhash.xxh3_64_intdigest(b" ".join(parts).lower())


def measures(text: bytes):
    """Words, their characters, symbols, repeated lines, repeated words, and the
    lines as a map of hash to words."""
    import numpy as np

    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _SPACES + bytes(range(0x80, 0xC0))))
    marks = len(text) - len(text.translate(None, _SYMBOLS))
    seen, again, lines = set(), 0, {}
    for line in text.split(b"\n"):
        parts = line.split()
        if not parts:
            continue
        if line in seen:
            again += 1
        seen.add(line)
        h = line_hash(parts)
        lines[h] = lines.get(h, 0) + len(parts)
    repeat = 0
    if n > 3:
        code: dict[bytes, int] = {}
        a = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, n)
        v = len(code)
        key = a[:-2] * v + a[1:-1]
        if v < 2_000_000:
            key = key * v + a[2:]
        else:  # three factors would overflow
            key = np.unique(key, return_inverse=True)[1] * v + a[2:]
        order = np.argsort(key)
        ranked = key[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            hit = np.zeros(n - 2, bool)
            hit[order[1:][same]] = True
            hit[order[:-1][same]] = True
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[k : n - 2 + k] |= hit
            repeat = int(cover.sum())
    return n, chars, marks, again, repeat, lines


def measure(docs: DataFrame, host_col: str) -> DataFrame:
    """Per document: the base measures and its lines as (hash, words, times)."""
    rows = docs.select("doc_id", F.col(host_col).alias("host"), "text")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = (
        f"doc_id {kinds['doc_id']}, host {kinds['host']}, n_words long, word_chars long, n_symbols long, "
        "n_dup_lines long, n_repeat_words long, lines array<struct<h:long,w:long>>"
    )

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            got = [measures(t or b"") for t in as_bytes(b.column("text"))]
            hashes = np.array([h for g in got for h in g[5]], np.uint64).view(np.int64)
            weights = pa.array([w for g in got for w in g[5].values()], pa.int64())
            ends = np.cumsum([0] + [len(g[5]) for g in got])
            pairs = pa.StructArray.from_arrays([pa.array(hashes), weights], ["h", "w"])
            cols = [b.column("doc_id"), b.column("host")]
            cols += [pa.array([g[k] for g in got], pa.int64()) for k in range(5)]
            cols += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]
            yield pa.RecordBatch.from_arrays(
                cols, ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"]
            )

    return rows.mapInArrow(lean(run), out)


def frequent_lines(table: DataFrame, least_docs: int, host_share: float) -> tuple[DataFrame, DataFrame]:
    """The lines of a measured table, and the (f_host, f_h) that are too frequent."""
    per_host = table.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    lines = table.select("host", "_row", F.explode("lines").alias("line")).select("host", "_row", "line.h", "line.w")
    counts = lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("line_docs")).where(F.col("line_docs") > least_docs)
    frequent = materialise(
        counts.join(per_host.withColumnRenamed("host", "host2"), F.col("host").eqNullSafe(F.col("host2")))
        .where(F.col("line_docs") > F.col("host_docs") * F.lit(float(host_share)))
        .select(F.col("host").alias("f_host"), F.col("h").alias("f_h")),
        "quality-frequent",
    )
    return lines, frequent


def judge(
    docs: DataFrame,
    *,
    host_col: str = "source",
    least_docs: int = 20,
    host_share: float = 0.02,
    depleted_share: float = 0.5,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Measures and verdict per document.

    A line is too frequent when more than ``least_docs`` documents of its host
    and more than ``host_share`` of them have it. A document is depleted when
    more than ``depleted_share`` of its words stand in such lines. Null text is
    empty and fails the base rules; a null host is a host of its own; repeated
    rows are documents each; an empty table gives no rows."""
    table = materialise(measure(docs, host_col).withColumn("_row", F.monotonically_increasing_id()), "quality-lines")
    lines, frequent = frequent_lines(table, least_docs, host_share)
    same = F.col("host").eqNullSafe(F.col("f_host")) & (F.col("h") == F.col("f_h"))
    if frequent.count() <= broadcast_rows:
        hit = lines.join(F.broadcast(frequent), same)
    else:
        salted = frequent.withColumn("f_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = lines.join(salted, same & (F.pmod(F.xxhash64("_row"), F.lit(SALTS)) == F.col("f_salt")))
    removed = (
        hit
        .groupBy("_row")
        .agg(F.count(F.lit(1)).alias("n_removed_lines"), F.sum("w").alias("n_removed_words"))
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = F.col("n_removed_words") > F.col("n_words") * F.lit(float(depleted_share))
    return (
        table.drop("lines")
        .join(removed, "_row", "left")
        .na.fill(0, ["n_removed_lines", "n_removed_words"])
        .withColumn("base_failed", failed)
        .withColumn("depleted", depleted)
        .withColumn("kept", ~failed & ~depleted)
        .drop("_row")
    )


def clean(
    docs: DataFrame,
    *,
    host_col: str = "source",
    least_docs: int = 20,
    host_share: float = 0.02,
    depleted_share: float = 0.5,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """The documents that judge() keeps, without their too frequent lines.

    The other lines stay as they are, in order. Columns other than text (and
    n_chars, which follows it) pass through unchanged. A host has fewer frequent
    lines than lines a document on average over ``host_share``, so they come as
    one list per host."""
    table = materialise(measure(docs, host_col).withColumn("_row", F.monotonically_increasing_id()), "quality-lines")
    _, frequent = frequent_lines(table, least_docs, host_share)
    lists = frequent.groupBy(F.col("f_host").alias("_f_host")).agg(F.collect_list("f_h").alias("_f_hashes"))
    names, schema = docs.columns, docs.schema
    listed = docs.join(lists, F.col(host_col).eqNullSafe(F.col("_f_host")), "left").select(*docs.columns, "_f_hashes")

    def run(batches):
        import pyarrow as pa

        at = names.index("text")
        last_raw, gone = None, frozenset()
        for b in batches:
            texts, keep = [], []
            for raw, hashes in zip(as_bytes(b.column(at)), b.column(len(names))):
                got = measures(raw or b"")
                bad = hashes.as_py()
                if bad != last_raw:
                    last_raw, gone = bad, frozenset(h & (1 << 64) - 1 for h in bad or ())
                lost = sum(w for h, w in got[5].items() if h in gone)
                failed = got[0] < min_words or 100 * got[4] > max_repeat_percent * got[0]
                keep.append(not failed and not lost > got[0] * depleted_share)
                if keep[-1] and gone:
                    left = [x for x in (raw or b"").split(b"\n") if not (parts := x.split()) or line_hash(parts) not in gone]
                    raw = b"\n".join(left)
                texts.append(raw)
            cols = list(b.columns[: len(names)])
            cols[at] = pa.array(texts, pa.binary()).cast(pa.string()).cast(b.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep, pa.bool_()))

    done = listed.mapInArrow(lean(run), schema)
    return done.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else done
