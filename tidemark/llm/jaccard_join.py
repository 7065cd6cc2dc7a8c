"""Exact Jaccard join of shingle sets by PartEnum signatures.

Two sets of sizes a and b with Jaccard similarity t or more differ in at most
k = (a + b)(1 - t)/(1 + t) elements. Sizes fall into bands that grow by 1/t, so
that partners are in the same or in neighbouring bands. For a band the feature
domain (64-bit shingle hashes) is split into n1 > k/2 partitions of three parts
each: some partition then holds at most one difference, and two of its three
parts agree. The signatures of a set are all pairs of parts, of its own band
and of the next. Sets that share no signature cannot be similar.

Before that, texts with equal sets fold into one class, and classes with too
many shingles that no other class has (counted over a fixed share of the hash
domain) drop out: they cannot reach t with anything. Both steps lose nothing.

Sets of a signature are first compared with the least one only, then, where they lie in
different components, with others chosen by hash, a few rounds long. The exact way
for the rest: of the members of signatures that are still in different
components, those are compared whose first common shingle, rare ones first,
leaves room for enough common ones. Groups of near copies thus do not unfold into
pairs, nor do texts that share a passage; texts of one template that are nearly but
not quite similar do, and each such pair is then compared.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, binaries, blocks_of, discard, flat, lean, materialise, text_bytes
from .components import least_labels, with_edges

_UPPER = bytes(range(0x41, 0x5B))
_TO_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
#: Bytes of text whose sets are made together.
BLOCK_BYTES = 4 << 20
#: Of 1024 hash values, so many are looked at to find unshared shingles.
LOOKED_AT = 512
#: Rounds of comparing the members of a signature with another head, at most.
HEAD_ROUNDS = 4
#: Partitions per half difference; above 1 so that most sets need no empty parts.
PARTITION_SLACK = 1.2


def block_sets(texts: list, width: int) -> list:
    """Sorted distinct 64-bit shingle hashes of every text (empty for none)."""
    import numpy as np
    import xxhash

    words: dict[bytes, int] = {}
    lists = [t.translate(_TO_LOWER).split() if t else [] for t in texts]
    n = sum(map(len, lists))
    codes = np.fromiter((words.setdefault(w, len(words)) for x in lists for w in x), np.int64, n)
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    one = known[codes]
    h = np.zeros(max(0, n - width + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + one[k : k + len(h)]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
    out, at = [], 0
    for x in lists:
        m = len(x)
        if m >= width:
            out.append(np.unique(h[at : at + m - width + 1]))
        elif m:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(x), seed=m)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += m
    return out


def bands(num: int, den: int, upto: int) -> list[int]:
    """Least sizes of the bands."""
    lows = [1]
    while lows[-1] <= upto:
        lows.append(lows[-1] * den // num + 1)
    return lows


def signatures(s, band: int, hi: int, num: int, den: int):
    """Signatures of the sorted set s for a band whose largest size is hi.

    A partition counts as good if two of its three parts have elements. If more
    partitions are good than differences can spoil, a shared signature with
    elements is certain, and those without are left out."""
    import numpy as np

    spread, total = den - num, den + num
    k = 2 * hi * spread // total
    n1 = int(PARTITION_SLACK * (k // 2)) + 1
    most = min(hi, len(s) * den // num)
    spoiled = (len(s) + most) * spread // total // 2
    edges = np.searchsorted(s >> np.uint64(32), (np.arange(3 * n1 + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(3 * n1))
    with np.errstate(over="ignore"):
        x = s * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x ^ (x >> np.uint64(29)), dtype=np.uint64)))
        part = (run[edges[1:]] - run[edges[:-1]]).reshape(n1, 3)
        filled = (np.diff(edges) > 0).reshape(n1, 3)
        place = np.arange(3 * n1, dtype=np.uint64).reshape(n1, 3) + np.uint64(band << 40)
        sig = np.roll(part, 1, axis=1) * np.uint64(3) + np.roll(part, 2, axis=1) * np.uint64(5) + place * np.uint64(0xC2B2AE3D27D4EB4F)
        sig = (sig ^ (sig >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        sig ^= sig >> np.uint64(31)
    if int((filled.sum(axis=1) >= 2).sum()) > spoiled:
        return sig[np.roll(filled, 1, axis=1) | np.roll(filled, 2, axis=1)]
    return sig.ravel()


def set_table(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash of every document."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import xxhash

        for _, b in blocks_of(batches, BLOCK_BYTES):
            sets = block_sets(as_bytes(b.column("text")), width)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "set_hash"],
            )

    return rows.mapInArrow(lean(run), f"doc_id {id_type}, text_hash long, n_shingles long, set_hash binary")


ENTRIES = "block long, bucket long, hashes binary, kinds binary, owners binary, keys binary"
KEY_BYTES = 16


def _entries(block: int, ids, sets: list, kinds, share: int, n_buckets: int, keys: list):
    """Record batch of a block: packed (hash, class, owner) lists, one row per hash
    bucket that gets any, and a row with the keys of the owners. Of the owners of a
    shingle, the first of the first two classes say all. 32 bits of the hash are
    kept: a clash only makes a shingle look shared. The work grows with the hashes
    of the block, however many buckets there are."""
    import numpy as np
    import pyarrow as pa

    some = [s[(s & np.uint64(1023)) < share] for s in sets]
    h = np.concatenate(some) if some else np.zeros(0, np.uint64)
    n = [len(s) for s in some]
    who, kind = np.repeat(np.asarray(ids, np.uint16), n), np.repeat(np.asarray(kinds, np.uint64), n)
    order = np.lexsort((who, kind, h))
    h, who, kind = h[order], who[order], kind[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    new_kind = fresh.copy()
    new_kind[1:] |= kind[1:] != kind[:-1]
    run = np.cumsum(new_kind)
    nth = run - np.maximum.accumulate(np.where(fresh, run, 0)) if len(h) else run
    keep = new_kind & (nth < 2)
    h, who, kind = h[keep], who[keep], kind[keep]
    bucket = np.minimum(h // np.uint64((1 << 64) // n_buckets), np.uint64(n_buckets - 1)).astype(np.int64)
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), bucket[1:] != bucket[:-1])))
    # The last row is that of the keys: its lists are empty.
    cuts = np.concatenate((head, [len(h), len(h)]))
    buckets = np.concatenate((bucket[head], [block % n_buckets]))
    columns = [
        pa.array(np.full(len(buckets), block, np.int64)), pa.array(buckets),
        *(binaries(x, cuts) for x in ((h >> np.uint64(10)).astype(np.uint32), kind, who)),
        pa.concat_arrays([pa.nulls(len(head), pa.binary()), pa.array([b"".join(keys)], pa.binary())]),
    ]
    return pa.RecordBatch.from_arrays(columns, ["block", "bucket", "hashes", "kinds", "owners", "keys"])


def _count_unshared(entries: DataFrame) -> DataFrame:
    """key, unshared: shingles of an owner that no other class has. Hash buckets
    get the packed lists and give back the owners of unshared ones. Owners are
    positions in a block of this very scan, so the scan sends their keys along:
    another scan may cut its blocks elsewhere."""

    def answer(table):
        import numpy as np
        import pyarrow as pa

        h, cuts = flat(table.column("hashes"), np.uint32)
        kinds, owners = flat(table.column("kinds"), np.uint64)[0], flat(table.column("owners"), np.uint16)[0]
        alone = np.zeros(len(h), bool)
        if len(h):
            order = np.argsort(h, kind="stable")
            ranked, kind = h[order], kinds[order]
            head = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            one = np.minimum.reduceat(kind, head) == np.maximum.reduceat(kind, head)
            alone[order] = np.repeat(one, np.diff(np.append(head, len(h))))
        found = binaries(owners[alone], np.concatenate(([0], np.cumsum(alone)))[cuts])
        return pa.table([table.column("block"), found, table.column("keys")], names=["block", "owners", "keys"])

    def count(table):
        import numpy as np
        import pyarrow as pa

        n = np.bincount(flat(table.column("owners"), np.uint16)[0])
        pos = np.flatnonzero(n)
        (keys,) = table.column("keys").drop_null().to_pylist()
        own = [keys[p : p + KEY_BYTES] for p in (pos * KEY_BYTES).tolist()]
        return pa.table([pa.array(own, pa.binary()), pa.array(n[pos], pa.int64())], names=["key", "unshared"])

    return (
        entries.groupBy("bucket").applyInArrow(answer, "block long, owners binary, keys binary")
        .groupBy("block").applyInArrow(count, "key binary, unshared long")
    )


def unshared_in_texts(docs: DataFrame, width: int) -> DataFrame:
    """Over a share of the hash domain, for all documents, by set hash."""
    size, _ = text_bytes(docs)
    n_buckets = max(16, size // BLOCK_BYTES)

    def ask(batches):
        import numpy as np
        import xxhash

        for block, b in blocks_of(batches, BLOCK_BYTES):
            sets = block_sets(as_bytes(b.column("text")), width)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            kinds = [int.from_bytes(k[-8:], "big") for k in keys]
            yield _entries(block, np.arange(len(sets)), sets, kinds, LOOKED_AT, n_buckets, keys)

    return _count_unshared(docs.select("doc_id", "text").mapInArrow(lean(ask), ENTRIES))


def unshared_in_sets(sets: DataFrame) -> DataFrame:
    """Over the whole hash domain, for the sets that are left (one per class), by cid."""
    total = int(sets.agg(F.sum("n_shingles")).first()[0] or 0)
    n_buckets = max(16, 6 * total // BLOCK_BYTES)

    def ask(batches):
        import numpy as np
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        for b in batches:
            cut = np.flatnonzero(np.diff(b.column("block").to_numpy())) + 1
            for mine in np.split(np.arange(b.num_rows), cut):
                if len(mine):
                    rows = b.slice(int(mine[0]), len(mine))
                    keys = [c.to_bytes(KEY_BYTES, "big", signed=True) for c in rows.column("cid").to_pylist()]
                    kinds = rows.column("cid").to_numpy()
                    own = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
                    block, serial = part << 32 | serial, serial + 1
                    yield _entries(block, np.arange(len(own)), own, kinds, 1024, n_buckets, keys)

    cid = F.conv(F.hex(F.substring("key", KEY_BYTES - 7, 8)), 16, 10).cast("long")
    return _count_unshared(sets.select("block", "cid", "hashes").mapInArrow(lean(ask), ENTRIES)).select(cid.alias("cid"), "unshared")


def sketch(s) -> bytes:
    """Parity of the number of elements in each of 2^k cells, at least four per
    element: one difference between two sets flips one bit at most."""
    import numpy as np

    cells = 64
    while cells < 4 * len(s):
        cells *= 2
    odd = np.bincount((s >> np.uint64(7) & np.uint64(cells - 1)).astype(np.intp), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


#: Columns of a set's brief sketch: 64 cells each, of one size for all sets.
BRIEF = ["brief0", "brief1", "brief2", "brief3"]


def brief(s):
    """As sketch(), of 256 cells, as four numbers."""
    import numpy as np

    odd = np.bincount((s >> np.uint64(7) & np.uint64(255)).astype(np.intp), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def flips(x: bytes, y: bytes) -> int:
    """Cells whose parity differs, the finer sketch folded to the coarser."""
    import numpy as np

    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) whose sets reach num/den. Sizes and sketches rule out
    most that do not; the rest is compared element by element."""
    sized = sets.select("cid", F.col("n_shingles").alias("n"), "sketch")
    near = (
        pairs.join(sized.withColumnsRenamed({"cid": "a", "n": "na", "sketch": "sa"}), "a")
        .join(sized.withColumnsRenamed({"cid": "b", "n": "nb", "sketch": "sb"}), "b")
        .where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
        .select("a", "b", "na", "nb", "sa", "sb")
    )

    def rule_out(batches):
        import pyarrow as pa

        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")))
            keep = [flips(x, y) * (den + num) <= (m + n) * (den - num) for m, n, x, y in rows]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            keep = []
            for x, y in zip(b.column("ha").to_pylist(), b.column("hb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("cid").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("cid").alias("b"), F.col("hashes").alias("hb"))
    close = near.mapInArrow(lean(rule_out), "a long, b long")
    return close.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(lean(compare), "a long, b long")


def apart(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """sig, cid, label of the members of signatures that lie in several components."""
    named = shared.join(labels, F.col("cid") == F.col("id"), "left").select("sig", "cid", F.coalesce("label", "cid").alias("label"))
    split = named.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("sig")
    return named.join(split, "sig")


def other_heads(members: DataFrame, sets: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b): one member of every signature, chosen by a hash that differs from
    signature to signature and turn to turn, with those of other components. Members
    whose size or brief sketch rules out their head are not paired with it."""
    known = ["cid", "label", "n_shingles", *BRIEF]
    members = members.join(sets.select("cid", "n_shingles", *BRIEF), "cid")
    heads = members.groupBy("sig").agg(F.min_by(F.struct(*known), F.struct(F.xxhash64("sig", "cid", F.lit(turn)), "cid")).alias("h"))
    m, n = F.col("n_shingles"), F.col("h.n_shingles")
    flipped = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"h.{c}"))) for c in BRIEF), F.lit(0))
    near = (F.least(m, n) * den >= F.greatest(m, n) * num) & (flipped * (den + num) <= (m + n) * (den - num))
    pairs = members.join(heads, "sig").where((F.col("label") != F.col("h.label")) & near)
    return pairs.select(F.least("cid", "h.cid").alias("a"), F.greatest("cid", "h.cid").alias("b")).distinct()


def across_components(sets: DataFrame, open_ones: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of sets in different components that may still be similar.

    Only shingles that occur in several components count. In one order for all
    sets (rare ones first), a similar pair's first common shingle must have as
    many shingles after it, in both, as the pair has to share: that leaves out
    shingles of passages that many texts have but that make up too little of
    them, and pairs of near copies that each differ too much."""

    def spread(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            raw = b.column("hashes").to_pylist()
            n = [len(x) // 8 for x in raw]
            for k in range(0, len(raw), 200):
                part = slice(k, k + 200)
                col = lambda c: pa.array(np.repeat(b.column(c).to_numpy()[part], n[part]))  # noqa: B023, E731
                h = np.frombuffer(b"".join(raw[part]), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), col("cid"), col("n_shingles"), col("label")], ["h", "cid", "n", "label"])

    rows = sets.join(open_ones, "cid").select("cid", "n_shingles", "label", "hashes").mapInArrow(lean(spread), "h long, cid long, n long, label long")
    crossing = (
        rows.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("x"), F.max("label").alias("y"))
        .where("x < y").select("h", "df")
    )
    back = Window.partitionBy("cid").orderBy(F.col("df").desc(), F.col("h").desc())
    # left: crossing shingles from this one on, itself included.
    kept = rows.join(crossing, "h").withColumn("left", F.row_number().over(back)).where(F.col("left") * den >= F.col("n") * num)
    kept = materialise(kept.select("h", "cid", "n", "label", "left"), "jaccard-crossing")
    other = kept.select("h", *[F.col(c).alias(f"{c}_b") for c in ("cid", "n", "label", "left")])
    enough = F.least("left", "left_b") * (num + den) >= (F.col("n") + F.col("n_b")) * num
    return (
        kept.join(other, "h").where((F.col("cid") < F.col("cid_b")) & (F.col("label") != F.col("label_b")) & enough)
        .select(F.col("cid").alias("a"), F.col("cid_b").alias("b"))
        .distinct()
    )


def join_components(docs: DataFrame, *, shingle_words: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id (least
    doc_id reachable by links), class_size (documents with the same set), kept
    (true for one row of every component, and for rows without words).

    Texts without words have no shingles and are linked with nothing, not even
    with each other; a null doc_id is treated as an id above all others; repeated
    rows are one class; an empty table gives no rows. A text is held whole by one
    task, at about a hundred bytes a word."""
    spark = docs.sparkSession
    table = materialise(set_table(docs, shingle_words).withColumn("row", F.monotonically_increasing_id()), "jaccard-sets")
    unshared = unshared_in_texts(docs, shingle_words).groupBy(F.col("key").alias("set_hash")).agg(F.max("unshared").alias("unshared"))
    classes = materialise(
        table.where("n_shingles > 0").groupBy("set_hash").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "text_hash", "n_shingles")).alias("first"),
            F.count(F.lit(1)).alias("class_size"),
        ).join(unshared, "set_hash", "left").na.fill(0, ["unshared"]).select("set_hash", F.col("first.row").alias("cid"), F.col("first.doc_id").alias("least_id"), "class_size", "unshared",
                 F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), F.col("first.n_shingles").alias("n_shingles")),
        "jaccard-classes",
    )
    alive = classes.where(F.col("unshared") * den <= F.col("n_shingles") * (den - num)).select(
        F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash"), "cid"
    )
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(
        alive, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_hash") == F.col("c_hash"))
    )

    def to_sets(batches):
        import numpy as np
        import pyarrow as pa

        for block, b in blocks_of(batches, BLOCK_BYTES):
            sets = block_sets(as_bytes(b.column("text")), shingle_words)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(sets), pa.int64()), pa.array(np.arange(len(sets))), b.column("cid"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary()),
                 *(pa.array(x) for x in np.array([brief(s) for s in sets]).reshape(-1, len(BRIEF)).T.copy())],
                ["block", "pos", "cid", "n_shingles", "hashes", "sketch", *BRIEF],
            )

    briefs = ", ".join(f"{c} long" for c in BRIEF)
    first = materialise(
        texts.select("cid", "text").mapInArrow(lean(to_sets), f"block long, pos long, cid long, n_shingles long, hashes binary, sketch binary, {briefs}"), "jaccard-alive"
    )
    again = unshared_in_sets(first).groupBy("cid").agg(F.max("unshared").alias("unshared"))
    left = (
        first.groupBy("cid").agg(F.first("n_shingles").alias("n"), F.min(F.struct("block", "pos")).alias("at"))
        .join(again, "cid", "left").na.fill(0, ["unshared"])
        .where(F.col("unshared") * den <= F.col("n") * (den - num))
        .select("at.block", "at.pos")
    )
    sets = materialise(first.join(left, ["block", "pos"]).select("cid", "n_shingles", "hashes", "sketch", *BRIEF), "jaccard-left")
    largest = int(sets.agg(F.max("n_shingles")).first()[0] or 0)
    lows = bands(num, den, largest * den // num + 1)

    def to_signatures(batches):
        import bisect

        import numpy as np
        import pyarrow as pa

        for b in batches:
            ids, found = [], []
            for cid, raw in zip(b.column("cid").to_pylist(), b.column("hashes").to_pylist()):
                s = np.frombuffer(raw, np.uint64)
                own = bisect.bisect_right(lows, len(s)) - 1
                for band in (own, own + 1):
                    sig = signatures(s, band, lows[band + 1] - 1 if band + 1 < len(lows) else lows[band] * den // num, num, den)
                    found.append(sig)
                    ids.append(np.full(len(sig), cid, np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(ids))], ["sig", "cid"]
                )

    sigs = sets.mapInArrow(lean(to_signatures), "sig long, cid long")
    heads = sigs.groupBy("sig").agg(F.min("cid").alias("head"), F.max("cid").alias("tail")).where("head < tail").select("sig", "head")
    shared = materialise(sigs.join(heads, "sig"), "jaccard-signatures")
    stars = shared.where("head < cid").select(F.col("head").alias("a"), F.col("cid").alias("b")).distinct()
    links = materialise(verified(stars, sets, num, den), "jaccard-links")
    labels = least_labels(links)
    # Copies of a text may differ too much from each other and be held together by one of
    # them that is not the least: heads chosen anew for each signature find it at a cost
    # of one comparison a member.
    for turn in range(HEAD_ROUNDS):
        tried = materialise(other_heads(apart(shared, labels), sets, turn, num, den).join(stars, ["a", "b"], "left_anti"), "jaccard-heads")
        closer = materialise(verified(tried, sets, num, den), "jaccard-closer")
        found = closer.limit(1).count()
        discard(tried)
        if not found:
            discard(closer)
            break
        labels = with_edges(labels, closer)
        discard(closer)
    open_ones = materialise(apart(shared, labels).select("cid", "label").distinct(), "jaccard-open")
    rest = across_components(sets, open_ones, num, den).join(stars, ["a", "b"], "left_anti")
    more = materialise(verified(rest, sets, num, den), "jaccard-more-links")
    if more.limit(1).count():
        labels = with_edges(labels, more)
    whole = classes.join(labels, F.col("cid") == F.col("id"), "left").withColumn("label", F.coalesce("label", "cid"))
    discard(first, sets, shared, links, open_ones, more)
    # Only classes with a link take part in the sums over components.
    linked = whole.where("id is not null").groupBy("label").agg(F.min(F.struct(F.col("least_id").isNull(), "least_id", "cid")).alias("head"))
    named_classes = whole.join(linked, "label", "left").select(
        F.col("set_hash").alias("k"), "class_size", F.coalesce("head.least_id", "least_id").alias("component_id"), F.coalesce("head.cid", "cid").alias("keeper")
    )
    return (
        table.join(named_classes, (F.col("set_hash") == F.col("k")) & (F.col("n_shingles") > 0), "left")
        .select("row", "doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"),
                (F.coalesce("keeper", "row") == F.col("row")).alias("kept"))
    )


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of every component: that of the least doc_id (null ids
    last), and one of them where rows repeat. Documents without words are linked
    with nothing and all stay; columns pass through unchanged whatever their names."""
    found = materialise(join_components(docs, **options).select("doc_id", "text_hash", "n_shingles", "kept"), "jaccard-found")
    # Rows are found again by id and text. Of rows that agree in both, all stay or one.
    own = f"_{uuid.uuid4().hex}_"
    keys = (
        found.groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"), ((F.count(F.lit(1)) > 1) & (F.max("n_shingles") > 0)).alias("again"))
        .where("kept").select(*[F.col(c).alias(own + c) for c in ("doc_id", "text_hash", "again")])
    )
    rows = docs.withColumn(own + "hash", F.xxhash64("text"))
    one = rows.join(keys, F.col("doc_id").eqNullSafe(F.col(own + "doc_id")) & (F.col(own + "hash") == F.col(own + "text_hash")))
    again = F.col(own + "again")
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    firsts = one.where(again).groupBy(own + "doc_id", own + "text_hash").agg(F.first(packed).alias(own + "row")).select(own + "row.*")
    return one.where(~again).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(firsts)
