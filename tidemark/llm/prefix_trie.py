"""Prefix trie of conversations, with totals of subtrees by time-forward processing.

A node is a distinct sequence of first turns. It is known by two 64-bit hashes that
depend on every turn and its position, so the prefixes of a conversation are
running sums and a conversation may be cut anywhere.

Conversations are dealt into shards by ranges of conv_id, and within a shard into
bands of depth. A shard has its own copy of every prefix of its conversations; the
shard with a node's smallest member owns the node and alone counts its value. The
copies of a shard are sorted by falling depth (reverse level order). They are read
once: a node takes what its children sent it from a priority queue, adds its own
value and sends the sum to its parent, which comes later in the order. The queue
holds a fixed number of messages and spills the rest as sorted runs. Tops of a band
send theirs to the next band up. The totals of a node over all shards are then the
sums over its copies, one shuffle with partial sums.
"""

from __future__ import annotations

import heapq
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialise, ranked, shuffle_partitions

#: Turns of a conversation that one window holds at most.
RUN_TURNS = 2_000
#: Depths of a band.
BAND = 50_000
#: Copies of nodes per shard, and shards at most (their bounds travel with the code).
SHARD_ROWS, MAX_SHARDS = 100_000, 20_000
#: Messages that a queue keeps in memory.
QUEUE = 100_000
#: Bytes of a list of ids that one row carries.
CHUNK_BYTES = 1 << 16


class SpillingQueue:
    """Priority queue of tuples: the least comes first. Above ``most`` entries, the
    later half goes to disk as a sorted run, in a file without a name that ends with
    the task; runs are read back in order, a few entries at a time."""

    def __init__(self, most: int = QUEUE, page: int = 256):
        self.most, self.page, self.heap, self.runs, self.n_runs = most, page, [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        import pickle

        self.heap.sort()
        half = max(1, len(self.heap) // 2)
        file = tempfile.TemporaryFile()
        for i in range(half, len(self.heap), self.page):
            pickle.dump(self.heap[i : i + self.page], file)
        del self.heap[half:]
        file.seek(0)
        self.n_runs += 1
        self._next([], 0, file, self.n_runs)

    def _next(self, page: list, at: int, file, run: int) -> None:
        """The run, by its next entry, among the runs; a page is read where one ends."""
        import pickle

        if at == len(page):
            try:
                page, at = pickle.load(file), 0
            except EOFError:
                file.close()
                return
        heapq.heappush(self.runs, (page[at], run, at, page, file))

    def __bool__(self) -> bool:
        return bool(self.heap or self.runs)

    def first(self) -> tuple:
        heads = [x[0] for x in (self.heap[:1], [r[0] for r in self.runs[:1]]) if x]
        return min(heads)

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, run, at, page, file = heapq.heappop(self.runs)
            self._next(page, at + 1, file, run)
            return item
        return heapq.heappop(self.heap)


# --- turns ----------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place, n_keyed (turns of the conversation), role, digest of the text
    and its words, one row per turn, in the order of turn, nulls first; turns with
    one number are ordered by role and digest. Null role and text count as empty;
    rows without conv_id belong to no conversation and are left out. Texts are
    digested where they are read."""
    text = F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        "conv_id", F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.sha2(text, 256).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    return ranked(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], "trie-turns").drop("turn")


def rebuilt(found: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """conv_id, depth (from 1), role, digest, words and n_turns of rebuilt
    conversations, and one row of depth 0 for each: the first h turns of the first
    conversation of the family (conv_id - conv_id % family), then its own after its
    first h; h is the CRC-32 of the decimal conv_id modulo ``most``."""
    h = F.crc32(F.col("conv_id").cast("string")) % most
    base = F.col("conv_id") - F.col("conv_id") % family
    convs = found.groupBy("conv_id").agg(F.max("n_keyed").alias("n")).withColumns({"h": h, "base": base})
    bases = convs.where("conv_id = base").select(F.col("base").alias("b"), F.col("n").alias("n_base"))
    convs = convs.join(bases, F.col("base") == F.col("b"), "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = materialise(convs.select("conv_id", "n", "h", "base", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("n_turns")), "trie-conversations")
    kept = ["conv_id", "depth", "role", "digest", "words", "n_turns"]
    own = found.where(F.col("place") >= h).join(convs.select("conv_id", "h", "taken", "n_turns"), "conv_id")
    own = own.withColumn("depth", F.col("taken") + F.col("place") - F.col("h") + 1)
    heads = found.where((F.col("conv_id") == base) & (F.col("place") < most - 1)).select(F.col("conv_id").alias("base"), "place", "role", "digest", "words")
    lent = convs.select("conv_id", "base", "h", "n_turns").join(heads, "base").where("place < h").withColumn("depth", F.col("place") + 1)
    tops = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("words"), "n_turns")
    return own.select(*kept).unionByName(lent.select(*kept)).unionByName(tops)


def with_prefixes(rows: DataFrame) -> DataFrame:
    """rows (conv_id, depth, ...) with hashes a and b of the turns up to this one, and
    pa and pb of those before it. Long conversations are cut; what a cut starts from
    comes from a table with one row per cut."""
    salted = lambda k: F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(k), "depth", "role", "digest"))
    rows = rows.withColumns({"ua": salted(1), "ub": salted(2), "cut": F.floor(F.col("depth") / RUN_TURNS).cast("long")}).drop("role", "digest")
    sums = rows.groupBy("conv_id", "cut").agg(F.bit_xor("ua").alias("sa"), F.bit_xor("ub").alias("sb"))
    earlier = Window.partitionBy("conv_id").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    carried = sums.select("conv_id", "cut", *[F.coalesce(F.bit_xor(s).over(earlier), zero).alias(c) for s, c in (("sa", "ca"), ("sb", "cb"))])
    inside = Window.partitionBy("conv_id", "cut").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.select("*", F.bit_xor("ua").over(inside).alias("ra"), F.bit_xor("ub").over(inside).alias("rb"))
    found = runs.join(carried, ["conv_id", "cut"])
    a, b = F.col("ra").bitwiseXOR(F.col("ca")), F.col("rb").bitwiseXOR(F.col("cb"))
    return found.select("conv_id", "depth", "words", "n_turns", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("ua")).alias("pa"), b.bitwiseXOR(F.col("ub")).alias("pb"))


# --- nodes ------------------------------------------------------------------------


def shard_of(rows: DataFrame, shard_rows: int, band: int) -> Column:
    """Shard by range of conv_id and band of depth. The bounds of the ranges are
    quantiles: at most MAX_SHARDS numbers, whatever the size of the table."""
    import numpy as np
    import pandas as pd

    spark = rows.sparkSession
    n = min(MAX_SHARDS, max(shuffle_partitions(spark), rows.count() // shard_rows))
    at = F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
    got = rows.agg(F.percentile_approx("conv_id", at, F.lit(10 * n)).alias("x")).first()["x"] or []
    bounds = np.unique(np.array(got, np.int64))

    def slot(ids):
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right"))

    slot.__annotations__ = {"ids": pd.Series, "return": pd.Series}
    return F.pandas_udf(slot, "long")("conv_id") * F.lit(1 << 32) + F.floor(F.col("depth") / band)


COPY = "shard long, depth long, a long, b long, pa long, pb long, conv_id long, n_convs long, own long, words long, n_ends long"


def copies(rows: DataFrame, shard_rows: int = SHARD_ROWS, band: int = BAND) -> DataFrame:
    """One row per shard and node (a, b, depth) that it has: the node's smallest
    member, its members and those that end there, and own: 1 in the shard that owns
    it. rows: with_prefixes() with ``ends`` (0 or 1)."""
    sharded = rows.withColumn("shard", shard_of(rows, shard_rows, band))
    local = sharded.groupBy("shard", "depth", "a", "b").agg(
        F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n"), F.sum("ends").alias("e"), F.max("words").alias("words"), F.max("pa").alias("pa"), F.max("pb").alias("pb")
    )
    # One row per shard that has the node.
    all_of = Window.partitionBy("depth", "a", "b")
    whole = local.withColumns({"conv_id": F.min("least").over(all_of), "n_convs": F.sum("n").over(all_of), "n_ends": F.sum("e").over(all_of)})
    return whole.select("shard", "depth", "a", "b", "pa", "pb", "conv_id", "n_convs", (F.col("least") == F.col("conv_id")).cast("long").alias("own"), "words", "n_ends")


SENT = "shard long, depth long, a long, b long, conv_id long, child_depth long, n_convs long, n_children long, n_leaves long, saved long, own long, parent_conv_id long, done boolean"


def forward(batches, queue: int = QUEUE):
    """Rows of a task by shard, falling depth, a and b, in the form of SENT: nodes
    (child_depth null) among what a deeper band sent (child_depth set). Gives rows of
    nodes whose parent is known (done), and of tops of the band, addressed to their
    parent."""
    import pyarrow as pa

    names = [x.split()[0] for x in SENT.split(", ")]
    out: list[tuple] = []

    def batch():
        cols = list(zip(*out)) or [()] * len(names)
        kinds = [pa.int64()] * (len(names) - 1) + [pa.bool_()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    shard, waiting = None, SpillingQueue(queue)

    def flush():
        # What is left has its parent in the band above.
        while waiting:
            key, message = waiting.pop()
            out.append((shard, -key[0], key[1], key[2], *message, None, False))

    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("shard", "depth", "a", "b", "pa", "pb", "conv_id", "n_convs", "own", "words", "n_ends", "child_depth", "n_children", "n_leaves", "saved")]
        for s, depth, x, y, px, py, conv, n, own, words, ends, child, kids, leaves, saved in zip(*columns):
            if s != shard:
                flush()
                shard = s
            if child is not None:
                waiting.push(((-depth, x, y), (conv, child, n, kids, leaves, saved, own)))
                continue
            kids, leaves, saved = 0, own * (ends == n), own * (n - 1) * words
            key = (-depth, x, y)
            while waiting and waiting.first()[0] <= key:
                at, message = waiting.pop()
                if at != key:  # a message to a node that stands in the band above
                    raise AssertionError("a node's parent comes after it in its shard")
                out.append((s, depth, x, y, *message, conv, True))
                leaves, saved, kids = leaves + message[4], saved + message[5], kids + message[6]
            if depth:
                waiting.push(((1 - depth, px, py), (conv, depth, n, kids, leaves, saved, own)))
            else:
                out.append((s, depth, x, y, conv, 0, n, kids, leaves, saved, own, None, True))
            if len(out) >= 10_000:
                yield batch()
    flush()
    yield batch()


def id_digests(ends: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ends_sha256: digest of the decimal conv_ids of a key in ascending order,
    comma-joined. Ids are range-sorted and joined to pieces of CHUNK_BYTES first; the
    pieces of a key are then digested in their order, one after the other, as the
    digest demands; nothing holds more than a piece."""
    n = shuffle_partitions(ends.sparkSession)
    kinds = ", ".join(f"{k} long" for k in keys)

    def pieces(batches):
        import pyarrow as pa

        key, first, part, size, out = None, None, [], 0, []

        def close():
            if part:
                out.append((*key, first, ",".join(part)))

        def batch():
            cols = list(zip(*out)) or [()] * (len(keys) + 2)
            out.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.string())], [*keys, "first", "ids"])

        for b in batches:
            for *k, i in zip(*(b.column(c).to_pylist() for c in (*keys, "conv_id"))):
                if k != key or size >= CHUNK_BYTES:
                    close()
                    key, first, part, size = k, i, [], 0
                part.append(str(i))
                size += len(part[-1]) + 1
            if len(out) >= 1_000:
                yield batch()
        close()
        yield batch()

    def digests(batches):
        import hashlib

        import pyarrow as pa

        key, state = None, None
        for b in batches:
            out = []
            for *k, ids in zip(*(b.column(c).to_pylist() for c in (*keys, "ids"))):
                if k != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield told(out, pa)
        yield told([(*key, state.hexdigest())] if key is not None else [], pa)

    def told(rows, pa):
        cols = list(zip(*rows)) or [()] * (len(keys) + 1)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.string())], [*keys, "ends_sha256"])

    order = [*keys, "conv_id"]
    cut = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(lean(pieces), f"{kinds}, first long, ids string")
    return cut.repartition(n, *keys).sortWithinPartitions(*keys, "first").mapInArrow(lean(digests), f"{kinds}, ends_sha256 string")


def trie(conversations: DataFrame, *, shard_rows: int = SHARD_ROWS, band: int = BAND, queue: int = QUEUE, rebuild=rebuilt) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id (null for
    the root), n_convs, n_children, n_leaves and saved_tokens of its subtree, and
    ends_sha256.

    conversations: conv_id, turn, role, text; other columns are left aside. Rows that
    repeat are turns each; an empty table has no members and gives no rows. See
    turns() for nulls and ties; texts are read whole where they stand, and any number
    of turns or members may share a conversation or a node."""
    rows = with_prefixes(rebuild(turns(conversations))).withColumn("ends", (F.col("depth") == F.col("n_turns")).cast("long")).drop("n_turns")
    rows = materialise(rows, "trie-rows")
    nodes = materialise(copies(rows, shard_rows, band), "trie-copies")
    n = shuffle_partitions(rows.sparkSession)
    null = F.lit(None).cast("long")
    plain = nodes.withColumns({c: null for c in ("child_depth", "n_children", "n_leaves", "saved")})
    deepest = nodes.agg(F.max("depth")).first()[0]
    done, sent = None, None
    for k in range((deepest or 0) // band, -1, -1):
        here = plain.where(F.floor(F.col("depth") / band) == k)
        if sent is not None:
            up = sent.where("not done").withColumns({"shard": F.col("shard") - 1, **{c: null for c in ("pa", "pb", "words", "n_ends")}})
            here = here.unionByName(up.select(*here.columns))
        # Messages stand before the nodes of their level.
        ordered = here.repartition(n, "shard").sortWithinPartitions("shard", F.col("depth").desc(), "a", "b", F.col("child_depth").asc_nulls_last())
        sent = materialise(ordered.mapInArrow(lean(lambda x: forward(x, queue)), SENT), "trie-totals")
        done = sent.where("done") if done is None else done.unionByName(sent.where("done"))
    totals = done.groupBy(F.col("conv_id"), F.col("child_depth").alias("depth")).agg(
        F.max("parent_conv_id").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    digests = id_digests(rows.where("ends = 1"), ["depth", "a", "b"])
    named = digests.join(nodes.where("own = 1").select("depth", "a", "b", "conv_id"), ["depth", "a", "b"]).select(F.col("conv_id").alias("e_conv"), F.col("depth").alias("e_depth"), "ends_sha256")
    whole = totals.join(named, (F.col("conv_id") == F.col("e_conv")) & (F.col("depth") == F.col("e_depth")), "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
