"""Merkle manifest of a table: every row gets a proof up to one root.

Rows are leaves, in the order of their id within their source. Runs of ``fanout``
nodes are hashed together until a source has one node, its subroot; subroots are
hashed together in the same way, in the order of the sources.

Leaves are dealt into aligned blocks of fanout ** block_levels. A block computes
its own levels. Above them the blocks of a source exchange nodes as a butterfly:
in round r the blocks whose numbers differ in digit r alone (to the base of the
fanout) swap the roots of the subtrees they stand for, and all of them hash the
common ancestor. After the last round every block knows the subroot and has seen
all siblings on its way: proofs need no pass downwards. Groups have fanout rows at
most, whatever the size of a source. Where the last subtree has fewer blocks than
its neighbours, further members take the missing numbers and are dropped at the
end. Sources then do the same among themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, ranked

FANOUT = 3
#: Levels inside a block: 3 ** 6 leaves.
BLOCK_LEVELS = 6


def field(c: Column, kind: str = "") -> Column:
    """UTF-8 byte count, ':' and the value as text; '-' for null."""
    t = c if kind == "string" else c.cast("string")
    return F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))


def leaf(docs: DataFrame, columns: list[str], **changed: Column) -> Column:
    """Digest of a row's columns; ``changed`` stands in for some of them."""
    kinds = dict(docs.dtypes)
    return F.sha2(F.concat(*[field(changed.get(c, F.col(f"`{c}`")), kinds[c]) for c in columns]), 256)


def butterfly(nodes: DataFrame, by: list[str], fanout: int = FANOUT) -> DataFrame:
    """by, part, node, path, spot: the root that the parts 0..n_parts-1 of each ``by``
    have in common, with each part's siblings and its place among them, level by level.

    nodes: by, part, n_parts, node (hex). One shuffle of one small row per part and
    round; as many rounds as the part numbers have digits."""
    most = nodes.agg(F.max("n_parts")).first()[0] or 0
    state = nodes.select(*by, "part", "n_parts", "node", F.array().cast("array<array<string>>").alias("path"), F.array().cast("array<int>").alias("spot"))
    width = 1
    while width < most:
        active = F.col("n_parts") > width
        high = F.when(active, F.floor(F.col("part") / (width * fanout))).otherwise(F.col("part")).cast("long")
        low = F.when(active, F.col("part") % width).otherwise(F.lit(-1)).cast("long")
        digit = (F.floor(F.col("part") / width) % fanout).cast("int")
        met = state.withColumns({"high": high, "low": low, "digit": digit}).groupBy(*by, "n_parts", "high", "low").agg(
            F.array_sort(F.collect_list(F.struct("digit", "node", "path", "spot"))).alias("m")
        )
        met = met.withColumn("all", F.transform("m", lambda x: x["node"])).withColumn("up", F.sha2(F.array_join("all", ""), 256))
        met = met.withColumn("d", F.explode(F.when(active, F.sequence(F.lit(0), F.lit(fanout - 1))).otherwise(F.array(F.lit(0)))))
        own = F.coalesce(F.get("m", F.col("d")), F.get("m", F.lit(0)))
        others = F.concat(F.slice("all", F.lit(1), F.col("d")), F.slice("all", F.col("d") + 2, F.lit(fanout)))
        state = met.select(
            *by,
            F.when(active, (F.col("high") * fanout + F.col("d")) * width + F.col("low")).otherwise(F.col("high")).alias("part"),
            "n_parts",
            F.when(active, F.col("up")).otherwise(own["node"]).alias("node"),
            F.when(active, F.concat(own["path"], F.array(others))).otherwise(own["path"]).alias("path"),
            F.when(active, F.concat(own["spot"], F.array("d"))).otherwise(own["spot"]).alias("spot"),
        )
        width *= fanout
    return state.where("part < n_parts").drop("n_parts")


def run_up(nodes: list[str], fanout: int) -> list[str]:
    """The level above."""
    from hashlib import sha256

    return [sha256("".join(nodes[i : i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)]


def block_levels_of(leaves: list[str], n_keyed: int, fanout: int, levels: int) -> list[list[str]]:
    """All levels of a block, the leaves first: ``levels`` above them where the
    source has further blocks, else as many as it takes to one node."""
    out = [leaves]
    more = n_keyed > fanout**levels
    while len(out) <= levels if more else len(out[-1]) > 1:
        out.append(run_up(out[-1], fanout))
    return out


def prove(
    docs: DataFrame,
    leaves: dict[str, Column],
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    fanout: int = FANOUT,
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """One row per row of docs: doc_id, source, the columns of ``leaves`` (hex
    digests; the first is the leaf of the tree, others come along), subroot, root,
    proof (array of arrays: siblings level by level, left to right; none where a run
    has one node) and spot (own place in each run, from 0).

    A null source is a source, the first; null ids come first in their source; rows
    of one source and id are ordered by their leaf, equal ones are leaves each. An
    empty table gives no rows. Texts are digested where they are read and not
    shuffled, however long; what is shuffled is some 200 bytes a row."""
    names = list(leaves)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), *[c.alias(f"l{i}") for i, c in enumerate(leaves.values())])
    found = ranked(rows, ["source"], [F.col("doc_id").asc_nulls_first(), F.col("l0")], "manifest-leaves")
    size = fanout**block_levels
    entry = F.struct("place", "doc_id", *[f"l{i}" for i in range(len(names))])
    blocks = materialise(
        found.groupBy("source", "n_keyed", F.floor(F.col("place") / size).cast("long").alias("part")).agg(F.array_sort(F.collect_list(entry)).alias("leaves")),
        "manifest-blocks",
    )

    def roots(batches):
        import pyarrow as pa

        for b in batches:
            lists = (([x["l0"] for x in row], n) for row, n in zip(b.column("leaves").to_pylist(), b.column("n_keyed").to_pylist()))
            node = [block_levels_of(own, n, fanout, block_levels)[-1][0] for own, n in lists]
            yield pa.RecordBatch.from_arrays([b.column("source"), b.column("n_keyed"), b.column("part"), pa.array(node, pa.string())], ["source", "n_keyed", "part", "node"])

    kind = rows.schema["source"].dataType.simpleString()
    tops = blocks.mapInArrow(lean(roots), f"source {kind}, n_keyed long, part long, node string")
    upper = materialise(butterfly(tops.withColumn("n_parts", F.ceil(F.col("n_keyed") / size).cast("long")), ["source"], fanout), "manifest-upper")
    sources = ranked(upper.where("part = 0").select("source", F.col("node").alias("subroot")), [], [F.col("source").asc_nulls_first()], "manifest-sources")
    above = butterfly(sources.select(F.col("place").alias("part"), F.col("n_keyed").alias("n_parts"), F.col("subroot").alias("node")), [], fanout)
    crowns = sources.join(above, F.col("place") == F.col("part")).select(
        F.col("source").alias("t_source"), "subroot", F.col("node").alias("root"), F.col("path").alias("t_path"), F.col("spot").alias("t_spot")
    )
    ways = upper.join(crowns, F.col("source").eqNullSafe(F.col("t_source"))).select(
        F.col("source").alias("u_source"), F.col("part").alias("u_part"), "subroot", "root", F.concat("path", "t_path").alias("path"), F.concat("spot", "t_spot").alias("spot")
    )
    whole = blocks.join(ways, F.col("source").eqNullSafe(F.col("u_source")) & (F.col("part") == F.col("u_part"))).select("source", "n_keyed", "leaves", "subroot", "root", "path", "spot")
    own = [f"l{i}" for i in range(len(names))]
    id_kind = rows.schema["doc_id"].dataType.simpleString()

    def expand(batches):
        import pyarrow as pa

        for b in batches:
            for k, row in enumerate(b.column("leaves").to_pylist()):
                path, spot = b.column("path")[k].as_py(), b.column("spot")[k].as_py()
                levels = block_levels_of([x["l0"] for x in row], b.column("n_keyed")[k].as_py(), fanout, block_levels)[:-1]
                proofs, spots = [], []
                for i in range(len(row)):
                    mine, at = [], []
                    for level in levels:
                        low = i - i % fanout
                        run = level[low : low + fanout]
                        at.append(i - low)
                        mine.append(run[: i - low] + run[i - low + 1 :])
                        i //= fanout
                    proofs.append(mine + path)
                    spots.append(at + spot)
                same = lambda c: pa.concat_arrays([b.column(c).slice(k, 1)] * len(row))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["doc_id"] for x in row], leaf_type(b, "doc_id")), same("source"), *(pa.array([x[c] for x in row], pa.string()) for c in own),
                     same("subroot"), same("root"), pa.array(proofs, pa.list_(pa.list_(pa.string()))), pa.array(spots, pa.list_(pa.int32()))],
                    ["doc_id", "source", *own, "subroot", "root", "proof", "spot"],
                )

    def leaf_type(b, name):
        return b.column("leaves").type.value_type.field(name).type

    out = whole.mapInArrow(
        lean(expand), f"doc_id {id_kind}, source {kind}, {', '.join(f'{c} string' for c in own)}, subroot string, root string, proof array<array<string>>, spot array<int>"
    )
    return out.withColumnsRenamed(dict(zip(own, names)))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, in their order."""
    return F.sha2(F.array_join(F.flatten(proof), ""), 256)


def folded(start: Column, proof: Column, spot: Column, fanout: int = FANOUT) -> Column:
    """The root that a leaf and a proof lead to. Equal to the table's root: the leaf
    stands in the table at this place."""
    steps = F.arrays_zip(proof.alias("with"), spot.alias("at"))
    return F.aggregate(
        steps, start,
        lambda node, s: F.sha2(F.concat(F.array_join(F.slice(s["with"], F.lit(1), s["at"]), ""), node, F.array_join(F.slice(s["with"], s["at"] + 1, F.lit(fanout)), "")), 256),
    )
