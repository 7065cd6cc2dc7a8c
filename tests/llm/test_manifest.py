"""The manifest against a tree built by hand."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def put(v):
    if v is None:
        return "-"
    t = str(v)
    return f"{len(t.encode())}:{t}"


def tree(nodes, fanout=3):
    """(root, proof of every node: its siblings, flat)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            low = i - i % fanout
            proofs[k] += [x for j, x in enumerate(nodes[low : low + fanout]) if low + j != i]
        at = [i // fanout for i in at]
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def by_hand(rows):
    """(doc_id, leaf, subroot, root, digest of the proof) of every row."""
    sources = {}
    for i, t, lang, s, n in rows:
        sources.setdefault(s, []).append((i is not None, i or 0, h(put(i), put(s), put(lang), put(n), put(t)), i))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for x, proof in zip(sorted(sources[s], key=lambda x: x[:3]), trees[s][1]):
            out.append((x[3], x[2], trees[s][0], root, h(*proof, *tops[k])))
    return sorted(out, key=str)


def corpus(sizes, seed=1):
    r = random.Random(seed)
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            text = r.choice([None, "", "é\nü", "one\ntwo\n", "x" * 3000]) if r.random() < 0.4 else f"text {r.random()}\nend"
            rows.append((i, text, r.choice(["en", None]), s, r.choice([len(text or ""), None])))
            i += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("levels", [1, 2])
@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 40, None: 7, "é": 1, "b": 3, "z": 28}, {f"s{k}": k for k in range(1, 12)}])
def test_proofs_by_hand(spark, sizes, levels):
    rows = corpus(sizes)
    if len(rows) > 1:
        rows += [rows[0], rows[1], (None, "no id", None, "a", 3), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"part": F.lit(1), "leaf": F.lit("x"), "place": F.lit(0)}).repartition(3)
    got = manifest.prove(docs, {"leaf": manifest.leaf(docs, COLUMNS)}, block_levels=levels)
    got = got.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("p"), manifest.folded(F.col("leaf"), F.col("proof"), F.col("spot")).alias("f")).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == by_hand(rows)
    assert all(r.f == r.root for r in got)


def test_changes_are_seen(spark):
    rows = corpus({"a": 30, "b": 5})
    docs = spark.createDataFrame(rows, SCHEMA)
    other = manifest.leaf(docs, COLUMNS, text=F.replace("text", F.lit("\n"), F.lit("")))
    got = manifest.prove(docs, {"leaf": manifest.leaf(docs, COLUMNS), "other": other}, block_levels=1)
    got = got.select("doc_id", (manifest.folded(F.col("other"), F.col("proof"), F.col("spot")) == F.col("root")).alias("ok")).collect()
    changed = {i for i, t, *_ in rows if t and "\n" in t}
    assert {r.doc_id for r in got if not r.ok} == changed and changed


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert manifest.prove(docs, {"leaf": manifest.leaf(docs, COLUMNS)}).count() == 0
