"""The Jaccard join on tiny tables and on tables where hardly any set is left."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import jaccard_join
from tidemark.llm.common import binaries, flat

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("rows", [[(1, "a b c")], [(1, None), (2, None), (3, "")], [(None, "a b c d e f")]])
def test_tiny_tables(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join_components(docs).collect()}
    size = lambda t: max(len(t.split()) - 4, 1) if t and t.split() else 0
    assert got == {(i, size(t), i) for i, t in rows}
    assert jaccard_join.keep_one_of_each(docs).count() == len(rows)


@pytest.mark.parametrize("seed", range(1))
def test_one_short_pair_among_distinct_texts(spark, seed):
    r = random.Random(seed)
    texts = [" ".join(f"w{r.randrange(10**9)}" for _ in range(200)) for _ in range(400)]
    pair = [f"w{r.randrange(10**9)}" for _ in range(24)]
    rows = [*enumerate(texts), (1000, " ".join(pair)), (1001, " ".join([*pair, "more"]))]
    got = {x.doc_id: x.component_id for x in jaccard_join.join_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (1000 if i == 1001 else i) for i, _ in rows}


@pytest.mark.parametrize("seed", range(20))
def test_entries_tell_who_is_alone(spark, seed):
    """Lists of many buckets, several of them with keys alone."""
    r = np.random.default_rng(seed)
    sets = [np.unique(r.integers(0, 2**64, r.integers(0, 30), np.uint64)) for _ in range(5)]
    sets[3] = sets[0]
    keys = [bytes([k]) * jaccard_join.KEY_BYTES for k in range(5)]
    batch = jaccard_join._entries(3, np.arange(5), sets, [0, 1, 2, 3, 4], 1024, 1 << 40, keys)
    lists = pa.Table.from_batches([batch])
    h, cuts = flat(lists.column("hashes"), np.uint32)
    owners, _ = flat(lists.column("owners"), np.uint16)
    assert cuts[-1] == cuts[-2] == len(h) == len(owners)
    assert lists.column("keys").drop_null().to_pylist() == [b"".join(keys)]
    want = sorted((int(x >> np.uint64(10)) & 0xFFFFFFFF, i) for i, s in enumerate(sets) for x in s)
    assert sorted(zip(h.tolist(), owners.tolist())) == want
    assert len(set(lists.column("bucket").to_pylist()[:-1])) == len(lists) - 1


def test_binaries_and_back():
    values = np.arange(10, dtype=np.uint16)
    column = binaries(values, [0, 0, 3, 10, 10])
    assert column.to_pylist()[1] == values[:3].tobytes()
    for x in (column, pa.chunked_array([column.slice(1), column.slice(0, 2)])):
        back, cuts = flat(x, np.uint16)
        assert [back[a:b].tobytes() for a, b in zip(cuts, cuts[1:])] == x.to_pylist()


def test_copies_around_a_middle(spark, monkeypatch):
    """Copies that are similar to one text in the middle and not to each other: other
    heads link them, and the exact step is left with few pairs."""
    r, n = random.Random(5), 60
    base = [f"w{r.randrange(10**9)}" for _ in range(400)]
    rows = []
    for i in range(n):
        copy = list(base)
        # The text in the middle is not the first row: the least of a signature is a copy.
        for at in r.sample(range(0, 400, 10), 9 if i != n // 2 else 0):
            copy[at] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    pairs = []
    whole = jaccard_join.across_components
    monkeypatch.setattr(jaccard_join, "across_components", lambda *a: pairs.append(whole(*a)) or pairs[-1])
    counted = []
    kept = jaccard_join.materialise
    monkeypatch.setattr(jaccard_join, "materialise", lambda df, label: counted.append(pairs[-1].count()) or kept(df, label) if label == "jaccard-more-links" else kept(df, label))
    got = {x.doc_id: x.component_id for x in jaccard_join.join_components(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()}
    assert got == {i: 0 for i in range(n)}
    assert counted and counted[0] < n
