"""The prefix trie against one built by hand."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie
from tidemark.llm.prefix_trie import SpillingQueue

SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            text = text or ""
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256(text.encode()).hexdigest(), text))
    own = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in own.items()}
    members = defaultdict(set)
    ends = defaultdict(set)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - c % 20, []) if c >= 0 else own.get(c + (-c) % 20, [])
        whole = tuple(base[:h] + own[c][h:])
        ends[whole].add(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].add(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = []

    def walk(k):
        below = [walk(x) for x in kids[k]]
        leaves = sum(x[0] for x in below) if below else 1
        words = len(k[-1][1].split()) if k else 0
        saved = (len(members[k]) - 1) * words + sum(x[1] for x in below)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves, saved, digest))
        return leaves, saved

    if members:
        walk(())
    return sorted(out, key=str)


def corpus(seed, n=90):
    r = random.Random(seed)
    texts = ["", None, "hello there", "a b c", "é ü", "one\ttwo\nthree"]
    rows = []
    for c in r.sample(range(-30, 200), n):
        for t in range(r.choice([1, 1, 2, 3, 5])):
            rows.append((c, r.choice([t, None]) if r.random() < 0.1 else t, r.choice(["user", None, "assistant"]) if t else "user", r.choice(texts)))
    rows += [rows[0], rows[1], (None, 0, "user", "x")]
    rows += [(7, t, "user", r.choice(texts)) for t in range(25)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"shard_rows": 20, "band": 2, "queue": 3}), (3, {"shard_rows": 7, "band": 5, "queue": 2})])
def test_trie_by_hand(spark, monkeypatch, seed, options):
    if options:
        monkeypatch.setattr(prefix_trie, "RUN_TURNS", 4)
        monkeypatch.setattr(prefix_trie, "CHUNK_BYTES", 6)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("x"), "place": F.lit(1), "words": F.lit(None)}).repartition(3)
    got = sorted([tuple(r) for r in prefix_trie.trie(docs, **options).collect()], key=str)
    assert got == by_hand(rows)


def test_copies_of_a_conversation(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 600, 3) for t in range(4)]
    got = sorted([tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), shard_rows=50).collect()], key=str)
    assert got == by_hand(rows)


def test_empty_table(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_queue_with_spills(seed):
    r = random.Random(seed)
    queue, held = SpillingQueue(5, page=2), []
    for _ in range(400):
        if held and r.random() < 0.45:
            assert queue.first() == min(held)
            held.remove(queue.pop())
        else:
            held.append((r.randrange(50), r.randrange(9)))
            queue.push(held[-1])
    rest = []
    while queue:
        rest.append(queue.pop())
    assert rest == sorted(held) and queue.n_runs > 3
