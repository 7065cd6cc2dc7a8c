"""The channel against exhaustive search, and the classifier on planted words."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity as T

WORDS = "the of and to in that it was for on are with as his they be at one have this some more people time water round".split()
BAD = ["stupid", "idiot", "worthless"]


def prose(r, n, bad=None):
    words = [r.choice(WORDS) + r.choice(["", "", "er", "ing"]) for _ in range(n)]
    if bad:
        words[r.randrange(n)] = bad
    return " ".join(words)


def by_hand(texts):
    """Counts of grams, symbol by symbol."""
    found = Counter()
    for t in texts:
        before = [0, 0, 0]
        for c in t.lower() + " ":
            s = T.symbol(c) if "a" <= c <= "z" else T.OTHER if ord(c) >= 0xC0 else 0
            if not s and not before[-1]:
                continue
            c3 = before[-1]
            c2 = before[-2] if c3 else 0
            c1 = before[-3] if c2 else 0
            found[((c1 * 28 + c2) * 28 + c3) * 28 + s] += 1
            before = [*before[1:], s]
    return found


def test_gram_counts(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 5)
    texts = ["Ab  abc, é1 x", "", " ", "über straße 12 a", "no" * 30]
    docs = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(2)
    got = {r["gram"]: r["n"] for r in T.gram_counts(docs).collect()}
    # Characters between 0x80 and 0xC0 do not occur, so bytes and characters agree.
    assert got == dict(by_hand(texts))


@pytest.fixture(scope="module")
def lm():
    r = random.Random(3)
    texts = [prose(r, 40, r.choice(BAD)) for _ in range(300)]
    c = by_hand(texts)
    return T.log_probabilities(list(c), list(c.values()))


@pytest.mark.parametrize("clear, written", [
    ("stupid", "stup1d"), ("stupid", "$tup!d"), ("idiot", "1d10t"), ("idiot", "id.i.ot"), ("worthless", "w0rthle55"), ("stupid", "stuuuupid"), ("idiot", "iiidiooot"), ("idiot", "idi*t"),
])
def test_restored_words(lm, clear, written):
    assert clear in T.restored(f"some {written}, more", lm)
    assert not T.restored("some people, more water (round) time", lm)


def test_spaced_and_hidden(lm):
    assert "idiot" in " ".join(T.restored("some i d i o t more", lm))
    assert "stupid" in " ".join(T.restored("some s-t-u-p-i-d more", lm))
    assert "stupid" in T.restored("some stu​pid more", lm)


def test_decode_is_the_best_path(lm):
    """Against all ways through the lattice."""

    def brute(written):
        best = (-1e9, "")
        for ways in itertools.product(*[[*T.choices(c), *([("again", T.AGAIN)] if i and written[i - 1] == c else [])] for i, c in enumerate(written)]):
            score, before, out = 0.0, [0, 0, 0], ""
            for x, p in ways:
                if x == "again":
                    score = score + p if before[-1] else -1e9
                    continue
                score += p
                if x == " ":
                    if any(before):
                        score += lm[((before[0] * 28 + before[1]) * 28 + before[2]) * 28]
                        before, out = [0, 0, 0], out + " "
                elif x:
                    s = T.symbol(x)
                    score += lm[((before[0] * 28 + before[1]) * 28 + before[2]) * 28 + s]
                    before, out = [*before[1:], s], out + x
            score += lm[((before[0] * 28 + before[1]) * 28 + before[2]) * 28]
            best = max(best, (score, out.strip()))
        return best[1]

    r = random.Random(4)
    for _ in range(25):
        written = "".join(r.choice("stupid1d0!-ee") for _ in range(6))
        assert T.decode(written, lm) == brute(written), written


def test_classifier(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 3 == 0
        rows.append((i, prose(r, 60, r.choice(BAD) if toxic else None)))
        if i < 300:
            labels.append((i, int(toxic)))
    hidden = ["stup1d", "1d10t", "w0rthle55", "i d i o t"]
    rows += [(1000 + k, prose(r, 60, w)) for k, w in enumerate(hidden)] + [(2000, None), (2001, ""), (2002, "w " * 40_000), (5, rows[5][1]), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"label": F.lit(1), "score": F.lit("x")}).repartition(3)
    marks = spark.createDataFrame([*labels, labels[0], (7, None), (None, 1)], "doc_id long, label int")
    model = T.fit(docs, marks)
    got = T.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    of = {x.doc_id: x.score for x in got}
    assert all((of[i] >= 0.5) == (i % 3 == 0) for i in range(400))
    assert all(of[1000 + k] >= 0.5 for k in range(len(hidden)))
    assert max(of[i] for i in (2000, 2001, 2002, None)) < 0.5
    again = {x.doc_id: x.score for x in T.score(docs.repartition(5), T.fit(docs.repartition(2), marks)).collect()}
    assert all(abs(of[i] - again[i]) < 1e-6 for i in of)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label int")
    assert all(x.score < 0.5 for x in T.score(docs, T.fit(docs, none)).collect())
    one = spark.createDataFrame([(1, 1)], "doc_id long, label int")
    assert all(x.score > 0.5 for x in T.score(docs, T.fit(docs, one)).collect())
    empty = docs.limit(0)
    assert T.score(empty, T.fit(empty, none)).count() == 0


def test_held_out_documents(spark):
    """Labelled documents of the given tables whose labels the model has not seen (six
    toxic ones; some labels of these tables are wrong)."""
    import os

    from tidemark.llm.queries import op13_toxicity

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("the given tables are not here")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [(r["score"], labels[r["doc_id"]]) for r in op13_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = (np.array([s for s, y in got if y == k]) for k in (1, 0))
    ahead = (toxic[:, None] > clean[None, :]) + 0.5 * (toxic[:, None] == clean[None, :])
    assert len(toxic) and ahead.mean() > 0.85
    assert (clean < 0.5).mean() > 0.98
