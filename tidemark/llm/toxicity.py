"""Toxicity of texts whose spelling hides words: a noisy channel and a classifier.

A character language model (grams of four over a small alphabet, counted over all
texts) says which spellings are likely; a channel says what a writer may have made
of a letter: a look-alike, a run of it, or spaces and marks between letters. A
suspicious token becomes a lattice of the letters that may stand behind it, and the
Viterbi path through the lattice is the restored text. Words of the text and of the
restored tokens, and their beginnings, are the features of a logistic regression
that learns from labelled documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise

#: Symbols of the language model: word boundary, a-z, any other letter.
SYMBOLS = 28
OTHER = SYMBOLS - 1
#: Bytes of text that are counted together.
PIECE = 1 << 20
#: Labelled rows per class that the classifier learns from at most (a documented
#: bound: rows with the least digest of their id), and features that it keeps.
SAMPLE, FEATURES = 4_000, 2_000
#: Standard errors by which a feature's log odds have to differ from none.
SURE = 3.0
#: Words that a worker remembers between texts.
MEMO = 100_000

# Letters behind look-alikes.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t",
    "(": "c", "#": "h", "*": "aeiou", "€": "e", "£": "l", "¡": "i", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ԁ": "d",
}
#: Marks that may stand between the letters of a word, and those at its ends that are left off.
SEPARATORS = "._-~*'·"
ENDS = ".,;:!?\"'()[]{}<>«»“”„‘’…-_*~/\\"
HIDDEN = re.compile("[­͏​-‏⁠﻿̀-ͯ]")
#: Log probabilities: a look-alike, a symbol that means itself, a repeated letter, a
#: separator that means nothing or a boundary, and a boundary between spaced letters.
LOOKS, ITSELF, AGAIN, NOTHING, BREAK, INSERTED = log(0.3), log(0.01), log(0.4), log(0.5), log(0.5), log(0.05)

_MARK = "0-9@$!|+(#*€£¡"
_SUSPECT = re.compile(rf"[a-z].*[{_MARK}аеорсхуіѕԁ]|[{_MARK}аеорсхуіѕԁ].*[a-z]|([^\W\d_])\1\1|\w[{re.escape(SEPARATORS)}]+\w")
_RUN = re.compile(r"([^\W\d_])\1\1")
_FOREIGN = re.compile("[аеорсхуіѕԁ]")
_SPACED = re.compile(r"(?<!\S)(?:[^\s\w]?\w[^\s\w]?\s{1,3}|[@$!|+(#*€£¡]\s{1,3}){2,}[^\s\w]?[\w@$!|+(#*€£¡][^\s\w]?(?!\S)")


# --- language model -------------------------------------------------------------


def gram_counts(docs: DataFrame) -> DataFrame:
    """gram, n: how often each gram of four symbols stands in the texts. What comes
    before a boundary does not count. SYMBOLS ** 4 rows at most."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = np.zeros(256, np.uint8)
        table[ord("a") : ord("z") + 1] = table[ord("A") : ord("Z") + 1] = np.arange(1, 27)
        table[0xC0:] = OTHER
        table[0x80:0xC0] = 255  # later bytes of a character
        counts = np.zeros(SYMBOLS**4, np.int64)

        def count(data: bytes, before):
            x = table[np.frombuffer(data, np.uint8)]
            x = np.concatenate((before, x[x != 255])).astype(np.int64)
            x = x[np.concatenate(([True, True, True], (x[3:] > 0) | (x[2:-1] > 0)))] if len(x) > 3 else x
            c, b, a = x[2:-1], x[1:-2], x[:-3]
            b = np.where(c > 0, b, 0)
            a = np.where(b > 0, a, 0)
            counts[:] += np.bincount(((a * SYMBOLS + b) * SYMBOLS + c) * SYMBOLS + x[3:], minlength=len(counts))
            return x[-3:]

        for batch in batches:
            for text in batch.column("text").drop_null():
                data, before = text.as_py().encode() + b" ", np.zeros(3, np.int64)
                for i in range(0, len(data), PIECE):
                    before = count(data[i : i + PIECE], before)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["gram", "n"])

    return docs.select("text").mapInArrow(lean(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def log_probabilities(grams, n, weight: float = 5.0):
    """Array by (three symbols before, symbol): log probability, each order leaning on
    the next lower one with ``weight``."""
    import numpy as np

    counts = np.zeros(SYMBOLS**4)
    counts[np.asarray(grams, np.int64)] = n
    counts = counts.reshape((SYMBOLS,) * 4)
    p = (counts.sum((0, 1, 2)) + 1) / (counts.sum() + SYMBOLS)
    for c in (counts.sum((0, 1)), counts.sum(0), counts):
        p = (c + weight * p) / (c.sum(-1, keepdims=True) + weight)
    return np.log(p).astype(np.float32).ravel()


def language_model(docs: DataFrame):
    """log_probabilities() over all texts of docs; a table of fixed size."""
    got = gram_counts(docs).toArrow()
    return log_probabilities(got.column("gram").to_numpy(), got.column("n").to_numpy())


# --- channel ----------------------------------------------------------------------


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER


def choices(c: str) -> list[tuple[str, float]]:
    """Letters behind a written character, with their log probabilities; '' is
    nothing and ' ' a boundary."""
    if "a" <= c <= "z":
        return [(c, 0.0)]
    if c in LEET:
        found = [(x, LOOKS - log(len(LEET[c]))) for x in LEET[c]] + [(c, ITSELF)]
        return found + [("", NOTHING)] if c in SEPARATORS else found
    if c in SEPARATORS:
        return [("", NOTHING), (" ", BREAK)]
    return [(c, 0.0)] if c.isalpha() else [(" ", 0.0)]


def decode(written: str, lm, spaced: bool = False) -> str:
    """The likeliest text behind ``written``: a Viterbi path. States are the last three
    symbols, so there are as many as the letters of three characters allow; the time
    grows with the length. Spaced letters may have boundaries between them."""
    # state (up to three symbols as a number): (log probability, path as linked pairs)
    states = {0: (0.0, None)}
    square = SYMBOLS * SYMBOLS

    def put(into, state, score, path):
        held = into.get(state)
        if held is None or score > held[0]:
            into[state] = (score, path)

    last = ""
    for c in written:
        new: dict = {}
        for state, (score, path) in states.items():
            starts = [(state, score, path)]
            if spaced and state % SYMBOLS:
                starts.append((0, score + INSERTED + lm[state * SYMBOLS], (path, " ")))
            if c == last and state % SYMBOLS:
                put(new, state, score + AGAIN, path)
            for at, so_far, way in starts:
                for x, p in choices(c):
                    if x == "":
                        put(new, at, so_far + p, way)
                    elif x == " ":
                        put(new, 0, so_far + p + lm[at * SYMBOLS], (way, " ")) if at else put(new, 0, so_far + p, way)
                    else:
                        s = symbol(x)
                        put(new, at % square * SYMBOLS + s, so_far + p + lm[at * SYMBOLS + s], (way, x))
        states, last = new, c
    _, path = max((score + lm[state * SYMBOLS], k, path) for k, (state, (score, path)) in enumerate(states.items()))[:3:2]
    out = []
    while path is not None:
        path, x = path
        out.append(x)
    return "".join(reversed(out)).strip()


def restored(text: str, lm, memo: dict | None = None, calm: set | None = None) -> list[str]:
    """Words that the suspicious tokens of a lower-case text stand for. ``memo`` keeps
    what tokens were decoded to, ``calm`` the tokens that are not suspicious."""
    memo, calm = {} if memo is None else memo, set() if calm is None else calm
    out = []

    def add(written, spaced):
        key = (written, spaced)
        got = memo.get(key)
        if got is None:
            got = memo[key] = decode(written, lm, spaced).split()
        out.extend(got)

    if HIDDEN.search(text):
        text = HIDDEN.sub("", text)
        out.extend(text.split())
    # Most words are letters alone: they are suspicious only for runs and look-alikes.
    letters_tell = _RUN.search(text) or _FOREIGN.search(text)
    for w in set(text.split()) - calm:
        core = w.strip(ENDS)
        if core.isalpha() and not letters_tell:
            continue
        if len(core) > 2 and _SUSPECT.search(core):
            add(core, False)
        else:
            calm.add(w)
    for m in _SPACED.finditer(text):
        add("".join(x.strip(ENDS) or x for x in m.group().split()), True)
    return out


# --- classifier ---------------------------------------------------------------------


def features(word: str) -> list[str]:
    """A word and its beginnings of four and five letters."""
    return [word, *(f"{word[:k]}*" for k in (4, 5) if len(word) > k)]


def features_of(text: str | None, lm, memo: dict | None = None) -> set[str]:
    low = (text or "").lower()
    words = {w.strip(ENDS) for w in {*low.split(), *restored(low, lm, memo)}}
    words.discard("")
    return {f for w in words for f in features(w)}


@dataclass
class Model:
    """Weights of features, the constant, and the language model of the channel."""

    weights: dict[str, float]
    constant: float
    lm: object


def _sampled(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """text, label of at most ``most`` documents of each class, and how many labelled
    ids each class has."""
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {int(r["label"]): r["count"] for r in known.groupBy("label").count().collect() if r["label"] in (0, 1)}
    by = [F.md5(F.col("doc_id").cast("string")), "doc_id"]
    picked = known.where("label = 0").orderBy(*by).limit(most).unionByName(known.where("label = 1").orderBy(*by).limit(most))
    # 2 * most rows at most.
    some = docs.select(F.col("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("text", "label")
    return materialise(some, "toxicity-sample"), sizes


def _rate(x: float, n: float) -> float:
    return (x + 0.5) / (n + 1)


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, most_features: int = FEATURES) -> Model:
    """The model of docs (doc_id, text) and labels (doc_id, label 0 or 1).

    The language model counts all texts. The classifier learns from ``sample``
    documents of each class at most. Labels of one id that differ count as 1; null
    labels do not count. Without labels of both classes every score is the share of
    toxic labels, 0 without labels."""
    lm = language_model(docs)
    rows, sizes = _sampled(docs, labels, sample)
    n = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        share = sizes.get(1, 0) / max(1, sum(sizes.values()))
        return Model({}, log(max(share, 1e-9) / max(1 - share, 1e-9)), lm)

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        memo, table = {}, lm.tolist()
        for b in batches:
            held, size = [Counter(), Counter()], 0
            for text, label in zip(b.column("text"), b.column("label").to_pylist()):
                t = text.as_py()
                held[label].update(features_of(t, table, memo))
                size += len(t or "")
                if size > PIECE:
                    yield told(held, pa)
                    held, size = [Counter(), Counter()], 0
                    memo.clear()
            yield told(held, pa)

    def told(held, pa):
        keys = list(held[0] | held[1])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([held[0][k] for k in keys], pa.int64()), pa.array([held[1][k] for k in keys], pa.int64())], ["f", "n0", "n1"])

    counts = rows.mapInArrow(lean(count), "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 >= 3")
    r0, r1 = ((F.col(f"n{k}") + 0.5) / (n[k] + 1) for k in (0, 1))
    # Only what tells the classes apart by far more than chance among so many words.
    spread = F.sqrt(1 / (F.col("n0") + 0.5) + 1 / (F.col("n1") + 0.5))
    counts = counts.where(F.abs(F.log(r1 / r0)) > SURE * spread)
    best = counts.orderBy(((r1 - r0) * F.log(r1 / r0)).desc(), "f").limit(most_features).select("f").collect()
    index = {r["f"]: i for i, r in enumerate(best)}

    def hits(batches):
        import pyarrow as pa

        memo, table = {}, lm.tolist()
        for b in batches:
            found = []
            for t in b.column("text"):
                found.append(sorted(index[f] for f in features_of(t.as_py(), table, memo) if f in index))
                if len(memo) > MEMO:
                    memo.clear()
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(found, pa.list_(pa.int32()))], ["label", "hits"])

    told_hits = rows.mapInArrow(lean(hits), "label int, hits array<int>").toArrow()
    weights, constant = regression(told_hits.column("hits").to_pylist(), told_hits.column("label").to_pylist(), len(index))
    # The sample holds other shares of the classes than the labels.
    constant += log(sizes[1] / sizes[0]) - log(n[1] / n[0])
    return Model({f: float(weights[i]) for f, i in index.items()}, constant, lm)


def regression(hits: list[list[int]], labels: list[int], n_features: int, rounds: int = 1_500, penalty: float = 2e-5):
    """Weights and constant of a logistic regression over present features."""
    import numpy as np

    y = np.asarray(labels, float)
    at = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    col = np.fromiter((i for h in hits for i in h), np.int64, len(at))
    w, b = np.zeros(n_features), log(_rate(y.sum(), len(y)) / (1 - _rate(y.sum(), len(y))))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for k in range(1, rounds + 1):
        z = b + np.bincount(at, w[col], len(y))
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.append(np.bincount(col, d[at], n_features) + penalty * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1; higher: toxic likelier) and n_restored (words that the
    channel restored) of every row of docs (doc_id, text).

    Null and empty texts get the score of a text without features. Texts are read
    whole, at some hundred bytes of memory a word; repeated rows get a row each; an
    empty table gives none."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    weights, constant, lm = model.weights, model.constant, model.lm

    def run(batches):
        from math import exp

        import pyarrow as pa

        starts = {f[:-1] for f in weights if f.endswith("*")}
        plain: set = set()  # words without a feature of the model
        calm: set = set()
        memo, table = {}, lm.tolist()  # single numbers come faster out of a list
        for b in batches:
            scores, restorations = [], []
            for t in b.column("text"):
                low = (t.as_py() or "").lower()
                words = set(low.split())
                hidden = restored(low, table, memo, calm)
                found = set()
                for w in words.union(hidden) - plain:
                    core = w.strip(ENDS)
                    if core in weights or core[:4] in starts or core[:5] in starts:
                        found.update(f for f in features(core) if f in weights)
                    else:
                        plain.add(w)
                z = constant + sum(weights[f] for f in sorted(found))
                scores.append(1 / (1 + exp(-max(-30.0, min(30.0, z)))))
                restorations.append(len(hidden))
                for held in (plain, calm):
                    if len(held) > MEMO:
                        held.clear()
                if len(memo) > MEMO:
                    memo.clear()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array(restorations, pa.int64())], ["doc_id", "score", "n_restored"])

    return rows.mapInArrow(lean(run), f"doc_id {kind}, score double, n_restored long")
