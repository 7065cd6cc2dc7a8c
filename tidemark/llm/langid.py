"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed character 1- to 3-grams.
Every language has several centroids, found by spherical k-means over its
sample documents; the language of the nearest centroid (by cosine) wins, and a
document that is much farther from it than sample documents of its length are
is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, lean

DIMS = 1 << 14
_SPACE = np.uint32(32)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_SHIFT = np.uint64(64 - 14)


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_LETTER = _letters()


def grams(text: str) -> tuple[np.ndarray, int]:
    """Counts of hashed 1- to 3-grams of letters, and the number of letters."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _LETTER[a]
    a = np.where(letter, a, _SPACE)
    n = int(letter.sum())
    a = a[letter | np.concatenate(([True], letter[:-1]))] if len(a) else a
    x = a.astype(np.uint64)
    count = np.bincount(((x * _MIX[0]) >> _SHIFT).astype(np.intp), minlength=DIMS)
    if len(x) > 1:
        two = (x[:-1] << np.uint64(21)) | x[1:]
        count += np.bincount(((two * _MIX[1]) >> _SHIFT).astype(np.intp), minlength=DIMS)
        if len(x) > 2:
            three = (two[:-1] << np.uint64(21)) | x[2:]
            count += np.bincount(((three * _MIX[2]) >> _SHIFT).astype(np.intp), minlength=DIMS)
    return count, n


def _bin(n_letters: int) -> int:
    return min(n_letters.bit_length(), 20)


@dataclass
class Centroids:
    labels: list[str]
    idf: np.ndarray
    matrix: np.ndarray  # one row per centroid
    owner: np.ndarray  # index into labels of each row
    floor: np.ndarray  # least cosine that is accepted, by bit length of the letter count
    least_letters: int = 0

    def predict(self, text: str | None) -> tuple[str, float, bool, str | None]:
        """Language, score in 0..1, whether it is rejected, and the runner-up."""
        if not text:
            return "und", 0.0, True, None
        count, n = grams(text)
        if n == 0 or not self.labels:
            return "und", 0.0, True, None
        v = np.sqrt(count, dtype=np.float32) * self.idf
        norm = float(np.sqrt(v @ v)) or 1.0
        best = np.full(len(self.labels), -1.0)
        np.maximum.at(best, self.owner, (self.matrix @ v) / norm)
        order = np.argsort(-best, kind="stable")
        score = min(1.0, max(0.0, float(best[order[0]])))
        second = self.labels[order[1]] if len(order) > 1 else None
        return self.labels[order[0]], score, bool(n >= self.least_letters and score < self.floor[_bin(n)]), second


def _kmeans(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    """Unit centroids of spherical k-means over the unit rows of x."""
    pick = [int(rng.integers(len(x)))]
    near = x @ x[pick[0]]
    while len(pick) < min(k, len(x)):  # farthest-first start
        pick.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[pick[-1]])
    c = x[pick]
    for _ in range(rounds):
        to = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (to == j).any():
                m = x[to == j].sum(axis=0)
                c[j] = m / (np.linalg.norm(m) or 1.0)
    return c


def fit(
    labelled: DataFrame, *, sample_docs: int = 1200, centroids: int = 4, rounds: int = 8, slack: float = 0.4, least_letters: int = 20, seed: int = 7
) -> Centroids:
    """Fit on a sample of about ``sample_docs`` whole texts per language.

    The sample is chosen by a hash of the document, the same on every run. Its
    vectors are the only thing that reaches the driver, 96 kB each at most however
    long a text is; their number does not grow with the corpus. A document is rejected when its cosine is below ``slack`` times the
    first percentile of sample documents with about as many letters; with fewer
    than ``least_letters`` there is too little to tell, and it is accepted."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20))
    limit = F.lit(-1)
    for name, n in per.items():
        limit = F.when(F.col("lang") == name, min(1 << 20, max(1, (sample_docs << 20) // n))).otherwise(limit)
    sample = rows.where(draw < limit).select("lang", F.col("doc_id").cast("string").alias("id"), F.xxhash64("text").alias("h"), "text")

    def vectors(batches):
        import pyarrow as pa

        for b in batches:
            at, roots, letters = [], [], []
            for t in as_bytes(b.column("text")):
                count, n = grams(t.decode("utf-8", "replace"))
                at.append(np.flatnonzero(count))
                roots.append(np.sqrt(count[at[-1]]).astype(np.float32).tobytes())
                letters.append(n)
            cols = [pa.array([x.astype(np.uint16).tobytes() for x in at], pa.binary()), pa.array(roots, pa.binary()), pa.array(letters, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], ["lang", "id", "h", "at", "roots", "n"])

    found = sample.mapInArrow(lean(vectors), "lang string, id string, h long, at binary, roots binary, n long").where("n > 0").collect() if per else []
    by: dict[str, list] = {}  # of each language: places and square roots of the counts, and letters
    seen = np.zeros(DIMS, np.int64)
    for r in sorted(found, key=lambda r: (r["lang"], r["id"] or "", r["h"])):
        at = np.frombuffer(r["at"], np.uint16)
        seen[at] += 1
        by.setdefault(r["lang"], []).append((at, np.frombuffer(r["roots"], np.float32), r["n"]))
    total = len(found)
    del found
    labels = sorted(by)
    if not labels:
        return Centroids([], np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros(21))
    idf = np.log((1 + total) / (1 + seen)).astype(np.float32) + np.float32(0.1)
    rng = np.random.default_rng(seed)
    found, owner, close = [], [], [[] for _ in range(21)]
    for k, name in enumerate(labels):
        x = np.zeros((len(by[name]), DIMS), np.float32)  # one language at a time is spread out
        for row, (at, v, _) in zip(x, by[name]):
            row[at] = v * idf[at]
            row /= max(float(np.sqrt(row @ row)), 1e-9)
        c = _kmeans(x, centroids, rounds, rng)
        found.append(c)
        owner += [k] * len(c)
        for cos, (_, _, n) in zip((x @ c.T).max(axis=1).tolist(), by[name]):
            close[_bin(n)].append(cos)
    floor = np.zeros(21)
    for b in range(21):  # few documents of a length: those of all shorter ones count too
        near = close[b] if len(close[b]) >= 30 else [c for bin_ in close[: b + 1] for c in bin_]
        floor[b] = slack * float(np.quantile(near, 0.01)) if near else 0.0
    return Centroids(labels, idf, np.concatenate(found).astype(np.float32), np.array(owner), floor, least_letters)


def classify(docs: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, lang_pred, score, rejected, runner_up for every row, in one narrow
    pass. Only the text is looked at, whole, at some 30 bytes of memory a character.
    Null text and text without a letter is ``und``, score 0, rejected, as are all
    texts where nothing was learned; languages at equal distance go by name;
    repeated rows are classified each; an empty table gives no rows."""
    rows = docs.select("doc_id", "text")
    out = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean, runner_up string"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [model.predict(t and t.decode("utf-8", "replace")) for t in as_bytes(b.column("text"))]
            cols = list(zip(*got)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()),
                 pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.string())],
                ["doc_id", "lang_pred", "score", "rejected", "runner_up"],
            )

    return rows.mapInArrow(lean(run), out)


def keep_accepted(docs: DataFrame, model: Centroids) -> DataFrame:
    """docs without the documents that the classifier rejects: those far from all
    languages, and those with null text or without a letter. All columns stay;
    repeated rows stay or go together; an empty table stays empty."""
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = as_bytes(b.column(names.index("text")))
            keep = [not model.predict(t and t.decode("utf-8", "replace"))[2] for t in texts]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
