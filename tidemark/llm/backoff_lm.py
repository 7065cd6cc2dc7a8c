"""Language-model scoring by a weighted backoff automaton.

States are the contexts of up to ``order`` - 1 words that training texts have,
and the root. With h the words of a state, an arc goes out for every word w
that follows h in training, weighted with

    P(w | h) = (c(hw) + mu * P(w | h')) / (c(h) + mu),

to the state of the longest context that hw leaves. For all other words there
is one failure arc, weighted with mu / (c(h) + mu), to the state of h', which is
h without its first word. The root has an arc for every word: a known one has
(c(w) - D) / N, and all unknown words together have the mass D * V / N that
discounting freed. A text starts in the state of the start mark.

The automaton is as large as the corpus, so no task holds it. A block of
documents lists its own distinct n-grams; these are counted in hash buckets
over all blocks; each bucket answers each block with the counts of just the
n-grams that the block asked for, in the order asked. A block then builds the
part of the automaton that its texts can reach, and goes through each text once
from left to right, carrying the state and adding up the weights of the arcs.

Blocks are cut once and written as one row each, so all passes see the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_FILES, as_bytes, binaries, blocks_of, buckets_of, lean, materialise, text_bytes

#: Bytes of text whose n-grams are listed together, and of corpus for each bucket.
BLOCK_BYTES = 3 << 20
BUCKET_BYTES = 4 << 20
_UPPER = bytes(range(0x41, 0x5B))
_TO_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_NUL_SAFE = 0x9E3779B97F4A7C15


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words; the end mark is the empty word."""
    return [*(text.translate(_TO_LOWER).split() if text else ()), b""]


class Grams:
    """The n-grams of the texts of a block.

    hashes[m] holds for every token the hash of the m+1 tokens that end there; a
    start mark stands before a text's first token. valid[m] is False where that
    would reach beyond the start mark."""

    def __init__(self, texts: list, order: int):
        import numpy as np
        import xxhash

        words: dict[bytes, int] = {}
        lists = [tokens(t) for t in texts]
        self.lengths = np.array([len(x) for x in lists], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        n = int(self.lengths.sum())
        self.codes = np.fromiter((words.setdefault(w, len(words)) for x in lists for w in x), np.int64, n)
        self.n_words, self.end = len(words), words.get(b"", 0)
        one = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))[self.codes]
        self.hashes, self.valid = [one], [np.ones(n, bool)]
        for m in range(1, order):
            before = np.roll(self.hashes[-1], 1)
            before[self.starts] = np.uint64(m)  # start mark
            with np.errstate(over="ignore"):
                h = (before ^ (before >> np.uint64(29))) * np.uint64(_NUL_SAFE) + one
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            self.hashes.append(h ^ (h >> np.uint64(29)))
            valid = np.roll(self.valid[-1], 1) if m > 1 else np.ones(n, bool)
            if m > 1:
                valid[self.starts] = False
            self.valid.append(valid)

    def asked(self, trains):
        """Per n-gram length (from 0) the sorted distinct hashes and their counts
        in training texts."""
        import numpy as np

        for m, (h, ok) in enumerate(zip(self.hashes, self.valid)):
            h, at = np.unique(h[ok], return_inverse=True)
            yield m, h, np.bincount(at, weights=trains[ok], minlength=len(h)).astype(np.int64)


class Automaton:
    """The states and arcs that the texts of a block can reach."""

    def __init__(self, grams: Grams, totals: list, n_train: int, vocab: int, discount: float, mu: float):
        """totals[m]: training count of the m+1 tokens that end at each token (0
        where that is not valid)."""
        import numpy as np

        order, n = len(totals), len(grams.codes)
        is_first = np.zeros(n, bool)
        is_first[grams.starts] = True
        back_one = lambda x: np.concatenate((x[:1], x[:-1]))
        c1 = totals[0]
        n_texts = int(c1[grams.codes == grams.end].max(initial=0))
        # States: 0 is the root, 1 the start mark; then contexts by length.
        self.fail, self.back = [0, 0], [0.0, float(np.log10(mu / (n_texts + mu)))]
        ending = [np.zeros(n, np.int64)]  # state of the m tokens that end at a token
        for m in range(1, order):
            there = np.flatnonzero((totals[m - 1] > 0) & (grams.codes != grams.end))
            _, at, which = np.unique(grams.hashes[m - 1][there], return_index=True, return_inverse=True)
            state = np.zeros(n, np.int64)
            state[there] = len(self.fail) + which
            one = there[at]
            self.fail += ending[-1][one].tolist()
            self.back += np.log10(mu / (totals[m - 1][one] + mu)).tolist()
            ending.append(state)
        unknown = discount * vocab / n_train if n_train else 1.0
        p = np.where(c1 > 0, (c1 - discount) / max(n_train, 1), unknown)
        _, at = np.unique(grams.codes, return_index=True)
        longest = ending[1] if order > 1 else ending[0]
        self.root = list(zip(np.log10(p[at]).tolist(), longest[at].tolist()))
        self.arcs: dict[int, tuple] = {}
        for m in range(1, order):
            source = back_one(ending[m])
            context = back_one(totals[m - 1])
            source[is_first], context[is_first] = (1, n_texts) if m == 1 else (0, 0)
            p = (totals[m] + mu * p) / (context + mu)
            there = np.flatnonzero(totals[m] > 0)
            _, at = np.unique(grams.hashes[m][there], return_index=True)
            one = there[at]
            goes = ending[m + 1 if m + 1 < order else m][one]
            key = source[one] * grams.n_words + grams.codes[one]
            self.arcs.update(zip(key.tolist(), zip(np.log10(p[one]).tolist(), goes.tolist())))
        self.n_words, self.start = grams.n_words, int(order > 1)

    def weight(self, codes: list[int]) -> float:
        """Sum of the weights on the way of a text."""
        total, state = 0.0, self.start
        arcs, root, back, fail, n_words = self.arcs, self.root, self.back, self.fail, self.n_words
        for w in codes:
            while state:
                arc = arcs.get(state * n_words + w)
                if arc is not None:
                    break
                total += back[state]
                state = fail[state]
            else:
                arc = root[w]
            total += arc[0]
            state = arc[1]
        return total


def _pack(a) -> bytes:
    """Counts in the narrowest width that holds them; the width leads."""
    import numpy as np

    top = int(a.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 8
    return bytes([width]) + a.astype(f"<u{width}").tobytes()


def _unpack(raw: bytes):
    import numpy as np

    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _pack_lists(a, cuts):
    """_pack() of the lists between the cuts as an Arrow array, without a loop over them."""
    import numpy as np
    import pyarrow as pa

    n = np.diff(cuts)
    top = np.maximum.reduceat(a, cuts[:-1]) if len(a) else a
    width = np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 8))
    offsets = np.append(0, np.cumsum(1 + width * n))
    out = np.zeros(offsets[-1], np.uint8)
    out[offsets[:-1]] = width
    wide = np.repeat(width, n)
    at = np.repeat(offsets[:-1] + 1 - width * cuts[:-1], n) + wide * np.arange(len(a))
    for byte in range(int(wide.max(initial=0))):
        has = np.flatnonzero(wide > byte)
        out[at[has] + byte] = a[has] >> 8 * byte & 255
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def score(
    docs: DataFrame, train_on: str, *, order: int = 2, mu: float = 60.0, fallback_discount: float = 0.75
) -> DataFrame:
    """Score every document with a model of those for which the SQL condition
    ``train_on`` (over doc_id) holds.

    Null text is empty and has the end token alone; repeated rows count and are
    scored each; an empty table gives no rows; without training texts all words
    are unknown and weigh 1. A text is held whole by one task, at some hundred
    bytes a token. Columns: doc_id, in_training, n_tokens, n_known, train_tokens,
    base_score, score."""
    rows = docs.select("doc_id", "text", F.coalesce(F.expr(train_on), F.lit(False)).alias("in_training"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    size, _ = text_bytes(docs)
    n_buckets = max(16, size // BUCKET_BYTES)

    def gather(batches):
        import pyarrow as pa

        for block, b in blocks_of(batches, BLOCK_BYTES):
            lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(k)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists], ["block", "doc_id", "text", "in_training"])

    blocks = materialise(
        rows.mapInArrow(lean(gather), f"block long, doc_id array<{id_type}>, text array<string>, in_training array<boolean>"), "lm-blocks", **BLOCK_FILES
    )

    def ask(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for block, texts, flags in zip(b.column("block").to_pylist(), b.column("text"), b.column("in_training")):
                grams = Grams(as_bytes(texts.values), order)
                trains = np.repeat(np.array(flags.as_py(), float), grams.lengths)
                for kind, h, c in grams.asked(trains):
                    buckets, cuts = buckets_of(h, n_buckets)
                    n = len(buckets)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, block, np.int64)), pa.array(buckets), pa.array(np.full(n, kind, np.int32)),
                         binaries(h, cuts), _pack_lists(c, cuts)],
                        ["block", "bucket", "kind", "hashes", "counts"],
                    )

    def answer(table):
        import numpy as np
        import pyarrow as pa

        kinds = np.array(table.column("kind").to_pylist())
        blocks = table.column("block").to_pylist()
        bucket = table.column("bucket")[0].as_py()
        hashes, counts = table.column("hashes").to_pylist(), table.column("counts").to_pylist()
        out: list[list] = [[], [], [], []]
        stats = [0] * 4
        for kind in sorted(set(kinds.tolist())):
            mine = np.flatnonzero(kinds == kind).tolist()
            h = [np.frombuffer(hashes[i], np.uint64) for i in mine]
            distinct, at = np.unique(np.concatenate(h), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([_unpack(counts[i]) for i in mine]), minlength=len(distinct)).astype(np.int64)
            if kind == 0:
                stats = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())]
            for i, part in zip(mine, np.split(total[at], np.cumsum([len(x) for x in h])[:-1])):
                for col, v in zip(out, (blocks[i], kind, _pack(part), None)):
                    col.append(v)
        for col, v in zip(out, (-1, -1, b"", stats)):
            col.append(v)
        return pa.table(
            [pa.array(out[0], pa.int64()), pa.array([bucket] * len(out[0]), pa.int64()), pa.array(out[1], pa.int32()),
             pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int64()))],
            names=["block", "bucket", "kind", "totals", "stats"],
        )

    answers = materialise(
        blocks.mapInArrow(lean(ask), "block long, bucket long, kind int, hashes binary, counts binary")
        .groupBy("bucket")
        .applyInArrow(answer, "block long, bucket long, kind int, totals binary, stats array<long>"),
        "lm-answers",
    )
    s = answers.where("block = -1").agg(*[F.sum(F.col("stats")[k]) for k in range(4)]).first()
    n_train, vocab, n1, n2 = (int(x or 0) for x in s)
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else fallback_discount

    def walk(texts, answered):
        import numpy as np
        import pyarrow as pa

        if not texts.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(out_names, out_kinds)})
        ids, words, flags = (texts.column(c)[0].values for c in ("doc_id", "text", "in_training"))
        grams = Grams(as_bytes(words), order)
        parts: dict[int, list] = {}
        for kind, bucket, raw in zip(*(answered.column(c).to_pylist() for c in ("kind", "bucket", "totals"))):
            parts.setdefault(kind, []).append((bucket, raw))
        totals = []
        for m, (h, ok) in enumerate(zip(grams.hashes, grams.valid)):
            keys, at = np.unique(h[ok], return_inverse=True)
            got = [_unpack(raw) for _, raw in sorted(parts.get(m, []))]
            c = np.zeros(len(ok), np.int64)
            c[ok] = np.concatenate(got)[at] if got else 0
            totals.append(c)
        automaton = Automaton(grams, totals, n_train, vocab, discount, mu)
        c1 = totals[0]
        base = np.log10((c1 + 1) / (n_train + vocab + 1))
        ends = (grams.starts + grams.lengths).tolist()
        weights = [automaton.weight(grams.codes[a:z].tolist()) for a, z in zip(grams.starts.tolist(), ends)]
        cols = [
            ids, flags, pa.array(grams.lengths), pa.array(np.add.reduceat((c1 > 0).astype(np.int64), grams.starts)),
            pa.array(np.full(len(ids), n_train), pa.int64()), pa.array(np.add.reduceat(base, grams.starts), pa.float64()), pa.array(weights, pa.float64()),
        ]
        return pa.table(cols, names=out_names)

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    out_names = ["doc_id", "in_training", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    out_kinds = [to_arrow_type(rows.schema["doc_id"].dataType), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return (
        blocks.groupBy("block")
        .cogroup(answers.where("block >= 0").select("block", "bucket", "kind", "totals").groupBy("block"))
        .applyInArrow(
            lambda texts, answered: walk(texts, answered),
            f"doc_id {id_type}, in_training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )
