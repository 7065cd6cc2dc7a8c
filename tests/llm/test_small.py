"""Operators against brute force on small tables with awkward rows."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import backoff_lm, jaccard_join, langid, merkle, mixing, packing, quality_lines, secrets, suffix_arrays, suffix_dedup, url_lists

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in that it was for on are with as his they be at one have this".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "er", "ing", "."]) for _ in range(n))


def corpus(seed=1):
    """Copies, near copies, shared passages, nulls, empties, ties, a long text."""
    r = random.Random(seed)
    texts = [prose(r, r.randrange(1, 120)) for _ in range(24)]
    passage = prose(r, 60)
    texts += [texts[0], texts[0], texts[3]]
    for t in texts[4:8]:
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [f"{prose(r, 10)}\n{passage}\n{prose(r, 10)}" for _ in range(4)]
    texts += ["", None, " \t\n", "one", "ONE", "a b c d", "é" * 300, "x" * 500, prose(r, 6000), "line one\nline two\nline one"]
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["s0", "s1", None]), len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[0])  # a repeated row
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Extra columns whose names the operators use themselves.
    return spark.createDataFrame(rows, SCHEMA).withColumns({"block": F.lit(1), "row": F.lit("x"), "_row": F.lit(2), "bucket": F.lit(0)}).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(t):
    w = (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_components(docs, none, rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    got = jaccard_join.join_components(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), root(i)) for i, s in sets.items()}
    assert jaccard_join.join_components(none).count() == 0
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, s in sets.items() if root(i) == i or not s)


def test_one_of_each_with_odd_rows(spark):
    a, b = prose(random.Random(1), 40), prose(random.Random(2), 40)
    rows = [(None, a, 1), (None, a, 2), (None, a + " more", 3), (7, b, 4), (7, b, 4), (7, b + " more", 5), (9, "", 6), (9, "", 6), (9, None, 7), (None, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `text_hash` int").withColumn("a.b", F.lit(1))
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(r["text_hash"] for r in kept.collect())
    assert got[0] in (1, 2, 3) and got[1:] in ([4, 6, 6, 7, 8], [5, 6, 6, 7, 8])


def test_jaccard_links_do_not_depend_on_batches(spark):
    # Batches end by bytes: an extra column moves their ends, and so those of blocks.
    r = random.Random(11)
    texts = [prose(r, 40 + 7 * (i % 5)) for i in range(150)]
    texts += [f"{t} more" for t in texts[::3]]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2).sortWithinPartitions("doc_id").cache()
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "3000")
        got = {x.doc_id: x.component_id for x in jaccard_join.join_components(table).collect()}
    finally:
        spark.conf.set(name, before)
    assert got == {i: 3 * (i - 150) if i >= 150 else i for i in range(200)}


@pytest.mark.parametrize("seed", range(3))
def test_signatures_lose_no_similar_pair(seed):
    r = random.Random(seed)
    for _ in range(150):
        n = r.choice([1, 2, 3, 4, 7, 12, 40, 150])
        a = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
        lost = r.randrange(0, max(1, n // 4) + 1)
        b = np.unique(np.concatenate((a[lost:], np.array([r.getrandbits(64) for _ in range(r.randrange(0, max(1, n // 8) + 1))], np.uint64))))
        both = len(np.intersect1d(a, b))
        if not both or 100 * both < 75 * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        lows = jaccard_join.bands(75, 100, 1000)
        got = []
        for s in (a, b):
            own = max(i for i, low in enumerate(lows) if low <= len(s))
            got.append({int(x) for k in (own, own + 1) for x in jaccard_join.signatures(s, k, lows[k + 1] - 1, 75, 100)})
        assert got[0] & got[1]
        assert 175 * jaccard_join.flips(jaccard_join.sketch(a), jaccard_join.sketch(b)) <= 25 * (len(a) + len(b))


def test_suffix_arrays():
    r = np.random.default_rng(2)
    for k in range(300):
        t = r.integers(97, 97 + int(r.integers(1, 5)), int(r.integers(1, 60))).astype(np.uint8)
        t = np.tile(t[: 1 + len(t) // 4], 5) if k % 3 == 0 else t
        raw = t.tobytes()
        sa = suffix_arrays.suffix_array(t)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        lcp = suffix_arrays.common_prefixes(t, sa, np.zeros(len(t), bool), 1000)
        for x, y in zip(sa[1:].tolist(), sa[:-1].tolist()):
            n = 0
            while max(x, y) + n < len(raw) and raw[x + n] == raw[y + n]:
                n += 1
            assert lcp[x] == n


def test_cut_repeats(docs, none, rows):
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[k : k + 200] for _, b in raw for k in range(len(b) - 199))
    want = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.cut_repeats(docs).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert suffix_dedup.cut_repeats(none).count() == 0


def test_cut_repeats_in_long_texts(spark):
    r = random.Random(8)
    long = prose(r, 900)
    texts = [long, long[:700] + prose(r, 300) + long[1500:2900], prose(r, 700), prose(r, 60) + long[-450:], long[:199], "é" * 450, None]
    texts[2] += texts[2][100:500]
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    want = []
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (64, 333, 5000):
        got = suffix_dedup.cut_repeats(table, piece_bytes=size, with_text=True).collect()
        assert sorted((*r[:5], bytes(r[5])) for r in got) == want


@pytest.mark.parametrize("hot", [3, 2_000])
def test_cut_repeats_around_a_frequent_line(spark, hot):
    r = random.Random(5)
    line = "licensed under terms that every file of this tree repeats, as it was agreed upon: read them before use"
    texts = [f"{prose(r, 60)} {line} {prose(r, 60)}" for _ in range(40)]
    at = texts[0].index(line)
    texts += [f"{prose(r, 9)} {texts[0][at - 90 : at + 190]} {prose(r, 9)}", line, line + line, texts[7]]
    seen = Counter(b[k : k + 200] for b in (t.encode() for t in texts) for k in range(len(b) - 199))
    want = []
    for b in (t.encode() for t in texts):
        gone = {j for k in range(len(b) - 199) if seen[b[k : k + 200]] > 1 for j in range(k, k + 200)}
        want.append(hashlib.sha256(bytes(x for j, x in enumerate(b) if j not in gone)).hexdigest())
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()
    got = {x.doc_id: x.kept_sha256 for x in suffix_dedup.cut_repeats(table, hot=hot).collect()}
    assert got == dict(enumerate(want)) and want[40] != hashlib.sha256(texts[40].encode()).hexdigest()


def interpolated(lists, train, order, mu):
    """Score of every token list by the interpolated model, one n-gram at a time."""
    marked = [["<s>", *w] for w in train]
    count = Counter(tuple(w[max(0, i - m) : i + 1]) for w in marked for i in range(1, len(w)) for m in range(min(order, i + 1)))
    state = Counter()
    for g, c in count.items():
        state[g[:-1]] += c
    one = {g[0]: c for g, c in count.items() if len(g) == 1}
    n, v = sum(one.values()), len(one)
    n1, n2 = (sum(c == k for c in one.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.75

    def p(g):
        if len(g) == 1:
            return ((one[g[0]] - d) / n if g[0] in one else d * v / n) if n else 1.0
        return (count[g] + mu * p(g[1:])) / (state[g[:-1]] + mu)

    out = []
    for w in lists:
        w = ["<s>", *w]
        out.append(sum(np.log10(p(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(1, len(w))))
    return out, one, n, v


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff_scores(docs, none, rows, order):
    lists = [(t or "").encode().translate(backoff_lm._TO_LOWER).split() + [b""] for _, t, *_ in rows]
    train = [w for (i, *_), w in zip(rows, lists) if zlib.crc32(str(i).encode()) % 7 != 2]
    scores, one, n, v = interpolated(lists, train, order, 9.0)
    want = {i: (w, x) for (i, *_), w, x in zip(rows, lists, scores)}
    for r in backoff_lm.score(docs, "crc32(cast(doc_id as string)) % 7 <> 2", order=order, mu=9.0).collect():
        words, score = want[r.doc_id]
        base = sum(np.log10((one.get(x, 0) + 1) / (n + v + 1)) for x in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(x in one for x in words), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and abs(r.score - score) < 1e-6 * max(1, abs(score))
    assert backoff_lm.score(none, "true", order=order).count() == 0


def test_backoff_without_training_or_ids(spark):
    table = spark.createDataFrame([(None, "a b", 1), (None, None, 2), (3, "a", 3), (3, "a", 3)], "doc_id long, text string, block int")
    got = backoff_lm.score(table, "doc_id < 0", order=3).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.score) for r in got) == [("3", 2, 0, 0.0), ("3", 2, 0, 0.0), ("None", 1, 0, 0.0), ("None", 3, 0, 0.0)]
    assert not any(r.in_training for r in got)


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_sum_to_one(order):
    # One state's arcs, for every word that was seen and one that was not.
    train = b"a b a c a b b a c a b".split() + [b""]
    words = sorted(set(train)) + [b"unseen"]
    texts = [b" ".join(train[:-1])] + [b"a b " + w for w in words if w] + [b"a b"]
    grams = backoff_lm.Grams(texts, order)
    marked = ["<s>", *train]
    totals = []
    for m in range(order):
        seen = Counter(tuple(marked[i - m : i + 1]) for i in range(max(1, m), len(marked)))
        at = [["<s>", *backoff_lm.tokens(t)] for t in texts]
        totals.append(np.array([seen[tuple(w[i - m : i + 1])] if i >= m else 0 for w in at for i in range(1, len(w))]))
    one = Counter(train)
    made = backoff_lm.Automaton(grams, totals, len(train), len(one), 0.6, 7.0)
    after = lambda t: made.weight(grams.codes[grams.starts[t] : grams.starts[t] + grams.lengths[t]].tolist()[:3])
    before = made.weight(grams.codes[grams.starts[-1] :].tolist()[:2])
    total = sum(10 ** (after(t) - before) for t in range(1, len(texts)))
    assert abs(total - 1) < 1e-9


def test_blocks_do_not_depend_on_batches(spark):
    # The passes of a block operator see one cut, wherever Arrow batches end and partitions lie.
    r = random.Random(12)
    texts = [prose(r, r.randrange(1, 90)) for _ in range(120)]
    texts += [f"{prose(r, 5)} {texts[i]} {prose(r, 5)}" for i in range(0, 120, 6)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(n) for n in names]
    got = []
    try:
        for parts, size, n in ((1, before[0], before[1]), (3, "2500", "7"), (7, "900", "1000")):
            for name, v in zip(names, (size, n)):
                spark.conf.set(name, v)
            t = table.repartition(parts)
            cut = sorted(map(tuple, suffix_dedup.cut_repeats(t).collect()))
            scores = sorted((x.doc_id, x.n_known, round(x.score, 6)) for x in backoff_lm.score(t, "doc_id % 5 > 0").collect())
            got.append((cut, scores))
    finally:
        for name, v in zip(names, before):
            spark.conf.set(name, v)
    assert got[0] == got[1] == got[2] and any(x[2] for x in got[0][0])


def test_packing(docs, none, rows):
    from tidemark.llm.queries import tokenizer_path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows}
    got = packing.pack(docs, tokenizer_path(), max_tokens=64, with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert np.frombuffer(r.ids, np.uint32).tolist() == part and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, parts in by_doc.items():
        assert sum(n for _, n in sorted(parts)) == len(ids[i]) * Counter(x[0] for x in rows)[i]
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_packing_does_not_depend_on_partitions(spark):
    from tidemark.llm.queries import tokenizer_path

    r = random.Random(8)
    rows = [(i % 90 if i % 9 else None, "same text" if i % 3 else prose(r, 30)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(map(tuple, packing.pack(docs.repartition(n), tokenizer_path()).select("doc_id", "start", "length", "ids_crc32", "sequence_id", "offset").collect()), key=str) for n in (1, 5)]
    assert found[0] == found[1] and len(found[0]) == len(rows)


def test_plan_places_all_and_fills():
    r = random.Random(1)
    hist = Counter(min(2048, int(r.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    patterns = packing.plan(hist, 2048)
    placed = Counter()
    for p, c in patterns:
        assert sum(p) <= 2048
        for n in p:
            placed[n] += c
    assert placed == hist
    used = sum(n * c for n, c in hist.items())
    assert used / (2048 * sum(c for _, c in patterns)) > 0.99
    assert sum(c for _, c in packing.plan({100: 1000}, 2048)) == 50


def test_mixing(docs, none, rows):
    sized = mixing.sizes(docs)
    got = mixing.take(sized).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len((t or "").encode().split())
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), (5, 2, 1)))
    budget, target = 1.5 * sum(size.values()), {}
    free = set(size)
    while free:  # give by weight, fix what is over its cap, again
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in over} if over else {s: level * weight[s] for s in free}
        free = free - over if over else set()
    taken, largest = Counter(), max(r.size for r in got)
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and 0 <= r.times <= 2 and r.source_size == size[r.source]
        taken[r.source] += r.size * r.times
    assert sum(taken.values()) <= budget and all(abs(taken[s] - target[s]) <= largest for s in size)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.take(sized.repartition(5)).collect()), key=str)
    assert mixing.take(mixing.sizes(none)).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixing.mix(none).count() == 0
    times = Counter(r.doc_id for r in mixed.collect())
    want = Counter()
    for r in got:
        want[r.doc_id] += r.times if r.size else 1
    assert times == +want


def test_mix_keeps_texts_without_words(spark):
    r = random.Random(7)
    rows = [(i, r.choice([None, "", " \n"]) if i % 2 else prose(r, 20), r.choice(["a", "b", None])) for i in range(400)]
    got = Counter(x.doc_id for x in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert all(got[i] == 1 for i in range(1, 400, 2)) and sum(got[i] for i in range(0, 400, 2)) > 200


def test_mix_keeps_the_budget_with_repeated_rows(spark):
    rows = [(1, "a b c", "s", 0), (1, "a b c", "s", 0), (None, "a b c d", "t", 1), (None, None, None, 2), (None, None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `_mix_id` int").withColumns({"_mix_hash": F.lit(1), "times": F.lit("t"), "size": F.lit(0)})
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    assert sum(len((r.text or "").split()) for r in got) <= 15 and max(Counter(map(tuple, got)).values()) <= 4
    assert {r["_mix_id"] for r in got} == {0, 1, 2}


def test_running_sums_in_levels(spark, monkeypatch):
    from tidemark.llm import common

    monkeypatch.setattr(common, "RUN_ROWS", 3)
    rows = [(k, o, (7 * o + k) % 5) for k in range(2) for o in range(0, 100, 1 + k)]
    got = common.running_before(spark.createDataFrame(rows, "k int, o long, v long"), ["k"], "o", "v", 100).collect()
    assert {(r.k, r.o, r.before) for r in got} == {(k, o, sum(v for j, i, v in rows if j == k and i < o)) for k, o, _ in rows}
    got = common.running_before(spark.createDataFrame(rows[:100], "k int, o long, v long"), [], "o", "v", 100).collect()
    assert {(r.o, r.before) for r in got} == {(o, sum(v for _, i, v in rows[:100] if i < o)) for _, o, _ in rows[:100]}


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    tri = Counter(zip(w, w[1:], w[2:]))
    cover = {j for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(cover)


def test_frequent_lines_shuffled_or_broadcast(docs):
    few = dict(least_docs=1, host_share=0.0)
    a, b = (sorted(map(str, quality_lines.judge(docs, broadcast_rows=n, **few).collect())) for n in (0, 1000))
    assert a == b and any("n_removed_lines=1" in x for x in a)


def test_quality_lines(spark, docs, none, rows):
    for r in quality_lines.judge(docs).collect():
        t = {i: t for i, t, *_ in rows}[r.doc_id]
        want = brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert quality_lines.judge(none).count() == 0
    r = random.Random(4)
    line = prose(r, 60)
    many = [(i, f"{line}\n{prose(r, 30) if i % 2 else prose(r, 200)}", "en", "s", 0) for i in range(60)] + [(99, prose(r, 80), "en", "s", 0)]
    got = {x.doc_id: x for x in quality_lines.judge(spark.createDataFrame(many, SCHEMA)).collect()}
    assert not got[1].kept and got[1].depleted and got[2].kept and got[2].n_removed_lines == 1 and got[99].n_removed_lines == 0


def test_clean_removes_frequent_lines(spark):
    r = random.Random(4)
    line = prose(r, 60)
    many = [(i, f"{line}\n\n{prose(r, 30) if i % 2 else prose(r, 200)}", "en", None, 0) for i in range(60)] + [(99, prose(r, 80), "en", None, 0)]
    table = spark.createDataFrame(many, SCHEMA)
    want = {x.doc_id for x in quality_lines.judge(table).where("kept").collect()}
    got = {x.doc_id: x for x in quality_lines.clean(table).collect()}
    assert set(got) == want and 2 in want and 1 not in want
    for i, t, *_ in many:
        if i in want:
            assert got[i].text == t.removeprefix(line + "\n") and got[i].n_chars == len(got[i].text)


def test_secrets(spark, docs, none):
    import base64
    import gzip

    key = 'password = "hunter22x"'
    plain = f"x {key} y"
    b64 = base64.b64encode(key.encode()).decode()
    packed = base64.b64encode(gzip.compress(f"{key} and more of the same text".encode())).decode()
    url = "".join(f"%{c:02X}" for c in key.encode())
    uni = "".join(f"\\u{ord(c):04x}" for c in key)
    twice = base64.b64encode(f"again {b64} again".encode()).decode()
    assert secrets.joined(secrets.secrets(plain)[0]) == "assign:2:23"
    for enc in (b64, packed, twice):
        base, every, _ = secrets.secrets(f"é {enc} end")
        assert base == [] and secrets.joined(every) == f"assign:2:{2 + len(enc)}"
    for enc, width in ((url, 3), (uni, 6)):
        assert secrets.joined(secrets.secrets(f"é {enc} end")[1]) == f"assign:2:{2 + width * 21}"
    assert secrets.joined(secrets.secrets("toKen:abcdef AKIA" + "A" * 16 + " " + "0f" * 12)[0]) == "assign:0:12,access:13:33,hex:34:58"
    assert secrets.secrets("token = abc ſecret=abcdefgh ")[0] == []  # too short; letters there are ASCII
    assert secrets.secrets("%2525252541%25")[2] >= 3  # each layer once, to the end
    got = secrets.find_secrets(docs)
    assert got.count() == docs.count() and secrets.find_secrets(none).count() == 0
    one = secrets.redact(spark.createDataFrame([(1, plain, "en", "s", 9), (2, None, None, None, None)], SCHEMA)).orderBy("doc_id").collect()
    assert (one[0].text, one[0].n_chars, one[1].text) == ('x [assign]" y', 13, None)


def test_secrets_at_every_place(spark):
    import base64

    key = "password = hunter22x"
    b64 = base64.b64encode(key.encode()).decode()
    url = "".join(f"%{c:02X}" for c in key.encode())
    for enc in (b64, url):
        text = f"{enc}\n{enc}\nand {enc} end"
        base, every, layers = secrets.secrets(text)
        n = len(enc)
        assert base == [] and secrets.joined(every) == ",".join(f"assign:{s}:{s + n}" for s in (0, n + 1, 2 * n + 6)) and layers >= 3
        out = secrets.redact(spark.createDataFrame([(1, text, "en", "s", 9)], SCHEMA)).first().text
        assert out == "[assign]\n[assign]\nand [assign] end"
    outer = [base64.b64encode(f"{w} {b64}".encode()).decode() for w in ("first one", "other two")]
    assert [s for s, *_ in secrets.secrets(" ".join(outer))[1]] == [0, len(outer[0]) + 1]


def test_secrets_in_odd_layers(monkeypatch):
    import base64
    import gzip

    key = b"password = hunter22x"
    b64 = lambda raw: base64.b64encode(raw).decode()
    spans = lambda text: secrets.joined(secrets.secrets(text)[1])
    for raw in (
        b"x-" + key, gzip.compress(gzip.compress(key)), zlib.compress(gzip.compress(key)), gzip.compress(b"none, ") + gzip.compress(key),
        gzip.compress(b"none, " * 3_000_000 + key), gzip.compress(bytes(range(200, 256)) + b"\0" + key),
    ):
        assert spans(f"( {b64(raw)} )") == f"assign:2:{2 + len(b64(raw))}"
    assert spans(b64(b"token=abcdef")) == "assign:0:16"
    got = secrets.secrets(b64(b"\xff\x00\xfe" + key + b"\xff\x00"))[1]
    assert got and got[0][1] == 0
    wrapped = base64.encodebytes(b"a text, " * 20 + key).decode().strip()
    # A word on the next line may belong to the run, so it is looked at with and without.
    assert (5, 0, 5 + len(wrapped)) in secrets.secrets(f"word\n{wrapped}\nend of it")[1]
    assert [s for s, *_ in secrets.secrets(f"ab/{b64(key)}")[1]] == [3]
    monkeypatch.setattr(secrets, "PIECE_BYTES", 64)
    raw = gzip.compress(b"a, " * 500_000 + key + b", b" * 500_000)
    assert spans(b64(raw)) == f"assign:0:{len(b64(raw))}"


def naive_secrets(text):
    """Secret values anywhere in a text or below it, by trying every decoding of
    every run at every alignment, without spans."""
    import base64
    import gzip
    import html

    found, seen, work = set(), set(), [text]
    while work:
        t = work.pop()
        if t in seen:
            continue
        seen.add(t)
        for m in re.finditer(r"(?:password|token)[ =]+([A-Za-z0-9]{6,})", t):
            found.add(m.group(1))
        raw = re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), t)
        work += [raw, re.sub(r"\\u([0-9A-Fa-f]{4})", lambda m: chr(int(m[1], 16)), t), html.unescape(t)]
        for m in re.finditer(r"[A-Za-z0-9+/]{16,}", re.sub(r"(?<=[A-Za-z0-9+/])\n(?=[A-Za-z0-9+/])", "", t)):
            for k in range(4):
                run = m.group()[k:]
                data = base64.b64decode(run[: len(run) // 4 * 4] + (run[len(run) // 4 * 4 :] + "===")[:4] if len(run) % 4 > 1 else run[: len(run) // 4 * 4])
                for unpack in (lambda d: d, gzip.decompress, zlib.decompress):
                    try:
                        work.append(unpack(data).decode("ascii"))
                    except (OSError, EOFError, zlib.error, UnicodeDecodeError):
                        pass
    return found


@pytest.mark.parametrize("seed", range(12))
def test_secrets_in_random_nestings(spark, seed):
    import base64
    import gzip

    r = random.Random(seed)
    wrap = [
        lambda t: base64.b64encode(t.encode()).decode(), lambda t: base64.b64encode(gzip.compress(t.encode())).decode(),
        lambda t: base64.b64encode(zlib.compress(t.encode())).decode(), lambda t: "".join(f"%{c:02x}" for c in t.encode()),
        lambda t: "".join(f"\\u{ord(c):04x}" for c in t), lambda t: "".join(f"&#{ord(c)};" for c in t),
        lambda t: base64.encodebytes(t.encode()).decode().strip(),
    ]
    text, keys = [], set()
    for k in range(r.randrange(1, 4)):
        key = "".join(r.choice("abcdefghij0123456789") for _ in range(12))
        inner = f"token={key}"
        for _ in range(r.randrange(1, 4)):
            inner = r.choice(wrap)(f"{r.choice(['', 'see ', 'a b '])}{inner}")
        keys.add(key)
        text += [inner] * r.randrange(1, 3)
    whole = "\n\n".join(text)
    assert keys <= naive_secrets(whole)  # the brute force itself finds what was planted
    _, every, _ = secrets.secrets(whole)
    # Every copy is covered by a span, and nothing is left when the spans are cut out.
    at = 0
    for part in text:
        start = whole.index(part, at)
        at = start + len(part)
        assert any(s < at and e > start for s, _, e in every), part
    out = secrets.redact(spark.createDataFrame([(1, whole, "en", "s", 9)], SCHEMA)).first().text
    assert not naive_secrets(out) & keys


def test_pipeline(spark, docs, none, tmp_path):
    """Every stage against the plain reading of what it does to its input."""
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "secrets", "mix", "pack"]
    here = str(tmp_path)
    docs.write.parquet(f"{here}/documents.parquet")
    got = docs
    for name, stage in P.STAGES[:-1]:
        before, got = got, stage(spark, got, here)
        assert got.columns == docs.columns, name
        got.write.parquet(f"{here}/{name}")
        got = spark.read.parquet(f"{here}/{name}")
        old, new = before.collect(), got.collect()
        if name == "language":
            assert {r.doc_id for r in new} <= {r.doc_id for r in old} and not any(r.text is None or not any(c.isalpha() for c in r.text) for r in new)
        if name == "near_duplicates":
            sets = [shingles(r.text) for r in new]
            assert all(100 * len(a & b) < 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
            kept = [shingles(r.text) for r in new]
            near = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
            gone = [shingles(r.text) for r in old if r.doc_id not in {x.doc_id for x in new}]
            assert all(any(near(g, x) for x in [*kept, *(y for y in gone if y is not g)]) for g in gone)
        if name == "secrets":
            assert sorted(r.doc_id for r in new) == sorted(r.doc_id for r in old) and not any(secrets.secrets(r.text)[1] for r in new)
        if name == "mix":
            words = lambda rs: sum(len(r.text.encode().split()) for r in rs)
            assert words(new) <= 1.5 * words(old) and max(Counter(r.doc_id for r in new).values()) <= 2
    packed = P.STAGES[-1][1](spark, got, here)
    total = Counter(r.doc_id for r in got.collect())
    pieces = defaultdict(int)
    for r in packed.collect():
        pieces[r.doc_id] += r.length
        assert r.offset + r.length <= 2048
    assert {i: n for i, n in pieces.items()} == {r.doc_id: r.doc_tokens * total[r.doc_id] for r in packed.collect()}
    assert P.run(spark, here).count() == packed.count()
    none.write.parquet(f"{here}/none/documents.parquet")
    assert P.run(spark, f"{here}/none").count() == 0


def test_language_against_brute_force(spark):
    # Scores from plain dictionaries of n-grams, given the centroids.
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(WORDS[:9] if i % 2 else WORDS[9:]) for _ in range(30)), "a" if i % 2 else "b") for i in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), centroids=2)

    def brute(text):
        s = re.sub(r"[^a-zß-ÿ]+", " ", text.lower())
        v = Counter()
        for n, mix in zip((1, 2, 3), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
            for i in range(len(s) - n + 1):
                k = 0
                for c in s[i : i + n]:
                    k = k << 21 | ord(c)
                v[(k * mix & (1 << 64) - 1) >> 50] += 1
        w = {k: c**0.5 * float(model.idf[k]) for k, c in v.items()}
        norm = sum(x * x for x in w.values()) ** 0.5
        best = {}
        for row, o in zip(model.matrix, model.owner):
            cos = sum(x * float(row[k]) for k, x in w.items()) / norm
            best[model.labels[o]] = max(best.get(model.labels[o], -1), cos)
        return max(sorted(best), key=best.get), max(best.values())

    texts = [t for _, t, _ in rows[:20]] + ["The, THE of! and", "x", "of\n\nto  in", "straße für über"]
    got = langid.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for x in got:
        lang, score = brute(texts[x.doc_id])
        assert x.lang_pred == lang and abs(x.score - max(0.0, score)) < 1e-4


def test_language(spark, none):
    r = random.Random(9)
    vocab = {"en": WORDS, "de": "der und die das nicht ein ist zu von mit sich auf für über größe straße".split(), "fr": "le la les des été où être très avec pour dans une".split()}
    rows = [(i, " ".join(r.choice(vocab[k]) for _ in range(r.randrange(5, 80))), k) for i in range(240) for k in [("en", "de", "fr")[i % 3]]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table.where("doc_id < 180"))
    odd = spark.createDataFrame([(900, None, None), (901, "", None), (902, "123 !!", None), (903, "ξψωφ χκλμ ντζξ ψωφχ" * 9, None), (904, "😀 \U0001f4a9", None)], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.classify(table.union(odd), model).collect()}
    assert sum(got[i].lang_pred == k for i, _, k in rows if i >= 180) >= 59
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902, 904))
    assert got[903].rejected and got[903].lang_pred in vocab and 0 <= got[903].score <= 1
    assert langid.fit(none).labels == [] and langid.classify(none, model).count() == 0
    kept = langid.keep_accepted(table.union(odd), model)
    assert kept.columns == table.columns and {x.doc_id for x in kept.collect()}.isdisjoint({900, 901, 902, 903})
    assert kept.count() >= 238


def test_merkle(spark, docs, none, rows):
    table = [(i, t) for i, t, *_ in rows[:-1]]
    got = {r.doc_id: r for r in merkle.fingerprints(docs.dropDuplicates(["doc_id"])).collect()}
    for k, (i, t) in enumerate(table):
        t, after = t or "", table[(k + 1) % len(table)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (t == edited)
    assert got[0].fingerprint == got[24].fingerprint and got[1].fingerprint != got[2].fingerprint
    assert merkle.fingerprints(none).count() == 0
    assert merkle.fingerprints(spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")).first().near_next == 1.0


def test_url_lists(spark):
    from datetime import datetime, timedelta

    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    events = [
        ("bad.example.com", day(1), "add", "host"), ("bad.example.com", day(3), "remove", "host"), ("example.org", day(0), "add", "domain"),
        (None, day(0), "add", "host"), ("z", None, "add", "host"), ("bad.example.com", day(0), "add", "other"), ("bad.example.com", day(0), None, "host"),
        # Two rules on one key: each has intervals of its own.
        ("two.net", day(2), "add", "domain"), ("two.net", day(4), "add", "host"), ("two.net", day(5), "remove", "host"),
        ("two.net/a/b", day(7), "add", "path"), ("two.net/a/b", day(7), "remove", "path"), ("two.net/a", day(8), "add", "path"),
    ]
    cases = [
        ("http://bad.example.com/x", day(1), "host"), ("http://bad.example.com/x", day(3), None), ("https://u@WWW.Example.org:8080/", day(9), "domain"),
        ("nohost", day(9), None), (None, day(9), None), ("http://bad.example.com", None, None), ("http://bad.example.com", day(0), None),
        ("http://a.bad.example.com/x", day(1), None), ("http://notexample.org", day(9), None), ("http://two.net/a/b", day(3), "domain"),
        ("http://two.net/", day(4), "host"), ("http://two.net/", day(6), "domain"), ("http://www.two.net/", day(4), "domain"),
        ("http://two.net/a/b/c?x#y", day(7), "domain"), ("http://two.net/a/b/c?x#y", day(8), "path"), ("http://two.net/ab", day(8), "domain"),
        ("http://www.two.net/a", day(8), "domain"), ("http://two.net/a", day(1), None), ("http://bad.example.com/x", day(1), "host"),
    ]
    rows = [(i % 17, u, t, "k") for i, (u, t, _) in enumerate(cases)]
    table = spark.createDataFrame(rows, "page_id int, url string, fetched_at timestamp, `key` string")
    listed = url_lists.validity(spark.createDataFrame(events, "key string, at timestamp, action string, rule string"))
    got = sorted((r.page_id, str(r.url), str(r.fetched_at), str(r.rule)) for r in url_lists.filter_captures(table, listed).collect())
    assert got == sorted((i % 17, str(u), str(t), str(rule)) for i, (u, t, rule) in enumerate(cases))
    assert url_lists.filter_captures(table, listed.limit(0)).where("blocked").count() == 0
    assert url_lists.filter_captures(table.limit(0), listed).count() == 0


ORACLES = ["op2_line_frequency", "op3_url_lists", "op4_partenum", "op5_merkle", "op8_suffix", "op10_mix", "op11_manifest", "op12_prefix_trie"]
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_sql(spark, name):
    import duckdb
    from tidemark.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert got and got == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=str)
