"""Remove passages that occur more than once, found in suffix arrays.

A passage is any string of ``least`` bytes that starts at two places. Every
window of that length has an anchor: the leftmost of its 64-byte strings with
the least hash. Equal windows have equal anchors, so anchors say which shard
can compare them, and an anchor that occurs once needs no comparison. The
context of an anchor is the text under all windows that it stands for.

1. Blocks of documents list their anchors with their contexts (hashes only);
   buckets find the anchors that occur more than once.
2. Blocks send the contexts of those to the anchor's shard, equal contexts
   folded into one with a count. A shard builds the suffix array of its
   contexts by induced sorting, takes permuted common prefixes, and windows
   that agree with another one over ``least`` bytes form its classes.
3. Shards answer each block in the order it asked; blocks cover the bytes of
   the windows found, and cut them out.

An anchor with more than ``hot`` contexts (a frequent line shorter than a window,
in ever different surroundings) would make a shard of any size. Its windows are
told apart by 128-bit hashes instead, counted in buckets of these hashes.

Blocks are folded first, so a passage that a third of all documents share is
sent once per block, and no step holds all occurrences of anything. Long texts are
cut into pieces that overlap by less than a window: the windows that start in a
piece are its own. Blocks are cut once and written as one row each, so all passes
see the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_FILES, BLOCK_ROWS, as_bytes, binaries, buckets_of, discard, lean, materialise, text_bytes
from .suffix_arrays import common_prefixes, suffix_array, words_at

ANCHOR_BYTES = 64
#: Bytes of text of a block, and of corpus for each shard. Anchors of a block take
#: some hundred bytes of memory per byte, as do suffix arrays.
BLOCK_BYTES = 2 << 20
SHARD_BYTES = 1 << 20
#: Different contexts (336 bytes at most) up to which a shard compares an anchor's windows.
HOT_CONTEXTS = 2_000
#: Bytes of a text whose windows are looked at together.
PIECE_BYTES = 1 << 20
_BREAK = 0xFF  # in no UTF-8 text


def anchors(texts: list, least: int):
    """(buffer, starts, lengths, anchor hash, first window, windows) of a block:
    runs of windows with the same anchor, as positions in the joined texts."""
    import numpy as np

    joined = b"".join(t or b"" for t in texts)
    lengths = np.array([len(t or b"") for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    n, width = len(joined), least - ANCHOR_BYTES + 1
    none = np.zeros(0, np.int64)
    if n < least:
        return joined, starts, lengths, none.astype(np.uint64), none, none
    with np.errstate(over="ignore"):
        h = words_at(np.frombuffer(joined, np.uint8))[: n - 7] * np.uint64(0x9E3779B97F4A7C15)
        size = 8
        while size < ANCHOR_BYTES:
            h = h ^ (h >> np.uint64(29))
            h = h[: len(h) - size] * np.uint64(0xBF58476D1CE4E5B9) + (h[size:] ^ np.uint64(size)) * np.uint64(0x94D049BB133111EB)
            size *= 2
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    bits = np.uint64(n.bit_length())
    m = h >> bits
    m <<= bits
    m |= np.arange(len(h), dtype=np.uint64)  # ties: the leftmost
    span = 1
    while 2 * span <= width:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    if span < width:
        rest = width - span
        m = np.minimum(m[: len(m) - rest], m[rest:])
    m &= (np.uint64(1) << bits) - np.uint64(1)
    owner = m.view(np.int64)
    windows = np.maximum(lengths - least + 1, 0)
    inside = np.zeros(len(owner) + 1, np.int64)
    has = windows > 0
    np.add.at(inside, starts[has], 1)
    np.add.at(inside, (starts + windows)[has], -1)
    valid = np.flatnonzero(np.cumsum(inside[:-1]))
    own = owner[valid]
    if not len(own):
        return joined, starts, lengths, none.astype(np.uint64), none, none
    head = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (valid[1:] != valid[:-1] + 1))))
    a = h[own[head]]  # least values of windows: small ones, to be spread over the buckets again
    with np.errstate(over="ignore"):
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            a = (a ^ (a >> np.uint64(shift))) * np.uint64(factor)
        a ^= a >> np.uint64(33)
    return joined, starts, lengths, a, valid[head], np.diff(np.append(head, len(own)))


def folded(texts: list, least: int):
    """Anchors of a block with equal contexts folded: anchor hash, context hash
    and count in (anchor, context) order, the first place of each, and for every
    anchor its entry; then what anchors() gave."""
    import numpy as np
    import xxhash

    got = anchors(texts, least)
    joined, _, _, a, low, n = got
    digest = xxhash.xxh3_64_intdigest
    c = np.fromiter((digest(joined[i:j]) for i, j in zip(low.tolist(), (low + n + least - 1).tolist())), np.uint64, len(low))
    order = np.lexsort((c, a))
    aa, cc = a[order], c[order]
    new = np.ones(len(order), bool)
    new[1:] = (aa[1:] != aa[:-1]) | (cc[1:] != cc[:-1])
    head = np.flatnonzero(new)
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    count = np.diff(np.append(head, len(order)))
    return aa[head], cc[head], count, order[head], entry, got


def windows_twice(contexts: list[bytes], counts, least: int):
    """For every context the windows (from 0) that occur at two places or more,
    counts saying at how many places a context stands."""
    import numpy as np

    sizes = np.array([len(c) for c in contexts], np.int64)
    t = np.frombuffer(bytes([_BREAK]).join(contexts), np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    which = np.repeat(np.arange(len(contexts)), sizes + 1)[: len(t)]
    window = np.arange(len(t)) - starts[which] <= (sizes - least)[which]
    must = np.zeros(len(t), bool)
    must[starts] = True
    sa = suffix_array(t)
    longest = int(sizes.max(initial=0)) + 8
    prefix = common_prefixes(t, sa, must, longest)
    ranked = sa[window[sa]]
    new = prefix[ranked] < least
    new[0] = True
    head = np.flatnonzero(new)
    total = np.add.reduceat(counts[which[ranked]], head)
    twice = np.zeros(len(t), bool)
    twice[ranked] = (total >= 2)[np.cumsum(new) - 1]
    return [twice[s : s + k - least + 1] for s, k in zip(starts.tolist(), sizes.tolist())]


def hot_windows(joined: bytes, low, n, least: int):
    """For runs of windows: their places, the distinct hashes in order (two words
    each) and for every place the number of its hash."""
    import numpy as np
    import xxhash

    at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    digest = xxhash.xxh3_128_digest
    raw = np.frombuffer(b"".join(digest(joined[i : i + least]) for i in at.tolist()), ">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((raw[:, 1], raw[:, 0]))
    ranked = raw[order]
    new = np.ones(len(at), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    which = np.empty(len(at), np.int64)
    which[order] = np.cumsum(new) - 1
    return at, ranked[new], which


def cut_repeats(docs: DataFrame, *, least: int = 200, with_text: bool = False, hot: int = HOT_CONTEXTS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256 (and kept, binary).

    Texts are UTF-8 bytes, null is empty; windows never cross documents; texts
    below ``least`` bytes lose nothing; repeated rows are places of their own,
    so copies lose all; an empty table gives no rows. A text longer than
    ``piece_bytes`` is worked on in pieces and put together at the end, at a few
    bytes of memory per byte."""
    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    size, _ = text_bytes(docs)
    n_buckets = max(16, size // SHARD_BYTES)

    def gather(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, serial, row = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            held: list[tuple] = []
            size = 0

            def block():
                at, rows, starts, totals, texts = zip(*held)  # noqa: B023
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                longs = [one(pa.array(x, pa.int64())) for x in (rows, starts, totals)]
                ids = one(b.column("doc_id").take(pa.array(at, pa.int64())))  # noqa: B023
                return pa.RecordBatch.from_arrays(
                    [pa.array([part << 32 | serial], pa.int64()), ids, *longs, one(pa.array(texts, pa.binary()))],  # noqa: B023
                    ["block", "doc_id", "row", "start", "total", "text"],
                )

            for i, text in enumerate(as_bytes(b.column("text"))):
                text = text or b""
                for start in range(0, max(len(text) - least + 1, 1), piece_bytes):
                    last = start + piece_bytes > len(text) - least
                    piece = text[start:] if last else text[start : start + piece_bytes + least - 1]
                    held.append((i, part << 40 | row, start, len(text), piece))
                    size += len(piece)
                    if size >= BLOCK_BYTES or len(held) >= BLOCK_ROWS:
                        yield block()
                        held, size, serial = [], 0, serial + 1
                row += 1
            if held:
                yield block()
                serial += 1

    blocks = materialise(
        rows.mapInArrow(lean(gather), f"block long, doc_id array<{id_type}>, row array<long>, start array<long>, total array<long>, text array<binary>"),
        "suffix-blocks", **BLOCK_FILES,
    )

    def ask(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for block, texts in zip(b.column("block").to_pylist(), b.column("text").to_pylist()):
                a, c, count, *_ = folded(texts, least)
                buckets, cuts = buckets_of(a, n_buckets)
                lists = (binaries(x, cuts) for x in (a, c, np.minimum(count, 2).astype(np.uint8)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(buckets), block, np.int64)), pa.array(buckets), *lists],
                    ["block", "bucket", "anchors", "contexts", "counts"],
                )

    def sort_out(table):
        """0: the anchor occurs once; 1: send the context; 2: another block sends it;
        3: the anchor is hot, send the hashes of its windows."""
        import numpy as np
        import pyarrow as pa

        a = [np.frombuffer(x, np.uint64) for x in table.column("anchors").to_pylist()]
        sizes = [len(x) for x in a]
        a = np.concatenate(a)
        c = np.frombuffer(b"".join(table.column("contexts").to_pylist()), np.uint64)
        m = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8).astype(np.int64)
        order = np.lexsort((c, a))
        aa, cc = a[order], c[order]
        new_a = np.concatenate(([True], aa[1:] != aa[:-1]))
        new_c = new_a | np.concatenate(([True], cc[1:] != cc[:-1]))
        heads, nth = np.flatnonzero(new_a), np.cumsum(new_a) - 1
        shared = np.add.reduceat(m[order], heads) >= 2
        many = np.add.reduceat(new_c.astype(np.int64), heads) > hot
        code = np.empty(len(a), np.uint8)
        code[order] = np.where(shared[nth], np.where(many[nth], 3, np.where(new_c, 1, 2)), 0)
        parts = [x.tobytes() for x in np.split(code, np.cumsum(sizes)[:-1])]
        return pa.table([table.column("block"), table.column("bucket"), pa.array(parts, pa.binary())], names=["block", "bucket", "codes"])

    codes = materialise(
        blocks.mapInArrow(lean(ask), "block long, bucket long, anchors binary, contexts binary, counts binary")
        .groupBy("bucket")
        .applyInArrow(sort_out, "block long, bucket long, codes binary"),
        "suffix-codes",
    )

    def in_order(texts, answers, column):
        """The block's folded anchors and what the buckets say of each."""
        import numpy as np

        got = folded(texts.column("text")[0].as_py(), least)
        parts = sorted((k, v) for k, v in zip(*(answers.column(x).to_pylist() for x in ("bucket", column))) if v is not None)
        return got, np.frombuffer(b"".join(v for _, v in parts), np.uint8)

    def send(texts, answers):
        import numpy as np
        import pyarrow as pa

        cols: list[list] = [[], [], [], [], [], []]
        if texts.num_rows:
            (a, c, count, at, entry, (joined, _, _, _, low, n)), code = in_order(texts, answers, "codes")
            block = texts.column("block")[0].as_py()
            much = np.flatnonzero(code[entry] == 3)
            if len(much):
                _, keys, which = hot_windows(joined, low[much], n[much], least)
                times = np.minimum(np.bincount(which, minlength=len(keys)), 2).astype(np.uint8)
                buckets, cuts = buckets_of(keys[:, 0], n_buckets)
                for k, x, y in zip(buckets.tolist(), cuts.tolist(), cuts[1:].tolist()):
                    for col, v in zip(cols, (block, n_buckets + k, keys[x:y].tobytes(), times[x:y].tobytes(), b"", b"")):
                        col.append(v)
            use = np.flatnonzero((code == 1) | (code == 2))
            first, last = low[at[use]], (low + n)[at[use]] + least - 1
            buckets, cuts = buckets_of(a[use], n_buckets)
            for k, x, y in zip(buckets.tolist(), cuts.tolist(), cuts[1:].tolist()):
                mine = use[x:y]
                sent = code[mine] == 1
                spans = list(zip(first[x:y][sent].tolist(), last[x:y][sent].tolist()))
                for col, v in zip(cols, (
                    block, k, c[mine].tobytes(), np.minimum(count[mine], 2).astype(np.uint8).tobytes() + sent.astype(np.uint8).tobytes(),
                    np.array([z - s for s, z in spans], np.uint32).tobytes(), b"".join(joined[s:z] for s, z in spans),
                )):
                    col.append(v)
        kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 4
        return pa.table([pa.array(v, k) for v, k in zip(cols, kinds)], names=["block", "bucket", "contexts", "flags", "sizes", "texts"])

    width = (least - ANCHOR_BYTES + 1 + 7) // 8

    def count_hot(table):
        import numpy as np
        import pyarrow as pa

        raw = table.column("contexts").to_pylist()
        keys = np.frombuffer(b"".join(raw), np.uint64).reshape(-1, 2)
        times = np.frombuffer(b"".join(table.column("flags").to_pylist()), np.uint8).astype(np.int64)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        ranked = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
        twice = np.empty(len(keys), np.uint8)
        twice[order] = (np.add.reduceat(times[order], np.flatnonzero(new)) >= 2)[np.cumsum(new) - 1]
        found = [x.tobytes() for x in np.split(twice, np.cumsum([len(x) // 16 for x in raw])[:-1])]
        return pa.table([table.column("block"), table.column("bucket"), pa.array(found, pa.binary())], names=["block", "bucket", "bits"])

    def compare(table):
        import numpy as np
        import pyarrow as pa

        if table.column("bucket")[0].as_py() >= n_buckets:
            return count_hot(table)
        c = [np.frombuffer(x, np.uint64) for x in table.column("contexts").to_pylist()]
        flags = [np.frombuffer(x, np.uint8).reshape(2, -1) for x in table.column("flags").to_pylist()]
        texts: list[bytes] = []
        for raw, sizes in zip(table.column("texts").to_pylist(), table.column("sizes").to_pylist()):
            ends = np.cumsum(np.frombuffer(sizes, np.uint32)).tolist()
            texts += [raw[x:y] for x, y in zip([0, *ends], ends)]
        sent = np.concatenate([x[f[1] == 1] for x, f in zip(c, flags)])
        keys, at = np.unique(sent, return_index=True)
        where = np.searchsorted(keys, np.concatenate(c))
        counts = np.bincount(where, weights=np.concatenate([f[0] for f in flags]), minlength=len(keys)).astype(np.int64)
        bits = np.zeros((len(keys), width), np.uint8)
        for k, twice in enumerate(windows_twice([texts[i] for i in at.tolist()], counts, least)):
            row = np.packbits(twice)
            bits[k, : len(row)] = row
        found = [bits[w].tobytes() for w in np.split(where, np.cumsum([len(x) for x in c])[:-1])]
        return pa.table([table.column("block"), table.column("bucket"), pa.array(found, pa.binary())], names=["block", "bucket", "bits"])

    answers = materialise(
        blocks.groupBy("block")
        .cogroup(codes.groupBy("block"))
        .applyInArrow(lambda texts, told: send(texts, told), "block long, bucket long, contexts binary, flags binary, sizes binary, texts binary")
        .groupBy("bucket")
        .applyInArrow(compare, "block long, bucket long, bits binary"),
        "suffix-answers",
    )
    def cut(texts, told):
        import numpy as np
        import pyarrow as pa

        rows: list[tuple] = []
        if texts.num_rows:
            (_, _, _, _, entry, (joined, starts, lengths, _, low, n)), code = in_order(texts, told, "codes")
            parts = sorted((k, v) for k, v in zip(told.column("bucket").to_pylist(), told.column("bits").to_pylist()) if v is not None)
            bits = np.frombuffer(b"".join(v for k, v in parts if k < n_buckets), np.uint8).reshape(-1, width)
            compared = (code == 1) | (code == 2)
            nth = np.cumsum(compared) - 1
            asked = np.flatnonzero(compared[entry])
            twice = np.unpackbits(bits[nth[entry[asked]]], axis=1)
            run, col = np.nonzero(twice)
            hit = low[asked][run] + col
            much = np.flatnonzero(code[entry] == 3)
            if len(much):
                at, _, which = hot_windows(joined, low[much], n[much], least)
                told_hot = np.frombuffer(b"".join(v for k, v in parts if k >= n_buckets), np.uint8)
                hit = np.concatenate((hit, at[told_hot[which] > 0]))
            edge = np.bincount(hit, minlength=len(joined) + 1) - np.bincount(hit + least, minlength=len(joined) + 1)
            gone = np.cumsum(edge[: len(joined)]) > 0
            ids = texts.column("doc_id")[0].as_py()
            of = zip(ids, *(texts.column(c)[0].as_py() for c in ("row", "start", "total")), starts.tolist(), lengths.tolist())
            for doc_id, row, start, total, s, m in of:
                text, mine = joined[s : s + m], gone[s : s + m]
                if m == total:
                    rows.append((doc_id, row, *without(text, mine), None, None, start))
                else:
                    rows.append((doc_id, row, total, None, None, None, None, text, np.packbits(mine).tobytes(), start))
        schema = to_arrow_schema(pieces_schema)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()

    def without(text: bytes, gone):
        """n_bytes, n_removed, n_spans, kept_sha256, kept of a whole text."""
        import hashlib

        import numpy as np

        removed = int(gone.sum())
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if removed else text
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if removed else 0
        return len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None

    def join_pieces(table):
        """A long text from its pieces: a byte is gone if it is in any of them."""
        import numpy as np
        import pyarrow as pa

        total = table.column("n_bytes")[0].as_py()
        text, gone = bytearray(total), np.zeros(total, bool)
        for start, piece, bits in zip(*(table.column(c).to_pylist() for c in ("start", "piece", "gone"))):
            text[start : start + len(piece)] = piece
            gone[start : start + len(piece)] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(piece)).astype(bool)
        schema = to_arrow_schema(out_schema)
        cols = [table.column("doc_id").combine_chunks()[:1], *([v] for v in without(bytes(text), gone)[: len(schema) - 1])]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    out_schema = _parse_datatype_string(out)
    pieces = f"doc_id {id_type}, row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, piece binary, gone binary, start long"
    pieces_schema = _parse_datatype_string(pieces)
    told = codes.select("block", "bucket", "codes", F.lit(None).cast("binary").alias("bits")).unionByName(
        answers.select("block", "bucket", F.lit(None).cast("binary").alias("codes"), "bits")
    )
    done = materialise(
        blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda texts, told: cut(texts, told), pieces_schema), "suffix-cut"
    )
    discard(blocks, codes, answers)
    return (
        done.where("piece is null").select(*out_schema.names)
        .unionByName(done.where("piece is not null").groupBy("row").applyInArrow(join_pieces, out_schema))
    )
