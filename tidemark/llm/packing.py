"""Pack documents into sequences by shortest-pack-first over the length histogram.

Documents longer than a sequence are cut into full pieces and a rest. Only the
histogram of piece lengths (at most ``max_tokens`` rows, whatever the corpus
size) reaches the driver, where lengths are placed longest first into the open
packing pattern with the fewest tokens. A pattern carries a count, so one step
places many pieces. Pieces then find their sequence by their rank among the
pieces of equal length, counted in levels so that one frequent length does not
land in one task.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, lean, materialise, running_before

BUCKET_ROWS = 2000
MARKS = ".,;:!?#$%&*|"
#: Words and marks whose ids a task remembers in each of two generations.
MEMO_WORDS = 150_000
#: Bytes of text whose words are looked up together.
PART_BYTES = 4 << 20
#: Words that one call of the tokenizer takes.
LEARN_WORDS = 10_000
_ENCODERS: dict[str, WordIds] = {}
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class WordIds:
    """Token ids (little-endian uint32 bytes) of ASCII-white-space separated words.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its words, one after the other. The words of many texts are
    told apart by one dictionary encoding; a word is encoded once."""

    def __init__(self, path: str):
        import os

        import numpy as np

        # Spark runs a task a core; threads of the tokenizer would each keep memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.np = np
        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        for piece, i in vocab.items():
            self.ends[i] = piece.endswith("</w>")
        self.folds = self.tok.encode("ABC", add_special_tokens=False).ids == self.tok.encode("abc", add_special_tokens=False).ids
        self.memo: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordIds:
        """The worker's encoder; it outlives a task, unlike what it remembers."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def forget(self) -> None:
        """Words of one task are few of another's; the memory is wanted elsewhere."""
        self.memo, self.older = {"": b""}, {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [self.np.array(e.ids, self.np.uint32).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, single: list[str], odd: list[str]) -> None:
        """Remember the ids of pieces. Single ones are one piece for the tokenizer
        too, so all of them are encoded as one text and told apart by their ends."""
        np, memo = self.np, self.memo
        for k in range(0, len(single), LEARN_WORDS):
            some = single[k : k + LEARN_WORDS]
            (whole,) = self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(whole.ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                raw, at = ids.tobytes(), 0
                for x, stop in zip(some, (4 * stops).tolist()):
                    memo[x] = raw[at:stop]
                    at = stop
            else:  # another tokenizer, without marked word ends
                memo.update(zip(some, self._encoded(some)))
        for k in range(0, len(odd), LEARN_WORDS):
            some = odd[k : k + LEARN_WORDS]
            memo.update(zip(some, self._encoded(some)))

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of each of several distinct words. Most are letters whose lower case
        is one letter again, and then marks; the tokenizer takes these as two pieces."""
        if len(self.memo) > MEMO_WORDS:  # what is still in use comes over from the older one
            self.older, self.memo = self.memo, {"": b""}
        memo, older, folds = self.memo, self.older, self.folds
        cores = [s.rstrip(MARKS) for s in words]
        plain = [not c or (c.isalpha() and (c.isascii() or max(c) < "İ")) for c in cores]
        heads = [(c.lower() if folds else c) if ok else s for s, c, ok in zip(words, cores, plain)]
        tails = [s[len(c) :] if ok else "" for s, c, ok in zip(words, cores, plain)]
        single, odd = [], []
        for x, ok in zip(heads, plain):
            if x not in memo:
                if x in older:
                    memo[x] = older[x]
                else:
                    memo[x] = b""
                    (single if ok else odd).append(x)
        for x in set(tails).difference(memo):
            memo[x] = b""
            single.append(x)
        self.learn(single, odd)
        return [memo[x] + memo[y] if y else memo[x] for x, y in zip(heads, tails)]

    def _flat(self, texts: list[bytes]) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        coded = lists.flatten().dictionary_encode()
        ids = self.ids_of(coded.dictionary.to_pylist())
        codes, ends = coded.indices, lists.offsets.to_pylist()
        return [b"".join(map(ids.__getitem__, codes[a:z].to_numpy().tolist())) for a, z in zip(ends, ends[1:])]

    def encode(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Ids of every text, in order. A long text is looked up in parts that end
        at white space."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            text = text or b""
            if held and size + len(text) > PART_BYTES:
                yield from self._flat(held)
                held, size = [], 0
            if len(text) <= PART_BYTES:
                held.append(text)
                size += len(text)
                continue
            done, at = [], 0
            while at < len(text):
                cut = _SPACE.search(text, at + PART_BYTES)
                end = cut.end() if cut else len(text)
                done += self._flat([text[at:end]])
                at = end
            yield b"".join(done)
        if held:
            yield from self._flat(held)


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids as binary) per piece."""
    rows = docs.select(F.col("doc_id"), F.col("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def cut(batches):
        import zlib
        from array import array

        import pyarrow as pa

        words = WordIds.of(tokenizer)
        end, step = end_id.to_bytes(4, "little"), 4 * max_tokens
        for b in batches:
            owner, start, length, crc, total, ids = array("q"), array("q"), array("q"), array("q"), array("q"), []
            for row, raw in enumerate(words.encode(as_bytes(b.column("text")))):
                raw += end
                for at in range(0, len(raw), step):
                    part = raw[at : at + step]
                    owner.append(row)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(raw) // 4)
                    if with_ids:
                        ids.append(part)
            cols = [b.column("doc_id").take(pa.array(owner, pa.int64()))]
            cols += [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)
        words.forget()

    return rows.mapInArrow(lean(cut), out)


def plan(histogram: dict[int, int], max_tokens: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (piece lengths in order) with their counts.

    Longest length first; each goes to the open pattern with the fewest tokens.
    Where none has room, new patterns open and take as many of the length as
    fit, which is what shortest-pack-first does one piece at a time."""
    open_by_space: dict[int, list[list]] = {}
    spaces: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], count: int, space: int) -> None:
        if space == 0:
            done.append((pattern, count))
            return
        if space not in open_by_space:
            open_by_space[space] = []
            bisect.insort(spaces, space)
        open_by_space[space].append([pattern, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if spaces and spaces[-1] >= length:
                space = spaces[-1]
                pattern, count = open_by_space[space].pop()
                if not open_by_space[space]:
                    del open_by_space[space]
                    spaces.pop()
                used = min(count, left)
                if count > used:
                    put(pattern, count - used, space)
                put((*pattern, length), used, space - length)
                left -= used
            else:
                each = min(left, max_tokens // length)
                packs = left // each
                put((length,) * each, packs, max_tokens - each * length)
                left -= packs * each
    return done + [(p, c) for at in open_by_space.values() for p, c in at]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset): ranks of a length from one
    row to the next go to consecutive sequences at that offset."""
    seen: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rank = seen.get(length, 0)
            rows.append((length, rank, sequence, offset))
            seen[length] = rank + count
            offset += length
        sequence += count
    return sorted(rows)


def pack(docs: DataFrame, tokenizer: str, *, max_tokens: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence_id and offset.

    Null or empty text is the end id alone. Repeated rows are packed each. Pieces of
    one length are placed in the order of a hash of doc_id, start and their ids, so
    another partitioning of docs gives the same rows. An empty table gives no rows."""
    table = materialise(
        pieces(docs, tokenizer, max_tokens, end_id, with_ids).withColumn("_row", F.monotonically_increasing_id()), "pack-pieces"
    )
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = slots(plan(histogram, max_tokens))
    buckets = max(16, sum(histogram.values()) // BUCKET_ROWS)
    table = table.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = table.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_before(counts, ["length"], "_bucket", "_n", buckets, "_before").drop("_n")
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens", "_row")
    ranked = (
        table.withColumn("_in", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_in"))
        .drop("_bucket", "_before", "_in", "_row")
    )
    kept = [c for c in ranked.columns if c != "_rank"]
    out = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in kept) + ", sequence_id long, offset long"

    def assign(batches):
        import numpy as np
        import pyarrow as pa

        grid = np.array(place or [(0, 0, 0, 0)], np.int64)
        key = grid[:, 0] << 48 | grid[:, 1]
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(key, length << 48 | rank, side="right") - 1
            cols = [b.column(c) for c in kept]
            cols += [pa.array(grid[at, 2] + rank - grid[at, 1]), pa.array(grid[at, 3])]
            yield pa.RecordBatch.from_arrays(cols, [*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(lean(assign), out)
