"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing.

A document is cut into full windows from its start; what is left (under one window) is cut into
near-equal pieces of at most ``PIECE`` ids, so that windows can be evened out. The pieces of a few
hundred documents are packed together, each partition on its own and without a shuffle: every
piece starts as a partial partition with itself in one subset; the two partial partitions with the
widest imbalance are merged again and again, the largest subset of one with the smallest of the
other, until one partition into k near-equal windows is left. k is the least possible count, and
rises whenever a window exceeds the capacity. What a group of pieces wastes is thus a few ids a
window, and memory is bounded by the group.

Null and empty texts give one piece, their end id; a text of any length is packed whole; repeated
rows are packed each, also under one id; pieces of one size go by their order; no other columns are read, so
none can clash; an empty table gives no rows. A window's id has the partition and a count within it, so lost tasks that
run again give the same ids.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, filterfalse

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from chronofold.llm.arrow import chunks, map_batches

WINDOW = 2048
PIECE = 512
GROUP = 512
END_ID = 1
CACHE = 500_000
LONG = 64
DEFAULT = "word_bpe_49k.json"
#: The vocabulary's own words, as Python's engine matches them up to U+024F in lower-cased text.
PATTERN = r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+"
#: Where the engines differ or the library looks at more than single words.
ODD = "[^\x00-ɏ]|[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]|İ"


class WordIds:
    """Ids of texts as bytes (unsigned 32-bit, little-endian), from bounded tables of what white space delimits.

    No word of the vocabulary's pattern holds white space, so a text's ids are those of its delimited pieces.
    Missing words are encoded together, with spaces between them, by the library without its
    normaliser (they are lower case already); each word's last id is one that ends a word.
    """

    def __init__(self, name: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        path = public_tokenizers.path(name)
        self.library, self.plain, self.known, self.words = Tokenizer.from_file(path), Tokenizer.from_file(path), {}, {}
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.split, self.unlike, self.marks = re.compile(PATTERN).findall, re.compile(ODD).search, [*map(chr, range(0x1C, 0x20)), *special]

    def odd(self, text: str) -> bool:
        """Whether a text is for the library as a whole."""
        return any(m in text for m in self.marks) or not text.isascii() and bool(self.unlike(text))

    def learn(self, words: list[str]) -> None:
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        raw = ids.tobytes()
        if len(cuts) != len(words) + 1:
            raise ValueError("words and word ends differ")
        self.words.update((w, raw[a:b]) for w, a, b in zip(words, cuts, cuts[1:]))

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def add(self, pieces: set[str]) -> None:
        split = [self.split(p) for p in pieces]
        if missing := list(set(filterfalse(self.words.__contains__, chain.from_iterable(split)))):
            self.learn(missing)
        look = self.words.__getitem__
        self.known.update((p, b"".join(map(look, w))) for p, w in zip(pieces, split))

    def texts(self, texts: list[str]) -> list[bytes]:
        odd = [self.odd(t) for t in texts]
        pieces = [[] if o else t.lower().split() for t, o in zip(texts, odd)]
        missing = set(filterfalse(self.known.__contains__, chain.from_iterable(pieces)))
        if max(len(self.known) + len(missing), len(self.words)) > CACHE:
            self.known, self.words = {}, {}
            missing = set(chain.from_iterable(pieces))
        if missing:
            self.add(missing)
        look = self.known.__getitem__
        made = [self.whole(t) if o else b"".join(map(look, p)) for t, o, p in zip(texts, odd, pieces)]
        if long := [x for x in missing if len(x) > LONG]:  # so that the tables are bounded in bytes too
            for x in long:
                del self.known[x]
            for x in [x for x in self.words if len(x) > LONG]:
                del self.words[x]
        return made


_coders: dict[str, WordIds] = {}


def coder_of(name: str) -> WordIds:
    """One for all tasks of a worker process."""
    if name not in _coders:
        _coders[name] = WordIds(name)
    return _coders[name]


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` subsets with near-equal sums, by multiway differencing."""
    if k <= 1:
        return [list(range(len(sizes)))]
    # A partial partition: subsets (sum, members as nested pairs), largest first, empty ones left out.
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        one, two = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        shared = len(one) + len(two) - k
        if shared > 0:  # the smallest of each meet the largest of the other
            alone, small = one[: len(one) - shared], one[len(one) - shared :]
            other, meet = two[: len(two) - shared], two[len(two) - shared :]
            both = [(a[0] + b[0], (a[1], b[1])) for a, b in zip(small, reversed(meet))]
            if len(one) == k or len(two) == k:
                long, short = (one, two) if len(one) == k else (two, one)
                gap = k - len(short)
                both = [(a[0] + b[0], (a[1], b[1])) for a, b in zip(long[gap:], reversed(short))]
                alone, other = long[:gap], []
            merged = alone + other + both
        else:
            merged = one + two
        merged.sort(key=lambda x: -x[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        made += 1
        heapq.heappush(heap, (-spread, made, merged))
    out = []
    for _, members in heap[0][2]:
        found, stack = [], [members]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            else:
                found.append(x)
        out.append(sorted(found))
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``sizes`` by window; no window exceeds ``capacity``, and there are as few as differencing finds."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, k)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            return found
        k += 1


def pieces_of(length: int, capacity: int = WINDOW, piece: int = PIECE) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, length) of a document's full windows, and of the pieces of what is left."""
    full = [(at, capacity) for at in range(0, length - length % capacity, capacity)]
    rest, at = length % capacity, length - length % capacity
    n = -(-rest // piece)
    cuts = [at + rest * i // n for i in range(n + 1)] if n else []
    return full, [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def pack(docs: DataFrame, *, text: str = "text", key: str = "doc_id", tokenizer: str = DEFAULT, capacity: int = WINDOW) -> DataFrame:
    """One row per piece: its document, place there, checksum of its ids, window and place in it."""
    fields = (key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sequence = coder_of(tokenizer), (TaskContext.get().partitionId() << 33) - 1
        rows, waiting, held = [], [], 0
        kinds = None

        def emit() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=list(fields))
            rows.clear()
            return made

        def place() -> None:
            nonlocal sequence
            for window in windows([p[2] for p in waiting], capacity):
                sequence += 1
                offset = 0
                for i in window:
                    doc, start, length, crc, total = waiting[i]
                    rows.append((doc, start, length, crc, total, sequence, offset))
                    offset += length
            waiting.clear()

        for batch in (part for whole in batches for part in chunks(whole, text)):
            kinds = kinds or [batch.schema.field(key).type] + [pa.int64()] * 6
            for doc, ids in zip(batch.column(key).to_pylist(), coder.texts([t or "" for t in batch.column(text).to_pylist()])):
                view = memoryview(ids + end)
                total = len(view) // 4
                full, rest = pieces_of(total, capacity)
                for start, length in full:
                    sequence += 1
                    rows.append((doc, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), total, sequence, 0))
                waiting.extend((doc, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), total) for start, length in rest)
                held += bool(rest)
                if held >= GROUP:
                    place()
                    held = 0
            if len(rows) > 20_000:
                yield emit()
        if waiting:
            place()
        if rows:
            yield emit()

    return map_batches(docs.select(key, text), run, schema)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
