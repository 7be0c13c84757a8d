"""Line deduplication by pairwise alignment.

A run is a line of at least ``MIN_WORDS`` words, or consecutive shorter lines that reach as many
together: from each line the shortest that begins there and the shortest that ends there, so each
line of a common block lies in a run within it. Runs are hashed, and the first (least id) document
that holds a run owns it. A later document is paired with the owner of each run it holds, so the
pairs are at most twice the lines, however many documents share one. Rare runs find their owners by a
shuffle join; those that hold more than a thousandth of all runs are at most a thousand, so their
owners are broadcast (the exact way for frequent runs). Each pair is aligned with patience diff
over all its lines: lines that both have once are anchors, the longest increasing run of anchors
is kept and grown over equal neighbours. Blocks of aligned lines that follow each other in both
documents and have ``MIN_WORDS`` words together are deleted from the later document; what is left is
aligned again, ``ROUNDS`` times at most, and at last looked up run by run, so moved and repeated blocks
go too, and texts in opposite orders take n log n steps.

Lines are compared without white space at their ends. Null and empty texts stay as they are; rows
with a null id are neither cut nor compared; rows that repeat an id count as one document and are
each cut; texts of any length are whole; ``cut`` keeps the columns of its input, and drops documents
whose lines are all deleted (copies) where asked to; of equal runs the least id's is kept; an empty table
gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.hashing import mix, powers
from chronofold.llm.scratch import Scratch, join_hot

MIN_WORDS = 10
ROUNDS = 4


def _lines(text: str) -> Column:
    return F.split(text, "\n")


def _words(line: Column) -> Column:
    return F.when(line == "", 0).otherwise(F.size(F.split(line, r"\s+")))


def _sequences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, lines, hashes, words) of each row's lines; ``lines`` find the pairs, and other ``hashes`` align them."""
    trimmed = F.transform(_lines(text), lambda x: F.btrim(x, F.lit(" \t\r")))
    found = docs.where(F.col(key).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("id"), trimmed.alias("lines"))
    return found.select(
        "id", F.transform("lines", lambda x: F.xxhash64(x)).alias("lines"), F.transform("lines", lambda x: F.xxhash64(x, F.lit("aligned"))).alias("hashes"), F.transform("lines", _words).alias("words")
    )


def runs_of(lines: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's runs, once a row; ``bounds`` are where the rows' lines begin (one more: the end)."""
    total = np.concatenate([[0], np.cumsum(words)])
    up, down = powers(len(lines) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lines.view(np.uint64) * up[:-1])])
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(words > 0)
    ends = np.searchsorted(total, total[at] + MIN_WORDS, side="left")
    begins = np.searchsorted(total, total[at + 1] - MIN_WORDS, side="right") - 1
    ahead, behind = ends <= bounds[row[at] + 1], begins >= bounds[row[at]]
    begin, end = np.concatenate([at[ahead], begins[behind]]), np.concatenate([ends[ahead], at[behind] + 1])
    hashes = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    rows = row[begin]
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def _runs(sequences: DataFrame) -> DataFrame:
    """(id, line) hashes of the runs to find partners by, once a row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, words = batch.column("lines"), batch.column("words")
            rows, hashes = runs_of(lines.flatten().to_numpy(zero_copy_only=False), words.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lines.value_lengths().to_numpy(zero_copy_only=False))]))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(hashes.view(np.int64))], names=["id", "line"])

    return sequences.select("id", "lines", "words").mapInArrow(run, f"id {sequences.schema['id'].dataType.simpleString()}, line long")


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first, whose second increases (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        p = bisect_left(tops, b)
        back.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[p], piles[p] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def aligned(first: list[int], later: list[int], once: bool = True, long: frozenset = frozenset()) -> list[tuple[int, int]]:
    """Aligned (place in first, place in later) of equal lines, by patience diff; None in later is skipped.

    Anchors are the lines that both have ``once``, or else the first places of the ``long`` ones that they share, or of all."""
    once_a, once_b = Counter(first), Counter(x for x in later if x is not None)
    where_b = {x: j for j, x in reversed(list(enumerate(later))) if x is not None}
    anchors = [(i, where_b[x]) for i, x in enumerate(first) if once_a[x] == 1 and once_b.get(x) == 1] if once else []
    if not once:
        seen: set[int] = set()
        use = (long & where_b.keys()) or where_b.keys()
        for i, x in enumerate(first):
            if x in use and x not in seen:
                seen.add(x)
                anchors.append((i, where_b[x]))
    out: list[tuple[int, int]] = []
    last_a = last_b = -1
    run = increasing(anchors)
    for k, (i, j) in enumerate(run):
        if i <= last_a or j <= last_b:
            continue
        stop_a, stop_b = run[k + 1] if k + 1 < len(run) else (len(first), len(later))
        a, b = i, j
        while a - 1 > last_a and b - 1 > last_b and first[a - 1] == later[b - 1]:
            a, b = a - 1, b - 1
        while a < stop_a and b < stop_b and first[a] == later[b]:
            out.append((a, b))
            a, b = a + 1, b + 1
        last_a, last_b = a - 1, b - 1
    return out


def common_blocks(first: list[int], later: list[int], words: list[int], least: int = MIN_WORDS) -> list[int]:
    """Places of ``later`` that lie in common blocks of at least ``least`` words."""
    shared = set(first)
    rest: list[int | None] = [x if x in shared else None for x in later]
    gone: list[int] = []
    once, long = True, frozenset(x for x, n in zip(later, words) if n >= least and x in shared)
    for _ in range(ROUNDS):
        found: list[int] = []
        block: list[tuple[int, int]] = []
        for pair in [*aligned(first, rest, once, long), None]:
            if block and (pair is None or pair[0] != block[-1][0] + 1 or pair[1] != block[-1][1] + 1):
                if sum(words[j] for _, j in block) >= least:
                    found += [j for _, j in block]
                block = []
            if pair:
                block.append(pair)
        if not found:
            if not once:
                break
            once = False  # no block at lines that both have once; others may be left
        gone += found
        for j in found:
            rest[j] = None
    return sorted(gone + left_blocks(first, rest, words, least))  # whatever is left, in linear time


def _shortest(lines: list[int | None], words: dict[int, int], least: int) -> Iterator[tuple[int, tuple]]:
    """(place, lines) of the shortest run of ``least`` words from each line with words; no run holds a line without an entry."""
    j, n = 0, 0
    for i, x in enumerate(lines):
        if j <= i:
            j, n = i, 0
        while j < len(lines) and n < least and lines[j] in words:
            n += words[lines[j]]
            j += 1
        if n >= least and words[x]:
            yield i, tuple(lines[i:j])
        n -= words.get(x, 0)


def left_blocks(first: list[int], later: list[int | None], words: list[int], least: int) -> list[int]:
    """Places of ``later`` in blocks of ``least`` words that ``first`` has anywhere; None in later is skipped."""
    known = {x: n for x, n in zip(later, words) if x is not None}
    if sum(n for x, n in zip(later, words) if x is not None) < least:
        return []
    where: dict[tuple, int] = {}
    for i, run in _shortest(first, known, least):
        where.setdefault(run, i)
    gone: list[int] = []
    for j, run in _shortest(later, known, least):
        i = where.get(run)
        if i is None or gone and j <= gone[-1]:
            continue
        while i < len(first) and j < len(later) and first[i] == later[j]:
            gone.append(j)
            i, j = i + 1, j + 1
    return gone


def pairs(sequences: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct (later, first) of documents that share a run, first being its owner."""
    lines = scratch.table(_runs(sequences))
    counted = lines.groupBy("line").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    owners = scratch.table(counted.where("first != last").select("line", "first", "n"))
    total = owners.agg(F.sum("n")).first()[0] or 0
    found = join_hot(lines, owners, "line", "n", total).where("id != first")
    return found.select(F.col("id").alias("later"), "first").distinct()


def deletions(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, gone): for each document with common blocks, the places and hashes of the lines to delete."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(key, text)
    sequences = scratch.table(_sequences(docs, key, text))
    found = pairs(sequences, scratch)
    both = found.join(sequences.select(F.col("id").alias("later"), F.col("hashes").alias("b"), F.col("words").alias("w")), "later")
    both = both.join(sequences.select(F.col("id").alias("first"), F.col("hashes").alias("a")), "first").select("later", "a", "b", "w")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, gone = [], []
            for later, a, b, w in zip(*(c.to_pylist() for c in batch.columns)):
                if places := common_blocks(a, b, w):
                    ids.append(later)
                    gone.append([{"at": j, "line": b[j]} for j in places])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("later").type), pa.array(gone, pa.list_(pa.struct([("at", pa.int32()), ("line", pa.int64())])))], names=["id", "gone"])

    kind = docs.schema[key].dataType.simpleString()
    made = both.mapInArrow(run, f"id {kind}, gone array<struct<at:int,line:bigint>>")
    return made.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def cut(docs: DataFrame, *, key: str = "doc_id", text: str = "text", counts: bool = False, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with common blocks deleted from the later documents; ``counts`` adds n_lines and n_deleted."""
    gone = deletions(docs, key=key, text=text).select(F.col("id").alias("__id"), F.col("gone").alias("__gone"))  # no clash with the input's columns
    rows = docs.join(gone, docs[key] == gone["__id"], "left")
    lines = F.transform(_lines(text), lambda x, i: F.struct(i.alias("at"), F.xxhash64(F.btrim(x, F.lit(" \t\r")), F.lit("aligned")).alias("line"), x.alias("x")))
    kept = F.filter(lines, lambda s: ~F.array_contains(F.col("__gone"), F.struct(s["at"].alias("at"), s["line"].alias("line"))))
    rows = rows.withColumn("__kept", F.when(F.col("__gone").isNotNull(), F.transform(kept, lambda s: s["x"])))
    blank = F.forall("__kept", lambda x: F.btrim(x) == "")
    if drop_emptied:
        rows = rows.where(F.col("__kept").isNull() | ~blank)
    new = F.when(F.col("__kept").isNull(), F.col(text)).when(blank, "").otherwise(F.array_join("__kept", "\n"))
    out = [new.alias(text) if c == text else F.col(c) for c in docs.columns]
    if counts:
        n = F.when(F.coalesce(F.col(text), F.lit("")) == "", 0).otherwise(F.size(_lines(text)))
        out += [n.cast("long").alias("n_lines"), F.when(F.col("__kept").isNull(), 0).otherwise(n - F.size("__kept")).cast("long").alias("n_deleted")]
    return rows.select(*out)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cut(docs, counts=True).select("doc_id", "n_lines", "n_deleted", "text")
