"""Benchmark decontamination by winnowing.

Every window of ``SPAN`` (13) consecutive words of a text is stood for by the least of its ten
4-gram hashes. Two equal windows have equal least hashes, so joining the fingerprints (the least
hashes, each kept once while the window slides over it) of benchmark items and documents finds
every shared span of 13 words or more. Hits are extended to whole windows: a window of a document
whose fingerprint is known is looked up by two independent 64-bit hashes of all its 13 words.
An item with fewer words is one window of its own length, found in the same way.

Where the benchmark has at most ``INDEX_WINDOWS`` windows, they are made into sorted arrays once and
broadcast, and the documents are read once without a shuffle. A larger one is joined by shuffle:
documents give their fingerprints, once while each stays, those that meet a benchmark fingerprint
are extended to windows, and these are joined by whole hashes. Both ways return the same rows.

Words are runs of 0-9, letters and non-ASCII characters, A-Z lower-cased. Null and empty texts
have no words; items without words match nothing; items with a null id hit words but are not listed;
items that repeat an id are one; repeated rows are compared each; a text of any length is compared
whole; an empty table gives no rows; other columns are not read by ``flag`` and kept by ``clean``
(which adds a column named __row for a while).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.arrow import chunks, joined, map_batches
from chronofold.llm.hashing import Words, byte_values, grams, starts_of, table_of
from chronofold.llm.scratch import Scratch

SPAN = 13
GRAM = 4
INDEX_WINDOWS = 1 << 20
#: The bytes of words.
WORD_BYTES = table_of("30-39 41-5a 61-7a 80-ff")
VALUES, OTHER = byte_values(10), byte_values(11)
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text: str | None) -> list[bytes]:
    """The words of one text, as lower-cased bytes."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return bytes(np.where(WORD_BYTES[raw], raw, 32).astype(np.uint8)).translate(LOWER).split()


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` consecutive values, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


class Index:
    """Windows of benchmark items, as sorted arrays made once: by length, two hashes of each window, the fingerprints,
    and each window's items."""

    def __init__(self, windows: pa.Table):
        """``windows``: distinct (item, n, least, whole, check), item as text."""
        n, least, whole, check = (windows.column(c).to_numpy().astype(np.int64) for c in ("n", "least", "whole", "check"))
        names = windows.column("item").combine_chunks().dictionary_encode()
        code = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.names = names.dictionary.to_pylist()
        self.least, self.whole, self.check, self.first, self.items = {}, {}, {}, {}, {}
        for k in np.unique(n).tolist():
            own = np.flatnonzero(n == k)
            own = own[np.argsort(whole[own].view(np.uint64), kind="stable")]
            hashes, first = np.unique(whole[own].view(np.uint64), return_index=True)
            self.least[k] = np.unique(least[own].view(np.uint64))
            self.whole[k], self.first[k], self.items[k] = hashes, np.append(first, len(own)), code[own]
            self.check[k] = check[own][first].view(np.uint64)
            if (np.repeat(self.check[k], np.diff(self.first[k])) != check[own].view(np.uint64)).any():
                raise RuntimeError("two windows share a hash")


def isin_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x if len(table) else np.zeros(len(x), bool)


def least_of(words: Words, n: int) -> np.ndarray:
    """The fingerprint of the window of ``n`` words at each word: the least hash of its GRAM-grams."""
    return sliding_least(grams(words.hashes, min(GRAM, n)), n - min(GRAM, n) + 1)


def candidates(words: Words, index: Index) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window length, the first words of the windows whose hashes the index has, and their places in it."""
    for n, known in index.whole.items():
        at = starts_of(words.first, n)
        if not len(at):
            continue
        least = least_of(words, n)[at]
        new = np.concatenate([[True], least[1:] != least[:-1]])  # a fingerprint is looked up once while it stays
        at = at[isin_sorted(least[new], index.least[n])[np.cumsum(new) - 1]]
        whole = grams(words.hashes, n)[at]
        found = isin_sorted(whole, known)
        yield n, at[found], np.searchsorted(known, whole[found])


def hits(texts: pa.Array, index: Index) -> tuple[Words, np.ndarray, dict[int, set], np.ndarray, np.ndarray]:
    """The words, which of them are hit, the items by text, where texts begin, and their bytes."""
    data, bounds = joined(texts)
    words = Words(data, bounds, WORD_BYTES, VALUES)
    hit, items = np.zeros(len(words.starts) + 1, np.int64), defaultdict(set)
    found = [(n, at, place, np.searchsorted(words.first, at, side="right") - 1) for n, at, place in candidates(words, index) if len(at)]
    # windows that agree in one hash are held against another, over the texts that have such
    docs = np.unique(np.concatenate([owner for *_, owner in found])) if found else np.zeros(0, np.int64)
    if len(docs):
        second = Words(*joined(texts.take(pa.array(docs))), WORD_BYTES, OTHER)
    for n, at, place, owner in found:
        there = np.searchsorted(docs, owner)
        same = grams(second.hashes, n)[at - words.first[owner] + second.first[there]] == index.check[n][place]
        at, place, owner = at[same], place[same], owner[same]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + n, -1)
        for doc, p in set(zip(owner.tolist(), place.tolist())):
            items[doc].update(index.items[n][index.first[n][p] : index.first[n][p + 1]].tolist())
    named = {doc: {index.names[i] for i in own if i >= 0} for doc, own in items.items()}
    return words, np.cumsum(hit[:-1]) > 0, named, bounds, data


def digest(items: Iterable) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in items)).encode()).hexdigest()


def small_index(theirs: DataFrame) -> Index | None:
    """The index where it has at most INDEX_WINDOWS windows (48 bytes each), else None; made once and then broadcast."""
    return Index(theirs.toArrow()) if theirs.count() <= INDEX_WINDOWS else None


def benchmark_windows(benchmark: DataFrame, text: str, item: str) -> DataFrame:
    """Distinct (item, n, least, whole, check) of the items' windows."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("item_text"))
    return _windows(rows, "item", "item_text").distinct()


FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _keys(docs: DataFrame, key: str) -> str:
    return f"`{key}` {docs.schema[key].dataType.simpleString()}"


def flag(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", share: int = 20) -> DataFrame:
    """For each document: its words, those hit, the items found, and whether at least one in ``share`` words is hit."""
    theirs = benchmark_windows(benchmark, text, item)
    made = small_index(theirs)
    if made is None:
        return _flag_by_shuffle(docs, theirs, key, text, share)
    index = docs.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in (part for whole in batches for part in chunks(whole, text)):
            words, hit, items, _, _ = hits(batch.column(text), known)
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[words.first[1:]] - total[words.first[:-1]]
            yield _rows(batch.column(key), key, words.counts(), n_hit, [items.get(i, ()) for i in range(batch.num_rows)], share)

    return map_batches(docs.select(key, text), run, f"{_keys(docs, key)}, {FIELDS}")


def _rows(keys: pa.Array, key: str, n_words: np.ndarray, n_hit: np.ndarray, items: list, share: int) -> pa.RecordBatch:
    columns = [keys, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([digest(x) for x in items]), pa.array((n_hit > 0) & (share * n_hit >= n_words))]
    return pa.RecordBatch.from_arrays(columns, names=[key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _windows(source: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, least, whole, check): windows of each text's own length, SPAN at most, with the winnowed fingerprint and
    two whole hashes by different byte values."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, text)):
            words, second = (Words(*joined(batch.column(text)), WORD_BYTES, v) for v in (VALUES, OTHER))
            counts = words.counts()
            for n in range(1, SPAN + 1):
                at = starts_of(words.first, n)
                owner = np.searchsorted(words.first, at, side="right") - 1
                own = np.minimum(counts[owner], SPAN) == n
                at, owner = at[own], owner[own]
                if len(at):
                    columns = (least_of(words, n)[at], grams(words.hashes, n)[at], grams(second.hashes, n)[at])
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(owner)), pa.array(np.full(len(at), n)), *(pa.array(x.view(np.int64)) for x in columns)], names=[key, "n", "least", "whole", "check"])

    return map_batches(source.select(key, text), run, f"{_keys(source, key)}, n long, least long, whole long, check long")


def _fingerprints(rows: DataFrame, text: str, lengths: list[int]) -> DataFrame:
    """(row, n, least, at, run): each text's fingerprints, once while they stay: for ``run`` windows from word ``at``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, text)):
            words = Words(*joined(batch.column(text)), WORD_BYTES, VALUES)
            for n in lengths:
                at = starts_of(words.first, n)
                if not len(at):
                    continue
                owner, least = np.searchsorted(words.first, at, side="right") - 1, least_of(words, n)[at]
                new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])]))
                stays = np.diff(np.append(new, len(at)))
                at, owner = at[new], owner[new]
                yield pa.RecordBatch.from_arrays([batch.column("__row").take(pa.array(owner)), pa.array(np.full(len(new), n)), pa.array(least[new].view(np.int64)), pa.array(at - words.first[owner]), pa.array(stays)], names=["__row", "n", "least", "at", "run"])

    return map_batches(rows.select("__row", text), run, "__row long, n long, least long, at long, run long")


def _extended(rows: DataFrame, text: str) -> DataFrame:
    """(row, n, whole, check, at): the hashes of the windows in each row's runs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, text)):
            words, second = (Words(*joined(batch.column(text)), WORD_BYTES, v) for v in (VALUES, OTHER))
            places = defaultdict(list)
            for i, (first, runs) in enumerate(zip(words.first.tolist(), batch.column("__runs").to_pylist())):
                for r in runs:
                    at = np.arange(first + r["at"], first + r["at"] + r["run"])
                    places[r["n"]].append(np.stack([np.full(len(at), i), at]))
            for n, found in places.items():
                owner, at = np.concatenate(found, 1)
                yield pa.RecordBatch.from_arrays([batch.column("__row").take(pa.array(owner)), pa.array(np.full(len(at), n)), *(pa.array(grams(w.hashes, n)[at].view(np.int64)) for w in (words, second)), pa.array(at - words.first[owner])], names=["__row", "n", "whole", "check", "at"])

    return map_batches(rows.select("__row", text, "__runs"), run, "__row long, n long, whole long, check long, at long")


def _found_by_shuffle(rows: DataFrame, text: str, theirs: DataFrame) -> DataFrame | None:
    """(row, at, n, item) of ``rows``' windows that are among ``theirs``: fingerprints are joined, those that meet are
    extended to whole windows, and these are joined by two hashes. None where there are none of theirs."""
    lengths = sorted(r.n for r in theirs.select("n").distinct().collect())
    if not lengths:
        return None
    met = _fingerprints(rows, text, lengths).join(theirs.select("n", "least").distinct(), ["n", "least"], "left_semi")
    runs = met.groupBy("__row").agg(F.collect_list(F.struct("n", "at", "run")).alias("__runs"))
    return _extended(rows.join(runs, "__row"), text).join(theirs.select("item", "n", "whole", "check"), ["n", "whole", "check"])


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows with numbers of their own; written, since a number given anew may fall on another row."""
    return Scratch(docs.sparkSession).table(docs.withColumn("__row", F.monotonically_increasing_id()))


def _flag_by_shuffle(docs: DataFrame, theirs: DataFrame, key: str, text: str, share: int) -> DataFrame:
    """The way for benchmarks of any size."""
    rows = _numbered(docs.select(key, text))
    found = _found_by_shuffle(rows, text, theirs)
    out = rows.withColumn("n_words", _n_words(text))
    if found is None:
        out = out.withColumn("spans", F.lit(None).cast("array<struct<at:long,n:long>>")).withColumn("items", F.lit(None).cast("array<string>"))
    else:
        spans = found.groupBy("__row").agg(F.collect_set(F.struct("at", "n")).alias("spans"), F.collect_set("item").alias("items"))
        out = out.join(spans, "__row", "left")
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))))
    n_hit = F.when(F.col("spans").isNull(), F.lit(0)).otherwise(hit).cast("long")
    items = F.array_sort(F.coalesce(F.col("items"), F.array().cast("array<string>")))
    out = out.select(key, "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", share: int = 20) -> DataFrame:
    """Documents that are not contaminated, with single hits below that share cut out of the text.

    Rows are judged each by itself, also those with null or repeated keys; the columns of ``docs`` are kept as they are."""
    theirs = benchmark_windows(benchmark, text, item)
    made = small_index(theirs)
    if made is None:
        return _clean_by_shuffle(docs, theirs, text, share)
    index = docs.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in (part for whole in batches for part in chunks(whole, text)):
            words, hit, _, bounds, data = hits(batch.column(text), known)
            yield _cleaned(batch, text, words, hit, bounds, data, share)

    return docs.mapInArrow(run, docs.schema)


def _cleaned(batch: pa.RecordBatch, text: str, words: Words, hit: np.ndarray, bounds: np.ndarray, data: np.ndarray, share: int) -> pa.RecordBatch:
    """The rows of a batch that are not contaminated, without their hit words."""
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[words.first[1:]] - total[words.first[:-1]]
    bad = (n_hit > 0) & (share * n_hit >= words.counts())
    if n_hit.any():
        texts = batch.column(text).to_pylist()
        for i in np.flatnonzero((n_hit > 0) & ~bad).tolist():
            texts[i] = without(data, int(bounds[i]), int(bounds[i + 1]) - 1, words, hit, int(words.first[i]), int(words.first[i + 1]))
        place = batch.schema.get_field_index(text)
        batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
    return batch.filter(pa.array(~bad))


def without(data: np.ndarray, begin: int, end: int, words: Words, hit: np.ndarray, lo: int, hi: int) -> str:
    """A text without its hit words and what stands between two of them."""
    keep, at = [], begin
    i = lo
    while i < hi:
        if hit[i]:
            j = i
            while j + 1 < hi and hit[j + 1]:
                j += 1
            keep.append(data[at : words.starts[i]])
            at = words.ends[j]
            i = j
        i += 1
    return np.concatenate([*keep, data[at:end]]).tobytes().decode()


def _clean_by_shuffle(docs: DataFrame, theirs: DataFrame, text: str, share: int) -> DataFrame:
    """The same rows for benchmarks of any size: the hit spans of each row are joined to it by its own number."""
    rows = _numbered(docs)
    found = _found_by_shuffle(rows, text, theirs)
    if found is None:
        return rows.select(*docs.columns)
    columns = docs.columns  # the function below must not hold the DataFrame
    spans = found.groupBy("__row").agg(F.collect_set(F.struct("at", "n")).alias("__spans"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, text)):
            data, bounds = joined(batch.column(text))
            words = Words(data, bounds, WORD_BYTES, VALUES)
            hit = np.zeros(len(words.starts) + 1, np.int64)
            for first, places in zip(words.first.tolist(), batch.column("__spans").to_pylist()):
                for span in places or ():
                    hit[first + span["at"]] += 1
                    hit[first + span["at"] + span["n"]] -= 1
            yield _cleaned(batch.select(columns), text, words, np.cumsum(hit[:-1]) > 0, bounds, data, share)

    return rows.join(spans, "__row", "left").select(*docs.columns, "__spans").mapInArrow(run, docs.schema)


def _n_words(text: str) -> F.Column:
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.size(F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))).cast("long")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
f AS (SELECT doc_id, item_id, dw.n, i FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM f) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
