"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of order 0 to ``ORDER`` with the counts of its training
texts; contexts of order 3 seen fewer than ``KEPT`` times in every language are left to the shorter ones. Every text
starts after line feeds, so equal texts have equal code lengths wherever they stand. The statistics are frozen, so a byte's code length after a context is fixed: where the
context has seen the byte, its count over total plus distinct (escape method C); else the code
length of the escape, and then the shorter context's code for it, with the bytes that the longer
context has seen excluded; below order 0 all 256 bytes are equally likely. A text's code length is
the exact sum over its bytes; the shortest language wins, and the score is its share when code
lengths are taken as likelihoods per byte over ``SCORE_BYTES`` bytes at most.

The model is small and fixed in size: for each longest context that any language keeps, one row
with the code length of each byte class in each language. Scoring gathers rows with numpy; a batch
has no loop over bytes. Bytes of A-Z count as a-z; the ``CLASSES - 1`` most frequent bytes have
classes of their own, the others share one and cost their share of it.

The model is fitted on about ``SAMPLE`` whole texts of each language of at most ``SAMPLE_CHARS``
characters, chosen by a hash of the id (the documented bound of what is fitted). Texts that are null or hold no letter are `und`; a text of any length is
scored whole; ties go to the language that sorts first; repeated rows are scored each. Without any
training text every document is `und`. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.arrow import chunks, joined, map_batches

ORDER = 3
CLASSES = 128
SAMPLE = 400
SAMPLE_CHARS = 50_000
SCORE_BYTES = 64
_BITS = 7
KEPT = 3
START = b"\n" * ORDER
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


class Model:
    """Frozen code lengths: ``classes`` of bytes, ``row_of`` each context's row, ``cost`` [row, class, language]."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        data = {k: FOLD[np.frombuffer(START + START.join(v) + START, np.uint8)] for k, v in texts.items()}
        counts = sum((np.bincount(x, minlength=256) for x in data.values()), np.zeros(256, np.int64))
        frequent = np.argsort(-counts, kind="stable")[: CLASSES - 1]
        frequent = frequent[counts[frequent] > 0]
        self.classes = np.zeros(256, np.uint8)  # class 0: the bytes without one of their own
        self.classes[frequent] = np.arange(1, len(frequent) + 1)
        used = len(frequent) + 1
        shared = np.log2(max(1, 256 - len(frequent)))
        coded = {k: self.classes[x].astype(np.int64) for k, x in data.items()}
        seen = set()
        for x in coded.values():
            keys, n = np.unique(self.contexts(x)[ORDER:], return_counts=True)
            seen.update(keys[n >= KEPT].tolist())
        self.keys = np.array(sorted(seen), np.int64)
        self.row_of = np.zeros(1 << (_BITS * ORDER), np.int32)
        self.row_of[self.keys] = np.arange(1, len(self.keys) + 1)
        self.used = used
        languages = len(self.languages)
        self.cost = np.zeros((len(self.keys) + 1, used, languages), np.float32)
        self.short = np.zeros((used * used, used, languages), np.float32)
        for j, name in enumerate(self.languages):
            self._fill(coded[name], j, shared)
        self.cost[0] = self.short.mean(axis=0)

    def contexts(self, x: np.ndarray) -> np.ndarray:
        """The key of the ``ORDER`` classes before each position; before the first stand line feeds, as before each
        text of the training data."""
        feed = int(self.classes[10])
        key = np.zeros(len(x), np.int64)
        for j in range(1, ORDER + 1):
            key[j:] |= x[:-j] << (_BITS * (j - 1))
            key[:j] |= feed << (_BITS * (j - 1))
        return key

    def restart(self, key: np.ndarray, x: np.ndarray, begins: np.ndarray) -> None:
        """Makes the contexts at the beginning of each text those after line feeds, whatever text stands before it."""
        feed = int(self.classes[10])
        for place in range(ORDER):
            at = begins[begins + place < np.append(begins[1:], len(x))] + place
            here = np.zeros(len(at), np.int64)
            for j in range(1, ORDER + 1):
                here |= (x[at - j] if j <= place else feed) << (_BITS * (j - 1))
            key[at] = here

    def _fill(self, x: np.ndarray, j: int, shared: float) -> None:
        """Code lengths of language ``j`` from the counts of ``x``, from order 0 up."""
        u = self.used
        uniform = np.full((1, u), 1 / 256)
        uniform[0, 0] = (256 - u + 1) / 256
        p0 = self._blend(np.bincount(x, minlength=u).astype(float)[None, :], uniform)
        order1 = np.bincount(x[:-1] * u + x[1:], minlength=u * u).reshape(u, u).astype(float)
        p1 = self._blend(order1, np.repeat(p0, u, 0))
        order2 = np.bincount((x[:-2] * u + x[1:-1]) * u + x[2:], minlength=u**3).reshape(u * u, u).astype(float)
        p2 = self._blend(order2, np.tile(p1, (u, 1)))
        self.short[:, :, j] = -np.log2(p2)
        self.short[:, 0, j] += shared
        row = self.row_of[self.contexts(x)]
        order3 = np.bincount(row.astype(np.int64) * u + x, minlength=(len(self.keys) + 1) * u).reshape(-1, u).astype(float)[1:]
        near, far = self.keys & (CLASSES - 1), (self.keys >> _BITS) & (CLASSES - 1)
        self.cost[1:, :, j] = -np.log2(self._blend(order3, p2[far * u + near]))
        self.cost[1:, 0, j] += shared

    @staticmethod
    def _blend(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Probabilities after a context: method C, escapes to ``shorter`` with the seen ones excluded."""
        total, seen = counts.sum(1, keepdims=True), counts > 0
        distinct = seen.sum(1, keepdims=True)
        escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0)
        left = np.where(seen, 0.0, shorter).sum(1, keepdims=True)
        below = np.where(seen, 0.0, shorter) / np.maximum(left, 1e-12)
        return np.maximum(np.where(seen, counts / np.maximum(total + distinct, 1), escape * below), 1e-12)

    def code_lengths(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits of each text in each language; ``bounds`` are byte positions, a line feed ends each text."""
        x = self.classes[FOLD[data]].astype(np.int64)
        key = self.contexts(x)
        self.restart(key, x, bounds[:-1])
        row = self.row_of[key]
        flat = self.cost.reshape(-1, len(self.languages))
        bits = flat[row.astype(np.int64) * self.used + x]
        if len(miss := np.flatnonzero(row == 0)):
            far, near = (key[miss] >> _BITS) & (CLASSES - 1), key[miss] & (CLASSES - 1)
            bits[miss] = self.short[far * self.used + near, x[miss]]
        return np.add.reduceat(bits, bounds[:-1], axis=0, dtype=np.float64) if len(bounds) > 1 else np.zeros((0, len(self.languages)))


def crc_part(key: str, parts: int):
    return F.crc32(F.col(key).cast("string")) % parts


def sample_by_language(rows: DataFrame, *, key: str, lang: str, text: str, size: int = SAMPLE) -> dict[str, list[bytes]]:
    """About ``size`` texts of each language, by a hash of the key; only these come to the driver."""
    drawn = F.pmod(F.xxhash64(F.col(key), F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    own = rows.where(F.col(lang).isNotNull() & F.col(key).isNotNull()).select(F.col(lang).alias("__lang"), F.col(key).alias("__key"), drawn.alias("__drawn"), F.col(text).alias("__text"))
    counts = own.groupBy("__lang").agg(F.count("*").alias("__n"))
    # ids are drawn without their texts; about ``size`` of each language, which is a bound, so they may be broadcast
    drawn_ids = own.select("__lang", "__key", "__drawn").join(counts, "__lang").where(F.col("__drawn") * F.col("__n") < size).select("__lang", "__key").distinct()
    chosen = own.where(F.length("__text").between(1, SAMPLE_CHARS)).join(F.broadcast(drawn_ids), ["__lang", "__key"])
    found: dict[str, list[bytes]] = {}
    for r in chosen.groupBy("__lang", "__key").agg(F.min("__text").alias("text")).collect():  # one text for each id
        found.setdefault(r["__lang"], []).append(r["text"].encode())
    return {k: sorted(v) for k, v in found.items()}


def identify(docs: DataFrame, training: dict[str, list[bytes]], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of each row."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Model(training) if training else None)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double"
    latin = re.compile("[A-Za-z]").search

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen: Model | None = model.value
        for batch in (part for whole in batches for part in chunks(whole, text, 1 << 20)):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            letters = [bool(latin(t)) or any(map(str.isalpha, t)) for t in texts]
            if frozen is None:
                names, score = ["und"] * len(texts), np.zeros(len(texts))
            else:
                data, bounds = joined(batch.column(text))
                bits = frozen.code_lengths(data, bounds)
                size = np.diff(bounds)
                scaled = -(bits - bits.min(1, keepdims=True)) * (np.minimum(size, SCORE_BYTES) / size)[:, None]
                likely = 2.0**scaled
                best = bits.argmin(1)
                score = np.where(letters, 1.0 / likely.sum(1), 0.0)
                names = [frozen.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[key, "lang_pred", "score"])

    return map_batches(docs.select(key, text), run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    training = docs.where(F.col("lang").isNotNull() & (crc_part("doc_id", 4) != 2))
    found = identify(docs.select("doc_id", "text"), sample_by_language(training, key="doc_id", lang="lang", text="text"))
    return found.select("doc_id", (crc_part("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
