"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Characters are folded to ``SYMBOLS`` symbols (letters without accents or case, look-alike digits as
the letters they stand for, one for everything that separates words). An instance is a place in
the text; its features are the gappy subsequences of ``LENGTH`` symbols that start within
``STARTS`` places from it and span at most ``SPAN``, each weighted ``DECAY`` to the power of its
span. So an insult with a character put in or gaps between its letters still shares
subsequences with the plain one.

Training is on sentences' windows of labelled texts, as multiple instances: each toxic text is
stood for by its most toxic window (first by log-odds of its 5-symbol runs, then by the machine
itself), clean texts by drawn windows and, round after round, by those that the machine takes for
toxic. Kernel values against the landmarks, whitened by their own kernel matrix (Nystroem), go into
a linear machine with squared hinge loss. Since the kernel has explicit features, the fitted
machine is collapsed to one weight per subsequence: a table of SYMBOLS ** LENGTH numbers, which is
what is broadcast. A text's score is a logistic function, fitted on the training texts, of the
largest margin of its windows.

The machine is fitted on about ``SAMPLE`` toxic and ``CLEAN_SHARE * SAMPLE`` clean labelled texts of
at most ``SAMPLE_CHARS`` characters, chosen by a hash of the id (the documented bound); a third of
them is kept for the logistic function. Every text is scored whole, one
pass, no shuffle. Null and empty texts have no window and get the score of a margin of 0 evidence,
below 0.5; several labels of one id count as toxic if any is; ids without labels, null labels and
repeated rows are fine (of several texts under one id the least is learnt from); equal windows' ties go to the
first; without both labels in the sample every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from chronofold.llm.arrow import chunks, map_batches

SYMBOLS = 32
LENGTH = 4
SPAN = 7
STARTS = 5
DECAY = 0.5
LANDMARKS = 560
SAMPLE = 1500
SAMPLE_CHARS = 8_000
CLEAN_SHARE = 2
ROUNDS = 5
RUN = 5
PAD = SPAN + STARTS
#: Digits and signs that stand for letters.
LOOKS_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _fold_table(n: int = 0x250) -> np.ndarray:
    table = np.zeros(n + 1, np.uint8)
    for cp in range(n):
        c = LOOKS_LIKE.get(chr(cp), chr(cp))
        base = unicodedata.normalize("NFKD", c.lower())[:1]
        if "a" <= base <= "z":
            table[cp] = ord(base) - 96
        elif c.isalpha():
            table[cp] = 27
        elif c.isdigit():
            table[cp] = 28
    table[n] = 29  # other scripts and signs
    return table


FOLD = _fold_table()
#: Offsets of the symbols after the first, by subsequence shape.
SHAPES = [c for c in combinations(range(1, SPAN), LENGTH - 1)]


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, ``PAD`` separators around each, and where each text's symbols begin (one more: the end)."""
    gap = " " * PAD
    points = np.frombuffer((gap + gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = FOLD[np.minimum(points, len(FOLD) - 1)]
    begins = np.cumsum([PAD, *(len(t) + PAD for t in texts)])
    return symbols, begins


def codes(symbols: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """The code of the subsequence of that shape at each place."""
    n = len(symbols) - SPAN
    code = symbols[:n].astype(np.int32)
    for offset in shape:
        code = code * SYMBOLS + symbols[offset : offset + n]
    return code


def margins(symbols: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The machine's value, without its threshold, of the window at each place."""
    n = len(symbols) - SPAN
    at = np.zeros(n + 1, np.float32)
    wide = symbols.astype(np.int32)
    pairs = {d: wide[:n] * SYMBOLS + wide[d : d + n] for d in range(1, SPAN)}
    for a, b, c in SHAPES:
        tail = c - b
        at[1:] += weights[(pairs[a] << 10) | (wide[b : b + n] << 5) | wide[b + tail : b + tail + n]] * np.float32(DECAY ** (c + 1))
    sums = np.cumsum(at, dtype=np.float64)
    out = np.zeros(n)
    out[: n - STARTS + 1] = sums[STARTS:] - sums[: n - STARTS + 1]
    return out


def largest(values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest value of each text's places (from STARTS before it), and where it is."""
    lo, hi = begins[:-1] - STARTS, begins[1:] - PAD
    found, where = np.zeros(len(lo)), np.zeros(len(lo), np.int64)
    for i, (a, b) in enumerate(zip(lo.tolist(), np.maximum(hi, lo + 1).tolist())):
        where[i] = a + int(values[a:b].argmax())
        found[i] = values[where[i]]
    return found, where


def features(symbols: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights [place, subsequence] of the windows at ``places``."""
    starts = (places[:, None] + np.arange(STARTS)[None, :]).ravel()
    code, weight = [], []
    for shape in SHAPES:
        c = symbols[starts].astype(np.int64)
        for offset in shape:
            c = c * SYMBOLS + symbols[starts + offset]
        code.append(c.reshape(len(places), STARTS))
        weight.append(np.full((len(places), STARTS), DECAY ** (shape[-1] + 1)))
    return np.concatenate(code, 1), np.concatenate(weight, 1)


class Nystroem:
    """Whitened kernel values against landmark windows."""

    def __init__(self, code: np.ndarray, weight: np.ndarray):
        self.ids, inverse = np.unique(code, return_inverse=True)
        self.phi = np.zeros((len(self.ids) + 1, len(code)), np.float32)
        np.add.at(self.phi, (inverse.reshape(code.shape), np.arange(len(code))[:, None]), weight)
        gram = (self.phi.T @ self.phi).astype(np.float64)
        value, vector = np.linalg.eigh(gram)
        keep = value > 1e-6 * value[-1]
        self.whiten = (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)

    def __call__(self, code: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.zeros((len(code), self.whiten.shape[1]), np.float32)
        for lo in range(0, len(code), 512):
            c = code[lo : lo + 512]
            at = np.searchsorted(self.ids, c)
            at[at == len(self.ids)] = 0
            at = np.where(self.ids[at] == c, at, len(self.ids))
            w = weight[lo : lo + 512]
            plain = np.zeros((len(c), self.phi.shape[1]), np.float32)
            for k in range(c.shape[1]):
                plain += w[:, k : k + 1].astype(np.float32) * self.phi[at[:, k]]
            out[lo : lo + 512] = plain @ self.whiten
        return out

    def collapse(self, linear: np.ndarray) -> np.ndarray:
        """One weight per subsequence, equal to the machine over the landmarks."""
        weights = np.zeros(SYMBOLS**LENGTH, np.float32)
        weights[self.ids] = (self.phi[:-1] @ (self.whiten @ linear)).astype(np.float32)
        return weights


def svm(x: np.ndarray, y: np.ndarray, each: np.ndarray, penalty: float = 0.05, steps: int = 10) -> tuple[np.ndarray, float]:
    """A linear machine by Newton steps on the squared hinge loss; ``each`` weighs the rows."""
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    ridge = np.full(x1.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        gap = 1 - y * (x1 @ w)
        on = gap > 0
        weighed = x1[on] * each[on, None].astype(np.float32)
        new = np.linalg.solve((weighed.T @ x1[on]).astype(np.float64) + np.diag(ridge), (weighed.T @ y[on]).astype(np.float64))
        if np.abs(new - w).max() < 1e-3:
            break
        w = new
    return w[:-1], float(w[-1])


def _slices(begins: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` symbols, so that what is computed at once is bounded."""
    lo = 0
    while lo < len(begins) - 1:
        hi = max(lo + 1, int(np.searchsorted(begins, begins[lo] + most)) - 1)
        yield lo, min(hi, len(begins) - 1)
        lo = hi


def _part(symbols: np.ndarray, begins: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols and places of some texts, and how far their places are moved."""
    shift = int(begins[lo]) - PAD
    return symbols[shift : int(begins[hi])], begins[lo : hi + 1] - shift, shift


def _runs(symbols: np.ndarray) -> np.ndarray:
    n = len(symbols) - SPAN
    run = symbols[:n].astype(np.int32)
    for j in range(1, RUN):
        run = run * SYMBOLS + symbols[j : j + n]
    return run


def _first_windows(symbols: np.ndarray, begins: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The place in each text with the highest log-odds of its runs of ``RUN`` symbols."""
    seen = np.zeros((2, SYMBOLS**RUN), np.uint16)
    for lo, hi in _slices(begins):
        part, at, _ = _part(symbols, begins, lo, hi)
        run = _runs(part)
        for i in range(hi - lo):
            seen[int(toxic[lo + i]), np.unique(run[at[i] - STARTS : at[i + 1] - PAD])] += 1
    places = []
    for lo, hi in _slices(begins):
        part, at, shift = _part(symbols, begins, lo, hi)
        run = _runs(part)
        bad, good = seen[1, run].astype(float), seen[0, run].astype(float)
        odds = np.log((bad + 0.2) / (toxic.sum() + 1)) - np.log((good + 0.2) / ((1 - toxic).sum() + 1))
        sums = np.concatenate([[0], np.cumsum(np.where(bad >= 2, odds, 0.0))])
        summed = np.zeros(len(run))
        summed[: len(run) - STARTS + 1] = sums[STARTS:] - sums[: len(run) - STARTS + 1]
        places.append(largest(summed, at)[1] + shift)
    return np.concatenate(places)


def _largest_windows(symbols: np.ndarray, begins: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The place of each text's largest margin."""
    places = []
    for lo, hi in _slices(begins):
        part, at, shift = _part(symbols, begins, lo, hi)
        places.append(largest(margins(part, weights), at)[1] + shift)
    return np.concatenate(places)


class Machine:
    """The fitted machine: a weight per subsequence, the logistic function's slope and middle."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        aside = np.arange(len(texts)) % 3 == 2  # for the logistic function, which must not see what the machine has fitted
        if len(set(toxic[aside].tolist())) < 2 or len(set(toxic[~aside].tolist())) < 2:
            aside = np.zeros(len(texts), bool)
        self._fit([t for t, x in zip(texts, aside) if not x], toxic[~aside].astype(float))
        judged = np.flatnonzero(aside) if aside.any() else np.arange(len(texts))
        tops = [self.tops([texts[i] for i in judged[k : k + 300]]) for k in range(0, len(judged), 300)]
        self.slope, self.middle = self._logistic(np.concatenate(tops), toxic[judged].astype(float))

    def _fit(self, texts: list[str], toxic: np.ndarray) -> None:
        draw = np.random.default_rng(3)
        symbols, begins = fold(texts)
        clean = np.flatnonzero(toxic == 0)
        witness = _first_windows(symbols, begins, toxic)[toxic == 1]
        span = np.maximum(begins[1:] - PAD - begins[:-1], 1)
        plain = np.concatenate([begins[clean] - 1 + draw.integers(0, span[clean]) for _ in range(3)])
        hard = np.zeros(0, np.int64)
        for _ in range(ROUNDS):
            good = np.unique(np.concatenate([plain, hard]))
            a, b = (draw.permutation(p)[: LANDMARKS // 2] for p in (np.unique(witness), hard if len(hard) else good))
            kernel = Nystroem(*features(symbols, np.concatenate([a, b])))
            places = np.concatenate([witness, good])
            y = np.concatenate([np.ones(len(witness)), -np.ones(len(good))])
            each = np.where(y > 0, len(good) / max(len(witness), 1), 1.0)
            linear, self.threshold = svm(kernel(*features(symbols, places)), y, each)
            self.weights = kernel.collapse(linear)
            where = _largest_windows(symbols, begins, self.weights)
            witness = where[toxic == 1]
            hard = np.unique(np.concatenate([hard, where[clean]]))

    def tops(self, texts: list[str]) -> np.ndarray:
        """The largest margin of each text."""
        symbols, begins = fold(texts)
        return largest(margins(symbols, self.weights), begins)[0] + self.threshold

    @staticmethod
    def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Slope and middle by Newton steps."""
        each = np.full(len(y), 1 / len(y))
        design, w = np.stack([x, np.ones(len(x))], 1), np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            h = (design * (each * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + 1e-3 * np.eye(2) * 0.01
            step = np.linalg.solve(h, design.T @ (each * (y - p)) - 1e-5 * w)
            w = w + np.clip(step, -2, 2)
        return (float(w[0]), float(-w[1] / w[0])) if w[0] > 0 else (1.0, 0.0)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.tops(texts) - self.middle), -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, size: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """About ``size`` toxic and ``CLEAN_SHARE`` times as many clean texts; ``labels`` has (key, label)."""
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("label"))
    counts = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    drawn = F.pmod(F.xxhash64(F.col(key), F.lit("toxicity")), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("label") == 1, min(1.0, size / max(counts.get(1, 1), 1))).otherwise(min(1.0, CLEAN_SHARE * size / max(counts.get(0, 1), 1)))
    # about (1 + CLEAN_SHARE) * size ids and labels: bounded, so they may be broadcast
    chosen = F.broadcast(one.where(drawn < share).select(F.col(key).alias("__key"), "label"))
    texts = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.length("__text").between(1, SAMPLE_CHARS))
    # one text for each id, so that repeated ids do not exceed the bound
    rows = texts.join(chosen, "__key").groupBy("__key").agg(F.min("__text").alias("text"), F.max("label").alias("label")).collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    return [r[1] for r in rows], np.array([r[2] for r in rows], np.int64)


def score(docs: DataFrame, machine: Machine | None, *, key: str = "doc_id", text: str = "text", name: str = "toxicity_score") -> DataFrame:
    """All columns of ``docs`` and the score; it stands in place of a column of its name."""
    fitted = docs.sparkSession.sparkContext.broadcast(machine)
    docs = docs.select(*(c for c in docs.columns if c.lower() != name.lower() or c == text))
    schema = StructType([*docs.schema, StructField(name, DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s in _scored(batches, text, fitted.value):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def reject(docs: DataFrame, machine: Machine | None, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose score is under ``least``, with the columns of ``docs``, whatever their names."""
    fitted = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s in _scored(batches, text, fitted.value):
            yield batch.filter(pa.array(s < least))

    return docs.mapInArrow(run, docs.schema)


def _scored(batches: Iterable[pa.RecordBatch], text: str, machine: Machine | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in (part for whole in batches for part in chunks(whole, text, 1 << 18)):
        texts = [t or "" for t in batch.column(text).to_pylist()]
        yield batch, machine.scores(texts) if machine else np.zeros(len(texts))


def learn(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine | None:
    texts, toxic = sample(docs, labels, key=key, text=text, label=label)
    return Machine(texts, toxic) if len(set(toxic.tolist())) == 2 else None


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the rows that may be learnt from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = score(docs, learn(docs, training_labels(spark, sf_dir)))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return found.select("doc_id", held.alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))
