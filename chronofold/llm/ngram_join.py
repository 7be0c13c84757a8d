"""Near-duplicate documents by an exact Jaccard join on word shingles with token-combination prefixes.

Tokens are hashes of word shingles; two sets link when 100 * intersection >= percent * union (4 words and
85 unless said otherwise, and so in the examples here). Equal sets are one node. Tokens are ordered
rare first: those that hold more than 1 / 2**16 of all tokens are frequent and come last, the others
in order of their hash. A linked pair shares at least ceil(0.85 n) tokens, so among the first
p = n - ceil(0.85 n) + 1 of each there is a common one.

Prefixes are extended. A rare token is indexed by itself. Frequent tokens fall in ``CLASSES`` classes
and are indexed by pairs within a class; a prefix is extended by one token for each class it
touches, as long as needed for the guarantee (two prefixes that share no rare token and at most one
token of each class share too few tokens in all). Sets of under ``small(percent)`` tokens index frequent tokens
singly; those near that size are indexed both ways, since their partners may lie on either side.
A further extension (``extra``) prunes: a node whose extended prefix holds fewer tokens shared with
others than any partner needs is left out before pairs are made.

Pairs are verified on whole sets, after bounds by sketches. Connected groups need no pair twice: first
every node meets the centre that it shares most index entries with, then one centre of another
component, and at last all pairs across components of entries that still lie in several are compared:
those of small entries by a join, those of large ones in clusters, tile by tile, where only pairs that
may link become rows. So no link between components is lost and no group is expanded into all its pairs.

Null and empty texts have an empty set and link with nothing; fewer than 4 words are one shingle;
texts of any length are whole; repeated rows and copies share their node; only the id and text
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData
from pyspark.sql.window import Window

from chronofold.llm.arrow import chunks, joined, map_batches
from chronofold.llm.hashing import Words, byte_values, grams, mix, starts_of, table_of
from chronofold.llm.scratch import Scratch, join_hot

SHINGLE = 4
PERCENT = 85
FREQUENT_BITS = 16
CLASSES = 32
LEAST = 64
BLOOM_BITS = 23
SKETCH_BITS = 1024
SMALL_ENTRY = 64
TILE = 512
TILE_CODES = 1 << 20
#: Bytes of text hashed at once, which fit a core's cache.
CHUNK = 1 << 19
SEEN = 1 << 17
#: The bytes of words are all but ASCII white space.
WORD_BYTES = table_of("20-20 09-0d", invert=True)
U = np.uint64


def needed(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least intersection with any partner."""
    return -(-percent * n // 100)


def alone(percent: int) -> int:
    """Sets of fewer tokens link with no other: one token more or less is too many."""
    return -(-percent // (100 - percent))


def small(percent: int) -> int:
    """Sets of at least so many tokens have no partner of fewer than LEAST."""
    return -(-100 * LEAST // percent)


def extra(n: np.ndarray) -> np.ndarray:
    """Tokens that prefixes are extended by for pruning."""
    return 2 + n // 20


class Sets:
    """The shingle sets of some texts: sorted distinct tokens, each text's range, and node hashes."""

    def __init__(self, texts: pa.Array, seed: int, k: int = SHINGLE):
        words = Words(*joined(texts), WORD_BYTES, byte_values(seed))
        counts = words.counts()
        made = np.maximum(counts - k + 1, np.minimum(counts, 1))  # fewer words than k are one shingle
        ends = np.concatenate([[0], np.cumsum(made)])
        token = np.empty(ends[-1], U)
        short = np.flatnonzero((counts > 0) & (counts < k)).tolist()
        whole = np.ones(len(token), bool)
        whole[ends[short]] = False
        if whole.any():
            token[whole] = grams(words.hashes, k)[starts_of(words.first, k)]
        for d in short:
            token[ends[d]] = grams(words.hashes[words.first[d] : words.first[d + 1]], int(counts[d]))[0]
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
            token[lo:hi].sort()
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        new[ends[:-1][made > 0]] = True
        self.token = token[new]
        self.first = np.concatenate([[0], np.cumsum(new)])[ends]
        self.n = np.diff(self.first)
        sums = [np.concatenate([[U(0)], np.cumsum(mix(self.token ^ U(salt)))]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
        self.node, self.check = (mix(s[self.first[1:]] - s[self.first[:-1]] + self.n.astype(U)).view(np.int64) for s in sums)

    def ranges(self, rows: np.ndarray) -> np.ndarray:
        """Places of the tokens of some rows."""
        n = self.n[rows]
        return np.arange(int(n.sum())) + np.repeat(self.first[rows] - (np.cumsum(n) - n), n)


class Fresh:
    """Nodes that a task has met, so that copies count once; emptied at SEEN nodes, after which a copy may count again."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, node: np.ndarray) -> np.ndarray:
        """The first place of each node that is new."""
        if len(self.seen) > SEEN:
            self.seen.clear()
        found, at = np.unique(node, return_index=True)
        new = [i for x, i in zip(found.tolist(), at.tolist()) if x not in self.seen]
        self.seen.update(found.tolist())
        return np.array(sorted(new), np.int64)


def survey(docs: DataFrame, key: str, text: str, seed: int, shingle: int) -> DataFrame:
    """Kind 0: (key, node, check, set size) of each row; kind 1: (token, count in a part of the input) of tokens
    with a share there that may make them frequent."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        fresh = Fresh()

        def rows(kind: int, *columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *(pa.array(c, pa.int64()) for c in columns)], names=["kind", "id", "node", "check", "n"])

        def frequent() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            least = max(2, int(count.sum()) >> (FREQUENT_BITS + 2))
            held.clear()
            token, count = token[count >= least], count[count >= least]
            zero = np.zeros(len(token), np.int64)
            return rows(1, token.view(np.int64), zero, zero, count)

        for batch in (part for whole in batches for part in chunks(whole, text, CHUNK)):
            sets = Sets(batch.column(text), seed, shingle)
            yield rows(0, batch.column(key), sets.node, sets.check, sets.n)
            held.append(sets.token[sets.ranges(fresh(sets.node))])
            if sum(map(len, held)) > 2_000_000:
                yield frequent()
        if held:
            yield frequent()

    return map_batches(docs.select(F.col(key).cast("long").alias(key), text), run, "kind int, id long, node long, check long, n long")


def core(n: int, group: np.ndarray, percent: int = PERCENT) -> tuple[int, int]:
    """How many tokens of an ordered set are indexed singly whatever their class (for small sets), and how
    many belong to the prefix in which frequent ones are paired. ``group``: class of each token, -1 for rare."""
    p = n - int(needed(np.int64(n), percent)) + 1
    single = p if n < small(percent) else 0
    if n < LEAST:
        return single, 0
    length = p
    while length - len(set(group[:length].tolist()) - {-1}) < p:
        length += 1
    return single, length


def prefixes(docs: DataFrame, text: str, seed: int, frequent: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """(token, node, flags) of the extended prefixes; flags: 1 indexed singly, 2 paired within its class."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, least, fresh = known.value, alone(percent), Fresh()
        for batch in (part for whole in batches for part in chunks(whole, text, CHUNK)):
            sets = Sets(batch.column(text), seed, shingle)
            at = np.searchsorted(often, sets.token)
            at[at == len(often)] = 0
            common = often[at] == sets.token if len(often) else np.zeros(len(sets.token), bool)
            tokens, nodes, flags = [], [], []
            for d in fresh(sets.node).tolist():
                n = int(sets.n[d])
                if n < least:  # a partner of so small a set is equal to it
                    continue
                lo, hi = int(sets.first[d]), int(sets.first[d + 1])
                token, frequent_here = sets.token[lo:hi], common[lo:hi]
                p = n + 1 + (-percent * n // 100)
                if frequent_here.any():
                    token = np.concatenate([token[~frequent_here], token[frequent_here]])
                    rare = n - int(frequent_here.sum())
                    group = np.where(np.arange(n) < rare, -1, (token % U(CLASSES)).astype(np.int64))
                    single, paired = core(n, group, percent)
                else:
                    rare, single, paired = n, p if n < small(percent) else 0, p if n >= LEAST else 0
                size = min(n, max(p + 2 + n // 20, paired))
                flag = np.zeros(size, np.int8)
                flag[: max(single, min(paired, rare))] = 1
                flag[rare:paired] += 2
                tokens.append(token[:size])
                nodes.append(np.full(size, sets.node[d]))
                flags.append(flag)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(flags).astype(np.int8))], names=["token", "node", "flags"])

    return map_batches(docs.select(text), run, "token long, node long, flags byte")


def sketches(every: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit words of the sketches of some sets (tokens ``every``, cut at ``ends``), and where each begins (one more: the end).

    A sketch has a power of two of bits, SKETCH_BITS and twice the tokens at least, so a large set's is not full; a token's
    place is its last bits, so a longer sketch folds onto a shorter one."""
    n = np.diff(ends)
    width = np.array([max(SKETCH_BITS, 1 << (2 * k - 1).bit_length()) for k in n.tolist()], np.int64)
    first = np.concatenate([[0], np.cumsum(width)])
    seen = np.zeros(first[-1], bool)
    seen[np.repeat(first[:-1], n) + (every & np.repeat(width - 1, n))] = True
    return np.packbits(seen).view(np.int64), (first // 64).astype(np.int32)


def whole_sets(docs: DataFrame, text: str, seed: int, bloom: np.ndarray, shingle: int) -> DataFrame:
    """(node, tokens, bits, codes) of texts whose node may be in ``bloom``; a node comes about once a task. ``bits`` has a bit
    for each token's place in a sketch (``sketches``), and ``codes`` the tokens' distinct last 16 bits: what only one of two
    sets has of either stands for a token at least that the other lacks."""
    known = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, fresh = known.value, Fresh()
        for batch in (part for whole in batches for part in chunks(whole, text, CHUNK)):
            sets = Sets(batch.column(text), seed, shingle)
            one = fresh(sets.node)
            place = sets.node[one] & ((1 << BLOOM_BITS) - 1)
            one = one[(bits[place >> 5] >> (place & 31).astype(np.uint32) & 1) == 1]
            if len(one):
                tokens = [sets.token[sets.first[d] : sets.first[d + 1]].view(np.int64) for d in one.tolist()]
                ends = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
                every = np.concatenate(tokens)
                words, steps = sketches(every, ends)
                codes = [np.unique(t.astype(np.int16)) for t in tokens]
                marks = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(sets.node[one]), pa.ListArray.from_arrays(pa.array(ends), pa.array(every)), pa.ListArray.from_arrays(pa.array(steps), pa.array(words)), pa.ListArray.from_arrays(pa.array(marks), pa.array(np.concatenate(codes)))], names=["node", "tokens", "bits", "codes"])

    return map_batches(docs.select(text), run, "node long, tokens array<long>, bits array<long>, codes array<smallint>")


def bloom_of(nodes: DataFrame) -> np.ndarray:
    """A bitmap of 2 ** BLOOM_BITS bits (1 MB whatever the input) with a bit for each node."""
    place = F.col("node").bitwiseAND((1 << BLOOM_BITS) - 1)
    words = nodes.select(F.shiftright(place, 5).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast((node & {(1 << BLOOM_BITS) - 1}) & 31 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << (BLOOM_BITS - 5), np.uint32)
    bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    return bits


def shared(rows: DataFrame) -> DataFrame:
    """(token, node, flags) of tokens that more than one node has, each once. Frequent ones are taken for such, so no
    window holds a hot token's rows."""
    w = Window.partitionBy("token")
    rare = rows.where("flags < 2").withColumn("lo", F.min("node").over(w)).withColumn("hi", F.max("node").over(w)).where("lo != hi").drop("lo", "hi")
    return rare.unionByName(rows.where("flags >= 2")).distinct()


def by_entry(rows: DataFrame, several: str, *aggregates: Column) -> DataFrame:
    """``rows`` (sig, ...) with aggregates of their entry, of entries with more than one value of ``several``; a join, so
    that a hot entry's rows can be split."""
    found = rows.groupBy("sig").agg(F.min(several).alias("__lo"), F.max(several).alias("__hi"), F.count("*").alias("entry"), *aggregates)
    return rows.join(found.where("__lo != __hi").drop("__lo", "__hi"), "sig")


def _most(a_only: Column, b_only: Column) -> Column:
    """The most tokens that can be common, given what each side has alone."""
    return F.least(F.col("na") - a_only, F.col("nb") - b_only)


def _sides(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with a column of both sets: xa, xb, and their sizes na, nb."""
    side = sets.select("node", F.size("tokens").alias("n") if "n" not in sets.columns else "n", F.col(column).alias("x"))
    both = pairs.join(side.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("x").alias("xb")), "b")
    return both.join(side.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("x").alias("xa")), "a")


def _links(most: Column, percent: int) -> Column:
    return 100 * most >= percent * (F.col("na") + F.col("nb") - most)


def _folded(x: str, words: Column) -> Column:
    """A sketch folded onto ``words`` of its words."""
    part = lambda i: F.aggregate(F.sequence(F.lit(0), (F.size(x) / words).cast("int") - 1), F.lit(0).cast("long"), lambda bits, k: bits.bitwiseOR(F.get(x, i + k * words)))
    return F.when(F.size(x) == words, F.col(x)).otherwise(F.transform(F.sequence(F.lit(0), words - 1), part))


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) less those whose bits show that too few tokens can be common."""
    words = F.least(F.size("xa"), F.size("xb"))

    def only(one: str, two: str) -> Column:
        return F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda total, x: total + x)

    both = _sides(pairs, sets, "bits").withColumns({"xa": _folded("xa", words), "xb": _folded("xb", words)})
    return both.where(_links(_most(only("xa", "xb"), only("xb", "xa")), percent)).select("a", "b")


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those whose codes allow enough common tokens; a far closer bound than bits."""
    both = _sides(pairs, sets, "codes").withColumn("common", F.size(F.array_intersect("xa", "xb")))
    most = _most(F.size("xa") - F.col("common"), F.size("xb") - F.col("common"))
    return both.withColumn("least", most).where(_links(F.col("least"), percent)).select("a", "b")


def among(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``sets`` that are in ``nodes``, and a few others, so that the rest are not shuffled.

    By a bitmap of 2 ** BLOOM_BITS bits, as at most 2 ** (BLOOM_BITS - 6) rows of 64 that are broadcast."""
    word = F.expr(f"shiftright(node & {(1 << BLOOM_BITS) - 1}, 6)")
    words = nodes.groupBy(word.alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(node & 63 as int))")).alias("__bits"))
    return sets.join(F.broadcast(words), word == F.col("__word")).where("shiftright(__bits, cast(node & 63 as int)) & 1 = 1").drop("__word", "__bits")


def exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of written distinct pairs (a, b) that link, by their whole sets."""
    both = _sides(pairs, among(sets, pairs.select(F.explode(F.array("a", "b")).alias("node"))), "tokens")
    return both.where(_links(F.size(F.array_intersect("xa", "xb")), percent)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    return exact(scratch.table(likely(plausible(pairs, sets, percent), sets, percent)), sets, percent)


def _tile_pairs(nodes: DataFrame, percent: int, weight: Column, *columns: str) -> GroupedData:
    """Groups of two tiles each, of nodes (node, n, comp, cluster, bits and ``columns``) of one cluster.

    A cluster's nodes are dealt by size into buckets, of which only the same and adjacent ones can hold pairs, and those into
    tiles of at most about TILE nodes and TILE_CODES values of 16 bits (``weight``: those of a node)."""
    nodes = nodes.withColumn("bucket", F.floor(F.log("n") / log(100 / percent)).cast("int"))
    buckets = nodes.groupBy("cluster", "bucket").agg(F.count("*").alias("m"), F.sum(weight).alias("size"))
    tiles = F.ceil(F.greatest(F.col("m") / TILE, F.col("size") / TILE_CODES)).cast("int")
    # a map of at most some hundred buckets, since their sizes rise by a factor
    sizes = buckets.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("bucket", tiles.alias("tiles")))).alias("tiles"), F.sum("m").alias("m"))
    total = sizes.agg(F.sum("m")).first()[0] or 0
    dealt = join_hot(nodes, sizes, "cluster", "m", total).drop("m")
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("node", F.lit("tile")), F.col("tiles")[F.col("bucket")]).cast("int"))
    dealt = dealt.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("others", F.col("tiles")[F.col("bucket") + F.col("step")])
    dealt = dealt.where("others is not null").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    # the lower bucket's tile is i, and within one bucket the lower tile
    swap = (F.col("step") == -1) | ((F.col("step") == 0) & (F.col("other") < F.col("tile")))
    dealt = dealt.select(
        "cluster", F.least("bucket", F.col("bucket") + F.col("step")).alias("low"), F.abs("step").alias("gap"),
        F.when(swap, F.col("other")).otherwise(F.col("tile")).alias("i"), F.when(swap, F.col("tile")).otherwise(F.col("other")).alias("j"), "bucket", "tile", "node", "n", "comp", "bits", *columns,
    )
    return dealt.groupBy("cluster", "low", "gap", "i", "j")


def _by_bits(group: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of a group of two tiles, with the rows of other components that it may link with by size and bits."""
    bucket, tile, n, comp = (group.column(c).to_numpy() for c in ("bucket", "tile", "n", "comp"))
    bits = group.column("bits").to_numpy()
    words = min(map(len, bits))
    bits = np.stack([np.bitwise_or.reduce(x.reshape(-1, words)) for x in bits]).view(U)
    low, gap, i, j = (group.column(c)[0].as_py() for c in ("low", "gap", "i", "j"))
    left, right = np.flatnonzero((bucket == low) & (tile == i)), np.flatnonzero((bucket == low + gap) & (tile == j))
    for x in left.tolist():
        y = right[(comp[right] != comp[x]) & ((gap > 0 or i != j) | (right > x))]
        y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
        most = np.minimum(n[x] - np.bitwise_count(bits[x] & ~bits[y]).sum(1, dtype=np.int64), n[y] - np.bitwise_count(bits[y] & ~bits[x]).sum(1, dtype=np.int64))
        y = y[100 * most >= percent * (n[x] + n[y] - most)]
        if len(y):
            yield x, y


def tiled(nodes: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Likely pairs (a, b) of different components within each cluster of ``nodes``: node, n, comp, bits, cluster.

    A task compares two tiles, so no cluster lies in one task and no pair becomes a row unless it is likely. First tiles have
    bits alone and tell the nodes that may have a partner; only those are dealt again, with their far larger codes."""

    def partnered(group: pa.Table) -> pa.Table:
        node, has = group.column("node").to_numpy(), np.zeros(group.num_rows, bool)
        for x, y in _by_bits(group, percent):
            has[x] = has[y] = True
        return pa.table({"node": pa.array(node[has], pa.int64())})

    def compare(group: pa.Table) -> pa.Table:
        node, n = group.column("node").to_numpy(), group.column("n").to_numpy()
        codes = [np.asarray(c).view(np.uint16) for c in group.column("codes").to_numpy()]
        has, found = np.zeros(1 << 16, bool), []
        for x, y in _by_bits(group, percent):
            has[codes[x]] = True
            for z in y.tolist():
                common = int(np.count_nonzero(has[codes[z]]))
                most = min(int(n[x]) - len(codes[x]), int(n[z]) - len(codes[z])) + common
                if 100 * most >= percent * (int(n[x]) + int(n[z]) - most):
                    found.append((min(node[x], node[z]), max(node[x], node[z])))
            has[codes[x]] = False
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    some = scratch.table(_tile_pairs(nodes, percent, 4 * F.size("bits")).applyInArrow(partnered, "node long").distinct())
    left = nodes.join(some, "node", "left_semi").join(among(sets, some).select("node", "codes"), "node")
    return _tile_pairs(scratch.table(left), percent, F.size("codes"), "codes").applyInArrow(compare, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp): the least node that each node of ``edges`` is connected with.

    Every round maps the edges to components and hooks each component to the least of its neighbours."""
    labels = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("comp"), F.least("a", "m").alias("up"))
        hop = parent.select(F.col("comp").alias("up"), F.col("up").alias("upper"))
        parent = scratch.table(parent.join(hop, "up", "left").select("comp", F.coalesce("upper", "up").alias("up")))
        if labels is None:
            labels = parent.select(F.col("comp").alias("node"), F.col("up").alias("comp"))
        else:
            labels = labels.join(parent, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
        pa_, pb = parent.select(F.col("comp").alias("a"), F.col("up").alias("ua")), parent.select(F.col("comp").alias("b"), F.col("up").alias("ub"))
        edges = scratch.table(edges.join(pa_, "a").join(pb, "b").select(F.col("ua").alias("a"), F.col("ub").alias("b")).where("a != b").distinct())
        if edges.isEmpty():
            return scratch.table(labels)


class Join:
    """One run of the join over (key, text) rows."""

    def __init__(self, docs: DataFrame, key: str, text: str, shingle: int = SHINGLE, percent: int = PERCENT):
        if shingle < 1 or not 0 < percent < 100:
            raise ValueError("shingles have at least one word, and percent lies between 0 and 100")
        self.shingle, self.percent = shingle, percent
        self.docs, self.key, self.text = docs.select(key, text), key, text
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark)

    def rows(self) -> DataFrame:
        """(id, node, n) of each row, with the tokens' survey; again with another seed should two sets share a node."""
        for seed in (8, 108, 208):
            self.seed = seed
            made = self.scratch.table(survey(self.docs, self.key, self.text, seed, self.shingle))
            rows = made.where("kind = 0").select("id", "node", "check", "n")
            nodes = rows.where("n > 0").groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi"), F.count("*").alias("rows"), F.min("id").alias("least"), F.first("n").alias("n"))
            self.nodes = self.scratch.table(nodes)
            said = self.nodes.agg(F.sum("n").alias("tokens"), F.sum("rows").alias("rows"), F.max(F.col("lo") != F.col("hi")).alias("clash")).first()
            if not said.clash:
                self.total, self.n_rows = said.tokens or 0, said.rows or 0
                self.counted = made.where("kind = 1").select(F.col("id").alias("token"), F.col("n").alias("count"))
                return rows.select("id", "node", "n")
        raise RuntimeError("sets of different tokens share their hashes under every seed")

    def frequent(self) -> np.ndarray:
        """Tokens with more than 1 / 2**FREQUENT_BITS of all: so at most 2**FREQUENT_BITS."""
        counts = self.counted.groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") * (1 << FREQUENT_BITS) > self.total)
        return np.sort(counts.select("token").toPandas()["token"].to_numpy(np.int64).view(U))

    def members(self) -> DataFrame:
        """(token, node, flags) of nodes that may have a partner."""
        rows = prefixes(self.docs, self.text, self.seed, self.frequent(), self.shingle, self.percent)
        found = self.scratch.table(shared(rows))
        least = F.expr(f"least(2 + int(floor(n * {self.percent} / 100)) div 20 + 1, int(ceil(n * {self.percent} / 100)))")
        alive = found.groupBy("node").agg(F.count("*").alias("have")).join(self.nodes.select("node", "n"), "node").where(F.col("have") >= least).select("node")
        left = self.scratch.table(shared(found.join(alive, "node", "left_semi")))
        self.scratch.drop(found)
        return left

    def signatures(self, members: DataFrame) -> DataFrame:
        """(sig, node, n, entry, c): single tokens, and pairs of frequent ones within their class, that several nodes
        have; entry: their number, c: (node, n) of the first."""
        single = members.where(F.col("flags").bitwiseAND(1) != 0).select(F.xxhash64("token").alias("sig"), "node")
        paired = members.where(F.col("flags").bitwiseAND(2) != 0).withColumn("class", F.expr(f"pmod(token, {CLASSES})"))
        sets = paired.groupBy("node", "class").agg(F.array_sort(F.collect_set("token")).alias("t"))
        places = sets.select("node", "t", F.posexplode("t").alias("i", "one"))
        pairs = places.select("node", "one", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("two"))
        every = single.unionByName(pairs.select(F.xxhash64("one", "two", F.lit(2)).alias("sig"), "node")).distinct()
        every = self.scratch.table(every.join(self.nodes.select("node", "n"), "node"))
        found = self.scratch.table(by_entry(every, "node", F.min(F.struct("node", "n")).alias("c")))
        self.scratch.drop(every)
        return found

    def fitting(self, pairs: DataFrame) -> DataFrame:
        """Distinct (a, b) of pairs with sizes (na, nb) that can link."""
        ok = (100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")) & (F.col("a") != F.col("b"))
        return pairs.where(ok).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def links(self) -> DataFrame:
        """(node, comp) of nodes that link with another."""
        keep, drop = self.scratch.table, self.scratch.drop
        members = self.members()
        sigs = self.signatures(members)
        drop(members)
        alive = keep(sigs.select("node").distinct())
        sets = whole_sets(self.docs, self.text, self.seed, bloom_of(alive), self.shingle).join(alive, "node", "left_semi")
        sets = keep(sets.groupBy("node").agg(*(F.first(c).alias(c) for c in ("tokens", "bits", "codes"))))

        # first each node meets the centre that it shares most entries with, then one of another component, and then all that are left
        edges = keep(verified(self.best(sigs), sets, self.percent, self.scratch))
        labels = components(edges, self.scratch)
        left = self.unsettled(sigs, labels, F.min_by(F.struct("node", "n", "comp"), F.xxhash64("node", F.lit("centre"))).alias("c"))
        drop(sigs)
        edges = edges.unionByName(keep(verified(self.best(left.where("c.comp != comp")), sets, self.percent, self.scratch)))
        labels = components(edges, self.scratch)

        rest = self.unsettled(left, labels, F.min("node").alias("first"))
        drop(left)
        near = keep(self.all_pairs(rest, sets).distinct())
        drop(rest)
        edges = edges.unionByName(keep(exact(near, sets, self.percent)))
        return components(edges, self.scratch)

    def best(self, entries: DataFrame) -> DataFrame:
        """Pairs (a, b) of each node and the centre (``c``) that it shares most entries with."""
        met = entries.where("node != c.node").groupBy("node", "n", "c").agg(F.count("*").alias("entries"))
        best = met.groupBy("node", "n").agg(F.max(F.struct("entries", "c")).alias("m"))
        return self.fitting(best.select(F.col("m.c.node").alias("a"), F.col("m.c.n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb")))

    def unsettled(self, sigs: DataFrame, labels: DataFrame, *aggregates: Column) -> DataFrame:
        """(sig, node, n, comp, entry, aggregates) of index entries whose nodes lie in several components; entry: their number."""
        named = sigs.select("sig", "node", "n").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        return self.scratch.table(by_entry(named, "comp", *aggregates))

    def all_pairs(self, rest: DataFrame, sets: DataFrame) -> DataFrame:
        """Likely pairs (a, b) across components within all entries of ``rest``; a pair may come twice."""
        few, many = rest.where(F.col("entry") <= SMALL_ENTRY), rest.where(F.col("entry") > SMALL_ENTRY)
        one = few.select("sig", F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
        two = few.select("sig", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
        pairs = plausible(self.fitting(one.join(two, "sig").where(F.col("ca") < F.col("cb"))), sets, self.percent)
        pairs = likely(pairs, sets, self.percent)
        return pairs if many.isEmpty() else pairs.unionByName(tiled(self.clusters(many, sets), sets, self.percent, self.scratch))

    def clusters(self, many: DataFrame, sets: DataFrame) -> DataFrame:
        """Nodes of large entries, each once, with the cluster of entries that share nodes."""
        star = many.select(F.col("first").alias("a"), F.col("node").alias("b")).where("a != b").distinct()
        named = components(self.scratch.table(star), self.scratch).withColumnRenamed("comp", "cluster")
        nodes = many.select("node", "n", "comp").distinct()
        return self.scratch.table(nodes.join(named, "node").join(sets.select("node", "bits"), "node"))

    def result(self) -> DataFrame:
        """(id, n_shingles, component_id) of each row."""
        rows = self.rows()
        labels = self.links() if self.total else None
        info = self.nodes.select("node", "rows", "least")
        if labels is not None:
            named = info.join(labels, "node").groupBy("comp").agg(F.min("least").alias("whole"))
            named = labels.join(named, "comp").select("node", "whole")
            info = info.join(named, "node", "left").select("node", "rows", F.coalesce("whole", "least").alias("least"))
        info = self.scratch.table(info)
        linked = join_hot(rows.where("n > 0"), info, "node", "rows", self.n_rows)
        out = linked.select("id", "n", F.col("least").alias("component_id")).unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
        return out.select(F.col("id").alias(self.key), F.col("n").alias("n_shingles"), "component_id")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of each row; the component is named by its least key. Sets of shingles of
    ``shingle`` words link at a Jaccard similarity of ``percent`` (1 to 99) hundredths."""
    return Join(docs, key, text, shingle, percent).result()


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component: that with the least key, null keys last.

    Rows are joined by numbers of their own, so rows with null keys take part as all others, rows that repeat
    a key go only as copies, and rows with null or empty texts, which link with nothing, all stay."""
    # written, since a number given anew may fall on another row
    rows = Scratch(docs.sparkSession).table(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = near_duplicates(rows, key="__row", text=text, shingle=shingle, percent=percent).select("__row", "component_id")
    order = F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), F.col("__row").alias("row"))
    kept = found.join(rows.select("__row", key), "__row").groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(kept.select(F.col("first.row").alias("__row")), "__row", "left_semi").select(*docs.columns)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS v, doc_id AS u FROM d UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.u)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(u) AS component_id FROM r GROUP BY v) c ON c.v = d.doc_id
"""
