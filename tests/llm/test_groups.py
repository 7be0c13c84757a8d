"""Operators across rows: brute force on small fixtures, odd rows, the pipeline."""

import collections
import random
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from chronofold.llm import line_dedup, ngram_join
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def plain_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (i, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                up[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(i, least.get(find(x), i))
    return sorted((i, len(s), least[find(x)]) for x, (i, s) in enumerate(sets))


def copies(seed, n=220):
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefghijklmnop") + str(draw.randrange(60))
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(draw.choice([2, 4, 9, 30, 80, 150]))] for _ in range(12)]
    rows = []
    for i in range(n):
        t = list(draw.choice(bases[:4] if draw.random() < 0.6 else bases))
        for _ in range(draw.choice([0, 0, 1, 2, 3, 5])):
            t[draw.randrange(len(t))] = word()
        if draw.random() < 0.3:
            t = t + passage if draw.random() < 0.5 else [word() for _ in range(60)] + passage
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("seed, frequent_bits, small_entry", [(1, 16, 64), (2, 6, 4), (3, 4, 2), (4, 8, 0)])
def test_join_is_exact(spark, monkeypatch, seed, frequent_bits, small_entry):
    monkeypatch.setattr(ngram_join, "FREQUENT_BITS", frequent_bits)
    monkeypatch.setattr(ngram_join, "SMALL_ENTRY", small_entry)
    monkeypatch.setattr(ngram_join, "TILE", 8)
    rows = copies(seed)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == plain_components(rows)


def plain_components_of(rows, k, percent):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for i, t in rows}
    sets = {i: frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset() for i, w in words.items()}
    comp = {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b) and comp[i] != comp[j]:
                low, high = sorted((comp[i], comp[j]))
                comp = {x: low if c == high else c for x, c in comp.items()}
    return sorted((i, len(s), comp[i]) for i, s in sets.items())


@pytest.mark.parametrize("seed, shingle, percent", [(5, 5, 80), (6, 2, 50)])
def test_join_is_exact_for_other_values(spark, monkeypatch, seed, shingle, percent):
    monkeypatch.setattr(ngram_join, "FREQUENT_BITS", 6)
    monkeypatch.setattr(ngram_join, "SMALL_ENTRY", 4)
    monkeypatch.setattr(ngram_join, "TILE", 8)
    rows = copies(seed, 160) + [(1000 + i, " ".join(f"s{j}" for j in range(i))) for i in range(1, 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.near_duplicates(docs, shingle=shingle, percent=percent).collect()
    assert sorted(tuple(r) for r in got) == plain_components_of(rows, shingle, percent)


def sets_of(spark, *texts):
    """The whole sets of texts, and the node of each."""
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    every = np.full(1 << (ngram_join.BLOOM_BITS - 5), 0xFFFFFFFF, np.uint32)
    nodes = [int(x) for x in ngram_join.Sets(pa.array(texts), 8, 1).node]
    return ngram_join.whole_sets(docs, "text", 8, every, 1), nodes


def test_sketches_of_large_sets(spark):
    text = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    sets, (a, b, c, d, e) = sets_of(spark, text("a", 3000), text("a", 1000) + " " + text("b", 2000), text("a", 2900), text("c", 500), text("c", 1600))
    pairs = spark.createDataFrame([(a, b), (a, c), (d, e)], "a long, b long")
    found = {percent: sorted(tuple(r) for r in ngram_join.plausible(pairs, sets, percent).collect()) for percent in (85, 30)}
    assert found[85] == [(a, c)] and {(a, c), (d, e)} <= set(found[30])  # (a, b) have a fifth in common
    wanted = spark.createDataFrame([(a,), (d,)], "node long")
    assert sorted(r.node for r in ngram_join.among(sets, wanted).select("node").collect()) == sorted([a, d])


@pytest.mark.parametrize("small_entry", [64, 0])
def test_join_is_exact_for_sketches_of_several_lengths(spark, monkeypatch, small_entry):
    monkeypatch.setattr(ngram_join, "SMALL_ENTRY", small_entry)
    monkeypatch.setattr(ngram_join, "TILE", 8)
    draw = random.Random(7)
    base = [f"w{i}" for i in range(1100)]
    rows = []
    for i, n in enumerate([470, 490, 505, 520, 540, 560, 900, 950, 1000, 1030, 1060, 1100] * 3):
        t = base[:n]
        for _ in range(draw.choice([0, 5, 12, 25])):
            t[draw.randrange(n)] = f"x{i} {draw.random()}"
        rows.append((i, " ".join(t)))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == plain_components(rows)


def test_tiles_deal_codes_to_nodes_that_may_link(spark, monkeypatch):
    """Of a cluster of nodes with little in common, only those with a possible partner are dealt with their codes."""
    dealt, tables = ngram_join._tile_pairs, []
    monkeypatch.setattr(ngram_join, "_tile_pairs", lambda nodes, percent, weight, *columns: tables.append((columns, nodes.count())) or dealt(nodes, percent, weight, *columns))
    alike = " ".join(f"q{i}" for i in range(300))
    texts = [" ".join(f"{c}{i}" for i in range(300)) for c in "abcdefgh"] + [alike, alike + " more"]
    sets, of = sets_of(spark, *texts)
    nodes = spark.createDataFrame([(x, x, 1) for x in of], "node long, comp long, cluster long").join(sets.select("node", F.size("tokens").cast("long").alias("n"), "bits"), "node")
    found = ngram_join.tiled(nodes, sets, 85, ngram_join.Scratch(spark)).collect()
    assert [tuple(r) for r in found] == [tuple(sorted(of[-2:]))] and tables == [((), 10), (("codes",), 2)]


def test_pipeline_near_copies_by_five_words(spark, small):
    base = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join(base + [f"x{i}" for i in range(66)])), (3, " ".join(base + [f"y{i}" for i in range(90)]))]
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), small)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_join_odd_rows(spark, odd_docs, no_docs):
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(odd_docs).collect()), key=str)
    assert len(got) == 10
    found = collections.defaultdict(list)
    for i, n, c in got:
        found[i].append((n, c))
    assert found[5] == [found[4][0]] * 2 and found[4][0][1] == 4
    assert [found[i] for i in (2, 3, 7)] == [[(0, 2)], [(0, 3)], [(0, 7)]]
    assert found[6] == [(1, 6)]
    assert ngram_join.near_duplicates(no_docs).count() == 0
    kept = ngram_join.one_of_each(odd_docs)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 6, 7, 8] and kept.columns == odd_docs.columns


def test_one_of_each_by_row(spark, odd_docs):
    text = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(None, text("a")), (None, text("a")), (None, text("b")), (3, text("b")), (2, text("c")), (2, text("d")), (2, text("d")), (1, text("c")), (None, None), (None, ""), (4, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("extra")).repartition(3)
    kept = ngram_join.one_of_each(docs)
    want = [(None, text("a")), (3, text("b")), (1, text("c")), (2, text("d")), (None, None), (None, ""), (4, ""), (4, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str) and kept.columns == docs.columns
    assert sorted((str(r.doc_id) for r in ngram_join.one_of_each(odd_docs).collect())) == ["1", "2", "3", "4", "6", "7", "8", "None"]


def least_runs(lines):
    """(places, lines) of the shortest runs of 10 words from each line with words, and up to each."""
    words = [len(x.split()) for x in lines]
    for i, n in enumerate(words):
        for step in (1, -1):
            j, have = i, n
            while have < 10 and 0 <= j + step < len(lines):
                j += step
                have += words[j]
            if n and have >= 10:
                lo, hi = min(i, j), max(i, j)
                yield range(lo, hi + 1), tuple(lines[lo : hi + 1])


def check_cut(rows, gone):
    """Whether just common runs go, and none is left, by looking up every run of every document; no code is shared with the operator."""
    lines = {i: [x.strip(" \t\r") for x in (t or "").split("\n")] for i, t in rows}
    earlier = set()
    for i in sorted(lines):
        own = list(least_runs(lines[i]))
        common = {p for places, run in own if run in earlier for p in places}
        assert all(not lines[i][p] for p in gone.get(i, set()) - common)  # a block's empty lines are in no shortest run at its ends
        assert not any(run in earlier and gone.get(i, set()).isdisjoint(places) for places, run in own)
        earlier.update(run for _, run in own)


def gone_of(docs):
    return {r.id: {g["at"] for g in r.gone} for r in line_dedup.deletions(docs).collect()}


def text_without(text, gone):
    kept = [x for k, x in enumerate((text or "").split("\n")) if k not in gone]
    return text if not gone else "" if all(not x.strip() for x in kept) else "\n".join(kept)


def test_line_dedup(spark):
    draw = random.Random(4)
    pool = [" ".join(f"{draw.choice('abcdefg')}{draw.randrange(30)}" for _ in range(draw.choice([2, 5, 10, 14, 55]))) for _ in range(60)]
    rows = [(i, "\n".join(draw.choice(pool) if draw.random() < 0.5 else f"own line {i} {j}" for j in range(draw.randrange(1, 12)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, gone = {r.doc_id: r.text for r in line_dedup.cut(docs).collect()}, gone_of(docs)
    check_cut(rows, gone)
    assert gone and got == {i: text_without(t, gone.get(i, set())) for i, t in rows}
    left = collections.Counter(x for t in got.values() for x in set(t.split("\n")) if len(x.split()) >= 10)
    assert max(left.values()) == 1


def all_pairs_cut(rows):
    """Each document is compared with every earlier one."""
    lines = {i: [x.strip(" \t\r") for x in t.split("\n")] for i, t in rows}
    out = {}
    for i, t in rows:
        gone = set()
        for first in lines:
            if first < i:
                gone.update(line_dedup.common_blocks(lines[first], lines[i], [len(x.split()) for x in lines[i]]))
        kept = [x for k, x in enumerate(t.split("\n")) if k not in gone]
        out[i] = t if not gone else "" if all(not x.strip() for x in kept) else "\n".join(kept)
    return out


def test_line_dedup_short_lines(spark):
    draw = random.Random(8)
    line = lambda n: " ".join(f"{draw.choice('abcdefg')}{draw.randrange(90)}" for _ in range(n))
    blocks = [[line(draw.choice([0, 1, 3, 4, 5, 12])) for _ in range(draw.randrange(2, 7))] for _ in range(30)]
    rows = []
    for i in range(120):
        parts = [draw.choice(blocks) if draw.random() < 0.5 else [f"own line {i} {j}"] for j in range(draw.randrange(1, 6))]
        rows.append((i, "\n".join(x for p in parts for x in p)))
    rows += [(200, "one two three four\n\nfive six seven\n eight nine ten\nown 200"), (201, "own 201\none two three four\n\nfive six seven\neight nine ten")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.cut(docs).collect()}
    check_cut(rows, gone_of(docs))
    assert got == all_pairs_cut(rows) and got[201] == "own 201"
    assert any(len(x.split()) < 10 and t.count(x) > got[i].count(x) for i, t in rows for x in t.split("\n") if x)


def test_blocks_of_repeated_short_lines():
    assert line_dedup.common_blocks(list("abc"), list("cbaabc"), [4] * 6) == [3, 4, 5]
    assert line_dedup.common_blocks(list("abcab"), list("bacab"), [4] * 5) == [2, 3, 4]


def test_line_dedup_odd_rows(spark, odd_docs, no_docs):
    got = line_dedup.cut(odd_docs, counts=True)
    rows = collections.Counter((r.doc_id, len(r.text or ""), r.n_deleted) for r in got.collect())
    assert sum(rows.values()) == 10 and rows[(5, 0, 1)] == 2
    assert got.columns == [*odd_docs.columns, "n_lines", "n_deleted"]
    assert line_dedup.cut(no_docs).count() == 0
    kept = line_dedup.cut(odd_docs, drop_emptied=True)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 6, 7, 8]


def test_texts_in_opposite_orders():
    lines = list(range(20_000))
    assert line_dedup.common_blocks(lines, lines[::-1], [12] * len(lines)) == lines  # quadratic steps would take minutes


def test_alignment():
    a, b = list("abcdefgh"), list("xabyefgz")
    assert line_dedup.aligned(a, b) == [(0, 1), (1, 2), (4, 4), (5, 5), (6, 6)]
    assert line_dedup.common_blocks(list("abc"), list("cxab"), [9, 9, 9, 9], 10) == [2, 3]
    assert line_dedup.common_blocks(list("ab"), list("ababa"), [6] * 5, 10) == [0, 1, 2, 3]
    assert line_dedup.increasing([(0, 3), (1, 0), (2, 1), (3, 2)]) == [(1, 0), (2, 1), (3, 2)]


def test_pipeline(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before, rows = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, before, small)
        made.write.parquet(str(tmp_path / name))
        before = spark.read.parquet(str(tmp_path / name))
        rows[name] = before.count()
        if name != "packing":
            assert before.columns == docs.columns
            assert before.where("text is not null and n_chars != char_length(text)").count() == 0
    left = spark.read.parquet(str(tmp_path / "decontamination"))
    assert rows["toxicity"] > rows["ngram_join"] >= rows["decontamination"] > 0
    assert before.select("doc_id").distinct().count() == left.count()
    toxic = spark.read.parquet(str(tmp_path / "toxicity"))
    texts, gone = [(r.doc_id, r.text) for r in toxic.collect()], gone_of(toxic)
    check_cut(texts, gone)
    cut = {i: text_without(t, gone.get(i, set())) for i, t in texts}
    assert {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "line_dedup")).collect()} == {i: t for i, t in cut.items() if t or not gone.get(i)}
    single = spark.read.parquet(str(tmp_path / "line_dedup")).select("doc_id", "text").collect()
    alike = {i: c for i, _, c in plain_components_of([tuple(r) for r in single], 5, 80)}
    kept = [r.doc_id for r in spark.read.parquet(str(tmp_path / "ngram_join")).select("doc_id").collect()]
    assert sorted(kept) == sorted(set(alike.values()))
    whole = corpus_pipeline.run(spark, small)
    assert whole.agg(F.sum("length")).first()[0] == before.agg(F.sum("length")).first()[0]
    assert np.isclose(whole.count(), rows["packing"], atol=5)
