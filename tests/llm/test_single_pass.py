"""Operators that read each row once: brute force, round trips, odd rows."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from chronofold.llm import chat_format, decontamination, html_text, language_id, matroska, packing, token_counts, toxicity
from pyspark.sql import functions as F


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def noise(n, seed=5):
    draw = random.Random(seed)
    letters = "abzZÉéßñÑ09 _-'\t\n\x85\xa0\x1c.,|<>İǅªº²½Ωж"
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(n)] + ["it's I'LL don'T", "a<|endoftext|>b", "ΑΣ ΣΑΣ", "x" * 5000]


def test_token_counts(spark, odd_docs, no_docs):
    docs = spark.createDataFrame(list(enumerate(noise(2000))), "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = sorted((str(i), len(t.encode()), len(library.encode(t, add_special_tokens=False))) for i, t in texts_of(docs))
    got = token_counts.count_tokens(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == expected
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.count_tokens(no_docs).count() == 0
    assert token_counts.count_tokens(odd_docs).count() == 10


def test_packing(spark, odd_docs, no_docs):
    docs = spark.createDataFrame(list(enumerate(noise(800) + ["many words here " * 3000])), "doc_id long, text string")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(docs).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in texts_of(docs):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    # little padding: but for each partition's last group, windows are nearly full
    partitions = docs.rdd.getNumPartitions()
    assert len(by_sequence) <= sum(r.length for r in rows) / (0.97 * 2048) + partitions
    assert packing.pack(no_docs).count() == 0
    assert packing.pack(odd_docs).agg(F.sum("length")).first()[0] > 100_000


@pytest.mark.parametrize("k", [1, 2, 3, 7, 20])
def test_differencing(k):
    draw = random.Random(k)
    sizes = [draw.randint(1, 512) for _ in range(150)]
    found = packing.difference(sizes, k)
    assert sorted(i for w in found for i in w) == list(range(150))
    sums = [sum(sizes[i] for i in w) for w in found]
    assert len(found) == k and max(sums) - min(sums) <= 512
    assert all(sum(sizes[i] for i in w) <= 2048 for w in packing.windows(sizes, 2048))


def plain_hits(text, items):
    words = decontamination.words_of(text)
    hit, found = set(), set()
    for item, other in items:
        w = decontamination.words_of(other)
        n = min(13, len(w))
        theirs = {tuple(w[i : i + n]) for i in range(len(w) - n + 1 if n else 0)}
        for j in range(len(words) - n + 1 if n else 0):
            if tuple(words[j : j + n]) in theirs:
                hit.update(range(j, j + n))
                found.add(item)
    return len(words), len(hit), len(found), decontamination.digest(found)


def test_decontamination(spark, odd_docs, no_docs, monkeypatch):
    draw = random.Random(1)
    word = lambda: draw.choice(["alpha", "Beta", "x1", "é", "gamma", "of", "the"])
    items = [(i, " ".join(word() for _ in range(draw.choice([0, 1, 2, 5, 12, 13, 14, 30])))) for i in range(12)] + [(90, None), (91, "...")]
    items[1] = (1, "unique short item words")
    rows = []
    for i in range(60):
        t = [word() for _ in range(draw.randint(0, 60))]
        src = draw.choice(items)[1] or ""
        at = draw.randint(0, len(t))
        rows.append((i, ", ".join(t[:at] + src.split() + t[at:])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    docs = docs.unionByName(odd_docs.select("doc_id", "text"))
    expected = sorted((str(i), *plain_hits(t, items)) for i, t in texts_of(docs))
    key = lambda r: (str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256)
    got = decontamination.flag(docs, bench).collect()
    assert sorted(key(r) for r in got) == expected
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)
    monkeypatch.setattr(decontamination, "INDEX_WINDOWS", 0)
    assert sorted(map(key, decontamination.flag(docs, bench).collect())) == sorted(map(key, got))
    monkeypatch.undo()
    assert decontamination.flag(no_docs, bench).count() == 0
    assert all(r.n_hit == 0 for r in decontamination.flag(docs, bench.limit(0)).collect())


def test_clean_cuts_light_hits(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    host = " ".join(f"w{i}" for i in range(1000))
    docs = spark.createDataFrame([(1, f"{host} {passage} {host}", "k"), (2, f"a {passage}", "k"), (3, "clean text", "k"), (4, None, "k")], "doc_id long, text string, source string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontamination.clean(docs, bench).collect()}
    assert set(got) == {1, 3, 4} and got[1] == f"{host}  {host}" and got[3] == "clean text" and got[4] is None


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_clean_is_the_same_either_way(spark, monkeypatch, odd_docs, no_docs, limit):
    monkeypatch.setattr(decontamination, "INDEX_WINDOWS", limit)
    passage, short = " ".join(f"p{i}" for i in range(20)), "only four words here"
    host = " ".join(f"w{i}" for i in range(1000))
    rows = [(1, f"{host} {passage} {host}"), (2, f"a {passage}"), (2, "clean text"), (2, None), (None, f"b {passage}"), (None, f"É {short} {host}"), (None, f"{passage} {host} {short}, {passage}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("extra")).repartition(3)
    bench = spark.createDataFrame([(1, passage), (2, passage), (3, short), (4, None)], "item_id long, text string")
    got = decontamination.clean(docs, bench)
    want = [(1, f"{host}  {host}"), (2, "clean text"), (2, None), (None, f"É  {host}"), (None, f" {host} ")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str) and got.columns == docs.columns
    assert decontamination.clean(odd_docs, bench).count() == 10 and decontamination.clean(no_docs, bench).count() == 0
    assert decontamination.clean(docs, bench.where("item_id = 4")).count() == 7


def test_matroska(spark, odd_docs, no_docs):
    rows = matroska.digest(matroska.store(odd_docs)).collect()
    want = {}
    for i, t in texts_of(odd_docs):
        raw = t.encode()
        want.setdefault(i, (len(raw), hashlib.sha256(raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))).hexdigest()))
    assert len(rows) == 10 and all((r.n_bytes, r.payload_sha256) == want[r.doc_id] for r in rows)
    assert matroska.store(no_docs).count() == 0
    packets = matroska.packet_table(matroska.store(odd_docs.where("doc_id = 4"))).orderBy("begin").collect()
    assert all(b.ms - a.ms == 72 and a.end <= b.begin for a, b in zip(packets, packets[1:]))


def test_lacing_kinds_and_unknown_sizes():
    m = matroska
    frames = [b"a" * 300, b"b" * 5, b"c" * 260, b"d"]
    xiph = bytes([3, 255, 45, 5, 255, 5])
    ebml = bytes([3]) + (0x4000 | 300).to_bytes(2, "big") + (0x4000 | (5 - 300 + 8191)).to_bytes(2, "big") + (0x4000 | (255 + 8191)).to_bytes(2, "big")
    body = b"".join(frames)
    blocks = [m.element(m.SIMPLE, b"\x82" + struct.pack(">hB", -3, flags) + head + body) for flags, head in ((0x02, xiph), (0x86, ebml))]
    group = m.element(m.GROUP, m.element(m.BLOCK, b"\x82" + struct.pack(">hB", 9, 0) + b"zz") + m.element(m.REFERENCE, b"\x01"))
    cluster = m.id_bytes(m.CLUSTER_ID) + b"\xff" + m.number(m.TIME, 100) + blocks[0] + blocks[1] + group
    data = m.element(m.EBML, b"") + m.id_bytes(m.SEGMENT) + b"\x01" + b"\xff" * 7 + cluster + cluster
    media = m.packets(data)
    assert media.clusters == 2
    assert [data[p.begin : p.end] for p in media.packets] == (frames * 2 + [b"zz"]) * 2
    assert [p.time for p in media.packets][:9] == [97] * 8 + [109] and [p.key for p in media.packets][:9] == [False] * 4 + [True] * 4 + [False]
    assert not media.packets[8].key
    for broken in (b"", b"no", data[: len(data) - 1]):
        with pytest.raises((ValueError, struct.error, IndexError)):
            m.packets(broken)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "<|im_end|> <\\| <\\\\| a\nb"), (1, 1, "assistant", "<|im_start|>x"), (1, 2, "odd %<|\nrole", "t"), (2, 5, None, None), (3, 1, "assistant", ""), (3, 0, "user", "q"), (None, 0, "user", "u"), (3, 2, "assistant", "z"), (3, 2, "assistant", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    made = chat_format.format_examples(turns)
    got = {r.conv_id: r for r in chat_format.digest(made).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for conv in (1, 2, 3, None):
        own = sorted([(r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, r, t in own))
        assert got[conv].loss_sha256 == sha("".join(t for _, r, t in own if r == "assistant"))
    assert made.where("conv_id = 3").count() == 3 and made.where("conv_id = 1").count() == 2
    assert chat_format.digest(chat_format.format_examples(turns.limit(0))).count() == 0


PAGE = """<html><head><title>T</title><script>var x="</p>"</script></head><body class="has-sidebar"><nav><a href=/>Home</a></nav>
<div class="ad">Buy this thing now, it is a wonderful thing to buy for everyone.</div>
<article><h1>Head &amp; line</h1><p><b>First   paragraph of the text, with <i>inline</i> words.<br><p>Short.</p><form>Name</form>
<p>Another paragraph that is long enough to count &#8212; really.</p><div id="comments"><p>I like this a lot, thank you so much for it.</p></div></article>
<aside>More links</aside><footer>&copy; us</footer>"""


def test_html():
    assert html_text.main_text(PAGE) == "Head & line\nFirst paragraph of the text, with inline words.\nShort.\nAnother paragraph that is long enough to count — really."
    for odd, text in ((None, ""), ("", ""), ("plain", "plain"), ("<p>a", "a"), ("<nav>x</nav>", ""), ("<div>", "")):
        assert html_text.main_text(odd) == text
    assert len(html_text.main_text("<p>" + "word " * 200_000 + "</p>")) == 999_999


LONG = "A paragraph that is long enough to count as text of the article, with many words in it and few tags."


@pytest.mark.parametrize(
    "before, after",
    [("<div class='layout has-sidebar'><article>", "</article></div>"), ("<div class='sidebar-left-layout'><div id='rail'><main>", "</main></div></div>"), ("<div id='content' class='no-comments'>", "</div>"), ("<p>Title</p><div class='page comments-open'>", "</div>")],
)
def test_html_wrapper_names(before, after):
    page = f"<body><nav>Home</nav>{before}<p>{LONG}</p><p>{LONG}</p>{after}<div class='related'><article><p>{LONG} Other.</p></article></div><footer>us</footer>"
    if "article" not in before and "main" not in before:
        page = page.replace("<article>", "").replace("</article>", "")
    text = html_text.main_text(page)
    assert text.count(LONG) >= 2 and "Home" not in text and "us" not in text.split("\n")
    if "article" in before or "main" in before or "no-" in before:
        assert text == f"{LONG}\n{LONG}"


def test_html_marks_that_stay():
    page = f"<body><div class='has-rail'><article><p>{LONG}</p><div class='comments'><article><p>{LONG} I say.</p></article></div></article><aside><article><p>{LONG} Aside.</p></article></aside></div>"
    assert html_text.main_text(page) == LONG
    assert html_text.main_text(f"<body><div><p>{LONG}</p></div><div id='comments'><p>{LONG} I say.</p><p>{LONG} Me too.</p></div>") == LONG


def test_html_sparse_parts_of_the_article():
    cells = "".join(f"<tr><td>{i}</td><td>v{i}</td></tr>" for i in range(20))
    parts = "".join(f"<section><div>part {i}</div></section>" for i in range(12))
    inner = f"<p>{LONG}</p><p>{LONG}</p><table>{cells}</table>{parts}<div><a href=/x>a source</a></div>"
    want = [LONG, LONG, *(x for i in range(20) for x in (str(i), f"v{i}")), *(f"part {i}" for i in range(12)), "a source"]
    for tag in ("article", "main"):
        assert html_text.main_text(f"<body><div>top</div><{tag}>{inner}</{tag}><div>end</div>").split("\n") == want
    assert html_text.main_text(f"<body><div>{inner}</div>").split("\n") == want
    assert html_text.main_text(f"<body><main><h1>Title</h1></main><div><p>{LONG}</p><p>{LONG}</p></div>") == f"{LONG}\n{LONG}"
    assert html_text.main_text(f"<body><article><p>{LONG}</p><p>{LONG}</p></article><article><p>Teaser</p></article>") == f"{LONG}\n{LONG}"


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_text.extract(pages).collect()
    assert len(got) == 3 and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_language_model_is_ppm():
    texts = {"aa": [b"abab abab"], "bb": [b"bcbc bc"]}
    model = language_id.Model(texts)
    # after each context, what may follow has probabilities that sum to one
    shared = 256 - (model.used - 1)
    for row in range(1, len(model.keys) + 1):
        p = 2.0 ** -model.cost[row].astype(float)
        p[0] *= shared
        assert np.allclose(p.sum(0), 1, atol=1e-4)
    data = np.frombuffer(b"abab\n", np.uint8)
    bits = model.code_lengths(data, np.array([0, 5]))
    assert bits.shape == (1, 2) and bits[0, 0] < bits[0, 1]


def naive_bits(training, text):
    """Bits of a text in each language by PPM with escape method C and exclusion, byte by byte, from counts in dictionaries."""
    start = b"\n" * language_id.ORDER
    fold = bytes.lower  # A-Z only
    data = {k: fold(start + start.join(v) + start) for k, v in training.items()}
    keeps = set()
    for x in data.values():
        seen = {}
        for i in range(3, len(x)):
            seen[x[i - 3 : i]] = seen.get(x[i - 3 : i], 0) + 1
        keeps |= {c for c, n in seen.items() if n >= language_id.KEPT}
    used = sorted({c for x in data.values() for c in x})
    out = {}
    for name, x in data.items():
        counts = {}
        for order in range(4):
            for i in range(order, len(x)):
                row = counts.setdefault(x[i - order : i], {})
                row[x[i]] = row.get(x[i], 0) + 1

        def p(context, byte):
            if len(context) == 3 and context not in keeps:
                return p(context[1:], byte)
            shorter = (lambda b: 1 / 256) if not context else lambda b: p(context[1:], b)
            row = counts.get(context, {})
            if not row:
                return shorter(byte)
            total = sum(row.values()) + len(row)
            if byte in row:
                return row[byte] / total
            left = 1 - sum(shorter(b) for b in row)
            return len(row) / total * shorter(byte) / left

        whole = fold(start + text + b"\n")
        out[name] = sum(-np.log2(p(whole[i - 3 : i], whole[i])) for i in range(3, len(whole)))
    assert len(used) < language_id.CLASSES
    return out


def test_language_bits_are_exact_and_local():
    training = {"aa": [b"una casa grande", b"la casa casa"], "bb": [b"the house is big", b"that house there"]}
    model = language_id.Model(training)
    texts = [b"una casa", b"the casa", b"una casa", b"", b"house", b"una casa"]
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bits = model.code_lengths(np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8), bounds)
    assert (bits[0] == bits[2]).all() and (bits[0] == bits[5]).all()  # whatever stands before
    for text, got in zip(texts, bits):
        assert np.allclose(got, list(naive_bits(training, text).values()), rtol=1e-4)


def test_language_id(spark, small, odd_docs, no_docs):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = language_id.op5_language_id(spark, small).join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null")
    held = got.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count()
    training = language_id.sample_by_language(docs, key="doc_id", lang="lang", text="text")
    rows = language_id.identify(odd_docs, training).collect()
    assert len(rows) == 10 and {r.lang_pred for r in rows if r.doc_id in (2, 3, 7)} == {"und"}
    assert all(0 <= r.score <= 1 for r in rows)
    assert language_id.identify(no_docs, training).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd_docs, {}).collect()} == {"und"}


@pytest.fixture(scope="module")
def machine():
    draw = random.Random(2)
    word = lambda: "".join(draw.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(draw.randint(1, 3)))
    texts, toxic = [], []
    for i in range(700):
        words = [word() for _ in range(draw.randint(5, 60))]
        bad = i % 3 == 0
        if bad:
            words[draw.randrange(len(words))] = draw.choice(["idiot", "moron", "scumbag"])
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return toxicity.Machine(texts[:500], np.array(toxic[:500])), texts[500:], np.array(toxic[500:])


def test_toxicity(machine):
    fitted, texts, toxic = machine
    score = fitted.scores(texts)
    assert ((score >= 0.5) == toxic).mean() >= 0.97
    gapped = fitted.scores(["the on idxiot here", "in mo-ron re", "then an id1ot"])
    assert (gapped > fitted.scores(["the on thin here", "in re on re", "then an one"])).all()
    assert fitted.scores([""])[0] < 0.5


def test_collapsed_table_equals_kernel():
    symbols, begins = toxicity.fold(["some words that idiot has here and there", "more of it"])
    marks, places = begins[0] + np.array([2, 11, 20]), begins[0] + np.arange(0, 30)
    kernel = toxicity.Nystroem(*toxicity.features(symbols, marks))
    linear = np.arange(1, kernel.whiten.shape[1] + 1, dtype=np.float32)
    direct = kernel(*toxicity.features(symbols, places)) @ linear
    assert np.allclose(direct, toxicity.margins(symbols, kernel.collapse(linear))[places], rtol=1e-3, atol=1e-3)


def test_kernel_by_enumeration():
    from itertools import combinations

    text, other = "some idiot here", "an idxiot is"
    (a, begin_a), (b, begin_b) = toxicity.fold([text]), toxicity.fold([other])

    def subsequences(symbols, place):
        found = {}
        for start in range(place, place + toxicity.STARTS):
            for rest in combinations(range(1, toxicity.SPAN), toxicity.LENGTH - 1):
                word = tuple(int(symbols[start + i]) for i in (0, *rest))
                found[word] = found.get(word, 0) + toxicity.DECAY ** (rest[-1] + 1)
        return found

    def value(x, y):
        return sum(w * y.get(k, 0) for k, w in x.items())

    for i in (0, 3, 6):
        for j in (0, 3, 4):
            code, weight = toxicity.features(np.concatenate([a, b]), np.array([begin_a[0] + i, len(a) + begin_b[0] + j]))
            phi = toxicity.Nystroem(code, weight).phi
            want = value(subsequences(a, int(begin_a[0]) + i), subsequences(b, int(begin_b[0]) + j))
            assert np.isclose(phi[:, 0] @ phi[:, 1], want, rtol=1e-4, atol=1e-6)


def test_toxicity_of_held_out_labels(spark):
    """Each held-out toxic document that holds a word of toxic learnt documents alone is caught, and few clean ones are."""
    sf = "/root/testdata/sf0.1"
    scored = {r.doc_id: r for r in toxicity.op3_toxicity(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").join(labels, "doc_id").collect()
    seen = {0: Counter(), 1: Counter()}
    words = {r.doc_id: set(re.findall(r"\w+", (r.text or "").lower())) for r in rows}
    for r in rows:
        if not scored[r.doc_id].held_out:
            seen[r.toxic].update(words[r.doc_id])
    insults = {w for w, n in seen[1].items() if n >= 50 and not seen[0][w]}
    marked = [scored[r.doc_id] for r in rows if r.toxic == 1 and scored[r.doc_id].held_out and words[r.doc_id] & insults]
    clean = [scored[r.doc_id] for r in rows if r.toxic == 0 and scored[r.doc_id].held_out]
    assert len(marked) >= 40 and all(r.predicted == 1 for r in marked)
    assert len(clean) >= 500 and sum(r.predicted for r in clean) <= 0.04 * len(clean)


def test_toxicity_keeps_clashing_columns(spark, machine, odd_docs):
    docs = odd_docs.withColumn("toxicity_score", F.lit("own")).withColumn("label", F.lit("own"))
    assert toxicity.score(docs, machine[0]).schema["toxicity_score"].dataType.simpleString() == "double"
    kept = toxicity.reject(docs, machine[0])
    assert kept.columns == docs.columns and {r.toxicity_score for r in kept.collect()} == {"own"}
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, toxic int")
    assert len(toxicity.sample(docs.unionByName(docs), labels, key="doc_id", text="text", label="toxic")[0]) == 1  # the other is too long


def test_toxicity_rows(spark, machine, odd_docs, no_docs):
    assert toxicity.score(odd_docs, machine[0]).count() == 10
    assert set(toxicity.score(odd_docs, machine[0]).columns) == {*odd_docs.columns, "toxicity_score"}
    assert toxicity.score(no_docs, machine[0]).count() == 0
    labels = spark.createDataFrame([(1, 0), (1, 1), (4, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    texts, toxic = toxicity.sample(odd_docs, labels, key="doc_id", text="text", label="toxic")
    assert (texts, toxic.tolist()) == (["a b c d e f g h", "one"], [1, 0])
    assert toxicity.learn(odd_docs, labels.limit(0)) is None
    assert {r.toxicity_score for r in toxicity.score(odd_docs, None).collect()} == {0.0}


def test_chunks():
    batch = pa.record_batch({"t": pa.array(["a" * 10, None, "b" * 10, "", "c" * 50])})
    from chronofold.llm.arrow import chunks

    assert [c.num_rows for c in chunks(batch, "t", 15)] == [2, 2, 1]
