"""The training-data operators against brute force, exact round trips and held-out accuracy, with edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framesieve.llm import chat, decontaminate, linear, near_dup, packing, pii, quality, queries, substring, tiff, toxicity, url_filter, words
from framesieve.llm.common import fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: null, empty, blank, short, very long, repeated rows and ties
LONG = " ".join(f"w{i}" for i in range(30_000))
EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three four five six"), (6, LONG), (7, "same text here with some words"), (7, "same text here with some words"), (8, "same text here with some words"), (None, "no id at all for this row"), (9, "Ünïcödé 文字 🙂 text")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def clashing(df):
    """Columns whose names operators use inside."""
    return df.withColumns({c: F.lit(1) for c in ("score", "piece", "length", "key", "anchor", "content", "mask", "page", "matches", "base", "target", "order", "class_id")})


def norm(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(str, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    made, wanted = queries.queries()[name](spark, sf).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert norm(made) == norm(wanted.astype(made[sorted(made.columns)].dtypes.to_dict()))


# 1 -----------------------------------------------------------------------------------------------


def test_url_trie_against_brute_force(spark):
    rng = random.Random(1)
    parts = ["", "a", "ab", "abc", "b"]
    rule = lambda: rng.choice(["com", "x.com", "y.x.com", "net"]) + rng.choice(["", "/" + "/".join(rng.choices(parts, k=rng.randint(1, 3)))])
    allow, block = [rule() for _ in range(12)], [rule() for _ in range(12)]
    trie = url_filter.UrlTrie(allow, block)

    def brute(host, path):
        best = None
        for verdict, r in [("allow", r) for r in allow] + [("block", r) for r in block]:
            h, slash, p = r.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
                rank = (h.count("."), len(slash + p), verdict == "block")
                best = max(best, (rank, r, verdict)) if best else (rank, r, verdict)
        return best and best[1:]

    for _ in range(3000):
        host, path = rng.choice(["com", "x.com", "z.y.x.com", "net", "xcom", ""]), rng.choice(["", "/" + "/".join(rng.choices(parts, k=rng.randint(1, 4)))])
        made = trie.match(host, path)
        assert (made and made[1:]) == brute(host, path)


def test_url_rule_case():
    assert url_filter.UrlTrie([], ["Example.COM/A"]).match("www.example.com", "/Ab")[1:] == ("Example.COM/A", "block")
    assert url_filter.UrlTrie([], ["Example.COM/A"]).match("www.example.com", "/ab") is None


def test_url_edge(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7?x", "http://a.net/de/#f", "x://É.org"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash"))
    rows = {r.page_id: r for r in url_filter.filter_urls(df, queries.ALLOW, queries.BLOCK, ["page_id"]).collect()}
    assert (rows[0].host, rows[0].path, rows[0].rule, rows[0].verdict) == ("", "", None, "allow")
    assert (rows[4].host, rows[4].rule, rows[4].verdict) == ("www.example.com", "com/en/", "block") or rows[4].rule == "example.com/en/7"
    assert rows[4].rule == "example.com/en/7" and rows[5].rule == "net/de/" and rows[6].host == "É.org"
    assert url_filter.filter_urls(df.limit(0), [], [], ["page_id"]).count() == 0


def test_url_rules_in_several_tries(spark, monkeypatch):
    rng = random.Random(3)
    rule = lambda: rng.choice(["com", "x.com", "y.x.com", "net", ""]) + rng.choice(["", "/", "/a", "/a/b", "/ab"])
    allow, block = [rule() for _ in range(15)], [rule() for _ in range(15)]
    df = spark.createDataFrame([(i, rng.choice(["http://z.y.x.com", "s://x.com", "s://net", "s://org", ""]) + rng.choice(["", "/a/b/c", "/abc", "/"])) for i in range(200)], "page_id long, url string").withColumn("__best", F.lit(1))
    whole = sorted(url_filter.filter_urls(df, allow, block, ["page_id", "__best"]).collect())
    monkeypatch.setattr(url_filter, "SHARD_CHARS", 500)
    assert len(url_filter._shards(allow, block)) > 3 and sum(len(a) + len(b) for a, b in url_filter._shards(allow, block)) == 30
    same = lambda rows: [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows]
    assert same(sorted(url_filter.filter_urls(df, allow, block, ["page_id", "__best"]).collect())) == same(whole)


# 2 -----------------------------------------------------------------------------------------------


def tiling(a, b, least=decontaminate.SEED):
    fa, fb, out = [1] * len(a), [1] * len(b), 0
    while True:
        best, found = 0, []
        for i, j in itertools.product(range(len(a)), range(len(b))):
            k = 0
            while i + k < len(a) and j + k < len(b) and fa[i + k] and fb[j + k] and a[i + k] == b[j + k]:
                k += 1
            best, found = (k, [(i, j)]) if k > best else (best, [*found, (i, j)] if k == best else found)
        if best < least:
            return out
        for i, j in found:
            if all(fa[i : i + best]) and all(fb[j : j + best]):
                fa[i : i + best], fb[j : j + best], out = [0] * best, [0] * best, out + best


def test_tiles_against_brute_force():
    for s in range(60):
        r = np.random.default_rng(s)
        b = r.integers(1, 30, 40).astype(np.uint64)
        c = sorted(r.integers(0, 40, 2))
        a = np.concatenate([b[c[1] :], r.integers(50, 60, 4).astype(np.uint64), b[c[0] : c[1]], b[: c[0]]])
        assert sum(k for _, _, k in decontaminate.tiles(a, b)) == tiling(a.tolist(), b.tolist())


def test_decontaminate(spark, docs, sf):
    items = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi."), (2, "too short"), (3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    moved = "prefix words iota KAPPA lambda, mu nu xi omicron pi and then alpha beta gamma delta epsilon zeta eta theta suffix"
    rows = table(spark, [*EDGE, (20, moved), (21, moved.replace("iota", "x").replace("mu", "y").replace("beta", "z").replace("zeta", "q"))])
    found = {r.doc_id: r.matches for r in decontaminate.decontaminate(clashing(rows), bench, ["doc_id"]).collect()}
    assert [m.item_id for m in found[20]] == [1] and found[20][0].coverage == 1.0 and found[21] == [] and found[6] == []
    old, decontaminate.SHARD_CHARS = decontaminate.SHARD_CHARS, 20
    try:  # shard by shard, with repeated items and repeated rows
        several = bench.unionByName(bench.where("item_id = 1").withColumn("item_id", F.lit(9).cast("long")))
        made = decontaminate.decontaminate(clashing(rows).withColumn("__key", F.lit(0)), several, ["doc_id", "__key", "key"]).collect()
        assert len(made) == len(EDGE) + 2 and {r.doc_id: [m for m in r.matches if m.item_id == 1] for r in made} == found
        assert [m.item_id for r in made if r.doc_id == 20 for m in r.matches] == [1, 9]
    finally:
        decontaminate.SHARD_CHARS = old
    assert decontaminate.decontaminate(rows, bench.limit(0), ["doc_id"]).where("size(matches) > 0").count() == 0
    assert decontaminate.decontaminate(rows.limit(0), bench, ["doc_id"]).count() == 0
    word = re.compile(r"[^\W_]+")
    split = lambda t: word.findall((t or "").lower())
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()
    made = {r.doc_id: list(r.item_ids) for r in queries.op2_decontaminate(spark, sf).collect()}
    texts = dict(zip(*docs.toPandas()[["doc_id", "text"]].T.values, strict=True))
    for item, text in zip(benchmark.item_id, benchmark.text, strict=True):
        own = split(text)
        grams = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        for d, t in texts.items():
            w = split(t)
            if len(grams & {tuple(w[i : i + 5]) for i in range(len(w) - 4)}) * 5 < len(own) * 0.1:
                assert item not in made[d]
            elif len(w) < 400:
                assert (item in made[d]) == (tiling(w, own) / len(own) >= 0.5)


# 3 -----------------------------------------------------------------------------------------------


def test_chat(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo"), (1, 1, "bob", "yo"), (1, 2, None, None), (None, None, "cat", "x"), (2, 0, "system", "only")] + [(3, i, "ab"[i % 2], f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.rotate(df.withColumn("speaker", F.lit("clash")).withColumn("chunk", F.lit(0))).collect()
    whole = collections.defaultdict(str)
    for r in sorted(made, key=lambda r: (str(r.conv_id), r.speaker, r.chunk)):
        assert len(whole[r.conv_id, r.speaker]) == r.start and r.n_turns <= chat.CHUNK
        whole[r.conv_id, r.speaker] += r.text
    for r in made:
        text = whole[r.conv_id, r.speaker]
        for s in r.spans:
            assert text[: s.start].endswith("<|assistant|>\n") and text[s.start : s.end].endswith("<|end|>")
        assert r.n_masked == sum(s.end - s.start for s in r.spans)
    assert whole[1, "ann"] == "<|assistant|>\nhi<|end|>\n<|user name=bob|>\nyo<|end|>\n<|user name=unknown|>\n<|end|>\n"
    assert {k for k in whole if k[0] == 1} == {(1, "ann"), (1, "bob"), (1, "unknown")} and (None, "cat") in whole and (2, "system") not in whole
    assert sum(len(r.spans) for r in made if r.conv_id == 3 and r.speaker == "a") == 100
    assert [r.chunk for r in sorted(made, key=lambda r: r.chunk) if r.conv_id == 3 and r.speaker == "a"] == [0, 1, 2, 3]
    old, chat.STRETCH = chat.STRETCH, 2
    try:
        assert sorted(map(str, chat.rotate(df).collect())) == sorted(map(str, made))
    finally:
        chat.STRETCH = old
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:  # chunks don't depend on how rows are dealt
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        assert sorted(map(str, chat.rotate(df).collect())) == sorted(map(str, made))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert chat.rotate(df.limit(0)).count() == 0


# 4, 6 --------------------------------------------------------------------------------------------


def held_out(spark, name, column, folds, rest):
    at = "/root/testdata/sf0.1"
    made = queries.queries()[name](spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id")
    assert made.where(F.col("held_out") != (fold("doc_id", folds) == rest)).count() == 0
    rows = made.where("held_out").select(column, "predicted", "score").toPandas()
    good, bad = rows[rows[column] == 1].score.to_numpy(), rows[rows[column] == 0].score.to_numpy()
    auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    return auc, (rows.predicted == rows[column]).mean(), rows[rows[column] == 1].predicted.mean()


def test_quality_held_out(spark):
    auc, accuracy, recall = held_out(spark, "op6_quality", "quality", 5, 0)
    assert auc > 0.97 and accuracy > 0.97 and recall > 0.97


def test_toxicity_held_out(spark):
    auc, accuracy, recall = held_out(spark, "op4_toxicity", "toxic", 4, 2)
    assert auc > 0.97 and accuracy > 0.97 and recall > 0.8


def test_internal_names(spark):
    """Kept columns may have the names that operators use inside."""
    rows = table(spark, [(1, "a b"), (2, None)]).withColumns({"__text": F.lit("x"), "__content": F.lit("y")})
    keep = ["doc_id", "__text", "__content"]
    weights = np.zeros((1 << quality.BITS) + 1, np.float32)
    for made in (quality.classify(rows, weights, keep), toxicity.votes(rows, np.zeros(0, np.int64), keep), tiff.text_media(rows, keep), tiff.media_features(tiff.text_media(rows, keep), keep), packing.pack(rows, queries.tokenizer_path(), keep), pii.find(rows, keep)):
        assert sorted((r.doc_id, r["__text"], r["__content"]) for r in made.collect()) == [(1, "x", "y"), (2, "x", "y")]


def test_classifier_edges(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    edge = clashing(table(spark, EDGE))
    for weights, module in ((quality.train(docs, labels), quality), (toxicity.train(docs, labels)[0], toxicity)):
        rows = module.classify(edge, weights, ["doc_id"]).collect()
        assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
        by = collections.defaultdict(set)
        for r in rows:
            by[r.doc_id].add(r.score)
        assert by[1] == by[2] == by[3] and by[7] == by[8]
        assert module.classify(edge.limit(0), weights, ["doc_id"]).count() == 0
    none = labels.limit(0)
    assert {r.score for r in quality.classify(edge, quality.train(docs, none), ["doc_id"]).collect()} == {0.5}
    assert toxicity.classify(edge, toxicity.train(docs, none)[0], ["doc_id"]).count() == len(EDGE)


def test_ftrl_against_brute_force():
    """The updates one coordinate at a time, in plain floats."""
    rng = random.Random(6)
    p = linear.Ftrl(alpha=0.2, beta=0.7, l1=0.3, l2=0.5, epochs=3)
    rows = [(sorted(rng.sample(range(8), rng.randint(0, 5))), rng.random()) for _ in range(40)]
    rows = [(index, [rng.choice([1.0, 0.5, 2.0]) for _ in index], target) for index, target in rows]
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= p.l1:
            return 0.0
        return -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for index, value, target in rows:
            x = dict(zip(index, value, strict=True)) | {8: 1.0}
            w = {i: weight(i) for i in x}
            error = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x))) - target
            for i in x:
                g = error * x[i]
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    made = linear.ftrl([(np.array(i, np.int64), np.array(v), t) for i, v, t in rows], 9, p)
    assert made == pytest.approx([weight(i) for i in range(9)]) and any(made)


def test_scores_are_sparse_dot_products(spark):
    weights = np.random.default_rng(3).normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    texts = ["", "One two, two TWO!", "a b c 12 é"]
    made = {r.doc_id: r.score for r in quality.classify(table(spark, list(enumerate(texts))), weights, ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        data = text.encode()
        _, index, value = quality.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        total = float(weights[-1]) + sum(float(weights[k]) * v for k, v in zip(index, value, strict=True))
        assert made[i] == pytest.approx(1 / (1 + math.exp(-total)))


def test_voters(spark):
    seeds = [w for group in toxicity.SEEDS for w in group]
    cases = {
        "what an idiot": {0}, "IDIOT, you moron": {0}, "stupid vermin": {1, 2}, "1d10t": {toxicity.DISGUISED}, "such an idioooot!": {toxicity.DISGUISED}, "$tupid": {toxicity.DISGUISED}, "idiot1234": set(),
        "you are kind": {toxicity.ADDRESSED}, "Vous êtes là": {toxicity.ADDRESSED}, "you. they are": set(), "A BIG LOUD TEXT THAT SHOUTS AND SHOUTS ALL THE TIME": {toxicity.SHOUTED}, "SOME OF the words in CAPITALS ONLY ARE NOT many enough here": set(),
        "no!! no!! no!!": {toxicity.MARKED}, "no!!!!!!": set(), "idiot and idiot": {0, toxicity.REPEATED}, "lovelyx": {toxicity.INDUCED + 1}, "": set(), "clean words": set(),
    }
    data = b"lovelyz"
    index = toxicity.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[1][1]  # its beginning of four bytes
    rows = table(spark, [*enumerate(cases), (90, None)])
    made = {r.doc_id: r["mask"] for r in toxicity.votes(rows, np.array([index]), ["doc_id"]).collect()}
    assert {t: {v for v in range(toxicity.VOTERS) if made[i] >> v & 1} for i, t in enumerate(cases)} == cases and made[90] == 0
    assert all(not toxicity.undisguised(w) for w in seeds)


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    n, k = 40_000, toxicity.VOTERS
    y = rng.random(n) < 0.2
    hit, miss = rng.uniform(0.5, 0.9, k), rng.uniform(0.01, 0.1, k)
    v = rng.random((n, k)) < np.where(y[:, None], hit, miss)
    copied = rng.random(n) < 0.8
    v[copied, 1] = v[copied, 0]  # a correlated pair
    masks, counts = np.unique((v << np.arange(k)).sum(1), return_counts=True)
    model = toxicity.LabelModel(masks, np.full(len(masks), -1), counts.astype(float))
    assert abs(model.prior - 0.2) < 0.02
    assert np.abs(model.accuracy_[1] - v[y].mean(0)).max() < 0.05 and np.abs(model.accuracy_[0] - v[~y].mean(0)).max() < 0.05
    assert model.parent[1] == 0 or model.parent[0] == 1


# 5 -----------------------------------------------------------------------------------------------


def test_suffix_automaton():
    for s in range(40):
        rng = random.Random(s)
        a, ref = substring.SuffixAutomaton(), [[rng.choice("abc") for _ in range(rng.randint(1, 12))] for _ in range(4)]
        for r in ref:
            a.add(r)
        inside = {tuple(r[i:j]) for r in ref for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
        q = [rng.choice("abc") for _ in range(20)]
        for k, (m, _) in enumerate(a.statistics(q)):
            assert m == max(n for n in range(k + 2) if not n or tuple(q[k + 1 - n : k + 1]) in inside)


def test_suffix_automaton_counts():
    for s in range(60):
        rng = random.Random(s)
        a, length = substring.SuffixAutomaton(), rng.randint(1, 5)
        ref = [([rng.choice("abc") for _ in range(rng.randint(1, 14))], rng.choice([1, 1, 1, 3])) for _ in range(3)]
        for words, n in ref:
            a.add(words, n)
        a.count()
        times = collections.Counter()
        for words, n in ref:
            for i in range(len(words) - length + 1):
                times[tuple(words[i : i + length])] += n
        for words in ([w for w, _ in ref] + [[rng.choice("abc") for _ in range(20)]]):
            wanted = {i + k for i in range(len(words) - length + 1) if times[tuple(words[i : i + length])] > 1 for k in range(length)}
            spans = list(a.repeated(words, length))
            assert {k for low, high in spans for k in range(low, high)} == wanted
            assert all(one[1] < two[0] for one, two in itertools.pairwise(spans))


def dedup_brute(rows, length):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = collections.Counter(tuple(w[i : i + length]) for _, w in words for i in range(len(w) - length + 1))
    out = []
    for d, w in words:
        gone = {i + k for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for k in range(length)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((str(d), len(w), len(gone), " ".join(kept)))
    return sorted(out)


def test_substring(spark):
    rng = random.Random(3)
    shared = " ".join(f"s{i}" for i in range(50))
    other = lambda n: " ".join(f"r{rng.random()}" for _ in range(n))
    rows = [*EDGE, (30, other(20) + " " + shared + "\n" + other(5)), (31, shared), (32, other(40) + "\t" + " ".join(shared.split()[:34])), (33, "la " * 200), (34, "a b c " * 40), (35, " ".join(f"é{i}" for i in range(40)) + " x " + " ".join(f"é{i}" for i in range(40)))]
    made = substring.dedup(clashing(table(spark, rows)), ["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in made) == dedup_brute(rows, substring.WINDOW)
    small = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    made = substring.dedup(table(spark, small), ["doc_id"], 6, 3).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in made) == dedup_brute(small, 6)
    assert substring.dedup(table(spark, []), ["doc_id"]).count() == 0


def test_substring_crowded_anchors(spark, monkeypatch):
    """A phrase that many texts share, each followed by words of its own, and half of the texts twice."""
    phrase = " ".join(f"p{i}" for i in range(34))
    rows = [(i, f"{phrase} a{i % 30} b{i % 30} c{i % 30} " + " ".join(f"d{i}_{k}" for k in range(30))) for i in range(60)]
    rows += [(100 + i, " ".join(random.Random(i).choices("ab", k=50))) for i in range(40)]
    wanted = dedup_brute(rows, 35)
    for shard in (3, 1024):
        monkeypatch.setattr(substring, "SHARD", shard)
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in substring.dedup(table(spark, rows), ["doc_id"]).collect()) == wanted
        small = [(i, " ".join(random.Random(i).choices("abc", k=60))) for i in range(40)]
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in substring.dedup(table(spark, small), ["doc_id"], 6, 3).collect()) == dedup_brute(small, 6)


def test_substring_automaton_decides(spark, monkeypatch):
    rows = table(spark, [(1, " ".join(f"w{i}" for i in range(50))), (2, " ".join(f"w{i}" for i in range(50)))])
    assert [r.n_removed for r in substring.dedup(rows, ["doc_id"]).collect()] == [50, 50]
    monkeypatch.setattr(substring, "SuffixAutomaton", type("Blind", (substring.SuffixAutomaton,), {"add": lambda self, words, times: None}))
    assert [r.n_removed for r in substring.dedup(rows, ["doc_id"]).collect()] == [0, 0]


def test_substring_clashing_names(spark):
    rows = table(spark, [(1, "a b"), (2, None)]).withColumns({c: F.lit(c) for c in ("key", "twin", "start", "anchors", "anchor", "digest", "__text", "__key", "marks")})
    keep = ["doc_id", "key", "twin", "start", "anchors", "anchor", "digest", "__text", "__key", "marks"]
    made = sorted(substring.dedup(rows, keep).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.key, r["__text"], r.anchor, r.text) for r in made] == [(1, "key", "__text", "anchor", "a b"), (2, "key", "__text", "anchor", "")]


# 7 -----------------------------------------------------------------------------------------------


def packed_whole(made, capacity):
    bins = collections.defaultdict(list)
    for r in made:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, docs, sf):
    from tokenizers import Tokenizer

    made = queries.op7_bin_slack_packing(spark, sf).collect()
    n = packed_whole(made, 2048)
    total = sum(r.length for r in made)
    assert n <= total / 2048 * 1.01 + 1
    coder = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    by = collections.defaultdict(list)
    for r in made:
        by[r.doc_id].append(r)
    for d, text in zip(*docs.toPandas()[["doc_id", "text"]].T.values, strict=True):
        ids, at = [*coder.encode(text, add_special_tokens=False).ids, 0], 0
        for k, r in enumerate(sorted(by[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    edge = clashing(table(spark, EDGE)).withColumn("__part", F.lit("own"))
    rows = packing.pack(edge, queries.tokenizer_path(), ["doc_id", "lang", "__part"], 16).collect()
    packed_whole(rows, 16)
    assert [r.ids for r in rows if r.doc_id == 1] == [[0]] and len({(r.doc_id, r.piece) for r in rows}) == len(rows) - 1
    assert packing.pack(edge.limit(0), queries.tokenizer_path(), ["doc_id"]).count() == 0


def test_ids_of_plain_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    coder, (encode, forget) = Tokenizer.from_file(path), words.tokenizer(path)
    forget()
    rng = random.Random(5)
    parts = ["ab", "7", "'s", "!", "\u3000", "\x1c", "\u180e", "\x85", "é", "文", "<|endoftext|>", " ", " ", " ", "\n", "\n" * 999, "\r\n" * 1250, " " * 1000, "\t" * 1001]
    texts = ["", " ", " " * 300_000 + "x", "\n" * 300_000, "a" * 100_000, "a " * 50_000, "a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "<|endoftext|", "don't 's 'll x"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(400)]
    wanted = [coder.encode(t, add_special_tokens=False).ids for t in texts]
    assert wanted[6] == [64, 220, 50256, 275]
    monkeypatch.setattr(words, "REMEMBERED", 40)
    for _ in range(2):  # words once new, and then known or forgotten again
        for size in (1, 7, len(texts)):
            made = [x for i in range(0, len(texts), size) for x in encode(pa.array(texts[i : i + size]))]
            assert [x.tolist() for x in made] == wanted
    assert encode(pa.array([], pa.string())) == [] and [x.tolist() for x in encode(pa.array([None, "a"]))] == [[], [64]]


def test_fullest_against_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        stock = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(0, 60)
        every = [c for c in itertools.product(*(range(n + 1) for n in stock.values()))]
        best = max(s for c in every if (s := sum(k * x for k, x in zip(c, stock, strict=True))) <= room)
        use = packing.fullest(stock, room)
        assert sum(k * n for k, n in use.items()) == best and all(use[k] <= stock[k] for k in use)


# 8 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("how", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_tiff_round_trip(how):
    rng = np.random.default_rng(how)
    for predictor, tile, order, kind in itertools.product((1, 2), (None, 16), "<>", (np.uint8, np.uint16)):
        pages = [rng.integers(0, 4, (37, 50), dtype=kind), rng.integers(0, 255, (10, 21, 3), dtype=kind)]
        found = list(tiff.decode(tiff.encode(pages, how, predictor, 8, tile, order)))
        assert [p.error for p in found] == [None, None]
        assert (found[0].data[:, :, 0] == pages[0]).all() and (found[1].data == pages[1]).all()


def test_tiff_known_bytes():
    """Vectors written by hand: the well-known PackBits sample, the LZW sample of codes 256 7 258 8 8 258 6 6 257, and a
    big-endian file with one page of 2 by 3 samples in two strips, horizontally differenced."""
    assert tiff.packbits_decode(bytes.fromhex("feaa0280002afdaa0380002a22f7aa"), 24) == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10)
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    packed = int(bits.ljust(88, "0"), 2).to_bytes(11, "big")
    assert tiff.lzw_decode(packed, 9) == bytes((7, 7, 7, 8, 8, 7, 7, 6, 6))
    tag = lambda number, kind, *values: struct.pack(">HHI", number, kind, len(values)) + (struct.pack(f">{len(values)}{'H' if kind == 3 else 'I'}", *values) + b"\0" * 4)[:4]
    strips = bytes((10, 1, 255)) + bytes((200, 100, 0))  # rows 10 11 10 and 200 44 44
    entries = [tag(256, 3, 3), tag(257, 3, 2), tag(258, 3, 8), tag(259, 3, 1), tag(262, 3, 1), tag(277, 3, 1), tag(278, 3, 1), tag(279, 3, 3, 3), tag(317, 3, 2)]
    offsets = 8 + 2 + 12 * 10 + 4
    entries.insert(5, struct.pack(">HHII", 273, 4, 2, offsets))
    data = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", 10) + b"".join(entries) + struct.pack(">I", 0) + struct.pack(">II", offsets + 8, offsets + 11) + strips
    (page,) = tiff.decode(data)
    assert page.error is None and page.data[:, :, 0].tolist() == [[10, 11, 10], [200, 44, 44]]


def lzw_codes(data):
    """The format's own account of its codes, one step at a time, as bits."""
    table, out, width, prefix = {bytes((i,)): i for i in range(256)}, f"{256:09b}", 9, b""
    for byte in data:
        if prefix + bytes((byte,)) in table:
            prefix += bytes((byte,))
            continue
        out += f"{table[prefix]:0{width}b}"
        table[prefix + bytes((byte,))] = len(table) + 2
        width = {512: 10, 1024: 11, 2048: 12}.get(len(table) + 2, width)  # entry 511, 1023 or 2047 was just added
        if len(table) + 2 == 4095:
            out += f"{256:012b}"
            table, width = {bytes((i,)): i for i in range(256)}, 9
        prefix = bytes((byte,))
    out += f"{table[prefix]:0{width}b}"
    width = {511: 10, 1023: 11, 2047: 12}.get(len(table) + 2, width)
    return out + f"{257:0{width}b}"


def test_lzw_against_its_account():
    for seed, n in ((0, 3), (1, 900), (2, 20_000)):
        data = np.random.default_rng(seed).integers(0, 6, n, np.uint8).tobytes()
        bits = lzw_codes(data)
        assert tiff.lzw_decode(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big"), n) == data


def test_tiff_damage(spark):
    good = tiff.encode([np.zeros((4, 4), np.uint8)], tiff.LZW)
    rng = random.Random(0)
    for _ in range(400):
        bad = bytearray(good)
        for _ in range(rng.randint(1, 4)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        list(tiff.decode(bytes(bad[: rng.randint(0, len(bad))])))
    files = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"II*\0")), (4, bytearray(tiff.encode([np.ones((2, 3), np.uint8)] * 2)))], "id long, content binary").withColumn("page", F.lit(9))
    rows = tiff.pages(files, ["id"]).collect()
    assert sorted((r.id, r.page, r.error is None) for r in rows) == [(1, 0, True), (2, 0, False), (3, 0, False), (4, 0, True), (4, 1, True)]
    assert bytes(next(r.data for r in rows if r.id == 4)) == b"\1" * 6


def test_tiff_text(spark):
    media = tiff.text_media(clashing(table(spark, EDGE)), ["doc_id"])
    rows = tiff.media_features(media, ["doc_id", "n_bytes"]).collect()
    stored = [bytes(r.media) for r in media.collect()]
    wanted = collections.Counter()
    for i, t in EDGE:
        raw = (t or "").encode()
        pay = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        wanted[i, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:])] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == wanted
    assert {hashlib.sha256(s).hexdigest() for s in stored} == {r.media_sha256 for r in rows}
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (7, 8)}) == 1


# 9 -----------------------------------------------------------------------------------------------


def similarity_brute(x, y):
    """Probability Jaccard of two dicts of weights, as it is written."""
    return sum(1 / sum(max(x.get(k, 0) / x[i], y.get(k, 0) / y[i]) for k in x.keys() | y.keys()) for i in x if i in y)


def classes_brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
        sets.append({g: 1 + math.log(n) for g, n in collections.Counter(grams).items()})
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or top(i) != top(j) and len(a.keys() & b.keys()) >= 0.4 * len(a.keys() | b.keys()) and similarity_brute(a, b) >= 0.8 - 1e-9:
            up[top(i)] = top(j)
    out = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        out[top(i)].append(str(d))
    return sorted(sorted(v) for v in out.values())


def classes(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r.class_id].append(str(r.doc_id))
    return sorted(sorted(v) for v in out.values())


def test_near_dup(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert classes(near_dup.near_duplicates(docs).collect()) == classes_brute(rows)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    near = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(120)] = f"n{i}"
        near.append((100 + i, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(60))
    crowd = [(200 + i, passage + " " + " ".join(f"c{i}_{k}" for k in range(12 + i % 9))) for i in range(60)]
    twins = [(300 + i, t + " tail") for i, (_, t) in enumerate(crowd[:10])]
    edge = [r for r in EDGE if r[0] is not None]
    mixed = [*edge, *near, *crowd, *twins]
    assert classes(near_dup.near_duplicates(clashing(table(spark, mixed))).collect()) == classes_brute(mixed)
    kept = near_dup.keep_one(table(spark, mixed)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(min(v, key=int) for v in classes_brute(mixed))
    assert near_dup.near_duplicates(table(spark, [])).count() == 0 and near_dup.keep_one(table(spark, EDGE)).columns == [c.split()[0] for c in DOCS.split(", ")]


def test_near_dup_repeated_lines(spark):
    """A line repeated 50 times weighs as much as nearly five lines do, in the sketch, the prefix filter and the comparison."""
    rows, wanted = [], []
    for i in range(30):
        text, line = " ".join(f"r{i}_{k}" for k in range(84)), f" l{i} m{i} n{i} o{i} p{i}"
        rows += [(4 * i, text), (4 * i + 1, text + line), (4 * i + 2, text + line * 50), (4 * i + 3, text + f" l{i}" + line * 45)]
        wanted += [[str(4 * i), str(4 * i + 1)], [str(4 * i + 2), str(4 * i + 3)]]
    assert classes(near_dup.near_duplicates(table(spark, rows)).collect()) == classes_brute(rows) == sorted(sorted(w) for w in wanted)


def test_similarity_against_its_formula():
    rng = np.random.default_rng(9)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in "ab")
        x, y = (near_dup.weight(rng.integers(1, 4, len(h))) for h in (a, b))
        assert near_dup.similarity(a, b, x, y) == pytest.approx(similarity_brute(dict(zip(a, x, strict=True)), dict(zip(b, y, strict=True))))
        assert near_dup.similarity(a, a, x, x) == pytest.approx(1)


def test_prefix_filter_leaves_out_no_similar_pair(spark, monkeypatch):
    """Without bands only the rare shingles make candidates: all pairs of a crowd are compared that must be."""
    rng = random.Random(4)
    rows = []
    for i in range(12):
        base = [f"x{i}_{k}" for k in range(60)]
        for j in range(6):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(60)
                w[at:at] = w[max(0, at - 7) : at] * rng.randint(0, 3)
            rows.append((10 * i + j, " ".join(w + ["common tail of five words"])))
    signed = near_dup._signed(table(spark, rows)).collect()
    sets = near_dup.materialize(near_dup._shingled(table(spark, rows), spark.createDataFrame([(r.doc_id, r.row, r.content) for r in signed], "doc_id long, row binary, content binary")))
    labels = near_dup.materialize(sets.select("content", F.col("content").alias("label")))
    made = near_dup._compared_rare(near_dup._rare(sets, 0.8), labels, sets, 0.8).collect()
    label = {bytes(r.content): bytes(r.label) for r in made}
    found = collections.defaultdict(list)
    for r in signed:
        found[label[bytes(r.content)]].append(str(r.doc_id))
    assert sorted(sorted(v) for v in found.values()) == classes_brute(rows)


def test_keep_one_by_row(spark):
    words = lambda k: " ".join(f"{k}_{i}" for i in range(20))
    alone = [(None, words(f"n{i}")) for i in range(12)]  # no id, each a class of its own
    rows = [*alone, (None, words("n3")), (1, words("a")), (5, words("a")), (5, words("b")), (None, words("b")), (7, words("c")), (7, words("d")), (7, words("d")), (None, None), (None, "")]
    kept = near_dup.keep_one(table(spark, rows)).collect()
    wanted = [*alone, (1, words("a")), (5, words("b")), (7, words("c")), (7, words("d")), (None, "")]
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted((str(i), t) for i, t in wanted)


def test_probability_minhash():
    rng = np.random.default_rng(0)
    off = []
    for shift in range(0, 100, 5):
        h, w = rng.integers(1, 1 << 63, 400, dtype=np.uint64), 1 + np.log(rng.integers(1, 5, 400))
        doc, ha, wa = np.repeat([0, 1], 300), np.concatenate([h[:300], h[shift : shift + 300]]), np.concatenate([w[:300], w[shift : shift + 300]])
        sig = near_dup.sketch(2, doc, ha, wa)
        one, two = dict(zip(ha[:300], wa[:300], strict=True)), dict(zip(ha[300:], wa[300:], strict=True))
        exact = sum(1 / sum(max(one.get(k, 0) / one[x], two.get(k, 0) / two[x]) for k in {*one, *two}) for x in one if x in two)
        off.append((sig[0] == sig[1]).mean() - exact)
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.06


# 10 ----------------------------------------------------------------------------------------------

#: The contract's patterns as they are written there (fixed values).
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_brute(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            g = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(g) <= 19 and luhn(g), "phone": lambda: 10 <= len(g) <= 15}[kind]():
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def test_pii_base(spark, docs):
    rng = random.Random(2)
    odd = ["a@b.c_d@e.f a@b.c@d.e x.@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 00255.0.0.1 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 4" + "1" * 40, "+1 (743) 555-3824 +1..2 +12345678901234567 +1 234 567 890 ()", "é🙂 x@y.zz 🙂 10.0.0.1", "9" * 5000, "a." * 3000, "+" * 500 + "1 2"]
    rows = [*EDGE, *((100 + i, t) for i, t in enumerate(odd)), *((200 + i, "".join(rng.choice("ab1.@+- ()4🙂_") for _ in range(120))) for i in range(150))]
    made = pii.find(clashing(table(spark, rows)), ["doc_id"]).select("doc_id", pii.written(F.col("base")).alias("b")).collect()
    assert sorted((str(r.doc_id), r.b) for r in made) == sorted((str(i), base_brute(t)) for i, t in rows)
    texts = docs.select("doc_id", "text").collect()
    found = {r.doc_id: r.b for r in pii.find(docs, ["doc_id"]).select("doc_id", pii.written(F.col("base")).alias("b")).collect()}
    assert found == {r.doc_id: base_brute(r.text) for r in texts}


def test_pii_bootstrap(spark):
    known = [(i, f"please write mail me at user{i}@site.com soon, my phone: dial number +1 743 555 {1000 + i} today") for i in range(12)]
    keys = [(30 + i, f'here the token = "{hashlib.sha1(str(i).encode()).hexdigest()}" is set') for i in range(8)]
    fresh = [(50, "hello mail me at user77#hidden9 now"), (51, "the year was 1984x55 and room 12345"), (52, None), (53, 'my TOKEN = "F00DFACE99"!'), (54, f"commit {hashlib.sha1(b'x').hexdigest()}")]
    rows = {r.doc_id: r for r in pii.find(table(spark, known + keys + fresh), ["doc_id"]).withColumn("e", pii.written(F.col("extra"))).withColumn("k", pii.written(F.col("secrets"))).collect()}
    assert rows[50].e == "email:17:31" and rows[51].e == "" and rows[52].e == "" and rows[0].e == ""
    assert rows[30].k == "secret:18:58" and rows[53].k == "secret:12:22" and rows[54].k == "" and rows[30].e == rows[53].e == ""
    masked = {r.doc_id: r.text for r in pii.redact(table(spark, known + keys + fresh)).collect()}
    assert masked[50] == "hello mail me at <email> now" and "<phone> today" in masked[3] and masked[52] is None and masked[51] == fresh[1][1]
    assert masked[53] == 'my TOKEN = "<secret>"!' and masked[31] == 'here the token = "<secret>" is set'
    assert pii.find(table(spark, []), ["doc_id"]).count() == 0


def test_pii_scores_against_brute_force(spark):
    rng = random.Random(4)
    for _ in range(3):
        kinds = {i: rng.choice([-1, -1, 0, 1]) for i in range(40)}
        edges = {(f"p{rng.randrange(12)}", rng.randrange(40)): rng.randint(1, 4) for _ in range(150)}
        fits = {i: 1 << kinds[i] if kinds[i] >= 0 else rng.randrange(4) for i in kinds}
        df = spark.createDataFrame([(p, i, n, kinds[i], fits[i]) for (p, i), n in edges.items()], "pattern string, instance long, n long, kind int, fits int")
        made = {r.pattern: (r.kind, round(r.confidence, 9), r.support) for r in pii.scored(df, 3, 0.45, 2).collect()}
        trusted = {i: k for i, k in kinds.items() if k >= 0 and any(i == j for _, j in edges)}
        for last in (False, False, True):
            confident = {}
            for p in {p for p, _ in edges}:
                of = {i: n for (q, i), n in edges.items() if q == p}
                good, support, kind = max((sum(n for i, n in of.items() if trusted.get(i) == k), sum(trusted.get(i) == k for i in of), k) for k in (0, 1))
                if support >= 2 and good / sum(of.values()) >= 0.45:
                    confident[p] = (kind, round(good / sum(of.values()), 9), support)
            if not last:
                for (p, i), _ in edges.items():
                    if p in confident and kinds[i] < 0 and fits[i] >> confident[p][0] & 1:
                        trusted[i] = max(trusted.get(i, -1), confident[p][0])
        assert made == confident


def test_pii_mask_many(spark, monkeypatch):
    rng = random.Random(3)
    for block in (3, 256):
        monkeypatch.setattr(pii, "BLOCK", block)
        rows = []
        for d in range(30):
            text = "".join(rng.choice("ab é🙂文") for _ in range(rng.randint(0, 60)))
            spans = [(rng.randrange(5), a, rng.randint(a + 1, len(text))) for a in (rng.randrange(len(text)) for _ in range(rng.randint(0, 9)))] if text else []
            rows.append((d, text, spans))
        df = spark.createDataFrame(rows, f"doc_id long, text string, spans {pii.SPAN}")
        for r, (_, text, spans) in zip(df.withColumn("m", pii.mask(F.col("text"), F.col("spans"))).orderBy("doc_id").collect(), rows, strict=True):
            out, at = "", 0
            for k, a, b in sorted(spans, key=lambda s: (s[1], s[0], s[2])):
                if a >= at:
                    out += text[at:a] + f"<{pii.NAMES[k]}>"
                at = max(at, b)
            assert r.m == out + text[at:]


# pipeline ----------------------------------------------------------------------------------------


def test_long_dialogue_sql(spark, tmp_path):
    rows = [(1, i, ["ann", "bob", "system"][i % 3], "é" * (i % 7)) for i in range(150)] + [(2, 0, "bob", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    made, wanted = queries.op3_perspective_rotation(spark, str(tmp_path)).toPandas(), con.sql(queries.oracle_sql()["op3_perspective_rotation"]).df()
    assert len(made) == 7 and norm(made) == norm(wanted.astype(made[sorted(made.columns)].dtypes.to_dict()))


def test_pipeline_stage_edges(spark, sf, tmp_path):
    """Nulls, blanks, repeated ids and rows, very long texts and columns with the names that stages use inside."""
    import corpus_pipeline

    taken = ("score", "predicted", "matches", "__matches0", "__hash", "__row", "__id", "__of", "__key", "row", "base", "extra", "piece", "length", "content", "spans", "__text", "mask")
    full = table(spark, EDGE).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in taken})
    for name, stage in corpus_pipeline.STAGES:
        for docs in (full, full.limit(0)):
            made = stage(spark, docs, sf)
            if name == "packing":
                packed_whole(made.collect(), 2048)
                assert made.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
                continue
            assert made.columns == docs.columns
            before = collections.Counter(map(str, docs.drop("text").collect()))
            after = collections.Counter(map(str, made.drop("text").collect()))
            assert not after - before
            if name in ("decontaminate", "pii"):
                assert after == before
            if name == "near_dup" and before:
                kept = sorted((str(r.doc_id), (r.text or "").strip()[:20]) for r in made.collect())
                assert kept == sorted([("1", ""), ("4", "one"), ("5", "one two three four f"), ("6", LONG[:20]), ("7", "same text here with "), ("None", "no id at all for thi"), ("9", "Ünïcödé 文字 🙂 text")])


def test_steps_are_deleted(spark, sf):
    import os

    import corpus_pipeline
    from framesieve.llm.common import shared_dir

    at = shared_dir(spark).removeprefix("file:")
    left = lambda: {f for f in os.listdir(at) if f.startswith("framesieve-")}
    before = left()
    made = corpus_pipeline.run(spark, sf)
    assert len(left() - before) == 1 and made.count() > 0


def test_pipeline_stages(spark, sf, docs, tmp_path):
    import corpus_pipeline

    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, at, sf)
        made.write.parquet(str(tmp_path / name))
        at = kept[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or at.columns == docs.columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in kept.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in ids["quality"] for d in good) >= 0.97 * len(good)
    rows = [tuple(r) for r in kept["quality"].select("doc_id", "text").collect()]
    assert ids["near_dup"] == {min(map(int, c)) for c in classes_brute(rows)}
    bad = {r.doc_id for r in decontaminate.decontaminate(kept["near_dup"], spark.read.parquet(f"{sf}/benchmark.parquet"), ["doc_id"]).where("size(matches) > 0").collect()}
    assert ids["decontaminate"] == ids["near_dup"] - bad
    assert ids["pii"] == ids["decontaminate"] and all(base_brute(r.text) == "" for r in kept["pii"].collect())
    assert ids["packing"] == ids["pii"]
    packed_whole(kept["packing"].collect(), 2048)
    assert corpus_pipeline.run(spark, sf).count() == kept["packing"].count()
