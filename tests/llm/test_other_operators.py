from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from weftline.llm import ann_search, components, queries, source_mixing, url_filters

SF = "/root/testdata/sf0.001"


def test_urls_equal_brute_force(spark):
    urls = [None, "", "no scheme", "http://a.COM/x", "http://com", "https://www.example.com/en/1", "https://Shop.Example.com/en/?q", "http://example.com/fr/", "http://x.net/es/a#b", "http://xnet/es/", "http://a.net/fr", "http://net/fr/#", "ftp://h.org/ads/banner?x", "http://h.org/click/track?x", "http://h.org/?utm_campaign=spam", "http://h.org/a?page=2&ref=x", "http://example.org/en/?page=2&ref=x", "a://b://c/d", "http://É.com/x", "http://h.org/x\ny?z", "http://h.org/login", "http://h.org/loginx"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, host string")
    got = url_filters.filter_urls(df).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [url_filters.brute_force(u) for u in urls + urls[:3]]
    assert url_filters.filter_urls(df.filter("false")).count() == 0
    clash = df.toDF("c1", "c0", "__url").withColumn("fit", F.lit(1)).withColumn("__rule", F.lit("a")).withColumn("Rule", F.lit("b"))
    made = url_filters.filter_urls(clash, "c0").orderBy("c1").collect()
    assert made[0].__fields__ == ["c1", "c0", "__url", "fit", "__rule", "host", "path", "rule", "verdict"] and all(r["__rule"] == "a" and r["__url"] == "mine" for r in made)
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in made] == [url_filters.brute_force(u) for u in urls + urls[:3]]


def test_urls_equal_the_sql(spark):
    import duckdb

    urls = ["http://a.org/login", "http://a.org/login\n", "http://a.org/login\r\n", "http://a.org/login?", "http://a.org/robots.txt\n", "http://a.org/x?print=1\n", "http://a.org/pixel.gif", None, "http://x.casino.y/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    pages = df.toArrow()
    want = duckdb.sql(url_filters.oracle()).order("page_id").fetchall()
    assert pages.num_rows == len(urls) and [tuple(r) for r in url_filters.filter_urls(df).drop("url").orderBy("page_id").collect()] == want


def test_rules_are_filed_under_rare_tokens(spark):
    rules = (url_filters.PatternRule("r", "block", "/common/rare", ("common", "rare")), url_filters.PatternRule("s", "block", "/common/none", ("common", "none")))
    df = spark.createDataFrame([("http://a/common/x",), ("http://a/common/rare",)], "url string")
    assert url_filters.rarest_tokens(df, "url", rules) == {"r": "rare", "s": "none"}
    assert [r["verdict"] for r in url_filters.filter_urls(df, pattern_rules=rules).collect()] == ["allow", "block"]


def test_pfair_deviates_by_less_than_one_block():
    for shares in ({"a": 1}, {"a": 5, "b": 3, "c": 1}, {"a": 97, "b": 2, "c": 1}, {f"s{i}": 1 + i % 4 for i in range(23)}):
        slots, total, seen = source_mixing.pfair_slots(shares), sum(shares.values()), Counter()
        assert Counter(s for s, _ in slots) == shares
        for t, (s, block) in enumerate(slots, 1):
            assert block == seen[s]
            seen[s] += 1
            assert all(abs(seen[x] - t * w / total) < 1 for x, w in shares.items())


def test_mixing_equals_plain_scheduling(spark):
    rng = np.random.default_rng(6)
    rows = [(i if i % 9 else None if i % 2 else 7, None if i % 13 == 0 else f"s{int(rng.integers(0, 4)) ** 2}") for i in range(400)]
    shares = {"s0": 6, "s1": 3, "s4": 9}
    df = spark.createDataFrame(rows, "doc_id long, source string")
    for default in (1, 3):  # 3: a common divisor
        got = Counter((*r,) for r in source_mixing.mix_sources(df, shares, default, block_rows=3).collect())
        assert got == Counter((*r, *at) for r, at in zip(rows, source_mixing.brute_force(rows, shares, default, 3), strict=True))
    assert source_mixing.planned({"a": 2_000_000, "b": 1_000_000}) == ({"a": [0, 1], "b": [2]}, 3)


def test_mixing_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", i, -i, "r", i, 2.0 * i) for i in range(50)], "doc_id long, source string, `key` int, hash int, `range` string, __hash long, `at` double")
    out = source_mixing.mix_sources(df)
    assert out.columns == [*df.columns, "slot", "block", "place"] and sorted(map(tuple, out.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    again = source_mixing.mix_sources(out)
    assert again.columns == out.columns and sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_mixing_keeps_every_row(spark, docs, empty):
    rows = docs.unionByName(docs)
    mixed = source_mixing.mix_sources(rows, {"src0": 3}, block_rows=2)
    assert mixed.count() == rows.count()
    out = mixed.orderBy("slot", "place").collect()
    assert len({(r["slot"], r["place"]) for r in out}) == len(out)
    by_slot = {}
    for r in out:
        by_slot.setdefault(r["slot"], set()).add(r["source"])
    assert all(len(s) == 1 for s in by_slot.values())
    for source, n in Counter(r["source"] for r in out).items():
        own = sorted((r["block"], r["place"]) for r in out if r["source"] == source)
        assert own == [(i // 2, i % 2) for i in range(n)]
    assert source_mixing.mix_sources(empty).count() == 0
    ordered = source_mixing.mixed_order(docs)
    assert ordered.columns == docs.columns and sorted(map(str, ordered.collect())) == sorted(map(str, docs.collect()))


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(3000, 32)).astype(np.float32)
    vectors[1] = vectors[0] * 2
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    odd = [(3000, None, "x"), (3050, [0.0] * 32, "x"), (3100, [float("nan")] * 32, "x"), (3150, [None] + [1.0] * 31, "x"), (3200, [1.0], "x"), (None, [1.0] * 32, "x"), (3250, [], "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score string")
    got = ann_search.nearest(df, df.filter("vec_id % 50 = 0")).collect()
    want = ann_search.brute_force(np.arange(3000), vectors.astype(float))
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert found.keys() == want.keys() and all(sorted(f) == [1, 2, 3, 4, 5] for f in found.values())
    hits = sum(len({v for v, _ in found[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want) and found[0][1] == (1, 1.0) or abs(found[0][1][1] - 1) < 1e-12
    assert ann_search.nearest(df.filter("false"), df.filter("false")).count() == 0
    few = df.filter("vec_id < 3")
    assert [r["vec_id"] for r in ann_search.nearest(few, few.filter("vec_id = 0")).orderBy("rank").collect()] == [i for i, _ in ann_search.brute_force(np.arange(3), vectors[:3].astype(float))[0]]


def test_neighbours_in_sets_of_queries_and_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(1500, 6)), 1)
    vectors[100:130] = vectors[50]  # ties: equal rows of many ids
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 50 = 0")
    monkeypatch.setattr(ann_search, "QUERY_BYTES", 400)
    monkeypatch.setattr(ann_search, "BLOCK_ROWS", 130)
    got, want = {}, ann_search.brute_force(np.arange(1500), vectors)
    for r in ann_search.nearest(df, asked).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[q]) & {v for v, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)
    assert got[50] == [100, 101, 102, 103, 104] and got[100] == [50, 101, 102, 103, 104]


def test_large_groups_of_equal_vectors(spark, monkeypatch):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(4000, 24))
    copies = np.sort(rng.permutation(4000)[:1500])
    vectors[copies] = vectors[copies[0]] * rng.choice([1.0, 2.0, 3.0, 0.7], size=(1500, 1))  # equal and parallel
    ids = np.arange(4000) + 1
    twice = int(ids[copies[0]])
    own = [(twice, vectors[copies[0]].tolist())] * 12  # an id many times
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)] + own, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann_search, "BLOCK_ROWS", 500)
    asked = [twice, *ids[copies[[3, 700, 1400]]].tolist()]
    got = {}
    for r in ann_search.nearest(df, df.filter(F.col("vec_id").isin(asked)).dropDuplicates(["vec_id"])).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    least = sorted([*ids[copies].tolist(), *[twice] * 12])
    assert got == {q: [i for i in least if i != q][:5] for q in asked}


def test_scores_do_not_depend_on_neighbours_in_a_block():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(500, 33))
    v[100:137] = v[0]
    v[200:230] = v[0] * rng.choice([2.0, 0.25, 8.0], size=(30, 1))
    alone = np.array([ann_search.cosines(x[None], v[0])[0] for x in v])
    assert (ann_search.cosines(v, v[0]) == alone).all() and (alone[100:137] == 1.0).all() and (alone[200:230] == 1.0).all()
    for block in (500, 120, 17):
        ids = best = None
        for s in range(0, 500, block):
            ids, best = ann_search.Block(np.arange(s, min(s + block, 500)), v[s : s + block]).search(0, v[0], 5, ids, best)
        assert ids.tolist() == [100, 101, 102, 103, 104] and (best == 1.0).all()


def test_recall_on_clustered_vectors_and_ids_as_text(spark, monkeypatch):
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(40, 64))
    vectors = (centres[rng.integers(0, 40, 4000)] + 0.2 * rng.normal(size=(4000, 64))).astype(np.float32)
    monkeypatch.setattr(ann_search, "BLOCK_ROWS", 900)
    df = spark.createDataFrame([(f"v{i:05d}", v.tolist(), i) for i, v in enumerate(vectors)], "`vec.id` string, embedding array<float>, query_id int")
    got = {}
    for r in ann_search.nearest(df, df.filter("query_id % 50 = 0"), vec_id="vec.id").collect():
        got.setdefault(int(r["query_id"][1:]), set()).add(int(r["vec_id"][1:]))
    want = ann_search.brute_force(np.arange(4000), vectors.astype(float))
    assert sum(len(got[q] & {v for v, _ in want[q]}) for q in want) >= 0.95 * 5 * len(want)


def test_the_tree_finds_all_leaves_in_reach():
    rng = np.random.default_rng(8)
    points = rng.normal(size=(3000, 4))
    tree = ann_search.KdTree(points, 16)
    assert sorted(np.concatenate(tree.leaves)) == list(range(3000))
    for q in rng.normal(size=(20, 4)):
        found, far = tree.within(q, 0.5)
        inside = set(np.concatenate([tree.leaves[i] for i in found])) if len(found) else set()
        assert set(np.flatnonzero(((points - q) ** 2).sum(1) <= 0.5)) <= inside and (np.diff(far) >= 0).all()
        assert tree.home(q) in tree.within(q, np.inf)[0]


def test_stopping_ratio():
    draws = (np.random.default_rng(1).normal(size=(20_000, ann_search.DIMS)) ** 2).sum(1)
    assert abs((draws <= ann_search.stopping_ratio(0.9)).mean() - 0.9) < 0.01


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(50, 51), (51, 50), (60, 60), (70, 90), (80, 90)]
    df = spark.createDataFrame(edges, "u long, v long")
    roots = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    assert all(roots[i] == 0 for i in range(41)) and (roots[51], roots[90], roots[80]) == (50, 70, 70) and 60 not in roots
    assert components.connected_components(df.filter("false")).count() == 0


def test_stars_are_split_between_tasks(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_EDGES", 5)
    rng = np.random.default_rng(2)
    edges = [(500, i) for i in range(300)] + [(int(a), int(b)) for a, b in rng.integers(600, 900, (200, 2))]
    root = {i: i for i in {x for e in edges for x in e}}
    for _ in range(2000):
        after = dict(root)
        for a, b in edges:
            after[a] = after[b] = min(after[a], after[b])
        if after == root:
            break
        root = after
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in root.items() if k not in alone}


def test_registered_queries():
    names = set(__spark_entry__.queries())
    assert set(queries.queries()) | {"pipeline"} <= names and {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in queries.queries()}
    assert set(queries.oracle_sql()) <= names


def test_the_mixture_reaches_the_pipelines_result(spark, monkeypatch):
    before = spark.read.parquet(f"{SF}/documents.parquet")
    shares = {"src0": 1, "src1": 7}
    monkeypatch.setattr(source_mixing, "SHARES", shares)
    out = {r["doc_id"]: (r["slot"], r["place"]) for r in corpus_pipeline.run(spark, SF).collect()}
    kept = before.filter(F.col("doc_id").isin(list(out)))
    place = lambda s: {r["doc_id"]: (r["slot"], r["place"]) for r in source_mixing.mix_sources(kept, s).collect()}
    assert out == place(shares) != place({}) and len(set(out.values())) == len(out)


def test_pipeline_stages_follow_their_decisions(spark):
    from weftline.llm import arrowtext, bpe_codec, jaccard_join, secret_scan, toxicity

    import public_tokenizers

    before = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in before.collect()}
    model = toxicity.learn_from_tables(spark, SF, before)
    clean = {i for i, r in rows.items() if model.score([r["text"] or ""])[0] < toxicity.TOXIC_AT}
    classes = jaccard_join.brute_force({i: rows[i]["text"] for i in clean})
    kept = {i for i, (c, _) in classes.items() if c == i}
    library = bpe_codec.Vocabulary(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    want = {}
    for i in kept:
        text, parts, at = rows[i]["text"], [], 0
        for _, s, e in secret_scan.brute_force(text):
            if s >= at:
                parts += [text[at:s], "[secret]"]
            at = max(at, e)
        want[i] = len(library.encode("".join([*parts, text[at:]]), add_special_tokens=False).ids)
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in out} == want and len(out) == len(want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "secret_scans", "mixing_sources", "bpe_codec"]
    assert arrowtext.shared_folder(spark).startswith("file:") and before.filter(F.col("doc_id").isNull()).isEmpty()
