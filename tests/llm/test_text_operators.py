import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weftline.llm import arrowtext, bpe_codec, jaccard_join, language_id, quality_rules, secret_scan, token_counts, toxicity


def by_text(df, *columns):
    return {r["text"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_held_out_split(spark):
    rows = spark.range(200).select("id", arrowtext.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


# ---------------------------------------------------------------- secrets
def test_trigram_queries_are_necessary_conditions():
    holds = lambda q, s: True if q is True else q[1] in s if q[0] == "tri" else (all if q[0] == "and" else any)(holds(x, s) for x in q[1])
    for pattern, matches in ((r"(foo|barn)[0-9]+x?", ["foo1", "barn22x"]), (r"a(bc)?def", ["adef", "abcdef"]), (r"(?:ab){2,}c", ["ababc"]), (r"[xy]yz.*end", ["xyz..end", "yyzend"])):
        for s in matches:
            assert holds(secret_scan.trigram_query(pattern), s)
    assert secret_scan.trigram_query("[0-9a-f]+") is True and secret_scan.trigram_query("a?b?") is True
    assert not holds(secret_scan.trigram_query(r"(foo|barn)[0-9]+"), "nothing")


def test_secrets_equal_brute_force(docs, empty, texts):
    found = by_text(secret_scan.scan_secrets(docs), "secret_spans")
    for t in texts:
        assert [(s["kind"], s["start"], s["end"]) for s in found[t][0]] == secret_scan.brute_force(t)
    assert secret_scan.scan_secrets(docs).count() == docs.count() and secret_scan.scan_secrets(empty).count() == 0
    rng = random.Random(1)
    bits = ["password", "=", ": ", "'", "API_KEY", "apikey", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "ghp_", "x" * 40, " ", "é", "eyJ", ".", "-----BEGIN RSA PRIVATE KEY-----"]
    many = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    got = secret_scan.Scanner().scan(pa.array(many))
    assert [[(secret_scan.RULES[k].kind, s, e) for s, k, e in x] for x in got] == [secret_scan.brute_force(t) for t in many]


def test_redaction_keeps_everything_else(docs):
    clean = secret_scan.redact_secrets(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    joined = " ".join(r["text"] or "" for r in clean.collect())
    assert "hunter2222" not in joined and "[secret]" in joined and all(not secret_scan.brute_force(r["text"]) for r in clean.collect())


# ---------------------------------------------------------------- near-duplicates
def test_jaccard_equals_brute_force(spark, docs, empty):
    rows = docs.collect()
    got = jaccard_join.near_duplicates(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    want = jaccard_join.brute_force({r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None})
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == want
    assert jaccard_join.near_duplicates(docs).count() == docs.count() and jaccard_join.near_duplicates(empty).count() == 0


def test_hot_groups_are_dealt_in_blocks(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    rows = []
    for i in range(70):
        words = list(base)
        words[rng.randrange(120)] = f"z{i % 50}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(30))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # two more families in the buckets of the first, near its copies and not
    for f, changed in ((200, 14), (300, 60)):
        other = [w if k >= changed else f"y{f}-{k}" for k, w in enumerate(base)]
        rows += [(f + i, " ".join([*other[:50], f"q{i}", *other[51:]])) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = jaccard_join.brute_force(dict(rows))
    kept = sorted(i for i, (c, _) in want.items() if c == i)
    for block in (8, 1024):
        got = jaccard_join.near_duplicates(df, block=block).collect()
        assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == want
        assert sorted(r["doc_id"] for r in jaccard_join.keep_one_of_each(df, block=block).collect()) == kept


def test_large_groups_that_no_pivot_reaches(spark):
    """A chain: neighbours are near copies, distant ones are not."""
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = jaccard_join.brute_force(dict(rows))
    for block, limit in ((6, jaccard_join.BLOCK_BYTES), (1024, 4_000)):  # blocks by nodes, and by bytes
        before, jaccard_join.BLOCK_BYTES = jaccard_join.BLOCK_BYTES, limit
        try:
            assert sorted(r["doc_id"] for r in jaccard_join.keep_one_of_each(df, block=block).collect()) == sorted(i for i, (c, _) in want.items() if c == i) == [0]
        finally:
            jaccard_join.BLOCK_BYTES = before


def test_one_document_of_each_class_stays(docs):
    kept = jaccard_join.keep_one_of_each(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    want = jaccard_join.brute_force({r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None})
    assert kept.columns == docs.columns and ids.count(None) == 1
    assert sorted(i for i in ids if i is not None) == sorted(i for i, (c, _) in want.items() if c == i)


def test_classes_without_own_ids_stay_apart(spark):
    rng = random.Random(12)
    text = lambda: " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(40))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (None, b + " tail"), (1, c), (1, d), (1, d), (2, d), (3, e), (None, e), (3, f), (None, None), (3, "")]
    kept = jaccard_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = [(r["doc_id"], r["text"]) for r in kept]
    chosen = [x for x in got if x in [(None, b), (None, b + " tail")]]  # one class of three rows without an id
    assert len(chosen) == 1
    assert sorted(map(str, got)) == sorted(map(str, [(None, a), *chosen, (1, c), (1, d), (3, e), (3, f), (None, None), (3, "")]))


def test_pruning_bounds():
    least = jaccard_join.least_matches(0.8, 1e-6)
    assert least[0] == 0 and all(a <= b for a, b in zip(least, least[1:], strict=False)) and least[63] < 0.8 * 63
    # the posterior's tail by numerical integration
    n, m = 63, least[63]
    x = np.linspace(0, 1, 200_001)
    density = x**m * (1 - x) ** (n - m)
    assert density[x >= 0.8].sum() / density.sum() >= 1e-6 * 0.99


# ---------------------------------------------------------------- language
LINES = {"aa": "kiki lalo meru", "bb": "stro grund welt", "cc": "oua ien tion"}


def test_language_on_held_out_rows(spark, empty):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(LINES[g].split()) for _ in range(rng.randint(2, 40))), g) for i, g in enumerate(rng.choices(list(LINES), k=400))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(df.filter(~arrowtext.held_out("doc_id")))
    out = language_id.identify_languages(df, model).filter(arrowtext.held_out("doc_id")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out) and all(0 <= r["score"] <= 1 for r in out)
    odd = [None, "", "123 !?", "\u0660\u0661", "kiki"]
    names, scores = model.predict(odd)
    assert names == ["und"] * 4 + ["aa"] and scores[:4].tolist() == [0] * 4
    assert model.predict(["kiki lalo"])[1][0] == model.predict(["x", "kiki lalo", "y" * 999])[1][1]  # neighbours don't matter
    assert language_id.learn(empty).predict(["abc"])[0] == ["und"]


def test_rare_languages_are_learned_from_large_tables(spark):
    rng = random.Random(14)
    say = lambda g: " ".join(rng.choice(LINES[g].split()) for _ in range(20))
    df = spark.createDataFrame([(i, say(g), g) for i, g in enumerate(["aa"] * 3000 + ["bb"] * 1000 + ["cc"] * 2)], "doc_id long, text string, lang string")
    model = language_id.learn(df, rows=40)
    assert model.languages == ["aa", "bb", "cc"] and model.predict([say("cc"), say("bb"), say("aa")])[0] == ["cc", "bb", "aa"]


def test_language_scores_equal_plain_sums():
    rng = np.random.default_rng(0)
    model = language_id.LanguageModel(["a", "b"], rng.normal(size=(language_id.BINS, 2)).astype(np.float32), np.zeros(2))
    texts = ["", "a", "ab", "Abcé", "x" * 1000]
    for t, got in zip(texts, model.scores(texts), strict=True):
        bins, _, _ = language_id.character_bins([t])
        want = sum((model.log_probs[b[: max(0, len(t) - k + 1)]].astype(float).sum(0) for k, b in zip(language_id.SIZES, bins, strict=True)), np.zeros(2))
        assert got == pytest.approx(want, abs=1e-6)


# ---------------------------------------------------------------- quality
def test_quality_counts_equal_brute_force(docs, empty, texts):
    out = quality_rules.judge_quality(docs, quality_rules.QualityModel(None))
    got = by_text(out, *quality_rules.COUNTS, "base_failed", "kept")
    for t in texts:
        want = quality_rules.brute_force(t)
        assert got[t] == (*[want[c] for c in quality_rules.COUNTS], want["base_failed"], not want["base_failed"])
    assert out.count() == docs.count() and quality_rules.judge_quality(empty, quality_rules.QualityModel(None)).count() == 0
    rng = random.Random(4)
    for _ in range(200):
        many = ["".join(rng.choice(["a ", "b ", "a b c d e ", "\n", "\n\n", "é", "#", "\t", ""]) for _ in range(rng.randint(0, 20))) for _ in range(5)]
        m = quality_rules.Measured(pa.array(many))
        assert [{c: int(getattr(m, c)[i]) for c in quality_rules.COUNTS} for i in range(5)] == [{k: v for k, v in quality_rules.brute_force(t).items() if k != "base_failed"} for t in many]


def test_quality_learns_and_calibrates(spark, empty):
    rng = random.Random(6)
    good, bad = ["calm", "river", "letter", "morning"], ["zzqx", "##", "buy!!", "wqk"]
    rows = [(i, " ".join(f"{rng.choice(good if y else bad)}{rng.randint(0, 9)}" for _ in range(30)), y) for i, y in enumerate(rng.choices([0, 1], k=300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    train = df.filter(~arrowtext.held_out("doc_id"))
    model = quality_rules.learn(train, train.withColumnRenamed("y", "quality").drop("text"))
    out = quality_rules.judge_quality(df.filter(arrowtext.held_out("doc_id")), model).collect()
    assert sum(r["kept"] == bool(r["y"]) for r in out) >= 0.97 * len(out)
    assert quality_rules.learn(empty, train.withColumnRenamed("y", "quality").drop("text")).weights is None
    # ids as text, and one id many times
    named = train.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    many = named.unionByName(named.filter("doc_id = 'd1'").crossJoin(spark.range(50).select()))
    again = quality_rules.learn(many, named.withColumnRenamed("y", "quality").drop("text"))
    assert (again.probability(quality_rules.Measured(pa.array(["calm1 river2 letter3 " * 9, "zzqx1 ##2 buy!!3 " * 9]))) >= quality_rules.KEEP_AT).tolist() == [True, False]


def test_quality_features_in_slices(monkeypatch):
    rng = random.Random(16)
    texts = pa.array(["".join(rng.choice("abé中😀 \n") for _ in range(rng.randint(0, 60))) for _ in range(40)])
    model = quality_rules.QualityModel(np.random.default_rng(1).normal(size=(quality_rules.PARTS, quality_rules.BINS)).astype(np.float32))
    whole, rows = model.raw(quality_rules.Measured(texts)), quality_rules._sparse_rows(quality_rules.Measured(texts))
    monkeypatch.setattr(quality_rules, "SLICE", 7)
    assert model.raw(quality_rules.Measured(texts)) == pytest.approx(whole)
    assert [x.tolist() for x, _ in quality_rules._sparse_rows(quality_rules.Measured(texts))] == [x.tolist() for x, _ in rows]
    assert whole == pytest.approx([model.weights.ravel()[x] @ v for x, v in rows], abs=1e-5)
    # each text by itself, and as many n-grams as its characters give
    assert whole == pytest.approx([model.raw(quality_rules.Measured(texts.slice(i, 1)))[0] for i in range(40)])
    made = [(part, int(np.diff(offsets)[0])) for part, _, offsets in quality_rules.Measured(pa.array(["aé中😀b" * 4])).features()]
    assert sum(n for p, n in made if p == 2) == 18 and sum(n for p, n in made if p == 3) == 16


# ---------------------------------------------------------------- tokens
def test_token_counts_equal_the_library(docs, empty, texts):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    out = token_counts.count_tokens(docs, path)
    got = by_text(out, "n_bytes", "n_tokens")
    for t in texts:
        assert got[t] == (len((t or "").encode()), len(library.encode(t or "")))
    assert out.count() == docs.count() and token_counts.count_tokens(empty, path).count() == 0
    rng = random.Random(7)
    bits = ["a", " ", "  ", "\n", "\t", "▁", "the", "é", "😀", "<s>", "<unk>", "<0x0A>", "\u3000", "1", "\r\n", "\0"]
    many = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    assert token_counts.PieceCounter(path).count(many) == [len(x) for x in library.encode(many)]


def test_proved_strings_are_single_tokens():
    counter = token_counts.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"))
    assert counter.cuts_hold and len(counter.single) > 25_000
    for s in random.Random(8).sample(sorted(counter.single), 300):
        ids = counter.model.encode("\n" + s)
        assert len(ids) - len(counter.model.encode("\n")) == 1


# ---------------------------------------------------------------- BPE
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_transducer_numbers_its_words(tmp_path):
    words = sorted({"a", "ab", "abc", "talk", "talked", "talking", "walk", "walked", "walking", "été", "中"}, key=lambda w: w.encode())
    arrays = bpe_codec.compile_lexicon([w.encode() for w in words])
    arrays |= {"first": np.arange(len(words) + 1), "ids": np.arange(len(words))}
    (tmp_path / "l").write_bytes(bpe_codec.lexicon_bytes(arrays))
    lexicon = bpe_codec.Lexicon(str(tmp_path / "l"))
    assert lexicon.find([w.encode() for w in words]).tolist() == list(range(len(words)))
    assert lexicon.find([b"", b"tal", b"talke", b"abcd", b"zz"]).tolist() == [-1] * 5 and lexicon.ids_of(3) == [3]
    # talk- and walk- share their suffixes
    assert len(arrays["base"]) < sum(len(w.encode()) for w in words) / 2


def digests(ids, decoded):
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_encoding_and_decoding_equal_the_library(spark, docs, empty, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    out = bpe_codec.encode_decode(docs, PATH)
    got, hashed = by_text(out, "ids", "decoded"), by_text(bpe_codec.encode_digests(docs, PATH), *bpe_codec.DIGEST.names)
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[t] == (ids, library.decode(ids, skip_special_tokens=False))
        assert hashed[t] == digests(*got[t])
    assert out.count() == docs.count() and bpe_codec.encode_digests(empty, PATH).count() == 0
    # odd strings, and code points of all planes, assigned or not
    rng = random.Random(9)
    bits = ["a", "B", " ", "\n", "İ", "Σ", "e\u0301", "😀", "<|endoftext|>", "<|End", "\x1c", "\x85", "中文", "1", "²", "'s", "'LL", "...", "don't", "ǅ", "\0", "क्षि", "<|", "|>"]
    many = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 10))) for _ in range(4000)]
    points = [*rng.sample([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], 3000), *range(0x80, 0x600), 0x58B, 0x88F, 0xC5C, 0x1C89, 0x180E, 0x200B, *range(0x2000, 0x200B)]
    many += [f"a{chr(c)}b {chr(c)}{chr(c)}1{chr(c)}!{chr(c)}\u0301x" for c in points]
    made = bpe_codec.encode_digests(spark.createDataFrame([(t,) for t in many], "text string"), PATH, words=["a", "the"]).collect()
    for r in made:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert tuple(r[1:]) == digests(ids, library.decode(ids, skip_special_tokens=False)), repr(r["text"])


def test_long_texts_are_worked_on_in_parts(monkeypatch):
    text = "".join(random.Random(3).choice(["word ", "don't\n", "\x1c", "é\u0301", "  ", "<|endoftext|>"]) for _ in range(3000))
    whole = list(bpe_codec.pieces(text))
    monkeypatch.setattr(bpe_codec, "SEGMENT", 100)
    parts = list(bpe_codec.pieces(text))
    assert len(whole) == 1 and len(parts) > 20 and [p for x in parts for p in x] == whole[0]


def test_files_that_cut_otherwise_are_refused():
    with pytest.raises(ValueError):
        bpe_codec.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


# ---------------------------------------------------------------- toxicity
def test_automaton_equals_edit_distance():
    terms, stems, clean = ["idiot", "moron", "scum"], ["worth"], ["motor"]
    automaton = toxicity.build_automaton(terms, stems, clean)

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        edits = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abcdefghijklmnopqrstuvwxyz"} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "abcdefghijklmnopqrstuvwxyz"} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        return b in edits

    rng = random.Random(10)
    words = {"idiot", "Idiots", "idoit", "moorn", "moron", "scum", "scam", "worthless", "worth", "motor", "xmoron"}
    for _ in range(3000):
        w = list(rng.choice(terms + stems))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randint(0, 1)] = rng.choice(["", rng.choice("abcdeimnorstuw")])
        words.add("".join(w))
    for word in words - {""}:
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        found = automaton.hits(codes)
        low = word.lower()
        want = low not in clean and (low in terms or (low.startswith("worth") and len(low) >= 5) or any(len(t) >= 5 and near(t, low) for t in terms))
        assert (len(found[0]) > 0) == want, word


def test_context_separates_quotation():
    abuse, quoted = "you are an idiot!", 'he said the word "idiot" again'
    at = [s.index("idiot") for s in (abuse, quoted)]
    assert toxicity.context(abuse, at[0], at[0] + 5, 0) == 1.0 and toxicity.context(quoted, at[1], at[1] + 5, 0) < 0.5


def test_toxicity_on_held_out_rows(spark, docs, empty):
    rng = random.Random(11)
    calm, bad = [f"word{k}" for k in range(60)], ["idiot", "moron", "disgusting", "worthless"]
    rows = []
    for i in range(600):
        y = int(i % 5 == 0)
        words = [rng.choice(calm) for _ in range(30)] + (rng.sample(bad, 2) if y else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), y))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").filter(~arrowtext.held_out("doc_id"))
    model = toxicity.learn(df, labels)
    out = toxicity.score_toxicity(df, model, spans="hits").filter(arrowtext.held_out("doc_id")).collect()
    assert all((r["score"] >= toxicity.TOXIC_AT) == bool(r["toxic"]) for r in out)
    assert all(r["text"][h["start"] : h["end"]].startswith(h["term"][:4]) for r in out for h in r["hits"] if h["distance"] == 0)
    assert model.score(["you idoit, what a mooron, you are disgustnig"])[0] > model.score(["calm words"])[0]
    scored = toxicity.score_toxicity(docs, model)
    assert scored.count() == docs.count() and scored.filter("score is null or score < 0 or score > 1").isEmpty()
    assert toxicity.score_toxicity(empty, model).count() == 0
    named = toxicity.learn(df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    assert (named.score(["calm you idiot moron", "calm words"]) >= toxicity.TOXIC_AT).tolist() == [True, False]
    none = toxicity.learn(df, labels.filter("toxic = 0"))
    assert none.score(["idiot", ""]).tolist() == [0, 0]


def test_rare_short_and_stem_terms(spark):
    rng = random.Random(13)
    calm, rows = [f"calm{k}" for k in range(40)], []
    for i in range(6000):
        bad = [] if i % 2 else ["vilesnout"] if i % 200 == 0 else [rng.choice(["scum", "idiot", "moron"]), f"grobian{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}"]
        rows.append((i, " ".join(rng.sample(calm, 8) + bad), 1 - i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df, df.select("doc_id", "toxic"))
    scores = model.score(["calm1 calm2 vilesnout", "calm1 skum scmu scun", "calm1 gorbianzz grobbianqq grbianxx", "calm1 calm2"])
    assert (scores >= toxicity.TOXIC_AT).tolist() == [True, True, True, False], scores


def test_arrow_columns_replace_clashing_names(docs):
    out = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert out.columns == [c for c in docs.columns if c != "n_tokens"] + ["n_bytes", "n_tokens"]
    assert out.filter(F.col("n_tokens").isNull()).isEmpty()
