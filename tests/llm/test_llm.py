"""Operators of the training-data subpackage against brute force, round trips, held-out rows and edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trustframe.llm import chat, decontaminate, jaccard, language, mixing, quality, sharding, tokens, topk, toxicity
from trustframe.llm.queries import QUERIES, SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs, empty and very long texts, ties, repeated rows and NULL keys."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "one", "en", None, 3),
        (5, "same words here again and more", "en", "b", 0), (5, "same words here again and more", "en", "b", 0),
        (None, "same words here again and more", None, "b", 0), (7, "w" * 200_000, "de", "b", 0),
        (8, "long text of words " * 5000, "fr", "a", 0), (9, "!!! 123 ###", "es", "a", 0),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    """A folder of tables: the odd documents, and one of empty tables."""
    root = tmp_path_factory.mktemp("odd")
    labels = spark.createDataFrame([(5, 1, 0), (8, 0, 1), (9, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "same words here again"), (2, None), (None, "x"), (3, "")], "item_id long, text string")
    vectors = spark.createDataFrame([(0, [1.0, 0.5], 1), (50, [1.0], 1), (1, None, 1), (2, [float("nan"), 1.0], 0), (3, [1.0, 0.5], 0), (None, [1.0, 1.0], 0)],
                                    "vec_id long, embedding array<float>, label int")
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "a\\b <s>[INST] <|x|>\n"), (1, 1, None, "t"), (None, None, "user", "")],
                                  "conv_id long, turn long, role string, text string")
    for kind, keep in (("rows", True), ("empty", False)):
        for name, df in (("documents", odd), ("labels", labels), ("benchmark", bench), ("embeddings", vectors), ("conversations", turns)):
            df.where(F.lit(keep)).write.parquet(f"{root}/{kind}/{name}.parquet")
    return root


@pytest.mark.parametrize("name", sorted(QUERIES))
@pytest.mark.parametrize("kind", ["rows", "empty"])
def test_odd_and_empty_tables(spark, folder, name, kind):
    rows = QUERIES[name](spark, f"{folder}/{kind}").collect()
    whole = name not in ("op2_decontaminate", "op5_top_k", "op8_format_chat")
    assert not whole or len(rows) == (10 if kind == "rows" else 0)


def test_oracles(spark, small):
    con = duckdb.connect()
    for table in ("embeddings", "conversations", "documents"):
        con.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    for name, sql in SQL.items():
        cur = con.execute(sql)
        columns = [d[0] for d in cur.description]
        assert sorted(cur.fetchall()) == sorted(tuple(r) for r in QUERIES[name](spark, small).select(*columns).collect()), name


def test_shards(spark, small):
    rows = QUERIES["op1_shuffle_shards"](spark, small).collect()
    again = QUERIES["op1_shuffle_shards"](spark, small).collect()
    assert sorted(rows, key=str) == sorted(again, key=str)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(by) == 16 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_hypergeometric_inversion_agrees_with_numpy(monkeypatch):
    want = [sharding.hypergeometric(np.random.default_rng(i), 300, 700, 100) for i in range(3000)]
    monkeypatch.setattr(sharding, "NUMPY_MOST", 0)
    got = [sharding.hypergeometric(np.random.default_rng(i), 300, 700, 100) for i in range(3000)]
    assert abs(np.mean(want) - np.mean(got)) < 0.4 and abs(np.std(want) - np.std(got)) < 0.3
    left = [5, 0, 3]
    assert sum(sharding.draw_row(np.random.default_rng(0), left, 8)) == 8 and left == [0, 0, 0]


def test_shuffle_keeps_columns(spark):
    df = spark.range(100).select("id", F.lit("x").alias("shard"), F.lit(1).alias("chunk"), F.lit(2).alias("row_tag"))
    out = sharding.shuffle_into_shards(df, 7)
    assert out.columns == ["id", "chunk", "row_tag", "shard", "slot"] and out.select("id").distinct().count() == 100


def test_mix_takes_targets(spark, small):
    rows = QUERIES["op4_mix_sources"](spark, small).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    size = lambda t: len(WORDS.findall(t or ""))
    by, held = Counter(), Counter()
    for r in rows:
        assert r.size == size(docs[r.doc_id].text) and 0 <= r.taken <= 3 * r.size
        by[docs[r.doc_id].source] += r.taken
        held[docs[r.doc_id].source] += r.size
    names = sorted(held)
    weight, cap, target, open_ = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {s: 3 * held[s] for s in names}, {}, set(names)
    while True:
        left = sum(held.values()) - sum(target.values())
        full = {s for s in open_ if weight[s] * left / sum(weight[x] for x in open_) > cap[s]}
        if not full:
            break
        target.update((s, cap[s]) for s in full)
        open_ -= full
    target.update({s: weight[s] * left / sum(weight[x] for x in open_) for s in open_})
    for r in rows:
        assert r.target == pytest.approx(target[docs[r.doc_id].source])
    for s in names:
        assert abs(by[s] - target[s]) <= max(3, 0.01 * target[s])


def test_sainte_lague_is_by_highest_quotients(spark):
    rng = np.random.default_rng(3)
    votes = [float(v) for v in rng.integers(1, 1000, 40)]
    units = spark.createDataFrame(list(enumerate(votes)), "u int, v double")
    got = {r.u: r.seats for r in mixing.sainte_lague(units, [], ["u"], F.col("v"), F.lit(137), F.lit(50), "seats").collect()}
    want = Counter({i: 0 for i in range(40)})
    for _ in range(137):
        want[max(range(40), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
    assert got == dict(want)


def test_chat_round_trip(spark, folder):
    out = {r.conv_id: r for r in QUERIES["op8_format_chat"](spark, f"{folder}/rows").collect()}
    said = "user\n\n\nt\nassistant\na\\b <s>[INST] <|x|>\n\n"
    assert out[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and out[1].n_turns == 3
    assert out[1].loss_chars == len("a\\b <s>[INST] <|x|>\n") and out[-1].n_turns == 2 and out[None].n_turns == 1
    texts = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "\\\\<s>", "[[INST]", "<<|", "<<SYS>>x<</SYS>>", "<\\/s>\\"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u and not re.search(chat.CONTROL, r.e) for r in rows)


def test_layouts(spark):
    records = spark.createDataFrame([
        ('{"messages":[{"content":"hi","role":"user"},{"role":"assistant","content":"yo"}],"x":1}',), ('{"response":"b","prompt":"a"}',), ("oops",), (None,),
        ('{"conversations":[{"from":"human","value":"q"},{"value":"r","from":"gpt"}]}',)], "record string")
    got = [(r.layout, [(t.role, t.text) for t in r.turns or []]) for r in chat.with_turns(records).collect()]
    assert got == [(None, []), ("prompt and response", [("user", "a"), ("assistant", "b")]), (None, []), (None, []),
                   ("conversations", [("user", "q"), ("assistant", "r")])]
    assert chat.unmapped_records(chat.with_turns(records)).count() == 3


def test_decontamination(spark):
    item = "Yesterday Tom bought 15 red apples and 4 kg of flour for Anna while it was raining over the old market square"
    bench = spark.createDataFrame([(1, item), (2, "short one here")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Some words before. " + item + " and some after."), (2, item.replace("Tom", "Bob").replace("15", "27").replace("Anna", "Lisa")),
        (3, "Nothing of the kind stands in this document at all, it is about Bob and 27 apples."), (4, None), (5, ""), (6, item.upper()),
        (7, "so a short one here it is")], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.find_leaks(docs, bench).collect()}
    assert found == {(1, 1): False, (2, 1): True, (6, 1): False, (7, 2): False}
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()) == [3, 4, 5]


def test_decontamination_of_items_with_few_literals(spark):
    items = [
        "What is 12 + 7?", "Compute 3 * 4 + 5 = 17.", "Wer war Kanzler?", "Die Hauptstadt Österreichs heißt Wien.",
        "Paris, Berlin, Madrid, Rome, Vienna, Lisbon, Athens, Dublin", "2 4 8 16 32 64 128 256 512",
        "Tom Ann Bob Eve Max Kim Lea Jan Ben Mia Leo Zoe went to the old market square and bought 3 kg of 4 8 15 16 23 42"]
    other = [
        "What is 19 + 5?", "Compute 2 * 9 + 6 = 24.", "Wer war Minister?", "Die Hauptstadt Frankreichs heißt Paris.",
        "Oslo, Bern, Prague, Warsaw, Sofia, Zagreb, Riga, Tallinn", "3 9 27 81 243 729 2187 6561 19683"]
    changed = "Tim Amy Rob Ada Sam Kit Liv Jon Bea Mae Lou Zac went to the old market square and bought 5 kg of 7 9 13 18 25 47"
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    # the last: the few literal tokens of an item in another text
    texts = ["some words, then " + x + " and more" for x in items] + [x.lower() for x in items[:6]] + other + [changed, "they went to the old market square"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.item_id): (r.covered, r.total, r.reparameterised) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(found) == {(i, i) for i in range(7)} | {(7 + i, i) for i in range(6)} | {(19, 6)}
    assert all(c == n == max(1, len(decontaminate.templates(items[i])[0]) - 5) for (_, i), (c, n, _) in found.items() if i != 6)
    assert found[6, 6] == (24, 24, False) and found[19, 6] == (24, 24, True)
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()) == [13, 14, 15, 16, 17, 18, 20]


def test_language_model_sums_all_segmentations():
    names = ["a", "b", "ab", "▁", "▁a", "abb"]
    pieces, table = language.Pieces(names), np.array([[0.1], [0.2], [0.3], [0.05], [0.15], [0.2], [1e-7]])

    def brute(word):
        return sum((table[names.index(word[:n])][0] if word[:n] in names else 1e-7 if n == 1 else 0) * brute(word[n:]) for n in range(1, len(word) + 1)) if word else 1.0

    words = ["▁abb", "▁", "ab", "cab", "▁abab"]
    assert np.allclose(np.exp(language.log_scores(pieces, words, table))[:, 0], [brute(w) for w in words])
    counts = language.expected_counts(pieces, ["ab"], np.array([1.0]), table[:, 0])
    assert counts[2] == pytest.approx(0.3 / 0.32) and counts[0] == pytest.approx(0.02 / 0.32)


def held_out(spark, small, name, truth):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    return QUERIES[name](spark, small).join(docs.drop("text").join(labels, "doc_id", "left"), "doc_id").where("held_out").where(F.col(truth).isNotNull()).collect()


def test_held_out_accuracy(spark):
    # sf0.1: the smaller tables hold too few toxic documents of some languages to learn from
    folder = "/root/testdata/sf0.1"
    rows = held_out(spark, folder, "op3_language_id", "lang")
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    for name, truth in (("op7_quality", "quality"), ("op10_toxicity", "toxic")):
        rows = held_out(spark, folder, name, truth)
        assert all(0 <= r.score <= 1 for r in rows) and sum(r[truth] == r.predicted for r in rows) >= 0.95 * len(rows), name


def test_levenshtein_trie():
    terms = ["idiot", "stupid", "grand*"]
    trie = toxicity.Trie(terms)
    one_edit = lambda w: {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) if j <= len(w) for c in ["", *"abdiotx"]} | {w[:i] + w[i + 1] + w[i] + w[i + 2:] for i in range(len(w) - 1)}
    for number, term in enumerate(terms[:2]):
        for word in one_edit(term):
            assert trie.near(word) == number and (trie.may_be_near(word) or word == term), word
    assert trie.near("idi") == -1 and trie.near("idaatx") == -1 and trie.exact("grandiose") == 2 and trie.exact("gran") == -1
    matcher = toxicity.Matcher(terms)
    assert matcher["1d10t!"] == 1 and matcher["idoit"] == -1 and matcher["words"] == 0
    plain, quoted = (toxicity.features(t, matcher, [1.0, 1.0, 1.0]) for t in ("you are an idiot", 'he "is an idiot" she'))
    assert plain[0] > 0 and plain[1] == 0 and quoted[0] == 0 and quoted[1] > 0


def test_misspelled_stems_and_short_terms():
    terms = ["grand*", "achlich*", "boor", "smug*"]
    matcher = toxicity.Matcher(terms)
    one_edit = lambda w: {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) if j <= len(w) for c in ["", *"abchlxz"]} | {w[:i] + w[i + 1] + w[i] + w[i + 2:] for i in range(len(w) - 1)}
    for number, stem in enumerate(("grand", "achlich")):
        for typo in one_edit(stem):
            for word in (typo, typo + "er", typo + "zzezizo"):
                assert abs(matcher[word]) == number + 1, word
    assert matcher["boro"] == matcher["obor"] == -3 and matcher["b00r"] == 3
    assert matcher["msugly"] == matcher["smgu"] == -4
    # a word that starts as a usual one of other documents is no misspelled stem
    usual = toxicity.Matcher(terms, frozenset(["granite", "grani*", "granit*"]))
    assert usual["granite"] == usual["granitic"] == 0 and usual["granditic"] == 1 and usual["gramditic"] == -1
    assert matcher["gxaxd"] == 0 and matcher["bxor"] == 0 and matcher["achxxch"] == 0


def test_terms_of_a_minor_group(spark):
    # 12 of 1,200 toxic documents have terms of their own, each in 10 of them
    rng = np.random.default_rng(3)
    usual = ["".join(rng.choice(list("abcdefghijklm"), 7)) for _ in range(300)]
    text = lambda *more: " ".join([*rng.choice(usual, 30), *more])
    rows = [(text("zzgrumpf"), 1) for _ in range(1188)] + [(text("qurvandel" if i > 1 else "", "wostrek" if i < 10 else ""), 1) for i in range(12)]
    rows += [(text(), 0) for _ in range(4800)]
    terms, rates = toxicity.learn_terms(spark.createDataFrame(rows, "text string, toxic int"))
    trie = toxicity.Trie(terms)
    assert all(trie.exact(w) >= 0 for w in ("zzgrumpf", "qurvandel", "wostrek")) and min(rates) > 2
    assert not any(trie.exact(w) >= 0 for w in usual)


def test_votes_follow_the_nearest():
    known = np.eye(3)
    labels = np.array([1.0, 0.0, 0.0])
    assert quality.vote(np.array([[5.0, 0.1, 0.0]]), np.eye(3), known, labels)[0] > 0.9
    assert quality.features(None)[-1] == 1 and quality.features("a b")[:-1].any()


def test_shapes_of_whole_chunks():
    start = "aB0/" * 16
    one, two = (quality.features(start + end)[: quality.SHAPES] for end in ("aB0/aB0/", "--==--=="))
    assert one.any() and two.any() and (one != two).any()


def test_top_k_with_ties_and_copies(spark):
    rng = np.random.default_rng(0)
    rows = [[int(x) for x in v] for v in rng.integers(-300, 300, (400, 5))] + [[7, 7, 7, 7, 7]] * 300
    vectors = spark.createDataFrame(list(enumerate(rows)), "vec_id long, vec array<long>")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    got = sorted(tuple(r) for r in topk.top_k(vectors, queries).collect())
    x = np.array(rows)
    want = []
    for q in range(0, 700, 50):
        order = sorted((i for i in range(700) if i != q), key=lambda i: (-int(x[q] @ x[i]), i))[:5]
        want += [(q, n + 1, i, int(x[q] @ x[i])) for n, i in enumerate(order)]
    assert got == sorted(want)


def test_wavelet_matrix():
    ids = np.random.default_rng(1).integers(0, 900, 3000) ** 2 % 49409
    shard = tokens.WaveletMatrix.from_bytes(tokens.WaveletMatrix.build(ids, np.array([0]), np.array([5]), np.array([True])).to_bytes())
    assert (shard.decode() == ids).all() and all(shard.access(i) == ids[i] for i in range(0, 3000, 37))
    for token in set(ids[:20].tolist()):
        at = np.flatnonzero(ids == token)
        assert shard.count(token) == len(at) and shard.count(token, 100, 2000) == ((at >= 100) & (at < 2000)).sum()
        assert [shard.occurrence(token, k) for k in range(len(at) + 1)] == [*at.tolist(), -1]
    assert shard.count(5) == (ids == 5).sum()


def test_token_files(spark, folder, small):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoder = tokens._Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("  a\t\tb\r\nc", "İstanbul ΣΑΣ ς", "x<|endoftext|>y", "é é́ ́a", "a\x1cb\x85c\xa0d　e", "it's I'M don't 12 $%^", "", "Ä.B!c¿", "日本語"):
        assert encoder.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    rows = sorted(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op6_wavelet_tokens"](spark, small).collect()}
    start = 0
    for r in rows:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[r.doc_id] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def brute_components(rows, width, percent):
    lower = {c: c + 32 for c in range(65, 91)}
    sets, roots, holders = {}, {}, defaultdict(list)
    for i, text in rows:
        w = WORDS.findall((text or "").translate(lower))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        roots[i] = i

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in holders[s])
        for s in sets[i]:
            holders[s].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                roots[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "RARE", 3)
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 220)]
    rows = []
    for i in range(60):  # a group of near copies, all tokens frequent
        own = list(base)
        for at in rng.integers(0, 220, int(rng.integers(0, 9))):
            own[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(f"y{x}" for x in rng.integers(0, 10**6, 40)) + " " + " ".join(base[:60])) for i in range(20)]
    rows += [(200, "a b c d e f g h i j"), (201, "A b c d e f g h i j"), (202, "a b c d e f g h i j k"), (203, "a b"), (204, "a  b"), (205, ""), (206, None)]
    for width, percent in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()}
        assert got == brute_components(rows, width, percent)


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean = corpus_pipeline.toxicity(spark, docs, small)
    assert clean.columns == docs.columns and 0.7 * len(texts) < clean.count() <= len(texts)
    single = corpus_pipeline.near_duplicates(spark, docs, small)
    want = {root for _, root in brute_components(sorted(texts.items()), 5, 80).values()}
    assert {r.doc_id for r in single.collect()} == want and single.columns == docs.columns
    free = corpus_pipeline.decontamination(spark, docs, small)
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert {r.doc_id for r in free.collect()} == {i for i, t in texts.items() if not any(x in (t or "") for x in items)}
    mixed = corpus_pipeline.mixing(spark, docs, small)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.select("doc_id").collect()} <= set(texts)
    out = corpus_pipeline.run(spark, small)
    assert out.columns == [*docs.columns, "shard", "slot"] and out.count() > 0


def test_one_of_each_handles_odd_rows(spark, odd):
    # equal texts of a repeated and of a NULL id are one group; NULL and blank texts all stay
    assert sorted(str(r.doc_id) for r in jaccard.one_of_each(odd).collect()) == ["1", "2", "3", "4", "5", "7", "8", "9"]
