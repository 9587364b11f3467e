"""Byte-pair merges, fill-in-middle and importance resampling against brute force, round trips and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from trustframe.llm import bytepairs, infill, resample
from trustframe.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "one", "en", None, 3),
    (5, "same words here again and more", "en", "b", 0), (5, "same words here again and more", "en", "b", 0),
    (None, "same words here again and more", None, "b", 0), (7, "w" * 100_000, "de", "b", 0),
    (8, "Long text of Words " * 5000, "fr", "a", 0), (9, "has <P> in it", "es", "a", 0), (10, "a<S", "es", "a", 0),
    (11, "Ärger 中文 😀\r\n$1 \\ x", "de", "a", 0), (12, "word " * 30, "en", "a", 0), (12, "other " * 30, "en", "a", 0),
]
WHOLE = ["op11_byte_pairs", "op12_fill_in_middle", "op13_resample"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    bench = [(1, "same words here again"), (2, None), (3, "")]
    for kind, keep in (("rows", True), ("empty", False)):
        for name, df in (("documents", spark.createDataFrame(ODD, DOCS)), ("benchmark", spark.createDataFrame(bench, "item_id long, text string"))):
            df.where(F.lit(keep)).write.parquet(f"{root}/{kind}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", WHOLE)
def test_every_row_of_odd_and_empty_tables(spark, odd, name):
    assert QUERIES[name](spark, f"{odd}/rows").count() == len(ODD)
    assert QUERIES[name](spark, f"{odd}/empty").collect() == []


def tables(spark, folders, name):
    return {f: [r.asDict() for r in spark.read.parquet(f"{f}/{name}.parquet").collect()] for f in folders}


# --- byte pairs


@pytest.fixture(scope="module")
def reference():
    known = bytepairs.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return known, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known.ranks, special_tokens={})


def test_byte_pairs_equal_those_of_the_library(spark, odd, small, reference):
    _, library = reference
    for folder in (f"{odd}/rows", small):
        texts = [r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
        ids = [np.array(library.encode_ordinary(t), "<u4") for t in texts]
        want = Counter((len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for x, t in zip(ids, texts, strict=True))
        rows = QUERIES["op11_byte_pairs"](spark, folder).collect()
        assert Counter((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want


def test_merges_of_many_words_at_once(reference):
    known, library = reference
    rnd = random.Random(3)
    words = list({"".join(rnd.choice("abcdeinrst") for _ in range(rnd.randrange(1, 40))) for _ in range(5000)} | {"a" * 3000, "ab" * 2000})
    made = bytepairs.Words(known)
    made.learn(set(words))
    assert all(np.frombuffer(made[w], "<u4").tolist() == library.encode_ordinary(w) for w in words)


def test_a_lower_merge_that_comes_up_goes_first():
    # "yz" (rank 258) brings forth "yz"+"a" (257), which takes its "a" from the other occurrence of "ab" (259)
    ranks = {bytes([b]): b for b in range(256)} | {b"yza": 257, b"yz": 258, b"ab": 259, b"xa": 260}
    known = bytepairs.Vocabulary(ranks)

    def alone(word):
        parts = [bytes([b]) for b in word]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rnd = random.Random(5)
    words = [bytes(rnd.choice(b"xyzab") for _ in range(rnd.randrange(2, 30))) for _ in range(2000)] + [b"yzab", b"yzayzab" * 5]
    got = bytepairs.replay(words, known)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [alone(w) for w in words]


def test_kept_words_are_bounded(reference, monkeypatch):
    known, library = reference
    monkeypatch.setattr(bytepairs, "MOST_KEPT", 1000)
    made = bytepairs.Words(known)
    for i in range(50):
        made.learn({f"qqzx{i}w{j}" for j in range(5)})
        assert len(made) < 40
    assert np.frombuffer(made["qqzx49w1"], "<u4").tolist() == library.encode_ordinary("qqzx49w1")


# --- fill in the middle


def cut_by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_by_hand(spark, odd, small):
    for folder in (f"{odd}/rows", small):
        want = Counter()
        for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
            n, form, p, m, out = cut_by_hand(r.doc_id, r.text)
            want[r.doc_id, n, form, p, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in QUERIES["op12_fill_in_middle"](spark, folder).collect()) == want
    assert {"plain", "psm", "spm"} <= {k[2] for k in want}


def test_fill_in_middle_oracle(spark, odd):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{odd}/rows/documents.parquet/*.parquet'")
    rows = con.execute(infill.OP12_SQL).fetchall()
    assert Counter(rows) == Counter(tuple(r) for r in QUERIES["op12_fill_in_middle"](spark, f"{odd}/rows").collect())


def test_fill_in_middle_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some text here", "mine", 7)], "doc_id long, text string, form string, n int")
    row = infill.fill_in_middle(df).first()
    assert (row["form"], row["n"], row["n_"]) == ("mine", 7, 5) and row["form_"] in ("plain", "psm", "spm")


def test_restore_with_text_that_looks_like_markers(spark):
    texts = [(i, t) for i in range(40) for t in ("a<S b> <P c", "<<<P<S<M>", "x<S$1\\", "\n\n<M\n> y")]
    made = infill.fill_in_middle(spark.createDataFrame(texts, "doc_id long, text string"))
    assert all(r.text == r.back for r in made.withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect())


# --- resampling

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features_by_hand(text):
    words = _WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def draw_by_hand(docs, bench):
    made = [(r["doc_id"], *features_by_hand(r["text"])) for r in docs]
    s = Counter(b for _, _, f in made for b in f)
    t = Counter(b for r in bench for b in features_by_hand(r["text"])[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows = []
    for doc_id, n_words, f in made:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0], r[2]))
    return rows, able[: 25 * len(able) // 100]


def test_resample_by_hand(spark, odd, small):
    for folder in (f"{odd}/rows", small):
        docs, bench = (spark.read.parquet(f"{folder}/{x}.parquet").collect() for x in ("documents", "benchmark"))
        rows, drawn = draw_by_hand(docs, bench)
        got = QUERIES["op13_resample"](spark, folder).collect()
        assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter((a, c, d, e) for a, _, c, d, e in rows)
        ranks = sorted((r["rank"], r.doc_id, r.score) for r in got if r["rank"] is not None)
        assert ranks == [(i, r[0], r[4]) for i, r in enumerate(drawn, 1)]


@pytest.mark.parametrize("k", [1, 2, 37, 500, 999, 1000])
def test_quickselect_with_ties(spark, tmp_path, k):
    rnd = random.Random(k)
    rows = [(rnd.choice([0, 0, 0, 5, -3, 10**12, None]), rnd.choice([None, 1, 2, 3]), i) for i in range(1000)]
    spark.createDataFrame(rows, "score long, doc_id long, tag long").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    order = resample.Order((("score", True), ("doc_id", False), ("tag", False)))
    last = resample.kth_key(table, order, k, 3)
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or 0, r[2]))[:k]
    wins = resample.ranked(table.where(order.key <= last), order, "rank").orderBy("rank").collect()
    assert [(r.score, r.doc_id, r.tag) for r in wins] == want and [r["rank"] for r in wins] == list(range(1, k + 1))


def test_resampled_documents_keep_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("rank", F.lit("mine"))
    out = resample.resampled_documents(docs, spark.read.parquet(f"{small}/benchmark.parquet"))
    assert out.columns == [*docs.columns, "rank_"]
    drawn = QUERIES["op13_resample"](spark, small).where("rank is not null").count()
    assert out.count() == drawn > 0
