"""Apportionment with binding caps, ties of votes, the bounded sample, and near-copy search among shared passages."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustframe.llm import common, jaccard, mixing, quality


def apportion(votes, seats, most):
    """Seats one by one to the highest quotient, smaller unit first."""
    got = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if got[i] < most[i] and votes[i] > 0]
        if not open_:
            break
        best = min(open_, key=lambda i: (-votes[i] / (2 * got[i] + 1), i))
        got[best] += 1
    return got


def test_seats_with_binding_caps(spark):
    rnd = random.Random(5)
    cases = [([1000, 1, 1, 1], 40, [20] * 4), ([0, 0, 5], 4, [9, 9, 9]), ([3, 3], 9, [2, 2]), ([7], 0, [3]), ([10, 1], 3, [0, 9])]
    for _ in range(40):
        n = rnd.randrange(1, 9)
        cases.append(([rnd.choice([0, 1, 7, 50, 1000, rnd.randrange(1, 300)]) for _ in range(n)], rnd.randrange(0, 120), [rnd.choice([0, 1, 5, 30, 200]) for _ in range(n)]))
    rows = [(g, i, float(v), s, m) for g, (votes, s, most) in enumerate(cases) for i, (v, m) in enumerate(zip(votes, most))]
    df = spark.createDataFrame(rows, "g int, i int, votes double, seats long, most long")
    for out in ("mine", "q", "S"):
        made = mixing.sainte_lague(df, ["g"], ["i"], F.col("votes"), F.col("seats"), F.col("most"), out)
        got = {(r.g, r.i): r[out] for r in made.collect()}
        for g, (votes, seats, most) in enumerate(cases):
            assert [got[g, i] for i in range(len(votes))] == apportion(votes, seats, most), (g, votes, seats, most)


@pytest.mark.parametrize("size", [20, 65, 300])
def test_votes_break_ties_by_row(size):
    rng = np.random.default_rng(size)
    known = rng.choice([-1.0, 0.0, 1.0], size=(size, 3))
    known /= np.maximum(np.linalg.norm(known, axis=1, keepdims=True), 1e-12)
    labels = rng.integers(0, 2, size).astype(float)
    x = rng.choice([-1.0, 0.5, 1.0], size=(40, 3))
    got = quality.vote(x, np.eye(3), known, labels)
    z = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    for row, score in zip(z @ known.T, got):
        top = sorted(range(size), key=lambda i: (-row[i], i))[: min(quality.NEIGHBOURS, size)]
        w = np.maximum(row[top], 1e-6) ** 8
        assert score == pytest.approx(float((w * labels[top]).sum() / w.sum()), rel=1e-9)


@pytest.mark.parametrize("most", [10_000, 1])
def test_sample_is_the_same_by_either_join(spark, monkeypatch, most):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 7 == 0, None).otherwise("usual").alias("kind"), F.lit(1).alias("n"))
    monkeypatch.setattr(common, "MOST_CLASSES", most)
    got = Counter(r.kind for r in common.bounded_sample(df, "kind", 400, ["id"]).collect())
    assert got["rare"] == 300 and 300 < got["usual"] < 500 and set(got) == {"rare", "usual"}


def test_a_passage_of_many_unlike_documents_makes_few_pairs(spark, monkeypatch):
    rnd = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(30))
    own = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    texts = [f"{own(6)} {passage} {own(6)}" for _ in range(500)]
    texts += [texts[0] + " tail", texts[1] + " tail", texts[1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = []
    keep = jaccard.Verifier.links
    monkeypatch.setattr(jaccard.Verifier, "links", lambda self, p: (pairs.append(p.count()), keep(self, p))[1])
    got = {r.doc_id: r.component_id for r in jaccard.near_components(docs).collect()}
    assert {d for d, c in got.items() if d != c} == {500, 501, 502} and (got[500], got[501], got[502]) == (0, 1, 1)
    assert sum(pairs) < 5000


def near_copies(seed, n):
    """Copies of one text with 0 to 16 words replaced, some of them in the same places, and a few that continue another copy."""
    rnd = random.Random(seed)
    base = [f"b{i}" for i in range(230)]
    texts = [list(base)]
    for _ in range(n):
        own = list(base if rnd.random() < 0.8 else texts[rnd.randrange(len(texts))])
        for _ in range(rnd.randrange(17)):
            own[rnd.randrange(len(base))] = f"x{rnd.randrange(10**6) if rnd.random() < 0.7 else rnd.randrange(30)}"
        texts.append(own)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_outsiders_of_a_group_of_near_copies_make_few_pairs(spark, monkeypatch, seed):
    texts = near_copies(seed, 240)
    sets = [{tuple(t[k : k + 4]) for k in range(len(t) - 3)} for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 85 * len(a | sets[j]) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    pairs = []
    keep = jaccard.Verifier.links
    monkeypatch.setattr(jaccard.Verifier, "links", lambda self, p: (pairs.append(p.count()), keep(self, p))[1])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_components(docs).collect()}
    assert got == {i: find(i) for i in range(len(sets))} and 20 < len(set(got.values())) < 240
    assert sum(pairs) < 10 * len(sets), pairs  # of 28,920


def test_new_words_of_some_texts_are_encoded_at_once(monkeypatch):
    import public_tokenizers

    from trustframe.llm import tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    rnd = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEÀÉßöÿÑ" + ".,;!#" + "'0½_ªİ\x85\x0b<|>/"
    texts = [" ".join("".join(rnd.choice(letters[: rnd.choice([26, 37, 42, len(letters)])]) for _ in range(rnd.randrange(1, 12))) for _ in range(60)) for _ in range(40)]
    texts += ["", " ", "</w> a", "a<|endoftext|>b", "x" * 3000, "à̀ é"]
    encoder = tokens._Encoder(path)
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    learned = []
    keep = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda new: (learned.append(len(new)), keep(new))[1])
    assert [ids.tolist() for ids in encoder.encode(texts)] == want == [ids.tolist() for ids in encoder.encode(texts)]
    assert len(learned) == 1 and learned[0] > 1000
    # a model that marks no end of a word is asked word by word
    encoder = tokens._Encoder(path)
    encoder.ends = np.zeros_like(encoder.ends)
    assert [ids.tolist() for ids in encoder.encode(texts)] == want


def test_slices_of_texts_are_cut_and_gathered_by_arrow(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    from trustframe.llm import tokens

    rnd = random.Random(5)
    signs = ["a", "Z", "É", "ß", "ÿ", "×", "İ", "K", "'s", "1", " ", "  ", "\n", "\t", "\r", "\x0b", "　", ".", ",!", "-", "<|endoftext|>", "日本", "the", "\x00", "|"]
    texts = ["", None, *("".join(rnd.choice(signs) for _ in range(rnd.randrange(40))) for _ in range(2000)), "long " * 500]
    column = pa.array(texts, pa.string())
    monkeypatch.setattr(tokens, "SLICE", 4000)
    bounds = list(tokens.slices(column))
    assert len(bounds) > 10 and [b for b, _ in bounds] == [0, *(e for _, e in bounds[:-1])] and bounds[-1][1] == len(texts)
    encoder = tokens._Encoder(public_tokenizers.path("word_bpe_49k.json"))
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for most in (tokens.MOST_KEPT, 300):
        monkeypatch.setattr(tokens, "MOST_KEPT", most)
        got, kept = [], []
        for begin, end in bounds:
            got += [ids.tolist() for ids in encoder.encode(column[begin:end].fill_null(""))]
            kept.append(len(encoder.words))
        assert got == want and len(set(encoder.words.to_pylist())) == kept[-1]
        assert (sorted(kept) == kept) == (most > 300)
    assert encoder.encode([]) == [] and tokens.gather(np.arange(9), np.array([7, 0, 3]), np.array([2, 0, 4])).tolist() == [7, 8, 3, 4, 5, 6]


def test_a_worker_gives_back_what_a_partition_freed():
    import re
    from pathlib import Path

    from trustframe.llm import common

    held = lambda: int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) >> 10
    pins, during = [], []

    def work(batches):
        made = [bytes(800) for _ in range(150_000)]
        pins.extend(made[::1000])  # else the allocator shrinks by itself
        for batch in batches:
            yield batch
        during.append(held())

    assert list(common.releasing(work)(iter([1, 2, 3]))) == [1, 2, 3] and len(pins) == 150
    assert held() < during[0] - 60
