"""The compiled trie and automaton against a table of edit distances; bounds of the toxicity operator."""

import random

from pyspark.sql import functions as F

from trustframe.llm import toxicity


def distance(a, b):
    """Insertions, deletions, replacements and swaps of neighbours."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def by_hand(terms, word, usual):
    found = []
    for i, term in enumerate(terms):
        text, stem = term.rstrip("*"), term.endswith("*")
        if len(text) < toxicity.LEAST_FUZZY:
            swaps = {text[:k] + text[k + 1] + text[k] + text[k + 2 :] for k in range(len(text) - 1) if text[k] != text[k + 1]}
            if (word[: len(text)] in swaps if stem else word in swaps) and word[:4] + "*" not in usual:
                found.append(i)
        elif stem:
            sizes = range(len(text) - 1, min(len(word), len(text) + 1) + 1)
            if word[: len(text)] + "*" not in usual and any(distance(word[:k], text) <= 1 for k in sizes):
                found.append(i)
        elif distance(word, text) <= 1:
            found.append(i)
    return min(found, default=-1)


def test_automaton_equals_edit_distances():
    rnd = random.Random(3)
    draw = lambda low, high: "".join(rnd.choice(letters) for _ in range(rnd.randrange(low, high)))
    hits = 0
    for turn in range(200):
        letters = "abc" if turn % 2 else "abcdefgh"
        terms = list({draw(2, 9) + rnd.choice(["", "*"]) for _ in range(rnd.randrange(1, 25))})
        usual = frozenset(draw(3, 8) + "*" for _ in range(4))
        trie = toxicity.Trie(terms)
        for _ in range(40):
            word = list(rnd.choice(terms).rstrip("*") + draw(0, 3))
            for _ in range(rnd.randrange(3)):
                k = rnd.randrange(len(word) + 1)
                word[k : k + rnd.randrange(2)] = rnd.choice(["", rnd.choice(letters)])
            word = "".join(word)
            if word:
                want = by_hand(terms, word, usual)
                hits += want >= 0
                # terms of one swapped form under five letters keep the first of them, so numbers may differ there only
                got = trie.near(word, usual)
                assert len(word) < 4 or trie.may_follow(word[:4]) or (got < 0 and trie.exact(word) < 0)
                assert (got >= 0) == (want >= 0) and (got == want or len(terms[want].rstrip("*")) < 5 or len(terms[got].rstrip("*")) < 5), (word, terms, usual)
    assert hits > 2000


def test_moves_of_the_automaton_are_kept():
    """Words with the same start take the moves that the first of them had worked out, and a word is read no further than places are left."""
    trie = toxicity.Trie(["grandiose", "grumble*", "idiot"])
    assert [trie.near(w) for w in ("grandoise", "grmbles", "idaot", "grand", "xyzxyzxyz")] == [0, 1, 2, -1, -1]
    known = len(trie.places), sum(map(len, trie.moves))
    assert [trie.near(w) for w in ("grandoise", "grmbles", "idaot", "grand", "xyzabcabc")] == [0, 1, 2, -1, -1]
    assert (len(trie.places), sum(map(len, trie.moves))) == known
    trie.forget()
    assert len(trie.places) == 2 and trie.near("grmbles") == 1


def test_kept_states_are_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_STATES", 5)
    terms = ["grandiose", "grumble*", "idiot"]
    matcher, whole = toxicity.Matcher(terms), toxicity.Trie(terms)
    for word in ("grandoise", "grmbles", "idaot", "grand", "grumbled", "iditos", "gandiose"):
        exact, near = whole.exact(word), whole.near(word)
        assert matcher[word] == (exact + 1 or -(near + 1)), word
        assert len(matcher.trie.places) < 60


def test_shared_letters_by_hand():
    words = ["", "ab", "abc", "b", "", "", "éa", "éab", "grandiosely", "grandioselyest"]
    assert toxicity.shared_letters(words).to_pylist() == [0, 0, 2, 0, 0, 0, 0, 2, 0, 10]


def test_a_column_named_score_is_kept(spark):
    docs = spark.createDataFrame([(1, "text", "mine")], "doc_id long, text string, score string")
    row = toxicity.score_documents(docs, toxicity.NOTHING).first()
    assert (row["score"], row["score_"]) == ("mine", 0.0)


def test_one_id_with_many_rows_gives_the_fit_one(spark):
    docs = spark.createDataFrame([(1, f"word{i}") for i in range(500)] + [(2, "clean")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    every, sample = toxicity.labelled_documents(docs, labels, F.lit(True))
    assert every.count() == 501 and sample.count() == 2


def test_counts_of_terms_by_hand(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(" ".join(rnd.choice(["grumbles", "Grumbled!", "grumb", "gr4mbles", "plain", "plainly", f"w{i % 5}x", "--"]) for _ in range(12)), int(i % 3 == 0)) for i in range(60)]
    held, uses = [{}, {}], [{}, {}]
    for text, toxic in rows:
        words = [w for w in map(toxicity.clean_word, text.lower().split()) if w]
        terms = [t for w in words for t in [w] + [w[:k] + "*" for k in toxicity.STEMS if len(w) >= k]]
        for t in set(terms):
            held[toxic][t] = held[toxic].get(t, 0) + 1
        for t in terms:
            uses[toxic][t] = uses[toxic].get(t, 0) + 1
    seen = []
    keep = toxicity.cut_lineage
    monkeypatch.setattr(toxicity, "cut_lineage", lambda df: (seen.append(keep(df)), seen[-1])[1])
    toxicity.learn_terms(spark.createDataFrame(rows, "text string, toxic int"))
    got = {r.term: (r.a, r.b, r.ua, r.ub) for r in seen[0].collect() if r.term}
    every = set(held[0]) | set(held[1])
    want = {t: (held[1].get(t, 0), held[0].get(t, 0), uses[1].get(t, 0), uses[0].get(t, 0)) for t in every}
    assert got == {t: x for t, x in want.items() if x[0] >= toxicity.LEAST_DOCUMENTS}


def test_a_batch_is_read_in_pieces(spark, monkeypatch):
    # a reader that takes whole batches holds the texts of thousands of rows as strings
    model = (["idiot"], [3.0], [], [2.0, 0.0, 0.0, 2.0, -4.0])
    docs = spark.createDataFrame([(i if i % 7 else None, f"one {'idiot' if i % 3 == 0 else 'word'} more", [i]) for i in range(1003)], "doc_id long, text string, tags array<long>").coalesce(1)
    whole = [tuple(r) for r in toxicity.score_documents(docs, model).collect()]
    monkeypatch.setattr(toxicity, "PIECE", 10)
    assert [tuple(r) for r in toxicity.score_documents(docs, model).collect()] == whole and len(whole) == 1003
    kept = toxicity.score_documents(docs, model, 0.3)
    assert kept.schema == docs.schema and [tuple(r) for r in kept.collect()] == [tuple(r) for r in docs.collect() if "idiot" not in r.text]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": [str(i) for i in range(95)]})
    parts = list(toxicity.pieces(iter([batch])))
    assert max(p.num_rows for p in parts) <= 10 and [t for p in parts for t in p.column("text").to_pylist()] == [str(i) for i in range(95)]


def test_equal_words_of_documents_leave_in_one_row(monkeypatch):
    # a row a word and document has Spark make ten stems of each
    import pyarrow as pa

    texts, toxic = ["stupid stone stupid", "Stone, stupid", "stone", "  ", "a stone"] * 60, [1, 0, 0, 1, 1] * 60
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(toxic, pa.int32())], ["text", "toxic"])
    rows = [tuple(r.values()) for made in toxicity.word_rows(iter([batch])) for r in made.to_pylist()]
    # (word, toxic, letters shared with the word before, documents, uses)
    assert sorted(rows) == sorted([
        ("", 1, 0, 180, 300), ("", 0, 0, 120, 180), ("stone", 1, 0, 120, 120), ("stupid", 1, 2, 60, 120), ("stone", 0, 0, 120, 120),
        ("stupid", 0, 2, 60, 60), ("a", 1, 0, 60, 60)])
    monkeypatch.setattr(toxicity, "MOST_ROWS", 1)
    parts = [made.to_pylist() for made in toxicity.word_rows(iter([batch]))]
    assert len(parts) == 2 and sum(r["held"] for p in parts for r in p) == sum(r[3] for r in rows)
