"""Toxicity from a learned lexicon, misspellings and the context of each hit.

A lexicon of words and stems that mark toxic documents is learned from counts over all labelled rows. Its trie
is intersected with the Levenshtein automaton (distance 1) of a word, which finds misspelled terms without trying
every term; digits and signs that stand for letters are read as letters. A window of words around each hit says
whether the term is quoted or reported; such hits count apart, and a logistic model on the counts gives the score.

Defined cases: NULL and empty texts have no hit and get the score of a text without one; nothing learned: score 0;
a document labelled twice is toxic if any label says so; words of any length are read whole; of terms under
``LEAST_FUZZY`` letters only swaps of neighbours and signs for letters count as misspellings.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.llm.common import bounded_sample, fresh, may_hold, releasing, remainder
from trustframe.session import cut_lineage, load_table

#: Labelled rows of either class that the weights of the counts are fitted on.
SAMPLE = 2500
#: Lengths of stems.
STEMS = range(4, 11)
#: Toxic documents that must hold a term, and the share of its documents that must be toxic (classes in balance).
LEAST_DOCUMENTS, LEAST_PRECISION = 3, 0.75
#: Share of the toxic documents that admits a term without a test (small tables), and chance terms expected of the test.
LEAST_SUPPORT, CHANCE = 0.02, 0.05
#: Least log ratio of a term's rates in toxic and other documents; lower ones occur by chance.
LEAST_RATE = 2.2
#: Share of the toxic class when the weights are fitted.
CLASS_SHARE = 0.15
#: Shortest term that all misspellings are looked for; of shorter ones only swaps.
LEAST_FUZZY = 5
#: Words before and after a hit that make its context.
CONTEXT = 6
#: Words that a partition keeps; beyond them it starts anew.
MOST_KEPT = 100_000
#: States of the automaton that a partition keeps.
MOST_STATES = 20_000
#: Rows whose texts a task has as Python strings at a time; its batches hold thousands.
PIECE = 200
#: Different rows of word counts that a task collects before it passes them on.
MOST_ROWS = 50_000
THRESHOLD = 0.3
# fixed values: characters read as letters inside words, marks that open or close a quotation, words of reporting
LEET = str.maketrans("013457@$!", "oieastasi")
QUOTES = "\"“”„«»‘’'`"
REPORTING = frozenset("said says quoted quote called word words term wrote writes report reported insult slur dit mot sagte wort dijo palabra".split())
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’…–—¡¿"


#: The edit made on the way to a node of the trie; a letter stands for a swap of which the word must still have that letter.
NO_EDIT, EDIT, SWAP = "none", "edit", "swap"
#: A node and an edit.
Place = tuple[int, str]
#: States without a place, and before the first letter.
NOWHERE, BEGINNING = 0, 1


class Trie:
    """Lexicon terms; a stem ends in ``*`` and covers every word that starts with it.

    ``near`` intersects the trie with the Levenshtein automaton of a word for distance 1 (insertion, deletion, replacement, swap of
    neighbours). A place of the intersection is a node and the edit made on the way to it: none, a swap, any other, or a swap's second
    letter that the word must have next. The places that words with the same start can be at make a state; a state's moves are worked
    out when a word first takes them and then kept, so that a word is read by one look-up a letter, up to the letter that leaves no place.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.depth: list[int] = [0]
        #: letters of a stem, or of the start that a short term is held against, by the term's number; 0: none, for other whole words
        self.start_of: list[int] = []
        for i, term in enumerate(terms):
            text, at, stem = term.rstrip("*"), 0, term.endswith("*")
            for c in text:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({}), self.word.append(-1), self.stem.append(-1), self.depth.append(self.depth[at] + 1)
                at = self.children[at][c]
            (self.stem if stem else self.word)[at] = i
            self.start_of.append(LEAST_FUZZY - 1 if len(text) < LEAST_FUZZY else len(text) if stem else 0)
        self.forget()

    def forget(self) -> None:
        """Start the kept states anew, with the empty one and the one before any letter."""
        self.states: dict[frozenset[Place], int] = {}
        self.places: list[frozenset[Place]] = []
        self.moves: list[dict[str, int]] = []
        #: terms that a word ends with in a state, and stems that it then starts with
        self.ends: list[list[int]] = []
        self.begins: list[list[int]] = []
        self._state(frozenset())
        self._state(frozenset([(0, NO_EDIT)]))

    def exact(self, word: str) -> int:
        """Term that the word is or starts with; -1: none."""
        at = 0
        for c in word:
            at = self.children[at].get(c, -1)
            if at < 0:
                return -1
            if self.stem[at] >= 0:
                return self.stem[at]
        return self.word[at]

    def may_be_near(self, word: str) -> bool:
        """Whether the word can be or begin with a term, or be near one, by its first four letters."""
        return len(word) < 4 or self.may_follow(word[:4])

    def may_follow(self, start: str) -> bool:
        """Whether a word of four letters or more with this start of four can be or begin a term, or be near one."""
        state, found = self._read(start)
        return state != NOWHERE or bool(found) or self.exact(start) >= 0

    def near(self, word: str, usual: frozenset[str] = frozenset()) -> int:
        """Term within one edit; the smallest number wins.

        A stem is held against every prefix of the word, unless the word's start of its length is in ``usual``.
        """
        state, found = self._read(word)
        found = found + self.ends[state]
        return min((i for i in found if not self.start_of[i] or word[: self.start_of[i]] + "*" not in usual), default=-1) if found else -1

    def _read(self, word: str) -> tuple[int, list[int]]:
        """The state after the word, and the stems that it starts with or is near to starting with."""
        moves, begins, state, found = self.moves, self.begins, BEGINNING, []
        for c in word:
            after = moves[state].get(c)
            state = self._move(state, c) if after is None else after
            if state == NOWHERE:
                break
            if begins[state]:
                found = found + begins[state]
        return state, found

    def _move(self, state: int, c: str) -> int:
        """Where the letter leads from a state."""
        after: set[Place] = set()
        for node, edit in self.places[state]:
            own = self.children[node]
            if edit == NO_EDIT:
                after.add((node, EDIT))  # a letter too many
                for d, child in own.items():
                    below = self.children[child]
                    after.add((child, NO_EDIT if c == d else EDIT))
                    if c in below:
                        after.add((below[c], EDIT))  # a letter lacks
                        if c != d:
                            after.add((below[c], d))
            elif edit in (EDIT, SWAP):
                if c in own:
                    after.add((own[c], edit))
            elif edit == c:
                after.add((node, SWAP))
        to = self.moves[state][c] = self._state(frozenset(after))
        return to

    def _state(self, places: frozenset[Place]) -> int:
        if places not in self.states:
            self.states[places] = len(self.places)
            self.places.append(places)
            self.moves.append({})
            # what a word has that ends here or before a letter that lacks; terms under LEAST_FUZZY letters only by a swap
            here = {(node, edit) for node, edit in places if edit in (NO_EDIT, EDIT, SWAP)}
            here |= {(child, EDIT) for node, edit in places if edit == NO_EDIT for child in self.children[node].values()}
            reached = {node for node, edit in here if edit == SWAP or self.depth[node] >= LEAST_FUZZY}
            self.ends.append(sorted(self.word[node] for node in reached if self.word[node] >= 0))
            self.begins.append(sorted(self.stem[node] for node in reached if self.stem[node] >= 0))
        return self.states[places]


def clean_word(chunk: str) -> str:
    """Lower-case word without marks at its ends, with signs inside it read as letters."""
    word = chunk.strip(EDGE)
    if not word.isalpha():
        word = "".join(c for c in (word.translate(LEET) if any(c.isalpha() for c in word) else word) if c.isalpha())
    return word


class CleanWords(dict):
    """lower-case chunk -> clean word."""

    def __missing__(self, chunk: str) -> str:
        if len(self) > MOST_KEPT:
            self.clear()
        word = self[chunk] = clean_word(chunk)
        return word


class Matcher(dict):
    """lower-case chunk -> 0 (no term), term number + 1, or minus that for a misspelled one."""

    def __init__(self, terms: list[str], usual: frozenset[str] = frozenset()):
        super().__init__()
        self.trie, self.usual = Trie(terms), usual

    def __missing__(self, chunk: str) -> int:
        if len(self) > MOST_KEPT:
            self.clear()
        if len(self.trie.places) > MOST_STATES:
            self.trie.forget()
        word, out = clean_word(chunk), 0
        if word:
            term = self.trie.exact(word)
            if term >= 0:
                out = term + 1
            elif word not in self.usual:
                term = self.trie.near(word, self.usual)
                out = -(term + 1) if term >= 0 else 0
        self[chunk] = out
        return out


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, PIECE):
            yield batch.slice(begin, PIECE)


def is_quoted(chunks: list[str], at: int) -> bool:
    """The hit stands between quotation marks, or a word of reporting stands near it."""
    before, after = chunks[max(0, at - CONTEXT) : at + 1], chunks[at : at + CONTEXT + 1]
    opened = any(c[0] in QUOTES for c in before)
    closed = any(c.rstrip(".,;:!?")[-1:] in QUOTES and c.rstrip(".,;:!?") for c in after)
    return opened and closed or any(c.strip(EDGE) in REPORTING for c in before + after)


#: Counts of a document: weight of hits, weight of quoted hits, distinct terms, weight by words.
FEATURES = 4
#: Weight of a misspelled hit against an exact one.
FUZZY = 0.8


def features(text: str, matcher: Matcher, weights: list[float]) -> list[float]:
    chunks = text.lower().split()
    found = list(map(matcher.__getitem__, chunks))
    if not any(found):
        return [0.0] * FEATURES
    plain = quoted = 0.0
    terms = set()
    for at in [at for at, term in enumerate(found) if term]:
        term = found[at]
        weight = weights[abs(term) - 1] * (1.0 if term > 0 else FUZZY)
        if is_quoted(chunks, at):
            quoted += weight
        else:
            terms.add(abs(term))
            plain += weight
    return [math.log1p(plain), math.log1p(quoted), math.log1p(len(terms)), math.log1p(100 * plain / len(chunks))]


#: Columns of ``word_rows``.
KINDS = {"word": pa.string(), "toxic": pa.int32(), "shared": pa.int32(), "held": pa.int64(), "n": pa.int64()}


def shared_letters(words: list[str]) -> pa.Array:
    """Letters that each word shares with the one before, as far as stems go."""
    own, before = pa.array(words, pa.string()), pa.array(["", *words[:-1]], pa.string())
    size, shared = pc.utf8_length(own), pa.repeat(pa.scalar(0, pa.int32()), len(words))
    for k in range(1, STEMS[-1] + 1):
        same = pc.and_(pc.greater_equal(size, k), pc.equal(pc.utf8_slice_codeunits(own, 0, k), pc.utf8_slice_codeunits(before, 0, k)))
        shared = pc.add(shared, same.cast(pa.int32()))
    return shared


def summed(rows: pa.Table) -> pa.Table:
    """Rows of ``KINDS`` with those of the same word in one."""
    sums = rows.group_by(["word", "toxic", "shared"], use_threads=False).aggregate([("held", "sum"), ("n", "sum")])
    return sums.rename_columns({"held_sum": "held", "n_sum": "n"}).select(list(KINDS))


@releasing
def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> (word, toxic, shared, held, n): distinct words of each document in order, with the letters shared with the one before.

    Documents that say the same of a word are counted in one row (held: documents, n: uses), some ``MOST_ROWS`` rows at a time, so that
    Spark makes stems of far fewer rows. The word "" counts the documents and all their words; it comes first in each document.
    """
    clean = CleanWords()
    kept = pa.schema(KINDS.items()).empty_table()
    for part in pieces(batches):
        words: list[str] = []
        uses: list[int] = []
        sizes: list[int] = []
        for text in part.column("text").to_pylist():
            own: dict[str, int] = {}
            for chunk, n in Counter(text.lower().split()).items():
                word = clean[chunk]
                own[word] = own.get(word, 0) + n
            own.pop("", None)
            own[""] = sum(own.values())
            ordered = sorted(own)
            words.extend(ordered)
            uses.extend(map(own.__getitem__, ordered))
            sizes.append(len(ordered))
        toxic = np.repeat(part.column("toxic").to_numpy(zero_copy_only=False), sizes)
        made = [words, toxic, shared_letters(words), np.ones(len(words), np.int64), uses]
        made = pa.table([pa.array(x, kind) for x, kind in zip(made, KINDS.values(), strict=True)], list(KINDS))
        kept = summed(pa.concat_tables([kept, made]))
        if kept.num_rows >= MOST_ROWS:
            yield from kept.combine_chunks().to_batches()
            kept = kept.schema.empty_table()
    if kept.num_rows:
        yield from kept.combine_chunks().to_batches()


def learn_terms(labelled: DataFrame) -> tuple[list[str], list[float]]:
    """labelled(text, toxic) -> words and stems (with ``*``) that mark toxic documents, and their weights.

    A term's weight is the log ratio of its rates among the words of toxic and of other documents. Rare terms are
    admitted by a binomial tail (Chernoff bound), corrected for the number of terms.
    """
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return [], []
    of = lambda c, label: F.sum(F.when(F.col("toxic") == label, F.col(c)).otherwise(0))
    # a stem is new to its document where the word before, in order, does not share it
    used = labelled.select("text", "toxic").mapInArrow(word_rows, "word string, toxic int, shared int, held long, n long")
    k = F.char_length("word")
    stems = [F.when(k >= i, F.struct(F.concat(F.substr("word", F.lit(1), F.lit(i)), F.lit("*")).alias("term"), F.when(F.lit(i) > F.col("shared"), F.col("held")).otherwise(F.lit(0).cast("long")).alias("held"))) for i in STEMS]
    own = F.array(F.struct(F.col("word").alias("term"), F.col("held")), *stems)
    terms = used.select("toxic", "n", F.explode(own).alias("t")).where("t is not null").select("toxic", "n", "t.term", "t.held")
    counts = cut_lineage(terms.groupBy("term").agg(
        of("held", 1).alias("a"), of("held", 0).alias("b"), of("n", 1).alias("ua"), of("n", 0).alias("ub")).where(
        (F.col("term") == "") | (F.col("a") >= LEAST_DOCUMENTS)))
    share = (F.col("a") / bad) / (F.col("a") / bad + F.col("b") / good)
    part = lambda c, size: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (F.col("a") + F.col("b")) * ((bad + good) / size))).otherwise(0.0)
    admitted = (F.col("a") >= LEAST_SUPPORT * bad) | (part("a", bad) + part("b", good) >= math.log(max(1, counts.count()) / CHANCE))
    # the candidates of the lexicon: they grow with the words that mark toxic texts, not with the rows
    rows = counts.where((F.col("term") == "") | admitted & (share >= LEAST_PRECISION)).orderBy(
        F.col("term") != "", F.desc("a"), F.desc(F.length("term")), "term").collect()
    if not rows or rows[0]["term"]:
        return [], []
    words_bad, words_good = rows[0]["ua"], rows[0]["ub"]
    rate = {r["term"]: math.log((r["ua"] + 0.5) / (words_bad + 1) * (words_good + 1) / (r["ub"] + 0.5)) for r in rows[1:]}
    support = {r["term"]: r["a"] for r in rows[1:] if rate[r["term"]] >= LEAST_RATE}
    # of stems that say the same, the longest; below it no longer ones
    whole = {w for w in support if not w.endswith("*")}
    longer: dict[str, int] = {}
    for t, a in support.items():
        if t.endswith("*"):
            longer[t[:-2]] = max(longer.get(t[:-2], 0), a)
    stems: set[str] = set()
    for t in sorted((t[:-1] for t in support if t.endswith("*")), key=len):
        if longer.get(t, 0) < 0.9 * support[t + "*"] and not any(t[:k] in stems for k in STEMS):
            stems.add(t)
    main = {w for w in whole if not any(w[:k] in stems for k in STEMS) or any(w[:k] in stems and support[w] >= 0.5 * support[w[:k] + "*"] for k in STEMS)}
    kept = sorted({s + "*" for s in stems} | main, key=lambda t: (-support[t], t))
    return kept, [rate[t] for t in kept]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights (bias last) by Newton steps, classes weighted by ``CLASS_SHARE``."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y == 1, CLASS_SHARE / max(1, y.sum()), (1 - CLASS_SHARE) / max(1, (1 - y).sum()))
    w, penalty = np.zeros(x1.shape[1]), ridge * np.diag([1.0] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (share * (p - y)) + penalty @ w
        hessian = (x1 * (share * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x1 + penalty
        w = w - np.linalg.solve(hessian, gradient)
    return w


def usual_words(sample: DataFrame, terms: list[str]) -> list[str]:
    """Words of documents that aren't toxic within one edit of a term, and (with ``*``) their starts of the stems' lengths: no misspellings."""
    shared = sample.sparkSession.sparkContext.broadcast(terms)

    @releasing
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, words = Matcher(shared.value), set()
        for part in pieces(batches):
            chunks = {c for t in part.column("text").to_pylist() for c in t.lower().split()}
            words |= {clean_word(c) for c in chunks if matcher[c] < 0}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(words | {w[:k] + "*" for w in words for k in STEMS}), pa.string())], ["word"])

    # bounded by the words of the sample
    return [r["word"] for r in sample.where("toxic = 0").select("text").mapInArrow(near, "word string").distinct().collect()]


#: Terms, their weights, words that are no misspellings, weights of the counts.
Model = tuple[list[str], list[float], list[str], list[float]]
NOTHING: Model = ([], [], [], [])


def with_features(df: DataFrame, model: Model) -> DataFrame:
    """df(toxic, text) -> (toxic, f): the counts of each document."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @releasing
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, rates, usual, _ = shared.value
        matcher = Matcher(terms, frozenset(usual))
        for part in pieces(batches):
            f = [features(t, matcher, rates) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.int32()), pa.array(f, pa.list_(pa.float64()))], ["toxic", "f"])

    return df.select("toxic", "text").mapInArrow(measure, "toxic int, f array<double>")


def fit(labelled: DataFrame, sample: DataFrame) -> Model:
    """All labelled(text, toxic) and a bounded sample of them -> model."""
    terms, rates = learn_terms(labelled)
    if not terms:
        return NOTHING
    sample = cut_lineage(sample)
    usual = usual_words(sample, terms)
    rows = with_features(sample, (terms, rates, usual, [])).collect()  # two times SAMPLE rows of counts
    w = fit_logistic(np.array([r["f"] for r in rows]), np.array([r["toxic"] for r in rows], float))
    # hits only raise a score and quoted ones do not
    signs = [1, -1, 1, 1]
    return terms, rates, usual, [float(max(x * s, 0.0) * s) for x, s in zip(w[:-1], signs, strict=True)] + [float(w[-1])]


def scores(f: np.ndarray, weights: list[float]) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-(f @ np.array(weights[:-1]) + weights[-1])))


def labelled_documents(docs: DataFrame, labels: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, toxic) of all labelled documents, and of about ``SAMPLE`` of either class."""
    best = labels.where(F.col("toxic").isin(0, 1) & keep).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded_sample(best, "toxic", SAMPLE, ["doc_id"])
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    texts = may_hold(texts, F.xxhash64("doc_id"), best.select(F.xxhash64("doc_id").alias("h")))  # spares others the shuffle
    sample = texts.join(F.broadcast(chosen), "doc_id")  # two times SAMPLE ids
    # one text an id, so that the rows that the driver fits on are bounded, too
    return texts.join(best, "doc_id"), sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def score_documents(docs: DataFrame, model: Model, keep_below: float | None = None) -> DataFrame:
    """docs(..., text) -> the other columns and score (``score_`` beside one of that name); or, with ``keep_below``, the rows that score less, whole."""
    kept = [c for c in docs.columns if c != "text"]
    name = fresh(docs, "score")[0]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @releasing
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, rates, usual, weights = shared.value
        matcher = Matcher(terms, frozenset(usual))
        for part in pieces(batches):
            f = np.array([features(t, matcher, rates) if t else [0.0] * FEATURES for t in part.column("text").to_pylist()]).reshape(part.num_rows, FEATURES)
            score = scores(f, weights) if weights else np.zeros(part.num_rows)
            if keep_below is None:
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(score)], [*kept, name])
            else:
                yield part.filter(pa.array(score < keep_below))

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema if x.name != "text")
    return docs.mapInArrow(measure, f"{fields}, `{name}` double" if keep_below is None else docs.schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted to be toxic; learned from all labelled rows."""
    return score_documents(docs, fit(*labelled_documents(docs, labels, F.lit(True))), THRESHOLD)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from those whose id has another remainder than 2."""
    docs, labels = load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels")
    rest = remainder(F.col("doc_id"), 4)
    model = fit(*labelled_documents(docs, labels, rest != 2))
    scored = score_documents(docs.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
