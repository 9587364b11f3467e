"""Language identification by unigram piece models that sum over all segmentations.

The vocabulary is fixed and public (a SentencePiece file); each language has a probability for every piece. A
word's probability is the sum over all ways to cut it into pieces, from the forward algorithm; a text's is the
product over its words. The probabilities are fitted by expectation maximisation (forward and backward sums) on a
bounded sample of labelled texts, ``SAMPLE`` rows of each language.

Defined cases: NULL texts and texts without a letter are ``und`` with score 0, as all are when nothing can be
learned; ties go to the smaller language code; words of any length count whole, in parts of ``PART`` characters.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.llm.common import bounded_sample, remainder
from trustframe.session import cut_lineage, load_table

#: Labelled rows per language that the model is fitted on.
SAMPLE = 800
ROUNDS = 2
#: Added to every piece's expected count, and the probability of a character that is no piece.
SMOOTH, UNKNOWN = 0.05, 1e-7
PART = 40
#: Words whose scores a worker keeps; beyond them it starts anew.
MOST_KEPT = 300_000
LETTERS = re.compile(r"[^\W\d_]+")


class Pieces:
    """The vocabulary as a trie in two sorted arrays, walked for many words at once."""

    def __init__(self, pieces: list[str]):
        children: dict[int, int] = {}
        ends: dict[int, int] = {}
        nodes = 1
        for i, piece in enumerate(pieces):
            at = 0
            for c in piece:
                step = at << 21 | ord(c)
                if step not in children:
                    children[step] = nodes
                    nodes += 1
                at = children[step]
            ends.setdefault(at, i)
        self.size = len(pieces)
        keys = np.fromiter(children, np.int64, len(children))
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.fromiter(children.values(), np.int64, len(children))[order]
        self.piece = np.full(nodes, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())

    def spans(self, words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(start, word numbers, lengths, pieces) of all pieces found, starts in ascending order; -1: unknown character."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        longest = int(sizes.max(initial=0))
        codes = np.zeros((len(words), longest + 1), np.int64)
        for n in np.unique(sizes).tolist():
            if n:
                own = np.flatnonzero(sizes == n)
                joined = "".join([words[i] for i in own.tolist()]).encode("utf-32-le", "surrogatepass")
                codes[own, :n] = np.frombuffer(joined, np.uint32).reshape(len(own), n)
        for start in range(longest):
            own = np.flatnonzero(sizes > start)
            node, live = np.zeros(len(own), np.int64), own
            found_w, found_n, found_p = [], [], []
            for n in range(1, longest - start + 1):
                step = node << 21 | codes[live, start + n - 1]
                at = np.minimum(np.searchsorted(self.keys, step), len(self.keys) - 1)
                good = self.keys[at] == step
                if n == 1:
                    piece = np.where(good, self.piece[self.next[at]], -1)
                    found_w.append(live), found_n.append(np.ones(len(live), np.int64)), found_p.append(piece)
                node, live = self.next[at[good]], live[good]
                if n > 1:
                    hit = self.piece[node] >= 0
                    found_w.append(live[hit]), found_n.append(np.full(int(hit.sum()), n)), found_p.append(self.piece[node[hit]])
                more = sizes[live] > start + n
                node, live = node[more], live[more]
                if not len(live):
                    break
            yield start, np.concatenate(found_w), np.concatenate(found_n), np.concatenate(found_p)


def forward(spans: list, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Probability sums (word, position, language); the last row of ``table`` is that of unknown characters."""
    sums = np.zeros((len(sizes), int(sizes.max(initial=0)) + 1, table.shape[1]))
    sums[:, 0] = 1.0
    for start, word, length, piece in spans:
        np.add.at(sums, (word, start + length), sums[word, start] * table[piece])
    return sums


def backward(spans: list, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(sizes), int(sizes.max(initial=0)) + 1, table.shape[1]))
    sums[np.arange(len(sizes)), sizes] = 1.0
    for start, word, length, piece in reversed(spans):
        np.add.at(sums, (word, np.full(len(word), start)), sums[word, start + length] * table[piece])
    return sums


def word_parts(word: str) -> list[str]:
    marked = "▁" + word
    return [marked[i : i + PART] for i in range(0, len(marked), PART)]


def log_scores(pieces: Pieces, words: list[str], table: np.ndarray) -> np.ndarray:
    """log probability of every word (each of at most ``PART`` characters) under every language."""
    if not words:
        return np.zeros((0, table.shape[1]))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    sums = forward(list(pieces.spans(words)), sizes, table)
    return np.log(np.maximum(sums[np.arange(len(words)), sizes], 1e-300))


def expected_counts(pieces: Pieces, words: list[str], weights: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in weighted words, over all segmentations."""
    counts = np.zeros(pieces.size + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    table, spans = column[:, None], list(pieces.spans(words))
    ahead, behind = forward(spans, sizes, table)[..., 0], backward(spans, sizes, table)[..., 0]
    whole = np.maximum(ahead[np.arange(len(words)), sizes], 1e-300)
    for start, word, length, piece in spans:
        share = ahead[word, start] * column[piece] * behind[word, start + length] / whole[word] * weights[word]
        np.add.at(counts, piece, share)
    return counts[:-1]


def load_pieces(path: str) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i) and not model.is_byte(i)]


def fit(labelled: DataFrame, vocabulary: list[str]) -> tuple[list[str], np.ndarray]:
    """labelled(lang, text) -> languages and their table of piece probabilities (pieces + 1, languages)."""
    spark = labelled.sparkSession
    names = spark.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                seen: Counter = Counter()
                for text in texts:
                    seen.update(LETTERS.findall(text.lower()))
                if seen:
                    yield pd.DataFrame({"lang": lang, "word": list(seen), "n": list(seen.values())})

    words = cut_lineage(labelled.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    table = np.full((len(vocabulary) + 1, len(langs)), 1.0 / max(1, len(vocabulary)))
    table[-1] = UNKNOWN
    for _ in range(ROUNDS if langs else 0):
        now = spark.sparkContext.broadcast(table)

        def expect(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            pieces, totals = Pieces(names.value), {}
            for pdf in batches:
                for lang, own in pdf.groupby("lang"):
                    parts = [(p, n) for w, n in zip(own["word"], own["n"], strict=True) for p in word_parts(w)]
                    for at in range(0, len(parts), 20_000):
                        some = parts[at : at + 20_000]
                        made = expected_counts(pieces, [p for p, _ in some], np.array([n for _, n in some], float), now.value[:, langs.index(lang)])
                        totals[lang] = totals.get(lang, 0) + made
            for lang, counts in totals.items():
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"lang": lang, "piece": at, "n": counts[at]})

        # one row per language and piece of the vocabulary at most
        rows = words.mapInPandas(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full((len(vocabulary), len(langs)), SMOOTH)
        np.add.at(counts, (rows["piece"].to_numpy(), [langs.index(x) for x in rows["lang"]]), rows["n"].to_numpy())
        table[:-1] = counts / counts.sum(axis=0)
    return langs, table


_KEPT: dict = {}


class Scorer:
    """Word scores of one model, kept by worker between batches and tasks."""

    def __init__(self, names: list[str], table: np.ndarray):
        self.pieces, self.table = Pieces(names), table
        self.place: dict[str, int] = {}
        self.scores = np.zeros((1024, table.shape[1]))

    def learn(self, words: list[str]) -> None:
        new = list(dict.fromkeys(w for w in words if w not in self.place))
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            parts = [(i, p) for i, w in enumerate(some) for p in word_parts(w)]
            made = np.zeros((len(some), self.table.shape[1]))
            np.add.at(made, [i for i, _ in parts], log_scores(self.pieces, [p for _, p in parts], self.table))
            first = len(self.place)
            self.place.update(zip(some, range(first, first + len(some)), strict=True))
            if len(self.place) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros((max(len(self.scores), len(some)), self.table.shape[1]))])
            self.scores[first : first + len(some)] = made

    def score(self, counted: list[Counter]) -> np.ndarray:
        if len(self.place) > MOST_KEPT:
            self.place.clear()
        self.learn([w for words in counted for w in words])
        out = np.zeros((len(counted), self.table.shape[1]))
        for i, words in enumerate(counted):
            at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
            out[i] = np.fromiter(words.values(), np.float64, len(words)) @ self.scores[at]
        return out


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, vocabulary: list[str], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    spark = docs.sparkSession
    names, model, key = spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(table), uuid.uuid4().hex
    kept = [c for c in docs.columns if c not in (text, "lang_pred", "score")]

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if _KEPT.get("key") != key:
            _KEPT.clear()
            _KEPT.update(key=key, scorer=Scorer(names.value, model.value))
        scorer = _KEPT["scorer"]
        for pdf in batches:
            pred, score = ["und"] * len(pdf), [0.0] * len(pdf)
            texts = pdf[text].tolist()
            for begin in range(0, len(texts) if langs else 0, 256):
                counted = [Counter(LETTERS.findall(t.lower())) if t else Counter() for t in texts[begin : begin + 256]]
                totals = scorer.score(counted)
                best = totals.argmax(axis=1)
                rest = 1.0 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
                for i, words in enumerate(counted):
                    if words:
                        pred[begin + i], score[begin + i] = langs[best[i]], float(rest[i])
            yield pdf[kept].assign(lang_pred=pred, score=score)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    return docs.mapInPandas(guess, f"{fields}, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Language of every document; learned from those whose id has another remainder than 2."""
    import public_tokenizers

    vocabulary = load_pieces(model or public_tokenizers.path("piece_bpe_32k.model"))
    docs = load_table(spark, sf_dir, "documents")
    rest = remainder(F.col("doc_id"), 4)
    known = docs.where((rest != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sample = bounded_sample(known, "lang", SAMPLE, ["doc_id"])
    langs, table = fit(sample.select("lang", "text"), vocabulary)
    held = docs.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "text")
    return predict(held, langs, table, vocabulary)
