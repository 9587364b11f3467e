"""Byte-level BPE encoding and decoding by replaying the merges over all words of a block of texts at once.

A text is cut by the vocabulary's pattern; a worker gathers the distinct cuts of a block of texts that it has not met
before and lays their bytes out as one row of tokens. An inverted index holds, for every merge (named by the id of the
token that it makes), the positions of the pairs that it joins. Merges are taken from the lowest rank upwards; one is
applied at all its positions, and only the pairs with the two touched neighbours are looked up and indexed anew.

A merge can bring forth a pair of a lower rank in the same word. The rest of that word's positions then go back to the
index, so each word sees its merges in the order in which it alone would: lowest rank first, leftmost first. A cut that is
a token itself is that token.

Ids are packed as little-endian unsigned 32-bit numbers. Words kept from block to block are bounded in bytes and live as
long as their partition; a lost task starts with none and gives the same ids.

Defined cases: a NULL or empty text has no id and decodes to no byte; decoding joins bytes, which need not be UTF-8;
texts and cuts of any length are whole; unknown ids are an error.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.session import load_table

#: Characters of the texts that are cut and merged together, about.
BLOCK = 1 << 17
#: Bytes of words and their ids that a partition keeps.
MOST_KEPT = 32 << 20
#: Bytes counted for a kept word besides its letters and ids.
PER_WORD = 150
_SHIFT = 32


class Vocabulary:
    """Ranks of byte strings, and for every pair of tokens that makes a third one the id of that."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.pairs: dict[int, int] = {}
        for token, made in ranks.items():
            for cut in range(1, len(token)):
                first, second = ranks.get(token[:cut]), ranks.get(token[cut:])
                if first is not None and second is not None:
                    self.pairs[first << _SHIFT | second] = made
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # the merge of two single bytes, or -1
        self.first = np.full((256, 256), -1, np.int64)
        for a in range(256):
            for b in range(256):
                self.first[a, b] = self.pairs.get(int(self.single[a]) << _SHIFT | int(self.single[b]), -1)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


@functools.lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file: of fixed size, so a worker keeps it."""
    return Vocabulary.read(path)


def replay(words: list[bytes], known: Vocabulary) -> list[bytes]:
    """Packed ids of every word (none empty), all merged together."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    token: list[int] = known.single[data].tolist()
    # neighbours of a position; a word's own bounds are -1
    after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
    after[ends - 1] = -1
    before[0] = -1
    before[ends[:-1]] = -1
    made = np.full(len(data), -1, np.int64)
    made[:-1] = known.first[data[:-1], data[1:]]
    made[ends - 1] = -1
    right, left = after.tolist(), before.tolist()
    # inverted index: merge -> positions of the first of its two tokens, ascending
    places = np.flatnonzero(made >= 0)
    places = places[np.argsort(made[places], kind="stable")]
    cuts = np.flatnonzero(np.diff(made[places])) + 1
    index = {int(made[p[0]]): p.tolist() for p in np.split(places, cuts) if len(p)}
    waiting = list(index)
    heapq.heapify(waiting)
    due = made.tolist()  # the merge that the pair at a position waits for; positions in the index may be stale
    end_of = np.repeat(ends, np.diff(ends, prepend=0)).tolist()
    pair, push, pop = known.pairs.get, heapq.heappush, heapq.heappop
    while waiting:
        rank = pop(waiting)
        held = index.pop(rank)
        if len(held) > 1:
            held.sort()
        stopped, back = -1, []  # a lower merge came up in the word that ends at ``stopped``
        for at in held:
            if due[at] != rank:
                continue
            if at < stopped:
                back.append(at)
                continue
            second = right[at]
            behind, ahead = right[second], left[at]
            token[at], token[second], due[second], due[at] = rank, -1, -1, -1
            right[at] = behind
            if behind >= 0:
                left[behind] = at
                new = pair(rank << _SHIFT | token[behind])
                if new is not None:
                    due[at] = new
                    if new in index:
                        index[new].append(at)
                    else:
                        index[new] = [at]
                        push(waiting, new)
                    if new < rank:
                        stopped = end_of[at]
            if ahead >= 0:
                new = pair(token[ahead] << _SHIFT | rank)
                if new is None:
                    due[ahead] = -1
                else:
                    due[ahead] = new
                    if new in index:
                        index[new].append(ahead)
                    else:
                        index[new] = [ahead]
                        push(waiting, new)
                    if new < rank:
                        stopped = end_of[at]
        if back:
            index[rank] = back
            push(waiting, rank)
    ids = np.array(token, np.int64)
    kept = ids >= 0
    sizes = np.add.reduceat(kept, np.concatenate([[0], ends[:-1]]))
    packed, out, begin = ids[kept].astype("<u4").tobytes(), [], 0
    for size in (4 * sizes).tolist():
        out.append(packed[begin : begin + size])
        begin += size
    return out


class Words(dict):
    """cut -> packed ids, for as long as they fit in ``MOST_KEPT`` bytes."""

    def __init__(self, known: Vocabulary):
        super().__init__()
        self.known, self.held = known, 0

    def learn(self, cuts: set[str]) -> None:
        if self.held > MOST_KEPT:
            self.clear()
            self.held = 0
        ranks, new = self.known.ranks, []
        for cut in cuts:
            if cut not in self:
                own = ranks.get(cut.encode())
                if own is None:
                    new.append(cut)
                else:
                    self[cut] = own.to_bytes(4, "little")
                    self.held += PER_WORD + len(cut)
        if new:
            made = replay([w.encode() for w in new], self.known)
            self.update(zip(new, made, strict=True))
            self.held += sum(map(len, made)) + sum(map(len, new)) + PER_WORD * len(new)


def blocks(texts: list[str], size: int = BLOCK) -> Iterator[list[str]]:
    """Runs of texts of about ``size`` characters; a longer text is a run of its own."""
    own, held = [], 0
    for text in texts:
        own.append(text)
        held += len(text)
        if held >= size:
            yield own
            own, held = [], 0
    if own:
        yield own


def encoder(path: str, pattern: str) -> Callable[[Column], Column]:
    """A column function from text to packed ids; ``path`` holds base64 tokens and ranks and is read by each worker."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words, cut = Words(vocabulary(path)), regex.compile(pattern).findall
        for batch in batches:
            out: list[bytes] = []
            for own in blocks([t or "" for t in batch]):
                parts = list(map(cut, own))
                words.learn(set().union(*parts))
                out += [b"".join(map(words.__getitem__, p)) for p in parts]
            yield pd.Series(out, dtype=object)

    return encode


def decoder(path: str) -> Callable[[Column], Column]:
    """A column function from packed ids to bytes."""

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = vocabulary(path).bytes_of.__getitem__
        for batch in batches:
            yield pd.Series([b"".join(map(token, np.frombuffer(x, "<u4").tolist())) if x else b"" for x in batch], dtype=object)

    return decode


def op11_byte_pairs(spark: SparkSession, sf_dir: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Every document's ids and the bytes that they decode to, as digests."""
    import public_tokenizers

    path = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = docs.select("doc_id", encoder(path, pattern or public_tokenizers.PATTERN)(F.col("text")).alias("ids"))
    both = encoded.withColumn("decoded", decoder(path)(F.col("ids")))
    return both.select(
        "doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
