"""Token ids in wavelet matrix files, one per shard.

Documents are range-partitioned by id and encoded; a shard is a run of whole documents. Its file holds the ids that
occur, the documents' first positions and one bit plane per bit of an id's place among them, most significant first;
each plane is a stable partition of the one before (zeros first), and the counts of ones at every 512th bit of each. They give rank, and with
it access to a single token, counting of an id in a range and the place of its n-th occurrence, without unpacking.

Files are written and read by Spark (a file is one raw record), so any file system that Spark knows will do.

Defined cases: a NULL text is empty and has only the end id; NULL ids come first, equal ids are ordered by a digest of the text; a
document lies in one shard whatever its length; an empty table gives no file and no row.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustframe.session import checkpoint_root, cut_lineage, load_table

END = 2
#: Ids of a shard, about; a shard ends with the document that reaches it.
SHARD_TOKENS = 1 << 21
#: Bits between two counts of ones.
STEP = 512
MAGIC = b"WVM2"
#: Words whose ids a partition keeps; beyond them it starts anew.
MOST_KEPT = 400_000
#: Bytes of the texts that are encoded at once, about.
SLICE = 8 << 20
#: New words that the model takes in a line.
LINE = 50


class WaveletMatrix:
    """One shard in memory: planes, counts and the documents' first positions."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, planes: list[np.ndarray], size: int,
                 counts: list[np.ndarray] | None = None):
        self.symbols, self.starts, self.doc_ids, self.known, self.planes, self.size = symbols, starts, doc_ids, known, planes, size
        self.counts = [ones_before(p) for p in planes] if counts is None else counts
        self.zeros = [size - int(rank_one(p, c, size)) for p, c in zip(planes, self.counts, strict=True)]

    @classmethod
    def build(cls, ids: np.ndarray, starts: np.ndarray, doc_ids: np.ndarray, known: np.ndarray) -> WaveletMatrix:
        flags = np.zeros(int(ids.max(initial=0)) + 1, bool)
        flags[ids] = True
        symbols = np.flatnonzero(flags).astype(np.uint32)
        places = np.cumsum(flags, dtype=np.int64) - 1
        kind = np.uint16 if len(symbols) <= 1 << 16 else np.uint32
        now, planes = places.astype(kind)[ids], []
        for bit in reversed(range(max(1, int(len(symbols) - 1).bit_length()))):
            planes.append(np.packbits(now & kind(1 << bit) != 0, bitorder="little"))
            if bit:
                # a plane is an Arrow array of flags as it is
                own, ones = pa.array(now), pa.Array.from_buffers(pa.bool_(), len(now), [None, pa.py_buffer(planes[-1])])
                now = np.concatenate([own.filter(pc.invert(ones)).to_numpy(), own.filter(ones).to_numpy()])
        return cls(symbols, starts, doc_ids, known, planes, len(ids))

    def to_bytes(self) -> bytes:
        head = struct.pack("<4sQQQI", MAGIC, self.size, len(self.starts), len(self.symbols), len(self.planes))
        parts = [self.starts.astype("<i8"), self.doc_ids.astype("<i8"), np.packbits(self.known, bitorder="little"), self.symbols.astype("<u4"), *self.planes, *[c.astype("<u8") for c in self.counts]]
        return head + b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, size, docs, symbols, planes = struct.unpack_from("<4sQQQI", data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = struct.calcsize("<4sQQQI")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        starts, doc_ids, known = take("<i8", docs), take("<i8", docs), take("u1", -(-docs // 8))
        known = np.unpackbits(known, bitorder="little")[:docs].astype(bool)
        names = take("<u4", symbols)
        own = [take("u1", -(-size // 8)) for _ in range(planes)]
        return cls(names, starts, doc_ids, known, own, size, [take("<u8", -(-(-(-size // 8)) // (STEP // 8)) + 1) for _ in own])

    def decode(self) -> np.ndarray:
        """All ids in order: from the lowest plane upwards, each plane undoes its partition."""
        order: np.ndarray | None = None
        kind = np.uint16 if len(self.symbols) <= 1 << 16 else np.uint32
        for depth, plane in enumerate(reversed(self.planes)):
            ones = np.unpackbits(plane, count=self.size, bitorder="little").astype(bool)
            zeros, value = self.size - int(ones.sum()), kind(1 << depth)
            out = np.zeros(self.size, kind)
            if order is None:
                out[ones] = value
            else:
                out[~ones] = order[:zeros]
                out[ones] = order[zeros:] | value
            order = out
        return self.symbols[order] if order is not None else np.zeros(0, np.uint32)

    def access(self, at: int) -> int:
        """The id at a position."""
        place = 0
        for plane, counts, zeros in zip(self.planes, self.counts, self.zeros, strict=True):
            one = plane[at >> 3] >> (at & 7) & 1
            before = int(rank_one(plane, counts, at))
            place, at = place << 1 | int(one), zeros + before if one else at - before
        return int(self.symbols[place])

    def _range(self, token: int, first: int, last: int) -> tuple[int, int, int]:
        place = int(np.searchsorted(self.symbols, token))
        if place >= len(self.symbols) or self.symbols[place] != token:
            return 0, 0, -1
        for depth, (plane, counts, zeros) in enumerate(zip(self.planes, self.counts, self.zeros, strict=True)):
            a, b = int(rank_one(plane, counts, first)), int(rank_one(plane, counts, last))
            one = place >> (len(self.planes) - 1 - depth) & 1
            first, last = (zeros + a, zeros + b) if one else (first - a, last - b)
        return first, last, place

    def count(self, token: int, first: int = 0, last: int | None = None) -> int:
        """How often an id occurs in [first, last)."""
        low, high, _ = self._range(token, first, self.size if last is None else last)
        return high - low

    def occurrence(self, token: int, n: int) -> int:
        """Position of the n-th (from 0) occurrence of an id; -1: there are fewer."""
        low, high, place = self._range(token, 0, self.size)
        if n < 0 or n >= high - low:
            return -1
        at = low + n
        for depth in reversed(range(len(self.planes))):
            one = place >> (len(self.planes) - 1 - depth) & 1
            at = select_bit(self.planes[depth], self.counts[depth], self.size, at - self.zeros[depth] if one else at, one)
        return at


_POPCOUNT = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def ones_before(plane: np.ndarray) -> np.ndarray:
    """Ones before every STEP-th bit."""
    ones = _POPCOUNT[plane]
    if len(ones) % (STEP // 8):
        ones = np.concatenate([ones, np.zeros(-len(ones) % (STEP // 8), np.uint8)])
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(ones.reshape(-1, STEP // 8).sum(axis=1, dtype=np.int64))])


def rank_one(plane: np.ndarray, counts: np.ndarray, at: int) -> int:
    """Ones before a position."""
    block, byte = at // STEP, at >> 3
    total = int(counts[block]) + int(_POPCOUNT[plane[block * (STEP // 8) : byte]].sum())
    return total + (int(_POPCOUNT[plane[byte] & ((1 << (at & 7)) - 1)]) if at & 7 else 0)


def select_bit(plane: np.ndarray, counts: np.ndarray, size: int, n: int, one: int) -> int:
    """Position of the n-th (from 0) bit of a kind."""
    low, high = 0, size - 1
    while low < high:
        middle = (low + high) // 2
        ones = int(rank_one(plane, counts, middle + 1))
        if (ones if one else middle + 1 - ones) > n:
            high = middle
        else:
            low = middle + 1
    return low


#: Signs without a meaning of their own.
_SIGNS = "([.,;:!?#$%&*|]+)"
#: What is neither such a sign nor a letter whose lower case is one letter whatever stands beside it.
_ODD = "[^A-Za-zÀ-ÖØ-öø-ÿ.,;:!?#$%&*|]"


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str):
    """The tokenizer, its model behind blanks (for ASCII, and for all letters) and the ids that end a word: of fixed size, so a worker keeps them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer, pre_tokenizers

    own = Tokenizer.from_file(path)
    # the letters that stand for the bytes of ASCII letters and signs are themselves
    ascii_words, words = Tokenizer(own.model), Tokenizer(own.model)
    ascii_words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    suffix = getattr(own.model, "end_of_word_suffix", None)
    vocabulary = own.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    if suffix:
        ends[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
    return own, ascii_words, words, ends


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of values, one behind the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    return values[np.arange(total, dtype=kind) + np.repeat((starts - (ends - sizes)).astype(kind), sizes)]


class _Encoder:
    """Ids of texts; those of words are kept for a partition.

    The tokenizer never joins across blanks, nor a run of letters with a run of other signs, so a text's ids are those
    of its parts. A slice of texts is cut into its different runs between blanks, and these into their different words, by Arrow; new plain words
    go straight to the tokenizer's model, all at once, other runs through the whole tokenizer; and ids are gathered along the cuts.
    """

    def __init__(self, path: str):
        self.tokenizer, self.ascii_words, self.other_words, self.ends = _tokenizer(path)
        self._forget()

    def _forget(self) -> None:
        #: words and odd runs; of each the first place in the ids, and how many it has
        self.words, self.starts, self.sizes = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def _keep(self, new: pa.Array, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, new])
        self.starts, self.sizes = np.concatenate([self.starts, len(self.ids) + starts]), np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])

    def _whole(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs by the whole tokenizer, and how many each has."""
        made = [x.ids for x in self.tokenizer.encode_batch_fast(new.to_pylist(), add_special_tokens=False)]
        return np.array([i for own in made for i in own], "<u4"), np.array([len(own) for own in made], np.int64)

    def _plain(self, new: pa.Array, model) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in lower case, and how many each has; a word's last id, and no other, is one that ends a word."""
        bounds = pa.array([*range(0, len(new), LINE), len(new)], pa.int32())
        lines = pc.binary_join(pa.ListArray.from_arrays(bounds, new), " ").to_pylist()
        ids = np.array([i for made in model.encode_batch_fast(lines, add_special_tokens=False) for i in made.ids], "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(new) else self._whole(new)

    def _learn(self, new: pa.Array) -> None:
        starts, sizes, found, at = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [], 0
        letters = pc.string_is_ascii(new).to_numpy(zero_copy_only=False)
        filled = pc.not_equal(new, "").to_numpy(zero_copy_only=False)  # "" stands beside signs
        for some, model in ((letters & filled, self.ascii_words), (~letters, self.other_words)):
            if some.any():
                ids, own = self._plain(new.filter(pa.array(some)), model)
                starts[some], sizes[some] = at + np.cumsum(own) - own, own
                found.append(ids)
                at += len(ids)
        self._keep(new, np.concatenate([np.zeros(0, "<u4"), *found]), starts, sizes)

    def _numbers(self, words: pa.Array, odd: np.ndarray) -> np.ndarray:
        numbers = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        unknown = numbers < 0
        for some in (unknown & ~odd, unknown & odd):
            if some.any():
                new = words.filter(pa.array(some))
                numbers[some] = len(self.words) + np.arange(len(new))
                if odd[some][0]:
                    ids, own = self._whole(new)
                    self._keep(new, ids, np.cumsum(own) - own, own)
                else:
                    self._learn(new)
        return numbers

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        if len(self.words) > MOST_KEPT:
            self._forget()
        cut = pc.split_pattern(pc.replace_substring_regex(pa.array(texts, pa.string()), "[\\n\\t\\r]", " "), " ")
        counts = cut.value_lengths().to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        runs, codes = coded.dictionary, coded.indices.to_numpy()
        odd = pc.match_substring_regex(runs, _ODD)
        # plain runs: each letter has one lower case
        parts = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(runs.filter(pc.invert(odd))), _SIGNS, " \\1 "), " ")
        words = parts.flatten().dictionary_encode()
        n = len(words.dictionary)
        numbers = self._numbers(pa.concat_arrays([words.dictionary, runs.filter(odd)]), np.arange(n + odd.true_count) >= n)
        numbers = np.concatenate([numbers[words.indices.to_numpy()], numbers[n:]])
        # of all runs, plain ones before odd ones: their parts, then their ids
        sizes = self.sizes[numbers]
        ids = gather(self.ids, self.starts[numbers], sizes)
        held = np.concatenate([parts.value_lengths().to_numpy().astype(np.int64), np.ones(odd.true_count, np.int64)])
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])[np.cumsum(held)]
        run_sizes = np.diff(ends, prepend=0)
        order = np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        at = at[codes]
        own = run_sizes[at]
        made = gather(ids, (ends - run_sizes)[at], own)
        last = np.concatenate([np.zeros(1, np.int64), np.cumsum(own)])[np.cumsum(counts)]
        return np.split(made, last[:-1]) if len(last) else []


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows with about ``SLICE`` bytes."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        before = int(total[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + SLICE, "right")))
        yield begin, end
        begin = end


def write_wavelet_shards(docs: DataFrame, tokenizer: str, path: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """docs(doc_id, text) -> files of shards in ascending doc_id order; names of records hold their order."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(tokenizer)
        partition, number = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held, end = 0, np.array([END], "<u4")

        def pack() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in ids], np.int64)
            starts = np.cumsum(sizes) - sizes
            known = np.array([n is not None for n in names])
            shard = WaveletMatrix.build(np.concatenate(ids), starts, np.array([n or 0 for n in names], np.int64), known)
            return pa.RecordBatch.from_arrays([pa.array([struct.pack("<QQ", partition, number) + shard.to_bytes()], pa.binary())], ["payload"])

        for batch in batches:
            texts, own = batch.column("text"), [None if x is None or x != x else int(x) for x in batch.column("doc_id").to_pylist()]
            for begin, until in slices(texts):
                for name, made in zip(own[begin:until], encoder.encode(pc.fill_null(texts[begin:until], "")), strict=True):
                    ids.append(np.append(made, end))
                    names.append(name)
                    held += len(made) + 1
                    if held >= shard_tokens:
                        yield pack()
                        ids, names, held, number = [], [], 0, number + 1
        if ids:
            yield pack()

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    records = ordered.mapInArrow(shards, "payload binary")
    # one record per file, its bytes as they are
    records.select(F.col("payload").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_wavelet_shards(spark: SparkSession, path: str) -> DataFrame:
    """(part, number, shard_start, doc_id, n_tokens, ids_crc32) of every document in the files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                part, number = struct.unpack_from("<QQ", content)
                shard = WaveletMatrix.from_bytes(content[16:])
                ids = shard.decode().astype("<u4")
                ends = np.append(shard.starts[1:], shard.size)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(shard.starts.tolist(), ends.tolist(), strict=True)]
                names = pd.array(shard.doc_ids, dtype="Int64")
                names[~shard.known] = pd.NA
                yield pd.DataFrame({"part": part, "number": number, "shard_start": shard.starts, "doc_id": names, "n_tokens": ends - shard.starts, "ids_crc32": crc})

    files = spark.read.format("binaryFile").load(path).select("content")
    # a task takes one batch of files at a time; the files have SHARD_TOKENS ids each
    return files.mapInPandas(read, "part long, number long, shard_start long, doc_id long, n_tokens long, ids_crc32 long")


def op6_wavelet_tokens(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Every document's place, length and checksum, read back from the files."""
    import public_tokenizers

    path = f"{checkpoint_root(spark)}/wavelet-{uuid.uuid4().hex}"
    write_wavelet_shards(load_table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), path)
    read = cut_lineage(read_wavelet_shards(spark, path))  # files are decoded once
    sums = read.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    parts = sums.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", "number", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("own_start")).join(parts, "part")
    return read.join(offsets, ["part", "number"]).select(
        "doc_id", (F.col("part_start") + F.col("own_start") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
