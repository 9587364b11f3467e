"""N-gram Jaccard join with token-combination prefixes: exact links and components of near-equal documents.

A document is the set of hashes of its word n-grams. Documents with equal sets are one set from the start. Under one
global order of tokens, sets whose Jaccard similarity reaches the threshold t share at least k tokens among their
first n - ceil(t n) + k. The order puts rare tokens first:

* a set whose prefix (k = 1) holds rare tokens only is indexed by those single tokens;
* the sets that lack such tokens count their other tokens among themselves; those that few of them hold come next in the
  order, and a set whose prefix they fill is indexed by single tokens, too. Texts with a passage that many others hold
  are told apart by what is their own;
* any other set extends its prefix to k = G + 1 and is indexed by its rare tokens and by pairs of its other tokens
  that fall in the same of G groups; G + 1 shared tokens put two in one group. G grows with the size of a set, so the
  pairs stay linear in it.

Sets that share an index key are candidates; of keys that the same sets hold one is kept. They are joined in two rounds. First every
set of a key meets the key's leader. Then, where a key still spans several components, its sets meet across components: in
a key of few sets (single tokens have no others) all that sketches of 256 bits do not tell apart; in a larger one those that
share a difference from the leader. Of two similar sets in different components one is not similar to the leader, so both
differ from it in some of the same tokens (``differences``); the more of its own differences a set must share, the fewer of them are
indexed. Only pairs inside one component are never compared, so no link between components is lost, while a group of thousands of near
copies costs a few comparisons per copy. Candidates are pruned by the overlap of their stored low hashes, which is exact,
and verified on all tokens.

Low tokens, those with a low hash, are counted over all documents. The classes of tokens
only steer the order; a mistake there (the table of frequent tokens has a fixed size) costs time, not links.

Defined cases: a NULL or blank text has no n-gram, size 0, and is linked with nothing; fewer words than n are one
sequence; repeated rows have the same component; a component without any doc_id has NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.llm.common import BITS, WORD, flags_of, fresh, read_flags, releasing
from trustframe.session import cut_lineage, load_table, release

#: Sets that hold a token, up to which it is rare.
RARE = 24
#: Sets up to this size keep all tokens in the table of sets; larger ones their low hashes.
SMALL = 128
#: Words whose hashes a partition keeps; beyond them it starts anew.
MOST_KEPT = 200_000
#: UTF-8 bytes with A to Z in lower case; bytes.split() then parts at the six separators only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
FACTORS = (np.random.default_rng(9).integers(1, 1 << 62, size=64, dtype=np.int64) * 2 + 1).astype(np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MOST_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix_bits(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int, known: _Words) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; ``known`` keeps the hashes of words for a partition."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += ids[k : k + n] * FACTORS[k]
    return np.unique(mix_bits(total))


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of size n with any similar one."""
    return -(-percent * n // 100)


def low_limit(percent: int) -> np.uint64:
    """Hashes below it are stored and counted: a share somewhat above the longest prefix."""
    return np.uint64(int(min(1.0, 1.6 * (1 - percent / 100) + 0.06) * (2**64 - 1)))


def rare_keys(tokens: np.ndarray, n: int, percent: int, frequent: np.ndarray) -> np.ndarray | None:
    """Index keys of a set of n tokens from its low ones, if the rare ones among them fill its prefix; None: they do not."""
    least = needed(n, percent)
    if least == n and 100 * n // percent == n:
        return np.empty(0, np.uint64)  # only an equal set is similar
    rare = tokens[(tokens < low_limit(percent)) & ~frequent[tokens >> np.uint64(64 - BITS)]]
    return rare[: n - least + 1] if len(rare) > n - least else None


def all_keys(tokens: np.ndarray, percent: int, frequent: np.ndarray, frequent_here: np.ndarray) -> np.ndarray:
    """Index keys of a set from all its tokens: rare ones alone, then pairs of the others.

    Rare are low tokens that few sets hold and, behind them in the order, other tokens that few of the sets indexed here hold.
    """
    n, low = len(tokens), low_limit(percent)
    least, slot = needed(n, percent), tokens >> np.uint64(64 - BITS)
    first, second = (tokens < low) & ~frequent[slot], (tokens >= low) & ~frequent_here[slot]
    rare = np.concatenate([tokens[first], tokens[second]])
    if len(rare) > n - least:
        return rare[: n - least + 1]
    other = tokens[~(first | second)]
    keys = [rare]
    smallest, largest = max(1, least), 100 * n // percent
    for level in range(smallest.bit_length() - 1, largest.bit_length()):
        # as many groups as the prefix has tokens make the fewest pairs
        groups = max(1, int((1 << level) * (100 - percent) / 100))
        rest = other[: max(0, min(n, n - least + groups + 1) - len(rare))]
        of = rest % np.uint64(groups)
        order = np.argsort(of, kind="stable")
        rest, of = rest[order], of[order]
        ends = np.append(np.flatnonzero(np.diff(of)) + 1, len(of))
        begin = 0
        for end in ends.tolist():
            i, j = np.triu_indices(end - begin, 1)
            own = rest[begin:end]
            keys.append(mix_bits(own[i] * FACTORS[20] + own[j] * FACTORS[21] + np.uint64(level)))
            begin = end
    return np.unique(np.concatenate(keys))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """256 bits of a set, one for each token: a bit that another set lacks is a token that it lacks."""
    bits = np.zeros(256, bool)
    bits[(tokens >> np.uint64(8)).astype(np.int64) & 255] = True
    return np.packbits(bits, bitorder="little").view(np.int64)


def most_shared(a: str, b: str, na: Column, nb: Column) -> Column:
    """Bound of the overlap of two sets from their sketches."""
    lacks = lambda x, y: sum((F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(i))))) for i in range(4)), F.lit(0))
    return F.least(na - lacks(a, b), nb - lacks(b, a))


def _signed(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """docs(doc_id, text, text_key) -> (doc_id, text_key, n, d1, d2, whole, tokens, bits): digest of each set, its (low) tokens and its sketch."""
    limit = low_limit(percent)

    @releasing
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for pdf in batches:
            texts = pdf["text"].tolist()
            for at in range(0, len(texts), 1000):
                made = [shingles(t, width, known) for t in texts[at : at + 1000]]
                digest = np.array([xxhash.xxh3_128_digest(s.tobytes()) for s in made], "S16")
                pairs = np.frombuffer(b"".join(d.ljust(16, b"\0") for d in digest.tolist()), np.int64).reshape(-1, 2)
                sizes = np.array([len(s) for s in made], np.int64)
                yield pdf[["doc_id", "text_key"]].iloc[at : at + 1000].assign(
                    n=sizes, d1=pairs[:, 0], d2=pairs[:, 1], whole=sizes <= SMALL,
                    tokens=[_signed(s if len(s) <= SMALL else s[s < limit]) for s in made], bits=[sketch(s) for s in made])

    kind = "string" if docs.schema["doc_id"].dataType.simpleString() == "string" else "long"
    return docs.mapInPandas(measure, f"doc_id {kind}, text_key string, n long, d1 long, d2 long, whole boolean, tokens array<long>, bits array<long>")


def tokens_of(docs: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """(text_key, all tokens) of the texts whose digest is in ``keys``. No text is shuffled."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(flags_of(keys.select(F.xxhash64("text_key").alias("h")), "h"))

    @releasing
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags, known = read_flags(wanted.value), _Words()
        for pdf in batches:
            hashes = pdf["h"].to_numpy(np.int64).view(np.uint64)
            pdf = pdf[flags[hashes >> np.uint64(64 - BITS)]].drop_duplicates("text_key")
            for at in range(0, len(pdf), 1000):
                own = pdf.iloc[at : at + 1000]
                yield pd.DataFrame({"text_key": own["text_key"], "tokens": [_signed(shingles(t, width, known)) for t in own["text"]]})

    made = docs.where(F.col("text").isNotNull()).select("text_key", F.xxhash64("text_key").alias("h"), "text").mapInPandas(measure, "text_key string, tokens array<long>")
    return made.join(keys, "text_key", "left_semi").groupBy("text_key").agg(F.first("tokens").alias("tokens"))


def _index(sets: DataFrame, keys_of: Callable[[], Callable[[np.ndarray, int], np.ndarray | None]]) -> DataFrame:
    """sets(sid, n, tokens) -> (key, sid, n); key NULL: the set needs all its tokens. ``keys_of`` is called once a partition."""

    @releasing
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys_for = keys_of()
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                own = pdf.iloc[at : at + 1000]
                keys, sids, sizes, lacking = [], [], [], []
                for sid, n, tokens in zip(own["sid"].tolist(), own["n"].tolist(), own["tokens"], strict=True):
                    made = keys_for(np.sort(np.asarray(tokens, np.int64).view(np.uint64)), n)
                    if made is None:
                        lacking.append((sid, n))
                    else:
                        keys.append(made), sids.append(np.full(len(made), sid)), sizes.append(np.full(len(made), n))
                if keys:
                    yield pd.DataFrame({"key": pd.array(_signed(np.concatenate(keys)), "Int64"), "sid": np.concatenate(sids), "n": np.concatenate(sizes)})
                if lacking:
                    yield pd.DataFrame({"key": pd.array([pd.NA] * len(lacking), "Int64"), "sid": [s for s, _ in lacking], "n": [n for _, n in lacking]})

    return sets.select("sid", "n", "tokens").mapInPandas(index, "key long, sid long, n long")


def rare_postings(sets: DataFrame, percent: int, table) -> DataFrame:
    """Postings of the sets whose rare low tokens fill their prefix."""

    def keys_of() -> Callable[[np.ndarray, int], np.ndarray | None]:
        frequent = read_flags(table.value)
        return lambda tokens, n: rare_keys(tokens, n, percent, frequent)

    return _index(sets, keys_of)


def all_postings(sets: DataFrame, percent: int, table, table_here) -> DataFrame:
    """Postings of sets(sid, n, tokens) with all their tokens."""

    def keys_of() -> Callable[[np.ndarray, int], np.ndarray]:
        frequent, frequent_here = read_flags(table.value), read_flags(table_here.value)
        return lambda tokens, n: all_keys(tokens, percent, frequent, frequent_here)

    return _index(sets, keys_of)


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, root): alternating large and small stars until nothing changes; root is the least node."""
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        # u > v holds for every edge, so all of u's neighbours here are smaller ones
        joined = large.join(small, "u")
        edges = cut_lineage(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def similar(overlap: Column, na: Column, nb: Column, percent: int) -> Column:
    return (100 + percent) * overlap >= percent * (na + nb)


def differences(sets: DataFrame, percent: int) -> DataFrame:
    """sets(c, tc, sid, n, tokens): sets under leaders c with tokens tc -> with far, and the differences by which a set is found.

    For a leader C, let r be the tokens of C that a set lacks, d those it has beside C and i what it shares with C. If A and B are similar and
    A is not similar to C (far), they share at least s of their differences r and d together, and of d alone at least u:

    * s > (100 |r of B| + percent |d of B|) / (100 + percent), from |A and B| = |C| - |r of A| - |r of B| + s;
    * s >= percent |A| / 100 - i of A, and u >= percent |X| / 100 - i of X for either set X, as similar sets share percent of each.

    All differences are in one order, d before r. The first that A and B share is among the first |r| + |d| - s + 1 of either, and, if u > 0,
    among its first |d| - u + 1. ``seek`` has them for a far set as A, ``found`` for any set as B.
    """
    more, less = F.sort_array(F.array_except("tokens", "tc")), F.sort_array(F.array_except("tc", "tokens"))
    parts = sets.select("c", "sid", "n", F.size("tc").cast("long").alias("nc"), more.alias("d"), less.alias("r"))
    nd, nr = F.size("d").cast("long"), F.size("r").cast("long")
    both = F.col("nc") - nr
    lacks = F.expr(f"(n * {percent} + 99) div 100") - both
    far = ~similar(both, F.col("n"), F.col("nc"), percent)
    alone = F.when(lacks >= 1, nd - lacks + 1).otherwise(nd + nr)
    as_a = F.least(nd + nr - F.greatest(F.lit(1), lacks) + 1, alone)
    as_b = F.least(nd + nr - F.floor((100 * nr + percent * nd) / (100 + percent)), alone)
    of = lambda k: F.slice(F.concat("d", "r"), F.lit(1), F.greatest(F.lit(0), k).cast("int"))
    return parts.select("c", "sid", "n", far.alias("far"), F.when(far, of(as_a)).alias("seek"), of(as_b).alias("found"))


class Verifier:
    """Tests candidate pairs; texts are read again only for sets whose low tokens cannot decide."""

    def __init__(self, docs: DataFrame, sets: DataFrame, width: int, percent: int):
        self.docs, self.sets, self.width, self.percent = docs, sets, width, percent
        self.have: DataFrame | None = None

    def links(self, pairs: DataFrame) -> DataFrame:
        """pairs(a, b) -> those that are similar."""
        s = self.sets.select("sid", "n", "whole", "tokens")
        both = pairs.join(s.toDF("a", "na", "wa", "ta"), "a").join(s.toDF("b", "nb", "wb", "tb"), "b")
        low = F.size(F.array_intersect("ta", "tb"))
        rest = [F.when(F.col(w), F.col(n)).otherwise(F.col(n) - F.size(t)) for w, n, t in (("wa", "na", "ta"), ("wb", "nb", "tb"))]
        sure = F.col("wa") & F.col("wb")
        most = F.when(sure, low).otherwise(low + F.least(*rest))
        kept = cut_lineage(both.where(similar(most, F.col("na"), F.col("nb"), self.percent)).select("a", "b", "na", "nb", sure.alias("sure")))
        found, open_ = kept.where("sure").select("a", "b"), kept.where("not sure")
        ids = open_.select(F.col("a").alias("sid")).union(open_.select(F.col("b").alias("sid"))).distinct()
        if self.have is not None:
            ids = ids.join(self.have, "sid", "left_anti")
        ids = cut_lineage(ids.join(self.sets.select("sid", "text_key"), "sid"))
        if not ids.isEmpty():
            made = cut_lineage(tokens_of(self.docs, ids.select("text_key").distinct(), self.width).join(ids, "text_key").select("sid", "tokens"))
            self.have = made if self.have is None else self.have.union(made)
        if self.have is None:
            return found
        tested = open_.join(self.have.toDF("a", "ta"), "a").join(self.have.toDF("b", "tb"), "b")
        overlap = F.size(F.array_intersect("ta", "tb"))
        return found.union(tested.where(similar(overlap, F.col("na"), F.col("nb"), self.percent)).select("a", "b"))


def near_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, text_key, n_shingles, component_id), one row per row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.md5("text").alias("text_key"))
    signed = cut_lineage(signatures(docs, width, percent))
    sets = cut_lineage(signed.where("n > 0").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("whole").alias("whole"), F.first("tokens").alias("tokens"), F.first("bits").alias("bits"), F.min("text_key").alias("text_key"),
    ).withColumn("sid", F.monotonically_increasing_id()))
    wide, signed = signed, cut_lineage(signed.select("doc_id", "text_key", "n", "d1", "d2"))
    release(wide)
    limit = F.lit(int(low_limit(percent)) - (1 << 63))
    is_low = F.col("t").bitwiseXOR(F.lit(-(1 << 63))) < limit

    def often(tokens: DataFrame) -> Broadcast:
        held = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > RARE)
        return spark.sparkContext.broadcast(flags_of(held, "t"))

    table = often(sets.select(F.explode("tokens").alias("t")).where(is_low))
    first = cut_lineage(rare_postings(sets, percent, table))
    lacking = cut_lineage(first.where("key is null").select("sid").join(sets.select("sid", "n", "text_key", "whole", F.when(F.col("whole"), F.col("tokens")).alias("own")), "sid"))
    index = first.where("key is not null")
    more = full = None
    if not lacking.isEmpty():
        read = tokens_of(docs, lacking.where("not whole").select("text_key").distinct(), width).join(lacking.where("not whole"), "text_key")
        full = cut_lineage(read.select("sid", "n", "tokens").union(lacking.where("whole").select("sid", "n", F.col("own").alias("tokens"))))
        # only these sets are indexed by other than low tokens, so rare among them will do
        table_here = often(full.select(F.explode("tokens").alias("t")).where(~is_low))
        more = cut_lineage(all_postings(full, percent, table, table_here))
        index = index.withColumn("read", F.lit(False)).union(more.withColumn("read", F.lit(True)))
    else:
        index = index.withColumn("read", F.lit(False))
    of_key = index.groupBy("key").agg(F.count(F.lit(1)).alias("c"), *[F.bit_xor(F.xxhash64("sid", F.lit(i))).alias(f"h{i}") for i in (1, 2)], F.min("read").alias("read"))
    # one of the keys that the same sets hold; one that more than RARE sets hold is a pair of tokens, so all tokens of its sets are at hand
    several = of_key.where("c > 1").groupBy("c", "h1", "h2").agg(F.min("key").alias("key"), F.min("read").alias("read"))
    held_by = cut_lineage(index.drop("read").join(several.select("key", "c", (F.col("read") & (F.col("c") > RARE)).alias("large")), "key"))
    # the leader of a key is the set whose keys are held most: in the middle of a group of near copies
    weights = held_by.groupBy("sid").agg(F.sum("c").alias("weight"))
    shared = cut_lineage(held_by.drop("c").join(weights, "sid"))
    # only sets that share a key are compared
    held = cut_lineage(sets.join(shared.select("sid").distinct(), "sid", "left_semi"))
    wide, sets = sets, cut_lineage(sets.select("sid", "d1", "d2", "rep"))
    release(first, more, lacking, wide, held_by)
    check = Verifier(docs, held, width, percent)
    fits = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    links = tested = roots = None
    for turn in ("leader", "rest"):
        now = shared
        if roots is not None:
            now = shared.join(roots.toDF("sid", "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
            split = now.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
            now = cut_lineage(now.join(split, "key", "left_semi"))
        else:
            now = now.withColumn("root", F.col("sid"))
        lead = now.groupBy("key").agg(F.max(F.struct("weight", "sid", "n", "root")).alias("l"))
        if turn == "leader":
            paired = now.join(lead, "key").select("sid", "n", "root", F.col("l.sid").alias("sid2"), F.col("l.n").alias("n2"), F.col("l.root").alias("root2"))
        else:
            small = now.where("not large").join(held.select("sid", "bits"), "sid")
            per = small.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
            main = per.groupBy("key").agg(F.max(F.struct("c", "root")).alias("m")).select("key", F.col("m.root").alias("main"))
            few = small.join(main, "key").where("root <> main").select("key", "main", F.col("sid").alias("sid2"), F.col("n").alias("n2"), F.col("root").alias("root2"), F.col("bits").alias("bits2"))
            # sets that their sketches tell apart are no pair
            far = ~similar(most_shared("bits", "bits2", F.col("n"), F.col("n2")), F.col("n"), F.col("n2"), percent)
            once = (F.col("root") == F.col("main")) | (F.col("sid") < F.col("sid2"))
            paired = small.join(few, "key").where(once & ~far).select("sid", "n", "root", "sid2", "n2", "root2")
            if full is not None:
                led = now.where("large").join(lead, "key").select(F.col("l.sid").alias("c"), "sid", "root").distinct()
                tokens = full.select("sid", "n", "tokens")
                apart = differences(led.select("c", "sid").join(tokens, "sid").join(tokens.select(F.col("sid").alias("c"), F.col("tokens").alias("tc")), "c"), percent)
                apart = cut_lineage(apart.join(led, ["c", "sid"]))
                seek = apart.where("far").select("c", "sid", "n", "root", F.explode("seek").alias("t"))
                found = apart.select("c", F.col("sid").alias("sid2"), F.col("n").alias("n2"), F.col("root").alias("root2"), F.explode("found").alias("t"))
                paired = paired.union(seek.join(found, ["c", "t"]).select("sid", "n", "root", "sid2", "n2", "root2"))
        pairs = paired.where((F.col("root") != F.col("root2")) & fits(F.col("n"), F.col("n2"))).select(F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs)
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.union(pairs)
        found = cut_lineage(check.links(pairs))
        links = found if links is None else links.union(found)
        roots = cut_lineage(components(links))
    if roots is None:
        best = sets.select("d1", "d2", F.col("rep").alias("component_id"))
    else:
        rooted = sets.select("sid", "d1", "d2", "rep").join(roots.toDF("sid", "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
        best = rooted.join(least, "root").select("d1", "d2", "component_id")
    out = signed.select("doc_id", "text_key", "n", "d1", "d2")
    kept = out.where("n > 0").join(best, ["d1", "d2"]).select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id")
    return kept.union(out.where("n = 0").select("doc_id", "text_key", F.col("n"), F.col("doc_id")))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component of near-equal texts; texts without a word all stay.

    The one that stays has the smallest doc_id (NULL last), then the smallest text digest; of equal rows with that id
    and text one stays. Texts are shuffled only if a table of fixed size says that they may belong to a group.
    """
    key, may_go, own, own_key = fresh(docs, "text_key", "may_go", "own_id", "own_key")
    # texts stand for themselves by their digest, so NULL and repeated ids are told apart
    named = near_components(docs.select(F.md5("text").alias("doc_id"), "text"), width, percent)
    classes = cut_lineage(named.where("n_shingles > 0").select("text_key", "component_id").distinct())
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.md5("text").alias("text_key"))
    members = rows.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("m")).join(classes, "text_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_key")).alias("b")
    best = cut_lineage(members.groupBy("component_id").agg(first, F.sum("m").alias("m")))
    groups = classes.join(best.where("m > 1").select("component_id"), "component_id")
    flags = docs.sparkSession.sparkContext.broadcast(flags_of(groups.select(F.xxhash64("text_key").alias("h")), "h"))

    @F.pandas_udf("boolean")
    def in_group(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = read_flags(flags.value)
        for h in batches:
            yield pd.Series(table[h.to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - BITS)])

    keyed = docs.withColumn(key, F.md5("text")).withColumn(may_go, in_group(F.xxhash64(key)) & F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    stay = best.select(F.col("b.doc_id").alias(own), F.col("b.text_key").alias(own_key))
    chosen = keyed.where(may_go).join(stay, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(key) == F.col(own_key)), "left_semi")
    return keyed.where(~F.col(may_go)).select(*docs.columns).union(chosen.dropDuplicates(["doc_id", key]).select(*docs.columns))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 4-word shingles and a similarity of 0.85."""
    return near_components(load_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
