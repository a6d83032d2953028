"""N-gram Jaccard join by T-occurrence search.

Two sets of sizes n and m with the wanted Jaccard index share T elements at least. DivideSkip parts
the n inverted lists of a set's elements, in the order of their lengths: the L longest, with
L = T / (MU * log2(longest list) + 1), are only probed, the others merged. A partner
must occur in T - L of the merged ones, which for both sets are their rarest elements, so only
these are posted. What reaches that many is then probed by binary search for all elements and kept if
it reaches the overlap. Lengths are counts over the whole corpus, in a sketch of fixed size; any order gives the same
result, a rough one only more candidates.

Equal sets are one class, which takes part once. First each class is tried
against two hubs of each of its lists: the member that shares most elements, so the middle of a
group of near copies, and the lowest in a random order. This joins large groups without forming
their pairs. Then every class that has lists with other components left searches them: what can link of each
list (dealt in blocks of LIST) comes to it in order, and a heap merges these lists.
Candidates are sifted by size, place in the list and parity: sets whose bucket parities (two
buckets for each element at least) differ in more places than the sets may differ in elements
cannot link.

Elements are 64-bit hashes, and so are classes: among c classes chance merges two with odds of
c * c / 2 ** 65.

Null text, and text without words, has no shingle and links with nothing. Repeated rows (of the
same doc_id too) are copies. Null ids name no component but their own. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import Bits
from .rolling import mixed

#: Counters of the corpus sketch, and how many a row of it holds.
SKETCH, BLOCK = 1 << 20, 1 << 12
#: Hubs that a class is tried against before it searches the lists that are left.
PARTNERS = 8
#: DivideSkip's weight of a list's length, and classes of a list that are searched at once.
MU, LIST = 0.002, 1_024


def shingles(text: str, width: int) -> np.ndarray:
    """Hashes of the distinct runs of width words, in rising order; of all words where they are fewer."""
    words = text.encode().lower().split()  # of bytes: A-Z alone is lowered, and the six ASCII spaces split
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out ^ (h[k : len(h) - width + 1 + k] + np.uint64(k)))
    return np.unique(out)


def class_id(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


class Threshold:
    """A Jaccard index of num / den at least."""

    def __init__(self, num: int, den: int, longest: int = 1):
        self.num, self.den = num, den
        self.probe = 1 / (MU * math.log2(max(2, longest)) + 1)

    def merged(self, n: int) -> int:
        """In how many of the merged lists a partner of a set of n occurs at least: T - L."""
        t = -(-self.num * n // self.den)
        return max(1, t - int(t * self.probe))

    def short(self, n: int) -> int:
        """Number of lists to merge for a set of n."""
        return n - -(-self.num * n // self.den) + self.merged(n)

    def overlap(self, n: Column, m: Column) -> Column:
        """Least overlap of sets of n and m."""
        return F.ceil(self.num * (n + m) / F.lit(self.num + self.den))

    def reached(self, both: int, n: int, m: int) -> bool:
        return self.den * both >= self.num * (n + m - both)


def parities(s: np.ndarray) -> np.ndarray:
    """Whether each of 2**k buckets, at least 256 and two for each element, holds an odd number of elements; as longs."""
    size = max(256, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def odd_between(x: Column, y: Column) -> Column:
    """In how many buckets two parities differ; one of twice the size is folded."""

    def folded(long: Column, short: Column) -> Column:
        halves = F.zip_with(F.slice(long, 1, F.size(short)), F.slice(long, F.size(short) + 1, F.size(short)), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(long) == 2 * F.size(short), halves).otherwise(long)

    return F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)


def measured(docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, text_hash, n, class) of every document, and the sketch: how often elements of each counter occur in the corpus."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SKETCH, np.int64)
        for f in frames:
            sets = [shingles(t, width) for t in f["text"]]
            if any(len(s) for s in sets):
                at, n = np.unique(counter(np.concatenate(sets)), return_counts=True)
                counts[at] += n
            yield pd.DataFrame({"doc_id": f["doc_id"], "text_hash": f["text_hash"], "n": [len(s) for s in sets], "class": [class_id(s) for s in sets], "block": -1, "counts": b""})
        if len(at := np.flatnonzero(counts.reshape(-1, BLOCK).any(axis=1))):
            packed = [zlib.compress(counts[k * BLOCK : (k + 1) * BLOCK].tobytes(), 1) for k in at]
            yield pd.DataFrame({"doc_id": -1, "text_hash": 0, "n": 0, "class": 0, "block": at, "counts": packed})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.int64)
        for x in f["counts"]:
            total += np.frombuffer(zlib.decompress(x), np.int64)
        return pd.DataFrame({"block": [f["block"].iloc[0]], "counts": [total.tobytes()]})

    rows = common.stored(docs.mapInPandas(run, "doc_id long, text_hash long, n long, class long, block int, counts binary"))
    sketch = np.zeros(SKETCH, np.int64)
    for r in rows.filter("block >= 0").groupBy("block").applyInPandas(add, "block int, counts binary").collect():
        sketch[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.int64)
    return common.own_ids(rows.filter("block < 0")).select("doc_id", "text_hash", "n", "class"), sketch


def counter(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(44)).astype(np.int64)


def short_lists(s: np.ndarray, sketch: np.ndarray, least: Threshold) -> np.ndarray:
    """The set's rarest elements, whose lists are merged."""
    return s[np.lexsort((s, sketch[counter(s)]))[: least.short(len(s))]]


def candidates(docs: DataFrame, sketch: np.ndarray, width: int, least: Threshold) -> DataFrame:
    """Classes that share a short list with another: class, n, parities, elements and their places. Copies can come more than once."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def lists(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sets = {class_id(s): s for t in f["text"] if len(s := shingles(t, width))}
            if sets:
                short = {c: short_lists(s, sent.value, least) for c, s in sets.items()}
                yield pd.DataFrame({"element": np.concatenate(list(short.values())).astype(np.int64), "class": np.repeat(list(short), [len(x) for x in short.values()])})

    shared = docs.mapInPandas(lists, "element long, class long").groupBy("element").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high")
    bits = Bits(common.stored(shared.select("element")), "element", 28)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[int] = set()
        for f in frames:
            rows = []
            for t in f["text"]:
                s = shingles(t, width)
                if not len(s) or (c := class_id(s)) in done:
                    continue
                if len(done) < 1_000_000:
                    done.add(c)
                short = short_lists(s, sent.value, least)
                at = np.flatnonzero(bits.has(short))
                if len(at):
                    rows.append((c, len(s), least.merged(len(s)), parities(s), short[at].astype(np.int64), at.astype(np.int32)))
            if rows:
                yield pd.DataFrame(rows, columns=["class", "n", "least", "odd", "elements", "places"])

    return docs.mapInPandas(run, "class long, n long, least long, odd array<long>, elements array<long>, places array<int>")


def possible(pairs: DataFrame, light: DataFrame, least: Threshold) -> DataFrame:
    """Of the pairs (a, b) of classes those that sizes and parities allow."""
    one = light.select(F.col("class").alias("a"), F.struct("n", "odd").alias("x"))
    two = light.select(F.col("class").alias("b"), F.struct("n", "odd").alias("y"))
    need = least.overlap(F.col("x.n"), F.col("y.n"))
    parity = F.when(sized("x.n", "y.n", least), odd_between(F.col("x.odd"), F.col("y.odd")) <= F.col("x.n") + F.col("y.n") - 2 * need)
    return pairs.join(one, "a").join(two, "b").filter(parity).select("a", "b")


def sets_of(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(class, set) of all classes in the pairs, from one document of each; only these are shingled again."""
    ids = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    one = common.stored(ids.join(classes, "class").select("class", F.xxhash64(F.coalesce("least", F.lit(common.NO_ID))).alias("key")))
    keys, names = Bits(one, "key"), Bits(one, "class")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sets = {class_id(s): s for t in f["text"][keys.has(f["key"].to_numpy())] if len(s := shingles(t, width))}
            if sets and (own := names.has(np.array(list(sets)))).any():
                yield pd.DataFrame([(c, s.tobytes()) for (c, s), x in zip(sets.items(), own, strict=True) if x], columns=["class", "set"])

    keyed = docs.select(F.xxhash64("doc_id").alias("key"), "text")
    return keyed.mapInPandas(run, "class long, set binary").groupBy("class").agg(F.first("set").alias("set"))


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, least: Threshold) -> DataFrame:
    """Of the pairs (a, b) those that link; b's set goes to a's, which probes it by binary search."""
    part = F.when(F.count("*").over(Window.partitionBy("a")) > LIST, F.pmod(F.xxhash64("b"), F.lit(64))).otherwise(0)
    pairs = common.stored(pairs.withColumn("part", part.cast("int")))
    sets = common.stored(sets_of(pairs, docs, classes, width))
    own = sets.join(pairs.select(F.col("a").alias("class"), "part").distinct(), "class").select(F.col("class").alias("a"), "part", F.col("class").alias("b"), "set")
    other = pairs.join(sets, pairs["b"] == sets["class"]).select("a", "part", "b", "set")
    lined = own.unionByName(other).repartition(common.partitions(pairs.sparkSession), "a", "part").sortWithinPartitions("a", "part", F.col("a") != F.col("b"), "b")

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = np.zeros(0, np.uint64)
        for f in frames:
            out = []
            for a, b, s in zip(f["a"], f["b"], f["set"], strict=True):
                y = np.frombuffer(s, np.uint64)
                if a == b:  # the class itself, before its partners
                    x = y
                    continue
                few, many = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(many, few), len(many) - 1)
                if least.reached(int((many[at] == few).sum()), len(x), len(y)):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return common.stored(lined.mapInPandas(probe, "a long, b long"))


def links(docs: DataFrame, classes: DataFrame, sketch: np.ndarray, width: int, least: Threshold) -> DataFrame:
    """Edges (a, b) between classes that have the components of all links. classes: class, least doc_id."""
    found = candidates(docs, sketch, width, least)
    light = common.stored(found.select("class", "n", "least", "odd", F.arrays_zip("elements", "places").alias("lists")).dropDuplicates(["class"]))
    posted = light.select("class", F.size("lists").alias("shared"), F.explode("lists.elements").alias("element"))
    low = F.shiftrightunsigned(F.xxhash64("class"), 24)  # 40 bits that order at random; the share of elements goes before them
    orders = [low - F.shiftleft(F.col("shared").cast("long"), 40), low]
    lowest = [F.min(F.struct(o.alias("draw"), F.col("class").alias("hub"))).alias(f"h{k}") for k, o in enumerate(orders)]
    hubs = posted.groupBy("element").agg(*lowest, F.count("*").alias("n")).filter("n > 1")
    hubs = hubs.select("element", F.array_distinct(F.array(*[f"h{k}.hub" for k in range(len(orders))])).alias("hubs"))
    stars = posted.join(hubs, "element").select(F.col("class").alias("a"), F.explode("hubs").alias("b")).filter("a <> b").distinct()
    draw = Window.partitionBy("a").orderBy(F.xxhash64("a", "b"))
    tries = possible(stars, light, least).withColumn("k", F.row_number().over(draw)).filter(F.col("k") <= PARTNERS)
    edges = verified(tries.select("a", "b"), docs, classes, width, least)
    roots = common.components(edges)
    named = light.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select("class", "n", "least", F.coalesce("root", "class").alias("root"), F.explode("lists").alias("e"))
    named = named.select("class", "n", "least", "root", F.col("e.elements").alias("element"), F.col("e.places").alias("place"))
    open_lists = named.groupBy("element").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / LIST).cast("int").alias("blocks")).filter("low <> high").select("element", "blocks")
    left = named.join(open_lists, "element").withColumn("parts", F.max("blocks").over(Window.partitionBy("class")))
    pairs = searched(common.stored(left), least)
    return edges.unionByName(verified(possible(pairs, light, least), docs, classes, width, least))


def searched(left: DataFrame, least: Threshold) -> DataFrame:
    """Pairs (a, b) of classes of different components that occur in enough of each other's merged lists. left: element, blocks, class, parts, n, least, root, place."""
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block")
    entry = F.struct("class", "n", "least", "root", "place")
    lists = left.select("element", "blocks", block, entry.alias("x")).groupBy("element", "blocks", "block").agg(F.sort_array(F.collect_list("x")).alias("list"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    lists = lists.select("element", "block", every.alias("own"), "list")
    each = left.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("block", every)
    met = each.join(lists, ["element", "block", "own"])  # a block of a list meets one block of the classes that search it

    def fits(y: Column) -> Column:
        need = F.ceil(least.num * (F.col("n") + y["n"]) / F.lit(least.num + least.den))
        reach = F.least(F.col("n") - F.col("place"), y["n"] - y["place"]) + F.least(F.col("least"), y["least"]) - 1 >= need  # some of the elements that they share come before
        close = (least.num * F.col("n") <= least.den * y["n"]) & (least.num * y["n"] <= least.den * F.col("n"))
        return (y["class"] > F.col("class")) & (y["root"] != F.col("root")) & close & reach

    few = F.transform(F.filter("list", fits), lambda y: F.struct(y["class"].alias("class"), F.least(F.col("least"), y["least"]).alias("least")))
    found = met.select("class", "parts", few.alias("list")).filter(F.size("list") > 0)
    split = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.filter("list", lambda y: F.pmod(F.xxhash64(y["class"]), F.col("parts")) == k))
    found = found.select("class", F.posexplode(split).alias("part", "list")).filter(F.size("list") > 0)
    lined = found.repartition(common.partitions(left.sparkSession), "class", "part").sortWithinPartitions("class", "part")

    def merge(lists: list) -> list[int]:
        merged = heapq.merge(*[[(x["class"], x["least"]) for x in one] for one in lists])
        return [c for (c, enough), same in groupby(merged) if sum(1 for _ in same) >= enough]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for f in frames:
            out = []
            for own, part, one in zip(f["class"], f["part"], f["list"], strict=True):
                if held and (own, part) != key:
                    out += [(key[0], b) for b in merge(held)]
                    held = []
                key = own, part
                held.append(one)
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])
        if held:
            yield pd.DataFrame({"a": key[0], "b": merge(held)}).astype("int64")

    return lined.mapInPandas(search, "a long, b long")


def sized(n: str, m: str, least: Threshold) -> Column:
    return (least.num * F.col(n) <= least.den * F.col(m)) & (least.num * F.col(m) <= least.den * F.col(n))


def grouped(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, text_hash, n_shingles, root) of every row: root names its component, null without shingles; text_hash is xxhash64 of the text (null: empty)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = common.texts(docs, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    rows, sketch = measured(docs, width)

    def roots() -> DataFrame:
        classes = common.stored(rows.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("least")))
        return common.components(links(docs, classes, sketch, width, Threshold(num, den, int(sketch.max()))))

    found = common.settled(spark, roots).select(F.col("node").alias("class"), "root")
    root = F.when(F.col("n") > 0, F.coalesce("root", "class"))
    return rows.join(found, "class", "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), root.alias("root"))


def components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id that links lead to, the own one included."""
    rows = grouped(docs, width, num, den)
    least = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Query: components of all documents by 4-word shingles and a Jaccard index of 0.85."""
    return components(common.table(spark, sf_dir, "documents"), 4, 85, 100)
