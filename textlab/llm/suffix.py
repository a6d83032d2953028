"""Removal of strings that occur elsewhere, by blockwise sorting of suffix buckets with a difference cover.

A text is a row of symbols, bytes or words. Sampled are the places whose number modulo v lies in a
difference cover: any two places then have an offset below v at which both are sampled, so equal
strings of `length` symbols hold an aligned pair of samples with length - v + 1 equal symbols after
them. These leading symbols, the gram, make the bucket of a sampled suffix; buckets of one fall away.

The rank of a sample is precomputed from its context, the v - 1 symbols before it and the length
from it on: samples of one rank tie as far as any string reaches that passes them, so all strings
of their contexts are repeated, and one sample of a rank stands for all in the sort. A task then
sorts one bucket at a time: the suffixes in symbol order with the common prefixes of neighbours,
the symbols before them likewise. A string that starts d symbols before a sample is repeated if
its d symbols tie with another's in one order and the rest in the other; the sort never
looks beyond the contexts, so memory is bounded by BUCKET of them, however long a tie is. A larger
bucket is dealt into parts, and what a part leaves open is matched with one of each string of the
other parts, by what RUN neighbouring strings share, then string by string.

Grams, contexts and strings matched between parts are compared by 64-bit hashes, everything else by its symbols.
Null text counts as empty; texts under `length` symbols lose nothing; matches never cross
documents. Repeated rows are copies of each other and lose all that is long enough. Null ids are
ids. An empty table gives no rows. Long texts are worked through in blocks of BLOCK symbols.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Bits, merged
from .rolling import as_words, between, mixed, prefix, word_spans

#: Bytes of a string, and least symbols of a gram.
LENGTH, GRAM = 400, 64
#: Segments of a bucket that one task sorts at once, and neighbouring strings that are matched together between parts.
BUCKET, RUN = 1_024, 16
#: Symbols of a text that are hashed at once, hashes that a task sorts before it sends them, and tasks' shares of hashes for each shuffle partition.
BLOCK, HELD, SHARES = 1 << 19, 1 << 20, 4
#: Symbols of segments that a task holds at once, and bits of a place within the stretch of a text whose strings are gathered together.
SORTED, STRETCH = 4 << 20, 12

Symbols = Callable[[bytes], np.ndarray]


def row_key(doc_id, data: bytes) -> int:
    """A hash of the document's id and bytes."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(repr(doc_id).encode() + b"\0" + data)).astype(np.int64))


def as_bytes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


@functools.cache
def cover(most: int) -> tuple[int, np.ndarray]:
    """(v, residues): a difference cover modulo v, most at most, from the lines of a projective plane of prime order."""
    for q in (17, 13, 11, 7, 5, 3, 2):
        v = q * q + q + 1
        if v > most:
            continue
        for a, b, c in itertools.product(range(q), range(q), range(1, q)):  # powers of x modulo x^3 = a x^2 + b x + c
            x, on_line = (1, 0, 0), []
            for k in range(v):
                if not x[2]:
                    on_line.append(k)
                x = (c * x[2] % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
            if len(on_line) == q + 1 and len({(i - j) % v for i in on_line for j in on_line}) == v:
                return v, np.array(on_line)
    return 1, np.zeros(1, np.int64)


def sampled(symbols: np.ndarray, length: int, v: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Block by block: hashes of the sampled grams, their places, prefix sums and where these start."""
    residues = cover(v)[1]
    gram, n = length - v + 1, len(symbols)
    if n < length:
        return
    for base in range(0, n, BLOCK):
        low, high = max(0, base - v + 1), min(n, base + BLOCK + length)
        rounds = np.arange(base // v, min(n, base + BLOCK) // v + 1) * v
        place = (rounds[:, None] + residues[None, :]).ravel()
        place = place[(place >= base) & (place < base + BLOCK) & (place + gram <= n)]
        if len(place):
            sums = prefix(symbols[low:high])
            yield mixed(between(sums, place - low, place - low + gram)), place, sums, low


def contexts(place: np.ndarray, n: int, length: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last symbol (exclusive) of all strings that have each place among their first v symbols."""
    return np.maximum(0, place - v + 1), np.minimum(n, place + length)


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Spans covered by strings that start at the rising places."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist(), strict=True))


def dealt(values: np.ndarray, shares: int) -> np.ndarray:
    """The share of each hash; rises with the hash."""
    return ((values >> np.uint64(40)) * np.uint64(shares) >> np.uint64(24)).astype(np.int64)


def blobs(values: np.ndarray, order: np.ndarray, shares: int) -> Iterator[tuple[int, bytes]]:
    """The values by their share, which follows order; both rise together."""
    share = dealt(order, shares)
    cut = np.flatnonzero(np.diff(share, prepend=-1))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(share)], strict=True):
        yield int(share[a]), values[a:b].tobytes()


RANKED = np.dtype([("rank", "<u8"), ("gram", "<i8"), ("row", "<i8"), ("place", "<i4"), ("a", "<i4"), ("b", "<i4")])
COVER = np.dtype([("row", "<i8"), ("a", "<i4"), ("b", "<i4")])


def found_twice(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of RANKED rows in the order of their ranks: one of each rank, and COVER rows of all of a rank that comes twice."""
    lead = np.diff(x["rank"], prepend=~x["rank"][:1]) != 0
    again = ~lead
    again[:-1] |= again[1:]
    return x[lead], x[again][list(COVER.names)].astype(COVER)


def covers(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET, symbols: Symbols = as_bytes) -> DataFrame:
    """(row, a, b): by row_key() the spans of symbols that repeated strings cover, which may overlap; docs: doc_id, text."""
    spark = docs.sparkSession
    v = cover(max(1, length - gram + 1))[0]
    shares = SHARES * common.partitions(spark)

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pd.DataFrame:
            h = np.sort(np.concatenate(held))
            few = h[np.append([True, True], h[2:] != h[:-2])[: len(h)]]  # two of a kind say all
            return pd.DataFrame(blobs(few, few, shares), columns=["share", "data"])

        for f in frames:
            for t in f["text"]:
                for h, *_ in sampled(symbols(t.encode()), length, v):
                    held.append(h)
                    size += len(h)
                if size > HELD:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def shared(f: pd.DataFrame) -> pd.DataFrame:
        h = np.sort(np.frombuffer(b"".join(f["data"]), "<u8"))
        return pd.DataFrame({"gram": np.unique(h[1:][h[1:] == h[:-1]]).astype(np.int64)})

    gram_bits = Bits(common.stored(docs.mapInPandas(grams, "share int, data binary").groupBy("share").applyInPandas(shared, "gram long")), "gram", 28)

    def ranked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pd.DataFrame:
            x = np.concatenate(held)
            ones, covers = found_twice(x[np.argsort(x["rank"], kind="stable")])
            rows = list(blobs(ones, ones["rank"], shares))
            return pd.DataFrame([*rows, (-1, covers.tobytes())], columns=["share", "data"])

        for f in frames:
            for d, t in zip(f["doc_id"], f["text"], strict=True):
                data = t.encode()
                s, row = symbols(data), None
                for h, place, sums, low in sampled(s, length, v):
                    hit = np.flatnonzero(gram_bits.has(h))
                    if not len(hit):
                        continue
                    row = row_key(d, data) if row is None else row
                    place = place[hit]
                    a, b = contexts(place, len(s), length, v)
                    x = np.empty(len(hit), RANKED)
                    shape = ((place - a) << 20 | (b - a)).astype(np.uint64)
                    x["rank"] = mixed(between(sums, a - low, b - low) ^ mixed(shape))
                    x["gram"], x["row"], x["place"], x["a"], x["b"] = h[hit].astype(np.int64), row, place, a, b
                    held.append(x)
                    size += len(x)
                if size > HELD // 4:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    met = common.stored(docs.mapInPandas(ranked, "share int, data binary"))
    gram_bits.drop()

    def equal(f: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(f["data"]), RANKED)
        ones, covers = found_twice(x[np.argsort(x["rank"], kind="stable")])
        one = pd.DataFrame({"gram": ones["gram"], "row": ones["row"], "place": ones["place"], "a": 0, "b": 0})
        return pd.concat([one, pd.DataFrame({"gram": 0, "row": covers["row"], "place": -1, "a": covers["a"], "b": covers["b"]})])

    ranks = common.stored(met.filter("share >= 0").groupBy("share").applyInPandas(equal, "gram long, row long, place int, a int, b int"))

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for x in f["data"]:
                yield pd.DataFrame(np.frombuffer(x, COVER))

    out = ranks.filter("place < 0").select("row", "a", "b").unionByName(met.filter("share < 0").mapInPandas(opened, "row long, a int, b int"))
    ones = ranks.filter("place >= 0").select("gram", "row", "place")
    buckets = common.stored(ones.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram", F.ceil(F.col("n") / bucket).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("row", "place"), F.col("parts")).cast("int").alias("part")
    wanted = common.stored(ones.join(buckets, "gram").select("row", F.struct("gram", "place", part, "parts").alias("at")).groupBy("row").agg(F.collect_set("at").alias("at")))
    row_bits = Bits(wanted, "row")

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            data = [t.encode() for t in f["text"]]
            rows = np.array([row_key(d, x) for d, x in zip(f["doc_id"], data, strict=True)], np.int64)
            own = np.flatnonzero(row_bits.has(rows))
            if len(own):
                yield pd.DataFrame({"row": rows[own], "data": [data[k] for k in own]})

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["gram", "part", "parts", "row", "place", "first", "data"]
        for f in frames:
            out = []
            for row, data, at in zip(f["row"], f["data"], f["at"], strict=True):
                s = symbols(data)
                place = np.array([x["place"] for x in at], np.int64)
                for x, a, b in zip(at, *(y.tolist() for y in contexts(place, len(s), length, v)), strict=True):
                    out.append((x["gram"], x["part"], x["parts"], row, x["place"], a, s[a:b].tobytes()))
                if len(out) > 4096:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

    pieces = docs.mapInPandas(keyed, "row long, data binary").join(wanted, "row").mapInPandas(cut, "gram long, part int, parts int, row long, place int, first int, data binary")
    lined = pieces.repartition(common.partitions(spark), "gram", "part").sortWithinPartitions("gram", "part")
    size = symbols(b"").itemsize

    def sort_buckets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        weight, last = 0, None
        columns = ["row", "spans", "blocks"]
        for f in frames:
            for r in f.itertuples():
                if weight > SORTED and (r.gram, r.part) != last:
                    if out := list(sort(held, length, v, symbols(b"").dtype)):
                        yield pd.DataFrame(out, columns=columns)
                    held, weight = [], 0
                held.append(r)
                weight += len(r.data) // size
                last = (r.gram, r.part)
        if held and (out := list(sort(held, length, v, symbols(b"").dtype))):
            yield pd.DataFrame(out, columns=columns)

    span = "array<struct<a:int,b:int>>"
    found = common.stored(lined.mapInPandas(sort_buckets, f"row long, spans {span}, blocks array<struct<core:long,unmet:boolean,strings:array<long>,starts:array<int>,open:array<boolean>>>"))
    row_bits.drop()
    out = out.unionByName(found.select("row", F.explode("spans").alias("s")).select("row", "s.a", "s.b"))
    if not buckets.filter("parts > 1").isEmpty():
        blocks = found.select("row", F.explode("blocks").alias("x")).select("row", "x.*")
        often = blocks.groupBy("core").agg(F.count("*").alias("n"), F.max("unmet").alias("unmet")).filter("n > 1 AND unmet")
        core_bits = Bits(common.stored(often.select("core")), "core", 28)

        def met_again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f[core_bits.has(f["core"].to_numpy())]

        def once(f: pd.DataFrame) -> pd.DataFrame:
            whole = {c: np.concatenate(f[c].to_list()) for c in ("strings", "starts", "open")}
            x = pd.DataFrame({"row": np.repeat(f["row"].to_numpy(), f["starts"].str.len()), "string": whole["strings"], "a": whole["starts"], "open": whole["open"]})
            return x.groupby(["row", "a"], as_index=False).agg({"string": "first", "open": "min"})[["row", "string", "a", "open"]]

        # A string comes from the buckets of all samples in it, which is one place, and open if no part has found it. Long texts go in stretches.
        stretch = F.shiftright(F.element_at("starts", 1), STRETCH)
        near = blocks.mapInPandas(met_again, blocks.schema).withColumn("share", F.pmod(F.xxhash64("row", stretch), F.lit(shares)))
        strings = common.stored(near.groupBy("share").applyInPandas(once, "row long, string long, a int, open boolean"))
        core_bits.drop()
        # What its own part has found is covered already; it only tells the others.
        where = F.struct("row", "a")
        twice = strings.groupBy("string").agg(F.min(where).alias("one"), F.max(where).alias("other"), F.max("open").alias("open")).filter("one <> other AND open").select("string")
        out = out.unionByName(strings.filter("open").join(twice, "string", "left_semi").select("row", "a", (F.col("a") + length).alias("b")))
    return out


def neighbours(x: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts rows of symbols, of which size count, within their groups.

    Gives the place of each row in the order; by place the common prefix with the row before
    (-1: another group); by row the longest one with a neighbour.
    """
    raw = x.astype(x.dtype.newbyteorder(">")).tobytes()
    width, unit = x.shape[1] * x.itemsize, x.itemsize
    keys = [(g, raw[k * width : k * width + n * unit]) for k, (g, n) in enumerate(zip(group.tolist(), size.tolist(), strict=True))]
    order = np.array(sorted(range(len(x)), key=keys.__getitem__))
    y, n, g = x[order], size[order], group[order]
    differ = y[1:] != y[:-1]
    prefix_ = np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1]) if x.shape[1] else np.zeros(len(x) - 1, np.int64)
    prefix_ = np.where(g[1:] == g[:-1], np.minimum(prefix_, np.minimum(n[1:], n[:-1])), -1)
    before, after = np.append(-1, prefix_), np.append(prefix_, -1)
    place, longest = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    place[order], longest[order] = np.arange(len(x)), np.maximum(before, after)
    return place, before, longest


def sort(rows: list, length: int, v: int, dtype: np.dtype) -> Iterator[tuple]:
    """Sorts the suffixes of the rows' segments within each gram and part; gives for each row its covered spans, and of dealt buckets the open strings by runs."""
    m, most = len(rows), v - 1
    names: dict[tuple, int] = {}
    group = np.array([names.setdefault((r.gram, r.part), len(names)) for r in rows], np.int64)
    left_n = np.array([r.place - r.first for r in rows], np.int64)
    text = [np.frombuffer(r.data, dtype) for r in rows]
    right_n = np.array([len(t) for t in text], np.int64) - left_n
    right, left = np.zeros((m, length), dtype), np.zeros((m, most), dtype)
    for k, (t, n) in enumerate(zip(text, left_n.tolist(), strict=True)):
        right[k, : len(t) - n] = t[n:]
        left[k, :n] = t[:n][::-1]
    right_at, right_common, right_most = neighbours(right, right_n, group)
    left_at, left_common, left_most = neighbours(left, left_n, group)
    hit, lead = np.zeros((m, most + 1), bool), np.zeros((m, most + 1), bool)
    for d in range(most + 1):
        own = np.flatnonzero((left_most >= d) & (right_most >= length - d))
        if not len(own):
            continue
        tie = np.cumsum(right_common < length - d)[right_at[own]] * (m + 1) + np.cumsum(left_common < d)[left_at[own]]
        _, first, back, n = np.unique(tie, return_index=True, return_inverse=True, return_counts=True)
        hit[own, d] = n[back] > 1
        lead[own[first], d] = True
    dealt_out = np.array([r.parts > 1 for r in rows])
    for k in np.flatnonzero(hit.any(axis=1) | dealt_out).tolist():
        r = rows[k]
        spans = runs(r.place - np.flatnonzero(hit[k])[::-1], length)
        blocks = []
        if dealt_out[k]:
            away = np.arange(max(0, length - right_n[k]), left_n[k] + 1)  # of the sampled place from each string's start
            away = away[~hit[k, away] | lead[k, away]]
            unmet = ~hit[k, away]
            sums = prefix(text[k])
            strings = mixed(between(sums, left_n[k] - away, left_n[k] - away + length)).astype(np.int64)
            for run in np.unique(away // RUN).tolist():
                these = away // RUN == run
                low = left_n[k] - run * RUN
                high = min(len(text[k]), low - RUN + 1 + length)  # the symbols that all strings of this run share
                core = int(mixed(between(sums, np.array([low]), np.array([high])) ^ np.uint64(run))[0].astype(np.int64))
                blocks.append({"core": core, "unmet": bool(unmet[these].any()), "strings": strings[these].tolist(), "starts": (r.place - away[these]).tolist(), "open": unmet[these].tolist()})
        if spans or blocks:
            yield r.row, [{"a": a, "b": b} for a, b in spans], blocks


def joined(*found: DataFrame) -> DataFrame:
    """(row, spans) of covers, with overlapping spans joined, by their unit, 0 for the first."""
    spark = found[0].sparkSession
    every = [c.select("row", F.lit(k).alias("unit"), "a", "b") for k, c in enumerate(found)]
    whole = functools.reduce(DataFrame.unionByName, every).withColumn("share", F.pmod("row", F.lit(SHARES * common.partitions(spark))))

    def join(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["row", "unit", "a", "b"], ignore_index=True)
        far = f.groupby(["row", "unit"])["b"].cummax()
        new = (f["a"] > far.shift(fill_value=-1)) | (f["row"] != f["row"].shift()) | (f["unit"] != f["unit"].shift())
        f = f.assign(b=far).groupby(new.cumsum(), sort=False).agg({"row": "first", "unit": "first", "a": "first", "b": "last"})
        spans = [{"unit": u, "a": a, "b": b} for u, a, b in zip(f["unit"].tolist(), f["a"].tolist(), f["b"].tolist(), strict=True)]
        return pd.DataFrame({"row": f["row"].to_numpy(), "x": spans}).groupby("row", as_index=False).agg(spans=("x", list))

    return whole.groupBy("share").applyInPandas(join, "row long, spans array<struct<unit:int,a:int,b:int>>")


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """(row, spans): the bytes that repeated strings cover."""
    return common.settled(docs.sparkSession, lambda: joined(covers(docs, length, gram, bucket)))


def applied(docs: DataFrame, spans: DataFrame, finish: Callable, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """finish(bytes, spans as (unit, a, b)) of every text, with kept columns. Only texts that may have spans are shuffled to them."""
    bits = Bits(spans, "row", 24)

    def split(hit: bool) -> Callable:
        def run(doc_ids: list, texts: list) -> tuple[list[int], list]:
            data = [t.encode() for t in texts]
            rows = np.array([row_key(d, x) for d, x in zip(doc_ids, data, strict=True)], np.int64)
            own = np.flatnonzero(bits.has(rows) == hit)
            return own, [(int(rows[k]),) if hit else finish(data[k], []) for k in own]

        return run

    def end(texts: list, spans: list) -> tuple[None, list]:
        return None, [finish(t.encode(), [(s["unit"], s["a"], s["b"]) for s in x or ()]) for t, x in zip(texts, spans, strict=True)]

    without = common.mapped(docs, split(False), ("doc_id", "text"), schema, ("doc_id", *keep))
    with_spans = common.mapped(docs, split(True), ("doc_id", "text"), "row long", ("doc_id", "text", *keep)).join(spans, "row", "left")
    return common.own_ids(without.unionByName(common.mapped(with_spans, end, ("text", "spans"), schema, ("doc_id", *keep))))


def rest(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def deduplicated(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """docs without repeated strings; what is cut through of a character goes too. n_chars follows.

    With words, repeated passages of more words than that go too, however short they are in bytes.
    A passage's first and last word can be glued to what surrounds it, so words - 1 whole ones are asked for.
    """
    common.small_batches(docs.sparkSession)
    names = common.veiled(docs)
    plain = common.texts(docs, *[common.quoted(c).alias(x) for c, x in names.items()])
    base = plain.select("doc_id", "text")

    def passages() -> DataFrame:
        found = [covers(base, length, min(GRAM, max(1, length // 3)))]
        if words is not None:
            found.append(covers(base, max(1, words - 1), max(1, words // 3), symbols=as_words))
        return joined(*found)

    def finish(data: bytes, spans: list[tuple[int, int, int]]) -> tuple[str]:
        cut = [(a, b) for unit, a, b in spans if unit == 0]
        if len(cut) < len(spans):
            start, stop = word_spans(data)
            cut += [(int(start[a]), int(stop[b - 1])) for unit, a, b in spans if unit == 1]
        return (rest(data, merged(cut)).decode(errors="ignore"),)

    return common.unveiled(applied(plain, common.settled(docs.sparkSession, passages), finish, "text string", tuple(names.values())), docs)


def digest(data: bytes, spans: list[tuple[int, int, int]]) -> tuple:
    cut = merged([(a, b) for _, a, b in spans])
    return len(data), sum(b - a for a, b in cut), len(cut), hashlib.sha256(rest(data, cut)).hexdigest()


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: bytes removed from all documents, and digests of what is left."""
    common.small_batches(spark)
    docs = common.texts(common.table(spark, sf_dir, "documents"))
    out = applied(docs, repeated(docs), digest, DIGEST)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
