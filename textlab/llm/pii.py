"""Personal data by patterns, and information-theoretic sanitisation of what reveals it.

The patterns find the protected entities: e-mail and IP addresses, card and phone numbers. A term
near an entity reveals it if knowing the term makes the entity likely: with the point-wise mutual
information PMI(e; t) = log2(p(e | t) / p(e)) and the entity's information IC(e) = -log2 p(e),
estimated from co-occurrence in the whole corpus, t is disclosive if PMI >= DISCLOSED * IC. Terms
that give the entity away (PMI >= REMOVED * IC) are removed. Other disclosive ones are generalised:
their beginnings, LEVELS letters long, are terms of the corpus too, and the longest one that is not
disclosive itself takes the term's place; without one the term is removed.
A kind of entity is an entity too, so terms beside ever new values of a kind are found as well.
A context is the REACH words on either side of an entity in its line, whole words only.

Of p(e | t) the lower confidence bound is taken (Wilson, Z): support follows the
evidence, and one context may do in a large corpus. All counts are of distinct texts, so copies of
a document change nothing; texts whose contexts have equal words are the evidence of one. Null text counts as empty and has no spans. Repeated rows are treated one by one.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .suffix import blobs

KINDS = ("email", "ip", "card", "phone", "term")
DISCLOSED, REMOVED, SUPPORT = 0.8, 0.95, 1
#: The bound of p(e | t) in standard deviations: 95% from one side.
Z = 1.645
#: Words on either side that make up a context.
REACH = 8
#: Lengths of the beginnings that terms are generalised to, the most telling first; in counts they end in *.
LEVELS = (5, 3, 1)
#: Disclosive pairs, or terms to count, up to which they are broadcast; more pairs are joined by a shuffle, more terms pass a bitmap.
BROADCAST_PAIRS = 200_000
#: Terms that a task counts before it sends them.
HELD = 500_000

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# The look-behind spares starts inside a run of digits, where what follows the run has failed already.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"\w{3,}")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @ and so in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def near(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, list[tuple[str, int, int]]]]:
    """For each base span its entity, a hash of its context's words, and these with their places."""
    if not spans:
        return []
    out = []
    taken = common.merged([(a, b) for a, _, b in spans])
    firsts = [a for a, _ in taken]
    at = [m.span() for m in TERM.finditer(text)]
    starts, stops = [a for a, _ in at], [b for _, b in at]

    def free(k: int) -> bool:
        j = bisect_left(firsts, stops[k])  # only the last span that starts before the word's end can reach it
        return not j or taken[j - 1][1] <= starts[k]

    for a, kind, b in spans:
        own = []
        k, edge = bisect_right(stops, a) - 1, a
        low = max(-1, k - REACH)
        while k > low and "\n" not in text[stops[k] : edge]:
            own.append(k)
            edge, k = starts[k], k - 1
        own.reverse()
        k, edge = bisect_left(starts, b), b
        high = min(len(at), k + REACH)
        while k < high and "\n" not in text[edge : starts[k]]:
            own.append(k)
            edge, k = stops[k], k + 1
        words = [(text[starts[k] : stops[k]].lower(), starts[k], stops[k]) for k in own if free(k)]
        value = text[a:b].lower() if kind == 0 else re.sub(r"[^0-9.]" if kind == 1 else r"[^0-9]", "", text[a:b])
        out.append((number(f"{kind}:{value}"), number(" ".join(w for w, _, _ in words)), words))
    return out


def number(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "little", signed=True)


def lower(p: Column, n: Column) -> Column:
    """The lower end of Wilson's interval for a share p of n."""
    z = Z * Z / n
    return (p + z / 2 - F.sqrt(z * (p * (1 - p) + z / 4))) / (1 + z)


#: The kinds as entities.
KIND_IDS = [number(k) for k in KINDS]


def beside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, list[tuple[str, int, int]]]]:
    """What near() gives, and the same of each span's kind."""
    for (_, kind, _), (entity, context, words) in zip(spans, near(text, spans), strict=True):
        yield entity, context, words
        yield KIND_IDS[kind], context, words


def levels(words: Iterable[str]) -> set[str]:
    """The words and their beginnings."""
    found = set(words)
    return found | {w[:n] + "*" for n in LEVELS for w in found if len(w) > n}


def term_counts(docs: DataFrame, names: DataFrame, broadcast_terms: int) -> DataFrame:
    """(term, n_term): in how many texts each of names occurs. Counts are sent as sorted hashes, a row for each share of them."""
    spark = docs.sparkSession
    shares = common.partitions(spark)

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(key=keys(f["term"]).astype(np.int64))

    named = common.stored(names.mapInPandas(hashed, "term string, key long"))
    few = named.count() <= broadcast_terms
    sent = spark.sparkContext.broadcast(frozenset(r["term"] for r in named.select("term").collect())) if few else None
    bits = None if few else common.Bits(named, "key")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()

        def out() -> pd.DataFrame:
            k, n = keys(counts), np.fromiter(counts.values(), np.int64, len(counts))
            if bits:
                own = bits.has(k.astype(np.int64))
                k, n = k[own], n[own]
            order = np.argsort(k)
            k, n = k[order], n[order]
            rows = [(s, x, y) for (s, x), (_, y) in zip(blobs(k, k, shares), blobs(n, k, shares), strict=True)]
            return pd.DataFrame(rows, columns=["share", "keys", "n"])

        for f in frames:
            for t in f["text"]:
                said = levels(TERM.findall(t.lower()))
                counts.update(sent.value & said if sent else said)
                if len(counts) > HELD:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    def add(f: pd.DataFrame) -> pd.DataFrame:
        k, back = np.unique(np.frombuffer(b"".join(f["keys"]), "<u8"), return_inverse=True)
        return pd.DataFrame({"key": k.astype(np.int64), "n_term": np.bincount(back, weights=np.frombuffer(b"".join(f["n"]), "<i8")).astype(np.int64)})

    counted = docs.mapInPandas(count, "share int, keys binary, n binary").groupBy("share").applyInPandas(add, "key long, n_term long")
    return named.join(counted, "key").select("term", "n_term")


def keys(terms: Collection[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(text): every text once. Only texts whose hash comes more than once are shuffled and stored; docs is read again for the others."""
    hashed = common.texts(docs).select("text", F.xxhash64("text").alias("hash"))
    bits = common.Bits(common.stored(hashed.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")), "hash", 28)

    def split(hit: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = bits.has(b.column("hash").to_numpy(zero_copy_only=False)) == hit
                yield b.select(["text"]).filter(pa.array(own))

        return hashed.mapInArrow(run, "text string")

    return split(False).unionByName(common.stored(split(True).distinct()))


def disclosive(docs: DataFrame, disclosed: float = DISCLOSED, support: int = SUPPORT, broadcast_terms: int = BROADCAST_PAIRS) -> DataFrame:
    """(entity, term, share, general): pairs whose PMI is share of the entity's information, disclosed at least, and the longest beginning of the term whose share is less (null: none)."""
    common.small_batches(docs.sparkSession)
    return common.settled(docs.sparkSession, lambda: _disclosive(docs, disclosed, support, broadcast_terms))


def _disclosive(docs: DataFrame, disclosed: float, support: int, broadcast_terms: int) -> DataFrame:
    docs = distinct_texts(docs).withColumn("at", F.monotonically_increasing_id())

    def contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(e, k, c, sorted(levels(w for w, _, _ in ws))) for k, t in zip(f["at"], f["text"], strict=True) for e, c, ws in beside(t, base_spans(t))]
            if rows:
                yield pd.DataFrame(rows, columns=["entity", "at", "context", "terms"])

    seen = common.stored(docs.mapInPandas(contexts, "entity long, at long, context long, terms array<string>"))
    often = seen.select("entity", "at").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    each = seen.select("entity", "at", "context", F.explode("terms").alias("term"))
    # Each pair's texts, and its contexts with different words; apart, as one aggregate of two distinct counts would expand the rows.
    texts = each.select("entity", "term", "at").distinct().groupBy("entity", "term").agg(F.count("*").alias("together"))
    apart = each.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_context"))
    pairs = texts.join(apart, ["entity", "term"]).filter(F.col("n_context") >= support).join(often, "entity")
    pairs = common.stored(pairs.select("entity", "n_entity", "term", "together", "n_context"))
    total = docs.count()
    spread = term_counts(docs, pairs.select("term").distinct(), broadcast_terms)
    info = F.log2(F.lit(total) / F.col("n_entity"))
    weight = F.least(F.lit(1.0), F.col("n_context") / F.col("together"))  # of a text as evidence
    known = F.log2(lower(F.least(F.lit(1.0), F.col("together") / F.col("n_term")), F.col("n_term") * weight))  # log2 p(e | t)
    share = F.when(info > 0, (info + known) / info).otherwise(0.0)
    shares = common.stored(pairs.join(spread, "term").select("entity", "term", share.alias("share")))
    safe = shares.filter(F.col("term").endswith("*") & (F.col("share") < disclosed)).select("entity", F.col("term").alias("level"))
    said = shares.filter(~F.col("term").endswith("*") & (F.col("share") >= disclosed))
    longer = said.select("*", F.explode(F.array(*[F.concat(F.substring("term", 1, n), F.lit("*")) for n in LEVELS])).alias("level"))
    best = longer.filter(F.length("level") <= F.length("term")).join(safe, ["entity", "level"]).groupBy("entity", "term").agg(F.max_by("level", F.length("level")).alias("general"))
    return said.join(best, ["entity", "term"], "left")


def masked(text: str, spans: list[tuple[int, int, int, float, str]], removed: float = REMOVED) -> str:
    """The text with overlapping spans joined and replaced: entities by their kind, terms by a beginning or nothing."""
    out, at = [], 0
    for a, kind, b, share, general in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out.append(text[at:a])
            if kind < 4:
                out.append(f"[{KINDS[kind].upper()}]")
            elif share < removed and general:
                out.append(text[a : a + len(general) - 1] + "*")
        at = b
    return "".join([*out, text[at:]])


SPANS = "array<struct<start:int,kind:int,stop:int>>"


def found(docs: DataFrame, pairs: DataFrame, keep: tuple[str, ...] = (), sanitise: bool = False, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Rows of docs: doc_id, base and terms (arrays of spans), kept columns, and with sanitise the text as masked()."""
    spark = docs.sparkSession
    keep = tuple(c for c in keep if c not in ("doc_id", "text"))
    docs = common.texts(docs, *keep)
    shares = None
    if pairs.count() <= broadcast_pairs:
        shares = spark.sparkContext.broadcast({(r["entity"], r["term"]): (r["share"], r["general"] or "") for r in pairs.collect()})
    else:  # the pairs of each text come to it by its place in the input
        docs = common.stored(docs.withColumn("row", F.monotonically_increasing_id()))

        def open_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = {(r, e, w) for r, t in zip(f["row"], f["text"], strict=True) for e, _, ws in beside(t, base_spans(t)) for w, _, _ in ws}
                if rows:
                    yield pd.DataFrame(list(rows), columns=["row", "entity", "term"])

        own = docs.select("row", "text").mapInPandas(open_pairs, "row long, entity long, term string").join(pairs, ["entity", "term"])
        own = own.groupBy("row").agg(F.collect_list(F.struct("entity", "term", "share", "general")).alias("own"))
        docs = docs.join(own, "row", "left")

    def run(texts: list, *own: list) -> tuple[None, list]:
        out = []
        for k, t in enumerate(texts):
            spans = base_spans(t)
            known = shares.value if shares else {(x["entity"], x["term"]): (x["share"], x["general"] or "") for x in own[0][k] or ()}
            more: dict[tuple[int, int], tuple[float, str]] = {}
            for e, _, ws in beside(t, spans) if known else ():
                for w, a, b in ws:
                    if (e, w) in known:
                        share, general = known[e, w]
                        was = more.get((a, b), (share, general))
                        more[a, b] = max(was[0], share), min(was[1], general, key=len)  # what no entity is disclosed by
            base = [{"start": a, "kind": i, "stop": b} for a, i, b in spans]
            terms = [{"start": a, "kind": 4, "stop": b} for a, b in sorted(more)]
            text = masked(t, [(a, i, b, 1.0, "") for a, i, b in spans] + [(a, 4, b, *x) for (a, b), x in more.items()]) if sanitise else None
            out.append((base, terms, text))
        return None, out

    read = ("text",) if shares else ("text", "own")
    return common.own_ids(common.mapped(docs, run, read, f"base {SPANS}, terms {SPANS}, text string", ("doc_id", *keep)))


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with masked texts; n_chars follows them where there is such a column."""
    names = common.veiled(docs)
    plain = docs.select("doc_id", "text", *[common.quoted(c).alias(x) for c, x in names.items()])
    return common.unveiled(found(plain, disclosive(docs), tuple(names.values()), sanitise=True), docs)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Query: spans of all documents."""
    docs = common.table(spark, sf_dir, "documents")
    names = F.array(*map(F.lit, KINDS))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    out = found(docs, disclosive(docs))
    number_of = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [number_of(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return out.select("doc_id", *counts, F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.array_sort(F.concat("base", "terms"))).alias("spans"))
