"""Smoothed sublinear TF-IDF in long form, document-balanced and chunk-weighted scores, contrasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.text import first_of
from ..sources import writers
from ..plans.config import TfidfSpec, TokenSpec

# Patterns of addresses, numbers, single letters and single characters.
URL, NUMBER, LETTER, CJK = r"^(https?://|www\.)", r"^[0-9０-９.,%％]+$", r"^[A-Za-zＡ-Ｚａ-ｚ]$", r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]$"

#: Rows of weights that leave Python at once.
ROWS = 1 << 16


def keep_token(t: Column, spec: TokenSpec) -> Column:
    """Stop words go first, then preserved terms stay, then addresses, numbers and single characters go."""
    stop = t.isin(*spec.stopwords) if spec.stopwords else F.lit(False)
    stay = t.isin(*spec.preserved) if spec.preserved else F.lit(False)
    return (t != "") & ~stop & (stay | ~(t.rlike(URL) | t.rlike(NUMBER) | ((F.length(t) == 1) & F.lit(not spec.one_letter))))


def keep_noun(t: Column, spec: TokenSpec) -> Column:
    """As keep_token without preserved terms; single CJK characters stay, Latin letters and symbols go."""
    stop = t.isin(*spec.stopwords) if spec.stopwords else F.lit(False)
    return (t != "") & ~stop & ~(t.rlike(URL) | t.rlike(NUMBER) | t.rlike(LETTER) | t.rlike(r"^[^\p{L}\p{N}_\s]+$"))


def tokens(text: Column, spec: TokenSpec, keep=keep_token) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(spec.pattern), F.lit(0)), lambda t: keep(t, spec))


def normalised_token(normalised: Column, dictionary: Column, surface: Column) -> Column:
    """The first form of a token that isn't blank, trimmed."""
    return F.coalesce(first_of(normalised, dictionary, surface), F.lit(""))


def substantive_noun(pos: Column, noun: str, markers: list[str]) -> Column:
    """Whether the first part of speech is the noun and none is among the markers (formal nouns, numerals)."""
    return (F.get(pos, F.lit(0)) == noun) & ~F.arrays_overlap(pos, F.array(*map(F.lit, markers)).cast("array<string>"))


def analysed(df: DataFrame, analyse: Callable[[str], list[dict]], text: str = "text") -> DataFrame:
    """Adds morphemes, array<struct<surface, dictionary, normalised, pos>>, by any analyser of one text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(morphemes=[analyse(t or "") for t in f[text]])

    return df.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", morphemes array<struct<surface:string,dictionary:string,normalised:string,pos:array<string>>>")


def content_words(morphemes: Column, kinds: list[str]) -> Column:
    """Forms of the morphemes whose first part of speech is among kinds."""
    kept = F.filter(morphemes, lambda m: F.get(m["pos"], F.lit(0)).isin(*kinds))
    return F.filter(F.transform(kept, lambda m: normalised_token(m["normalised"], m["dictionary"], m["surface"])), lambda t: t != "")


def display_errors(terms: DataFrame, spec: TokenSpec, key: str = "term") -> DataFrame:
    """Terms that a chart must not show: those that the noun filter drops, or that give no token."""
    bad = ~keep_noun(F.col(key), spec) | (F.size(tokens(F.col(key), spec, keep_noun)) == 0)
    return terms.filter(bad).select(F.lit("not to be displayed").alias("error"), F.col(key).alias("key"))


def protected_stopwords(stopwords: DataFrame, protected: DataFrame) -> DataFrame:
    """Protected terms among the stop words; none may be."""
    return stopwords.join(protected, "term", "left_semi")


@dataclass
class Tfidf:
    """weights: chunk_id, document, group columns, term, weight; sizes by chunk and document come from chunks."""

    chunks: DataFrame
    counts: DataFrame
    vocabulary: DataFrame
    weights: DataFrame


def bags(chunks: DataFrame, keep: list[str], words: Column) -> DataFrame:
    """The kept columns, terms and ns: the distinct words of a row with how often each occurs; counted in the task that reads the row."""
    made = chunks.select(*keep, words.alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column("terms")
            coded = found.flatten().dictionary_encode()
            width = max(len(coded.dictionary), 1)
            row = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy())
            key, n = np.unique(row * width + coded.indices.to_numpy(), return_counts=True)
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(key // width, minlength=len(found)))].astype(np.int32))
            terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(key % width)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], terms, pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))], [*b.schema.names, "ns"])

    return made.mapInArrow(run, StructType([*made.schema.fields, StructField("ns", ArrayType(IntegerType()))]))


def flat(counted: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each term of a bag."""
    return counted.select(*keep, F.explode(F.arrays_zip("terms", "ns")).alias("t")).select(*keep, F.col("t.terms").alias("term"), F.col("t.ns").cast("long").alias("n"))


def hashed(vocabulary: DataFrame, every: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """A seed by which the hashes of every term differ; the vocabulary's hashes in order, and their df."""
    seed = 0
    while not every.groupBy(F.xxhash64("term", F.lit(seed))).count().filter("count > 1").isEmpty():
        seed += 1
    got = vocabulary.select(F.xxhash64("term", F.lit(seed)).alias("h"), F.col("df").cast("int").alias("df")).toArrow()
    h, df = got.column("h").to_numpy(), got.column("df").to_numpy()
    order = np.argsort(h)
    return seed, h[order], df[order]


def weighed(counted: DataFrame, keep: list[str], vocabulary: DataFrame, every: DataFrame, total: int) -> DataFrame:
    """Weights of bags of which each is a chunk of its own; the vocabulary goes to them by its hashes."""
    seed, h, df = hashed(vocabulary, every)
    sent = counted.sparkSession.sparkContext.broadcast((h, df))
    read = counted.select(*keep, "terms", "ns", F.transform("terms", lambda t: F.xxhash64(t, F.lit(seed))).alias("hs"))
    names = [*keep, "term", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, dfs = sent.value
        for b in batches:
            terms, ns, hs = (b.column(c) for c in ("terms", "ns", "hs"))
            coded = hs.flatten().dictionary_encode()  # a term is looked up once for a batch
            own = coded.dictionary.to_numpy()
            at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
            inside = known[at] == own if len(known) else np.zeros(len(own), bool)
            idf = np.zeros(len(own))
            idf[inside] = np.log((1 + total) / (1 + dfs[at[inside]])) + 1
            codes = coded.indices.to_numpy()
            left = np.flatnonzero(inside[codes])
            row = np.repeat(np.arange(b.num_rows), ns.value_lengths().to_numpy())[left]
            u = (1 + np.log(ns.flatten().to_numpy()[left])) * idf[codes[left]]
            weight = u / np.sqrt(np.bincount(row, u * u, b.num_rows))[row]
            words = terms.flatten()
            for k in range(0, len(left), ROWS):
                part = slice(k, k + ROWS)
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(row[part])) for c in keep], words.take(pa.array(left[part])), pa.array(weight[part])], names)

    return read.mapInArrow(run, StructType([*counted.select(*keep).schema.fields, StructField("term", StringType()), StructField("weight", DoubleType())]))


def joined_weights(counts: DataFrame, keep: list[str], vocabulary: DataFrame, broadcast_terms: int) -> DataFrame:
    """Weights of counts of any chunks and with any vocabulary, by shuffles of all counts."""
    weighted = vocabulary.select("term", "idf")
    if broadcast_terms and weighted.count() <= broadcast_terms:
        weighted = F.broadcast(weighted)
    raw = counts.join(weighted, "term").withColumn("u", (1 + F.log("n")) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("u") * F.col("u")).over(Window.partitionBy("chunk_id")))
    return raw.select(*keep, "term", (F.col("u") / length).alias("weight"))


def fit(chunks: DataFrame, spec: TfidfSpec, token_spec: TokenSpec, document: str, groups: list[str], keep=keep_token) -> Tfidf:
    """chunks: chunk_id, document, groups, text. The vocabulary may be empty, then so are the weights; require_vocabulary() makes that an error.

    Rows are counted and weighed where they are read; only those whose chunk_id isn't their own are joined by it.
    """
    columns = ["chunk_id", document, *groups]
    base = chunks.select(*columns)
    counted = writers.stored(bags(chunks, columns, tokens(F.coalesce("text", F.lit("")), token_spec, keep)))  # tokens are taken from the texts once
    twice = counted.groupBy("chunk_id").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("chunk_id").alias("twice_id"))
    counts, shared = flat(counted, columns), None
    if not twice.isEmpty():
        same = F.col("chunk_id").eqNullSafe(F.col("twice_id"))
        shared = writers.stored(flat(counted.join(twice, same, "left_semi"), columns).groupBy(*columns, "term").agg(F.sum("n").alias("n")))
        counted = counted.join(twice, same, "left_anti")
        counts = flat(counted, columns).unionByName(shared)
    every = writers.stored(counts.groupBy("term").agg(F.count("*").alias("df")))
    total = base.agg(F.count("*").alias("total"))
    vocabulary = every.crossJoin(F.broadcast(total)).filter((F.col("df") >= spec.min_df) & (F.col("df") <= spec.max_df * F.col("total"))).withColumn("idf", F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1)  # total: one row
    if vocabulary.count() > spec.hashed_terms:
        return Tfidf(base, counts, vocabulary, joined_weights(counts, columns, vocabulary, spec.broadcast_terms))
    weights = weighed(counted, columns, vocabulary, every, base.count())
    if shared is not None:
        weights = weights.unionByName(joined_weights(shared, columns, vocabulary, spec.broadcast_terms))
    return Tfidf(base, counts, vocabulary, weights)


def require_vocabulary(m: Tfidf) -> Tfidf:
    if m.vocabulary.isEmpty():
        raise ValueError("no term is left in the vocabulary")
    return m


def document_scores(m: Tfidf, document: str, groups: list[str]) -> DataFrame:
    """Mean weight over all chunks of a document, those without the term included."""
    sizes = m.chunks.groupBy(document).agg(F.count("*").alias("chunk_count"))
    return m.weights.groupBy(document, *groups, "term").agg(F.sum("weight").alias("w")).join(sizes, document).select(document, *groups, "term", "chunk_count", (F.col("w") / F.col("chunk_count")).alias("score"))


def group_scores(m: Tfidf, document: str, group: str) -> DataFrame:
    """group, term, document_balanced_score and chunk_weighted_score."""
    sizes = m.chunks.groupBy(group).agg(F.count("*").alias("chunks"), F.count_distinct(document).alias("documents"))
    scores = document_scores(m, document, [group])
    out = scores.groupBy(group, "term").agg(F.sum("score").alias("b"), F.sum(F.col("score") * F.col("chunk_count")).alias("w")).join(sizes, group)
    return out.select(F.col(group).alias("group"), "term", (F.col("b") / F.col("documents")).alias("document_balanced_score"), (F.col("w") / F.col("chunks")).alias("chunk_weighted_score"))


def top_terms(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.desc(F.round("document_balanced_score", 9)), "term"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)


def contrast(scores: DataFrame, left: str, right: str) -> DataFrame:
    """Per term the difference left - right of balanced scores; no difference favours left."""
    value = lambda g: F.coalesce(F.max(F.when(F.col("group") == g, F.col("document_balanced_score"))), F.lit(0.0))
    out = scores.filter(F.col("group").isin(left, right)).groupBy("term").agg(value(left).alias("left_score"), value(right).alias("right_score"))
    out = out.withColumn("difference", F.col("left_score") - F.col("right_score"))
    return out.withColumn("favored_group", F.when(F.col("difference") >= 0, left).otherwise(right))


def ordered_contrast(contrasted: DataFrame, n: int, reverse: bool = False) -> DataFrame:
    """The n terms of the largest absolute difference, with their place; reversed, the difference is right - left."""
    d = F.round(F.abs("difference"), 9)
    top = contrasted.orderBy(d.desc(), "term").limit(n).withColumn("place", F.row_number().over(Window.orderBy(d.desc(), "term")))  # of n rows
    return top.withColumn("difference", -F.col("difference")) if reverse else top


def presentation_terms(contrasted: DataFrame, k: int, strict: bool = False) -> DataFrame:
    """The k strongest terms on either side, by difference; strict: fewer of either are an error."""
    d = F.round("difference", 9)
    high = contrasted.filter("difference > 0").orderBy(d.desc(), "term").limit(k)
    low = contrasted.filter("difference < 0").orderBy(d.asc(), "term").limit(k)
    if strict and min(high.count(), low.count()) < k:
        raise ValueError(f"fewer than {k} terms on a side")
    return high.unionByName(low)


def bars(top: DataFrame, group: str, n: int = 15) -> DataFrame:
    """The n best of top_terms() of a group, the last first, as a horizontal chart stacks them."""
    return top.filter((F.col("group") == group) & (F.col("rank") <= n)).select("term", "document_balanced_score", (F.lit(n) + 1 - F.col("rank")).alias("place"))
