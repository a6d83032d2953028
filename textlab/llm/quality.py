"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Every rule compares one measure of a text with a cutoff. The labelled good documents of a stratum
(language) that pass the base rule are parted in two by a hash of their id. One half designs a path of
settings, from loose to strict: at each level every rule has the strictest cutoff of a fixed grid that
rejects no more than the level's share of that half. The other half is the holdout: level by level,
the exact binomial probability of seeing as few rejections by any rule as were seen, if the true
rate of false rejection were MAX_RISK, must not exceed the stratum's part of DELTA, and the first
level that fails ends the path. Such fixed-sequence testing needs no correction over the levels;
Bonferroni's corrects over the strata. So in each stratum all rules together reject at most MAX_RISK of the good
documents, with probability 1 - DELTA for all strata at once. A stratum without a certified level
rejects by the base rules only; 86 good documents in the holdout can certify one of four strata.

Null text counts as empty (no words: it fails the base rule), null lang is a stratum of its own
under the empty name. Repeated rows are measured one by one. Without labels nothing is certified
and the base rules alone decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]+"
MAX_RISK, DELTA = 0.05, 0.05
#: What each rule may reject of the designing half, level by level.
LEVELS = (0.0, 0.0025, 0.005, 0.01)
#: Measures that must not exceed their cutoff, with the grid of cutoffs.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5),
    "word_length": (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0),
    "dup_line_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.7),
    "repeat_share": (0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.18),
}
#: Strata up to which the table of cutoffs is broadcast; more are joined by a shuffle.
BROADCAST_STRATA = 10_000
WINDOW = 5


def let(value: Column, f) -> Column:
    """f(value), with value computed once even where f uses it often or inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of width words that occur twice or more in the array, first occurrences included."""

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def starts(pairs: Column) -> Column:
            w = lambda j: F.get(pairs, j)["w"]
            twice = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda j: F.coalesce(w(j) == w(j + 1), F.lit(False)) | F.coalesce(w(j) == w(j - 1), F.lit(False)))
            return F.array_sort(F.transform(twice, lambda j: F.get(pairs, j)["i"]))

        def union(at: Column) -> Column:
            steps = F.zip_with(F.slice(at, 2, F.size(at) - 1), F.slice(at, 1, F.size(at) - 1), lambda b, a: F.least(F.lit(width), b - a))
            return F.aggregate(steps, F.lit(width), lambda s, x: s + x)

        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(let(ordered, starts), union)).otherwise(0)

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > width, let(let(hashed, windows), covered)).otherwise(0).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of every whole text."""
    text = F.coalesce("text", F.lit(""))
    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lines = let(worded, lambda a: F.struct(F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup")))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    counts = let(words, lambda a: F.struct(F.size(a).cast("long").alias("n"), F.length(F.array_join(a, "")).cast("long").alias("chars"), repeated_words(a).alias("again")))
    out = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), counts.alias("w"), symbols.cast("long").alias("n_symbols"), lines.alias("l"))
    return out.select("doc_id", "lang", F.col("w.n").alias("n_words"), F.col("w.chars").alias("word_chars"), "n_symbols", F.col("l.dup").alias("n_dup_lines"), F.col("w.again").alias("n_repeat_words"), F.col("l.n").alias("n_lines"))


def with_shares(df: DataFrame) -> DataFrame:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.withColumns({"base_failed": failed, "symbol_share": share("n_symbols", "n_words"), "word_length": share("word_chars", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words")})


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial X, summed term by term in logarithms; 1 where k is not below n * p, as no test can pass there."""
    odds = math.log(p / (1 - p))
    first = n * math.log1p(-p)
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    step = lambda s, i: F.struct((s["t"] + F.log((n - i + 1) / i) + odds).alias("t"), (s["c"] + F.exp(s["t"] + F.log((n - i + 1) / i) + odds)).alias("c"))
    total = F.aggregate(steps, F.struct(first.alias("t"), F.exp(first).alias("c")), step, lambda s: s["c"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(total)


def any_over(rules: dict[str, tuple[float, ...]], prefix: str) -> Column:
    """Whether a measure exceeds its cutoff, in columns named by the prefix and the rule; null cutoffs reject nothing."""
    over = F.lit(False)
    for rule in rules:
        over = over | F.coalesce(F.col(rule) > F.col(prefix + rule), F.lit(False))
    return over


def cutoffs(shares: DataFrame, labels: DataFrame, rules: dict[str, tuple[float, ...]] = RULES, max_risk: float = MAX_RISK, delta: float = DELTA, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """lang, level (from 1; null: none) and the cutoff of every rule at the strictest certified level."""
    good = labels.filter("quality = 1").select("doc_id").distinct()
    held = common.stored(shares.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi").select("lang", F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1).isin(*"13579bdf").alias("holdout"), *rules))
    seen = [F.count_if(F.col(rule) > c).alias(f"{rule}_{i}") for rule, grid in rules.items() for i, c in enumerate(grid)]
    designed = held.filter("NOT holdout").groupBy("lang").agg(F.count("*").alias("n"), *seen)
    none = F.lit(None).cast("double")
    strictest = lambda rule, share: F.least(none, none, *[F.when(F.col(f"{rule}_{i}") <= share * F.col("n"), F.lit(c)) for i, c in enumerate(rules[rule])])
    path = common.stored(designed.select("lang", *[strictest(rule, share).alias(f"c{j}_{rule}") for j, share in enumerate(levels) for rule in rules]))
    if path.count() <= BROADCAST_STRATA:
        path = F.broadcast(path)
    rejected = [F.count_if(any_over(rules, f"c{j}_")).alias(f"k{j}") for j in range(len(levels))]
    tested = common.stored(held.filter("holdout").join(path, "lang").groupBy("lang").agg(F.count("*").alias("n"), *rejected))
    share = delta / max(1, tested.count())
    failed = [binomial_cdf(F.col(f"k{j}"), F.col("n"), max_risk) > share for j in range(len(levels))]
    last = F.coalesce(*[F.when(x, F.lit(j)) for j, x in enumerate(failed)], F.lit(len(levels)))  # levels passed before the first failure
    level = F.nullif(last, F.lit(0))
    chosen = lambda rule: F.get(F.array(*[F.col(f"c{j}_{rule}") for j in range(len(levels))]), F.col("level") - 1)
    return tested.select("lang", level.alias("level")).join(path, "lang").select("lang", "level", *[chosen(rule).alias(f"max_{rule}") for rule in rules])


def filtered(docs: DataFrame, labels: DataFrame, rules: dict[str, tuple[float, ...]] = RULES, max_risk: float = MAX_RISK, delta: float = DELTA) -> DataFrame:
    """The counts of every document, base_failed and kept."""
    spark = docs.sparkSession
    shares = with_shares(common.stored(measured(docs)))
    limits = common.settled(spark, lambda: cutoffs(shares, labels, rules, max_risk, delta))
    if limits.count() <= BROADCAST_STRATA:
        limits = F.broadcast(limits)
    return shares.join(limits, "lang", "left").withColumn("kept", ~F.col("base_failed") & ~any_over(rules, "max_"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Query: counts and verdicts of all documents."""
    out = filtered(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    tests = ", ".join(f"('{rule}', {c})" for rule, grid in RULES.items() for c in grid)
    levels = ", ".join(f"({j}, {share})" for j, share in enumerate(LEVELS, 1))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
words AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM split),
sized AS (SELECT r, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars FROM words GROUP BY r),
windows AS (SELECT r, i, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c, lead(w, 3) OVER o AS d, lead(w, 4) OVER o AS e FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
counted AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c, d, e) AS n FROM windows WHERE e IS NOT NULL),
again AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM counted, range({WINDOW}) t(k) WHERE n > 1 GROUP BY r),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT r, doc_id, lang, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN sized USING (r) LEFT JOIN again USING (r) LEFT JOIN lines USING (r)),
s AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_share, coalesce(word_chars / nullif(n_words, 0), 0) AS word_length,
    coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_share, coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_share FROM m),
measures AS (UNPIVOT (SELECT r, lang, {", ".join(RULES)} FROM s) ON {", ".join(RULES)} INTO NAME rule VALUE x),
held AS (SELECT r, lang, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS holdout FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
tests(rule, c) AS (VALUES {tests}),
levels(level, share) AS (VALUES {levels}),
designed AS (SELECT h.lang, t.rule, t.c, count(*) AS n, count(*) FILTER (x > c) AS k FROM held h JOIN measures USING (r) JOIN tests t USING (rule) WHERE NOT holdout GROUP BY ALL),
path AS (SELECT lang, level, rule, min(c) AS c FROM designed, levels WHERE k <= share * n GROUP BY ALL),
hits AS (SELECT DISTINCT h.r, h.lang, p.level FROM held h JOIN measures m USING (r) JOIN path p ON p.lang = h.lang AND p.rule = m.rule AND x > c WHERE holdout),
sizes AS (SELECT lang, count(*) AS n FROM held WHERE holdout AND lang IN (SELECT lang FROM held WHERE NOT holdout) GROUP BY lang),
tested AS (SELECT lang, n, level, count(hits.r) AS k FROM sizes CROSS JOIN levels LEFT JOIN hits USING (lang, level) GROUP BY ALL),
risks AS (
  SELECT lang, level, CASE WHEN k >= n * {MAX_RISK} THEN 1 ELSE list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({MAX_RISK}) + (n - i) * ln(1 - {MAX_RISK})))) END AS risk FROM tested),
reached AS (SELECT lang, coalesce(min(level) FILTER (risk > {DELTA} / (SELECT count(*) FROM sizes)), {len(LEVELS) + 1}) - 1 AS level FROM risks GROUP BY lang),
limits AS (SELECT lang, rule, c FROM path JOIN reached USING (lang, level)),
over AS (SELECT DISTINCT r FROM measures JOIN limits USING (lang, rule) WHERE x > c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM over) AS kept FROM s
"""


OP5_SQL = _sql()
