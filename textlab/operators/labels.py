"""Summaries of categorical labels over a complete set of labels, and rules on annotated chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact, evidence_found, safe_divide, visible_length
from ..plans.config import Indicator, Taxonomy

CHUNK_WEIGHTED, WITHIN, BALANCED = "chunk_weighted_supplementary", "within_document", "document_balanced"


def merge_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on a key that must be unique on both sides; a repeated one fails the query."""
    return unique(left, key).join(unique(right, key), key, "left")


def unique(df: DataFrame, key: str) -> DataFrame:
    """df, if no key repeats; the query fails otherwise."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(key))).withColumn("_ok", F.assert_true(F.col("_n") == 1, F.lit(f"{key} is not unique"))).filter(F.col("_ok").isNull()).drop("_n", "_ok")


def merge_complete(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of two tables that must have the same keys, each once; the query fails otherwise."""
    one, two = unique(left, key).withColumn("_l", F.lit(True)), unique(right, key).withColumn("_r", F.lit(True))
    both = one.join(two, key, "full").withColumn("_ok", F.assert_true(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.lit(f"a {key} has no partner")))
    return both.filter(F.col("_ok").isNull()).drop("_l", "_r", "_ok")


def with_names(df: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the name of each key from a short table of names; a key without one fails the query."""
    named = df.join(F.broadcast(names.select(key, name).dropDuplicates([key]).limit(10_000)), key, "left")  # a name for each cluster or label
    return named.withColumn(name, F.coalesce(name, F.raise_error(F.concat(F.lit(f"no {name} for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("string")))


def pair_matrix(joint: DataFrame, pairs: list[tuple[str, str]], groups: list[str]) -> DataFrame:
    """joint_table() rows of chosen pairs: one row for each, one column of balanced shares for each group, 0 where there is none."""
    wanted = joint.filter(F.struct("first_label", "second_label").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in pairs]))
    return wanted.groupBy("label_pair").pivot("group", groups).agg(F.first("document_balanced_proportion")).na.fill(0)


def indicator_bars(table: DataFrame, n: int = 35) -> DataFrame:
    """The last n balanced indicators in the order of narrative, name and group, with their label in a chart."""
    label = F.concat_ws(" | ", F.replace("narrative", F.lit("Narrative "), F.lit("")), "group", F.replace(F.replace("indicator", F.lit("Proportion of "), F.lit("")), F.lit(" proportion"), F.lit("")))
    rows = table.filter(F.col("weighting_method") == BALANCED).orderBy(F.desc("narrative"), F.desc("indicator"), F.desc("group")).limit(n)
    place = F.row_number().over(Window.orderBy("narrative", "indicator", "group"))  # of n rows
    return rows.select(place.alias("place"), label.alias("plot_label"), "value")


def with_phase(df: DataFrame, phases: dict[str, str], period: str = "period") -> DataFrame:
    """Adds phase; a period without one fails the query."""
    table = F.create_map(*[F.lit(x) for kv in phases.items() for x in kv])
    phase = F.try_element_at(table, F.col(period))
    return df.withColumn("phase", F.coalesce(phase, F.raise_error(F.concat(F.lit("no phase for "), F.coalesce(period, F.lit("null")))).cast("string")))


def observed(df: DataFrame, fields: list[str], most: int = 1000) -> Taxonomy:
    """The labels that occur; more than most of a field raise an error, as a taxonomy is a short list."""
    found = {f: sorted(r[0] for r in df.select(f).filter(F.col(f).isNotNull()).distinct().take(most + 1)) for f in fields}
    if wide := [f for f, x in found.items() if len(x) > most]:
        raise ValueError(f"more than {most} labels: {', '.join(wide)}")
    return Taxonomy({f: tuple(x) for f, x in found.items()})


def _counts(taxonomy: Taxonomy) -> Column:
    """All labels of the taxonomy with their counts, none left out."""
    return F.array(*[F.struct(F.lit(f).alias("label_field"), F.lit(x).alias("label"), F.count_if(F.col(f) == x).alias("count")) for f, x in taxonomy.pairs()])


def label_summary(merged: DataFrame, taxonomy: Taxonomy, dimension: str | None = None) -> DataFrame:
    """dimension, group, label_field, label, count, proportion, weighting_method; one pass, counts of 0 included."""
    group = F.col(dimension) if dimension else F.lit("overall")
    out = merged.groupBy(group.alias("group")).agg(F.count("*").alias("n"), _counts(taxonomy).alias("c")).select("group", "n", F.inline("c"))
    return out.select(F.lit(dimension or "overall").alias("dimension"), "group", "label_field", "label", "count", safe_divide(F.col("count"), F.col("n")).alias("proportion"), F.lit(CHUNK_WEIGHTED).alias("weighting_method"))


def document_level(merged: DataFrame, taxonomy: Taxonomy, document: str, attributes: list[str]) -> DataFrame:
    """Label proportions inside each document, with the attributes of its first chunk."""
    first = [F.min_by(a, "chunk_id").alias(a) for a in attributes]
    out = merged.groupBy(document).agg(*first, F.count("*").alias("document_chunk_count"), _counts(taxonomy).alias("c")).select(document, *attributes, "document_chunk_count", F.inline("c"))
    return out.withColumn("proportion", safe_divide(F.col("count"), F.col("document_chunk_count"))).withColumn("weighting_method", F.lit(WITHIN))


def document_balanced(levels: DataFrame, document: str, dimension: str) -> DataFrame:
    """Means over documents of document_level() rows."""
    out = levels.groupBy(F.col(dimension).alias("group"), "label_field", "label").agg(F.count_distinct(document).alias("document_count"), F.avg("proportion").alias("proportion"))
    return out.select(F.lit(dimension).alias("dimension"), "group", "label_field", "label", "document_count", "proportion", F.lit(BALANCED).alias("weighting_method"))


def joint_table(merged: DataFrame, taxonomy: Taxonomy, first: str, second: str, document: str, dimension: str) -> DataFrame:
    """All pairs of labels of two fields: counts and both weightings."""
    pairs = [(a, b) for a in taxonomy.fields[first] for b in taxonomy.fields[second]]
    cells = F.array(*[F.struct(F.lit(a).alias("first_label"), F.lit(b).alias("second_label"), F.count_if((F.col(first) == a) & (F.col(second) == b)).alias("n")) for a, b in pairs])
    docs = merged.groupBy(dimension, document).agg(F.count("*").alias("chunks"), cells.alias("c")).select(dimension, document, "chunks", F.inline("c"))
    out = docs.groupBy(F.col(dimension).alias("group"), "first_label", "second_label").agg(F.sum("n").alias("count"), safe_divide(F.sum("n"), F.sum("chunks")).alias("chunk_weighted_proportion"), F.avg(safe_divide(F.col("n"), F.col("chunks"))).alias("document_balanced_proportion"), F.count_distinct(document).alias("document_count"))
    return out.select(F.lit(dimension).alias("dimension"), "group", F.lit(first).alias("first_label_field"), "first_label", "second_label", F.concat_ws(" × ", "first_label", "second_label").alias("label_pair"), "count", "chunk_weighted_proportion", "document_balanced_proportion", "document_count")


def indicators(merged: DataFrame, specs: list[Indicator], document: str) -> DataFrame:
    """Two rows for each indicator, chunk-weighted and document-balanced; an empty subset gives 0. Two aggregations in all."""
    each = []
    for k, s in enumerate(specs):
        inside = F.coalesce(F.expr(s.subset), F.lit(False))
        each += [F.count_if(inside).alias(f"n{k}"), F.count_if(inside & F.coalesce(F.expr(s.condition), F.lit(False))).alias(f"k{k}")]
    docs = merged.groupBy(document).agg(*each)
    total = docs.agg(*[x for k in range(len(specs)) for x in (F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}"), F.coalesce(F.sum(f"k{k}"), F.lit(0)).alias(f"k{k}"), F.avg(F.when(F.col(f"n{k}") > 0, F.col(f"k{k}") / F.col(f"n{k}"))).alias(f"b{k}"))])
    rows = []
    for k, s in enumerate(specs):
        for value, way in ((safe_divide(F.col(f"k{k}"), F.col(f"n{k}")), CHUNK_WEIGHTED), (F.coalesce(f"b{k}", F.lit(0.0)), BALANCED)):
            rows.append(F.struct(F.lit(s.narrative).alias("narrative"), F.lit(s.name).alias("indicator"), F.lit(s.group).alias("group"), value.alias("value"), F.lit(way).alias("weighting_method"), F.lit(s.note).alias("interpretation_note")))
    return total.select(F.inline(F.array(*rows)))


def grouping_sets_summary(merged: DataFrame, taxonomy: Taxonomy, groups: list[str]) -> DataFrame:
    """Observed labels by each of several groupings, from one expansion of the rows."""
    long = merged.unpivot(groups, list(taxonomy.fields), "dimension", "label").filter("label IS NOT NULL")
    long = long.select(F.inline(F.array(*[F.struct(F.lit(g).alias("group_field"), F.col(g).cast("string").alias("group"), "dimension", "label") for g in groups])))
    out = long.groupBy("group_field", "group", "dimension", "label").agg(F.count("*").alias("count"))
    n = F.sum("count").over(Window.partitionBy("group_field", "group", "dimension"))
    return out.withColumn("n_chunks", n).withColumn("proportion", F.round(F.col("count") / F.col("n_chunks"), 4))


def label_pivot(summary: DataFrame, groups: list[str], value: str = "proportion") -> DataFrame:
    """One row for each label, one column for each group, 0 where there is none."""
    return summary.groupBy("label_field", "label").pivot("group", groups).agg(F.first(value)).na.fill(0)


def ordered_groups(groups: DataFrame, known: list[str]) -> DataFrame:
    """Adds display_order: known groups first, in their order, others after them by first row."""
    place = F.array_position(F.array(*map(F.lit, known)).cast("array<string>"), F.col("group"))
    rank = F.struct(F.when(place > 0, place).otherwise(F.lit(len(known) + 1)), "first_row", "group")
    return groups.withColumn("display_order", F.row_number().over(Window.orderBy(rank)))


REASONS = {"short": "short evidence", "lost": "evidence not found", "rare": "rare combination", "ceremonial": "ceremonial or regional"}


def review_candidates(merged: DataFrame, fields: list[str], rules: list[tuple[str, str]], patterns: list[str], reasons: dict[str, str] = REASONS, after: list[tuple[str, str]] = ()) -> DataFrame:
    """Rows with a reason to look again. rules and after: (reason, SQL condition) on the fields; between them, in order: short evidence,
    evidence not in the text, a combination of labels that occurs once, a pattern in the text."""
    # A combination that occurs once is found by its row's id, so no task gets all rows of a frequent one.
    once = merged.groupBy(*fields).agg(F.count("*").alias("_n"), F.min("chunk_id").alias("chunk_id")).filter("_n = 1")
    once = once.select(*[F.col(c).alias(f"_one_{c}") for c in ("chunk_id", *fields)], F.lit(True).alias("_rare"))
    same = F.lit(True)
    for c in ("chunk_id", *fields):
        same = same & F.col(c).eqNullSafe(F.col(f"_one_{c}"))
    ceremonial = F.exists(F.array(*map(F.lit, patterns)).cast("array<string>"), lambda p: F.contains(F.col("text"), p))
    df = merged.join(once, same, "left").withColumn("_rare", F.coalesce("_rare", F.lit(False)))
    checks = [(F.expr(c), r) for r, c in rules]
    checks += [(F.coalesce(visible_length(F.col("evidence")), F.lit(0)) < 5, reasons["short"]), (~F.coalesce(evidence_found(F.col("evidence"), F.col("text")), F.lit(False)), reasons["lost"]), (F.col("_rare"), reasons["rare"]), (ceremonial, reasons["ceremonial"])]
    checks += [(F.expr(c), r) for r, c in after]
    return df.withColumn("review_reason", F.concat_ws(" | ", *[F.when(c, F.lit(r)) for c, r in checks])).filter("review_reason <> ''").drop(*once.columns)


def representative_examples(merged: DataFrame, criteria: dict[str, str], patterns: list[str], limit: int = 3, length: int = 250) -> DataFrame:
    """Best rows for each named SQL condition: no pattern, found and long evidence, usual length, then id; equal texts once."""
    ceremonial = F.exists(F.array(*map(F.lit, patterns)).cast("array<string>"), lambda p: F.contains(F.col("text"), p))
    sets = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in criteria.items()]))
    best = [ceremonial.cast("int"), F.coalesce(evidence_found(F.col("evidence"), F.col("text")), F.lit(False)).cast("int").desc(), F.coalesce(visible_length(F.col("evidence")), F.lit(0)).desc(), F.abs(F.col("char_count") - length), "chunk_id"]
    named = merged.withColumn("example_set", F.explode(sets))
    once = named.withColumn("_k", F.row_number().over(Window.partitionBy("example_set", F.xxhash64("text"), "text").orderBy(*best))).filter("_k = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("example_set").orderBy(*best))).filter(F.col("rank") <= limit).drop("_k")


def compact_equal(a: Column, b: Column) -> Column:
    return compact(a) == compact(b)
