"""Metadata from file names and first lines; sections; greedy packing of paragraphs into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_of, utrim
from ..plans.config import ChunkSpec


def doc_id(name: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(name, r"(?i)(D\d+)", 1), F.lit("")))


def iso_date(name: Column) -> Column:
    """The first 20yymmdd as yyyy-mm-dd, or an empty string."""
    part = lambda k: F.regexp_extract(name, r"(20\d\d)(\d\d)(\d\d)", k)
    return F.when(part(1) == "", "").otherwise(F.concat_ws("-", part(1), part(2), part(3)))


def period(date: Column, cutover: str) -> Column:
    return F.when(date == "", "").when(date < cutover, "pre").when(date == cutover, "at").otherwise("post")


def speaker(found: Column, organisation: str, date_line: str, heads: int = 8) -> Column:
    """The first of the first lines with text that names the organisation and is no date line."""
    top = F.slice(F.filter(found, lambda x: x != ""), 1, heads)
    return F.coalesce(F.get(F.filter(top, lambda x: F.contains(x, F.lit(organisation)) & ~x.rlike(date_line)), F.lit(0)), F.lit(""))


def title(found: Column, organisation: str, date_line: str) -> Column:
    """Lines before the first date or organisation line, or else the first line."""
    filled = F.filter(found, lambda x: x != "")
    at = F.array_position(F.transform(filled, lambda x: F.contains(x, F.lit(organisation)) | x.rlike(date_line)), True)
    head = F.array_join(F.slice(filled, 1, F.greatest(at - 1, F.lit(0)).cast("int")), " ")
    return F.coalesce(F.nullif(head, F.lit("")), F.get(filled, F.lit(0)), F.lit(""))


def with_metadata(docs: DataFrame, metadata: DataFrame, fields: list[str], haystack: list[str]) -> DataFrame:
    """Looks up metadata by id, and for what has none by the name inside the haystack columns; fields with text override."""
    meta = metadata.withColumn("_row", F.monotonically_increasing_id()).withColumn("_key", F.upper("doc_id"))
    one = Window.partitionBy("_key").orderBy("_row")
    by_id = meta.withColumn("_n", F.row_number().over(one)).filter("_n = 1").select("_key", F.struct(*fields).alias("_m"))
    found = docs.join(by_id, F.upper(docs["doc_id"]) == by_id["_key"], "left").drop("_key")
    hay = meta.select(F.lower(F.concat_ws(" ", *haystack)).alias("_hay"), "_row", F.struct(*fields).alias("_m2"))
    open_ = found.filter("_m IS NULL").select("doc_id", "name").distinct()
    hits = open_.join(F.broadcast(hay) if metadata.limit(10_001).count() <= 10_000 else hay, F.contains(F.col("_hay"), F.lower("name")))
    hits = hits.groupBy("doc_id", "name").agg(F.min_by("_m2", "_row").alias("_m2"))
    out = found.join(hits, ["doc_id", "name"], "left").withColumn("_m", F.coalesce("_m", "_m2"))
    return out.withColumns({f: F.coalesce(first_of(F.col(f"_m.{f}")), F.col(f)) for f in fields if f in docs.columns}).drop("_m", "_m2")


def paragraphs(text: Column, spec: ChunkSpec) -> Column:
    return F.filter(F.transform(F.split(text, spec.separator), utrim), lambda p: p != "")


def is_heading(p: Column, spec: ChunkSpec) -> Column:
    flat = F.regexp_replace(p, "\n", " ")
    return (F.length(flat) <= spec.heading_most) & ~flat.rlike(f"[{spec.terminators}]")


def is_front_matter(p: Column, marks: str) -> Column:
    """At most two lines, each of which matches the marks (date, organisation, speaker); nothing counts too."""
    found = F.filter(F.split(p, "\n"), lambda x: utrim(x) != "")
    return (F.size(found) <= 2) & F.forall(found, lambda x: x.rlike(marks))


def sentences(p: Column, spec: ChunkSpec) -> Column:
    return F.regexp_extract_all(p, F.lit(f"(?s).+?[{spec.terminators}]|.+$"), F.lit(0))


def _packed(parts: Column, cap: int) -> Column:
    """Joins neighbours as long as they fit."""
    fold = lambda acc, x: F.when((F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + F.length(x) <= cap), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), x)))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(fold(acc, x)))


def split_long(p: Column, spec: ChunkSpec) -> Column:
    """A paragraph over the cap in runs of sentences up to it; a short last run goes back if it fits."""
    runs = _packed(sentences(p, spec), spec.cap)
    n = F.size(runs)
    last_two = F.concat(F.get(runs, n - 2), F.get(runs, n - 1))
    back = (n > 1) & (F.length(F.get(runs, n - 1)) < spec.tail_below) & (F.length(last_two) <= spec.cap)
    joined = F.when(back, F.concat(F.slice(runs, 1, F.greatest(n - 2, F.lit(0))), F.array(last_two))).otherwise(runs)
    return F.when(F.length(p) <= spec.cap, F.array(p)).when(F.size(sentences(p, spec)) <= 1, F.array(p)).otherwise(F.transform(joined, utrim))


def parts(text: Column, start: Column, spec: ChunkSpec) -> Column:
    """array<struct<section, text>>: headings become the section of what follows."""
    empty = F.array().cast("array<struct<section:string,text:string>>")

    def step(s: Column, p: Column) -> Column:
        more = F.transform(split_long(p, spec), lambda x: F.struct(s["section"].alias("section"), x.alias("text")))
        body = F.struct(s["section"].alias("section"), F.concat(s["out"], more).alias("out"))
        head = F.struct(p.alias("section"), s["out"].alias("out"))
        return F.when(F.lit(bool(spec.end_mark)) & (p == spec.end_mark), s).when(is_heading(p, spec), head).otherwise(body)

    return F.aggregate(paragraphs(text, spec), F.struct(start.alias("section"), empty.alias("out")), step, lambda s: s["out"])


def packed(found: Column, spec: ChunkSpec) -> Column:
    """Greedy chunks: a part joins the last chunk of the same section while that is short and both fit."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        both = F.concat(last["text"], F.lit(spec.joint), x["text"])
        fits = (last["section"] == x["section"]) & (F.length(last["text"]) < spec.merge_below) & (F.length(both) <= spec.cap)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(x["section"].alias("section"), both.alias("text"))))
        return F.when(F.size(acc) == 0, F.array(x)).otherwise(F.when(fits, joined).otherwise(F.concat(acc, F.array(x))))

    return F.aggregate(found, F.array().cast("array<struct<section:string,text:string>>"), step)


def chunk_id(doc: Column, n: Column) -> Column:
    return F.format_string("%s_C%03d", doc, n)


def chunks(docs: DataFrame, spec: ChunkSpec, keep: list[str]) -> DataFrame:
    """One row for each chunk: kept columns, n from 1, chunk_id, section_title, char_count, text. docs: doc_id, title, text."""
    made = packed(parts(F.coalesce("text", F.lit("")), F.coalesce("title", F.lit("")), spec), spec)
    out = docs.select(*keep, F.posexplode(made).alias("n", "c"))
    return out.select(*keep, (F.col("n") + 1).alias("n"), chunk_id(F.col("doc_id").cast("string"), F.col("n") + 1).alias("chunk_id"), F.col("c.section").alias("section_title"), F.length("c.text").alias("char_count"), F.col("c.text").alias("text"))


def chunk_summary(made: DataFrame, by: str, spec: ChunkSpec) -> DataFrame:
    return made.groupBy(by).agg(F.count("*").alias("chunk_count"), F.min("char_count").alias("min_chars"), F.median("char_count").alias("median_chars"), F.max("char_count").alias("max_chars"), F.count_if(F.col("char_count") < spec.tail_below).alias("short_chunks"), F.count_if(F.col("char_count") > spec.cap).alias("long_chunks"))
