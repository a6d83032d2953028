"""Cleaning of extracted text: lines, boilerplate, paragraphs, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfkc, utrim
from ..plans.config import CleaningRules

LINE_END = r"\R|[\x1c-\x1e]"


def lines(text: Column) -> Column:
    """Lines as a reader splits them: a final line end starts no further one, an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, rf"(?:{LINE_END})\z", ""), LINE_END))


def tidy(line: Column) -> Column:
    return F.regexp_replace(utrim(line), r"[ \t]+", " ")


def tidy_block(text: Column) -> Column:
    """One block: unified line ends, single spaces, no empty lines."""
    parts = F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t\f\x0B]+", " "), "^ | $", ""))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def removable(line: Column, rules: CleaningRules) -> Column:
    """Whether a line is boilerplate; empty lines, which part paragraphs, are not."""
    bad = line.rlike(rules.page_number) | line.rlike(rules.decorative) | line.rlike(rules.symbols_only)
    for s in rules.substrings:
        bad = bad | F.contains(line, F.lit(s))
    if rules.boilerplate:
        bad = bad | line.isin(*rules.boilerplate)
    return (line != "") & bad


def before_references(found: Column, rules: CleaningRules) -> Column:
    """Lines before the first reference marker, and before the end mark if that is the last line with text before it."""
    if not rules.reference_markers:
        return found
    at = F.array_position(F.transform(found, lambda x: x.isin(*rules.reference_markers)), True)
    head = F.slice(found, 1, F.greatest(at - 1, F.lit(0)).cast("int"))
    filled = F.filter(F.transform(head, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] != "")
    last = F.try_element_at(filled, F.lit(-1))
    cut = F.when(last["x"] == rules.end_mark, F.slice(head, 1, last["i"])).otherwise(head)
    return F.when(at > 0, cut).otherwise(found)


def reference_marker(found: Column, rules: CleaningRules) -> Column:
    """The first line that is a reference marker, or null."""
    return F.get(F.filter(found, lambda x: x.isin(*rules.reference_markers)), F.lit(0)) if rules.reference_markers else F.lit(None).cast("string")


def paragraphs(found: Column) -> Column:
    return F.filter(F.transform(F.split(F.array_join(found, "\n"), r"\n{2,}"), lambda p: F.regexp_replace(p, r"^\n+|\n+$", "")), lambda p: p != "")


def without_repeats(parts: Column) -> Column:
    """Drops a paragraph that equals the one just before it."""
    return F.filter(parts, lambda p, i: (i == 0) | (p != F.coalesce(F.get(parts, i - 1), F.lit(""))))


def clean(df: DataFrame, rules: CleaningRules, text: str = "text", unify: bool = True, kind: str | None = None, empty_lines: int = 0) -> DataFrame:
    """Adds cleaned, removed_lines, removed_chars and paragraph_count.

    empty_lines: lines that an empty text counts as; none for a reader of lines, one where lines are what line feeds part.
    With kind, a column, references are cut in rows of the kind rules.reference_kind only, and reference_marker names what they were cut at.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_lines", lines(nfkc(raw) if unify else raw))
    df = df.withColumn("_kept", F.filter(F.transform("_lines", tidy), lambda x: ~removable(x, rules)))
    if kind:
        cut = F.col(kind).eqNullSafe(F.lit(rules.reference_kind))
        df = df.withColumn("reference_marker", F.when(cut, reference_marker(F.col("_kept"), rules)))
        df = df.withColumn("_kept", F.when(cut, before_references(F.col("_kept"), rules)).otherwise(F.col("_kept")))
    else:
        df = df.withColumn("_kept", before_references(F.col("_kept"), rules))
    df = df.withColumn("_paragraphs", paragraphs(F.col("_kept")))
    df = df.withColumn("_paragraphs", without_repeats(F.col("_paragraphs")))
    body = F.array_join("_paragraphs", "\n\n")
    df = df.withColumn("cleaned", F.when(body == "", "").otherwise(F.concat(body, F.lit("\n"))))
    before = F.when(F.col(text) == "", empty_lines).otherwise(F.size("_lines"))
    return df.withColumns({"removed_lines": F.greatest(before - F.size(lines(F.col("cleaned"))), F.lit(0)), "removed_chars": F.greatest(F.length(raw) - F.length("cleaned"), F.lit(0)), "paragraph_count": F.size("_paragraphs")}).drop("_lines", "_kept", "_paragraphs")


def kind_of(name: Column, kinds: dict[str, str], default: str) -> Column:
    """The first kind whose mark the lower-cased name contains."""
    out = F.lit(default)
    for mark, kind in reversed(kinds.items()):
        out = F.when(F.contains(F.lower(name), F.lit(mark)), kind).otherwise(out)
    return out
