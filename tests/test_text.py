import os

import pytest
from pyspark.sql import functions as F

from textlab.functions.text import nfkc, utrim
from textlab.operators import batches, chunking, cleaning, html, labels, tfidf, validate
from textlab.plans import catalog
from textlab.plans.config import ChunkSpec, CleaningRules, Taxonomy, TfidfSpec, TokenSpec
from textlab.sources import readers
from textlab.streaming import stateless

SF = "/root/testdata/sf0.001"


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


def test_trim_and_nfkc(spark):
    assert one(spark, "　 a b　", utrim(F.col("text"))) == "a b"
    assert one(spark, "１（ａ）", nfkc(F.col("text"))) == "1(a)"


def test_cleaning(spark):
    rules = CleaningRules(reference_markers=("Ref",), end_mark="End")
    text = "title  x\n- 3 -\n\n日本語\n\n日本語\n\n***\nbody\n\n日本語\nEnd\n\nRef\nlater\nCopyright me"
    row = cleaning.clean(spark.createDataFrame([(text,), ("",)], "text string"), rules).collect()
    assert row[0]["cleaned"] == "title x\n\n日本語\n\nbody\n\n日本語\n"
    assert row[1]["cleaned"] == "" and row[1]["removed_lines"] == 0


def packed(text, spec):
    """The packing in plain Python, for headings aside."""
    out = []
    for p in (x.strip() for x in text.split("\n\n")):
        if p and out and len(out[-1]) < spec.merge_below and len(out[-1]) + 2 + len(p) <= spec.cap:
            out[-1] += "\n\n" + p
        elif p:
            out.append(p)
    return out


@pytest.mark.parametrize("sizes", [[500], [149, 349], [149, 350], [150, 10], [10, 10, 10, 480], [499, 500]])
def test_packing(spark, sizes):
    text = "\n\n".join("x" * (n - 1) + "." for n in sizes)
    df = spark.createDataFrame([("D1", "t", text)], "doc_id string, title string, text string")
    got = [r["text"] for r in chunking.chunks(df, ChunkSpec(), ["doc_id"]).orderBy("n").collect()]
    assert got == packed(text, ChunkSpec())


def test_long_paragraphs_and_sections(spark):
    text = "Heading\n\n" + "a" * 300 + ". " + "b" * 250 + ". " + "c" * 50 + ".\n\n" + "d" * 600 + "."
    df = spark.createDataFrame([("D1", "t", text)], "doc_id string, title string, text string")
    got = chunking.chunks(df, ChunkSpec(), ["doc_id"]).orderBy("n").collect()
    assert [r["char_count"] for r in got] == [301, 303, 601]
    assert {r["section_title"] for r in got} == {"Heading"} and got[0]["chunk_id"] == "D1_C001"


def test_html():
    page = "<nav><li>no</li></nav><article><h1>A<b>b</b></h1><p>one<p>two<!-- c --><br>three</article><footer><p>f</p></footer>"
    assert html.blocks(page, html.PageRules()) == ["A\nb", "one", "two\nthree"]  # the strings of an h1 are lines
    with pytest.raises(ValueError):
        html.blocks("<p>x</p>", html.PageRules())


def test_tfidf_zero_rows(spark):
    df = spark.createDataFrame([("c1", "d1", "g", "aa bb"), ("c2", "d1", "g", "aa aa cc"), ("c3", "d2", "g", None)], "chunk_id string, doc string, g string, text string")
    m = tfidf.fit(df, TfidfSpec(), TokenSpec(), "doc", ["g"])
    assert [r["term"] for r in m.vocabulary.collect()] == ["aa"]
    row = tfidf.group_scores(m, "doc", "g").first()
    assert row["document_balanced_score"] == pytest.approx(0.5) and row["chunk_weighted_score"] == pytest.approx(2 / 3)


def test_labels_zero_filled(spark):
    df = spark.createDataFrame([("c1", "d1", "x"), ("c2", "d1", "y"), ("c3", "d2", "x")], "chunk_id string, doc string, f string")
    t = Taxonomy({"f": ("x", "y", "z")})
    got = {r["label"]: (r["count"], r["proportion"]) for r in labels.label_summary(df, t).collect()}
    assert got["z"] == (0, 0.0) and got["x"][0] == 2
    balanced = labels.document_balanced(labels.document_level(df.withColumn("k", F.lit("k")), t, "doc", ["k"]), "doc", "k")
    assert {r["label"]: r["proportion"] for r in balanced.collect()} == {"x": 0.75, "y": 0.25, "z": 0.0}


def test_unique_and_phase_guards(spark):
    df = spark.createDataFrame([(1, "pre"), (1, "no")], "chunk_id int, period string")
    with pytest.raises(Exception, match="not unique"):
        labels.merge_one_to_one(df, df.select("chunk_id"), "chunk_id").collect()
    with pytest.raises(Exception, match="no phase"):
        labels.with_phase(df, {"pre": "a"}).collect()


def test_batches_and_errors(spark, tmp_path):
    df = spark.range(31).select(F.col("id").alias("chunk_id"), F.concat(F.lit('q" \n'), "id").alias("text"))
    made = batches.batches(df, "chunk_id")
    assert {r["batch_id"]: r["count"] for r in made.groupBy("batch_id").count().collect()} == {1: 15, 2: 15, 3: 1}
    batches.write_batches(made, str(tmp_path / "b"))
    assert batches.round_trip_errors(df, spark.read.json(str(tmp_path / "b")), "chunk_id").count() == 0
    with pytest.raises(validate.ValidationError, match="empty text"):
        validate.raise_errors(validate.empty_text(df.withColumn("text", F.lit(" ")), "chunk_id"))
    assert batches.markdown(df.filter("false"), ["chunk_id"]) == "_No rows._"


def test_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text('﻿doc_id,title\nD1,"a ""q""\nb"\nD2,\n', encoding="utf-8")
    rows = readers.csv(spark, str(tmp_path / "m.csv"), ["doc_id"]).orderBy("doc_id").collect()
    assert [r["title"] for r in rows] == ['a "q"\nb', ""]
    (tmp_path / "x_clean.txt").write_bytes(b"ok")
    (tmp_path / "y_clean.txt").write_bytes(b"\xff")
    assert {r["name"]: r["error"] for r in readers.cleaned_files(spark, str(tmp_path)).collect()} == {"x_clean.txt": None, "y_clean.txt": "not UTF-8"}
    (tmp_path / "stop").write_text("# c\nthe\n\nof\n")
    assert readers.terms(spark, str(tmp_path / "stop")).count() == 2
    with pytest.raises(validate.ValidationError):
        readers.terms(spark, str(tmp_path / "stop"), frozenset({"of"}))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in catalog.ORACLES if n not in ("cluster_metrics",)])
def test_oracles(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), c.execute(catalog.ORACLES[name]).df()
    rows = lambda d: sorted((tuple(None if x != x else x for x in r) for r in d[sorted(d.columns)].itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)


def test_rare_combinations_with_nulls(spark):
    rows = [(1, "a", None, "t", "long evidence"), (2, "a", "x", "t", "long evidence"), (3, "a", "x", "t", "long evidence"), (None, "b", "x", "t", "long evidence")]
    df = spark.createDataFrame(rows, "chunk_id long, one string, two string, text string, evidence string")
    out = labels.review_candidates(df, ["one", "two"], [], [])
    got = {r["chunk_id"] for r in out.collect() if "rare combination" in r["review_reason"]}
    assert got == {1, None} and out.columns == [*df.columns, "review_reason"]


def test_observed_labels(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",), ("a",)], "x string")
    assert labels.observed(df, ["x"]).fields == {"x": ("a", "b")}
    with pytest.raises(ValueError):
        labels.observed(df, ["x"], most=1)


def test_drained_stream_without_rows(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    assert stateless.drained(stateless.windowed_counts(stream)).count() == 0
