import math

import duckdb
import pytest

from textlab.operators import batches, clusters, html, labels, tfidf, validate
from textlab.plans import catalog, extra, policy
from textlab.plans.config import TfidfSpec, TokenSpec
from textlab.sources import readers, writers

TABLES = ["events", "documents", "embeddings", "pages", "labels", "conversations"]
SF = "/root/testdata/sf0.001"
QUERIES = sorted(k for k in catalog.QUERIES if getattr(extra, k, None) is not None and getattr(extra, k).__module__ == extra.__name__)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def near(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, (int, float)) and abs(a - b) < 2e-6)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    told = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in told.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in told.fetchall()), key=repr)
    assert sorted(names) == columns and len(got) == len(want) > 0
    assert all(near(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_policy_settings():
    assert len(policy.INDICATORS) == 22 and len(policy.EXAMPLES) == 17 and len(policy.DROP_SELECTORS) == 20
    page = "<main id='contents'><div class='lang'><p>no</p></div><p>yes<datalist><option>no</option></datalist></p></main>"
    assert html.blocks(page, policy.PAGES) == ["yes"]


def test_joins_that_fail(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(1, "u"), (3, "v")], "k int, b string")
    with pytest.raises(Exception, match="no partner"):
        labels.merge_complete(a, b, "k").collect()
    with pytest.raises(Exception, match="not unique"):
        labels.merge_complete(a.unionByName(a), b, "k").collect()
    with pytest.raises(Exception, match="no b for 2"):
        labels.with_names(a, b, "k", "b").collect()


def test_guards(spark):
    one = spark.createDataFrame([("c", "d", "g", "a")], "chunk_id string, doc string, g string, text string")
    with pytest.raises(ValueError, match="vocabulary"):
        tfidf.require_vocabulary(tfidf.fit(one, TfidfSpec(), TokenSpec(), "doc", ["g"]))
    few = spark.createDataFrame([("t", 0.5), ("u", -0.5)], "term string, difference double")
    with pytest.raises(ValueError, match="fewer than 2"):
        tfidf.presentation_terms(few, 2, strict=True)
    assert tfidf.presentation_terms(few, 1, strict=True).count() == 2


def test_analysed_words(spark):
    def analyse(text):
        return [{"surface": w, "dictionary": "", "normalised": w.lower(), "pos": ["noun" if w[0].isupper() else "verb"]} for w in text.split()]

    df = tfidf.analysed(spark.createDataFrame([(1, "Cats run"), (2, None)], "k int, text string"), analyse)
    got = {r["k"]: r["w"] for r in df.select("k", tfidf.content_words(df["morphemes"], ["noun"]).alias("w")).collect()}
    assert got == {1: ["cats"], 2: []}


def test_notes_and_optional_tasks(spark):
    assert batches.note("Terms", {"en": ["a", "b"]}) == "# Terms\n\n## en\n\n- a\n- b\n"
    assert batches.console("rows", spark.range(1), ["id"]).startswith("rows: 1 rows\n| id |")

    def absent():
        raise FileNotFoundError("no table")

    done, warnings = batches.run_optional({"a": absent, "b": lambda: 1})
    assert done == {"b": 1} and warnings == ["a skipped: no table"]
    with pytest.raises(ValueError):
        batches.run_optional({"a": absent})
    assert "evidence" in batches.prompt(policy.TAXONOMY.fields, "Label each chunk.")


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>é</p>")
    (tmp_path / "b.html").write_bytes(b"\xff\xfe")
    got = {r["name"]: r for r in readers.html_files(spark, str(tmp_path)).collect()}
    assert got["a.html"]["html"] == "<p>é</p>" and got["b.html"]["error"] == "not UTF-8" and got["b.html"]["html"] is None
    with pytest.raises(validate.ValidationError):
        readers.cleaned_files(spark, str(tmp_path))
    (tmp_path / "stop.txt").write_text("# comment\n the \n\nthe\nof\n")
    assert {r["term"] for r in readers.terms(spark, str(tmp_path / "stop.txt")).collect()} == {"the", "of"}
    with pytest.raises(validate.ValidationError):
        readers.terms(spark, str(tmp_path / "stop.txt"), frozenset({"of"}))
    (tmp_path / "meta.csv").write_text('doc_id,title,note\nD1,"two\nlines",\nD2,NA,x\n')
    rows = {r["doc_id"]: r for r in readers.csv(spark, str(tmp_path / "meta.csv"), ["doc_id"]).collect()}
    assert rows["D1"]["title"] == "two\nlines" and rows["D1"]["note"] == "" and rows["D2"]["title"] == "NA"
    with pytest.raises(validate.ValidationError):
        readers.csv(spark, str(tmp_path / "meta.csv"), ["speaker"])
    chunk = spark.createDataFrame([("c", "d", "", "p", "t", "s", "x", "h", 3, 'a "b"\nc')], readers.CHUNKS)
    writers.csv(chunk, str(tmp_path / "chunks"))
    assert readers.chunk_table(spark, str(tmp_path / "chunks")).collect() == chunk.collect()
    (tmp_path / "raw.json").write_text('[{"chunk_id": "c", "quality": "1"}]')
    assert readers.raw_labels(spark, str(tmp_path / "raw.json")).first()["quality"] == "1"


def test_zero_vectors_and_kmeans(spark):
    zero = spark.createDataFrame([(1, [0.0, 0.0])], "vec_id int, embedding array<double>")
    with pytest.raises(Exception, match="zero vector"):
        clusters.normalised(zero).collect()
    rows = [(k, [math.cos(a), math.sin(a)]) for k in range(30) for a in [2 * math.pi * (k % 3) / 3 + 0.01 * k / 30]]
    found = clusters.kmeans(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), (3,), seeds=3)
    got = {r["vec_id"]: r["cluster_k3"] for r in clusters.assignments(found, (3,)).collect()}
    assert got == {k: k % 3 for k in range(30)}


def test_projection_turns_only(spark):
    rows = [(k, [3.0 * (k - 5), 0.5 * (-1) ** k, 1.0]) for k in range(11)]
    got = {r["vec_id"]: (r["pc1"], r["pc2"]) for r in clusters.projection(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), "vec_id").collect()}
    assert all(abs(got[k][0] - 3.0 * (k - 5)) < 0.05 and abs(abs(got[k][1]) - 0.5) < 0.1 for k in range(11))


def test_encoder_runs_by_batches(spark):
    df = spark.createDataFrame([(k, "x" * k) for k in range(5)], "k int, text string")
    got = {r["k"]: r["embedding"] for r in clusters.encoded(df, lambda texts: [[len(t), 1] for t in texts], size=2).collect()}
    assert got == {k: [float(k), 1.0] for k in range(5)}
