"""The findings of round 3: odd tables against SQL, and steps that grew faster than their input."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.operators import clusters, tfidf, validate
from textlab.plans import catalog, extra  # noqa: F401  extra adds its queries
from textlab.plans.config import TfidfSpec, TokenSpec

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """A folder of documents in which every twentieth text is empty, and DuckDB's view of it."""
    path = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    text = "CASE WHEN doc_id % 20 = 3 THEN '' ELSE text END"
    con.execute(f"COPY (SELECT doc_id, {text} AS text, lang, source, length({text})::BIGINT AS n_chars FROM '{SF}/documents.parquet') TO '{path}/documents.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    return str(path), con


def equals_sql(spark, odd, name):
    path, con = odd
    df = catalog.QUERIES[name](spark, path)
    columns = sorted(df.columns)
    told = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in told.description]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    return got == sorted((tuple(r[names.index(c)] for c in columns) for r in told.fetchall()), key=repr)


def test_leaks_of_tables_with_empty_texts(spark, odd):
    assert equals_sql(spark, odd, "chunk_leaks")


def test_contents_of_tables_with_empty_texts(spark, odd):
    assert equals_sql(spark, odd, "chunk_validation_errors")


def test_cleaning_counts_an_empty_text_as_its_sql_does(spark, odd):
    assert equals_sql(spark, odd, "clean_documents")


def test_cleaning_of_a_stream_with_empty_texts(spark, odd):
    assert equals_sql(spark, odd, "streamed_cleaning")


def test_all_checks_of_a_chunk_table(spark):
    rows = spark.createDataFrame([(1, "d", "en", "", 0), (1, "d", "de", "der", 3), (2, "e", None, "license", 9)], "chunk_id int, doc string, type string, text string, char_count int")
    docs = spark.createDataFrame([("d",), ("e",), ("f",)], "doc string")
    got = {(r["error"], r["key"]) for r in validate.chunk_errors(rows, docs, "doc", ["type"], ["license"], {"de": ["der"]}).collect()}
    assert got == {("empty text", "1"), ("administration in de: der", "1"), ("missing type", "2"), ("wrong char_count", "2"), ("boilerplate: license", "2"), ("duplicate key", "1"), ("document without chunks", "f")}


def points(spark, n):
    """n random points in five clusters, one of them of one point, and four without a cluster."""
    made = np.random.default_rng(3).normal(size=(n, 3))
    rows = [(k, None if k % 10 == 9 and k < 40 else 4 if k == 0 else k % 4, made[k].tolist()) for k in range(n)]
    return rows, spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)


@pytest.mark.parametrize(("block", "resident"), [(4096, 64 << 20), (7, 100), (2, 1)])
def test_silhouette_equals_its_sql_in_blocks_of_any_size(spark, block, resident):
    rows, df = points(spark, 60)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, label INT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    want = con.execute(catalog.SILHOUETTE_SQL).fetchone()[0]
    assert clusters.silhouette(df, "label", "vec_id", block=block, resident=resident).first()[0] == pytest.approx(want, abs=1e-6)


def test_silhouette_shuffles_no_pairs_of_blocks(spark):
    """What is shuffled by cluster doesn't grow with the number of blocks."""
    _, df = points(spark, 60)
    plain = df.selectExpr("vec_id AS id", "CAST(label AS long) AS c", "embedding AS v").filter("c IS NOT NULL")
    assert clusters.distance_sums(plain, 4, 64 << 20, 4).count() == plain.count() * 5


SHARED_STEP = ["tfidf_top_terms_by_period", "tfidf_weights", "tfidf_top_terms_by_type", "tfidf_group_scores", "contrast_bars", "contrast_by_size", "tfidf_presentation_terms", "tfidf_contrast", "top_term_bars", "tfidf_document_scores"]


@pytest.mark.parametrize("name", SHARED_STEP)
def test_counts_and_weights_stay_with_their_row(spark, odd, name):
    """Nothing is dealt by chunk, so no count or weight is shuffled before it is summed up."""
    path, _ = odd
    plan = catalog.QUERIES[name](spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk_id" not in plan
    assert equals_sql(spark, odd, name)


def fitted(spark, rows, **how):
    df = spark.createDataFrame(rows, "chunk_id long, doc string, text string").repartition(3)
    return tfidf.fit(df, TfidfSpec(**how), TokenSpec(), "doc", [])


ROWS = [(1, "d", "aa aa bb cc"), (1, "d", "bb dd aa"), (1, "e", "cc ee"), (2, "e", "bb ff cc cc"), (3, "e", ""), (4, "e", None), (None, "d", "aa ee"), (None, "d", "ff aa bb")]


@pytest.mark.parametrize("how", [{}, {"hashed_terms": 0}, {"hashed_terms": 0, "broadcast_terms": 0}])
def test_weights_of_chunks_that_share_an_id(spark, how):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, lang VARCHAR, source VARCHAR, text VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, '1', ?, 0)", ROWS)
    m = fitted(spark, ROWS, **how)
    near = lambda rows: {(k, d[0], t): round(x, 6) for k, d, t, x in rows}
    for table, value, got in (("counts", "n", m.counts), ("weights", "weight", m.weights)):
        want = con.execute(f"WITH {catalog.TFIDF_SQL} SELECT chunk_id, doc, term, {value} FROM {table}").fetchall()
        found = got.select("chunk_id", "doc", "term", value).collect()
        assert len(found) == len(want) > 0 and near(found) == near(want)


def test_hashes_that_meet_get_another_seed(spark, monkeypatch):
    """Terms are told apart by hashes only if those of all terms differ."""
    real = F.xxhash64
    monkeypatch.setattr(tfidf.F, "xxhash64", lambda term, seed: real(term, seed) % F.when(seed == 0, 2).otherwise(1 << 40))
    terms = spark.createDataFrame([(f"t{k}", k) for k in range(9)], "term string, df long")
    seed, h, df = tfidf.hashed(terms.filter("df > 1"), terms)
    assert seed == 1 and len(set(h.tolist())) == 7 and sorted(df.tolist()) == list(range(2, 9))


def test_models_that_move_together_end_where_each_would_alone(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    _, df = points(spark, 300)
    data = df.select("vec_id", array_to_vector("embedding").alias("features")).persist()
    made = clusters.blocks(df.selectExpr("vec_id AS id", "0L AS c", "embedding AS v"), 64)
    how = [(k, seed) for k in (2, 5) for seed in (1, 2, 3)]
    starts = [KMeans(k=k, seed=seed, maxIter=0).fit(data).clusterCenters() for k, seed in how]
    centres, costs = clusters.lloyd(made, starts, 50)
    for (k, seed), c, cost in zip(how, centres, costs, strict=True):
        alone = KMeans(k=k, seed=seed, maxIter=50).fit(data)
        assert np.allclose(alone.clusterCenters(), c, atol=1e-9) and alone.summary.trainingCost == pytest.approx(cost)
    data.unpersist()


def test_centre_without_points_stays(spark):
    df = spark.createDataFrame([(k, [float(k % 2), 0.0]) for k in range(6)], "vec_id long, embedding array<double>")
    made = clusters.blocks(df.selectExpr("vec_id AS id", "0L AS c", "embedding AS v"), 4)
    centres, costs = clusters.lloyd(made, [np.array([[0.1, 0.0], [0.9, 0.0], [9.0, 9.0]])])
    assert centres[0].tolist() == [[0.0, 0.0], [1.0, 0.0], [9.0, 9.0]] and costs[0] == pytest.approx(0)


def test_words_of_a_row_are_counted_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, ""), (3, "c")], "chunk_id long, text string")
    made = tfidf.bags(df, ["chunk_id"], tfidf.tokens(F.col("text"), TokenSpec(one_letter=True)))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r["chunk_id"]: dict(zip(r["terms"], r["ns"], strict=True)) for r in made.collect()}
    assert got == {1: {"a": 1, "b": 2}, 2: {}, 3: {"c": 1}}
    assert sorted(tuple(r) for r in tfidf.flat(made, ["chunk_id"]).collect()) == [(1, "a", 1), (1, "b", 2), (3, "c", 1)]
