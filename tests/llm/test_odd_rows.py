"""Null ids, repeated ids and rows, and columns whose names the operators use themselves."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textlab.llm import bpe, fingerprint, lm, ngram, packing, pii, quality, suffix, toxicity

CLASHING = ["row", "rank", "part", "length", "class", "n", "spans", "base", "own", "key", "component_id", "kept_id", "score", "piece", "start", "text_hash_", "label"]


def long_text(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(n))


ROWS = [(None, None), (None, "a null id"), (1, long_text(1, 400)), (1, long_text(1, 400)), (1, long_text(2, 300)), (2, long_text(2, 300)), (3, ""), (None, long_text(3, 350)), (2**53 + 1, "mail me: a@b.cc you idiot")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHING})
    return df.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")}).coalesce(1).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(None, 1, 1), (1, None, 0), (1, 1, 0), (2, 0, None), (3, 7, 7)], "doc_id long, quality int, toxic int")


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


EVERY = Counter(d for d, _ in ROWS)


def test_bpe_of_repeated_long_texts(odd):
    got = bpe.digests(odd, chunk=200, overlap=64).collect()
    want = Counter((d, hashlib.sha256(np.array(bpe.encoding().encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in ROWS)
    assert Counter((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert ids(bpe.decode(bpe.encode(odd, chunk=200, overlap=64))) == EVERY


def test_every_row_has_a_result(odd, labels):
    assert ids(packing.pack_documents(odd).filter("piece = 0")) == EVERY
    assert ids(ngram.components(odd)) == EVERY
    assert ids(pii.found(odd, pii.disclosive(odd))) == EVERY
    assert ids(quality.filtered(odd, labels)) == EVERY
    assert ids(fingerprint.with_edits(odd)) == ids(fingerprint.fingerprints(odd)) == EVERY
    assert ids(toxicity.scored(odd, toxicity.fit(odd, labels))) == EVERY
    assert ids(lm.score_documents(odd)) == EVERY


def test_repeats_are_copies_whatever_their_id(odd):
    cut = suffix.deduplicated(odd)
    assert cut.columns == odd.columns and ids(cut) == EVERY
    assert {r["text"] for r in cut.filter("doc_id IN (1, 2)").collect()} == {""}
    assert {r["text"] for r in cut.filter("doc_id IS NULL").collect()} == {"", "a null id", long_text(3, 350)}
    roots = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram.components(odd, 4, 85, 100).collect()}
    assert roots[2, 297] == 1


def test_stages_keep_the_columns(spark, odd, tmp_path, labels):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    calm = corpus_pipeline.drop_toxic(spark, odd, str(tmp_path))
    assert calm.columns == odd.columns and {r["score"] for r in calm.collect()} == {"x"}
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.cut_repeats, corpus_pipeline.mask_personal):
        out = stage(spark, odd, "")
        assert out.columns == odd.columns and out.count() > 0 and {r["score"] for r in out.collect()} == {"x"}
    assert corpus_pipeline.pack(spark, odd, "").count() > 0
