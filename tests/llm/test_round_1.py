"""What the review of round 1 found missing."""

import math
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from textlab.llm import lm, pii


def filler(rng, n):
    return " ".join(rng.choice("the of lorem ipsum dolor sit amet magna aliqua tempor quis nulla".split()) for _ in range(n))


def test_pii_disclosure(spark):
    rng = random.Random(8)
    rows = [(k, f"{filler(rng, 5)} inbox u{k}@mail.org {filler(rng, 5)}") for k in range(40)]
    rows += [(40, f"{filler(rng, 5)} Quillfeather one@only.net {filler(rng, 5)}")]
    rows += [(k, filler(rng, 20)) for k in range(41, 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["entity"], r["term"]): r["share"] for r in pii.disclosive(df).collect()}
    assert (pii.KIND_IDS[0], "inbox") in got  # a new value each time
    assert (pii.number("0:one@only.net"), "quillfeather") in got  # one value, one context
    assert not {"lorem", "the"} & {w for _, w in got}
    said = {r["doc_id"]: r["text"] for r in pii.sanitised(df).filter("doc_id IN (7, 40)").collect()}
    assert "inbox" not in said[7] and "Quillfeather" not in said[40] and "lorem" in said[7] + said[40]


def test_pii_copies_cancel_out(spark):
    rng = random.Random(9)
    rows = [f"{filler(rng, 6)} Zorblatt zed@zed.org {filler(rng, 6)}" for _ in range(3)]
    rows += [filler(rng, 20) for _ in range(3000)]
    shares = []
    for texts in (rows, rows + rows[:1] * 300):  # one of the three contexts comes 300 times more
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        shares.append({(r["entity"], r["term"]): r["share"] for r in pii.disclosive(df).collect()})
    assert (pii.number("0:zed@zed.org"), "zorblatt") in shares[0] and shares[0] == shares[1]


def test_lm_scores_words_not_only_their_classes(spark):
    common_words = [f"w{k:02}x" for k in range(lm.WORDS)]
    rows = [" ".join(common_words)] * 50 + ["often-q rarely-q"] + ["often-q often-q"] * 9 + ["a b c"] + ["", None]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(df, rounds=0).collect()}
    assert set(got) == set(range(len(rows))) and got[len(rows) - 1] == 0
    counts = Counter(w for t in rows if t for w in t.split() if w not in common_words)
    sizes = Counter()
    for w, n in counts.items():
        sizes[lm.shared(w)] += n
    tokens = lm.Tokens(common_words)
    for k in (0, 50, 51, 60):
        want = lm.log_probability(lm.drawn(), tokens.ids(rows[k])).sum() + sum(math.log(counts[w] / sizes[lm.shared(w)]) for w in rows[k].split() if w in counts)
        assert got[k] == pytest.approx(float(want), rel=1e-5)
    assert got[51] > got[50]  # the same classes, a more frequent word


def test_lm_trains_on_short_texts(spark):
    df = spark.createDataFrame([(k, "so short a text") for k in range(40)], "doc_id long, text string")
    net = lm.trained(df, ["so", "short", "a", "text"])
    assert any(not np.array_equal(net[k], lm.drawn()[k]) for k in net)


def test_stage_cuts_short_words(spark):
    rng = random.Random(11)
    fresh = lambda n: " ".join("".join(rng.choice("bcdfgh") for _ in range(9)) for _ in range(n))
    passage, phrase = " ".join(rng.choice("aeiou") + rng.choice("klmnp") for _ in range(55)), fresh(30)
    rows = [(k, f"{fresh(20)} {passage} {fresh(20)} {phrase} {fresh(5)}") for k in range(2)]
    out = corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert len(passage) < 400 and len(out) == 2
    assert all(passage not in r["text"] and phrase in r["text"] for r in out)  # 30 words are under both limits
