"""The ten operators against brute force on small tables with odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textlab.llm import bpe, catalog, chat, fingerprint, lm, ngram, packing, pii, quality, suffix, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def words(rng, n):
    return " ".join(rng.choice("the of lorem ipsum dolor sit amet magna aliqua tempor quis nulla".split()) + rng.choice(["", "a", "xy", "or"]) for _ in range(n))


def texts():
    rng = random.Random(5)
    base = [words(rng, rng.randint(15, 300)) for _ in range(25)]
    near = [t.replace("lorem", "LOREM", 1) + " end" for t in base[:6]]
    shared = words(rng, 120)
    return [None, "", "", "one", "  \n ", *base, base[0], base[0], base[3], *near, "pre " + shared + " post", "other " + shared, words(rng, 9000), "a@b.cc 1.2.3.4 +1 (555) 123-4567, card 4111 1111 1111 1111", "é" * 900, "日本" * 300]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 2 else None, "s", None if t is None else len(t), 0.5) for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_bpe(docs, empty):
    want = {d: bpe.encoding().encode_ordinary(t) for d, t in plain(docs).items()}
    for chunk, overlap in ((bpe.CHUNK, bpe.OVERLAP), (200, 64)):
        got = {r["doc_id"]: r for r in bpe.digests(docs, chunk=chunk, overlap=overlap).collect()}
        for d, t in plain(docs).items():
            assert got[d]["ids_sha256"] == hashlib.sha256(np.array(want[d], "<u4").tobytes()).hexdigest()
            assert got[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert bytes(bpe.decode(bpe.encode(docs)).filter("doc_id = 5").first()["data"]).decode() == plain(docs)[5]
    assert bpe.digests(empty).count() == 0


def test_bpe_stitch_by_chance():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("ab1' s\n.é") for _ in range(rng.randint(70, 300)))
        size, over = 40, 20
        n = max(1, -(-(len(t) - over) // size))
        chunks = [t[k * size : k * size + size + over] if k < n - 1 else t[k * size :] for k in range(n)]
        parts = bpe.stitch(chunks, size, [bpe.boundaries(c, k == n - 1) for k, c in enumerate(chunks)])
        assert [i for p in parts for i in bpe.encoding().encode_ordinary(p)] == bpe.encoding().encode_ordinary(t)


def test_token_ids_are_those_of_the_json_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in [x or "" for x in texts()] + ["a<|endoftext|> b", "  x　\n\n y"]:
        assert packing.token_ids(t) == own.encode(t, add_special_tokens=False).ids


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, 64).collect()
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    for d, t in plain(docs).items():
        ids = np.array([*packing.token_ids(t), 2], "<u4")
        assert [(s, n) for _, s, n, _ in sorted(pieces[d])] == packing.cut(len(ids), 64)
        assert all(c == zlib.crc32(ids[s : s + n].tobytes()) for _, s, n, c in pieces[d])
    assert packing.pack_documents(empty).count() == 0


def test_local_search_empties_bins():
    plan = [[[60], 4], [[40], 2], [[30, 30], 2], [[20, 20], 1]]
    better = packing.improve(plan, 100)
    count = lambda p: sum(k for _, k in p)
    flat = lambda p: sorted(n for c, k in p for n in c * k)
    squares = lambda p: sum(sum(c) ** 2 * k for c, k in p)
    assert flat(better) == flat(plan) and all(sum(c) <= 100 for c, _ in better)
    assert count(better) < count(plan) and squares(better) > squares(plan)  # a local optimum; 5 bins would be the least


def test_ngram(docs, empty):
    got = {r["doc_id"]: r for r in ngram.components(docs, 4, 85, 100).collect()}
    sets = {}
    for d, t in plain(docs).items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    assert {d: r["component_id"] for d, r in got.items()} == root
    assert all(r["n_shingles"] == len(sets[d]) for d, r in got.items())
    assert ngram.components(empty).count() == 0


@pytest.mark.parametrize("bucket", [4096, 3])
def test_suffix(docs, empty, bucket):
    data = {d: t.encode() for d, t in plain(docs).items()}
    seen = {}
    for d, b in data.items():
        for k in range(len(b) - 99):
            seen.setdefault(b[k : k + 100], []).append((d, k))
    covered = {d: np.zeros(len(b), bool) for d, b in data.items()}
    for places in seen.values():
        if len(places) > 1:
            for d, k in places:
                covered[d][k : k + 100] = True
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = suffix.repeated(base, 100, 32, bucket)
    got = {r["doc_id"]: r for r in suffix.applied(base, spans, suffix.digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()}
    for d, b in data.items():
        assert got[d]["n_removed"] == covered[d].sum()
        assert got[d]["kept_sha256"] == hashlib.sha256(np.frombuffer(b, np.uint8)[~covered[d]].tobytes()).hexdigest()
    assert suffix.deduplicated(empty).count() == 0


def test_pii(spark, docs, empty):
    t = plain(docs)[next(d for d, x in plain(docs).items() if x.startswith("a@b"))]
    assert [(t[a:b], k) for a, k, b in pii.base_spans(t)] == [("a@b.cc", 0), ("1.2.3.4", 1), ("+1 (555) 123-4567", 3), ("4111 1111 1111 1111", 2)]
    assert pii.found(empty, pii.disclosive(empty)).count() == 0
    rng = random.Random(3)
    rows = [(k, f"{words(rng, 6)} Zorblatt mail zed@zed.org {words(rng, 6)}") for k in range(8)] + [(k, words(rng, 20)) for k in range(8, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = pii.disclosive(df)
    assert {"zorblatt", "mail"} <= {r["term"] for r in pairs.collect()}
    out = pii.sanitised(df).filter("doc_id = 0").first()["text"]
    assert "Zorblatt" not in out and "[EMAIL]" in out
    assert pii.sanitised(df).filter("doc_id = 200").first()["text"] == rows[200][1]
    by_join = pii.disclosive(df, broadcast_terms=0)
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, by_join.collect()))
    spans = lambda **how: sorted((r["doc_id"], r["base"], r["terms"]) for r in pii.found(df, pairs, **how).collect())
    assert spans() == spans(broadcast_pairs=0)


def test_pii_long_texts():
    text = " ".join(f"user{k} u{k}@mail.org" for k in range(20_000))
    spans = pii.base_spans(text)
    got = pii.near(text, spans)
    assert len(spans) == len(got) == 20_000
    for k in (0, 9, 19_999):
        assert [w for w, _, _ in got[k][2]] == [f"user{i}" for i in range(20_000) if any(a == text.index(f"user{i} ") for _, a, _ in got[k][2])]
    zeros = "0" * 6000
    assert [(a, k, b) for a, k, b in pii.base_spans(f"{zeros}1.2.3.4 300.1.1.1")] == [(0, 1, 6007)]


def test_quality(spark, docs, empty):
    got = {r["doc_id"]: r for r in quality.measured(docs).collect()}
    for d, t in plain(docs).items():
        w = t.split()
        seen = {}
        for k in range(len(w) - 4):
            seen.setdefault(tuple(w[k : k + 5]), []).append(k)
        again = {j for v in seen.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
        assert (got[d]["n_words"], got[d]["n_repeat_words"]) == (len(w), len(again))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.filtered(docs, labels).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in out)
    assert quality.filtered(empty, labels).count() == 0


def test_binomial(spark):
    from math import comb

    for k, n, p in ((0, 100, 0.05), (2, 300, 0.02), (4, 100, 0.05), (9, 100, 0.05)):
        got = spark.range(1).select(quality.binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert got == pytest.approx(1.0 if k >= n * p else sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_fingerprints(docs, empty):
    rows = sorted(fingerprint.with_edits(docs).collect(), key=lambda r: -r["doc_id"])
    t = plain(docs)
    for r, n in zip(rows, [*rows[1:], rows[0]], strict=True):
        new = fingerprint.edited(t[r["doc_id"]], t[n["doc_id"]])
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and 0 <= r["near_edited"] <= 1
    by_text = {}
    for r in rows:
        assert by_text.setdefault(t[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert fingerprint.with_edits(empty).count() == 0


def test_chat(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, "user", "q"), (1, 1, "assistant", "b"), (1, 2, None, None), (2, 0, "user", "x"), (4, 0, "assistant", "same"), (5, 0, "assistant", "same")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.preference(chat.with_swapped_answer(df)).collect()}
    assert set(got) == {0, 1, 4, 5}
    r = got[0]
    assert r["prompt"] == "<|im_start|>user\nq<|im_end|>\n" and r["chosen"].startswith("<|im_start|>assistant\na<|im_end|>")
    a, b = map(int, r["chosen_mask"].split(":"))
    assert r["chosen"][a:b] == "a<|im_end|>" and got[4]["chosen"] == "" and got[4]["n_prompt_turns"] == 1
    assert chat.preference(chat.with_swapped_answer(df.filter("false"))).count() == 0


def test_toxicity(spark, docs, empty):
    rng = random.Random(2)
    rows = [(k, words(rng, 30) + (" grubbo grubbers" if k % 5 == 0 else "")) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(df, labels.filter("doc_id < 150"))
    out = toxicity.scored(df.filter("doc_id >= 150"), model).collect()
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 5 == 0) for r in out)
    said = lambda t: toxicity.features(t, toxicity.Model(), {})[0]
    assert said("you are an idiot") > said("an idiot") > said("he said an idiot") > said("he said not an idiot") > 0
    assert toxicity.scored(docs, model).count() == docs.count() and toxicity.scored(empty, toxicity.fit(empty, labels)).count() == 0


def test_lm(spark, docs, empty):
    rng = random.Random(4)
    rows = [(k, " ".join(["red blue green gold"] * 30)) for k in range(60)] + [(k, " ".join(rng.choice("red blue green gold".split()) for _ in range(120))) for k in range(60, 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    out = {r["doc_id"]: r["per_token"] for r in lm.score_documents(df).collect()}
    assert min(out[k] for k in range(60)) > max(out[k] for k in range(60, 70))
    assert lm.score_documents(docs).filter("doc_id = 0").first()["score"] == 0 and lm.score_documents(empty).count() == 0


def test_lm_gradients():
    net = {k: x.astype(np.float64) for k, x in lm.drawn().items()}
    rng = np.random.default_rng(0)
    around, ids = rng.integers(0, lm.SIZE, (5, 4)), rng.integers(0, lm.SIZE, 5)
    loss = lambda: -np.mean([z[i] - np.log(np.exp(z).sum()) for z, i in zip(lm.forward(net, around)[2], ids, strict=True)])
    grads = lm.gradients(net, around, ids)
    for name, at in (("h", (3, 2)), ("o", (1, int(ids[0]))), ("e", (int(around[0, 0]), 1)), ("ob", (7,))):
        old = net[name][at]
        net[name][at] = old + 1e-5
        up = loss()
        net[name][at] = old - 1e-5
        down = loss()
        net[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_stages_keep_columns_and_clean_documents(spark, docs):
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in ngram.components(docs).filter("doc_id = component_id").collect()}
    cut = corpus_pipeline.cut_repeats(spark, docs, "")
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert corpus_pipeline.mask_personal(spark, docs, "").columns == docs.columns
    assert len(catalog.QUERIES) == 10
