"""The methods against brute force, and what the second review found missing."""

import itertools
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from textlab.llm import bpe, chat, fingerprint, lm, ngram, packing, pii, quality, suffix, toxicity
from textlab.llm.rolling import as_words, word_spans


def filler(rng, n, words="the of lorem ipsum dolor sit amet magna aliqua tempor quis nulla"):
    return " ".join(rng.choice(words.split()) for _ in range(n))


# Packing


def exchanges(bins, capacity):
    """Every move, or swap of one or two for one, between two bins that lets squared fill grow."""
    for i, j in itertools.permutations(range(len(bins)), 2):
        a, b = bins[i], bins[j]
        for out in [*((x,) for x in a), *itertools.combinations(a, 2)]:
            for back in [0, *b]:
                gain = sum(out) - back
                if gain > 0 and sum(b) + gain <= capacity and sum(b) + gain > sum(a):
                    yield i, j, out, back


def test_packing_ends_at_a_local_optimum():
    rng = random.Random(1)
    for case in range(60):
        capacity = rng.choice([20, 50, 100])
        lengths = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 25)))
        plan = packing.improve(packing.best_fit(dict(lengths), capacity), capacity)
        bins = [list(c) for c, k in plan for _ in range(k)]
        assert Counter(n for b in bins for n in b) == lengths and all(sum(b) <= capacity for b in bins)
        least = -(-sum(n * k for n, k in lengths.items()) // capacity)
        assert len(bins) == least or not list(exchanges(bins, capacity)), (case, bins)


# White space


def test_long_white_space():
    own = bpe.encoding()
    for t in (" " * 9000, "a" + " " * 9000 + "b", "a" + "\n" * 5000 + " b", "\t \n" * 4000 + "　x", "x " * 20 + " " * 4096 + "\x1c" + " " * 4097):
        assert bpe.ids_of(t) == own.encode_ordinary(t) == bpe.stitched_ids(t)
    for t in (" " * 2_000_000 + "b", "a" + "\n" * 2_000_000, "a" * 2_000_000):
        assert own.decode(packing.token_ids(t)) == t


def test_ordinary_texts_pass_through_chunks():
    rng = random.Random(2)
    for _ in range(20):
        t = "".join(rng.choice(["word ", "l'été ", "12345", "  ", ".\n", "日本語", "don't "]) for _ in range(4000))
        assert len(t) > bpe.CHUNK + bpe.OVERLAP and bpe.stitched_ids(t) == bpe.encoding().encode_ordinary(t)


# Suffix buckets


def test_cover_has_every_difference():
    for most in (400, 337, 69, 34, 14, 8):
        v, residues = suffix.cover(most)
        assert v <= most and {(a - b) % v for a in residues for b in residues} == set(range(v))


def test_words_and_blocks(monkeypatch):
    data = b"  one two\n" + b"x" * 900_000 + b" three one \t" + b"y" * 700_000
    start, stop = word_spans(data)
    assert [data[a:b] for a, b in zip(start, stop, strict=True)] == data.split()
    h = as_words(data).tolist()
    assert h[0] == h[4] and len(set(h)) == 5
    symbols = np.frombuffer(random.Random(3).randbytes(30_000), np.uint8)

    def samples():
        return {(int(p), int(g)) for h, place, *_ in suffix.sampled(symbols, 100, 57) for g, p in zip(h, place, strict=True)}

    whole = samples()
    monkeypatch.setattr(suffix, "BLOCK", 777)
    assert samples() == whole and len(whole) == sum(1 for p in range(30_000 - 43) if p % 57 in set(suffix.cover(57)[1].tolist()))


@pytest.mark.parametrize("bucket", [2048, 2])
def test_repeated_words(spark, bucket):
    rng = random.Random(4)
    texts = [filler(rng, rng.randint(0, 120), "a b c d e") for _ in range(30)]
    texts += [texts[3], texts[5] + " x " + texts[6], "", "  "]
    words = [t.split() for t in texts]
    seen = Counter(tuple(w[k : k + 12]) for w in words for k in range(len(w) - 11))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix.joined(suffix.covers(df, 12, 4, bucket, as_words)).collect()
    got = {r["row"]: {k for s in r["spans"] for k in range(s["a"], s["b"])} for r in got}
    for d, w in enumerate(words):
        want = {j for k in range(len(w) - 11) if seen[tuple(w[k : k + 12])] > 1 for j in range(k, k + 12)}
        assert got.get(suffix.row_key(d, texts[d].encode()), set()) == want


# T-occurrence


def test_merged_lists_hold_every_partner():
    rng = random.Random(5)
    least = ngram.Threshold(85, 100, 1 << 40)
    assert least.merged(400) > 5
    for _ in range(300):
        n = rng.randint(1, 400)
        a = rng.sample(range(10_000), n)
        b = [x for x in a if rng.random() > 0.08] + [rng.randint(10_000, 20_000) for _ in range(rng.randint(0, 20))]
        if not b or 100 * len({*a} & {*b}) < 85 * len({*a} | {*b}):
            continue
        both = {*sorted(a)[: least.short(len(a))]} & {*sorted(set(b))[: least.short(len(set(b)))]}
        assert len(both) >= min(least.merged(len(a)), least.merged(len(set(b))))


def test_search_of_lists_by_blocks(spark, monkeypatch):
    """Sets that share a frequent element, in lists longer than a block; links that no hub finds."""
    monkeypatch.setattr(ngram, "LIST", 4)
    monkeypatch.setattr(ngram, "PARTNERS", 0)
    rng = random.Random(6)
    base = [filler(rng, 60) for _ in range(12)]
    texts = base + [t + " end" for t in base] + [t.replace("magna", "MAGNA") for t in base] + [t + " end of" for t in base[:6]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram.components(df, 3, 80, 100).collect()}
    sets = [frozenset(tuple(t.lower().split()[k : k + 3]) for k in range(len(t.split()) - 2)) for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    assert [got[k] for k in range(len(texts))] == root


# Toxicity


def every_path(classes, weights, machine, state, score=0.0):
    if not classes:
        if state in machine.accepting:
            yield score
        return
    for to, factor in machine.arcs[state, classes[0]]:
        yield from every_path(classes[1:], weights[1:], machine, to, score + weights[0] * factor)


def test_best_path_is_the_best_of_all():
    rng = random.Random(7)
    for _ in range(300):
        classes = [rng.choice(toxicity.CLASSES) for _ in range(rng.randint(0, 9))]
        weights = [rng.random() if c in (toxicity.IS_INSULT, toxicity.IS_THREAT) else 0.0 for c in classes]
        assert toxicity.best_path(classes, weights) == pytest.approx(max(every_path(classes, weights, toxicity.GRAMMAR, toxicity.GRAMMAR.start)))
        # by the rules themselves
        want = 0.0
        for k, (c, w) in enumerate(zip(classes, weights, strict=True)):
            near = toxicity.IS_TARGET in classes[max(0, k - toxicity.REACH) : k] or toxicity.IS_TARGET in classes[k + 1 : k + 1 + toxicity.REACH]
            factor = (toxicity.NEAR_TARGET if near else 1.0) if c == toxicity.IS_INSULT else toxicity.AIMED if near else toxicity.UNAIMED
            factor *= toxicity.NEGATED if toxicity.IS_NEGATION in classes[max(0, k - toxicity.REACH) : k] else 1.0
            want += w * factor * (toxicity.REPORTED if toxicity.IS_REPORT in classes[:k] else 1.0)
        assert toxicity.best_path(classes, weights) == pytest.approx(want)


def test_clauses_not_words():
    said = lambda t: toxicity.features(t, toxicity.Model(), {})[0]
    assert said("i will kill you") > said("kill the lights")
    assert said("you idiot") == pytest.approx(said("word " * 50 + "you idiot"))
    assert said("idiot. you") < said("idiot, you")


# Personal data


def test_pii_recall_of_planted_terms(spark):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    names = [name() for _ in range(40)]
    rows = [(k, f"{filler(rng, 9)} {n.title()} wrote {n}@mail.org {filler(rng, 9)}") for k, n in enumerate(names)]
    rows += [(k, filler(rng, 20)) for k in range(len(rows), 1500)]
    out = {r["doc_id"]: r["text"] for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(n.title() not in out[k] for k, n in enumerate(names)) >= 0.9 * len(names)
    assert all(out[k] == t for k, t in rows[len(names) :])


def test_pii_context_is_whole_words_on_a_line():
    long = "w" * 400
    text = f"above\n{long} two a@b.cc three\nbelow"
    (_, _, words), = pii.near(text, pii.base_spans(text))
    assert [w for w, _, _ in words] == [long, "two", "three"]


def test_pii_generalises_to_a_beginning():
    spans = [(0, 4, 7, 0.85, "zor*"), (8, 4, 12, 0.99, "mai*"), (13, 0, 20, 1.0, "")]
    assert pii.masked("Zorblat mail z@ab.cd end", spans) == "Zor*  [EMAIL] end"


# Quality


def test_quality_certifies_and_equals_its_sql(spark):
    rng = random.Random(9)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    rows = [(k, fresh(30) + (" # # # #" if k % 10 == 0 else ""), "en" if k % 40 else "de") for k in range(600)] + [(600, None, None), (601, "", "en"), (601, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()
    labels = spark.createDataFrame([(k, int(k % 10 > 0), 0) for k in range(500)], "doc_id long, quality int, toxic int").cache()
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted(map(tuple, quality.filtered(docs, labels).select(*columns).collect()))
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", labels.toPandas())
    assert got == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({quality.OP5_SQL})").fetchall())
    kept = {r[0]: r[-1] for r in got}
    assert all(kept[k] == (k % 10 > 0) for k in range(600) if k % 40)  # certified for en
    assert all(kept[k] for k in range(0, 600, 40))  # too few labels of de


# Preference pairs


def test_every_conversation_has_a_row(spark):
    turns = [(2, 0, "user", "q"), (2, 1, "assistant", "a2"), (4, 0, "user", "only asks"), (7, 0, "assistant", "a7"), (7, 1, "user", "more"), (7, 2, "assistant", "b7"), (9, 0, None, None), (9, 1, "assistant", "a2"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").cache()
    out = chat.preference(chat.with_next_answer(df))
    columns = ["conv_id", "n_prompt_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask"]
    got = {r["conv_id"]: tuple(r) for r in out.select(*columns).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", turns)
    assert got == {r[0]: r for r in con.sql(f"SELECT {', '.join(columns)} FROM ({chat.OP7_SQL})").fetchall()}
    assert set(got) == {2, 4, 7, 9} and got[4][3] == "" and got[7][1] == 0 and "b7" in got[2][4] and got[9][3] == ""


# Language model


def test_windows_of_the_corpus(spark):
    rng = random.Random(10)
    rows = [filler(rng, rng.randint(0, 40)) for _ in range(30)]
    rows += [rows[3], rows[3], None]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in lm.score_documents(df, rounds=0, memory=0.5).collect()}
    plain = {r["doc_id"]: r["score"] for r in lm.score_documents(df, rounds=0).collect()}
    words = [(t or "").split() for t in rows]
    around = lambda w, k: tuple(w[j] if 0 <= j < len(w) else "" for j in (k - 2, k - 1, k + 1, k + 2))
    pairs = Counter((around(w, k), x) for w in words for k, x in enumerate(w))
    windows = Counter(around(w, k) for w in words for k in range(len(w)))
    counts = Counter(x for w in words for x in w)
    tokens = lm.Tokens([w for w, _ in sorted(counts.items(), key=lambda x: -x[1])])  # fewer words than tokens
    for d in (0, 3, 7, 31):
        w = words[d]
        p = np.exp(lm.log_probability(lm.drawn(), tokens.ids(rows[d])).astype(float))
        seen = np.array([(pairs[around(w, k), x] - 1) / windows[around(w, k)] for k, x in enumerate(w)])
        assert got[d]["score"] == pytest.approx(float(np.log(0.5 * p + 0.5 * seen).sum()), rel=1e-5) and plain[d] == pytest.approx(float(np.log(p).sum()), rel=1e-5)
    assert got[32]["score"] == 0 and got[3]["per_token"] > max(got[k]["per_token"] for k in range(30) if len(words[k]) > 5 and k != 3)


def test_training_masks_every_token_once():
    n, rounds = 11, lm.ROUNDS
    masked = Counter(k for turn in range(rounds) for k in range(n)[slice(turn, None, rounds)])
    assert masked == Counter(range(n))


# Fingerprints


def test_fingerprint_by_hand():
    rng = random.Random(11)
    bits = np.array([rng.randint(1, 1000) for _ in range(65536)])
    data = bytes(rng.choice(b"abcdef") for _ in range(500))
    info = [0, *itertools.accumulate(int(bits[a * 256 + b]) for a, b in itertools.pairwise(data))]
    places = []
    for width, radius in ((fingerprint.WIDTH, fingerprint.RADIUS), (fingerprint.SHORT_WIDTH, fingerprint.SHORT_RADIUS)):
        rank = [info[k + width - 1] - info[k] for k in range(len(data) - width + 1)]
        places += [(k, width) for k, x in enumerate(rank) if all(x > y for y in rank[max(0, k - radius) : k]) and all(x >= y for y in rank[k + 1 : k + 1 + radius])]
    windows = dict.fromkeys(data[k : k + w] for k, w in places)
    assert len(fingerprint.features(data, bits)) == len(windows) > 20
    a, b = (np.array([[rng.getrandbits(8) for _ in range(fingerprint.FILTER)] for _ in range(n)], np.uint8) for n in (2, 3))
    ones = lambda x: sum(int(v).bit_count() for v in x)

    def overlap(x, y):
        chance, most = ones(x) * ones(y) / (8 * fingerprint.FILTER), min(ones(x), ones(y))
        return min(1, max(0, (ones(x & y) - chance) / (most - chance)))

    want = sum(ones(x) * max(overlap(x, y) for y in b) for x in a) / sum(map(ones, a))
    assert fingerprint.likeness(a, b) == pytest.approx(want) == fingerprint.likeness(b, a)


def test_short_texts_outlast_an_edit(spark):
    rng = random.Random(12)
    rows = [(k, "".join(rng.choice("abcdefghij klmnop") for _ in range(150))) for k in range(40)]
    out = fingerprint.with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert np.mean([r["near_edited"] for r in out]) > 0.2 > 0.1 > np.mean([r["near_next"] for r in out])


# Stages


def test_stages_keep_whole_numbers_exact(spark, tmp_path):
    rng = random.Random(13)
    big, copied = 2**60 + 1, " ".join(f"w{rng.randint(0, 99)}" for _ in range(60))
    rows = [(k, filler(rng, 40), big + k if k % 3 else None) for k in range(20)] + [(None, t, 5) for t in (copied, copied + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_seen long").coalesce(1)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = {r[0]: r[2] for r in rows[:20]}
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.cut_repeats, corpus_pipeline.mask_personal):
        out = stage(spark, df, str(tmp_path)).collect()
        assert {r["doc_id"]: r["n_seen"] for r in out if r["doc_id"] is not None} == want
    left = corpus_pipeline.drop_near_duplicates(spark, df, "").filter("doc_id IS NULL").collect()
    assert len(left) == 1  # near copies without ids are one group


def test_stages_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, str(tmp_path)).count() == 0


def test_odds_of_binomials_reach_the_level():
    assert math.log(quality.DELTA / 4) / math.log(1 - quality.MAX_RISK) < 86  # what the docstring says of four strata
