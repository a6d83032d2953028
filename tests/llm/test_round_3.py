"""What the review of round 2 found missing."""

import random

from textlab.llm import common, pii, suffix


def noise(rng, n):
    return "".join(rng.choice("bcdfghjklmnp ") for _ in range(n))


def brute(rows, length):
    """Places of each text that repeated strings cover."""
    seen = {}
    for k, t in enumerate(rows):
        for a in range(len(t) - length + 1):
            seen.setdefault(t[a : a + length], []).append((k, a))
    out = [set() for _ in rows]
    for at in seen.values():
        for k, a in at if len(at) > 1 else ():
            out[k].update(range(a, a + length))
    return out


def test_parts_find_what_repeats_and_no_more(spark):
    rng = random.Random(21)
    base = noise(rng, 200)
    rows = []
    for _ in range(24):  # near copies with unlike ends
        at = rng.randrange(200)
        rows.append(noise(rng, 60) + base[:at] + rng.choice("xyz") + base[at + 1 :] + noise(rng, 60))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = suffix.covers(df, 100, 32, 8).collect()
    got = [set() for _ in rows]
    at = {suffix.row_key(k, t.encode()): k for k, t in enumerate(rows)}
    for r in found:
        got[at[r["row"]]].update(range(r["a"], r["b"]))
    assert got == brute(rows, 100)
    assert len(found) < 2_000  # 5,798 when each part sent on what it had found itself


def near_copies(rng, n, size=200):
    base = noise(rng, size)
    out = []
    for _ in range(n):
        at = rng.randrange(size)
        out.append(noise(rng, 60) + base[:at] + rng.choice("xyz") + base[at + 1 :] + noise(rng, 60))
    return out


def test_parts_send_a_string_once_for_each_place(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(common, "stored", lambda df, f=common.stored: kept.append(f(df)) or kept[-1])

    def sent(n):
        kept.clear()
        rows = near_copies(random.Random(22), n)
        got = [set() for _ in rows]
        at = {suffix.row_key(k, t.encode()): k for k, t in enumerate(rows)}
        for r in suffix.covers(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), 100, 32, 8).collect():
            got[at[r["row"]]].update(range(r["a"], r["b"]))
        assert got == brute(rows, 100)
        strings = next(x for x in kept if "string" in x.columns)
        return strings.count(), strings.select("row", "a").distinct().count()

    few, places = sent(24)
    assert few == places  # once for each sample in the string before
    assert sent(48)[0] < 3 * few  # not with the square of the group
    monkeypatch.setattr(suffix, "STRETCH", 4)
    assert sent(24)[1] == places


def test_only_copies_are_stored_for_distinct_texts(spark, monkeypatch):
    rows = [f"text {k}" for k in range(300)] + ["twice"] * 2 + ["often"] * 40 + ["", None]
    kept = []
    monkeypatch.setattr(common, "stored", lambda df, f=common.stored: kept.append(f(df)) or kept[-1])
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = sorted(r["text"] for r in pii.distinct_texts(docs).collect())
    assert got == sorted({t or "" for t in rows})
    stored = [r["text"] for x in kept if "text" in x.columns for r in x.collect()]
    assert {"twice", "often", ""} <= set(stored) and len(stored) < 100


def test_disclosive_stores_no_table_of_all_texts(spark, monkeypatch):
    rows = [f"text {k} inbox u{k}@mail.org here" for k in range(200)]
    kept = []
    monkeypatch.setattr(common, "stored", lambda df, f=common.stored: kept.append(f(df)) or kept[-1])
    sizes = lambda: sum(x.count() for x in kept if "text" in x.columns)
    monkeypatch.setattr(common, "drop_stored", lambda *_: None)
    pii.disclosive(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert sizes() < 100
