"""Document fingerprints from improbable features.

Every byte window of a text carries self-information under the byte pairs of the whole corpus; the
windows that carry more than any other within a radius are the text's features. Windows are
long; texts of under SHORT bytes have features from short windows as well, as few long ones outlast an edit there. Their
hashes go into a chain of Bloom filters, FEATURES to each. Two chains are compared filter by
filter: shared bits, less those that chance gives, over the most that could be shared.

A fingerprint depends on the text and the corpus table only, so equal texts have equal ones. Null
counts as empty; an empty text has no filter, is like another empty one (1) and unlike all others
(0). Texts shorter than a window are one feature. Null ids come last; rows with equal doc_id are ordered by text; a
table of one row has itself as the next document; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .rolling import mixed, windows_at

WIDTH, RADIUS = 64, 16
#: Bytes below which a text has features from windows of another width and radius too.
SHORT, SHORT_WIDTH, SHORT_RADIUS = 1_024, 16, 4
#: Bytes of a filter, its features, and the bits that each sets.
FILTER, FEATURES, HASHES = 256, 128, 5


def pair_table(docs: DataFrame) -> np.ndarray:
    """Bits that each byte gives after each byte, in 64ths, from the pair counts of all texts (65,536 at most reach the driver)."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(65536, np.int64)
        for f in frames:
            for t in f["text"]:
                b = np.frombuffer(t.encode(), np.uint8).astype(np.int32)
                if len(b) > 1:
                    total += np.bincount(b[:-1] * 256 + b[1:], minlength=65536)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"pair": at.astype(np.int32), "n": total[at]})

    table = np.zeros((256, 256))
    for r in common.texts(docs).mapInPandas(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        table[divmod(r["pair"], 256)] = r["n"]
    share = (table + 1) / (table.sum(axis=1, keepdims=True) + 256)
    return np.rint(-64 * np.log2(share)).astype(np.int64).ravel()


def reach_max(x: np.ndarray, n: int) -> np.ndarray:
    """Largest of each n values in a row; len(x) - n + 1 results."""
    width = 1
    while 2 * width <= n:
        x, width = np.maximum(x[:-width], x[width:]), 2 * width
    return np.maximum(x[: len(x) - (n - width)], x[n - width :])


def selected(b: np.ndarray, info: np.ndarray, width: int, radius: int) -> np.ndarray:
    """Hashes of the windows that carry more than any other within the radius; of the whole text if it is no longer than a window."""
    if len(b) <= width:
        return mixed(windows_at(b, np.zeros(1, np.int64), len(b)))
    rank = info[width - 1 :] - info[: len(info) - width + 1]  # of the window that starts at each place
    low = np.full(radius, -1)
    around = reach_max(np.concatenate([low, rank, low]), radius)  # of radius ranks, the first of them radius before
    n = len(rank)
    at = np.flatnonzero((rank > around[:n]) & (rank >= around[radius + 1 : radius + 1 + n]))
    return mixed(windows_at(b, at, width))


def features(data: bytes, bits: np.ndarray) -> np.ndarray:
    """Hashes of the selected windows, in order, each once."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    info = np.concatenate([[0], np.cumsum(bits[b[:-1].astype(np.int32) * 256 + b[1:]])])
    h = selected(b, info, WIDTH, RADIUS)
    if len(b) < SHORT:
        h = np.concatenate([h, selected(b, info, SHORT_WIDTH, SHORT_RADIUS)])
    return h[np.sort(np.unique(h, return_index=True)[1])]


def chain(h: np.ndarray) -> np.ndarray:
    """The filters of the hashes, one a row."""
    n = -(-len(h) // FEATURES)
    out = np.zeros((n, FILTER * 8), np.uint8)
    for k in range(HASHES):
        out[np.arange(len(h)) // FEATURES, (h >> np.uint64(11 * k) & np.uint64(FILTER * 8 - 1)).astype(np.int64)] = 1
    return np.packbits(out, axis=1)


def fingerprint(text: str, bits: np.ndarray) -> np.ndarray:
    return chain(features(text.encode(), bits))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1: mean over the shorter chain's filters of the best normalised overlap."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    one, two = (np.bitwise_count(x).sum(axis=1, dtype=np.int64).astype(float) for x in (a, b))
    best = np.empty(len(a))
    for k, x in enumerate(a):  # a filter against all of the other chain, so memory grows with one chain only
        shared = np.bitwise_count(x & b).sum(axis=1, dtype=np.int64)
        chance, most = one[k] * two / (FILTER * 8), np.minimum(one[k], two)
        best[k] = np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1).max()
    return float(np.average(best, weights=one))


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def written(a: np.ndarray) -> str:
    return base64.b64encode(a.tobytes()).decode()


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [x.split()[0] for x in RESULT.split(", ")]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every text."""
    common.small_batches(docs.sparkSession)
    bits = pair_table(docs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "fingerprint": [written(fingerprint(t, bits)) for t in f["text"]]})

    return common.own_ids(common.texts(docs).mapInPandas(run, "doc_id long, fingerprint string"))


def with_edits(docs: DataFrame) -> DataFrame:
    """RESULT rows: every text against its edit and the next document by falling doc_id.

    Texts are sorted by range once. A partition's last row needs the first of the next one; these
    rows, two for each partition, are matched afterwards.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    bits = pair_table(docs)

    def row(doc_id, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
        new = edited(text, following)
        print_ = fingerprint(new, bits)
        return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), written(own), written(print_), likeness(own, print_), likeness(own, other)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last = TaskContext.get().partitionId(), None
        columns = ["what", "part", "text", *NAMES]
        end = lambda what, d, t: (what, part, t, d, 0, "", "", "", 0.0, 0.0)
        for f in frames:
            rows = []
            for d, t in zip(f["doc_id"], f["text"], strict=True):
                own = fingerprint(t, bits)
                if last is None:
                    rows.append(end("first", d, t))
                else:
                    rows.append(("row", part, "", *row(*last, t, own)))
                last = d, t, own
            if rows:
                yield pd.DataFrame(rows, columns=columns)
        if last:
            yield pd.DataFrame([end("last", *last[:2])], columns=columns)

    ordered = common.texts(docs).repartitionByRange(common.partitions(spark), F.desc_nulls_last("doc_id")).sortWithinPartitions(F.desc_nulls_last("doc_id"), "text")
    out = common.stored(ordered.mapInPandas(run, f"what string, part int, text string, {RESULT}"))
    first = out.filter("what = 'first'")
    parts = first.select("part")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(whole)).alias("next"))
    ends = out.filter("what = 'last'").select("part", "doc_id", "text").join(after, "part").join(first.select(F.col("part").alias("next"), F.col("text").alias("following")), "next")

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([row(d, t, fingerprint(t, bits), n, fingerprint(n, bits)) for d, t, n in zip(f["doc_id"], f["text"], f["following"], strict=True)], columns=NAMES)

    return common.own_ids(out.filter("what = 'row'").select(*NAMES).unionByName(ends.select("doc_id", "text", "following").mapInPandas(match, RESULT)))


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Query: all documents, their edits and their neighbours."""
    return with_edits(common.table(spark, sf_dir, "documents"))
