"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into chunks that overlap. Every chunk is pre-tokenised on its own, from
wherever it starts; the pattern has no look-behind, so once two tokenisations share a boundary
they agree from there on. A boundary that chunk k and chunk k + 1 share inside their overlap is
therefore a true one, and the text can be cut there. Between such cuts lie the pieces, which are
encoded independently. Where an overlap holds no shared boundary (a pre-token longer than the
overlap), the rest of the text stays one piece. Decoding concatenates the bytes of the ids.

Texts of more than DEALT code points send their chunks and pieces to many tasks, shorter ones are
chunked, stitched and encoded where they are read. A long run of white space is a pre-token of its
own but for its last character (the pattern's engine would run out of stack on it).

Null text counts as empty; an empty text has no ids. Every row gives a row, also where doc_ids or
whole rows repeat or ids are null: pieces find together by id and text, and copies are counted.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Code points of a chunk, of its overlap with the next one, and of a text that one task still encodes.
CHUNK, OVERLAP, DEALT = 4_096, 256, 32_768
#: Code points before a chunk's end in which a boundary could still move.
MARGIN = 8


@functools.cache
def encoding(path: str = RANKS):
    """The tiktoken encoding of a rank file, one for each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _pattern():
    return regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


#: A run of white space that is taken out of the text before the pattern is used.
_RUN = regex.compile(r"\p{White_Space}{4096,}")


def ids_of(text: str, path: str = RANKS) -> list[int]:
    """The ids of a text's pre-tokens, as the encoding gives them."""
    own, out, at = encoding(path), [], 0
    for m in _RUN.finditer(text) if len(text) >= 4096 else ():
        stop = m.end() if m.end() == len(text) else m.end() - 1  # the last character goes with what follows
        out += own.encode_ordinary(text[at : m.start()])
        out += own._encode_single_piece(text[m.start() : stop])
        at = stop
    return out + own.encode_ordinary(text[at:])


def stitched_ids(text: str, path: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of a text by overlapping chunks."""
    n = -(-(len(text) - overlap) // chunk)
    if n < 2:
        return ids_of(text, path)
    chunks = [text[k * chunk : (k + 1) * chunk + overlap] if k < n - 1 else text[k * chunk :] for k in range(n)]
    parts = stitch(chunks, chunk, [boundaries(c, k == n - 1) for k, c in enumerate(chunks)])
    return [i for p in parts for i in ids_of(p, path)]


def boundaries(text: str, last: bool) -> list[int]:
    """Ends of the pre-tokens after which a text may be cut: not in or after white space, and, unless the chunk is the last, not near its end."""
    most = len(text) if last else len(text) - MARGIN
    return [e for m in _pattern().finditer(text) if (e := m.end()) <= most and not text[e - 1].isspace()]


def stitch(chunks: list[str], size: int, marks: list[list[int]]) -> list[str]:
    """Pieces of the text that the overlapping chunks (each size long without its overlap) make up.

    marks: boundaries() of each chunk. The pieces start and end at pre-token boundaries.
    """
    cuts = [0]
    for k in range(len(chunks) - 1):
        own = {e + k * size for e in marks[k] if e >= size}
        shared = [e for e in (m + (k + 1) * size for m in marks[k + 1] if m < len(chunks[k]) - size) if e in own]
        if not shared:
            break  # what follows isn't known to be in step: it stays one piece
        cuts.append(shared[0])
    text = "".join(c[:size] for c in chunks[:-1]) + chunks[-1]
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def _digest(doc_id: int, ids: np.ndarray, path: str) -> tuple:
    raw = encoding(path).decode_bytes(ids.tolist())
    return int(doc_id), len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])


def pieces(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, key, copies, piece, text) of the texts in docs: chunks are pre-tokenised in parallel, then stitched.

    Texts of one doc_id are told apart by key, a hash; rows that are equal are stitched once and counted.
    """
    n = F.length("text")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - overlap) / chunk).cast("int") - 1)))
    chunks = docs.select("doc_id", F.xxhash64("text").alias("key"), "text", n.alias("n"), at.alias("k"))
    last = F.col("k") == F.greatest(F.lit(0), F.ceil((F.col("n") - overlap) / chunk).cast("int") - 1)
    chunks = chunks.select("doc_id", "key", "k", last.alias("last"), F.substring("text", F.col("k") * chunk + 1, F.when(last, F.col("n")).otherwise(chunk + overlap)).alias("text"))
    chunks = chunks.repartition(common.partitions(docs.sparkSession), "doc_id", "k")

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ends = [[e for e in boundaries(t, z) if e < overlap or e >= chunk] for t, z in zip(f["text"], f["last"], strict=True)]
            yield f.assign(marks=ends)

    def join(f: pd.DataFrame) -> pd.DataFrame:
        copies = int((f["k"] == 0).sum())
        f = f.sort_values("k").drop_duplicates("k")
        out = stitch(list(f["text"]), chunk, [list(x) for x in f["marks"]])
        return pd.DataFrame({"doc_id": f["doc_id"].iloc[0], "key": f["key"].iloc[0], "copies": copies, "piece": range(len(out)), "text": out})

    marked = chunks.mapInPandas(mark, "doc_id long, key long, k int, last boolean, text string, marks array<int>")
    return marked.groupBy("doc_id", "key").applyInPandas(join, "doc_id long, key long, copies int, piece int, text string")


def encode(docs: DataFrame, path: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP, dealt: int = DEALT) -> DataFrame:
    """(doc_id, ids array<int>) of every text."""
    return _encoded(docs, path, chunk, overlap, dealt, "doc_id long, ids array<int>", lambda d, ids: (int(d), ids.astype(np.int32)))


def digests(docs: DataFrame, path: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP, dealt: int = DEALT) -> DataFrame:
    """Number and SHA-256 of each text's ids, and SHA-256 of what they decode to."""
    return _encoded(docs, path, chunk, overlap, dealt, DIGEST, lambda d, ids: _digest(d, ids, path))


def _encoded(docs: DataFrame, path: str, chunk: int, overlap: int, dealt: int, schema: str, result) -> DataFrame:
    common.small_batches(docs.sparkSession)
    docs = common.texts(docs)
    dealt = max(dealt, chunk + overlap)

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield _frame([result(d, np.array(stitched_ids(t, path, chunk, overlap), np.uint32)) for d, t in zip(f["doc_id"], f["text"], strict=True)], schema)

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "key": f["key"], "copies": f["copies"], "piece": f["piece"], "ids": [np.array(ids_of(t, path), "<u4").tobytes() for t in f["text"]]})

    def concat(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("piece")
        return _frame([result(f["doc_id"].iloc[0], np.frombuffer(b"".join(f["ids"]), "<u4"))] * int(f["copies"].iloc[0]), schema)

    long = pieces(docs.filter(F.length("text") > dealt), chunk, overlap)
    long = long.repartition(common.partitions(docs.sparkSession), "doc_id", "piece").mapInPandas(part, "doc_id long, key long, copies int, piece int, ids binary")
    return common.own_ids(docs.filter(F.length("text") <= dealt).mapInPandas(whole, schema).unionByName(long.groupBy("doc_id", "key").applyInPandas(concat, schema)))


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, data binary): the bytes of each row's ids, concatenated."""

    def back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoding(path)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "data": [own.decode_bytes([int(i) for i in ids]) for ids in f["ids"]]})

    ids = encoded.select(F.coalesce("doc_id", F.lit(common.NO_ID)).alias("doc_id"), "ids")
    return common.own_ids(ids.mapInPandas(back, "doc_id long, data binary"))


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Query: digests of the ids and decoded bytes of all documents."""
    return digests(common.table(spark, sf_dir, "documents"))
