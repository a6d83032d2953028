"""Best-fit packing of token sequences, improved by swap-based local search.

Every piece has a length from 1 to the capacity, so the histogram of lengths, at most as many
counts as the capacity, says all that packing needs. The driver plans on it: bins of the same
content are one pattern with a count. Best fit by falling length makes the first plan; local
search then moves one document, swaps one for one, or two for one, between underfull bins as long
as the sum of squared fills grows, which drains the emptiest bins until they vanish. Pieces get
their place by their rank among those of equal length; ranks come from a range partitioning, so
a length that a third of all pieces have is spread over many tasks.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from . import bpe, common

CAPACITY = 1024
END_ID = 2
#: The text of the one special token of the json vocabulary, and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_ids(text: str, path: str = bpe.RANKS) -> list[int]:
    """The ids that the json tokenizer gives without adding special tokens; one named in the text is one id."""
    if SPECIAL not in text:
        return bpe.ids_of(text, path)
    out: list[int] = []
    for k, part in enumerate(text.split(SPECIAL)):
        out += [SPECIAL_ID] * (k > 0) + bpe.ids_of(part, path)
    return out


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first may be shorter, the others are full."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenised(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """PIECE rows of every document, null ids as common.NO_ID; null text counts as empty and has the end id only."""
    common.small_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, t in zip(f["doc_id"], f["text"], strict=True):
                ids = np.array([*token_ids(t), END_ID], "<u4")
                rows += [(d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            yield bpe._frame(rows, PIECE)

    return common.texts(docs).mapInPandas(run, PIECE)


# A plan is a list of [lengths in falling order, number of such bins].


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[list]:
    """Best fit by falling length of counts[length] pieces; equal bins are treated at once."""
    room: dict[int, list[list]] = defaultdict(list)  # by free space
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            fits = [r for r, bins in room.items() if r >= n and bins]
            r = min(fits) if fits else capacity
            content, k = room[r].pop() if fits else ([], -(-left // (capacity // n)))
            each = min(r // n, left)  # pieces that one bin takes
            full = min(k, left // each)
            room[r - each * n].append([content + [n] * each, full])
            left -= each * full
            if fits and k > full:
                room[r].append([content, k - full])
            elif k > full and left:  # a last new bin with what is left
                room[capacity - left * n].append([[n] * left, 1])
                left = 0
    return [x for bins in room.values() for x in bins]


class Bins:
    """Patterns (lengths in falling order) of a plan with their numbers; underfull ones are found by slack, and by a length and slack."""

    def __init__(self, plan: list[list], capacity: int):
        self.capacity = capacity
        self.number: Counter = Counter()
        #: Patterns by (length, slack); length 0 stands for any. A mask has a bit for each slack of a length.
        self.found: dict[tuple[int, int], set] = defaultdict(set)
        self.mask: dict[int, int] = defaultdict(int)
        self.emptiest: list[tuple[int, tuple]] = []
        for content, k in plan:
            self.add(tuple(sorted(content, reverse=True)), k)

    def add(self, c: tuple, k: int) -> None:
        self.number[c] += k
        if c and self.number[c] == k and (slack := self.capacity - sum(c)):
            heapq.heappush(self.emptiest, (sum(c), c))
            for n in {0, *c}:
                self.found[n, slack].add(c)
                self.mask[n] |= 1 << slack

    def take(self, c: tuple, k: int) -> None:
        self.number[c] -= k
        if not self.number[c]:
            del self.number[c]
            slack = self.capacity - sum(c)
            for n in {0, *c} if slack else ():
                self.found[n, slack].discard(c)
                if not self.found[n, slack]:
                    self.mask[n] &= ~(1 << slack)

    def target(self, source: tuple, n: int, gain: int) -> tuple | None:
        """The fullest pattern with the length n that has room for gain and ends fuller than the source is, the source itself if there are two."""
        most = self.capacity - sum(source) + gain  # its slack is less
        bits = self.mask[n] >> gain
        while bits:
            slack = gain + (bits & -bits).bit_length() - 1
            if slack >= most:
                return None
            for c in self.found[n, slack]:
                if c != source or self.number[c] > 1 and (n == 0 or c.count(n) > 0):
                    return c
            bits &= bits - 1
        return None


def without(c: tuple, gone: tuple) -> list[int]:
    rest = list(c)
    for n in gone:
        rest.remove(n)
    return rest


def exchange(bins: Bins, source: tuple) -> tuple | None:
    """(target, what leaves source, what comes back) that lets squared fill grow: a move, or a swap of one or two for one, the most at once."""
    outs = [((a,), a) for a in sorted(set(source), reverse=True)]
    outs += sorted({((a, b), a + b) for i, a in enumerate(source) for b in source[i + 1 :]}, key=lambda x: -x[1])
    widest = bins.mask[0].bit_length() - 1
    for out, size in outs:
        if target := bins.target(source, 0, size):
            return target, out, ()
        for back in range(max(1, size - widest), size):
            if bins.mask[back] and (target := bins.target(source, back, size - back)):
                return target, out, (back,)
    return None


def improve(plan: list[list], capacity: int = CAPACITY) -> list[list]:
    """Local search: pieces wander from emptier to fuller bins while squared fill grows, until no exchange is left or no fewer bins can do."""
    bins = Bins(plan, capacity)
    least = -(-sum(sum(c) * k for c, k in bins.number.items()) // capacity)
    total, stuck, moved = sum(bins.number.values()), [], True
    while total > least and (bins.emptiest or moved):
        if not bins.emptiest:  # those that found no partner before the last moves are tried again
            bins.emptiest, stuck, moved = sorted(x for x in set(stuck) if x[1] in bins.number), [], False
            continue
        entry = heapq.heappop(bins.emptiest)
        source = entry[1]
        if source not in bins.number:
            continue
        if not (found := exchange(bins, source)):
            stuck.append(entry)
            continue
        target, out, back = found
        k = bins.number[source] // 2 if source == target else min(bins.number[source], bins.number[target])
        bins.take(source, k)
        bins.take(target, k)
        if less := without(source, out) + list(back):
            bins.add(tuple(sorted(less, reverse=True)), k)
        else:
            total -= k
        bins.add(tuple(sorted(without(target, back) + list(out), reverse=True)), k)
        if source in bins.number:
            heapq.heappush(bins.emptiest, entry)
        moved = True
    return [[list(c), k] for c, k in bins.number.items()]


def slots(plan: list[list]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks, first sequence ids and offsets; a rank's slot is the last one not after it."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: Counter = Counter()
    base = 0
    for content, k in plan:
        at = 0
        for n in content:
            out[n].append((used[n], base, at))
            used[n] += k
            at += n
        base += k
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in out.items()}


def with_longs(df: DataFrame, *names: str) -> StructType:
    return StructType([*df.schema, *(StructField(n, LongType()) for n in names)])


def pack(pieces: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to rows with a length from 1 to the capacity.

    The driver gets at most capacity counts, and a count for each partition and length in it, of
    which there are at most capacity + partitions. The plan's patterns depend on the lengths, not
    on the number of rows.
    """
    spark = pieces.sparkSession
    ranged = pieces.repartitionByRange(common.partitions(spark), "length", *keys).sortWithinPartitions("length", *keys)

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        part = TaskContext.get().partitionId()
        for f in frames:
            rank = f.groupby("length").cumcount() + f["length"].map(lambda n: seen[n])
            seen.update(f["length"].tolist())
            yield f.assign(part=part, rank=rank.astype("int64"))

    schema = with_longs(pieces, "part", "rank")
    ranked = common.stored(ranged.mapInPandas(local, schema))
    found = ranked.groupBy("part", "length").count().collect()
    counts: Counter = Counter()
    before: dict[tuple[int, int], int] = {}
    for r in sorted(found, key=lambda r: (r["length"], r["part"])):
        before[r["part"], r["length"]] = counts[r["length"]]
        counts[r["length"]] += r["count"]
    places = slots(improve(best_fit(dict(counts), capacity), capacity))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for (part, n), g in f.groupby(["part", "length"], sort=False):
                rank = g["rank"].to_numpy() + before[part, n]
                first, base, at = places[n]
                k = np.searchsorted(first, rank, "right") - 1
                out.append(g.assign(sequence_id=base[k] + rank - first[k], offset=at[k]))
            if out:
                yield pd.concat(out).drop(columns=["part", "rank"])

    return ranked.mapInPandas(place, with_longs(pieces, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises and packs documents; see tokenised() and pack(). Repeated rows and null ids are packed as well; an empty table gives no rows."""
    return common.own_ids(pack(common.stored(tokenised(docs, capacity)), capacity))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """Query: all documents in sequences of at most 1024 tokens."""
    return pack_documents(common.table(spark, sf_dir, "documents"))
