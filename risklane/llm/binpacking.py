"""Packing whole documents into as few sequences as possible: Martello-Toth reduction, then best fit.

A document is never cut unless it is longer than a sequence; so this is bin packing of integer lengths, and how many pieces there are
of each length decides everything. Those counts (at most ``LENGTH`` numbers, however many documents) are the instance that
is solved; which piece takes which place follows from its rank among the pieces of its length.

1. Every document is encoded and cut by Spark; pieces are counted by length.
2. Reduction (Martello and Toth): for a length, a set of pieces that dominates every other way of filling its sequence is fixed for
   good, for as many sequences as the counts allow. This goes on until no length gives one, so it loses nothing.
3. What is left goes, longest first, into the fullest sequence that has room (best fit decreasing). Sequences that hold
   the same lengths are kept as one with a count, so the work grows with the number of lengths and not of pieces.
4. The plan, rows of (length, first rank, sequences, ...), is bounded like the instance. It is broadcast, and every piece looks its place up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from risklane.llm.common import stage
from risklane.llm.packing import GAPS, ODD_SPACE, Encoder
from risklane.operators.ordered import TASK_ROWS, running_sums

# Fixed values of the query: ids in a sequence, the id that ends a document.
LENGTH = 4096
END_ID = 1


class Stock:
    """How many pieces of each length are left, with fast answers about which lengths are present."""

    def __init__(self, counts: Mapping[int, int], room: int) -> None:
        self.room = room
        self.counts = np.zeros(room + 1, np.int64)
        for length, count in counts.items():
            self.counts[length] += count
        self._index()

    def _index(self) -> None:
        present = np.where(self.counts > 0, np.arange(self.room + 1), 0)
        self.present = np.flatnonzero(self.counts)
        # at_most[v]: the greatest length present that is at most v; 0 for none.
        self.at_most = np.maximum.accumulate(present)

    def take(self, pieces: Counter, times: int) -> None:
        for length, copies in pieces.items():
            self.counts[length] -= copies * times
        if any(not self.counts[length] for length in pieces):
            self._index()

    def times(self, pieces: Counter) -> int:
        return min(int(self.counts[length]) // copies for length, copies in pieces.items())

    def smallest(self, many: int, without: int) -> list[int]:
        """The ``many`` smallest pieces, one piece of length ``without`` aside; fewer if there are no more."""
        out: list[int] = []
        for length in self.present[:many + 1].tolist():
            out += [length] * min(many - len(out), int(self.counts[length]) - (length == without))
            if len(out) == many:
                break
        return out

    def largest_fit(self, room: int, without: int) -> int:
        """The largest piece of at most ``room``, one piece of length ``without`` aside; 0 for none."""
        if room <= 0:
            return 0
        found = int(self.at_most[min(room, self.room)])
        if found == without and self.counts[found] == 1:
            found = int(self.at_most[found - 1])
        return found

    def pairs(self, room: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """For each present length a, the largest b <= a with a + b <= room and both pieces there (0: none)."""
        counts = self.counts
        left = counts.copy()
        left[without] -= 1
        a = self.present[(self.present <= room) & (left[self.present] > 0)]
        most = np.minimum(a - (left[a] < 2), room - a)
        b = np.where(most > 0, self.at_most[np.maximum(most, 0)], 0)
        if counts[without] == 1:
            # The only piece of that length is in use.
            b = np.where(b == without, self.at_most[without - 1], b)
        return a, b


def dominating(stock: Stock, length: int) -> Counter | None:
    """A set with a piece of ``length`` that dominates every feasible set with one, or None if none is proven.

    One set dominates another if the other's further pieces can be dealt into groups that each fit into a piece of its own.
    """
    room = stock.room - length
    largest = stock.largest_fit(room, length)
    if not largest:
        return Counter([length])                    # nothing fits beside it
    small = stock.smallest(3, length)
    if largest == room or len(small) == 1 or small[0] + small[1] > room:
        # It fills the sequence, or at most one piece fits beside it: all others are shorter than the largest.
        return Counter([length, largest])
    if len(small) == 3 and sum(small) <= room:
        return None
    # At most two pieces fit beside it.
    a, b = stock.pairs(room, length)
    sums = np.where(b > 0, a + b, 0)
    if not len(a) or sums.max() <= largest:
        return Counter([length, largest])           # any two fit into the place of the largest one
    best = int(np.flatnonzero(a == largest)[0]) if (a == largest).any() else -1
    # With the largest piece, and beside it a piece as long as the shorter one of any pair.
    if best >= 0 and b[best] > 0 and b[best] >= b.max():
        return Counter([length, int(a[best]), int(b[best])])
    return None


class Group(NamedTuple):
    """``count`` sequences that hold the same pieces: (length, copies) in order."""

    pieces: tuple[tuple[int, int], ...]
    count: int


def reduce(stock: Stock) -> list[Group]:
    """Fix dominating sets until there are none; takes their pieces out of ``stock``."""
    fixed: list[Group] = []
    again = True
    while again:
        again = False
        for length in stock.present[::-1].tolist():
            while stock.counts[length]:
                pieces = dominating(stock, length)
                if pieces is None:
                    break
                times = stock.times(pieces)
                fixed.append(Group(tuple(sorted(pieces.items(), reverse=True)), times))
                stock.take(pieces, times)
                again = True
    return fixed


def best_fit(stock: Stock) -> list[Group]:
    """The pieces of ``stock``, longest first, each into the fullest sequence with room for it."""
    open_groups: dict[int, list[Group]] = defaultdict(list)
    rooms: list[int] = []

    def put(group: Group, room: int) -> None:
        if group.count:
            if not open_groups[room]:
                insort(rooms, room)
            open_groups[room].append(group)

    for length in stock.present[::-1].tolist():
        left = int(stock.counts[length])
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                group = open_groups[room].pop()
                if not open_groups[room]:
                    rooms.pop(at)
            else:
                room, group = stock.room, Group((), left)
            # A sequence is filled up before the next one of the same room is begun.
            copies = room // length
            full = min(group.count, left // copies)
            put(Group((*group.pieces, (length, copies)), full), room - copies * length)
            left -= full * copies
            used = full
            if used < group.count and left:
                put(Group((*group.pieces, (length, left)), 1), room - left * length)
                used, left = used + 1, 0
            if group.pieces:
                put(Group(group.pieces, group.count - used), room)
    return [group for groups in open_groups.values() for group in groups]


PLAN = ["length", "first", "copies", "sequence", "offset"]


def plan(counts: Mapping[int, int], room: int = LENGTH) -> pd.DataFrame:
    """Where pieces go: piece ``rank`` of a length belongs to its last row with first <= rank.

    It is in sequence + (rank - first) // copies, at offset + (rank - first) % copies * length.
    """
    stock = Stock(counts, room)
    groups = reduce(stock)
    groups += best_fit(stock)
    ranks: Counter = Counter()
    rows, sequence = [], 0
    for group in groups:
        offset = 0
        for length, copies in group.pieces:
            rows.append((length, ranks[length], copies, sequence, offset))
            ranks[length] += copies * group.count
            offset += copies * length
        sequence += group.count
    return pd.DataFrame(rows, columns=PLAN).sort_values(["length", "first"], ignore_index=True)


class BatchEncoder:
    """Ids of many texts at once: the distinct words of a batch are encoded, then dealt back to the texts."""

    def __init__(self, path: str, end: int) -> None:
        self.encoder, self.end = Encoder(path), np.array([end], np.uint32)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each with the end id; ids of each text)."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False)
        known = self.encoder.words
        if len(known) > 4 * len(words.dictionary) + 600_000:
            known.clear()
        found = list(map(self._word, words.dictionary.to_pylist()))
        found.append(self.end.tobytes())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        begins = np.cumsum(sizes) - sizes
        # The end id stands after the last word of each text.
        ends = split.offsets.to_numpy()[1:] - split.offsets.to_numpy()[0]
        codes = np.insert(codes, ends, len(found) - 1)
        lengths = sizes[codes]
        places = np.repeat(begins[codes] - (np.cumsum(lengths) - lengths), lengths)
        places += np.arange(len(places))
        stops = np.cumsum(lengths)[ends + np.arange(len(ends))]
        return flat[places], np.diff(stops, prepend=0)

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        if ODD_SPACE.search(word) or word.split() != [word]:
            parts = GAPS.findall(word) if ODD_SPACE.search(word) else word.split()
            return b"".join(map(self.encoder.words.__getitem__, parts))
        return self.encoder.words[word]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
# Texts encoded at once, in bytes; a longer one is encoded alone.
BATCH = 8_000_000


def pieces_of(df: DataFrame, tokenizer_path: str, id_col: str, text_col: str, room: int, end: int) -> DataFrame:
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(ids: pa.Array, texts: pa.Array, encoder: BatchEncoder) -> pa.RecordBatch:
        flat, sizes = encoder.ids(texts)
        counts = -(-sizes // room)
        row = np.repeat(np.arange(len(sizes)), counts)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = piece * room
        length = np.minimum(sizes[row] - start, room)
        begin = (np.cumsum(sizes) - sizes)[row] + start
        data = memoryview(flat).cast("B")
        check = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
             pa.array(check, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BatchEncoder(tokenizer_path, end)
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            first = 0
            while first < len(sizes):
                done = sizes[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(sizes, done + BATCH, side="right")))
                yield cut(batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), encoder)
                first = last

    return rows.mapInArrow(run, PIECES)


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", room: int = LENGTH,
         end: int = END_ID, limit: int = TASK_ROWS) -> DataFrame:
    """One row for each piece of each row of ``df``: its place in a sequence of at most ``room`` ids.

    A null or empty text is one piece of one id, ``end``. Rows that repeat are documents of their own. Pieces of a length are
    ranked by (doc_id, piece, checksum), null ids first, so reruns agree up to the exchange of equal pieces. An empty table gives
    an empty result; other columns of ``df`` are ignored. Lengths of more than ``limit`` pieces are ranked in slices.
    """
    pieces = stage(pieces_of(df, tokenizer_path, id_col, text_col, room, end), "pieces")
    # At most ``room`` rows, whatever the size of the table.
    counts = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = plan(counts, room)
    # Ranks of one length are consecutive numbers, so (length, rank) is one sorted number.
    wide = max(counts.values(), default=0) + 1
    shipped = df.sparkSession.sparkContext.broadcast({name: places[name].to_numpy(np.int64) for name in PLAN})
    ranked = running_sums(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], {"rank": F.lit(1).cast("bigint")}, limit)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shipped.value
        keys = rows["length"] * wide + rows["first"]
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("length", "rank"))
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            past = rank - rows["first"][at]
            sequence = rows["sequence"][at] + past // rows["copies"][at]
            offset = rows["offset"][at] + past % rows["copies"][at] * length
            kept = [batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], OUT_NAMES)

    return ranked.mapInArrow(place, OUT)


OUT_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
OUT = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
