"""Best-fit packing: the reduction loses no optimum, best fit equals the plain loop, and every id lies in one place."""

import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from risklane.llm import binpacking as B

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = "doc_id bigint, text string, `LENGTH` int, sequence_id string"


def fewest(sizes, room):
    """The least number of sequences, by trying everything."""
    @lru_cache(None)
    def left(items):
        if not items:
            return 0
        first, rest = items[0], items[1:]

        def fill(at, free, keep):
            best = 1 + left(keep + rest[at:])
            for i in range(at, len(rest)):
                if rest[i] <= free and (i == at or rest[i] != rest[i - 1]):
                    best = min(best, fill(i + 1, free - rest[i], keep + rest[at:i]))
            return best

        return fill(0, room - first, ())

    return left(tuple(sorted(sizes, reverse=True)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=11), st.integers(24, 40))
def test_the_reduction_loses_no_optimum(sizes, room):
    stock = B.Stock(Counter(sizes), room)
    groups = B.reduce(stock)
    used = Counter()
    for group in groups:
        assert sum(length * copies for length, copies in group.pieces) <= room
        for length, copies in group.pieces:
            used[length] += copies * group.count
    rest = [length for length in range(room + 1) for _ in range(int(stock.counts[length]))]
    assert used + Counter(rest) == Counter(sizes)
    assert sum(group.count for group in groups) + fewest(rest, room) == fewest(sizes, room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_equals_the_plain_loop(sizes):
    rooms = []
    for length in sorted(sizes, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(30 - length)
    groups = B.best_fit(B.Stock(Counter(sizes), 30))
    got = [30 - sum(n * k for n, k in group.pieces) for group in groups for _ in range(group.count)]
    assert sorted(got) == sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_every_rank_has_one_place(counts):
    rows = B.plan(counts, 64)
    taken = defaultdict(set)
    for length, count in counts.items():
        mine = rows[rows.length == length]
        for rank in range(count):
            row = mine.iloc[np.searchsorted(mine["first"].to_numpy(), rank, side="right") - 1]
            past = rank - row["first"]
            at = row["offset"] + past % row["copies"] * length
            spots = set(range(at, at + length))
            sequence = row["sequence"] + past // row["copies"]
            assert not spots & taken[sequence]
            taken[sequence] |= spots
    assert all(spots == set(range(len(spots))) and len(spots) <= 64 for spots in taken.values())


def texts():
    rng = random.Random(8)
    words = [f"w{rng.randrange(900)}" for _ in range(3000)] + ["Über", "naïve", "don't", "x y", "a\x1cb", "日本語", "<|endoftext|>", "😀", "İstanbul"]
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, "null id"), (5, "same"), (5, "same"), (6, " ".join(rng.choices(words, k=6000)))]
    return rows + [(i, rng.choice(["", " "]) + " ".join(rng.choices(words, k=rng.choice([3, 40, 500, 1500])))) for i in range(10, 130)]


@pytest.mark.parametrize("parts, batch", [(1, B.BATCH), (13, 3000)])
def test_pack_against_the_tokenizer(spark, monkeypatch, parts, batch):
    monkeypatch.setattr(B, "BATCH", batch)
    rows = texts()
    docs = spark.createDataFrame([(*row, 1, "clash") for row in rows], SCHEMA).repartition(parts)
    got = B.pack(docs, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    expected = []
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], np.uint32)
        for piece, start in enumerate(range(0, len(ids), 4096)):
            cut = ids[start:start + 4096]
            expected.append((doc_id, piece, start, len(cut), zlib.crc32(cut.tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(expected, key=str)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 4096
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 4096) + 2


def test_hot_lengths_are_ranked_in_slices(spark):
    docs = spark.createDataFrame([(i, "same words here", 1, "c") for i in range(40)], SCHEMA)
    got = B.pack(docs, PATH, room=12, limit=5).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 40 and len({r.sequence_id for r in got}) == 14


def test_empty_table(spark):
    assert B.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []
