"""Periodic runs against a search of all periods, and the query against plain Python."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from risklane.llm import periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, runs string, `TEXT_` int"


def brute(words, least=24):
    """All longest stretches of every period, without those that a smaller period explains."""
    n, found = len(words), set()
    for period in range(1, n // 3 + 1):
        start = 0
        while start + period < n:
            stop = start
            while stop + period < n and words[stop] == words[stop + period]:
                stop += 1
            if stop > start and stop + period - start >= max(least, 3 * period):
                stretch = words[start:stop + period]
                if all(stretch[d:] != stretch[:-d] for d in range(1, period)):
                    found.add((start, len(stretch), period))
            start = stop + 1
    return sorted(found, key=lambda run: (run[0], run[2]))


def runs_of(texts, least):
    before, periods.LEAST_WORDS = periods.LEAST_WORDS, least
    try:
        return periods.runs_of([[str(word).encode() for word in words] for words in texts])
    finally:
        periods.LEAST_WORDS = before


pieces = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=30), st.integers(1, 6))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(pieces, max_size=6), min_size=1, max_size=4), st.sampled_from([1, 24]))
def test_all_runs_are_found(texts, least):
    flat = [[word for block, times in text for word in block * times] for text in texts]
    assert runs_of(flat, least) == [brute(words, least) for words in flat]


@pytest.mark.parametrize("period", [5, 37, 160, 611])
def test_runs_of_long_periods(period):
    rng = random.Random(period)
    for alphabet in (2, 1000):
        # A block that is itself mostly a run of period 3, and a random one.
        for block in ([rng.randrange(alphabet) for _ in range(period)], ([7, 8, 9] * period)[:period - 1] + [1]):
            words = [rng.randrange(alphabet) for _ in range(50)] + block * 3 + block[:period // 2] + [-1] * 5
            assert runs_of([words], 24) == [brute(words)]


def plant(doc_id, words):
    check = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), check // 10
    if check % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected(doc_id, text):
    words = plant(doc_id, WORD.findall(text or ""))
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digest)


def documents():
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "x " * 30), (5, "a b " * 200), (5, "a b " * 200), (6, "é ü z " * 9), (7, "w " * 23),
            (8, "w " * 24), (-4, "one two three four five six seven eight " * 3)]
    for i in range(100, 180):
        block = [f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 30))]
        rows.append((i, " ".join([f"u{rng.randrange(9)}" for _ in range(rng.randint(0, 40))] + block * rng.randint(0, 5) + block[:rng.randint(0, 5)])))
    return rows


@pytest.mark.parametrize("line", [400_000, 50])
def test_query_against_brute_force(spark, monkeypatch, line):
    monkeypatch.setattr(periods, "LINE", line)
    rows = documents()
    docs = spark.createDataFrame([(*row, "clash", 1) for row in rows], SCHEMA).repartition(3)
    got = periods.digests(periods.find(docs, periods.planted(docs)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(*row) for row in rows), key=str)
    assert any(zlib.crc32(str(row[0]).encode()) % 10 == 0 for row in rows)


def test_empty_table_and_a_very_long_text(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert periods.digests(periods.find(docs, F.col("text"))).collect() == []
    block = " ".join(f"v{i}" for i in range(70_000))
    long = spark.createDataFrame([(1, " ".join([block] * 4), None, None)], SCHEMA)
    row = periods.find(long, F.col("text")).first()
    assert [tuple(run) for run in row["runs"]] == [(0, 280_000, 70_000)]
    assert row["collapsed"] == block
