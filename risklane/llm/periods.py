"""Periodic runs of words, by string synchronising sets (after Kempa and Kociumaka).

A run is a longest stretch of words that repeats a block of q words, q the smallest such period, at least ``TIMES`` times over. Periods
up to ``DIRECT`` are found by comparing the text with itself shifted. For larger ones, at every dyadic scale t = 2, 4, 8, ..., a position is
chosen where the hash of the next t words is the least among the windows that start in the t + 1 positions from here, and
stands at either end of them. Whether a position is chosen depends on its next 2t words only, so inside a run the choice
repeats with the period. Two chosen positions, next to each other among those with equal context, propose their
distance as a period:

- contexts of 4t words serve the periods from 2.5t to 4t, contexts of 5t words those from 10/3 t to 5t. A context is at least as
  long as the period, so within a run equal contexts are whole periods apart and neighbours exactly one;
- windows of a period of at most t/3 are not chosen from, which keeps the set sparse: they lie inside runs found at
  smaller scales. A run whose chosen positions all fell into such a region would have that smaller period itself, since
  the region would overlap itself shifted by the run's period for longer than both periods together.

What is proposed is extended and checked on the words themselves, so a hash collision can add nothing; with 64-bit hashes
compared within one text, losing a run takes a collision among its own few windows.

Many texts are handled at once as one line of word numbers, cut at text ends; a scale keeps only texts long enough to hold its
periods. Whole texts stay in one task, whatever their length: no step holds more than a few numbers a word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from risklane.llm.common import let, spare_name, words_of

# Repetitions and words of the shortest run.
TIMES = 3
LEAST_WORDS = 24
# Periods found by shifting the text.
DIRECT = 4
# Words handled at once; a longer text is handled alone.
LINE = 400_000
# Contexts, in units of the scale, with the periods they serve (in the same unit).
CONTEXTS = ((4, Fraction(5, 2), Fraction(4)), (5, Fraction(10, 3), Fraction(5)))
NEVER = np.uint64(2**64 - 1)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29), np.uint64(32))


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of hashes."""
    first, second, low, high = MIX
    value = (left ^ (left >> low)) * first + (right ^ (right >> high)) * second
    value = (value ^ (value >> high)) * first
    return value ^ (value >> low)


def shifted(values: np.ndarray, by: int, fill=0) -> np.ndarray:
    """Values ``by`` places further on; past the end, ``fill``."""
    out = np.full_like(values, fill)
    if by < len(values):
        out[:len(values) - by] = values[by:]
    return out


class Line:
    """Texts in a row: word numbers, and where each text starts and ends."""

    def __init__(self, words: np.ndarray, counts: np.ndarray) -> None:
        self.words, self.counts = words, counts
        self.stops = np.cumsum(counts)
        self.starts = self.stops - counts
        # (start, stop, period) of the runs found, positions in this line.
        self.found: set[tuple[int, int, int]] = set()

    def bounds(self, at: int) -> tuple[int, int]:
        text = int(np.searchsorted(self.stops, at, side="right"))
        return int(self.starts[text]), int(self.stops[text])

    def grow(self, first: int, last: int, period: int) -> None:
        """Take in the run around positions first..last-1, if each equals the word ``period`` further on."""
        words = self.words
        low, high = self.bounds(first)
        if last + period > high or not np.array_equal(words[first:last], words[first + period:last + period]):
            return
        step = 32
        while last + period < high:
            size = min(step, high - period - last)
            same = words[last:last + size] == words[last + period:last + period + size]
            if not same.all():
                last += int(np.argmin(same))
                break
            last, step = last + size, step * 2
        step = 32
        while first > low:
            size = min(step, first - low)
            same = words[first - size:first] == words[first - size + period:first + period]
            if not same.all():
                first -= int(np.argmin(same[::-1]))
                break
            first, step = first - size, step * 2
        stop = last + period
        if stop - first >= TIMES * period and not self._shorter(first, period):
            self.found.add((first, stop, period))

    def _shorter(self, first: int, period: int) -> bool:
        """Whether a run of at least two periods repeats a proper divisor of its period."""
        words, left, prime = self.words, period, 2
        while left > 1:
            if prime * prime > left:
                prime = left
            if left % prime == 0:
                part = period // prime
                if np.array_equal(words[first:first + period], words[first + part:first + part + period]):
                    return True
                while left % prime == 0:
                    left //= prime
            prime += 1
        return False

    def small_periods(self) -> None:
        """Runs of the periods up to ``DIRECT``, by comparison with the shifted line."""
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        for period in range(1, DIRECT + 1):
            if len(self.words) <= period:
                break
            same = (self.words[:-period] == self.words[period:]) & (text[:-period] == text[period:])
            edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
            first, last = edges[::2], edges[1::2]
            long = last - first >= (TIMES - 1) * period
            for start, stop in zip(first[long].tolist(), last[long].tolist()):
                if not self._shorter(start, period):
                    self.found.add((start, stop + period, period))

    def larger_periods(self) -> None:
        scale = 2
        while True:
            # The smallest period of this scale, three times.
            long = np.flatnonzero(2 * self.counts >= TIMES * 5 * scale)
            if not len(long):
                return
            self._scale(long, scale)
            scale *= 2

    def _scale(self, texts: np.ndarray, scale: int) -> None:
        whole = len(texts) == len(self.counts)
        counts = self.counts[texts]
        size = int(counts.sum())
        stops = np.cumsum(counts)
        shift = np.repeat(self.starts[texts] - (stops - counts), counts)
        places = np.arange(size) + shift
        number = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)
        room = np.repeat(stops, counts) - np.arange(size)
        window = (self.words if whole else self.words[places]).astype(np.uint64)
        length = 1
        while length < scale:
            window = mixed(window, shifted(window, length))
            length *= 2
        twice = mixed(window, shifted(window, scale))
        contexts = {4: mixed(twice, shifted(twice, 2 * scale))}
        contexts[5] = mixed(contexts[4], shifted(window, 4 * scale))

        ranked = mixed(window, np.full_like(window, scale))
        ranked[ranked == NEVER] -= np.uint64(1)
        ranked[self._periodic(places, whole, scale)] = NEVER
        least, reach = ranked, 1
        while reach < scale:
            least = np.minimum(least, shifted(least, reach, NEVER))
            reach *= 2
        end = shifted(ranked, scale, NEVER)
        least = np.minimum(least, end)
        chosen = np.flatnonzero((room >= 2 * scale) & (least != NEVER) & ((least == ranked) | (least == end)))
        for times, low, high in CONTEXTS:
            at = chosen[room[chosen] >= times * scale]
            self._propose(at, places, mixed(contexts[times][at], number[at]), times * scale, low * scale, high * scale)

    def _periodic(self, places: np.ndarray, whole: bool, scale: int) -> np.ndarray:
        """Where the next ``scale`` words have a period of at most a third of it."""
        edges = np.zeros(len(self.words) + 1, np.int64)
        for start, stop, period in self.found:
            if TIMES * period <= scale <= stop - start:
                edges[start] += 1
                edges[stop - scale + 1] -= 1
        inside = np.cumsum(edges[:-1]) > 0
        return inside if whole else inside[places]

    def _propose(self, at: np.ndarray, places: np.ndarray, keys: np.ndarray, context: int, low: Fraction, high: Fraction) -> None:
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        gap = np.diff(at)
        good = np.flatnonzero((keys[1:] == keys[:-1]) & (gap >= float(low) - 1e-9) & (gap <= float(high) + 1e-9))
        if not len(good):
            return
        first, period = places[at[good]], gap[good]
        order = np.lexsort((first, period))
        first, period = first[order], period[order]
        # Proposals of one period whose equal stretches meet are one.
        new = np.flatnonzero(np.concatenate([[True], (period[1:] != period[:-1]) | (first[1:] > first[:-1] + context)]))
        lasts = np.concatenate([first[new[1:] - 1], first[-1:]]) + context
        for start, last, p in zip(first[new].tolist(), lasts.tolist(), period[new].tolist()):
            self.grow(start, last, p)

    def runs(self) -> list[list[tuple[int, int, int]]]:
        """(start, length, period) of the runs of each text, by start and then period."""
        self.small_periods()
        self.larger_periods()
        out: list[list[tuple[int, int, int]]] = [[] for _ in self.counts]
        for start, stop, period in sorted(self.found, key=lambda run: (run[0], run[2])):
            if stop - start >= LEAST_WORDS:
                text = int(np.searchsorted(self.stops, start, side="right"))
                out[text].append((start - int(self.starts[text]), stop - start, period))
        return out


def collapsed(words: Sequence, runs: Sequence[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def runs_of(texts: Sequence[list]) -> list[list[tuple[int, int, int]]]:
    """Runs of each of some lists of words."""
    counts = np.array([len(words) for words in texts], np.int64)
    flat = pa.array([word for words in texts for word in words], pa.binary())
    return Line(flat.dictionary_encode().indices.to_numpy(), counts).runs()


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def find(df: DataFrame, text: Column, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with n_words, its runs (by start, then period) and the text without repetitions.

    ``collapsed`` holds the words that no run contains after its first period, joined by one space. A null, empty or blank text
    has no words, no runs and an empty ``collapsed``. Rows that repeat are handled alike, each by itself; an empty table gives an
    empty result. Columns outside ``keep`` are ignored, whatever their names.
    """
    held = spare_name(df.select(*keep), "text")
    rows = df.select(*keep, F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias(held))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]), "n_words bigint", f"runs {RUNS}",
                        "collapsed string"])

    def line(texts: list[list[bytes]], kept: pa.Table) -> pa.RecordBatch:
        found = runs_of(texts)
        runs = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found],
                        pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])))
        short = [b" ".join(collapsed(words, runs) if runs else words).decode() for words, runs in zip(texts, found)]
        table = kept.append_column("n_words", pa.array([len(words) for words in texts], pa.int64()))
        table = table.append_column("runs", runs).append_column("collapsed", pa.array(short, pa.string()))
        return table.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, texts = 0, 0, []
            kept = pa.Table.from_batches([batch.select(list(range(batch.num_columns - 1)))])
            for at, text in enumerate(batch.column(batch.num_columns - 1)):
                # Splitting bytes splits at ASCII white space only.
                texts.append(text.as_py().split())
                size += len(texts[-1])
                if size >= LINE:
                    yield line(texts, kept.slice(first, len(texts)))
                    first, size, texts = at + 1, 0, []
            if texts:
                yield line(texts, kept.slice(first, len(texts)))

    return rows.mapInArrow(run, schema)


def longest(runs: Column) -> Column:
    """The run of the greatest exact length / period; ties go to the smallest start, then period. Null without runs."""
    return F.when(F.size(runs) > 0, F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.element_at(runs, 1), lambda best, run: F.when(
        run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best)))


def planted(df: DataFrame) -> Column:
    """The texts of the query: of one document in ten, chosen by the checksum of its id, the words from some place on repeat a block."""
    check = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = F.floor(check / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        start = F.pmod(g, n)
        block = F.lit(1) + F.floor((n - start) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("long")
        return let(F.struct(start.alias("a"), block.alias("p")), lambda at: F.concat_ws(
            " ", F.slice(words, F.lit(1), at["a"].cast("int")),
            F.transform(F.sequence(F.lit(0).cast("long"), n - at["a"] - 1),
                        lambda i: F.element_at(words, (at["a"] + F.pmod(i, at["p"]) + 1).cast("int")))))

    words = words_of(F.col("text"))
    return F.when(F.coalesce(check % 10 == 0, F.lit(False)),
                  let(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))).otherwise(F.col("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row per document: its runs counted, the best of them, and digests of all runs and of the collapsed text."""
    listed = F.array_join(F.transform("runs", lambda run: F.concat(F.concat_ws(",", *[
        run[name].cast("string") for name in ("start", "length", "period")]), F.lit("\n"))), "")
    best = F.col("best")
    return found.withColumn("best", longest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(F.lit(1000) * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
