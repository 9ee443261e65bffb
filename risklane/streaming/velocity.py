"""Exact velocity of arriving payments from keyed state.

State of a card: one total of everything older than any window can reach; its recent payments, packed into one value; and,
for every span of ``SPAN`` seconds that saw ``BIG`` payments or more, their total, with the payments themselves in a map by
span. A payment's history is the old total, the totals of big spans before a point in time, and the payments before that
point among the recent ones and in the one big span the point lies in. So a micro-batch reads a bounded number of rows
a card besides those of the spans its windows begin and end in, however long the history is. What no window of a payment
still accepted can reach is folded into the old total, when payments of the card arrive or by an event-time timer.

Cards that hash alike share a key, and their states are packed into one value. Big spans are entries of their own, so that a key
reads no more than the old totals, the recent payments and the spans its batch asks for.

A hot card is split into parts, each with a state of its own: a payment is kept by one part (by its id), asked of every
part, and the parts' answers add up. Payments later than the watermark are dropped by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import MapState

from risklane.functions.clock import DAY, WEEK
from risklane.operators.ordered import TASK_ROWS, if_small
from risklane.operators.velocity import EXACT, HORIZONS, KEY, from_history
from risklane.staging import new_path
from risklane.streaming import jobs

# Seconds of a span, and payments that make it a big one.
SPAN = 6 * 3600
BIG = 256
# Keys of the state. A call for a key costs about 10 ms whatever it holds, so cards share keys and a batch makes at most this many calls.
BUCKETS = 8192
# Stands for a missing card.
NO_CARD = -2**63
# What a sum is kept in: squares of cents outgrow 64 bits, so they are kept in two parts.
PART = np.int64(2**31)
# Columns of a total: span, payments, sum, squares. The first row, of no span, is the old total.
WIDTH = 5
OLD = np.iinfo(np.int64).min

HISTORY = ["_n", "_sum", *[f"{what}_{name}" for name in HORIZONS for what in ("_n", "_sum")]]
SCHEMA = ", ".join(["TransactionID bigint", "card1 bigint", "TransactionDT bigint", "cents bigint",
                    *[f"{name} bigint" for name in HISTORY], "_high bigint", "_low bigint"])


def amounts(cents: np.ndarray) -> np.ndarray:
    """Columns (n, sum, high, low) of single payments."""
    square = cents * cents
    return np.stack([np.ones_like(cents), cents, square // PART, square % PART], axis=1)


def running(rows: np.ndarray) -> np.ndarray:
    """Totals before each row and after the last."""
    return np.concatenate([np.zeros((1, rows.shape[1]), np.int64), np.cumsum(rows, axis=0)])


class CardState:
    """The state of one part of a card while a batch is worked on."""

    def __init__(self, totals: np.ndarray, recent: np.ndarray, due: int, spans: MapState) -> None:
        self.totals, self.recent, self.due, self.spans = totals, recent, due, spans
        self.read: dict[int, np.ndarray] = {}

    def rows(self, span: int) -> np.ndarray:
        """(time, id, cents) of the payments of a big span, in order."""
        if span not in self.read:
            self.read[span] = np.frombuffer(self.spans.getValue((span,))[0], np.int64).reshape(-1, 3)
        return self.read[span]

    def _put(self, span: int, rows: np.ndarray) -> None:
        self.spans.updateValue((span,), (rows.tobytes(),))
        self.read[span] = rows
        kept = self.totals[self.totals[:, 0] != span]
        at = int(np.searchsorted(kept[:, 0], span))
        self.totals = np.insert(kept, at, [span, *amounts(rows[:, 2]).sum(axis=0)], axis=0)

    def keep(self, fresh: np.ndarray) -> None:
        """Take in new payments; spans that have become big move out of the recent ones."""
        spans = fresh[:, 0] // SPAN
        old = np.isin(spans, self.totals[1:, 0])
        for span in np.unique(spans[old]).tolist():
            self._put(span, in_order(np.concatenate([self.rows(span), fresh[spans == span]])))
        self.recent = in_order(np.concatenate([self.recent, fresh[~old]]))
        found, counts = np.unique(self.recent[:, 0] // SPAN, return_counts=True)
        for span in found[counts >= BIG].tolist():
            inside = self.recent[:, 0] // SPAN == span
            self._put(span, self.recent[inside])
            self.recent = self.recent[~inside]

    def history(self, points: np.ndarray, idents: np.ndarray | None = None) -> np.ndarray:
        """Totals of the payments before each point: earlier in time, or of the same second with a smaller id."""
        spans = points // SPAN
        out = running(self.totals[:, 1:])[np.searchsorted(self.totals[:, 0], spans)]
        out = out + running(amounts(self.recent[:, 2]))[before(self.recent, points, idents)]
        for span in np.intersect1d(spans, self.totals[1:, 0]).tolist():
            asked = np.flatnonzero(spans == span)
            inside = self.rows(span)
            out[asked] += running(amounts(inside[:, 2]))[before(inside, points[asked], None if idents is None else idents[asked])]
        return out

    def fold(self, watermark: int) -> None:
        """Payments out of every window's reach go into the old total."""
        reach = watermark - WEEK
        gone = (self.totals[:, 0] != OLD) & ((self.totals[:, 0] + 1) * SPAN <= reach)
        for span in self.totals[gone, 0].tolist():
            self.spans.removeKey((span,))
        passed = int(np.searchsorted(self.recent[:, 0], reach))
        self.totals[0, 1:] += self.totals[gone, 1:].sum(axis=0) + amounts(self.recent[:passed, 2]).sum(axis=0)
        self.totals, self.recent = self.totals[~gone], self.recent[passed:]

    def next_due(self) -> int | None:
        """When something passes out of reach, in milliseconds; a timer a day at most."""
        ends = [*((self.totals[1:2, 0] + 1) * SPAN).tolist(), *(self.recent[:1, 0] + 1).tolist()]
        return -(-(min(ends) + WEEK) // DAY) * DAY * 1000 if ends else None


def in_order(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def before(rows: np.ndarray, points: np.ndarray, idents: np.ndarray | None) -> np.ndarray:
    """How many of some ordered payments stand before each point."""
    first = np.searchsorted(rows[:, 0], points, side="left")
    if idents is not None:
        last = np.searchsorted(rows[:, 0], points, side="right")
        for i in np.flatnonzero(last - first > 1):
            first[i] += np.searchsorted(rows[first[i]:last[i], 1], idents[i])
        single = np.flatnonzero(last - first == 1)
        first[single] += rows[first[single], 1] < idents[single]
    return first


class CardSpans:
    """The big spans of one part of a card among those of its key."""

    def __init__(self, spans: MapState, card: int, part: int) -> None:
        self.spans, self.owner = spans, (card, part)

    def getValue(self, key: tuple) -> tuple:
        return self.spans.getValue((*self.owner, *key))

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.spans.updateValue((*self.owner, *key), value)

    def removeKey(self, key: tuple) -> None:
        self.spans.removeKey((*self.owner, *key))


Cards = dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]


def packed(cards: Cards) -> bytes:
    """(card, part) -> (totals, recent) as whole numbers: how many, a line of (card, part, totals, recent ones) each, then all of them."""
    lines = np.array([(*owner, len(totals), len(recent)) for owner, (totals, recent) in cards.items()], np.int64)
    return b"".join([np.int64(len(cards)).tobytes(), lines.tobytes(), *[rows.tobytes() for kept in cards.values() for rows in kept]])


def unpacked(value: bytes) -> Cards:
    numbers = np.frombuffer(value, np.int64)
    cards, at = {}, 1 + 4 * int(numbers[0])
    for card, part, totals, recent in numbers[1:at].reshape(-1, 4).tolist():
        middle, end = at + WIDTH * totals, at + WIDTH * totals + 3 * recent
        cards[card, part] = numbers[at:middle].reshape(-1, WIDTH), numbers[middle:end].reshape(-1, 3)
        at = end
    return cards


class CardVelocity(StatefulProcessor):
    """State and answers of the parts of cards that share a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cards = handle.getValueState("cards", "packed binary, due bigint")
        self.spans = handle.getMapState("spans", "card bigint, part bigint, span bigint", "packed binary")

    def close(self) -> None:
        pass

    def _load(self) -> tuple[Cards, int]:
        kept = self.cards.get()
        return ({}, 0) if kept is None else (unpacked(kept[0]), kept[1])

    def _state(self, cards: Cards, owner: tuple[int, int]) -> CardState:
        totals, recent = cards.get(owner, (np.array([[OLD, 0, 0, 0, 0]], np.int64), np.zeros((0, 3), np.int64)))
        return CardState(totals.copy(), recent, 0, CardSpans(self.spans, *owner))

    def _save(self, cards: Cards, due: int, changed: dict[tuple[int, int], CardState], watermark: int) -> None:
        soonest = []
        for owner, state in changed.items():
            state.fold(watermark)
            cards[owner] = state.totals, state.recent
            soonest.append(state.next_due())
        soonest = min((at for at in soonest if at is not None), default=None)
        if soonest is not None and (due == 0 or soonest < due):
            self.handle.registerTimer(soonest)
            due = soonest
        self.cards.update((packed(cards), due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        time, ident, cents, card, part = (batch[name].to_numpy(np.int64) for name in ("seconds", "TransactionID", "cents", "owner", "part"))
        mine, payments = batch["mine"].to_numpy(bool), np.stack([time, ident, cents], axis=1)
        found = {name: np.zeros(len(batch), np.int64) for name in (*HISTORY, "_high", "_low")}
        order = np.lexsort((part, card))
        starts = np.flatnonzero(np.diff(card[order], prepend=card[order[0]]) | np.diff(part[order], prepend=-1))
        cards, due = self._load()
        changed = {}
        for at in np.split(order, starts[1:]):
            owner = int(card[at[0]]), int(part[at[0]])
            state = changed[owner] = self._state(cards, owner)
            state.keep(payments[at][mine[at]])
            own = state.history(time[at], ident[at])
            for i, name in enumerate(("_n", "_sum", "_high", "_low")):
                found[name][at] = own[:, i]
            for name, seconds in HORIZONS.items():
                older = state.history(time[at] - seconds)
                found[f"_n_{name}"][at], found[f"_sum_{name}"][at] = older[:, 0], older[:, 1]
        self._save(cards, due, changed, timerValues.getCurrentWatermarkInMs() // 1000)
        yield pd.DataFrame({**{name: batch[name] for name in ("TransactionID", "card1", "TransactionDT", "cents")}, **found})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cards, _ = self._load()
        self._save(cards, 0, {owner: self._state(cards, owner) for owner in cards}, timerValues.getCurrentWatermarkInMs() // 1000)
        return iter([])


def histories(payments: DataFrame, late: str = "1 hour", hot: DataFrame | None = None) -> DataFrame:
    """What every arriving payment adds up to before it, one row for each part of its card.

    ``payments`` has an event time ``ts``. ``hot`` holds (card1, parts) of the cards to be split; a card's parts may
    grow from run to run, and must not shrink.
    """
    spark = payments.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = payments.withWatermark("ts", late).select(
        "ts", F.col("TransactionID").cast("bigint").alias("TransactionID"), F.col("card1").cast("bigint").alias("card1"),
        F.col("TransactionDT").cast("bigint").alias("TransactionDT"), F.col("cents").cast("bigint").alias("cents"),
        F.unix_seconds("ts").alias("seconds"))
    if hot is None:
        rows = rows.withColumn("part", F.lit(0)).withColumn("mine", F.lit(True))
    else:
        few = if_small(hot.select("card1", "parts"))
        rows = rows.join(few, "card1", "left").withColumn("_parts", F.coalesce("parts", F.lit(1)).cast("int")).drop("parts")
        home = F.pmod(F.xxhash64("TransactionID"), F.col("_parts"))
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn(
            "mine", F.col("part") == home).drop("_parts")
    rows = rows.withColumn("owner", F.coalesce("card1", F.lit(NO_CARD)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("owner", "part"), F.lit(BUCKETS)))
    return rows.groupBy("bucket").transformWithStateInPandas(
        CardVelocity(), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")


def velocity_of(found: DataFrame) -> DataFrame:
    """Velocity columns of one micro-batch of ``histories``: the parts of a payment arrive together."""
    keys = [*KEY, "cents"]
    summed = found.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in (*HISTORY, "_high", "_low")])
    squares = (F.col("_high").cast(EXACT) * F.lit(int(PART)).cast("decimal(10,0)") + F.col("_low").cast(EXACT)).cast(EXACT)
    return from_history(summed.withColumn("_squares", squares))


class VelocityStream:
    """Runs of the velocity query over one folder of output, state and hot cards.

    A restarted run goes on from the state. Before it starts, cards with more than ``limit`` payments so far get one part for
    every ``limit`` of them; parts are never taken away.
    """

    def __init__(self, payments: DataFrame, root: str, late: str = "1 hour", limit: int = TASK_ROWS) -> None:
        self.payments, self.root, self.late, self.limit = payments, root, late, limit

    def output(self) -> DataFrame:
        return self.payments.sparkSession.read.parquet(f"{self.root}/out").drop("batch")

    def _hot(self) -> DataFrame | None:
        """(card1, parts) by the payments answered so far."""
        spark = self.payments.sparkSession
        try:
            done = self.output()
        except Exception as error:          # no run has written yet
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return None
            raise
        hot = done.groupBy("card1").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > self.limit).select(
            "card1", F.ceil(F.col("n") / self.limit).cast("int").alias("parts"))
        path = new_path(spark, "hot-cards")
        hot.write.parquet(path)
        return spark.read.parquet(path)

    def run(self) -> StreamingQuery:
        """Answer what has arrived, and stop."""
        def write(batch: DataFrame, number: int) -> None:
            velocity_of(batch).write.mode("overwrite").parquet(f"{self.root}/out/batch={number}")

        query = jobs.start(histories(self.payments, self.late, self._hot()), write, "append", f"{self.root}/checkpoint")
        query.awaitTermination()
        return query
