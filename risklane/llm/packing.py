"""Packing token ids into training sequences as vector bin packing with the dot-product heuristic.

A sequence has three limits: ids, segments and loss-bearing ids. Of the pieces that fit, the one whose vector (each
part over its limit) has the greatest dot product with what is left of the sequence goes in next (Panigrahy et al.,
"Heuristics for Vector Bin Packing"). When nothing fits whole, the piece is cut whose head fills the gap. So every
sequence but the last of a task is full, unless its segments run out first.

Each task packs the rows of its own input partition, with memory bounded by the pool of waiting pieces, and hands on the one
sequence that ran out of pieces, with its ids. These tails, one a task, are dealt to groups of ``TAILS`` tasks and packed again, and so
on until one group is left: padding does not depend on how many tasks there were. Sequence ids hold the round and the task or
group. A lost task is redone with the same result, since it depends on the rows of its partition only.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from risklane.llm.common import TEXT_BATCH, stage

# Fixed values of the query: ids in a sequence, the id that ends a document.
LENGTH = 4096
END_ID = 2
# Pieces that wait at once in a task, out of which a sequence is filled.
POOL = 1024
# Tasks whose tails are packed together.
TAILS = 64
# Distinct words whose ids a task keeps at hand.
CACHED_WORDS = 400_000

# Fixed value: how the vocabulary's pre-tokenizer cuts lower-case text.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Control characters that Python takes for white space and the tokenizer does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
GAPS = re.compile(r"[^ \t-\r]+")


class Limits(NamedTuple):
    ids: int = LENGTH
    segments: int = 1024
    loss: int = LENGTH


class Words(dict):
    """Ids of words, worked out as they are met."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.encode(word)
        return found


class Encoder:
    """Ids of whole texts, word by word: words recur, and white space parts them for this vocabulary anyway.

    A word of characters below U+0250, which normalisation leaves alone, is cut as the tokenizer cuts it, and the
    parts, which are words themselves, are looked up in the same table; any other word, and any that may hold a special
    token, goes to the tokenizer as it is.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = Words(self._word)
        # Fixed value: the characters that stand for bytes in a byte-level vocabulary.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [byte for byte in range(256) if byte not in shown]
        self.shown = {byte: byte for byte in shown} | {byte: 256 + i for i, byte in enumerate(hidden)}

    def _part(self, part: str) -> bytes:
        text = part if part.isascii() and part.isalnum() else part.encode().decode("latin-1").translate(self.shown)
        return array("I", [token.id for token in self.model.tokenize(text)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and len(word) <= 64:       # most words that are met for the first time
            return self._part(word) if word.islower() else self.words[word.lower()]
        if len(word) > 64 or "<|" in word or not word.isascii() and (max(word) >= "ɐ" or "İ" in word):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        low, words = word.lower(), self.words
        if low.isalpha():
            return self._part(low)
        if low[:-1].isalpha() and low[-1] in ".,":
            return words[low[:-1]] + words[low[-1]]
        parts = PARTS.findall(low)
        return self._part(low) if parts == [low] else b"".join([words[part] for part in parts])

    def ids(self, text: str) -> np.ndarray:
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        words = GAPS.findall(text) if ODD_SPACE.search(text) else text.split()
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.uint32)


class Packer:
    """Pieces waiting to be placed, and the rows of those that are."""

    def __init__(self, limits: Limits, first: int) -> None:
        self.limits, self.sequence, self.rows = limits, first, []
        self.pieces: list[tuple] = []           # (doc_id, start, ids, doc_tokens, first loss-bearing id)

    @staticmethod
    def _loss(start: int, count: int, loss_from: int) -> int:
        return max(0, start + count - max(start, loss_from))

    def add(self, doc_id, ids: np.ndarray, loss_from: int) -> None:
        self.waiting(doc_id, 0, ids, len(ids), loss_from)

    def waiting(self, doc_id, start: int, ids: np.ndarray, total: int, loss_from: int) -> None:
        limits = self.limits
        while len(ids) >= limits.ids and limits.loss >= limits.ids:
            self._emit([(doc_id, start, ids[:limits.ids], total, loss_from)])
            start, ids = start + limits.ids, ids[limits.ids:]
        if len(ids):
            self.pieces.append((doc_id, start, ids, total, loss_from))

    def drain(self, keep: int, hand_on: bool = False) -> None:
        """Fill sequences until at most ``keep`` pieces wait.

        With ``hand_on``, the pieces of a sequence for which they ran out, and with them the last ones, wait on.
        """
        if len(self.pieces) <= keep:
            return
        pieces, limits = self.pieces, np.array(self.limits, float)
        # One line for each limit, so that a comparison or a product is a single run over the pieces.
        sizes = np.array([(len(p[2]), 1, self._loss(p[1], len(p[2]), p[4])) for p in pieces], float).T.copy()
        free = np.ones(len(pieces), bool)
        shares = sizes / limits[:, None]
        left_over = len(pieces)
        while left_over > keep:
            room, placed = limits.copy(), []
            while room[0] >= 1 and room[1] >= 1:
                fits = free & (sizes[0] <= room[0]) & (sizes[2] <= room[2])       # and room for a segment, as tested above
                weight = room / limits
                at = int(np.where(fits, shares[0] * weight[0] + shares[1] * weight[1] + shares[2] * weight[2], -1.0).argmax())
                if fits[at]:
                    placed.append(pieces[at])
                    free[at] = False
                    left_over -= 1
                    room -= sizes[:, at]
                    continue
                at = self._cut(pieces, sizes, free, room)
                if at is None:
                    break
                doc_id, start, ids, total, loss_from = pieces[at]
                head = self._head(start, len(ids), loss_from, room)
                placed.append((doc_id, start, ids[:head], total, loss_from))
                room -= (head, 1, self._loss(start, head, loss_from))
                pieces[at] = (doc_id, start + head, ids[head:], total, loss_from)
                sizes[:, at] = (len(ids) - head, 1, self._loss(start + head, len(ids) - head, loss_from))
                shares[:, at] = sizes[:, at] / limits
            if hand_on and not left_over and room[0] >= 1 and room[1] >= 1:
                self.pieces = placed
                return
            self._emit(placed)
        self.pieces = [piece for piece, still in zip(pieces, free) if still]

    def _head(self, start: int, count: int, loss_from: int, room: np.ndarray) -> int:
        """Most leading ids of a piece that fit."""
        plain = min(count, max(0, loss_from - start))
        return int(min(count, room[0], plain + room[2]))

    def _cut(self, pieces: list[tuple], sizes: np.ndarray, free: np.ndarray, room: np.ndarray) -> int | None:
        """The smallest waiting piece of which some ids fit; none left means that the sequence stays short."""
        left = np.flatnonzero(free)
        for at in left[np.argsort(sizes[0, left], kind="stable")]:
            if self._head(pieces[at][1], len(pieces[at][2]), pieces[at][4], room) > 0:
                return int(at)
        return None

    def _emit(self, placed: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total, loss_from in placed:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset,
                              self._loss(start, len(ids), loss_from)))
            offset += len(ids)
        self.sequence += 1

    def taken(self, task: int | None = None) -> pd.DataFrame:
        """Rows of the pieces placed since the last call; with ``task``, also those that wait, with what it takes to place them later."""
        rows, self.rows = [(*row, None, None, None) for row in self.rows], []
        if task is not None:
            rows += [(doc_id, start, len(ids), None, total, None, None, None, task, loss_from, ids.tobytes())
                     for doc_id, start, ids, total, loss_from in self.pieces]
        whole = [*COLUMNS, *TAIL[:-1]]
        return pd.DataFrame(rows, columns=[*COLUMNS, *TAIL]).astype({name: "Int64" for name in whole})


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
TAIL = ["task", "loss_from", "ids"]
SCHEMA = ", ".join(f"{name} bigint" for name in [*COLUMNS, *TAIL[:-1]]) + ", ids binary"


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         loss_col: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """One row for each piece of each row of ``df``.

    A null text counts as empty: its only id is ``END_ID``. ``loss_col`` holds the number of ids at the end of a
    document that bear loss (null or no column: all of them). Rows with equal ids are packed as separate documents. An empty table
    gives an empty result; other columns of ``df`` are ignored.
    """
    loss = F.col(loss_col).cast("bigint") if loss_col else F.lit(None).cast("bigint")
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), loss.alias("loss"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(tokenizer_path)
        task = TaskContext.get().partitionId()
        packer = Packer(limits, task << 32)
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            for doc_id, text, bears in zip(batch["doc_id"], batch["text"], batch["loss"]):
                ids = np.concatenate([encoder.ids(text or ""), end])
                loss_from = 0 if pd.isna(bears) else max(0, len(ids) - int(bears))
                packer.add(None if pd.isna(doc_id) else int(doc_id), ids, loss_from)
                if len(packer.pieces) >= 2 * POOL:
                    packer.drain(POOL)
            if packer.rows:
                yield packer.taken()
        packer.drain(0, hand_on=True)
        yield packer.taken(task)

    packed = stage(rows.mapInPandas(pieces, SCHEMA), "packed", TEXT_BATCH)
    done = packed.filter("task IS NULL").select(*COLUMNS)
    tails, number = packed.filter("task IS NOT NULL"), 0
    while True:
        # One row a group: the groups there are, at most the tasks of the scan over TAILS.
        last = tails.agg(F.max("task").alias("t")).first()["t"]
        if last is None:
            return done
        number += 1
        again = stage(again_packed(tails, limits, number, last < TAILS), "packed")
        done = done.unionByName(again.filter("task IS NULL").select(*COLUMNS))
        if last < TAILS:
            return done
        tails = again.filter("task IS NOT NULL")


def again_packed(tails: DataFrame, limits: Limits, number: int, is_last: bool) -> DataFrame:
    """Tails of groups of tasks packed together; each group hands on one tail, the last one none."""
    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["task", "doc_id", "start", "length", "ids"], ignore_index=True)
        task = int(rows["task"].iloc[0]) // TAILS
        packer = Packer(limits, number << 52 | task << 32)
        for doc_id, start, ids, total, loss_from in zip(rows["doc_id"], rows["start"], rows["ids"], rows["doc_tokens"], rows["loss_from"]):
            packer.waiting(None if pd.isna(doc_id) else int(doc_id), int(start), np.frombuffer(ids, np.uint32), int(total), int(loss_from))
        packer.drain(0, hand_on=not is_last)
        return packer.taken(task)

    return tails.groupBy(F.floor(F.col("task") / TAILS)).applyInPandas(group, SCHEMA)
