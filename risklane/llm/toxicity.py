"""Toxicity by a convolutional text classifier, trained in numpy inside one Spark task and scored in Arrow batches.

A word is the mean of hashed embeddings: the whole word and its letter 4- and 5-grams (with word ends), so that unseen
inflections of a known stem are met. Filters one, two and three words wide run over the whole text, each filter
keeps its greatest response, and a logistic layer turns these into a score between 0 and 1.

Training reads a bounded sample of labelled rows (``SAMPLE_DOCS``, at most ``SAMPLE_WORDS`` words of whole texts, in a
hash order of the ids); everything else covers every row and whole texts. Thresholds are calibrated by language on
sampled rows that the fit did not see. Scores read nothing but the text.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from risklane.llm.common import TEXT_BATCH, shuffled, spare_name, stage
from risklane.operators.ordered import small

# Most labelled documents of either class that a model is fitted on, and most words of theirs.
SAMPLE_DOCS = 3_000
SAMPLE_WORDS = 4_000_000
# Of the sample, one in so many is not fitted on. With all labelled rows outside the sample it calibrates thresholds.
CALIBRATE = 5
# Score bins that thresholds are chosen from, and calibrating rows of either class that a language of its own needs.
BINS, LEAST_ROWS = 4_096, 20
BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
EPOCHS, BATCH_DOCS, RATE = 8, 128, 0.02
# Sampled documents that a bucket must be met in to be learned; what fewer hold tells one text from another, not a class.
LEAST_DOCS = 3
# Words whose vectors a task keeps at hand.
CACHED_WORDS = 150_000
# Words that go through the filters at once.
CHUNK = 1 << 16
LETTERS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Buckets of a word: itself and its letter 4- and 5-grams."""
    edged = f"<{word}>".encode()
    grams = [edged] + [edged[i:i + n] for n in (4, 5) for i in range(len(edged) - n + 1)]
    return [zlib.crc32(gram) % BUCKETS for gram in grams]


class Words:
    """Rows of word vectors for the words met, filled as they come; starts anew when ``CACHED_WORDS`` are held."""

    def __init__(self, model: "Model") -> None:
        self.table, self.width = model.embeddings, model.kernel.shape[1]
        self.kernel = model.kernel
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, self.width), np.float32)

    def responses(self, words: list[str]) -> np.ndarray:
        """Responses of all filter taps to each word."""
        if len(self.index) > CACHED_WORDS:
            self._clear()
        fresh = [word for word in set(words) if word not in self.index]
        if fresh:
            start = len(self.index)
            while start + len(fresh) > len(self.rows):
                held, self.rows = self.rows, np.zeros((2 * len(self.rows), self.width), np.float32)
                self.rows[:len(held)] = held        # the rest takes no memory until it is written
            self.index.update(zip(fresh, range(start, start + len(fresh))))
            grams = [features(word) for word in fresh]
            sizes = np.array([len(g) for g in grams])
            flat = np.fromiter((b for g in grams for b in g), np.int64, int(sizes.sum()))
            sums = np.add.reduceat(self.table[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            self.rows[start:start + len(fresh)] = (sums / sizes[:, None]) @ self.kernel
        return self.rows[[self.index[word] for word in words]]


class Model(NamedTuple):
    """Embeddings (buckets, dims); kernel (dims, taps * filters), taps of one width next to each other."""
    embeddings: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    def pooled(self, words: list[str], cache: Words) -> np.ndarray:
        """Greatest response of every filter anywhere in the text; zeros past its ends, so short texts have one too."""
        best = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        overlap = max(WIDTHS) - 1
        for start in range(0, len(words), CHUNK):
            part = words[start:start + CHUNK + overlap]
            taps = np.concatenate([cache.responses(part), np.zeros((overlap, self.kernel.shape[1]), np.float32)])
            best = np.maximum(best, greatest(taps, min(CHUNK, len(part)), self.bias)[0])
        return best

    def score(self, text: str | None, cache: Words) -> float:
        best = self.pooled(LETTERS.findall((text or "").lower()), cache)
        return float(1 / (1 + np.exp(-np.clip(best @ self.weights + self.offset, -30, 30))))


def greatest(taps: np.ndarray, count: int, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(greatest rectified response, the word it starts at) per filter; ``taps`` has rows to spare at its end."""
    values, places, tap = [], [], 0
    for i, width in enumerate(WIDTHS):
        sums = taps[:count, tap * FILTERS:(tap + 1) * FILTERS].copy()
        for k in range(1, width):
            sums += taps[k:count + k, (tap + k) * FILTERS:(tap + k + 1) * FILTERS]
        tap += width
        at = sums.argmax(axis=0)
        places.append(at)
        values.append(np.maximum(sums[at, np.arange(FILTERS)] + bias[i * FILTERS:(i + 1) * FILTERS], 0))
    return np.concatenate(values), np.concatenate(places)


class Adam:
    def __init__(self, shape: tuple[int, ...]) -> None:
        self.m, self.v, self.t = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0

    def step(self, value: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad * grad - self.v)
        value -= RATE * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.99 ** self.t)) + 1e-8)


def evidence(met: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Signed root of the likelihood ratio of each bucket: how surely its documents are of one class more than of the other."""
    share = np.clip(labels.mean(), 1e-6, 1 - 1e-6) if len(labels) else 0.5
    total = np.maximum(met.sum(axis=0), 1e-9)
    parts = [m * np.log(np.maximum(m, 1e-9) / (total * p)) for m, p in ((met[1], share), (met[0], 1 - share))]
    return np.sign(met[1] - total * share) * np.sqrt(np.maximum(2 * (parts[0] + parts[1]), 0))


def fit(texts: list[list[str]], labels: np.ndarray, seed: int = 7) -> Model:
    """Mini-batch gradient steps on the logistic loss, the classes weighted evenly. Deterministic.

    The first dimension of an embedding starts from the evidence of its bucket, the others at random.
    """
    rng = np.random.default_rng(seed)
    taps = sum(WIDTHS)
    embeddings = (rng.standard_normal((BUCKETS, DIMS)) * 0.05).astype(np.float32)
    kernel = (rng.standard_normal((DIMS, taps * FILTERS)) * 0.5).astype(np.float32)
    bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    weights = (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.3).astype(np.float32)
    offset = np.zeros(1, np.float32)
    vocabulary = {word: i for i, word in enumerate(sorted({w for words in texts for w in words}))}
    grams = [features(word) for word in vocabulary]
    starts = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int64)
    flat = np.fromiter((b for g in grams for b in g), np.int32, int(starts[-1]))
    del grams
    docs = [np.array([vocabulary[w] for w in words], np.int32) for words in texts]
    met = np.zeros((2, BUCKETS))
    for doc, label in zip(docs, labels):
        of = np.unique(doc)
        met[int(label), np.unique(np.concatenate([flat[starts[w]:starts[w + 1]] for w in of] or [np.zeros(0, np.int32)]))] += 1
    learnt = met.sum(axis=0) >= LEAST_DOCS
    embeddings[:, 0] = np.clip(evidence(met, labels) / 3, -2, 2)
    embeddings[~learnt] = 0
    kernel[0] = np.abs(kernel[0])
    share = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    rules = {name: Adam(value.shape) for name, value in
             (("kernel", kernel), ("bias", bias), ("weights", weights), ("offset", offset))}
    squares = np.full(BUCKETS, 1e-8, np.float32)
    pad = np.zeros((max(WIDTHS) - 1, taps * FILTERS), np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for batch in np.array_split(order, max(1, len(order) // BATCH_DOCS)):
            used = np.unique(np.concatenate([docs[i] for i in batch] or [np.zeros(0, np.int32)]))
            vectors = np.zeros((len(used), DIMS), np.float32)
            if len(used):
                sizes = starts[used + 1] - starts[used]
                ends = np.cumsum(sizes)
                member = np.repeat(starts[used] - (ends - sizes), sizes) + np.arange(ends[-1])
                buckets = flat[member]
                vectors = np.add.reduceat(embeddings[buckets], ends - sizes) / sizes[:, None].astype(np.float32)
            responses = vectors @ kernel
            g_vectors, g_kernel = np.zeros_like(vectors), np.zeros_like(kernel)
            g_bias, g_weights, g_offset = np.zeros_like(bias), np.zeros_like(weights), np.zeros_like(offset)
            for i in batch:
                rows = np.searchsorted(used, docs[i])
                if len(rows):
                    pooled, places = greatest(np.concatenate([responses[rows], pad]), len(rows), bias)
                else:
                    pooled = np.zeros(len(weights), np.float32)
                score = 1 / (1 + np.exp(-np.clip(pooled @ weights + offset[0], -30, 30)))
                error = np.float32((score - labels[i]) * share[i] / len(batch))
                g_weights += error * pooled
                g_offset += error
                back = error * weights * (pooled > 0)
                if not len(rows):
                    continue
                g_bias += back
                tap = 0
                for w, width in enumerate(WIDTHS):
                    for f in range(FILTERS):
                        g, at = back[w * FILTERS + f], places[w * FILTERS + f]
                        if g:
                            for k in range(min(width, len(rows) - at)):
                                column = (tap + k) * FILTERS + f
                                g_kernel[:, column] += g * vectors[rows[at + k]]
                                g_vectors[rows[at + k]] += g * kernel[:, column]
                    tap += width
            touched = np.flatnonzero(np.abs(g_vectors).sum(axis=1)) if len(used) else np.zeros(0, np.int64)
            for value, name, grad in ((kernel, "kernel", g_kernel), (bias, "bias", g_bias),
                                      (weights, "weights", g_weights + 1e-4 * weights), (offset, "offset", g_offset)):
                rules[name].step(value, grad)
            for row in touched:         # rare buckets learn as fast as frequent ones
                where = flat[starts[used[row]]:starts[used[row] + 1]]
                grad = g_vectors[row] / len(where)
                where = where[learnt[where]]
                squares[where] += float(grad @ grad)
                np.subtract.at(embeddings, where, 0.02 * grad / np.sqrt(squares[where])[:, None])
    return Model(embeddings, kernel, bias, weights, float(offset[0]))


def best_cut(clean: np.ndarray, toxic: np.ndarray) -> float:
    """Midway between neighbouring bins with rows where F1 is greatest; nearest to 0.5 among ties; 0.5 without both classes.

    Both inputs hold the (weighted) rows of a class per score bin.
    """
    if not clean.any() or not toxic.any():
        return 0.5
    taken = np.flatnonzero(clean + toxic)
    options = np.concatenate([[BINS // 2], (taken[1:] + taken[:-1] + 1) // 2])
    options = options[np.argsort(np.abs(options - BINS // 2), kind="stable")]
    hits, flagged = (np.append(np.cumsum(of[::-1])[::-1], 0)[options] for of in (toxic, clean + toxic))
    return float(options[int(np.argmax(np.round(2 * hits / (flagged + toxic.sum()), 12)))] / BINS)


def train(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task over the bounded sample: fit, and hand out the model as bytes and the rows it was fitted on."""
    texts, labels, orders, words = [], [], [], 0
    known: dict[str, str] = {}          # each word is kept once, however often it is met
    sample = pd.concat([part for part in rows], ignore_index=True)
    sample = sample.sort_values(["_order", "_toxic", "_text"], kind="stable", ignore_index=True)
    for text, label, order in zip(sample["_text"], sample["_toxic"], sample["_order"]):
        found = LETTERS.findall((text or "").lower())
        if words + len(found) > SAMPLE_WORDS and texts:
            continue
        words += len(found)
        texts.append([known.setdefault(word, word) for word in found])
        labels.append(int(label))
        orders.append(int(order))
    marks = np.array(labels)
    fitted = np.arange(len(texts)) % CALIBRATE != CALIBRATE - 1
    model = fit([t for t, f in zip(texts, fitted) if f], marks[fitted])
    out = io.BytesIO()
    np.savez(out, embeddings=model.embeddings.astype(np.float16), kernel=model.kernel, bias=model.bias,
             weights=model.weights, offset=model.offset)
    yield pd.DataFrame({"model": [out.getvalue()], "fitted": [[o for o, f in zip(orders, fitted) if f]]})


def load(blob: bytes) -> tuple[Model, dict[str, float], float]:
    """The model, the thresholds of languages, and the one of all others; 0.5 before any are set."""
    with np.load(io.BytesIO(blob), allow_pickle=False) as held:
        model = Model(held["embeddings"].astype(np.float32), held["kernel"], held["bias"], held["weights"],
                      float(held["offset"]))
        if "pooled" not in held.files:
            return model, {}, 0.5
        return model, dict(zip(held["langs"].tolist(), held["levels"].tolist())), float(held["pooled"])


def held_out(ident: Column) -> Column:
    """Rows that no model may learn labels from: crc32 of the id as text divides by 5. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.encode(ident.cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(True))


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            lang_col: str = "lang", per_class: int = SAMPLE_DOCS) -> bytes | None:
    """A model from at most ``per_class`` labelled rows of each class, in hash order of the id; None without labels.

    Its thresholds come from every labelled row that it was not fitted on.
    """
    usable = stage(labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")) \
        .filter(F.col("_toxic").isin(0, 1) & ~held_out(F.col("_id"))).dropDuplicates(["_id"]) \
        .withColumn("_order", F.xxhash64(F.col("_id"))), "labelled")
    picked = stage(usable.filter("_toxic = 1").orderBy("_order", "_id").limit(per_class).unionByName(
        usable.filter("_toxic = 0").orderBy("_order", "_id").limit(per_class)), "sampled")
    thin = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    rows = thin.drop("_lang").join(F.broadcast(picked), "_id").dropDuplicates(["_id"])
    schema = "model binary, fitted array<bigint>"
    made = stage(stage(rows, "texts").repartition(1).mapInPandas(train, schema) if not picked.isEmpty() else
                 docs.sparkSession.createDataFrame([], schema), "model", TEXT_BATCH).first()
    return calibrated(made["model"], thin, usable, made["fitted"]) if made else None


def calibrated(blob: bytes, docs: DataFrame, usable: DataFrame, fitted: list[int]) -> bytes:
    """``blob`` with a threshold for every language, from counts of (language, label, score bin).

    The fit takes more of one class than of the other, so what it leaves is weighted up, by language and label, to all
    labelled rows: the cut is made at the prevalence that the corpus has.
    """
    spark = docs.sparkSession
    seen = spark.createDataFrame([(o,) for o in fitted], "_order bigint")
    bounded = F.broadcast if small(usable) else shuffled
    every = docs.select("_id", "_lang").join(bounded(usable.select("_id", "_toxic")), "_id").groupBy("_lang", "_toxic").count()
    totals = {(r["_lang"], r["_toxic"]): r["count"] for r in every.collect()}
    left = usable.join(F.broadcast(seen), "_order", "left_anti").select("_id", "_toxic")
    scores = docs.join(bounded(left), "_id").select("_lang", "_toxic", scorer(spark, blob)(F.col("_text")).alias("_score"))
    bins = F.least(F.floor(F.col("_score") * BINS), F.lit(BINS - 1)).cast("int")
    met: dict = {}
    for row in scores.groupBy("_lang", "_toxic", bins.alias("bin")).count().collect():
        met.setdefault(row["_lang"], np.zeros((2, BINS)))[row["_toxic"], row["bin"]] += row["count"]
    pooled, levels = np.zeros((2, BINS)), {}
    for lang, counts in met.items():
        natural = counts * [[totals[lang, label] / max(1.0, counts[label].sum())] if counts[label].any() else [0.0] for label in (0, 1)]
        pooled += natural
        if lang is not None and counts.sum(axis=1).min() >= LEAST_ROWS:
            levels[lang] = best_cut(*natural)
    with np.load(io.BytesIO(blob), allow_pickle=False) as held:
        out = io.BytesIO()
        np.savez(out, **{name: held[name] for name in held.files}, langs=np.array(list(levels), dtype=str),
                 levels=np.array(list(levels.values()), dtype=float), pooled=best_cut(*pooled))
    return out.getvalue()


def scorer(spark: SparkSession, blob: bytes):
    """The score of a text as a column function."""
    held = spark.sparkContext.broadcast(blob)

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load(held.value)[0]
        cache = Words(model)
        for texts in batches:
            yield pd.Series([model.score(text, cache) for text in texts], dtype="float64")

    return toxic


def scored(df: DataFrame, blob: bytes | None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All columns of ``df`` with _score, _threshold, _flagged in front of none of them (names in use get an underscore).

    A null or empty text has no words; its score is what the bias terms give. Without a model every score is 0.
    """
    score, level, flag = (spare_name(df, name) for name in ("_score", "_threshold", "_flagged"))
    if blob is None:
        return df.withColumns({score: F.lit(0.0), level: F.lit(0.5), flag: F.lit(False)})
    _, levels, pooled = load(blob)
    bound = F.coalesce(*[F.when(F.col(lang_col) == lang, F.lit(cut)) for lang, cut in sorted(levels.items())],
                       F.lit(pooled))
    return df.withColumn(score, scorer(df.sparkSession, blob)(F.col(text_col))).withColumn(level, bound) \
        .withColumn(flag, F.col(score) >= F.col(level))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """Score and decision for every row of ``docs``, repeated rows included."""
    blob = learned(docs, labels, id_col, text_col, lang_col)
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return scored(thin, blob).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.col("_threshold").alias("threshold"),
        F.col("_flagged").alias("flagged"))


def clean_rows(df: DataFrame, blob: bytes | None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df``, whole, below their language's threshold."""
    out = scored(df, blob, text_col, lang_col)
    flag = next(c for c in reversed(out.columns) if c.lstrip("_") == "flagged")
    return out.filter(~F.col(flag)).select(*df.columns)
