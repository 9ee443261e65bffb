"""Near-duplicate texts by an inverted join over the coordinates of MinHash signatures.

1. A text becomes its set of word 5-shingles (64-bit hashes), and the set a signature of ``COORDINATES`` minima. Equal
   sets form one class, so exact copies never meet each other.
2. A class is posted under its (coordinate, value) pairs. Two sets of similarity 0.75 agree in 48 of 64 coordinates on
   average; a pair must agree in ``MATCHES``. Fewer agree with a probability of 3e-8 at the threshold itself, and less
   above it. Two texts that share a passage and are 0.25 alike agree in so many with one of 4e-4. Prefix: of two signatures that agree in at least t places, those parts share a pair that remain when
   each leaves out its t - 1 most frequent pairs; so a class is posted under its rarest pairs only. Pairs that one class alone has
   are not posted at all. Skip: the long lists left out are never merged; their collisions are counted by comparing
   the two signatures in place, and pairs below the threshold go no further.
3. Links are confirmed on the full sets, recomputed from the texts of the classes that are in question.
4. Every list first compares its members with its least one (a hub). Members that then belong to one component need no
   further comparison. Where a hub's lists still hold several components, their members meet in blocks of bounded size: first
   by signature, which says who may have a partner in another component, and then those few by full set. A block
   gives out members and trees of links, never pairs. So a group of near copies costs about one comparison
   a member, and no link between different components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from risklane.llm.common import TEXT_BATCH, shuffled, stage
from risklane.llm.components import components, trees

# Words in a shingle, and the least similarity of a link as a percentage.
SHINGLE_WORDS = 5
LEAST_PERCENT = 75
COORDINATES = 64
MATCHES = 28
# Shingles that go through the hash functions at once.
BLOCK = 1 << 15
# Most members of a family that meet in one block, by signature and by full set.
MEMBERS, SETS = 2_048, 256
# Rows of small families that a task takes at once.
TOGETHER = 8_192

_rng = np.random.default_rng(20)
SCALES = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
MIXERS = _rng.integers(1, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; A-Z count as a-z."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = len(words) - size + 1
    mixed = np.zeros(count, np.uint64)
    for i in range(size):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * MIXERS[i] + hashes[i:i + count]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed * MIXERS[0])


def signature(found: np.ndarray) -> np.ndarray:
    """Least value of every hash function over a set that is not empty."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), BLOCK):
        least = np.minimum(least, (found[start:start + BLOCK, None] * SCALES + SHIFTS).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sizes, keys, signatures = [], [], []
        for text in batch["text"]:
            found = shingles(text)
            sizes.append(len(found))
            keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            signatures.append(signature(found) if len(found) else None)
        yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": sizes, "key": keys, "sig": signatures})


def full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingles(text) for text in batch["text"]]
        yield pd.DataFrame({"key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                            "set": [s.tobytes() for s in sets]})


def confirmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose whole sets are similar enough, in integers."""
    for batch in batches:
        keep = []
        for left, right in zip(batch["set_a"], batch["set_b"]):
            a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * common >= LEAST_PERCENT * (len(a) + len(b) - common))
        yield batch.loc[keep, ["a", "b"]]


def agreeing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, one: n + one)


def near_sizes(a: Column, b: Column) -> Column:
    """Sets of a similarity cannot differ more than this in size."""
    return (100 * F.least(a, b)) >= (LEAST_PERCENT * F.greatest(a, b))


def postings(classes: DataFrame) -> DataFrame:
    """(token, id, least_id, n_shingles, sig): the rarest shared coordinate-value pairs of each class."""
    tokens = classes.select("id", F.posexplode("sig").alias("at", "value")) \
        .select("id", F.xxhash64("at", "value").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("docs")).filter("docs > 1")
    # A signature has COORDINATES pairs; all but its MATCHES - 1 most frequent ones are the prefix. The pairs that
    # only one class has are the rarest of all: of n shared pairs the n - (MATCHES - 1) rarest are in the prefix.
    lists = tokens.join(shuffled(shared), "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("docs", "token"))).alias("l")) \
        .filter(F.size("l") >= MATCHES) \
        .select("id", F.explode(F.expr(f"slice(l, 1, size(l) - {MATCHES - 1})")["token"]).alias("token"))
    return lists.join(shuffled(classes.select("id", "least_id", "n_shingles", "sig")), "id")


def full_sets_of(ids: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, set) of the classes in ``ids``, from their texts."""
    wanted = stage(ids.join(classes.select("id", "key", "least_id"), "id"), "wanted")
    texts = docs.join(wanted.select("least_id").distinct(), F.col("doc_id").eqNullSafe(F.col("least_id")), "left_semi")
    return stage(texts.mapInPandas(full_sets, "key binary, set binary").join(wanted.select("id", "key"), "key")
                 .select("id", "set").dropDuplicates(["id"]), "sets", TEXT_BATCH)


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are links on their full sets."""
    both = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = full_sets_of(both, docs, classes)
    return pairs.join(shuffled(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))), "a") \
        .join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b") \
        .mapInPandas(confirmed, "a bigint, b bigint")


def likely(rows: pd.DataFrame, across: bool) -> pd.DataFrame:
    """Members of a block that may be linked with a member of another component, by their signatures."""
    left, right = (rows[rows["b"] == rows["i"]], rows[rows["b"] == rows["j"]]) if across else (rows, rows)
    found = []
    if len(left) and len(right):
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        a, b = (np.stack(side["sig"].to_numpy()) for side in (left, right))
        n, m = left["n_shingles"].to_numpy()[:, None], right["n_shingles"].to_numpy()[None, :]
        agree = np.zeros((len(a), len(b)), np.uint8)
        for k in range(COORDINATES):
            agree += a[:, k, None] == b[None, :, k]
        may = (agree >= MATCHES) & (left["root"].to_numpy()[:, None] != right["root"].to_numpy()[None, :])
        may &= 100 * np.minimum(n, m) >= LEAST_PERCENT * np.maximum(n, m)
        found = np.unique(np.concatenate([ids[may.any(axis=1)], others[may.any(axis=0)]]))
    return pd.DataFrame({"hub": rows["hub"].iloc[:1].repeat(len(found)).to_numpy(), "id": found}).astype("int64")


def linked(rows: pd.DataFrame, across: bool) -> pd.DataFrame:
    """Trees of the links between members of a block that are of different components, by their full sets."""
    left, right = (rows[rows["b"] == rows["i"]], rows[rows["b"] == rows["j"]]) if across else (rows, rows)
    ids, others = left["id"].to_numpy(), right["id"].to_numpy()
    roots, other_roots = left["root"].to_numpy(), right["root"].to_numpy()
    sets, other_sets = ([np.frombuffer(s, np.uint64) for s in side["set"]] for side in (left, right))
    a, b = [], []
    if len(sets) and len(other_sets):
        sizes = np.array([len(s) for s in other_sets])
        owner, values = np.repeat(np.arange(len(sizes)), sizes), np.concatenate(other_sets)
        order = np.argsort(values, kind="stable")
        owner, values = owner[order], values[order]
        for at, own in enumerate(sets):
            low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            hits = high - low
            place = np.repeat(low - (np.cumsum(hits) - hits), hits) + np.arange(hits.sum())
            common = np.bincount(owner[place], minlength=len(sizes))
            near = (100 * common >= LEAST_PERCENT * (len(own) + sizes - common)) & (other_roots != roots[at])
            b.append(others[near])
            a.append(np.full(near.sum(), ids[at]))
    none = [np.zeros(0, np.int64)]
    return trees(np.concatenate(a or none), np.concatenate(b or none))


def in_blocks(families: DataFrame, most: int, work, schema: str) -> DataFrame:
    """``work`` over families (rows of one ``hub``), those of more than ``most`` members block by block.

    A member of block b meets blocks j in the groups (min(b, j), max(b, j)). Small families share a group.
    """
    sizes = families.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("blocks"))
    groups = max(1, -(-families.count() // TOGETHER))
    rows = families.join(sizes, "hub").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumn("i", F.least("b", "other")).withColumn("j", F.greatest("b", "other")) \
        .withColumn("g", F.when(F.col("blocks") > 1, F.col("hub")).otherwise(F.pmod(F.xxhash64("hub"), F.lit(groups)) - groups)) \
        .drop("blocks", "other")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        across = bool(rows["i"].iloc[0] != rows["j"].iloc[0])
        rows = rows.sort_values("hub", kind="stable", ignore_index=True)
        cuts = np.flatnonzero(np.diff(rows["hub"].to_numpy())) + 1
        ends = [0, *cuts.tolist(), len(rows)]
        return pd.concat([work(rows.iloc[s:e], across) for s, e in zip(ends, ends[1:])], ignore_index=True)

    return rows.groupBy("g", "i", "j").applyInPandas(meet, schema)


def several_roots(families: DataFrame) -> DataFrame:
    """Rows of the families in which more than one component is left."""
    mixed = families.groupBy("hub").agg(F.min("root").alias("low"), F.max("root").alias("high")) \
        .filter("low <> high").select("hub")
    return families.join(mixed, "hub", "left_semi")


def class_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, root) of the classes that are linked with others."""
    posts = stage(postings(classes), "postings")
    hubs = posts.groupBy("token").agg(F.min(F.struct("least_id", "id", "n_shingles", "sig")).alias("hub"),
                                      F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members")
    near = near_sizes(F.col("n_shingles"), F.col("hub.n_shingles"))
    with_hub = stage(posts.join(shuffled(hubs), "token").filter(F.col("id") != F.col("hub.id")).select(
        F.col("hub.id").alias("hub"), "id", (near & (agreeing(F.col("sig"), F.col("hub.sig")) >= MATCHES)).alias("near"))
        .distinct(), "hubs")
    tested = with_hub.filter("near").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    links = stage(verified(tested, docs, classes), "links")
    roots = components(links)

    # What is left: the lists of a hub, put together as its family, that still hold several components.
    named = with_hub.select("hub", "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left") \
        .withColumn("root", F.coalesce("root", "id"))
    mixed = several_roots(named)
    families = stage(mixed.join(shuffled(classes.select("id", "n_shingles", "sig")), "id"), "families")
    asked = stage(in_blocks(families, MEMBERS, likely, "hub bigint, id bigint").distinct(), "likely")
    if asked.isEmpty():
        return roots
    sets = full_sets_of(asked.select("id").distinct(), docs, classes)
    exact = families.select("hub", "id", "root").join(shuffled(asked), ["hub", "id"], "left_semi").join(sets, "id")
    more = in_blocks(stage(exact, "families"), SETS, linked, "id bigint, root bigint")
    return components(links.unionByName(more.select(F.col("id").alias("a"), F.col("root").alias("b"))))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Set size, component and decision for every row of ``df``, repeated rows included.

    Null and blank texts have an empty set and are linked with nothing. Rows with equal ids and different texts are
    separate documents with one id; a null id is never the smallest. Extra columns of ``df`` are ignored.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = stage(docs.mapInPandas(sketches, "doc_id bigint, n_shingles bigint, key binary, sig array<int>"), "sketches", TEXT_BATCH)
    classes = stage(rows.filter("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
        .withColumn("id", F.monotonically_increasing_id()), "classes")
    roots = class_links(docs, classes)
    # Only classes with links are looked up by root; all others are components of their own.
    linked = classes.select("id", "least_id").join(roots.withColumnRenamed("node", "id"), "id")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    merged = linked.join(least, "root").select("id", "component_id")
    named = stage(classes.select("id", "key", "least_id").join(merged, "id", "left")
                  .select("key", F.coalesce("component_id", "least_id").alias("component_id")), "named")
    return rows.select("doc_id", "n_shingles", "key").join(named, "key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, whole, with one document of each component: the one of the smallest id.

    An id goes if no row of it is kept. Rows that repeat both id and text count once.
    """
    found = stage(near_duplicates(df, id_col, text_col), "decided")
    ids = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    gone = ids.filter("not kept").select(F.col("doc_id").alias("_gone_id"))
    left = df.join(gone, F.col(id_col).eqNullSafe(F.col("_gone_id")), "left_anti")
    return left if ids.filter("rows > 1").isEmpty() else left.dropDuplicates([id_col, text_col])
