"""Near-duplicate vectors by product quantisation over coarse inverted lists, with an exact rerank.

1. Coarse centroids and the codebooks of ``PARTS`` subspaces are fitted on a bounded sample (``SAMPLE`` vectors). Every
   vector is indexed: its nearest list, one code per subspace for the residual, and the length of what the codes miss.
2. Two vectors at most ``reach`` apart in different lists lie on different sides of the plane between the two centroids,
   and their distances from that plane add up to at most ``reach``. So one of them is within reach / 2 of the plane: every
   vector probes the lists whose plane is that near, and of each link at least one end probes the list of the other. These
   probes are sufficient, whatever the data. A link that only one end meets is counted there for both.
3. In a list, table look-ups give the distance from the prober to each coded vector. By the triangle inequality the
   real distance is less by at most what the codes miss; whatever cannot be near is dropped.
4. The rest is decided by the cosine in double precision.

Equal vectors form one class with a weight, so copies are not compared. Lists meet their probers in blocks of bounded
size: a list that holds a third of all vectors is many blocks. A block gives out counts and a spanning forest of its
links, and not the links.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from risklane.llm.common import stage
from risklane.llm.components import components, trees

# Fixed value: the least cosine of a link.
LEAST_COSINE = 0.95
# Most vectors that centroids and codebooks are fitted on.
SAMPLE = 16_384
PARTS, CODES = 8, 256
# Most members, and most probers, that meet in one task's block.
MEMBERS, PROBERS = 2_048, 4_096
STEPS = 8


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def centroids(points: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from points drawn by a fixed seed; empty cells keep their centre."""
    rng = np.random.default_rng(seed)
    found = points[rng.choice(len(points), min(count, len(points)), replace=False)].copy()
    for _ in range(STEPS):
        nearest = np.concatenate([distances(points[i:i + 4096], found).argmin(1) for i in range(0, len(points), 4096)])
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, points)
        sizes = np.bincount(nearest, minlength=len(found))
        found = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], found).astype(np.float32)
    return found


def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task over the bounded sample."""
    rows = pd.concat(list(batches), ignore_index=True)
    if len(rows):
        points = Units(rows.sort_values("_order", ignore_index=True)["v"]).folded(int(rows["_width"].iloc[0])).astype(np.float32)
        lists = centroids(points, int(np.clip(np.sqrt(rows["_n"].iloc[0]), 1, 1024)), 1)
        nearest = np.concatenate([distances(points[i:i + 4096], lists).argmin(1) for i in range(0, len(points), 4096)])
        rest = points - lists[nearest]
        books = [centroids(part, CODES, 2 + i) for i, part in enumerate(np.array_split(rest, min(PARTS, rest.shape[1]), axis=1))]
        out = io.BytesIO()
        np.savez(out, lists=lists, **{f"book{i}": book for i, book in enumerate(books)})
        yield pd.DataFrame({"index": [out.getvalue()]})


class Index:
    def __init__(self, blob: bytes) -> None:
        with np.load(io.BytesIO(blob), allow_pickle=False) as held:
            self.lists = held["lists"]
            self.books = [held[f"book{i}"] for i in range(len(held.files) - 1)]
        widths = [book.shape[1] for book in self.books]
        self.ends = np.cumsum(widths)
        self.starts = self.ends - widths
        self.width = self.lists.shape[1]
        self.between = np.sqrt(distances(self.lists, self.lists))

    def code(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, length of what the codes miss) of each point."""
        nearest = distances(points, self.lists).argmin(1)
        rest = points - self.lists[nearest]
        codes = np.stack([distances(rest[:, s:e], book).argmin(1) for s, e, book in zip(self.starts, self.ends, self.books)], 1)
        return nearest, codes.astype(np.uint8), np.linalg.norm(rest - self.decoded(codes), axis=1)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)

    def probes(self, points: np.ndarray, reach: float) -> np.ndarray:
        """Which lists are to be searched for partners of which point: those with a plane at most reach / 2 away."""
        far = distances(points, self.lists)
        own = far.argmin(1)
        return far - far[np.arange(len(points)), own][:, None] <= reach * self.between[own] + 1e-4

    def estimates(self, points: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
        """Distances from points to coded members of one list, by a table per point and subspace."""
        rest = points - self.lists[number]
        total = np.zeros((len(points), len(codes)), np.float32)
        for i, (s, e, book) in enumerate(zip(self.starts, self.ends, self.books)):
            total += distances(rest[:, s:e], book).astype(np.float32)[:, codes[:, i]]
        return np.sqrt(np.maximum(total, 0))


class Units:
    """Vectors divided by their length in double precision, one table per number of components."""

    def __init__(self, column: pd.Series) -> None:
        vectors = column.to_numpy()
        self.lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
        self.places = np.zeros(len(vectors), np.int64)
        self.rows, self.tables = {}, {}
        for length in np.unique(self.lengths).tolist():
            at = np.flatnonzero(self.lengths == length)
            points = np.stack(vectors[at]).astype(np.float64)
            # First by a power of two near the greatest component, which is exact, so that no square over- or underflows.
            points = np.ldexp(points, -np.frexp(np.abs(points).max(axis=1))[1][:, None])
            self.places[at] = np.arange(len(at))
            self.rows[length], self.tables[length] = at, points / np.linalg.norm(points, axis=1)[:, None]

    def folded(self, width: int) -> np.ndarray:
        """One row of ``width`` numbers per vector: a shorter one is filled up with 0, a longer one is added up in strides.

        Sums of k components are divided by the square root of k, so no distance between vectors of one length grows, and
        what is near stays near. Vectors of ``width`` numbers stay as they are.
        """
        if list(self.tables) == [width]:
            return self.tables[width]
        out = np.zeros((len(self.lengths), width))
        for length, points in self.tables.items():
            strides = -(-length // width)
            padded = np.zeros((len(points), strides * width))
            padded[:, :length] = points
            added = strides - (np.arange(width) + (strides - 1) * width >= length)
            out[self.rows[length]] = padded.reshape(len(points), strides, width).sum(axis=1) / np.sqrt(np.maximum(added, 1))
        return out

    def linked(self, other: Units, r: np.ndarray, c: np.ndarray, least: float) -> np.ndarray:
        """Whether vectors r of this set and c of the other, pair by pair, have a cosine of at least ``least``; those of different lengths have none."""
        found = np.zeros(len(r), bool)
        for length in self.tables.keys() & other.tables.keys():
            at = np.flatnonzero((self.lengths[r] == length) & (other.lengths[c] == length))
            mine, theirs = self.tables[length][self.places[r[at]]], other.tables[length][other.places[c[at]]]
            found[at] = np.einsum("ij,ij->i", mine, theirs) >= least
        return found


def block(number: int, members: pd.DataFrame, probers: pd.DataFrame, index: Index, least: float) -> pd.DataFrame:
    """Per prober its weight of partners in the block, and per node of a link the root it hangs on.

    A member that does not probe the prober's list gets its share of the link here too.
    """
    reach = float(np.sqrt(2 - 2 * least))
    m_units, p_units = Units(members["v"]), Units(probers["point"])
    p = p_units.folded(index.width)
    codes = np.stack([np.frombuffer(c, np.uint8) for c in members["codes"]])
    missed = members["missed"].to_numpy()
    m_ids, p_ids, weights = members["id"].to_numpy(), probers["own"].to_numpy(), members["weight"].to_numpy()
    homes, p_weights = probers["home"].to_numpy(), probers["p_weight"].to_numpy()
    asks = np.unpackbits(np.stack([np.frombuffer(a, np.uint8) for a in members["asks"]]), axis=1)
    counts, back, pairs = np.zeros(len(p_ids), np.int64), np.zeros(len(m_ids), np.int64), []
    for start in range(0, len(p), 512):
        part = p[start:start + 512]
        near = index.estimates(part.astype(np.float32), number, codes) - missed[None, :] <= reach + 1e-3
        rows, columns = np.nonzero(near)
        different = p_ids[start + rows] != m_ids[columns]
        rows, columns = rows[different], columns[different]
        for at in range(0, len(rows), 1 << 16):
            r, c = rows[at:at + (1 << 16)], columns[at:at + (1 << 16)]
            linked = p_units.linked(m_units, start + r, c, least)
            r, c = start + r[linked], c[linked]
            np.add.at(counts, r, weights[c])
            alone = asks[c, homes[r]] == 0
            np.add.at(back, c[alone], p_weights[r[alone]])
            pairs.append(np.stack([r, c]))
    met = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    ids, sums = np.concatenate([p_ids, m_ids]), np.concatenate([counts, back])
    has = np.flatnonzero(sums)
    links = pd.DataFrame({"id": ids[has], "links": sums[has], "root": ids[has]})
    return pd.concat([links, trees(p_ids[met[0]], m_ids[met[1]]).assign(links=0)], ignore_index=True)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST_COSINE) -> DataFrame:
    """Links, component and decision for every row of ``df``, repeated rows included.

    A vector that is null, empty, zero, or holds a null or non-finite component is linked with nothing. Vectors of different
    lengths are not linked with each other; lengths are searched together, in an index as wide as the commonest one (of equally
    common lengths the greatest). Rows that repeat an id are separate vectors: copies of each other are links. Other columns of
    ``df``, labels too, are ignored.
    """
    spark = df.sparkSession
    # Components stay in single precision where the table has no more than that.
    single = df.select(vector_col).schema[0].dataType == T.ArrayType(T.FloatType())
    number = "float" if single else "double"
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(f"array<{number}>").alias("v"))
    sound = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                       & F.exists("v", lambda x: x != 0), F.lit(False))
    marked = rows.withColumn("key", F.when(sound, F.md5(F.array_join(F.transform(
        "v", lambda x: F.when(x == 0, F.lit(0.0).cast(number)).otherwise(x).cast("string")), ","))))
    # A class is numbered as it is written; components are named by their least id in the end.
    classes = stage(marked.filter("key is not null").groupBy("key").agg(
        F.first("v").alias("v"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least_id"))
        .withColumn("id", F.monotonically_increasing_id()), "vectors")
    usual = classes.groupBy(F.size("v").alias("n")).agg(F.sum("weight").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    total = classes.count()
    linked = None
    if total:
        # Keys are hashes, so the first ones are a random sample, the same in every run.
        made = stage(classes.select("v", F.col("key").alias("_order")).orderBy("_order").limit(SAMPLE)
                     .withColumn("_n", F.lit(total)).withColumn("_width", F.lit(usual["n"])).repartition(1).mapInPandas(fit, "index binary"), "index")
        linked = stage(_links(classes, spark.sparkContext.broadcast(made.first()["index"]), least), "links")
    if linked is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")) \
            .withColumn("kept", F.lit(True))
    counts = linked.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = classes.select("id", "least_id").join(roots, F.col("id") == F.col("node"))
    least_of = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    merged = named.join(least_of, "root").select("id", "component_id")
    found = classes.select("key", "id", "weight", "least_id").join(counts, "id", "left").join(merged, "id", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component_id", "least_id").alias("component_id"))
    return marked.select("vec_id", "key").join(found, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")) \
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, held, least: float) -> DataFrame:
    """(id, links, root): partial counts, and trees of linked classes."""
    reach = float(np.sqrt(2 - 2 * least))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(held.value)
        for batch in batches:
            points = Units(batch["v"]).folded(index.width).astype(np.float32)
            number, codes, missed = index.code(points)
            probed = index.probes(points, reach)
            yield pd.DataFrame({"id": batch["id"], "weight": batch["weight"], "v": batch["v"], "list": number,
                                "codes": [c.tobytes() for c in codes], "missed": missed,
                                "asks": [row.tobytes() for row in np.packbits(probed, axis=1)],
                                "probes": [np.flatnonzero(row).tolist() for row in probed]})

    kind = classes.schema["v"].dataType.simpleString()
    schema = f"id bigint, weight bigint, v {kind}, list int, codes binary, missed double, asks binary, probes array<int>"
    indexed = stage(classes.select("id", "weight", "v").mapInPandas(coded, schema), "coded")
    members = indexed.groupBy("list").agg(F.count(F.lit(1)).alias("members"))
    asked = indexed.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("probers"))
    # One row per list, of which there are at most 1024.
    sizes = F.broadcast(stage(members.join(asked, "list").select(
        "list", F.ceil(F.col("members") / MEMBERS).cast("int").alias("m_blocks"),
        F.ceil(F.col("probers") / PROBERS).cast("int").alias("p_blocks")), "lists"))
    left = indexed.drop("probes").join(sizes, "list").select(
        "list", F.pmod("id", "m_blocks").cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.col("p_blocks") - 1)).alias("p"),
        "id", "weight", "v", "codes", "missed", "asks")
    right = indexed.select(F.col("id").alias("own"), F.col("weight").alias("p_weight"), F.col("list").alias("home"),
                           F.col("v").alias("point"), F.explode("probes").alias("list")) \
        .join(sizes, "list").select(
            "list", F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1)).alias("m"),
            F.pmod("own", "p_blocks").cast("int").alias("p"), "own", "p_weight", "home", "point")
    state = {}

    def meet(key, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        if "index" not in state:
            state["index"] = Index(held.value)
        return block(int(key[0]), mine, theirs, state["index"], least)

    return left.groupBy("list", "m", "p").cogroup(right.groupBy("list", "m", "p")) \
        .applyInPandas(meet, "id bigint, links bigint, root bigint")
