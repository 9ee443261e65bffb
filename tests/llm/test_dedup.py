"""Near-duplicate texts and vectors against all pairs, and the connected components."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from risklane.llm import components, neardup, queries, vectors

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def roots_of(count, pairs):
    root = list(range(count))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(count)]


def shingle_set(text):
    words = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_texts(rows):
    sets = [shingle_set(text) for _, text in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    roots = roots_of(len(rows), pairs)
    out = []
    for i, (ident, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[i] and rows[j][0] is not None]
        least = min(group) if group else None
        out.append((ident, len(sets[i]), least, ident == least))
    return Counter(out)


def variants(seed):
    rng = random.Random(seed)
    rows = []
    for base in range(12):
        words = [f"b{base}w{rng.randrange(400)}" for _ in range(rng.choice([30, 60, 150]))]
        for copy in range(rng.choice([1, 2, 6])):
            own = list(words)
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10 ** 6)}"
            rows.append((len(rows) + 100, " ".join(own)))
    # A chain: every text is near the next one only.
    words = [f"c{i}" for i in range(100)]
    for step in range(8):
        rows.append((len(rows) + 100, " ".join(words[step * 6:] + [f"d{i}" for i in range(step * 6)])))
    # A family whose members are near its first text or not, and near each other or not.
    words = [f"f{i}" for i in range(80)]
    for copy in range(40):
        own = list(words)
        for _ in range(copy % 7):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10 ** 6)}"
        rows.append((len(rows) + 100, " ".join(own)))
    # A passage that many documents share.
    shared = " ".join(f"s{i}" for i in range(40))
    rows += [(len(rows) + 100 + k, shared + " " + " ".join(f"p{k}q{i}" for i in range(30))) for k in range(25)]
    rows += [(1, None), (2, ""), (3, " \n "), (4, "A b c"), (5, "a B\tc"), (6, "a b"), (7, "a b c d e"), (8, "A B C D E")]
    rows += [(None, "t u v w x y z"), (9, rows[0][1].upper()), (9, rows[0][1].upper())]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, members", [(1, 2048), (2, 8), (3, 3)])
def test_near_duplicates(spark, seed, members, monkeypatch):
    monkeypatch.setattr(neardup, "MEMBERS", members)
    monkeypatch.setattr(neardup, "SETS", max(2, members // 2))
    rows = variants(seed)
    df = spark.createDataFrame([(i, t, 5, "k") for i, t in rows], "doc_id bigint, text string, n_shingles int, key string").repartition(4)
    got = neardup.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    found = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect())
    assert found == Counter({(a, b, c, bool(d) if a is not None else c is None): n for (a, b, c, d), n in brute_texts(rows).items()})


def test_near_duplicates_empty(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert neardup.near_duplicates(empty).collect() == []
    blank = spark.createDataFrame([(1, None), (1, " ")], "doc_id bigint, text string")
    assert [tuple(r) for r in neardup.near_duplicates(blank).collect()] == [(1, 0, 1, True)] * 2


def test_near_duplicates_of_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in queries.op6_near_duplicates(spark, sf_dir).collect())
    assert got == brute_texts(rows)


def test_one_of_each(spark):
    rows = variants(4)
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id bigint, text string, _gone_id string")
    kept = neardup.one_of_each(df.withColumnRenamed("_gone_id", "kept"))
    assert kept.columns == ["doc_id", "text", "kept"]
    wanted = {i for (i, _, least, ok) in brute_texts(rows) if ok}
    assert {r.doc_id for r in kept.collect()} - {None} == wanted - {None}


def test_signatures_agree_as_sets_do():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 4000, dtype=np.uint64)
    for share in (0.5, 0.75, 0.9):
        union = int(2000 / share)
        agree = np.mean([
            (neardup.signature(np.unique(s[:2000])) == neardup.signature(np.unique(np.concatenate([s[:2000], s[2000:union]])))).mean()
            for s in (rng.permutation(base) for _ in range(60))])
        assert agree == pytest.approx(share, abs=0.04)


def test_misses_are_rare():
    """The chance that two sets of similarity 0.75 agree in fewer coordinates than asked."""
    n, t = neardup.COORDINATES, neardup.MATCHES
    assert sum(math.comb(n, k) * 0.75 ** k * 0.25 ** (n - k) for k in range(t)) < 5e-8


def test_tables_that_spark_sizes_too_low_are_not_broadcast(spark, tmp_path):
    classes = [(i, i, 20, bytes([i]), list(range(neardup.COORDINATES))) for i in range(6)]
    for name, rows, schema in (("classes", classes, "id long, least_id long, n_shingles long, key binary, sig array<int>"),
                               ("edges", [(i + 1, 0) for i in range(6)], "u long, v long")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    classes, edges = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("classes", "edges"))
    found = neardup.postings(classes)
    assert {r["id"]: r["count"] for r in found.groupBy("id").count().collect()} == {
        i: neardup.COORDINATES - neardup.MATCHES + 1 for i in range(6)}
    for df in (found, components._large_star(edges), components._small_star(edges)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    roots = roots_of(400, real)
    assert got == {n: roots[n] for pair in real for n in pair}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def vector_rows(seed, size=24):
    rng = np.random.default_rng(seed)
    rows = []
    for centre in rng.standard_normal((30, size)):
        for _ in range(int(rng.integers(1, 9))):
            rows.append((centre + rng.standard_normal(size) * rng.choice([0.02, 0.2, 0.3]) * 1.0).astype(np.float32).tolist())
    rows += [rows[0], rows[0], (np.array(rows[1]) * 7).astype(np.float32).tolist()]
    rows += [None, [], [0.0] * size, [1.0] * (size - 1) + [float("nan")], [1.0] * (size - 1) + [float("inf")],
             [1.0] * (size - 1) + [None], [1.0] * 3, [1.0] * 3]
    return [(1000 + i, v, "x") for i, v in enumerate(rows)] + [(None, rows[2], "y"), (1000, rows[3], "y")]


def brute_vectors(rows):
    ok = [v is not None and None not in v and all(map(math.isfinite, v)) and any(v) for _, v, _ in rows]
    scaled = [np.array(v, float) / max(map(abs, v)) if good else None for good, (_, v, _) in zip(ok, rows)]
    units = [v / np.linalg.norm(v) if good else None for good, v in zip(ok, scaled)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i)
             if ok[i] and ok[j] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.95]
    links = Counter(i for pair in pairs for i in pair)
    roots = roots_of(len(rows), pairs)
    out = []
    for i, (ident, _, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[i] and rows[j][0] is not None]
        least = min(group) if group else None
        out.append((ident, links[i], least, ident == least))
    return Counter(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_vectors(spark, seed, monkeypatch):
    monkeypatch.setattr(vectors, "MEMBERS", 16)
    monkeypatch.setattr(vectors, "PROBERS", 16)
    rows = vector_rows(seed)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, key string").repartition(3)
    assert Counter(tuple(r) for r in vectors.near_vectors(df).collect()) == brute_vectors(rows)


def test_near_vectors_of_every_length_in_doubles(spark, monkeypatch):
    """Near copies of 5, 24 and 61 numbers, and vectors far outside single precision."""
    monkeypatch.setattr(vectors, "MEMBERS", 16)
    rng = np.random.default_rng(4)
    rows = [v for v, in [(row[1],) for row in vector_rows(4)] if v is not None]
    for size in (5, 61):
        for centre in rng.standard_normal((12, size)):
            rows += [(centre + rng.standard_normal(size) * 0.2).tolist() for _ in range(3)]
    rows += [[1e-50] * 4, [1e-50] * 4, [1e300, -1e300, 0.0, 0.0], [2e300, -2e300, 1e299, 0.0], [5e-324, 0.0], [1e308, 0.0]]
    rows = [(i, v, "x") for i, v in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, key string").repartition(3)
    got = vectors.near_vectors(df).collect()
    assert Counter(tuple(r) for r in got) == brute_vectors(rows)
    assert [r.n_links for r in sorted(got, key=lambda r: r.vec_id)[-6:]] == [1] * 6


def test_near_vectors_of_the_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, "") for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op5_near_vectors(spark, sf_dir).collect()) == brute_vectors(rows)


def test_probes_find_the_links():
    """Share of the links, near the threshold, whose list is probed; brute force over 64 dimensions."""
    import pandas as pd
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((900, 64))
    points = np.concatenate([centres, centres + rng.standard_normal(centres.shape) * 0.3])
    points /= np.linalg.norm(points, axis=1)[:, None]
    sample = pd.DataFrame({"v": list(points), "_order": range(len(points)), "_n": len(points), "_width": 64})
    index = vectors.Index(next(vectors.fit(iter([sample])))["index"][0])
    number, _, _ = index.code(points.astype(np.float32))
    probed = index.probes(points.astype(np.float32), math.sqrt(0.1))
    a, b = np.nonzero(points @ points.T >= 0.95)
    other = a != b
    assert other.sum() > 500 and probed[a[other], number[b[other]]].mean() > 0.99


def narrow_rows(seed, count, size, effective):
    """Vectors whose spread, and that of their near copies, lies in a few directions of many."""
    rng = np.random.default_rng(seed)
    spread = np.zeros(size)
    spread[:effective] = 1
    spread[effective:] = 0.02
    points = rng.standard_normal((count, size)) * spread
    return np.concatenate([points, points + rng.standard_normal(points.shape) * spread * 0.25]).astype(np.float32)


@pytest.mark.parametrize("size, effective", [(384, 10), (768, 10)])
def test_near_vectors_of_low_effective_dimension(spark, size, effective):
    points = narrow_rows(8, 800, size, effective)
    units = points.astype(float) / np.linalg.norm(points.astype(float), axis=1)[:, None]
    near = units @ units.T >= 0.95
    np.fill_diagonal(near, False)
    assert near.sum() > 1000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r for r in vectors.near_vectors(df.repartition(3)).collect()}
    assert [got[i].n_links for i in range(len(points))] == near.sum(axis=1).tolist()
    roots = roots_of(len(points), list(zip(*np.nonzero(near))))
    least = {}
    for i, root in enumerate(roots[i] for i in range(len(points))):
        least.setdefault(root, i)
    assert [got[i].component_id for i in range(len(points))] == [least[roots[i]] for i in range(len(points))]


def test_near_vectors_without_any(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert vectors.near_vectors(spark.createDataFrame([], schema)).collect() == []
    none = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], schema)
    assert sorted(tuple(r) for r in vectors.near_vectors(none).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    one = spark.createDataFrame([(3, [1.0, 2.0])], schema)
    assert [tuple(r) for r in vectors.near_vectors(one).collect()] == [(3, 0, 3, True)]
