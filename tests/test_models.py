import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from risklane.operators import boosting as B, calibration, forest as I, neighbours as N, oversample as O
from risklane.operators.shaping import hash_sample

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 3))
    y = ((x[:, 0] > 0.8) & (x[:, 1] > 0)) | (x[:, 2] > 2.2)
    data = [(int(i), int(y[i]), [float(v) for v in x[i]]) for i in range(len(x))]
    df = spark.createDataFrame(data, "TransactionID long, isFraud int, x array<double>")
    return df.select("TransactionID", "isFraud", array_to_vector("x").alias("features")).cache()


@pytest.fixture(scope="module")
def booster(rows):
    return B.fit(rows.filter("TransactionID % 4 > 0"), rows.filter("TransactionID % 4 = 0"), rounds=12, least_weight=2.0)


def margins_of(rows, booster):
    found = {r["TransactionID"]: r["x"] for r in rows.select("TransactionID", vector_to_array("features").alias("x")).collect()}
    return dict(zip(found, booster.margins(np.array(list(found.values())))))


def test_patience_keeps_the_best_round(spark):
    """Noise: no round helps the validation rows for long, and what is kept is where their AUC was best."""
    rng = np.random.default_rng(4)
    x = rng.random((800, 2))
    y = (rng.random(800) < 0.3 + 0.4 * (x[:, 0] > 0.5)).astype(int)
    df = spark.createDataFrame([(i, int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))],
                               "TransactionID long, isFraud int, x array<double>")
    df = df.select("TransactionID", "isFraud", array_to_vector("x").alias("features")).cache()
    train, val = df.filter("TransactionID % 4 > 0"), df.filter("TransactionID % 4 = 0")
    long, short = (B.fit(train, val, rounds=40, patience=n, abreast=2, least_weight=1.0, least_gain=0.0) for n in (0, 8))
    held = [i for i in range(800) if i % 4 == 0]

    def auc(trees):
        scores = B.sigmoid(long.head(trees).margins(x[held]))
        steps = np.minimum((scores * B.AUC_STEPS).astype(int), B.AUC_STEPS - 1)
        return B.auc_of(np.stack([np.bincount(steps[y[held] == label], minlength=B.AUC_STEPS) for label in (0, 1)]))

    seen = {trees: auc(trees) for trees in range(2, long.trees + 1, 2)}
    assert seen[long.trees] == max(seen.values())
    best, end = 0, None
    for trees, value in seen.items():
        best = trees if not best or value > seen[best] else best
        if trees - best >= 8:
            break
    assert short.trees == best
    assert short.value.tolist() == long.head(short.trees).value.tolist()


def test_fit_does_not_depend_on_partitioning(rows):
    train, val = rows.filter("TransactionID % 4 > 0"), rows.filter("TransactionID % 4 = 0")
    first = B.fit(train, val, rounds=8, least_weight=2.0)
    second = B.fit(train.repartition(7), val.repartition(3), rounds=8, least_weight=2.0, block=50)
    assert all(np.array_equal(getattr(first, name), getattr(second, name)) for name in ("roots", *B.NODE))


def test_only_the_smaller_child_is_counted(spark):
    """Counted are a tree's own columns and, of two children, the one with fewer rows; the other one follows from the parent."""
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 20, (700, 3)), rng.integers(0, 2, 700)
    df = spark.createDataFrame([(int(b), [float(v) for v in a]) for a, b in zip(x, y)], "isFraud int, x array<double>")
    df = df.select("isFraud", array_to_vector("x").alias("features")).repartition(3)
    edges = [np.arange(20.0)] * 3
    fitter = B.Fitter(B.blocks(df, df.limit(0), edges, 100), 3, 0.0, 1.0)
    sample = fitter.sample()
    fitter.add([], [1, 2])
    trees = [B.Growing([[-1, 0, -1, 0.0, 0.0, 0.0]], [0], np.array(columns, bool)) for columns in ([1, 1, 0], [1, 1, 1])]
    roots, _ = fitter.sums(trees, True)
    for tree, root, cut in zip(trees, roots, (3, 15)):
        tree.parents = root[None]
        B.split_open(tree, [(1.0, 0, cut, root[0, :cut + 1].sum(axis=0), root[0, cut + 1:].sum(axis=0))], 0.1, 1.0, 0.1)
        tree.halve(sample)
    assert [tree.asked() for tree in trees] == [[1], [2]]
    found, _ = fitter.sums(trees, False)
    fitter.close()
    for tree, sums, cut in zip(trees, found, (3, 15)):
        for node, side in zip(tree.full(sums[None]), (x[:, 0] <= cut, x[:, 0] > cut)):
            for feature in range(3):
                for weight, values in enumerate(((0.5 - y[side]) * B.GRAIN, np.full(side.sum(), B.GRAIN / 4))):
                    expected = np.bincount(x[side, feature], values, minlength=B.BINS) * tree.columns[feature]
                    assert node[feature, :, weight].tolist() == expected.tolist()


@pytest.mark.parametrize("l1, l2, least_gain", [(0.0, 0.0, 0.0), (0.5, 1.0, 0.0), (0.1, 3.0, 6.0)])
def test_first_tree_against_brute_force(spark, rows, l1, l2, least_gain):
    """One tree of depth two on all rows and columns, every split tried."""
    data = rows.select("isFraud", vector_to_array("features").alias("x")).collect()
    x, y = np.array([r["x"] for r in data]), np.array([r["isFraud"] for r in data])
    edges = B.bin_edges(rows, 3)
    got = B.fit(rows, rows, rounds=1, depth=2, row_share=1.0, column_share=1.0, least_weight=3.0, least_gain=least_gain, l1=l1, l2=l2, abreast=1)

    def worth(part):
        g = (0.5 - y[part]).sum()
        return max(abs(g) - l1, 0) ** 2 / (part.sum() / 4 + l2)

    def value(part):
        g = (0.5 - y[part]).sum()
        return -np.sign(g) * max(abs(g) - l1, 0) / (part.sum() / 4 + l2) * B.STEP

    def grow(part, depth):
        best = (max(least_gain, 1e-6), None)
        for f in range(3) if depth else ():
            for cut in edges[f]:
                left, right = part & (x[:, f] <= cut), part & (x[:, f] > cut)
                if min(left.sum(), right.sum()) / 4 >= 3.0:
                    gain = worth(left) + worth(right) - worth(part)
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
        if best[1] is None:
            return np.where(part, value(part), 0.0)
        return sum(grow(side, depth - 1) for side in best[1])

    expected = grow(np.ones(len(y), bool), 2)
    assert got.margins(x) == pytest.approx(expected, abs=1e-6)


def test_attributions_add_up(rows, booster):
    margins = margins_of(rows, booster)
    parts = B.attribute(booster, rows).collect()
    assert len(parts) == len(margins)
    for r in parts:
        assert r["base"] + sum(r["values"]) == pytest.approx(margins[r["TransactionID"]], abs=1e-9)


def random_booster(trees, depth, features, seed):
    """Trees that split at random, with repeated features along a path."""
    rng = np.random.default_rng(seed)
    model = B.empty(0.25, features)
    for _ in range(trees):
        nodes, open_nodes = [[-1, 0.0, -1, 0.0, 1000.0, 0.0]], [(0, 0)]
        while open_nodes:
            at, level = open_nodes.pop()
            if level == depth or rng.random() < 0.15:
                nodes[at][3] = float(rng.normal())
                continue
            share = rng.uniform(0.1, 0.9)
            nodes[at][:3] = [int(rng.integers(features)), float(rng.normal()), len(nodes)]
            for part in (share, 1 - share):
                open_nodes.append((len(nodes), level + 1))
                nodes.append([-1, 0.0, -1, 0.0, nodes[at][4] * part, 0.0])
        model = B.grown(model, nodes)
    return model


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_attributions_are_shapley_values(depth):
    """Against the average over all orders of arrival; absent features follow the training shares."""
    from itertools import combinations
    from math import factorial
    features = 4
    model = random_booster(3, depth, features, depth)
    x = np.random.default_rng(1).normal(size=(5, features))

    def worth(node, row, present):
        feature = model.feature[node]
        if feature < 0:
            return model.value[node]
        left = model.left[node]
        if feature in present:
            return worth(left + int(row[feature] > model.cut[node]), row, present)
        return sum(worth(child, row, present) * model.cover[child] / model.cover[node] for child in (left, left + 1))

    got = B.contributions(model, x)
    for i, row in enumerate(x):
        for j in range(features):
            others = [f for f in range(features) if f != j]
            total = 0.0
            for size in range(features):
                weight = factorial(size) * factorial(features - 1 - size) / factorial(features)
                for present in combinations(others, size):
                    total += weight * sum(worth(root, row, {*present, j}) - worth(root, row, set(present)) for root in model.roots)
            assert got[i, j] == pytest.approx(total, abs=1e-10)


def test_margins_and_attributions_of_many_rows_are_those_of_few():
    """Tests are evaluated once for many rows and the pieces of a tree looked up by their outcomes."""
    model = random_booster(6, 7, 9, 11)
    x = np.random.default_rng(3).normal(size=(B.FEW + 5, 9))
    few = slice(0, 40)
    assert np.array_equal(model.margins(x)[few], model.margins(x[few]))
    for root in model.roots:
        found = B.pieces(model, int(root))
        leaves = [n for _, nodes in found for n in nodes if model.feature[n] < 0]
        end = next((r for r in model.roots if r > root), len(model.feature))
        assert sorted(leaves) == [n for n in range(root, end) if model.feature[n] < 0]
        assert all(len(tests) <= B.TESTS for tests, _ in found)
        whole = B.worths(model, int(root), set(range(root, end)), {n: x[few, model.feature[n]] > model.cut[n] for n in range(root, end)},
                         40, *((p + s) / 2 for p, s in zip(np.polynomial.legendre.leggauss(4), (1, 0))))
        alone = B.Booster(np.array([root]), *[getattr(model, name) for name in B.NODE], model.margin, model.features)
        got = B.contributions(alone, x)[few]
        for feature in range(9):
            assert got[:, feature] == pytest.approx(whole.get(feature, np.zeros(40)), abs=1e-12)


def test_forest_paths_against_a_walk_of_each_row():
    rng = np.random.default_rng(8)
    trees = [I.grow(rng.normal(size=(n, 4)), rng) for n in (64, 3, 1)]
    tables = [np.full((3, 1 + max(n[0] for tree in trees for n in tree)), -1, kind) for kind in (np.int32, float, np.int32, np.int32, float)]
    for i, tree in enumerate(trees):
        for node, *fields in tree:
            for table, value in zip(tables, fields):
                table[i, node] = value
    assert I.depths(tables[0], tables[2]).tolist()[2] == 0
    x = rng.normal(size=(I.TOGETHER + 9, 4))
    got = I.path_scores(tuple(tables), 64, x)
    for i in (0, 5, I.TOGETHER, len(x) - 1):
        total = 0.0
        for feature, threshold, left, right, path in zip(*tables):
            at = 0
            while feature[at] >= 0:
                at = left[at] if x[i, feature[at]] <= threshold[at] else right[at]
            total += path[at]
        assert got[i] == pytest.approx(2.0 ** (-total / 3 / float(I.mean_path(64))))


def test_attributions_of_a_long_booster_add_up():
    model = random_booster(320, 6, 12, 7)
    x = np.random.default_rng(2).normal(size=(50, 12))
    assert B.base_value(model) + B.contributions(model, x).sum(axis=1) == pytest.approx(model.margins(x), abs=1e-9)
    held = sum(getattr(model, name).nbytes for name in ("roots", *B.NODE))
    assert held < 100 * len(model.feature)


def test_scores_and_importance(rows, booster):
    scored = B.score(booster, rows).collect()
    assert all(0 <= r["score_raw"] <= 1 for r in scored)
    table = B.top_features(B.importance(booster, NAMES, rows), 2).collect()
    assert len(table) == 2 and table[0]["importance"] >= table[1]["importance"] > 0
    assert sum(r["importance"] for r in B.importance(booster, NAMES, rows).collect()) == pytest.approx(1)
    named = B.attribute(booster, rows).select(F.explode(B.named(F.col("values"), NAMES)).alias("d")).select("d.feature")
    assert named.distinct().count() == 3
    best = B.top_contributions(B.attribute(booster, rows), NAMES, 2)
    assert best.columns == ["TransactionID", "feature", "feature_val", "shap_value", "direction"]
    values = {(r["TransactionID"]): (r["values"], r["x"]) for r in B.attribute(booster, rows).collect()}
    for r in best.collect():
        parts, x = values[r["TransactionID"]]
        i = NAMES.index(r["feature"])
        assert (r["shap_value"], r["feature_val"]) == (parts[i], x[i])
        assert sum(abs(p) > abs(parts[i]) for p in parts) <= 1
        assert r["direction"].startswith("↑" if parts[i] > 0 else "↓")
    assert B.mean_contribution(B.attribute(booster, rows), NAMES).count() == 3


def test_calibration_is_monotone_and_bounded(spark, rows, booster):
    scored = B.score(booster, rows).drop("features")
    got = calibration.apply(calibration.fit(scored), scored).orderBy("score_raw").collect()
    values = [r["score_cal"] for r in got]
    assert values == sorted(values) and 0 <= values[0] and values[-1] <= 1
    beyond = spark.createDataFrame([(-5.0,), (9.0,)], "score_raw double")
    ends = [r["score_cal"] for r in calibration.apply(calibration.fit(scored), beyond).collect()]
    assert ends == [values[0], values[-1]]


@pytest.mark.parametrize("block_rows", [5000, 40, 9])
def test_neighbours_are_exact(spark, block_rows):
    rng = np.random.default_rng(9)
    # A dense clump, a spread cloud, and copies of one point.
    x = np.vstack([rng.normal(0, 0.05, (120, 3)), rng.normal(3, 2, (90, 3)), np.repeat([[7.0, 7.0, 7.0]], 25, axis=0)])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")
    got = {}
    for r in N.neighbours(df, 5, block_rows).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["other"], r["distance"]))
    gaps = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(gaps, np.inf)
    for i in range(len(x)):
        best = sorted(range(len(x)), key=lambda j: (gaps[i, j], j))[:5]
        assert [d for _, d in got[i]] == pytest.approx([gaps[i, j] for j in best])
        assert [o for o, _ in got[i]] == best


@pytest.mark.parametrize("scale", [1.0, 1e8, np.inf])
def test_pairs_out_of_reach_are_not_measured(scale):
    """Nearly equal rows far from the origin, copies, and a row without a distance: the pairs kept hold the nearest, and are few."""
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(200, 4)) + (scale if np.isfinite(scale) else 0), rng.normal(size=(1, 4)) * scale])
    x[100:120] = x[:20]
    table = pd.DataFrame({"id": np.arange(len(x)), "x": list(x)})
    with np.errstate(invalid="ignore"):
        gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(gaps, np.inf)
    near = [sorted((gaps[i, j], j) for j in range(len(x)) if np.isfinite(gaps[i, j]))[:3] for i in range(len(x))]
    with np.errstate(invalid="ignore"):
        found = N.nearest(table, table, 3).sort_values(["id", "distance", "other"])
        again = N.nearest(table.assign(bound=[n[-1][0] if n else np.nan for n in near]), table, 3).sort_values(["id", "distance", "other"])
    for got in (found, again):
        assert list(zip(got["id"], got["distance"], got["other"])) == [(i, d, j) for i, n in enumerate(near) for d, j in n]
    if scale == 1.0:
        ids = table["id"].to_numpy()
        assert sum(len(row) for row, _ in N.candidates(x, x, ids, ids, np.full(len(x), np.inf), 3)) < 5 * len(x)


def test_oversampling(spark, rows):
    features = {r["TransactionID"]: np.array(r["x"]) for r in rows.select("TransactionID", vector_to_array("features").alias("x")).collect()}
    sizes = {r["isFraud"]: r["count"] for r in rows.groupBy("isFraud").count().collect()}
    balanced = O.balance(rows)
    assert {r["count"] for r in balanced.groupBy("isFraud").count().collect()} == {max(sizes.values())}
    new = O.synthetic(rows).withColumn("x", vector_to_array("features")).collect()
    assert len(new) == max(sizes.values()) - min(sizes.values())
    points = rows.filter("isFraud = 1").select(F.col("TransactionID").alias("id"), vector_to_array("features").alias("x"))
    near = {(r["id"], r["other"]) for r in N.neighbours(points, 5).collect()}
    uses = {}
    for r in new:
        assert (r["base"], r["other"]) in near and 0 <= r["share"] < 1
        expected = features[r["base"]] + r["share"] * (features[r["other"]] - features[r["base"]])
        assert np.allclose(r["x"], expected)
        uses[r["base"]] = uses.get(r["base"], 0) + 1
    assert max(uses.values()) - min(uses.values()) <= 1


def test_oversampling_does_not_depend_on_partitioning(spark, rows):
    columns = ["base", "other", "share"]
    first = sorted(map(tuple, O.synthetic(rows.repartition(2)).select(*columns).collect()))
    second = sorted(map(tuple, O.synthetic(rows.repartition(7), block_rows=11, limit=5).select(*columns).collect()))
    assert first == second


def test_forest_flags_the_far_rows(spark, rows):
    odd = spark.createDataFrame([(10_000 + i, 1, [9.0 + i, -9.0, 9.0]) for i in range(5)],
                                "TransactionID long, isFraud int, x array<double>")
    df = rows.unionByName(odd.select("TransactionID", "isFraud", array_to_vector("x").alias("features")))
    forest = I.fit(df, trees=60, tree_rows=64)
    got = {r["TransactionID"]: r for r in I.scores(forest, df).collect()}
    assert all(0 <= r["iso_score"] <= 1 for r in got.values())
    flagged = sum(r["iso_flag"] for r in got.values())
    assert flagged == pytest.approx(0.035 * len(got), abs=2)
    assert all(got[10_000 + i]["iso_flag"] == 1 for i in range(5))
    again = {r["TransactionID"]: r["iso_score"] for r in I.scores(I.fit(df.repartition(9), trees=60, tree_rows=64), df).collect()}
    assert all(again[k] == pytest.approx(v["iso_score"]) for k, v in got.items())
    by_batch = [r["iso_score"] for r in I.scores(forest, rows.limit(50), by_batch=True).collect()]
    assert min(by_batch) == 0 and max(by_batch) == pytest.approx(1)


def test_path_length_constant():
    assert I.mean_path(1) == 0 and I.mean_path(2) == 1
    assert float(I.mean_path(256)) == pytest.approx(10.2447, abs=1e-3)


def test_hash_sample(spark):
    df = spark.range(5000).withColumnRenamed("id", "TransactionID")
    first = {r[0] for r in hash_sample(df, 300).collect()}
    assert len(first) == 300
    assert first == {r[0] for r in hash_sample(df.repartition(11), 300).collect()}
    assert first != {r[0] for r in hash_sample(df, 300, seed=1).collect()}
    assert hash_sample(df, 9000).count() == 5000


def test_blocks_are_filled_across_batches(spark):
    """Blocks hold as many rows as asked for, though Spark hands rows over in batches of 10,000, and no row is lost."""
    rows = spark.range(0, 25_000, 1, 1).select(F.col("id").alias("TransactionID"), (F.col("id") % 7 == 0).cast("int").alias("isFraud"),
                                               (F.col("id") % 60).cast("double").alias("a"))
    rows = B.assemble(rows, ["a"])
    cut = [np.arange(59.0)]
    found = B.blocks(rows, rows.limit(0), cut, block=12_000).collect()
    assert sorted(len(row["label"]) for row in found) == [1000, 12_000, 12_000]
    bins = np.concatenate([np.frombuffer(row["bins"], np.uint8) for row in found])
    assert np.array_equal(np.bincount(bins), np.bincount(np.arange(25_000) % 60))
    assert sum(np.frombuffer(row["label"], np.uint8).sum() for row in found) == len(range(0, 25_000, 7))


def test_blocks_are_dealt_evenly_and_a_lost_round_comes_back(spark, tmp_path):
    """Every task has as many blocks as any other, whatever files they come from; rounds that executors lost are computed again."""
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 20, (1300, 2)), rng.integers(0, 2, 1300)
    df = spark.createDataFrame([(int(b), [float(v) for v in a]) for a, b in zip(x, y)], "isFraud int, x array<double>")
    df = df.select("isFraud", array_to_vector("x").alias("features")).coalesce(1)
    blocks = B.blocks(df, df.limit(0), [np.arange(20.0)] * 2, 50)
    blocks.write.parquet(f"{tmp_path}/blocks")
    blocks.limit(9).coalesce(1).write.mode("append").parquet(f"{tmp_path}/blocks")
    fitter = B.Fitter(spark.read.parquet(f"{tmp_path}/blocks"), 2, 0.0, 0.7)
    sizes = fitter.blocks.glom().map(len).collect()
    assert sum(sizes) == 26 + 9 and max(sizes) - min(sizes) <= 1
    assert len(sizes) == spark.sparkContext.defaultParallelism

    leaf = [-1, 0, -1, 0.25, 1.0, 0.0]
    tree = [[0, 9, 1, 0.0, 2.0, 1.0], leaf, [-1, 0, -1, -0.5, 1.0, 0.0]]
    fitter.add([], [1, 2])
    for number in range(B.REBASE + 2):          # beyond a checkpoint
        fitter.add([tree], [number, 100 + number])
        if number % 5 == 0:
            fitter.sums([B.Growing([list(leaf)], [0], np.ones(2, bool)) for _ in range(2)], True)
    roots = [B.Growing([list(leaf)], [0], np.ones(2, bool)) for _ in range(2)]
    found, _ = fitter.sums(roots, True)
    for rdd in (fitter.blocks, fitter.state):
        rdd.unpersist(True)
    again, _ = fitter.sums(roots, True)
    fitter.close()
    assert found.any() and np.array_equal(found, again)
