"""Features, decisions, conversations, files and streams beyond what the SQL comparison covers."""

import glob
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from risklane.functions import dialogue, wording
from risklane.operators import conversations as C, decisions as D, encode, features as X, profile as P, routing as R
from risklane.plans import scoring, stream_queries, training as T
from risklane.plans.feature_queries import payments
from risklane.sources import files
from risklane.sources.views import view
from risklane.streaming import jobs, sources, velocity


def test_codes_of_unseen_and_missing(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,), ("B",)], "c string")
    codes = encode.fit_codes(train, ["c"])
    assert {(r["value"], r["code"]) for r in codes.collect()} == {("B", 0), ("__nan__", 1), ("a", 2), ("b", 3)}
    new = spark.createDataFrame([(1, "a"), (2, None), (3, "zz")], "id int, c string")
    assert sorted(tuple(r) for r in encode.apply_codes(new, codes, ["c"]).collect()) == [(1, 2), (2, 1), (3, -1)]


def test_serving_defaults(spark, sf_dir):
    train = payments(spark, sf_dir)
    fitted = X.fit(train)
    assert "sparse1" not in fitted.names and "isFraud" not in fitted.names
    lone = spark.createDataFrame([("t", -5, 12.5, 0.0)], "TransactionID string, card1 long, TransactionAmt double, addr1 double")
    row = X.serve(lone, fitted).first()
    assert (row["card1_velocity"], row["card1_amt_mean"], row["amt_deviation"]) == (1, 12.5, 0.0)
    assert (row["addr1"], row["addr1_nullflag"], row["addr2"], row["addr2_nullflag"]) == (0.0, 0, -1.0, 1)
    assert row["hour_raw"] == 0.0 and row["hour_cos"] == 1.0


def test_request_hour_is_shifted(spark):
    request = spark.createDataFrame([("r", "UPI", 10.0, "debit", "visa", "a.com", "mobile", 14, 7)],
                                    "request_id string, tx_type string, amount double, card_type string, network string, "
                                    "email string, device string, hour int, card_id long")
    row = X.time_and_amount(X.from_requests(request)).first()
    assert row["TransactionDT"] == 14 * 3600 + 9_000_000 and row["hour_raw"] == 18.0


def test_linear_route_against_numpy(spark, sf_dir):
    log = view(spark, sf_dir, "outcomes")
    stats = {(r["tx_type"], r["gateway"]): r for r in R.linear_statistics(log).collect()}
    rows = R.linear_route(log.select("step", "tx_type", "amt", "hour"), R.linear_statistics(log)).limit(80).collect()
    for r in rows:
        x = np.array([np.log1p(r["amt"]) / 10, np.sin(2 * np.pi * r["hour"] / 24), np.cos(2 * np.pi * r["hour"] / 24),
                      float(r["amt"] > 500), 1.0])
        scores = {}
        for g in R.GATEWAYS:
            s = stats[r["tx_type"], g]
            inverse = np.linalg.inv([[s[f"a{min(i, j)}{max(i, j)}"] for j in range(5)] for i in range(5)])
            scores[g] = inverse @ [s[f"b{i}"] for i in range(5)] @ x + 0.5 * np.sqrt(x @ inverse @ x)
        assert scores[r["routed_gateway"]] == pytest.approx(max(scores.values()))


def test_thompson_route_is_repeatable_and_prefers_good_arms(spark):
    arms = spark.createDataFrame([("UPI", "Razorpay", 900, 100), ("UPI", "PayU", 10, 90)], "tx_type string, gateway string, alpha int, beta int")
    df = spark.range(3000).select(F.col("id").alias("TransactionID"), F.lit("UPI").alias("tx_type"))
    first = {r[0]: r[2] for r in R.thompson_route(df, arms, gateways=R.GATEWAYS).collect()}
    assert first == {r[0]: r[2] for r in R.thompson_route(df.repartition(13), arms, gateways=R.GATEWAYS).collect()}
    share = {g: sum(v == g for v in first.values()) / len(first) for g in R.GATEWAYS}
    assert share["PayU"] == 0
    # Two untried arms have the flat prior: the chance that neither beats about 0.9 is near 0.81.
    assert share["Razorpay"] == pytest.approx(0.81, abs=0.03)


def test_explanations_without_drivers(spark):
    none = F.array().cast("array<struct<feature:string,value:double>>")
    row = spark.range(1).select(wording.fraud_explanation(
        F.lit("LEGITIMATE"), F.lit("LOW"), F.lit("ALLOW"), F.lit(0.0625), none).alias("t")).first()
    assert row["t"] == "Transaction appears legitimate. Fraud probability: 6.2% (below threshold). Recommended action: ALLOW."


def test_claims_and_topics(spark):
    turns = spark.createDataFrame([
        (1, 0, "user", "Which CARD type?"), (1, 1, "assistant", "About 9.0% fraud, or 3.5 % Fraud."), (1, 2, "user", "hello"),
        (1, 3, "user", "Tell me of the UPI route"), (1, 4, "user", "a lower bar")],
        "conv_id int, turn int, role string, text string")
    paid = spark.createDataFrame([(1,)] * 35 + [(0,)] * 965, "isFraud int")
    checked = {r["turn"]: r for r in C.check_claims(turns, paid).collect()}
    assert checked[1]["corrections"] == ["Fraud rate is 3.5%, not 9.0%."] and not checked[1]["verified"]
    assert checked[0]["verified"] and checked[1]["n_claims"] == 2
    asked = {r["turn"]: (r["intent"], r["topic"]) for r in C.questions(turns).collect()}
    assert asked == {0: ("data", "by_card_type"), 2: ("general", None), 3: ("routing", "gateway"), 4: ("whatif", None)}


def test_last_turns_limit_before_the_shuffle(spark, sf_dir):
    plan = C.latest(view(spark, sf_dir, "conversations"), ["conv_id"], "turn")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_scan_reads_only_what_is_asked(spark, sf_dir, tmp_path):
    path = str(tmp_path / "t")
    files.write_table(view(spark, sf_dir, "txn"), path)
    plan = files.read_columns(spark, path, ["card1", "cents"]).filter("cents > 100")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<cents:bigint,card1:bigint>" in plan and "GreaterThan(cents,100)" in plan


def test_narrow_types(spark):
    df = spark.createDataFrame([(-128, 200, 70000, 2**40, 1.5, None)], "a long, b long, c long, d long, e double, f long")
    kinds = {f.name: f.dataType.simpleString() for f in P.narrow(df).schema.fields}
    assert kinds == {"a": "tinyint", "b": "smallint", "c": "int", "d": "bigint", "e": "float", "f": "bigint"}


def test_training_chain(spark, sf_dir):
    """On one table from end to end; the split path of every ordered operator is forced."""
    txn = payments(spark, sf_dir)
    parts = T.prepare(txn, limit=100)
    assert sum(p.count() for p in (parts.train, parts.val, parts.test)) == txn.count()
    models = T.train(parts, rounds=5)
    runs = T.run_metrics(models, parts, "r1", "Staging")
    assert {r["metric"] for r in runs.collect()} == {
        *(f"{s}_{m}" for s in ("val", "test") for m in ("auc", "ap", "f1", "precision", "recall")), "threshold"}
    assert T.best_run(runs).first()["run_id"] == "r1"
    from risklane.operators import forest as I
    chain = scoring.Chain(parts.fitted, models, I.fit(parts.train, trees=20))
    raw = view(spark, sf_dir, "txn").withColumn("amount_text", F.when(F.col("TransactionID") == 3, "x?").otherwise("10.0"))
    got = scoring.score_payments(raw.drop("TransactionAmt", "isFraud"), chain, R.posterior(view(spark, sf_dir, "outcomes")),
                                 view(spark, sf_dir, "rates")).collect()
    assert len(got) == txn.count()
    bad = [r for r in got if r["error"]]
    assert [(r["transaction_id"], r["error"], r["fraud_decision"]) for r in bad] == [
        ("3", "could not convert string to float: 'x?'", None)]


SECOND_SESSION = """
import sys
from pyspark.sql import functions as F
from risklane.session import build_session
from risklane.operators import routing as R
from risklane.plans import saved, scoring
from risklane.plans.model_queries import with_amount_text
from risklane.sources.views import view
path, out, sf_dir, staged = sys.argv[1:]
spark = build_session("risklane-second", "local[2]", **{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false",
                                                        "spark.checkpoint.dir": staged})
chain = saved.load(spark, path)
scoring.score_payments(with_amount_text(view(spark, sf_dir, "txn")), chain, R.posterior(view(spark, sf_dir, "outcomes")),
                       view(spark, sf_dir, "rates")).write.parquet(out)
spark.stop()
"""


def test_saved_chain_in_a_second_session(spark, sf_dir, tmp_path):
    """Another process loads the chain and gives the same records; a folder that broke off is not loaded, nor one overwritten."""
    import os
    import subprocess
    import sys
    from pyspark.errors import AnalysisException
    from risklane.operators import forest as I
    from risklane.plans import saved
    from risklane.plans.model_queries import with_amount_text
    parts = T.prepare(payments(spark, sf_dir))
    chain = scoring.Chain(parts.fitted, T.train(parts, rounds=3, oversampled=False), I.fit(parts.train, trees=10))
    path, out = str(tmp_path / "chain"), str(tmp_path / "records")
    saved.save(chain, path, spark)
    expected = scoring.score_payments(with_amount_text(view(spark, sf_dir, "txn")), chain, R.posterior(view(spark, sf_dir, "outcomes")),
                                      view(spark, sf_dir, "rates"))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", SECOND_SESSION, path, out, sf_dir, str(tmp_path)], check=True, cwd=root, timeout=240)
    assert sorted(map(str, spark.read.parquet(out).select(expected.columns).collect())) == sorted(map(str, expected.collect()))
    with pytest.raises(AnalysisException):
        saved.save(chain, path, spark)
    with pytest.raises(AnalysisException):
        saved.load(spark, str(tmp_path / "none"))


def test_artifacts_keep_order_and_nulls(spark, tmp_path):
    from risklane.sources import files
    series = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.75), ("d", 0.1)], "feature string, importance double")
    files.write_series(series.repartition(3), str(tmp_path / "series"), "feature", "importance", 3)
    assert [tuple(r) for r in files.read_series(spark, str(tmp_path / "series")).orderBy("position").collect()] == [
        (0, "c", 0.75), (1, "a", 0.5), (2, "b", 0.5)]
    files.write_list(spark, ["z", 'a "quoted"', ""], str(tmp_path / "list"))
    assert files.read_list(spark, str(tmp_path / "list")) == ["z", 'a "quoted"', ""]
    row = spark.createDataFrame([(1, None, float("inf"), ["x"])], "a long, b double, c double, d array<string>")
    files.write_object(row, str(tmp_path / "object"))
    back = files.read_object(spark, str(tmp_path / "object"), "a long, b double, c double, d array<string>")
    assert back.collect() == row.collect()


def _feed(spark, sf_dir, folder, pieces):
    """Event files in time order, each written before the next."""
    events = view(spark, sf_dir, "events")
    bounds = events.approxQuantile("event_id", [i / pieces for i in range(pieces + 1)], 0)
    for i in range(pieces):
        top = F.col("event_id") <= bounds[i + 1] if i == pieces - 1 else F.col("event_id") < bounds[i + 1]
        events.filter((F.col("event_id") >= bounds[i]) & top).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("big, limit", [(4, 20), (256, 10**6)])
def test_velocity_stream_equals_batch(spark, sf_dir, tmp_path, monkeypatch, big, limit):
    """In two runs of several batches each; cards with over ``limit`` payments are split before the second run."""
    from risklane.operators.velocity import exact_velocity
    monkeypatch.setattr(velocity, "BIG", big)
    folder, more = str(tmp_path / "in"), str(tmp_path / "more")
    _feed(spark, sf_dir, more, 4)
    parts = sorted(glob.glob(f"{more}/*.parquet"), key=lambda path: spark.read.parquet(path).agg(F.min("event_id")).first()[0])
    os.makedirs(folder)
    runs = []
    for half in (parts[:2], parts[2:]):
        for path in half:
            copy = shutil.copy(path, folder)
            os.utime(copy, (parts.index(path) + 10**9,) * 2)        # files arrive in the order of their times
        stream = sources.payments(sources.event_stream(spark, folder, files_per_trigger=1))
        run = velocity.VelocityStream(stream, str(tmp_path / "state"), late="5 days", limit=limit)
        runs.append(run.run())
    assert sum(progress["numInputRows"] for query in runs for progress in query.recentProgress) == 1000
    batch = exact_velocity(view(spark, sf_dir, "txn")).orderBy("TransactionID").collect()
    assert [tuple(r) for r in run.output().orderBy("TransactionID").collect()] == [tuple(r) for r in batch]


class Spans(dict):
    """A map state in memory."""

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


def test_cards_share_keys_and_keep_their_own_state(spark, sf_dir, tmp_path, monkeypatch):
    """Far fewer keys than cards: what the state holds is packed and comes back, and the answers are those of the batch."""
    from risklane.operators.velocity import exact_velocity
    monkeypatch.setattr(velocity, "BUCKETS", 3)
    monkeypatch.setattr(velocity, "BIG", 2)
    folder, root = str(tmp_path / "in"), str(tmp_path / "state")
    events = view(spark, sf_dir, "events")
    for i in (0, 1):
        events.filter((F.col("event_id") >= 500) == bool(i)).write.mode("append").parquet(folder)
        run = velocity.VelocityStream(sources.payments(sources.event_stream(spark, folder)), root, late="1 hour")
        found = run.run().lastProgress["stateOperators"][0]
        assert found["numRowsTotal"] > 0
    got = {r["TransactionID"]: r for r in run.output().collect()}
    batch = exact_velocity(view(spark, sf_dir, "txn")).collect()
    assert len(got) == len(batch)
    for r in batch:
        assert got[r["TransactionID"]].asDict() == pytest.approx(r.asDict())
    cards = {(5, 0): (np.arange(10).reshape(2, 5), np.arange(9).reshape(3, 3)), (-7, 2): (np.ones((1, 5), np.int64), np.zeros((0, 3), np.int64))}
    again = velocity.unpacked(velocity.packed(cards))
    assert list(again) == list(cards)
    assert all(np.array_equal(a, b) for key in cards for a, b in zip(cards[key], again[key]))


@pytest.mark.parametrize("seed", range(6))
def test_card_state_against_all_payments(monkeypatch, seed):
    """Batches of payments in any order within the allowed lateness, with ties, folding as the watermark moves."""
    monkeypatch.setattr(velocity, "BIG", [2, 9, 1000][seed % 3])
    rng = np.random.default_rng(seed)
    spans, seen, ids = Spans(), np.zeros((0, 3), np.int64), iter(rng.permutation(5000).tolist())
    state = velocity.CardState(np.array([[velocity.OLD, 0, 0, 0, 0]], np.int64), np.zeros((0, 3), np.int64), 0, spans)
    for batch in range(25):
        newest, watermark = batch * 50_000, (batch - 1) * 50_000 - 3600
        size = int(rng.integers(1, 60))
        low, step = max(watermark, 0), int(rng.choice([1, 500]))
        time = low + rng.integers(0, newest + 50_000 - low, size) // step * step
        fresh = np.stack([time, [next(ids) for _ in range(size)], rng.integers(1, 10**7, size)], axis=1).astype(np.int64)
        seen = np.concatenate([seen, fresh])
        if len(fresh):
            state.keep(fresh)
        for at, ident, _ in fresh:
            prior = seen[(seen[:, 0] < at) | ((seen[:, 0] == at) & (seen[:, 1] < ident))][:, 2].astype(object)
            n, total, high, low = state.history(np.array([at]), np.array([ident]))[0].tolist()
            assert (n, total, high * int(velocity.PART) + low) == (len(prior), sum(prior), sum(prior * prior))
            for seconds in velocity.HORIZONS.values():
                older = seen[seen[:, 0] < at - seconds][:, 2]
                if at - seconds >= watermark - velocity.WEEK:
                    assert state.history(np.array([at - seconds]))[0].tolist()[:2] == [len(older), older.sum()]
        state.fold(watermark)
        state = velocity.CardState(state.totals, state.recent, 0, spans)
    assert len(state.recent) < len(seen) and state.totals[0, 1] > 0


def test_posterior_stream_in_several_batches(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "in")
    _feed(spark, sf_dir, folder, 3)
    log = sources.from_payments("outcomes", sources.payments(sources.event_stream(spark, folder, files_per_trigger=1)))
    out = str(tmp_path / "out")
    jobs.start(jobs.running_posterior(log), jobs.into(out), "update").awaitTermination()
    got = {(r["tx_type"], r["gateway"]): (r["alpha"], r["beta"]) for r in jobs.newest(spark, out, R.ARM).collect()}
    want = {(r["tx_type"], r["gateway"]): (r["alpha"], r["beta"]) for r in R.posterior(view(spark, sf_dir, "outcomes")).collect()}
    assert got == want


def test_streamed_payments_are_scored_on_every_core(spark, sf_dir, monkeypatch):
    """The events are one small file, which a stream reads in one task."""
    seen = []

    def scored(raw, *_):
        seen.append(raw.rdd.getNumPartitions())
        return raw.select("TransactionID")

    monkeypatch.setattr(stream_queries, "fitted_chain", lambda *_: None)
    monkeypatch.setattr(stream_queries.saved, "save", lambda *_: None)
    monkeypatch.setattr(stream_queries.saved, "load", lambda *_: None)
    monkeypatch.setattr(stream_queries.scoring, "score_payments", scored)
    found = stream_queries.stream_score_models(spark, sf_dir)
    assert found.count() == view(spark, sf_dir, "events").count()
    assert seen == [spark.sparkContext.defaultParallelism]


def test_streamed_decisions_equal_batch(spark, sf_dir):
    import __spark_entry__ as entry_point
    queries = entry_point.queries()
    batch, stream = (sorted(map(tuple, queries[name](spark, sf_dir).collect()), key=str)
                     for name in ("score_batch", "stream_score_models"))
    assert batch == stream


@pytest.mark.parametrize("digits", [1, 3, 4])
def test_numbers_are_shown_as_python_shows_them(spark, digits):
    rng = np.random.default_rng(2)
    values = [0.0, 0.3125, -0.3125, 0.0625, 0.0125, 2.675, 80.65, 0.8065 * 100, 6.25, 99.95, 126.85, 250.25]
    values += [i / 10**(digits + 1) for i in range(5, 2000, 10)] + [i / 2**(digits + 1) for i in range(1, 200, 2)]
    values += [float(v) for v in rng.normal(0, 20, 300)]
    df = spark.createDataFrame([(v, f"{v:.{digits}f}") for v in values], "v double, want string")
    shown = F.format_string(f"%.{digits}f", wording.even(F.col("v"), digits))
    wrong = df.withColumn("got", shown).filter("got <> want AND abs(want) > 0").collect()
    assert not wrong


def test_other_gateways_are_routed(spark):
    """Arms of gateways that no constant names take part, and nothing else does."""
    arms = spark.createDataFrame([("UPI", "Alpha pay", 1500, 400, 0.79, 1898), ("UPI", "Beta", 2, 60, 0.03, 60)],
                                 "tx_type string, gateway string, alpha int, beta int, posterior_mean double, n_trials long")
    df = spark.range(500).select(F.col("id").alias("TransactionID"), F.lit("UPI").alias("tx_type"))
    assert {r[2] for r in R.thompson_route(df, arms).collect()} == {"Alpha pay"}
    state = {(r["tx_type"], r["gateway"]): (r["alpha"], r["beta"], r["posterior_mean"], r["n_trials"])
             for r in R.with_untried(arms, ["Alpha pay", "Gamma"]).collect()}
    assert state["UPI", "Alpha pay"] == (1500, 400, 0.79, 1898) and state["CARD", "Gamma"] == (1, 1, 0.5, 0)
    assert len(state) == 9


def test_csv_keeps_every_text(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("TransactionID,isFraud,TransactionAmt,M1,id_30,V1,note\n1,0,1.5,T,Windows 10,3,a\n2,1,2,F,,4.5,7\n")
    df = files.read_transactions_csv(spark, str(path))
    assert [tuple(r) for r in df.collect()] == [(1, 0, 1.5, "T", "Windows 10", 3.0, "a"), (2, 1, 2.0, "F", None, 4.5, "7")]
    path.write_text("TransactionID,isFraud\n1,yes\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        files.read_transactions_csv(spark, str(path)).collect()


def test_published_router_state(spark, tmp_path):
    path = tmp_path / "state.json"
    path.write_text("""{
  "UPI": {"Razorpay": {"alpha": 1587.0, "beta": 260.0, "posterior_mean": 0.8592, "credible_interval_95": [0.843, 0.8747],
                       "n_trials": 1845, "true_rate": 0.94}},
  "CARD": {"Other": {"alpha": 3.0, "beta": 1.0, "posterior_mean": 0.75, "n_trials": 2}}
}""")
    arms = files.read_router_state(spark, str(path))
    rows = {(r["tx_type"], r["gateway"]): tuple(r)[2:] for r in arms.collect()}
    assert rows == {("UPI", "Razorpay"): (1587.0, 260.0, 0.8592, [0.843, 0.8747], 1845, 0.94),
                    ("CARD", "Other"): (3.0, 1.0, 0.75, None, 2, None)}
    files.write_router_state(arms, str(tmp_path / "again"))
    again = files.read_router_state(spark, str(tmp_path / "again"))
    assert {tuple(map(str, r)) for r in again.collect()} == {tuple(map(str, r)) for r in arms.collect()}


def test_rounding_like_python(spark):
    import random
    rng = random.Random(4)
    values = [130.35, 150.65, 0.125, 0.375, 2.5, 127.25, 1234.25, 0.0, 1e-9, 99999.95, 0.05, 0.15, 6.25, 1e6 + 0.0625]
    values += [rng.uniform(0, 10 ** rng.randrange(1, 5)) for _ in range(300)] + [rng.randrange(10 ** 6) / 80 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values] + [(-v,) for v in values], "v double")
    for digits in (1, 3):
        got = df.select("v", F.format_string(f"%.{digits}f", wording.even(F.col("v"), digits) + 0.0).alias("t")).collect()
        assert all(r["t"] == f"{r['v']:.{digits}f}".replace("-0.000", "0.000") or float(r["t"]) == 0 for r in got)


def test_columns_by_prefix(spark):
    from risklane.operators.shaping import with_prefix
    df = spark.createDataFrame([(1, 2.0, 3.0, "x")], "TransactionID long, V1 double, V20 double, card1 string")
    assert with_prefix(df, "V", "TransactionID").columns == ["TransactionID", "V1", "V20"]
