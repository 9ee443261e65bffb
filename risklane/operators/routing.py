"""Gateway routing: posteriors from logged outcomes, policy comparison, and bandit routing of batches.

An arm is a (payment type, gateway) pair.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from risklane.functions.beta import beta_draw, interval95
from risklane.functions.clock import on_circle
from risklane.functions.rules import PAYMENT_TYPES
from risklane.operators.ordered import TASK_ROWS, if_small, positions, rolling_mean, running_sums

ARM = ["tx_type", "gateway"]
# Known gateways in their listed order (fixed values).
GATEWAYS = ("Razorpay", "PayU", "Stripe", "CCAvenue")
# Most gateways that one batch is routed among.
MOST_GATEWAYS = 500
CONTEXT_SIZE = 5


def posterior(outcomes: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Beta posterior of every arm. ``prior`` holds (tx_type, gateway, alpha, beta) of an earlier state."""
    wins = F.sum(F.col("success").cast("long"))
    seen = outcomes.groupBy(*ARM).agg(wins.alias("wins"), (F.count(F.lit(1)) - wins).alias("losses"))
    if prior is not None:
        start = prior.select(*ARM, (F.col("alpha") - 1).cast("long").alias("wins"),
                             (F.col("beta") - 1).cast("long").alias("losses"))
        seen = seen.unionByName(start).groupBy(*ARM).agg(F.sum("wins").alias("wins"), F.sum("losses").alias("losses"))
    alpha, beta = F.col("wins") + 1, F.col("losses") + 1
    return seen.select(*ARM, alpha.alias("alpha"), beta.alias("beta"),
                       (alpha / (alpha + beta)).alias("posterior_mean"),
                       (F.col("wins") + F.col("losses")).alias("n_trials"))


def with_interval(arms: DataFrame) -> DataFrame:
    return arms.withColumn("ci", interval95(F.col("alpha").cast("double"), F.col("beta").cast("double")))


def gateways_of(arms: DataFrame, known: Sequence[str] = ()) -> list[str]:
    """``known``, then every other gateway that ``arms`` names, by name. An error beyond ``MOST_GATEWAYS``."""
    found = [row[0] for row in arms.select("gateway").distinct().limit(MOST_GATEWAYS + 1).collect()]
    if len(found) > MOST_GATEWAYS:
        raise ValueError(f"more than {MOST_GATEWAYS} gateways")
    return [*known, *sorted(name for name in found if name is not None and name not in known)]


def with_untried(arms: DataFrame, gateways: Sequence[str], kinds: Sequence[str] = PAYMENT_TYPES) -> DataFrame:
    """``arms`` and, with the flat prior, every pair of ``kinds`` and ``gateways`` that it lacks."""
    pairs = arms.sparkSession.createDataFrame([(kind, name) for kind in kinds for name in gateways],
                                              "tx_type string, gateway string")
    state = arms.select(*ARM, "alpha", "beta", "posterior_mean", "n_trials")
    return F.broadcast(pairs).join(state, ARM, "full").select(
        *ARM, F.coalesce("alpha", F.lit(1)).alias("alpha"), F.coalesce("beta", F.lit(1)).alias("beta"),
        F.coalesce("posterior_mean", F.lit(0.5)).alias("posterior_mean"),
        F.coalesce("n_trials", F.lit(0)).cast("long").alias("n_trials"))


def posterior_errors(arms: DataFrame, rates: DataFrame) -> DataFrame:
    """Learned against reference rates, best reference gateway of each type first."""
    joined = arms.join(if_small(rates), ARM)
    return joined.select(
        *ARM, F.col("rate").alias("true_rate"), F.round("posterior_mean", 4).alias("posterior_mean"), "n_trials",
        F.round(F.abs(F.col("posterior_mean") - F.col("rate")), 4).alias("error"),
    ).orderBy("tx_type", F.desc("true_rate"))


def policy_lift(outcomes: DataFrame, baseline: str) -> DataFrame:
    """Success rate per policy and its gain over the baseline policy, in percent."""
    rates = outcomes.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.avg("success").alias("_rate"))
    # One row per policy: the window is over that table, not over the log.
    base = F.max(F.when(F.col("policy") == baseline, F.col("_rate"))).over(W.partitionBy())
    return rates.select("policy", "n", F.round(F.col("_rate") * 100, 4).alias("success_pct"),
                        F.round((F.col("_rate") - base) / base * 100, 4).alias("lift_pct"))


def cumulative_regret(outcomes: DataFrame, rates: DataFrame, limit: int = TASK_ROWS) -> DataFrame:
    """Regret of each step (best rate of the type less the chosen arm's) and its running total per policy."""
    best = rates.groupBy("tx_type").agg(F.max("rate").alias("best"))
    known = rates.join(best, "tx_type").select(
        *ARM, (F.col("best") - F.col("rate")).cast("decimal(18,6)").alias("regret"))
    steps = outcomes.select("policy", "step", *ARM).join(if_small(known), ARM)
    summed = running_sums(steps, ["policy"], ["step"], {"_before": F.col("regret")}, limit)
    return summed.select("policy", "step", F.col("regret").cast("double").alias("regret"),
                         F.round((F.col("_before") + F.col("regret")).cast("double"), 6).alias("cum_regret"))


def rolling_success(outcomes: DataFrame, size: int = 200, by: Sequence[str] = ("policy",),
                    limit: int = TASK_ROWS) -> DataFrame:
    log = outcomes.select(*by, "step", F.col("success").cast("long").alias("success"))
    return rolling_mean(log, list(by), ["step"], "success", size, "rolling_rate", limit)


def outage_view(outcomes: DataFrame, tx_type: str, start: int, end: int, size: int = 50, margin: int = 500,
                limit: int = TASK_ROWS) -> DataFrame:
    """Rolling success of one payment type around an outage. Cut after rolling, so edges are full windows."""
    one_type = outcomes.filter(F.col("tx_type") == tx_type)
    return rolling_success(one_type, size, ("policy", "tx_type"), limit).filter(
        F.col("step").between(start - margin, end + margin))


def round_robin(df: DataFrame, order: Sequence[str], gateways: Sequence[str] = GATEWAYS,
                limit: int = TASK_ROWS) -> DataFrame:
    names = F.array(*[F.lit(g) for g in gateways])
    turn = (F.col("_at") % len(gateways)).cast("int")
    return positions(df, order, "_at", limit).withColumn("assigned", names[turn]).drop("_at")


def ranked_arms(arms: DataFrame) -> DataFrame:
    """Arms with their rank inside the payment type, best posterior mean first."""
    order = W.partitionBy("tx_type").orderBy(F.desc("posterior_mean"), "gateway")
    return arms.withColumn("rank", F.row_number().over(order))


def second_best(arms: DataFrame) -> DataFrame:
    return ranked_arms(arms).filter(F.col("rank") == 2).select(
        "tx_type", F.col("gateway").alias("second_gateway"), F.col("posterior_mean").alias("second_rate"))


def best_by_mean(arms: DataFrame) -> DataFrame:
    """The arm a deterministic router picks for each payment type."""
    return ranked_arms(arms).filter(F.col("rank") == 1).drop("rank")


def _by_type(arms: DataFrame, gateways: Sequence[str], *columns: str) -> DataFrame:
    """One row per payment type (four at most) with a gateway -> struct(columns) map, to be broadcast."""
    known = arms.filter(F.col("tx_type").isin(*PAYMENT_TYPES) & F.col("gateway").isin(*gateways))
    return known.groupBy("tx_type").agg(F.map_from_entries(
        F.collect_list(F.struct(F.col("gateway"), F.struct(*columns)))).alias("_arms"))


def _pick(scores: dict[str, Column]) -> Column:
    """The gateway with the highest score; on equal scores the one listed first."""
    ranked = [F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("gateway"))
              for i, (name, score) in enumerate(scores.items())]
    return F.array_max(F.array(*ranked))["gateway"]


def thompson_route(df: DataFrame, arms: DataFrame, ident: str = "TransactionID", seed: int = 42,
                   gateways: Sequence[str] | None = None) -> DataFrame:
    """Route by one posterior draw per arm. The draw depends on (seed, id, gateway) only; no shuffle.

    Payments go to the gateways that ``arms`` names and to ``gateways``.
    """
    gateways = gateways_of(arms, gateways or ())
    spread = df.join(F.broadcast(_by_type(arms, gateways, "alpha", "beta")), "tx_type", "left")
    draws = {}
    for name in gateways:
        arm = F.col("_arms")[name]
        # An arm that was never tried has the flat prior.
        draws[name] = beta_draw(F.xxhash64(F.lit(seed), F.col(ident), F.lit(name)),
                                F.coalesce(arm["alpha"], F.lit(1)).cast("double"),
                                F.coalesce(arm["beta"], F.lit(1)).cast("double"))
    drawn = spread.withColumns({f"_draw_{name}": draw for name, draw in draws.items()})
    return drawn.withColumn("routed_gateway", _pick({name: F.col(f"_draw_{name}") for name in gateways})) \
                .select(*df.columns, "routed_gateway")


def context(amount: Column, hour: Column) -> list[Column]:
    """What the linear bandit sees of a payment."""
    hour_sin, hour_cos = on_circle(hour, 24)
    return [F.log1p(amount) / 10, hour_sin, hour_cos, (amount > 500).cast("double"), F.lit(1.0)]


def linear_statistics(outcomes: DataFrame) -> DataFrame:
    """Per arm the ridge statistics I + sum(x x') (upper triangle, row by row) and sum(reward * x)."""
    x = context(F.col("amt"), F.col("hour"))
    rows = outcomes.select(*ARM, F.col("success").cast("double").alias("_reward"),
                           *[value.alias(f"_x{i}") for i, value in enumerate(x)])
    pairs = [(i, j) for i in range(CONTEXT_SIZE) for j in range(i, CONTEXT_SIZE)]
    return rows.groupBy(*ARM).agg(
        *[F.expr(f"sum(_x{i} * _x{j}) + {1.0 if i == j else 0.0}D").alias(f"a{i}{j}") for i, j in pairs],
        *[F.expr(f"sum(_reward * _x{i})").alias(f"b{i}") for i in range(CONTEXT_SIZE)])


def linear_route(df: DataFrame, statistics: DataFrame, explore: float = 0.5,
                 gateways: Sequence[str] | None = None) -> DataFrame:
    """Route by upper confidence bound. The few 5x5 inverses are taken here; rows are scored as columns.

    Payments go to the gateways that ``statistics`` names and to ``gateways``.
    """
    gateways = gateways_of(statistics, gateways or ())
    size = CONTEXT_SIZE
    fitted = []
    known = statistics.filter(F.col("tx_type").isin(*PAYMENT_TYPES) & F.col("gateway").isin(*gateways))
    for row in known.collect():                 # one row per payment type and gateway
        a = np.array([[row[f"a{min(i, j)}{max(i, j)}"] for j in range(size)] for i in range(size)])
        inverse = np.linalg.inv(a)
        theta = inverse @ np.array([row[f"b{i}"] for i in range(size)])
        fitted.append((row["tx_type"], row["gateway"], theta.tolist(), inverse.ravel().tolist()))
    # One row per payment type with every coefficient as a column, so that scoring is plain arithmetic.
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    column = {name: f"g{i}" for i, name in enumerate(gateways)}
    names = [f"_{column[g]}_{c}" for g in gateways for c in (*(f"t{i}" for i in range(size)), *(f"i{i}{j}" for i, j in pairs))]
    table = {}
    for kind, gateway, theta, inverse in fitted:
        line = table.setdefault(kind, dict.fromkeys(names))
        line |= {f"_{column[gateway]}_t{i}": theta[i] for i in range(size)}
        # Both halves of the symmetric matrix in one coefficient.
        line |= {f"_{column[gateway]}_i{i}{j}": inverse[i * size + j] * (1 if i == j else 2) for i, j in pairs}
    wide = df.sparkSession.createDataFrame(
        [(kind, *line.values()) for kind, line in table.items()],
        ", ".join(["tx_type string", *(f"{name} double" for name in names)]))
    spread = df.join(F.broadcast(wide), "tx_type", "left").withColumns(
        {f"_x{i}": value for i, value in enumerate(context(F.col("amt"), F.col("hour")))})
    # theta'x + explore * sqrt(x' inverse x) as SQL text; an untried arm has theta 0 and the unit matrix.
    untried = " + ".join(f"_x{i} * _x{i}" for i in range(size))
    scores = {}
    for g in gateways:
        gain = " + ".join(f"_{column[g]}_t{i} * _x{i}" for i in range(size))
        width = " + ".join(f"_{column[g]}_i{i}{j} * _x{i} * _x{j}" for i, j in pairs)
        scores[g] = F.expr(f"coalesce({gain} + {explore!r}D * sqrt({width}), {explore!r}D * sqrt({untried}))")
    return spread.withColumn("routed_gateway", _pick(scores)).select(*df.columns, "routed_gateway")
