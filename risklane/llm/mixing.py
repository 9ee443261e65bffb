"""Mixing sources to target weights by entropy balancing, in DataFrame expressions only.

Every document has a rate between 0 and ``most`` copies. Rates minimise the entropy relative to an even draw, subject
to one token constraint per source: the rates times the sizes add up to the source's target. The optimum tilts the
odds of a rate exponentially, rate = most / (1 + exp(-lambda * size / mean size)), and the multipliers lambda solve
a convex dual: Newton steps, each one aggregation over all (source, size) cells. Rates depend on source and size only,
so cells hold all that the iterations need; their number grows with the distinct sizes and not with the rows.

Rounding walks the cells of a source from the largest size to the smallest and hands on the words still owed, so a
source ends within half of its smallest size of the target (as far as copies allow). The copies of a cell are dealt
to its documents as evenly as possible, the odd ones by a hash order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from risklane.llm.common import shuffled, spare_name, stage, word_count
from risklane.operators.ordered import running_sums

# Weights of the sources in code point order, repeating; the share of all words; the cap on repeats.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
# A source counts as solved when its expected words are this near its target, relatively.
TOLERANCE = 1e-9
# Newton steps before the bracket is only halved, and the steps by which it must be too narrow to halve.
NEWTON_STEPS, MOST_STEPS = 40, 140
# Most sizes of one source that are rounded in one fold.
FOLD = 1024


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            most: int = MOST) -> DataFrame:
    """(source, source_size) with the target of each source, null source last.

    Sharing out by weight, with what exceeds a cap shared out again until nothing does, is filling to one level:
    target = min(cap, level * weight). Sources fill up in the order of cap / weight, so the level follows from
    running sums over them. One row per source enters these windows, and no document.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("_rank", F.row_number().over(by_name) - 1) \
        .withColumn("_weight", F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]),
                                            (F.col("_rank") % len(weights) + 1).cast("int"))) \
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    fills = W.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before = fills.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    left = ranked.withColumn("_budget", F.sum("source_size").over(every) * F.lit(share)) \
        .withColumn("_left", F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) \
        .withColumn("_open", F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    # The level is set by the first source that it does not fill; sources before it are at their caps.
    level = left.withColumn("_level", F.col("_left") / F.col("_open")) \
        .withColumn("_free", F.col("_level") * F.col("_weight") < F.col("_cap"))
    found = level.withColumn("_first", F.min(F.when(F.col("_free"), F.struct(
        F.col("_cap") / F.col("_weight"), "_rank", "_level"))).over(every)["_level"])
    return found.select("source", "source_size", F.least(
        F.col("_cap"), F.coalesce(F.col("_first") * F.col("_weight"), F.col("_cap"))).alias("target"))


def rate_of(tilt: Column, size: Column, mean: Column, most: int) -> Column:
    return F.lit(float(most)) / (F.lit(1.0) + F.exp(-tilt * size / mean))


def exact(value: Column) -> Column:
    """Sum of doubles that is the same in whatever order the rows come: each is rounded to nine decimal places first."""
    return F.sum(value.cast("decimal(38,9)")).cast("double")


def solve(cells: DataFrame, wanted: DataFrame, most: int = MOST) -> DataFrame:
    """Multiplier per source, by safeguarded Newton steps on the dual.

    Sources at their cap (rate ``most`` for all) and sources without words need none. The words drawn rise with
    lambda, so every step narrows a bracket; a step that leaves it is replaced by the bracket's middle.
    After ``NEWTON_STEPS`` steps the bracket is halved until it is solved or too narrow to halve; running out of steps is an error.
    The state is one row per source, written after each step.
    """
    bound = 60.0
    state = wanted.filter("target > 0 and target < source_size * %d" % most).select(
        "source", "target", "source_size", F.lit(0.0).alias("tilt"), F.lit(-bound).alias("low"),
        F.lit(bound).alias("high"), F.lit(False).alias("done"))
    means = cells.filter("size > 0").groupBy("source").agg(
        (F.sum(F.col("size") * F.col("docs")) / F.sum("docs")).alias("mean"),
        F.min("size").alias("smallest"))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    state = stage(state.alias("s").join(means.alias("m"), same("s", "m")).select(
        "s.*", "mean", (F.col("mean") / F.col("smallest") * bound).alias("reach"))
        .withColumn("low", -F.col("reach")).withColumn("high", F.col("reach")).drop("reach"), "tilts")
    for number in range(MOST_STEPS):
        if state.filter("not done").isEmpty():
            break
        rate = rate_of(F.col("tilt"), F.col("size"), F.col("mean"), most)
        words = F.col("size") * F.col("docs")
        drawn = cells.alias("c").join(state.filter("not done").alias("s"), same("c", "s")).groupBy("s.source").agg(
            exact(words * rate).alias("drawn"),
            exact(words * rate * (F.lit(1.0) - rate / F.lit(float(most))) * F.col("size") / F.col("mean")).alias("slope"))
        gap = F.col("drawn") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap / F.col("slope")
        middle = (F.col("_low") + F.col("_high")) / 2
        step = middle if number >= NEWTON_STEPS else F.when(
            (F.col("slope") > 0) & (newton > F.col("_low")) & (newton < F.col("_high")), newton).otherwise(middle)
        # Nothing lies between the ends of a bracket as narrow as its own rounding.
        narrow = F.col("_high") - F.col("_low") <= F.greatest(F.abs("_low"), F.abs("_high")) * 1e-15
        near = (F.abs(gap) <= F.col("target") * TOLERANCE) | narrow
        state = stage(state.alias("s").join(drawn.alias("d"), same("s", "d"), "left")
                      .select("s.*", "drawn", "slope")
                      .withColumn("_low", low).withColumn("_high", high)
                      .withColumn("_near", near)
                      .withColumn("_tilt", F.when(F.col("done") | F.col("_near"), F.col("tilt")).otherwise(step))
                      .select("source", "target", "source_size", F.col("_tilt").alias("tilt"),
                              F.when(F.col("done"), F.col("low")).otherwise(F.col("_low")).alias("low"),
                              F.when(F.col("done"), F.col("high")).otherwise(F.col("_high")).alias("high"),
                              (F.col("done") | F.coalesce("_near", F.lit(True))).alias("done"), "mean"), "tilts")
    else:
        if not state.filter("not done").isEmpty():
            raise ArithmeticError(f"no multiplier found in {MOST_STEPS} steps")
    return state.select("source", "tilt", "mean")


def copies_per_cell(rated: DataFrame, most: int = MOST, fold: int = FOLD) -> DataFrame:
    """(source, size, docs, rate) with whole copies per cell, whose words add up to the target.

    A fold over sizes, largest first, gives each cell the copies owed so far and hands on the rest. Sources of more than ``fold``
    sizes are folded in blocks, each from nothing owed; the block of the smallest sizes comes last and starts from what
    all blocks before it left over, so the end is as near the target as one long fold's.
    """
    counts = rated.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    blocks = F.ceil(F.col("_n") / fold)
    placed = running_sums(rated, ["source"], ["size"], {"_at": F.lit(1).cast("long")}).alias("r") \
        .join(counts.alias("n"), F.col("r.source").eqNullSafe(F.col("n.source"))) \
        .select("r.source", "size", "docs", "rate", F.floor(F.col("_at") * blocks / F.col("_n")).alias("_block"))
    blocked = stage(placed.groupBy("source", "_block").agg(
        F.sort_array(F.collect_list(F.struct("size", "docs", "rate")), asc=False).alias("cells")), "blocks")

    def owed_copies(owed: Column, cell: Column) -> Column:
        return F.greatest(F.lit(0), F.least(cell["docs"] * most, F.round(owed / cell["size"]))).cast("long")

    def give(state: Column, cell: Column) -> Column:
        owed = state["owed"] + cell["docs"] * cell["rate"] * cell["size"]
        copies = owed_copies(owed, cell)
        return F.struct((owed - copies * cell["size"]).alias("owed"), F.array_append(state["given"], F.struct(
            cell["size"].alias("size"), cell["docs"].alias("docs"), cell["rate"].alias("rate"),
            copies.alias("cell_copies"))).alias("given"))

    empty = F.array().cast("array<struct<size:bigint,docs:bigint,rate:double,cell_copies:bigint>>")

    def folded(start: Column) -> Column:
        return F.aggregate("cells", F.struct(start.alias("owed"), empty.alias("given")), give)

    first = stage(blocked.filter("_block > 0").select("source", folded(F.lit(0.0)).alias("state")), "folded")
    # Summed as decimals: the order of the blocks is free.
    over = first.groupBy("source").agg(F.sum(F.col("state.owed").cast("decimal(38,9)")).cast("double").alias("_over"))
    last = blocked.filter("_block = 0").alias("b").join(over.alias("o"), F.col("b.source").eqNullSafe(F.col("o.source")), "left") \
        .select("b.source", folded(F.coalesce("_over", F.lit(0.0))).alias("state"))
    return first.unionByName(last).select("source", F.inline("state.given"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Copies of every document, with its source's target.

    A null text and a text without words have size 0 and no copies. The null source is a source of its own, last in
    order. Repeated rows each get their own copies. A table without words has targets and copies of 0; an empty table gives
    an empty result. Other columns of ``df`` are ignored.
    """
    thin = stage(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                           word_count(text_col).alias("size")), "sizes")
    cells = stage(thin.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "cells")
    wanted = stage(targets(cells.groupBy("source").agg(
        F.sum(F.col("size") * F.col("docs")).alias("source_size")), weights, share, most), "targets")
    tilts = solve(cells, wanted, most)
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    full = F.when(F.col("target") >= F.col("source_size") * most, F.lit(float(most))).otherwise(F.lit(0.0))
    rated = cells.filter("size > 0").alias("c").join(wanted.alias("w"), same("c", "w")) \
        .select("c.*", "target", "source_size").alias("c").join(tilts.alias("t"), same("c", "t"), "left") \
        .select("c.source", "size", "docs", F.coalesce(
            rate_of(F.col("tilt"), F.col("size"), F.col("mean"), most), full).alias("rate"))
    dealt = copies_per_cell(rated, most)
    # The odd copies of a cell go to the first documents in a hash order.
    ranked = running_sums(thin.withColumn("_h", F.xxhash64("doc_id", "source")), ["source", "size"], ["_h", "doc_id"],
                          {"_at": F.lit(1).cast("long")})
    cell = F.col("r.source").eqNullSafe(F.col("d.source")) & (F.col("r.size") == F.col("d.size"))
    placed = ranked.alias("r").join(shuffled(dealt.alias("d")), cell, "left") \
        .select("r.doc_id", "r.source", "r.size", "rate", F.coalesce(
            F.floor(F.col("cell_copies") / F.col("docs")) +
            (F.col("_at") < F.col("cell_copies") % F.col("docs")).cast("long"), F.lit(0)).cast("long").alias("copies"))
    return placed.alias("p").join(wanted.alias("w"), same("p", "w")).select(
        "p.doc_id", "p.size", "w.source_size", F.col("w.target").cast("double").alias("target"),
        (F.col("copies") * F.col("p.size")).alias("taken"), "p.source",
        F.coalesce("rate", F.lit(0.0)).alias("rate"), "copies")


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df``, whole, each as often as the mix takes it.

    Rows that agree in id, source and size share their copies evenly, rounded up.
    """
    number, count = spare_name(df, "_copies"), spare_name(df, "_copy")
    shares = mix(df, id_col, text_col, source_col).groupBy(
        F.col("doc_id").alias("_m_id"), F.col("source").alias("_m_source"), F.col("size").alias("_m_size")).agg(
        F.ceil(F.sum("copies") / F.count(F.lit(1))).cast("int").alias(number)).filter(F.col(number) > 0)
    same = F.col(id_col).eqNullSafe(F.col("_m_id")) & F.col(source_col).eqNullSafe(F.col("_m_source")) \
        & (word_count(text_col) == F.col("_m_size"))
    return df.join(shares, same).withColumn(count, F.explode(F.sequence(F.lit(1), F.col(number)))).select(*df.columns)
