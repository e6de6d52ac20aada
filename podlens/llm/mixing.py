"""Op 9: mixing sources to target weights by entropy balancing.

Of all rates that meet the token targets, entropy balancing takes those closest (in relative entropy)
to taking every document once. They have the form exp(sum of one multiplier for each of a document's
constraint groups). The multipliers solve a convex dual problem by Newton steps, and stay in a table. With
one family of groups, as in the query (sources), the dual separates: sizes are summed once by group, and
the steps run on that sum, in one row for each group, to log(target / size). Several families take turns,
with sums over Spark tables for each turn; no query has that, but a test. The rates are then rounded to
whole copies, in an order drawn from a hash, so that each group's tokens come out at their target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podlens.llm.tables import pieces, prepare, store
from podlens.session import small_side

# Fixed by the contract: weights of the sources in their order, share of all tokens, largest repetition.
SOURCE_WEIGHTS, TOTAL_SHARE, MAX_COPIES = (5, 2, 1), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
# Newton steps for one family of groups; several families take turns until all are this near to their targets.
STEPS, TOLERANCE = 60, 1e-9
# Tables with a row for each group are kept in pieces of so many rows.
GROUPS_EACH = 100_000
# The documents of a source are ordered in so many parts, which are summed before any is sorted.
PARTS = 4096


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``target`` from (source, source_size): shares by weight, with a limit.

    A source whose share is above its limit keeps the limit, and the excess goes to the others by
    weight. That ends with one level: each source gets the smaller of weight x level and its limit, so
    the level follows from sums over the sources in the order of limit / weight.
    """
    weights = F.element_at(F.array(*map(F.lit, SOURCE_WEIGHTS)), F.col("place") % len(SOURCE_WEIGHTS) + 1)
    # One row for each source: the order runs over names, not over documents.
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))) - 1
    rows = sizes.withColumn("place", place).withColumn("weight", weights.cast("double"))
    rows = rows.withColumn("limit", (MAX_COPIES * F.col("source_size")).cast("double"))
    rows = rows.withColumn("fill", F.col("limit") / F.col("weight"))
    every = Window.orderBy("fill", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("fill", "place").rowsBetween(Window.unboundedPreceding, -1)
    total = TOTAL_SHARE * F.sum("source_size").over(every)
    left = total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / weight_left)
    # The level is the first one that its own source does not limit.
    fits = F.min(F.when(F.col("fill") >= F.col("level"), F.struct("fill", "place", "level"))).over(every)["level"]
    target = F.least(F.col("weight") * fits, F.col("limit"))
    return rows.select("source", "source_size", F.coalesce(target, F.col("limit")).alias("target"))


def newton(mass: Column, target: Column) -> Column:
    """The multiplier that minimises mass * exp(multiplier) - target * multiplier, from 0 by Newton steps.

    Gradient: mass * exp(multiplier) - target; Hessian: mass * exp(multiplier). A step is 1 at most.
    """

    def step(multiplier: Column, _: Column) -> Column:
        tilted = mass * F.exp(multiplier)
        return multiplier + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(target - tilted, tilted)))

    usable = (mass > 0) & (target > 0)
    return F.when(usable, F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(0.0), step)).otherwise(F.lit(0.0))


def balance(cells: DataFrame, targets: DataFrame, families: list[str], rounds: int = 50) -> DataFrame:
    """Multipliers of the exponentially tilted rates: ``family``, ``group``, ``multiplier``.

    ``cells`` has the ``size`` of all documents with the same groups: one column for each family of
    groups. ``targets`` has ``family``, ``group``, ``target``. Within a family the groups share no
    document, so the Hessian of the dual is diagonal there, and all groups take their Newton steps side
    by side. Families take turns, each with the others held, until all groups are at their targets. A
    group without tokens keeps the multiplier 0.
    """
    state = store(targets.withColumn("multiplier", F.lit(0.0)), "multipliers")
    n = pieces(state.count(), GROUPS_EACH)
    for _ in range(rounds):
        worst = 0.0
        for family in families:
            tilted, exponent = cells, F.lit(0.0)
            for name in families:
                if name == family:
                    continue
                own = state.filter(F.col("family") == name)
                own = own.select(F.col("group").alias(f"{name}_of"), F.col("multiplier").alias(f"{name}_by"))
                tilted = tilted.join(small_side(own), F.col(name).eqNullSafe(F.col(f"{name}_of")), "left")
                exponent = exponent + F.coalesce(f"{name}_by", F.lit(0.0))
            gained = tilted.select(F.col(family).alias("tilted_group"), (F.col("size") * F.exp(exponent)).alias("mass"))
            gained = gained.groupBy("tilted_group").agg(F.sum("mass").alias("mass")).coalesce(n)
            own = F.col("family") == family
            joined = state.join(small_side(gained), own & F.col("group").eqNullSafe(F.col("tilted_group")), "left")
            gap = F.try_divide(F.abs(F.col("mass") * F.exp("multiplier") - F.col("target")), F.col("target"))
            solved = F.when(own, newton(F.col("mass"), F.col("target"))).otherwise(F.col("multiplier"))
            columns = ["family", "group", "target", F.coalesce(solved, F.lit(0.0)).alias("multiplier")]
            joined = joined.select(*columns, F.when(F.col("target") > 0, gap).alias("gap"))
            joined = store(joined.coalesce(n), "multipliers")
            worst = max(worst, joined.agg(F.max("gap")).first()[0] or 0.0)
            state = joined.drop("gap")
        if len(families) == 1 or worst <= TOLERANCE:
            break
    return state.select("family", "group", "multiplier")


def rounded_copies(rates: DataFrame) -> DataFrame:
    """``rates`` (any columns, with group, size, rate, target, draw and row) with whole ``copies``.

    Every document gets the whole part of its rate. In the order of ``draw``, the first documents of a
    group get one copy more, as many as bring the group's tokens nearest to its target. Only the part
    of a group in which that ends is sorted. ``row`` orders what has one draw.
    """
    columns = rates.columns
    part = F.shiftrightunsigned("draw", 64 - PARTS.bit_length() + 1)
    rows = rates.withColumns({"whole": F.floor("rate"), "part": part})
    sure = F.sum(F.col("whole") * F.col("size"))
    parts = rows.groupBy("group", "part").agg(F.sum("size").alias("part_size"), sure.alias("sure"))
    in_group = Window.partitionBy("group")
    ahead = in_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("group").alias("of_group"),
        F.col("part").alias("of_part"),
        "part_size",
        F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("before"),
        F.sum("sure").over(in_group).alias("sure"),
    )
    same = F.col("group").eqNullSafe(F.col("of_group")) & (F.col("part") == F.col("of_part"))
    rows = rows.join(parts, same).withColumn("wanted", F.col("target") - F.col("sure"))
    inside = (F.col("before") < F.col("wanted")) & (F.col("before") + F.col("part_size") > F.col("wanted"))
    one_more = F.when(F.col("before") < F.col("wanted"), 1).otherwise(0)
    all_or_none = rows.filter(~inside).select(*columns, (F.col("whole") + one_more).alias("copies"))
    order = Window.partitionBy("group", "part").orderBy("draw", "row").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.filter(inside).withColumn("through", F.col("before") + F.sum("size").over(order))
    # The document that crosses the target is taken if that ends nearer to it.
    one_more = F.when(F.col("through") - F.col("size") / 2 <= F.col("wanted"), 1).otherwise(0)
    return all_or_none.unionAll(last.select(*columns, (F.col("whole") + one_more).alias("copies")))


def mix(docs: DataFrame) -> DataFrame:
    """Copies of every document so that sources meet their token targets.

    Returns ``doc_id``, ``size``, ``source_size``, ``target``, ``rate``, ``copies``, ``taken`` (size
    times copies) and the ``digest`` of the text. ``docs`` has ``doc_id``, ``text`` and ``source``;
    other columns are not read. A null text has size 0; a null source is a source of its own, the last
    one. A source without words has target 0. No document is taken more than twice. Rows that repeat
    are rounded one by one. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.md5(F.coalesce("text", F.lit(""))).alias("digest"),
        F.col("source").alias("group"),
        word_count().alias("size"),
    )
    rows = store(rows.withColumn("draw", F.xxhash64(F.lit("copies"), "doc_id", "digest")), "sizes")
    cells = store(rows.groupBy(F.col("group").alias("source")).agg(F.sum("size").alias("size")), "cells")
    n = pieces(cells.count(), GROUPS_EACH)
    cells = cells.coalesce(n)
    targets = store(source_targets(cells.withColumnRenamed("size", "source_size")).coalesce(n), "targets")
    wanted = targets.select(F.lit("source").alias("family"), F.col("source").alias("group"), "target")
    found = balance(cells, wanted, ["source"]).select(F.col("group").alias("of_group"), "multiplier")
    known = targets.join(small_side(found), F.col("source").eqNullSafe(F.col("of_group"))).drop("of_group")
    # Newton ends within rounding errors of its target; a rate that is whole but for that is whole.
    rate = F.least(F.round(F.exp("multiplier"), 7), F.lit(float(MAX_COPIES)))
    rate = F.when(F.col("target") > 0, rate).otherwise(F.lit(0.0))
    known = store(known.withColumn("rate", rate).coalesce(n), "rates")
    rated = rows.join(small_side(known), F.col("group").eqNullSafe(F.col("source")))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return rounded_copies(rated).select("doc_id", "size", "source_size", "target", "rate", "copies", taken, "digest")
