"""Mixing sources to target weights by entropy balancing.

Targets.  Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share the words
of all documents; a target stops at ``MOST_COPIES`` times its source's words and the excess is
shared again by weight until none is above.  That is one water level over the table of sources:
each round closes the sources below it and raises it.

Rates.  Each document i of source s gets a rate r_i of least entropy relative to one copy, subject to
sum(size_i * r_i) = target_s and, since no document exceeds ``MOST_COPIES`` times its size, r_i <= M.
The dual of that convex problem gives exponential tilts stopped at the bound, r_i = min(M, exp(l_s * z_i)),
where z_i is the size over the source's mean size.  It has one variable per source, and Newton
steps on the logarithm of the tokens reached (kept inside a bracket, halved in time, until all have converged) find it: each step
is one Spark aggregation of the token sums and their derivatives over a written (source, size, count) table, much smaller
than the documents, joined with the table of duals.  Sources may be many: they are a table
throughout, which the driver sees only while it has at most ``MOST_BROADCAST`` rows.

Copies.  Rates are rounded to whole copies by systematic sampling: inside cells of a few
thousand documents of one source, ordered by size, fractions accumulate and a further copy falls
wherever the sum passes a whole number.  The starting point is the one of ``STARTS`` that brings
the source's words nearest to its target.  Sums run over integers (rates in units of 2**-20), so
reruns agree whatever the partitioning.

Edge cases: null and empty texts have size 0 and are taken as zero words; a source of no words has
target 0; a null source is a source of its own, distinct from the empty string; repeated rows are
documents of their own (cells go by id and text, so only rows equal in both share one for certain); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import materialise, text_or_empty
from pointloom.plans.storage import number_rows

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Documents of a source that one cell of the rounding holds on average.
CELL_ROWS = 4000
STARTS = 16
UNIT = 1 << 20
#: Relative error of the token sums at which a dual has converged.
CLOSE = 1e-9
#: From this Newton step on every fourth one halves the bracket instead.
HALVING = 8
#: Sources whose table is broadcast, and kept by the driver between steps, at most.
MOST_BROADCAST = 20_000


def sizes(docs: DataFrame) -> DataFrame:
    """``docs`` with size, the number of words of the whole text."""
    return docs.withColumn("size", F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))


def fixed(table: DataFrame, rows: int) -> DataFrame:
    """A table of one row per source, computed once: local and broadcast while it is small, else written."""
    if rows <= MOST_BROADCAST:
        return F.broadcast(table.sparkSession.createDataFrame(table.collect(), table.schema))
    return materialise(table, "sources")


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (s, words, ...) with target, its words in the mix."""
    ranked = number_rows(sources.withColumn("last", F.col("s").isNull()), ["last", "s"], "rank").drop("last")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS)).cast("int") + 1)
    weighed = materialise(ranked.withColumn("weight", weight).drop("rank"), "weights")
    most = MOST_COPIES * F.col("words")
    level, closed = 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") >= most
        got = weighed.agg(F.sum("words").alias("all"), F.sum(F.when(full, most).otherwise(0)).alias("used"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"), F.count_if(full).alias("closed")).first()
        if not got["open"] or got["closed"] == closed:
            break
        closed = got["closed"]
        level = (got["all"] - got["used"]) / got["open"]
    share = F.lit(level) * F.col("weight")
    return weighed.withColumn("target", F.when(share >= most, most.cast("double")).otherwise(share)).drop("weight")


def tilted(value: Column, size: Column, mean: Column) -> Column:
    """The rate at dual ``value``; infinite where all of a source is taken as often as may be."""
    power = F.least(F.greatest(value * size / mean, F.lit(-700.0)), F.lit(700.0))
    return F.when(value == float("inf"), F.lit(float(MOST_COPIES))).otherwise(F.least(F.lit(float(MOST_COPIES)), F.exp(power)))


def newton_step(step: int) -> dict[str, Column]:
    """New low, high, value and done of a dual, from these and reached and slope at its value."""
    value, low, high, reached, target = (F.col(c) for c in ("value", "low", "high", "reached", "target"))
    above = reached > target
    low, high = F.when(above, low).otherwise(value), F.when(above, value).otherwise(high)
    bounded = (low > float("-inf")) & (high < float("inf"))
    newton = value - F.log(reached / target) * reached / F.col("slope")
    away = value + F.when(above, -1).otherwise(1) * F.greatest(F.lit(1.0), 2 * F.abs(value))
    inside = (F.col("slope") > 0) & (reached > 0) & (newton > low) & (newton < high)
    if step >= HALVING and step % 4 == 0:
        inside &= ~bounded
    new = F.when(inside, newton).when(~bounded, away).otherwise((low + high) / 2)
    close = F.abs(reached - target) <= CLOSE * target
    return {"low": low, "high": high, "value": F.when(close, value).otherwise(new), "done": close | (new == value)}


def solve(histogram: DataFrame) -> tuple[DataFrame, int]:
    """Table (s, words, documents, mean, target, value) of the duals of all sources, from (s, size, n), and its length."""
    totals = histogram.groupBy("s").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("documents"))
    goals = targets(totals)
    count = goals.count()
    columns = ["s", "words", "documents", "mean", "target"]
    full = F.col("target") >= MOST_COPIES * F.col("words")  # every document at the bound
    inf = float("inf")
    duals = goals.withColumn("mean", F.greatest(F.col("words") / F.col("documents"), F.lit(1e-9))).select(
        *columns, F.lit(-inf).alias("low"), F.lit(inf).alias("high"), F.when(full, F.lit(inf)).otherwise(0.0).alias("value"), full.alias("done")
    )
    duals, step = fixed(duals, count), 0
    while not duals.filter("not done").isEmpty():
        now = duals.filter("not done").select(F.col("s").alias("t"), F.col("mean").alias("m"), F.col("value").alias("v"))
        rate = tilted(F.col("v"), F.col("size"), F.col("m"))
        tokens = F.col("n") * F.col("size")
        rows = histogram.join(now, F.col("s").eqNullSafe(F.col("t"))).select("s", (tokens * rate).alias("r"), F.when(rate < MOST_COPIES, tokens * F.col("size") / F.col("m") * rate).otherwise(0.0).alias("d"))
        reached = rows.groupBy(F.col("s").alias("t")).agg(F.sum("r").alias("reached"), F.sum("d").alias("slope"))
        joined = duals.join(reached, F.col("s").eqNullSafe(F.col("t")), "left")
        new = {c: F.when(F.col("done"), F.col(c)).otherwise(x) for c, x in newton_step(step).items()}
        duals, step = fixed(joined.select(*columns, *(x.alias(c) for c, x in new.items())), count), step + 1
    # twelve digits: the order of summation leaves no trace
    return fixed(duals.select(*columns, F.format_string("%.11e", "value").cast("double").alias("value")), count), count


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, then source, rate and copies, for every row of ``docs``."""
    key = F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(11)).alias("key")
    rows = materialise(sizes(docs.select("doc_id", F.col("source").cast("string").alias("s"), "text")).select("doc_id", "s", "size", key), "sizes")
    duals, count = solve(materialise(rows.groupBy("s", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts"))
    rate = tilted(F.col("value"), F.col("size"), F.col("mean"))
    rated = rows.join(duals.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t"))).withColumn("units", F.round(rate * UNIT).cast("long")).withColumn("whole", F.floor(F.col("units") / UNIT).cast("long"))
    celled = rated.withColumn("part", F.col("units") - F.col("whole") * UNIT).withColumn("cell", F.pmod("key", F.ceil(F.col("documents") / CELL_ROWS).cast("long")))
    order = Window.partitionBy("s", "cell").orderBy("size", "key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    # the cell number's hash spreads the cells' own starting points
    celled = materialise(celled.withColumn("upto", F.sum("part").over(order) + F.pmod(F.xxhash64("cell"), F.lit(UNIT))), "rates")

    def further(start: int) -> Column:
        shift = F.lit(start * (UNIT // STARTS))
        return F.floor((F.col("upto") + shift) / UNIT).cast("long") - F.floor((F.col("upto") - F.col("part") + shift) / UNIT).cast("long")

    sums = celled.groupBy(F.col("s").alias("t2")).agg(F.first("target").alias("goal"), *[F.sum(F.col("size") * (F.col("whole") + further(k))).alias(f"w{k}") for k in range(STARTS)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{k}") - F.col("goal")).alias("off"), F.lit(k).alias("start")) for k in range(STARTS)]))
    chosen = fixed(sums.select("t2", best["start"].alias("start")), count)
    extra = F.coalesce(*[F.when(F.col("start") == k, further(k)) for k in range(STARTS)])
    out = celled.join(chosen, F.col("s").eqNullSafe(F.col("t2"))).withColumn("copies", F.least(F.col("whole") + extra, F.lit(MOST_COPIES).cast("long")))
    return out.select("doc_id", "size", F.col("words").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("s").alias("source"), (F.col("units") / UNIT).alias("rate"), "copies")
