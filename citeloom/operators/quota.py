"""Citation quotas of agents, hops and recency bins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import pick
from ..functions.scores import bin_index, hop_split


def agent_quotas(agents: DataFrame, cartel_share: float, random_share: float) -> DataFrame:
    """agents(agent, out_degree, generators, same_year, cartel_id, cartel_size) adds cartel, reserve and q."""
    d = F.col("out_degree")
    cartel = F.when(F.col("cartel_id") > 0, F.least(F.round(d * cartel_share).cast("int"), F.col("cartel_size") - 1)).otherwise(0)
    out = agents.withColumn("cartel", cartel.cast("int")).withColumn("reserve", F.floor(d * random_share).cast("int"))
    q = F.col("out_degree") - F.col("generators") - F.col("same_year") - F.col("cartel")
    return out.withColumn("q", F.when(q > F.col("reserve"), q - F.col("reserve")).otherwise(q).cast("int"))


def split_hops(agents: DataFrame) -> DataFrame:
    """agents(agent, q, alpha, n1, n2) adds c1 and c2."""
    first, second = hop_split(F.col("q"), F.col("alpha"), F.col("n1"), F.col("n2"))
    return agents.withColumn("c1", first).withColumn("c2", second)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once and not again for every bin that reads it."""
    return F.transform(F.array(value), use)[0]


def bin_targets(total: Column, probabilities: list[float], bounds: list[int], draw) -> Column:
    """Targets by bin before sizes count: rounded shares in order, then leftover units to bins of random years 1 to 5.

    draw(unit) is the uniform of a leftover unit (a column).
    """
    bins = len(probabilities)
    p = F.array(*map(F.lit, probabilities))

    def share(acc: Column, b: Column) -> Column:
        x = F.least(F.round(total * F.element_at(p, b + 1)).cast("int"), acc["left"])
        return F.struct((acc["left"] - x).cast("int").alias("left"), F.concat(acc["out"], F.array(x.cast("int"))).alias("out"))

    start = F.struct(total.cast("int").alias("left"), F.array().cast("array<int>").alias("out"))
    shared = F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), start, share)

    def units(s: Column) -> Column:
        return F.transform(F.when(s["left"] > 0, F.sequence(F.lit(1), s["left"])).otherwise(F.array().cast("array<int>")), lambda i: bin_index(pick(draw(i), 5) + 1, bounds))

    return _once(shared, lambda s: _once(units(s), lambda found: F.transform(s["out"], lambda x, b: (x + F.size(F.filter(found, lambda v: v == b))).cast("int"))))


def rebalance(targets: Column, sizes: Column) -> Column:
    """Excess of each bin in turn moves to the nearest lower bins with room, then to higher ones."""

    def settle(t: Column, b: Column) -> Column:
        room = F.lit(0)
        excess = F.greatest(F.element_at(t, b + 1) - F.element_at(sizes, b + 1), room)
        lower = F.when(b > 0, F.reverse(F.sequence(F.lit(0), b - 1))).otherwise(F.array().cast("array<int>"))
        last = F.size(t) - 1
        higher = F.when(b < last, F.sequence(b + 1, last)).otherwise(F.array().cast("array<int>"))

        def move(acc: Column, j: Column) -> Column:
            x = F.least(acc["left"], F.greatest(F.element_at(sizes, j + 1) - F.element_at(t, j + 1), F.lit(0)))
            return F.struct((acc["left"] - x).cast("int").alias("left"), F.concat(acc["moves"], F.array(F.struct(j.alias("j"), x.cast("int").alias("x")))).alias("moves"))

        start = F.struct(excess.cast("int").alias("left"), F.array().cast("array<struct<j:int,x:int>>").alias("moves"))
        done = F.aggregate(F.concat(lower, higher), start, move)

        def moved(d: Column, x: Column, i: Column) -> Column:
            gain = F.aggregate(F.filter(d["moves"], lambda m: m["j"] == i), F.lit(0), lambda a, m: a + m["x"])
            return F.when(i == b, x - (excess - d["left"])).otherwise(x + gain).cast("int")

        return _once(done, lambda d: F.transform(t, lambda x, i: moved(d, x, i)))

    return F.aggregate(F.sequence(F.lit(0), F.size(targets) - 1), targets, settle)


def bin_quotas(groups: DataFrame, probabilities: list[float], bounds: list[int], draw) -> DataFrame:
    """groups(agent, hop, total, sizes array<int>) -> agent, hop, bin, quota."""
    targets = groups.withColumn("targets", bin_targets(F.col("total"), probabilities, bounds, draw))
    settled = targets.withColumn("settled", rebalance(F.col("targets"), F.col("sizes")))
    out = settled.select("agent", "hop", F.posexplode("settled").alias("bin", "quota"), "sizes")
    return out.select("agent", "hop", "bin", F.least("quota", F.element_at("sizes", F.col("bin") + 1)).alias("quota"))


def size_arrays(counts: DataFrame, bins: int) -> DataFrame:
    """(agent, hop, bin, n) -> agent, hop, sizes: one entry a bin."""
    sums = [F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("n"))), F.lit(0)).cast("int") for b in range(bins)]
    return counts.groupBy("agent", "hop").agg(F.array(*sums).alias("sizes"))
