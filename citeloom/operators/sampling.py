"""Weighted and uniform sampling without replacement, bags and index draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import pick
from ..functions.scores import MAX_CITATIONS, weighted_key
from ..plans.state import keep
from .graph import dense_ids, distributed_rank


def scored(candidates: DataFrame, metrics: DataFrame, weights: DataFrame) -> DataFrame:
    """candidates(agent, hop, bin, candidate) get score: the weighted sum of the four power scores, each
    divided by its sum over the (agent, hop, bin)."""
    m = metrics.select(F.col("node_id").alias("candidate"), "pa", "fit", "na", "ar")
    rows = candidates.join(m, "candidate").join(weights, "agent")
    group = Window.partitionBy("agent", "hop", "bin")
    parts = [F.col(w) * (F.col(x) / F.sum(x).over(group)) for w, x in (("w_pa", "pa"), ("w_fit", "fit"), ("w_na", "na"), ("w_ar", "ar"))]
    return rows.withColumn("score", parts[0] + parts[1] + parts[2] + parts[3]).select("agent", "hop", "bin", "candidate", "score")


def _first(rows: DataFrame, quota: Column, keys: tuple[str, ...], *order: Column | str) -> DataFrame:
    """Adds rank and keeps ranks up to the quota. Spark cuts groups before the shuffle where a literal bound is
    under the session's threshold; groups with larger quotas (MAX_CITATIONS at most) are ranked without that."""
    line = Window.partitionBy(*keys).orderBy(*order)
    bound = min(MAX_CITATIONS, int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")) - 1)

    def ranked(some: DataFrame, most: int) -> DataFrame:
        return some.withColumn("rank", F.row_number().over(line)).where((F.col("rank") <= F.col("_quota")) & (F.col("rank") <= most))

    quoted = rows.withColumn("_quota", quota)
    out = ranked(quoted.where(F.col("_quota") <= bound), bound)
    if bound < MAX_CITATIONS:
        out = out.unionByName(ranked(quoted.where(F.col("_quota") > bound), MAX_CITATIONS))
    return out.drop("_quota")


def weighted_top(rows: DataFrame, quota: Column, draw: Column, keys: tuple[str, ...] = ("agent", "hop", "bin")) -> DataFrame:
    """The quota largest keys ln(u) / score of each group."""
    return _first(rows.withColumn("_key", weighted_key(draw, F.col("score"))), quota, keys, F.col("_key").desc(), "candidate").drop("_key")


def uniform_top(rows: DataFrame, quota: Column, draw: Column, keys: tuple[str, ...] = ("agent", "hop", "bin")) -> DataFrame:
    return _first(rows.withColumn("_u", draw), quota, keys, "_u", "candidate").drop("_u")


def at_index(drawn: DataFrame, indexed: DataFrame, value: str, name: str) -> DataFrame:
    """drawn(..., idx) joined to indexed(idx, value); value is called name, idx goes."""
    return drawn.join(indexed.select("idx", F.col(value).alias(name)), "idx").drop("idx")


def from_bag(rows: DataFrame, bag: DataFrame, size: int, draw: Column, name: str) -> DataFrame:
    """bag(idx, value): each row of rows draws one value uniformly."""
    return at_index(rows.withColumn("idx", pick(draw, size)), bag, "value", name)


def random_fill(wanted: DataFrame, indexed: DataFrame, size: int, taken: DataFrame, draw, slack: int = 3, rounds: int = 4) -> DataFrame:
    """wanted(agent, f): f distinct uniform nodes an agent that are not in taken(agent, target).

    Indices are drawn, never the whole graph: a round draws f + slack of what is still missing, joins
    nodes by index, drops taken and repeated ones. Rounds draw new indices and double the slack until nobody misses any.
    Who misses some after the last round has taken most of the graph, so what it has left is no more than that: it is
    ranked by a draw for each node, and the agent gets f or all there is. draw(agent column, number column) is the uniform.
    """
    found = None
    excluded = taken.select("agent", "target").distinct()
    left = wanted.where("f > 0").select("agent", "f")
    for turn in range(rounds):
        if turn and not left.limit(1).count():
            return found
        numbers = F.sequence(F.lit(1), F.least(F.col("f") * (1 << min(turn, 6)) + slack, F.lit(4 * MAX_CITATIONS)).cast("int"))
        drawn = left.select("agent", "f", F.explode(numbers).alias("n")).withColumn("n", F.col("n") + turn * 100_000)
        hits = at_index(drawn.withColumn("idx", pick(draw(F.col("agent"), F.col("n")), size)), indexed, "node_id", "target")
        hits = hits.join(excluded if found is None else excluded.unionByName(found.select("agent", "target")), ["agent", "target"], "left_anti").groupBy("agent", "target", "f").agg(F.min("n").alias("n"))
        order = Window.partitionBy("agent").orderBy("n")
        new = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("f")).select("agent", "target", "n")
        found = new if found is None else found.unionByName(new)
        got = new.groupBy("agent").agg(F.count("*").alias("got"))
        left = left.join(got, "agent", "left").select("agent", (F.col("f") - F.coalesce("got", F.lit(0))).alias("f")).where("f > 0")
        left, found = keep(left, "left"), keep(found, "found")
    if not left.limit(1).count():
        return found
    free = left.crossJoin(indexed.select(F.col("node_id").alias("target"))).join(excluded.unionByName(found.select("agent", "target")), ["agent", "target"], "left_anti")
    # numbers below 0: no round draws them
    order = Window.partitionBy("agent").orderBy("_u", "target")
    ranked = free.withColumn("_u", draw(F.col("agent"), -1 - F.col("target"))).withColumn("rank", F.row_number().over(order)).where("rank <= f")
    return found.unionByName(ranked.select("agent", "target", (F.col("rank") + rounds * 100_000).cast(found.schema["n"].dataType).alias("n")))


def same_year_sources(agents: DataFrame, share: float, n: int, draw: Column) -> DataFrame:
    """floor(n * share) distinct agents: those with the smallest draws."""
    ranked = distributed_rank(agents.select("agent").withColumn("_u", draw), F.floor(F.col("_u") * 1024), "_u", "agent")
    return ranked.where(F.col("idx") < int(n * share)).select("agent")


def same_year_citations(agents: DataFrame, sources: DataFrame, draw: Column) -> DataFrame:
    """agent, target: every source cites one new node that is no source."""
    others = agents.select("agent").join(sources, "agent", "left_anti")
    indexed = dense_ids(others.select(F.col("agent").alias("node_id")))
    total = others.agg(F.count("*").alias("m"))
    drawn = sources.join(F.broadcast(total)).where("m > 0").withColumn("idx", pick(draw, F.col("m"))).drop("m")
    return at_index(drawn, indexed, "node_id", "target")
