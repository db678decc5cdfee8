"""New agents: attributes, generators, planted and clonal overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import pick
from ..functions.scores import peak_fitness
from .graph import dense_ids, distributed_rank
from .sampling import at_index

WEIGHTS = ("w_pa", "w_fit", "w_na", "w_ar")


def sample_fitness(agents: DataFrame, draw, lag: tuple[int, int], duration: tuple[int, int], value: tuple[int, int]) -> DataFrame:
    """Adds fit_lag, fit_duration (uniform, both ends included) and fit_value (power law)."""

    def between(name: str, low: int, high: int) -> Column:
        return (pick(draw(name, "agent"), high - low + 1) + low).cast("int")

    return agents.withColumn("fit_lag", between("lag", *lag)).withColumn("fit_duration", between("duration", *duration)).withColumn("fit_value", peak_fitness(draw("peak", "agent"), *value))


def sample_alpha(agents: DataFrame, draw, use_alpha: bool, alpha: float, minimum: float = 0.0) -> DataFrame:
    u = draw("alpha", "agent")
    if not use_alpha:
        value = F.lit(-1.0)
    elif alpha == -1:
        value = F.round(u * 1000) / 1000
    elif minimum > 0:
        value = F.lit(minimum) + u * (1 - minimum)
    else:
        value = F.lit(float(alpha))
    return agents.withColumn("alpha", value)


def sample_weights(agents: DataFrame, draw, fixed: tuple[float, float, float, float]) -> DataFrame:
    """The four weights over their sum; one -1 among the fixed ones makes all four uniform draws."""
    raw = [draw(w, "agent") if -1 in fixed else F.lit(float(x)) for w, x in zip(WEIGHTS, fixed, strict=True)]
    rows = agents.select("*", *(r.alias(f"_{w}") for w, r in zip(WEIGHTS, raw, strict=True)))
    total = F.col("_w_pa") + F.col("_w_fit") + F.col("_w_na") + F.col("_w_ar")
    return rows.select(*agents.columns, *((F.col(f"_{w}") / total).alias(w) for w in WEIGHTS))


def eligible_generators(metrics: DataFrame, now: int, start_year: int, recency: int, degree_percent: float, fitness_percent: float, fitness_max: int) -> DataFrame:
    """metrics(node_id, year, type, in_degree, fitness) -> node_id of recent nodes that reach both cuts.

    A cut is the value at index int((n - 1) * percent / 100) of the descending order; ties at it stay.
    In the first years seed nodes rank with the largest fitness.
    """
    recent = metrics.where(F.lit(now) - F.col("year") <= recency)
    fitness = F.when((F.col("type") == "seed") & F.lit(now - start_year <= recency), F.lit(fitness_max)).otherwise(F.col("fitness"))
    rows = recent.select("node_id", "in_degree", fitness.alias("fitness"))

    def cut(column: str, percent: float) -> DataFrame:
        # values are counted before they are ordered: few distinct values, whatever the number of nodes
        counts = rows.groupBy(column).agg(F.count("*").alias("n"))
        reach = F.sum("n").over(Window.orderBy(F.col(column).desc()))
        total = F.sum("n").over(Window.partitionBy())
        index = F.floor((total - 1) * percent / 100)
        return counts.withColumn("reach", reach).withColumn("index", index).where("reach > index").agg(F.max(column).alias(f"{column}_cut"))

    return rows.join(F.broadcast(cut("in_degree", degree_percent))).join(F.broadcast(cut("fitness", fitness_percent))).where("in_degree >= in_degree_cut and fitness >= fitness_cut").select("node_id")


def pick_generators(agents: DataFrame, indexed: DataFrame, size: int, draw: Column) -> DataFrame:
    """agent, generator: a uniform node of indexed(node_id, idx)."""
    return at_index(agents.select("agent").withColumn("idx", pick(draw, size)), indexed, "node_id", "generator")


def choose_generators(agents: DataFrame, everyone: DataFrame, n_all: int, eligible: DataFrame, n_eligible: int, probability: float, draw) -> DataFrame:
    """With the given probability a uniform eligible node, else any node of the graph; no eligible node, no generator."""
    chosen = agents.select("agent", (draw("eligible", "agent") < probability).alias("_e"))
    first = pick_generators(chosen.where("_e"), eligible, n_eligible, draw("generator", "agent")) if n_eligible else None
    rest = pick_generators(chosen.where("not _e"), everyone, n_all, draw("generator", "agent"))
    return rest if first is None else rest.unionByName(first)


def inherit_cluster(picks: DataFrame, nodes: DataFrame) -> DataFrame:
    """agent, generator, cluster_id of the generator."""
    own = nodes.select(F.col("node_id").alias("generator"), "cluster_id")
    return picks.join(own, "generator", "left").select("agent", "generator", "cluster_id")


def plant(agents: DataFrame, planted: DataFrame, relative_year: int, draw: Column) -> DataFrame:
    """planted(year, line_no, ...) of this relative year meet random distinct agents; present values replace the agent's."""
    lines = planted.where(F.col("year") == relative_year)
    place = lines.withColumn("_n", F.row_number().over(Window.orderBy("line_no"))).drop("year")
    drawn = agents.withColumn("_u", draw)
    order = distributed_rank(drawn, F.floor(F.col("_u") * 1024), "_u", "agent").withColumn("_n", F.col("idx") + 1).drop("_u", "idx")
    overrides = [c for c in place.columns if c in agents.columns]
    renamed = place.select("_n", "line_no", *(F.col(c).alias(f"_{c}") for c in overrides))
    joined = order.join(F.broadcast(renamed), "_n", "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in overrides else F.col(c) for c in agents.columns), F.col("line_no").alias("planted_line"))


def override_clonal(agents: DataFrame, clonal: DataFrame, which: Column) -> DataFrame:
    """The values that the one-row clonal table has replace those of the agents that which picks."""
    present = [c for c in clonal.columns if c in agents.columns]
    one = clonal.select(*(F.col(c).alias(f"_{c}") for c in present))
    return agents.join(F.broadcast(one)).select(*(F.when(which, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in present else F.col(c) for c in agents.columns))


def schedule_cartel_authors(agents: DataFrame, authors: DataFrame) -> DataFrame:
    """agent, author_id: each author with a cartel id (0 counts) gets one agent, lowest ids first."""
    a = dense_ids(authors.where("cartel_id >= 0").select(F.col("author_id").alias("node_id")))
    b = dense_ids(agents.select(F.col("agent").alias("node_id")))
    return b.withColumnRenamed("node_id", "agent").join(a.withColumnRenamed("node_id", "author_id"), "idx").select("agent", "author_id")
