"""Degrees, node sets, h-index, metrics and edge bookkeeping.

edges(source, target[, year]) is a directed multigraph; nodes(node_id, year, ...) holds attributes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import bin_index, power_score
from ..plans.state import keep


def node_set(edges: DataFrame) -> DataFrame:
    """Ids that occur in an edge."""
    return edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()


def graph_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with an edge; the others are no part of the graph."""
    return nodes.join(node_set(edges), "node_id", "left_semi")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, in_degree, out_degree, parallel edges counted. One exchange: both ends are summed together."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    counts = ends.groupBy(F.col("e.node_id").alias("node_id")).agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return nodes.select("node_id").join(counts, "node_id", "left").select("node_id", zero("i").alias("in_degree"), zero("o").alias("out_degree"))


def in_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    counts = edges.groupBy(F.col("target").alias("node_id")).agg(F.count("*").alias("n"))
    return nodes.select("node_id").join(counts, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("in_degree"))


def newest(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.max("year").alias("max_year"), F.max("node_id").alias("max_node"))


def author_h_index(nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """author_id, h. Papers outside the graph count as uncited."""
    papers = nodes.select("author_id", "node_id").join(degree, "node_id", "left").select("author_id", F.coalesce("in_degree", F.lit(0)).alias("d"))
    # counts of papers by citations bound what a prolific author brings into one window
    counted = papers.groupBy("author_id", "d").agg(F.count("*").alias("n"))
    reach = F.sum("n").over(Window.partitionBy("author_id").orderBy(F.col("d").desc()))
    # with c papers of at least d citations each, min(c, d) papers have that many
    return counted.withColumn("h", F.least(reach, "d")).groupBy("author_id").agg(F.max("h").alias("h"))


def seed_reputations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """initial_author_reputation of fresh nodes: the h-index of the author's papers up to the node's year, by final degrees.

    A paper of g citations counts for the levels 1 to min(g, the author's final h-index). The d-th paper of
    level d, by year, is when the author reaches d; so levels are counted, papers never meet each other.
    """
    degree = keep(in_degrees(nodes, edges), "degree")
    final = author_h_index(nodes, degree)
    papers = nodes.select("node_id", "author_id", "year").join(degree, "node_id").join(final, "author_id")
    levels = papers.where("least(in_degree, h) > 0").select("author_id", "year", F.explode(F.sequence(F.lit(1).cast("long"), F.least("in_degree", "h"))).alias("level"))
    counts = levels.groupBy("author_id", "level", "year").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("author_id", "level").orderBy("year"))
    reached = counts.withColumn("so_far", so_far).where("so_far >= level").groupBy("author_id", "level").agg(F.min("year").alias("year"))
    steps = reached.groupBy("author_id", "year").agg(F.count("*").alias("up")).unionByName(nodes.select("author_id", "year", F.lit(0).cast("long").alias("up")).distinct())
    h = F.sum("up").over(Window.partitionBy("author_id").orderBy("year"))
    by_year = steps.groupBy("author_id", "year").agg(F.sum("up").alias("up")).select("author_id", "year", h.cast("int").alias("initial_author_reputation"))
    return nodes.join(by_year, ["author_id", "year"], "left")


def node_reputation(nodes: DataFrame, h: DataFrame) -> DataFrame:
    return nodes.select("node_id", "author_id").join(h, "author_id").select("node_id", F.col("h").alias("reputation"))


def metrics(nodes: DataFrame, degree: DataFrame, h: DataFrame, fitness: Column) -> DataFrame:
    """node_id, year and the four power scores, whole numbers kept unnormalised so that sums are exact."""
    joined = nodes.join(degree, "node_id", "left").join(h, "author_id", "left")
    value = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select("node_id", "year", power_score(value("in_degree")).alias("pa"), power_score(fitness).alias("fit"), power_score(F.col("num_authors")).alias("na"), power_score(value("h")).alias("ar"))


def recency_histogram(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """age, count over edges between known nodes, ages over 0 only."""
    years = nodes.select("node_id", "year")
    s = years.select(F.col("node_id").alias("source"), F.col("year").alias("sy"))
    t = years.select(F.col("node_id").alias("target"), F.col("year").alias("ty"))
    aged = edges.join(s, "source").join(t, "target").select((F.col("sy") - F.col("ty")).alias("age"))
    return aged.where("age > 0").groupBy("age").agg(F.count("*").alias("count"))


def bin_probabilities(table: DataFrame, bounds: list[int]) -> DataFrame:
    """bin, weight, probability from (age, count); every bin is present."""
    bins = table.sparkSession.range(len(bounds)).select(F.col("id").cast("int").alias("bin"))
    sums = table.groupBy(bin_index(F.col("age"), bounds).alias("bin")).agg(F.sum("count").alias("weight"))
    out = bins.join(sums, "bin", "left").select("bin", F.coalesce("weight", F.lit(0)).alias("weight"))
    return out.withColumn("probability", F.col("weight") / F.sum("weight").over(Window.partitionBy()))


def distributed_rank(rows: DataFrame, slot: Column, *order: str) -> DataFrame:
    """Adds idx = 0, 1, ... in the order given. slot must not fall in that order: slots are counted first and
    rows are numbered within their slot, so no task sees all rows."""
    slotted = rows.withColumn("_slot", slot)
    counts = slotted.groupBy("_slot").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_slot", ahead.alias("_start"))
    within = F.row_number().over(Window.partitionBy("_slot").orderBy(*order)) - 1
    return slotted.join(starts, "_slot").withColumn("idx", (F.col("_start") + within).cast("long")).drop("_slot", "_start")


def dense_ids(nodes: DataFrame, width: int = 1 << 14) -> DataFrame:
    """node_id, idx = 0, 1, ... by ascending id."""
    return distributed_rank(nodes.select("node_id"), F.floor(F.col("node_id") / width), "node_id").select("node_id", "idx")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes."""
    ids = nodes.select("node_id")
    s, t = ids.withColumnRenamed("node_id", "source"), ids.withColumnRenamed("node_id", "target")
    return edges.join(s, "source", "left_semi").join(t, "target", "left_semi")


def dedup_edges(ranked: DataFrame) -> DataFrame:
    """(source, target, rank): the lowest rank of each pair stays; pre-aggregated, no window."""
    return ranked.groupBy("source", "target").agg(F.min("rank").alias("rank"))


def append_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new)


def publication_histogram(nodes: DataFrame) -> DataFrame:
    """pubs, authors: how many authors have so many publications."""
    per_author = nodes.groupBy("author_id").agg(F.count("*").alias("pubs"))
    return per_author.groupBy("pubs").agg(F.count("*").alias("authors"))


def lotka_deficits(histogram: DataFrame) -> DataFrame:
    """pubs, authors, expected, deficit for 2 <= pubs while round(n1 / pubs^2) >= 1."""
    one = histogram.where("pubs = 1").select(F.col("authors").alias("n1"))
    n1 = one.agg(F.coalesce(F.max("n1"), F.lit(0)).alias("n1"))
    slots = n1.select("n1", F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.ceil(F.sqrt(F.col("n1") * 2.0)).cast("int")))).alias("pubs"))
    wanted = slots.withColumn("expected", F.round(F.col("n1") / (F.col("pubs") * F.col("pubs")).cast("double")).cast("long")).where("expected >= 1")
    have = histogram.select("pubs", "authors")
    out = wanted.withColumn("pubs", F.col("pubs").cast("long")).join(have, "pubs", "left")
    return out.select("pubs", F.coalesce("authors", F.lit(0)).alias("authors"), "expected", (F.col("expected") - F.coalesce("authors", F.lit(0))).alias("deficit"))


def first_deficit(histogram: DataFrame) -> DataFrame:
    """The smallest publication count that is short of more than one author."""
    return lotka_deficits(histogram).where("deficit > 1").agg(F.min("pubs").alias("pubs"))


def stage_totals(timing: DataFrame) -> DataFrame:
    return timing.groupBy("label").agg(F.sum("ms").alias("ms"))
