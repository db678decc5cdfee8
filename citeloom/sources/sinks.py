"""Writers of edge lists, node lists, communities and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import NODE_COLUMNS

# What the node list shows for absent values and for the agent-only columns of seeds.
AGENT_ONLY = ("alpha", "pa_weight", "fit_weight", "num_authors_weight", "author_reputation_weight", "assigned_out_degree", "planted_nodes_line_number", "sampled_neighborhood_size", "fully_random_citations")
NO_GENERATORS = "no_generators"
RENAMED = {"fit_lag": "fit_lag_duration", "fit_value": "fit_peak_value", "fit_duration": "fit_peak_duration", "w_pa": "pa_weight", "w_fit": "fit_weight", "w_na": "num_authors_weight", "w_ar": "author_reputation_weight"}


def nodelist_rows(nodes: DataFrame, degree: DataFrame, reputation: DataFrame | None, authors: DataFrame | None) -> DataFrame:
    """The 24 columns of the node list. The group id is that of the author; absent values become -1."""
    rows = nodes
    for a, b in RENAMED.items():
        if a in rows.columns:
            rows = rows.withColumnRenamed(a, b)
    rows = rows.drop("in_degree", "out_degree", "final_author_reputation", "cartel_id").join(degree, "node_id")
    rows = rows.join(reputation.select("author_id", F.col("h").alias("final_author_reputation")), "author_id", "left") if reputation is not None else rows.withColumn("final_author_reputation", F.lit(-1))
    rows = rows.join(authors.select("author_id", "cartel_id"), "author_id", "left") if authors is not None else rows.withColumn("cartel_id", F.lit(-1))
    seed = F.col("type") == "seed"

    def shown(name: str) -> Column:
        if name == "generator_node_string":
            value = F.coalesce(F.col(name), F.lit(NO_GENERATORS)) if name in rows.columns else F.lit(NO_GENERATORS)
            return F.when(seed, NO_GENERATORS).otherwise(value)
        value = F.coalesce(F.col(name), F.lit(-1)) if name in rows.columns else F.lit(-1)
        return F.when(seed, F.lit(-1)).otherwise(value) if name in AGENT_ONLY else value

    kind = F.when(seed, "seed").otherwise("agent")
    return rows.select(*(kind.alias("type") if c == "type" else shown(c).alias(c) for c in NODE_COLUMNS))


def write_csv(df: DataFrame, path: str, *order: str, single: bool = True) -> None:
    """A CSV folder with a header, rows in order; single: one part file, as other tools expect."""
    out = df.orderBy(*order)
    (out.coalesce(1) if single else out).write.mode("overwrite").csv(path, header=True)


def write_edgelist(edges: DataFrame, path: str, single: bool = True) -> None:
    rank = ["rank"] if "rank" in edges.columns else []
    out = edges.orderBy("source", *rank, "target").select("source", "target")
    (out.coalesce(1) if single else out).write.mode("overwrite").csv(path, header=True)


def six_digits(value: Column) -> Column:
    """A double as text with six significant digits."""
    return F.format_string("%.6g", value)


def write_nodelist(rows: DataFrame, path: str, single: bool = True) -> None:
    doubles = {n for n, kind in rows.dtypes if kind == "double"}
    write_csv(rows.select(*((F.when(F.col(c) == F.floor(c), F.col(c).cast("long").cast("string")).otherwise(six_digits(F.col(c))).alias(c) if c in doubles else F.col(c)) for c in rows.columns)), path, "node_id", single=single)


def write_communities(communities: DataFrame, path: str) -> None:
    write_csv(communities.select("node_id", "cluster_id"), path, "node_id")


def write_parquet(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path) if partitions else df.write.mode("overwrite").parquet(path)
