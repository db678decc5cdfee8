"""python -m citeloom.communities: communities of a network in CSV files, written as node_id,cluster_id."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.community import communities
from .plans.state import keep
from .sources.readers import read_table
from .sources.sinks import write_communities


def _columns(df: DataFrame, path: str, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return df.select(*(F.trim(F.col(f"`{n}`").cast("string")).alias(f"c{i}") for i, n in enumerate(names)))


def find(nodes: DataFrame, edges: DataFrame, objective: str, resolution: float) -> tuple[DataFrame, int]:
    """nodes(c0), edges(c0, c1) with ids of any kind -> (node_id, cluster_id), and how many edges had an
    unknown end. Ids get numbers once, in a written table; clusters are numbered by their first member."""
    numbered = keep(nodes.select("c0").distinct().withColumn("n", F.monotonically_increasing_id()), "numbers")
    a, b = numbered.select("c0", F.col("n").alias("source")), numbered.select(F.col("c0").alias("c1"), F.col("n").alias("target"))
    known = keep(edges.join(a, "c0").join(b, "c1").select("source", "target"), "known")
    ignored = edges.count() - known.count()
    found = communities(numbered.select(F.col("n").alias("node_id")), known, objective, resolution)
    return found.join(numbered.withColumnRenamed("n", "node_id"), "node_id").select(F.col("c0").alias("node_id"), "cluster_id"), ignored


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    for name in ("nodelist", "edgelist", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--node_col", default="node_id")
    p.add_argument("--source_col", default="source")
    p.add_argument("--target_col", default="target")
    p.add_argument("--directed", action="store_true", help="accepted; links count in both directions")
    p.add_argument("--resolution", type=float, default=0.01)
    p.add_argument("--objective", choices=("cpm", "modularity"), type=str.lower, default="cpm")
    c = p.parse_args(argv)
    spark = SparkSession.builder.appName("citeloom").getOrCreate()
    nodes = _columns(read_table(spark, c.nodelist), c.nodelist, c.node_col)
    edges = _columns(read_table(spark, c.edgelist), c.edgelist, c.source_col, c.target_col)
    found, ignored = find(nodes, edges, c.objective, c.resolution)
    if ignored:
        print(f"{ignored} edges with an unknown end were left out")
    found = keep(found, "found")
    print(f"{found.select('cluster_id').distinct().count()} communities")
    write_communities(found, c.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
