"""Delimited and Parquet inputs. Schemas are explicit; headers are resolved by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CLONAL, NODELIST, PLANTED
from ..functions.scores import MAX_CITATIONS


def delimiter(spark: SparkSession, path: str) -> str:
    """Comma, tab or space, whichever the first line has, in this order."""
    first = spark.read.text(path).first()
    for mark in (",", "\t", " "):
        if first is not None and mark in first[0]:
            return mark
    raise ValueError(f"{path}: no comma, tab or space in the first line")


def header_positions(spark: SparkSession, path: str) -> dict[str, int]:
    """Position of each column name; of equal names the last counts."""
    return {name: i for i, name in enumerate(spark.read.text(path).first()[0].split(delimiter(spark, path)))}


def header_names(spark: SparkSession, path: str) -> dict[int, str]:
    return dict(enumerate(spark.read.text(path).first()[0].split(delimiter(spark, path))))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, named by the header; Parquet as it is."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    mark = delimiter(spark, path)
    names = spark.read.text(path).first()[0].split(mark)
    schema = ", ".join(f"`{n}` STRING" for n in names)
    return spark.read.csv(path, schema=schema, sep=mark, header=True, mode="PERMISSIVE", enforceSchema=True)


def _number(column: str, kind: str) -> Column:
    return F.trim(F.col(f"`{column}`").cast("string")).cast(kind)


def read_edgelist(spark: SparkSession, path: str) -> DataFrame:
    """source, target from the first two columns, whatever they are called; repeats stay."""
    rows = read_table(spark, path)
    a, b = rows.columns[:2]
    return rows.select(_number(a, "long").alias("source"), _number(b, "long").alias("target"))


def read_nodelist(spark: SparkSession, path: str) -> DataFrame:
    """Fresh nodes: node_id and year (publication_year is accepted), seeds with default fitness."""
    rows = read_table(spark, path)
    year = next((c for c in ("year", "publication_year") if c in rows.columns), None)
    if year is None or "node_id" not in rows.columns:
        raise ValueError(f"{path}: needs node_id and year")
    return rows.select(_number("node_id", "long").alias("node_id"), _number(year, "int").alias("year"), F.lit("seed").alias("type"), *seed_fitness())


def seed_fitness() -> list[Column]:
    return [F.lit(0).alias("fit_lag"), F.lit(1000).alias("fit_duration"), F.lit(1).alias("fit_value")]


def read_checkpoint(spark: SparkSession, path: str, keep_fitness: bool = False) -> DataFrame:
    """Nodes that an earlier run wrote. Fitness starts anew, as for seeds, unless keep_fitness."""
    kinds = {c.split()[0]: c.split()[1] for c in NODELIST.split(", ")}
    rows = read_table(spark, path)
    missing = {"node_id", "year", "type", "author_id"} - {*rows.columns}
    if missing:
        raise ValueError(f"{path}: lacks {sorted(missing)}")
    typed = rows.select(*(F.col(c) if kinds[c] == "STRING" else _number(c, kinds[c]).alias(c) for c in rows.columns if c in kinds))
    fitness = [F.col(a).alias(b) for a, b in (("fit_lag_duration", "fit_lag"), ("fit_peak_duration", "fit_duration"), ("fit_peak_value", "fit_value"))]
    return typed.select(*(c for c in typed.columns if not c.startswith("fit_") or c == "fit_weight"), *(fitness if keep_fitness else seed_fitness()))


def checkpoint_authors(nodes: DataFrame) -> DataFrame:
    """author_id, birth_year, pub_count, cartel_id (null: none) from a checkpoint's nodes."""
    cartel = F.max(F.when(F.col("cartel_id") != -1, F.col("cartel_id"))) if "cartel_id" in nodes.columns else F.lit(None).cast("int")
    return nodes.groupBy("author_id").agg(F.min("year").alias("birth_year"), F.count("*").alias("pub_count"), cartel.alias("cartel_id"))


def next_author_id(authors: DataFrame) -> int:
    return (authors.agg(F.max("author_id")).first()[0] or -1) + 1


def read_recency_table(spark: SparkSession, path: str) -> DataFrame:
    """age, count; ages over 0; of repeated ages the last line counts."""
    rows = read_table(spark, path)
    a, b = rows.columns[:2]
    lined = rows.select(_number(a, "int").alias("age"), _number(b, "long").alias("count")).withColumn("line", F.monotonically_increasing_id())
    return lined.where("age > 0").groupBy("age").agg(F.max_by("count", "line").alias("count"))


def read_bag(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """value: the second column; with most, a larger value is refused."""
    rows = read_table(spark, path)
    values = rows.select(_number(rows.columns[1], "int").alias("value"))
    if most is not None and values.where(F.col("value") > most).limit(1).count():
        raise ValueError(f"{path}: a value is over {most}")
    return values


def read_out_degree_bag(spark: SparkSession, path: str) -> DataFrame:
    return read_bag(spark, path, MAX_CITATIONS)


def read_planted(spark: SparkSession, path: str) -> DataFrame:
    """Known columns with their types, and line_no (2 for the first row)."""
    rows = read_table(spark, path)
    names = {c: c.replace("fitness_", "fit_") for c in rows.columns}
    known = [(c, n) for c, n in names.items() if n in PLANTED]
    numbered = rows.coalesce(1).withColumn("line_no", F.monotonically_increasing_id() + 2)
    return numbered.select(F.col("line_no").cast("int").alias("line_no"), *(_number(c, PLANTED[n]).alias(n) for c, n in known))


def read_clonal(spark: SparkSession, path: str) -> DataFrame:
    """One row: for each known column the last line that has a value."""
    rows = read_table(spark, path)
    names = {c: c.replace("fitness_", "fit_") for c in rows.columns}
    known = [(c, n) for c, n in names.items() if n in CLONAL]
    lined = rows.coalesce(1).withColumn("_line", F.monotonically_increasing_id())
    value = lambda c, n: _number(c, CLONAL[n])
    return lined.agg(*(F.max_by(value(c, n), F.when(value(c, n).isNotNull(), F.col("_line"))).alias(n) for c, n in known))


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    """node_id, cluster_id (or comm_id, if there is no cluster_id); rows that are too short are skipped."""
    rows = read_table(spark, path)
    cluster = next((c for c in ("cluster_id", "comm_id") if c in rows.columns), None)
    if cluster is None or "node_id" not in rows.columns:
        raise ValueError(f"{path}: needs node_id and cluster_id or comm_id")
    return rows.select(_number("node_id", "long").alias("node_id"), _number(cluster, "long").alias("cluster_id")).where("node_id is not null and cluster_id is not null")


def with_communities(nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """Clusters of graph nodes; unknown ids of the file take no part."""
    return nodes.drop("cluster_id").join(communities, "node_id", "left")
