"""A citation-like network over the order tables, for queries and tests.

An order is a paper, its customer the author, its year the publication year; it cites earlier orders
that contain the same part. SQL holds the same views as DuckDB text.
"""

from __future__ import annotations

from functools import cached_property
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .state import keep

NOW = 2001
#: How many orders back, within a part, a paper cites.
STEPS = (3, 7, 13)

SQL = """
nodes_all as materialized (select o_orderkey as node_id, year(o_orderdate) as year, o_custkey as author_id, cast(coalesce(na, 1) as bigint) as num_authors, c_nationkey as cluster_id
  from orders join customer on o_custkey = c_custkey
  left join (select l_orderkey, count(distinct l_suppkey) as na from lineitem group by l_orderkey) x on l_orderkey = o_orderkey),
part_x as materialized (select distinct l_partkey as p, o_orderkey as k, o_orderdate as d from lineitem join orders on l_orderkey = o_orderkey),
part_r as materialized (select *, row_number() over (partition by p order by d, k) as rn from part_x),
back as materialized (select p, rn - step as rn, k, d from part_r, (values (3), (7), (13)) s(step)),
edges_all as materialized (select distinct a.k as source, b.k as target from back a join part_r b on a.p = b.p and a.rn = b.rn and year(a.d) > year(b.d)),
edges as materialized (select source, target from edges_all join nodes_all on source = node_id where year <= 2000),
node_set as (select source as node_id from edges union select target from edges),
nodes as materialized (select n.* from nodes_all n semi join node_set g on n.node_id = g.node_id),
agents as (select node_id as agent, author_id from nodes_all where year = 2001),
authors as (select author_id, min(year) as birth_year, count(*) as pub_count from nodes group by author_id)
"""


class Views:
    """Tables as DataFrames, made when they are first asked for. What a query uses again and again is
    written to the shared folder once."""

    _made: ClassVar[dict[tuple[str, str], Views]] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Views:
        """The views of a folder, written once by an application: queries read the network, they don't rebuild it."""
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._made:
            cls._made[key] = cls(spark, sf_dir)
        return cls._made[key]

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def nodes_all(self) -> DataFrame:
        suppliers = self._table("lineitem").groupBy("l_orderkey").agg(F.size(F.collect_set("l_suppkey")).alias("na"))
        orders = self._table("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
        customers = self._table("customer").select("c_custkey", "c_nationkey")
        joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).join(suppliers, orders["o_orderkey"] == suppliers["l_orderkey"], "left")
        rows = joined.select(F.col("o_orderkey").alias("node_id"), "year", F.col("o_custkey").alias("author_id"), F.coalesce("na", F.lit(1)).cast("long").alias("num_authors"), F.col("c_nationkey").alias("cluster_id"))
        return keep(rows, "view_nodes_all", compact=True)

    @cached_property
    def _dated_edges(self) -> DataFrame:
        """source, target, y (the source's year). Each paper of a part looks back at the papers a few places before it: one
        window, no self-join."""
        orders = self._table("orders").select("o_orderkey", "o_orderdate")
        lines = self._table("lineitem").select("l_orderkey", "l_partkey")
        parts = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(F.col("l_partkey").alias("p"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d")).repartition("p").distinct()  # one exchange serves the window as well
        places = Window.partitionBy("p").orderBy("d", "k")
        back = [F.struct(F.lag("k", s).over(places).alias("k"), F.lag("d", s).over(places).alias("d")) for s in STEPS]
        looked = parts.select("k", "d", F.array(*back).alias("back"))
        cited = looked.select(F.col("k").alias("source"), F.year("d").alias("y"), F.explode("back").alias("b"))
        edges = cited.where(F.col("y") > F.year("b.d")).groupBy("source", F.col("b.k").alias("target")).agg(F.min("y").alias("y"))
        return keep(edges, "view_edges", compact=True)

    @cached_property
    def edges_all(self) -> DataFrame:
        return self._dated_edges.select("source", "target")

    @cached_property
    def edges(self) -> DataFrame:
        """A part of the table above, unless papers are by unknown customers."""
        known = self._table("customer").select("c_custkey")
        orders = self._table("orders")
        strangers = keep(orders.join(known, orders["o_custkey"] == known["c_custkey"], "left_anti").select(F.col("o_orderkey").alias("source")), "view_strangers")
        older = self._dated_edges.where(F.col("y") < NOW).select("source", "target")
        return older if strangers.isEmpty() else keep(older.join(strangers, "source", "left_anti"), "view_edges_old", compact=True)

    @cached_property
    def nodes(self) -> DataFrame:
        from ..operators.graph import graph_nodes

        return keep(graph_nodes(self.nodes_all, self.edges), "view_nodes", compact=True)

    @cached_property
    def adjacency(self) -> DataFrame:
        from ..operators.neighborhood import kept_adjacency

        return kept_adjacency(self.edges, "view_adjacency")

    @cached_property
    def agents(self) -> DataFrame:
        return self.nodes_all.where(F.col("year") == NOW).select(F.col("node_id").alias("agent"), "author_id")

    @cached_property
    def authors(self) -> DataFrame:
        return self.nodes.groupBy("author_id").agg(F.min("year").alias("birth_year"), F.count("*").alias("pub_count"))
