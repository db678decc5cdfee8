"""One query for each operator over the views, and the same query as DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rng, scores
from ..operators import agents as ag
from ..operators import authors as au
from ..operators import cartel as ca
from ..operators import community as co
from ..operators import graph as gr
from ..operators import neighborhood as ne
from ..operators import quota as qu
from ..operators import sampling as sa
from ..sources import readers, sinks
from .state import keep, kept_path
from .views import NOW, SQL, Views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BOUNDS = [1, 2, 3, 5]
CAP = 20
FITNESS_MAX = 1000


def query(sql: str | None = None) -> Callable[[Callable[[Views], DataFrame]], Callable[[Views], DataFrame]]:
    """Register a function of the views; sql: what follows the views' WITH list."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views.of(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = f"with recursive {SQL}{sql}"
        return f

    return add


def u(purpose: str, *parts: Column | str | int) -> Column:
    return rng.u(purpose, NOW, *parts)


def us(purpose: str, *parts: str | int) -> str:
    return rng.u_sql(purpose, NOW, *parts)


# --- shared steps -------------------------------------------------------------------------------------------

BIN_SQL = "case when {a} >= 1 and {a} < 2 then 0 when {a} >= 2 and {a} < 3 then 1 when {a} >= 3 and {a} < 5 then 2 else 3 end"
POWER_SQL = "(greatest(pow({x}::double, 3.0::double), 1.0::double) + 1.0::double)"

DEG_SQL = ", deg as (select node_id, coalesce(i, 0) as in_degree from nodes left join (select target, count(*) as i from edges group by target) on target = node_id)"
H_SQL = ", ranked as (select author_id, in_degree, row_number() over (partition by author_id order by in_degree desc) as rn from nodes join deg using (node_id)), h as (select author_id, count(*) filter (in_degree >= rn) as h from ranked group by author_id)"
FIT_SQL = f""", fit0 as (select node_id, year, floor({us('lag', 'node_id')} * 4)::int as lag, floor({us('duration', 'node_id')} * 5)::int + 1 as dur,
    floor(pow((pow(1000.0::double, -2) - pow(1.0::double, -2)) * {us('peak', 'node_id')} + pow(1.0::double, -2), -0.5::double))::int as peak from nodes),
  fit as (select node_id, lag, dur, peak, case when year + lag > {NOW} then 1 when year + lag + dur >= {NOW} then peak
    else floor(peak / pow(({NOW} - year - lag - dur + 1)::double, 3)) end::int as fitness from fit0)"""
INDEX_SQL = ", idx as (select node_id, row_number() over (order by node_id) - 1 as idx from nodes), total as (select count(*) as n from nodes)"
PICK_SQL = INDEX_SQL + f", picks as (select agent, node_id as generator from (select agent, floor({us('generator', 'agent')} * n)::bigint as i from agents, total) join idx on idx = i)"
ADJ_SQL = PICK_SQL + ", adj as materialized (select a, b, row_number() over (partition by a order by b) - 1 as place, count(*) over (partition by a) as d from (select source as a, target as b from edges union select target, source from edges) where a <> b)"
NEAR_SQL = ADJ_SQL + ", near as materialized (select agent, b as candidate from picks join adj on a = generator)"


def places_sql(name: str, owners: str, purpose: str, *names: str) -> str:
    """A CTE (agent, node, place, i): the drawn order of each owner's neighbours, owners(agent, node)."""
    drawn = f"floor({rng.line_sql('sa', 'sb', 'n')} * d / {rng.PRIME}::double)::bigint"
    return (
        f", {name}_o as materialized (select agent, node, d, floor({us(purpose + '_a', *names)} * {rng.SEEDS})::bigint as sa, floor({us(purpose + '_b', *names)} * {rng.SEEDS})::bigint as sb from {owners} join adj on a = node and place = 0),"
        f" {name} as materialized (select agent, node, place, row_number() over (partition by agent, node order by o, place) - 1 as i from"
        f" (select agent, node, place, {rng.line_sql('sa', 'sb', 'place')} as o from (select agent, node, sa, sb, unnest(range(0, d)) as place from {name}_o where d <= {4 * CAP})"
        f" union all select agent, node, place, min(n) as o from (select agent, node, {drawn} as place, n from (select agent, node, d, sa, sb, unnest(range(1, 2 * d + 1)) as n from {name}_o where d > {4 * CAP})"
        f" union all select agent, node, unnest(range(0, d)), 2 * d + 1 from {name}_o where d > {4 * CAP}) group by all))"
    )


CAP1_SQL = NEAR_SQL + ", own1 as (select agent, generator as node from picks)" + places_sql("places1", "own1", "cap1", "agent") + f", cap1 as materialized (select agent, node as generator, b as candidate from places1 p join adj on a = node and adj.place = p.place where i < {CAP})"
CAP2_SQL = (
    CAP1_SQL + ", own2 as (select agent, candidate as node from cap1)" + places_sql("places2", "own2", "cap2c", "agent", "node")
    + f""", lines as (select agent, candidate as node, coalesce(sum(d) over (partition by agent order by {us('cap2p', 'agent', 'candidate')}, candidate rows between unbounded preceding and 1 preceding), 0) as ahead from cap1 join adj on a = candidate and place = 0),
  fresh as (select p.agent, b as candidate, min(ahead + i) as slot from places2 p join lines using (agent, node) join adj on a = node and adj.place = p.place
    anti join near n on n.agent = p.agent and n.candidate = b anti join picks g on g.agent = p.agent and g.generator = b group by 1, 2),
  cap2 as materialized (select agent, candidate, n from (select *, row_number() over (partition by agent order by slot) as n from fresh) where n <= {CAP}),
  hops as (select agent, 1 as hop, candidate from cap1 union all select agent, 2, candidate from cap2)"""
)
FAR_SQL = "(select c.agent, b as candidate from near c join adj on a = c.candidate anti join near n on n.agent = c.agent and n.candidate = b anti join picks p on p.agent = c.agent and p.generator = b)"
BINNED_SQL = CAP2_SQL + f", binned as (select agent, hop, candidate, {BIN_SQL.format(a=f'({NOW} - year)')} as bin from hops join nodes on node_id = candidate)"
METRIC_SQL = (
    DEG_SQL + H_SQL + FIT_SQL + f""", metric as (select node_id, {POWER_SQL.format(x='in_degree')} as pa, {POWER_SQL.format(x='fitness')} as fit, {POWER_SQL.format(x='num_authors')} as na, {POWER_SQL.format(x='h')} as ar
  from nodes join deg using (node_id) join fit using (node_id) join h using (author_id))"""
)
WEIGHT_SQL = f", w0 as (select agent, {us('w_pa', 'agent')} as a, {us('w_fit', 'agent')} as b, {us('w_na', 'agent')} as c, {us('w_ar', 'agent')} as d from agents), weights as (select agent, a / (a + b + c + d) as w_pa, b / (a + b + c + d) as w_fit, c / (a + b + c + d) as w_na, d / (a + b + c + d) as w_ar from w0)"
SCORED_SQL = (
    BINNED_SQL + METRIC_SQL + WEIGHT_SQL + """, scored as (select agent, hop, bin, candidate, w_pa * (pa / sum(pa) over g) + w_fit * (fit / sum(fit) over g) + w_na * (na / sum(na) over g) + w_ar * (ar / sum(ar) over g) as score
  from binned join metric on node_id = candidate join weights using (agent) window g as (partition by agent, hop, bin))"""
)
CARTEL_SQL = ", cart as (select author_id, case when author_id % 100 = 1 then 1 else 0 end as cartel_id from authors where author_id % 100 in (1, 2)), ca as (select agent, author_id, generator from agents join cart using (author_id) join picks using (agent) where cartel_id > 0), partners as (select agent, c.author_id as partner from ca a join cart c on c.cartel_id = 1 and c.author_id <> a.author_id)"
CARTEL_IN_SQL = CAP2_SQL + CARTEL_SQL + f", cin as (select agent, partner, hop, candidate from (select agent, author_id as partner, hop, candidate, row_number() over (partition by agent, author_id order by hop, {us('cartel', 'agent', 'candidate')}, candidate) as n from hops join nodes on node_id = candidate semi join partners p on p.agent = hops.agent and p.partner = author_id) where n = 1)"


def degree_table(v: Views) -> DataFrame:
    return gr.in_degrees(v.nodes, v.edges)


def fitness_table(v: Views) -> DataFrame:
    drawn = ag.sample_fitness(v.nodes.withColumnRenamed("node_id", "agent"), u, (0, 3), (1, 5), (1, FITNESS_MAX)).withColumnRenamed("agent", "node_id")
    return drawn.withColumn("fitness", scores.decayed_fitness(F.col("fit_value"), F.col("year"), F.col("fit_lag"), F.col("fit_duration"), NOW))


def metric_table(v: Views) -> DataFrame:
    return gr.metrics(fitness_table(v), degree_table(v), gr.author_h_index(v.nodes, degree_table(v)), F.col("fitness"))


def generator_picks(v: Views) -> DataFrame:
    indexed = keep(gr.dense_ids(v.nodes), "index")
    return ag.pick_generators(v.agents, indexed, indexed.count(), u("generator", "agent"))


def placed_hops(v: Views) -> DataFrame:
    return ne.placed_hops(generator_picks(v), v.adjacency, CAP, u)


def capped_hops(v: Views) -> DataFrame:
    return placed_hops(v).drop("place")


def binned_hops(v: Views) -> DataFrame:
    return ne.binned(capped_hops(v), v.nodes, NOW, BOUNDS)


def agent_weights(v: Views) -> DataFrame:
    return ag.sample_weights(v.agents, u, (-1, -1, -1, -1)).select("agent", *ag.WEIGHTS)


def scored_table(v: Views) -> DataFrame:
    metrics = keep(metric_table(v), "metrics", compact=True)
    return sa.scored(keep(binned_hops(v), "bins", compact=True), metrics, agent_weights(v))


def cartel_table(v: Views) -> DataFrame:
    return v.authors.where("author_id % 100 in (1, 2)").select("author_id", F.when(F.col("author_id") % 100 == 1, 1).otherwise(0).alias("cartel_id"))


def cartel_agents(v: Views) -> DataFrame:
    real = cartel_table(v).where("cartel_id > 0").select("author_id")
    return v.agents.join(real, "author_id", "left_semi").join(generator_picks(v), "agent")


def group_hops(v: Views, members: DataFrame) -> DataFrame:
    """Both hops of these agents only: an agent's hops don't depend on other agents."""
    return ne.hops(members.select("agent", "generator"), v.adjacency, CAP, u)


def cartel_draw(candidate: Column) -> Column:
    return u("cartel", "agent", candidate)


# --- metrics ------------------------------------------------------------------------------------------------


@query(" select node_id, coalesce(i, 0)::bigint as in_degree, coalesce(o, 0)::bigint as out_degree from nodes left join (select target, count(*) as i from edges group by target) on target = node_id left join (select source, count(*) as o from edges group by source) on source = node_id")
def degree_counts(v: Views) -> DataFrame:
    return gr.degrees(v.nodes, v.edges)


@query(" select node_id from node_set")
def node_set(v: Views) -> DataFrame:
    return gr.node_set(v.edges)


@query(" select max(year) as max_year, max(node_id) as max_node from nodes")
def max_year_node(v: Views) -> DataFrame:
    return gr.newest(v.nodes)


@query(DEG_SQL + H_SQL + " select author_id, h from h")
def author_h_index(v: Views) -> DataFrame:
    return gr.author_h_index(v.nodes, degree_table(v))


@query(DEG_SQL + H_SQL + " select node_id, h as reputation from nodes join h using (author_id)")
def node_reputation(v: Views) -> DataFrame:
    return gr.node_reputation(v.nodes, gr.author_h_index(v.nodes, degree_table(v)))


@query(FIT_SQL + " select node_id, fitness from fit")
def fitness_decay(v: Views) -> DataFrame:
    return fitness_table(v).select("node_id", "fitness")


@query(METRIC_SQL + " select * from metric")
def power_scores(v: Views) -> DataFrame:
    return metric_table(v).drop("year")


@query(DEG_SQL + f" select node_id, round({POWER_SQL.format(x='in_degree')} / sum({POWER_SQL.format(x='in_degree')}) over (), 12) as share, round(4.0::double * tanh(pow(in_degree::double, 3.0::double) / 50.0::double * 0.25::double), 9) as tanh_score from deg")
def normalised_scores(v: Views) -> DataFrame:
    score = scores.power_score(F.col("in_degree"))
    total = degree_table(v).agg(F.sum(score).alias("total"))
    return degree_table(v).join(F.broadcast(total)).select("node_id", F.round(score / F.col("total"), 12).alias("share"), F.round(scores.tanh_score(F.col("in_degree"), 4.0, 50.0), 9).alias("tanh_score"))


@query(FIT_SQL + " select node_id, lag as fit_lag, dur as fit_duration, peak as fit_value from fit")
def peak_fitness_sample(v: Views) -> DataFrame:
    return fitness_table(v).select("node_id", "fit_lag", "fit_duration", "fit_value")


@query(f" select agent, round({us('alpha', 'agent')} * 1000) / 1000 as free, 0.2::double + {us('alpha', 'agent')} * 0.8::double as bounded, 0.35::double as fixed, -1.0::double as unused from agents")
def alpha_sample(v: Views) -> DataFrame:
    kinds = {"free": (True, -1, 0), "bounded": (True, 0.5, 0.2), "fixed": (True, 0.35, 0), "unused": (False, 0.35, 0)}
    out = v.agents.select("agent")
    for name, (use, alpha, least) in kinds.items():
        out = ag.sample_alpha(out, u, use, alpha, least).withColumnRenamed("alpha", name)
    return out


@query(WEIGHT_SQL + " select agent, round(w_pa, 9) as w_pa, round(w_fit, 9) as w_fit, round(w_na, 9) as w_na, round(w_ar, 9) as w_ar from weights")
def weight_sample(v: Views) -> DataFrame:
    return agent_weights(v).select("agent", *(F.round(w, 9).alias(w) for w in ag.WEIGHTS))


BAG_SQL = ", bag as (select row_number() over (order by source) - 1 as idx, n as value from (select source, count(*) as n from edges_all group by source)), bag_n as (select count(*) as n from bag)"


@query(BAG_SQL + f" select agent, value as out_degree from (select agent, floor({us('out_degree', 'agent')} * n)::bigint as i from agents, bag_n) join bag on idx = i")
def outdegree_bag_sample(v: Views) -> DataFrame:
    counts = v.edges_all.groupBy(F.col("source").alias("node_id")).agg(F.count("*").alias("value"))
    bag = keep(gr.dense_ids(counts).join(counts, "node_id").select("idx", "value"), "bag")
    return sa.from_bag(v.agents.select("agent"), bag, bag.count(), u("out_degree", "agent"), "out_degree")


@query(f", bag as (select row_number() over (order by node_id) - 1 as idx, num_authors as value from nodes_all), bag_n as (select count(*) as n from bag) select agent, value as num_authors from (select agent, floor({us('num_authors', 'agent')} * n)::bigint as i from agents, bag_n) join bag on idx = i")
def num_authors_sample(v: Views) -> DataFrame:
    bag = keep(gr.dense_ids(v.nodes_all).join(v.nodes_all.select("node_id", F.col("num_authors").alias("value")), "node_id").select("idx", "value"), "bag")
    return sa.from_bag(v.agents.select("agent"), bag, bag.count(), u("num_authors", "agent"), "num_authors")


AGE_SQL = ", ages as (select s.year - t.year as age, count(*) as n from edges join nodes_all s on s.node_id = source join nodes_all t on t.node_id = target where s.year > t.year group by 1)"


@query(AGE_SQL + f", b as (select {BIN_SQL.format(a='age')} as bin, sum(n) as weight from ages group by 1) select i::int as bin, coalesce(weight, 0)::bigint as weight, coalesce(weight, 0)::bigint / (sum(weight) over ())::double as probability from range(4) r(i) left join b on bin = i")
def recency_bin_probs(v: Views) -> DataFrame:
    return gr.bin_probabilities(gr.recency_histogram(v.edges, v.nodes_all), BOUNDS)


@query(f" select i as age, {BIN_SQL.format(a='i')} as bin from range(-5, 13) r(i)")
def bin_index_cases(v: Views) -> DataFrame:
    return v.spark.range(-5, 13).select(F.col("id").alias("age"), scores.bin_index(F.col("id"), BOUNDS).alias("bin"))


# --- neighbourhoods -----------------------------------------------------------------------------------------


@query(NEAR_SQL + " select agent, candidate from near")
def one_hop(v: Views) -> DataFrame:
    return ne.one_hop(generator_picks(v), v.adjacency)


@query(NEAR_SQL + f" select distinct agent, candidate from {FAR_SQL}")
def two_hop(v: Views) -> DataFrame:
    return ne.two_hop(keep(generator_picks(v), "picks"), v.adjacency)


@query(CAP1_SQL + " select agent, candidate from cap1")
def one_hop_capped(v: Views) -> DataFrame:
    return ne.one_hop_capped(generator_picks(v), v.adjacency, CAP, u).select("agent", "candidate")


@query(CAP2_SQL + " select agent, candidate from cap2")
def two_hop_capped(v: Views) -> DataFrame:
    return capped_hops(v).where("hop = 2").select("agent", "candidate")


@query(CAP2_SQL + " select agent, 1 as hop, candidate from cap1 union all select agent, 1, candidate from cap2 join (select agent, count(*) as n1 from cap1 group by agent) using (agent) where n <= 25 - n1")
def pooled_hop(v: Views) -> DataFrame:
    return ne.pooled(placed_hops(v), 25)


@query(BINNED_SQL + " select agent, hop, bin, count(*) as n from binned group by agent, hop, bin")
def bin_neighbourhood_counts(v: Views) -> DataFrame:
    return ne.bin_counts(binned_hops(v))


@query(" select cluster_id, count(*) as n from nodes where cluster_id >= 0 and year < 2000 group by cluster_id")
def cluster_sizes(v: Views) -> DataFrame:
    return ne.cluster_sizes(v.nodes, 2000)


CLUSTER_SQL = PICK_SQL + ", own as (select agent, generator, cluster_id from picks join nodes on node_id = generator)"


@query(CLUSTER_SQL + " select agent, node_id as candidate from own join nodes using (cluster_id) where node_id <> generator and year < 2001")
def cluster_candidates(v: Views) -> DataFrame:
    picks = ag.inherit_cluster(generator_picks(v), v.nodes)
    return ne.cluster_candidates(picks, v.nodes, NOW)


PRUNE_THETA = 500


@query(CAP2_SQL + f", mine as (select agent, cluster_id as own from picks join nodes on node_id = generator where cluster_id in (select cluster_id from nodes where year < 2001 group by cluster_id having count(*) >= {PRUNE_THETA})) select agent, candidate from cap2 join nodes on node_id = candidate left join mine using (agent) where own is null or own <> cluster_id")
def two_hop_pruned(v: Views) -> DataFrame:
    picks = ag.inherit_cluster(generator_picks(v), v.nodes).withColumn("alpha", F.lit(0.5))
    active = ne.active_clusters(picks, v.nodes, NOW, PRUNE_THETA)
    return ne.prune_cluster(capped_hops(v).where("hop = 2"), active, v.nodes).select("agent", "candidate")


@query(CARTEL_IN_SQL + " select agent, hop, candidate from hops h anti join cin c on c.agent = h.agent and c.candidate = h.candidate")
def drop_cited(v: Views) -> DataFrame:
    hopped = keep(capped_hops(v), "hops")
    near = ca.in_neighborhood(cartel_agents(v), cartel_table(v), v.nodes, hopped, u("cartel", "agent", "candidate"))
    return ne.drop_cited(hopped, near.select("agent", F.col("candidate").alias("target")))


@query(CAP2_SQL + f""", mine as (select agent, generator, cluster_id as own from picks join nodes on node_id = generator where cluster_id in (select cluster_id from nodes where year < 2001 group by cluster_id having count(*) >= {PRUNE_THETA}))
  select agent, 1 as hop, candidate from cap1 anti join mine using (agent) union all select agent, 1, node_id from mine join nodes on cluster_id = own where year < 2001 and node_id <> generator
  union all select agent, 2, candidate from cap2 join nodes on node_id = candidate left join mine using (agent) where own is null or own <> cluster_id""")
def cluster_override(v: Views) -> DataFrame:
    picks = keep(ag.inherit_cluster(generator_picks(v), v.nodes).withColumn("alpha", F.lit(0.5)), "picks")
    active = keep(ne.active_clusters(picks, v.nodes, NOW, PRUNE_THETA), "active")
    return ne.cluster_override(keep(capped_hops(v), "hops"), active, v.nodes, NOW)


# --- quotas -------------------------------------------------------------------------------------------------

QUOTA_SQL = f""", a0 as (select agent, author_id, (agent % 40 + 1)::int as d, case when {us('same', 'agent')} < 0.12 then 1 else 0 end as s, case when author_id % 100 = 1 then 1 else 0 end as cartel_id from agents),
  a1 as (select *, case when cartel_id > 0 then least(round(d * 0.5::double), 4 - 1) else 0 end::int as cartel, floor(d * 0.05::double)::int as reserve from a0),
  a2 as (select *, d - 1 - s - cartel as q0 from a1),
  quotas as (select agent, d as out_degree, cartel, reserve, (case when q0 > reserve then q0 - reserve else q0 end)::int as q from a2)"""


def quota_table(v: Views) -> DataFrame:
    rows = v.agents.select("agent", (F.col("agent") % 40 + 1).cast("int").alias("out_degree"), F.lit(1).alias("generators"), F.when(u("same", "agent") < 0.12, 1).otherwise(0).alias("same_year"), F.when(F.col("author_id") % 100 == 1, 1).otherwise(0).alias("cartel_id"), F.lit(4).alias("cartel_size"))
    return qu.agent_quotas(rows, 0.5, 0.05)


@query(QUOTA_SQL + " select * from quotas")
def quota_split(v: Views) -> DataFrame:
    return quota_table(v).select("agent", "out_degree", "cartel", "reserve", "q")


SPLIT_SQL = (
    CAP2_SQL + QUOTA_SQL + f""", sized as (select agent, count(*) filter (hop = 1)::int as n1, count(*) filter (hop = 2)::int as n2 from hops group by agent),
  s0 as (select agent, greatest(q, 0) as q, round({us('alpha', 'agent')} * 1000) / 1000 as alpha, n1, n2, least(n1 + n2, greatest(q, 0)) as t from quotas join sized using (agent)),
  s1 as (select *, least(floor(t * alpha)::int, n1) as c1 from s0), split as (select agent, q, n1, n2, c1, least(t - c1, n2) as c2 from s1)"""
)


def split_table(v: Views, hopped: DataFrame) -> DataFrame:
    count = lambda h: F.sum(F.when(F.col("hop") == h, 1).otherwise(0)).cast("int")
    sizes = hopped.groupBy("agent").agg(count(1).alias("n1"), count(2).alias("n2"))
    rows = quota_table(v).select("agent", F.greatest("q", F.lit(0)).alias("q")).join(sizes, "agent")
    return qu.split_hops(ag.sample_alpha(rows, u, True, -1))


@query(SPLIT_SQL + " select agent, q, n1, n2, c1, c2 from split")
def hop_split(v: Views) -> DataFrame:
    return split_table(v, capped_hops(v)).select("agent", "q", "n1", "n2", "c1", "c2")


PROBABILITIES = [0.5, 0.25, 0.125, 0.125]


@query(f""", a as (select agent, (agent % 23)::int as t from agents), x0 as (select *, least(round(t * 0.5::double), t)::int as x0 from a), x1 as (select *, least(round(t * 0.25::double), t - x0)::int as x1 from x0),
  x2 as (select *, least(round(t * 0.125::double), t - x0 - x1)::int as x2 from x1), x3 as (select *, least(round(t * 0.125::double), t - x0 - x1 - x2)::int as x3 from x2),
  units as (select agent, unnest(range(1, t - x0 - x1 - x2 - x3 + 1)) as i from x3), drawn as (select agent, {BIN_SQL.format(a='y')} as bin from (select agent, floor({us('unit', 'agent', 'i')} * 5) + 1 as y from units)),
  extra as (select agent, count(*) filter (bin = 0) as e0, count(*) filter (bin = 1) as e1, count(*) filter (bin = 2) as e2, count(*) filter (bin = 3) as e3 from drawn group by agent)
  select agent, t as total, (x0 + coalesce(e0, 0))::int as b0, (x1 + coalesce(e1, 0))::int as b1, (x2 + coalesce(e2, 0))::int as b2, (x3 + coalesce(e3, 0))::int as b3 from x3 left join extra using (agent)""")
def bin_quota_targets(v: Views) -> DataFrame:
    rows = v.agents.select("agent", (F.col("agent") % 23).cast("int").alias("total"))
    rows = rows.withColumn("t", qu.bin_targets(F.col("total"), PROBABILITIES, BOUNDS, lambda i: u("unit", "agent", i)))
    return rows.select("agent", "total", *(F.element_at("t", b + 1).alias(f"b{b}") for b in range(4)))


def bin_quota_table(v: Views) -> DataFrame:
    hopped = capped_hops(v)
    sizes = qu.size_arrays(ne.bin_counts(ne.binned(hopped, v.nodes, NOW, BOUNDS)), len(BOUNDS))
    split = keep(split_table(v, hopped), "split")
    totals = split.select("agent", F.lit(1).alias("hop"), F.col("c1").alias("total")).unionByName(split.select("agent", F.lit(2).alias("hop"), F.col("c2").alias("total")))
    return qu.bin_quotas(sizes.join(totals, ["agent", "hop"]), PROBABILITIES, BOUNDS, lambda i: u("unit", "agent", "hop", i))


@query(SPLIT_SQL + " select agent, 1 as hop, c1::bigint as quota from split where n1 > 0 union all select agent, 2, c2 from split where n2 > 0")
def bin_quota_rebalanced(v: Views) -> DataFrame:
    """Quotas summed over bins: the hop's quota is always met."""
    return bin_quota_table(v).groupBy("agent", "hop").agg(F.sum("quota").alias("quota"))


def quotas_sql(groups: str, *unit: str) -> str:
    """A CTE quota_of(agent, hop, bin, quota); groups(agent, hop, s0 to s3, t): sizes by bin and the total; unit: the names of a
    leftover unit's draw. The excess of each bin goes to the nearest lower bins with room, then to higher ones."""
    bins = range(len(BOUNDS))
    out, left = "", "t"
    for b, p in enumerate(PROBABILITIES):
        out += f", z{b} as (select *, least(round(t * {p}::double), {left})::int as x{b} from {f'z{b - 1}' if b else groups})"
        left += f" - x{b}"
    out += f", zu as (select agent, hop, unnest(range(1, {left} + 1)) as i from z{bins[-1]}), zd as (select agent, hop, {BIN_SQL.format(a='y')} as bin from (select agent, hop, floor({us(*unit)} * 5) + 1 as y from zu))"
    out += f", ze as (select agent, hop, {', '.join(f'count(*) filter (bin = {b}) as e{b}' for b in bins)} from zd group by agent, hop)"
    out += f", zt as (select agent, hop, s0, s1, s2, s3, {', '.join(f'(x{b} + coalesce(e{b}, 0))::int as t{b}' for b in bins)} from z{bins[-1]} left join ze using (agent, hop))"
    last = "zt"
    for b in bins:
        for k in [*range(b)][::-1] + [*range(b + 1, len(BOUNDS))]:
            moved = f"greatest(least(t{b} - s{b}, s{k} - t{k}), 0)"
            out += f", y{b}_{k} as (select * replace (t{b} - {moved} as t{b}, t{k} + {moved} as t{k}) from {last})"
            last = f"y{b}_{k}"
    return out + f", quota_of as ({' union all '.join(f'select agent, hop, {b} as bin, least(t{b}, s{b})::int as quota from {last}' for b in bins)})"


SIZES_SQL = ", ".join(f"(count(*) filter (bin = {b}))::int as s{b}" for b in range(len(BOUNDS)))
SETTLED_SQL = (
    SPLIT_SQL + BINNED_SQL.removeprefix(CAP2_SQL) + f", sizes as (select agent, hop, {SIZES_SQL} from binned group by agent, hop), sized_by as (select s.*, case hop when 1 then c1 else c2 end::int as t from sizes s join split using (agent))"
    + quotas_sql("sized_by", "unit", "agent", "hop", "i")
)


@query(SETTLED_SQL + " select * from quota_of")
def bin_quota_by_bin(v: Views) -> DataFrame:
    """Quotas of every bin after excess has moved between bins."""
    return bin_quota_table(v).select("agent", "hop", "bin", "quota")


# --- selection ----------------------------------------------------------------------------------------------


@query(SCORED_SQL + " select agent, hop, bin, candidate, floor(score * 1000000::double + 0.5::double)::bigint as score_millionths from scored")
def scored_candidates(v: Views) -> DataFrame:
    """Engines round decimals differently, so the score is a whole number of millionths."""
    return scored_table(v).select("agent", "hop", "bin", "candidate", F.floor(F.col("score") * 1e6 + 0.5).cast("long").alias("score_millionths"))


@query(SCORED_SQL + f" select agent, hop, bin, candidate from (select *, row_number() over (partition by agent, hop, bin order by ln({us('wrs', 'agent', 'candidate')}) / score desc, candidate) as n from scored) where n <= 3")
def weighted_topk(v: Views) -> DataFrame:
    return sa.weighted_top(scored_table(v), F.lit(3), u("wrs", "agent", "candidate")).select("agent", "hop", "bin", "candidate")


@query(BINNED_SQL + f" select agent, hop, bin, candidate from (select *, row_number() over (partition by agent, hop, bin order by {us('uni', 'agent', 'candidate')}, candidate) as n from binned) where n <= 3")
def uniform_topk(v: Views) -> DataFrame:
    return sa.uniform_top(binned_hops(v), F.lit(3), u("uni", "agent", "candidate")).select("agent", "hop", "bin", "candidate")


def fill_sql(rounds: int) -> str:
    """So many rounds of draws one after the other; every agent is filled long before they are over."""
    out, found = ", left0 as (select agent, (agent % 5)::int as f from agents where agent % 5 > 0)", "select agent, target from new{}"
    for r in range(rounds):
        taken = " union all ".join(["select agent, candidate as target from near", *(found.format(k) for k in range(r))])
        out += (
            f", draws{r} as (select agent, f, unnest(range(1, (f * {1 << min(r, 6)} + 3 + 1)::int)) + {r * 100_000} as n from left{r}),"
            f" hit{r} as (select d.agent, d.f, d.n, i.node_id as target from draws{r} d, total t join idx i on i.idx = floor({us('fill', 'd.agent', 'd.n')} * t.n)::bigint),"
            f" fresh{r} as (select h.agent, h.f, h.target, min(h.n) as n from hit{r} h anti join ({taken}) x on x.agent = h.agent and x.target = h.target group by all),"
            f" new{r} as materialized (select agent, target from (select *, row_number() over (partition by agent order by n) as rank from fresh{r}) where rank <= f),"
            f" left{r + 1} as materialized (select agent, f - coalesce(got, 0) as f from left{r} left join (select agent, count(*) as got from new{r} group by agent) using (agent) where f > coalesce(got, 0))"
        )
    return out + " " + " union all ".join(found.format(k) for k in range(rounds))


@query(NEAR_SQL + fill_sql(4))
def random_fill(v: Views) -> DataFrame:
    indexed = keep(gr.dense_ids(v.nodes), "index")
    cited = ne.one_hop(generator_picks(v), v.adjacency).select("agent", F.col("candidate").alias("target"))
    wanted = v.agents.select("agent", (F.col("agent") % 5).cast("int").alias("f"))
    return sa.random_fill(wanted, indexed, indexed.count(), cited, lambda a, n: u("fill", a, n)).select("agent", "target")


SAME_SQL = f", sources as (select agent from (select agent, row_number() over (order by {us('source', 'agent')}, agent) as n, count(*) over () as m from agents) where n <= floor(m * 0.12::double))"


@query(SAME_SQL + " select agent from sources")
def same_year_sources(v: Views) -> DataFrame:
    return sa.same_year_sources(v.agents, 0.12, v.agents.count(), u("source", "agent"))


@query(SAME_SQL + f", o as (select agent, row_number() over (order by agent) - 1 as idx, count(*) over () as m from agents anti join sources using (agent)) select s.agent, o.agent as target from sources s join o on idx = floor({us('same_year', 's.agent')} * m)::bigint")
def same_year_citations(v: Views) -> DataFrame:
    sources = keep(same_year_sources(v), "sources")
    return sa.same_year_citations(v.agents, sources, u("same_year", "agent"))


# --- generators and authors ---------------------------------------------------------------------------------

ELIGIBLE_SQL = (
    DEG_SQL + FIT_SQL + """, recent as (select node_id, in_degree, fitness from nodes join deg using (node_id) join fit using (node_id) where 2001 - year <= 5),
  c1 as (select in_degree as cut from (select in_degree, row_number() over (order by in_degree desc) - 1 as n, count(*) over () as m from recent) where n = floor((m - 1) * 20 / 100)),
  c2 as (select fitness as cut from (select fitness, row_number() over (order by fitness desc) - 1 as n, count(*) over () as m from recent) where n = floor((m - 1) * 30 / 100)),
  eligible as (select node_id from recent where in_degree >= (select cut from c1) and fitness >= (select cut from c2))"""
)


def eligible_table(v: Views) -> DataFrame:
    rows = fitness_table(v).select("node_id", "year", "fitness", F.lit("agent").alias("type")).join(degree_table(v), "node_id")
    return ag.eligible_generators(rows, NOW, NOW, 5, 20, 30, FITNESS_MAX)


@query(ELIGIBLE_SQL + " select node_id from eligible")
def eligible_generators(v: Views) -> DataFrame:
    return eligible_table(v)


@query(
    ELIGIBLE_SQL + INDEX_SQL + f""", eidx as (select node_id, row_number() over (order by node_id) - 1 as idx, count(*) over () as m from eligible),
  ch as (select agent, {us('eligible', 'agent')} < 0.4 as e, {us('generator', 'agent')} as g from agents)
  select agent, node_id as generator from ch join eidx on idx = floor(g * m)::bigint where e union all select agent, node_id from ch, total join idx on idx = floor(g * n)::bigint where not e"""
)
def generator_pick(v: Views) -> DataFrame:
    everyone, eligible = keep(gr.dense_ids(v.nodes), "index"), keep(gr.dense_ids(eligible_table(v)), "eligible")
    return ag.choose_generators(v.agents, everyone, everyone.count(), eligible, eligible.count(), 0.4, u)


@query(PICK_SQL + " select agent, generator, cluster_id from picks join nodes on node_id = generator")
def cluster_inherit(v: Views) -> DataFrame:
    return ag.inherit_cluster(generator_picks(v), v.nodes)


@query(PICK_SQL + CARTEL_SQL + " select cartel_id, author_id from cart")
def cartel_members(v: Views) -> DataFrame:
    return ca.members(cartel_table(v))


@query(PICK_SQL + CARTEL_SQL + " select agent, node_id from partners join nodes on author_id = partner")
def cartel_generators(v: Views) -> DataFrame:
    return ca.generators(cartel_agents(v), cartel_table(v), v.nodes)


@query(CARTEL_IN_SQL + " select agent, partner, hop, candidate from cin")
def cartel_in_neighbourhood(v: Views) -> DataFrame:
    members = keep(cartel_agents(v), "cartel")
    return ca.in_neighborhood(members, cartel_table(v), v.nodes, group_hops(v, members), u("cartel", "agent", "candidate"))


@query(
    CARTEL_IN_SQL + f" select agent, partner, candidate from (select p.agent, p.partner, node_id as candidate, row_number() over (partition by p.agent, p.partner order by {us('cartel', 'p.agent', 'node_id')}, node_id) as n"
    " from partners p join nodes on author_id = partner join ca on ca.agent = p.agent and node_id <> generator anti join cin on cin.agent = p.agent and cin.partner = p.partner) where n = 1"
)
def cartel_outside(v: Views) -> DataFrame:
    members = keep(cartel_agents(v), "cartel")
    near = keep(ca.in_neighborhood(members, cartel_table(v), v.nodes, group_hops(v, members), u("cartel", "agent", "candidate")), "near")
    return ca.outside(members, cartel_table(v), v.nodes, near, cartel_draw)


@query(CARTEL_IN_SQL + " select agent, least(3, count(distinct partner)) as n from cin group by agent")
def cartel_neighbourhood_authors(v: Views) -> DataFrame:
    members = keep(cartel_agents(v).withColumn("cartel", F.lit(3)), "cartel")
    return ca.neighborhood_authors(members, cartel_table(v), v.nodes, group_hops(v, members))


OUT_SQL = CARTEL_IN_SQL + (
    f", cout as (select agent, partner, candidate from (select p.agent, p.partner, node_id as candidate, row_number() over (partition by p.agent, p.partner order by {us('cartel', 'p.agent', 'node_id')}, node_id) as n"
    " from partners p join nodes on author_id = partner join ca on ca.agent = p.agent and node_id <> generator anti join cin on cin.agent = p.agent and cin.partner = p.partner) where n = 1)"
)


@query(OUT_SQL + f" select agent, candidate as target from (select *, row_number() over (partition by agent order by part, o, partner) as n from (select agent, partner, candidate, 0 as part, {us('null', 'agent', 'candidate')} as o from cin union all select agent, partner, candidate, 1, partner::double from cout)) where n <= 3")
def cartel_null(v: Views) -> DataFrame:
    members = keep(cartel_agents(v).withColumn("cartel", F.lit(3)), "cartel")
    near = keep(ca.in_neighborhood(members, cartel_table(v), v.nodes, group_hops(v, members), u("cartel", "agent", "candidate")), "near")
    far = ca.outside_first(members, cartel_table(v), v.nodes, near, cartel_draw)
    return ca.null_citations(members, near, far, u("null", "agent", "candidate")).select("agent", "target")


CARTEL_SCORED_SQL = (
    OUT_SQL + METRIC_SQL + WEIGHT_SQL + f", cb as (select agent, 1 as hop, candidate, {BIN_SQL.format(a=f'({NOW} - year)')} as bin from cin join nodes on node_id = candidate), sizes as (select agent, hop, {SIZES_SQL}, 3 as t from cb group by agent, hop)"
    + quotas_sql("sizes", "cartel_unit", "agent", "i") + f""", cs as (select agent, bin, candidate, {us('cartel_pick', 'agent', 'candidate')} as o, w_pa * (pa / sum(pa) over g) + w_fit * (fit / sum(fit) over g) + w_na * (na / sum(na) over g) + w_ar * (ar / sum(ar) over g) as score
    from cb join metric on node_id = candidate join weights using (agent) window g as (partition by agent, bin)),
  cp as (select agent, candidate as target from (select *, row_number() over (partition by agent, bin order by case when bin < 3 then -ln(o) / score else o end, candidate) as n from cs join quota_of using (agent, bin)) where n <= quota)
  select agent, target from cp union all select agent, candidate from (select *, row_number() over (partition by agent order by partner) as n from cout) left join (select agent, count(*) as got from cp group by agent) using (agent) where n <= 3 - coalesce(got, 0)"""
)


@query(CARTEL_SCORED_SQL)
def cartel_scored(v: Views) -> DataFrame:
    members = keep(cartel_agents(v).withColumn("cartel", F.lit(3)), "cartel")
    near = keep(ca.in_neighborhood(members, cartel_table(v), v.nodes, group_hops(v, members), u("cartel", "agent", "candidate")), "near")
    rows = near.select("agent", F.lit(1).alias("hop"), "candidate")
    sizes = qu.size_arrays(ne.bin_counts(ne.binned(rows, v.nodes, NOW, BOUNDS)), len(BOUNDS)).join(members.select("agent", F.col("cartel").alias("total")), "agent")
    quotas = qu.bin_quotas(sizes, PROBABILITIES, BOUNDS, lambda i: u("cartel_unit", "agent", i))
    picked = select_by_bins(ne.binned(rows, v.nodes, NOW, BOUNDS), quotas, metric_table(v), agent_weights(v), "cartel_pick", u)
    chosen = keep(picked.select("agent", F.col("candidate").alias("target")), "chosen")
    far = ca.outside_first(members, cartel_table(v), v.nodes, near, cartel_draw)
    return chosen.unionByName(ca.remaining(members, chosen, far))


def select_by_bins(in_bins: DataFrame, quotas: DataFrame, metrics: DataFrame, weights: DataFrame, name: str, draw) -> DataFrame:
    """agent, hop, bin, candidate: weighted in all bins but the last one, uniform there."""
    last = quotas.agg(F.max("bin").alias("last"))
    scored = sa.scored(in_bins, metrics, weights).join(quotas, ["agent", "hop", "bin"]).join(F.broadcast(last))
    heavy = sa.weighted_top(scored.where("bin < last"), F.col("quota"), draw(name, "agent", "candidate"))
    even = sa.uniform_top(scored.where("bin = last"), F.col("quota"), draw(name, "agent", "candidate"))
    return heavy.select("agent", "hop", "bin", "candidate").unionByName(even.select("agent", "hop", "bin", "candidate"))


@query(" select pubs, count(*) as authors from (select author_id, count(*) as pubs from nodes group by author_id) group by pubs")
def lotka_histogram(v: Views) -> DataFrame:
    return gr.publication_histogram(v.nodes)


LOTKA_SQL = ", hist as (select greatest(1, pubs - 6) as pubs, count(*) as authors from (select author_id, count(*) as pubs from nodes group by author_id) group by 1), n1 as (select coalesce(max(authors), 0) as n1 from hist where pubs = 1), k as (select unnest(range(2, 2000)) as pubs), e as (select k.pubs, coalesce(authors, 0) as authors, round(n1 / (k.pubs * k.pubs)::double)::bigint as expected from k cross join n1 left join hist on hist.pubs = k.pubs)"


def shifted_histogram(v: Views) -> DataFrame:
    """The network's authors have about ten papers each; six fewer give the law something to miss."""
    return gr.publication_histogram(v.nodes).groupBy(F.greatest(F.lit(1), F.col("pubs") - 6).alias("pubs")).agg(F.sum("authors").alias("authors"))


@query(LOTKA_SQL + " select pubs, authors, expected, expected - authors as deficit from e where expected >= 1")
def lotka_deficit(v: Views) -> DataFrame:
    return gr.lotka_deficits(shifted_histogram(v))


@query(LOTKA_SQL + " select min(pubs) as pubs from e where expected >= 1 and expected - authors > 1")
def lotka_first_deficit(v: Views) -> DataFrame:
    return gr.first_deficit(shifted_histogram(v))


@query()
def author_assignment(v: Views) -> DataFrame:
    """agent, author_id: authors that the inverse-square law asks for, the agents in id order."""
    return au.grow(v.agents.select("agent"), v.authors.withColumn("cartel_id", F.lit(None).cast("int")), NOW, 30)[0]


PLANTED_ROWS = [(1, 2, 7, 0.9), (1, 3, None, 0.1), (2, 4, 11, None), (1, 5, 250, None)]


@query(f", p(y, line_no, d, a) as (values (1, 2, 7, 0.9), (1, 3, null, 0.1), (2, 4, 11, null), (1, 5, 250, null)), o as (select agent, row_number() over (order by {us('plant', 'agent')}, agent) as n from agents), l as (select *, row_number() over (order by line_no) as n from p where y = 1) select agent, coalesce(d, 10)::int as out_degree, coalesce(a, 0.5)::double as alpha, line_no::int as planted_line from o left join l using (n)")
def planted_overrides(v: Views) -> DataFrame:
    planted = v.spark.createDataFrame(PLANTED_ROWS, "year int, line_no int, out_degree int, alpha double")
    rows = v.agents.select("agent", F.lit(10).alias("out_degree"), F.lit(0.5).alias("alpha"))
    return ag.plant(rows, planted, 1, u("plant", "agent"))


@query(" select agent, case when author_id % 100 = 1 then 33 else 10 end as out_degree, 0.5::double as alpha from agents")
def clonal_overrides(v: Views) -> DataFrame:
    clonal = v.spark.createDataFrame([(33, None)], "out_degree int, alpha double")
    rows = v.agents.select("agent", "author_id", F.lit(10).alias("out_degree"), F.lit(0.5).alias("alpha"))
    return ag.override_clonal(rows, clonal, F.col("author_id") % 100 == 1).select("agent", "out_degree", "alpha")


@query(", c as (select author_id, row_number() over (order by author_id) as n from authors where author_id % 100 in (1, 2)), a as (select agent, row_number() over (order by agent) as n from agents) select agent, author_id from a join c using (n)")
def cartel_schedule(v: Views) -> DataFrame:
    return ag.schedule_cartel_authors(v.agents, cartel_table(v))


# --- edges, files, graph ------------------------------------------------------------------------------------


@query(", r as (select l_partkey as source, l_suppkey as target, l_linenumber as rank from lineitem) select source, target, min(rank) as rank from r group by source, target")
def edge_dedup(v: Views) -> DataFrame:
    return gr.dedup_edges(v._table("lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_linenumber").alias("rank")))


@query(" select source, target from edges union all select source, target from edges_all join nodes_all on node_id = source where year = 2001")
def edge_append(v: Views) -> DataFrame:
    return gr.append_edges(v.edges, v.edges_all.join(v.agents.select(F.col("agent").alias("source")), "source", "left_semi"))


@query(", g(y, n) as (select 0, count(*) from nodes union all select y + 1, n + ceil(n * 0.03::double)::bigint from g where y < 10) select y::int as year, n::bigint as nodes from g")
def growth_projection(v: Views) -> DataFrame:
    from .simulate import growth

    return v.spark.createDataFrame(growth(v.nodes.count(), 0.03, 10), "year int, nodes long")


@query(DEG_SQL + """ select node_id, 'seed' as type, year, -1.0::double as alpha, coalesce(o, 0)::bigint as out_degree, in_degree::bigint as in_degree, 'no_generators' as generator_node_string, -1 as cartel_id, cluster_id
  from nodes join deg using (node_id) left join (select source, count(*) as o from edges group by source) on source = node_id""")
def nodelist_export(v: Views) -> DataFrame:
    rows = v.nodes.withColumn("type", F.lit("seed")).withColumn("alpha", F.lit(0.7))
    return sinks.nodelist_rows(rows, gr.degrees(v.nodes, v.edges), None, None).select("node_id", "type", "year", F.col("alpha").cast("double").alias("alpha"), "out_degree", "in_degree", "generator_node_string", "cartel_id", "cluster_id")


@query(" select source as node_id, string_agg(target::varchar, ';' order by target) as encoded, count(*)::int as n from edges group by source")
def generator_string_roundtrip(v: Views) -> DataFrame:
    lists = v.edges.groupBy(F.col("source").alias("node_id")).agg(F.array_sort(F.collect_list("target")).alias("t"))
    encoded = lists.select("node_id", scores.int_list(F.col("t")).alias("encoded"))
    return encoded.withColumn("back", scores.parse_int_list(F.col("encoded"))).select("node_id", scores.int_list(F.col("back")).alias("encoded"), F.size("back").alias("n"))


def on_file(v: Views, rows: DataFrame, name: str) -> str:
    """A CSV file in the shared folder."""
    path = kept_path(v.spark, f"{name}-{uuid.uuid4().hex}")
    sinks.write_csv(rows, path, *rows.columns)
    return path


@query(" select source, target from edges")
def edgelist_file(v: Views) -> DataFrame:
    """Written by the sink, its delimiter found and read again."""
    path = kept_path(v.spark, f"edgelist-{uuid.uuid4().hex}")
    sinks.write_edgelist(v.edges, path)
    return readers.read_edgelist(v.spark, path)


@query(" select node_id, year, 'seed' as type, 0 as fit_lag, 1000 as fit_duration, 1 as fit_value from nodes")
def nodelist_file(v: Views) -> DataFrame:
    return readers.read_nodelist(v.spark, on_file(v, v.nodes.select("node_id", F.col("year").alias("publication_year")), "nodelist"))


@query(" select author_id, min(year) as birth_year, count(*) as pub_count, case when author_id % 100 in (1, 2) then (author_id % 100 = 1)::int end as cartel_id from nodes group by author_id")
def checkpoint_file(v: Views) -> DataFrame:
    """A node list of an earlier run: authors, their first year, papers and group."""
    group = F.when(F.col("author_id") % 100 == 1, 1).when(F.col("author_id") % 100 == 2, 0).otherwise(-1)
    rows = v.nodes.select("node_id", "year", F.lit("seed").alias("type"), "author_id", group.alias("cartel_id"))
    authors = readers.checkpoint_authors(readers.read_checkpoint(v.spark, on_file(v, rows, "checkpoint")))
    return authors.withColumn("author_id", F.col("author_id").cast("long"))


@query(AGE_SQL + " select age::int as age, n as count from ages")
def recency_file(v: Views) -> DataFrame:
    return readers.read_recency_table(v.spark, on_file(v, gr.recency_histogram(v.edges, v.nodes_all).select("age", "count"), "recency"))


@query(" select n::int as value, count(*) as rows from (select source, count(*) as n from edges_all group by source) group by n")
def out_degree_bag_file(v: Views) -> DataFrame:
    bag = v.edges_all.groupBy("source").agg(F.count("*").alias("n"))
    return readers.read_out_degree_bag(v.spark, on_file(v, bag, "bag")).groupBy("value").agg(F.count("*").alias("rows"))


@query(" select node_id, cluster_id::bigint as cluster_id from nodes")
def community_file(v: Views) -> DataFrame:
    path = kept_path(v.spark, f"communities-{uuid.uuid4().hex}")
    sinks.write_communities(v.nodes, path)
    return readers.with_communities(v.nodes.select("node_id"), readers.read_communities(v.spark, path))


@query(DEG_SQL + """, up as (select distinct a.author_id, a.year, b.node_id, in_degree from nodes a join nodes b on a.author_id = b.author_id and b.year <= a.year join deg on deg.node_id = b.node_id),
  r as (select author_id, year, in_degree, row_number() over (partition by author_id, year order by in_degree desc) as rn from up), h as (select author_id, year, (count(*) filter (in_degree >= rn))::int as h from r group by author_id, year)
  select node_id, h as initial_author_reputation from nodes join h using (author_id, year)""")
def seed_reputation(v: Views) -> DataFrame:
    return gr.seed_reputations(v.nodes.select("node_id", "author_id", "year"), v.edges).select("node_id", "initial_author_reputation")


@query(" select node_id, row_number() over (order by node_id) - 1 as idx from nodes")
def dense_ids(v: Views) -> DataFrame:
    return gr.dense_ids(v.nodes)


@query(" select source, target from edges_all semi join nodes a on a.node_id = source semi join nodes b on b.node_id = target")
def edge_validity(v: Views) -> DataFrame:
    return gr.valid_edges(v.edges_all, v.nodes)


@query(""", b as materialized (select source as x, target as y from edges union select target, source from edges),
  walk(node_id, component) using key (node_id) as (select node_id, node_id from nodes
    union (select y, min(w.component) from walk w join b on w.node_id = x join recurring.walk r on r.node_id = y where w.component < r.component group by y)) select node_id, component from walk""")
def connected_components(v: Views) -> DataFrame:
    return co.connected_components(v.nodes.select("node_id"), v.edges)


@query(" select cluster_id, n as nodes, coalesce(i, 0) as inner, coalesce(i, 0) - 0.01::double * (n * (n - 1) / 2) as quality from (select cluster_id, count(*) as n from nodes group by cluster_id) left join (select s.cluster_id, count(*) as i from edges join nodes s on s.node_id = source join nodes t on t.node_id = target where s.cluster_id = t.cluster_id group by 1) using (cluster_id)")
def community_quality(v: Views) -> DataFrame:
    nodes = v.nodes.select("node_id", F.col("cluster_id").cast("long").alias("cluster_id"))
    out = co.community_quality(nodes, v.edges, nodes, 0.01)
    return out.withColumn("cluster_id", F.col("cluster_id").cast("int"))


@query()
def leiden_partition(v: Views) -> DataFrame:
    return co.communities(v.nodes.select("node_id"), v.edges, "cpm", 0.01)


@query()
def simulate_one_year(v: Views) -> DataFrame:
    """source, target: the edges of one simulated year over the views' network."""
    from .simulate import Settings, State, one_year

    nodes = v.nodes.select("node_id", "year", "author_id", "num_authors", F.lit("seed").alias("type"), F.lit(0).alias("fit_lag"), F.lit(1000).alias("fit_duration"), F.lit(1).alias("fit_value"), F.lit(None).cast("long").alias("cluster_id"))
    authors = v.authors.join(cartel_table(v), "author_id", "left")
    bag = v.edges_all.groupBy("source").agg(F.count("*").alias("value")).select("value")
    settings = Settings(growth_rate=0.03, bounds=tuple(BOUNDS), cap=CAP)
    state = State(keep(nodes, "nodes"), keep(v.edges, "edges"), keep(authors, "authors"))
    return one_year(v.spark, state, settings, NOW, bag, v.nodes.select(F.col("num_authors").alias("value")), PROBABILITIES).new_edges
