"""The yearly simulation: snapshot, spawn, neighbourhoods, quotas, selection, fill, commit.

State between years is tables in the shared folder: a year adds its nodes and edges and rewrites none.
All randomness is hashed, so a run can be repeated and a lost task redone. What reaches the driver is
counts, the sizes of bags and what the configuration names, never nodes, authors or edges.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rng, scores
from ..operators import agents as ag
from ..operators import authors as au
from ..operators import cartel as ca
from ..operators import graph as gr
from ..operators import neighborhood as ne
from ..operators import quota as qu
from ..operators import sampling as sa
from .state import keep


@dataclass(frozen=True)
class Settings:
    growth_rate: float = 0.03
    bounds: tuple[int, ...] = (1, 2, 3, 5)
    cap: int | None = 10_000
    use_alpha: bool = True
    alpha: float = -1
    minimum_alpha: float = 0.0
    weights: tuple[float, float, float, float] = (-1, -1, -1, -1)
    lag: tuple[int, int] = (0, 3)
    duration: tuple[int, int] = (1, 5)
    fitness: tuple[int, int] = (1, 1000)
    same_year: float = 0.12
    random_share: float = 0.05
    cartel_share: float = 0.5
    null_cartel: bool = False
    generator_probability: float = 0.0
    degree_percent: float = 5
    fitness_percent: float = 20
    recency: int = 10
    lifetime: int = 30
    theta: int = 0
    start_year: int = 0
    seed: int = 0


@dataclass
class State:
    """nodes(node_id, year, author_id, num_authors, type, fit_lag, fit_duration, fit_value, cluster_id, ...),
    edges(source, target), authors(author_id, birth_year, pub_count, cartel_id)."""

    nodes: DataFrame
    edges: DataFrame
    authors: DataFrame
    timing: list[tuple[int, str, int]] = field(default_factory=list)


@dataclass
class Year:
    new_nodes: DataFrame
    new_edges: DataFrame
    citations: DataFrame
    authors: DataFrame


def growth(n: int, rate: float, years: int) -> list[tuple[int, int]]:
    """Graph sizes after 0, 1, ... years."""
    out = [(0, n)]
    for y in range(1, years + 1):
        n += math.ceil(n * rate)
        out.append((y, n))
    return out


def indexed_bag(values: DataFrame, spark: SparkSession) -> tuple[DataFrame, int]:
    """(idx, value) of a bag, by value: bags are small next to the graph, and equal values are alike."""
    counts = values.groupBy("value").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = keep(counts.withColumn("start", ahead), "bag")
    return ranges, ranges.agg(F.sum("n")).first()[0] or 0


#: Equal pieces of a bag's index: a draw meets only the values of its piece.
PIECES = 1024


def draw_from(rows: DataFrame, bag: DataFrame, size: int, draw: Column, name: str) -> DataFrame:
    """A uniform member of the bag for each row: its index falls into the range of one value."""
    if not size:
        return rows.withColumn(name, F.lit(1))
    piece = -(-size // PIECES)
    ranges = bag.select(F.col("start").alias("_start"), (F.col("start") + F.col("n")).alias("_end"), F.col("value").alias(name))
    ranges = ranges.withColumn("_p", F.explode(F.sequence(F.floor(F.col("_start") / piece), F.floor((F.col("_end") - 1) / piece))))
    out = rows.withColumn("_i", rng.pick(draw, size)).withColumn("_p", F.floor(F.col("_i") / piece))
    return out.join(ranges, "_p").where((F.col("_i") >= F.col("_start")) & (F.col("_i") < F.col("_end"))).drop("_i", "_p", "_start", "_end")


def one_year(spark: SparkSession, state: State, s: Settings, now: int, out_degrees: DataFrame, num_authors: DataFrame, probabilities: list[float], planted: DataFrame | None = None, clonal: DataFrame | None = None, relative_year: int = 1) -> Year:
    def u(purpose: str, *parts: Column | str | int) -> Column:
        return rng.u_fast(purpose, now, *parts, seed=s.seed)

    clock = [time.perf_counter()]

    def lap(label: str) -> None:
        clock.append(time.perf_counter())
        state.timing.append((now, label, int(1000 * (clock[-1] - clock[-2]))))

    nodes = keep(gr.graph_nodes(state.nodes, state.edges), "graph")
    edges = state.edges
    n_graph, last = nodes.agg(F.count("*"), F.max("node_id")).first()
    n_new = math.ceil((n_graph or 0) * s.growth_rate)
    degree = keep(gr.in_degrees(nodes, edges), "degree")
    fitness = scores.decayed_fitness(F.col("fit_value"), F.col("year"), F.col("fit_lag"), F.col("fit_duration"), now)
    lap("snapshot")

    # spawn
    new = spark.range(last + 1, last + 1 + n_new).select(F.col("id").alias("agent"))
    new = ag.sample_fitness(new, u, s.lag, s.duration, s.fitness)
    new = ag.sample_alpha(ag.sample_weights(new, u, s.weights), u, s.use_alpha, s.alpha, s.minimum_alpha)
    new = draw_from(new, *indexed_bag(out_degrees, spark), u("out_degree", "agent"), "out_degree")
    new = draw_from(new, *indexed_bag(num_authors, spark), u("num_authors", "agent"), "num_authors")
    new = new.withColumn("author_id", F.lit(None).cast("long"))
    if planted is not None:
        names = {"pa_weight": "w_pa", "fit_weight": "w_fit", "num_authors_weight": "w_na", "author_reputation_weight": "w_ar", "fit_peak_value": "fit_value", "fit_peak_duration": "fit_duration", "fit_lag_duration": "fit_lag"}
        renamed = planted
        for a, b in names.items():
            if a in planted.columns:
                renamed = renamed.withColumnRenamed(a, b)
        new = ag.plant(new, renamed, relative_year, u("plant", "agent"))
    else:
        new = new.withColumn("planted_line", F.lit(None).cast("int"))
    new = keep(new, "agents")
    real = state.authors.where("cartel_id is not null")
    cartel = ag.schedule_cartel_authors(new.where("planted_line is null"), real)
    named = keep(new.where("author_id is not null").select("agent", "author_id").unionByName(cartel), "named")
    assigned, authors = au.grow(new.select("agent"), state.authors, now, s.lifetime, s.seed, named)
    membership = authors.where("cartel_id is not null").select("author_id", "cartel_id")
    new = new.drop("author_id").join(assigned, "agent").join(membership, "author_id", "left")
    if clonal is not None:
        wide = clonal
        for a, b in {"fit_peak_value": "fit_value", "fit_peak_duration": "fit_duration", "fit_lag_duration": "fit_lag", "pa_weight": "w_pa", "fit_weight": "w_fit", "num_authors_weight": "w_na", "author_reputation_weight": "w_ar"}.items():
            if a in wide.columns:
                wide = wide.withColumnRenamed(a, b)
        new = ag.override_clonal(new, wide, F.col("cartel_id").isNotNull())
    new = keep(new, "authored")
    lap("authors")

    # generators
    everyone = keep(gr.dense_ids(nodes), "index")
    rows = nodes.select("node_id", "year", "type", fitness.alias("fitness")).join(degree, "node_id")
    eligible = keep(gr.dense_ids(ag.eligible_generators(rows, now, s.start_year or now, s.recency, s.degree_percent, s.fitness_percent, s.fitness[1])), "eligible")
    free = new.where("cartel_id is null or cartel_id <= 0")
    picks = ag.choose_generators(free, everyone, n_graph, eligible, eligible.count(), s.generator_probability, u)
    picks = picks.unionByName(ca.pick_generators(new.where("cartel_id > 0"), authors, nodes, u("mate", "agent")))
    picks = keep(ag.inherit_cluster(picks, nodes), "picks")
    sources = keep(sa.same_year_sources(new, s.same_year, n_new, u("source", "agent")), "sources")
    same = keep(sa.same_year_citations(new, sources, u("same_year", "agent")), "same")
    lap("generators")

    # neighbourhoods
    adj = ne.kept_adjacency(edges, "adjacency")
    hopped = neighbourhoods(picks, new, nodes, adj, now, s, u)
    hopped = keep(hopped, "hops")
    lap("neighbourhoods")

    # group citations
    sizes = membership.where("cartel_id > 0").groupBy("cartel_id").agg(F.count("*").alias("cartel_size"))
    flags = new.join(picks.select("agent", F.lit(1).alias("generators")), "agent", "left").join(same.select("agent", F.lit(1).alias("same_year")), "agent", "left").join(sizes, "cartel_id", "left")
    flags = flags.fillna(0, ["generators", "same_year", "cartel_size"])
    quotas = keep(qu.agent_quotas(flags, s.cartel_share, s.random_share), "quotas")
    metric = keep(gr.metrics(nodes.withColumn("fitness", fitness), degree, gr.author_h_index(nodes, degree), F.col("fitness")), "metrics")
    weights = new.select("agent", *ag.WEIGHTS)
    in_cartel = quotas.where("cartel > 0").join(picks.select("agent", "generator"), "agent")
    near = keep(ca.in_neighborhood(in_cartel, authors, nodes, hopped, u("cartel", "agent", "candidate")), "near")
    far = keep(ca.outside_first(in_cartel, authors, nodes, near, lambda c: u("cartel", "agent", c)), "far")
    if s.null_cartel:
        group = ca.null_citations(in_cartel, near, far, u("null", "agent", "candidate")).select("agent", "target")
    else:
        first = ne.binned(near.select("agent", F.lit(1).alias("hop"), "candidate"), nodes, now, list(s.bounds))
        chosen = keep(_by_bins(first, in_cartel.select("agent", F.lit(1).alias("hop"), F.col("cartel").alias("total")), metric, weights, probabilities, s, u, "cartel_pick").select("agent", F.col("candidate").alias("target")), "chosen")
        group = chosen.unionByName(ca.remaining(in_cartel, chosen, far))
    group = keep(group, "group")
    cited = same.unionByName(group)
    left = keep(ne.drop_cited(hopped, cited), "left")
    lap("group citations")

    # recency quotas and selection
    count = lambda h: F.sum(F.when(F.col("hop") == h, 1).otherwise(0)).cast("int")
    found = left.groupBy("agent").agg(count(1).alias("n1"), count(2).alias("n2"))
    split = quotas.where("q > 0").select("agent", "q", F.when(F.col("alpha") < 0, 1.0).otherwise(F.col("alpha")).alias("alpha")).join(found, "agent")
    split = keep(qu.split_hops(split), "split")
    totals = split.select("agent", F.lit(1).alias("hop"), F.col("c1").alias("total")).unionByName(split.select("agent", F.lit(2).alias("hop"), F.col("c2").alias("total")))
    in_bins = ne.binned(left, nodes, now, list(s.bounds))
    selected = keep(_by_bins(in_bins, totals, metric, weights, probabilities, s, u, "pick").select("agent", F.col("candidate").alias("target")), "selected")
    lap("selection")

    # uniform fill and edges
    start = picks.select("agent", F.col("generator").alias("target"), F.lit(0).alias("rank"))
    so_far = cited.unionByName(selected)
    got = so_far.groupBy("agent").agg(F.count("*").alias("got"))
    missing = quotas.join(got, "agent", "left").select("agent", (F.col("out_degree") - F.coalesce("got", F.lit(0)) - F.col("generators")).alias("f"))
    missing = keep(missing, "missing")
    filled = sa.random_fill(missing, everyone, n_graph, so_far.unionByName(start.select("agent", "target")), lambda a, n: u("fill", a, n))
    all_cited = start.unionByName(so_far.withColumn("rank", F.lit(1))).unionByName(filled.select("agent", "target", F.lit(2).alias("rank")))
    new_edges = keep(gr.dedup_edges(all_cited.withColumnRenamed("agent", "source")), "edges")
    reach = left.groupBy("agent").agg(F.count("*").alias("reach"))
    done = new.join(picks.select("agent", "generator", "cluster_id"), "agent", "left").join(reach, "agent", "left").join(missing, "agent", "left").join(quotas.select("agent", "q"), "agent", "left")
    h = gr.author_h_index(nodes, degree)
    done = done.join(h, "author_id", "left")
    new_nodes = done.select(
        F.col("agent").alias("node_id"), F.lit(now).alias("year"), "author_id", "num_authors", F.lit("agent").alias("type"), "fit_lag", "fit_duration", "fit_value", "cluster_id",
        "alpha", *ag.WEIGHTS, F.col("out_degree").alias("assigned_out_degree"), F.col("planted_line").alias("planted_nodes_line_number"), F.col("generator").cast("string").alias("generator_node_string"),
        F.when(F.col("q") > 0, F.coalesce("reach", F.lit(0))).otherwise(0).cast("int").alias("sampled_neighborhood_size"), F.col("f").cast("int").alias("fully_random_citations"), F.coalesce("h", F.lit(0)).cast("int").alias("initial_author_reputation"),
    )
    new_nodes = keep(new_nodes, "new_nodes")
    lap("commit")
    return Year(new_nodes, new_edges.select("source", "target"), new_edges, authors)


def neighbourhoods(picks: DataFrame, new: DataFrame, nodes: DataFrame, adj: DataFrame, now: int, s: Settings, u) -> DataFrame:
    """agent, hop, candidate: with alpha two hops, the first replaced by an active cluster; without it one pooled list."""
    start = picks.select("agent", "generator")
    if not s.use_alpha:
        return ne.pooled(ne.hops(start, adj, None, u) if s.cap is None else ne.placed_hops(start, adj, s.cap, u), s.cap)
    hopped = ne.hops(start, adj, s.cap, u)
    if s.theta > 0:
        active = keep(ne.active_clusters(picks.join(new.select("agent", "alpha"), "agent"), nodes, now, s.theta), "active")
        hopped = ne.cluster_override(hopped, active, nodes, now)
    return hopped


def _by_bins(in_bins: DataFrame, totals: DataFrame, metric: DataFrame, weights: DataFrame, probabilities: list[float], s: Settings, u, name: str) -> DataFrame:
    """Quotas by bin, then weighted choice in all bins but the last, uniform choice there."""
    bounds = list(s.bounds)
    in_bins = keep(in_bins, "bins")
    sized = qu.size_arrays(ne.bin_counts(in_bins), len(bounds)).join(totals, ["agent", "hop"])
    quotas = keep(qu.bin_quotas(sized, probabilities, bounds, lambda i: u(f"{name}_unit", "agent", "hop", i)), "bin_quotas")
    last = len(bounds) - 1
    wanted = in_bins.join(quotas.where("quota > 0"), ["agent", "hop", "bin"], "left_semi")
    scored = sa.scored(wanted.where(F.col("bin") < last), metric, weights).join(quotas, ["agent", "hop", "bin"])
    heavy = sa.weighted_top(scored, F.col("quota"), u(name, "agent", "candidate"))
    even = sa.uniform_top(wanted.where(F.col("bin") == last).join(quotas, ["agent", "hop", "bin"]), F.col("quota"), u(name, "agent", "candidate"))
    return heavy.select("agent", "hop", "bin", "candidate").unionByName(even.select("agent", "hop", "bin", "candidate"))


#: Years after which the parts of nodes and edges are written together, so that plans stay short.
MERGE = 16


def run(spark: SparkSession, state: State, s: Settings, years: int, out_degrees: DataFrame, num_authors: DataFrame, probabilities: list[float], planted: DataFrame | None = None, clonal: DataFrame | None = None) -> State:
    """So many years from the one after the newest node."""
    newest = gr.graph_nodes(state.nodes, state.edges).agg(F.max("year")).first()[0]
    s = Settings(**(s.__dict__ | {"start_year": s.start_year or newest + 1}))
    for k in range(1, years + 1):
        made = one_year(spark, state, s, newest + k, out_degrees, num_authors, probabilities, planted, clonal, k)
        # both parts are written: a year is added, older ones are read where they lie
        nodes = state.nodes.unionByName(made.new_nodes, allowMissingColumns=True)
        edges = gr.append_edges(state.edges.select("source", "target"), made.new_edges)
        if k % MERGE == 0:
            nodes, edges = keep(nodes, "nodes"), keep(edges, "all_edges")
        state = State(nodes, edges, made.authors, state.timing)
    return state
