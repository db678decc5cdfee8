"""python -m citeloom.cli --config FILE: read a network, simulate, write the grown network."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config, read_config
from .functions.rng import u_fast
from .functions.scores import elapsed
from .operators import authors as au
from .operators import graph as gr
from .plans.simulate import Settings, State, draw_from, indexed_bag, run
from .plans.state import keep
from .sources import readers, sinks


class LogFormat(logging.Formatter):
    """[LEVEL][d-h:m:s](t=Ns) message"""

    def format(self, record: logging.LogRecord) -> str:
        seconds = int(record.relativeCreated / 1000)
        return f"[{record.levelname}][{elapsed(seconds)}](t={seconds}s) {record.getMessage()}"


def settings(c: Config) -> Settings:
    return Settings(
        growth_rate=c.growth_rate, bounds=c.recency_bins, cap=None if c.neighborhood_sample == -1 else c.neighborhood_sample, use_alpha=c.use_alpha, alpha=c.alpha, minimum_alpha=c.minimum_alpha,
        weights=(c.preferential_weight, c.fitness_weight, c.num_authors_weight, c.author_reputation_weight), lag=(c.fitness_lag_duration_min, c.fitness_lag_duration_max),
        duration=(c.fitness_peak_duration_min, c.fitness_peak_duration_max), fitness=(c.fitness_value_min, c.fitness_value_max), same_year=c.same_year_citations, random_share=c.fully_random_citations,
        cartel_share=c.cartel_outdegree_proportion, null_cartel=c.null_cartel, generator_probability=c.non_random_generator_probability, degree_percent=c.in_degree_threshold, fitness_percent=c.fitness_threshold,
        recency=c.recency_threshold, lifetime=c.author_max_lifetime, theta=max(0, c.theta), seed=c.seed,
    )


def simulate(spark: SparkSession, c: Config) -> State:
    edges = keep(readers.read_edgelist(spark, c.edgelist), "edges")
    bag, authors_bag = readers.read_out_degree_bag(spark, c.out_degree_bag), readers.read_bag(spark, c.num_authors_bag)
    if c.start_from_checkpoint:
        nodes = readers.read_checkpoint(spark, c.nodelist, c.keep_fitness)
        authors = readers.checkpoint_authors(nodes)
        nodes = nodes.drop("in_degree", "out_degree", "cartel_id", "final_author_reputation", *([] if c.keep_fitness else ["num_authors"]))
    else:
        nodes, authors = au.first_authors(readers.read_nodelist(spark, c.nodelist), c.author_max_lifetime, c.seed)
        nodes = gr.seed_reputations(nodes, edges)
    unknown = gr.node_set(edges).join(nodes, "node_id", "left_anti").limit(1).count()
    if unknown:
        raise ValueError("an edge has an end that the node list lacks")
    if "num_authors" not in nodes.columns:
        nodes = draw_from(nodes, *indexed_bag(authors_bag, spark), u_fast("seed_authors", "node_id", seed=c.seed), "num_authors")
    nodes = readers.with_communities(nodes, readers.read_communities(spark, c.community_assignment)) if c.community_assignment else nodes.drop("cluster_id").withColumn("cluster_id", F.lit(None).cast("long"))
    table = readers.read_recency_table(spark, c.recency_table)
    probabilities = [r["probability"] for r in gr.bin_probabilities(table, list(c.recency_bins)).orderBy("bin").collect()]
    planted = readers.read_planted(spark, c.planted_nodes) if c.planted_nodes else None
    clonal = readers.read_clonal(spark, c.clonal_cartel_agent_file) if c.clonal_cartel_agent_file else None
    return run(spark, State(keep(nodes, "nodes"), edges, keep(authors, "authors")), settings(c), c.num_cycles, bag, authors_bag, probabilities, planted, clonal)


def write(spark: SparkSession, state: State, c: Config) -> None:
    nodes = gr.graph_nodes(state.nodes, state.edges)
    degree = keep(gr.degrees(nodes, state.edges), "degrees")
    h = gr.author_h_index(nodes, degree)
    sinks.write_edgelist(state.edges, c.output_file)
    sinks.write_nodelist(sinks.nodelist_rows(nodes, degree, h, state.authors), c.auxiliary_information_file)
    if c.log_file and c.log_level >= 1:
        timing = spark.createDataFrame(state.timing, "year int, label string, ms long")
        timing.coalesce(1).write.mode("overwrite").csv(f"{c.log_file}_timing", header=False)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--config", required=True)
    c = read_config(parser.parse_args(argv).config)
    handler = logging.FileHandler(c.log_file, mode="w") if c.log_file and c.log_level > 0 else logging.StreamHandler()
    handler.setFormatter(LogFormat())
    logging.basicConfig(level=logging.INFO if c.log_level >= 1 else logging.WARNING, handlers=[handler])
    spark = SparkSession.builder.appName("citeloom").getOrCreate()
    state = simulate(spark, c)
    logging.info("years simulated: %s", c.num_cycles)
    write(spark, state, c)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
