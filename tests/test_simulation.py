"""Properties of simulated years, files and restarts."""

import csv
import glob
import math
import random

import pytest
from pyspark.sql import functions as F

from citeloom import cli
from citeloom.config import ConfigError, parse_bounds, read_config
from citeloom.operators import graph as gr
from citeloom.sources import readers

INI = """[Environment]
edgelist = {d}/edges.csv
nodelist = {d}/{nodes}
growth_rate = 0.2
num_cycles = {cycles}
recency_table = {d}/recency.csv
recency_bins = 1,2,3,5 ; bins
out_degree_bag = {d}/degrees.csv
start_from_checkpoint = {restart}
planted_nodes = {planted}
{more}
[Agent]
num_authors_bag = {d}/authors.csv
same_year_citations = 0.25
author_max_lifetime = 30
preferential_weight = -1
fitness_weight = 1
num_authors_weight = 1
author_reputation_weight = 1
use_alpha = true
alpha = -1
theta = {theta}
fully_random_citations = 0.05
neighborhood_sample = 15
fitness_value_min = 1
fitness_value_max = 1000
fitness_lag_duration_min = 0
fitness_lag_duration_max = 2
fitness_peak_duration_min = 1
fitness_peak_duration_max = 3
in_degree_threshold = 5
fitness_threshold = 20
recency_threshold = 10
non_random_generator_probability = 0.3
cartel_outdegree_proportion = 0.5
null_cartel = {null}
clonal_cartel_agent_file =
[General]
output_file = {d}/out_edges{tag}
auxiliary_information_file = {d}/out_nodes{tag}
log_file = {d}/log{tag}
log_level = 1
num_processors = 4
seed = 4
"""


def write(path, header, rows):
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([header, *rows])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("net"))
    r = random.Random(1)
    years = {i: 1990 + i // 10 for i in range(80)}
    edges = {(i, r.randrange(10 * (i // 10))) for i in range(10, 80) for _ in range(4)}
    write(f"{d}/edges.csv", ["from", "to"], sorted(edges))
    write(f"{d}/nodes.csv", ["node_id", "year"], [*years.items(), (999, 1995)])
    write(f"{d}/recency.csv", ["age", "count"], [(0, 9), (1, 50), (2, 30), (3, 20), (4, 10), (6, 5), (1, 40)])
    write(f"{d}/degrees.csv", ["id", "n"], [(i, n) for i, n in enumerate((3, 5, 8, 12))])
    write(f"{d}/authors.csv", ["id", "n"], [(i, n) for i, n in enumerate((1, 2, 3))])
    write(f"{d}/planted.csv", ["year", "out_degree", "fit_peak_value"], [(1, 7, 77)])
    write(f"{d}/communities.csv", ["node_id", "comm_id"], [(i, i % 3) for i in range(80)])
    return d


def config(folder, name="c", **more):
    values = {"d": folder, "nodes": "nodes.csv", "cycles": 2, "restart": "false", "more": "", "tag": "", "planted": "", "theta": 0, "null": "false"} | more
    path = f"{folder}/{name}.ini"
    with open(path, "w") as f:
        f.write(INI.format(**values))
    return read_config(path)


def test_two_years(spark, folder):
    c = config(folder, planted=f"{folder}/planted.csv", more=f"community_assignment = {folder}/communities.csv", theta=5)
    state = cli.simulate(spark, c)
    nodes = {r["node_id"]: r.asDict() for r in state.nodes.collect()}
    edges = [tuple(r) for r in state.edges.select("source", "target").collect()]
    seeds = {n for n, r in nodes.items() if r["type"] == "seed"}
    graph = {x for e in edges for x in e}
    n = len({x for e in edges if e[0] in seeds for x in e})
    sizes = []
    for year in (1998, 1999):
        new = {i: r for i, r in nodes.items() if r["year"] == year}
        assert len(new) == math.ceil(n * 0.2)
        n += len(new)
        sizes.append(len(new))
        own = [e for e in edges if e[0] in new]
        assert len(own) == len({*own}) and not any(a == b for a, b in own)
        same = [e for e in own if nodes[e[1]]["year"] == year]
        assert len(same) == int(len(new) * 0.25) and len({a for a, _ in same}) == len(same)
        assert not {b for _, b in same} & {a for a, _ in same}
        for i, r in new.items():
            targets = [b for a, b in own if a == i]
            assert int(r["generator_node_string"]) in targets
            assert nodes[int(r["generator_node_string"])]["cluster_id"] == r["cluster_id"]
            # nothing is lost: the generator, the same-year paper and the rest make up the out-degree
            assert len(targets) == max(r["assigned_out_degree"], 1 + sum(a == i for a, _ in same))
            assert 1 <= r["fit_value"] <= 1000 and r["num_authors"] in (1, 2, 3)
    assert 999 not in graph
    planted = [r for r in nodes.values() if r.get("planted_nodes_line_number") is not None]
    assert [(r["planted_nodes_line_number"], r["assigned_out_degree"], r["fit_value"], r["year"]) for r in planted] == [(2, 7, 77, 1998)]
    again = cli.simulate(spark, c)
    assert sorted(map(tuple, again.edges.select("source", "target").collect())) == sorted(edges)
    cli.write(spark, state, c)
    rows = [r for p in glob.glob(f"{folder}/out_nodes/part*") for r in csv.DictReader(open(p))]
    assert len(rows) == len(graph) and [int(r["node_id"]) for r in rows] == sorted(graph)
    assert all(r["alpha"] == "-1" and r["generator_node_string"] == "no_generators" for r in rows if r["type"] == "seed")
    assert glob.glob(f"{folder}/log_timing/part*")


def test_restart_with_a_group(spark, folder):
    first = config(folder, "first", cycles=1, tag="_1")
    cli.write(spark, cli.simulate(spark, first), first)
    rows = [r for p in glob.glob(f"{folder}/out_nodes_1/part*") for r in csv.DictReader(open(p))]
    members = sorted({int(r["author_id"]) for r in rows})[:3]
    for r in rows:
        r["cartel_id"] = 1 if int(r["author_id"]) in members else -1
    write(f"{folder}/marked.csv", rows[0].keys(), [list(r.values()) for r in rows])
    edges = [r for p in glob.glob(f"{folder}/out_edges_1/part*") for r in list(csv.reader(open(p)))[1:]]
    write(f"{folder}/edges2.csv", ["s", "t"], edges)
    c = config(folder, "second", cycles=1, nodes="marked.csv", restart="true", tag="_2", null="true")
    c = type(c)(**(c.__dict__ | {"edgelist": f"{folder}/edges2.csv"}))
    state = cli.simulate(spark, c)
    new = state.nodes.where("year = 1999").collect()
    assert {*members} <= {r["author_id"] for r in new}
    assert {r["author_id"] for r in state.authors.where("cartel_id = 1").collect()} == {*members}
    papers = {r["node_id"]: r["author_id"] for r in state.nodes.collect()}
    edges = state.edges.collect()
    for r in new:
        if r["author_id"] in members:
            assert papers[int(r["generator_node_string"])] in {*members} - {r["author_id"]}
    assert len(edges) > 0


def test_readers(spark, folder):
    assert readers.delimiter(spark, f"{folder}/edges.csv") == ","
    assert readers.header_positions(spark, f"{folder}/nodes.csv") == {"node_id": 0, "year": 1}
    got = {r["age"]: r["count"] for r in readers.read_recency_table(spark, f"{folder}/recency.csv").collect()}
    assert got == {1: 40, 2: 30, 3: 20, 4: 10, 6: 5}
    write(f"{folder}/large.csv", ["id", "n"], [(1, 1501)])
    with pytest.raises(ValueError, match="1500"):
        readers.read_out_degree_bag(spark, f"{folder}/large.csv")
    write(f"{folder}/clonal.csv", ["out_degree", "fitness_peak_value"], [(5, 9), ("", 11)])
    assert readers.read_clonal(spark, f"{folder}/clonal.csv").first().asDict() == {"out_degree": 5, "fit_peak_value": 11}
    with open(f"{folder}/tab.tsv", "w") as f:
        f.write("a\tb\n1\t2\n1\t2\n")
    assert readers.read_edgelist(spark, f"{folder}/tab.tsv").collect() == [(1, 2), (1, 2)]


@pytest.mark.parametrize("text", ["2,3", "1,3,2", "1,-1", "x"])
def test_bad_bins(text):
    with pytest.raises(ConfigError):
        parse_bounds(text)


@pytest.mark.parametrize(("old", "new"), [("growth_rate = 0.2", ""), ("use_alpha = true", "use_alpha = yes"), ("\nalpha = -1\n", "\nalpha =\n"), ("same_year_citations = 0.25", "same_year_citations = 1"), ("neighborhood_sample = 15", "neighborhood_sample ="), ("[General]", "[Other]")])
def test_bad_config(folder, tmp_path, old, new):
    config(folder, "ok")
    path = tmp_path / "bad.ini"
    path.write_text(open(f"{folder}/ok.ini").read().replace(old, new))
    with pytest.raises(ConfigError):
        read_config(str(path))


def test_degrees_count_repeats(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 1)], "source long, target long")
    nodes = gr.node_set(edges)
    assert {r["node_id"]: (r["in_degree"], r["out_degree"]) for r in gr.degrees(nodes, edges).collect()} == {1: (1, 2), 2: (2, 1)}
    assert gr.valid_edges(edges, nodes.where(F.col("node_id") == 1)).count() == 0
