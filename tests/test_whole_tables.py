"""Queries that once saw a part of their tables, on small views against plain Python."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from citeloom.functions import rng
from citeloom.operators import community as co
from citeloom.operators import neighborhood as ne
from citeloom.operators import sampling as sa
from citeloom.plans import catalogue, state
from citeloom.plans.state import keep


def views(spark, edges, nodes=(), agents=()):
    """A stand-in for Views; nodes: (node_id, year, cluster_id), all nodes of the edges where none are given."""
    nodes = nodes or [(n, 1990, 0) for n in sorted({x for e in edges for x in e})]
    linked = spark.createDataFrame(edges, "source long, target long")
    return SimpleNamespace(
        spark=spark,
        edges=linked,
        adjacency=ne.placed(ne.adjacency(linked)),
        nodes=spark.createDataFrame(nodes, "node_id long, year int, cluster_id int"),
        agents=spark.createDataFrame(list(agents), "agent long, author_id long"),
    )


def brute_components(nodes, edges):
    label = {n: n for n in nodes}
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = {n: low if c == high else c for n, c in label.items()}
    return label


def cpm(groups, edges, gamma):
    inner = sum(any(a in g and b in g for g in groups) for a, b in edges)
    return inner - gamma * sum(len(g) * (len(g) - 1) / 2 for g in groups)


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [{items[0]}, *rest]
        for i in range(len(rest)):
            yield [*rest[:i], {items[0], *rest[i]}, *rest[i + 1 :]]


def groups_of(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["cluster_id"], set()).add(r["node_id"])
    assert all(min(g) == c for c, g in groups.items())
    return list(groups.values())


# odd sources, targets that three does not divide, a long path, parallel edges and a ring
EDGES = [(i + 1, i) for i in range(20)] + [(101, 100), (103, 101), (103, 101), (207, 205), (205, 203), (203, 207), (305, 304)]


def test_components_of_the_whole_network(spark):
    got = catalogue.connected_components(views(spark, EDGES)).collect()
    assert len(got) == len({x for e in EDGES for x in e})
    assert {r["node_id"]: r["component"] for r in got} == brute_components({x for e in EDGES for x in e}, EDGES)


@pytest.mark.parametrize("often", [0, 3, 10**6])
def test_components_with_frequent_labels(spark, often):
    edges = EDGES + [(1000 + i, 1000) for i in range(1, 40)] + [(2000 + i, 1010) for i in range(5)] + [(-4, -9), (-4, 3000), (3001, 3001)]
    v = views(spark, edges)
    got = [tuple(r) for r in co.connected_components(v.nodes.select("node_id"), v.edges, often).collect()]
    ids = {x for e in edges for x in e}
    assert len(got) == len(ids) and dict(got) == brute_components(ids, edges)


def test_communities_of_the_whole_network(spark):
    clique = lambda ids: [(b, a) for a in ids for b in ids if a < b]
    left, right = range(1, 13), range(21, 33)
    # joining the cliques would gain one edge and cost 0.01 * 12 * 12
    edges = clique(left) + clique(right) + [(21, 12), (103, 101), (107, 103)]
    got = groups_of(catalogue.leiden_partition(views(spark, edges)).collect())
    assert sorted(map(sorted, got)) == [[*left], [*right], [101, 103, 107]]


@pytest.mark.parametrize("gamma", [0.01, 0.3, 0.6])
def test_communities_reach_the_best_partition(spark, gamma):
    edges = [(2, 1), (3, 1), (3, 2), (4, 3), (5, 4), (6, 4), (6, 5), (9, 7)]
    v = views(spark, edges)
    found = groups_of(co.communities(v.nodes.select("node_id"), v.edges, "cpm", gamma).collect())
    ids = sorted({x for e in edges for x in e})
    assert sorted(x for g in found for x in g) == ids
    assert cpm(found, edges, gamma) == pytest.approx(max(cpm(p, edges, gamma) for p in partitions(ids)))


def test_every_agent_has_cluster_candidates(spark):
    nodes = [(n, 1995 + n % 8, n % 4 if n % 9 else -1) for n in range(40)]
    v = views(spark, [(1, 0)], nodes, [(a, 0) for a in range(1, 60)])
    cluster = {n: c for n, _, c in nodes}
    picks = {r["agent"]: r["generator"] for r in catalogue.generator_picks(v).collect()}
    assert len(picks) == 59
    want = {(a, n) for a, g in picks.items() for n, y, c in nodes if c == cluster[g] >= 0 and n != g and y < catalogue.NOW}
    got = [tuple(r) for r in catalogue.cluster_candidates(v).select("agent", "candidate").collect()]
    assert len(got) == len(want) and {*got} == want


def test_cluster_members_are_met_in_blocks(spark, monkeypatch):
    """One large cluster, two small ones and an unknown one; agents meet blocks, not single members."""
    monkeypatch.setattr(ne, "MEMBERS", 16)
    rows = [(n, 1990 + n % 14, 0 if n % 10 else n % 4 - 1) for n in range(2000)] + [(5000, 1990, None)]
    nodes = spark.createDataFrame(rows, "node_id long, year int, cluster_id int")
    agents = [(9000 + i, 7 * i, i % 4 - 1) for i in range(12)] + [(9100, 3, None), (9101, 3, 77)]
    blocks = ne.member_blocks(nodes, 2001).collect()
    assert 40 < len(blocks) < 200 and max(len(b["members"]) for b in blocks) < 64
    assert sorted((b["cluster_id"], m) for b in blocks for m in b["members"]) == sorted((c, n) for n, y, c in rows if y < 2001 and c is not None and c >= 0)
    got = ne.cluster_candidates(spark.createDataFrame(agents, "agent long, generator long, cluster_id int"), nodes, 2001).collect()
    want = [(a, n) for a, g, c in agents for n, y, k in rows if c is not None and c >= 0 and k == c and y < 2001 and n != g]
    assert sorted((r["agent"], r["candidate"]) for r in got) == sorted(want)


@pytest.mark.parametrize("override", [False, True])
def test_cluster_rows_are_written_tightly(spark, tmp_path, monkeypatch, override):
    """Every pair is there, and takes a small part of the 1.6 bytes of rows that go agent by agent; several teams and blocks."""
    monkeypatch.setattr(ne, "TEAM", 300, raising=False)
    nodes = spark.range(6000).selectExpr("id * 7919 as node_id", "1990 as year", "cast(id % 2 as int) as cluster_id")
    agents = spark.range(1000).selectExpr("id + 100000000 as agent", "id * 7919 as generator", "cast(id % 2 as int) as cluster_id")
    if override:
        hops = spark.createDataFrame([(100000000, 2, 5), (7, 1, 8)], "agent long, hop int, candidate long")
        rows = ne.cluster_override(hops, agents, nodes, 2001)
        got = rows.where("not ((agent = 100000000 and candidate = 5) or agent = 7)").select("agent", "candidate")
        assert rows.count() == got.count() + 2
    else:
        rows = got = ne.cluster_candidates(agents, nodes, 2001)
    want = agents.join(nodes, "cluster_id").where("node_id <> generator").select("agent", F.col("node_id").alias("candidate"))
    assert got.count() == want.count() == 1000 * 2999
    assert got.exceptAll(want).isEmpty()
    rows.write.parquet(str(tmp_path / "rows"))
    assert sum(f.stat().st_size for f in (tmp_path / "rows").glob("*.parquet")) < 0.4 * 1000 * 2999


def test_every_source_makes_the_round_trip(spark):
    edges = [(s, (7 * s + k) % 50) for s in range(60, 75) for k in range(s % 4)]
    want = {}
    for s, t in edges:
        want.setdefault(s, []).append(t)
    got = {r["node_id"]: (r["encoded"], r["n"]) for r in catalogue.generator_string_roundtrip(views(spark, edges)).collect()}
    assert got == {s: (";".join(map(str, sorted(ts))), len(ts)) for s, ts in want.items()}


def test_random_fill_beside_a_hub(spark):
    edges = [(i, 0) for i in range(1, 9)] + [(9, 10), (10, 11)]  # 0 has eight neighbours of twelve nodes
    v = views(spark, edges, agents=[(a, 0) for a in range(200)])
    picks = {r["agent"]: r["generator"] for r in catalogue.generator_picks(v).collect()}
    near = {n: {b for a, b in edges if a == n} | {a for a, b in edges if b == n} for n in range(12)}
    assert any(g == 0 and a % 5 == 4 for a, g in picks.items())
    got = {}
    for r in catalogue.random_fill(v).collect():
        got.setdefault(r["agent"], []).append(r["target"])
    for a, g in picks.items():
        targets = got.get(a, [])
        assert len({*targets}) == len(targets) == min(a % 5, 12 - len(near[g]))
        assert {*targets} <= {*range(12)} - near[g]


def test_random_fill_meets_the_last_free_nodes(spark):
    indexed = spark.range(3000).select(F.col("id").alias("idx"), F.col("id").alias("node_id"))
    taken = spark.createDataFrame([(1, i) for i in range(3000) if i not in (17, 2900)], "agent long, target long")
    wanted = spark.createDataFrame([(1, 2), (2, 2)], "agent long, f int")
    rows = sa.random_fill(wanted, indexed, 3000, taken, lambda a, n: rng.u("f", a, n), rounds=2).collect()
    assert sorted(r["target"] for r in rows if r["agent"] == 1) == [17, 2900]
    assert len({r["target"] for r in rows if r["agent"] == 2}) == 2 and len(rows) == 4


def planted(groups=6, size=15, seed=3):
    """Dense groups with a few links between them, and a hub that all know."""
    draw = random.Random(seed)
    ids = range(groups * size)
    edges = [(b, a) for a in ids for b in range(a + 1, len(ids)) if draw.random() < (0.8 if a // size == b // size else 0.01)]
    return edges + [(i, 1000) for i in ids]


def is_connected(group, edges):
    return len({*brute_components(group, [e for e in edges if e[0] in group and e[1] in group]).values()}) == 1


@pytest.mark.parametrize("gamma", [0.05, 0.3])
def test_large_components_are_contracted(spark, gamma):
    edges = planted() + [(2001, 2000), (2002, 2001), (3000, 3000)]
    v = views(spark, edges)
    ids = sorted({x for e in edges for x in e})
    at_once = groups_of(co.communities(v.nodes.select("node_id"), v.edges, "cpm", gamma).collect())
    for limit in (100, 1):
        found = groups_of(co.communities(v.nodes.select("node_id"), v.edges, "cpm", gamma, limit).collect())
        assert sorted(x for g in found for x in g) == ids
        assert all(is_connected(g, edges) for g in found)
        assert cpm(found, edges, gamma) >= (0.9 if limit > 1 else 0.6) * cpm(at_once, edges, gamma)
    assert all(is_connected(g, edges) for g in at_once)


def test_no_merge_or_move_improves_communities():
    edges = planted()
    ids = {x: i for i, x in enumerate(sorted({x for e in edges for x in e}))}
    pairs = [(ids[a], ids[b], 1.0) for a, b in edges]
    for gamma in (0.05, 0.3, 0.7):
        found = co.leiden(len(ids), pairs, "cpm", gamma, 0.0)
        groups = [{i for i, c in enumerate(found) if c == k} for k in sorted({*found})]
        links = [(a, b) for a, b, _ in pairs]
        best = cpm(groups, links, gamma)
        assert all(is_connected(g, links) for g in groups)
        joins = lambda x, y: sum((a in x and b in y) or (a in y and b in x) for a, b in links)
        for k, g in enumerate(groups):
            assert all(joins(g, h) <= gamma * len(g) * len(h) + 1e-9 for h in groups[:k])
            for i in g:
                stays = joins({i}, g - {i}) - gamma * (len(g) - 1)
                assert stays >= -1e-9 and all(joins({i}, h) - gamma * len(h) <= stays + 1e-9 for h in groups if h is not g)
        assert best >= cpm([{i for x, i in ids.items() if x // 15 == k} for k in range(6)] + [{ids[1000]}], links, gamma) - 1e-9 or gamma != 0.3


def test_contraction_of_modularity(spark):
    edges = planted()
    v = views(spark, edges)
    for limit in (10**6, 100):
        found = groups_of(co.communities(v.nodes.select("node_id"), v.edges, "modularity", 1.0, limit).collect())
        assert sum(sum(i // 15 == k for i in max(found, key=lambda g: sum(i // 15 == k for i in g))) for k in range(6)) >= 80


def test_lists_of_many_pieces_and_ranges(spark, monkeypatch):
    """Pieces and ranges of a few places give the hops that whole lists give, hubs read by rows and short lists by arrays."""
    edges = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(i, 7 * i % 59 + 1) for i in range(1, 60)] + [(i, 100 + i % 9) for i in range(1, 60)], "source long, target long")
    picks = spark.createDataFrame([(1000 + i, i) for i in range(60)], "agent long, generator long")
    draw = lambda name, *c: rng.u(name, *c)
    whole = {tuple(r) for r in ne.placed_hops(picks, ne.packed(ne.adjacency(edges)), 5, draw).collect()}
    monkeypatch.setattr(ne, "PIECE", 4)
    monkeypatch.setattr(ne, "RANGE", 10)
    lists = ne.packed(ne.adjacency(edges.unionByName(edges)))
    assert lists.where("size(ids) > 4 or degree > 1000").isEmpty() and lists.where("node_id = 0").count() > 15
    assert {tuple(r) for r in ne.placed_hops(picks, lists, 5, draw).collect()} == whole


def shuffle_files(spark):
    spark.sparkContext._jvm.System.gc()
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    rows = spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    before = shuffle_files(spark)
    out = keep(rows, "tidy")
    assert not shuffle_files(spark) - before
    assert sorted(r["n"] for r in out.collect()) == [714] * 5 + [715] * 2
    assert not spark.conf._jconf.contains(state.TIDY) or spark.conf.get(state.TIDY) == "false"


def test_lists_packed_in_parts_are_whole(spark):
    rng_ = random.Random(5)
    edges = spark.createDataFrame([(rng_.randrange(300), rng_.randrange(300)) for _ in range(3000)] + [(7, n) for n in range(300, 2600)], "source long, target long")
    before = shuffle_files(spark)
    kept = ne.kept_adjacency(edges, "parts")
    assert not shuffle_files(spark) - before
    row = lambda r: (r["node_id"], r["piece"], r["first"], tuple(r["ids"]), r["degree"])
    assert sorted(map(row, kept.collect())) == sorted(map(row, ne.packed(ne.adjacency(edges)).collect()))


def test_component_links_shrink_by_level(spark, monkeypatch):
    """A chain, a star and a random part; links are renamed and written level by level."""
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(r.randint(2000, 2400), r.randint(2000, 2400)) for _ in range(900)]
    nodes, kept = sorted({x for e in edges for x in e}), []
    monkeypatch.setattr(co, "keep", lambda df, name: kept.append((name, keep(df, name))) or kept[-1][1])
    v = views(spark, edges)
    got = {r["node_id"]: r["component"] for r in co.connected_components(v.nodes.select("node_id"), v.edges, 20).collect()}
    assert got == brute_components(nodes, edges)
    alive = [0 for name, _ in kept if name == "links"]
    assert len(alive) > 1  # they were read whole in every round


def test_scores_read_written_metrics_and_bins(monkeypatch):
    """Their shuffle files are gone before candidates are scored."""
    kept = []
    monkeypatch.setattr(catalogue, "keep", lambda df, name, compact=False: kept.append((df, compact)) or f"{df}, written")
    monkeypatch.setattr(catalogue, "metric_table", lambda v: "metrics")
    monkeypatch.setattr(catalogue, "binned_hops", lambda v: "bins")
    monkeypatch.setattr(catalogue, "agent_weights", lambda v: "weights")
    monkeypatch.setattr(catalogue.sa, "scored", lambda *a: a)
    assert catalogue.scored_table(None) == ("bins, written", "metrics, written", "weights")
    assert sorted(kept) == [("bins", True), ("metrics", True)]


def test_quota_hops_are_made_once(monkeypatch):
    made = []
    monkeypatch.setattr(catalogue, "capped_hops", lambda v: made.append(v) or v.hops)
    monkeypatch.setattr(catalogue, "split_table", lambda v, hopped: v.split)
    monkeypatch.setattr(catalogue, "keep", lambda df, name: df)
    monkeypatch.setattr(catalogue.ne, "binned", lambda *a: a[0])
    monkeypatch.setattr(catalogue.ne, "bin_counts", lambda rows: rows)
    monkeypatch.setattr(catalogue.qu, "size_arrays", lambda rows, n: Frame())
    monkeypatch.setattr(catalogue.qu, "bin_quotas", lambda *a: a[0])
    monkeypatch.setattr(catalogue, "F", SimpleNamespace(lit=lambda x: Frame(), col=lambda x: Frame()))
    catalogue.bin_quota_table(SimpleNamespace(hops=Frame(), split=Frame(), nodes=None))
    assert len(made) == 1


class Frame:
    """Stands for a table or column whose rows don't matter."""

    def __getattr__(self, name):
        return lambda *a: self
