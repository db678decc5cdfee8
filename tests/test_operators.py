"""Hand-made cases whose answers follow from the operators' definitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.functions import rng, scores
from citeloom.operators import agents as ag
from citeloom.operators import authors as au
from citeloom.operators import community as co
from citeloom.operators import graph as gr
from citeloom.operators import leiden
from citeloom.operators import neighborhood as ne
from citeloom.operators import quota as qu
from citeloom.operators import sampling as sa
from citeloom.plans.simulate import growth


def values(spark, rows, schema, *columns):
    return spark.createDataFrame(rows, schema).select(*columns).collect()


def test_bin_index(spark):
    got = values(spark, [(a,) for a in (0, -3, 1, 4, 5, 10, 99)], "a int", scores.bin_index(F.col("a"), [1, 2, 5, 10]))
    assert [r[0] for r in got] == [3, 3, 0, 1, 2, 3, 3]


def test_power_and_decay(spark):
    got = values(spark, [(x,) for x in (0, 1, 2, 3)], "x int", scores.power_score(F.col("x")))
    assert [r[0] for r in got] == [2, 2, 9, 28]
    years = (2001, 2002, 2005, 2006, 2008, 2010)
    got = values(spark, [(t,) for t in years], "t int", scores.decayed_fitness(F.lit(100), F.lit(2000), F.lit(2), F.lit(3), F.col("t")))
    assert [r[0] for r in got] == [1, 100, 100, 12, 1, 0]


def test_h_index(spark):
    papers = {1: [5, 4, 4, 1], 2: [0], 3: [3, 3, 3], 4: [10]}
    rows = [(a, 10 * a + i, d) for a, ds in papers.items() for i, d in enumerate(ds)]
    nodes = spark.createDataFrame([(a, n) for a, n, _ in rows], "author_id long, node_id long")
    degree = spark.createDataFrame([(n, d) for _, n, d in rows if d], "node_id long, in_degree long")
    assert {r[0]: r[1] for r in gr.author_h_index(nodes, degree).collect()} == {1: 3, 2: 0, 3: 3, 4: 1}


def test_eligible_cut(spark):
    rows = [(i, 2000, "agent", v, 1) for i, v in enumerate(range(10, 0, -1))]
    m = spark.createDataFrame(rows, "node_id long, year int, type string, in_degree long, fitness int")
    got = ag.eligible_generators(m, 2001, 2001, 10, 20, 100, 1000)
    assert sorted(r[0] for r in got.collect()) == [0, 1]
    assert ag.eligible_generators(m.where("false"), 2001, 2001, 10, 20, 20, 1000).collect() == []


def test_hop_split(spark):
    c1, c2 = scores.hop_split(F.col("q"), F.col("a"), F.col("n1"), F.col("n2"))
    got = values(spark, [(10, 0.35, 2, 20), (10, 0.5, 20, 1)], "q int, a double, n1 int, n2 int", c1.alias("c1"), c2.alias("c2"))
    assert [tuple(r) for r in got] == [(2, 8), (5, 1)]


@pytest.mark.parametrize(("total", "p", "sizes", "want"), [(10, (0.5, 0.3, 0.2), (2, 10, 10), (2, 6, 2)), (6, (0.0, 1.0, 0.0), (2, 3, 9), (2, 3, 1))])
def test_bin_quota(spark, total, p, sizes, want):
    df = spark.createDataFrame([(1, 1, total, list(sizes))], "agent long, hop int, total int, sizes array<int>")
    got = qu.bin_quotas(df, list(p), [1, 2, 5], lambda i: rng.u("t", i))
    assert tuple(r["quota"] for r in got.orderBy("bin").collect()) == want


def test_shares_and_moves_are_computed_once(spark):
    """Not once for every bin that reads them: the plan spells each fold out once."""
    groups = spark.createDataFrame([(1, 1, 7, [2, 9, 1])], "agent long, hop int, total int, sizes array<int>")
    targets = groups.select(qu.bin_targets(F.col("total"), [0.5, 0.2, 0.1], [1, 2, 3], lambda i: rng.u("x", "agent", i)).alias("t"))
    assert targets._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
    settled = groups.select(qu.rebalance(F.col("sizes"), F.col("sizes")).alias("t"))
    assert settled._jdf.queryExecution().analyzed().toString().count("aggregate(") == 3


def test_hop_quota_is_met(spark):
    r = random.Random(5)
    rows = []
    for i in range(300):
        sizes = [r.randint(0, 6) for _ in range(4)]
        rows.append((i, 1, r.randint(0, sum(sizes)), sizes))
    df = spark.createDataFrame(rows, "agent long, hop int, total int, sizes array<int>")
    got = qu.bin_quotas(df, [0.4, 0.3, 0.2, 0.1], [1, 2, 3, 5], lambda i: rng.u("t", "agent", i)).groupBy("agent").agg(F.sum("quota").alias("q"))
    assert {r["agent"]: r["q"] for r in got.collect()} == {i: t for i, _, t, _ in rows}


def brute_rebalance(targets, sizes):
    t = list(targets)
    for b in range(len(t)):
        excess = max(0, t[b] - sizes[b])
        for j in [*range(b - 1, -1, -1), *range(b + 1, len(t))]:
            move = min(excess, max(0, sizes[j] - t[j]))
            t[j] += move
            t[b] -= move
            excess -= move
    return t


def test_rebalance_matches_brute_force(spark):
    r = random.Random(9)
    rows = [([r.randint(0, 9) for _ in range(5)], [r.randint(0, 9) for _ in range(5)]) for _ in range(200)]
    df = spark.createDataFrame(rows, "t array<int>, s array<int>")
    got = df.select("t", "s", qu.rebalance(F.col("t"), F.col("s")).alias("r")).collect()
    assert all(row["r"] == brute_rebalance(row["t"], row["s"]) for row in got)


def test_agent_quota(spark):
    df = spark.createDataFrame([(1, 20, 1, 1, 1, 4)], "agent long, out_degree int, generators int, same_year int, cartel_id int, cartel_size int")
    row = qu.agent_quotas(df, 0.5, 0.05).first()
    assert (row["cartel"], row["reserve"], row["q"]) == (3, 1, 14)


def test_growth():
    assert growth(100, 0.03, 3) == [(0, 100), (1, 103), (2, 107), (3, 111)]


def test_isolated_node_is_no_graph_node(spark):
    edges = spark.createDataFrame([(1, 2)], "source long, target long")
    nodes = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "node_id long, year int")
    assert sorted(r[0] for r in gr.graph_nodes(nodes, edges).collect()) == [1, 2]


def test_capped_out_first_hop_stays_out_of_the_second(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 9)] + [(i, 8) for i in range(1, 8)] + [(1, 50)], "source long, target long")
    picks = spark.createDataFrame([(100, 0)], "agent long, generator long")
    got = ne.hops(picks, ne.placed(ne.adjacency(edges)), 3, lambda name, *c: rng.u(name, *c)).collect()
    near = {r["candidate"] for r in got if r["hop"] == 1}
    assert len(near) == 3 and not any(r["candidate"] in range(9) for r in got if r["hop"] == 2)


def test_lotka_needs_more_than_one():
    walk = au.GrowthWalk({1: 8, 2: 1}, {1: 8, 2: 1}, 30)
    assert walk.deficit() is None  # two are expected and one is there
    assert walk.next_author(2001, 0) == 0 and walk.births[0] == 2001
    walk.totals[2] = 0
    assert walk.deficit() == 2
    assert walk.next_author(2001, 1) in {au.COUNT, 0}


def test_lotka_skips_the_dead_and_the_barred(spark):
    schema = "author_id long, birth_year int, pub_count long, cartel_id int"
    one = spark.createDataFrame([(7,)], "agent long")
    dead = spark.createDataFrame([(i, 1900, 1, None) for i in range(12)], schema)
    assert au.grow(one, dead, 2001, 30)[0].collect() == [(7, 12)]
    barred = spark.createDataFrame([(i, 2000, 1, 1 if i < 11 else None) for i in range(12)], schema)
    assert au.grow(one, barred, 2001, 30)[0].collect() == [(7, 11)]


def brute_growth(agents, authors, year, lifetime, rank, named):
    """The same law over explicit lists: agent -> author, and publication counts."""
    pubs = {a: n for a, _, n, _ in authors}
    alive = {a for a, born, _, c in authors if c is None and year - born < lifetime}
    next_id = max([-1, *pubs, *named.values()]) + 1
    fresh, touched = {}, {}
    for a in sorted((a for a in alive if a not in named.values()), key=rank):
        fresh.setdefault(pubs[a], []).append(a)
    for a in pubs:
        if a in named.values() and a in alive:
            touched.setdefault(pubs[a], []).append(a)
    out = {}
    for i, agent in enumerate(sorted(agents)):
        if agent in named:
            a = named[agent]
            if a in touched.get(pubs.get(a, 0), []):
                touched[pubs[a]].remove(a)
                touched.setdefault(pubs[a] + 1, []).append(a)
            elif a not in pubs:
                touched.setdefault(1, []).append(a)
            pubs[a] = pubs.get(a, 0) + 1
            out[agent] = a
            continue
        count = lambda k: sum(n == k for n in pubs.values())
        k, wanted = 2, None
        while (expected := math.floor(count(1) / k**2 + 0.5)) >= 1:
            if expected - count(k) > 1:
                wanted = k
                break
            k += 1
        old, new = fresh.get(k - 1, []), touched.setdefault(k - 1, [])
        if wanted and old + new:
            at = int(au.draw(0, "author", year, i) * (len(old) + len(new)))
            if at < len(old):
                a = old.pop(0)
            else:
                a, new[at - len(old)] = new[at - len(old)], new[-1]
                new.pop()
        else:
            a, next_id = next_id, next_id + 1
        pubs[a] = pubs.get(a, 0) + 1
        touched.setdefault(pubs[a], []).append(a)
        out[agent] = a
    return out, pubs


def test_growth_matches_explicit_lists(spark):
    r = random.Random(3)
    authors = [(a, r.choice([1950, 1990, 2000]), r.choice([1, 1, 1, 1, 2, 3]), 4 if a % 17 == 0 else None) for a in range(200)]
    agents = [3 * i for i in range(150)]
    named = {9: 17, 30: 500, 33: 500, 60: 21, 63: 34}
    df = spark.createDataFrame(authors, "author_id long, birth_year int, pub_count long, cartel_id int")
    u = {r["author_id"]: r["u"] for r in df.select("author_id", rng.u_fast("author_rank", "author_id", seed=0).alias("u")).collect()}
    want, pubs = brute_growth(agents, authors, 2001, 30, lambda a: (u[a], a), named)
    given, grown = au.grow(spark.createDataFrame([(a,) for a in agents], "agent long"), df, 2001, 30, 0, spark.createDataFrame([*named.items()], "agent long, author_id long"))
    assert {r["agent"]: r["author_id"] for r in given.collect()} == want
    assert {r["author_id"]: r["pub_count"] for r in grown.collect()} == pubs
    births = {a: b for a, b, _, _ in authors}
    assert all(r["birth_year"] == births.get(r["author_id"], 2001) for r in grown.collect())
    assert len({*want.values()} & {a for a, *_ in authors}) > 10  # somebody was promoted


def test_first_authors_follow_the_law(spark):
    nodes = spark.createDataFrame([(i, 1950 + i // 40) for i in range(2000)], "node_id long, year int")
    named, authors = au.first_authors(nodes, 10)
    rows = named.collect()
    born = {r["author_id"]: r["birth_year"] for r in authors.collect()}
    assert len(rows) == 2000 and sum(r["pub_count"] for r in authors.collect()) == 2000
    assert all(0 <= r["year"] - born[r["author_id"]] <= 10 for r in rows)
    assert sorted(born) == [*range(len(born))]
    pubs = sorted((r["pubs"], r["authors"]) for r in gr.publication_histogram(named).collect())
    assert pubs[0][0] == 1 and dict(pubs).get(2, 0) >= pubs[0][1] / 4 - 3  # the law is met


def test_seed_reputation_is_the_h_index_up_to_the_year(spark):
    r = random.Random(2)
    papers = [(i, r.randrange(6), 1990 + r.randrange(8)) for i in range(120)]
    edges = [(a, b) for a in range(120) for b in range(a) if r.random() < 0.04]
    cites = {i: sum(t == i for _, t in edges) for i in range(120)}

    def h(author, year):
        d = sorted((cites[i] for i, a, y in papers if a == author and y <= year), reverse=True)
        return sum(x >= k + 1 for k, x in enumerate(d))

    nodes = spark.createDataFrame(papers, "node_id long, author_id long, year int")
    got = gr.seed_reputations(nodes, spark.createDataFrame(edges, "source long, target long")).collect()
    assert {r["node_id"]: r["initial_author_reputation"] for r in got} == {i: h(a, y) for i, a, y in papers}


def test_draw_from_a_bag_is_uniform(spark):
    from citeloom.plans.simulate import draw_from, indexed_bag

    bag = spark.createDataFrame([(v,) for v in [1] * 3000 + [2] * 1000 + list(range(10, 1010))], "value int")
    got = draw_from(spark.range(50_000), *indexed_bag(bag, spark), rng.u("b", "id"), "x")
    counts = {r["x"]: r["count"] for r in got.groupBy("x").count().collect()}
    assert sum(counts.values()) == 50_000 and abs(counts[1] - 30_000) < 600 and abs(counts[2] - 10_000) < 500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def py_places(degree, want, few, *names):
    purpose, *rest = names
    a, b = (math.floor(au.draw(0, f"{purpose}_{k}", *rest) * rng.SEEDS) for k in "ab")

    def number(n):
        x = (a + n * rng.STRIDE) % rng.PRIME
        return (x * x % rng.PRIME + b) ** 2 % rng.PRIME

    if degree <= few:
        return sorted(range(degree), key=lambda p: (number(p), p))[:want]
    line = [math.floor(number(n) * degree / rng.PRIME) for n in range(1, 2 * degree + 1)] + [*range(degree)]
    return [*dict.fromkeys(line)][:want]


def test_drawn_places_are_uniform(spark):
    for degree, few, want in ((30, 80, 5), (200, 80, 20), (100_000, 80, 20)):
        rows = spark.range(20_000).select(F.explode(ne.drawn_places(F.lit(degree).cast("long"), F.lit(want), few, rng.line_seeds(lambda name, *c: rng.u(name, *c), "p", "id"))).alias("place"), "id")
        assert rows.distinct().count() == 20_000 * want
        tenths = [r["n"] for r in rows.groupBy(F.floor(F.col("place") * 10 / degree).alias("t")).agg(F.count("*").alias("n")).collect()]
        assert len(tenths) == 10 and all(abs(n - 2_000 * want) < 6 * (2_000 * want) ** 0.5 for n in tenths)
        # no two neighbouring places go together more often than others
        both = rows.alias("a").join(rows.alias("b"), "id").where("b.place = a.place + 1").count()
        expected = 20_000 * want * (want - 1) / degree
        assert abs(both - expected) < 6 * expected**0.5 + 5


@pytest.mark.parametrize("cap", [2, 5, 30])
def test_hops_match_a_walk_along_the_line(spark, cap):
    r = random.Random(cap)
    edges = [(a, b) for a in range(120) for b in range(a) if r.random() < (0.9 if b < 3 else 0.03)]
    edges += [(7, 7), (3, 5), (5, 3)]
    near = {n: sorted({b for a, b in edges if a == n} | {a for a, b in edges if b == n} - {n}) for n in range(120)}
    near = {n: [x for x in v if x != n] for n, v in near.items()}
    picks = [(1000 + i, i) for i in range(120)]
    draw = lambda *names: au.draw(0, *names)
    want = set()
    for agent, g in picks:
        d = len(near[g])
        first = [near[g][p] for p in (range(d) if d <= cap else py_places(d, cap, 4 * cap, "cap1", agent))]
        want |= {(agent, 1, x) for x in first}
        line = []
        for parent in sorted(first, key=lambda x: (draw("cap2p", agent, x), x)):
            line += [near[parent][p] for p in py_places(len(near[parent]), len(near[parent]), 4 * cap, "cap2c", agent, parent)]
        want |= {(agent, 2, x) for x in [x for x in dict.fromkeys(line) if x != g and x not in near[g]][:cap]}
    adj = ne.placed(ne.adjacency(spark.createDataFrame(edges, "source long, target long")))
    hopped = ne.placed_hops(spark.createDataFrame(picks, "agent long, generator long"), adj, cap, lambda name, *c: rng.u(name, *c))
    rows = hopped.collect()
    assert len(rows) == len(want) and {(r["agent"], r["hop"], r["candidate"]) for r in rows} == want
    for k in (1, cap, cap + 1):
        pooled = ne.pooled(hopped, k).groupBy("agent").count().collect()
        assert {r["agent"]: r["count"] for r in pooled} == {a: min(k, sum(x[0] == a for x in want)) for a, _ in picks if any(x[0] == a for x in want)}


def test_a_hub_is_sampled_without_reading_its_list(spark):
    hub = spark.range(1, 1_000_001).select(F.col("id").alias("source"), F.lit(0).cast("long").alias("target"))
    edges = hub.unionByName(spark.createDataFrame([(0, 2_000_000), (2_000_000, 2_000_001)], "source long, target long"))
    adj = ne.placed(ne.adjacency(edges))
    from citeloom.plans.state import keep

    adj = keep(adj, "hub")
    picks = spark.range(200).select((F.col("id") + 5_000_000).alias("agent"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("generator"))
    got = ne.placed_hops(picks, adj, 20, lambda name, *c: rng.u(name, *c)).groupBy("agent", "hop").agg(F.countDistinct("candidate").alias("n")).collect()
    sizes = {(r["agent"] - 5_000_000, r["hop"]): r["n"] for r in got}
    assert all(sizes[i, 1] == 20 for i in range(0, 200, 2))
    # a leaf has the hub as its only neighbour, and 20 of the hub's others in the second hop
    assert all((sizes[i, 1], sizes[i, 2]) == (1, 20) for i in range(1, 200, 2))
    places = adj.where("node_id = 0").agg(F.count("*"), F.countDistinct("place"), F.min("place"), F.max("place")).first()
    assert tuple(places) == (1_000_001, 1_000_001, 0, 1_000_000)


def test_users_plans_cut_groups_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("agent"), F.lit(1).alias("hop"), F.lit(0).alias("bin"), F.col("id").alias("candidate"), F.lit(1.0).alias("score"), (F.col("id") % 7).alias("quota"))
    for top in (sa.weighted_top(rows, F.col("quota"), rng.u("w", "candidate")), sa.uniform_top(rows, F.lit(3), rng.u("w", "candidate"))):
        assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    counts = {r["agent"]: r["count"] for r in sa.weighted_top(rows, F.col("quota"), rng.u("w", "candidate")).groupBy("agent").count().collect()}
    assert counts == {a: a for a in range(1, 7)}
    large = spark.range(3000).select(F.lit(1).alias("agent"), F.lit(1).alias("hop"), F.lit(0).alias("bin"), F.col("id").alias("candidate"))
    assert [sa.uniform_top(large, F.lit(q), rng.u("w", "candidate")).count() for q in (1200, 1600)] == [1200, 1500]


def test_driver_and_spark_draw_alike(spark):
    got = spark.range(20).select("id", rng.u("x", 7, "id", seed=3).alias("u")).collect()
    assert all(math.isclose(r["u"], au.draw(3, "x", 7, r["id"]), rel_tol=0, abs_tol=0) for r in got)


def test_weighted_sampling_follows_the_weights(spark):
    rows = spark.range(20_000).select(F.col("id").alias("agent"), F.explode(F.array(*(F.struct(F.lit(i).alias("candidate"), F.lit(float(w)).alias("score")) for i, w in enumerate((1, 2, 3, 4))))).alias("c"))
    rows = rows.select("agent", F.lit(1).alias("hop"), F.lit(0).alias("bin"), "c.candidate", "c.score")
    got = sa.weighted_top(rows, F.lit(1), rng.u("w", "agent", "candidate")).groupBy("candidate").count().collect()
    for r in got:
        assert abs(r["count"] / 20_000 - (r["candidate"] + 1) / 10) < 0.012


def test_random_fill_is_exact(spark):
    indexed = spark.range(40).select(F.col("id").alias("idx"), (F.col("id") * 10).alias("node_id"))
    wanted = spark.createDataFrame([(1, 30), (2, 5), (3, 0), (4, 60)], "agent long, f int")
    taken = spark.createDataFrame([(1, 10 * i) for i in range(8)], "agent long, target long")
    rows = sa.random_fill(wanted, indexed, 40, taken, lambda a, n: rng.u("f", a, n)).collect()
    by = {a: [r["target"] for r in rows if r["agent"] == a] for a in (1, 2, 3, 4)}
    assert len(by[1]) == len({*by[1]}) == 30 and not {*by[1]} & {10 * i for i in range(8)}
    assert len({*by[2]}) == 5 and by[3] == [] and len({*by[4]}) == len(by[4]) == 40


def test_dense_ids(spark):
    nodes = spark.createDataFrame([(5,), (1,), (900_000,), (33,)], "node_id long")
    assert {r[0]: r[1] for r in gr.dense_ids(nodes, 16).collect()} == {1: 0, 5: 1, 33: 2, 900_000: 3}


def test_lists_round_trip(spark):
    row = spark.createDataFrame([([3, 1, 2],), ([],)], "x array<int>").select(scores.parse_int_list(scores.int_list(F.col("x")))).collect()
    assert [r[0] for r in row] == [[3, 1, 2], []]
    assert scores.elapsed(90_061) == "1-1:1:1"


def test_leiden_finds_two_cliques():
    pairs = [(a, b, 1.0) for base in (0, 5) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 5, 1.0)]
    for objective, gamma, total in (("cpm", 0.3, 0.0), ("modularity", 1.0, float(len(pairs)))):
        found = co.leiden(10, pairs, objective, gamma, total)
        assert len({*found[:5]}) == 1 and len({*found[5:]}) == 1 and found[0] != found[9]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)], "source long, target long")
    got = {r["node_id"]: r["component"] for r in co.connected_components(gr.node_set(edges), edges).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in (100, 101, 102)} == {100}


def test_own_folder_where_the_session_names_none(spark):
    from types import SimpleNamespace

    from citeloom.plans import state

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=spark.sparkContext)
    found = state.shared_dir(bare)
    assert found and state.shared_dir(bare) == found


@pytest.mark.parametrize("weights", ["one", "whole", "broken"])
def test_large_graphs_move_as_arrays(monkeypatch, weights):
    """No node of a large graph is walked alone; the communities are connected and as good as those of walking."""
    draw = random.Random(7)
    n = 6000
    pairs = {(min(a, b), max(a, b)) for a in range(n) for b in [draw.randrange(a // 12 * 12, a // 12 * 12 + 12) for _ in range(5)] + [draw.randrange(n) for _ in range(3)] if a != b}
    a, b = np.array(sorted(pairs)).T
    w = {"one": np.ones(len(a)), "whole": 1.0 + a % 3, "broken": 0.75 + (a % 3) / 4}[weights]
    quality = lambda f: w[f[a] == f[b]].sum() - 0.05 * (np.bincount(f) * (np.bincount(f) - 1.0) / 2).sum()
    with monkeypatch.context() as m:
        m.setattr(leiden, "FEW", 10**9, raising=False)
        walked = quality(leiden.partition(np.ones(n), a, b, w, 0.05))
    for size in (0, n // 2):
        with monkeypatch.context() as m:
            m.setattr(leiden, "FEW", size, raising=False)
            if not size:
                m.setattr(leiden.Level, "near", lambda *_: pytest.fail("a node is walked alone"))
            found = leiden.partition(np.ones(n), a, b, w, 0.05)
            assert np.array_equal(found, leiden.partition(np.ones(n), a, b, w, 0.05))
        assert quality(found) > 0.98 * walked
        level = leiden.Level(np.ones(n), a, b, w)
        assert len(np.unique(leiden.connected(level, found))) == len(np.unique(found))
