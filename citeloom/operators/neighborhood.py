"""Neighbourhoods of generator nodes, recency bins and cluster candidates.

picks(agent, generator); adjacency(node_id, neighbor) holds both directions; packed(adjacency) numbers every node's neighbours
and holds them in pieces, so that a sample of them is drawn as numbers first and only pieces with drawn numbers are read.
placed() is the same with a row for each neighbour; operators take either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import PRIME, line_number, line_seeds
from ..functions.scores import bin_index
from ..plans.state import discard, keep, keep_parts

#: Neighbour ids that are numbered in one place; a hub's list is cut into such ranges.
RANGE = 1 << 20
#: Places of a list in one piece.
PIECE = 1024
#: Parts in which a whole network's lists are packed one after the other.
PARTS = 4
#: Blocks of cluster members in all, and the least and the most members of one.
BLOCKS, MEMBERS, MOST = 512, 4096, 1 << 20
#: Agents of a cluster that meet a block in one task, and members that each meets at a time.
TEAM, TURN = 1 << 14, 128


def adjacency(edges: DataFrame) -> DataFrame:
    """Undirected neighbours in both directions; no node is its own neighbour. packed() drops repeats."""
    there = F.struct(F.col("source").alias("node_id"), F.col("target").alias("neighbor"))
    back = F.struct(F.col("target").alias("node_id"), F.col("source").alias("neighbor"))
    return edges.where("source <> target").select(F.explode(F.array(there, back)).alias("e")).select("e.node_id", "e.neighbor")


def packed(adj: DataFrame) -> DataFrame:
    """node_id, piece, first, ids, degree of the node: neighbours stand in id order at the places 0, 1, ...; ids are those at first,
    first + 1, ... and lie in places of one piece.

    A list is sorted range by range, so that no task sorts a hub's whole list. A piece at the end of a range may come in two rows.
    """
    if "ids" in adj.columns:
        return adj
    if "place" in adj.columns:
        whole = adj.groupBy("node_id", F.floor(F.col("place") / PIECE).alias("piece"), "degree").agg(F.min("place").alias("first"), F.array_sort(F.collect_list("neighbor")).alias("ids"))
        return whole.select("node_id", "piece", "first", "ids", "degree")
    cut = adj.withColumn("_range", F.floor(F.col("neighbor") / RANGE)).repartition("node_id", "_range")
    sets = cut.groupBy("node_id", "_range").agg(F.array_sort(F.collect_set("neighbor")).alias("all"))
    ahead = Window.partitionBy("node_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = sets.select("node_id", "_range", F.size("all").cast("long").alias("n"))
    starts = counts.select("node_id", "_range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("node_id")).alias("degree"))
    rows = sets.join(starts, ["node_id", "_range"])
    end = F.col("start") + F.size("all")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.floor(F.col("start") / PIECE), F.floor((end - 1) / PIECE)))).withColumn("first", F.greatest("start", F.col("piece") * PIECE))
    ids = F.slice("all", (F.col("first") - F.col("start") + 1).cast("int"), F.least(F.lit(PIECE), end - F.col("first"), (F.col("piece") + 1) * PIECE - F.col("first")).cast("int"))
    return pieces.select("node_id", "piece", "first", ids.alias("ids"), "degree")


def kept_adjacency(edges: DataFrame, name: str) -> DataFrame:
    """packed() of both directions, written. Nodes are packed part by part: the shuffle of all at once is the largest there is."""
    rows = adjacency(edges)
    return keep_parts(lambda k: packed(rows.where(F.pmod(F.xxhash64("node_id"), F.lit(PARTS)) == k)), PARTS, name)


def placed(adj: DataFrame) -> DataFrame:
    """node_id, place (0, 1, ... by neighbour id), neighbor, degree of the node."""
    rows = packed(adj).select("node_id", "first", "degree", F.posexplode("ids").alias("n", "neighbor"))
    return rows.select("node_id", (F.col("first") + F.col("n")).alias("place"), "neighbor", "degree")


def degrees(adj: DataFrame) -> DataFrame:
    """node_id, degree of every node with a neighbour."""
    return adj.where("first = 0").select("node_id", "degree")


def _read(rows: DataFrame, key: str, places: Column, adj: DataFrame, *columns: str) -> DataFrame:
    """columns, ids, read: array of (rank, node) for the places (an array by rank) of the key's list, one row a piece read.

    A list of one piece is read in one row; of longer lists each place is a row, so that a hub's readers are dealt out.
    """
    part = lambda piece, pairs: F.struct(piece.cast("long").alias("piece"), pairs.alias("pairs"))
    pairs = F.transform(places, lambda p, i: F.struct(i.alias("rank"), p.alias("place")))
    parts = F.when(F.col("degree") <= PIECE, F.array(part(F.lit(0), pairs))).otherwise(F.transform(pairs, lambda x: part(F.floor(x["place"] / PIECE), F.array(x))))
    slots = rows.select(*columns, F.col(key).alias("node_id"), F.explode(parts).alias("part")).select(*columns, "node_id", "part.piece", "part.pairs")
    met = slots.join(adj.select("node_id", "piece", "first", "ids"), ["node_id", "piece"])
    here = F.filter("pairs", lambda x: (x["place"] >= F.col("first")) & (x["place"] < F.col("first") + F.size("ids")))
    got = F.transform(here, lambda x: F.struct(x["rank"].alias("rank"), F.get("ids", (x["place"] - F.col("first")).cast("int")).alias("node")))
    return met.select(*columns, "ids", got.alias("read"))


def drawn_places(degree: Column, want: Column, few: int, seeds: Column) -> Column:
    """The first want (at most degree) places 0 .. degree - 1 in a random order that the line seeds name.

    Up to few places are ordered by a number each. Of more, numbers 1, 2, ... of the line draw places with
    replacement and repeats are skipped; after 2 * degree draws what is left follows in order. A prefix never
    depends on want.
    """
    whole = F.sequence(F.lit(0).cast("long"), degree.cast("long") - 1)

    def ordered(s: Column) -> Column:
        return F.transform(F.array_sort(F.transform(whole, lambda p: F.struct(line_number(s, p).alias("u"), p.alias("p")))), lambda x: x["p"])

    def by_number(s: Column, last: Column) -> Column:
        return F.transform(F.sequence(F.lit(1).cast("long"), last.cast("long")), lambda n: F.floor(line_number(s, n) * degree / PRIME))

    def thrown(s: Column) -> Column:
        some = F.array_distinct(by_number(s, F.least(want * 3 / 2 + 64, degree * 2)))
        every = F.array_distinct(F.concat(by_number(s, degree * 2), whole))
        return F.when(want * 4 > degree, every).otherwise(F.transform(F.array(some), lambda x: F.when(F.size(x) >= want, x).otherwise(every))[0])

    # the seeds are computed once, not once a place
    return F.transform(F.array(seeds), lambda s: F.slice(F.when(degree <= few, ordered(s)).otherwise(thrown(s)), F.lit(1), want.cast("int")))[0]


def _listed(picks: DataFrame, adj: DataFrame, key: str) -> DataFrame:
    """The rows of picks with each neighbour of their key as candidate."""
    return picks.join(packed(adj).select(F.col("node_id").alias(key), "ids"), key).select(*picks.columns, F.explode("ids").alias("candidate"))


def one_hop(picks: DataFrame, adj: DataFrame) -> DataFrame:
    """agent, candidate: all neighbours of the generator."""
    return _listed(picks.select("agent", "generator"), adj, "generator").select("agent", "candidate")


def two_hop(picks: DataFrame, adj: DataFrame) -> DataFrame:
    """agent, candidate: neighbours of neighbours outside the first hop, exact."""
    near = one_hop(picks, adj)
    reach = _listed(near.withColumnRenamed("candidate", "parent"), adj, "parent").select("agent", "candidate").distinct()
    seen = near.unionByName(picks.select("agent", F.col("generator").alias("candidate")))
    return reach.join(seen, ["agent", "candidate"], "left_anti")


def opened(picks: DataFrame, adj: DataFrame, cap: int, draw) -> DataFrame:
    """agent, generator, degree, read: at most cap (rank, neighbour) of the generator, drawn as places before any list is
    read; ids: the whole list where it has one piece. adj is packed()."""
    rows = picks.select("agent", "generator").join(degrees(adj).withColumnRenamed("node_id", "generator"), "generator")
    want = F.least(F.col("degree"), F.lit(cap))
    drawn = F.when(F.col("degree") <= cap, F.sequence(F.lit(0).cast("long"), F.col("degree") - 1)).otherwise(drawn_places(F.col("degree"), want, 4 * cap, line_seeds(draw, "cap1", "agent")))
    read = _read(rows, "generator", drawn, adj, "agent", "generator", "degree")
    return read.select("agent", "generator", "degree", "read", F.when(F.col("degree") <= PIECE, F.col("ids")).alias("ids"))


def first_hop(rows: DataFrame) -> DataFrame:
    """agent, generator, candidate, place (rank in the sample) of opened()."""
    return rows.select("agent", "generator", F.explode("read").alias("r")).select("agent", "generator", F.col("r.node").alias("candidate"), (F.col("r.rank") + 1).cast("int").alias("place"))


def one_hop_capped(picks: DataFrame, adj: DataFrame, cap: int, draw) -> DataFrame:
    """agent, generator, candidate, place (rank in the sample): at most cap neighbours."""
    return first_hop(opened(picks, packed(adj), cap, draw))


def two_hop_capped(first: DataFrame, adj: DataFrame, cap: int, draw) -> DataFrame:
    """agent, candidate, place: at most cap unseen neighbours of the candidates of first, which is opened().

    Parents stand in random order, a parent's neighbours in random order; an agent takes the first cap nodes of
    this line that are neither its generator nor any neighbour of it (also one that the first cap left out).
    Lines are read from the front, so that nobody fans out to whole lists: a round reads a few times cap, and
    agents that still miss some while their line goes on read eight times as much in the next round.
    In the first round an agent's line and its generator's list (of one piece) meet as arrays; else rows meet rows.
    """
    line = Window.partitionBy("agent").orderBy("_o", "parent").rowsBetween(Window.unboundedPreceding, -1)
    drawn = first.select("agent", "generator", (F.col("degree") > PIECE).alias("wide"), F.explode("read.node").alias("parent"))
    parents = drawn.join(degrees(adj).withColumnRenamed("node_id", "parent"), "parent").withColumn("_o", draw("cap2p", "agent", "parent"))
    parents = parents.withColumn("before", F.coalesce(F.sum("degree").over(line), F.lit(0))).withColumn("reach", F.sum("degree").over(Window.partitionBy("agent"))).drop("_o")
    parents = keep(parents, "parents", compact=True)
    near = first.where("ids is not null").groupBy("agent", "generator").agg(F.flatten(F.collect_list("ids")).alias("near"))
    near = near.select("agent", F.concat("near", F.array("generator")).alias("near"))
    wide = not first.where(F.col("degree") > PIECE).isEmpty()

    def read(rows: DataFrame) -> DataFrame:
        places = drawn_places(F.col("degree"), F.least(F.col("degree"), F.lit(budget) - F.col("before")), 4 * cap, line_seeds(draw, "cap2c", "agent", "parent"))
        found = _read(rows.where(F.col("before") < budget), "parent", places, adj, "agent", "generator", "before")
        return found.select("agent", "generator", F.transform("read", lambda x: F.struct((F.col("before") + x["rank"]).alias("slot"), x["node"].alias("candidate"))).alias("read"))

    budget, found = 2 * cap + 32, None
    while True:
        if found is not None:
            taken = _by_rows(read(parents), adj, cap)
        elif wide:
            taken = _by_arrays(read(parents.where("not wide")), near, cap).unionByName(_by_rows(read(parents.where("wide")), adj, cap))
        else:
            taken = _by_arrays(read(parents), near, cap)
        taken = keep(taken, "second", compact=True)
        full = taken.where(F.col("place") == cap).select("agent")
        left = keep(parents.where(F.col("reach") > budget).join(full, "agent", "left_anti"), "going_on")
        if found is None:  # those of later rounds are few, and found reads them
            discard(parents)
        if not left.limit(1).count():
            return taken if found is None else found.unionByName(taken)
        done = taken.join(left.select("agent").distinct(), "agent", "left_anti")
        found = done if found is None else found.unionByName(done)
        parents, budget = left, budget * 8


def _by_arrays(read: DataFrame, near: DataFrame, cap: int) -> DataFrame:
    """agent, candidate, place: the first cap nodes of each agent's line that near(agent, near) lacks."""
    lines = read.select("agent", "read").repartition("agent").groupBy("agent").agg(F.flatten(F.collect_list("read")).alias("line"))
    ordered = F.transform(F.array_sort("line"), lambda x: x["candidate"])
    fresh = lines.join(near, "agent").select("agent", F.slice(F.array_except(ordered, F.col("near")), 1, cap).alias("fresh"))
    return fresh.select("agent", F.posexplode("fresh").alias("n", "candidate")).select("agent", "candidate", (F.col("n") + 1).cast("int").alias("place"))


def _by_rows(read: DataFrame, adj: DataFrame, cap: int) -> DataFrame:
    """The same for lines or generators' lists of any length."""
    read = keep(read.select("agent", "generator", F.explode("read").alias("r")).select("agent", "generator", "r.slot", "r.candidate").where("candidate <> generator"), "rows")
    asked = keep(read.select("generator").distinct(), "asked")
    fresh = read.join(_listed(asked, adj, "generator"), ["generator", "candidate"], "left_anti")
    order = Window.partitionBy("agent").orderBy("slot")
    own = fresh.groupBy("agent", "candidate").agg(F.min("slot").alias("slot"))
    return own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).select("agent", "candidate", F.col("place").cast("int").alias("place"))


def placed_hops(picks: DataFrame, adj: DataFrame, cap: int, draw) -> DataFrame:
    """agent, hop, candidate, place: both hops under their caps, in the order in which they were drawn."""
    adj = packed(adj)
    first = keep(opened(picks, adj, cap, draw), "first", compact=True)
    second = two_hop_capped(first, adj, cap, draw)
    return first_hop(first).select("agent", F.lit(1).alias("hop"), "candidate", "place").unionByName(second.select("agent", F.lit(2).alias("hop"), "candidate", "place"))


def hops(picks: DataFrame, adj: DataFrame, cap: int | None, draw) -> DataFrame:
    """agent, hop, candidate for hops 1 and 2. cap None: exact. draw(purpose, *columns) gives uniforms."""
    if cap is not None:
        return placed_hops(picks, adj, cap, draw).drop("place")
    first, second = one_hop(picks, adj), two_hop(picks, adj)
    return first.select("agent", F.lit(1).alias("hop"), "candidate").unionByName(second.select("agent", F.lit(2).alias("hop"), "candidate"))


def pooled(hopped: DataFrame, cap: int | None) -> DataFrame:
    """One list under key 1. The cap is shared: the first hop comes first, then the second in the order of its
    parents. hopped comes from placed_hops, or from hops where there is no cap."""
    if cap is None:
        return hopped.select("agent", F.lit(1).alias("hop"), "candidate")
    order = Window.partitionBy("agent").orderBy("hop", "place")
    return hopped.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).select("agent", F.lit(1).alias("hop"), "candidate")


def binned(hopped: DataFrame, nodes: DataFrame, now: int, bounds: list[int]) -> DataFrame:
    """Adds the recency bin of each candidate."""
    years = nodes.select(F.col("node_id").alias("candidate"), "year")
    return hopped.join(years, "candidate").withColumn("bin", bin_index(F.lit(now) - F.col("year"), bounds)).drop("year")


def bin_counts(in_bins: DataFrame) -> DataFrame:
    return in_bins.groupBy("agent", "hop", "bin").agg(F.count("*").alias("n"))


def cluster_sizes(nodes: DataFrame, before: int | None = None) -> DataFrame:
    rows = nodes.where("cluster_id >= 0")
    return (rows if before is None else rows.where(F.col("year") < before)).groupBy("cluster_id").agg(F.count("*").alias("n"))


def member_blocks(nodes: DataFrame, now: int) -> DataFrame:
    """cluster_id, block, blocks of the cluster, members: ids of its older nodes dealt into blocks by a hash. There are about BLOCKS in all
    clusters together, or fewer of MEMBERS; none is much larger than MOST."""
    rows = nodes.where((F.col("year") < now) & (F.col("cluster_id") >= 0)).select("cluster_id", "node_id")
    counts = keep(rows.groupBy("cluster_id").agg(F.count("*").alias("n")), "members")
    total = counts.agg(F.sum("n")).first()[0] or 0
    size = min(max(MEMBERS, -(-total // BLOCKS)), MOST)
    blocks = counts.select("cluster_id", F.ceil(F.col("n") / size).cast("int").alias("blocks"))
    dealt = rows.join(F.broadcast(blocks), "cluster_id") if blocks.count() <= MOST else rows.join(blocks, "cluster_id")
    return dealt.groupBy("cluster_id", F.pmod(F.xxhash64("node_id"), "blocks").cast("int").alias("block"), "blocks").agg(F.collect_list("node_id").alias("members"))


def cluster_candidates(agents: DataFrame, nodes: DataFrame, now: int) -> DataFrame:
    """agents(agent, generator, cluster_id) -> agent, candidate: older members other than generators.

    The result has a row for every agent and member of a cluster. Teams of agents and blocks of members meet in place: what is
    shuffled are agents, once a block, and members, once a team; no pair is, and no task holds more than a team and a block. The team goes
    through the block a few members at a time, so that both columns repeat within a page and Parquet packs them tightly.
    """
    agents = keep(agents.where("cluster_id >= 0").select("cluster_id", "agent", "generator"), "agents")
    members = keep(member_blocks(nodes, now), "blocks")
    teams = agents.groupBy("cluster_id").agg(F.ceil(F.count("*") / TEAM).cast("int").alias("teams"))
    cells = keep(members.groupBy("cluster_id").agg(F.max("blocks").alias("blocks")).join(teams, "cluster_id"), "cells")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda t, *columns: t.join(F.broadcast(cells) if few else cells, "cluster_id").select("cluster_id", *columns)
    few = cells.count() <= MOST
    tasks = int(agents.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as few bytes here stand for many pairs
    met = deal(agents, F.pmod(F.xxhash64("agent"), "teams").cast("int").alias("team"), each("blocks").alias("block"), "agent", "generator")
    turns = F.transform(F.sequence(F.lit(1), F.size("members"), F.lit(TURN)), lambda i: F.slice("members", i, F.lit(TURN)))
    dealt = deal(members.drop("blocks"), each("teams").alias("team"), "block", "members").repartition(tasks, "cluster_id", "team", "block")
    turned = dealt.select("cluster_id", "team", "block", F.explode(turns).alias("turn"))
    pairs = turned.join(met.hint("shuffle_hash"), ["cluster_id", "team", "block"])
    return pairs.select("agent", "generator", F.explode("turn").alias("candidate")).where("candidate <> generator").select("agent", "candidate")


def active_clusters(agents: DataFrame, nodes: DataFrame, now: int, theta: int) -> DataFrame:
    """Agents (agent, generator, cluster_id, alpha) whose cluster replaces the first hop."""
    large = cluster_sizes(nodes, now).where(F.col("n") >= theta).select("cluster_id")
    return agents.where("alpha > 0 and cluster_id >= 0").join(large, "cluster_id", "left_semi")


def prune_cluster(far: DataFrame, active: DataFrame, nodes: DataFrame) -> DataFrame:
    """Second-hop rows without members of the agent's active cluster."""
    own = active.select("agent", F.col("cluster_id").alias("own"))
    theirs = nodes.select(F.col("node_id").alias("candidate"), F.col("cluster_id").alias("theirs"))
    return far.join(own, "agent", "left").join(theirs, "candidate", "left").where("own is null or theirs is null or own <> theirs").drop("own", "theirs")


def cluster_override(hopped: DataFrame, active: DataFrame, nodes: DataFrame, now: int) -> DataFrame:
    """Hop 1 of agents with an active cluster becomes its members; their hop 2 loses them."""
    others = hopped.where("hop = 1").join(active.select("agent"), "agent", "left_anti")
    first = cluster_candidates(active, nodes, now).select("agent", F.lit(1).alias("hop"), "candidate")
    second = prune_cluster(hopped.where("hop = 2"), active, nodes)
    return others.select("agent", "hop", "candidate").unionByName(first).unionByName(second.select("agent", "hop", "candidate"))


def drop_cited(hopped: DataFrame, cited: DataFrame) -> DataFrame:
    return hopped.join(cited.select("agent", F.col("target").alias("candidate")), ["agent", "candidate"], "left_anti")
