"""The co-recipiency graph: edges, PageRank, communities, neighbours.

A graph is an account's. Accounts whose graph has up to ``held_edges`` edges and nodes are computed a task each; a larger one by rounds of joins
over written tables. Both ways follow the same rules, so they give the same communities and, up to rounding, the same ranks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import drop, numbered, written

DAMPING, ROUNDS, TOLERANCE = 0.85, 100, 1e-6
#: Edges and nodes of a graph that one task holds.
HELD_EDGES = 500_000
#: Participants of a thread on either side of a task that pairs them.
PAIRED = 1_000
#: Rounds of moves within a level of communities.
MOVES = 24


def participants(threads: DataFrame, contacts: DataFrame) -> DataFrame:
    """account, thread_id, address: known contacts in threads without list mail."""
    t = threads.where("not any_list").select("account", "thread_id", F.explode(F.array_distinct("participants")).alias("address"))
    return t.join(contacts.select("account", "address").distinct(), ["account", "address"], "left_semi")


def edges(people: DataFrame, paired: int = PAIRED) -> DataFrame:
    """account, a, b (a < b), weight: the number of threads that both are in. Pairs of a large thread are dealt over tasks by chunks of its people."""
    p = people.select("account", "thread_id", "address").distinct()
    size = p.groupBy("account", "thread_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("account", "thread_id", F.ceil(F.col("n") / paired).cast("int").alias("parts"))
    p = p.join(size, ["account", "thread_id"]).withColumn("mine", F.pmod(F.xxhash64("address"), "parts").cast("int")).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x = p.select("account", "thread_id", F.col("mine").alias("i"), F.col("theirs").alias("j"), F.col("address").alias("a"))
    y = p.select("account", "thread_id", F.col("theirs").alias("i"), F.col("mine").alias("j"), F.col("address").alias("b"))
    return x.join(y, ["account", "thread_id", "i", "j"]).where("a < b").groupBy("account", "a", "b").agg(F.count(F.lit(1)).alias("weight"))


def _by_size(nodes: DataFrame, e: DataFrame, held_edges: int, small: Callable, large: Callable) -> DataFrame:
    """``small`` of the accounts with up to ``held_edges`` edges and nodes, ``large`` of the others; both take written nodes and edges."""
    nodes, e = written(nodes.select("account", "address").distinct(), "nodes"), written(e.select("account", "a", "b", F.col("weight").cast("long").alias("weight")), "edges")
    size = nodes.select("account").unionAll(e.select("account")).groupBy("account").agg(F.count(F.lit(1)).alias("n"))
    big = written(size.where(F.col("n") > held_edges).select("account"), "large")
    if big.isEmpty():
        return small(nodes, e)
    part = lambda how: (nodes.join(big, "account", how), e.join(big, "account", how))
    return small(*part("left_anti")).unionByName(large(*part("left_semi")))


def _an_account_a_task(nodes: DataFrame, e: DataFrame, values: Callable, schema: str) -> DataFrame:
    """values: names in order, edges as places and weights, hashes of names -> a column of values."""
    none = F.lit(None).cast("string")
    rows = e.select("account", "a", "b", "weight", F.lit(0).cast("long").alias("h")).unionByName(nodes.select("account", F.col("address").alias("a"), none.alias("b"), F.lit(0).cast("long").alias("weight"), _bits().alias("h")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        linked = pdf["b"].notna()
        own = pdf[~linked].sort_values("a")
        names, x = own["a"].to_numpy(), pdf[linked]
        place = pd.Index(names)
        got = values(len(names), place.get_indexer(x["a"]), place.get_indexer(x["b"]), x["weight"].to_numpy(np.int64), own["h"].to_numpy(np.int64))
        return pd.DataFrame({"account": pdf["account"].iloc[0], "address": names, "v": got})

    return rows.groupBy("account").applyInPandas(one, schema)


def _bits() -> Column:
    return F.xxhash64("account", "address")


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select("account", F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(e.select("account", F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


# -- PageRank


def ranks(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE, damping: float = DAMPING) -> np.ndarray:
    src, dst, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([weight, weight]).astype(float)
    out = np.bincount(src, w, n)
    share, r = w / out[src], np.full(n, 1 / max(1, n))
    for _ in range(rounds):
        new = (1 - damping) / n + damping * (np.bincount(dst, r[src] * share, n) + r[out == 0].sum() / n)
        change, r = np.abs(new - r).sum(), new
        if change < n * tolerance:
            break
    return r


def pagerank(nodes: DataFrame, e: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE, damping: float = DAMPING, held_edges: int = HELD_EDGES) -> DataFrame:
    """account, address, centrality: weighted rounds until the ranks of an account's n nodes change by less than n * tolerance in all, at most
    ``rounds``. Ranks of nodes without edges are spread over all."""
    small = lambda n, e: _an_account_a_task(n, e, lambda n, a, b, w, _: ranks(n, a, b, w, rounds, tolerance, damping), "account string, address string, v double")
    return _by_size(nodes, e, held_edges, small, lambda n, e: _rank_rounds(n, e, rounds, tolerance, damping)).withColumnRenamed("v", "centrality")


def _rank_rounds(nodes: DataFrame, e: DataFrame, rounds: int, tolerance: float, damping: float) -> DataFrame:
    """A round is one join on the source, one aggregation on the target and sums by account; accounts that have converged stay as they are."""
    arcs = _both_ways(e)
    out = arcs.groupBy("account", "src").agg(F.sum("weight").alias("out"))
    arcs = written(arcs.join(out, ["account", "src"]).select("account", "src", "dst", (F.col("weight") / F.col("out")).alias("share")), "arcs")
    size = nodes.groupBy("account").agg(F.count(F.lit(1)).alias("n"))
    linked = arcs.select("account", F.col("src").alias("address"), F.lit(True).alias("linked")).distinct()
    rank = nodes.join(size, "account").join(linked, ["account", "address"], "left").select("account", "address", "n", "linked", (1.0 / F.col("n")).alias("v"), F.lit(True).alias("moving"))
    rank = written(rank, "ranks")
    for _ in range(rounds):
        moving = rank.where("moving")
        got = arcs.join(moving.select("account", F.col("address").alias("src"), "v"), ["account", "src"]).groupBy("account", F.col("dst").alias("address")).agg(F.sum(F.col("v") * F.col("share")).alias("got"))
        loose = moving.groupBy("account").agg(F.sum(F.when(F.col("linked").isNull(), F.col("v")).otherwise(0.0)).alias("loose"))
        new = (1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / F.col("n"))
        step = written(moving.join(got, ["account", "address"], "left").join(loose, "account").select("account", "address", "n", "linked", "v", new.alias("new")), "step")
        change = step.groupBy("account").agg((F.sum(F.abs(F.col("new") - F.col("v"))) >= F.max("n") * tolerance).alias("moving"))
        after = written(step.join(change, "account").select("account", "address", "n", "linked", F.col("new").alias("v"), "moving").unionByName(rank.where("not moving")), "ranks")
        drop(rank)
        drop(step)
        rank = after
        if rank.where("moving").isEmpty():
            break
    return rank.select("account", "address", "v")


# -- communities
#
# Local moves in rounds. In each, the nodes whose hash has the round's bit set look at the communities beside them and move to that of the largest gain
# M2 * k(c) - degree * total(c) (k: weight of the node's edges into c; total: degrees in c but for the node's own), its own winning ties, then the smallest. A node
# alone moves to another one alone only if that is smaller, so no two change places. A level ends when no node wants to move, or after ``MOVES`` rounds; it counts if modularity
# grew. Communities, named after their smallest node, are the nodes of the next level. All numbers are integers, so results don't depend on the order of sums.


def louvain(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The smallest node of each node's community."""
    ids, member = np.arange(n), np.arange(n)
    a, b, weight, loops = a.astype(np.int64), b.astype(np.int64), weight.astype(np.int64), np.zeros(n, np.int64)
    while len(a):
        src, dst, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([weight, weight])
        degree = 2 * loops + np.bincount(src, w, n).astype(np.int64)
        m2 = int(degree.sum())
        c = np.arange(n)
        before = m2 * 2 * int(loops.sum()) - sum(int(d) ** 2 for d in degree[ids])
        for turn in range(MOVES):
            total, size = np.bincount(c[ids], degree[ids], n).astype(np.int64), np.bincount(c[ids], minlength=n)
            node, to, k = np.concatenate([src, ids]), np.concatenate([c[dst], c[ids]]), np.concatenate([w, np.zeros(len(ids), np.int64)])
            order = np.lexsort((to, node))
            node, to, k = node[order], to[order], k[order]
            first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (to[1:] != to[:-1])])
            node, to, k = node[first], to[first], np.add.reduceat(k, first)
            own = to == c[node]
            gain = m2 * k - degree[node] * (total[to] - np.where(own, degree[node], 0))
            barred = ~own & (size[c[node]] == 1) & (size[to] == 1) & (to > c[node])
            order = np.lexsort((to, ~own, -gain, barred, node))
            best = order[np.r_[True, node[order][1:] != node[order][:-1]]]
            wants = ~own[best]
            if not wants.any():
                break
            go = best[wants & ((h[node[best]] >> turn & 1) == 1)]
            c[node[go]] = to[go]
        inside = 2 * int(loops.sum()) + int(w[c[src] == c[dst]].sum())
        total = np.bincount(c[ids], degree[ids], n).astype(np.int64)
        if m2 * inside - sum(int(t) ** 2 for t in total) <= before:
            break
        smallest = np.full(n, n)
        np.minimum.at(smallest, c[ids], ids)
        name = smallest[c]
        member = name[member]
        x, y = np.minimum(name[a], name[b]), np.maximum(name[a], name[b])
        folded = np.zeros(n, np.int64)
        np.add.at(folded, name[ids], loops[ids])
        np.add.at(folded, x[x == y], weight[x == y])
        loops, keep = folded, x != y
        pair, inverse = np.unique(np.stack([x[keep], y[keep]]), axis=1, return_inverse=True)
        a, b, weight = pair[0], pair[1], np.bincount(inverse.ravel(), weight[keep], pair.shape[1]).astype(np.int64)
        ids = np.unique(name[ids])
    return member


def _move_rounds(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """account, address, v (the smallest address of the community), by the rules of ``louvain`` as joins and aggregations."""
    member = written(nodes.select("account", "address", F.col("address").alias("name")), "members")
    level = written(nodes.select("account", F.col("address").alias("i"), _bits().alias("h"), F.lit(0).cast("long").alias("loops")), "level")
    arcs = written(_both_ways(e).select("account", F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("w")), "arcs")
    while not arcs.isEmpty():
        degree = level.join(arcs.groupBy("account", "i").agg(F.sum("w").alias("w")), ["account", "i"], "left").select("account", "i", "h", "loops", (2 * F.col("loops") + F.coalesce("w", F.lit(0))).alias("degree"))
        sums = degree.groupBy("account").agg(F.sum("degree").alias("m2"), F.sum("loops").alias("all_loops"), F.sum(F.col("degree").cast("decimal(38,0)") * F.col("degree")).alias("squares"))
        state = written(degree.join(sums, "account").withColumn("c", F.col("i")), "state")
        for turn in range(MOVES):
            of = state.groupBy("account", "c").agg(F.sum("degree").alias("total"), F.count(F.lit(1)).alias("size"))
            place = state.select("account", F.col("i").alias("j"), F.col("c").alias("to"))
            near = arcs.join(place, ["account", "j"]).groupBy("account", "i", "to").agg(F.sum("w").alias("k")).unionByName(state.select("account", "i", F.col("c").alias("to"), F.lit(0).cast("long").alias("k")))
            near = near.groupBy("account", "i", "to").agg(F.sum("k").alias("k")).join(of.withColumnRenamed("c", "to"), ["account", "to"]).join(state.join(of.select("account", "c", F.col("size").alias("own_size")), ["account", "c"]), ["account", "i"])
            own = F.col("to") == F.col("c")
            wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products of two weights pass 64 bits in an account of 10**10
            gain = wide(F.col("m2")) * wide(F.col("k")) - wide(F.col("degree")) * wide(F.col("total") - F.when(own, F.col("degree")).otherwise(0))
            barred = ~own & (F.col("own_size") == 1) & (F.col("size") == 1) & (F.col("to") > F.col("c"))
            best = near.groupBy("account", "i").agg(F.min_by("to", F.struct(barred, -gain, ~own, "to")).alias("best"))
            moved = written(state.join(best, ["account", "i"]), "moved")
            if moved.where("best <> c").isEmpty():
                drop(moved)
                break
            on = F.shiftright("h", turn).bitwiseAND(F.lit(1)) == 1
            after = written(moved.withColumn("c", F.when(on, F.col("best")).otherwise(F.col("c"))).drop("best"), "state")
            drop(moved)
            drop(state)
            state = after
        place = state.select("account", "i", "c")
        inside = arcs.join(place, ["account", "i"]).join(place.select("account", F.col("i").alias("j"), F.col("c").alias("d")), ["account", "j"]).groupBy("account").agg(F.sum(F.when(F.col("c") == F.col("d"), F.col("w")).otherwise(0)).alias("inside"))
        squares = state.groupBy("account", "c").agg(F.sum("degree").alias("t")).groupBy("account").agg(F.sum(F.col("t").cast("decimal(38,0)") * F.col("t")).alias("after"))
        grown = sums.join(inside, "account").join(squares, "account").where(F.col("m2").cast("decimal(38,0)") * F.col("inside") - F.col("after") > -F.col("squares")).select("account")
        grown = written(grown, "grown")
        if grown.isEmpty():
            break
        smallest = state.groupBy("account", "c").agg(F.min("i").alias("name"))
        name = written(state.join(grown, "account", "left_semi").join(smallest, ["account", "c"]).select("account", "i", "name", "h", "loops"), "names")
        to = name.select("account", F.col("i").alias("name"), F.col("name").alias("to"))
        member = written(member.join(to, ["account", "name"], "left").select("account", "address", F.coalesce("to", "name").alias("name")), "members")
        folded = arcs.join(name.select("account", "i", F.col("name").alias("x")), ["account", "i"]).join(name.select("account", F.col("i").alias("j"), F.col("name").alias("y")), ["account", "j"]).groupBy("account", F.col("x").alias("i"), F.col("y").alias("j")).agg(F.sum("w").alias("w"))
        folded = written(folded, "arcs")
        own = folded.where("i = j").select("account", "i", (F.col("w") / 2).cast("long").alias("inner"))
        level = name.groupBy("account", F.col("name").alias("i")).agg(F.sum("loops").alias("l"), F.max(F.when(F.col("i") == F.col("name"), F.col("h"))).alias("h")).join(own, ["account", "i"], "left")
        level = written(level.select("account", "i", "h", (F.col("l") + F.coalesce("inner", F.lit(0))).alias("loops")), "level")
        arcs = folded.where("i <> j")
    return member.select("account", "address", F.col("name").alias("v"))


def communities(nodes: DataFrame, e: DataFrame, held_edges: int = HELD_EDGES) -> DataFrame:
    """account, address, community_id: a partition of high modularity. Ids are numbered by the communities' smallest addresses. Equal input gives equal output."""
    named = lambda n, a, b, w, h: louvain(n, a, b, w, h)

    def small(n: DataFrame, e: DataFrame) -> DataFrame:
        found = _an_account_a_task(n, e, named, "account string, address string, v long")
        rank = found.groupBy("account").agg(F.sort_array(F.collect_set("v")).alias("all"))  # no more than the task held
        return found.join(rank, "account").select("account", "address", (F.array_position("all", F.col("v")) - 1).alias("v"))

    def large(n: DataFrame, e: DataFrame) -> DataFrame:
        found = written(_move_rounds(n, e), "communities")
        number = numbered(found.select("account", "v").distinct(), "account", "v", by="account")
        return found.join(number, ["account", "v"]).select("account", "address", F.col("n").alias("v"))

    return _by_size(nodes, e, held_edges, small, large).withColumnRenamed("v", "community_id")


def modularity(e: DataFrame, members: DataFrame) -> DataFrame:
    """account, modularity of a partition."""
    m = members.select("account", "address", "community_id")
    x = e.join(m.select("account", F.col("address").alias("a"), F.col("community_id").alias("ca")), ["account", "a"]).join(m.select("account", F.col("address").alias("b"), F.col("community_id").alias("cb")), ["account", "b"])
    inside = x.groupBy("account").agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inside"))
    degree = x.select("account", F.explode(F.array("ca", "cb")).alias("c"), "weight").groupBy("account", "c").agg(F.sum("weight").alias("d"))
    squares = degree.groupBy("account").agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("squares"))
    return inside.join(squares, "account").select("account", (F.col("inside") / F.col("m") - F.col("squares") / (4.0 * F.col("m") * F.col("m"))).alias("modularity"))


def neighbours(e: DataFrame, contacts: DataFrame, address: str, limit: int = 15) -> DataFrame:
    a = address.lower()
    near = e.where((F.col("a") == a) | (F.col("b") == a)).select("account", F.when(F.col("a") == a, F.col("b")).otherwise(F.col("a")).alias("address"), F.col("weight").alias("shared_threads"))
    out = near.join(contacts, ["account", "address"])
    return out.orderBy(F.col("shared_threads").desc(), F.col("engagement_score").desc_nulls_last(), "address").limit(limit)


def community_overview(contacts: DataFrame, members: int = 10) -> DataFrame:
    """account, community_id, size and the most central members."""
    c = contacts.where("community_id is not null")
    w = Window.partitionBy("account", "community_id").orderBy(F.col("centrality").desc_nulls_last(), "address")
    top = c.withColumn("n", F.row_number().over(w)).where(F.col("n") <= members).groupBy("account", "community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "address"))), lambda x: x["address"]).alias("members"))
    return c.groupBy("account", "community_id").agg(F.count(F.lit(1)).alias("size")).join(top, ["account", "community_id"]).orderBy(F.col("size").desc(), "community_id", "account")


def with_metrics(contacts: DataFrame, ranks: DataFrame, groups: DataFrame) -> DataFrame:
    return contacts.join(ranks, ["account", "address"], "left").join(groups, ["account", "address"], "left")
