"""Graphs as edge tables (src, dst[, weight]).

Degrees, PageRank, components, searches and shortest paths are rounds of joins and grouped minima over tables; a round's table
is checkpointed, so that plans stay short and lost executors cost one round. Matching over links that are given one by one runs
per weakly connected component, as a pandas function: a task holds one component. What tasks of flow, betweenness and strong
components hold is said there.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.frame import with_row_number
from lumenframe.operators.lineage import cut as _cut


def _settled(df: DataFrame) -> DataFrame:
    """As _cut, without the plan's estimate of its size: that is the product of a join's sides, which rounds of joins make a number
    of so many digits that planning takes longer than the work."""
    found = _cut(df)
    session = df.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(found._jdf.queryExecution().toRdd(), found._jdf.schema(), False), session)


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, once."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, centrality): degrees, and their sum over the other nodes' number. One aggregate."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    d = ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return d.crossJoin(F.broadcast(d.agg((F.count(F.lit(1)) - 1).alias("_n")))).select("node", "out_degree", "in_degree", ((F.col("out_degree") + F.col("in_degree")) / F.nullif("_n", F.lit(0))).alias("centrality"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank), ranks summing to 1; a node without out-edges deals its rank to all."""
    edges = _cut(edges.select("src", "dst").distinct())
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_d"))
    links = _cut(edges.join(out, "src"))
    every = _cut(nodes(edges).join(out.withColumnRenamed("src", "node"), "node", "left"))
    n = every.count()
    rank = every.select("node", "_d", F.lit(1.0 / n).alias("rank"))
    for k in range(rounds):
        given = links.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("_d")).alias("g"))
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("_d").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        rank = every.join(given, "node", "left").crossJoin(F.broadcast(lost)).select("node", "_d", ((1 - damping) / n + damping * (F.coalesce("g", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if k % 5 == 4:
            rank = _cut(rank)
    return rank.select("node", "rank")


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component): the smallest node reachable, by minima over neighbours and jumps to the component's own component."""
    links = _cut(both_ways(edges.select("src", "dst")))
    state = _cut(nodes(edges).withColumn("component", F.col("node")))
    for _ in range(rounds):
        least = links.join(state.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("m"))
        step = state.join(least, "node", "left").select("node", "component", F.least("component", "m").alias("m"))
        jump = step.join(step.select(F.col("node").alias("m"), F.col("m").alias("j")), "m", "left").select("node", "component", F.least("m", "j").alias("new"))
        new = _cut(jump)
        if new.filter("new < component").isEmpty():
            return state
        state = new.select("node", F.col("new").alias("component"))
    raise RuntimeError("components did not settle")


def bfs(edges: DataFrame, start, directed: bool = False, rounds: int = 1000) -> DataFrame:
    """(node, level) of the nodes reached from start."""
    links = _cut(edges.select("src", "dst").distinct() if directed else both_ways(edges.select("src", "dst")))
    seen = _cut(edges.sparkSession.range(1).select(F.lit(start).cast(edges.schema["src"].dataType).alias("node"), F.lit(0).alias("level")))
    front = seen
    for k in range(1, rounds + 1):
        front = _cut(links.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("level", F.lit(k)))
        if front.isEmpty():
            break
        seen = _cut(seen.unionAll(front))
    return seen


def shortest_paths(edges: DataFrame, start, directed: bool = False, rounds: int = 1000) -> DataFrame:
    """(node, distance) from start over weights, by rounds of relaxation; negative cycles raise RuntimeError."""
    links = edges.select("src", "dst", "weight")
    links = _cut(links if directed else links.unionAll(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    most = nodes(edges).count()
    known = _cut(edges.sparkSession.range(1).select(F.lit(start).cast(edges.schema["src"].dataType).alias("node"), F.lit(0.0).alias("distance")))
    for _ in range(min(rounds, most) + 1):
        reached = links.join(known.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"))
        new = _cut(known.unionAll(reached).groupBy("node").agg(F.min("distance").alias("distance")))
        if new.exceptAll(known).isEmpty():
            return new
        known = new
    raise RuntimeError("a negative cycle")


def all_pairs_paths(edges: DataFrame, directed: bool = False, rounds: int = 64) -> DataFrame:
    """(src, dst, distance) of all pairs with a path, each node to itself included; negative cycles raise RuntimeError.

    Paths double in length each round: known distances are joined with themselves, the least of each pair stays. The result
    has up to nodes^2 rows by nature.
    """
    links = edges.select("src", "dst", F.col("weight").cast("double").alias("distance"))
    links = links if directed else links.unionAll(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance"))
    least = lambda df: _cut(df.groupBy("src", "dst").agg(F.min("distance").alias("distance")))
    known = least(links.unionAll(nodes(edges).select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("distance"))))
    for _ in range(rounds):
        if not known.filter("src = dst AND distance < 0").isEmpty():
            raise RuntimeError("a negative cycle")
        on = known.select(F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("distance").alias("further"))
        new = least(known.join(on, "dst").select("src", F.col("end").alias("dst"), (F.col("distance") + F.col("further")).alias("distance")))
        old = known.withColumnRenamed("distance", "before")
        if new.join(old, ["src", "dst"], "left").filter("before IS NULL OR distance < before - 1e-12 * abs(before)").isEmpty():
            return known
        known = new
    raise RuntimeError("paths did not settle")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community): in each round a node takes its neighbours' commonest label, the smallest of ties; all at once."""
    links = _cut(both_ways(edges.select("src", "dst")))
    state = nodes(edges).withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = links.join(state.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.count(F.lit(1)).alias("n"))
        state = _cut(votes.groupBy("node").agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("community")))
    return state


def spanning_tree(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(src, dst, weight) of a minimum spanning forest by Boruvka's rounds: each component takes its lightest way out."""
    links = _cut(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").filter("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    taken = None
    for _ in range(rounds):
        if taken is None:
            apart = links.withColumn("a", F.col("src")).withColumn("b", F.col("dst"))
        else:
            part = components(taken)
            left, right = (part.select(F.col("node").alias(c), F.col("component").alias(n)) for c, n in (("src", "a"), ("dst", "b")))
            apart = links.join(left, "src", "left").join(right, "dst", "left").withColumn("a", F.coalesce("a", "src")).withColumn("b", F.coalesce("b", "dst")).filter("a <> b")
        out = apart.select("a", F.struct("weight", "src", "dst").alias("e")).unionAll(apart.select(F.col("b").alias("a"), F.struct("weight", "src", "dst").alias("e")))
        best = _cut(out.groupBy("a").agg(F.min("e").alias("e")).select("e.src", "e.dst", "e.weight").distinct())
        if best.isEmpty():
            break
        taken = _cut(best if taken is None else taken.unionAll(best))
    return taken if taken is not None else links


def per_component(edges: DataFrame, f, schema: str) -> DataFrame:
    """f(pandas edges) -> pandas, for each weakly connected component."""
    part = components(edges).select(F.col("node").alias("src"), "component")
    return edges.join(part, "src").groupBy("component").applyInPandas(lambda pdf: f(pdf.drop(columns="component")), schema)


def _adjacent(pdf: pd.DataFrame, directed: bool = True) -> dict:
    out = defaultdict(list)
    for a, b in sorted(set(zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True))):
        out[a].append(b)
        out[b] += [] if directed else [a]
    return out


def strong_components(edges: DataFrame, rounds: int = 200, small: int = 500_000) -> DataFrame:
    """(node, component): the smallest node of the same strongly connected component.

    A round ranks nodes at random and finds each node's first ancestor and first descendant by that rank, itself included: minima
    over in- and out-neighbours and jumps to the ancestor's ancestor. Where both are one node, the node is of its component. The
    others' components lie within nodes of equal ancestor and descendant, so other edges go. The rounds expected grow with the
    logarithm of the nodes; tables are those of edges and nodes, at any size of a component. Once `small` edges or fewer are
    left, one task solves them.
    """
    links, done = _settled(edges.select("src", "dst").filter("src <> dst").distinct()), None
    left = _settled(nodes(edges).filter("node IS NOT NULL"))
    for k in range(rounds):
        if links.count() <= small:
            found = links.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_strong, "node long, component long")
            found = left.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
            return found if done is None else done.unionAll(found)
        # a bijection of longs, so ranks stand for nodes
        rank = lambda c, k=k: F.xxhash64(F.lit(k), F.col(c).cast("long"))
        state = left.select("node", rank("node").alias("at")).select("node", "at", F.col("at").alias("up"), F.col("at").alias("down"))
        state = _first_relatives(links.select(rank("src").alias("src"), rank("dst").alias("dst")), state)
        found = state.filter("up = down").select("node", "up")
        found = found.groupBy("up").agg(F.min("node").alias("component")).join(found, "up").select("node", "component")
        done = _settled(found if done is None else done.unionAll(found))
        left = _settled(state.filter("up <> down").select("node", "up", "down"))
        if left.isEmpty():
            return done
        ends = [left.select(F.col("node").alias(c), F.col("up").alias(f"u_{c}"), F.col("down").alias(f"d_{c}")) for c in ("src", "dst")]
        links = _settled(links.join(ends[0], "src").join(ends[1], "dst").filter("u_src = u_dst AND d_src = d_dst").select("src", "dst"))
        left = left.select("node")
    raise RuntimeError("strong components did not settle")


def _first_relatives(links: DataFrame, state: DataFrame, rounds: int = 10_000) -> DataFrame:
    """state (node, at, up, down) with the smallest `at` that leads to a node's and the smallest it leads to; links are of `at`."""
    for _ in range(rounds):
        ups = links.join(state.select(F.col("at").alias("src"), "up"), "src").groupBy(F.col("dst").alias("at")).agg(F.min("up").alias("u"))
        downs = links.join(state.select(F.col("at").alias("dst"), "down"), "dst").groupBy(F.col("src").alias("at")).agg(F.min("down").alias("d"))
        jumps = [state.select(F.col("at").alias(c), F.col(c).alias(f"j_{c}")) for c in ("up", "down")]
        wide = state.join(ups, "at", "left").join(downs, "at", "left").join(jumps[0], "up").join(jumps[1], "down")
        best = [F.least(F.col(c), F.col(c[0]), F.col(f"j_{c}")) for c in ("up", "down")]
        new = _settled(wide.select("node", "at", best[0].alias("up"), best[1].alias("down"), ((best[0] < F.col("up")) | (best[1] < F.col("down"))).alias("moved")))
        state = new.drop("moved")
        if new.filter("moved").isEmpty():
            return state
    raise RuntimeError("relatives did not settle")


def _strong(pdf: pd.DataFrame) -> pd.DataFrame:
    ahead, back = _adjacent(pdf), _adjacent(pdf.rename(columns={"src": "dst", "dst": "src"}))
    order, seen = [], set()
    for root in sorted(ahead):
        stack = [(root, iter(ahead[root]))] if root not in seen else []
        seen.add(root)
        while stack:
            node, rest = stack[-1]
            new = next((x for x in rest if x not in seen), None)
            if new is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(new)
                stack.append((new, iter(ahead[new])))
    found = {}
    for root in reversed(order):
        if root in found:
            continue
        members, queue = [root], deque([root])
        found[root] = None
        while queue:
            for x in back[queue.popleft()]:
                if x not in found:
                    found[x] = None
                    members.append(x)
                    queue.append(x)
        for m in members:
            found[m] = min(members)
    return pd.DataFrame({"node": list(found), "component": list(found.values())})



def betweenness(edges: DataFrame, batch: int = 256, most: int = 24) -> DataFrame:
    """(node, betweenness) of an undirected graph, by accumulation from every source.

    A component's sources are dealt over tasks (up to `most`), each of which holds the component's adjacency as numbers and adds
    up what its sources give. The work is the product of nodes and edges by nature.
    """
    part = _settled(components(edges).filter("node IS NOT NULL"))
    placed = _settled(with_row_number(part, [F.col("component").asc(), F.col("node").asc()], "at"))
    sizes = placed.groupBy("component").agg(F.min("at").alias("first"), F.count(F.lit(1)).cast("int").alias("n"))
    placed = _settled(placed.join(sizes, "component").select("component", "node", "n", (F.col("at") - F.col("first")).cast("int").alias("i")))
    links = both_ways(edges.select("src", "dst").filter("src <> dst")).join(placed.withColumnRenamed("node", "src"), "src").join(placed.select(F.col("node").alias("dst"), F.col("i").alias("j")), "dst")
    near = links.groupBy("component", "n", "i").agg(F.collect_list("j").alias("near"))
    tasks = F.least(F.ceil(F.col("n") / batch), F.lit(most)).cast("int")
    dealt = near.withColumn("tasks", tasks).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        n, count, first = int(pdf["n"].iloc[0]), int(pdf["tasks"].iloc[0]), int(pdf["task"].iloc[0])
        start = np.concatenate([[0], np.cumsum(pdf["near"].map(len).to_numpy())])
        score = _shares(start, np.concatenate(pdf["near"].to_numpy()).astype(np.int32), np.arange(first, n, count), batch)
        return pd.DataFrame({"component": pdf["component"].iloc[0], "i": np.arange(n, dtype=np.int32), "share": score})

    found = dealt.groupBy("component", "task").applyInPandas(f, "component long, i int, share double").groupBy("component", "i").agg(F.sum("share").alias("share"))
    return placed.join(found, ["component", "i"], "left").select("node", F.coalesce("share", F.lit(0.0)).alias("betweenness"))


def _shares(start: np.ndarray, near: np.ndarray, sources: np.ndarray, batch: int) -> np.ndarray:
    """What these sources add to each node's betweenness in a connected graph; node i's neighbours are near[start[i] : start[i + 1]]."""
    n, score = len(start) - 1, np.zeros(len(start) - 1)
    lists = None
    for k in range(0, len(sources), batch):
        some = sources[k : k + batch]
        # thin graphs are deep: searches node by node; others level by level, as products of the adjacency with all sources' counts
        got = _level_shares(start, near, some) if len(near) >= 16 * n else None
        if got is None:
            lists = lists or [near[start[i] : start[i + 1]].tolist() for i in range(n)]
            got = _queue_shares(lists, some.tolist())
        score += got
    return score


def _level_shares(start: np.ndarray, near: np.ndarray, sources: np.ndarray, deepest: int = 32) -> np.ndarray | None:
    n, m = len(start) - 1, len(sources)

    def summed(x: np.ndarray) -> np.ndarray:
        """Each node's sum of x over its neighbours."""
        out, dense = np.empty_like(x), len(near) > 0.01 * n * n
        step = 1024 if dense else max(1, 100_000 * n // len(near))
        for a in range(0, n, step):
            b = min(n, a + step)
            at = near[start[a] : start[b]]
            if dense:
                rows = np.zeros((b - a, n))
                rows[np.repeat(np.arange(b - a), np.diff(start[a : b + 1])), at] = 1
                out[a:b] = rows @ x
            else:
                out[a:b] = np.add.reduceat(x[at], start[a:b] - start[a], axis=0)
        return out

    level = np.full((n, m), -1, np.int16)
    level[sources, np.arange(m)] = 0
    front = np.zeros((n, m))
    front[sources, np.arange(m)] = 1
    paths, scales, last = front.copy(), [None], 0
    while (level < 0).any():
        front = summed(front)
        front[level >= 0] = 0
        new, last = front > 0, last + 1
        if last > deepest:
            return None
        most = front.max(0)
        scales.append(np.where(most > 1e100, most, 1.0))
        front /= scales[-1]
        level[new] = last
        paths[new] = np.maximum(front[new], 1e-300)
    share = np.zeros((n, m))
    for k in range(last, 1, -1):  # a source's own share doesn't count
        given = summed(np.where(level == k, (1 + share) / paths, 0) / scales[k])
        before = level == k - 1
        share[before] = (paths * given)[before]
    return share.sum(1) / 2


def _queue_shares(near: list, sources: list) -> np.ndarray:
    score = np.zeros(len(near))
    for s in sources:
        order, before, paths, far = [], defaultdict(list), defaultdict(int, {s: 1}), {s: 0}
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                score[w] += share[w] / 2
    return score


def topological_order(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(node, level): the longest way from a node without in-edges; a cycle raises RuntimeError. Levels are peeled in rounds."""
    links, left = _cut(edges.select("src", "dst").distinct()), _cut(nodes(edges))
    done = None
    for k in range(rounds):
        if left.isEmpty():
            return done
        free = _cut(left.join(links.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(k)))
        if free.isEmpty():
            raise RuntimeError("a cycle")
        done = _cut(free if done is None else done.unionAll(free))
        left = _cut(left.join(free, "node", "left_anti"))
        links = _cut(links.join(free.select(F.col("node").alias("src")), "src", "left_anti"))
    raise RuntimeError("more levels than rounds")


def matching(edges: DataFrame) -> DataFrame:
    """(src, dst): a maximum matching of a bipartite graph whose edges lead from one side to the other."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        near, taken = _adjacent(pdf), {}

        def place(a, seen: set) -> bool:
            # augmenting paths, depth first, without recursion
            stack = [(a, iter(near[a]))]
            way = []
            while stack:
                node, rest = stack[-1]
                b = next((x for x in rest if x not in seen), None)
                if b is None:
                    stack.pop()
                    if way:
                        way.pop()
                    continue
                seen.add(b)
                way.append((node, b))
                if b not in taken:
                    for u, v in way:
                        taken[v] = u
                    return True
                stack.append((taken[b], iter(near[taken[b]])))
            return False

        for a in sorted(set(pdf["src"])):
            place(a, set())
        return pd.DataFrame({"src": list(taken.values()), "dst": list(taken)}, columns=["src", "dst"])

    return per_component(edges, f, "src long, dst long")


def matching_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(src, dst): a maximum matching of left (src, key) and right (dst, key), each row of the one being linked with every row of
    the other that has its key. The links are never written out: the n-th of a key takes the n-th of the other side, by numbers
    of a distributed sort. Where a node has several keys, its links are no such groups, and `matching` takes them one by one."""
    left, right = (df.select(c, key).filter(F.col(c).isNotNull() & F.col(key).isNotNull()).distinct() for df, c in ((left, "src"), (right, "dst")))
    if any(not df.groupBy(c).count().filter("count > 1").isEmpty() for df, c in ((left, "src"), (right, "dst"))):
        return matching(left.join(right, key).select("src", "dst"))

    def placed(df: DataFrame, c: str) -> DataFrame:
        rows = with_row_number(df, [F.col(key).asc(), F.col(c).asc()], "_at")
        return rows.join(rows.groupBy(key).agg(F.min("_at").alias("_first")), key).select(key, c, (F.col("_at") - F.col("_first")).alias("_n"))

    return placed(left, "src").join(placed(right, "dst"), [key, "_n"]).select("src", "dst")


def max_flow(edges: DataFrame, source, sink) -> float:
    """The largest flow over weights as capacities.

    A search over tables finds the shortest ways that still have room, one task the largest flow over the edges of all ways
    found so far, and so on until there is no way left; the flow is the largest of the whole graph then. A task holds the edges
    of those ways, not the graph.
    """
    links = _settled(edges.filter("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight")).filter("weight > 1e-12"))
    part = flows = None
    total = 0.0
    while (ways := _shortest_ways(links, flows, source, sink)) is not None:
        part = _settled(ways if part is None else part.unionAll(ways).distinct())
        flows = _settled(_flows(part, source, sink))
        total = float(flows.agg(F.sum(F.when(F.col("src") == source, F.col("flow")).when(F.col("dst") == source, -F.col("flow")))).first()[0])
    return total


def _at(df: DataFrame, ends: DataFrame, size: int) -> DataFrame:
    """Rows of df at these ends, of which there are `size`; few are sent to all."""
    return df.join(F.broadcast(ends) if size <= 100_000 else ends, ends.columns)


def _shortest_ways(links: DataFrame, flows: DataFrame | None, source, sink) -> DataFrame | None:
    """(src, dst, weight): the links on shortest ways from source to sink with room beside the flows; None if there is no way."""
    kind = links.schema["src"].dataType
    one = lambda x: links.sparkSession.range(1).select(F.lit(x).cast(kind).alias("node"))
    if flows is not None:
        back = _settled(flows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "flow"))
        net = flows.unionAll(back.withColumn("flow", -F.col("flow"))).groupBy("src", "dst").agg(F.sum("flow").alias("flow"))
        full = _settled(_at(links, flows.select("src", "dst"), flows.count()).join(net, ["src", "dst"]).filter("weight - flow <= 1e-12").select("src", "dst"))
        full_size = full.count()

    def around(front: DataFrame, size: int, end: str) -> DataFrame:
        """Ways with room from (src) or to (dst) the front; those back over a flow have no weight."""
        at = front.select(F.col("node").alias(end))
        found = _at(links, at, size)
        if flows is None:
            return found
        found = found.join(F.broadcast(full) if full_size <= 100_000 else full, ["src", "dst"], "left_anti")
        return found.unionAll(back.join(at, end).select("src", "dst", F.lit(None).cast("double")))

    front, size = one(source), 1
    levels, seen = [(front, size)], front
    while True:
        front = _settled(around(front, size, "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        size = front.count()
        if not size:
            return None
        if not front.filter(F.col("node") == F.lit(sink)).isEmpty():
            break
        levels.append((front, size))
        seen = _settled(seen.unionAll(front))
    ways, front, size = None, one(sink), 1
    for before, n in reversed(levels):
        step = _settled(_at(around(front, size, "dst"), before.select(F.col("node").alias("src")), n).select("src", "dst", "weight"))
        ways = step if ways is None else ways.unionAll(step)
        front = _settled(step.select(F.col("src").alias("node")).distinct())
        size = front.count()
    return ways.filter("weight IS NOT NULL")


def _flows(part: DataFrame, source, sink) -> DataFrame:
    """(src, dst, flow) of a largest flow over the edges of part, in one task: shortest ways in phases."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = list(zip(pdf["src"].tolist(), pdf["dst"].tolist(), pdf["weight"].tolist(), strict=True))
        near, head, room = defaultdict(list), [], []
        for a, b, w in edges:
            near[a].append(len(head))
            near[b].append(len(head) + 1)
            head += [b, a]
            room += [w, 0.0]
        while True:
            level, queue = {source: 0}, deque([source])
            while queue and sink not in level:
                v = queue.popleft()
                for e in near[v]:
                    if room[e] > 1e-12 and head[e] not in level:
                        level[head[e]] = level[v] + 1
                        queue.append(head[e])
            if sink not in level:
                break
            tried, way, v = defaultdict(int), [], source
            while True:
                if v == sink:
                    push = min(room[e] for e in way)
                    for e in way:
                        room[e] -= push
                        room[e ^ 1] += push
                    way, v = [], source
                    continue
                while tried[v] < len(near[v]):
                    e = near[v][tried[v]]
                    if room[e] > 1e-12 and level.get(head[e]) == level[v] + 1:
                        break
                    tried[v] += 1
                if tried[v] < len(near[v]):
                    way.append(e)
                    v = head[e]
                elif way:
                    v = head[way.pop() ^ 1]
                    tried[v] += 1
                else:
                    break
        used = [(a, b, room[2 * i + 1]) for i, (a, b, _) in enumerate(edges) if room[2 * i + 1] > 1e-12]
        return pd.DataFrame(used, columns=["src", "dst", "flow"])

    return part.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(f, "src long, dst long, flow double")
