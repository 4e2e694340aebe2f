"""Graph traversal and structure over edge tables.

Edges are rows (g, src, dst); g names the graph, so that every operator works on
all graphs of a table at once and a big repository spreads over all tasks.
Frontier loops join level by level, write each step to shared storage and stop on
an empty frontier; only counts reach the driver. Rows with a null are left out,
repeated edges count once, further columns are not read, and an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.storage import broadcast_if_small, materialize, release, rows_of

FOREVER = 1_000_000
#: A graph of at most so many edges may be walked inside one task; the bound is
#: checked before, and larger graphs take the frontier loops. The starts of a
#: graph are dealt over blocks, a task's part each, so that edges times starts
#: of one stay within the work, as far as MOST_BLOCKS copies of the edges allow.
LOCAL_EDGES, LOCAL_WORK, MOST_BLOCKS = 200_000, 20_000_000, 64
#: Pairs of start and node that such a task looks after at a time.
LOCAL_CELLS = 4_000_000
#: Values in a batch that leaves such a task.
BATCH = 200_000


def _fits_tasks(edges: DataFrame, starts: DataFrame | None = None) -> bool:
    """Whether every graph is small enough for a task of its own; one small aggregate."""
    n = edges.groupBy("g").agg(F.count(F.lit(1)).alias("e"))
    if starts is None:
        return (n.agg(F.max("e")).first()[0] or 0) <= LOCAL_EDGES
    m = n.join(starts.groupBy("g").agg(F.count(F.lit(1)).alias("s")), "g").agg(F.max("e"), F.max(F.col("e") * F.col("s"))).first()
    return (m[0] or 0) <= LOCAL_EDGES and (m[1] or 0) <= LOCAL_WORK


def _adjacency(edges: pd.DataFrame) -> dict:
    out: dict = {}
    for a, b in sorted(set(zip(edges["src"], edges["dst"], strict=True))):
        out.setdefault(a, []).append(b)
    return out


def simple(edges: DataFrame) -> DataFrame:
    """Different edges without nulls."""
    return edges.select("g", "src", "dst").dropna().distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select("g", F.col("dst").alias("src"), F.col("src").alias("dst"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("g", "src", "dst").unionByName(reverse(edges)).distinct()


def nodes(edges: DataFrame) -> DataFrame:
    """(g, node) of all ends."""
    return edges.select("g", F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """A10: (g, node, fan_in, fan_out), one pass and one aggregation."""
    ends = edges.select("g", F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    return ends.groupBy("g", "node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def centrality(edges: DataFrame) -> DataFrame:
    """Degree centrality (in + out) / (n - 1), 0 in a graph of one node; a self loop adds 2."""
    d = degrees(edges)
    n = d.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    out = d.join(n, "g")
    return out.select("g", "node", "fan_in", "fan_out", F.when(F.col("n") > 1, (F.col("fan_in") + F.col("fan_out")) / (F.col("n") - 1)).otherwise(F.lit(0.0)).alias("centrality"))


def statistics(edges: DataFrame) -> DataFrame:
    """(g, nodes, edges, density = m / (n (n - 1)))."""
    n = nodes(edges).groupBy("g").agg(F.count(F.lit(1)).alias("nodes"))
    m = edges.groupBy("g").agg(F.count(F.lit(1)).alias("edges"))
    return n.join(m, "g").withColumn("density", F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(F.lit(0.0)))


class Seen:
    """The rows that a frontier loop has reached, in few tables.

    Levels are merged like digits of a counter: two tables of one order become
    one of the next, so an anti-join reads a logarithm of the levels and a row
    is rewritten a logarithm of times. Merged tables are deleted.
    """

    def __init__(self, key: list[str]) -> None:
        self.key = key
        self.parts: list[tuple[int, DataFrame]] = []

    def new(self, rows: DataFrame) -> DataFrame:
        """The rows whose key was not reached before."""
        return rows.join(self.all().select(*self.key), self.key, "left_anti") if self.parts else rows

    def add(self, rows: DataFrame) -> None:
        """A written table of new rows; the last two stay apart, as the next step still reads them."""
        self.parts.append((0, rows))
        while len(self.parts) > 2 and self.parts[-3][0] == self.parts[-2][0]:
            (order, a), (_, b) = self.parts[-3:-1]
            self.parts[-3:-1] = [(order + 1, materialize(a.unionByName(b), "seen"))]
            release(a)
            release(b)

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [x for _, x in self.parts])


def _search(ends: np.ndarray, below: np.ndarray, starts: np.ndarray, max_depth: int, toward: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Breadth first from many starts at once: (start, node, depth, row of the predecessor) in batches.

    below[ends[i] : ends[i + 1]] are the successors of node i, ascending. A batch
    holds whole searches in the order of depths; a row's predecessor is in its batch.
    """
    n = len(ends) - 1
    most = max(1, min(LOCAL_CELLS // max(n, 1), len(starts)))
    met = np.empty(most * n, np.int32)  # negative: not met by this start
    for first in range(0, len(starts), most):
        own = starts[first : first + most]
        met.fill(-1)
        who, at = np.arange(len(own)), own
        met[who * n + at] = 0
        rows, depth, before = [(who, at, np.full(len(own), -1))], 0, 0
        # a level in the order of its paths and neighbours in order: who is met first has the smallest path
        while depth < max_depth:
            low = ends[at]
            sizes = ends[at + 1] - low
            up_to = np.cumsum(sizes)
            cuts = np.unique(np.searchsorted(up_to, np.arange(LOCAL_CELLS, up_to[-1], LOCAL_CELLS), "right"))
            cells, parents = [], []
            for i, j in zip([0, *cuts], [*cuts, len(at)], strict=True):
                size = sizes[i:j]
                parent = np.repeat(np.arange(i, j), size)
                edge = np.arange(len(parent)) + np.repeat(low[i:j] - (up_to[i:j] - size) + (up_to[i - 1] if i else 0), size)
                cell = who[parent] * n + below[edge]
                new = met[cell] < 0
                cell, parent = cell[new], parent[new]
                place = np.arange(len(cell), dtype=np.int32)
                met[cell[::-1]] = place[::-1]  # of equal cells the first is written last
                new = met[cell] == place
                cells.append(cell[new])
                parents.append(parent[new])
            cell, parent = np.concatenate(cells), np.concatenate(parents)
            if not len(cell):
                break
            if toward:
                order = np.argsort(cell)
                cell, parent = cell[order], parent[order]
            parent += before
            before += len(at)
            who, at = np.divmod(cell, n)
            rows.append((who, at, parent))
            depth += 1
        depths = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x, _, _ in rows])
        who, at, parent = (np.concatenate(x) for x in zip(*rows, strict=True))
        yield own[who], at, depths, parent


def _path_nodes(node: np.ndarray, depth: np.ndarray, parent: np.ndarray, rows: slice, toward: bool) -> tuple[np.ndarray, np.ndarray]:
    """The paths of some rows of a batch of :func:`_search`: offsets, and nodes of all paths behind one another."""
    at, left = np.arange(rows.start, rows.stop), depth[rows].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(left + 1)])
    out = np.empty(ends[-1], np.int64)
    place, step = (ends[:-1].copy(), 1) if toward else (ends[1:] - 1, -1)
    while len(at):
        out[place] = node[at]
        more = left > 0
        at, place, left = parent[at[more]], place[more] + step, left[more] - 1
    return ends.astype(np.int32), out


def _reach_in_tasks(edges: DataFrame, starts: DataFrame | None, blocks: DataFrame, max_depth: int, paths: bool = False, toward: bool = False, joined: str | None = None, counts: bool = False) -> DataFrame:
    """Breadth first search of each small graph, a block of its starts in one task; rows leave in batches.

    blocks: (g, blocks), into how many the starts of a graph are dealt; without
    starts each block takes its share of the nodes. With ``counts`` only
    (g, start, reached) leaves the task.
    """
    kind = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    every_node = starts is None
    start_kind = kind["src"] if every_node else dict(starts.dtypes)["start"]
    names = ["g", "start", *(["reached"] if counts else ["node", "depth", *(["path"] if paths else [])])]

    def walk(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        src, dst = t.column("src").combine_chunks(), t.column("dst").combine_chunks()
        is_edge = pc.is_valid(dst)
        known = pc.unique(pa.concat_arrays([src, dst.filter(is_edge)]))
        known = known.take(pc.sort_indices(known))  # numbers in the order of names
        code = lambda x: pc.index_in(x, value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)
        pairs = np.unique(code(src.filter(is_edge)) * len(known) + code(dst.filter(is_edge)))
        ends = np.searchsorted(pairs // len(known), np.arange(len(known) + 1))
        begin = np.arange(key[2].as_py(), len(known), key[3].as_py()) if every_node else np.unique(code(src.filter(pc.invert(is_edge))))
        g, of = key[1].cast(t.schema.field("g").type), lambda x: known.take(pa.array(x))

        def batch(count: int, *columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.repeat(g, count), *columns], names=names)

        for start, node, depth, parent in _search(ends, pairs % len(known), begin, max_depth, toward):
            if counts:
                own, met = np.unique(start, return_counts=True)
                yield batch(len(own), of(own), pa.array(met - 1))
                continue
            at = 0
            while at < len(node):
                rows = slice(at, min(at + BATCH, len(node)))
                if paths:  # depths ascend: as many rows as their nodes allow
                    fit = np.searchsorted(np.cumsum(depth[rows] + np.int64(1)), BATCH, "right")
                    rows = slice(at, at + max(1, int(fit)))
                columns = [of(start[rows]), of(node[rows]), pa.array(depth[rows])]
                if paths:
                    offsets, path = _path_nodes(node, depth, parent, rows, toward)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), of(path))
                    columns.append(lists if joined is None else pc.binary_join(lists, joined))
                yield batch(rows.stop - at, *columns)
                at = rows.stop

    schema = f"g {kind['g']}, start {kind['src']}, " + ("reached bigint" if counts else f"node {kind['src']}, depth int" + (", path " + (f"array<{kind['src']}>" if joined is None else "string") if paths else ""))
    dealt = broadcast_if_small(blocks)
    sent = edges.select("g", "src", "dst").dropna().join(dealt, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "blocks", "src", "dst")
    if not every_node:
        named = starts.select("g", "start").dropna().join(dealt, "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        sent = sent.unionByName(named.select("g", F.pmod(F.xxhash64("start"), "blocks").cast("int").alias("block"), "blocks", F.col("start").cast(kind["src"]).alias("src"), F.lit(None).cast(kind["dst"]).alias("dst")))
    # sorted by a number first: names of graphs begin alike
    found = sent.groupBy(F.xxhash64("g", "block").alias("slot"), "g", "block", "blocks").applyInArrow(walk, schema)
    return found if start_kind == kind["src"] else found.withColumn("start", F.col("start").cast(start_kind))


def _blocks(edges: DataFrame, starts: DataFrame | None) -> DataFrame | None:
    """(g, blocks) for :func:`_reach_in_tasks`, or None if a graph is too large for a task; without starts about one for each edge."""
    n = edges.groupBy("g").agg(F.count(F.lit(1)).alias("e"))
    sized = n.withColumn("s", F.col("e")) if starts is None else n.join(starts.groupBy("g").agg(F.count(F.lit(1)).alias("s")), "g")
    blocks = F.least(F.ceil(F.col("e") * F.col("s") / LOCAL_WORK), F.lit(MOST_BLOCKS))
    out = materialize(sized.select("g", "e", F.greatest(blocks, F.lit(1)).cast("int").alias("blocks")), "blocks")
    if (out.agg(F.max("e")).first()[0] or 0) <= LOCAL_EDGES:
        return out.select("g", "blocks")
    release(out)
    return None


def _every_start(edges: DataFrame) -> DataFrame:
    return nodes(edges.dropna()).withColumnRenamed("node", "start")


def reach(edges: DataFrame, starts: DataFrame | None, max_depth: int = FOREVER, paths: bool = False, local: bool = True, toward: bool = False, joined: str | None = None) -> DataFrame:
    """What can be reached from each start.

    starts: (g, start), or None for every node of every graph. Result:
    (g, start, node, depth[, path]), the start itself at depth 0. A node is listed once for each start, at its least depth; with
    ``paths``, under the smallest of the shortest paths by code points. With
    ``toward`` paths are listed, and compared, from the node to the start. With
    ``joined`` paths are texts, nodes parted by it.
    """
    edges = edges.select("g", "src", "dst")
    if local and (blocks := _blocks(edges, starts)) is not None:
        return _reach_in_tasks(edges, starts, blocks, max_depth, paths, toward, joined)
    starts = starts if starts is not None else _every_start(edges)
    front = starts.select("g", "start", F.col("start").alias("node"), F.lit(0).alias("depth"), *([F.array("start").alias("path")] if paths else [])).distinct()
    front = materialize(front, "front")
    seen = Seen(["g", "start", "node"])
    seen.add(front)
    depth = 0
    while depth < max_depth:
        step = front.select("g", "start", F.col("node").alias("src"), "depth", *(["path"] if paths else [])).join(edges, ["g", "src"])
        if paths:
            step = step.groupBy("g", "start", F.col("dst").alias("node")).agg(F.min("depth").alias("depth"), F.min("path").alias("path"))
            longer = F.concat(F.array("node"), "path") if toward else F.concat("path", F.array("node"))
            step = step.select("g", "start", "node", (F.col("depth") + 1).alias("depth"), longer.alias("path"))
        else:
            step = step.select("g", "start", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        front = materialize(seen.new(step), "front")
        if not rows_of(front):
            release(front)
            break
        seen.add(front)
        depth += 1
    return seen.all() if joined is None else seen.all().withColumn("path", F.array_join("path", joined))


def reach_counts(edges: DataFrame, local: bool = True) -> DataFrame:
    """(g, start, reached), how many other nodes each node reaches; of small graphs only the counts leave the tasks."""
    edges = edges.select("g", "src", "dst")
    if local and (blocks := _blocks(edges, None)) is not None:
        return _reach_in_tasks(edges, None, blocks, FOREVER, counts=True)
    return reach(edges, None, local=False).groupBy("g", "start").agg((F.count(F.lit(1)) - 1).alias("reached"))


def reachable_set(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(g, node) reached from any of the starts (g, node), which are included."""
    edges = edges.select("g", "src", "dst")
    named = starts.select("g", F.col("node").alias("start"))
    if _fits_tasks(edges, named):
        return reach(edges, named).select("g", "node").unionByName(starts.select("g", "node")).distinct()
    front = materialize(starts.select("g", "node").distinct(), "front")
    seen = Seen(["g", "node"])
    while rows_of(front):
        seen.add(front)
        step = front.select("g", F.col("node").alias("src")).join(edges, ["g", "src"]).select("g", F.col("dst").alias("node")).distinct()
        front = materialize(seen.new(step), "front")
    return seen.all() if seen.parts else front


def unreachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The nodes that no start reaches."""
    return nodes(edges).join(reachable_set(edges, starts), ["g", "node"], "left_anti")


def weak_components(edges: DataFrame) -> DataFrame:
    """(g, node, component), component being the least node of the weakly connected part.

    Alternates large-star and small-star steps (Kiveris et al., 2014): labels
    settle in a logarithmic number of rounds, hubs do not blow up.
    """
    own = nodes(edges)
    now = edges.where("src <> dst").select("g", F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now = materialize(now, "star")
    while True:
        both = now.unionByName(now.select("g", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("g", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, ["g", "u"]).where("v > u").select("g", F.col("v").alias("u"), F.col("m").alias("v"))
        small_low = large.groupBy("g", "u").agg(F.min("v").alias("m"))
        small = large.join(small_low, ["g", "u"]).select("g", F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = materialize(small, "star")
        changed = rows_of(after) != rows_of(now) or not after.join(now, ["g", "u", "v"], "left_anti").isEmpty()
        release(now)
        now = after
        if not changed:
            break
    return own.join(now.select("g", F.col("u").alias("node"), F.col("v").alias("m")), ["g", "node"], "left").select("g", "node", F.coalesce("m", "node").alias("component"))


def _trim(edges: DataFrame, rounds: int = 4) -> DataFrame:
    """Edges whose ends may lie on a cycle: those without a predecessor or successor are peeled off."""
    now = materialize(edges.where("src <> dst"), "trim")
    size = rows_of(now)
    for _ in range(rounds):
        live = now.select("g", F.col("src").alias("node")).intersect(now.select("g", F.col("dst").alias("node")))
        live = materialize(live, "live")
        kept = now.join(live.select("g", F.col("node").alias("src")), ["g", "src"], "left_semi").join(live.select("g", F.col("node").alias("dst")), ["g", "dst"], "left_semi")
        after = materialize(kept.select("g", "src", "dst"), "trim")
        left = rows_of(after)
        release(now)
        now = after
        if left == size:
            break
        size = left
    return now


def _strong_in_tasks(edges: DataFrame) -> DataFrame:
    """Tarjan's algorithm, without recursion, for each small graph in one task."""
    kind = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def parts(key, e):
        nexts = _adjacency(e)
        order: dict = {}
        low: dict = {}
        on: set = set()
        stack: list = []
        rows = []
        for root in list(nexts):
            if root in order:
                continue
            work = [(root, iter(nexts[root]))]
            order[root] = low[root] = len(order)
            stack.append(root)
            on.add(root)
            while work:
                node, rest = work[-1]
                for b in rest:
                    if b not in order:
                        order[b] = low[b] = len(order)
                        stack.append(b)
                        on.add(b)
                        work.append((b, iter(nexts.get(b, ()))))
                        break
                    if b in on:
                        low[node] = min(low[node], order[b])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[node])
                    if low[node] == order[node]:
                        part = []
                        while not part or part[-1] != node:
                            part.append(stack.pop())
                            on.discard(part[-1])
                        if len(part) > 1:
                            least = min(part)
                            rows += [(key[0], n, least) for n in part]
        return pd.DataFrame(rows, columns=["g", "node", "component"])

    return edges.groupBy("g").applyInPandas(parts, f"g {kind['g']}, node {kind['src']}, component {kind['src']}")


def strong_components(edges: DataFrame, local: bool = True) -> DataFrame:
    """(g, node, component) of strongly connected parts of two nodes or more.

    Peels what cannot lie on a cycle, then colours: every node takes the least
    node that reaches it; in one colour, what reaches the node that gave it is
    its part. Found parts leave and the rest is peeled and coloured again.
    component is the least node of its part. Self loops do not count.
    """
    edges = simple(edges)
    if local and _fits_tasks(edges):
        return _strong_in_tasks(edges)
    rest = _trim(edges, rounds=1_000)
    found: list[DataFrame] = []
    while rows_of(rest):
        colour = materialize(nodes(rest).withColumn("c", F.col("node")), "colour")
        while True:
            offered = rest.join(colour.withColumnRenamed("node", "src"), ["g", "src"]).groupBy("g", F.col("dst").alias("node")).agg(F.min("c").alias("o"))
            better = colour.join(offered, ["g", "node"], "left").select("g", "node", "c", F.least("c", F.coalesce("o", "c")).alias("n"))
            # what reaches the node that gave the colour reaches this one too: labels jump, rounds grow with a logarithm
            jump = colour.select("g", F.col("node").alias("n"), F.col("c").alias("j"))
            better = better.join(jump, ["g", "n"], "left").select("g", "node", "c", F.least("n", F.coalesce("j", "n")).alias("n"))
            moved = materialize(better, "colour")
            still = not moved.where("n < c").isEmpty()
            release(colour)
            colour = moved.select("g", "node", F.col("n").alias("c"))
            if not still:
                break
        inside = rest.join(colour.select("g", F.col("node").alias("src"), F.col("c").alias("cs")), ["g", "src"]).join(colour.select("g", F.col("node").alias("dst"), F.col("c").alias("cd")), ["g", "dst"])
        inside = materialize(inside.where("cs = cd").select("g", "src", "dst", F.col("cs").alias("c")), "inside")
        part = materialize(inside.where("src = c or dst = c").select("g", "c", F.col("c").alias("node")).distinct(), "part")
        front, levels = part, [part]
        while True:
            back = front.select("g", "c", F.col("node").alias("dst")).join(inside, ["g", "c", "dst"]).select("g", "c", F.col("src").alias("node")).distinct()
            front = materialize(back.join(reduce(DataFrame.unionByName, levels), ["g", "c", "node"], "left_anti"), "back")
            if not rows_of(front):
                break
            levels.append(front)
        whole = reduce(DataFrame.unionByName, levels)
        sizes = whole.groupBy("g", "c").count()
        whole = materialize(whole.join(sizes.where("count > 1").select("g", "c"), ["g", "c"], "left_semi"), "part")
        found.append(whole.select("g", "node", F.col("c").alias("component")))
        gone = reduce(DataFrame.unionByName, levels).select("g", "node")  # parts of one node leave as well
        kept = rest.join(gone.select("g", F.col("node").alias("src")), ["g", "src"], "left_anti").join(gone.select("g", F.col("node").alias("dst")), ["g", "dst"], "left_anti")
        rest = _trim(kept.select("g", "src", "dst"), rounds=1_000)
    if not found:
        return nodes(edges).where("false").withColumn("component", F.col("node"))
    out = reduce(DataFrame.unionByName, found)
    least = out.groupBy("g", "component").agg(F.min("node").alias("least"))
    return out.join(least, ["g", "component"]).select("g", "node", F.col("least").alias("component"))


def cycle_summary(edges: DataFrame) -> DataFrame:
    """(g, components, cyclic_nodes, self_loops) of graphs that have any of them."""
    parts = strong_components(edges).groupBy("g").agg(F.countDistinct("component").alias("components"), F.count(F.lit(1)).alias("cyclic_nodes"))
    loops = simple(edges).where("src = dst").groupBy("g").agg(F.count(F.lit(1)).alias("self_loops"))
    out = parts.join(loops, "g", "full")
    return out.select("g", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("components", "cyclic_nodes", "self_loops")])


def short_cycles(edges: DataFrame, longest: int = 3) -> DataFrame:
    """(g, cycle) simple cycles of up to ``longest`` nodes, each once, from its least node.

    All simple cycles may be exponentially many, so the length is an explicit bound.
    """
    e = materialize(_trim(simple(edges)), "cycles")
    walk = e.where("src < dst").select("g", F.col("src").alias("head"), F.col("dst").alias("tail"), F.array("src", "dst").alias("cycle"))
    out = []
    for length in range(2, longest + 1):
        close = e.select("g", F.col("src").alias("tail"), F.col("dst").alias("head"))
        out.append(walk.join(close, ["g", "tail", "head"]).select("g", "cycle"))
        if length < longest:
            walk = walk.join(e.withColumnRenamed("src", "tail"), ["g", "tail"]).where("dst > head and not array_contains(cycle, dst)")
            walk = walk.select("g", "head", F.col("dst").alias("tail"), F.concat("cycle", F.array("dst")).alias("cycle"))
    loops = simple(edges).where("src = dst").select("g", F.array("src").alias("cycle"))
    return reduce(DataFrame.unionByName, [loops, *out])


def canonical_cycle(cycle: "F.Column") -> "F.Column":
    """A cycle turned so that its least node comes first."""
    at = F.array_position(cycle, F.array_min(cycle)).cast("int")
    return F.concat(F.slice(cycle, at, F.size(cycle)), F.slice(cycle, 1, at - 1))


def blast_radius(edges: DataFrame, starts: DataFrame, max_depth: int = 10) -> DataFrame:
    """(g, start, affected, risk): who is affected by a change, over reversed edges, the start left out."""
    hit = reach(reverse(edges), starts, max_depth).where("depth > 0 and node <> start")
    n = hit.groupBy("g", "start").agg(F.count(F.lit(1)).alias("affected"))
    out = starts.select("g", "start").distinct().join(n, ["g", "start"], "left").withColumn("affected", F.coalesce("affected", F.lit(0)))
    return out.withColumn("risk", F.when(F.col("affected") >= 20, "high").when(F.col("affected") >= 5, "medium").otherwise("low"))


def module_blast(edges: DataFrame, starts: DataFrame, include_start_on_cycle: bool = True) -> DataFrame:
    """Closure of the consumers with its parts by name, risk and percentage.

    With ``include_start_on_cycle`` a start that its own consumers lead back to counts as well.
    """
    hit = reach(reverse(edges), starts)
    hit = hit.where("depth > 0").select("g", "start", "node")
    if include_start_on_cycle:
        ring = strong_components(edges).select("g", F.col("node").alias("start")).unionByName(edges.where("src = dst").select("g", F.col("src").alias("start"))).distinct()
        back = starts.select("g", "start").distinct().join(ring, ["g", "start"], "left_semi")
        hit = hit.unionByName(back.withColumn("node", F.col("start")))
    name = F.lower("node")
    api, service, test = name.contains("api") | name.contains("router"), name.contains("service"), name.contains("test") | name.contains("spec")
    n = hit.groupBy("g", "start").agg(F.count(F.lit(1)).alias("total"), F.count_if(api).alias("apis"), F.count_if(service).alias("services"), F.count_if(test).alias("tests"))
    out = starts.select("g", "start").distinct().join(n, ["g", "start"], "left")
    out = out.select("g", "start", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "apis", "services", "tests")])
    risk = F.when((F.col("total") > 15) | (F.col("apis") > 3), "Critical").when(F.col("total") > 8, "High").when(F.col("total") > 3, "Medium").otherwise("Low")
    return out.withColumn("risk", risk).withColumn("percent", F.least(F.lit(100), F.col("total") * 5))


def neighbours(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(g, start, direction, node) of direct predecessors (in) and successors (out)."""
    s = starts.select("g", "start")
    out = edges.join(s.withColumnRenamed("start", "src"), ["g", "src"]).select("g", F.col("src").alias("start"), F.lit("out").alias("direction"), F.col("dst").alias("node"))
    into = edges.join(s.withColumnRenamed("start", "dst"), ["g", "dst"]).select("g", F.col("dst").alias("start"), F.lit("in").alias("direction"), F.col("src").alias("node"))
    return out.unionByName(into).distinct()


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """The edges with both ends among (g, node)."""
    return edges.join(keep.select("g", F.col("node").alias("src")), ["g", "src"], "left_semi").join(keep.select("g", F.col("node").alias("dst")), ["g", "dst"], "left_semi")


#: fixed values: kinds of nodes and of edges of the named projections; None takes all edges
PROJECTIONS: dict[str, tuple[tuple[str, ...], tuple[str, ...] | None]] = {
    "call": (("function", "method"), ("calls",)),
    "import": (("file", "module", "package"), ("imports",)),
    "inheritance": (("class", "interface", "struct", "enum"), ("extends", "implements", "overrides")),
    "dependency": ((), ("imports", "calls", "uses", "extends", "implements")),
    "module": (("module", "file"), None),
    "namespace": (("namespace",), None),
    "package": (("package",), None),
    "symbol": (("class", "interface", "struct", "enum", "function", "method", "field", "variable", "parameter", "symbol"), None),
    "repository": (("repository", "commit", "branch", "file", "module", "package"), None),
}


def project(edges: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """The edges (g, src, dst, kind) of a named projection: both ends among its kinds of nodes (g, node, kind), and of its kinds of edges."""
    node_kinds, edge_kinds = PROJECTIONS[name]
    out = edges.select("g", "src", "dst", "kind")
    if edge_kinds:
        out = out.where(F.col("kind").isin(*edge_kinds))
    return induced(out, nodes.where(F.col("kind").isin(*node_kinds))) if node_kinds else out


def ego(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(g, start, node, depth) around each start in both directions."""
    return reach(undirected(edges), starts, depth)


def nearest_reachable(edges: DataFrame, live: DataFrame, lost: DataFrame) -> DataFrame:
    """For each lost node the nearest live one without regard to direction, ties to the least.

    All live nodes start one search together, so the work does not grow with their number.
    """
    both = undirected(edges)
    label = materialize(live.select("g", "node", F.col("node").alias("nearest"), F.lit(0).alias("depth")), "near")
    front, seen = label, Seen(["g", "node"])
    seen.add(label)
    while True:
        step = front.select("g", F.col("node").alias("src"), "nearest", "depth").join(both, ["g", "src"]).groupBy("g", F.col("dst").alias("node")).agg(F.min("nearest").alias("nearest"), (F.min("depth") + 1).alias("depth"))
        front = materialize(seen.new(step), "near")
        if not rows_of(front):
            break
        seen.add(front)
    return lost.select("g", "node").join(seen.all(), ["g", "node"], "left")


def levels(edges: DataFrame) -> DataFrame:
    """(g, node, level) of an acyclic graph: 0 without predecessors, else 1 + the greatest of theirs.

    Kahn's algorithm, a level a round. Nodes on or behind a cycle get no row.
    """
    e = materialize(simple(edges), "dag")
    waiting = materialize(nodes(e), "waiting")
    done: list[DataFrame] = []
    level = 0
    while rows_of(waiting):
        blocked = e.join(waiting.select("g", F.col("node").alias("src")), ["g", "src"], "left_semi").select("g", F.col("dst").alias("node")).distinct()
        free = materialize(waiting.join(blocked, ["g", "node"], "left_anti"), "free")
        if not rows_of(free):
            break
        done.append(free.withColumn("level", F.lit(level)))
        after = materialize(waiting.join(free, ["g", "node"], "left_anti"), "waiting")
        release(waiting)
        waiting, level = after, level + 1
    return reduce(DataFrame.unionByName, done) if done else nodes(edges).where("false").withColumn("level", F.lit(0))


def call_tree(edges: DataFrame, starts: DataFrame, depth: int = 4) -> DataFrame:
    """(g, start, path, depth, back_edge): the tree of calls to a depth; a node that repeats on its own path is marked and not followed."""
    e = edges.select("g", "src", "dst")
    level = starts.select("g", "start", F.col("start").alias("src"), F.array("start").alias("path"), F.lit(0).alias("depth"), F.lit(False).alias("back_edge"))
    out = [level]
    for k in range(depth):
        level = level.where("not back_edge").join(e, ["g", "src"]).select(
            "g", "start", F.col("dst").alias("src"), F.concat("path", F.array("dst")).alias("path"), F.lit(k + 1).alias("depth"), F.array_contains("path", F.col("dst")).alias("back_edge")
        )
        level = materialize(level, "tree")
        out.append(level)
    return reduce(DataFrame.unionByName, [x.select("g", "start", "path", "depth", "back_edge") for x in out])


def mutual(edges: DataFrame) -> DataFrame:
    """(g, a, b) of nodes that depend on each other, each pair once."""
    e = edges.where("src <> dst")
    pair = e.select("g", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up"))
    return pair.groupBy("g", "a", "b").agg(F.bool_or("up").alias("x"), F.bool_or(~F.col("up")).alias("y")).where("x and y").select("g", "a", "b")


def dead_code(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes no entry reaches: (g, node, status, confidence, weight).

    status is ``unused`` without any caller and ``orphan`` below other dead
    nodes; weight = 1 + 10 * centrality + 0.5 * fan_out + nodes below.
    """
    lost = materialize(unreachable(edges, entries), "dead")
    c = centrality(edges)
    inner = materialize(induced(edges, lost), "dead-edges")
    below = reach(inner, lost.select("g", F.col("node").alias("start"))).where("depth > 0").groupBy("g", F.col("start").alias("node")).agg(F.count(F.lit(1)).alias("below"))
    out = lost.join(c, ["g", "node"]).join(below, ["g", "node"], "left")
    unused = F.col("fan_in") == 0
    return out.select(
        "g",
        "node",
        F.when(unused, "unused").otherwise("orphan").alias("status"),
        F.when(unused, 0.95).otherwise(0.90).alias("confidence"),
        (1 + 10 * F.col("centrality") + 0.5 * F.col("fan_out") + F.coalesce("below", F.lit(0))).alias("weight"),
    )


def reading_scores(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(g, node, score): 100 for an entry + 50 * centrality + 30 * share of the largest in-degree + 15 for a core folder - 40 for a peripheral one."""
    c = centrality(edges)
    core = F.col("node").rlike("(^|[/:])(core|src|lib|app|services?|domain)/")
    outer = F.col("node").rlike("(^|[/:])(tests?|docs?|examples?|scripts|benchmarks)/")
    entry = entries.select("g", "node").distinct().withColumn("entry", F.lit(True))
    top = c.groupBy("g").agg(F.max("fan_in").alias("top"))
    out = c.join(entry, ["g", "node"], "left").join(top, "g")
    score = F.when(F.col("entry"), 100.0).otherwise(0.0) + 50 * F.col("centrality") + F.when(F.col("top") > 0, 30 * F.col("fan_in") / F.col("top")).otherwise(0.0) + F.when(core, 15.0).otherwise(0.0) - F.when(outer, 40.0).otherwise(0.0)
    return out.select("g", "node", score.alias("score"))


def small_starts(edges: DataFrame, column: str = "src") -> DataFrame:
    """(g, start): of each graph the node with the most edges on one side, ties to the least."""
    d = edges.groupBy("g", F.col(column).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("g").orderBy(F.desc("n"), "start")
    return d.withColumn("r", F.row_number().over(w)).where("r = 1").select("g", "start")


