"""Parent-child links to full hierarchies, with cycles named.

Roots start a frontier that is joined to the links level by level; every level
extends path and depth. The nodes that no frontier reaches lie on a cycle or
below one. Real trees have a thin tail of very deep branches; once a level
reaches only a small share of what is left, the frontier moves on by doubling
jumps (1, 2, 4, ... levels at a time), so depth costs a logarithm of jobs.

Every job joins on (graph, node): a repository with a third of all links still
spreads over all tasks, and nothing is gathered on the driver but counts.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.graph import reach
from quarrylight.storage import broadcast_if_small, materialize, release, rows_of

#: A level that is smaller than the one before and reaches less than this share
#: of the nodes left ends the level-wise part.
THIN = 1 / 8
MAX_ROUNDS = 62
#: Ids in all paths of a frontier that may be broadcast, of under 100 bytes each: 20 MB at most.
SHORT_PATHS = 200_000

#: fixed values: kinds that state a parent link, by the side the parent stands on
PARENT_IS_SOURCE = ("contains", "owns", "declares")
PARENT_IS_TARGET = ("belongs_to", "defined_in")


def stated_links(edges: DataFrame) -> DataFrame:
    """(repository_id, commit_sha, node_id, parent_id) of every edge that states a parent.

    ``edges`` has one row for each edge that counts. Kinds are compared without
    case and outer blanks; other kinds and rows with a null end, repository or
    commit state no link. One link may be stated by several edges.
    """
    kind = F.lower(F.trim("kind"))
    down = kind.isin(*PARENT_IS_SOURCE)
    links = edges.where(down | kind.isin(*PARENT_IS_TARGET)).select(
        "repository_id",
        "commit_sha",
        F.when(down, F.col("target_id")).otherwise(F.col("source_id")).alias("node_id"),
        F.when(down, F.col("source_id")).otherwise(F.col("target_id")).alias("parent_id"),
    )
    return links.dropna()


def parent_links(edges: DataFrame) -> DataFrame:
    """(repository_id, commit_sha, node_id, parent_id), one row for each node with a parent.

    Links are those of :func:`stated_links`, each once. Trees have one parent a
    node: of several the smallest id (by code points) is followed, and
    :func:`further_parents` lists the others.
    """
    return stated_links(edges).groupBy("repository_id", "commit_sha", "node_id").agg(F.min("parent_id").alias("parent_id"))


def further_parents(edges: DataFrame) -> DataFrame:
    """(repository_id, commit_sha, node_id, parent_id, followed): every parent of each node that has several.

    A link that breaks the trees is reported here rather than lost; ``followed``
    marks the one that :func:`parent_links` keeps.
    """
    key = ["repository_id", "commit_sha", "node_id"]
    links = stated_links(edges)
    several = links.groupBy(*key).agg(F.min("parent_id").alias("least"), F.max("parent_id").alias("most")).where("least <> most")
    return links.distinct().join(several.select(*key, "least"), key).select(*key, "parent_id", (F.col("parent_id") == F.col("least")).alias("followed"))


class Hierarchy:
    """The trees of a link table.

    links: (repository_id, commit_sha, node_id, parent_id), one parent a node.
    paths: whether to carry depth, root and the full path; without it only
    reachability is known, which is all that cycles need.
    thin: share of the nodes left under which a shrinking level ends the
    level-wise part; 0 climbs level by level to the end, with equal results.

    Repeated links, self links and empty tables are allowed; rows with nulls
    are dropped; further columns of ``links`` are not read.
    """

    def __init__(self, links: DataFrame, paths: bool = True, thin: float = THIN) -> None:
        self.paths, self.thin = paths, thin
        # written once: the graphs' names and the numbered links both come from it
        links = materialize(links.select("repository_id", "commit_sha", "node_id", "parent_id").dropna(), "named")
        graphs = links.select("repository_id", "commit_sha").distinct()
        self.graphs = materialize(graphs.withColumn("g", F.monotonically_increasing_id()), "graphs")
        self.n_graphs = rows_of(self.graphs)
        named = links.join(broadcast_if_small(self.graphs, self.n_graphs), ["repository_id", "commit_sha"])
        self.links = materialize(named.groupBy("g", F.col("node_id").alias("n")).agg(F.min("parent_id").alias("p")), "links")
        release(links)
        self.levels: list[DataFrame] = []
        self._climb()

    def _climb(self) -> None:
        parents = self.links.select("g", F.col("p").alias("n")).distinct()
        top = parents.join(self.links.select("g", "n"), ["g", "n"], "left_anti")
        if self.paths:
            top = top.select("g", "n", F.lit(None).cast("string").alias("p"), F.lit(0).alias("depth"), F.col("n").alias("root"), F.array("n").alias("path"))
        frontier = materialize(top, "roots")
        self.levels.append(frontier)
        left = rows_of(self.links)
        before = 0
        links = self.links.select("g", "p", F.col("n").alias("child"))
        while left:
            up = frontier.select("g", F.col("n").alias("p"), *(["depth", "root", "path"] if self.paths else []))
            if not self.paths or rows_of(frontier) * len(self.levels) <= SHORT_PATHS:
                up = broadcast_if_small(up, rows_of(frontier))  # else the links would be shuffled for every level
            else:
                up = up.hint("merge")  # files of paths are far smaller than the paths
            step = links.join(up, ["g", "p"])
            if self.paths:
                step = step.select("g", F.col("child").alias("n"), "p", (F.col("depth") + 1).alias("depth"), "root", F.concat("path", F.array("child")).alias("path"))
            else:
                step = step.select("g", F.col("child").alias("n"))
            frontier = materialize(step, "level")
            size = rows_of(frontier)
            if not size:
                break
            self.levels.append(frontier)
            if size < before and size < self.thin * left:
                break
            before = size
            left -= size
        self._tail(frontier)

    def _tail(self, frontier: DataFrame) -> None:
        """Doubling jumps for the nodes below the last level; sets ``tail`` and ``unreached``."""
        reached = reduce(DataFrame.unionByName, [x.select("g", "n") for x in self.levels])
        rest = self.links.join(reached, ["g", "n"], "left_anti")
        edge = frontier.select("g", F.col("n").alias("p"), F.lit(True).alias("edge"))
        state = rest.join(edge, ["g", "p"], "left").select(
            "g", "n", "p", F.col("p").alias("at"), F.col("edge").isNotNull().alias("done"), *([F.array("n").alias("seg")] if self.paths else [])
        )
        now = materialize(state, "tail")
        total, done = rows_of(now), now.where("done").count()
        for _ in range(MAX_ROUNDS):
            if done == total:
                break
            via = now.select("g", F.col("n").alias("at"), F.col("at").alias("at2"), F.col("done").alias("done2"), *([F.col("seg").alias("seg2")] if self.paths else []))
            moved = (
                now.where("not done")
                .join(via.hint("merge") if self.paths else broadcast_if_small(via, total), ["g", "at"], "left")
                .select("g", "n", "p", F.coalesce("at2", "at").alias("at"), F.coalesce("done2", F.lit(False)).alias("done"), *([F.concat("seg2", "seg").alias("seg")] if self.paths else []))
            )
            after = materialize(now.where("done").unionByName(moved), "tail")
            release(now)
            now, was, done = after, done, after.where("done").count()
            if done == was:
                break  # distances to the trees have no gaps: whoever is left never arrives
        self.tail = now.where("done")
        self.last_frontier = frontier
        self.n_unreached = total - done
        self.unreached = now.where("not done").select("g", "n", "p")

    def nodes(self) -> DataFrame:
        """(repository_id, commit_sha, node_id, parent_id, depth, root_id, path) of all nodes with a root."""
        if not self.paths:
            raise ValueError("nodes() needs paths=True")
        columns = ["g", "n", "p", "depth", "root", "path"]
        near = reduce(DataFrame.unionByName, [x.select(*columns) for x in self.levels])
        top = self.last_frontier.select("g", F.col("n").alias("at"), "depth", "root", "path")
        far = self.tail.join(top, ["g", "at"]).select(
            "g", "n", "p", (F.col("depth") + F.size("seg")).alias("depth"), "root", F.concat("path", "seg").alias("path")
        )
        return self._named(near.unionByName(far)).select(
            "repository_id", "commit_sha", F.col("n").alias("node_id"), F.col("p").alias("parent_id"), "depth", F.col("root").alias("root_id"), "path"
        )

    def ancestor_pairs(self) -> DataFrame:
        """(repository_id, commit_sha, node_id, descendant_id, distance): every node and each node below it."""
        return self.nodes().select(
            "repository_id",
            "commit_sha",
            F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("at", "node_id"),
            F.col("node_id").alias("descendant_id"),
            "depth",
        ).select("repository_id", "commit_sha", F.col("node_id"), "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))

    def rootless_pairs(self) -> DataFrame:
        """(repository_id, commit_sha, node_id, descendant_id, distance): the same for nodes on a cycle of parents or below one, at the least distance.

        On a cycle every other node of it is below; no node is below itself.
        """
        up = reach(self.unreached.select("g", F.col("n").alias("src"), F.col("p").alias("dst")), self.unreached.select("g", F.col("n").alias("start")))
        found = up.where("node <> start").select("g", F.col("node").alias("node_id"), F.col("start").alias("descendant_id"), F.col("depth").alias("distance"))
        return self._named(found).select("repository_id", "commit_sha", "node_id", "descendant_id", "distance")

    def cyclic(self) -> DataFrame:
        """(repository_id, commit_sha, node_id, cycle_head): nodes on a cycle of parents or below one.

        cycle_head is the smallest node_id of that cycle by code points. A jump
        of at least as many steps as a graph has such nodes lands on the cycle
        and, from there, has seen all of it.
        """
        if not self.n_unreached:
            return self._named(self.unreached).select("repository_id", "commit_sha", F.col("n").alias("node_id"), F.col("p").alias("cycle_head"))
        largest = self.unreached.groupBy("g").count().agg(F.max("count")).first()[0]
        now = materialize(self.unreached.select("g", "n", F.col("p").alias("at"), F.col("p").alias("low")), "cycle")
        for _ in range(math.ceil(math.log2(max(2, largest)))):
            via = now.select("g", F.col("n").alias("at"), F.col("at").alias("at2"), F.col("low").alias("low2"))
            after = materialize(
                now.join(broadcast_if_small(via, self.n_unreached), ["g", "at"]).select("g", "n", F.col("at2").alias("at"), F.least("low", "low2").alias("low")), "cycle"
            )
            release(now)
            now = after
        heads = now.select("g", F.col("n").alias("at"), F.col("low").alias("cycle_head"))
        found = now.join(broadcast_if_small(heads, self.n_unreached), ["g", "at"])
        return self._named(found).select("repository_id", "commit_sha", F.col("n").alias("node_id"), "cycle_head")

    def _named(self, rows: DataFrame) -> DataFrame:
        return rows.join(broadcast_if_small(self.graphs, self.n_graphs), "g")
