"""Parent-child links to full hierarchies.

Every node with one parent steps up, by 1, 2, 4, ... links, to its anchor: the nearest node above
that has no parent or several.  What stays unprocessed has one parent all the way up and so lies on
a ring without a way in, or below one; the least id of each ring becomes an anchor too.  The nodes
below an anchor, up to further anchors, are its tree, and those trees hold every node once.

In every tree subtree sizes are summed upward and preorder ranges handed out downward, siblings
getting theirs by prefix sums of sizes.  The descendants of a node in its tree are the nodes whose
preorder lies in its range, its ancestors those in whose range its own lies; both are found by a
join on the binary blocks of the ranges.  All of that takes log(depth) rounds.

Links that lead to an anchor are ways between trees.  The graph of anchors and ways is small where
few nodes have several parents; up to KERNEL ways it is solved in one task, beyond by rounds over
tables, with the same result: the nearest root of every anchor, and the ways that lie on cycles.
Nodes on cycles are those in whose range the foot of such a way lies.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomelattice.session import Stage, stage

#: Siblings that one window sorts at most, about; ways between anchors that one task solves.
SIBLINGS, KERNEL = 1 << 16, 1_000_000


class _Loop:
    """A table replaced round by round; files of earlier rounds are removed.  `seen` has aggregates taken when the last one was written."""

    def __init__(self, df: DataFrame, **counted: Column) -> None:
        self._counted = counted
        self._stage = Stage(df, **counted)

    @property
    def df(self) -> DataFrame:
        return self._stage.df

    @property
    def seen(self) -> dict:
        return self._stage.seen

    def replace(self, df: DataFrame) -> None:
        old, self._stage = self._stage, Stage(df, **self._counted)
        old.drop()


def edges(nodes: DataFrame, node: str, children: str) -> tuple[DataFrame, DataFrame]:
    """Distinct ids (node), and distinct links (parent, child, pos) to children that are nodes; pos is the first place in a list."""
    ids = stage(nodes.where(F.col(node).isNotNull()).select(F.col(node).alias("node")).distinct())
    listed = nodes.where(F.col(node).isNotNull()).select(F.col(node).alias("parent"), F.posexplode(children).alias("pos", "child")).where("child is not null")
    links = listed.groupBy("parent", "child").agg(F.min("pos").alias("pos"))
    return ids, stage(links.join(ids.withColumnRenamed("node", "child"), "child", "left_semi").select("parent", "child", "pos"))


def _step(t: DataFrame, low: bool = False) -> DataFrame:
    """A round of doubling: nodes that aren't done go on to where the node they have reached is."""
    above = t.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"), *([F.col("low").alias("low2")] if low else []))
    least = [F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("sunk")] if low else []
    moved = t.where("not done").join(above, "up").select("node", F.col("up2").alias("up"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done"), *least)
    return t.where("done").select(*moved.columns).unionByName(moved) if not low else t.where("done").withColumn("sunk", F.lit(False)).select(*moved.columns).unionByName(moved)


def _anchored(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(node, anchor, dist, top) of every node; top says that the node has no parent."""
    parents = links.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("parent")).withColumnRenamed("child", "node")
    start = stage(ids.join(parents, "node", "left").select("node", F.when(F.col("n") == 1, F.col("parent")).alias("parent"), F.col("n").isNull().alias("top")))
    done = F.col("parent").isNull()
    state = start.select("node", F.coalesce("parent", "node").alias("up"), F.when(done, 0).otherwise(1).cast("long").alias("dist"), done.alias("done"), F.col("parent").alias("low"), (~done).alias("sunk"))
    # low is the least id among the nodes passed; once no more are done and it sinks no more, it is that of the ring.
    loop = _Loop(state, left=F.count(F.when(~F.col("done"), 1)), sunk=F.count(F.when(F.col("sunk"), 1)))
    before = None
    while (left := loop.seen["left"]) and (left != before or loop.seen["sunk"]):
        before = left
        loop.replace(_step(_step(loop.df, low=True), low=True))
    found = loop.df.where("done").select("node", "up", "dist")
    if left:
        rest = loop.df.where("not done").select("node", (F.col("low") == F.col("node")).alias("done")).join(start.select("node", "parent"), "node")
        ring = _Loop(rest.select("node", F.when(F.col("done"), F.col("node")).otherwise(F.col("parent")).alias("up"), F.when(F.col("done"), 0).otherwise(1).cast("long").alias("dist"), "done"), left=F.count(F.when(~F.col("done"), 1)))
        while ring.seen["left"]:
            ring.replace(_step(_step(ring.df)))
        found = found.unionByName(ring.df.select("node", "up", "dist"))
    return stage(found.join(start.select("node", "top"), "node").select("node", F.col("up").alias("anchor"), "dist", "top"))


def _solved(ways: pa.Table) -> pa.Table:
    """(anchor, depth, root, ring) of all ends of ways (src, dst, steps, top); ring names the strongly connected component of an anchor on a cycle."""
    names = pc.unique(pa.chunked_array([*ways["src"].chunks, *ways["dst"].chunks]))
    src, dst = (pc.index_in(ways[c], value_set=names).to_numpy() for c in ("src", "dst"))
    order = np.argsort(src, kind="stable")
    at, n = np.searchsorted(src[order], np.arange(len(names) + 1)).tolist(), len(names)
    to, steps, name = dst[order].tolist(), ways["steps"].to_numpy()[order].tolist(), names.to_pylist()
    depth, root = [-1] * n, [None] * n
    heap = [(0, name[i], i) for i in np.unique(src[ways["top"].to_numpy(zero_copy_only=False)]).tolist()]
    heapq.heapify(heap)
    while heap:
        d, r, v = heapq.heappop(heap)
        if depth[v] < 0:
            depth[v], root[v] = d, r
            for e in range(at[v], at[v + 1]):
                if depth[to[e]] < 0:
                    heapq.heappush(heap, (d + steps[e], r, to[e]))
    # Strongly connected components, by one depth-first search without recursion.
    index, low, ring, held, stack, clock = [0] * n, [0] * n, [None] * n, [False] * n, [], 0
    for begin in range(n):
        if index[begin]:
            continue
        work = [(begin, at[begin])]
        clock += 1
        index[begin] = low[begin] = clock
        stack.append(begin)
        held[begin] = True
        while work:
            v, e = work.pop()
            if e < at[v + 1]:
                work.append((v, e + 1))
                w = to[e]
                if not index[w]:
                    clock += 1
                    index[w] = low[w] = clock
                    stack.append(w)
                    held[w] = True
                    work.append((w, at[w]))
                elif held[w]:
                    low[v] = min(low[v], index[w])
                continue
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
            if low[v] == index[v]:
                component = []
                while not component or component[-1] != v:
                    component.append(stack.pop())
                    held[component[-1]] = False
                if len(component) > 1 or v in to[at[v] : at[v + 1]]:
                    label = min(name[x] for x in component)
                    for x in component:
                        ring[x] = label
    return pa.table({"anchor": names, "depth": pa.array([d if d >= 0 else None for d in depth], pa.int64()), "root": pa.array(root, pa.string()), "ring": pa.array(ring, pa.string())})


def _nearest(ways: DataFrame) -> DataFrame:
    """(anchor, depth, root): the smallest depth and, among equals, root id of every anchor below a root, by rounds over the ways."""
    ways = stage(ways)
    best = F.struct(F.lit(0).cast("long").alias("depth"), F.col("src").alias("root"))
    found = _Loop(ways.where("top").select(F.col("src").alias("anchor"), best.alias("best"), F.lit(True).alias("new")).distinct(), new=F.count(F.when(F.col("new"), 1)))
    while found.seen["new"]:
        t = found.df
        offers = t.where("new").join(ways.withColumnRenamed("src", "anchor"), "anchor").select(F.col("dst").alias("anchor"), F.struct((F.col("best.depth") + F.col("steps")).alias("depth"), F.col("best.root").alias("root")).alias("offer")).groupBy("anchor").agg(F.min("offer").alias("offer"))
        found.replace(t.join(offers, "anchor", "full").select("anchor", F.least("best", "offer").alias("best"), F.coalesce(F.col("best").isNull() | (F.col("offer") < F.col("best")), F.lit(False)).alias("new")))
    return found.df.select("anchor", "best.depth", "best.root")


def _sibling_offsets(tree: DataFrame) -> DataFrame:
    """(node, off): 1 and the sizes of the siblings before a node; tree has node, parent, pos, size.

    Siblings are in the order of their places; more than SIBLINGS of one parent are cut into runs of
    4096 places, crowded runs further by hash, with prefix sums over the runs.
    """
    run = tree.withColumn("run", F.floor(F.col("pos") / 4096))
    crowded = run.groupBy("parent", "run").agg(F.count("*").alias("crowd")).where(F.col("crowd") > SIBLINGS)
    run = run.join(crowded, ["parent", "run"], "left")
    run = run.withColumn("part", F.when(F.col("crowd").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("crowd") / (SIBLINGS // 2)))))
    sums = run.groupBy("parent", "run", "part").agg(F.sum("size").alias("total"))
    before = sums.withColumn("base", F.coalesce(F.sum("total").over(Window.partitionBy("parent").orderBy("run", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("parent", "run", "part").orderBy("pos", "node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return run.withColumn("inside", inside).join(before, ["parent", "run", "part"]).select("node", (1 + F.col("base") + F.col("inside")).alias("off"))


def _sum_up(tree: DataFrame, weights: dict[str, str]) -> DataFrame:
    """Sums of the weight columns over every node's subtree; tree has node, parent, depth and the weights' columns.

    In the round of steps of 2^k each node has the sum of its descendants less than 2^k below; it
    gets those less than 2^(k+1) below from the nodes exactly 2^k below.
    """

    def doubled(t: DataFrame, step: int) -> DataFrame:
        given = t.where(F.col("depth") >= step).groupBy("up").agg(*(F.sum(c).alias(f"{c}_below") for c in weights)).withColumnRenamed("up", "node")
        above = t.where(F.col("depth") >= step).select(F.col("node").alias("up"), F.col("up").alias("up2"))
        t = t.join(given, "node", "left").join(above, "up", "left")
        return t.select("node", "depth", F.col("up2").alias("up"), *((F.col(c) + F.coalesce(f"{c}_below", F.lit(0))).alias(c) for c in weights))

    loop = _Loop(tree.select("node", "depth", F.col("parent").alias("up"), *(F.col(w).alias(c) for c, w in weights.items())), deepest=F.max("depth"))
    step = 1
    while step <= (loop.seen["deepest"] or 0):
        loop.replace(doubled(doubled(loop.df, step), 2 * step))
        step *= 4
    return loop.df.select("node", *weights)


def _sum_down(tree: DataFrame, weights: list[str], paths: bool = False) -> DataFrame:
    """Sums of the columns over the way from below the root to every node, and the way itself if asked for."""
    extra = [F.array("node").alias("path")] if paths else []
    loop = _Loop(tree.select("node", "depth", F.col("parent").alias("up"), *weights, *extra), deepest=F.max("depth"))
    step = 1
    while step <= (loop.seen["deepest"] or 0):
        t = loop.df
        above = t.select(F.col("node").alias("up"), F.col("up").alias("up2"), *(F.col(c).alias(f"{c}_up") for c in weights), *([F.col("path").alias("path_up")] if paths else []))
        more = t.where(F.col("depth") >= step).join(above, "up")
        longer = [F.concat("path_up", "path").alias("path")] if paths else []
        loop.replace(t.where(F.col("depth") < step).unionByName(more.select("node", "depth", F.col("up2").alias("up"), *((F.col(c) + F.col(f"{c}_up")).alias(c) for c in weights), *longer)))
        step *= 2
    return loop.df.select("node", *weights, *(["path"] if paths else []))


def _spread(links: DataFrame, state: DataFrame, source: str, target: str) -> DataFrame:
    """(node, label): the greatest label among the nodes of state that lead to a node along links."""
    loop = _Loop(state.select("node", "label", F.lit(True).alias("new")), new=F.count(F.when(F.col("new"), 1)))
    while loop.seen["new"]:
        t = loop.df
        sent = links.select(F.col(source).alias("node"), F.col(target).alias("to")).join(t.where("new").select("node", "label"), "node").select(F.col("to").alias("node"), "label")
        both = t.select("node", "label", F.col("label").alias("old")).unionByName(sent.withColumn("old", F.lit(None).cast("string")))
        grown = both.groupBy("node").agg(F.max("label").alias("label"), F.max("old").alias("old"))
        loop.replace(grown.select("node", "label", (F.col("old").isNull() | (F.col("label") > F.col("old"))).alias("new")))
    return loop.df.select("node", "label")


def _trim(links: DataFrame) -> _Loop:
    """Links without those at the ends of chains."""
    rest = _Loop(links, left=F.count(F.lit(1)))
    left = -1
    while rest.seen["left"] != left:
        left = rest.seen["left"]
        e = rest.df
        inner = e.join(e.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").join(e.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        rest.replace(inner.select("parent", "child"))
    return rest


def components(links: DataFrame) -> DataFrame:
    """(node, ring): nodes that can be reached from themselves along links (parent, child), with a name of their strongly connected component.

    Ends of chains are trimmed round by round, from both sides.  Of what is left every node takes
    the greatest id that leads to it as its colour; nodes that lead back to the node their colour is
    named after, within the colour, form a component.  Those leave, and the rest is treated again.
    """
    loops = links.where("parent = child").select(F.col("child").alias("node"), F.col("child").alias("ring")).distinct()
    found = None
    rest = links.where("parent <> child").select("parent", "child")
    while True:
        trimmed = _trim(rest)
        if not trimmed.seen["left"]:
            break
        e = trimmed.df
        every = e.select(F.col("parent").alias("node")).union(e.select("child")).distinct()
        colours = _spread(e, every.select("node", F.col("node").alias("label")), "parent", "child")
        inside = stage(
            e.join(colours.select(F.col("node").alias("parent"), F.col("label").alias("a")), "parent").join(colours.select(F.col("node").alias("child"), F.col("label").alias("b")), "child").where("a = b").select("parent", "child", F.col("a").alias("ring"))
        )
        back = _spread(inside, colours.where("node = label"), "child", "parent").select("node")
        # A component of one node has no links inside, for those to itself have been taken out.
        ring = inside.join(back.withColumnRenamed("node", "parent"), "parent", "left_semi").join(back.withColumnRenamed("node", "child"), "child", "left_semi")
        part = stage(ring.select(F.col("child").alias("node"), "ring").distinct())
        found = part if found is None else found.union(part)
        rest = e.join(back.withColumnRenamed("node", "parent"), "parent", "left_anti").join(back.withColumnRenamed("node", "child"), "child", "left_anti")
    return loops if found is None else found.union(loops.join(found, "node", "left_anti"))


def nested_sets(forest: DataFrame) -> DataFrame:
    """(node, root, depth, parent, pre, size) of a forest (node, root, depth, parent, pos).

    Below a root the nodes have 0 ... as pre; a node's descendants are those with pre + 1 ... pre + size - 1.
    """
    t = stage(forest.withColumn("one", F.lit(1).cast("long")))
    t = stage(t.join(_sum_up(t, {"size": "one"}), "node"))
    offs = _sibling_offsets(t.where("parent is not null").select("node", "parent", "pos", "size"))
    t = stage(t.join(offs, "node", "left").fillna(0, ["off"]))
    return stage(t.select("node", "root", "depth", "parent", "size").join(_sum_down(t, ["off"]).withColumnRenamed("off", "pre"), "node"))


def within(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """Rows of ranges (root, pre, size, ...) with every row of points (root, at, ...) whose place lies in the range.

    A range is cut into its binary blocks, two of each length at most, and a point belongs to one
    block of each length; so they meet by equality, once.
    """
    cut = F.expr(
        "filter(flatten(transform(sequence(0, cast(log2(size) as int)), k -> array("
        "  case when shiftright(pre + shiftleft(1L, k) - 1, k) < shiftright(pre + size, k) and shiftright(pre + shiftleft(1L, k) - 1, k) % 2 = 1 then struct(k, shiftright(pre + shiftleft(1L, k) - 1, k) as block) end,"
        "  case when shiftright(pre + shiftleft(1L, k) - 1, k) < shiftright(pre + size, k) and shiftright(pre + size, k) % 2 = 1 then struct(k, shiftright(pre + size, k) - 1 as block) end"
        "))), x -> x is not null)"
    )
    blocks = ranges.withColumn("_x", F.explode(cut)).select(*ranges.columns, F.col("_x.k").alias("_k"), F.col("_x.block").alias("_block"))
    most = ranges.groupBy("root").agg(F.max("size").alias("_most"))
    places = points.join(most, "root").withColumn("_x", F.explode(F.expr("transform(sequence(0, cast(log2(_most) as int)), k -> struct(k, shiftright(at, k) as block))")))
    places = places.select("root", *(c for c in points.columns if c != "root"), F.col("_x.k").alias("_k"), F.col("_x.block").alias("_block"))
    return blocks.join(places, ["root", "_k", "_block"]).drop("_k", "_block")


class Hierarchy:
    """Trees, nearest roots and cycles over the links of a table of nodes.

    nodes may have several rows for a node, whose children are then the union; null nodes, null lists
    and null or unknown entries are left out, repeated ones count once; other columns are not looked
    at.  An empty table gives an empty hierarchy.
    """

    def __init__(self, nodes: DataFrame, node: str = "node_id", children: str = "children_ids") -> None:
        self.ids, self.links = edges(nodes, node, children)
        anchored = _anchored(self.ids, self.links)
        child = anchored.select(F.col("node").alias("child"), (F.col("anchor") == F.col("node")).alias("way"))
        above = anchored.select(F.col("node").alias("parent"), F.col("anchor").alias("src"), F.col("dist").alias("foot"))
        tops = anchored.where("top").select(F.col("node").alias("src"), F.lit(True).alias("src_top"))
        written = Stage(self.links.join(child, "child").join(above, "parent"), ways=F.count(F.when(F.col("way"), 1)))
        self.ways = written.df.where("way").select("parent", F.col("child").alias("dst"), "src", (F.col("foot") + 1).alias("steps"))
        ways = self.ways.groupBy("src", "dst").agg(F.min("steps").alias("steps")).join(tops, "src", "left").select("src", "dst", "steps", F.coalesce("src_top", F.lit(False)).alias("top"))
        if written.seen["ways"] <= KERNEL:
            solved = ways.groupBy(F.lit(0).alias("one")).applyInArrow(_solved, "anchor string, depth long, root string, ring string")
        else:
            ends = ways.select(F.col("src").alias("anchor")).union(ways.select("dst")).distinct()
            rings = components(stage(ways.select(F.col("src").alias("parent"), F.col("dst").alias("child")))).withColumnRenamed("node", "anchor")
            solved = ends.join(_nearest(ways), "anchor", "left").join(rings, "anchor", "left").select("anchor", "depth", "root", "ring")
        self.solved = stage(solved)
        tree = written.df.where("not way").select(F.col("child").alias("node"), "parent", "pos")
        # Anchors that no way leads to or from are roots.
        near = self.solved.select("anchor", F.struct("depth", "root").alias("near"))
        joined = anchored.join(tree, "node", "left").join(near, "anchor", "left")
        base = F.when(F.col("near").isNull(), F.struct(F.lit(0).cast("long").alias("depth"), F.col("anchor").alias("root"))).otherwise(F.col("near"))
        self.placed = stage(joined.withColumn("near", base).select("node", "anchor", "dist", "parent", "pos", F.col("near.root").alias("root"), (F.col("near.depth") + F.col("dist")).alias("depth")))
        self._ranges: DataFrame | None = None

    def ranges(self) -> DataFrame:
        """(node, root, depth, parent, pre, size) in the trees of the anchors: root is the anchor, depth the links from it."""
        if self._ranges is None:
            self._ranges = nested_sets(self.placed.select("node", F.col("anchor").alias("root"), F.col("dist").alias("depth"), "parent", "pos"))
        return self._ranges

    def cycles(self) -> DataFrame:
        """(node): the nodes on cycles: those in whose range the foot of a way lies that leads to an anchor of the same strongly connected component."""
        ring = self.solved.where("ring is not null").select("anchor", "ring")
        inner = self.ways.join(ring.withColumnsRenamed({"anchor": "src", "ring": "a"}), "src").join(ring.withColumnsRenamed({"anchor": "dst", "ring": "b"}), "dst").where("a = b")
        feet = Stage(inner.select(F.col("parent").alias("node"), F.col("src").alias("root")).distinct(), n=F.count(F.lit(1)))
        if not feet.seen["n"]:
            return feet.df.select("node")
        ranges = self.ranges()
        points = feet.df.join(ranges.select("node", F.col("pre").alias("at")), "node").select("root", "at")
        return within(ranges.select("node", "root", "pre", "size"), points).select("node").distinct()

    def found(self) -> DataFrame:
        """(node_id, root_id, node_depth, on_cycle), a row for every node; below no root '' and -1."""
        t = self.placed.join(self.cycles().withColumn("ring", F.lit(1)), "node", "left")
        return t.select(F.col("node").alias("node_id"), F.coalesce("root", F.lit("")).alias("root_id"), F.coalesce("depth", F.lit(-1)).cast("int").alias("node_depth"), F.coalesce("ring", F.lit(0)).alias("on_cycle"))

    def shortest(self) -> DataFrame:
        """(node, root, depth, parent, pos): the forest of shortest ways from roots; of several parents on such ways the least."""
        at = self.placed.select("node", "root", "depth").where("root is not null")
        ends = self.links.join(at.withColumnsRenamed({"node": "child", "root": "r", "depth": "d"}), "child").join(at.withColumnsRenamed({"node": "parent", "root": "pr", "depth": "pd"}), "parent")
        chosen = ends.where("r = pr and d = pd + 1").groupBy("child").agg(F.min_by(F.struct("parent", "pos"), "parent").alias("by")).select(F.col("child").alias("node"), "by.parent", "by.pos")
        return stage(at.join(chosen, "node", "left"))

    def table(self, paths: bool = False) -> DataFrame:
        """(node_id, root_id, node_depth, parent_id, pre, size, on_cycle), a row for every node, parent and range being those in the forest of shortest ways; below no root '' and -1, and nulls.

        With paths also `path`, the ids from the root to the node.
        """
        forest = self.shortest()
        t = self.found().join(nested_sets(forest).select(F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), "pre", "size"), "node_id", "left")
        if paths:
            t = t.join(_sum_down(forest, [], paths=True).withColumnRenamed("node", "node_id"), "node_id", "left")
        return t.select("node_id", "root_id", "node_depth", "parent_id", "pre", "size", "on_cycle", *(["path"] if paths else []))

    def descendants(self) -> DataFrame:
        """(node, descendant): all nodes that a node leads to, itself only if it is on a cycle.

        In its tree they are the nodes in its range.  A way whose foot is in the range, or the node
        itself, adds the tree of its head and of all anchors that leads to, which are found by
        joining pairs of anchors until no new one comes up, with ways twice as long in every round.
        """
        ranges = self.ranges()
        own = ranges.select("node", "root", "pre", "size")
        inside = within(own, ranges.select("root", F.col("pre").alias("at"), F.col("node").alias("descendant"))).where("node <> descendant").select("node", "descendant")
        reach = _Loop(self.ways.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), n=F.count(F.lit(1)))
        before = -1
        while reach.seen["n"] != before:
            before = reach.seen["n"]
            t = reach.df
            reach.replace(t.union(t.select("a", F.col("b").alias("m")).join(t.select(F.col("a").alias("m"), "b"), "m").select("a", "b")).distinct())
        feet = self.ways.select(F.col("parent").alias("foot"), "dst").join(ranges.select(F.col("node").alias("foot"), "root", F.col("pre").alias("at")), "foot").select("root", "at", "dst")
        heads = stage(within(own, feet).select("node", F.col("dst").alias("head")).distinct())
        further = heads.join(reach.df.select(F.col("a").alias("head"), F.col("b")), "head").select("node", F.col("b").alias("head"))
        trees = ranges.select(F.col("root").alias("head"), F.col("node").alias("descendant"))
        outside = heads.union(further).distinct().join(trees, "head").select("node", "descendant")
        return inside.union(outside).distinct()
