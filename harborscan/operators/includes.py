"""The graph of manifests that include each other: cycles of any length, files reached as constraints only.

Edges are (path, target): one row for each include line. Both walks are rounds of joins over tables in the shared folder.
Tables that may be large are joined by sorting and never sent to all tasks, small as their files may look: only a round's
few fresh rows are, up to a fixed number, so that the driver's share is bounded for each round.
"""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from harborscan.functions.scratch import stored


#: Rows of a table that may be sent to all tasks.
FEW = 20_000
#: Edges that one task walks by itself, about; and rounds of merging, after which parts of the graph stay apart.
BLOCK, MERGES = 200_000, 24


def _large(df: DataFrame, n: int) -> DataFrame:
    """df, of about ``n`` rows at most: joined by sorting unless they are few."""
    return df if n <= FEW else df.hint("merge")


def _fresh(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= FEW else df.hint("merge")


def _inner(edges: DataFrame, n: int) -> DataFrame:
    """The edges whose path is a target and whose target is a path: no other edge lies on a cycle."""
    return edges.join(_large(edges.select(F.col("target").alias("path")).distinct(), n), "path", "left_semi").join(_large(edges.select(F.col("path").alias("target")).distinct(), n), "target", "left_semi").select("path", "target")


def _coloured(edges: DataFrame, size: int) -> DataFrame:
    """node, colour: the greatest name that leads to the node, its own included. Only nodes whose colour changed go on."""
    nodes = edges.select(F.col("path").alias("node")).unionAll(edges.select("target")).distinct()
    colours = stored(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("fresh")), "colours")
    while n := colours.where("fresh").count():
        came = _fresh(colours.where("fresh"), n).join(edges, F.col("node") == F.col("path")).groupBy(F.col("target").alias("node")).agg(F.max("colour").alias("came"))
        better = F.coalesce(F.col("came") > F.col("colour"), F.lit(False))
        colours = stored(colours.join(_large(came, size), "node", "left").select("node", F.greatest("colour", "came").alias("colour"), better.alias("fresh")), "colours")
    return colours.select("node", "colour")


def _backward(edges: DataFrame, roots: DataFrame, size: int) -> DataFrame:
    """node, colour of all nodes that lead to a root of their colour: the roots' components. edges: path, target, colour."""
    found = fresh = stored(roots, "leading")
    while n := fresh.count():
        step = edges.join(_fresh(fresh, n), (edges["target"] == fresh["node"]) & (edges["colour"] == fresh["colour"])).select(edges["path"].alias("node"), edges["colour"]).distinct()
        fresh = stored(step.join(_large(found, size), ["node", "colour"], "left_anti"), "leading")
        found = found.unionAll(fresh)
    return found


def cycles(edges: DataFrame) -> DataFrame:
    """path, cycle (the smallest path of its strongly connected component), n_files: every file that includes itself over
    any number of steps.

    Edges that can't lie on a cycle are trimmed. Then each node takes the greatest name that leads to it; the nodes of one
    such colour that lead back to the colour's own node are its component, at least one a colour. They leave, as do edges
    between colours, and the rest is coloured anew. No pair of nodes that merely reach each other is ever listed, so the
    work of a round is in proportion to the edges; rounds follow the length of paths. Null ends are no edges, repeated
    edges are one, and a file that includes itself directly is a cycle of one unless it is in a longer one.
    """
    once = stored(edges.select("path", "target").where("path IS NOT NULL AND target IS NOT NULL").distinct(), "includes")
    most = once.count()
    alone = once.where("path = target").select("path")
    left, parts = once.where("path <> target"), []
    while True:
        n, size, trimmed = None, left.count(), left
        while n is None or size < n:
            left, n = trimmed, size
            trimmed = stored(_inner(left, n), "trimmed")
            size = trimmed.count()
        left = trimmed
        if left.isEmpty():
            break
        colours = _coloured(left, n)
        own, other = colours.toDF("path", "colour"), colours.toDF("target", "__colour")
        within = stored(left.join(_large(own, n), "path").join(_large(other, n), "target").where("colour = __colour").select("path", "target", "colour"), "within")
        part = stored(_backward(within, colours.where("node = colour"), n), "components")
        parts.append(part)
        gone = part.select("node")
        left = stored(within.select("path", "target").join(_large(gone.toDF("path"), n), "path", "left_anti").join(_large(gone.toDF("target"), n), "target", "left_anti"), "left")
    whole = alone.select(F.col("path").alias("node"), F.lit(None).cast("string").alias("colour"), F.lit(0).alias("n")).limit(0)
    for part in parts:  # a colour names one component: its node is in no other
        whole = whole.unionAll(part.join(_large(part.groupBy("colour").agg(F.count("*").alias("n")), most), "colour").where("n > 1").select("node", "colour", "n"))
    names = whole.groupBy("colour").agg(F.min("node").alias("cycle"))
    longer = whole.join(_large(names, most), "colour").select(F.col("node").alias("path"), "cycle", F.col("n").cast("long").alias("n_files"))
    single = alone.join(_large(longer.select("path"), most), "path", "left_anti").select("path", F.col("path").alias("cycle"), F.lit(1).cast("long").alias("n_files"))
    return longer.unionAll(single)


def reached(files: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """path, constraint_only, depth of the files that roots include over any number of steps, or over ``max_depth`` at most.

    edges: path, target, constraint_only. A file is read at most twice: as requirements, and as constraints only, which all
    files below a constraints file are. Each state counts once, at its least depth; null flags are false. Each step is a
    round of joins: ``reachable`` has the same states without their depths, in far fewer rounds where paths are long.
    """
    state = ["path", "constraint_only"]
    known = stored(files.select("path").distinct(), "files")
    most = known.count()
    steps = stored(edges.select("path", "target", F.coalesce("constraint_only", F.lit(False)).alias("__only")).where("target IS NOT NULL").distinct(), "includes")
    seen = fresh = stored(roots.select("path").distinct().join(_large(known, most), "path", "left_semi").select("path", F.lit(False).alias("constraint_only"), F.lit(0).cast("long").alias("depth")), "reached")
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = _fresh(fresh, fresh.count()).join(steps, "path").select(F.col("target").alias("path"), (F.col("constraint_only") | F.col("__only")).alias("constraint_only")).distinct()
        fresh = stored(step.join(_large(known, most), "path", "left_semi").join(_large(seen, most), state, "left_anti").select(*state, F.lit(depth).cast("long").alias("depth")), "reached")
        if fresh.isEmpty():
            break
        seen = seen.unionAll(fresh)
    return seen


def _parts(edges: DataFrame) -> DataFrame | None:
    """id, part: nodes that edges connect mostly share a part. Both are hashes of names; null if there are no edges.

    In a round every part joins its least neighbour, and what they point to in turn; hashes keep such ways short. Parts then
    are at most half as many. Whether all of a component meet before the rounds end touches the work only, not what is reached.
    """
    a, b = F.xxhash64("path").alias("a"), F.xxhash64("target").alias("b")
    pairs, maps = stored(edges.select(a, b).unionAll(edges.select(b.alias("a"), a.alias("b"))).where("a <> b").distinct(), "pairs"), []
    while (n := pairs.count()) and len(maps) < MERGES:
        hook = stored(pairs.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("to")), "hooks")
        for _ in range(2):
            hook = hook.join(_large(hook.select(F.col("a").alias("to"), F.col("to").alias("__to")), n), "to").select("a", F.col("__to").alias("to"))
        hook = stored(hook, "hooks")
        maps.append((hook, n))
        ends = pairs.join(_large(hook, n), "a").select(F.col("to").alias("x"), F.col("b").alias("a")).join(_large(hook, n), "a")
        pairs = stored(ends.select(F.col("x").alias("a"), F.col("to").alias("b")).where("a <> b").distinct(), "pairs")
    whole = None
    for hook, n in reversed(maps):
        here = hook.select(F.col("a").alias("id"), F.col("to").alias("part"))
        whole = here if whole is None else here.join(_large(whole.select(F.col("id").alias("part"), F.col("part").alias("__part")), n), "part", "left").select("id", F.coalesce("__part", "part").alias("part"))
    return whole


def _walked(edges: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
    """The new states that the fresh ones of a block lead to along its edges, and those of other blocks that they touch."""
    ways: dict[str, list] = {}
    for path, *way in zip(edges["path"], edges["target"], edges["__only"], edges["to_block"]):
        ways.setdefault(path, []).append(way)
    block = states["block"].iloc[0] if len(states) else None
    known = set(zip(states["path"], states["constraint_only"]))
    left, new = [(p, c) for p, c, fresh in zip(states["path"], states["constraint_only"], states["fresh"]) if fresh], {}
    while left:
        path, only = left.pop()
        for target, flag, to in ways.get(path, ()):
            state = target, only or flag
            if state not in known:
                known.add(state)
                new[state] = to
                if to == block:
                    left.append(state)
    return pd.DataFrame([(to, p, c, to == block) for (p, c), to in new.items()], columns=["block", "path", "constraint_only", "inside"])


def reachable(files: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """path, constraint_only of the files that roots include over any number of steps, each state once: those of ``reached``.

    Edges are dealt into blocks of bounded size: files that includes connect share one where they fit, larger parts are dealt
    by files. A task walks its block to the end, so that rounds follow the steps between blocks and not the length of paths.
    """
    state = ["path", "constraint_only"]
    known = stored(files.select("path").distinct(), "files")
    most = known.count()
    told = edges.select("path", "target", F.coalesce("constraint_only", F.lit(False)).alias("__only")).where("target IS NOT NULL").distinct()
    steps = stored(told.join(_large(known.select(F.col("path").alias("target")), most), "target", "left_semi").join(_large(known, most), "path", "left_semi").select("path", "target", "__only"), "includes")
    start = roots.select("path").distinct().join(_large(known, most), "path", "left_semi").select("path", F.lit(False).alias("constraint_only"))
    n = steps.count()
    n_blocks = max(1, -(-n // BLOCK))
    parts = _parts(steps) if n_blocks > 1 else None
    if parts is None:
        one = F.lit(0).cast("long")
        steps, fresh = steps.withColumns({"block": one, "to_block": one}), start.withColumn("block", one)
    else:
        parts = stored(parts, "parts")
        sizes = steps.select(F.xxhash64("path").alias("id")).join(_large(parts, 2 * n), "id").groupBy("part").agg((F.count("*") > BLOCK).alias("wide"))
        nodes = stored(parts.join(_large(sizes, n), "part", "left").select("id", F.pmod(F.when(F.col("wide"), F.xxhash64("id")).otherwise(F.xxhash64("part")), F.lit(n_blocks)).alias("block")), "blocks")
        nodes = _large(nodes, 2 * n)
        placed = steps.withColumns({"id": F.xxhash64("path"), "to": F.xxhash64("target")}).join(nodes, "id", "left").join(nodes.select(F.col("id").alias("to"), F.col("block").alias("to_block")), "to", "left")
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)  # noqa: E731  # a file that includes only itself
        steps = stored(placed.select(zero("block"), "path", "target", "__only", zero("to_block")), "steps")
        fresh = start.withColumn("id", F.xxhash64("path")).join(nodes, "id", "left").select(*state, zero("block"))
    steps = steps.repartition(n_blocks, "block") if n_blocks > 1 else steps
    seen, fresh = None, stored(fresh.select("block", *state), "fresh")
    while not fresh.isEmpty():
        mine = fresh.withColumn("fresh", F.lit(True))
        mine = mine if seen is None else mine.unionAll(seen.withColumn("fresh", F.lit(False)))
        new = stored(steps.groupBy("block").cogroup(mine.groupBy("block")).applyInPandas(_walked, "block long, path string, constraint_only boolean, inside boolean"), "walked")
        seen = fresh if seen is None else seen.unionAll(fresh)
        seen = seen.unionAll(new.where("inside").drop("inside"))
        if n_blocks == 1:
            break
        fresh = stored(new.where("NOT inside").drop("inside").distinct().join(_large(seen.select(*state), 2 * most), state, "left_anti").select("block", *state), "fresh")
    return fresh.select(*state) if seen is None else seen.select(*state)


def as_read(records: DataFrame, states: DataFrame) -> DataFrame:
    """The records of the files in states, once for each way in which a file is read.

    records: path, version, version_kind, directness, constraint and others. Read as constraints, a pin is no installed
    version: it becomes the constraint ``==version``, and nothing is known of its directness.
    """
    only = F.col("constraint_only")
    pin = F.concat(F.lit("=="), F.when((F.col("version_kind") == "EXACT") & (F.col("version") != ""), F.col("version")))
    changed: dict[str, Column] = {
        "constraint": F.when(only, F.coalesce(pin, "constraint")).otherwise(F.col("constraint")), "version": F.when(~only, F.col("version")),
        "version_kind": F.when(only, "CONSTRAINT").otherwise(F.col("version_kind")), "directness": F.when(only, "UNKNOWN").otherwise(F.col("directness")),
    }
    return records.join(states.select("path", "constraint_only").distinct().hint("merge"), "path").select(*(changed.get(c, F.col(c)).alias(c) for c in records.columns), "constraint_only")
