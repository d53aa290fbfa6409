"""What is asked of a routed graph: contexts, transitions, and reads followed along their edges.

A context is one read at one tail of one node: (node, dir, side, bases, edge_pos), edge_pos being its place among the reads of
that direction over that tail. With direction F a read comes in by side P and goes out by S, with R the other way round.
All calls take any number of contexts as a DataFrame and keep its other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import K, revcomp, unpack
from .routing import own_bases

#: Most steps that a read is followed, down and up.
DOWN_STEPS, UP_STEPS = 2000, 1000
CONTEXT = ["node", "dir", "side", "bases", "edge_pos"]


def side_of(upstream: bool) -> Column:
    """The side on which a read of column dir comes in, or goes out."""
    return F.when((F.col("dir") == "F") == F.lit(upstream), "P").otherwise("S")


def contexts(positions: DataFrame, upstream: bool = True) -> DataFrame:
    """A context for each route at its tail before (or after), with its node_pos."""
    bases, pos = ("up_tail", "up_pos") if upstream else ("down_tail", "down_pos")
    return positions.select("node", "dir", side_of(upstream).alias("side"), F.col(bases).alias("bases"), F.col(pos).alias("edge_pos"), "node_pos")


def spanning_contexts(positions: DataFrame) -> DataFrame:
    """Both contexts of each route: prefix and suffix tail with the places there."""
    forward = F.col("dir") == "F"
    pick = lambda a, b, name: F.when(forward, F.col(a)).otherwise(F.col(b)).alias(name)
    return positions.select("node", "dir", "node_pos", pick("up_tail", "down_tail", "prefix"), pick("up_pos", "down_pos", "prefix_pos"), pick("down_tail", "up_tail", "suffix"), pick("down_pos", "up_pos", "suffix_pos"))


def end_contexts(positions: DataFrame, targets: DataFrame, start: bool = True, end: bool = True) -> DataFrame:
    """Contexts at which reads start or end: at no tail (idx 0), or at one that leads to no node."""
    known = targets.select("node", "side", "bases", "idx", "linked")

    def open_at(upstream: bool) -> DataFrame:
        out = contexts(positions, upstream).join(known, ["node", "side", "bases"], "left").where("bases = '' or linked = 0")
        return out.select("node", "dir", "node_pos", "side", "bases", "edge_pos", F.coalesce("idx", F.lit(0)).alias("idx"))

    parts = [open_at(up) for up, wanted in ((True, start), (False, end)) if wanted]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def across_node(asked: DataFrame, positions: DataFrame, downstream: bool = True) -> DataFrame:
    """Contexts moved over their node, with the read (or against it): from the tail it comes in by to that it goes out by.
    Contexts on the wrong side for the direction have no result."""
    here = contexts(positions, downstream)
    there = contexts(positions, not downstream).select("node", "dir", "node_pos", F.col("side").alias("to_side"), F.col("bases").alias("to_bases"), F.col("edge_pos").alias("to_pos"))
    rest = [c for c in asked.columns if c not in (*CONTEXT, "node_pos")]
    moved = asked.drop("node_pos").join(here, CONTEXT).join(there, ["node", "dir", "node_pos"])
    return moved.select("node", "dir", F.col("to_side").alias("side"), F.col("to_bases").alias("bases"), F.col("to_pos").alias("edge_pos"), "node_pos", *rest)


def transitions(positions: DataFrame) -> DataFrame:
    """`across_node` of the contexts of all routes, from the tail before: with from_bases and the place of the route (asked_pos)."""
    return positions.select("node", "dir", F.col("node_pos").alias("asked_pos"), F.col("up_tail").alias("from_bases"), side_of(False).alias("side"), F.col("down_tail").alias("bases"), F.col("down_pos").alias("edge_pos"))


def to_linking_edge(asked: DataFrame, linked: DataFrame) -> DataFrame:
    """Contexts moved along their tail to the node that it leads to: the far tail, the same place, and the direction there (the
    other one where the nodes' orientations differ). linked: edges (node, side, bases, target, linked, far_side, far_bases).
    Contexts at no tail or at one without a link have no result."""
    rest = [c for c in asked.columns if c not in (*CONTEXT, "node_pos")]
    turned = F.when(F.col("linked") > 0, F.col("dir")).when(F.col("dir") == "F", "R").otherwise("F")
    moved = asked.join(linked.select("node", "side", "bases", "target", "linked", "far_side", "far_bases"), ["node", "side", "bases"])
    return moved.select(F.col("target").alias("node"), turned.alias("dir"), F.col("far_side").alias("side"), F.col("far_bases").alias("bases"), "edge_pos", *rest)


def extracted(asked: DataFrame, with_node: bool = False, k: int = K) -> DataFrame:
    """Contexts with seq: the bases of their tail as the read shows them, and those of the node, if asked for, in the read's order."""
    coming = F.col("side") == side_of(True)
    tail = F.when(coming, revcomp(F.col("bases"))).otherwise(F.col("bases"))
    if not with_node:
        return asked.withColumn("seq", tail)
    own = F.when(F.col("dir") == "F", unpack(F.col("node"), k)).otherwise(revcomp(unpack(F.col("node"), k)))
    return asked.withColumn("seq", F.when(coming, F.concat(tail, own)).otherwise(F.concat(own, tail)))


def route_lists(runs: DataFrame, targets: DataFrame, limit: int) -> DataFrame:
    """(node, total, routes): the runs of each node with their tails' numbers, in order, by direction; null where the node has
    more than `limit` routes (or the limit is not above 0)."""
    number = lambda upstream, name: targets.select("node", F.col("side").alias(f"{name}_side"), F.col("bases").alias(f"{name}_tail"), F.col("idx").alias(f"{name}_idx"))
    totals = runs.groupBy("node").agg(F.sum("width").alias("total"))
    few = runs.join(totals.where((F.col("total") <= limit) & F.lit(limit > 0)), "node").withColumns({"up_side": side_of(True), "down_side": side_of(False)})
    named = few.join(number(True, "up"), ["node", "up_side", "up_tail"], "left").join(number(False, "down"), ["node", "down_side", "down_tail"], "left")
    prefix, suffix = (F.coalesce(F.when(F.col("dir") == d, F.col("up_idx")).otherwise(F.col("down_idx")), F.lit(0)) for d in ("F", "R"))
    lists = named.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("dir", "run", prefix.alias("prefix"), suffix.alias("suffix"), "width"))).alias("routes"))  # at most `limit`
    return totals.join(lists, "node", "left")


def _traced(asked: DataFrame, positions: DataFrame, trace: DataFrame, upstream: bool) -> DataFrame:
    """Contexts (numbered by `asked_id`) with the read they are on (its first route) and their place there."""
    here = contexts(positions, upstream).join(trace, ["node", "dir", "node_pos"])
    return asked.join(here.drop("node_pos"), CONTEXT).withColumnRenamed("place", "from_place")


START = ["start_node", "start_dir", "start_pos"]


def followed(asked: DataFrame, positions: DataFrame, trace: DataFrame, tags: DataFrame | None = None, most: int = DOWN_STEPS) -> DataFrame:
    """asked: contexts at tails that reads come in by, each with an asked_id. For each: the steps followed, the bases from its
    tail to the end of the read (or of `most` steps), and the tag of the read, if the end was reached."""
    at = _traced(asked.select("asked_id", *CONTEXT), positions, trace, True)
    onward = trace.join(positions.select("node", "dir", "node_pos", "down_tail"), ["node", "dir", "node_pos"]).select(*START, "place", "down_tail", F.col("node").alias("at_node"), F.col("dir").alias("at_dir"), "node_pos")
    ahead = at.join(onward, START).where((F.col("place") >= F.col("from_place")) & (F.col("place") < F.col("from_place") + most))
    joined = ahead.groupBy("asked_id", "node", "dir", "side", "bases", "edge_pos").agg(F.sort_array(F.collect_list(F.struct("place", "down_tail", "at_node", "at_dir", "node_pos"))).alias("p"))  # a read's own
    last = F.element_at("p", -1)
    out = joined.select("asked_id", F.size("p").alias("steps"), F.concat(revcomp(F.col("bases")), own_bases(), F.array_join("p.down_tail", "")).alias("seq"), last["at_node"].alias("node"), last["at_dir"].alias("dir"), last["node_pos"].alias("node_pos"))
    if tags is None:
        return out.drop("node", "dir", "node_pos")
    return out.join(tags, ["node", "dir", "node_pos"], "left").drop("node", "dir", "node_pos")


def followed_upstream(asked: DataFrame, positions: DataFrame, trace: DataFrame, most: int = UP_STEPS) -> DataFrame:
    """asked: contexts at tails that reads come in by, each with an asked_id. For each: the steps back and the tails before, as the
    read shows them, from the nearest to the first, joined by '-'."""
    at = _traced(asked.select("asked_id", *CONTEXT), positions, trace, True)
    back = trace.join(positions.select("node", "dir", "node_pos", "up_tail"), ["node", "dir", "node_pos"]).select(*START, "place", "up_tail")
    behind = at.join(back, START).where((F.col("place") <= F.col("from_place")) & (F.col("place") > F.col("from_place") - most))
    joined = behind.groupBy("asked_id").agg(F.sort_array(F.collect_list(F.struct("place", "up_tail")), asc=False).alias("p"))  # a read's own
    return joined.select("asked_id", F.size("p").alias("steps"), F.array_join(F.transform("p.up_tail", revcomp), "-").alias("seq"))


def followed_once(asked: DataFrame, positions: DataFrame, linked: DataFrame) -> DataFrame:
    """Contexts at tails that reads come in by, moved over their node and along the next edge, and whether going back from there
    leads to the same context."""
    marked = asked.select("asked_id", *CONTEXT, F.struct(*CONTEXT).alias("asked_from"))
    there = to_linking_edge(across_node(marked, positions), linked)
    returned = across_node(to_linking_edge(there.withColumn("reached", F.struct(*CONTEXT)), linked), positions, downstream=False)
    same = F.struct(*CONTEXT) == F.col("asked_from")
    return returned.select("asked_id", *[F.col(f"reached.{c}").alias(c) for c in CONTEXT], same.alias("returns"))


def tag_counts(trace: DataFrame, tags: DataFrame) -> DataFrame:
    """(reads, with_tag, without_tag): reads that can be walked, and how many of them end at a tag."""
    first = trace.where("place = 0").agg(F.count("*").alias("reads"))
    held = tags.join(trace, ["node", "dir", "node_pos"]).select(*START).distinct().agg(F.count("*").alias("with_tag"))
    return first.join(F.broadcast(held)).select("reads", "with_tag", (F.col("reads") - F.col("with_tag")).alias("without_tag"))


def validation(targets: DataFrame, linked: DataFrame, runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(check, violations): tails of no node, tails that a node has twice, runs over a tail that its node doesn't have, edges
    without a tail at the far end, edges whose widths differ at the far end."""
    tails = targets.select("node", "side", "bases")
    used = runs.select("node", side_of(True).alias("side"), F.col("up_tail").alias("bases")).unionByName(runs.select("node", side_of(False).alias("side"), F.col("down_tail").alias("bases"))).where("bases <> ''")
    far = tails.select(F.col("node").alias("target"), F.col("side").alias("far_side"), F.col("bases").alias("far_bases"))
    width = lambda node, side, bases, f, r: targets.select(F.col("node").alias(node), F.col("side").alias(side), F.col("bases").alias(bases), F.col("forward").alias(f), F.col("reverse").alias(r))
    both = linked.join(width("node", "side", "bases", "f", "r"), ["node", "side", "bases"]).join(width("target", "far_side", "far_bases", "ff", "fr"), ["target", "far_side", "far_bases"])
    swapped = "(linked > 0 and (f <> ff or r <> fr)) or (linked < 0 and (f <> fr or r <> ff))"
    parts = {
        "tail_without_node": tails.join(nodes, "node", "left_anti"),
        "tail_twice": tails.groupBy("node", "side", "bases").count().where("count > 1"),
        "route_without_tail": used.join(tails, ["node", "side", "bases"], "left_anti"),
        "edge_without_far_tail": linked.join(far, ["target", "far_side", "far_bases"], "left_anti"),
        "edge_width": both.where(swapped),
    }
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.unionByName(one)
    return out
