"""The order of routes, runs of equal routes, and walks.

Within a node and direction, routes are in order of the tails before them (latest first), then those after, then the read, which
is the same order at both ends of each edge. Two reads that leave a node by the same tail come to the same node, so the order is
found by growing ranks: a route's rank by d tails, and those of the steps d, 2d, ... back, give the rank by FAN d tails, and only
routes that are still tied go on. Reads with equal steps are one, with a weight, so copies cost nothing. A rank is the
number of routes before it, a sum over counts that are added up before they meet, in blocks, so that a node with
any number of routes has no task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import packed as P
from ..functions.sequences import K, pack, revcomp, tail_path, target, unpack
from .lineage import by_arrow, cut, dropped

#: Ranks of a block of a running sum.
BLOCK = 1 << 16
#: Times that the tails of a rank grow in a round.
FAN = 16
#: Hops of a pointer in a round: it grows HOPS + 1 times as long.
HOPS = 3
SETTLED, OPEN, TIED = 0, 1, 2
STATE = "read long, weight long, way array<long>, rank array<long>, state array<int>, n_open long, n_tied long"


def sums_before(rows: DataFrame, group: list[str], order: str, weight: str, name: str, first: Column | None = None, block: int = BLOCK) -> DataFrame:
    """rows with the sum of the weights of the rows before it in its group, by `order`. A group is summed in blocks of `first`, a
    long from -1 up that never falls in that order (`order` itself, if not given), and the blocks' sums are put together after."""
    cut_up = rows.withColumn("_block", F.floor(((F.col(order) if first is None else first) + 1) / block))
    blocks = cut_up.groupBy(*group, "_block").agg(F.sum(weight).alias("_sum"))
    behind = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*group, "_block", F.coalesce(F.sum("_sum").over(behind), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = cut_up.withColumn("_own", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return own.join(blocks, [*group, "_block"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_block", "_own", "_before")


def way(node: Column, direction: Column) -> Column:
    """Node and direction as one number."""
    return node * 2 + F.when(direction == "R", 1).otherwise(0)


def with_copies(walked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(read, weight, steps) of reads with different steps (the least read_id stands for its copies), and
    (read_id, read, nth) of all."""
    step = F.struct("ord", way(F.col("node"), F.col("dir")).alias("way"), "up_tail", "down_tail")
    lists = walked.groupBy("read_id").agg(F.sort_array(F.collect_list(step)).alias("steps"))  # a read's own
    digest = F.sha2(F.concat_ws(",", F.transform("steps", lambda s: F.concat_ws(":", s["way"].cast("string"), s["up_tail"], s["down_tail"]))), 256)
    lists = lists.withColumn("digest", digest)
    groups = lists.groupBy("digest").agg(F.min("read_id").alias("read"), F.count("*").alias("weight"))
    # copies in order of read_id
    members = lists.select("read_id", "digest").join(groups.where("weight > 1").select("digest", "read"), "digest")
    nth = F.row_number().over(Window.partitionBy("read").orderBy("read_id")) - 1
    copies = members.select("read_id", "read", nth.cast("long").alias("nth"))
    alone = groups.where("weight = 1").select(F.col("read").alias("read_id"), "read", F.lit(0).cast("long").alias("nth"))
    reads = lists.withColumnRenamed("read_id", "read").join(groups.select("read", "weight"), "read").select("read", "weight", "steps")
    return reads, copies.unionByName(alone)


def _first_ranks(reads: DataFrame) -> DataFrame:
    """The state by one tail back."""
    rows = reads.select("read", "weight", F.explode("steps").alias("s")).select("read", "weight", "s.ord", "s.way", "s.up_tail")
    counts = rows.groupBy("way", "up_tail").agg(F.sum("weight").alias("sum"), F.count("*").alias("n"))
    before = Window.partitionBy("way").orderBy("up_tail").rowsBetween(Window.unboundedPreceding, -1)  # a row for each tail
    counts = counts.withColumn("rank", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    told = rows.join(counts, ["way", "up_tail"]).groupBy("read", "weight").agg(F.sort_array(F.collect_list(F.struct("ord", "way", "rank", F.when(F.col("n") > 1, OPEN).otherwise(SETTLED).alias("state")))).alias("t"))
    n = lambda state: F.size(F.filter("t.state", lambda x: x == state)).cast("long")
    return told.select("read", "weight", F.col("t.way").alias("way"), F.col("t.rank").alias("rank"), F.col("t.state").alias("state"), n(OPEN).alias("n_open"), n(TIED).alias("n_tied"))


def _round(state: DataFrame, kind: int, back: int, first: DataFrame | None = None) -> DataFrame:
    """The state after the routes of a kind (OPEN: by tails before, TIED: by tails after) are told apart by the ranks `back` steps
    before (less than 0: after), twice as far, and so on, or by `first` (read, ord, keys)."""

    def asked(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            sizes = np.diff(batch.column("rank").offsets.to_numpy())
            ways, rank, states = (batch.column(c).flatten().to_numpy() for c in ("way", "rank", "state"))
            read, order = P.owners(sizes)
            begins = np.cumsum(sizes) - sizes
            at = np.flatnonzero(states == kind)
            keys = np.full((len(at), FAN - 1), -1, np.int64)
            for i in range(FAN - 1):
                far = order[at] - back * (i + 1)
                known = np.flatnonzero((far >= 0) & (far < sizes[read[at]]))
                keys[known, i] = rank[begins[read[at[known]]] + far[known]]
            own, weight = batch.column("read").to_numpy(), batch.column("weight").to_numpy()
            listed = pa.ListArray.from_arrays(pa.array((np.arange(len(at) + 1) * (FAN - 1)).astype(np.int32)), pa.array(keys.ravel()))
            yield {"read": own[read[at]], "weight": weight[read[at]], "ord": order[at], "way": ways[at], "rank": rank[at], "keys": listed}

    rows = by_arrow(state.where("n_open > 0" if kind == OPEN else "n_tied > 0"), asked, "read long, weight long, ord int, way long, rank long, keys array<long>")
    if first is not None:
        rows = rows.drop("keys").join(first, ["read", "ord"])
    counts = rows.groupBy("way", "rank", "keys").agg(F.sum("weight").alias("sum"), F.count("*").alias("n"))
    counts = sums_before(counts, ["way", "rank"], "keys", "sum", "before", F.element_at("keys", 1))
    # what has come to the read's start, all tails equal, is told apart by the tails after
    end = TIED if kind == OPEN else SETTLED
    now = F.when(F.col("n") == 1, SETTLED).when(F.element_at("keys", -1) < 0, end).otherwise(kind)
    new = rows.join(counts, ["way", "rank", "keys"]).groupBy("read").agg(F.collect_list(F.struct("ord", (F.col("rank") + F.col("before")).alias("rank"), now.alias("state"))).alias("t"))
    merged = state.join(new.select("read", F.col("t.ord").alias("ords"), F.col("t.rank").alias("ranks"), F.col("t.state").alias("states")), "read", "left")

    def put(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            sizes = np.diff(batch.column("rank").offsets.to_numpy())
            rank, states = (np.array(batch.column(c).flatten().to_numpy()) for c in ("rank", "state"))
            begins = np.cumsum(sizes) - sizes
            lists = batch.column("ords")
            counted = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0)
            at = np.repeat(begins, counted) + lists.flatten().to_numpy()
            rank[at], states[at] = (batch.column(c).flatten().to_numpy() for c in ("ranks", "states"))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            read = P.owners(sizes)[0]
            n = lambda s: np.bincount(read[states == s], minlength=len(sizes))  # noqa: B023, E731
            yield {"read": batch.column("read"), "weight": batch.column("weight"), "way": batch.column("way"), "rank": pa.ListArray.from_arrays(offsets, pa.array(rank)), "state": pa.ListArray.from_arrays(offsets, pa.array(states)), "n_open": n(OPEN), "n_tied": n(TIED)}

    return cut(by_arrow(merged, put, STATE), "ranks")


def ranked(reads: DataFrame) -> DataFrame:
    """(read, weight, way array, rank array): for each step the number of routes before it in its node and direction."""
    state = cut(_first_ranks(reads), "ranks")

    def left(column: str) -> bool:
        return bool(state.agg(F.sum(column)).first()[0])

    def after(*args) -> DataFrame:
        new = _round(state, *args)
        dropped(state)
        return new

    back = 1
    while left("n_open"):
        state = after(OPEN, back)
        back *= FAN
    if left("n_tied"):
        # the order of the tails after, as numbers: the rank of each among those of its node and direction
        rows = reads.select("read", F.explode("steps").alias("s")).select("read", "s.ord", "s.way", "s.down_tail")
        number = F.row_number().over(Window.partitionBy("way").orderBy("down_tail")).cast("long")
        numbers = rows.select("way", "down_tail").distinct().withColumn("keys", F.array(number))
        state = after(TIED, 0, rows.join(numbers, ["way", "down_tail"]).select("read", "ord", "keys"))
        back = 1
        while left("n_tied"):
            state = after(TIED, -back)
            back *= FAN
    return state


class Ordered:
    """The routes of steps in order: `routes` has a row for each step of different reads, with the weight of its copies and the
    place of the first one among all routes (node_pos) and those of the same tail before (up_pos) and after (down_pos)."""

    def __init__(self, walked: DataFrame):
        reads, self.copies = with_copies(walked)
        reads = cut(reads, "reads")
        state = ranked(reads)
        zipped = state.select("read", "weight", F.posexplode("rank").alias("ord", "node_pos"))
        steps = reads.select("read", F.explode("steps").alias("s")).select("read", "s.ord", "s.way", "s.up_tail", "s.down_tail")
        rows = cut(steps.join(zipped, ["read", "ord"]), "routes")
        # routes of one tail before lie together
        firsts = rows.groupBy("way", "up_tail").agg(F.min("node_pos").alias("first"))
        rows = rows.join(firsts, ["way", "up_tail"]).withColumn("up_pos", F.col("node_pos") - F.col("first")).drop("first")
        rows = sums_before(rows, ["way", "down_tail"], "node_pos", "weight", "down_pos")
        self.routes = cut(rows.select("read", "ord", F.shiftright("way", 1).alias("node"), F.when(F.col("way") % 2 == 1, "R").otherwise("F").alias("dir"), "up_tail", "down_tail", "weight", "node_pos", "up_pos", "down_pos"), "routes")

    def positions(self) -> DataFrame:
        """(read_id, ord, node, dir, up_tail, down_tail, node_pos, up_pos, down_pos) of every step of every read."""
        at = lambda c: (F.col(c) + F.col("nth")).alias(c)
        return self.routes.join(self.copies, "read").select("read_id", "ord", "node", "dir", "up_tail", "down_tail", at("node_pos"), at("up_pos"), at("down_pos"))

    def runs(self) -> DataFrame:
        """Routes in order, equal neighbours as one: (node, dir, run, up_tail, down_tail, width, and the places of the first one:
        node_pos, up_pos, down_pos)."""
        rows = self.routes.withColumn("tails", F.struct("up_tail", "down_tail"))
        before = rows.select("node", "dir", (F.col("node_pos") + F.col("weight")).alias("node_pos"), F.col("tails").alias("tails_before"))
        starts = rows.join(before, ["node", "dir", "node_pos"], "left").withColumn("new", F.when(F.col("tails").eqNullSafe(F.col("tails_before")), 0).otherwise(1).cast("long"))
        numbered = sums_before(starts, ["node", "dir"], "node_pos", "new", "news")
        run = (F.col("news") + F.col("new") - 1).alias("run")
        out = numbered.select("node", "dir", run, "up_tail", "down_tail", "weight", "node_pos", "up_pos", "down_pos")
        return out.groupBy("node", "dir", "run", "up_tail", "down_tail").agg(F.sum("weight").alias("width"), F.min("node_pos").alias("node_pos"), F.min("up_pos").alias("up_pos"), F.min("down_pos").alias("down_pos"))

    def tags(self, tagged: DataFrame) -> DataFrame:
        """(node, dir, node_pos, tag) of (read_id, tag): a tag lies at the last step of its read."""
        last = self.routes.groupBy("read").agg(F.max(F.struct("ord", "node", "dir", "node_pos")).alias("l"))
        ends = self.copies.join(last, "read").select("read_id", "l.node", "l.dir", (F.col("l.node_pos") + F.col("nth")).alias("node_pos"))
        return ends.join(tagged, "read_id").select("node", "dir", "node_pos", "tag")


def positions_of(runs: DataFrame) -> DataFrame:
    """(node, dir, up_tail, down_tail, node_pos, up_pos, down_pos): each route of the runs."""
    each = runs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("i"))
    at = lambda c: (F.col(c) + F.col("i")).alias(c)
    return each.select("node", "dir", "up_tail", "down_tail", at("node_pos"), at("up_pos"), at("down_pos"))


def over_edges(positions: DataFrame, k: int = K) -> DataFrame:
    """(node, dir, node_pos, next_node, next_dir, next_pos): where the read of each route goes on, by the far end of its tail and
    the place there. Routes whose tail leads to no route are left out."""
    side = F.when(F.col("dir") == "F", "S").otherwise("P")
    path = tail_path(unpack(F.col("node"), k), side, F.col("down_tail"))
    led = positions.where("down_tail <> ''").select("node", "dir", "node_pos", "down_pos", F.length("down_tail").alias("n"), path.alias("path"))
    far = target(F.col("path"), k)
    out = led.select("node", "dir", "node_pos", pack(far).alias("next_node"), F.when(F.right("path", F.lit(k)) == far, "F").otherwise("R").alias("next_dir"), F.substring(revcomp(F.col("path")), F.lit(k + 1), F.col("n")).alias("up_tail"), F.col("down_pos").alias("up_pos"))
    into = positions.select(F.col("node").alias("next_node"), F.col("dir").alias("next_dir"), "up_tail", "up_pos", F.col("node_pos").alias("next_pos"))
    return out.join(into, ["next_node", "next_dir", "up_tail", "up_pos"]).select("node", "dir", "node_pos", "next_node", "next_dir", "next_pos")


def traced(positions: DataFrame, k: int = K) -> DataFrame:
    """(node, dir, node_pos, start_node, start_dir, start_pos, place): the first step of each route's read and how many steps lie
    between, found by pointers back that grow fourfold a round, from (node, direction, position) alone."""
    onward = over_edges(positions, k).select(way(F.col("next_node"), F.col("next_dir")).alias("way"), F.col("next_pos").alias("pos"), way(F.col("node"), F.col("dir")).alias("a_way"), F.col("node_pos").alias("a_pos"))
    every = positions.select(way(F.col("node"), F.col("dir")).alias("way"), F.col("node_pos").alias("pos"))
    # a: the furthest step back that is known; done: it is the first
    now = cut(every.join(onward, ["way", "pos"], "left").select("way", "pos", F.coalesce("a_way", "way").alias("a_way"), F.coalesce("a_pos", "pos").alias("a_pos"), F.when(F.col("a_way").isNull(), 0).otherwise(1).cast("long").alias("place"), F.col("a_way").isNull().alias("done")), "pointers")
    while not now.where("not done").isEmpty():
        back = now.select(F.col("way").alias("a_way"), F.col("pos").alias("a_pos"), F.col("a_way").alias("b_way"), F.col("a_pos").alias("b_pos"), F.col("place").alias("more"), F.col("done").alias("b_done"))
        moved = now.where("not done")
        for _ in range(HOPS):  # from a first step on, a hop leads nowhere else
            moved = moved.join(back, ["a_way", "a_pos"]).select("way", "pos", F.col("b_way").alias("a_way"), F.col("b_pos").alias("a_pos"), (F.col("place") + F.col("more")).alias("place"), F.col("b_done").alias("done"))
        new = cut(now.where("done").unionByName(moved), "pointers")
        dropped(now)
        now = new
    node, direction = (lambda w: F.shiftright(w, 1)), (lambda w: F.when(F.col(w) % 2 == 1, "R").otherwise("F"))
    return now.select(node("way").alias("node"), direction("way").alias("dir"), F.col("pos").alias("node_pos"), node("a_way").alias("start_node"), direction("a_way").alias("start_dir"), F.col("a_pos").alias("start_pos"), "place")


def own_bases(k: int = K) -> Column:
    """The bases of a route's node as its read shows them."""
    return F.when(F.col("dir") == "F", unpack(F.col("node"), k)).otherwise(revcomp(unpack(F.col("node"), k)))


def walks(positions: DataFrame, trace: DataFrame, k: int = K) -> DataFrame:
    """(node, dir, node_pos, steps, seq): each read walked again from its first route."""
    start = ["start_node", "start_dir", "start_pos"]
    pieces = trace.join(positions.select("node", "dir", "node_pos", "down_tail"), ["node", "dir", "node_pos"])
    joined = pieces.groupBy(*start).agg(F.sort_array(F.collect_list(F.struct("place", "down_tail"))).alias("p"))  # a read's own
    first = joined.select(*[F.col(c).alias(c.replace("start_pos", "node_pos").replace("start_", "")) for c in start], F.size("p").alias("steps"), F.array_join("p.down_tail", "").alias("rest"))
    out = first.join(positions.select("node", "dir", "node_pos", "up_tail"), ["node", "dir", "node_pos"])
    return out.select("node", "dir", "node_pos", "steps", F.concat(revcomp(F.col("up_tail")), own_bases(k), F.col("rest")).alias("seq"))

