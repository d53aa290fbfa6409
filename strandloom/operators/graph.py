"""K-mers, node policies, hits, steps, tails and edges of the routed graph, as DataFrames.

Reads are (read_id, seq). The smaller strand of a k-mer is its node id (`node`, two bits a base in a long; `unpack` gives the
bases). K-mers chosen as nodes lie at most `sparseness` bases apart on every read. A step is one node on one read with the bases
to the node before (up_tail, read away from the node) and after (down_tail). Tails are a node's distinct step ends by side (P before,
S after it, in the node's own orientation). k-mers are computed a batch at a time in arrays, and which of them are
nodes is asked by groups of reads (`searched`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import packed as P
from ..functions.sequences import K, orientation, pack, revcomp, tail_path, target, unpack
from .lineage import by_arrow, cut, dropped, freed, kept

MIN_LENGTH, SPARSENESS = 40, 23
#: Bases of a row of reads that are searched together.
GROUP = 1 << 20
#: Nodes of a part at most; bits of a slice of the filter and most slices (1 MB each; they are what is broadcast). With more nodes, slices
#: get fuller, and beyond a node for each two bits there is no filter.
PART_NODES, SLICE_BITS, MOST_SLICES, FILTER_BITS = 1 << 19, 1 << 23, 64, 16


def filtered(reads: DataFrame, min_length: int = MIN_LENGTH, k: int = K) -> DataFrame:
    """Reads long enough and without N; m is the last place of a k-mer."""
    return reads.where((F.length("seq") >= max(min_length, k)) & ~F.contains("seq", F.lit("N"))).withColumn("m", F.length("seq") - k)


def kmers(reads: DataFrame, k: int = K, text: bool = False) -> DataFrame:
    """(read_id, pos, node, rc): every place of every read; rc tells whether the read shows the other strand. text: and kmer,
    the bases."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            ids = batch.column("read_id")
            for read, pos, forward, reverse in P.places(*P.texts_of(batch.column("seq")), k):
                out = {"read_id": ids.take(pa.array(read)), "pos": pos, "node": np.minimum(forward, reverse), "rc": forward > reverse}
                yield out | {"kmer": P.strings_of(forward, k)} if text else out

    return by_arrow(reads.select("read_id", "seq"), run, "read_id long, pos int, node long, rc boolean" + (", kmer string" if text else ""))


def kmer_counts(reads: DataFrame, k: int = K) -> DataFrame:
    """(node, n): how often each canonical k-mer occurs; a batch sends each of its k-mers once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            parts = [np.minimum(f, r) for _, _, f, r in P.places(*P.texts_of(batch.column("seq")), k)]
            if parts:
                node, n = np.unique(np.concatenate(parts), return_counts=True)
                yield {"node": node, "n": n}

    return by_arrow(reads.select("seq"), run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def nodes_grid(reads: DataFrame, k: int = K, sparseness: int = SPARSENESS) -> DataFrame:
    """(node): distinct k-mers at every sparseness-th place of each read (the middle of reads without such a place)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            data, low, high = P.texts_of(batch.column("seq"))
            last = high - low - k
            sizes = np.where(last < sparseness, last >= 0, last // sparseness)
            owner, number = P.owners(sizes)
            place = np.where(last[owner] < sparseness, last[owner] // 2, (number + 1) * sparseness)
            ids, fine = P.ids_at(data, low[owner] + place, k)
            yield {"node": np.unique(np.minimum(ids, P.reverse_ids(ids, k))[fine])}

    return by_arrow(reads.select("seq"), run, "node long").distinct()


def _revcomp(s: str) -> str:
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def chosen(seq: str, known: set[str], k: int, sparseness: int) -> list[str]:
    """K-mers to add for one read, given the nodes known so far: the places of known nodes are looked for from the far
    end of each stretch backwards, then gaps of sparseness and more are filled."""
    m = len(seq) - k

    def smer(p: int) -> str:
        s = seq[p : p + k]
        return min(s, _revcomp(s))

    hits, checked, at = [], -1, min(sparseness - 1, m)
    while at <= m and at > checked:
        hit = next((p for p in range(at, checked, -1) if smer(p) in known), None)
        if hit is None:
            hit = next((p for p in range(at + 1, m + 1) if smer(p) in known), None)
            if hit is None:
                break
        hits.append(hit)
        checked, at = hit, hit + sparseness
    added, before = [], 0
    for end in [*hits, m + 1]:
        while end - before > sparseness or (end == m + 1 and m - before >= sparseness):
            before += sparseness
            added.append(before)
        before = end
    if not hits and not added:
        added.append(m // 2)
    return [smer(p) for p in added]


def nodes_sequential(reads: DataFrame, k: int = K, sparseness: int = SPARSENESS, known: list[str] | None = None) -> DataFrame:
    """(node) as one reader in order of read_id finds them: later reads reuse the nodes of earlier ones. One task by
    nature; for small inputs and for comparison. `nodes_rounds` is the distributed form."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = set(known or ())
        for frame in it:
            new: list[str] = []
            for seq in frame.seq:
                more = chosen(seq, held, k, sparseness)
                new += [x for x in dict.fromkeys(more) if x not in held]
                held.update(more)
            yield pd.DataFrame({"smer": new}, dtype="str")

    found = reads.select("read_id", "seq").orderBy("read_id").coalesce(1).mapInPandas(run, "smer string")
    return found.select(pack(F.col("smer")).alias("node"))


def nodes_rounds(reads: DataFrame, rounds: int = 4, k: int = K, sparseness: int = SPARSENESS) -> DataFrame:
    """(node): reads in `rounds` parts by a hash of the id; each part adds grid nodes only in stretches that the nodes of
    earlier parts leave open. No task needs the whole node set."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            data, low, high = P.texts_of(batch.column("seq"))
            wanted = []
            for m, own in zip((high - low - k).tolist(), batch.column("places").to_pylist(), strict=True):
                before, add = 0, []
                for mark in [*sorted(own or ()), m]:
                    if mark - before > sparseness:  # as many as keep every distance within the sparseness
                        add += range(before + sparseness, mark + 1, sparseness)
                    before = mark
                wanted.append(add if own or m > sparseness else [m // 2])
            sizes = np.array([len(w) for w in wanted], np.int64)
            owner, _ = P.owners(sizes)
            at = low[owner] + np.array([p for w in wanted for p in w], np.int64)
            parts = [np.empty(0, np.int64)]
            for a in range(0, len(at), 100_000):
                some = at[a : a + 100_000]
                codes = P.CODE[data[some[:, None] + np.arange(k)]]
                ids = np.zeros(len(some), np.int64)
                for i in range(k):
                    ids = ids << 2 | codes[:, i] & 3
                parts.append(np.minimum(ids, P.reverse_ids(ids, k))[(codes < P.OTHER).all(1)])
            yield {"node": np.unique(np.concatenate(parts))}

    known = None
    for part in range(rounds):
        some = reads.where(F.pmod(F.xxhash64("read_id"), F.lit(rounds)) == part)
        if known is None:
            known = cut(nodes_grid(some, k, sparseness), "nodes")
            continue
        open_reads = some.select("read_id", "seq").join(hit_lists(some, known, k).select("read_id", "places"), "read_id", "left")
        known = cut(known.unionByName(by_arrow(open_reads, run, "node long")).distinct(), "nodes")
    return known


def grouped(reads: DataFrame, known: Broadcast | None = None, k: int = K) -> DataFrame:
    """(grp, ids, seqs, marks): reads in rows of about GROUP bases, computed once, with a bit for each base, set where a k-mer begins
    that may be a node."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        number = TaskContext.get().partitionId() << 32
        for batch in it:
            if not batch.num_rows:
                continue
            data, low, high = P.texts_of(batch.column("seq"))
            group = (np.cumsum(high - low) - (high - low)) // GROUP
            offsets = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]).astype(np.int32)
            marks = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                bits = np.zeros(high[b - 1] - low[a], bool)
                bits[P.marked(data, low[a:b], high[a:b], k, known and known.value) - low[a]] = True
                marks.append(np.packbits(bits).tobytes())
            lists = {c: pa.ListArray.from_arrays(offsets, batch.column(b)) for c, b in (("ids", "read_id"), ("seqs", "seq"))}
            yield {"grp": number + np.arange(len(offsets) - 1), "marks": marks} | lists
            number += len(offsets) - 1

    return cut(by_arrow(reads.select("read_id", "seq"), run, "grp long, ids array<long>, seqs array<string>, marks binary"), "groups")


def dealt_nodes(nodes: DataFrame, parts: int) -> DataFrame:
    """(part, ids): the ids of the nodes by parts, in order, in few rows."""

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[np.ndarray] = []

        def out() -> dict:
            ids = np.unique(np.concatenate(held))
            held.clear()
            some = list(P.by_part(ids, parts))
            return {"part": [p for p, _ in some], "ids": [P.coded(ids[at]) for _, at in some]}

        for batch in it:
            held.append(batch.column("node").to_numpy())
            if sum(map(len, held)) > 2 * PART_NODES:
                yield out()
        if held:
            yield out()

    return by_arrow(nodes.select("node"), split, "part int, ids binary")


def node_parts(nodes: DataFrame) -> tuple[DataFrame, int, int]:
    """(part, ids): the ids of the nodes, in order, in a row for each part of at most about PART_NODES; how many parts, and nodes."""
    count = nodes.count()
    parts = 1 << (max(0, count - 1) // PART_NODES).bit_length()

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, held = None, []
        for batch in it:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if part != now and held:
                    yield {"part": [now], "ids": [P.coded(np.unique(np.concatenate(held)))]}
                    held = []
                now = part
                held.append(P.decoded(raw))
        if held:
            yield {"part": [now], "ids": [P.coded(np.unique(np.concatenate(held)))]}

    dealt = dealt_nodes(nodes, parts).repartition("part").sortWithinPartitions("part")
    return cut(by_arrow(dealt, merge, "part int, ids binary"), "parts"), parts, count


def node_filter(held: DataFrame, parts: int, count: int) -> P.Filter | None:
    """A Bloom filter of the parts of nodes. A task makes whole slices, so that the driver gets each bit once."""
    slices = min(parts, MOST_SLICES)
    bits = SLICE_BITS if parts > 1 else max(1 << 10, 1 << (max(1, count) * FILTER_BITS - 1).bit_length())
    if 2 * count > bits * slices:
        return None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, own = None, None
        for batch in it:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if part % slices != now:
                    if own is not None:
                        yield {"slice": [now], "words": [own.words.tobytes()]}
                    now, own = part % slices, P.Filter(bits)
                own.put(P.decoded(raw))
        if own is not None:
            yield {"slice": [now], "words": [own.words.tobytes()]}

    dealt = held.withColumn("slice", F.col("part") % slices).repartition("slice").sortWithinPartitions("slice").select("part", "ids")
    out = P.Filter(bits, slices=slices)
    for row in by_arrow(dealt, run, "slice int, words binary").toLocalIterator():  # a row for each slice
        words = np.frombuffer(row.words, np.uint64)
        out.words[row.slice * len(words) : (row.slice + 1) * len(words)] = words
    return out


def searched(reads: DataFrame, nodes: DataFrame, fn: Callable, schema: str, k: int = K, numbered: bool = False) -> DataFrame:
    """What fn(ids, data, low, high, read, pos, node, rc) yields for each group of reads: their ids, their bases, and all places
    that hold a node, in order; numbered: fn takes the group's number too, which grows with the order of sorted reads. Each group asks the parts of nodes which of its k-mers (that the filter lets pass, each once) they hold, and
    gets a bit for each; so no row for a place is dealt anywhere. nodes are read twice."""
    reads.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 * GROUP))  # rows of groups are large
    held, parts, count = node_parts(nodes)
    holds = node_filter(held, parts, count)
    freed(reads.sparkSession)
    known = reads.sparkSession.sparkContext.broadcast(holds) if holds else None
    groups = grouped(reads, known, k)
    if known is not None:
        known.destroy()  # each executor keeps a copy on disk
    freed(reads.sparkSession)

    def candidates(seqs: pa.Array, marks: pa.Scalar) -> tuple:
        data, low, high = P.texts_of(seqs)
        at = low[0] + np.flatnonzero(np.unpackbits(np.frombuffer(marks.as_buffer(), np.uint8)))
        read = np.searchsorted(low, at, "right") - 1
        forward, _ = P.ids_at(data, at, k)
        reverse = P.reverse_ids(forward, k)
        return data, low, high, read, at - low[read], np.minimum(forward, reverse), forward > reverse

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            for i, grp in enumerate(batch.column("grp").to_pylist()):
                ids = np.unique(candidates(batch.column("seqs")[i].values, batch.column("marks")[i])[5])
                some = list(P.by_part(ids, parts))
                yield {"part": [p for p, _ in some], "grp": [grp] * len(some), "ids": [P.coded(ids[at]) for _, at in some]}

    def answer(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, own = None, np.empty(0, np.int64)
        for batch in it:
            out: dict[str, list] = {"grp": [], "part": [], "yes": []}
            for part, grp, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "grp", "ids")), strict=True):
                if grp == -1:  # comes first
                    now, own = part, P.decoded(raw)
                elif part == now:
                    ids = P.decoded(raw)
                    yes = own[np.minimum(np.searchsorted(own, ids), len(own) - 1)] == ids
                    for c, x in (("grp", grp), ("part", part), ("yes", np.packbits(yes).tobytes())):
                        out[c].append(x)
            yield out

    asked = by_arrow(groups.select("grp", "seqs", "marks"), ask, "part int, grp long, ids binary")
    both = asked.unionByName(held.withColumn("grp", F.lit(-1).cast("long")))
    answers = cut(by_arrow(both.repartition("part").sortWithinPartitions("part", "grp"), answer, "grp long, part int, yes binary"), "answers")
    dropped(held)
    del asked, both, held
    freed(reads.sparkSession)

    by_group = answers.groupBy("grp").agg(F.collect_list(F.struct("part", "yes")).alias("told"))  # a bit for each k-mer of a group

    def each(fn: Callable, schema: str) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in it:
                for i in range(batch.num_rows):
                    data, low, high, read, pos, node, rc = candidates(batch.column("seqs")[i].values, batch.column("marks")[i])
                    ids, where = np.unique(node, return_inverse=True)
                    told = {a["part"]: a["yes"] for a in batch.column("told")[i].as_py() or ()}
                    yes = np.zeros(len(ids), bool)
                    for part, at in P.by_part(ids, parts):
                        if part in told:
                            yes[at] = np.unpackbits(np.frombuffer(told[part], np.uint8), count=len(at)).astype(bool)
                    hit = np.flatnonzero(yes[where])
                    number = (batch.column("grp")[i].as_py(),) if numbered else ()
                    yield from fn(batch.column("ids")[i].values, data, low, high, read[hit], pos[hit], node[hit], rc[hit], *number)

        out = by_arrow(groups.join(by_group, "grp", "left"), run, schema)
        out.also, out.each = [groups, answers], each  # what it is read from; the same places for another function
        return out

    return each(fn, schema)


def found_kmers(reads: DataFrame, nodes: DataFrame, k: int = K) -> DataFrame:
    """(read_id, pos, node, rc) of every place that holds a node."""

    def run(ids, data, low, high, read, pos, node, rc) -> Iterator[dict]:
        yield {"read_id": ids.take(pa.array(read)), "pos": pos, "node": node, "rc": rc}

    return searched(reads, nodes, run, "read_id long, pos int, node long, rc boolean", k)


def hit_lists(reads: DataFrame, nodes: DataFrame, k: int = K) -> DataFrame:
    """(read_id, places, nodes, reversed): a row for each read with hits, in order of their places."""

    def run(ids, data, low, high, read, pos, node, rc) -> Iterator[dict]:
        some, sizes = np.unique(read, return_counts=True)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = {c: pa.ListArray.from_arrays(offsets, pa.array(x)) for c, x in (("places", pos.astype(np.int32)), ("nodes", node), ("reversed", rc))}
        yield {"read_id": ids.take(pa.array(some))} | lists

    return searched(reads, nodes, run, "read_id long, places array<int>, nodes array<long>, reversed array<boolean>", k)


def hits(reads: DataFrame, nodes: DataFrame, k: int = K) -> DataFrame:
    """(read_id, ord, pos, node, dir): every node on every read."""

    def run(ids, data, low, high, read, pos, node, rc) -> Iterator[dict]:
        order = P.owners(np.bincount(read, minlength=len(low)))[1]
        yield {"read_id": ids.take(pa.array(read)), "ord": order, "pos": pos, "node": node, "dir": pa.array(np.where(rc, "R", "F"), pa.string())}

    return searched(reads, kept(nodes, "nodes"), run, "read_id long, ord int, pos int, node long, dir string", k)


def _stretch(low: np.ndarray, high: np.ndarray, read: np.ndarray, pos: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """For hits in order: their number on the read, the place before (0 for the first), and that after (the read's last one)."""
    sizes = np.bincount(read, minlength=len(low))
    order = P.owners(sizes)[1]
    before = np.where(order > 0, np.concatenate([[0], pos[:-1]]), 0) if len(pos) else pos
    after = np.concatenate([pos[1:], [0]])[: len(pos)]
    after[np.cumsum(sizes)[sizes > 0] - 1] = (high - low - k)[sizes > 0]
    return order, before, after


def gaps(reads: DataFrame, nodes: DataFrame, k: int = K) -> DataFrame:
    """(read_id, gap) before each hit and after the last one, of the reads with hits."""

    def run(ids, data, low, high, read, pos, node, rc) -> Iterator[dict]:
        _, before, after = _stretch(low, high, read, pos, k)
        last = np.flatnonzero(np.diff(read, append=-1))
        yield {"read_id": ids.take(pa.array(np.concatenate([read, read[last]]))), "gap": np.concatenate([pos - before, (after - pos)[last]])}

    return searched(reads, kept(nodes, "nodes"), run, "read_id long, gap int", k)


def steps(reads: DataFrame, nodes: DataFrame, k: int = K) -> DataFrame:
    """(read_id, ord, pos, node, dir, up_tail, down_tail)."""

    def run(ids, data, low, high, read, pos, node, rc) -> Iterator[dict]:
        order, before, after = _stretch(low, high, read, pos, k)
        for a in range(0, len(pos), 200_000):
            s = slice(a, a + 200_000)
            begin, p = low[read[s]], pos[s]
            yield {
                "read_id": ids.take(pa.array(read[s])), "ord": order[s], "pos": p, "node": node[s], "dir": pa.array(np.where(rc[s], "R", "F"), pa.string()),
                "up_tail": P.stretches(data, begin + before[s], begin + p, True), "down_tail": P.stretches(data, begin + p + k, begin + after[s] + k),
            }

    return searched(reads, kept(nodes, "nodes"), run, "read_id long, ord int, pos int, node long, dir string, up_tail string, down_tail string", k)


def ends(walked: DataFrame) -> DataFrame:
    """Both ends of each step: (node, dir, side, bases)."""
    forward = F.col("dir") == "F"
    return walked.select("node", "dir", F.explode(F.array(F.struct(F.when(forward, "P").otherwise("S").alias("side"), F.col("up_tail").alias("bases")), F.struct(F.when(forward, "S").otherwise("P").alias("side"), F.col("down_tail").alias("bases")))).alias("e")).select("node", "dir", "e.side", "e.bases")


def widths(walked: DataFrame) -> DataFrame:
    """(node, side, bases, forward, reverse): steps over each tail by direction."""
    n = lambda d: F.sum((F.col("dir") == d).cast("long"))
    return ends(walked).where("bases <> ''").groupBy("node", "side", "bases").agg(n("F").alias("forward"), n("R").alias("reverse"))


def tails(walked: DataFrame) -> DataFrame:
    """(node, side, idx, len, bases, forward, reverse): distinct tails, numbered from 1 by length and bases, with their
    widths; 0 is no tail."""
    order = Window.partitionBy("node", "side").orderBy(F.length("bases"), "bases")  # of distinct tails
    return widths(walked).select("node", "side", F.row_number().over(order).alias("idx"), F.length("bases").alias("len"), "bases", "forward", "reverse")


def with_path(held: DataFrame, k: int = K) -> DataFrame:
    """Tails with the bases of their node, read towards the tail, and the tail."""
    return held.withColumn("path", tail_path(unpack(F.col("node"), k), F.col("side"), F.col("bases")))


def tail_targets(held: DataFrame, nodes: DataFrame, k: int = K) -> DataFrame:
    """Tails with the node they lead to and linked: 1 or -1 by its orientation, 0 if it is no node."""
    led = with_path(held, k).withColumn("target", pack(target(F.col("path"), k)))
    out = led.join(nodes.select(F.col("node").alias("target"), F.lit(1).alias("known")), "target", "left")
    linked = F.when(F.col("known").isNull(), 0).otherwise(orientation(F.col("path"), F.col("side"), k))
    return out.select(*held.columns, "target", linked.alias("linked"))


def linking(targets: DataFrame) -> DataFrame:
    """The linked node of each tail, -1 for none."""
    return targets.withColumn("linking", F.when(F.col("linked") != 0, F.col("target")).otherwise(F.lit(-1)))


def edges(targets: DataFrame, k: int = K) -> DataFrame:
    """Linked tails with the far end: its side and its bases, by which it is found among the target's tails."""
    back = revcomp(F.col("path"))
    far_side = F.when(F.left(back, F.lit(k)) == unpack(F.col("target"), k), "S").otherwise("P")
    return with_path(targets.where("linked <> 0"), k).select("node", "side", "idx", "bases", "target", "linked", far_side.alias("far_side"), F.substring(back, F.lit(k + 1), F.length("bases")).alias("far_bases"))


def edge_widths(linked: DataFrame, width: DataFrame) -> DataFrame:
    """Edges with the widths of both ends; agrees tells whether they match (directions swap where linked < 0)."""
    far = width.select(F.col("node").alias("target"), F.col("side").alias("far_side"), F.col("bases").alias("far_bases"), F.col("forward").alias("far_forward"), F.col("reverse").alias("far_reverse"))
    both = linked.join(width.select("node", "side", "bases", "forward", "reverse"), ["node", "side", "bases"]).join(far, ["target", "far_side", "far_bases"], "left")
    same = F.when(F.col("linked") > 0, (F.col("forward") == F.col("far_forward")) & (F.col("reverse") == F.col("far_reverse"))).otherwise((F.col("forward") == F.col("far_reverse")) & (F.col("reverse") == F.col("far_forward")))
    return both.select("node", "side", "bases", "target", "linked", "forward", "reverse", F.coalesce(same, F.lit(False)).alias("agrees"))


def routes(walked: DataFrame) -> DataFrame:
    """(node, dir, up_tail, down_tail, width): reads on each way through a node; partial sums before the shuffle."""
    return walked.groupBy("node", "dir", "up_tail", "down_tail").agg(F.count("*").alias("width"))


def fragments(reads: DataFrame, longest: int = 1050, overlap: int = 50, min_length: int = MIN_LENGTH) -> DataFrame:
    """(read_id, fragment_id, start_pos, end_pos): long runs split with an overlap."""
    n, stride = F.length("seq"), longest - overlap
    last = F.greatest(F.lit(0), F.floor((n - overlap) / stride)).cast("int")
    at = reads.where(n >= min_length).select("read_id", n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return at.select("read_id", F.col("i").cast("long").alias("fragment_id"), (F.col("i") * stride).alias("start_pos"), F.least(F.col("n"), F.col("i") * stride + longest).alias("end_pos"))


def acgt_runs(lines: DataFrame, id_column: str, text: str, min_length: int = MIN_LENGTH) -> DataFrame:
    """(id, start_pos, len): runs of uppercase ACGT; other characters advance the position, line ends don't."""
    pieces = lines.select(id_column, F.posexplode(F.split(F.regexp_replace(text, "[\r\n]", ""), "[^ACGT]", -1)).alias("i", "run"))
    before = Window.partitionBy(id_column).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.select(id_column, F.coalesce(F.sum(F.length("run") + 1).over(before), F.lit(0)).alias("start_pos"), F.length("run").alias("len"))
    return placed.where(F.col("len") >= min_length)


def grid_places(m: Column, sparseness: int = SPARSENESS) -> Column:
    """The places of the grid policy as an expression."""
    return F.when(m < sparseness, F.array(F.floor(m / 2).cast("int"))).otherwise(F.sequence(F.lit(sparseness), F.greatest(m, F.lit(sparseness)), F.lit(sparseness)))
