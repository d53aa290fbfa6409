"""The order of routes of reads whose own nodes lie at most k bases apart, in arrays.

Within a node and direction (a way), routes are in order of the tails before them (latest first), then those after, then the read.
Three things make that order cheap:

* The reads are sorted by their bases and ids before they are grouped. Two routes of a way with all tails before equal belong to reads
  with the same beginning, so the order of the reads is that of the tails after, and of copies.
* A way whose routes all come by one tail tells nobody apart: from there, all go back to the same node. So only steps at ways with
  several tails before (`where`) are compared, and the other ways inherit the order of the nearest such step before.
* Ranks of these steps grow FAN-fold a round, of open ones only, as in `routing`.

Each group of reads sends what it asks to the parts of the nodes, each class of routes once, and gets ranks back in the same order; at the
end each route is dealt once, to the part of its node, where places, runs and whatever else is asked are found at one go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import packed as P
from ..functions.sequences import K
from .graph import PART_NODES, _stretch, searched
from .lineage import by_arrow, cut, dropped, freed, kept
from .packed_tails import MOST, SIDE, _codes, _led, _side, _summed, _tails, _texts, bases_of, few, of_few, tail_rows, tail_schema
from .routing import FAN

HITS = "sizes binary, way binary, gap binary, up binary, down binary"
STATE = "grp long, iread binary, iway binary, rank binary, open binary, n_open long"


def growing(x: np.ndarray) -> bytes:
    return few(np.diff(x, prepend=0))


def of_growing(raw: bytes) -> np.ndarray:
    return np.cumsum(of_few(raw))


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def since(new: np.ndarray) -> np.ndarray:
    """How many rows lie between each and the last new one."""
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0)) if len(new) else at


def by_text(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys for lexsort, by which tails are in order of their texts."""
    return code, code << 2 * (MOST - bases_of(code)) & (1 << 2 * MOST) - 1


def _hits(batch: pa.RecordBatch, i: int, k: int) -> tuple[np.ndarray, ...]:
    """Of a group: hits of each read; way, tail before and tail after of each hit."""
    sizes, way, gap, first, last = (of_few(batch.column(c)[i].as_py()) for c in ("sizes", "way", "gap", "up", "down"))
    return sizes, way, *_tails(way, gap, sizes, first, last, k)


def _by_way(way: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One hit of each class (way and tail before), in order; the class of each hit; hits of each class."""
    order = np.lexsort((up, way))
    new = changes(way[order], up[order])
    number = np.empty(len(way), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number, np.bincount(number, minlength=int(new.sum()))


def _parts(rows: DataFrame, names: list[str], fn: Callable, schema: str) -> DataFrame:
    """What fn(grps, *columns of blobs) yields for each part, whose blobs are in order of their groups; the first column grows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, held = None, []
        for batch in it:
            for part, grp, *blobs in zip(*(batch.column(c).to_pylist() for c in ("part", "grp", *names)), strict=True):
                if part != now and held:
                    yield from fn(now, *zip(*held, strict=True))
                    held.clear()
                now = part
                held.append((grp, of_growing(blobs[0]), *map(of_few, blobs[1:])))
        if held:
            yield from fn(now, *zip(*held, strict=True))

    return by_arrow(rows.repartition("part").sortWithinPartitions("part", "grp"), run, schema)


def _told(rows: DataFrame, names: list[str], fn: Callable) -> DataFrame:
    """(grp, told): for each group, what fn(*columns) says of each row of its blobs: two columns of numbers."""

    def run(part: int, grps, *columns) -> Iterator[dict]:
        sizes = [len(x) for x in columns[0]]
        blob = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes)[:-1]
        one, two = (np.split(x, ends) for x in fn(blob, *map(np.concatenate, columns)))
        yield {"grp": list(grps), "part": [part] * len(grps), "one": [few(x) for x in one], "two": [few(x) for x in two]}

    said = _parts(rows, names, run, "grp long, part int, one binary, two binary")
    return said.groupBy("grp").agg(F.collect_list(F.struct("part", "one", "two")).alias("told"))  # a row for each part


def _heard(told: pa.Scalar, node: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of `_told` for the rows that were sent, whose nodes are these."""
    said = {t["part"]: t for t in told.as_py() or ()}
    one, two = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
    for part, at in P.by_part(node, parts):
        one[at], two[at] = of_few(said[part]["one"]), of_few(said[part]["two"])
    return one, two


def _first(blob: np.ndarray, way: np.ndarray, up: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Routes before each class in its way; 1 if the class has several routes, and 2 if the way has several classes."""
    order = np.lexsort((*by_text(up), way))
    w, u = way[order], up[order]
    new_way, new = changes(w), changes(w, u)
    at = np.flatnonzero(new)
    total = np.add.reduceat(n[order], at) if len(at) else n
    before, owner = np.cumsum(total) - total, (np.cumsum(new_way) - 1)[at]
    before = before - before[new_way[at]][owner]
    flags = (total > 1) + 2 * (np.bincount(owner) > 1)[owner] if len(at) else total
    one, two = np.empty(len(way), np.int64), np.empty(len(way), np.int64)
    number = np.cumsum(new) - 1
    one[order], two[order] = before[number], flags[number]
    return one, two


def _next(blob: np.ndarray, way: np.ndarray, read: np.ndarray, rank: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each open step by more tails, and whether it is still open. What has come to the start of its read is told apart
    by the order of reads."""
    order = np.lexsort((read, blob, *keys[::-1], rank, way))
    w, r = way[order], rank[order]
    tied, new = changes(w, r), changes(w, r, *(k[order] for k in keys))
    place, over = since(tied), keys[-1][order] == 0
    number = np.cumsum(new) - 1
    rank_now = np.where(over, place, place[new][number]) + r
    still = ~over & (np.bincount(number, minlength=1)[number] > 1)
    one, two = np.empty(len(way), np.int64), np.empty(len(way), np.int64)
    one[order], two[order] = rank_now, still
    return one, two


class PackedOrder:
    """The routes of reads through their own nodes, in order. Each question is one pass: every route is dealt to its node's part."""

    def __init__(self, reads: DataFrame, nodes: DataFrame, k: int = K):
        nodes = kept(nodes, "nodes")
        self.k, self.parts = k, 1 << (4 * max(0, nodes.count() - 1) // PART_NODES).bit_length()
        found = self._found(reads, nodes)
        freed(reads.sparkSession)  # what was dealt to find out which k-mers are nodes
        hits = cut(found, "hits")
        dropped(*found.also)
        del found
        freed(reads.sparkSession)
        self.hits = self._ranked_once(hits)
        dropped(hits)
        freed(reads.sparkSession)  # the hits that were dealt to what they were told
        state, back = cut(self.hits.select(*STATE.replace(" long", "").replace(" binary", "").split(", ")), "ranks"), 1
        while state.agg(F.sum("n_open")).first()[0]:
            new = self._round(state, back)
            dropped(state)
            freed(reads.sparkSession)
            state, back = new, back * FAN
        # put together once, so that no question deals the hits
        columns = ["grp", "ids", "sizes", "way", "gap", "up", "down", "where", "several"]
        self.state = cut(self.hits.select(*columns).join(state.select("grp", F.col("rank").alias("ranks")), "grp"), "order")
        dropped(state, self.hits)
        self.hits = self.state
        freed(reads.sparkSession)

    def _found(self, reads: DataFrame, nodes: DataFrame) -> DataFrame:
        """A row for each group of sorted reads: ids, hits of each read, for each hit its way and the bases since the one before, and
        the tails before the first and after the last hit of each read with hits."""
        k = self.k

        def run(ids, data, low, high, read, pos, node, rc, grp) -> Iterator[dict]:
            order, before, after = _stretch(low, high, read, pos, k)
            if max((pos - before).max(initial=0), (after - pos).max(initial=0)) > min(k, MOST):
                raise ValueError("a tail is longer than a node")
            head, end, begin = np.flatnonzero(order == 0), np.flatnonzero(np.diff(read, append=-1)), low[read]
            up, down = _codes(data, (begin + pos - 1)[head], pos[head], True), _codes(data, (begin + pos + k)[end], (after - pos)[end], False)
            one = {"way": node * 2 + rc, "gap": np.where(order > 0, pos - before, 0), "up": up, "down": down, "sizes": np.bincount(read, minlength=len(low))}
            yield {"grp": [grp], "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)} | {c: [few(x)] for c, x in one.items()}

        return searched(reads.select("read_id", "seq").orderBy("seq", "read_id"), nodes, run, "grp long, ids array<long>, " + HITS, k, numbered=True)

    def _ranked_once(self, hits: DataFrame) -> DataFrame:
        """hits with those at ways with several classes (`where`), their ranks by one tail, and which hits aren't alone in their class."""
        parts, k = self.parts, self.k

        def ask(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in it:
                for i, grp in enumerate(batch.column("grp").to_pylist()):
                    _, way, up, _ = _hits(batch, i, k)
                    some, _, n = _by_way(way, up)
                    dealt = list(P.by_part(way[some] >> 1, parts))
                    cols = {"way": [growing(way[some[at]]) for _, at in dealt], "up": [few(up[some[at]]) for _, at in dealt], "n": [few(n[at]) for _, at in dealt]}
                    yield {"part": [p for p, _ in dealt], "grp": [grp] * len(dealt)} | cols

        def put(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in it:
                for i in range(batch.num_rows):
                    sizes, way, up, _ = _hits(batch, i, k)
                    some, number, _ = _by_way(way, up)
                    rank, flags = (x[number] for x in _heard(batch.column("told")[i], way[some] >> 1, parts))
                    where = np.flatnonzero(flags & 2)
                    still = flags[where] & 1
                    out = {"where": growing(where), "iread": growing(P.owners(sizes)[0][where]), "iway": few(way[where]), "rank": few(rank[where]), "open": few(still), "several": few(flags & 1)}
                    yield {c: batch.column(c).slice(i, 1) for c in ("grp", "ids", "sizes", "way", "gap", "up", "down")} | {c: [x] for c, x in out.items()} | {"n_open": [int(still.sum())]}

        asked = by_arrow(hits.drop("ids"), ask, "part int, grp long, way binary, up binary, n binary")
        told = cut(_told(asked, ["way", "up", "n"], _first), "told")
        del asked
        freed(hits.sparkSession)
        out = cut(by_arrow(hits.join(told, "grp", "left"), put, "ids array<long>, " + HITS + ", where binary, several binary, " + STATE), "hits")
        dropped(told)
        return out

    def _round(self, state: DataFrame, back: int) -> DataFrame:
        """The state after open steps are told apart by the ranks of the steps `back` before, twice as far, and so on."""
        parts, names = self.parts, [f"key{i}" for i in range(1, FAN)]

        def opened(iread: bytes, iway: bytes, still: bytes) -> tuple[np.ndarray, ...]:
            read, way, still = of_growing(iread), of_few(iway), of_few(still)
            at = np.flatnonzero(still)
            at = at[np.argsort(way[at], kind="stable")]
            return read, way[at], at

        def ask(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in it:
                for grp, raw, *own in zip(*(batch.column(c).to_pylist() for c in ("grp", "rank", "iread", "iway", "open")), strict=True):
                    rank, (read, way, at) = of_few(raw), opened(*own)
                    order, columns = since(changes(read)), {"read": read[at], "rank": rank[at]}
                    for i, name in enumerate(names, 1):
                        columns[name] = np.where(order[at] >= back * i, rank[np.maximum(at - back * i, 0)] + 1, 0)
                    dealt = list(P.by_part(way >> 1, parts))
                    yield {"part": [p for p, _ in dealt], "grp": [grp] * len(dealt), "way": [growing(way[x]) for _, x in dealt]} | {c: [few(v[x]) for _, x in dealt] for c, v in columns.items()}

        def put(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in it:
                for i in range(batch.num_rows):
                    rank, still = (np.array(of_few(batch.column(c)[i].as_py())) for c in ("rank", "open"))
                    _, way, at = opened(*(batch.column(c)[i].as_py() for c in ("iread", "iway", "open")))
                    rank[at], still[at] = _heard(batch.column("told")[i], way >> 1, parts)
                    yield {c: batch.column(c).slice(i, 1) for c in ("grp", "iread", "iway")} | {"rank": [few(rank)], "open": [few(still)], "n_open": [int(still.sum())]}

        columns = ["way", "read", "rank", *names]
        asked = by_arrow(state.where("n_open > 0"), ask, "part int, grp long, " + ", ".join(f"{c} binary" for c in columns))
        return cut(by_arrow(state.join(_told(asked, columns, _next), "grp", "left"), put, STATE), "ranks")

    def each_part(self, fn: Callable, schema: str, named: bool | str = False, asked: DataFrame | None = None) -> DataFrame:
        """What fn(routes) gives for each part: dict of node, rc, up, down, first, last, middle (whether it is its read's), node_pos,
        up_pos and down_pos of all routes in order of their ways and places; named: with read_id and ord ("last": those of last routes only, others have 0). asked: contexts, those of a
        part go to fn too (way, up, place and asked_id), and routes have the group and the hit that they are, and onward, their order by tail after."""
        parts, k, found = self.parts, self.k, asked is not None

        def deal(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in it:
                for i in range(batch.num_rows):
                    sizes, way, up, down = _hits(batch, i, k)
                    grp, *raw = (batch.column(c)[i].as_py() for c in ("grp", "several", "ranks"))
                    several, rank = map(of_few, raw)
                    where = of_growing(batch.column("where")[i].as_py())
                    read, order = P.owners(sizes)
                    # the nearest step of the same read that tells routes apart
                    near = np.searchsorted(where, np.arange(len(way)), "right") - 1
                    there = np.flatnonzero((several == 1) & (near >= 0))
                    there = there[read[where[near[there]]] == read[there]] if len(there) else there
                    key = np.zeros(len(way), np.int64)
                    key[there] = rank[near[there]] + 1
                    columns = {"key": key, "ends": (order == 0) + 2 * (order == sizes[read] - 1) + 4 * (order == sizes[read] // 2)}
                    if found:
                        columns |= {"hit": np.arange(len(way))}
                    if named:
                        columns |= {"read_id": batch.column("ids")[i].values.to_numpy()[read], "ord": order}
                        least = min(0, int(columns["read_id"].min(initial=0)))
                        columns["read_id"], columns["least"] = columns["read_id"] - least, np.full(len(way), -least)
                        if named == "last":
                            columns |= {c: np.where(columns["ends"] & 2, columns[c], 0) for c in ("read_id", "ord", "least")}
                    some = np.lexsort((up, way))  # keeps the order of reads
                    for part, at in P.by_part(way[some] >> 1, parts):
                        x = some[at]
                        w, u, d = way[x], up[x], down[x]
                        new = changes(w, u)
                        begin = np.flatnonzero(new)
                        # each class once, and a tail after only where it is another than that of the hit before
                        out = {"way": growing(w[begin]), "up": few(u[begin]), "n": few(np.diff(begin, append=len(x))), "down": few(np.where(changes(d), d, 0))}
                        yield {"part": [part], "grp": [grp]} | {c: [v] for c, v in (out | {c: few(v[x]) for c, v in columns.items()}).items()}

        names = ["way", "up", "n", "down", "key", "ends", *(["hit"] if found else []), *(["read_id", "ord", "least"] if named else [])]

        def run(part: int, grps, *columns) -> Iterator[dict]:
            held = dict(zip(names, columns, strict=True))
            own = [i for i, grp in enumerate(grps) if grp >= 0]
            if not own:
                return
            rows = {c: np.concatenate([x[i] for i in own]) for c, x in held.items()}
            n = rows.pop("n")
            rows["way"], rows["up"] = np.repeat(rows["way"], n), np.repeat(rows["up"], n)
            rows["down"] = rows["down"][np.maximum.accumulate(np.where(rows["down"] > 0, np.arange(len(rows["down"])), 0))]
            if found:
                rows["grp"] = np.repeat(np.array([grps[i] for i in own]), [len(held["key"][i]) for i in own])
            at = np.lexsort((rows["key"], *by_text(rows["up"]), rows["way"]))  # keeps the order of reads
            rows = {c: x[at] for c, x in rows.items()}
            way = rows["way"]
            places = _places(way, rows["up"], rows["down"])
            onward = places.pop("onward")
            out = {"node": way >> 1, "rc": way & 1, "up": rows["up"], "down": rows["down"], "first": rows["ends"] & 1 == 1, "last": rows["ends"] & 2 == 2, "middle": rows["ends"] & 4 == 4}
            out |= places
            if named:
                out |= {"read_id": rows["read_id"] - rows["least"], "ord": rows["ord"]}
            if not found:
                yield fn(out)
                return
            out |= {"grp": rows["grp"], "hit": rows["hit"], "onward": onward}
            others = [i for i, grp in enumerate(grps) if grp < 0]
            if others:
                theirs = {c: np.concatenate([held[c][i] for i in others]) for c in ("way", "up", "n", "down", "key")}
                yield fn(out, theirs["way"], theirs["up"], theirs["n"], theirs["down"] - theirs["key"])

        blobs = by_arrow(self.hits if named else self.hits.drop("ids"), deal, "part int, grp long, " + ", ".join(f"{c} binary" for c in names))
        if found:
            blobs = blobs.unionByName(self._asked(asked, names))
        return _parts(blobs, names, run, schema)

    def _asked(self, asked: DataFrame, names: list[str]) -> DataFrame:
        """Contexts (with asked_id) at tails that reads come in by, as blobs for the parts of their nodes: way, up, place (n), and
        asked_id (down, less key)."""
        parts = self.parts

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in it:
                node, turned, pos, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "turned", "edge_pos", "asked_id"))
                data, low, high = P.texts_of(batch.column("bases"))
                way, up = node * 2 + turned, _codes(data, low, high - low, False)
                least = min(0, int(ids.min(initial=0)))
                some = np.argsort(way, kind="stable")
                for part, at in P.by_part(way[some] >> 1, parts):
                    x = some[at]
                    out = {"way": growing(way[x]), "up": few(up[x]), "n": few(pos[x]), "down": few(ids[x] - least), "key": few(np.full(len(x), -least))}
                    yield {"part": [part], "grp": [-1]} | {c: [out.get(c, few(np.zeros(1, np.int64)))] for c in names}

        coming = asked.where((F.col("side") == F.when(F.col("dir") == "F", "P").otherwise("S")) & (F.col("edge_pos") >= 0) & (F.length("bases") <= MOST))
        rows = coming.select("asked_id", "node", (F.col("dir") == "R").cast("long").alias("turned"), "bases", F.col("edge_pos").cast("long").alias("edge_pos"))
        return by_arrow(rows, run, "part int, grp long, " + ", ".join(f"{c} binary" for c in names))

    def positions(self) -> DataFrame:
        """(read_id, ord, node, dir, up_tail, down_tail, node_pos, up_pos, down_pos) of every step of every read."""
        return self.each_part(lambda r: {"read_id": r["read_id"], "ord": r["ord"]} | _placed(r), "read_id long, ord int, " + PLACED, named=True)

    def each(self) -> DataFrame:
        """positions without the reads."""
        return self.each_part(_placed, PLACED)

    def sequences(self) -> DataFrame:
        """(node, dir, node_pos, seq): `retrieval.extracted` of the contexts of all routes at their tails before, with the node."""
        k = self.k

        def run(r: dict) -> dict:
            n = bases_of(r["up"])
            tail = 1 << 2 * n | P.reverse_ids(r["up"] - (1 << 2 * n), MOST) >> 2 * (MOST - n)
            own = P.strings_of(np.where(r["rc"] == 1, P.reverse_ids(r["node"], k), r["node"]), k)
            seq = pc.binary_join_element_wise(_texts(tail, n), own.cast(pa.large_string()), pa.scalar("", pa.large_string()))
            return {"node": r["node"], "dir": _dir(r["rc"]), "node_pos": r["node_pos"], "seq": seq}

        return self.each_part(run, "node long, dir string, node_pos long, seq string")

    def runs(self) -> DataFrame:
        """Routes in order, equal neighbours as one: (node, dir, run, up_tail, down_tail, width, and the places of the first one:
        node_pos, up_pos, down_pos)."""
        return self.each_part(lambda r: (lambda s: _placed(s) | {"run": s["run"], "width": s["width"]})(_runs(r)), RUNS)

    def tables(self, tagged: DataFrame | None, last: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
        """tails, routes and, of (read_id, tag), tags, and what they are read from: routes that are dealt once for all three and kept in
        a row for each part. last: nothing else is asked of this order, so it is removed."""
        k = self.k

        def pack(r: dict) -> dict:
            ids = r["read_id"][r["last"]]
            least = min(0, int(ids.min(initial=0)))
            return {"way": [growing(r["node"] * 2 + r["rc"])], "up": [few(r["up"])], "down": [few(r["down"])], "ends": [few(r["first"] + 2 * r["last"])], "ids": [few(ids - least)], "least": [least]}

        placed = cut(self.each_part(pack, "way binary, up binary, down binary, ends binary, ids binary, least long", named="last"), "placed")
        if last:
            dropped(self.state)
        freed(placed.sparkSession)

        def each(fn: Callable, schema: str) -> DataFrame:
            def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
                for batch in it:
                    for raw, least, *rest in zip(*(batch.column(c).to_pylist() for c in ("way", "least", "up", "down", "ends", "ids")), strict=True):
                        way, (up, down, ends, ids) = of_growing(raw), map(of_few, rest)
                        yield fn({"node": way >> 1, "rc": way & 1, "up": up, "down": down, "first": ends & 1 == 1, "last": ends & 2 == 2}, ids + least)

            return by_arrow(placed, run, schema)

        def tails(r: dict, ids: np.ndarray) -> dict:
            code, rc = np.concatenate([r["up"], r["down"]]), np.tile(r["rc"], 2)
            some = np.flatnonzero(code > 1)
            key = np.concatenate([r["rc"], 1 - r["rc"]]) << SIDE | code << 1 | np.concatenate([~r["first"], ~r["last"]])
            return tail_rows(*_summed(np.tile(r["node"], 2)[some], key[some], 1 - rc[some], rc[some]), k)

        def runs(r: dict, ids: np.ndarray) -> dict:
            s = _runs({c: r[c] for c in ("node", "rc", "up", "down")} | _places(r["node"] * 2 + r["rc"], r["up"], r["down"]))
            return _placed(s) | {"run": s["run"], "width": s["width"]}

        def ends(r: dict, ids: np.ndarray) -> dict:
            last = r["last"]
            return {"read_id": ids, "node": r["node"][last], "dir": _dir(r["rc"][last]), "node_pos": since(changes(r["node"] * 2 + r["rc"]))[last]}

        out = {"tails": each(tails, tail_schema()), "routes": each(runs, RUNS)}
        if tagged is not None:
            out["tags"] = each(ends, "read_id long, node long, dir string, node_pos long").join(tagged, "read_id").select("node", "dir", "node_pos", "tag")
        return out, placed

    def tags(self, tagged: DataFrame) -> DataFrame:
        """(node, dir, node_pos, tag) of (read_id, tag): a tag lies at the last step of its read."""

        def run(r: dict) -> dict:
            some = _some(r, r["last"])
            return some | {"dir": _dir(some["rc"])}

        return self.each_part(run, "read_id long, node long, dir string, node_pos long", named=True).join(tagged, "read_id").select("node", "dir", "node_pos", "tag")

    def middles(self) -> DataFrame:
        """(asked_id, node, dir, side, bases, edge_pos): for each read the context at its middle step, where the read comes in."""

        def run(r: dict) -> dict:
            some = _some(r, r["middle"])
            return {"asked_id": some["read_id"], "node": some["node"], "dir": _dir(some["rc"]), "side": _side(some["rc"] == 1), "bases": _tail(some["up"]), "edge_pos": some["up_pos"]}

        return self.each_part(run, "asked_id long, node long, dir string, side string, bases string, edge_pos long", named=True)

    def followed_upstream(self, asked: DataFrame, most: int) -> DataFrame:
        """`retrieval.followed_upstream`: the route of each context is found in the part of its node, and followed back in its group."""
        k = self.k

        def find(r: dict, way: np.ndarray, up: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> dict:
            at, there = _found_at(r["node"] * 2 + r["rc"], r["up"], way, up, pos)
            return {"grp": r["grp"][at[there]], "hit": r["hit"][at[there]], "asked_id": ids[there]}

        def follow(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in it:
                for i in range(batch.num_rows):
                    sizes, _, up, _ = _hits(batch, i, k)
                    order, wanted = P.owners(sizes)[1], batch.column("wanted")[i].values
                    ids, hit = (wanted.field(c).to_numpy() for c in ("asked_id", "hit"))
                    steps = np.minimum(order[hit] + 1, most)
                    for a, b in _bounded(steps):
                        owner, back = P.owners(steps[a:b])
                        yield {"asked_id": ids[a:b], "steps": steps[a:b], "seq": _joined(up[hit[a:b][owner] - back], steps[a:b])}

        found = self.each_part(find, "grp long, hit long, asked_id long", asked=asked)
        by_group = found.groupBy("grp").agg(F.collect_list(F.struct("asked_id", "hit")).alias("wanted"))
        return by_arrow(self.hits.select("grp", "sizes", "way", "gap", "up", "down").join(by_group, "grp"), follow, "asked_id long, steps int, seq string")

    def followed_once(self, asked: DataFrame) -> DataFrame:
        """`retrieval.followed_once`: over the node and along the tail after, and from there back along the same edge, whose route is
        looked for again by its tail after and the place there."""
        k = self.k

        def run(r: dict, way: np.ndarray, up: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> dict:
            at, there = _found_at(r["node"] * 2 + r["rc"], r["up"], way, up, pos)
            some = np.flatnonzero(there)
            some = some[~r["last"][at[some]]]
            s, ids = _some(r | {"onward": r["node"]}, at[some]), ids[some]
            key = (s["rc"] == 0).astype(np.int64) << SIDE | s["down"] << 1 | 1
            _, _, _, target, linked, far = _led(s["node"], key, k)
            rc = np.where(linked > 0, s["rc"], 1 - s["rc"])
            # and back: the edge from there, and the route that goes out by it
            _, _, _, node, turned, back = _led(target, far, k)
            back_rc, onward = np.where(turned > 0, rc, 1 - rc), r["onward"]
            again, held = _found_at((r["node"] * 2 + r["rc"])[onward], r["down"][onward], node * 2 + back_rc, back >> 1 & (1 << SIDE - 1) - 1, s["down_pos"])
            again = onward[again]
            same = held & ((r["node"] * 2 + r["rc"])[again] == way[some]) & (r["up"][again] == up[some]) & (r["up_pos"][again] == pos[some])
            return {"asked_id": ids, "node": target, "dir": _dir(rc), "side": _side(far >> SIDE == 1), "bases": _tail(far >> 1 & (1 << SIDE - 1) - 1), "edge_pos": s["down_pos"], "returns": same}

        return self.each_part(run, "asked_id long, node long, dir string, side string, bases string, edge_pos long, returns boolean", asked=asked)

    def reads(self) -> DataFrame:
        """(reads): how many reads begin at a route."""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in it:
                yield {"n": [np.count_nonzero(of_few(raw)) for raw in batch.column("sizes").to_pylist()]}

        return by_arrow(self.hits.select("sizes"), run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("reads"))

    def end_contexts(self, start: bool = True, end: bool = True) -> DataFrame:
        """`retrieval.end_contexts` of all routes."""

        def run(r: dict) -> dict:
            up_idx, down_idx, *_ = _numbered(r)
            parts = []
            for wanted, at, tail, pos, idx, turned in ((start, "first", "up", "up_pos", up_idx, 1), (end, "last", "down", "down_pos", down_idx, 0)):
                s = np.flatnonzero(r[at] & wanted)
                parts.append((r["node"][s], r["rc"][s], r["node_pos"][s], r["rc"][s] == turned, r[tail][s], r[pos][s], idx[s]))
            node, rc, node_pos, suffix, code, pos, idx = map(np.concatenate, zip(*parts, strict=True))
            return {"node": node, "dir": _dir(rc), "node_pos": node_pos, "side": _side(suffix), "bases": _tail(code), "edge_pos": pos, "idx": idx}

        return self.each_part(run, "node long, dir string, node_pos long, side string, bases string, edge_pos long, idx int")

    def across_edges(self) -> DataFrame:
        """`retrieval.to_linking_edge` of the contexts of all routes at their tails after: (from_node, from_dir, asked_pos, node, dir, side,
        bases, edge_pos). A tail after a read's last route leads to no node, all others do."""
        k = self.k

        def run(r: dict) -> dict:
            s = _some(r, ~r["last"])
            _, _, _, target, linked, far = _led(s["node"], (s["rc"] == 0).astype(np.int64) << SIDE | s["down"] << 1 | 1, k)
            rc = np.where(linked > 0, s["rc"], 1 - s["rc"])
            return {"from_node": s["node"], "from_dir": _dir(s["rc"]), "asked_pos": s["node_pos"], "node": target, "dir": _dir(rc), "side": _side(far >> SIDE == 1), "bases": _tail(far >> 1 & (1 << SIDE - 1) - 1), "edge_pos": s["down_pos"]}

        return self.each_part(run, "from_node long, from_dir string, asked_pos long, node long, dir string, side string, bases string, edge_pos long")

    def stats(self) -> DataFrame:
        """A row for each node that routes lead through, as smer: its tails, routes and runs."""
        k = self.k

        def run(r: dict) -> dict:
            *_, tails, suffix = _numbered(r)
            runs = _runs(r)
            nodes = r["node"][changes(r["node"])]
            n = lambda node, *weight: np.bincount(np.searchsorted(nodes, node), *weight, minlength=len(nodes)).astype(np.int64)
            out = {"smer": P.strings_of(nodes, k), "prefix_tails": n(tails[~suffix]), "suffix_tails": n(tails[suffix]), "entries": n(runs["node"])}
            for rc, name in ((0, "forward"), (1, "reverse")):
                out |= {f"{name}_entries": n(runs["node"][runs["rc"] == rc]), f"{name}_routes": n(r["node"][r["rc"] == rc])}
            return out

        names = ["prefix_tails", "suffix_tails", "entries", "forward_entries", "reverse_entries", "forward_routes", "reverse_routes"]
        return self.each_part(run, "smer string, " + ", ".join(f"{c} long" for c in names))

    def route_lists(self, limit: int) -> DataFrame:
        """`retrieval.route_lists` of all nodes."""

        def run(r: dict) -> dict:
            up_idx, down_idx, *_ = _numbered(r)
            runs = _runs(r | {"up_idx": up_idx, "down_idx": down_idx})
            nodes, total = np.unique(r["node"], return_counts=True)
            few_enough = total <= limit if limit > 0 else np.zeros(len(nodes), bool)
            runs = _some(runs, few_enough[np.searchsorted(nodes, runs["node"])])
            sizes = np.bincount(np.searchsorted(nodes, runs["node"]), minlength=len(nodes))
            turned = runs["rc"] == 1
            fields = {"dir": _dir(runs["rc"]), "run": pa.array(runs["run"]), "prefix": pa.array(np.where(turned, runs["down_idx"], runs["up_idx"]).astype(np.int32)), "suffix": pa.array(np.where(turned, runs["up_idx"], runs["down_idx"]).astype(np.int32)), "width": pa.array(runs["width"])}
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.StructArray.from_arrays(list(fields.values()), list(fields)), mask=pa.array(~few_enough))
            return {"node": nodes, "total": total, "routes": lists}

        return self.each_part(run, "node long, total long, routes array<struct<dir: string, run: long, prefix: int, suffix: int, width: long>>")


def _some(r: dict, which: np.ndarray) -> dict:
    return {c: x[which] for c, x in r.items()}


def _found_at(way: np.ndarray, tail: np.ndarray, asked_way: np.ndarray, asked_tail: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of routes that lie together by way and tail, that of each way, tail and place, and whether there is one."""
    begin = np.flatnonzero(changes(way, tail))
    n, sizes = len(begin), np.diff(begin, append=len(way))
    w, t = np.concatenate([way[begin], asked_way]), np.concatenate([tail[begin], asked_tail])
    order = np.lexsort((t, w))  # a class comes before those who ask for it
    last = np.maximum.accumulate(np.where(order < n, np.arange(len(order)), 0))
    owner = np.empty(len(order), np.int64)
    owner[order] = order[last]
    owner = owner[n:]
    there = owner < n
    owner = np.where(there, owner, 0)
    there &= (way[begin][owner] == asked_way) & (tail[begin][owner] == asked_tail) & (pos < sizes[owner])
    return np.where(there, begin[owner] + pos, 0), there


def _bounded(steps: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Stretches of rows with about so many steps."""
    group = (np.cumsum(steps) - steps) // most
    begin = np.flatnonzero(changes(group))
    return zip(begin.tolist(), np.append(begin[1:], len(steps)).tolist(), strict=True)


def _joined(code: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Reverse complements of tails, so many a row, joined by '-'."""
    n = bases_of(code)
    turned = 1 << 2 * n | P.reverse_ids(code - (1 << 2 * n), MOST) >> 2 * (MOST - n)
    owner, at = P.owners(n + 1)
    last = at == n[owner]
    letters = np.where(last, np.uint8(ord("-")), P.BASES[turned[owner] >> 2 * np.maximum(n[owner] - 1 - at, 0) & 3])
    ends = np.cumsum(n + 1)[np.cumsum(sizes) - 1] if len(sizes) else np.empty(0, np.int64)
    keep = np.ones(len(letters), bool)
    keep[ends - 1] = False  # none after the last
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate([[0], ends - np.arange(1, len(ends) + 1)]).astype(np.int64)), pa.py_buffer(letters[keep]))


def _numbered(r: dict) -> tuple[np.ndarray, ...]:
    """The numbers of the tails before and after each route, as in `graph.tails` (0: no tail); the nodes of all tails, and whether they
    are on side S."""
    n = len(r["node"])
    node, code = np.tile(r["node"], 2), np.concatenate([r["up"], r["down"]])
    suffix = np.concatenate([r["rc"] == 1, r["rc"] == 0])
    order = np.lexsort((code, suffix, node))  # codes are in order of length and bases
    node, code, side = node[order], code[order], suffix[order]
    new, some = changes(node, side, code), changes(node, side)
    number = np.cumsum(new & (code > 1))  # 1 is no tail
    begins = number - (new & (code > 1))
    idx = np.empty(2 * n, np.int64)
    idx[order] = np.where(code > 1, number - np.maximum.accumulate(np.where(some, begins, 0)), 0)
    held = new & (code > 1)
    return idx[:n], idx[n:], node[held], side[held]


PLACED = "node long, dir string, up_tail string, down_tail string, node_pos long, up_pos long, down_pos long"
RUNS = "node long, dir string, run long, up_tail string, down_tail string, width long, node_pos long, up_pos long, down_pos long"


def _places(way: np.ndarray, up: np.ndarray, down: np.ndarray) -> dict:
    """The places of routes in order, and onward, their order by tail after."""
    onward = np.lexsort((down, way))  # keeps the order of routes
    down_pos = np.empty(len(way), np.int64)
    down_pos[onward] = since(changes(way[onward], down[onward]))
    return {"node_pos": since(changes(way)), "up_pos": since(changes(way, up)), "down_pos": down_pos, "onward": onward}


def _dir(rc: np.ndarray) -> pa.Array:
    return pa.array(np.where(rc == 1, "R", "F"), pa.string())


def _tail(code: np.ndarray) -> pa.Array:
    return _texts(code, bases_of(code))


def _placed(r: dict) -> dict:
    return {"node": r["node"], "dir": _dir(r["rc"]), "up_tail": _tail(r["up"]), "down_tail": _tail(r["down"])} | {c: r[c] for c in ("node_pos", "up_pos", "down_pos")}


def _runs(r: dict) -> dict:
    """The first route of each run, its number in its way, and how many routes it has."""
    new_way, new = changes(r["node"], r["rc"]), changes(r["node"], r["rc"], r["up"], r["down"])
    at = np.flatnonzero(new)
    return {c: x[at] for c, x in r.items()} | {"run": since(new_way[at]), "width": np.diff(at, append=len(new))}
