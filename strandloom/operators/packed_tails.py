"""Tails and edges of reads whose own nodes lie at most k bases apart, straight from the reads and in arrays.

A tail is a number: a 1 and two bits a base, so that the order of numbers is that of length and bases. A tail between two
hits of a read leads to the later one, which is a node; one at the end of a read leads to none. So whether a tail is linked is known
where it is found. Each group of reads sends its tails, each once with its counts, to the parts of their nodes, or of
the lesser node of the edge, where both its ends meet; a part is then numbered, summed and compared in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import packed as P
from ..functions.sequences import K
from .graph import PART_NODES, _stretch, dealt_nodes, searched
from .lineage import by_arrow, cut, dropped, freed, kept

#: Bases of a tail that a number holds; the bit of its side (1: S) in a key, which ends in whether it is linked.
MOST, SIDE = 30, 62


#: Bytes from which on numbers are compressed, and the mark of those that are.
SMALL, PRESSED = 256, 0x80


def few(x: np.ndarray) -> bytes:
    """Numbers from 0 up: how many bytes they need, then the first byte of each, the second of each, and so on; compressed if there are
    many."""
    n = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    raw = x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()
    if len(raw) < SMALL:
        return bytes([n]) + raw
    return bytes([n | PRESSED]) + len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def of_few(raw: bytes) -> np.ndarray:
    n = raw[0] & ~PRESSED
    body = pa.decompress(raw[5:], int.from_bytes(raw[1:5], "little"), codec="zstd") if raw[0] & PRESSED else raw[1:]
    body = np.frombuffer(body, np.uint8).reshape(n, -1)
    out = np.zeros((body.shape[1], 8), np.uint8)
    out[:, :n] = body.T
    return out.view("<i8").ravel()


def _codes(data: np.ndarray, first: np.ndarray, n: np.ndarray, reverse: bool) -> np.ndarray:
    """The numbers of stretches of n bases from first on, or of their reverse complements, from first backwards."""
    out = np.ones(len(n), np.int64)
    for i in range(int(n.max(initial=0))):
        some = np.flatnonzero(n > i)
        base = P.CODE[data[first[some] - i if reverse else first[some] + i]].astype(np.int64)
        out[some] = out[some] << 2 | (3 - base if reverse else base)
    return out


def bases_of(code: np.ndarray) -> np.ndarray:
    """How many bases tails have."""
    return (np.frexp(code.astype(np.float64))[1].astype(np.int64) - 1) // 2


def _tails(way: np.ndarray, gap: np.ndarray, sizes: np.ndarray, first: np.ndarray, last: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The tails before and after each hit, gap bases after the hit before. Between two hits they are ends of the nodes there, so only the
    first and the last tail of each read are kept."""
    has = np.flatnonzero(sizes)
    ends = np.cumsum(sizes)[has]
    begins, node = ends - sizes[has], way >> 1
    shown = np.where(way & 1 == 1, P.reverse_ids(node, k), node)
    up, down, n = np.ones(len(way), np.int64), np.ones(len(way), np.int64), gap[1:]
    up[1:] = 1 << 2 * n | P.reverse_ids(shown[:-1] >> 2 * (k - n), MOST) >> 2 * (MOST - n)
    down[:-1] = 1 << 2 * n | shown[1:] & (1 << 2 * n) - 1
    up[begins], down[ends - 1] = first, last
    return up, down


def _around(data: np.ndarray, low: np.ndarray, high: np.ndarray, read: np.ndarray, pos: np.ndarray, node: np.ndarray, rc: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of hits in order: the tails before and after, and which hits are the first and the last of their reads."""
    order, before, after = _stretch(low, high, read, pos, k)
    if max((pos - before).max(initial=0), (after - pos).max(initial=0)) > min(k, MOST):
        raise ValueError("a tail is longer than a node")
    first, last = order == 0, np.diff(read, append=-1) != 0
    head, end, begin = np.flatnonzero(first), np.flatnonzero(last), low[read]
    up, down = _codes(data, (begin + pos - 1)[head], pos[head], True), _codes(data, (begin + pos + k)[end], (after - pos)[end], False)
    return *_tails(node * 2 + rc, np.where(first, 0, pos - before), np.bincount(read, minlength=len(low)), up, down, k), first, last


def _summed(node: np.ndarray, key: np.ndarray, forward: np.ndarray, reverse: np.ndarray) -> tuple[np.ndarray, ...]:
    """In order of node and key, each once with the sums."""
    order = np.lexsort((key, node))
    node, key = node[order], key[order]
    at = np.flatnonzero(np.concatenate([[True], (np.diff(node) != 0) | (np.diff(key) != 0)])[: len(node)])
    if not len(at):
        return node, key, forward, reverse
    return node[at], key[at], np.add.reduceat(forward[order], at), np.add.reduceat(reverse[order], at)


def _planes(x: np.ndarray) -> bytes:
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _of_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _led(node: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of tails: bases, number, whether on side S, target, link (1 or -1; 0: none), and the key of the far end."""
    suffix, code = key >> SIDE == 1, key >> 1 & (1 << SIDE - 1) - 1
    n = bases_of(code)
    own = np.where(suffix, node, P.reverse_ids(node, k))
    bits = code - (1 << 2 * n)
    t = ((own.astype(np.uint64) << (2 * n).astype(np.uint64) | bits.astype(np.uint64)) & np.uint64((1 << 2 * k) - 1)).astype(np.int64)
    u = P.reverse_ids(t, k)
    linked = np.where(key & 1 == 0, 0, np.where(suffix == (t < u), 1, -1))
    back = P.reverse_ids(own >> 2 * (k - n), MOST) >> 2 * (MOST - n)  # as many bases of the node, read from the far end
    far = (u < t).astype(np.int64) << SIDE | (1 << 2 * n | back) << 1 | 1
    return n, code, suffix, np.minimum(t, u), linked, far


def _dealt(reads: DataFrame, nodes: DataFrame, k: int, by_edge: bool, fn: Callable, schema: str) -> DataFrame:
    """What fn(node, key, forward, reverse) gives for each part."""
    parts = 1 << (2 * max(0, nodes.count() - 1) // PART_NODES).bit_length()

    def found(ids, data, low, high, read, pos, node, rc) -> Iterator[dict]:
        up, down, first, last = _around(data, low, high, read, pos, node, rc, k)
        code = np.concatenate([up, down])
        key = np.concatenate([rc, ~rc]).astype(np.int64) << SIDE | code << 1 | np.concatenate([~first, ~last])
        some = np.flatnonzero(code > 1 if not by_edge else (code > 1) & (key & 1 == 1))
        turned = np.concatenate([rc, rc])[some].astype(np.int64)
        node, key, forward, reverse = _summed(np.concatenate([node, node])[some], key[some], 1 - turned, turned)
        where = np.minimum(node, _led(node, key, k)[3]) if by_edge else node
        dealt = list(P.by_part(where, parts))
        put = {"part": [p for p, _ in dealt], "node": [P.coded(node[at]) for _, at in dealt]}
        yield put | {c: [_planes(x[at]) for _, at in dealt] for c, x in (("key", key), ("forward", forward), ("reverse", reverse))}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, held = None, []

        def whole() -> dict:
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            return fn(*_summed(*rows))

        for batch in it:
            for part, node, *rest in zip(*(batch.column(c).to_pylist() for c in ("part", "node", "key", "forward", "reverse")), strict=True):
                if part != now and held:
                    yield whole()
                now = part
                held.append((P.decoded(node), *map(_of_planes, rest)))
        if held:
            yield whole()

    blobs = searched(reads, kept(nodes, "nodes"), found, "part int, node binary, key binary, forward binary, reverse binary", k)
    return by_arrow(blobs.repartition("part").sortWithinPartitions("part"), run, schema)


def _texts(code: np.ndarray, n: np.ndarray) -> pa.Array:
    m = int(n.max(initial=0))
    held = P.letters_of(code.view(np.uint64) << (64 - 2 * n).astype(np.uint64), m)
    letters = held[np.arange(m) < n[:, None]]
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(np.concatenate([[0], np.cumsum(n)])), pa.py_buffer(letters))


def _side(suffix: np.ndarray) -> pa.Array:
    return pa.array(np.where(suffix, "S", "P"), pa.string())


def tail_rows(node: np.ndarray, key: np.ndarray, forward: np.ndarray, reverse: np.ndarray, k: int, spelled: bool = False) -> dict:
    """The columns of `tails`, of tails in order, each once."""
    n, code, suffix, target, linked, _ = _led(node, key, k)
    new = _first_of(node, suffix)
    idx = np.arange(len(node)) - np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    names = {"smer": P.strings_of(node, k), "target": P.strings_of(target, k)} if spelled else {"node": node, "target": target}
    return names | {"side": _side(suffix), "idx": idx, "len": n, "bases": _texts(code, n), "forward": forward, "reverse": reverse, "linked": linked}


def tail_schema(spelled: bool = False) -> str:
    own, kind = ("smer", "string") if spelled else ("node", "long")
    return f"{own} {kind}, side string, idx int, len int, bases string, forward long, reverse long, target {kind}, linked int"


def tails(reads: DataFrame, nodes: DataFrame, k: int = K, spelled: bool = False) -> DataFrame:
    """`graph.tail_targets` of the tails of these reads by their own nodes. spelled: with the bases of node (as smer) and target."""
    return _dealt(reads, nodes, k, False, lambda *rows: tail_rows(*rows, k, spelled), tail_schema(spelled))


def edges(reads: DataFrame, nodes: DataFrame, k: int = K) -> DataFrame:
    """`graph.edges` of these tails."""

    def run(node, key, forward, reverse) -> dict:
        n, code, suffix, target, linked, far = _led(node, key, k)
        new = np.concatenate([[True], (np.diff(node) != 0) | (np.diff(suffix.astype(int)) != 0)])
        idx = np.arange(len(node)) - np.flatnonzero(new)[np.cumsum(new) - 1] + 1
        s = np.flatnonzero(linked)
        far_code = far[s] >> 1 & (1 << SIDE - 1) - 1
        return {"node": node[s], "side": _side(suffix[s]), "idx": idx[s], "bases": _texts(code[s], n[s]), "target": target[s], "linked": linked[s], "far_side": _side(far[s] >> SIDE == 1), "far_bases": _texts(far_code, n[s])}

    return _dealt(reads, nodes, k, False, run, "node long, side string, idx int, bases string, target long, linked int, far_side string, far_bases string")


def _at_far_end(node: np.ndarray, key: np.ndarray, forward: np.ndarray, reverse: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each edge has a far end, and whether its counts are those there (directions swap where the link is -1)."""
    _, _, _, target, linked, far = _led(node, key, k)
    own_nodes, own_keys = np.unique(node), np.unique(key)

    def place(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(among, values), len(among) - 1)
        return at, among[at] == values

    own = place(node, own_nodes)[0] * len(own_keys) + place(key, own_keys)[0]  # in order, as node and key are
    (a, has_node), (b, has_key) = place(target, own_nodes), place(far, own_keys)
    at, there = place(a * len(own_keys) + b, own)
    f, r = np.where(linked > 0, forward[at], reverse[at]), np.where(linked > 0, reverse[at], forward[at])
    there &= has_node & has_key
    return there, there & (forward == f) & (reverse == r)


def agreeing(node: np.ndarray, key: np.ndarray, forward: np.ndarray, reverse: np.ndarray, k: int) -> np.ndarray:
    """Whether the counts of each edge are those of its far end."""
    return _at_far_end(node, key, forward, reverse, k)[1]


def edge_widths(reads: DataFrame, nodes: DataFrame, k: int = K) -> DataFrame:
    """`graph.edge_widths` of these edges."""

    def run(node, key, forward, reverse) -> dict:
        n, code, suffix, target, linked, _ = _led(node, key, k)
        return {"node": node, "side": _side(suffix), "bases": _texts(code, n), "target": target, "linked": linked, "forward": forward, "reverse": reverse, "agrees": agreeing(node, key, forward, reverse, k)}

    return _dealt(reads, nodes, k, True, run, "node long, side string, bases string, target long, linked int, forward long, reverse long, agrees boolean")


def edge_check(reads: DataFrame, nodes: DataFrame, k: int = K) -> DataFrame:
    """(n_edges, violations): edges, and how many have other counts at the far end."""

    def run(node, key, forward, reverse) -> dict:
        return {"n": np.array([len(node)]), "bad": np.array([np.count_nonzero(~agreeing(node, key, forward, reverse, k))])}

    return _dealt(reads, nodes, k, True, run, "n long, bad long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"), F.coalesce(F.sum("bad"), F.lit(0)).alias("violations"))


def routes(reads: DataFrame, nodes: DataFrame, k: int = K) -> DataFrame:
    """`graph.routes` of the steps of these reads: each group sends its routes, each once with its count, to the parts of their nodes."""
    parts = 1 << (2 * max(0, nodes.count() - 1) // PART_NODES).bit_length()

    def summed(node: np.ndarray, up: np.ndarray, down: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((down, up, node))
        node, up, down = node[order], up[order], down[order]
        at = np.flatnonzero(np.concatenate([[True], (np.diff(node) != 0) | (np.diff(up) != 0) | (np.diff(down) != 0)])[: len(node)])
        return (node[at], up[at], down[at], np.add.reduceat(width[order], at)) if len(at) else (node, up, down, width)

    def found(ids, data, low, high, read, pos, node, rc) -> Iterator[dict]:
        up, down, *_ = _around(data, low, high, read, pos, node, rc, k)
        node, up, down, width = summed(node, up << 1 | rc, down, np.ones(len(pos), np.int64))
        dealt = list(P.by_part(node, parts))
        put = {"part": [p for p, _ in dealt], "node": [P.coded(node[at]) for _, at in dealt]}
        yield put | {c: [_planes(x[at]) for _, at in dealt] for c, x in (("up", up), ("down", down), ("width", width))}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, held = None, []

        def whole() -> dict:
            node, up, down, width = summed(*[np.concatenate(x) for x in zip(*held, strict=True)])
            held.clear()
            up_tail, down_tail = (_texts(c, bases_of(c)) for c in (up >> 1, down))
            return {"node": node, "dir": pa.array(np.where(up & 1, "R", "F"), pa.string()), "up_tail": up_tail, "down_tail": down_tail, "width": width}

        for batch in it:
            for part, node, *rest in zip(*(batch.column(c).to_pylist() for c in ("part", "node", "up", "down", "width")), strict=True):
                if part != now and held:
                    yield whole()
                now = part
                held.append((P.decoded(node), *map(_of_planes, rest)))
        if held:
            yield whole()

    blobs = searched(reads, kept(nodes, "nodes"), found, "part int, node binary, up binary, down binary, width binary", k)
    return by_arrow(blobs.repartition("part").sortWithinPartitions("part"), run, "node long, dir string, up_tail string, down_tail string, width long")


CHECKS = ["tail_without_node", "tail_twice", "route_without_tail", "edge_without_far_tail", "edge_width"]


def _first_of(*columns: np.ndarray) -> np.ndarray:
    """Of rows in order, which differ from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def lacking(node: np.ndarray, tail: np.ndarray, own_node: np.ndarray, own_tail: np.ndarray) -> int:
    """How many pairs, each counted once, are not among one's own."""
    n, t, asked = np.concatenate([own_node, node]), np.concatenate([own_tail, tail]), np.repeat([0, 1], [len(own_node), len(node)])
    order = np.lexsort((asked, t, n))
    return int(asked[order][_first_of(n[order], t[order])].sum())


def checked_nodes(nodes: np.ndarray, node: np.ndarray, key: np.ndarray, way: np.ndarray, up: np.ndarray, down: np.ndarray) -> dict[str, int]:
    """Violations in a part: its nodes, its tails (in order) and the tails that its routes have on both sides. A key's last bit tells a
    tail that is linked from one that isn't."""
    tail = key >> 1
    twice = ~_first_of(node, tail)
    used = np.concatenate([up, down])
    side = np.concatenate([way & 1, 1 - (way & 1)])
    some = np.flatnonzero(used > 1)
    return {
        "tail_without_node": int((~np.isin(node, nodes)).sum()), "tail_twice": int((twice & np.append(~twice[1:], True)).sum()),
        "route_without_tail": lacking(np.tile(way >> 1, 2)[some], (side << SIDE - 1 | used)[some], node, tail),
    }


def checked_edges(node: np.ndarray, key: np.ndarray, forward: np.ndarray, reverse: np.ndarray, k: int) -> dict[str, int]:
    """Violations among tails that lie with those at their far ends; only linked ones are edges."""
    linked = key & 1 == 1
    edge = node[linked], key[linked] >> 1
    n, t, f, r = _summed(node, key | 1, forward, reverse)
    _, same = _at_far_end(n, t, f, r, k)
    _, _, _, target, _, far = _led(node[linked], key[linked], k)
    wrong = np.flatnonzero(~same)
    order = np.lexsort((np.repeat([0, 1], [len(wrong), len(edge[0])]), np.concatenate([t[wrong] >> 1, edge[1]]), np.concatenate([n[wrong], edge[0]])))
    a, b, asked = np.concatenate([n[wrong], edge[0]])[order], np.concatenate([t[wrong] >> 1, edge[1]])[order], (order >= len(wrong))
    first = np.maximum.accumulate(np.where(_first_of(a, b), np.arange(len(a)), 0)) if len(a) else np.empty(0, np.int64)
    return {"edge_without_far_tail": lacking(target, far >> 1, n, t >> 1), "edge_width": int((asked & ~asked[first]).sum())}


def checks(reads: DataFrame, nodes: DataFrame, k: int = K) -> DataFrame:
    """`retrieval.validation` of the tails, edges and routes of these reads by their own nodes, in two deals: tails and routes to the parts
    of their nodes, then tails to the part of the lesser node of their edge. Only counts of violations are given out."""
    nodes = kept(nodes, "nodes")
    parts = 1 << (2 * max(0, nodes.count() - 1) // PART_NODES).bit_length()
    blobs = "part int, kind int, node binary, a binary, b binary, c binary"

    def tails_of(data, low, high, read, pos, node, rc) -> tuple[np.ndarray, ...]:
        up, down, first, last = _around(data, low, high, read, pos, node, rc, k)
        code = np.concatenate([up, down])
        key = np.concatenate([rc, ~rc]).astype(np.int64) << SIDE | code << 1 | np.concatenate([~first, ~last])
        some = np.flatnonzero(code > 1)
        turned = np.concatenate([rc, rc])[some].astype(np.int64)
        return up, down, _summed(np.concatenate([node, node])[some], key[some], 1 - turned, turned)

    def put(kind: int, where: np.ndarray, node: np.ndarray, *rest: np.ndarray) -> dict:
        dealt = list(P.by_part(where, parts))
        rest += (np.zeros(len(node), np.int64),) * (3 - len(rest))
        return {"part": [p for p, _ in dealt], "kind": [kind] * len(dealt), "node": [few(np.diff(node[at], prepend=0)) for _, at in dealt]} | {c: [few(x[at]) for _, at in dealt] for c, x in zip("abc", rest, strict=True)}

    def turn(key: np.ndarray) -> np.ndarray:
        """The side as the last bit, so that few bytes are enough."""
        return (key & (1 << SIDE) - 1) << 1 | key >> SIDE

    def back(x: np.ndarray) -> np.ndarray:
        return (x & 1) << SIDE | x >> 1

    def by_node(ids, data, low, high, read, pos, node, rc) -> Iterator[dict]:
        up, down, (n, key, *_) = tails_of(data, low, high, read, pos, node, rc)
        yield put(1, n, n, turn(key))
        way = node * 2 + rc
        order = np.lexsort((down, up, way))
        order = order[_first_of(way[order], up[order], down[order])]
        yield put(2, node[order], way[order], up[order], down[order])

    def by_edge(ids, data, low, high, read, pos, node, rc) -> Iterator[dict]:
        *_, (n, key, forward, reverse) = tails_of(data, low, high, read, pos, node, rc)
        yield put(1, np.minimum(n, _led(n, key, k)[3]), n, turn(key), forward, reverse)

    def in_parts(rows: DataFrame, fn: Callable) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            now, held = None, {0: [], 1: [], 2: []}

            def whole() -> dict:
                none = (np.empty(0, np.int64),) * 4
                out = fn(*([np.concatenate(x) for x in zip(none, *own, strict=True)] for own in held.values()))
                for own in held.values():
                    own.clear()
                return {"check": list(out), "violations": list(out.values())}

            for batch in it:
                for part, kind, node, *rest in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "node", "a", "b", "c")), strict=True):
                    if part != now and now is not None:
                        yield whole()
                    now = part
                    held[kind].append((np.cumsum(of_few(node)), *map(of_few, rest)))
            if now is not None:
                yield whole()

        return cut(by_arrow(rows.repartition("part").sortWithinPartitions("part"), run, "check string, violations long"), "checks")

    def with_nodes(own: list, tails: list, routes: list) -> dict[str, int]:
        node, key, *_ = _summed(tails[0], back(tails[1]), tails[2], tails[3])
        return checked_nodes(own[0], node, key, *routes[:3])

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = P.decoded(raw)
                yield {"part": [part], "kind": [0], "node": [few(np.diff(ids, prepend=0))]} | {c: [few(np.zeros(len(ids), np.int64))] for c in "abc"}

    found = searched(reads, nodes, by_node, blobs, k)
    one = in_parts(found.unionByName(by_arrow(dealt_nodes(nodes, parts), split, blobs)), with_nodes)
    freed(reads.sparkSession)
    two = in_parts(found.each(by_edge, blobs), lambda own, tails, routes: checked_edges(*_summed(tails[0], back(tails[1]), tails[2], tails[3]), k))
    dropped(*found.also)
    zero = reads.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, CHECKS))).alias("check"), F.lit(0).cast("long").alias("violations"))
    return one.unionByName(two).unionByName(zero).groupBy("check").agg(F.sum("violations").alias("violations"))
