"""Reads walked again from the runs of routes alone, in arrays.

Routes get numbers in order of their parts (by node), ways and places. The routes of a way that go on by one tail arrive by one tail at
one way, in the same order, so each class is sent once, with the numbers of its routes, to the part of the node that it leads to, and each
route learns the number of the one before it on its read. These numbers are lists, one for each read. One task follows lists of up
to TOGETHER routes; longer ones are made shorter before: a route whose hash is less than those of its neighbours is taken over by the
one before, a third of them in a round, and is told its place afterwards. Places are slots in which all reads lie one after the
other; the tails go to their slots in chunks of whole reads, and are spelled there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import packed as P
from ..functions.sequences import K
from .graph import PART_NODES
from .lineage import by_arrow, cut, dropped, freed
from .packed_routes import _dir, _found_at, _parts, changes, growing, of_growing, since
from .packed_tails import MOST, SIDE, _codes, _led, _texts, bases_of, few, of_few

#: Routes that one task follows; runs that are dealt together; steps that are spelled together; reads that are followed one by one.
TOGETHER, DEALT, CHUNK, ALONE = 1 << 24, 1 << 18, 1 << 20, 16

COUNTS = "part int, n long, n_linked long, n_slots long, "


def _binary(*names: str) -> str:
    return ", ".join(f"{c} binary" for c in names)


def _held(runs: DataFrame, parts: int) -> DataFrame:
    """(part, n, longest, way, up, down, width): the runs of each part in order, how many routes they have, and bases of the longest tail."""
    names = ["way", "run", "up", "down", "width", "longest"]

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple] = []

        def out() -> dict:
            way, run, up, down, width, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((run, way))
            dealt = [(p, order[x]) for p, x in P.by_part(way[order] >> 1, parts)]
            columns = {"way": [growing(way[x]) for _, x in dealt]} | {c: [few(v[x]) for _, x in dealt] for c, v in (("run", run), ("up", up), ("down", down), ("width", width))}
            return {"part": [p for p, _ in dealt], "grp": [0] * len(dealt), "longest": [few(n.max(keepdims=True))] * len(dealt)} | columns

        for batch in it:
            node, turned, run, width = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("node", "turned", "run", "width"))
            codes, longest = [], np.zeros(len(node), np.int64)
            for c in ("up_tail", "down_tail"):
                data, low, high = P.texts_of(batch.column(c))
                longest = np.maximum(longest, high - low)
                codes.append(_codes(data, low, np.minimum(high - low, MOST), False))
            held.append((node * 2 + turned, run, *codes, width, longest))
            if sum(len(x[0]) for x in held) >= DEALT:
                yield out()
        if held and sum(len(x[0]) for x in held):
            yield out()

    def merge(part: int, grps, *columns) -> Iterator[dict]:
        way, run, up, down, width, longest = map(np.concatenate, columns)
        at = np.lexsort((run, way))
        yield {"part": [part], "n": [int(width.sum())], "longest": [int(longest.max())], "way": [growing(way[at])]} | {c: [few(x[at])] for c, x in (("up", up), ("down", down), ("width", width))}

    rows = runs.select("node", (F.col("dir") == "R").cast("int").alias("turned"), "run", "up_tail", "down_tail", "width")
    return cut(_parts(by_arrow(rows, deal, "part int, grp long, " + _binary(*names)), names, merge, "part int, n long, longest long, " + _binary("way", "up", "down", "width")), "walked")


class Numbers:
    """The numbers of routes: those of a part lie together."""

    def __init__(self, part: list[int], n: list[int]):
        self.part, self.begin = np.array(part, np.int64), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        self.of = dict(zip(part, self.begin.tolist()))
        self.total = int(self.begin[-1])

    def dealt(self, number: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each part with the places of its numbers, in their order, and these within the part."""
        order = np.argsort(number, kind="stable")
        ends = np.searchsorted(number[order], self.begin)
        for i, part in enumerate(self.part.tolist()):
            some = order[ends[i] : ends[i + 1]]
            if len(some):
                yield part, some, number[some] - self.begin[i]


def _links(held: DataFrame, numbers: Numbers, parts: int, k: int) -> DataFrame:
    """(part, n, at, prev, next, weight): for each route the number of the one before it on its read, plus 1 (0: none)."""
    names = ["way", "up", "n", "came"]

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            for part, raw, *rest in zip(*(batch.column(c).to_pylist() for c in ("part", "way", "up", "down", "width")), strict=True):
                runs, (up, down, width) = of_growing(raw), map(of_few, rest)
                yield {"part": [part], "grp": [-1], "way": [growing(runs)], "up": [few(up)], "n": [few(width)], "came": [few(width[:0])]}
                way, down = np.repeat(runs, width), np.repeat(down, width)
                some = np.flatnonzero(down > 1)
                order = some[np.lexsort((down[some], way[some]))]  # keeps the order of routes
                begin = np.flatnonzero(changes(way[order], down[order]))
                sizes = np.diff(begin, append=len(order))
                node, rc, code = way[order[begin]] >> 1, way[order[begin]] & 1, down[order[begin]]
                _, _, _, target, linked, far = _led(node, (rc == 0).astype(np.int64) << SIDE | code << 1 | 1, k)
                to = target * 2 + np.where(linked > 0, rc, 1 - rc)
                by_way = np.argsort(to, kind="stable")
                for there, x in P.by_part(to[by_way] >> 1, parts):
                    c = by_way[x]
                    owner, place = P.owners(sizes[c])
                    yield {"part": [there], "grp": [part], "way": [growing(to[c])], "up": [few(far[c] >> 1 & (1 << SIDE - 1) - 1)], "n": [few(sizes[c])], "came": [few(order[begin[c][owner] + place])]}

    def receive(part: int, grps, way, up, n, came) -> Iterator[dict]:
        if grps[0] != -1:
            return
        own_way, own_up = np.repeat(way[0], n[0]), np.repeat(up[0], n[0])
        order = np.lexsort((own_up, own_way))
        prev = np.zeros(len(order), np.int64)
        if len(grps) > 1:
            asked = [np.concatenate(x[1:]) for x in (way, up, n)]
            number = np.concatenate([x + numbers.of[grp] for grp, x in zip(grps[1:], came[1:], strict=True)])
            own_way, own_up = own_way[order], own_up[order]
            new = changes(own_way, own_up)
            size = np.diff(np.flatnonzero(new), append=len(new))[np.cumsum(new) - 1]
            at, there = _found_at(own_way, own_up, asked[0], asked[1], np.zeros(len(asked[0]), np.int64))
            owner, place = P.owners(asked[2])
            fits = np.flatnonzero(there[owner] & (place < size[at][owner]))
            prev[order[at[owner[fits]] + place[fits]]] = number[fits] + 1
        yield {"part": [part], "n": [len(prev)], "n_linked": [int((prev > 0).sum())], "n_slots": [len(prev)], "at": [growing(np.arange(len(prev)))], "prev": [few(prev)], "next": [few(np.zeros_like(prev))], "weight": [few(np.ones_like(prev))]}

    return cut(_parts(by_arrow(held, ask, "part int, grp long, " + _binary(*names)), names, receive, COUNTS + _binary("at", "prev", "next", "weight")), "links")


def _shorter(state: DataFrame, numbers: Numbers, nth: int) -> DataFrame:
    """The state after a round, with what each route took over: (taker, taken, offset). Round 0 tells routes those after them only."""
    names = ["at", "prev", "next", "weight", "taken"]

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            for part, raw, *rest in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "prev", "next", "weight")), strict=True):
                at, (prev, after, weight) = of_growing(raw), map(of_few, rest)
                own = numbers.of[part] + at
                mixed = lambda x: P.mixed(x + (nth << 40))
                gone = (prev > 0) & (mixed(own) < mixed(prev - 1)) & ((after == 0) | (mixed(own) < mixed(after - 1))) if nth else np.zeros(len(at), bool)
                stay, tell = np.flatnonzero(~gone), np.flatnonzero(gone if nth else prev > 0)
                yield {"part": [part], "grp": [-1], "at": [growing(at[stay])], "prev": [few(prev[stay])], "next": [few(after[stay])], "weight": [few(weight[stay])], "taken": [few(at[:0])]}
                onward = tell[after[tell] > 0] if nth else tell[:0]
                back = (prev[tell] - 1, np.zeros(len(tell), np.int64), after[tell] if nth else own[tell] + 1, weight[tell] * bool(nth), own[tell])
                ahead = (after[onward] - 1, np.ones(len(onward), np.int64), prev[onward], weight[onward], own[onward])
                to, kind, value, more, taken = map(np.concatenate, zip(back, ahead, strict=True))
                for there, x, place in numbers.dealt(to):
                    yield {"part": [there], "grp": [part], "at": [growing(place)], "prev": [few(kind[x])], "next": [few(value[x])], "weight": [few(more[x])], "taken": [few(taken[x])]}

    def receive(part: int, grps, *columns) -> Iterator[dict]:
        at, prev, after, weight = (np.array(x[0]) for x in columns[:4])
        place, kind, value, more, taken = (np.concatenate([x[0][:0], *x[1:]]) for x in columns)
        where = np.searchsorted(at, place)
        ahead, back = kind == 1, np.flatnonzero(kind == 0)
        prev[where[ahead]], after[where[back]] = value[ahead], value[back]
        back = back[more[back] > 0]
        back = back[np.argsort(where[back], kind="stable")]
        offset = weight[where[back]]
        weight[where[back]] += more[back]
        linked = (prev > 0) & (prev - 1 != numbers.of[part] + at)  # a list that goes round ends as one route that follows itself
        slots = int(weight[prev == 0].sum())
        yield {"part": [part], "n": [len(at)], "n_linked": [int(linked.sum())], "n_slots": [slots], "at": [growing(at)], "prev": [few(prev)], "next": [few(after)], "weight": [few(weight)], "taker": [growing(place[back])], "taken": [few(taken[back])], "offset": [few(offset)]}

    return cut(_parts(by_arrow(state, ask, "part int, grp long, " + _binary(*names)), names, receive, COUNTS + _binary("at", "prev", "next", "weight", "taker", "taken", "offset")), "links")


def follow(after: np.ndarray, first: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Of lists by the places of the items after (-1: none) and their first items: the slot of each item, lists lying one after the
    other (-1: on none that begins), and the slots at which lists begin. weight: slots that an item takes (none: one)."""

    def walk(filled: np.ndarray, slot: np.ndarray | None) -> None:
        read, item = np.arange(len(first)), first
        while len(item) > ALONE:
            if slot is not None:
                slot[item] = filled[read]
            filled[read] += 1 if weight is None else weight[item]
            item = after[item]
            on = item >= 0
            read, item = read[on], item[on]
        for r, i in zip(read.tolist(), item.tolist()):
            rest = []
            while i >= 0:
                rest.append(i)
                i = int(after[i])
            rest = np.array(rest)
            sizes = np.ones(len(rest), np.int64) if weight is None else weight[rest].astype(np.int64)
            if slot is not None:
                slot[rest] = filled[r] + np.cumsum(sizes) - sizes
            filled[r] += sizes.sum()

    sizes = np.zeros(len(first), np.int64)
    walk(sizes, None)
    begin = np.cumsum(sizes) - sizes
    slot = np.full(len(after), -1, np.int32 if sizes.sum() < 1 << 31 else np.int64)
    walk(begin.copy(), slot)
    return slot, begin


def _followed(state: DataFrame, numbers: Numbers, before: dict[int, int] | None = None) -> DataFrame:
    """(part, at, slot, cuts): for each route twice its slot plus 1, and 1 more if it is its read's first (0: on no read); rows of part -1 have
    the slots at which chunks begin. All lists are followed in one task, which gets a row for each part; before (slots of the parts before
    each part): lists have one route each, and parts are worked on by themselves."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = (x for b in it for x in zip(*(b.column(c).to_pylist() for c in ("part", "at", "prev", "weight", "n")), strict=True))
        if before is None:
            yield from together(sorted(rows, key=lambda x: numbers.of[x[0]]), 0)
            return
        for x in rows:
            yield from together([x], before[x[0]])

    def together(rows: list[tuple], more: int) -> Iterator[dict]:
        ends = np.cumsum([0, *(x[4] for x in rows)])
        whole = int(ends[-1]) == numbers.total
        own = None if whole else np.concatenate([numbers.of[x[0]] + of_growing(x[1]) for x in rows])
        after, first = np.full(ends[-1], -1, np.int32), [np.empty(0, np.int64)]
        for i, x in enumerate(rows):
            known = of_few(x[2]) - 1
            some = np.flatnonzero(known >= 0)
            after[known[some] if whole else np.searchsorted(own, known[some])] = ends[i] + some
            first.append(ends[i] + np.flatnonzero(known < 0))
            rows[i] = (x[0], x[1], None, x[3])
        del own
        weight, first = None if whole else np.concatenate([of_few(x[3]) for x in rows]), np.concatenate(first)
        slot, begin = follow(after, first, weight)
        del after, weight
        cuts = begin + more
        for i, x in enumerate(rows):
            own = slot[ends[i] : ends[i + 1]].astype(np.int64)
            own = np.where(own < 0, 0, (own + more + 1) * 2)
            own[first[slice(*np.searchsorted(first, ends[i : i + 2]))] - ends[i]] += 1
            yield {"part": [x[0]], "at": [x[1]], "slot": [few(own)], "cuts": [None]}
        yield {"part": [-1], "at": [None], "slot": [None], "cuts": [growing(cuts[changes(cuts // CHUNK)])]}

    own = state.select("part", "at", "prev", "weight", "n")
    return cut(by_arrow(own.repartition(1) if before is None else own, run, "part int, " + _binary("at", "slot", "cuts")), "slots")


def _told(slots: DataFrame, taken: DataFrame, numbers: Numbers) -> DataFrame:
    """The slots with those of what was taken over in a round."""
    names = ["at", "slot"]

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            for part, raw, raw_slot, taker, *rest in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "slot", "taker", "taken", "offset")), strict=True):
                at, slot, (number, offset) = of_growing(raw), of_few(raw_slot), map(of_few, rest)
                yield {"part": [part], "grp": [-1], "at": [raw], "slot": [raw_slot]}
                own = slot[np.searchsorted(at, of_growing(taker))]
                own = np.where(own > 0, ((own >> 1) + offset) * 2, 0)
                for there, x, place in numbers.dealt(number):
                    yield {"part": [there], "grp": [part], "at": [growing(place)], "slot": [few(own[x])]}

    def receive(part: int, grps, *columns) -> Iterator[dict]:
        at, slot = map(np.concatenate, columns)
        order = np.argsort(at, kind="stable")
        yield {"part": [part], "at": [growing(at[order])], "slot": [few(slot[order])]}

    return cut(_parts(by_arrow(slots.select("part", "at", "slot").join(taken, "part"), ask, "part int, grp long, " + _binary(*names)), names, receive, "part int, " + _binary(*names)), "slots")


def _spelled(held: DataFrame, slots: DataFrame, cuts: np.ndarray, k: int) -> DataFrame:
    """(node, dir, node_pos, steps, seq) of the reads, in chunks."""
    names = ["slot", "down", "head", "head_way", "head_up", "head_pos"]

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            for part, raw, *rest in zip(*(batch.column(c).to_pylist() for c in ("part", "way", "up", "down", "width", "slot")), strict=True):
                up, down, width, slot = map(of_few, rest)
                way, up, down = (np.repeat(x, width) for x in (of_growing(raw), up, down))
                node_pos = since(changes(way))
                order = np.argsort(slot, kind="stable")
                order = order[slot[order] > 0]
                place = (slot[order] >> 1) - 1
                ends = np.searchsorted(place, np.append(cuts, np.iinfo(np.int64).max))
                for chunk in np.flatnonzero(np.diff(ends)).tolist():
                    x, at = order[ends[chunk] : ends[chunk + 1]], place[ends[chunk] : ends[chunk + 1]] - cuts[chunk]
                    head = np.flatnonzero(slot[x] & 1)
                    first = x[head]
                    yield {"part": [chunk], "grp": [part], "slot": [growing(at)], "down": [few(down[x])], "head": [few(at[head])], "head_way": [few(way[first])], "head_up": [few(up[first])], "head_pos": [few(node_pos[first])]}

    def spell(chunk: int, grps, *columns) -> Iterator[dict]:
        slot, down, head, way, up, pos = map(np.concatenate, columns)
        order = np.argsort(head)
        head, way, up, pos = (x[order] for x in (head, way, up, pos))
        steps = np.diff(head, append=len(slot))
        nth, node, n = np.arange(len(head)), way >> 1, bases_of(up)
        # the tail before the first node, that node, and the tails after
        code = np.empty(len(slot) + 2 * len(head), np.int64)
        code[slot + 2 * np.searchsorted(head, slot, "right")] = down
        bases = np.empty(len(code), np.int64)
        code[head + 2 * nth] = 1 << 2 * n | P.reverse_ids(up - (1 << 2 * n), MOST) >> 2 * (MOST - n)
        bases[:] = bases_of(code)
        code[head + 2 * nth + 1], bases[head + 2 * nth + 1] = np.where(way & 1 == 1, P.reverse_ids(node, k), node), k
        offsets = np.concatenate([[0], np.cumsum(bases)])[np.append(head + 2 * nth, len(code))]
        seq = pa.LargeStringArray.from_buffers(len(head), pa.py_buffer(offsets), _texts(code, bases).buffers()[2])
        yield {"node": node, "dir": _dir(way & 1), "node_pos": pos, "steps": steps, "seq": seq}

    blobs = by_arrow(held.join(slots.select("part", "slot"), "part"), deal, "part int, grp long, " + _binary(*names))
    return _parts(blobs, names, spell, "node long, dir string, node_pos long, steps int, seq string")


def walks(runs: DataFrame, nodes: int, k: int = K) -> DataFrame | None:
    """`routing.walks` of these runs of so many nodes; none if a tail is longer than a number or a node holds."""
    spark = runs.sparkSession
    parts = 1 << (4 * max(0, nodes - 1) // PART_NODES).bit_length()
    held = _held(runs, parts)
    freed(spark)
    sizes = sorted(held.select("part", "n", "longest").collect())
    if max((r.longest for r in sizes), default=0) > min(k, MOST):
        dropped(held)
        return None
    numbers = Numbers([r.part for r in sizes], [r.n for r in sizes])
    state, rounds = _links(held, numbers, parts, k), []
    freed(spark)
    left, linked, before = numbers.total, True, None
    while left > TOGETHER and linked:
        new = _shorter(state, numbers, len(rounds))
        dropped(state)
        rounds.append(cut(new.select("part", "taker", "taken", "offset"), "taken"))
        state = new
        left, linked = state.agg(F.sum("n"), F.sum("n_linked")).first()
        freed(spark)
    if left > TOGETHER:
        counts = {r.part: r.n_slots for r in state.select("part", "n_slots").collect()}
        before = dict(zip(counts, (np.cumsum([0, *counts.values()])[:-1]).tolist()))
    slots = _followed(state, numbers, before)
    dropped(state)
    cuts = np.sort(np.concatenate([np.empty(0, np.int64), *(of_growing(bytes(r.cuts)) for r in slots.where("part = -1").select("cuts").collect())]))
    slots = slots.where("part >= 0")
    for taken in reversed(rounds):
        slots = _told(slots, taken, numbers)
        dropped(taken)
        freed(spark)
    return _spelled(held, slots, cuts, k)
