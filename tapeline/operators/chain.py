"""Sequential rules over a key's ordered rows, spread over blocks of positions.

A rule such as "one position at a time" or a zigzag walks row by row and carries a small state. Here each block of rows is summed up as a *map*:
which state comes out for each state that may come in. Maps are small (a few cases, each with its outcome), they compose, and composition
is associative, so the state at the start of every block follows from a prefix composition over blocks:

1. per (key, block): the block's map;
2. per (key, ``FAN`` blocks): composed maps, level by level, until a key has one;
3. downwards: from the state at the start of a group of blocks to the state at the start of each block in it;
4. per (key, block): the rule itself over the block's rows, from its own starting state.

No task ever holds more than one block's rows or ``FAN`` maps, however many rows a key has. Maps and states are arrays of doubles; positions
and ends are exact in them up to 2^53.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..session import cut

#: Rows in a block, blocks that are composed in one task.
SIZE, FAN = 4096, 256


def _ddl(df, cols):
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*cols).schema)


def block_of(pos, size=SIZE):
    return F.floor(F.col(pos) / size).cast("bigint")


def entry_states(maps, key, compose, apply, start, fan=None):
    """State at the start of each block.

    ``maps``: written rows (key, block, map). ``compose(map, map)`` and ``apply(state, map)`` work on numpy arrays; ``start``: rows (key, state),
    the state before a key's first block. Returns (key, block, state).
    """
    fan = fan or FAN
    last = maps.agg(F.max("block")).first()[0] or 0
    levels = [maps]
    while last >= fan:

        def joined(pdf):
            pdf = pdf.sort_values("block")
            m = pdf["map"].iloc[0]
            for x in pdf["map"].iloc[1:]:
                m = compose(np.asarray(m), np.asarray(x))
            out = pdf.iloc[:1].copy()
            out["block"], out["map"] = out["up"], [np.asarray(m)]
            return out.drop(columns="up")

        up = levels[-1].withColumn("up", F.floor(F.col("block") / fan).cast("bigint"))
        levels.append(cut(up.groupBy(*key, "up").applyInPandas(joined, _ddl(maps, [*key, "block", "map"])), "maps"))
        last //= fan
    states = start.select(*key, F.lit(0).cast("bigint").alias("up"), "state")
    for level in reversed(levels):
        names = [f"_{i}" for i in range(len(key))]
        known = states.select(*[F.col(k).alias(n) for k, n in zip(key, names)], "up", "state")

        def opened(maps, states):
            maps = maps.sort_values("block")
            if not len(maps) or not len(states):
                return maps[[*key, "block"]].iloc[:0].assign(state=None)
            state, out = np.asarray(states["state"].iloc[0]), []
            for m in maps["map"]:
                out.append(state)
                state = apply(state, np.asarray(m))
            t = maps[[*key, "block"]].copy()
            t["state"] = out
            return t

        child = level.withColumn("up", F.floor(F.col("block") / fan).cast("bigint"))
        found = child.groupBy(*key, "up").cogroup(known.groupBy(*names, "up")).applyInPandas(opened, _ddl(maps, [*key, "block"]) + ", state array<double>")
        states = found.withColumnRenamed("block", "up")
    return states.withColumnRenamed("up", "block")


# ------------------------------------------------------------------ one position at a time

def busy_map(starts, ends):
    """Of trades in order of their start: [thresholds, outcomes]. Busy until x coming in, the block's end state is the outcome at the first
    threshold above x, and x itself beyond the last. Found by pointer doubling over "the first trade that starts after this one has ended"."""
    n = len(starts)
    jump = np.maximum(np.arange(1, n + 1), np.searchsorted(starts, ends, side="right"))
    out = ends.copy()
    jump, out = np.append(jump, n), np.append(out, 0)
    while (jump[:n] < n).any():
        inner = jump < n
        out[inner] = out[jump[inner]]
        jump[inner] = jump[jump[inner]]
    first = np.flatnonzero(np.diff(starts, prepend=starts[0] - 1))
    return _pieces(starts[first], out[first])


def _pieces(edges, outs):
    """Neighbouring thresholds of one outcome become one."""
    keep = np.append(outs[1:] != outs[:-1], True) if len(outs) else np.zeros(0, bool)
    return np.concatenate([edges[keep], outs[keep]]).astype(float)


def busy_after(x, m):
    """Outcome of a map for each x."""
    edges, outs = np.split(m, 2)
    x = np.atleast_1d(x)
    at = np.searchsorted(edges, x, side="right")
    return np.where(at < len(edges), np.append(outs, 0)[at], x)


def busy_compose(a, b):
    edges, outs = np.split(a, 2)
    later, theirs = np.split(b, 2)
    rest = later > (edges[-1] if len(edges) else -np.inf)
    return _pieces(np.concatenate([edges, later[rest]]), np.concatenate([busy_after(outs, b), theirs[rest]]))


def one_at_a_time(trades, key, start, end, order, size=SIZE, fan=None):
    """Keep a trade only if it starts after the last kept one has ended. ``trades`` are written rows with a position ``order`` per key that rises
    with ``start``; ``start`` and ``end`` are numbers. Returns (key, ``order``) of the kept trades."""
    rows = trades.select(*key, F.col(order).alias("_at"), F.col(start).cast("double").alias("_s"), F.col(end).cast("double").alias("_e"), block_of(order, size).alias("block"))

    def summed(pdf):
        pdf = pdf.sort_values("_at")
        t = pdf[[*key, "block"]].iloc[:1].copy()
        t["map"] = [busy_map(pdf["_s"].to_numpy(), pdf["_e"].to_numpy())]
        return t

    maps = cut(rows.groupBy(*key, "block").applyInPandas(summed, _ddl(rows, [*key, "block"]) + ", map array<double>"), "busy")
    begin = maps.select(*key).distinct().withColumn("state", F.array(F.lit(float("-inf"))))
    states = entry_states(maps, key, busy_compose, lambda x, m: busy_after(x, m), begin, fan)
    names = [f"_{i}" for i in range(len(key))]
    states = states.select(*[F.col(k).alias(n) for k, n in zip(key, names)], F.col("block").alias("_b"), "state")

    def chosen(pdf, state):
        pdf = pdf.sort_values("_at")
        s, e = pdf["_s"].to_numpy(), pdf["_e"].to_numpy()
        kept, i = [], int(np.searchsorted(s, state["state"].iloc[0][0], side="right"))
        while i < len(s):
            kept.append(i)
            i = max(i + 1, int(np.searchsorted(s, e[i], side="right")))
        return pdf.iloc[kept][[*key, "_at"]]

    kept = rows.groupBy(*key, "block").cogroup(states.groupBy(*names, "_b")).applyInPandas(chosen, _ddl(rows, [*key, "_at"]))
    return kept.withColumnRenamed("_at", order)


# ------------------------------------------------------------------ percent reversals

def _reached(ext, prices, theta):
    """How many of the rising ``prices`` (times trend) a leg with this extreme turns at. For one extreme the rule is monotone in the price, to the bit."""
    return int(np.count_nonzero((ext - prices) / abs(ext) >= theta))


def _turn(px, at, trend, theta, extreme):
    """First place from ``at`` on where a leg turns, and the place of its extreme so far (-1: the incoming one). Works in stretches that double."""
    ext, where, step = extreme, -1, 64
    while at < len(px):
        x = px[at : at + step] * trend
        run = np.maximum.accumulate(np.append(ext * trend, x))
        turn = np.flatnonzero((x <= run[:-1]) & ((run[:-1] - x) / np.abs(run[:-1]) >= theta))
        to = int(turn[0]) if turn.size else len(x)
        if to and run[to] > run[0]:
            where, ext = at + int(np.argmax(x[:to])), run[to] * trend
        if turn.size:
            return at + to, where, ext
        at, step = at + len(x), step * 2
    return None, where, ext


class _Legs:
    """Walks through one block: from a turn at a place, which state the block ends in. Places are met again and again, so they are remembered."""

    def __init__(self, px, pos, theta):
        self.px, self.pos, self.theta, self.known = px, pos, theta, {}

    def end(self, place, trend):
        """State at the block's end if a leg of ``trend`` begins at ``place``: (trend, price, position)."""
        path = []
        while (place, trend) not in self.known:
            path.append((place, trend))
            turn, where, ext = _turn(self.px, place + 1, trend, self.theta, self.px[place])
            if turn is None:
                self.known[path[-1]] = (trend, ext, self.pos[where if where >= 0 else place])
                break
            place, trend = turn, -trend
        out = self.known[path[-1] if path and path[-1] in self.known else (place, trend)]
        self.known.update(dict.fromkeys(path, out))
        return out


def _side(px, pos, theta, trend, legs):
    """A block's map for one incoming trend, in prices times trend: [free, value, position, (outcome of 3,) turning prices, outcomes].

    A higher incoming high turns earlier: at the first price that is low enough for it, one of the block's new lows. Without one, the leg turns
    where it would have turned on the block's own prices; if nowhere, the block is free: the extreme is the higher of both.
    """
    turn, where, ext = _turn(px, 1, trend, theta, px[0])
    inner = len(px) if turn is None else turn
    signed = px[:inner] * trend
    low = np.minimum.accumulate(signed)
    records = np.flatnonzero(np.append(True, signed[1:] < low[:-1]))
    edges, outs, after = [], [], None
    for r, nxt in zip(records[::-1].tolist(), [None, *records[:0:-1].tolist()]):
        # a leg that begins at r and meets the next record without a turn goes on as the leg that begins there
        back = None if nxt is None else _turn(px[:nxt], r + 1, -trend, theta, px[r])[0]
        if nxt is None:
            after = legs.end(r, -trend)
        elif back is not None:
            after = legs.end(back, trend)
        edges.append(px[r] * trend)
        outs.append(after)
    edges, outs = np.array(edges), np.array(outs).reshape(-1, 3)
    if turn is None:
        rest = (1.0, ext * trend, pos[where if where >= 0 else 0], 0.0, 0.0, 0.0)
    else:
        rest = (0.0, 0.0, 0.0, *legs.end(turn, -trend))
    return _pack_side(rest, edges, outs)


def _pack_side(rest, edges, outs):
    """Turning prices rise; an incoming extreme has the outcome of the highest price that it turns at. Neighbours of one outcome become one."""
    if len(edges):
        keep = np.append(True, (outs[1:] != outs[:-1]).any(axis=1))
        if rest[0] == 0.0 and (outs[0] == np.array(rest[3:])).all():
            keep[0] = False
        edges, outs = edges[keep], outs[keep]
    return np.concatenate([[len(edges)], rest, edges, outs.ravel()])


def _read_side(m):
    n = int(m[0])
    return m[1:7], m[7 : 7 + n], m[7 + n : 7 + 4 * n].reshape(n, 3)


def turn_map(px, pos, theta):
    """Map of a block's prices: the side for rising legs, then the one for falling legs."""
    legs = _Legs(px, pos, theta)
    up, down = (_side(px, pos, theta, t, legs) for t in (1.0, -1.0))
    return np.concatenate([[theta, len(up)], up, down])


def _sides(m):
    n = int(m[1])
    return m[2 : 2 + n], m[2 + n :]


def turn_after(state, m):
    """State (trend, extreme, position) behind a block."""
    trend, ext, pos = state
    rest, edges, outs = _read_side(_sides(m)[0 if trend > 0 else 1])
    if at := _reached(ext * trend, edges, m[0]):
        return outs[at - 1]
    if rest[0] == 0.0:
        return rest[3:]
    return np.array([trend, rest[1] * trend, rest[2]]) if rest[1] > ext * trend else np.asarray(state, float)


def turn_compose(a, b):
    out = []
    for k, trend in ((0, 1.0), (1, -1.0)):
        rest, edges, outs = _read_side(_sides(a)[k])
        outs = np.array([turn_after(x, b) for x in outs]).reshape(-1, 3)
        if rest[0] == 0.0:
            rest = np.concatenate([rest[:3], turn_after(rest[3:], b)])
        else:
            rest2, edges2, outs2 = _read_side(_sides(b)[k])
            under = _reached(rest[1], edges2, b[0])  # whether the second block already turns with the first block's own extreme
            new = (np.arange(len(edges2)) >= under) & (edges2 < (edges[0] if len(edges) else np.inf))
            edges, outs = np.concatenate([edges2[new], edges]), np.concatenate([outs2[new], outs])
            if under:
                rest = np.concatenate([[0.0, 0.0, 0.0], outs2[under - 1]])
            elif rest2[0] == 0.0:
                rest = rest2
            elif rest2[1] > rest[1]:
                rest = rest2
        out.append(_pack_side(rest, edges, outs))
    return np.concatenate([[a[0], len(out[0])], *out])


def turns_in_block(px, pos, theta, state):
    """(position, price, trend) of the extremes that turns inside a block confirm, and the state behind it."""
    trend, ext, where = (float(x) for x in state)
    out, at = [], 0
    while True:
        turn, place, ext = _turn(px, at, trend, theta, ext)
        where = where if place < 0 else pos[place]
        if turn is None:
            return out, (trend, ext, where)
        out.append((where, ext, trend))
        trend, ext, where, at = -trend, px[turn], pos[turn], turn + 1


def percent_turns(bars, key, theta, pos, price, start, size=SIZE, fan=None):
    """Extremes of percent-reversal legs. ``bars``: rows (key with ``theta`` in it, pos, price) behind each key's start; ``start``: (key, state).

    Returns (key, pos, price, trend, last): trend 1 for a high, -1 for a low; ``last`` marks the extreme of the leg still open at the end.
    """
    rows = bars.select(*key, F.col(pos).cast("double").alias("_at"), F.col(price).cast("double").alias("_px"), block_of(pos, size).alias("block"))
    arrays = lambda pdf: (pdf["_px"].to_numpy(), pdf["_at"].to_numpy(), float(pdf[theta].iloc[0]))

    def summed(pdf):
        pdf = pdf.sort_values("_at")
        t = pdf[[*key, "block"]].iloc[:1].copy()
        t["map"] = [turn_map(*arrays(pdf))]
        return t

    maps = cut(rows.groupBy(*key, "block").applyInPandas(summed, _ddl(rows, [*key, "block"]) + ", map array<double>"), "turns")
    states = entry_states(maps, key, turn_compose, turn_after, start, fan)
    names = [f"_{i}" for i in range(len(key))]
    ends = maps.groupBy(*key).agg(F.max("block").alias("final"))
    states = states.join(ends, list(key)).select(*[F.col(k).alias(n) for k, n in zip(key, names)], F.col("block").alias("_b"), "state", (F.col("block") == F.col("final")).alias("final"))

    def walked(pdf, state):
        pdf = pdf.sort_values("_at")
        found, rest = turns_in_block(*arrays(pdf), state["state"].iloc[0])
        found = [(p, x, t, False) for p, x, t in found] + ([(rest[2], rest[1], rest[0], True)] if state["final"].iloc[0] else [])
        t = pd.DataFrame(found, columns=["pos", "price", "trend", "last"])
        for k in key:
            t[k] = pdf[k].iloc[0]
        return t[[*key, "pos", "price", "trend", "last"]].astype({"pos": "int64", "trend": "int64", "last": bool})

    return rows.groupBy(*key, "block").cogroup(states.groupBy(*names, "_b")).applyInPandas(walked, _ddl(rows, key) + ", pos bigint, price double, trend bigint, last boolean")
