"""External induced suffix sorting with common-prefix values, on disk-backed priority queues.

A level is a string of symbols ended by a least one of its own. Its starred positions (S-type after
L-type) cut it into substrings. One induction sorts and names these: from the stars, in order of
their run of equal symbols and what ends it, first all L-type and then all S-type positions are
induced. Where names repeat, the string of names is the next level, sorted the same way, and its
order of stars is the seed of a second induction, which sorts all suffixes of the level.

A queue holds tuples: symbol, position, common prefix with the tuple before it under that symbol,
the run it starts with, the symbol after that run, and a few symbols that stand before it, so that
the string itself is seldom looked at. Tuples leave by symbol and then by arrival, in batches that
put nothing among themselves. Common prefixes pass on through range minima: the last time each
value was undercut (``cap + 2`` numbers) answers them over all that was visited, whatever its
size. Symbols of later levels have a length and a common prefix with the symbol before them, both
in symbols of the first level, so every value counts those.

Values are capped at ``cap``, the length of interest: suffixes that agree so far may come in any
order. Tuples and columns over a share of ``memory`` are files in a folder of the task, removed at
the end; nothing else reads it. So memory is bounded whatever the size of the shard, but for a
1/128 of the count of names. A run of one symbol takes a round for each of its places.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

MEMORY = 16 << 20
BYTES = 258  # 0 ends all, 1 ends a string, then the bytes
CARRIED = 3
WINDOW = 4_096
NONE = 1 << 62
UNKNOWN, START = -2, -1
TUPLE = np.dtype([("key", np.int64), ("to", np.int64), ("pos", np.int32), ("lcp", np.int16), ("run", np.int16), ("nxt", np.int32), ("prev", np.int32, (CARRIED,))])
PAIR = np.dtype([("key", np.int64), ("value", np.int64)])
_SEPARATOR = np.ones(1, np.int32)


class Store:
    """A folder for files, made when the first is needed, and the bound on memory."""

    def __init__(self, memory: int = MEMORY) -> None:
        self.memory, self.folder, self.files = memory, None, 0

    def file(self) -> str:
        self.folder = self.folder or tempfile.mkdtemp(prefix="induced-")
        self.files += 1
        return f"{self.folder}/{self.files}"

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


class Column:
    """Values of one type, first in memory and then in a file: appended, read in order either way,
    looked up or overwritten."""

    def __init__(self, store: Store, dtype, size: int = 0, fill: int = 0) -> None:
        self.store, self.dtype, self.size = store, np.dtype(dtype), 0
        self.held: list[np.ndarray] = []
        self.bytes, self.path = 0, None
        self.step = max(4, min(1 << 16, store.memory // 16 // self.dtype.itemsize))
        while self.size < size:
            self.append(np.full(min(self.step, size - self.size), fill, self.dtype))

    def __len__(self) -> int:
        return self.size

    def append(self, values: np.ndarray) -> None:
        if len(values):
            self.held.append(np.asarray(values, self.dtype))
            self.size += len(values)
            self.bytes += self.held[-1].nbytes
            if self.bytes > self.store.memory // (64 if self.path else 16):
                self.spill()

    def spill(self) -> None:
        """All to the file."""
        if self.held:
            self.path = self.path or self.store.file()
            with open(self.path, "ab") as f:
                for values in self.held:
                    f.write(np.ascontiguousarray(values).data)
        self.held, self.bytes = [], 0

    def _whole(self) -> np.ndarray:
        if self.path:
            self.spill()
            return np.memmap(self.path, self.dtype, "r+")
        if len(self.held) != 1:
            self.held = [np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)]
        return self.held[0]

    def blocks(self, back: bool = False) -> Iterator[np.ndarray]:
        if self.path:
            self.spill()
        at = range(0, self.size, self.step)
        for a in reversed(at) if back else at:
            yield self.read(a, min(a + self.step, self.size))

    def read(self, a: int, z: int) -> np.ndarray:
        if not self.path:
            return self._whole()[a:z]
        self.spill()
        return np.fromfile(self.path, self.dtype, z - a, offset=a * self.dtype.itemsize)

    def take(self, index: np.ndarray) -> np.ndarray:
        return np.asarray(self._whole()[index])  # a file stays mapped for this only

    def put(self, index: np.ndarray, values: np.ndarray) -> None:
        self._whole()[index] = values

    def free(self) -> None:
        if self.path:
            os.unlink(self.path)
        self.held, self.bytes, self.path, self.size = [], 0, None, 0


class Line:
    """Tuples in order of arrival."""

    def __init__(self, store: Store, dtype) -> None:
        self.store, self.dtype, self.size = store, dtype, 0
        self.held: list[np.ndarray] = []
        self.path, self.taken, self.filed = None, 0, 0

    def push(self, values: np.ndarray) -> None:
        self.held.append(values)
        self.size += len(values)

    def spill(self) -> None:
        if self.held:
            self.path = self.path or self.store.file()
            with open(self.path, "ab") as f:
                for values in self.held:
                    f.write(np.ascontiguousarray(values).data)
                    self.filed += len(values)
            self.held = []

    def take(self, n: int) -> np.ndarray:
        """The first ``n``, or a few more or less at the border of what is in memory."""
        if self.taken < self.filed:
            n = min(n, self.filed - self.taken)
            out = np.fromfile(self.path, self.dtype, n, offset=self.taken * self.dtype.itemsize)
            self.taken += n
            if self.taken == self.filed:
                os.unlink(self.path)
                self.path, self.taken, self.filed = None, 0, 0
        else:
            out, self.held = np.concatenate(self.held) if len(self.held) != 1 else self.held[0], []
            if len(out) > n:
                out, self.held = out[:n], [out[n:]]
        self.size -= len(out)
        return out

    def blocks(self, n: int) -> Iterator[np.ndarray]:
        while self.size:
            yield self.take(n)


class Queue:
    """A disk-backed priority queue: the smallest key first, equal keys by arrival.

    The keys are cut into ranges. That of the smallest keys is in memory and sorted; the others are
    lines of tuples in order of arrival, in files beyond a share of the memory. A range that is too
    large when its turn comes is cut further, by its own keys; one key alone is never sorted.
    """

    def __init__(self, store: Store, dtype=TUPLE) -> None:
        self.store, self.dtype = store, dtype
        self.limit = max(4, min(8_192, store.memory // 16 // dtype.itemsize))
        self.low, self.lines = np.zeros(1, np.int64), [Line(store, dtype)]  # beyond the range in hand
        self.now, self.top, self.own = np.zeros(0, dtype), 0, None  # own: the rest of a key alone
        self.used = 0

    def push(self, values: np.ndarray) -> None:
        """Tuples sorted by key, those of a key in order of arrival; none below one taken before."""
        cut = int(np.searchsorted(values["key"], self.top))
        if cut:
            self._join(values[:cut])
        if cut == len(values):
            return
        values = values[cut:]
        at = np.searchsorted(values["key"], self.low)
        at[0] = 0
        edges = np.r_[at, len(values)]
        for i in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            self.lines[i].push(values[edges[i] : edges[i + 1]])
        self.used += values.nbytes
        if self.used > self.store.memory // 4:
            for line in self.lines:
                line.spill()
            if self.own is not None:
                self.own.spill()
            self.used = 0

    def _join(self, values: np.ndarray) -> None:
        if self.own is not None:
            self.own.push(values)
            self.used += values.nbytes
            return
        if not len(self.now):
            self.now = values
        else:
            at = np.searchsorted(self.now["key"], values["key"], "right") + np.arange(len(values))
            out = np.empty(len(self.now) + len(values), self.dtype)
            old = np.ones(len(out), bool)
            old[at] = False
            out[at], out[old] = values, self.now
            self.now = out
        if len(self.now) > 2 * self.limit:
            key = self.now["key"]
            cut = int(np.searchsorted(key, key[self.limit]))
            cut = cut or int(np.searchsorted(key, key[0], "right"))
            if cut < len(key):
                self._before(int(key[cut]), self.now[cut:].copy())
                self.now, self.top = self.now[:cut], int(key[cut])

    def _before(self, low: int, *values: np.ndarray) -> None:
        line = Line(self.store, self.dtype)
        for v in values:
            line.push(v)
            self.used += v.nbytes
        self.low, self.lines = np.r_[np.int64(low), self.low], [line, *self.lines]

    def head(self) -> np.ndarray | None:
        """The sorted tuples in hand, at least one; None where all are gone."""
        while not len(self.now):
            if self.own is not None:
                if self.own.size:
                    self.now = self.own.take(self.limit)
                    break
                self.own = None
            if not self.lines:
                return None
            line, self.lines = self.lines[0], self.lines[1:]
            low, self.low = int(self.low[0]), self.low[1:]
            top = int(self.low[0]) if len(self.low) else NONE
            if line.size <= self.limit:
                parts = list(line.blocks(self.limit))
                if parts:
                    got = np.concatenate(parts)
                    self.now = got[np.argsort(got["key"], kind="stable")]
                self.top = top
            else:
                self._cut(line, low, top)
        return self.now

    def _cut(self, line: Line, low: int, top: int) -> None:
        whole = Line(self.store, self.dtype)
        least, most = NONE, -1
        for block in line.blocks(self.limit):
            least, most = min(least, int(block["key"].min())), max(most, int(block["key"].max()))
            whole.push(block)
            if whole.size > self.limit:
                whole.spill()
        if least == most:
            self.own, self.top = whole, least + 1
            if top > least + 1:
                self._before(least + 1)
            return
        width = -(-(most - least + 1) // 256)
        count, line = np.zeros(256, np.int64), Line(self.store, self.dtype)
        for block in whole.blocks(self.limit):
            count += np.bincount((block["key"] - least) // width, minlength=256)
            line.push(block)
            if line.size > self.limit:
                line.spill()
        first, size = [0], 0
        for i, c in enumerate(count.tolist()):
            if size and size + c > self.limit // 2:
                first.append(i)
                size = 0
            size += c
        starts = least + np.array(first, np.int64) * width
        starts[0] = low
        lines = [Line(self.store, self.dtype) for _ in first]
        used = 0
        for block in line.blocks(self.limit):
            own = np.searchsorted(starts, block["key"], "right") - 1
            order = np.argsort(own, kind="stable")
            edges = np.searchsorted(own[order], np.arange(len(first) + 1))
            for i in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                lines[i].push(block[order[edges[i] : edges[i + 1]]])
            used += block.nbytes
            if used > self.store.memory // 8:
                for part in lines:
                    part.spill()
                used = 0
        self.low, self.lines, self.used = np.r_[starts, self.low], [*lines, *self.lines], self.used + used

    def take(self, n: int) -> np.ndarray:
        out, self.now = self.now[:n], self.now[n:]
        return out

    def drain(self) -> Iterator[np.ndarray]:
        while (head := self.head()) is not None:
            yield self.take(len(head))


class Minima:
    """The least of ``values`` over (lo, hi], by a table over blocks; 0 where there are none."""

    BLOCK = 256

    def __init__(self, values: Column | None) -> None:
        self.values = values
        if values is not None:
            least = np.concatenate([np.minimum.reduceat(b, np.arange(0, len(b), self.BLOCK)) for b in values.blocks()])
            self.table = [least]
            while 1 << len(self.table) <= len(least):
                half = 1 << (len(self.table) - 1)
                self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if self.values is None or not len(lo):
            return np.zeros(len(lo), np.int64)
        return np.concatenate([self._some(lo[i : i + self.BLOCK], hi[i : i + self.BLOCK]) for i in range(0, len(lo), self.BLOCK)])

    def _some(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.empty(len(lo), np.int64)
        a, z = lo.astype(np.int64) + 1, hi.astype(np.int64) + 1  # half open
        left, right = -(-a // self.BLOCK), z // self.BLOCK
        wide = left < right
        parts = (a, np.where(wide, left * self.BLOCK, z)), (np.where(wide, right * self.BLOCK, z), z)
        out[:] = np.iinfo(np.int16).max
        for x, y in parts:
            some = np.flatnonzero(y > x)
            if len(some):
                n = y[some] - x[some]
                start = np.cumsum(n) - n
                got = self.values.take(np.repeat(x[some] - start, n) + np.arange(n.sum()))
                out[some] = np.minimum(out[some], np.minimum.reduceat(got, start))
        some = np.flatnonzero(wide)
        if len(some):
            out[some] = np.minimum(out[some], range_least(self.table, left[some], right[some] - 1))
        return out


def range_table(values: np.ndarray, longest: int) -> list[np.ndarray]:
    table = [values]
    while 1 << len(table) <= longest:
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def range_least(table: list[np.ndarray], a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Over a..z inclusive."""
    level = np.frexp((z - a + 1).astype(np.float64))[1] - 1
    out = np.empty(len(a), table[0].dtype)
    for lv in range(int(level.min()), int(level.max()) + 1):
        w = np.flatnonzero(level == lv)
        if len(w):
            out[w] = np.minimum(table[lv][a[w]], table[lv][z[w] - (1 << lv) + 1])
    return out


class Fold:
    """Common prefixes among some of the visited: the least since the one before."""

    def __init__(self, most: int) -> None:
        self.most, self.carry = most, most

    def __call__(self, at: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        if not len(at):
            self.carry = min(self.carry, int(lcp.min()))
            return np.zeros(0, np.int16)
        out = np.minimum.reduceat(lcp, np.r_[0, at[:-1] + 1])
        # The last piece of reduceat runs to the end; it is to stop at its own place.
        out[-1] = lcp[(at[-2] + 1 if len(at) > 1 else 0) : at[-1] + 1].min()
        out[0] = min(int(out[0]), self.carry)
        rest = lcp[at[-1] + 1 :]
        self.carry = int(rest.min()) if len(rest) else self.most
        return out


class Level:
    """``text``: symbols below ``kinds``, the last one 0 and the only 0. ``length`` and ``prefix``
    of symbols: see above; None where each is one long, and has nothing in common with others."""

    def __init__(self, store: Store, text: Column, kinds: int, cap: int, length: Column | None = None, prefix: Column | None = None) -> None:
        self.store, self.text, self.kinds, self.cap, self.length = store, text, kinds, cap, length
        self.prefix = Minima(prefix)
        if kinds * kinds * (cap + 1) >= 1 << 63:
            raise ValueError(f"{kinds} names are too many to sort")

    def _length(self, symbols: np.ndarray) -> np.ndarray | int:
        return 1 if self.length is None else self.length.take(symbols).astype(np.int64)

    def _before(self, pos: np.ndarray) -> np.ndarray:
        at = pos[:, None].astype(np.int64) - np.arange(1, CARRIED + 1)
        return np.where(at >= 0, self.text.take(np.maximum(at, 0).ravel()).reshape(at.shape), START)

    # -- stars

    def scan(self) -> None:
        """``stars`` as tuples and ``sizes``, the length up to the next star, both from the end."""
        store, cap = self.store, self.cap
        self.stars, self.sizes = Column(store, TUPLE), Column(store, np.int16)
        behind = 0  # length from the block's end to the next star
        after = run_after = next_after = None
        z = len(self.text)
        while z:
            a = max(0, z - self.text.step)
            data = self.text.read(max(0, a - CARRIED), z)
            lead = a - max(0, a - CARRIED)
            sym, n = data[lead:].astype(np.int64), z - a
            place = np.arange(n)
            last = after is None
            ends = np.r_[sym[:-1] != sym[1:], True]
            end = np.minimum.accumulate(np.where(ends, place, n)[::-1])[::-1]
            follow = np.r_[sym, 0 if last else after]
            run, nxt = end - place + 1, follow[end + 1]
            if not last and sym[-1] == after:
                tail = end == n - 1
                run[tail] += run_after
                nxt[tail] = next_after
            padded = np.r_[np.full(CARRIED - lead, START, np.int64), data.astype(np.int64)]
            prev = np.stack([padded[CARRIED - 1 - j : CARRIED - 1 - j + n] for j in range(CARRIED)], axis=1)
            star = (nxt > sym) & (prev[:, 0] > sym)
            if last:
                star[-1] = n + lead > 1
            at = np.flatnonzero(star)
            sums = np.r_[0, np.cumsum(np.broadcast_to(self._length(sym), n))]
            if len(at):
                size = sums[np.r_[at[1:], n]] - sums[at]
                size[-1] += behind
                behind = int(sums[at[0]])
                t = np.empty(len(at), TUPLE)
                t["key"], t["to"], t["pos"], t["lcp"] = 2 * sym[at] + 1, 2 * prev[at, 0], a + at, 0
                t["run"], t["nxt"], t["prev"] = np.minimum(run[at], cap), nxt[at], prev[at]
                self.stars.append(t[::-1])
                self.sizes.append(np.minimum(size[::-1], cap))
            else:
                behind += int(sums[-1])
            after, run_after, next_after = int(sym[0]), int(run[0]), int(nxt[0])
            z = a

    def by_run(self) -> Iterator[np.ndarray]:
        """The stars by symbol, falling run and what ends the run, with common prefixes; ``cap + 1``
        where these are the same."""
        cap, sorter = self.cap, Queue(self.store)
        for t in self.stars.blocks():
            t = t.copy()
            t["key"] = ((t["key"] >> 1) * (cap + 1) + (cap - t["run"])) * self.kinds + t["nxt"]
            sorter.push(t[np.argsort(t["key"], kind="stable")])
        last = None
        for t in sorter.drain():
            t = t.copy()
            both = t if last is None else np.r_[last, t]
            key, run, nxt = both["key"], both["run"].astype(np.int64), both["nxt"].astype(np.int64)
            sym = key // self.kinds // (cap + 1)
            lcp = np.zeros(len(both), np.int64)
            some = np.flatnonzero((sym[1:] == sym[:-1]) & (key[1:] != key[:-1])) + 1
            if len(some):
                lo = np.where(run[some - 1] == run[some], nxt[some - 1], sym[some])
                lcp[some] = np.minimum(run[some] * self._length(sym[some]) + self.prefix(lo, nxt[some]), cap)
            lcp[1:][key[1:] == key[:-1]] = cap + 1
            cut = len(both) - len(t)
            t["lcp"], t["key"] = lcp[cut:], 2 * sym[cut:] + 1
            last = both[-1:].copy()
            yield t

    # -- induction

    def sweep(self, queue: Queue, down: bool, seen) -> None:
        """Visits the queue's tuples in order and pushes what stands before them and is of the type
        induced. ``seen(batch, symbols, common prefixes)``."""
        cap, kinds = self.cap, self.kinds
        last, clock, tail = np.full(cap + 2, -1, np.int64), 0, None
        pushed = Column(self.store, np.int64, kinds, -1)
        while (head := queue.head()) is not None:
            ahead = head[:WINDOW]
            key = ahead["key"]
            bad = np.minimum.accumulate(ahead["to"]) <= key
            n = int(bad.argmax()) if bad[-1] else len(ahead)
            n = n or int(np.searchsorted(key, key[0], "right"))
            batch = queue.take(n)
            key = batch["key"]
            half = key >> 1
            sym = kinds - 1 - half if down else half
            lcp = batch["lcp"].copy()
            new = np.r_[tail is None or key[0] != tail["key"][0], key[1:] != key[:-1]]
            at = np.flatnonzero(new)
            if len(at):
                lcp[at] = self._border(batch, sym, at, tail, down)
            tail = batch[-1:].copy()
            source = np.flatnonzero(batch["to"] != NONE)
            if len(source):
                queue.push(self._induced(batch, sym, lcp, source, down, last, pushed, clock))
            seen(batch, sym, lcp)
            latest = np.full(cap + 2, -1, np.int64)
            latest[lcp] = clock + np.arange(n)  # of equal values the last one stays
            np.maximum(last, np.maximum.accumulate(latest), out=last)
            clock += n
        pushed.free()

    def _border(self, batch: np.ndarray, sym: np.ndarray, at: np.ndarray, tail, down: bool) -> np.ndarray:
        """Common prefixes of the first of each key with the one visited before."""
        out = np.zeros(len(at), np.int64)
        if tail is None:
            at, skip = at[1:], 1
        else:
            skip = 0
        if not len(at):
            return out
        before = batch[at - 1]
        if not skip and at[0] == 0:
            before[0] = tail[0]
        half = before["key"] >> 1
        other = self.kinds - 1 - half if down else half
        me = sym[at]
        lo, hi = np.minimum(other, me), np.maximum(other, me)
        same = np.flatnonzero(other == me)
        if self.prefix.values is None and not len(same):
            return out
        runs = np.zeros(len(at), np.int64)
        if len(same):
            s, ell = (before, batch[at]) if down else (batch[at], before)
            a, b = s["run"][same].astype(np.int64), ell["run"][same].astype(np.int64)
            d, e, c = s["nxt"][same], ell["nxt"][same], me[same]
            runs[same] = np.minimum(a, b) * self._length(c)
            lo[same], hi[same] = np.where(a < b, c, e), np.where(a > b, c, d)
        out[skip:] = np.minimum(runs + self.prefix(lo, hi), self.cap)
        return out

    def _induced(self, batch, sym, lcp, source, down, last, pushed, clock) -> np.ndarray:
        cap, kinds = self.cap, self.kinds
        to = batch["to"][source]
        order = np.argsort(to, kind="stable")
        source, to = source[order], to[order]
        first = np.r_[True, to[1:] != to[:-1]]
        start = np.where(first, 0, np.r_[0, source[:-1] + 1])
        least = range_least(range_table(lcp, int((source - start).max()) + 1), start, source).astype(np.int64)
        group = np.flatnonzero(first)
        half = to >> 1
        old = pushed.take(half[group])
        least[group] = np.minimum(least[group], np.searchsorted(last, old, "right"))
        pushed.put(half[group], clock + source[np.r_[group[1:], len(source)] - 1])
        out = np.empty(len(source), TUPLE)
        now = kinds - 1 - half if down else half
        value = np.where(least > cap, cap + 1, np.minimum(least + self._length(now), cap))
        value[group[old < 0]] = -1
        given = batch[source]
        same = now == sym[source]
        out["key"], out["pos"], out["lcp"] = to, given["pos"] - 1, value
        out["run"] = np.where(same, np.minimum(given["run"] + 1, cap), 1)
        out["nxt"] = np.where(same, given["nxt"], sym[source])
        prev = out["prev"]
        prev[:, :-1], prev[:, -1] = given["prev"][:, 1:], UNKNOWN
        need = np.flatnonzero(prev[:, 0] == UNKNOWN)
        if len(need):
            prev[need] = self._before(out["pos"][need])
        p = prev[:, 0].astype(np.int64)
        if down:
            out["to"] = np.where((p >= 0) & (p <= now), 2 * (kinds - 1 - p), NONE)
        else:
            out["to"] = np.where(p >= now, 2 * p, NONE)
        return out

    def induce(self, seeds: Iterator[np.ndarray], naming: bool, seen) -> None:
        """From the sorted stars to all suffixes, the greatest first: ``seen(positions, common
        prefixes)``; where naming, to the stars only. The last position is left out."""
        up, large = Queue(self.store), Column(self.store, TUPLE)
        for t in seeds:
            up.push(t)
        fold = Fold(self.cap + 1)

        def keep(batch: np.ndarray, sym: np.ndarray, lcp: np.ndarray) -> None:
            p, wanted = batch["prev"][:, 0], batch["key"] & 1 == 0
            if naming:
                wanted &= (p >= 0) & (p < sym)
            at = np.flatnonzero(wanted)
            got = batch[at]
            got["lcp"] = fold(at, lcp)
            large.append(got)

        self.sweep(up, False, keep)
        downward, above = Queue(self.store), 0
        for t in large.blocks(back=True):
            t = t[::-1].copy()
            sym, p = t["key"] >> 1, t["prev"][:, 0].astype(np.int64)
            below = t["lcp"].copy()
            t["lcp"] = np.r_[np.int16(above), below[:-1]]
            above = below[-1]
            t["key"] = 2 * (self.kinds - 1 - sym) + 1
            t["to"] = np.where((p >= 0) & (p < sym), 2 * (self.kinds - 1 - p), NONE)
            downward.push(t)
        large.free()
        fold = Fold(self.cap + 1)

        def tell(batch: np.ndarray, sym: np.ndarray, lcp: np.ndarray) -> None:
            if naming:
                at = np.flatnonzero((batch["key"] & 1 == 0) & (batch["prev"][:, 0] > sym))
                lcp = fold(at, lcp)
                if len(at):
                    seen(batch["pos"][at], lcp)
            else:
                seen(batch["pos"], lcp)

        self.sweep(downward, True, tell)

    # -- names and order

    def name(self) -> tuple[Column, int, Column, Column]:
        """``(string of names, kinds of names, length, prefix)``."""
        store, cap = self.store, self.cap
        sorter, fall, kinds = Queue(store, PAIR), Column(store, np.int16), 0

        def seen(pos: np.ndarray, lcp: np.ndarray) -> None:
            nonlocal kinds
            new = lcp <= cap
            if not kinds:
                new[0] = True
            fall.append(lcp[new][1:] if not kinds else lcp[new])
            pairs = np.empty(len(pos), PAIR)
            pairs["value"] = kinds - 1 + np.cumsum(new)
            kinds += int(new.sum())
            pairs["key"] = pos
            sorter.push(pairs[np.argsort(pos, kind="stable")])

        self.induce(self.by_run(), True, seen)
        kinds += 1  # the end
        names, at = Column(store, np.int32), len(self.stars)
        length, prefix = Column(store, np.int16, kinds), Column(store, np.int16)
        for pairs in sorter.drain():
            own = kinds - 1 - pairs["value"]
            names.append(own)
            length.put(own, self.sizes.read(at - len(own), at)[::-1])
            at -= len(own)
        names.append(np.zeros(1, np.int32))
        length.put(np.zeros(1, np.int64), np.ones(1, np.int16))
        prefix.append(np.zeros(min(kinds, 2), np.int16))  # of the end and of the least after it
        for values in fall.blocks(back=True):
            prefix.append(values[::-1])
        fall.free()
        return names, kinds, length, prefix

    def order(self) -> Iterator[np.ndarray]:
        """The stars in order of their suffixes, with common prefixes."""
        store, k = self.store, len(self.stars)
        names, kinds, length, prefix = self.name()
        if kinds == k:
            rank = Column(store, np.int64, k)
            at = 0
            for block in names.blocks():
                rank.put(block, at + np.arange(len(block)))
                at += len(block)
            found = ((which, prefix.read(i * rank.step, i * rank.step + len(which))) for i, which in enumerate(rank.blocks()))
        else:
            for column in (self.text, self.stars, self.sizes):
                if column.bytes > store.memory // 64:
                    column.spill()
            below = Level(store, names, kinds, self.cap, length, prefix)
            fall = Column(store, [("pos", np.int64), ("lcp", np.int16)])

            def seen(pos: np.ndarray, lcp: np.ndarray) -> None:
                rows = np.empty(len(pos), fall.dtype)
                rows["pos"], rows["lcp"] = pos, lcp
                fall.append(rows)

            below.sort(seen)
            for column in (names, length, prefix):
                column.free()
            fall.append(np.array([(k - 1, 0)], fall.dtype))

            def backward() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                carry = 0
                for block in fall.blocks(back=True):
                    turned = block["lcp"][::-1]
                    yield block["pos"][::-1], np.r_[np.int16(carry), turned[:-1]]
                    carry = turned[-1]
                fall.free()

            found = backward()
        for which, lcp in found:
            t = self.stars.take(k - 1 - which)
            t["lcp"] = lcp
            yield t

    def sort(self, seen) -> None:
        """``seen(positions, common prefixes)``: all suffixes but the last position's, the greatest
        first, each with what it has in common with the one before it."""
        self.scan()
        if len(self.stars):
            self.induce(self.order(), False, seen)
        self.stars.free()
        self.sizes.free()


class Shard:
    """Strings whose windows of ``size`` bytes are looked for in each other and themselves.

    A string may come with a stretch that all its windows hold, and a key: such a stretch becomes
    one symbol as long as its bytes, the same one where the bytes are the same under that key. Equal
    keys are to come together. Windows that are equal must hold their stretches at one place.
    """

    def __init__(self, size: int, memory: int = MEMORY) -> None:
        self.size, self.store = size, Store(memory)
        self.text, self.starts, self.windows = (Column(self.store, t) for t in (np.int32, np.int64, np.int32))
        self.length = Column(self.store, np.int16, BYTES, 1)
        self.key, self.known = None, {}

    def add(self, strings: list[bytes], keys: list | None = None, cuts: list | None = None, widths: list | None = None) -> None:
        parts, ends, size = [], [], len(self.text)
        for i, s in enumerate(strings):
            data = np.frombuffer(s, np.uint8).astype(np.int32) + 2
            if keys is not None:
                if keys[i] != self.key:
                    self.key, self.known = keys[i], {}
                stretch = s[cuts[i] : cuts[i] + widths[i]]
                symbol = self.known.get(stretch)
                if symbol is None:
                    symbol = self.known[stretch] = len(self.length)
                    self.length.append(np.full(1, widths[i]))
                data = np.r_[data[: cuts[i]], np.int32(symbol), data[cuts[i] + widths[i] :]]
            parts += [data, _SEPARATOR]
            ends.append(len(data) + 1)
        if parts:
            self.starts.append(size + np.r_[0, np.cumsum(ends[:-1])])
            self.windows.append(np.array([max(0, len(s) - self.size + 1) for s in strings]))
            self.text.append(np.concatenate(parts))

    def repeated(self) -> Iterator[list[np.ndarray]]:
        """For each string in order, in lists, the numbers of its windows that occur anywhere else."""
        try:
            yield from self._repeated()
        finally:
            self.store.close()

    def _repeated(self) -> Iterator[list[np.ndarray]]:
        size, text = self.size, self.text
        total = len(text)
        text.append(np.zeros(1, np.int32))
        hits, before = Queue(self.store, PAIR), None

        def seen(pos: np.ndarray, lcp: np.ndarray) -> None:
            nonlocal before
            hit = lcp >= size
            found = [pos[hit], pos[:-1][hit[1:]]]
            if hit[0] and before is not None:
                found.append(np.array([before]))
            before = int(pos[-1])
            found = np.unique(np.concatenate(found))
            if len(found):
                pairs = np.empty(len(found), PAIR)
                pairs["key"], pairs["value"] = found, 0
                hits.push(pairs)

        kinds = len(self.length)
        Level(self.store, text, kinds, size, self.length if kinds > BYTES else None).sort(seen)
        waiting, drained, live, at = np.zeros(0, np.int64), hits.drain(), True, 0
        for starts in self.starts.blocks():
            windows = self.windows.read(at, at + len(starts))
            at += len(starts)
            edge = int(self.starts.read(at, at + 1)[0]) if at < len(self.starts) else total
            while live and (not len(waiting) or waiting[-1] < edge):
                block = next(drained, None)
                live = block is not None
                if live:
                    waiting = np.r_[waiting, block["key"]]
            cuts = np.searchsorted(waiting, np.r_[starts, edge])
            out = []
            for i, s in enumerate(starts.tolist()):
                own = np.unique(waiting[cuts[i] : cuts[i + 1]]) - s
                out.append(own[own < windows[i]])
            yield out
            waiting = waiting[cuts[-1] :]


def repeated_windows(strings: list[bytes], size: int, memory: int = MEMORY) -> list[np.ndarray]:
    """For each string which of its windows of ``size`` bytes occur anywhere else in the strings."""
    shard = Shard(size, memory)
    shard.add(strings)
    out = []
    for places in (own for block in shard.repeated() for own in block):
        flags = np.zeros(max(0, len(strings[len(out)]) - size + 1), bool)
        flags[places] = True
        out.append(flags)
    return out
