"""External induced sorting of suffixes with common-prefix values.

A text is an array of symbols in which 0 ends a string; suffixes are compared up to their string's end, and
ends are ordered by place.  The steps:

1. Suffixes are S (smaller than the next) or L; an S behind an L, and every end, is a seed.
2. Seeds' substrings up to the next seed are named in sorted order; if names repeat, the string of names is
   sorted by the same routine again (or by doubling, once it fits ``base``).
3. Induction: tuples (symbol, run, rank of the suffix behind the run, place) stand in queues by symbol.  Queues
   are popped in ascending symbol order to rank the L suffixes, then in descending order to rank all.  As the
   suffix behind a run has another symbol, a popped queue only needs a stable sort by run: it is a monotone
   priority queue whose top level is the symbol.  Queues over ``budget`` bytes go to an anonymous
   temporary file, in large sequential pieces, like Spark's own spills; it vanishes with the task.
4. Common prefixes ride along: two tuples of one run share the run and what the suffixes behind it share,
   which is the least value between their ranks; of different runs, the shorter run.
"""

from __future__ import annotations

import tempfile

import numpy as np

CAP = 255


class Queues:
    """Tuples by symbol, each queue in the order of pushing; the largest go to disk when over budget."""

    def __init__(self, budget: int, kind: type = np.int64):
        self.budget, self.kind, self.held, self.parts, self.file, self.spilled = budget, kind, 0, {}, None, 0

    def push(self, symbols: np.ndarray, run: int, keys: np.ndarray, places: np.ndarray) -> None:
        if not len(symbols):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, keys, places = symbols[order], keys[order], places[order]
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        edges = [0, *cuts.tolist(), len(symbols)]
        for a, b in zip(edges, edges[1:], strict=False):
            part = np.empty((3, b - a), self.kind)
            part[0], part[1], part[2] = run, keys[a:b], places[a:b]
            self.parts.setdefault(int(symbols[a]), []).append(part)
            self.held += part.nbytes
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        sizes = {s: sum(p.nbytes for p in ps if isinstance(p, np.ndarray)) for s, ps in self.parts.items()}
        for s in sorted(sizes, key=sizes.get, reverse=True):
            if self.held <= self.budget // 2:
                break
            kept = []
            for p in self.parts[s]:
                if isinstance(p, np.ndarray):
                    at = self.file.seek(0, 2)
                    self.file.write(p.tobytes())
                    self.held -= p.nbytes
                    self.spilled += p.nbytes
                    p = (at, p.shape[1])
                kept.append(p)
            self.parts[s] = kept

    def pop(self, symbol: int) -> np.ndarray:
        """(run, key, place) of a symbol, by run and then by key."""
        got = []
        for p in self.parts.pop(symbol, []):
            if isinstance(p, np.ndarray):
                self.held -= p.nbytes
            else:
                self.file.seek(p[0])
                p = np.frombuffer(self.file.read(3 * np.dtype(self.kind).itemsize * p[1]), self.kind).reshape(3, -1)
            got.append(p)
        if not got:
            return np.empty((3, 0), self.kind)
        out = np.concatenate(got, axis=1) if len(got) > 1 else got[0]
        if out[0, 0] == out[0, -1] and (out[0] == out[0, 0]).all():
            return out
        return out[:, np.argsort(np.minimum(out[0], 65535).astype(np.uint16), kind="stable")] if out[0].max() < 65535 else out[:, np.argsort(out[0], kind="stable")]


def _shared(values: np.ndarray, popped: np.ndarray, out: np.ndarray) -> None:
    """Common prefixes of popped tuples with the one before, into ``out``; ``values`` are those by rank."""
    run, key = popped[0], popped[1]
    if len(run) < 2:
        return
    cuts = np.flatnonzero(run[1:] != run[:-1]) + 1
    edges = [0, *cuts.tolist(), len(run)]
    for a, b in zip(edges, edges[1:], strict=False):
        if a:
            out[a] = min(CAP, int(run[a - 1]), int(run[a]))
        if b - a > 1:
            r = key[a:b]
            least = np.minimum.reduceat(values[: r[-1] + 1], r[:-1] + 1).astype(np.int64)
            out[a + 1 : b] = np.minimum(least + run[a], CAP)


def _words(t: np.ndarray, p: np.ndarray, at: int, length: np.ndarray) -> np.ndarray:
    """Symbols ``at`` and after of the substrings at ``p``, packed in order; a high symbol follows the last one."""
    per = 8 // t.itemsize
    bits = 8 * t.itemsize
    end = np.uint64((1 << bits) - 1)
    out = np.zeros(len(p), np.uint64)
    for i in range(at, at + per):
        v = t[np.minimum(p + i, len(t) - 1)].astype(np.uint64)
        v = np.where(i < length, v, np.where(i == length, end, np.uint64(0)))
        out = (out << np.uint64(bits)) | v if bits < 64 else v
    return out


def _ranks(t: np.ndarray, seeds: np.ndarray, base: int, budget: int) -> np.ndarray:
    """The order of the seed suffixes, as indexes into ``seeds``."""
    m = len(seeds)
    is_end = t[seeds] == 0
    body = np.flatnonzero(~is_end)
    names = np.empty(m, np.int64)
    ends = int(is_end.sum())
    names[is_end] = np.arange(ends)
    if len(body):
        p = seeds[body]
        length = seeds[body + 1] - p + 1
        per = 8 // t.itemsize
        _, name = np.unique(_words(t, p, 0, length), return_inverse=True)
        name = name.astype(np.int64) << 32
        long = np.flatnonzero(length + 1 > per)
        if len(long):
            columns = [_words(t, p[long], k, length[long]) for k in range(per, int(length[long].max()) + 1, per)]
            order = np.lexsort([*columns[::-1], name[long]])
            step = np.zeros(len(long), bool)
            for c in (name[long], *columns):
                step[1:] |= c[order[1:]] != c[order[:-1]]
            name[long[order]] += np.cumsum(step)
        _, name = np.unique(name, return_inverse=True)
        names[body] = ends + name
    distinct = int(names.max()) + 1
    if distinct == m:
        return np.argsort(names)
    if m > base:
        reduced = np.where(is_end, 0, names - ends + 1).astype(np.uint32)
        order, _ = sort_suffixes(reduced, base, budget, values=False)
        return np.concatenate([np.flatnonzero(is_end), order])
    return _doubling(names)


def _doubling(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string of names in which each string ends in a name of its own."""
    m = len(names)
    counts = np.bincount(names)
    rank = (np.cumsum(counts) - counts)[names]
    open_ = np.flatnonzero(counts[names] > 1)
    h = 1
    while len(open_):
        old, nxt = rank[open_], rank[open_ + h]
        order = np.argsort(old * (m + 1) + nxt)
        open_, old, nxt = open_[order], old[order], nxt[order]
        new_old = np.concatenate([[True], old[1:] != old[:-1]])
        new = new_old | np.concatenate([[True], nxt[1:] != nxt[:-1]])
        index = np.arange(len(open_))
        first_old = np.maximum.accumulate(np.where(new_old, index, 0))
        first_new = np.maximum.accumulate(np.where(new, index, 0))
        rank[open_] = old + first_new - first_old
        sizes = np.diff(np.append(np.flatnonzero(new), len(open_)))
        open_ = open_[np.repeat(sizes, sizes) > 1]
        h *= 2
    out = np.empty(m, np.int64)
    out[rank] = np.arange(m)
    return out


def _direct(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes at ``a`` and ``b``, to ``cap``, within their strings."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    last = len(t) - 1
    for i in range(cap):
        x, y = t[np.minimum(a[live] + i, last)], t[np.minimum(b[live] + i, last)]
        live = live[(x == y) & (x != 0)]
        if not len(live):
            break
        out[live] += 1
    return out


def sort_suffixes(t: np.ndarray, base: int = 1 << 24, budget: int = 256 << 20, values: bool = True, cap: int = CAP) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes but the ends in ascending order, and the common prefix of each with the one before
    (exact below ``cap``, else at least ``cap``; zeros where ``values`` is not asked for).  ``t`` is unsigned, ends in 0 and has no symbol of
    all ones."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    change = np.flatnonzero(t[1:] != t[:-1]) + 1
    starts = np.concatenate([[0], change])
    sizes = np.diff(np.append(starts, n))
    after = np.append(t[change], 0)
    small = np.repeat(t[starts] < after, sizes)
    small |= t == 0
    place = np.int32 if n < 1 << 31 else np.int64
    behind = (np.arange(n, dtype=place) - np.repeat(starts.astype(place), sizes)) + 1  # symbols of the run up to here
    ahead = np.repeat((starts + sizes).astype(place), sizes) - np.arange(n, dtype=place)  # and from here
    seeds = np.flatnonzero((small & ~np.concatenate([[True], small[:-1]])) | (t == 0))
    seeds = seeds[_ranks(t, seeds, base, budget)]
    kinds = np.unique(t)
    seed_edges = np.searchsorted(t[seeds], np.append(kinds, kinds[-1] + 1), side="left") if kinds[-1] < np.iinfo(t.dtype).max else None
    ls = int((~small).sum())
    order = np.empty(ls + len(seeds), place)
    common = np.zeros(len(order), np.uint8)
    shared = np.zeros(len(seeds), np.int64)
    if values and len(seeds) > 1:
        shared[1:] = _direct(t, seeds[:-1], seeds[1:], cap)
    queues = Queues(budget, place)

    def induce(places: np.ndarray, first: int, larger: bool) -> None:
        """Push the runs before these suffixes, if of a larger (smaller) symbol."""
        keys = np.arange(first, first + len(places))
        ok = places > 0
        places, keys = places[ok], keys[ok]
        here, before = t[places], t[places - 1]
        ok = before > here if larger else (before < here) & (before > 0)
        places, keys, before = places[ok], keys[ok], before[ok]
        run = 1
        length = behind[places - 1]
        while len(places):
            queues.push(before, run, keys, places - run)
            run += 1
            ok = length >= run
            if not ok.all():
                places, keys, before, length = places[ok], keys[ok], before[ok], length[ok]

    at, l_range = 0, {}
    for i, c in enumerate(kinds.tolist()):
        got = queues.pop(c)
        k = got.shape[1]
        if values and k:
            _shared(common, got, common[at : at + k])
        order[at : at + k] = got[2]
        induce(got[2], at, True)
        l_range[c] = (at, at + k)
        own = seeds[seed_edges[i] : seed_edges[i + 1]]
        if len(own):
            s = at + k
            order[s : s + len(own)] = own
            if values:
                common[s : s + len(own)] = shared[seed_edges[i] : seed_edges[i + 1]]
                common[s] = min(CAP, int(ahead[got[2, -1]]), int(ahead[own[0]])) if k and c else 0
            induce(own, s, True)
            at = s + len(own)
        else:
            at += k
    del seeds, shared
    total = int((t != 0).sum())
    down = np.empty(total, place)
    shares = np.zeros(total, np.uint8)
    at = 0
    for c in kinds[::-1].tolist():
        if c == 0:
            break
        got = queues.pop(c)
        k = got.shape[1]
        if values and k:
            _shared(shares, got, shares[at : at + k])
        down[at : at + k] = got[2]
        induce(got[2], at, False)
        a, b = l_range[c]
        own = order[a:b][::-1]
        if len(own):
            s = at + k
            down[s : s + len(own)] = own
            if values:
                shares[s + 1 : s + len(own)] = common[a + 1 : b][::-1]
                shares[s] = min(CAP, int(ahead[got[2, -1]]), int(ahead[own[0]])) if k else 0
            induce(own, s, False)
            at = s + len(own)
        else:
            at += k
    out = np.zeros(total, np.uint8)
    out[1:] = shares[1:][::-1]
    return down[::-1], out
