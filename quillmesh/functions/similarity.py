"""String similarity that sets cannot express, as one Arrow kernel: longest common subsequences by bit-parallel integers,
of all short pairs of a batch at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _rows(a: str) -> dict[str, int]:
    """Bit sets of the places of each character."""
    rows: dict[str, int] = {}
    for i, ch in enumerate(a):
        rows[ch] = rows.get(ch, 0) | 1 << i
    return rows


def _lcs(rows: dict[str, int], n: int, b: str) -> int:
    mask = s = (1 << n) - 1
    for ch in b:
        u = s & rows.get(ch, 0)
        s = ((s + u) | (s - u)) & mask
    return n - s.bit_count()


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    return _lcs(_rows(a), len(a), b) if a and b else 0


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 1.0
    s, gap = len(both), 1 if both else 0
    total = (s + gap + len(left)) + (s + gap + len(right))
    best = 1 - (len(left) + len(right) - 2 * lcs(left, right)) / total
    if both:
        for other in (left, right):
            best = max(best, 1 - (gap + len(other)) / (2 * s + gap + len(other)))
    return best


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter string with any window of the longer one, shorter windows at its ends included.

    A window has no longer a common subsequence than it has common characters; these are counted along, and only
    windows whose bound is above the best ratio so far are aligned, those of the greatest bound first.
    """
    if not a or not b:
        return 0.0

    def one(short: str, long: str, best: float) -> float:
        n, m = len(short), len(long)
        need, common, bounds = Counter(short), 0, []
        for i in range(1 - n, m):  # the window is long[max(0, i) : min(m, i + n)]
            if i + n <= m:
                enters = long[i + n - 1]
                common += need[enters] > 0
                need[enters] -= 1
            if i > 0:
                leaves = long[i - 1]
                need[leaves] += 1
                common -= need[leaves] > 0
            bounds.append((2 * common / (n + min(m, i + n) - max(0, i)), i))
        rows = _rows(short)
        for bound, i in sorted(bounds, reverse=True):
            if bound <= best:
                break
            window = long[max(0, i) : min(m, i + n)]
            best = max(best, 2 * _lcs(rows, n, window) / (n + len(window)))
        return best

    if len(a) > len(b):
        a, b = b, a
    best = one(a, b, 0.0)
    return one(b, a, best) if len(a) == len(b) else best


def lcs_similarity(a: str, b: str) -> float:
    return lcs(a, b) / max(len(a), len(b)) if a and b else 0.0


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a common prefix of up to four characters where it is above 0.7."""
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [ch for ch, u in zip(b, used) if u]
    turned = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - turned) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


NAME = {"n_jw": jaro_winkler, "n_lev": ratio, "n_tokset": token_set, "n_toksort": token_sort, "n_partial": partial, "n_lcs": lcs_similarity}
ADDRESS = {"a_lev": ratio, "a_tokset": token_set, "a_toksort": token_sort}
#: Pairs of strings whose measures a worker holds.
HELD = 50_000


@lru_cache(maxsize=HELD)
def _measures(names: tuple[str, ...], a: str, b: str) -> tuple[float, ...]:
    return tuple(round((NAME | ADDRESS)[n](a, b), 6) for n in names) if a and b else (0.0,) * len(names)


#: Characters that one word of bits can place; longer strings are measured one pair at a time.
BITS = 64
#: Cells of a table of places, and 16 times the windows that are aligned at a time: what a core's cache holds.
CELLS = 1 << 17
_ONES = np.array([(1 << i) - 1 for i in range(BITS + 1)], np.uint64)
_BIT = np.uint64(1) << np.arange(BITS, dtype=np.uint64)


def _rounded(x: np.ndarray) -> np.ndarray:
    """``round(x, 6)`` of each: ties are left to Python, which sees the exact value."""
    y, up = np.round(x, 6), x * 1e6
    tied = np.flatnonzero(np.abs(up - np.floor(up) - 0.5) < 1e-3)
    y[tied] = [round(v, 6) for v in x[tied].tolist()]
    return y


class _Pairs:
    """Pairs of strings of BITS characters at most, as numbers of characters (0 beyond the end), so that a step of an
    alignment is one step for all pairs."""

    def __init__(self, a: list[str], b: list[str]):
        n = len(a)
        self.n, size = n, np.fromiter(map(len, a + b), np.int64, 2 * n)
        chars = np.array(a + b, f"<U{max(1, size.max(initial=1))}").view(np.uint32).reshape(2 * n, -1)
        known = np.zeros(int(chars.max(initial=0)) + 1, bool)
        known[chars] = True
        known[0] = False
        number = np.cumsum(known)
        codes = number[chars]
        self.kinds = int(number[-1]) + 1
        self.a, self.b, self.na, self.nb = codes[:n], codes[n:], size[:n], size[n:]
        self.base = np.arange(n) * self.kinds

    def places(self, codes: np.ndarray) -> np.ndarray:
        """For each pair and character the bits of its places, flat."""
        table = np.zeros(self.n * self.kinds, np.uint64)
        for i in range(codes.shape[1]):
            table[self.base + codes[:, i]] |= _BIT[i]
        table[self.base] = 0
        return table

    def lcs(self) -> np.ndarray:
        table, s = self.places(self.a), np.full(self.n, _ONES[-1])
        for i in range(int(self.nb.max(initial=0))):
            u = s & table[self.base + self.b[:, i]]
            s = (s + u) | (s - u)
        return self.na - np.bitwise_count(s & _ONES[self.na])

    def jaro_winkler(self) -> np.ndarray:
        table, used = self.places(self.b), np.zeros(self.n, np.uint64)
        reach = np.maximum(0, np.maximum(self.na, self.nb) // 2 - 1)
        taken = np.zeros(self.a.shape, bool)
        for i in range(int(self.na.max(initial=0))):
            window = _ONES[np.minimum(self.nb, i + reach + 1)] & ~_ONES[np.minimum(self.nb, np.maximum(0, i - reach))]
            free = table[self.base + self.a[:, i]] & ~used & window
            used |= free & (~free + np.uint64(1))
            taken[:, i] = free != 0
        m = np.bitwise_count(used).astype(np.int64)
        rows, at = np.nonzero(taken)
        other = np.nonzero((used[:, None] & _BIT[: self.b.shape[1]]) != 0)
        turned = np.bincount(rows[self.a[rows, at] != self.b[other]], minlength=self.n) // 2
        with np.errstate(invalid="ignore", divide="ignore"):
            jaro = (m / self.na + m / self.nb + (m - turned) / m) / 3
        prefix, alike = np.zeros(self.n, np.int64), np.ones(self.n, bool)
        for i in range(min(4, self.a.shape[1])):
            alike &= (self.a[:, i] == self.b[:, i]) & (self.a[:, i] > 0)
            prefix += alike
        jaro = np.where(m > 0, jaro, 0.0)
        return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)

    def partial(self) -> np.ndarray:
        """As ``partial``, with every window aligned."""
        swap = self.na > self.nb
        short, long = np.where(swap[:, None], self.b, self.a), np.where(swap[:, None], self.a, self.b)
        n, m = np.minimum(self.na, self.nb), np.maximum(self.na, self.nb)
        best = self._windows(short, long, n, m, np.arange(self.n))
        same = np.flatnonzero(n == m)
        best[same] = np.maximum(best[same], self._windows(long, short, m, n, same))
        return best

    def _windows(self, short: np.ndarray, long: np.ndarray, n: np.ndarray, m: np.ndarray, of: np.ndarray) -> np.ndarray:
        table, out = self.places(short), np.zeros(len(of))
        count = (n + m - 1)[of]
        ends = np.cumsum(count)
        start = 0
        while start < len(of):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CELLS // 16, "right")))
            c = count[start:stop]
            pair = np.repeat(of[start:stop], c)
            first = np.repeat(np.cumsum(c) - c, c)
            shift = np.arange(len(pair)) - first + 1 - n[pair]
            lo, hi = np.maximum(0, shift), np.minimum(m[pair], shift + n[pair])
            length, base = hi - lo, self.base[pair]
            cell, flat, s = pair * long.shape[1] + lo, long.ravel(), np.full(len(pair), _ONES[-1])
            for i in range(int(n[of[start:stop]].max())):
                at = np.minimum(cell + i, len(flat) - 1)
                u = s & np.where(i < length, table[base + flat[at]], np.uint64(0))
                s = (s + u) | (s - u)
            common = n[pair] - np.bitwise_count(s & _ONES[n[pair]])
            out[start:stop] = np.maximum.reduceat(2 * common / (n[pair] + length), np.cumsum(c) - c)
            start = stop
        return out


@lru_cache(maxsize=HELD)
def _parts(text: str) -> tuple[frozenset[str], str]:
    tokens = text.split()
    return frozenset(tokens), " ".join(sorted(tokens))


def _token_set(a: list[str], b: list[str]) -> np.ndarray:
    out, kept, left, right, shared = np.zeros(len(a)), [], [], [], []
    for i, (x, y) in enumerate(zip(a, b)):
        x, y = _parts(x)[0], _parts(y)[0]
        if not x or not y:
            continue
        both = x & y
        if both and (len(both) == len(x) or len(both) == len(y)):
            out[i] = 1.0
            continue
        kept.append(i)
        left.append(" ".join(sorted(x - both)))
        right.append(" ".join(sorted(y - both)))
        shared.append(sum(map(len, both)) + max(0, len(both) - 1))
    if kept:
        s, p = np.array(shared), _Pairs(left, right)
        gap, ends = (s > 0).astype(np.int64), (p.na, p.nb)
        best = 1 - (p.na + p.nb - 2 * p.lcs()) / ((s + gap + p.na) + (s + gap + p.nb))
        for other in ends:
            best = np.where(s > 0, np.maximum(best, 1 - (gap + other) / np.maximum(2 * s + gap + other, 1)), best)
        out[kept] = best
    return out


def _together(names: tuple[str, ...], a: list[str], b: list[str]) -> np.ndarray:
    """A row of measures for each pair of non-empty strings within BITS, a column for each name."""
    p = _Pairs(a, b)
    if len(a) > 1 and p.n * p.kinds > CELLS:
        h = len(a) // 2
        return np.concatenate([_together(names, a[:h], b[:h]), _together(names, a[h:], b[h:])])
    out, common = np.zeros((len(a), len(names))), None
    for i, name in enumerate(names):
        kind = (NAME | ADDRESS)[name]
        if kind in (ratio, lcs_similarity):
            common = p.lcs() if common is None else common
            x = 2 * common / (p.na + p.nb) if kind is ratio else common / np.maximum(p.na, p.nb)
        elif kind is token_sort:
            t = _Pairs([_parts(x)[1] for x in a], [_parts(x)[1] for x in b])
            x = np.where(t.na + t.nb > 0, 2 * t.lcs() / np.maximum(t.na + t.nb, 1), 1.0)
        else:
            x = _token_set(a, b) if kind is token_set else p.partial() if kind is partial else p.jaro_winkler()
        out[:, i] = _rounded(x)
    return out


def measures(names: tuple[str, ...], a: list[str | None], b: list[str | None]) -> np.ndarray:
    """A row of measures for each pair of strings, a column for each name; 0 where either is empty or null. Equal pairs
    are measured once."""
    if not names:
        return np.zeros((len(a), 0))
    number: dict[tuple, int] = {}
    at = np.fromiter((number.setdefault(x, len(number)) for x in zip(a, b)), np.int64, len(a))
    made, short = np.zeros((len(number), len(names))), []
    for i, (x, y) in enumerate(number):
        if x and y:
            if len(x) <= BITS and len(y) <= BITS and "\0" not in x and "\0" not in y:
                short.append(i)
            else:
                made[i] = _measures(names, x, y)
    if short:
        pairs = list(number)
        made[short] = _together(names, [pairs[i][0] for i in short], [pairs[i][1] for i in short])
    return made[at]


def fuzzy_features(pairs: DataFrame, only: list[str] | None = None) -> DataFrame:
    """``pairs`` (q_core, p_core, q_addr, p_addr) with the alignment features, or those of ``only``; 0 where either side
    is empty or null. One pass of Arrow batches, each aligned as a whole; pairs of strings that meet again in a batch are
    measured once."""
    of_name, of_address = (tuple(n for n in kind if only is None or n in only) for kind in (NAME, ADDRESS))
    names = [*of_name, *of_address]
    kept = [c for c in pairs.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("q_core", "p_core", "q_addr", "p_addr")}
            found = np.concatenate([measures(of_name, text["q_core"], text["p_core"]), measures(of_address, text["q_addr"], text["p_addr"])], 1)
            made = [pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *made], names=[*kept, *names])

    schema = T.StructType([*pairs.select(*kept).schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    return pairs.select(*kept).mapInArrow(run, schema)
