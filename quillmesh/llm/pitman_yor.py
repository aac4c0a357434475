"""LM scoring with a hierarchical Pitman-Yor model, seated by Gibbs sampling.

Model. Every word, and the start of a text, is the context of a restaurant whose dishes are all words that follow it.
All these restaurants share one parent, a restaurant of all words, whose own parent is uniform over the words and one
unseen word. P(word | context) sums to one over them.

Seating. A Gibbs sweep draws the table counts of all dishes of a restaurant anew, given their customers: a gamma
variable for each restaurant makes its dishes independent, and a dish's count then has a law that is drawn from
directly (exactly up to EXACT customers or where few tables are expected, by its normal limit where they are many).
The context restaurants are swept first, given unigram probabilities as their parent's; every table of theirs is then
a customer of the parent, which is swept in its turn. Predictive probabilities are those of the mean seating of
SAMPLES sweeps after BURN_IN (ROOT_SAMPLES after ROOT_BURN_IN for the parent). Random variables come from hashes of the
words and the sweep, so that scores depend neither on how rows are dealt to tasks nor on which tasks ran twice.

Scale. All pairs of neighbouring words of all training texts count, none is left out or merged. Texts are read in
groups of some GROUP_BYTES; a group's distinct pairs are cut by ranges of their context's hash and sent packed, one
entry a pair and group. A context with more than a set share of all tokens is split by its dishes' hashes into ranges of
their own: its sweeps are made together, each with the tables of all of its shards, before its shards are seated by the
variables so drawn. A range adds up its pairs, seats its restaurants, and answers each group with the customers and
tables of its entries, in a file of the shared folder; the tables go on, packed by ranges of the word's hash, to the
parent. Groups are read again to score their texts. The values of the most frequent words, KNOWN at most, are
broadcast, and such words travel as their rank; those of each group's other words are asked for by ranges of the word's
hash, their counts before the pairs are sent. Neither what is split nor what is broadcast changes a score.

The input has to be a table (files), since it is read twice and its rows are numbered by the scan.

Defined cases: an empty table gives no rows; a null or empty text is the end alone; texts may be as long as a batch
can hold; a null doc_id counts as the empty text for the split into folds; a corpus without training texts gives
N = V = 0 and a uniform model; repeated rows are texts of their own; words of one count that tie at KNOWN are all
joined; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .packing import pack, unpack
from .storage import collect, discard, materialize, parts, shared_dir

KNOWN = 400_000
DISCOUNT, STRENGTH = 0.75, 1.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.5, 1.0
BURN_IN, SAMPLES = 2, 3
ROOT_BURN_IN, ROOT_SAMPLES = 2, 2
GROUP_BYTES = 6 << 20
#: Text whose pairs meet in one range.
RANGE_BYTES = 16 << 20
#: A context of more tokens than this, or than all tokens over 2**20 if that is more, is split.
SPLIT = 1 << 20
EXACT, FEW = 256, 90
SEED = 7
END = np.uint64(0x5BD1E995A7F3C2D1)
#: Marks the cells of a split context among answers to groups (0 or more) and to ranges of words (small negatives).
CELLS = -(1 << 62)
#: The start of a text as a context: the greatest of all hashes.
START = np.uint64(0xFFFFFFFFFFFFFFFF)
ROW = "__row"


def uniforms(keys: np.ndarray, step: int) -> np.ndarray:
    """One number in (0, 1) for each key (uint64) and step."""
    with np.errstate(over="ignore"):
        x = K.mix(K.mix(keys ^ np.uint64(SEED)) + np.uint64(step + 1) * np.uint64(0x9E3779B97F4A7C15))
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def normals(keys: np.ndarray, step: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(uniforms(keys, 2 * step))) * np.cos(2 * np.pi * uniforms(keys, 2 * step + 1))


def gammas(shape: np.ndarray, keys: np.ndarray, step: int) -> np.ndarray:
    """Gamma variables of shapes of 1 or more, by squeezing a transformed normal one (Marsaglia and Tsang)."""
    d = shape - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, todo, attempt = np.zeros(len(shape)), np.arange(len(shape)), 0
    while len(todo):
        at = 1_000_000 + 1000 * step + 4 * attempt
        x, u = normals(keys[todo], at), uniforms(keys[todo], 2 * at + 3)
        v = (1 + c[todo] * x) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            ok = (v > 0) & (np.log(u) < 0.5 * x * x + d[todo] * (1 - v + np.log(v)))
        out[todo[ok]] = (d[todo] * v)[ok]
        todo, attempt = todo[~ok], attempt + 1
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of 100 or more."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


@functools.cache
def _stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers [customers, tables] up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, EXACT):
        t = np.arange(1, c + 1)
        out[c + 1, 1 : c + 1] = np.log(c - discount * t) + out[c, 1 : c + 1]
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c + 1, 1 : c + 2], out[c, : c + 1])
    return out


@functools.cache
def _few(discount: float) -> np.ndarray:
    """[j, t]: the weights of gamma(c - discount * j) / gamma(c) in the chance that t tables have c customers."""
    t = j = range(1, FEW + 1)
    part = lambda j, t: (-1) ** (j + 1) * math.comb(t, j) * math.gamma(1 + discount * j) * math.sin(math.pi * discount * j) / math.pi
    return np.array([[part(x, y) for y in t] for x in j])


def draw_tables(c: np.ndarray, rate: np.ndarray, discount: float, chance: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """Table counts of dishes of c customers: Poisson(rate) tables of Sibuya(discount) sizes, given their sum c.

    Up to EXACT customers by the generalised Stirling numbers. Above, by the alternating sum for the chance of c where
    few tables are expected, else by the normal law at the saddle point of the sum, whose tables are many. ``chance``
    and ``normal`` are a uniform and a normal variable for each dish.
    """
    out = np.ones(len(c), np.int64)

    def pick(at: np.ndarray, logs: np.ndarray) -> None:
        p = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), 1)
        out[at] = 1 + (p < (chance[at] * p[:, -1])[:, None]).sum(1)

    small = np.flatnonzero((c > 1) & (c <= EXACT))
    small = small[np.argsort(c[small], kind="stable")]
    while len(small):
        width = int(c[small[min(len(small), 4096) - 1]])
        at, small = small[:4096], small[4096:]
        pick(at, _stirling(discount)[c[at], 1 : width + 1] + np.arange(1, width + 1) * np.log(discount * rate[at])[:, None])
    large = np.flatnonzero(c > EXACT)
    if len(large):
        n, lam = c[large].astype(float), rate[large]
        low, high = np.full(len(n), -700.0), np.zeros(len(n))  # log(1 - r), r the saddle point
        for _ in range(60):
            mid = (low + high) / 2
            more = np.log(lam * discount) + np.log(-np.expm1(mid)) + (discount - 1) * mid > np.log(n)
            low, high = np.where(more, mid, low), np.where(more, high, mid)
        u = np.exp((low + high) / 2)
        mean = lam * (1 - u**discount)
        var = mean - n / (1 + (1 - u) * (1 - discount) / u)
        few = mean <= FEW / 3
        many = np.rint(mean + np.sqrt(np.maximum(var, 0)) * normal[large])
        out[large] = np.clip(many, 1, n).astype(np.int64)
        at = np.flatnonzero(few)
        for at in np.array_split(at, len(at) // 4096 + 1):
            t = np.arange(1, FEW + 1)
            x = n[at][:, None]
            weight = np.exp(_log_gamma(x - discount * t) - _log_gamma(x)) @ _few(discount)
            fact = np.array([math.lgamma(y + 1) for y in t])
            if len(at):
                pick(large[at], np.log(np.maximum(weight, 1e-300)) + t * np.log(lam[at])[:, None] - fact)
    return out


def _first_tables(c: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(c.astype(float) ** DISCOUNT / 2), 1, c).astype(np.int64)


def seat(c: np.ndarray, keys: np.ndarray, restaurant: np.ndarray, names: np.ndarray, parent: np.ndarray, shards: np.ndarray, scales: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seats dishes of c customers: (mean tables of each dish, mean tables of each restaurant, tables of the last sweep).

    ``restaurant`` numbers a dish's restaurant, ``names`` are their keys, ``parent`` is a dish's parent probability,
    ``shards`` by how much its tables are multiplied. One customer is one table. ``scales`` are gamma variables for each
    sweep and restaurant that were drawn before, with the tables of dishes that are not here.
    """
    n = len(names)
    many = np.flatnonzero(c > 1)
    own, place, up, key = c[many], restaurant[many], parent[many], keys[many]
    alone = np.bincount(restaurant, c == 1, n)
    t = _first_tables(own)
    mean, tables = np.zeros(len(many)), np.zeros(n)
    for step in range(BURN_IN + SAMPLES):
        scale = gammas(STRENGTH / DISCOUNT + (alone + np.bincount(place, t, n)) * shards, names, step) if scales is None else scales[step]
        t = draw_tables(own, np.maximum(scale[place] * up, 1e-300), DISCOUNT, uniforms(key, 4 * step), normals(key, 2 * step + 1))
        if step >= BURN_IN:
            mean += t
            tables += (alone + np.bincount(place, t, n)) * shards
    each, last = (c > 0).astype(float), (c > 0).astype(np.int64)
    each[many], last[many] = mean / SAMPLES, t
    return each, tables / SAMPLES, last


class _Tokens:
    """Token hashes of the texts of a slice, an end after each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, first = K.spans(K.NOT_SPACE[data], offsets)
        n = len(first) - 1
        h = K.span_hashes(K.LOWER[data], starts, ends)
        self.first = first + np.arange(n + 1)
        self.hash = np.full(len(h) + n, END)
        body = np.ones(len(self.hash), bool)
        body[self.first[1:] - 1] = False
        self.hash[body] = h


def _lookup(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of h in sorted keys and which are there."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64())], names=["h", "c"])

    for batch in batches:
        for _, data, offsets in K.slices(batch, "text"):
            held.append(_Tokens(data, offsets).hash)
            size += len(data)
            if size >= GROUP_BYTES:
                yield flush()
                size = 0
    if held:
        yield flush()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[pa.RecordBatch, _Tokens]]]]:
    """(number, slices) of consecutive rows of some GROUP_BYTES of text, cut at the same rows however batches fall."""
    before, now, held = 0, None, []
    for batch in batches:
        for rows, data, offsets in K.slices(batch, "text"):
            number = (before + offsets[:-1]) // GROUP_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(cuts, cuts[1:]):
                part = rows.select([ROW, "doc_id", "held_out"]).slice(a, b - a)  # not the text
                name = (part.column(part.schema.get_field_index(ROW))[0].as_py() >> 33 << 33) + int(number[a])
                if held and name != now:
                    yield now, held
                    held = []
                now = name
                held.append((part, _Tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])))
            before += len(data)
    if held:
        yield now, held


class _Pairs:
    """The distinct pairs (context, word) of a group, in order of the ranges they are sent to."""

    def __init__(self, held: list[tuple[pa.RecordBatch, _Tokens]], hot: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], n_parts: int):
        tokens = np.concatenate([x.hash for _, x in held])
        sizes = np.concatenate([np.diff(x.first) for _, x in held])
        self.words, self.code = np.unique(tokens, return_inverse=True)
        n = len(self.words)
        context = np.empty(len(tokens), np.int64)
        context[1:] = self.code[:-1]
        context[np.cumsum(sizes) - sizes] = n
        pairs, self.entry = np.unique(context * (n + 1) + self.code, return_inverse=True)
        self.context, self.word = np.divmod(pairs, n + 1)
        names = np.append(self.words, START)
        at, split = _lookup(hot[0], names)
        shards = np.where(split, hot[2][at], 1).astype(np.uint64) if len(hot[0]) else np.ones(n + 1, np.uint64)
        shard = ((self.words[self.word] >> np.uint64(32)) * shards[self.context]) >> np.uint64(32)
        part = ((K.mix(names[self.context]) >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)
        if len(hot[0]):
            part = np.where(split[self.context], np.uint64(n_parts) + hot[3][at[self.context]].astype(np.uint64) + shard, part)
        self.order = np.argsort(part, kind="stable")
        self.part = part[self.order].astype(np.int64)
        self.names = names

    def cuts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(range, entries in order, first of each run of one context)."""
        edges = np.flatnonzero(np.diff(self.part, prepend=-1, append=-1)).tolist()
        for a, b in zip(edges, edges[1:]):
            at = self.order[a:b]
            yield int(self.part[a]), at, np.flatnonzero(np.diff(self.context[at], prepend=-1))


#: Contexts as ranks, hashes of those without; lengths of their runs; words alike; counts; levels of words without ranks.
_REQUEST = [np.uint32, np.uint64, np.uint32, np.uint32, np.uint64, np.uint32, np.uint8]
#: Customers of an entry, its tables in all samples beyond one in each; tables of a run's context in all samples.
_ANSWER = [np.uint32, np.uint32, np.uint64]


def _ranked(codes: np.ndarray, rest: np.ndarray, by_rank: np.ndarray) -> np.ndarray:
    """Hashes of ranks from 1 on; of 0 the next of ``rest``."""
    out, on = np.empty(len(codes), np.uint64), codes > 0
    out[on], out[~on] = by_rank[codes[on] - 1], rest
    return out


def _levels(c: np.ndarray, floor: float, norm: float) -> np.ndarray:
    """Probabilities of words of c customers in eighths of an octave."""
    return np.clip(np.rint(-8 * np.log2((c + floor) / norm)), 0, 255).astype(np.uint8)


def _counts(words: np.ndarray, keys: np.ndarray, counts: np.ndarray, store, path: str) -> np.ndarray:
    """Training counts of a group's words: of the frequent ones, and as answered of the others."""
    at, found = _lookup(keys, words)
    c = np.where(found, counts[at] if len(counts) else 0, 0)
    if not found.all():
        c[~found] = np.concatenate([x[0] for x in _read_answers(store, path, [np.int64])])
    return c


def _requests(hot, known, n_parts: int, floor: float, norm: float, uri: str, whole: bool):
    """(part, to, blob): the entries of each group by range: contexts, words, training counts, parent probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, rank = known.value
        store, place = _open(uri)
        for group, held in _groups(batches):
            p = _Pairs(held, hot.value, n_parts)
            train = np.concatenate([np.repeat(~rows.column(rows.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False).astype(bool), np.diff(x.first)) for rows, x in held])
            c = np.bincount(p.entry, train, len(p.word)).astype(np.uint32)
            at, found = _lookup(keys, p.names)
            ranks = np.where(found, rank[at] + 1 if len(rank) else 0, 0).astype(np.uint32)
            own = np.where(found[:-1], counts[at[:-1]] if len(counts) else 0, 0) if whole else _counts(p.words, keys, counts, store, f"{place}/{group}-counts")
            level = _levels(own, floor, norm)
            parts_, blobs, size = [], [], 0
            for part, e, first in p.cuts():
                runs = np.diff(np.append(first, len(e))).astype(np.uint32)
                u, w = p.context[e[first]], p.word[e]
                rest = w[~found[w]]
                blobs.append(pack(ranks[u], p.names[u[~found[u]]], runs, ranks[w], p.words[rest], c[e], level[rest]))
                parts_.append(part)
                size += len(blobs[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(parts_, pa.int32()), pa.array([group] * len(parts_), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "to", "blob"])
                    parts_, blobs, size = [], [], 0
            if parts_:
                yield pa.RecordBatch.from_arrays([pa.array(parts_, pa.int32()), pa.array([group] * len(parts_), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "to", "blob"])

    return run


def _seated(hot, known, n_parts: int, n_words: int, floor: float, norm: float, drawn=None):
    """For one range: its answer to each group (to >= 0), and its tables by range of words (to < 0). A shard of a split
    context is given back with its cells, until ``drawn`` has its gamma variables and tables."""

    def run(table: pa.Table) -> pa.Table:
        hashes, counts, _, base = hot.value
        part = table["part"][0].as_py()
        groups = table["to"].to_pylist()
        keys_, counts_, rank = known.value
        by_rank, level_of = np.empty(len(keys_), np.uint64), np.empty(len(keys_), np.uint8)
        by_rank[rank], level_of[rank] = keys_, _levels(counts_, floor, norm)
        blobs = [unpack(x.as_buffer(), _REQUEST) for x in table["blob"]]
        with np.errstate(over="ignore"):
            runs = [_ranked(x[0], x[1], by_rank) for x in blobs]
            context = np.concatenate([np.repeat(u, x[2]) for u, x in zip(runs, blobs)])
            word = np.concatenate([_ranked(x[3], x[4], by_rank) for x in blobs])
            ranks, c = (np.concatenate([x[i] for x in blobs]) for i in (3, 5))
            code = np.empty(len(ranks), np.uint8)
            code[ranks > 0], code[ranks == 0] = level_of[ranks[ranks > 0] - 1], np.concatenate([x[6] for x in blobs])
            key = K.mix(context + K.mix(word) * np.uint64(3))
        keys, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        total = np.bincount(inverse, c, len(keys)).astype(np.int64)
        names, restaurant = np.unique(context[first], return_inverse=True)
        cells = np.flatnonzero(total)
        if part >= n_parts and drawn is None:
            held = pack(keys[cells], total[cells], code[first][cells])
            return pa.concat_tables([table, pa.table({"part": pa.array([part], pa.int32()), "to": pa.array([CELLS], pa.int64()), "blob": pa.array([held], pa.binary())})])
        scales, of_all = None, None
        if part >= n_parts:  # a part of one context
            at = np.searchsorted(base, part - n_parts, "right") - 1
            scales, of_all = drawn.value[0][:, [at]], drawn.value[1][at]
        mean, tables, last = seat(total[cells], keys[cells], restaurant[cells], names, 2.0 ** (code[first][cells] / -8.0), np.ones(len(names)), scales)
        more = np.zeros(len(keys), np.uint32)
        more[cells] = np.rint((mean - 1) * SAMPLES)
        tables = np.rint(tables * SAMPLES if of_all is None else np.full(len(names), of_all)).astype(np.uint64)
        total = total.astype(np.uint32)
        ends = np.cumsum([len(x[3]) for x in blobs])
        out_to, out = list(groups), [pack(total[i], more[i], tables[np.searchsorted(names, u)]) for i, u in zip(np.split(inverse, ends[:-1]), runs)]
        words, back_to = np.unique(word[first][cells], return_inverse=True)
        served = np.bincount(back_to, last, len(words)).astype(np.uint64)
        cuts, ranges = _word_cuts(words, n_words)
        for a, b, r in zip(cuts, cuts[1:], ranges):
            out_to.append(-1 - r)
            out.append(pack(np.diff(words[a:b], prepend=np.uint64(0)), served[a:b]))
        made = pa.table({"part": pa.array([part] * len(out), pa.int32()), "to": pa.array(out_to, pa.int64()), "blob": pa.array(out, pa.binary())})
        del blobs, runs, context, word, c, code, ranks, key, keys, inverse, out
        K.trim()
        return made

    return run


def _hot_tables(hot, n_parts: int, step: int, scales: np.ndarray | None):
    """(context, tables) of each shard's cells before the first sweep, or after one with these gamma variables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(hot.value[3], batch.column(0).to_numpy() - n_parts, "right") - 1
            tables = []
            for i, blob in zip(at, batch.column(1)):
                key, c, code = unpack(blob.as_buffer(), [np.uint64, np.int64, np.uint8])
                many = c > 1
                key, own, up = key[many], c[many], 2.0 ** (code[many] / -8.0)
                t = _first_tables(own) if scales is None else draw_tables(own, np.maximum(scales[i] * up, 1e-300), DISCOUNT, uniforms(key, 4 * step), normals(key, 2 * step + 1))
                tables.append(int(t.sum()) + int((~many).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(tables, pa.int64())], names=["at", "t"])

    return run


def _sweep_hot(cells: DataFrame, hot, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """For split contexts the gamma variables [sweep, context], and their tables in all samples."""
    names = hot.value[0]

    def tables(step: int, scales: np.ndarray | None) -> np.ndarray:
        out = np.zeros(len(names))
        for at, t in cells.mapInArrow(_hot_tables(hot, n_parts, step, scales), "at long, t long").groupBy("at").agg(F.sum("t")).collect():
            out[at] = t
        return out

    scales, now, kept = [], tables(-1, None), np.zeros(len(names))
    for step in range(BURN_IN + SAMPLES):
        scales.append(gammas(STRENGTH / DISCOUNT + now, names, step))
        now = tables(step, scales[-1])
        if step >= BURN_IN:
            kept += now
    return np.array(scales), kept


def _served(table: pa.Table) -> pa.Table:
    """(h, served) of one range of words."""
    blobs = [unpack(x.as_buffer(), [np.uint64, np.uint64]) for x in table["blob"]]
    words, inverse = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in blobs]), return_inverse=True)
    served = np.bincount(inverse, np.concatenate([x[1] for x in blobs]), len(words)).astype(np.int64)
    return pa.table({"h": pa.array(words.view(np.int64)), "served": pa.array(served)})


def _rare(known, n_words: int):
    """(part, to, blob): the words of each group that are not among the frequent ones, by range of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = known.value[0]
        for group, held in _groups(batches):
            words = np.unique(np.concatenate([x.hash for _, x in held]))
            words = words[~_lookup(keys, words)[1]]
            cuts, parts_ = _word_cuts(words, n_words)
            blobs = [pack(np.diff(words[a:b], prepend=np.uint64(0))) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(parts_, pa.int64()), pa.array([group] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "to", "blob"])

    return run


def _word_cuts(words: np.ndarray, n_words: int) -> tuple[list[int], list[int]]:
    """Where sorted words cross from one range to the next, and the ranges."""
    ranges = (((words >> np.uint64(32)) * np.uint64(n_words)) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(ranges, prepend=-1, append=-1)).tolist()
    return cuts, ranges[cuts[:-1]].tolist()


def _answered(*columns: str):
    """For each group's words of one range these columns (zeros for unseen words)."""

    def run(asked: pa.Table, words: pa.Table) -> pa.Table:
        h = words["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, values = h[order], [words[c].to_numpy()[order] for c in columns]
        blobs = []
        for blob in asked["blob"]:
            at, found = _lookup(h, np.cumsum(unpack(blob.as_buffer(), [np.uint64])[0], dtype=np.uint64))
            blobs.append(pack(*(np.where(found, v[at], 0).astype(v.dtype) if len(h) else np.zeros(len(at), v.dtype) for v in values)))
        return pa.table({"part": asked["part"].cast(pa.int64()), "to": asked["to"], "blob": pa.array(blobs, pa.binary())})

    return run


def _root_draws(scales: list[float], size: int):
    """Tables of each word in the parent, for each of the sweeps whose gamma variables are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c = batch.column(0).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            drawn = [draw_tables(c, np.full(len(c), max(x / (size + 1), 1e-300)), ROOT_DISCOUNT, uniforms(h, 5000 + 4 * i), normals(h, 5000 + 2 * i + 1)) for i, x in scales]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.mean(drawn, 0) if len(c) else np.zeros(0))], names=["h", "c", "served", "t"])

    return run


def _root(words: DataFrame, size: int) -> tuple[DataFrame, float]:
    """``words`` (h, c, served) with the mean tables t of each in the parent, and the sum of t."""
    schema = "h long, c long, served long, t double"
    tables, scales = float(size), []
    for step in range(ROOT_BURN_IN + ROOT_SAMPLES):
        scale = float(gammas(np.array([ROOT_STRENGTH / ROOT_DISCOUNT + tables]), np.array([SEED], np.uint64), 900 + step)[0])
        scales.append((step, scale))
        tables = float(words.mapInArrow(_root_draws(scales[-1:], size), schema).agg(F.coalesce(F.sum("t"), F.lit(0.0))).first()[0])
    seated = materialize(words.mapInArrow(_root_draws(scales[ROOT_BURN_IN:], size), schema), "words")
    return seated, float(seated.agg(F.coalesce(F.sum("t"), F.lit(0.0))).first()[0])


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _write_answers(uri: str, suffix: str):
    """One file for each group: its answers in order of ranges. A task that runs again leaves the same file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open(uri)
        now, out, draft, done = None, None, "", []

        def close() -> None:
            if out is not None:
                out.close()
                store.move(draft, f"{folder}/{now}{suffix}")
                done.append(now)

        for batch in batches:
            for group, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if group != now:
                    close()
                    now, draft = group, f"{folder}/_{group}{suffix}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(draft)
                out.write(len(blob).to_bytes(8, "little") + blob)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["to"])

    return run


def _read_answers(store: pafs.FileSystem, path: str, kinds: list) -> Iterator[list[np.ndarray]]:
    with store.open_input_stream(path) as f:
        raw = f.read()
    at = 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 8], "little")
        yield unpack(raw[at + 8 : at + 8 + size], kinds)
        at += 8 + size


def _shards(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The shards of each split context, and those before it."""
    shards = np.array(sizes, np.int64)
    return shards, np.cumsum(shards) - shards


def score(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every text."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    held_out = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5) == 1
    numbered = docs.select(F.monotonically_increasing_id().alias(ROW), "doc_id", held_out.alias("held_out"), F.col(text).alias("text"))
    training = numbered.where(~F.col("held_out")).select("text")
    lexicon = materialize(training.mapInArrow(K.give_back(_unigrams), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "lexicon")
    total, size = lexicon.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_bytes, n_texts = numbered.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.coalesce(F.sum((~F.col("held_out")).cast("long")), F.lit(0))).first()
    n_parts = max(2 * parts(spark), n_bytes // RANGE_BYTES + 1)
    n_words = max(parts(spark), n_parts // 4)  # ranges of words: a range of pairs sends a row to each
    most = max(SPLIT, total >> 20)
    rows = lexicon.where(F.col("c") > most).collect()  # 2**20 at most
    hot_counts = sorted([(int(np.int64(r.h).view(np.uint64)), r.c) for r in rows if np.int64(r.h).view(np.uint64) != END] + ([(int(START), n_texts)] if n_texts > most else []))
    hot = sc.broadcast((np.array([h for h, _ in hot_counts], np.uint64), np.array([c for _, c in hot_counts], np.int64), *_shards([c // most + 1 for _, c in hot_counts])))
    # the levels of count that hold KNOWN words at most, the most frequent first
    level = F.floor(4 * F.log2("c"))
    histogram = sorted(((r[0], r[1]) for r in lexicon.groupBy(level).count().collect()), reverse=True)  # a few hundred levels at most
    least, taken = None, 0
    for at, count in histogram:
        if taken + count > KNOWN:
            break
        least, taken = at, taken + count
    whole = taken == size

    def frequent(table: DataFrame, *columns: str) -> list[np.ndarray]:
        held = (table.where(level >= least) if least is not None else table.limit(0)).select("h", *columns).toArrow()  # KNOWN at most
        h = held["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        return [h[order], *(held[c].to_numpy()[order] for c in columns)]

    floor, norm = 0.5, total + 0.5 * (size + 1)
    keys, counts = frequent(lexicon, "c")
    rank = np.empty(len(keys), np.int64)
    rank[np.lexsort((keys, -counts))] = np.arange(len(keys))
    known = sc.broadcast((keys, counts, rank))
    uri = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    fs, folder = _open(uri)
    fs.create_dir(folder, recursive=True)

    def write(table: DataFrame, suffix: str) -> None:
        table.repartition("to").sortWithinPartitions("to", "part").select("to", "blob").mapInArrow(_write_answers(uri, suffix), "to long").count()

    def answer(words: DataFrame, suffix: str, *columns: str) -> None:
        place = F.shiftright(F.shiftrightunsigned("h", 32) * n_words, 32).alias("part")
        found = asked.groupBy("part").cogroup(words.select(place, "h", *columns).groupBy("part")).applyInArrow(_answered(*columns), "part long, to long, blob binary")
        write(found, suffix)

    if not whole:
        asked = materialize(numbered.mapInArrow(K.give_back(_rare(known, n_words)), "part long, to long, blob binary"), "asked")
        answer(lexicon, "-counts", "c")
        collect(spark)
    schema = "part int, to long, blob binary"
    entries = numbered.mapInArrow(K.give_back(_requests(hot, known, n_parts, floor, norm, uri, whole)), schema)
    seating = functools.partial(_seated, hot, known, n_parts, n_words, floor, norm)
    seated = [materialize(entries.groupBy("part").applyInArrow(seating(), schema), "seated")]
    answers = seated[0].where(f"part < {n_parts}")
    if hot_counts:
        drawn = sc.broadcast(_sweep_hot(seated[0].where(f"to = {CELLS}").select("part", "blob"), hot, n_parts))
        seated.append(materialize(seated[0].where(f"part >= {n_parts} and to >= 0").groupBy("part").applyInArrow(seating(drawn), schema), "seated"))
        answers = answers.union(seated[1])
    collect(spark)  # the shuffle files of the entries go
    served = answers.where("to < 0").select("to", "blob").groupBy("to").applyInArrow(_served, "h long, served long")
    joined = materialize(lexicon.join(served, "h").select("h", "c", "served"), "served")
    words, tables = _root(joined, size)
    customers = int(joined.agg(F.coalesce(F.sum("served"), F.lit(0))).first()[0])
    write(answers.where("to >= 0"), "-pairs")
    discard(*seated, joined, lexicon)  # and the shuffle files of the answers, before those of the rare words are made
    if not whole:
        answer(words, "-words", "served", "t")
        discard(asked)
    share = (ROOT_STRENGTH + ROOT_DISCOUNT * tables) / (size + 1)
    below = ROOT_STRENGTH + customers
    table = sc.broadcast(tuple(frequent(words, "c", "served", "t")))

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, served_, t = table.value
        root = (served_ - ROOT_DISCOUNT * t + share) / below
        store, place = _open(uri)
        for group, held in _groups(batches):
            p = _Pairs(held, hot.value, n_parts)
            at, found = _lookup(keys, p.words)
            up = np.where(found, root[at] if len(root) else 0.0, share / below)
            if whole:
                c = np.where(found, counts[at] if len(counts) else 0, 0)
            else:
                c = _counts(p.words, keys, counts, store, f"{place}/{group}-counts")
                if not found.all():
                    rest = [np.concatenate(x) for x in zip(*_read_answers(store, f"{place}/{group}-words", [np.int64, np.float64]))]
                    up[~found] = (rest[0] - ROOT_DISCOUNT * rest[1] + share) / below
            customers_ = STRENGTH + np.append(c, n_texts)[p.context]  # a word but the end is followed once each time
            value, back = np.zeros(len(p.word)), np.zeros(len(p.word))
            for (_, e, first), (own, more, tables_) in zip(p.cuts(), _read_answers(store, f"{place}/{group}-pairs", _ANSWER)):
                value[e] = np.where(own > 0, own - DISCOUNT * (1 + more / SAMPLES), 0) / customers_[e]
                back[e] = (STRENGTH + DISCOUNT * np.repeat(tables_, np.diff(np.append(first, len(e)))) / SAMPLES) / customers_[e]
            per_entry = np.log10(value + back * up[p.word])
            base_of = np.log10((c + floor) / norm)
            cut = 0
            for rows_, x in held:
                n = len(x.hash)
                code, entry = p.code[cut : cut + n], p.entry[cut : cut + n]
                cut += n
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rows_.column(rows_.schema.get_field_index(name)) for name in (ROW, "doc_id", "held_out")),
                        pa.array(np.diff(x.first), pa.int64()),
                        pa.array(K.row_sums(c[code] > 0, x.first), pa.int64()),
                        pa.array(K.row_sums(base_of[code], x.first)),
                        pa.array(K.row_sums(per_entry[entry], x.first)),
                    ],
                    names=[ROW, "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = numbered.mapInArrow(K.give_back(evaluate), f"{ROW} long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return score(docs.select("doc_id", "text")).drop("perplexity")
