"""Benchmark decontamination by winnowing.

A text is a sequence of words (runs of digits, a-z after lower-casing A-Z, and characters beyond ASCII).
Of every ``w`` consecutive ``k``-grams the rightmost one with the least hash is kept as a fingerprint, so that any
shared span of at least ``w + k - 1 = window`` words shares a fingerprint whatever its place. Fingerprints of
documents are joined with those of the benchmark. A joined place is extended to both sides over the windows that
cover it: each that is a window of an item is a hit, and hits that touch or overlap are one span. So a place costs
``w`` lookups, however often its words occur in the text or in the benchmark. An item with fewer words is one window
of its own length: it is winnowed with ``k = length, w = 1`` (every gram kept), which keeps the guarantee.

The benchmark's size is measured first. Up to BROADCAST_BYTES of text its fingerprints and windows are broadcast and
the documents read once, without a shuffle. A larger one is never gathered: the fingerprints of both sides are joined
by Spark, and texts with a joined place are read again and their windows joined (documents are then numbered by the
scan, so they have to be a table).

Defined cases: empty tables (no documents: no rows; no items: no hits); a null or empty text has no words and no
hits; a null item text or one without words has no window; texts may be as long as a batch can hold; equal least
hashes in a window are settled by the rightmost; repeated rows of either table are judged alike; several items with
one text all count; an item id of null is reported as the string "null"; extra columns pass through, those with the
names of the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .storage import materialize

WINDOW = 10
GRAM = 5
#: Text and ids of a benchmark that is broadcast.
BROADCAST_BYTES = 16 << 20
ROW = "__row"
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


class Words:
    """The words of many texts, one after another: byte spans, hashes and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = K.LOWER[data]
        self.starts, self.ends, self.first = K.spans(K.ALNUM[self.data], offsets)
        self.hashes = K.span_hashes(self.data, self.starts, self.ends)
        self.raw = self.data.tobytes()

    def spell(self, i: int, n: int) -> list[bytes]:
        """n words from word i on."""
        return [self.raw[a:b] for a, b in zip(self.starts[i : i + n].tolist(), self.ends[i : i + n].tolist())]

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k words from each word on, NONE where the text ends before."""
        out = np.full(len(self.hashes), NONE)
        g = K.window_hashes(self.hashes, k)
        out[: len(g)] = np.minimum(g, NONE - np.uint64(1))
        n = self.first[1:] - self.first[:-1]
        tail = np.minimum(n, k - 1)
        out[K.ragged(self.first[1:] - tail, tail)] = NONE
        return out

    def fingerprints(self, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes kept by winnowing: each is the rightmost of the least of some window of w grams."""
        g = self.grams(k)
        if w > 1 and len(g):
            n = self.first[1:] - self.first[:-1]
            low, place = np.append(g, np.full(w - 1, NONE)), np.arange(len(g) + w - 1)
            width = 1
            while width < w:  # doubling gives the least of w in log2(w) passes
                step = min(width, w - width)
                right = low[step:] <= low[: len(low) - step]
                low[: len(low) - step] = np.where(right, low[step:], low[: len(low) - step])
                place[: len(low) - step] = np.where(right, place[step:], place[: len(low) - step])
                width += step
            place = place[: len(g)]
            whole = np.ones(len(g), bool)
            tail = np.minimum(n, k + w - 2)  # windows that would leave the text
            whole[K.ragged(self.first[1:] - tail, tail)] = False
            at = np.unique(place[whole])
        else:
            at = np.flatnonzero(g != NONE)
        return at, g[at]

    def joined(self, at: np.ndarray, k: int, w: int) -> np.ndarray:
        """The starts of the windows of k + w - 1 words that cover the k-gram at one of the places ``at``."""
        starts = np.unique((at[:, None] - np.arange(w)).ravel())
        text = np.searchsorted(self.first, at, "right") - 1
        starts = starts[starts >= 0]
        own = np.searchsorted(self.first, starts, "right") - 1
        return starts[(starts + k + w - 1 <= self.first[own + 1]) & np.isin(own, text)]


def shapes(sizes: Iterable[int], window: int, gram: int) -> list[tuple[int, int, int]]:
    """(window, k, w) for each length of window that items have."""
    return [(size, gram, window - gram + 1) if size == window else (size, size, 1) for size in sorted(set(sizes))]


def _in(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of h in sorted keys, and which are there."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def item_windows(words: Words, window: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of window: (length, fingerprints, starts of windows, hashes of windows) of its items."""
    n = words.first[1:] - words.first[:-1]
    for size, k, w in shapes((int(min(x, window)) for x in n if x), window, gram):
        mine = np.minimum(n, window) == size
        at, h = words.fingerprints(k, w)
        h = h[mine[np.searchsorted(words.first, at, "right") - 1]]
        g = words.grams(size)
        starts = np.flatnonzero(g != NONE)
        starts = starts[mine[np.searchsorted(words.first, starts, "right") - 1]]
        yield size, np.unique(h), starts, g[starts]


class Table:
    """Fingerprints and windows of the benchmark, sorted for lookups."""

    def __init__(self, ids: list, texts: list, window: int, gram: int):
        self.ids = ["null" if x is None else str(x) for x in ids]
        raw = [(x or "").encode() for x in texts]
        words = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        self.parts = []  # (window, k, w, fingerprints, window hashes, first of each hash in items, items, words of each hash)
        for (size, fingerprints, starts, h), (_, k, w) in zip(item_windows(words, window, gram), shapes((int(min(x, window)) for x in np.diff(words.first) if x), window, gram)):
            item = np.searchsorted(words.first, starts, "right") - 1
            order = np.lexsort((item, h))
            h, item, starts = h[order], item[order], starts[order]
            new = np.append(True, (h[1:] != h[:-1]) | (item[1:] != item[:-1]))
            h, item, starts = h[new], item[new], starts[new]
            keys, first = np.unique(h, return_index=True)
            spelled = [words.spell(i, size) for i in starts[first].tolist()]
            self.parts.append((size, k, w, fingerprints, keys, np.append(first, len(h)), item, spelled))

    def hits(self, doc: Words) -> Iterator[tuple[int, int, list[str]]]:
        """(start, end, items) of every window of a text that is an item's and covers a joined fingerprint."""
        for size, k, w, fingerprints, keys, first, item, spelled in self.parts:
            at, h = doc.fingerprints(k, w)
            starts = doc.joined(at[_in(fingerprints, h)[1]], k, w)
            if not len(starts):
                continue
            g = doc.grams(size)[starts]
            at, found = _in(keys, g)
            same: dict[int, bool] = {}
            for i, key in zip(starts[found].tolist(), at[found].tolist()):
                if key not in same:  # hashes are equal: compare the words once for each window
                    same[key] = doc.spell(i, size) == spelled[key]
                if same[key]:
                    yield i, i + size, [self.ids[x] for x in item[first[key] : first[key + 1]].tolist()]


def _merged(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _result(words: Words, hits: list[tuple[list, set]]) -> list[pa.Array]:
    """The columns of RESULT from the hit windows and items of each text."""
    spans = [_merged(where) for where, _ in hits]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64()))]
    values = [words.first[1:] - words.first[:-1], [sum(e - s for s, e in x) for x in spans], [sorted(x) for _, x in hits], spans]
    return [pa.array(v, k) for v, k in zip(values, kinds)]


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit (words inside a hit), item_ids (sorted as strings, those with a hit window)
    and hit_spans ([first word, end) of hits that touch or overlap)."""
    kept = [c for c in docs.columns if c not in RESULT.names]
    docs, benchmark = docs.select(*kept), benchmark.select("item_id", "text")
    held = benchmark.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(32))).first()[0] or 0
    if held > BROADCAST_BYTES:
        return _annotate_joined(docs, benchmark, window, gram, text)
    rows = benchmark.collect()  # BROADCAST_BYTES at most
    shared = docs.sparkSession.sparkContext.broadcast(Table([r[0] for r in rows], [r[1] for r in rows], window, gram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for rows, data, offsets in K.slices(batch, text):
                words = Words(data, offsets)
                found: list[tuple[list, set]] = [([], set()) for _ in range(rows.num_rows)]
                for s, e, items in table.hits(words):
                    d = int(np.searchsorted(words.first, s, "right")) - 1
                    found[d][0].append((s - int(words.first[d]), e - int(words.first[d])))
                    found[d][1].update(items)
                cols = [rows.column(rows.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*cols, *_result(words, found)], names=[*kept, *RESULT.names])

    return docs.mapInArrow(K.give_back(run), T.StructType([*docs.schema.fields, *RESULT.fields]))


def _annotate_joined(docs: DataFrame, benchmark: DataFrame, window: int, gram: int, text: str) -> DataFrame:
    """``annotate`` by joins, for a benchmark of any size."""
    kept = docs.columns

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in K.slices(batch, "text"):
                words = Words(data, offsets)
                ids = rows.column(0).cast(pa.string()).fill_null("null")
                for size, fingerprints, starts, h in item_windows(words, window, gram):
                    own = pa.array(np.searchsorted(words.first, starts, "right") - 1)
                    for kind, hashes, names in ((0, fingerprints, pa.nulls(len(fingerprints), pa.string())), (size, h, ids.take(own))):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), size, np.int32)), pa.array(np.full(len(hashes), kind > 0)), pa.array(hashes.view(np.int64)), names], names=["size", "whole", "h", "item"])

    bench = materialize(benchmark.mapInArrow(items, "size int, whole boolean, h long, item string").distinct(), "benchmark")
    forms = shapes((r[0] for r in bench.select("size").distinct().collect()), window, gram)  # window at most
    numbered = docs.withColumn(ROW, F.monotonically_increasing_id())

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in K.slices(batch, text):
                words, row = Words(data, offsets), rows.column(rows.schema.get_field_index(ROW))
                for size, k, w in forms:
                    at, h = words.fingerprints(k, w)
                    own = np.searchsorted(words.first, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([row.take(pa.array(own)), pa.array(np.full(len(at), size, np.int32)), pa.array(at - words.first[own]), pa.array(h.view(np.int64))], names=[ROW, "size", "place", "h"])

    keys = bench.where("not whole").select("size", "h")
    places = numbered.select(ROW, text).mapInArrow(prints, f"{ROW} long, size int, place long, h long").join(keys, ["size", "h"], "left_semi")
    places = places.groupBy(ROW).agg(F.collect_set(F.struct("size", "place")).alias("places"))  # a text's own

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in K.slices(batch, text):
                words, row = Words(data, offsets), rows.column(rows.schema.get_field_index(ROW))
                joined: dict[int, list[int]] = {}
                for i, found in enumerate(rows.column(rows.schema.get_field_index("places")).to_pylist()):
                    for x in found:
                        joined.setdefault(x["size"], []).append(int(words.first[i]) + x["place"])
                for size, k, w in forms:
                    starts = words.joined(np.array(joined.get(size, []), np.int64), k, w)
                    own = np.searchsorted(words.first, starts, "right") - 1
                    yield pa.RecordBatch.from_arrays([row.take(pa.array(own)), pa.array(np.full(len(starts), size, np.int32)), pa.array(starts - words.first[own]), pa.array(words.grams(size)[starts].view(np.int64))], names=[ROW, "size", "start", "h"])

    near = numbered.select(ROW, text).join(places, ROW).mapInArrow(windows, f"{ROW} long, size int, start long, h long")
    hits = near.join(bench.where("whole").select("size", "h", "item"), ["size", "h"])
    hits = hits.groupBy(ROW).agg(F.collect_set(F.array("start", F.col("start") + F.col("size"))).alias("__spans"), F.collect_set("item").alias("__items"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in K.slices(batch, text):
                spans, names = (rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("__spans", "__items"))
                cols = [rows.column(rows.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*cols, *_result(Words(data, offsets), [(x or [], set(y or [])) for x, y in zip(spans, names)])], names=[*kept, *RESULT.names])

    return numbered.join(hits, ROW, "left").drop(ROW).mapInArrow(finish, T.StructType([*docs.schema.fields, *RESULT.fields]))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns of ``annotate``."""
    return annotate(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows without a hit, with the columns they had (those with the names of results too)."""
    own = {c: f"__own_{c}" for c in docs.columns if c in RESULT.names}
    kept = annotate(docs.withColumnsRenamed(own), benchmark).where("n_hit = 0").drop(*RESULT.names)
    return kept.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def brute_force(texts: list[str | None], items: list[tuple[object, str | None]], window: int = WINDOW) -> list[dict]:
    """What ``digest`` returns, by comparing every window with every place (for small fixtures)."""
    import re

    def words(x: str | None) -> list[str]:
        x = re.sub("[A-Z]", lambda m: m[0].lower(), x or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x)

    out = []
    for text in texts:
        doc, hit, ids = words(text), set(), set()
        for item_id, item in items:
            q = words(item)
            size = min(window, len(q))
            grams = {tuple(q[i : i + size]) for i in range(len(q) - size + 1)} if size else set()
            for i in range(len(doc) - size + 1) if size else ():
                if tuple(doc[i : i + size]) in grams:
                    hit.update(range(i, i + size))
                    ids.add("null" if item_id is None else str(item_id))
        out.append({"n_words": len(doc), "n_hit": len(hit), "n_items": len(ids), "items_sha256": hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()})
    return out
