"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

1. Each task hashes every window of its texts by rolling prefix sums (64 bits), sorts the hashes of a group of
   texts, keeps one entry per distinct hash (the others repeat it within the group and are known to be removed),
   and cuts the sorted entries by hash range. A cut is one compressed row: hash deltas, word places and the texts'
   row numbers. So the shuffle carries some 8 bytes a window, and a window that millions of texts share sends one
   entry per group, not one per text. The number of ranges follows the bytes of text, so that one fits in a task.
2. Each hash range counts: a hash of two entries or more is repeated, and its places go back, packed by blocks of
   rows. A block has the more rows the shorter the texts are, and is put together from a sorted stream.
3. Each text merges the windows that start at its places into maximal intervals and drops the words in them.

Row numbers are those of the scan, so the input has to be a table (files); pass ``stable=False`` for anything
else and it is written to the shared folder first.

Defined cases: an empty table gives no rows; a null or empty text has no words and keeps none; a text shorter than
the window loses nothing; texts may be as long as a batch can hold; of equal windows all are removed, first ones too;
repeated rows (copies) repeat each other's windows, so both lose them; words are compared as 64-bit hashes of
35 words; extra columns pass through, those with the names of the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .packing import pack, unpack
from .storage import materialize, parts

WINDOW = 35
GROUP_BYTES = 24 << 20
#: Text whose windows meet in one range: some 16 MB of entries.
RANGE_BYTES = 16 << 20
#: Rows whose repeated places travel together: 2**BLOCK_BITS consecutive ones of a partition at most, and fewer where
#: that many of the mean length are above BLOCK_BYTES.
BLOCK_BITS = 10
BLOCK_BYTES = 4 << 20
ROW = "__row"


def _by_block(bits: int, rows: np.ndarray, first: np.ndarray, places: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Sorted word places of a group, one packed value (rows in the block, places each, positions) for each block of rows."""
    text = np.searchsorted(first, places, "right") - 1
    cut = np.flatnonzero(np.diff(text, prepend=-1))
    position = (places - first[text]).astype(np.uint32)
    counts, own = np.diff(np.append(cut, len(places))).astype(np.uint32), rows[text[cut]]
    block = own >> bits
    edges = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block)).tolist()
    ends = np.append(cut, len(places)).tolist()
    return block[edges[:-1]].tolist(), [pack((own[a:b] & ((1 << bits) - 1)).astype(np.uint16), counts[a:b], position[ends[a] : ends[b]]) for a, b in zip(edges, edges[1:])]


def _split(bits: int):
    """(block, packed values) in order of blocks to one row of word places (uint32) for each text that has some."""

    def rows_of(block: int, blobs: list[bytes]) -> pa.RecordBatch:
        parts_ = [unpack(x, [np.uint16, np.uint32, np.uint32]) for x in blobs]
        row = np.concatenate([np.repeat(r, c) for r, c, _ in parts_])
        place = np.concatenate([p for _, _, p in parts_])
        order = np.argsort(row, kind="stable")
        row, place = row[order], place[order]
        cut = np.flatnonzero(np.diff(row.astype(np.int64), prepend=-1))
        ends = np.append(cut, len(row)).tolist()
        return pa.RecordBatch.from_arrays([pa.array((block << bits) + row[cut].astype(np.int64)), pa.array([place[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], names=[ROW, "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            for now, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and now != block:
                    yield rows_of(block, held)
                    held = []
                block = now
                held.append(blob)
        if held:
            yield rows_of(block, held)

    return run


def _windows(window: int, n_parts: int, text: str):
    schema = pa.schema([("part", pa.int32()), ("known", pa.bool_()), ("blob", pa.binary())])
    edges = np.array([-(-(p << 32) // n_parts) << 32 for p in range(n_parts)], np.uint64)  # the least hash of each range

    def group(held: list) -> Iterator[pa.RecordBatch]:
        rows, first, h, at = map(np.concatenate, zip(*held))
        held.clear()
        if not len(h):
            return
        K.trim()  # the sort needs no tables of powers
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        del order
        same = h[1:] == h[:-1]
        new = np.append(True, ~same)
        again = np.append(False, same) | np.append(same, False)
        parts_, known, blobs = [], [], []
        if again.any():
            places = np.sort(at[again])
            parts_.append(int(rows[0] % n_parts))
            known.append(True)
            blobs.append(pack(places, rows, first.astype(np.int64)))
        h, at, again = h[new], at[new], again[new]
        del same, new
        cuts = [*np.searchsorted(h, edges).tolist(), len(h)]
        for p in range(n_parts):
            a, b = cuts[p], cuts[p + 1]
            if a == b:
                continue
            t = np.unique(np.searchsorted(first, at[a:b], "right") - 1)  # only texts with a place in this range
            parts_.append(p)
            known.append(False)
            blobs.append(pack(np.diff(h[a:b], prepend=np.uint64(0)), at[a:b], again[a:b].view(np.uint8), np.diff(rows[t], prepend=0), np.diff(first[t], prepend=0)))
            if sum(map(len, blobs)) > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(parts_, pa.int32()), pa.array(known), pa.array(blobs, pa.binary())], schema=schema)
                parts_, known, blobs = [], [], []
        if parts_:
            yield pa.RecordBatch.from_arrays([pa.array(parts_, pa.int32()), pa.array(known), pa.array(blobs, pa.binary())], schema=schema)

    def windows(rows: np.ndarray, data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[tuple[np.ndarray, ...], int]:
        """(rows and first words of texts with windows, hashes and places of these), and the words so far: those of the
        group before this slice are ``words``."""
        starts, ends, first = K.spans(K.NOT_SPACE[data], offsets)
        own = K.window_hashes(K.span_hashes(data, starts, ends), window)
        used = np.flatnonzero(np.diff(first) >= window)
        at = K.ragged(first[used], np.diff(first)[used] - window + 1)
        return (rows[used], first[used] + words, own[at], (at + words).astype(np.uint32)), words + len(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, words = [], 0, 0
        for batch in batches:
            for rows, data, offsets in K.slices(batch, text):
                found, words = windows(rows.column(rows.schema.get_field_index(ROW)).to_numpy(), data, offsets, words)
                held.append(found)
                size += len(data)
                if size >= GROUP_BYTES:
                    yield from group(held)
                    held, size, words = [], 0, 0
        if held:
            yield from group(held)

    return run


def _count(table: pa.Table, bits: int) -> pa.Table:
    """The places of repeated windows of one hash range, by block of rows."""
    blocks, blobs = [], []

    def emit(*places_of: np.ndarray) -> None:
        at_blocks, packed = _by_block(bits, *places_of)
        blocks.extend(at_blocks)
        blobs.extend(packed)

    hashes, owners, places, flags, texts = [], [], [], [], []
    for known, blob in zip(table["known"].to_pylist(), table["blob"]):
        if known:
            at, rows, first = unpack(blob.as_buffer(), [np.uint32, np.int64, np.int64])
            emit(rows, first, at.astype(np.int64))
            continue
        h, at, flag, rows, first = unpack(blob.as_buffer(), [np.uint64, np.uint32, np.uint8, np.int64, np.int64])
        with np.errstate(over="ignore"):
            hashes.append(np.cumsum(h, dtype=np.uint64))
        owners.append(np.full(len(h), len(texts), np.int32))
        places.append(at)
        flags.append(flag)
        texts.append((np.cumsum(rows), np.cumsum(first)))
    if hashes:
        h, owner, at, flag = map(np.concatenate, (hashes, owners, places, flags))
        del hashes, owners, places, flags
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        again = np.append(False, same) | np.append(same, False)
        hit = order[again]
        hit = hit[flag[hit] == 0]  # the others are in the known lists
        hit = hit[np.lexsort((at[hit], owner[hit]))]
        cuts = np.searchsorted(owner[hit], np.arange(len(texts) + 1))
        for i, (rows, first) in enumerate(texts):
            if cuts[i] < cuts[i + 1]:
                emit(rows, first, at[hit[cuts[i] : cuts[i + 1]]].astype(np.int64))
    return pa.table({"block": pa.array(blocks, pa.int64()), "blob": pa.array(blobs, pa.binary())})


def annotate(docs: DataFrame, window: int = WINDOW, text: str = "text", stable: bool = True, kept_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_removed, removed_spans ([first word, end) of maximal intervals), kept_sha256 and,
    with ``kept_text``, kept_text (the words that stay, joined by one space)."""
    names = ["n_words", "n_removed", "removed_spans", "kept_sha256"] + ["kept_text"] * kept_text
    kept = [c for c in docs.columns if c not in names]
    source = docs.select(*kept)
    if not stable:
        source = materialize(source, "substring-dedup")
    source = source.withColumn(ROW, F.monotonically_increasing_id())
    size, n_rows = docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0)), F.count("*")).first()
    n_parts = max(8 * parts(docs.sparkSession), size // RANGE_BYTES + 1)
    bits = min(BLOCK_BITS, max(0, int(BLOCK_BYTES * n_rows // (size + 1)).bit_length() - 1))
    entries = source.select(ROW, text).mapInArrow(K.give_back(_windows(window, n_parts, text)), "part int, known boolean, blob binary")
    places = entries.groupBy("part").applyInArrow(lambda table: _count(table, bits), "block long, blob binary")
    found = places.repartition("block").sortWithinPartitions("block").mapInArrow(_split(bits), f"{ROW} long, places binary")
    joined = source.join(found, ROW, "left").drop(ROW)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept_text", T.StringType())] * kept_text
    schema = T.StructType([*source.drop(ROW).schema.fields, *fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in K.slices(batch, text):
                starts, ends, first = K.spans(K.NOT_SPACE[data], offsets)
                n = len(starts)
                change = np.zeros(n + 1, np.int64)
                for i, found_here in enumerate(rows.column(rows.schema.get_field_index("places")).to_pylist()):
                    if found_here:
                        p = np.frombuffer(found_here, np.uint32).astype(np.int64) + first[i]
                        np.add.at(change, p, 1)
                        np.add.at(change, p + window, -1)
                gone = np.cumsum(change)[:n] > 0
                removed = K.row_sums(gone, first)
                spans = [[] for _ in range(len(first) - 1)]
                for i in np.flatnonzero(removed).tolist():
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[first[i] : first[i + 1]], [False]]).astype(np.int8)))
                    spans[i] = edge.reshape(-1, 2).tolist()
                stay = ~gone
                s, size = starts[stay], (ends - starts)[stay] + 1
                out = np.append(data, np.uint8(32))[K.ragged(s, size)]
                stop = np.concatenate([[0], np.cumsum(size)])
                out[stop[1:] - 1] = 32
                left = np.concatenate([[0], np.cumsum(stay)])[first]
                bounds = stop[left].tolist()
                raw = out.tobytes()
                texts = [raw[a : max(a, b - 1)] for a, b in zip(bounds, bounds[1:])]
                cols = [rows.column(rows.schema.get_field_index(c)) for c in kept]
                cols += [pa.array(first[1:] - first[:-1], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
                if kept_text:
                    cols.append(pa.array([x.decode() for x in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, *names])

    return joined.mapInArrow(K.give_back(cut), schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return annotate(docs.select("doc_id", "text"), kept_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, kept_sha256) by counting windows in a dictionary (for small fixtures)."""
    import re
    from collections import Counter

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone: set[int] = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
