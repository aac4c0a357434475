"""Token-id files: each document's ids compressed on their own with one shared zstandard dictionary.

A store is a folder in the shared file system with ``dictionary`` (trained on the serialized ids of a bounded
sample: at most SAMPLE_DOCS documents by least hash of their row; a text above SAMPLE_CHARS characters gives windows
of as many in all, spread over it) and shards in ascending order of doc_id, of some SHARD_BYTES each. A shard is::

    magic, SHA-256 of the dictionary, bytes per id | compressed documents | index | footer

The index has, for each document, doc_id, whether it is null, the token and the byte at which it starts in the
shard and its number of tokens; the footer the index's place, the number of documents and of tokens. ``shards.json``
has the least and greatest doc_id of each shard, so that one document is read by the index of its shard and one short
read. Shards are written under a name of the attempt and renamed, so that a task that is run again leaves one whole
file. The ids of a text are those of its pieces (words and runs of other signs, as the vocabulary file declares), each
distinct piece being encoded by the library once.

Defined cases: a null or empty text is the end id alone; texts may be as long as a batch can hold; a null doc_id
sorts first; rows of one doc_id, nulls too, stand in order of a hash of their bytes and may fill several shards;
repeated rows are stored each; an empty table gives a store without shards; columns beside doc_id and text are not stored.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .pieces import Vocabulary, byte_letters, default_vocabulary, pieces_of, split_text, vocabulary
from .storage import discard, least_hashes, materialize, parts, shared_dir

END_ID = 1
MAGIC = b"QMTOKEN1"
SAMPLE_DOCS = 512
SAMPLE_CHARS = 8192
SAMPLE_WINDOWS = 4
SHARD_BYTES = 128 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
READ_BYTES = 8 << 20
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("token", "<i8"), ("byte", "<i8"), ("tokens", "<i8")])
FOOTER = np.dtype([("index", "<i8"), ("docs", "<i8"), ("tokens", "<i8")])


def _maker_for(path: str):
    """Encodes pieces with the model of the tokenizers library; they are normalised and cut already."""

    def make(vocab: Vocabulary):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenize = Tokenizer.from_file(path).model.tokenize
        letters = dict(enumerate(byte_letters()))
        return lambda pieces: [[t.id for t in tokenize(p.decode("latin-1").translate(letters))] for p in pieces]

    return make


class _Flat:
    """The ids of a cache's pieces one after another; piece 0 is the end id."""

    def __init__(self) -> None:
        self.of: object = None

    def encode(self, cache, data: np.ndarray, offsets: np.ndarray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, an end after each, and each text's first (len + 1)."""
        numbers, first = cache.split(data, offsets)
        if self.of is not cache.values:
            self.of, self.ids, self.sizes = cache.values, np.array([END_ID], dtype), np.ones(1, np.int64)
        new = cache.values[len(self.sizes) - 1 :]
        if new:
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in new for i in x), dtype, int(sizes.sum()))])
            self.sizes = np.concatenate([self.sizes, sizes])
        starts = np.cumsum(self.sizes) - self.sizes
        order = np.insert(numbers + 1, first[1:], 0)
        sizes = self.sizes[order]
        return self.ids[K.ragged(starts[order], sizes)], np.concatenate([[0], np.cumsum(sizes)])[first + np.arange(len(first))]


def train_dictionary(docs: DataFrame, path: str, dtype: str) -> bytes:
    """From the stated sample; empty where it is too small to train on."""
    make = _maker_for(path)(vocabulary(path))
    few = least_hashes(docs, ["doc_id", "text"], SAMPLE_DOCS).select(F.coalesce("text", F.lit("")).alias("text"))
    each, size = SAMPLE_CHARS // SAMPLE_WINDOWS, F.length("text")
    windows = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda i: F.substring(F.col("text"), ((size - each) * i / (SAMPLE_WINDOWS - 1)).cast("int") + 1, F.lit(each)))
    rows = few.select(F.explode(F.when(size > SAMPLE_CHARS, windows).otherwise(F.array("text"))).alias("text")).collect()
    vocab = vocabulary(path)
    samples = []
    for row in rows:
        pieces = split_text(row[0], vocab)
        made = iter(make([p for p in pieces if not isinstance(p, int)]))
        ids = [i for p in pieces for i in ([p] if isinstance(p, int) else next(made))] + [END_ID]
        samples.append(np.array(ids, dtype).tobytes())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_store(docs: DataFrame, uri: str, path: str | None = None, shards: int | None = None) -> list[dict]:
    """Write ``doc_id, text`` of docs as a store; returns its shards in order: path, docs, tokens."""
    spark = docs.sparkSession
    path = path or default_vocabulary()
    vocab = vocabulary(path)
    dtype = "<u2" if max(vocab.tokens) < 1 << 16 else "<u4"
    docs = docs.select("doc_id", "text")
    raw = train_dictionary(docs, path, dtype)
    mark = hashlib.sha256(raw).digest()
    fs, base = _open(uri)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/dictionary") as f:
        f.write(raw)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = pieces_of(path, "library", _maker_for(path))
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw)) if raw else zstandard.ZstdCompressor(level=LEVEL)
        flat = _Flat()
        for batch in batches:
            for rows, data, offsets in K.slices(batch, "text"):
                ids, cuts = flat.encode(cache, data, offsets, dtype)
                raw_ids, width = ids.tobytes(), ids.dtype.itemsize
                bounds = (cuts * width).tolist()
                payload = [pack.compress(raw_ids[a:b]) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(payload, pa.binary())], names=["doc_id", "n", "payload"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        store, folder = _open(uri)
        name, draft = f"{folder}/shard-{number:06d}", f"{folder}/_draft-{number:06d}-{uuid.uuid4().hex}"
        index, at, token, out = [], len(MAGIC) + 33, 0, None
        for batch in batches:
            if batch.num_rows and out is None:
                out = store.open_output_stream(draft)
                out.write(MAGIC + mark + bytes([np.dtype(dtype).itemsize]))
            part = np.zeros(batch.num_rows, INDEX)
            for i, (doc, n, blob) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                part[i] = (doc or 0, doc is None, token, at, n)
                out.write(blob)
                at += len(blob)
                token += n
            index.append(part)
        if out is None:
            return
        rows = np.concatenate(index)
        out.write(rows.tobytes() + np.array([(at, len(rows), token)], FOOTER).tobytes())
        out.close()
        store.move(draft, name)
        named = rows["doc_id"][rows["null"] == 0]
        ends = [named.min(), named.max()] if len(named) else [None, None]
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([token], pa.int64()), *(pa.array([x], pa.int64()) for x in ends)], names=["shard", "docs", "tokens", "least", "most"])

    encoded = materialize(docs.mapInArrow(K.give_back(encode), "doc_id long, n long, payload binary"), "token-rows")
    size = encoded.agg(F.coalesce(F.sum(F.length("payload").cast("long") + INDEX.itemsize), F.lit(0))).first()[0]
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("payload").asc()]  # rows of one id can be dealt to several shards
    ordered = encoded.repartitionByRange(shards or max(parts(spark), size // SHARD_BYTES + 1), *order).sortWithinPartitions(*order)
    made = sorted(ordered.mapInArrow(write, "shard int, docs long, tokens long, least long, most long").collect(), key=lambda r: r.shard)  # one row a shard
    listed = [{"path": f"shard-{r.shard:06d}", "docs": r.docs, "tokens": r.tokens, "least": r.least, "most": r.most} for r in made]
    discard(encoded)
    with fs.open_output_stream(f"{base}/shards.json") as f:
        f.write(json.dumps({"dictionary_sha256": mark.hex(), "vocabulary": os.path.basename(path), "shards": listed}).encode())
    return listed


def _index(f, name: str) -> tuple[np.ndarray, int]:
    size = f.size()
    f.seek(size - FOOTER.itemsize)
    foot = np.frombuffer(f.read(FOOTER.itemsize), FOOTER)[0]
    f.seek(int(foot["index"]))
    return np.frombuffer(f.read(int(foot["docs"]) * INDEX.itemsize), INDEX), int(foot["index"])


def _head(f, raw: bytes, name: str) -> str:
    f.seek(0)
    head = f.read(len(MAGIC) + 33)
    if head[: len(MAGIC)] != MAGIC or head[len(MAGIC) : -1] != hashlib.sha256(raw).digest():
        raise ValueError(f"{name}: not a shard of this store's dictionary")
    return f"<u{head[-1]}"


def read_store(spark: SparkSession, uri: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, with ``ids``, the ids."""
    fs, base = _open(uri)
    with fs.open_input_stream(f"{base}/shards.json") as f:
        listed = json.loads(f.read())["shards"]
    first = np.concatenate([[0], np.cumsum([s["tokens"] for s in listed])]).tolist()
    todo = [(s["path"], a) for s, a in zip(listed, first)]
    types = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open(uri)
        with store.open_input_stream(f"{folder}/dictionary") as f:
            raw = f.read()
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)) if raw else zstandard.ZstdDecompressor()
        for batch in batches:
            for k in batch.column(0).to_pylist():
                name, before = todo[k]
                with store.open_input_file(f"{folder}/{name}") as f:
                    dtype = _head(f, raw, name)
                    index, end = _index(f, name)
                    edges = np.append(index["byte"], end)
                    a = 0
                    while a < len(index):
                        b = min(len(index), max(a + 1, int(np.searchsorted(edges, edges[a] + READ_BYTES, "right")) - 1))
                        f.seek(int(edges[a]))
                        block = f.read(int(edges[b] - edges[a]))
                        cuts = (edges[a : b + 1] - edges[a]).tolist()
                        texts = [np.frombuffer(unpack.decompress(block[x:y]), dtype).astype("<u4") for x, y in zip(cuts, cuts[1:])]
                        own = index[a:b]
                        cols = [pa.array(own["doc_id"].copy(), pa.int64(), mask=own["null"] == 1), pa.array(own["token"] + before), pa.array([len(t) for t in texts], pa.int64()), pa.array([zlib.crc32(t.tobytes()) for t in texts], pa.int64())]
                        cols += [pa.array([t.astype(np.int32) for t in texts], pa.list_(pa.int32()))] * ids
                        yield pa.RecordBatch.from_arrays(cols, names=[n for n, _ in types])
                        a = b

    n = len(todo)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    return spark.range(0, n, 1, max(1, n)).mapInArrow(read, schema)


def fetch(uri: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document (of the first, where several have its id), reading its shard's index and its own bytes only."""
    fs, base = _open(uri)
    with fs.open_input_stream(f"{base}/dictionary") as f:
        raw = f.read()
    with fs.open_input_stream(f"{base}/shards.json") as f:
        listed = json.loads(f.read())["shards"]
    unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)) if raw else zstandard.ZstdDecompressor()
    for s in listed:
        if s["least"] is None or not s["least"] <= doc_id <= s["most"]:
            continue
        with fs.open_input_file(f"{base}/{s['path']}") as f:
            dtype = _head(f, raw, s["path"])
            index, end = _index(f, s["path"])
            own = index["doc_id"][index["null"] == 0]
            skip = len(index) - len(own)
            i = int(np.searchsorted(own, doc_id))
            if i < len(own) and own[i] == doc_id:
                edges = np.append(index["byte"], end)
                f.seek(int(edges[skip + i]))
                return np.frombuffer(unpack.decompress(f.read(int(edges[skip + i + 1] - edges[skip + i]))), dtype).astype(np.uint32)
    return None


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes a store in the shared folder and returns the contract's columns as read back from its files."""
    spark = docs.sparkSession
    uri = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    write_store(docs, uri, path)
    return read_store(spark, uri, ids=False)
