"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree are the merge ranks of neighbouring symbols; each inner node holds the least rank below
it. The root names the lowest rank, and going down to the left child where it is as low gives its leftmost
place. A merge changes three leaves, each brought up in O(log n); a piece of n symbols takes O(n log n) however
long it is. Encoding is done once for each distinct piece that a worker meets.

Decoding goes from the ids of a text to its tokens, joined as the file declares.

Defined cases: an empty table gives no rows; a null or empty text has no tokens and decodes to the empty text; texts
may be as long as a batch can hold; of equal ranks the leftmost merges first; repeated rows are encoded alike; extra columns pass through, those with the names of the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as K
from .pieces import Vocabulary, default_vocabulary, pieces_of, split_text, vocabulary

NO_RANK = 1 << 30


def merge(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """The symbols after all merges, always the leftmost of the lowest rank first."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length()
    tree = [NO_RANK] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(symbols[i] << 20 | symbols[i + 1], NO_RANK)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    if tree[1] == NO_RANK:
        return symbols
    sym = list(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(leaf: int, rank: int) -> None:
        i = size + leaf
        tree[i] = rank
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a <= b else b
            if tree[i] == least:
                break
            tree[i] = least
            i >>= 1

    while (rank := tree[1]) < NO_RANK:
        i = 1
        while i < size:
            i *= 2
            if tree[i] != rank:
                i += 1
        i -= size
        j = after[i]
        sym[i] = merged[rank]
        k = after[i] = after[j]
        sym[j] = -1
        if j < n - 1:
            put(j, NO_RANK)
        if k < n:
            before[k] = i
            put(i, get(sym[i] << 20 | sym[k], NO_RANK))
        else:
            put(i, NO_RANK)
        if (h := before[i]) >= 0:
            put(h, get(sym[h] << 20 | sym[i], NO_RANK))
    return [x for x in sym if x >= 0]


def encode_piece(piece: bytes, vocab: Vocabulary) -> list[int]:
    inner = vocab.inner
    return merge([inner[b] for b in piece[:-1]] + [vocab.final[piece[-1]]], vocab.ranks, vocab.merged)


def encode(text: str | None, path: str | None = None) -> list[int]:
    """Token ids of one text."""
    vocab = vocabulary(path or default_vocabulary())
    return [i for x in split_text(text or "", vocab) for i in ([x] if isinstance(x, int) else encode_piece(x, vocab))]


def decode(ids: list[int], path: str | None = None) -> str:
    """The tokens of ids, joined as the file declares (it names no decoder: one space between tokens)."""
    return _decoded(ids, vocabulary(path or default_vocabulary()).tokens)


def _decoded(ids: list[int], tokens: dict[int, str]) -> str:
    return " ".join([tokens[i] for i in ids if i in tokens])


def _maker(vocab: Vocabulary):
    return lambda pieces: [encode_piece(p, vocab) for p in pieces]


class _Strings:
    """For each numbered piece: how many tokens, and its ids as text."""

    def __init__(self) -> None:
        self.of: object = None
        self.clear()

    def clear(self) -> None:
        self.counts: list[int] = []
        self.ids: list[bytes] = []

    def follow(self, cache) -> None:
        if self.of is not cache.values:
            self.of = cache.values
            self.clear()
        for ids in cache.values[len(self.counts) :]:
            self.counts.append(len(ids))
            self.ids.append(" ".join(map(str, ids)).encode())


def tokenize(docs: DataFrame, path: str | None = None, text: str = "text", ids: bool = True, decoded: bool = False, digests: bool = False) -> DataFrame:
    """``docs`` with n_tokens and, as asked, ids (array<int>), decoded (string), ids_sha256 and decoded_sha256."""
    path = path or default_vocabulary()
    fields = [("n_tokens", T.LongType(), pa.int64())]
    fields += [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))] * ids
    fields += [("decoded", T.StringType(), pa.string())] * decoded
    fields += [("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())] * digests
    names = {f[0] for f in fields}
    kept = [c for c in docs.columns if c not in names]
    schema = T.StructType([*docs.select(*kept).schema.fields, *(T.StructField(n, t) for n, t, _ in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = pieces_of(path, "bpe", _maker)
        strings = _Strings()
        for batch in batches:
            for rows, data, offsets in K.slices(batch, text):
                numbers, first = cache.split(data, offsets)
                strings.follow(cache)
                counts = np.array(strings.counts, np.int64)
                each = counts[numbers] if len(numbers) else np.zeros(0, np.int64)
                per_row = K.row_sums(each, first)
                made = {"n_tokens": pa.array(per_row)}
                if ids:
                    flat = np.fromiter((i for x in numbers.tolist() for i in cache.values[x]), np.int32, int(each.sum()))
                    made["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)), pa.array(flat))
                if decoded or digests:
                    order, bounds = numbers.tolist(), first.tolist()
                    spans = [order[a:b] for a, b in zip(bounds, bounds[1:])]
                    values, tokens = cache.values, cache.vocab.tokens
                    texts = [_decoded([i for piece in x for i in values[piece]], tokens) for x in spans]
                    if decoded:
                        made["decoded"] = pa.array(texts, pa.string())
                    if digests:
                        digits = strings.ids
                        made["ids_sha256"] = pa.array([hashlib.sha256(b" ".join([digits[i] for i in x])).hexdigest() for x in spans])
                        made["decoded_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts])
                cols = [rows.column(rows.schema.get_field_index(c)) for c in kept] + [made[f[0]] for f in fields]
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, *(f[0] for f in fields)])

    return docs.select(*kept).mapInArrow(K.give_back(run), schema)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns."""
    return tokenize(docs.select("doc_id", "text"), path, ids=False, digests=True).drop("text")
