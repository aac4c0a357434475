"""Token counts: greedy longest-match word pieces in linear time, without building the pieces.

A trie of the vocabulary gets, for each node, a failure link and the number of pieces that are popped when the
link is taken: what greedy matching would have emitted for the string of the node before matching goes on at the
link's target. One pass over the bytes of a word then counts its pieces, whatever the overlaps in the
vocabulary. The vocabulary is the token set of the file without word-end marks; it holds every byte, so that
every word has pieces.

Defined cases: an empty table gives no rows; a null or empty text has 0 words and 0 tokens; texts may be as long as
a batch can hold; where several pieces match the longest is taken, so that nothing ties; repeated rows count alike;
extra columns pass through, those with the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as K
from .pieces import Vocabulary, default_vocabulary, pieces_of


class Automaton:
    """child[node << 8 | byte], link[node], popped[node]; node 0 is the root."""

    def __init__(self, words: list[bytes]):
        self.child: dict[int, int] = {}
        final = [False]
        depth_order: list[tuple[int, int, int]] = []
        child = self.child
        for w in words:
            node = 0
            for b in w:
                key = node << 8 | b
                if key not in child:
                    child[key] = len(final)
                    final.append(False)
                    depth_order.append((node, b, child[key]))
                node = child[key]
            final[node] = True
        self.link = [0] * len(final)
        self.popped = [0] * len(final)
        level: list[tuple[int, int, int]] = []
        below: dict[int, list[tuple[int, int, int]]] = {}
        for edge in depth_order:
            below.setdefault(edge[0], []).append(edge)
        level = below.get(0, [])
        while level:
            deeper: list[tuple[int, int, int]] = []
            for parent, b, node in level:
                if final[node]:
                    self.popped[node] = 1
                else:
                    count, z = self.popped[parent], self.link[parent]
                    while (z << 8 | b) not in child:
                        if z == 0:
                            raise ValueError(f"no word of one byte {b}")
                        count, z = count + self.popped[z], self.link[z]
                    self.popped[node], self.link[node] = count, child[z << 8 | b]
                deeper.extend(below.get(node, []))
            level = deeper

    def count(self, word: bytes) -> int:
        child, link, popped = self.child, self.link, self.popped
        node = total = 0
        for b in word:
            while (to := child.get(node << 8 | b)) is None:
                if node == 0:
                    raise ValueError(f"no word of one byte {b}")
                total += popped[node]
                node = link[node]
            node = to
        while node:
            total += popped[node]
            node = link[node]
        return total


def word_list(vocab: Vocabulary) -> list[bytes]:
    """The vocabulary's strings as bytes, without word-end marks."""
    out = set()
    for token in vocab.ids:
        token = token.removesuffix(vocab.suffix)
        if token:
            out.add(bytes(vocab.bytes_of[c] for c in token))
    return sorted(out)


def _maker(vocab: Vocabulary):
    automaton = Automaton(word_list(vocab))
    return lambda pieces: [automaton.count(p) for p in pieces]


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with n_words (pieces of the split) and n_tokens (greedy word pieces); a special token is one of each."""
    path = path or default_vocabulary()
    kept = [c for c in docs.columns if c not in ("n_words", "n_tokens")]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = pieces_of(path, "count", _maker)
        for batch in batches:
            for rows, data, offsets in K.slices(batch, text):
                numbers, first = cache.split(data, offsets)
                counts = np.array([1 if isinstance(v, list) else v for v in cache.values], np.int64)
                each = counts[numbers] if len(numbers) else np.zeros(0, np.int64)
                cols = [rows.column(rows.schema.get_field_index(c)) for c in kept]
                cols += [pa.array(first[1:] - first[:-1], pa.int64()), pa.array(K.row_sums(each, first), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, "n_words", "n_tokens"])

    return docs.select(*kept).mapInArrow(run, schema)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    return count_tokens(docs.select("doc_id", "text"), path).drop("text")
