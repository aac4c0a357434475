"""Near-duplicate classes by order MinHash, verified by banded alignment.

A text's k-mers are runs of SHINGLE words, each labelled with how often it has occurred before, so that repeats
count. Each of SKETCHES hash functions picks the PICKS labelled k-mers of least hash and keeps them in text order;
texts are candidates where one such tuple agrees. Candidates are verified over their whole word sequences by an
alignment in a band of (1 - SIMILARITY) of the longer one; a link is an edit similarity of SIMILARITY or more.
Two texts whose words are the same but for a share e at scattered places have s = (1 - e)**SHINGLE of their k-mers
in common and agree in one tuple with a chance of about (s / (2 - s))**PICKS: all SKETCHES tuples differ in 15% of
pairs at e = 0.20, in 3% at 0.16 and in less than 0.1% at 0.12 (measured in tests/llm).

Texts with the same words are one node from the start. Buckets (the texts of one tuple) are worked through in three
rounds:

1. In each bucket the centre of a text is the shortest one of about its length. Every text is held against CENTERS of
   its centres, those of its largest buckets; the components are taken.
2. A bucket whose texts are then still in different components is mixed. All its pairs in different components are
   compared if it has SMALL texts or fewer; of larger ones each text is held against one drawn for its largest.
3. In larger buckets that are mixed even then, all pairs in different components are compared: none is left out.
   Buckets of the same texts are one, and blocks of BLOCK texts meet each other with their texts, so that a bucket is
   many groups. A pair is aligned in one of the buckets that it shares, drawn by its hash.

Before texts are aligned their bags are compared: counts of words by BINS ranges of their hash. An edit changes two
counts by one at most, so pairs whose counts differ by more than twice the limit are no links. Round 3 then counts the
words and pairs of neighbouring words that two texts share, of which an edit takes one and two. It takes time in
proportion to the pairs of such a bucket, and a text goes once to each block of it; of the pairs only links become rows,
and of a group no more than join its components.

Classes are the components of all links, and a link can be lost only between texts that meet in no tuple.

Rows are numbered by the scan, so the input has to be a table (files); others are to be written first.

Defined cases: an empty table has no classes; texts without words (null, empty, white space) are classes of their
own; a text of fewer words than SHINGLE has one k-mer of all of them; a text may be as long as a batch can hold (the
alignment of n words takes n steps on numbers of 0.4 n bits); ids may be of any type that has an order; the class id
is the least doc_id of the class (null only if all are), and the row that stays is the first by doc_id (nulls last),
then by row number; repeated rows are copies; extra columns pass ``keep_one`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .storage import discard, materialize, materialize_parts

SHINGLE = 5
PICKS = 2
SKETCHES = 48
BINS = 128
SIMILARITY = 0.8
#: Bits of the filter by which most texts that meet no other stay out of the shuffle: for each that does, and at most.
FILTER_BITS, FILTER_MOST = 16, 1 << 27
#: The tuples of so many hash functions are brought together at a time: what one function made meets nothing of another.
TOGETHER = 16
#: Centres that a text is held against in the first round; pairs that this leaves open are those of later rounds.
CENTERS = 3
#: Buckets of so many texts or fewer are worked through pair by pair at once.
SMALL = 16
#: Texts of a block of a larger bucket, about, and their words.
BLOCK, BLOCK_WORDS = 1024, 1 << 19
#: Pairs of a centre for each copy of its text, and copies at most: the texts held against it are dealt to as many places.
EACH, SALTS = 64, 256
ROW = "__row"

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64)
_C = np.uint64(0x9FB21C651E98DF25)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def labelled_kmers(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' k-mers with their occurrence numbers, and each text's first (len + 1)."""
    n = first[1:] - first[:-1]
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(start[-1]), np.uint64)
    g = K.window_hashes(h, SHINGLE)
    long = n >= SHINGLE
    out[K.ragged(start[:-1][long], count[long])] = g[K.ragged(first[:-1][long], count[long])]
    for k in range(1, SHINGLE):
        at = np.flatnonzero(n == k)
        if len(at):
            out[start[at]] = K.window_hashes(h, k)[first[at]]
    text = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((out, text))
    same = np.append(False, (out[order[1:]] == out[order[:-1]]) & (text[order[1:]] == text[order[:-1]]))
    if same.any():
        place = np.arange(len(out))
        run = np.maximum.accumulate(np.where(same, 0, place))
        occurrence = np.zeros(len(out), np.uint64)
        occurrence[order] = (place - run).astype(np.uint64)
        with np.errstate(over="ignore"):
            out = K.mix(out + occurrence * _C)
    return out, start


def sketch(kmers: np.ndarray) -> np.ndarray:
    """One value per hash function: its least labelled k-mers in text order."""
    with np.errstate(over="ignore"):
        h = kmers[None, :] * _A[:, None] + _B[:, None]
        h ^= h >> np.uint64(32)
        picks = min(PICKS, len(kmers))
        every = np.arange(SKETCHES)
        at = np.empty((SKETCHES, picks), np.int64)
        for i in range(picks):
            at[:, i] = h.argmin(axis=1)
            h[every, at[:, i]] = _MOST
        at.sort(axis=1)
        v = np.arange(1, SKETCHES + 1, dtype=np.uint64) * _C
        for i in range(picks):
            v = K.mix(v * np.uint64(3) + kmers[at[:, i]])
        return v


def bag(h: np.ndarray) -> bytes:
    """How many words of a text fall into each of BINS ranges of their hash, 255 at most."""
    return np.minimum(np.bincount((K.mix(h ^ _C) >> np.uint64(32)) % np.uint64(BINS), minlength=BINS), 255).astype(np.uint8).tobytes()


def _content(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A 128-bit hash of each text's sequence of words."""
    import xxhash

    raw = h.tobytes()
    return [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def _lists(content: list[bytes], made: dict[bytes, np.ndarray], first_seen: list[bool]) -> pa.Array:
    """For the first row of each content its values, else null."""
    values = [made[c] if f else made[c][:0] for c, f in zip(content, first_seen)]
    sizes = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), pa.int64()))


def _signatures(text: str):
    """Tuples are written once for each content of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in K.slices(batch, text):
                starts, ends, first = K.spans(K.NOT_SPACE[data], offsets)
                h = K.span_hashes(data, starts, ends)
                kmers, at = labelled_kmers(h, first)
                content = _content(h, first)
                tuples: dict[bytes, np.ndarray] = {}
                first_seen = []
                for i, c in enumerate(content):
                    first_seen.append(c not in tuples)
                    if c not in tuples:
                        own = kmers[at[i] : at[i + 1]]
                        tuples[c] = (sketch(own) if len(own) else own).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(rows.schema.get_field_index(ROW)),
                        rows.column(rows.schema.get_field_index("doc_id")),
                        pa.array(content, pa.binary()),
                        pa.array(first[1:] - first[:-1], pa.int64()),
                        _lists(content, tuples, first_seen),
                    ],
                    names=[ROW, "doc_id", "content", "n_words", "sketch"],
                )

    return run


def _filter_chunk(table: pa.Table) -> pa.Table:
    """4096 bytes of the filter."""
    at = table["at"].to_numpy()
    bits = np.zeros(1 << 15, bool)
    bits[at & 0x7FFF] = True
    return pa.table({"chunk": pa.array([at[0] >> 15], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _filter(needed: DataFrame) -> np.ndarray:
    """Bits by the first four bytes of a content: where it is 0, no content of ``needed`` has them."""
    size = 1 << 15
    wanted = min(FILTER_MOST, FILTER_BITS * needed.count())
    while size < wanted:
        size *= 2
    at = F.conv(F.hex(F.substring("content", 1, 4)), 16, 10).cast("long").bitwiseAND(F.lit(size - 1))
    out = np.zeros((size >> 15, 4096), np.uint8)
    chunks = needed.select(at.alias("at")).groupBy(F.shiftright("at", 15)).applyInArrow(_filter_chunk, "chunk long, bits binary")
    for chunk, bits in chunks.collect():  # FILTER_MOST bits at most, in one job: an iterator takes one for each partition
        out[chunk] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def _let_through(may, content: list[bytes]) -> np.ndarray:
    at = np.frombuffer(b"".join(content), ">u4")[::4].astype(np.int64) & (8 * len(may.value) - 1)
    return ((may.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)


def _among(table: DataFrame, needed: DataFrame) -> DataFrame:
    """The rows of ``table`` (content first) whose contents are in ``needed``, and few others: they need not travel to be
    found."""
    may = table.sparkSession.sparkContext.broadcast(_filter(needed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_let_through(may, batch.column(0).to_pylist())))

    return table.mapInArrow(K.give_back(run), table.schema)


def _texts(text: str, may):
    """(content, text, bag) of texts with words that the broadcast filter ``may`` lets through, each content once for a
    slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in K.slices(batch, text):
                starts, ends, first = K.spans(K.NOT_SPACE[data], offsets)
                h = K.span_hashes(data, starts, ends)
                content = _content(h, first)
                needed = _let_through(may, content)
                seen = {c: i for i, c in enumerate(content) if needed[i] and first[i] < first[i + 1]}
                own = rows.column(rows.schema.get_field_index(text)).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(seen), pa.binary()), own.take(pa.array(list(seen.values()), pa.int64())), pa.array([bag(h[first[i] : first[i + 1]]) for i in seen.values()], pa.binary())],
                    names=["content", "text", "bag"],
                )

    return run


def _sequences(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    for _, data, offsets in K.slices(batch, column):
        starts, ends, first = K.spans(K.NOT_SPACE[data], offsets)
        h = K.span_hashes(data, starts, ends)
        yield from (h[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist()))


def banded_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """The edit distance of two sequences, or limit + 1 if it is larger: bit-parallel, in a band around the
    diagonal of ``limit`` rows to either side."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > limit:
        return limit + 1
    if n == 0:
        return m
    d = min(limit, m)
    if m - int(np.isin(a, b).sum()) > limit:  # words of a that b lacks cost one each
        return limit + 1
    rows: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        rows[x] = rows.get(x, 0) | 1 << i
    mask = (1 << (2 * d + 1)) - 1
    vp = (mask >> d) << d
    vn = 0
    score = d
    bottom, turn = 1 << (2 * d), m - d
    for j, x in enumerate(b.tolist(), 1):
        eq = rows.get(x, 0)
        shift = j - d - 1
        eq = (eq >> shift if shift >= 0 else eq << -shift) & mask
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp = vn | (mask ^ (d0 | vp))
        hn = d0 & vp
        if j <= turn:
            if not d0 & bottom:
                score += 1
        else:
            bit = bottom >> (j - turn)
            if hp & bit:
                score += 1
            elif hn & bit:
                score -= 1
        half = d0 >> 1
        vp = hn | (mask ^ ((half | hp) & mask))
        vn = half & hp
    return min(score, limit + 1)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    longest = max(len(a), len(b))
    limit = int((1 - SIMILARITY) * longest + 1e-9)
    return banded_distance(a, b, limit) <= limit


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [similar(a, b) for a, b in zip(_sequences(batch, "a"), _sequences(batch, "b"))]
        at = pa.array(np.flatnonzero(keep))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["u", "v"])


def _bags(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16)


def _limits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The edits that ``similar`` allows texts of a and b words."""
    return ((1 - SIMILARITY) * np.maximum(a, b) + 1e-9).astype(np.int64)


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose bags allow a link."""
    for batch in batches:
        if not batch.num_rows:
            continue
        differ = np.abs(_bags(batch.column(2)) - _bags(batch.column(3))).sum(1)
        keep = pa.array(np.flatnonzero(differ <= 2 * _limits(batch.column(4).to_numpy(), batch.column(5).to_numpy())))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["u", "v"])


def _verified(pairs: DataFrame, texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are similar, as a written table. A centre v may be in very many pairs: EACH of these
    have a salt, and its bag and text are sent once to each salt in use. Only texts that bags leave in a pair travel."""

    def beside(pairs: DataFrame, table: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        many = pairs.groupBy("v").agg(F.least(F.lit(SALTS), F.ceil(F.count("*") / EACH)).alias("salts")).where("salts > 1")
        pairs = pairs.join(many, "v", "left").select("u", "v", F.expr("pmod(xxhash64(u), coalesce(salts, 1))").alias("salt"))
        first = table.select(F.col("content").alias("u"), *[F.col(c).alias(f"{c}_u") for c in columns])
        second = table.select(F.col("content").alias("v"), *[F.col(c).alias(f"{c}_v") for c in columns])
        second = pairs.select("v", "salt").distinct().join(second, "v")
        return pairs.join(first, "u").join(second, ["v", "salt"])

    near = beside(pairs, sizes, ("bag", "n_words")).select("u", "v", "bag_u", "bag_v", "n_words_u", "n_words_v")
    near = materialize(near.mapInArrow(_plausible, "u binary, v binary"), "plausible")
    texts = _among(texts.select("content", "text"), near.select(F.col("u").alias("content")).union(near.select("v")))
    both = beside(near, texts, ("text",)).select("u", "v", F.col("text_u").alias("a"), F.col("text_v").alias("b"))
    links = materialize(both.mapInArrow(K.give_back(_verify), "u binary, v binary"), "links")
    discard(near)
    return links


def _close(other: str = "n_other") -> str:
    """The lengths allow a link."""
    return f"abs(n_words - {other}) <= {round(1 - SIMILARITY, 9)} * greatest(n_words, {other}) + 1e-9"


def _meetings(signed: DataFrame, first: int) -> DataFrame:
    """(bucket, content, n_words, center, n) of the tuples from ``first`` on, TOGETHER of each text, that texts of
    different words have in common, each text once for a bucket: ``center`` is the shortest of the n texts in the bucket
    of about this one's length. The tuples travel once; what follows is done where those of a bucket are."""
    members = signed.select("content", "n_words", F.explode(F.slice("sketch", first + 1, TOGETHER)).alias("bucket"))
    met = Window.partitionBy("bucket")
    shared = members.withColumn("least", F.min("content").over(met)).withColumn("most", F.max("content").over(met)).where("least <> most")
    shared = shared.groupBy("bucket", "content").agg(F.first("n_words").alias("n_words"))
    like = Window.partitionBy("bucket", F.floor(F.log(F.col("n_words").cast("double")) / F.log(F.lit(1 / SIMILARITY))))
    # the shortest has the least beside what the bucket's texts have in common
    center = F.min(F.struct("n_words", "content")).over(like)["content"]
    return shared.select("bucket", "content", "n_words", center.alias("center"), F.count("*").over(like).alias("n"))


def _mixed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, n, content, n_words, root) of buckets that hold texts of different components, as a written table: a row
    for each text of such a bucket. Buckets that hold the same texts are one, which is named by them."""
    named = shared.select("bucket", "content", "n_words").join(roots.withColumnRenamed("node", "content"), "content", "left").withColumn("root", F.coalesce("root", "content"))
    held = {"n": F.count("*"), "texts": F.expr("bit_xor(xxhash64(content))"), "first": F.min("content"), "last": F.max("content"), "least": F.min("root"), "most": F.max("root")}
    met = Window.partitionBy("bucket")
    mixed = named.select("*", *[x.over(met).alias(k) for k, x in held.items()]).where("least <> most")
    mixed = mixed.withColumn("bucket", F.xxhash64("n", "texts", "first", "last")).select("bucket", "n", "content", "n_words", "root")
    return materialize(mixed.dropDuplicates(["bucket", "content"]), "mixed-members")


def _joined(forest: DataFrame, links: DataFrame) -> DataFrame:
    """The components of a forest (node, root) and of links found since, which are removed."""
    joined = components(forest.toDF("u", "v").unionByName(links))
    discard(links)
    return joined


def _first_round(shared: DataFrame) -> DataFrame:
    """(u, v), each once: every text with the centres of its largest buckets, as a written table."""
    best = shared.where("content <> center").groupBy("content", "center").agg(F.max("n").alias("n")).groupBy("content").agg(F.sort_array(F.collect_list(F.struct("n", "center")), False).alias("all"))
    best = best.select("content", F.explode(F.slice("all", 1, CENTERS)).alias("best"))  # of SKETCHES at most
    return materialize(best.select(F.greatest("content", "best.center").alias("u"), F.least("content", "best.center").alias("v")).distinct(), "pairs")


def _second_round(members: DataFrame) -> DataFrame:
    """(u, v), each once: all pairs of small mixed buckets in different components, and each text of larger ones with
    the centre of the largest."""
    few = members.where(f"n <= {SMALL}").select("bucket", "content", "n_words", "root")
    other = few.toDF("bucket", "v", "n_other", "other")
    every = few.withColumnRenamed("content", "u").join(other, "bucket").where(f"u > v and root <> other and {_close()}").select("u", "v")
    large = members.where(f"n > {SMALL}")
    # a centre is the least by a hash of its own: a text of many large buckets meets as many centres
    center = F.min(F.struct(F.xxhash64("content", "bucket").alias("h"), "content", "n_words", "root")).over(Window.partitionBy("bucket"))
    star = large.withColumn("center", center).where(f"root <> center.root and {_close('center.n_words')}")
    star = star.groupBy("content").agg(F.max(F.struct("n", "center.content")).alias("best"))
    return every.union(star.select(F.greatest("content", "best.content").alias("u"), F.least("content", "best.content").alias("v"))).distinct()


class _Shared:
    """How many items, counted as often as they occur, texts have in common."""

    def __init__(self, items: np.ndarray, size: np.ndarray):
        self.size, self.first = size, np.cumsum(size) - size
        order = np.argsort(items, kind="stable")  # of equal items those of a text stand together
        text = np.repeat(np.arange(len(size)), size)[order]
        place = np.arange(len(items))
        other = np.append(True, items[order[1:]] != items[order[:-1]])[: len(items)]
        start = np.maximum.accumulate(np.where(other, place, 0))
        own = np.maximum.accumulate(np.where(other | np.append(True, text[1:] != text[:-1])[: len(items)], place, 0))
        self.code = np.empty(len(items), np.int64)
        self.code[order] = start + place - own  # an item's numbers begin at its start, one for each time that a text has it
        self.mark = np.zeros(len(items), bool)

    def count(self, x: int, others: np.ndarray) -> np.ndarray:
        mine = self.code[self.first[x] : self.first[x] + self.size[x]]
        self.mark[mine] = True
        found = K.row_sums(self.mark[self.code[K.ragged(self.first[others], self.size[others])]], np.append(0, np.cumsum(self.size[others])))
        self.mark[mine] = False
        return found


def _shared_runs(words: list[np.ndarray]) -> tuple[_Shared, _Shared]:
    """The words of texts and their pairs of neighbours."""
    every, size = np.concatenate(words), np.array([len(x) for x in words])
    after = np.ones(len(every), bool)
    after[np.cumsum(size)[size > 0] - 1] = False
    return _Shared(every, size), _Shared(K.window_hashes(np.append(every, np.uint64(0)), 2)[after], np.maximum(size - 1, 0))


def _block_pairs(table: pa.Table) -> pa.Table:
    """(u, v) of two blocks of a bucket, or within one: the pairs in different components whose bags allow a link and
    that belong to this of their buckets. With a column of texts the links among them, but none whose ends earlier ones
    have joined."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    own, n = table["own"].to_numpy(), table["n_words"].to_numpy().astype(np.int64)
    content, root, bags = np.array(table["content"].to_pylist(), object), np.unique(np.array(table["root"].to_pylist(), object), return_inverse=True)[1], _bags(table["bag"])
    words = list(_sequences(pa.RecordBatch.from_arrays([table["text"].combine_chunks()], names=["text"]), "text")) if "text" in table.column_names else None
    single, double = _shared_runs(words) if words is not None else (None, None)
    lists = table["buckets"].combine_chunks()
    size = lists.value_lengths().to_numpy().astype(np.int64)
    first, bucket = np.cumsum(size) - size, lists.flatten().to_numpy().view(np.uint64)
    code = np.unique(bucket, return_inverse=True)[1]
    mark = np.zeros(len(bucket), bool)
    names = np.frombuffer(b"".join(x[:8].ljust(8, b"\0") for x in content), np.uint64)
    here = np.array(table["bucket"][0].as_py(), np.int64).view(np.uint64)
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    u, v = [], []
    for k, x in enumerate(left):
        others = right[k + 1 :] if i == j else right
        limit = _limits(n[x], n[others])
        may = (root[others] != root[x]) & (np.abs(n[others] - n[x]) <= limit)
        others, limit = others[may], limit[may]
        others = others[np.abs(bags[others] - bags[x]).sum(1) <= 2 * limit]
        if not len(others):
            continue
        mine = code[first[x] : first[x] + size[x]]
        mark[mine] = True
        at = K.ragged(first[others], size[others])
        with np.errstate(over="ignore"):
            pair = names[x] + names[others]
            drawn = np.where(mark[code[at]], K.mix(bucket[at] ^ np.repeat(pair, size[others])), _MOST)
            others = others[np.minimum.reduceat(drawn, np.cumsum(size[others]) - size[others]) == K.mix(here ^ pair)]
        mark[mine] = False
        if words is not None:  # of the longer text's n words n - limit are left at least, of its n - 1 pairs n - 1 - 2 * limit
            longest = np.maximum(n[x], n[others])
            limit = _limits(n[x], n[others])
            may = single.count(x, others) >= longest - limit
            others, longest, limit = others[may], longest[may], limit[may]
            others = others[double.count(x, others) >= longest - 1 - 2 * limit]
        for y in others:
            if words is not None:
                if root[x] == root[y] or not similar(words[x], words[y]):
                    continue
                root[root == root[y]] = root[x]
            u.append(max(content[x], content[y]))
            v.append(min(content[x], content[y]))
    return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})


def _block_links(table: pa.Table) -> pa.Table:
    try:
        return _block_pairs(table)
    finally:
        if table.num_rows > BLOCK // 4:  # it takes longer than a small group itself
            K.trim()


def _third_round(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(u, v), each once: of all pairs of larger mixed buckets in different components those whose bags allow a link;
    the links among them, as many as join the components, if ``sizes`` has texts."""
    members = members.where(f"n > {SMALL}")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.sum("n_words").over(Window.partitionBy("bucket")) / BLOCK_WORDS))
    buckets = members.groupBy("content").agg(F.collect_set("bucket").alias("buckets"))  # SKETCHES at most
    columns = [c for c in ("bag", "text") if c in sizes.columns]
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.expr("pmod(xxhash64(content), blocks)"))
    dealt = dealt.join(buckets, "content").join(sizes.select("content", *columns), "content").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "content", "n_words", "root", "buckets", *columns)
    return dealt.groupBy("bucket", "i", "j").applyInArrow(_block_links, "u binary, v binary").distinct()


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: ROW (its row number), doc_id, class_id, class_size and whether it is the one kept."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias(ROW), "doc_id", F.col(text).alias(text))
    signed = materialize(numbered.mapInArrow(K.give_back(_signatures(text)), f"{ROW} long, doc_id {kind}, content binary, n_words long, sketch array<long>"), "signatures")
    # to find the tuples of different texts and these texts
    shared = materialize_parts([_meetings(signed, k) for k in range(0, SKETCHES, TOGETHER)], "buckets")
    rows = materialize(signed.select(ROW, "doc_id", "content", "n_words"), "rows")
    discard(signed)
    pairs = _first_round(shared)
    needed = materialize(shared.select("content").distinct(), "needed")
    may = docs.sparkSession.sparkContext.broadcast(_filter(needed))
    plain = docs.select(F.col(text).alias(text)).mapInArrow(K.give_back(_texts(text, may)), "content binary, text string, bag binary")
    texts = materialize(plain.join(needed, "content", "left_semi").dropDuplicates(["content"]), "texts")
    discard(needed)
    sizes = materialize(texts.select("content", "bag").join(shared.select("content", "n_words").distinct(), "content"), "sizes")
    links = _verified(pairs, texts, sizes)
    forest = components(links)
    discard(links)
    members = _mixed(shared, forest)
    more = materialize(_second_round(members).join(pairs, ["u", "v"], "left_anti"), "pairs")
    discard(pairs)
    links = _verified(more, texts, sizes)
    forest = _joined(forest, links)
    large = materialize(members.where(f"n > {SMALL}").select("bucket", "content", "n_words"), "large")
    discard(members)
    if large.take(1):
        left = _mixed(large, forest)
        links = materialize(_third_round(left, _among(texts, left.select("content").distinct())), "links")
        discard(left)
        forest = _joined(forest, links)
    discard(shared, more, texts, sizes, large)
    named = rows.join(forest.withColumnRenamed("node", "content"), "content", "left").withColumn("root", F.coalesce("root", "content"))
    named = named.select(ROW, "doc_id", F.when(F.col("n_words") > 0, F.col("root")).otherwise(F.col(ROW).cast("string").cast("binary")).alias("root"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"), F.col(ROW).alias("r"))).alias("best")
    chosen = materialize(named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), best), "classes")
    return named.join(chosen, "root").select(ROW, "doc_id", "class_id", "class_size", (F.col(ROW) == F.col("best.r")).alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    return classes(docs.select("doc_id", "text")).drop(ROW)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (a table) with one of each class, all columns as they were."""
    stay = classes(docs).where("kept").select(ROW)
    return docs.withColumn(ROW, F.monotonically_increasing_id()).join(stay, ROW, "left_semi").select(*docs.columns)
