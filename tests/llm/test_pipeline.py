"""The pipeline's stages on their own inputs, and its result against brute force."""

import corpus_pipeline
import pytest

from quillmesh.llm import bpe, decontaminate, near_dedup, quality, secret_scan

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "encoding"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    passed = {r.doc_id: r for r in quality.annotate(docs).collect() if r.kept}
    for r in passed.values():
        assert not quality.brute_force(r.text)[-1]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left, words = [], {i: passed[i].text.split() for i in sorted(passed)}
    import numpy as np

    number: dict[str, int] = {}
    arrays = {i: np.array([number.setdefault(w, len(number)) for w in ws], np.uint32) for i, ws in words.items()}
    root = {i: i for i in arrays}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(arrays)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if find(i) != find(j) and near_dedup.similar(arrays[i], arrays[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    left = [i for i in ids if find(i) == i]
    hits = decontaminate.brute_force([passed[i].text for i in left], items)
    left = [i for i, h in zip(left, hits) if not h["n_hit"]]
    assert sorted(got) == left
    for i in left:
        text = passed[i].text
        spans = sorted(tuple(map(int, s.split(":")[1:])) for s in secret_scan.brute_force(text)[4].split(",") if s)
        out, at = "", 0
        for s, e in spans:
            if s >= at:
                out += text[at:s] + secret_scan.MARK
            at = max(at, e)
        assert got[i].n_tokens == len(bpe.encode(out + text[at:] if spans else text))


def test_empty(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
