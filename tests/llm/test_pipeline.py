"""The pipeline against the same stages in plain Python on a small corpus."""

import os
import sys
import zlib

import numpy as np
import pytest

import corpus_pipeline
from heddle.llm import bpe, pii
from heddle.llm.entry import PII_KEY, vocabulary

sys.path.insert(0, os.path.dirname(__file__))
from test_duplicates import FOLD, shingles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_and_result(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, folder)
    assert kept.columns == docs.columns
    rows = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    assert 200 < len(rows) < 400
    # Lines that an earlier document holds.
    strip = "\t\n\x0b\x0c\r "
    own = {}
    for d, t in rows:
        for line in t.split("\n"):
            own.setdefault(line.strip(strip).translate(FOLD), []).append(d)
    rows = [(d, "\n".join(x for x in t.split("\n") if len(k := x.strip(strip).translate(FOLD)) < 10 or own[k][0] == d or len(set(own[k])) < 2)) for d, t in rows]
    # One document of each class.
    sets, parent = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    rows = [(d, t) for d, t in rows if find(d) == d]
    # Surrogates (no collisions among so few), tokens.
    texts = [(d, pii.rewrite(t, PII_KEY, {})[0]) for d, t in rows]
    enc = bpe.Encoder(vocabulary())
    want = {d: [*x.tolist(), 2] for (d, _), x in zip(texts, enc.batch([t for _, t in texts]))}
    got = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert set(got) == set(want)
    for d, pieces in got.items():
        at = 0
        for start, n, crc, total in sorted(pieces):
            assert start == at and total == len(want[d]) and crc == zlib.crc32(np.array(want[d][start : start + n], "<u4").tobytes())
            at += n
        assert at == len(want[d])


def test_stages_take_awkward_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c", None, None, None), (2, "a b d", None, None, None)], docs.schema)
    for df, n in ((odd, 5), (odd.where("false"), 0)):
        out = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, folder)
            assert out.columns == docs.columns and out.count() <= n
        assert corpus_pipeline.STAGES[-1][1](spark, out, folder).count() == out.count()
