"""The pipeline held against plain Python versions of its stages, each on its own input."""

import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from corpus import components
from seclog.llm.tokens import default_vocabulary
from seclog.llm.toxicity import score
from test_others import base_spans, brute_hits


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    results = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, results[-1], sf).write.parquet(f"{tmp_path}/{name}")
        results.append(spark.read.parquet(f"{tmp_path}/{name}"))
    start, toxic, single, clean, masked, packed = [r.collect() for r in results]
    assert all(r.columns == columns for r in results[:-1])

    scored = score(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    left = {r.doc_id for r in toxic}
    assert left == {r.doc_id for r in scored if not r.predicted} and len(toxic) == len(left)
    assert {tuple(r) for r in toxic} <= {tuple(r) for r in start}

    want, _ = components([(r.doc_id, r.text) for r in toxic], 5, 80)
    assert sorted(r.doc_id for r in single) == sorted(i for i, c in want.items() if i == c)

    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = brute_hits([(r.doc_id, r.text) for r in single], items)
    assert sorted(r.doc_id for r in clean) == sorted(i for i, h in hits.items() if not h[3])

    before = {r.doc_id: r.text for r in clean}
    assert {r.doc_id for r in masked} == set(before)
    for r in masked:
        assert not base_spans(r.text)
        if not base_spans(before[r.doc_id]) and not re.search(r"[A-Za-z0-9+/_=-]{20}", before[r.doc_id]):
            assert r.text == before[r.doc_id]

    library = Tokenizer.from_file(default_vocabulary())
    pieces = []
    for r in masked:
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        pieces += [(r.doc_id, p // 4096, zlib.crc32(np.array(ids[p:p + 4096], "<u4").tobytes())) for p in range(0, len(ids), 4096)]
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed) == sorted(pieces)
    assert corpus_pipeline.ORACLE_SQL is None
