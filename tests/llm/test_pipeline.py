"""The pipeline on the smallest tables, stage by stage against what must hold."""

import zlib

import numpy as np

import corpus_pipeline
from pulsemill.llm import decontamination, tokens

DIR = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        now = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and now <= before and len(now) > len(before) * 0.6
        before = now
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    left = decontamination.digest(decontamination.find(docs, bench))
    assert left.where("contaminated").count() == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    enc = tokens.encoder(tokens.tokenizer_path())
    rows = corpus_pipeline.run(spark, DIR).collect()
    ids = {d: np.frombuffer(enc.plain(t), "<u4").tolist() + [1] for d, t in texts.items()}
    assert {r.doc_id for r in rows} == set(ids)
    for r in rows:
        piece = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert zlib.crc32(piece.tobytes()) == r.ids_crc32
