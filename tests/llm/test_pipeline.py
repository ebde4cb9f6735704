"""The pipeline, stage by stage, over documents of which it is known what should become of them."""

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import mixing
from tessera.llm.common import written

from .helpers import AWKWARD, documents, prose


def test_stages(spark, tmp_path):
    good = [(i, prose(i, 150)) for i in range(100, 150)]
    copies = [(1000 + i, t.replace(".", "!")) for i, t in good[:10]]
    bad = [(i, " | ".join(f"{w}###" for w in prose(i, 60).split())) for i in range(200, 220)]
    short = [(i, prose(i, 20)) for i in range(300, 305)]
    documents(spark, good + copies + bad + short + AWKWARD).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        rows = docs.collect()
        if name != "encode":
            docs = spark.createDataFrame(rows, docs.schema)
            assert docs.columns == columns
        seen.append((name, rows))
    ids = {name: {r.doc_id for r in rows} for name, rows in seen}
    keep = {i for i, _ in good}
    assert keep <= ids["classify"] and not ids["classify"] & {i for i, _ in bad}
    assert {i for i in ids["rules"] if i and i >= 100} == keep | {i for i, _ in copies}
    assert {i for i in ids["dedup"] if i and i >= 100} == keep
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(good)
    for r in seen[-1][1]:
        if r.doc_id in texts:
            assert np.frombuffer(r.ids, np.uint32).tolist() == library.encode(texts[r.doc_id]).ids and r.n_tokens == len(r.ids) // 4
    assert len(seen[-1][1]) == len(seen[-2][1])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[-1][1])


def test_training_order_reaches_the_result(spark, tmp_path):
    docs = documents(spark, [(i, prose(i, 40 + i % 60)) for i in range(200)])
    rows, plan = mixing.planned(docs)
    want = [r.doc_id for r in sorted(mixing.mix(docs, plan).select("_t", "_at", "_copy", "_row.doc_id").collect())]
    mixed = written(corpus_pipeline.mix(spark, docs, ""), "mix")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")  # files are read in parts, small ones together
    try:
        got = corpus_pipeline.encode(spark, mixed, "").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r.part for r in got}) > 1 and [r.doc_id for r in sorted(got, key=lambda r: (r.part, r.row))] == want


CLASH = ("keys", "n", "rep", "sig", "component", "size", "_at", "_t", "_s", "_id", "_row", "ids", "part", "row", "score", "kept", "word", "votes")


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_on_awkward_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = documents(spark, AWKWARD + [(i, prose(i, 80)) for i in range(20, 40)]).withColumns({c: F.lit("x") for c in CLASH})
    blank = docs.select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    out = stage(spark, docs, "")
    rows = out.collect()
    assert {r.doc_id for r in rows} <= {i for i, _ in AWKWARD} | set(range(20, 40)) and set(range(20, 40)) - {r.doc_id for r in rows} == set() or name == "mix"
    assert stage(spark, docs.limit(0), "").collect() == []
    nothing = stage(spark, blank.limit(5), "").collect()
    if name == "encode":
        assert [(r.doc_id, r.n_tokens, bytes(r.ids)) for r in nothing] == [(None, 0, b"")] * 5
    else:
        assert out.columns == docs.columns and stage(spark, docs.limit(0), "").columns == docs.columns
        # the rules and the mix have no use for them, one row stays of equal ones
        assert len(nothing) == {"classify": len(nothing), "rules": 0, "dedup": 1, "mix": 0}[name]
