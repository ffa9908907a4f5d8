"""The pipeline's stages against plain versions, each on what its predecessor kept."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as entry
from shoebox.llm import langid, simhash
from shoebox.llm.common import lean_batches
from tests.llm import plain
from tests.llm.test_near_copies import least_ids

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "simhash", "decontaminate", "mix", "tokens"]
    odd = spark.createDataFrame([(10**6, "#### 1234 ....", "en", "src0", 14), (10**6 + 1, None, None, None, None)], docs.schema)
    kept = docs.unionByName(odd)
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = kept.collect()
        out = stage(spark, kept, DATA)
        assert out.columns == columns
        left = out.collect()
        if name == "language":
            assert {r.doc_id for r in rows} - {r.doc_id for r in left} == {10**6, 10**6 + 1}
        elif name == "simhash":
            assert sorted(str(r.doc_id) for r in left) == least_ids(rows)
        elif name == "decontaminate":
            assert sorted(r.doc_id for r in left) == sorted(r.doc_id for r in rows if not plain.contamination(r.text, items)[1])
        else:
            assert {r.doc_id for r in left} <= {r.doc_id for r in rows} and len(left) > 1.2 * len(rows)
        kept = spark.createDataFrame(left, docs.schema)
    final = corpus_pipeline.STAGES[-1][1](spark, kept, DATA).orderBy("start").collect()
    assert sorted(r.doc_id for r in final) == sorted(r.doc_id for r in left)
    assert [r.start for r in final] == [sum(x.n_tokens for x in final[:k]) for k in range(len(final))]


def test_registered():
    found = entry.queries()
    assert {n.split("_")[0] for n in found if n.startswith("op")} >= {f"op{k}" for k in range(1, 14)} and found["pipeline"] is corpus_pipeline.run
    assert {"op4_subspace", "op6_decontaminate", "op7_mix", "op10_licenses", "op11_manifest", "op12_resample"} <= set(entry.oracle_sql())
    assert langid.NOTHING == "und"


def test_workers_hold_little():
    """Working arrays of the language and simhash stages over texts of 2 MB, in bytes."""
    draws = random.Random(1)
    words = ["".join(draws.choices("abcdefghij", k=draws.randint(2, 9))) for _ in range(2_000)]
    texts = [" ".join(draws.choices(words, k=350)) for _ in range(1_000)]
    raw = [t.encode() for t in texts]
    model = langid.Model(["a", "b"], np.random.default_rng(1).integers(0, 4, (1 << 16, 1)).astype(np.uint8))

    def peak(job):
        tracemalloc.start()
        try:
            out = job()
            return out, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    scores, most = peak(lambda: model.scores(texts))
    assert most < 20 << 20 and np.array_equal(scores[:7], model.scores(texts[:7]))
    prints, most = peak(lambda: np.concatenate([simhash.fingerprints(raw[a:b], 5) for a, b in simhash._sliced(raw)]))
    assert most < 20 << 20 and np.array_equal(prints, simhash.fingerprints(raw, 5))


def test_lean_batches(spark):
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = [spark.conf.get(k) for k in keys]

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64()), "size": pa.array([batch.nbytes], pa.int64())})

    with lean_batches(spark):
        sent = spark.range(0, 2_000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text")).mapInArrow(sizes, "n long, size long").collect()
        assert int(spark.conf.get(keys[2])) < 4_096
    assert sum(r.n for r in sent) == 2_000 and max(r.size for r in sent) < 3 << 20
    assert [spark.conf.get(k).removesuffix("b") for k in keys] == [x.removesuffix("b") for x in before]
