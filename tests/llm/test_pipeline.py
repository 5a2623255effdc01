"""Each stage of the pipeline on its own input, against plain versions."""
import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql.types import StructType

import corpus_pipeline
from tests.llm.helpers import AWKWARD, SCHEMA, words
from tests.llm.test_minhash_dedup import plain
from tripwright.llm import byte_bpe
from tripwright.storage import materialize

SF = "/root/testdata/sf0.001"


def test_stages_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {}
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before[name] = docs.collect()
        columns = docs.columns
        docs = materialize(stage(spark, docs, SF), "stage")
        after[name] = docs.collect()
        if stage is not corpus_pipeline.encode:
            assert docs.columns == columns
    quality, exact, near, mixed, coded = (n for n, _ in corpus_pipeline.STAGES)

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in after[quality]}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in left for i in good) >= 0.9 * len(good)

    groups = defaultdict(list)
    for r in before[exact]:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    assert sorted(r.doc_id for r in after[exact]) == sorted(min(g) for g in groups.values())

    want = [i for i, _, _, kept in plain([(r.doc_id, r.text) for r in before[near]], 5, 80) if kept]
    assert sorted(r.doc_id for r in after[near]) == sorted(want)

    copies, size = Counter(r.doc_id for r in after[mixed]), {r.doc_id: len(words(r.text)) for r in before[mixed]}
    assert max(copies.values()) <= 3 and set(copies) <= set(size)
    taken, budget = sum(size[i] * n for i, n in copies.items()), sum(size.values())
    assert budget - max(size.values()) <= taken <= budget

    bpe = byte_bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = sorted((r.doc_id, bpe.encode_ordinary(r.text or "")) for r in before[coded])
    assert sorted((r.doc_id, list(r.ids)) for r in after[coded]) == want
    texts = {r.doc_id: r.text or "" for r in before[coded]}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in after[coded])


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50


def folder_of(spark, tmp_path, rows):
    """A table folder of these documents, without the column that only differs in case: Parquet refuses it."""
    schema = StructType([f for f in SCHEMA if f.name != "TEXT"])
    spark.createDataFrame([(*r, "r", "s", "d", "q") for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], i % 2, 0) for i, r in enumerate(rows)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_run_on_an_empty_table(spark, tmp_path):
    got = corpus_pipeline.run(spark, folder_of(spark, tmp_path, []))
    assert got.collect() == [] and set(got.columns) == set(corpus_pipeline.run(spark, SF).columns)


def test_each_stage_on_awkward_rows(spark, tmp_path):
    """Stages that keep rows return rows of their input, with all its columns; the whole run ends."""
    sf = folder_of(spark, tmp_path, AWKWARD)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = Counter(map(tuple, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        rows = Counter(map(tuple, kept.collect()))
        assert kept.columns == docs.columns and set(rows) <= set(whole), name
    exact = corpus_pipeline.STAGES[1][1](spark, docs, sf).collect()
    assert sorted((r.doc_id for r in exact), key=repr) == sorted([1, 3, 5, 6, 7, 9, 10, None], key=repr)
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(r.decoded_sha256 for r in coded) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in AWKWARD)
    assert 0 <= corpus_pipeline.run(spark, sf).count() <= 3 * len(AWKWARD)
