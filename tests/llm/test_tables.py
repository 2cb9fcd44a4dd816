"""Every query and the pipeline over whole tables of edge rows, and over empty tables."""

import pytest

import corpus_pipeline
from marginalia.llm.queries import QUERIES

from .test_operators import edge_docs, frame

QUERY_COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op3_simhash": ["doc_id", "fingerprint", "component_id"],
    "op4_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op5_exact_search": ["query_id", "rank", "vec_id", "score"],
    "op6_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_licenses": ["doc_id", "n_licenses", "licenses"],
    "op8_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op9_quality": ["doc_id", "held_out", "score", "predicted"],
    "op10_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
}


def write(spark, folder, docs, empty):
    tables = {
        "documents": docs,
        "labels": spark.createDataFrame([(0, 1, 0), (3, 0, None), (9, 0, 1), (9, 1, 1), (None, 1, 1), (12, 1, 0)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, "one two three"), (2, None), (None, "a b c d"), (1, "one two three")], "item_id long, text string"),
        "embeddings": spark.createDataFrame([(0, [1.0, 2.0], 1), (50, [2.0, 1.0], 1), (50, [2.0, 1.0], 1), (1, None, 1), (None, [1.0, 1.0], 1)], "vec_id long, embedding array<float>, label int"),
    }
    for name, df in tables.items():
        (df.limit(0) if empty else df).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module", params=[False, True], ids=["edges", "empty"])
def folder(request, spark, tmp_path_factory):
    docs = edge_docs(spark)
    return write(spark, tmp_path_factory.mktemp("tables"), docs, request.param), 0 if request.param else docs.count()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_on_tables(spark, folder, name):
    got = QUERIES[name](spark, folder[0])
    assert got.columns[: len(QUERY_COLUMNS[name])] == QUERY_COLUMNS[name]
    rows = got.collect()
    if name == "op5_exact_search":
        assert len(rows) == (9 if folder[1] else 0)  # three queries, three candidates each
    else:
        assert len(rows) == folder[1]


def test_pipeline_on_tables(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    df = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, folder[0])
        assert df.columns == docs.columns
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    assert sorted(r["slot"] for r in rows if r["shard"] == 0) == list(range(sum(r["shard"] == 0 for r in rows)))


def test_pipeline_stages_against_plain_forms(spark):
    """Each stage's decisions on its own input, from the operators' plain forms."""
    from . import brute

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect()}
    assert kept == set(brute.components([i for i, _ in rows], [brute.simhash(t) for _, t in rows]))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for (i, _), (n, hit, _) in zip(rows, brute.contamination([t for _, t in rows], items)) if not hit}
    assert {r["doc_id"] for r in corpus_pipeline.decontamination_stage(spark, docs, sf).collect()} == clean
    mixed = corpus_pipeline.mixing_stage(spark, docs, sf)
    assert mixed.exceptAll(mixed.distinct().join(docs, docs.columns, "left_semi")).groupBy(*docs.columns).count().where("count > 2").isEmpty()
    assert mixed.select("doc_id").distinct().join(docs, "doc_id", "left_anti").isEmpty()
    shards = corpus_pipeline.sharding_stage(spark, docs, sf).groupBy("shard").count().collect()
    assert max(r["count"] for r in shards) - min(r["count"] for r in shards) <= 1


def test_one_text_in_most_rows(spark):
    """A hot group of copies, in every operator that groups."""
    from pyspark.sql import functions as F

    from marginalia.llm import mixing, sharding, simhash, suffix_dedup

    docs = frame(spark, [(i, "the same words in a row of them " * 20, "s") for i in range(3000)] + [(5000 + i, f"other {i} text {i * 7} here", "t") for i in range(300)])
    assert simhash.deduplicate(docs).where("doc_id < 3000").count() == 1
    removed = suffix_dedup.remove_repeats(docs).where("doc_id < 3000").agg(F.max(F.octet_length("kept"))).first()[0]
    assert removed == 0
    assert mixing.mix(docs).count() > 0
    counts = [r["count"] for r in sharding.shard(docs).groupBy("shard").count().collect()]
    assert len(counts) == 16 and max(counts) - min(counts) <= 1
