"""Templates under five words."""

from marginalia.llm import licenses

TEXTS = ["All rights reserved.", "x y z. ALL RIGHTS\nRESERVED, 2020", "all rights are reserved", "overall rights reserved", "all rights reservedly", "", None]


def test_short_templates_are_found(spark, tmp_path):
    rows = [*enumerate([*TEXTS, "All rights reserved. Released under the MIT License."])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_licenses"], r["licenses"], r["restricted"]) for r in licenses.op7_licenses(spark, str(tmp_path)).collect()}
    none = (0, "", False)
    assert got == {
        0: (1, "all-rights-reserved", True), 1: (1, "all-rights-reserved", True), 2: none, 3: none, 4: none, 5: none, 6: none,
        7: (2, "all-rights-reserved,mit-notice", True),
    }
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in licenses.scan(docs, {"four": "the mit license all", "three": "the MIT license"}).collect() if r["licenses"] == ["three"]} == {7}
    assert all(r["licenses"] == [] for r in licenses.scan(docs, {}).collect())


def test_every_notice_of_the_table_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r["doc_id"] for r in docs.collect() if " all rights reserved " in f" {' '.join(licenses.words_of(r['text'] or ''))} "}
    assert want and want == {r["doc_id"] for r in licenses.scan(docs).collect() if "all-rights-reserved" in r["licenses"]}
