"""The operators against plain forms of their contracts, on edge rows and on the small tables."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, exact_search, licenses, mixing, pii, quality, sharding, simhash, suffix_dedup, toxicity
from marginalia.llm.graph import connected_components

from . import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, uid long"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5, 1, 7) for i, t, s in rows], SCHEMA)


def edge_texts():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "Delta", "eps", "zeta", "éta", "theta"]
    long = " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(3000))
    return [None, "", "   \n\t", "one", "One two", "a b c d", "A b\x0bc  d", long, long, long + " more", long.replace("beta", "bet4", 1)]


def edge_docs(spark):
    texts = edge_texts()
    rows = [(i * 3, t, ["x", "y", None][i % 3]) for i, t in enumerate(texts)]
    return frame(spark, [*rows, rows[-1], rows[-1], (None, "one", "y")])


# --- PII ---------------------------------------------------------------------------------------------------------


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@+- ()%9éZ\n", max_size=60))
def test_pii_base_kinds_equal_the_patterns(text):
    found = pii.find(text, pii.automaton())
    assert {k: found[k] for k in pii.BASE_KINDS} == brute.base_spans(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="0123456789 -.", max_size=80))
def test_pii_digits_equal_the_patterns(text):
    found = pii.find(text, pii.automaton())
    assert {k: found[k] for k in pii.BASE_KINDS} == brute.base_spans(text)


def test_pii_added_kinds():
    text = 'see https://ex.org/a?b=1, token = "0641917ea4e9feb9cda8" password=b3936fa83b IBAN GB82 WEST 1234 5698 7654 32. token of'
    found = pii.find(text, pii.automaton())
    assert [text[i:j] for i, j in found["url"]] == ["https://ex.org/a?b=1"]
    assert [text[i:j] for i, j in found["secret"]] == ["0641917ea4e9feb9cda8", "b3936fa83b"]
    assert [text[i:j] for i, j in found["account"]] == ["GB82 WEST 1234 5698 7654 32"]


def test_pii_of_very_long_texts():
    """Time stays linear where one cue follows another, or where a run has no end."""
    import time

    anchors = pii.automaton()
    n = 200_000
    for text in ("iban " + "A1" * n, "iban DE1 " * (n // 9), "token=" * (n // 6), "token=x1" * (n // 8), "http://." * (n // 8), "http://a" * (n // 8), "a@" * (n // 2), "1" * n, "1.1" * (n // 3), "+1" * (n // 2), "+1 (" * (n // 4), "token" + " " * n):
        began = time.process_time()
        pii.find(text, anchors)
        assert time.process_time() - began < 5, text[:20]
    spans = pii.find("x " * 100_000 + "iban DE89 3704 0044 0532 0130 00 token=abc123def", anchors)
    assert spans["account"] == [(200_005, 200_032)] and spans["secret"] == [(200_039, 200_048)]
    inner = pii.find('token=password=abc token="secret:a1b2c3d4', anchors)["secret"]
    assert inner == [(33, 41)]


def test_pii_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = pii.op2_pii(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = brute.base_spans(texts[r["doc_id"]])
        base = ",".join(f"{k}:{i}:{j}" for k in pii.BASE_KINDS for i, j in spans[k])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [len(spans[k]) for k in pii.BASE_KINDS]
        assert r["spans"].startswith(base)


# --- SimHash -----------------------------------------------------------------------------------------------------


def check_simhash(rows, got):
    prints = [brute.simhash(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [f"{p:016x}" for p in prints], brute.components([i for i, _ in rows], prints)), key=str)
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == want


def test_simhash_edges(spark):
    docs = edge_docs(spark)
    got = simhash.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    check_simhash([(r["doc_id"], r["text"]) for r in docs.collect()], got)


def test_simhash_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_simhash([(r["doc_id"], r["text"]) for r in docs.collect()], simhash.op3_simhash(spark, SF).collect())


@pytest.mark.parametrize("plan", [p for _, p in simhash.PLANS])
@pytest.mark.parametrize("block", [4, 4096])
def test_simhash_links_keep_every_component(spark, plan, block):
    rng = random.Random(block)
    prints = set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(25):
            prints.add(p)
            for _ in range(rng.randrange(1, 6)):
                p ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.classes(df, plan=plan, block=block).collect()}
    assert [got[p] for p in signed] == brute.components(list(range(len(prints))), prints)


def test_deduplicate_keeps_one_of_each_class(spark):
    docs = edge_docs(spark)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    classes = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(classes)


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_with_broadcast_hubs(spark, monkeypatch):
    """The same components where all but the smallest groups count as hubs."""
    from marginalia.llm import graph

    monkeypatch.setattr(graph, "HUB", 3)
    test_components_of_chains_and_hubs(spark)
    rows = spark.createDataFrame([(k, v) for k in (1, 2, 3) for v in range(10 * k * (k < 3))] + [(7, 0)], "u long, v long")
    values = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    joined = graph.join_hubs(rows, values, "u", rows.count())
    assert sorted(joined.collect()) == sorted((r["u"], r["v"], 0) for r in rows.collect())


# --- decontamination ---------------------------------------------------------------------------------------------


def check_contamination(docs, bench, **more):
    rows, items = [(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()]
    want = [(i, *w, w[1] > 0 and 20 * w[1] >= w[0]) for (i, _), w in zip(rows, brute.contamination([t for _, t in rows], items))]
    got = [(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in decontaminate.contamination(docs, bench, **more).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = decontaminate.drop_contaminated(docs, bench, **more)
    assert kept.schema == docs.schema
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((w[0] for w in want if not w[2]), key=str)
    assert decontaminate.drop_contaminated(docs, bench, share=20, **more).count() == sum(not w[-1] for w in want)


def test_contamination_edges(spark):
    a = " ".join(f"w{i % 7}" for i in range(40))
    bench = spark.createDataFrame([(1, a), (2, "Short One"), (3, ""), (4, None), (None, "solo"), (2, "short one"), (5, "x!y?z")], "item_id long, text string")
    docs = frame(spark, [(1, a, "s"), (2, "pre " + a + " post " * 900, "s"), (3, "SHORT, one solo", "s"), (4, None, "s"), (5, "", "s"), (6, "x y z x y z", "s"), (7, "w0 " * 50, "s"), (7, "w0 " * 50, "s")])
    for size in (1, 60, 10**6):
        check_contamination(docs, bench, block_bytes=size)
    check_contamination(docs, bench.limit(0))


def test_contamination_of_long_documents(spark):
    """One benchmark window in a very long text is enough for the filter, not for the flag."""
    item = " ".join(f"bench{i}" for i in range(30))
    filler = " ".join(f"f{i % 977}" for i in range(30_000))
    docs = frame(spark, [(1, f"{filler} {' '.join(item.split()[5:18])} {filler}", "s"), (2, filler, "s"), (3, f"{filler} {' '.join(item.split()[5:17])} end", "s")])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["contaminated"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: (13, False), 2: (0, False), 3: (0, False)}
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()) == [2, 3]


def test_tables_of_many_blocks_are_built_once(monkeypatch):
    """A task with documents under HOLD builds each of 20 blocks' tables once, however many batches it reads."""
    built = []

    class Counted(decontaminate.WuManber):
        def __init__(self, *a):
            built.append(1)
            super().__init__(*a)

    class Part:
        def __init__(self, k):
            self.value = [(str(k), " ".join(f"b{k}w{i}" for i in range(20)).encode())]

    monkeypatch.setattr(decontaminate, "WuManber", Counted)
    parts = [Part(k) for k in range(20)]
    batches = [pa.RecordBatch.from_arrays([pa.array([" ".join(f"b{k}w{i}" for i in range(20))] * 300)], names=["text"]) for k in range(20)]
    found, held = [], {}
    for b in decontaminate.gathered(iter(batches), parts):
        found += [ids for _, _, ids in decontaminate.scan(decontaminate.text_bytes(b.column("text")), parts, 13, held)]
    assert found == [{str(k)} for k in range(20) for _ in range(300)]
    assert len(built) == 20


def test_contamination_table(spark):
    check_contamination(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))


# --- exact search ------------------------------------------------------------------------------------------------


def check_search(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int, size int")
    vectors = exact_search.integer_vectors(df)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_search.top_k(vectors, F.col("vec_id") % 50 == 0, **more).collect() if r["vec_id"] is not None)
    fine = [(i, np.floor(256 * np.array(e, np.float32).astype(float))) for i, e, *_ in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for q, (i, v) in enumerate(fine):
        if i is not None and i % 50 == 0:
            scores = [(-int(v @ w), j) for c, (j, w) in enumerate(fine) if c != q and len(w) == len(v) and j is not None]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(sorted(scores)[:5])]
    assert got == sorted(want)


def test_search_edges(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(6) / 4 + (i % 3)).tolist(), 1, 2) for i in range(300)]
    rows += [(300, None, 1, 2), (301, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1, 2), (350, [float("nan")] * 6, 1, 2), (302, [float("inf")] * 6, 1, 2)]
    rows += [(400, [1.0, 2.0], 1, 2), (401, [3.0, 4.0], 1, 2), (450, [], 1, 2), (451, [], 1, 2), rows[50], rows[50]]
    rows += [(1000 + i, rows[7][1], 1, 2) for i in range(50)]
    check_search(spark, rows)
    check_search(spark, rows, queries=3, candidates=40)
    check_search(spark, [])


def test_cover_tree_prunes_and_covers():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.standard_normal((800, 8)) + 40 * rng.standard_normal(8) for _ in range(8)])
    tree = exact_search.cover_tree(points)

    def walk(node):
        assert np.sqrt(((points[node.rows] - node.center) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
        for c in node.children:
            walk(c)

    walk(tree)
    n = np.arange(len(points))
    search = exact_search.DualTree(points[::50], n[::50], points, n, n, 5)
    search.run()
    assert search.pairs < len(points) * len(points[::50]) / 2
    for row, i in enumerate(n[::50]):
        s = points @ points[i]
        s[i] = -np.inf
        assert list(search.found[row]) == list(np.argsort(-s, kind="stable")[:5])


# --- mixing ------------------------------------------------------------------------------------------------------


def words_in(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check_mix(docs, block=mixing.BLOCK):
    rows = docs.collect()
    got = mixing.copies(mixing.plan(mixing.slim(docs), block=block)).collect()
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=str) == sorted(((r["doc_id"], words_in(r["text"])) for r in rows), key=str)
    size = {}
    for r in rows:
        size[r["source"]] = size.get(r["source"], 0) + words_in(r["text"])
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full, total = {}, set(), sum(size.values())
    while True:
        open_ = [s for s in order if s not in full]
        left = total - sum(3 * size[s] for s in full)
        w = sum(weight[s] for s in open_)
        target = {s: 3 * size[s] if s in full else left * weight[s] / w for s in order}
        above = {s for s in open_ if target[s] > 3 * size[s]}
        if not above:
            break
        full |= above
    taken = {}
    largest = {}
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, total) and r["source_size"] == size[r["source"]]
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    for s in order:
        assert abs(taken[s] - target[s]) <= 2 * largest[s] + 1
    again = mixing.copies(mixing.plan(mixing.slim(docs.repartition(7)), block=block)).select(*got[0].__fields__).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    return target, taken


def test_mixing_edges(spark):
    check_mix(edge_docs(spark))


def test_mixing_table_in_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    target, taken = check_mix(docs)
    assert all(abs(taken[s] - target[s]) <= 0.06 * target[s] for s in target)
    check_mix(docs, block=16)


def test_mixing_repeated_row_and_result(spark):
    docs = frame(spark, [(1, "a b c", "s")] * 500 + [(i, "w " * (i % 40 + 1), "t") for i in range(2, 400)] + [(i, "v " * 30, "u") for i in range(400, 500)])
    check_mix(docs)
    mixed = mixing.mix(docs)
    want = mixing.copies(mixing.plan(mixing.slim(docs))).agg(F.sum("copies"), F.sum(F.col("copies") * F.col("size"))).first()
    assert mixed.columns == docs.columns and mixed.count() == want[0]
    assert sum(words_in(r["text"]) for r in mixed.collect()) == want[1]


def test_mixing_empty(spark):
    docs = frame(spark, [])
    assert mixing.copies(mixing.plan(mixing.slim(docs))).count() == 0 and mixing.mix(docs).count() == 0


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    p, x = np.full(500, 0.37), rng.integers(1, 400, 500)
    q = mixing.fly(p, x, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * x).sum() - (p * x).sum()) < 1e-4
    r = mixing.land(q, x)
    assert set(r) <= {0.0, 1.0} and abs((r * x).sum() - (p * x).sum()) <= 400


# --- licenses ----------------------------------------------------------------------------------------------------


def test_licenses(spark):
    t = licenses.TEMPLATES
    grant = t["mit-grant"].split()
    grant[30] = "other"
    far = "Permission is hereby granted to any person who asks for it in the course of the day and not to others at all"
    rows = [(i, "word here " * 7 + text + " and then some more words follow it", "s") for i, text in enumerate(t.values())]
    rows += [(100, " ".join(grant), "s"), (101, far, "s"), (102, None, "s"), (103, "", "s"), (104, "released under the mit", "s"), (105, "x " * 3000 + t["mit-grant"].upper(), "s")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(frame(spark, rows)).collect()}
    for i, name in enumerate(t):
        assert name in got[i]
    assert got[100] == ["mit-grant"] and got[105] == ["mit-grant"]
    assert [got[i] for i in (101, 102, 103, 104)] == [[]] * 4
    with pytest.raises(ValueError):
        licenses.scan(frame(spark, rows), {"short": "too short"})
    assert licenses.scan(frame(spark, [])).count() == 0


def test_license_hashes_are_those_of_sql(spark):
    row = spark.range(1).select(F.xxhash64(F.lit(-5).cast("long"), F.lit(3)), F.xxhash64(F.lit("a b c d e"))).first()
    assert row[0] == licenses.band_hash(-5, 3) and row[1] == licenses._xx_words("a b c d e".split())


def test_license_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: set(r["licenses"]) for r in licenses.scan(docs).collect()}
    for r in docs.collect():
        words = " " + " ".join(licenses.words_of(r["text"])) + " "
        exact = {n for n, t in licenses.TEMPLATES.items() if " " + " ".join(licenses.words_of(t)) + " " in words}
        assert exact <= got[r["doc_id"]]


def plain_licenses(text):
    """Templates with 0.8 of their shingles in some window, every window tried; one row of short ones word for word."""
    w = licenses.words_of(text or "")
    own = [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
    out = set()
    for name, t in licenses.TEMPLATES.items():
        v = licenses.words_of(t)
        if len(v) < 5:
            if f" {' '.join(v)} " in f" {' '.join(w)} ":
                out.add(name)
            continue
        want = {" ".join(v[i : i + 5]) for i in range(len(v) - 4)}
        width, step = max(1, (3 * len(want) + 1) // 2), max(1, len(want) // 2)
        if any(len(want & set(own[a : a + width])) >= 0.8 * len(want) for a in range(0, len(own), step)):
            out.add(name)
    return sorted(out)


def test_licenses_equal_plain_containment(spark):
    """Both ways: nothing missed, nothing found that containment doesn't confirm."""
    import random

    rng, rows = random.Random(3), []
    for i in range(150):
        words = rng.choice(list(licenses.TEMPLATES.values())).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "changed"
        cut = rng.choice([0, 0, 1, 5])
        rows.append((i, "lead in " * rng.randrange(9) + " ".join(words[cut:]) + " and so on" * rng.randrange(9), "s"))
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {i: plain_licenses(t) for i, t, _ in rows}


def test_licenses_under_conditions(spark):
    """A filter, join or grouping on the result neither changes it nor makes the texts be hashed again."""
    found = licenses.op7_licenses(spark, SF)
    want = {r["doc_id"]: r["n_licenses"] for r in found.collect()}
    some = found.where("n_licenses > 0 and not restricted")
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(concat_ws") == 1
    assert found.where("n_licenses > 0").count() == sum(n > 0 for n in want.values())
    assert {r["n_licenses"]: r["count"] for r in found.groupBy("n_licenses").count().collect()} == {n: list(want.values()).count(n) for n in want.values()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert docs.join(found.where("n_licenses > 0"), "doc_id").count() == sum(n > 0 for n in want.values())


# --- sharding ----------------------------------------------------------------------------------------------------


def check_shards(docs, shards=16):
    rows = sharding.shard(docs, shards).collect()
    assert sorted(((r["doc_id"], r["size"]) for r in rows), key=str) == sorted(((r["doc_id"], len((r["text"] or "").encode()) + 1) for r in docs.collect()), key=str)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    return rows


def test_sharding(spark):
    check_shards(edge_docs(spark))
    check_shards(spark.read.parquet(f"{SF}/documents.parquet"))
    check_shards(frame(spark, [(i, "same", "s") for i in range(5000)] + [(i, f"t{i}", "s") for i in range(5000)]))
    assert sharding.shard(frame(spark, [])).count() == 0


def test_growth_moves_few_rows_with_slack(spark):
    docs = frame(spark, [(i, f"text {i}", "s") for i in range(4000)])
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.shard(docs, n, slack=0.25).collect()} for n in (16, 17))
    assert sum(a[i] != b[i] for i in a) < 0.15 * len(a)


# --- models ------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.op9_quality(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    assert got and docs.count() == quality.op9_quality(spark, "/root/testdata/sf0.1").count()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.97


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.op1_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) / len(got) > 0.95


def test_models_on_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(0, 1, 0), (3, None, None), (9, 0, 1), (9, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        w = quality.train(docs, some, F.lit(True))
        assert quality.score(docs, w).count() == docs.count() and quality.drop_rejected(docs, w).columns == docs.columns
        m = toxicity.train(docs, some, F.lit(True))
        assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, m).collect())
    empty = frame(spark, [])
    assert quality.score(empty, quality.train(empty, labels, F.lit(True))).count() == 0
    assert toxicity.score(empty, toxicity.train(empty, labels, F.lit(True))).count() == 0


def maximal_segments(scores):
    """By definition: every run whose proper prefixes and suffixes all have smaller sums than it, maximal."""
    n, good = len(scores), []
    for i in range(n):
        for j in range(i, n):
            s = scores[i : j + 1]
            if all(sum(s[:k]) > 0 for k in range(1, len(s) + 1)) and all(sum(s[k:]) > 0 for k in range(len(s))):
                good.append((i, j))
    return sorted((i, j) for i, j in good if not any((a, b) != (i, j) and a <= i and j <= b for a, b in good))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-3.0, -2.0, -1.0, 1.0, 2.0, 5.0]), max_size=14))
def test_segments_are_all_maximal_ones(scores):
    x = np.array(scores)
    at = np.flatnonzero(x > 0)
    total = np.cumsum(x) if len(x) else x
    got = toxicity.segments(at, x[at], total[at] - x[at])
    assert [(i, j) for i, j, _ in got] == maximal_segments(scores)


# --- suffix dedup ------------------------------------------------------------------------------------------------


def check_repeats(docs, depth=400, **more):
    rows = docs.collect()
    want = sorted((r["doc_id"] or -1, *w) for r, w in zip(rows, brute.repeats([r["text"] for r in rows], depth)))
    got = suffix_dedup.remove_repeats(docs, depth, **more).collect()
    found = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["starts"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got)
    assert found == want
    words = sorted((r["doc_id"] or -1, *w) for r, w in zip(rows, brute.repeated_words([r["text"] for r in rows], more.get("word_depth", 50))))
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_repeated_words"]) for r in got) == words
    return found


def test_repeats_edges(spark):
    docs = edge_docs(spark)
    assert any(r[2] for r in check_repeats(docs))
    check_repeats(docs, group=1)
    check_repeats(docs, depth=40, digit=20, word_depth=8, word_digit=3)
    check_repeats(docs, group=1, word_depth=5, word_digit=5)
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_repeats_of_planted_passages(spark):
    rng = random.Random(8)
    passage = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(300, 1500))) for _ in range(6)]
    texts = []
    for i in range(120):
        text = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(700)))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passage)
            at, cut = rng.randrange(len(p) // 2), rng.randrange(len(text) + 1)
            part = p[at : at + rng.randrange(200, 1200)]
            if rng.random() < 0.4:
                k = rng.randrange(len(part))
                part = part[:k] + "#" + part[k + 1 :]
            text = text[:cut] + part + text[cut:]
        texts.append(text)
    texts += ["a" * 1000, "ab" * 700, "xy " * 500, "xy " * 200]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for more in ({}, {"group": 2}, {"digit": 300}):
        check_repeats(docs, **more)


def test_repeats_of_short_passages_by_words(spark):
    """Passages of over 50 short words, under 400 bytes, are found by words and removed by none."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randrange(51, 70))) for _ in range(12)]
    texts = [" ".join(word() for _ in range(rng.randrange(100, 400))) for _ in range(90)]
    planted = {}
    for i in range(0, 90, 3):
        words, p = texts[i].split(), rng.choice(passages[:10])
        cut = rng.randrange(len(words))
        texts[i] = rng.choice(["\n", "  ", " "]).join([" ".join(words[:cut]), p, " ".join(words[cut:])])
        planted.setdefault(p, []).append(i)
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for more in ({}, {"group": 1}):
        check_repeats(docs, **more)
    found = {r["doc_id"] for r in suffix_dedup.remove_repeats(docs).where("n_repeated_words > 0").collect()}
    assert found == {i for group in planted.values() if len(group) > 1 for i in group}


def test_repeats_table(spark):
    check_repeats(spark.read.parquet(f"{SF}/documents.parquet"))
