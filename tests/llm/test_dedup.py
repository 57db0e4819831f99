import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import simhash as S
from fieldloom.llm.exact_dedup import CountingQuotientFilter, exact_dedup

SCHEMA = "doc_id bigint, text string, fp int, kept string, __rowx int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)


def brute_exact(rows):
    def norm(t):
        return (t or "").translate({c: None for c in (32, 9, 10, 11, 12, 13)})

    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        out.append((i, min(g)[3], len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


EDGE = [(1, "a b"), (2, "ab"), (3, "ab  "), (4, None), (5, ""), (6, "\t\n"), (7, "x" * 200_000), (8, "x" * 199_999 + " x"), (None, "é"), (9, "é"), (10, "é "), (None, None), (11, "ab  ")]


def test_exact_dedup_matches_brute_force(spark):
    got = exact_dedup(docs(spark, EDGE)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute_exact(EDGE)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})


def test_repeated_rows_keep_exactly_one(spark):
    got = exact_dedup(docs(spark, [(1, "same")] * 5 + [(2, "same")])).collect()
    assert [r.kept for r in got].count(True) == 1 and {r.group_size for r in got} == {6} and {r.keep_id for r in got} == {1}


def test_empty_tables(spark):
    assert exact_dedup(docs(spark, [])).count() == 0
    assert S.simhash_components(docs(spark, [])).count() == 0


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    import importlib

    from pyspark.sql import functions as F

    module = importlib.import_module("fieldloom.llm.exact_dedup")
    real = F.xxhash64
    monkeypatch.setattr(module.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    try:
        got = exact_dedup(docs(spark, EDGE)).collect()
    finally:
        monkeypatch.setattr(module.F, "xxhash64", real)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute_exact(EDGE)


def test_filter_merges_without_loss():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**64, 5000, np.uint64) for _ in range(2))
    b[:1000] = a[:1000]
    for bits in (1, 6, 12):
        merged = CountingQuotientFilter.build(a, bits).merge(CountingQuotientFilter.build(b, bits))
        values, counts = np.unique(np.concatenate([a, b]), return_counts=True)
        assert (merged.fingerprints() == values).all() and (merged.counts == counts).all()


def test_building_takes_little_more_than_linear_time():
    import time

    import pyarrow as pa

    from fieldloom.llm.exact_dedup import _build, merge_all

    rng = np.random.default_rng(2)

    def seconds(n):
        values = rng.integers(-(2**62), 2**62, n)
        batches = [pa.RecordBatch.from_arrays([pa.array(values[at : at + 1000])], names=["fp"]) for at in range(0, n, 1000)]
        start = time.time()
        rows = sum(len(np.frombuffer(r, np.uint64)) for b in _build(6)(iter(batches)) for r in b.column(1).to_pylist())
        assert rows == n
        return time.time() - start

    assert seconds(800_000) < 8 + 12 * seconds(100_000)
    parts = [rng.integers(0, 500, 100).astype(np.uint64) for _ in range(40)]
    whole = merge_all(CountingQuotientFilter.build(p, 6) for p in parts)
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (whole.fingerprints() == values).all() and (whole.counts == counts).all() and merge_all(iter([])) is None


def test_simhash_of_one_shingle_and_none():
    import xxhash

    assert S.simhash(S.shingle_hashes(b"", 3)) == 0
    assert S.simhash(S.shingle_hashes(b" A b\tC\n", 3)) == xxhash.xxh64_intdigest(b"a b c", 42)
    assert S.simhash(S.shingle_hashes("É x".encode(), 3)) == xxhash.xxh64_intdigest("É x".encode(), 42)


def brute_components(ids, prints):
    label = np.array(ids)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    while True:
        new = np.where(near, label[None, :], np.iinfo(np.int64).max).min(1)
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("limit", [8, 2048])
def test_links_find_all_components(spark, monkeypatch, limit):
    """Chains and dense clusters of close fingerprints, with keys small and over the limit."""
    monkeypatch.setattr(S, "LIMIT", limit)
    rng = random.Random(3)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values |= {rng.getrandbits(64) for _ in range(200)} | {0, 1, 2**64 - 1}
    values = np.array(sorted(values), np.uint64)
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint")
    roots = {r.node: r.root for r in S.components(S.close_links(nodes, len(values)), "a", "b").collect()}
    got = [roots.get(int(v), int(v)) for v in values.view(np.int64)]
    expected = brute_components(values.view(np.int64).tolist(), values)
    pairs = lambda labels: {tuple(np.flatnonzero(np.array(labels) == x)) for x in set(labels)}
    assert pairs(got) == pairs(expected.tolist())


def test_simhash_components_of_documents(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text), (3, text.replace("w7 ", "w8 ")), (9, None), (8, " "), (None, text), (4, "one two"), (2, "ONE\ttwo"), (7, text)]
    got = {(r.doc_id): r for r in S.simhash_components(docs(spark, rows)).collect()}
    assert got[9].fingerprint == "0" * 16 and got[9].component_id == got[8].component_id == 8
    assert got[4].component_id == got[2].component_id == 2
    assert got[5].component_id == got[7].component_id and got[None].component_id == got[5].component_id
    assert sum(r.is_first for r in got.values()) == len({r.component_id for r in got.values()})


SPLITS = {"spark.sql.files.minPartitionNum": "31", "spark.sql.files.maxPartitionBytes": "40k", "spark.sql.files.openCostInBytes": "0"}


@pytest.mark.parametrize("shuffled", [False, True])
def test_rows_keep_their_keys_when_splits_change(spark, tmp_path, shuffled):
    """The operator plans with some splits and the action runs with others, as when cores come or go."""
    from fieldloom.llm import stages
    from fieldloom.llm.decontamination import contained_items

    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [(k, text(20)) for k in range(5)]
    texts = [text(60) + (" " + items[k % 5][1] if k % 9 == 0 else "") for k in range(400)]
    rows = [(k, texts[k % 400] + " " * (k // 400), "en", "ab"[k % 2], 1) for k in range(900)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(6).write.option("parquet.block.size", 16384).parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 0, int("w1 " in rows[k][1])) for k in range(900)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = docs.repartition(7) if shuffled else docs
    made = [stage(spark, docs, str(tmp_path)) for stage in (stages.toxicity_stage, stages.exact_dedup_stage, stages.simhash_stage, stages.decontamination_stage)]
    made += [exact_dedup(docs), contained_items(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))]
    for k, v in SPLITS.items():
        spark.conf.set(k, v)
    try:
        clean, exact, near, apart, all_, found = [m.collect() for m in made]
    finally:
        for k in SPLITS:
            spark.conf.unset(k)
    leaked = {k for k in range(900) if k % 400 % 9 == 0}
    assert len({r.doc_id for r in clean}) == len(clean) > 0
    assert [len({r.text.strip() for r in x}) for x in (exact, near)] == [len(exact), len(near)] == [400, 400]
    assert sorted(r.doc_id for r in apart) == sorted(set(range(900)) - leaked) and sorted(r.doc_id for r in found) == sorted(leaked)
    assert sorted((r.doc_id, r.keep_id % 400, r.group_size) for r in all_) == [(k, k % 400, 3 if k % 400 < 100 else 2) for k in range(900)]


def test_scratch_tables_go(spark):
    import glob

    from fieldloom.llm._common import scratch, shared_dir, stored

    with scratch(spark):
        assert stored(spark.range(3), "gone").count() == 3
    kept = stored(spark.range(3), "stays")
    assert not glob.glob(f"{shared_dir(spark)}/fieldloom/gone-*") and kept.count() == 3


def slow_fingerprint(text, width=3):
    """Bit by bit: a bit is set if more than half of the shingles' hashes have it."""
    import xxhash

    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints_match_a_slow_version(spark):
    rng = random.Random(21)
    texts = [" ".join(rng.choice(["The", "of", "É", "x1", "and", "rare" + str(rng.randrange(30))]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += [None, "", " \t\n", "one", "One two", "a\x0bb\x0cc\rd", "same same same same same", "w " * 50_000, " ".join(f"v{k}" for k in range(30_000))]
    got = {r.doc_id: r.fingerprint for r in S.simhash_components(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {k: f"{slow_fingerprint(t):016x}" for k, t in enumerate(texts)}


def test_small_edge_tables_end_without_rounds(spark, monkeypatch):
    """One task and the rounds give the same components, for plain and for struct nodes; small tables need no exchange but one."""
    from fieldloom.llm import _components as C

    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(150)] + [(7, 7)]
    plain = spark.createDataFrame(edges, "a bigint, b bigint")
    keys = plain.select(*[F.struct((-F.col(c)).alias("row"), F.col(c).alias("at")).alias(c) for c in ("a", "b")])
    for table in (plain, keys):
        found = {}
        for small in (C.SMALL, 0):
            monkeypatch.setattr(C, "SMALL", small)
            result = C.components(table, "a", "b")
            found[small] = {r.node: r.root for r in result.collect()}
            if small:
                assert "Exchange" not in result._jdf.queryExecution().executedPlan().toString()
            monkeypatch.undo()
        assert found[0] == found[C.SMALL] and len(set(found[0].values())) > 1
    assert C.components(plain.where("a = b"), "a", "b").count() == 0
