import math
import random
import re

import pytest

from fieldloom.llm.mixing import mix_sources, pivotal_round

SCHEMA = "doc_id bigint, text string, source string, size int, h string, target string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, "h", "t") for i, t, s in rows], SCHEMA)


def corpus(n, seed=1, sources=("a", "b", "Z", "é", None)):
    rng = random.Random(seed)
    return [(i, " ".join("w" for _ in range(int(rng.paretovariate(1.1) * 5) % 900)), rng.choice(sources)) for i in range(n)]


def targets(rows, weights=(3, 1, 2), share=1.5, cap=2):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total = share * sum(size.values())
    capped, out = set(), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(cap * size[s] for s in capped)
        level = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        above = {s for s in free if level[s] > cap * size[s]}
        if not above:
            return {**level, **{s: cap * size[s] for s in capped}}, size
        capped |= above
        if len(capped) == len(order):
            return {s: cap * size[s] for s in order}, size


def test_targets_and_totals(spark):
    rows = corpus(700) + [(1000, None, "a"), (1001, "", "b"), (1002, "\t x\n", "b"), (None, "x y", None), (None, "x y", None)]
    got = mix_sources(frame(spark, rows)).collect()
    expected, sizes = targets(rows)
    assert sorted(r.size for r in got) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows)
    for source, target in expected.items():
        own = [r for r in got if r.source == source]
        assert all(math.isclose(r.target, target, rel_tol=1e-9) and r.source_size == sizes[source] for r in own)
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)
        rate = target / sizes[source]
        assert all(math.floor(rate) <= r.copies <= math.ceil(rate) and r.taken == r.copies * r.size <= 2 * r.size for r in own)


def test_runs_agree_whatever_the_partitions(spark):
    df = frame(spark, corpus(300, 2))
    one = sorted((r.doc_id, r.taken) for r in mix_sources(df.coalesce(1)).collect())
    other = sorted((r.doc_id, r.taken) for r in mix_sources(df.repartition(7)).collect())
    assert one == other


def test_expectations_are_kept(spark):
    units = [(g, g * 100 + k, (0.3, 0.75)[k % 2], 1 + (k * 7) % 40, seed) for seed in range(150) for g in (seed,) for k in range(30)]
    df = spark.createDataFrame(units, "g int, h bigint, p double, size bigint, seed int")
    got = pivotal_round(df.selectExpr("g", "h", "p", "size", "p AS p0"), "g", ["p0"], 5)
    rows = got.collect()
    assert len(rows) == len(units)
    for p in (0.3, 0.75):
        own = [r.take for r in rows if r.p0 == p]
        assert abs(sum(own) / len(own) - p) < 0.04
    for g in range(150):
        own = [r for r in rows if r.g == g]
        assert abs(sum(r.take * r.size for r in own) - sum(r.p0 * r.size for r in own)) <= 40


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, " ", "b")], [(1, "one", "a")]])
def test_small_tables(spark, rows):
    got = mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)


def test_repeated_ids_and_carried_columns(spark):
    rows = [(7, "a b c", "s")] * 40
    df = frame(spark, rows)
    got = mix_sources(df, carry=("h",)).collect()
    assert len(got) == 40 and {r.h for r in got} == {"h"} and sum(r.taken for r in got) == 180


def test_native_plan(spark):
    plan = mix_sources(frame(spark, corpus(20)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_rows_without_id_are_told_apart_by_their_texts(spark):
    """A hundred texts without id and of one size: about one and a half times each is taken, not all or none."""
    rows = [(None, f"a b c{k}", "x") for k in range(100)] + [(None, None, "x")] * 20
    got = mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert len(got) == 120 and sum(r.taken for r in got) == 450 and {r.taken for r in got if r.size} == {3, 6}
