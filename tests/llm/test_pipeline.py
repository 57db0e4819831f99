import random
import re

import numpy as np

import corpus_pipeline
from fieldloom.llm import jaccard_dedup as J
from fieldloom.llm import simhash as S
from fieldloom.llm import stages
from fieldloom.llm._common import ROW, with_row

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, target double"


def corpus(tmp_path, spark, n=240):
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(4000)}"
    text = lambda k: " ".join(word() for _ in range(k))
    items = [(k, text(30)) for k in range(10)]
    rows, toxic = [], {}
    for i in range(n):
        t = text(rng.randint(40, 200))
        toxic[i] = int(i % 6 == 0)
        if toxic[i]:
            t += " vile rotten grim words"
        elif i % 11 == 1:
            t = rows[-1][1] + " "
            toxic[i] = toxic[i - 1]
        elif i % 13 == 2:
            t += " " + items[i % 10][1]
        rows.append((i, t, "en", rng.choice(["a", "b", "c", None]), len(t), 1.0))
    rows += [(n, None, None, "a", None, 1.0), (n + 1, "", "en", "b", 0, 1.0), (None, "x" * 300_000, "en", None, 1, 1.0), (3, rows[3][1], "en", "a", 1, 1.0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, toxic, items


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", "", t or "")


def test_stages_one_by_one(spark, tmp_path):
    rows, toxic, items = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    clean = stages.toxicity_stage(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    left = {r.doc_id for r in clean.collect()}
    wrong = [i for i, y in toxic.items() if (i in left) == bool(y)]
    assert len(wrong) <= 0.05 * len(toxic)

    got = stages.exact_dedup_stage(spark, docs, str(tmp_path)).collect()
    assert len(got) == len({normal(r[1]) for r in rows}) == len({normal(r.text) for r in got})

    near = stages.simhash_stage(spark, docs, str(tmp_path)).collect()
    prints = np.array([S.simhash(S.shingle_hashes((t or "").encode(), 3)) for _, t, *_ in rows], np.uint64)
    label = np.arange(len(prints))
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    while ((new := np.where(close, label[None, :], 1 << 60).min(1)) != label).any():
        label = new
    assert len(near) == len(set(label.tolist())) and {r.doc_id for r in near} >= {min(i for i in range(240) if label[i] == x) for x in set(label[:240].tolist())}

    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    leaked = {r[0] for r in rows if any(len(shingles(t) & shingles(r[1] or "")) >= 0.8 * len(shingles(t)) for _, t in items)}
    assert len(leaked) > 5
    assert sorted((r.doc_id for r in stages.decontamination_stage(spark, docs, str(tmp_path)).collect()), key=repr) == sorted((r[0] for r in rows if r[0] not in leaked), key=repr)

    mixed = stages.mixing_stage(spark, docs, str(tmp_path))
    assert mixed.columns == [*docs.columns, "copy", "copies", "size", "source_size", "mix_target", "taken"]
    for source in ("a", "b", "c", None):
        own = [r for r in mixed.collect() if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].mix_target) <= 200


def test_no_near_copy_stays(spark):
    """Copies at a five-word Jaccard of 0.8, in a cluster of many, in a chain, and one just below."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(9000)}"
    rows = []
    for size in (3, 3, 2, 40):
        text = [word() for _ in range(300)]
        rows += [[*text[:k], word(), *text[k + 1 :]] for k in (rng.randrange(300) for _ in range(size))]
    chain = [word() for _ in range(400)]
    rows += [chain[k : k + 300] for k in range(0, 100, 25)]  # neighbours share 271 of 321 shingles
    rows += [[word() for _ in range(300)] for _ in range(40)] + [["a", "b"], ["A", "b"], [], []]
    far = [word() for _ in range(300)]
    rows += [far, [word() for _ in range(50)] + far[50:]]  # 246 of 346
    texts = [" ".join(r) for r in rows]
    sets = [{tuple(r[k : k + 5]) for k in range(max(1, len(r) - 4))} for r in ([w.lower() for w in r] for r in rows)]
    label = list(range(len(sets)))
    close = [[j for j in range(len(sets)) if len(s & sets[j]) >= 0.8 * len(s | sets[j])] for s in sets]
    while (new := [min(label[j] for j in c) for c in close]) != label:
        label = new
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in stages.simhash_stage(spark, docs, "").collect()) == sorted(set(label))
    assert len(set(label)) == 4 + 1 + 40 + 2 + 2


def test_run_applies_all_stages(spark, tmp_path):
    rows, toxic, items = corpus(tmp_path, spark)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 0 < len({r.doc_id for r in got}) < len(rows) and max(r.copies for r in got) <= 2
    assert sum(toxic.get(r.doc_id, 0) for r in got) <= 0.05 * len(got)
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_empty_documents(spark, tmp_path):
    corpus(tmp_path, spark)
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_empty_labels_and_benchmark_take_nothing_away(spark, tmp_path):
    rows, _, _ = corpus(tmp_path, spark, 60)
    none = tmp_path / "none"
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{none}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{none}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    whole = sorted(map(repr, docs.collect()))
    assert sorted(map(repr, stages.decontamination_stage(spark, docs, str(none)).collect())) == whole
    assert sorted(map(repr, stages.toxicity_stage(spark, docs, str(none)).collect())) in (whole, [])


def test_edits_of_one_text_do_not_all_meet(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    start = [f"w{rng.randrange(10**6)}" for _ in range(150)]

    def edited(words, k):
        out = list(words)
        for i in rng.sample(range(len(out)), k):
            out[i] = f"e{rng.randrange(10**6)}"
        return out

    far = [edited(start, rng.randint(7, 10)) for _ in range(200)]
    texts = [edited(start, rng.randint(0, 2)) for _ in range(60)] + far + [edited(f, 1) for f in far[:40]] + [edited(start, rng.randint(4, 6)) for _ in range(40)]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    seen, plain = tmp_path / "pairs", J._verify

    def counted(width, least):
        run = plain(width, least)

        def count(batches):
            for batch in batches:
                with open(seen, "a") as f:
                    f.write(f"{batch.num_rows}\n")
                yield from run([batch])

        return count

    monkeypatch.setattr(J, "_verify", counted)
    numbered = with_row(docs)
    first = J.near_copies(numbered).where("is_first").join(numbered, ROW).select("doc_id")
    got = sorted(r.doc_id for r in first.collect())
    sets = [set(J.shingle_set(" ".join(t), 5).tolist()) for t in texts]
    label = list(range(len(sets)))
    close = [[j for j in range(len(sets)) if len(s & sets[j]) >= 0.8 * len(s | sets[j])] for s in sets]
    while (new := [min(label[j] for j in c) for c in close]) != label:
        label = new
    assert got == sorted(set(label)) and 100 < len(got) < 300
    pairs = sum(map(int, seen.read_text().split()))
    print("pairs verified", pairs)
    assert pairs < 0.35 * len(texts) * (len(texts) - 1) / 2


def test_a_group_of_edits_costs_pairs_in_proportion(spark, tmp_path, monkeypatch):
    """Edits of one text that are mostly far from each other: links as by brute force, few pairs a text, no more of them in a larger group."""
    rng = random.Random(5)
    start = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for _ in range(600):
        out = list(start)
        for i in rng.sample(range(150), rng.randint(0, 8)):
            out[i] = f"e{rng.randrange(10**7)}"
        texts.append(" ".join(out))
    met, whole = [], type(spark.range(1)).distinct

    def distinct(frame):
        if frame.columns == ["a", "b", "ra", "rb"]:
            met[-1] += frame.count()
        return whole(frame)

    monkeypatch.setattr(type(spark.range(1)), "distinct", distinct)
    for n in (150, 600):
        met.append(0)
        numbered = with_row(spark.createDataFrame([(i, t) for i, t in enumerate(texts[:n])], "doc_id bigint, text string"))
        got = sorted(r.doc_id for r in J.near_copies(numbered).where("is_first").join(numbered, ROW).select("doc_id").collect())
        sets = [J.shingle_set(t, 5) for t in texts[:n]]
        u, at = np.unique(np.concatenate(sets), return_inverse=True)
        held = np.zeros((n, len(u)), np.float32)
        held[np.repeat(np.arange(n), [len(s) for s in sets]), at] = 1
        both, sizes = held @ held.T, held.sum(1)
        close = both >= 0.8 * (sizes[:, None] + sizes[None, :] - both) - 1e-4
        label = np.arange(n)
        while ((new := np.where(close, label[None, :], n).min(1)) != label).any():
            label = new
        assert got == sorted(set(label.tolist())) and 0.2 * n < len(got) < 0.8 * n
    print("pairs met", met)
    assert met[1] < 60 * 600 and met[1] < 8 * met[0]
