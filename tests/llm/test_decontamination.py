import random
import re

from fieldloom.llm import decontamination as D


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())


def shingles(w, width):
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(docs, items, width=5, threshold=0.8):
    out = []
    for d, t in docs:
        for i, u in items:
            w = words(u)
            if not w:
                continue
            n = min(width, len(w))
            own = shingles(w, n)
            shared = len(own & shingles(words(t), n))
            if shared >= threshold * len(own) - 1e-9:
                out.append((d, i, len(own), shared))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 5, 6, 12, 30, 64, 65, 120]))) for k in range(40)]
    docs = [(k, text(rng.choice([0, 2, 50, 400, 3000]))) for k in range(60)]
    for k, (d, t) in enumerate(docs):
        w = t.split()
        item = items[k % 40][1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):  # some words of the planted item change
            item[rng.randrange(len(item))] = "changed"
        at = rng.randint(0, len(w))
        docs[k] = (d, " ".join(w[:at]) + "\n" + " ".join(item).upper() + "\t" + " ".join(w[at:]))
    return docs, items


def search(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, h int, shingle string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, w int")
    return sorted(((r.doc_id, r.item_id, r.item_shingles, r.shared_shingles) for r in D.contained_items(d, b).collect()), key=repr)


def test_no_pair_is_lost(spark):
    docs, items = corpus(4)
    expected = brute(docs, items)
    assert len(expected) > 20
    assert search(spark, docs, items) == expected


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    docs, items = corpus(5)
    assert search(spark, docs, items) == brute(docs, items)


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (None, "x a b c d e f"), (4, "A B"), (5, "q " * 100_000 + "a b c d e f")]
    items = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, " "), (None, "a b"), (4, "a a a a a a a")]
    assert search(spark, docs, items) == brute(docs, items)
    assert search(spark, [], items) == [] and search(spark, docs, []) == []


def test_native_plan(spark):
    docs, items = corpus(6)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    plan = D.contained_items(d, spark.createDataFrame(items, "item_id bigint, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
