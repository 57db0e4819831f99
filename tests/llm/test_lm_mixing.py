import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import lm_mixing as L


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def kept_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def corpus(n, seed=1):
    rng = random.Random(seed)
    parts = ["th", "er", "in", "an", "re", "ed", "ou", "st", "ti", "on"]
    return [(i, " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 150))).title()) for i in range(n)]


def brute_base(rows):
    tokens = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in rows]
    c = Counter(w for i, ws in tokens if not held_out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return n, [(i, len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens]


def test_base_scores_and_code_lengths(spark):
    rows = corpus(400) + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "É É x" * 5000), (None, "no id"), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id bigint, text string, score double")
    got = L.score_texts(df, ~kept_out()).collect()
    total, expected = brute_base(rows)
    key = lambda x: repr((x[0], x[1], x[2], round(x[3], 6)))
    assert sorted(map(key, [(r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got])) == sorted(map(key, expected))
    assert all(r.train_tokens == total and r.score < 0 and r.bits_per_byte > 0 for r in got)
    test = [r for r in got if held_out(r.doc_id) and r.n_tokens > 20 and r.doc_id < 400]
    assert len(test) > 20 and np.mean([r.bits_per_byte for r in test]) < 2.2
    assert sum(r.score for r in test) > sum(r.base_score for r in test)


def random_model(seed=0):
    rng = np.random.default_rng(seed)
    state = np.zeros(L.SLOTS, np.uint16)
    state[rng.integers(0, L.SLOTS, 4 << 20)] = rng.integers(0, 1024, 4 << 20)
    seen = rng.integers(0, 500, (L.GATES * L.STEPS, 2)).astype(float)
    return L.Model(state, rng.normal(0.3, 0.1, (L.GATES, len(L.ORDERS))), seen)


def test_probabilities_of_all_bytes_sum_to_one():
    model = random_model()
    for before in (0x616263646566, 0xFFFFFFFFFFFF, 0):
        contexts = np.array([(before << 8) | b for b in range(255)], np.uint64)
        total = (10 ** model.byte_scores(contexts).astype(float)).sum()
        # the edge is no byte of a text: its share is the only one missing
        assert 0.5 < total <= 1 + 1e-5
    assert model.byte_scores(np.array([0x6162636465FF], np.uint64)).tolist() == [0]


def slow_slots(before, byte, k):
    """The eight slots of a byte with whole numbers of Python."""
    cut = (1 << 64) - 1
    mix, node_mix = int(L._MIX), int(L._NODE)
    h = (int.from_bytes(before[-L.ORDERS[k] :], "big") + (L.ORDERS[k] << 56)) * mix & cut
    h ^= h >> 29
    out, node = [], 1
    for j in range(8):
        if j == 4:
            h, node = (h + (1 + (byte >> 4)) * mix) & cut, 1
        line = (h * node_mix & cut) >> (64 + 4 - L.TABLE_BITS[k])
        out.append(sum(1 << b for b in L.TABLE_BITS[:k]) + line * 16 + node)
        node = node * 2 | byte >> 7 - j & 1
    return out


def slow_score(model, text):
    """A text bit by bit."""
    data, total = b"\xff" * 6 + text, 0.0
    for at in range(6, len(data)):
        places = [slow_slots(data[at - 6 : at], data[at], k) for k in range(len(L.ORDERS))]
        for j in range(8):
            found = [int(model.state[p[j]]) for p in places]
            times = [L._TIMES[f // 64] for f in found]
            gate = 0
            for n in times[-L.GATED :]:
                gate = gate * 4 + sum(n >= o for o in L.OFTEN)
            z = sum(np.float32(model.weights[gate, k] * L._STRETCH[f]) for k, f in enumerate(found))
            z = int(np.rint(np.clip(z, -L.REACH, L.REACH) * L.STEP)) + L.STEP * L.REACH
            total += model.last[(gate * L.STEPS + z) * 2 + (data[at] >> 7 - j & 1)]
    return total


def test_scores_equal_a_slow_version():
    model = random_model(4)
    texts = [L.tokens("Some text, som\u00e9 text"), L.tokens(None), L.tokens("a\0b some \u4e2d\u6587 text text")]
    key = L.positions(texts)
    contexts, place = L.distinct_contexts(key)
    got = L.token_scores(model.byte_scores(contexts), place, L.bytes_of(key))
    sizes = [t.count(b" ") + 1 for t in texts]
    sums = np.add.reduceat(got, np.cumsum([0, *sizes[:-1]]))
    assert len(got) == sum(sizes) and np.allclose(sums, [slow_score(model, t) for t in texts], rtol=1e-4)


def test_learned_counts_equal_a_slow_version():
    rng = random.Random(2)
    texts = [L.tokens(" ".join(rng.choice(["the", "then", "there", "of"]) for _ in range(40))) for _ in range(5)]
    learner = L.Learner()
    learner.add(texts[:3])
    learner.add(texts[3:])
    expected = Counter()
    for t in texts:
        data = b"\xff" * 6 + t
        for at in range(6, len(data)):
            for k in range(len(L.ORDERS)):
                expected.update((p, data[at] >> 7 - j & 1) for j, p in enumerate(slow_slots(data[at - 6 : at], data[at], k)))
    assert {(int(a), int(b)): int(learner.counts[a, b]) for a, b in zip(*np.nonzero(learner.counts))} == dict(expected)
    assert learner.last.sum() == learner.seen.sum() == 8 * sum(map(len, texts))


def test_distinct_contexts_survive_equal_hashes(monkeypatch):
    rng = np.random.default_rng(3)
    key = rng.integers(0, 50, 3000).astype(np.uint64)
    for mix in (L._MIX, np.uint64(1 << 63)):  # the second gives two hashes to all
        monkeypatch.setattr(L, "_MIX", mix)
        contexts, place = L.distinct_contexts(key)
        assert (contexts[place] == key).all()
    contexts, often = L.counted_contexts(key.copy())
    assert contexts.tolist() == np.unique(key).tolist() and (often == np.unique(key, return_counts=True)[1]).all()


def test_states_keep_counts_nearly():
    n0, n1 = (x.ravel() for x in np.meshgrid(np.arange(200), np.arange(200)))
    off = np.abs(L._STRETCH[L.states(n0, n1)] - L.logits(n0.astype(float), n1.astype(float)))
    assert off.max() < 0.12 and L.states(np.array([0]), np.array([0]))[0] // 64 == 0


def test_refinement_is_sequential():
    """Token by token: shares of a step depend on the steps before alone."""
    rng = np.random.default_rng(5)
    sizes = np.array([1, 40, 200])
    model, base = -rng.random(241) * 3, -rng.random(241) * 3
    expected, at = [], 0
    for n in sizes:
        share, total = 32 * np.array([0.5, 0.5]), 0.0
        for t in range(0, n, 32):
            p = 10 ** np.column_stack([model, base])[at + t : at + min(n, t + 32)]
            parts = p * share / share.sum()
            total += np.log10(parts.sum(axis=1)).sum()
            share = share + (parts / parts.sum(axis=1, keepdims=True)).sum(axis=0)
        expected.append(total)
        at += n
    assert np.allclose(L.refined_scores(model, base, sizes), expected)


def test_token_scores_by_hand():
    chunk = [L.tokens("ab c"), L.tokens(None)]
    assert chunk == [b"ab c \n", b"\n"]
    data = np.frombuffer(b"\xff" * 5 + chunk[0] + b"\xff" * 6 + chunk[1], np.uint8)
    score = np.where(data == 0xFF, 0.0, np.arange(len(data)))
    assert L.token_scores(score, np.arange(len(data)), data).tolist() == [5 + 6 + 7, 8 + 9, 10, 17]


def test_longest_context():
    """The last predictor tells the sixth byte before apart."""
    contexts = np.array([(b << 56 - 8) | 0x6263646566 << 8 | 0x67 for b in (0x61, 0x7A)], np.uint64)
    found = L.slots(contexts, L.bytes_of(contexts), len(L.ORDERS) - 1)
    assert (found[:, 0] != found[:, 1]).all()


def test_token_probabilities_sum_to_at_most_one():
    """Over 3 known and 997 unknown tokens, under the base and under the mixture."""
    rng = np.random.default_rng(6)
    model = rng.random(1000)
    model = np.log10(model / model.sum())
    counts = np.r_[[4, 2, 1], np.zeros(997)]
    base = L.base_logs(np.log10(counts + 1), np.log10(counts.sum() + 3 + 1), model)
    assert np.allclose(10 ** base[:3], (counts[:3] + 1) / 11)
    assert (10**base).sum() <= 1 + 1e-9
    assert (10 ** L.refined_scores(model, base, np.ones(1000, np.int64))).sum() <= 1 + 1e-9


def test_pages_merge_without_loss():
    import pandas as pd

    rng = np.random.default_rng(2)
    whole, frames = np.zeros((L.PAGE, 2), np.int64), []
    for _ in range(5):
        part = np.zeros((L.PAGE, 2), np.uint32)
        part[rng.choice(L.PAGE, 500, replace=False)] = rng.integers(0, 900, (500, 2))
        whole += part
        frames.append(dict(zip(("slot", "zeros", "ones"), L._page(part))) | {"page": 3, "task": 0})
    (out,) = L._merge_pages((3, 0), iter([pd.DataFrame(frames[:2]), pd.DataFrame(frames[2:])]))
    at = np.cumsum(L._loose(out["slot"][0]), dtype=np.int64)
    assert (L._loose(out["zeros"][0]) == whole[at, 0]).all() and (L._loose(out["ones"][0]) == whole[at, 1]).all()
    assert len(at) == whole.any(axis=1).sum()


def test_held_out_texts_are_not_learned(spark):
    rows = corpus(60, 3)
    changed = [(i, "zz qq" if held_out(i) and i % 2 else t) for i, t in rows]
    score = lambda rs: {r.doc_id: (r.score, r.base_score) for r in L.score_texts(spark.createDataFrame(rs, "doc_id bigint, text string"), ~kept_out()).collect()}
    one, other = score(rows), score(changed)
    assert all(np.allclose(one[i], other[i]) for i, t in changed if dict(rows)[i] == t)


def test_empty_and_nothing_to_learn(spark):
    df = spark.createDataFrame([(2, "some text")], "doc_id bigint, text string")
    assert L.score_texts(df.limit(0), ~kept_out()).count() == 0
    (r,) = L.score_texts(df, F.lit(False)).collect()
    assert r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and r.score < 0


def _peak(run):
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_contexts_are_found_in_little_memory():
    """Bytes for each position beyond the positions themselves; the executors' memory follows them."""
    rng = np.random.default_rng(4)
    key = L.positions([b"".join(rng.choice([b"the ", b"of ", b"word ", b"corpus "], 400_000).tolist())])
    assert _peak(lambda: L.distinct_contexts(key)) < 16 * len(key)
    assert _peak(lambda: L.counted_contexts(key)) < 16 * len(key)


def test_newton_steps_match_gate_by_gate():
    rng = np.random.default_rng(9)
    n, orders = 500, len(L.ORDERS)
    x, p, often = rng.normal(size=(orders, 8, n)), rng.random((8, n)), rng.integers(1, 9, n).astype(float)
    gate, bits = rng.integers(0, 5, (8, n)), rng.integers(0, 2, (8, n))
    weights, curvature = np.full((L.GATES, orders), 0.3), np.zeros((L.GATES, orders, orders))
    L.fit_weights(x, p, gate, bits, often, weights, curvature)
    for g in range(L.GATES):
        own = gate == g
        v, w = x[:, own], (np.broadcast_to(often, own.shape) * p * (1 - p))[own]
        pull = v @ ((bits - p) * often)[own]
        assert np.allclose(curvature[g], (v * w) @ v.T)
        assert np.allclose(weights[g], 0.3 + np.clip(np.linalg.solve((v * w) @ v.T + L.PRIOR * np.eye(orders), pull), -0.1, 0.1))
