import random
import zlib

import numpy as np

from fieldloom.llm import toxicity as T


def corpus(n, seed=1):
    rng = random.Random(seed)
    stems = {"en": ["the", "and", "of"], "de": ["der", "und", "die"]}
    bad = {"en": ["vile", "rotten", "grim"], "de": ["schlimm"]}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de"])
        w = [rng.choice(stems[lang]) if rng.random() < 0.4 else "w" + str(rng.randrange(3000)) for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(2):
                word = rng.choice(bad[lang])
                w.insert(rng.randrange(len(w)), word + (rng.choice(["", "er", "heit", str(rng.randrange(99))]) if lang == "de" else ""))
        rows.append((i, " ".join(w), toxic))
    return rows


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, t, "en", 0.5) for i, t, _ in rows], "doc_id bigint, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    got = T.score_toxicity(docs, T.fit(docs, labels)).collect()
    truth = {i: y for i, _, y in rows}
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    test = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out]
    assert len(test) > 200 and np.mean([p == y for p, y in test]) > 0.95
    hits = sum(p and y for p, y in test)
    assert hits / sum(y for _, y in test) > 0.85


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = corpus(200, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    one = T.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"))
    other = T.fit(docs, spark.createDataFrame([(i, 1 - y if held_out(i) else y) for i, _, y in rows], "doc_id bigint, toxic int"))
    assert (one.dense == other.dense).all() and (one.thresholds == other.thresholds).all()


def test_edge_cases(spark):
    rows = corpus(120, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (7000, ""), (7001, " \n"), (7002, "vile " * 150_000), (7002, "vile")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (7000, 1), (1, 1)], "doc_id bigint, toxic int")
    got = T.score_toxicity(docs, T.fit(docs, labels)).collect()
    assert len(got) == 125 and all(0 <= r.score <= 1 for r in got)
    for model in (T.fit(docs, labels.limit(0)), T.fit(docs, labels.where("toxic = 0"))):
        assert len({r.score for r in T.score_toxicity(docs, model).collect()}) == 1
    assert T.score_toxicity(docs.limit(0), T.TextCNN.fresh()).count() == 0


def test_long_text_in_parts_equals_whole(monkeypatch):
    model, words = T.TextCNN.fresh(3), T.Words()
    rng = random.Random(1)
    rows = [words(" ".join(f"w{rng.randrange(500)}" for _ in range(n))) for n in (0, 1, 2, 999, 5)]
    whole = model.logits(rows, words)
    monkeypatch.setattr(T, "CHUNK", 7)
    assert np.allclose(model.logits(rows, words), whole, atol=1e-5)


def slow_logit(model, words):
    """One text word by word: hashed parts, windows, maxima, linear layer."""
    pad = [np.zeros(T.SIZE)] * (max(T.WIDTHS) - 1)
    vectors = [np.mean([model.embedding[zlib.crc32(p.encode()) % (T.BUCKETS - 1) + 1] for p in (w, *(f"<{k}{w[:k]}" for k in (3, 4, 5)), ">" + w[-4:])], axis=0) for w in words]
    total = model.bias
    for n, width in enumerate(T.WIDTHS):
        for f in range(T.FILTERS):
            line = pad[:1] + vectors + pad
            values = [model.biases[n][f] + sum(line[at + k] @ model.filters[n][k][:, f] for k in range(width)) for at in range(len(vectors) + 1)]
            total += max(0.0, max(values)) * model.dense[n * T.FILTERS + f]
    return total


def test_logits_equal_a_slow_version():
    model, words = T.TextCNN.fresh(3), T.Words()
    model.biases = [np.full(T.FILTERS, 0.1, np.float32) for _ in T.WIDTHS]
    texts = ["the vile dog", "one", "a b c d e f g a b", ""]
    got = model.logits([words(t) for t in texts], words)
    assert np.allclose(got, [slow_logit(model, t.split()) for t in texts], atol=1e-4)


def test_gradients_equal_differences():
    model, words = T.TextCNN.fresh(5), T.Words()
    model.biases = [np.full(T.FILTERS, 0.05, np.float32) for _ in T.WIDTHS]
    rows = [words(t) for t in ("the vile dog of", "a quiet house and it", "grim")]
    labels, weight = np.array([1, 0, 1]), np.array([2.0, 1.0, 2.0])

    def loss():
        z = model.logits(rows, words).astype(float)
        return float((weight * (np.log1p(np.exp(z)) - labels * z)).mean())

    grads, d_bias, touched, d_embedding = T.gradients(model, rows, words, labels, weight)
    parameters = [model.dense, *model.filters, *model.biases]
    rng = np.random.default_rng(0)

    def slope(array, place, h=2e-3):
        before = array[place]
        array[place] = before + h
        up = loss()
        array[place] = before - h
        down = loss()
        array[place] = before
        return (up - down) / (2 * h)

    for array, grad in zip(parameters, grads):
        for _ in range(6):
            place = tuple(rng.integers(0, n) for n in array.shape)
            assert abs(slope(array, place) - grad[place]) < 2e-3
    for k in rng.integers(0, len(touched), 12):
        if touched[k]:
            assert abs(slope(model.embedding, (touched[k], 3)) - d_embedding[k, 3]) < 2e-3
    before = model.bias
    model.bias = before + 1e-3
    up = loss()
    model.bias = before - 1e-3
    assert abs((up - loss()) / 2e-3 - d_bias) < 2e-3


def test_repeated_ids_train_alike(spark):
    rows = corpus(200, 6)
    more = [(i, t + " zz") for i, t, _ in rows[:50]] + [(i, None) for i, _, _ in rows[:20]]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    all_ = [(i, t) for i, t, _ in rows] + more
    one, other = (T.fit(spark.createDataFrame(r, "doc_id bigint, text string"), labels) for r in (all_, all_[::-1]))
    assert (one.embedding == other.embedding).all() and one.bias == other.bias
