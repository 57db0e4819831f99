import hashlib
import random
import re
from itertools import product

import numpy as np
import pytest

from fieldloom.llm import pii_crf as P

MODEL = P.train()


def plain_base(text):
    """The contract's patterns, by plain regular expressions."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[ -]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return out


def test_base_spans_match_plain_patterns():
    rng = random.Random(1)
    pieces = ["a@b.c", "@", ".", "a.b+c@x-y.z.w", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+", "12", " ", "-", "é", "x", "\n", "0001.2.3.255", "@d.e", "1.2.3.4.5.6.7.8"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        assert P.base_spans(text) == plain_base(text), text


def test_viterbi_matches_enumeration():
    words = ["call", "(743)", "555-3824", "at", "x"]
    for n in range(1, 5):
        sequence = words[:n]
        scores = []
        for labels in product(range(P.LABELS), repeat=n):
            total = P._allowed()[0][labels[0]]
            for t, y in enumerate(labels):
                own = [(P._SIDES[0], sequence[t])] + ([(P._SIDES[1], sequence[t - 1])] if t else []) + ([(P._SIDES[2], sequence[t + 1])] if t + 1 < n else [])
                total += sum(MODEL.emissions([w], side)[0][y] for side, w in own)
                if t:
                    total += (MODEL.moves + P._allowed())[labels[t - 1], y]
            scores.append((total, labels))
        assert tuple(MODEL.decode([sequence, ["pad"] * 7])[0]) == max(scores)[1]


def test_accuracy_on_unseen_sequences():
    table = P._labelled(seed=77, rows=200)
    found = MODEL.decode([w for w, _ in table])
    assert np.mean([a == b for (_, ls), p in zip(table, found) for a, b in zip(ls, p)]) > 0.98


def test_added_spans():
    text = "write to john [at] example [dot] com or call (743) 555-3824, not on 2024-05-01 at noon"
    spans = P.added_spans([text], [P.base_spans(text)], MODEL)[0]
    assert [(P.KINDS[k], text[a:b]) for k, a, b in spans] == [("email", "john [at] example [dot] com"), ("phone", "(743) 555-3824")]


def test_operator(spark):
    rows = [(1, "mail a@b.com"), (1, "mail a@b.com"), (2, None), (3, ""), (None, "é 10.0.0.1"), (4, "a" * 300_000 + "@" + "1" * 300_000), (5, "word " * 100_000 + "+49 30 1234567")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, spans string")
    got = P.find_pii(df, MODEL).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id) or ""
        base = plain_base(text) if len(text) < 1000 else P.base_spans(text)
        shown = ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in sorted(base))
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        assert set(filter(None, shown.split(","))) <= set(r.spans.split(",")) and r.spans == ",".join(f"{f.kind}:{f.start}:{f.end}" for f in sorted(r.found, key=lambda f: (P.KINDS.index(f.kind), f.start)))
    assert P.find_pii(df.limit(0), MODEL).count() == 0


#: Labelled by hand, in the style of the documents: {kind:what a reader would mark}; no marks, nothing to find.
SAMPLE = """
avec rerepa oument éreé. Des {phone:+1 (826) 555-4081} {ip:190.137.223.204} du anviou un
en çaux éaiépa un. {phone:+1 (843) 555-7672} {ip:170.106.47.218} Et, ou
und ieachach enßpf zutzau enüerpf {email:die.55@mail4.example.com} tzzu, ie
thon onst {phone:+1 (243) 555-5526} erenouble thoringsh reed
de ciónta {ip:248.167.124.71}*** ciónco raie
the thoroued token = "254ca002228af484f240146ffd26ba4415598ee8" enhast
ueadoos 9807915762804490 raie, esllra
Licensed under CC BY-NC 4.0. See the General Public License, version 3.
write to {email:jane [at] host [dot] org} and wait
schreib an {email:otto at firma punkt de} bitte
escribe a {email:jose arroba correo punto es} hoy
mail {email:lea(at)example.org} or call {phone:(743) 555-3824}, thanks
call {phone:555-867-5309} after {phone:030 1234567} ist besetzt
the server {ip:10.0.0[.]7} is at rest, see page 12 and 2004
erti or the 12.05.2019 and 2019-05-12 for $450.20 and v1.2.30 on it
le {card:4111/1111/1111/1111} est à nous, la 4111/1111/1111/1112 non
dot the line at noon, meet @anna at the point
Handy {phone:0049 151 23456789} oder {email:max.muster@firma.de}
von 1 bis 20, dann 3 4 5 und 600000 sowie 12345
""".strip().splitlines()


def test_spans_of_a_sample_labelled_by_hand():
    found, right, wanted, base_right = 0, 0, 0, 0
    model = P.train()
    for line in SAMPLE:
        text, gold = "", set()
        for plain, kind, marked in re.findall(r"([^{]*)(?:\{(\w+):([^}]*)\})?", line):
            text += plain
            if kind:
                gold.add((P.KINDS.index(kind), len(text), len(text) + len(marked)))
                text += marked
        base = P.base_spans(text)
        got = set(base) | set(P.added_spans([text], [base], model)[0])
        found, right, wanted, base_right = found + len(got), right + len(got & gold), wanted + len(gold), base_right + len(set(base) & gold)
    assert base_right < 0.5 * wanted, "the sample needs more than patterns"
    assert right >= 0.9 * wanted and right >= 0.9 * found, (found, right, wanted, base_right)


@pytest.mark.parametrize("n", [0, 500, 511, 513, 600, 30_000])
def test_long_chains_are_not_cut(n):
    text = "12 " * n + "call (743) 555-3824 now" + " 12" * n
    assert [(k, text[a:b]) for k, a, b in P.added_spans([text], [P.base_spans(text)], MODEL)[0]] == [(3, "(743) 555-3824")]


def test_lockstep_equals_one_by_one():
    rng = random.Random(4)
    words = ["12", "(743)", "555-3824", "call", "x", "jane", "[at]", "host", "[dot]", "org", "1.2.3", "+1"]
    many = [[rng.choice(words) for _ in range(rng.randint(1, 300))] for _ in range(60)]
    for one, all_ in zip((MODEL.decode([s])[0] for s in many), MODEL.decode(many)):
        assert (one == all_).all()


def test_every_word_is_decoded():
    text = "plain words " * 40 + "please write to maria at example point org if you find it " + "plain words " * 40
    found = P.added_spans([text, "", " "], [[], [], []], MODEL)
    assert [text[a:b] for _, a, b in found[0]] == ["maria at example point org"] and found[1:] == [[], []]
    assert P.added_spans(["we met at at that at noon"], [[]], MODEL) == [[]]


def test_pruned_decoding_is_the_best_labelling():
    rng = random.Random(4)
    moves = MODEL.moves + P._allowed()
    words = [w for s, _ in P._labelled(seed=3, rows=40) for w in s] + ["plain", "words", "here"] * 40
    for _ in range(20):
        s = [rng.choice(words) for _ in range(60)]
        own, after, before = (MODEL.emissions(s, side) for side in P._SIDES)
        best, back = own[0] + before[1] + P._allowed()[0], []
        for t in range(1, 60):
            step = best[:, None] + moves
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + own[t] + after[t - 1] + (before[t + 1] if t < 59 else 0)
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert MODEL.decode([s])[0].tolist() == path[::-1]
