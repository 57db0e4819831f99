"""Personal data by patterns and a linear-chain conditional random field.

Patterns with checks find the base spans: e-mail addresses, IPv4 addresses, card numbers that
pass Luhn, and international phone numbers. The random field adds spans that patterns miss,
such as addresses written out ("name [at] host [dot] org") and phone numbers without a plus. Its
features are the shapes of a word and its neighbours: letters, digits and signs with run
lengths, digit counts, and a few key words. It is trained by Adam on the exact likelihood, from
a small labelled table that a rule below generates, on the driver, in a few seconds. Decoding
is Viterbi over all sequences of a batch at once.

A sequence is all words of a text, however long; each word is decoded. Added spans that overlap a base
span or fail the check of their kind (an at and a dot, digits, octets, Luhn) are dropped, so base spans stay as they are.

Everything happens inside the scan: no shuffle, and memory is bounded by a batch.

Defined results: a null text counts as empty and has no spans; repeated rows are searched each;
a very long text is searched whole; of labellings that score alike the first stays; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import stored

KINDS = ("email", "ip", "card", "phone")
#: Words, with padding, that are decoded in lockstep; a longer sequence is decoded alone.
GRID = 1 << 19
#: Labels: 0 outside, then begin and inside of each kind.
LABELS = 1 + 2 * len(KINDS)

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Pattern matches per kind, leftmost and not overlapping; matches that fail a check are dropped."""
    spans: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            spans.append((0, start, found.end()))
            last = found.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                spans.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    spans.append((3, m.start(), m.end()))
    return spans


#: Words that announce or spell out personal data.
KEYWORDS = set(
    "at [at] (at) {at} dot [dot] (dot) {dot} punkt point punto arroba arobase tel tel. phone fax call mobile cell email e-mail mail card visa mastercard credit ip host server address "
    "telefon handy téléphone teléfono tarjeta karte carte adresse dirección".split()
)
#: What an added address must hold: an at sign and a dot, or words for them.
_AT = re.compile(r"@|(?<![^\W_])(?:at|arroba|arobase)(?![^\W_])", re.I)
_DOT = re.compile(r"\.|(?<![^\W_])(?:dot|punkt|point|punto)(?![^\W_])", re.I)
_TRIM = "\"'`,;:!?#%&*$<>=…»«."


_PLAIN = ("s=a", "n=0", "n=0,first=x", "dots=0,n=0", "at=False")


def word_features(word: str) -> tuple[str, ...]:
    """What the shape of one word says; words of letters alone, which most are, say the same."""
    ends = word[-1:] in _TRIM
    letters = word[:-1] if ends else word
    if letters.isalpha() and letters.lower() not in KEYWORDS:
        return (*_PLAIN, "end") if ends else _PLAIN
    return _shape_features(word)


@lru_cache(maxsize=200_000)
def _shape_features(word: str) -> tuple[str, ...]:
    bare = word.strip(_TRIM) or word
    lower = bare.lower()
    shape = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 6)}", re.sub(r"[^\W\d_]+", "a", bare))[:24]
    digits = len(_DIGIT.findall(bare))
    count = next(k for k, most in enumerate((0, 2, 4, 6, 9, 11, 15, 19, 1 << 60)) if digits <= most)
    found = [f"s={shape}", f"n={count}", f"n={count},first={bare[0] if not bare[0].isalnum() else 'x'}", f"dots={min(bare.count('.'), 4)},n={count}", f"at={'@' in bare}"]
    if lower in KEYWORDS:
        found.append(f"k={lower}")
    if word[-1:] in _TRIM:
        found.append("end")
    return tuple(found)


def _labelled(seed: int = 11, rows: int = 320) -> list[tuple[list[str], list[int]]]:
    """The labelled table: short word sequences with personal data and look-alikes in them."""
    rng = random.Random(seed)
    common = "the and of is it die der und le la les et que el los de por un with from mail call see page nous wir here".split()
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    top = lambda: rng.choice(["com", "org", "net", "de", "fr", "es", "example"])
    at = lambda: rng.choice(["[at]", "(at)", "{at}", "at", "arroba", "arobase"])
    dot = lambda: rng.choice(["[dot]", "(dot)", "{dot}", "dot", "punkt", "punto", "point"])
    announce = lambda: rng.choice(["tel.", "Tel:", "phone", "call", "mobile:", "Telefon", "fax", "teléfono"])

    def entity():
        """(kind or None, words): what is labelled, and look-alikes that are not."""
        kind = rng.randrange(22)
        if kind < 3:
            b, a = dot(), at()
            if a == "at" and b[0] in "[({":
                b = "dot"
            return 0, [name(), a, name(), b, top()]
        if kind < 4:
            return 0, [f"{name()}{rng.choice(['[at]', '(at)', '{at}'])}{name()}{rng.choice(['.', '[dot]', '(dot)'])}{top()}"]
        if kind < 5:
            return 0, [f"{name()}@{name()}.{top()}"]
        if kind < 6:
            return 3, [f"({d(3)})", f"{d(3)}-{d(4)}"]
        if kind < 7:
            return 3, [f"{d(3)}-{d(3)}-{d(4)}"]
        if kind < 8:
            return 3, [f"+{d(rng.choice([1, 2]))}", f"({d(3)})", f"{d(3)}-{d(4)}"]
        if kind < 9:
            return 3, ["00" + d(2), d(rng.choice([2, 3])), d(rng.choice([6, 7, 8]))]
        if kind < 10:
            return 1, [".".join(d(rng.choice([2, 3])) for _ in range(4))]
        if kind < 11:
            return 1, [rng.choice(["[.]", "(.)"]).join(d(rng.choice([1, 2, 3])) for _ in range(4))]
        if kind < 12:
            return 2, [d(4) for _ in range(4)]
        if kind < 13:
            return 2, [rng.choice([".", "/", "_"]).join(d(4) for _ in range(4))]
        look = rng.randrange(14)
        return None, [
            [d(4)], [d(2)], [d(1)], [f"{d(2)}.{d(2)}.{d(4)}"], [f"{d(4)}-{d(2)}-{d(2)}"], [f"{d(1)}.{d(2)}"], [f"${d(3)}.{d(2)}"], [f"v{d(1)}.{d(1)}.{d(2)}"],
            [rng.choice(["dot", "point"]), name()], [name(), "at", name()], ["".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 32, 40])))], [d(rng.choice([5, 6, 16, 20]))],
            [f"{name()}{d(2)}"], ["@" + name()],
        ][look]

    table = []
    for _ in range(rows):
        words, labels = [], []
        for _ in range(rng.randint(1, 4)):
            # what is labelled may follow directly on something else
            plain = [rng.choice(common) if rng.random() < 0.6 else name() for _ in range(rng.randint(1, 7) if not words or rng.random() < 0.6 else 0)]
            kind, own = entity()
            if kind == 3 and rng.random() < 0.4:
                plain.append(announce())
            tail = rng.choice(["", "", ",", ".", "!!", "###"])
            own = [*own[:-1], own[-1] + tail]
            words += plain + own
            labels += [0] * len(plain) + ([0] * len(own) if kind is None else [1 + 2 * kind] + [2 + 2 * kind] * (len(own) - 1))
        extra = [rng.choice(common) for _ in range(rng.randint(0, 4))]
        table.append((words + extra, labels + [0] * len(extra)))
    return table


def _allowed() -> np.ndarray:
    """0 where a label may follow another, else a large penalty: inside follows its own kind only."""
    out = np.zeros((LABELS, LABELS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = -1e4
        out[[inside - 1, inside], inside] = 0
    return out


_SIDES = ("", "<", ">")


@dataclass
class CRF:
    features: dict[str, int]
    weights: np.ndarray  # feature, label
    moves: np.ndarray  # label, label

    def emissions(self, words: list[str], side: str) -> np.ndarray:
        """Scores that each distinct word gives a position: its own, the one after, or the one before it."""
        kinds: dict[tuple[str, ...], int] = {}
        return self._by_kind([kinds.setdefault(word_features(w), len(kinds)) for w in words], list(kinds), side)

    def _by_kind(self, of: list[int], kinds: list[tuple[str, ...]], side: str) -> np.ndarray:
        """The same for words that are known by their features."""
        out = np.zeros((len(kinds), LABELS))
        for k, found in enumerate(kinds):
            ids = [i for f in found if (i := self.features.get(side + f)) is not None]
            out[k] = self.weights[ids].sum(axis=0)
        return out[of]

    def decode(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """Viterbi labels of every word of all sequences."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(sequences)
        ends = np.cumsum([len(s) for s in sequences])
        filled = [k for k, s in enumerate(sequences) if s]
        for _, part in groupby(filled, key=lambda k: (ends[k] - 1) // GRID):
            own = list(part)
            for k, labels in zip(own, self._labels([sequences[k] for k in own])):
                out[k] = labels
        return out

    def _labels(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """All words are scored, and the best labelling is found where one but 0 can be in it.

        A run of other labels gains at most the sum over its words of `rise`, and `slack`, over the same
        words as 0. A word through which no run has a positive sum is 0 in every best labelling, so what
        lies between such words is searched alone, with its moves from and to 0."""
        number: dict[str, int] = {}
        ids = [np.array([number.setdefault(w, len(number)) for w in s]) for s in sequences]
        kinds: dict[tuple[str, ...], int] = {}
        of = [kinds.setdefault(word_features(w), len(kinds)) for w in number]
        own, after, before = (self._by_kind(of, list(kinds), s) for s in _SIDES)
        scores = [own[i] for i in ids]
        for s, i in zip(scores, ids):
            s[1:] += after[i[:-1]]
            s[:-1] += before[i[1:]]
        moves = self.moves + _allowed()
        others = np.ones(moves.shape, bool)
        others[0, 0] = False
        most = float((moves[others] - moves[0, 0]).max())
        slack = abs(most) + 1e-6
        out, runs, places = [], [], []
        for k, s in enumerate(scores):
            out.append(np.zeros(len(s), np.int8))
            rise = s[:, 1:].max(axis=1) - s[:, 0] + most
            sums = np.r_[0.0, np.cumsum(rise)]
            best = np.maximum.accumulate(sums[:0:-1])[::-1] - np.minimum.accumulate(sums[:-1])  # over all runs through a word
            edge = np.flatnonzero(np.diff(np.r_[False, best > -slack, False]))
            for low, high in edge.reshape(-1, 2).tolist():
                run = s[low:high].copy()
                run[0] += moves[0] if low else _allowed()[0]
                if high < len(s):
                    run[-1] += moves[:, 0]
                runs.append(run)
                places.append((k, low, high))
        order = sorted(range(len(runs)), key=lambda k: len(runs[k]))
        while order:
            first = len(order) - max(1, min(len(order), GRID // len(runs[order[-1]])))
            part, order = order[first:], order[:first]
            for j, labels in zip(part, self._lockstep([runs[j] for j in part])):
                k, low, high = places[j]
                out[k][low:high] = labels
        return out

    def _lockstep(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        sizes = np.array([len(s) for s in scores])
        order = np.argsort(-sizes, kind="stable")
        moves = self.moves + _allowed()
        most = sizes[order[0]]
        grid = np.zeros((len(order), most, LABELS))
        for k, o in enumerate(order):
            grid[k, : sizes[o]] = scores[o]
        best, back = grid[:, 0].copy(), np.zeros((len(order), most, LABELS), np.int8)
        live = np.searchsorted(-sizes[order], -np.arange(most), side="left")  # sequences longer than t
        for t in range(1, most):
            n = live[t]
            step = best[:n, :, None] + moves
            back[:n, t] = step.argmax(axis=1)
            best[:n] = step.max(axis=1) + grid[:n, t]
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(order)
        last = best.argmax(axis=1)
        paths = np.zeros((len(order), most), np.int8)
        for t in range(most - 1, -1, -1):
            n = live[t]
            ending = sizes[order[:n]] == t + 1
            paths[:n, t] = np.where(ending, last[:n], back[np.arange(n), min(t + 1, most - 1), paths[:n, min(t + 1, most - 1)]])
        for k, o in enumerate(order):
            out[o] = paths[k, : sizes[o]]
        return out


def train(table: list[tuple[list[str], list[int]]] | None = None, steps: int = 120, rate: float = 0.2, decay: float = 1e-3) -> CRF:
    """Maximum likelihood by Adam, all sequences in each step by forward and backward sums."""
    table = table or _labelled()
    features: dict[str, int] = {}
    rows, cells, gold = [], [], []
    longest = max(len(w) for w, _ in table)
    for s, (words, labels) in enumerate(table):
        for t in range(len(words)):
            for side, other in zip(_SIDES, (t, t - 1, t + 1)):
                if 0 <= other < len(words):
                    for f in word_features(words[other]):
                        rows.append(features.setdefault(side + f, len(features)))
                        cells.append(s * longest + t)
        gold.append(labels + [0] * (longest - len(labels)))
    rows, cells, gold = np.array(rows), np.array(cells), np.array(gold)
    sizes = np.array([len(w) for w, _ in table])
    mask = np.arange(longest) < sizes[:, None]
    model = CRF(features, np.zeros((len(features), LABELS)), np.zeros((LABELS, LABELS)))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.weights, model.moves)]
    allowed, n = _allowed(), len(table)
    # cells come in order; every feature has a row
    cell_starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    order = np.argsort(rows, kind="stable")
    by_row, row_starts = cells[order], np.flatnonzero(np.r_[True, np.diff(rows[order]) > 0])
    seen = np.zeros((LABELS, LABELS))
    for t in range(1, longest):
        np.add.at(seen, (gold[:, t - 1][mask[:, t]], gold[:, t][mask[:, t]]), 1)
    for step in range(1, steps + 1):
        score = np.zeros((n * longest, LABELS))
        score[cells[cell_starts]] = np.add.reduceat(model.weights[rows], cell_starts)
        score = score.reshape(n, longest, LABELS)
        score[:, 0] += allowed[0]
        moves = model.moves + allowed
        # sums over all labellings, in logarithms
        forward = np.zeros((n, longest, LABELS))
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            x = forward[:, t - 1, :, None] + moves
            top = x.max(axis=1, keepdims=True)
            new = score[:, t] + (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        top = forward[:, -1].max(axis=1)
        total = top + np.log(np.exp(forward[:, -1] - top[:, None]).sum(axis=1))
        backward = np.zeros((n, longest, LABELS))
        pairs = np.zeros((LABELS, LABELS))
        for t in range(longest - 2, -1, -1):
            y = moves + (score[:, t + 1] + backward[:, t + 1])[:, None, :]
            top = y.max(axis=2, keepdims=True)
            new = (top + np.log(np.exp(y - top).sum(axis=2, keepdims=True)))[:, :, 0]
            inner = mask[:, t + 1, None]
            pairs += (np.exp(np.minimum(forward[:, t, :, None] + y - total[:, None, None], 0)) * inner[:, :, None]).sum(axis=0)
            backward[:, t] = np.where(inner, new, 0)
        marginal = np.exp(np.minimum(forward + backward - total[:, None, None], 0)) * mask[:, :, None]
        marginal[np.arange(n)[:, None], np.arange(longest), gold] -= mask
        flat = marginal.reshape(-1, LABELS)
        grad = np.add.reduceat(flat[by_row], row_starts)
        lr = rate * (1 - step / (steps + 1))
        for value, g, (m, v) in ((model.weights, grad / n + decay * model.weights, state[0]), (model.moves, (pairs - seen) / n + decay * model.moves, state[1])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def added_spans(texts: list[str], base: list[list[Span]], model: CRF) -> list[list[Span]]:
    """What the random field finds in each text beside the base spans."""
    labels = model.decode([_WORD.findall(text) for text in texts])
    out: list[list[Span]] = [[] for _ in texts]
    for k, path in enumerate(labels):
        begins = np.flatnonzero(path % 2 == 1).tolist()
        bounds = [m.span() for m in _WORD.finditer(texts[k])] if begins else []
        for t in begins:
            kind, end = int(path[t]) // 2, t + 1
            while end < len(path) and path[end] == 2 + 2 * kind:
                end += 1
            a, b = bounds[t][0], bounds[end - 1][1]
            word = texts[k][a:b]
            a += len(word) - len(word.lstrip(_TRIM))
            b -= len(word) - len(word.rstrip(_TRIM))
            if a < b and plausible(kind, texts[k][a:b]) and not any(a < e and s < b for _, s, e in base[k]):
                out[k].append((kind, a, b))
    return out


def plausible(kind: int, found: str) -> bool:
    """Whether an added span holds what its kind needs."""
    digits = _DIGIT.findall(found)
    if kind == 0:
        return any(c.isalpha() for c in found) and bool(_AT.search(found) and _DOT.search(found))
    if kind == 1:
        parts = re.findall(r"[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn("".join(digits))
    return 7 <= len(digits) <= 15


def digest(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _find(model, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            base = [base_spans(t) for t in texts]
            added = added_spans(texts, base, model.value)
            spans = [
                [{"kind": KINDS[k], "start": a, "end": e, "base": own is b} for own in (b, x) for k, a, e in own] for b, x in zip(base, added)
            ]
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            hashes = pa.array([hashlib.sha256(digest(b).encode()).hexdigest() for b in base])
            shown = pa.array([digest(b + x) for b, x in zip(base, added)], pa.string())
            listed = pa.array(spans, schema.field(schema.get_field_index("found")).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts, hashes, shown, listed], schema=schema)

    return run


def find_pii(docs: DataFrame, model: CRF | None = None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256,
    spans, `found` (all spans as structs of kind, start, end and base) and the carried columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train())
    base = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"carry_{c}") for c in carry], F.col(text_col).cast("string").alias("body"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
    new = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("found", T.ArrayType(span))]
    schema = T.StructType([*base.drop("body").schema.fields, *new])
    found = stored(base.mapInArrow(_find(shared, to_arrow_schema(schema)), schema), "pii")
    return found.withColumnsRenamed({f"carry_{c}": c for c in carry})
