"""Language-model scores by online logistic context mixing, beside a word-count base score.

A text is scored as its tokens: lower-cased words, then an end. The base score is that of
smoothed counts of words. The model codes the bytes of the tokens (a space after each word, a
line feed as the end) bit by bit. Hashed-context predictors of several orders each keep counts
of zeros and ones by context and position in the byte; their logits are combined by weights that
a gate selects, by how often the longest predictors have seen the context. The result is refined
adaptively twice: a last stage maps gate and mixed logit to the share of ones that such bits had
when they were predicted, and each token gets the mean of that and of the base under shares that
follow what has served the text's earlier tokens best (the base has one escape for all words that
it does not know, which the bits spell out). The sum over bits is a code length, hence total bits
per byte and a log10 probability.

One pass over every row that is learned from gathers, in each task:
* counts of words, summed by a shuffle, as many as there are words;
* counts of bits in hashed tables, whose pages are merged in a tree of fan-in `FAN`, so that no
  task gets the pages of all tasks;
* gated weights and the last stage, learned online: each chunk of texts is first predicted from
  the counts of the task so far, the weights take Newton steps on what was predicted, and only
  then are its bits counted. Weights are averaged over tasks by the bits they have seen.
What is gathered of words is exact and grows with the corpus: the chance of a whole word is that
of all its bytes after the word so far, a context without end. Word counts are not broadcast, for
they grow: the texts are dealt into blocks of `BLOCK` bytes, the distinct words of each block
fetch their counts by a join, and each block is scored together with its words. The bit tables
are hashed, and their size is a parameter (`TABLE_BITS`, 23 MB as broadcast), so that what every
task holds has a bound: contexts of a larger corpus share slots, and the weights of the
predictors that suffer from that fall, as they learn from it.

Within a chunk of texts most contexts repeat, so everything is computed for distinct contexts
and looked up by position.

Defined results: a null text counts as empty and is the end alone; a null id is learned from;
repeated rows are scored (and learned from) each; a very long text is scored whole, as a chunk of its
own; without any row to learn from every byte is predicted from empty tables; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import stored

#: Bytes before the predicted one that each predictor sees, and the sizes of their tables as powers of two.
ORDERS = (1, 2, 3, 4, 6)
TABLE_BITS = (16, 20, 21, 22, 22)
SLOTS = sum(1 << b for b in TABLE_BITS)
_STARTS = np.cumsum([0, *(1 << b for b in TABLE_BITS)])
#: The gate says how often each of the three longest predictors has seen its context: never, or at least so often.
OFTEN = (1, 3, 16)
GATED = 3
GATES = (len(OFTEN) + 1) ** GATED
#: Steps of the mixed logit in the last stage, their width and reach, and the weight of its prior.
STEP, REACH, TRUST = 8, 12, 8.0
STEPS = 2 * STEP * REACH + 1
PAGE = 1 << 16
#: Bytes of text that are learned from at a time, at first and at most, that are scored at a time, and of a block
#: that is scored with its words.
FIRST, LEARNED, CHUNK, BLOCK = 1 << 20, 16 << 20, 8 << 20, 16 << 20
FAN = 64
#: Contexts and positions that are worked on at a time, and the least curvature of a Newton step.
PART, PIECE, PRIOR = 1 << 14, 1 << 16, 50.0
#: Words that a task counts before it sends what it has.
WORDS = 300_000
END = "\n"
#: What stands before a text, a byte that no text holds.
EDGE = 0xFF

_MIX = np.uint64(0x9E3779B97F4A7C15)
_NODE = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def tokens(text: str | None) -> bytes:
    """Lower-cased words, each with a space after it, then the end."""
    words = (text or "").encode().lower().split()
    return b" ".join([*words, END.encode()])


def positions(texts: list[bytes]) -> np.ndarray:
    """(Bytes before, byte) as an integer, of every position of the texts and of the edges before them."""
    edge = bytes([EDGE]) * max(ORDERS)
    data = edge + b"".join(edge + t for t in texts)
    # every position as the eight bytes that end there, of which the longest order and one count
    key = np.ndarray(len(data) - 7, ">u8", data, strides=(1,)).astype(np.uint64)
    key &= np.uint64((1 << (8 * max(ORDERS) + 8)) - 1)
    return key


def counted_contexts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct integers of the positions, without those of edges, and how often each comes; sorts in place."""
    key.sort()
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    starts, size = np.flatnonzero(new), len(key)
    distinct = key[starts]
    del key, new  # the largest by far
    often = np.diff(starts, append=size)
    inside = bytes_of(distinct) != EDGE
    return distinct[inside], often[inside]


def distinct_contexts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct integers (some may come twice), and for each position its number among them.

    Positions are sorted by a hash that leaves room for the position itself, and a group ends where
    the integers differ, so equal hashes of different integers do no harm."""
    size = len(key)
    room = max(1, size - 1).bit_length()
    low = np.uint64((1 << room) - 1)
    hashed = np.empty(size, np.uint64)
    for at in range(0, size, PIECE):
        own = key[at : at + PIECE] * _MIX
        own ^= own >> _HALF
        own *= _NODE
        own &= ~low
        own |= np.arange(at, at + len(own), dtype=np.uint64)
        hashed[at : at + PIECE] = own
    hashed.sort()
    found, place, count, last = [], np.empty(size, np.int32), 0, None
    for at in range(0, size, PIECE):
        order = (hashed[at : at + PIECE] & low).astype(np.intp)
        own = np.take(key, order)
        new = np.ones(len(own), bool)
        np.not_equal(own[1:], own[:-1], out=new[1:])
        new[0] = last is None or own[0] != last
        place[order] = np.cumsum(new, dtype=np.int32) + np.int32(count - 1)
        found.append(own[new])
        count, last = count + len(found[-1]), own[-1]
    return np.concatenate(found), place


#: Of each byte, its bits (high first) and the place of each bit among those of its half, given the bits before it.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).T.copy()
_NODES = np.stack([(1 << j % 4) | ((np.arange(256) >> (4 if j < 4 else 0) & 15) >> (4 - j % 4)) for j in range(8)]).astype(np.int32)
_HALVES = (np.uint64(1) + (np.arange(256, dtype=np.uint64) >> np.uint64(4))) * _MIX


def bytes_of(contexts: np.ndarray) -> np.ndarray:
    return contexts.astype(np.uint8)  # the last byte


def slots(contexts: np.ndarray, byte: np.ndarray, k: int) -> np.ndarray:
    """Table positions of the k-th predictor for the eight bits of each context (bit, context).

    The context and the bits before choose a line of 16 slots for each half of the byte."""
    order, lines = ORDERS[k], np.uint64(64 + 4 - TABLE_BITS[k])
    hashed = (contexts >> np.uint64(8)) & np.uint64((1 << (8 * order)) - 1)
    hashed += np.uint64(order << 56)
    hashed *= _MIX
    hashed ^= hashed >> np.uint64(29)
    high = ((hashed * _NODE) >> lines).astype(np.int32) << 4
    hashed += np.take(_HALVES, byte)
    hashed *= _NODE
    low = (hashed >> lines).astype(np.int32) << 4
    out = np.take(_NODES, byte, axis=1, mode="clip")
    out[:4] += high + np.int32(_STARTS[k])
    out[4:] += low + np.int32(_STARTS[k])
    return out


def logits(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4)))


#: A state is how often a slot was seen, as the last of these that it reached, and its logit in 64 levels.
_TIMES = np.array([0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 512, 2048, 8192])
_WIDEST = np.log((np.r_[_TIMES[1:] - 1, 1 << 17] + 0.4) / 0.4)
#: The logit of each state, and the first states that count as seen so often.
_STRETCH = (_WIDEST[:, None] * np.linspace(-1, 1, 64)).astype(np.float32).ravel()
_STRETCH[:64] = 0
_REACHED = [64 * int(np.searchsorted(_TIMES, o)) for o in OFTEN]


def _class(n: np.ndarray, bounds: list[int] | tuple[int, ...]) -> np.ndarray:
    """How many of the bounds are reached."""
    return sum((n >= b).view(np.uint8) for b in bounds)


def states(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """States of slots from their counts of zeros and ones."""
    times = np.searchsorted(_TIMES, n0.astype(np.int64) + n1, "right") - 1
    with np.errstate(invalid="ignore"):
        level = np.nan_to_num((logits(n0.astype(np.float64), n1) / _WIDEST[times] + 1) * 31.5)
    return (times * 64 + np.clip(np.rint(level), 0, 63)).astype(np.uint16)


class Model:
    """The states of all slots, the gated weights, and the counts of the last stage (gate and step, bit)."""

    def __init__(self, state: np.ndarray, weights: np.ndarray, seen: np.ndarray):
        self.state, self.weights = state, weights
        logit = np.tile(np.linspace(-REACH, REACH, STEPS), GATES)
        one = (seen[:, 1] + TRUST * _sigmoid(logit)) / (seen.sum(axis=1) + TRUST)
        self.last = np.log10(np.column_stack([1 - one, one])).astype(np.float32).ravel()
        self.parts = [(weights[:, k : k + 1] * _STRETCH).astype(np.float32).ravel() for k in range(len(ORDERS))]

    def byte_scores(self, contexts: np.ndarray) -> np.ndarray:
        """log10 probability of the byte of each context; zero at an edge."""
        out = np.zeros(len(contexts), np.float32)
        for at in range(0, len(contexts), PART):
            own = contexts[at : at + PART]
            byte = bytes_of(own)
            found = [np.take(self.state, slots(own, byte, k), mode="clip") for k in range(len(ORDERS))]
            gate = np.zeros(found[0].shape, np.uint8)
            for f in found[-GATED:]:
                gate *= np.uint8(len(OFTEN) + 1)
                gate += _class(f, _REACHED)
            gate = gate.astype(np.intp)
            base, z = gate << 10, np.zeros(gate.shape, np.float32)
            for part, f in zip(self.parts, found):
                z += np.take(part, base + f, mode="clip")
            gate *= STEPS
            gate += steps(z)
            gate *= 2
            gate += np.take(_BITS, byte, axis=1, mode="clip")
            out[at : at + PART] = np.where(byte == EDGE, 0, np.take(self.last, gate, mode="clip").sum(axis=0))
        return out


def steps(z: np.ndarray) -> np.ndarray:
    """Mixed logits as steps of the last stage."""
    return (np.rint(np.clip(z, -REACH, REACH) * np.float32(STEP)) + STEP * REACH).astype(np.int32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -15, 15)))


def fit_weights(x: np.ndarray, p: np.ndarray, gate: np.ndarray, bits: np.ndarray, often: np.ndarray, weights: np.ndarray, curvature: np.ndarray) -> None:
    """An online Newton step, a small one, for the weights of each gate; changes both arrays in place."""
    pull, bend = ((bits - p) * often).ravel(), (p * (1 - p) * often).ravel()
    gate = gate.ravel().astype(np.uint8, copy=False)
    order = np.argsort(gate, kind="stable")
    counts = np.bincount(gate, minlength=len(weights))
    rows = np.take(np.reshape(x, (len(x), -1)), order, axis=1, mode="clip")
    pull, bent = pull[order], rows * bend[order]
    ends, used = np.cumsum(counts), np.flatnonzero(counts)
    pulls = np.zeros((len(used), len(x), 1))
    for at, g in enumerate(used):
        own = slice(ends[g] - counts[g], ends[g])
        curvature[g] += bent[:, own] @ rows[:, own].T
        pulls[at, :, 0] = rows[:, own] @ pull[own]
    move = np.linalg.solve(curvature[used] + PRIOR * np.eye(len(ORDERS)), pulls)[:, :, 0]
    weights[used] += np.clip(move, -0.1, 0.1)


def token_scores(scores: np.ndarray, place: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Sums of byte scores by token; a token ends with its space or is the end. data: the byte of each position."""
    ends = (data == 32) | (data == 10)
    return np.add.reduceat(scores[place], np.r_[0, np.flatnonzero(ends)[:-1] + 1], dtype=np.float64)


def base_logs(logs: np.ndarray, norm: float, model: np.ndarray) -> np.ndarray:
    """log10 probability of each token under the base, from log10(count + 1) and its norm.

    Tokens of count 0 share one escape, 1 / norm, which the model spells out, so that the
    probabilities of all tokens sum to at most one."""
    return logs - norm + np.where(logs > 0, 0.0, model)


def refined_scores(model: np.ndarray, base: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each text under the mean of the model and the base.

    Shares start equal and then follow the responsibilities for the tokens before. Texts advance
    together by steps of 32 tokens, or a 64th of a longer text."""
    top = np.maximum(model, base)
    p, q = 10 ** (model - top), 10 ** (base - top)
    share, held = np.full(len(sizes), 16.0), np.full(len(sizes), 32.0)
    step = np.maximum(32, -(-sizes // 64))
    starts = np.cumsum(sizes) - sizes
    out, done = np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)
    live = np.flatnonzero(sizes)
    while len(live):
        n = np.minimum(step[live], sizes[live] - done[live])
        first = np.cumsum(n) - n
        at = np.repeat(starts[live] + done[live] - first, n) + np.arange(n.sum())
        own = np.repeat(share[live] / held[live], n)
        part = p[at] * own
        mean = part + q[at] * (1 - own)
        out[live] += np.add.reduceat(np.log10(mean) + top[at], first)
        share[live] += np.add.reduceat(part / mean, first)
        held[live] += n
        done[live] += n
        live = live[done[live] < sizes[live]]
    return out


def _chunks(texts: Iterator[bytes], first: int = CHUNK, most: int = CHUNK) -> Iterator[list[bytes]]:
    """Texts by `first` bytes, then four times as many each time, up to `most`."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= first:
            yield held
            held, size, first = [], 0, min(most, 4 * first)
    if held:
        yield held


class Learner:
    """Counts, weights and last stage of one task, learned online."""

    def __init__(self):
        self.counts = np.zeros((SLOTS, 2), np.uint32)
        self.weights = np.full((GATES, len(ORDERS)), 0.3)
        self.curvature, self.seen = np.zeros((GATES, len(ORDERS), len(ORDERS))), np.zeros(GATES)
        self.last = np.zeros((GATES * STEPS, 2))

    def add(self, texts: list[bytes]) -> None:
        """Part by part of the distinct contexts: predict, learn weights and the last stage from that, then count."""
        contexts, often = counted_contexts(positions(texts))
        for at in range(0, len(contexts), PART):
            self._learn(contexts[at : at + PART], often[at : at + PART])

    def _learn(self, own: np.ndarray, often: np.ndarray) -> None:
        both = self.counts.view(np.uint64).ravel()
        byte = bytes_of(own)
        bits, gate = np.take(_BITS, byte, axis=1, mode="clip"), np.zeros((8, len(own)), np.uint8)
        x = np.empty((len(ORDERS), 8, len(own)), np.float32)
        places = [slots(own, byte, k).astype(np.intp) for k in range(len(ORDERS))]
        for k, place in enumerate(places):
            pairs = np.take(both, place, mode="clip").view(np.uint32).reshape(8, -1, 2)
            zeros, ones = pairs[..., 0].astype(np.float32), pairs[..., 1].astype(np.float32)
            x[k] = logits(zeros, ones)
            if k >= len(ORDERS) - GATED:
                gate *= np.uint8(len(OFTEN) + 1)
                gate += _class(zeros + ones, OFTEN)
        index, z = gate.astype(np.intp), np.zeros(gate.shape, np.float32)
        for w, v in zip(self.weights.T.astype(np.float32), x):
            z += np.take(w, index, mode="clip") * v
        index *= STEPS
        index += steps(z)
        index *= 2
        index += bits
        part = np.bincount(index.ravel(), np.tile(often.astype(float), 8), self.last.size)
        self.last += part.reshape(-1, 2)
        self.seen += part.reshape(GATES, -1).sum(axis=1)
        fit_weights(x, _sigmoid(z), gate, bits, often.astype(np.float32), self.weights, self.curvature)
        more = (often.astype(np.uint64) << (bits * np.uint64(32))).ravel()  # zeros in the low half, ones in the high
        for place in places:
            np.add.at(both, place.ravel(), more)


def _squeezed(a: np.ndarray) -> bytes:
    return len(a).to_bytes(4, "little") + pa.compress(a.astype(np.uint16).tobytes(), "zstd", asbytes=True)


def _loose(b: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[4:], 2 * int.from_bytes(b[:4], "little"), "zstd", asbytes=True), np.uint16)


def _page(counts: np.ndarray) -> tuple[bytes, bytes, bytes] | None:
    """Steps between used slots and their counts (slot, two), or None if no slot is used."""
    used = np.flatnonzero(counts.any(axis=1))
    if not len(used):
        return None
    own = counts[used].astype(np.int64)
    most = np.maximum(own.max(axis=1, keepdims=True), 65535)
    own = np.where(own > 0, np.maximum(1, own * 65535 // most), 0)
    return _squeezed(np.diff(used, prepend=0)), _squeezed(own[:, 0]), _squeezed(own[:, 1])


_GATHERED = "page int, task int, word string, n bigint, slot binary, zeros binary, ones binary, w double, seen double"


def _gather(schema: pa.Schema):
    """Counts of words (page null), weights (page -1, task their number), counts of the last stage
    (page -2, likewise) and pages of bit counts of one task."""

    def rows(**columns):
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)

    def counted(words: Counter):
        got = list(words.items())
        words.clear()
        for at in range(0, len(got), 1 << 15):
            part = got[at : at + (1 << 15)]
            yield rows(word=[w.decode() for w, _ in part], n=[c for _, c in part])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, learner = Counter(), Learner()
        for texts in _chunks((tokens(t) for b in batches for t in b.column(0).to_pylist()), FIRST, LEARNED):
            for t in texts:
                words.update(t.split(b" "))  # ends are words of their own
            if len(words) > WORDS:
                yield from counted(words)
            learner.add(texts)
        yield from counted(words)
        gate = np.arange(learner.weights.size) // len(ORDERS)
        yield rows(page=[-1] * len(gate), task=list(range(len(gate))), w=(learner.weights.ravel() * learner.seen[gate]).tolist(), seen=learner.seen[gate].tolist())
        used = np.flatnonzero(learner.last.any(axis=1))
        yield rows(page=[-2] * len(used), task=used.tolist(), w=learner.last[used, 0].tolist(), seen=learner.last[used, 1].tolist())
        task = TaskContext.get().partitionId()
        for page in range(SLOTS // PAGE):
            if part := _page(learner.counts[page * PAGE : (page + 1) * PAGE]):
                yield rows(page=[page], task=[task], slot=[part[0]], zeros=[part[1]], ones=[part[2]])

    return run


def _merge_pages(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum up to FAN pages; counts over 65535 are scaled down."""
    total = np.zeros((PAGE, 2), np.int64)
    for frame in frames:
        for slot, zeros, ones in zip(frame["slot"], frame["zeros"], frame["ones"]):
            at = np.cumsum(_loose(slot), dtype=np.int64)
            total[at, 0] += _loose(zeros)
            total[at, 1] += _loose(ones)
    slot, zeros, ones = _page(total)
    yield pd.DataFrame({"page": [key[0]], "task": [key[1]], "slot": [slot], "zeros": [zeros], "ones": [ones]})


def bit_states(gathered: DataFrame) -> np.ndarray:
    """Merge the pages of all tasks in a tree and keep the states of all slots on the driver (2 bytes a slot)."""
    pages = gathered.where("page >= 0").select("page", "task", "slot", "zeros", "ones")
    tasks = (pages.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        tasks = -(-tasks // FAN)
        pages = pages.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("page", "task").applyInPandas(_merge_pages, pages.schema)
        if tasks <= 1:
            break
        pages = stored(pages, "lm-pages")
    state = np.zeros(SLOTS, np.uint16)
    for r in pages.toLocalIterator():
        at = r.page * PAGE + np.cumsum(_loose(r.slot), dtype=np.int64)
        state[at] = states(_loose(r.zeros), _loose(r.ones))
    return state


def gated_weights(gathered: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights by gate and order, averaged over tasks by the bits that they have seen, and the
    counts of the last stage summed over tasks."""
    weights, last = np.full(GATES * len(ORDERS), 0.3), np.zeros((GATES * STEPS, 2))
    sums = gathered.where("page < 0").groupBy("page", "task").agg(F.sum("w").alias("w"), F.sum("seen").alias("seen"))
    for r in sums.collect():  # GATES x ORDERS and GATES x STEPS numbers at most
        if r.page == -2:
            last[r.task] = r.w, r.seen
        elif r.seen > 0:
            weights[r.task] = r.w / r.seen
    return weights.reshape(GATES, len(ORDERS)), last


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Number the texts of a task by running size; a task that runs again gives the same numbers."""
    first, size = TaskContext.get().partitionId() << 24, 0
    for batch in batches:
        numbers = []
        for n in batch.column(batch.num_columns - 1).cast(pa.binary()):
            numbers.append(first + size // BLOCK)
            size += len(n.as_py() or b"")
        yield batch, numbers


def _block_texts(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, numbers in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *batch.columns], schema=schema)

    return run


def _block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, words = None, set()

    def sent():
        got = [w.decode() for w in words]
        for at in range(0, len(got), 1 << 16):
            part = got[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int64()), pa.array(part, pa.string())], names=["block", "word"])

    for batch, numbers in _blocks(batches):
        for number, text in zip(numbers, batch.column(batch.num_columns - 1).to_pylist()):
            if number != block:
                if block is not None:
                    yield from sent()
                block, words = number, {END.encode()}
            words.update((text or "").encode().lower().split())
    if block is not None:
        yield from sent()


def _score(model, total: int, distinct: int, schema: pa.Schema):
    norm = np.log10(total + distinct + 1)

    def base(chunk: list[bytes], known: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([t.count(b" ") + 1 for t in chunk])  # ends are words of their own
        logs = chain.from_iterable(map(known.get, t.split(b" "), repeat(0.0)) for t in chunk)
        return np.fromiter(logs, float, sizes.sum()), sizes

    def spelled(chunk: list[bytes]) -> np.ndarray:
        key = positions(chunk)
        data = bytes_of(key)
        contexts, place = distinct_contexts(key)
        del key
        return token_scores(model.value.byte_scores(contexts), place, data)

    def scored(chunk: list[bytes], known: dict[bytes, float]) -> list[np.ndarray]:
        """n_tokens, n_known, base_score, score, n_bytes; what is large goes before the next chunk is begun."""
        logs, sizes = base(chunk, known)
        starts, own = np.cumsum(sizes) - sizes, spelled(chunk)
        summed = np.add.reduceat(logs, starts) - sizes * norm
        return [sizes, np.add.reduceat(logs > 0, starts, dtype=np.int64), summed, refined_scores(own, base_logs(logs, norm, own), sizes), np.array([len(t) for t in chunk])]

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        known = dict(zip((w.encode() for w in words.column("word").to_pylist()), np.log10(words.column("n").to_numpy() + 1.0).tolist()))
        parts = [scored(chunk, known) for chunk in _chunks(tokens(t.as_py()) for t in texts.column(texts.num_columns - 1))]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        new = [pa.array(np.concatenate(p), kind) for p, kind in zip(zip(*parts), kinds)]
        return pa.Table.from_arrays([*[texts.column(c) for c in texts.column_names[1:-1]], *new], schema=schema)

    return run


def score_texts(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte and the carried columns.

    `learn` is a condition on `doc_id` for the rows to learn from."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"carry_{c}") for c in carry], F.col(text_col).cast("string").alias("body"),
    )
    learned = rows.where(learn).select("body")
    form = spark.createDataFrame([], _GATHERED).schema
    gathered = stored(learned.mapInArrow(_gather(to_arrow_schema(form)), form), "lm-gathered")
    words = stored(gathered.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    model = spark.sparkContext.broadcast(Model(bit_states(gathered), *gated_weights(gathered)))  # 2 bytes a slot
    numbered = T.StructType([T.StructField("block", T.LongType()), *rows.schema.fields])
    texts = rows.mapInArrow(_block_texts(to_arrow_schema(numbered)), numbered)
    per_block = rows.select("body").mapInArrow(_block_words, "block bigint, word string")
    per_block = per_block.join(words.hint("shuffle_hash"), "word").select("block", "word", "n")
    fields = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("n_bytes", T.LongType())]
    out = T.StructType([*rows.drop("body").schema.fields, *[T.StructField(*f) for f in fields]])
    scored = texts.groupBy("block").cogroup(per_block.groupBy("block")).applyInArrow(_score(model, total, distinct, to_arrow_schema(out)), out)
    scored = stored(scored, "lm-scores").withColumn("train_tokens", F.lit(total).cast("long"))
    scored = scored.withColumn("bits_per_byte", -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).drop("n_bytes")
    return scored.withColumnsRenamed({f"carry_{c}": c for c in carry})
