"""Operator 1: language-model scores by online logistic context mixing over bits.

A text is its sequence of lower-cased words and one end; each is a token. A token that training texts hold is coded as BITS binary decisions, the
bits of its hash, and then among the tokens of these bits by its share; one that they do not hold is spelled byte by byte, eight decisions each.
Whether a token is a new one is a decision before, by the share of tokens met once. Predictors of each decision are counters of hashed contexts:

- of words: no context; the last two bytes of the token before, hashed to 256, for the first CLASS_BITS decisions; the token before itself
  (none at a text's start), whose hash grows with the corpus, with all that ever followed it;
- of bytes: the one, two and three bytes before within the word, hashed to 4,096 each.

Predictions are mixed as logits by weights that a gate picks: how often the token before was met at this node, whether it was ever followed by both
bits, and how far the decision is in the token. A last stage refines the mixed probability by how often such predictions came true. Every
predictor is antisymmetric in the two bits, so probabilities of a decision sum to one.

All counts are of all training tokens and grow with the corpus. Texts are cut into chunks where they are read; a chunk's distinct tokens and
distinct pairs (context, bits) are sorted, packed and sent to slices, ranges of hashes of bounded size, which add up the counts of all chunks and send
back each chunk's counts and prices. Pairs of a token that is HOT_SHARE of all or more are dealt by their first HOT_BITS bits too, and a table of
at most 1 / HOT_SHARE such tokens holds the counts of these bits. Weights and the last stage are learned online from every training occurrence, each
predicted from the counts without itself before the weights move: contexts are dealt by their hashes to groups of about learn_tokens tokens, each
group learns in the order of its pairs' hashes, and the groups' weights are averaged by how much each gate met, what came true is added up. Those of
bytes are learned so from all distinct training words, in groups of about learn_words. They stay fixed while texts are scored. Groups depend on the
corpus alone, and what they tell are whole numbers, so no result depends on how rows, chunks or slices are dealt.

A null text is an empty one: it is the end alone. Rows are scored each on its own, repeated ones too; a null doc_id counts as not held out. Without
training documents every token is new. No documents give no rows. Words of any length are hashed and spelled whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernel
from tessera.llm.common import Scratch, table

U = np.uint64
BITS, CLASS_BITS, HOT_BITS = 18, 12, 8
HOT_SHARE = 1 / 4096
BYTE_ORDERS, BYTE_SLOTS = 3, 4096
SEEN = np.array([1, 2, 3, 5, 17, 257])  # counts of a node at which the gate changes
FAR = 3  # parts of a token's decisions that have gates of their own
GATES = (len(SEEN) + 1) * 2 * FAR
BINS = 24
PARTS = 16
UNIT = 128  # prices are in parts of a bit
WEIGHT_UNIT = 1 << 16
_K = [kernel.mix(np.array([i], U) * U(0x9E3779B97F4A7C15))[0] | U(1) for i in range(301, 309)]
_START, _END = kernel.mix(np.array(_K[:2], U))


# packed numbers

def pack(numbers: np.ndarray, ascending: bool = False) -> bytes:
    """Unsigned 64-bit numbers as planes of their bytes, compressed; of ascending ones the differences."""
    n = numbers.astype("<u8", copy=False)
    if ascending:
        n = np.diff(n, prepend=U(0))
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(n).view(np.uint8).reshape(-1, 8).T).ravel(), 1)


def unpack(raw: bytes, ascending: bool = False) -> np.ndarray:
    n = np.array(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1).T, order="C").view("<u8").reshape(-1).astype(U, copy=False)
    return np.cumsum(n, dtype=U) if ascending else n


# tokens

def _trained(doc_ids) -> np.ndarray:
    return np.array([d is None or zlib.crc32(str(d).encode()) % 10 != 0 for d in doc_ids.to_pylist()], bool)


@dataclass
class Tokens:
    id: np.ndarray  # 64-bit hash; its first BITS bits code the token
    row: np.ndarray
    begin: np.ndarray
    size: np.ndarray  # bytes, none for an end
    raw: np.ndarray  # lower-cased bytes of the texts


def tokens(column: pa.Array) -> Tokens:
    """All tokens of the texts in order."""
    raw, at = kernel.text_bytes(column)
    h, row, begin, size = kernel.word_spans(raw, at, lower=True)
    n_rows = len(at) - 1
    n_words = np.bincount(row, minlength=n_rows)
    place, total = np.arange(len(h)) + row, len(h) + n_rows
    out = np.full(total, _END, U), np.repeat(np.arange(n_rows), n_words + 1), np.zeros(total, np.int64), np.zeros(total, np.int64)
    for a, b in ((out[0], kernel.mix(h ^ _K[2])), (out[2], begin), (out[3], size)):
        a[place] = b
    return Tokens(*out, kernel._LOWER[raw])


def _classes(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of tokens, by their last two bytes."""
    padded = np.append(raw, np.zeros(1, np.uint8))
    last = np.where(size > 0, padded[begin + np.maximum(size, 1) - 1].astype(U), U(0))
    two = np.where(size > 1, padded[begin + np.maximum(size, 2) - 2].astype(U), U(0))
    return (kernel.mix((two * U(257) + last + U(1)) * _K[3]) >> U(56)).astype(np.int64)


def _contexts(id_: np.ndarray, class_: np.ndarray, bits: int) -> np.ndarray:
    """The context that a token is for the next: its class and a hash of bits - 8 bits; after these, a text's start."""
    own = (class_.astype(U) << U(bits - 8)) | (kernel.mix(id_ + _K[4]) >> U(72 - bits))
    return np.append(own, _START >> U(64 - bits))


def _by_rank(met: np.ndarray) -> np.ndarray:
    """Places of a chunk's distinct tokens, those met most often first, as frequent ones pack best with small numbers."""
    return np.argsort(-met, kind="stable")


def _ranks(met: np.ndarray) -> np.ndarray:
    out = np.empty(len(met), np.int64)
    out[_by_rank(met)] = np.arange(len(met))
    return out


def _pair_keys(contexts: np.ndarray, ids: np.ndarray, t: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(context, bits) of each token. t: each token's place in ids; first: whether it begins a text."""
    out = (contexts << U(BITS))[np.where(first, t.dtype.type(len(ids)), np.append(t[:1], t[:-1]))]
    out |= (ids >> U(64 - BITS))[t]
    return out


def _cut_out(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of some words end to end."""
    ends = np.cumsum(size)
    return raw[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + size, size)]


def _slots(context: np.ndarray, order: int) -> np.ndarray:
    return (kernel.mix(context + U(order)) >> U(52)).astype(np.int64)


_BYTE_K = np.array(_K[5:8], U) * np.array([3, 5, 7], U)
_CONTEXTS_1 = np.arange(257, dtype=U) * _BYTE_K[0]
_CONTEXTS_2 = (_CONTEXTS_1[:, None] + np.arange(257, dtype=U) * _BYTE_K[1]).ravel()
_SLOTS_1, _SLOTS_2 = _slots(_CONTEXTS_1, 1), _slots(_CONTEXTS_2, 2)


def _byte_slots(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, byte, contexts x bytes) of each byte of some words and of the space that ends each."""
    length = size + 1
    ends = np.cumsum(length)
    of = np.repeat(np.arange(len(size)), length)
    byte = _cut_out(np.append(raw, np.zeros(1, np.uint8)), begin, length).astype(np.int64)
    byte[ends - 1] = 32
    before = [(byte + 1).astype(np.int16)]  # and then the bytes 1, 2, 3 before, more by one, 0 where the word has none
    for _ in range(BYTE_ORDERS):
        before.append(np.append(np.int16(0), before[-1][:-1])[: len(of)])
        before[-1][ends - length] = 0
    two = before[1].astype(np.int32) * 257 + before[2]
    return of, byte, np.stack([_SLOTS_1[before[1]], _SLOTS_2[two], _slots(_CONTEXTS_2[two] + before[3].astype(U) * _BYTE_K[2], 3)])


# chunks

CHUNKS = "chunk long, part int, task long, counts binary, doc_id array<long>, n_bytes array<long>, n_tokens array<long>, t binary, ids binary, n binary, met binary, classes binary, new binary, old binary, old_sizes binary, trained long, hot array<long>, hot_context array<long>"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_FIELDS = [(name, _KINDS[kind]) for name, kind in (x.split() for x in CHUNKS.split(", "))]
CLASS_COUNTS, BYTE_COUNTS = 256 << CLASS_BITS, BYTE_ORDERS * BYTE_SLOTS * 256


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(name)], kind) for name, kind in _FIELDS], [name for name, _ in _FIELDS])


def _distinct(id_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens (or pairs), ascending; where one of each is; each token's place among them; how often each is met. As np.unique, in less memory."""
    order = np.argsort(id_)
    ids = id_[order]
    new = np.append(True, ids[1:] != ids[:-1])
    ids = ids[new]
    place = np.cumsum(new, dtype=np.int32 if len(id_) < 1 << 31 else np.int64)
    place -= 1
    t = np.empty_like(place)
    t[order] = place
    return ids, order[new], t, np.diff(np.flatnonzero(new), append=len(id_))


def _word_pieces(size: np.ndarray, limit: int = 1 << 18) -> Iterator[slice]:
    """Ranges of words of about limit bytes together."""
    cuts = np.flatnonzero(np.diff(np.cumsum(size + 1) // limit)) + 1
    ends = [*cuts.tolist(), len(size)]
    return map(slice, [0, *ends[:-1]], ends)


def _chunk(number: int, docs: pa.Table, context_bits: int, counts: np.ndarray) -> pa.RecordBatch:
    """What is told of a chunk of documents; its training tokens are added to counts, of classes and of bytes.

    Of all stages workers took most memory here, so arrays of all tokens are few and small, and go as soon as they have been used.
    """
    text, trained = docs.column("text").combine_chunks(), _trained(docs.column("doc_id"))
    id_, begin, size, raw, learned, first, n_tokens = ([] for _ in range(7))
    done = 0
    for a, b in kernel.by_bytes(text):
        x = tokens(text.slice(a, b - a))
        for into, value in ((id_, x.id), (begin, x.begin + done), (size, x.size), (raw, x.raw), (learned, trained[a:b][x.row]), (first, np.append(True, x.row[1:] != x.row[:-1])), (n_tokens, np.bincount(x.row, minlength=b - a))):
            into.append(value)
        done += len(x.raw)
    del x
    raw, learned, first, n_tokens = map(np.concatenate, (raw, learned, first, n_tokens))
    id_ = np.concatenate(id_)
    ids, where, t, met = _distinct(id_)
    del id_
    begin = np.concatenate(begin)[where]
    size = np.concatenate(size)[where]
    n = np.bincount(t[learned], minlength=len(ids))
    class_ = _classes(raw, begin, size)
    contexts = _contexts(ids, class_, context_bits)
    before = np.where(first, t.dtype.type(len(ids)), np.append(t[:1], t[:-1]))[learned]
    node = (np.append(class_, int(_START >> U(56))) << CLASS_BITS).astype(np.int32)[before]
    node |= (ids >> U(64 - CLASS_BITS)).astype(np.int32)[t[learned]]
    counts[:CLASS_COUNTS] += np.bincount(node, minlength=CLASS_COUNTS)
    del before, node
    known, old = np.flatnonzero((n > 0) & (size > 0)), []
    for at in _word_pieces(size[known]):
        part = known[at]
        old.append(_cut_out(raw, begin[part], size[part]))
        of, byte, slots = _byte_slots(old[-1], np.cumsum(size[part]) - size[part], size[part])
        for k in range(BYTE_ORDERS):
            np.add.at(counts, CLASS_COUNTS + ((k * BYTE_SLOTS + slots[k]) << 8) + byte, n[part][of])
    new = np.flatnonzero((n == 0) & (size > 0))
    spelled = b" ".join(raw[a : a + b].tobytes() for a, b in zip(begin[new].tolist(), size[new].tolist()))
    hot = np.flatnonzero(n >= max(1, HOT_SHARE * int(learned.sum())))  # a token that is hot in all chunks together is so in one at least
    return _row(
        chunk=number, doc_id=docs.column("doc_id").to_pylist(), n_bytes=pc.fill_null(pc.binary_length(text), 0).to_pylist(), n_tokens=n_tokens.tolist(), t=pack(_ranks(met).astype(U)[t]), ids=pack(ids, True), n=pack(n), met=pack(met), classes=pack(class_),
        new=zstandard.compress(spelled, 1), old=zstandard.compress(np.concatenate(old), 1), old_sizes=pack(size[known]), trained=int(learned.sum()), hot=ids[hot].astype(np.int64).tolist(), hot_context=np.where(ids[hot] == _END, contexts[-1], contexts[hot]).astype(np.int64).tolist(),
    )


def _chunks(docs: DataFrame, context_bits: int, chunk_bytes: int) -> DataFrame:
    """CHUNKS of docs (doc_id, text); rows without chunk hold parts of a task's counts of classes and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        counts, number = np.zeros(CLASS_COUNTS + BYTE_COUNTS, np.int64), task << 24
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for a, b in kernel.by_bytes(batch.column("text")):
                held.append(batch.slice(a, b - a))
                size += held[-1].nbytes
                if size >= chunk_bytes:
                    yield _chunk(number, pa.Table.from_batches(held), context_bits, counts)
                    number, size = number + 1, 0
                    held.clear()
        if held:
            yield _chunk(number, pa.Table.from_batches(held), context_bits, counts)
        if counts.any():
            for i, part in enumerate(counts.reshape(PARTS, -1)):
                yield _row(part=i, task=task, counts=pack(part))

    return docs.select("doc_id", "text").mapInArrow(run, CHUNKS)


PAIR_COLUMNS = ["doc_id", "n_tokens", "t", "ids", "met", "classes"]


def _unfolded(one: dict, context_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: its distinct tokens; of each token its place among these, its row and its pair (context, bits)."""
    ids = unpack(one["ids"], True)
    t = unpack(one["t"]).view(np.int64)
    kind = np.int32 if len(t) < 1 << 31 else np.int64
    t = _by_rank(unpack(one["met"]).astype(np.int64)).astype(kind)[t]
    row = np.repeat(np.arange(len(one["n_tokens"]), dtype=kind), one["n_tokens"])
    contexts = _contexts(ids, unpack(one["classes"]).astype(np.int64), context_bits)
    return ids, t, row, _pair_keys(contexts, ids, t, np.append(True, row[1:] != row[:-1]))


def _counted_pairs(one: dict, context_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a chunk: the distinct pairs, ascending, and their training occurrences."""
    _, _, row, key = _unfolded(one, context_bits)
    learned = _trained(pa.array(one["doc_id"], pa.int64()))[row]
    key <<= U(1)
    key |= learned
    key.sort()
    both = key
    starts = np.flatnonzero(np.append(True, (both[1:] >> U(1)) != (both[:-1] >> U(1))))
    return both[starts] >> U(1), np.add.reduceat((both & U(1)).astype(np.int64), starts)


# slices

SLICE = "slice int, chunk long, keys binary, n binary"


def _hot_places(key: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair: the place of its context among the hot ones, and whether it is one."""
    context = key >> U(BITS)
    at = np.searchsorted(hot, context).clip(max=max(len(hot) - 1, 0))
    return at, hot[at] == context if len(hot) else np.zeros(len(key), bool)


def _units(key: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """A hash of the context of each pair, of a hot one with its first bits: pairs that are counted together have the same."""
    context, is_hot = key >> U(BITS), _hot_places(key, hot)[1]
    return kernel.mix(np.where(is_hot, (key >> U(BITS - HOT_BITS)) + _K[5], context * _K[6]))


def _slices(unit: np.ndarray, slices: int) -> np.ndarray:
    return (((unit >> U(32)) * U(slices)) >> U(32)).astype(np.int32)


def _in_order(place: np.ndarray) -> np.ndarray:
    """A stable order of places; of 16 bits they are sorted faster."""
    return np.argsort(place.astype(np.uint16) if place.max(initial=0) < 1 << 16 else place, kind="stable")


def _parts(place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each place that occurs, and where, in order."""
    order = _in_order(place)
    at = np.flatnonzero(np.diff(place[order], prepend=-1))
    return zip(place[order[at]].tolist(), np.split(order, at[1:]))


def _rows_of(rows: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
    """run, a generator of dicts, for each chunk's columns."""
    kinds = pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in schema.split(", "))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from pa.Table.from_pylist(list(run(batch.slice(i, 1).to_pylist()[0])), kinds).to_batches()

    return rows.where("chunk IS NOT NULL").select(*columns).mapInArrow(each, schema)


def _dealt(rows: DataFrame, columns: list[str], counted, place_of) -> DataFrame:
    """SLICE: the packed keys of each chunk, ascending, and their counts (counted from its columns), by slices (place_of keys)."""

    def run(one: dict) -> Iterator[dict]:
        key, n = counted(one)
        for place, p in _parts(place_of(key)):
            yield {"slice": place, "chunk": one["chunk"], "keys": pack(key[p], True), "n": pack(n[p])}

    return _rows_of(rows, ["chunk", *columns], run, SLICE)


SPELLED = "slice int, keys binary, sizes binary, words binary"


def _spelled(rows: DataFrame, groups: int) -> DataFrame:
    """SPELLED: the training words of each chunk by groups of their hashes, ascending."""

    def run(one: dict) -> Iterator[dict]:
        ids, n = unpack(one["ids"], True), unpack(one["n"])
        ids, raw, size = ids[(n > 0) & (ids != _END)], np.frombuffer(zstandard.decompress(one["old"]), np.uint8), unpack(one["old_sizes"]).astype(np.int64)
        begin = np.cumsum(size) - size
        for place, p in _parts(_slices(ids, groups)):
            yield {"slice": place, "keys": pack(ids[p], True), "sizes": pack(size[p]), "words": zstandard.compress(_cut_out(raw, begin[p], size[p]).tobytes(), 1)}

    return _rows_of(rows, ["ids", "n", "old", "old_sizes"], run, SPELLED)


def _gathered(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A slice's distinct keys, their counts, and where each chunk's keys are among them."""
    own = [unpack(x, True) for x in group.column("keys").to_pylist()]
    n = np.concatenate([unpack(x) for x in group.column("n").to_pylist()]).astype(np.int64)
    key, _, inverse, _ = _distinct(np.concatenate(own))
    return key, np.bincount(inverse, weights=n, minlength=len(key)).astype(np.int64), np.split(inverse, np.cumsum([len(x) for x in own])[:-1])


ANSWERS = "chunk long, slice int, kind int, answer binary, n long, types long, once long, codes binary, codes_n binary, hot array<long>"


def _count_words(group: pa.Table, hot_least: float) -> pa.Table:
    """Kind 0: each chunk's counts; kind 1: a slice's tokens, types, types met once, tokens by code, and those met hot_least times or more."""
    id_, n, places = _gathered(group)
    slice_ = group.column("slice")[0].as_py()
    codes, at = np.unique(id_ >> U(64 - BITS), return_index=True)
    rows = [{"chunk": c, "slice": slice_, "kind": 0, "answer": pack(n[p])} for c, p in zip(group.column("chunk").to_pylist(), places)]
    rows.append({"slice": slice_, "kind": 1, "n": int(n.sum()), "types": int((n > 0).sum()), "once": int((n == 1).sum()), "codes": pack(codes, True), "codes_n": pack(np.add.reduceat(n, at)), "hot": id_[n >= hot_least].astype(np.int64).tolist()})
    return pa.Table.from_pylist(rows, pa.schema([(x, _KINDS[y]) for x, y in (z.split() for z in ANSWERS.split(", "))]))


def _tree(leaves: np.ndarray) -> np.ndarray:
    """Counts of the nodes above some leaves (the last axis), the root at 1 and the children of i at 2 i and 2 i + 1."""
    out = [leaves]
    while out[-1].shape[-1] > 1:
        out.append(out[-1][..., 0::2] + out[-1][..., 1::2])
    return np.concatenate([np.zeros_like(out[-1]), *out[::-1]], -1)


def _siblings(tree: np.ndarray) -> np.ndarray:
    """The counts of each node's sibling in place of its own."""
    return tree.reshape(*tree.shape[:-1], -1, 2)[..., ::-1].reshape(tree.shape)


def _logits(tree: np.ndarray, prior: float = 0.4) -> np.ndarray:
    """Of the bit 1 at each node."""
    return np.log((tree[..., 1::2] + prior) / (tree[..., 0::2] + prior)).astype(np.float32)


# the mixer

class Mixer:
    """Weights by gate, and by gate and strength of a prediction how often it came true."""

    def __init__(self, inputs: int):
        self.weights = np.full((GATES, inputs), 1.1 / inputs, np.float32)
        self.speed = np.full((GATES, inputs), 1e-2)
        self.right, self.met = np.zeros((GATES, BINS)), np.zeros((GATES, BINS))

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Logit of the bit that came, x being the inputs for it."""
        weights = np.ascontiguousarray(self.weights.T)
        z = x[:, 0] * weights[0][gate]
        for k in range(1, x.shape[1]):
            z += x[:, k] * weights[k][gate]
        return np.minimum(np.maximum(z, np.float32(-12)), np.float32(12))

    def learn(self, x: np.ndarray, gate: np.ndarray, mass: np.ndarray, rate: float = 0.02) -> None:
        """Predicts, then moves the weights."""
        z = self.mixed(x, gate)
        at = gate * BINS + np.minimum(np.abs(z) * np.float32(BINS / 12), np.float32(BINS - 1)).astype(np.int64)
        met = np.bincount(at, weights=mass, minlength=GATES * BINS).reshape(GATES, BINS)
        self.right += np.bincount(at, weights=mass * ((z > 0) + 0.5 * (z == 0)), minlength=GATES * BINS).reshape(GATES, BINS)
        self.met += met
        error = mass / (1 + np.exp(z))
        total = met.sum(1, keepdims=True)
        step = np.stack([np.bincount(gate, weights=error * x[:, k], minlength=GATES) for k in range(x.shape[1])], 1) / np.maximum(total, 1e-9)
        self.speed = 0.98 * self.speed + 0.02 * step**2
        self.weights += np.where(total > 0, rate * step / (np.sqrt(self.speed) + 1e-3), 0).astype(np.float32)

    def told(self) -> np.ndarray:
        """Whole numbers that add up over mixers in any order: weights times what their gates met, predictions that came true (in halves) and all."""
        met = self.met.sum(1, keepdims=True)
        return np.rint(np.concatenate([x.ravel() for x in (self.weights * met * WEIGHT_UNIT, self.right * 2, self.met)])).astype(np.int64)

    @classmethod
    def mean(cls, inputs: int, told: np.ndarray) -> "Mixer":
        """Of the sums of what mixers told; weights of gates that none met are as they begin."""
        out = cls(inputs)
        if len(told):
            weights, right, met = (x.reshape(GATES, -1) for x in np.split(told, [GATES * inputs, GATES * (inputs + BINS)]))
            out.right, out.met = right / 2, met.astype(float)
            total = out.met.sum(1, keepdims=True)
            out.weights = np.where(total > 0, weights / (np.maximum(total, 1) * WEIGHT_UNIT), out.weights).astype(np.float32)
        return out

    def bits(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Cost of the bit that came, refined."""
        z = self.mixed(x, gate)
        at = gate * BINS + np.minimum(np.abs(z) * np.float32(BINS / 12), np.float32(BINS - 1)).astype(np.int64)
        share, trust = ((self.right + 0.5) / (self.met + 1)).astype(np.float32).ravel()[at], (0.5 * self.met / (self.met + 200)).astype(np.float32).ravel()[at]
        p = 1 / (1 + np.exp(-z))
        p += np.where(z == 0, np.float32(0), trust * (np.where(z > 0, share, 1 - share) - p))
        return -np.log2(np.minimum(np.maximum(p, np.float32(1e-7)), np.float32(1 - 1e-7)))


_GATE_OF = (np.searchsorted(SEEN, np.arange(SEEN[-1] + 1), side="right") * 2 * FAR).astype(np.int64)


def _gates(same: np.ndarray, other: np.ndarray, level: int, levels: int) -> np.ndarray:
    return _GATE_OF[np.minimum(same + other, SEEN[-1])] + np.where(np.minimum(same, other) > 0, FAR, 0) + level * FAR // levels


def _context_logits(same: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.log((same.astype(np.float32) + np.float32(0.3)) / (other.astype(np.float32) + np.float32(0.3)))


@dataclass
class Words:
    """Predictors of the decisions of known words."""

    context_bits: int
    hot: np.ndarray  # ascending contexts
    hot_tree: np.ndarray  # of each, the counts of its first HOT_BITS decisions
    tree: np.ndarray
    class_tree: np.ndarray
    mixer: Mixer

    def ready(self) -> "Words":
        if not hasattr(self, "logits"):
            self.logits, self.class_logits = _logits(self.tree), _logits(self.class_tree)
        return self

    def ready_to_learn(self) -> "Words":
        """Holds, of each node, the logits for its bit that a training occurrence of it is predicted with from the others."""
        if not hasattr(self, "others"):
            self.others, self.class_others = ((np.log((x - np.float32(0.6)).clip(np.float32(0.4)) / (_siblings(x) + np.float32(0.4)))).astype(np.float32) for x in (self.tree, self.class_tree))
        return self

    def paths(self, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Counts of the nodes that each of ascending distinct pairs passes, from the root to its code; of contexts that are here whole, or hot."""
        out = np.empty((BITS + 1, len(key)), np.int32 if max(n.sum(), self.hot_tree.max(initial=0)) < 2**31 else np.int64)
        for level in range(BITS + 1):
            group = key >> U(BITS - level)
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            out[level] = np.repeat(np.add.reduceat(n, starts), np.diff(np.append(starts, len(key))))
        if len(self.hot):
            context = key >> U(BITS)
            at = np.searchsorted(self.hot, context).clip(max=len(self.hot) - 1)
            hot = np.flatnonzero(self.hot[at] == context)
            code = (key[hot] & U((1 << BITS) - 1)).astype(np.int64)
            for level in range(HOT_BITS + 1):
                out[level, hot] = self.hot_tree[at[hot], (1 << level) | (code >> (BITS - level))]
        return out

    def levels(self, key: np.ndarray, paths: np.ndarray, left_out: int):
        """For each decision of the pairs: (inputs for the bit that came, gate). left_out: 1 if an occurrence is to be predicted from the others."""
        code, class_ = (key & U((1 << BITS) - 1)).astype(np.int64), (key >> U(BITS + self.context_bits - 8)).astype(np.int64)
        for level in range(1, BITS + 1):
            node = (1 << level) | (code >> (BITS - level))
            same, other = paths[level] - left_out, paths[level - 1] - paths[level]
            x = np.zeros((3, len(key)), np.float32).T  # each input's values side by side
            if left_out:
                x[:, 0] = self.others[node]
                if level <= CLASS_BITS:
                    x[:, 1] = self.class_others.ravel()[(class_ << CLASS_BITS + 1) | node]
            else:
                sign = (2 * (node & 1) - 1).astype(np.float32)
                x[:, 0] = self.logits[node >> 1] * sign
                if level <= CLASS_BITS:
                    x[:, 1] = self.class_logits.ravel()[(class_ << CLASS_BITS) | (node >> 1)] * sign
            x[:, 2] = _context_logits(same, other)
            yield x, _gates(same, other, level - 1, BITS)

    def learn(self, key: np.ndarray, n: np.ndarray, at_once: int = 4096) -> None:
        """One online pass over the training occurrences of the pairs, in steps that grow up to at_once pairs, so that weights settle."""
        self.ready_to_learn()
        paths, order = self.paths(key, n), np.flatnonzero(n > 0)
        order = order[np.argsort(kernel.mix(key[order] + _K[7]), kind="stable")]
        key, n = key[order], n[order].astype(float)
        for path in paths:
            path[: len(order)] = path[order]
        a = 0
        while a < len(order):
            b = min(a + min(at_once, 256 + a // 16), len(order))
            for x, gate in self.levels(key[a:b], paths[:, a:b], 1):
                self.mixer.learn(x, gate, n[a:b])
            a = b

    def bits(self, key: np.ndarray, n: np.ndarray, at_once: int = 1 << 14) -> np.ndarray:
        """Cost of each pair's decisions."""
        out, context, a = np.zeros(len(key)), key >> U(BITS), 0
        while a < len(key):
            b = int(np.searchsorted(context, context[min(a + at_once, len(key)) - 1], side="right"))  # all of a context
            for x, gate in self.levels(key[a:b], self.paths(key[a:b], n[a:b]), 0):
                out[a:b] += self.mixer.bits(x, gate)
            a = b
        return out


@dataclass
class Bytes:
    """Predictors of the decisions of new words' bytes."""

    tree: np.ndarray  # orders x slots x 512
    mixer: Mixer

    def levels(self, byte: np.ndarray, slots: np.ndarray, left_out: int):
        flat, roots = self.tree.ravel(), (slots + np.arange(BYTE_ORDERS)[:, None] * BYTE_SLOTS) * self.tree.shape[-1]
        for level in range(1, 9):
            node = (1 << level) | (byte >> (8 - level))
            x = np.zeros((BYTE_ORDERS, len(byte)), np.float32).T
            for k in range(BYTE_ORDERS):
                at = roots[k] + node
                same, other = np.maximum(flat[at] - left_out, 0), flat[at ^ 1]
                x[:, k] = _context_logits(same, other)
            yield x, _gates(same, other, level - 1, 8)

    def learn(self, raw: np.ndarray, size: np.ndarray, at_once: int = 512, most_bytes: int = 4096) -> None:
        """One online pass over words, which lie in raw end to end, in steps of at most at_once words and most_bytes bytes."""
        begin = np.cumsum(size) - size
        for a in range(0, len(size), at_once):
            b = min(a + at_once, len(size))
            _, byte, slots = _byte_slots(raw[begin[a] : begin[b - 1] + size[b - 1]], begin[a:b] - begin[a], size[a:b])
            for b in range(0, len(byte), most_bytes):
                for x, gate in self.levels(byte[b : b + most_bytes], slots[:, b : b + most_bytes], 1):
                    self.mixer.learn(x, gate, np.ones(len(x)))

    def bits(self, words: list[bytes], at_once: int = 4096) -> np.ndarray:
        out = [np.zeros(0)]
        for a in range(0, len(words), at_once):
            part = words[a : a + at_once]
            of, byte, slots = _byte_slots(*_spans(part))
            cost = np.zeros(len(byte))
            for x, gate in self.levels(byte, slots, 0):
                cost += self.mixer.bits(x, gate)
            out.append(np.bincount(of, weights=cost, minlength=len(part)))
        return np.concatenate(out)


def _spans(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size


# the whole

def _score_chunk(rows: pa.Table, answers: pa.Table, words: Words, spelling: Bytes, place_of, train: dict) -> pa.Table:
    one = {c: rows.column(c)[0].as_py() for c in ("doc_id", "n_bytes", "n_tokens", "t", "ids", "n", "met", "classes", "new")}
    ids, t, row, key = _unfolded(one, words.context_bits)
    found = sorted(zip(answers.column("kind").to_pylist(), answers.column("slice").to_pylist(), answers.column("answer").to_pylist()), key=lambda x: x[:2])
    known = np.concatenate([unpack(a) for k, _, a in found if k == 0]).astype(np.int64)
    key, _, inverse, _ = _distinct(key)
    place = _in_order(place_of(key))
    price = np.zeros(len(key))
    price[place] = np.concatenate([unpack(a) for k, _, a in found if k == 2]) / UNIT
    # of each distinct token: what being known and its share of its code cost, or what being new and its bytes do
    of_code = words.tree[(1 << BITS) | (ids >> U(64 - BITS)).astype(np.int64)]
    new_share = (train["once"] + 0.5) / (train["n"] + 1)
    own = np.where(known > 0, -np.log2(1 - new_share) - np.log2(np.maximum(known, 1) / np.maximum(of_code, 1)), -np.log2(new_share))
    listed = np.flatnonzero((unpack(one["n"]) == 0) & (ids != _END))
    missing = known[listed] == 0
    spelled = zstandard.decompress(one["new"]).split(b" ") if len(listed) else []
    own[listed[missing]] += spelling.bits([w for w, m in zip(spelled, missing.tolist()) if m])
    cost = np.where(known[t] > 0, price[inverse], 0) + own[t]
    base = np.log10((known + 0.1) / (train["n"] + 0.1 * (train["types"] + 1)))
    n_rows = len(one["n_tokens"])
    total = lambda x: np.bincount(row, weights=x, minlength=n_rows)
    bits = total(cost)
    doc_id = pa.array(one["doc_id"], pa.int64())
    columns = [doc_id, pa.array(~_trained(doc_id)), pa.array(one["n_tokens"], pa.int64()), pa.array(total(known[t] > 0).astype(np.int64)), pa.array(np.full(n_rows, train["n"], np.int64)), pa.array(total(base[t])), pa.array(-bits * np.log10(2)), pa.array(bits / np.maximum(np.array(one["n_bytes"]), 1))]
    return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])


def _small(tree: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where they fit."""
    return tree.astype(np.int32) if tree.max(initial=0) < 2**31 else tree


def _added(group: pa.Table) -> pa.Table:
    total = None
    for x in group.column("counts"):
        n = unpack(x.as_py())
        total = n if total is None else total + n
    return pa.table([group.column("part").slice(0, 1), group.column("task").slice(0, 1), pa.array([pack(total)], pa.binary())], ["part", "task", "counts"])


def _total(counts: DataFrame, parts: int, at_once: int = 32) -> np.ndarray:
    """The sums of all tasks' (or groups') packed counts (part, task, counts), added up at_once at a time, however many there are."""
    tasks = (counts.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        counts = counts.withColumn("task", F.floor(F.col("task") / at_once)).groupBy("part", "task").applyInArrow(_added, "part int, task long, counts binary")
        tasks = -(-tasks // at_once)
        if tasks == 1:
            break
    rows = {r["part"]: unpack(r["counts"]).astype(np.int64) for r in counts.collect()}  # a row for each part
    return np.concatenate([rows[i] for i in range(parts)]) if rows else np.zeros(0, np.int64)


def score(spark: SparkSession, docs: DataFrame, chunk_bytes: int = 6 << 20, slice_pairs: int = 700_000, learn_tokens: int = 500_000, learn_words: int = 50_000) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Slices hold about slice_pairs tokens. learn_tokens, learn_words: what a group learns from; all groups together learn from all there is.
    """
    scratch = Scratch(spark, "mixing")
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    context_bits = min(46, max(24, int((size["b"] or 0) / 6 + size["n"] + 1).bit_length() + 2))
    chunks = scratch.keep(_chunks(docs, context_bits, chunk_bytes))
    told = chunks.where("chunk IS NOT NULL").agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(y) for x, y in ((F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b), "tokens"), (F.col("trained"), "trained")))).first()
    slices = max(1, -(-told["tokens"] // slice_pairs))
    groups = max(1, -(-told["trained"] // learn_tokens))
    together = -(-groups // slices)  # groups that learn in one slice of pairs

    # counts of words, and what all tasks need of them: a table of fixed size
    own_words = lambda one: (unpack(one["ids"], True), unpack(one["n"]))
    hot_least = max(1, HOT_SHARE * told["trained"])
    answers = scratch.keep(_dealt(chunks, ["ids", "n"], own_words, lambda ids: _slices(ids, slices)).groupBy("slice").applyInArrow(lambda group: _count_words(group, hot_least), ANSWERS))
    leaves, train = np.zeros(1 << BITS, np.int64), {"n": 0, "types": 0, "once": 0}
    for r in answers.where("kind = 1").select("n", "types", "once", "codes", "codes_n").toLocalIterator():  # 2**BITS codes and one row per slice
        np.add.at(leaves, unpack(r["codes"], True).astype(np.int64), unpack(r["codes_n"]).astype(np.int64))
        train = {k: train[k] + r[k] for k in train}
    flat = _total(chunks.where("part IS NOT NULL").select("part", "task", "counts"), PARTS)
    flat = flat if len(flat) else np.zeros(CLASS_COUNTS + BYTE_COUNTS, np.int64)
    hot = answers.where("kind = 1").select(F.explode("hot").alias("hot"))  # 1 / HOT_SHARE rows at most, of them the contexts that they are
    hot = chunks.where("chunk IS NOT NULL").select(F.explode(F.arrays_zip("hot", "hot_context")).alias("x")).select("x.*").join(F.broadcast(hot), "hot").select("hot_context").distinct().collect()
    hot_keys = np.sort(np.array([r["hot_context"] for r in hot], np.int64)).astype(U)

    def heated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(len(hot_keys) << HOT_BITS, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                key, n = _counted_pairs(batch.slice(i, 1).to_pylist()[0], context_bits)
                at, is_hot = _hot_places(key, hot_keys)
                node = (key[is_hot] >> U(BITS - HOT_BITS)).astype(np.int64) & ((1 << HOT_BITS) - 1)
                total += np.bincount((at[is_hot] << HOT_BITS) | node, weights=n[is_hot], minlength=len(total)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pack(total)], pa.binary())], ["part", "task", "counts"])

    hot_counts = np.zeros((len(hot_keys), 1 << HOT_BITS), np.int64)
    if len(hot_keys):
        found = chunks.where("chunk IS NOT NULL").select(*PAIR_COLUMNS).mapInArrow(heated, "part int, task long, counts binary")
        hot_counts[:] = _total(found, 1).reshape(hot_counts.shape)
    words = Words(context_bits, hot_keys, _tree(hot_counts), _tree(leaves), _small(_tree(flat[:CLASS_COUNTS].reshape(256, -1))), Mixer(3))
    spelling = Bytes(_small(_tree(flat[CLASS_COUNTS:].reshape(BYTE_ORDERS, BYTE_SLOTS, 256))), Mixer(BYTE_ORDERS))
    sent = spark.sparkContext.broadcast((words, spelling))

    # the weights: of words from all training pairs, by groups of contexts, of bytes from all training words, by groups of words
    def place_of(key: np.ndarray) -> np.ndarray:
        return _slices(_units(key, sent.value[0].hot), groups) // together

    def learned_pairs(group: pa.Table) -> pa.Table:
        key, n, _ = _gathered(group)
        total = np.zeros(GATES * (3 + 2 * BINS), np.int64)
        for _, own in _parts(_slices(_units(key, sent.value[0].hot), groups)):
            one = replace(sent.value[0], mixer=Mixer(3))
            one.learn(key[own], n[own])
            total += one.mixer.told()
        lists = [pa.array([group.column(c).to_pylist()], pa.list_(kind)) for c, kind in (("chunk", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()))]
        return pa.table([group.column("slice").slice(0, 1), *lists, pa.array([pack(total)], pa.binary())], ["slice", "chunk", "keys", "n", "told"])

    def learned_words(group: pa.Table) -> pa.Table:
        first = np.unique(np.concatenate([unpack(x, True) for x in group.column("keys").to_pylist()]), return_index=True)[1]
        size = np.concatenate([unpack(x) for x in group.column("sizes").to_pylist()]).astype(np.int64)
        raw = np.concatenate([np.frombuffer(zstandard.decompress(x), np.uint8) for x in group.column("words").to_pylist()])
        one = replace(sent.value[1], mixer=Mixer(BYTE_ORDERS))
        one.learn(_cut_out(raw, (np.cumsum(size) - size)[first], size[first]), size[first])
        return pa.table([pa.array([0], pa.int32()), group.column("slice").slice(0, 1).cast(pa.int64()), pa.array([pack(one.mixer.told())], pa.binary())], ["part", "task", "counts"])

    pairs = scratch.keep(
        _dealt(chunks, PAIR_COLUMNS, lambda one: _counted_pairs(one, context_bits), place_of).groupBy("slice").applyInArrow(learned_pairs, "slice int, chunk array<long>, keys array<binary>, n array<binary>, told binary"),
        rows_per_file=4,
    )  # a row for each slice
    word_groups = max(1, -(-train["types"] // learn_words))
    told_words = scratch.keep(_spelled(chunks, word_groups).groupBy("slice").applyInArrow(learned_words, "part int, task long, counts binary"))
    mixers = Mixer.mean(3, _total(pairs.select(F.lit(0).alias("part"), F.col("slice").cast("long").alias("task"), F.col("told").alias("counts")), 1)), Mixer.mean(BYTE_ORDERS, _total(told_words, 1))

    def final() -> tuple[Words, Bytes]:
        return tuple(replace(x, mixer=m) for x, m in zip(sent.value, mixers))

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = final()[0].ready()
        for batch in batches:
            for i in range(batch.num_rows):
                slice_, group = batch.column("slice")[i], pa.table([batch.column(c)[i].values for c in ("chunk", "keys", "n")], ["chunk", "keys", "n"])
                key, n, places = _gathered(group)
                cost = np.minimum(np.ceil(words.bits(key, n) * UNIT), 2**32).astype(np.int64)
                chunk = group.column("chunk").combine_chunks()
                yield pa.RecordBatch.from_arrays([chunk, pa.array([slice_.as_py()] * len(chunk), pa.int32()), pa.array(np.full(len(chunk), 2, np.int32)), pa.array([pack(cost[p]) for p in places], pa.binary())], ["chunk", "slice", "kind", "answer"])

    prices = pairs.select("slice", "chunk", "keys", "n").mapInArrow(priced, "chunk long, slice int, kind int, answer binary")
    all_ = answers.where("kind = 0").select("chunk", "slice", "kind", "answer").unionByName(prices)

    def finish(rows: pa.Table, found: pa.Table) -> pa.Table:
        return _score_chunk(rows, found, *final(), place_of, train)

    own = chunks.where("chunk IS NOT NULL").select("chunk", "doc_id", "n_bytes", "n_tokens", "t", "ids", "n", "met", "classes", "new")
    return own.groupBy("chunk").cogroup(all_.groupBy("chunk")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, table(spark, sf_dir, "documents"))
