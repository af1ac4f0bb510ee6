"""Language-model scores by online logistic context mixing.

A text is a string of bytes (A-Z in lower case) and an end. Each byte is a walk down a binary tree that depends
on the byte before (a Huffman tree of what followed it in training), so a likely byte is few decisions. At every
decision each hashed context (two bytes, four bytes, the word so far) predicts the bit from two counts;
the predictions are mixed in the logistic domain by weights that a gate selects, the gate being how much the two
longer contexts have seen. All weights start alike and are learned online, from the first byte of each text to its last: what
a text is scored with does not depend on other texts' places or on a sample.

A last stage refines the mix adaptively: each word is expected by the bytes and, as a whole, by its count in training, the share of the
latter being how often it has been nearer so far in the text.

Training counts bits over all training texts: every task fills tables of a fixed number of slots, which Spark
adds up slot by slot. The tables sent to tasks have that fixed size, whatever the corpus. Word counts grow with the corpus; the
most frequent words are sent to tasks, the counts of all others are joined, for both word models.
"""

from __future__ import annotations

import heapq
import math
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GROUP_BYTES, saved, table
from .ctph import power_tables
from .words import BYTE, WHITE

#: Bits of the slot number of each context's table.
TABLE_BITS = (18, 22, 22)
#: Slots in what a task hands on at a time.
PART = 1 << 14
#: Weights are corrected after so many bytes of a text, from its first to its last.
STEP = 64
RATE = 0.01
#: Texts up to so many bytes are scored side by side, longer ones each alone, in blocks of so many bytes.
LONG = 1 << 17
#: Words are counted in so many bytes of texts before their counts are handed on.
WORDS_BYTES = 8 << 20
#: Contexts are hashed for about so many bytes at a time.
BLOCK = 1 << 15
#: Most frequent words that every task holds; counts of others are joined.
HEAD = 100_000
END = 255
#: The hash of two bytes.
TWO = np.uint32(0x85EBCA6B)
PAD = 4


# -- the tree ---------------------------------------------------------------------------------------------------------
class Code:
    """Paths of all bytes after all bytes: for symbol = before * 256 + byte, ``size`` decisions from ``first`` on in ``mix`` (the
    node, 0 at the root and less than 255) and ``sign`` (+1 or -1)."""

    def __init__(self, pairs: np.ndarray):
        size, mix, sign = np.zeros(65536, dtype=np.int64), [], []
        overall = pairs.sum(axis=0) + 1
        for before in range(256):
            counts = pairs[before] * 256 + overall / overall.sum() if pairs[before].any() else overall.astype(float)
            heap = [(float(c), k, k) for k, c in enumerate(counts)]
            heapq.heapify(heap)
            parent: dict[int, tuple[int, int]] = {}
            name = 256
            while len(heap) > 1:
                (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
                parent[x], parent[y] = (name, -1), (name, 1)
                heapq.heappush(heap, (a + b, name, name))
                name += 1
            for byte in range(256):
                nodes, signs, at = [], [], byte
                while at in parent:
                    at, s = parent[at]
                    nodes.append(at)
                    signs.append(s)
                size[before * 256 + byte] = len(nodes)
                mix += [510 - n for n in reversed(nodes)]
                sign += reversed(signs)
        self.size = size
        self.first = np.concatenate([[0], np.cumsum(size)[:-1]])
        self.mix, self.sign = np.array(mix, dtype=np.intp), np.array(sign, dtype=np.float32)


def laid_out(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after the other, each with ``PAD`` blanks before and an end after; and where each text starts."""
    data = np.frombuffer(b"".join([b"    " + r + b"\xff" for r in raws]), dtype=np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(r) + PAD + 1 for r in raws])[:-1]]) + PAD


def gaps(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to no word; the first is a blank, the last an end."""
    out = WHITE.take(data, mode="clip")
    out |= data == END
    return out


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Where all words begin and end, and the words, each different one held once."""
    gap = gaps(data)
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not len(edge):
        return edge, edge, pa.array([], pa.binary()).dictionary_encode()
    parts = pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(data)])  # a word, a gap, a word
    return edge[0::2], edge[1::2], parts.take(pa.array(np.arange(0, len(edge), 2))).dictionary_encode()


def symbols_of(data: np.ndarray) -> np.ndarray:
    """Each byte with the one before."""
    out = np.zeros(len(data), dtype=np.intp)
    out[1:] = data[:-1]
    out <<= 8
    out |= data
    return out


def contexts(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """A 32-bit hash of each context before every byte of ``laid_out``; texts are worked on in blocks that stay in the cache."""
    cuts = [0]
    for at in (starts - PAD).tolist():
        if at - cuts[-1] >= BLOCK:
            cuts.append(at)
    out = [np.empty(len(data), dtype=np.uint32) for _ in TABLE_BITS]
    for a, b in zip(cuts, [*cuts[1:], len(data)]):
        for whole, part in zip(out, _contexts(data[a:b])):
            whole[a:b] = part
    return out


def _contexts(data: np.ndarray) -> list[np.ndarray]:
    wide = data.astype(np.uint32)
    out = []
    two = np.zeros(len(data), dtype=np.uint32)
    two[2:] = wide[1:-1] | wide[:-2] << np.uint32(8)
    four = two.copy()
    four[4:] |= wide[1:-3] << np.uint32(16) | wide[:-4] << np.uint32(24)
    out.append(two * TWO)
    out.append((four ^ four >> np.uint32(15)) * np.uint32(0xC2B2AE35))
    up, down = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    word = BYTE.take(data.astype(np.intp), mode="clip")
    word *= up[: len(data)]
    np.cumsum(word, out=sums[1:])
    blank = np.flatnonzero(WHITE.take(data[:-1], mode="clip")) + 1
    start = np.repeat(np.concatenate([[0], blank]), np.diff(np.concatenate([[0], blank, [len(data)]])))  # where each byte's word begins
    np.subtract(sums[:-1], sums.take(start, mode="clip"), out=word)
    word *= down.take(start, mode="clip")
    word ^= word >> np.uint64(32)
    out.append(word.astype(np.uint32) * np.uint32(0x27D4EB2F))
    for x in out:
        x ^= x >> np.uint32(16)
    return out


def decisions(code: Code, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each symbol's decisions end; which symbol each decision belongs to; and where in the code's lists it lies."""
    size = code.size.take(symbols, mode="clip")
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(symbols), dtype=np.intp), size)
    first = code.first.take(symbols, mode="clip")
    first -= ends
    first += size
    place = first.take(owner, mode="clip")
    place += np.arange(len(owner))
    return ends, owner, place


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ``keys``, and how often each occurs; they are sorted in place."""
    keys.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1]]))
    return keys[first], np.diff(first, append=len(keys))


def slots(context: np.ndarray, owner: np.ndarray, mix: np.ndarray, bits: int) -> np.ndarray:
    """The slot of each decision: the nodes of a context lie side by side, so that a byte's path is read from few cache lines."""
    x = context * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    x >>= np.uint32(32 - bits)
    x = x.astype(np.intp).take(owner, mode="clip")
    x ^= mix
    return x


# -- counting ---------------------------------------------------------------------------------------------------------
class Counts:
    """Counts of the bits of texts: ``tables`` (slot * 2 + bit) of all contexts, and how often each byte followed each two, from
    which the first of the tables comes in the end."""

    def __init__(self, code: Code):
        self.code = code
        self.tables = [np.zeros(2 << b, dtype=np.uint32) for b in TABLE_BITS]
        self.triples = np.zeros(1 << 24, dtype=np.uint32)  # only pages that are touched take room

    def add(self, raws: list[bytes]) -> None:
        data, starts = laid_out(raws)
        keep = np.ones(len(data), dtype=bool)
        for k in range(1, PAD + 1):
            keep[starts - k] = False
        at = np.flatnonzero(keep)
        symbols = symbols_of(data)
        triples = symbols.copy()
        triples[1:] |= (symbols[:-1] & 0xFF00) << 8
        symbols = symbols.take(at)
        np.add.at(self.triples, triples.take(at), np.uint32(1))
        for h, bits, out in zip(contexts(data, starts)[1:], TABLE_BITS[1:], self.tables[1:]):
            some, times = runs(h.take(at).astype(np.uint64) << np.uint64(16) | symbols.view(np.uint64))  # a symbol in a context takes its path once for all
            _, owner, place = decisions(self.code, (some & np.uint64(0xFFFF)).astype(np.intp))
            s = slots((some >> np.uint64(16)).astype(np.uint32), owner, self.code.mix.take(place), bits)
            s <<= 1
            s |= self.code.sign.take(place) > 0
            np.add.at(out, s, times.astype(np.uint32).take(owner))

    def finish(self) -> list[np.ndarray]:
        some = np.flatnonzero(self.triples)
        _, owner, place = decisions(self.code, some & 0xFFFF)
        two = (some >> 8 & 0xFF | some >> 16 << 8).astype(np.uint32) * TWO
        s = slots(two ^ two >> np.uint32(16), owner, self.code.mix[place], TABLE_BITS[0])
        np.add.at(self.tables[0], s << 1 | (self.code.sign[place] > 0), self.triples[some].take(owner))
        return self.tables


def small_counts(counts: np.ndarray) -> np.ndarray:
    """Two counts a slot as one byte: how much the slot has seen (0 to 3) in two bits, and its logit in six."""
    pairs = counts.reshape(-1, 2).astype(np.float64)
    zero, one = pairs[:, 0], pairs[:, 1]
    total = zero + one
    logit = np.log((one + 0.4) / (zero + 0.4)) * np.where((zero == 0) | (one == 0), 1 + (total >= 255) * 0.3, 1)
    place = np.rint(np.sign(logit) * np.log1p(np.minimum(np.abs(logit), MOST)) / np.log1p(MOST) * 31) + 32
    return (np.digitize(total, [1, 3, 16]).astype(np.uint8) << 6) | place.astype(np.uint8)


def counted(train: DataFrame, code: Code) -> list[np.ndarray]:
    """The tables of ``train`` (raw binary, any case): one byte a slot."""
    sent = train.sparkSession.sparkContext.broadcast(code)

    def fill(batches):
        own = sent.value
        counts = Counts(own)
        pending, size, some = [], 0, False
        for batch in batches:
            for t in batch.column(0):
                raw = t.as_py().lower()
                pending.append(raw)
                size += len(raw)
                if size > GROUP_BYTES:
                    counts.add(pending)
                    pending, size, some = [], 0, True
        if pending:
            counts.add(pending)
            some = True
        for k, table_ in enumerate(counts.finish() if some else []):
            for p, own_part in enumerate(table_.reshape(-1, min(2 * PART, len(table_)))):
                if own_part.any():
                    planes = np.ascontiguousarray(own_part.view(np.uint8).reshape(-1, 4).T)
                    yield pa.RecordBatch.from_pydict({"part": pa.array([k << 16 | p], pa.int32()), "counts": pa.array([zlib.compress(planes.tobytes(), 1)], pa.binary())})

    def unpack(raw: bytes) -> np.ndarray:
        planes = np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(4, -1)
        return np.ascontiguousarray(planes.T).view(np.uint32).ravel()

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = unpack(raw.as_py())
                sums[part] = sums[part] + x if part in sums else x.astype(np.uint64)
        for part, x in sums.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "counts": pa.array([zlib.compress(small_counts(x).tobytes(), 1)], pa.binary())})

    rows = train.mapInArrow(fill, "part int, counts binary")
    n = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = [np.full(1 << b, 32, dtype=np.uint8) for b in TABLE_BITS]
    for part, raw in rows.repartition(min(n, 256), "part").mapInArrow(add, "part int, counts binary").toLocalIterator():
        x = np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
        start = (part & 0xFFFF) * PART
        out[part >> 16][start : start + len(x)] = x
    return out


# -- mixing -----------------------------------------------------------------------------------------------------------
#: The largest logit; the logits that a slot's low six bits stand for; and gates, of what two contexts have seen.
MOST = 9.0
LEVELS = (np.sign(np.arange(64) - 32) * np.expm1(np.abs(np.arange(64) - 32) / 31 * np.log1p(MOST))).astype(np.float32)
LOGIT = np.tile(LEVELS, 4)
GATES = 16
SIGNS = len(TABLE_BITS) + 1
BIAS = np.float32(0.3)
#: What all weights start at.
START = np.float32(0.4)


class Model:
    """Tables and tree."""

    def __init__(self, code: Code, tables: list[np.ndarray]):
        self.code, self.tables = code, tables

    def _inputs(self, hashes: list[np.ndarray], at: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The contexts' logits at each decision, and its gate."""
        mix = self.code.mix.take(place, mode="clip")
        inputs, gate = [], None
        for k, (h, bits, table_) in enumerate(zip(hashes, TABLE_BITS, self.tables)):
            seen = table_.take(slots(h.take(at, mode="clip"), owner, mix, bits), mode="clip")
            inputs.append(LOGIT.take(seen, mode="clip"))
            if k:
                seen >>= 6
                gate = seen if gate is None else gate << 2 | seen
        return inputs, gate

    def costs(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """What the bytes of ``laid_out`` cost, bits times ln 2 (0 for blanks before texts), summed up to each place where a word or a text begins or
        ends (what lies between is not told apart); and where each text starts."""
        data, starts = laid_out(raws)
        hashes, symbols, edge = contexts(data, starts), symbols_of(data), gaps(data)
        edge[1:] = edge[1:] != edge[:-1]
        lengths = np.array([len(r) + 1 for r in raws], dtype=np.int64)
        out = np.zeros(len(data) + 1)
        for k in np.flatnonzero(lengths > LONG).tolist():
            self._alone(data, hashes, int(starts[k]), int(starts[k] + lengths[k]), out)
        doc = np.flatnonzero(lengths <= LONG)
        doc = doc[np.argsort(-lengths[doc], kind="stable")]  # longest first: those not yet at their end stay in front
        begin, end = starts[doc], starts[doc] + lengths[doc]
        weights = np.full((SIGNS // 2, len(doc) * GATES), START + 1j * START, dtype=np.complex64)  # two of them as one number: half as many places to look up
        for step in range(0, int(lengths[doc].max(initial=0)), STEP):
            live = int(np.searchsorted(begin - end, -step, side="left"))
            first = begin[:live] + step
            n = np.minimum(end[:live] - first, STEP)
            last = np.cumsum(n)
            at = np.arange(last[-1]) + np.repeat(first - (last - n), n)
            ends, owner, place = decisions(self.code, symbols.take(at, mode="clip"))
            inputs, gate = self._inputs(hashes, at, owner, place)
            sign = self.code.sign.take(place, mode="clip")
            who = np.repeat(np.arange(live, dtype=np.intp) * GATES, n).take(owner, mode="clip")
            who += gate
            inputs.append(BIAS)
            z = np.zeros(len(who), dtype=np.float32)
            for w, x, y in zip(weights, inputs[::2], inputs[1::2]):
                w = w.take(who, mode="clip")
                z += w.real * x
                z += w.imag * y
            z *= sign
            np.clip(z, -12, 12, out=z)
            np.negative(z, out=z)
            np.exp(z, out=z)  # odds against the bit
            s = z + np.float32(1)
            z /= s
            z *= sign  # the error
            begins = edge.take(at, mode="clip")
            begins[last - n] = True
            begins = np.flatnonzero(begins)  # a word or a gap, or what of it lies in this step
            to = np.append(begins[1:], len(at)) - 1
            out[at.take(to) + 1] = np.add.reduceat(np.log(s, out=s), np.append(0, ends.take(begins[1:] - 1)))
            z *= np.float32(RATE)
            for w, x, y in zip(weights, inputs[::2], inputs[1::2]):
                both = np.empty(len(who), dtype=np.complex64)
                np.multiply(z, x, out=both.real)
                np.multiply(z, y, out=both.imag)
                np.add.at(w, who, both)
        return np.cumsum(out, out=out), starts

    def _alone(self, data: np.ndarray, hashes: list[np.ndarray], begin: int, end: int, out: np.ndarray) -> None:
        """The costs of one text: what does not depend on the correction is worked out for a block at a time."""
        change = np.zeros(GATES * SIGNS, dtype=np.float32)
        for start in range(begin, end, LONG):
            at = np.arange(start, min(start + LONG, end))
            to, owner, place = decisions(self.code, data[at - 1].astype(np.int64) << 8 | data[at])
            inputs, gate = self._inputs(hashes, at, owner, place)
            x = np.empty((len(gate), SIGNS), dtype=np.float32)
            for k, column in enumerate([*inputs, BIAS]):
                x[:, k] = column
            x *= self.code.sign.take(place, mode="clip")[:, None]
            which = gate.astype(np.intp)[:, None] * SIGNS + np.arange(SIGNS)
            odds = np.empty(len(gate), dtype=np.float32)
            a = 0
            for b in [*to[STEP - 1 : -1 : STEP].tolist(), int(to[-1])]:
                z = np.einsum("nk,nk->n", x[a:b], START + change.take(which[a:b]))
                np.clip(z, -12, 12, out=z)
                np.negative(z, out=z)
                np.exp(z, out=z)
                odds[a:b] = z
                change += RATE * np.bincount(which[a:b].ravel(), weights=((z / (z + np.float32(1)))[:, None] * x[a:b]).ravel(), minlength=GATES * SIGNS)
                a = b
            out[at + 1] = np.diff(np.cumsum(np.log1p(odds), dtype=np.float64)[to - 1], prepend=0.0)


def refined(by_bytes: np.ndarray, by_count: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the two experts for words weigh (natural logs), the bytes and the count, given what each says of every word (``by_count`` is
    nan where it is not known here) and each word's text: the share of the latter is (1 + how often it was above) / (10 + how many words
    were known) so far in the text."""
    known = ~np.isnan(by_count)
    wins = np.zeros(len(owner) + 1)
    np.cumsum(known & (np.where(known, by_count, 0) > by_bytes), out=wins[1:])
    seen = np.concatenate([[0.0], np.cumsum(known)])
    times = np.bincount(owner)
    first = (np.cumsum(times) - times)[owner]  # texts' words lie one after the other
    share = (1 + wins[:-1] - wins[first]) / (10 + seen[:-1] - seen[first])
    return np.log1p(-share), np.log(share)


def by_length(lengths: np.ndarray) -> list[list[int]]:
    """Which texts are worked on together: texts of about one length, ``GROUP_BYTES`` at a time."""
    out, size = [[]], 0
    for k in np.argsort(lengths, kind="stable").tolist():
        if size > GROUP_BYTES:
            out.append([])
            size = 0
        out[-1].append(k)
        size += int(lengths[k])
    return out if len(lengths) else []


def model_of(train: DataFrame, pairs: np.ndarray) -> Model:
    """A model of ``train`` (raw binary, any case), given how often each byte followed each other."""
    code = Code(pairs)
    return Model(code, counted(train, code))


# -- the query --------------------------------------------------------------------------------------------------------
def gathered(docs: DataFrame) -> DataFrame:
    """(kind, key, n): 0 word counts, 1 counts of a byte after a byte, 2 the number of texts."""

    def run(batches):
        pairs = np.zeros(65536, dtype=np.int64)
        texts = size = 0
        pending: list[bytes] = []

        def count():
            data = np.frombuffer(b"".join(pending), dtype=np.uint8)
            pending.clear()
            for a in range(1, len(data), GROUP_BYTES):
                pairs[:] += np.bincount(symbols_of(data[a - 1 : a + GROUP_BYTES])[1:], minlength=65536)
            pairs[END << 8 | 32] = 0  # the end of a text before the next one; no text has that byte
            _, _, words = words_of(data)
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), dtype=np.int32)), words.dictionary, pa.array(n, pa.int64())], names=["kind", "key", "n"])

        for batch in batches:
            for t in batch.column(0):
                raw = t.as_py().lower()
                texts += 1
                pending += [b" ", raw, b"\xff"]
                size += len(raw)
                if size > WORDS_BYTES:
                    yield count()
                    size = 0
        if texts:
            yield count()
            some = np.flatnonzero(pairs).tolist()
            yield pa.RecordBatch.from_pydict({"kind": pa.array([1] * len(some) + [2], pa.int32()), "key": pa.array([k.to_bytes(2, "big") for k in some] + [b""], pa.binary()), "n": pa.array([*pairs[some].tolist(), texts], pa.int64())})

    return docs.select("raw").mapInArrow(run, "kind int, key binary, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def scored(docs: DataFrame, model: Model, head: dict[bytes, int], ends: int, log_total: float) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_bytes, known, base, score, tail) of ``docs`` (doc_id, held_out, raw): the score (natural log) without the
    words that ``head`` has not, which are in tail with the bytes' expectation and the weight of the count's (natural logs)."""
    sent = docs.sparkSession.sparkContext.broadcast((model, head))
    end = math.log10(ends + 0.1) - log_total

    def run(batches):
        own, counts = sent.value
        log_of = {w: math.log10(c + 0.1) - log_total for w, c in counts.items()}
        nan = math.nan

        def done(ids, held, raws):
            upto, starts = own.costs(raws)
            data, _ = laid_out(raws)
            s, e, words = words_of(data)
            which = words.indices.to_numpy()
            n = np.diff(np.searchsorted(s, starts), append=len(s))
            owner = np.repeat(np.arange(len(raws)), n)
            base = np.fromiter(map(log_of.get, words.dictionary.to_numpy(zero_copy_only=False), repeat(nan)), dtype=np.float64, count=len(words.dictionary)).take(which)
            by_bytes, by_count = upto[s] - upto[e], base * math.log(10)
            less, more = refined(by_bytes, by_count, owner)
            known = ~np.isnan(base)
            value = np.where(known, np.logaddexp(by_bytes + less, np.where(known, by_count, 0) + more), 0.0)
            last = starts + [len(r) + 1 for r in raws]
            total = lambda x: np.bincount(owner, weights=x, minlength=len(raws))
            score = upto[starts] - upto[last] - total(by_bytes) + total(value)
            rare = np.flatnonzero(~known)
            flat = [words.dictionary.take(pa.array(which[rare])), pa.array((by_bytes + less)[rare].astype(np.float32)), pa.array(more[rare].astype(np.float32))]
            tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[rare], np.arange(len(raws) + 1)), pa.int32()), pa.StructArray.from_arrays(flat, fields=list(kind.field("tail").type.value_type)))
            columns = [ids, held, n + 1, [len(r) + 1 for r in raws], (total(known) + (ends > 0)).astype(np.int64), total(np.where(known, base, 0)) + end, score, tails]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, kind)], schema=kind)

        for batch in batches:
            ids, held, raws = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for group in by_length(np.asarray(pc.binary_length(raws))):
                yield done([ids[k] for k in group], [held[k] for k in group], [raws[k].as_py().lower() for k in group])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = "doc_id long, held_out boolean, n_tokens long, n_bytes long, known long, base double, score double, tail array<struct<word:binary,own:float,more:float>>"
    kind = to_arrow_schema(StructType.fromDDL(schema))
    return docs.select("doc_id", "held_out", "raw").mapInArrow(run, schema)


def least_count(words: DataFrame, most: int = HEAD) -> int:
    """The smallest count that ``most`` words or fewer reach; there are no more different counts than twice the root of all tokens."""
    sizes = words.groupBy("c").agg(F.count("*").alias("k"))
    reach = sizes.withColumn("to", F.sum("k").over(Window.orderBy(F.desc("c")))).filter(F.col("to") <= most)
    return reach.agg(F.coalesce(F.min("c"), F.lit(1 << 62))).first()[0]


def scores(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row: the word model's and the
    mixing model's log10 probability of the whole text, and the latter as bits for each byte (its end counts as one), learned from the rows that are not held out.

    Null texts count as empty: an end alone. A text of any length is scored whole. A null id hashes as the empty text, and is held out. Repeated rows are scored
    alike. Without training rows every decision is even and every word unknown. An empty table gives an empty one;
    other columns of the input do not come back, whatever their names.
    """
    spark = df.sparkSession
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")  # A-Z become lower case where the bytes are read
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), (F.crc32(key.cast("binary")) % 10 == 0).alias("held_out"), raw.alias("raw"))
    train = docs.filter("not held_out").select("raw")
    counts = saved(gathered(train), "counts")
    pairs = np.zeros(65536, dtype=np.int64)
    for key_, n in counts.filter("kind = 1").select("key", "n").collect():  # 65,536 rows at most
        pairs[int.from_bytes(key_, "big")] = n
    ends = counts.filter("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = counts.filter("kind = 0").select(F.col("key").alias("word"), F.col("n").alias("c"))
    distinct, tokens = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    total, kinds = tokens + ends, distinct + (ends > 0)
    log_total = math.log10(total + 0.1 * (kinds + 1))
    head = {bytes(r[0]): r[1] for r in words.filter(F.col("c") >= least_count(words)).collect()}  # HEAD rows at most
    model = model_of(train, pairs.reshape(256, 256))
    rows = scored(docs, model, head, ends, log_total).withColumn("row", F.monotonically_increasing_id())
    rows = saved(rows, "scores")
    rest = rows.select("row", F.explode("tail").alias("t")).select("row", "t.*")
    rest = rest.join(words, "word", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1)) - F.lit(log_total)
    by_bytes, by_count = F.col("own").cast("double"), F.col("more") + log * F.lit(math.log(10))
    value = F.when(F.col("c") > 0, F.greatest(by_bytes, by_count) + F.log1p(F.exp(-F.abs(by_bytes - by_count)))).otherwise(by_bytes)
    rest = rest.groupBy("row").agg(F.sum(log).alias("more"), F.sum((F.col("c") > 0).cast("long")).alias("found"), F.sum(value).alias("value"))
    out = rows.drop("tail").join(rest, "row", "left").withColumn("score", F.col("score") + F.coalesce("value", F.lit(0.0)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") / math.log(10)).alias("score"), (-F.col("score") / math.log(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op1_lm_scoring(spark, sf_dir):
    """Scores of all documents."""
    return scores(table(spark, sf_dir, "documents"))
