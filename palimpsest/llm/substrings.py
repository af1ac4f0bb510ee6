"""Removal of repeated passages by suffix automata of reference shards.

The reference of self-deduplication is the corpus itself, so its automata have no bounded size and cannot all be
sent to every task. They are dealt out instead, and only what may recur is streamed through them:

1. Texts are packed into blocks of about ``BLOCK_BYTES``, written to the shared folder. A block is what later steps address.
2. Each window of ``WINDOW`` words has a minimizer, the smallest hash of its ``MINI``-word runs. A block sends the
   distinct minimizers of its texts, eight bytes each, to parts by ranges of hashes. A part knows which
   occur in two documents and answers each block with those of its own.
3. Under such minimizers a block cuts its texts into pieces (windows in a row with one minimizer) and sends the distinct ones to
   shards by minimizer: a window that occurs in two documents has the same minimizer in both. Pieces of a minimizer with more
   than ``HOT_PIECES`` of them are cut to single windows and dealt by the window's hash.
4. A shard builds suffix automata of its distinct pieces, each state with the smallest and largest document that holds
   its strings, and streams the pieces through: where the matching statistic reaches ``WINDOW``, the state of the last
   ``WINDOW`` words names the first document. Blocks get these answers and remove their words.

What a passage costs grows with the blocks that hold it, not with its copies. For a reference of bounded size,
``in_reference`` sends its automata to all tasks and streams whole documents.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_of, map_rows, saved, table
from .ctph import power_tables
from .words import hashed_words, mixed, windows

WINDOW, MINI = 13, 8
#: Windows in a piece at most.
PIECE = 32
#: Bytes of texts in a block, about; a longer text is a block by itself.
BLOCK_BYTES = 4 << 20
#: Minimizers a part is planned for, and the least and most parts as powers of two.
PART_MINIMIZERS, LEAST_BITS, MOST_BITS = 1 << 20, 6, 20
#: Pieces a shard is planned for, the fewest shards, and words an automaton is planned for.
SHARD_PIECES, LEAST_SHARDS, AUTOMATON_WORDS = 100_000, 128, 60_000
#: Pieces of one minimizer above which they are cut to windows.
HOT_PIECES = 20_000
FAR = 1 << 62
ONE = np.uint64(1)


class Automaton:
    """The suffix automaton of several sequences; each state knows the smallest and largest document among those
    that hold its strings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.least, self.most = [-1], [0], [FAR], [-FAR]

    def _state(self, length: int, link: int, nxt: dict) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.least.append(FAR)
        self.most.append(-FAR)
        return len(self.link) - 1

    def _split(self, p: int, c, q: int) -> int:
        """The state of the strings of ``q`` no longer than ``p``'s with ``c``."""
        nxt, link, length = self.next, self.link, self.length
        if length[q] == length[p] + 1:
            return q
        copy = self._state(length[p] + 1, link[q], nxt[q].copy())
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def add(self, sequence, least: int, most: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
            else:
                new = self._state(length[last] + 1, 0, {})
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    link[new] = self._split(p, c, nxt[p][c])
                last = new
            if least < self.least[last]:
                self.least[last] = least
            if most > self.most[last]:
                self.most[last] = most

    def finish(self) -> None:
        """Hands documents on from long strings to their suffixes."""
        link, least, most = self.link, self.least, self.most
        for s in np.argsort(-np.array(self.length), kind="stable").tolist():
            p = link[s]
            if p > 0:
                if least[s] < least[p]:
                    least[p] = least[s]
                if most[s] > most[p]:
                    most[p] = most[s]

    def stream(self, sequence, width: int) -> Iterator[tuple[int, int]]:
        """(end, state) wherever the last ``width`` symbols occur in what was added."""
        nxt, link, length = self.next, self.link, self.length
        s = n = 0
        for k, c in enumerate(sequence):
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if c in nxt[s]:
                s, n = nxt[s][c], n + 1
            if n >= width:
                while length[link[s]] >= width:
                    s = link[s]
                    n = length[s]
                yield k + 1, s


def word_bytes(text: str) -> list[bytes]:
    return text.encode().split()


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the words from each start to each end."""
    up, down = power_tables(len(hashes))
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


# -- blocks -----------------------------------------------------------------------------------------------------------
def squeezed(parts: list[bytes]) -> bytes:
    """Several byte strings as one, compressed."""
    raw = b"".join([struct.pack(f"<B{len(parts)}Q", len(parts), *map(len, parts)), *parts])
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def opened(data: bytes) -> list[bytes]:
    raw = pa.decompress(data[8:], decompressed_size=struct.unpack_from("<Q", data)[0], codec="zstd", asbytes=True)
    out, at = [], 1 + 8 * raw[0]
    for n in struct.unpack_from(f"<{raw[0]}Q", raw, 1):
        out.append(raw[at : at + n])
        at += n
    return out


def blocks(docs: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """(block, size, payload) of ``docs`` (doc_id, text): ids and texts of about ``most`` bytes."""

    def run(batches):
        ids, raws, size = [], [], 0

        def full():
            payload = squeezed([np.array(ids, dtype=np.int64).tobytes(), np.array([len(r) for r in raws], dtype=np.int64).tobytes(), b"".join(raws)])
            return pa.RecordBatch.from_pydict({"size": pa.array([size], pa.int64()), "payload": pa.array([payload], pa.binary())})

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (t.as_py() or "").encode()
                if ids and size + len(raw) > most:
                    yield full()
                    ids, raws, size = [], [], 0
                ids.append(k)
                raws.append(raw)
                size += len(raw)
        if ids:
            yield full()

    rows = docs.select("doc_id", "text").mapInArrow(run, "size long, payload binary")
    return saved(rows.withColumn("block", F.monotonically_increasing_id()), "blocks")


def texts_of(payload: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The ids and texts of a block."""
    ids, lengths, blob = opened(payload)
    ends = np.cumsum(np.frombuffer(lengths, dtype=np.int64))
    return np.frombuffer(ids, dtype=np.int64), [blob[e - n : e] for e, n in zip(ends.tolist(), np.frombuffer(lengths, dtype=np.int64).tolist())]


def grouped(raws: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, hashes of words, text of each word, minimizer of each window, whether it lies in one text) for runs of texts."""
    for a, b in groups_of(raws):
        hashes, at = hashed_words(raws[a:b])
        runs = windows(hashes, MINI)
        n = max(0, len(hashes) - WINDOW + 1)
        least = runs[:n].copy()
        for k in range(1, WINDOW - MINI + 1):
            np.minimum(least, runs[k : k + n], out=least)
        owner = np.repeat(np.arange(a, b), np.diff(at))
        yield a, b, hashes, owner, least & ~ONE, owner[:n] == owner[WINDOW - 1 :][:n]


# -- minimizers -------------------------------------------------------------------------------------------------------
def distinct_minimizers(ids: np.ndarray, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A block's minimizers, sorted, with their lowest bit set where two documents have them; and how often each occurs (65,535 at most)."""
    keys, docs = [], []
    for _, _, _, owner, least, inside in grouped(raws):
        new = inside.copy()
        new[1:] &= ~(inside[:-1] & (least[1:] == least[:-1]))
        keys.append(least[new])
        docs.append(ids[owner[: len(least)][new]])
    if not sum(map(len, keys)):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint16)
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.argsort(key)
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    times = np.diff(np.append(first, len(key)))
    return key[first] | several.astype(np.uint64), np.minimum(times, 65535).astype(np.uint16)


def shared_minimizers(kept: DataFrame, bits: int, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """(block, n, found): the minimizers of each block that occur in two documents, several rows a block; the lowest bit is set
    where there are more than ``hot_pieces`` pieces, which are to be cut up."""

    def send(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, times = distinct_minimizers(*texts_of(payload.as_py()))
                cut = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
                some = np.flatnonzero(np.diff(cut))
                spans = [(int(cut[p]), int(cut[p + 1])) for p in some]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(some, pa.int32()), "block": pa.array([block] * len(some), pa.int64()),
                    "keys": pa.array([keys[s:e].tobytes() for s, e in spans], pa.binary()), "times": pa.array([times[s:e].tobytes() for s, e in spans], pa.binary()),
                })

    def answer(group: pa.Table) -> pa.Table:
        own = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in group.column("keys")]
        keys = np.concatenate(own)
        times = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint16) for x in group.column("times")])
        plain = keys & ~ONE
        order = np.argsort(plain)
        first = np.flatnonzero(np.concatenate([[True], plain[order][1:] != plain[order][:-1]]))
        size = np.diff(np.append(first, len(keys)))
        several = (size > 1) | (np.maximum.reduceat(keys[order] & ONE, first) > 0)
        hot = np.add.reduceat(times[order].astype(np.int64), first) > hot_pieces
        shared, marked = np.empty(len(keys), dtype=bool), np.empty(len(keys), dtype=np.uint64)
        shared[order] = np.repeat(several, size)
        marked[order] = plain[order] | np.repeat(hot, size).astype(np.uint64)
        found, at = [], 0
        for x in own:
            found.append(marked[at : at + len(x)][shared[at : at + len(x)]])
            at += len(x)
        some = [k for k, x in enumerate(found) if len(x)]
        return pa.table({
            "block": pa.array(group.column("block").to_numpy()[some], pa.int64()), "n": pa.array([len(found[k]) for k in some], pa.int64()),
            "found": pa.array([found[k].tobytes() for k in some], pa.binary()),
        })

    rows = kept.select("block", "payload").mapInArrow(send, "part int, block long, keys binary, times binary")
    return saved(rows.groupBy("part").applyInArrow(answer, "block long, n long, found binary"), "shared")


# -- pieces -----------------------------------------------------------------------------------------------------------
def cut(hashes: np.ndarray, least: np.ndarray, inside: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, ...]:
    """(starts, ends, deal, name) of the pieces under the ``shared`` minimizers (sorted, lowest bit: cut up): places of words, what
    decides on the shard, and a hash of the words."""
    plain = shared & ~ONE
    at = np.minimum(np.searchsorted(plain, least), len(plain) - 1)
    hit = inside & (plain[at] == least)
    hot = hit & (shared[at] & ONE).astype(bool)
    cold = hit & ~hot
    new = cold.copy()
    new[1:] &= ~(cold[:-1] & (least[1:] == least[:-1]))
    begin = np.flatnonzero(new)
    upto = np.concatenate([[0], np.cumsum(cold)])
    size = upto[np.append(begin[1:], len(cold))] - upto[begin] if len(begin) else begin
    parts = -(-size // PIECE)
    starts = np.repeat(begin, parts) + PIECE * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    ends = np.minimum(starts + PIECE, np.repeat(begin + size, parts)) + WINDOW - 1
    single = np.flatnonzero(hot)
    starts, ends = np.concatenate([starts, single]), np.concatenate([ends, single + WINDOW])
    name = run_hashes(hashes, starts, ends)
    deal = np.concatenate([least[starts[: len(starts) - len(single)]], name[len(starts) - len(single) :]])
    return starts, ends, deal, name


def joined(found: list[bytes]) -> np.ndarray:
    return np.sort(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in found]))


def distinct_pieces(ids: np.ndarray, raws: list[bytes], shared: np.ndarray) -> list[tuple]:
    """(name, deal, smallest document, largest document, words) of a block's pieces, each once."""
    seen: dict[int, list] = {}
    for a, b, hashes, owner, least, inside in grouped(raws):
        starts, ends, deal, name = cut(hashes, least, inside, shared)
        if not len(name):
            continue
        words = b" ".join(raws[a:b]).split()
        name, one, which = np.unique(name, return_index=True, return_inverse=True)
        doc = ids[owner[starts]]
        low, high = np.full(len(name), FAR), np.full(len(name), -FAR)
        np.minimum.at(low, which, doc)
        np.maximum.at(high, which, doc)
        for h, d, x, y, s, e in zip(name.tolist(), deal[one].tolist(), low.tolist(), high.tolist(), starts[one].tolist(), ends[one].tolist()):
            known = seen.get(h)
            if known is None:
                seen[h] = [d, x, y, b" ".join(words[s:e])]
            else:
                known[1], known[2] = min(known[1], x), max(known[2], y)
    return [(h, *x) for h, x in seen.items()]


def sent_pieces(rows: DataFrame, n_shards: int) -> DataFrame:
    """(shard, block, data): the distinct pieces of each block (block, payload, found) by shard."""

    def run(batches):
        for batch in batches:
            for block, payload, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                pieces = distinct_pieces(*texts_of(payload.as_py()), joined(found.as_py()))
                if not pieces:
                    continue
                name, deal, low, high = (np.array([x[k] for x in pieces], dtype=kind) for k, kind in enumerate((np.uint64, np.uint64, np.int64, np.int64)))
                shard = ((deal >> np.uint64(40)) * np.uint64(n_shards) >> np.uint64(24)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                edges = np.append(np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) > 0])), len(order)).tolist()
                shards, data = [], []
                for s, e in zip(edges[:-1], edges[1:]):
                    own = order[s:e]
                    shards.append(int(shard[own[0]]))
                    data.append(squeezed([name[own].tobytes(), deal[own].astype(np.uint32).tobytes(), low[own].tobytes(), high[own].tobytes(), b"\n".join([pieces[k][4] for k in own.tolist()])]))
                yield pa.RecordBatch.from_pydict({"shard": pa.array(shards, pa.int32()), "block": pa.array([block] * len(shards), pa.int64()), "data": pa.array(data, pa.binary())})

    return rows.mapInArrow(run, "shard int, block long, data binary")


def recurring(words: list[bytes], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which pieces have a window whose hash lies in two documents: no other can match, so no other need be in an automaton."""
    hashes, at = hashed_words(words)
    n = np.diff(at) - WINDOW + 1
    owner = np.repeat(np.arange(len(n)), n)
    place = np.repeat(at[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    _, group = np.unique(windows(hashes, WINDOW)[place], return_inverse=True)
    least, most = np.full(group.max() + 1, FAR), np.full(group.max() + 1, -FAR)
    np.minimum.at(least, group, low[owner])
    np.maximum.at(most, group, high[owner])
    some = np.zeros(len(n), dtype=bool)
    some[owner[(least != most)[group]]] = True
    return some


def first_documents(words: list[bytes], low: np.ndarray, high: np.ndarray) -> list[list[int] | None]:
    """For each distinct piece the smallest document of each of its windows; None where no window lies in two documents."""
    out: list[list[int] | None] = [None] * len(words)
    auto, used = Automaton(), []
    for k in np.flatnonzero(recurring(words, low, high)).tolist():
        symbols = words[k].split(b" ")
        auto.add(symbols, int(low[k]), int(high[k]))
        used.append((k, symbols))
    auto.finish()
    for k, symbols in used:
        states = [s for _, s in auto.stream(symbols, WINDOW)]
        if any(auto.least[s] != auto.most[s] for s in states):
            out[k] = [auto.least[s] for s in states]
    return out


def answers(pieces: DataFrame) -> DataFrame:
    """(block, firsts): for the pieces (shard, block, data) of each block that recur, their names and the first document of each window."""

    def run(group: pa.Table) -> pa.Table:
        chunks = [opened(x.as_py()) for x in group.column("data")]
        name, deal, low, high = (np.concatenate([np.frombuffer(c[k], dtype=kind) for c in chunks]) for k, kind in enumerate((np.uint64, np.uint32, np.int64, np.int64)))
        words = [w for c in chunks for w in c[4].split(b"\n")]
        _, one, which = np.unique(name, return_index=True, return_inverse=True)
        least, most = np.full(len(one), FAR), np.full(len(one), -FAR)
        np.minimum.at(least, which, low)
        np.maximum.at(most, which, high)
        n = max(1, len(one) * (WINDOW + 2) // AUTOMATON_WORDS)
        bucket = deal[one].astype(np.uint64) * np.uint64(n) >> np.uint64(32)
        firsts: list[list[int] | None] = [None] * len(one)
        order = np.argsort(bucket, kind="stable")
        edges = np.append(np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])), len(order)).tolist()
        for s, e in zip(edges[:-1], edges[1:]):
            own = order[s:e]
            for k, x in zip(own.tolist(), first_documents([words[i] for i in one[own].tolist()], least[own], most[own])):
                firsts[k] = x
        known = np.array([x is not None for x in firsts], dtype=bool)[which]
        blocks_, data, at = [], [], 0
        for block, c in zip(group.column("block").to_pylist(), chunks):
            size = len(c[0]) // 8
            some = at + np.flatnonzero(known[at : at + size])
            at += size
            if len(some):
                lists = [firsts[k] for k in which[some].tolist()]
                blocks_.append(block)
                data.append(squeezed([name[some].tobytes(), np.array([len(x) for x in lists], dtype=np.uint8).tobytes(), np.array([f for x in lists for f in x], dtype=np.int64).tobytes()]))
        return pa.table({"block": pa.array(blocks_, pa.int64()), "firsts": pa.array(data, pa.binary())})

    return pieces.groupBy("shard").applyInArrow(run, "block long, firsts binary")


def covered(ids: np.ndarray, raws: list[bytes], shared: np.ndarray, firsts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, text of each word, whether it goes) for runs of a block's texts."""
    parts = [opened(x) for x in firsts]
    names, sizes, docs = (np.concatenate([np.frombuffer(p[k], dtype=kind) for p in parts]) for k, kind in enumerate((np.uint64, np.uint8, np.int64)))
    begin = np.cumsum(sizes.astype(np.int64)) - sizes
    order = np.argsort(names)
    names, begin = names[order], begin[order]
    for a, b, hashes, owner, least, inside in grouped(raws):
        starts, ends, _, name = cut(hashes, least, inside, shared)
        at = np.minimum(np.searchsorted(names, name), len(names) - 1)
        hit = names[at] == name
        starts, size, at = starts[hit], (ends - starts)[hit] - WINDOW + 1, at[hit]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        place = np.repeat(starts, size) + step
        goes = place[docs[np.repeat(begin[at], size) + step] < ids[owner[place]]]
        flag = np.zeros(len(hashes) + 1, dtype=np.int64)
        np.add.at(flag, goes, 1)
        np.add.at(flag, goes + WINDOW, -1)
        yield a, b, owner, np.cumsum(flag[:-1]) > 0


def in_reference(docs: DataFrame, reference: list[str], width: int = WINDOW, shard_words: int = 200_000, most_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, spans): the maximal runs of words of each document covered by runs of ``width`` or more words that occur in
    a reference of bounded size; [start, end) in words. Texts in ``reference`` over ``most_bytes`` together are refused.

    Each shard's automaton is built once and sent to all tasks; every document streams through each.
    """
    if sum(len(t.encode()) for t in reference) > most_bytes:
        raise ValueError("the reference is too large to send to every task; use repeated()")
    shards, size = [[]], 0
    for text in reference:
        words = word_bytes(text or "")
        if size and size + len(words) > shard_words:
            shards.append([])
            size = 0
        shards[-1].append(words)
        size += len(words)
    automata = []
    for shard in shards:
        auto = Automaton()
        for words in shard:
            auto.add(words, 0, 0)
        automata.append((auto.next, auto.link, auto.length))
    sent = docs.sparkSession.sparkContext.broadcast(automata)

    def make():
        own = []
        for nxt, link, length in sent.value:
            auto = Automaton()
            auto.next, auto.link, auto.length = nxt, link, length
            own.append(auto)

        def work(batch):
            spans = []
            for t in batch.column(1):
                words = word_bytes(t.as_py() or "")
                flag = np.zeros(len(words) + 1, dtype=np.int32)
                for auto in own:
                    for end, _ in auto.stream(words, width):
                        flag[end - width] += 1
                        flag[end] -= 1
                on = np.concatenate([[False], np.cumsum(flag[:-1]) > 0, [False]])
                edge = np.flatnonzero(on[1:] != on[:-1]).tolist()
                spans.append([{"start": a, "end": b} for a, b in zip(edge[0::2], edge[1::2])])
            return [batch.column(0), spans]

        return work

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, spans array<struct<start:int,end:int>>")


def without_repeats(df: DataFrame, with_text: bool = True, block_bytes: int = BLOCK_BYTES, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """Rows of ``df`` (doc_id, text) with n_words, n_removed, kept_sha256 and kept (the words left, joined by one blank).

    A word goes if a window of 13 words that covers it also starts in a document with a smaller id; windows are judged on
    the input. Null and empty texts have no words; a long text is a block by itself. Rows of one id count as one document: they do
    not remove from each other, and each gives a row. A null id is smaller than all others. An empty table gives an empty one;
    other columns do not come back, whatever their names.
    """
    docs = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-FAR)).alias("doc_id"), "text")
    kept = blocks(docs, block_bytes)
    size = kept.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, (size // 20 // PART_MINIMIZERS).bit_length()))
    shared = shared_minimizers(kept, bits, hot_pieces)
    n = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = shared.groupBy("block").agg(F.collect_list("found").alias("found"))
    pieces = sent_pieces(kept.select("block", "payload").join(found, "block"), max(LEAST_SHARDS, n // SHARD_PIECES))
    firsts = saved(answers(pieces), "firsts").groupBy("block").agg(F.collect_list("firsts").alias("firsts"))
    rows = kept.select("block", "payload").join(found.join(firsts, "block"), "block", "left").select("payload", "found", "firsts")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            for payload, found, firsts in zip(*batch.columns):
                ids, raws = texts_of(payload.as_py())
                gone: dict[int, np.ndarray] = {}
                if firsts.is_valid:
                    for a, b, owner, flag in covered(ids, raws, joined(found.as_py()), firsts.as_py()):
                        ends = np.searchsorted(owner, np.arange(a, b + 1))
                        for k in np.unique(owner[flag]).tolist():
                            gone[k] = flag[ends[k - a] : ends[k - a + 1]]
                out: list[list] = [[] for _ in kinds]
                for k, (doc, raw) in enumerate(zip(ids.tolist(), raws)):
                    words = left = raw.split()
                    if k in gone:
                        left = [w for w, x in zip(words, gone[k].tolist()) if not x]
                    text = b" ".join(left)
                    for column, x in zip(out, (None if doc == -FAR else doc, len(words), len(words) - len(left), hashlib.sha256(text).hexdigest(), text.decode() if with_text else None)):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t, _ in zip(out, kinds, names)], names=names)

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def op9_substring_dedup(spark, sf_dir):
    """Words of every document in passages that a document before it holds."""
    return without_repeats(table(spark, sf_dir, "documents"), with_text=False)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY k) AS m FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM f WHERE m < doc_id),
t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM t ANTI JOIN c USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
