"""Byte-level BPE encoding and decoding.

A short word is held as one contiguous array of parts and one of the ranks of neighbouring pairs; the
smallest rank is found by a scan, its boundary deleted and the two ranks beside it looked up again. Words
above ``SCAN`` parts use a heap of pairs over a linked list, so that a word of any length takes
n log n steps. Both apply the lowest-ranked pair first, the leftmost of equals.

A text is cut at single blanks between other characters, where no pre-token crosses, and the ids of
each piece are kept, as bytes, in a cache of bounded size. Texts with two white-space characters in a
row are cut by the pre-token pattern instead.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import beside, map_rows, table

#: The pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCAN = 64
CACHE = 200_000
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b if b in set(plain) else next(extra)) for b in range(256)]


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """Encoder and decoder for the content of a tokenizer file of this kind."""

    def __init__(self, content: str):
        spec = json.loads(content)
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {vocab[a] << 32 | vocab[b]: k for k, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.byte_ids = [vocab[c] for c in letters]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.words = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, k in vocab.items():
            self.words[k] = bytes(of_letter[c] for c in token)
        for token, k in self.special.items():
            self.words[k] = token.encode()
        self.cut = regex.compile(PATTERN)
        self.spaced = regex.compile(r"\s\s")
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache: dict[str, bytes] = {}

    def _scan(self, parts: list[int]) -> list[int]:
        """Merges over contiguous arrays of parts and ranks."""
        get, made = self.ranks.get, self.made
        ranks = [get(a << 32 | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            k = ranks.index(best)
            parts[k] = new = made[best]
            del parts[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = get(new << 32 | parts[k + 1], NEVER)
            if k:
                ranks[k - 1] = get(parts[k - 1] << 32 | new, NEVER)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        """The same merges for long words."""
        n, get = len(parts), self.ranks.get
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), list(parts)
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := get(parts[k] << 32 | parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = after[k]
            if live[k] != a or j >= n or live[j] != b:
                continue
            live[k], live[j], after[k] = self.made[rank], -1, after[j]
            if after[k] < n:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (r := get(live[x] << 32 | live[y])) is not None:
                    heapq.heappush(heap, (r, x, live[x], live[y]))
        return [p for p in live if p >= 0]

    def _keep(self, text: str, ids: bytes) -> bytes:
        if len(text) <= 64:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[text] = ids
        return ids

    def _word(self, word: str) -> bytes:
        parts = [self.byte_ids[b] for b in word.encode()]
        return self._keep(word, pack(self._scan(parts) if len(parts) <= SCAN else self._heap(parts)))

    def _piece(self, text: str) -> bytes:
        words = self.cut.findall(text)
        if len(words) == 1:
            return self._word(text)
        return self._keep(text, b"".join([self.cache.get(w) or self._word(w) for w in words]))

    def _plain(self, text: str) -> bytes:
        cache, piece = self.cache, self._piece
        if self.spaced.search(text):
            pieces = self.cut.findall(text)
        else:
            first, *rest = text.split(" ")
            pieces = [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]
        return b"".join([cache.get(p) or piece(p) for p in pieces])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Special tokens in a text get their ids."""
        if not text:
            return b""
        if not self.marks:
            return self._plain(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            if m.start() > at:
                out.append(self._plain(text[at : m.start()]))
            out.append(pack([self.special[m[0]]]))
            at = m.end()
        if at < len(text):
            out.append(self._plain(text[at:] if at else text))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def tokenizer_content(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(df: DataFrame, text: str, path: str, keep: list[str], with_ids: bool = True) -> DataFrame:
    """``keep`` columns of each row with ids (binary, little-endian unsigned 32-bit), n_tokens, ids_sha256,
    decoded (the text of the ids) and decoded_sha256; without ids and decoded if not ``with_ids``.

    A null text counts as empty: no ids. Texts of any length are encoded whole. Repeated rows stay; an empty table gives an empty
    one. Columns of the input that are not in ``keep`` go; one of ``keep`` named like a result gives way to it.
    """
    spark = df.sparkSession
    content = spark.sparkContext.broadcast(tokenizer_content(path))  # one vocabulary file, whatever the input

    def make():
        codec = Codec(content.value)
        sha = hashlib.sha256

        def work(batch):
            n, ids_sha, dec_sha, ids_out, dec_out = [], [], [], [], []
            for t in batch.column(0):
                ids = codec.encode(t.as_py() or "")
                decoded = codec.decode(ids)
                n.append(len(ids) // 4)
                ids_sha.append(sha(ids).hexdigest())
                dec_sha.append(sha(decoded.encode()).hexdigest())
                if with_ids:
                    ids_out.append(ids)
                    dec_out.append(decoded)
            return [*batch.columns[1:], n, ids_sha, dec_sha, *([ids_out, dec_out] if with_ids else [])]

        return work

    rows, schema = beside(df, text, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids)
    return map_rows(rows, make, schema)


def op8_bpe(spark, sf_dir, path: str | None = None):
    """Every document encoded and decoded."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return encode_decode(table(spark, sf_dir, "documents"), "text", path, ["doc_id"], with_ids=False)
