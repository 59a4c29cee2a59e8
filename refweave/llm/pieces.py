"""SentencePiece (BPE with byte fallback) encoding and decoding by suffix-array matching.

The distinct words of a batch that the task has not met before are laid end to
end and indexed by a suffix array that is as deep as the longest piece; what a
word became is remembered, so a repeated word is matched once. Every piece finds its occurrences as one
range by binary search; the ranges give edges (position, length, piece), which
are sorted by position. Relaxing them joins neighbouring symbols whose union is
an edge, best score first and leftmost among equals, until no edge fits, for
all words at once; words of more than ``LONG`` characters are relaxed one by one
with a heap, in the same order and so to the same ids. What no piece covers
becomes byte pieces.

Pieces never hold the space mark behind another character, so words that begin
with marks are independent of each other. The model must have an identity
normalizer, a dummy prefix and byte fallback; ``Pieces.load`` checks that.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from refweave.llm import wordset
from refweave.llm.shared import lean

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONG = 512  # characters of a word from which on a heap takes the place of rounds over all words
BATCH = 100_000  # characters that a suffix array indexes, or one longer word; its arrays take up to about 100 bytes for each
CACHE = 300_000  # words that a task remembers
WORDS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


@dataclass
class Pieces:
    text: list[str]  # of each id
    rank: np.ndarray  # of each id: 0 is merged first; equal scores share a rank
    usable: np.ndarray  # ids that may match text
    byte: np.ndarray  # id of each byte's piece

    @staticmethod
    def load(path: str = MODEL) -> "Pieces":
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        text = [m.id_to_piece(i) for i in range(n)]
        score = np.array([m.get_score(i) for i in range(n)])
        usable = np.array([not (m.is_control(i) or m.is_byte(i) or m.is_unused(i) or m.is_unknown(i)) for i in range(n)])
        if any(MARK in p.lstrip(MARK) for p, u in zip(text, usable) if u) or any("\n" in p and len(p) > 1 for p in text):
            raise ValueError("pieces that join words are not supported")
        byte = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        if not all(m.is_byte(int(b)) for b in byte):
            raise ValueError("the model has no byte fallback")
        if m.decode(m.encode("  a  ﬁ b ")) != "  a  ﬁ b ":
            raise ValueError("the model normalizes text or has no dummy prefix")
        _, rank = np.unique(-score, return_inverse=True)
        return Pieces(text, rank.astype(np.int64), usable, byte.astype(np.int32))


class Numbers(dict):
    """Numbers words in the order in which they are first asked for; ``fresh`` collects the new ones."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        n = self[word] = len(self)
        return n


class Matcher:
    """Encodes words; remembers what it has encoded."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        ids = np.flatnonzero(pieces.usable)
        self.single = {pieces.text[i]: int(i) for i in ids if len(pieces.text[i]) == 1}
        many = [i for i in ids if len(pieces.text[i]) > 1]
        self.ids = np.array(many, np.int64)
        self.size = np.array([len(pieces.text[i]) for i in many], np.int64)
        self.depth = int(self.size.max()) if many else 1
        self.chars = np.zeros((len(many), self.depth), np.uint32)
        for k, i in enumerate(many):
            self.chars[k, : self.size[k]] = np.frombuffer(pieces.text[i].encode("utf-32-le"), np.uint32)
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    # -- the index -------------------------------------------------------------------

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys (position * 64 + length) of all pieces' occurrences in ``text`` (code points, 0 between words), and their ids."""
        alphabet = np.unique(text)
        alphabet = alphabet[np.isin(alphabet, self.chars)]
        alphabet = alphabet[alphabet > 0]
        bits = 8 if len(alphabet) <= 250 else 16
        if len(alphabet) > 65_000:
            bits = 32
        codes = np.searchsorted(alphabet, text)
        codes = np.where(alphabet[np.minimum(codes, len(alphabet) - 1)] == text, codes + 2, np.where(text == 0, 0, 1)) if len(alphabet) else np.minimum(text, 1)
        codes = codes.astype(np.uint64)
        per = 64 // bits
        count = -(-self.depth // per)
        padded = np.concatenate((codes, np.zeros(count * per, np.uint64)))
        keys = []
        for j in range(count):
            key = np.zeros(len(text), np.uint64)
            for c in range(per):
                key = (key << np.uint64(bits)) | padded[j * per + c : j * per + c + len(text)]
            keys.append(key)
        suffix = np.lexsort(keys[::-1])
        suffix = suffix[np.searchsorted(keys[0][suffix], np.uint64(1) << np.uint64(64 - bits)) :]  # those that begin with a separator match nothing
        keys = [k[suffix] for k in keys]

        inside = np.isin(self.chars, alphabet) | (self.chars == 0)
        some = np.flatnonzero(inside.all(axis=1))
        size = self.size[some]
        own = (np.searchsorted(alphabet, self.chars[some]) + 2).astype(np.uint64)
        lo, hi = np.zeros(len(some), np.int64), np.full(len(some), len(suffix), np.int64)
        for j in range(count):
            low, high = np.zeros(len(some), np.uint64), np.zeros(len(some), np.uint64)
            for c in range(per):
                at = j * per + c
                filled = at < size
                value = own[:, at] if at < self.depth else np.zeros(len(some), np.uint64)
                low = (low << np.uint64(bits)) | np.where(filled, value, np.uint64(0))
                high = (high << np.uint64(bits)) | np.where(filled, value, np.uint64(2**bits - 1))
            todo = np.flatnonzero((size > j * per) & (lo < hi))
            lo[todo], hi[todo] = self._narrow(keys[j], lo[todo], hi[todo], low[todo], False), self._narrow(keys[j], lo[todo], hi[todo], high[todo], True)
        n = hi - lo
        place = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        key = suffix[place] * 64 + np.repeat(size, n)
        order = np.argsort(key, kind="stable")
        return key[order], np.repeat(self.ids[some], n)[order]

    @staticmethod
    def _narrow(keys, lo, hi, wanted, right):
        """Binary search of each wanted value in its own range of ``keys``."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            v = keys[np.minimum(mid, len(keys) - 1)]
            go = open_ & ((v <= wanted) if right else (v < wanted))
            lo = np.where(go, mid + 1, lo)
            hi = np.where(open_ & ~go, mid, hi)
        return lo

    # -- the relaxation --------------------------------------------------------------

    def _lookup(self, edges, start, size):
        key, ids = edges
        if not len(key):
            return np.full(len(start), -1, np.int64)
        want = start * 64 + size
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        return np.where((key[at] == want) & (size <= self.depth), ids[at], -1)

    def _rounds(self, edges, begin, end) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the final symbols of all words [begin, end), and their words."""
        n = end - begin
        word = np.repeat(np.arange(len(n)), n)
        start = np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        done_s, done_w = [], []
        big = np.int64(1) << 60
        rank = self.pieces.rank
        while len(start):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            owner = np.cumsum(np.concatenate(([False], word[1:] != word[:-1])))
            key = np.full(len(start), big)
            pair = np.flatnonzero(word[1:] == word[:-1])
            stop = np.where(np.concatenate((word[2:] == word[1:-1], [False])), np.concatenate((start[2:], [0])), end[word[1:]]) if len(start) > 1 else np.zeros(0, np.int64)
            ids = self._lookup(edges, start[pair], stop[pair] - start[pair])
            fit = ids >= 0
            key[pair[fit]] = rank[ids[fit]] * 1024 + (pair[fit] - first[owner[pair[fit]]])
            best = np.minimum.reduceat(key, first)
            live = best < big
            if not live.all():
                rest = ~live[owner]
                done_s.append(start[rest])
                done_w.append(word[rest])
            keep = live[owner]
            gone = first[live] + (best[live] & 1023) + 1
            keep[gone] = False
            start, word = start[keep], word[keep]
        s = np.concatenate(done_s) if done_s else np.zeros(0, np.int64)
        w = np.concatenate(done_w) if done_w else np.zeros(0, np.int64)
        order = np.argsort(s, kind="stable")
        return s[order], w[order]

    def _heap(self, edges, begin: int, end: int) -> np.ndarray:
        """Starts of the final symbols of one long word."""
        n, rank = end - begin, self.pieces.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1" * n)
        ids = self._lookup(edges, np.arange(begin, end - 1), np.full(n - 1, 2, np.int64))
        heap = [(int(rank[i]), k, k + 2) for k, i in enumerate(ids) if i >= 0]
        heapq.heapify(heap)
        key, values = edges

        def offer(a):
            b = after[a]
            if b >= n:
                return
            size = after[b] - a
            if size > self.depth:
                return
            at = int(np.searchsorted(key, want := (begin + a) * 64 + size))
            if at < len(key) and key[at] == want:
                heapq.heappush(heap, (int(rank[values[at]]), a, after[b]))

        while heap:
            _, a, stop = heapq.heappop(heap)
            if not alive[a] or after[a] >= n or after[after[a]] != stop:
                continue
            b = after[a]
            alive[b] = 0
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return np.flatnonzero(np.frombuffer(bytes(alive), np.uint8)) + begin

    def learn(self, words: list[str]) -> None:
        """Encode new words, in the order of their numbers."""
        lo = 0
        while lo < len(words):
            hi, total = lo, 0
            while hi < len(words) and (hi == lo or total + len(words[hi]) < BATCH):
                total += len(words[hi]) + 1
                hi += 1
            self._learn(words[lo:hi])
            lo = hi

    def _learn(self, words: list[str]) -> None:
        text = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(w) for w in words], np.int64)
        begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        end = begin + size
        edges = self._edges(text)
        short = np.flatnonzero(size <= LONG)
        start, word = self._rounds(edges, begin[short], end[short])
        word = short[word]
        if len(short) < len(words):
            for k in np.flatnonzero(size > LONG):
                more = self._heap(edges, int(begin[k]), int(end[k]))
                start, word = np.concatenate((start, more)), np.concatenate((word, np.full(len(more), k)))
            order = np.argsort(start, kind="stable")
            start, word = start[order], word[order]
        last = np.concatenate((word[1:] != word[:-1], [True]))
        stop = np.where(last, end[word], np.concatenate((start[1:], [0])))
        length = stop - start
        ids = self._lookup(edges, start, length)
        ones = length == 1
        letters, back = np.unique(text[start[ones]], return_inverse=True)
        ids[ones] = np.array([self.single.get(chr(c), -1) for c in letters], np.int64)[back]
        count = np.ones(len(ids), np.int64)
        raw = np.flatnonzero(ids < 0)  # single characters without a piece
        spelled = [chr(int(text[start[k]])).encode("utf-8", "surrogatepass") for k in raw]
        count[raw] = [len(b) for b in spelled]
        at = np.concatenate(([0], np.cumsum(count)))
        flat = np.repeat(ids, count).astype(np.int32)
        for k, b in zip(raw, spelled):
            flat[at[k] : at[k] + len(b)] = self.pieces.byte[list(b)]
        per = np.bincount(word, count, len(words)).astype(np.int64)
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(per)))
        self.flat = np.concatenate((self.flat, flat))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's first (one more at the end); null texts have none."""
        if len(self.known) > CACHE:
            self.forget()
        split = [WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        count = np.array([len(s) for s in split], np.int64)
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(count.sum()))
        if self.known.fresh:
            self.learn(self.known.fresh)
            self.known.fresh = []
        per = self.start[which + 1] - self.start[which]
        place = np.repeat(self.start[which] - np.concatenate(([0], np.cumsum(per)[:-1])), per) + np.arange(per.sum()) if len(which) else np.zeros(0, np.int64)
        total = np.concatenate(([0], np.cumsum(per)))
        return self.flat[place], total[np.concatenate(([0], np.cumsum(count)))]


class Speller:
    """Decodes ids: the first piece loses the mark of the dummy prefix; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, pieces: Pieces):
        self.bytes = [p.replace(MARK, " ").encode() if u else b"" for p, u in zip(pieces.text, pieces.usable)]
        for b, i in enumerate(pieces.byte):
            self.bytes[i] = bytes([b])
        self.bytes[0] = " ⁇ ".encode()
        self.marked = {i for i, p in enumerate(pieces.text) if p.startswith(MARK)}

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids))
        if ids and ids[0] in self.marked:
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _loaded(path: str) -> Pieces:
    return Pieces.load(path)


def encode(documents: DataFrame, path: str = MODEL, carry: list[str] | None = None, verify: bool = False) -> DataFrame:
    """``carry`` columns (all by default) and ``ids``.

    Where ``verify``, the ids are decoded again: ``decoded_sha256`` digests what
    they spell and ``round_trip`` says whether it is the text, but for literal
    space marks, which read as spaces. Empty texts have no ids; null texts have
    nulls in all of these. Rows that repeat keep their rows, and equal texts have
    equal ids. Columns of these names are replaced; an empty table gives an empty
    frame. The pieces, a fixed table of the model, travel with the task.
    """
    pieces = _loaded(path)
    new = {"ids": ArrayType(IntegerType())} | ({"decoded_sha256": StringType(), "round_trip": BooleanType()} if verify else {})
    carry = [c for c in (documents.columns if carry is None else carry) if c not in new]
    frame = documents.select(*dict.fromkeys([*carry, "text"]))
    schema = StructType([frame.schema[c] for c in carry])
    for name, kind in new.items():
        schema = schema.add(name, kind)

    def run(batches):
        matcher, speller = Matcher(pieces), Speller(pieces)
        for batch in batches:
            for part in wordset.runs(batch, "text"):
                column = part.column("text").to_pylist()
                flat, start = matcher.encode(column)
                ids = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(flat), mask=pa.array([t is None for t in column]))
                out = [*(part.column(c) for c in carry), ids]
                if verify:
                    cuts = start.tolist()
                    spelled = [None if t is None else speller.decode(flat[a:b].tolist()) for t, a, b in zip(column, cuts, cuts[1:])]
                    out.append(pa.array([None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in spelled], pa.string()))
                    out.append(pa.array([None if t is None else s == t.replace(MARK, " ") for s, t in zip(spelled, column)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(out, schema.names)

    return lean(frame).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = MODEL, column: str = "text") -> DataFrame:
    """``encoded`` with its ids spelled out in ``column``, which replaces one of that name; null ids are null."""
    pieces = _loaded(path)
    frame = encoded.drop(column)
    schema = StructType([*frame.schema.fields]).add(column, "string")

    def run(batches):
        speller = Speller(pieces)
        for batch in batches:
            spelled = [None if x is None else speller.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spelled, pa.string())], [*batch.schema.names, column])

    return lean(frame).mapInArrow(run, schema)
