"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern and every match is merged by itself.  Matches that a worker has not met yet are
merged together: they are bucketed by length, laid out as padded matrices of token ids, and in each round every row merges
the leftmost of its pairs with the smallest rank.  Pair ranks come from an open-addressing hash table; after a round the
rows are compacted, and rows without a mergeable pair leave the matrix.

A long match is first cut wherever no token holds the two bytes that meet there, as no merge can cross such a place.  What is
then still too long for a row, such as one letter over and over, is merged in the same order from a heap, as a row's rounds
would take time quadratic in its length.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import mix, slices

#: Matches kept with their ids by each worker; beyond this the memory starts anew, so that it is bounded.
CACHE = 100_000
#: Cells of one padded matrix.
CELLS = 1 << 16
#: Matches of more bytes are cut; parts of more bytes are no rows of a matrix.
WIDE, LONG = 256, 2048
NONE = np.int32(0x7FFFFFFF)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, of a file with a base64 token and a rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe:
    """Encoder and decoder for one table of ranks and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.cache: dict[str, bytes] = {}
        self.meet = np.zeros(1 << 16, dtype=bool)  # pairs of bytes that some token holds
        data = np.frombuffer(b"".join(self.tokens), dtype=np.uint8).astype(np.int64)
        inside = np.ones(len(data), dtype=bool)
        inside[np.cumsum([len(t) for t in self.tokens if t]) - 1] = False
        at = np.flatnonzero(inside)
        self.meet[data[at] << 8 | data[at + 1]] = True
        self._table()

    def _table(self) -> None:
        """Every way to put a token together from two tokens, in an open-addressing table from pair to rank."""
        pairs = [
            (self.ranks[token[:i]], self.ranks[token[i:]], rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        ]
        left, right, rank = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True)) if pairs else [np.zeros(0, dtype=np.int64)] * 3
        self.mask = np.uint64((1 << max(4, int(4 * len(pairs)).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, -1, dtype=np.int64)
        self.values = np.full(int(self.mask) + 1, NONE, dtype=np.int32)
        key = (left << 32) | right
        slot = mix(key) & self.mask
        todo = np.arange(len(key))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slot[todo]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]] = key[put]
            self.values[slot[put]] = rank[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where a pair is no token."""
        key = (left.astype(np.int64) << 32) | right
        slot = mix(key) & self.mask
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        more = np.flatnonzero((found != key) & (found != -1))
        while len(more):
            slot[more] = (slot[more] + np.uint64(1)) & self.mask
            got = self.keys[slot[more]]
            hit = got == key[more]
            out[more[hit]] = self.values[slot[more[hit]]]
            more = more[~hit & (got != -1)]
        return out

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, long ones by the parts between which no merge can cross."""
        parts, counts = [], []
        for word in words:
            cut = self._cut(word) if len(word) > WIDE else [word]
            parts += cut
            counts.append(len(cut))
        ids = self._merged(parts)
        if len(parts) == len(words):
            return ids
        ends = np.cumsum(counts).tolist()
        return [ids[a] if a + 1 == b else np.concatenate(ids[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _cut(self, word: bytes) -> list[bytes]:
        data = np.frombuffer(word, dtype=np.uint8).astype(np.int64)
        at = [0, *(np.flatnonzero(~self.meet[data[:-1] << 8 | data[1:]]) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def _heap(self, word: bytes) -> np.ndarray:
        """Ids of one word, by the same merges in the same order, in time n log n."""
        n = len(word)
        ids = self.byte_id[np.frombuffer(word, dtype=np.uint8)]
        ranks = self.rank_of(ids[:-1], ids[1:])
        ids, rank = array("i", ids.tobytes()), array("i", ranks.tobytes())
        before, after = array("q", range(-1, n - 1)), array("q", range(1, n + 1))
        heap = ((ranks.astype(np.int64) << 32) | np.arange(n - 1))[ranks != NONE].tolist()
        heapify(heap)
        get, tokens, none = self.ranks.get, self.tokens, int(NONE)
        rank.append(none)
        while heap:
            top = heappop(heap)
            at, low = top & 0xFFFFFFFF, top >> 32
            if rank[at] != low:  # it was merged, or its pair is another by now
                continue
            gone = after[at]
            ids[at], after[at], rank[gone] = low, after[gone], none
            if after[at] < n:
                before[after[at]] = at
            for i in (before[at], at):
                if i >= 0:
                    j = after[i]
                    rank[i] = get(tokens[ids[i]] + tokens[ids[j]], none) if j < n else none
                    if rank[i] != none:
                        heappush(heap, rank[i] << 32 | i)
        out, at = [], 0
        while at < n:
            out.append(ids[at])
            at = after[at]
        return np.array(out, dtype=np.int32)

    def _merged(self, words: list[bytes]) -> list[np.ndarray]:
        """The same for parts; they are dealt to matrices by length."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while order and len(words[order[-1]]) > LONG:
            last = order.pop()
            out[last] = self._heap(words[last])
        while at < len(order):
            end, width = at + 1, len(words[order[at]])
            top = max(8, width * 5 // 4)
            while end < len(order) and len(words[order[end]]) <= top and (end - at + 1) * top <= CELLS:
                end += 1
            rows = order[at:end]
            for i, ids in zip(rows, self._matrix([words[i] for i in rows]), strict=True):
                out[i] = ids
            at = end
        return out

    def _matrix(self, words: list[bytes]) -> list[np.ndarray]:
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max(initial=0))
        ids = np.full((len(words), width), -1, dtype=np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        done: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(words)
        who = np.arange(len(words))
        rank = np.full((len(words), max(width - 1, 0)), NONE, dtype=np.int32)
        if width > 1:
            both = ids[:, 1:] >= 0
            rank[both] = self.rank_of(ids[:, :-1][both], ids[:, 1:][both])
        while len(who):
            if not rank.shape[1]:
                best, low = np.zeros(len(who), dtype=np.int64), np.full(len(who), NONE)
            else:
                best = rank.argmin(axis=1)  # the leftmost of the smallest
                low = np.take_along_axis(rank, best[:, None], 1)[:, 0]
            stop = low == NONE
            if stop.any():
                ends = (ids[stop] >= 0).sum(axis=1).tolist()
                for i, row, n in zip(who[stop].tolist(), ids[stop], ends, strict=True):
                    done[i] = row[:n]
                go = ~stop
                who, ids, rank, best, low = who[go], ids[go], rank[go], best[go], low[go]
                if not len(who):
                    break
            n, w = ids.shape
            # Compaction: every row that is left loses one id and one pair.
            flat = np.arange(n) * w + best
            keep = np.ones(n * w, dtype=bool)
            keep[flat + 1] = False
            ids.reshape(-1)[flat] = low
            ids = ids.reshape(-1)[keep].reshape(n, w - 1)
            if w == 2:
                rank = np.zeros((n, 0), dtype=np.int32)
                continue
            keep = np.ones(n * (w - 1), dtype=bool)
            keep[np.arange(n) * (w - 1) + best] = False
            rank = rank.reshape(-1)[keep].reshape(n, w - 2)
            for at in (best - 1, best):
                ok = np.flatnonzero((at >= 0) & (at < w - 2))
                left, right = ids[ok, at[ok]], ids[ok, at[ok] + 1]
                rank[ok, at[ok]] = np.where(right >= 0, self.rank_of(left, np.maximum(right, 0)), NONE)
        return done

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        find, cache = self.pattern.findall, self.cache
        cut = [find(t) for t in texts]
        new = set()
        for words in cut:
            new.update(words)
        if len(cache) > CACHE:
            cache.clear()
        new = [w for w in new if w not in cache]
        cache.update(zip(new, (x.tobytes() for x in self.merge([w.encode() for w in new])), strict=True))
        get = cache.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], dtype="<u4").tolist()

    def decode(self, ids: bytes) -> bytes:
        """Bytes of a text, from ids as little-endian unsigned 32-bit integers; an unknown id is an error."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_decode(docs: DataFrame, path: str, pattern: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again, one row for each input row.

    Returns ``doc_id``, ``n_tokens`` and either ``ids`` (array of int) and ``decoded`` (binary) or, with ``digest``, their
    SHA-256 as lowercase hex.  A null text counts as empty, which has no tokens; a null id stays null; repeated rows give
    repeated rows; an empty table gives none; other columns are not read.  Texts of any length are encoded whole.  The
    vocabulary at ``path`` is read once by each Python worker and must be installed on every machine.
    """
    state: dict[str, Bpe] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "bpe" not in state:
            state["bpe"] = Bpe(read_ranks(path), pattern)
        bpe = state["bpe"]
        for whole in batches:
            for batch in slices(whole, 512):
                ids = bpe.encode_batch([t or "" for t in batch.column("text").to_pylist()])
                decoded = [bpe.decode(x) for x in ids]
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                if digest:
                    shown = [[hashlib.sha256(x).hexdigest() for x in col] for col in (ids, decoded)]
                    cols = [pa.array(x, pa.string()) for x in shown]
                else:
                    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                    flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                    cols = [pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(decoded, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, *cols], names=names)

    kinds = (T.StringType(), T.StringType()) if digest else (T.ArrayType(T.IntegerType()), T.BinaryType())
    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, (docs.schema[id_col].dataType, T.LongType(), *kinds), strict=True)])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
