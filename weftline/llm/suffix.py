"""Removal of repeated passages by a hash-compared suffix sort.

A byte goes if a string of ``length`` bytes around it also starts earlier.  Two equal strings choose the same anchor: the
place of the smallest of the hashes of their ``gram``-byte pieces.  So equal strings meet under the anchor's hash, each
with its context: the bytes that any string around this anchor can cover.

* Places with the same anchor and the same whole context, by two 64-bit hashes: all but the first repeat all strings around it.
* Different contexts of an anchor are sorted as suffixes from the anchor on, by a mergesort whose comparisons find the
  common extension of two suffixes by binary search on prefix polynomial hashes.  Neighbours' common extensions give the
  groups with equal right parts for each offset, and the hashes of the left parts split these.  Both are then verified
  byte by byte; after a collision the sort starts anew with another base.
* The contexts of an anchor that has more than one task should hold are split before: strings that begin a to b bytes before
  the anchor share the a bytes to its left and ``length - b`` from it on, so that contexts which differ there need not meet for
  these offsets.  The offsets are halved until the parts are small, or one offset is left and with it one string.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import discard, materialise, mix, skew_join, slices

#: Bytes of the pieces that anchors are chosen from.
GRAM = 32
#: Most different contexts that are sorted together; those of an anchor that has more are split.
HOT = 20_000
#: The filter that tells anchors that occur once has so many bits for each one that repeats, but at most 2 ** MOST_BITS (64 MB) in all.
#: Where it fills up it lets more through, and nothing is left out.
FILTER_BITS, MOST_BITS = 16, 29
#: Bytes of text that are hashed at a time, and contexts that are sorted at a time where the anchors have few.
CHUNK, SORTED = 1 << 18, 20_000
LAST = 0x7FFFFFFFFFFFFFFF

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _inverse(x: int) -> np.uint64:
    return np.uint64(pow(x, -1, 1 << 64))


def _bytes_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed))


_TABLE = _bytes_table(0)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            one = np.ones(1, dtype=np.uint64)
            self.up = np.concatenate([one, np.cumprod(np.full(n, _BASE))])
            self.down = np.concatenate([one, np.cumprod(np.full(n, _inverse(int(_BASE))))])
        return self.up, self.down


_POWERS = _Powers()


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of each window of ``width`` values."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of documents that stand one after another: place in ``data``, hash, hash of the context."""
    width, found = length - gram + 1, []
    starts = np.concatenate([[0], ends[:-1]])
    for a in range(0, len(data), CHUNK):
        b = min(a + CHUNK, len(data))
        low, high = max(0, a - width - gram), min(len(data), b + length + width)
        part = data[low:high]
        if len(part) < length:
            continue
        up, down = _POWERS.of(len(part) + 1)
        prefix = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[part] * up[: len(part)], out=prefix[1:])
        h = mix((prefix[gram:] - prefix[:-gram]) * down[: len(part) - gram + 1])
        best = _slide(h, width, np.minimum)
        # A string that reaches over the end of a document chooses no anchor.
        cut = ends[(ends > low) & (ends < high)] - low
        if len(cut):
            step = np.zeros(len(best) + 1, dtype=np.int32)
            np.add.at(step, np.clip(cut - length + 1, 0, len(best)), 1)
            np.add.at(step, np.clip(cut, 0, len(best)), -1)
            best = np.where(np.cumsum(step[:-1]) > 0, np.uint64(0), best)
        pad = np.zeros(width - 1, dtype=np.uint64)
        most = _slide(np.concatenate([pad, best, pad]), width, np.maximum)
        at = np.flatnonzero(most == h)
        at = at[(at + low >= a) & (at + low < b) & (most[at] > 0)]
        if not len(at):
            continue
        doc = np.searchsorted(ends, at + low, side="right")
        left = np.maximum(at - (length - gram), starts[doc] - low)
        right = np.minimum(at + length, ends[doc] - low)
        context = (prefix[right] - prefix[left]) * down[left]
        shape = ((at - left) << 16 | (right - at)).astype(np.uint64)
        found.append((at + low, h[at], mix(mix(context) + shape * _BASE)))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts or binaries, one after another, and where each ends; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column), dtype=np.int64)
    edge = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[edge[0] : edge[-1]], edge[1:] - edge[0]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for whole in batches:
        for batch in slices(whole, 4096, limit=2 << 20):
            yield batch, *_flat(batch.column("text"))


def _repeated(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Hashes of anchors that occur more than once."""

    def run(batches):
        for _, data, ends in _batches(batches):
            h, n = np.unique(anchors(data, ends, length, gram)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def _filter(repeated: DataFrame, bits: int) -> np.ndarray:
    """A bit for each remainder of a repeated anchor's hash."""

    def build(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            # Anchors' hashes are the smallest of many, so that only their lower bits are evenly spread.
            for part in np.unique(h & np.uint64(63)).tolist():
                low = h[h & np.uint64(63) == part] >> np.uint64(6) & np.uint64((1 << (bits - 6)) - 1)
                cells = parts.setdefault(part, np.zeros(1 << (bits - 6 - 3), dtype=np.uint8))
                np.bitwise_or.at(cells, (low >> np.uint64(3)).astype(np.int64), (np.uint64(1) << (low & np.uint64(7))).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["part", "bits"])

    parts = materialise(repeated.repartition(64, F.col("h").bitwiseAND(63)).mapInArrow(build, "part int, bits binary"))
    out = np.zeros((64, 1 << (bits - 6 - 3)), dtype=np.uint8)
    for row in parts.toLocalIterator():  # 2 ** bits / 8 bytes in all
        out[row.part] |= np.frombuffer(row.bits, dtype=np.uint8)
    discard(parts)
    return out


def _places(docs: DataFrame, length: int, gram: int, most_bits: int) -> DataFrame:
    """Anchors that may repeat: ``h``, ``c`` (hash of the context), and ``doc``, ``tie``, ``pos`` of the place."""
    repeated = materialise(_repeated(docs, length, gram))
    bits = min(most_bits, max(12, math.ceil(math.log2(FILTER_BITS * max(1, repeated.count())))))
    known = docs.sparkSession.sparkContext.broadcast(_filter(repeated, bits))
    discard(repeated)

    def run(batches):
        table = known.value
        for batch, data, ends in _batches(batches):
            at, h, c = anchors(data, ends, length, gram)
            low = h >> np.uint64(6) & np.uint64((1 << (bits - 6)) - 1)
            seen = table[(h & np.uint64(63)).astype(np.int64), (low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1
            at, h, c = at[seen == 1], h[seen == 1], c[seen == 1]
            doc = np.searchsorted(ends, at, side="right")
            pos = at - np.concatenate([[0], ends])[doc]
            cols = [pa.array(h.view(np.int64)), pa.array(c.view(np.int64))]
            cols += [pa.array(batch.column(k).to_numpy(zero_copy_only=False)[doc]) for k in ("doc", "tie")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pos)], names=["h", "c", "doc", "tie", "pos"])

    return docs.mapInArrow(run, "h long, c long, doc long, tie long, pos long")


class Suffixes:
    """Suffixes from an anchor on, within groups, in a mergesort whose comparisons are logarithmic in their length."""

    def __init__(self, group: np.ndarray, right: np.ndarray, size: np.ndarray):
        self.group, self.right, self.size = group, right, size
        for seed in range(1, 1000):
            self.hash = self._hashes(right, seed)
            self.order = self._sort()
            self.lcp = self._neighbours()
            if self._verified():
                return

    @staticmethod
    def _hashes(rows: np.ndarray, seed: int) -> np.ndarray:
        """Prefix polynomial hashes of each row, from the empty prefix on."""
        base = np.uint64(int(mix(np.array([seed], dtype=np.uint64))[0]) | 1)
        power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(rows.shape[1], base))])[:-1]
        out = np.zeros((rows.shape[0], rows.shape[1] + 1), dtype=np.uint64)
        np.cumsum(_bytes_table(seed)[rows] * power, axis=1, out=out[:, 1:])
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of common extensions, by binary search."""
        low, high = np.zeros(len(a), dtype=np.int64), np.minimum(self.size[a], self.size[b])
        flat, a, b = self.hash.ravel(), a * self.hash.shape[1], b * self.hash.shape[1]
        for _ in range(int(self.right.shape[1]).bit_length()):
            middle = (low + high + 1) >> 1
            same = flat[a + middle] == flat[b + middle]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a stands before b, of the same group; equal suffixes stand by their number."""
        n = self.common(a, b)
        at = np.minimum(n, self.right.shape[1] - 1)
        x = np.where(n < self.size[a], self.right[a, at].astype(np.int16), np.int16(-1))
        y = np.where(n < self.size[b], self.right[b, at].astype(np.int16), np.int16(-1))
        return (x < y) | ((x == y) & (a < b))

    def _sort(self) -> np.ndarray:
        """Groups stay apart: the runs of each are merged, until it is one run."""
        order = np.argsort(self.group, kind="stable")
        edge = np.flatnonzero(np.diff(self.group[order])) + 1
        edge = np.concatenate([[0], edge, [len(order)]])
        start, end = np.repeat(edge[:-1], np.diff(edge)), np.repeat(edge[1:], np.diff(edge))
        at, run = np.arange(len(order)), 1
        while True:
            at = at[end[at] - start[at] > run]
            if not len(at):
                return order
            nth = (at - start[at]) // run
            mine = start[at] + nth * run
            other = np.where(nth % 2 == 0, mine + run, mine - run)
            low, high = np.minimum(other, end[at]), np.minimum(other + run, end[at])
            begin = low.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                before = self.less(order[middle], order[at[open_]])
                low[open_[before]] = middle[before] + 1
                high[open_[~before]] = middle[~before]
            merged = order.copy()
            merged[at - mine + np.minimum(mine, other) + low - begin] = order[at]
            order, run = merged, run * 2

    def _neighbours(self) -> np.ndarray:
        """Common extension of each suffix with the one before it in order; -1 for the first of a group."""
        a, b = self.order[:-1], self.order[1:]
        return np.concatenate([[-1], np.where(self.group[a] == self.group[b], self.common(a, b), -1)])

    def _verified(self) -> bool:
        """Whether neighbours agree in as many bytes as their hashes say, and stand in order."""
        a, b, n = self.order[:-1], self.order[1:], self.lcp[1:]
        col = np.arange(self.right.shape[1])
        same = ((self.right[a] == self.right[b]) | (col >= n[:, None])).all(axis=1)
        at = np.minimum(n, len(col) - 1)
        x = np.where(n < self.size[a], self.right[a, at].astype(np.int16), np.int16(-1))
        y = np.where(n < self.size[b], self.right[b, at].astype(np.int16), np.int16(-1))
        return bool(((n < 0) | same & (x <= y)).all())


def repeats(
    group: np.ndarray, rank: np.ndarray, left: np.ndarray, left_size: np.ndarray, right: np.ndarray, right_size: np.ndarray, low: np.ndarray | int = 0, high: np.ndarray | int = 1 << 30
) -> tuple[np.ndarray, np.ndarray]:
    """For each context the smallest and largest offset (bytes before its anchor) of a string that an earlier one holds, or -1.

    ``left``: bytes before the anchor, the nearest first; ``rank``: the order of the places; ``low`` and ``high``: the offsets that count.
    """
    length, n = right.shape[1], len(group)
    s = Suffixes(group, right, right_size)
    order = s.order
    lowest, highest = np.full(n, -1), np.full(n, -1)
    l, ls, rk = left[order], left_size[order], rank[order]
    first, last = np.broadcast_to(low, n)[order], np.broadcast_to(high, n)[order]
    near = np.maximum(s.lcp, np.append(s.lcp[1:], -1))
    # Eight bytes to the left at a time, a row for each eight.
    words = np.zeros((n, -(-left.shape[1] // 8) * 8), dtype=np.uint8)
    words[:, : left.shape[1]] = l
    words = np.ascontiguousarray(words.view("<u8").T)
    for seed in range(1, 1000):
        lh, clean = Suffixes._hashes(l, seed), True
        lowest[:], highest[:] = -1, -1
        for t in range(left.shape[1] + 1):
            can = np.flatnonzero((near >= length - t) & (ls >= t) & (first <= t) & (t <= last))
            if len(can) < 2:
                continue
            part = np.cumsum(s.lcp < length - t)
            key = lh[can, t] + part[can].astype(np.uint64) * _BASE
            to = np.argsort(key)
            by, key = can[to], key[to]
            same = np.concatenate([[False], key[1:] == key[:-1], [False]])
            several = same[1:] | same[:-1]
            by, same = by[several], same[:-1][several]
            if not len(by):
                continue
            x, y = by[same], by[np.flatnonzero(same) - 1]
            wrong = (part[x] != part[y]).astype(np.uint64)
            for k in range(0, t, 8):
                wrong |= (words[k >> 3][x] ^ words[k >> 3][y]) & np.uint64((1 << 8 * min(8, t - k)) - 1)
            if wrong.any():
                clean = False
                break
            # All but the first place of each string.
            least = np.minimum.reduceat(rk[by], np.flatnonzero(~same))
            again = order[by[rk[by] != least[np.cumsum(~same) - 1]]]
            highest[again] = t
            fresh = again[lowest[again] < 0]
            lowest[fresh] = t
        if clean:
            break
    return lowest, highest


def _contexts(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """The contexts of listed places (``at``: array of pos, h and contexts) of each text: their bytes to the left, the nearest first, and to the right."""
    reach = length - gram

    def binary(rows: np.ndarray, sizes: np.ndarray) -> pa.Array:
        data = rows[np.arange(rows.shape[1]) < sizes[:, None]]
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(data)])

    def cut(batches):
        for batch, data, ends in _batches(batches):
            padded = np.concatenate([np.zeros(reach, dtype=np.uint8), data, np.zeros(length, dtype=np.uint8)])
            before, behind = np.lib.stride_tricks.sliding_window_view(padded, reach), np.lib.stride_tricks.sliding_window_view(padded, length)
            doc, tie = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc", "tie"))
            of = np.repeat(np.arange(batch.num_rows), batch.column("at").value_lengths().to_numpy(zero_copy_only=False))
            places = batch.column("at").flatten()
            for low in range(0, len(of), 8192):
                d, some = of[low : low + 8192], pa.RecordBatch.from_struct_array(places.slice(low, 8192))
                pos = some.column("pos").to_numpy(zero_copy_only=False)
                at = np.concatenate([[0], ends])[d] + pos
                l = binary(before[at][:, ::-1], np.minimum(pos, reach))
                r = binary(behind[at + reach], np.minimum(ends[d] - at, length))
                cols = [some.column("h"), some.column("contexts"), pa.array(doc[d]), pa.array(tie[d]), pa.array(pos), l, r]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "contexts", "doc", "tie", "pos", "l", "r"])

    return rows.mapInArrow(cut, "h long, contexts long, doc long, tie long, pos long, l binary, r binary")


def _split(hot: DataFrame, length: int, gram: int, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Contexts of anchors with too many of them: tables of parts that can be sorted, and of spans that are known to repeat.

    Contexts are parted by the bytes that all strings of the offsets ``a`` to ``b`` share, as hashes: which strings are equal is
    told by the sort, or by the strings themselves where one offset is left.
    """
    place, ready, spans = F.struct("doc", "tie", "pos"), [], []
    rows = hot.select("h", "doc", "tie", "pos", "l", "r", F.lit(0).alias("a"), F.lit(length - gram).alias("b"))
    while True:
        half = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.array(F.struct(F.col("a").alias("a"), half.alias("b")), F.struct((half + 1).alias("a"), F.col("b").alias("b")))
        rows = rows.withColumn("part", F.explode(halves)).select("h", "doc", "tie", "pos", "l", "r", "part.a", "part.b")
        # Where a string of every offset of the part would reach over an end of the text, there is none.
        rows = rows.where((F.octet_length("l") >= F.col("a")) & (F.octet_length("r") >= length - F.col("b")))
        head = F.expr("substring(l, 1, a)"), F.expr(f"substring(r, 1, {length} - b)")
        rows = materialise(rows.withColumn("key", F.xxhash64("h", "a", "b", *head)))
        many = rows.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
        known = materialise(skew_join(rows, many, ["key"], "many", rows.count()))
        discard(rows)
        single = known.where("a = b")
        string = single.select("doc", "tie", "pos", "a", F.concat(*head).alias("w"))
        least = string.groupBy("a", "w").agg(F.min(F.struct("doc", "tie", "pos")).alias("f"), F.count("*").alias("many")).where("many > 1")
        start = F.col("pos") - F.col("a")
        spans.append(materialise(skew_join(string, least, ["a", "w"], "many", string.count()).where(place != F.col("f")).select("doc", "tie", start.alias("lo"), (start + length).alias("hi"))))
        ready.append(known.where(F.col("a") < F.col("b")).where(F.col("many") <= most).select("key", "doc", "tie", "pos", "l", "r", "a", "b"))
        rows = known.where(F.col("a") < F.col("b")).where(F.col("many") > most)
        if rows.isEmpty():
            return ready, spans


def _sorted_repeats(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """What earlier places repeat at the offsets ``a`` to ``b``, within each ``key``: ``doc``, ``tie``, ``lo``, ``hi``."""
    reach = length - gram

    def matrix(parts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
        data, ends = _flat(parts)
        sizes = np.diff(ends, prepend=0)
        out = np.zeros((len(sizes), width), dtype=np.uint8)
        out[np.arange(width) < sizes[:, None]] = data
        return out, sizes

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = {k: pa.concat_arrays([x.column(k) for x in held]) for k in ("key", "doc", "tie", "pos", "a", "b", "l", "r")}
        key, doc, tie, pos, a, b = (rows[k].to_numpy(zero_copy_only=False) for k in ("key", "doc", "tie", "pos", "a", "b"))
        rank = np.empty(len(key), dtype=np.int64)
        rank[np.lexsort((pos, tie, doc))] = np.arange(len(key))
        low, high = repeats(key, rank, *matrix(rows["l"], reach), *matrix(rows["r"], length), a, b)
        hit = np.flatnonzero(low >= 0)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[hit], tie[hit], pos[hit] - high[hit], pos[hit] - low[hit] + length)], names=["doc", "tie", "lo", "hi"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        count, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, done = batch.column("key").to_numpy(zero_copy_only=False), 0
            edge = np.flatnonzero(np.concatenate([[key[0] != last], key[1:] != key[:-1]]))
            while (k := np.searchsorted(edge, done + max(0, SORTED - count))) < len(edge):
                yield solve([*held, batch.slice(done, edge[k] - done)])
                held, count, done = [], 0, int(edge[k])
            held.append(batch.slice(done))
            count, last = count + batch.num_rows - done, key[-1]
        if count:
            yield solve(held)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc long, tie long, lo long, hi long")


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = GRAM, hot: int = HOT, bits: int = MOST_BITS, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts earlier, in UTF-8 and within documents.

    Earlier is a smaller ``doc_id``, or an earlier start in the same document.  Returns for each row ``doc_id``, ``n_bytes``,
    ``n_removed``, ``n_spans`` (maximal removed runs) and either ``kept`` (binary: the bytes that stay) and ``spans`` (array of
    start and end), or with ``digest`` ``kept_sha256``.  Null and empty texts have no bytes.  Rows with the same id and
    text are one document and get the same result; texts that share an id stand in the order of a hash; a row without an
    id comes last.  Tables may be empty, texts of any length, and further columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    several = not rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    tie = F.xxhash64("text") if several else F.lit(0).cast("long")
    keyed = rows.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), tie.alias("tie"), "text", "doc_id")

    place = F.struct("doc", "tie", "pos")
    places = materialise(_places(keyed.select("doc", "tie", "text"), length, gram, bits))
    first = places.groupBy("h", "c").agg(F.min(place).alias("f"), F.count("*").alias("many"))
    first = materialise(first.select("h", "c", "f.*", "many"))
    reach = length - gram
    span = [F.greatest(F.lit(0), F.col("pos") - reach).alias("lo"), (F.col("pos") + length).alias("hi")]
    again = first.where("many > 1").select("h", "c", place.alias("f"), "many")
    # Each table is written by itself, so that the shuffle behind it is gone before the next.  The spans of a text are listed in
    # one row: they are fewer than its anchors, of which there is one to each few dozen bytes.
    whole = skew_join(places, again, ["h", "c"], "many", places.count()).where(place != F.col("f")).select("doc", "tie", *span)
    whole = materialise(whole.groupBy("doc", "tie").agg(F.collect_set(F.struct("lo", "hi")).alias("gone")))
    discard(places)

    several = first.groupBy("h").agg(F.count("*").alias("contexts")).where("contexts > 1")
    mixed = skew_join(first.select("h", "doc", "tie", "pos"), several, ["h"], "contexts", first.count())
    mixed = materialise(mixed.groupBy("doc", "tie").agg(F.collect_list(F.struct("pos", "h", "contexts")).alias("at")))
    discard(first)
    cuts = materialise(_contexts(keyed.select("doc", "tie", "text").join(mixed, ["doc", "tie"]), length, gram))
    discard(mixed)
    sort = [cuts.where(F.col("contexts") <= hot).select(F.col("h").alias("key"), "doc", "tie", "pos", "l", "r", F.lit(0).alias("a"), F.lit(reach).alias("b"))]
    known = []
    crowded = cuts.where(F.col("contexts") > hot)
    if not crowded.isEmpty():
        more, known = _split(crowded, length, gram, hot)
        sort += more
    spans = reduce(DataFrame.union, [whole.select("doc", "tie", F.inline("gone")), _sorted_repeats(reduce(DataFrame.union, sort), length, gram), *known])
    spans = materialise(spans.groupBy("doc", "tie").agg(F.collect_set(F.struct("lo", "hi")).alias("gone")))
    discard(whole, cuts)

    def run(batches):
        for whole_batch in batches:
            for batch in slices(whole_batch, 512):
                data, ends = _flat(batch.column("text"))
                starts = np.concatenate([[0], ends[:-1]])
                of = np.repeat(np.arange(batch.num_rows), pc.fill_null(batch.column("gone").value_lengths(), 0).to_numpy(zero_copy_only=False))
                gone = pa.RecordBatch.from_struct_array(batch.column("gone").flatten())
                lo, hi = (gone.column(k).to_numpy(zero_copy_only=False) for k in ("lo", "hi"))
                # Texts stand one byte apart here, so that no run goes on in the next.
                base = starts + np.arange(batch.num_rows)
                lo, hi = lo + base[of], np.minimum(hi, (ends - starts)[of]) + base[of]
                to = np.argsort(lo)
                lo, hi = lo[to], np.maximum.accumulate(hi[to])
                new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]])[: len(lo)])
                lo, hi, of = lo[new], hi[np.append(new[1:], len(lo))[: len(new)] - 1], of[to][new]
                step = np.zeros(len(data) + 1, dtype=np.int8)
                step[lo - of] += 1
                step[hi - of] -= 1
                stay = np.cumsum(step[:-1], dtype=np.int8) == 0
                kept, n_spans, removed = data[stay], np.bincount(of, minlength=batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64)
                np.add.at(removed, of, hi - lo)
                edge = np.concatenate([[0], np.cumsum(ends - starts - removed)])
                texts = [kept[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
                cols = [batch.column("doc_id"), pa.array(ends - starts), pa.array(removed), pa.array(n_spans)]
                if digest:
                    cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()))
                else:
                    pairs = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1, dtype=np.int32) * 2), pa.array(np.stack([lo - base[of], hi - base[of]], axis=1).ravel()))
                    cols += [pa.array([x.tobytes() for x in texts], pa.binary()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32)), pairs)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", *(["kept_sha256"] if digest else ["kept", "spans"])]
    last = "kept_sha256 string" if digest else "kept binary, spans array<array<long>>"
    joined = keyed.join(spans, ["doc", "tie"], "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")
