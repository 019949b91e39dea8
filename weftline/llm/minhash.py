"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

Documents with the same shingle set are one node.  A node's signature is SuperMinHash: in round j every shingle puts the
value j plus a random fraction at the j-th place of its own random permutation of the places, so that the places of a small
set are filled evenly; a document stops as soon as no later round can lower any of its places.

Sharing a band of the signature makes two nodes candidates, and no more than that: pages of one template share bands without
being alike.  Candidates become neighbours only if enough places of their whole signatures agree, and only neighbours are
chained to clusters.  Every cluster's links are then found exactly on full shingle sets.  In both steps nodes that are known
to be connected are not compared again, so that a group of copies takes one pass over its members; a group too large
for one task is cut into blocks that share a pivot, and only what the pivot did not connect meets other blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import discard, materialise, mix, scope, skew_join, slices, unused
from weftline.llm.graph import components

#: Values in a band.
ROWS = 6
#: Chance that two documents just at the threshold share no band, and that their signatures agree in too few places.
MISS, SKETCH_MISS = 1e-6, 1e-9
#: Bands shared with the smallest node of a band that make two nodes neighbours without a look at their signatures.  It only
#: saves work: neighbours are verified, and all other candidates are looked at.
SHARED = 6
#: Most nodes of one block of a band; most documents and shingles in one block of a cluster.
BLOCK_NODES, BLOCK_DOCS, BLOCK_SHINGLES = 4096, 512, 200_000
#: Bits of a place that are compared to tell neighbours.
BITS = 4
#: Rounds after which the permutations of the shingles that are left are written out.
DENSE = 24

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_TRIVIAL = np.iinfo(np.int64).max


def _powers(n: int, known: list[np.ndarray] = [np.ones(1, dtype=np.uint64)]) -> np.ndarray:  # noqa: B006
    if len(known[0]) < n:
        known[0] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, _BASE, dtype=np.uint64))])
    return known[0]


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; words are cut at ASCII white space after lower-casing A-Z."""
    raw = [(t or "").encode().lower() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    solid = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return [np.zeros(0, dtype=np.uint64)] * len(texts)
    length = end - start
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    word = np.add.reduceat(_BYTE[data[solid]] * _powers(int(length.max()) + 1)[place], first)
    word = mix(word + length.astype(np.uint64))
    ends = np.cumsum([len(x) + 1 for x in raw])
    upto = np.searchsorted(start, ends)
    out, at = [], 0
    for stop in upto.tolist():
        w = word[at:stop]
        k = min(size, len(w))
        if k == 0:
            out.append(np.zeros(0, dtype=np.uint64))
        else:
            h = np.full(len(w) - k + 1, k, dtype=np.uint64)
            for i in range(k):
                h = h * np.uint64(_BASE) + w[i : len(w) - k + 1 + i]
            out.append(np.unique(mix(h)))
        at = stop
    return out


def exact_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The distinct shingles of each text as numbers that are equal only for equal words in equal order, among these texts."""
    known: dict[bytes, int] = {}
    words = [np.array([known.setdefault(w, len(known)) for w in t.encode().lower().split()], dtype=np.int64) for t in texts]
    length = np.array([len(w) for w in words])
    grams = np.minimum(length, size)
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(texts)
    numbered = 0
    for k in np.unique(grams[grams > 0]).tolist():
        some = np.flatnonzero(grams == k)
        count = length[some] - k + 1
        code = np.concatenate([words[i][: n] for i, n in zip(some, count, strict=True)])
        for j in range(1, k):  # two numbers become one, which stays small as it is made dense each time
            after = np.concatenate([words[i][j : j + n] for i, n in zip(some, count, strict=True)])
            code = np.unique(code * (len(known) + 1) + after, return_inverse=True)[1]
        at = np.concatenate([[0], np.cumsum(count)])
        for i, a, b in zip(some.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            out[i] = np.unique(code[a:b]) + numbered
        numbered += int(code.max()) + 1
    return out


def super_minhash(sets: list[np.ndarray], places: int) -> np.ndarray:
    """A signature for each set of hashes; its values are the round in the upper bits and a random fraction below.

    An empty set has the largest value at every place.
    """
    sig = np.full((len(sets), places), _TRIVIAL, dtype=np.int64)
    size = np.array([len(x) for x in sets], dtype=np.int64)
    if not size.sum():
        return sig
    x, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    cells, picks, perm = sig.reshape(-1), [], None
    for j in range(places):
        u = mix(x + np.uint64((j + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        value = (u & np.uint64((1 << 40) - 1)).astype(np.int64) | (j << 40)
        pick = (j + ((u >> np.uint64(40)) % np.uint64(places - j))).astype(np.int32)
        if perm is None:
            # What stands at a place of a permutation follows from the swaps so far, the last one first.
            spot = pick
            for i in range(j - 1, -1, -1):
                spot = np.where(spot == picks[i], np.int32(i), spot)
        else:
            spot = np.take_along_axis(perm, pick[:, None], 1)[:, 0].astype(np.int32)
        np.minimum.at(cells, owner * places + spot, value)
        live = np.unique(owner)
        open_ = np.zeros(len(sets), dtype=bool)
        open_[live] = sig[live].max(axis=1) >> 40 > j  # not every place has a value of this round or an earlier one
        keep = open_[owner]
        if not keep.any():
            break
        picks.append(pick)
        if not keep.all():
            x, owner = x[keep], owner[keep]
            picks = [p[keep] for p in picks]
            perm = None if perm is None else perm[keep]
        if perm is not None:
            np.put_along_axis(perm, picks[j][:, None].astype(np.int64), perm[:, j : j + 1].copy(), 1)
        elif j + 1 == DENSE:  # only small sets are left, so that this is small as well
            perm = np.tile(np.arange(places, dtype=np.uint16), (len(x), 1))
            for i, p in enumerate(picks):
                np.put_along_axis(perm, p[:, None].astype(np.int64), perm[:, i : i + 1].copy(), 1)
    return sig


def band_count(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return max(1, math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1


def least_matches(threshold: float, places: int, miss: float = SKETCH_MISS) -> int:
    """The places of which ``BITS`` bits agree between the signatures of two sets at the threshold, but for a chance of ``miss``."""
    same, below = threshold + (1 - threshold) / (1 << BITS), 0.0
    for k in range(places + 1):
        below += math.comb(places, k) * same**k * (1 - same) ** (places - k)
        if below > miss:
            return k
    return places


def sketches(sig: np.ndarray) -> list[bytes]:
    """The last ``BITS`` bits of each place, two places to a byte."""
    low = (np.pad(sig, ((0, 0), (0, sig.shape[1] % 2))) & 0xF).astype(np.uint8)
    return [row.tobytes() for row in low[:, ::2] | low[:, 1::2] << 4]


def places_of(sketch: list[bytes]) -> np.ndarray:
    """The places of sketches as rows; one is added to an odd number of them."""
    both = np.frombuffer(b"".join(sketch), dtype=np.uint8).reshape(len(sketch), -1)
    return np.concatenate([both & 0xF, both >> 4], axis=1)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band of each signature."""
    parts = sig.astype(np.uint64).reshape(len(sig), -1, rows)
    h = np.tile(np.arange(parts.shape[1], dtype=np.uint64), (len(sig), 1))
    for i in range(rows):
        h = mix(h * np.uint64(_BASE) + parts[:, :, i])
    return h.view(np.int64)


def signatures(docs: DataFrame, shingle: int, count: int) -> DataFrame:
    """``doc_id``, ``n``: size of the shingle set, ``h1`` and ``h2``: address of the set, ``bands``, ``sketch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 256, limit=2 << 20):
                sets = shingle_sets(batch.column("text").to_pylist(), shingle)
                ones = [int(x.sum(dtype=np.uint64)) for x in sets]
                twos = [int(mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) for x in sets]
                sig = super_minhash(sets, count * ROWS)
                found = bands(sig)
                cols = [batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64())]
                cols += [pa.array(np.array(v, dtype=np.uint64).view(np.int64)) for v in (ones, twos)]
                cols.append(pa.array([b if len(x) else None for b, x in zip(found, sets, strict=True)], pa.list_(pa.int64())))
                cols.append(pa.array(sketches(sig), pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "h1", "h2", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, n long, h1 long, h2 long, bands array<long>, sketch binary")


Linked = Callable[[int, np.ndarray], np.ndarray]


def spanning(linked: Linked, part: np.ndarray) -> list[tuple[int, int]]:
    """Links that join whatever links join.

    ``linked(i, rest)`` says which of ``rest`` are linked to i.  Places of one ``part`` are joined from the start, and places
    that are joined are not compared, so that copies of one another take a single pass.
    """
    part = np.unique(part, return_inverse=True)[1]
    size = np.bincount(part)
    by_part = np.split(np.argsort(part, kind="stable"), np.cumsum(size)[:-1])
    alive, out = np.ones(len(part), dtype=bool), []
    for seed in np.argsort(size, kind="stable").tolist():
        front = by_part[seed]
        if not alive[front[0]]:
            continue
        alive[front] = False
        while len(front):
            rest = np.flatnonzero(alive)
            by = np.full(len(rest), -1)
            if len(front) <= len(rest):
                for i in front.tolist():
                    left = np.flatnonzero(by < 0)
                    by[left[linked(i, rest[left])]] = i
            else:
                for k, i in enumerate(rest.tolist()):
                    hit = linked(i, front)
                    by[k] = front[hit.argmax()] if hit.any() else -1
            new = np.flatnonzero(by >= 0)
            out += zip(by[new].tolist(), rest[new].tolist(), strict=True)
            front = np.concatenate([by_part[p] for p in np.unique(part[rest[new]]).tolist()]) if len(new) else new
            alive[front] = False
    return out


def alike(n: np.ndarray, sketch: np.ndarray, least: int, num: int, den: int) -> Linked:
    """Whether sizes allow for the similarity and enough places agree."""

    def linked(i: int, rest: np.ndarray) -> np.ndarray:
        fits = np.minimum(n[rest], n[i]) * den >= np.maximum(n[rest], n[i]) * num
        at = np.flatnonzero(fits)
        fits[at] = np.count_nonzero(sketch[rest[at]] == sketch[i], axis=1) >= least
        return fits

    return linked


def similar(sets: list[np.ndarray], num: int, den: int) -> Linked:
    """Whether sets, as sorted small numbers, have a similarity of ``num / den``."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    start = np.cumsum(size) - size
    flat = np.concatenate(sets)
    mark = np.zeros(int(flat.max(initial=0)) + 1, dtype=bool)

    def linked(i: int, rest: np.ndarray) -> np.ndarray:
        fits = np.minimum(size[rest], size[i]) * den >= np.maximum(size[rest], size[i]) * num
        at = rest[fits]
        if len(at):
            mark[sets[i]] = True
            first = np.cumsum(size[at]) - size[at]
            every = np.repeat(start[at] - first, size[at]) + np.arange(int(size[at].sum()))
            both = np.add.reduceat(mark[flat[every]].astype(np.int64), first)
            mark[sets[i]] = False
            fits[fits] = den * both >= num * (size[at] + size[i] - both)
        return fits

    return linked


def _solved(rows: DataFrame, solve: Callable[[pa.Table], Linked]) -> DataFrame:
    """Links (``u``, ``v``) that join the rows of each ``group``, ``x``, ``y``, of which the ``node`` is a number and the ``part`` what it is joined with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            node = table.column("node").to_numpy()
            # A pivot that is at home in its block, and what is at home and a visitor, stands once.
            table = table.take(np.unique(node, return_index=True)[1])
            node = table.column("node").to_numpy()
            found = np.array(spanning(solve(table), table.column("part").to_numpy()), dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(node[found[:, k]]) for k in (0, 1)], names=["u", "v"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "x", "y")], axis=1)
            edge = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if a < b:
                    if held and tuple(keys[a]) != last:
                        yield flush(held)
                        held = []
                    held.append(batch.slice(a, b - a))
                    last = tuple(keys[a])
        if held:
            yield flush(held)

    return rows.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y").mapInArrow(run, "u long, v long")


def links_within(members: DataFrame, payload: DataFrame, solve: Callable[[pa.Table], Linked], most: int, weight: int | None = None) -> DataFrame:
    """Links that join whatever is linked within each group of ``members`` (``group``, ``node``, ``part``), as a written table.

    ``payload`` has a row for each node, with what ``solve`` needs.  A group of more than ``most`` nodes, or more than ``weight``
    in their column ``n``, is dealt to blocks, each of which also gets the group's smallest node; nodes that are then not connected with
    most of their group visit every other block.
    """
    with scope() as keep:
        count, total = F.count("*"), members.count()
        blocks = F.ceil(count / most) if weight is None else F.greatest(F.ceil(count / most), F.ceil(F.sum("n") / weight))
        sizes = members.groupBy("group").agg(count.alias("many"), blocks.cast("int").alias("blocks"), F.min("node").alias("pivot"))
        placed = skew_join(members.select("group", "node", "part"), sizes, ["group"], "many", total)
        placed = materialise(placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("many"))
        zero = F.lit(0).alias("y")
        home = placed.select("group", F.col("block").alias("x"), zero, "node", "part")
        pivots = placed.where("blocks > 1 and node = pivot").select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), zero, "node", "part")
        links = materialise(_solved(home.union(pivots).join(payload, "node"), solve))
        large = placed.where("blocks > 1")
        if large.isEmpty():
            return keep(links)

        # What the pivots, and other groups, have joined by now.
        known = members.where("part <> node").select(F.col("part").alias("u"), F.col("node").alias("v"))
        joined = materialise(components(links.union(known)))
        large = large.select("group", "node", "blocks", "block").join(joined, "node", "left").select("group", "node", "blocks", "block", F.coalesce("root", "node").alias("part"))
        large = materialise(large)
        parts = large.groupBy("group", "part").agg(F.count("*").alias("c"))
        main = parts.groupBy("group").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.sum("c").alias("many"), F.max("c").alias("most"))
        main = main.withColumn("calls", F.ceil((F.col("many") - F.col("most")) / most).cast("int")).where("calls > 0").select("group", "main", "calls", "many")
        apart = materialise(skew_join(large, main, ["group"], "many", total).drop("many"))
        call = F.pmod(F.xxhash64("node", F.lit(1)), F.col("calls")).cast("int")
        hosts = apart.select("group", F.col("block").alias("x"), F.explode(F.sequence(F.lit(0), F.col("calls") - 1)).alias("y"), "node", "part")
        visitors = apart.where("part <> main").select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), call.alias("y"), "node", "part")
        return keep(materialise(links.union(_solved(hosts.union(visitors).join(payload, "node"), solve))))


def _neighbours(nodes: DataFrame, least: int, num: int, den: int) -> DataFrame:
    """Clusters of nodes whose signatures are alike: ``node`` and ``root`` of all nodes that have a neighbour, but the roots."""
    def solve(table: pa.Table) -> Linked:
        return alike(table.column("n").to_numpy(), places_of(table.column("sketch").to_pylist()), least, num, den)

    with scope() as keep:
        rows = materialise(nodes.select("node", F.explode("bands").alias("band")))
        total = rows.count()
        lead = rows.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("many")).where("many > 1")
        shared = materialise(skew_join(rows, lead, ["band"], "many", total).select("band", "node", "lead", "many"))
        discard(rows)
        often = shared.where("node <> lead").groupBy("node", "lead").agg(F.count("*").alias("c")).where(F.col("c") >= SHARED)
        first = components(often.select(F.col("node").alias("u"), F.col("lead").alias("v")))
        known = shared.join(first.withColumnRenamed("root", "part"), "node", "left").select("band", "node", "many", F.coalesce("part", "node").alias("part"))
        # Bands whose nodes are not all in one cluster yet.
        open_ = known.groupBy("band").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.max("many").alias("many")).where("a < b").select("band", "many")
        members = materialise(skew_join(known.drop("many"), open_, ["band"], "many", total).select(F.col("band").alias("group"), "node", "part"))
        discard(shared)
        more = links_within(members, nodes.select("node", "n", "sketch"), solve, BLOCK_NODES)
        return keep(materialise(components(more.union(first.select(F.col("node").alias("u"), F.col("root").alias("v"))))))


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of at least ``num / den`` of their sets of word shingles.

    Returns for each row ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id that links reach, itself included) and
    ``kept`` (whether that is its own).  A text of fewer words than a shingle is one shingle; a text without words, or null,
    has none and is linked with nothing.  Rows that share an id count as one document, and a row without an id is linked
    with nothing, has no component and is kept.  Tables may be empty, and further columns aren't read.

    Sets are taken as equal if two 64-bit sums of their shingles' hashes and their sizes are; all other links are confirmed
    on the words themselves.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with scope() as keep:
        if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
            out = _groups(docs, None, shingle, num, den)
        else:
            # Every row gets an id of its own, and what shared one before is linked.
            rows = materialise(docs.select(F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()).alias("row"), "doc_id", "text"))
            ids = rows.where("row is not null").select("row", F.col("doc_id").alias("id"))
            found = materialise(_groups(rows.select(F.col("row").alias("doc_id"), "text"), ids, shingle, num, den))
            named = found.join(ids, found.doc_id == ids.row).select("id", "n", "component")
            least = named.groupBy("component").agg(F.min("id").alias("least"))
            out = named.where("n > 0").join(least, "component").select(F.col("id").alias("doc_id"), "n", F.col("least").alias("component"))
            out = out.union(named.where("n = 0").select("id", "n", "id")).union(found.where("doc_id is null"))
        return keep(materialise(out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("component").eqNullSafe(F.col("doc_id")).alias("kept"))))


def _groups(docs: DataFrame, same: DataFrame | None, shingle: int, num: int, den: int) -> DataFrame:
    """``doc_id``, ``n`` and ``component`` of each row; no id stands twice.  Rows with one ``id`` in ``same`` (``row``, ``id``) are linked."""
    count = band_count(num / den)
    whole = materialise(signatures(docs, shingle, count))
    sig = materialise(whole.select("doc_id", "n", "h1", "h2"))
    named = sig.where("n > 0 and doc_id is not null")
    sets = materialise(named.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("node"), F.count("*").alias("many")))
    nodes = materialise(whole.select(F.col("doc_id").alias("node"), "n", "bands", "sketch").join(sets.select("node"), "node", "left_semi"))
    discard(whole)

    hung = _neighbours(nodes, least_matches(num / den, count * ROWS), num, den)
    clusters = hung.select("node", F.col("root").alias("group")).union(hung.select(F.col("root").alias("node"), F.col("root").alias("group")).distinct())
    members = materialise(clusters.join(nodes.select("node", "n"), "node").select("group", "node", F.col("node").alias("part"), "n"))
    discard(nodes)
    texts = docs.join(members.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text")

    def solve(table: pa.Table) -> Linked:
        return similar(exact_sets(table.column("text").to_pylist(), shingle), num, den)

    links = links_within(members, texts, solve, BLOCK_DOCS, BLOCK_SHINGLES)
    if same is not None:
        shared = named.join(sets.select("h1", "h2", "n", "node"), ["h1", "h2", "n"]).join(same, F.col("doc_id") == F.col("row")).select("id", "node").distinct()
        least = shared.groupBy("id").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v < last").select("id", "v")
        links = links.union(shared.join(least, "id").select(F.col("node").alias("u"), "v"))
    linked = components(links)

    # Only sets of several rows, or with a link, have another component than their own id.
    label = sets.join(linked, "node", "left").where("root is not null or many > 1").select("h1", "h2", "n", "many", F.coalesce("root", "node").alias("component"))
    out = skew_join(named, label, ["h1", "h2", "n"], "many", named.count(), "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    return out.union(sig.where("n = 0 or doc_id is null").select("doc_id", "n", "doc_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one for each group stays; rows without an id all stay.

    Null, empty and wordless texts have no near-duplicates and stay; of rows that share an id all stay or go together.
    """
    gone = unused(docs, "gone")
    with scope() as keep:
        out = keep(materialise(near_duplicates(docs, shingle, num, den).where("not kept").select(F.col("doc_id").alias(gone)).distinct()))
    return docs.join(out, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
