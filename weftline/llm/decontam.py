"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every benchmark item gives windows of ``window`` consecutive words (a shorter item is one window).  A window is a set of
positioned word shingles, and a document holds the window only if it holds all of them, so one necessary token is enough
as its prefix: the window's rarest shingle over all documents.  Documents meet windows on that token, the offset of the
token bounds the window's place by the ends of the document, and the words themselves are then compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import lower_ascii, materialise, scope, unused

#: What separates words: every ASCII character but digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most benchmark shingles that are sent out with the plan (8 bytes each); beyond it documents and shingles are joined by a shuffle.
LITERALS = 20_000
#: Most bytes of a table that is broadcast, which are counted; a larger one is joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _places(n: Column, size: int) -> Column:
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def _gram(w: Column, size: int | Column, name: str):
    return lambda i: F.struct(i.alias(name), F.array_join(F.slice(w, i + 1, size), " ").alias("gram"))


def _is_known(w: Column, size: int, hashes: list[int]):
    return lambda i: F.xxhash64(F.slice(w, i + 1, size)).isin(hashes)


def _shingles(w: Column, n: Column, size: int) -> Column:
    """Each run of ``size`` words with its position."""
    return F.transform(_places(n, size), _gram(w, size, "pos"))


def windows_of(items: DataFrame, window: int, shingle: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Windows of all items: ``item``, ``win`` (its words joined by blanks), ``k`` (their number), ``s`` (words of a shingle)."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("k", F.least(F.size("w"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)
    w = w.withColumn("win", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("k")), " "))))
    return w.select("item", "win", "k", F.least(F.col("k"), F.lit(shingle)).alias("s")).distinct()


def _parts(wins: DataFrame) -> DataFrame:
    """All shingles of each distinct window: ``win``, ``k``, ``s``, ``off``, ``gram``."""
    w = wins.select("win", "k", "s").distinct().withColumn("w", F.split("win", " "))
    offs = F.sequence(F.lit(0), F.col("k") - F.col("s"))
    return w.select("win", "k", "s", F.inline(F.transform(offs, _gram(F.col("w"), F.col("s"), "off"))))


def _sent(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if the bytes of its rows are few enough."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) + 16 if t == "string" else F.lit(16) for c, t in df.dtypes), F.lit(64))
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0] <= BROADCAST_BYTES else df


def _matches(docs: DataFrame, grams: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """One row for each document (``rid``, id, ``n_words``) and each place in it of a benchmark shingle (``rid``, ``n_words``, ``pos``, ``gram``)."""
    sizes = sorted(r.s for r in grams.select("s").distinct().collect())  # at most the shingle length, so a handful
    few = grams.count() <= LITERALS
    rid = F.monotonically_increasing_id().alias("rid")
    row = docs.select(rid, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if few:
        known = {s: [r.h for r in grams.where(F.col("s") == s).select(F.xxhash64(F.split("gram", " ")).alias("h")).distinct().collect()] for s in sizes}

        def found(w: Column) -> Column:
            n, out = F.size(w), []
            for s in sizes:
                at = F.filter(_places(n, s), _is_known(w, s, known[s]))
                out.append(F.transform(at, _gram(w, s, "pos")))
            hits = F.concat(*out) if out else F.array().cast("array<struct<pos:int,gram:string>>")
            return F.struct(n.alias("n_words"), hits.alias("hits"))

        base = materialise(row.select("rid", "doc_id", _let(words(F.col("text")), found).alias("x")).select("rid", "doc_id", "x.n_words", "x.hits"))
        # The hash only picks places to look at; the shingle itself has to be one of the benchmark's.
        return base.drop("hits"), base.select("rid", "n_words", F.inline("hits"))

    def every(w: Column) -> Column:
        n = F.size(w)
        mark = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("gram")))
        return F.struct(n.alias("n_words"), F.concat(mark, *[_shingles(w, n, s) for s in sizes]).alias("all"))

    rows = row.select("rid", "doc_id", _let(words(F.col("text")), every).alias("x")).select("rid", "doc_id", "x.n_words", F.inline("x.all"))
    known = grams.select(F.col("gram").alias("known")).distinct()
    rows = materialise(rows.join(known, rows.gram == known.known, "left").where((F.col("pos") < 0) | F.col("known").isNotNull()).drop("known"))
    return rows.where("pos < 0").select("rid", "doc_id", "n_words"), rows.where("pos >= 0").select("rid", "n_words", "pos", "gram")


def find_windows(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Where benchmark windows occur, one row for each document row.

    Returns ``doc_id``, ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``n_items`` (distinct items with
    an occurring window), ``items`` (their ids as strings, sorted) and ``contaminated``.  A null or empty text has no words
    and is clean; items without words take no part; an item without an id is found but not listed; null ids and repeated
    rows of documents are kept as they are; either table may be empty; further columns are not read.
    """
    wins = materialise(windows_of(items, window, shingle, item_col, item_text_col))
    parts = materialise(_parts(wins))
    base, places = _matches(docs, parts.select("s", "gram").distinct(), id_col, text_col)

    # The prefix of each window: its rarest shingle.  A window with a shingle that no document has cannot occur.
    often = places.groupBy("gram").agg(F.count("*").alias("often"))
    rank = Window.partitionBy("win").orderBy(F.col("often").asc_nulls_first(), "off")
    first = parts.join(often, "gram", "left").withColumn("r", F.row_number().over(rank)).where("r = 1 and often is not null")
    prefix = _sent(materialise(first.select("gram", "off", "win", "k", "s")))

    # Length and positional bounds, then the words: shingles that cover the window must stand in their places.
    cand = places.join(prefix, "gram").withColumn("start", F.col("pos") - F.col("off"))
    cand = cand.where((F.col("start") >= 0) & (F.col("start") + F.col("k") <= F.col("n_words")))
    need = F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("k") - F.col("s"), F.col("s")), F.array(F.col("k") - F.col("s"))))
    probe = cand.select("rid", "start", "win", "k", "s", F.size(need).alias("needed"), F.explode(need).alias("j"))
    probe = probe.select("rid", "start", "win", "k", "needed", (F.col("start") + F.col("j")).alias("pos"), F.array_join(F.slice(F.split("win", " "), F.col("j") + 1, F.col("s")), " ").alias("gram"))
    held = probe.join(places.select("rid", "pos", "gram"), ["rid", "pos", "gram"]).groupBy("rid", "start", "win", "k").agg(F.count("*").alias("got"), F.first("needed").alias("needed"))
    occ = materialise(held.where("got = needed").select("rid", "start", "win", "k"))

    # Words covered: the length of the union of the occurrences.
    before = Window.partitionBy("rid").orderBy("start", "k").rowsBetween(Window.unboundedPreceding, -1)
    spans = occ.select("rid", "start", "k").distinct()
    reach = F.coalesce(F.max(F.col("start") + F.col("k")).over(before), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("k") - F.greatest(F.col("start"), reach))
    covered = spans.withColumn("fresh", fresh).groupBy("rid").agg(F.sum("fresh").alias("n_hit"))

    named = occ.select("rid", "win").join(_sent(wins.where("item is not null").select("win", "item")), "win").select("rid", "item").distinct()
    named = named.groupBy("rid").agg(F.sort_array(F.collect_list("item")).alias("items"))

    out = base.join(covered, "rid", "left").join(named, "rid", "left")
    hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), (hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with all their columns.

    Null and empty texts, and all rows of the same text alike, stay or go; ids are not read; either table may be empty.
    """
    mark = unused(docs, "spoilt")
    some = docs.where("text <> ''")
    key = F.sha2("text", 256)
    with scope() as keep:
        found = find_windows(some.select(key.alias("doc_id"), "text"), items, window, shingle).where("contaminated")
        spoilt = keep(materialise(found.select(F.col("doc_id").alias(mark)).distinct()))
    return some.join(_sent(spoilt), key == F.col(mark), "left_anti").unionByName(docs.where("text is null or text = ''"))
