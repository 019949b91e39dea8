"""Language identification of code-switched text by a linear-chain conditional random field over words.

The features of a word are itself (the lexicon), its beginnings and endings, and its letter n-grams, hashed to a fixed
number of weights for each language; transitions between the languages of neighbouring words are learned with them.
Labelled texts have one language each, so that texts which switch are joined from stretches of them to learn from.
Forward-backward gives every word's chances: ``label_words`` returns the language of each run of words, and a text's language
is the one with the largest mean chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import held_out, mix, slices

#: Labelled rows to learn from, those with the smallest hash of their id: at most so many of each language, and of all.  Every language
#: has its share, of so many rows at least, however many languages there are.
ROWS_EACH, ROWS, LEAST_ROWS = 150, 3000, 5
#: Words of each step.  A learned text of more words gives several sequences; a predicted one is one chain all the same.
SEQUENCE = 256
#: Joined texts for each sequence that is learned, and the fewest and most words of one of their stretches.
SWITCHED, SHORT, LONG = 0.25, 3, 40
BITS, GRAMS, AFFIX = 15, (2, 3, 4), 4
EPOCHS, RATE, DECAY = 4, 0.3, 1e-6
#: Words kept with their features' sums by each worker; beyond this the memory starts anew.
CACHE = 100_000
#: New words whose features are made at a time.
NEW = 8192
#: With more languages than these, fewer words are kept and made at a time.
FEW = 4
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words one after another, and the number of each word's."""
    raw = [f"^{w}$".encode("utf-32-le") for w in words]
    size = np.array([len(r) // 4 for r in raw])
    code = np.frombuffer(b"".join(raw), dtype="<u4").astype(np.uint64)
    end = np.cumsum(size)
    start = end - size
    owner = np.repeat(np.arange(len(words)), size)
    letter = mix(code + np.uint64(0x9E3779B97F4A7C15))
    keys, who = [], []
    for n in GRAMS:
        h = np.full(max(0, len(code) - n + 1), n, dtype=np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + letter[i : len(code) - n + 1 + i]
        ok = np.flatnonzero(owner[: len(h)] == owner[n - 1 :]) if len(h) else np.zeros(0, dtype=np.int64)
        keys.append(h[ok])
        who.append(owner[ok])
    upto = np.zeros(len(code) + 1, dtype=np.uint64)
    power = np.cumprod(np.full(int(size.max(initial=1)), 0x100000001B3, dtype=np.uint64))
    np.cumsum(letter * power[np.arange(len(code)) - start[owner]], out=upto[1:])
    for k in range(2, AFFIX + 2):  # beginnings, of k letters and the mark before them
        ok = np.flatnonzero(size > k)
        keys.append(upto[start[ok] + k] - upto[start[ok]] + np.uint64(101 * k))
        who.append(ok)
    for k in range(2, AFFIX + 2):  # endings
        ok = np.flatnonzero(size > k)
        h = np.full(len(ok), 977 * k, dtype=np.uint64)
        for i in range(k):
            h = h * np.uint64(0x100000001B3) + letter[end[ok] - k + i]
        keys.append(h)
        who.append(ok)
    keys.append(upto[end] - upto[start] + np.uint64(7))
    who.append(np.arange(len(words)))
    key, who = np.concatenate(keys), np.concatenate(who)
    order = np.argsort(who, kind="stable")
    return (mix(key[order]) >> np.uint64(64 - BITS)).astype(np.int64), np.bincount(who, minlength=len(words))


def _share(most: int, langs: int) -> int:
    return max(1, most * FEW // max(FEW, langs))


def _emissions(weights: np.ndarray, key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of the weights of each word's features."""
    end = np.cumsum(count)
    start = end - count
    out, step = np.empty((len(count), weights.shape[1])), _share(NEW, weights.shape[1])
    for low in range(0, len(count), step):
        some = start[low : low + step]
        out[low : low + step] = np.add.reduceat(weights[key[some[0] : end[low + len(some) - 1]]], some - some[0], axis=0)
    return out


def _scaled(emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(trans - trans.max())


def _forward(e: np.ndarray, move: np.ndarray, a: np.ndarray | None) -> np.ndarray:
    """Chances given the words up to each; ``a``: those at the word before the first, where there is one."""
    alpha = np.empty_like(e)
    for t in range(e.shape[1]):
        a = e[:, t] if a is None else (a @ move) * e[:, t]
        a = a / a.sum(axis=1, keepdims=True)
        alpha[:, t] = a
    return alpha


def _backward(e: np.ndarray, move: np.ndarray, size: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What the words behind each say of its language; ``b``: that at the last word of sequences of full width."""
    beta = np.empty_like(e)
    beta[:, -1] = b
    for t in range(e.shape[1] - 2, -1, -1):
        b = (e[:, t + 1] * b) @ move.T
        b /= b.sum(axis=1, keepdims=True)
        b = np.where((t >= size - 1)[:, None], 1.0 / e.shape[2], b)
        beta[:, t] = b
    return beta


def forward_backward(emit: np.ndarray, size: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of each language at each word of padded sequences, and expected transitions; all in scaled probabilities.

    ``emit``: sequences x words x languages, in logarithms; ``size``: words of each sequence.
    """
    e, move = _scaled(emit, trans)
    alpha = _forward(e, move, None)
    beta = _backward(e, move, size, np.full((len(e), e.shape[2]), 1.0 / e.shape[2]))
    chance = alpha * beta
    chance /= chance.sum(axis=2, keepdims=True)
    inside = np.arange(e.shape[1]) < size[:, None]
    pair = inside[:, 1:]
    before, after = alpha[:, :-1][pair], (e[:, 1:] * beta[:, 1:])[pair]
    after /= ((before @ move) * after).sum(axis=1, keepdims=True)
    return chance * inside[:, :, None], move * (before.T @ after)


class Crf:
    def __init__(self, langs: list[str], weights: np.ndarray, trans: np.ndarray):
        self.langs, self.weights, self.trans = langs, weights, trans
        self.cache: dict[str, int] = {}
        self.table = np.zeros((0, len(langs)))

    def rows(self, words: list[str]) -> np.ndarray:
        """The row of ``table`` with each word's sums."""
        if len(self.cache) > _share(CACHE, len(self.langs)):
            self.cache, self.table = {}, self.table[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.cache]
        sums = [self.table]
        for low in range(0, len(new), NEW):
            key, count = features(new[low : low + NEW])
            sums.append(_emissions(self.weights, key, count))
        if new:
            self.cache.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate(sums)
        return np.fromiter(map(self.cache.__getitem__, words), dtype=np.int64, count=len(words))

    def sums(self, row: np.ndarray, start: np.ndarray, size: np.ndarray, best: np.ndarray | None = None, chances: np.ndarray | None = None) -> np.ndarray:
        """Summed chances of each language over the words of texts, each of which is one chain; longer texts stand first.

        ``best`` and ``chances``, where given, are filled with the likeliest language of each word and its chance.

        The chains are read in stretches: forward, of which only the chances at their ends are kept, and then back, with
        each stretch's forward chances made again from the end of the one before.  So a long text takes no more memory.
        """
        langs = len(self.langs)

        def stretch(a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n = np.minimum(size[size > a] - a, SEQUENCE)
            inside = np.arange(int(n.max())) < n[:, None]
            pad = np.zeros((*inside.shape, langs))
            pad[inside] = self.table[row[(start[: len(n), None] + a + np.arange(inside.shape[1]))[inside]]]
            return (*_scaled(pad, self.trans), n)

        ends, starts = [None], range(0, int(size.max()), SEQUENCE)
        for a in starts[:-1]:
            e, move, n = stretch(a)
            last = ends[-1] if a == 0 else ends[-1][: len(n)]
            ends.append(_forward(e, move, last)[:, -1])
        out, behind = np.zeros((len(size), langs)), np.zeros((0, langs))
        for a, before in zip(reversed(starts), reversed(ends), strict=True):
            e, move, n = stretch(a)
            b = np.full((len(n), langs), 1.0 / langs)
            b[: len(behind)] = behind
            beta = _backward(e, move, n, b)
            chance = _forward(e, move, None if before is None else before[: len(n)]) * beta
            chance /= chance.sum(axis=2, keepdims=True)
            inside = np.arange(e.shape[1]) < n[:, None]
            out[: len(n)] += (chance * inside[:, :, None]).sum(axis=1)
            if best is not None:
                at = (start[: len(n), None] + a + np.arange(e.shape[1]))[inside]
                best[at], chances[at] = chance.argmax(axis=2)[inside], chance.max(axis=2)[inside]
            behind = (e[:, 0] * beta[:, 0]) @ move.T
            behind /= behind.sum(axis=1, keepdims=True)
        return out

    def _summed(self, cut: list[list[str]], labelled: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Summed chances of each text's words and their numbers; if ``labelled``, each word's likeliest language and its chance."""
        row = self.rows([w for words in cut for w in words])
        sizes = np.array([len(words) for words in cut], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        best, chances = (np.zeros(len(row), dtype=np.int32), np.zeros(len(row))) if labelled else (None, None)
        sums = np.zeros((len(cut), len(self.langs)))
        order = np.argsort(-sizes, kind="stable")[: int((sizes > 0).sum())]
        step = _share(256, len(self.langs))
        for low in range(0, len(order), step):
            some = order[low : low + step]
            sums[some] = self.sums(row, starts[some], sizes[some], best, chances)
        return sums, sizes, best, chances

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its mean chance of each text; ``und`` and 0 without letters."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.langs:
            return out
        sums, sizes, _, _ = self._summed([_WORD.findall(t.lower()) if t else [] for t in texts])
        for i, n in enumerate(sizes):
            if n:
                best = int(sums[i].argmax())
                out[i] = (self.langs[best], float(min(1.0, sums[i, best] / n)))
        return out

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str, int, float]]]:
        """Runs of words of one language in each text: start, end, language, words and mean chance."""
        found = [list(_WORD.finditer(t)) if t else [] for t in texts]
        if not self.langs:
            return [[(m[0].start(), m[-1].end(), UNKNOWN, len(m), 0.0)] if m else [] for m in found]
        _, sizes, best, chances = self._summed([[m[0].lower() for m in words] for words in found], labelled=True)
        out, at = [], 0
        for words, n in zip(found, sizes.tolist(), strict=True):
            mine, chance = best[at : at + n], chances[at : at + n]
            edge = [0, *(np.flatnonzero(np.diff(mine)) + 1).tolist(), n] if n else []
            out.append([(words[a].start(), words[b - 1].end(), self.langs[mine[a]], b - a, float(min(1.0, chance[a:b].mean()))) for a, b in zip(edge[:-1], edge[1:], strict=True)])
            at += n
        return out


def _joined(seqs: list[tuple[list[str], np.ndarray]], langs: int, rng: np.random.Generator) -> list[tuple[list[str], np.ndarray]]:
    """Texts that switch between languages, each made of stretches of sequences of one language."""
    out = []
    for _ in range(int(SWITCHED * len(seqs)) if langs > 1 else 0):
        words, labels = [], []
        for _ in range(int(rng.integers(2, 8))):
            some, label = seqs[int(rng.integers(len(seqs)))]
            n = min(len(some), int(rng.integers(SHORT, LONG + 1)), SEQUENCE - len(words))
            a = int(rng.integers(len(some) - n + 1))
            words += some[a : a + n]
            labels.append(label[a : a + n])
        out.append((words, np.concatenate(labels)))
    return out


def learn(texts: list[str], labels: list[str]) -> Crf:
    """Maximum likelihood by steps of adaptive size; every word of a text has the text's language, and joined texts switch."""
    langs = sorted(set(labels))
    weights, trans = np.zeros((1 << BITS, len(langs))), np.zeros((len(langs), len(langs)))
    squares, trans_squares = np.full(weights.shape, 1e-6), np.full(trans.shape, 1e-6)
    seqs = []
    for text, label in zip(texts, labels, strict=True):
        words = _WORD.findall(text.lower())
        seqs += [(words[a : a + SEQUENCE], np.full(len(words[a : a + SEQUENCE]), langs.index(label))) for a in range(0, len(words), SEQUENCE)]
    rng = np.random.default_rng(0)
    seqs += _joined(seqs, len(langs), rng)
    for _ in range(EPOCHS):
        order = rng.permutation(len(seqs))
        for low in range(0, len(order), 64):
            some = [seqs[k] for k in order[low : low + 64]]
            words = [w for s, _ in some for w in s]
            key, count = features(words)
            emit = _emissions(weights, key, count)
            size = np.array([len(s) for s, _ in some])
            inside = np.arange(int(size.max())) < size[:, None]
            pad = np.zeros((*inside.shape, len(langs)))
            pad[inside] = emit
            chance, moved = forward_backward(pad, size, trans)
            grad = chance[inside]
            label = np.concatenate([y for _, y in some])
            grad[np.arange(len(words)), label] -= 1
            last = np.zeros(len(label), dtype=bool)
            last[np.cumsum(size) - 1] = True
            at = np.flatnonzero(~last)
            move = moved - np.bincount(label[at] * len(langs) + label[at + 1], minlength=len(langs) ** 2).reshape(len(langs), len(langs))
            step = np.zeros_like(weights)
            for y in range(len(langs)):
                step[:, y] = np.bincount(key, weights=np.repeat(grad[:, y], count), minlength=1 << BITS)
            step += DECAY * weights
            squares += step * step
            weights -= RATE * step / np.sqrt(squares)
            trans_squares += move * move
            trans -= RATE * move / np.sqrt(trans_squares)
    return Crf(langs, weights, trans)


def train(docs: DataFrame, rows_each: int = ROWS_EACH, rows: int = ROWS) -> Crf:
    """Learn from a sample of the rows of each language that are not held out; only languages with such rows can be told."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    count = known.select("lang").distinct().count()
    if not count:
        return Crf([], np.zeros((1 << BITS, 0)), np.zeros((0, 0)))
    each = max(LEAST_ROWS, min(rows_each, rows // count))
    # Spark keeps so many rows of a language in each task before they meet, and again in each part of a language.
    ids = known.select("doc_id", "lang").distinct().withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64)))
    for by in (["lang", "part"], ["lang"]):
        first = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id"))
        ids = ids.withColumn("k", first).where(F.col("k") <= each).drop("k")
    ids = ids.drop("part")
    # At most as many rows as the bound, or the least number of each language, are broadcast.
    some = known.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    got = sorted((r.lang, r.doc_id, r.text) for r in some.toLocalIterator())
    return learn([t for *_, t in got], [lang for lang, *_ in got])


def predict(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` (mean chance of that language) of each row's whole text.

    A text that is null or has no letter is ``und`` with score 0, as is every text where nothing could be learned.  Null
    ids are not held out; repeated rows stay; a table may be empty; further columns are not read.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((model.langs, model.weights, model.trans))  # a fixed number of weights
    state: dict[str, Crf] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "crf" not in state:
            state["crf"] = Crf(*known.value)
        for whole in batches:
            for batch in slices(whole, 1024, limit=2 << 20):
                got = state["crf"].predict(batch.column("text").to_pylist())
                cols = [batch.column("doc_id"), batch.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def annotate(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``, which replace columns of these names; rows and other columns stay."""
    kept = docs.drop("lang_pred", "lang_score")
    known = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.trans))
    state: dict[str, Crf] = {}
    names = [*kept.columns, "lang_pred", "lang_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "crf" not in state:
            state["crf"] = Crf(*known.value)
        for whole in batches:
            for batch in slices(whole, 1024, text_col, limit=2 << 20):
                got = state["crf"].predict(batch.column(text_col).to_pylist())
                more = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=names)

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return kept.mapInArrow(run, schema)


def label_words(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every word: ``doc_id`` and ``spans``, runs of words of one language in order.

    A span has ``start`` and ``end`` in code points, ``lang``, ``words`` and ``score`` (their mean chance).  A text that is null or
    has no letter has none; where nothing could be learned the whole text is ``und``.  Null ids and repeated rows stay; a table
    may be empty; further columns are not read.
    """
    known = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.trans))
    state: dict[str, Crf] = {}
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("words", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "crf" not in state:
            state["crf"] = Crf(*known.value)
        for whole in batches:
            for batch in slices(whole, 512, limit=1 << 20):
                got = state["crf"].spans(batch.column("text").to_pylist())
                shown = [[dict(zip(("start", "end", "lang", "words", "score"), x, strict=True)) for x in spans] for spans in got]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shown, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<start:bigint,end:bigint,lang:string,words:bigint,score:double>>")
