"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, strips accents, maps look-alike letters of other scripts and digit substitutions to Latin letters and
everything that is no letter to a blank.  Entries are whole words or beginnings of words with a weight (log odds); those
that cover labelled toxic texts best are learned one after another, and all others that are too sure to be chance.  Matches inside
exception phrases don't count.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import held_out, slices

#: Characters that stand for Latin letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe",
}
#: Phrases in which a word of the lexicon is no insult.
EXCEPTIONS = ("trash can", "trash bin", "worthless check", "class clown", "clown fish")

#: Labelled rows that the lexicon is learned from: at most so many toxic ones and so many others, those with the smallest hash of their id.
TOXIC_ROWS, OTHER_ROWS = 2000, 4000
#: Least evidence (G-test) for an entry, how many times likelier it has to make a toxic text, and least toxic texts that have it.
EVIDENCE, RATIO, LEAST = 15.0, 5.0, 3
SHORTEST, LONGEST = 4, 6
LIMIT = 0.3


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        out = ""
        for x in unicodedata.normalize("NFKD", c):
            x = LOOKALIKES.get(x, DIGITS.get(x, x))
            out += "" if unicodedata.combining(x[0]) else x if x.isalpha() else " "
        self[code] = out
        return out


_FOLD = _Fold()
_ASCII = bytes(ord(_FOLD[i][0]) if i < 128 else 32 for i in range(256))


def fold(text: str) -> str:
    """``text`` in Latin letters where they stand for such, with a blank before, behind and for all that is no letter."""
    if text.isascii():
        text = text.encode().translate(_ASCII).decode()
    else:
        text = text.translate(_FOLD)
    return f" {text} "


class Lexicon:
    """Weights of entries (`` word `` or `` beginning``), exception phrases and the scale of scores."""

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = (), middle: float = 1.0):
        self.weights, self.exceptions, self.middle = weights, tuple(exceptions), middle
        self.find = ahocorasick.Automaton()
        for entry, w in weights.items():
            self.find.add_word(entry, (len(entry), w))
        for phrase in self.exceptions:
            entry = fold(phrase)
            self.find.add_word(entry, (len(entry), None))
        if len(self.find):
            self.find.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of the longest entry at each place, without those inside exceptions."""
        if not len(self.find):
            return []
        found: dict[int, tuple[int, float]] = {}
        spared = []
        for end, (size, weight) in self.find.iter(folded):
            start = end - size + 1
            if weight is None:
                spared.append((start, end + 1))
            elif start not in found or size > found[start][0]:
                found[start] = (size, weight)
        if not spared:
            return [(s, s + n, w) for s, (n, w) in found.items()]
        # A place is inside an exception if, of those that begin no later, the one that reaches farthest covers it.
        spared.sort()
        starts, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
        upto = {s: bisect_right(starts, s) for s in found}
        return [(s, s + n, w) for s, (n, w) in found.items() if not upto[s] or reach[upto[s] - 1] < s + n]

    def strength(self, text: str | None) -> float:
        """Weight of all matches against the logarithm of the length in words."""
        folded = fold(text or "")
        hits = self.matches(folded)
        return sum(w for *_, w in hits) / math.log2(2 + len(folded.split())) if hits else 0.0

    def score(self, text: str | None) -> float:
        x = max(0.0, self.strength(text))
        return x / (x + self.middle)


def _entries(text: str | None) -> set[str]:
    out = set()
    for w in set(fold(text or "").split()):
        out.update(f" {w[:n]}" for n in range(SHORTEST, min(LONGEST, len(w) - 1) + 1))
        out.add(f" {w} ")
    return out


def _evidence(p: int, n: int, toxic: int, other: int) -> float:
    total, out = toxic + other, 0.0
    for got, part in ((p, toxic), (n, other)):
        if got:
            out += 2 * got * math.log(got * total / ((p + n) * part))
    return out


def learn(rows, exceptions: Iterable[str] = EXCEPTIONS) -> Lexicon:
    """A lexicon from ``rows()``, an iterator over texts and labels that can be had several times."""
    often = {1: Counter(), 0: Counter()}
    count = Counter()
    for text, label in rows():
        count[label] += 1
        if label == 1:
            often[1].update(_entries(text))
    tried = len(often[1])
    often[1] = Counter({e: p for e, p in often[1].items() if p >= LEAST})
    for text, label in rows():
        if label == 0:  # other entries are no candidates, so that their number bounds this table
            often[0].update(_entries(text) & often[1].keys())
    toxic, other = max(1, count[1]), max(1, count[0])

    def fits(e: str, p: int) -> bool:
        n = often[0][e]
        return p / toxic > RATIO * (n + 0.5) / other and _evidence(p, n, toxic, other) >= EVIDENCE

    def weight(e: str) -> float:
        return math.log((often[1][e] + 0.5) / (toxic + 1)) - math.log((often[0][e] + 0.5) / (other + 1))

    able = {e for e, p in often[1].items() if fits(e, p)}
    held = [_entries(text) & able for text, label in rows() if label == 1]
    chosen: dict[str, float] = {}
    while True:
        left = Counter(e for h in held for e in h)
        best = max(((_evidence(p, often[0][e], toxic, other), len(e), e) for e, p in left.items() if p >= LEAST and fits(e, p)), default=None)
        if best is None:
            break
        chosen[best[2]] = weight(best[2])
        held = [h for h in held if best[2] not in h]
    # Entries with more evidence than chance gives any of those tried are taken as well, though others cover their texts.
    sure = max(EVIDENCE, 2 * math.log(max(1, tried)))
    strong = {e: g for e in able if (g := _evidence(often[1][e], often[0][e], toxic, other)) >= sure}
    for e in sorted(strong, key=lambda e: (-strong[e], -len(e), e)):
        if not any(e.startswith(c.rstrip()) or c.startswith(e.rstrip()) for c in chosen):
            chosen[e] = weight(e)
    draft = Lexicon(chosen, exceptions)
    around = {1: Counter(), 0: Counter()}
    for text, label in rows():
        folded = fold(text or "")
        for s, e, _ in draft.matches(folded):
            end = folded.find(" ", e - 1 if folded[e - 1] == " " else e)
            word = folded[s:end].strip()
            around[label].update({f"{folded[:s].split(' ')[-1]} {word}".strip(), f"{word} {folded[end:].lstrip().split(' ')[0]}".strip()} - {word})
    learned = [x for x, n in around[0].items() if n >= 3 and not around[1][x]]
    model = Lexicon(chosen, [*exceptions, *learned])
    # The scale puts the strength that parts the labels best at the limit for a prediction.
    got = sorted((model.strength(text), label) for text, label in rows())
    right = best_right = count[1]
    cut = (0.0, got[0][0] if got else 0.0)
    for i, (x, label) in enumerate(got):
        right += 1 if label == 0 else -1
        if right > best_right and (i + 1 == len(got) or got[i + 1][0] > x):
            best_right, cut = right, (x, got[i + 1][0] if i + 1 < len(got) else x + 1)
    least = (cut[0] + cut[1]) / 2 or 0.5
    return Lexicon(chosen, [*exceptions, *learned], middle=least * (1 - LIMIT) / LIMIT)


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS) -> Lexicon:
    """Learn from a bounded sample of the labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = None
    for value, most in ((1, toxic_rows), (0, other_rows)):
        some = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = some if ids is None else ids.union(some)
    # At most the sum of both bounds is broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    held = [(r.text, int(r.toxic)) for r in rows.toLocalIterator()]
    return learn(lambda: iter(held))


def score(docs: DataFrame, model: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: ``doc_id``, ``held_out``, ``score`` from 0 to 1 and ``predicted`` (1 from 0.3 on).

    Null and empty texts score 0.  Repeated rows and null ids (not held out) stay; a table may be empty; further columns
    are not read.
    """
    state: dict[str, Lexicon] = {}
    kept = (model.weights, model.exceptions, model.middle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "model" not in state:
            state["model"] = Lexicon(*kept)
        for whole in batches:
            for batch in slices(whole, 1024):
                got = np.array([state["model"].score(t) for t in batch.column("text").to_pylist()], dtype=np.float64)
                cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(got), pa.array((got >= LIMIT).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
