"""URL filters: rules for hosts and paths first, then gradient-boosted trees on lexical features.

The trees are learned from labelled URLs, which the caller gives as a table.  Where there are no other labels, the rules are
the labels: ``labelled_by`` gives the URLs of a table that a rule decides, so that the trees say what the rules leave open.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPLIT = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.DOTALL)
#: Labelled URLs to learn from: at most so many distinct ones of each label, those with the smallest hash.
LABELLED = 2000


@dataclass(frozen=True)
class Rule:
    """``pattern``: a host and what paths start with, such as ``example.com/en/``."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1] if "/" in self.pattern else ""

    def fits(self, host: str, path: str) -> bool:
        return (host == self.host or host.endswith("." + self.host)) and path.startswith(self.path)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    m = _SPLIT.match(url or "")
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


class Rules:
    """Rules by host, so that a URL meets only those of its own host and the domains above it."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.by_host: dict[str, list[Rule]] = {}
        for r in rules:
            self.by_host.setdefault(r.host, []).append(r)
        self.dots = max((h.count(".") for h in self.by_host), default=0)

    def match(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits; of rules of one length the one with the longer host, then the first in order."""
        parts = host.rsplit(".", self.dots + 1)
        above = [host] if len(parts) <= self.dots + 1 else []
        above += [".".join(parts[i:]) for i in range(1, len(parts))]
        fits = (r for h in above for r in self.by_host.get(h, ()) if path.startswith(r.path))
        return max(fits, key=lambda r: (len(r.pattern), len(r.host)), default=None)


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


class Features:
    """Lexical features of URLs, with the shares of blocked URLs among those with the same suffix."""

    def __init__(self, urls: list[str], labels: np.ndarray):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        seen: Counter = Counter()
        bad: Counter = Counter()
        for url, y in zip(urls, labels, strict=True):
            for key in self._suffixes(split_url(url)[0]):
                seen[key] += 1
                bad[key] += int(y)
        self.share = {k: (bad[k] + self.prior * 2) / (n + 2) for k, n in seen.items()}

    @staticmethod
    def _suffixes(host: str) -> tuple[str, str]:
        """The last label with a dot before it, and the last two."""
        parts = host.rsplit(".", 2)
        return f".{parts[-1]}", ".".join(parts[-2:])

    def of(self, url: str | None) -> list[float]:
        url = url or ""
        host, path = split_url(url)
        query = url.split("#", 1)[0].partition("?")[2]
        digits, host_digits = (sum(c.isdigit() for c in x) for x in (url, host))
        return [
            len(url), len(host), len(path), len(query),  # length
            host.count(".") + 1, sum(bool(p) for p in path.split("/")),  # depth
            digits / max(1, len(url)), host_digits / max(1, len(host)),
            _entropy(host), _entropy(path),
            len([p for p in query.split("&") if p]),  # parameters
            *(self.share.get(k, self.prior) for k in self._suffixes(host)),
        ]


class Trees:
    """Boosted regression trees for the logistic loss, each with ``2 ** depth`` leaves, on thresholds at quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 16, ridge: float = 1.0):
        self.depth, self.trees = depth, []
        mean = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
        self.base = math.log(mean / (1 - mean))
        if not len(y):
            return
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        raw = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            grad, curve = y - p, p * (1 - p)
            node, splits = np.zeros(len(y), dtype=np.int64), []
            for level in range(depth):
                chosen = []
                for k in range(1 << level):
                    at = np.flatnonzero(node == k)
                    chosen.append(self._split(x[at], grad[at], curve[at], cuts, ridge))
                feature, cut = (np.array(v) for v in zip(*chosen, strict=True))
                splits.append((feature, cut))
                node = node * 2 + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaf = rate * np.bincount(node, weights=grad, minlength=1 << depth) / (np.bincount(node, weights=curve, minlength=1 << depth) + ridge)
            raw += leaf[node]
            self.trees.append((splits, leaf))

    @staticmethod
    def _split(x: np.ndarray, grad: np.ndarray, curve: np.ndarray, cuts: list[np.ndarray], ridge: float) -> tuple[int, float]:
        best, out = 1e-9, (0, math.inf)
        g, h = grad.sum(), curve.sum()
        for f, cut in enumerate(cuts):
            where = np.searchsorted(cut, x[:, f])  # a value equal to a threshold stays below it
            gl = np.cumsum(np.bincount(where, weights=grad, minlength=len(cut) + 1))[:-1]
            hl = np.cumsum(np.bincount(where, weights=curve, minlength=len(cut) + 1))[:-1]
            if len(cut):
                gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                i = int(gain.argmax())
                if gain[i] > best:
                    best, out = float(gain[i]), (f, float(cut[i]))
        return out

    def chance(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        for splits, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for feature, cut in splits:
                node = node * 2 + (x[np.arange(len(x)), feature[node]] > cut[node])
            raw += leaf[node]
        return 1 / (1 + np.exp(-raw))


@dataclass(frozen=True)
class Model:
    features: Features
    trees: Trees

    def chance(self, urls: list[str | None]) -> np.ndarray:
        return self.trees.chance(np.array([self.features.of(u) for u in urls])) if urls else np.zeros(0)


def learn(urls: list[str], labels: np.ndarray) -> Model:
    """Statistics from one half, trees from the other."""
    half = len(urls) // 2
    features = Features(urls[:half], labels[:half])
    return Model(features, Trees(np.array([features.of(u) for u in urls[half:]]), labels[half:].astype(float)))


def _host_and_path(rules: Rules, urls: list[str | None]) -> Iterator[tuple[str, str, Rule | None]]:
    for url in urls:
        host, path = split_url(url)
        yield host, path, rules.match(host, path)


def labelled_by(pages: DataFrame, rules: tuple[Rule, ...], url_col: str = "url") -> DataFrame:
    """``url`` and ``label`` (1: to block) of the rows that a rule decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Rules(rules)
        for b in batches:
            urls = b.column("url").to_pylist()
            found = [(u, int(r.verdict == "block")) for u, (_, _, r) in zip(urls, _host_and_path(known, urls), strict=True) if r]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32())], names=["url", "label"])

    return pages.select(F.col(url_col).alias("url")).mapInArrow(run, "url string, label int")


def train(labelled: DataFrame, most: int = LABELLED) -> Model:
    """Learn from at most ``most`` distinct URLs of each ``label`` (1: to block, 0: not); rows that lack either are left out.

    Without any labels the model blocks nothing.
    """
    known = labelled.where(F.col("label").isin(0, 1) & F.col("url").isNotNull()).groupBy("url").agg(F.max("label").alias("label"))
    rows = []
    for value in (0, 1):
        some = known.where(F.col("label") == value).orderBy(F.xxhash64("url"), "url").limit(most)
        rows += [(r.url, int(r.label)) for r in some.collect()]
    order = np.random.default_rng(0).permutation(len(rows))
    return learn([rows[i][0] for i in order], np.array([rows[i][1] for i in order], dtype=np.int64))


def judge(pages: DataFrame, rules: tuple[Rule, ...], model: Model, limit: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A verdict for every url: ``page_id``, ``host``, ``path``, ``rule`` (or null), ``verdict`` and ``score`` (the trees' chance to block).

    The longest rule that fits decides, else the trees: block above ``limit``.  A null url, or one without ``://``, has an empty
    host and path and no rule.  Repeated rows and null ids stay; a table may be empty; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Rules(rules)
        for b in batches:
            urls = b.column("url").to_pylist()
            chance = model.chance(urls)
            out = [(host, path, r.pattern if r else None, r.verdict if r else "block" if c > limit else "allow") for (host, path, r), c in zip(_host_and_path(known, urls), chance.tolist(), strict=True)]
            cols = [b.column("page_id"), *(pa.array([o[i] for o in out], pa.string()) for i in range(4)), pa.array(chance, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "host", "path", "rule", "verdict", "score"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
