"""Classifier chains for toxicity over hashed word stems.

The categories are label columns in chain order; the model of each is a logistic regression whose
features are the stems of a text's words and the probabilities that the earlier models gave it. Later
models are trained with out-of-fold probabilities, so they see earlier categories as wrong as they will
be on new texts. The last category decides: its threshold is the one with the best F1 on out-of-fold
probabilities, at least `least_p`.

A word's stems are itself and its prefixes of 3 to 6 code points, A-Z lower-cased and punctuation at the
ends taken off, as sets: how often a stem repeats and how long the text is don't matter. Per category up to
`n_stems` stems are chosen, by the signed roots of chi-squared from `least_z` up; of stems that extend one
another only the one with the best score.

Training takes a bounded sample: of the labelled identifiers those with the `sample` smallest hashes
(default 6,000), whose texts are turned into their distinct words where they stand; the driver gets these and
a hash of each text. The fitted model has at most n_stems weights a category and goes to the tasks with the
function. Scoring reads whole texts of all rows without a shuffle.

Defined results: null and empty texts have no stems and get the intercepts' probabilities; rows with a
null label aren't trained on; a null identifier is scored but never trained on; rows that repeat pass
through, and of texts that share a labelled identifier each is trained on; a very long text counts by its
distinct words, and words of more than 64 characters aren't remembered; other columns stay as they are,
whatever their names; an empty table gives an empty result; without labelled rows of both kinds a category's
probability is its training mean (0 without rows), and nothing is rejected.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 6000
MEMO = 1 << 18  # words
PREFIXES = (3, 4, 5, 6)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»‘’“”…¿¡"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str) -> set[str]:
    """Distinct words. A word's stems are itself with a blank at its end, and its prefixes."""
    return {x for w in set(text.translate(UPPER).split()) if (x := w.strip(PUNCTUATION))}


def logistic(x: np.ndarray, y: np.ndarray, *, penalty: float = 0.3, steps: int = 30) -> np.ndarray:
    """Weights with the intercept last, by Newton's method with an L2 penalty; x is dense and narrow."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * v[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Link:
    """One model of the chain: weights of stems, of the earlier categories' probabilities, and the intercept."""

    weights: dict[str, float]
    earlier: list[float]
    intercept: float

    def score(self, own: set[str], before: list[float]) -> float:
        """own: the text's stems, or those of them that have a weight in any link."""
        z = self.intercept + sum(a * b for a, b in zip(self.earlier, before, strict=True))
        z += sum(self.weights[s] for s in sorted(own & self.weights.keys()))
        return float(1 / (1 + math.exp(-min(30.0, max(-30.0, z)))))


@dataclass
class Chain:
    categories: list[str]
    links: list[Link] = field(default_factory=list)
    threshold: float = 1.0
    memo: dict[str, tuple[str, ...]] | None = None  # of a text's words, in the process that scores
    weighted: set[str] | None = None

    def score(self, text: str) -> list[float]:
        if self.memo is None or len(self.memo) > MEMO:
            self.memo = {}
        memo, own = self.memo, set()
        for w in set(text.split()):
            if (got := memo.get(w)) is None:
                got = self.marks(w)
                if len(w) <= 64:
                    memo[w] = got
            if got:
                own.update(got)
        out: list[float] = []
        for link in self.links:
            out.append(link.score(own, out))
        return out

    def marks(self, word: str) -> tuple[str, ...]:
        """The stems of a word that have a weight in any link."""
        if self.weighted is None:
            self.weighted = {s for link in self.links for s in link.weights}
        x = word.translate(UPPER).strip(PUNCTUATION)
        return tuple([s for s in (x + " ", *[x[:n] for n in PREFIXES if len(x) >= n]) if s in self.weighted])


def coded(texts: Iterable[set[str]]) -> tuple[list[str], list[np.ndarray]]:
    """Of texts as words: the names of all stems, and each text's as sorted places among them."""
    of_word: dict[str, int] = {}
    stem_id: dict[str, int] = {}
    table: list[list[int]] = []
    docs = []
    for own in texts:
        for w in own:
            if w not in of_word:
                of_word[w] = len(table)
                table.append([stem_id.setdefault(s, len(stem_id)) for s in (w + " ", *[w[: min(n, len(w))] for n in PREFIXES])] if len(w) >= PREFIXES[0] else [stem_id.setdefault(w + " ", len(stem_id))] * (1 + len(PREFIXES)))
        docs.append(np.fromiter((of_word[w] for w in own), np.int64, len(own)))
    lookup = np.array(table, np.int64).reshape(-1, 1 + len(PREFIXES))
    return list(stem_id), [np.unique(lookup[d]) for d in docs]


def choose(names: list[str], rows: list[np.ndarray], y: np.ndarray, n_stems: int, least: int, least_z: float) -> list[int]:
    """Stems that mark y."""
    hit, total = (np.bincount(np.concatenate([*own, np.zeros(0, np.int64)]), minlength=len(names)).astype(float) for own in ([r for r, v in zip(rows, y, strict=True) if v], rows))
    n_pos, n_neg = float(y.sum()), float(len(y) - y.sum())
    a, b, c, d = hit, n_pos - hit, total - hit, n_neg - (total - hit)
    z = (a * d - b * c) * np.sqrt(len(y) / np.maximum(n_pos * n_neg * (a + c) * (b + d), 1))  # signed root of chi-squared
    z[total < least] = -1
    out: list[int] = []
    taken: set[str] = set()  # the prefixes of what was chosen, and that itself
    for i in sorted(np.flatnonzero(z >= least_z).tolist(), key=lambda i: (-z[i], len(names[i]), names[i])):
        if len(out) == n_stems:
            break
        parts = [names[i][:k] for k in range(PREFIXES[0], len(names[i]) + 1)]
        if names[i] in taken or any(p in taken and p in {names[k] for k in out} for p in parts):
            continue
        out.append(i)
        taken.update(parts)
    return out


def _design(rows: list[np.ndarray], chosen: list[int], n_names: int) -> np.ndarray:
    column = np.full(n_names, -1)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen)))
    for i, r in enumerate(rows):
        own = column[r]
        x[i, own[own >= 0]] = 1
    return x


def _fit(names: list[str], rows: list[np.ndarray], before: np.ndarray, y: np.ndarray, n_stems: int, least: int, least_z: float) -> tuple[Link, list[int]]:
    if y.sum() in (0, len(y)):
        p = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return Link({}, [0.0] * before.shape[1], float(np.log(p / (1 - p)))), []
    chosen = choose(names, rows, y, n_stems, least, least_z)
    w = logistic(np.hstack([_design(rows, chosen, len(names)), before]), y.astype(float))
    return Link(dict(zip([names[i] for i in chosen], w[: len(chosen)].tolist(), strict=True)), w[len(chosen) : -1].tolist(), float(w[-1])), chosen


def best_threshold(p: np.ndarray, y: np.ndarray, least: float) -> float:
    """The threshold halfway between two scores with the best F1."""
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1  # ties fall together
    i = int(np.argmax(f1))
    return max(least, (p[i] + p[i + 1]) / 2 if i + 1 < len(p) else p[i])


def fit_chain(texts: list[str], labels: np.ndarray, categories: list[str], **options) -> Chain:
    """The chain of whole texts."""
    return fit_words([words(t) for t in texts], [zlib.crc32(t.encode()) for t in texts], labels, categories, **options)


def fit_words(texts: Iterable[set[str]], marks: list[int], labels: np.ndarray, categories: list[str], *, folds: int = 5, n_stems: int = 400, least: int = 5, least_z: float = 5.0, least_p: float = 0.2) -> Chain:
    """texts: as words; marks: hashes of the texts, which give their folds, so copies share one; labels: a column of 0 and 1 a category, in chain order."""
    (names, rows), chain = coded(texts), Chain(categories)
    fold = np.array([m % folds for m in marks], int)
    before = np.zeros((len(rows), 0))
    for k in range(len(categories)):
        y, out = labels[:, k], np.zeros(len(rows))
        for f in range(folds):
            rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            link, chosen = _fit(names, [rows[i] for i in rest], before[rest], y[rest], n_stems, least, least_z)
            x = np.hstack([_design([rows[i] for i in own], chosen, len(names)), before[own]])
            out[own] = 1 / (1 + np.exp(-np.clip(x @ np.array([*link.weights.values(), *link.earlier]) + link.intercept, -30, 30)))
        chain.links.append(_fit(names, rows, before, y, n_stems, least, least_z)[0])
        before = np.hstack([before, out[:, None]])
    y = labels[:, -1]
    chain.threshold = best_threshold(before[:, -1], y, least_p) if 0 < y.sum() < len(y) else float("inf")
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", **options) -> Chain:
    """categories: name by SQL expression over labels (1 or 0, null: no label), in chain order; the last decides.

    An identifier with several label rows is trained on with the largest value of each.
    """
    named = labels.select(F.col(id_col).cast("bigint").alias("__id"), *[F.expr(e).cast("int").alias(f"__{i}") for i, e in enumerate(categories.values())]).dropna()
    named = named.groupBy("__id").agg(*[F.max(f"__{i}").alias(f"__{i}") for i in range(len(categories))])
    # The sample is fixed by identifiers before any text is read.
    named = named.withColumn("__h", F.xxhash64("__id")).orderBy("__h", "__id").limit(sample)
    own = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    columns = [f"__{i}" for i in range(len(categories))]
    rows = own.join(F.broadcast(named), "__id").select("__h", "__id", F.coalesce("__text", F.lit("")).alias("__text"), *columns)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text as its distinct words and a hash: no text leaves its task."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column(2).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64()), pa.array(["\n".join(sorted(words(t))) for t in texts]), *part.columns[3:]], names=["__h", "__id", "__mark", "__words", *columns])

    schema = "__h bigint, __id bigint, __mark bigint, __words string, " + ", ".join(f"{c} int" for c in columns)
    found = rows.mapInArrow(told, schema).orderBy("__h", "__id", "__mark", "__words").limit(sample).collect()
    y = np.array([[r[c] for c in columns] for r in found], int).reshape(len(found), len(categories))
    return fit_words((set(filter(None, r["__words"].split("\n"))) for r in found), [r["__mark"] for r in found], y, list(categories), **options)


def score(docs: DataFrame, chain: Chain, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a probability p_<category> each, and toxic: the last one is at least the threshold."""
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array([chain.score(x or "") for x in batch.column(1).to_pylist()]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, i]) for i in range(len(names))], pa.array(p[:, -1] >= chain.threshold)], names=["doc_id", *names, "toxic"])

    schema = "doc_id bigint, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean"
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, chain: Chain, *, text_col: str = "text") -> DataFrame:
    """docs without the rows that the chain rejects, all columns as they are."""

    @F.pandas_udf("boolean")
    def clean(texts):
        return texts.map(lambda x: chain.score(x or "")[-1] < chain.threshold)

    return docs.where(clean(F.col(text_col).cast("string")))
