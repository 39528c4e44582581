"""Operator 5: a toxicity classifier with counterfactual regularisation.

Features are a text's words and their beginnings (5 and 7 letters), each with a value that saturates with the count and
falls with the text's length. A logistic regression is trained on labelled documents. From each sentence of them that names
a group of people, copies are made in which the name is swapped for each other one of its kind; the square of the score's
change is part of the loss, so a group's name by itself carries no weight. A second, small regression on cross-fitted scores,
the share of indicative words and the length makes the score a probability; its loss has the same term, on the final score.

Training takes at most `max_rows` labelled documents (smallest hashes of doc_id), with their whole texts, and for the swaps at most
`max_sentences` of their different sentences with a group's name (smallest hashes); these bounds do not depend on the input. Rows
whose crc32(doc_id as text) mod 3 is 1 are held out. The model has at most `max_features` weights and is sent with the tasks.
All documents are scored in one scan, without a shuffle, over their whole texts.

Defined cases: a null or empty text has the score of no features; a document with several labels is toxic if one says so, a
null label is none; without labels of both kinds every score is the share of toxic labels (0 without labels); repeated rows
are scored each; a null doc_id is not held out; other columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Names of groups of people, by kind (fixed values).
IDENTITY = [
    "women men girls boys woman man girl boy female male".split(),
    "muslims christians jews hindus buddhists sikhs atheists catholics".split(),
    "muslim christian jewish hindu buddhist sikh atheist catholic".split(),
    "gay straight lesbian bisexual transgender heterosexual queer".split(),
    "black white asian african european american mexican chinese indian arab latino".split(),
    "immigrants refugees foreigners natives citizens migrants".split(),
    "disabled blind deaf elderly young old".split(),
]
_SWAP = {w: tuple(x for x in kind if x != w) for kind in IDENTITY for w in kind}
_EDGE = ".,;:!?\"'()[]{}#*$%&|<>-_/\\~^+=@`0123456789"
_BEGIN = (5, 7)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def forms(raw: str) -> tuple[str, ...]:
    """The features of a lower-case token: its word and the word's beginnings; none if it has no word."""
    w = raw.strip(_EDGE)
    return (w, *(w[:q] + "*" for q in _BEGIN if len(w) > q)) if w else ()


def features(text: str | None) -> tuple[Counter, int]:
    """Counts of the features and the number of words."""
    counts: Counter = Counter()
    n = 0
    for raw, k in Counter((text or "").lower().split()).items():
        found = forms(raw)
        n += k if found else 0
        for f in found:
            counts[f] += k
    return counts, n


def swapped(text: str) -> list[tuple[Counter, Counter, int]]:
    """For each sentence with a name of a group: its features, those with the name swapped, and its length."""
    out = []
    for sentence in _SENTENCE.split(text or ""):
        ws = sentence.lower().split()
        for i, raw in enumerate(ws):
            w = raw.strip(_EDGE)
            for other in _SWAP.get(w, ()):
                a, n = features(sentence)
                b, _ = features(" ".join([*ws[:i], other, *ws[i + 1 :]]))
                out.append((a, b, n))
    return out


def _value(count: np.ndarray | float, n: np.ndarray | float):
    return np.minimum(3.0 * count / np.sqrt(np.maximum(n, 1)), 3.0)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Matrix:
    """A sparse matrix: row, column, count and value of each entry, by rows and by columns. rows: (columns, counts, words of the text)."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, int]], d: int) -> None:
        size = [len(c) for c, _, _ in rows]
        self.n, self.d = len(rows), d
        self.r = np.repeat(np.arange(self.n, dtype=np.int32), size)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        self.c = join([c for c, _, _ in rows], np.int32)
        self.counts = join([k for _, k, _ in rows], np.float32)
        self.v = _value(self.counts, np.repeat(np.array([n for _, _, n in rows], np.float32), size)).astype(np.float32)
        self.rows, self.row_at = np.unique(self.r, return_index=True)
        order = np.argsort(self.c, kind="stable")
        self.by_column_r, self.by_column_v = self.r[order], self.v[order]
        self.columns, self.column_at = np.unique(self.c[order], return_index=True)

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.rows):
            out[self.rows] = np.add.reduceat(self.v * w[self.c], self.row_at)
        return out

    def back(self, e: np.ndarray) -> np.ndarray:
        out = np.zeros(self.d)
        if len(self.columns):
            out[self.columns] = np.add.reduceat(self.by_column_v * e[self.by_column_r], self.column_at)
        return out


def _fit(x: Matrix, y: np.ndarray, use: np.ndarray, pairs: tuple[Matrix, Matrix] | None, ridge: float, fairness: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and intercept, by adaptive gradient steps."""
    share = y[use].mean()
    w, b = np.zeros(x.d), float(np.log(share / (1 - share)))
    square, square_b = np.full(x.d, 1e-8), 1e-8
    for _ in range(steps):
        e = np.where(use, _sigmoid(b + x.dot(w)) - y, 0) / use.sum()
        g = x.back(e) + ridge * w
        if pairs and pairs[0].n:
            gap = pairs[0].dot(w) - pairs[1].dot(w)
            gap *= 2 * fairness / len(gap)
            g += pairs[0].back(gap) - pairs[1].back(gap)
        square += g * g
        w -= 0.3 * g / np.sqrt(square)
        square_b += e.sum() ** 2
        b -= 0.1 * e.sum() / np.sqrt(square_b)
    return w, b


def _summary(z: np.ndarray, hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the second regression sees: the first score, the share and number of indicative words, the length."""
    n = np.maximum(n, 1)
    return np.stack([np.ones_like(z), z, np.minimum(100 * hits / n, 10), np.log1p(hits), np.log(n) / 5], axis=1)


def _newton(x: np.ndarray, y: np.ndarray, gaps: np.ndarray, fairness: float, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression; gaps: what swaps change in the rows of x, penalised by the mean square of the score's change."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w)) + (fairness * len(x) / len(gaps) * gaps.T @ gaps if len(gaps) else 0)
    for _ in range(30):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(h, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """weights: by feature; top: of the second regression; indicative: from which weight on a feature counts as an indicative word."""

    def __init__(self, weights: dict[str, float], intercept: float, top: list[float], indicative: float) -> None:
        self.weights, self.intercept, self.top, self.indicative = weights, intercept, top, indicative
        # By the length of the beginning, so that scoring makes no string but the beginning itself.
        self.begins = [(q, {f[:q]: w for f, w in weights.items() if len(f) == q + 1 and f[q] == "*"}) for q in _BEGIN]

    def score(self, text: str | None) -> float:
        whole: dict[str, int] = {}
        n = 0
        for raw, k in Counter((text or "").lower().split()).items():
            if w := raw.strip(_EDGE):
                n += k
                whole[w] = whole.get(w, 0) + k
        z, hits = self.intercept, 0.0
        scale = 3.0 / max(n, 1) ** 0.5

        def add(counts: dict[str, int], weights: dict[str, float]) -> None:
            nonlocal z, hits
            for f in counts.keys() & weights.keys():
                w = weights[f]
                z += w * min(scale * counts[f], 3.0)
                if w >= self.indicative:
                    hits += counts[f]

        add(whole, self.weights)
        for q, weights in self.begins:
            counts: dict[str, int] = {}
            for w, k in whole.items():
                if len(w) > q:
                    b = w[:q]
                    counts[b] = counts.get(b, 0) + k
            add(counts, weights)
        s = _summary(np.array([z]), np.array([hits]), np.array([float(n)]))[0]
        return float(_sigmoid(float(s @ np.array(self.top))))


def columns(counts: Counter, column: dict[str, int], n: int) -> tuple[np.ndarray, np.ndarray, int]:
    known = [(column[f], k) for f, k in counts.items() if f in column]
    return np.array([c for c, _ in known], np.int32), np.array([k for _, k in known], np.int32), n


def train(names: list[str], rows: list[tuple[np.ndarray, np.ndarray, int]], y: np.ndarray, pairs: list[tuple[Counter, Counter, int]], ridge: float = 1e-4, fairness: float = 10.0, steps: int = 150, folds: int = 10) -> Model:
    """names: the features; rows: (columns, counts, words) of each labelled text, in an order that is the same each time."""
    y = y.astype(float)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model({}, 0.0, [float(np.log(p / (1 - p))), 0, 0, 0, 0], np.inf)
    column = {f: j for j, f in enumerate(names)}
    x = Matrix(rows, len(names))
    both = (Matrix([columns(a, column, n) for a, _, n in pairs], len(names)), Matrix([columns(b, column, n) for _, b, n in pairs], len(names)))
    n = np.array([r[2] for r in rows], float)
    fold = np.arange(len(rows)) % folds
    z, hits = np.zeros(len(rows)), np.zeros(len(rows))
    for k in range(folds):
        use = fold != k
        if len(set(y[use].tolist())) < 2:
            use = np.ones(len(rows), bool)
        w, b = _fit(x, y, use, both, ridge, fairness, steps)
        z = np.where(fold == k, b + x.dot(w), z)
        mark = (w >= _indicative(w)).astype(float)
        hits = np.where(fold == k, np.bincount(x.r, x.counts * mark[x.c], minlength=len(rows)), hits)
    w, b = _fit(x, y, np.ones(len(rows), bool), both, ridge, fairness, steps)
    mark, sizes = (w >= _indicative(w)).astype(float), np.array([n for _, _, n in pairs], float)
    ends = [_summary(b + m.dot(w), np.bincount(m.r, m.counts * mark[m.c], minlength=m.n), sizes) for m in both]
    top = _newton(_summary(z, hits, n), y, ends[0] - ends[1], fairness)
    return Model({f: float(v) for f, v in zip(names, w, strict=True) if v}, b, top.tolist(), _indicative(w))


def _indicative(w: np.ndarray) -> float:
    """From which weight on a feature counts as indicative: half of the fifth largest."""
    return float(np.sort(w)[-min(5, len(w))] / 2) if len(w) and w.max() > 0 else np.inf


def _held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_sentences: int = 2000, min_documents: int = 4, max_features: int = 60_000, **options) -> Model:
    """A model from labels (doc_id, toxic) and the texts of docs (doc_id, text). Features are made and counted on the executors; the driver
    gets the names of at most max_features of them, the numbers of at most max_rows texts, and at most max_sentences sentences."""
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(~_held_out("doc_id"))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")  # at most max_rows rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, toxic, text in zip(b.column("doc_id"), b.column("toxic"), b.column("text"), strict=True):
                text = text.as_py()
                counts, n = features(text)
                named = {s for s in _SENTENCE.split(text or "") if any(w.strip(_EDGE) in _SWAP for w in s.lower().split())}
                for col, x in zip(out, (doc.as_py(), toxic.as_py(), n, list(counts), list(counts.values()), sorted(named)), strict=True):
                    col.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "toxic", "n", "f", "k", "named"])

    made = stored(texts.select("doc_id", "toxic", "text").mapInArrow(extract, "doc_id long, toxic int, n long, f array<string>, k array<int>, named array<string>"), "features")
    often = made.select(F.explode("f").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_documents)
    names = [r["f"] for r in often.orderBy(F.desc("n"), "f").limit(max_features).collect()]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = {f: j for j, f in enumerate(names)}
        for b in batches:
            cs, ks = [], []
            for f, k in zip(b.column("f"), b.column("k"), strict=True):
                known = [(column[x], y) for x, y in zip(f.as_py(), k.as_py(), strict=True) if x in column]
                cs.append([c for c, _ in known])
                ks.append([y for _, y in known])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("n"), pa.array(cs, pa.list_(pa.int32())), pa.array(ks, pa.list_(pa.int32()))], names=["doc_id", "toxic", "n", "c", "k"])

    got = made.mapInArrow(number, "doc_id long, toxic int, n long, c array<int>, k array<int>").toArrow()
    named = made.select(F.explode("named").alias("s")).distinct().orderBy(F.xxhash64("s"), "s").limit(max_sentences).collect()
    y, n = got.column("toxic").to_numpy(), got.column("n").to_numpy()
    order = np.lexsort((n, got.column("doc_id").to_numpy())).tolist()
    cs, ks = got.column("c"), got.column("k")
    rows = [(cs[i].values.to_numpy(), ks[i].values.to_numpy(), int(n[i])) for i in order]
    pairs = [p for r in named for p in swapped(r["s"])]
    return train(names, rows, y[order], pairs, **options)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs with score and predicted added (they replace columns of these names)."""
    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*columns).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([model.score(t.as_py()) for t in b.column("text")], float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*columns, "score", "predicted"])

    return docs.select(*columns).mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", _held_out("doc_id").alias("held_out"), "score", "predicted")
