"""Toxicity: cumulative-link ordinal regression on sparse text features, expected severity of every document."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import cut, drop_since, made, table

#: Labelled rows that the fit uses at most, in the order of a hash of their ids.
FIT_ROWS = 20_000
#: Texts whose features a task counts at a time.
SLICE = 500
#: Lengths of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6)
#: A feature needs so many documents and so many standard errors of log odds; a strong one also has such log odds.
LEAST_DOCS, LEAST_Z, STRONG = 3, 4.0, 3.0
#: Severity grades above 0 (not toxic), steps of the fit, weight penalty.
GRADES, STEPS, PENALTY = 3, 200, 1e-4

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> list[set]:
    """Distinct words of a whole text in lower case, then their beginnings of each length."""
    words = set(_WORD.findall((text or "").lower()))
    return [words, *({w[:n] for w in words if len(w) > n} for n in PREFIXES)]


def _ids(text: str | None, vocabulary: list[dict]) -> list[int]:
    return [v[f] for found, v in zip(features(text), vocabulary) for f in found & v.keys()]


def sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """doc_id, y, fold (0 to 9, by a hash of the id), columns of at most FIT_ROWS labelled documents, written once.

    Of rows that repeat an id the least counts, of labels that do the greatest, so that reruns agree.
    """
    by_id = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    few = by_id.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(FIT_ROWS)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(*[F.col(c) for c in columns]).alias("row"))
    both = picked.join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.min("row").alias("row"))
    return cut(both.select("doc_id", "y", F.pmod(F.xxhash64("doc_id"), F.lit(10)).cast("int").alias("fold"), *[F.col("row")[c].alias(c) for c in columns]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(lo, SLICE) for whole in batches for lo in range(0, whole.num_rows, SLICE)):
        seen: dict[tuple[int, int], Counter] = {(half, y): Counter() for half in (0, 1) for y in (0, 1)}
        for y, half, text in zip(*(c.to_pylist() for c in batch.columns)):
            for kind, found in enumerate(features(text)):
                seen[half, min(1, max(0, y))].update((kind, f) for f in found)
        for (half, y), counts in seen.items():
            kinds, names = zip(*counts) if counts else ((), ())
            n = list(counts.values())
            cols = [n if (h, t) == (half, y) else [0] * len(n) for h in (0, 1) for t in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(names, pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names=["kind", "name", "n00", "n01", "n10", "n11"])


def vocabulary(fit_rows: DataFrame) -> list[tuple]:
    """(kind, name, strong in half 0, strong in half 1) of the features that tell toxic documents from others, strongest first.

    fit_rows: y, half, text of the labelled rows of the fit, a bounded sample. A half's marks come from its rows alone.
    """
    totals = fit_rows.groupBy("half", (F.col("y") > 0).cast("int").alias("t")).agg(F.count("*").alias("n")).collect()
    n = {(r["half"], r["t"]): r["n"] for r in totals}
    size = lambda half, t: n.get((half, t), 0)
    if not all(size(0, t) + size(1, t) for t in (0, 1)):
        return []
    counts = fit_rows.select("y", "half", "text").mapInArrow(_count, "kind int, name string, n00 long, n01 long, n10 long, n11 long")
    counts = counts.groupBy("kind", "name").agg(*[F.sum(c).alias(c) for c in ("n00", "n01", "n10", "n11")])

    def told(pos, neg, n_pos: int, n_neg: int):
        p, q = pos + 0.5, neg + 0.5
        odds = F.log(p / (n_pos + 1.0)) - F.log(q / (n_neg + 1.0))
        return odds, F.abs(odds) / F.sqrt(1 / p + 1 / q)

    c = F.col
    _, z = told(c("n01") + c("n11"), c("n00") + c("n10"), size(0, 1) + size(1, 1), size(0, 0) + size(1, 0))
    halves = [told(c(f"n{h}1"), c(f"n{h}0"), size(h, 1), size(h, 0)) for h in (0, 1)]
    strong = [(odds >= STRONG) & (zh >= LEAST_Z / 2) for odds, zh in halves]
    enough = c("n00") + c("n01") + c("n10") + c("n11") >= LEAST_DOCS
    top = counts.where(enough).select("kind", "name", z.alias("z"), strong[0].alias("s0"), strong[1].alias("s1")).where(c("z") >= LEAST_Z)
    return [(r["kind"], r["name"], r["s0"], r["s1"]) for r in top.orderBy(c("z").desc(), "kind", "name").collect()]


def grade(y: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Severity 0 to GRADES: 0 if not toxic, else by a text's marks, in equal parts of the toxic rows."""
    out = np.zeros(len(y), np.int64)
    toxic = y > 0
    if toxic.any():
        edges = np.quantile(marks[toxic], [k / GRADES for k in range(1, GRADES)])
        out[toxic] = 1 + (marks[toxic][:, None] > edges[None, :]).sum(1)
    return out


class Ordinal:
    """P(grade > k) = sigmoid(w.x - t_k): one weight vector for all thresholds t_0 <= t_1 <= ... ."""

    def __init__(self, vocabulary: list[dict], weights: np.ndarray, cuts: np.ndarray, reject: float):
        self.vocabulary, self.weights, self.cuts, self.reject = vocabulary, weights, cuts, reject

    def severity(self, eta: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(-np.clip(eta[:, None] - self.cuts[None, :], -30, 30)))).sum(1)

    def eta(self, text: str | None) -> float:
        found = sorted(_ids(text, self.vocabulary))  # one order of summation, so that reruns agree
        return float(self.weights[found].sum()) if found else 0.0


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts by Adagrad steps on the mean negative log likelihood of the grades."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ids = np.fromiter((i for r in rows for i in r), np.int64, len(at))
    k = GRADES
    above = np.array([max(1, int((grades > j).sum())) for j in range(k)], float)
    cuts = np.maximum.accumulate(-np.log(above / (len(grades) - above + 1)))
    first, gaps = cuts[0], np.log(np.maximum(np.diff(cuts), 0.05))
    w = np.zeros(n_features)
    past = [np.full(n_features, 1e-8), 1e-8, np.full(k - 1, 1e-8)]
    n = len(grades)
    for _ in range(STEPS):
        cuts = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        eta = np.bincount(at, weights=w[ids], minlength=n) if len(ids) else np.zeros(n)
        over = 1 / (1 + np.exp(-np.clip(eta[:, None] - cuts[None, :], -30, 30)))
        edge = np.concatenate((np.ones((n, 1)), over, np.zeros((n, 1))), 1)
        here = np.arange(n)
        p = np.maximum(edge[here, grades] - edge[here, grades + 1], 1e-9)
        slope = np.concatenate((np.zeros((n, 1)), over * (1 - over), np.zeros((n, 1))), 1)
        d_eta = -(slope[here, grades] - slope[here, grades + 1]) / p / n
        d_cut = np.zeros((n, k + 2))
        d_cut[here, grades] += slope[here, grades] / p / n
        d_cut[here, grades + 1] -= slope[here, grades + 1] / p / n
        by_cut = d_cut[:, 1:-1].sum(0)
        grad = [np.bincount(ids, weights=d_eta[at], minlength=n_features) + PENALTY * w if len(ids) else w * 0, by_cut.sum(), np.array([by_cut[j + 1 :].sum() * np.exp(gaps[j]) for j in range(k - 1)])]
        for j in range(3):
            past[j] = past[j] + grad[j] ** 2
        w, first, gaps = w - 0.3 * grad[0] / np.sqrt(past[0]), first - 0.1 * grad[1] / np.sqrt(past[1]), gaps - 0.1 * grad[2] / np.sqrt(past[2])
    return w, first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))


def best_cut(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The score from which rows are rejected: the best F1 on held rows, in the middle of the gap there; none toxic: infinity."""
    if not toxic.any():
        return float("inf")
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + toxic.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float(s[k] if k + 1 == len(s) else (s[k] + s[k + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """A model from a bounded labelled sample. No labelled toxic rows: a model that rejects nothing.

    Labels are binary, so grades above 0 need a signal that the model's own weights don't make: a toxic row is graded by
    the words that mark toxic texts in the half of the sample that it isn't in. A fifth of the rows is held for the cut.
    """
    mark = made()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = sample(picked, labels, "toxic").withColumn("half", F.col("fold") % 2).withColumn("held", F.col("fold") < 2)
    names = vocabulary(rows.where(~F.col("held")))
    kinds: list[dict] = [{} for _ in range(1 + len(PREFIXES))]
    for i, (kind, name, _, _) in enumerate(names):
        kinds[kind][name] = i
    if not names:
        return Ordinal(kinds, np.zeros(0), np.full(GRADES, 30.0), float("inf"))
    strong = np.array([[s0, s1] for _, _, s0, s1 in names])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array([_ids(t, kinds) for t in b.column(4).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "y", "held", "half", "ids"])

    got = rows.select("doc_id", "y", "held", "half", "text").mapInArrow(encode, "doc_id long, y int, held boolean, half int, ids array<int>").orderBy("doc_id").collect()
    drop_since(mark)
    ids, y, held = [sorted(r["ids"]) for r in got], np.array([r["y"] for r in got]), np.array([r["held"] for r in got], bool)
    marks = np.array([int(strong[i, 1 - r["half"]].sum()) if i else 0 for i, r in zip(ids, got)])
    train = np.flatnonzero(~held)
    w, cuts = fit_ordinal([ids[i] for i in train], grade(y[train], marks[train]), len(names))
    model = Ordinal(kinds, w, cuts, float("inf"))
    calibrate = np.flatnonzero(held) if (y[held] > 0).any() else train
    eta = np.array([w[ids[i]].sum() if ids[i] else 0.0 for i in calibrate])
    model.reject = best_cut(model.severity(eta), y[calibrate] > 0)
    return model


def score(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, severity (expected grade, 0 to GRADES), kept (severity below the model's cut).

    Null or blank text has no features and gets the severity of a text without any. A null doc_id stays null, repeated
    rows each get a row, an empty table gives no rows, other columns are ignored. Rows with as many signs get the same
    severity. One pass over whole texts of any length, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            eta = np.array([model.eta(t.as_py()) for t in b.column(1)], float)
            s = model.severity(eta)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(s < model.reject)], names=["doc_id", "severity", "kept"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, severity double, kept boolean")


def keep_clean(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """docs, same columns, without the rows that the model rejects: one pass, whole rows through Arrow, no join."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.severity(np.array([model.eta(t.as_py()) for t in b.column(at)], float))
            yield b.filter(pa.array(s < model.reject))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
