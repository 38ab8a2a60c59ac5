"""Quality classifier by co-training: a text view and a page-metadata view teach each other, calibrated views are combined."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import cut, table
from rowloom.llm.toxicity import sample

#: Exchanges of pseudo-labels, confidence asked of one, weight of all of them against that of all labels.
ROUNDS, CONFIDENT, PSEUDO_WEIGHT = 3, 0.97, 0.5
#: Bins of a number, hash buckets of a source or language, Newton steps of a fit on labels and of one in a round, penalty.
BINS, BUCKETS, STEPS, ROUND_STEPS, PENALTY = 12, 16, 12, 3, 1.0
#: Partial sums that the driver adds up.
PARTS = 8
#: Share of good held documents that the cut may reject at most.
MOST_LOST = 0.005

_SYMBOLS = np.frombuffer(b"#*$%&|<>{}[]=+^~_\\@", np.uint8)
_ENDS = (".", "!", "?", ":", '"')


def text_view(text: str) -> list[float]:
    """Numbers on what a whole text says: characters, words, repetition."""
    words = text.split()
    n, octets = max(1, len(words)), np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    letters = max(1, int(octets[65:91].sum() + octets[97:123].sum() + octets[128:].sum()))
    grams = len(words) - 2
    unique = len(set(words))
    return [
        float(octets[_SYMBOLS].sum()) / n,
        float(octets[65:91].sum()) / letters,
        float(octets[48:58].sum()) / n,
        float(octets[33]) / n,
        float(octets[46] + octets[44]) / n,
        sum(map(len, words)) / n,
        unique / n,
        len(set(zip(words, words[1:], words[2:]))) / grams if grams > 0 else 1.0,
        sum(a == b for a, b in zip(words, words[1:])) / n,
    ]


def page_view(text: str, n_chars: int | None, lang: str | None, source: str | None) -> tuple[list[float], list[int]]:
    """Numbers on a page's layout and size, and buckets of its language and source."""
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(lines))
    numbers = [
        np.log1p(n_chars if n_chars is not None else len(text)),
        np.log1p(len(lines)),
        np.log1p(len(text) / n),
        1 - len(set(lines)) / n if lines else 0.0,
        sum(x.rstrip().endswith(_ENDS) for x in lines) / n,
        sum(x[:1].isupper() for x in lines) / n,
        max(map(len, lines), default=0) / max(1, len(text)),
    ]
    return numbers, [zlib.crc32((lang or "").encode()) % BUCKETS, BUCKETS + zlib.crc32((source or "").encode()) % BUCKETS]


class View:
    """Logistic regression on binned numbers and buckets: additive, so any shape of a number's effect fits."""

    def __init__(self, numbers: np.ndarray):
        qs = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(numbers[:, j], qs)) for j in range(numbers.shape[1])]
        self.size = len(self.edges) * BINS + 2 * BUCKETS + 1  # the last weight is the shift
        self.w = np.zeros(self.size)

    def ids(self, numbers: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """The weights that each row adds up."""
        cols = [j * BINS + np.searchsorted(e, numbers[:, j], side="right") for j, e in enumerate(self.edges)]
        return np.column_stack([*cols, *(len(self.edges) * BINS + buckets).T, np.full(len(numbers), self.size - 1)]).astype(np.int64)

    def logit(self, ids: np.ndarray) -> np.ndarray:
        return self.w[ids].sum(1)

    def slopes(self, ids: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Gradient and curvature of the loss over rows, as one array; sums over parts of the rows add up."""
        p = 1 / (1 + np.exp(-np.clip(self.logit(ids), -30, 30)))
        v, d = p * (1 - p), self.size
        curve = np.zeros(d * d)
        for a in range(ids.shape[1]):
            for b in range(ids.shape[1]):
                curve += np.bincount(ids[:, a] * d + ids[:, b], weights=v, minlength=d * d)
        return np.concatenate((np.bincount(ids.ravel(), weights=np.repeat(p - y, ids.shape[1]), minlength=d), curve))

    def step(self, sums: np.ndarray) -> None:
        """One damped Newton step on the penalised loss."""
        d = self.size
        g, h = sums[:d] + PENALTY * self.w, sums[d:].reshape(d, d) + PENALTY * np.eye(d)
        move = np.linalg.solve(h, g)
        self.w = self.w - move * min(1.0, 4.0 / max(np.abs(move).max(), 1e-12))


def platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that calibrate logits on held rows, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        g = np.array([((p - y) * s).sum() + 1e-2 * (a - 1), (p - y).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * s * s).sum() + 1e-2, (v * s).sum()], [(v * s).sum(), v.sum() + 1e-2]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = max(1e-3, a - step[0]), b - step[1]
    return a, b


class CoTrained:
    """Two views with their calibrations and the cut of the combined score."""

    def __init__(self, views: list[View] | None = None, scales: list[tuple[float, float]] = (), cut_at: float = -np.inf):
        self.views, self.scales, self.cut_at = views, scales, cut_at

    def score_ids(self, ids: list[np.ndarray]) -> np.ndarray:
        """P(text view), P(page view), combined P: the mean of the calibrated logits."""
        z = [a * v.logit(i) + b for v, i, (a, b) in zip(self.views, ids, self.scales)]
        return 1 / (1 + np.exp(-np.clip(np.column_stack([*z, (z[0] + z[1]) / 2]), -30, 30)))

    def score(self, x: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if self.views is None:
            return np.full((len(x[0][0]), 3), 0.5)
        return self.score_ids([v.ids(*part) for v, part in zip(self.views, x)])


def _features(rows: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
    pages = [page_view(t or "", n, lang, source) for t, n, lang, source in rows]
    texts = np.array([text_view(t or "") for t, *_ in rows]).reshape(len(rows), -1)
    none = np.zeros((len(rows), 2), np.int64) + [0, BUCKETS]
    return [(texts, none), (np.array([p[0] for p in pages]).reshape(len(rows), -1), np.array([p[1] for p in pages], np.int64).reshape(len(rows), 2))]


def _measured(rows: DataFrame, *keep: str) -> DataFrame:
    """Columns keep, then t, p (numbers of the views) and b (buckets)."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(keep)
            (t, _), (p, k) = _features(list(zip(*(b.column(n + i).to_pylist() for i in range(4)))))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(t.tolist(), pa.list_(pa.float64())), pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(k.tolist(), pa.list_(pa.int64()))], names=[*keep, "t", "p", "b"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), "t array<double>, p array<double>, b array<long>"])
    return rows.select(*keep, "text", "n_chars", "lang", "source").mapInArrow(run, schema)


def _normal(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("n_chars").cast("long").alias("n_chars"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


def binned(docs: DataFrame, views: list[View], id_col: str = "doc_id") -> DataFrame:
    """doc_id, t, p (the weights that a row adds up in the text and the page view) of every row of docs: whole texts, one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _features(list(zip(*(b.column(i).to_pylist() for i in range(1, 5)))))
            ids = [v.ids(*part).astype(np.int16) for v, part in zip(views, x)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(i), pa.list_(pa.int16())) for i in ids)], names=["doc_id", "t", "p"])

    return _normal(docs, id_col).mapInArrow(run, "doc_id long, t array<short>, p array<short>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def _taught(pool: DataFrame, views: list[View], teachers: list[View], scales: list[tuple[float, float]]) -> list[tuple[float, np.ndarray]]:
    """For each view the number of rows that the other, as it was when the round began, is sure of, and the slopes over them.

    Every unlabelled row is looked at. A task leaves one array a view; PARTS tasks add these up, the driver adds theirs.
    """
    schema, names = "part int, view int, n double, sums binary", ["part", "view", "n", "sums"]

    def out(part: int, found: dict[int, tuple[float, np.ndarray]]) -> pa.RecordBatch:
        rows = sorted(found.items())
        return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array([k for k, _ in rows], pa.int32()), pa.array([n for _, (n, _) in rows], pa.float64()), pa.array([x.tobytes() for _, (_, x) in rows], pa.binary())], names=names)

    def put(found: dict, k: int, n: float, sums: np.ndarray) -> None:
        found[k] = (found[k][0] + n, found[k][1] + sums) if k in found else (n, sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[float, np.ndarray]] = {}
        for b in batches:
            ids = [_matrix(b.column(1)), _matrix(b.column(2))] if b.num_rows else []
            for k in (0, 1) if ids else ():
                a, shift = scales[1 - k]
                p = 1 / (1 + np.exp(-np.clip(a * teachers[1 - k].logit(ids[1 - k]) + shift, -30, 30)))
                sure = (p >= CONFIDENT) | (p <= 1 - CONFIDENT)
                if sure.any():
                    put(found, k, float(sure.sum()), views[k].slopes(ids[k][sure], (p[sure] >= 0.5) * 1.0))
        yield out(zlib.crc32(b"".join(x.tobytes() for _, x in found.values())) % PARTS, found)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[float, np.ndarray]] = {}
        for b in batches:
            for k, n, sums in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                put(found, k, n, np.frombuffer(sums))
        yield out(0, found)

    got = pool.mapInArrow(run, schema).repartition(PARTS, "part").mapInArrow(add, schema).orderBy("view", "n", "sums").collect()
    total: dict[int, tuple[float, np.ndarray]] = {k: (0.0, np.zeros(v.size + v.size**2)) for k, v in enumerate(views)}
    for r in got:
        put(total, r["view"], r["n"], np.frombuffer(r["sums"]))
    return [total[0], total[1]]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", found: list | None = None) -> CoTrained:
    """A model from a bounded sample of the labelled documents (toxicity.FIT_ROWS) and all unlabelled ones.

    Views are fitted on the labels first. In each round a view names labels for the unlabelled rows that it is sure of,
    and the other takes Newton steps on the labels and these. Of the sample eight tenths fit, one calibrates the views
    and one sets the cut. Labels of one kind only: a model that keeps all. found: a list that gets the table of `binned`.
    """
    base = _normal(docs, id_col)
    known = sample(base, labels, "quality", columns=("text", "n_chars", "lang", "source"))
    rows = sorted(_measured(known, "doc_id", "y", "fold").collect())
    y, fold = np.array([r["y"] > 0 for r in rows], float), np.array([r["fold"] for r in rows], np.int64)
    train = fold > 1
    if not len(rows) or y[train].min(initial=1) == y[train].max(initial=0):
        return CoTrained()

    def parts(mask):
        pick = [r for i, r in enumerate(rows) if mask[i]]
        b = np.array([r["b"] for r in pick], np.int64).reshape(len(pick), 2)
        return [(np.array([r["t"] for r in pick]).reshape(len(pick), -1), b * 0 + [0, BUCKETS]), (np.array([r["p"] for r in pick]).reshape(len(pick), -1), b)]

    views = [View(numbers) for numbers, _ in parts(train)]
    ids = [v.ids(*x) for v, x in zip(views, parts(train))]
    calibrate, last = (m if m.any() else train for m in (fold == 0, fold == 1))
    test = [v.ids(*x) for v, x in zip(views, parts(calibrate))]
    for v, x in zip(views, ids):
        for _ in range(STEPS):
            v.step(v.slopes(x, y[train]))
    every = cut(binned(docs, views, id_col))
    if found is not None:
        found.append(every)
    pool = cut(every.join(labels.where(F.col("doc_id").isNotNull()).select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "t", "p"))
    for _ in range(ROUNDS):
        scales = [platt(v.logit(x), y[calibrate]) for v, x in zip(views, test)]
        teachers = [copy(v) for v in views]
        for _ in range(ROUND_STEPS):
            for v, x, (n, sums) in zip(views, ids, _taught(pool, views, teachers, scales)):
                v.step(v.slopes(x, y[train]) + sums * (PSEUDO_WEIGHT * train.sum() / max(n, 1.0)))
    scales = [platt(v.logit(x), y[calibrate]) for v, x in zip(views, test)]
    model = CoTrained(views, scales)
    s = model.score(parts(last))[:, 2]
    good = np.sort(s[y[last] > 0])
    best = _best_cut(s, y[last] > 0)
    model.cut_at = min(best, float(good[int(MOST_LOST * len(good))])) if len(good) else best
    return model


def _best_cut(s: np.ndarray, good: np.ndarray) -> float:
    """The score below which documents are rejected: the best F1 of the bad ones on held rows."""
    if good.all():
        return -np.inf
    order = np.argsort(s, kind="stable")
    hits = np.cumsum(~good[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + (~good).sum())
    k = int(f1.argmax())
    top = s[order][k]
    above = s[s > top]
    return float((top + above.min()) / 2) if len(above) else float(top) + 1e-9


_SCORED, _NAMES = "doc_id long, p_text double, p_page double, score double, kept boolean", ["doc_id", "p_text", "p_page", "score", "kept"]


def score(docs: DataFrame, model: CoTrained, id_col: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, p_text, p_page, score, kept (score at or above the model's cut).

    Null text counts as empty, null metadata as unknown; a null doc_id stays null, repeated rows each get a row, an empty
    table gives no rows, other columns are ignored; rows with equal features get the same score. One pass over whole
    texts of any length, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.score(_features(list(zip(*(b.column(i).to_pylist() for i in range(1, 5))))))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k]) for k in range(3)), pa.array(p[:, 2] >= model.cut_at)], names=_NAMES)

    return _normal(docs, id_col).mapInArrow(run, _SCORED)


def co_train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """fit() and score() of the same documents with their texts measured once."""
    found: list[DataFrame] = []
    model = fit(docs, labels, id_col, found)
    if not found:
        return score(docs, model, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = model.score_ids([_matrix(b.column(1)), _matrix(b.column(2))])
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k]) for k in range(3)), pa.array(p[:, 2] >= model.cut_at)], names=_NAMES)

    return found[0].mapInArrow(run, _SCORED)


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co_train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
