"""Quality classifier by co-training on two views of a document.

One classifier sees the text's content, the other the page's metadata. Both start from
the labelled sample. In a round each labels all unlabelled documents for the other that it
is sure of, and both are fitted again. How sure a view must be is read off labelled
documents kept aside: a view hands over only above the score from which its verdicts were
right often enough there, and nothing where there is no such score. Both views are
calibrated on the documents kept aside, and every document is scored by the two together.

Every unlabelled document takes part in every round. A task adds its documents to the sums
of a Newton step, and the driver gets the total, whose size is that of the model.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmotion.llm.common import stored

#: Bound of the labelled sample that is fitted on, in documents.
LABELLED = 4000
#: Co-training rounds, Newton steps in each, and the ridge.
ROUNDS, STEPS, RIDGE = 4, 2, 10.0
#: A view hands over what it scores above a score that kept PRECISION on SUPPORT documents aside, at least.
PRECISION, SUPPORT = 0.95, 10
#: All that a view is handed weighs at most so many times what its labelled documents weigh.
HANDED = 4.0
WORDS, KINDS = 128, 32
MARKS = "#*$%&|<>!?.,"


def text_view(text: str | None) -> np.ndarray:
    """Shares of kinds of characters, of repeats and of closed lines, and hashed word shares."""
    t = text or ""
    w, lines = t.split(), [x for x in t.split("\n") if x.strip()]
    n, m = max(1, len(t)), max(1, len(w))
    letters = sum(map(str.isalpha, t))
    known: dict[str, int] = {}
    for x in w:
        known[x] = known.get(x, 0) + 1
    shape = [letters / n, sum(map(str.isupper, t)) / max(1, letters), sum(map(str.isdigit, t)) / n, *(t.count(c) / m for c in MARKS),
             len(w) > 0, np.log1p(len(w)) / 5, len(t) / m / 10, len(known) / m, max(known.values(), default=0) / m,
             1 - len(set(lines)) / max(1, len(lines)), sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines))]
    hashed = np.zeros(WORDS)
    for x, k in known.items():
        hashed[zlib.crc32(x.encode("utf-8", "surrogatepass")) % WORDS] += k
    return np.concatenate([shape, np.sqrt(hashed / m)]).astype(np.float32)


def meta_view(lang: str | None, source: str | None, n_chars: int | None, size: int) -> np.ndarray:
    """Declared language, source and length, and how the declared length fits the stored one."""
    v = np.zeros(2 * KINDS + 4, np.float32)
    for i, x in enumerate((lang, source)):
        v[i * KINDS + zlib.crc32(repr(x).encode("utf-8", "surrogatepass")) % KINDS] = 1
    declared = 0 if n_chars is None else max(0, int(n_chars))
    v[2 * KINDS :] = np.log1p(declared) / 5, np.log1p(size) / 5, n_chars is None, np.log1p(abs(declared - size)) / 5
    return v


@dataclass(frozen=True)
class View:
    """A logistic classifier with standardised inputs, its calibration and the log odds
    from which it hands over bad and good documents."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    sure: tuple[float, float] = (-np.inf, np.inf)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -6, 6), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weights

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.offset

    def pseudo_labels(self, x: np.ndarray) -> np.ndarray:
        """0 and 1 for what it hands over, else -1."""
        raw = self.raw(x)
        return np.where(raw <= self.sure[0], 0, np.where(raw >= self.sure[1], 1, -1))


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def newton_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log loss at w, summed over rows."""
    p = _chance(z @ w)
    return z.T @ (p - y), (z.T * (p * (1 - p))) @ z


def _stepped(w: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, ridge: float) -> np.ndarray:
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6  # the intercept
    return w - np.linalg.solve(curvature + np.diag(penalty), gradient + penalty * w)


def _logistic(z: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        new = _stepped(w, *newton_sums(z, y, w), ridge)
        moved, w = np.abs(new - w).max(), new
        if moved < 1e-8:
            break
    return w


def fit_view(x: np.ndarray, y: np.ndarray) -> View:
    mean, scale = x.mean(axis=0), x.std(axis=0)
    v = View(mean, np.where(scale > 1e-6, scale, 1.0), np.zeros(x.shape[1] + 1))
    return replace(v, weights=_logistic(v.inputs(x), y, RIDGE))


def calibrated(view: View, x: np.ndarray, y: np.ndarray) -> View:
    """Platt's scaling on documents that the view was not fitted on."""
    if len(set(y.tolist())) < 2:
        return view
    slope, offset = _logistic(np.stack([view.raw(x), np.ones(len(x))], axis=1), y, ridge=1e-3)
    return replace(view, slope=max(0.0, float(slope)), offset=float(offset) if slope > 0 else float(np.log(y.mean() / (1 - y.mean()))))


def _loss(view: View, x: np.ndarray, y: np.ndarray) -> float:
    """Log loss of the view's calibrated odds."""
    z = np.clip(calibrated(view, x, y).log_odds(x), -30, 30)
    return float(np.mean(np.log1p(np.exp(z)) - y * z))


def gated(view: View, x: np.ndarray, y: np.ndarray) -> View:
    """The scores beyond which the view was right often enough on the documents aside."""
    raw = view.raw(x)

    def bound(order: np.ndarray, wanted: int, none: float) -> float:
        right = np.cumsum(y[order] == wanted) / np.arange(1, len(order) + 1)
        at = np.flatnonzero((right >= PRECISION) & (np.arange(1, len(order) + 1) >= SUPPORT) & (np.append(np.diff(raw[order]), 1) != 0))
        return float(raw[order][at[-1]]) if len(at) else none

    order = np.argsort(raw, kind="stable")
    low, high = bound(order, 0, -np.inf), bound(order[::-1], 1, np.inf)
    return replace(view, sure=(low, high) if low < high else (-np.inf, np.inf))


@dataclass(frozen=True)
class CoTrained:
    text: View
    meta: View
    prior: float  # log odds of a good document, which both views contain

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.log_odds(text), self.meta.log_odds(meta)
        return _chance(a), _chance(b), _chance(a + b - self.prior)


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float32) for v in column.to_pylist()]).astype(np.float64)


def pool_sums(pool: DataFrame, views: list[View]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each view: how many documents the other hands over, and their Newton sums."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray | None] = [None, None]
        for b in batches:
            if not b.num_rows:
                continue
            x = [_unpacked(b.column(0)), _unpacked(b.column(1))]
            for me, other in ((0, 1), (1, 0)):
                y = views[other].pseudo_labels(x[other])
                g, h = newton_sums(views[me].inputs(x[me][y >= 0]), y[y >= 0], views[me].weights)
                sums = np.concatenate([[(y >= 0).sum()], g, h[np.triu_indices(len(g))]])
                total[me] = sums if total[me] is None else total[me] + sums
        if total[0] is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([t.tolist() for t in total])], names=["view", "sums"])

    got = (pool.select("t", "m").mapInArrow(run, "view int, sums array<double>").select("view", F.posexplode("sums"))
           .groupBy("view", "pos").agg(F.sum("col").alias("v")).collect())
    out = []
    for i, v in enumerate(views):
        k = len(v.weights)
        sums = np.zeros(1 + k + k * (k + 1) // 2)
        for r in got:
            if r["view"] == i:
                sums[r["pos"]] = r["v"]
        h = np.zeros((k, k))
        h[np.triu_indices(k)] = sums[1 + k :]
        out.append((int(sums[0]), sums[1 : 1 + k], h + np.triu(h, 1).T))
    return out


def co_train(x: tuple[np.ndarray, np.ndarray], y: np.ndarray, aside: np.ndarray, pool: DataFrame | None, rounds: int = ROUNDS) -> CoTrained | None:
    """Fit both views; None where the labels are not of two kinds.

    ``pool``: the unlabelled documents as (t, m).
    """
    fit = ~aside
    if len(set(y[fit].tolist())) < 2:
        return None
    check = aside if aside.any() and len(set(y[aside].tolist())) > 1 else fit
    share = float(y[fit].mean())
    views = [fit_view(v[fit], y[fit]) for v in x]
    for _ in range(rounds if pool is not None else 0):
        views = [gated(v, u[check], y[check]) for v, u in zip(views, x, strict=True)]
        if not any(np.isfinite(v.sure).any() for v in views):
            break
        taught = views
        for _ in range(STEPS):
            handed = pool_sums(pool, taught)
            new = []
            for v, u, (n, g, h) in zip(taught, x, handed, strict=True):
                weight = min(1.0, HANDED * int(fit.sum()) / n) if n else 0.0
                g0, h0 = newton_sums(v.inputs(u[fit]), y[fit], v.weights)
                new.append(replace(v, weights=_stepped(v.weights, g0 + weight * g, h0 + weight * h, RIDGE)))
            taught = new
        # what a view was taught stays only if it does not misjudge the documents aside more
        views = [t if _loss(t, u[check], y[check]) <= _loss(v, u[check], y[check]) else v for v, t, u in zip(views, taught, x, strict=True)]
    text, meta = (calibrated(v, u[check], y[check]) for v, u in zip(views, x, strict=True))
    return CoTrained(text, meta, float(np.log(share / (1 - share))))


def featured(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, y, t, m): both views of every document, and its label where it is chosen."""
    known = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).join(F.broadcast(chosen), "doc_id", "left")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, lang, source, n_chars = (b.column(i).to_pylist() for i in range(1, 5))
            t = [text_view(v).tobytes() for v in text]
            m = [meta_view(g, s, n, len(v or "")).tobytes() for v, g, s, n in zip(text, lang, source, n_chars, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(5), pa.array(t, pa.binary()), pa.array(m, pa.binary())], names=["doc_id", "y", "t", "m"])

    return known.select("doc_id", "text", "lang", "source", "n_chars", "y").mapInArrow(run, f"doc_id {id_type}, y int, t binary, m binary")


def quality_scores(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text_score, meta_score, score, kept) for every row of documents (doc_id,
    text, lang, source, n_chars); ``labels``: (doc_id, quality 0 or 1).

    Rows with a null label, or whose doc_id has labels that disagree, count as unlabelled,
    as do labels beyond the LABELLED with the smallest id hashes. Null columns are values
    of their own; a null text is an empty one. Without labels of both kinds every score is
    0.5 and every document is kept. Repeated rows each get their row; an empty table gives
    none.
    """
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("_y")).where("y = _y")
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).select("doc_id", F.col("y").cast("int").alias("y"))
    rows = stored(featured(docs, chosen), "quality-views")
    got = rows.where("y is not null").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").select("y", "t", "m").toPandas()  # LABELLED rows of some 700 bytes
    y = got["y"].to_numpy(np.int64)
    x = tuple(np.stack([np.frombuffer(v, np.float32) for v in got[c]]).astype(np.float64) if len(got) else np.zeros((0, 1)) for c in ("t", "m"))
    model = co_train(x, y, np.arange(len(y)) % 4 == 0, rows.where("y is null"), rounds) if len(y) else None
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            scores = [np.full(b.num_rows, 0.5)] * 3 if model is None else model.score(_unpacked(b.column(1)), _unpacked(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v) for v in scores), pa.array(scores[2] >= 0.5)],
                                             names=["doc_id", "text_score", "meta_score", "score", "kept"])

    return rows.select("doc_id", "t", "m").mapInArrow(run, f"doc_id {id_type}, text_score double, meta_score double, score double, kept boolean")


def op4_query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_scores(docs, labels)
