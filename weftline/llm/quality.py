"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

A document becomes some twenty statistics of its whole text (class shares of its characters, word
lengths, distinct and repeated words, line shape). They are standardised and mapped to cosines of
random projections, whose inner products approximate a Gaussian kernel. Each partition of the
training rows sums its own normal equations; the sums (one matrix of `features`^2 a partition,
at most `parts` of them) meet on the driver, where ridge is solved. Raw ridge scores are
calibrated by isotonic regression on a histogram of fixed size, gathered out of sample: the model
that calibrates a row was solved without that row's fold.

Fitting takes about `max_fit` labels (documented bound), all of them if there are no more, chosen by a
hash of doc_id and label; they are broadcast as ids only, so texts never shuffle. Scoring reads every text once.

Defined cases: null and empty texts have all statistics 0 and are scored like any other; labels
other than 0 or 1, null labels and labels without a document teach nothing; equal labels of
a document count once, different ones each; with no usable label the score is 0.5 for all; with one class only it is that
class for all; an empty table gives no rows; other columns pass through, those named like a result
are replaced.
A text may be of any length; it is read a megabyte at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.shared import lean, materialize, others, quoted, slices, small_batches
from weftline.llm.wordhash import AS_IS, Words, raw

MAX_FIT, FEATURES, PARTS, FOLDS, BINS, THRESHOLD = 60_000, 256, 16, 5, 2048, 0.3
RESULTS = ("score", "predicted")
STATS = (
    "log_bytes", "log_words", "upper", "lower", "digit", "space", "punct", "bang", "symbol", "bar", "high", "newline",
    "word_length", "word_spread", "distinct", "top", "adjacent", "log_line", "short_words", "long_words", "edge_symbol",
)


def _class(*members: int) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


_CLASSES = [
    _class(*range(0x41, 0x5B)), _class(*range(0x61, 0x7B)), _class(*range(0x30, 0x3A)), _class(0x20, *range(9, 14)), _class(*b".,;:'\"?()-"),
    _class(*b"!"), _class(*b"#$%&*@^~+=<>{}[]\\/_`"), _class(*b"|"), _class(*range(0x80, 0x100)), _class(0x0A),
]
_EDGE = _class(*b"!#$%&*@^~+=|")


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATS for each text; worked out for about a megabyte of texts at a time."""
    return np.vstack([np.zeros((0, len(STATS))), *(_statistics(texts[a:b]) for a, b in slices(texts))])


def _statistics(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), len(STATS)))
    w = Words(texts, AS_IS, places=True)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    for k, text in enumerate(texts):
        if text:
            counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
            out[k, 2:12] = [counts[c].sum() for c in _CLASSES]
    some = np.maximum(sizes, 1)[:, None]
    lines = out[:, 11] + 1
    out[:, 2:12] /= some
    n, own = np.maximum(w.count, 1), w.owner()
    length = (w.ends - w.starts).astype(float)
    total = lambda x: np.bincount(own, weights=x, minlength=len(texts))
    mean = total(length) / n
    out[:, 0], out[:, 1] = np.log1p(sizes), np.log1p(w.count)
    out[:, 12], out[:, 13] = mean, np.sqrt(np.maximum(0, total(length**2) / n - mean**2))
    if len(w.hash):
        order = np.lexsort((w.hash, own))
        h, o = w.hash[order], own[order]
        new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1]))))
        runs = np.diff(np.concatenate((new, [len(h)])))
        out[:, 14] = np.bincount(o[new], minlength=len(texts)) / n
        np.maximum.at(out[:, 15], o[new], runs / n[o[new]])
        out[:, 16] = total(np.concatenate(([0.0], (w.hash[1:] == w.hash[:-1]) & (own[1:] == own[:-1])))) / n
        joined = np.frombuffer(b"".join(texts) + b" ", dtype=np.uint8)
        base = np.concatenate(([0], np.cumsum(sizes)))[own]
        out[:, 20] = total(_EDGE[joined[base + w.ends - 1]].astype(float)) / n
    out[:, 17] = np.log1p(sizes / lines)
    out[:, 18], out[:, 19] = total((length <= 3).astype(float)) / n, total((length >= 16).astype(float)) / n
    return out


@dataclass(frozen=True)
class Model:
    """Scores statistics; constant is set where the labels taught nothing to tell apart."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    solved: np.ndarray
    edges: np.ndarray
    levels: np.ndarray
    constant: float | None = None

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -8, 8)
        f = np.sqrt(2.0 / len(self.phase)) * np.cos(z @ self.weights + self.phase)
        return np.hstack((f, np.ones((len(x), 1))))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.fourier(x) @ self.solved, self.edges, self.levels), 0.0, 1.0)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nearest non-decreasing sequence by weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _stat_frame(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            x = statistics(raw(batch.column(text_col)))
            flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), flat], names=[*keep, "stats"])

    return df.mapInArrow(lean(run), schema)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_fit: int = MAX_FIT, features: int = FEATURES, parts: int = PARTS, ridge: float = 1e-3, seed: int = 20240601) -> Model:
    """Learn from labels whose (id, label) rows the caller has chosen; about max_fit of them at most, by hash."""
    small_batches(docs.sparkSession)
    some = labels.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull()).distinct()
    n = some.count()
    if n > max_fit:  # about max_fit of them, wherever they lie
        some = some.where(F.shiftrightunsigned(F.xxhash64("id", "y"), 1) < F.lit(int(2**63 * (max_fit / n))))
    chosen = materialize(_stat_frame(docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text")).join(F.broadcast(some), "id"), "text", ["id", "y"]), "quality-fit")
    dims = len(STATS)
    told = chosen.select("y", *(F.col("stats")[k].alias(f"s{k}") for k in range(dims))).agg(F.count("*").alias("n"), F.sum("y").alias("ones"), *(f(f"s{k}").alias(f"{n}{k}") for k in range(dims) for n, f in (("m", F.avg), ("d", F.stddev_pop)))).first()
    rng = np.random.default_rng(seed)
    blank = {"center": np.zeros(dims), "scale": np.ones(dims), "weights": np.zeros((dims, features)), "phase": np.zeros(features), "solved": np.zeros(features + 1), "edges": np.zeros(1), "levels": np.zeros(1)}
    if not told["n"]:
        return Model(**blank, constant=0.5)
    if told["ones"] in (0, told["n"]):
        return Model(**blank, constant=float(told["ones"] > 0))
    blank |= {
        "center": np.array([told[f"m{k}"] for k in range(dims)]),
        "scale": np.maximum(np.array([told[f"d{k}"] for k in range(dims)]), 1e-6),
        "weights": rng.normal(size=(dims, features)) / np.sqrt(dims),
        "phase": rng.uniform(0, 2 * np.pi, features),
    }
    mapping = Model(**blank)
    width = features + 1

    def sums(batches):
        """Normal equations of this partition for each fold: X'X and X'y, side by side."""
        held = np.zeros((FOLDS, width, width + 1))
        for batch in batches:
            x = np.array(batch.column("stats").to_pylist(), dtype=float).reshape(-1, dims)
            y, fold = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            f = mapping.fourier(x)
            for k in range(FOLDS):
                part = f[fold == k]
                held[k, :, :width] += part.T @ part
                held[k, :, width] += part.T @ y[fold == k]
        yield pa.RecordBatch.from_pydict({"sums": pa.array([held.astype("<f8").tobytes()], pa.binary())})

    folded = chosen.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(FOLDS)).cast("int")).coalesce(parts)
    total = sum(np.frombuffer(r["sums"], "<f8").reshape(FOLDS, width, width + 1) for r in folded.mapInArrow(lean(sums), "sums binary").collect())

    def solve(s: np.ndarray) -> np.ndarray:
        n = max(1.0, s[width - 1, width - 1])
        return np.linalg.solve(s[:, :width] + ridge * n * np.eye(width) / features, s[:, width])

    full = solve(total.sum(0))
    without = [solve(total.sum(0) - total[k]) for k in range(FOLDS)]
    edges = np.linspace(-0.5, 1.5, BINS)

    def histogram(batches):
        n, ones = np.zeros(BINS, dtype=np.int64), np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            x = np.array(batch.column("stats").to_pylist(), dtype=float).reshape(-1, dims)
            y, fold = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            f = mapping.fourier(x)
            s = np.choose(fold, [f @ w for w in without])
            at = np.clip(np.rint((s + 0.5) / 2 * (BINS - 1)), 0, BINS - 1).astype(int)
            n += np.bincount(at, minlength=BINS)
            ones += np.bincount(at, weights=y, minlength=BINS).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"bin": np.arange(BINS), "n": n, "ones": ones})

    met = folded.mapInArrow(lean(histogram), "bin long, n long, ones long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).where("n > 0").orderBy("bin").collect()
    n, ones = np.array([r["n"] for r in met], dtype=float), np.array([r["ones"] for r in met], dtype=float)
    at = np.array([r["bin"] for r in met])
    return Model(**blank | {"solved": full, "edges": edges[at], "levels": isotonic(ones / n, n)})


def score(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on)."""
    small_batches(docs.sparkSession)
    carried = others(docs, text_col, *RESULTS)
    schema = T.StructType([*(docs.schema[c] for c in (*carried, text_col)), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = shared.value.score(statistics(raw(batch.column(text_col))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*carried, text_col)), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return docs.select(*(F.col(quoted(c)) for c in (*carried, text_col))).mapInArrow(lean(run), schema)
