"""Quality scores by positive-unlabelled learning.

A linear model over character-shape pairs is fitted by stochastic descent on the non-negative unbiased risk (Kiryo et
al., 2017): trusted positives, a sample of unlabelled web text, and a class prior. The prior starts as the share of
positives among the labelled rows of the training folds and is then estimated from the unlabelled rows' margins; if it
moved by more than ``MOVED``, the model is fitted again with it. A one-dimensional logistic curve then turns the model's margin into a probability, fitted on
labelled training rows. The fit uses about ``FIT_ROWS`` labelled rows of each class at most, and ``UNLABELLED`` times
as many unlabelled ones, chosen by a hash of doc_id; the risk is a mean over rows, so a uniform sample estimates it
with an error that depends on the sample's size alone, not on the corpus. Every document is scored over its whole text.

Defined cases: a null text counts as empty, and an empty text gets the score of no evidence (the calibrated bias);
labels that are null or given for absent documents are ignored; a repeated label counts once, contradicting ones both; with no
labels of a class in the training folds every score is the prior (0.5 without any labels); rows whose doc_id is null
are scored and held out (no checksum); an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lean, text_column

#: About so many labelled rows of each class, at most, fit the model.
FIT_ROWS = 4_000
#: And so many times as many unlabelled ones, as few of them are negatives.
UNLABELLED = 4
FOLDS = 5
THRESHOLD = 0.3
MOVED = 0.02
_CLASSES = 38
_EXTRA = 9
#: Frequencies in texts of about so many bytes count half: a short text says little.
_DAMP = 40
#: Odd multipliers by place in a word.
_PLACE = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
N_FEATURES = _CLASSES * _CLASSES + _CLASSES + _EXTRA


def _class_table() -> np.ndarray:
    """Classes of bytes: 8 groups of small letters, capitals, digits, space, line end, two kinds beyond ASCII, points, 23 groups of marks."""
    t = np.zeros(256, np.uint8)
    for b in range(256):
        ch = chr(b)
        if "a" <= ch <= "z":
            t[b] = b % 8
        elif "A" <= ch <= "Z":
            t[b] = 8
        elif "0" <= ch <= "9":
            t[b] = 9
        elif ch in " \t":
            t[b] = 10
        elif b < 32:
            t[b] = 11
        elif b >= 128:
            t[b] = 12 if b >= 192 else 13
        elif ch in ".,":
            t[b] = 14
        else:
            t[b] = 15 + b % 23
    return t


def featurize(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A row of features per text: root frequencies of class pairs and classes, and measures of repetition and length."""
    out = np.zeros((len(starts), N_FEATURES), np.float32)
    pairs = _CLASSES * _CLASSES
    for r, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        n = b - a
        if not n:
            continue
        raw = buf[a:b]
        c = table[raw]
        row = out[r]
        row[pairs : pairs + _CLASSES] = np.sqrt(np.bincount(c, minlength=_CLASSES) / n)
        if n > 1:
            code = c[:-1].astype(np.int32) * _CLASSES + c[1:]
            row[:pairs] = np.sqrt(np.bincount(code, minlength=pairs) / (n - 1))
        row[: pairs + _CLASSES] *= n / (n + _DAMP)
        x = row[pairs + _CLASSES :]
        x[0] = np.log1p(n) / 10
        if n >= 8:
            grams = raw[:-7].astype(np.uint64)
            for k in range(1, 8):
                grams = grams * np.uint64(0x9E3779B97F4A7C15) + raw[k : n - 7 + k]
            seen = np.sort(grams)
            x[1] = np.count_nonzero(seen[1:] != seen[:-1]) / len(seen)  # distinct eight-byte strings
        spaces = np.count_nonzero(c == 10) + np.count_nonzero(c == 11)
        x[2] = np.log1p(n / (spaces + 1)) / 5
        letters = np.count_nonzero(c <= 8)
        x[3] = np.count_nonzero(c == 8) / (letters + 1)
        x[4] = np.count_nonzero(c >= 15) / n
        x[5] = 1
        gap = np.flatnonzero((c == 10) | (c == 11))
        begin = np.concatenate([[0], gap + 1])
        stop = np.concatenate([gap, [n]])
        keep = stop > begin
        begin, stop = begin[keep], stop[keep]
        if len(begin) > 3:
            at = np.arange(n) - np.repeat(np.concatenate([[0], begin[1:]]), np.diff(np.concatenate([[0], begin[1:], [n]])))
            # a weight by byte and place; white space weighs nothing
            value = (raw.astype(np.uint64) + np.uint64(1)) * _PLACE[np.minimum(at, 63)]
            value[gap] = 0
            word = np.add.reduceat(value, begin)
            x[6] = np.count_nonzero(word[1:] == word[:-1]) / len(word)
            seen = np.sort(word)
            x[7] = (1 + np.count_nonzero(seen[1:] != seen[:-1])) / len(word)
            x[8] = x[7] * np.log1p(len(word)) / 5
    return out


@dataclass(frozen=True)
class Model:
    """Weights over features, bias, and the calibration ``sigmoid(a * margin + c)``."""

    weights: np.ndarray
    bias: float
    a: float
    c: float

    def score(self, x: np.ndarray) -> np.ndarray:
        m = x @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.a * m + self.c, -30, 30))).astype(np.float64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pu_step(p: np.ndarray, u: np.ndarray, w: np.ndarray, b: float, prior: float, decay: float) -> np.ndarray:
    """Direction of ascent, weights then bias: the gradient of the unbiased risk with the logistic loss; where the
    estimate of the negatives' part falls below zero, of that part's negative alone."""
    zp, zu = p @ w + b, u @ w + b
    sp, su = _sigmoid(zp), _sigmoid(zu)
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    gp_pos, gp_neg, gu = prior * (sp - 1) / len(sp), -prior * sp / len(sp), su / len(su)
    gp, g_u = (gp_pos + gp_neg, gu) if negative >= 0 else (-gp_neg, -gu)
    return np.append(p.T @ gp + u.T @ g_u + decay * w, gp.sum() + g_u.sum())


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60, rate: float = 0.02, decay: float = 1e-5, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with the logistic loss."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(positive.shape[1]), 0.0
    scale = 4.0  # features are root frequencies, most of them small
    m1, m2, step = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    size = 256
    for _ in range(epochs):
        order = rng.permutation(len(unlabelled))
        for at in range(0, len(order), size):
            u = unlabelled[order[at : at + size]].astype(np.float32) * scale
            p = positive[rng.integers(0, len(positive), min(size, len(positive)))].astype(np.float32) * scale
            grad = pu_step(p, u, w, b, prior, decay)
            step += 1
            m1 = 0.9 * m1 + 0.1 * grad
            m2 = 0.999 * m2 + 0.001 * grad**2
            move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            w -= move[:-1]
            b -= move[-1]
    return w * scale, float(b)


def margins(x: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    return np.concatenate([x[i : i + 1024].astype(np.float32) @ w + b for i in range(0, len(x), 1024)])


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over weighted margins, by Newton's method with smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        q = _sigmoid(a * margin + c)
        g = np.array([(weight * (q - target) * margin).sum() + 1e-6 * a, (weight * (q - target)).sum()])
        v = weight * (q * (1 - q) + 1e-9)
        h = np.array([[(v * margin**2).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-9]])
        d = np.linalg.solve(h, g)
        scale = min(1.0, 5 / (np.abs(d).max() + 1e-12))
        a, c = a - scale * d[0], c - scale * d[1]
        if np.abs(d).max() < 1e-8:
            break
    return float(a), float(c)


def estimate_prior(positive: np.ndarray, negative: np.ndarray, free: np.ndarray, start: float, rounds: int = 200) -> float:
    """The share of positives among unlabelled rows, from margins (Saerens et al., 2002).

    Labels need not be a fair sample of both classes, only of each: the classes' likelihood ratio at a margin comes
    from a curve fitted with equal weights, and expectation maximisation finds the share that explains the margins.
    """
    y = np.concatenate([np.ones(len(positive)), np.zeros(len(negative))])
    weight = np.concatenate([np.full(len(positive), 0.5 / len(positive)), np.full(len(negative), 0.5 / len(negative))]) * len(y)
    a, c = calibrate(np.concatenate([positive, negative]), y, weight)
    ratio, share = np.exp(np.clip(a * free + c, -30, 30)), start
    for _ in range(rounds):
        before, share = share, float((share * ratio / (share * ratio + 1 - share)).mean())
        share = min(0.98, max(0.02, share))
        if abs(share - before) < 1e-6:
            break
    return share


def held_out(doc_id: Column) -> Column:
    """Whether a row is never learned from: the checksum of its id as text falls into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _features(df: DataFrame) -> DataFrame:
    """kind and features (bytes of float32) of rows (kind, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _class_table()
        for batch in batches:
            x = featurize(*text_column(batch.column(1)), table)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], names=["kind", "x"])

    return df.mapInArrow(lean(run), "kind int, x binary")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> Model | float:
    """The fitted model, or a constant score where a class has no labelled training row.

    Kinds: 1 trusted positive, 0 labelled negative (prior and calibration only), 2 unlabelled (any document of the
    training folds, its label unseen).
    """
    key = F.col(f"`{id_col}`").cast("long")
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_q")).where(F.col("_q").isin(0, 1) & ~held_out(F.col("_id"))).distinct()
    totals = {r["_q"]: r["count"] for r in known.groupBy("_q").count().collect()}
    n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)
    if not n_pos or not n_neg:
        return float(n_pos / (n_pos + n_neg)) if n_pos + n_neg else 0.5
    base = docs.select(key.alias("_id"), F.col(f"`{text_col}`").alias("text")).where(~held_out(F.col("_id")))
    n_docs = base.select("_id").count()
    spot = lambda salt: (F.pmod(F.xxhash64("_id", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30))
    wanted = known.where(F.when(F.col("_q") == 1, spot(1) < rows / n_pos).otherwise(spot(1) < rows / n_neg))
    labelled = base.join(F.broadcast(wanted), "_id").select(F.col("_q").alias("kind"), "text")  # at most about 2 * rows ids
    free = base.where(spot(2) < UNLABELLED * rows / max(n_docs, 1)).select(F.lit(2).alias("kind"), "text")
    table = _features(labelled.unionByName(free)).toArrow()  # about (2 + UNLABELLED) * rows feature rows, some 3 kB each
    kind = table.column("kind").to_numpy()
    flat = table.column("x").combine_chunks()
    # rows of one width lie end to end in the column's buffer; they stay in half precision until used
    every = np.frombuffer(flat.buffers()[2], np.float16, len(kind) * N_FEATURES).reshape(-1, N_FEATURES) if len(kind) else np.zeros((0, N_FEATURES), np.float16)
    x = {k: every[kind == k] for k in (0, 1, 2)}
    if not all(map(len, x.values())):
        return float(n_pos / (n_pos + n_neg))
    share = min(0.98, max(0.02, n_pos / (n_pos + n_neg)))
    w, b = fit_pu(x[1], x[2], share)
    prior = estimate_prior(margins(x[1], w, b), margins(x[0], w, b), margins(x[2], w, b), share)
    if abs(prior - share) > MOVED:
        w, b = fit_pu(x[1], x[2], prior)
    m1, m0 = margins(x[1], w, b), margins(x[0], w, b)
    shares = np.concatenate([np.full(len(m1), prior / len(m1)), np.full(len(m0), (1 - prior) / len(m0))]) * (len(m1) + len(m0))
    a, c = calibrate(np.concatenate([m1, m0]), np.concatenate([np.ones(len(m1)), np.zeros(len(m0))]), shares)
    return Model(w.astype(np.float32), b, a, c)


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document; texts stay in their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _class_table()
        for batch in batches:
            n = batch.num_rows
            if isinstance(model, float):
                s = np.full(n, model)
            else:
                buf, starts, ends = text_column(batch.column(2))
                s = np.concatenate([model.score(featurize(buf, starts[i : i + 512], ends[i : i + 512], table)) for i in range(0, n, 512)]) if n else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    key = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(key.alias("doc_id"), held_out(key).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: Model | float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _class_table()
        for batch in batches:
            if isinstance(model, float):
                good = np.full(batch.num_rows, model >= THRESHOLD)
            else:
                buf, starts, ends = text_column(batch.column(batch.schema.names.index(text_col)))
                good = np.concatenate([model.score(featurize(buf, starts[i : i + 512], ends[i : i + 512], table)) >= THRESHOLD for i in range(0, len(starts), 512)] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(lean(run), docs.schema)
