"""Quality classifier: positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fold, packed, row_and, shipped, table, unpacked

PAIRS = 256  # bins of hashed pairs of bytes
_TABLE = np.zeros(256, np.int64)  # byte class: 0 a-z, 1 A-Z, 2 0-9, 3 space, 4 newline, 5 .,;:!?'"()-, 6 #*$%&|<>, 7 other ASCII, 8 beyond ASCII
_TABLE[:128], _TABLE[128:] = 7, 8
for _c, _s in ((0, "abcdefghijklmnopqrstuvwxyz"), (1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, "0123456789"), (3, " \t\r\x0b\x0c"), (4, "\n"), (5, ".,;:!?'\"()-"), (6, "#*$%&|<>")):
    _TABLE[[ord(x) for x in _s]] = _c
OTHER = 13
WIDTH = 9 + 81 + OTHER + PAIRS
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def features(text: str | None) -> np.ndarray:
    """A text's shape: byte classes and their pairs, words, lines, repeats, and hashed pairs of bytes."""
    raw = (text or "").encode()
    out = np.zeros(WIDTH, np.float32)
    if not raw:
        return out
    data = np.frombuffer(raw, np.uint8)
    kind = _TABLE[data]
    n = len(data)
    out[:9] = np.bincount(kind, minlength=9) / n
    if n > 1:
        out[9:90] = np.sqrt(np.bincount(kind[:-1] * 9 + kind[1:], minlength=81) / (n - 1))
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.int64)
        pairs = (low[:-1] * 257 + low[1:] * 31) % PAIRS
        out[90 + OTHER:] = np.sqrt(np.bincount(pairs, minlength=PAIRS) / (n - 1))
    words = _WORDS.findall(raw)
    if words:
        sizes = np.fromiter(map(len, words), np.float64, len(words))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out[90] = min(2.0, sizes.mean() / 10)
        out[91] = min(2.0, sizes.std() / 10)
        out[92] = len(set(words)) / len(words) ** 0.9
        again = sum(a == b for a, b in zip(words, words[1:])) / len(words)
        out[93] = again ** 0.5
        out[94] = 1 - len(set(lines)) / len(lines)
        out[95] = min(2.0, len(words) / len(lines) / 100)
        out[96] = np.log1p(len(words)) / 10
        out[97] = sum(map(bytes.isupper, words)) / len(words)
        out[99] = min(1.0, 4 * again)
        out[100] = (Counter(words).most_common(1)[0][1] / len(words)) ** 0.5
        out[101] = (sum(a == b for a, b in zip(words, words[2:])) / len(words)) ** 0.5
        out[102] = len(lines) / len(words)
        out[98] = sum(x.endswith((b".", b"!", b"?")) for x in lines) / len(lines)
    return out


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised and clipped, so that a rare feature can't outweigh all others in an odd text.

    The hashed pairs, which are many and noisy, are damped: the model leans on them only where they tell much.
    """
    z = np.clip((x - mean) / scale, -4, 4)
    z[:, 90 + OTHER:] *= 0.2
    return z


def risk(w: np.ndarray, b: float, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, tuple[np.ndarray, float], tuple[np.ndarray, float]]:
    """The two parts of the PU risk with the logistic loss, and their gradients (by weights, by bias).

    The first is prior * P(loss as positive); the second, which estimates the risk of the negatives, is
    U(loss as negative) - prior * P(loss as negative).
    """
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    zp, zu = p @ w + b, u @ w + b
    first = prior * np.logaddexp(0, -zp).mean()
    second = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    g1 = -prior * sigmoid(-zp) / len(zp)
    g2, g3 = sigmoid(zu) / len(zu), -prior * sigmoid(zp) / len(zp)
    return first, second, (p.T @ g1, g1.sum()), (u.T @ g2 + p.T @ g3, g2.sum() + g3.sum())


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60, batch: int = 512, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights, bias, and the features' mean and scale of a logistic model by non-negative PU risk (Kiryo et al. 2017).

    The risk is the first part of risk() + max(0, its second part). Where the second falls below 0 in a batch, the step
    goes against that part alone, which undoes overfitting to it.
    """
    every = np.concatenate([positive, unlabelled])
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    p, u = (standard(x, mean, scale) for x in (positive, unlabelled))
    rng = np.random.default_rng(seed)
    w, b = np.zeros(p.shape[1]), 0.0
    m, v, step = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    total_w, total_b, kept = np.zeros_like(w), 0.0, 0
    rounds = max(1, -(-len(u) // batch))
    for epoch in range(epochs):
        order_p, order_u = rng.permutation(len(p)), rng.permutation(len(u))
        for k in range(rounds):
            xp, xu = p[order_p[k::rounds]], u[order_u[k::rounds]]
            if not len(xp) or not len(xu):
                continue
            _, negative, (one_w, one_b), (two_w, two_b) = risk(w, b, xp, xu, prior)
            grad_w, grad_b = (one_w + two_w, one_b + two_b) if negative >= 0 else (-two_w, -two_b)
            step += 1
            g = np.append(grad_w + decay * w, grad_b)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
            if epoch >= epochs // 2:
                total_w, total_b, kept = total_w + w, total_b + b, kept + 1
    return (total_w / max(1, kept), total_b / max(1, kept), mean, scale)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5) -> float:
    """The share of positives among the unlabelled, from these two sets alone: best bin estimation (Garg et al. 2021).

    A model that tells the two sets apart is trained on half of each. On the other halves, the share of the unlabelled
    over a threshold is at least the prior times that of the positives; the threshold of the smallest upper confidence
    bound on that ratio gives the estimate. Kept between 0.05 and 0.95; 0.5 where a half has fewer than 20 rows.
    """
    rng = np.random.default_rng(seed)
    halves = []
    for x in (positive, unlabelled):
        order = rng.permutation(len(x))
        halves.append((x[order[::2]], x[order[1::2]]))
    (p1, p2), (u1, u2) = halves
    if min(len(p2), len(u2)) < 20:
        return 0.5
    w, b, mean, scale = train(p1, u1, len(p1) / (len(p1) + len(u1)), epochs=20)
    zp, zu = (np.sort(standard(x, mean, scale) @ w + b) for x in (p2, u2))
    cuts = np.unique(np.concatenate([zp, zu]))
    over = lambda z: 1 - np.searchsorted(z, cuts, side="left") / len(z)
    up, uu = over(zp), over(zu)
    some = up > 0
    slack = np.sqrt(np.log(40) / 2 / len(zu)) + np.sqrt(np.log(40) / 2 / len(zp))  # both sides hold with 0.9
    bound = (uu[some] + 1.01 * slack) / up[some]
    best = int(bound.argmin())
    return float(min(0.95, max(0.05, uu[some][best] / up[some][best])))


def fit(docs: DataFrame, labels: DataFrame, positives: int = 4_000, unlabelled: int = 8_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float, np.ndarray, np.ndarray] | None:
    """A model from `positives` trusted documents (label 1) and `unlabelled` of all documents, at most.

    Both are drawn by a hash of id and text, and the same draw comes once, so repeated rows and ids don't swell them, and
    a rerun draws the same. Only their features come to the driver; the two numbers bound them. The class prior is
    estimated from the two sets by class_prior(); labels of 0 teach nothing. None without a text of label 1 or without
    other texts. An id labelled twice counts by its larger label; null ids and labels teach nothing.
    """
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_tz_id")).agg(F.max(label_col).alias("_tz_label"))
    ones = marks.filter(F.col("_tz_label") == 1)
    n, rows = ones.count(), docs.count()
    if not n:
        return None
    unit = lambda h: F.pmod(h, F.lit(1 << 30)) / float(1 << 30)
    texts = docs.select(F.col(id_col).alias("_tz_id"), F.col(text_col).alias("_tz_text"), F.xxhash64(F.lit(29), F.col(id_col), F.col(text_col)).alias("_tz_h"))
    trusted = ones.filter(unit(F.xxhash64("_tz_id", F.lit(23))) < min(1.0, positives / n)).select("_tz_id")  # about `positives` ids
    some = texts.join(F.broadcast(trusted), "_tz_id")
    rest = texts.filter(unit(F.col("_tz_h")) < min(1.0, unlabelled / max(1, rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t).astype(np.float16).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["h", "x"])

    def drawn(df: DataFrame, most: int) -> np.ndarray:
        once = shipped(df).select("_tz_h", "_tz_text").mapInArrow(run, "h long, x binary").groupBy("h").agg(F.min("x").alias("x"))
        got = once.orderBy("h").limit(most).collect()
        return np.stack([np.frombuffer(r.x, np.float16).astype(np.float64) for r in got]) if got else np.zeros((0, WIDTH))

    p, u = drawn(some, positives), drawn(rest, unlabelled)
    return train(p, u, class_prior(p, u)) if len(p) and len(u) else None


def score(docs: DataFrame, model, threshold: float = 0.3, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Null and empty texts are scored as a text without any features; without a model every score is 0.5. Whole texts are
    read. Columns of the two names are replaced; others pass. Empty input: empty output.
    """
    base = packed(docs, text_col, beside=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                x = np.stack([features(t) for t in b.column(1).to_pylist()]) if b.num_rows else np.zeros((0, WIDTH))
                if shared.value is None:
                    s = np.full(b.num_rows, 0.5)
                else:
                    w, bias, mean, scale = shared.value
                    s = 1 / (1 + np.exp(-np.clip(standard(x, mean, scale) @ w + bias, -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), b.column(1)][: 2 + keep_text], names=["_tz_row", "s", "t"][: 2 + keep_text])

    out = shipped(base).mapInArrow(run, row_and(base, "s double" + ", t string" * keep_text))
    text = {text_col: F.col("t")} if keep_text else {}
    return unpacked(out, docs, None if keep_text else text_col, **text, score=F.col("s"), predicted=(F.col("s") >= threshold).cast("int"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit(docs.filter(~held), labels.filter(~held))
    return score(docs.withColumn("held_out", held), model, keep_text=False).select("doc_id", "held_out", "score", "predicted")
