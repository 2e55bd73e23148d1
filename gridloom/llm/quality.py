"""Quality classifier from positive and unlabelled texts: non-negative unbiased risk with an estimated class prior."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, lean, small_batches, smallest, spread, table

#: The model is fitted on at most so many trusted positives and unlabelled texts, chosen by a hash of their ids.
POSITIVES, UNLABELLED = 4000, 8000
EPOCHS, BATCH, RATE, DECAY, SEED = 60, 256, 0.01, 1e-4, 11
#: Classes of bytes: lower, upper, digit, space, line end, full stop, comma, other ASCII, beyond ASCII.
_CLASS = np.array([8 if b >= 0x80 else 0 if 0x61 <= b <= 0x7A else 1 if 0x41 <= b <= 0x5A else 2 if 0x30 <= b <= 0x39 else 3 if b in (0x20, 9) else 4 if b in (10, 13) else 5 if b == 0x2E else 6 if b == 0x2C else 7 for b in range(256)], np.uint16)
_TRIGRAMS, _STATS = 729, 6
FEATURES = _TRIGRAMS + _STATS


def features(texts: list[bytes | None]) -> np.ndarray:
    """One row per text: root frequencies of byte-class trigrams over the whole text, and word statistics."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in zip(out, texts, strict=True):
        if not text:
            continue
        words = text.split()
        n = max(1, len(words))
        row[_TRIGRAMS:] = len(set(words)) / n, sum(map(eq, words, words[1:])) / n, min(20.0, len(text) / n) / 20, np.log1p(len(text)) / 15, np.log1p(len(words)) / 15, text.count(b"\n") / n
        c = _CLASS[np.frombuffer(text, np.uint8)]
        if len(c) > 2:
            row[:_TRIGRAMS] = np.sqrt(np.bincount(c[:-2] * 81 + c[1:-1] * 9 + c[2:], minlength=_TRIGRAMS) / (len(c) - 2))
    return out


class PuModel:
    """A linear scorer. fit() minimises the non-negative estimate of the risk of the logistic loss:
    prior * R(positives as 1) + max(0, R(unlabelled as 0) - prior * R(positives as 0))."""

    def __init__(self):
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.w, self.b = np.zeros(FEATURES, np.float32), 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w + self.b

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64), -500, 500)))

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> PuModel:
        """Adam over shuffled batches; where the negative part falls below zero, its gradient is reversed. Without a prior
        the scorer tells positives from unlabelled texts, both sides of equal weight."""
        if not len(positive) or not len(unlabelled):
            return self
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(0), both.std(0) + 0.02
        p, u = ((x - self.mean) / self.scale for x in (positive, unlabelled))
        rng, w, b = np.random.default_rng(SEED), np.zeros(FEATURES), 0.0
        m, v, step = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1), 0

        def move(g: np.ndarray, epoch: int, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
            nonlocal m, v, step
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            by = RATE * (1 - epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            return w - by[:-1], b - by[-1]

        softplus = lambda z: np.logaddexp(0, z)
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        for epoch in range(EPOCHS):
            order_u, order_p = rng.permutation(len(u)), rng.permutation(len(p))
            for k in range(0, len(u), BATCH):
                xu = u[order_u[k : k + BATCH]]
                xp = p[order_p[np.arange(k, k + BATCH) % len(p)]]
                zu, zp = xu @ w + b, xp @ w + b
                if prior is None:
                    gp, gu = -sigmoid(-zp) / len(zp), sigmoid(zu) / len(zu)
                    w, b = move(np.append(xp.T @ gp + xu.T @ gu + DECAY * w, gp.sum() + gu.sum()), epoch, w, b)
                    continue
                negative = softplus(zu).mean() - prior * softplus(zp).mean()
                gp, gu = -prior * sigmoid(-zp) / len(zp), np.zeros(len(zu))
                if negative >= 0:
                    gu = sigmoid(zu) / len(zu)
                    gp -= prior * sigmoid(zp) / len(zp)
                else:
                    gu, gp = -sigmoid(zu) / len(zu), prior * sigmoid(zp) / len(zp)
                w, b = move(np.append(xp.T @ gp + xu.T @ gu + DECAY * w, gp.sum() + gu.sum()), epoch, w, b)
        self.w, self.b = w.astype(np.float32), float(b)
        return self


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled texts, from these two samples alone.

    One half of each trains a scorer of positives against unlabelled texts. On the other halves, above any threshold,
    the share of the unlabelled divided by that of the positives bounds the prior from above; the threshold is the one
    at which this, with its confidence margin, is least.
    """
    p, u = positive[: len(positive) // 2], unlabelled[: len(unlabelled) // 2]
    if not len(p) or not len(u):
        return 0.5
    model = PuModel().fit(p, u, None)
    sp, su = (np.sort(model.logits(x[len(x) // 2 :]).astype(np.float64)) for x in (positive, unlabelled))
    above = lambda s: 1 - np.searchsorted(s, sp, "left") / len(s)
    qp, qu = above(sp), above(su)
    margin = np.sqrt(np.log(4 / 0.1) / 2 / len(su)) + np.sqrt(np.log(4 / 0.1) / 2 / len(sp))
    at = ((qu + 1.01 * margin) / qp).argmin()
    return float(np.clip(qu[at] / qp[at], 0.01, 0.99))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _with_features(rows: DataFrame) -> DataFrame:
    """(u, tie, role, features) of the rows (u, tie, role, text): of fixed size, however long the texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(as_bytes(b.column(3)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes() for r in x], pa.binary())], ["u", "tie", "role", "features"])

    return rows.select("u", "tie", "role", "text").mapInArrow(lean(scan), "u double, tie long, role int, features binary")


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row, the numbers of the model of the whole sample (u, tie, role, features)."""
    keys, parts = [], []
    for b in batches:
        keys.append([b.column(k).to_numpy() for k in range(3)])
        parts.append(np.frombuffer(b"".join(b.column(3).to_pylist()), np.float32).reshape(-1, FEATURES))
    if not parts:
        return
    u, tie, role = map(np.concatenate, zip(*keys, strict=True))
    order = np.lexsort((role, tie, u))
    x, role = np.concatenate(parts)[order], role[order]
    positive, unlabelled = x[role == 1], x[role == 0]
    model = PuModel().fit(positive, unlabelled, estimated_prior(positive, unlabelled))
    columns = [pa.array([v.tobytes()], pa.binary()) for v in (model.mean, model.scale, model.w)]
    yield pa.RecordBatch.from_arrays([*columns, pa.array([model.b], pa.float64())], ["mean", "scale", "w", "b"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> PuModel:
    """Learn from rows of docs for which `learn` holds: those labelled 1 are the positives, any are unlabelled.

    No other label is looked at; the prior is estimated from the two samples. Ids that several rows share take part
    through the first few of them in the order of a hash, so the sample's bound holds whatever the table. The sample,
    about 36 MB, is learned in one task; the driver gets four vectors.
    """
    small_batches(docs.sparkSession)
    known = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & learn).select("doc_id")
    ones = known.count()
    if not ones:
        return PuModel()
    p = smallest(known, SEED, "doc_id", POSITIVES, ones).distinct().withColumn("role", F.lit(1))
    open_ = docs.where(learn & F.col("doc_id").isNotNull()).select("doc_id")
    u = smallest(open_, SEED, "doc_id", UNLABELLED, open_.count()).distinct().withColumn("role", F.lit(0))
    chosen = F.broadcast(p.unionByName(u))  # at most POSITIVES + UNLABELLED ids
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select(spread(SEED, "doc_id").alias("u"), F.xxhash64("text").alias("tie"), "role", "text")
    sample = _with_features(rows).orderBy("u", "tie", "role").limit(POSITIVES + UNLABELLED)
    got = sample.mapInArrow(lean(_learned), "mean binary, scale binary, w binary, b double").first()
    model = PuModel()
    if got:
        model.mean, model.scale, model.w = (np.frombuffer(v, np.float32) for v in (got["mean"], got["scale"], got["w"]))
        model.b = got["b"]
    return model


def score(docs: DataFrame, model: PuModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, and the columns named in keep) of every row; nothing but the text decides the score.

    Null and empty texts get the score of an all-zero row of features. Without positives to learn from, every score is
    0.5. Repeated rows get equal scores, an empty table an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # four vectors of fixed length
    rows = docs.select(F.col(text_col).alias("_text"), F.col(id_col), *keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.scores(features(as_bytes(b.column(0))))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s, pa.float64())], [*b.schema.names[1:], "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(lean(scan), f"{kinds}, score double")


def accepted(docs: DataFrame, model: PuModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose texts score at least `least`."""
    spark = docs.sparkSession
    small_batches(spark)
    shared, place = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.scores(features(as_bytes(b.column(place)))) >= least, pa.bool_()))

    return docs.mapInArrow(lean(scan), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op10_quality": op10_quality}
SQL: dict[str, str] = {}
