"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import as_bytes, discard, joined, lean, materialise, ranges, small_batches, spread, table

#: The network is fitted on at most so many texts of each language and in all, and so many pieces of each text.
TEXTS_PER_LANGUAGE, TEXTS, PIECES = 500, 8000, 8
#: Bytes of a piece in training. In prediction, bytes that a segment labels, and those before and after them that it also
#: reads, so that every byte is labelled with states that have seen what stands around it.
PIECE, SEGMENT, CONTEXT = 96, 256, 32
HIDDEN, STEPS, BATCH, RATE, SEED = 8, 400, 256, 0.02, 5
UNDETERMINED = "und"
_PAD = 256  # the byte code that leaves states as they are
_KEEP = 60.0  # an update gate of this input is exactly 1 in single precision
_SEGMENTS = 1024
_LETTER = regex.compile(r"\p{L}").search


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Direction:
    """Gated recurrent units that read in one direction; arrays are (features, sequences)."""

    def __init__(self, rng: np.random.Generator, hidden: int, dtype=np.float32):
        self.h = hidden
        self.e = (rng.standard_normal((3 * hidden, _PAD + 1)) * 0.5).astype(dtype)
        self.u = (rng.standard_normal((3 * hidden, hidden)) * 0.4).astype(dtype)
        self.q = np.zeros((hidden, 1), dtype)
        self.hold()

    def hold(self) -> None:
        self.e[:, _PAD] = 0
        self.e[: self.h, _PAD] = _KEEP

    def states(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        """The state after each row of codes (time, sequences); the array is reused."""
        n, h = self.h, np.zeros((self.h, codes.shape[1]), self.e.dtype)
        x, a, c = (np.empty((k * n, codes.shape[1]), self.e.dtype) for k in (3, 3, 1))
        for row in codes:
            np.take(self.e, row, axis=1, out=x, mode="clip")
            np.matmul(self.u, h, out=a)
            x[: 2 * n] += a[: 2 * n]
            gates = _sigmoid(x[: 2 * n])
            np.add(a[2 * n :], self.q, out=c)
            c *= gates[n:]
            c += x[2 * n :]
            c *= -2  # tanh(c) = 2 / (1 + exp(-2 c)) - 1
            np.minimum(c, 60, out=c)
            np.exp(c, out=c)
            c += 1
            np.reciprocal(c, out=c)
            c *= 2
            c -= 1
            h -= c
            h *= gates[:n]
            h += c
            yield h

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, list]:
        """States (time, features, sequences) and what the way back needs."""
        n, h, out, tape = self.h, np.zeros((self.h, codes.shape[1]), self.e.dtype), [], []
        for row in codes:
            x, a = self.e[:, row], self.u @ h
            gates = _sigmoid(x[: 2 * n] + a[: 2 * n])
            z, r, q = gates[:n], gates[n:], a[2 * n :] + self.q
            c = np.tanh(x[2 * n :] + r * q)
            tape.append((h, z, r, q, c))
            h = c + z * (h - c)
            out.append(h)
        return np.stack(out), tape

    def backward(self, codes: np.ndarray, tape: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of e, u and q, carried back through time."""
        n, du, dq_sum, dh = self.h, np.zeros_like(self.u), np.zeros_like(self.q), 0
        dx_all = np.empty((len(codes), 3 * n, codes.shape[1]), self.e.dtype)
        for t in range(len(codes) - 1, -1, -1):
            h, z, r, q, c = tape[t]
            dh = dh + d_out[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz, dr, dq = dh * (h - c) * z * (1 - z), dc * q * r * (1 - r), dc * r
            da = np.concatenate([dz, dr, dq])
            dx_all[t, : 2 * n], dx_all[t, 2 * n :] = da[: 2 * n], dc
            du += da @ h.T
            dq_sum += dq.sum(axis=1, keepdims=True)
            dh = dh * z + self.u.T @ da
        flat = codes.ravel()
        de = np.stack([np.bincount(flat, dx_all[:, k].ravel(), _PAD + 1) for k in range(3 * n)]).astype(self.e.dtype)
        de[:, _PAD] = 0
        return de, du, dq_sum


class ByteTagger:
    """Labels every byte with a language from the states of both directions; a text's probabilities are their mean."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED, dtype=np.float32):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ways = [Direction(rng, hidden, dtype), Direction(rng, hidden, dtype)]
        self.v = [(rng.standard_normal((len(languages), hidden)) * 0.3).astype(dtype) for _ in range(2)]
        self.c = np.zeros((len(languages), 1), dtype)

    def loss(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
        """Mean cross-entropy over the bytes of codes (time, sequences), the parameters, and their gradients."""
        back = codes[::-1]
        (hf, tf), (hb, tb) = self.ways[0].forward(codes), self.ways[1].forward(back)
        hb = hb[::-1]
        z = self.v[0] @ hf + self.v[1] @ hb + self.c
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        real = codes != _PAD
        n = max(1, real.sum())
        picked = np.take_along_axis(p, np.broadcast_to(labels, codes.shape)[:, None, :], axis=1)[:, 0]
        value = -(np.log(np.maximum(picked, 1e-30)) * real).sum() / n
        d = p
        np.put_along_axis(d, np.broadcast_to(labels, codes.shape)[:, None, :], picked[:, None] - 1, axis=1)
        d *= real[:, None, :] / n
        d = d.astype(self.c.dtype)
        dv = [np.einsum("tks,ths->kh", d, h, optimize=True) for h in (hf, hb)]
        gf = self.ways[0].backward(codes, tf, np.matmul(self.v[0].T, d))
        gb = self.ways[1].backward(back, tb, np.matmul(self.v[1].T, d)[::-1])
        w = self.ways
        return float(value), [w[0].e, w[0].u, w[0].q, w[1].e, w[1].u, w[1].q, *self.v, self.c], [*gf, *gb, *dv, d.sum(axis=(0, 2))[:, None]]

    def fit(self, codes: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> ByteTagger:
        """Adam over random batches of pieces; codes is (time, pieces)."""
        rng, moments = np.random.default_rng(seed), None
        for step in range(1, steps + 1):
            at = rng.integers(0, codes.shape[1], min(BATCH, codes.shape[1]))
            _, params, grads = self.loss(codes[:, at], labels[at])
            moments = moments or [(np.zeros_like(g), np.zeros_like(g)) for g in grads]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = RATE * (1 - step / (steps + 1)) / (1 if norm < 1 else norm)
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            for way in self.ways:
                way.hold()
        return self

    def positions(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(time, probabilities (languages, sequences)) of each row of codes, last row first; the array is reused."""
        ahead = np.empty((len(codes), len(self.languages), codes.shape[1]), np.float32)
        for out, h in zip(ahead, self.ways[0].states(codes), strict=True):
            np.matmul(self.v[0], h, out=out)
        p, total = np.empty_like(ahead[0]), np.empty((1, codes.shape[1]), np.float32)
        for t, h in zip(range(len(codes) - 1, -1, -1), self.ways[1].states(codes[::-1]), strict=True):
            np.matmul(self.v[1], h, out=p)
            p += ahead[t]
            p += self.c
            np.max(p, axis=0, keepdims=True, out=total)
            p -= total
            np.exp(p, out=p)
            np.sum(p, axis=0, keepdims=True, out=total)
            p /= total
            yield t, p

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all bytes of each text (texts, languages); an empty text has zeros."""
        sums = np.zeros((len(texts), len(self.languages)))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        pieces = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        inside = ranges(np.zeros(len(texts), np.int64), pieces) * SEGMENT
        before = np.minimum(CONTEXT, inside)
        own = np.minimum(SEGMENT, size[owner] - inside)
        after = np.minimum(CONTEXT, size[owner] - inside - own)
        starts, lengths, wide = (np.cumsum(size) - size)[owner] + inside - before, before + own + after, SEGMENT + 2 * CONTEXT
        for k in range(0, len(starts), _SEGMENTS):
            s, n, first, last = (x[k : k + _SEGMENTS] for x in (starts, lengths, before, before + own))
            codes = np.full((len(s), wide), _PAD, np.int64)
            codes[np.arange(wide) < n[:, None]] = data[ranges(s, n)]
            codes = np.ascontiguousarray(codes.T)
            at = np.arange(wide)[:, None]
            real, acc = ((at >= first) & (at < last)).astype(np.float32), np.zeros((len(self.languages), len(s)), np.float32)
            for t, p in self.positions(codes):
                p *= real[t]
                acc += p
            np.add.at(sums, owner[k : k + _SEGMENTS], acc.T)
        return sums / np.maximum(size, 1)[:, None]


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each text, from places that a checksum of the text spreads over the whole of it. Columns: u, tie, lang, text."""
    for b in batches:
        row, number, out = [], [], []
        for r, text in enumerate(as_bytes(b.column(3))):
            for k in range(min(PIECES, -(-len(text) // PIECE))):
                at = zlib.crc32(text, k) % max(1, len(text) - PIECE + 1)
                row.append(r)
                number.append(k)
                out.append(text[at : at + PIECE])
        rows = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in b.columns[:3]), pa.array(number, pa.int32()), pa.array(out, pa.binary())], ["u", "tie", "lang", "k", "piece"])


def fit(docs: DataFrame, learn: Column) -> ByteTagger | None:
    """Learn from text and lang of the rows for which `learn` holds; None if there is nothing to learn from.

    The sample is bounded: TEXTS_PER_LANGUAGE ids of each language and TEXTS ids in all, in the order of a hash, and
    of each text PIECES pieces of PIECE bytes from all over it.
    """
    small_batches(docs.sparkSession)
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    by_hash = spread(SEED, "doc_id")
    counts = materialise(known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).withColumn("_of", F.col("_n")))
    # what is surely beyond a language's share goes first: a window then sees about twice the share, not the language
    near = joined(known.select("doc_id", "lang"), counts, ["lang"], "_n", F.col("doc_id")).where(by_hash * F.col("_of") < 2.0 * TEXTS_PER_LANGUAGE + 100)
    ranked = near.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy(by_hash, "doc_id")))
    chosen = ranked.where(F.col("_k") <= TEXTS_PER_LANGUAGE).orderBy("_k", by_hash, "doc_id").limit(TEXTS).select("doc_id").distinct()
    rows = known.where(F.length("text") > 0).select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id")  # at most TEXTS ids
    rows = rows.select(by_hash.alias("u"), F.xxhash64("text").alias("tie"), "lang", "text")
    got = rows.mapInArrow(lean(_pieces), "u double, tie long, lang string, k int, piece binary").orderBy("u", "tie", "lang", "k").limit(TEXTS * PIECES).collect()
    discard(counts)
    languages = sorted({r.lang for r in got})
    if not languages:
        return None
    codes = np.full((PIECE, len(got)), _PAD, np.int64)
    for k, r in enumerate(got):
        codes[: len(r.piece), k] = np.frombuffer(r.piece, np.uint8)
    number = {x: k for k, x in enumerate(languages)}
    return ByteTagger(languages).fit(codes, np.array([number[r.lang] for r in got]))


def predict(docs: DataFrame, model: ByteTagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; only the text decides. score is the pooled probability of the language.

    Texts that are null or without a letter, and all texts if there was nothing to learn from, are 'und' with score 0.
    Ties go to the language that sorts first. Repeated rows get equal results, an empty table an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # about 60 kB, whatever the corpus

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for b in batches:
            texts = [t if t and tagger and _LETTER(t.decode()) else b"" for t in as_bytes(b.column(1))]
            best, top = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if tagger and texts:
                p = tagger.probabilities(texts)
                best, top = p.argmax(axis=1), p.max(axis=1)
            names = [tagger.languages[k] if t else UNDETERMINED for t, k in zip(texts, best.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(np.clip(top, 0, 1))], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(scan), f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs, ~held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language": op3_language}
SQL: dict[str, str] = {}
