"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

N-grams of 3 to 6 characters are taken inside words with their boundaries, of
lower-cased text, hashed to 2**20 buckets and counted once a document.  The model is
fitted on a bounded sample of labelled documents (`max_rows`, by the order of a hash
of their ids): buckets whose log-count ratio r differs from zero by `z` standard
errors become features of the value r, however many there are, and a logistic model
weighs them.  Its bias is set on predictions for documents that a fit has not seen, so
that the threshold parts the labels best.  Every document is scored on its whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import bucket_of, id_text, parts_of, settle, table
from spanlake.llm.quality_gam import labelled_sample

BITS, SIZES = 20, (3, 4, 5, 6)
WORDS = re.compile(r"[^\W\d_]+")


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of all n-grams of all words, boundaries counted as characters."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    gap = (c == 32).cumsum()  # the number of the word that begins or goes on at a place
    own, out = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(c), np.uint64)
        for n in range(1, SIZES[-1] + 1):
            m = len(c) - n + 1
            if m < 1:
                break
            h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1:] + np.uint64(1)
            if n in SIZES:
                whole = np.flatnonzero((gap[n - 1:] - (c[n - 1:] == 32)) == gap[:m])  # no boundary but at the ends
                x = h[whole]
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                own.append(gap[whole] - 1)
                out.append((x >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(own), np.concatenate(out)


class Grams:
    """Buckets by word, kept from batch to batch; only those of `wanted` (all: None)."""

    def __init__(self, wanted: np.ndarray | None = None, most: int = 300_000):
        self.wanted, self.most, self.kept = wanted, most, {}

    def learn(self, words: set[str]) -> None:
        if len(self.kept) > self.most:
            self.kept.clear()
        new = [w for w in words if w not in self.kept]
        own, bucket = ngram_buckets(new)
        if self.wanted is not None:
            bucket = self.wanted[bucket]
            own, bucket = own[bucket >= 0], bucket[bucket >= 0]
        order = np.argsort(own, kind="stable")
        own, bucket = own[order], bucket[order].astype(np.int32)
        at = np.searchsorted(own, np.arange(len(new) + 1))
        for i, w in enumerate(new):
            self.kept[w] = bucket[at[i]:at[i + 1]] if at[i] < at[i + 1] else None

    def of(self, texts, part: int = 250):
        """Distinct buckets of each text, in order; `part` texts are held as words at a time."""
        for lo in range(0, len(texts), part):
            sets = [set(WORDS.findall((t or "").lower())) for t in texts[lo:lo + part]]
            if any(w not in self.kept for s in sets for w in s):
                self.learn(set().union(*sets))
            for s in sets:
                got = [b for w in s if (b := self.kept[w]) is not None]
                yield np.unique(np.concatenate(got)) if got else np.zeros(0, np.int32)


def _counts(batches):
    """bucket, df0, df1 and, under bucket -1, the numbers of documents."""
    grams, df, n = Grams(), np.zeros((2, 1 << BITS), np.int64), [0, 0]
    for batch in batches:
        y = batch.column("y").to_pylist()
        for k, buckets in zip(y, grams.of(batch.column("text").to_pylist())):
            k = int(k > 0)
            df[k][buckets] += 1
            n[k] += 1
    at = np.flatnonzero(df.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), *(pa.array(np.append(df[k][at], n[k]), pa.int64()) for k in (0, 1))], names=["bucket", "df0", "df1"])


class NaiveBayesLinear:
    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float):
        self.buckets, self.weights, self.bias = buckets, weights, bias

    def index(self) -> np.ndarray:
        at = np.full(1 << BITS, -1, np.int32)
        at[self.buckets] = np.arange(len(self.buckets))
        return at

    def score(self, rows) -> np.ndarray:
        z = np.array([self.weights[r].sum() for r in rows], float) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def narrow(n: int):
    """The type that numbers below n are held in."""
    return np.uint16 if n <= 1 << 16 else np.int32


def _sums(values: np.ndarray, first: np.ndarray, filled: np.ndarray, n: int) -> np.ndarray:
    """Sums of runs of values that begin at first; filled: which of the n sums have a run."""
    out = np.zeros(n, np.float32)
    if len(first):
        out[filled] = np.add.reduceat(values, first)
    return out


def fit_linear(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, l2: float = 0.02, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression on r-scaled binary features: Nesterov gradient steps, deterministic."""
    n, p = len(rows), len(r)
    share = (y.sum() + 0.5) / (n + 1)
    w, b = np.zeros(p), float(np.log(share / (1 - share)))
    if not n or not p or y.min() == y.max():
        return w, b
    size, at = np.array([len(x) for x in rows]), np.concatenate(rows)
    scale = (r / np.abs(r).max()).astype(np.float32)
    by_feature = np.repeat(np.arange(n, dtype=narrow(n)), size)[np.argsort(at, kind="stable")]  # the rows of each feature
    times = np.bincount(at, minlength=p)
    (docs,), (used,) = np.nonzero(size), np.nonzero(times)
    at_docs, at_used = (size.cumsum() - size)[docs], (times.cumsum() - times)[used]
    rate = 4 / (float(_sums((scale ** 2)[at], at_docs, docs, n).max()) + 1 + l2)
    v, vb = w.copy(), b
    for k in range(1, steps + 1):
        z = _sums((scale * v).astype(np.float32)[at], at_docs, docs, n)
        left = (1 / (1 + np.exp(-np.clip(z + vb, -50, 50))) - y).astype(np.float32)
        gw, gb = scale * _sums(left[by_feature], at_used, used, p) + l2 * v, float(left.sum())
        nw, nb = v - rate * gw, vb - min(rate, 4 / n) * gb
        mix = (k - 1) / (k + 2)
        v, vb, w, b = nw + mix * (nw - w), nb + mix * (nb - b), nw, nb
    return w * scale, b


def best_cut(z: np.ndarray, y: np.ndarray) -> float | None:
    """The place on z that parts the labels with the best F1; of a stretch of places the middle; None without both labels."""
    if not len(y) or y.min() == y.max():
        return None
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hits, n = np.cumsum(y), np.arange(1, len(y) + 1)
    score = 2 * hits / (n + y.sum())
    score[:-1][z[:-1] == z[1:]] = 0  # no place between equal ones
    k = int(score.argmax())
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep=None, max_rows: int = 20_000,
          z: float = 2.5, min_df: int = 3, threshold: float = 0.7) -> NaiveBayesLinear:
    """Fit on at most max_rows labelled documents, whole texts, that keep (a condition on __id) admits."""
    keep = F.lit(True) if keep is None else keep
    rows = settle(labelled_sample(docs, labels, label, max_rows, keep).select("text", "y").repartition(32), "labelled")
    sums = rows.mapInArrow(_counts, "bucket long, df0 long, df1 long").groupBy("bucket").agg(F.sum("df0").alias("a"), F.sum("df1").alias("b")).where((F.col("bucket") < 0) | (F.col("a") + F.col("b") >= min_df))
    sums = settle(sums, "counts")  # a row for each bucket at most
    total = F.broadcast(sums.where("bucket < 0").select(F.col("a").alias("na"), F.col("b").alias("nb")))  # one row
    n0, n1 = F.col("na"), F.col("nb")
    ratio = F.log((F.col("b") + 0.5) / (n1 + 1)) - F.log((F.col("a") + 0.5) / (n0 + 1))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    chosen = sums.where("bucket >= 0").join(total).select("bucket", ratio.alias("r"), (F.abs(ratio) / error).alias("z")).where(F.col("z") >= z).select("bucket", "r").orderBy("bucket").toPandas()  # 2**BITS rows at most
    buckets, r = chosen["bucket"].to_numpy(np.int64), chosen["r"].to_numpy(float)
    model = NaiveBayesLinear(buckets, r, 0.0)
    shared, kind = docs.sparkSession.sparkContext.broadcast(model.index()), narrow(len(r))

    def featured(batches):
        grams = Grams(shared.value)
        for part in (part for batch in batches for part in parts_of(batch, "text", 8 << 20, 1_000)):
            got = grams.of(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(kind).tobytes() for x in got], pa.binary()), part.column("y")], names=["x", "y"])

    sample = rows.mapInArrow(featured, "x binary, y int").toArrow()  # max_rows rows at most
    sample = sorted(zip(sample.column("x").to_pylist(), sample.column("y").to_pylist()))
    x, y = [np.frombuffer(b, kind) for b, _ in sample], np.array([k > 0 for _, k in sample], float)
    del sample
    unseen, fold = np.zeros(len(y)), np.arange(len(y)) % 2
    for k in (0, 1):
        w, b = fit_linear([x[i] for i in np.flatnonzero(fold != k)], y[fold != k], r)
        unseen[fold == k] = [w[x[i]].sum() + b for i in np.flatnonzero(fold == k)]
    model.weights, model.bias = fit_linear(x, y, r)
    if (cut := best_cut(unseen, y)) is not None:
        model.bias += float(np.log(threshold / (1 - threshold))) - cut
    return model


def toxicity_scores(docs: DataFrame, model: NaiveBayesLinear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row; a text without letters (or null) has the score of no feature."""
    narrow = id_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        grams = Grams(shared.value.index())
        for part in (part for batch in batches for part in parts_of(batch, "text", 8 << 20, 2_000)):
            score = shared.value.score(grams.of(part.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted; learns only where crc32(doc_id as text) mod 3 is not 1.

    Without labels every score is one half; further columns are ignored; repeated
    rows give repeated rows.
    """
    model = train(id_text(docs), labels, keep=bucket_of("__id", 3) != 1)
    return toxicity_scores(docs, model).select(
        "doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op4_toxicity(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
