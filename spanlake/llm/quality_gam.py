"""Quality classifier: a generalised additive model with pairwise interactions.

Training is cyclic boosting: round after round, each feature in turn gets a
shallow tree (at most `leaves` leaves over its bins, by gradient and Hessian
sums) whose leaf values, shrunk, are added to the feature's lookup table.  Then
the pairs whose coarse grid explains most of what is left get two-dimensional
tables in the same way.  A score is the logistic of table look-ups added up.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import bucket_of, id_text, parts_of, table

FEATURES = (
    "log_bytes", "upper", "digits", "space", "sentence_marks", "bangs", "bars", "symbols", "non_ascii", "log_words",
    "word_bytes", "distinct_words", "same_as_previous", "longest_run", "top_word", "line_words", "repeated_lines", "bare_ends",
)
_SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{}~", np.uint8)


def features(data: bytes) -> np.ndarray:
    """The feature vector of a text's UTF-8 bytes, all of them."""
    n = len(data)
    if not n:
        return np.zeros(len(FEATURES))
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    w = max(1, len(words))
    run = longest = same = 0
    before = None
    for x in words:
        if x == before:
            same += 1
            run += 1
            if run > longest:
                longest = run
        else:
            run, before = 0, x
    tally = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    return np.array([
        np.log1p(n), c[65:91].sum() / n, c[48:58].sum() / n, (c[32] + c[9] + c[10] + c[13]) / n, (c[44] + c[46] + c[59] + c[63]) / w,
        c[33] / w, c[124] / w, c[_SYMBOLS].sum() / w, c[128:].sum() / n, np.log1p(len(words)),
        (n - c[32] - c[10]) / w, len(tally) / w * np.log1p(w), same / w, np.log1p(longest), max(tally.values(), default=0) / w,
        np.log1p(len(words) / k), 1 - len(set(lines)) / k, sum(x[-1:] not in b".!?" for x in lines) / k,
    ])


def _leaf_values(g: np.ndarray, h: np.ndarray, leaves: int, l2: float = 1.0) -> np.ndarray:
    """Newton steps per bin, constant over the leaves of a greedily grown tree on ordered bins."""
    cuts, gs, hs = [0, len(g)], np.concatenate([[0], g.cumsum()]), np.concatenate([[0], h.cumsum()])
    part = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + l2)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            at = np.arange(a + 1, b)
            at = at[(hs[at] - hs[a] > 0.5) & (hs[b] - hs[at] > 0.5)]
            if len(at):
                gain = part(a, at) + part(at, b) - part(a, b)
                i = int(gain.argmax())
                best = max(best, (float(gain[i]), int(at[i])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + l2)
    return out


class Gam:
    def __init__(self, edges, tables, pairs, pair_tables, bias):
        self.edges, self.tables, self.pairs, self.pair_tables, self.bias = edges, tables, pairs, pair_tables, bias

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities: one table look-up per feature and per pair, added up."""
        if not len(x):
            return np.zeros(0)
        b = self.bins(x)
        z = np.full(len(x), self.bias)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, leaves: int = 4, max_bins: int = 32, n_pairs: int = 6) -> Gam:
    """Without both labels in y the model is the constant share of ones (one half without rows)."""
    p = x.shape[1] if x.ndim == 2 else len(FEATURES)
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    model = Gam([np.zeros(0)] * p, [np.zeros(1)] * p, [], [], float(np.log(share / (1 - share))))
    if not n or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, max_bins + 1)[1:-1])) for j in range(p)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    b = model.bins(x)
    z = np.full(n, model.bias)
    for _ in range(rounds):
        for j in range(p):
            q = 1 / (1 + np.exp(-z))
            k = len(model.tables[j])
            step = rate * _leaf_values(np.bincount(b[:, j], y - q, k), np.bincount(b[:, j], q * (1 - q), k), leaves)
            model.tables[j] += step
            z += step[b[:, j]]
    q = 1 / (1 + np.exp(-z))
    coarse = np.stack([b[:, j] * 4 // len(model.tables[j]) for j in range(p)], axis=1)
    gains = []
    for i in range(p):
        for j in range(i):
            cell = coarse[:, i] * 4 + coarse[:, j]
            gains.append((float((np.bincount(cell, y - q, 16) ** 2 / (np.bincount(cell, q * (1 - q), 16) + 1)).sum()), j, i))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:n_pairs]]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(rounds // 4):
        for (i, j), t in zip(model.pairs, model.pair_tables):
            q = 1 / (1 + np.exp(-z))
            cell = b[:, i] * t.shape[1] + b[:, j]
            g, h = np.bincount(cell, y - q, t.size).reshape(t.shape), np.bincount(cell, q * (1 - q), t.size).reshape(t.shape)
            rows = np.cumsum(np.concatenate([[0], np.diff(_leaf_values(g.sum(1), h.sum(1), 2)) != 0]))
            step = np.zeros(t.shape)
            for r in np.unique(rows):  # a cut in one feature, then one in the other on either side
                step[rows == r] = rate * _leaf_values(g[rows == r].sum(0), h[rows == r].sum(0), 2)
            t += step
            z += step[b[:, i], b[:, j]]
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, keep) -> DataFrame:
    """doc_id, text, y of at most max_rows labelled documents, by the order of a hash of their ids.

    Repeated labels of a document count once (the largest), null labels not at all;
    of rows that share an id the smallest text counts.
    """
    ids = (
        labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("y"))
        .where(F.col("__id").isNotNull() & F.col("y").isNotNull() & keep)
        .groupBy("__id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    )
    held = docs.join(F.broadcast(ids), docs["doc_id"] == F.col("__id"))  # at most max_rows rows of 12 bytes
    return held.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def _featured(batches):
    for batch in batches:
        x = np.array([features(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())]).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel())), batch.column("y")], names=["x", "y"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 16_000, keep=None) -> Gam:
    """Fit on at most max_rows labelled documents; keep: a condition on __id, the document's id."""
    sample = labelled_sample(docs, labels, label, max_rows, F.lit(True) if keep is None else keep)
    rows = sample.select("text", "y").mapInArrow(_featured, "x array<double>, y int").collect()
    rows.sort(key=lambda r: r["x"])  # the same model whatever the order of tasks
    return fit(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["y"] > 0 for r in rows], float))


def quality_scores(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row; null counts as an empty text, which has a score like any other."""
    narrow = id_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = np.array([features(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(x), pa.float64())], names=["doc_id", "score"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted; learns only where crc32(doc_id as text) mod 3 is not 1."""
    model = train(id_text(docs), labels, keep=bucket_of("__id", 3) != 1)
    return quality_scores(docs, model).select(
        "doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs (all columns) that the classifier accepts, scored where they are: no join back.

    Null texts count as empty; null ids and rows that share an id are scored like any
    other; without labels every score is one half and all rows stay; an empty table
    gives an empty result.
    """
    model = train(id_text(docs), labels, keep=bucket_of("__id", 3) != 1)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in (part for batch in batches for part in parts_of(batch, "text", 16 << 20, 10_000)):
            x = np.array([features(t.as_py() or b"") for t in part.column("text").cast(pa.binary())]).reshape(-1, len(FEATURES))
            yield part.filter(pa.array(shared.value.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_gam(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
