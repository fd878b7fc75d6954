"""BM25 over one field and weighted BM25 over several, in single precision, as Columns.

Every step is a 32-bit operation in a fixed order: term scores are added from left
to right in the order of the terms' bytes, so scores are reproducible bit for bit.
"""

from __future__ import annotations

import copy
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.analysis import builtin_stop_words
from spanlake.operators.compile import MAX_TERMS, matching, resolve, select_postings
from spanlake.plans.parser import QueryError
from spanlake.plans.query import compile_query, span_leaves
from spanlake.settings import setting
from spanlake.sources.index import Index

TF_STEPS = (1, 2, 3, 5, 10, 20, 41, 85, 177, 371, 777, 1626, 3405, 7132, 14938, 31288)
FEW_SCORED = 64
f32 = np.float32


def tf_representative(tf: Column) -> Column:
    """The largest step that a term frequency reaches, as a float."""
    out = F.lit(float(TF_STEPS[0]))
    for step in TF_STEPS[1:]:
        out = F.when(tf >= step, float(step)).otherwise(out)
    return out.cast("float")


def idf(n: int, df: int) -> np.float32:
    return f32(max(0.0, math.log(1 + (n - df + 0.5) / (df + 0.5))))


@dataclass
class Weights:
    """Scoring terms: weight, whether pinned by the query or an edit, and the fields they count in."""

    terms: dict[str, np.float32] = field(default_factory=dict)
    pinned: set[str] = field(default_factory=set)
    fields: dict[str, set[int]] = field(default_factory=dict)

    def add(self, term: str, weight, pinned: bool, fields) -> None:
        self.terms[term] = f32(self.terms[term] + weight) if term in self.terms else f32(weight)
        self.fields.setdefault(term, set()).update(fields)
        if pinned:
            self.pinned.add(term)


def _collect(index: Index, q: tuple) -> Weights:
    found: list = []

    def visit(q, boost, explicit, scope):
        kind = q[0]
        if kind in ("not", "all"):
            return
        if kind in ("conj", "disj"):
            for x in q[-1]:
                visit(x, boost, explicit, scope)
        elif kind == "boost":
            visit(q[2], f32(boost * f32(q[1])), True, scope)
        elif kind == "field":
            visit(q[2], boost, explicit, [f for f in scope if index.fields[f] == q[1]])
        elif kind == "span":
            found.extend((leaf, boost, explicit, scope) for leaf in span_leaves(q[1]))
        else:
            found.append((q, boost, explicit, scope))

    visit(q, f32(1), False, list(range(len(index.fields))))
    terms, wide = resolve(index, list(dict.fromkeys(x[0] for x in found)))
    out = Weights()
    for leaf, boost, explicit, scope in found:
        for t in terms.get(leaf, ()):
            out.add(t, boost, explicit, scope)
    most = min(MAX_TERMS, setting(index.spark, "max_expansion_terms"))
    if wide or sum(len(ts) for leaf, ts in terms.items() if leaf[0] != "term") > most:
        raise QueryError(f"the query expands to more than {most} terms")
    return out


def largest_tf(index: Index, terms: list[str]) -> dict[str, int]:
    """Largest frequency of each term in a document, from the dictionary."""
    rows = index.terms.where(F.col("bucket").isin(index.bucket_numbers(terms)) & F.col("term").isin(terms))
    return {r["term"]: r["max_tf"] for r in rows.select("term", "max_tf").collect()}


def stop_words(index: Index, setting: str | None) -> set[str]:
    """Literal terms, or the words of a preset that are one token in the index's analysis."""
    if not setting:
        return set()
    if setting == "auto" or setting.startswith("auto:"):
        words = builtin_stop_words(setting.partition(":")[2] or "auto")
        return {t[0] for w in words if len(t := index.analyzer.terms(w)) == 1}
    return {w.strip() for w in setting.split(",") if w.strip()}


def scoring_terms(index: Index, query: str, full: bool = False, dense_ratio: float = 0.10, term_add=None, term_replace=None, score_stop_words: str | None = None) -> tuple[Weights, dict[str, int]]:
    """The terms that score, after edits and (unless full) stop words and dense-term elision, with frequencies."""
    if term_add is not None and term_replace is not None:
        raise QueryError("term_add and term_replace exclude each other")
    w = _collect(index, compile_query(query, index.analyzer, scoring=True))
    if term_replace is not None:
        w = Weights()
    for text in (term_add if term_add is not None else term_replace) or ():
        for t in index.analyzer.terms(text):
            if t not in w.terms:
                w.add(t, f32(1), True, range(len(index.fields)))
            w.pinned.add(t)
    df = index.frequencies(sorted(w.terms))
    if not full:
        n, stop = index.totals[0], stop_words(index, score_stop_words)
        ratio = float(f32(dense_ratio))
        for t in list(w.terms):
            dense = df.get(t, 0) > 0 and df[t] >= ratio * n
            if t not in w.pinned and (dense or t in stop):
                del w.terms[t]
    return w, df


def scores(index: Index, query: str, full: bool = True, k1: float = 1.2, b: float = 0.75, **edits) -> DataFrame:
    """doc_id, score (float) of every document that matches; without scored terms the score is 0."""
    if not 0 <= k1 <= 10_000 or not 0 <= b <= 1:
        raise QueryError("k1 must be between 0 and 10000, b between 0 and 1")
    w, df = scoring_terms(index, query, full, **edits)
    return _ranked(index, compile_query(query, index.analyzer), w, df, k1, b)


def top_scores(index: Index, query: str, k: int, full: bool = True, k1: float = 1.2, b: float = 0.75, above: int = 100_000, **edits) -> DataFrame:
    """doc_id, score of documents that match, the k best among them.

    Where any of several words makes a match, and their postings are more than
    `above`, the rarest words' documents are scored first.  Words whose largest
    possible scores together stay below the k-th of those can't bring a document
    there alone: their postings are read for documents of the other words only.
    """
    if not 0 <= k1 <= 10_000 or not 0 <= b <= 1:
        raise QueryError("k1 must be between 0 and 10000, b between 0 and 1")
    w, df = scoring_terms(index, query, full, **edits)
    q = compile_query(query, index.analyzer)
    plain = lambda x: x[0] == "term" or x[0] == "boost" and x[2][0] == "term"
    used = sorted((t for t in w.terms if df.get(t, 0) > 0), key=lambda t: (df[t], t))
    if not (k > 0 and q[0] == "disj" and q[1] == 1 and all(map(plain, q[2])) and len(index.fields) == 1 and 2 <= len(used) <= FEW_SCORED and sum(df[t] for t in used) > above):
        return _ranked(index, q, w, df, k1, b)
    n, most = index.totals[0], largest_tf(index, used)

    def bound(t):
        tf = max(x for x in TF_STEPS if x <= max(1, most[t]))
        return max(0.0, float(idf(n, df[t])) * float(w.terms[t])) * (k1 + 1) * tf / (tf + k1 * (1 - b)) * (1 + 1e-5)  # a document of no length; rounding

    first, seen = [], 0
    for t in used:
        if seen >= 10 * k:
            break
        first.append(t)
        seen += df[t]
    part = Weights({t: w.terms[t] for t in first}, set(), {t: w.fields[t] for t in first})
    best = _ranked(index, ("disj", 1, [("term", t) for t in first]), part, df, k1, b).orderBy(F.desc("score"), "doc_id").limit(k).collect()
    if len(best) < k:
        return _ranked(index, q, w, df, k1, b)
    least, sum_of, aside = float(best[-1]["score"]), 0.0, []
    for t in sorted(used, key=lambda t: (bound(t), t)):
        sum_of += bound(t)
        if sum_of >= least or len(aside) == len(used) - 1:
            break
        aside.append(t)
    matched = {(x if x[0] == "term" else x[2])[1] for x in q[2]}
    if not aside or any(w.terms[t] < 0 for t in used):
        return _ranked(index, q, w, df, k1, b)
    wanted = sorted(set(used) - set(aside))
    sub = copy.copy(index)
    held = select_postings(index, wanted)
    sub.__dict__["postings"] = held.unionByName(select_postings(index, aside).join(held.select("doc_id").distinct(), "doc_id", "left_semi"))
    return _ranked(sub, ("disj", 1, [("term", t) for t in sorted(matched & set(used))]), w, df, k1, b)


def scores_of_all(index: Index, queries: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id, score of the documents that match all queries (clauses on one column), scored as one query of all their words."""
    found = Weights()
    for query in queries:
        one, _ = scoring_terms(index, query, True)
        for t, weight in one.terms.items():
            found.add(t, weight, t in one.pinned, one.fields[t])
    return _ranked(index, ("conj", [compile_query(q, index.analyzer) for q in queries]), found, index.frequencies(sorted(found.terms)), k1, b)


def _ranked(index: Index, q: tuple, w: Weights, df: dict[str, int], k1: float, b: float) -> DataFrame:
    zero = F.lit(0.0).cast("float")
    used = sorted(t for t in w.terms if df.get(t, 0) > 0)
    if not used:
        return matching(index, q).select("doc_id", zero.alias("score"))
    n, total, by_field = index.totals
    weights = [f32(x) for x in index.weights]
    several = len(index.fields) > 1
    if several:
        avgdl = f32(0)
        for x, t in zip(weights, by_field):
            avgdl = f32(avgdl + f32(x * f32(t)))
        avgdl = f32(avgdl / f32(n)) if n else f32(1)
    else:
        avgdl = f32(f32(total) / f32(n)) if n else f32(1)
    k1, b = f32(k1), f32(b)
    lit = lambda x: F.lit(float(x)).cast("float")
    add = lambda xs: F.coalesce(F.aggregate(xs, zero, lambda t, x: (t + x["s"]).cast("float")), zero)

    def term_score(mult, tf, length):
        numerator = mult * tf * lit(f32(k1 + f32(1)))
        denominator = (tf + lit(f32(k1 * f32(f32(1) - b)))) + lit(f32(f32(k1 * b) / avgdl)) * length
        return (numerator / denominator).cast("float")

    mults = {t: float(f32(idf(n, df[t]) * w.terms[t])) for t in used}
    if not several and len(used) <= FEW_SCORED:  # in the pass that matches: a posting has all that its score needs
        mult = F.lit(None).cast("float")
        for t in reversed(used):
            mult = F.when(F.col("term") == t, lit(mults[t])).otherwise(mult)
        one = F.when(F.col("term").isin(used), F.struct("term", term_score(mult, tf_representative(F.col("tf")), F.col("dl").cast("float")).alias("s")))
        rows = matching(index, q, used, {"xs": F.sort_array(F.collect_list(one))})  # a document's scoring terms
        return rows.select("doc_id", add("xs").alias("score"))
    table = index.spark.createDataFrame([(t, mults[t], sorted(w.fields[t])) for t in used], "term string, mult float, scope array<int>")
    rows = select_postings(index, used).select("term", "doc_id", "field", "tf", "dl").join(F.broadcast(table), "term")  # at most MAX_TERMS rows
    if several:
        own = F.array(*map(lit, weights))
        rows = rows.where(F.array_contains("scope", F.col("field"))).groupBy("term", "doc_id", "mult").agg(
            F.sort_array(F.collect_list(F.struct("field", (F.get(own, F.col("field")) * tf_representative(F.col("tf"))).cast("float").alias("x")))).alias("xs")
        ).select("term", "doc_id", "mult", F.aggregate("xs", zero, lambda s, x: (s + x["x"]).cast("float")).alias("tf"))
        length = zero
        for i, x in enumerate(weights):
            length = (length + (lit(x) * F.get("field_dl", F.lit(i)).cast("float")).cast("float")).cast("float")
        rows = rows.join(index.docs.select("doc_id", length.alias("len")), "doc_id")
    else:
        rows = rows.select("term", "doc_id", "mult", tf_representative(F.col("tf")).alias("tf"), F.col("dl").cast("float").alias("len"))
    parts = rows.select("doc_id", "term", term_score(F.col("mult"), F.col("tf"), F.col("len")).alias("s"))
    sums = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term", "s"))).alias("xs"))  # a document's scoring terms
    return matching(index, q).join(sums.select("doc_id", add("xs").alias("score")), "doc_id", "left").select("doc_id", F.coalesce("score", zero).alias("score"))


def inspect(index: Index, query: str, **edits) -> DataFrame:
    """term, weight of the terms that score()."""
    w, _ = scoring_terms(index, query, **edits)
    return index.spark.createDataFrame([(t, float(w.terms[t])) for t in sorted(w.terms)], "term string, weight float")
