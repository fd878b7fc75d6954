"""Compiles a query to a DataFrame of matching documents over the index tables.

All words a query needs are read in one pass: postings of those words (pruned to
their buckets) are grouped by document into flags and, for spans, positions; the
Boolean structure is then one Column.  A span is first reduced to its Boolean
skeleton; common shapes (phrases of words, THEN and NEAR of two words, BEFORE,
AFTER, windows on a word) stay built-in expressions, the rest is solved by one
Arrow UDF on the documents the skeleton leaves.
"""

from __future__ import annotations

import operator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.operators.spans import intervals, skeleton
from spanlake.plans.parser import QueryError
from spanlake.plans.query import NONE, check_fields, prune, span_children, span_leaves
from spanlake.sources.index import Index

MAX_TERMS = 65_536
FEW = 1_000
PRUNE_ABOVE = 100_000  # documents; smaller indexes don't ask the dictionary which word is rarest


def java_regex(p: str) -> str:
    return f"(?U)^(?:{p})$"


def term_condition(leaf: tuple, term: Column) -> Column:
    """A leaf as a condition on dictionary terms."""
    kind = leaf[0]
    if kind == "term":
        return term == leaf[1]
    if kind == "regex":
        p = leaf[1]
        if p.endswith(".*") and not any(c in p[:-2] for c in "\\.+*?()|[]{}^$"):
            return term.startswith(p[:-2])
        return term.rlike(java_regex(p))
    if kind == "range":
        lo, hi = leaf[1], leaf[2]
        both = [term >= lo] * (lo is not None) + [term <= hi] * (hi is not None)
        return reduce(operator.and_, both, F.lit(True))
    text, prefix, most = leaf[1:]
    head, rest = text[:prefix], text[prefix:]
    near = F.levenshtein(F.substring(term, len(head) + 1, 1 << 30), F.lit(rest), min(most, 1 << 30)) >= 0
    return (term.startswith(head) & near) if head else near


def resolve(index: Index, leaves: list[tuple]) -> tuple[dict[tuple, list[str]], list[tuple]]:
    """Dictionary terms of each leaf, and the leaves that have more than MAX_TERMS."""
    found: dict[tuple, list[str]] = {x: [x[1]] for x in leaves if x[0] == "term"}
    wide = []
    for leaf in leaves:
        if leaf[0] == "term":
            continue
        rows = index.terms.where(term_condition(leaf, F.col("term"))).select("term").limit(MAX_TERMS + 1).collect()
        if len(rows) > MAX_TERMS:
            wide.append(leaf)
        else:
            found[leaf] = sorted(r["term"] for r in rows)
    return found, wide


def select_postings(index: Index, terms: list[str]) -> DataFrame:
    """Postings of exact terms, from their buckets only."""
    posts = index.postings
    if len(terms) <= FEW:
        return posts.where(F.col("bucket").isin(index.bucket_numbers(terms)) & F.col("term").isin(terms)) if terms else posts.where(F.lit(False))
    named = index.spark.createDataFrame([(index.bucket_number(t), t) for t in terms], "bucket int, term string")  # at most MAX_TERMS a leaf
    return posts.join(F.broadcast(named), ["bucket", "term"], "left_semi")  # by bucket too, so that other folders aren't read


class Plan:
    def __init__(self, index: Index, q: tuple):
        self.index, self.q = index, q
        self.fields = list(range(len(index.fields)))
        self.flags: dict = {}
        self.places: dict = {}
        self.uses_docs = self.solves = False
        self._visit(q, tuple(self.fields))
        self.leaves = list(dict.fromkeys([k[0] for k in self.flags] + [k[0] for k in self.places]))

    def _scope(self, name: str, scope: tuple) -> tuple:
        return tuple(f for f in scope if self.index.fields[f] == name)

    def _visit(self, q: tuple, scope: tuple) -> None:
        kind = q[0]
        if kind == "conj":
            for x in q[1]:
                self._visit(x, scope)
        elif kind == "disj":
            for x in q[2]:
                self._visit(x, scope)
        elif kind == "not":
            self._visit(q[1], scope)
        elif kind == "boost":
            self._visit(q[2], scope)
        elif kind == "field":
            self._visit(q[2], self._scope(q[1], scope))
        elif kind == "all":
            self.uses_docs |= len(scope) < len(self.fields)
        elif kind == "span":
            for leaf in span_leaves(q[1]):
                for f in scope:
                    self.places.setdefault((leaf, f), f"p{len(self.places)}")
            self.uses_docs |= self._needs_length(q[1])
            self.solves |= not self._is_native(q[1])
        elif kind != "none":
            self.flags.setdefault((q, scope), f"b{len(self.flags)}")

    def _needs_length(self, n: tuple) -> bool:
        return n[0] == "window" and n[1][0] != "words" and (n[1][0] != "first" or n[1][2]) or any(map(self._needs_length, span_children(n)))

    # ------------------------------------------------------------- conditions
    def truth(self, q: tuple, scope: tuple, span) -> Column:
        kind = q[0]
        go = lambda x: self.truth(x, scope, span)
        if kind == "conj":
            return reduce(operator.and_, map(go, q[1]))
        if kind == "disj":
            if q[1] == 1:
                return reduce(operator.or_, map(go, q[2]))
            return reduce(operator.add, (go(x).cast("int") for x in q[2])) >= q[1]
        if kind == "not":
            return ~go(q[1])
        if kind == "boost":
            return go(q[2])
        if kind == "field":
            return self.truth(q[2], self._scope(q[1], scope), span)
        if kind == "all":
            if len(scope) == len(self.fields):
                return F.lit(True)
            return reduce(operator.or_, (F.get("field_dl", F.lit(f)) > 0 for f in scope), F.lit(False))
        if kind == "span":
            return span(q[1], scope)
        if kind == "none":
            return F.lit(False)
        return F.coalesce(F.col(self.flags[(q, scope)]), F.lit(False))

    def without_words(self, q: tuple) -> bool:
        """Whether a document with none of the query's words could match."""
        kind = q[0]
        if kind == "conj":
            return all(map(self.without_words, q[1]))
        if kind == "disj":
            return sum(map(self.without_words, q[2])) >= q[1]
        if kind == "not":
            return not self._surely(q[1])
        if kind in ("boost", "field"):
            return self.without_words(q[2])
        return kind == "all"

    def _surely(self, q: tuple) -> bool:
        """Whether such a document matches for sure."""
        kind = q[0]
        if kind == "conj":
            return all(map(self._surely, q[1]))
        if kind == "disj":
            return sum(map(self._surely, q[2])) >= q[1]
        if kind == "not":
            return not self.without_words(q[1])
        if kind == "boost":
            return self._surely(q[2])
        if kind == "field":
            return False
        return kind == "all"

    def places_of(self, leaf: tuple, f: int) -> Column:
        return F.coalesce(F.col(self.places[(leaf, f)]), F.array().cast("array<int>"))

    def rough(self, node: tuple, scope: tuple) -> Column:
        own = lambda f: skeleton(node, lambda leaf: F.lit(False) if leaf is None else F.size(self.places_of(leaf, f)) > 0)
        return reduce(operator.or_, map(own, scope), F.lit(False))

    def exact(self, node: tuple, scope: tuple) -> Column:
        return reduce(operator.or_, (self._native(node, f) if self._is_native(node) else self._solve(node, f) for f in scope), F.lit(False))

    # ------------------------------------------------------------------ spans
    @staticmethod
    def _is_native(n: tuple) -> bool:
        def word(x):
            return x[0] == "leaf" and x[1][0] == "term"

        kind = n[0]
        if kind == "leaf":
            return True
        if kind == "gaps" and n[1] == 0:
            inner = n[3]
            if inner[0] == "ordered" and all(map(word, inner[1])):
                return n[2] == 0 or len(inner[1]) == 2
            return inner[0] == "unordered" and len(inner[1]) == 2 and all(map(word, inner[1])) and inner[1][0] != inner[1][1]
        if kind == "rel":
            return n[1] in ("before", "after") and word(n[2]) and word(n[3])
        return kind == "window" and n[2][0] == "leaf"

    def _native(self, n: tuple, f: int) -> Column:
        at = lambda x: self.places_of(x[1], f)
        kind = n[0]
        if kind == "leaf":
            return F.size(at(n)) > 0
        if kind == "gaps":
            a, *rest = n[3][1]
            if n[3][0] == "ordered" and n[2] == 0:
                return F.exists(at(a), lambda p: reduce(operator.and_, (F.array_contains(at(b), p + k) for k, b in enumerate(rest, 1)), F.lit(True)))
            far = min(n[2], (1 << 31) - 3) + 1
            gap = lambda p, q: (q - p).between(1, far) if n[3][0] == "ordered" else F.abs(q - p) <= far
            return F.exists(at(a), lambda p: F.exists(at(rest[0]), lambda q: gap(p, q)))
        if kind == "rel":
            a, b = at(n[2]), at(n[3])
            return F.coalesce(F.array_min(a) < F.array_max(b) if n[1] == "before" else F.array_max(a) > F.array_min(b), F.lit(False))
        spec, dl = n[1], F.get("field_dl", F.lit(f)).cast("long") if self.uses_docs else F.lit(0)
        part = lambda pct: F.ceil(dl * pct / 100).cast("long")
        if spec[0] == "words":
            lo, hi = F.lit(max(spec[1], 1) - 1), F.lit(spec[2] - 1)
        elif spec[0] == "first":
            lo, hi = F.lit(0), (part(spec[1]) if spec[2] else F.lit(spec[1])) - 1
        elif spec[0] == "last":
            lo, hi = dl - F.least(part(spec[1]) if spec[2] else F.lit(spec[1]), dl), dl - 1
        else:
            out = F.ceil(dl * (100 - min(spec[1], 100)) / 200).cast("long")
            lo, hi = out, dl - out - 1
        return F.exists(at(n[2]), lambda p: p.between(lo, hi))

    def _solve(self, node: tuple, f: int, count: bool = False) -> Column:
        """Whether a span occurs in a field, or how often."""
        leaves = span_leaves(node)
        where = {leaf: k for k, leaf in enumerate(leaves)}

        @F.pandas_udf("int" if count else "boolean")
        def solved(dl: pd.Series, places: pd.DataFrame) -> pd.Series:
            found = [len(intervals(node, lambda leaf, row=row: sorted(map(int, row[where[leaf]])), int(n or 0))) for n, row in zip(dl, zip(*(places[c] for c in places)))]
            return pd.Series(found, dtype="int32") if count else pd.Series(found, dtype="int32") > 0

        dl = F.get("field_dl", F.lit(f)) if self.uses_docs else F.lit(0)
        return solved(dl, F.struct(*(self.places_of(leaf, f).alias(f"l{k}") for k, leaf in enumerate(leaves))))

    # ------------------------------------------------------------------- plan
    def run(self, more_terms: list[str], more: dict[str, Column]) -> DataFrame:
        """doc_id and, from the same pass over the postings of the query's words and more_terms, the aggregates in more."""
        if not self.leaves and not more:
            return self.index.docs.where(self.truth(self.q, tuple(self.fields), None)).select("doc_id")
        if self.q[0] == "term" and len(self.fields) == 1 and not more:  # a posting a document: nothing to group, and a limit stops early
            return select_postings(self.index, [self.q[1]]).select("doc_id")
        return self.rows(more_terms, more).where(self.truth(self.q, tuple(self.fields), self.exact)).select("doc_id", *more)

    def frequencies(self) -> DataFrame:
        """doc_id, freq: the number of minimal intervals of a span in a document, over its fields; documents without are left out."""
        node = self.q[1]
        freq = reduce(operator.add, (self._solve(node, f, count=True) for f in self.fields))
        return self.rows([], {}).select("doc_id", freq.alias("freq")).where("freq > 0")

    def rows(self, more_terms: list[str], more: dict[str, Column]) -> DataFrame:
        """Documents that may match, with the flags and places of the query's words and the aggregates in more."""
        index, every = self.index, tuple(self.fields)
        found, wide = resolve(index, self.leaves)
        whole = self.without_words(self.q)
        docs = index.docs.select("doc_id", "field_dl")
        terms = sorted({t for ts in found.values() for t in ts} | set(more_terms))
        many = len(terms) > FEW or wide
        if wide:
            posts = index.postings.where(reduce(operator.or_, [term_condition(x, F.col("term")) for x in wide]) | F.col("term").isin(terms))
        else:
            posts = select_postings(index, terms) if many or whole or len(terms) < 2 or index.totals[0] <= PRUNE_ABOVE else self._by_rarest(terms)
        if many and not wide:
            of: dict[str, list[int]] = {t: [] for t in terms}
            for k, leaf in enumerate(self.leaves):
                for t in found[leaf]:
                    of[t].append(k)
            table = index.spark.createDataFrame([(index.bucket_number(t), t, ks) for t, ks in of.items()], "bucket int, term string, ks array<int>")
            posts = index.postings.join(F.broadcast(table), ["bucket", "term"])  # at most MAX_TERMS a leaf
            is_leaf = {leaf: F.array_contains("ks", k) for k, leaf in enumerate(self.leaves)}
        else:
            is_leaf = {leaf: term_condition(leaf, F.col("term")) if leaf in wide or leaf[0] == "term" else F.col("term").isin(found[leaf]) for leaf in self.leaves}
        inside = lambda fs: F.lit(True) if len(fs) == len(self.fields) else F.col("field").isin(list(fs))
        aggs = [F.max(is_leaf[leaf] & inside(scope)).alias(name) for (leaf, scope), name in self.flags.items()]
        aggs += [F.flatten(F.collect_list(F.when(is_leaf[leaf] & inside((f,)), F.col("positions")))).alias(name) for (leaf, f), name in self.places.items()]
        if self.solves:  # the solver's work isn't seen in the size of its input: keep all partitions
            posts = posts.repartition(int(index.spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
        rows = posts.groupBy("doc_id").agg(*aggs, *(c.alias(name) for name, c in more.items()))
        if whole:
            rows = docs.join(rows, "doc_id", "left")
        elif self.uses_docs:
            rows = rows.where(self.truth(self.q, every, self.rough)) if not self._negated_span(self.q) and not self._scoped_all(self.q) else rows
            rows = rows.join(docs, "doc_id")
        if self.places and not self._negated_span(self.q):
            rows = rows.where(self.truth(self.q, every, self.rough))
        return rows

    def _by_rarest(self, terms: list[str]) -> DataFrame:
        """Postings of terms, those of the others only for documents of the rarest word that a match must have, where it is much rarer."""
        needed = {leaf[1] for leaf in self.required(self.q) if leaf[0] == "term"}
        df = self.index.frequencies(terms) if needed else {}
        rare = min(needed, key=lambda t: (df.get(t, 0), t), default=None)
        if rare is None or df.get(rare, 0) * 10 > sum(df.values()):
            return select_postings(self.index, terms)
        held = select_postings(self.index, [rare])
        others = select_postings(self.index, [t for t in terms if t != rare])
        return held.unionByName(others.join(held.select("doc_id").distinct(), "doc_id", "left_semi"))

    def required(self, q: tuple) -> set:
        """Leaves that every matching document has."""
        kind = q[0]
        if kind == "conj":
            return set().union(*map(self.required, q[1]))
        if kind == "disj":
            parts = [self.required(x) for x in q[2]]
            return set.intersection(*parts) if q[1] == 1 else set().union(*parts) if q[1] == len(parts) else set()
        if kind in ("boost", "field"):
            return self.required(q[2])
        if kind == "span":
            return self._required_span(q[1])
        return set() if kind in ("not", "all", "none") else {q}

    def _required_span(self, n: tuple) -> set:
        kind = n[0]
        if kind == "leaf":
            return {n[1]}
        if kind == "rel" and n[1] in ("ncontain", "nwithin", "noverlap"):
            return self._required_span(n[2])
        parts = [self._required_span(c) for c in span_children(n)]
        if kind == "or" or kind == "atleast" and n[1] == 1:
            return set.intersection(*parts)
        return set().union(*parts) if kind != "atleast" or n[1] == len(parts) else set()

    def _scoped_all(self, q: tuple) -> bool:
        return any(self._scoped_all(x) for x in (q[1] if q[0] == "conj" else q[2] if q[0] == "disj" else [q[1]] if q[0] == "not" else [q[2]] if q[0] in ("boost", "field") else [])) or q == ("all",)

    def _negated_span(self, q: tuple, negated: bool = False) -> bool:
        """A negated span can't be prefiltered by its skeleton."""
        kind = q[0]
        if kind == "not":
            return self._negated_span(q[1], True)
        if kind == "span":
            return negated
        return any(self._negated_span(x, negated) for x in (q[1] if kind == "conj" else q[2] if kind == "disj" else [q[2]] if kind in ("boost", "field") else []))


def matching(index: Index, q: tuple, more_terms: list[str] | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """doc_id of every live document that matches a lowered query, and aggregates (more) over its postings of the query's words and more_terms."""
    check_fields(q, index.fields) if len(index.fields) > 1 else _no_fields(q)
    index.check_analysis()
    q = prune(q)
    if q in (NONE, ("none",)):
        return index.postings.where(F.lit(False)).groupBy("doc_id").agg(*(c.alias(name) for name, c in more.items())) if more else index.docs.select("doc_id").where(F.lit(False))
    return Plan(index, q).run(more_terms or [], more or {})


def _no_fields(q: tuple) -> None:
    from spanlake.plans.query import walk

    if any(x[0] == "field" for x in walk(q)):
        raise QueryError("a field scope needs an index of several fields")
