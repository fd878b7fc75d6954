"""Evaluation of a query on one document: the sequential path, and the oracle of the compiled plans."""

from __future__ import annotations

from functools import lru_cache

import regex

from spanlake.functions.analysis import Analyzer
from spanlake.operators.spans import intervals
from spanlake.plans.parser import deep
from spanlake.plans.query import compile_query


class Doc:
    """A document's fields as term -> positions, with lengths."""

    def __init__(self, fields: dict[str, list]):
        self.length = {f: len(tokens) for f, tokens in fields.items()}
        self.at: dict[str, dict[str, list[int]]] = {}
        for f, tokens in fields.items():
            held = self.at.setdefault(f, {})
            for t in tokens:
                held.setdefault(t.text, []).append(t.pos)

    @classmethod
    def of(cls, texts: dict[str, str | None], analyzer: Analyzer) -> Doc:
        doc = cls({})
        for f, text in texts.items():
            if text is not None:
                words, at = analyzer.words(text)
                held = doc.at.setdefault(f, {})
                doc.length[f] = len(words)
                for t, p in zip(words, at):
                    held.setdefault(t, []).append(p)
        return doc


def levenshtein_within(a: str, b: str, most: int) -> bool:
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


@lru_cache(4096)
def _pattern(p: str):
    return regex.compile(p, regex.V0)


def leaf_matches(leaf: tuple, term: str) -> bool:
    kind = leaf[0]
    if kind == "term":
        return term == leaf[1]
    if kind == "regex":
        return _pattern(leaf[1]).fullmatch(term) is not None
    if kind == "range":
        t = term.encode()
        return (leaf[1] is None or leaf[1].encode() <= t) and (leaf[2] is None or t <= leaf[2].encode())
    p = leaf[2]
    return term[:p] == leaf[1][:p] and len(leaf[1][:p]) <= len(term) and levenshtein_within(leaf[1][p:], term[p:], leaf[3])


def leaf_positions(leaf: tuple, at: dict[str, list[int]]) -> list[int]:
    if leaf[0] == "term":
        return at.get(leaf[1], [])
    return sorted({p for t, ps in at.items() if leaf_matches(leaf, t) for p in ps})


def _eval(q: tuple, doc: Doc, scope: list[str]) -> bool:
    kind = q[0]
    if kind == "conj":
        return all(_eval(x, doc, scope) for x in q[1])
    if kind == "disj":
        return sum(_eval(x, doc, scope) for x in q[2]) >= q[1]
    if kind == "not":
        return not _eval(q[1], doc, scope)
    if kind == "boost":
        return _eval(q[2], doc, scope)
    if kind == "field":
        return _eval(q[2], doc, [f for f in scope if f == q[1]])
    if kind == "all":
        return any(doc.length.get(f) for f in scope)
    if kind == "span":
        return any(intervals(q[1], lambda leaf, f=f: leaf_positions(leaf, doc.at.get(f, {})), doc.length.get(f, 0)) for f in scope)
    return any(leaf_positions(q, doc.at.get(f, {})) for f in scope)


@deep
def evaluate(q: tuple, doc: Doc, fields: list[str] | None = None) -> bool:
    """Whether the document matches; one without tokens matches nothing."""
    fields = list(doc.length) if fields is None else fields
    return any(doc.length.get(f) for f in fields) and _eval(q, doc, fields)


def matches(text: str | None, query: str | None, analyzer: Analyzer | None = None) -> bool | None:
    """text ==> query without an index; null on either side gives null."""
    if text is None or query is None:
        return None
    a = analyzer or Analyzer()
    return evaluate(compile_query(query, a), Doc.of({"body": text}, a))
