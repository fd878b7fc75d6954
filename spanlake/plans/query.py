"""From a parsed tree to a query: analysis of its words, lowering, simplification, display.

Queries: ("term", s) ("all",) ("not", q) ("conj", qs) ("disj", min, qs)
("fuzzy", s, prefix, distance) ("regex", p) ("range", lo, hi) ("boost", f, q)
("field", name, q) ("span", node).  Span nodes: ("empty",) ("leaf", query leaf)
("ordered"|"unordered"|"or", nodes) ("atleast", min, nodes)
("gaps", least, most, node) ("width", most, node) ("window", spec, node)
("rel", kind, a, b).  prune() puts ("none",), which no document matches in any
scope, in the place of spans whose operands were analysed away.
"""

from __future__ import annotations

import math
import re

import regex as _regex

from spanlake.functions.analysis import Analyzer, Token
from spanlake.plans.parser import QueryError, deep, parse

NONE = ("not", ("all",))
MAX_SPAN_NESTING, MAX_COMBINATIONS, MAX_EXPANSION, MAX_REGEX = 2000, 10_000, 100_000, 2 << 20


# ---------------------------------------------------------------- analysis
def _phrase_of(tokens: list[Token]) -> list:
    out, before = [], None
    for t in tokens:
        if before is not None and t.pos - before > 1:
            out.append(("gap", t.pos - before - 1))
        before = t.pos
        out.append(("word", t.text))
    return out


def _whole(tokens: list[Token], text: str) -> None:
    if any(t.split for t in tokens):
        raise QueryError(f"the long-token policy splits {text!r}")


def _analyze_phrase(elements: list, a: Analyzer) -> list:
    out, run, gap = [], [], 0

    def put(x):
        nonlocal gap
        if out and gap:
            out.append(("gap", gap))
        gap = 0
        out.append(x)

    def flush():
        nonlocal gap
        if not run:
            return
        *tokens, mark = a.tokens(" ".join(run) + " a")  # the mark shows the positions of discarded trailing words
        run.clear()
        before = -1
        for t in tokens:
            gap += t.pos - before - 1
            before = t.pos
            put(("word", t.text))
        gap += mark.pos - before - 1

    for kind, x in elements:
        if kind == "word":
            run.append(x)
            continue
        flush()
        if kind == "gap":
            gap += x
        else:
            put(("any", [_analyze(y, a) for y in x]))
    flush()
    return out


def escape(text: str) -> str:
    return re.sub(r"([\\.+*?()|\[\]{}^$#&\-~])", r"\\\1", text)


def _analyze_wild(parts: list, a: Analyzer):
    segments = [[0, []]]
    for p in parts:
        if isinstance(p, str):
            segments[-1][1].append((".*" if p == "*" else ".", None))
            continue
        tokens = a.tokens(p[1])
        _whole(tokens, p[1])
        if not tokens:
            return ("none",)
        before = None
        for t in tokens:
            if before is not None:
                segments.append([t.pos - before - 1, []])
            before = t.pos
            segments[-1][1].append((escape(t.text), t.text))
    done = []
    for gap, pieces in segments:
        if all(text is not None for _, text in pieces):
            done.append((gap, ("term", "".join(text for _, text in pieces))))
        else:
            done.append((gap, ("regex", "".join(p for p, _ in pieces))))
    if len(done) == 1:
        return done[0][1]
    out = []
    for gap, x in done:
        if gap:
            out.append(("gap", gap))
        out.append(("word", x[1]) if x[0] == "term" else ("any", [x]))
    return ("phrase", out, None)


def _analyze(x: tuple, a: Analyzer) -> tuple:
    kind = x[0]
    if kind == "term":
        tokens = a.tokens(x[1])
        if len(tokens) < 2:
            return ("term", tokens[0].text) if tokens else ("none",)
        return ("phrase", _phrase_of(tokens), None)
    if kind == "fuzzy":
        tokens = a.tokens(x[1])
        _whole(tokens, x[1])
        if not tokens:
            return ("none",)
        last = ("fuzzy", tokens[-1].text, *x[2:])
        return last if len(tokens) == 1 else ("phrase", _phrase_of(tokens)[:-1] + [("any", [last])], None)
    if kind == "wild":
        return _analyze_wild(x[1], a)
    if kind == "range":
        def bound(s):
            if s is None:
                return None
            tokens = a.tokens(s)
            _whole(tokens, s)
            if not tokens:
                raise QueryError(f"range bound {s!r} has no word")
            return "".join(t.text for t in tokens)
        return ("range", bound(x[1]), bound(x[2]))
    if kind == "phrase":
        return ("phrase", _analyze_phrase(x[1], a), x[2])
    if kind in ("and", "or", "alts"):
        return (kind, [_analyze(y, a) for y in x[1]])
    if kind == "atleast":
        return (kind, x[1], [_analyze(y, a) for y in x[2]])
    if kind in ("andnot",):
        return (kind, _analyze(x[1], a), _analyze(x[2], a))
    if kind in ("then", "near"):
        return (kind, _analyze(x[1], a), _analyze(x[2], a), x[3])
    if kind == "rel":
        return (kind, x[1], _analyze(x[2], a), _analyze(x[3], a))
    if kind in ("window", "within", "boost", "field"):
        return (kind, x[1], _analyze(x[2], a))
    return x


# ---------------------------------------------------------------- lowering
def threshold(t: tuple, n: int) -> int:
    return t[1] if t[0] == "n" else n if t[0] == "all" else -(-t[1] * n // 100)


def check_regex(p: str) -> str:
    """Refuses what a linear-time regex dialect lacks: look-around, back references, possessive and atomic groups."""
    bare = re.sub(r"\\.", lambda m: "\\1" if m[0][1].isdigit() and m[0][1] != "0" or m[0][1] == "k" else "x", p, flags=re.S)
    if re.search(r"\\1|\(\?[=!>]|\(\?<[=!]|\(\?\(|[*+?}]\+", re.sub(r"\[[^\]]*\]", "x", bare)):
        raise QueryError(f"unsupported regular expression {p!r}")
    if len(p) > MAX_REGEX:
        raise QueryError("regular expression is too large")
    try:
        _regex.compile(p, _regex.V0)
    except _regex.error as e:
        raise QueryError(f"invalid regular expression {p!r}: {e}") from None
    return p


def _leaf(x: tuple) -> tuple:
    if x[0] == "regex":
        check_regex(x[1])
    return NONE if x[0] == "none" else x


def _lower(x: tuple) -> tuple:
    kind = x[0]
    if kind in ("term", "all", "none", "fuzzy", "regex", "range"):
        return _leaf(x)
    if kind == "and":
        return ("conj", [_lower(y) for y in x[1]])
    if kind in ("or", "alts"):
        return ("disj", 1, [_lower(y) for y in x[1]])
    if kind == "andnot":
        return ("conj", [_lower(x[1]), ("not", _lower(x[2]))])
    if kind == "atleast":
        return ("disj", threshold(x[1], len(x[2])), [_lower(y) for y in x[2]])
    if kind in ("boost", "field"):
        return (kind, x[1], _lower(x[2]))
    if kind == "phrase" and len(x[1]) == 1 and x[1][0][0] == "word":
        return ("term", x[1][0][1])
    n = _span(x, 1)
    plain, built = _sizes(n)
    if built - plain > MAX_EXPANSION:
        raise QueryError("AT LEAST inside a span expands to too many operands")
    return ("span", n)


def _span(x: tuple, depth: int) -> tuple:
    if depth > MAX_SPAN_NESTING:
        raise QueryError("query is nested too deeply")
    go = lambda y: _span(y, depth + 1)
    kind = x[0]
    if kind == "all":
        raise QueryError("* can't be used inside a span")
    if kind == "none":
        return ("empty",)
    if kind in ("term", "fuzzy", "regex", "range"):
        return ("leaf", _leaf(x))
    if kind in ("and", "or"):  # left-deep: (a b) c differs from a b c in gaps
        nodes = [go(y) for y in x[1]]
        acc = nodes[0]
        for n in nodes[1:]:
            acc = ("unordered" if kind == "and" else "or", [acc, n])
        return acc
    if kind == "alts":
        return ("or", [go(y) for y in x[1]])
    if kind == "andnot":
        return ("rel", "ncontain", go(x[1]), go(x[2]))
    if kind == "atleast":
        n = threshold(x[1], len(x[2]))
        if math.comb(len(x[2]), n) > MAX_COMBINATIONS:
            raise QueryError("AT LEAST has too many combinations")
        return ("atleast", n, [go(y) for y in x[2]])
    if kind == "then":
        return ("gaps", 0, x[3], ("ordered", [go(x[1]), go(x[2])]))
    if kind == "near":
        return ("gaps", 0, x[3], ("unordered", [go(x[1]), go(x[2])]))
    if kind == "rel":
        return ("rel", x[1], go(x[2]), go(x[3]))
    if kind == "window":
        return ("window", x[1], go(x[2]))
    if kind == "within":
        return ("width", x[1], go(x[2]))
    if kind == "boost":
        return go(x[2])
    if kind == "field":
        raise QueryError("a field scope can't be used inside a span")
    return _span_phrase(x[1], x[2], go)


def _span_phrase(elements: list, slop, go) -> tuple:
    children, gap = [], 0
    for kind, v in elements:
        if kind == "gap":
            gap += v
            continue
        children.append((gap, ("leaf", ("term", v)) if kind == "word" else ("or", [go(y) for y in v])))
        gap = 0
    if not children:
        return ("empty",)
    if len(children) == 1:
        return children[0][1]
    total, flat = sum(g for g, _ in children[1:]), [c for _, c in children]
    if not total:
        return ("gaps", 0, slop or 0, ("ordered", flat))
    if slop is not None:
        return ("gaps", total, total + slop, ("ordered", flat))
    acc = flat[0]
    for g, c in children[1:]:
        acc = ("gaps", g, g, ("ordered", [acc, c]))
    return acc


# ---------------------------------------------------------- simplification
def _simplify(q: tuple, dedup: bool) -> tuple:
    kind = q[0]
    if kind == "not":
        x = _simplify(q[1], dedup)
        return x[1] if x[0] == "not" else ("not", x)
    if kind in ("boost", "field"):
        x = _simplify(q[2], dedup)
        return x if x in (NONE, ("all",)) and kind == "boost" else (kind, q[1], x)
    if kind == "conj":
        out = []
        for x in (_simplify(y, dedup) for y in q[1]):
            if x == NONE:
                return NONE
            out += x[1] if x[0] == "conj" else [] if x == ("all",) else [x]
        out = _unique(out) if dedup else out
        return ("all",) if not out else out[0] if len(out) == 1 else ("conj", out)
    if kind == "disj":
        need, out = q[1], []
        if need == 0:
            return ("all",)
        for x in (_simplify(y, dedup) for y in q[2]):
            if x == NONE:
                continue
            if x == ("all",):
                need -= 1
            elif x[0] == "disj" and x[1] == 1 and need == 1 == q[1]:
                out += x[2]
            else:
                out.append(x)
        if need <= 0:
            return ("all",)
        if need == 1 and dedup:
            out = _unique(out)
        if need > len(out):
            return NONE
        if len(out) == 1:
            return out[0]
        return ("conj", out) if need == len(out) and need > 1 else ("disj", need, out)
    return q


def _unique(qs: list) -> list:
    seen, out = set(), []
    for q in qs:
        if q[0] == "term":
            if q in seen:
                continue
            seen.add(q)
        out.append(q)
    return out


def _sizes(n: tuple) -> tuple[int, int]:
    """Nodes of a span, as written and with AT LEAST expanded to its combinations."""
    parts = [_sizes(c) for c in span_children(n)]
    plain, built = 1 + sum(p for p, _ in parts), 1 + sum(b for _, b in parts)
    if n[0] != "atleast" or not 1 <= n[1] <= len(parts):
        return plain, built
    return plain, 1 + math.comb(len(parts), n[1]) + (built - 1) * math.comb(len(parts) - 1, n[1] - 1)  # each operand is in the latter number of combinations


def _without_empty(n: tuple) -> tuple:
    """A span without operands that can't occur; ("empty",) if it can't occur itself."""
    nothing, kind = ("empty",), n[0]
    if kind in ("leaf", "empty"):
        return n
    if kind in ("or", "atleast"):
        some = [x for x in map(_without_empty, span_children(n)) if x != nothing]
        if kind == "or":
            return nothing if not some else some[0] if len(some) == 1 else ("or", some)
        return nothing if not 1 <= n[1] <= len(some) else ("atleast", n[1], some)
    if kind == "rel":
        a, b = _without_empty(n[2]), _without_empty(n[3])
        if a == nothing or b == nothing:
            return a if n[1] in ("ncontain", "nwithin", "noverlap") else nothing
        return ("rel", n[1], a, b)
    every = [_without_empty(x) for x in span_children(n)]
    if nothing in every:
        return nothing
    return (kind, every) if kind in ("ordered", "unordered") else (*n[:-1], every[0])


def prune(q: tuple) -> tuple:
    """A query to be matched: the same documents, but no span has an operand that can't occur."""
    kind = q[0]
    if kind == "span":
        n = _without_empty(q[1])
        return ("none",) if n == ("empty",) else ("span", n)
    if kind == "conj":
        return (kind, [prune(x) for x in q[1]])
    if kind == "disj":
        return (kind, q[1], [prune(x) for x in q[2]])
    if kind == "not":
        return (kind, prune(q[1]))
    return (kind, q[1], prune(q[2])) if kind in ("boost", "field") else q


@deep
def compile_query(text: str, analyzer: Analyzer, scoring: bool = False, implicit: str = "and") -> tuple:
    """The query of a text; scoring keeps repeated terms, which weigh more; implicit: what white space means, and or or."""
    return _simplify(_lower(_analyze(parse(text, implicit), analyzer)), not scoring)


def walk(q: tuple):
    """All query nodes, spans not entered."""
    yield q
    kind = q[0]
    for x in q[1] if kind == "conj" else q[2] if kind == "disj" else [q[1]] if kind == "not" else [q[2]] if kind in ("boost", "field") else []:
        yield from walk(x)


def span_children(n: tuple) -> list:
    kind = n[0]
    return list(n[1]) if kind in ("ordered", "unordered", "or") else list(n[2]) if kind == "atleast" else [n[3]] if kind == "gaps" else [n[2]] if kind in ("width", "window") else [n[2], n[3]] if kind == "rel" else []


def span_leaves(n: tuple) -> list[tuple]:
    """Distinct leaves of a span, in order of first use."""
    out: dict = {}
    todo = [n]
    while todo:
        x = todo.pop()
        if x[0] == "leaf":
            out.setdefault(x[1])
        todo += reversed(span_children(x))
    return list(out)


def check_fields(q: tuple, fields: list[str]) -> None:
    for x in walk(q):
        if x[0] == "field" and x[1] not in fields:
            raise QueryError(f"unknown field {x[1]!r}")


# ------------------------------------------------------------------ display
def show_leaf(q: tuple) -> str:
    """A leaf as it is named in marks."""
    if q[0] == "term":
        return q[1]
    if q[0] == "regex":
        return f"MATCHES {q[1]}"
    if q[0] == "range":
        return "RANGE(" + ", ".join("*" if b is None else b for b in q[1:]) + ")"
    return q[1] + (f"~{q[3]}" if q[2] == 1 else f"~{q[2]}:{q[3]}")


_REL = {"contain": "CONTAINING", "ncontain": "NOT_CONTAINING", "within": "CONTAINED_BY", "nwithin": "NOT_CONTAINED_BY", "overlap": "OVERLAPPING", "noverlap": "NON_OVERLAPPING", "before": "BEFORE", "after": "AFTER"}


def show_window(spec: tuple) -> str:
    if spec[0] == "words":
        return f"IN WORDS {spec[1]} TO {spec[2]}"
    return f"IN {spec[0].upper()} {spec[1]}" + ("%" if spec[2] else " WORDS")


def _plain_phrase(n: tuple) -> str | None:
    if n[0] == "gaps" and n[1] == 0 and n[3][0] == "ordered" and all(c[0] == "leaf" and c[1][0] == "term" for c in n[3][1]):
        words = " ".join(re.sub(r'([\\"\[\]_])', r"\\\1", c[1][1]) for c in n[3][1])
        return f"PHRASE{f'/{n[2]}' if n[2] else ''}(\"{words}\")"
    return None


def show_span(n: tuple) -> str:
    kind = n[0]
    if (phrase := _plain_phrase(n)) is not None:
        return phrase
    if kind == "leaf":
        if n[1][0] == "range":
            return " TO ".join("*" if b is None else b for b in n[1][1:])
        return f"/{n[1][1]}/" if n[1][0] == "regex" else show_leaf(n[1])
    if kind == "empty":
        return "EMPTY"
    if kind in ("ordered", "unordered", "or"):
        return f"{kind.upper()}(" + ", ".join(map(show_span, n[1])) + ")"
    if kind == "atleast":
        return f"ATLEAST({n[1]}, " + ", ".join(map(show_span, n[2])) + ")"
    if kind == "gaps":
        return (f"MAXGAPS({n[2]}, " if n[1] == 0 else f"GAPS({n[1]}..{n[2]}, ") + show_span(n[3]) + ")"
    if kind == "width":
        return f"MAXWIDTH({n[1]}, {show_span(n[2])})"
    if kind == "window":
        return f"WINDOW({show_window(n[1])}, {show_span(n[2])})"
    return f"{_REL[n[1]]}({show_span(n[2])}, {show_span(n[3])})"


def show(q: tuple) -> str:
    """A readable form of a lowered query."""
    kind = q[0]
    if kind == "regex":
        return f"REGEX({q[1]})"
    if kind in ("term", "range", "fuzzy"):
        return show_leaf(q)
    if kind == "all":
        return "*"
    if kind == "not":
        return f"NOT({show(q[1])})"
    if kind == "conj":
        return "AND(" + ", ".join(map(show, q[1])) + ")"
    if kind == "disj":
        return ("OR(" if q[1] == 1 else f"ATLEAST({q[1]}, ") + ", ".join(map(show, q[2])) + ")"
    if kind == "boost":
        return f"{show(q[2])}^{q[1]:g}" if q[2][0] in ("term", "fuzzy") else f"({show(q[2])})^{q[1]:g}"
    if kind == "field":
        return f"{q[1]}:({show(q[2])})"
    if kind == "none":
        return "NONE"
    n, tail = q[1], ""
    if n[0] == "window":
        n, tail = n[2], " " + show_window(n[1])
    phrase = _plain_phrase(n)
    return (phrase if phrase is not None else f"SPAN({show_span(n)})") + tail


def ql_parse(text: str, surface: bool = False, analyzer: Analyzer | None = None) -> str:
    """The surface tree, or the lowered query, of a text."""
    return repr(parse(text)) if surface else show(compile_query(text, analyzer or Analyzer()))
