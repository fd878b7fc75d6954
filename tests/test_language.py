"""Recorded answers of the query language, on the per-document evaluator."""

import pytest

from spanlake.functions.analysis import Analyzer, AnalyzerSpec
from spanlake.operators.evaluate import Doc, evaluate, matches
from spanlake.plans.parser import QueryError, maybe_quote, parse
from spanlake.plans.query import compile_query, ql_parse

DRINKS = ["craft beer and wine", "wine only", "beer bud light", "stout beer from the brewery", "brewing notes: hops and malt", "the craft of wine making", "beer beer beer", "Cider"]
SPANS4 = ["alpha x beta gamma", "alpha beta gamma", "beta gamma alpha", "alpha x y beta gamma"]
MINIMAL6 = ["x hotel hotel hotel zed y", "hotel x hotel zed", "hotel hotel zed", "a b b c d", "a b c b d", "a b x x b"]


def ids(texts, query, **spec):
    a = Analyzer(AnalyzerSpec(**spec))
    q = compile_query(query, a)
    return [i for i, t in enumerate(texts, 1) if t is not None and evaluate(q, Doc.of({"body": t}, a))]


@pytest.mark.parametrize("texts, query, want", [
    (DRINKS, "beer", [1, 3, 4, 7]), (DRINKS, "CIDER", [8]), (DRINKS, "mead", []), (DRINKS, "craft beer", [1]), (DRINKS, "craft AND wine", [1, 6]),
    (DRINKS, "cider OR stout", [4, 8]), (DRINKS, "craft beer OR cider", [1, 8]), (DRINKS, "beer AND NOT bud", [1, 4, 7]), (DRINKS, "(cider OR stout) AND beer", [4]),
    (DRINKS, '"craft beer"', [1]), (DRINKS, '"beer craft"', []), (DRINKS, "brew*", [4, 5]), (DRINKS, "wine NEAR/3 craft", [1, 6]), (DRINKS, "beer^0", [1, 3, 4, 7]),
    (SPANS4, 'alpha THEN/1 "beta gamma"', [1, 2]), (SPANS4, 'alpha THEN/2 "beta gamma"', [1, 2, 4]), (SPANS4, '"alpha x" THEN/2 "beta gamma"', [1, 4]),
    (SPANS4, '"beta gamma" THEN/1 alpha', [3]), (SPANS4, "alpha THEN/1 beta", [1, 2]), (SPANS4, 'alpha NEAR/1 "beta gamma"', [1, 2, 3]),
    (MINIMAL6, '"hotel _ hotel zed"', [2]), (MINIMAL6, '"hotel _ hotel"', [2]), (MINIMAL6, '"hotel hotel zed"', [1, 3]), (MINIMAL6, '"a b" NEAR/2 b', []),
    (MINIMAL6, '"a b" NEAR/1 b', []), (MINIMAL6, 'b NEAR/2 "a b"', []), (MINIMAL6, '"a b" THEN/2 b', [4, 5, 6]),
    (["apple", "", "...", None], "*", [1]), (["big bad wolf", "big wolf", "big very bad wolf"], '"big _ wolf"', [1]), (["big bad wolf", "big wolf", "big very bad wolf"], '"big __ wolf"', [3]),
    (["a b x c", "a x b x x c", "a x b x c"], '"a _ b __ c"', [2]), (["fuji red apple", "fuji x y z apple", "apple fuji"], '"fuji apple"~2', [1]),
    (["fuji red apple", "fuji x y z apple", "apple fuji"], '"fuji apple"~3', [1, 2]), (["a c", "a x c", "a x y c", "a x y z c"], '"a _ c"~1', [2, 3]),
    (["foo_bar", "foo x bar", "foo bar"], '"foo_bar"', [2]), (["foo_bar", "foo x bar", "foo bar"], r'"foo\_bar"', [1]), (["foo_bar", "foo x bar", "foo bar"], "foo_bar", [1]),
    (["wi fx", "wi fi", "wi xx"], "wi-fi~1", [1, 2]), (["apple", "apply", "zebra"], "MATCHES Apple.*", []), (["apple", "apples", "zebra"], "MATCHES apple.*", [1, 2]),
    (["apple", "apply"], "MATCHES ppl", []), (["the", "teh"], "teh~1", [2]), (["the", "teh"], "teh~2", [1, 2]),
    (["ant", "bee", "cat", "dog"], "bee TO cat", [2, 3]), (["ant", "bee", "cat", "dog"], "* TO bee", [1, 2]), (["ant", "bee", "cat", "dog"], "cat TO *", [3, 4]), (["ant", "bee"], "cat TO bee", []),
    (["a x", "b"], "AT LEAST 0 OF [a b]", [1, 2]), (["a b", "b"], "AT LEAST 5 OF [a b]", []), (["47,000", "48,000", "9"], "[47,000 48,000]", [1, 2]), (["beer", "wine"], "[beer,wine]", [1, 2]),
    (["a b c d"], "a IN WORDS 0 TO 0", []), (["a b c d"], "a IN WORDS 1 TO 1", [1]), (["a b c d e"], "e IN LAST 1 WORDS", [1]), (["a b c d e"], "d IN LAST 1 WORDS", []),
    (["a b c d"], "a IN FIRST 25%", [1]), (["a b c d"], "b IN FIRST 25%", []), (["a b c d"], "b IN MIDDLE 50%", [1]), (["a b c d"], "a IN FIRST 0 WORDS", []),
    (["b a", "a b"], "a BEFORE b", [2]), (["b a", "a b"], "a AFTER b", [1]), (["a", "a a"], "a NEAR/2 a", [2]), (["beer", "wine"], "beer AND NOT ,", [1]),
])
def test_recorded(texts, query, want):
    assert ids(texts, query) == want


@pytest.mark.parametrize("query", ['""', "[]", '"   "', "apple AND", "(apple", "apple)", "a BEFORE b BEFORE c", "NOT a", "a THEN b", "* NOT ENCLOSES a", "* IN FIRST 3 WORDS", "a* TO c", "... TO z",
                                   "a ^2", "a^20000", r"MATCHES (a)\1", "MATCHES (?=a)b", "MATCHES (", "a~99999999999", "(" * 1100 + "a" + ")" * 1100])
def test_errors(query):
    with pytest.raises(QueryError):
        compile_query(query, Analyzer())


def test_empty_queries_match_nothing_without_error():
    assert [ids(["a", "b"], q) for q in ("", "  ", "!!!")] == [[], [], []]


def test_null_operands_are_null():
    assert matches(None, "a") is None and matches("a", None) is None and matches("a b", "b") is True


def test_filters_bind_to_the_primary_on_their_left():
    texts = ["a b", "a x x b"]
    assert ids(texts, "(a NEAR/5 b) WITHIN 2") == [1] and ids(texts, "a NEAR/5 b WITHIN 2") == [1, 2]


def test_implicit_or_is_a_parser_option():
    assert parse("a b AND c", implicit="or") == ("or", [("term", "a"), ("and", [("term", "b"), ("term", "c")])])


def test_display_and_quoting():
    assert ql_parse('"fuji apple" OR x') == 'OR(PHRASE("fuji apple"), x)' and ql_parse("appl* AND NOT pie") == "AND(REGEX(appl.*), NOT(pie))"
    assert [maybe_quote(x) for x in ("beer", "a b", "AND", 'x"y')] == ["beer", '"a b"', '"AND"', '"x\\"y"']


def test_position_gaps_of_discarded_tokens():
    text, q = ["x aaaaaaaaaaaa y"], '"x y"'
    assert ids(text, q, long_tokens="discard", max_token_bytes=8) == []
    assert ids(text, q, long_tokens="discard", max_token_bytes=8, position_gaps="collapse") == [1]
