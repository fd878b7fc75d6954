import pytest
from pyspark.sql import functions as F

from spanlake.functions.analysis import Analyzer, AnalysisError, AnalyzerSpec, builtin_stop_words, token_column


@pytest.mark.parametrize("text, want, spec", [
    ("3.14 can't wi-fi example.com e-mail U.S.A. 1,000 foo_bar @user #tag", ["3.14", "can't", "wi", "fi", "example.com", "e", "mail", "u.s.a", "1,000", "foo_bar", "user", "tag"], {}),
    ("Straße STRASSE İstanbul ΣΊΣΥΦΟΣ", ["straße", "strasse", "istanbul", "σισυφοσ"], {}),
    ("Jalapeño ﬁne Ｆｕｌｌ ① x²", ["jalapeno", "ﬁne", "ｆｕｌｌ", "①", "x", "²"], {}),
    ("I ❤️ 😀 👩‍💻 🇺🇸", ["i", "❤", "😀", "👩‍💻", "🇺🇸"], {}), ("I ❤️ 😀", ["i"], {"graphemes": "discard"}),
    ("東京タワー ひらがな 한국어", ["東", "京", "タワー", "ひ", "ら", "か", "な", "한국어"], {}), ("Hello, World! wi-fi", ["hello,", "world!", "wi-fi"], {"tokenizer": "whitespace"}),
    ("a" * 300, ["a" * 256, "a" * 44], {}), ("a" * 300, ["a" * 256], {"long_tokens": "truncate"}), ("a" * 300, [], {"long_tokens": "discard"}), ("Café", ["Café"], {"case_folding": "preserve", "accent_folding": "preserve"}),
])
def test_recorded(text, want, spec):
    assert Analyzer(AnalyzerSpec(**spec)).terms(text) == want


def test_continuations_take_positions():
    assert [(t.text, t.pos) for t in Analyzer(AnalyzerSpec(max_token_bytes=4)).tokens("abcdefgh z")] == [("abcd", 0), ("efgh", 1), ("z", 2)]


def test_options_are_checked():
    for bad in ({"tokenizer": "x"}, {"max_token_bytes": 3}, {"graphemes": "y"}):
        with pytest.raises(AnalysisError):
            AnalyzerSpec(**bad)


def test_column_equals_analyzer(spark):
    import random

    r = random.Random(7)
    pool = ["a", "B", "é", "Ñ", "ß", "9", "1", ".", ",", "'", ":", ";", "_", " ", "-", "\n", "İ", "x", "😀", "東", "Σ", "²", "ﬁ", "́"]
    texts = ["".join(r.choices(pool[:18] if i % 2 else pool, k=r.randint(0, 25))) for i in range(1500)] + [None, "", "a" * 700, "é" * 200]
    for spec in (AnalyzerSpec(), AnalyzerSpec(case_folding="preserve"), AnalyzerSpec(accent_folding="preserve", max_token_bytes=8), AnalyzerSpec(graphemes="retain"), AnalyzerSpec(tokenizer="whitespace")):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        got = {x.i: x.c for x in df.select("i", token_column(F.col("t"), spec).alias("c")).collect()}
        for i, t in enumerate(texts):
            want = None if t is None else [(x.text, x.pos) for x in Analyzer(spec).tokens(t)]
            assert (got[i] if got[i] is None else [tuple(x) for x in got[i]]) == want, (t, spec)


def test_stop_words():
    assert len(builtin_stop_words("en")) == 59 and set(builtin_stop_words("en")) < set(builtin_stop_words("AUTO"))


def test_tokens_leave_in_small_pieces():
    """A batch of long texts isn't held as tokens as a whole, and its pieces are the analyzer's tokens."""
    import pyarrow as pa

    from spanlake.functions import analysis as A

    spec = A.AnalyzerSpec(tokenizer="whitespace", long_tokens="discard", max_token_bytes=8)
    a = A.Analyzer(spec)
    texts = [None, "", "Straße İx toolongword _ ΑΣ", *(f"Word{i} and more " * 9000 for i in range(40)), "end\x1cof", None]

    def fill(t, held):
        for c, values in zip(("text", "pos"), a.words(t)):
            held[c] += values

    parts = list(A._lists(pa.array(texts), {"text": pa.string(), "pos": pa.int32()}, fill))
    assert max(len(p.flatten()) for p in parts) * 5 < A.PIECE + 200_000 and len(parts) > 4
    got = [x for p in parts for x in p.to_pylist()]
    assert got == [None if t is None else [{"text": x.text, "pos": x.pos} for x in a.tokens(t)] for t in texts]
