"""Text analysis: text to normalised tokens with positions.

`Analyzer` is the one definition, in Python (used for queries, highlights and any
text).  `token_column` gives the same tokens as a Spark column: texts of ASCII and
Latin letters stay in the JVM as built-in functions, the rest goes through an
Arrow UDF.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlake import ship_active


class AnalysisError(ValueError):
    pass


@dataclass(frozen=True)
class Token:
    text: str
    pos: int
    start: int
    end: int
    kind: str = "word"
    split: bool = False


def check_word(word: str) -> str:
    """A word of a custom dictionary: not empty, without white space, of at most 256 bytes."""
    if not word or any(c.isspace() for c in word) or len(word.encode()) > 256:
        raise AnalysisError(f"{word!r} can't be a word of a dictionary")
    return word


@dataclass(frozen=True)
class AnalyzerSpec:
    """The index's analysis options; fixed once an index is built."""

    tokenizer: str = "unicode"
    case_folding: str = "fold"
    accent_folding: str = "fold"
    long_tokens: str = "split"
    max_token_bytes: int = 256
    graphemes: str = "emoji"
    position_gaps: str = "preserve"
    #: Words and their frequencies, for the tokenizer "dictionary".
    dictionary: tuple[tuple[str, int], ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "dictionary", tuple(sorted((check_word(w), int(n)) for w, n in self.dictionary)))
        allowed = {
            "tokenizer": ("unicode", "whitespace", "dictionary"), "case_folding": ("fold", "preserve"), "accent_folding": ("fold", "preserve"),
            "long_tokens": ("split", "truncate", "discard"), "graphemes": ("emoji", "retain", "discard"), "position_gaps": ("preserve", "collapse"),
        }
        for name, values in allowed.items():
            if getattr(self, name) not in values:
                raise AnalysisError(f"{name} must be one of {', '.join(values)}, not {getattr(self, name)!r}")
        if not 4 <= self.max_token_bytes <= 2692:
            raise AnalysisError("max_token_bytes must be between 4 and 2692")

    def to_dict(self) -> dict:
        return asdict(self) | {"dictionary": [list(x) for x in self.dictionary]}

    def with_words(self, words: dict[str, int | None]) -> AnalyzerSpec:
        """Adds words to the dictionary, or with None takes them out; an index keeps the dictionary it was built with."""
        held = dict(self.dictionary) | words
        return replace(self, dictionary=tuple((w, n) for w, n in held.items() if n is not None))

    def fingerprint(self) -> str:
        """Equal for specs that give the same tokens."""
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True).encode()).hexdigest()[:16]


_WORD_BREAK = regex.compile(r"(?V1w)\b")
_GRAPHEME = regex.compile(r"\X")
_ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]")
_MARK = regex.compile(r"\p{M}+")
_SYMBOL = regex.compile(r"\p{S}")
_BARRED = regex.compile(r"[\p{P}\p{Z}\p{C}]")
_QUOTES = {0x27: ".", 0x2019: "."}
_JOINERS = "\u200d\ufe0e\ufe0f"
_EMOJI = regex.compile(r"(?:\p{Extended_Pictographic}|\p{Emoji_Presentation}|\p{Regional_Indicator}{2}|[0-9#*]\ufe0f?\u20e3)")


def _is_emoji(g: str) -> bool:
    return not g.isascii() and _EMOJI.match(g) is not None


# Texts of ASCII and Latin letters: one pattern finds their words, in the JVM as here.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_PLAIN = "^[\u0000-\u007f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*$"
_RUN = f"[{_LETTERS}0-9_]++"
_TOKEN = rf"{_RUN}(?:(?:(?<=[{_LETTERS}])[.:'](?=[{_LETTERS}])|(?<=[0-9])[.,;'](?=[0-9])){_RUN})*+"
_IS_PLAIN, _PLAIN_TOKEN, _PLAIN_WORD = re.compile(_PLAIN[:-1] + r"\Z"), re.compile(_TOKEN), re.compile(f"[{_LETTERS}0-9]")


_HAN = regex.compile(r"\p{Han}+")
_SPACES = np.array([i for i in range(0x3001) if chr(i).isspace()], np.uint32)
PIECE = 1 << 20  # characters of texts whose tokens are held in Python at a time
KNOWN = 1 << 16  # words whose folded forms an analyzer holds


class Analyzer:
    def __init__(self, spec: AnalyzerSpec | None = None):
        self.spec = spec or AnalyzerSpec()
        words = dict(self.spec.dictionary)
        total = max(1, sum(words.values()))
        self.cost = {w: math.log(total / max(1, n)) for w, n in words.items()}
        self.strange = math.log(total) + 1  # of a character that is no word, above any word's
        self.longest = max(map(len, words), default=1)
        self.known: dict[str, list[str]] = {}
        self.one: dict[str, str] = {}

    def tokens(self, text: str) -> list[Token]:
        return [Token(*x) for x in self.found(text)]

    def found(self, text: str) -> list[tuple[str, int, int, int, str, bool]]:
        """The tokens as plain tuples, in the order of Token."""
        spec = self.spec
        raw = {"unicode": self._unicode, "whitespace": self._whitespace, "dictionary": self._dictionary}[spec.tokenizer](text)
        known, keep, out, shift = self.known, spec.position_gaps == "preserve", [], 0
        for pos, (word, start, end, kind) in enumerate(raw):
            pieces = known.get(word)
            if pieces is None:
                pieces = self._pieces(word)
                if len(known) < KNOWN and len(word) <= 64:
                    known[word] = pieces
            for k, piece in enumerate(pieces):
                shift += k > 0
                out.append((piece, pos + shift if keep else len(out), start, end, kind, len(pieces) > 1))
        return out

    def words(self, text: str) -> tuple[list[str], list[int] | range]:
        """The tokens' texts and positions."""
        whole = self.whole(text)
        if whole is None:
            found = self.found(text)
            return [x[0] for x in found], [x[1] for x in found]
        if "" not in whole:
            return whole, range(len(whole))
        at = [i for i, x in enumerate(whole) if x]
        return [whole[i] for i in at], at if self.spec.position_gaps == "preserve" else range(len(at))

    def whole(self, text: str) -> list[str] | None:
        """Of each word of a text its token, empty if it has none; None where one pattern doesn't find the words or a word becomes several."""
        spec, ascii_text = self.spec, text.isascii()
        by_space = spec.tokenizer == "whitespace"
        if not by_space and (spec.graphemes == "retain" or not (ascii_text or _IS_PLAIN.match(text))):
            return None
        if ascii_text or (_IS_PLAIN.match(text) if by_space else not _odd(spec).search(text)):  # folding leaves the words' bounds
            folded = self.fold(text)
            words = folded.split() if by_space else self._plain_words(folded)
            longest, most = max(map(len, words), default=0), spec.max_token_bytes
            if longest <= (most if ascii_text else most // 4):
                return words
            if ascii_text and spec.long_tokens != "split":
                return [x if len(x) <= most else x[:most] if spec.long_tokens == "truncate" else "" for x in words]
        words = text.split() if by_space else self._plain_words(text)
        out = list(map(self.one.get, words))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    if len(pieces := self._pieces(words[i])) > 1:
                        return None
                    out[i] = pieces[0] if pieces else ""
                    if len(self.one) < KNOWN and len(words[i]) <= 64:
                        self.one[words[i]] = out[i]
        return out

    @staticmethod
    def _plain_words(text: str) -> list[str]:
        found = _PLAIN_TOKEN.findall(text)
        return [x for x in found if "_" not in x or _PLAIN_WORD.search(x)] if "_" in text else found

    def _pieces(self, word: str) -> list[str]:
        """What a word's token becomes: folded, and cut where it is too long."""
        folded, most = self.fold(word), self.spec.max_token_bytes
        if not folded:
            return []
        if len(folded.encode()) <= most:
            return [folded]
        if self.spec.long_tokens == "discard":
            return []
        if self.spec.long_tokens == "truncate":
            return [x for x in [self._cut(folded, most)] if x]
        return self._split(folded, most)

    def terms(self, text: str) -> list[str]:
        return self.words(text)[0]

    def fold(self, word: str) -> str:
        spec = self.spec
        if spec.case_folding == "fold":
            word = word.replace("\u03a3", "\u03c3").lower()  # so that no sigma is final
        if spec.accent_folding == "fold" and not word.isascii():
            word = unicodedata.normalize("NFC", _MARK.sub("", unicodedata.normalize("NFD", word)))
        return word

    def _whitespace(self, text: str):
        return [(m[0], m.start(), m.end(), "unknown") for m in re.finditer(r"\S+", text)]

    def _dictionary(self, text: str):
        """Runs of Han characters cut into words of the dictionary, by the likeliest path of a unigram lattice; other text as by `unicode`."""
        out, at = [], 0
        for m in _HAN.finditer(text):
            out += [(w, a + at, b + at, kind) for w, a, b, kind in self._unicode(text[at:m.start()])]
            at = m.end()
            out += [(text[a:b], a, b, "word") for a, b in self._cheapest(text, m.start(), at)]
        return out + [(w, a + at, b + at, kind) for w, a, b, kind in self._unicode(text[at:])]

    def _cheapest(self, text: str, lo: int, hi: int) -> list[tuple[int, int]]:
        best = [(0.0, lo)] + [(math.inf, lo)] * (hi - lo)
        for i in range(lo, hi):
            so_far = best[i - lo][0]
            for j in range(i + 1, min(hi, i + self.longest) + 1):
                cost = self.cost.get(text[i:j], self.strange if j == i + 1 else None)
                if cost is not None and so_far + cost < best[j - lo][0]:
                    best[j - lo] = (so_far + cost, i)
        cuts = [hi]
        while cuts[-1] > lo:
            cuts.append(best[cuts[-1] - lo][1])
        cuts.reverse()
        return list(zip(cuts, cuts[1:]))

    def _unicode(self, text: str):
        mode, out, gap = self.spec.graphemes, [], 0
        if mode != "retain" and _IS_PLAIN.match(text):
            found = ((m[0], m.start(), m.end(), "word") for m in _PLAIN_TOKEN.finditer(text))
            return [x for x in found if "_" not in x[0] or _PLAIN_WORD.search(x[0])]
        # Apostrophes join as full stops do; the library's rule for vowels behind them isn't Unicode's.
        bounds = [m.start() for m in _WORD_BREAK.finditer(text.translate(_QUOTES))]
        if not bounds or bounds[0] != 0:
            bounds.insert(0, 0)
        if bounds[-1] != len(text):
            bounds.append(len(text))

        def marks(lo: int, hi: int):
            if mode == "discard" or lo >= hi or mode == "emoji" and text[lo:hi].isascii():
                return
            for m in _GRAPHEME.finditer(text, lo, hi):
                g = m[0].strip()
                if g and (kind := self._grapheme(g)):
                    at = m.start() + m[0].index(g)
                    yield g, at, at + len(g), kind

        for lo, hi in zip(bounds, bounds[1:]):
            piece = text[lo:hi]
            if not _ALNUM.search(piece):
                continue
            word = piece.strip()
            start = lo + piece.index(word)
            out += marks(gap, start)
            kind = "emoji" if mode != "discard" and word[0] in "0123456789" and _is_emoji(word) else "word"
            out.append((word, start, start + len(word), kind))
            gap = hi
        out += marks(gap, len(text))
        return out

    def _grapheme(self, g: str) -> str | None:
        if _is_emoji(g):
            return "emoji"
        if self.spec.graphemes == "emoji":
            return None
        kept = [c for c in g if c not in _JOINERS]
        if any(_BARRED.match(c) for c in kept):
            return None
        if any(_SYMBOL.match(c) for c in kept):
            return "symbol"
        return "grapheme" if any(_MARK.match(c) for c in kept) else None

    @staticmethod
    def _cut(s: str, most: int) -> str:
        return s.encode()[:most].decode(errors="ignore")

    def _split(self, s: str, most: int) -> list[str]:
        """Chunks of at most `most` bytes at grapheme borders; a larger grapheme is cut at a character."""
        out, held, size = [], "", 0
        for m in _GRAPHEME.finditer(s):
            g = m[0]
            n = len(g.encode())
            if size + n > most and held:
                out.append(held)
                held, size = "", 0
            while n > most:
                part = self._cut(g, most)
                out.append(part)
                g = g[len(part):]
                n = len(g.encode())
            held, size = held + g, size + n
        return out + [held] if held else out


def _latin_map(spec: AnalyzerSpec) -> tuple[str, str, str]:
    """Characters, what they fold to, and those that fold to several."""
    fold = Analyzer(spec).fold
    chars = [chr(c) for c in (*range(0xC0, 0x180),) if c not in (0xD7, 0xF7)]
    pairs = [(c, fold(c)) for c in chars]
    odd = "".join(c for c, f in pairs if len(f) != 1)
    pairs = [(c, f) for c, f in pairs if c != f and len(f) == 1]
    return "".join(c for c, _ in pairs), "".join(f for _, f in pairs), odd


@lru_cache(64)
def _odd(spec: AnalyzerSpec) -> re.Pattern:
    odd = _latin_map(spec)[2]
    return re.compile(f"[{odd}]" if odd else "(?!)")


def latin_words(text: Column, spec: AnalyzerSpec) -> Column | None:
    """array<string>: the tokens of a text of ASCII and Latin letters, by built-in functions; None if the options need the general way."""
    if spec.tokenizer != "unicode" or spec.graphemes == "retain":
        return None
    chars, folded, _ = _latin_map(spec)
    lowered = text if spec.case_folding == "preserve" else F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ascii_text = F.lower(text) if spec.case_folding == "fold" else text
    clean = F.when(F.octet_length(text) == F.char_length(text), ascii_text).otherwise(F.translate(lowered, chars, folded) if chars else lowered)
    found = F.regexp_extract_all(clean, F.lit(_TOKEN), F.lit(0))
    return F.when(F.contains(text, F.lit("_")), F.filter(found, lambda t: t.rlike(rf"[{_LETTERS}0-9]"))).otherwise(found)


def is_latin(text: Column, words: Column, spec: AnalyzerSpec) -> Column:
    """Whether latin_words (given as words) are the tokens of a text: it has no other letters and no word that may be too long."""
    odd = _latin_map(spec)[2]
    plain = text.rlike(_PLAIN) & ~F.exists(words, lambda t: F.char_length(t) > spec.max_token_bytes // 4)
    return plain & ~text.rlike(f"[{odd}]") if odd else plain


def _lists(texts: pa.Array, columns: dict[str, pa.DataType], fill) -> Iterator[pa.Array]:
    """Lists of structs of a batch of texts, in pieces of limited size: fill(text, held) adds a text's values to the columns held."""
    def done():
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(held[c], t) for c, t in columns.items()], names=list(columns)))

    held, ends, seen, count = {c: [] for c in columns}, [0], 0, 0
    for text in texts:
        text = text.as_py()
        if text is None:
            ends[-1] = None
        else:
            fill(text, held)
            count = len(next(iter(held.values())))
            seen += len(text)
        ends.append(count)
        if seen >= PIECE:
            yield done()
            held, ends, seen, count = {c: [] for c in columns}, [0], 0, 0
    if len(ends) > 1:
        yield done()


def _byte_places(text: str) -> np.ndarray:
    """Of each character and of the end, the place in UTF-8 bytes."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000).astype(np.int64))])


def token_spans(text: Column, spec: AnalyzerSpec | None = None) -> Column:
    """array<struct<text, pos, start, end, kind>>: tokens with their places in the text, in UTF-8 bytes, ends exclusive."""
    ship_active()
    analyzer = Analyzer(spec)
    columns = {"text": pa.string(), "pos": pa.int32(), "start": pa.int32(), "end": pa.int32(), "kind": pa.string()}

    def fill(t, held):
        whole = analyzer.whole(t) if analyzer.spec.tokenizer == "whitespace" else None
        if whole is not None and "" not in whole:  # the usual case, by whole columns
            chars = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            inside = np.concatenate([[False], ~np.isin(chars, _SPACES), [False]])
            lo, hi = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
            columns = whole, range(len(whole)), lo, hi, ["unknown"] * len(whole)
        else:
            columns = tuple(zip(*(x[:5] for x in analyzer.found(t)))) or ((),) * 5
        at = None if t.isascii() else _byte_places(t)
        for name, values in zip(held, columns):
            held[name] += values if name not in ("start", "end") else np.asarray(values, np.int64).tolist() if at is None else at[np.asarray(values, np.int64)].tolist()

    @F.arrow_udf("array<struct<text: string, pos: int, start: int, end: int, kind: string>>")
    def places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from _lists(texts, columns, fill)

    return places(text)


def token_column(text: Column, spec: AnalyzerSpec | None = None) -> Column:
    """array<struct<text string, pos int>> of a text column; null where the text is."""
    ship_active()
    spec = spec or AnalyzerSpec()
    analyzer = Analyzer(spec)

    def fill(t, held):
        words, at = analyzer.words(t)
        held["text"] += words
        held["pos"] += at

    @F.arrow_udf("array<struct<text: string, pos: int>>")
    def general(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from _lists(texts, {"text": pa.string(), "pos": pa.int32()}, fill)

    words = latin_words(text, spec)
    if words is None:
        return general(text)
    plain = is_latin(text, words, spec)
    native = F.transform(words, lambda t, i: F.struct(t.alias("text"), i.alias("pos")))
    return F.when(plain, native).otherwise(general(F.when(plain, F.lit(None).cast("string")).otherwise(text)))


def token_count(text: Column, spec: AnalyzerSpec) -> Column:
    """Tokens of a text, counted one text at a time; null where the text is."""
    ship_active()
    analyzer = Analyzer(spec)

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array((None if (t := x.as_py()) is None else len(analyzer.words(t)[0]) for x in texts), pa.int32())

    return count(text)


def builtin_stop_words(preset: str) -> list[str]:
    """Function words of a preset: zh, en or auto (both)."""
    from spanlake.functions.stopwords import EN, ZH

    sets = {"en": EN, "zh": ZH, "auto": ZH + EN}
    if preset.lower() not in sets:
        raise AnalysisError("unknown stop-word preset; expected zh, en, or auto")
    return list(sets[preset.lower()])
