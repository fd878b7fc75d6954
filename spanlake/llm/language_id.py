"""Language ID by segmentation-marginalised unigrams.

Every language has probabilities of the pieces of one fixed public vocabulary.  A
word's probability is the sum over all its segmentations into pieces, by the
forward algorithm; a text's is the product over its words.  Piece probabilities
are learnt by expectation maximisation: forward and backward sums give every
piece's expected count under all segmentations of the training words.

A character that begins no piece is a piece of its own, of a small probability.
Words are runs of letters, lower-cased.  Those above `LONGEST` characters are summed
one by one, with rescaling; the sum is over all segmentations all the same.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import bucket_of, id_text, parts_of, table

WORDS = re.compile(r"[^\W\d_]+")
LETTERS = regex.compile(r"\p{L}+")
LONGEST = 32
CELLS = 3_000_000  # numbers of a table of sums that is held at once
STEP = 50_000  # characters of a long run whose pieces are held at once
START = "▁"


def words_of(text: str) -> list[str]:
    low = text.lower()
    out = WORDS.findall(low)
    return out if not out or "".join(out).isalpha() else LETTERS.findall(low)  # numerals such as ½ and Ⅷ are no letters


def load_pieces(path: str | None = None) -> list[str]:
    """Lower-case pieces of letters (a word start counts as one) of a public sentencepiece vocabulary."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(p for p in pieces if re.fullmatch(f"{START}?[^\\W\\d_]*", p) and p)


class Lattice:
    """Finds all pieces in words by a vectorised walk of a trie, and sums over their segmentations."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        nodes, last = {}, {}
        for i, p in enumerate(pieces):
            at = 0
            for c in p:
                at = nodes.setdefault((at, ord(c)), len(nodes) + 1)
            last[at] = i
        keys = np.array([(a << 21) | c for a, c in nodes], np.int64)
        order = keys.argsort()
        self.keys, self.child = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self.piece = np.full(len(nodes) + 1, -1, np.int64)
        for at, i in last.items():
            self.piece[at] = i
        self.unknown = len(pieces)
        self.deepest = max(map(len, pieces), default=1)

    def _walk(self, c: np.ndarray, limit: np.ndarray):
        """(place, length, piece) of all matches in an array of characters, of which limit are left from a place on."""
        at, node, out = np.arange(len(c)), np.zeros(len(c), np.int64), []
        k = 0
        while len(at):
            key = node << 21 | c[at + k]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[i] == key
            at, node = at[hit], self.child[i[hit]]
            k += 1
            found = self.piece[node]
            good = found >= 0
            if k == 1:
                lone = np.ones(len(c), bool)
                lone[at[good]] = False
                lone = np.flatnonzero(lone)
                out.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), self.unknown)))
            out.append((at[good], np.full(int(good.sum()), k), found[good]))
            more = limit[at] > k
            at, node = at[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*out))

    def matches(self, words: list[str]):
        """(word, start, end, piece) of all matches, and the words' lengths; places count the word start as one character."""
        size = np.array([len(w) + 1 for w in words], np.int64)
        c = np.frombuffer("".join(START + w for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.concatenate([[0], size.cumsum()])[:-1]
        word = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(c)) - first[word]
        at, k, piece = self._walk(c, size[word] - place)
        return word[at], place[at], place[at] + k, piece, size

    def _steps(self, word: str):
        """For each place of a long word, in order: the lengths and the pieces of the matches that begin there."""
        c = np.frombuffer((START + word).encode("utf-32-le"), np.uint32).astype(np.int64)
        for lo in range(0, len(c), STEP):
            part = c[lo:lo + STEP + self.deepest]
            at, k, piece = self._walk(part, len(part) - np.arange(len(part)))
            order = np.argsort(at, kind="stable")
            at, k, piece = at[order], k[order], piece[order]
            own = min(STEP, len(c) - lo)
            cut = np.searchsorted(at, np.arange(own + 1))
            for i in range(own):
                yield k[cut[i]:cut[i + 1]], piece[cut[i]:cut[i + 1]]

    def long_forward(self, word: str, probs: np.ndarray) -> np.ndarray:
        """log P(word | language) of one word of any length; sums of the last few places only are held, and rescaled."""
        size = self.deepest + 1
        ring, log = np.zeros((size, probs.shape[1])), np.zeros(probs.shape[1])
        ring[0] = 1
        for s, (k, piece) in enumerate(self._steps(word)):
            here = ring[s % size].copy()
            ring[s % size] = 0
            ring[(s + k) % size] += here * probs[piece]
            if s % 16 == 15:
                most = ring.max(axis=0)
                ring /= most
                log += np.log(most)
        return np.log(ring[(len(word) + 1) % size]) + log

    def long_expected(self, word: str, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, their expected counts) of one word of any length, by logarithms."""
        log = np.log(p).tolist()
        steps = [(k.tolist(), piece.tolist()) for k, piece in self._steps(word)]

        def add(x, y):
            return y if x == -math.inf else x if y == -math.inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))

        n = len(steps)
        ahead, behind = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        ahead[0] = behind[n] = 0.0
        for s, (ks, qs) in enumerate(steps):
            for k, q in zip(ks, qs):
                ahead[s + k] = add(ahead[s + k], ahead[s] + log[q])
        for s in range(n - 1, -1, -1):
            for k, q in zip(*steps[s]):
                behind[s] = add(behind[s], behind[s + k] + log[q])
        got = [(q, math.exp(ahead[s] + log[q] + behind[s + k] - ahead[n])) for s, (ks, qs) in enumerate(steps) for k, q in zip(ks, qs)]
        return np.array([q for q, _ in got]), np.array([x for _, x in got])

    @staticmethod
    def _sweep(word, frm, to, p, n_words, width, begin):
        """Sums over paths: total[w, to] += total[w, frm] * p, in order of `to` as given by groups."""
        total = np.zeros((n_words, width, p.shape[1]))
        total[np.arange(n_words), begin] = 1
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(width + 1))
        return total, order, cut

    def forward(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """log P(word | language), one row per word; probs: pieces (the last: unknown) x languages."""
        out = np.zeros((len(words), probs.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) <= LONGEST]
        if len(short) < len(words):
            out[short] = self.forward([words[i] for i in short], probs)
            for i in (i for i, w in enumerate(words) if len(w) > LONGEST):
                out[i] = self.long_forward(words[i], probs)
            return out
        step = max(1, CELLS // ((LONGEST + 2) * max(1, probs.shape[1])))
        for lo in range(0, len(words), step):
            part = words[lo:lo + step]
            word, a, b, piece, size = self.matches(part)
            width = int(size.max()) + 1
            total, order, cut = self._sweep(word, a, b, probs, len(part), width, 0)
            for e in range(1, width):
                i = order[cut[e]:cut[e + 1]]
                if len(i):
                    gain = total[word[i], a[i]] * probs[piece[i]]
                    for k in range(probs.shape[1]):
                        total[:, e, k] += np.bincount(word[i], gain[:, k], len(part))
            out[lo:lo + len(part)] = np.log(np.maximum(total[np.arange(len(part)), size], 1e-300))
        return out

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces over all segmentations of the words, each counts[i] times; p: one language's."""
        sums = np.zeros(len(p))
        short = [i for i, w in enumerate(words) if len(w) <= LONGEST]
        if len(short) < len(words):
            for i in (i for i, w in enumerate(words) if len(w) > LONGEST):
                piece, got = self.long_expected(words[i], p)
                np.add.at(sums, piece, got * counts[i])
            words, counts = [words[i] for i in short], counts[short]
        for lo in range(0, len(words), 20_000):
            part, n = words[lo:lo + 20_000], counts[lo:lo + 20_000]
            word, a, b, piece, size = self.matches(part)
            width, q = int(size.max()) + 1, p[piece]
            alpha, order, cut = self._sweep(word, a, b, p[:, None], len(part), width, 0)
            alpha = alpha[:, :, 0]
            for e in range(1, width):
                i = order[cut[e]:cut[e + 1]]
                alpha[:, e] += np.bincount(word[i], alpha[word[i], a[i]] * q[i], len(part))
            beta = np.zeros_like(alpha)
            beta[np.arange(len(part)), size] = 1
            order = np.argsort(a, kind="stable")
            cut = np.searchsorted(a[order], np.arange(width + 1))
            for s in range(width - 1, -1, -1):
                i = order[cut[s]:cut[s + 1]]
                beta[:, s] += np.bincount(word[i], q[i] * beta[word[i], b[i]], len(part))
            whole = np.maximum(alpha[np.arange(len(part)), size], 1e-300)
            sums += np.bincount(piece, n[word] * alpha[word, a] * q * beta[word, b] / whole[word], len(p))
        return sums


class Model:
    def __init__(self, langs: list[str], lattice: Lattice, probs: np.ndarray, prior: np.ndarray):
        self.langs, self.lattice, self.probs, self.prior = langs, lattice, probs, prior
        self.at, self.rows = {}, np.zeros((0, len(langs)))

    def __getstate__(self):
        return {**self.__dict__, "at": {}, "rows": np.zeros((0, len(self.langs)))}

    def learn(self, words: set[str]) -> None:
        if len(self.at) * max(1, len(self.langs)) > CELLS:
            self.at, self.rows = {}, self.rows[:0]
        new = [w for w in words if w not in self.at]
        if new:
            n = len(self.at)
            self.at.update((w, n + i) for i, w in enumerate(new))
            self.rows = np.concatenate([self.rows[:n], self.lattice.forward(new, self.probs)])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and posterior of each text; `und` and 0 without a letter or without languages."""
        lists = [words_of(t or "") for t in texts]
        if self.langs:
            self.learn(set().union(*lists))
        names, scores, at = [], [], self.at.__getitem__
        for words in lists:
            if not words or not self.langs:
                names.append("und")
                scores.append(0.0)
                continue
            z = self.rows[list(map(at, words))].sum(axis=0) + self.prior
            e = np.exp(z - z.max())
            k = int(z.argmax())
            names.append(self.langs[k])
            scores.append(float(e[k] / e.sum()))
        return names, scores


def maximised(lattice: Lattice, words: list[str], times: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A language's piece probabilities by expectation maximisation, from flat ones."""
    n = len(lattice.pieces) + 1
    p = np.full(n, 1 / n)
    for _ in range(rounds):
        got = lattice.expected(words, times, p) + 0.01
        p = got / got.sum()
    return p


def train(docs: DataFrame, lang_col: str = "lang", keep=None, per_lang: int = 1500, max_langs: int = 2000, path: str | None = None) -> Model:
    """docs: doc_id, text and lang.  Documents a language are counted over all rows, its words over a hash
    sample of some per_lang documents; each language is fitted by the executors on all words of its sample.
    More than max_langs languages are refused: they would not fit the model."""
    spark = docs.sparkSession
    rows = docs.where(F.col(lang_col).isNotNull() & F.col("text").isNotNull() & (F.lit(True) if keep is None else keep)).select("doc_id", F.col(lang_col).alias("lang"), "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()}
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not sizes:
        return Model([], Lattice(["a"]), np.zeros((2, 0)), np.zeros(0))
    rate = spark.createDataFrame([(k, min(1.0, per_lang / n)) for k, n in sizes.items()], "lang string, rate double")
    place = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    lattice = Lattice(load_pieces(path))
    shared = spark.sparkContext.broadcast(lattice)

    def count(batches):
        sums: dict[str, Counter] = {}
        for batch in batches:
            for part in parts_of(batch, "text", 4 << 20, 1_000):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    sums.setdefault(lang, Counter()).update(words_of(text))
        got = [(k, w, n) for k, c in sums.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    def fitted(group: pa.Table) -> pa.Table:  # the words of per_lang documents
        group = group.sort_by("word")
        p = maximised(shared.value, group.column("word").to_pylist(), group.column("n").to_numpy().astype(float))
        return pa.table({"lang": group.column("lang")[:1], "p": pa.array([p.tobytes()], pa.binary())})

    sample = rows.join(F.broadcast(rate), "lang").where(place < F.col("rate")).select("lang", "text")  # max_langs rows at most
    words = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = {r["lang"]: np.frombuffer(bytes(r["p"])) for r in words.groupBy("lang").applyInArrow(fitted, "lang string, p binary").collect()}
    langs = sorted(found)
    prior = np.array([sizes[k] for k in langs], float)
    if not langs:
        return Model([], lattice, np.zeros((len(lattice.pieces) + 1, 0)), prior)
    return Model(langs, lattice, np.stack([found[k] for k in langs], axis=1), np.log(prior / prior.sum()))


def language_id(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row; `und` and 0 where the text is null or has no letter.

    Repeated rows give repeated rows, an empty table an empty one; null ids stay;
    further columns are ignored.
    """
    narrow = id_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for part in (part for batch in batches for part in parts_of(batch, "text", 4 << 20, 1_000)):
            names, scores = m.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns only where crc32(doc_id as text) mod 4 is not 2.

    `und` and score 0 where the text is null or has no letter, or nothing could be
    learnt.  Repeated rows give repeated rows; further columns are ignored.
    """
    model = train(docs.select("doc_id", "text", "lang"), keep=bucket_of("doc_id", 4) != 2)
    return language_id(docs, model).select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_language_id(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"))
