"""URL filters: path rules on hosts, and gradient-boosted trees on lexical features.

Rules decide first; elsewhere the trees' score does.  Features are Column
expressions; the fitted trees become one too.  Suffix statistics are counted over
all labelled URLs and joined by suffix, whatever their number.  The fit takes a
bounded hash sample of labelled URLs to the driver.

Labels come from a table (url, label).  The tables at hand label no URLs; for them
op2_url_filter falls back to public category words in host names (seed_labels), which
the trees never see.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import fold_case, look_up, settle, table

RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Words of public category lists; a host label made of them (by hyphens) is taken for unwanted.
SEED_WORDS = ("adult", "bet", "bets", "betting", "casino", "escort", "gambling", "loan", "loans", "payday", "pharma", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "viagra", "warez", "xxx")
FEATURES = (
    "url_bytes", "host_bytes", "path_bytes", "labels", "depth", "digit_ratio", "host_digits", "hyphens", "host_hyphens", "entropy",
    "vowel_ratio", "parameters", "fragment", "longest_label", "suffix",
)
BROADCAST_ROWS = 200_000
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end; A-Z lower-cased; empty without ://."""
    return fold_case(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the host or a parent of it and whose path begins the path; else null."""
    rule = verdict = None
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # so the longest is tested first
        at = text.find("/") if "/" in text else len(text)
        own, start = text[:at], text[at:]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start) & (host != "")
        rule = F.when(fits, F.lit(text)).otherwise(F.lit(None).cast("string") if rule is None else rule)
        verdict = F.when(fits, F.lit(what)).otherwise(F.lit(None).cast("string") if verdict is None else verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def lexical(urls: DataFrame) -> DataFrame:
    """urls: url, host, path, stat and more -> with x, the feature array.  Null urls count as empty."""
    url = F.coalesce("url", F.lit(""))
    host, path = F.col("host"), F.col("path")
    size = lambda c: F.char_length(c).cast("double")
    count = lambda c, pattern: size(F.regexp_replace(c, f"[^{pattern}]", ""))
    share = lambda c, pattern: F.coalesce(count(c, pattern) / F.nullif(size(c), F.lit(0.0)), F.lit(0.0))
    letters = F.split(host, "")
    parts = F.transform(F.array_distinct(letters), lambda a: F.size(F.filter(letters, lambda b: b == a)) / F.size(letters))
    entropy = F.when(host == "", 0.0).otherwise(F.aggregate(parts, F.lit(0.0), lambda s, p: s - p * F.log2(p)))
    labels = F.split(host, r"\.")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    x = [
        size(url), size(host), size(path), F.size(labels).cast("double"), count(path, "/"), share(url, "0-9"), count(host, "0-9"), count(url, r"\-_"),
        count(host, r"\-"), entropy, share(host, "aeiou"), F.when(query == "", 0.0).otherwise(count(query, "&") + 1), F.contains(url, F.lit("#")).cast("double"),
        F.array_max(F.transform(labels, F.char_length)).cast("double"), F.col("stat"),
    ]
    return urls.withColumn("x", F.array(*x))


class Trees:
    """Depth-limited regression trees as (feature, threshold, left, right) tuples or leaf values."""

    def __init__(self, bias: float, trees: list):
        self.bias, self.trees = bias, trees

    def column(self, x: Column) -> Column:
        def node(t):
            return F.lit(float(t)) if not isinstance(t, tuple) else F.when(F.get(x, F.lit(t[0])) <= t[1], node(t[2])).otherwise(node(t[3]))

        z = F.lit(self.bias)
        for t in self.trees:
            z = z + node(t)
        return 1 / (1 + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        def node(t, r):
            return t if not isinstance(t, tuple) else node(t[2] if r[t[0]] <= t[1] else t[3], r)

        return np.array([1 / (1 + np.exp(-(self.bias + sum(node(t, r) for t in self.trees)))) for r in x])


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, l2: float = 1.0, max_bins: int = 32, least: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss; without both labels the trees are none."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    out = Trees(float(np.log(share / (1 - share))), [])
    if not len(y) or y.min() == y.max():
        return out
    cuts = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        mid = (v[1:] + v[:-1]) / 2
        cuts.append(mid if len(mid) < max_bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, max_bins + 1)[1:-1])))
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    z = np.full(len(y), out.bias)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-z))
        g, h = y - q, q * (1 - q)
        step = np.zeros(len(y))

        def grow(rows, level):
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            if level < depth:
                for j, c in enumerate(cuts):
                    if len(c):
                        a, b = np.bincount(bins[rows, j], g[rows], len(c) + 1).cumsum()[:-1], np.bincount(bins[rows, j], h[rows], len(c) + 1).cumsum()[:-1]
                        gain = a ** 2 / (b + l2) + (gs - a) ** 2 / (hs - b + l2) - gs ** 2 / (hs + l2)
                        gain[(b < least) | (hs - b < least)] = 0
                        i = int(gain.argmax())
                        if gain[i] > best[0]:
                            best = (float(gain[i]), (j, i))
            if best[1] is None:
                value = float(rate * gs / (hs + l2))
                step[rows] = value
                return value
            j, i = best[1]
            low = bins[rows, j] <= i
            return (j, float(cuts[j][i]), grow(rows[low], level + 1), grow(rows[~low], level + 1))

        tree = grow(np.arange(len(y)), 0)
        if not isinstance(tree, tuple):
            break
        out.trees.append(tree)
        z += step
    return out


def seed_labels(urls: DataFrame) -> DataFrame:
    """url, label: 1 where a host label has a seed word between hyphens or alone, else 0."""
    seed = rf"(^|[.\-])({'|'.join(SEED_WORDS)})([.\-]|$)"
    return urls.where("url IS NOT NULL").select("url", host_of(F.col("url")).rlike(seed).cast("int").alias("label"))


class UrlModel:
    """Trees, and for suffixes the share of label 1 (table suffix, ones, n), drawn to the prior by `weight` URLs."""

    def __init__(self, trees: Trees, suffixes: DataFrame, prior: float, weight: float = 10.0):
        self.trees, self.suffixes, self.prior, self.weight = trees, suffixes, prior, weight

    def stat(self, less: Column | None = None) -> Column:
        """The smoothed share; less: an URL's own label, which is left out."""
        ones, n = (F.coalesce(F.col(c), F.lit(0)) for c in ("ones", "n"))
        if less is not None:
            ones, n = ones - less, n - 1
        return (ones + self.weight * self.prior) / (n + self.weight)

    def looked_up(self, urls: DataFrame) -> DataFrame:
        """urls with a column host -> with ones and n of its suffix; null where it isn't known."""
        of = urls.withColumn("suffix", suffix_of(F.col("host")))
        if self.suffixes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            return of.join(F.broadcast(self.suffixes), "suffix", "left")
        known = look_up(of, self.suffixes.withColumnRenamed("n", "size").select("suffix", "ones", "size"), ["suffix"], "size").withColumnRenamed("size", "n")
        other = of.join(self.suffixes.select("suffix"), "suffix", "left_anti").select("*", F.lit(None).cast("long").alias("ones"), F.lit(None).cast("long").alias("n"))
        return known.unionByName(other)


def train(labelled: DataFrame, max_rows: int = 10_000) -> UrlModel:
    """labelled: url, label.  Suffixes are counted over all distinct URLs, the trees are fitted on at most max_rows, by the order of a hash.

    Null URLs and labels are left out; an URL labelled twice counts once, with the larger label.
    """
    rows = settle(
        labelled.where("url IS NOT NULL AND label IS NOT NULL").groupBy("url").agg(F.max("label").cast("int").alias("label"))
        .select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label"), "labelled"
    )
    suffixes = settle(rows.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(F.sum("label").alias("ones"), F.count("*").alias("n")), "suffixes")
    total = suffixes.agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")).first()
    model = UrlModel(Trees(0.0, []), suffixes, ((total["ones"] or 0) + 0.5) / ((total["n"] or 0) + 1))
    some = rows.orderBy(F.xxhash64("url"), "url").limit(max_rows)
    got = lexical(model.looked_up(some).withColumn("stat", model.stat(F.col("label")))).select("x", "label", "url").collect()
    got.sort(key=lambda r: r["url"])
    model.trees = boost(np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["label"] for r in got], float))
    return model


def judge(pages: DataFrame, model: UrlModel, rules=RULES, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score.

    A null URL, or one without ://, has empty host and path, fits no rule and is
    judged by the trees.  Repeated rows give repeated rows, null ids stay, an empty
    table gives an empty result; further columns are ignored.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    scored = lexical(model.looked_up(urls).withColumn("stat", model.stat())).select("page_id", "host", "path", model.trees.column(F.col("x")).alias("score"))
    return scored.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score"
    )


def op2_url_filter(spark, sf_dir):
    """Trained on the fallback labels: no table labels URLs."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, train(seed_labels(pages)))
