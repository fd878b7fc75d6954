"""Operators that SQL can't express, against plain versions of their definitions on small fixtures."""

import hashlib
import math
import random
import string

import numpy as np
import pytest

from spanlake.llm import decontaminate, quality_gam, secret_scan, toxicity
from tests.llm.test_operators import corpus, docs, held, labels


# ------------------------------------------------------------------ 8 secrets
def slow_base(text):
    """Base spans, character by character."""
    value = set(string.ascii_letters + string.digits + "+/_.=-")

    def assign(i):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            j = i + len(word)
            if text[i:j].isascii() and text[i:j].lower() == word:
                j += text[j:j + 1] in ('"', "'") and j < len(text)
                while text[j:j + 1] == " ":
                    j += 1
                if text[j:j + 1] not in (":", "="):
                    continue
                j += 1
                while text[j:j + 1] == " ":
                    j += 1
                j += text[j:j + 1] in ('"', "'") and j < len(text)
                k = j
                while k < len(text) and text[k] in value:
                    k += 1
                if k > j:
                    return k, k - j >= 12
        return None

    def run(first, allowed, least):
        def at(i):
            if not text.startswith(first, i):
                return None
            j = i + len(first)
            while j < len(text) and text[j] in allowed:
                j += 1
            return (j, j - i >= least) if j > i + len(first) or not first and j > i else None
        return at

    out = []
    for kind, find in enumerate((assign, run("AKIA", set(string.ascii_uppercase + string.digits), 18), run("", set("0123456789abcdef"), 16))):
        i = 0
        while i < len(text):
            got = find(i)
            if got is None:
                i += 1
                continue
            if got[1]:
                out.append((i, kind, got[0]))
            i = got[0]
    return sorted(out)


def test_base_spans(spark):
    r = random.Random(9)
    bits = ["password", "PassWord", "passwd", "secret", "token", "apikey", "API_key", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH1234567", "0123456789abcdef", "deadbeef", "x", "é", "\n", "abcdefghijkl", "-._", "ſecret", "KİA"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 14))) for _ in range(3000)]
    for t in texts:
        assert secret_scan.base_spans(t) == slow_base(t), t
    rows = {x.doc_id: x for x in secret_scan.secret_scan(docs(spark, list(enumerate(texts[:300])))).collect()}
    for i, t in enumerate(texts[:300]):
        spans = slow_base(t)
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        assert rows[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))


# ------------------------------------------------------------------ 4 toxicity
def slow_grams(text):
    """Buckets of a text's n-grams of 3 to 6 characters inside words with their boundaries."""
    out, mask = set(), (1 << 64) - 1
    for w in toxicity.WORDS.findall(text.lower()):
        w = f" {w} "
        for n in toxicity.SIZES:
            for i in range(len(w) - n + 1):
                h = 0
                for c in w[i:i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & mask
                out.add(((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & mask) >> 64 - toxicity.BITS)
    return out


def test_toxicity_features_ratios_and_scores(spark):
    rows, marks = corpus(random.Random(11), 300)
    rows += [(1000, None), (1001, ""), (1002, "12 !!"), (1003, "x" * 200_000), (1004, "snarfle " * 20_000)]
    model = toxicity.train(docs(spark, rows).select("doc_id", "text"), labels(spark, marks))
    grams = [slow_grams(t) for _, t in rows[:300]]
    n = [sum(m[2] == k for m in marks) for k in (0, 1)]
    want = {}
    for b in set().union(*grams):
        a, c = (sum(b in g for g, m in zip(grams, marks) if m[2] == k) for k in (0, 1))
        r = math.log((c + 0.5) / (n[1] + 1)) - math.log((a + 0.5) / (n[0] + 1))
        if a + c >= 3 and abs(r) / math.sqrt(1 / (a + 0.5) + 1 / (c + 0.5)) >= 2.5:
            want[b] = r
    assert sorted(want) == model.buckets.tolist() and len(want) > 5
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    got = {x.doc_id: x.score for x in toxicity.toxicity_scores(docs(spark, rows), model).collect()}
    for i, t in rows:
        z = sum(weight.get(b, 0) for b in slow_grams(t or "")) + model.bias
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9
    assert got[1000] == got[1001] == got[1002] and got[1004] > 0.7 > got[1000]


def test_more_features_than_any_former_cap(spark):
    r = random.Random(12)
    words = ["".join(r.choices(string.ascii_lowercase, k=9)) for _ in range(1500)]
    rows = [(i, " ".join(r.choices(words[:750] if i % 2 else words[750:], k=120))) for i in range(400)]
    model = toxicity.train(docs(spark, rows).select("doc_id", "text"), labels(spark, [(i, 0, i % 2) for i in range(400)]))
    assert len(model.buckets) > 6000


def test_the_cut_parts_labels_best():
    r = np.random.default_rng(3)
    z, y = np.round(r.normal(size=60), 1), (r.random(60) < 0.3).astype(float)
    f1 = lambda c: 2 * y[z > c].sum() / ((z > c).sum() + y.sum())
    assert abs(f1(toxicity.best_cut(z, y)) - max(f1(c) for c in [*(z - 0.05), -9])) < 1e-12
    assert toxicity.best_cut(z, np.zeros(60)) is None


# ------------------------------------------------------------------ 5 quality
def slow_features(text):
    data = text.encode()
    if not data:
        return [0.0] * len(quality_gam.FEATURES)
    n, words = len(data), data.split()
    w = max(1, len(words))
    count = lambda chars: sum(data.count(bytes([c])) for c in chars.encode())
    runs, same = [0], 0
    for a, b in zip(words, words[1:]):
        same += a == b
        runs.append(runs[-1] + 1 if a == b else 0)
    lines = [x for x in data.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    return [
        math.log1p(n), count(string.ascii_uppercase) / n, count(string.digits) / n, count(" \t\n\r") / n, count(",.;?") / w, count("!") / w, count("|") / w,
        count("#$%&*+/<=>@[\\]^_`{}~") / w, sum(b > 127 for b in data) / n, math.log1p(len(words)), (n - count(" \n")) / w, len(set(words)) / w * math.log1p(w), same / w,
        math.log1p(max(runs)), max((words.count(x) for x in set(words)), default=0) / w, math.log1p(len(words) / k), 1 - len(set(lines)) / k,
        sum(not x.endswith((b".", b"!", b"?")) for x in lines) / k,
    ]


def test_quality_features_and_table_scores(spark):
    rows, marks = corpus(random.Random(13), 200)
    r = random.Random(14)
    rows += [(500 + i, "".join(r.choices("ab AB 12 .!?|#~é日\n\t", k=r.randint(0, 200)))) for i in range(100)] + [(700, None), (701, ""), (702, " \n"), (703, "y" * 100_000)]
    model = quality_gam.train(docs(spark, rows).select("doc_id", "text"), labels(spark, marks))
    assert len(model.pairs) == 6
    got = {x.doc_id: x.score for x in quality_gam.quality_scores(docs(spark, rows), model).collect()}
    for i, t in rows:
        x = slow_features(t or "")
        assert np.allclose(quality_gam.features((t or "").encode()), x)
        at = [sum(v >= e for e in edges) for v, edges in zip(quality_gam.features((t or "").encode()), model.edges)]
        z = model.bias + sum(table[b] for table, b in zip(model.tables, at)) + sum(table[at[a], at[b]] for (a, b), table in zip(model.pairs, model.pair_tables))
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9


def test_rows_that_share_a_labelled_id_count_once(spark):
    rows, marks = corpus(random.Random(15), 120)
    once = quality_gam.classify(docs(spark, rows), labels(spark, marks)).where("doc_id < 120").collect()
    more = docs(spark, rows + [rows[5]] * 40)
    sample = quality_gam.labelled_sample(more.select("doc_id", "text"), labels(spark, marks), "quality", 50, quality_gam.F.lit(True))
    assert sample.count() == 50 and sample.groupBy("doc_id").count().where("count > 1").count() == 0
    again = {(x.doc_id, x.score) for x in quality_gam.classify(more, labels(spark, marks)).collect()}
    assert again == {(x.doc_id, x.score) for x in once} and all(x.held_out == held(x.doc_id, 3, 1) for x in once)


# ------------------------------------------------------------------ 7 decontamination
@pytest.mark.parametrize("few", [False, True])
def test_decontamination_of_plain_words(spark, few, monkeypatch):
    """Exactly the documents with enough equal windows at one alignment, whole and partial copies among them."""
    if few:
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 2)
    r = random.Random(16)
    word = lambda: r.choice(["ab", "cd", "ef"])
    items = [[word() for _ in range(r.choice([3, 7, 8, 9, 10, 14, 25]))] for _ in range(14)]
    texts = []
    for _ in range(120):
        t = [word() for _ in range(r.randint(0, 30))]
        if r.random() < 0.6:
            x = r.choice(items)
            a = r.randint(0, len(x))
            t += x[a:a + r.randint(1, len(x))]
        texts.append(t + [word() for _ in range(r.randint(0, 9))])
    want = set()
    for i, t in enumerate(texts):
        for j, x in enumerate(items):
            width = min(8, len(x))
            shifts = [p - q for p in range(len(t) - width + 1) for q in range(len(x) - width + 1) if t[p:p + width] == x[q:q + width]]
            if any(shifts.count(s) >= min(3, len(x) - width + 1) for s in set(shifts)):
                want.add((i, j))
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs(spark, [(i, ", ".join(t)) for i, t in enumerate(texts)]), bench).collect()}
    assert got == want and 5 < len(want) < len(texts) * len(items) / 2


def test_decontamination_of_other_values(spark):
    """Numbers, units and names replaced alike are found, replaced inconsistently are not; a name may grow by a word."""
    item = "the shop of Anna sells 12 kg of rice for 30 dollars and Anna buys 12 kg of flour for the old bakery in town"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [
        (1, item.replace("Anna", "Mary Ann Smith").replace("12", "7.5").replace("30", "1,200")), (2, item.replace("12 kg of rice for 30", "13 kg of rice for 31").replace("Anna buys 12", "Clara buys 14").replace("of Anna", "of Berta")),
        (3, item.replace("kg", "miles")), (4, "the shop of Anna sells 12 kg of rice"), (5, item.upper()), (6, item.replace("Anna", "Anna" + "x" * 5000)), (7, "z" * 100_000), (8, item.replace(" ", "\n")),
    ]
    found = {x.doc_id for x in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert {1, 3, 6} <= found and not {2, 4, 7} & found


def test_decontamination_of_copies_with_an_edited_value(spark):
    item = "the shop of Anna sells 12 kg of rice for 30 dollars and then the old owner writes a long letter about flour and bread to every baker in town before Anna buys 12 kg of flour"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.replace("buys 12", "buys 13")), (2, item.replace("of Anna sells 12 kg of rice for 30", "of Bert sells 13 kg of rice for 31").replace("Anna buys 12", "Carl buys 14").replace("a long letter about flour and bread", "some very short notes on other things")), (3, item.replace("of Anna sells 12 kg of rice for 30", "of Bert sells 13 kg of rice for 31"))]
    assert {x.doc_id for x in decontaminate.contaminated(docs(spark, rows), bench).collect()} == {1, 3}
