"""Benchmark decontamination by templates (DataFrame operations only).

Numbers, units behind numbers and names (runs of capitalised words inside a
sentence) become typed placeholders, one each; every other word is lower-cased.
Windows of `window` template words of the corpus are hash-joined with those of the
benchmark.  Windows at one alignment of a document with an item form a match; its
slots must be consistent: where the item repeats a value the document repeats one,
each item value standing for one document value.  So re-parameterised questions are
caught, and texts that merely share a frame with unrelated fillings are not.  Where
windows with equal values cover half of an item, other values don't matter.

A window of fewer than `min_words` words that aren't placeholders has no frame to go
by.  Items that are short, or have too few windows with a frame, are looked for word
for word: by windows of `window` words, or of the item's own length below that.

Only hashes and places leave the scan of the corpus.  Values of slots are read from
the matched documents afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import settle, table

UNITS = "km|kg|cm|mm|mg|ml|kwh|mph|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|meters?|metres?|grams?|liters?|litres?|inches|feet|dollars?|euros?|cents?|percent|usd|eur"
NAME, END, GLUE, UNIT, NUM = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005"
MARKS = (NAME, UNIT, NUM)
BROADCAST_ROWS = 200_000
WORD = r"[\p{L}\p{N}]"


def _numbered(text: Column, keep: bool) -> Column:
    """Marks before units and numbers; digits that only . or , parts are one number.  Without keep a mark stands for its word."""
    units = F.regexp_replace(text, rf"(?i)(?<=[0-9] ?)(?={UNITS}\b)", " " + UNIT)
    marked = F.regexp_replace(units, r"(?<![\p{L}\p{N}\u0001-\u0005.,])(?=[0-9])", NUM)
    glued = F.regexp_replace(marked, "(?<=[0-9])[.,](?=[0-9])", "")
    return glued if keep else F.regexp_replace(glued, rf"(?<=[{UNIT}{NUM}]){WORD}++", "")


def words(text: Column, keep: bool = True) -> Column:
    """A text's template words: lower-cased words, and placeholders that begin with a mark.  keep: the values follow the marks."""
    name = r"(?<=[\p{L}\p{N},;] )\p{Lu}\p{Ll}\p{L}*+"
    named = F.replace(F.regexp_replace(text, name, f"{NAME}$0{END}" if keep else NAME + END), F.lit(f"{END} {NAME}"), F.lit(GLUE if keep else ""))
    cut = lambda x: F.array_remove(F.split(F.lower(x), "[^\\p{L}\\p{N}\u0001-\u0005]+"), "")
    return F.when(text.rlike("[0-9]"), cut(_numbered(named, keep))).otherwise(cut(named))


def plain_words(text: Column) -> Column:
    """Lower-cased words; digits that only . or , parts are one word."""
    low = F.lower(text)
    cut = lambda x: F.array_remove(F.split(x, r"[^\p{L}\p{N}]+"), "")
    return F.when(low.rlike("[0-9]"), cut(F.regexp_replace(low, "(?<=[0-9])[.,](?=[0-9])", ""))).otherwise(cut(low))


def _hashes(of: Column) -> Column:
    return F.transform(of, lambda w: F.xxhash64(w))


def _is_slot(w: Column) -> Column:
    return F.substring(w, 1, 1).isin(*MARKS)


def _at(place: Column, k: int) -> Column:
    return F.get("c", place + k)


def _windows(rows: DataFrame, window: int, min_words: int) -> DataFrame:
    """rows: key columns and c, hashes of template words -> keys, pos, h, slots: every window with a frame."""
    pos = F.col("pos")
    blanks = [F.xxhash64(F.lit(x)) for x in (NAME + END, UNIT, NUM)]
    slots = sum((_at(pos, k).isin(*blanks).cast("int") for k in range(window)), F.lit(0))
    every = rows.select("*", F.posexplode_outer("c").alias("pos", "first")).where(pos <= F.size("c") - window)  # outer: no filter that would hash all words twice
    return every.withColumn("slots", slots).where(F.col("slots") <= window - min_words).withColumn("h", F.xxhash64(*(_at(pos, k) for k in range(window)))).drop("c", "first")


def _runs(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """rows: key columns and c, hashes of words -> keys, pos, k, h: every run of one of the lengths k."""
    pos = F.col("pos")
    every = rows.select("*", F.posexplode_outer("c").alias("pos", "first"))
    runs = [F.struct(F.lit(k).alias("k"), F.when(pos <= F.size("c") - k, F.xxhash64(F.lit(k), *(_at(pos, i) for i in range(k)))).alias("h")) for k in lengths]
    return every.withColumn("run", F.explode(F.array(*runs))).where("run.h IS NOT NULL").select("*", "run.k", "run.h").drop("c", "first", "run")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it has no more than BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _spread(at: Column | str, width: Column) -> Column:
    """How many words the windows of some width at ascending places cover."""
    return F.aggregate(
        at, F.struct((-width).alias("last"), F.lit(0).alias("n")),
        lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(width, p - s["last"])).alias("n")), lambda s: s["n"],
    )


def _groups(ours: DataFrame, theirs: DataFrame, window: int, min_windows: int) -> DataFrame:
    """Windows of documents that meet those of items, by alignment, where there are enough: doc_id, sig, item_id, size, least, shift, at, slots, n, share."""
    hits = ours.drop("slots").join(_small(theirs), "h").select("doc_id", "sig", "item_id", "size", "least", "width", "slots", (F.col("pos") - F.col("ipos")).alias("shift"), "ipos")
    group = hits.groupBy("doc_id", "sig", "item_id", "size", "least", "width", "shift").agg(F.sort_array(F.collect_set("ipos")).alias("at"), F.max("slots").alias("slots"))  # an item's windows at most
    return group.where(F.size("at") >= F.col("least")).select("doc_id", "sig", "item_id", "size", "least", "shift", "at", "slots", F.size("at").alias("n"), (_spread("at", F.col("width")) / F.col("size")).alias("share"))


def _consistent(found: DataFrame, docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """Of groups with slots, those where each of the item's values stands for one value of the document.

    Or those of which windows with equal values alone are enough and cover half of the
    item: a copy in which single occurrences of values were edited.
    """
    valued = lambda x: F.filter(F.transform(x, lambda w, i: F.struct(i.alias("p"), w.alias("v"))), lambda s: _is_slot(s["v"]))
    theirs = items.select("item_id", valued(words(F.col("text"))).alias("values"))
    held = docs.join(_small(settle(found.select("doc_id", "sig").distinct(), "held")), ["doc_id", "sig"], "left_semi").dropDuplicates(["doc_id", "sig"])
    both = found.join(_small(theirs), "item_id").join(held.select("doc_id", "sig", words(F.col("text")).alias("t")), ["doc_id", "sig"])
    inside = F.filter("values", lambda s: F.exists("at", lambda a: s["p"].between(a, a + window - 1)))
    pairs = F.array_distinct(F.transform(inside, lambda s: F.struct(s["v"].alias("a"), F.get("t", s["p"] + F.col("shift")).alias("b"))))
    other = F.filter("values", lambda s: ~F.get("t", s["p"] + F.col("shift")).eqNullSafe(s["v"]))
    equal = F.filter("at", lambda a: ~F.exists("other", lambda s: s["p"].between(a, a + window - 1)))
    rows = both.withColumn("pairs", pairs).withColumn("other", other).withColumn("equal", equal)
    one_for_one = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x["a"])))
    mostly_equal = (F.size("equal") >= F.col("least")) & (_spread("equal", F.lit(window)) * 2 >= F.col("size"))
    return rows.where(one_for_one | mostly_equal).select(*found.columns)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_words: int = 5, min_windows: int = 3) -> DataFrame:
    """doc_id, item_id, n_windows, item_share: documents that hold min_windows windows of an item at one alignment.

    item_share is the part of the item's words that lie in matched windows.  An item
    that has fewer windows needs all of them; one with fewer than min_windows windows
    with a frame behind its first word is found word for word only.  Null ids and
    texts match nothing, nor do texts without words; repeated rows of a document or an
    item count once, rows that share an id but not the text one by one; either table
    may be empty; further columns are ignored.
    """
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("sig", F.xxhash64("text"))
    framed = settle(_windows(items.select("item_id", _hashes(words(F.col("text"), False)).alias("c")).withColumn("size", F.size("c")), window, min_words).withColumnRenamed("pos", "ipos"), "items")
    enough = framed.where("ipos > 0").groupBy("item_id").agg(F.count_distinct("ipos").alias("k")).where(F.col("k") >= min_windows).select("item_id")
    theirs = framed.withColumn("least", F.least(F.lit(min_windows), F.col("size") - window + 1)).withColumn("width", F.lit(window))
    ours = _windows(docs.select("doc_id", "sig", _hashes(words(F.col("text"), False)).alias("c")), window, min_words)
    found = settle(_groups(ours, theirs, window, min_windows), "found")
    out = found.where("slots = 0")
    if not found.where("slots > 0").isEmpty():
        out = out.unionByName(_consistent(found.where("slots > 0"), docs, items, window))

    whole = settle(items.join(enough, "item_id", "left_anti").select("item_id", _hashes(plain_words(F.col("text"))).alias("c")).withColumn("size", F.size("c")).where("size > 0"), "whole")
    width = F.least(F.lit(window), F.col("size"))
    lengths = sorted(r[0] for r in whole.select(width).distinct().collect())  # window numbers at most
    if lengths:
        theirs = _runs(whole, lengths).withColumnRenamed("pos", "ipos").withColumn("width", width).withColumn("least", F.least(F.lit(min_windows), F.col("size") - width + 1)).withColumn("slots", F.lit(0))
        theirs = settle(theirs.where("k = width"), "runs")
        ours = _runs(docs.select("doc_id", "sig", _hashes(plain_words(F.col("text"))).alias("c")), lengths)
        out = out.unionByName(_groups(ours, theirs, window, min_windows))
    return out.groupBy("doc_id", "item_id").agg(F.max("n").alias("n_windows"), F.round(F.max("share"), 4).alias("item_share"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs (all columns, whatever their names) whose document holds no benchmark item.

    Null ids and null texts stay; rows that share an id stay or go together.
    """
    bad = contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def op7_decontaminate(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
