"""Benchmark decontamination by question templates.

Words lose symbols and case; numbers, units after a number, and names
(capitalised inside a sentence) become typed placeholders. Windows of eight
template words are hash-joined with those of the benchmark. Capitals tell no
names in a text all in capitals, in Title Case or without any, so windows are also joined
blind to case, with names as plain words, and word for word where numbers and
units leave under five plain words. Hits of a document
and item lie on a diagonal (document position less item position). A diagonal
counts as a leak if at least half of the item's windows, or 13 words in a row
at the least, are on it (counted over its template windows with template hits
alone, and over all its windows with hits of every kind) and its slots are consistent: equal values in the item
stand for equal values in the document, and different for different. So a
question with other numbers is caught, and text that only has the form isn't.

An item of fewer than eight words has no window; it is found where a whole line
of a text is the item, word for word and blind to case.

Cases. Null, empty and blank texts and items match nothing. A window with fewer
than five plain words matches only as it is, whatever the case. Very long texts
are searched whole. Rows that share a doc_id, or have none, are judged each by
its own text (told apart by a 128-bit digest, so no doc_id gathers in one task),
and repeated rows alike; leaks() names a doc_id and item once, by the best of its
texts and diagonals. Repeated items report each item_id, null ones too. No rows
or no items: no leaks. Columns beside doc_id and text don't matter to leaks(),
and without_leaks() returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, counted, materialise, same, text_digest, words

WINDOW, PLAIN, SHARE, RUN = 8, 5, 0.5, 13
# Units of measure.
UNITS = ["mm", "cm", "m", "km", "g", "kg", "mg", "lb", "oz", "ml", "l", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "meters", "metres", "miles", "feet", "inches", "dollars", "euros", "cents", "kmh", "mph", "degrees", "percent", "watts", "volts", "joules", "newtons", "liters", "litres", "grams", "kilograms", "kilometers", "kilometres"]


def _kind(c: Column, i: Column) -> Column:
    """The placeholder of a core (a word without outer punctuation), or null; comparisons of strings tell its first character's kind."""
    before, digit = F.get("_core", i - 1), lambda x: (x >= "0") & (x < ":")
    upper = ((c >= "A") & (c < "[")) | ((c >= "\u0080") & (F.substring(c, 1, 1) != F.lower(F.substring(c, 1, 1))))
    inside = (i > 0) & ~F.right(F.get("_words", i - 1), F.lit(1)).isin(".", "!", "?", ":")
    return F.when(digit(c), F.when(c.rlike("^[0-9][0-9.,]*$"), "<number>")).when(digit(before), F.when(F.lower(c).isin(UNITS), "<unit>")).when(upper, F.when(inside, "<name>"))


def _cores(text: Column) -> tuple[Column, Column]:
    """The words without symbols, and without outer punctuation too."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[^\p{{L}}\p{{N}}{SPACE}.,!?:;]+", "")
    # Punctuation that stands alone joins the word before it.
    plain = F.regexp_replace(plain, rf"[{SPACE}]+([.,!?:;])", "$1")
    return words(plain), F.transform(words(plain), lambda w: F.btrim(w, F.lit(".,!?:;")))


def _windows(docs: DataFrame, *key: str) -> DataFrame:
    """The key columns, at, hash, kind of each window, and the values of the text's placeholders by word: _v, and _bv without names.

    kind: t (template), b (names as plain words), l (word for word)."""
    df = docs.select(*key, _cores(F.col("text"))[0].alias("_words")).where(F.size("_words") >= WINDOW)
    df = df.withColumn("_core", F.transform("_words", lambda w: F.btrim(w, F.lit(".,!?:;"))))
    df = df.withColumn("_k", F.transform("_core", _kind)).withColumn("_any", F.exists("_k", lambda k: k.isNotNull()))
    # Upper case folds what lower case doesn't (ß and SS).
    df = df.withColumn("_plain", F.transform("_core", lambda c: F.xxhash64(F.upper(c)))).withColumn("_named", F.exists("_k", lambda k: k.eqNullSafe("<name>")))
    hashed = lambda slot: F.transform("_plain", lambda x, i: F.when(slot(F.get("_k", i)), F.xxhash64(F.get("_k", i))).otherwise(x))
    valued = lambda slot: F.transform("_core", lambda c, i: F.when(slot(F.get("_k", i)), F.upper(c)))
    every, unnamed = (lambda k: k.isNotNull()), (lambda k: k.isNotNull() & (k != "<name>"))
    df = df.select(
        *key, "_plain", "_any", "_named",
        F.when(F.col("_any"), hashed(every)).otherwise(F.col("_plain")).alias("_h"), F.when(F.col("_any"), valued(every)).alias("_v"),
        F.when(F.col("_named"), hashed(unnamed)).alias("_bh"), F.when(F.col("_named"), valued(unnamed)).alias("_bv"),
    )
    at = F.sequence(F.lit(0), F.size("_plain") - WINDOW)
    n_slots = lambda values: F.transform(at, lambda i: sum((F.get(values, i + k).isNotNull().cast("int") for k in range(WINDOW)), F.lit(0)))
    df = df.withColumn("_n", F.when(F.col("_any"), n_slots("_v"))).withColumn("_bn", F.when(F.col("_named"), n_slots("_bv")).otherwise(F.col("_n")))

    def window(i: Column, hashes: str, kind: str) -> Column:
        return F.struct(i.alias("at"), F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))).alias("hash"), F.lit(kind).alias("kind"))

    few = WINDOW - PLAIN
    # A window with names is made blind too, one with too many numbers also word for word.
    made = F.transform(F.when(F.col("_any"), F.filter(at, lambda i: F.get("_n", i) <= few)).otherwise(at), lambda i: window(i, "_h", "t"))
    blind = F.transform(F.filter(at, lambda i: (F.get("_bn", i) <= few) & (F.get("_n", i) > F.get("_bn", i))), lambda i: window(i, "_bh", "b"))
    literal = F.transform(F.filter(at, lambda i: F.get("_bn", i) > few), lambda i: window(i, "_plain", "l"))
    made = F.when(F.col("_named"), F.concat(made, blind, literal)).when(F.col("_any"), F.concat(made, literal)).otherwise(made)
    df = df.select(*key, "_v", F.when(F.col("_named"), F.col("_bv")).otherwise(F.col("_v")).alias("_bv"), made.alias("_made"))
    # Outer: else the optimiser adds a filter on the array's size, with all of its making, below everything.
    return df.select(*key, "_v", "_bv", F.explode_outer("_made").alias("x")).where("x is not null").select(*key, "_v", "_bv", "x.*")


def _slots(at: str) -> Column:
    """The values of a window's placeholders by place, null for plain words; a null array if it has none."""
    cut = lambda values: F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: F.get(values, F.col(at) + k))
    slots = F.when(F.col("kind") == "t", cut("_v")).when(F.col("kind") == "b", cut("_bv"))
    return F.when(F.exists(slots, lambda x: x.isNotNull()), slots)


def windows(docs: DataFrame, *key: str) -> DataFrame:
    """The key columns, at, hash, template, slots of each window."""
    return _windows(docs, *key).select(*key, "at", "hash", (F.col("kind") == "t").alias("template"), _slots("at").alias("slots"))


def _short(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """doc_id, _id, item_id of items under a window's words that are a whole line of a text; None without such items."""
    name = lambda core: F.md5(F.upper(F.array_join(core, " ")))
    of = lambda text: _cores(text)[1]
    few = benchmark.select("item_id", of(F.col("text")).alias("_core")).where((F.size("_core") > 0) & (F.size("_core") < WINDOW))
    few = few.select("item_id", name("_core").alias("_line"))
    if few.isEmpty():
        return None
    lines = docs.select("doc_id", text_digest(F.col("text")).alias("_id"), F.explode(F.array_distinct(F.split("text", "\n"))).alias("_text"))
    lines = lines.select("doc_id", "_id", of(F.col("_text")).alias("_core")).where((F.size("_core") > 0) & (F.size("_core") < WINDOW))
    return lines.withColumn("_line", name("_core")).join(counted(few), "_line").select("doc_id", "_id", "item_id").distinct()


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, _id, item_id, item_windows, n_windows: a row for each text of a document, item and diagonal that is a leak."""
    items = materialise(windows(benchmark, "item_id").withColumnsRenamed({"at": "item_at", "slots": "item_slots", "template": "item_template"}))
    sizes = items.groupBy("item_id").agg(F.count_distinct("item_at").alias("item_windows"), F.count(F.when(F.col("item_template"), 1)).alias("item_templates"))
    # Equal windows of many items stand together, so that a window of a document meets one row.
    items = same(items, sizes, ["item_id"]).groupBy("hash").agg(F.collect_list(F.struct("item_id", "item_at", "item_slots", "item_template", "item_windows", "item_templates")).alias("_items"))
    items = counted(items)
    # The slots of a document's window are made only where its hash is met.
    made = _windows(docs.select("doc_id", "text", text_digest(F.col("text")).alias("_id")), "doc_id", "_id")
    hits = made.join(items, "hash").select("doc_id", "_id", "at", (F.col("kind") == "t").alias("template"), _slots("at").alias("slots"), F.explode("_items").alias("i"))
    hits = hits.select("doc_id", "_id", "at", "template", "slots", "i.*").withColumn("diagonal", F.col("at") - F.col("item_at"))
    on = ["doc_id", "_id", "item_id", "item_windows", "item_templates", "diagonal"]
    values = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    slots = F.when(F.col("slots").isNotNull() & F.col("item_slots").isNotNull(), F.filter(values, lambda x: x["a"].isNotNull()))
    hits = hits.select(*on, "item_at", slots.alias("slots"), (F.col("template") & F.col("item_template")).alias("template"))
    # Equal hits of repeated rows count once.
    of_template = lambda c: F.when(F.col("template"), F.col(c))
    per = hits.groupBy(*on).agg(*(
        x for k, c in (("", F.col), ("_t", of_template))
        for x in (F.size(F.collect_set(c("item_at"))).alias(f"n{k}"), F.array_distinct(F.flatten(F.collect_set(c("slots")))).alias(f"s{k}"))
    ))

    def consistent(s: str) -> Column:
        a, b = F.transform(s, lambda x: x["a"]), F.transform(s, lambda x: x["b"])
        return (F.size(F.array_distinct(a)) == F.size(s)) & (F.size(F.array_distinct(b)) == F.size(s))

    enough = lambda n: F.least(F.ceil(F.col(n) * SHARE), F.lit(RUN - WINDOW + 1))
    leak = ((F.col("n") >= enough("item_windows")) & consistent("s")) | ((F.col("n_t") > 0) & (F.col("n_t") >= enough("item_templates")) & consistent("s_t"))
    out = per.where(leak).select("doc_id", "_id", "item_id", F.col("n").alias("n_windows"), "item_windows")
    short = _short(docs, benchmark)
    return out if short is None else out.unionByName(short.select("doc_id", "_id", "item_id", F.lit(1).alias("n_windows"), F.lit(1).cast("long").alias("item_windows")))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, n_windows (hits on its best diagonal), item_windows."""
    return _leaks(docs, benchmark).groupBy("doc_id", "item_id", "item_windows").agg(F.max("n_windows").alias("n_windows")).select("doc_id", "item_id", "n_windows", "item_windows")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no item."""
    bad = counted(_leaks(docs, benchmark).select(F.col("_id").alias("_bad")).distinct())
    whole = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("_row"))
    return whole.join(bad, text_digest(F.col("_row.text")) == bad["_bad"], "left_anti").select("_row.*")
