"""Quality rules whose cutoffs come with a guarantee.

The cutoffs of all rules form one path from lenient to strict: at step j the
rules have been tightened in turn, rule by rule and level by level. A document's
step is the first at which a rule rejects it. In every stratum (language) the
good labelled documents that pass the base rules, on which no cutoff was fitted,
are counted up to each step, and the steps are tested in this fixed order: step j
is certified if it and all before it have an exact binomial tail
P(Bin(n, limit) <= rejected) of at most confidence / number of strata. A fixed
sequence that ends at its first failure needs no further correction over its
steps, so Bonferroni is over the strata alone. Then, in all strata at once, the
rules together reject at most `limit` of the good documents with probability
1 - confidence. The strictest certified step is used. A stratum with too few
labels (86 at four strata) certifies nothing and keeps all.

Labelled documents of equal text count once: copies aren't independent trials.

Cases. A null or empty text has zero counts and fails the base rules; a very
long one is counted whole. A null stratum is one of its own. A document labelled
several times, and a text whose copies are labelled, counts once, as good if any
label says so. Ratios equal to a cutoff pass. Repeated rows are judged alike.
Without labels every document that passes the base rules is kept. No rows: no
result. Columns beside doc_id, text and the stratum don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, counted, materialise, same, text_digest, words

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: rule: (counted, counted against, cutoffs from lenient to strict)
RULES = {
    "symbols": ("n_symbols", "word_chars", (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03)),
    "capitals": ("n_upper", "word_chars", (0.8, 0.65, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15)),
    "shouts": ("n_bang", "n_words", (2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1)),
    "lines": ("n_dup_lines", "n_lines", (0.8, 0.65, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15)),
    "repeats": ("n_repeat_words", "n_words", (0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.07, 0.05)),
}


def _repeat_words(df: DataFrame) -> DataFrame:
    """Add n_repeat_words: the words within windows of five that the text has twice or more.

    Windows are 64-bit digests. Only texts in which two are equal are sorted;
    then each repeated window adds the words up to the next one's start."""
    df = df.withColumn("_w", F.transform("_words", lambda w: F.xxhash64(w)))
    at = F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW)
    hashed = F.transform(at, lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(WINDOW))))
    df = df.withColumn("_h", F.when(F.col("n_words") >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>")))
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_t", F.when(some, pairs))
    at = F.transform("_t", lambda t, k: F.when((F.get("_t", k - 1)["h"] == t["h"]).eqNullSafe(True) | (F.get("_t", k + 1)["h"] == t["h"]).eqNullSafe(True), t["i"]))
    df = df.withColumn("_p", F.sort_array(F.filter(at, lambda x: x.isNotNull())))
    steps = F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(steps, F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long"))


def statistics(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, text_id and the counts of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", F.col(stratum).alias("stratum"), text_digest(text).alias("text_id"), text.alias("_text"), words(text).alias("_words"))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    df = df.select(
        "doc_id", "stratum", "text_id", "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("_text", F.lit("!")).cast("long").alias("n_bang"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    df = _repeat_words(df)
    return df.drop("_words", "_w", "_h", "_t", "_p")


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term in logarithms; 1 from the mean on, where no cutoff is certified."""
    odds = F.lit(p / (1 - p))
    start = n * F.log1p(F.lit(-p))

    def term(a: Column, i: Column) -> Column:
        t = a["t"] + F.ln((n - i + 1) / i * odds)
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    first = F.struct(start.alias("t"), F.exp(start).alias("s"))
    some = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.aggregate(some, first, term, lambda a: a["s"]))


#: (rule, cutoff) of each step of the path, from 1.
PATH = [(r, RULES[r][2][level]) for level in range(8) for r in RULES]


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def first_step() -> Column:
    """The first step of the path at which a row of statistics() is rejected; null if none does."""
    hits = [F.when(F.col(RULES[r][0]) > F.lit(c) * F.col(RULES[r][1]), F.lit(j)) for j, (r, c) in enumerate(PATH, 1)]
    return F.coalesce(*hits)


def certified(stats: DataFrame, labels: DataFrame, limit: float = 0.05, confidence: float = 0.05) -> DataFrame:
    """One row a stratum with labelled good documents: stratum, n (of them), certified (the last certified step, 0 for none).

    stats has step and base_failed besides the columns of statistics()."""
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("_good")).where("_good = 1").select(F.col("doc_id").alias("_id"))
    held = stats.where("not base_failed").join(good, stats["doc_id"] == good["_id"])
    held = held.groupBy("stratum", "text_id").agg(F.min("step").alias("step"))  # of equal texts one
    by = held.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("k"))
    by = by.groupBy("stratum").agg(F.sum("k").alias("n"), F.map_from_entries(F.collect_list(F.when(F.col("step").isNotNull(), F.struct("step", "k")))).alias("at"))  # an entry a step at most
    strata = materialise(by)
    tests = strata.agg(F.count(F.lit(1)).alias("strata"))  # one row
    rows = strata.join(F.broadcast(tests), how="left")
    none = F.lit(0).cast("long")

    def walk(a: Column, j: Column) -> Column:
        k = a["k"] + F.coalesce(F.try_element_at("at", j), none)
        good = a["open"] & (binomial_tail(F.col("n"), k, limit) <= F.lit(confidence) / F.col("strata"))
        return F.struct(k.alias("k"), good.alias("open"), F.when(good, j).otherwise(a["last"]).alias("last"))

    start = F.struct(none.alias("k"), F.lit(True).alias("open"), F.lit(0).alias("last"))
    steps = F.sequence(F.lit(1), F.lit(len(PATH)))
    return rows.select("stratum", "n", F.aggregate(steps, start, walk, lambda a: a["last"]).alias("certified"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = 0.05, confidence: float = 0.05, max_strata: int | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, failed (the certified rule that first rejects it, or empty).

    Certified steps are broadcast up to a measured size (max_strata rows, if
    given); those of more strata are joined by a shuffle."""
    # Written in between: the optimiser would carry each count's whole expression into every step of the path.
    stats = materialise(statistics(docs, stratum))
    stats = materialise(stats.withColumns({"base_failed": _base_failed(), "step": first_step()}))
    df = same(stats, counted(certified(stats, labels, limit, confidence).select("stratum", "certified"), max_strata), ["stratum"], "left")
    rule = F.element_at(F.array(*(F.lit(r) for r, _ in PATH)), F.col("step"))
    failed = F.coalesce(F.when(F.col("step") <= F.col("certified"), rule), F.lit(""))
    df = df.withColumn("failed", failed)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("failed") == "")).alias("kept"), "failed")
