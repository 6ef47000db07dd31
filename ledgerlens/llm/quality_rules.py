"""Quality rules over whole texts, with DataFrame functions only.

Base rules count words, symbols, repeated lines and words inside repeated three-word windows. The verdict is a
log-likelihood ratio of hashed one- and two-word grams between two multinomials, one of a trusted target and one of the raw corpus, each over
`buckets` buckets with add-one smoothing, divided by the grams of the text; a text is kept at `threshold` or above. The raw
multinomial counts every document. The target's are the documents labelled good, at most `most_target` of them in order
of a hash of their ids (a bound on what is broadcast, not on what is counted or judged).

Windows are found inside each row: their hashes are compared as a set first, and only texts with a repeat sort them.
The table of ratios has `buckets` rows whatever the corpus; counts are summed before the shuffle.

Defined cases: null text has no words; a text without words has ratio 0 and fails the base rules; a null id is like any
other; repeated rows are judged alike; an empty corpus keeps a uniform table; other columns pass through, except that an input
column of an output's name gives way to it in judged(); ties of the ratio with the threshold are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import positional

BUCKETS = 1 << 14
MOST_TARGET = 20_000
THRESHOLD = -0.12
SPACE = r"[\x20\x09-\x0D]+"
OWN = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_grams", "ratio", "kept"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def grams_of(words: Column, buckets: int) -> Column:
    """Buckets of one-word grams, then of two-word grams."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.transform(words, lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(one, F.slice(two, 1, F.greatest(F.size(words) - 1, F.lit(0))))


def with_base(docs: DataFrame, text: str, p: str) -> DataFrame:
    """Adds the base counts under names that begin with p."""
    t = F.coalesce(F.col(text), F.lit(""))
    c = lambda name: F.col(p + name)
    out = docs.withColumn(p + "words", words_of(F.col(text)))
    lines = F.filter(F.split(t, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn(p + "lines", lines).withColumn(p + "n_words", F.size(c("words")).cast("long"))
    out = out.withColumn(p + "word_chars", F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long"))
    out = out.withColumn(p + "n_symbols", (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"))
    out = out.withColumn(p + "n_dup_lines", (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"))
    window = F.transform(c("words"), lambda w, i: F.xxhash64(w, F.get(c("words"), i + 1), F.get(c("words"), i + 2)))
    out = out.withColumn(p + "windows", F.slice(window, 1, F.greatest(F.size(c("words")) - 2, F.lit(0))))
    placed = F.array_sort(F.transform(c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn(p + "placed", F.when(F.size(F.array_distinct(c("windows"))) < F.size(c("windows")), placed))
    twice = F.filter(c("placed"), lambda x, i: F.coalesce(F.get(c("placed"), i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(c("placed"), i + 1)["h"] == x["h"], F.lit(False)))
    out = out.withColumn(p + "at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.transform(c("at"), lambda a, k: F.least(F.lit(3), F.coalesce(F.get(c("at"), k + 1) - a, F.lit(3))))
    out = out.withColumn(p + "n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).cast("long"))
    failed = (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    return out.withColumn(p + "base_failed", failed).drop(*(p + x for x in ("lines", "windows", "placed", "at")))


def trusted_ids(labels: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """Ids labelled good, at most so many, by a hash of the id."""
    return labels.where("quality = 1").select(F.col(id_col).alias("__trusted")).where("__trusted IS NOT NULL").distinct().orderBy(F.xxhash64("__trusted"), "__trusted").limit(most)


def ratio_table(docs: DataFrame, labels: DataFrame, id_col: str, text: str, buckets: int, most: int) -> list[float]:
    """log(target / raw) for each bucket; both multinomials are add-one smoothed."""
    target = F.broadcast(trusted_ids(labels, most))
    rows = docs.select(F.col(id_col).alias("__id"), words_of(F.col(text)).alias("__words")).join(target, F.col("__id") == F.col("__trusted"), "left")
    grams = rows.select(F.explode(grams_of(F.col("__words"), buckets)).alias("b"), F.col("__trusted").isNotNull().cast("int").alias("t"))
    count = {r[0]: (r[1], r[2]) for r in grams.groupBy("b").agg(F.count("*"), F.sum("t")).collect()}
    raw, good = (sum(x[k] for x in count.values()) + buckets for k in (0, 1))
    return [math.log((count.get(b, (0, 0))[1] + 1) / good) - math.log((count.get(b, (0, 0))[0] + 1) / raw) for b in range(buckets)]


def _verdicts(docs: DataFrame, labels: DataFrame, id_col: str, text: str, threshold: float, buckets: int, most_target: int) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns named by their places, and __o_ columns of the operator's own."""
    base, own = positional(docs)
    table = ratio_table(base, labels, own[id_col], own[text], buckets, most_target)
    # one folded literal, read by place
    ratios = F.split(F.lit(",".join(f"{x:.9f}" for x in table)), ",").cast("array<double>")
    out = with_base(base, own[text], "__q_")
    out = out.withColumn("__q_grams", grams_of(F.col("__q_words"), buckets)).withColumn("__q_n_grams", F.size("__q_grams").cast("long"))
    total = F.aggregate(F.col("__q_grams"), F.lit(0.0), lambda s, b: s + F.get(ratios, b))
    out = out.withColumn("__q_ratio", F.coalesce(total / F.nullif(F.col("__q_n_grams"), F.lit(0)), F.lit(0.0)))
    out = out.withColumn("__q_kept", ~F.col("__q_base_failed") & (F.col("__q_ratio") >= threshold))
    # a generator of one row: a filter on the verdict can't be pushed below it, where the optimizer would put whole
    # arrays in place of their names inside lambdas and compute them anew for each element
    said = F.struct(*(F.col(f"__q_{c}").alias(f"__o_{c}") for c in OWN))
    return out.select(*own.values(), F.inline(F.array(said))), own


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS, most_target: int = MOST_TARGET, prefix: str = "") -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_grams, ratio and kept (names begin with prefix)."""
    out, own = _verdicts(docs, labels, id_col, text, threshold, buckets, most_target)
    new = {prefix + c for c in OWN}
    return out.select(*(F.col(o).alias(c) for c, o in own.items() if c not in new), *(F.col(f"__o_{c}").alias(prefix + c) for c in OWN))


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS, most_target: int = MOST_TARGET) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    out, own = _verdicts(docs, labels, id_col, text, threshold, buckets, most_target)
    return out.where("__o_kept").select(*(F.col(o).alias(c) for c, o in own.items()))
