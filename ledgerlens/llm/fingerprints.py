"""Homomorphic multiset fingerprints of documents, with DataFrame functions only.

A document is a multiset of paragraphs (its lines). A paragraph becomes a wide vector: four 32-bit lanes (128 bits, on which
equality rests) hashed from the whole paragraph, and 64 lanes that each add one bit of the hash of each of its two-word shingles. A document's vector
is the sum of its paragraphs', lanes taken modulo 2^32 and 2^16, so the order of paragraphs doesn't matter and a
paragraph is inserted or deleted by adding or subtracting its vector (`combined`). Texts of equal multisets have equal
fingerprints; likeness is the correlation of the 64 lanes, cut to 0..1, and 1 for equal fingerprints.

The next document comes from a window over ranges of ids, with texts shuffled once; the grouping that sums lanes has
that same distribution, so it adds no shuffle. Ranges grow as the 3/4 power of the rows, so that their cuts fit a plan; an id that
many rows share is cut again by a hash of the text. A range's last row gets its neighbour from a table of one row a range.

Defined cases: null text is empty; an empty text has no shingles; a null id stands after all others; rows of equal
id are neighbours in order of a hash of their texts; a single document is its own next one; other columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, checkpoint, partitions

LANES = 64
SUMS = LANES // 2
PAIR = 1 | 1 << SUMS
RANGE_ROWS = 2000


def exact_lanes(text: Column) -> list[Column]:
    """Four sums of paragraph hashes modulo 2^32."""


    def lane(seed: int, shift: int) -> Column:
        hashes = F.transform(F.split(text, "\n", -1), lambda p: F.shiftrightunsigned(F.xxhash64(p, F.lit(seed)), shift).bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: (s + h) % F.lit(1 << 32))

    return [lane(seed, shift) for seed in (0, 1) for shift in (0, 32)]


def shingle_hashes(text: Column) -> Column:
    """Hashes of two-word shingles inside each paragraph; its last word stands alone."""
    lines = F.transform(F.split(text, "\n", -1), lambda p: F.array_remove(F.split(p, r"[\x20\x09-\x0D]+"), ""))
    return F.flatten(F.transform(lines, lambda ws: F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1)))))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of a with those of b inserted (sign 1) or deleted (-1): arrays of 4 exact lanes, then LANES others."""
    return F.transform(F.zip_with(a, b, lambda x, y: x + sign * y), lambda x, i: F.when(i < 4, F.pmod(x, F.lit(1 << 32))).otherwise(F.pmod(x, F.lit(1 << 16))))


def spelled(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x, i: F.lower(F.lpad(F.hex(x), F.when(i < 4, 8).otherwise(4), "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Correlation of the shingle lanes, cut to 0..1; 1 if all lanes are equal, 0 if either is flat."""
    x, y = F.slice(a, 5, LANES), F.slice(b, 5, LANES)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + v)
    sx, sy = total(x), total(y)
    xx, yy = total(F.transform(x, lambda v: v * v)), total(F.transform(y, lambda v: v * v))
    xy = total(F.zip_with(x, y, lambda v, w: v * w))
    spread = (LANES * xx - sx * sx).cast("double") * (LANES * yy - sy * sy).cast("double")
    r = F.when(spread > 0, (LANES * xy - sx * sy) / F.sqrt(spread)).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(F.greatest(r, F.lit(0.0)), F.lit(1.0)))


def with_range(docs: DataFrame, ranges: int) -> DataFrame:
    """Adds __range, in the order of (__id, __h), of about equal rows: two levels of cuts, so a row compares with few.

    An id that makes up several cuts has the ranges between them, dealt by __h.
    """
    wide = max(1, math.isqrt(ranges))
    if wide == 1:
        return docs.withColumn("__range", F.lit(0))
    cuts = sorted(docs.agg(F.percentile_approx("__id", [k / (wide * wide) for k in range(1, wide * wide)], 4 * wide * wide)).first()[0] or [])
    blocks = [cuts[k : k + wide] for k in range(0, len(cuts), wide)] or [[]]
    spelled_out = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>") if xs else F.array().cast("array<bigint>")
    heads = spelled_out([b[0] for b in blocks if b])
    inner = F.split(F.lit(";".join(",".join(map(str, b)) for b in blocks)), ";")

    def count(below):
        """How many cuts stand below the id."""
        block = F.size(F.filter(heads, below))
        return F.when(block == 0, 0).otherwise((block - 1) * wide + F.size(F.filter(F.split(F.get(inner, block - 1), ",").cast("array<bigint>"), below)))

    less, most = count(lambda c: c < F.col("__id")), count(lambda c: c <= F.col("__id"))
    out = docs.withColumn("__less", less).withColumn("__most", most)
    share = F.shiftrightunsigned(F.col("__h").bitwiseXOR(F.lit(-(1 << 63))), 32) * (F.col("__most") - F.col("__less") + 1)
    return out.withColumn("__range", (F.col("__less") + F.shiftright(share, 32)).cast("int")).drop("__less", "__most")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    rows = rows.withColumn("__h", F.xxhash64("__text"))
    n = docs.count()
    rows = with_range(rows, max(partitions(docs.sparkSession), math.ceil((n / range_rows) ** 0.75)))
    # ranges: a row each
    heads = rows.groupBy("__range").agg(F.min(F.struct("__id", "__h")).alias("f"))
    heads = checkpoint(heads.select("__range", F.col("f.__id").alias("__first"), F.col("f.__h").alias("__first_h")))
    order = Window.orderBy("__range")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    circled = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(everything))
    heads = heads.select("__range", circled("__first").alias("__next_first"), circled("__first_h").alias("__next_h"), circled("__range").alias("__next_range"))
    ahead = rows.select(F.col("__id").alias("__next_first"), F.col("__h").alias("__next_h"), F.col("__text").alias("__t")).join(F.broadcast(heads), ["__next_first", "__next_h"])
    after = ahead.groupBy("__range").agg(F.min("__t").alias("__after"))
    own = Window.partitionBy("__range").orderBy("__id", "__h", "__text")
    rows = rows.select("*", F.row_number().over(own).alias("__n"), F.lead("__text").over(own).alias("__lead"))
    rows = rows.join(after, "__range", "left")
    half = F.floor(F.length("__text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("__text"), F.lit(1), F.length("__text") - half), F.substring(F.coalesce("__lead", "__after"), F.lit(1), half))
    rows = rows.select("__range", "__n", "__id", F.length("__text").cast("long").alias("__chars"), "__text", edited.alias("__edited"))
    sides = F.array(*(F.struct(F.lit(k).alias("side"), F.col(c).alias("t")) for k, c in enumerate(("__text", "__edited"))))
    sides = rows.select("__range", "__n", "__id", "__chars", F.explode(sides).alias("s")).select("__range", "__n", "__id", "__chars", "s.side", F.col("s.t").alias("t"))
    digest = F.when(F.col("side") == 1, F.sha2(F.col("t").cast("binary"), 256))
    sides = sides.select("__range", "__n", "__id", "__chars", "side", digest.alias("digest"), *(x.alias(f"e{k}") for k, x in enumerate(exact_lanes(F.col("t")))), shingle_hashes(F.col("t")).alias("hs"))
    keys = ["__range", "__n", "side"]
    exploded = sides.select(*keys, F.explode_outer("hs").alias("h"))
    sums = exploded.groupBy(*keys).agg(*(F.coalesce(F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(PAIR))), F.lit(0)).alias(f"s{j}") for j in range(SUMS)))
    lanes = F.array(*(x for j in range(SUMS) for x in (F.col(f"s{j}").bitwiseAND(F.lit(0xFFFF)), F.shiftright(f"s{j}", SUMS).bitwiseAND(F.lit(0xFFFF)))))
    whole = sides.drop("hs").join(sums.select(*keys, lanes.alias("lanes")), keys)
    whole = whole.select(*keys, "__id", "__chars", "digest", F.concat(F.array(*(f"e{k}" for k in range(4))), "lanes").alias("v"))
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    both = whole.groupBy("__range", "__n").agg(F.max("__id").alias("__id"), F.max("__chars").alias("__chars"), F.max("digest").alias("digest"), pick(0, "v").alias("v"), pick(1, "v").alias("w"))
    first = both.where("__n = 1").select(F.col("__range").alias("__next_range"), F.col("v").alias("__first_v")).join(F.broadcast(heads.select("__range", "__next_range")), "__next_range").select("__range", "__first_v")
    both = both.select("*", F.lead("v").over(Window.partitionBy("__range").orderBy("__n")).alias("__lead_v")).join(first, "__range", "left")
    return both.select(
        F.when(F.col("__id") != LAST_ID, F.col("__id")).alias(id_col),
        F.col("__chars").alias("n_chars"),
        F.col("digest").alias("edited_sha256"),
        spelled(F.col("v")).alias("fingerprint"),
        spelled(F.col("w")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("w")).alias("near_edited"),
        likeness(F.col("v"), F.coalesce("__lead_v", "__first_v")).alias("near_next"),
    )
