"""URL rules by cascades of Bloom filters, exact on the corpus without a join.

The complete key universe is every host suffix with every path prefix that a rule could name, over all URLs. Level one
encodes the listed keys; level two the keys of the universe that level one takes for listed; level three the listed
keys that level two takes for false positives; and so on until a level is exact on the universe. A key is listed if the
first level that lacks it is even, or no level lacks it and their number is odd. Levels are built from bits that
executors OR together; what reaches the driver is the filters, whose size follows the list and its false positives.

There is a cascade for allowed and one for blocked rules. The longest rule that fits wins; a key in both lists is
allowed; a page that no rule fits gets the default. Defined cases: null or no "://": empty host and path; a text of any
length is matched by as many suffixes as the longest rule has labels; an empty list fits nothing; repeated rows are judged
alike, rules of equal length that fit one page are one rule; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
BITS_PER_KEY = 8
HASHES = 3
LEVELS = 40
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Level:
    number: int
    bits: int
    words: list[int] = field(default_factory=list)

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(1000 * self.number + k)), F.lit(self.bits)) for k in range(HASHES)]

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        out = F.lit(True)
        for at in self.places(key):
            word = F.get(words, F.shiftrightunsigned(at, 5).cast("int"))
            out = out & (F.call_function("shiftright", word, at.bitwiseAND(F.lit(31)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out


def level_of(keys: DataFrame, number: int, count: int) -> Level:
    """A filter of the keys, 32 bits to a word, from bits that are summed up before they meet."""
    level = Level(number, 32 * max(1, math.ceil(count * BITS_PER_KEY / 32)))
    at = keys.select(F.explode(F.array(*level.places(F.col("key")))).alias("at"))
    words = at.groupBy(F.shiftrightunsigned("at", 5).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(31)).cast("int"))).alias("bits")).collect()
    level.words = [0] * (level.bits // 32)
    for w, b in words:
        level.words[w] = b
    return level


@dataclass
class Cascade:
    levels: list[Level]

    def listed(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels), 0, -1):
            out = F.when(~self.levels[k - 1].holds(key), F.lit(k % 2 == 0)).otherwise(out)
        return out


def cascade_of(listed: DataFrame, universe: DataFrame) -> Cascade:
    """listed and universe have a column key of distinct keys; the levels alternate until none errs."""
    levels: list[Level] = []
    sides = [listed, universe.join(listed, "key", "left_anti")]
    while len(levels) < LEVELS:
        now = sides[len(levels) % 2]
        # of this side, what every earlier level of the other side's turn lets through
        for level in levels:
            now = now.where(level.holds(F.col("key")))
        count = now.count()
        if not count:
            return Cascade(levels)
        levels.append(level_of(now, len(levels) + 1, count))
    raise RuntimeError("the cascade did not become exact")


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def candidates(host: Column, path: Column, rules) -> Column:
    """Every key that a rule could be: host suffixes of as many labels as rules have, with path prefixes of their lengths."""
    hosts, paths = zip(*((r.split("/", 1)[0], "/" + r.split("/", 1)[1]) for _, r in rules), strict=True) if rules else ((), ())
    labels = F.split(host, r"\.")
    suffixes = [F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in sorted({h.count(".") + 1 for h in hosts})]
    prefixes = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted({len(p) for p in paths})]
    keys = F.array(*(F.concat(s, p) for s in suffixes for p in prefixes)).cast("array<string>")
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))


def judge(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Id, host, path, rule (null if none fits) and verdict."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("keys", candidates(F.col("host"), F.col("path"), rules))
    universe = rows.select(F.explode("keys").alias("key")).distinct()
    spark = pages.sparkSession
    allowed = sorted({r for a, r in rules if a == "allow"})
    blocked = sorted({r for a, r in rules if a == "block"} - set(allowed))
    lists = [spark.createDataFrame([(r,) for r in rs], "key string") for rs in (allowed, blocked)]
    allow, block = (cascade_of(x, universe) for x in lists)
    fits = F.filter("keys", lambda k: allow.listed(k) | block.listed(k))
    longest = F.array_max(F.transform(fits, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    rows = rows.withColumn("rule", longest)
    verdict = F.when(F.col("rule").isNull(), default).when(allow.listed(F.col("rule")), "allow").otherwise("block")
    return rows.select(id_col, "host", "path", "rule", verdict.alias("verdict"))


def judge_sql(rules=RULES, default: str = "allow") -> str:
    fits = " UNION ALL ".join(f"SELECT '{a}' AS action, '{r}' AS rule, '{r.split('/', 1)[0]}' AS rule_host, '/{r.split('/', 1)[1]}' AS rule_path" for a, r in rules)
    return rf"""
WITH rules AS ({fits}),
cut AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
               regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
best AS (SELECT page_id, host, path, rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS n
         FROM cut LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(action, '{default}') AS verdict FROM best WHERE n = 1"""
