"""Secret scanning with corpus-wide ownership frequency.

Candidates are the matches of three base kinds (assignments, access keys, hexadecimal strings) and, beside them, bare
runs of the characters that values have. Each candidate's value is hashed (64 bits); hashes are counted by repository (the
distinct documents of an owner) and by owner, over the whole corpus. A value that more than `most_owners` owners and more
than `most_repositories` repositories hold is a widely copied example; any other is owner-specific and looks live.

That verdict decides: a bare run becomes a span of kind `token` only if its value looks live and either is varied enough
to be a credential by itself or stands somewhere in the corpus as a base match, so a password that one document assigns is
found where others merely quote it. Base spans always stay in the report; mask() hides live values and leaves examples.

Counts are partial before each shuffle; the table of verdicts is written once, so that both sides of its join are plain
shuffles, whose hot values (an example in a third of all documents) the engine splits.

A span is the whole match, in code points, end exclusive; an assignment's value is its second group. Defined cases: null
text is empty; a null owner is one owner of its own, a null id one repository; repeated rows count once; of spans that
start together the order is that of the kinds; other columns are ignored, or pass through mask(), whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, positional

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
ISSUED = re.compile(r"(gh[opsur]_|xox[abprs]-|sk_live_|AIza|eyJ)[A-Za-z0-9_.-]{20,}")
KINDS = ("assign", "access", "hex", "token")
MASK = "<SECRET>"
MOST_OWNERS, MOST_REPOSITORIES = 2, 4
SCAN = "n_assign long, n_access long, n_hex long, base string, candidates array<struct<kind:int,first:int,last:int,hash:bigint,strong:boolean>>"


def base_matches(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value), leftmost and non-overlapping for each kind."""
    found = [(0, *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return found + [(2, *m.span(), m[0]) for m in HEX.finditer(text)]


def varied(s: str) -> bool:
    """20 characters or more with upper case, lower case and three digits, or the form of an issued token."""
    return len(s) >= 20 and sum(map(str.isdigit, s)) >= 3 and s != s.lower() and s != s.upper() or ISSUED.fullmatch(s) is not None


def bare_runs(text: str, taken: list) -> list[tuple[int, int, int, str]]:
    """Runs of 12 characters or more with letters and digits, less dots at the end, outside base matches."""
    out = []
    for m in RUN.finditer(text):
        s = m[0].rstrip(".")
        if len(s) < 12 or s.isalpha() or not any(map(str.isdigit, s)) or not any(map(str.isalpha, s)):
            continue
        a, b = m.start(), m.start() + len(s)
        if not any(x < b and a < y for _, x, y, _ in taken):
            out.append((3, a, b, s))
    return out


def value_hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def spelled(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted((a, k, b) for k, a, b in spans))


def _scan(batches):
    for batch in batches:
        cols = [[] for _ in range(5)]
        for text in batch.column(2).to_pylist():
            base = base_matches(text or "")
            for k in range(3):
                cols[k].append(sum(x[0] == k for x in base))
            cols[3].append(spelled((k, a, b) for k, a, b, _ in base))
            cols[4].append([{"kind": k, "first": a, "last": b, "hash": value_hash(v), "strong": k < 3 or varied(v)} for k, a, b, v in base + bare_runs(text or "", base)])
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("hash", pa.int64()), ("strong", pa.bool_())]))
        arrays = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], kind)]
        yield pa.RecordBatch.from_arrays(arrays, ["__id", "__owner", "n_assign", "n_access", "n_hex", "base", "candidates"])


def scanned_documents(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__id"), F.col(owner_col).cast("string").alias("__owner"), F.col(text_col).cast("string").alias("__text"))
    scanned = rows.mapInArrow(_scan, f"__id {kind}, __owner string, {SCAN}")
    return checkpoint(scanned.withColumn("__row", F.monotonically_increasing_id()))


def ownership(scanned: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories, and labelled: whether the value stands somewhere as a base match."""
    each = scanned.select("__owner", "__id", F.explode("candidates").alias("c")).select("__owner", "__id", "c.hash", (F.col("c.kind") < 3).alias("labelled"))
    repositories = each.groupBy("hash", "__owner", "__id").agg(F.max("labelled").alias("labelled"))
    owners = repositories.groupBy("hash", "__owner").agg(F.count("*").alias("n"), F.max("labelled").alias("labelled"))
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"), F.max("labelled").alias("labelled"))


def judged(scanned: DataFrame, most_owners: int, most_repositories: int) -> DataFrame:
    """Candidates that count, one a row: __row, __id, kind, first, last, hash, live."""
    owned = ownership(scanned)
    example = (F.col("n_owners") > most_owners) & (F.col("n_repositories") > most_repositories)
    owned = checkpoint(owned.select("hash", (~example).alias("live"), "labelled"))
    one = scanned.where(F.size("candidates") > 0).select("__row", "__id", F.explode("candidates").alias("c")).select("__row", "__id", "c.*")
    return one.join(owned, "hash").where("kind < 3 OR live AND (strong OR labelled)")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """Id, n_assign, n_access, n_hex, base_sha256, spans, and beyond the contract n_live and n_examples: values of spans that look live, or are examples."""
    scanned = scanned_documents(docs, id_col, text_col, owner_col)
    said = judged(scanned, most_owners, most_repositories).groupBy("__row").agg(
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_examples"),
        F.collect_list(F.when(F.col("kind") == 3, F.struct("first", "last"))).alias("added"),
    )
    rows = scanned.select("__row", "__id", "n_assign", "n_access", "n_hex", "base").join(said, "__row", "left")
    parts = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))
    added = F.coalesce(F.transform("added", lambda s: F.concat(F.lit("token:"), s["first"].cast("string"), F.lit(":"), s["last"].cast("string"))), F.array().cast("array<string>"))
    order = F.transform(F.concat(parts, added), lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("a"), F.array_position(F.array(*map(F.lit, KINDS)), F.split_part(s, F.lit(":"), F.lit(1))).alias("k"), s.alias("s")))
    spans = F.array_join(F.transform(F.array_sort(order), lambda x: x["s"]), ",")
    return rows.select(F.col("__id").alias(id_col), "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_examples", F.lit(0)).alias("n_examples"))


def masked_text(text: str | None, hashes) -> str | None:
    """Values whose hash is among those given give way to a mask, with their whole match; overlapping ones to one."""
    if not text or hashes is None or not len(hashes):
        return text
    base, live = base_matches(text), set(np.asarray(hashes).tolist())
    spans = sorted((a, b) for _, a, b, v in base + bare_runs(text, base) if value_hash(v) in live)
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """The documents with every live value of scan() masked in the text; examples and other columns as they were."""
    base, own = positional(docs)
    said = judged(scanned_documents(docs, id_col, text_col, owner_col), most_owners, most_repositories)
    # a value is live wherever it stands, so rows of one id may share their lists
    live = checkpoint(said.where("live").groupBy("__id").agg(F.collect_set("hash").alias("__live")))

    @F.pandas_udf("string")
    def masked(text, hashes):
        return text.combine(hashes, masked_text)

    joined = base.join(live, F.col(own[id_col]).eqNullSafe(F.col("__id")), "left").withColumn(own[text_col], masked(F.col(own[text_col]).cast("string"), F.col("__live")))
    return joined.select(*(F.col(own[c]).alias(c) for c in docs.columns))
