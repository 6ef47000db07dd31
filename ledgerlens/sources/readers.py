"""What comes in: lines of JSON, single writes, trees of files, and the data sets of benchmarks."""

from __future__ import annotations

import datetime
import fnmatch
import posixpath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ledger import WRITE, checked

SUFFIXES = ("md", "markdown", "txt")
MOST_BYTES = 8 << 20


def memories(spark: SparkSession, path: str, project: str, now: Column | None = None, valid_from=None, valid_to=None) -> DataFrame:
    """Writes from lines {topic, content}. A line that isn't one fails the whole read before anything is written.

    Topics keep the order of the file: seq grows with the place of a line, by file name and offset. One validity holds for all.
    """
    now = F.current_timestamp() if now is None else now
    schema = "topic string, content string, broken string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "broken").option("mode", "PERMISSIVE").json(path)
    wrong = F.col("broken").isNotNull() | F.col("topic").isNull() | F.col("content").isNull()
    rows = rows.where(F.when(wrong, F.raise_error(F.concat(F.lit("not a memory: "), F.coalesce("broken", "topic", F.lit("a line without topic"))))).cast("boolean").isNull() | ~wrong)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = rows.select("topic", "content", place.alias("place"))
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("topic").orderBy("place")).cast("long"))
    moment = lambda v: F.lit(v).cast("timestamp")
    return checked(rows.select(F.lit(project).alias("project"), "topic", "content", "seq", now.alias("recorded_at"), moment(valid_from).alias("valid_from"), moment(valid_to).alias("valid_to")))


def single(spark: SparkSession, project: str, topic: str, content: str, seq: int, now: datetime.datetime, valid_from=None, valid_to=None) -> DataFrame:
    """One write, through the same steps as many."""
    return checked(spark.createDataFrame([(project, topic, content, seq, now, valid_from, valid_to)], WRITE))


def ignores(lines: list[str], at: str = "") -> list[tuple[str, str, bool, bool]]:
    """Rules (folder, pattern, folders only, negated) of an ignore file that lies in the folder `at`."""
    rules = []
    for line in lines:
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        pattern = line.removeprefix("!").removeprefix("\\")
        rules.append((at, pattern.rstrip("/"), pattern.endswith("/"), negated))
    return rules


def ignored(path: str, rules: list[tuple[str, str, bool, bool]]) -> bool:
    """Whether a file's path, or a folder above it, is ignored: the last rule that fits decides."""
    parts = path.split("/")
    for k in range(1, len(parts) + 1):
        sub, folder, verdict = "/".join(parts[:k]), k < len(parts), False
        for at, pattern, folders, negated in rules:
            if at and not sub.startswith(at + "/") or folders and not folder:
                continue
            inner = sub[len(at) + 1 :] if at else sub
            anchored = "/" in pattern
            if fnmatch.fnmatchcase(inner, pattern.removeprefix("/").replace("**/", "*")) if anchored else fnmatch.fnmatchcase(parts[k - 1], pattern):
                verdict = not negated
        if verdict:
            return True
    return False


def wanted(path: str, rules: list[tuple[str, str, bool, bool]]) -> bool:
    """Files of the known suffixes, neither hidden nor ignored."""
    parts = path.split("/")
    return path.rsplit(".", 1)[-1].lower() in SUFFIXES and not any(p.startswith(".") for p in parts) and not ignored(path, rules)


def files(spark: SparkSession, root: str, rules: list[tuple[str, str, bool, bool]] = ()) -> DataFrame:
    """path (under the root), text, size, mtime of a tree's text files of at most 8 MiB, and problem for those that can't be read.

    Spark lists and reads the tree; links aren't followed where the file system tells them apart. The rules are those of the
    ignore files, which a caller reads beforehand.
    """
    rules = list(rules)
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(root)
    base = posixpath.normpath(root.split(":", 1)[-1]).replace("//", "/")
    under = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), f"^{base}/", "")
    keep = F.udf(lambda p: wanted(p, rules), T.BooleanType())
    rows = seen.select(under.alias("path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).where(keep("path"))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    problem = F.when(F.col("size") > MOST_BYTES, "too large").when(text.isNull(), "not UTF-8")
    return rows.select("path", F.when(problem.isNull(), text).alias("text"), "size", "mtime", problem.alias("problem"))


# --- benchmark data sets


def session_turns(spark: SparkSession, path: str) -> DataFrame:
    """conversation, session, stamp, turn, dia_id, speaker, text of conversations whose sessions are fields session_1, session_2, …

    The sessions are keys of a map, as their number is not in the schema.
    """
    kind = "sample_id string, conversation map<string,string>"
    rows = spark.read.option("multiLine", "true").schema(kind).json(path)
    fields = rows.select(F.col("sample_id").alias("name"), "conversation", F.explode("conversation").alias("key", "value"))
    fields = fields.withColumn("session", F.regexp_extract("key", r"^session_([0-9]+)$", 1)).where("session <> ''")
    turns = F.from_json("value", "array<struct<dia_id:string,speaker:string,text:string>>")
    stamp = F.element_at("conversation", F.concat("key", F.lit("_date_time")))
    each = fields.select(F.col("name").alias("conversation"), F.col("session").cast("int").alias("session"), stamp.alias("stamp"), F.posexplode(turns).alias("turn", "t"))
    return each.select("conversation", "session", "stamp", "turn", "t.dia_id", "t.speaker", "t.text")


def session_questions(spark: SparkSession, path: str) -> DataFrame:
    """conversation, question, answer, category, evidence; an adversarial answer stands in where there is no other."""
    kind = "sample_id string, qa array<struct<question:string,answer:string,adversarial_answer:string,category:int,evidence:array<string>>>"
    rows = spark.read.option("multiLine", "true").schema(kind).json(path).select(F.col("sample_id").alias("conversation"), F.explode("qa").alias("q"))
    return rows.select("conversation", "q.question", F.coalesce("q.answer", "q.adversarial_answer").alias("answer"), "q.category", "q.evidence")


def haystacks(spark: SparkSession, path: str) -> DataFrame:
    """question_id, question_type, question, answer, session_id, stamp, gold, turn, role, content, has_answer."""
    turn = "array<struct<role:string,content:string,has_answer:boolean>>"
    kind = f"question_id string, question_type string, question string, answer string, answer_session_ids array<string>, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<{turn}>"
    rows = spark.read.option("multiLine", "true").schema(kind).json(path)
    zipped = F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")
    one = rows.select("question_id", "question_type", "question", "answer", "answer_session_ids", F.explode(zipped).alias("s"))
    one = one.select("*", F.col("s.haystack_session_ids").alias("session_id"), F.col("s.haystack_dates").alias("stamp"), F.posexplode("s.haystack_sessions").alias("turn", "t"))
    return one.select("question_id", "question_type", "question", "answer", "session_id", "stamp", F.array_contains("answer_session_ids", F.col("session_id")).alias("gold"), "turn", "t.role", "t.content", F.coalesce("t.has_answer", F.lit(False)).alias("has_answer"))


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """id, question, place, title, memory (title and text, at most 2,000 characters), supporting: questions over several paragraphs."""
    kind = "id string, question string, paragraphs array<struct<title:string,paragraph_text:string,is_supporting:boolean>>"
    rows = spark.read.schema(kind).json(path).select("id", "question", F.posexplode("paragraphs").alias("place", "p"))
    return rows.select("id", "question", "place", "p.title", F.substring(F.concat_ws("\n", "p.title", "p.paragraph_text"), 1, 2000).alias("memory"), F.col("p.is_supporting").alias("supporting"))


GAINS = {"Exact": 1.0, "Substitute": 0.1, "Complement": 0.01, "Irrelevant": 0.0}


def graded(rows: DataFrame) -> DataFrame:
    """Products for queries with the gain of their label."""
    gain = F.coalesce(*(F.when(F.col("esci_label").isin(k, k[0]), F.lit(v)) for k, v in GAINS.items()))
    return rows.withColumn("gain", gain)
