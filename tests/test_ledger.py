"""The ledger's writes and reads, and text functions, on hand-made rows with the values they must give."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import text
from ledgerlens.operators import ledger


def at(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=n)


def writes(spark, *rows):
    return spark.createDataFrame([("p", t, c, k, at(k), None, None) for k, t, c in rows], ledger.WRITE)


def none(spark, schema):
    return spark.createDataFrame([], schema)


def states(spark, *rows):
    return spark.createDataFrame([("p", t, v, v, c, None, None, at(v), None, at(99) if gone else None) for t, v, c, gone in rows], ledger.STATE)


def test_verdicts_and_chain(spark):
    rows = writes(spark, (1, "a", "   "), (2, "a", "deploys through ci"), (3, "a", "ok"), (4, "a", "deploys   through\nci"), (5, "a", "deploys by hand now"), (6, "b", "設定変更手順書式"), (7, "b", None))
    evidence, new, jobs = ledger.recorded(rows, none(spark, ledger.STATE), none(spark, ledger.EVIDENCE))
    assert {r.seq: (r.reason, r.evidence_version) for r in evidence.collect()} == {1: ("empty", 1), 2: ("promoted", 2), 3: ("too_short", 3), 4: ("restatement", 4), 5: ("promoted", 5), 6: ("promoted", 1), 7: ("empty", 2)}
    assert sorted((r.topic, r.version, r.supersedes) for r in new.collect()) == [("a", 1, None), ("a", 2, 1), ("b", 1, None)]
    assert {(r.kind, r.subject) for r in jobs.collect()} == {(k, t) for k in ("sync_index", "derive_mentions") for t in "ab"}
    more, again, _ = ledger.recorded(writes(spark, (8, "a", "deploys by  hand now"), (9, "a", "deploys no more")), new, evidence)
    assert [(r.seq, r.reason, r.evidence_version) for r in more.orderBy("seq").collect()] == [(8, "restatement", 6), (9, "promoted", 7)]
    assert [(r.version, r.supersedes) for r in again.collect()] == [(3, 2)]
    todo = spark.createDataFrame([("p", "a", "deploys by hand now"), ("p", "a", "all new text"), ("p", "b", "設定変更手順書式")], "project string, topic string, content string")
    assert [r.content for r in ledger.to_remember(todo, new, evidence).collect()] == ["all new text"]


def test_inverted_interval_and_bounds(spark):
    bad = spark.createDataFrame([("p", "a", "some content", 1, at(0), at(5), at(5))], ledger.WRITE)
    with pytest.raises(Exception, match="interval"):
        ledger.checked(bad).collect()
    held = spark.createDataFrame([(at(10), at(20))], "valid_from timestamp, valid_to timestamp")
    assert [held.where(ledger.holds_at(F.lit(at(n)))).count() for n in (9, 10, 19, 20)] == [0, 1, 1, 0]


def test_offsets_deletes_and_retirement(spark):
    rows = states(spark, ("a", 1, "one", False), ("a", 2, "two", True), ("a", 4, "four", False), ("a", 7, "seven", False), ("b", 1, "b one", False))
    asked = spark.createDataFrame([("p", "a", 1), ("p", "a", 9)], "project string, topic string, back int")
    got = {r.back: (r.version, r.actual, r.is_current, r.available) for r in ledger.version_back(rows, asked).collect()}
    assert got == {1: (4, 1, False, 3), 9: (1, 2, False, 3)}
    gone = spark.createDataFrame([("p", "a", 7)], "project string, topic string, version int")
    after = ledger.soft_delete(rows, gone, F.lit(at(50)))
    assert {r.topic: r.version for r in ledger.current(after).collect()} == {"a": 4, "b": 1}
    topics = spark.createDataFrame([("p", "a")], "project string, topic string")
    retired, jobs = ledger.retire(rows, topics, F.lit(at(50)))
    assert [r.topic for r in ledger.current(retired).collect()] == ["b"] and jobs.count() == 1
    unseen = spark.createDataFrame([("p", "a", 4)], "project string, topic string, version int")
    assert ledger.current(ledger.retire_seen(rows, unseen, F.lit(at(50)))[0]).count() == 2
    assert ledger.current(ledger.retire_seen(rows, gone, F.lit(at(50)))[0]).count() == 1
    assert [r.version for r in ledger.as_of(rows, F.lit(at(5)), F.lit(at(5))).where("topic = 'a'").collect()] == [4]
    with pytest.raises(ValueError):
        ledger.of_project(rows, "")
    assert ledger.of_project(rows, "other").count() == 0
    rest, counts = ledger.purge("p", states=rows)
    assert rest["states"].count() == 0 and [tuple(r) for r in counts.collect()] == [("states", 5)]


def test_names_and_upserts(spark):
    kind = "project string, topic_id long, name string"
    names = spark.createDataFrame([("p", 1, "old"), ("p", 2, "held")], kind)
    aliases = spark.createDataFrame([("p", 2, "other")], "project string, topic_id long, alias string")
    asked = spark.createDataFrame([("p", "old", "new"), ("p", "held", "old")], "project string, old string, new string")
    after, kept, refused = ledger.rename(names, aliases, asked)
    assert {r.name for r in after.collect()} == {"new", "held"} and {r.alias for r in kept.collect()} == {"other", "old"}
    assert [r.old for r in refused.collect()] == ["held"]
    who = spark.createDataFrame([("p", n) for n in ("new", "old", "other", "none")], "project string, name string")
    assert {(r.name, r.topic_id, r.by) for r in ledger.found(after, kept, who).collect()} == {("new", 1, "name"), ("old", 1, "alias"), ("other", 2, "alias")}
    rows = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, seq int, v string")
    new = spark.createDataFrame([(2, 3, "d"), (2, 2, "c"), (3, 1, "e")], "k int, seq int, v string")
    assert {tuple(r) for r in ledger.upsert(rows, new, ["k"], "seq").collect()} == {(1, 1, "a"), (2, 3, "d"), (3, 1, "e")}
    assert {tuple(r) for r in ledger.insert_if_absent(rows, new, ["k"]).collect()} == {(3, 1, "e")}
    assert ledger.may_defer(rows, 3) and not ledger.may_defer(rows, 2)


def test_trusted_files(spark):
    seen = spark.createDataFrame([("a", 5, at(1), at(1), 7), ("b", 5, at(1), at(1), 7), ("c", 5, at(1), at(3), 7)], "path string, size long, mtime timestamp, ctime timestamp, inode long")
    records = spark.createDataFrame([("a", 5, at(1), at(1), 7, "x", at(2)), ("b", 6, at(1), at(1), 7, "x", at(2)), ("c", 5, at(1), at(3), 7, "x", at(3))], "path string, size long, mtime timestamp, ctime timestamp, inode long, build string, read_at timestamp")
    assert [r.path for r in ledger.trusted(seen, records, "x").collect()] == ["a"] and ledger.trusted(seen, records, "y").count() == 0


def test_grep_and_spans(spark):
    content = "é" * 80 + " needle and " + "漢" * 80
    evidence, new, _ = ledger.recorded(writes(spark, (1, "a", content), (2, "a", "NEEDLE")), none(spark, ledger.STATE), none(spark, ledger.EVIDENCE))
    got = {r.seq: (r.byte, r.excerpt) for r in ledger.grep(evidence, "needle").collect()}
    raw = content.encode()
    a, b = 161 - 60, 161 + 60
    while raw[a] & 0xC0 == 0x80:
        a -= 1
    while raw[b] & 0xC0 == 0x80:
        b += 1
    assert got == {1: (161, "…" + raw[a:b].decode().strip() + "…"), 2: (0, "NEEDLE")}
    assert ledger.grep(evidence, "needle", folded=False).count() == 1
    spans = spark.createDataFrame([("p", "a", 0, 0, 2, "é"), ("p", "a", 1, 0, 2, "wrong")], "project string, topic string, ordinal int, byte_start long, byte_end long, text string")
    assert [(r.first.ordinal, r.wrong) for r in ledger.wrong_spans(spans, new).collect()] == [(1, 1)]
    assert ledger.wrong_spans(spans.where("ordinal = 0"), new).count() == 0


def test_text_functions(spark):
    def one(value, *columns):
        return tuple(spark.createDataFrame([(value,)], "x string").select(*columns).first())

    x = F.col("x")
    assert one("  a b \n c ", text.normal(x)) == ("a b c",)
    assert one("the technical debt is mounting", text.names(x, F.lit("db")), text.names(x, F.lit(""))) == (False, False)
    assert one("call the deploy service now", text.names(x, F.lit("deploy_service")), text.names(x, F.lit("Deploy-Service"))) == (True, True)
    assert one("a b #3", text.section_number(x, F.lit("a b")), text.section_number(x, F.lit("a")), text.section_number(x, x)) == (3, None, 1)
    assert one("f.md › A #2", text.file_of(x), text.belongs(x, F.lit("f.md"))) == ("f.md", True)
    assert one("notes.md #2 #3", text.file_of(x)) == ("notes.md",)
    assert one("file:a:b", text.locator_name(x)) == ("a:b",)
    assert one("2023/05/23 (Tue) 13:01", text.session_date(x)) == (datetime.datetime(2023, 5, 23, 13, 1),)
    assert one("1:56 pm on 8 May, 2023", text.session_date(x)) == (datetime.datetime(2023, 5, 8, 13, 56),)
    assert one("no date", text.session_date(x), text.rfc3339(x)) == (None, None)
    assert one("2024-02-03T04:05:06+02:00", text.rfc3339_text(text.rfc3339(x))) == ("2024-02-03T02:05:06Z",)
    assert one("D8:6; D9:017, D:3", text.evidence_ids(x)) == (["D8:6", "D9:17"],)
    assert one("D1:3/x", text.topic_id(x)) == ("D1_3_x",)
    assert one("the Duke of York met Ann Lee", text.proper_names(x)) == (["Duke of York", "Ann Lee"],)
    assert one("naïve 漢字", text.byte_slice(x, F.lit(2), F.lit(4)), text.byte_offset(x, F.lit(4))) == ("ï", 4)
    assert one("the cat is on the mat and it was for us", text.detect_language(x)) == ("en",) and one("漢字", text.detect_language(x)) == (None,)
    assert one("one two", text.jaccard(x, F.lit("One, TWO")), text.jaccard(x, F.lit(""))) == (1.0, 0.0)
    assert one("", text.jaccard(x, F.lit(""))) == (1.0,)
    row = spark.createDataFrame([([1.0, 0.1], [0.0, 0.0])], "a array<float>, b array<float>").select(text.cosine("a", "b"), text.cosine("a", "a"), text.half_precision("a")).first()
    assert row[0] == 0.0 and row[1] == pytest.approx(1.0) and row[2] == pytest.approx([1.0, 0.0999755859375])
    sizes = spark.createDataFrame([(5,), (100_000,), (9_000_000,)], "n long").select(text.segment_documents(F.col("n"))).collect()
    assert [r[0] for r in sizes] == [10_000, 25_000, 250_000]
