"""Sources, the store with its projection, the queue and the stream, each on small files."""

import datetime
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

from ledgerlens.operators import ledger
from ledgerlens.sources import readers
from ledgerlens.sources.store import Session, Store
from ledgerlens.streaming import cascade


def at(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=n)


def test_lines_of_json(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("".join(json.dumps({"topic": t, "content": c}) + "\n" for t, c in [("a", "first of a"), ("b", "first of b"), ("a", "second of a")]))
    rows = readers.memories(spark, str(tmp_path / "m.jsonl"), "p").collect()
    assert sorted((r.topic, r.seq, r.content) for r in rows) == [("a", 1, "first of a"), ("a", 2, "second of a"), ("b", 1, "first of b")]
    (tmp_path / "bad.jsonl").write_text('{"topic": "a", "content": "fine"}\nnot json\n')
    with pytest.raises(Exception, match="not a memory"):
        readers.memories(spark, str(tmp_path / "bad.jsonl"), "p").collect()


def test_trees(spark, tmp_path):
    for name, data in {"a.md": b"# A", "sub/b.TXT.txt": "é".encode(), "sub/c.py": b"x", ".hidden/d.md": b"x", "skip/e.md": b"x", "bad.md": b"\xff\xfe", "keep.md": b"k"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rules = readers.ignores(["# rules", "skip/", "keep.*", "!keep.md"])
    got = {r.path: (r.text, r.problem) for r in readers.files(spark, str(tmp_path), rules).collect()}
    assert got == {"a.md": ("# A", None), "sub/b.TXT.txt": ("é", None), "bad.md": (None, "not UTF-8"), "keep.md": ("k", None)}
    assert readers.ignored("x/build/y.md", readers.ignores(["build/"])) and not readers.ignored("build", readers.ignores(["build/"]))
    assert readers.ignored("x/a.md", readers.ignores(["/a.md"], "x")) and not readers.ignored("y/x/a.md", readers.ignores(["/a.md"], "x"))


def test_data_sets(spark, tmp_path):
    talk = [{"sample_id": "c1", "conversation": {"session_1": [{"dia_id": "D1:1", "speaker": "A", "text": "hi"}, {"dia_id": "D1:2", "speaker": "B", "text": "yo"}], "session_1_date_time": "1:56 pm on 8 May, 2023", "speaker_a": "A"}, "qa": [{"question": "q", "adversarial_answer": "no", "category": 5, "evidence": ["D1:1"]}]}]
    (tmp_path / "talk.json").write_text(json.dumps(talk))
    assert [tuple(r) for r in readers.session_turns(spark, str(tmp_path / "talk.json")).orderBy("turn").collect()] == [("c1", 1, "1:56 pm on 8 May, 2023", 0, "D1:1", "A", "hi"), ("c1", 1, "1:56 pm on 8 May, 2023", 1, "D1:2", "B", "yo")]
    assert [tuple(r)[:4] for r in readers.session_questions(spark, str(tmp_path / "talk.json")).collect()] == [("c1", "q", "no", 5)]
    hay = [{"question_id": "1", "question_type": "t", "question": "q", "answer": "a", "answer_session_ids": ["s2"], "haystack_session_ids": ["s1", "s2"], "haystack_dates": ["d1", "d2"], "haystack_sessions": [[{"role": "user", "content": "x"}], [{"role": "user", "content": "y", "has_answer": True}]]}]
    (tmp_path / "hay.json").write_text(json.dumps(hay))
    assert [(r.session_id, r.gold, r.content, r.has_answer) for r in readers.haystacks(spark, str(tmp_path / "hay.json")).orderBy("session_id").collect()] == [("s1", False, "x", False), ("s2", True, "y", True)]
    (tmp_path / "par.jsonl").write_text(json.dumps({"id": "1", "question": "q", "paragraphs": [{"title": "T", "paragraph_text": "p" * 3000, "is_supporting": True}]}))
    [row] = readers.paragraphs(spark, str(tmp_path / "par.jsonl")).collect()
    assert (row.title, len(row.memory), row.supporting) == ("T", 2000, True)
    assert [r.gain for r in readers.graded(spark.createDataFrame([("Exact",), ("S",), ("odd",)], "esci_label string")).collect()] == [1.0, 0.1, None]


def test_store_and_session(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @pandas_udf(ArrayType(FloatType()))
    def encoder(text):
        calls.add(len(text))
        return text.map(lambda t: [float(len(t))])

    store = Store(spark, str(tmp_path / "store"), "v1", encoder)
    session = Session(store, "p")
    long = ". ".join(f"sentence number {k} of a long memory" for k in range(60))
    assert [session.write("a", c, k, at(k)) for k, c in enumerate(["short", long, long + " ", "another memory of it"], 1)] == ["too_short", "promoted", "restatement", "promoted"]
    assert session.write("b", "what b has to say", 5, at(5)) == "promoted"
    assert session.read("a").content == "another memory of it" and session.read("a", 7).content == long and session.read("none") is None
    assert [r.topic for r in session.topics().collect()] == ["b", "a"] and session.grep("NUMBER 7 ").count() == 2
    # the long version's further spans went with it
    spans = store.projection()
    assert sorted((r.topic, r.ordinal, r.text) for r in spans.collect()) == [("a", 0, "another memory of it"), ("b", 0, "what b has to say")]
    assert store.read("spans").where("NOT alive").count() > 1
    made = calls.value
    assert store.reindex() == 2 and calls.value == made  # all vectors were lent
    store.encoding = "v2"
    wanted = store.cut(ledger.current(store.read("states")))
    assert [r.held for r in store.holds(wanted).collect()] == [False, False]
    assert store.reindex() == 2 and calls.value > made
    before = sorted(map(str, store.read("evidence").collect()))
    store.compact("evidence")
    assert len(store.epochs("evidence")) == 1 and sorted(map(str, store.read("evidence").collect())) == before
    # an epoch that is written twice is written once
    twice = readers.single(spark, "p", "c", "a write that comes twice", 9, at(9))
    epoch = store.next_epoch()
    for _ in range(2):
        store.remember(twice, epoch)
    assert [(r.version, r.seq) for r in store.read("states").where("topic = 'c'").collect()] == [(1, 9)]
    session.retire("a", F.lit(at(60)))
    assert session.read("a") is None and store.projection().where("topic = 'a'").count() == 0
    assert store.purge("p")["states"] == 4 and store.read("evidence").count() == 0


def test_stream_of_writes(spark, tmp_path):
    inbox, done = tmp_path / "in", []
    inbox.mkdir()
    store = Store(spark, str(tmp_path / "store"))

    def file(name, *rows):
        (inbox / name).write_text("".join(json.dumps({"project": "p", "topic": t, "content": c, "seq": k, "recorded_at": at(k).isoformat()}) + "\n" for k, t, c in rows))

    def run():
        query = cascade.cascade(store, cascade.writes(spark, str(inbox)), str(tmp_path / "ck"), available_now=True, after=lambda jobs, epoch: done.append((epoch, jobs.count())))
        query.awaitTermination()

    file("1.json", (1, "a", "the first memory"), (2, "a", "the first  memory"), (3, "b", "tiny"))
    run()
    file("2.json", (4, "a", "the second memory"), (5, "a", "the first memory"))
    run()
    assert done == [(1, 2), (2, 2)]
    assert {(r.seq, r.reason) for r in store.read("evidence").collect()} == {(1, "promoted"), (2, "restatement"), (3, "too_short"), (4, "promoted"), (5, "promoted")}
    assert [(r.version, r.supersedes) for r in store.read("states").orderBy("version").collect()] == [(1, None), (2, 1), (3, 2)]


def test_queue(spark):
    job = lambda kind, subject, due, attempts=0: ("p", kind, subject, cascade.PRIORITY[kind], at(due), attempts, None, None, None)
    queue = spark.createDataFrame([job("derive_mentions", "a", 0), job("sync_index", "a", 5), job("sync_index", "b", 1), job("optimize", "x", 500), job("sync_index", "dead", 0, 8)], cascade.JOB)
    owed = spark.createDataFrame([("p", "sync_index", "dead"), ("p", "sync_index", "b"), ("p", "sync_index", "b")], "project string, kind string, subject string")
    revived = cascade.enqueue(queue, owed, F.lit(at(9)))
    assert revived.count() == 5 and cascade.exhausted(revived).count() == 0
    now = F.lit(at(10))
    after, taken = cascade.claim(queue, "w", now, 2)
    assert sorted((r.kind, r.subject, r.attempts) for r in taken.collect()) == [("sync_index", "a", 1), ("sync_index", "b", 1)]
    assert cascade.due(after, F.lit(at(69))).count() == 1 and cascade.due(after, F.lit(at(70))).count() == 3  # a lease ends
    later, stolen = cascade.claim(after, "v", F.lit(at(80)), 1, ["sync_index"])
    assert cascade.complete(later, taken).count() == 4  # only the claim that still stands
    failed = cascade.fail(after, taken, "broke", now)
    assert {(r.error, r.available_at) for r in failed.where("error IS NOT NULL").collect()} == {("broke", at(3610))}
    assert cascade.due(cascade.replay(queue, now), now).count() == 4 and cascade.discard(queue).count() == 4

    worked = []

    def work(jobs):
        subjects = [r.subject for r in jobs.collect()]
        if "b" in subjects:
            raise RuntimeError("no b")
        worked.extend(subjects)

    left, done = cascade.drain(queue, work, "w", now, 2)
    assert done == 2 and worked == ["a", "a"] and {r.subject: r.error for r in left.collect()} == {"b": "no b", "x": None, "dead": None}


def test_quiet_periods(spark):
    changes = [("r", "a", 0.0, False), ("r", "b", 0.9, False), ("r", "c", 2.5, False), ("r", "d", 10.0, True), ("r", "e", 11.5, False), ("q", "z", 0.0, True)] + [("s", f"f{k}", k * 0.9, False) for k in range(13)]
    rows = cascade.flushes(spark.createDataFrame(changes, "root string, path string, at double, gone boolean")).collect()
    got = {(r.root, r.flush): (r.paths, r.deleted) for r in rows}
    assert got["r", 1] == (["a", "b"], []) and got["r", 2] == (["c"], []) and got["r", 3] == (["d", "e"], ["d"]) and got["q", 1] == (["z"], ["z"])
    assert len(got["s", 1][0]) == 12 and got["s", 2][0] == ["f12"]  # ten seconds at most
    files = lambda *r: spark.createDataFrame(list(r), "path string, size long, mtime timestamp")
    hits = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    assert {r.path for r in cascade.stale(hits, files(("a", 1, at(1)), ("b", 1, at(1)), ("c", 1, at(1))), files(("a", 1, at(1)), ("b", 2, at(1)))).collect()} == {"b", "c"}
