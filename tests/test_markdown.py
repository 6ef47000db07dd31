"""Packing and sectioning on hand-made texts; the frames on small tables."""

import random

import pytest

from ledgerlens.functions import markdown as md

MIXED = """# Title

Some prose here. It has sentences! Does it end? Yes.

## Code

```py
def f():
    return "# no heading"

x = 1
```

| a | b |
|---|:-:|
| 1 | 2 |
| 3 | 4 |

[2024-05-01] Ann: hello there
still Ann talking

user: what now
Ünïcode wörds 漢字 follow each other without an end """ + " ".join(f"w{k}" for k in range(60))


@pytest.mark.parametrize("cap", range(1, 40))
def test_spans_partition_the_text(cap):
    spans, tokens = md.pack("name", MIXED, cap=cap), md.Tokens()
    at = 0
    for k, s in enumerate(spans):
        assert s.ordinal == k and MIXED[s.a : s.b] == s.text and s.a >= at and not MIXED[at : s.a].strip()
        assert tokens.count(s.text) <= cap and tokens.count(s.header) <= md.HEADER_CAP
        at = s.b
    assert not MIXED[at:].strip()


def test_short_texts_stay_whole():
    assert [(s.text, s.header) for s in md.pack("n", "  short\n")] == [("  short\n", "n")]
    assert len(md.pack("n", "")) == 1


def test_headings_open_and_never_end_a_span():
    text = "# One\n\n" + "a b c d. " * 6 + "\n\n# Two\n\n" + "e f g h. " * 6
    spans = md.pack("n", text, cap=30)
    assert [s.text.split("\n")[0] for s in spans if s.text.startswith("#")] == ["# One", "# Two"]
    assert not any(s.text.rstrip().split("\n")[-1].startswith("#") for s in spans)
    assert "n > One" in {s.header for s in spans} or len(spans) == 2
    rows = "| h1 | h2 |\n|---|---|\n" + "\n".join(f"| {k} | {k} |" for k in range(30))
    assert md.pack("n", rows, cap=40)[1].header == "n > | h1 | h2 |"


def test_lines():
    assert md.heading_of("## A title ##") == (2, "A title") and md.heading_of("#no") is None and md.heading_of("    # deep") is None and md.heading_of("#") == (1, "")
    assert md.heading_of("# C#") == (1, "C#")
    assert md.fence_of("~~~~ x") == ("~", 4) and md.fence_ends("~~~~~", ("~", 4)) and not md.fence_ends("~~~", ("~", 4))
    assert md.speaker_of("[1 May] Bob: hi") == "1 May, Bob" and md.speaker_of("Assistant: x") == "Assistant" and md.speaker_of("note: x") is None
    assert md.table_opens("| a | b |", "|--|--|") and not md.table_opens("a | b", "--")
    assert [md.underline_level(x) for x in ("===", "--", "-=")] == [1, 2, None]
    assert all(map(md.container_opens, ["> q", "- item", "12) x", "<div>", "| a"])) and not md.container_opens("1x")


BODY = "word " * 60


def test_sections():
    text = f"---\ntitle: x\n---\nlead {BODY}\n\n# A\n{BODY}\n\n## B\n{BODY}\n```\n# not one\n```\n\nSetext title\n===\n{BODY}\n# A\n{BODY}\n# Tiny\nfew words\n"
    got = md.unnamed("f.md", text)
    assert [b for b, _ in got] == ["f.md", "f.md › A", "f.md › A › B", "f.md › Setext title", "f.md › A"]
    assert "few words" in got[-1][1] and "not one" in got[2][1]
    assert md.parents([b for b, _ in got]) == [(1, 0), (2, 1), (3, 0), (4, 0)]
    assert md.named(got, []) == ["f.md", "f.md › A", "f.md › A › B", "f.md › Setext title", "f.md › A #2"]
    # the second A came first before: it keeps its name and the other takes the next
    assert md.named(got, [("f.md › A", got[4][1])])[4] == "f.md › A"
    assert md.unnamed("e.md", "") == [] and md.unnamed("e.md", "# Only\n") == [("e.md › Only", "# Only")]


def test_numbers_pairs_similarity():
    assert [md.number_of(n, "a") for n in ("a", "a #2", "a #1", "a #x", "b")] == [1, 2, None, None, None]
    assert md.similarity("one two", "One, two!") == 1.0 and md.similarity("", "") == 1.0
    assert md.pairs(["x y z w", "same"], ["same", "x y z w v"], 0.5) == [(1, 0), (0, 1)]
    r = random.Random(1)
    now = [" ".join(r.choice("abcdef") for _ in range(6)) for _ in range(8)]
    assert sorted(md.pairs(now, now[::-1])) == [(k, 7 - k) for k in range(8)] or len(set(now)) < 8


def test_view_grows_on_the_nearer_side():
    spans = [(k, n) for k, n in enumerate([100, 50, 50, 400, 50])]
    assert md.grown(spans, 2, 200) == (0, 2) and md.grown(spans, 2, 60) == (2, 2) and md.grown(spans, 3, 10_000) == (0, 4)


def test_frames(spark):
    topics = spark.createDataFrame([(1, "n", MIXED), (2, "m", None), (3, None, "é é")], "topic_id long, name string, content string")
    rows = md.span_frame(topics, cap=20).collect()
    assert all(MIXED.encode()[r.byte_start : r.byte_end].decode() == r.text for r in rows if r.topic_id == 1)
    assert {r.topic_id for r in rows} == {1, 2, 3}
    files = spark.createDataFrame([("f.md", f"# A\n{BODY}\n# B\n{BODY}x"), ("g.md", None)], "path string, text string")
    first = md.section_frame(files)
    assert [(r.name, r.parent) for r in first.orderBy("place").collect()] == [("f.md › A", None), ("f.md › B", "f.md › A")]
    later = md.section_frame(spark.createDataFrame([("f.md", f"# A\n{BODY}")], "path string, text string"), first.select("path", "name", "content"))
    gone = md.gone_sections(later, first.select("path", "name"), spark.createDataFrame([("f.md",)], "path string"), False)
    assert [tuple(r) for r in gone.collect()] == [("f.md", "f.md › B", "cut away")]
