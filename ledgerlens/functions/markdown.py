"""Markdown as far as packing and sectioning read it: lines that open something, sections under headings, spans under a cap.

Everything here is plain Python over one text, greedy and in order, which no column expression can say; `span_frame` and
`section_frame` apply it in Arrow batches. Positions are code points; the frames give UTF-8 bytes.

Defined cases: an empty or null text is one span, and no section; a text of any length is cut; a single token above the cap is a span of its own.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, replace
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAP, HEADER_CAP, VIEW = 200, 32, 600
LEAST, TITLE, SAME = 48, 80, 0.8
ABOVE = " › "
WORDLIKE = re.compile(r"\w+|[^\w\s]")


class Tokens:
    """Plug point: counts a text's tokens and says where they begin. This one takes words and single marks."""

    def starts(self, text: str) -> list[int]:
        return [m.start() for m in WORDLIKE.finditer(text)]

    def count(self, text: str) -> int:
        return sum(1 for _ in WORDLIKE.finditer(text))


# --- lines


def shallow(line: str) -> str | None:
    """The line without an indent of at most three blanks; None if it is deeper."""
    rest = line.lstrip(" ")
    return rest if len(line) - len(rest) <= 3 else None


def fence_of(line: str) -> tuple[str, int] | None:
    m = re.match(r"(`{3,}|~{3,})", shallow(line) or "")
    return (m[0][0], len(m[0])) if m else None


def fence_ends(line: str, opened: tuple[str, int]) -> bool:
    mark, size = opened
    rest = shallow(line)
    return rest is not None and (after := rest.lstrip(mark)).strip() == "" and len(rest) - len(after) >= size


def heading_of(line: str) -> tuple[int, str] | None:
    """Level and title of a heading marked by number signs; a closing run of them is no part of the title."""
    m = re.fullmatch(r"(#{1,6})(?:\s+(.*))?", (shallow(line) or "").rstrip(), re.DOTALL)
    if m is None:
        return None
    title = (m[2] or "").strip()
    return len(m[1]), re.sub(r"(^|\s+)#+$", "", title).rstrip()


def underline_level(line: str) -> int | None:
    m = re.fullmatch(r"(=+|-+)\s*", shallow(line) or "")
    return (1 if m[1][0] == "=" else 2) if m else None


def row_cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().removeprefix("|").removesuffix("|").split("|")]


def table_opens(line: str, after: str) -> bool:
    rule = row_cells(after)
    return "|" in line and "|" in after and len(rule) == len(row_cells(line)) and all(re.fullmatch(":?-+:?", c) for c in rule)


def speaker_of(line: str) -> str | None:
    """Who speaks: `[date] name:` or a role at the line's beginning."""
    line = line.split("\n", 1)[0]
    if m := re.match(r"\[([^\]]{1,64})\]([^:]+):(?=\s|$)", line):
        who = m[2].strip()
        return None if len(m[2].lstrip()) > 64 else f"{m[1]}, {who}" if who else m[1]
    m = re.match(r"(user|assistant|system):", line, re.IGNORECASE)
    return m[1] if m else None


_TAGS = set("p div section nav aside article header footer ul ol li dl table pre form fieldset hr h6 h5 h4 h3 h2 h1 figure figcaption details dialog blockquote address script".split())


def container_opens(line: str) -> bool:
    """Quotes, tables, lists and blocks of HTML, whose lines can't be the title above an underline."""
    rest = shallow(line)
    if rest is None:
        return False
    if rest.startswith((">", "|", "<!--")) or re.match(r"([-*+]|\d+[.)])( |$)", rest):
        return True
    m = re.match(r"</?([A-Za-z0-9]+)(?=[ >/]|$)", rest)
    return m is not None and m[1].lower() in _TAGS


def stripped(text: str, a: int, b: int) -> tuple[int, int]:
    part = text[a:b]
    left = a + len(part) - len(part.lstrip())
    return left, max(left, a + len(part.rstrip()))


# --- packing


@dataclass
class Block:
    kind: str
    a: int
    b: int


def blocks_of(text: str) -> list[Block]:
    ends = [m.start() for m in re.finditer("\n", text)] + [len(text)]
    lines = [(a + 1, b) for a, b in pairwise([-1, *ends])]
    at = lambda k: text[lines[k][0] : lines[k][1]]
    special = lambda s: fence_of(s) or heading_of(s) or speaker_of(s)
    out, k = [], 0
    while k < len(lines):
        first, line = k, at(k)
        k += 1
        if not line.strip():
            continue
        if opened := fence_of(line):
            kind = "fence"
            while k < len(lines):
                k += 1
                if fence_ends(at(k - 1), opened):
                    break
        elif heading_of(line):
            kind = "heading"
        elif speaker_of(line):
            kind = "turn"
            while k < len(lines) and not special(at(k)):
                k += 1
        else:
            kind = "table" if k < len(lines) and table_opens(line, at(k)) else "paragraph"
            while k < len(lines) and at(k).strip() and not special(at(k)):
                k += 1
        out.append(Block(kind, *stripped(text, lines[first][0], lines[k - 1][1])))
    return out


@dataclass
class Unit:
    a: int
    b: int
    tokens: int
    opens: bool = False
    heading: bool = False
    under: int | None = None
    goes_on: int | None = None


def evenly(text: str, a: int, b: int, tokens: Tokens, cap: int) -> list[tuple[int, int, int]]:
    """A stretch above the cap, cut at token boundaries into pieces as equal as can be."""
    starts = tokens.starts(text[a:b])
    pieces = max(1, -(-len(starts) // max(1, cap)))
    while True:
        edges = [a, *(a + starts[k * len(starts) // pieces] for k in range(1, pieces)), b]
        cut = [(x, y, tokens.count(text[x:y])) for x, y in (stripped(text, *e) for e in pairwise(edges)) if x < y]
        if pieces >= len(starts) or all(n <= cap for *_, n in cut):
            return cut
        pieces += 1


def units_of(text: str, blocks: list[Block], tokens: Tokens, cap: int) -> list[Unit]:
    out: list[Unit] = []
    under = None
    for k, block in enumerate(blocks):
        if block.kind == "heading":
            under = k
        common = {"heading": block.kind == "heading", "under": under, "goes_on": k if block.kind in ("turn", "table") else None}
        n = tokens.count(text[block.a : block.b])
        if n <= cap:
            out.append(Unit(block.a, block.b, n, opens=block.kind == "heading", **common))
            continue
        # code and tables part between lines, prose after sentences
        edge = r"\n" if block.kind in ("fence", "table") else r"(?<=[.!?。！？])[\"'”’)\]]*\s+|(?<=[。！？])|\n{2,}"
        bounds = [block.a, *(block.a + m.end() for m in re.finditer(edge, text[block.a : block.b])), block.b]
        first = True
        for a, b in (stripped(text, *e) for e in pairwise(bounds)):
            if a == b:
                continue
            m = tokens.count(text[a:b])
            for x, y, c in [(a, b, m)] if m <= cap else evenly(text, a, b, tokens, cap):
                out.append(Unit(x, y, c, opens=first and block.kind == "heading", **common))
                first = False
    return out


def fitting(text: str, room: int, tokens: Tokens) -> str:
    """As much of a text's head as counts at most `room` tokens."""
    starts = tokens.starts(text)
    if len(starts) <= room:
        return text
    for k in range(room, 0, -1):
        head = text[: starts[k]].rstrip()
        if tokens.count(head) <= room:
            return head
    return ""


def header_of(name: str, parts: list[str | None], tokens: Tokens) -> str:
    out = name
    for part in filter(None, parts):
        for room in range(HEADER_CAP - tokens.count(out), 0, -1):
            piece = fitting(part, room, tokens)
            if not piece:
                break
            if tokens.count(f"{out} > {piece}") <= HEADER_CAP:
                out = f"{out} > {piece}"
                break
    return fitting(out, HEADER_CAP, tokens)


@dataclass
class Span:
    ordinal: int
    a: int
    b: int
    header: str
    text: str
    tokens: int


@dataclass
class _Open:
    """A span in the making: its first unit says what it continues."""

    first: Unit
    b: int
    tokens: int
    only_headings: bool

    def take(self, u: Unit) -> None:
        self.b, self.tokens, self.only_headings = u.b, self.tokens + u.tokens, self.only_headings and u.heading


def pack(name: str, text: str, tokens: Tokens | None = None, cap: int = CAP) -> list[Span]:
    """A text whole if it counts at most `cap` tokens, else packed from its blocks in order; a heading opens a span."""
    tokens = tokens or Tokens()
    total = tokens.count(text)
    blocks = blocks_of(text) if total > cap else []
    todo = units_of(text, blocks, tokens, cap)[::-1]
    if not todo:
        return [Span(0, 0, len(text), name, text, total)]
    done: list[_Open] = []
    now: _Open | None = None
    while todo:
        u = todo.pop()
        if now is None:
            now = _Open(u, u.b, u.tokens, u.heading)
        elif now.tokens + u.tokens <= cap and (now.only_headings or not u.opens):
            now.take(u)
        elif now.only_headings and not u.heading and (head := fitting(text[u.a : u.b], max(0, cap - now.tokens), tokens)):
            # headings don't end a span: the head of what follows goes with them
            now.take(replace(u, b=u.a + len(head), tokens=tokens.count(head)))
            done, now = [*done, now], None
            a, b = stripped(text, u.a + len(head), u.b)
            if a < b:
                n = tokens.count(text[a:b])
                rest = [(a, b, n)] if n <= cap else evenly(text, a, b, tokens, cap)
                todo += [replace(u, a=x, b=y, tokens=c, opens=False) for x, y, c in reversed(rest)]
        else:
            done, now = [*done, now], _Open(u, u.b, u.tokens, u.heading)
    if now is not None:
        done.append(now)
    out = []
    for k, s in enumerate(done):
        before = lambda block: block is not None and blocks[block].a < s.first.a  # noqa: B023, E731
        title = heading_of(text[blocks[s.first.under].a : blocks[s.first.under].b]) if before(s.first.under) else None
        opening = None
        if before(s.first.goes_on):
            block = blocks[s.first.goes_on]
            opening = speaker_of(text[block.a : block.b]) if block.kind == "turn" else text[block.a : block.b].split("\n", 1)[0].strip()
        out.append(Span(k, s.first.a, s.b, header_of(name, [title[1] if title else None, opening], tokens), text[s.first.a : s.b], s.tokens))
    return out


def grown(spans: list[tuple[int, int]], best: int, room: int = VIEW) -> tuple[int, int]:
    """Which spans (tokens, by ordinal) a view shows: from the best one outward, the nearer side first, while they fit."""
    low = high = best
    left = room - spans[best][1]
    down, up = True, True
    while down or up:
        lower = down and (not up or best - (low - 1) <= (high + 1) - best)
        k = low - 1 if lower else high + 1
        if 0 <= k < len(spans) and spans[k][1] <= left:
            left -= spans[k][1]
            low, high = min(low, k), max(high, k)
        elif lower:
            down = False
        else:
            up = False
    return spans[low][0], spans[high][0]


# --- sections


def unnamed(path: str, text: str, tokens: Tokens | None = None) -> list[tuple[str, str]]:
    """(base, content) of a file's sections: cut at headings outside fences; small ones join a neighbour."""
    tokens = tokens or Tokens()
    text = re.sub("\r\n?", "\n", text.removeprefix("﻿"))
    begin = _after_front_matter(text)
    found = [s for s in _headed(text, begin) if text[s[1] : s[2]].strip()]
    kept: list[list] = []
    waiting = None
    for titles, a, b, body in found:
        if waiting is not None:
            a, body, waiting = waiting[1], body or waiting[3], None
        section = [titles, a, b, body]
        if tokens.count(text[a:b]) >= LEAST:
            kept.append(section)
        elif kept and body:
            kept[-1][2] = b
        else:
            waiting = section
    if waiting is not None:
        if kept:
            kept[-1][2] = waiting[2]
        else:
            kept.append(waiting)
    return [(ABOVE.join([path, *titles]), text[a:b].strip()) for titles, a, b, _ in kept if text[a:b].strip()]


def _after_front_matter(text: str) -> int:
    if not re.match(r"---\n[\w-]+:", text):
        return 0
    at = 4
    for line in text[4:].splitlines(keepends=True):
        at += len(line)
        if line.rstrip() in ("---", "..."):
            return at
        if not line.strip():
            break
    return 0


def _headed(text: str, begin: int):
    """(titles above, first, last, has a body) for the stretch under each heading."""
    stack: list[tuple[int, str]] = []
    out, start, body = [], begin, False
    opened, inside = None, False
    paragraph: tuple[int, list[str], bool] | None = None

    def cut(at: int, level: int, title: str, had_body: bool) -> None:
        nonlocal start, body, stack
        if at > start or had_body:
            out.append(([t for _, t in stack], start, at, had_body))
        stack = [x for x in stack if x[0] < level] + ([(level, title[:TITLE])] if title else [])
        start, body = at, False

    at = begin
    for line in text[begin:].splitlines(keepends=True) if "\n" in text[begin:] else [text[begin:]]:
        here, at = at, at + len(line)
        line = line.removesuffix("\n")
        if opened:
            opened = None if fence_ends(line, opened) else opened
            body = True
        elif opened := fence_of(line):
            paragraph, inside, body = None, False, True
        elif paragraph and (level := underline_level(line)):
            (first, lines, had_body), paragraph = paragraph, None
            cut(first, level, " ".join(lines), had_body)
        elif marked := heading_of(line):
            paragraph, inside = None, False
            cut(here, marked[0], marked[1], body)
        else:
            filled = bool(line.strip())
            inside = filled and (inside or container_opens(line))
            if not filled or inside:
                paragraph = None
            elif paragraph:
                paragraph[1].append(line.strip())
            elif shallow(line) is not None:
                paragraph = (here, [line.strip()], body)
            body |= filled
    out.append(([t for _, t in stack], start, len(text), body))
    return out


def shingles(text: str) -> set[tuple[str, ...]]:
    """Three-word shingles of lower-case words; one of what there is, if there are fewer."""
    words = re.findall(r"[^\W_]+", text.lower())
    return {tuple(words[k : k + 3]) for k in range(len(words) - 2)} if len(words) >= 3 else {tuple(words)}


def similarity(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def pairs(now: list[str], before: list[str], least: float = SAME) -> list[tuple[int, int]]:
    """One-to-one, the likest first: equal texts, then by similarity."""
    scored = [(2.0 if x == y else similarity(y, x), k, j) for k, x in enumerate(now) for j, y in enumerate(before)]
    used_now, used_before, out = set(), set(), []
    for score, k, j in sorted(scored, key=lambda s: (-s[0], s[1], s[2])):
        if score >= least and k not in used_now and j not in used_before:
            used_now.add(k)
            used_before.add(j)
            out.append((k, j))
    return out


def number_of(name: str, base: str) -> int | None:
    """1 for the base itself, n for `base #n` with n of 2 or more."""
    if name == base:
        return 1
    m = re.fullmatch(r" #([0-9]+)", name[len(base) :]) if name.startswith(base) else None
    return int(m[1]) if m and int(m[1]) >= 2 else None


def named(sections: list[tuple[str, str]], earlier: list[tuple[str, str]]) -> list[str]:
    """Names for (base, content): those of the earlier sections that they are like, otherwise the next free number."""
    groups = defaultdict(list)
    for k, (base, _) in enumerate(sections):
        groups[base].append(k)
    names: dict[int, str] = {}
    for base in sorted(groups):
        old = [x for x in earlier if number_of(x[0], base) is not None]
        for k, j in pairs([sections[i][1] for i in groups[base]], [c for _, c in old]):
            names[groups[base][k]] = old[j][0]
    taken: set[str] = set()
    for k in sorted(names):
        if names[k] in taken:
            del names[k]
        else:
            taken.add(names[k])
    for k, (base, _) in enumerate(sections):
        if k not in names:
            n = 1
            while (name := base if n == 1 else f"{base} #{n}") in taken:
                n += 1
            names[k] = name
            taken.add(name)
    return [names[k] for k in range(len(sections))]


def parents(bases: list[str]) -> list[tuple[int, int]]:
    """(section, parent): the first section of the nearest heading above it, otherwise the file's first."""
    first = {b: k for k, b in reversed(list(enumerate(bases)))}
    out = []
    for k, base in enumerate(bases):
        above = base
        while ABOVE in above:
            above = above.rsplit(ABOVE, 1)[0]
            if first.get(above, k) < k:
                out.append((k, first[above]))
                break
        else:
            if k:
                out.append((k, 0))
    return out


# --- frames

#: Contents whose spans are held at once.
ROWS = 64


def span_frame(topics: DataFrame, tokens: type[Tokens] = Tokens, cap: int = CAP) -> DataFrame:
    """topic_id, ordinal, byte_start, byte_end, header, text, tokens of the spans of (topic_id, name, content)."""

    def run(batches):
        counter = tokens()
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            rows = []
            for topic, name, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                content = content or ""
                for s in pack(name or "", content, counter, cap):
                    a = len(content[: s.a].encode())
                    rows.append((topic, s.ordinal, a, a + len(s.text.encode()), s.header, s.text, s.tokens))
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            names = ["topic_id", "ordinal", "byte_start", "byte_end", "header", "text", "tokens"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    kind = topics.schema["topic_id"].dataType.simpleString()
    return topics.select("topic_id", "name", "content").mapInArrow(run, f"topic_id {kind}, ordinal int, byte_start long, byte_end long, header string, text string, tokens int")


def section_frame(files: DataFrame, earlier: DataFrame | None = None, tokens: type[Tokens] = Tokens) -> DataFrame:
    """path, place, base, name, parent, content: the sections of (path, text), named after those that were there before (path, name, content)."""
    spark = files.sparkSession
    earlier = spark.createDataFrame([], "path string, name string, content string") if earlier is None else earlier
    # a file's earlier sections travel with it: one row a file on either side
    before = earlier.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("name", "content"))).alias("before"))

    def run(batches):
        counter = tokens()
        for batch in batches:
            rows = []
            for path, text, old in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                cut = unnamed(path, text or "", counter)
                names = named(cut, [(x["name"], x["content"]) for x in old or []])
                above = dict(parents([b for b, _ in cut]))
                rows += [(path, k, base, names[k], names[above[k]] if k in above else None, content) for k, (base, content) in enumerate(cut)]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "place", "base", "name", "parent", "content"])

    return files.select("path", "text").join(before, "path", "left").mapInArrow(run, "path string, place int, base string, name string, parent string, content string")


def gone_sections(now: DataFrame, recorded: DataFrame, read: DataFrame, whole_tree: bool) -> DataFrame:
    """Recorded sections (path, name) that are there no more: of files that were read, or, if the whole tree was walked, of files that aren't in it."""
    missing = recorded.join(now.select("name").distinct(), "name", "left_anti")
    seen = missing.join(read.select("path").distinct().withColumn("seen", F.lit(True)), "path", "left")
    return seen.where(F.col("seen") if not whole_tree else F.lit(True)).select("path", "name", F.when(F.col("seen"), "cut away").otherwise("file gone").alias("reason"))
