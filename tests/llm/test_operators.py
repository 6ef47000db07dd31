"""Operators on small tables with nulls, empties, long texts, repeated rows and clashing columns, against brute force."""

import functools
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import byte_bpe, compression_quality, fingerprints, lattice_lm, near_dedup, packing, quality_rules, secret_scan, suffix_dedup, url_filter

PASSAGE = "a passage of text that stands in more than one document and is longer than fifty bytes, word for word. "
BASE = " ".join(f"word{i}" for i in range(120))
TEXTS = [
    (0, BASE), (1, BASE), (2, BASE.replace("word60", "other")), (3, None), (4, ""), (5, "x"), (6, PASSAGE + "tail é" * 9), (7, "head ü " + PASSAGE), (8, "y " * 6000),
    (9, "password = 'abcdefghijkl99' deadbeefdeadbeef00"), (9, "password = 'abcdefghijkl99' deadbeefdeadbeef00"), (None, "no id here"), (10, "One\ntwo\nOne\n\n$ %"),
]
#: Columns whose names are those that operators use or return.
CLASHES = ["__batch", "key", "words", "kept", "__id", "__y", "__live", "__words", "__owner", "__row", "__text", "__range", "__h", "__in0", "base", "hash", "vertex", "body", "n", "score", "spans", "ratio", "fingerprint", "rule", "host"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None if k == 5 else f"s{k % 3}", len(t or ""), *"x" * len(CLASHES)) for k, (i, t) in enumerate(TEXTS)], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 1, 0), (6, 1, 0), (8, 0, 0), (10, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_suffix_dedup(docs, empty):
    got = sorted((tuple(r) for r in suffix_dedup.dedup_windows(docs).collect()), key=str)
    first, want = {}, []
    for i, t in sorted(TEXTS, key=lambda x: (x[0] is None, x[0] or 0)):
        b, order = (t or "").encode(), 2**63 - 1 if i is None else i
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first.setdefault(b[j : j + 50], order) < order:
                gone[j : j + 50] = b"1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), len(b) - len(kept), len(re.findall(b"1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=str)
    assert suffix_dedup.dedup_windows(empty).count() == 0
    kept = suffix_dedup.dedup_windows(docs, keep_text=True)
    assert {"lang", "__batch", "key", "words", "kept"} <= set(kept.columns) and kept.count() == len(TEXTS)
    assert suffix_dedup.without_repeats(docs).columns == docs.columns


def test_rows_between_batches_and_buckets():
    # about the text of 6 GB of input, and the shuffle partitions that go with it
    batches, buckets = suffix_dedup.dealt(10_500_000_000, 600)
    assert batches >= 600 and buckets >= 600 and batches * buckets < 1_000_000
    assert suffix_dedup.dealt(0, 4) == (4, 4)


def test_no_pass_is_asked_twice(spark):
    docs = spark.createDataFrame([(1, PASSAGE), (2, PASSAGE)], "doc_id long, text string")
    plan = suffix_dedup.dedup_windows(docs)._jdf.queryExecution().logical().toString()
    # posts of the first pass and the answers of three; batches read answers in the second, the third and at the end
    assert (plan.count("FlatMapGroupsInArrow"), plan.count("FlatMapCoGroupsInArrow")) == (4, 3)


def test_rows_of_a_batch_in_another_order_each_pass():
    texts = ["a" + PASSAGE, "b" * 70 + PASSAGE[30:120] + "c", "", PASSAGE[:80] + "d" * 60 + PASSAGE[10:], "d" * 57, PASSAGE[5:]]
    ids = [4, 7, 5, 9, 2**63 - 1, 2**63 - 1]
    docs = pa.table({"__id": ids, "__text": texts, "__batch": [0] * len(ids)})
    schema = pa.schema([("__id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def said(posts):
        return pa.concat_tables(suffix_dedup._answer(posts.filter(pc.equal(posts["__bucket"], b))) for b in set(posts["__bucket"].to_pylist()))

    one = said(suffix_dedup._post_first(docs, 50, 3))
    two = said(suffix_dedup._post_second(docs.take([5, 3, 1, 0, 2, 4]), one, 50, 3))
    three = said(suffix_dedup._post_third(docs.take([4, 5, 2, 3, 0, 1]), two, 50, 3))
    got = suffix_dedup._finish(docs.take([1, 0, 4, 2, 5, 3]), three, 50, 3, False, schema).to_pylist()
    first, want = {}, []
    for i, t in sorted(zip(ids, texts, strict=True)):
        gone = bytearray(len(t))
        for j in range(len(t) - 49):
            if first.setdefault(t[j : j + 50], i) < i:
                gone[j : j + 50] = b"1" * 50
        kept = "".join(x for x, g in zip(t, gone, strict=True) if not g).encode()
        want.append((i, len(t), len(t) - len(kept), len(re.findall(b"1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert sorted(tuple(r.values()) for r in got) == sorted(want) and sum(w[2] for w in want)


def test_whole_copies_side_by_side(spark):
    texts = [PASSAGE * 3, PASSAGE, PASSAGE + "tail", "ü" + PASSAGE + "x" * 60, "", "x" * 55]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_removed, r.n_spans) for size in (300, 1 << 20) for r in suffix_dedup.dedup_windows(docs, batch_bytes=size).collect()}
    n = len(PASSAGE)
    assert got == {0: (0, 0), 1: (n, 1), 2: (n, 1), 3: (n, 1), 4: (0, 0), 5: (55, 1)}


def test_near_duplicates(docs, empty):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert {(0, 119, 0), (1, 119, 0), (2, 119, 0)} <= got
    assert {r[2] for r in got if r[0] in (3, 4)} == {3, 4} and (5, 1, 5) in got
    assert near_dedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("words", [2, 5])
def test_components_of_a_wide_cluster(spark, words):
    """Copies on both sides of the similarity, more than a short list holds, beside strangers: no link is lost."""
    r = random.Random(words)
    base, other = [f"b{i}" for i in range(150)], [f"o{i}" for i in range(150)]

    def copy(of, edits):
        out = list(of)
        for _ in range(edits):
            out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
        return " ".join(out)

    most = 24 if words == 2 else 11
    texts = [copy(base, r.randrange(most)) for _ in range(110)] + [copy(other, r.randrange(most)) for _ in range(50)] + [copy([f"z{r.randrange(900)}" for _ in range(60)], 0) for _ in range(40)]
    texts += [texts[0], texts[3], "A b C d e", "a B c d E", "one", None]
    r.shuffle(texts)
    ids = r.sample(range(1000), len(texts))

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()

    sets, component = [shingles(t) for t in texts], list(ids)
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for a, b in links:
        old, new = max(component[a], component[b]), min(component[a], component[b])
        component = [new if c == old else c for c in component]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, words=words).collect()}
    assert got == {i: (len(s), c, i == c) for i, s, c in zip(ids, sets, component, strict=True)}
    assert len(links) > 500 and len(set(component)) > 40


def test_ownership_decides(spark):
    live, example, quoted, varied = "abcdefghijkl99", "exampleexample01", "zyxwvutsrqpo42", "Zk9qLw3Vb7Rt2Xc8Mn4P"
    rows = [(k, f"s{k}", f"secret = {example}") for k in range(6)] + [(10, "s0", f"password: {live}"), (11, "s0", f"see {live} there"), (12, "s1", f"and {quoted}."), (13, "s2", varied), (14, None, f"key {varied} {varied}"), (14, None, f"key {varied} {varied}"), (15, "s3", f"as in {example}"), (16, "s4", None)]
    rows += [(20 + k, f"s{k}", f"sample Qk9qLw3Vb7Rt2Xc8Mn4P number {k}") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: r for r in secret_scan.scan(docs).collect()}
    # brute force: owners and repositories of each value
    found = []
    for i, o, t in set(rows):
        base = secret_scan.base_matches(t or "")
        found += [(i, o, v, k) for k, _, _, v in base + secret_scan.bare_runs(t or "", base)]
    owners, repositories = ({v: {(o, i) if k else o for i, o, x, _ in found if x == v} for *_, v, _ in found} for k in (0, 1))
    looks_live = {v for v in owners if not (len(owners[v]) > secret_scan.MOST_OWNERS and len(repositories[v]) > secret_scan.MOST_REPOSITORIES)}
    assert looks_live == {live, quoted, varied}
    labelled = {v for *_, v, k in found if k < 3}
    for i, _, t in rows:
        base = secret_scan.base_matches(t or "")
        added = [(k, a, b) for k, a, b, v in secret_scan.bare_runs(t or "", base) if v in looks_live and (secret_scan.varied(v) or v in labelled)]
        assert got[i]["spans"] == secret_scan.spelled([x[:3] for x in base] + added)
        assert got[i]["base_sha256"] == hashlib.sha256(secret_scan.spelled(x[:3] for x in base).encode()).hexdigest()
    assert got[11]["spans"] == "token:4:18" and got[12]["spans"] == "" and got[13]["spans"] == "token:0:20" and got[20]["spans"] == ""
    masked = {r["doc_id"]: r["text"] for r in secret_scan.mask(docs).collect()}
    assert masked[10] == masked[11].replace("see ", "").replace(" there", "") == "<SECRET>" and masked[0] == f"secret = {example}" and masked[12] == f"and {quoted}."
    assert masked[14] == "key <SECRET> <SECRET>" and masked[16] is None


def test_secrets(docs, empty):
    rows = secret_scan.scan(docs).collect()
    assert len(rows) == len(TEXTS)
    nine = [r for r in rows if r["doc_id"] == 9]
    assert len(nine) == 2 and all((r["n_assign"], r["n_access"], r["n_hex"]) == (1, 0, 1) for r in nine)
    assert all(r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest() for r in nine)
    masked = secret_scan.mask(docs)
    assert masked.columns == docs.columns and masked.count() == len(TEXTS)
    assert not [r for r in masked.collect() if "deadbeef" in (r["text"] or "")]
    assert secret_scan.scan(empty).count() == 0


def test_bpe_and_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for r in byte_bpe.bpe_roundtrip(docs, path).collect():
        assert r["decoded_sha256"] in {hashlib.sha256((t or "").encode()).hexdigest() for i, t in TEXTS if i == r["doc_id"]}
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(docs, path).collect()
    sizes = Counter()
    for r in pieces:
        sizes[r["sequence_id"]] += r["length"]
    assert max(sizes.values()) <= 2048 and sum(sizes.values()) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)
    assert byte_bpe.bpe_roundtrip(empty, path.replace("word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken")).count() == 0 and packing.pack(empty, path).count() == 0


def test_lattice_scores(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    words = {i: [*re.findall("[^\x20\x09-\x0d]+", (t or "").lower()), "\n"] for i, t in TEXTS}
    train = Counter(w for i, t in TEXTS if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in words[i])
    n, v = sum(train.values()), len(train)
    for r in lattice_lm.lattice_scores(docs, path).collect():
        ws = words[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(train[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0
    assert lattice_lm.lattice_scores(empty, path).count() == 0


def test_quality_rules(docs, empty, labels):
    for r in quality_rules.judged(docs, labels, prefix="q_").collect():
        text = r["text"] or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        windows = list(zip(w, w[1:], w[2:], strict=False))
        count = Counter(windows)
        repeated = {k + j for k, x in enumerate(windows) if count[x] > 1 for j in range(3)}
        want = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert tuple(r["q_" + c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["q_base_failed"] == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert not (r["q_base_failed"] and r["q_kept"])
    assert quality_rules.judged(empty, labels).count() == 0


def test_compression_quality(docs, empty, labels):
    rows = compression_quality.scores(docs, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert compression_quality.scores(empty, labels.limit(0)).count() == 0


def test_compression_quality_tells_classes_apart(spark):
    r = random.Random(4)
    words = [[f"{c}{r.randrange(10**6):x}" for _ in range(300)] for c in "gb"]
    rows = [(i, " ".join(r.choice(words[i % 2 if r.random() < 0.9 else r.randrange(2)]) for _ in range(r.randrange(20, 400)))) for i in range(240)]
    # repeated rows of an id, some with another text; a null text; an empty one
    docs = spark.createDataFrame([*rows, *rows[:30], (7, "g b " * 20), (500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = [compression_quality.scores(d, labels).collect() for d in (docs, docs.repartition(7))]
    assert sorted(map(tuple, got[0])) == sorted(map(tuple, got[1])) and len(got[0]) == len(rows) + 33
    held = [(x["score"], 1 - x["doc_id"] % 2) for x in got[0] if x["held_out"] and x["doc_id"] < 500]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in got[0])
    pairs = [a > b for a, y in held for b, z in held if y > z]
    assert sum(pairs) / len(pairs) > 0.95


def test_fingerprints(docs, empty):
    rows = fingerprints.fingerprints(docs).collect()
    assert len(rows) == len(TEXTS)
    order = sorted(((2**63 - 1 if i is None else i), t or "") for i, t in TEXTS)
    edited = Counter()
    for k, (_, t) in enumerate(order):
        half, after = len(t) // 2, order[(k + 1) % len(order)][1]
        edited[len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r["n_chars"], r["edited_sha256"]) for r in rows) == edited
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (0, 1)}) == 1
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    assert fingerprints.fingerprints(empty).count() == 0


def test_likeness_by_brute_force(spark):
    hashed = lambda *parts: functools.reduce(lambda seed, p: xxhash.xxh64_intdigest(p, seed=seed), parts, 42)

    def vector(text):
        exact, lanes = [0] * 4, [0] * fingerprints.LANES
        for line in text.split("\n"):
            for k in range(4):
                exact[k] = (exact[k] + (hashed(line.encode(), struct.pack("<i", k // 2)) >> (32 * (k % 2)) & 0xFFFFFFFF)) % 2**32
            words = re.findall("[^\x20\x09-\x0d]+", line)
            for k, w in enumerate(words):
                h = hashed(*(x.encode() for x in words[k : k + 2]))
                for j in range(fingerprints.LANES):
                    lanes[j] += h >> j & 1
        # lanes come in pairs j, j + LANES / 2
        return exact, [lanes[j + half] for j in range(fingerprints.LANES // 2) for half in (0, fingerprints.LANES // 2)]

    def like(a, b):
        if a == b:
            return 1.0
        x, y = np.array(a[1], float), np.array(b[1], float)
        return float(min(1.0, max(0.0, np.corrcoef(x, y)[0, 1]))) if x.std() and y.std() else 0.0

    texts = ["a b c d\ne f g a b", "e f g a b\na b c d", "", "one", " ".join(f"w{i % 7}" for i in range(90)), "x é\n\nx é", "a b c d\ne f g"]
    docs = spark.createDataFrame([(3 * k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    for k, t in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        exact, lanes = vector(t)
        assert got[3 * k]["fingerprint"] == "".join(f"{x:08x}" for x in exact) + "".join(f"{x:04x}" for x in lanes)
        assert (got[3 * k]["near_edited"], got[3 * k]["near_next"]) == pytest.approx((like(vector(t), vector(edited)), like(vector(t), vector(after))))


def test_ranges_split_one_id(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.lit(77)).otherwise(F.col("id")).alias("__id"), F.xxhash64("id").alias("__h"))
    got = fingerprints.with_range(rows, 36).collect()
    sizes = Counter(r["__range"] for r in got)
    assert max(sizes.values()) < 400 and sum(sizes.values()) == 4000
    order = sorted(got, key=lambda r: (r["__id"], r["__h"]))
    assert [r["__range"] for r in order] == sorted(r["__range"] for r in got)


def test_fingerprints_are_homomorphic(spark):
    lanes = lambda t: F.concat(F.array(*fingerprints.exact_lanes(F.lit(t))), F.array(*[F.lit(0).cast("long")] * fingerprints.LANES))
    r = spark.range(1).select(lanes("a\nb").alias("ab"), lanes("b\na").alias("ba"), fingerprints.combined(lanes("a"), lanes("b")).alias("sum"), fingerprints.combined(lanes("b\na"), lanes("b"), -1).alias("less"), lanes("a").alias("a")).first()
    assert r["ab"] == r["ba"] == r["sum"] and r["less"] == r["a"]


def test_url_filter(spark):
    urls = ["http://WWW.Example.com/en/1", "https://m.example.com/en/x?y", "http://a.net/es/", "http://net/fr/#t", "http://x.com", "http://x.com/", "nothing", None, "", "http://notnet/es/", "ftp://a.b.c.example.com/fr/"]
    urls += ["http://a." + "b." * 5000 + "example.com/en/" + "x" * 50_000, "http://x.com/", "http://example.com/en/?/fr/"]
    pages = spark.createDataFrame([(k, u, "h", "p", "r", "v", "k") for k, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string, keys string, key string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    want = ["www.example.com/en/", "example.com/en/", "net/es/", "net/fr/", None, "com/", None, None, None, None, "com/", "example.com/en/", "com/", "example.com/en/"]
    rules = {r: a for a, r in url_filter.RULES}
    assert [got[k] for k in range(len(urls))] == [(r, rules.get(r, "allow")) for r in want]
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert url_filter.judge(pages.union(pages)).count() == 2 * len(urls)
