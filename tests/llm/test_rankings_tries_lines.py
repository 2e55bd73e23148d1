"""Importance resampling, prefix tries and line dedup against brute force, on awkward rows and with everything split."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import common, importance, lines, prefix_trie

key = lambda r: tuple((v is None, str(v)) for v in r)
lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture
def split(spark, monkeypatch):
    """Small limits, so that every group is cut."""
    monkeypatch.setattr(lines, "HELD", 2)
    monkeypatch.setattr(prefix_trie, "PART", 2)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    monkeypatch.setattr(importance, "BINS", 3)
    monkeypatch.setattr(common, "BATCH_ROWS", 3)
    yield
    common.BATCH_ROWS = 4096
    common.small_batches(spark)


# importance


def brute_resample(rows, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    def found(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for b in found(text)[1]:
                counts[b] += 1
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets))))
    out = []
    for doc, text in rows:
        n, own = found(text)
        weight = sum(gain(b) for b in own)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=key)


@pytest.mark.parametrize("longest,percent,least", [(1, 10, 20), (3, 50, 1), (2, 100, 0), (1, 0, 1)])
def test_resampling(spark, awkward, split, longest, percent, least):
    target = ["the river of light under seven bridge", None, "", "stone walking stone"]
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, n long")
    docs = awkward.unionByName(awkward.where("doc_id % 3 = 0")).withColumn("rank", F.lit("mine"))
    got = importance.resample(docs, bench, longest=longest, percent=percent, least_words=least, buckets=300)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute_resample([(r.doc_id, r.text) for r in docs.collect()], target, longest, 300, least, percent)
    assert sorted(map(tuple, got.collect()), key=key) == want


def test_resampling_of_many_ties(spark, split):
    """One document id on a third of all rows, another third without an id: few scores, all of them shared."""
    rows = [(7, "a b c d")] * 40 + [(None, f"a b {'c ' * (k % 3)}") for k in range(40)] + [(k, "b a c c") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = importance.resample(docs, docs.where("false"), least_words=2, percent=37)
    assert sorted(map(tuple, got.collect()), key=key) == brute_resample(rows, [], least=2, percent=37)


def test_resampling_of_nothing(spark, nothing, awkward):
    bench = spark.createDataFrame([("x",)], "text string")
    assert importance.resample(nothing, bench).count() == 0
    assert importance.resample(awkward.where("text IS NULL"), bench).where("weight = 0 AND rank IS NULL").count() == 2


# prefix tries


def brute_trie(convs):
    """convs: id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = [c for c in m if len(convs[c]) == len(p)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), sum(q not in kids or not kids[q] for q in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=key)


def clean(rows):
    """Conversations as the operator orders them."""
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        if c is not None:
            convs[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16], role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}


def regraft(convs):
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
    return {c: convs.get(c - c % 5, [])[: h[c]] + turns[h[c] :] for c, turns in convs.items()}


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turns = [(("user", "assistant")[k % 2], rng.choice(["yes", "no", "é"])) for k in range(rng.choice([0, 1, 2, 3, 5, 8, 13, 16, 17]))]
        rows += [(c, k * 2, role, text) for k, (role, text) in enumerate(turns)]
    rows += [(500, None, None, "b"), (500, None, "user", None), (500, 1, "user", "x"), (500, 1, "user", "x"), (None, 1, "user", "x"), (501, 0, "", ""), (502, 0, None, None), (503, 1, "usery", "es")]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, split, seed):
    rows = conversations(seed, 60)
    if seed == 2:  # one conversation holds a third of all turns, and a turn is repeated often
        rows += [(77, k, "user", "yes") for k in range(len(rows) // 2)] + [(78, 0, "user", "no")] * 70
    turns = prefix_trie.turns_of(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], f"{SCHEMA}, pos int, conv int, name int"))
    convs = clean(rows)
    got = sorted(map(tuple, prefix_trie.trie(turns, turns.select("conv").distinct()).collect()), key=key)
    assert got == brute_trie(convs)
    new = prefix_trie.trie(prefix_trie.regrafted(turns), turns.select("conv").distinct())
    assert sorted(map(tuple, new.collect()), key=key) == brute_trie(regraft(convs))


def test_trie_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    turns = prefix_trie.turns_of(empty)
    assert prefix_trie.trie(prefix_trie.regrafted(turns), turns.select("conv").distinct()).count() == 0
    only = spark.createDataFrame([(5,), (3,)], "conv long")  # conversations without a turn
    assert list(map(tuple, prefix_trie.trie(turns, only).collect())) == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]


# lines


def brute_lines(rows, least_chars=20, least_docs=3):
    strip = lambda x: x.strip(" \t\n\v\f\r").translate(lower)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[strip(line)].add(doc)
    keeper = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in holders.items() if len(k) >= least_chars and len(ids) >= least_docs}
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if strip(x) not in keeper or keeper[strip(x)] == doc]
        out.append((doc, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=key)


def test_lines_of_awkward_rows(spark, awkward, nothing):
    docs = awkward.withColumn("keep", F.lit(1)).withColumn("id", F.lit("x"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, lines.report(docs, least_docs=2).collect()), key=key) == brute_lines(rows, least_docs=2)
    assert lines.report(nothing).count() == 0 and lines.keep_bitmaps(nothing).count() == 0
    assert lines.deduplicated(docs).columns == docs.columns and lines.deduplicated(docs).where("text IS NULL").count() == 2


@pytest.mark.parametrize("least_docs", [1, 2, 3, 5])
def test_shared_lines(spark, split, least_docs):
    rng = random.Random(least_docs)
    pool = [f"Line number {k} of the {'é' * k} licence" for k in range(9)] + ["short", "", " \t", "a very common line of more than twenty characters", "Éa" * 10, "é" * 19]
    rows = []
    for doc in range(90):
        own = [rng.choice(pool) for _ in range(rng.randrange(12))] + ["a very common line of more than twenty characters"] * (doc % 3 == 0)
        rows.append((doc if doc % 9 else None, "\n".join(rng.choice(["", "  ", "\t"]) + (x.upper() if rng.random() < 0.1 else x) + rng.choice(["", "\r", " "]) for x in own)))
    rows += rows[:40] + rows[3:4] * 30 + [(5, "a very common line of more than twenty characters\nother text"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, lines.report(docs, least_docs=least_docs).collect()), key=key) == brute_lines(rows, least_docs=least_docs)
    texts = lines.deduplicated(docs, least_docs=least_docs)
    want = [(r[0], r[3]) for r in brute_lines(rows, least_docs=least_docs)]
    assert sorted(((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in texts.collect()), key=key) == sorted(want, key=key)


def test_lines_of_long_texts(spark):
    text = "\n".join(f"this is line number {k % 5000} of a very long text" for k in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text[: len(text) // 2]), (4, "x" * 2_000_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.report(docs).collect()}
    assert got[1].n_dropped == got[1].n_lines == 200_000 and got[2].n_dropped == 200_000 and got[4].n_dropped == 0
    assert got[3].n_dropped == 0 and got[3].kept_sha256 == hashlib.sha256(docs.where("doc_id = 3").first().text.encode()).hexdigest()


def test_places_in_groups(spark, split):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, -4]), rng.randrange(5)) for _ in range(200)]
    table = common.materialise(spark.createDataFrame(rows, "g long, o long").withColumn("t", F.monotonically_increasing_id()))
    got = common.numbered(table, "g", [F.col("o").desc(), F.col("t")], "place").collect()
    groups = defaultdict(list)
    for r in sorted(got, key=lambda r: r.place):
        groups[r.g].append(r.o)
        assert r.place == len(groups[r.g]) - 1
    assert len(got) == 200 and all(o == sorted(o, reverse=True) for o in groups.values())
