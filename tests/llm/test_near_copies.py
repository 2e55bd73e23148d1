"""Near copies of the pipeline against brute force: five-word shingles, Jaccard similarity of 0.8 or more."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest

from gridloom.llm import near_copies


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, base, n):
    out = list(base)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"e{rng.randrange(10**6)}"
    return out


def brute(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (t.lower().split() for t in texts)]
    label = list(range(len(texts)))
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in range(len(texts)):
        before = list(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    return label, links


@pytest.mark.parametrize("members", [near_copies.MEMBERS, 5])  # the second deals cells over many chunks and units
def test_groups_against_brute_force(spark, members):
    rng = random.Random(11)
    texts = ["", " \n ", "Word", "word", "a b c d", "A  b c\td"]
    for n in (8, 9, 12, 20, 30, 60, 120, 250, 600):  # a text, and copies around the threshold
        for _ in range(4):
            base = words(rng, n)
            texts += [" ".join(base), " ".join([*base, "more"]), " ".join([*base, *words(rng, n // 8)]), " ".join(["more", "words", *base])]
            texts += [" ".join(edited(rng, base, k)) for k in {n // 60, n // 50, n // 40, n // 30} if k]
    hub = words(rng, 300)  # a cell with many candidates, and a chain out of it
    texts += [" ".join(edited(rng, hub, 2)) for _ in range(60)]
    texts += [" ".join(hub[k:]) for k in range(0, 160, 20)]
    texts = list(dict.fromkeys(texts))
    label, links = brute(texts)
    assert len(links) > 1770
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    root = {bytes(r.key): r.root for r in near_copies.groups(df, members=members).collect()}
    found: dict = {}
    for k, t in enumerate(texts):
        key = hashlib.sha256(t.encode()).digest()[:16]
        found.setdefault(root.get(key, key), set()).add(k)
    want: dict = {}
    for k, r in enumerate(label):
        want.setdefault(r, set()).add(k)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_a_large_cell_that_is_one_group_needs_no_units(spark):
    dense = spark.createDataFrame([(c, k) for c in (128, 256) for k in range(100)], "cell long, id long")
    one = spark.createDataFrame([(k, 0) for k in range(1, 100)], "node long, root long")
    assert near_copies._open_units(dense, one, 8)[0].isEmpty()
    two = one.where("node < 97")  # 0 to 96 are one group, 97 to 99 are alone: two chunks meet, never two of the group
    rows = near_copies._open_units(dense, two, 8)[0].where("cell = 128").collect()
    units: dict = {}
    for r in rows:
        units.setdefault(r.unit, []).append(r)
    assert len(rows) == 97 + 3 * 14 and len(units) == 14
    assert all(any(r.id > 96 for r in unit) for unit in units.values())
    met = {(r.id, q.id) for unit in units.values() for r in unit for q in unit if r.root != q.root and (r.chunk != q.chunk) == r.crossing}
    assert len(met) == 2 * (3 * 97 + 3)


def test_candidates_come_from_bk_trees(monkeypatch):
    rng, n, sketches = random.Random(5), [], []
    for size in (14, 18, 100):  # both radii
        base = words(rng, size)
        for k in [*range(30), 0, 0]:  # three have equal fingerprints
            text = edited(rng, base, k % (size // 10 + 2))
            h = np.unique(np.array([near_copies.xxhash.xxh64_intdigest(x, 42) for x in near_copies.shingles(" ".join(text).encode())], np.uint64))
            prints, least = near_copies.fingerprints(h)
            n.append(len(h))
            sketches.append(prints.tobytes() + least.tobytes())
    n, sketch = np.array(n), np.frombuffer(b"".join(sketches), np.uint8).reshape(len(n), -1)
    unit, prints = np.arange(len(n)) % 2 * 7, np.ascontiguousarray(sketch[:, : 8 * near_copies.FINGERPRINTS]).view(np.uint64)
    order = np.argsort(unit, kind="stable")
    unit, n, sketch, prints = unit[order], n[order], sketch[order], prints[order]
    cell = np.zeros(len(n), np.int64)  # place 0: an equal first byte and smallest hash
    want = set()
    for i, j in combinations(range(len(n)), 2):
        bits = int(np.bitwise_count(prints[i] ^ prints[j]).sum())
        near = bits <= (near_copies.WIDE if min(n[i], n[j]) <= near_copies.FEW else near_copies.RADIUS)
        meet = sketch[i, 0] == sketch[j, 0] and (sketch[i, 8 * near_copies.FINGERPRINTS :][:4] == sketch[j, 8 * near_copies.FINGERPRINTS :][:4]).all()
        if unit[i] == unit[j] and near and meet and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]):
            want.add((i, j, bits))

    def found(**more):
        return sorted(p for part in near_copies._near(unit, cell, n, sketch, near_copies.SIMILARITY, **more) for p in zip(*(x.tolist() for x in part), strict=True))

    assert len(want) > 80 and found() == sorted(want)
    side = np.where(np.arange(len(n)) % 3 == 0, 1, 2)
    assert found(side=side) == sorted(p for p in want if side[p[0]] != side[p[1]])
    monkeypatch.setattr(near_copies.BkForest, "within", lambda self, queries, group, radius: (np.zeros(0, np.int64),) * 3)
    assert found() == []


def test_pairs_to_verify_grow_with_the_texts_of_a_group(spark, monkeypatch):
    """Any two of these texts are candidates, alike in 0.73 of their shingles: no pair is a link."""
    rng, rows, written = random.Random(8), [], near_copies.materialise
    base = words(rng, 200)
    texts = [" ".join(edited(rng, base[3:-3], 3)) for _ in range(400)]

    def counted(df):
        out = written(df)
        if out.columns == ["u", "v"]:
            rows[-1] += out.count()
        return out

    monkeypatch.setattr(near_copies, "materialise", counted)
    for size in (200, 400):
        rows.append(0)
        label, links = brute(texts[:size])
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts[:size])], "doc_id long, text string")
        groups = near_copies.groups(df)
        assert groups.count() == len({r for k, r in enumerate(label) if r != k}) + sum(r != k for k, r in enumerate(label))
    assert rows[1] <= 2.5 * rows[0] and rows[1] < 400 * 399 / 2 / 4


@pytest.mark.parametrize("members", [near_copies.MEMBERS, 5])
def test_groups_of_texts_too_long_for_their_hashes(spark, members):
    rng = random.Random(13)
    texts = []
    for n in (near_copies.HELD - 10, near_copies.HELD + 4, near_copies.HELD + 400):  # on both sides of the bound
        base = words(rng, n)
        texts += [" ".join(edited(rng, base, k)) for k in [2, n // 60, n // 50, n // 45, n // 40, n // 30] * 5]
    label, links = brute(texts)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    root = {bytes(r.key): r.root for r in near_copies.groups(df, members=members).collect()}
    found: dict = {}
    for k, t in enumerate(texts):
        key = hashlib.sha256(t.encode()).digest()[:16]
        found.setdefault(root.get(key, key), set()).add(k)
    want: dict = {}
    for k, r in enumerate(label):
        want.setdefault(r, set()).add(k)
    assert len(want) > 3 and sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_recall_of_pairs_at_the_threshold():
    rng, met = np.random.default_rng(2), []
    for n in (81, 200, 1000):  # texts with fewer shingles share a cell in any case
        for _ in range(300):
            h = rng.integers(0, 2**63, n + n // 9, dtype=np.int64).astype(np.uint64)
            texts = [np.sort(h[:n]), np.sort(h[n // 9 :])]
            a, b = ([*near_copies.fingerprints(x)] for x in texts)
            common = np.intersect1d(near_copies.cells(texts[0], *a), near_copies.cells(texts[1], *b))
            met.append(len(common) > 0 and int(np.bitwise_count(a[0] ^ b[0]).sum()) <= near_copies.RADIUS)
    assert np.mean(met) >= 0.995


def test_near_copies_leave_the_pipeline(spark, sf_dir):
    import corpus_pipeline as C

    rng = random.Random(4)
    base = words(rng, 200)
    texts = [" ".join(base), " ".join(edited(rng, base, 3)), " ".join(words(rng, 200))]
    texts += [" ".join(texts[0].split()[:120] + texts[2].split()[:80])]  # alike in 0.4 of its shingles: stays
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in dict(C.STAGES)["simhash"](spark, df, sf_dir).collect()) == [0, 2, 3]


def test_less_alike_texts_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    with pytest.raises(ValueError):
        near_copies.one_of_each(docs, similarity=(1, 2))
    assert near_copies.one_of_each(docs, similarity=(9, 10)).count() == 1


def test_cells_of_one_text_go_through_no_join(spark):
    marked = spark.createDataFrame([(k, [7, 100 + k, 2**62 + k]) for k in range(2000)] + [(k, [9, -k]) for k in range(5000, 5003)], "id long, cells array<long>")
    units, counts = near_copies._chunks(marked, 4096)
    assert "LeftOuter" not in units._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.cell, r.id) for r in units.collect()) == [(7, k) for k in range(2000)] + [(9, k) for k in range(5000, 5003)]
    near_copies.discard(counts)
