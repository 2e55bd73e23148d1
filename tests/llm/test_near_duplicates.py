"""SimHash and embeddings against brute force, and connected components."""

from itertools import pairwise

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import common, components, embeddings, near_copies, simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(n, links, ids):
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return label


def test_fingerprints_and_components(awkward):
    rows = awkward.where("doc_id IS NOT NULL").select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = sorted(zip([r.doc_id for r in rows], [f"{f:016x}" for f in fps], closure(len(rows), links, [r.doc_id for r in rows]), strict=True))
    got = sorted(map(tuple, simhash.near_duplicates(awkward.where("doc_id IS NOT NULL")).collect()))
    assert got == want


def test_null_ids_and_no_rows(awkward, nothing):
    assert simhash.near_duplicates(awkward).count() == awkward.count()
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert None not in ids and 3 in ids  # the row without an id repeats document 3, which stands for both
    assert len(set(ids)) == len(ids) and 0 in ids and 12 not in ids
    alone = awkward.where("doc_id IS NULL OR doc_id <> 3")
    assert [r.doc_id for r in simhash.one_of_each(alone).collect()].count(None) == 1


@pytest.mark.parametrize("module", [simhash, near_copies])
def test_of_rows_with_one_id_and_text_every_run_keeps_the_same(spark, module):
    text = " ".join(f"a{k}" for k in range(60))
    rows = [(1, text, f"lang{k}") for k in range(20)]
    kept = {module.one_of_each(spark.createDataFrame(order, "doc_id long, text string, lang string")).first().lang for order in (rows, rows[::-1], rows[7:] + rows[:7])}
    assert len(kept) == 1


@pytest.mark.parametrize("module", [simhash, near_copies])
def test_one_row_of_each_group_stays(spark, module):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (7, a), (None, b), (None, c), (None, c), (9, None), (8, "")]
    df = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "n long, doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in module.one_of_each(df).collect()), key=str)
    assert got == sorted([(5, a), (5, b), (None, c), (8, "")], key=str)


@pytest.mark.parametrize("n", [1, 1000, 10**5, 10**7, 10**9, 10**11])
def test_shard_keys_hold_every_pair(n):
    rng = np.random.default_rng(n % 97)
    keys = simhash.shard_keys(n)
    assert max(sum(w for _, w in parts) for parts in keys) == min(sum(w for _, w in parts) for parts in keys) >= min(40, max(0, (n // 256).bit_length() - 1))
    for _ in range(200):
        x = int(rng.integers(0, 2**63)) << 1
        y = x
        for b in rng.choice(64, 4, replace=False).tolist():
            y ^= 1 << b
        assert any(all((x ^ y) >> shift & ((1 << width) - 1) == 0 for shift, width in parts) for parts in keys)


def test_long_texts_are_read_whole():
    text = " ".join(f"w{i}" for i in range(simhash._SLICE + 500))
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.integers(0, 3), st.randoms())
def test_bk_forest_finds_all(base, groups, rng):
    fps = np.array([b ^ sum(1 << rng.randrange(64) for _ in range(k)) & (2**64 - 1) for b in base for k in range(4)], np.uint64)
    group = np.array([rng.randint(0, groups) for _ in fps])
    q, n = simhash.BkForest(fps, group).search(fps, group, 4)
    found = set(zip(q.tolist(), n.tolist(), strict=True))
    assert found == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= 4}


def test_hot_shards_are_split(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    fps = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (300, 2))} | {int(x) for x in rng.integers(0, 2**63, 50)}
    monkeypatch.setattr(simhash, "SHARD_NODES", 16)
    monkeypatch.setattr(simhash, "MOST_NODES", 8)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.root for r in components.components(simhash.links(df, len(fps))).collect()}
    order = sorted(fps)
    links = [(i, j) for i in range(len(order)) for j in range(i) if (order[i] ^ order[j]).bit_count() <= 4]
    want = {f: r for f, r in zip(order, closure(len(order), links, order), strict=True) if f != r}
    assert got == want


def test_components_of_chains_and_stars(spark):
    edges = list(pairwise(range(100, 160))) + [(500, k) for k in range(501, 580)] + [(7, 7), (900, 901), (901, 900)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 100 for k in range(101, 160)} | {k: 500 for k in range(501, 580)} | {901: 900}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_e8():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 8)) * 2
    moves = np.concatenate([embeddings.shortest_e8(), np.zeros((1, 8))])
    p = embeddings.nearest_e8(x)
    assert np.allclose(((x - p) ** 2).sum(1), ((x[:, None] - p[:, None] - moves) ** 2).sum(2).min(1))
    assert len(embeddings.shortest_e8()) == 240 and np.allclose((embeddings.shortest_e8() ** 2).sum(1), 2)


@pytest.mark.parametrize("cell_rows", [256, 8])
def test_embeddings_against_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(embeddings, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((120, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = [x[k % 20] + rng.standard_normal(64) * s for k, s in enumerate(np.linspace(0.002, 0.025, 60))]
    vectors = [v.tolist() for v in [*x, *near, *x[:30]]]
    rows = [(k, v, k % 2 if k < 120 else (k - 120) % 20 % 2) for k, v in enumerate(vectors)]
    odd = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] + [1.0] * 63, 0), (903, vectors[0], None), (904, [], 1), (905, [None] + [1.0] * 63, 1), (906, [float("inf")] + [0.0] * 63, 0), (None, vectors[0], 0), (3, vectors[3], 1)]
    df = spark.createDataFrame([(*r, "c") for r in rows + odd], "vec_id long, embedding array<float>, label int, cells string")
    e = np.array([np.float32(v) for v in vectors + [vectors[3]]], float)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows] + [1])
    ids = [r[0] for r in rows] + [3]
    hit = (e @ e.T >= 0.93) & (labels[:, None] == labels) & ~np.eye(len(e), dtype=bool)
    comp = closure(len(e), list(zip(*np.nonzero(hit), strict=True)), ids)
    want = [(i, int(n), c, i == c) for i, n, c in zip(ids, hit.sum(1), comp, strict=True)] + [(o[0], 0, o[0], o[0] is not None) for o in odd[:-1]]
    got = [tuple(r) for r in embeddings.near_duplicates(df).collect()]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_a_hot_key_is_dealt_over_tasks(spark):
    """100,000 rows of one key: no partition of the join holds them all, and every row is there once."""
    rows = spark.range(120_000).selectExpr("id", "IF(id < 100000, 7, id) AS k")
    known = common.materialise(rows.groupBy("k").count())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = common.joined(rows, known, ["k"], "count", rows["id"])
        sizes = [r.n for r in out.selectExpr("spark_partition_id() AS p").groupBy("p").agg({"*": "count"}).toDF("p", "n").collect()]
        assert sum(sizes) == 120_000 and max(sizes) < 60_000
        units, counts = common.in_units(rows.select("k", "id"), ["k"], "id", 4000)
        assert units.groupBy("k", "unit_a", "unit_b").count().agg({"count": "max"}).first()[0] < 9000
        assert units.select("id", "unit_a", "unit_b").distinct().count() == 100_000 * 25
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_extreme_doubles(spark):
    rows = [(1, [1e200] * 4, 0), (2, [1e200] * 4, 0), (3, [1e-200] * 4, 0), (4, [2e200, 2e200, 2e200, 1.9e200], 0), (5, [5e-324, 0.0, 0.0, 0.0], 0), (6, [1e-200, -1e-200, 1e-200, -1e-200], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6)}


@pytest.mark.parametrize("dim", [16, 64, 128, 768])
def test_lattice_recall(dim):
    rng = np.random.default_rng(9)
    u = rng.standard_normal((1500, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    n = rng.standard_normal(u.shape)
    n -= (n * u).sum(1, keepdims=True) * u
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    v = 0.93 * u + np.sqrt(1 - 0.93**2) * n
    h = embeddings.LatticeHash(dim)
    a, b = h.cells(u), h.cells(v)
    assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean() >= 0.97
