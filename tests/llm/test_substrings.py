"""Repeated windows of words and bytes against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import anchors, relative_lz, repeats, suffix_array


def covered(seqs, window):
    count = Counter(tuple(s[i : i + window]) for s in seqs for i in range(len(s) - window + 1))
    out = []
    for s in seqs:
        gone = np.zeros(len(s), bool)
        for i in range(len(s) - window + 1):
            if count[tuple(s[i : i + window])] > 1:
                gone[i : i + window] = True
        out.append(gone)
    return out


def by_words(texts):
    seqs = [t.split() for t in texts]
    return [(len(s), int(g.sum()), hashlib.sha256(b" ".join(w for w, x in zip(s, g, strict=True) if not x)).hexdigest()) for s, g in zip(seqs, covered(seqs, 35), strict=True)]


def by_bytes(texts):
    return [(len(t), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~g])).hexdigest()) for t, g in zip(texts, covered(texts, 200), strict=True)]


@pytest.mark.parametrize("hot", [50_000, 3, 1])
@pytest.mark.parametrize(("module", "brute"), [(relative_lz, by_words), (suffix_array, by_bytes)])
def test_against_brute_force(awkward, module, brute, hot):
    rows = awkward.select("doc_id", "text").collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    want = sorted(((r.doc_id, *x) for r, x in zip(rows, brute([(r.text or "").encode() for r in rows]), strict=True)), key=key)
    got = sorted((tuple(r) for r in module.deduplicated(awkward, hot_runs=hot).collect()), key=key)
    assert got == want
    assert any(r[2] for r in got)


@pytest.mark.parametrize("hot", [50_000, 1])
@pytest.mark.parametrize(("module", "window"), [(relative_lz, 35), (suffix_array, 200)])
def test_all_repeats_come_through_the_resolver(awkward, monkeypatch, module, window, hot):
    """With a resolver that finds nothing, only copies of whole texts go."""
    monkeypatch.setattr(module, "equal_windows", lambda runs: np.zeros(int(runs.windows.sum()), bool))
    texts = {r.doc_id: r.text or "" for r in awkward.where("doc_id IS NOT NULL").collect()}
    copies = Counter(r.text or "" for r in awkward.collect())
    items = (lambda t: t.split()) if window == 35 else str.encode
    for r in module.deduplicated(awkward, hot_runs=hot).where("doc_id IS NOT NULL").collect():
        text = texts[r.doc_id]
        assert r.n_removed == (len(items(text)) if copies[text] > 1 and len(items(text)) >= window else 0)


def test_a_factor_is_the_longest(spark):
    """A run that shares 40 words with one place and 55 with another is one factor of 55, whichever place is indexed first."""
    w = [b"w%d" % k for k in range(60)]
    segments = [b" ".join(x) for x in (w, [*w[:40], *[b"x%d" % k for k in range(20)]], [*w[:55], b"y1", b"y2", b"y3", b"y4", b"y5"])]
    runs = repeats.Runs(np.zeros(3, int), np.full(3, 26), np.full(3, 26), segments)
    block = relative_lz.ReferenceBlock(runs)
    assert block.longest(np.array([0, 26, 52])).tolist() == [55, 40, 55]


@pytest.mark.parametrize("module", [relative_lz, suffix_array])
def test_no_rows(nothing, module):
    assert module.deduplicated(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=0, max_size=400), st.integers(20, 60), st.sampled_from([1 << 16, 50]))
def test_anchors(items, window, block):
    x, k = np.array(items, np.int64), 5
    before, anchors.BLOCK = anchors.BLOCK, block
    try:
        h, place, first, last = anchors.anchors(x, window, k)
    finally:
        anchors.BLOCK = before
    n = max(0, len(x) - window + 1)
    assert np.concatenate([np.arange(a, z + 1) for a, z in zip(first, last, strict=True)] or [[]]).tolist() == list(range(n))
    g = anchors.gram_hashes(x, k) >> np.uint64(24)
    for p, a, z in zip(place.tolist(), first.tolist(), last.tolist(), strict=True):
        for s in (a, z):
            assert p == s + int(np.argmin(g[s : s + window - k + 1]))


def test_gram_hashes_tell_grams_apart():
    x = np.array([1, 2, 3, 1, 2, 3, 2, 1])
    h = anchors.gram_hashes(x, 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 5


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(200, 260)), min_size=2, max_size=6), st.integers(1, 4))
def test_resolvers(parts, letters):
    rng = np.random.default_rng(letters)
    sources = [bytes(rng.integers(97, 97 + letters, 300).astype(np.uint8)) for _ in range(3)]
    segments = [sources[k][:n] for k, n in parts]
    runs = repeats.Runs(np.zeros(len(segments), int), np.full(len(segments), 168), np.array([len(s) - 199 for s in segments]), segments)
    hit = suffix_array.equal_windows(runs)
    # windows meet only at equal places of the anchor
    flat = [(168 - i, s[i : i + 200]) for s in segments for i in range(len(s) - 199)]
    count = Counter(flat)
    assert hit.tolist() == [count[x] > 1 for x in flat]
    words = [b" ".join(bytes([c]) for c in s[:60]) for s in segments]
    runs = repeats.Runs(np.zeros(len(words), int), np.zeros(len(words), int), np.full(len(words), 26), words)
    hit = relative_lz.equal_windows(runs)
    flat = [tuple(w.split()[i : i + 35]) for w in words for i in range(26)]
    count = Counter(flat)
    assert hit.tolist() == [count[x] > 1 for x in flat]


def test_difference_cover():
    shift = suffix_array._SHIFT
    for a in range(suffix_array.PERIOD):
        for b in range(suffix_array.PERIOD):
            assert {(a + shift[a, b]) % suffix_array.PERIOD, (b + shift[a, b]) % suffix_array.PERIOD} <= set(suffix_array.COVER)
