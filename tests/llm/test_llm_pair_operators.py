"""N-gram join, filter audit and hard negatives against brute force."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from harvestline.llm import filter_audit, hard_negatives, near_dups, ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, chunk int, n long, component string, token int, key string, first long"


def frame(spark, rows):
    """Documents (id, text, source) with columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, 1, 2, "c", 3, "k", 4) for r in rows], DOCS)


def shingle_set(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def components_of(rows, size, percent):
    """(n_shingles, component) of each row, comparing all pairs of rows."""
    sets = [shingle_set(r[1], size) for r in rows]
    label = {r[0]: r[0] for r in rows if r[0] is not None}
    moved = True
    while moved:
        moved = False
        for (a, x), (b, y) in itertools.combinations(list(zip([r[0] for r in rows], sets)), 2):
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y) and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return sorted(((r[0], len(s), label.get(r[0])) for r, s in zip(rows, sets)), key=str)


def near_copies(seed, groups=6, copies=14):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(4, 120))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 12)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(60)}"
            if rng.random() < 0.2:
                words = words[:rng.randrange(1, len(words) + 1)]
            rows.append((rng.randrange(10**6), (" \t" if rng.random() < 0.5 else "  ").join(words).upper() if rng.random() < 0.1 else " ".join(words), f"s{g}"))
    rng.shuffle(rows)
    return rows


ODD = [(901, None, "s"), (902, "", "s"), (903, " \n ", None), (None, "w1 w2 w3", "s"), (None, "w1 w2 w3", "s"), (904, "one", "s"), (905, "one", "s"),
       (906, "One two", "s"), (907, "one TWO", "s"), (908, "a b c d e f g h", "s"), (908, "a b c d e f g h", "s"), (908, "one", "t")]


@pytest.mark.parametrize("seed,size,percent", [(1, 5, 80), (2, 3, 85), (3, 1, 50), (4, 5, 100)])
def test_ngram_join_equals_all_pairs(spark, seed, size, percent):
    rows = near_copies(seed) + ODD
    got = ngram_join.ngram_join(frame(spark, rows).repartition(3), size, percent, chunk_bytes=4000).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == components_of(rows, size, percent)


def test_near_dedup_of_a_group_around_the_threshold(spark):
    """Copies that mostly miss the threshold with their pivot and sometimes meet it with each other."""
    rng = random.Random(9)
    base = [f"v{k}" for k in range(60)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 3, 3, 4])):
            words[rng.randrange(60)] = f"x{rng.randrange(4)}"
        rows.append((k, " ".join(words), "s"))
    want = components_of(rows, 3, 85)
    got = near_dups.near_duplicates(frame(spark, rows), 3, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want
    joined = ngram_join.ngram_join(frame(spark, rows), 3, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, joined), key=str) == want
    assert 1 < len({r[2] for r in want}) < 150


def test_ngram_join_without_rows_and_with_one_long_text(spark):
    assert ngram_join.ngram_join(frame(spark, [])).collect() == []
    long = " ".join(f"w{k}" for k in range(150_000))
    got = ngram_join.ngram_join(frame(spark, [(1, long, "s"), (2, long + " end", "s"), (3, long[:600_000], "s")]), chunk_bytes=1000).collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in sorted(got)][:2] == [(1, 149_996, 1), (2, 149_997, 1)]
    assert sorted(got)[2].component_id == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=20), min_size=2, max_size=8), st.integers(50, 100))
def test_similar_sets_share_what_the_shorter_choice_asks_for(sets, percent):
    """The multi-match condition never drops a similar pair, whatever the members choose."""
    seen = collections.Counter(t for s in sets for t in s)
    ordered = [np.array(sorted(s, key=lambda t: (seen[t], t))) for s in sets]
    n = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(n)])
    cost = np.concatenate([[0], np.cumsum([seen[t] - 1 for s in ordered for t in s])]).astype(float)
    matches = ngram_join.prefix_choice(n, at, cost, percent)
    assert (matches >= 1).all() and (matches <= ngram_join.MOST).all()
    for a, b in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            prefix = [set(ordered[k][:min(n[k] + percent * n[k] // -100 + matches[k], n[k])].tolist()) for k in (a, b)]
            assert len(prefix[0] & prefix[1]) >= min(matches[a], matches[b])


def test_longer_prefixes_for_costly_lists():
    n, at = np.array([100, 100]), np.array([0, 100, 200])
    rare = np.r_[np.zeros(20), np.ones(80)]       # nothing in the prefix but the set itself
    common = np.r_[np.full(21, 1000.0), np.zeros(79)]  # the lists grow no more behind the shortest prefix
    choice = ngram_join.prefix_choice(n, at, np.concatenate([[0], np.cumsum(np.r_[rare, common])]), 80)
    assert choice[1] > choice[0] == 1


# ---- filter audit

def audited(rows, labels):
    """All rows of the audit by going through the documents for each order."""
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    fails = []
    for i, t, _ in rows:
        t = t or ""
        words = WORD.findall(t)
        fails.append({"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                      "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)})
    out = {}
    for part in {s or "" for *_, s in rows}:
        mine = [(r, f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, x in enumerate(order, 1):
                goes = [(r, f) for r, f in left if f[x]]
                left = [(r, f) for r, f in left if not f[x]]
                total[x] += len(goes)
                out[part, "".join(order), step] = [len(left), len(goes), sum(f[x] for _, f in mine) - len(goes), sum(f[x] and sum(f.values()) == 1 for _, f in mine),
                                                   sum(r[0] in good for r, _ in goes), sum(r[0] in toxic for r, _ in goes), x]
        for key in out:
            if key[0] == part:
                out[key][-1] = total[out[key][-1]]
    return sorted((*k, *v) for k, v in out.items())


def test_filter_audit_equals_going_through_all_orders(spark):
    rng = random.Random(5)
    words = lambda n, m: " ".join(f"w{rng.randrange(m)}" for _ in range(n))
    texts = [words(60, 500), words(60, 10), words(20, 500), words(60, 500) + " #", "ABC " * 60, "x", None, "", "é|É " * 30, words(60, 400).upper()]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["s1", "s2", "", None])) for _ in range(160)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in rng.choices([None, *range(50)], k=60)]
    told = spark.createDataFrame([(*x, "p") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(frame(spark, rows).repartition(4), told)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == audited(rows, labels)
    assert filter_audit.audit(frame(spark, []), told).collect() == []
    assert filter_audit.audit(frame(spark, [(1, "w " * 100_000, "s")]), told.limit(0)).where("step = 5 and kept > 0").count() == 0


def test_filter_audit_of_one_text_in_many_copies(spark):
    rows = [(k, "same text", f"s{k % 3}") for k in range(300)] + [(0, "same text", "s1")]
    got = {(r.part, r.step): r.removed for r in filter_audit.audit(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'EABCD'").collect()}
    assert [got["s0", 1], got["s1", 1], got["s2", 1]] == [99, 100, 100]  # both rows of id 0 have no smaller one


# ---- hard negatives

def mined(rows, every=50):
    whole = lambda v: [int(x) * 256 if abs(x) > 2**45 else int(np.floor(256 * x)) for x in v]
    ok = [(i, whole(v), l) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    short = lambda s: min(max(s, -2**63), 2**63 - 1)
    out = []
    for i, v, l in ok:
        if i % every == 0:
            others = sorted(((-dot(v, w), j, m) for j, w, m in ok if len(w) == len(v)), key=lambda e: e[:2])
            for p, j, _ in [e for e in others if e[2] == l and e[1] != i][:5]:
                window = [(s, k) for s, k, m in others if m != l and 50 * -p <= 100 * -s <= 95 * -p]
                out += [(i, j, r, k, short(-p), short(-s)) for r, (s, k) in enumerate(window[:3], 1)]
    return sorted(out)


def vector_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0, "w") for r in rows], "vec_id long, embedding array<double>, label int, row int, score double, place string")


def test_hard_negatives_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "GROUP", 100)
    rng = np.random.default_rng(3)
    rows = [(k, (rng.integers(-8, 9, 6) / 8).tolist(), int(rng.integers(0, 4))) for k in range(400)]
    rows += [(k, [0.5] * 6, k % 3) for k in range(400, 520)]                          # ties
    rows += [(k, rng.normal(size=3).tolist(), 1 + k % 2) for k in range(600, 660)]    # another dimension
    rows += [(700, None, 1), (750, [None] * 6, 1), (800, [float("nan")] * 6, 1), (850, [float("inf")] * 6, 1), (900, [0.1] * 6, None), (None, [0.1] * 6, 1),
             (950, [], 1), (951, [], 2), (50, [0.25] * 6, 2), (50, [0.25] * 6, 2), (1000, [0.0] * 6, 2)]
    got = hard_negatives.mine(vector_frame(spark, rows).repartition(4))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == mined(rows)
    assert hard_negatives.mine(vector_frame(spark, [])).collect() == []
    assert hard_negatives.mine(vector_frame(spark, [(1, [1.0], 1)])).collect() == []


def test_hard_negatives_of_large_components(spark):
    rng = np.random.default_rng(4)
    scale = [1.0, 1e5, 1e9, 1e20, 1e300]
    rows = [(k, (rng.normal(size=4) * scale[k % 5]).tolist(), k % 2) for k in range(0, 300, 3)]
    got = [r[:3] + r[3:] for r in sorted(map(tuple, hard_negatives.mine(vector_frame(spark, rows), every=15).collect()))]
    assert got == mined(rows, 15)


def test_threshold_stops_before_the_end_of_the_lists():
    """Long anchors along one axis of spread-out candidates: a few entries decide."""
    rng = np.random.default_rng(6)
    x = np.floor(256 * np.c_[np.linspace(-4, 4, 2048), rng.normal(size=(2048, 2)) / 50]) / 256
    block = hard_negatives.SortedLists(np.arange(2048), rng.integers(0, 4, 2048), x)
    anchor = np.array([[3.0, 0.0, 0.0], [-3.0, 0.1, 0.0]])
    windows = [[hard_negatives.Interval(5)], [hard_negatives.Interval(5)]]
    batch = hard_negatives.Batch(np.array([5000, 5001]), np.array([1, 2]), anchor, [[hard_negatives.Interval(5)], [hard_negatives.Interval(5)]])
    pairs = block.search_all(batch, same_label=True)
    assert 0 < pairs < 0.2 * 2 * 2048
    for a, label, ws, score, ids in zip(anchor, (1, 2), windows, batch.score[:, 0], batch.id[:, 0]):
        assert 0 < block.search(a, float(np.sqrt(a @ a)), block.labels == label, ws) < 0.2 * 2048
        assert ws[0].best == list(zip(score.tolist(), ids.tolist()))
        every = sorted(zip((-np.rint(x[block.labels == label] @ a * 65536)).astype(int), np.flatnonzero(block.labels == label)))[:5]
        assert ws[0].best == [(-s, i) for s, i in every]
