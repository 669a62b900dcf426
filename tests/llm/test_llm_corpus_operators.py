"""Archives, vector search, near-duplicates, repeated passages, tokens, mixing and the pipeline."""

import collections
import fractions
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from harvestline.llm.chunks import chunked
from harvestline.llm import archives, bpe, mixing, near_dups, substrings, toxicity, vector_search
from harvestline.llm.graph import components
from harvestline.llm.membership import MOST_BITS, members, without
from harvestline.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, chunk int, n long, component string, size int"
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    """Documents (id, text[, source]) with columns whose names clash with inner ones."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, 2, "c", 3) for r in rows], DOCS)


ODD = [(901, None), (902, ""), (903, " \n "), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (904, "one"), (905, "one"), (906, "One two"), (907, "one TWO")]


# ---- against SQL

@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    assert [d[0] for d in cur.description] == df.columns
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, cur.fetchall()))


# ---- archives

PAGES = [(1, "http://a/ b", "x" * 1000), (5, "http://c", "x" * 1000), (3, None, "x" * 1000), (4, "http://d", "é" * 500), (9, "http://e", "é" * 500),
         (6, "u", None), (7, "u", ""), (8, "u", "y" * 999), (10, "u", "y" * 999), (None, "u", "z" * 2000), (11, "u", "z" * 2000),
         (12, "\nWARC/1.1\r\n\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\n\nfiledesc://x 0 0 0 3\n" * 50), (13, "u", "q" * 1500), (13, "u", "q" * 1500)]


def test_archives_round_trip(spark):
    df = spark.createDataFrame([(*p, "w") for p in PAGES], "page_id long, url string, html string, path string").repartition(3)
    got = archives.archived(df).toPandas()
    assert len(got) == len(PAGES)
    ids = got.set_index("record_id").page_id
    payloads = {p[0]: (p[2] or "").encode() for p in PAGES}
    for r in got[got.page_id.notna()].itertuples():
        body = payloads[int(r.page_id)]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert r.record_type == "revisit" or bytes(r.payload) == body
    kinds = {int(r.page_id): (r.record_type, None if r.refers_to_id is None else ids[r.refers_to_id]) for r in got[got.page_id.notna()].itertuples()}
    assert kinds[1] == kinds[3] == ("revisit", 5) and kinds[4] == ("revisit", 9) and kinds[5][0] == kinds[9][0] == "response"
    assert all(kinds[k] == ("response", None) for k in (6, 7, 8, 10, 11, 12))
    assert got[got.page_id.isna()].record_type.tolist() == ["revisit"]
    assert sorted(got[got.page_id == 13].record_type) == ["response", "revisit"]
    assert archives.archived(df.limit(0)).count() == 0


def test_arc_headers_of_both_versions():
    v1 = b"http://a 1.2.3.4 20200102030405 text/html; charset=utf-8 5\nhello\n"
    v2 = b"\nhttp://a 1.2.3.4 20200102030405 text/html 200 abc - 17 f.arc 5\nhel\nomore"
    assert archives.parse_arc(1, v1) == ({"url": "http://a", "ip": "1.2.3.4", "date": "20200102030405", "type": "text/html; charset=utf-8"}, b"hello")
    assert archives.parse_arc(2, v2)[1] == b"hel\nom"[:5]
    assert archives.iso("20200102030405") == "2020-01-02T03:04:05Z"
    for version, bad in ((1, b"http://a 1 2 t 9\nhello"), (2, v1), (1, b"nothing")):
        with pytest.raises(ValueError):
            archives.parse_arc(version, bad)
    for version in (1, 2):
        assert archives.arc_version(archives.arc_preamble(version)("f")) == version


# ---- vectors

def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=7 if i % 9 else 3)], 1) for i in range(350)]
    rows += [(400, None, 1), (401, [1.0, None], 1), (500, [float("nan")] * 7, 1), (600, [float("inf")] * 7, 1), (None, [1.0] * 7, 1), (700, [], 1), (701, [], 1)]
    rows += [(800, rows[1][1], 1), (801, rows[1][1], 1), (801, rows[1][1], 1)]
    got = collections.defaultdict(list)
    for r in vector_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(3)).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    usable = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64)) for i, v, _ in rows
              if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    for q, x in usable:
        if q % 100 == 0:
            want = sorted(((-int(x @ y), i) for i, y in usable if i != q and len(y) == len(x)))[:10]
            assert sorted(got.pop(q)) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert not got


def test_search_keeps_large_components(spark):
    """Components from 2**14 to the largest double: nobody is dropped, ranks are those of exact integers."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=40) * 10.0 ** float(rng.choice([0, 3, 5, 7, 30]))]) for i in range(1, 320)]
    rows += [(400, [2.0 ** 20] * 40), (500, [1e308, -1e308] * 20), (501, [1e308, -1e308] * 20), (502, [1.7e308] + [0.0] * 39), (600, [16384.0] + [0.5] * 39)]
    rows += [(700 + i, [2.0 ** 20] * 39 + [2.0 ** 20 + i / 1024]) for i in range(5)]
    got = collections.defaultdict(list)
    for r in vector_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    exact = [(i, [math.floor(1024 * fractions.Fraction(x)) for x in v]) for i, v in rows]
    for q, x in exact:
        if q % 100 == 0:
            want = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in exact if i != q)[:10]
            assert sorted(got.pop(q)) == [(k + 1, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for k, (s, i) in enumerate(want)]
    assert not got


def test_bounds_never_lie_below_the_product():
    rng = np.random.default_rng(6)
    a, b = rng.integers(-900, 900, (40, 50)), rng.integers(-900, 900, (60, 50))
    *bounds, exact = [x @ y.T for x, y in zip(vector_search.summaries(a), vector_search.summaries(b))]
    assert all((u >= exact - 1e-6 * np.abs(u)).all() for u in bounds) and len(bounds) == 3


# ---- near-duplicates

def shingle_set(text, size):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def brute_components(rows, size, percent):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def near_corpus(seed=2):
    """Exact copies, chains of copies each changed a little more, and texts that share a passage."""
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    rows, passage = [], text(60)
    for _ in range(6):
        base = text(120)
        for step in range(12):
            rows.append(" ".join(base))
            base[rng.randrange(120)] = f"x{rng.randrange(10 ** 6)}"
            base[rng.randrange(120)] = f"x{rng.randrange(10 ** 6)}"
    rows += [" ".join(passage + text(15)) for _ in range(40)]
    rows += [rows[0]] * 5 + [rows[20].upper()]
    return list(enumerate(rows))


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, size, percent):
    rows = near_corpus()
    got = near_dups.near_duplicates(frame(spark, rows + ODD), size, percent).toPandas()
    assert len(got) == len(rows) + len(ODD)
    want = brute_components(rows + [r for r in ODD if r[0] is not None], size, percent)
    known = got[got.doc_id.notna()]
    assert {int(r.doc_id): (r.n_shingles, int(r.component_id)) for r in known.itertuples()} == want
    assert (known.kept == (known.doc_id == known.component_id)).all()
    lost = got[got.doc_id.isna()]
    assert lost.kept.all() and lost.component_id.isna().all()


def test_texts_of_a_shared_id_are_linked(spark):
    a, b, c = ("".join(f"{x}{k} " for k in range(20)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (3, b), (7, b), (7, c), (9, c), (2, "q q q q")]
    got = near_dups.near_duplicates(frame(spark, rows)).toPandas()
    want = brute_components(rows, 5, 80)
    assert {int(r.doc_id): int(r.component_id) for r in got.itertuples()} == {i: c for i, (_, c) in want.items()} == {1: 1, 5: 1, 3: 1, 7: 1, 9: 1, 2: 2}


def test_pipeline_filters_act_on_rows(spark, tmp_path):
    """Rows without an id, and rows that share one, go by their own text."""
    clean, other = ("".join(f"{x}{k} " for k in range(30)) for x in ("stone", "leaf"))
    labelled = [(i, (" grobian" if i % 2 else "") + f" moss{i}" * 3) for i in range(200)]
    spark.createDataFrame([(i, i % 2) for i, _ in labelled], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = [(None, "grobian"), (900, "grobian"), (900, "moss2"), (None, "moss4")]
    docs = spark.createDataFrame([(t, i, 7) for i, t in labelled + odd], "text string, doc_id long, extra int")
    left = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in left.where("doc_id is null or doc_id = 900").collect()) == [("900", "moss2"), ("None", "moss4")]
    rows = [(5, clean), (5, other), (3, clean), (None, clean), (None, clean), (None, "null only " * 3), (None, "null only " * 3), (8, None), (8, "")]
    left = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), str(tmp_path))
    assert sorted(map(str, [(r.doc_id, r.text) for r in left.collect()])) == sorted(map(str, [(5, other), (3, clean), (None, "null only " * 3), (8, None), (8, "")]))


def text_scans_without_exchange(df):
    """Number of scans of texts whose rows reach the result without a shuffle."""
    above, free = [], 0
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        node = line.lstrip(" :+-")
        depth = len(line) - len(node)
        above = [(d, n) for d, n in above if d < depth] + [(depth, node)]
        free += "FileScan" in node and "text" in node and not any("Exchange" in n for _, n in above)
    return free


def test_texts_that_stay_are_not_shuffled(spark, tmp_path):
    """However many rows go, those that stay are told before the join; result as by brute force."""
    rows = near_corpus(5)
    docs = frame(spark, rows + ODD)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, -1)  # as with more ids than can be broadcast
    try:
        left = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
        assert text_scans_without_exchange(left) == 1
        known = [r for r in ODD if r[0] is not None]
        want = [i for i, (_, component) in brute_components(rows + known, 5, 80).items() if i == component]
        assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(want)
        assert left.where("doc_id is null").count() == 1
    finally:
        spark.conf.set(threshold, before)


def test_rows_outside_a_list_are_told(spark):
    ids = spark.range(0, 20_000, 7).union(spark.range(0, 700, 7)).selectExpr("cast(id as int) as key").union(spark.createDataFrame([(None,)], "key int"))
    listed = members(ids, "key")
    assert listed.bits < MOST_BITS
    rows = spark.range(20_000).selectExpr("id as key", "id % 3 as other").union(spark.createDataFrame([(None, 1), (7, 2), (8, 2)], "key long, other long"))
    places = rows.where("key is not null").select("key", listed.place(rows["key"]).alias("place")).toPandas()
    held = listed.may_hold(places.place.to_numpy())
    assert held[places.key % 7 == 0].all() and held[places.key % 7 > 0].mean() < 0.1
    want = sorted(k for k in [*range(20_000), 8] if k % 7)
    left = without(rows, ids, "key").collect()
    assert sorted(r.key for r in left if r.key is not None) == want and sum(r.key is None for r in left) == 1
    assert without(rows, ids.limit(0), "key").count() == rows.count()


def test_repeated_and_no_documents(spark):
    got = near_dups.near_duplicates(frame(spark, [(4, "a b c d e f"), (4, "a b c d e f"), (2, "A b c d e f"), (9, "q")])).toPandas()
    assert sorted(zip(got.doc_id, got.component_id)) == [(2, 2), (4, 2), (4, 2), (9, 9)]
    assert near_dups.near_duplicates(frame(spark, [])).count() == 0


def test_pruning_limits_keep_similar_pairs():
    rng = np.random.default_rng(9)
    for s in (0.8, 0.85):
        limits = near_dups.mismatch_limits(s)
        wrong = rng.random((20_000, 192)) < (1 - s) / 2
        assert all((wrong[:, :n].sum(1) <= limit).mean() > 0.999 for n, limit in zip(near_dups.BATCHES, limits))
        apart = rng.random((20_000, 192)) < 0.5
        assert (apart.sum(1) <= limits[-1]).mean() < 0.001


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(205, 203), (203, 205), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 205: 203, 203: 203}


# ---- repeated passages

def brute_removal(rows, size):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            window = tuple(words[k:k + size])
            if window in seen:
                gone[k:k + size] = [True] * size
            seen.add(window)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def passage_corpus(seed=8):
    rng = random.Random(seed)
    words = [f"p{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(55)]
    rows = []
    for i in range(80):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        if i % 3 == 0:
            at = rng.randrange(0, 30)
            text += passage[at:at + rng.randrange(15, 30)] + [rng.choice(words)]
        if i % 10 == 0:
            text += ["again"] * 50
        rows.append((i, rng.choice([" ", "\n", "\t ", " \r\n"]).join(text)))
    return rows + [(200, rows[4][1]), (201, rows[3][1] + " \n"), (202, None), (203, ""), (204, "é " * 30)]


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 3000])
def test_removed_passages_equal_brute_force(spark, chunk_bytes):
    rows = passage_corpus()
    got = substrings.remove_repeats(frame(spark, rows + [(None, rows[3][1])]), chunk_bytes=chunk_bytes).toPandas()
    assert len(got) == len(rows) + 1
    known = {int(r.doc_id): (r.n_words, r.n_removed, r.kept_text) for r in got[got.doc_id.notna()].itertuples()}
    assert known == brute_removal(rows, 20) and sum(v[1] for v in known.values()) > 500
    assert [hashlib.sha256(t.encode()).hexdigest() for t in got.kept_text] == got.kept_sha256.tolist()
    assert got[got.doc_id.isna()].n_removed.tolist() == [0]


def test_repeated_rows_of_a_document_are_no_earlier(spark):
    text = " ".join(f"v{k}" for k in range(30))
    got = substrings.remove_repeats(frame(spark, [(1, text), (1, text), (2, text)])).toPandas()
    assert sorted(zip(got.doc_id, got.n_removed)) == [(1, 0), (1, 0), (2, 30)]
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


# ---- tokens

def brute_tokens(text):
    t = bpe.tokenizer(None)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


TEXTS = ["Hello  World's cat<|endoftext|>dog foo", "ÉÇ é café 12 ##!!\n\nx", None, "", " \t", "a<|startoftext|> <|endoftext|", "x​y\xa0z　w 日本語 \x1c\x85",
         "ΣΑΣ ǅ İ ẞ K 'S it'll", "́ ́ e ́", "w" * 5000, "😀 ﷺ ½ ² ०१", "same row", "same row"]


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 40])
def test_encoding_equals_the_library(spark, chunk_bytes):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (11, "other")]
    got = bpe.encode(frame(spark, rows), chunk_bytes=chunk_bytes).toPandas()
    want = sorted((str(i), *map(str, brute_tokens(t))) for i, t in rows)
    assert sorted((str(None if i != i else int(i)), str(list(map(int, ids))), a, b) for i, ids, a, b in zip(got.doc_id, got.ids, got.ids_sha256, got.decoded_sha256)) == want
    assert (got.n_tokens == got.ids.map(len)).all()
    assert bpe.encode(frame(spark, [])).count() == 0


def test_an_id_with_many_rows_is_spread_over_chunks(spark):
    rows = [(7, f"text number {i} of one id") for i in range(300)]
    docs = frame(spark, rows)
    chunks = chunked(docs, 200, by_text=True)
    assert chunks.chunks > 20 and chunks.rows.groupBy("chunk").count().agg({"count": "max"}).first()[0] < 40
    assert chunked(docs, 200).rows.select("chunk").distinct().count() == 1
    got = bpe.encode(docs, with_ids=False, chunk_bytes=200).toPandas()
    assert sorted(got.ids_sha256) == sorted(brute_tokens(t)[1] for _, t in rows)


def test_distinct_words_of_a_chunk_are_found_a_slice_at_a_time():
    import tracemalloc

    rng = random.Random(4)
    texts = [b" ".join(b"w%d" % rng.randrange(300) for _ in range(2000)) + rng.choice([b"", b"\n", b" "]) for _ in range(250)] + [b"", b" "]
    raw, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    bpe.distinct_words(raw[:100], np.array([0, 100]))  # tables of the hashes
    tracemalloc.start()
    word_off, inverse, words, hashes = bpe.distinct_words(raw, off, 100_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * len(inverse)  # all numbers of all words at once took over 60 bytes a word
    assert [words[k] for k in inverse] == b" ".join(texts).split() and len(set(words)) == len(words) == 300
    assert word_off.tolist() == [0, *np.cumsum([len(t.split()) for t in texts])] and (np.diff(hashes.astype(float)) >= 0).all()


def test_workers_give_freed_memory_back():
    from harvestline.llm.common import pieces

    held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    blocks = [np.ones(12_000) for _ in range(3000)]  # 96 KB each: from the heap, which the last one keeps from shrinking
    last, full = blocks[-1], held()
    del blocks
    assert list(pieces(iter([]))) == [] and held() < full - 200e6 and last[0] == 1


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_no_token_crosses_ascii_white_space(text):
    t = bpe.tokenizer(None)
    words = re.split(r"[\x20\x09-\x0D]+", text)
    assert t.encode(text, add_special_tokens=False).ids == [i for w in words if w for i in t.encode(w, add_special_tokens=False).ids]


# ---- mixing

def brute_targets(sizes, share=1.5, limit=2.0, weights=(5.0, 2.0, 1.0)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    full = {}
    while True:
        rest = share * sum(sizes.values()) - sum(full.values())
        open_ = [s for s in names if s not in full]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > limit * sizes[s] + 1e-9]
        if not over:
            return {s: full.get(s, level * weight[s]) for s in names}
        full |= {s: limit * sizes[s] for s in over}


def mix_rows(n=3000, seed=1):
    rng = random.Random(seed)
    sources = [None, "b", "a", "Z", "é", "tiny", "\U0001f600", "empty"]
    rows = [(i, "w " * (0 if (s := sources[min(int(rng.random() ** 2 * 7), 6)]) == "empty" else rng.randrange(0, 90)), s) for i in range(n)]
    return rows + [(n, "", "empty"), (n + 1, None, "empty"), (None, "w w w", "a")]


def test_targets_and_taken_words(spark):
    rows = mix_rows()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    got = mixing.draws(frame(spark, rows)).toPandas()
    assert len(got) == len(rows)
    want = brute_targets(sizes)
    for source, part in got.groupby("source", dropna=False):
        source = None if source != source else source
        assert np.allclose(part.target, want[source]) and (part.source_size == sizes[source]).all()
        taken = (part["size"] * part.shards.map(len)).sum()
        assert abs(taken - want[source]) <= 90
    assert got.shards.map(len).max() <= 2
    again = mixing.draws(frame(spark, rows[::-1]).repartition(5)).toPandas()
    key = lambda d: sorted((str(i), str(s), list(map(int, x))) for i, s, x in zip(d.doc_id, d.source, d.shards))
    assert key(got) == key(again)
    assert mixing.draws(frame(spark, [])).count() == 0


def test_tree_keeps_every_block_and_balances_shards(spark):
    quotas = spark.createDataFrame([(0, 700), (1, 100), (2, 3), (3, 0)], "rank int, blocks long")
    rows = mixing.split_tree(quotas, 3, 5).collect()
    by_source, by_shard = collections.Counter(), collections.Counter()
    for r in rows:
        by_source[r["rank"]] += r.blocks
        by_shard[r.shard] += r.blocks
    assert by_source == {0: 700, 1: 100, 2: 3} and len(by_shard) == 8 and max(by_shard.values()) - min(by_shard.values()) <= 3
    big = {r.shard: r.blocks for r in rows if r["rank"] == 1}
    assert all(3 <= big.get(s, 0) <= 25 for s in range(8))  # 12.5 each on average


def test_mixture_rows_are_the_draws(spark):
    rows = mix_rows(400)
    mixed = mixing.mixture(frame(spark, rows))
    assert mixed.columns == frame(spark, []).columns and set(r["size"] for r in mixed.select("size").collect()) == {3}
    drawn = mixing.draws(frame(spark, rows)).toPandas()
    want = collections.Counter({i: 0 for i in ()})
    for i, x in zip(drawn.doc_id, drawn.shards):
        want[str(i)] += len(x)
    got = collections.Counter(str(float(r.doc_id)) if r.doc_id is not None else "nan" for r in mixed.select("doc_id").collect())
    assert got == +want


def test_native_plan(spark):
    plan = QUERIES["op10_source_mixing"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- pipeline

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        steps[name] = docs = docs.cache()
        if name != "bpe":
            assert docs.columns == before.columns
    source = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score(source, labels).where("predicted = 1").collect()}
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    assert sorted(ids(steps["toxicity"])) == sorted(set(ids(source)) - toxic)
    kept = brute_components([(r.doc_id, r.text) for r in steps["toxicity"].select("doc_id", "text").collect()], 5, 80)
    assert sorted(ids(steps["near_dedup"])) == sorted(i for i, (_, c) in kept.items() if i == c)
    assert sorted(ids(steps["secrets"])) == sorted(ids(steps["near_dedup"]))
    texts = {r.doc_id: r.text for r in steps["secrets"].collect()}
    assert not any("token = \"" in t for t in texts.values())
    mixed = collections.Counter(ids(steps["mixing"]))
    assert set(mixed) <= set(texts) and max(mixed.values()) <= 2
    got = steps["bpe"].toPandas()
    assert collections.Counter(got.doc_id) == mixed
    assert all(r.ids_sha256 == brute_tokens(texts[r.doc_id])[1] for r in got.itertuples())


CLASHING = ["rank", "passes", "spans", "count", "_shard", "_block", "_inner", "_order", "__row", "size", "target", "shards", "n", "component_id", "key", "token", "chunk"]


def clashing(spark, n=300):
    rng = random.Random(12)
    rows = [(k if k % 10 else None, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1, 60))), f"s{k % 5}", *[f"{k} {c}" for c in CLASHING]) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)), rows


def test_mixing_with_columns_of_inner_names(spark):
    df, rows = clashing(spark)
    mixed = mixing.mixture(df)
    assert mixed.columns == df.columns
    assert {tuple(r) for r in mixed.collect()} <= set(rows)
    drawn = mixing.draws(df)
    assert drawn.columns == [c for c in df.columns if c not in mixing.ADDED] + list(mixing.ADDED)
    assert {(r.text, r["rank"], r["_block"], r["count"]) for r in drawn.collect()} == {(r[1], r[3], r[8], r[6]) for r in rows}


def test_mixing_without_ids_meets_its_targets(spark):
    rng = random.Random(13)
    rows = [(None, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(5, 40))), f"s{k % 4}") for k in range(4000)]
    got = mixing.draws(frame(spark, rows)).toPandas()
    taken = (got["size"] * got.shards.map(len)).groupby(got.source).sum()
    target = got.groupby("source").target.first().astype(float)
    assert (abs(taken - target) / target).max() < 0.01


@pytest.mark.parametrize("name", ["toxicity", "near_dedup", "secrets", "mixing"])
def test_stages_keep_columns_of_inner_names(spark, tmp_path, name):
    df, rows = clashing(spark, 120)
    spark.createDataFrame([(k, 1, int(k % 7 == 0)) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = dict(corpus_pipeline.STAGES)[name](spark, df, str(tmp_path))
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} <= set(rows)
