"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification, exact links.

A document is its set of word shingles. Documents with equal sets form one class, told by a
128-bit digest, and only the smallest id of a class goes on. MinHash signatures are cut into
bands; classes that share a band meet in a bucket. No bucket is expanded into all its pairs:
every member is compared with the bucket's pivot, the member that shares the most bands with
others (the text that copies were made from). Where this leaves several components in a bucket,
their members meet again at their rarest common shingles, and only at places where the first one
that two similar sets share can be (``prefixes``): what a text shares with nobody takes up these
places, so that most outsiders meet nobody.

A pair is verified step by step: after each batch of signature bits the posterior probability
that its similarity reaches the threshold is known, and pairs below the chosen miss probability
are pruned. Survivors are verified exactly on their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from harvestline.llm import vectext as vt
from harvestline.llm.common import pieces, prepared, stored, strings
from harvestline.llm.graph import components
from harvestline.llm.membership import members
from harvestline.llm.prefixes import least_partner, pairs_across, useful

U = np.uint64
BANDS, BAND_ROWS = 32, 6   # a pair of similarity 0.8 shares no band with chance 6e-5, of 0.85 with 3e-7
BATCHES = (64, 128, 192)   # signature bits compared after each step
MISS = 1e-6                # posterior chance of reaching the threshold below which a pair is pruned


def mismatch_limits(similarity: float, miss: float = MISS) -> list[int]:
    """Most differing bits with which a pair stays, after each batch. A bit of a MinHash value
    agrees with chance (1 + s) / 2; the prior of s is uniform."""
    s = (np.arange(20_000) + 0.5) / 20_000
    p, limits = (1 + s) / 2, []
    for n in BATCHES:
        limit = 0
        for wrong in range(n + 1):
            log = (n - wrong) * np.log(p) + wrong * np.log1p(-p)
            weight = np.exp(log - log.max())
            if weight[s >= similarity].sum() / weight.sum() < miss:
                break
            limit = wrong
        limits.append(limit)
    return limits


def shingles(raw: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, text by text, and their offsets. Letters A-Z
    are lower-cased; a text of fewer words than ``size`` is one shingle, one without words none."""
    low = vt.LOWER[raw]
    start, end, word_off = vt.words(low, off)
    h = vt.span_hashes(low, start, end, 50)
    at, window_off = vt.window_rows(word_off, size)
    value, row = vt.windows(h, size, 51)[at] if len(at) else np.zeros(0, np.uint64), vt.rows_of(window_off)
    n = np.diff(word_off)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):  # the words of a short text, told apart from those of a full shingle by their number
        total = np.zeros(len(short), np.uint64)
        factor = vt.constants(52)[1]
        for k in range(size - 1):
            has = n[short] > k
            total[has] = total[has] * factor + h[word_off[short[has]] + k]
        value, row = np.concatenate([value, vt.mix(total + n[short].astype(np.uint64))]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        value, row = value[order], row[order]
    first = np.unique(vt.mix(value + vt.mix(row.astype(np.uint64) + U(1))), return_index=True)[1]
    keep = np.zeros(len(value), bool)
    keep[first] = True
    value, row = value[keep], row[keep]
    return value, np.searchsorted(row, np.arange(len(off)))


def minhash(value: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Signature (hash functions x sets) of the non-empty sets."""
    rng = np.random.Generator(np.random.PCG64(77))
    factors = rng.integers(1, 2**63 - 1, BANDS * BAND_ROWS, dtype=np.uint64) * U(2) + U(1)
    shifts = rng.integers(0, 2**64 - 1, BANDS * BAND_ROWS, dtype=np.uint64)
    starts = off[:-1][np.diff(off) > 0]
    out, work = np.empty((len(factors), len(starts)), np.uint64), np.empty_like(value)
    for k, (a, b) in enumerate(zip(factors, shifts)):
        np.multiply(value, a, out=work)
        np.add(work, b, out=work)
        np.minimum.reduceat(work, starts, out=out[k])
    return out


SIGNATURE = "doc_id long, n long, d1 long, d2 long, bands array<long>, s0 long, s1 long, s2 long"


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """For each text: number of shingles, digest of the set, band keys, and signature bits (band
    keys are null for an empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, off in pieces(batches):
            value, at = shingles(raw, off, size)
            n = np.diff(at)
            full = np.flatnonzero(n > 0)
            digests = []
            for salt in (1, 2):
                total = np.zeros(len(n), np.uint64)
                if len(full):
                    total[full] = np.add.reduceat(vt.mix(value + U(salt)), at[:-1][full])
                digests.append(total.view(np.int64))
            keys, bits = np.zeros((len(full), BANDS), np.int64), np.zeros((3, len(n)), np.int64)
            if len(full):
                signature = minhash(value, at)
                for band in range(BANDS):
                    key = np.full(len(full), band + 1, np.uint64)
                    for r in range(BAND_ROWS):
                        key = vt.mix(key * U(31) + signature[band * BAND_ROWS + r])
                    keys[:, band] = key.view(np.int64)
                ones = np.packbits((vt.mix(signature) & U(1)).astype(np.uint8), axis=0, bitorder="little")  # 24 x sets
                for w in range(3):
                    bits[w, full] = np.ascontiguousarray(ones[8 * w:8 * w + 8].T).view("<i8").ravel()
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).cast(pa.int64()), pa.array(n.astype(np.int64)), *[pa.array(d) for d in digests], bands, *[pa.array(b) for b in bits]],
                names=["doc_id", "n", "d1", "d2", "bands", "s0", "s1", "s2"])

    return prepared(docs, "doc_id", "text").mapInArrow(run, SIGNATURE)


def may_link(percent: int) -> Column:
    """Whether a pair (na, a0.. and nb, b0..) survives the size bound and every signature batch."""
    ok = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    wrong = F.lit(0)
    for k, limit in enumerate(mismatch_limits(percent / 100)):
        wrong = wrong + F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}")))
        ok = ok & (wrong <= limit)
    return ok


def packed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, packed) of the documents named in ``ids`` (doc_id). Few others are packed and shuffled."""
    listed = members(ids, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            batch = batch.filter(pa.array(listed.may_hold(batch.column(2).to_numpy())))
            raw, off = strings(batch.column(1))
            for i in range(0, batch.num_rows, 1000):
                j = min(i + 1000, batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(
                    [compressor.compress(raw[a:b].tobytes()) for a, b in zip(off[i:j], off[i + 1:j + 1])], pa.binary())], names=["doc_id", "packed"])

    rows = prepared(docs, "doc_id", "text").withColumn("place", listed.place(F.col("doc_id")))
    return rows.mapInArrow(run, "doc_id long, packed binary").join(ids, "doc_id", "left_semi")


def shared_postings(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Postings (token, node, n, pos) of the shingles of ``texts`` (doc_id, packed) that may be the
    first one a text shares with another it is similar to; rarest first. A task counts its texts
    before anything is shuffled."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                raw = [np.frombuffer(unpack(blob), np.uint8) for blob in part.column(1).to_pylist()]
                yield part.column(0), [np.sort(shingles(r, np.array([0, len(r)]), size)[0].view(np.int64)) for r in raw]

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in sets(batches):
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["token", "seen"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, found in sets(batches):
            digest = [int(vt.mix(f.view(np.uint64)).sum().view(np.int64)) for f in found]
            yield pa.RecordBatch.from_arrays([nodes, pa.array([len(f) for f in found], pa.int64()), pa.array(digest, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                                             names=["node", "n", "text", "tokens"])

    seen = texts.mapInArrow(occurrences, "token long, seen long").groupBy("token").agg(F.sum("seen").alias("seen")).where("seen > 1")
    mine = texts.mapInArrow(members, "node long, n long, text long, tokens array<long>").select("node", "n", "text", F.explode("tokens").alias("token"))
    ordered = mine.join(seen, "token").groupBy("node", "text", "n").agg(F.sort_array(F.collect_list(F.struct("seen", "token"))).alias("common"))
    placed = ordered.select("node", "n", F.size("common").alias("shared"), F.posexplode("common").alias("at", "entry"))
    pos = F.col("at") + 1 + F.col("n") - F.col("shared")
    first = placed.select(F.col("entry.token").alias("token"), "node", "n", pos.alias("pos")).where(F.col("pos") <= F.col("n") - least_partner(F.col("n"), percent) + 1)
    return useful(first, percent)


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) among the pairs: 100 * intersection >= percent * union of the whole sets."""
    mine = lambda c: texts.select(F.col("doc_id").alias(c), F.col("packed").alias(f"text_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last, left = zstandard.ZstdDecompressor().decompress, None, None

        def of(blob: bytes) -> np.ndarray:
            raw = np.frombuffer(unpack(blob), np.uint8)
            return np.sort(shingles(raw, np.array([0, len(raw)]), size)[0])

        for batch in batches:
            linked = []
            for a, blob_a, blob_b in zip(batch.column(0), batch.column(2), batch.column(3)):
                if (key := (a.as_py(), blob_a.as_buffer())) != last:
                    last, left = key, of(blob_a.as_py())
                right = of(blob_b.as_py())
                common = len(np.intersect1d(left, right, assume_unique=True))
                linked.append(100 * common >= percent * (len(left) + len(right) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    both = pairs.select("a", "b").join(mine("b"), "b").join(mine("a"), "a").select("a", "b", "text_a", "text_b")
    return stored(both.mapInArrow(run, "a long, b long, linked boolean").where("linked").select("a", "b").distinct(), "links")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id (the smallest doc_id
    reachable through links, its own if there are none) and kept (whether it is that one).
    A null or wordless text has no shingles and is linked with nothing. A null doc_id gets a null
    component and is kept. Rows that share a doc_id are one node that holds several texts, linked
    when one of them is; each row reports its own n_shingles. Ties and repeated rows fall in one
    class; an empty table gives an empty result."""
    docs = docs.select("doc_id", "text")
    signed = stored(signatures(docs, size), "signatures")
    full = signed.where("n > 0 and doc_id is not null")
    classes = stored(full.groupBy("d1", "d2", "n").agg(
        F.min("doc_id").alias("node"), F.min_by(F.struct("bands", "s0", "s1", "s2"), "doc_id").alias("sig")), "classes")
    keyed = classes.select("node", F.explode("sig.bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    met = stored(keyed.join(shared, "key").distinct(), "meetings")
    rank = F.struct(F.col("meetings"), -F.col("node"))
    central = met.join(met.groupBy("node").agg(F.sum("members").alias("meetings")), "node")
    pivots = central.groupBy("key").agg(F.max_by("node", rank).alias("pivot"))
    buckets = stored(met.select("key", "node").join(pivots, "key"), "buckets")
    ids = stored(buckets.select("node").distinct(), "met")
    texts = stored(packed_texts(docs, ids.withColumnRenamed("node", "doc_id")), "node-texts")
    nodes = stored(classes.select("node", "n", "sig.s0", "sig.s1", "sig.s2", "sig.bands").join(ids, "node", "left_semi"), "nodes")
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), *[F.col(f"s{k}").alias(f"{c}{k}") for k in range(3)])

    # each member against the pivot of its bucket
    stars = buckets.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    survivors = stars.join(side("b"), "b").join(side("a"), "a").where(may_link(percent)).select("a", "b")
    links = verified(survivors, texts, size, percent)

    # members of buckets that this leaves in several components, at their rarest common shingles
    labels = components(links)
    placed = buckets.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    open_nodes = placed.join(mixed, "key").select(F.col("node").alias("doc_id")).distinct()
    postings = stored(shared_postings(stored(texts.join(open_nodes, "doc_id", "left_semi"), "open-texts"), size, percent), "open-postings")
    across = stored(pairs_across(postings, labels, percent), "across")
    more = across.join(side("b"), "b").join(side("a"), "a").where(may_link(percent)).select("a", "b").distinct()
    links = stored(links.union(verified(more, texts, size, percent)), "all-links")
    return resolved(signed, classes, links)


def resolved(signed: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of ``signed`` (doc_id, n, d1, d2) with the component that ``links`` (a, b) between the
    nodes of ``classes`` (d1, d2, n, node) put them in."""
    full = signed.where("n > 0 and doc_id is not null")
    # classes that share a doc_id belong together
    row = F.struct("d1", "d2", "n")
    several = full.groupBy("doc_id").agg(F.min(row).alias("low"), F.max(row).alias("high")).where("low <> high").select("doc_id")
    held = full.select("doc_id", "d1", "d2", "n").join(several, "doc_id").join(classes.select("d1", "d2", "n", "node"), ["d1", "d2", "n"])
    tied = stored(held.join(held.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).where("a <> b").distinct(), "shared-ids")

    final = components(links.union(tied))
    owner = classes.select("d1", "d2", "n", "node").join(final, "node", "left").select("d1", "d2", "n", F.coalesce("component", "node").alias("component"))
    same = [F.col("s.d1") == F.col("o.d1"), F.col("s.d2") == F.col("o.d2"), F.col("s.n") == F.col("o.n")]
    result = signed.select("doc_id", "n", "d1", "d2").alias("s").join(owner.alias("o"), same, "left")
    component = F.when(F.col("s.doc_id").isNotNull(), F.coalesce("o.component", "s.doc_id"))
    return result.select("s.doc_id", F.col("s.n").alias("n_shingles"), component.alias("component_id"),
                         F.coalesce(F.col("s.doc_id") == component, F.lit(True)).alias("kept"))
