"""Near-duplicate texts by weighted minhash over TF-IDF shingles.

A shingle is five consecutive words, lower case; a shorter text is one shingle
of all its words. Its weight is its count times the sum of the IDF of its
words: under independence that sum is the log of how rarely the shingle is
expected. (The IDF of the shingle itself would give a shingle that many copies
share almost no weight, and so tell copies apart by what they do not share.)
Words are counted in a fixed number of hash buckets, over all documents.

Signatures are improved consistent weighted samples (ICWS): each of ``BANDS`` x
``ROWS`` samples agrees with the probability of the weighted Jaccard
similarity. Texts that agree in a band are candidates. Candidates are put
together in clusters, and inside a cluster all pairs are verified by exact
weighted Jaccard, in blocks: no pair is written, only the links that connect.

Defined results:

* null texts, texts without words, null ids: a class of their own;
* equal texts: one class, compared once for all copies;
* repeated ids: rows of their own in a common class;
* ties: similarity of exactly ``MIN_SIMILARITY`` links;
* empty table: empty result; columns of the input named like an output: kept inside ``row``.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.joins import broadcast_if_small
from driftline.llm.components import components
from driftline.llm.tables import packed, words, written

SHINGLE = 5
MIN_SIMILARITY = 0.8
BANDS = 20
ROWS = 5
SAMPLES = BANDS * ROWS
IDF_BUCKETS = 1 << 20
SLOTS = 1 << 12
CHUNK = 512
#: A member whose estimate to the head of its bucket is below this gets another head.
UNRELATED = 0.35
#: Least estimate of a pair at ``MIN_SIMILARITY`` that is provided for: with 100 samples, one pair in 10,000 is below.
LEAST_ESTIMATE = 0.65
#: A member at or above this cannot be so near to one below ``UNRELATED``; the others look for a further head as well.
SETTLED = UNRELATED + 1 - LEAST_ESTIMATE
BLOCK_ROWS = 1024
BLOCK_WORDS = 2_000_000
PACK_ROWS = 256
#: Above so many texts, elements of at most ``FEW`` texts are summed by pairs.
SMALL = 128
FEW = 8
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                    0xFF51AFD7ED558CCD], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def shingles(hashes: np.ndarray, idf: np.ndarray):
    """Distinct shingles of a text: hash, count and IDF."""
    h = hashes.view(np.uint32).astype(np.uint64)
    rare = idf[(h % np.uint64(IDF_BUCKETS)).astype(np.int64)]
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    key, weight = np.full(n, size, np.uint64), np.zeros(n)
    for j in range(size):
        key += mixed(h[j:j + n]) * FACTORS[j]
        weight += rare[j:j + n]
    key, first, count = np.unique(mixed(key), return_index=True, return_counts=True)
    return key, count, weight[first]


@functools.cache
def variates():
    """Variates by slot and sample: 1 / r, beta and r with r from Gamma(2, 1) and beta uniform; ln c with c as r."""
    rng = np.random.default_rng(20240229)
    shape = (SLOTS, SAMPLES)
    r, beta, c = rng.gamma(2.0, 1.0, shape), rng.random(shape), rng.gamma(2.0, 1.0, shape)
    return np.stack([1 / r, beta, r], axis=1).astype(np.float32), np.log(c).astype(np.float32)


def signature(hashes: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """One 32-bit value per sample; long texts are taken in chunks."""
    key, count, weight = shingles(hashes, idf)
    logs = np.log(count * weight).astype(np.float32)
    steps_table, c_table = variates()
    best = np.full(SAMPLES, np.inf, np.float32)
    out = np.zeros(SAMPLES, np.uint64)
    for start in range(0, len(key), CHUNK):
        k = key[start:start + CHUNK]
        one, two = (k & np.uint64(SLOTS - 1)).astype(np.int64), (k >> np.uint64(40)).astype(np.int64) % SLOTS
        drawn = steps_table.take(one, axis=0)
        t = drawn[:, 0] * logs[start:start + CHUNK, None]
        t += drawn[:, 1]
        np.floor(t, out=t)
        a = t - drawn[:, 1]
        a += 1
        a *= drawn[:, 2]
        np.subtract(c_table.take(two, axis=0), a, out=a)  # ln c - r (t - beta) - r
        at = a.argmin(0)
        low = a[at, np.arange(SAMPLES)]
        better = low < best
        best[better] = low[better]
        steps = t[at, np.arange(SAMPLES)].astype(np.int64).view(np.uint64)
        out[better] = mixed(k[at] + steps * FACTORS[1])[better]
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def idf_table(docs: DataFrame) -> np.ndarray:
    """IDF by bucket of words, from the documents of the whole table; a table of fixed size."""
    buckets = F.array_distinct(F.transform("words", lambda h: F.pmod(h, F.lit(IDF_BUCKETS))))
    counts = docs.select(F.explode(buckets).alias("bucket")).groupBy("bucket").count().toArrow()
    found = np.zeros(IDF_BUCKETS)
    found[counts["bucket"].to_numpy()] = counts["count"].to_numpy()
    return (1.0 + np.log((docs.count() + 1) / (found + 1))).astype(np.float32)


def prepared(df: DataFrame, doc_id: str, text: str, keep: list[str] | None) -> DataFrame:
    """``row``, id, text and a key of the text."""
    out = packed(df, keep, id=doc_id, text=text)
    return out.withColumn("key", F.md5(F.col("text").cast("binary")))


def hashed(docs: DataFrame) -> DataFrame:
    """(id, key, n_words, words) of documents with an id and words, written once: 32-bit hashes, in order.

    Two words that share a hash would have to stand at the same place of two
    texts to matter, one chance in 2^32.
    """
    found = docs.select("id", "key", words(F.lower("text")).alias("words")).filter(
        (F.size("words") > 0) & F.col("id").isNotNull())
    return written(found.select("id", "key", F.size("words").alias("n_words"),
                                F.transform("words", lambda w: F.hash(w)).alias("words")), "words")


def signed(docs: DataFrame, idf) -> DataFrame:
    """One row per distinct text: key, smallest id, length, signature."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def sign(batch: pa.Array) -> pa.Array:
        table = idf.value
        rows = [signature(np.asarray(x.values), table) for x in batch]
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, SAMPLES, dtype=np.int32), flat)

    found = docs.select("key", "id", "n_words", sign("words").alias("signature"))
    return found.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"),
                                    F.first("n_words").alias("n_words"), F.first("signature").alias("signature"))


def heads(rows: DataFrame) -> DataFrame:
    """``rows`` (band, hash, id) of buckets with several members, next to the smallest id of the bucket."""
    first = rows.groupBy("band", "hash").agg(F.min("id").alias("head"), F.count("*").alias("n")).filter(
        "n > 1").select(F.col("band").alias("b"), F.col("hash").alias("h"), "head")
    return rows.join(first, (F.col("band") == F.col("b")) & (F.col("hash") == F.col("h"))).select(
        "band", "hash", "id", "head")


def estimated(links: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, head) with the share of agreeing samples."""
    mine, other = (reps.select(F.col("id").alias(n), F.col("signature").alias(s))
                   for n, s in (("id", "s"), ("head", "t")))
    same = F.aggregate(F.zip_with("s", "t", lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)
    return links.join(mine, "id").join(other, "head").select("id", "head", (same / SAMPLES).alias("estimate"))


def candidate_links(reps: DataFrame, rounds: int = 3) -> DataFrame:
    """(id, head) links that keep similar texts of a bucket together.

    Every member is linked to the head of its bucket if they seem related.
    Members that are not get a head among themselves; after some rounds the
    rest is linked to its head as it is, so no candidate is lost. Two texts
    differ in at least as many samples as one agrees more often with the head
    than the other, so a pair that one head would part has its better member
    below ``SETTLED``: such members are linked and get a further head too.
    """
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(
        i.alias("band"), F.xxhash64(F.slice("signature", i * ROWS + 1, ROWS)).alias("hash"))))
    rows = written(heads(reps.select("id", band.alias("x")).select("x.*", "id")), "buckets")
    found = None
    for turn in range(rounds):
        links = rows.filter("id <> head").select("id", "head").distinct()
        near = written(estimated(links, reps).filter(F.col("estimate") >= UNRELATED), "near")
        linked = near.select("id", "head")
        found = linked if found is None else found.unionByName(linked)
        settled = near.filter(F.col("estimate") >= SETTLED).select("id", "head")
        open_rows = written(rows.filter("id <> head").join(settled, ["id", "head"], "left_anti"), "open")
        # a bucket whose members are all linked to its head parts no pair
        parted = open_rows.join(linked, ["id", "head"], "left_anti").select("band", "hash").distinct()
        rows = written(heads(open_rows.join(parted, ["band", "hash"], "left_semi").select("band", "hash", "id")),
                       "buckets")
        if rows.isEmpty():
            return found.distinct()
    return found.unionByName(rows.filter("id <> head").select("id", "head")).distinct()


def overlaps(docs: list[tuple], n: int):
    """Total weights, and the weights that pairs have in common, of a few texts.

    The k-th occurrence of a shingle is an element with the shingle's IDF as
    weight, so the common weight of two texts is a sum over common elements.
    Elements of many texts are summed by a matrix product, those of few by pairs.
    """
    element = np.concatenate([e for e, _ in docs])
    weight = np.concatenate([w for _, w in docs])
    owner = np.repeat(np.arange(n), [len(e) for e, _ in docs])
    total = np.bincount(owner, weight, minlength=n)
    order = np.argsort(element, kind="stable")
    element, weight, owner = element[order], weight[order], owner[order]
    start = np.flatnonzero(np.append(True, element[1:] != element[:-1]))
    size = np.diff(np.append(start, len(element)))
    common = np.zeros((n, n))
    wide = np.flatnonzero(size > (1 if n <= SMALL else FEW))
    for part in range(0, len(wide), 1024):
        first, count = start[wide[part:part + 1024]], size[wide[part:part + 1024]]
        at = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
        x = np.zeros((n, len(first)))
        x[owner[at], np.repeat(np.arange(len(first)), count)] = np.sqrt(weight[at])
        common += x @ x.T
    for m in range(2, FEW + 1) if n > SMALL else ():
        first = start[size == m]
        for i, j in itertools.permutations(range(m), 2):
            np.add.at(common, (owner[first + i], owner[first + j]), weight[first])
    return total, common


def elements(hashes: np.ndarray, idf: np.ndarray):
    key, count, weight = shingles(hashes, idf)
    if count.max() > 1:
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        key = mixed(np.repeat(key, count) + nth.astype(np.uint64) * FACTORS[2])
        weight = np.repeat(weight, count)
    return key, weight


def local_links(ids: np.ndarray, docs: list[tuple]) -> np.ndarray:
    """Smallest id of the component of each text, among these texts."""
    total, common = overlaps(docs, len(docs))
    near = common >= MIN_SIMILARITY * (total[:, None] + total[None, :] - common) * (1 - 1e-12)
    np.fill_diagonal(near, True)
    a, b = np.nonzero(near)
    root = ids.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, a, before[b])
        if (root == before).all():
            return root


def verified(members: DataFrame, idf) -> DataFrame:
    """(id, root) links inside the clusters: rows (cluster, n, blocks, id, words) in, bounded groups.

    Small clusters share groups; a large one is cut into blocks by hash and
    every pair of blocks is a group.
    """

    def compare(table: pa.Table) -> pa.Table:
        cluster, ids = np.array(table.column("cluster")), np.array(table.column("id"))
        column, weights = table.column("words").combine_chunks(), idf.value
        out_id, out_root = [], []
        order = np.argsort(cluster, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            docs = [elements(np.asarray(column[int(i)].values), weights) for i in part]
            root = local_links(ids[part], docs)
            linked = root != ids[part]
            out_id.append(ids[part][linked])
            out_root.append(root[linked])
        return pa.table({"id": pa.array(np.concatenate(out_id), pa.int64()),
                         "root": pa.array(np.concatenate(out_root), pa.int64())})

    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least("block", j).alias("low"), F.greatest("block", j).alias("high"))))
    dealt = members.withColumn("block", block).withColumn("pair", pairs)
    return dealt.select("pack", "pair.low", "pair.high", "cluster", "id", "words").groupBy(
        "pack", "low", "high").applyInArrow(compare, "id long, root long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    keep: list[str] | None = None) -> DataFrame:
    """``row`` with ``class_id`` (smallest id of its class) and ``kept`` (the row that stays).

    ``keep`` names the input columns that ``row`` holds (all). Only texts whose class is not
    their own id are joined back; every other row is its own class.
    """
    docs = prepared(df, doc_id, text, keep)
    known = hashed(docs)
    idf = df.sparkSession.sparkContext.broadcast(idf_table(known))
    reps = written(signed(known, idf), "signed")
    clusters = written(components(candidate_links(reps), "id", "head"), "clusters")
    sizes = clusters.join(reps.select("id", "n_words"), F.col("node") == F.col("id")).groupBy("component").agg(
        F.count("*").alias("n"), F.sum(F.col("n_words").cast("long")).alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_WORDS)).cast("int")
    packs = clusters.count() // PACK_ROWS + 1
    pack = F.when(F.col("blocks") > 1, -1 - F.col("component")).otherwise(
        F.pmod(F.xxhash64("component"), F.lit(packs)))
    placed = clusters.join(sizes.select("component", blocks.alias("blocks")), "component").join(
        reps.select("key", "id"), F.col("node") == F.col("id")).select(
        F.col("key").alias("member"), F.col("id").alias("first_id"), F.col("component").alias("cluster"), "blocks",
        pack.alias("pack"))
    placed = broadcast_if_small(written(placed, "placed"))
    members = known.join(placed, (F.col("key") == F.col("member")) & (F.col("id") == F.col("first_id")))
    links = written(verified(members, idf), "verified")
    classes = components(links, "id", "root")
    named = reps.select("key", "id", "copies").join(classes, F.col("id") == F.col("node"), "left").select(
        F.col("key").alias("rep_key"), F.coalesce("component", "id").alias("class"), "id", "copies").filter(
        (F.col("class") != F.col("id")) | (F.col("copies") > 1)).select("rep_key", "class")
    out = docs.select("row", "id", "key").join(
        broadcast_if_small(written(named, "classes")), F.col("key") == F.col("rep_key"), "left")
    class_id = F.when(F.col("id").isNotNull(), F.coalesce("class", "id"))
    return out.select("row", class_id.alias("class_id"),
                      F.coalesce(F.col("id") == class_id, F.lit(True)).alias("kept"))


def first_of_each(result: DataFrame) -> DataFrame:
    """The rows that stay, one per class: of rows that share an id, the first in order."""
    kept = result.filter("kept").select("row", "class_id")
    repeated = kept.groupBy("class_id").count().filter("count > 1 and class_id is not null").select(
        F.col("class_id").alias("again"))
    repeated = broadcast_if_small(written(repeated, "repeated"))
    if repeated.isEmpty():
        return kept.select("row.*")
    single = kept.join(repeated, F.col("class_id") == F.col("again"), "left_anti").select("row")
    several = kept.join(repeated, F.col("class_id") == F.col("again")).groupBy("class_id").agg(
        F.min("row").alias("row")).select("row")
    return single.unionByName(several).select("row.*")
