"""Near-duplicate embeddings by an inverted multi-index.

Both halves of the vectors have a codebook of their own; a pair of codewords
is a cell of the product grid. Every vector is filed in the cell of its
nearest codewords and, as a query, visits cells in the order of the summed
distances of its halves (multi-sequence traversal). How many cells it visits
is measured: the fewest that reach the target recall on sampled queries that
have links, compared with all other vectors. What is met in a cell is verified
by cosine in double precision.

Defined results:

* vectors that are null, zero or hold null or non-finite components, and null
  labels or ids: linked with nothing, a component of their own;
* vectors of different length, or with different labels: never linked;
* equal vectors with equal labels: linked, compared once for all copies;
* rows that share an id: rows of their own with a common component;
* empty table: empty result; columns of the input named like an output: kept inside ``row``.

Codebooks and the number of visits are fitted on at most ``MAX_SAMPLE``
vectors and ``MAX_QUERIES`` queries, drawn until ``ENOUGH`` of them have a link;
every vector is filed and is a query.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.joins import broadcast_if_small
from driftline.llm.components import components
from driftline.llm.tables import packed, written

MIN_COSINE = 0.93
MAX_SAMPLE = 20_000
FIRST_QUERIES = 512
MAX_QUERIES = 8192
ENOUGH = 64
TARGET = 0.98
CELL_ROWS = 32
MAX_CODEWORDS = 1024
BLOCK = 2048


def unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def halves(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of ``width`` components each; vectors of another length are cut or padded to file them."""
    full = np.zeros((len(x), 2 * width))
    n = min(2 * width, x.shape[1])
    full[:, :n] = x[:, :n]
    return full[:, :width], full[:, width:]


def distances(x: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ codebook.T + (codebook * codebook).sum(1), 0)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(7)
    centers = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        nearest = distances(x, centers).argmin(1)
        counts = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, x)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def traversal(d1: np.ndarray, d2: np.ndarray, visits: int) -> list[int]:
    """The ``visits`` nearest cells of the grid, nearest first, by the multi-sequence algorithm."""
    o1, o2, k = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable"), len(d2)
    s1, s2, out = d1[o1].tolist(), d2[o2].tolist(), []
    heap, reached = [(s1[0] + s2[0], 0, 0)], {}
    while heap and len(out) < visits:
        _, i, j = heapq.heappop(heap)
        out.append(int(o1[i]) * k + int(o2[j]))
        reached[i] = j
        if i + 1 < len(s1) and (j == 0 or reached.get(i + 1, -1) == j - 1):
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
        if j + 1 < k and (i == 0 or reached.get(i - 1, -1) > j):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
    return out


def distinct_vectors(df: DataFrame) -> DataFrame:
    """(key, id, label, v, copies) of each valid (label, vector); ``id`` is the smallest."""
    return df.filter("key is not null").groupBy("key").agg(
        F.min("id").alias("id"), F.first("label").alias("label"), F.first("v").alias("v"),
        F.count("*").alias("copies"))


def keyed(df: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """``row``, id, label, vector, and a key of label and vector that is null for invalid rows."""
    out = packed(df, id=vec_id, label=label, v=embedding).withColumn("v", F.col("v").cast("array<double>"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)
    words = F.array_join(F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")), ",")
    return out.withColumn("key", F.when(valid, F.md5(F.concat_ws("|", F.col("label").cast("string"), words))))


class Index:
    """Two codebooks; files vectors and lists the cells they visit."""

    def __init__(self, sample: np.ndarray, n: int):
        self.width = max(1, (sample.shape[1] + 1) // 2)
        k = min(MAX_CODEWORDS, max(4, math.ceil(math.sqrt(n / CELL_ROWS))))
        self.books = [k_means(h, min(k, len(sample))) for h in halves(sample, self.width)]

    def distances(self, x: np.ndarray):
        return [distances(h, b) for h, b in zip(halves(x, self.width), self.books)]

    def cells(self, x: np.ndarray, visits: int) -> list[list[int]]:
        d1, d2 = self.distances(x)
        return [traversal(a, b, visits) for a, b in zip(d1, d2)]


def by_width(vectors: pa.Array):
    """Row numbers and unit vectors of each length in a batch."""
    lengths = np.array([len(v) for v in vectors])
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, unit(vectors.take(pa.array(rows)).to_pylist())


def target_rank(ranks) -> int:
    ranks = sorted(ranks)
    return ranks[min(len(ranks) - 1, math.ceil(TARGET * len(ranks)))]


def planted_ranks(index: Index, sample: np.ndarray) -> list[int]:
    """Cells a query visits up to its link, for links planted at a cosine of exactly ``MIN_COSINE``.

    Each query is a vector of the sample turned towards another one. No link is
    farther away, so the ranks are what a table with few links to measure may need.
    """
    x = sample[:FIRST_QUERIES]
    aside = np.roll(sample, 1, axis=0)[:FIRST_QUERIES]
    aside = aside - (aside * x).sum(1)[:, None] * x
    size = np.linalg.norm(aside, axis=1)
    x, aside = x[size > 1e-9], aside[size > 1e-9] / size[size > 1e-9][:, None]
    if not len(x):
        return [1]
    d1, d2 = index.distances(MIN_COSINE * x + math.sqrt(1 - MIN_COSINE ** 2) * aside)
    e1, e2 = index.distances(x)
    reach = d1[np.arange(len(x)), e1.argmin(1)] + d2[np.arange(len(x)), e2.argmin(1)]
    return [int((a[:, None] + b[None, :] <= r).sum()) for a, b, r in zip(d1, d2, reach)]


def build(reps: DataFrame) -> tuple[Index, int]:
    """The index, and the number of cells to visit for the target recall.

    Queries, in hash order, are compared with every other vector: for each query
    that has links the rank of the last cell that holds one. The visits are the
    ``TARGET`` quantile of these ranks. A query without links has no rank, so
    four times as many are drawn until ``ENOUGH`` have links; if they are still
    fewer, the visits also cover links planted at the threshold.
    """
    n = reps.count()
    order = [F.xxhash64("key"), "key"]
    sizes = reps.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    rows = reps.filter(F.size("v") == sizes["width"]).orderBy(*order).limit(MAX_SAMPLE).select(
        "key", "label", "v").collect()
    sample = unit([r.v for r in rows])
    index = Index(sample, n)
    grid = len(index.books[0]) * len(index.books[1])

    def measured(start: int, stop: int) -> list[int]:
        queries = sample[start:stop]
        keys = np.array([r.key for r in rows[start:stop]], object)
        labels = np.array([r.label for r in rows[start:stop]], object)

        def ranks(batches):
            d1, d2 = index.distances(queries)
            for batch in batches:
                q, rank = [], []
                for at, x in by_width(batch.column("v")):
                    if x.shape[1] != queries.shape[1]:
                        continue
                    key, label = (np.array(batch.column(c).take(pa.array(at)).to_pylist(), object)
                                  for c in ("key", "label"))
                    e1, e2 = (e.argmin(1) for e in index.distances(x))
                    for first in range(0, len(queries), FIRST_QUERIES):
                        a, b = np.nonzero(queries[first:first + FIRST_QUERIES] @ x.T >= MIN_COSINE)
                        a += first
                        other = (labels[a] == label[b]) & (keys[a] != key[b])
                        a, b = a[other], b[other]
                        for i in np.unique(a):
                            mine = b[a == i]
                            reach = (d1[i, e1[mine]] + d2[i, e2[mine]]).max()
                            q.append(int(i))
                            rank.append(int(((d1[i][:, None] + d2[i][None, :]) <= reach).sum()))
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(rank, pa.int64())], ["q", "rank"])

        return [r.rank for r in reps.select("key", "label", "v").mapInArrow(ranks, "q int, rank long").groupBy(
            "q").agg(F.max("rank").alias("rank")).select("rank").collect()]

    needed: list[int] = []
    start, stop = 0, FIRST_QUERIES
    while start < min(len(rows), MAX_QUERIES) and len(needed) < ENOUGH:
        needed += measured(start, min(stop, MAX_QUERIES))
        start, stop = stop, 4 * stop
    visits = target_rank(needed) if needed else 1
    if len(needed) < ENOUGH:
        visits = max(visits, target_rank(planted_ranks(index, sample)))
    return index, min(grid, max(4, visits))


VISITED = T.ArrayType(T.IntegerType())


def compare(table: pa.Table) -> pa.Table:
    """Links between the queries and the members of one block of a cell.

    A query counts the copies of each member it links with. The member counts
    the query only if it does not visit the query's own cell, where it counts
    it as a query. One row per vector with links: its count and the smallest
    id of its component inside the block.
    """
    side = np.array(table.column("member"))
    ids, copies = np.array(table.column("id")), np.array(table.column("copies"))
    keys = table.column("key").to_pylist()
    x = unit(table.column("v").to_pylist())
    q, m = np.flatnonzero(~side), np.flatnonzero(side)
    own = np.array(table.column("own"))
    visited = [set(v) if s else () for v, s in zip(table.column("visited").to_pylist(), side)]
    key_of = {k: i for i, k in reversed(list(enumerate(keys)))}
    same = np.array([key_of[k] for k in keys])  # one place per vector, on whichever side it is
    links, root = np.zeros(len(ids), np.int64), ids.copy()
    pairs = []
    for start in range(0, len(q), 512):
        part = q[start:start + 512]
        a, b = np.nonzero(x[part] @ x[m].T >= MIN_COSINE)
        a, b = part[a], m[b]
        keep = same[a] != same[b]
        a, b = a[keep], b[keep]
        np.add.at(links, same[a], copies[b])
        other = np.array([own[i] not in visited[j] for i, j in zip(a.tolist(), b.tolist())], bool)
        if other.any():
            np.add.at(links, same[b[other]], copies[a[other]])
        pairs.append((same[a], same[b]))
    a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (root == before).all():
            break
    seen = np.unique(np.concatenate([a, b])).astype(np.int64)
    return pa.table({"key": pa.array([keys[i] for i in seen], pa.string()), "id": pa.array(ids[seen], pa.int64()),
                     "links": pa.array(links[seen], pa.int64()), "root": pa.array(root[seen], pa.int64())})


def file_vectors(reps: DataFrame, index: Index, visits: int) -> DataFrame:
    """``reps`` with the cells each one visits, its own first."""

    @F.arrow_udf(VISITED)
    def cells(vectors: pa.Array) -> pa.Array:
        out: list = [None] * len(vectors)
        for at, x in by_width(vectors):
            for i, visited in zip(at, index.cells(x, visits)):
                out[i] = visited
        return pa.array(out, pa.list_(pa.int32()))

    return reps.withColumn("visited", cells("v")).withColumn("own", F.col("visited")[0])


def links(reps: DataFrame, index: Index, visits: int) -> DataFrame:
    """(key, id, links, root): partial counts and local components, from all blocks of all cells.

    A cell is cut into blocks of members and blocks of queries by hash; each
    pair of blocks is one bounded group, so a cell that holds a third of all
    vectors is many groups.
    """
    filed = written(file_vectors(reps, index, visits), "filed").withColumn("width", F.size("v"))
    members = filed.withColumn("cell", F.col("own"))
    queries = filed.withColumn("cell", F.explode("visited"))
    cell = ["label", "width", "cell"]
    blocks = members.groupBy(*cell).agg(F.count("*").alias("m")).join(
        queries.groupBy(*cell).agg(F.count("*").alias("q")), cell).select(
        *cell, F.ceil(F.col("m") / BLOCK).cast("int").alias("m_blocks"),
        F.ceil(F.col("q") / (2 * BLOCK)).cast("int").alias("q_blocks"))
    blocks = broadcast_if_small(written(blocks, "blocks"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    chosen = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    columns = [*cell, "m_block", "q_block", "member", "key", "id", "copies", "own", "visited", "v"]
    left = members.join(blocks, cell).withColumns(
        {"member": F.lit(True), "m_block": chosen(F.col("m_blocks"))}).withColumn("q_block", spread(F.col("q_blocks")))
    right = queries.withColumn("visited", F.lit(None).cast("array<int>")).join(blocks, cell).withColumns(
        {"member": F.lit(False), "q_block": chosen(F.col("q_blocks"))}).withColumn("m_block", spread(F.col("m_blocks")))
    return left.select(columns).unionByName(right.select(columns)).groupBy(*cell, "m_block", "q_block").applyInArrow(
        compare, "key string, id long, links long, root long")


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                    label: str = "label") -> DataFrame:
    """``row`` with ``n_links``, ``component_id`` and ``kept`` (first of its component)."""
    rows = written(keyed(df, vec_id, embedding, label), "vectors")
    reps = written(distinct_vectors(rows), "distinct")
    if reps.isEmpty():
        found = reps.select("key", "id", F.lit(0).cast("long").alias("links"), F.col("id").alias("root"))
    else:
        found = written(links(reps, *build(reps)), "found")
    groups = components(found, "id", "root")
    totals = found.groupBy("key").agg(F.sum("links").alias("links"))
    result = reps.select("key", "id", "copies").join(totals, "key", "left").join(
        groups, F.col("id") == F.col("node"), "left").select(
        "key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    return rows.join(written(result, "result"), "key", "left").select(
        "row", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"))
