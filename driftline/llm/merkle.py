"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf: the SHA-256 of its fields. Leaves of a group, in the order of
their ids, form a tree with ``FANOUT`` children a node; the group roots, in the order
of the groups, form one more tree. A leaf's proof are the siblings on its way up.

Digests travel as messages to the label of the node that needs them. Labels are in
post-order, (last leaf below the node, level), so children come before parents. The
queue is external: a sweep shuffles and sorts the messages by label, a task takes a
run of ``FANOUT ** LEVELS`` leaves from it and keeps those that stay within its run on a
heap (at most ``FANOUT`` a level); the digest of the run is a message to the next sweep.
After the last sweep the queue runs backwards: the proof of a run's top is delivered
to the run, and from node to child down to the leaves. So a sweep costs one
shuffle of digests, the next one holds 4,096 times fewer, and texts are read once.

Defined results:

* null fields: ``-``; other fields: UTF-8 byte count, ``:``, value;
* null group: a group of its own, before all others; null ids: before all other ids;
* repeated ids: ordered by their digests; repeated rows: leaves of their own, equal
  but for their places, so a hot group of copies is dealt out like other leaves;
* a group of one leaf: the leaf is the group root; a table of one leaf: its root too;
* very long texts: hashed where they are read, never moved;
* empty table: empty result, no root;
* columns of the input named like an output: kept inside ``row``, if asked for.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.joins import broadcast_if_small
from driftline.llm.tables import written

FANOUT = 8
LEVELS = 4
RUN = FANOUT ** LEVELS
STEP = "struct<left:string,right:string>"


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256, in hex, of the fields with their lengths."""
    def one(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(one, fields)), 256)


def digest_of(children) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` (group, leaf, ...) written with ``place`` in their group and ``n``, the group's size.

    A range partitioning by group and order, with a number of the row as last key, cuts
    groups and runs of equal leaves into partitions of one size. The place is the number of
    the group's rows in partitions before plus the place inside.
    """
    spread = leaves.withColumn("salt", F.monotonically_increasing_id())
    keys = [F.col("group").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], "leaf", "salt"]
    ranged = written(spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt").withColumn(
        "at", F.monotonically_increasing_id()), "leaves")
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    parts = ranged.groupBy("group", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    # one row per group and partition that holds it
    whole = Window.partitionBy("group")
    before = F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = written(parts.select(
        F.col("group").alias("g"), F.col("part").alias("p"), F.sum("rows").over(whole).alias("n"),
        (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")), "parts")
    return ranged.join(broadcast_if_small(parts), F.col("group").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p"))
                       ).withColumn("place", F.col("at") + F.col("shift")).drop("g", "p", "shift", "at", "part")


def depth(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def parent_label(place: int, level: int, n: int) -> tuple[int, int]:
    """Post-order label of the parent of a node at ``level`` that covers ``place``, among ``n`` leaves."""
    width = FANOUT ** (level + 1)
    return min((place // width + 1) * width, n) - 1, level + 1


def forward(leaves: Iterator[tuple[int, str]], n: int, top: int) -> Iterator[tuple[tuple[int, int], list[str]]]:
    """(label, digests of its children) of the nodes up to level ``top`` over consecutive leaves, in label order."""
    queue: list[tuple[tuple[int, int], int, str]] = []
    for place, digest in leaves:
        heapq.heappush(queue, (parent_label(place, 0, n), place, digest))
        while queue and queue[0][0][0] == place:
            label, children = queue[0][0], []
            while queue and queue[0][0] == label:
                children.append(heapq.heappop(queue)[2])
            yield label, children
            if label[1] < top:
                heapq.heappush(queue, (parent_label(place, label[1], n), place, digest_of(children)))


def backward(runs: list[tuple[tuple[int, int], list[str]]], start: int, n: int, proof: list) -> Iterator[tuple]:
    """(place, proof) of the leaves below the last of ``runs``, from the last leaf to the first."""
    children = dict(runs)
    queue = [((-runs[-1][0][0], -runs[-1][0][1]), proof)]
    while queue:
        (last, level), own = heapq.heappop(queue)
        last, level = -last, -level
        if level == 0:
            yield last, own
            continue
        digests = children[last, level]
        width = FANOUT ** (level - 1)
        first = last - (last % (width * FANOUT))
        for k in range(len(digests)):
            step = {"left": "".join(digests[:k]), "right": "".join(digests[k + 1:])}
            end = min(first + (k + 1) * width, n) - 1
            heapq.heappush(queue, ((-end, -(level - 1)), [step, *own]))


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def swept_up(nodes: DataFrame) -> DataFrame:
    """The tops of all runs of (group, n, place, leaf), as nodes of the next sweep."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (group, _), run in groupby(rows_of(batches, "group", "run", "n", "place", "leaf"), lambda r: r[:2]):
            first = next(run)
            n = first[2]
            leaves = ((r[3], r[4]) for r in (x for part in ((first,), run) for x in part))
            for _, children in forward(leaves, n, min(LEVELS, depth(n))):
                pass
            out.append({"group": group, "n": -(-n // RUN), "place": first[3] // RUN, "leaf": digest_of(children)})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
            [("group", pa.string()), ("n", pa.int64()), ("place", pa.int64()), ("leaf", pa.string())]))

    return in_runs(nodes.filter("n > 1")).mapInArrow(sweep, "group string, n long, place long, leaf string").unionByName(
        nodes.filter("n = 1").select("group", "n", "place", "leaf"))


def in_runs(nodes: DataFrame, *first: str) -> DataFrame:
    dealt = nodes.withColumn("run", F.floor(F.col("place") / RUN))
    return dealt.repartition("group", "run").sortWithinPartitions(
        F.col("group").asc_nulls_first(), "run", *[F.col(c) for c in first], "place")


def swept_down(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """``nodes`` with ``proof``; ``tops`` gives the proof of each run's top by (group, place).

    The proof of a top comes as a message that is sorted before the leaves of its run.
    """
    kept = nodes.schema["row"].dataType if "row" in nodes.columns else None
    row = F.col("row") if kept else F.lit(None).cast("string").alias("row")
    own = nodes.select("group", "n", "place", "leaf", row, F.lit(None).cast(f"array<{STEP}>").alias("proof"),
                       F.lit(1).alias("kind"))
    message = tops.select("group", F.lit(None).cast("long").alias("n"), (F.col("place") * RUN).alias("place"),
                          F.lit(None).cast("string").alias("leaf"), F.lit(None).cast(own.schema["row"].dataType).alias("row"),
                          "proof", F.lit(0).alias("kind"))
    out_schema = own.drop("kind").schema

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proof, key, held, count = None, None, [], 0

        def finished() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            places, leaves = table.column("place").to_pylist(), table.column("leaf").to_pylist()
            n = table.column("n")[0].as_py()
            proofs = [proof]
            if n > 1:
                runs = list(forward(zip(places, leaves), n, min(LEVELS, depth(n))))
                proofs = [p for _, p in backward(runs, places[0], n, proof)][::-1]
            made = pa.array(proofs, table.schema.field("proof").type)
            yield pa.RecordBatch.from_arrays(
                [made if f == "proof" else table.column(f) for f in out_schema.names], names=out_schema.names)

        for batch in batches:
            groups, runs, kinds = (batch.column(c).to_pylist() for c in ("group", "run", "kind"))
            start = 0
            for stop in [*(i for i in range(1, batch.num_rows) if (groups[i], runs[i], kinds[i]) != (
                    groups[i - 1], runs[i - 1], kinds[i - 1])), batch.num_rows]:
                if stop == 0:
                    continue
                if kinds[start] == 0:
                    if held:
                        yield from finished()
                        held.clear()
                    proof = batch.column("proof")[start].as_py()
                else:
                    held.append(batch.slice(start, stop - start))
                start = stop
        if held:
            yield from finished()

    return in_runs(own.unionByName(message), "kind").mapInArrow(sweep, out_schema)


def proofs(leaves: DataFrame, tops: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with proofs, group roots) of placed leaves (group, n, place, leaf, row).

    ``tops`` gives, once the roots are known, the proof of each group's root: a function of them.
    """
    sweeps = [leaves]
    while not sweeps[-1].filter("n > 1").isEmpty():
        sweeps.append(written(swept_up(sweeps[-1]), "sweep"))
    roots = sweeps[-1].select("group", F.col("leaf").alias("subroot"))
    empty = F.array().cast(f"array<{STEP}>").alias("proof")
    above = tops(roots) if tops else roots.select("group", F.lit(0).cast("long").alias("place"), empty)
    for nodes in sweeps[-2::-1]:
        below = swept_down(nodes, above)
        above = below if nodes is leaves else written(below.select("group", "place", "proof"), "proofs")
    if len(sweeps) == 1:  # groups of one leaf only
        above = leaves.join(broadcast_if_small(above.select(F.col("group").alias("g"), "proof")),
                            F.col("group").eqNullSafe(F.col("g"))).drop("g")
    return above, roots


def manifest(df: DataFrame, fields: list[str], doc_id: str = "doc_id", group: str = "lang",
             keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns to keep, by default the id), ``leaf``, ``subroot``, ``root`` and ``proof``.

    The proof is a list of (left, right) from the leaf to the root: digests of the siblings
    before and after, joined. Kept columns travel with the digests, so keep few.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in (keep or [doc_id])])
    leaves = df.select(row.alias("row"), F.col(f"`{group}`").cast("string").alias("group"),
                       F.col(f"`{doc_id}`").alias("id"), leaf_digest([F.col(f"`{c}`") for c in fields]).alias("leaf"))
    leaves = written(leaves, "digests")  # the range partitioning reads its input twice
    found = {}

    def over_groups(roots: DataFrame) -> DataFrame:
        """The tree over the group roots: proofs of the roots, as tops of their groups."""
        subs = roots.select(F.lit("").alias("group"), F.struct(F.col("group").alias("of")).alias("row"),
                            F.struct(F.col("group").isNotNull().alias("known"), "group").alias("id"),
                            F.col("subroot").alias("leaf"))
        proved, top = proofs(placed(subs.withColumn("known", F.col("id.known")).withColumn("name", F.col("id.group")).drop(
            "id"), ["known", "name"]))
        found["root"] = next((r.subroot for r in top.collect()), None)  # one row
        return written(proved.select(F.col("row.of").alias("group"), F.lit(0).cast("long").alias("place"), "proof"),
                       "tops")

    proved, roots = proofs(placed(leaves, ["id"]), over_groups)
    roots = broadcast_if_small(roots.withColumnRenamed("group", "g"))
    return proved.join(roots, F.col("group").eqNullSafe(F.col("g"))).select(
        "row", "leaf", "subroot", F.lit(found["root"]).cast("string").alias("root"), "proof")


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))
