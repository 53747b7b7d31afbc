"""Conversation structure repair by a persistent audit DP.

Faulty turns are named (blank, duplicate, truncated), and the cheapest edits are
found after which the roles read ``(s?(ua)+)?``: keep a turn, give it another role,
delete it, insert an empty one. Of equally cheap edits the audit, the edits' initials in
order, that is least in ASCII wins.

The DP walks along the turns with one state per place in the grammar. The edits that lead
to a state are a node that points to the node before it, so all states share their
prefixes (``Trail``). A tie is decided where two paths part: rolling hashes of the prefixes
and binary-lifting ancestors find the longest common prefix, and equal hashes are verified.
Every turn adds one piece to a path (insertions before it, then its own letter), so paths
to one place are equally long in pieces and no piece is a prefix of another.

Conversations of any length: turns are sorted by range partitioning and cut into blocks of
at most ``BLOCK`` turns. A block gives its cheapest edits from every state to every state,
and the blocks of a conversation are joined by the same DP with blocks in place of turns.
No task holds more than a block of turns; what meets by conversation is one row a block.

Defined results:

* null role or text: one space; null id: one conversation of its own; null turn: before all others;
* equal turns: ordered by role, then text; repeated rows: duplicates but for the first;
* a role is known by its first character; an empty role is never legal;
* white space is ASCII's, a text of nothing else is blank; very long texts: only their ends
  and digests take part in the DP;
* empty table: empty result; further columns: not part of a conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.merkle import rows_of
from driftline.llm.tables import written

BLOCK = 1024
# fixed values: costs of the edits, and of leaving a truncated turn as it is
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANK, DUPLICATE, CUT = 1, 2, 3  # faults; 0 is none
#: States: nothing yet, after the system turn, after a user's, after an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ENDS = (START, ASSISTANT)
#: Edits with the role they give: insert user or assistant, rerole to user or assistant; their initials.
INSERTED, REROLED = {"u": "u", "a": "a"}, {"u": "U", "a": "A"}
INITIALS = str.maketrans("uaUA", "IIRR")
ROLES = {"u": "user", "a": "assistant"}
MODULUS, BASE = (1 << 61) - 1, 1_000_003


class Trail:
    """Paths of pieces as linked nodes; node 0 is the empty path."""

    def __init__(self):
        self.piece, self.up, self.hash = [""], [()], [0]

    def grow(self, node: int, piece: str) -> int:
        """The path of ``node`` with one more piece; ancestors at 1, 2, 4, ... nodes up."""
        up = [node]
        while len(self.up[up[-1]]) >= len(up):
            up.append(self.up[up[-1]][len(up) - 1])
        self.up.append(tuple(up))
        self.piece.append(piece)
        value = hash_of(piece.translate(INITIALS))
        self.hash.append((self.hash[node] * BASE + value) % MODULUS)
        return len(self.piece) - 1

    def pieces(self, node: int) -> list[str]:
        out = []
        while node:
            out.append(self.piece[node])
            node = self.up[node][0]
        return out[::-1]

    def same(self, a: int, b: int) -> bool:
        """Whether two paths have equal initials: a walk back to where they share a node."""
        while a != b:
            if self.piece[a].translate(INITIALS) != self.piece[b].translate(INITIALS):
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether path ``a`` has smaller initials than path ``b`` of as many pieces."""
        if a == b or self.hash[a] == self.hash[b] and self.same(a, b):
            return False
        x, y = a, b
        for k in range(len(self.up[a]) - 1, -1, -1):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        before_x, before_y = self.up[x][0] if x else 0, self.up[y][0] if y else 0
        p, q = self.piece[x].translate(INITIALS), self.piece[y].translate(INITIALS)
        if p != q and self.same(before_x, before_y):
            return p < q
        left, right = ([s.translate(INITIALS) for s in self.pieces(n)] for n in (a, b))
        return left < right  # a collision of hashes


def hash_of(text: str) -> int:
    return int.from_bytes(text.encode(), "big") % MODULUS + 1


#: (state, insertions, state after them) that can pay: two insertions lead back to a state after a user's turn.
def openings(state: int) -> list[tuple[str, int]]:
    out = [("", state)]
    while len(out) < (2 if state == USER else 3):
        role = NEXT[out[-1][1]]
        out.append((out[-1][0] + INSERTED[role], AFTER[role]))
    return out


OPENINGS = {state: openings(state) for state in range(4)}


def choices(initial: str, fault: int) -> list[tuple[int, int, int, str]]:
    """(state, state after, cost, piece) of all edits of one turn with what is inserted before it."""
    out = [(state, state, DELETE, "D") for state in range(4)]
    if fault in (BLANK, DUPLICATE):
        return out
    extra = TRUNCATED if fault == CUT else 0
    for state, opened in OPENINGS.items():
        for inserted, at in opened:
            cost = INSERT * len(inserted) + extra
            if initial and (initial == NEXT[at] or initial == "s" and at == START):
                out.append((state, AFTER[initial], cost + KEEP, inserted + "K"))
            role = NEXT[at]
            out.append((state, AFTER[role], cost + REROLE, inserted + REROLED[role]))
    return out


CHOICES = {(i, f): choices(i, f) for i in ("s", "u", "a", "") for f in range(4)}


def best(trail: Trail, states: dict[int, tuple[int, int]], steps) -> dict[int, tuple[int, int]]:
    """The DP over one turn or block: the cheapest (cost, node) per state after ``steps``."""
    found: dict[int, tuple[int, int, str]] = {}
    ties: dict[int, list[tuple[int, str]]] = {}
    for state, after, cost, piece in steps:
        if state in states:
            total = states[state][0] + cost
            if after not in found or total < found[after][0]:
                found[after] = total, states[state][1], piece
                ties[after] = [(states[state][1], piece)]
            elif total == found[after][0]:
                ties[after].append((states[state][1], piece))
    out = {}
    for after, (total, _, _) in found.items():
        nodes = [trail.grow(n, p) for n, p in ties[after]]
        node = nodes[0]
        for other in nodes[1:]:
            if trail.less(other, node):
                node = other
        out[after] = total, node
    return out


def block_edits(turns: list[tuple[str, int]], starts) -> list[tuple[int, int, int, list[str]]]:
    """(state before, state after, cost, pieces) over a block of (initial, fault)."""
    out = []
    for start in starts:
        trail, states = Trail(), {start: (0, 0)}
        for initial, fault in turns:
            states = best(trail, states, CHOICES[initial if initial in AFTER else "", fault])
        out += [(start, after, cost, trail.pieces(node)) for after, (cost, node) in states.items()]
    return out


def joined_edits(blocks: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[str]]:
    """(cost, edits of each block and those after the last) of a whole conversation."""
    trail, states = Trail(), {START: (0, 0)}
    for steps in blocks:
        states = best(trail, states, steps)
    closings = [(state, 0, INSERT * len(inserted), inserted) for state in states
                for inserted, at in OPENINGS[state] if at in ENDS]
    cost, node = best(trail, states, closings)[0]
    return cost, trail.pieces(node)


# ------------------------------------------------------------------- on tables
TURN = "conv_id long, turn long, role string, text string"


def ordered(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """(at, conv_id, turn, role, text), written in order: ``at`` grows along a conversation.

    The row's number is the last key of the range partitioning, so copies of one turn, or one
    long conversation, are cut into partitions like other rows.
    """
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                     filled(role).alias("role"), filled(text).alias("text"),
                     F.monotonically_increasing_id().alias("salt"))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "salt"]
    return written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt").withColumn(
        "at", F.monotonically_increasing_id()), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """(at, conv_id, turn, initial, fault): the first fault of each turn.

    The first of equal turns is a minimum by conversation and digest, combined map-side, and
    is found again by its number, which no two turns share.
    """
    text = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    light = turns.select("at", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"),
                         F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"),
                         (text == "").alias("blank"), (~F.substring(text, -1, 1).isin(".", "!", "?")).alias("cut"))
    first = light.groupBy("conv_id", "said").agg(F.min("at").alias("first")).select("first")
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), CUT).otherwise(0)
    return light.join(first, F.col("at") == F.col("first"), "left").select(
        "at", "conv_id", "turn", "initial", fault.alias("fault"))


EDITS = "struct<before:int,after:int,cost:long,edits:string>"
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
BLOCKS = ("conv_id long, block long, first long, last long, head string, tail string, "
          + ", ".join(f"{c} long" for c in COUNTS) + f", paths array<{EDITS}>")
LEGAL = {"su", "ua", "au"}


def block_rows(found: DataFrame) -> DataFrame:
    """One row per conversation and block: counts, ends, and cheapest edits from state to state."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        rows = rows_of(batches, "block", "conv_id", "turn", "initial", "fault")
        for block, in_block in groupby(rows, lambda r: r[0]):
            for k, (conv, part) in enumerate(groupby(in_block, lambda r: r[1])):
                turns = list(part)
                known = [t[2] for t in turns if t[2] is not None]
                codes = [(t[3], t[4]) for t in turns]
                # the first conversation of a block may have begun in the block before
                edits = block_edits(codes, (START,) if k else range(4))
                count = [sum(c[1] == f for c in codes) for f in (BLANK, DUPLICATE, CUT)]
                out.append(dict(
                    zip(COUNTS, [*count, sum(a[0] + b[0] not in LEGAL for a, b in zip(codes, codes[1:])), len(set(known))]),
                    conv_id=conv, block=block, first=known[0] if known else None, last=known[-1] if known else None,
                    head=codes[0][0], tail=codes[-1][0], paths=[
                        {"before": b, "after": a, "cost": c, "edits": " ".join(p)} for b, a, c, p in edits]))
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("last", pa.int64()),
                        ("head", pa.string()), ("tail", pa.string()), *[(c, pa.int64()) for c in COUNTS],
                        ("paths", pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()),
                                                      ("cost", pa.int64()), ("edits", pa.string())])))])
    dealt = found.withColumn("block", F.floor(F.col("at") / BLOCK))
    return dealt.repartition("block").sortWithinPartitions("block", "at").mapInArrow(summarise, BLOCKS)


AUDITS = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, blocks array<long>, edits array<string>")


def audited(blocks: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost, audit, and the edits of each block (one more entry for the end)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        columns = ("conv_id", "block", "first", "last", "head", "tail", "paths", *COUNTS)
        for conv, part in groupby(rows_of(batches, *columns), lambda r: r[0]):
            total, steps, numbers = dict.fromkeys(COUNTS, 0), [], []
            low = high = tail = None
            for _, block, first, last, head, end, paths, *counts in part:
                for name, count in zip(COUNTS, counts):
                    total[name] += count
                total["illegal"] += tail is not None and tail + head not in LEGAL
                total["turns"] -= high is not None and high == first  # counted on both sides
                low, high, tail = first if low is None else low, high if last is None else last, end
                steps.append([(p["before"], p["after"], p["cost"], p["edits"]) for p in paths])
                numbers.append(block)
            cost, edits = joined_edits(steps)
            out.append({"conv_id": conv, "gaps": 0 if low is None else high - low + 1 - total["turns"], "cost": cost,
                        "audit": "".join(edits).replace(" ", "").translate(INITIALS), "blocks": numbers, "edits": edits,
                        **{c: total[c] for c in COUNTS[:4]}})
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", *COUNTS[:4], "cost")],
                        ("audit", pa.string()), ("blocks", pa.list_(pa.int64())), ("edits", pa.list_(pa.string()))])
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(join, AUDITS)


def audit(turns: DataFrame) -> DataFrame:
    """The audits of ``ordered`` turns, written: one row per conversation."""
    return written(audited(written(block_rows(faults(turns)), "blocks")), "audits")


REPAIRED = "conv_id long, role string, text string"


def repaired(turns: DataFrame, audits: DataFrame, whole: bool = False) -> DataFrame:
    """(conv_id, role, text) of the repaired turns, in order within their block.

    A block's edits are a message that is sorted before its turns; edits after the last turn
    are a message after all turns. With ``whole``, blocks of a conversation share a partition, in
    order, which a digest over the conversation needs.
    """
    count = F.size("blocks")
    messages = audits.select("conv_id", F.posexplode("edits").alias("k", "edits"), "blocks").select(
        "conv_id", F.when(F.col("k") < count, F.get("blocks", F.col("k"))).otherwise(
            F.element_at("blocks", -1)).alias("block"),
        F.when(F.col("k") < count, -1).otherwise(BLOCK).cast("long").alias("place"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"), "edits")
    block = F.floor(F.col("at") / BLOCK)
    rows = turns.select("conv_id", block.alias("block"), (F.col("at") - block * BLOCK).alias("place"), "role", "text",
                        F.lit(None).cast("string").alias("edits"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = iter(())
        for batch in batches:
            out = []
            for conv, role, text, edits in rows_of(iter([batch]), "conv_id", "role", "text", "edits"):
                if edits is not None and not edits.strip("ua"):  # after the last turn
                    out += [(conv, ROLES[e], "") for e in edits]
                elif edits is not None:
                    pieces = iter(edits.split(" "))
                else:
                    piece = next(pieces)
                    out += [(conv, ROLES[e], "") for e in piece[:-1]]
                    if piece[-1] != "D":
                        out.append((conv, ROLES.get(piece[-1].lower(), role), text))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    merged = rows.unionByName(messages)
    dealt = merged.repartition("conv_id") if whole else merged.repartition("conv_id", "block")
    return dealt.sortWithinPartitions("conv_id", "block", "place").mapInArrow(apply, REPAIRED)


def digests(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) over ``role:text`` of the repaired turns, joined by newlines.

    SHA-256 takes its input in order, so the turns of a conversation stream through one task, which
    holds a batch of them and the state of the hash.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        out = []
        for conv, part in groupby(rows_of(batches, "conv_id", "role", "text"), lambda r: r[0]):
            state = hashlib.sha256()
            for k, (_, role, text) in enumerate(part):
                state.update(f"{'\n' if k else ''}{role}:{text}".encode())
            out.append({"conv_id": conv, "repaired_sha256": state.hexdigest()})
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    return repaired(turns, audits, whole=True).mapInArrow(digest, "conv_id long, repaired_sha256 string")
