"""Merkle manifest, conversation repair and packing against plain versions, and on odd input."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftline.llm import merkle, packing, turn_repair
from driftline.llm.queries import QUERIES
from driftline.llm.tables import read

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------------- merkle
def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def counted(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(digests):
    """(root, proof of each leaf as a list of (left, right))."""
    proofs, at, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 8 * 8:i // 8 * 8 + 8]
            proofs[k].append(("".join(run[:i % 8]), "".join(run[i % 8 + 1:])))
        nodes = [sha("".join(nodes[j:j + 8])) for j in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], proofs


def plain_manifest(rows, fields, group):
    groups = {}
    for r in rows:
        leaf = sha("".join(counted(r[c]) for c in fields))
        groups.setdefault(r[group], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])]) for g in names}
    root, above = plain_tree([trees[g][0] for g in names])
    return sorted((leaf[2], trees[g][0], root, tuple(p + up)) for g, up in zip(names, above)
                  for leaf, p in zip(sorted(groups[g]), trees[g][1]))


def collected(found):
    return sorted((r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.proof)) for r in found.collect())


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8, None: 9, "": 1}, {"z": 4097, "a": 64, "é": 65, None: 4096},
                                   {str(k): 1 + k % 3 for k in range(70)}])
def test_trees_of_all_sizes(spark, sizes):
    rows = [(i, g) for g, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, lang string")
    got = collected(merkle.manifest(df, ["doc_id", "lang"]))
    assert got == plain_manifest([r.asDict() for r in df.collect()], ["doc_id", "lang"], "lang")


def test_manifest_of_odd_documents(spark, odd_documents, no_documents):
    fields = ["doc_id", "text", "source"]
    found = merkle.manifest(odd_documents, fields, group="source", keep=["doc_id", "row"])
    assert collected(found) == plain_manifest([r.asDict() for r in odd_documents.collect()], fields, "source")
    back = found.select((merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok")).collect()
    assert len(back) == 9 and all(r.ok for r in back)
    assert merkle.manifest(no_documents, fields, group="source").count() == 0


def test_copies_of_one_row_are_leaves_of_their_own(spark):
    df = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a").alias("lang"))
    assert collected(merkle.manifest(df, ["doc_id"])) == plain_manifest(
        [r.asDict() for r in df.collect()], ["doc_id"], "lang")


def test_queue_stays_small():
    n = 5000
    leaves = ((k, f"{k:064d}") for k in range(n))
    labels = [label for label, _ in merkle.forward(leaves, n, merkle.depth(n))]
    assert labels == sorted(labels) and labels[-1] == (n - 1, merkle.depth(n))


# ---------------------------------------------------------------------- repair
def plain_repair(turns):
    """All edits of (role, text, fault), by enumeration: (cost, audit, repaired)."""
    found = []
    gaps = ["", "u", "a", "ua", "au", "uu", "aa"]
    for edits in itertools.product("KuaD", repeat=len(turns)):
        cost, audit, out, good = 0, [], [], True
        for (role, text, fault), edit in zip(turns, edits):
            good &= edit == "D" or fault not in (turn_repair.BLANK, turn_repair.DUPLICATE)
            cost += {"K": 0, "D": 3}.get(edit, 2) + (edit != "D" and fault == turn_repair.CUT)
            audit.append(edit if edit in "KD" else "R")
            out.append([] if edit == "D" else [(role if edit == "K" else turn_repair.ROLES[edit], text)])
        if not good:
            continue
        for inserts in itertools.product(gaps, repeat=len(turns) + 1):
            rows = []
            for k, own in enumerate([*out, []]):
                rows += [(turn_repair.ROLES[r], "") for r in inserts[k]] + own
            if all(r[0] for r in rows) and re.fullmatch("(s?(ua)+)?", "".join(r[0][0] for r in rows)):
                letters = "".join("I" * len(i) + a for i, a in itertools.zip_longest(inserts, audit, fillvalue=""))
                found.append((cost + 2 * sum(map(len, inserts)), letters, "\n".join(f"{r}:{t}" for r, t in rows)))
    return min(found)


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = (turn_repair.BLANK if not bare else turn_repair.DUPLICATE if (role, text) in seen
                 else turn_repair.CUT if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def test_repair_equals_enumeration(spark):
    rng = random.Random(5)
    talks = {k: [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["Yes.", "no", " ", "Why?", "Yes."]))
                 for _ in range(rng.randint(1, 3))] for k in range(60)}
    df = spark.createDataFrame([(k, t, *row) for k, rows in talks.items() for t, row in enumerate(rows)], turn_repair.TURN)
    turns = turn_repair.ordered(df)
    audits = turn_repair.audit(turns)
    texts = {r.conv_id: r.repaired_sha256 for r in turn_repair.digests(turns, audits).collect()}
    for r in audits.collect():
        want = plain_repair(plain_faults(talks[r.conv_id]))
        assert (r.cost, r.audit) == want[:2], talks[r.conv_id]
        assert texts.get(r.conv_id, sha("")) == sha(want[2])


def test_blocks_give_what_one_walk_gives():
    rng = random.Random(2)
    for _ in range(200):
        turns = [(rng.choice(["s", "u", "a", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 40))]
        cut = sorted(rng.sample(range(len(turns) + 1), min(3, len(turns))))
        parts = [turns[a:b] for a, b in zip([0, *cut], [*cut, len(turns)]) if a < b]
        join = lambda edits: [(b, a, c, " ".join(p)) for b, a, c, p in edits]
        whole = turn_repair.joined_edits([join(turn_repair.block_edits(turns, (0,)))])
        dealt = turn_repair.joined_edits([join(turn_repair.block_edits(p, range(4))) for p in parts])
        flat = lambda found: (found[0], " ".join(x for x in found[1] if x))
        assert flat(whole) == flat(dealt)


def test_ties_of_paths_are_decided_by_their_initials():
    rng = random.Random(3)
    for _ in range(300):
        trail, nodes = turn_repair.Trail(), []
        common = [rng.choice(["K", "D", "uK"]) for _ in range(rng.randint(0, 20))]
        for _ in range(2):
            node = 0
            for piece in [*common, *[rng.choice(["K", "D", "uK", "U"]) for _ in range(3)]]:
                node = trail.grow(node, piece)
            nodes.append(node)
        words = ["".join(trail.pieces(n)).translate(turn_repair.INITIALS) for n in nodes]
        assert trail.less(*nodes) == (words[0] < words[1])


def test_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(turn_repair, "hash_of", lambda text: 1)
    trail = turn_repair.Trail()
    a, b = trail.grow(trail.grow(0, "K"), "D"), trail.grow(trail.grow(0, "D"), "K")
    assert trail.less(b, a) and not trail.less(a, b) and not trail.less(a, a)


def test_long_conversation_is_cut_into_blocks(spark):
    n = 5000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                               F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                               F.concat(F.lit("turn "), "id", F.lit(".")).alias("text"))
    turns = turn_repair.ordered(df.where("turn <> 2001"))
    blocks = turn_repair.block_rows(turn_repair.faults(turns))
    assert blocks.count() >= n // turn_repair.BLOCK
    row = turn_repair.audit(turns).first()
    assert (row.cost, row.gaps, row.illegal) == (2, 1, 1) and row.audit == "K" * 2001 + "I" + "K" * 2998
    assert turn_repair.repaired(turns, turn_repair.audit(turns)).count() == n


def test_repair_of_odd_turns(spark):
    rows = [(None, 1, "user", "Hi."), (None, None, None, None), (3, 5, "user", "Hi."), (3, 5, "user", "Hi."),
            (3, None, "system", "x" * 100_000 + ". \n"), (4, None, "a", ""), (5, 2, "assistant", "ok? ")]
    df = spark.createDataFrame(rows, turn_repair.TURN).withColumns({"audit": F.lit(1), "block": F.lit("b"), "at": F.lit(0.5)})
    turns = turn_repair.ordered(df)
    got = {r.conv_id: r for r in turn_repair.audit(turns).collect()}
    assert got[None].audit == "DKI" and (got[None].blank, got[None].gaps) == (1, 0)
    assert got[3].audit == "KKDI" and (got[3].duplicate, got[3].cost) == (1, 5)
    assert got[4].audit == "D" and got[5].audit == "IK"
    assert turn_repair.audit(turn_repair.ordered(df.limit(0))).count() == 0


# --------------------------------------------------------------------- packing
def one_by_one(histogram, capacity, rule):
    """Residuals of the sequences when one piece after another goes where it fits best."""
    bins = np.zeros((0, 3), np.int64)
    for length in sorted(histogram, reverse=True):
        demand = packing.demand_of(length)
        for _ in range(histogram[length]):
            able = np.flatnonzero((bins >= demand).all(1))
            if len(able):
                at = able[np.argmin(packing.fit(bins[able], demand, capacity, rule))]
            else:
                bins, at = np.concatenate([bins, [capacity.limits]]), len(bins)
            bins[at] -= demand
    return bins


@pytest.mark.parametrize("rule", packing.RULES)
def test_groups_give_what_single_pieces_give(rule):
    rng = random.Random(7)
    for _ in range(40):
        capacity = packing.Capacity(rng.randint(20, 60), rng.choice([3, 5, 60]), rng.choice([500, 900, 3600]))
        histogram = {n: rng.randint(1, 30) for n in rng.sample(range(1, capacity.longest + 1), 8)}
        groups = packing.best_fit(histogram, capacity, rule)
        want = one_by_one(histogram, capacity, rule)
        held = [[(n, each) for n, _, each in g.held for _ in range(1)] for g in groups for _ in range(g.size)]
        for h in held:
            assert sum(n * e for n, e in h) <= capacity.tokens and sum(e for _, e in h) <= capacity.documents
            assert sum(n * n * e for n, e in h) <= capacity.attention
        assert sum(g.size for g in groups) == len(want)
        assert {n: sum(g.size * e for g in groups for m, _, e in g.held if m == n) for n in histogram} == histogram


def test_pieces_too_large_are_refused():
    with pytest.raises(ValueError, match="no sequence"):
        packing.best_fit({9: 1}, packing.Capacity(8, 8, 64))
    assert packing.best_fit({}) == []


ODD = ["", "  ", "a\x1cb \x1d!c", "Σας ΣΑΣ İstanbul ﬁ ŉ", "é é́ ́x", "hi<|endoftext|>you <|startoftext|>", "x" * 3000,
       "tab\t\x0b\x0c\r\n\x85\xa0 　end", "<|endoftext|><|endoftext|> <|endoftext|", "naïve ☃ \U0001f600 't 'LL don't",
       "가 ᄀ ᅡ", "a​b﻿c", "  x"]


def test_words_give_the_ids_of_the_library():
    tokenizer, tokens = Tokenizer.from_file(WORDS), packing.WordTokens(WORDS)
    for texts in (ODD, [" ".join(ODD)], ["".join(ODD)]):
        want = [np.array(e.ids, np.uint32).tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert list(tokens(texts)) == want


def test_words_of_letters_need_no_marks(monkeypatch):
    tokenizer, tokens = Tokenizer.from_file(WORDS), packing.WordTokens(WORDS)
    marked, ids = [], tokens.ids
    monkeypatch.setattr(tokens, "ids", lambda words: (marked.extend(words), ids(words))[1])
    texts = ["Some plain wörter und Σας 中文, more. (odd) end!!", "it's 12 don't. plain. x's", "w" * 100 + "..."]
    want = lambda t: np.array(tokenizer.encode(t, add_special_tokens=False).ids, np.uint32).tobytes()
    assert list(tokens(texts)) == [want(t) for t in texts]
    assert not {"Some", "plain", "more", "more.", "plain.", "end!!", "中文", "wörter"} & set(marked) and "(odd)" in marked
    assert max(map(len, tokens.memo)) <= packing.MEMO_CHARS
    assert list(tokens(["plain İstanbul two"])) == [want("plain İstanbul two")] and "İstanbul" in marked  # not one piece


def test_different_words_are_looked_up_once_a_slice(monkeypatch):
    tokenizer, tokens = Tokenizer.from_file(WORDS), packing.WordTokens(WORDS)
    asked, known = [], tokens.known
    monkeypatch.setattr(tokens, "known", lambda words: (asked.append(words), known(words))[1])
    texts = ["plain plain\u2003plain, \xa0 (odd)\x1codd ", None, "", "plain\x85\u3000 odd." * 50, "\u2028", "wörter\u2003odd, a"]
    want = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, np.uint32).tobytes() for t in texts]
    for given in (texts, pa.array(texts, pa.large_string()), pa.array(["x", *texts]).slice(1)):
        assert list(tokens(given)) == want
    assert len(asked) == 3 and all(len(words) == len(set(words)) for words in asked)
    assert list(tokens([])) == [] and list(tokens([None])) == [b""]


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_WORDS", 50)
    tokenizer, tokens = Tokenizer.from_file(WORDS), packing.WordTokens(WORDS)
    for k in range(20):
        text = " ".join(f"w{i}" for i in range(k, k + 40))
        assert list(tokens([text])) == [np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()]
        assert len(tokens.memo) <= 90


def check_packing(rows, texts, capacity=packing.Capacity()):
    tokenizer, by, sequences = Tokenizer.from_file(WORDS), {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        n = capacity.longest
        assert sorted(by[doc_id]) == [(k, s, len(ids[s:s + n]), zlib.crc32(ids[s:s + n].tobytes()))
                                      for k, s in enumerate(range(0, len(ids), n))]
    for spans in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(spans)))
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= capacity.tokens
        assert len(spans) <= capacity.documents and sum(n * n for _, n in spans) <= capacity.attention
    return len(sequences), sum(r.length for r in rows)


def test_query_packs_all_documents(spark):
    docs = {r.doc_id: r.text for r in read(spark, SF, "documents").collect()}
    used, tokens = check_packing(QUERIES["op13_vector_packing"](spark, SF).collect(), docs)
    assert used <= -(-tokens // packing.TOKENS) + 1


@pytest.mark.parametrize("capacity", [packing.Capacity(), packing.Capacity(100, 3, 4000)])
def test_packing_of_odd_documents(spark, odd_documents, no_documents, capacity):
    marked = odd_documents.withColumns({"length": F.lit("n"), "part": F.lit(0)}).withColumn(
        "doc_id", F.monotonically_increasing_id())
    found = packing.pieces(marked, WORDS, capacity.longest, with_ids=True)
    placed = packing.pack(found, capacity)
    rows = placed.select("row.doc_id", "row.text", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()
    check_packing(rows, {r.doc_id: r.text for r in rows}, capacity)
    whole = packing.sequences(placed).collect()
    assert all(len(r.ids) == sum(r.lengths) for r in whole) and sum(len(r.ids) for r in whole) == sum(r.length for r in rows)
    assert packing.pack(packing.pieces(no_documents, WORDS)).count() == 0
