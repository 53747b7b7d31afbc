"""Each stage of the pipeline against a plain version of it, over whole documents."""

import hashlib

import pytest
import tiktoken
from pyspark.sql import functions as F
from test_near_duplicates import brute_classes
from test_rules_and_mixing import brute_repeat_words

import corpus_pipeline as pipeline
from driftline.llm import bpe, byte_bpe, quality
from driftline.llm.tables import read, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each."""
    docs, out = read(spark, SF, "documents"), []
    columns = docs.columns
    out.append(docs.collect())
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        assert name == "encoding" or docs.columns == columns
        out.append(docs.collect())
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_stage_names():
    assert [n for n, _ in pipeline.STAGES] == [
        "quality_rules", "quality_classifier", "near_dedup", "source_mixing", "encoding"]


def test_rules(stages):
    def fails(text):
        words = (text or "").split()
        return len(words) < 20 or 100 * brute_repeat_words(words) > 30 * len(words)

    # no host of these documents fails as a whole, so the base rules decide
    assert ids(stages[1]) == sorted(r.doc_id for r in stages[0] if not fails(r.text))


def test_classifier(spark, stages):
    weights, cut = quality.fit(read(spark, SF, "documents"), read(spark, SF, "labels"))
    strength = {r.doc_id: sum(w * x for w, x in zip(weights, quality.text_features(r.text or ""))) for r in stages[1]}
    assert ids(stages[2]) == sorted(i for i, s in strength.items() if s >= cut - 1e-9)


def test_near_duplicates(stages):
    classes, _ = brute_classes({r.doc_id: r.text for r in stages[2]})
    assert ids(stages[3]) == sorted(set(classes.values()))


def test_mixing(stages):
    size = {r.doc_id: len((r.text or "").split()) for r in stages[3]}
    sources, weight, total = {}, {}, sum(size.values())
    for r in stages[3]:
        sources[r.source] = sources.get(r.source, 0) + size[r.doc_id]
    for k, s in enumerate(sorted(sources, key=lambda s: (s is None, s or ""))):
        weight[s] = (3, 1, 2)[k % 3]
    target, full = dict.fromkeys(sources, 0.0), set()
    while True:
        left = 1.5 * total - sum(2 * sources[s] for s in full)
        open_ = [s for s in sources if s not in full]
        target.update({s: left * weight[s] / sum(weight[x] for x in open_) for s in open_})
        over = {s for s in open_ if target[s] > 2 * sources[s]}
        if not over:
            break
        full |= over
        target.update({s: 2.0 * sources[s] for s in over})
    taken = dict.fromkeys(sources, 0)
    for r in stages[4]:
        taken[r.source] += size[r.doc_id]
    largest = {s: max(size[r.doc_id] for r in stages[3] if r.source == s) for s in sources}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sources)
    copies = {i: sum(r.doc_id == i for r in stages[4]) for i in size}
    assert max(copies.values()) <= 2 and set(ids(stages[4])) <= set(size)


def test_encoding(spark, stages):
    path, pattern = byte_bpe.public_vocabulary(pipeline.RANKS)
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.from_ranks(path).ids, special_tokens={})
    text = {r.doc_id: r.text or "" for r in stages[4]}
    assert ids(stages[5]) == ids(stages[4])
    for r in stages[5]:
        assert r.ids == encoding.encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_odd_documents_pass_all_stages(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        columns = docs.columns
        for name, stage in pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs.withColumn("lang", F.lit(None).cast("string")).select(columns), SF), name)
            assert docs.columns == columns, name
        assert pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
