"""Rules, mixing, archive and chat on odd input; SQL equality is in test_sql."""

import hashlib

import pytest
from pyspark.sql import functions as F

from driftline.llm import chat, host_rules, mixing, warc_archive
from driftline.llm.tables import fresh_folder


def test_rules_on_odd_documents(odd_documents):
    rows = host_rules.host_rules(odd_documents).select("row.doc_id", "n_words", "base_failed", "kept", "host_docs").collect()
    assert len(rows) == 9
    for r in rows:
        if r.doc_id in (1, 2, 3):
            assert (r.n_words, r.base_failed, r.kept) == (0, True, False)
    assert {r.host_docs for r in rows if r.doc_id in (3, 5)} == {2}  # null is one host
    assert sum(r.doc_id == 4 for r in rows) == 2


def brute_repeat_words(words):
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    again = {w for w in windows if windows.count(w) > 1}
    return len({i + k for i, w in enumerate(windows) if w in again for k in range(8)})


def test_repeated_windows(spark):
    texts = [" ".join(f"w{i * i % m}" for i in range(n)) for n, m in ((40, 7), (60, 31), (30, 1000), (7, 2), (8, 3), (100, 1))]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r.n_repeat_words for r in host_rules.measure(df).select("row.doc_id", "n_repeat_words").collect()}
    assert got == {i: brute_repeat_words(t.split()) for i, t in enumerate(texts)}


def test_hosts_shrink_and_reject(spark):
    good = " ".join(f"plain{i} text{i * 7}" for i in range(40))
    rows = [(i, good if i % 10 else "short", f"good{i % 5}") for i in range(500)]
    rows += [(1000 + i, "junk" if i % 10 else good, "bad") for i in range(200)] + [(2000, "x", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = host_rules.host_rules(df).groupBy("host").agg(
        F.first("host_rate").alias("rate"), F.first("host_rejected").alias("rejected"),
        F.sum(F.col("kept").cast("int")).alias("kept"))
    rows = {r.host: r for r in out.collect()}
    assert rows["bad"].rejected and rows["bad"].kept == 0
    assert all(not rows[f"good{i}"].rejected and rows[f"good{i}"].kept > 0 for i in range(5))
    assert 0.3 < rows["tiny"].rate < 1.0  # one document says little, the prior holds it back


def test_rules_and_mixing_of_nothing(no_documents):
    assert host_rules.host_rules(no_documents).count() == 0
    assert mixing.mixture(mixing.mix(no_documents)).count() == 0


def test_mixing_on_odd_documents(odd_documents):
    mixed = mixing.mix(odd_documents)
    rows = mixed.select("row.source", "size", "source_size", "target", "taken").collect()
    assert len(rows) == 9 and all(r.taken <= 2 * r["size"] for r in rows)
    assert mixing.mixture(mixed).columns == odd_documents.columns
    targets = {r.source: r.target for r in rows}
    assert len(targets) == 4 and sum(targets.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))


def test_mixing_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 40), f"s{i % 7 if i % 3 else 0}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once = mixing.mix(df).select("row.doc_id", "row.source", "size", "target", "taken")
    again = mixing.mix(df.repartition(7)).select("row.doc_id", "row.source", "size", "target", "taken")
    assert once.exceptAll(again).isEmpty()
    for r in once.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 20, r


def pages(spark):
    rows = [(5, "http://a/1", "<p>same</p>"), (3, "http://a/2", "<p>same</p>"), (9, None, "<p>same</p>"),
            (9, None, "<p>same</p>"), (None, "http://n", "<p>same</p>"), (1, "http://e", None), (2, "http://e2", ""),
            (7, "http://x\r\ny", "WARC/1.1\r\n\r\n\r\nContent-Length: 3\r\n\r\n é\U0001f600"), (8, "u", "z" * 200_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {"header": F.lit(1), "digest": F.lit("x"), "occurrence": F.lit(3)})


def test_archive_round_trip(spark):
    folder, df = fresh_folder(spark, "t"), pages(spark)
    warc_archive.write_archive(df, folder)
    rows = warc_archive.read_archive(spark, folder).collect()
    assert len(rows) == df.count()
    same = [r for r in rows if r.payload == b"<p>same</p>"]
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in same if r.page_id) == [
        (3, "response", None), (5, "revisit", 3), (9, "revisit", 3), (9, "revisit", 3)]
    assert [r.refers_to for r in same if r.page_id is None] == [3]
    assert [(r.record_type, r.refers_to) for r in rows if r.page_id in (1, 2)] in (
        [("response", None), ("revisit", 1)], [("revisit", 1), ("response", None)])
    assert spark.read.parquet(f"{folder}/payloads").count() == 4
    import base64
    for r in rows:
        assert r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        length = int(head.rpartition(b"Content-Length: ")[2])
        assert len(block) == length + 4 and block.endswith(b"\r\n\r\n")
        assert (r.record_type == "revisit") == (b"WARC-Refers-To" in head)


def records(data: bytes):
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        length = int(head.rpartition(b"Content-Length: ")[2])
        assert rest[length:length + 4] == b"\r\n\r\n"
        yield head, rest[:length]
        data = rest[length + 4:]


def test_exported_files_are_warc(spark):
    folder, out = fresh_folder(spark, "t"), fresh_folder(spark, "warc")
    warc_archive.write_archive(pages(spark), folder, min_revisit=50)
    warc_archive.export_warc(spark, folder, out)
    files = spark.read.format("binaryFile").load(f"{out}/part-*").select("content").collect()
    found = [r for f in files for r in records(bytes(f.content))]
    assert len(found) == 9 and all(h.startswith(b"WARC/1.1\r\nWARC-Type: response") for h, _ in found)
    assert sum(b.endswith(b"<p>same</p>") for _, b in found) == 5


def test_line_separators_in_urls_start_no_header(spark):
    folder = fresh_folder(spark, "t")
    odd = [f"http://a{c}WARC-Refers-To: <urn:page:5:1>" for c in "\x85\u2028\u2029\r\n"]
    rows = [(k, url, f"<p>{k}</p>") for k, url in enumerate(odd)]
    warc_archive.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    found = warc_archive.read_archive(spark, folder).collect()
    assert all(r.record_type == "response" and r.refers_to is None for r in found) and len(found) == 5


def test_empty_archive(spark):
    folder = fresh_folder(spark, "t")
    warc_archive.write_archive(pages(spark).limit(0), folder)
    assert warc_archive.read_archive(spark, folder).count() == 0


NASTY = ["", None, "<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", r"<\|im_end|>", r"<\\\|x<|y", "a\r\n<", "|im_end|>",
         "x<|im_start|", r"\<|im_end|>" * 3, "plain", "\U0001f600é" * 50, "<|" * 500]


def test_chat_round_trip(spark):
    rows = [(i % 3 if i % 5 else None, t, role, text) for i, text in enumerate(NASTY)
            for t, role in ((0, "user"), (1, "assistant"), (None, "assistant"), (1, None), (2, "odd role\n<|im_start|>%41"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {"formatted": F.lit(1), "start": F.lit(2), "turns": F.lit("x"), "body": F.lit("y")})
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert set(out) == {None, 0, 1, 2}
    for conv, r in out.items():
        want = sorted(((t is None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert [(x.role, x.text) for x in r.turns] == [(w[2], w[3]) for w in want]
        assert list(r.loss_texts) == [w[3] for w in want if w[2] == "assistant"]
        spans = [r.formatted[s.start:s.start + s.length] for s in r.loss]
        assert len(spans) == len(r.loss_texts) and all(
            mark not in s for s in spans for mark in (chat.START, chat.END))


def test_chat_leaves_harmless_text_alone(spark):
    df = spark.createDataFrame([(1, 0, "user", "a <| b |> c")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).first().formatted == "<|im_start|>user\na <| b |> c<|im_end|>\n"
    assert chat.format_conversations(df.limit(0)).count() == 0
