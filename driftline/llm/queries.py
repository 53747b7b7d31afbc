"""The registered queries of the operators, next to their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import (byte_bpe, chat, host_rules, merkle, mixing, multi_index, packing, quality, token_counts,
                           toxicity, turn_repair, warc_archive, weighted_minhash)
from driftline.llm.tables import fresh_folder, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


HOST_RULES_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (
  SELECT r, unnest(generate_series(1, len(words) - 7)) AS i,
    unnest([list_slice(words, j, j + 7) for j in generate_series(1, len(words) - 7)]) AS win
  FROM d WHERE len(words) >= 8),
starts AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
rep AS (SELECT r, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS n FROM starts)
  GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT d.doc_id, d.source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(lines.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    coalesce(lines.n, 0) AS n_lines
  FROM d LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars
    OR 100 * n_dup_lines > 30 * n_lines AS rule_failed FROM b),
h AS (SELECT source, count(*) AS host_docs, CAST(sum(CAST(rule_failed AS INT)) AS BIGINT) AS host_failures
  FROM f GROUP BY source),
t AS (SELECT sum(host_docs) AS docs, count(*) AS hosts, sum(host_failures) / sum(host_docs) AS m FROM h),
v AS (SELECT any_value(m) AS m, any_value(docs) AS docs, any_value(hosts) AS hosts,
    sum(host_failures * host_failures / host_docs) / any_value(docs) - any_value(m) ^ 2 AS v FROM h, t),
p AS (SELECT m, CASE WHEN v - m * (1 - m) * hosts / docs > 0 THEN
    greatest(1.0, least(1e6, m * (1 - m) / (v - m * (1 - m) * hosts / docs) - 1)) ELSE 1e6 END AS k FROM v),
r AS (SELECT source, host_docs, host_failures,
    round((host_failures + m * k) / (host_docs + k), 9) AS host_rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND host_rate <= 0.5 AS kept, host_docs, host_failures, round(host_rate, 6) AS host_rate
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""


@query("op2_host_rules", HOST_RULES_SQL)
def _(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text", "source")
    measured = host_rules.host_rules(docs, keep=["doc_id"])
    return measured.select(
        "row.doc_id", *host_rules.MEASURES, "base_failed", "kept",
        "host_docs", "host_failures", F.round("host_rate", 6).alias("host_rate"))


@query("op5_token_counts")
def _(spark, sf):
    path, pattern = byte_bpe.public_vocabulary("byte_bpe_50k.json")
    docs = read(spark, sf, "documents").select("doc_id", "text")
    counted = token_counts.prefix_counts(docs, path, pattern)
    return counted.withColumn("answer", token_counts.budget(F.col("prefixes"), 512)).select(
        "row.doc_id", F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long").alias("n_bytes"),
        "answer.n_tokens", (F.col("answer.n_tokens") > 512).alias("over_limit"), "answer.fitting_chars")


@query("op7_byte_bpe")
def _(spark, sf):
    path, pattern = byte_bpe.public_vocabulary("byte_bpe_multi_50k.tiktoken")
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return byte_bpe.digests(byte_bpe.round_trip(docs, path, pattern, keep=["doc_id"], digest=True), "doc_id")


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (SELECT *, 13 + length(role) + 11 + length(CASE
    WHEN contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|')
    THEN regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') ELSE text END) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op6_chat_format", CHAT_SQL)
def _(spark, sf):
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.read_back(chat.format_conversations(turns.unionByName(probe))))


MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS hash FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2 * CAST(sum(size) AS BIGINT) AS cap,
    [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
w AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS rate FROM s
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CAST(least(cap, coalesce(weight * (
    SELECT rate FROM w WHERE weight * rate <= cap ORDER BY cap / weight, rate LIMIT 1), cap)) AS DOUBLE) AS target
  FROM w),
c AS (SELECT *, CASE WHEN source_size > 0 THEN least(2, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END
  AS copies FROM g),
h AS (SELECT source, hash, sum(size) AS n FROM d GROUP BY ALL),
r AS (SELECT source, hash, n, sum(n) OVER (PARTITION BY source ORDER BY hash) AS up_to FROM h),
b AS (SELECT r.source, hash + CAST(target - copies * source_size - (up_to - n) > n / 2 AS BIGINT) AS below
  FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source
  WHERE target - copies * source_size > 0 AND up_to - n <= target - copies * source_size
    AND up_to > target - copies * source_size)
SELECT doc_id, size, source_size, target,
  size * CAST(copies + CAST(hash < coalesce(below, 0) AS BIGINT) AS BIGINT) AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""


@query("op8_mixing", MIXING_SQL)
def _(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("row.doc_id", "size", "source_size", "target", "taken")


WARC_SQL = r"""
WITH p AS (SELECT page_id, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS url,
  coalesce(html, '') AS html, encode(coalesce(html, '')) AS payload FROM pages),
o AS (SELECT *, row_number() OVER (PARTITION BY payload, page_id, url) AS nth FROM p),
f AS (SELECT *, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex,
  row_number() OVER w = 1 AS first, first_value(page_id) OVER w AS first_id, first_value(nth) OVER w AS first_nth FROM o
  WINDOW w AS (PARTITION BY payload ORDER BY page_id NULLS LAST, url, nth)),
k AS (SELECT *, CASE WHEN first THEN 'response' ELSE 'revisit' END AS record_type,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, i // 4 * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)
    for i in range(32)], '') AS payload_digest,
  'HTTP/1.1 200 OK' || n || 'Content-Type: text/html; charset=utf-8' || n || 'Content-Length: ' || payload_bytes || n || n AS http
  FROM f, (SELECT chr(13) || chr(10) AS n)),
r AS (SELECT *, 'WARC/1.1' || n || 'WARC-Type: ' || record_type || n
  || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || ':' || nth || '>' || n
  || 'WARC-Date: 2024-01-01T00:00:00Z' || n || 'WARC-Target-URI: ' || url || n
  || 'WARC-Payload-Digest: sha1:' || payload_digest || n || CASE WHEN first THEN '' ELSE
    'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || n
    || 'WARC-Refers-To: <urn:page:' || coalesce(CAST(first_id AS VARCHAR), '') || ':' || first_nth || '>' || n END
  || 'Content-Type: application/http; msgtype=response' || n
  || 'Content-Length: ' || (strlen(http) + CASE WHEN first THEN payload_bytes ELSE 0 END) || n || n || http
  || CASE WHEN first THEN html ELSE '' END || n || n AS record FROM k)
SELECT page_id, payload_bytes, payload_digest, record_type, CASE WHEN NOT first THEN first_id END AS refers_to,
  sha256(record) AS record_sha256 FROM r
"""


@query("op9_warc_archive", WARC_SQL)
def _(spark, sf):
    folder = fresh_folder(spark, "archive")
    warc_archive.write_archive(read(spark, sf, "pages").select("page_id", "url", "html"), folder)
    return warc_archive.read_archive(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
        F.sha2("record", 256).alias("record_sha256"))


@query("op10_quality")
def _(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    weights, cut = quality.fit(docs, read(spark, sf, "labels"))
    return quality.score(docs, weights, cut).select("row.doc_id", "held_out", "score", "predicted")


@query("op1_toxicity")
def _(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    weights, thresholds = toxicity.fit(docs, read(spark, sf, "labels"))
    return toxicity.score(docs, weights, thresholds).select(
        "row.doc_id", "severity", "grade", "p_toxic", "toxic")


@query("op3_multi_index")
def _(spark, sf):
    vectors = read(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    return multi_index.near_duplicates(vectors).select("row.vec_id", "n_links", "component_id", "kept")


@query("op4_weighted_minhash")
def _(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return weighted_minhash.near_duplicates(docs, keep=["doc_id"]).select("row.doc_id", "class_id", "kept")


# -- op11: the tree unrolled, level by level; a tree of one node stays as it is
def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = f"[CAST((ascii({text}[1 + i // 8]) >> (i % 8)) & 1 AS BIGINT) for i in range(8 * length({text}))]"
    return (f"xor(list_reduce([4294967295::BIGINT] || {bits}, lambda c, b: "
            "xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)")


def leaf_sql(text: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def tree_sql(name: str, levels: int) -> str:
    """CTEs name1, name2, ...: (g, p, n, hs), the runs of each level of nodes; name0 is (g, i, h)."""
    out = []
    for k in range(levels):
        nodes = f"{name}0" if k == 0 else (
            f"(SELECT g, p AS i, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}{k})")
        out.append(f"{name}{k + 1} AS (SELECT g, i // 8 AS p, n, list(h ORDER BY i) AS hs FROM "
                   f"(SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {nodes}) GROUP BY g, i // 8, n)")
    return ",\n".join(out)


def climb_sql(name: str, levels: int, start: str) -> str:
    """CTEs that carry leaves (digest acc, place i in tree g) up, with the siblings met on the way."""
    out = []
    for k in range(levels):
        at, last = f"(c.i // {8 ** k}) % 8", start if k == 0 else f"{name}c{k}"
        left, right = f"array_to_string(t.hs[1:{at}], '')", f"array_to_string(t.hs[{at} + 2:], '')"
        out.append(f"{name}c{k + 1} AS (SELECT c.* REPLACE (CASE WHEN t.n > 1 THEN sha256({left} || c.acc || {right}) "
                   f"ELSE c.acc END AS acc, CASE WHEN t.n > 1 THEN c.proof || {left} || {right} ELSE c.proof END AS proof) "
                   f"FROM {last} c JOIN {name}{k + 1} t ON c.g IS NOT DISTINCT FROM t.g AND c.i // {8 ** (k + 1)} = t.p)")
    return ",\n".join(out)


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: 8 ** 7 documents a language, 8 ** 3 languages.
MERKLE_SQL = f"""
WITH d AS (SELECT doc_id, lang AS g, {leaf_sql("text")} AS leaf,
    CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {leaf_sql(LOWER)} ELSE {leaf_sql("text")} END AS acc
  FROM documents),
l0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, acc) - 1 AS i, leaf AS h,
    '' AS proof FROM d),
{tree_sql("l", 7)},
sub AS (SELECT g, hs[1] AS subroot FROM l7 WHERE n = 1),
s0 AS (SELECT 0 AS g, g AS lang, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, subroot AS h, subroot FROM sub),
{tree_sql("s", 3)},
{climb_sql("l", 7, "l0")},
up AS (SELECT doc_id, leaf, subroot, 0 AS g, s0.i, acc, proof FROM lc7 JOIN s0 ON lc7.g IS NOT DISTINCT FROM s0.lang),
{climb_sql("s", 3, "up")}
SELECT doc_id, leaf, subroot, hs[1] AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = hs[1] AS verified
FROM sc3, s3
"""


@query("op11_merkle_manifest", MERKLE_SQL)
def _(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields, upper = ["doc_id", "source", "lang", "n_chars", "text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = [F.translate("text", upper, upper.lower()) if c == "text" else F.col(c) for c in fields]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle.manifest(docs.withColumn("tampered", F.when(hit, merkle.leaf_digest(lowered))), fields,
                            keep=["doc_id", "tampered"])
    back = merkle.folded(F.coalesce("row.tampered", "leaf"), F.col("proof"))
    return found.select("row.doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
                        back.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


# -- op12: the DP as a recursion over the turns, with the repaired lines beside the audit
REPAIR_SQL = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT *, {crc32_sql("key")} % 20 AS h FROM c),
x AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(generate_series(1, CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said, left(role, 1) AS r FROM x),
f AS (SELECT *, CASE WHEN said = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END
    AS fault, lead(r) OVER (PARTITION BY conv_id ORDER BY i) AS next FROM n),
t(s, ins, s1) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3),
    (3, 0, 3), (3, 1, 2), (3, 2, 3)),
o AS (SELECT conv_id, i, r, role, text, fault, s, s1, 2 * ins + CASE WHEN fault = 3 THEN 1 ELSE 0 END AS cost,
    repeat('I', ins) AS piece, CASE WHEN ins = 0 THEN [] WHEN ins = 2 THEN ['user:', 'assistant:']
      WHEN s1 = 3 THEN ['assistant:'] ELSE ['user:'] END AS lines FROM f, t WHERE fault NOT IN (1, 2)),
e AS (
  SELECT conv_id, i, s, CASE r WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END AS s2, cost, piece || 'K' AS piece,
    lines || [role || ':' || text] AS lines FROM o
  WHERE r = 's' AND s1 = 0 OR r = 'u' AND s1 <> 2 OR r = 'a' AND s1 = 2
  UNION ALL SELECT conv_id, i, s, CASE WHEN s1 = 2 THEN 3 ELSE 2 END, cost + 2, piece || 'R',
    lines || [CASE WHEN s1 = 2 THEN 'assistant:' ELSE 'user:' END || text] FROM o
  UNION ALL SELECT conv_id, i, s, s, 3, 'D', [] FROM f, (VALUES (0), (1), (2), (3)) AS v(s)),
ids AS (SELECT DISTINCT conv_id FROM conversations),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines
  FROM ids
  UNION ALL SELECT conv_id, i + 1, s2, m.cost, m.audit, m.lines FROM (
    SELECT dp.conv_id, dp.i, e.s2, min({{'cost': dp.cost + e.cost, 'audit': dp.audit || e.piece, 'lines': dp.lines || e.lines}})
      AS m FROM dp JOIN e ON dp.conv_id IS NOT DISTINCT FROM e.conv_id AND e.i = dp.i + 1 AND e.s = dp.s GROUP BY ALL)),
k AS (SELECT conv_id, count(*) AS rows,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (next IS NOT NULL AND r || next NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
b AS (SELECT dp.conv_id, min({{'cost': cost + [0, 4, 2, 0][s + 1], 'audit': audit || ['', 'II', 'I', ''][s + 1],
    'lines': lines || [[], ['user:', 'assistant:'], ['assistant:'], []][s + 1]}}) AS m
  FROM dp LEFT JOIN k ON dp.conv_id IS NOT DISTINCT FROM k.conv_id WHERE i = coalesce(rows, 0) GROUP BY dp.conv_id)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(m.cost AS BIGINT) AS cost, m.audit AS audit,
  sha256(array_to_string(m.lines, chr(10))) AS repaired_sha256
FROM b LEFT JOIN k ON b.conv_id IS NOT DISTINCT FROM k.conv_id
"""


def damaged(turns):
    """Every twentieth turn dropped, emptied, without sentence ends, doubled, or said by the user."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    harm = F.crc32(F.concat(filled[0], F.lit(":"), filled[1]).cast("binary")) % 20
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(
        F.col("text"))
    times = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return turns.select("conv_id", "turn", filled[2].alias("role"), filled[3].alias("text"), harm.alias("harm")).filter(
        "harm <> 0").select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
                            text.alias("text"), times.alias("copy")).drop("copy")


@query("op12_conversation_repair", REPAIR_SQL)
def _(spark, sf):
    given = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    turns = turn_repair.ordered(damaged(given))
    audits = turn_repair.audit(turns)
    found = audits.join(turn_repair.digests(turns, audits).withColumnRenamed("conv_id", "c"),
                        F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c").withColumnRenamed("conv_id", "c")
    ids = given.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query("op13_vector_packing")
def _(spark, sf):
    import public_tokenizers
    docs = read(spark, sf, "documents").select("doc_id", "text")
    found = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return packing.pack(found).select("row.doc_id", F.col("piece").cast("int").alias("piece"), "start", "length",
                                      "ids_crc32", "sequence_id", "offset")
