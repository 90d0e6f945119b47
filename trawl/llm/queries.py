"""The registered queries of the training-data operators, over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard_components

    return ngram_jaccard_components(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination, hit_words, is_contaminated

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort("item_ids"), ",")
    return found.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import events_of, format_conversations, loss_text, parse

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), F.lit(odd).alias("text"))
    chats = format_conversations(events_of(rows.unionByName(more)))
    read = chats.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda m: F.concat(m.role, F.lit("\n"), m.text, F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import scratch
    from .warc import read_archives, write_archives

    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages")).write.parquet(path)
    return read_archives(spark.read.parquet(path), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import compare_with_edit_and_next

    return compare_with_edit_and_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_documents

    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: its lines, those that go, and for each of them the line (document and number) that stays."""
    from .line_dedup import repeated_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = repeated_lines(docs, shorter=True).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", "first_doc_id", "first_number"))).alias("gone"))
    counts = docs.select("doc_id", F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    return counts.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), "gone")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: the licenses that its text states, with their wording differences."""
    from .licenses import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.transform("licenses", lambda x: x.license)
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(names, ",").alias("license_names"), "licenses")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: its candidates and those of them that the forest takes for secrets."""
    from .secrets import frequent_words, scan_secrets, synthetic_findings, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    words = frequent_words(docs)
    found = scan_secrets(docs, train(synthetic_findings(dictionary=words), words))
    secrets = F.filter("candidates", lambda c: c.score >= 0.5)
    return found.select("doc_id", F.size("candidates").cast("long").alias("n_candidates"), F.size(secrets).cast("long").alias("n_secrets"), secrets.alias("secrets"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: A-Z only, as the contracts ask for.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) g FROM w),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= 75 * (u.n + v.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id x, doc_id y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(y) FROM r WHERE r.x = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(ws)) k, unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(13, len(ws)) - 1], ' '))) g FROM b WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) i, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) g FROM d, ks WHERE len(ws) >= k),
m AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest(range(i, i + k)) p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) n, string_agg(x, ',' ORDER BY x) ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) x FROM m) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

#: formatted_chars: 14 characters of marks a turn ("### ", ": ", "</turn>" and a line feed), and one more for each escaped character.
OP3_SQL = r"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) t,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') l,
  sum(14 + length(role) + length(text) + length(role || text) - length(translate(role || text, '\#<:', ''))) f FROM m GROUP BY 1)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(t) AS turns_sha256, length(l)::BIGINT AS loss_chars, sha256(l) AS loss_sha256, f::BIGINT AS formatted_chars FROM g
"""

#: Base32 of the 20 bytes of a SHA-1: 32 digits of 5 bits each, taken from the hex digest's bits.
OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') h, sha1(coalesce(html, '')) x FROM pages),
f AS (SELECT x, min(page_id) f FROM p GROUP BY 1)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(x || '0', 1 + (5 * i // 4)::INT, 2))::INT >> (3 - 5 * i % 4)::INT & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id > f THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > f THEN f END AS refers_to
FROM p JOIN f USING (x)
"""

#: The method in one window: a source's documents in order of size, long ones first, lie on a line, each as long as its expected copies (q; the others r, which is q where none is long), from one offset u.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT z, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 w FROM d GROUP BY source),
-- the level at which every source below some source's cap by weight is capped, and that one isn't
lv AS (SELECT max(l) lvl FROM (SELECT a.w, a.z, ((SELECT sum(z) FROM s) - coalesce(sum(3 * b.z) FILTER (WHERE (3 * b.z) / b.w < (3 * a.z) / a.w), 0)) / sum(b.w) FILTER (WHERE (3 * b.z) / b.w >= (3 * a.z) / a.w) l
  FROM s a, s b GROUP BY a.source, a.w, a.z) WHERE l * w <= 3 * z),
t AS (SELECT source, z, least(3 * z, lvl * w)::DOUBLE target, CASE WHEN z > 0 THEN least(3 * z, lvl * w)::DOUBLE / z ELSE 0 END q, ('0x' || substr(md5('/' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE u FROM s, lv),
k AS (SELECT *, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % ceil(sqrt(count(*) OVER (PARTITION BY source, size)))::BIGINT c FROM d),
o AS (SELECT k.*, t.z, t.target, t.q, t.u, size * 50 > target lg, row_number() OVER (PARTITION BY k.source ORDER BY size * 50 > target DESC, size, c, doc_id) rk FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
f AS (SELECT source, count(*) FILTER (WHERE lg) n, coalesce(sum(size) FILTER (WHERE lg), 0)::BIGINT ls, coalesce(sum((floor(u + q * rk) - floor(u + q * (rk - 1)))::BIGINT * size) FILTER (WHERE lg), 0)::BIGINT lt, any_value(z) z, any_value(target) target, any_value(q) q FROM o GROUP BY source),
r AS (SELECT source, n, CASE WHEN n = 0 THEN q WHEN z > ls THEN greatest(0.0::DOUBLE, least(3.0::DOUBLE, (target - lt) / (z - ls))) ELSE 0.0::DOUBLE END r FROM f),
e AS (SELECT o.*, CASE WHEN lg THEN q * rk ELSE q * n + r * (rk - n) END b, CASE WHEN lg THEN q * (rk - 1) ELSE q * n + r * (rk - 1 - n) END a FROM o JOIN r ON o.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, z AS source_size, target, least(3, floor(u + b)::BIGINT - floor(u + a)::BIGINT) * size AS taken FROM e
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1_SQL, "op2_benchmark_decontamination": OP2_SQL, "op3_chat_formatting": OP3_SQL, "op4_warc": OP4_SQL, "op10_mixing": OP10_SQL}
