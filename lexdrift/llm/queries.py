"""The subpackage's registered queries and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, exact, langid, licenses, media, mixing, near, packing, simhash, substrings, token_files, trie
from .common import documents, shared_dir, staged


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark)
    token_files.write_tokens(documents(spark, sf_dir), out)
    return token_files.read_tokens(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':11') AS key
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS words FROM rows GROUP BY source
), ranked AS (
  SELECT source, words, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight
  FROM sums
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY words / weight, source ASC NULLS LAST) AS place FROM ranked
), levels AS (
  SELECT *, (1.5::DOUBLE * (sum(words) OVER ())::DOUBLE - 2 * (sum(words) OVER (ORDER BY place) - words)::DOUBLE)
            / (sum(weight) OVER () - (sum(weight) OVER (ORDER BY place) - weight)) AS level
  FROM ordered
), first_free AS (
  SELECT level FROM levels WHERE level * weight <= 2 * words ORDER BY place LIMIT 1
), targets AS (
  SELECT source, words, coalesce(least((2 * words)::DOUBLE, (SELECT level FROM first_free) * weight), (2 * words)::DOUBLE) AS target
  FROM levels
), plans AS (
  SELECT *, CASE WHEN words > 0 THEN floor(target / words)::BIGINT ELSE 0 END AS whole FROM targets
)
SELECT doc_id, size, p.words AS source_size, target,
       (whole + CASE WHEN (sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)
                           - size + size / 2 <= target - whole * p.words) THEN 1 ELSE 0 END) * size AS taken
FROM rows r JOIN plans p ON r.source IS NOT DISTINCT FROM p.source
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.remove_repeats(documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.layout(documents(spark, sf_dir)), licence_path="licence_path").withColumnRenamed("key", "doc_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = staged(media.encode(documents(spark, sf_dir)))
    tail = F.expr("substring(payload, length(payload) - 15, 16)")
    described = media.describe(stored).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "tensor",
        "spans",
    )
    return media.summarise(staged(described))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``op7_media``: payloads as they are read back from the stored form."""
    return op7_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes")


MEDIA_PAYLOADS_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents
), filled AS (
  SELECT *, greatest(192, (n_bytes + 191) // 192 * 192)::BIGINT AS payload_bytes FROM sized
)
SELECT doc_id, n_bytes, payload_bytes, sha256(text || repeat(' ', payload_bytes - n_bytes)) AS payload_sha256, payload_bytes + 44 AS media_bytes FROM filled
"""


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], turns.schema)
    return chat.digests(chat.format_conversations(turns.unionByName(probe)))


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), clean AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM turns
), sized AS (
  SELECT *, length(regexp_replace(role || text, '([<\\[])', '\1\\', 'g')) AS escaped FROM clean
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       (sum(escaped + length('<|turn|><|text|><|end|>')) + length('<s></s>'))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark_copies(documents(spark, sf_dir))


OP9_SQL = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents
), groups AS (
  SELECT content, first(doc_id ORDER BY n DESC, doc_id ASC NULLS LAST) AS keep_id, count(*) AS group_size
  FROM rows GROUP BY content
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(content) AS text_sha256
FROM rows JOIN groups USING (content)
"""


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.mark_near_copies(documents(spark, sf_dir), similarity=85)


OP10_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), every AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM texts
), sets AS (SELECT DISTINCT doc_id, shingle FROM every),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, ways.b FROM reached r JOIN ways ON ways.a = r.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT t.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END)
         || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM texts t LEFT JOIN marks ON marks.doc_id = t.doc_id
), counts AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l) JOIN letters d ON d.l NOT IN (a.l, b.l, c.l)
       JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)
), steps AS (
  SELECT filter_order, step::INTEGER AS step, filter_order[step] AS l, filter_order[1:step - 1] AS earlier FROM orders, range(1, 6) r(step)
), met AS (
  SELECT part, filter_order, step, l, n, good, toxic, contains(fails, l) AS here, fails = l AS only_here,
         earlier <> '' AND regexp_matches(fails, '[' || (CASE WHEN earlier = '' THEN '-' ELSE earlier END) || ']') AS gone
  FROM counts, steps
), figures AS (
  SELECT part, filter_order, step, l,
         sum(CASE WHEN NOT gone AND NOT here THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN NOT gone AND here THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN gone AND here THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN only_here THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN NOT gone AND here THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN NOT gone AND here THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM met GROUP BY part, filter_order, step, l
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley
FROM figures
"""


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.mark_similar(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    nodes = trie.prefix_trie(trie.shared_starts(turns))
    long = lambda c: F.col(c).cast("long").alias(c)
    return nodes.select(
        "conv_id", long("depth"), "parent_conv_id", "n_convs", long("n_children"), long("n_leaves"), F.col("saved").alias("saved_tokens"), F.lower(F.hex("ends")).alias("ends_sha256")
    )


#: crc32 isn't a function there: a byte is followed by eight steps of one bit.
OP13_SQL = r"""
WITH RECURSIVE ids AS (
  SELECT DISTINCT conv_id, list_transform(list_filter(string_split(conv_id::VARCHAR, ''), lambda x: x <> ''), lambda x: unicode(x)::BIGINT) AS bytes FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT conv_id, conv_id - conv_id % 5 AS start,
         xor(list_reduce(flatten(list_transform(bytes, lambda b: [b, 256, 256, 256, 256, 256, 256, 256, 256])),
                         lambda c, b: CASE WHEN b < 256 THEN xor(c, b) ELSE xor(c // 2, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) END, 4294967295::BIGINT), 4294967295::BIGINT) % 9 AS h
  FROM ids
), told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, strlen(coalesce(text, '')) AS size, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS label
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT conv_id, size, label, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, label[1:32]) AS pos FROM told
), rebuilt AS (
  SELECT h.conv_id, t.pos, t.label, t.size FROM heads h JOIN turns t ON t.conv_id = h.start WHERE t.pos <= h.h
  UNION ALL SELECT h.conv_id, t.pos, t.label, t.size FROM heads h JOIN turns t ON t.conv_id = h.conv_id WHERE t.pos > h.h
), placed AS (
  SELECT conv_id, label, size, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM rebuilt
), prefixes AS (
  SELECT conv_id, 0::BIGINT AS depth, '' AS name, 0::BIGINT AS size FROM ids
  UNION ALL SELECT p.conv_id, p.depth, sha256(prefixes.name || p.label), p.size FROM prefixes JOIN placed p ON p.conv_id = prefixes.conv_id AND p.depth = prefixes.depth + 1
), lasts AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id),
nodes AS (
  SELECT p.name, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(p.size) AS size,
         sha256(coalesce(string_agg(CASE WHEN l.depth = p.depth THEN p.conv_id::VARCHAR END, ',' ORDER BY p.conv_id), '')) AS ends_sha256
  FROM prefixes p JOIN lasts l ON l.conv_id = p.conv_id GROUP BY p.name, p.depth
), edges AS (
  SELECT n.name, n.conv_id, n.depth, u.name AS parent, up.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN prefixes u ON u.conv_id = n.conv_id AND u.depth = n.depth - 1 LEFT JOIN nodes up ON up.name = u.name AND up.depth = u.depth
), kids AS (SELECT parent AS name, count(*) AS n_children FROM edges WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT u.name, sum(CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens
  FROM nodes n LEFT JOIN kids k ON k.name = n.name JOIN prefixes u ON u.conv_id = n.conv_id AND u.depth <= n.depth GROUP BY u.name
)
SELECT n.conv_id, n.depth, e.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM nodes n JOIN edges e ON e.name = n.name LEFT JOIN kids k ON k.name = n.name JOIN below b ON b.name = n.name
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()} | {"media_payloads": media_payloads}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": OP3_SQL,
        "media_payloads": MEDIA_PAYLOADS_SQL,
        "op8_chat": OP8_SQL,
        "op9_exact_dedup": OP9_SQL,
        "op10_near_dedup": OP10_SQL,
        "op11_filter_audit": OP11_SQL,
        "op13_prefix_trie": OP13_SQL,
    }
