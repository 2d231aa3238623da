"""The operators applied to their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, html, langid, neardup, packing, pii, quality, repair, resampling, rules, sharding, vafile

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_vector_approximation_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vafile.integer_vectors(_read(spark, sf_dir, "embeddings"))
    return vafile.search(vectors, F.col("vec_id") % 50 == 0, k=5)


def op2_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(_read(spark, sf_dir, "conversations"))


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), TOKENIZER)


def op4_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op6_checked_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"))


def op7_likelihood_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.assess(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_read(spark, sf_dir, "documents"), TOKENIZER)


def op9_two_pass_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op10_signature_inverted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def op11_four_russians_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(_read(spark, sf_dir, "conversations"))


def op12_bounded_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op13_regular_sampling_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_vector_approximation_topk,
        op2_prefix_target_chat,
        op3_sum_of_squares_packing,
        op4_subword_quality,
        op5_rank_order_language,
        op6_checked_pii,
        op7_likelihood_ratio_rules,
        op8_prefix_bpe,
        op9_two_pass_html,
        op10_signature_inverted_join,
        op11_four_russians_repair,
        op12_bounded_ring_sharding,
        op13_regular_sampling_resample,
    )
}

def _more(best: str, cost: str, edit: str) -> str:
    """SQL that adds an edit to twelve digits of cost and the edits so far."""
    return f"lpad(CAST(CAST(left({best}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({best}, 13) || '{edit}'"


ORACLES = {
    "op10_signature_inverted_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
            FROM words
        ), posted AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
        ), shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
            FROM posted a JOIN posted b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM shared WHERE 100 * common >= 85 * (na + nb - common)
        ), reach AS (
            SELECT doc_id AS node, doc_id AS seen FROM sets
            UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
        ), found AS (
            SELECT node, min(seen) AS component_id FROM reach GROUP BY node
        )
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, f.component_id, s.doc_id = f.component_id AS kept
        FROM sets s JOIN found f ON f.node = s.doc_id
    """,
    "op1_vector_approximation_topk": """
        WITH sound AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(max(list_inner_product(q.v, c.v)) AS BIGINT) AS score
            FROM sound q JOIN sound c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 50 = 0
            GROUP BY 1, 2
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id, score
            FROM pairs
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op2_prefix_target_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), sized AS (
            SELECT *, row_number() OVER w AS i,
                   length(role) + length(text) + 22
                   + len(regexp_extract_all(role, '[<\[]\\*(?:s>|/s>|INST\]|/INST\])'))
                   + len(regexp_extract_all(text, '[<\[]\\*(?:s>|/s>|INST\]|/INST\])')) AS size
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
        ), run AS (
            SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto,
                   max(i) OVER (PARTITION BY conv_id) AS last
            FROM sized
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(upto) FILTER (role = 'assistant' OR i = last) AS BIGINT) AS formatted_chars,
               count(*) FILTER (role = 'assistant' OR i = last) AS n_examples
        FROM run GROUP BY conv_id
    """,
    "op11_four_russians_repair": rf"""
        WITH RECURSIVE bytes AS (
            SELECT list(list_reduce([b] || range(8), lambda c, n:
                       CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS tab
            FROM range(256) t(b)
        ), hashed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(4294967295, list_reduce([4294967295] || [CAST(ascii(x) AS BIGINT) FOR x IN string_split(
                       coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')],
                       lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)]))) % 20 AS k
            FROM conversations, bytes
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
                   CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM hashed WHERE k <> 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i,
                   rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
            FROM damaged
        ), judged AS (
            SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                           WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
            FROM placed
        ), whole AS (
            SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
                   count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                   count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
                   list(fault ORDER BY i) AS faults, list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts
            FROM judged GROUP BY conv_id
        ), conv AS (
            SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
                   coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
                   coalesce(faults, []) AS faults, coalesce(roles, []) AS roles, coalesce(texts, []) AS texts
            FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
        ), step AS (
            -- Cost (12 digits) and edits of the best way to write nothing, a system, a user, an assistant turn last.
            SELECT conv_id, 0 AS i, [repeat('0', 12), '900000000000', '000000000002I', '000000000004II'] AS best FROM conv
            UNION ALL
            SELECT conv_id, i, [n[1], n[2], u, least(n[4], {_more("u", "2", "I")})] FROM (
                SELECT conv_id, i, n, least(n[3], {_more("n[1]", "2", "I")}, {_more("n[2]", "2", "I")}, {_more("n[4]", "2", "I")}) AS u FROM (
                    SELECT conv_id, i, CASE WHEN fault IN ('b', 'd') THEN [{_more("x", "3", "D")} FOR x IN best] ELSE [
                        {_more("best[1]", "3", "D")},
                        least({_more("best[2]", "3", "D")}, CASE WHEN r = 's' THEN {_more("best[1]", "e", "K")} ELSE '99' END),
                        least({_more("best[3]", "3", "D")}, {_more("least(best[1], best[2], best[4])", "2 + e", "R")},
                              CASE WHEN r = 'u' THEN {_more("least(best[1], best[2], best[4])", "e", "K")} ELSE '99' END),
                        least({_more("best[4]", "3", "D")}, {_more("best[3]", "2 + e", "R")}, CASE WHEN r = 'a' THEN {_more("best[3]", "e", "K")} ELSE '99' END)
                    ] END AS n FROM (
                        SELECT s.conv_id, s.i + 1 AS i, s.best, c.faults[s.i + 1] AS fault, left(c.roles[s.i + 1], 1) AS r,
                               CASE WHEN c.faults[s.i + 1] = 't' THEN 1 ELSE 0 END AS e
                        FROM step s JOIN conv c ON s.conv_id IS NOT DISTINCT FROM c.conv_id WHERE s.i < len(c.faults)
                    )
                )
            )
        ), chosen AS (
            SELECT c.*, CAST(left(least(best[1], best[4]), 12) AS BIGINT) AS cost, substr(least(best[1], best[4]), 13) AS audit
            FROM step s JOIN conv c ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = len(c.faults)
        ), written AS (
            SELECT conv_id, 0 AS p, 0 AS i, '' AS last, [''][:0] AS lines, audit, roles, texts FROM chosen
            UNION ALL
            SELECT conv_id, p + 1, CASE WHEN e = 'I' THEN i ELSE i + 1 END,
                   CASE e WHEN 'D' THEN last WHEN 'K' THEN left(roles[i + 1], 1) ELSE left(fit, 1) END,
                   CASE e WHEN 'D' THEN lines WHEN 'I' THEN lines || [fit || ':']
                          WHEN 'K' THEN lines || [roles[i + 1] || ':' || texts[i + 1]] ELSE lines || [fit || ':' || texts[i + 1]] END,
                   audit, roles, texts
            FROM (SELECT *, substr(audit, p + 1, 1) AS e, CASE WHEN last = 'u' THEN 'assistant' ELSE 'user' END AS fit
                  FROM written WHERE p < length(audit))
        )
        SELECT c.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, cost, c.audit,
               sha256(array_to_string(lines, chr(10))) AS repaired_sha256
        FROM chosen c JOIN written w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.p = length(c.audit)
    """,
    "op13_regular_sampling_resample": r"""
        WITH bytes AS (
            SELECT list(list_reduce([b] || range(8), lambda c, n:
                       CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS tab
            FROM range(256) t(b)
        ), words AS (
            SELECT row_number() OVER () AS id, doc_id, aim, list_filter(regexp_split_to_array(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
            FROM (SELECT doc_id, text, false AS aim FROM documents UNION ALL SELECT NULL, text, true FROM benchmark)
        ), featured AS (
            SELECT id, aim, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]
                                     || [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS f
            FROM words
        ), hexed AS (
            SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM featured)
        ), hashed AS (
            SELECT f, xor(4294967295, list_reduce([4294967295] || [CAST('0x' || substr(x, CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT)
                       FOR i IN range(1, length(x) // 2 + 1)], lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]))) % 10000 AS bucket
            FROM hexed, bytes
        ), held AS (
            SELECT id, aim, bucket, count(*) AS n FROM featured JOIN hashed USING (f) GROUP BY ALL
        ), counted AS (
            SELECT bucket, coalesce(sum(n) FILTER (aim), 0) AS t, coalesce(sum(n) FILTER (NOT aim), 0) AS s FROM held GROUP BY bucket
        ), gained AS (
            SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * ((SELECT sum(s) FROM counted) + 10000.0::DOUBLE)
                       / ((s + 1.0::DOUBLE) * ((SELECT sum(t) FROM counted) + 10000.0::DOUBLE)))) AS BIGINT) AS gain
            FROM counted
        ), weighed AS (
            SELECT id, sum(n) AS n, sum(n * gain) AS weight FROM held JOIN gained USING (bucket) WHERE NOT aim GROUP BY id
        ), scored AS (
            SELECT doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                   CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('42:'
                       || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
            FROM words LEFT JOIN weighed USING (id) WHERE NOT aim
        ), drawn AS (
            SELECT *, n_words >= 20 AS fit, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place,
                   count(*) OVER (PARTITION BY n_words >= 20) AS n
            FROM scored
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 5 * n // 100 THEN place END AS rank FROM drawn
    """,
    "op12_bounded_ring_sharding": r"""
        WITH RECURSIVE spots AS (
            SELECT s AS shard, CAST('0x' || left(sha256('shard ' || s || ' node ' || n), 4) AS BIGINT) AS position
            FROM range(40) a(s), range(64) b(n)
        ), nodes AS (
            SELECT shard, position, row_number() OVER (ORDER BY position, shard) - 1 AS node FROM spots
        ), bytes AS (
            SELECT list(list_reduce([b] || range(8), lambda c, n:
                       CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS tab
            FROM range(256) t(b)
        ), hexed AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
        ), sized AS (
            SELECT doc_id, length(x) // 2 + 16 AS size, xor(4294967295, list_reduce([4294967295]
                       || [CAST('0x' || substr(x, CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT) FOR i IN range(1, length(x) // 2 + 1)],
                       lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]))) AS text_crc32,
                   CAST('0x' || left(sha256(coalesce(CAST(doc_id AS VARCHAR), '')), 4) AS BIGINT) AS spot
            FROM hexed, bytes
        ), mixed AS (
            SELECT *, CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || text_crc32 || ':' || spot), 15) AS BIGINT) AS m,
                   (SELECT count(*) FROM nodes WHERE position < spot) % 2560 AS arc
            FROM sized
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY arc ORDER BY m % 256, m, doc_id, size, text_crc32) - 1 AS place FROM mixed
        ), step AS (
            -- The arcs with keys that still wait, where they are now, and the room left in every shard.
            SELECT 0 AS k, arc, 0::BIGINT AS low, 0::BIGINT AS take, -1::BIGINT AS shard, count(*) AS waiting, 0::BIGINT AS done,
                   (SELECT [n // 40 + CASE WHEN s < n % 40 THEN 1 ELSE 0 END FOR s IN range(40)] FROM (SELECT count(*) AS n FROM ranked)) AS room, 0::BIGINT AS base
            FROM ranked GROUP BY arc
            UNION ALL
            (WITH met AS (
                SELECT s.*, n.shard AS at_shard, coalesce(sum(waiting) OVER (PARTITION BY n.shard ORDER BY n.node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
                FROM step s JOIN nodes n ON n.node = (s.arc + s.k) % 2560 WHERE waiting > 0
            ), taken AS (
                SELECT *, greatest(0, least(waiting, room[at_shard + 1] - ahead)) AS now FROM met
            ), rooms AS (
                SELECT list(r ORDER BY i) AS new_room FROM (
                    SELECT i, any_value(room[i + 1]) - coalesce(sum(now) FILTER (at_shard = i), 0) AS r FROM taken, range(40) t(i) GROUP BY i)
            )
            SELECT k + 1, arc, done, CAST(now AS BIGINT), at_shard, CAST(waiting - now AS BIGINT), CAST(done + now AS BIGINT), CAST(new_room AS BIGINT[]),
                   CAST(room[at_shard + 1] - least(ahead, room[at_shard + 1]) AS BIGINT)
            FROM taken, rooms)
        ), pieces AS (
            SELECT arc, low, low + take AS high, shard, base FROM step WHERE take > 0
        ), total AS (SELECT count(*) AS n FROM ranked)
        SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p.shard AS INTEGER) AS shard,
               n // 40 + CASE WHEN p.shard < n % 40 THEN 1 ELSE 0 END - base + place - low AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM ranked r JOIN pieces p ON p.arc = r.arc AND r.place >= p.low AND r.place < p.high, total
    """,
}
