"""One query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stackquarry.llm import bpe, decontaminate, embedding_dedup, fingerprints, html_extract, mixing, near_dedup, prefix_trie, quality, repair, secrets, suffix_dedup, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.group(table(spark, sf_dir, "embeddings"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_fingerprints": op2_fingerprints,
    "op3_secrets": op3_secrets,
    "op4_near_dedup": op4_near_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_quality": op6_quality,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_bpe": op8_bpe,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_mix": op10_mix,
    "op11_decontaminate": op11_decontaminate,
    "op12_repair": op12_repair,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE: dict[str, str] = {
    "op10_mix": """
WITH sizes AS (
    SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY size) - 1 AS nth
    FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents)
), sums AS (
    SELECT source, sum(size)::BIGINT AS source_size, sum(size * length(bin(size)))::DOUBLE AS measured
    FROM sizes GROUP BY source
), weighed AS (
    SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
           (source_size * 3)::DOUBLE AS most
    FROM sums
), levels AS (
    SELECT *,
           (sum(source_size) OVER ()
              - (sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - most))
         / (sum(weight) OVER ()
              - (sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - weight))
           AS level
    FROM weighed
), targets AS (
    SELECT *, least(most, weight * max(CASE WHEN level <= most / weight THEN level END) OVER ()) AS target
    FROM levels
), drawn AS (
    SELECT s.doc_id, s.size, s.nth, t.source, t.source_size, t.target,
           least(floor(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END), 3)::BIGINT AS copies,
           CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio,
           length(bin(s.size)) / (greatest(t.measured, 1) / greatest(t.source_size, 1)) AS measure,
           (('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, 'null') || CASE WHEN s.nth > 0 THEN ':' || s.nth ELSE '' END), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
    FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), placed AS (
    SELECT *, CASE WHEN copies >= 3 THEN 0 ELSE target - copies * source_size END AS wanted,
           least(CASE WHEN copies >= 3 THEN 0 ELSE ratio - copies END * measure, 0.999) AS chance
    FROM drawn
), ordered AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY u * (1 - chance) / (u * (1 - chance) + (1 - u) * chance), doc_id, size, nth
                              ROWS UNBOUNDED PRECEDING) AS through
    FROM placed
)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN wanted > 0 AND through - size / 2.0 <= wanted THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered
""",
    "op11_decontaminate": """
WITH texts AS (
    SELECT row_number() OVER () AS nth, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
    FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
    FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i:i + n - 1], ' '))) AS run
    FROM (SELECT *, least(10, len(words)) AS n FROM items WHERE len(words) > 0)
), runs AS (
    SELECT nth, n, unnest(list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i:i + n - 1], ' '))) AS run,
           unnest(range(1, len(words) - n + 2)) AS low
    FROM texts, (SELECT DISTINCT n FROM windows)
    WHERE len(words) >= n
), met AS (
    SELECT nth, low, n, item_id FROM runs JOIN windows USING (n, run)
), hits AS (
    SELECT nth, count(DISTINCT place) AS n_hit
    FROM (SELECT nth, unnest(range(low, low + n)) AS place FROM (SELECT DISTINCT nth, low, n FROM met))
    GROUP BY nth
), named AS (
    SELECT nth, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT nth, item_id::VARCHAR AS item FROM met WHERE item_id IS NOT NULL)
    GROUP BY nth
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hits USING (nth) LEFT JOIN named USING (nth)
""",
    "op12_repair": """
WITH RECURSIVE keyed AS (
    SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), kinds AS (
    SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda r, step: xor(r >> 1, 3988292384 * (r & 1))))) % 20 AS kind
    FROM keyed
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
           unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM kinds
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth,
           left(role, 1) AS initial, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending
    FROM damaged
), turns AS (
    SELECT *, CASE WHEN ending = '' THEN 'blank'
                   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nth) > 1 THEN 'duplicate'
                   WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY nth) AS before
    FROM placed
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
           count(*) AS n
    FROM turns GROUP BY conv_id
), inserts(state, rise, edits, onto) AS (
    VALUES (0, 0, '', 0), (1, 0, '', 1), (2, 0, '', 2), (3, 0, '', 3), (0, 2, 'I', 2), (1, 2, 'I', 2), (2, 2, 'I', 3),
           (3, 2, 'I', 2), (0, 4, 'II', 3), (1, 4, 'II', 3)
), edits(state, initial, rise, edit, onto) AS (
    VALUES (0, 's', 0, 'K', 1), (0, 'u', 0, 'K', 2), (1, 'u', 0, 'K', 2), (2, 'a', 0, 'K', 3), (3, 'u', 0, 'K', 2),
           (0, '', 3, 'D', 0), (1, '', 3, 'D', 1), (2, '', 3, 'D', 2), (3, '', 3, 'D', 3),
           (0, '', 2, 'R', 2), (1, '', 2, 'R', 2), (2, '', 2, 'R', 3), (3, '', 2, 'R', 2)
), walk AS (
    SELECT conv_id, 0::BIGINT AS nth, 0 AS state, '000000' AS best FROM counts
    UNION ALL
    SELECT w.conv_id, t.nth, e.onto,
           min(printf('%06d', left(w.best, 6)::INT + i.rise + e.rise + (t.fault = 'truncated' AND e.edit <> 'D')::INT)
               || substr(w.best, 7) || i.edits || e.edit)
    FROM walk w
    JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.nth = w.nth + 1
    JOIN inserts i ON i.state = w.state
    JOIN edits e ON e.state = i.onto AND (e.edit = 'D' OR t.fault IN ('', 'truncated') AND (e.edit = 'R' OR e.initial = t.initial))
    GROUP BY w.conv_id, t.nth, e.onto
), paths AS (
    SELECT w.conv_id, min(printf('%06d', left(best, 6)::INT + x.rise) || substr(best, 7) || x.edits) AS best
    FROM walk w
    JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.nth
    JOIN (VALUES (0, 0, ''), (1, 4, 'II'), (2, 2, 'I'), (3, 0, '')) x(state, rise, edits) ON x.state = w.state
    GROUP BY w.conv_id
), steps AS (
    SELECT conv_id, unnest(string_split(substr(best, 7), '')) AS edit, unnest(range(1, len(best) - 5)) AS step FROM paths
    WHERE len(best) > 6
), met AS (
    SELECT s.conv_id, s.step, s.edit, t.role, t.text, t.initial
    FROM (SELECT *, sum((edit <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY step) AS nth FROM steps) s
    LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.nth = s.nth AND s.edit <> 'I'
    WHERE s.edit <> 'D'
), lines AS (
    SELECT conv_id, step, CASE WHEN edit = 'K' THEN role
                               WHEN (row_number() OVER w - (first_value(edit = 'K' AND initial = 's') OVER w)::INT) % 2 = 1 THEN 'user'
                               ELSE 'assistant' END || ':' || coalesce(text, '') AS line
    FROM met WINDOW w AS (PARTITION BY conv_id ORDER BY step)
), repaired AS (
    SELECT conv_id, string_agg(line, chr(10) ORDER BY step) AS whole FROM lines GROUP BY conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
       coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal,
       coalesce(left(p.best, 6)::BIGINT, 0) AS cost, coalesce(substr(p.best, 7), '') AS audit, sha256(coalesce(r.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN paths p ON p.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
""",
    "op13_prefix_trie": """
WITH own AS (
    SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                         ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), shares AS (
    SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda r, step: xor(r >> 1, 3988292384 * (r & 1))))) % 4 AS share
    FROM own
), rebuilt AS (
    SELECT s.conv_id, list_concat(coalesce(h.turns, [])[1:s.share], s.turns[s.share + 1:]) AS turns
    FROM shares s LEFT JOIN own h ON h.conv_id = s.conv_id - s.conv_id % 20
), named AS (
    SELECT *, list_transform(turns, lambda t: md5(length(t.role) || ':' || t.role || t.text)) AS names FROM rebuilt
), prefixes AS (
    SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth,
           unnest(list_transform(range(0, len(turns) + 1), lambda d: array_to_string(names[1:d], ','))) AS prefix,
           unnest(list_transform(range(0, len(turns) + 1), lambda d: array_to_string(names[1:greatest(d - 1, 0)], ','))) AS parent,
           unnest(list_transform(range(0, len(turns) + 1), lambda d: CASE WHEN d = 0 THEN 0 ELSE
               len(regexp_extract_all(turns[d].text, '[^\\x20\\x09-\\x0D]+')) END)) AS words,
           len(turns) AS length
    FROM named
), nodes AS (
    SELECT depth, prefix, any_value(parent) AS parent, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n,
           string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth) AS ends
    FROM prefixes GROUP BY depth, prefix
), children AS (
    SELECT depth - 1 AS depth, parent AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), valued AS (
    SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.prefix = n.prefix
), subtrees AS (
    SELECT p.depth, p.prefix, sum((v.n_children = 0)::BIGINT) AS n_leaves, sum((v.n - 1) * v.words) AS saved_tokens
    FROM valued v JOIN prefixes p ON p.conv_id = v.conv_id AND p.depth <= v.depth
    GROUP BY p.depth, p.prefix
)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM valued v
JOIN subtrees s ON s.depth = v.depth AND s.prefix = v.prefix
LEFT JOIN nodes u ON u.depth = v.depth - 1 AND u.prefix = v.parent
""",
}
