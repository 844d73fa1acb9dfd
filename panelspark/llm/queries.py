"""The registered queries of the training-data operators."""

from __future__ import annotations

from .bpe import op10_bpe
from .chat import op9_chat
from .decontaminate import op2_decontaminate
from .fingerprints import op1_fingerprints
from .html_text import op3_html
from .minhash import op7_minhash
from .passages import op6_passages
from .pii import op4_pii
from .quality import op5_quality
from .ranked import op11_ranked
from .sharding import op12_shards
from .suffixes import op8_suffixes
from .turns import op13_turns

QUERIES = {"op1_fingerprints": op1_fingerprints, "op2_decontaminate": op2_decontaminate, "op3_html": op3_html, "op4_pii": op4_pii, "op5_quality": op5_quality, "op6_passages": op6_passages, "op7_minhash": op7_minhash, "op8_suffixes": op8_suffixes, "op9_chat": op9_chat, "op10_bpe": op10_bpe, "op11_ranked": op11_ranked, "op12_shards": op12_shards, "op13_turns": op13_turns}

#: Shingle sets compared by a self-join, and classes by their smallest reachable id.
OP7 = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
    FROM documents),
sets AS MATERIALIZED (
    SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM words),
flat AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM sets),
links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM (SELECT x.doc_id AS p, y.doc_id AS q, count(*) AS n FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) j
    JOIN sets a ON a.doc_id = p JOIN sets b ON b.doc_id = q
    WHERE 100 * n >= 75 * (len(a.s) + len(b.s) - n)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM sets LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = doc_id"""

#: SQL twins; SQL can't express the other operators (see tests/llm).
#: CRC-32 of a list of bytes, by a table made from its polynomial.
CRC = r"""crc_steps(i, k, v) AS (
    SELECT i, 0, i::UBIGINT FROM range(256) r(i)
    UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS crc_t FROM crc_steps WHERE k = 8)"""


def crc(text: str) -> str:
    """SQL of the CRC-32 of a text; crc_table must be in FROM."""
    found = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {found}), lambda a, x: xor(a >> 8, crc_t[(xor(a, x) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT"


#: Scores of all items and documents by a join on their terms.
OP11 = r"""
WITH own AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
known AS MATERIALIZED (SELECT * FROM own WHERE len(w) > 0),
sums AS MATERIALIZED (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM known),
counts AS MATERIALIZED (SELECT row, t, count(*) AS tf FROM (SELECT row, unnest(w) AS t FROM known) GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM counts, sums GROUP BY t, n_docs),
asked AS (
    SELECT item_id, item, t, count(*) AS q
    FROM (SELECT item_id, row_number() OVER () AS item, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS t FROM benchmark)
    GROUP BY ALL),
scores AS (
    SELECT item_id, item, doc_id, row, sum(q * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(w) * n_docs) // n_terms))))::BIGINT AS score
    FROM asked JOIN counts USING (t) JOIN weights USING (t) JOIN known USING (row), sums GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""

#: The jumps of each doc_id, for 8 and 9 shards, and slots in the order of the hash.
OP12 = rf"""
WITH RECURSIVE {CRC},
rows AS MATERIALIZED (
    SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {crc("coalesce(text, '')")} AS text_crc32, (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616 AS k
    FROM documents, crc_table),
jumps(doc_id, n, k, b, j) AS (
    SELECT DISTINCT doc_id, n, k, -1::BIGINT, 0::BIGINT FROM rows, (VALUES (8), (9)) v(n)
    UNION ALL
    SELECT doc_id, n, g, j, floor((j + 1) * (2147483648::DOUBLE / ((g // 8589934592) + 1)::DOUBLE))::BIGINT
    FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS g FROM jumps WHERE j < n)),
places AS (SELECT doc_id, max(b) FILTER (n = 8) AS shard, max(b) FILTER (n = 9) AS grown_shard FROM jumps WHERE j >= n GROUP BY doc_id),
parts AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) // 10000 AS part, (k * 2862933555777941757 + 1) % 18446744073709551616 AS g FROM rows),
hashed AS (
    SELECT *, (((g - g % 4294967296 + xor((g % 4294967296)::BIGINT, text_crc32) + part % 1048576) * 2862933555777941757 + 1) % 18446744073709551616) // 4294967296 AS h
    FROM parts)
SELECT x.doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY h, x.doc_id NULLS FIRST, text_crc32, size, part) - 1 AS slot, grown_shard::INT AS grown_shard
FROM hashed x JOIN places p ON x.doc_id IS NOT DISTINCT FROM p.doc_id"""

#: Rebuilt conversations as lists, their prefixes as nodes, and sums over the nodes that start with a node.
OP13 = rf"""
WITH RECURSIVE {CRC},
turns AS (
    SELECT conv_id, turn, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS mark, strlen(coalesce(text, '')) AS bytes
    FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT conv_id, list({{'m': mark, 'b': bytes}} ORDER BY turn NULLS FIRST, sha256(mark)) AS t FROM turns GROUP BY conv_id),
lengths AS MATERIALIZED (SELECT c.conv_id, {crc("c.conv_id::VARCHAR")} % 9 AS h FROM own c, crc_table),
rebuilt AS MATERIALIZED (
    SELECT o.conv_id, list_concat(coalesce(f.t, [])[1:h], o.t[h + 1:]) AS t
    FROM own o JOIN lengths USING (conv_id) LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % 5),
members AS (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS depth FROM rebuilt),
keyed AS MATERIALIZED (SELECT conv_id, depth, len(t) AS n, list_transform(t[1:depth], lambda x: sha256(x.m)) AS k, list_transform(t[1:depth - 1], lambda x: sha256(x.m)) AS p, CASE WHEN depth > 0 THEN t[depth].b ELSE 0 END AS b FROM members),
nodes AS MATERIALIZED (
    SELECT k, depth, any_value(p) AS p, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(b) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
    FROM keyed GROUP BY k, depth),
children AS (SELECT p AS k, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS MATERIALIZED (SELECT x.*, coalesce(c.n, 0) AS n_children FROM nodes x LEFT JOIN children c USING (k, depth)),
above AS (SELECT k[1:d] AS k, d AS depth, saved, (n_children = 0)::INT AS leaf FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_nodes)),
subtrees AS (SELECT k, depth, sum(leaf) AS n_leaves, sum(saved) AS saved FROM above GROUP BY ALL)
SELECT x.conv_id, x.depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, x.ends_sha256
FROM full_nodes x JOIN subtrees s USING (k, depth) LEFT JOIN nodes u ON u.k = x.p AND u.depth = x.depth - 1"""

ORACLES = {"op7_minhash": OP7, "op11_ranked": OP11, "op12_shards": OP12, "op13_turns": OP13}
