"""Queries ``opN_<name>`` over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op9_decontamination
from .extract import op3_extract_text
from .histogram_packing import op11_histogram_packing
from .line_dedup import op10_line_dedup
from .packing import op8_packing
from .periodic_runs import op13_periodic_runs
from .prefix_trie import op12_prefix_trie
from .quality import op7_quality_rules
from .simhash import op6_simhash
from .token_files import op4_token_files
from .surrogates import op2_surrogates
from .toxicity import op1_toxicity
from .warc import op5_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_surrogates, op3_extract_text, op4_token_files, op5_warc, op6_simhash, op7_quality_rules, op8_packing, op9_decontamination, op10_line_dedup, op11_histogram_packing, op12_prefix_trie, op13_periodic_runs)
    return {f.__name__: f for f in found}


#: Base32 of a SHA-1: five hex digits at a time are four letters.
OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
 d AS (SELECT page_id, strlen(body) AS n, min(page_id) OVER (PARTITION BY body) AS first,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST(concat('0x', substr(h, i // 4 * 5 + 1, 5)) AS BIGINT) >> ((3 - i % 4) * 5)) & 31) AS INTEGER) + 1, 1)), '') AS digest FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""

#: The shortest runs of 50 words from each line and up to it, named by their text; where one begins earlier, its lines go.
OP10_SQL = r"""
WITH l AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'raw': i - 1, 'line': x})) AS u FROM documents),
 a AS (SELECT doc_id, u.raw AS raw, u.line AS line, len(regexp_extract_all(u.line, '[^\x20\x09-\x0D]+')) AS w FROM l),
 c AS (SELECT *, row_number() OVER o - 1 AS seq, sum(w) OVER o AS cum FROM a WHERE w > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY raw ROWS UNBOUNDED PRECEDING)),
 p AS (SELECT s.doc_id, s.seq AS a, e.seq AS b FROM c s JOIN c e ON s.doc_id = e.doc_id AND e.seq BETWEEN s.seq AND s.seq + 49 AND e.cum - s.cum + s.w >= 50),
 r AS (SELECT doc_id, a AS seq, min(b) AS last FROM p GROUP BY doc_id, a UNION SELECT doc_id, max(a), b FROM p GROUP BY doc_id, b),
 k AS (SELECT r.doc_id, r.seq, r.last - r.seq + 1 AS len, string_agg(c.line, chr(10) ORDER BY c.seq) AS run FROM r JOIN c ON r.doc_id = c.doc_id AND c.seq BETWEEN r.seq AND r.last GROUP BY ALL),
 f AS (SELECT *, min({'d': doc_id, 's': seq}) OVER (PARTITION BY run) AS first FROM k),
 g AS (SELECT DISTINCT doc_id, unnest(range(seq, seq + len)) AS seq FROM f WHERE first.d < doc_id OR (first.d = doc_id AND first.s + len <= seq)),
 x AS (SELECT c.doc_id, c.raw FROM g JOIN c USING (doc_id, seq)),
 t AS (SELECT a.doc_id, coalesce(string_agg(line, chr(10) ORDER BY a.raw) FILTER (x.raw IS NULL), '') AS text, count(x.raw) AS n FROM a LEFT JOIN x ON a.doc_id = x.doc_id AND a.raw = x.raw GROUP BY a.doc_id)
SELECT doc_id, text, CAST(n AS INTEGER) AS n_lines_cut FROM t
"""

#: Nodes as lists of turns; the CRC-32 of a decimal by its table, which a rule gives.
OP12_SQL = r"""
WITH t AS (SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS u, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
 k AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END)) AS crc),
 s AS (SELECT conv_id, list(u ORDER BY i) AS own FROM t GROUP BY conv_id),
 h AS (SELECT s.*, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, d: xor(c // 256, k.crc[xor(c % 256, d) + 1])), CAST(4294967295 AS BIGINT)) % 4 AS h FROM s, k),
 w AS (SELECT c.conv_id, list_concat(coalesce(list_slice(b.own, 1, c.h), []), list_slice(c.own, c.h + 1, len(c.own))) AS turns FROM h c LEFT JOIN s b ON b.conv_id = c.conv_id - c.conv_id % 20),
 m AS (SELECT conv_id, len(turns) AS n, d, list_slice(turns, 1, d) AS node FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM w)),
 n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(node[-1].t, '[^\x20\x09-\x0D]+')) END AS saved,
   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM m GROUP BY node, d),
 c AS (SELECT p.node, p.d, count(*) AS kids FROM n JOIN n p ON p.d = n.d - 1 AND p.node = list_slice(n.node, 1, n.d - 1) GROUP BY ALL),
 a AS (SELECT list_slice(node, 1, up) AS node, sum(saved) AS saved, count(*) FILTER (kids IS NULL) AS leaves FROM (SELECT n.*, c.kids, unnest(range(0, n.d + 1)) AS up FROM n LEFT JOIN c USING (node, d)) GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(c.kids, 0) AS BIGINT) AS n_children, CAST(a.leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN a USING (node) LEFT JOIN c USING (node, d) LEFT JOIN n p ON p.d = n.d - 1 AND p.node = list_slice(n.node, 1, n.d - 1)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": OP5_SQL, "op10_line_dedup": OP10_SQL, "op12_prefix_trie": OP12_SQL}
