"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .ann import op8_pruned_graph
from .langid import op9_string_kernel
from .lexicon import op5_transducer
from .neardup import op3_inverted_join
from .packing import op4_deficit_round_robin
from .quality import op7_hashed_regression
from .sharding import op6_virtual_slots
from .substring import op2_doubling
from .tokencount import op1_separator_scan
from .warc import op10_index_first

QUERIES = {
    f.__name__: f
    for f in (
        op1_separator_scan,
        op2_doubling,
        op3_inverted_join,
        op4_deficit_round_robin,
        op5_transducer,
        op6_virtual_slots,
        op7_hashed_regression,
        op8_pruned_graph,
        op9_string_kernel,
        op10_index_first,
    )
}

_WORDS = "'[^ \\t-\\r]+'"

#: Equal texts, windows and shingles are compared as text here, where the operators compare hashes.
ORACLE_SQL: dict[str, str] = {
    "op2_doubling": f"""
        WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
        win AS (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
        rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
        cov AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM win JOIN rep USING (k)),
        kept AS (SELECT t.r, count(*) AS n, string_agg(t.word, ' ' ORDER BY t.j) AS words
                 FROM (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w) t ANTI JOIN cov ON t.r = cov.r AND t.j = cov.j GROUP BY t.r)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (r)""",
    "op3_inverted_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN [array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, len(ws) - 1)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS k FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        meet AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (SELECT x, y FROM meet JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
        both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON other = x),
        named AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN named ON named.doc_id = w.doc_id""",
    "op10_index_first": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
        g AS (SELECT h, min(page_id) AS original FROM p GROUP BY h)
        SELECT page_id, strlen(h) AS payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(10 * (k // 8) + 1 AS INTEGER), 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31 AS INTEGER) + 1, 1) FOR k IN range(32)], '') AS payload_digest,
               CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to
        FROM p JOIN g USING (h)""",
}
