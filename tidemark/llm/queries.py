"""The operators as queries over the synthetic tables, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_digests
from .common import table
from .embeddings import dedup_embeddings
from .jaccard import jaccard_components
from .line_dedup import line_dedup_digests
from .mixing import mixed_sizes
from .quality_rules import quality_verdicts
from .quality_trees import quality_scores
from .suffix_dedup import substring_digests
from .url_filter import judged_urls
from .warc import pages_through_warc

MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS room FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
        - coalesce(sum(room) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(room, weight * max(level) OVER ()) AS target FROM l),
r AS (SELECT d.doc_id, d.source, CAST(d.size AS BIGINT) AS size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
        CAST(('0x' || substr(sha256(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':mix:17'), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(floor(rate) AS BIGINT) + CAST(draw < rate - floor(rate) AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, copies FROM c
"""

LINE_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, (h.key IS NOT NULL AND k.doc_id <> h.keep_id) AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::BIGINT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url FROM pages),
b AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS top FROM b WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT b.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, b.payload_digest,
       CASE WHEN b.page_id <> m.top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b.page_id <> m.top THEN m.top END AS refers_to
FROM b LEFT JOIN m USING (payload_digest)
"""


JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

COSINE_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM v WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
      WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS least FROM r GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id, coalesce(c.least >= e.vec_id, true) AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": lambda spark, sf: bpe_digests(table(spark, sf, "documents")),
        "op2_jaccard_join": lambda spark, sf: jaccard_components(table(spark, sf, "documents")),
        "op3_quality_classifier": lambda spark, sf: quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels")),
        "op4_url_filters": lambda spark, sf: judged_urls(table(spark, sf, "pages")),
        "op5_mix_sources": lambda spark, sf: mixed_sizes(table(spark, sf, "documents")),
        "op6_warc": lambda spark, sf: pages_through_warc(table(spark, sf, "pages")).select(
            "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
        ),
        "op7_suffix_array_dedup": lambda spark, sf: substring_digests(table(spark, sf, "documents")),
        "op8_embedding_near_dedup": lambda spark, sf: dedup_embeddings(table(spark, sf, "embeddings")),
        "op9_quality_rules": lambda spark, sf: quality_verdicts(table(spark, sf, "documents"), table(spark, sf, "labels")),
        "op10_line_dedup": lambda spark, sf: line_dedup_digests(table(spark, sf, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": JACCARD_SQL, "op8_embedding_near_dedup": COSINE_SQL, "op5_mix_sources": MIX_SQL, "op6_warc": WARC_SQL, "op10_line_dedup": LINE_SQL}
