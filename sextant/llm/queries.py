"""The queries of this subpackage, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sextant.llm import divergence
from sextant.llm.divergence import op12_divergence
from sextant.llm.jaccard import op4_jaccard
from sextant.llm.maxent import op1_maxent
from sextant.llm.media import op8_media
from sextant.llm.mixing import op10_mixing
from sextant.llm.notices import op11_notices
from sextant.llm.packing import op3_packing
from sextant.llm.pii import op6_surrogates
from sextant.llm.repeats import op2_repeats
from sextant.llm.sharding import op5_sharding
from sextant.llm.syncmers import op7_syncmers
from sextant.llm.toxicity import op9_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_maxent, op2_repeats, op3_packing, op4_jaccard, op5_sharding, op6_surrogates, op7_syncmers, op8_media, op9_toxicity, op10_mixing, op11_notices, op12_divergence)}


#: Links by counting shared shingles, components by reachability.
JACCARD_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
 e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
 SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id)::BIGINT AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The other operators depend on hashes, trained weights or image features that SQL doesn't have; tests/llm holds them against plain versions."""
    return {"op4_jaccard": JACCARD_SQL, "op12_divergence": divergence.SQL}
