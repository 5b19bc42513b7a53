"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from .fill_in_middle import op13_fill_in_middle
from .html_text import op10_line_blocks
from .jaccard_join import op7_jaccard_join
from .language_id import op3_language_id
from .mixing import op6_mix_sources
from .packing import op9_best_fit_packing
from .piece_codec import op12_piece_codec
from .quotes import op1_quotation_linking
from .sale_assembly import op11_sale_assembly
from .suffix_dedup import op2_suffix_dedup
from .syncmers import op8_closed_syncmers
from .topk import op5_exact_topk
from .url_filter import op4_url_lm_ratio

QUERIES = {f.__name__: f for f in (op1_quotation_linking, op2_suffix_dedup, op3_language_id, op4_url_lm_ratio, op5_exact_topk, op6_mix_sources, op7_jaccard_join, op8_closed_syncmers, op9_best_fit_packing, op10_line_blocks, op11_sale_assembly, op12_piece_codec, op13_fill_in_middle)}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
          FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0), s AS (
          SELECT q.vec_id AS query_id, q.e AS qe, c.vec_id AS vec_id,
                 CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
        ), r AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, qe ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
