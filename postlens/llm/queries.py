"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .ann import search
from .common import table
from .embdedup import near_duplicates
from .html_main import main_text
from .mixing import mix_digest
from .packing import pack_documents
from .paragraphs import repeated_passages
from .quality import classify
from .simhash import simhash_components
from .suffix import dedup_substrings
from .tokens import count_tokens



def _pipeline():
    import corpus_pipeline

    return corpus_pipeline


QUERIES = {
    "op1_simhash": lambda spark, d: simhash_components(table(spark, d, "documents")),
    "op2_ann": lambda spark, d: search(table(spark, d, "embeddings")),
    "op3_token_counts": lambda spark, d: count_tokens(table(spark, d, "documents")),
    "op4_mixing": lambda spark, d: mix_digest(table(spark, d, "documents")),
    "op5_suffix_array_dedup": lambda spark, d: dedup_substrings(table(spark, d, "documents")),
    "op6_quality": lambda spark, d: classify(table(spark, d, "documents"), table(spark, d, "labels")),
    "op7_substring_dedup": lambda spark, d: repeated_passages(table(spark, d, "documents"), anywhere=True),
    "op8_embedding_near_dedup": lambda spark, d: near_duplicates(table(spark, d, "embeddings")),
    "op9_packing": lambda spark, d: pack_documents(table(spark, d, "documents")),
    "op10_html_main_text": lambda spark, d: main_text(table(spark, d, "pages")),
    "pipeline": lambda spark, d: _pipeline().run(spark, d),
}

ORACLE_SQL: dict[str, str] = {
    "op8_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_inner_product(e, e) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(r, s) AS (SELECT r, r FROM v UNION SELECT reach.r, l.b FROM reach JOIN links l ON reach.s = l.a),
found AS (SELECT reach.r, min(o.vec_id) AS component_id FROM reach JOIN v o ON o.r = reach.s GROUP BY reach.r)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.r) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN found USING (r)""",
}
