"""Named queries of the corpus operators and, where SQL can say it, their equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaykit.llm.bpe import round_trip_digests
from assaykit.llm.common import TOKENIZER, table
from assaykit.llm.exact_dedup import exact_dedup
from assaykit.llm.fill_middle import FIM_SQL, fim_digests
from assaykit.llm.hnsw import nearest, stated_queries
from assaykit.llm.html_extract import extract_text
from assaykit.llm.language_id import identify
from assaykit.llm.lexical import RANKED_SQL, ranked_search
from assaykit.llm.line_dedup import dedup_lines
from assaykit.llm.mixing import MIX_SQL, mix_sources
from assaykit.llm.near_dedup import near_groups
from assaykit.llm.quality import quality_scores
from assaykit.llm.substring_dedup import substring_dedup
from assaykit.llm.url_filter import judge_urls, seed_labels, train


def op1_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, train(seed_labels(pages)))


def op2_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_extraction(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents"))


def op6_hnsw_search(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings")
    return nearest(embeddings, stated_queries(embeddings))


def op7_mix_sources(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


def op8_bpe(spark, sf_dir):
    return round_trip_digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_minhash_near_dedup(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"))


def op11_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", F.size("languages").alias("n_languages"))


def op12_ranked_search(spark, sf_dir):
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fill_middle(spark, sf_dir):
    return fim_digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_quality_classifier, op3_html_extraction, op4_exact_dedup, op5_line_dedup, op6_hnsw_search, op7_mix_sources, op8_bpe,
    op9_minhash_near_dedup, op10_substring_dedup, op11_language_id, op12_ranked_search, op13_fill_middle,
)}

ORACLES = {
    "op4_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)""",
    "op7_mix_sources": MIX_SQL,
    "op12_ranked_search": RANKED_SQL,
    "op13_fill_middle": FIM_SQL,
}
