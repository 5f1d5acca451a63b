"""The queries of this package over the given tables."""

from __future__ import annotations

from .centroids import cluster_report, cluster_sql
from .codebooks import code_report, code_sql
from .contamination import contamination_report
from .embeddings import embedding_links
from .html import extract
from .licenses import license_scan
from .minhash import near_duplicates
from .mixing import MIX_SQL, mix_sizes
from .pii import pseudonymised
from .quality import quality
from .registry import query, table
from .repeats import repeats_removed
from .rules import rule_report, rule_sql
from .token_count import token_counts

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@query("op1_minhash_dedup")
def op1(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))


@query("op2_mix_sources", MIX_SQL)
def op2(spark, folder):
    return mix_sizes(table(spark, folder, "documents"))


@query("op3_license_scan")
def op3(spark, folder):
    return license_scan(table(spark, folder, "documents")).drop("places")


@query("op4_html_text")
def op4(spark, folder):
    return extract(table(spark, folder, "pages").select("page_id", "url", "html"))


@query("op10_quality_qda")
def op10(spark, folder):
    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_decontaminate")
def op9(spark, folder):
    return contamination_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_pii_pseudonyms")
def op7(spark, folder):
    return pseudonymised(table(spark, folder, "documents").select("doc_id", "text"))


@query("op8_embedding_dedup")
def op8(spark, folder):
    return embedding_links(table(spark, folder, "embeddings"))


@query("op6_token_counts")
def op6(spark, folder, vocabulary: str = VOCABULARY):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts(docs, vocabulary).drop("text")


@query("op5_repeated_bytes")
def op5(spark, folder):
    return repeats_removed(table(spark, folder, "documents")).drop("spans", "kept")


@query("op11_vector_codes", code_sql())
def op11(spark, folder):
    return code_report(table(spark, folder, "embeddings"))


@query("op12_centroids", cluster_sql())
def op12(spark, folder):
    return cluster_report(table(spark, folder, "embeddings"))


@query("op13_quality_rules", rule_sql())
def op13(spark, folder):
    return rule_report(table(spark, folder, "documents"))
