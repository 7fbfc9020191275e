"""The operators bound to the standard tables: one query for each.

Each query applies its operator, with production parameters, to all rows of its
tables.  Nulls, empty and very long texts, ties and repeated rows, empty tables
and other columns have the results that the operator's docstring states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, hamming_dedup, lexical_search, mixing, near_dedup, ngram_score, pii, quality_knn, quality_rules, source_audit, token_count, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, by source.  Cases: as ``mixing.mix_sources``."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their three-word shingles.  Cases: as ``near_dedup.document_components``."""
    return near_dedup.document_components(table(spark, sf_dir, "documents"), width=3, percent=85)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text.  Cases: as ``pii.find_personal_data``."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds control strings, formatted and read back.  Cases: as ``chat.conversation_digests``."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.sql("SELECT * FROM VALUES (-7, 0, 'user', :said), (-7, 1, 'assistant', :said)", args={"said": said}).toDF(*rows.columns).to(rows.schema)
    return chat.conversation_digests(rows.unionByName(extra))


def op5_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text by its nearest labelled neighbours.  Cases: as ``quality_knn.score_quality``."""
    return quality_knn.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=0, threshold=0.3)


def op6_ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all texts.  Cases: as ``ngram_score.score_texts``."""
    return ngram_score.score_texts(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every text.  Cases: as ``decontaminate.contamination``."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text.  Cases: as ``token_count.count_tokens``."""
    import public_tokenizers

    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all urls, by general terms and by those that labelled documents teach.  Cases: as ``url_filter.filter_urls``."""
    learned = url_filter.learned_terms(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), vocabulary=url_filter.general_terms(spark).unionByName(learned))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of and verdicts on all texts.  Cases: as ``quality_rules.judge_documents``."""
    return quality_rules.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of vectors of one label with cosines of 0.98 at least.  Cases: as ``hamming_dedup.vector_components``."""
    return hamming_dedup.vector_components(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of each language.  Cases: as ``source_audit.audit_sources``."""
    return source_audit.audit_sources(table(spark, sf_dir, "documents"), least=3, top=200)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item.  Cases: as ``lexical_search.search``."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_near_dedup": op2_near_dedup,
        "op3_pii": op3_pii,
        "op4_chat_format": op4_chat_format,
        "op5_quality_knn": op5_quality_knn,
        "op6_ngram_score": op6_ngram_score,
        "op7_decontaminate": op7_decontaminate,
        "op8_token_count": op8_token_count,
        "op9_url_filter": op9_url_filter,
        "op10_quality_rules": op10_quality_rules,
        "op11_embedding_dedup": op11_embedding_dedup,
        "op12_source_audit": op12_source_audit,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mixing.ORACLE_SQL,
        "op4_chat_format": chat.ORACLE_SQL,
        "op7_decontaminate": decontaminate.ORACLE_SQL,
        "op9_url_filter": url_filter.oracle_sql(),
        "op12_source_audit": source_audit.ORACLE_SQL,
        "op13_lexical_search": lexical_search.ORACLE_SQL,
    }
