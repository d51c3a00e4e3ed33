"""Registered queries of the training-data operators: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path
from . import sql
from .decontaminate import benchmark_overlaps
from .lexical_search import ranked_search
from .line_templates import line_dedup
from .order_minhash import near_duplicates
from .packing import best_fit_pack, document_items
from .quality_classifier import fit_evidence, quality_scores
from .quality_rules import quality_rules
from .secret_scan import BASE_RULES, joined, secret_spans
from .spelling import spelling_variants, vocabulary
from .substring_dedup import substring_dedup
from .token_records import ids_crc32, read_tokens, write_tokens
from .toxicity import learn, score
from .url_filter import filter_urls


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in 50-word windows that a smaller document holds are removed (recompression)."""
    kept = substring_dedup(read(spark, sf_dir, "documents"), width=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures of every text and the verdict of the line-frequency rules per source."""
    return quality_rules(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "n_kept_words", "kept")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, its site's rate as prior."""
    docs = read(spark, sf_dir, "documents")
    model = fit_evidence(docs, read(spark, sf_dir, "labels").filter(~_held_out()))
    return quality_scores(docs, model)


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_duplicates(read(spark, sf_dir, "documents"))


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text, learned from the rows that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = learn(docs, read(spark, sf_dir, "labels").filter(~_held_out()))
    return score(docs, model).select("doc_id", _held_out().alias("held_out"), "score",
                                     (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text, written as framed records and read back."""
    import public_tokenizers
    folder = scratch_path(spark, "token-records")
    write_tokens(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, folder, ids_crc32, (("ids_crc32", "long", pa.int64()),))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 2048 words; no two documents of one source or equal text share a bin."""
    return best_fit_pack(document_items(read(spark, sf_dir, "documents")), 2048)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified overlaps of documents with benchmark items."""
    return benchmark_overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of recurring templates dropped from every document but the first."""
    kept = line_dedup(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and the n-gram model on every page's URL."""
    return filter_urls(read(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form and the root of every word of 7 letters or more that occurs twice."""
    return spelling_variants(vocabulary(read(spark, sf_dir, "documents"), misspell=31))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item, ranked by their terms."""
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text: the base rules and the further ones."""
    found = secret_spans(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rule"] < len(BASE_RULES))

    def number(rule: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == rule)).cast("long")
    return found.select("doc_id", *(number(r).alias(f"n_{rule[0]}") for r, rule in enumerate(BASE_RULES)),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def registry() -> tuple[dict, dict]:
    queries = {f.__name__: f for f in (op1_substring_dedup, op2_quality_rules, op3_quality_classifier,
                                        op4_order_minhash, op5_toxicity, op6_token_records,
                                        op7_best_fit_packing, op8_decontaminate,
                                        op9_line_templates, op10_url_filter, op11_spelling_variants, op12_lexical_search,
                                        op13_secret_scan)}
    oracles = {"op1_substring_dedup": sql.OP1, "op2_quality_rules": sql.OP2,
               "op11_spelling_variants": sql.OP11, "op12_lexical_search": sql.OP12,
               "op13_secret_scan": sql.OP13}
    return queries, oracles
