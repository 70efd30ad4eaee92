"""The queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import block_norms, delta_lloyd, licenses, quotes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querent.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(quotes.mailbox(table(spark, sf_dir, "conversations"))).withColumnsRenamed({"thread": "conv_id", "order": "turn"})


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op4_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querent.llm.chroma import align, fingerprints, melody

    recordings = melody(table(spark, sf_dir, "embeddings"))
    return align(fingerprints(recordings, rate=2000, id_col="vec_id"), id_col="vec_id")


def op5_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querent.llm.weak_labels import weak_quality

    return weak_quality(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querent.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querent.llm.secrets import secrets

    return secrets(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querent.llm.quality_rules import fit_rules, quality

    docs = table(spark, sf_dir, "documents")
    return quality(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


#: Documents have no prompts: the first quarter of each stands for one. With 1,600 loss-bearing tokens of 2,048 a
#: long document's answer can't fill a sequence, which takes prompts of others to its end.
PROMPT_SHARE = 0.25


def tokenizer_file(name: str) -> str:
    """Where the public tokenizers' files are on this machine; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querent.llm.packing import Limits, pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=1, limits=Limits(loss=1600, segments=64), prompt_share=PROMPT_SHARE)


def op8_elias_fano_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querent.llm.elias_fano import encode_and_read

    return encode_and_read(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)


def op11_delta_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querent.llm.delta_lloyd import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


def op12_block_norm_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querent.llm.block_norms import clusters

    return clusters(table(spark, sf_dir, "embeddings")).drop("n_exact")


def op13_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querent.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quotation_linking, op2_license_scan, op3_quality_rules, op4_chroma_fingerprints, op5_weak_label_quality,
        op6_vector_packing, op7_mixing, op8_elias_fano_token_ids, op9_secret_scan, op10_simhash_near_dedup,
        op11_delta_lloyd_codes, op12_block_norm_clusters, op13_pu_toxicity,
    )
}

#: DuckDB SQL for those that SQL can express; the others are tested against brute force.
ORACLE: dict[str, str] = {"op1_quotation_linking": quotes.sql(mails=True), "op2_license_scan": licenses.sql(), "op11_delta_lloyd_codes": delta_lloyd.sql(), "op12_block_norm_clusters": block_norms.sql()}
