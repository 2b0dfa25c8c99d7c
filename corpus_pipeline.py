"""From raw documents to token files: toxicity, near copies, benchmark passages, mixing, tokens.

Each stage gets the documents its predecessor kept and returns the columns of documents; the last returns a row for each document in the token files. run() writes each
stage's result as Parquet in the shared folder, reads it back and deletes what came before, so a lost executor costs at most one stage.

Defined results, for every stage: columns other than doc_id, text and source are carried along unread, whatever their names and types; null or repeated doc_ids are
separate rows; an empty table stays empty; texts of any length are read whole. What null and wordless texts and ties mean is said stage by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabsieve.llm import common, op3_toxicity, op5_tokens, op7_minhash, op8_mix, op10_decontaminate


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents predicted toxic; the classifier learns from the labels of sf_dir. Null and empty texts are scored as texts without words, equal texts alike; a score of 0.5 is toxic."""
    return op3_toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near copies (five-word shingles, similarity of 0.8 or more): the smallest doc_id, null last, then the smallest row. Null and wordless texts are alike with nothing and stay."""
    return op7_minhash.deduplicate(docs, shingle=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of benchmark, copied or edited. Null and wordless texts hold none and stay."""
    return op10_decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out whole documents so that the sources' words come near their target weights. Null and wordless texts stay once; a null source is a source of its own."""
    return op8_mix.repeat_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files and read them back: doc_id, start, n_tokens, ids_crc32. A null text is written as the end id alone; repeated rows are separate entries."""
    import public_tokenizers

    return op5_tokens.token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Classifiers, hashes and token files can't be expressed in SQL; tests/llm/test_pipeline.py follows each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = common.tables_made()
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), name)
        common.sweep(docs, since)  # the stage's own tables and its input
    return docs
