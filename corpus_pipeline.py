"""The training-data pipeline: rules, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read
again as the next one's documents. All stages but the last return the columns of their input.

Defined cases. Null, empty and short texts have no ten words: the rules drop them. Null ids stay through the dedup, are
sampled by the hash of an empty id and come first in the token files. Rows that share an id are one document to the dedup: they
stay or go together. Of documents that tie in a group, the least id stays. Null languages and sources are values of their
own to the mixing. Texts of any length pass whole. An empty table passes through all stages; extra columns stay, whatever
they are called."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillwise.functions.materialize import materialize_table
from tillwise.llm.decontaminate import drop_contaminated
from tillwise.llm.minhash import drop_near_duplicates
from tillwise.llm.mixing import mix
from tillwise.llm.quality_rules import keep_good
from tillwise.llm.token_output import read_tokens, write_tokens


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rule or the learned decision list rejects."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the least id, of each group of near-duplicates (similarity 0.8 or more). 36 bands of 5 miss a
    pair at 0.8 with probability (1 - 0.8**5)**36 < 1e-6, for as many coordinates as the 30 bands of 6."""
    return drop_near_duplicates(docs, percent=80, bands=36, rows=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, or a large part of one, up to a few edits."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by the raked probabilities of their cells."""
    return mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what is read back from them."""
    return read_tokens(write_tokens(docs)).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("quality rules", quality_rules), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination),
          ("mixing sources", mixing), ("token output", token_output)]

#: SQL can express neither the learned rules, nor the signatures, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; tables in between go to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize_table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
