"""A corpus pipeline of five stages: quality, lines, near duplicates, secrets, packing.

Each stage takes the rows that the stage before kept, as written; all but the
last return the columns of documents. ``run`` applies them in order, with the
rows between two stages written to the shared folder and read again. Every stage
takes null, empty and very long texts, rows that repeat (each is a row of its own,
but for what near duplicates and repeated lines say), null ids and empty tables
(which stay empty); columns other than those of documents are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _like(docs: DataFrame, source: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now, in the types of the stage's input."""
    kinds = dict(source.dtypes)
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*[F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null texts are scored as empty ones; a tie with the threshold stays."""
    from triadic.llm.quality import accepted

    return accepted(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that had lines and has none left but blank ones goes as well. Of equal lines the one of the smallest doc_id stays (null first)."""
    from triadic.llm.line_dedup import dedup_lines

    d = dedup_lines(docs, percent=80, least_chars=1)
    return _like(d.where((F.col("n_removed") == 0) | (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id, with all rows that repeat it. Documents without words or id stay."""
    from triadic.llm.ngram_join import near_duplicates

    groups = near_duplicates(docs, percent=80, n=5)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    few = gone.limit(500_001).count() <= 500_000
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, every row by itself. Null stays null."""
    from triadic.llm.secrets import redact

    return _like(redact(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of sequences of 1024 tokens. A null or empty text is one piece of one token."""
    import public_tokenizers

    from triadic.llm.packing import pack

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), max_tokens=1024, end_id=2)


STAGES = [("quality", quality), ("lines", line_dedup), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: Tokenizing, scores and edited texts are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triadic.llm.common import Scratch

    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs)
    return docs
