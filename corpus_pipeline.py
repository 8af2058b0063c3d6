"""From raw documents to token ids: five stages, each written as Parquet and read by the next.

Rejected toxic documents go; one document of each near-duplicate group stays; documents that
hold benchmark windows go; secrets are masked; what is left is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelspark.llm.bpe import encode_documents
from pixelspark.llm.decontamination import contamination
from pixelspark.llm.jaccard import jaccard_components
from pixelspark.llm.scratch import Scratch
from pixelspark.llm.secrets_scan import redact
from pixelspark.llm.toxicity import fit_labelled, score


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7."""
    model = fit_labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).where("score < 0.7").drop("score")


def keyed(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """The documents with a key ``__row`` of each row's own, the same in every use.

    Rows of a Parquet table have one already: their file (64 bits of its path's hash) and place in it.
    Other rows are numbered and written.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            return docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")).alias("__row"))
        except AnalysisException:
            pass  # not Parquet
    return Scratch(spark, name).keep(docs.withColumn("__row", F.monotonically_increasing_id()))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies; documents without words stay.

    That with the smallest id stays, of equal ids the first row; rows without an id come last.  Every row
    is judged by its own text, whatever other rows have its id or none.
    """
    rows = keyed(spark, docs, "rows")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row").alias("id")
    comps = jaccard_components(rows.select(place, "text"), id_col="id")
    # written first: Spark sees its size, and sends a small one to the texts instead of dealing the texts out
    gone = Scratch(spark, "near-copies").keep(comps.where("id <> component_id").select("id.__row"))
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark window, each judged by its own text."""
    rows = keyed(spark, docs, "rows")
    found = contamination(rows.select("__row", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__row")
    gone = Scratch(spark, "contaminated").keep(found.where("contaminated").select("__row"))
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind; ``n_chars`` follows the text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their digests."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("byte_bpe", encode),
]

#: No SQL expresses the learned classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
