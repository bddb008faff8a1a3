"""Documents to training tokens: four stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents; the
last adds the ids of the tokens. Between stages the rows are written and read again.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm import byte_bpe, mixing, near_join, toxicity
from patchlens.llm.workers import find_package
from patchlens.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
RANKS = "byte_bpe_multi_50k.tiktoken"
SHARE = 0.6  # of the tokens that reach the mixture


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. The scores are a column beside the text, so nothing is shuffled."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = toxicity.fit(docs, labels, keep=~toxicity.held_out(F.col("own")))
    scored = docs.withColumn("_score", toxicity.passages(F.col("text"), model)["score"])
    return scored.where(F.col("_score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id; documents without an id stay."""
    found = materialize(near_join.near_copies(docs), "near-copies")
    surplus = found.where("doc_id <> class_id").select("doc_id").distinct()
    kept = docs.join(surplus, "doc_id", "left_anti")
    copies = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if copies.isEmpty():
        return kept.select(*COLUMNS)
    repeated = kept.join(copies.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])  # rows that repeat an id
    return kept.join(copies.select("doc_id"), "doc_id", "left_anti").select(*COLUMNS).unionByName(repeated.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics have flattened shares of the tokens."""
    return mixing.mix(docs, share=SHARE).where("kept").select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the tokens of every document, decoded once to show that nothing is lost."""
    ranks = public_tokenizers.path(RANKS)
    made = docs.select(*COLUMNS, byte_bpe.round_trip(F.col("text"), ranks, public_tokenizers.PATTERN).alias("made"))
    same = F.col("made.bytes") == F.coalesce("text", F.lit("")).cast("binary")
    return made.select("doc_id", "lang", "source", "made.ids", F.size("made.ids").cast("bigint").alias("n_tokens"), same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: The stages train models, cluster and hash; none of that can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    find_package(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
