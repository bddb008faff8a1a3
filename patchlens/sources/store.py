"""The element store: versioned tables of elements, catalog and keyword index.

Every save writes folders of its own, `<table>/save=<id>`, and last of all one row in
`commits`. Readers look at committed saves only and take the latest one of each framework,
so they never see elements, catalog and index of different saves, and a save that breaks
off, or runs while others read, is invisible. Older folders stay until the store's owner
removes them.

Postings and (term, chunk) rows are partitioned by framework and bucket of the term, grams
by bucket of the gram, and sorted by them inside; a lookup reads the buckets it asks for.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from patchlens.operators.extract import ELEMENT_COLUMNS
from patchlens.operators.index import KeywordIndex, bucket_of, framework_catalog, grams, postings, term_chunks, vocabulary

BUCKET_ELEMENTS = 4_096  # elements of a framework for each of its buckets
MOST_BUCKETS = 256

ELEMENT_TYPE = (
    "struct<type:string,name:string,package:string,file_path:string,line:int,signature:string,doc:string,"
    "body:string,receiver:string,imports:array<string>,references:array<string>>"
)
DOCUMENT_TYPE = (
    f"name string, repo_url string, local_path string, element_count bigint, packages array<string>, elements array<{ELEMENT_TYPE}>"
)


def _write(df: DataFrame, path: str, by: list[str], sort: list[str]) -> None:
    # Rebalancing by the partition columns writes few full files for each of them, and
    # still splits one that is too large for one task.
    df.hint("rebalance", *by).sortWithinPartitions(*by, *sort).write.partitionBy(*by).parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, with framework names as text whatever they look like; None if there is none."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        return None
    typed = StructType([StructField(f.name, StringType() if f.name in ("framework", "save") else f.dataType) for f in found.schema])
    return found if typed == found.schema else spark.read.schema(typed).parquet(path)


def save_frameworks(elements: DataFrame, path: str, repo_url: Column | None = None, local_path: Column | None = None) -> str:
    """Replace the given frameworks in the store, all tables at once; others stay. Returns the id of the save.

    `elements` needs element_id (see numbered_elements) and may hold many frameworks; it
    is computed once. The keyword index is written with it, so loading builds nothing.
    """
    spark, save = elements.sparkSession, f"s{uuid.uuid4().hex}"

    def place(table: str) -> str:
        return f"{path}/{table}/save={save}"

    _write(elements, place("elements"), ["framework"], ["element_id"])
    stored = _read(spark, place("elements"))
    if stored is None:
        return save  # nothing to replace
    buckets = F.least(F.lit(MOST_BUCKETS), F.ceil(F.col("element_count") / BUCKET_ELEMENTS)).cast("int")
    catalog = framework_catalog(stored).withColumn("repo_url", F.lit("") if repo_url is None else repo_url)
    catalog = catalog.withColumn("local_path", F.lit("") if local_path is None else local_path).withColumn("buckets", buckets)
    catalog.write.parquet(place("catalog"))
    sizes = _read(spark, place("catalog")).select("framework", "buckets")
    rows = postings(stored).join(sizes, "framework").withColumn("bucket", bucket_of(F.col("term_key"), F.col("buckets"))).drop("buckets")
    _write(rows, place("postings"), ["framework", "bucket"], ["term_key"])
    written = _read(spark, place("postings"))
    chunks = term_chunks(written).join(sizes, "framework").withColumn("bucket", bucket_of(F.col("term_key"), F.col("buckets"))).drop("buckets")
    _write(chunks, place("term_chunks"), ["framework", "bucket"], ["term_key"])
    _write(vocabulary(written), place("vocabulary"), ["framework"], ["key"])
    parts = grams(_read(spark, place("vocabulary"))).join(sizes, "framework")
    _write(parts.withColumn("bucket", bucket_of(F.col("gram"), F.col("buckets"))).drop("buckets"), place("grams"), ["framework", "bucket"], ["gram"])
    commit(spark, path, save)
    return save


def commit(spark: SparkSession, path: str, save: str) -> None:
    """Make a save visible: one row in one file, so readers see it whole or not at all."""
    commits = _read(spark, f"{path}/commits")
    last = 0 if commits is None else commits.agg(F.max("number")).first()[0] or 0
    spark.range(1).select(F.lit(last + 1).cast("bigint").alias("number"), F.current_timestamp().alias("committed_at")).coalesce(1).write.parquet(f"{path}/commits/save={save}")


def load_catalog(spark: SparkSession, path: str) -> DataFrame | None:
    """(framework, element_count, packages, repo_url, local_path, buckets, save) as of the last committed save of each framework."""
    commits, catalog = _read(spark, f"{path}/commits"), _read(spark, f"{path}/catalog")
    if commits is None or catalog is None:
        return None
    names = ["element_count", "packages", "repo_url", "local_path", "buckets", "save"]
    rows = catalog.join(commits.select("save", "number"), "save")
    last = rows.groupBy("framework").agg(F.max_by(F.struct(*names), F.struct("number", "save")).alias("last"))
    return last.select("framework", *(F.col(f"last.{n}").alias(n) for n in names))


def list_frameworks(spark: SparkSession, path: str) -> DataFrame:
    """Names in order; no rows when nothing was saved yet."""
    catalog = load_catalog(spark, path)
    if catalog is None:
        return spark.createDataFrame([], "framework string")
    return catalog.select("framework").orderBy("framework")


def _saved(spark: SparkSession, path: str, name: str):
    catalog = load_catalog(spark, path)
    found = None if catalog is None else catalog.where(F.col("framework") == name).select("save", "buckets").first()
    if found is None:
        raise ValueError(f"framework not indexed: {name}")
    return found


def load_framework(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Elements of one framework, read from its own partition of its last save only."""
    return _read(spark, f"{path}/elements/save={_saved(spark, path, name).save}").where(F.col("framework") == name)


def _current(spark: SparkSession, path: str, table: str) -> DataFrame:
    last = load_catalog(spark, path)
    if last is None:
        raise ValueError("no framework indexed")
    return _read(spark, f"{path}/{table}").join(last.select("framework", "save"), ["framework", "save"], "left_semi").drop("save")


def load_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of all frameworks, of the last save of each."""
    return _current(spark, path, "elements")


def load_index(spark: SparkSession, path: str, name: str | None = None) -> KeywordIndex:
    """The stored index of one framework, whose lookups read single buckets, or of all."""
    tables = ["postings", "term_chunks", "vocabulary", "grams"]
    if name is None:
        return KeywordIndex(*(_current(spark, path, t) for t in tables))
    last = _saved(spark, path, name)
    found = [_read(spark, f"{path}/{t}/save={last.save}") for t in tables]
    return KeywordIndex(*(t.where(F.col("framework") == name) for t in found), last.buckets)


def import_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Elements out of nested framework documents, without element_id.

    By default each file is one (indented) document; with `lines` each line is a record,
    as export_documents writes them: a document, or one element beside its framework's name.
    """
    documents = spark.read.schema(f"{DOCUMENT_TYPE}, element {ELEMENT_TYPE}").json(path, multiLine=not lines)
    found = documents.select(F.col("name").alias("framework"), F.explode(F.concat(F.coalesce("elements", F.array()), F.array("element"))).alias("e"))
    return found.where("e IS NOT NULL").select("framework", "e.*")


def export_documents(elements: DataFrame, catalog: DataFrame, path: str) -> None:
    """Frameworks as JSON lines: per framework one record with its header, and one per element.

    The records are the same whatever the size of a framework, and none holds more than
    one element. import_documents puts them together again.
    """
    headers = catalog.select(F.col("framework").alias("name"), "repo_url", "local_path", "element_count", "packages")
    items = elements.select(F.col("framework").alias("name"), F.struct(*ELEMENT_COLUMNS).alias("element"))
    headers.unionByName(items, allowMissingColumns=True).write.mode("overwrite").json(path)

