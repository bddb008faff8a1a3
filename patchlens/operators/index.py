"""Keyword index over code elements.

The index is a table of postings, one row per (element, term). It is built by a
narrow job: every posting of an element comes from that element's own row, so the
counts are made inside the row and nothing is shuffled.

Beside the postings stand what lookups need: the greatest count of each term in each
chunk of elements, the distinct terms, and their three-character grams.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlens.functions.text import camel_words, doc_words, exploded_counts, text
from patchlens.operators import joins
from patchlens.session import materialize

# A chunk holds elements of like size, and about this many postings at most, so one term
# never owns many postings under one join key and the largest total bounds all others well.
CHUNK_POSTINGS = 1 << 21

# Terms and words up to this length are their own key; longer ones are keyed by digest.
KEY_CHARS = 64

GRAM = 3


def token_key(token: Column) -> Column:
    return F.when(F.length(token) <= KEY_CHARS, token).otherwise(F.concat(F.lit("\u0001"), F.sha2(token, 256)))


def chunk_of(element_id: str = "element_id", total: str = "total") -> Column:
    """Chunk number: the size class (half octaves of the total), then blocks of ids that shrink as the size grows."""
    size = f"CAST(floor(2 * log2(greatest({total}, 1))) AS BIGINT)"
    block = f"greatest(1L, shiftright({CHUNK_POSTINGS}L, CAST({size} / 2 AS INT) + 1))"
    return F.expr(f"{size} * {1 << 52}L + pmod({element_id} div {block}, {1 << 52}L)")


def element_terms(name: Column, package: Column, kind: Column, doc: Column) -> Column:
    """All postings of one element, repeats included."""
    return F.concat(
        F.array(F.lower(text(name))),
        F.transform(camel_words(name), F.lower),
        F.array(F.lower(text(package)), text(kind)),
        doc_words(doc),
    )


def postings(elements: DataFrame) -> DataFrame:
    """(framework, term, term_key, chunk, element_id, label, tf, total, is_first), one row per element and term.

    `total` is the element's number of postings and `label` its package.name, the
    unit in which search results are made distinct. `is_first` marks one posting of
    each element, so that readers get the elements without a distinct.
    """
    c = F.col
    per_element = elements.select(
        "framework",
        "element_id",
        F.concat(text("package"), F.lit("."), text("name")).alias("label"),
        F.sort_array(element_terms(c("name"), c("package"), c("type"), c("doc"))).alias("terms"),
    )
    per_element = per_element.withColumn("total", F.size("terms").cast("bigint"))
    counted = exploded_counts(per_element, "terms", ["framework", "element_id", "label", "total"])
    return counted.select(
        "framework",
        c("word").alias("term"),
        token_key(c("word")).alias("term_key"),
        chunk_of().alias("chunk"),
        "element_id",
        "label",
        c("n").alias("tf"),
        "total",
        "is_first",
    )


Table = DataFrame | Callable[[], DataFrame]


class KeywordIndex:
    """Stored tables: postings; term_chunks (framework, term_key, chunk, max_tf); vocabulary (framework, key, text, n);
    grams (framework, gram, key). A table may be given as a function that writes it, called when it is first read.

    With `buckets`, postings and term_chunks have a column `bucket` that follows from the
    term and lookups read the buckets of the asked terms only; grams have one that follows
    from the gram. `source` are the elements, if searches that need no table should read these.
    """

    def __init__(self, postings: Table, term_chunks: Table, vocabulary: Table, grams: Table, buckets: int | None = None, source: DataFrame | None = None):
        self.given = {"postings": postings, "term_chunks": term_chunks, "vocabulary": vocabulary, "grams": grams}
        self.buckets = buckets
        self.source = source

    def _table(self, name: str) -> DataFrame:
        given = self.given[name]
        return given if isinstance(given, DataFrame) else given()

    postings = cached_property(lambda self: self._table("postings"))
    term_chunks = cached_property(lambda self: self._table("term_chunks"))
    vocabulary = cached_property(lambda self: self._table("vocabulary"))
    grams = cached_property(lambda self: self._table("grams"))

    @property
    def element_keys(self) -> DataFrame:
        """(framework, element_id, label, total, chunk), one row per element."""
        return self.postings.where("is_first").select("framework", "element_id", "label", "total", "chunk")

    def looked_up(self, table: str, asked: DataFrame, key: str) -> DataFrame:
        """The table, or of a bucketed one the buckets that hold the asked keys: at most `buckets` numbers reach the driver."""
        rows = getattr(self, table)
        if self.buckets is None:
            return rows
        numbers = [r[0] for r in asked.select(bucket_of(F.col(key), F.lit(self.buckets))).distinct().collect()]
        return rows.where(F.col("bucket").isin(numbers))

    def heavy_terms(self) -> DataFrame:
        """(framework, term_key, _salts) of the terms with more than KEY_ROWS postings: how many tasks a join gives to each."""
        counts = self.vocabulary  # of a save without counts they are made
        if "n" not in counts.columns:
            counts = self.postings.groupBy("framework", F.col("term_key").alias("key")).agg(F.count("*").alias("n"))
        return counts.where(F.col("n") > joins.KEY_ROWS).select("framework", F.col("key").alias("term_key"), F.ceil(F.col("n") / joins.KEY_ROWS).alias("_salts"))

    def most_in_chunks(self, asked: DataFrame, few: bool) -> DataFrame:
        """(framework, term_key, chunk, max_tf) of the asked terms at least.

        A table that is not written yet is not written for one search: the few asked terms are counted out of the postings.
        """
        if isinstance(self.given["term_chunks"], DataFrame) or "term_chunks" in self.__dict__ or not few:
            return self.looked_up("term_chunks", asked, "term_key")
        keys = ["framework", "term_key"]
        return term_chunks(self.postings.select(*keys, "chunk", "tf").join(F.broadcast(asked.select(*keys)), keys, "left_semi"))


def bucket_of(key: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(key), buckets.cast("bigint")).cast("int")


def vocabulary(stored_postings: DataFrame) -> DataFrame:
    """(framework, key, text, n) of the distinct terms of each framework and how many postings they have."""
    counted = stored_postings.groupBy("framework", F.col("term").alias("text")).agg(F.count("*").alias("n"))
    return counted.select("framework", token_key(F.col("text")).alias("key"), "text", "n")


def term_chunks(stored_postings: DataFrame) -> DataFrame:
    return stored_postings.groupBy("framework", "term_key", "chunk").agg(F.max("tf").alias("max_tf"))


def windows(token: Column, width: int) -> Column:
    """Distinct substrings that start at each character, of the width or as long as the rest."""
    places = F.sequence(F.lit(1), F.length(token))
    return F.when(F.length(token) > 0, F.array_distinct(F.transform(places, lambda p: F.substr(token, p, F.lit(width))))).otherwise(F.array().cast("array<string>"))


def grams(terms: DataFrame) -> DataFrame:
    """(framework, gram, key) of distinct terms: one row per distinct window of GRAM characters, the shorter ones at the end included."""
    return terms.select("framework", F.explode(windows(F.col("text"), GRAM)).alias("gram"), "key")


def build_index(elements: DataFrame, scan: bool = False) -> KeywordIndex:
    """The index of these elements, each table written to the shared folder when it is first read: without a search nothing is.

    With `scan`, for a few searches whose elements are not searched again, queries that a worker can hold
    are answered by a pass over the elements (`scan.py`) and write no table either.
    """
    key = token_key(F.col("term"))  # the term itself but for long ones, so it is made again and not stored
    index = KeywordIndex(
        lambda: materialize(postings(elements).drop("term_key"), "postings").withColumn("term_key", key),
        lambda: materialize(term_chunks(index.postings), "term-chunks"),
        lambda: materialize(vocabulary(index.postings), "vocabulary"),
        lambda: materialize(grams(index.vocabulary), "grams"),
        source=elements if scan else None,
    )
    return index


def term_freq(elements: DataFrame) -> DataFrame:
    """The plain inverted index: (framework, term, element_id, tf)."""
    return postings(elements).select("framework", "term", "element_id", "tf")


def doc_tokens(elements: DataFrame) -> DataFrame:
    """Indexed comment words per element with their counts."""
    rows = elements.select("framework", "element_id", F.sort_array(doc_words("doc")).alias("words"))
    return exploded_counts(rows, "words", ["framework", "element_id"]).select(
        "framework", "element_id", F.col("word").alias("token"), "n"
    )


def framework_catalog(elements: DataFrame) -> DataFrame:
    """One row per framework: sorted distinct packages and element count.

    Two steps, so that the list step sees one row per package instead of one per
    element; a framework with a third of all elements is reduced before it meets
    in one task.
    """
    per_package = elements.groupBy("framework", text("package").alias("package")).agg(F.count("*").alias("n"))
    return per_package.groupBy("framework").agg(
        F.sum("n").alias("element_count"),
        F.sort_array(F.collect_list("package")).alias("packages"),
    )


def type_counts(elements: DataFrame) -> DataFrame:
    return elements.groupBy("framework", "type").agg(F.count("*").alias("n"))


def elements_by_type(elements: DataFrame, kind: str, limit: int = 20) -> DataFrame:
    """First elements of one type in stored order; a limit of zero or less means 20."""
    return elements.where(F.col("type") == kind).orderBy("element_id").limit(limit if limit > 0 else 20)


def elements_by_type_per_framework(elements: DataFrame, kind: str, limit: int = 20) -> DataFrame:
    """The same for every framework at once; row_number <= n is cut before the shuffle."""
    limit = limit if limit > 0 else 20
    order = Window.partitionBy("framework").orderBy("element_id")
    kept = elements.where(F.col("type") == kind).withColumn("position", F.row_number().over(order))
    return kept.where(F.col("position") <= limit)


# Naming groups, the first that fits wins.
NAME_PREFIXES = [("New", "constructor"), ("Get", "getter"), ("Set", "setter"), ("Is", "predicate"), ("Has", "predicate")]
NAME_SUFFIXES = [("Handler", "handler"), ("Service", "service"), ("Repository", "repository"), ("Error", "error")]


def naming_group(name: Column) -> Column:
    group = F.lit(None).cast("string")
    for suffix, label in reversed(NAME_SUFFIXES):
        group = F.when(name.endswith(suffix), label).otherwise(group)
    for prefix, label in reversed(NAME_PREFIXES):
        group = F.when(name.startswith(prefix), label).otherwise(group)
    return group


def element_patterns(elements: DataFrame) -> DataFrame:
    """Elements under their type and under their naming group, one row each.

    The groups stay rows keyed by `pattern` and ordered by element_id: a group may
    hold a third of all elements and is never gathered into one value.
    """
    groups = F.filter(F.array(text("type"), naming_group(text("name"))), lambda g: g.isNotNull())
    return elements.withColumn("pattern", F.explode(groups))


def pattern_counts(elements: DataFrame) -> DataFrame:
    return element_patterns(elements).groupBy("framework", "pattern").agg(F.count("*").alias("n"))
