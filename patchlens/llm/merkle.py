"""Merkle fingerprints of documents, in DataFrame operations only.

A text is cut into paragraphs (lines), and each paragraph into pieces of up to eight words.
The digest of a section covers those of its paragraphs, the root those of the sections. A
section ends behind a paragraph whose digest begins with 0 to 3, so an edit moves no border
but its own. A fingerprint is written as

    <root>:<section>/<section>/...    section: <paragraph>,<paragraph>,...    paragraph: <piece>.<piece>...

with eight hexadecimal digits a piece. Equal roots mean equal texts; where roots differ, the
first branch that differs tells where the edit begins, and the shared pieces how alike the
texts are.

Defined cases: a null text counts as empty; an empty text has one paragraph without pieces;
rows without an id come last in the order of ids, among equal ids the order is by text; a
table of one row is its own neighbour; rows of equal id and text are each kept; columns other
than id and text are dropped, so their names do not matter.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = r"[ \t]*(?:[^ \t]{1,64}[ \t]*){1,8}|[ \t]+"
BUCKET_ROWS = 4_096
MOST_BUCKETS = 4_096


def fingerprint(text: Column) -> Column:
    paragraphs = F.transform(
        F.split(text, "\n"),
        lambda p: F.struct(
            F.sha2(p, 256).alias("digest"),
            F.array_join(F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda piece: F.substring(F.sha2(piece, 256), 1, 8)), ".").alias("pieces"),
        ),
    )
    return F.transform(F.array(paragraphs), _written)[0]


def _written(paragraphs: Column) -> Column:
    def mark(p: Column) -> Column:
        return F.when(p["digest"] < "4", "/").otherwise(",")

    pieces = F.array_join(F.transform(paragraphs, lambda p: F.concat(p["pieces"], mark(p))), "")
    digests = F.array_join(F.transform(paragraphs, lambda p: F.concat(p["digest"], mark(p))), "")
    root = F.sha2(F.array_join(F.transform(F.split(digests, "/"), lambda s: F.sha2(s, 256)), ""), 256)
    return F.concat(root, F.lit(":"), pieces)


def root(print_: Column) -> Column:
    return F.substring(print_, 1, 64)


def pieces(print_: Column) -> Column:
    """The distinct pieces of a fingerprint."""
    return F.array_distinct(F.filter(F.split(F.substring(print_, 66, 1 << 30), "[/,.]"), lambda x: x != ""))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else twice the shared pieces over the pieces of both; 0 where there are none."""
    return F.transform(
        F.array(F.struct(pieces(a).alias("a"), pieces(b).alias("b"))),
        lambda x: F.when(root(a) == root(b), 1.0)
        .when(F.size(x["a"]) + F.size(x["b"]) == 0, 0.0)
        .otherwise(2.0 * F.size(F.array_intersect(x["a"], x["b"])) / (F.size(x["a"]) + F.size(x["b"]))),
    )[0]


def first_change(a: Column, b: Column) -> Column:
    """struct<section: int, paragraph: int>, from 0: the first branch in which two fingerprints differ; null if none does."""
    sections = lambda p: F.split(F.substring(p, 66, 1 << 30), "/")

    def differing(xs: Column, ys: Column) -> Column:
        return F.array_position(F.transform(F.arrays_zip(xs.alias("x"), ys.alias("y")), lambda z: ~z["x"].eqNullSafe(z["y"])), True) - 1

    def within(s: Column) -> Column:
        x, y = (F.coalesce(F.get(sections(p), s), F.lit("")) for p in (a, b))
        return F.struct(s.cast("int").alias("section"), F.greatest(differing(F.split(x, ","), F.split(y, ",")), F.lit(0)).cast("int").alias("paragraph"))

    return F.when(root(a) != root(b), F.transform(F.array(F.greatest(differing(sections(a), sections(b)), F.lit(0))), within)[0])


def bucket_of(key: Column, splits: list[int]) -> Column:
    """How many of the ascending splits are at most key, by bisection; 0 for null."""
    if not splits:
        return F.lit(0)
    powers = [1 << p for p in reversed(range(len(splits).bit_length()))]
    table = F.lit(splits)
    return F.aggregate(
        F.array(*(F.lit(p) for p in powers)),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(splits)) & (F.get(table, at + step - 1) <= key), at + step).otherwise(at),
    )


def with_next(docs: DataFrame, own: str = "doc_id", text: str = "text") -> DataFrame:
    """(own, text, next_text): the text that follows in descending order of ids, after the last the first.

    Ids are cut into ranges of even size, each sorted by itself; every range also gets the
    first row of the one that follows it. Texts are shuffled once.
    """
    rows = docs.select(F.col(own).cast("bigint").alias("own"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n = min(MOST_BUCKETS, -(-rows.count() // BUCKET_ROWS))
    splits = []
    if n > 1:
        found = rows.agg(F.percentile_approx("own", [i / n for i in range(1, n)], 10_000).alias("at")).first()["at"]
        splits = sorted(set(found or []))
    rows = rows.withColumn("bucket", bucket_of(F.col("own"), splits))
    # At most MOST_BUCKETS + 1 rows, whatever the table.
    tops = sorted((tuple(r) for r in rows.groupBy("bucket").agg(F.max("own").alias("top")).collect()), reverse=True)
    if not tops:
        return rows.select("own", "text", F.col("text").alias("next_text"))
    follows = [(top, tops[i - 1][0]) for i, (_, top) in enumerate(tops)]  # the first row of a range also ends the one before it
    ends = docs.sparkSession.createDataFrame(follows, "top bigint, into int")
    order = [F.col("own").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    from pyspark.sql import Window

    heads = (
        rows.join(F.broadcast(ends), F.col("own").eqNullSafe(F.col("top")))
        .withColumn("nth", F.row_number().over(Window.partitionBy("own").orderBy(F.xxhash64("text"), F.col("text"))))
        .where("nth = 1")
        .select("own", "text", F.col("into").alias("bucket"), F.lit(1).alias("extra"))
    )
    both = rows.select("own", "text", "bucket", F.lit(0).alias("extra")).unionByName(heads)
    ordered = Window.partitionBy("bucket").orderBy("extra", *order)
    return both.withColumn("next_text", F.lead("text").over(ordered)).where("extra = 0").select("own", "text", "next_text")


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last floor(n/2) characters replaced by the first as many of the next one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(text.substr(F.lit(1), F.length(text) - half), next_text.substr(F.lit(1), half))


def compare_with_edits(docs: DataFrame, own: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: fingerprints of the text, of its edited text and of the next one, and how alike they are."""
    rows = with_next(docs, own, text).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    prints = rows.select(
        F.col("own").alias(own),
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        fingerprint(F.col("next_text")).alias("next_fingerprint"),
    )
    a, b, c = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return prints.select(
        own, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"),
        first_change(a, b).alias("change"),
    ).select("*", "change.section", "change.paragraph").drop("change")
