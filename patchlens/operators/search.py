"""Keyword search of many queries over many frameworks in one job.

Score of an element for a query, summed over the query's words with repeats:
10 per posting whose term equals the word, and 3 per posting whose term contains
the word or is contained in it. The empty word is contained in every term.

The plan has equi-joins only:

1. distinct words x distinct terms -> matching pairs, through the stored grams of the terms
   (terms that contain a word) and the windows of the words (terms inside a word);
2. (term, chunk) x words of the term -> what each word can add to an element of each chunk
   at most, and from that a bound for each query and chunk;
3. the chunks of the highest bound are scored first; the k-th best label there is the score
   to reach, and of all other chunks only those whose bound reaches it are read and scored.
   Before words meet queries the bounds are drawn once more, from the scores of the words.

Each posting meets the list of the words that match its term, so it is read once for all
queries, and a word's score is summed where the element's postings lie.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlens.functions.text import exploded_counts, query_words, text
from patchlens.operators import scan
from patchlens.operators.index import GRAM, KEY_CHARS, KeywordIndex, token_key, windows
from patchlens.operators.joins import counted_join, salt_of, salted_join, salts, spread_join
from patchlens.session import materialize

# Scores and default result sizes.
EXACT_SCORE = 10
PARTIAL_SCORE = 3
DEFAULT_LIMIT = 10
REVIEW_LIMIT = 5
TOOL_LIMIT = 3

FEW = 128  # words of a framework that are looked for in every distinct term
HEAD = 6  # characters of a term that are looked up inside words
WORDS_PER_ROW = 32_768
BROADCAST_PAIRS = 4_000_000  # pairs of term and word that are sent to all tasks
FIRST_CHUNKS, FIRST_LABELS = 32, 3  # a query starts with that many chunks at most, and with that many times the labels it asks for


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, framework, word, qtf) with counts made inside each query's row."""
    return _counted_words(queries).select("query_id", "framework", "word", "qtf")


def _counted_words(queries: DataFrame) -> DataFrame:
    rows = queries.select("query_id", "framework", F.sort_array(query_words("query")).alias("words"))
    rows = rows.withColumn("n_empty", F.size(F.filter("words", lambda w: w == "")).cast("bigint"))
    return exploded_counts(rows, "words", ["query_id", "framework", "n_empty"]).withColumnRenamed("n", "qtf")


def _asked_grams(index: KeywordIndex, words: DataFrame) -> DataFrame:
    """(framework, gram, word_id, word): the grams to look each word up by.

    A word of at least GRAM characters is looked up by the rarest of its grams, a shorter
    one by all grams that start with it.
    """
    c = F.col
    keys = ["framework", "word_id", "word"]
    rows = words.where(F.length("word") >= GRAM).select(*keys, F.explode(windows(c("word"), GRAM)).alias("gram")).where(F.length("gram") == GRAM)
    counts = index.looked_up("grams", rows, "gram").groupBy("framework", "gram").agg(F.count("*").alias("n"))
    found = rows.join(counts, ["framework", "gram"])  # a word with a gram that no term has would find nothing by it
    some = rows.groupBy(*keys).agg(F.count("*").alias("grams"))
    rarest = found.groupBy(*keys).agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count("*").alias("known")).join(some, keys)
    looked = rarest.where("known = grams").select("framework", "gram", "word_id", "word")
    short = words.where(F.length("word") < GRAM).select(*keys)
    if short.isEmpty():
        return looked
    # Only distinct grams meet short words, by their starts of one and two characters.
    known = index.grams.select("framework", "gram").distinct()
    starts = known.select("framework", "gram", F.explode(F.array_distinct(F.array(F.substring("gram", 1, 1), F.substring("gram", 1, 2)))).alias("word"))
    return looked.unionByName(starts.join(short, ["framework", "word"]).select(*looked.columns))


def terms_that_contain(index: KeywordIndex, words: DataFrame) -> DataFrame:
    """(framework, term_key, word_id) of all terms that hold a word, the word itself left out; words as in matching_pairs, none empty."""
    few = _few_words(words)
    if few is None:
        return _found_by_grams(index, words)
    found = _found_in_terms(index, few)
    others = words.join(few.select("word_id"), "word_id", "left_anti")
    return found if others.isEmpty() else found.unionByName(_found_by_grams(index, others))


def _few_words(words: DataFrame) -> DataFrame | None:
    """All words if no framework has more than FEW, else all that are shorter than a gram if these are as few, else None."""
    is_short = F.length("word") < GRAM
    counts = words.groupBy("framework").agg(F.count("*").alias("n"), F.count_if(is_short).alias("short"))
    most = counts.agg(F.max("n"), F.max("short")).first()
    if (most[0] or 0) <= FEW:
        return words
    return words.where(is_short) if 0 < most[1] <= FEW else None


def _found_in_terms(index: KeywordIndex, words: DataFrame) -> DataFrame:
    """terms_that_contain by a look into every distinct term, for at most FEW words of a framework: no grams are needed."""
    lists = words.groupBy("framework").agg(F.collect_list(F.struct("word_id", "word")).alias("words"))
    met = index.vocabulary.join(F.broadcast(lists), "framework").select("framework", F.col("key").alias("term_key"), "text", F.explode("words").alias("w"))
    return met.where(F.contains("text", "w.word") & (F.col("text") != F.col("w.word"))).select("framework", "term_key", "w.word_id")


def _found_by_grams(index: KeywordIndex, words: DataFrame) -> DataFrame:
    asked = materialize(_asked_grams(index, words), "asked-grams")
    rows = spread_join(index.looked_up("grams", asked, "gram").select("framework", "gram", "key"), asked, ["framework", "gram"], ["key"])
    is_text = F.length("key") <= KEY_CHARS
    # More than one gram of a term may start with a short word.
    whole = rows.where(is_text & (F.col("key") != F.col("word")) & F.contains("key", "word")).drop("gram")
    once = whole.where(F.length("word") >= GRAM).unionByName(whole.where(F.length("word") < GRAM).distinct())
    # A long term is known by its digest here; its text comes from the vocabulary.
    texts = index.vocabulary.where(F.length("text") > KEY_CHARS)
    long_terms = rows.where(~is_text).drop("gram").distinct().join(texts, ["framework", "key"]).where(F.contains("text", "word") & (F.col("text") != F.col("word")))
    found = [x.select("framework", F.col("key").alias("term_key"), "word_id") for x in (once, long_terms)]
    return found[0].unionByName(found[1])


def terms_inside(index: KeywordIndex, words: DataFrame) -> DataFrame:
    """(framework, term_key, word_id, equal) of all terms that a word holds, itself included; words as in matching_pairs, none empty.

    Each place of a word gives its next KEY_CHARS characters and their starts of up to
    HEAD characters, so rows grow with the length of a word and not with its square. The
    empty term is inside every word.
    """
    c = F.col
    places = words.select("framework", "word_id", "key", F.explode(windows(c("word"), KEY_CHARS)).alias("window"))
    heads = F.transform(F.sequence(F.lit(1), F.least(F.lit(HEAD), F.length("window"))), lambda n: F.substr("window", F.lit(1), n))
    starts = places.select("framework", "word_id", c("key").alias("word_key"), "window", F.explode(heads).alias("head"))
    nothing = words.select("framework", "word_id", c("key").alias("word_key"), F.lit("").alias("window"), F.lit("").alias("head"))
    terms = index.vocabulary.select("framework", "key", "text", F.substring("text", 1, HEAD).alias("head"))
    met = spread_join(terms, starts.unionByName(nothing), ["framework", "head"], ["key"])
    equal = (c("key") == c("word_key")).alias("equal")
    short = met.where((F.length("text") <= KEY_CHARS) & F.startswith("window", "text")).select("framework", "key", "word_id", equal).distinct()
    # Of a long term the window proves the first KEY_CHARS characters only.
    likely = met.where((F.length("text") > KEY_CHARS) & (F.substring("text", 1, KEY_CHARS) == c("window"))).select("framework", "key", "word_id", equal).distinct()
    longer = (
        likely.join(index.vocabulary.where(F.length("text") > KEY_CHARS), ["framework", "key"])
        .join(words.where(F.length("word") > KEY_CHARS).select("word_id", "word"), "word_id")
        .where(F.contains("word", "text")).select(*short.columns)
    )
    return short.unionByName(longer).withColumnRenamed("key", "term_key")


def matching_pairs(index: KeywordIndex, words: DataFrame) -> DataFrame:
    """(framework, term_key, word_id, weight) for distinct terms and distinct words (framework, word_id, key, word) of each framework.

    Equal texts weigh 13, other matches 3. The empty word would match every term;
    its partial score is added elsewhere, so here it only meets the empty term.
    """
    real_words = words.where("word <> ''")
    inside = terms_inside(index, real_words)
    inside = inside.withColumn("weight", F.when(F.col("equal"), EXACT_SCORE + PARTIAL_SCORE).otherwise(PARTIAL_SCORE)).drop("equal")
    around = terms_that_contain(index, real_words).withColumn("weight", F.lit(PARTIAL_SCORE))
    empty = index.vocabulary.where("text = ''").select("framework", F.col("key").alias("term_key")).join(words.where("word = ''").select("framework", "word_id"), "framework")
    return inside.unionByName(around).unionByName(empty.withColumn("weight", F.lit(EXACT_SCORE)))


# --- bounds and scores --------------------------------------------------------------------


@dataclass(frozen=True)
class Asked:
    """What a search has found out before it reads postings, all stored."""

    words: DataFrame  # query_id, framework, word_id, qtf, n_empty
    term_words: DataFrame  # framework, term_key, words: array of (word_id, weight)
    small: bool  # whether term_words holds at most BROADCAST_PAIRS pairs
    heavy: DataFrame | None  # framework, term_key, _salts: terms with very many postings, if term_words is not small
    totals: DataFrame  # framework, chunk, max_total, labels


def ask(index: KeywordIndex, queries: DataFrame) -> Asked:
    """Words of the queries and the terms they match."""
    c = F.col
    counted = _counted_words(queries)
    asked = counted.select("framework", "word").distinct().select("*", token_key(c("word")).alias("key"), F.monotonically_increasing_id().alias("word_id"))
    asked = materialize(asked, "words")
    # A term's words are a list, in parts of bounded size, so each posting is read once for all of them.
    parts = -(-asked.count() // WORDS_PER_ROW)
    lists = matching_pairs(index, asked).groupBy("framework", "term_key", F.pmod(F.xxhash64("word_id"), F.lit(max(parts, 1))).alias("part")).agg(
        F.collect_list(F.struct("word_id", c("weight").cast("bigint").alias("weight"))).alias("words")
    )
    lists = materialize(lists.select("framework", "term_key", "words"), "term-words")
    n_pairs = lists.agg(F.sum(F.size("words"))).first()[0] or 0
    words = spread_join(counted, asked.select("framework", "word", "word_id"), ["framework", "word"], ["query_id"])
    words = materialize(words.select("query_id", "framework", "word_id", "qtf", "n_empty"), "query-words")
    totals = index.element_keys.groupBy("framework", "chunk").agg(F.max("total").alias("max_total"), F.approx_count_distinct("label").alias("labels"))
    small = n_pairs <= BROADCAST_PAIRS
    return Asked(words, lists, small, None if small else materialize(index.heavy_terms(), "heavy-terms"), materialize(totals, "chunk-totals"))


def _matched(rows: DataFrame, asked: Asked, spread_by: list[str]) -> DataFrame:
    """rows (framework, term_key, ...) once for each word that matches the term, with word_id and weight.

    The lists are sent to all tasks if they are few: rows of an element then stay together,
    and its words are summed before anything is shuffled. Otherwise they are joined by term,
    and repeated only for terms with very many postings.
    """
    keys = ["framework", "term_key"]
    met = rows.join(F.broadcast(asked.term_words), keys) if asked.small else salted_join(rows, asked.term_words, keys, spread_by, asked.heavy)
    return met.select(*(n for n in rows.columns if n != "term_key"), F.explode("words").alias("w")).select("*", "w.word_id", "w.weight").drop("w")


def chunk_bounds(index: KeywordIndex, asked: Asked) -> DataFrame:
    """(framework, word_id, chunk, most): no element of the chunk scores more for the word.

    Every posting adds 3 at most, but those of the equal term, which add 10 more; and no
    term adds more than its greatest count in the chunk.
    """
    rows = index.most_in_chunks(asked.term_words, asked.small).select("framework", "term_key", "chunk", "max_tf")
    sums = _matched(rows, asked, ["chunk"]).groupBy("framework", "word_id", "chunk").agg(
        F.sum(F.col("weight") * F.col("max_tf")).alias("by_terms"),
        F.max(F.when(F.col("weight") >= EXACT_SCORE, F.col("max_tf")).otherwise(0)).alias("exact"),
    )
    by_size = PARTIAL_SCORE * F.col("max_total") + EXACT_SCORE * F.col("exact")
    return sums.join(asked.totals, ["framework", "chunk"]).select("framework", "word_id", "chunk", F.least("by_terms", by_size).alias("most"))


def query_bounds(asked: Asked, bounds: DataFrame) -> DataFrame:
    """(query_id, framework, chunk, bound): no element of the chunk scores more for the query. Chunks without a match have no row."""
    met = spread_join(asked.words, bounds, ["framework", "word_id"], ["query_id"])
    sums = met.groupBy("query_id", "framework", "chunk", "n_empty").agg(F.sum(F.col("qtf") * F.col("most")).alias("most"))
    empty = PARTIAL_SCORE * F.col("n_empty") * F.col("max_total")
    return sums.join(asked.totals, ["framework", "chunk"]).select("query_id", "framework", "chunk", "labels", (F.col("most") + empty).alias("bound"))


def word_scores(index: KeywordIndex, asked: Asked, chunks: DataFrame) -> DataFrame:
    """(framework, chunk, word_id, element_id, word_score) of all asked words in the given chunks (query_id, framework, chunk)."""
    places = chunks.select("framework", "chunk").distinct()
    read = index.looked_up("postings", asked.term_words, "term_key").join(places, ["framework", "chunk"], "left_semi")
    rows = _matched(read.select("framework", "term_key", "chunk", "element_id", "tf"), asked, ["element_id"])
    return rows.groupBy("framework", "chunk", "word_id", "element_id").agg(F.sum(F.col("weight") * F.col("tf")).alias("word_score"))


def query_scores(index: KeywordIndex, asked: Asked, scored_words: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, framework, element_id, label, score) of the elements of the given chunks with a matching word."""
    c = F.col
    grid = spread_join(asked.words, chunks, ["query_id", "framework"], ["word_id"])
    grid = grid.select("framework", "chunk", "word_id", "query_id", "qtf", "n_empty").repartition("framework", "chunk")
    sums = (
        grid.join(scored_words.repartition("framework", "chunk"), ["framework", "chunk", "word_id"])
        .groupBy("framework", "chunk", "query_id", "n_empty", "element_id").agg(F.sum(c("qtf") * c("word_score")).alias("word_score"))
    )
    keys = index.element_keys.repartition("framework", "chunk")
    return sums.join(keys, ["framework", "chunk", "element_id"]).select(
        "query_id", "framework", "element_id", "label", (c("word_score") + PARTIAL_SCORE * c("n_empty") * c("total")).alias("score")
    )


def empty_word_leaders(index: KeywordIndex, queries: DataFrame, limit: int) -> DataFrame:
    """Elements that can reach the top through empty words alone.

    An empty word adds the same multiple of `total` to every element, so of the
    elements without any other match only the `limit` labels with the largest
    totals of a framework can be among its best; all others need not be scored.
    """
    c = F.col
    best = (
        index.element_keys.groupBy("framework", "label")
        .agg(F.max(F.struct("total", (-c("element_id")).alias("neg_id"))).alias("best"))
        .select("framework", "label", c("best.total").alias("total"), (-c("best.neg_id")).alias("element_id"))
    )
    order = Window.partitionBy("framework").orderBy(c("total").desc(), "element_id")
    leaders = best.withColumn("rank", F.row_number().over(order)).where(c("rank") <= limit).drop("rank")
    spread = 16
    leaders = leaders.withColumn("salt", F.explode(salts(F.lit(spread))))
    asking = (
        queries.select("query_id", "framework", F.size(F.filter(query_words("query"), lambda w: w == "")).alias("n_empty"))
        .where("n_empty > 0")
        .withColumn("salt", salt_of(["query_id"], F.lit(spread)))
    )
    return asking.join(leaders, ["framework", "salt"]).select(
        "query_id", "framework", "element_id", "label",
        (PARTIAL_SCORE * c("n_empty").cast("bigint") * c("total")).alias("score"),
    )


def best_labels(scored: DataFrame) -> DataFrame:
    """(query_id, framework, label, score, element_id): the best element of each label, the smaller id of equal ones."""
    best = F.max(F.struct("score", (-F.col("element_id")).alias("neg_id"))).alias("best")
    rows = scored.groupBy("query_id", "framework", "label").agg(best)
    return rows.select("query_id", "framework", "label", F.col("best.score").alias("score"), (-F.col("best.neg_id")).alias("element_id"))


def ranked(rows: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    """The first `limit` rows of each query with their rank, cut before the shuffle."""
    place = F.row_number().over(Window.partitionBy("query_id", "framework").orderBy(*order))
    return rows.withColumn("rank", place).where(F.col("rank") <= limit)


def first_chunks(bounds: DataFrame, limit: int) -> DataFrame:
    """(query_id, framework, chunk): the chunks of the highest bound, up to some more labels than are asked for."""
    top = ranked(bounds, FIRST_CHUNKS, F.desc("bound"), "chunk")
    order = Window.partitionBy("query_id", "framework").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("labels").over(order), F.lit(0))
    return top.withColumn("before", before).where(F.col("before") < FIRST_LABELS * limit).select("query_id", "framework", "chunk")


def within_reach(bounds: DataFrame, reach: DataFrame) -> DataFrame:
    """(query_id, framework, chunk) of the bounds that are at least the score to reach, where there is one."""
    rows = spread_join(bounds, reach, ["query_id", "framework"], ["chunk"], "left")
    return rows.where("reach IS NULL OR bound >= reach").select("query_id", "framework", "chunk")


def scores(index: KeywordIndex, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, framework, label, score, element_id) of labels by matching words, whole for every label among the `limit` best.

    Elements matched by empty words only are not part of it; `empty_word_leaders` gives
    those that can win. What several steps read is written to the shared folder.
    """
    c = F.col
    names = ["query_id", "framework", "chunk"]
    asked = ask(index, queries)
    bounds = materialize(query_bounds(asked, chunk_bounds(index, asked)), "chunk-bounds")
    first = materialize(first_chunks(bounds, limit), "first-chunks")
    found = materialize(best_labels(query_scores(index, asked, word_scores(index, asked, first), first)), "first-scores")
    reach = materialize(ranked(found, limit, F.desc("score"), "element_id").where(c("rank") == limit).select("query_id", "framework", c("score").alias("reach")), "reach")
    others = materialize(within_reach(bounds.join(first, names, "left_anti"), reach), "other-chunks")
    if others.isEmpty():
        return found
    scored = materialize(word_scores(index, asked, others), "word-scores")
    closer = query_bounds(asked, scored.groupBy("framework", "word_id", "chunk").agg(F.max("word_score").alias("most")))
    open_ = materialize(within_reach(closer.join(others, names, "left_semi"), reach), "open-chunks")
    return best_labels(found.unionByName(query_scores(index, asked, scored, open_).select(*found.columns)))


def search(index: KeywordIndex, queries: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The best elements of each query: (query_id, framework, rank, element_id, score).

    `queries` is (query_id, framework, query) with a unique query_id. Equal
    package.name labels are made distinct first, keeping the best element; ties
    go to the smaller element_id. A limit of zero or less means 10.
    """
    limit = limit if limit > 0 else DEFAULT_LIMIT
    asking = None if index.source is None else scan.Asking.of(index.source, queries)
    if asking is not None:
        labels = best_labels(scan.best_labels(index.source, asking, limit, EXACT_SCORE, PARTIAL_SCORE))
    else:
        found = scores(index, queries, limit)
        leaders = empty_word_leaders(index, queries, limit)
        labels = best_labels(found.unionByName(leaders.select(*found.columns)))
    best = ranked(labels, limit, F.desc("score"), "element_id")
    return best.select("query_id", "framework", F.col("rank").cast("bigint").alias("rank"), "element_id", "score")


def search_elements(elements: DataFrame, index: KeywordIndex, queries: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """`search` joined back to the element rows it found.

    The hits are written first and only the elements among them are read in full;
    an element that very many queries find is spread over tasks.
    """
    found = materialize(search(index, queries, limit), "found")
    keys = ["framework", "element_id"]
    wanted = elements.join(found.select(*keys).distinct(), keys, "left_semi")
    return counted_join(found, wanted, keys, ["query_id"])


ENTRIES_TYPE = "array<struct<type:string,package:string,name:string,doc:string,body:string>>"


def searched_contexts(
    inputs: DataFrame, elements: DataFrame, index: KeywordIndex, limit: int = REVIEW_LIMIT, query: Column | None = None, body: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """`inputs` with `query_id`, null without framework, and (query_id, context) of the texts for which something was found.

    One search per framework and text, however many rows share it; query_id names both.
    """
    c = F.col
    asking = inputs.withColumn("_query", text("diff") if query is None else query)
    asking = asking.withColumn("query_id", F.when(text("framework") != "", F.concat(c("framework"), F.lit("/"), F.sha2("_query", 256))))
    queries = asking.where("query_id IS NOT NULL").select("query_id", "framework", c("_query").alias("query"))
    found = search_elements(elements, index, queries.dropDuplicates(["query_id", "framework"]), limit).select(
        "query_id",
        F.struct("rank", "type", "package", "name", "doc", (c("body") if body is None else body).alias("body")).alias("e"),
    )
    context = found.groupBy("query_id").agg(F.sort_array(F.collect_list("e")).alias("es")).select(
        "query_id",
        F.transform(
            "es",
            lambda e: F.struct(
                e["type"].alias("type"), e["package"].alias("package"), e["name"].alias("name"), e["doc"].alias("doc"), e["body"].alias("body")
            ),
        ).alias("context"),
    )
    return asking.drop("_query"), context


def attach_context(
    inputs: DataFrame, elements: DataFrame, index: KeywordIndex, limit: int = REVIEW_LIMIT,
    query: Column | None = None, body: Column | None = None, made: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """`inputs` with `context`, the best elements of its framework in rank order.

    The query is the diff unless another column is given. A row without framework,
    or whose framework has no index, gets an empty array. At most `limit` elements
    are gathered per query, and a query text that many rows share is searched once.
    `made` makes another value out of the array; it is made once per search, so rows
    that share one carry no texts they do not need.
    """
    made = made or (lambda context: context)
    asking, context = searched_contexts(inputs, elements, index, limit, query, body)
    asking = asking.withColumn("query_id", F.coalesce("query_id", F.lit("")))  # no search has this name
    joined = counted_join(asking, context.select("query_id", made(F.col("context")).alias("context")), ["query_id"], ["review_id", "file_no"], "left")
    return joined.withColumn("context", F.coalesce("context", made(F.array().cast(ENTRIES_TYPE)))).drop("query_id")
