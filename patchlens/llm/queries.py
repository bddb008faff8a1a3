"""One registered query per operator, each over its whole table, with SQL checks where SQL can say it."""

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm import alignment, byte_bpe, class_ngrams, hnsw, licences, merkle, mixing, near_join, prefix_trie, quality, token_counts, toxicity, warc
from patchlens.llm.workers import find_package
from patchlens.session import materialize, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORD_VOCABULARY = "word_bpe_49k.json"
ALIGNED = "byte_bpe_50k.json", "piece_bpe_32k.model"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


@query
def op1_token_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = token_counts.with_prefix_counts(docs, public_tokenizers.path(WORD_VOCABULARY), budget=2048)
    return counted.select(
        "doc_id",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        "tokens.n_tokens",
        (F.col("tokens.n_tokens") > 2048).alias("over_limit"),
        F.col("tokens.fitting").alias("fitting_chars"),
    )


@query
def op3_byte_bpe(spark, sf):
    ranks = public_tokenizers.path(BYTE_RANKS)
    made = table(spark, sf, "documents").select("doc_id", byte_bpe.round_trip(F.col("text"), ranks, public_tokenizers.PATTERN).alias("made"))
    return made.select("doc_id", "made.ids", "made.bytes").select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query
def op10_warc(spark, sf):
    folder = f"{shared_dir(spark).rstrip('/')}/patchlens/warc-{uuid.uuid4().hex}"
    materialize(warc.write_archives(table(spark, sf, "pages"), folder), "archives")
    records = warc.read_archives(spark, folder).where("not gap")
    return records.select(
        F.col("id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to")
    )


ORACLES["op10_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM f"""


@query
def op7_merkle(spark, sf):
    found = merkle.compare_with_edits(table(spark, sf, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        F.col("section").alias("edit_section"), F.col("paragraph").alias("edit_paragraph"),
    )


@query
def op6_toxicity(spark, sf):
    docs, out = table(spark, sf, "documents"), toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(docs, table(spark, sf, "labels"), keep=~toxicity.held_out(F.col("own")))
    return toxicity.score(docs, model).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size(F.filter("passages", lambda p: p["significance"] > 0)).alias("n_passages"),
    )


@query
def op9_near_join(spark, sf):
    return near_join.near_copies(table(spark, sf, "documents"))


@query
def op4_class_ngrams(spark, sf):
    scored = class_ngrams.score(table(spark, sf, "documents"), train=~class_ngrams.held_out(F.col("doc_id")))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op5_hnsw(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return hnsw.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


@query
def op2_mixing(spark, sf):
    return mixing.weigh(table(spark, sf, "documents"), share=0.5)


@query
def op11_quality(spark, sf):
    docs, out = table(spark, sf, "documents"), quality.held_out(F.col("doc_id"))
    model = quality.fit(docs, table(spark, sf, "labels"), keep=~quality.held_out(F.col("own")))
    scored = quality.score(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op12_prefix_trie(spark, sf):
    turns = prefix_trie.ordered_turns(table(spark, sf, "conversations"))
    head, source = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9, F.expr("conv_id - conv_id % 5")
    found = prefix_trie.trie(*prefix_trie.regrafted(turns, source, head, longest_head=8))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLES["op12_prefix_trie"] = """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS source, string_split(CAST(conv_id AS VARCHAR), '') AS digits, count(*) AS n FROM turns GROUP BY ALL),
heads AS (SELECT c.conv_id, source, xor(list_reduce(list_prepend(4294967295, list_transform(digits, lambda y: CAST(ascii(y) AS BIGINT))),
    lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1])), 4294967295) % 9 AS h FROM convs c, crc),
sized AS (SELECT h.*, least(h, coalesce(s.n, 0)) AS taken FROM heads h LEFT JOIN convs s ON s.conv_id = h.source),
grown AS (SELECT s.conv_id, pos, role, text FROM sized s JOIN turns t ON t.conv_id = s.source AND pos <= h
    UNION ALL SELECT s.conv_id, pos - h + taken, role, text FROM sized s JOIN turns t ON t.conv_id = s.conv_id AND pos > h),
whole AS (SELECT conv_id, list(sha256(octet_length(encode(role)) || ':' || role || text) ORDER BY pos) AS all_turns, list(octet_length(encode(text)) ORDER BY pos) AS sizes FROM grown GROUP BY conv_id),
seqs AS (SELECT conv_id, coalesce(all_turns, []) AS all_turns, coalesce(sizes, []) AS sizes FROM sized LEFT JOIN whole USING (conv_id)),
paths AS (SELECT conv_id, d AS depth, sha256(array_to_string(all_turns[:d], '')) || '-' || d AS node, d = len(all_turns) AS last, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size
    FROM (SELECT *, unnest(range(len(all_turns) + 1)) AS d FROM seqs)),
found AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM paths GROUP BY node, depth),
up AS (SELECT f.*, p.node AS parent FROM found f LEFT JOIN paths p ON p.conv_id = f.conv_id AND p.depth = f.depth - 1),
kids AS (SELECT parent, count(*) AS n FROM up WHERE parent IS NOT NULL GROUP BY parent),
nodes AS (SELECT u.*, coalesce(k.n, 0) AS n_children FROM up u LEFT JOIN kids k ON k.parent = u.node),
sums AS (SELECT p.node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, r.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN nodes r ON r.node = n.parent"""


@query
def op13_alignment(spark, sf):
    paths = public_tokenizers.path(ALIGNED[0]), public_tokenizers.path(ALIGNED[1])
    found = alignment.correspondences(table(spark, sf, "documents"), *paths)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op8_licences(spark, sf):
    docs = table(spark, sf, "documents")
    return licences.scan(docs, licences.fit(docs))


_PIECES = "list_distinct(list_filter(string_split_regex({p}[66:], '[/,.]'), lambda y: y <> ''))"
_NEAR = """CASE WHEN left(a, 64) = left({o}, 64) THEN 1.0 WHEN len(pa) + len(p{o}) = 0 THEN 0.0
    ELSE 2.0 * len(list_intersect(pa, p{o})) / (len(pa) + len(p{o})) END"""
_FIRST = "coalesce(list_filter(range(1, greatest(len({x}), len({y})) + 1), lambda i: {x}[i] IS DISTINCT FROM {y}[i])[1] - 1, 0)"
ORACLES["op7_merkle"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), (SELECT t FROM d ORDER BY doc_id DESC LIMIT 1)) AS nx FROM d),
e AS (SELECT doc_id, t, nx, left(t, length(t) - length(t) // 2) || left(nx, length(t) // 2) AS ed FROM n),
v AS (SELECT doc_id, 'a' AS k, t AS x FROM e UNION ALL SELECT doc_id, 'b', ed FROM e UNION ALL SELECT doc_id, 'c', nx FROM e),
p AS (SELECT doc_id, k, generate_subscripts(string_split(x, chr(10)), 1) AS i, unnest(string_split(x, chr(10))) AS q FROM v),
h AS (SELECT doc_id, k, i, sha256(q) AS dg, array_to_string(list_transform(regexp_extract_all(q, '{merkle.PIECE}'), lambda y: left(sha256(y), 8)), '.') AS pc FROM p),
m AS (SELECT *, CASE WHEN dg < '4' THEN '/' ELSE ',' END AS mark FROM h),
s AS (SELECT doc_id, k, string_agg(pc || mark, '' ORDER BY i) AS body, string_agg(dg || mark, '' ORDER BY i) AS dgs FROM m GROUP BY doc_id, k),
f AS (SELECT doc_id, k, sha256(array_to_string(list_transform(string_split(dgs, '/'), lambda y: sha256(y)), '')) || ':' || body AS fp FROM s),
w AS (SELECT doc_id, max(fp) FILTER (k = 'a') AS a, max(fp) FILTER (k = 'b') AS b, max(fp) FILTER (k = 'c') AS c FROM f GROUP BY doc_id),
g AS (SELECT *, {_PIECES.format(p='a')} AS pa, {_PIECES.format(p='b')} AS pb, {_PIECES.format(p='c')} AS pc,
    string_split(a[66:], '/') AS sa, string_split(b[66:], '/') AS sb FROM w),
c AS (SELECT *, {_FIRST.format(x='sa', y='sb')} AS sec FROM g),
r AS (SELECT *, string_split(coalesce(sa[sec + 1], ''), ',') AS xa, string_split(coalesce(sb[sec + 1], ''), ',') AS xb FROM c)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(ed) AS edited_sha256, a AS fingerprint, b AS edited_fingerprint,
  CAST({_NEAR.format(o='b')} AS DOUBLE) AS near_edited, CAST({_NEAR.format(o='c')} AS DOUBLE) AS near_next,
  CASE WHEN left(a, 64) <> left(b, 64) THEN CAST(sec AS INTEGER) END AS edit_section,
  CASE WHEN left(a, 64) <> left(b, 64) THEN CAST({_FIRST.format(x='xa', y='xb')} AS INTEGER) END AS edit_paragraph
FROM r JOIN e USING (doc_id)"""
