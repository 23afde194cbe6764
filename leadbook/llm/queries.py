"""Registered queries of the operators: thin forms over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadbook.llm.contamination import contamination_report
from leadbook.llm.embeddings import near_duplicates
from leadbook.llm.fingerprints import edited_fingerprints
from leadbook.llm.html_content import extract_pages
from leadbook.llm.jaccard import similarity_groups
from leadbook.llm.language import predict_documents
from leadbook.llm.lines import dedup_lines
from leadbook.llm.merkle import document_proofs
from leadbook.llm.ngram_model import score_documents
from leadbook.llm.packing import pack_documents
from leadbook.llm.prefix_trie import prefix_trie
from leadbook.llm.sentencepiece_scan import decode_documents, encode_documents
from leadbook.llm.token_files import read_token_files, write_token_files
from leadbook.runtime import ship_code

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query under its function name; the executors get the package before it runs."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sequences of 2048 tokens: byte-level ids, then id 0."""
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that an earlier document has."""
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("uid", F.monotonically_increasing_id())
    return dedup_lines(docs).select("doc_id", "text", "n_deleted")


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids of every whole text, and the text decoded from them."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("uid", F.monotonically_increasing_id())
    coded = encode_documents(docs, model, carry=("doc_id",))
    return decode_documents(coded, model).select("doc_id", "ids", "text")


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    return edited_fingerprints(documents(spark, sf_dir))


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by three-word shingle sets of Jaccard similarity 0.9 or more."""
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("uid", F.monotonically_increasing_id())
    groups = similarity_groups(docs, words=3, num=90, den=100)
    return groups.select("doc_id", "n_shingles", F.col("lead_id").alias("component_id"))


@query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document, with every tenth held out."""
    return score_documents(documents(spark, sf_dir))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, with every fourth held out."""
    return predict_documents(documents(spark, sf_dir))


@query
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked by a cosine of 0.9 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)


ORACLES["op9_embedding_near_dedup"] = """
WITH RECURSIVE
good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.vec_id, pairs.b FROM reach JOIN pairs ON reach.other = pairs.a
),
lead AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a)
SELECT lead.vec_id, coalesce(n.n, 0) AS n_links, component_id, lead.vec_id = component_id AS kept
FROM lead LEFT JOIN n ON lead.vec_id = n.vec_id
"""


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from token files: word-level ids, then id 2."""
    return read_token_files(write_token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2))


@query
def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a ten-word window of a benchmark item."""
    report = contamination_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return report.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLES["op11_benchmark_decontamination"] = f"""
WITH
item AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS k, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM item WHERE len(w) > 0)
),
doc AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
size AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc CROSS JOIN size WHERE len(w) >= n)
),
found AS (SELECT doc_id, item_id, i, place.n AS n FROM place JOIN win ON place.k = win.k AND place.n = win.n),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id
),
held AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT doc.doc_id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit ON doc.doc_id = hit.doc_id LEFT JOIN held ON doc.doc_id = held.doc_id
"""


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof in the Merkle manifest, with every row of crc32 divisible by 7 tampered with."""
    return document_proofs(documents(spark, sf_dir)).drop("path")


def _crc32_sql(text: str) -> str:
    """Unsigned crc32 of ASCII text, bit by bit."""
    bit = "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"lambda r, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], {bit}, xor(r, b))"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce({codes}, {byte}, 4294967295::BIGINT), 4294967295)"


def _leaf_sql(n_chars: str) -> str:
    fields = (f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text"))
    return f"sha256({' || '.join(fields)})"


ORACLES["op12_merkle_manifest"] = f"""
WITH RECURSIVE
hashed AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
    CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS shown
  FROM documents
),
leaf AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER () AS id
  FROM hashed
),
tree(lang, h, i, d, n) AS (
  SELECT lang, 0, i, leaf, n FROM leaf
  UNION ALL
  SELECT lang, h + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, h, i // 2, n
),
sub AS (
  SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1
),
upper(h, i, d, n) AS (
  SELECT 0, i, d, n FROM sub
  UNION ALL
  SELECT h + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM upper WHERE n > 1 GROUP BY h, i // 2, n
),
climb(id, lang, h, i, n, beside, f) AS (
  SELECT id, lang, 0, i, n, '', shown FROM leaf
  UNION ALL
  SELECT c.id, c.lang, c.h + 1, c.i // 2, (c.n + 1) // 2, c.beside || coalesce(s.d, ''),
    sha256(CASE WHEN c.i % 2 = 0 THEN c.f || coalesce(s.d, '') ELSE s.d || c.f END)
  FROM climb c LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM c.lang AND s.h = c.h AND s.i = xor(c.i, 1) WHERE c.n > 1
),
climb2(id, h, i, n, beside, f) AS (
  SELECT c.id, 0, s.i, s.n, c.beside, c.f FROM climb c JOIN sub s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL
  SELECT c.id, c.h + 1, c.i // 2, (c.n + 1) // 2, c.beside || coalesce(s.d, ''),
    sha256(CASE WHEN c.i % 2 = 0 THEN c.f || coalesce(s.d, '') ELSE s.d || c.f END)
  FROM climb2 c LEFT JOIN upper s ON s.h = c.h AND s.i = xor(c.i, 1) WHERE c.n > 1
)
SELECT leaf.doc_id AS doc_id, leaf.leaf AS leaf, sub.d AS subroot, upper.d AS root, sha256(c.beside) AS proof_sha256, c.f AS folded_root,
  c.f = upper.d AS verified
FROM leaf JOIN sub ON sub.lang IS NOT DISTINCT FROM leaf.lang JOIN climb2 c ON c.id = leaf.id AND c.n = 1 JOIN upper ON upper.n = 1
"""


@query
def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations, with counts over its members and subtree."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# A prefix is the digests of its turns, 64 characters each.
ORACLES["op13_conversation_prefix_trie"] = f"""
WITH
t AS (
  SELECT conv_id, item, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, item) - 1 AS pos
  FROM (
    SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS item,
      len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
    FROM conversations WHERE conv_id IS NOT NULL
  )
),
c AS (SELECT conv_id, {_crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
joined AS (
  SELECT c.conv_id, 0 AS part, pos, item, words FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 WHERE pos < h
  UNION ALL
  SELECT c.conv_id, 1, pos, item, words FROM c JOIN t ON t.conv_id = c.conv_id WHERE pos >= h
),
pre AS (
  SELECT conv_id, words, row_number() OVER w AS depth, string_agg(item, '') OVER w AS k
  FROM joined WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM c
),
node AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM pre GROUP BY k, depth),
child AS (SELECT left(k, 64 * (depth - 1)) AS k, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
own AS (
  SELECT node.k, depth, (n_convs - 1) * words AS saved, CASE WHEN child.n IS NULL THEN 1 ELSE 0 END AS leaf
  FROM node LEFT JOIN child ON child.k = node.k
),
total AS (
  SELECT left(k, 64 * d) AS k, sum(saved) AS saved, sum(leaf) AS leaves
  FROM (SELECT k, saved, leaf, unnest(generate_series(0, depth)) AS d FROM own) GROUP BY 1
),
last AS (SELECT conv_id, max_by(k, depth) AS k FROM pre GROUP BY conv_id),
ends AS (SELECT k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS h FROM last GROUP BY k)
SELECT node.conv_id, node.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(child.n, 0) AS n_children,
  total.leaves::BIGINT AS n_leaves, total.saved::BIGINT AS saved_tokens, coalesce(ends.h, sha256('')) AS ends_sha256
FROM node LEFT JOIN node up ON node.depth > 0 AND up.k = left(node.k, 64 * (node.depth - 1)) AND up.depth = node.depth - 1
LEFT JOIN child ON child.k = node.k JOIN total ON total.k = node.k LEFT JOIN ends ON ends.k = node.k
"""
