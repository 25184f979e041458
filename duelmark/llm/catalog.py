"""The numbered queries over the given tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from duelmark.llm import quality as ranking
from duelmark.llm.batches import remainder, table
from duelmark.llm.bestfit import pack_best_fit
from duelmark.llm.decontaminate import contained_items
from duelmark.llm.exact import exact_groups
from duelmark.llm.html import extract_main_text
from duelmark.llm.lm import score_texts
from duelmark.llm.middle import fill_in_middle, restore
from duelmark.llm.packing import pack_documents
from duelmark.llm.pii import KINDS, count_of, find_private_data, spans_text
from duelmark.llm.simhash import near_groups
from duelmark.llm.toxicity import toxicity, train
from duelmark.llm.trie import conversation_trie
from duelmark.llm.warc import read_captures, url_key, write_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"


def query(run):
    QUERIES[run.__name__] = run
    return run


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and digest of the spans of known form, and all spans."""
    spans = find_private_data(table(spark, sf_dir, "documents"))
    counts = [count_of("base", rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
                        spans_text(F.concat("base", "added")).alias("spans"))


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records, then read back through the capture index."""
    pages = table(spark, sf_dir, "pages")
    read = read_captures(write_archive(pages), pages.select(url_key("url").alias("key")), payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def held(modulus: int, value: int) -> Column:
    """Whether a document is held out from learning."""
    return remainder("doc_id", modulus) == value


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by SimHash."""
    return near_groups(table(spark, sf_dir, "documents"))


@query
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages by the consensus of their hosts."""
    return extract_main_text(table(spark, sf_dir, "pages")).drop("path")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items, and how much of them."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


oracle("op5_decontamination", r"""
WITH lowered AS (SELECT doc_id, list_filter(string_split_regex(
         lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
       FROM documents),
item AS (SELECT item_id, list_filter(string_split_regex(
         lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
       FROM benchmark),
item_shingle AS (SELECT DISTINCT item_id, least(5, len(w)) AS width,
         array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
       FROM item, range(1, len(w) - least(5, len(w)) + 2) AS t(i) WHERE len(w) > 0),
size AS (SELECT item_id, count(*) AS item_shingles FROM item_shingle GROUP BY item_id),
doc_shingle AS (SELECT DISTINCT doc_id, width, array_to_string(w[i:i + width - 1], ' ') AS s
       FROM lowered, (SELECT DISTINCT width FROM item_shingle), range(1, len(w) - width + 2) AS t(i))
SELECT doc_id, item_id, count(*) / any_value(item_shingles)::DOUBLE AS containment, count(*) AS shared, any_value(item_shingles) AS item_shingles
FROM doc_shingle JOIN item_shingle USING (width, s) JOIN size USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(item_shingles) - 1e-9
""")


@query
def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of all documents by a model of nine tenths of them."""
    return score_texts(table(spark, sf_dir, "documents"), held(10, 0))


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents by chunk recipes."""
    return exact_groups(table(spark, sf_dir, "documents")).drop("points")


oracle("op7_exact_dedup", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
g AS (SELECT doc_id, sha256(n) AS text_sha256, count(*) OVER (PARTITION BY n) AS group_size,
             first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""")


def labels_of(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label")).filter("label IS NOT NULL")


def labelled(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """Texts with their labels; ids are told by value, so a repeated label row repeats the text."""
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(labels_of(spark, sf_dir, label), "doc_id")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels of four fifths of them."""
    model = train(labelled(spark, sf_dir, "toxic").filter(~held(5, 0)))
    scored = table(spark, sf_dir, "documents").select("doc_id", toxicity(spark, model).alias("score"))
    return scored.select("doc_id", held(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, ranked from the labels of three quarters of them."""
    # features are smaller than texts, so they are made before they meet the labels
    labels = labels_of(spark, sf_dir, "quality").filter(~held(4, 2))
    described = ranking.described(table(spark, sf_dir, "documents").select("doc_id", "text").filter(~held(4, 2)))
    model = ranking.train_described(described.join(labels, "doc_id"))
    scored = table(spark, sf_dir, "documents").select("doc_id", ranking.quality(spark, model).alias("score"))
    return scored.select("doc_id", held(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum-of-squares packing of all documents into sequences of 2048 ids."""
    pieces = pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle examples of all documents."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


oracle("op12_fill_in_middle", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS x FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
             ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2,
             ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
             CASE WHEN t = '' OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(list_slice(w, 1, a), ''), '') AS pre, coalesce(array_to_string(list_slice(w, a + 1, b), ''), '') AS mid,
             coalesce(array_to_string(list_slice(w, b + 1, n), ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
""")


@query
def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit packing of all documents into sequences of 2048 ids."""
    return pack_best_fit(table(spark, sf_dir, "documents"), TOKENIZER)


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, each rebuilt with the first turns of its group's first conversation."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


oracle("op11_conversation_trie", r"""
WITH own AS (SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS w
       FROM conversations GROUP BY conv_id),
-- crc32 of the id's digits
h AS (SELECT conv_id, w, conv_id::VARCHAR AS c, xor(list_reduce(
         [4294967295::BIGINT] || list_transform(range(1, length(c) + 1), lambda i: ascii(c[i])::BIGINT),
         lambda y, b: list_reduce([xor(y, b)] || range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h FROM own),
b AS (SELECT h.conv_id, list_concat(coalesce(list_slice(g.w, 1, h), []), list_slice(h.w, h + 1, len(h.w))) AS w
       FROM h LEFT JOIN own g ON g.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d, list_slice(w, 1, d) AS path, len(w) AS n, strlen(w[d].x) AS bytes FROM b, range(0, len(w) + 1) AS r(d)),
node AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(bytes), 0) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY path, d),
child AS (SELECT list_slice(path, 1, d - 1) AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
whole AS (SELECT node.*, coalesce(child.n, 0) AS n_children FROM node LEFT JOIN child ON child.path = node.path),
sub AS (SELECT list_slice(path, 1, k) AS path, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens
        FROM whole, range(0, d + 1) AS r(k) GROUP BY 1)
SELECT whole.conv_id, whole.d AS depth, parent.conv_id AS parent_conv_id, whole.n_convs, n_children, n_leaves, saved_tokens, whole.ends_sha256
FROM whole JOIN sub ON sub.path = whole.path LEFT JOIN node parent ON whole.d > 0 AND parent.path = list_slice(whole.path, 1, whole.d - 1)
""")
