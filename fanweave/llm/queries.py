"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fanweave.llm.divergence import divergence
from fanweave.llm.exact_dedup import exact_duplicates, normalised
from fanweave.llm.infill import infill
from fanweave.llm.labels import in_fold
from fanweave.llm.mixing import DOMAINS, fit_domains, mix
from fanweave.llm.near_dedup import near_duplicates
from fanweave.llm.packing import best_fit, word_count
from fanweave.llm.quality import ACCEPT, fit_quality, score_quality
from fanweave.llm.registry import query, table
from fanweave.llm.repeats import remove_repeats
from fanweave.llm.secrets import BASE_KINDS, find_secrets
from fanweave.llm.token_records import read_index, write_token_records
from fanweave.llm.topk import top_k
from fanweave.llm.toxicity import FLAG, fit_toxicity, score_toxicity
from fanweave.llm.warc import read_archives, write_archives
from fanweave.session import new_path

EXACT_SQL = r"""
WITH norm AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""


@query("op5_exact_dedup", EXACT_SQL)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts by verified chunk recipes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_duplicates(docs).drop("row_no")


@query("op10_token_records")
def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all token ids as binary records, then read the places back from the files."""
    import public_tokenizers

    path = new_path(spark, "token-records")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    write_token_records(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


# base32 in SQL: five hexadecimal digits are four characters
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex, html FROM p),
b AS (
  SELECT *, list_aggregate(list_transform(range(32), lambda i: substr(
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER)
            >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '')
      AS payload_digest,
    max(page_id) OVER (PARTITION BY html) AS best
  FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM b
"""


@query("op9_warc", WARC_SQL)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives, then read and check them."""
    path = new_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels are learned outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels, ~in_fold("doc_id", 5, 0))
    return score_quality(docs, model).select(
        "doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels are learned outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, ~in_fold("doc_id", 4, 2))
    return score_toxicity(docs, model).select(
        "doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "score",
        (F.col("score") >= FLAG).cast("int").alias("predicted"),
    )


@query("op7_secrets")
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the secrets in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def listed(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return find_secrets(docs).select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
         AS rank
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op1_top_k", TOP_K_SQL)
def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector against all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 20 == 0, k=20, scale=64)


@query("op6_near_dedup")
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets have a similarity of 0.85 or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).drop("row_no")


@query("op3_mixing")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors, rates and copies of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_domains(docs, table(spark, sf_dir, "labels"))
    shares = [F.col("posteriors")[n].alias(f"p_{name}") for n, name in enumerate(DOMAINS)]
    return mix(docs, model).select("doc_id", "tokens", *shares, "rate", "copies")


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 2048 words; documents of one source or with equal texts are kept apart."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return best_fit(docs, word_count("text"), F.col("source"), F.xxhash64(normalised("text")))


INFILL_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
k AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS tokens,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3,
         CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d),
c AS (
  SELECT *, CAST(len(tokens) AS BIGINT) AS n FROM k),
p AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM c),
x AS (
  SELECT *, coalesce(array_to_string(list_slice(tokens, 1, low), ''), '') AS prefix,
         coalesce(array_to_string(list_slice(tokens, low + 1, high), ''), '') AS middle,
         coalesce(array_to_string(list_slice(tokens, high + 1, n), ''), '') AS suffix
  FROM p)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
              WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM x
"""


@query("op11_infill", INFILL_SQL)
def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle order of every document, and the digest of the way back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return infill(docs).drop("output")


REPEATS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
w AS (SELECT r, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM d),
e AS (
  SELECT r, unnest(range(1, len(words) - 33)) AS i,
         unnest(list_transform(range(1, len(words) - 33),
                lambda k: array_to_string(list_slice(words, k, k + 34), ' '))) AS edge
  FROM d WHERE len(words) >= 35),
m AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY edge) AS times FROM e) WHERE times > 1),
c AS (
  SELECT w.r, w.i, w.word, max(CASE WHEN m.i IS NULL THEN 0 ELSE 1 END) OVER (
           PARTITION BY w.r ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM w LEFT JOIN m ON w.r = m.r AND w.i = m.i),
k AS (
  SELECT r, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept
  FROM c GROUP BY r)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words,
       CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r
"""


@query("op12_repeats", REPEATS_SQL)
def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 35 words or more that start elsewhere too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         coalesce(text, '') AS t FROM documents),
x AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d),
o AS (
  SELECT r, lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS term FROM x),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (
  SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term)
  GROUP BY lang, source, term),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
total AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
g AS (
  SELECT a.lang, a.source, coalesce(v, 0) AS v, coalesce(total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) a LEFT JOIN size USING (lang)
  LEFT JOIN total USING (lang, source)),
s AS (
  SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n,
         CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 2)) // (g.total + 2 * g.v)
              AS BIGINT) AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (
  SELECT a.lang, a.source, b.source AS item,
         CAST(coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN s y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  WHERE x.term IS NULL OR y.term IS NOT NULL
  GROUP BY a.lang, a.source, b.source),
l AS (
  SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 2))
         // (any_value(t.total) + 2 * any_value(size.v)) AS BIGINT) AS q
  FROM c JOIN (SELECT lang, sum(total) AS total FROM total GROUP BY lang) t USING (lang)
  JOIN size USING (lang) GROUP BY lang, term),
term AS (
  SELECT s.lang, s.source, s.term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM s JOIN l USING (lang, term) WHERE s.n > 0 AND p > q),
r AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL SELECT lang, source, 'term', item, value FROM term),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)
                 AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query("op13_divergence", DIVERGENCE_SQL)
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of a language differ in their terms, and by which terms."""
    docs = table(spark, sf_dir, "documents").select("text", "lang", "source")
    return divergence(docs)
