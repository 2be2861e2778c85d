"""The registered queries of the operators, over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsift.llm import (bpe, chats, lines, mixing, nearest, pages, passages, quality, ranking, simhash,
                          sketches, spelling, urls)
from postsift.llm.common import table
from postsift.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = quality.with_votes(quality.measure(docs))
    voted = cut_lineage(measured.select(
        F.struct("row.doc_id").alias("row"), *quality.MEASURES, "votes"))
    judged = quality.judge(voted, quality.fit(voted))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "posterior", "kept")


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", tokenizer.encode(F.col("text")).alias("ids"))
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return docs.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(digits, 256).alias("ids_sha256"),
        F.sha2(tokenizer.decode(F.col("ids")), 256).alias("decoded_sha256"))


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query("op7_lines")
def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.report(table(spark, sf_dir, "documents"))
    return found.withColumn("n_dropped", F.size("dropped").cast("long"))


@query("op2_sketches")
def op2_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compare_with_edits(table(spark, sf_dir, "documents"))


@query("op8_chats", r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST,
           role NULLS FIRST, text NULLS FIRST) AS place, role, text
  FROM conversations),
whole AS (
  SELECT conv_id, max(place) AS size,
         list({'r': role, 't': text} ORDER BY place) AS said
  FROM turns GROUP BY conv_id),
kinds AS (SELECT min(conv_id) AS conv_id, size, said FROM whole GROUP BY size, said),
starts AS (
  SELECT DISTINCT said[1:k] AS said
  FROM (SELECT said, unnest(range(1, size)) AS k FROM whole)),
kept AS (SELECT conv_id FROM kinds k WHERE NOT EXISTS (SELECT 1 FROM starts s WHERE s.said = k.said))
SELECT conv_id, (place - 1) // 1024 AS part, count(*) AS n_turns,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '')
                  || '<|im_end|>' || chr(10), '' ORDER BY place) AS chat
FROM turns WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id, part""")
def op8_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.format_chats(table(spark, sf_dir, "conversations"))


@query("op6_urls")
def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "pages").select("page_id", "url")
    labelled = urls.labelled_urls(seen, table(spark, sf_dir, "labels"))
    return urls.judge(seen, labelled).select(
        "row.page_id", "host", "path", "rule", "score", "verdict")


@query("op9_pages")
def op9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.main_text(table(spark, sf_dir, "pages"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op10_passages")
def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query("op11_topk", """
WITH parts AS (
  SELECT row_number() OVER () AS row, vec_id, embedding, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
whole AS (
  SELECT row, vec_id, list_transform(x, lambda c: CAST(floor(64 * c) AS BIGINT)) AS v FROM parts
  WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: CAST(p[1] * p[2] AS BIGINT))) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.row <> c.row),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS place FROM scored)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM placed WHERE place <= 20""")
def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.top_k(table(spark, sf_dir, "embeddings"))


@query("op12_ranking", r"""
WITH said AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
docs AS (SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM said WHERE len(terms) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS length FROM docs),
asked AS (
  SELECT item, item_id, unnest(list_distinct(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)),
held AS (
  SELECT row, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0 * max(total) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, whole GROUP BY term),
scored AS (
  SELECT item, item_id, row, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * total) // length)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term), whole GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS place
  FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM placed WHERE place <= 10""")
def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _crc32_sql(key: str, run: str) -> str:
    """crc32 of ``key:run`` in DuckDB, over the UTF-8 bytes of code points up to U+00FF."""
    return f"""list_reduce(list_prepend(4294967295, flatten(list_transform(
      string_split(coalesce(CAST({key} AS VARCHAR), '') || ':' || {run}, ''),
      lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), ord(c) - 64] END))),
    lambda crc, b: xor(crc >> 8, steps[CAST(xor(crc, b) & 255 AS INTEGER) + 1]))"""


@query("op13_spelling", rf"""
WITH RECURSIVE bits AS (
  SELECT 0 AS k, range AS i, CAST(range AS BIGINT) AS v FROM range(256)
  UNION ALL
  SELECT k + 1, i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS steps FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
        FROM documents) GROUP BY ALL),
hashed AS (
  SELECT run, n, xor({_crc32_sql("doc_id", "run")}, 4294967295) AS h FROM runs, crc),
seen AS (
  SELECT CASE WHEN h % 199 = 0
              THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
              ELSE run END AS word, n
  FROM hashed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM seen WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n
  FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, n, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n
  FROM near GROUP BY word, n),
forms AS (SELECT word, near AS form, near_n AS form_n FROM best WHERE near_n >= 5 * n),
chains AS (
  SELECT word, word AS root, 0 AS step FROM words
  UNION ALL SELECT c.word, f.form, step + 1 FROM chains c JOIN forms f ON f.word = c.root),
ends AS (SELECT word, arg_max(root, step) AS root FROM chains GROUP BY word)
SELECT word, form, root, w.n AS n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, form_n
FROM words w LEFT JOIN best b USING (word) LEFT JOIN forms USING (word) JOIN ends USING (word)""")
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"), damage=spelling.DAMAGE))
