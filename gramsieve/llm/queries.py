"""The registered queries of this subpackage and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramsieve.llm import bpe, licences, linededup, lshforest, mixing, permutation, quality, sharding, suffixes, warc
from gramsieve.llm.common import table


def rank_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, rank_path()).drop("text")
    back = bpe.decode(coded, rank_path())
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return back.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    book = quality.judge(quality.ledger(docs), "v1")
    failed = F.col("fail_bits").bitwiseAND(F.lit(quality.mask("base")).cast("long")) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "n_lines", "fail_bits")


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT r, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM m)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r
), x AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda z: length(z))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM m LEFT JOIN rep USING (r)
), b AS (
  SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END
    + CASE WHEN word_chars > 25 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 16 ELSE 0 END
    + CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN 32 ELSE 0 END AS BIGINT) AS fail_bits
  FROM x
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, fail_bits FROM b
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("words"))
    mixed = mixing.mix(docs, size=F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    page = r"^<urn:page:(-?\d+)>$"
    return records.select(
        F.regexp_extract("record_id", page, 1).try_cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.regexp_extract("refers_to", page, 1).try_cast("long").alias("refers_to"),
    )


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), t AS (
  SELECT *, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS top FROM p
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
FROM t
"""


def op5_lshforest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lshforest.near_duplicates(docs, words=4, percent=80)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.y) AS component_id, d.doc_id = min(r.y) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.x = d.doc_id
GROUP BY d.doc_id, n.n
"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.assign(docs, 24)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), span=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return suffixes.without_spans(found).select(
        "doc_id",
        F.length("content").cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        # what is left in characters, as documents.n_chars counts them, and whether something went
        F.char_length(F.col("kept").cast("string")).cast("long").alias("kept_chars"),
        (F.size("spans") > 0).alias("has_repeats"),
    )


def op8_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"), passage=50)
    return out.select("doc_id", "n_lines", "n_dropped", F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT r, doc_id, p, ls[p] AS x FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM d)
), w AS (
  SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws FROM l
), k AS (
  SELECT *, CASE WHEN len(list_filter(ws, lambda w: NOT regexp_matches(w, '[0-9]'))) >= 0.6 * len(ws)
    THEN list_transform(ws, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) ELSE ws END AS k FROM w
), held AS (
  SELECT DISTINCT doc_id, k FROM k WHERE len(k) > 0
), c AS (
  SELECT k, len(k) AS n, k[1:3] AS lead, count(*) AS c FROM held GROUP BY k
), leaf AS (
  SELECT n, lead, sum(c) AS al FROM c GROUP BY n, lead HAVING count(*) > 1 AND sum(c) >= 10
), tok AS (
  SELECT k, n, lead, c, al, p, k[p] AS w FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM c JOIN leaf USING (n, lead))
), fixed AS (
  SELECT n, lead, p, w FROM tok GROUP BY n, lead, p, w HAVING 2 * sum(c) >= any_value(al)
), shape AS (
  SELECT k, CAST(n AS VARCHAR) || CAST(lead AS VARCHAR) || string_agg(p || ':' || w, ' ' ORDER BY p) AS s
  FROM tok JOIN fixed USING (n, lead, p, w) GROUP BY k, n, lead
  HAVING count(*) FILTER (NOT regexp_matches(w, '[0-9]') AND w <> '<*>') >= 0.6 * n AND count(*) FILTER (p > 3) >= 0.6 * (n - 3)
), tm AS (
  SELECT h.doc_id, h.k, coalesce('t' || s, 'k' || array_to_string(h.k, ' ')) AS t FROM held h LEFT JOIN shape USING (k)
), often AS (
  SELECT t, min(doc_id) AS f FROM (SELECT DISTINCT doc_id, t FROM tm) GROUP BY t HAVING count(*) >= 10
), again AS (
  SELECT k, min(doc_id) AS f FROM held WHERE len(k) > 50 GROUP BY k HAVING count(*) >= 2
), gone AS (
  SELECT tm.doc_id, tm.k, true AS hit FROM tm JOIN often USING (t) WHERE tm.doc_id <> f
  UNION SELECT h.doc_id, h.k, true FROM held h JOIN again USING (k) WHERE h.doc_id <> f
), done AS (
  SELECT k.r, k.doc_id, count(*) FILTER (len(k.k) > 0) AS n_lines, count(*) FILTER (hit) AS n_dropped,
    coalesce(string_agg(x, chr(10) ORDER BY p) FILTER (hit IS NULL), '') AS kept
  FROM k LEFT JOIN gone ON gone.doc_id = k.doc_id AND gone.k = k.k GROUP BY k.r, k.doc_id
)
SELECT doc_id, n_lines, n_dropped, CAST(strlen(kept) AS BIGINT) AS kept_bytes, sha256(kept) AS kept_sha256 FROM done
"""


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths; a source is a directory here, a language one below it with a folder for every 16 ids. Each
    sixteenth document plays the licence file of its source, language or folder in turn, so that the others can inherit."""
    at = F.col("doc_id")
    name = F.when(at % 16 != 0, F.concat(at.cast("string"), F.lit(".txt"))).otherwise("LICENSE")
    folder = F.when(at % 16 != 0, F.floor(at / 16)).when(at % 48 == 0, F.floor(at / 16))
    lang = F.when((at % 16 != 0) | (at % 48 != 16), F.col("lang"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", lang, folder.cast("string"), name).alias("path"))
    return licences.scan(docs).select("doc_id", "path", "licence", "score", "line", "origin", "origin_dir")


def queries() -> dict:
    import corpus_pipeline

    return {"op1_bpe": op1_bpe, "op2_quality": op2_quality, "op3_mixing": op3_mixing, "op4_warc": op4_warc, "op5_lshforest": op5_lshforest, "op6_sharding": op6_sharding, "op7_suffixes": op7_suffixes, "op8_permutation": op8_permutation, "op9_linededup": op9_linededup, "op10_licences": op10_licences, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality": OP2_SQL, "op4_warc": OP4_SQL, "op5_lshforest": OP5_SQL, "op9_linededup": OP9_SQL}
