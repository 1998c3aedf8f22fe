"""Query catalogue of the search engine, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramsieve.functions.grams import explode_grams, sparse_covering, trigrams
from gramsieve.operators import budgets, search
from gramsieve.operators.index import Index, bitmaps, build, decode_postings, encode_postings, number_files, posting_sizes, postings_of
from gramsieve.places import remove, shared_dir
from gramsieve.plans import planner
from gramsieve.sources.corpus import ignored, keep_files, parse_name_status, parse_porcelain
from gramsieve.streaming import delta
from gramsieve.streaming.overlay import Overlay, changes_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: (table, id, text) of the corpora.
DOCUMENTS, PAGES, CONVERSATIONS, BENCHMARK = ("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text"), ("benchmark", "item_id", "text")


def corpus(spark: SparkSession, sf_dir: str, which: tuple[str, str, str] = DOCUMENTS) -> DataFrame:
    name, key, text = which
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.col(key).alias("path"), F.col(text).alias("text"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _matches_sql(pattern: str, source: str = "SELECT doc_id AS path, text FROM documents") -> str:
    """Marks, splits and counts, as SQL; ``pattern`` in the oracle's dialect."""
    p = pattern.replace("'", "''")
    return f"""
WITH c AS ({source}),
s AS (SELECT path, string_split(regexp_replace(text, '({p})', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS seg FROM c WHERE regexp_matches(text, '{p}')),
x AS (SELECT path, seg, unnest(range(2, len(seg) + 1)) AS k FROM s),
y AS (SELECT path, string_split(seg[k], chr(2))[1] AS text, replace(array_to_string(seg[1:k-1], ''), chr(2), '') AS pre FROM x)
SELECT path, CAST(len(pre) - len(replace(pre, chr(10), '')) + 1 AS BIGINT) AS line, CAST(strlen(string_split(pre, chr(10))[-1]) + 1 AS BIGINT) AS col, text FROM y
"""


def _scan(name: str, pattern: str, which=DOCUMENTS, sql_pattern: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.find_matches(corpus(spark, sf_dir, which), pattern)

    run.__name__ = name
    table, key, text = which
    query(_matches_sql(sql_pattern or pattern, f"SELECT {key} AS path, {text} AS text FROM {table}"))(run)


_scan("scan_matches_literal", "license")
_scan("scan_matches_class", "[A-Z]{4,}")
_scan("scan_matches_alternation", "Copyright|License")
_scan("scan_matches_multiline", "(?m)^The [a-z]+")
_scan("scan_matches_html", 'href="[^"]*"', PAGES)
_scan("scan_matches_optional", "licen[sc]ed? under( the)?")
_scan("scan_matches_folded", "(?i)version [0-9]")


@query("SELECT doc_id AS path FROM documents WHERE regexp_matches(text, 'License|Copyright')")
def matching_files(spark, sf_dir):
    return search.matching_files(corpus(spark, sf_dir), "License|Copyright")


@query("SELECT doc_id AS path, CAST(len(regexp_extract_all(text, 'the [a-z]+')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, 'the [a-z]+')")
def match_count_per_file(spark, sf_dir):
    return search.find_matches(corpus(spark, sf_dir), "the [a-z]+").groupBy("path").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS files_scanned, CAST(sum(strlen(text)) AS BIGINT) AS bytes_scanned, count(*) FILTER (regexp_matches(text, '[A-Z]{4,}')) AS files_matched,
  CAST(sum(len(regexp_extract_all(text, '[A-Z]{4,}'))) AS BIGINT) AS matches FROM documents""")
def scan_stats(spark, sf_dir):
    return search.scan_stats(corpus(spark, sf_dir), "[A-Z]{4,}")


@query("""SELECT 'word' AS pattern, count(*) FILTER (regexp_matches(text, 'the')) AS files, CAST(sum(len(regexp_extract_all(text, 'the'))) AS BIGINT) AS matches FROM documents
UNION ALL SELECT 'phone', count(*) FILTER (regexp_matches(text, '[0-9]{3}-[0-9]{4}')), CAST(sum(len(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}'))) AS BIGINT) FROM documents
UNION ALL SELECT 'licence', count(*) FILTER (regexp_matches(text, 'licen[cs]e|License')), CAST(sum(len(regexp_extract_all(text, 'licen[cs]e|License'))) AS BIGINT) FROM documents""")
def scan_many(spark, sf_dir):
    return search.scan_many(corpus(spark, sf_dir), {"word": "the", "phone": "[0-9]{3}-[0-9]{4}", "licence": "licen[cs]e|License"})


@query("SELECT DISTINCT conv_id AS path FROM conversations WHERE regexp_matches(text, 'the|and')")
def files_only_alternation(spark, sf_dir):
    return search.matching_files(corpus(spark, sf_dir, CONVERSATIONS), "the|and").distinct()


@query(f"SELECT path || ':' || line || ':' || col || ': ' || text AS line_out FROM ({_matches_sql('License')})")
def printed_matches(spark, sf_dir):
    return search.format_matches(search.find_matches(corpus(spark, sf_dir), "License"))


# grams and index

_TRIGRAMS = "SELECT DISTINCT {key} AS file_id, substr(h, 2 * i + 1, 6) AS gram FROM (SELECT {key}, hex(encode(text)) AS h, unnest(range(0, strlen(text) - 2)) AS i FROM {table})"
_BENCH, _DOCS = _TRIGRAMS.format(key="item_id", table="benchmark"), _TRIGRAMS.format(key="doc_id", table="documents")


def _postings(spark, sf_dir, which=BENCHMARK) -> DataFrame:
    return explode_grams(corpus(spark, sf_dir, which), "path", "text")


#: Turns of conversations as files.
TURNS = "SELECT conv_id * 1000 + turn AS path, text FROM conversations"
#: Indexes that this program has written, by application, tables and kind.
_BUILT: dict[tuple, str] = {}


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("path"), "text")


def _index(spark, sf_dir, of_turns: bool = False) -> Index:
    """An index on disk, written once an application: of documents by trigrams, of turns by sparse grams."""
    key = (spark.sparkContext.applicationId, sf_dir, of_turns)
    if key not in _BUILT:
        path = f"{shared_dir(spark)}/index-{uuid.uuid4()}"
        files = (turns if of_turns else corpus)(spark, sf_dir).withColumn("file_id", F.col("path"))
        build(files, path, sparse=of_turns)
        remove(spark, path, at_exit=True)
        Index.open(spark, path)
        _BUILT[key] = path
    return Index.open(spark, _BUILT[key], check=False)


@query(_BENCH)
def trigrams_of_doc(spark, sf_dir):
    return _postings(spark, sf_dir).select("file_id", F.hex("gram").alias("gram"))


@query(f"SELECT gram, count(*) AS df FROM ({_DOCS}) GROUP BY gram")
def trigram_df(spark, sf_dir):
    return _index(spark, sf_dir).grams.select(F.hex("gram").alias("gram"), "df")


@query(f"SELECT gram, count(*) AS df, list_sort(list(file_id)) AS files FROM ({_BENCH}) GROUP BY gram")
def inverted_index(spark, sf_dir):
    g = _postings(spark, sf_dir).groupBy("gram").agg(F.count("*").alias("df"), F.sort_array(F.collect_list("file_id")).alias("files"))
    return g.select(F.hex("gram").alias("gram"), "df", "files")


def _hold(*words: str, how: str = "AND") -> str:
    return f" {how} ".join(f"contains(text, '{w}')" for w in words)


_L, _T = [trigrams(b"License")[i] for i in range(5)], trigrams(b"version")


def _set_sql(grams: list[bytes], all_: bool) -> str:
    names = ", ".join(f"'{g.hex().upper()}'" for g in grams)
    return f"SELECT file_id FROM ({_DOCS}) WHERE gram IN ({names}) GROUP BY file_id HAVING count(*) >= {len(grams) if all_ else 1}"


@query(_set_sql(_L, True))
def candidates_and(spark, sf_dir):
    return _index(spark, sf_dir).all_of(_L)


@query(_set_sql(_T[:2], False))
def candidates_or(spark, sf_dir):
    return _index(spark, sf_dir).any_of(_T[:2])


@query(f"{_set_sql(_L, True)} UNION {_set_sql(_T, True)}")
def candidates_and_of_or(spark, sf_dir):
    return _index(spark, sf_dir).candidates(planner.plan("License|version", planner.Override.TRIGRAM))


@query("SELECT doc_id AS file_id FROM documents")
def candidates_all(spark, sf_dir):
    return _index(spark, sf_dir).candidates(planner.plan("[0-9]+"))


def _indexed(spark, sf_dir, override=planner.Override.TRIGRAM):
    c = corpus(spark, sf_dir).withColumn("file_id", F.col("path"))
    return _index(spark, sf_dir).search(c, "Copyright|License", override)


@query(_matches_sql("Copyright|License"))
def indexed_search(spark, sf_dir):
    return _indexed(spark, sf_dir)


@query("SELECT doc_id AS path FROM documents WHERE regexp_matches(text, 'License')")
def indexed_files(spark, sf_dir):
    c = corpus(spark, sf_dir).withColumn("file_id", F.col("path"))
    return _index(spark, sf_dir).search_files(c, "License", planner.Override.TRIGRAM)


@query(f"SELECT count(*) AS scan_matches, count(*) AS indexed_matches, CAST(0 AS BIGINT) AS different FROM ({_matches_sql('Copyright|License')})")
def indexed_equals_scan(spark, sf_dir):
    """Matches of scan and of indexed search, and how many only one of them has."""
    a, b = search.find_matches(corpus(spark, sf_dir), "Copyright|License"), _indexed(spark, sf_dir)
    names = ["path", "line", "col", "text"]
    both = a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(-1))).groupBy(*names).agg(F.count_if(F.col("s") > 0).alias("x"), F.count_if(F.col("s") < 0).alias("y"))
    return both.agg(F.sum("x").alias("scan_matches"), F.sum("y").alias("indexed_matches"), F.sum(F.abs(F.col("x") - F.col("y"))).alias("different"))


def _turn_search(override):
    def run(spark, sf_dir):
        return _index(spark, sf_dir, True).search(turns(spark, sf_dir).withColumn("file_id", F.col("path")), "[Tt]he [a-z]+|(er|ing)+ of", override)

    return run


for _o in planner.Override:
    _run = _turn_search(_o)
    _run.__name__ = f"turns_search_{_o.value}"
    query(_matches_sql("[Tt]he [a-z]+|(er|ing)+ of", TURNS))(_run)


@query("SELECT CAST(doc_id AS VARCHAR) AS path, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS file_id FROM documents")
def file_numbers(spark, sf_dir):
    return number_files(corpus(spark, sf_dir).withColumn("path", F.col("path").cast("string"))).select("path", "file_id")


@query(f"""SELECT count(*) AS file_count, CAST(sum(strlen(text)) AS BIGINT) AS source_bytes, (SELECT count(DISTINCT gram) FROM ({_DOCS})) AS ngram_count, CAST(0 AS BIGINT) AS sparse_count,
  (SELECT count(DISTINCT gram) FROM ({_DOCS})) AS trigram_only_count FROM documents""")
def index_counts(spark, sf_dir):
    return _index(spark, sf_dir).counts()


@query(f"""SELECT 'trigram' AS strategy, CAST({len(_L)} AS BIGINT) AS lookups, count(*) AS files, count(*) FILTER (c.file_id IS NOT NULL) AS candidates, CAST(sum(strlen(text)) FILTER (c.file_id IS NOT NULL) AS BIGINT) AS bytes_read,
  count(*) FILTER (contains(text, 'License')) AS files_matched, CAST(sum(len(regexp_extract_all(text, 'License'))) AS BIGINT) AS matches FROM documents d LEFT JOIN ({_set_sql(_L, True)}) c ON c.file_id = d.doc_id""")
def search_counters(spark, sf_dir):
    c = corpus(spark, sf_dir).withColumn("file_id", F.col("path"))
    return _index(spark, sf_dir).search_counted(c, "License", planner.Override.TRIGRAM).drop("plan_seconds", "seconds")


@query("SELECT doc_id AS file_id FROM documents WHERE regexp_matches(text, 'Licen[sc]e')")
def verified_candidates(spark, sf_dir):
    i, c = _index(spark, sf_dir), corpus(spark, sf_dir).withColumn("file_id", F.col("path"))
    return search.verify(c.join(i.candidates(i.plan("Licen[sc]e")), "file_id", "left_semi"), "Licen[sc]e")


@query(_BENCH)
def postings_round_trip(spark, sf_dir):
    """Lists encoded in the shortest form and decoded."""
    return decode_postings(encode_postings(_postings(spark, sf_dir))).select("file_id", F.hex("gram").alias("gram"))


def _two(spark, sf_dir):
    i = _index(spark, sf_dir)
    return i.all_of([b"the"]), i.all_of([b"and"])


@query(f"{_set_sql([b'the'], True)} INTERSECT {_set_sql([b'and'], True)}")
def posting_intersect(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.join(b, "file_id", "left_semi")


@query(f"{_set_sql([b'the'], True)} UNION {_set_sql([b'and'], True)}")
def posting_union(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.unionByName(b).distinct()


@query(f"{_set_sql([b'the'], True)} EXCEPT {_set_sql([b'and'], True)}")
def posting_difference(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.join(b, "file_id", "left_anti")


@query(f"SELECT CAST(file_id // 32768 + 1 AS BIGINT) AS bucket, count(*) AS n FROM ({_DOCS}) WHERE gram = '746865' GROUP BY 1")
def postings_bitmap(spark, sf_dir):
    return bitmaps(_index(spark, sf_dir).lookup([b"the"]), ["gram"]).select("bucket", F.bitmap_count("bitmap").alias("n"))


@query(f"""WITH d AS (SELECT list_sort(list(c)) AS l, count(*) AS n, avg(c) AS m, max(c) AS x, count(*) FILTER (c > 1000) AS o, count(*) FILTER (c > 10000) AS p FROM (SELECT gram, count(*) AS c FROM ({_DOCS}) GROUP BY gram))
SELECT n AS ngram_count, m AS mean_df, l[n // 2 + 1] AS median_df, l[(n - 1) * 95 // 100 + 1] AS p95_df, l[(n - 1) * 99 // 100 + 1] AS p99_df, x AS max_df, o AS over_1000, p AS over_10000 FROM d""")
def posting_stats(spark, sf_dir):
    return _index(spark, sf_dir).stats()


_VARLEN = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END"


@query(f"""WITH g AS (SELECT gram, file_id - lag(file_id, 1, 0) OVER (PARTITION BY gram ORDER BY file_id) AS gap FROM ({_BENCH}))
SELECT gram, CAST(1 + {_VARLEN.format('count(*)')} + sum({_VARLEN.format('gap')}) AS BIGINT) AS varint_bytes FROM g GROUP BY gram""")
def posting_bytes_varint(spark, sf_dir):
    return posting_sizes(_postings(spark, sf_dir)).select(F.hex("gram").alias("gram"), "varint_bytes")


@query(f"SELECT gram, CAST(5 + 4 * count(*) AS BIGINT) AS fixed_bytes FROM ({_BENCH}) GROUP BY gram")
def posting_bytes_fixed(spark, sf_dir):
    return posting_sizes(_postings(spark, sf_dir)).select(F.hex("gram").alias("gram"), "fixed_bytes")


@query(f"SELECT gram, count(*) / (SELECT count(*) FROM benchmark) AS share FROM ({_BENCH}) GROUP BY gram")
def ngram_selectivity(spark, sf_dir):
    n = corpus(spark, sf_dir, BENCHMARK).agg(F.count("*").alias("n"))
    g = _postings(spark, sf_dir).groupBy("gram").agg(F.count("*").alias("df"))
    return g.join(n).select(F.hex("gram").alias("gram"), (F.col("df") / F.col("n")).alias("share"))


_PLAIN = ("enum AgentMode", "license", "MAX_FILE_SIZE")


@query(f"""SELECT p AS pattern, CAST(len(g) AS INTEGER) AS trigram_lookups, CAST(round(1.12 * len(g), 9) AS DOUBLE) AS trigram_cost
FROM (SELECT p, list_distinct(list_transform(range(1, len(p) - 1), lambda i: substr(p, i, 3))) AS g FROM (VALUES {', '.join(f"('{p}')" for p in _PLAIN)}) t(p))""")
def plan_cost(spark, sf_dir):
    return planner.diagnostics(spark, list(_PLAIN)).select("pattern", "trigram_lookups", F.round("trigram_cost", 9).alias("trigram_cost"))


@query("""WITH t AS (SELECT item_id, hex(encode(text)) AS h, strlen(text) AS n FROM benchmark),
p AS (SELECT item_id, i, substr(h, 2 * i + 1, 4) AS pair FROM (SELECT item_id, h, unnest(range(0, n - 1)) AS i FROM t)),
r AS (SELECT pair, row_number() OVER (ORDER BY md5(unhex(pair))) AS w FROM (SELECT DISTINCT pair FROM p)),
l AS (SELECT item_id, list(w ORDER BY i) AS ws FROM p JOIN r USING (pair) GROUP BY item_id),
x AS (SELECT item_id, ws, a, unnest(range(a, len(ws) + 1)) AS b FROM (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS a FROM l)),
g AS (SELECT item_id, a, b FROM x WHERE b <= a + 1 OR least(ws[a], ws[b]) > list_max(ws[a+1:b-1]))
SELECT item_id AS file_id, count(DISTINCT substr(h, 2 * a - 1, 2 * (b - a + 2))) AS n FROM g JOIN t USING (item_id) GROUP BY item_id""")
def sparse_all_counts(spark, sf_dir):
    """Sparse grams of each text."""
    return explode_grams(corpus(spark, sf_dir, BENCHMARK), "path", "text", sparse=True).groupBy("file_id").agg(F.count("*").alias("n"))


_REPEATED = ["the ", "ation", "----", "abababab", "    ", "=====", "License"]


@query(f"""WITH w AS (SELECT unnest({_REPEATED!r}) AS word), t AS (SELECT item_id, text FROM benchmark UNION ALL SELECT -strlen(word) * 100 - ascii(word), 'x' || word || 'y ' || word || word FROM w)
SELECT word, count(*) AS texts, CAST(0 AS BIGINT) AS missing FROM w JOIN t ON contains(text, word) GROUP BY word""")
def sparse_covering_check(spark, sf_dir):
    """For literals, with repeated pairs among them: the texts that hold them, and covering grams that such a text lacks."""
    planted = spark.createDataFrame([(-len(w) * 100 - ord(w[0]), f"x{w}y {w}{w}") for w in _REPEATED], "path long, text string")
    texts = corpus(spark, sf_dir, BENCHMARK).unionByName(planted)
    need = spark.createDataFrame([(w, bytearray(g)) for w in _REPEATED for g in sparse_covering(w.encode())], "word string, gram binary")
    due = texts.join(F.broadcast(need), F.contains("text", "word")).select(F.col("path").alias("file_id"), "word", "gram")
    held = explode_grams(texts, "path", "text", sparse=True).withColumn("held", F.lit(True))
    met = due.join(held, ["file_id", "gram"], "left")
    return met.groupBy("word").agg(F.count_distinct("file_id").alias("texts"), F.count_if(F.col("held").isNull()).alias("missing"))


# filters of a walk


@query("SELECT page_id AS path FROM pages WHERE page_id % 7 <> 0 OR (page_id % 2 = 0 AND strlen(html) >= 8192)")
def binary_filter(spark, sf_dir):
    """Every seventh page has a NUL: at its start, or, if its number is even, in place of its 8193rd byte or at its end."""
    html, odd = F.col("text").cast("binary"), F.col("path") % 7 == 0
    inside = F.concat(F.substring(html, 1, 8192), F.lit(b"\x00"), F.substring(html, 8194, 1 << 30))
    content = F.when(odd & (F.col("path") % 2 != 0), F.concat(F.lit(b"\x00"), html)).when(odd, inside).otherwise(html)
    files = corpus(spark, sf_dir, PAGES).select("path", F.octet_length("text").alias("length"), content.alias("content"))
    return keep_files(files, hidden=True).select("path")


@query("SELECT doc_id AS path, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents WHERE strlen(text) <= 1000")
def size_filter(spark, sf_dir):
    files = corpus(spark, sf_dir).select("path", F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"))
    return keep_files(files, largest=1000, hidden=True).select("path", F.col("length").alias("n_bytes"))


_PATHS = "CASE WHEN doc_id % 5 = 0 THEN '.cache/' ELSE 'src/' END || CASE WHEN doc_id % 7 = 0 THEN 'tmp/' ELSE '' END || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.log' ELSE '.txt' END"


@query(f"SELECT p AS path FROM (SELECT {_PATHS} AS p FROM documents) WHERE NOT regexp_matches(p, '(^|/)[.]')")
def hidden_filter(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(f"{_PATHS} AS path", "0 AS length", "CAST('' AS BINARY) AS content")
    return keep_files(files).select("path")


@query(f"SELECT p AS path FROM (SELECT {_PATHS} AS p FROM documents) WHERE NOT (regexp_matches(p, '(^|/)tmp/') OR (regexp_matches(p, '[.]log$') AND NOT regexp_matches(p, '^src/[^/]*3[.]log$')))")
def ignore_filter(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(f"{_PATHS} AS path")
    return files.filter(~ignored(F.col("path"), [("", "# build"), ("", "*.log"), ("src", "!/*3.log"), ("", "tmp/")]))


# changes over a base corpus

_CHANGED = """SELECT doc_id AS path, text FROM documents WHERE doc_id % 10 > 1
UNION ALL SELECT doc_id, text || chr(10) || 'FRESH_EDIT' FROM documents WHERE doc_id % 10 = 1
UNION ALL SELECT doc_id + 1000000, text FROM documents WHERE doc_id % 10 = 2"""


def _changes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every tenth document deleted, the next edited, the one after added again under another name; edits come twice."""
    base = corpus(spark, sf_dir)
    d = F.col("path") % 10
    row = lambda op, path, text, seq: F.struct(F.lit(op).alias("op"), path.alias("path"), text.alias("text"), F.lit(seq).cast("long").alias("seq"))
    p, t = F.col("path"), F.col("text")
    none = F.lit(None).cast("string")
    edit = F.array(row("M", p, F.lit("FRESH_EDIT early"), 1), row("M", p, F.concat(t, F.lit("\nFRESH_EDIT")), 2))
    made = F.when(d == 0, F.array(row("D", p, none, 1))).when(d == 1, edit).when(d == 2, F.array(row("A", p + 1000000, t, 1)))
    return base, base.select(F.inline(made))


@query(_matches_sql("License|FRESH_EDIT", _CHANGED))
def overlay_search(spark, sf_dir):
    return delta.search(*_changes(spark, sf_dir), "License|FRESH_EDIT")


@query(_matches_sql("License|FRESH_EDIT", _CHANGED))
def overlay_search_indexed(spark, sf_dir):
    """The base by its index and the changes by a layer's own."""
    base, changes = _changes(spark, sf_dir)
    return Overlay(changes, sparse=False).search(_index(spark, sf_dir), base.withColumn("file_id", F.col("path")), "License|FRESH_EDIT", planner.Override.TRIGRAM)


@query(f"SELECT path FROM ({_CHANGED}) WHERE (path % 10 = 1 OR path >= 1000000) AND contains(text, 'the') AND contains(text, 'and')")
def overlay_lookup(spark, sf_dir):
    """Paths of a layer's files that hold two grams, by its postings."""
    layer = Overlay(_changes(spark, sf_dir)[1], sparse=False)
    return layer.path_of(layer.all_of([b"the", b"and"])).select("path")


@query("""SELECT doc_id AS path, 'D' AS op, CAST(NULL AS BIGINT) AS n FROM documents WHERE doc_id % 10 = 0
UNION ALL SELECT doc_id, CASE doc_id % 10 WHEN 1 THEN 'M' ELSE 'A' END, CAST(strlen(text) AS BIGINT) FROM documents WHERE doc_id % 10 IN (1, 2)""")
def dirty_changes(spark, sf_dir):
    """Listed files as changes, with the texts of the live ones."""
    base = corpus(spark, sf_dir).withColumn("path", F.col("path").cast("string"))
    d = F.col("path").cast("long") % 10
    listed = base.filter(d < 3).select("path", F.when(d == 0, "Deleted").when(d == 1, "Modified").otherwise("Added").alias("status"))
    listed = listed.unionByName(spark.createDataFrame([(".gramsieve/grams/part-0", "Added"), ("no such file", "Modified")], "path string, status string"))
    return changes_of(listed, base).select(F.col("path").cast("long").alias("path"), "op", F.octet_length("text").cast("long").alias("n"))


_EDITED = """SELECT item_id AS file_id, text FROM benchmark WHERE item_id % 5 > 1
UNION ALL SELECT item_id + 1000, text || ' edited' FROM benchmark WHERE item_id % 5 = 1"""


@query(f"SELECT DISTINCT file_id, substr(h, 2 * i + 1, 6) AS gram FROM (SELECT file_id, hex(encode(text)) AS h, unnest(range(0, strlen(text) - 2)) AS i FROM ({_EDITED}))")
def compacted_postings(spark, sf_dir):
    """Postings after an update: of each five items one is deleted and one edited, which takes a new id."""
    items = corpus(spark, sf_dir, BENCHMARK).withColumnRenamed("path", "file_id")
    fresh = items.filter("file_id % 5 = 1").select((F.col("file_id") + 1000).alias("file_id"), F.concat("text", F.lit(" edited")).alias("text"))
    out = delta.compact(postings_of(items, sparse=False), items.filter("file_id % 5 < 2").select("file_id"), postings_of(fresh, sparse=False))
    return out.select("file_id", F.hex("gram").alias("gram"))


@query("SELECT doc_id AS path FROM documents WHERE doc_id % 10 = 0")
def overlay_deleted(spark, sf_dir):
    return delta.latest(_changes(spark, sf_dir)[1]).filter("op = 'D'").select("path")


@query(f"SELECT path, count(*) AS n FROM ({_matches_sql('the', _CHANGED)}) WHERE path % 10 = 1 GROUP BY path")
def overlay_modified_no_dup(spark, sf_dir):
    return delta.search(*_changes(spark, sf_dir), "the").filter("path % 10 = 1").groupBy("path").agg(F.count("*").alias("n"))


@query("""SELECT doc_id AS path, CASE doc_id % 10 WHEN 0 THEN 'Deleted' ELSE 'Modified' END AS status FROM documents WHERE doc_id % 10 < 2
UNION ALL SELECT doc_id + 1000000, 'Added' FROM documents WHERE doc_id % 10 = 2""")
def snapshot_diff(spark, sf_dir):
    base, changes = _changes(spark, sf_dir)
    return delta.diff(base, delta.merged(base, changes))


_D = "doc_id % 6"


@query(f"""SELECT 'd/' || doc_id || ' x.rs' AS path, CASE {_D} WHEN 0 THEN 'Modified' WHEN 1 THEN 'Added' WHEN 2 THEN 'Deleted' WHEN 3 THEN 'Added' ELSE 'Modified' END AS status FROM documents WHERE {_D} <> 4
UNION ALL SELECT 'd/' || doc_id || '.rs', 'Deleted' FROM documents WHERE {_D} = 4 UNION ALL SELECT 'e/' || doc_id || '.rs', 'Added' FROM documents WHERE {_D} = 4""")
def porcelain_parse(spark, sf_dir):
    """A line of short status for each document."""
    d, x = F.col("path") % 6, F.concat(F.lit("d/"), F.col("path"), F.lit(" x.rs"))
    line = F.when(d == 4, F.concat(F.lit("R  d/"), "path", F.lit(".rs -> e/"), "path", F.lit(".rs")))
    for k, code in ((0, " M"), (1, "??"), (2, " D"), (3, "A "), (5, "MM")):
        line = F.when(d == k, F.concat(F.lit(f"{code} "), x)).otherwise(line)
    return parse_porcelain(corpus(spark, sf_dir).select(line.alias("line")))


@query("SELECT 'a b/' || doc_id AS path, CASE doc_id % 4 WHEN 0 THEN 'Added' WHEN 1 THEN 'Deleted' ELSE 'Modified' END AS status FROM documents")
def name_status_parse(spark, sf_dir):
    letter = F.element_at(F.array(*map(F.lit, "ADMT")), (F.col("path") % 4 + 1).cast("int"))
    return parse_name_status(corpus(spark, sf_dir).select(F.concat(letter, F.lit("\ta b/"), "path").alias("line")))


# reports


@query("""WITH b AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'end/literal/' WHEN 1 THEN 'end/regex/' WHEN 2 THEN 'build/' ELSE 'other/' END || doc_id AS bench, CAST(doc_id % 41 AS DOUBLE) - 5.5 AS change_pct FROM documents),
k AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'end.literal' WHEN doc_id % 4 = 1 AND doc_id % 10 = 5 THEN 'end.regex' WHEN doc_id % 4 = 1 THEN 'build' WHEN doc_id % 4 = 2 THEN 'build' END AS key FROM b),
a AS (SELECT *, CAST(CASE key WHEN 'end.literal' THEN 10 WHEN 'end.regex' THEN 20 WHEN 'build' THEN 25 END AS DOUBLE) AS allowed_pct FROM k)
SELECT bench, change_pct, key, allowed_pct, CASE WHEN key IS NULL THEN 'unmapped' WHEN change_pct <= allowed_pct THEN 'pass' WHEN key = 'build' THEN 'warning' ELSE 'critical' END AS status FROM a""")
def budget_check(spark, sf_dir):
    """A measured change for each document, in both layouts, against three budgets."""
    d, i = F.col("path") % 4, F.col("path")
    bench = F.concat(F.when(d == 0, "end/literal/").when(d == 1, "end/regex/").when(d == 2, "build/").otherwise("other/"), i)
    change = F.concat(F.lit("change: [-9.0% "), F.format_string("%+.1f", (i % 41).cast("double") - 5.5), F.lit("% +99.0%]"))
    two = F.array(F.struct((2 * i).alias("n"), bench.alias("line")), F.struct((2 * i + 1).alias("n"), change.alias("line")))
    one = F.array(F.struct((2 * i).alias("n"), F.concat(bench, F.lit("  time: [1 ms 2 ms 3 ms] "), change).alias("line")))
    lines = corpus(spark, sf_dir).select(F.inline(F.when(i % 3 == 0, two).otherwise(one)))
    toml = "[end.literal]\nregression_pct = 10\ncritical = true\n[end.regex]\ncritical = true\n[build]\nthroughput_regression_pct = 25\ncritical = false\n"
    mapping = spark.createDataFrame([("end/literal/*", "end.literal", 0), ("end/*/*5", "end.regex", 1), ("end/regex/*", "build", 2), ("build/*", "build", 3)], "glob string, key string, place int")
    return budgets.check(budgets.parse_changes(lines), budgets.load_budgets(spark, toml), mapping)


@query("""WITH m AS (SELECT 'License' AS pattern, count(*) FILTER (regexp_matches(text, 'License')) AS scan_files FROM documents UNION ALL SELECT 'license', count(*) FILTER (regexp_matches(text, 'license')) FROM documents)
SELECT pattern, scan_files, scan_files AS index_files, false AS mismatch FROM m""")
def speedup_summary(spark, sf_dir):
    """Files by scan and by index for each pattern, and whether they differ; timings are bench.py's."""
    index, c = _index(spark, sf_dir), corpus(spark, sf_dir).withColumn("file_id", F.col("path"))
    parts = []
    for p in ("License", "license"):
        a = search.matching_files(c, p).agg(F.count("*").alias("scan_files"))
        b = index.search_files(c, p, planner.Override.TRIGRAM).agg(F.count("*").alias("index_files"))
        parts.append(a.join(b).select(F.lit(p).alias("pattern"), "scan_files", "index_files", (F.col("scan_files") != F.col("index_files")).alias("mismatch")))
    return parts[0].unionByName(parts[1])


@query("""SELECT doc_id AS path, CASE WHEN b >= 1048576 THEN printf('%.1f MB', floor(b / 104857.6 + 0.5) / 10) WHEN b >= 1024 THEN printf('%.1f KB', floor(b * 10 / 1024.0 + 0.5) / 10) ELSE b || ' B' END AS size FROM (SELECT doc_id, strlen(text) AS b FROM documents)""")
def human_sizes(spark, sf_dir):
    return corpus(spark, sf_dir).select("path", budgets.human_bytes(F.octet_length("text")).alias("size"))
