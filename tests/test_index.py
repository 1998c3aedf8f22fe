import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gramsieve.functions import grams
from gramsieve.operators import index as ix
from gramsieve.operators.search import find_matches, verify
from gramsieve.plans import planner

#: Poems of a made-up garden: names that recur, repeated marks, an empty file, one without line ends, letters beyond ASCII.
FILES = [
    ("beds/rose.txt", "red rose, rose tree\nprune_late(march)\n----- end -----\n"),
    ("beds/tulip.txt", "bulbs: 40\nplant_early(october); plant_deep(12)\n"),
    ("notes", "Überwinterung im Gewächshaus\n    four spaces\n"),
    ("tools/empty.txt", ""),
    ("tools/rake.txt", "rake;rake;rake"),
    ("tools/spade.txt", "depth = 12\ndepth = 30\nROSE spade"),
]
PATTERNS = [
    "rose", "(?i)rose", "rose tree|spade", r"plant_\w+\(", r"(?m)^depth = \d+$", r"\d{2}", "-----", "    ", "Gew(ä|ae)chshaus", "ra(ke;)+", "nothing of the kind",
    "prune_(late|early)", "(?:red |ROSE )?rose|spade", r"\bim\b", "b[aeu]lbs: 40|bulbs",
]


@pytest.fixture(scope="module")
def corpus(spark):
    return ix.number_files(spark.createDataFrame(FILES, "path string, text string")).cache()


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("index") / "i")
    ix.build(corpus, target, base="abc")
    return ix.Index.open(spark, target)


def test_ids_follow_paths(corpus):
    assert [(r.file_id, r.path) for r in corpus.orderBy("file_id").collect()] == list(enumerate(p for p, _ in sorted(FILES)))


def test_ids_of_many_wide_files(spark):
    """Wide rows, for which Spark joins small partitions; equal paths and none."""
    df = spark.range(400).select(F.when(F.col("id") % 50 != 7, F.concat(F.lit("d/"), F.col("id") % 333)).alias("path"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 600).alias("text"))
    got = ix.number_files(df.repartition(13), ranges=9).select("path", "file_id").orderBy("file_id").collect()
    assert [r.file_id for r in got] == list(range(400))
    assert [r.path for r in got] == sorted((r.path for r in got), key=lambda p: (p is not None, p or ""))
    assert ix.number_files(df.limit(0)).count() == 0


def test_search_equals_scan(corpus, index):
    for p in PATTERNS:
        want = sorted(find_matches(corpus, p).collect())
        for override in planner.Override:
            assert sorted(index.search(corpus, p, override).collect()) == want, (p, override)


def test_lookups(spark, index):
    assert index.contains(b"ros") and not index.contains(b"QQQ")
    assert index.all_of([]).count() == 6 and index.any_of([]).count() == 0
    assert {r.file_id for r in index.all_of([b"ros", b"red"]).collect()} == {0}
    assert {r.file_id for r in index.any_of([b"rak", b"ROS"]).collect()} == {4, 5}
    assert [r.path for r in index.path_of(spark.createDataFrame([(2,), (99,)], "file_id long")).collect()] == ["notes"]
    assert index.frequencies([b"ros", b"QQQ"]) == {b"ros": 1}
    n = index.grams.count()
    counts = index.counts().head()
    assert (counts.file_count, counts.source_bytes, counts.ngram_count, counts.sparse_count, counts.trigram_only_count) == (6, sum(len(t.encode()) for _, t in FILES), n, n, 0)


def test_counted_search_and_verification(corpus, index):
    row = index.search_counted(corpus, "rose", planner.Override.TRIGRAM).head()
    assert (row.strategy, row.lookups, row.files, row.candidates, row.files_matched, row.matches) == ("trigram", 2, 6, 1, 1, 2)
    assert row.bytes_read == len(FILES[0][1].encode()) and 0 <= row.plan_seconds <= row.seconds
    assert {r.file_id for r in verify(corpus, "12").collect()} == {1, 5} and verify(corpus, "[bad").count() == 0


def test_damage_is_found(spark, corpus, tmp_path):
    target = str(tmp_path / "i")
    ix.build(corpus, target, sparse=False)
    opened = ix.Index.open(spark, target)
    assert not opened.sparse and opened.counts().head().sparse_count == 0
    rows = {"postings": opened.postings.limit(5), "files": opened.files.limit(2), "grams": opened.grams.limit(1)}
    rows = {name: spark.createDataFrame(few.collect(), few.schema) for name, few in rows.items()}
    for name, few in rows.items():
        ix.build(corpus, target, sparse=False)
        few.write.mode("overwrite").parquet(f"{target}/{name}")
        with pytest.raises(ix.IndexError_):
            ix.Index.open(spark, target)
    spark.read.parquet(f"{target}/manifest").withColumn("version", F.lit(99)).write.parquet(f"{target}/m2")
    spark.read.parquet(f"{target}/m2").write.mode("overwrite").parquet(f"{target}/manifest")
    with pytest.raises(ix.IndexError_):
        ix.Index.open(spark, target, check=False)


def test_encoded_lists(spark):
    random.seed(8)
    ids = {b"few": [0], b"gap": [0, 127, 128, 20_000, 32_767, 32_768, 2_500_000], b"all": list(range(40_000)), b"any": sorted(random.sample(range(200_000), 3000))}
    postings = spark.createDataFrame([(bytearray(g), i) for g, x in ids.items() for i in x], "gram binary, file_id long")
    want = sorted((g, i) for g, x in ids.items() for i in x)
    for form in (None, ix.FIXED, ix.VARINT, ix.BITMAP):
        blocks = ix.encode_postings(postings, form)
        assert sorted((bytes(r.gram), r.file_id) for r in ix.decode_postings(blocks).collect()) == want
        assert form is None or {bytes(r.data)[0] for r in blocks.collect()} == {form}
    sizes = {(bytes(r.gram), r.bucket): (r.n, len(r.data)) for r in ix.encode_postings(postings).collect()}
    assert sizes[(b"few", 0)] == (1, 2) and sizes[(b"all", 0)] == (32768, 4097)
    odd = spark.createDataFrame([(bytearray(b"x"), 0, bytearray(b"")), (bytearray(b"y"), 0, bytearray(b"\x09abc"))], "gram binary, bucket long, data binary")
    assert ix.decode_postings(odd).count() == 0


def test_sparse_grams():
    random.seed(2)
    for _ in range(1500):
        t = bytes(random.choices(random.choice([b"ab", b"abcd-=", bytes(range(256))]), k=random.randint(0, 40)))
        a = random.randint(0, len(t))
        b = random.randint(a, len(t))
        w = grams.pair_weights(t)
        plain = {t[i : j + 2] for i in range(len(w)) for j in range(i, len(w)) if j <= i + 1 or min(w[i], w[j]) > max(w[i + 1 : j])}
        assert set(grams.sparse_all(t)) == plain and set(grams.trigrams(t)) <= plain
        literal, cover = t[a:b], grams.sparse_covering(t[a:b])
        assert set(cover) <= plain
        assert all(any(literal[i : i + 2] in g for g in cover) for i in range(len(literal) - 1))


def test_plans(index):
    p = planner.plan("spring garden", planner.Override.TRIGRAM)
    assert p.lookups == 11 and abs(p.cost - 11 * 1.12) < 1e-9
    assert planner.plan(r"\d{3}").lookups == 0 and planner.plan(r"\d{3}", planner.Override.SPARSE).strategy is planner.Strategy.TRIGRAM
    assert planner.by_frequency({b"abc": 5}, 10)(b"abc") == 0.5 and planner.by_frequency({}, 10)(b"abc") == 1.0
    # the index's own plan goes by its frequencies: every gram is in one file of six
    own = index.plan("rose tree")
    assert abs(own.cost - own.lookups * (1 / 6 + planner.LOOKUP)) < 1e-9


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "file_id long, path string, text string")
    i = ix.Index(none, ix.postings_of(none))
    assert i.stats().head().asDict() == {"ngram_count": 0, "mean_df": 0.0, "median_df": 0, "p95_df": 0, "p99_df": 0, "max_df": 0, "over_1000": 0, "over_10000": 0}


def test_grams_of_many_texts():
    """Texts side by side have the grams of each alone, with pairs near and far, in one part or in several."""
    random.seed(4)
    texts = [bytes(random.choices(random.choice([b"ab", b"aab", b"abcd-=", bytes(range(256))]), k=k)) for k in (0, 1, 2, 3, 40, 700, 3000) for _ in range(4)]
    texts += [None, b"ab" * 300, b"a" * 300, bytes(range(256)) * 3, "Gewächshaus ".encode() * 40]
    random.shuffle(texts)
    ids = np.arange(len(texts)) * 7 - 20
    for sparse, plain in ((True, grams.sparse_all), (False, grams.trigrams)):
        want = sorted((int(i), g) for i, t in zip(ids, texts, strict=True) for g in plain(t or b""))
        for step in (1 << 19, 100):
            parts = grams.gram_pairs(ids, pa.array(texts, pa.binary()), sparse, step)
            assert sorted((i, g) for names, at, of in parts for i, g in zip(of.tolist(), names.take(pa.array(at)).to_pylist(), strict=True)) == want


def test_postings_lie_in_blocks(spark, tmp_path):
    """A build reads texts twice, for files and for grams, and a gram's files lie in few rows; any ids come back."""
    ids = [0, 1, 127, 128, 129, 1 << 40, (1 << 63) - 1, -(1 << 63), -5]
    read = spark.sparkContext.accumulator(0)
    text = F.udf(lambda i: (read.add(1), f"a rose {i % 3}")[1])
    files = spark.createDataFrame([(i,) for i in ids], "file_id long").coalesce(1).select("file_id", F.col("file_id").cast("string").alias("path"), text("file_id").alias("text"))
    target = str(tmp_path / "i")
    ix.build(files, target)
    assert read.value <= 2 * len(ids)
    opened = ix.Index.open(spark, target)
    assert sorted(r.file_id for r in opened.lookup([b"ros"]).collect()) == sorted(ids)
    want = sorted((r.file_id, bytes(r.gram)) for r in ix.postings_of(files).collect())
    assert sorted((r.file_id, bytes(r.gram)) for r in opened.postings.collect()) == want
    assert ix.pack(opened.postings.coalesce(1)).count() == opened.grams.count() and opened.frequencies([b"ros"]) == {b"ros": len(ids)}
    few = spark.createDataFrame(list(range(40)), "long").select(F.lit(b"abc").alias("gram"), F.col("value").alias("file_id")).coalesce(1)
    assert ix.pack(few.repartition(8), most=2).count() > 3
    for at_once in (1, 7, 1000):
        small = ix.unpack(ix.pack(opened.postings, most=2).unionByName(ix.pack(few)), at_once)
        assert sorted((r.file_id, bytes(r.gram)) for r in small.collect()) == sorted(want + [(i, b"abc") for i in range(40)])
    saved = spark.read.parquet(f"{target}/manifest").withColumn("version", F.lit(3)).collect()
    spark.createDataFrame(saved, spark.read.parquet(f"{target}/manifest").schema).write.mode("overwrite").parquet(f"{target}/manifest")
    with pytest.raises(ix.IndexError_):
        ix.Index.open(spark, target, check=False)
    # an index of version 3 held a row for each posting
    rows = spark.createDataFrame([(bytearray(g), i) for i, g in want], "gram binary, file_id long")
    rows.write.mode("overwrite").parquet(f"{target}/postings")
    sums = rows.agg(ix._checksum("gram", "file_id").alias("postings_checksum")).head()[0]
    spark.createDataFrame(saved, spark.read.parquet(f"{target}/manifest").schema).withColumn("postings_checksum", F.lit(sums)).write.mode("overwrite").parquet(f"{target}/manifest")
    assert ix.Index.open(spark, target).all_of([b"ros", b"e 1"]).count() == sum(i % 3 == 1 for i in ids)


def test_a_build_deals_texts_over_tasks(spark, tmp_path):
    """A table of one row group, whose texts one task would take, is indexed by many, and by more the larger it is."""
    files = spark.range(300).select(F.col("id").alias("file_id"), F.concat(F.lit("posted "), "id").alias("text")).coalesce(1)
    files.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.rdd.getNumPartitions() == 1
    cores = spark.sparkContext.defaultParallelism
    tasks = ix.blocks_of(table, sparse=False).select(F.spark_partition_id().alias("p")).distinct().count()
    assert cores < tasks <= 3 * cores
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        unknown = spark.createDataFrame(table.rdd, table.schema)  # of any size, as Spark knows none
        assert ix.blocks_of(unknown, sparse=False).rdd.getNumPartitions() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
