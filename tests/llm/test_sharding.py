import zlib

from gramsieve.llm import sharding

ROWS = [(i, f"text {i % 50}" * (i % 9), "clash", None) for i in range(2000)] + [(None, "no id", "clash", None)] * 5 + [(7, "again", "clash", 1)] * 3 + [(9, None, "clash", 1)]
SCHEMA = "doc_id long, text string, SHARD string, slot int"


def key(r):
    return (str(r.doc_id), r.text or "", r.shard, r.slot, r.grown_shard)


def test_places(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = sharding.assign(df, 24, bucket_bytes=100).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert max(r.bucket for r in got) > 0
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(r.grown_shard in (r.shard, 24) for r in got) and any(r.grown_shard == 24 for r in got)
    order = [r.doc_id for r in sorted(by[3], key=lambda r: r.slot) if r.doc_id is not None]
    assert order != sorted(order)
    again = sharding.assign(df.repartition(7), 24, bucket_bytes=100).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))
    more = {r.doc_id: r.shard for r in sharding.assign(df, 25).collect()}
    assert all(more[r.doc_id] == r.grown_shard for r in got)


def test_write_and_empty(spark, tmp_path):
    out = sharding.assign(spark.createDataFrame(ROWS, SCHEMA), 4)
    sharding.write(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(ROWS)
    assert sharding.assign(spark.createDataFrame([], SCHEMA), 4).count() == 0


def test_query(spark):
    from gramsieve.llm.queries import op6_sharding

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op6_sharding(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
