import glob
import gzip
import hashlib
import random

from gramsieve.llm import queries, warc


def pages():
    random.seed(2)
    noise = "".join(chr(random.randint(32, 0x2FFF)) for _ in range(400_000))
    big = "<p>same</p>" * 200
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (5, None, big), (5, "http://a/5", big), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", noise), (9, "u", "é" * 500)]
    return [(*r, "clash", 1) for r in rows + [(None, "u", big)] + [(100 + i, f"u{i}", noise[i * 900 : i * 900 + 5000]) for i in range(300)]]


SCHEMA = "page_id long, url string, html string, payload string, record_type int"


def test_round_trip_over_many_ranges(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    path = str(tmp_path / "w")
    warc.write(df, path)
    plain = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{path}/part-*"))
    assert plain.count(b"WARC/1.1\r\n") == len(rows)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in ("128m", "10000", "777"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = warc.read(spark, path).collect()
            assert len(got) == len(rows), size
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    kinds = {}
    for r in got:
        kinds.setdefault(r.record_id, []).append(r)
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        for r in kinds[f"<urn:page:{i}>"]:
            assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
            if i in (1, 2, None):
                assert r.record_type == "revisit" and r.refers_to == "<urn:page:5>" and r.payload is None
            else:
                assert r.record_type == "response" and r.refers_to is None and bytes(r.payload) == data


def test_magic_inside_a_member_and_at_the_end_of_a_range():
    """Members whose compressed bytes hold the magic are joined again, within a range and across ranges."""
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\n" + b"abc\x1f\x8b\x08def" + b"\r\n\r\n"
    stored = gzip.compress(record, 0, mtime=0)
    pieces = (stored * 3).split(warc.MAGIC)
    assert len(pieces) == 7
    scan = warc._Scan("f", 0)
    for p in pieces:
        scan.take(p)
    scan.close()
    assert len(scan.records) == 3 and not scan.parts
    first, second = warc._Scan("f", 0), warc._Scan("f", 100)
    for p in pieces[:4]:
        first.take(p)
    for p in pieces[4:]:
        second.take(p)
    first.close()
    second.close()
    assert (len(first.records), len(second.records)) == (1, 1)
    assert [p[3] for p in first.parts + second.parts] == [True, False]
    assert warc._inflate(first.parts[0][4] + second.parts[0][4])[1]


def test_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_with_a_null_id(spark, tmp_path):
    rows = [(None, "u", "x" * 1200), (4, "u", "x" * 1200), (None, None, None), (7, None, "short")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in queries.op4_warc(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(-1, 1200, "revisit", 4), (4, 1200, "response", None), (-1, 0, "response", None), (7, 5, "response", None)], key=str)
