import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from ordercast.llm import warc
from ordercast.llm.common import new_path

PAGES = "page_id long, url string, html string"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expect(rows, min_bytes=0):
    best = {}
    for page_id, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= min_bytes and best[html or ""] != page_id
        out.append((page_id, len(data), digest(data), "revisit" if revisit else "response", best[html or ""] if revisit else None))
    return sorted(out)


def pages(n=120):
    return [(k, f"http://host/{k}\n", "é" * (k % 7) + "x" * (k % 3) if k % 5 else None) for k in range(n)]


def columns(df):
    return sorted(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame(rows, PAGES)
    assert columns(warc.round_trip(df, shard_bytes=100, roll_bytes=2000)) == expect(rows)
    assert columns(warc.round_trip(df, min_bytes=4)) == expect(rows, 4)


def test_files(spark):
    df = spark.createDataFrame(pages(), PAGES)
    paths = [new_path(spark, "warc") for _ in range(2)]
    listed = [warc.write(d, p, shard_bytes=100, roll_bytes=2000).collect() for d, p in zip((df, df.repartition(7)), paths)]
    # The same pages, however they are dealt, give the same files.
    assert sorted(listed[0]) == sorted(listed[1]) and len(listed[0]) > 5
    last = -1
    for row in sorted(listed[0], key=lambda r: r.file):
        with open(f"{paths[0].removeprefix('file://')}/{row.file}", "rb") as file:
            data = file.read()
        assert len(data) == row.bytes <= 2000 and hashlib.sha1(data).hexdigest() == row.sha1
        assert last < row.first_page <= row.last_page
        last = row.last_page
        records = gzip.decompress(data).split(b"WARC/1.1\r\n")[1:]
        assert len(records) == row.records + 1 and records[0].startswith(b"WARC-Type: warcinfo")
    offsets = warc.read(spark, paths[0]).where("offset > 0").select("file", "offset").first()
    with open(f"{paths[0].removeprefix('file://')}/{offsets.file}", "rb") as file:
        file.seek(offsets.offset)
        assert gzip.GzipFile(fileobj=file).read(8) == b"WARC/1.1"


def test_files_outside_of_the_manifest_do_not_count(spark):
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame(pages(10), PAGES), path)
    with open(f"{path.removeprefix('file://')}/pages-999999-00000.warc.gz", "wb") as file:
        file.write(b"left by a task that was lost")
    assert warc.read(spark, path).count() == 10


def test_odd_rows(spark):
    big = (1 << 60) + 1
    rows = [(None, None, None), (1, "a", "q"), (1, "a", "q"), (1, "b", "z"), (big, None, "q"), (None, "u", "q"), (None, "u", "only"), (3, "l", "long " * 200_000)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'own' as kind", "'own' as shard", "'own' as file")
    found = [tuple(r)[:1] + tuple(r)[4:6] for r in warc.round_trip(df).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(found, key=key) == sorted(
        [(None, "response", None), (1, "revisit", big), (1, "revisit", big), (1, "response", None), (big, "response", None)]
        + [(None, "revisit", big), (None, "response", None), (3, "response", None)],
        key=key,
    )
    twice = warc.round_trip(spark.createDataFrame([(5, "a", "q"), (5, "a", "q")], PAGES)).collect()
    assert sorted((r.record_type, r.refers_to) for r in twice) == [("response", None), ("revisit", 5)]
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_files_are_read_by_tasks_of_their_own(spark, tmp_path):
    pages = spark.range(60).selectExpr("id as page_id", "concat('http://x/', id) as url", "concat(repeat(sha2(cast(id as string), 512), 20), id) as html")
    path = f"file://{tmp_path}/w"
    files = warc.write(pages, path, shard_bytes=20_000).count()
    back = warc.read(spark, path)
    assert files >= 6 and back.rdd.getNumPartitions() == files
    held = back.select(F.spark_partition_id().alias("task"), "file").distinct()
    assert held.select("task").distinct().count() == files == held.count()
    assert sorted(r.page_id for r in back.collect()) == list(range(60))
