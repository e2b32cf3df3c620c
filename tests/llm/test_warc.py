import base64
import hashlib
import os

import pytest

from pathloom.llm import warc

PAGES = "page_id long, url string, html string"
INNER = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def expected(rows, least=0):
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    first = {}
    for page_id, _, html in rows:
        key = html or ""
        if len(key.encode()) >= least and page_id is not None:
            first[key] = min(first.get(key, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        refers = first.get(html or "", page_id)
        revisit = page_id is not None and refers != page_id
        out.append((page_id, len(data), digest(data), "revisit" if revisit else "response", refers if revisit else None))
    return sorted(out, key=repr)


ROWS = [
    (5, "http://a/\r\nX: y", "<p>one</p>"), (3, None, "<p>one</p>"), (3, "again", "<p>one</p>"), (9, "u", None), (8, "u", ""), (None, "u", "no id"),
    (10, "u", "x " + INNER + " tail"), (11, "u", INNER * 5), (12, "u", "WARC/1.0\r\n"), (13, "é", "é\r\n\r\nWARC/1.0\r\n" * 300),
    (14, "u", "\r\n\r\n"), (15, "u", "long " * 40_000), (16, "u", INNER * 5), (17, "u", "WARC/1.0\r\nContent-Length: 99999\r\n\r\nx"),
]


@pytest.mark.parametrize("split", ["128m", "500b", "3k"])
@pytest.mark.parametrize("files", [1, 4])
def test_round_trip(spark, tmp_path, split, files):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        path = f"{tmp_path}/archives"
        warc.write_archives(spark.createDataFrame(ROWS, PAGES).coalesce(1).repartition(files), path)
        found = warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        assert sorted(map(tuple, found.collect()), key=repr) == expected(ROWS)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_small_payloads_are_all_responses(spark, tmp_path):
    path = f"{tmp_path}/archives"
    warc.write_archives(spark.createDataFrame(ROWS, PAGES), path, min_revisit_bytes=100)
    found = warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, found.collect()), key=repr) == expected(ROWS, 100)


def test_a_damaged_archive_is_an_error(spark, tmp_path):
    path = f"{tmp_path}/archives"
    warc.write_archives(spark.createDataFrame(ROWS, PAGES).coalesce(1), path)
    (name,) = [n for n in os.listdir(path) if n.startswith("part-")]
    with open(f"{path}/{name}", "rb") as file:
        data = file.read()
    os.mkdir(f"{tmp_path}/cut")
    with open(f"{tmp_path}/cut/part", "wb") as file:
        file.write(data[:-9])
    with pytest.raises(ValueError, match="damaged"):
        warc.read_archives(spark, f"{tmp_path}/cut").collect()


def test_empty(spark, tmp_path):
    path = f"{tmp_path}/archives"
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.read_archives(spark, path).collect() == []
