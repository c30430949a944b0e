from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random

import pytest

from pyspark.sql import functions as F

from commutelens.llm import warc
from commutelens.llm.queries import op5_warc
from conftest import SMALL

SCHEMA = "page_id bigint, url string, html string, digest string"


def expected(rows):
    top = {}
    for i, _, html in rows:
        if i is not None:
            top[html or ""] = max(top.get(html or "", i), i)
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        first = top.get(html or "")
        twice = sum((h or "") == (html or "") for _, _, h in rows) > 1
        refers = first if twice and first is not None and (i is None or i < first) else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, url, "revisit" if refers is not None else "response", refers, len(data), digest))
    return sorted(out, key=repr)


def stored(spark, rows, folder, archive_bytes=2000):
    pages = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    monoliths = warc.write(pages, f"{folder}/raw", archive_bytes)
    monoliths = spark.createDataFrame(monoliths.collect(), warc.ARCHIVE_SCHEMA)
    return monoliths, spark.createDataFrame(warc.normalise(monoliths, f"{folder}/norm").collect(), warc.ARCHIVE_SCHEMA)


def test_round_trip(spark, tmp_path):
    draw = random.Random(5)
    rows = [(i, f"http://h/{i}?a=%20 é\r\n", draw.choice(["", "same", "<p>é\r\n\r\nWARC/1.1\r\n" * draw.randint(1, 200)])) for i in range(60)]
    rows += [(None, None, "same"), (None, "u", None), (70, "dup", "tied"), (70, "dup", "tied"), (3, "u", "x" * 300_000)]
    monoliths, archives = stored(spark, rows, str(tmp_path))
    got = warc.read(warc.index_of(archives)).collect()
    assert sorted([tuple(r)[:6] for r in got], key=repr) == expected(rows)
    payloads = {(r.page_id, r.url): bytes(r.payload) for r in got if r.record_type == "response"}
    assert payloads[3, "u"] == b"x" * 300_000
    for r in archives.collect():
        whole = gzip.decompress(open(r.archive.removeprefix("file:"), "rb").read())
        source = r.archive.replace("/norm/", "/raw/")
        assert whole == gzip.decompress(open(source, "rb").read())
        assert whole.count(b"WARC-Record-ID: ") == r.records


def test_reads_members_of_any_layout():
    records = [warc.record_bytes(i, "u", b"p" * i, "D", "response", None) for i in range(50)]
    for cut in (1, 7, 50):
        data = b"".join(gzip.compress(b"".join(records[a : a + cut])) for a in range(0, 50, cut))
        assert list(warc.records_of(io.BytesIO(data))) == records
    with pytest.raises(EOFError):
        list(warc.records_of(io.BytesIO(gzip.compress(b"".join(records))[:-40])))


def test_empty_table(spark, tmp_path):
    assert warc.write(spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0


def test_query_over_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html").collect()]
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in op5_warc(spark, SMALL).collect()]
    assert sorted(got, key=repr) == sorted([(i, k, f, n, d) for i, _, k, f, n, d in expected(rows)], key=repr)


def test_tasks_grow_with_the_number_of_archives(spark, tmp_path):
    rows = [(i, f"u{i}", f"{i} " * 500, None) for i in range(300)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    raw = str(tmp_path / "raw")
    warc.write(pages, raw, archive_bytes=3000).write.parquet(str(tmp_path / "list"))
    listed = spark.read.parquet(str(tmp_path / "list"))
    count = listed.count()
    normal = warc.normalise(warc.dealt(listed), str(tmp_path / "norm"))
    used = normal.withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    assert count > 50 and used > count / 3
