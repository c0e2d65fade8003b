"""An exact round trip through the archives."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import SparkSession

from chainmark.llm import warc
from chainmark.llm.work import Workspace

BIG = "<p>é" + "x" * 2000


def pages() -> list[tuple]:
    out = [(i, f"http://h{i % 3}.example.com/p{i % 7}?q={i}", f"<html>{i}</html>", "clash") for i in range(40)]
    out += [(100 + i, "https://User@Sub.Example.org:80/same", BIG, "clash") for i in range(6)]
    out += [(200, "http://a.com/1", "short"), (201, "http://a.com/2", "short"), (300, None, None), (301, "not a url\n", ""), (105, "https://User@Sub.Example.org:80/same", BIG), (None, "http://n.org", BIG), (400, "http://z.com", "y" * 300_000)]
    return [(*x, "clash")[:4] for x in out]


def test_round_trip(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    data = pages()
    df = spark.createDataFrame(data, "page_id long, url string, html string, key string").repartition(4)
    found = warc.archive(df).collect()
    want = []
    for i, _, html, _ in data:
        body = (html or "").encode()
        ids = [j for j, _, h, _ in data if (h or "").encode() == body and j is not None]
        revisit = len(body) >= 1000 and len([1 for _, _, h, _ in data if h == html]) > 1 and i != max(ids)
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == sorted(want, key=repr)


def test_lookup_by_url(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    df = spark.createDataFrame(pages(), "page_id long, url string, html string, key string")
    work = Workspace(spark, "t")
    records = warc.write(df, work)
    directory = warc.index(records, work)
    asked = df.where("page_id in (3, 17, 105, 400)").select("page_id", warc.url_key(df["url"]).alias("key"))
    got = {(r.page_id, r.payload) for r in warc.lookup(directory, asked).collect()}
    assert got == {(i, h) for i, _, h, _ in pages() if i in (3, 17, 105, 400)}
    none = spark.createDataFrame([(9999, "com,nowhere)/")], "page_id long, key string")
    assert warc.lookup(directory, none).count() == 0


def test_keys(spark: SparkSession) -> None:
    df = spark.createDataFrame([("https://User@Sub.Example.org:80/same?a",), ("x",), (None,)], "url string")
    assert [r.k for r in df.select(warc.url_key(df["url"]).alias("k")).collect()] == ["org:80,example,sub)/same?a", "x", ""]


def test_empty(spark: SparkSession) -> None:
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive(df).count() == 0
