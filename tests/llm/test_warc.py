"""Records read back equal what was written; exported files are WARC to a plain reader; damage stops the job."""

import glob
import hashlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import warc

LONG = "<html><p>é 日本 " + "words and words " * 20 + "</p></html>"
ROWS = [
    (5, "http://a/1", LONG), (3, "http://a/2", LONG), (9, None, LONG), (None, "http://n", LONG), (7, "http://b", "x" * 99), (8, "http://b", "x" * 99), (10, "u", "y" * 100), (11, "u", "y" * 100),
    (12, "u\r\nWARC-Type: revisit", None), (13, "", ""), (14, "http://c", "WARC/1.1\r\nWARC-Type: revisit\r\n\r\n" + "z\r\n\r\n" * 40), (15, "d", "\r\n\r\n" * 30), (3, "http://again", LONG), (16, "e", "q" * 300_000), (17, "e", None),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "mine", b"x") for r in rows], "page_id long, url string, html string, record int, digest string, payload binary")


def by_hand(rows):
    first = {}
    for i, (page_id, _, html) in enumerate(rows):
        key = (page_id is None, page_id or 0, i)
        first[html or ""] = min(first.get(html or "", key), key)
    out = []
    for i, (page_id, _, html) in enumerate(rows):
        data = (html or "").encode()
        own = len(data) < 100 or first[html or ""][2] == i
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "response" if own else "revisit", None if own else rows[first[html or ""][2]][0]))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


def test_round_trip(spark):
    assert ordered(map(tuple, warc.round_trip(pages(spark, ROWS)).collect())) == ordered(by_hand(ROWS))
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_a_hot_payload_is_stored_once(spark, tmp_path):
    rows = [(i, f"u{i}", LONG if i % 3 == 0 else None if i % 3 == 1 else f"{LONG}{i}") for i in range(9000)]
    warc.write(pages(spark, rows), str(tmp_path / "a"))
    stored = spark.read.parquet(str(tmp_path / "a/payloads"))
    assert stored.count() == 3002 == stored.select("digest").distinct().count()
    assert ordered(map(tuple, warc.parsed(warc.records(spark, str(tmp_path / "a"))).collect())) == ordered(by_hand(rows))


def plain_reader(data):
    """Records of a WARC file by the lengths that their headers name."""
    at, out = 0, []
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines[1:])
        block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
        at = end + 4 + len(block)
        assert data[at : at + 4] == b"\r\n\r\n"
        at += 4
        http, payload = block.split(b"\r\n\r\n", 1)
        assert http.startswith(b"HTTP/1.1 200 OK\r\n")
        out.append((fields, payload))
    return out


def test_exported_files_are_warc(spark, tmp_path):
    warc.write(pages(spark, ROWS), str(tmp_path / "a"))
    warc.export(spark, str(tmp_path / "a"), str(tmp_path / "files"))
    found = [r for f in glob.glob(str(tmp_path / "files/part-*")) for r in plain_reader(open(f, "rb").read())]
    ids = {f["WARC-Record-ID"]: f for f, _ in found}
    assert len(ids) == len(found) == len(ROWS)
    full = {hashlib.sha256(p).hexdigest() for f, p in found if f["WARC-Type"] == "response"}
    assert full == {hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in ROWS}
    for fields, payload in found:
        if fields["WARC-Type"] == "revisit":
            assert payload == b"" and ids[fields["WARC-Refers-To"]]["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]
        else:
            assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
    assert {f.get("WARC-Target-URI") for f, _ in found} >= {None, "u%0D%0AWARC-Type: revisit"}


@pytest.mark.parametrize("damage", ["changed", "lost", "header"])
def test_damage_stops_the_job(spark, tmp_path, damage):
    path = str(tmp_path / "a")
    warc.write(pages(spark, ROWS), path)
    part = "headers" if damage == "header" else "payloads"
    rows = spark.read.parquet(f"{path}/{part}")
    if damage == "changed":
        rows = rows.withColumn("payload", F.when(F.octet_length("payload") == 100, F.lit(b"y" * 99 + b"z")).otherwise(F.col("payload")))
    elif damage == "lost":
        rows = rows.filter(F.octet_length("payload") != 100)
    else:
        rows = rows.withColumn("header", F.regexp_replace("header", r"Content-Length: (\d+)\r\n\r\nHTTP", "Content-Length: 1$1\r\n\r\nHTTP"))
    rows.write.parquet(f"{path}-damaged/{part}")
    other = "payloads" if part == "headers" else "headers"
    spark.read.parquet(f"{path}/{other}").write.parquet(f"{path}-damaged/{other}")
    with pytest.raises(Exception, match="lost or changed|differs from its header"):
        warc.parsed(warc.records(spark, f"{path}-damaged")).collect()
