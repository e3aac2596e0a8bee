import gzip
import hashlib
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from rankloom.llm import warc


def write(spark, rows, path, **options):
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, payload int"), path, **options)


BIG, SMALL = "x" * 999 + "é", "y" * 998
ROWS = [(1, "http://a/1", BIG, 0), (5, "http://a/2\r\nWARC-Type: evil", BIG, 0), (3, None, BIG, 0), (7, "u", SMALL, 0), (8, "u", SMALL, 0), (9, "u", None, 0), (10, "u", "", 0), (None, "u", BIG, 0), (11, "u", "WARC/1.1\r\n\r\nWARC/1.1\n" * 100, 0), (12, "u", "z" * 3_000_000, 0), (13, "u", "z" * 3_000_000, 0), (13, "u", "z" * 3_000_000, 0)]


def test_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    write(spark, ROWS, path)
    found = warc.read_archives(spark, path).collect()
    assert len(found) == len(ROWS)
    by = {}
    for r in found:
        by.setdefault(r["record_id"], []).append(r)
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    for i, _, html, _ in ROWS:
        (r, *_) = by[name(i)]
        body = (html or "").encode()
        same = [p for p, _, h, _ in ROWS if (h or "") == (html or "") and p is not None]
        again = len(body) >= 1000 and i != max(same)
        assert r["record_type"] == ("revisit" if again else "response")
        assert r["refers_to"] == (name(max(same)) if again else None)
        assert r["full_length"] == len(body) and r["payload_digest"] == "sha1:" + hashlib.sha1(body).hexdigest()
        assert bytes(r["payload"]) == (b"" if again else body) and r["content_length"] == len(r["payload"])
    assert len(by[name(13)]) == 2
    assert len(list(tmp_path.glob("archive/_files-*.json"))) == 1


def test_files_of_tasks_that_were_not_committed_do_not_count(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    write(spark, ROWS[:4], path)
    (name,) = tmp_path.glob("archive/_files-*.json")
    own = json.loads(name.read_text())
    for job in (own[0][5:37], "0" * 32):  # a repeated task, and a job that never ended
        other = tmp_path / "archive" / f"part-{job}-{'1' * 32}.warc.gz"
        other.write_bytes((tmp_path / "archive" / own[0]).read_bytes())
    assert warc.read_archives(spark, path).count() == 4
    writer = warc.WarcWriter({"path": path})
    writer.job = own[0][5:37]
    writer.commit([warc.Written(n) for n in own] + [warc.Written(None), None])
    assert [p.name[5:37] for p in tmp_path.glob(f"archive/*{'1' * 32}.warc.gz")] == ["0" * 32]
    writer.abort([])
    assert [p.name for p in tmp_path.glob("archive/*.warc.gz")] == [f"part-{'0' * 32}-{'1' * 32}.warc.gz"]


def test_responses_that_a_full_bitmap_holds_are_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc.kernel, "LEAST_BITS", 3)
    monkeypatch.setattr(warc.kernel, "MOST_BITS", 3)  # eight bits: nearly all is held by chance
    r = random.Random(3)
    rows = [(k, "u", f"{r.randrange(25)} " * r.choice([10, 500]), 0) for k in range(150)] + [(None, "u", "0 " * 500, 0), (149, "u", "other " * 500, 0)]
    found = sorted(tuple(x) for x in warc.records_of(spark.createDataFrame(rows, "page_id long, url string, html string, payload int")).select("record_id", "record_type", "refers_to", F.octet_length("payload")).collect())
    want = []
    for i, _, html, _ in rows:
        last = max(p for p, _, h, _ in rows if h == html and p is not None)
        again = len(html) >= 1000 and i != last
        want.append((f"<urn:page:{'null' if i is None else i}>", "revisit" if again else "response", f"<urn:page:{last}>" if again else None, None if again else len(html)))
    assert found == sorted(want)


def test_filters_are_pushed_down_and_parts_are_split(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    write(spark, ROWS, path)
    df = warc.read_archives(spark, path, split_bytes=100).where("record_type = 'revisit' and record_id in ('<urn:page:1>', '<urn:page:12>', '<urn:page:9>')")
    assert sorted(r["record_id"] for r in df.select("record_id").collect()) == ["<urn:page:12>", "<urn:page:1>"]
    reader = warc.WarcReader({"path": path, "split_bytes": 100}, ["record_id"])
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("full_length",), 5)]))
    assert [type(f).__name__ for f in rest] == ["GreaterThan"]
    parts = reader.partitions()
    assert len(parts) > len(ROWS)  # also parts in which no record starts
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 4
    assert warc.read_archives(spark, path).where("target_uri is null").count() == 1


def test_unwanted_members_are_not_inflated():
    members = [gzip.compress(warc.record_bytes({"record_id": f"<{k}>", "record_type": "response" if k % 2 else "revisit"}, bytes(k * 50_000))) for k in range(6)]
    broken = [m if k % 2 else m[:300] + bytes(len(m) - 300) if len(m) > 400 else m for k, m in enumerate(members)]
    offsets = [sum(map(len, broken[:k])) for k in range(7)]
    found = list(warc.read_members(io.BytesIO(b"".join(broken)), offsets[:6], offsets[6], lambda f: f["warc-type"] == "response"))
    assert [len(b) for _, b in found] == [50_000, 150_000, 250_000]


@pytest.mark.parametrize("packed", [False, True])
def test_streams_without_an_index(spark, tmp_path, packed):
    records = [warc.record_bytes({"record_id": f"<{k}>", "record_type": ("response", "metadata")[k % 2], "target_uri": "u"}, b"line\r\n\r\n" * k * 20_000) for k in range(5)]
    blob = b"".join(gzip.compress(r) if packed else r for r in records)
    (tmp_path / ("a.warc.gz" if packed else "a.warc")).write_bytes(blob)
    found = warc.read_archives(spark, f"file://{tmp_path}").where("record_type = 'response'").collect()
    assert sorted((r["record_id"], len(r["payload"])) for r in found) == [("<0>", 0), ("<2>", 320_000), ("<4>", 640_000)]
    assert len(list(warc.read_records(io.BytesIO(blob)))) == 5


def test_empty_table_and_folded_headers(spark, tmp_path):
    write(spark, [], f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").collect() == []
    raw = b"WARC/1.0\r\nWARC-Type: response\r\nX-Long: a\r\n b\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    ((fields, block),) = warc.read_records(io.BytesIO(raw))
    assert fields["x-long"] == "a b" and block == b"hi"
    for cut in (len(raw) - 6, 30):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(raw[:cut])))
