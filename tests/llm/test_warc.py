"""op4: archives written and read back, push-down, foreign archives."""
import gzip
import hashlib

from llm.conftest import clash

from churnlens.llm import warc
from churnlens.llm.storage import new_folder


def pages(spark):
    long, other = "<p>é</p>" * 200, "y" * 999
    rows = [(1, "http://a/1", long), (2, "http://a/é 2", other), (3, None, None), (4, "u", ""), (7, "u", long), (5, "u", long),
            (6, "u", other), (8, "u\r\nX: y", "z" * 200_000), (9, "u", "z" * 200_000), (9, "u", "z" * 200_000), (None, "u", long)]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def test_round_trip(spark):
    df, rows = pages(spark)
    folder = new_folder(spark, "test")
    assert warc.write_warc(clash(df, "digest", "payload", "last", "revisit"), folder) > 0
    got = sorted((tuple(r) for r in warc.page_records(spark, folder).collect()), key=repr)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        last = max((j for j, _, x in rows if x == h and j is not None and len(b) >= 1000), default=None)
        again = last is not None and i != last
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last if again else None))
    assert got == sorted(want, key=repr)
    back = {r.record_id: r for r in warc.read_warc(spark, folder).collect()}
    assert back["urn:page:8"].payload is None and back["urn:page:8"].record_type == "revisit"
    assert back["urn:page:8"].target_uri == "u\r\nX: y" and back["urn:page:2"].target_uri == "http://a/é 2"
    assert bytes(back["urn:page:7"].payload).decode() == rows[0][2]


def test_filters_reach_the_source_and_payloads_stay_coded(spark, monkeypatch):
    df, _ = pages(spark)
    folder = new_folder(spark, "test")
    warc.write_warc(df, folder)
    r = warc.read_warc(spark, folder).filter("record_type = 'revisit' AND payload_length > 2000")
    assert "FilterExec" not in r._jdf.queryExecution().executedPlan().toString()
    assert r.count() == 1
    schema = type("S", (), {"fields": [type("F", (), {"name": c}) for c in ("record_type", "payload")]})
    reader = warc.WarcReader(schema, {"path": folder})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")])) == []
    monkeypatch.setattr(warc._Member, "payload", lambda self: 1 / 0)
    read = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    assert read and {x["record_type"] for x in read} == {"revisit"}


def test_foreign_archives(spark, tmp_path):
    parts = [warc.record(i, "u", b"p" * i, hashlib.sha1(b"p" * i).hexdigest(), None, False) for i in (0, 5, 70_000)]
    (tmp_path / "plain.warc").write_bytes(b"".join(parts))
    (tmp_path / "no-length.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "info.warc").write_bytes(info)
    got = warc.read_warc(spark, str(tmp_path)).selectExpr("record_type", "length(payload) AS n").collect()
    assert sorted((r.record_type, r.n) for r in got) == sorted([("response", n) for n in (0, 5, 70_000)] * 2 + [("warcinfo", 3)])
    assert warc.read_warc(spark, str(tmp_path), payload=False).filter("payload IS NOT NULL").count() == 0


def test_empty_table(spark):
    df, _ = pages(spark)
    folder = new_folder(spark, "test")
    assert warc.write_warc(df.limit(0), folder) == 0 and warc.page_records(spark, folder).count() == 0


def test_archives_roll(spark):
    df = spark.createDataFrame([(i, "u", f"{i} " * 500) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    one, many = new_folder(spark, "test"), new_folder(spark, "test")
    assert warc.write_warc(df, many, file_bytes=500) > 20 > warc.write_warc(df, one)
    rows = [sorted(map(tuple, warc.page_records(spark, f).collect())) for f in (one, many)]
    assert rows[0] == rows[1] and len(rows[0]) == 60
