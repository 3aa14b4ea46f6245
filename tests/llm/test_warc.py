import hashlib

from sylspark.llm import warc

SCHEMA = "page_id long, url string, html string, leaf string, segment int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_audit_finds_what_differs(spark):
    rows = [(k, f"http://a/{k}", f"<p>{k} ü</p>" * (k % 7)) for k in range(0, 700, 3)] + [(5000, None, None), (None, "u", "h"), (9, "http://a/9", "again")]
    other = [r for r in rows if r[0] != 30]
    other = [(r[0], r[1], "?" + r[2]) if r[0] in (33, 699) else r for r in other] + [(40, "new", "new")]
    a, b = warc.records(pages(spark, rows)), warc.records(pages(spark, other))
    assert {tuple(r) for r in warc.audit(a, b, fanout=4).collect()} == {(30, "missing"), (33, "corrupt"), (699, "corrupt"), (40, "added")}
    assert warc.audit(a, a).count() == 0
    found = warc.fixity(a, b).collect()
    assert len(found) == len(rows)
    ends: dict = {}
    for r in sorted((r for r in found if r.page_id is not None), key=lambda r: (r.page_id, r.leaf)):
        assert r.record_offset == ends.get(r.segment, 0)
        ends[r.segment] = r.record_offset + r.length
    assert {r.status for r in found} == {"ok", "corrupt", "missing", "unnumbered"}


def test_empty(spark):
    none = warc.records(pages(spark, []))
    assert warc.fixity(none, none).collect() == []


def test_files_round_trip(spark, tmp_path):
    rows = [(k, f"http://a/{k}", f"<p>\r\n{k} ü</p>" * (k % 5)) for k in range(40)] + [(2000, None, None)]
    path = f"file://{tmp_path}/w"
    written = {r.file: r.records for r in warc.write_warc(pages(spark, rows), path).collect()}
    assert sum(written.values()) == 41 and len(written) == 2
    back = warc.read_warc(spark, path).collect()
    assert sorted((r.url, r.payload) for r in back) == sorted((u or "", h or "") for _, u, h in rows)
    leaf = {r.page_id: (r.leaf, r.length) for r in warc.records(pages(spark, rows)).collect()}
    for r in back:
        if r.url.startswith("http"):
            assert leaf[int(r.url.rsplit("/", 1)[1])][1] == r.length
    one = rows[3]
    text = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {one[1]}\r\nContent-Type: text/html\r\nContent-Length: {len(one[2].encode())}\r\n\r\n{one[2]}\r\n\r\n"
    assert leaf[3][0] == hashlib.sha256(text.encode()).hexdigest()
