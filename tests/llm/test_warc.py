import base64
import gzip
import hashlib

import pytest

from netpen.llm import warc
from netpen.llm.queries import op3_warc


def pages():
    big = "<p>" + "long é page " * 4000 + "</p>"
    tricky = "WARC/1.0\r\nWARC-Type: response\r\n\r\n0\r\n\r\n" * 3
    return [(5, "http://a.example/x", "<p>one</p>"), (3, "http://b.example/y", "<p>one</p>"), (9, None, "<p>one</p>"),
            (None, "http://n.example/", "<p>one</p>"), (1, "http://c.example/", None), (2, "http://d.example/", ""),
            (4, "http://e.example/ \r\n x", big), (6, "http://f.example/", tricky), (7, "u", "WARC/1.0\r\n"),
            (8, "u", big), (10, "u", "😀" * 5000), (None, "u", "lonely")]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id long, url string, html string, sha1 int")


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(llm, tmp_path, least):
    rows = pages()
    warc.write_archives(table(llm, rows).repartition(3), str(tmp_path / "w"), min_bytes=least,
                        segment_bytes=1000, chunk_bytes=300)
    got = {(r.page_id, r.payload_digest): r for r in warc.read_archives(llm, str(tmp_path / "w")).collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same, default=None)
        r = got[i, digest(html)]
        alone = len((html or "").encode()) < least or first is None or i == first
        assert (r.record_type, r.refers_to) == (("response", None) if alone else ("revisit", first))
        assert r.payload == ((html or "").encode() if alone else None)
        assert r.url == (url and " ".join(url.split()))


def test_archives_are_warc_files(llm, tmp_path):
    warc.write_archives(table(llm, pages()).coalesce(1), str(tmp_path / "w"), segment_bytes=1000)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")))
    at, kinds = 0, []
    while at < len(data):
        assert data.startswith(b"WARC/1.0\r\n", at)
        end = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        kinds.append(fields["WARC-Type"])
        at = end + 4 + int(fields["Content-Length"])
        assert data[at:at + 4] == b"\r\n\r\n"
        at += 4
    assert set(kinds) == {"response", "revisit", "continuation"}


def test_damage_is_told(llm, tmp_path):
    warc.write_archives(table(llm, pages()).coalesce(1), str(tmp_path / "w"), segment_bytes=1000)
    file = next((tmp_path / "w").glob("part-*"))
    data = gzip.decompress(file.read_bytes())
    for number, broken in enumerate([data[:-200], data.replace(b"<p>one</p>", b"<p>two</p>", 1),
                                     data.replace(b"WARC-Segment-Number: 3\r\n", b"WARC-Segment-Number: 4\r\n", 1)]):
        (tmp_path / f"b{number}").mkdir()
        (tmp_path / f"b{number}" / "x.gz").write_bytes(gzip.compress(broken))
        with pytest.raises(Exception, match="cut short|digest|missing"):
            warc.read_archives(llm, str(tmp_path / f"b{number}")).collect()


def test_framing():
    for n in (0, 1, 9, 10, 11, 100):
        assert warc.unframe(warc.frame(b"x" * n, 10)) == b"x" * n
    assert warc.unframe(b"3;a=b\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"


def test_query(llm, tmp_path):
    rows = [r for r in pages() if r[0] is not None]
    table(llm, rows).drop("sha1").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: tuple(r)[1:] for r in op3_warc(llm, str(tmp_path)).collect()}
    for i, _, html in rows:
        first = min(p for p, _, h in rows if (h or "") == (html or ""))
        assert got[i] == (len((html or "").encode()), digest(html), "response" if first == i else "revisit",
                          None if first == i else first)
    (tmp_path / "none").mkdir()
    table(llm, []).drop("sha1").write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert op3_warc(llm, str(tmp_path / "none")).count() == 0
