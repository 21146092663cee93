import gzip
import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tablewright.llm import warc, zipped
from tablewright.llm.queries import op13_warc_archives
from tablewright.llm.warc import archives_in, page_id, read_records, record_ranges, write_archives


def reader(data):
    return lambda n, at: data[at : at + n]


def packed(members, **options):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as made:
        for name, body, method in members:
            made.writestr(zipfile.ZipInfo(name), body, compress_type=method, **options)
    return out.getvalue()


def held(data):
    """(name, size, data) of stored members, found by the directory."""
    found = []
    for m in zipped.members(reader(data), len(data)):
        at = zipped.data_start(reader(data), m)
        found.append((m.name, m.size, data[at : at + m.packed]))
    return found


MEMBERS = [("a.txt", b"one", 0), ("b/ü 한.bin", bytes(range(256)) * 9, 0), ("empty", b"", 0)]


@pytest.mark.parametrize("before", [b"", b"#!/bin/sh\nPK\x05\x06 exit\n"])
def test_directories(before):
    with_comment = io.BytesIO(packed(MEMBERS))
    with zipfile.ZipFile(with_comment, "a") as z:
        z.comment = b"a comment with PK\x05\x06 inside " * 100
    for data in (packed(MEMBERS), with_comment.getvalue()):
        assert held(before + data) == [(n, len(b), b) for n, b, _ in MEMBERS]
    assert held(packed([])) == []


@pytest.mark.parametrize("before", [b"", b"bytes before"])
def test_zip64_fields(monkeypatch, before):
    # sizes and offsets over 200 count as too large for their places, so the writer puts them into ZIP64 fields and end records
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 200)
    data = packed(MEMBERS * 3)
    assert zipped.END64 in data
    assert held(before + data) == [(n, len(b), b) for n, b, _ in MEMBERS * 3]


def test_more_members_than_the_short_count_holds():
    data = packed([(f"m{k}", b"%d" % k, 0) for k in range(70_000)])
    found = list(zipped.members(reader(data), len(data)))
    assert len(found) == 70_000 and found[-1].name == "m69999"
    at = zipped.data_start(reader(data), found[66_000])
    assert data[at : at + found[66_000].size] == b"66000"


def test_sizes_beyond_32_bits(tmp_path):
    import struct

    # a stored member of 5 GB that is a hole in the file, and a small one behind it
    big, small, path = 5 << 30, b"behind", tmp_path / "big.zip"
    with open(path, "wb") as f:
        def local(name, size):
            f.write(struct.pack(zipped.LOCAL_FIELDS, zipped.LOCAL, 45, 0, 0, 0, 33, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<2H2Q", 1, 16, size, size))

        local(b"big", big)
        f.seek(big, 1)
        at = f.tell()
        local(b"small", len(small))
        f.write(small)
        start = f.tell()
        for name, size, header in ((b"big", big, 0), (b"small", len(small), at)):
            extra = struct.pack("<2H", 9, 0) + struct.pack("<2H3Q", 1, 24, size, size, header)
            f.write(struct.pack(zipped.CENTRAL_FIELDS, zipped.CENTRAL, 45, 45, 0, 0, 0, 33, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra)
        end = f.tell()
        f.write(struct.pack(zipped.END64_FIELDS, zipped.END64, 44, 45, 45, 0, 0, 2, 2, end - start, start))
        f.write(struct.pack(zipped.LOCATOR_FIELDS, zipped.LOCATOR64, 0, end, 1))
        f.write(struct.pack(zipped.END_FIELDS, zipped.END, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    import pyarrow as pa

    with pa.OSFile(str(path)) as file:
        read = lambda n, o: file.read_at(n, o)
        one, two = zipped.members(read, file.size())
        assert (one.size, two.size, two.header) == (big, len(small), at)
        assert read(two.size, zipped.data_start(read, two)) == small


def test_damaged_directories():
    data = packed(MEMBERS)
    for bad in (b"", b"no archive", data[:-30], data[:20] + data[60:], data.replace(b"PK\x01\x02", b"PK\x01\x03")):
        with pytest.raises(ValueError):
            list(zipped.members(reader(bad), len(bad)))


PAGES = "page_id long, url string, html string, archive string, payload_bytes int, record_type string"


def odd_pages():
    draw = random.Random(5)
    big = [f"<p>{k}</p>" + "x é\r\n\r\n" * 300 for k in range(4)]
    rows = [(draw.randrange(1, 500), f"http://h/{k}", draw.choice(big)) for k in range(60)]
    rows += [(1000 + k, None if k % 3 else "http://a/\r\nX: y", "same but short") for k in range(10)]
    rows += [(2000, "u", None), (2001, "", ""), (None, "http://no/id", big[0]), (None, None, "only here" * 200), (None, "z", "only here" * 200), (7, "q", "y" * 1000), (8, "q", "y" * 1000), (9, "q", "y" * 999), (10, "q", "y" * 999)]
    return rows + rows[:5]


def expected(rows, least=1000):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        last = max(same) if same and len(body) >= least else None
        refers = last if last != page else None
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def of_pages(found):
    kind = found.where("record_type <> 'warcinfo'")
    return kind.select(page_id(F.col("record_id"), "bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id(F.col("refers_to"), "bigint").alias("refers_to"))


@pytest.mark.parametrize("sent", [200_000, 0])
def test_pages_round_trip(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(warc, "SENT_DIGESTS", sent)
    rows = odd_pages()
    pages = spark.createDataFrame([(*r, "a", 1, "t") for r in rows], PAGES).repartition(3)
    archives = write_archives(pages, f"file://{tmp_path}/w", archive_bytes=3000, date="2020-01-02T03:04:05Z")
    assert archives.count() > 3 and archives.selectExpr("sum(records)").first()[0] == len(rows) + archives.count()
    found = read_records(archives, range_bytes=700)
    assert sorted(map(tuple, of_pages(found).collect()), key=str) == expected(rows)
    assert found.where("record_type = 'response' and not intact").count() == 0
    got = sorted((page_id_of(r), r["payload"].decode()) for r in found.where("record_type = 'response'").collect())
    want = [(p if p is not None else -1, h or "") for p, _, h in rows]
    assert set(got) <= set(want) and {h for _, h in got} == {h for _, h in want}
    urls = {r["target_uri"] for r in found.collect()}
    assert urls >= {"http://h/1", None, "http://a/%0D%0AX:%20y"}
    # the standard library sees the same archives
    for r in archives.collect():
        with zipfile.ZipFile(r["archive"].removeprefix("file://")) as z:
            assert z.testzip() is None and z.namelist() == [warc.DATA, warc.INDEX]
            text = gzip.decompress(z.read(warc.DATA))
            assert text.count(b"WARC/1.1\r\n") == r["records"] == len(z.read(warc.INDEX).splitlines()) and all(i.compress_type == 0 for i in z.infolist())
    by_name = archives_in(spark, f"{tmp_path}/w/archives")
    assert by_name.count() == archives.count() and sorted(map(tuple, of_pages(read_records(by_name)).collect()), key=str) == expected(rows)


def page_id_of(r):
    name = r["record_id"].removeprefix(warc.PAGE)
    return int(name) if name else -1


def records(n, gz=True):
    made = [warc.page_record(str(k), f"http://x/{k}", f"body {k} ".encode() * (k * 40), None, "2020-01-01T00:00:00Z") for k in range(n)]
    return [gzip.compress(r) if gz else r for r in made]


def index_of(parts, name, skip=()):
    at, lines = 0, []
    for k, p in enumerate(parts):
        if k not in skip:
            lines.append(f'x 2020 {{"offset": "{at}", "length": "{len(p)}", "filename": "{name}"}}\n')
        at += len(p)
    return "".join(lines).encode()


def test_foreign_archives(spark, tmp_path, monkeypatch):
    plain, parts = records(30, False), records(30)
    many = [("datapackage.json", b"{}", 8), ("archive/one.warc.gz", b"".join(parts), 0), ("archive/two.warc", b"".join(plain), 0)]
    kinds = {
        "no index": many,
        "deflated index": [*many, ("indexes/a.cdxj", index_of(parts, "one.warc.gz"), 8), ("indexes/b.cdx.gz", gzip.compress(index_of(plain, "two.warc")), 0)],
        "index with gaps": [*many, ("indexes/a.cdxj", index_of(parts, "one.warc.gz", {3, 29}), 0)],
        "two members of gzip in an index": [*many, ("indexes/b.cdx.gz", gzip.compress(index_of(parts, "one.warc.gz")) + gzip.compress(index_of(plain, "two.warc")), 8)],
    }
    want = sorted((m, k, len(f"body {k} ".encode()) * k * 40) for m in ("archive/one.warc.gz", "archive/two.warc") for k in range(30))
    for piece in (1 << 20, 97):
        monkeypatch.setattr(warc, "PIECE", piece)
        for name, members in kinds.items():
            path = tmp_path / f"{name.replace(' ', '_')}.zip"
            path.write_bytes(packed(members))
            with warc._store(str(path))[0].open_input_file(str(path)) as file:
                for member, start, places in warc._places(file, file.size()):
                    assert [n for _, n in places] == [len(p) for p in (parts if member.endswith("gz") else plain)] and places[0][0] == start
    for name in kinds:
        table = spark.createDataFrame([(str(tmp_path / f"{name.replace(' ', '_')}.zip"),)], "archive string")
        got = read_records(table).collect()
        assert sorted((r["member"], page_id_of(r), r["payload_bytes"]) for r in got) == want
        assert all(r["intact"] and len(r["payload"]) == r["payload_bytes"] for r in got)


def test_members_that_can_not_be_read_in_place(spark, tmp_path):
    path = tmp_path / "packed.zip"
    path.write_bytes(packed([("archive/a.warc.gz", b"".join(records(3)), 8)]))
    with pytest.raises(Exception, match="not stored"):
        read_records(spark.createDataFrame([(str(path),)], "archive string")).count()


def test_long_record_has_a_range_of_its_own(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", "".join(map(chr, random.Random(k).choices(range(33, 1000), k=200_000 if k == 4 else 10)))) for k in range(8)], "page_id long, url string, html string").coalesce(1)
    archives = write_archives(pages, str(tmp_path / "w"))
    ranges = record_ranges(archives, 2000).collect()
    assert len(ranges) == 3 and sum(len(r["lengths"]) for r in ranges) == 9
    assert read_records(archives, range_bytes=2000).where("intact").count() == 8


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archives = write_archives(pages, str(tmp_path / "w"))
    assert archives.count() == 0 and read_records(archives).count() == 0
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    assert op13_warc_archives(spark, str(tmp_path)).count() == 0
