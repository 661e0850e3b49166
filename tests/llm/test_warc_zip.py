import base64
import hashlib
import io
import zipfile

import pytest

from stratalens.llm import queries as Q, warc_zip as Z


def test_archive_is_a_zip_others_can_read():
    for zip64 in (True, False):
        data = Z.build_archive([(5, Z.record(5, "http://a b", b"<p>", None)), (None, Z.record(None, None, b"", 5))], zip64)
        z = zipfile.ZipFile(io.BytesIO(data))
        assert z.testzip() is None and set(z.namelist()) == {"archive/data.warc", "indexes/index.txt", "datapackage.json"}
        rows = list(Z.read_archive(data))
        assert [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["url"]) for r in rows] == [(5, "response", None, 3, "http://a%20b"), (None, "revisit", 5, 0, None)]
        assert [r["page_id"] for r in Z.read_archive(data, {5})] == [5]


def test_archives_of_others_and_damage():
    buf = io.BytesIO()
    raw = Z.record(1, "u", b"x" * 9000, None)
    with zipfile.ZipFile(buf, "w") as z:
        z.comment = b"c" * 5000
        z.writestr("archive/data.warc", raw)
        z.writestr("indexes/index.txt", f"1 0 {len(raw)}")
    assert next(Z.read_archive(buf.getvalue()))["payload"] == b"x" * 9000
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc", raw)
    for bad in (buf.getvalue(), b"", b"no archive", Z.build_archive([(1, raw)])[:-30]):
        with pytest.raises((ValueError, KeyError)):
            list(Z.read_archive(bad))


def test_comment_that_looks_like_an_end_record():
    raw = Z.record(1, "u", b"x", None)
    data = Z.build_zip([("archive/data.warc", raw), ("indexes/index.txt", f"1 0 {len(raw)}".encode())], False)
    comment = Z.END + bytes(18) + b"tail"
    data = data[:-2] + len(comment).to_bytes(2, "little") + comment
    assert [r["page_id"] for r in Z.read_archive(data)] == [1]


class Counting(io.RawIOBase):
    """A file that counts what is read from the file system."""

    def __init__(self, path):
        self.file, self.read_bytes = open(path, "rb"), 0

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, *where):
        return self.file.seek(*where)

    def tell(self):
        return self.file.tell()

    def read(self, n=-1):
        got = self.file.read(n)
        self.read_bytes += len(got)
        return got


def test_only_ranges_are_read_from_the_file(tmp_path):
    import pyarrow as pa

    data = Z.build_archive([(i, Z.record(i, "u", b"y" * 100_000, None)) for i in range(100)])
    (tmp_path / "a.wacz").write_bytes(data)
    file = Counting(tmp_path / "a.wacz")
    Z.directory(Z.Ranges(pa.PythonFile(file, "r")))
    assert 0 < file.read_bytes < 6000
    file = Counting(tmp_path / "a.wacz")
    assert [r["page_id"] for r in Z.read_archive(pa.PythonFile(file, "r"), {7, 8, 60})] == [7, 8, 60]
    assert 300_000 < file.read_bytes < 320_000 < len(data) / 20
    file = Counting(tmp_path / "a.wacz")
    assert len(list(Z.read_archive(pa.PythonFile(file, "r")))) == 100 and file.read_bytes < len(data) + 10_000


def test_query(spark, tmp_path):
    pages = [(1, "a", "x"), (2, "b", "x"), (2, "b2", "x"), (3, None, None), (4, "d", ""), (5, "e", "é" * 90000), (None, "n", "x"), (7, "f", "alone\r\n\r\n")]
    df = spark.createDataFrame([(*p, "q") for p in pages], "page_id long, url string, html string, refers_to string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    rows = Q.op3_warc_zip(spark, str(tmp_path)).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        top = max((j for j, _, g in pages if (g or "") == (h or "") and j is not None), default=None)
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert sorted(map(key, rows)) == sorted(map(key, want))
    df.where("1 = 0").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert Q.op3_warc_zip(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.wacz").write_bytes(Z.build_archive([(9, Z.record(9, "u", b"z", None))]))
    assert [(r.page_id, bytes(r.payload)) for r in Z.read_files(spark, str(tmp_path / "w")).collect()] == [(9, b"z")]
