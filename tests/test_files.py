"""Scans of text files in several encodings, converted once."""

from lexiforge.sources import files as S
from pyspark.sql import functions as F


def test_scan_convert_report(spark, tmp_path):
    chinese = "这是正常的中文内容，用来检测。" * 20
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, data in (("a.txt", chinese.encode("gbk")), ("b.TXT", chinese.encode("utf-8")), ("c.md", b"plain"), ("sub/d.txt", b"\xff\xfe" + chinese.encode("utf-16-le")), ("e.epub", b"x"), ("f.bin", b"\x00"), ("noext", b"1")):
        (tmp_path / "in" / name).write_bytes(data)
    scanned = S.scan(spark, f"{tmp_path}/in")
    assert {(r.kind, r.n) for r in S.inventory(scanned).collect()} == {("txt", 3), ("epub", 1), ("other", 3)}
    read = S.converted(scanned)
    got = {r.path.rpartition("/")[2]: (r.encoding, r.text) for r in read.collect()}
    assert {n: e for n, (e, _) in got.items()} == {"a.txt": "gb18030", "b.TXT": "utf-8", "c.md": "utf-8-replace", "d.txt": "utf-16"}
    assert all(t == chinese for n, (_, t) in got.items() if n != "c.md")
    assert {r.path.rpartition("/")[2]: r.suspicious for r in S.quality_report(read).collect()} == {"a.txt": False, "b.TXT": False, "c.md": True, "d.txt": False}
    done = scanned.where(F.col("path").endswith("a.txt")).select("path", "modificationTime")
    assert sorted(r.path.rpartition("/")[2] for r in S.converted(scanned, done).collect()) == ["b.TXT", "c.md", "d.txt"]
    older = done.select("path", (F.col("modificationTime") - F.expr("interval 1 day")).alias("modificationTime"))
    assert S.converted(scanned, older).count() == 4 and S.converted(scanned.limit(0)).collect() == []
