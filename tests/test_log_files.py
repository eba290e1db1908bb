"""Listing, numbering and decoding of log files: nested, empty, split and mixed ones."""

import pytest

from gatewarden.sources import logs
from gatewarden.sources.listing import list_files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("logs of all kinds")
    (top / "deep" / "er").mkdir(parents=True)
    (top / "_hidden").mkdir()
    (top / "_hidden" / "x.log").write_text("no\n")
    (top / ".dot").write_text("no\n")
    (top / "a b.log").write_bytes("één\r\ntwo\n".encode() + b"three")
    (top / "empty.log").write_bytes(b"")
    (top / "deep" / "latin.log").write_bytes(b"caf\xe9\n" * 2 + "é\n".encode())
    (top / "deep" / "er" / "empty").write_bytes(b"")
    (top / "deep" / "er" / "late.log").write_bytes(b"x" * 9000 + b"\nbad \xff\ngood\n")
    # a character of two bytes that the end of the head cuts
    (top / "deep" / "er" / "cut.log").write_bytes(b"y" * 8191 + "é\n".encode())
    return top


def by_name(rows, *columns):
    return {r.file_path.rsplit("/", 1)[1]: tuple(r[c] for c in columns) for r in rows}


def test_listing(spark, folder):
    want = {"a b.log": (16, "utf-8"), "empty.log": (0, None), "latin.log": (13, "latin-1"), "empty": (0, None), "late.log": (9012, "utf-8"), "cut.log": (8194, "utf-8")}
    for paths in (str(folder), f"file://{folder}", [str(folder), str(folder / "deep")]):
        got = list_files(spark, paths, encoding=True).collect()
        assert len(got) == len(want) and by_name(got, "file_size", "encoding") == want
    assert set(by_name(list_files(spark, str(folder / "*.log")).collect())) == {"a b.log", "empty.log"}
    assert set(by_name(list_files(spark, str(folder / "d*" / "{latin,other}.log")).collect())) == {"latin.log"}
    assert set(by_name(list_files(spark, str(folder / "deep" / "e?")).collect())) == {"empty", "late.log", "cut.log"}
    assert set(by_name(list_files(spark, str(folder / "a b.log")).collect())) == {"a b.log"}
    with pytest.raises(Exception, match="nowhere"):
        list_files(spark, str(folder / "nowhere")).collect()


def test_paths_of_other_schemes(spark, folder, tmp_path):
    (tmp_path / "plain").symlink_to(folder)  # a mount's target may hold no space
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.default.link./in", f"file://{tmp_path}/plain")
    got = by_name(list_files(spark, "viewfs://default/in", encoding=True).collect(), "file_size", "encoding")
    assert got == {"a b.log": (16, None), "empty.log": (0, None), "latin.log": (13, None), "empty": (0, None), "late.log": (9012, None), "cut.log": (8194, None)}


def test_decoding_by_file(spark, folder):
    lines = logs.decode_files(logs.read_log_lines(spark, str(folder)), list_files(spark, str(folder), encoding=True))
    got = {(r.file_path.rsplit("/", 1)[1], r.line_number): (r.content[-8:], r.encoding, r.decode_error) for r in lines.collect()}
    assert got == {
        ("a b.log", 1): ("één", "utf-8", False), ("a b.log", 2): ("two", "utf-8", False), ("a b.log", 3): ("three", "utf-8", False),
        ("latin.log", 1): ("café", "latin-1", False), ("latin.log", 2): ("café", "latin-1", False), ("latin.log", 3): ("Ã©", "latin-1", False),
        ("late.log", 1): ("x" * 8, "utf-8", False), ("late.log", 2): ("bad ÿ", "utf-8", True), ("late.log", 3): ("good", "utf-8", False),
        ("cut.log", 1): ("yyyyyyyé", "utf-8", False),
    }
    inventory = logs.file_inventory(spark, str(folder), max_bytes=9000)
    assert by_name(inventory.collect(), "line_count", "is_empty", "too_large") == {"a b.log": (3, False, False), "empty.log": (0, True, False), "latin.log": (3, False, False), "empty": (0, True, False), "late.log": (3, False, True), "cut.log": (1, False, False)}
    summary = by_name(logs.ingestion_summary(lines, inventory).collect(), "lines_processed", "errors", "success")
    assert summary["late.log"] == (3, ["file is too large", "encoding error in 1 lines"], False)
    assert summary["empty"] == (0, ["file is empty"], False) and summary["a b.log"] == (3, [], True)


def test_numbers_over_many_splits(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 1), ("c", 1700)):
        (tmp_path / name).write_text("".join(f"{name} {k}\n" for k in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        lines = logs.read_log_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() >= 1
        rows = lines.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 4701 and all(r.content == f"{r.file_path[-1]} {r.line_number}" for r in rows)


def test_no_files(spark, tmp_path):
    assert list_files(spark, str(tmp_path)).count() == 0
