"""Rules of names, codes and installer tables, case by case."""

import pytest
from pyspark.sql import functions as F

from cargohold.functions import codecs
from cargohold.functions import text as fn
from cargohold.operators import installer


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def test_size_text(spark):
    cases = {0: "0", -3: "0", None: "0", 1: "1", 1023: "1023", 1024: "1.00 KB = 1024", 1_572_864: "1.50 MB = 1572864", 3 << 30: "3.00 GB = 3221225472"}
    assert values(spark, [(n,) for n in cases], "n long", fn.size_text(F.col("n"))) == [(x,) for x in cases.values()]


def test_default_names(spark):
    cases = {"text/html": "index.html", "TEXT/HTML; charset=x": "index.html", "text/richtext": "message.rtf", "text/anything": "message.txt", "image/Jpeg": "image.Jpeg", "application/postscript": "document.ps", "application/pdf": "file.dat", "message/rfc822": "message.eml", "message/partial": "file.dat", "video/mp4": "file.dat"}
    assert values(spark, [(k,) for k in cases], "k string", fn.default_name(F.col("k"))) == [(x,) for x in cases.values()]


def test_inner_extensions(spark):
    cases = [("a.pck", b"  <?xml version", ".xml"), ("a.pck", b"DDSx", ".dds"), ("a.pck", b" DDS", ".txt"), ("a.pck", b"\0<?xml", ".txt"), ("a.pck", b"x" * 16 + b"<?xml", ".txt"), ("a.pck", b"", ".txt"), ("d.x\\a.pbd", b"<?xml", ".bod"), ("a.pbb", b"", ".bob"), ("a.PCK", b"<?xml", ".PCK"), ("d.x\\none", b"", ""), ("a.b.txt", b"", ".txt")]
    assert values(spark, [x[:2] for x in cases], "p string, c binary", fn.inner_extension(F.col("p"), F.col("c"))) == [(x[2],) for x in cases]


def test_attributes(spark):
    assert values(spark, [(0,), (1,), (7,), (16,)], "b long", fn.item_attributes(F.col("b"))) == [(128,), (1,), (7,), (128,)]


@pytest.mark.parametrize(
    ("search", "mode", "case", "hits"),
    [("*.TXT", "wildcard", False, {"a.txt", "b.TXT"}), ("*.txt", "wildcard", True, {"a.txt"}), ("?.*", "wildcard", False, {"a.txt", "b.TXT", "[.("}), ("**", "wildcard", False, {"a.txt", "b.TXT", "[.(", "", "\u00c9x\ny"}), ("", "wildcard", False, {""}), ("[.(", "wildcard", False, {"[.("}), (".T", "substring", False, {"a.txt", "b.TXT"}), (".T", "substring", True, {"b.TXT"}), ("A.TXT", "string", False, {"a.txt"}), ("\u00e9*", "wildcard", False, set())],
)
def test_find(spark, search, mode, case, hits):
    names = ["a.txt", "b.TXT", "[.(", "", "\u00c9x\ny"]
    assert {n for n, hit in values(spark, [(n,) for n in names], "n string", "n", fn.found_by(F.col("n"), search, mode, case)) if hit} == hits


def test_bytes_and_crc(spark):
    cases = [(b"abcabc", 1, 0x6E2A), (b"\xff\x00bc", 2, None), (b"xyz", None, None), (b"", None, 0), (None, None, None), (b"123456789", None, 0x31C3)]
    for (at, crc), (content, want, want_crc) in zip(values(spark, [(x[0],) for x in cases], "c binary", fn.find_bytes(F.col("c"), b"bc"), fn.crc16(F.col("c"))), cases, strict=True):
        assert at == want
        if content in (b"", None, b"123456789"):
            assert crc == want_crc
    assert values(spark, [(b"a\xffb",)], "c binary", fn.find_bytes(F.col("c"), b"\xff"), fn.find_bytes(F.col("c"), b"")) == [(1, None)]


def test_stream_names(spark):
    one = chr(fn.STREAM_START + 10 + 64 * 64)
    cases = {chr(fn.STREAM_START): "00", one + chr(fn.STREAM_START): "A", chr(fn.STREAM_START + 64 * 65): "!", "plain": None, "": ""}
    assert values(spark, [(k,) for k in cases], "k string", fn.stream_name(F.col("k"))) == [(x,) for x in cases.values()]


def test_times_and_ends(spark):
    rows = [(0, "a"), (None, ""), (116444736000000000 + 15, "a\\")]
    got = values(spark, rows, "t long, p string", fn.file_time(F.col("t")).cast("string"), fn.with_trailing(F.col("p")))
    assert got == [(None, "a\\"), (None, ""), ("1970-01-01 00:00:00.000001", "a\\")]
    assert codecs.weak_crc32(b"") == 0 and codecs.weak_crc32(b"123456789") == 0x2DFD2D88


def test_folder_names(spark):
    cases = [
        ("FontsFolder", ".", ("FontsFolder", "FontsF~1")),
        ("FontsFolder", ".:S~1|Source", ("Source", "S~1")),
        ("FontsFolder", ".:.", ("FontsFolder", "FontsF~1")),
        ("FontsFolder", "T~1|Target:S", ("Target", "T~1")),
        ("OTHER", ".:S", (".", ".")),
        ("FontsFolder", ".:averyverylongsourcename", ("averyverylongsourcename", "FontsF~1")),
        ("X", "averyverylongname", ("averyverylongname", "")),
    ]
    got = values(spark, [x[:2] for x in cases], "k string, d string", installer.folder_names(F.col("k"), F.col("d")))
    assert [tuple(r[0]) for r in got] == [x[2] for x in cases]


def test_codes(spark):
    starts = values(spark, [(n,) for n in (0, 1, 2, 3, 4, 5, None)], "n int", installer.named_code(F.col("n"), installer.START_TYPES, "Unknown"))
    assert starts == [(" Boot Start",), (" System Start",), ("Automatic",), (" Manual",), (" Disabled",), ("Unknown",), ("Unknown",)]
    types = values(spark, [(n,) for n in (1, 2, 0x10, 0x20, 0x100, 0x110)], "n int", installer.named_code(F.col("n"), installer.SERVICE_TYPES, "Unknown"))
    assert types == [("Kernel Driver",), ("File System Driver",), ("SERVICE_WIN32_OWN_PROCESS",), ("SERVICE_WIN32_SHARE_PROCESS",), ("Interactive Process",), ("Unknown",)]
    actions = values(spark, [(n,) for n in (1, 1 + 0x40, 51 + 0xC0, 3, 0x40)], "n int", installer.named_code(F.col("n"), installer.CUSTOM_ACTIONS, "-", installer.ACTION_FLAGS))
    assert actions == [("DLL file stored in a Binary table stream",), ("DLL file stored in a Binary table stream",), ("Property set with formatted text",), ("-",), ("-",)]


def test_compression(spark):
    """(attributes, fake, has_media, word_count) rows of a package, and its class."""
    yes, no = installer.COMPRESSED, 1
    cases = {
        "no media": ([(yes, False, False, 2)], "none"),
        "by count": ([(no, False, True, 6)], "cab"),
        "mixed": ([(yes, False, True, 0), (no, False, True, 0)], "mixed"),
        "fake": ([(yes, False, True, 0), (no, True, True, 0)], "cab"),
        "plain": ([(no, False, True, 0)], "cab"),
    }
    rows = [(k, *r) for k, (x, _) in cases.items() for r in x]
    df = spark.createDataFrame(rows, "k string, a long, f boolean, m boolean, w long")
    got = df.groupBy("k").agg(installer.compression_class(F.col("a"), F.col("f"), F.col("m"), F.col("w")).alias("c")).collect()
    assert {r.k: r.c for r in got} == {k: c for k, (_, c) in cases.items()}


DIRS = "key string, parent string, name string, o long"


def test_deep_orphaned_and_circular_dirs(spark):
    deep = [(f"d{i}", f"d{i - 1}" if i else None, f"n{i}", i) for i in range(200)]
    rows = [*deep, ("o", "lost", "child", 0), ("self", "self", "own", 0), ("x", "y", "x", 0), ("y", "x", "y", 0), ("z", "x", "z", 0), ("dot", "d0", ".", 0), ("in", "dot", "in", 0)]
    got = {r.key: (r.path, r.level) for r in installer.dir_paths(spark.createDataFrame(rows, DIRS), "key", "parent", "name", "/").collect()}
    assert got["d199"] == ("/".join(f"n{i}" for i in range(200)), 199)
    assert got["lost"] == ("lost", 0) and got["o"] == ("lost/child", 1) and got["self"] == ("own", 0)
    assert got["x"] == got["y"] == got["z"] == (None, None)
    assert got["in"] == ("n0/in", 2) and len(got) == len(rows) + 1
    assert installer.dir_paths(spark.createDataFrame([], DIRS), "key", "parent", "name").count() == 0


def test_flat_index(spark):
    dirs = spark.createDataFrame([("a", None, "A", 2), ("b", None, "B", 1), ("c", "a", "C", 1)], DIRS)
    files = spark.createDataFrame([("a", "f1", 2), ("a", "f0", 1), ("c", "g", 1), ("b", "h", 1), (None, "top", 1), ("lost", "l", 1)], "dir string, file string, at long")
    got = installer.flat_index(dirs, files, "key", "parent", "name", "o", "dir", "file", "at").orderBy("item").collect()
    assert [(r.item, r.path) for r in got] == list(enumerate(["top", "B", "B\\h", "A", "A\\f0", "A\\f1", "A\\C", "A\\C\\g", "lost", "lost\\l"], 1))


def test_merged_dirs(spark):
    rows = [("1", None, "Top", 1), ("2", None, "TOP", 2), ("3", "2", "Sub", 1), ("4", "1", "sub", 1), ("5", "3", "x", 1), ("6", None, "Else", 3)]
    chains = installer.dir_chains(spark.createDataFrame(rows, DIRS), "key", "parent", F.col("name"), F.col("o"))
    assert {(r.path, r.n_merged) for r in installer.merged_dirs(chains, "/").collect()} == {("Top", 2), ("Top/sub", 2), ("Top/sub/x", 1), ("Else", 1)}


def test_first_match_prefers_order(spark):
    left = spark.createDataFrame([(1, 10, 5, 7), (2, 10, 6, 7), (3, 11, 5, 7)], "k long, size long, crc long, off long")
    right = spark.createDataFrame([(4, 10, 5, 7, "exact"), (3, 10, 0, 7, "any crc"), (2, 10, 9, 0, "other"), (1, 10, 6, 0, "any offset")], "pos long, size long, crc long, off long, name string")
    got = {r.k: r.name for r in installer.first_match(left, right, ["size"], ["crc", "off"], "k", "pos", "name").collect()}
    assert got == {1: "any crc", 2: "any offset", 3: None}


def test_references_to_a_depth(spark):
    refs = spark.createDataFrame([("a", "b", False), ("b", "c", True), ("c", "a", False), ("a", "c", False)], "parent string, child string, hidden boolean")
    root = spark.createDataFrame([("a",)], "child string")
    rows, whole = installer.referenced(root, refs, 3)
    assert sorted((r.child, r.depth, r.hidden) for r in rows.collect()) == [("a", 0, False), ("a", 2, False), ("b", 1, False), ("c", 1, False), ("c", 2, True)] and not whole
    assert installer.referenced(root, refs.filter("child <> 'a'"), 9)[1] and not installer.referenced(root, refs, 50, 20)[1]


def test_predicates(spark):
    assert values(spark, [(1, 0, 5), (2, 8, 5), (3, 7, 0)], "k long, status long, offset long", "k")[:1] == [(1,)]
    df = spark.createDataFrame([(1, 0, 5), (2, 8, 5), (3, 7, 0)], "k long, status long, offset long")
    assert [r.k for r in installer.valid_files(df).collect()] == [1]
    names = spark.createDataFrame([(".",), ("..",), ("",), ("\0x",), ("x",), ("...",)], "name string")
    assert {r.name for r in installer.real_dirs(names, "name").collect()} == {"x", "..."}
