"""Round trips, corrupt containers, codecs and sinks."""

import bz2
import gzip
import lzma
import struct
import zlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cargohold.functions import codecs
from cargohold.sinks import extract
from cargohold.sources import containers as c
from cargohold.sources import options, writers
from cargohold.streaming import inbox

FILES = [("a\\b\\one.txt", b"first", 5), ("two.txt", b"second file", 6), ("a\\three.bin", bytes(range(256)), 7)]


def listed(spark, rows, module=None):
    found = c.detected(spark.createDataFrame(rows, "container_id string, content binary"), module)
    items = c.items_of(found)
    return found, items


def test_round_trips(spark):
    cat, dat = writers.xcat_bytes(FILES, "x.dat")
    found, items = listed(spark, [("v", writers.vp_bytes(FILES)), ("p", writers.pak_bytes(FILES)), ("x.cat", cat), ("x.dat", dat)])
    got = {(r.container_id, r.path): bytes(r.content) for r in items.join(c.contents_of(items, found).drop("status"), ["container_id", "item_index"]).collect()}
    assert got == {(cid, p): data for cid in ("v", "p", "x.cat") for p, data, _ in FILES}


def test_corrupt_containers_give_a_status(spark):
    good = writers.vp_bytes(FILES)
    rows = [("short", b"VPVP\x02"), ("beyond", good[:40]), ("version", b"VPVP" + struct.pack("<iii", 9, 16, 0)), ("empty", b""), ("null", None), ("pak", b"PACK" + struct.pack("<II", 1 << 30, 64))]
    _, items = listed(spark, rows)
    got = {r.container_id: r for r in items.collect()}
    assert set(got) == {"short", "beyond", "version", "pak"}
    assert all(r.status.startswith("item_error") and r.item_index is None for r in got.values())


def test_mailboxes(spark):
    mail = b"From: A <a@x.org>\nSubject: Hello:\tyou\nDate: Thu, 01 Jan 1970 00:00:09 +0000\n\nbody" + b" " * 100
    box = b"From me\n" + mail + b"\nFrom you\n" + mail.replace(b"Subject: Hello:\tyou\n", b"")
    bat = writers.bat_bytes([(mail, 77, True), (mail, 78, False)]) + b"broken record"
    _, items = listed(spark, [("m", box), ("b", bat)])
    got = {(r.container_id, r.item_index): (r.path, r.owner, r.mtime, r.hidden) for r in items.collect()}
    assert got == {("m", 0): ("0000 - Hello_\tyou.eml", "a@x.org", 9, False), ("m", 1): ("0001.eml", "a@x.org", 9, False), ("b", 0): ("0000 - Hello_\tyou.eml", "a@x.org", 77, True), ("b", 1): ("0001 - Hello_\tyou.eml", "a@x.org", 78, False)}


def test_own_decoder(spark):
    found = c.detected(spark.createDataFrame([("z", b"abc")], "container_id string, content binary"), "mine")
    items = c.items_of(found, {"mine": lambda content: iter([{"path": "all", "size": len(content), "at": 0, "length": len(content)}])})
    assert [(r.path, r.size) for r in items.collect()] == [("all", 3)]


@given(st.binary(max_size=300))
def test_codecs(data):
    frame = zlib.compress(data, wbits=-15)
    packed = {"zlib": zlib.compress(data), "gzip": gzip.compress(data), "deflate": frame, "bzip2": bz2.compress(data), "lzma": lzma.compress(data, lzma.FORMAT_ALONE), "framed": struct.pack("<H", len(frame)) + frame if len(frame) < 1 << 16 else b"", "xor33": codecs.xor_constant(data, 0x33), "xor_index": codecs.xor_index(data)}
    for codec, x in packed.items():
        assert codecs.decoded_bytes(x, codec) == (data, "ok")
    assert codecs.decoded_bytes(b"\xff\xff" + data, "zlib")[1] != "ok"
    assert codecs.decoded_bytes(None, "zlib") == (None, "missing")


def test_verify(spark):
    contents = spark.createDataFrame([("c", 1, b"x"), ("c", 2, b"y"), ("c", 3, b"z")], "container_id string, item_index long, content binary")
    want = spark.createDataFrame([("c", 1, zlib.crc32(b"x")), ("c", 2, 7)], "container_id string, item_index long, crc32 long")
    assert {r.item_index: r.verified for r in c.verified(contents, want).collect()} == {1: True, 2: False, 3: None}


def test_files_are_written_inside_root_only(spark, tmp_path):
    rows = [("c", 1, "d\\one.txt", b"1"), ("c", 2, "..\\..\\evil.txt", b"2"), ("c", 3, "none", None)]
    status = extract.write_files(spark.createDataFrame(rows, "container_id string, item_index long, target string, content binary"), str(tmp_path))
    assert {r.item_index: r.status for r in status.collect()} == {1: "ok", 2: "refused", 3: "refused"}
    assert (tmp_path / "d" / "one.txt").read_bytes() == b"1"


def test_policies(spark):
    items = spark.createDataFrame([("c", 1, "a\\x"), ("c", 2, "a\\y")], "container_id string, item_index long, path string")
    there = spark.createDataFrame([("c", "out\\x")], "container_id string, target string")
    got = {p: {r.item_index: (r.target, r.action) for r in extract.planned(items, there, "out", "partial", "a", p).collect()} for p in extract.POLICIES}
    assert got["skip"][1] == ("out\\x", "skip") and got["rename"][1] == ("out\\x~1", "rename") and got["overwrite"][2] == ("out\\y", "write")


def test_inbox_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vp").write_bytes(writers.vp_bytes(FILES))
    inbox.stored(inbox.watched(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter(~F.col("is_dir")).count() == len(FILES)


def test_options_and_space(spark, tmp_path):
    got = options.merged({"MBOX": {"Charset": "a", "x": "1"}}, {"mbox": {"CHARSET": "b", "X": "-"}, "new": {"k": "v"}})
    assert got == {"mbox": {"charset": "b"}, "new": {"k": "v"}}
    plan = spark.createDataFrame([("write", 1 << 62), ("skip", 1 << 62)], "action string, size long")
    assert not extract.fits(plan, str(tmp_path)) and extract.fits(plan.filter("action = 'skip'"), str(tmp_path))


def test_long_header_and_body_lines(spark):
    """A header is searched up to its blank line, however long, and the body not at all."""
    chain = b"".join(b"Received: from host%d\r\n" % i for i in range(500))
    rows = [("far", chain + b"From: a@x.org\r\n\r\nbody"), ("body", b"Some text\n\nFrom: nobody\n"), ("no end", b"X: y\nMIME-Version: 1.0")]
    assert {r.container_id: r.module for r in c.detected(spark.createDataFrame(rows, "container_id string, content binary")).collect()} == {"far": "mime", "body": None, "no end": "mime"}


def test_part_names(spark):
    """Disposition, then type, then location, each cut like an address; names of one character don't count."""
    heads = {
        b'Content-Type: text/plain; name="t.txt"\nContent-Disposition: attachment; filename="=?utf-8?q?caf=C3=A9=2Etxt?="': "caf\u00e9.txt",
        b'Content-Type: text/plain; name="c:\\\\d\\\\t.txt"\nContent-Disposition: attachment; filename="x"': "t.txt",
        b'Content-Type: image/png; name="/"\nContent-Location: http://x.org/a/pic.png?s=1': "pic.png",
        b"Content-Type: image/PNG": "image.png",
        b"Content-Type: text/richtext": "message.rtf",
        b"Content-Type: text/css": "message.txt",
        b"Content-Type: application/postscript": "document.ps",
        b"Content-Type: application/zip": "file.dat",
        b"X-None: 1": "message.txt",
    }
    mail = b"From: a@b\nContent-Type: multipart/mixed; boundary=q\n\n" + b"".join(b"--q\n" + h + b"\n\nx\n" for h in heads) + b"--q--\n"
    _, items = listed(spark, [("m", mail)])
    assert [r.path for r in items.orderBy("item_index").collect()] == ["{headers}", *heads.values()]


def test_options_reach_decoders(spark):
    name = "\u00e9.txt".encode("latin-1")
    pak = struct.pack("<4sII", b"PACK", 12, 64) + struct.pack("<56sII", name, 12, 0)
    found = c.detected(spark.createDataFrame([("p", pak)], "container_id string, content binary"))
    assert c.items_of(found, options={"PAK": {"Charset": "latin-1"}}).first().path == "\u00e9.txt"
    assert c.items_of(found).first().path == "\ufffd.txt"
    assert c.items_of(found, options={"pak": {"enabled": "false"}}).count() == 0


def test_empty_files_are_packed(spark):
    found, items = listed(spark, [("p", writers.pak_bytes([("e", b"", 0), ("f", b"x", 0)]))])
    got = {r.path: bytes(r.content) for r in items.join(c.contents_of(items, found).drop("status"), ["container_id", "item_index"]).collect()}
    assert got == {"e": b"", "f": b"x"}


def test_times_and_attributes_come_back(spark, tmp_path):
    rows = [("c", 1, "a", b"1", 1, 1_000_000), ("c", 2, "b", b"2", 0, 0), ("c", 3, "d", b"3", None, None)]
    schema = "container_id string, item_index long, target string, content binary, attributes long, mtime long"
    for _ in range(2):  # the second time over a read-only file
        status = extract.write_files(spark.createDataFrame(rows, schema), str(tmp_path))
        assert {r.status for r in status.collect()} == {"ok"}
    assert (tmp_path / "a").stat().st_mtime == 1_000_000 and (tmp_path / "a").stat().st_mode & 0o222 == 0
    assert (tmp_path / "b").stat().st_mtime > 1_000_000 and (tmp_path / "b").stat().st_mode & 0o200


def test_failed_write_leaves_nothing(tmp_path):
    (tmp_path / "there").mkdir()
    (tmp_path / "there" / "full").write_bytes(b"")
    assert extract._put(str(tmp_path), "there", b"x", None, None).startswith("write_error")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["there"]


def test_plan_keeps_containers_in_order(spark):
    """Over several partitions, a container's rows follow each other by index."""
    items = spark.createDataFrame([(f"c{i % 3}", i, f"a\\{i}") for i in range(200)], "container_id string, item_index long, path string").repartition(9)
    plan = extract.planned(items, items.select("container_id", F.col("path").alias("target")).limit(0), "out", "full")
    rows = plan.select(F.spark_partition_id().alias("p"), "container_id", "item_index").collect()
    in_order = sorted((r.p, k, r.container_id, r.item_index) for k, r in enumerate(rows))
    assert len({p for p, *_ in in_order}) > 1
    assert [(cid, i) for _, _, cid, i in in_order] == sorted((cid, i) for _, _, cid, i in in_order)


def test_beside(spark):
    df = spark.createDataFrame([("file:/x/y/box.vp",), ("c:\\d\\a.pak",), ("alone",)], "p string")
    assert [r[0] for r in df.select(extract.beside(F.col("p"))).collect()] == ["file:/x/y", "c:\\d", ""]


def test_listing_sends_the_index_only(spark):
    files = [(f"a\\{k}.bin", bytes([k]) * 100_000, 1 + k) for k in range(8)]
    vp, pak = writers.vp_bytes(files), writers.pak_bytes(files)
    beyond = struct.pack("<4sII", b"PACK", 12, 64) + struct.pack("<56sII", b"far", 1 << 20, 5)  # n_bytes decides, not what is sent
    rows = [("v", vp), ("p", pak), ("short", pak[:14]), ("cut", pak[:-1]), ("high", struct.pack("<4sII", b"PACK", (1 << 32) - 64, (1 << 32) - 1) + b"x" * 99), ("odd", pak[:8] + struct.pack("<I", 8 * 64 + 63) + pak[12:]),
            ("none", b"PACK" + struct.pack("<II", 12, 0) + b"x" * 9), ("far", beyond), ("minus", vp[:12] + struct.pack("<i", -1) + vp[16:]), ("many", vp[:12] + struct.pack("<i", 1 << 30) + vp[16:])]
    found, items = listed(spark, rows)
    sent = {r.container_id: r for r in c.listable(found).collect()}
    assert {k: len(r.content) for k, r in sent.items() if k in "vp"} == {"v": 16 + 44 * 24, "p": 12 + 64 * 8}
    assert {k: r.n_bytes for k, r in sent.items()} == {k: len(x) for k, x in rows}
    got = {k: [(r.path, r.size, r.at, r.length) for r in items.filter(F.col("item_index").isNotNull() & (F.col("container_id") == k)).orderBy("item_index").collect()] for k, _ in rows}
    whole = {"v": c.vp_rows(vp), "p": c.pak_rows(pak), "odd": c.pak_rows(pak)}
    assert got == {k: [(r["path"], r["size"], r["at"], r["length"]) for r in whole.get(k, ())] for k, _ in rows}
    failed = {r.container_id for r in items.filter("item_index IS NULL AND status LIKE 'item_error%'").collect()}
    assert failed == {"short", "cut", "high", "far", "many"}
    # a decoder of one's own sees all bytes
    own = c.items_of(found.filter("container_id = 'p'"), {"pak": lambda content, charset: iter([{"path": "all", "size": len(content), "at": 0, "length": len(content)}])})
    assert own.first().size == len(pak)
