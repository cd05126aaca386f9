"""Container files as tables: containers, the items in them, and their contents.

A container is a row with its bytes; what a format's index says becomes rows in a
short helper per format, and everything after that is DataFrame work. A file that
can't be read gives a row with a status, never a failed task.
"""

from __future__ import annotations

import email
import email.policy
import re
import struct
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargohold.functions.codecs import decoded_bytes, xor_index
from cargohold.functions.text import mail_name, part_name
from cargohold.sources.options import DEFAULTS, merged

_STRINGS, _LONGS = ("container_id", "module", "path", "owner", "codec", "content_id", "status"), ("item_index", "size", "packed_size", "mtime", "at", "length")
_ITEM = pa.schema([(c, pa.string()) for c in _STRINGS] + [(c, pa.int64()) for c in _LONGS] + [("is_dir", pa.bool_()), ("hidden", pa.bool_()), ("inline", pa.binary()), ("names", pa.list_(pa.string()))])
ITEM = ", ".join([f"{c} string" for c in _STRINGS] + [f"{c} long" for c in _LONGS] + ["is_dir boolean", "hidden boolean", "inline binary", "names array<string>"])
_CONTENT = pa.schema([("container_id", pa.string()), ("item_index", pa.int64()), ("content", pa.binary()), ("status", pa.string())])
Row = dict[str, object]


def first_module(probes: list[tuple[str, Column]]) -> Column:
    """The first module of an ordered list whose probe holds; null if none does."""
    return F.coalesce(*(F.when(probe, F.lit(name)) for name, probe in probes))


def read_containers(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(container_id, content) of the files under path; C3: a glob prunes files before they are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select(F.col("path").alias("container_id"), "content")


def detected(containers: DataFrame, module: str | None = None) -> DataFrame:
    """containers with `module` (B, C1, C5, O2): by the first bytes, or by extension where those say nothing."""
    head = F.hex(F.substring("content", 1, 6))
    n = F.octet_length("content")
    # the whole header of a message, up to the first blank line, however long
    header = F.regexp_extract(F.decode("content", "ISO-8859-1"), r"(?s)\A(.*?)(\r?\n\r?\n|\z)", 1)
    probes = [
        ("vp", head.startswith("56505650")),
        ("xcat", F.col("container_id").rlike(r"(?i)\.cat$")),
        ("mbox", head.startswith("46726F6D20") & (n >= 100)),
        ("bat", head.startswith("20067919") & (n >= 100)),
        ("pak", head.startswith("5041434B")),
        ("mime", n.between(10, 100 << 20) & header.rlike(r"(?im)^(From|Message-ID|MIME-Version):")),
    ]
    return containers.withColumn("module", F.lit(module) if module else first_module(probes))


def _text(raw: bytes, charset: str = "utf-8") -> str:
    return raw.split(b"\0")[0].decode(charset, "replace")


def vp_rows(content: bytes, charset: str = "utf-8") -> Iterator[Row]:
    """B4, D-20: a flat index in which a directory row opens a directory and `..` closes one."""
    version, start, n = struct.unpack_from("<iii", content, 4)
    if version > 2:
        raise ValueError("version")
    stack: list[str] = []
    for k in range(n):
        at, size, raw, mtime = struct.unpack_from("<ii32si", content, start + 44 * k)
        name = _text(raw, charset)
        if name == "..":
            del stack[-1:]
            continue
        is_dir = at == -1 or size == 0
        yield {"path": "\\".join([*stack, name]), "is_dir": is_dir, "size": size, "mtime": mtime or None, "at": at, "length": size}
        if is_dir:
            stack.append(name)


def pak_rows(content: bytes, charset: str = "utf-8") -> Iterator[Row]:
    """64-byte entries: name, offset, length."""
    start, size = struct.unpack_from("<II", content, 4)
    for k in range(size // 64):
        raw, at, n = struct.unpack_from("<56sII", content, start + 64 * k)
        yield {"path": _text(raw, charset).replace("/", "\\"), "size": n, "at": at, "length": n}


def xcat_rows(content: bytes, charset: str = "latin-1") -> Iterator[Row]:
    """An index of lines `name size` after the data file's name; offsets are the running sum, in the data file beside it."""
    lines = [x for x in re.split(rb"[\0\r\n]+", xor_index(content)) if x]
    at = 0
    for line in lines[1:]:
        name, _, size = line.rpartition(b" ")
        yield {"path": name.decode(charset, "replace").replace("/", "\\"), "size": int(size), "at": at, "length": int(size), "codec": "xor33"}
        at += int(size)


def _mail_row(raw: bytes, at: int, end: int) -> Row:
    message = email.message_from_bytes(raw, policy=email.policy.compat32)
    subject = str(email.header.make_header(email.header.decode_header(message["subject"] or "")))
    date = email.utils.parsedate_tz(message["date"] or "")
    return {"path": subject, "owner": email.utils.parseaddr(message["from"] or "")[1], "size": end - at, "at": at, "length": end - at, "mtime": email.utils.mktime_tz(date) if date else None}


def mbox_rows(content: bytes) -> Iterator[Row]:
    """A message from each line that begins with `From `; the path is the subject, named later."""
    starts = [m.start() for m in re.finditer(rb"^From .*\n", content, re.M)]
    for a, z in zip(starts, [*starts[1:], len(content)], strict=True):
        begin = content.index(b"\n", a) + 1
        yield _mail_row(content[begin:z], begin, z)


def bat_rows(content: bytes) -> Iterator[Row]:
    """Records of a 48-byte header and a message; a broken record ends the list."""
    at = struct.unpack_from("<H", content, 4)[0]
    while at + 48 <= len(content):
        magic, head, _, received = struct.unpack_from("<4sIII", content, at)
        size = struct.unpack_from("<I", content, at + 36)[0]
        if magic != b"\x21\x09\x70\x19" or head != 48:
            return
        yield _mail_row(content[at + 48 : at + 48 + size], at + 48, at + 48 + size) | {"mtime": received, "hidden": bool(content[at + 20] & 1)}
        at += 48 + size


def _header_text(value: object) -> str | None:
    """A header's or parameter's value, decoded where it says so."""
    if value is None:
        return None
    text = email.utils.collapse_rfc2231_value(value)
    return str(email.header.make_header(email.header.decode_header(text))) if "=?" in text else str(text)


def mime_rows(content: bytes) -> Iterator[Row]:
    """The headers, then the parts that aren't multipart, in the order of the walk."""
    message = email.message_from_bytes(content, policy=email.policy.compat32)
    headers = "".join(f"{k}: {v}\r\n" for k, v in message.items()).encode("utf-8", "surrogateescape")
    yield {"path": "{headers}", "size": len(headers), "inline": headers}
    for part in message.walk():
        if part.is_multipart() and part.get_content_type() != "message/rfc822":
            continue
        body = part.get_payload(0).as_bytes() if part.get_content_type() == "message/rfc822" else part.get_payload(decode=True) or b""
        # what a name may come from, for part_name
        from_ = [part.get_param("filename", None, "content-disposition"), part.get_param("name"), part["content-location"]]
        yield {"path": "", "size": len(body), "inline": body, "names": [*map(_header_text, from_), part.get_content_type()]}


#: A user's own decoder joins by name.
DECODERS: dict[str, Callable[..., Iterator[Row]]] = {"vp": vp_rows, "pak": pak_rows, "xcat": xcat_rows, "mbox": mbox_rows, "bat": bat_rows, "mime": mime_rows}
_KEEP_WHAT_WAS_READ = {"mbox", "bat"}


def _uint32(at: int) -> Column:
    """The unsigned little-endian integer of four bytes of content, the first being byte `at` from 0."""
    digits = F.hex(F.substring("content", at + 1, 4))
    return F.conv(F.concat(*(F.substring(digits, k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("long")


def _index_only(head: list[Column], start: Column, size: Column) -> Column:
    """head and the index of `size` bytes from `start` on, which is left out if it ends beyond the file: the decoder misses it then."""
    index = F.when(start + size <= F.octet_length("content"), F.col("content").substr((start + 1).try_cast("int"), size.try_cast("int")))
    return F.concat(*head, F.coalesce(index, F.lit(b"")))


#: For formats with an index of fixed width: a container's content without the files, the index moved to behind the header.
_INDEXES: dict[str, Callable[[], Column]] = {
    "vp": lambda: _index_only([F.substring("content", 1, 8), F.lit(struct.pack("<i", 16)), F.substring("content", 13, 4)], _uint32(8), 44 * _uint32(12)),
    "pak": lambda: _index_only([F.substring("content", 1, 4), F.lit(struct.pack("<I", 12)), F.substring("content", 9, 4)], _uint32(4), _uint32(8) - _uint32(8) % 64),
}


def listable(containers: DataFrame, indexed: Iterable[str] = tuple(_INDEXES)) -> DataFrame:
    """(container_id, module, content, n_bytes) of what can be listed: for modules in `indexed` content is the header and the index, n_bytes is of the whole.

    Files of such a container never travel to Python for a listing, however many
    and large they are.
    """
    content = F.col("content")
    for m in indexed:
        # what is too short for a header stays as it is
        content = F.when((F.col("module") == m) & (F.octet_length("content") >= 16), _INDEXES[m]()).otherwise(content)
    found = containers.filter("module IS NOT NULL AND content IS NOT NULL")
    return found.select("container_id", "module", content.alias("content"), F.octet_length("content").cast("long").alias("n_bytes"))


def items_of(containers: DataFrame, decoders: dict[str, Callable[..., Iterator[Row]]] | None = None, options: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """Item rows of detected containers; of a container that can't be read one row with item_index null and a status (C2, D-11).

    Mailboxes keep what could be read before a fault. options: a user's sections
    of keys by module (C8, C9), merged over the defaults and given to the decoder
    as keywords; a module whose section has `enabled` false is not read (C7).
    Decoders of a user's own are given whole contents.
    """
    chosen = merged(DEFAULTS, options or {})
    off = {m for m, x in chosen.items() if x.pop("enabled", "true").lower() in ("0", "false", "no")}
    given = decoders or DECODERS
    known = {m: partial(f, **chosen.get(m, {})) for m, f in given.items() if m not in off}
    indexed = [m for m in _INDEXES if given.get(m) is DECODERS[m]]
    containers = containers.filter(~F.col("module").isin(*off)) if off else containers

    def rows_of(cid: str, module: str, content: bytes, n_bytes: int) -> list[Row]:
        rows: list[Row] = []
        try:
            for k, row in enumerate(known[module](content)):
                if row.get("at", 0) + (row.get("length") or 0) > n_bytes and module != "xcat":
                    raise ValueError("an entry ends beyond the file")
                rows.append({"item_index": k, "status": "ok", "is_dir": False, "hidden": False, "packed_size": row["size"], "codec": "none"} | row)
        except (KeyError, ValueError, IndexError, struct.error, TypeError, LookupError) as e:
            rows = [*(rows if module in _KEEP_WHAT_WAS_READ else []), {"status": f"item_error: {e}"}]
        content_id = cid[:-4] + ".dat" if module == "xcat" else cid
        return [r | {"container_id": cid, "module": module, "content_id": content_id} for r in rows]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # one container at a time: a batch is many MB where contents are whole
            for one in zip(*b.columns, strict=True):
                yield pa.RecordBatch.from_pylist(rows_of(*(x.as_py() for x in one)), _ITEM)

    rows = listable(containers, indexed).mapInArrow(of, ITEM)
    mails = F.col("module").isin("mbox", "bat") & F.col("item_index").isNotNull()
    named = F.when(mails, mail_name(F.col("item_index"), F.col("path"))).when(F.col("names").isNotNull(), part_name(*(F.col("names")[k] for k in range(4)))).otherwise(F.col("path"))
    return rows.withColumn("path", named).drop("names")


def contents_of(items: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_id, item_index, content, status) of files: one task reads a container's bytes once, in the order of places."""
    wanted = items.filter("item_index IS NOT NULL AND NOT is_dir")
    ready = wanted.filter("inline IS NOT NULL").select("container_id", "item_index", F.col("inline").alias("content"), F.lit("ok").alias("status"))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        whole = left["content"][0].as_py() if left.num_rows else None
        out = []
        for r in sorted(right.to_pylist(), key=lambda r: r["at"]):
            content, status = decoded_bytes(None if whole is None else whole[r["at"] : r["at"] + r["length"]], r["codec"])
            out.append({"container_id": r["container_id"], "item_index": r["item_index"], "content": content, "status": status if content is None or len(content) == r["size"] else "size_error"})
        return pa.Table.from_pylist(out, _CONTENT)

    places = wanted.filter("inline IS NULL").select("content_id", "container_id", "item_index", "at", "length", "codec", "size")
    sliced = containers.select(F.col("container_id").alias("content_id"), "content").groupBy("content_id").cogroup(places.groupBy("content_id")).applyInArrow(cut, "container_id string, item_index long, content binary, status string")
    return ready.unionByName(sliced)


def verified(contents: DataFrame, expected: DataFrame) -> DataFrame:
    """Contents with whether `md5` or `crc32` in expected (container_id, item_index, ...) agrees; null where neither is known."""
    known = [c for c in ("md5", "crc32") if c in expected.columns]
    both = contents.join(expected.select("container_id", "item_index", *(F.col(c).alias(f"want_{c}") for c in known)), ["container_id", "item_index"], "left")
    checks = [F.col("want_md5") == F.md5("content")] * ("md5" in known) + [F.col("want_crc32") == F.crc32("content")] * ("crc32" in known)
    return both.withColumn("verified", F.coalesce(*checks) if checks else F.lit(None).cast("boolean")).drop(*(f"want_{c}" for c in known))
