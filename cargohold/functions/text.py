"""Column functions on names, sizes, times and codes of container entries (H and P rows of the survey)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hives by registry root, and bits of file attributes.
HIVES = {0: "HKEY_CLASSES_ROOT", 1: "HKEY_CURRENT_USER", 2: "HKEY_LOCAL_MACHINE", 3: "HKEY_USERS"}
READONLY, HIDDEN, SYSTEM, DIRECTORY, NORMAL, REPARSE, ENCRYPTED = 0x1, 0x2, 0x4, 0x10, 0x80, 0x400, 0x4000
#: Languages, processors and checksum kinds of debug databases, in order of their codes; letters of packed stream names, and what they start at.
LANGUAGES = (
    "Information is not available", "C", "C++", "FORTRAN", "Microsoft Macro Assembler", "Pascal", "BASIC", "COBOL", "Linker-generated module", "Resource module converted with CVTRES tool",
    "POGO optimized module generated with CVTPGD tool", "C#", "Visual Basic", "Intermediate Language Assembly", "Java", "JScript", "Unknown MSIL",
)
PROCESSORS = (
    "Unavailable", "I386", "PENTIUM", "PENTIUMII", "PENTIUMPRO", "PENTIUMIII", "MIPS", "MIPSR4000", "MIPS16", "MIPS32", "MIPS64", "MIPSI", "MIPSII", "MIPSIII", "MIPSIV", "MIPSV",
    "IA64", "IA64_1", "IA64_2", "TRICORE", "X64", "AMD64", "Unknown",
)
CHECKSUMS = ("None", "MD5", "SHA1", "Unknown")
STREAM_LETTERS, STREAM_START = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz._", 0x3800
#: Letters of the ASCII alphabet, which alone are folded where case doesn't count.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIND_MODES = ("wildcard", "substring", "string")
CHARSETS = ("US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16")


def with_trailing(path: Column, sep: str = "\\") -> Column:
    """H3: the path with one separator at its end; an empty path stays empty."""
    return F.when((path == "") | path.endswith(sep), path).otherwise(F.concat(path, F.lit(sep)))


def with_thousands(n: Column) -> Column:
    """H4"""
    return F.format_number(n, 0)


def file_time(ft: Column) -> Column:
    """100 ns ticks since 1601 as a timestamp; zero and null are null."""
    return F.when(ft != 0, F.timestamp_micros(F.floor((ft - 116444736000000000) / 10).cast("long")))


def time_text(t: Column) -> Column:
    """H5"""
    return F.coalesce(F.date_format(t, "dd.MM.yyyy HH:mm:ss"), F.lit("-"))


def date_text(t: Column) -> Column:
    """H6"""
    return F.coalesce(F.date_format(t, "yyyy-MM-dd"), F.lit("-"))


def duration_text(seconds: Column) -> Column:
    """H7: hh:mm:ss."""
    return F.format_string("%02d:%02d:%02d", (seconds / 3600).cast("long"), ((seconds % 3600) / 60).cast("long"), (seconds % 60).cast("long"))


def size_text(n: Column) -> Column:
    """H8: in the largest unit that gives 1 or more, two decimals, then `=` and the plain bytes; bytes alone where they are all there is to say, `0` for none."""
    out = n.cast("string")
    for power, unit in ((10, "KB"), (20, "MB"), (30, "GB"), (40, "TB")):
        out = F.when(n >= 2**power, F.concat(F.format_string(f"%.2f {unit} = ", F.bround(n / float(2**power), 2)), n.cast("string"))).otherwise(out)
    return F.when(n > 0, out).otherwise("0")


def safe_name(name: Column) -> Column:
    """Characters that file names can't have become `_`."""
    return F.regexp_replace(name, r'[:*?"<>|\\/]', "_")


def square_brackets(path: Column) -> Column:
    """H11"""
    return F.translate(path, "<>", "[]")


def trimmed(s: Column) -> Column:
    """Without spaces, CR and LF at both ends."""
    return F.regexp_replace(s, "^[ \\r\\n]+|[ \\r\\n]+$", "")


def mail_subject(s: Column) -> Column:
    """CR, LF and TAB trimmed at both ends; inner CR and LF are spaces."""
    return F.regexp_replace(F.regexp_replace(s, "^[\\r\\n\\t]+|[\\r\\n\\t]+$", ""), "[\\r\\n]", " ")


def mail_name(index: Column, subject: Column) -> Column:
    """`0001 - subject.eml`, 240 characters of the subject; `0001.eml` without one."""
    number = F.lpad(index.cast("string"), 4, "0")
    clean = F.substring(safe_name(mail_subject(subject)), 1, 240)
    return F.when(F.coalesce(clean, F.lit("")) == "", F.concat(number, F.lit(".eml"))).otherwise(F.concat(number, F.lit(" - "), clean, F.lit(".eml")))


def url_name(url: Column) -> Column:
    """What stands before the first `?` and after the last `/` and `\\`; null if that is one character or none."""
    last = F.regexp_extract(F.regexp_extract(url, "^([^?]*)", 1), r"([^/\\]*)$", 1)
    return F.when(F.length(last) > 1, last)


def default_name(content_type: Column) -> Column:
    """A name for an unnamed part, by its type and subtype; parameters after `;` don't count."""
    full = F.trim(F.substring_index(content_type, ";", 1))
    kind, sub = F.lower(F.substring_index(full, "/", 1)), F.lower(F.substring_index(full, "/", -1))
    text = F.when(sub == "html", "index.html").when(sub == "richtext", "message.rtf").otherwise("message.txt")
    return (
        F.when(kind == "image", F.concat(F.lit("image."), F.substring_index(full, "/", -1)))
        .when(kind == "text", text)
        .when((kind == "application") & (sub == "postscript"), "document.ps")
        .when((kind == "message") & (sub == "rfc822"), "message.eml")
        .otherwise("file.dat")
    )


def part_name(disposition: Column, type_name: Column, location: Column, content_type: Column) -> Column:
    """The name of a mail part: the first of these that leaves more than one character of an address, else one by its type."""
    return F.coalesce(url_name(disposition), url_name(type_name), url_name(location), default_name(content_type))


def short_name(s: Column) -> Column:
    """Of `short|long` the long one, else the only one."""
    return F.when(F.instr(s, "|") > 0, F.substring_index(s, "|", -1)).otherwise(s)


def target_dir(default_dir: Column) -> Column:
    """The long target name of `target:source`."""
    return short_name(F.substring_index(default_dir, ":", 1))


def hive(root: Column) -> Column:
    """The hive's name; the current user's by default."""
    found = F.lit(HIVES[1])
    for k, name in HIVES.items():
        found = F.when(root == k, name).otherwise(found)
    return found


def major_version(version: Column) -> Column:
    """Of a packed installer version: bits 12-15 where bit 24 is set, else the low 16 bits over 100 where bit 25 or 26 is."""
    low = version.bitwiseAND(0xFFFF)
    return F.when(F.shiftright(version, 24) == 1, F.shiftright(version, 12).bitwiseAND(0xF)).when(F.shiftright(version, 24).isin(2, 4), F.when(low != 0, F.floor(low / 100)).otherwise(0)).otherwise(0).cast("int")


def without_version(name: Column) -> Column:
    """An ISO name without `;n`."""
    return F.regexp_replace(name, ";[^;]*$", "")


def drive_path(path: Column) -> Column:
    """`c:\\x` as `C_\\x`."""
    return F.when(path.rlike("^[A-Za-z]:"), F.concat(F.upper(F.substring(path, 1, 1)), F.lit("_"), F.substring(path, 3, 1 << 30))).otherwise(path)


def extension(path: Column) -> Column:
    """The name's last dot and what follows; empty without a dot."""
    return F.regexp_extract(path, r"(\.[^./\\]*)$", 1)


def inner_extension(path: Column, content: Column) -> Column:
    """The extension of what a packed game file holds: by the first 20 bytes up to a zero for `.pck`, by a rule for `.pbd` and `.pbb`, else its own."""
    old = extension(path)
    head = F.substring_index(F.decode(F.substring(content, 1, 20), "ISO-8859-1"), "\0", 1)
    inside = F.when(F.contains(head, F.lit("<?xml")), ".xml").when(head.startswith("DDS"), ".dds").otherwise(".txt")
    return F.when(old == ".pck", F.coalesce(inside, F.lit(".txt"))).when(old == ".pbd", ".bod").when(old == ".pbb", ".bob").otherwise(old)


def stream_name(packed: Column) -> Column:
    """A packed stream name's letters, two in a character; null if a character is outside the range."""
    letters = F.array(*map(F.lit, STREAM_LETTERS))
    codes = F.transform(F.filter(F.split(packed, ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int") - STREAM_START)

    def unpacked(c: Column) -> Column:
        high = F.shiftright(c, 6)
        low = F.element_at(letters, c.bitwiseAND(63) + 1)
        return F.when(high < 64, F.concat(low, F.element_at(letters, F.least(high, F.lit(63)) + 1))).when(high == 64, low).otherwise("!")

    ok = F.forall(codes, lambda c: (c >= 0) & (c <= 64 * 65))
    # a character of one letter ends the name
    n = F.array_position(F.transform(codes, lambda c: F.shiftright(c, 6) == 64), True).cast("int")
    return F.when(ok, F.array_join(F.transform(F.when(n > 0, F.slice(codes, 1, n)).otherwise(codes), unpacked), ""))


def decoded_text(raw: Column, charset: Column) -> Column:
    """Bytes as text by a column that names the charset, case aside; null for one that isn't known."""
    out = F.lit(None).cast("string")
    for name in CHARSETS:
        out = F.when(F.upper(charset) == name, F.decode(raw, name)).otherwise(out)
    return out


def image_name(raw: Column) -> Column:
    """A Unicode name of a disc image: UTF-8, or big-endian UTF-16 if a byte is below 32; without its version."""
    wide = F.hex(raw).rlike("^(..)*[01]")
    return F.regexp_replace(F.when(wide, F.decode(raw, "UTF-16BE")).otherwise(F.decode(raw, "UTF-8")), ";[^;]*$", "")


def folded(s: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(s, _UPPER, _LOWER)


def found_by(name: Column, search: str, mode: str = "wildcard", match_case: bool = False) -> Column:
    """Whether a name fits: "string" as a whole, "substring" somewhere, "wildcard" with `*` for any run and `?` for one character. Only A-Z are folded."""
    if mode not in FIND_MODES:
        raise ValueError(f"mode is one of {FIND_MODES}")
    text, want = (name, search) if match_case else (folded(name), search.translate(str.maketrans(_UPPER, _LOWER)))
    if mode == "string":
        return text == want
    if mode == "substring":
        return F.contains(text, F.lit(want))
    return text.rlike("(?s)^" + "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() else "\\" + c) for c in want) + r"\z")


def find_bytes(content: Column, pattern: bytes) -> Column:
    """The place, from 0, of the first occurrence of some bytes; null if there is none, or nothing is asked for."""
    at = F.instr(F.decode(content, "ISO-8859-1"), pattern.decode("latin-1"))
    return F.when((at > 0) & F.lit(len(pattern) > 0), at - 1)


def coded_name(code: Column, names: tuple[str, ...], default: str = "Unknown") -> Column:
    """The name at a code's place in LANGUAGES, PROCESSORS or CHECKSUMS (whose default is `-`)."""
    return F.coalesce(F.when((code >= 0) & (code < len(names)), F.element_at(F.array(*map(F.lit, names)), F.least(code, F.lit(len(names) - 1)).cast("int") + 1)), F.lit(default))


def crc16(content: Column) -> Column:
    """I16: the CRC-16 of short binary values (polynomial 0x1021, from 0), as descriptor tags have it."""
    size = F.octet_length(content)
    codes = F.transform(F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")), lambda i: F.conv(F.hex(F.substring(content, i, F.lit(1))), 16, 10).cast("int"))

    def step(crc: Column, byte: Column) -> Column:
        x = F.shiftright(crc, 8).bitwiseXOR(byte)
        x = x.bitwiseXOR(F.shiftright(x, 4))
        return F.shiftleft(crc, 8).bitwiseXOR(F.shiftleft(x, 12)).bitwiseXOR(F.shiftleft(x, 5)).bitwiseXOR(x).bitwiseAND(0xFFFF)

    return F.when(content.isNotNull(), F.aggregate(codes, F.lit(0), step))


def attribute_flags(bits: Column) -> Column:
    """The surfaced bits as letters."""
    letters = ((READONLY, "R"), (HIDDEN, "H"), (SYSTEM, "S"), (DIRECTORY, "D"), (REPARSE, "L"), (ENCRYPTED, "E"))
    return F.concat(*(F.when(bits.bitwiseAND(b) != 0, c).otherwise("") for b, c in letters))


def item_attributes(package_bits: Column) -> Column:
    """Attribute bits of an installer's file row: 1, 2 and 4 are read-only, hidden and system; a file with none of them is a normal one."""
    own = package_bits.bitwiseAND(READONLY | HIDDEN | SYSTEM)
    return F.when(own == 0, F.lit(NORMAL).cast("long")).otherwise(own)


def matches_filter(path: Column, masks: str, empty: bool = True) -> Column:
    """Whether the name fits one of `;`-separated wildcards, case aside; an empty list gives `empty`."""
    patterns = [m.strip() for m in masks.split(";") if m.strip()]
    if not patterns:
        return F.lit(empty)
    regex = "|".join("".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() else "\\" + c) for c in m) for m in patterns)
    return F.regexp_extract(path, r"([^/\\]*)$", 1).rlike(f"(?is)^({regex})$")
