"""More queries of the container algebra: lookups, links, groups of files and reports. Registered by cargohold.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargohold.functions import text as fn
from cargohold.operators import installer, ordered
from cargohold.plans import reports
from cargohold.queries import query, table
from cargohold.sinks import extract
from cargohold.sources import containers


@query("""WITH f AS (SELECT 'o' || o_orderkey AS path, o_orderkey * 7 % 1000003 AS item, o_custkey AS comp FROM orders)
SELECT s_suppkey, coalesce((SELECT min_by(path, item) FROM f WHERE comp = s_suppkey), s_suppkey::VARCHAR) AS command FROM supplier""")
def service_file(spark, sf_dir):
    """A service's command: the first file of its component in the order of the flat index; the component's key if there is none."""
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("path"), (F.col("o_orderkey") * 7 % 1000003).alias("item"), F.col("o_custkey").alias("comp"))
    services = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("comp"))
    return installer.service_commands(services, files, "comp", "path", "item").select("s_suppkey", "command")


@query("""SELECT p_partkey, n_nationkey FROM part JOIN nation ON lower('Nation_' || (p_size % 30)) = lower(n_name)""")
def cab_entry_join(spark, sf_dir):
    """Files and the entries named by their keys, case aside; keys without an entry drop out."""
    files = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Nation_"), F.col("p_size") % 30).alias("key"))
    entries = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return installer.cab_entries(files, entries, "key", "n_name").select("p_partkey", "n_nationkey")


@query("""SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def positional_dirs(spark, sf_dir):
    """The directory at a file's position in the directory table."""
    dirs = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return table(spark, sf_dir, "supplier").join(dirs, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@query("""SELECT md5(o_orderkey::VARCHAR || '.dat') AS name_hash, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey || '.dat' END AS name FROM orders""")
def listfile_names(spark, sf_dir):
    """Entries known by hash only get their names from lists, which repeat names and have others besides; unlisted ones keep none."""
    o = table(spark, sf_dir, "orders").select(F.concat("o_orderkey", F.lit(".dat")).alias("name"), "o_orderkey")
    lists = o.filter("o_orderkey % 3 > 0").select("name").unionAll(o.filter("o_orderkey % 6 > 3").select("name")).unionAll(o.select(F.concat("name", F.lit(".bak"))))
    return installer.named_entries(o.select(F.md5("name").alias("name_hash")), lists, "name_hash", "name")


@query("""SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey) AS last, max(o_orderkey) - min(o_orderkey) + 1 AS n_files, round(sum(o_totalprice), 2) AS unpacked FROM orders GROUP BY 1""")
def group_stats(spark, sf_dir):
    """number and size of a group's files."""
    groups = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.round(F.sum("o_totalprice"), 2).alias("unpacked"))
    return installer.file_groups(groups)


_VOLUMES = "SELECT s_suppkey AS volume, s_suppkey * 30 AS first, s_suppkey * 30 + 30 + (s_suppkey % 2) * 15 AS last FROM supplier"


@query(f"""WITH v AS ({_VOLUMES}), f AS (SELECT o_orderkey FROM orders), e AS (SELECT o_orderkey, min(volume) AS e FROM f JOIN v ON o_orderkey BETWEEN first AND last - 1 GROUP BY 1)
SELECT o_orderkey, string_agg(volume, ',' ORDER BY volume) AS volumes FROM f JOIN v ON o_orderkey BETWEEN first AND last LEFT JOIN e USING (o_orderkey) WHERE e IS NULL OR volume <= e GROUP BY 1""")
def spanned_volumes(spark, sf_dir):
    """The volumes that a file spans: all that end with it, up to the first that goes on."""
    volumes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("volume"), (F.col("s_suppkey") * 30).alias("first"), F.expr("s_suppkey * 30 + 30 + (s_suppkey % 2) * 15").alias("last"))
    found = installer.spanned_volumes(table(spark, sf_dir, "orders").select("o_orderkey"), volumes, "o_orderkey")
    return found.select("o_orderkey", F.array_join(F.col("volumes").cast("array<string>"), ",").alias("volumes"))


@query("""SELECT o_orderkey, 'folder ' || (o_orderkey // 50) || '/' || o_orderkey AS path FROM orders""")
def index_range_paths(spark, sf_dir):
    """D-19: folders own ranges of file indices."""
    folders = table(spark, sf_dir, "orders").select((F.expr("o_orderkey div 50")).alias("folder")).distinct().select("folder", (F.col("folder") * 50).alias("first"), (F.col("folder") * 50 + 49).alias("last"))
    found = ordered.in_ranges(table(spark, sf_dir, "orders").select("o_orderkey"), folders, "o_orderkey", "first", "last", 50)
    return found.select("o_orderkey", F.concat(F.lit("folder "), "folder", F.lit("/"), "o_orderkey").alias("path"))


@query("""WITH r AS (SELECT l_partkey AS block, 'f' || l_orderkey || '_' || l_linenumber AS name FROM lineitem) SELECT name, min(name) OVER (PARTITION BY block) AS item, count(*) OVER (PARTITION BY block) AS links FROM r""")
def hard_links(spark, sf_dir):
    """D-23: names that share a file entry are one item with several links."""
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("block"), F.concat(F.lit("f"), "l_orderkey", F.lit("_"), "l_linenumber").alias("name"))
    return installer.linked_items(refs, "block", "name").select("name", "item", "links")


@query("""SELECT c_custkey AS id, length(bin(c_custkey)) - 1 AS depth, c_custkey % 5 = 0 AS hidden FROM customer WHERE c_custkey > 0 AND length(bin(c_custkey)) - 1 < 6""")
def ref_tree(spark, sf_dir):
    """D-21: references from a root, to a depth, with the hidden flag of each name."""
    refs = table(spark, sf_dir, "customer").filter("c_custkey > 1").select(F.expr("c_custkey div 2").alias("parent"), F.col("c_custkey").alias("child"), (F.col("c_custkey") % 5 == 0).alias("hidden"))
    return installer.referenced(spark.createDataFrame([(1,)], "child long"), refs, 6)[0].select(F.col("child").alias("id"), "depth", "hidden")


@query("""WITH v AS (SELECT 'data' || (s_suppkey // 4) || '_' || (s_suppkey % 4) || '.cab' AS path, CASE WHEN s_suppkey % 7 = 0 THEN 'odd' ELSE 'sig5' END AS mark FROM supplier),
h AS (SELECT *, regexp_replace(path, '[0-9]*\\.[^.]*$', '') AS set, regexp_extract(path, '([0-9]*)\\.[^.]*$', 1)::INT AS volume FROM v)
SELECT a.set AS volume_set, count(*) AS n, min(b.path) AS first FROM h a JOIN h b ON a.set = b.set AND a.mark = b.mark WHERE a.volume = 1 GROUP BY 1""")
def volume_groups(spark, sf_dir):
    """The files of a multi-volume container: those whose name without number and whose signature and version are those of its first."""
    v = table(spark, sf_dir, "supplier").select(F.expr("concat('data', s_suppkey div 4, '_', s_suppkey % 4, '.cab')").alias("path"), F.when(F.col("s_suppkey") % 7 == 0, "odd").otherwise("sig5").alias("mark"))
    return installer.volume_sets(v, "path", ["mark"], 1).groupBy("volume_set").agg(F.count("*").alias("n"), F.min("path").alias("first"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'index.html' WHEN 1 THEN 'message.txt' WHEN 2 THEN 'image.PNG' WHEN 3 THEN 'file.dat' WHEN 4 THEN 'document.ps' ELSE 'message.rtf' END AS name,
CASE page_id % 4 WHEN 0 THEN CASE WHEN contains(split_part(left(html, 20), chr(0), 1), '<?xml') THEN '.xml' WHEN starts_with(html, 'DDS') THEN '.dds' ELSE '.txt' END WHEN 1 THEN '.bod' WHEN 2 THEN '.bob' ELSE '.PCK' END AS ext FROM pages""")
def default_names(spark, sf_dir):
    """Names by content type; extensions by first bytes or by rule."""
    kind = F.element_at(F.array(*map(F.lit, ("text/HTML", "Text/plain; charset=x", "image/PNG", "x/y", "application/PostScript", "text/richtext"))), (F.col("page_id") % 6 + 1).cast("int"))
    path = F.element_at(F.array(*map(F.lit, ("a\\b.c.pck", "x.pbd", "x.pbb", "x.PCK"))), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", fn.default_name(kind).alias("name"), fn.inner_extension(path, F.encode("html", "UTF-8")).alias("ext"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size % 16 WHEN 1 THEN (p_size * 100 + 7) // 100 ELSE 0 END::INTEGER AS major FROM part""")
def installer_version(spark, sf_dir):
    """H22"""
    packed = F.expr("CAST(CASE p_partkey % 3 WHEN 0 THEN (1 << 24) + ((p_size % 16) << 12) WHEN 1 THEN (2 << 24) + p_size * 100 + 7 ELSE 9 << 24 END AS BIGINT)")
    return table(spark, sf_dir, "part").select("p_partkey", fn.major_version(packed).alias("major"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Real Source' WHEN 1 THEN '.' WHEN 2 THEN n_name ELSE 'FontsFolder' END AS folder,
CASE n_nationkey % 4 WHEN 0 THEN 'SRC~1' WHEN 1 THEN '.' WHEN 2 THEN 'N~1' ELSE 'FontsF~1' END AS short_name FROM nation""")
def special_folders(spark, sf_dir):
    """D-13, H18: of special folders `.` gives way to the source's name or the key; other folders keep it."""
    at = (F.col("n_nationkey") % 4 + 1).cast("int")
    key = F.element_at(F.array(*map(F.lit, ("ProgramFilesFolder", "OTHER", "FontsFolder", "FontsFolder"))), at)
    default = F.element_at(F.array(F.lit(".:SRC~1|Real Source"), F.lit(".:src"), F.concat(F.lit("N~1|"), "n_name", F.lit(":src")), F.lit(".:.")), at)
    names = installer.folder_names(key, default)
    return table(spark, sf_dir, "nation").select("n_nationkey", names["name"].alias("folder"), names["short_name"].alias("short_name"))


@query("""SELECT event_id FROM events WHERE event_type <> 'click' AND value > 0 AND user_id > 3""")
def predicates(spark, sf_dir):
    """P5: features that are shown, of the events that aren't clicks."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") > 3, 1).otherwise(0).alias("Level"), F.when(F.col("value") > 0, 1).otherwise(0).alias("Display"), "event_type")
    return installer.visible_features(rows.filter("event_type <> 'click'")).select("event_id")


@query("""SELECT p_partkey FROM part WHERE (p_size & 8) = 0 AND p_partkey % 5 <> 0""")
def valid_files(spark, sf_dir):
    """File rows without the invalid bit and with data."""
    return installer.valid_files(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("status"), (F.col("p_partkey") % 5).alias("offset"))).select("p_partkey")


@query("""SELECT page_id FROM pages WHERE page_id % 4 > 1 AND NOT contains(url, '* Linker *') AND NOT contains(url, 'Import:')""")
def source_modules(spark, sf_dir):
    """Modules that neither the linker made nor an import names."""
    name = F.element_at(F.array(F.concat(F.lit("* Linker *"), "url"), F.concat("url", F.lit("Import:x")), F.col("url"), F.concat(F.lit("import:"), "url")), (F.col("page_id") % 4 + 1).cast("int"))
    return installer.source_modules(table(spark, sf_dir, "pages").select("page_id", name.alias("name")), "name").select("page_id")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 4 THEN '...' ELSE p_name END AS name FROM part WHERE p_partkey % 6 > 3""")
def real_dirs(spark, sf_dir):
    """Directory entries that are directories of their own."""
    name = F.element_at(F.array(F.lit("."), F.lit(".."), F.lit(""), F.concat(F.lit("\0"), "p_name"), F.lit("..."), F.col("p_name")), (F.col("p_partkey") % 6 + 1).cast("int"))
    return installer.real_dirs(table(spark, sf_dir, "part").select("p_partkey", name.alias("name")), "name")


@query("""SELECT n_nationkey, 'Volume_#' || n_nationkey AS label FROM nation WHERE n_regionkey = 2""")
def healthy_volumes(spark, sf_dir):
    """Healthy volumes by their default labels."""
    status = F.element_at(F.array(*map(F.lit, ("Failed", "FailedRedundancy", "Healthy", "healthy", ""))), (F.col("n_regionkey") + 1).cast("int"))
    found = installer.healthy_volumes(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").alias("index"), status.alias("status")))
    return found.select("n_nationkey", "label")


@query(f"""SELECT p_partkey, regexp_full_match(lower(p_brand), 'br.*#.3') AS wild, contains(lower(p_type), 'an') AS part, p_brand = 'Brand#13' AS whole FROM part""")
def find_names(spark, sf_dir):
    """Wildcard without case, substring without case, whole with case."""
    return table(spark, sf_dir, "part").select("p_partkey", fn.found_by(F.col("p_brand"), "BR*#?3").alias("wild"), fn.found_by(F.col("p_type"), "AN", "substring").alias("part"), fn.found_by(F.col("p_brand"), "Brand#13", "string", True).alias("whole"))


@query("""SELECT page_id, CASE WHEN instr(html, '<body') > 0 THEN octet_length(encode(left(html, instr(html, '<body') - 1)))::INTEGER END AS at FROM pages""")
def byte_search(spark, sf_dir):
    """Where a sequence of bytes stands first."""
    return table(spark, sf_dir, "pages").select("page_id", fn.find_bytes(F.encode("html", "UTF-8"), b"<body").alias("at"))


@query("""SELECT n_nationkey, n_name || ' é' AS name, CASE WHEN n_nationkey % 5 < 4 THEN n_name END AS plain FROM nation""")
def charset_names(spark, sf_dir):
    """Names in the character set that a column names, and names of disc images."""
    n = table(spark, sf_dir, "nation")
    at, full = (F.col("n_nationkey") % 5 + 1).cast("int"), F.concat("n_name", F.lit(" é"))
    raw = F.when(at % 2 == 1, F.encode(F.concat(full, F.lit(";1")), "UTF-16BE")).otherwise(F.encode(full, "UTF-8"))
    charset = F.element_at(F.array(*map(F.lit, ("us-ascii", "iso-8859-1", "utf-8", "utf-16le", "klingon"))), at)
    own = F.when(at == 4, F.encode("n_name", "UTF-16LE")).otherwise(F.encode("n_name", "UTF-8"))
    return n.select("n_nationkey", fn.image_name(raw).alias("name"), fn.decoded_text(own, charset).alias("plain"))


@query("""SELECT n_nationkey, 'SummaryInformation!x' AS name, CASE n_regionkey WHEN 0 THEN 'Information is not available' WHEN 1 THEN 'C' WHEN 2 THEN 'C++' WHEN 3 THEN 'FORTRAN' ELSE 'Microsoft Macro Assembler' END AS language,
CASE WHEN n_nationkey = 0 THEN 'None' WHEN n_nationkey = 1 THEN 'MD5' WHEN n_nationkey = 2 THEN 'SHA1' WHEN n_nationkey = 3 THEN 'Unknown' ELSE '-' END AS checksum FROM nation""")
def coded_names(spark, sf_dir):
    """Packed stream names, and names of codes."""
    letters = {c: i for i, c in enumerate(fn.STREAM_LETTERS)}
    pairs = ["Su", "mm", "ar", "yI", "nf", "or", "ma", "ti", "on"]
    packed = "".join(chr(fn.STREAM_START + letters[a] + 64 * letters[b]) for a, b in pairs) + chr(fn.STREAM_START + 64 * 65) + chr(fn.STREAM_START + letters["x"] + 64 * 64)
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", fn.stream_name(F.lit(packed)).alias("name"), fn.coded_name(F.col("n_regionkey"), fn.LANGUAGES).alias("language"), fn.coded_name(F.col("n_nationkey"), fn.CHECKSUMS, "-").alias("checksum"))


@query("""WITH RECURSIVE d AS (SELECT 'R' || r_regionkey AS key, NULL::VARCHAR AS parent, r_name AS name, r_regionkey AS o FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name, 100 - n_nationkey FROM nation),
t AS (SELECT key, name, name AS path, '1' || lpad(o::VARCHAR, 3, '0') AS walk FROM d WHERE parent IS NULL UNION ALL SELECT d.key, d.name, t.path || '/' || d.name, t.walk || '1' || lpad(o::VARCHAR, 3, '0') FROM d JOIN t ON d.parent = t.key),
f AS (SELECT s_name AS name, path || '/' || s_name AS path, walk || '0' || lpad(s_suppkey::VARCHAR, 19, '0') AS walk FROM supplier JOIN t ON t.key = 'N' || s_nationkey)
SELECT row_number() OVER (ORDER BY walk) AS item, name, is_dir, path FROM (SELECT name, true AS is_dir, path, walk FROM t UNION ALL SELECT name, false, path, walk FROM f)""")
def flat_index(spark, sf_dir):
    """D-18: regions, nations and suppliers as a list: files of a directory, then its subdirectories with what they hold."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    dirs = region.select(F.concat(F.lit("R"), "r_regionkey").alias("key"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("o"))
    dirs = dirs.unionByName(nation.select(F.concat(F.lit("N"), "n_nationkey").alias("key"), F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"), (100 - F.col("n_nationkey")).alias("o")))
    files = supplier.select(F.concat(F.lit("N"), "s_nationkey").alias("dir"), "s_name", "s_suppkey")
    return installer.flat_index(dirs, files, "key", "parent", "name", "o", "dir", "s_name", "s_suppkey").select("item", "name", "is_dir", F.translate("path", "\\", "/").alias("path"))


@query("""SELECT c_custkey, 'Service: ' || c_name || chr(10) || 'Segment: ' || c_mktsegment || chr(10) || 'Password: ***' AS report FROM customer""")
def virtual_reports(spark, sf_dir):
    """A text report per item; passwords are masked."""
    lines = F.concat_ws("\n", F.concat(F.lit("Service: "), "c_name"), F.concat(F.lit("Segment: "), "c_mktsegment"), F.lit("Password: ***"))
    return table(spark, sf_dir, "customer").select("c_custkey", lines.alias("report"))


@query("""WITH n AS (SELECT n_regionkey AS c, n_nationkey AS k, n_name AS x, lag(n_nationkey // 7) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS before FROM nation),
heads AS (SELECT r_regionkey AS c, s, -1 AS k, l, CASE l WHEN 0 THEN '' ELSE ['[Available Features]', '[Registry]', '[Shortcuts]', '[Installable Services]', '[Environment]', '[Custom Actions]', '[Properties]'][s + 1] END AS t
          FROM region, (SELECT unnest(generate_series(0, 6)) AS s), (SELECT unnest([0, 1]) AS l)),
rows AS (SELECT c, 0 AS s, k, 0 AS l, CASE WHEN k % 2 = 0 THEN '- ' || x ELSE '- <' || k || '>' END AS t FROM n WHERE k % 3 > 0
UNION ALL SELECT c, 1, k, 0, '[' || CASE WHEN k // 7 = 2 THEN 'HKEY_LOCAL_MACHINE' WHEN k // 7 = 0 THEN 'HKEY_CLASSES_ROOT' WHEN k // 7 = 3 THEN 'HKEY_USERS' ELSE 'HKEY_CURRENT_USER' END || '\\soft]' FROM n WHERE before IS DISTINCT FROM k // 7
UNION ALL SELECT c, 1, k, 1, CASE WHEN k % 2 = 0 THEN '"' || x || '"' ELSE '@' END || ' = "' || k || '"' FROM n
UNION ALL SELECT c, 2, k, 0, '- ' || k || ' (' || x || ')' FROM n UNION ALL SELECT c, 2, k, 1, 'dir -> ' || x || CASE WHEN k % 2 = 0 THEN ' /q' ELSE '' END FROM n
UNION ALL SELECT c, 3, k, 0, CASE WHEN k % 5 = 4 THEN '[Invalid Service Entry]' ELSE x END FROM n
UNION ALL SELECT c, 3, k, l, '    ' || ['Description: ', 'Command: run', 'Arguments: ', 'Service Type: Kernel Driver', 'Start Type: Automatic', 'Account: [LocalSystem]', 'Password: ***'][l] FROM n, (SELECT unnest(generate_series(1, 7)) AS l) WHERE k % 5 < 4
UNION ALL SELECT c, 4, k, 0, x || ' => ' || k FROM n
UNION ALL SELECT c, 5, k, 0, x FROM n UNION ALL SELECT c, 5, k, 1, '    Type: ' || CASE WHEN k % 2 = 0 THEN '65 => DLL file stored in a Binary table stream (Continue Running)' ELSE '3 => -' END FROM n
UNION ALL SELECT c, 5, k, 2, '    Source: s' FROM n UNION ALL SELECT c, 5, k, 3, '    Target: ' FROM n
UNION ALL SELECT c, 6, k, 0, x || ' = ' FROM n)
SELECT c AS container_id, string_agg(t || chr(10), '' ORDER BY s, k, l) AS text FROM (SELECT * FROM heads UNION ALL SELECT * FROM rows) GROUP BY 1""")
def installer_report(spark, sf_dir):
    """The report of each package, of all its tables."""
    n, k, x = table(spark, sf_dir, "nation"), F.col("n_nationkey"), F.col("n_name")

    def rows(**columns):
        return n.select(F.col("n_regionkey").alias("container_id"), k.alias("row"), *(v.alias(c) for c, v in columns.items()))

    none, even = F.lit(None).cast("string"), k % 2 == 0
    tables = {
        "Available Features": rows(key=k, Title=F.when(even, x), Description=none, Level=k % 3, Display=F.lit(1)),
        "Registry": rows(Root=F.floor(k / 7), Key=F.lit("soft"), Name=F.when(even, x), Value=k),
        "Shortcuts": rows(key=k, Directory=F.lit("dir"), Name=F.concat(F.lit("S~1|"), x), Target=x, Arguments=F.when(even, "/q")),
        "Installable Services": rows(Name=x, DisplayName=none, Description=none, command=F.lit("run"), Arguments=none, ServiceType=F.lit(1), StartType=F.lit(2), StartName=none, Password=F.lit("secret"), Component=F.when(k % 5 == 4, "").otherwise("c")),
        "Environment": rows(Name=x, Value=k),
        "Custom Actions": rows(Action=x, Type=F.when(even, 1 + 0x40).otherwise(3), Source=F.lit("s"), Target=none),
        "Properties": rows(Name=x, Value=none),
    }
    containers_ = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("container_id"))
    return reports.report_texts(reports.report_lines(containers_, tables))


_MIXED = "xor(xor(c >> 8, b), xor(c >> 8, b) >> 4)"


@query(f"""SELECT c_custkey, list_reduce(list_prepend(0, list_transform(string_split(c_name, ''), lambda x: ascii(x))), lambda c, b: xor(xor(xor(c << 8, {_MIXED} << 12), {_MIXED} << 5), {_MIXED}) & 65535)::INTEGER AS crc FROM customer""")
def tag_checksums(spark, sf_dir):
    """I16: CRC-16 of short values."""
    return table(spark, sf_dir, "customer").select("c_custkey", fn.crc16(F.encode("c_name", "UTF-8")).alias("crc"))


@query("""SELECT event_id, ts::TIMESTAMP AS at, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN event_type || '/' ELSE event_type || '/' END AS dir, event_type || ' x' AS bare FROM events""")
def panel_fields(spark, sf_dir):
    """H3, H12 and file times: ticks of 100 ns since 1601 as timestamps, folders with one separator at their end, names without blanks around them."""
    e = table(spark, sf_dir, "events")
    ticks = F.unix_micros(F.col("ts").cast("timestamp")) * 10 + 116444736000000000
    path = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.concat("event_type", F.lit("/"))).otherwise(F.col("event_type"))
    return e.select("event_id", fn.file_time(ticks).cast("timestamp_ntz").alias("at"), fn.with_trailing(path, "/").alias("dir"), fn.trimmed(F.concat(F.lit(" \r\n"), "event_type", F.lit(" x\n "))).alias("bare"))


@query(r"""SELECT page_id, regexp_replace(url, '[\\/]?[^\\/]*$', '') || '/out/' || page_id || '.txt' AS target FROM pages""".replace("\\\\", "\\"))
def in_place_targets(spark, sf_dir):
    """Contents go next to their container."""
    pages = table(spark, sf_dir, "pages")
    inner = extract.target_path(F.concat(F.lit("out/"), "page_id", F.lit(".txt")), "", "full", sep="/")
    return pages.select("page_id", F.concat(extract.beside(F.col("url")), inner).alias("target"))


@query("""SELECT doc_id, doc_id % 5 <> 0 AS verified FROM documents""")
def verify_contents(spark, sf_dir):
    """Contents against digests, every fifth of which is wrong."""
    docs = table(spark, sf_dir, "documents").select(F.lit("c").alias("container_id"), F.col("doc_id").alias("item_index"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    want = docs.select("container_id", "item_index", F.when(F.col("item_index") % 5 == 0, "bad").otherwise(F.md5("content")).alias("md5"))
    return containers.verified(docs, want).select(F.col("item_index").alias("doc_id"), "verified")
