"""The queries of the container algebra on the tables of a data directory, each with its SQL for DuckDB.

The tables are seen as containers: documents as archives by source, conversations
as mailboxes, pages as downloads, and the star schema as an installer database.
"""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargohold.functions import codecs
from cargohold.functions import text as fn
from cargohold.operators import installer, ordered, tree
from cargohold.scratch import written
from cargohold.sinks import extract
from cargohold.sources import containers, writers
from cargohold.sources.containers import first_module
from cargohold.streaming import inbox

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL where there is one."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of one archive per source."""
    path = F.expr("concat(lang, '/', n_chars div 1000, '/doc_', n_chars % 50, '.txt')")
    return table(spark, sf_dir, "documents").select(F.col("source").alias("container_id"), F.col("doc_id").alias("item_index"), path.alias("path"), F.col("n_chars").alias("size"), F.expr("n_chars div 2").alias("packed_size"), F.lit(False).alias("is_dir"))


_V1 = """v1 AS (SELECT source AS container_id, doc_id AS item_index, n_chars AS size, n_chars // 2 AS packed_size,
       lang || '/' || (n_chars // 1000) AS parent_path, 'doc_' || (n_chars % 50) || '.txt' AS name FROM documents)"""
_DIRS = f"""WITH {_V1}, dirs AS (SELECT DISTINCT container_id, parent_path AS path FROM v1
       UNION SELECT DISTINCT container_id, split_part(parent_path, '/', 1) FROM v1)"""


@query(f"""{_DIRS} SELECT container_id, n_files, 0::BIGINT AS n_dirs_reported, n_dirs, total_size, total_packed
FROM (SELECT container_id, count(*) AS n_files, sum(size)::BIGINT AS total_size, sum(packed_size)::BIGINT AS total_packed FROM v1 GROUP BY 1)
JOIN (SELECT container_id, count(*) AS n_dirs FROM dirs GROUP BY 1) USING (container_id)""")
def container_totals(spark, sf_dir):
    """F1, D-10: files, directories and bytes of each container."""
    items = archives(spark, sf_dir)
    return tree.totals(items).join(tree.dir_counts(items, "/"), "container_id")


@query(f"{_DIRS} SELECT container_id, path, -1::BIGINT AS item_index FROM dirs")
def synth_dirs(spark, sf_dir):
    """D-2: the directories that no row names."""
    return tree.all_dirs(archives(spark, sf_dir), "/")


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang || '/' || (n_chars // 1000) || '/x' || (n_chars % 50) END AS path,
CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang || '/' || (n_chars // 1000) END AS parent_path, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'x' || (n_chars % 50) END AS name FROM documents""")
def resolve_paths(spark, sf_dir):
    """D-1: dots, parents and doubled separators; too many parents have no path."""
    raw = F.expr(r"concat(lang, '\\.\\', n_chars div 1000, '\\gone\\..\\\\x', n_chars % 50, IF(doc_id % 7 = 0, '\\..\\..\\..\\..\\y', ''))")
    items = table(spark, sf_dir, "documents").select("doc_id", raw.alias("path"))
    found = tree.placed(items)
    return found.select("doc_id", *(F.translate(c, "\\", "/").alias(c) for c in ("path", "parent_path", "name")))


@query(f"""WITH {_V1}, n AS (SELECT *, row_number() OVER (PARTITION BY container_id, parent_path, name ORDER BY item_index) AS k FROM v1)
SELECT container_id, item_index, CASE WHEN k = 1 THEN name ELSE replace(name, '.txt', ',' || k || '.txt') END AS new_name FROM n""")
def dup_names(spark, sf_dir):
    """D-4, G4: names free of collisions."""
    return tree.unique_names(tree.placed(archives(spark, sf_dir), "/")).select("container_id", "item_index", "new_name")


@query(f"""WITH {_V1} SELECT container_id, name, size, item_index FROM v1 WHERE parent_path = 'en/2'""")
def list_dir(spark, sf_dir):
    """D-7: a directory of every container."""
    return tree.listed(tree.placed(archives(spark, sf_dir), "/"), "en/2").select("container_id", "name", "size", "item_index")


@query(f"""WITH {_V1} SELECT container_id, min(item_index) AS item_index, false AS is_dir FROM v1 WHERE parent_path = 'en/2' AND name = 'doc_7.txt' GROUP BY 1""")
def lookup_path(spark, sf_dir):
    """D-5: the node at a path of every container."""
    return tree.found_at(tree.placed(archives(spark, sf_dir), "/"), "en/2/doc_7.txt", "/")


@query(f"""{_DIRS} SELECT container_id, item_index, CASE item_index % 4 WHEN 0 THEN CASE WHEN (container_id, split_part(parent_path, '/', 1) || '/1') IN (SELECT container_id, path FROM dirs) THEN split_part(parent_path, '/', 1) || '/1' END
WHEN 1 THEN CASE WHEN (container_id, 'en/2') IN (SELECT container_id, path FROM dirs) THEN 'en/2' END WHEN 2 THEN parent_path || '/' || name END AS target FROM v1""")
def change_dir(spark, sf_dir):
    """D-6: moves from each item's directory: to one that may be there, absolutely, to a file, and past the root or through what isn't there."""
    items = tree.placed(archives(spark, sf_dir), "/")
    to = F.expr("CASE item_index % 4 WHEN 0 THEN '../1' WHEN 1 THEN '/en/./2/' WHEN 2 THEN name ELSE IF(item_index % 8 = 3, '../../../up', 'gone/..') END")
    nodes = tree.all_dirs(items, "/").select("container_id", "path").unionByName(items.select("container_id", "path"))
    found = tree.entered(items.select("container_id", "item_index", F.col("parent_path").alias("current"), to.alias("to")), nodes, "/")
    return found.select("container_id", "item_index", "target")


@query(f"""WITH {_V1} SELECT container_id, item_index, split_part(parent_path, '/', 2) || '/' || name AS path FROM v1 WHERE starts_with(parent_path, 'de/')""")
def relative_paths(spark, sf_dir):
    """D-8: paths below a directory."""
    found = archives(spark, sf_dir).withColumn("path", tree.relative_path(F.col("path"), F.lit("de"), "/"))
    return found.filter("path IS NOT NULL").select("container_id", "item_index", "path")


@query(f"""WITH {_V1} SELECT container_id, count(*) AS n_files, sum(size)::BIGINT AS total_size FROM v1 WHERE starts_with(parent_path || '/', 'fr/') GROUP BY 1""")
def subtree_totals(spark, sf_dir):
    """D-9, F3: what a selected directory holds."""
    nodes = tree.placed(archives(spark, sf_dir), "/")
    return tree.subtree(nodes, "fr", "/").groupBy("container_id").agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"))


@query(f"""WITH {_V1}, up AS (SELECT container_id, '' AS path, size FROM v1 UNION ALL SELECT container_id, split_part(parent_path, '/', 1), size FROM v1
UNION ALL SELECT container_id, parent_path, size FROM v1) SELECT container_id, path, count(*) AS n_files, sum(size)::BIGINT AS total_size FROM up GROUP BY ALL""")
def subtree_rollup(spark, sf_dir):
    """files and bytes of every directory with all below it."""
    return tree.rollup(archives(spark, sf_dir), "/")


@query(f"""{_DIRS} SELECT container_id, len(string_split(path, '/')) AS depth, count(*) AS n FROM dirs GROUP BY ALL""")
def dir_depth_hist(spark, sf_dir):
    """D-10: directories by depth."""
    return tree.all_dirs(archives(spark, sf_dir), "/").groupBy("container_id", F.size(F.split("path", "/")).cast("long").alias("depth")).agg(F.count("*").alias("n"))


@query("""SELECT 'star' AS container_id, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'star', r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)""")
def empty_dirs(spark, sf_dir):
    """D-22: directories that hold something."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    nations = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("path"), F.col("r_name").alias("parent_path"))
    dirs = nations.select("path", "parent_path").unionByName(region.select(F.col("r_name").alias("path"), F.lit("").alias("parent_path"))).withColumn("container_id", F.lit("star"))
    files = supplier.join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("star").alias("container_id"), F.col("path").alias("parent_path"))
    return tree.without_empty(dirs, files).select("container_id", "path")


@query(f"""WITH {_V1}, bad AS (SELECT DISTINCT container_id FROM v1 WHERE size > 20000) SELECT container_id, count(*) AS n_files FROM v1 WHERE container_id NOT IN (SELECT container_id FROM bad) GROUP BY 1""")
def whole_containers(spark, sf_dir):
    """D-11: a container with a bad item is not listed at all."""
    items = archives(spark, sf_dir).withColumn("bad", F.col("size") > 20000)
    return tree.whole_containers(items).groupBy("container_id").agg(F.count("*").alias("n_files"))


@query("""SELECT page_id, regexp_matches(split_part(split_part(url, '#', 1), '?', 1), '(?i)\\.html?$') AS html, regexp_matches(url, '(?i)/[^/]*[0-9][0-9]$') AS two FROM pages""")
def ext_filter(spark, sf_dir):
    """Wildcards on names."""
    pages = table(spark, sf_dir, "pages")
    bare = F.substring_index(F.substring_index("url", "#", 1), "?", 1)
    return pages.select("page_id", fn.matches_filter(bare, "*.html;*.HTM").alias("html"), F.col("url").rlike("(?i)/[^/]*[0-9][0-9]$").alias("two"))


@query(f"""WITH {_V1} SELECT container_id, count(*) AS n FROM v1 WHERE NOT regexp_matches(name, '(?i)^doc_1.\\.txt$') GROUP BY 1""")
def ignore_filter(spark, sf_dir):
    """C4: names that an ignore list doesn't have."""
    return archives(spark, sf_dir).filter(~fn.matches_filter(F.col("path"), "doc_1?.TXT", empty=False)).groupBy("container_id").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN starts_with(text, 'The ') THEN 'MIME' WHEN starts_with(text, 'From ') THEN 'MBOX' WHEN regexp_matches(left(text, 64), '\\n') THEN 'LINES' END AS module FROM documents""")
def detect_first_match(spark, sf_dir):
    """The first of the ordered signatures that fits."""
    head = F.substring("text", 1, 64)
    return table(spark, sf_dir, "documents").select("doc_id", first_module([("MIME", head.startswith("The ")), ("MBOX", head.startswith("From ")), ("LINES", head.contains("\n"))]).alias("module"))


_SUBJECT = r"substr(regexp_replace(regexp_replace(regexp_replace(s, '^[\r\n\t]+|[\r\n\t]+$', '', 'g'), '[\r\n]', ' ', 'g'), '[:*?""<>|\\/]', '_', 'g'), 1, 240)".replace('""', '"')


@query(f"""SELECT conv_id, turn, CASE WHEN x = '' THEN lpad(turn::VARCHAR, 4, '0') || '.eml' ELSE lpad(turn::VARCHAR, 4, '0') || ' - ' || x || '.eml' END AS name
FROM (SELECT conv_id, turn, {_SUBJECT} AS x FROM (SELECT conv_id, turn, string_split(text, chr(10))[1] AS s FROM conversations))""")
def mail_items(spark, sf_dir):
    """Names of messages."""
    rows = table(spark, sf_dir, "conversations").withColumn("s", F.substring_index("text", "\n", 1))
    return rows.select("conv_id", "turn", fn.mail_name(F.col("turn"), F.col("s")).alias("name"))


@query(r"""SELECT page_id, CASE WHEN length(n) > 1 THEN n END AS name FROM (SELECT page_id, regexp_extract(regexp_extract(url, '^([^?]*)', 1), '([^/\\]*)$', 1) AS n FROM pages)""")
def url_names(spark, sf_dir):
    """Names of downloads."""
    return table(spark, sf_dir, "pages").select("page_id", fn.url_name(F.col("url")).alias("name"))


@query(r"""SELECT page_id, regexp_replace(url, '[:*?"<>|\\/]', '_', 'g') AS safe, translate(html, '<>', '[]') AS brackets FROM pages""")
def sanitize_paths(spark, sf_dir):
    """H10, H11"""
    return table(spark, sf_dir, "pages").select("page_id", fn.safe_name(F.col("url")).alias("safe"), fn.square_brackets(F.col("html")).alias("brackets"))


@query("""SELECT event_id, format('{:,}', event_id * 1000) AS thousands, strftime(ts, '%d.%m.%Y %H:%M:%S') AS time_text, strftime(ts, '%Y-%m-%d') AS date_text,
printf('%02d:%02d:%02d', event_id // 3600, (event_id % 3600) // 60, event_id % 60) AS duration, CASE WHEN event_id >= 1048576 THEN printf('%.2f MB = ', event_id / 1048576.0) || event_id WHEN event_id >= 1024 THEN printf('%.2f KB = ', event_id / 1024.0) || event_id ELSE event_id::VARCHAR END AS size_text FROM events""")
def format_fields(spark, sf_dir):
    """H4 to H8: fields of the info panel."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select("event_id", fn.with_thousands(n * 1000).alias("thousands"), fn.time_text(F.col("ts")).alias("time_text"), fn.date_text(F.col("ts")).alias("date_text"), fn.duration_text(n).alias("duration"), fn.size_text(n).alias("size_text"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'HKEY_CLASSES_ROOT' WHEN 2 THEN 'HKEY_LOCAL_MACHINE' WHEN 3 THEN 'HKEY_USERS' ELSE 'HKEY_CURRENT_USER' END AS hive,
p_name AS bare, CASE WHEN p_size % 2 = 0 THEN 'long name ' || p_size ELSE 'SHORT~' || p_size END AS target, 'C_\\' || p_brand AS drive FROM part""")
def installer_names(spark, sf_dir):
    """Names in installer and image tables."""
    p = table(spark, sf_dir, "part")
    default = F.expr("concat('SHORT~', p_size, IF(p_size % 2 = 0, concat('|long name ', p_size), ''), ':src|source')")
    return p.select("p_partkey", fn.hive(F.col("p_size") % 5).alias("hive"), fn.without_version(F.concat("p_name", F.lit(";1"))).alias("bare"), fn.target_dir(default).alias("target"), fn.drive_path(F.concat(F.lit("c:\\"), "p_brand")).alias("drive"))


@query(f"""WITH {_V1} SELECT container_id, item_index, coalesce(sum(size) OVER (PARTITION BY container_id ORDER BY item_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM v1""")
def running_offsets(spark, sf_dir):
    """G1: sizes to offsets."""
    return ordered.running_sum(archives(spark, sf_dir), ["container_id"], ["item_index"], F.col("size"), "at").select("container_id", "item_index", "at")


@query("""SELECT event_id, user_id, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS new_header FROM events""")
def change_headers(spark, sf_dir):
    """Where a sorted report prints a new header."""
    found = ordered.previous(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", "before")
    return found.select("event_id", "user_id", (~F.col("event_type").eqNullSafe(F.col("before"))).alias("new_header"))


@query("""WITH p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT l_suppkey, l_partkey, (SELECT min(q.l_partkey) FROM p q WHERE q.l_suppkey = p.l_suppkey AND q.l_partkey >= p.l_partkey + 4) - l_partkey - 4 AS gap FROM p""")
def gap_sizes(spark, sf_dir):
    """Sizes estimated from the next position."""
    return ordered.gaps(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), ["l_suppkey"], "l_partkey", 4, "gap")


_KEY6 = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_SEQ = f"SELECT *, row_number() OVER (ORDER BY {', '.join(_KEY6)}) AS seq FROM lineitem"


def _sequenced(spark, sf_dir):
    return ordered.numbered(table(spark, sf_dir, "lineitem").select(_KEY6), [], _KEY6, "seq")


@query(f"""WITH f AS ({_SEQ}) SELECT f.seq, f.l_orderkey, m.s_name AS medium FROM f ASOF LEFT JOIN (SELECT s_name, s_suppkey * 500 AS last FROM supplier) m ON f.seq <= m.last""")
def media_asof(spark, sf_dir):
    """The medium of each file: the smallest last sequence that isn't below the file's."""
    media = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("medium"), (F.col("s_suppkey") * 500).alias("last"))
    return ordered.asof(_sequenced(spark, sf_dir), media, [], "seq", "last", ["medium"], forward=True).select("seq", "l_orderkey", "medium")


@query("""SELECT o_orderkey, min(c_custkey) AS first_group, count(*) AS n_groups FROM orders JOIN customer ON o_orderkey BETWEEN c_custkey * 40 AND c_custkey * 40 + 59 GROUP BY 1""")
def group_range(spark, sf_dir):
    """The groups whose range holds a file; the first counts."""
    groups = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 40).alias("first"), (F.col("c_custkey") * 40 + 59).alias("last"))
    found = ordered.in_ranges(table(spark, sf_dir, "orders").select("o_orderkey"), groups, "o_orderkey", "first", "last", 64)
    return found.groupBy("o_orderkey").agg(F.min("c_custkey").alias("first_group"), F.count("*").alias("n_groups"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""")
def file_component_join(spark, sf_dir):
    """E1"""
    comp = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    files = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return installer.files_with_components(files, comp, "l_orderkey", "o_orderkey").drop("o_orderkey")


@query("""SELECT o_orderkey, coalesce(c_name, o_custkey::VARCHAR) AS c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def component_dir_left(spark, sf_dir):
    """E2"""
    dirs = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name")
    return installer.components_with_dirs(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), dirs, "o_custkey", "c_custkey", "c_name").select("o_orderkey", "c_name")


def directories(spark, sf_dir):
    """Regions, nations and customers as a directory table; customers of one segment name no folder."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    rows = r.select(F.concat(F.lit("R"), "r_regionkey").alias("key"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    rows = rows.unionByName(n.select(F.concat(F.lit("N"), "n_nationkey").alias("key"), F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.col("n_name").alias("name")))
    return rows.unionByName(c.select(F.concat(F.lit("C"), "c_custkey").alias("key"), F.when(F.col("c_custkey") % 9 == 0, "Lost").otherwise(F.concat(F.lit("N"), "c_nationkey")).alias("parent"), F.when(F.col("c_mktsegment") == "BUILDING", ".").otherwise(F.col("c_name")).alias("name")))


_DIRECTORY = """d AS (SELECT 'R' || r_regionkey AS key, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name FROM nation
UNION ALL SELECT 'C' || c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'Lost' ELSE 'N' || c_nationkey END, CASE WHEN c_mktsegment = 'BUILDING' THEN '.' ELSE c_name END FROM customer
UNION ALL SELECT 'Lost', NULL, 'Lost')"""


@query(f"""WITH RECURSIVE {_DIRECTORY}, t AS (SELECT key, name AS path, 0 AS level FROM d WHERE parent IS NULL UNION ALL
SELECT d.key, CASE WHEN d.name = '.' THEN t.path ELSE t.path || '/' || d.name END, t.level + 1 FROM t JOIN d ON d.parent = t.key) SELECT key, path, level FROM t""")
def dir_paths_recursive(spark, sf_dir):
    """E3, D-8, D-12, D-15: a tree with dot folders, and with directories that only a parent key names."""
    return installer.dir_paths(directories(spark, sf_dir), "key", "parent", "name", "/")


@query("""SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders FROM customer""")
def dir_semi(spark, sf_dir):
    """E4"""
    return installer.flagged(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "has_orders")


@query(f"""WITH used AS (SELECT DISTINCT r_name || '/' || n_name AS path, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9000)
SELECT r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name || '/' || n_name IN (SELECT path FROM used) OR n_name = 'NATION_3'
UNION ALL SELECT r_name FROM region WHERE r_name IN (SELECT r_name FROM used) OR r_name IN (SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'NATION_3')""")
def dir_anti(spark, sf_dir):
    """D-14, E5: directories pruned unless they are used or forced."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    nations = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.concat_ws("/", "r_name", "n_name").alias("path"))
    paths = nations.select("path").unionByName(r.select(F.col("r_name").alias("path")))
    used = c.filter("c_acctbal > 9000").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("path").distinct()
    return installer.kept_dirs(paths, used, nations.filter("n_name = 'NATION_3'"), "/")


@query("""WITH d AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'Top' WHEN 1 THEN 'TOP' ELSE 'other' END AS a, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS b FROM customer),
first AS (SELECT lower(a) AS fa, min_by(a, k) AS a, count(*) AS n FROM d GROUP BY 1), second AS (SELECT lower(a) AS fa, lower(b) AS fb, min_by(b, k) AS b, count(*) AS n FROM d GROUP BY 1, 2)
SELECT a AS path, n AS n_merged FROM first UNION ALL SELECT a || '/' || b, s.n FROM second s JOIN first USING (fa)""")
def merge_same_named(spark, sf_dir):
    """D-16: directories of the same name but for case are one, at every level, in the first spelling."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, ("Top", "TOP", "other"))), (F.col("c_custkey") % 3 + 1).cast("int")).alias("a"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("b"))
    dirs = c.select(F.concat(F.lit("A"), "c_custkey").alias("key"), F.lit(None).cast("string").alias("parent"), F.col("a").alias("name"), F.col("c_custkey").alias("o"))
    dirs = dirs.unionByName(c.select(F.concat(F.lit("B"), "c_custkey").alias("key"), F.concat(F.lit("A"), "c_custkey").alias("parent"), F.col("b").alias("name"), F.lit(0).alias("o")))
    return installer.merged_dirs(installer.dir_chains(dirs, "key", "parent", F.col("name"), F.col("o")), "/")


@query("""SELECT l_suppkey, CASE WHEN l_suppkey % 5 = 0 THEN 'none' WHEN l_suppkey % 7 = 0 THEN 'cab' WHEN bool_or(l_discount > 0.09) FILTER (WHERE l_linenumber < 7) AND bool_or(NOT l_discount > 0.09) FILTER (WHERE l_linenumber < 7) THEN 'mixed' ELSE 'cab' END AS compression FROM lineitem GROUP BY 1""")
def compression_class(spark, sf_dir):
    """packages without media, packages that are said to be compressed, and others by their real files."""
    attributes = F.when(F.col("l_discount") > 0.09, installer.COMPRESSED).otherwise(1)
    found = installer.compression_class(attributes, F.col("l_linenumber") >= 7, F.col("l_suppkey") % 5 != 0, F.when(F.col("l_suppkey") % 7 == 0, 6).otherwise(4))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(found.alias("compression"))


@query("""SELECT p_partkey, CASE WHEN b & 1 != 0 THEN 'R' ELSE '' END || CASE WHEN b & 2 != 0 THEN 'H' ELSE '' END || CASE WHEN b & 4 != 0 THEN 'S' ELSE '' END || CASE WHEN b & 16 != 0 THEN 'D' ELSE '' END
|| CASE WHEN b & 1024 != 0 THEN 'L' ELSE '' END || CASE WHEN b & 16384 != 0 THEN 'E' ELSE '' END AS flags, CASE WHEN b & 7 = 0 THEN 128 ELSE b & 7 END::BIGINT AS item_bits FROM (SELECT p_partkey, p_partkey * 37 AS b FROM part)""")
def attr_bits(spark, sf_dir):
    """H20"""
    b = F.col("p_partkey") * 37
    return table(spark, sf_dir, "part").select("p_partkey", fn.attribute_flags(b).alias("flags"), fn.item_attributes(b).alias("item_bits"))


@query("""WITH m AS (SELECT p_partkey, (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = p_size AND (s_suppkey % 3 = 0 OR s_suppkey % 3 = p_partkey % 3) AND (s_suppkey % 2 = 0 OR s_suppkey % 2 = p_partkey % 2)) AS hit FROM part) SELECT p_partkey, s_name FROM m LEFT JOIN supplier ON s_suppkey = hit""")
def theta_first_match(spark, sf_dir):
    """The first record of the same size that agrees in checksum and offset, where zero agrees with all."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size"), (F.col("p_partkey") % 3).alias("crc"), (F.col("p_partkey") % 2).alias("off"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("size"), (F.col("s_suppkey") % 3).alias("crc"), (F.col("s_suppkey") % 2).alias("off"), "s_name")
    return installer.first_match(p, s, ["size"], ["crc", "off"], "p_partkey", "s_suppkey", "s_name")


@query("""SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN ' Boot Start' WHEN 1 THEN ' System Start' WHEN 2 THEN 'Automatic' WHEN 3 THEN ' Manual' WHEN 4 THEN ' Disabled' ELSE 'Unknown' END AS start_type,
CASE p_size % 5 WHEN 1 THEN 'Kernel Driver' WHEN 2 THEN 'File System Driver' ELSE 'Unknown' END AS service_type,
CASE p_size % 4 WHEN 1 THEN 'DLL file stored in a Binary table stream' WHEN 2 THEN 'EXE file stored in a Binary table stream' ELSE '-' END AS action FROM part""")
def service_names(spark, sf_dir):
    """Names of service starts and types, and of custom actions with and without flags."""
    action = F.col("p_size") % 4 + F.when(F.col("p_partkey") % 2 == 0, 0x40).otherwise(0) + F.when(F.col("p_partkey") % 3 == 0, 0x80).otherwise(0)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        installer.named_code(F.col("p_size") % 7, installer.START_TYPES, "Unknown").alias("start_type"),
        installer.named_code(F.col("p_size") % 5, installer.SERVICE_TYPES, "Unknown").alias("service_type"),
        installer.named_code(action, installer.CUSTOM_ACTIONS, "-", installer.ACTION_FLAGS).alias("action"),
    )


@query("""SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS last_text, bool_or(o_orderstatus = 'P') AS has_p, max(o_totalprice) AS most FROM orders GROUP BY 1""")
def last_row_wins(spark, sf_dir):
    """The largest, the last row's text, and whether a row exists."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", "o_orderkey").alias("last_text"), F.bool_or(F.col("o_orderstatus") == "P").alias("has_p"), F.max("o_totalprice").alias("most"))


@query(f"""WITH {_V1} SELECT container_id, item_index, 'out/' || split_part(parent_path, '/', 2) || '/' || name AS target, CASE WHEN container_id < 'src2' THEN 'skip' ELSE 'write' END AS action
FROM (SELECT *, min(item_index) OVER (PARTITION BY container_id, parent_path, name) AS first FROM v1 WHERE starts_with(parent_path, 'en/')) WHERE item_index = first""")
def extract_plan(spark, sf_dir):
    """Where selected items go, and what happens where something is."""
    items = archives(spark, sf_dir).filter(F.col("path").startswith("en/"))
    first = items.groupBy("container_id", "path").agg(F.min("item_index").alias("item_index"))
    there = first.filter("container_id < 'src2'").select("container_id", extract.target_path(F.col("path"), "out", "partial", "en", "/").alias("target"))
    return extract.planned(first, there, "out", "partial", "en", "skip", "/").select("container_id", "item_index", "target", "action")


@query("""SELECT doc_id, md5(text) AS md5, octet_length(encode(text))::BIGINT AS n_bytes FROM documents""")
def content_md5(spark, sf_dir):
    """Digests and measured sizes of contents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("""SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY CUBE (lang, source)""")
def cube_lang_source(spark, sf_dir):
    """An extension of Spark's: not a capability of the reference."""
    return table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5""")
def topk_sizes(spark, sf_dir):
    """An extension of Spark's: the five largest documents of each source, kept as a bounded list per task."""
    docs = table(spark, sf_dir, "documents").select("source", "n_chars", (-F.col("doc_id")).alias("neg"), F.pmod(F.xxhash64("doc_id"), F.lit(256)).alias("salt"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("n_chars", "neg")), asc=False), 1, 5)
    rows = docs.groupBy("source", "salt").agg(best.alias("b")).select("source", F.inline("b")).groupBy("source").agg(best.alias("b")).select("source", F.inline("b"))
    return rows.select("source", (-F.col("neg")).alias("doc_id"), "n_chars")


# Round trips: tables become container bytes, which are listed and extracted again.


def _packed(spark, sf_dir, write, only_full=False):
    """Containers of eight documents each, written by `write` in the tasks; null is the empty text. only_full: for formats that have no empty files."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))).select(F.expr("concat('pack_', doc_id div 8)").alias("container_id"), "doc_id", F.expr("concat(lang, '\\\\doc_', doc_id, '.txt')").alias("path"), F.encode("text", "UTF-8").alias("content"))

    def pack(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["doc_id"])
        found = write([(r["path"], r["content"], 1 + r["doc_id"]) for r in rows])
        return pa.table({"container_id": [rows[0]["container_id"] + suffix for suffix, _ in found], "content": [c for _, c in found]})

    docs = docs.filter("length(content) > 0") if only_full else docs
    # a table, as listing and reading both need it
    return written(docs.groupBy("container_id").applyInArrow(pack, "container_id string, content binary"), "packs")


def _listed_contents(packs, module=None):
    found = containers.detected(packs, module)
    items = containers.items_of(found)
    return items.join(containers.contents_of(items, found).withColumnRenamed("status", "read"), ["container_id", "item_index"])


_PACK = "SELECT 'pack_' || (doc_id // 8){0} AS container_id, replace(lang || '/doc_' || doc_id || '.txt', '/', '\\') AS path, octet_length(encode(coalesce(text, '')))::BIGINT AS size, md5(coalesce(text, '')) AS md5, 'ok' AS read FROM documents"


@query(_PACK.format("").replace(" AS md5,", " AS md5, doc_id + 1 AS mtime,") + " WHERE text <> ''")
def vp_roundtrip(spark, sf_dir):
    """B4, A4, D-20: documents packed into VP files, listed and extracted. In a VP file an entry without bytes is a directory, so it holds no empty documents."""
    found = _listed_contents(_packed(spark, sf_dir, lambda files: [("", writers.vp_bytes(files))], only_full=True))
    return found.select("container_id", "path", "size", F.md5("content").alias("md5"), "mtime", "read")


@query(_PACK.format(""))
def pak_roundtrip(spark, sf_dir):
    """Documents packed into PAK files."""
    found = _listed_contents(_packed(spark, sf_dir, lambda files: [("", writers.pak_bytes(files))]))
    return found.select("container_id", "path", "size", F.md5("content").alias("md5"), "read")


@query("""SELECT 'pack_' || k AS container_id, CASE WHEN k % 5 = 0 THEN 1 ELSE n END AS n_rows, CASE WHEN k % 5 = 0 THEN 0 ELSE n END AS n_items, k % 5 = 0 AS broken, true AS not_vp FROM (SELECT doc_id // 8 AS k, count(*) AS n FROM documents GROUP BY 1)""")
def broken_containers(spark, sf_dir):
    """A cut-off container gives one row with a status and spoils no other; a container that is forced into another format gives the same."""
    packs = _packed(spark, sf_dir, lambda files: [("", writers.pak_bytes(files))])
    cut = packs.withColumn("content", F.when(F.substring_index("container_id", "_", -1).cast("int") % 5 == 0, F.substring("content", 1, 10)).otherwise(F.col("content")))
    failed = F.coalesce(F.col("status").startswith("item_error"), F.lit(False))
    own = containers.items_of(containers.detected(cut)).groupBy("container_id").agg(F.count("*").alias("n_rows"), F.count("item_index").alias("n_items"), F.bool_or(failed).alias("broken"))
    forced = containers.items_of(containers.detected(cut, "vp")).groupBy("container_id").agg(F.bool_and(failed).alias("not_vp"))
    return own.join(forced, "container_id")


@query(_PACK.format(" || '.cat'"))
def xcat_roundtrip(spark, sf_dir):
    """An index beside its data file."""
    packs = _packed(spark, sf_dir, lambda files: list(zip((".cat", ".dat"), writers.xcat_bytes(files, "data.dat"), strict=True)))
    return _listed_contents(packs).select("container_id", "path", "size", F.md5("content").alias("md5"), "read")


_MAIL_TEXT = "concat('From: ', role, '@example.com\nSubject: ', subject, '\nDate: Thu, 01 Jan 1970 00:00:', lpad(turn % 60, 2, '0'), ' +0000\n\n', regexp_replace(text, '(?m)^From ', '>From '), '\n')"


def _mails(spark, sf_dir):
    """Messages of the conversations, a hundred turns a mailbox at most."""
    rows = table(spark, sf_dir, "conversations").withColumn("subject", F.concat(F.lit("turn "), "turn", F.lit(" of "), "conv_id"))
    return rows.withColumn("mail", F.expr(_MAIL_TEXT)).withColumn("container_id", F.expr("concat('box_', conv_id, '_', turn div 100)"))


@query("""SELECT 'box_' || conv_id || '_' || (turn // 100) AS container_id, lpad((row_number() OVER (PARTITION BY conv_id, turn // 100 ORDER BY turn) - 1)::VARCHAR, 4, '0') || ' - turn ' || turn || ' of ' || conv_id || '.eml' AS path,
role || '@example.com' AS owner, turn % 60 AS mtime FROM conversations""")
def mbox_roundtrip(spark, sf_dir):
    """Conversations as mailboxes, built and listed."""
    ordered_mails = F.transform(F.sort_array(F.collect_list(F.struct("turn", "mail"))), lambda m: F.concat(F.lit("From x Thu Jan  1 00:00:00 1970\n"), m["mail"]))
    boxes = _mails(spark, sf_dir).groupBy("container_id").agg(F.encode(F.array_join(ordered_mails, ""), "UTF-8").alias("content"))
    return containers.items_of(containers.detected(boxes)).select("container_id", "path", "owner", "mtime")


@query("""SELECT page_id::VARCHAR AS container_id, '{headers}' AS path, NULL AS md5 FROM pages UNION ALL SELECT page_id::VARCHAR, CASE WHEN page_id % 3 = 0 THEN 'page.html' WHEN page_id % 3 = 1 THEN 'named.htm' ELSE 'place.html' END, md5(html) FROM pages UNION ALL SELECT page_id::VARCHAR, 'message.txt', md5(url) FROM pages""")
def eml_parts(spark, sf_dir):
    """Pages as messages with an attachment and a nameless part."""
    eml = F.expr("""concat('MIME-Version: 1.0\nFrom: a@example.com\nContent-Type: multipart/mixed; boundary="xx"\n\n--xx\nContent-Type: text/html', CASE page_id % 3 WHEN 0 THEN '; name="other.htm"\nContent-Disposition: attachment; filename="http://x.org/a/page.html?q=1"' WHEN 1 THEN '; name="c:\\\\d\\\\named.htm"\nContent-Disposition: attachment; filename="/"' ELSE '\nContent-Location: http://x.org/a/b/place.html' END, '\nContent-Transfer-Encoding: base64\n\n',
        base64(encode(html, 'UTF-8')), '\n--xx\nContent-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: base64\n\n', base64(encode(url, 'UTF-8')), '\n--xx--\n')""")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("container_id"), F.encode(eml, "UTF-8").alias("content"))
    found = _listed_contents(pages)
    return found.select("container_id", "path", F.when(F.col("item_index") > 0, F.md5("content")).alias("md5"))


@query("""SELECT doc_id, md5(text) AS md5, 'ok' AS status FROM documents""")
def codec_roundtrip(spark, sf_dir):
    """Contents compressed or scrambled in one of several ways, and decoded."""

    @F.pandas_udf("binary")
    def encoded(text: pd.Series, codec: pd.Series) -> pd.Series:
        how = {"zlib": zlib.compress, "bzip2": bz2.compress, "lzma": lambda x: lzma.compress(x, lzma.FORMAT_ALONE), "xor33": codecs.CODECS["xor33"], "xor_index": codecs.xor_index}
        return pd.Series([how[c](t.encode()) for t, c in zip(text, codec, strict=True)])

    codec = F.element_at(F.array(*map(F.lit, ("zlib", "bzip2", "lzma", "xor33", "xor_index"))), (F.col("doc_id") % 5 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), codec.alias("codec"))
    out = codecs.decoded(encoded("text", "codec"), F.col("codec"))
    return docs.select("doc_id", out.alias("o")).select("doc_id", F.md5("o.content").alias("md5"), "o.status")


# Streams: extensions of Spark's, the reference has none.


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def events_tumbling(spark, sf_dir):
    """Events a day, as a stream with a watermark."""
    return inbox.drained(inbox.daily_counts(inbox.event_stream(spark, f"{sf_dir}/events.parquet")), "complete")


@query("""WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL '30 minutes', true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS begins, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark, sf_dir):
    """Sessions with gaps of half an hour."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("at", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("begins"), "n")


from cargohold.plans import lookups  # noqa: E402, F401  registers its queries
