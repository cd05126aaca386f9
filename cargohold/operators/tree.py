"""The container algebra: item rows with paths become a tree, in DataFrame expressions.

items have container_id, item_index, path, is_dir, size and packed_size; other
columns pass through. Paths are separated by `sep`.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargohold.operators.ordered import numbered

SEP = "\\"


def _parts(path: Column, sep: str) -> Column:
    return F.split(path, r"[\\]" if sep == SEP else f"[{sep}]")


def resolved(path: Column, sep: str = SEP) -> Column:
    """D-1: the path with `.` and `..` applied and runs of separators collapsed after the first component; null where `..` leaves the root.

    A leading separator makes a first component with an empty name.
    """
    parts = _parts(path, sep)
    bad = F.array(F.lit(None).cast("string"))

    def step(stack: Column, part: Column) -> Column:
        up = F.when(F.size(stack) > 0, F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(bad)
        down = F.when((part == "") & (F.size(stack) > 0), stack).otherwise(F.concat(stack, F.array(part)))
        # once past the root the stack stays bad
        return F.when(F.exists(stack, lambda x: x.isNull()), stack).when(part == ".", stack).when(part == "..", up).otherwise(down)

    stack = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(~F.exists(stack, lambda x: x.isNull()), F.array_join(stack, sep))


def name_of(path: Column, sep: str = SEP) -> Column:
    """H1: what follows the last separator."""
    return F.substring_index(path, sep, -1)


def parent_of(path: Column, sep: str = SEP) -> Column:
    """H2: what precedes the last separator; empty at the root."""
    return F.when(F.instr(path, sep) > 0, F.substring(path, 1, F.length(path) - F.length(name_of(path, sep)) - len(sep))).when(path.isNotNull(), "")


def ancestors(path: Column, sep: str = SEP) -> Column:
    """Paths of the directories above, from the top; without the root."""
    parts = _parts(path, sep)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), sep))).otherwise(F.array().cast("array<string>"))


def placed(items: DataFrame, sep: str = SEP) -> DataFrame:
    """items with resolved path, parent_path, name and depth; bad where the path can't be resolved."""
    out = items.withColumn("path", resolved(F.col("path"), sep))
    return out.select("*", parent_of(F.col("path"), sep).alias("parent_path"), name_of(F.col("path"), sep).alias("name"), F.size(_parts(F.col("path"), sep)).alias("depth"), F.col("path").isNull().alias("bad"))


def whole_containers(items: DataFrame) -> DataFrame:
    """D-11: without containers that have a bad item."""
    return items.join(items.filter("bad").select("container_id").distinct(), "container_id", "left_anti")


def all_dirs(items: DataFrame, sep: str = SEP) -> DataFrame:
    """D-2, D-3: each directory once: (container_id, path, item_index); -1 where no row names it, else the first row that does."""
    named = items.filter("is_dir").select("container_id", "path", "item_index")
    # parents first: as many rows as directories, not items
    parents = items.select("container_id", F.explode(F.array(parent_of(F.col("path"), sep), F.when(F.col("is_dir"), F.col("path")))).alias("d")).filter("d IS NOT NULL AND d <> ''").distinct()
    above = parents.select("container_id", F.explode(F.concat(ancestors(F.col("d"), sep), F.array("d"))).alias("path")).distinct()
    return above.join(named.groupBy("container_id", "path").agg(F.min("item_index").alias("item_index")), ["container_id", "path"], "left").withColumn("item_index", F.coalesce("item_index", F.lit(-1)))


def unique_names(files: DataFrame) -> DataFrame:
    """D-4: files (container_id, parent_path, name, item_index) with new_name, free of collisions.

    In order of item_index, a taken name becomes `base,N.ext`, or `base,N` without
    an extension, with the first free N from 2. Case counts. Where no name in a
    family looks like a renamed one, N is the number of the occurrence, which
    splits hot names over tasks. Other families have names that differ in such
    endings only; of those, names that no renamed one can meet are numbered like
    the rest, and the others are gone through in order.
    """
    base = F.when(F.instr("name", ".") > 0, F.expr("substring(name, 1, length(name) - length(substring_index(name, '.', -1)) - 1)")).otherwise(F.col("name"))
    ext = F.substring(F.col("name"), F.length(base) + 1, F.length("name"))
    rows = files.withColumn("__base", base).withColumn("__ext", ext).withColumn("__family", F.concat(F.regexp_replace(F.col("__base"), r"(,\d+)+$", ""), F.lit("\0"), F.col("__ext")))
    keys = ["container_id", "parent_path", "__family"]
    odd = rows.filter(F.col("__base").rlike(r",\d+$")).select(*keys).distinct().withColumn("__odd", F.lit(True))
    numbers = numbered(rows.join(odd, keys, "left"), ["container_id", "parent_path", "name"], ["item_index"], "__n")
    plain = numbers.filter("__odd IS NULL").withColumn("new_name", F.when(F.col("__n") == 1, F.col("name")).otherwise(F.concat("__base", F.lit(","), F.col("__n").cast("string"), "__ext")))
    columns = [*files.columns, "new_name"]

    def fold(t: pa.Table) -> pa.Table:
        taken: set[str] = set()
        free: dict[str, int] = {}  # the least number of each name that may be free
        new = []
        t = t.sort_by("item_index")
        for name, b, e in zip(*(t[c].to_pylist() for c in ("name", "__base", "__ext")), strict=True):
            use = name
            if use in taken:
                n = free.get(name, 2)
                while (use := f"{b},{n}{e}") in taken:
                    n += 1
                free[name] = n + 1
            taken.add(use)
            new.append(use)
        return t.append_column("new_name", pa.array(new, pa.string())).select(columns)

    folded = numbers.filter("__odd").groupBy(*keys).applyInArrow(fold, plain.select(*columns).schema)
    return plain.select(*columns).unionByName(folded)


def found_at(nodes: DataFrame, path: str, sep: str = SEP) -> DataFrame:
    """D-5: the node of each container at an exact path; directories before files.

    The empty path and one separator are the container itself, with index -1. A
    path that begins with a separator or has two in a row is nothing; one that
    ends with a separator is a directory.
    """
    bare = path[: -len(sep)] if path.endswith(sep) else path
    if path in ("", sep):
        return nodes.select("container_id").distinct().select("container_id", F.lit(-1).cast("long").alias("item_index"), F.lit(True).alias("is_dir"))
    known = nodes.filter(F.lit(not path.startswith(sep) and sep * 2 not in bare) & (F.col("path") == bare) & (F.col("is_dir") | F.lit(bare == path)))
    best = F.min_by(F.struct("item_index", "is_dir"), F.struct(~F.col("is_dir"), F.col("item_index"))).alias("b")
    return known.groupBy("container_id").agg(best).select("container_id", "b.item_index", "b.is_dir")


def changed_dir(current: Column, to: Column, sep: str = SEP) -> Column:
    """D-6: the path after moving from current: absolute if it begins with a separator; `/` is a separator too. Null past the root and for an empty move."""
    target = F.translate(to, "/", sep) if sep != "/" else to
    full = F.when(target.startswith(sep), F.regexp_replace(target, "^[\\\\/]+", "")).otherwise(F.concat_ws(sep, F.when(current != "", current), target))
    return F.when(to != "", F.regexp_replace(resolved(full, sep), "[\\\\/]+$", ""))


def entered(moves: DataFrame, nodes: DataFrame, sep: str = SEP) -> DataFrame:
    """D-6: moves (container_id, current, to) with `target`, null where a step of the way isn't there.

    nodes (container_id, path): all directories and files; a move may pass and end
    at a file. Each step of a distinct move is looked up once.
    """
    to = F.translate("to", "/", sep) if sep != "/" else F.col("to")
    # where each step of the move leads, from the start on
    parts = F.filter(_parts(to, sep), lambda x: x != "")
    lead = F.when(to.startswith(sep), F.lit("")).otherwise(F.col("current"))
    prefixes = F.transform(F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>")), lambda i: F.concat_ws(sep, F.when(lead != "", lead), F.array_join(F.slice(parts, 1, i), sep)))
    steps = moves.select("container_id", "current", "to").distinct().withColumn("step", F.explode(prefixes)).withColumn("path", resolved(F.col("step"), sep)).filter("path <> ''")
    lost = steps.join(nodes.select("container_id", "path").distinct(), ["container_id", "path"], "left_anti").select("container_id", "current", "to").distinct().withColumn("__lost", F.lit(True))
    found = moves.join(lost, ["container_id", "current", "to"], "left")
    return found.withColumn("target", F.when(F.col("__lost").isNull(), changed_dir(F.col("current"), F.col("to"), sep))).drop("__lost")


def listed(nodes: DataFrame, parent: str) -> DataFrame:
    """D-7, G7: the children of a directory: directories, then files, each by name."""
    return nodes.filter(F.col("parent_path") == parent).orderBy("container_id", F.desc("is_dir"), "name")


def relative_path(path: Column, root: Column, sep: str = SEP) -> Column:
    """D-8: the path below root; null outside; components with empty names vanish."""
    clean = F.array_join(F.filter(_parts(path, sep), lambda x: x != ""), sep)
    return F.when(root == "", clean).when(clean.startswith(F.concat(root, F.lit(sep))), F.substring(clean, F.length(root) + 2, F.length(clean)))


def subtree(nodes: DataFrame, prefix: str, sep: str = SEP) -> DataFrame:
    """D-9: the files below a directory, and the directories there that have nothing below them."""
    inside = nodes.filter(F.col("path").startswith(prefix + sep))
    full = inside.select("container_id", F.col("parent_path").alias("path")).distinct().withColumn("__has", F.lit(True))
    return inside.join(full, ["container_id", "path"], "left").filter(~F.col("is_dir") | F.col("__has").isNull()).drop("__has")


def rollup(files: DataFrame, sep: str = SEP) -> DataFrame:
    """(container_id, path, n_files, total_size) of every directory with all below it; the root is the empty path.

    Files are added up per directory before directories are spread over those above.
    """
    own = files.groupBy("container_id", parent_of(F.col("path"), sep).alias("dir")).agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    up = F.concat(F.array(F.lit("")), F.when(F.col("dir") != "", F.concat(ancestors(F.col("dir"), sep), F.array("dir"))).otherwise(F.array().cast("array<string>")))
    return own.select("container_id", F.explode(up).alias("path"), "n", "s").groupBy("container_id", "path").agg(F.sum("n").alias("n_files"), F.sum("s").alias("total_size"))


def totals(items: DataFrame) -> DataFrame:
    """(container_id, n_files, n_dirs_reported, total_size, total_packed); directories have no size."""
    return items.groupBy("container_id").agg(
        F.count_if(~F.col("is_dir")).alias("n_files"), F.count_if(F.col("is_dir")).alias("n_dirs_reported"),
        F.sum(F.when(~F.col("is_dir"), F.col("size")).otherwise(0)).alias("total_size"), F.sum(F.when(~F.col("is_dir"), F.col("packed_size")).otherwise(0)).alias("total_packed"),
    )


def dir_counts(items: DataFrame, sep: str = SEP) -> DataFrame:
    """D-10: (container_id, n_dirs): the directories that the container reports, or if it reports none those that its paths need."""
    reported = items.groupBy("container_id").agg(F.count_if("is_dir").alias("__r"))
    counted = all_dirs(items, sep).groupBy("container_id").agg(F.count("*").alias("__n"))
    return reported.join(counted, "container_id", "left").select("container_id", F.when(F.col("__r") > 0, F.col("__r")).otherwise(F.coalesce("__n", F.lit(0))).alias("n_dirs"))


def without_empty(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """D-22: directories that have a file or a directory directly inside; not transitive."""
    held = files.select("container_id", F.col("parent_path").alias("path")).unionByName(dirs.select("container_id", F.col("parent_path").alias("path"))).distinct()
    return dirs.join(held, ["container_id", "path"], "left_semi")
