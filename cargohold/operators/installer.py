"""What an installer database says about its files: joins, trees and reports over its tables (D-12 to D-16, D-18, E1 to E8, E10, E12 to E15, F4, F6, P2 to P5, P7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargohold.operators.ordered import in_ranges, numbered
from cargohold.scratch import written

#: Keys of special folders and their short names; service types and starts; custom actions and the bits that may be added to their types.
SPECIAL_FOLDERS = {
    "AdminToolsFolder": "AdminT~1", "AppDataFolder": "AppDat~1", "CommonAppDataFolder": "Common~1", "CommonFiles64Folder": "Common~2", "CommonFilesFolder": "Common~3", "DesktopFolder": "Deskto~1",
    "FavoritesFolder": "Favori~1", "FontsFolder": "FontsF~1", "LocalAppDataFolder": "LocalA~1", "MyPicturesFolder": "MyPict~1", "PersonalFolder": "Person~1", "ProgramFiles64Folder": "Progra~1",
    "ProgramFilesFolder": "Progra~2", "ProgramMenuFolder": "Progra~3", "SendToFolder": "SendTo~1", "StartMenuFolder": "StartM~1", "StartupFolder": "Startu~1", "System16Folder": "System~1",
    "System64Folder": "System~2", "SystemFolder": "System~3", "TempFolder": "TempFo~1", "TemplateFolder": "Templa~1", "WindowsFolder": "Window~1", "WindowsVolume": "Window~2",
}
SERVICE_TYPES = {0x10: "SERVICE_WIN32_OWN_PROCESS", 0x20: "SERVICE_WIN32_SHARE_PROCESS", 0x100: "Interactive Process", 0x1: "Kernel Driver", 0x2: "File System Driver"}
START_TYPES = {2: "Automatic", 3: " Manual", 4: " Disabled", 0: " Boot Start", 1: " System Start"}
CUSTOM_ACTIONS = {
    1: "DLL file stored in a Binary table stream", 2: "EXE file stored in a Binary table stream", 5: "JScript file stored in a Binary table stream", 6: "VBScript file stored in a Binary table stream",
    17: "DLL file that is installed with a product", 18: "EXE file that is installed with a product", 19: "Displays a specified error message and returns failure, terminating the installation",
    21: "JScript file that is installed with a product", 22: "VBScript file that is installed with a product", 34: "EXE file having a path referencing a directory", 35: "Directory set with formatted text",
    37: "JScript text stored in this sequence table", 38: "VBScript text stored in this sequence table", 50: "EXE file having a path specified by a property value", 51: "Property set with formatted text",
    53: "JScript text specified by a property value", 54: "VBScript text specified by a property value",
}
ACTION_FLAGS = 0x40 | 0x80
#: Characters that a short name has less than; bits of file rows and of the summary's word count.
SHORT_NAME, COMPRESSED, ALL_COMPRESSED = 14, 0x4000, 2


def files_with_components(files: DataFrame, components: DataFrame, key: str, component_key: str) -> DataFrame:
    """Inner; rows with a blank or unknown component drop out."""
    known = files.filter(F.trim(F.col(key).cast("string")) != "")
    return known.join(components, known[key] == components[component_key])


def components_with_dirs(components: DataFrame, dirs: DataFrame, key: str, dir_key: str, name: str) -> DataFrame:
    """Left; a directory that the table lacks is made from its key."""
    return components.join(dirs, components[key] == dirs[dir_key], "left").withColumn(name, F.coalesce(F.col(name), F.col(key).cast("string")))


def flagged(rows: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """Rows with whether keys has their key."""
    return rows.join(keys.select(F.col(key).alias("__k")).distinct().withColumn("__f", F.lit(True)), F.col(key) == F.col("__k"), "left").withColumn(flag, F.coalesce("__f", F.lit(False))).drop("__k", "__f")


def dir_chains(dirs: DataFrame, key: str, parent: str, name: Column, order: Column) -> DataFrame:
    """E3, D-12: (key, chain) of every directory, also of those that are only named as a parent: its own and all above, from the top, as (order, name).

    A directory that only a parent key names stands at the top, called by its
    key, after the others. Parents that are null or the row itself make a root.
    Chains double in length each round, so there are as many rounds as the
    logarithm of the depth, however deep; rows on or below a cycle, which no
    round ends, have a null chain.
    """
    link = F.array(F.struct(order.cast("long").alias("o"), name.cast("string").alias("n")))
    own = dirs.select(F.col(key).alias("k"), F.when(F.col(parent) != F.col(key), F.col(parent)).alias("up"), link.alias("chain"))
    named = own.select(F.col("up").alias("k")).filter("k IS NOT NULL").distinct()
    lost = named.join(own.select("k"), "k", "left_anti")
    link = F.array(F.struct(F.lit((1 << 63) - 1).alias("o"), F.col("k").cast("string").alias("n")))
    rows = written(own.unionByName(lost.select("k", F.lit(None).cast(own.schema["up"].dataType).alias("up"), link.alias("chain"))), "dir_chains")
    before, left = None, rows.filter("up IS NOT NULL").count()
    while left and left != before:  # each round ends the rows of some depths, unless only cycles are left
        top = rows.select(F.col("k").alias("k2"), F.col("up").alias("up2"), F.col("chain").alias("chain2"))
        joined = rows.join(top, rows["up"] == top["k2"], "left")
        chain = F.when(F.col("k2").isNotNull(), F.concat("chain2", "chain")).otherwise(F.col("chain"))
        rows = written(joined.select("k", F.col("up2").alias("up"), chain.alias("chain")), "dir_chains")
        before, left = left, rows.filter("up IS NOT NULL").count()
    return rows.select(F.col("k").alias(key), F.when(F.col("up").isNull(), F.col("chain")).alias("chain"))


def dir_paths(dirs: DataFrame, key: str, parent: str, name: str, sep: str = "\\") -> DataFrame:
    """E3, D-8, D-12, D-15: (key, path, level) of every directory, as dir_chains finds them.

    A name of `.` adds nothing to the path, so what is below it moves up. Rows on
    a cycle have a null path.
    """
    chains = dir_chains(dirs, key, parent, F.col(name), F.lit(0))
    names = F.filter(F.transform("chain", lambda x: x["n"]), lambda n: (n != ".") & (n != ""))
    return chains.select(key, F.array_join(names, sep).alias("path"), (F.size("chain") - 1).alias("level")).withColumn("level", F.when(F.col("path").isNotNull(), F.col("level")))


def flat_index(dirs: DataFrame, files: DataFrame, key: str, parent: str, name: str, order: str, file_dir: str, file_name: str, file_order: str) -> DataFrame:
    """D-18: (item, key, name, is_dir, path): the tree as a list: of each directory its files, then each subdirectory followed by what it holds.

    order and file_order are the places among siblings. Files of unknown
    directories stand in one that is named by its key. item counts from 1.
    Rows are numbered by a key of the walk, without gathering the tree.
    """
    lost = files.select(F.col(file_dir).alias(key)).filter(F.col(key).isNotNull()).distinct().join(dirs.select(key), key, "left_anti")
    every = dirs.select(key, parent, F.col(name).alias("__name"), F.col(order).cast("long").alias("__order")).unionByName(lost.select(key, F.lit(None).cast(dirs.schema[parent].dataType).alias(parent), F.col(key).cast("string").alias("__name"), F.lit((1 << 63) - 1).alias("__order")))
    chains = written(dir_chains(every, key, parent, F.col("__name"), F.col("__order")).filter("chain IS NOT NULL"), "flat_dirs")
    # a directory's own row comes before its files (0) and its subdirectories (1)
    place = F.transform("chain", lambda x: F.struct(F.lit(1).alias("kind"), x["o"].alias("o"), x["n"].alias("n")))
    path = F.array_join(F.transform("chain", lambda x: x["n"]), "\\")
    nodes = chains.select(F.col(key).cast("string").alias("key"), F.element_at("chain", -1)["n"].alias("name"), F.lit(True).alias("is_dir"), path.alias("path"), place.alias("walk"))
    inside = files.join(chains, files[file_dir] == chains[key], "left")
    end = F.array(F.struct(F.lit(0).alias("kind"), F.col(file_order).cast("long").alias("o"), F.col(file_name).cast("string").alias("n")))
    none = F.array().cast(nodes.schema["walk"].dataType)
    leaves = inside.select(files[file_name].cast("string").alias("key"), files[file_name].cast("string").alias("name"), F.lit(False).alias("is_dir"), F.concat_ws("\\", path, F.col(file_name)).alias("path"), F.concat(F.coalesce(place, none), end).alias("walk"))
    return numbered(nodes.unionByName(leaves), [], ["walk"], "item").select("item", "key", "name", "is_dir", "path")


def _split_name(part: Column) -> tuple[Column, Column]:
    """(short, long) of `short|long`, or of one name that is both; a short name that is too long is none."""
    has, first = F.instr(part, "|") > 0, F.substring_index(part, "|", 1)
    rest = F.when(has, F.substring(part, F.length(first) + 2, F.length(part))).otherwise(part)
    return F.when(F.length(first) < SHORT_NAME, first).otherwise(""), rest


def folder_names(key: Column, default_dir: Column) -> Column:
    """D-13, H18: (name, short_name) of a directory; for special folders `.` gives way to the source's name, or else the key.

    default_dir is `target` or `target:source`, each `short|long` or one name.
    """
    has = F.instr(default_dir, ":") > 0
    target = F.substring_index(default_dir, ":", 1)
    source = F.when(has, F.substring(default_dir, F.length(target) + 2, F.length(default_dir))).otherwise("")
    (short, name), (source_short, source_name) = _split_name(target), _split_name(source)
    known = F.lit(None).cast("string")
    for k, v in SPECIAL_FOLDERS.items():
        known = F.when(key == k, v).otherwise(known)
    dot = known.isNotNull() & (name == ".")

    def usable(s: Column) -> Column:
        return F.when((s != "") & (s != "."), s)

    return F.struct(F.when(dot, F.coalesce(usable(source_name), key)).otherwise(name).alias("name"), F.when(dot, F.coalesce(usable(source_short), known)).otherwise(short).alias("short_name"))


def kept_dirs(paths: DataFrame, used: DataFrame, forced: DataFrame, sep: str = "\\") -> DataFrame:
    """D-14, E5: directories (path) that hold a file somewhere below, are listed in forced, or lie above one of those."""
    seeds = used.select("path").unionByName(forced.select("path")).distinct()
    parts = F.split("path", r"[\\]" if sep == "\\" else f"[{sep}]")
    closure = seeds.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), sep))).alias("path")).distinct()
    return paths.join(closure, "path", "left_semi")


def merged_dirs(chains: DataFrame, sep: str = "\\") -> DataFrame:
    """D-16: (path, n_merged) of chains as dir_chains has them: directories whose names are the same but for case are one, at every level.

    Each keeps its first spelling, in order of the walk.
    """
    rows = chains.filter("chain IS NOT NULL").select(F.transform("chain", lambda x: F.lower(x["n"])).alias("folded"), F.transform("chain", lambda x: x["o"]).alias("walk"), F.element_at("chain", -1)["n"].alias("name"))
    firsts = written(rows.groupBy("folded").agg(F.min_by("name", F.struct("walk", "name")).alias("name"), F.count("*").alias("n_merged")), "merged_dirs")
    above = firsts.select("folded", "n_merged", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("folded")), lambda i: F.slice("folded", 1, i))).alias("at", "up"))
    named = above.join(firsts.select(F.col("folded").alias("up"), "name"), "up")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"])
    return named.groupBy("folded").agg(F.first("n_merged").alias("n_merged"), F.array_join(parts, sep).alias("path")).select("path", "n_merged")


def first_match(left: DataFrame, right: DataFrame, equal: list[str], maybe: list[str], key: str, order: str, take: str) -> DataFrame:
    """left's key with `take` of the first right row (by order) that has the same `equal` columns and in each of `maybe` the same value or zero.

    For each choice of `maybe` columns that are zero, right's first rows are
    found once per value, and left asks by an equi-join; so no left row ever
    meets all rows of a hot value.
    """
    found = left.select(key, *equal, *maybe)
    best = []
    for zeros in range(1 << len(maybe)):
        asked = [c for i, c in enumerate(maybe) if not zeros >> i & 1]
        fits = right
        for c in set(maybe) - set(asked):
            fits = fits.filter(F.col(c) == 0)
        first = fits.groupBy(*equal, *asked).agg(F.min(F.struct(order, take)).alias(f"__b{zeros}"))
        found = found.join(first, [*equal, *asked], "left")
        best.append(F.col(f"__b{zeros}"))
    return found.select(key, (F.least(*best) if len(best) > 1 else best[0])[take].alias(take))


def named_code(code: Column, names: dict[int, str], default: str, flags: int = 0) -> Column:
    """The name of a code; if unknown, of the code without flag bits; else default."""

    def look(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, v in names.items():
            out = F.when(c == k, v).otherwise(out)
        return out

    return F.coalesce(look(code), look(code.bitwiseAND(~flags)) if flags else F.lit(None).cast("string"), F.lit(default))


def compression_class(attributes: Column, fake: Column, has_media: Column, word_count: Column) -> Column:
    """an aggregate over a package's files: none without media; cab if the summary's word count says so; mixed if some real files are compressed and some not; else cab."""
    compressed = F.when(~fake, attributes.bitwiseAND(COMPRESSED) != 0)
    mixed = F.coalesce(F.bool_or(compressed) & F.bool_or(~compressed), F.lit(False))
    return F.when(~F.bool_or(has_media), "none").when(F.max(word_count).bitwiseAND(ALL_COMPRESSED) != 0, "cab").when(mixed, "mixed").otherwise("cab")


def service_commands(services: DataFrame, files: DataFrame, component: str, path: str, item: str) -> DataFrame:
    """Services with `command`: the path of the first file (by item, the place in the flat index) of their component, else the component's key."""
    first = files.groupBy(F.col(component).alias("__c")).agg(F.min_by(path, item).alias("__path"))
    return services.join(first, F.col(component) == F.col("__c"), "left").withColumn("command", F.coalesce("__path", F.col(component).cast("string"))).drop("__c", "__path")


def cab_entries(files: DataFrame, entries: DataFrame, key: str, name: str) -> DataFrame:
    """Files with the entries whose name is their key, case aside."""
    return files.join(entries, F.lower(F.col(key)) == F.lower(F.col(name)))


def named_entries(entries: DataFrame, names: DataFrame, name_hash: str, name: str) -> DataFrame:
    """Entries with the name whose MD5 is their hash, from lists that may repeat names; null where none has it."""
    listed = names.select(F.col(name), F.md5(name).alias("__h")).groupBy("__h").agg(F.min(name).alias(name))
    return entries.join(listed, F.col(name_hash) == F.col("__h"), "left").drop("__h")


def linked_items(refs: DataFrame, block: str, name: str) -> DataFrame:
    """D-23: names that share a file entry (block): each with its item, the first name of the entry, and the number of links."""
    items = refs.groupBy(block).agg(F.min(name).alias("item"), F.count("*").alias("links"))
    return refs.join(items, block)


def referenced(roots: DataFrame, refs: DataFrame, most_levels: int, most_refs: int = 1 << 28) -> tuple[DataFrame, bool]:
    """D-21, D-23: (child, parent, depth, hidden) of every reference from the roots (child) on, and whether all of them were followed.

    refs: parent, child, hidden. References are followed for most_levels levels,
    or until there are more than most_refs, which ends those of a cycle.
    """
    level = written(roots.select("child", F.lit(None).cast(refs.schema["parent"].dataType).alias("parent"), F.lit(0).alias("depth"), F.lit(False).alias("hidden")), "refs")
    every, total = level, level.count()
    for depth in range(1, most_levels):
        at = level.select(F.col("child").alias("__at"))
        level = written(refs.join(at, refs["parent"] == F.col("__at")).select("child", "parent", F.lit(depth).alias("depth"), "hidden"), "refs")
        found = level.count()
        if not found:
            return every, True
        total += found
        if total > most_refs:
            return every, False
        every = every.unionByName(level)
    more = refs.join(level.select(F.col("child").alias("__at")), refs["parent"] == F.col("__at"), "left_semi").limit(1).count()
    return every, not more


def volume_sets(files: DataFrame, path: str, marks: list[str], first: int) -> DataFrame:
    """Files with volume_set and volume, of those whose marks (signature, version) are those of the set's first volume.

    The set is the path up to the digits before its last dot, the volume those
    digits.
    """
    own = files.withColumn("volume_set", F.regexp_replace(path, r"[0-9]*\.[^.]*$", "")).withColumn("volume", F.regexp_extract(path, r"([0-9]*)\.[^.]*$", 1).cast("int"))
    heads = own.filter(F.col("volume") == first).groupBy("volume_set").agg(*(F.min(m).alias(m) for m in marks))
    return own.join(heads, ["volume_set", *marks], "left_semi")


def spanned_volumes(files: DataFrame, volumes: DataFrame, index: str) -> DataFrame:
    """(index, volumes): of each file the volumes (volume, first, last) that hold a part, in order, up to the first in which it ends.

    A file can be in several volumes only as the last of all but the one it ends
    in, so those are found by two equi-joins and one range.
    """
    v = volumes.filter("first <= last")
    ends = in_ranges(files, v.withColumn("__last", F.col("last") - 1).filter("first <= __last"), index, "first", "__last", 64).groupBy(index).agg(F.min("volume").alias("end"))
    at_last = files.join(v.select(F.col("last").alias("__last"), "volume"), F.col(index) == F.col("__last")).select(index, "volume")
    every = at_last.unionByName(ends.select(index, F.col("end").alias("volume"))).join(ends, index, "left")
    return every.filter("end IS NULL OR volume <= end").groupBy(index).agg(F.array_sort(F.collect_set("volume")).alias("volumes"))


def file_groups(groups: DataFrame) -> DataFrame:
    """groups (first, last, packed, unpacked, first_volume, last_volume) with n_files."""
    return groups.withColumn("n_files", F.col("last") - F.col("first") + 1)


def valid_files(files: DataFrame) -> DataFrame:
    """Without file rows that are marked invalid (bit 8 of status) or have no data (offset zero)."""
    return files.filter((F.col("status").bitwiseAND(8) == 0) & (F.col("offset") != 0))


def source_modules(modules: DataFrame, name: str) -> DataFrame:
    """Without modules that the linker made or that stand for imports."""
    return modules.filter(~(F.contains(F.col(name), F.lit("* Linker *")) | F.contains(F.col(name), F.lit("Import:"))))


def real_dirs(dirs: DataFrame, name: str) -> DataFrame:
    """Without the entries for the directory itself and the one above, and without names that are empty or begin with a zero."""
    return dirs.filter(~F.col(name).isin(".", "..") & (F.length(name) > 0) & ~F.col(name).startswith("\0"))


def healthy_volumes(volumes: DataFrame) -> DataFrame:
    """Volumes (index, status) with their labels; only healthy ones are searched."""
    return volumes.filter("status = 'Healthy'").withColumn("label", F.concat(F.lit("Volume_#"), F.col("index").cast("string")))


def visible_features(features: DataFrame) -> DataFrame:
    """P5"""
    return features.filter((F.col("Level") > 0) & (F.col("Display") > 0))
