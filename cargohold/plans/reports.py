"""Text reports of installer databases (J10), as lines and as whole texts.

A report is a table of lines with an order; only where the text itself is asked
for do a package's lines meet in one row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargohold.functions.text import hive, short_name
from cargohold.operators import installer
from cargohold.operators.ordered import previous

#: Sections of a package's report, in order; what indents a line and ends it.
SECTIONS = ("Available Features", "Registry", "Shortcuts", "Installable Services", "Environment", "Custom Actions", "Properties")
INDENT, END = "    ", "\n"
_LINE = ["container_id", "section", "row", "line", "text"]


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) != ""


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{INDENT}{label}: "), value)


def _lines(rows: DataFrame, section: str, *lines: Column) -> DataFrame:
    """The lines of each row (container_id, row), without nulls."""
    own = F.filter(F.array(*lines), lambda x: x.isNotNull())
    return rows.select("container_id", F.lit(SECTIONS.index(section)).alias("section"), "row", F.posexplode(own).alias("line", "text"))


def features(t: DataFrame) -> DataFrame:
    """key, Title, Description, Level, Display."""
    title = F.concat(F.lit("- "), F.when(_filled("Title"), F.col("Title")).otherwise(F.concat(F.lit("<"), F.col("key"), F.lit(">"))))
    return _lines(installer.visible_features(t), "Available Features", title, F.when(_filled("Description"), F.concat(F.lit(INDENT), "Description")))


def registry(t: DataFrame) -> DataFrame:
    """Root, Key, Name, Value; a key is named where it isn't the one of the row before."""
    marked = previous(t.withColumn("__key", F.concat_ws("\\", hive(F.col("Root")), _text("Key"))).withColumn("__of", F.struct("Root", _text("Key").alias("k"))), ["container_id"], ["row"], "__of", "__before")
    head = F.when(~F.col("__of").eqNullSafe(F.col("__before")), F.concat(F.lit("["), "__key", F.lit("]")))
    name = F.when(_filled("Name"), F.concat(F.lit('"'), F.col("Name"), F.lit('"'))).otherwise("@")
    return _lines(marked, "Registry", head, F.concat(name, F.lit(' = "'), _text("Value"), F.lit('"')))


def shortcuts(t: DataFrame) -> DataFrame:
    """key, Directory, Name, Target, Arguments."""
    target = F.concat(_text("Directory"), F.lit(" -> "), _text("Target"), F.when(_filled("Arguments"), F.concat(F.lit(" "), "Arguments")).otherwise(""))
    return _lines(t, "Shortcuts", F.concat(F.lit("- "), "key", F.lit(" ("), short_name(_text("Name")), F.lit(")")), target)


def services(t: DataFrame) -> DataFrame:
    """Name, DisplayName, Description, command, Arguments, ServiceType, StartType, StartName, Password, Component; command as service_commands finds it. Passwords are masked."""
    valid = _filled("Name") & _filled("Component")

    def only(c: Column) -> Column:
        return F.when(valid, c)

    return _lines(
        t, "Installable Services",
        F.when(valid, F.col("Name")).otherwise("[Invalid Service Entry]"),
        only(F.when(_filled("DisplayName"), _labelled("Display Name", F.col("DisplayName")))),
        only(_labelled("Description", _text("Description"))),
        only(_labelled("Command", _text("command"))),
        only(_labelled("Arguments", _text("Arguments"))),
        only(_labelled("Service Type", installer.named_code(F.col("ServiceType"), installer.SERVICE_TYPES, "Unknown"))),
        only(_labelled("Start Type", installer.named_code(F.col("StartType"), installer.START_TYPES, "Unknown"))),
        only(_labelled("Account", F.when(_filled("StartName"), F.col("StartName")).otherwise("[LocalSystem]"))),
        only(F.when(_filled("Password"), _labelled("Password", F.lit("***")))),
    )


def environment(t: DataFrame) -> DataFrame:
    """Name, Value."""
    return _lines(t, "Environment", F.concat(_text("Name"), F.lit(" => "), _text("Value")))


def actions(t: DataFrame) -> DataFrame:
    """Action, Type, Source, Target; rows without a name drop out. Flags are told where the type is only known without them."""
    kind = F.col("Type")
    known = F.lit(False)
    for k in installer.CUSTOM_ACTIONS:
        known = known | (kind == k)
    flags = F.array_join(F.filter(F.array(*(F.when(kind.bitwiseAND(bit) != 0, name) for bit, name in ((0x40, "Continue Running"), (0x80, "Async")))), lambda x: x.isNotNull()), ", ")
    told = F.when(~known & (flags != ""), F.concat(F.lit(" ("), flags, F.lit(")"))).otherwise("")
    name = installer.named_code(kind, installer.CUSTOM_ACTIONS, "-", installer.ACTION_FLAGS)
    return _lines(t.filter(_filled("Action")), "Custom Actions", F.col("Action"), _labelled("Type", F.concat(kind.cast("string"), F.lit(" => "), name, told)), _labelled("Source", _text("Source")), _labelled("Target", _text("Target")))


def properties(t: DataFrame) -> DataFrame:
    """Name, Value; properties without a name drop out."""
    return _lines(t.filter(_filled("Name")), "Properties", F.concat("Name", F.lit(" = "), _text("Value")))


_SECTIONS = dict(zip(SECTIONS, (features, registry, shortcuts, services, environment, actions, properties), strict=True))


def report_lines(containers: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(container_id, section, row, line, text) of each container's report, to be ordered by the middle three.

    tables: rows of sections by name, each with container_id and row, the place
    in its table. Every section has its heading, also an empty one.
    """
    heads = F.array(*(F.struct(F.lit(k).alias("section"), F.lit(-1).cast("long").alias("row"), F.lit(i).alias("line"), F.lit(t).alias("text")) for k, name in enumerate(SECTIONS) for i, t in enumerate(("", f"[{name}]"))))
    out = containers.select("container_id", F.inline(heads)).select(_LINE)
    for name, table in tables.items():
        out = out.unionByName(_SECTIONS[name](table.withColumn("row", F.col("row").cast("long"))).select(_LINE))
    return out


def report_texts(lines: DataFrame) -> DataFrame:
    """(container_id, text) of whole reports."""
    every = F.array_sort(F.collect_list(F.struct("section", "row", "line", "text")))
    return lines.groupBy("container_id").agg(F.array_join(F.transform(every, lambda x: F.concat(x["text"], F.lit(END))), "").alias("text"))
