"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Only DataFrame functions run here. The units of a file are its runs of one to
LINES consecutive lines, as notices are wrapped, and of licence files the whole
text. Units are bags of words weighted by tf * idf with document frequencies over
all files. A cosine of c needs words that carry c * c of the template's squared
length, so of each template the rarest words are taken until the others carry
less; a unit without any of them can't match. Files, units and pairs of unit and
template that share none go before any product, and nothing that could match is
lost. Templates are a table of any size.

A file without a licence of its own takes that of a licence file in the nearest
directory above it. Directories are resolved once each, however many files they
have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargohold.llm.common import written
from cargohold.llm.license_texts import TEMPLATES

THRESHOLD = 0.8
#: Consecutive lines of a unit, at most: notices are wrapped.
LINES = 4
#: Rows of templates' words, or words that are needed, that are sent to all tasks; more are joined by a shuffle.
SENT_WORDS = 50_000
#: Tasks that a directory's files are dealt over.
SALTS = 32
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice)\b[^/]*$"


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _idf(n_files: int, df: Column) -> Column:
    """ln((1 + files) / (1 + files with the word)) + 1: never below 1."""
    return F.log(F.lit(1.0 + n_files) / (1.0 + F.coalesce(df, F.lit(0)))) + 1


def template_table(spark, templates=TEMPLATES) -> DataFrame:
    """(template, license, text)."""
    rows = F.array(*(F.struct(F.lit(k).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text")) for k, (name, text) in enumerate(templates)))
    return spark.range(1).select(F.inline(rows))


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT_WORDS else df


def template_words(templates: DataFrame, counted: DataFrame, n_files: int, threshold: float) -> DataFrame:
    """(template, license, w, y, needed): the words of each template with their share y of its unit vector.

    Every text whose cosine to a template reaches the threshold has one of its
    needed words.
    """
    asked = templates.select("template", "license", F.explode(words_of(F.col("text"))).alias("w")).groupBy("template", "license", "w").agg(F.count("*").alias("tf"))
    weighed = asked.join(counted, "w", "left").withColumn("idf", _idf(n_files, F.col("df"))).withColumn("y", F.col("tf") * F.col("idf"))
    # a template's words are a group of its own size
    own, rarest = Window.partitionBy("template"), Window.partitionBy("template").orderBy(F.desc("idf"), "w").rowsBetween(Window.unboundedPreceding, -1)
    whole, before = F.sum(F.col("y") * F.col("y")).over(own), F.coalesce(F.sum(F.col("y") * F.col("y")).over(rarest), F.lit(0.0))
    found = weighed.withColumn("whole", whole).withColumn("left", F.col("whole") - before)
    return found.select("template", "license", "w", (F.col("y") / F.sqrt("whole")).alias("y"), (F.col("left") >= (threshold * threshold - 1e-9) * F.col("whole")).alias("needed"))


def _candidates(files: DataFrame, needed: DataFrame, n_needed: int) -> tuple[DataFrame, Column | None]:
    """Files with a needed word, and the needed words as an array if they are few."""
    if n_needed <= SENT_WORDS:
        asked = F.array(*(F.lit(r.w) for r in needed.collect()))
        return files.filter(F.arrays_overlap(words_of(F.col("text")), asked)), asked
    has = files.select("file_id", F.explode(F.array_distinct(words_of(F.col("text")))).alias("w")).join(needed, "w").select(F.col("file_id").alias("of")).distinct()
    return files.join(has, files["file_id"].eqNullSafe(has["of"]), "left_semi"), None


def _units(files: DataFrame, asked: Column | None) -> DataFrame:
    """(file_id, unit, w): the words of runs of lines that have one of the words asked for (all runs if None), and of licence files as wholes (run -1).

    unit is a hash of the file's row and the run, so rows that share an id don't mix.
    """
    lines = F.transform(F.split("text", "\n"), words_of)
    listed = files.select("file_id", F.xxhash64("file_id", "text").alias("row"), "is_license", lines.alias("lines"))
    hits = F.transform("lines", lambda x: F.arrays_overlap(x, asked) if asked is not None else F.size(x) > 0)
    # runs that begin with words, and have one of those asked for
    run = F.transform(F.sequence(F.lit(0), F.size("lines") * LINES - 1), lambda u: F.struct(u.alias("run"), (F.floor(u / LINES) + 1).cast("int").alias("from"), (u % LINES + 1).cast("int").alias("n")))
    fits = F.filter(run, lambda r: (r["from"] + r["n"] - 1 <= F.size("lines")) & F.exists(F.slice("hits", r["from"], r["n"]), lambda h: h))
    runs = listed.withColumn("hits", hits).select("file_id", "row", F.explode(fits).alias("r"), "lines")
    parts = runs.select("file_id", F.xxhash64("row", "r.run").alias("unit"), F.flatten(F.slice("lines", F.col("r.from"), F.col("r.n"))).alias("w"))
    return parts.unionByName(listed.filter("is_license").select("file_id", F.xxhash64("row", F.lit(-1)).alias("unit"), F.flatten("lines").alias("w")))


def own_licenses(files: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(file_id, license, score) of the files (file_id, text, is_license) that match a template: the best, ties by name."""
    n_files = files.count()
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    counted = files.select(F.explode(F.array_distinct(words_of(F.col("text")))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    counted = written(counted, "word_files")
    vectors = written(template_words(templates, counted, n_files, threshold), "template_words")
    needed = vectors.filter("needed").select("w").distinct()
    n_words, n_needed = vectors.count(), needed.count()
    some, asked = _candidates(files, needed, n_needed)
    terms = _units(some, asked).select("file_id", "unit", F.explode("w").alias("w")).groupBy("file_id", "unit", "w").agg(F.count("*").alias("tf"))
    terms = terms.join(counted, "w").select(F.struct("file_id", "unit").alias("key"), "w", (F.col("tf") * _idf(n_files, F.col("df"))).alias("x"))
    terms = written(terms, "license_terms")
    sizes = terms.groupBy("key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    # pairs of unit and template that share a needed word; only for those is a product made
    pairs = terms.join(_sent(vectors.filter("needed").select("w", "template"), n_words), "w").select("key", "template").distinct()
    products = terms.join(pairs, "key").join(_sent(vectors.drop("needed"), n_words), ["template", "w"])
    dots = products.groupBy("key", "template", "license").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    found = dots.join(sizes, "key").withColumn("score", F.round(F.col("dot") / F.col("size"), 6)).filter(F.col("score") >= threshold)
    best = found.groupBy("key.file_id", "license").agg(F.max("score").alias("score"))
    return best.groupBy("file_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select("file_id", "b.license", (-F.col("b.s")).alias("score"))


def license_scan(files: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD, id_col: str = "file_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row per row of files: file_id, path, license, score, origin, from_dir.

    A file's own licence is the template with the largest cosine, `threshold` or
    more, to one of its runs of up to LINES consecutive lines; for licence files
    (by name) also to its whole text. origin: "own"; "inherited" from the best licence file of the nearest
    directory at or above the file's, which from_dir names; or "none".

    Directories are separated by "/"; the root is the empty path. Nulls: a null
    text has no lines, a file with a null path is in no directory and inherits
    nothing, null ids are one file of several rows. Rows that repeat an id share
    the best licence of any of them. Very long texts and lines are read whole. Empty
    tables give an empty result, and without templates no file has a licence.
    Other columns are not read.
    """
    spark = files.sparkSession
    name = F.coalesce(F.regexp_extract(F.col(path_col), "([^/]*)$", 1), F.lit(""))
    base = files.select(F.col(id_col).alias("file_id"), F.col(path_col).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), name.rlike(LICENSE_FILE).alias("is_license"))
    own = written(own_licenses(base, template_table(spark) if templates is None else templates, threshold), "own_licenses")
    places = base.select("file_id", "path", "is_license", F.regexp_replace(F.regexp_extract("path", "^(.*)/[^/]*$", 1), "/+$", "").alias("dir"))
    named = places.join(own.withColumnRenamed("file_id", "of"), places["file_id"].eqNullSafe(F.col("of")), "left").drop("of")
    named = written(named, "licensed_files")
    licensed = named.filter("is_license AND license IS NOT NULL AND path IS NOT NULL").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", "path")).alias("b"))
    licensed = licensed.select(F.col("dir").alias("ancestor"), F.col("b.license").alias("dir_license"), (-F.col("b.s")).alias("dir_score"))
    parts = F.split("dir", "/")
    steps = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("ancestor")))
    above = named.filter("path IS NOT NULL").select("dir").distinct().select("dir", F.inline(steps))
    nearest = above.join(licensed, "ancestor").groupBy("dir").agg(F.max_by(F.struct("ancestor", "dir_license", "dir_score"), "depth").alias("near"))
    # only files that need it are joined; a directory's files are dealt over several tasks, its one row goes to each
    heirs = F.col("license").isNull() & F.col("path").isNotNull()
    salted = named.filter(heirs).withColumn("salt", F.pmod(F.xxhash64("file_id", "path"), F.lit(SALTS)).cast("int"))
    spread = nearest.select(F.col("dir").alias("near_dir"), "near", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("near_salt"))
    joined = salted.join(spread, (F.col("dir") == F.col("near_dir")) & (F.col("salt") == F.col("near_salt")), "left").unionByName(named.filter(~heirs), allowMissingColumns=True)
    has = F.col("license").isNotNull()
    return joined.select(
        "file_id", "path",
        F.coalesce("license", "near.dir_license").alias("license"),
        F.coalesce("score", "near.dir_score").alias("score"),
        F.when(has, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has, F.col("near.ancestor")).alias("from_dir"),
    )
