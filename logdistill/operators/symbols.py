"""Symbol maps of source files: classes, functions, methods and their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import bind, head, positions, spans
from ..functions.steps import with_once
from ..functions.text import split_lines
from ..shared import file_names

# --- fixed values -----------------------------------------------------------
CLASS_LINE = r"(?U)^class[\s\x1c-\x1f]+([\p{L}\p{N}_]+)"
DEF_LINE = r"(?U)^([\s\x1c-\x1f]*)def[\s\x1c-\x1f]+([\p{L}\p{N}_]+)"
FILE_ROW = "# %s  (%d lines)"
SYMBOL_ROW = "%-10s %-38s [%d–%d]"
METHOD_ROW = "  %-8s %-36s [%d–%d]"
# ----------------------------------------------------------------------------


def distinct_content(files: DataFrame) -> DataFrame:
    """Each (path, content hash) once, so nothing is parsed twice."""
    return files.dropDuplicates(["path", "file_hash"])


def _symbol(name, kind, start, end, parent) -> Column:
    return F.struct(
        name.alias("name"),
        F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"),
        start.cast("int").alias("start_line"),
        end.cast("int").alias("end_line"),
        F.lit("").alias("docstring"),
        parent.alias("parent"),
    )


def _definition(h: Column, owner: Column) -> Column:
    """A def line; indented behind any class it is a method of the latest one."""
    method = (h["indent"] > 0) & (owner != "")
    return _symbol(
        h["name"],
        F.when(method, "method").otherwise("function"),
        h["line"],
        h["line"],
        F.when(method, owner).otherwise(""),
    )


def _symbols(lines: Column) -> Column:
    def found(x: Column, i: Column) -> Column:
        kind = F.when(x.rlike(CLASS_LINE), "class").when(x.rlike(DEF_LINE), "def")
        name = F.when(x.rlike(CLASS_LINE), F.regexp_extract(x, CLASS_LINE, 1)).otherwise(
            F.regexp_extract(x, DEF_LINE, 2)
        )
        return F.struct(
            kind.alias("kind"),
            name.alias("name"),
            F.length(F.regexp_extract(x, DEF_LINE, 1)).alias("indent"),
            (i + 1).alias("line"),
        )

    def per_class(hits: Column, total: Column):
        def body(start: Column, length: Column) -> Column:
            own = F.get(hits, start)
            following = F.get(hits, start + length)["line"]
            cls = _symbol(
                own["name"], "class", own["line"],
                F.coalesce(following - 1, total), F.lit(""),
            )
            return F.concat(
                F.array(cls),
                F.transform(
                    F.slice(hits, start + 2, length - 1),
                    lambda h: _definition(h, own["name"]),
                ),
            )

        return body

    def whole(ls: Column) -> Column:
        hits = F.filter(F.transform(ls, found), lambda h: h["kind"].isNotNull())
        return bind(
            hits,
            lambda hs: bind(
                positions(hs, lambda h: h["kind"] == "class"),
                lambda cs: F.concat(
                    F.transform(
                        head(hs, F.coalesce(F.get(cs, F.lit(0)), F.size(hs))),
                        lambda h: _definition(h, F.lit("")),
                    ),
                    F.flatten(spans(cs, F.size(hs), per_class(hs, F.size(ls)))),
                ),
            ),
        )

    return bind(lines, whole)


def _parsed(files: DataFrame) -> DataFrame:
    text = F.make_valid_utf8(F.col("content").cast("string"))
    both = bind(
        split_lines(text),
        lambda ls: F.struct(F.size(ls).alias("line_count"), _symbols(ls).alias("symbols")),
    )
    return with_once(files.select("path", "content"), "x", both).select("path", "x.*")


def symbol_ranges(files: DataFrame) -> DataFrame:
    """One row per symbol of ``files(path, content)``: computed within the file's row."""
    return _parsed(files).select("path", F.posexplode("symbols").alias("ord", "s")).select(
        "path", "ord", "s.*"
    )


CACHED = (
    "content_hash STRING, symbols ARRAY<STRUCT<name: STRING, kind: STRING, start_line: INT, "
    "end_line: INT, docstring: STRING, parent: STRING>>"
)


def read_cache(spark: SparkSession, path: str, commit: bool = False) -> DataFrame:
    """The symbols of every content parsed so far, with the run that parsed it if asked for."""
    stored = spark.read.schema(CACHED + ", commit STRING").parquet(f"{path}/symbols")
    return stored if commit else stored.drop("commit")


def cached_symbols(files: DataFrame, path: str, commit: str) -> DataFrame:
    """``symbol_ranges`` by way of a cache in ``path``: only unseen contents are parsed.

    A content is known by its SHA-256. What this run had to parse is kept under
    ``commit``; a run repeated after a loss replaces its own part. Two runs at the
    same time may both parse a content; readers take it once. Null contents have no
    symbols and are not cached.
    """
    spark = files.sparkSession
    hashed = files.where(F.col("content").isNotNull()).withColumn(
        "content_hash", F.sha2("content", 256)
    )
    fresh = hashed.select("content_hash", "content")
    if any(n != f"commit={commit}" for n in file_names(spark, f"{path}/symbols")):
        known = read_cache(spark, path, commit=True).where(F.col("commit") != commit)
        fresh = fresh.join(known.select("content_hash"), "content_hash", "left_anti")
    # Equal contents meet as their hash and any one of them: combined before the shuffle.
    once = fresh.groupBy("content_hash").agg(F.first("content").alias("content"))
    parsed = _parsed(once.withColumnRenamed("content_hash", "path"))
    parsed.select(F.col("path").alias("content_hash"), "symbols").write.mode("overwrite").parquet(
        f"{path}/symbols/commit={commit}"
    )
    stored = read_cache(spark, path).dropDuplicates(["content_hash"])
    return (
        hashed.select("path", "content_hash")
        .join(stored, "content_hash")
        .select("path", F.posexplode("symbols").alias("ord", "s"))
        .select("path", "ord", "s.*")
    )


def symbol_children(symbols: DataFrame) -> DataFrame:
    """Methods of each class, matched by name: classes of one name share them."""
    classes = symbols.where((F.col("kind") == "class") & (F.col("parent") == "")).select(
        "path", F.col("name").alias("parent"), F.col("start_line").alias("class_line")
    )
    methods = symbols.where(F.col("parent") != "").select(
        "path", "parent", F.col("name").alias("method"), F.col("start_line").alias("method_line")
    )
    return classes.join(methods, ["path", "parent"])


def symbol_outline(files: DataFrame) -> DataFrame:
    """The indented outline of each file as one text."""
    def rows(symbols: Column) -> Column:
        own = F.filter(symbols, lambda s: s["parent"] != "")

        def listed(methods: Column) -> Column:
            def one(s: Column) -> Column:
                line = F.format_string(
                    SYMBOL_ROW, s["kind"], s["name"], s["start_line"], s["end_line"]
                )
                inner = F.transform(
                    F.filter(methods, lambda m: (s["kind"] == "class") & (m["parent"] == s["name"])),
                    lambda m: F.format_string(
                        METHOD_ROW, F.lit("def"), m["name"], m["start_line"], m["end_line"]
                    ),
                )
                return F.concat(F.array(line), inner)

            return F.flatten(F.transform(F.filter(symbols, lambda s: s["parent"] == ""), one))

        return bind(own, listed)

    title = F.format_string(FILE_ROW, F.col("path"), F.col("line_count"))
    text = F.array_join(
        F.concat(F.array(title), bind(F.col("symbols"), rows)), "\n"
    )
    return _parsed(files).select("path", "line_count", text.alias("outline"))
