"""Source-corpus analytics: rule findings per line, lines of code, shares by group.

Files are rows ``(file, text)``. Text is split and matched inside the JVM; Python runs only
for Python files, which need its tokenizer, and only over those.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.functions.python_source import code_line_count, docstring_lines

ADAPTABLE, REIMPLEMENT, PLATFORM_SPECIFIC = "ADAPTABLE", "REIMPLEMENT", "PLATFORM-SPECIFIC"


@dataclass(frozen=True)
class Rule:
    key: str
    pattern: str
    capability: str
    classification: str
    alternative: str = ""
    factors: tuple[str, ...] = ()  # every match holds one of these, in small letters; () if unknown


# Scan rules (key, pattern, capability, classification). The last two fields are
# this library's: its advice, and the literals that a match cannot do without.
RULES: tuple[Rule, ...] = (
    Rule("dbutils", r"\bdbutils\.",
         "Databricks Utilities (fs, secrets, widgets, notebook)", ADAPTABLE,
         "job parameters, an object-store client, a secret manager",
         ("dbutils.",)),
    Rule("display", r"(?<![\w.])display\(", "Notebook display()", ADAPTABLE, "show() or a plot",
         ("display(",)),
    Rule("databricks_connect", r"\bDatabricksSession\b|from databricks\.connect",
         "Databricks Connect session", ADAPTABLE, "a Spark Connect session",
         ("databrickssession", "databricks.connect")),
    Rule("databricks_sdk", r"from databricks\.sdk|import databricks\.sdk",
         "Databricks SDK / REST APIs", PLATFORM_SPECIFIC, "isolate behind a platform adapter",
         ("databricks.sdk",)),
    Rule("spark_databricks_conf", r"spark\.databricks\.", "Databricks-only Spark configuration",
         PLATFORM_SPECIFIC, "drop it or set it per platform",
         ("spark.databricks.",)),
    Rule("dbfs", r"dbfs:/|/dbfs/", "DBFS paths", ADAPTABLE, "a configured storage address",
         ("dbfs:/", "/dbfs/")),
    Rule("volumes_path", r"/Volumes/", "Hard-coded Unity Catalog Volume path", ADAPTABLE,
         "a configured storage address",
         ("/volumes/",)),
    Rule("auto_loader", r"cloudFiles", "Auto Loader", REIMPLEMENT,
         "a streaming file source with a checkpoint",
         ("cloudfiles",)),
    Rule("dlt", r"^\s*import dlt\b|@dlt\.", "Lakeflow Declarative Pipelines (dlt module)", ADAPTABLE,
         "Spark declarative pipelines",
         ("import dlt", "@dlt.")),
    Rule("streaming_table", r"(?i)\bCREATE\s+(OR\s+REFRESH\s+)?STREAMING\s+TABLE\b",
         "Lakeflow streaming tables (SQL)", ADAPTABLE, "Spark declarative pipelines in SQL",
         ("streaming",)),
    Rule("materialized_view", r"(?i)\bCREATE\s+(OR\s+REPLACE\s+)?MATERIALIZED\s+VIEW\b",
         "Materialized views", ADAPTABLE, "a declared materialized view or a refreshed table",
         ("materialized",)),
    Rule("read_files", r"(?i)\bread_files\s*\(", "read_files() table-valued function", ADAPTABLE,
         "a DataFrame reader",
         ("read_files",)),
    Rule("ai_functions",
         r"(?i)\bai_(query|classify|extract|gen|similarity|summarize|translate|forecast)\s*\(",
         "Databricks AI Functions", PLATFORM_SPECIFIC, "call a model service from a UDF",
         ("ai_",)),
    Rule("vector_search", r"databricks\.vector_search|vector_search\(", "Mosaic AI Vector Search",
         PLATFORM_SPECIFIC, "an open vector store",
         ("vector_search",)),
    Rule("secret_fn", r"(?i)\bsecret\s*\(\s*'", "SQL secret() function", ADAPTABLE,
         "parameters or environment variables",
         ("secret",)),
    Rule("cluster_by_auto", r"(?i)\bCLUSTER\s+BY\s+AUTO\b", "Automatic liquid clustering", ADAPTABLE,
         "name the clustering columns",
         ("cluster",)),
    Rule("row_filter_mask", r"(?i)\b(ROW\s+FILTER|MASK)\b\s+\w", "Row filters / column masks",
         PLATFORM_SPECIFIC, "enforce policy obligations in the query",
         ("filter", "mask")),
    Rule("system_tables", r"\bsystem\.(billing|access|lakeflow|compute|query|information_schema)\.",
         "Databricks system tables", PLATFORM_SPECIFIC, "event logs and monitoring",
         ("system.",)),
    Rule("create_or_replace_location", r"(?i)CREATE\s+OR\s+REPLACE\s+TABLE[^;]*\bLOCATION\b",
         "CREATE OR REPLACE TABLE ... LOCATION", ADAPTABLE, "create once, then overwrite the rows",
         ("location",)),
    Rule("alter_table_meta",
         r"(?i)\bALTER\s+TABLE\b[^;]*\b(SET\s+TBLPROPERTIES|ALTER\s+COLUMN[^;]*COMMENT)\b",
         "ALTER TABLE metadata changes", ADAPTABLE, "set comments and properties at creation",
         ("alter",)),
    Rule("notebook_magic", r"^\s*#\s*MAGIC\s+%|^%(sql|python|run|pip)\b", "Notebook magics",
         ADAPTABLE, "plain modules and SQL files",
         ("magic", "%sql", "%python", "%run", "%pip")),
)

# Scanned file types, skipped folders, comment markers.
SUFFIXES = ("py", "sql", "scala", "yml", "yaml", "ipynb")
SKIPPED_FOLDERS = (".venv", "stack")
COMMENT_MARKERS = {"sql": "--", "yml": "#", "yaml": "#"}

# every line boundary that str.splitlines knows; one class first, so that scanning is cheap
_LINE_BREAK = "[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029](?:(?<=\r)\n)?"
# what str.strip removes: the 29 code points that str.isspace knows
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_ODD_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def read_files(spark: SparkSession, root: str, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """All files of the given types below a folder, one row each: ``(file, text)``.

    Spark lists and reads them in parallel, from any storage it knows; files in a skipped
    folder are left out. Its file source never shows names that start with ``_`` or ``.``:
    use ``read_tree`` for a mounted source tree, where such files are code too.
    """
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}")
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    )
    folders = F.split(F.regexp_replace("file", "/[^/]*$", ""), "/")
    return files.where(~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS))))


def read_tree(spark: SparkSession, root: str, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """Like ``read_files`` for a folder mounted on every machine, with no file left out.

    The driver lists names only; tasks open the files. Undecodable bytes are replaced.
    """
    wanted = tuple("." + s for s in suffixes)
    names = [
        (os.path.join(folder, name),)
        for folder, _, files in os.walk(root)
        if not set(SKIPPED_FOLDERS) & set(folder.split(os.sep))
        for name in files
        if name.endswith(wanted)
    ]

    def open_files(batches):
        for batch in batches:
            for path in batch["file"]:
                with open(path, encoding="utf-8", errors="replace", newline="") as handle:
                    yield pd.DataFrame({"file": [path], "text": [handle.read()]})

    listed = spark.createDataFrame(names, "file STRING")
    parts = max(1, min(len(names) // 100, spark.sparkContext.defaultParallelism * 4))
    return listed.repartition(parts).mapInPandas(open_files, "file STRING, text STRING")


def suffix_of(file: Column) -> Column:
    return F.lower(F.regexp_extract(file, r"\.([^./]+)$", 1))


_PARTS = "__parts"


def _with_parts(files: DataFrame) -> DataFrame:
    """Split the text in a projection of its own: what follows uses the pieces repeatedly."""
    return files.withColumn(_PARTS, F.split("text", _LINE_BREAK, -1))


def _lines() -> Column:
    """The lines of a split text; a line break at the very end opens no further line."""
    parts = F.col(_PARTS)
    return F.when(
        F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)
    ).otherwise(parts)


def split_lines(files: DataFrame) -> DataFrame:
    """``files`` with ``lines`` instead of ``text``."""
    return _with_parts(files).withColumn("lines", _lines()).drop("text", _PARTS)


def stripped(line: Column) -> Column:
    return F.trim(line, F.lit(_BLANKS))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _docstrings(sources: pd.Series) -> pd.Series:
    return sources.map(lambda s: None if s is None else sorted(docstring_lines(s)))


@F.pandas_udf(T.IntegerType())
def _code_lines(sources: pd.Series) -> pd.Series:
    return sources.map(lambda s: None if s is None else code_line_count(s)).astype("Int32")


def _with_python(files: DataFrame, name: str, udf) -> DataFrame:
    """Add a per-file Python result; other files pass through without their text."""
    text = F.when(suffix_of(F.col("file")) == "py", F.col("text"))
    return files.withColumn(name, udf(text))


def _is_comment(line: Column, suffix: Column) -> Column:
    start = stripped(line)
    rule = (suffix == "py") & start.startswith("#") & ~F.contains(line, F.lit("MAGIC"))
    for name, marker in COMMENT_MARKERS.items():
        rule = rule | ((suffix == name) & start.startswith(marker))
    return rule


def _hit(line: Column, rule: Rule) -> Column:
    """Does a line match? ``(?U)`` gives character classes their Unicode meaning."""
    return line.rlike("(?U)" + rule.pattern)


def _folded(text: Column) -> Column:
    """Small letters; the four others that match an ASCII letter regardless of case become that."""
    odd = "\u017f\u212a\u0130\u0131"
    rare = reduce(or_, [F.contains(text, F.lit(c)) for c in odd])
    return F.lower(F.when(rare, F.translate(text, odd, "skii")).otherwise(text))


def _may_hit(folded: Column, rule: Rule) -> Column:
    """A plain search for the rule's literals: cheap, and true wherever the rule matches."""
    return reduce(or_, [F.contains(folded, F.lit(f)) for f in rule.factors]) if rule.factors else F.lit(True)


def _with_rules(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``__rules``, the places of the rules that may match a line; texts without any go.

    A generator, so that the tests run once and are not repeated in a pushed filter.
    """
    tests = [F.when(_may_hit(F.col("__folded"), r), F.lit(place)) for place, r in enumerate(rules)]
    found = F.filter(F.array(F.array_compact(F.array(*tests))), lambda places: F.size(places) > 0)
    return (
        files.withColumn("__folded", _folded(F.col("text")))
        .select("*", F.explode(found).alias("__rules")).drop("__folded")
    )


def _matches(line: Column, folded: Column, possible: Column, rules: list[Rule]) -> Column:
    """The rules a line matches, as structs; an expression runs only where its literals occur."""
    hits = [
        F.when(
            F.array_contains(possible, place) & _may_hit(folded, r) & _hit(line, r),
            F.struct(F.lit(r.key).alias("rule"), F.lit(r.capability).alias("capability"),
                     F.lit(r.classification).alias("classification"),
                     F.lit(r.alternative).alias("alternative")),
        )
        for place, r in enumerate(rules)
    ]
    return F.array_compact(F.array(*hits))


def findings(files: DataFrame, rules: Iterable[Rule] = RULES, python: bool = True) -> DataFrame:
    """``(file, line, rule, capability, classification, alternative, text)`` per hit.

    Comments and docstrings are skipped: naming a construct is not using it. ``python=False``
    leaves out the Python step for a corpus without Python files. Whole texts are tested
    first: only texts in which a rule may hit are tokenized and split, and their lines meet
    those rules only. Nothing is shuffled.
    """
    rules = list(rules)
    lines = F.posexplode(_lines()).alias("__pos", "__line")
    tested = _with_rules(files, rules)
    known = _with_python(tested, "__docs", _docstrings) if python else tested.withColumn(
        "__docs", F.lit(None).cast("array<int>")
    )
    prepared = _with_parts(known)
    suffix = suffix_of(F.col("file"))
    located = prepared.select(
        F.col("file"), suffix.alias("__suffix"), "__docs", "__rules", lines
    ).select(
        "file", "__suffix", "__docs", "__rules", (F.col("__pos") + 1).alias("line"), "__line",
        _folded(F.col("__line")).alias("__folded"),
    )
    line, folded, possible = F.col("__line"), F.col("__folded"), F.col("__rules")
    # compiled code drops the many lines without a hit before the arrays are built
    found = located.where(
        reduce(or_, [F.array_contains(possible, p) & _may_hit(folded, r) for p, r in enumerate(rules)])
        & ~_is_comment(line, F.col("__suffix"))
        & ~F.coalesce(F.array_contains("__docs", F.col("line")), F.lit(False))
    )
    return (
        found.select("file", "line", "__line", F.inline(_matches(line, folded, possible, rules)))
        .withColumn("text", stripped(line))
        .drop("__line")
    )


def hits_by_class(found: DataFrame) -> DataFrame:
    return found.groupBy("classification").agg(F.count(F.lit(1)).alias("hits"))


def code_lines(files: DataFrame, python: bool = True) -> DataFrame:
    """``(file, loc)``: lines with code. Blank lines, comments and docstrings do not count.

    For Python files that cannot be tokenized ``loc`` is NULL.
    """
    suffix = suffix_of(F.col("file"))
    marker = F.when(suffix == "sql", "--").otherwise("#")
    texts = F.transform(_lines(), stripped)
    plain = F.size(F.filter(texts, lambda s: (s != "") & ~F.startswith(s, marker)))
    if not python:
        return _with_parts(files).select("file", plain.alias("loc"))
    counted = _with_parts(_with_python(files, "__py", _code_lines))
    return counted.select("file", F.when(suffix == "py", F.col("__py")).otherwise(plain).alias("loc"))


def _glob_regex(pattern: str) -> str:
    """A path pattern, in which ``*`` and ``?`` stay within one folder, as a regex."""
    pieces = {"*": "[^/]*", "?": "[^/]"}
    return "".join(pieces.get(c, re.escape(c)) for c in pattern)


def classified(
    files: DataFrame, root: str, inventory: Mapping[str, Mapping[str, Iterable[str]]]
) -> DataFrame:
    """Add ``group`` and ``category`` from path patterns relative to ``root``.

    A file gets a row for each category that it matches. Files that match nothing, and
    package markers (``__init__.py``), are left out.
    """
    base = re.escape(os.path.join(root, ""))
    places = [
        F.when(
            F.col("file").rlike(f"^{base}({'|'.join(map(_glob_regex, patterns))})$"),
            F.struct(F.lit(group).alias("group"), F.lit(category).alias("category")),
        )
        for group, categories in inventory.items()
        for category, patterns in categories.items()
    ]
    return files.where(~F.endswith("file", F.lit("/__init__.py"))).select(
        "*", F.inline(F.array_compact(F.array(*places)))
    )


def loc_totals(counted: DataFrame) -> DataFrame:
    """Lines of code by group and category, from ``(group, category, loc)`` rows."""
    return counted.groupBy("group", "category").agg(
        F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc")
    )


def shared_ratio(totals: DataFrame, shared: str = "shared") -> DataFrame:
    """Per other group and category: ``shared / (shared + specific)``, NULL without code."""
    common = totals.where(F.col("group") == shared).select(
        "category", F.col("loc").alias("shared_loc")
    )
    others = totals.where(F.col("group") != shared).select(
        "group", "category", F.col("loc").alias("specific_loc")
    )
    lines = F.coalesce("shared_loc", F.lit(0))
    return others.join(common, "category", "left").select(
        "group", "category", lines.alias("shared_loc"), "specific_loc",
        F.round(lines / F.nullif(lines + F.col("specific_loc"), F.lit(0)), 4).alias("score"),
    )
