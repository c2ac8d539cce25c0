from __future__ import annotations

import dataclasses
import re

import pytest
from varve.functions.python_source import code_line_count, docstring_lines
from varve.operators import corpus

PYTHON = (
    "df = spark.readStream.format('cloudFiles').load('/Volumes/main/raw')\n"
    "# dbutils.fs.ls('dbfs:/tmp') in a comment is no hit\n"
    "dbutils.fs.ls('dbfs:/tmp')\n"
    "display(df)\n"
)
SQL = (
    "-- read_files('x') in a comment\n"
    "CREATE OR REFRESH STREAMING TABLE t AS\n"
    "SELECT * FROM read_files('/data');\n"
)

# one line per rule that must hit it
SAMPLES = {
    "dbutils": "x = dbutils.widgets.get('a')",
    "display": "display(df)",
    "databricks_connect": "from databricks.connect import DatabricksSession",
    "databricks_sdk": "from databricks.sdk import WorkspaceClient",
    "spark_databricks_conf": "spark.conf.set('spark.databricks.io.cache', 1)",
    "dbfs": "open('/dbfs/tmp/a')",
    "volumes_path": "p = '/Volumes/a/b'",
    "auto_loader": ".format('cloudFiles')",
    "dlt": "import dlt",
    "streaming_table": "create streaming  table a",
    "materialized_view": "CREATE OR REPLACE MATERIALIZED VIEW v AS SELECT 1",
    "read_files": "select * from READ_FILES ('x')",
    "ai_functions": "select ai_query('m', 'p')",
    "vector_search": "select * from vector_search(index => 'i')",
    "secret_fn": "select secret('scope', 'key')",
    "cluster_by_auto": "CREATE TABLE t (a INT) CLUSTER BY AUTO",
    "row_filter_mask": "ALTER TABLE t SET ROW FILTER f ON (a)",
    "system_tables": "select * from system.billing.usage",
    "create_or_replace_location": "CREATE OR REPLACE TABLE t (a INT) LOCATION 's3://x'",
    "alter_table_meta": "ALTER TABLE t SET TBLPROPERTIES ('a' = 'b')",
    "notebook_magic": "# MAGIC %sql",
}


def frame(spark, **files):
    data = [(name.replace("__", "."), text) for name, text in files.items()]
    return spark.createDataFrame(data, "file STRING, text STRING")


def test_python_and_sql_files(spark):
    found = corpus.findings(frame(spark, a__py=PYTHON, b__sql=SQL)).collect()
    hits = {(r.file, r.line, r.rule) for r in found}
    assert hits == {
        ("a.py", 1, "auto_loader"), ("a.py", 1, "volumes_path"), ("a.py", 3, "dbutils"),
        ("a.py", 3, "dbfs"), ("a.py", 4, "display"),
        ("b.sql", 2, "streaming_table"), ("b.sql", 3, "read_files"),
    }


def test_every_rule_hits_its_sample_like_python_does(spark):
    assert set(SAMPLES) == {r.key for r in corpus.RULES} and len(corpus.RULES) == 21
    lines = list(SAMPLES.values()) + ["plain text", "my.display(x)", "redisplay(x)", "ünmask x"]
    files = spark.createDataFrame([(f"f{i}.scala", t) for i, t in enumerate(lines)],
                                  "file STRING, text STRING")
    got = {(r.file, r.rule) for r in corpus.findings(files, python=False).collect()}
    expected = {
        (f"f{i}.scala", rule.key)
        for i, text in enumerate(lines) for rule in corpus.RULES if re.search(rule.pattern, text)
    }
    assert got == expected
    assert {(f"f{i}.scala", k) for i, k in enumerate(SAMPLES)} <= got


def test_factors_lose_no_hit(spark):
    """Letters that fold to ASCII ones, odd line breaks, and rules whose literals are unknown."""
    odd = ["\u017felect \u017fecret  ('a')", "ALTER TABLE t SET ROW F\u0130LTER f", "ma\u017f\u212a x", "a\x0bimport dlt\x1c%sql"]
    files = spark.createDataFrame([(f"f{i}.scala", t) for i, t in enumerate(odd)], "file STRING, text STRING")
    bare = [dataclasses.replace(r, factors=()) for r in corpus.RULES]
    hits = [{tuple(r) for r in corpus.findings(files, rules, python=False).collect()} for rules in (corpus.RULES, bare)]
    assert hits[0] == hits[1]
    assert {(r[0], r[2]) for r in hits[0]} >= {("f0.scala", "secret_fn"), ("f3.scala", "dlt"), ("f3.scala", "notebook_magic")}
    assert corpus.findings(files.where("false")).count() == 0
    empty = spark.createDataFrame([("a.py", None), ("b.sql", "")], "file STRING, text STRING")
    assert corpus.findings(empty).count() == 0


def test_a_file_may_stand_in_several_categories(spark):
    files = spark.createDataFrame([("r/a/x.py", 3), ("r/a/__init__.py", 1), ("r/b/y.sql", 5)], "file STRING, loc INT")
    placed = corpus.classified(files, "r", {"shared": {"t": ["a/*.py"], "o": ["?/*.*"]}, "own": {"t": ["b/*.sql"]}})
    assert {tuple(r) for r in placed.collect()} == {
        ("r/a/x.py", 3, "shared", "t"), ("r/a/x.py", 3, "shared", "o"),
        ("r/b/y.sql", 5, "shared", "o"), ("r/b/y.sql", 5, "own", "t"),
    }


def test_docstrings_are_not_code(spark):
    source = 'def f():\n    """uses dbutils.fs"""\n    return dbutils.fs\n'
    found = corpus.findings(frame(spark, a__py=source)).collect()
    assert [(r.line, r.text) for r in found] == [(3, "return dbutils.fs")]
    assert docstring_lines("not python (") == set()


@pytest.mark.parametrize("text", [
    "", "a", "a\n", "a\n\nb", "\n", "\r\n\n\r\r\n", "a\r\nb\rc\x0bd\x85e f", "x\n\n", "é\n\tq ",
])
def test_lines_split_like_python(spark, text):
    files = spark.createDataFrame([("f", text)], "file STRING, text STRING")
    assert corpus.split_lines(files).first().lines == text.splitlines()


def test_code_lines(spark):
    source = '"""Doc."""\n\n# comment\nx = 1\n\ndef f():\n    """Doc\n    more."""\n    return x\n'
    assert code_line_count(source) == 3
    files = frame(spark, a__py=source, b__sql="-- c\nSELECT 1\n\n  , 2\n", c__yml="# c\na: 1\n",
                  d__py="x = (")
    assert dict(map(tuple, corpus.code_lines(files).collect())) == {
        "a.py": 3, "b.sql": 2, "c.yml": 1, "d.py": None,
    }


def test_read_classify_and_share(spark, tmp_path):
    for name, text in {
        "src/a.py": "x = 1\ny = 2\n", "src/__init__.py": "z = 1\n", "src/deep/b.py": "q = 1\n",
        "jobs/run.sql": "SELECT 1\n", ".venv/c.py": "x = 1\n", "src/notes.txt": "no\n",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    # Spark's file source does not list names that start with an underscore
    assert corpus.read_files(spark, str(tmp_path)).count() == 3
    files = corpus.read_tree(spark, str(tmp_path))
    assert files.count() == 4
    inventory = {"shared": {"work": ["src/*.py"]}, "cloud": {"work": ["jobs/*.sql"]}}
    placed = corpus.classified(files, str(tmp_path), inventory)
    counted = placed.join(corpus.code_lines(files), "file")
    totals = corpus.loc_totals(counted)
    assert {tuple(r) for r in totals.collect()} == {("shared", "work", 1, 2), ("cloud", "work", 1, 1)}
    assert [tuple(r) for r in corpus.shared_ratio(totals).collect()] == [
        ("cloud", "work", 2, 1, 0.6667)
    ]


def test_docstrings_by_position():
    source = (
        'r"""Doc\nof two lines."""\n@wrap\nasync def f(\n    a,\n):\n    "one"  "two"\n    "no"\n'
        'class C:\n\n    # note\n    """Doc."""\n    if a:\n        "no"\n    b"no"\ndef g():\n    b"no"\ndef h():\n    f"no"\n'
    )
    assert docstring_lines(source) == {1, 2, 7, 12}
    assert code_line_count("") == 0 and docstring_lines("") == set()
    assert code_line_count(source) == len([l for l in source.splitlines() if l.strip() and "#" not in l]) - 4


def test_docstrings_in_brackets_and_one_line_bodies():
    source = (
        '("in brackets"\n "goes on")\ndef f(a: int = {1: 2}[1]): "doc"\nclass C: x = 1\n'
        'def g():\n    "doc"; x = 1\n    return ("no")\ndef h():\n    ("a", )\ndef i():\n    ()\n'
    )
    assert docstring_lines(source) == {1, 2, 3, 6}
    assert code_line_count(source) == 7


def test_code_files_clean_a_text_once(spark, tiny):
    from varve.plans import queries_more

    plan = queries_more._code_files(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and plan.count("length(text") == 1, plan
