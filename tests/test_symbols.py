"""Symbol maps of small sources."""

from pyspark.sql import functions as F

from logdistill.operators import symbols as S
from logdistill.sources.tables import describe_files, read_source_files

SOURCE = b'''import os

def first(x):
    def inner():
        pass

class A(Base):
    """doc"""
    def one(self): pass
    async def skipped(self): pass
    def two(self): pass

def between(): pass
class B:
\tdef three(self): pass
class A:
    def four(self): pass
'''


def table(spark, **files):
    return spark.createDataFrame([(k, v) for k, v in files.items()], "path string, content binary")


def test_ranges(spark):
    got = S.symbol_ranges(table(spark, a=SOURCE)).orderBy("ord").collect()
    assert [(r.name, r.kind, r.start_line, r.end_line, r.parent) for r in got] == [
        ("first", "function", 3, 3, ""), ("inner", "function", 4, 4, ""),
        ("A", "class", 7, 13, ""), ("one", "method", 9, 9, "A"), ("two", "method", 11, 11, "A"),
        ("between", "function", 13, 13, ""), ("B", "class", 14, 15, ""), ("three", "method", 15, 15, "B"),
        ("A", "class", 16, 17, ""), ("four", "method", 17, 17, "A"),
    ]


def test_no_symbols(spark):
    files = table(spark, empty=b"", prose=b"no code\nhere")
    assert S.symbol_ranges(files).count() == 0
    got = {r.path: r.outline for r in S.symbol_outline(files).collect()}
    assert got == {"empty": "# empty  (0 lines)", "prose": "# prose  (2 lines)"}


def test_classes_of_one_name_share_methods(spark):
    outline = S.symbol_outline(table(spark, a=SOURCE)).first().outline.splitlines()
    assert outline[0] == "# a  (17 lines)"
    assert outline[1] == "function   " + "first".ljust(38) + " [3–3]"
    methods = [x.split()[1] for x in outline if x.startswith("  def ")]
    assert methods == ["one", "two", "four", "three", "one", "two", "four"]
    assert outline[4] == "  def      " + "one".ljust(36) + " [9–9]"
    children = S.symbol_children(S.symbol_ranges(table(spark, a=SOURCE)))
    assert children.where("parent = 'A'").count() == 6


def test_bad_bytes_are_replaced(spark):
    got = S.symbol_ranges(table(spark, a=b"# \xff\xfe\ndef caf\xc3\xa9(): pass\n")).first()
    assert (got.name, got.start_line) == ("café", 2)


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_bytes(b"def a(): pass\n")
    (tmp_path / "sub" / "b.py").write_bytes(b"x\ny\n")
    (tmp_path / "c.txt").write_bytes(b"no")
    got = {r.path.rsplit("/", 1)[1]: r for r in read_source_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.py", "b.py"} and got["b.py"].line_count == 2
    import hashlib

    assert got["a.py"].file_hash == hashlib.sha256(b"def a(): pass\n").hexdigest()[:16]
    twice = table(spark, a=SOURCE).unionByName(table(spark, a=SOURCE)).unionByName(table(spark, a=b"x"))
    assert S.distinct_content(describe_files(twice)).count() == 2
    assert describe_files(table(spark, a=b"x")).select(F.max("line_count")).first()[0] == 1


def test_cache_parses_each_content_once(spark, tmp_path):
    path = str(tmp_path)
    first = table(spark, a=SOURCE, b=SOURCE, c=b"def x(): pass")
    got = S.cached_symbols(first, path, "one")
    assert sorted(got.collect()) == sorted(S.symbol_ranges(first).collect())
    parsed = lambda: {r["commit"]: r["count"] for r in S.read_cache(spark, path, True).groupBy("commit").count().collect()}
    assert parsed() == {"one": 2}
    more = first.unionByName(table(spark, d=SOURCE, e=None, f=b"", g=b"class New: pass"))
    got = S.cached_symbols(more, path, "two")
    assert sorted(got.collect()) == sorted(S.symbol_ranges(more).collect())
    assert parsed() == {"one": 2, "two": 2}  # the empty and the new one
    S.cached_symbols(more, path, "two")
    S.cached_symbols(more, path, "three")
    assert parsed() == {"one": 2, "two": 2}
    assert S.cached_symbols(more.limit(0), path, "four").count() == 0
