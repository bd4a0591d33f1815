import pytest

from paramscan.errors import SelectionError
from paramscan.functions.registry import register
from paramscan.operators.gather import gather
from paramscan.sources.tables import write_tsv


def test_gather(spark, tmp_path):
    table = spark.createDataFrame([("same.fits", "a" * 40), ("other.fits", "unknown"), (None, "b" * 40)], "path string, sha1 string").selectExpr("path", "sha1", "'NA' as source")
    write_tsv(table, str(tmp_path / "t.tsv"), null="None")
    config = {"data": [{"fmt": "data/{source}.fits", "db": "t.tsv"}, {"file": "static.txt", "md5": "c" * 32, "sha256": "d" * 64}, "odd"], "meta": [{"file": "meta.yml"}]}
    rows = lambda **k: [(r.path, r.algorithm, (r.checksum or "")[:1]) for r in gather(spark, str(tmp_path), config, **k).collect()]
    assert rows(paths=["same.fits"], tables=["t"]) == [("same.fits", "sha1", "a"), ("other.fits", None, ""), ("data/NA.fits", "sha1", "b")]
    assert rows(everything=True)[-2:] == [("static.txt", "sha256", "d"), ("meta.yml", None, "")]
    with pytest.raises(SelectionError):
        rows(tables=["missing"])
    with pytest.raises(ValueError):
        rows(paths=["../up"])
    with open(tmp_path / "t.tsv", "a") as f:
        f.write("x.fits\t\tNA\ttoo many\n")
    with pytest.raises(SelectionError, match="more values"):
        rows(tables=["t"])
    legacy = spark.createDataFrame([("a" * 40, "x")], "sha1 string, source string")
    assert [r.path for r in gather(spark, str(tmp_path), {"data": [{"fmt": "d/{source}.f"}]}, data=legacy).collect()] == ["d/x.f"]


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT path_tokens('a_b-c.d/e') t").first().t == ["a", "b", "c", "d", "e"]
    assert spark.sql("SELECT path_delimiters('a_b-c') d").first().d == ["_", "-"]
    row = spark.sql("SELECT canonical_number('1.5') a, canonical_number('001') b, is_valid_checksum('md5', repeat('a', 32)) c").first()
    assert (row.a, row.b, row.c) == (True, False, True)
    got = spark.sql("SELECT p, field, value FROM VALUES ('a0.5_i3.h5'), ('zz') AS t(p), LATERAL fmt_parse('a{a}_i{i}.h5', p)").collect()
    assert {(r.field, r.value) for r in got} == {("a", "0.5"), ("i", "3")}
