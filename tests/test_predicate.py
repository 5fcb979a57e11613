import pytest

from tomolake.errors import SchemaError
from tomolake.plans.predicate import where


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, "a", 1.5), (2, "b", None), (3, "c", -2.0), (4, None, 0.0)], "k int, s string, v double")


@pytest.mark.parametrize(
    "text,want",
    [
        ("k > 2", [3, 4]), ("s == 'a'", [1]), ("k >= 2 and v < 1", [3, 4]), ("(k == 1) | (k == 4)", [1, 4]), ("s in ['a', 'c']", [1, 3]), ("s not in ['a']", [2, 3]),
        ("v == -2.0", [3]), ("not k == 1", [2, 3, 4]), ("~(k < 3) & (k != 4)", [3]), ("v is None", [2]), ("s is not None and 1 < k <= 3", [2, 3]), ("s == 'it is'", []),
    ],
)
def test_dialect(df, text, want):
    assert sorted(r.k for r in where(df, text).collect()) == want


@pytest.mark.parametrize("text", ["k >", "unknown > 1", "len(s) > 1", "k + 1 > 2", "s.upper() == 'A'", "__import__('os')", "k in s", "lambda: 1", "k > [1]"])
def test_rejected(df, text):
    with pytest.raises(SchemaError):
        where(df, text)


def test_filter_reaches_the_scan(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "t"))
    plan = where(spark.read.parquet(str(tmp_path / "t")), "k > 2 and s == 'c'").select("k")._jdf.queryExecution().toString()
    assert "GreaterThan(k,2)" in plan and "EqualTo(s,c)" in plan and "ReadSchema: struct<k:int,s:string>" in plan
