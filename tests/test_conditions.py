import random

import pandas as pd
import pytest

from freshet.functions.conditions import condition
from freshet.plans import charts

WRITTEN = [
    "x > 0", "x == 0", "x != 1", "0 < x <= 2", "x in [1, 2]", "x not in (1, 2)", "site == 'a' and x > 0 or site == \"b\"",
    "not (x > 0 and site == 'a')", "(x > 0) & ~(site == 'a') | (x == 0)", "`total depth` >= 1.5 and x < @limit", "site in @names",
    "x * 2 + 1 > `total depth` - -1", "x == y == 1", "site == '@x `y`'", "flag and x > 0", "not flag", "x / 2 < 1",
]


@pytest.fixture(scope="module")
def frame():
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.choice([0.0, 1.0, 2.0, 3.0]), rng.choice([0.0, 1.0]), rng.choice([0.5, 1.5, 2.5]), rng.choice([True, False])) for _ in range(200)]
    return pd.DataFrame(rows, columns=["site", "x", "y", "total depth", "flag"])


@pytest.mark.parametrize("text", WRITTEN)
def test_conditions_pick_the_rows_that_the_notebook_picks(spark, frame, text):
    limit, names = 2.0, ["a", "c"]  # noqa: F841 - named by the conditions
    wanted = frame.query(text.replace("\n", " "))
    found = spark.createDataFrame(frame).filter(condition(text, {"limit": limit, "names": names})).toPandas()
    assert sorted(map(tuple, found.values)) == sorted(map(tuple, wanted.values))


def test_missing_values_are_equal_to_nothing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0)], "site string, x double")
    picked = {text: df.filter(condition(text)).count() for text in ("x > 0", "x != 1", "not x > 0", "site not in ['b']", "site == 'a'")}
    assert picked == {"x > 0": 2, "x != 1": 2, "not x > 0": 1, "site not in ['b']": 3, "site == 'a'": 2}


@pytest.mark.parametrize(
    "text",
    ["__import__('os')", "x.mean() > 1", "f(x)", "x if y else 1", "lambda: 1", "[x for x in y]", "x >", "", "x[0] == 1", "x ** 2 > 1", "@x > 1",
     "x in y", "x is None", "x = 1", "x; y", "x in [y]", "'a'", "1", "b'x' == site", "x > @names", "1 < {}", "x := 1"],
)
def test_everything_else_is_refused(spark, text):
    with pytest.raises(ValueError):
        condition(text, {"names": ["a"]})


def test_joint_plots_take_conditions_as_columns(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 0.0)], "site string, x double, outflow_mm double")
    for given in ("outflow_mm > 0", condition("outflow_mm > 0")):
        assert charts.joint_counts(df, "x", "outflow_mm", 1, 1, given).first()["storms"] == 1
