import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.errors import SpecError
from tidewell.functions import expressions as x
from tidewell.functions import scripts
from tidewell.functions.numbers import as_double


def python_value(node, values):
    """The same tree, evaluated here."""
    if isinstance(node, x.Number):
        return node.value
    if isinstance(node, x.Name):
        return values.get(node.name, 0.0)
    if isinstance(node, x.If):
        return python_value(node.then if python_value(node.condition, values) > 0 else node.otherwise, values)
    a, b = python_value(node.left, values), python_value(node.right, values)
    return {
        "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: 0.0 if b == 0 else a / b, "=": lambda: float(abs(a - b) < x.EPSILON), "!=": lambda: float(abs(a - b) > x.EPSILON),
        ">": lambda: float(a > b), ">=": lambda: float(a >= b), "<": lambda: float(a < b), "<=": lambda: float(a <= b),
    }[node.op]()


TEXTS = st.recursive(
    st.sampled_from(["a", "b.c", "1", "2.5", "1e-3", "0", ".5"]),
    lambda s: st.tuples(st.sampled_from(["{} + {}", "{} - {}", "{}*{}", "{} / {}", "({} = {})", "{} != {}", "{} < {}", "({}>={})", "-{} + {}", "if({}, {}, 2)", "IF ( {} , 1 , {} )"]), s, s).map(lambda t: t[0].format(t[1], t[2])),
    max_leaves=8,
)


@settings(max_examples=15, deadline=None)
@given(st.lists(TEXTS, min_size=4, max_size=8))
def test_columns_agree_with_plain_evaluation(spark, texts):
    values = {"a": 3.0, "b.c": -0.25}
    df = spark.range(1).select(*[x.to_column(x.parse(t), lambda n: F.lit(values[n])).alias(f"c{i}") for i, t in enumerate(texts)])
    for got, t in zip(df.first(), texts):
        want = python_value(x.parse(t), values)
        assert got == want or math.isclose(got, want, rel_tol=1e-12), t


def test_precedence_and_grouping():
    ev = lambda t, **v: python_value(x.parse(t), v)
    assert ev("2 + 3 * 4 - 6 / 2") == 11 and ev("(2 + 3) * 4") == 20 and ev("10 - 3 - 2") == 5
    assert ev("3 > 2 > 1") == 0.0 and ev("1 + 1 = 2") == 1.0 and ev("- 2 * - 3") == 6 and ev("5 / 0") == 0
    assert ev("if(0, 1, if(-1, 2, 3))") == 3 and ev("IFx + 1", IFx=4.0) == 5 and ev("0.1 + 0.2 = 0.3") == 1


@pytest.mark.parametrize("text", ["", "1 +", "(1", "1 2", "if(1, 2)", "if(1, 2, 3", "a $ b", "1..2", "* 2", "f(1)"])
def test_errors(text):
    with pytest.raises(SpecError):
        x.parse(text)


def test_only_numbers_are_numbers(spark):
    texts = ["5", " 5.50 ", "1d", "1f", "0x1", "", None, "abc", "-.5", "+1e3", "1,5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(as_double(F.col("t"), df.schema["t"].dataType)).collect()]
    assert got == [5.0, 5.5, None, None, None, None, None, None, -0.5, 1000.0, None]


def test_scripts(spark):
    cases = {
        "1 + 2 * 3 ^ 2 ^ 1 - -4": 23.0, "-2 ^ 2": -4.0, "7 % 4 + 5 / 0 + 5 % 0": 3.0, "n * 2 == 6 && !(n > 3) || false": True, '"a" + "b\\"c" == "ab\\"c"': True, "max(1, n, 2) + min(4)": 7.0,
        'len(str::trim("  é ")) + floor(2.7) + ceil(0.2) + round(2.5)': 7.0, 'if(str::contains("abc", "b"), str::to_uppercase("y"), "n")': "Y", "math::abs(0 - 3) + math::sqrt(16)": 7.0, '"a" < "b"': True, 'str::regex_matches("a1", "^[a-z][0-9]$")': True,
    }
    df = spark.range(1).select(*[scripts.to_column(t, lambda _: F.lit(3.0)).alias(f"c{i}") for i, t in enumerate(cases)])
    assert list(df.first()) == list(cases.values())
    for bad in ("", "1 +", "(1", "1 2", "1 && true", '"a" + 1', "!1", "-true", "nope(1)", "if(true, 1)", 'if(true, 1, "x")', "1 = 1", "true == 1", "min()", '"open', "len(1)", "1 , 2", ") 1"):
        with pytest.raises(SpecError):
            scripts.to_column(bad, lambda _: F.lit(3.0))
