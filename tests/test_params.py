import pytest

from tidewell.errors import MissingParams, SpecError
from tidewell.params import bind_read, scoped, transform
from tidewell.spec import Aggregation, Filter, FilterGroup, Having, ReadOp


def test_transforms():
    assert transform(" A/b ", ["trim", "lowercase", "split:/:1", "uppercase"]) == "B"
    for steps in (["reverse"], ["split"], ["split::0"], ["split:/:x"], ["split:/:9"], ["split:/:-1"]):
        with pytest.raises(SpecError):
            transform("a/b", steps)


def test_binding_everywhere():
    op = ReadOp("t", filters=(Filter("a", "In", "", None, ("$ids", "9")), Filter("b", "Between", "$lo", "$hi|trim")), filter_tree=FilterGroup("And", (Filter("c", "Eq", "$c"),)), aggregations=(Aggregation("TopN", "f", n="$n", having=Having("Gt", "$h")),))
    out = bind_read(op, {"ids": ["1", 2], "lo": 1, "hi": " 5 ", "c": "$", "n": "3", "h": 4})
    assert out.filters[0].values == ("1", "2", "9") and (out.filters[1].value, out.filters[1].value_to) == ("1", "5")
    assert out.filter_tree.filters[0].value == "$" and out.aggregations[0].n == 3 and out.aggregations[0].having.value == "4"
    with pytest.raises(MissingParams) as e:
        bind_read(op, {"ids": "1"})
    assert e.value.names == ["c", "h", "hi", "lo", "n"]


def test_batch_scope():
    assert scoped({"a": 1, "x:a": 2, "y:b": 3}, "x") == {"a": 2}
