import itertools
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom import Bound, Kind, ValidationError, Value
from ledgerloom.functions.keys import pack_position, tagged, tagged_literal, unpack_position
from ledgerloom.values import check_range, in_range, order_key


def test_kinds_and_accessors():
    assert [Value.of(v).kind() for v in (1, Decimal("1"), "a", b"a", None)] == [Kind.INT, Kind.DECIMAL, Kind.STRING, Kind.BYTES, Kind.NULL]
    assert Value.decimal("1.50").as_decimal() == "1.50" and Value.int(3).as_int() == 3 and Value.null().as_null() is None
    assert Value.int(1) != Value.decimal("1") and Value.null() == Value.null()
    with pytest.raises(ValidationError):
        Value.int(1).as_string()
    with pytest.raises(ValueError):
        Value.decimal("x")
    with pytest.raises(ValueError):
        Value.int(2**63)
    with pytest.raises(ValidationError):
        Value.of(True)
    with pytest.raises(ValidationError):
        Value.bytes(b"x").as_indexable()
    assert repr(Value.string("it's")) == 'Value.string("it\'s")'


def test_total_order():
    vs = [Value.null(), Value.int(5), Value.decimal("1.0"), Value.string("B"), Value.string("a"), Value.string("é")]
    assert sorted(reversed(vs), key=order_key) == vs


@given(st.integers(-5, 5), st.integers(-5, 5), st.sampled_from(["included", "excluded"]), st.sampled_from(["included", "excluded"]))
def test_inverted_ranges_are_rejected(a, b, how_a, how_b):
    lo, hi = getattr(Bound, how_a)(a), getattr(Bound, how_b)(b)
    if a > b or (a == b and how_a == how_b == "excluded"):
        with pytest.raises(ValidationError):
            check_range(lo, hi)
    else:
        check_range(lo, hi)


def test_ranges_against_the_total_order(spark):
    """Every pair of bounds of every kind, over INT and STRING columns with NULLs."""
    ints, strings = [None, 1, 2, 3], [None, "a", "b", "c"]
    bounds = [Bound.unbounded()] + [f(v) for f in (Bound.included, Bound.excluded) for v in (None, 1, 2, Decimal("2"), "a", "b")]
    for values, ddl in ((ints, "v bigint"), (strings, "v string")):
        df = spark.createDataFrame([(v,) for v in values], ddl).coalesce(1)
        dt = df.schema["v"].dataType
        cases, cols = [], []
        for lo, hi in itertools.product(bounds, bounds):
            try:
                cols.append(in_range(F.col("v"), dt, lo, hi).alias(f"c{len(cols)}"))
            except ValidationError:
                continue
            cases.append((lo, hi))

        def inside(v, lo, hi):
            k = order_key(Value.of(v))
            if lo.value is not None and not (k > order_key(lo.value) or (k == order_key(lo.value) and lo.how == "included")):
                return False
            return hi.value is None or k < order_key(hi.value) or (k == order_key(hi.value) and hi.how == "included")

        got = df.select("v", *cols).collect()
        for r in got:
            for i, (lo, hi) in enumerate(cases):
                assert bool(r[i + 1]) == inside(r[0], lo, hi), (r[0], lo, hi)


def test_tagged_keys_sort_by_kind(spark):
    df = spark.createDataFrame([(None, None, None), (5, None, None), (None, Decimal("1.0"), None), (None, None, "B"), (None, None, "a")], "i bigint, d decimal(38,10), s string")
    got = [tuple(r[:3]) for r in df.orderBy(tagged(F.col("i"), F.col("d"), F.col("s"))).collect()]
    assert got == [(None, None, None), (5, None, None), (None, Decimal("1.0"), None), (None, None, "B"), (None, None, "a")]
    assert df.where(tagged(F.col("i"), F.col("d"), F.col("s")) == tagged_literal(5)).count() == 1


def test_positions_round_trip(spark):
    df = spark.createDataFrame([(1, 0), (14, 2**48 - 1), (32767, 5)], "seg int, idx bigint").withColumn("k", pack_position(F.col("seg"), F.col("idx")))
    seg, idx = unpack_position(F.col("k"))
    assert df.where((seg != F.col("seg")) | (idx != F.col("idx"))).count() == 0
    assert [r.seg for r in df.orderBy("k").collect()] == [1, 14, 32767]
