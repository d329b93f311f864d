from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from ledgerloom import ConsistencyError, LogTable, TableConfig, ValidationError
from ledgerloom.sources import binary_log as B
from tests.conftest import rows

VALUES = st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1), st.text(max_size=9), st.binary(max_size=9), st.decimals(allow_nan=False, allow_infinity=False, places=4, min_value=-(10**12), max_value=10**12))


@given(st.lists(VALUES, max_size=5), st.booleans())
def test_rows_round_trip(values, dead):
    assert B.decode_row(B.encode_row(values, dead)) == (dead, values)


def test_known_bytes():
    assert B.encode_row([1, "hello", b"\x00\x01"], True) == bytes([0xFF, 1]) + (1).to_bytes(8, "big") + b"\x03" + (5).to_bytes(8, "big") + b"hello" + b"\x04" + (2).to_bytes(8, "big") + b"\x00\x01"
    assert B.encode_decimal(Decimal("-1.5")) == bytes([0, 0, 1, 0x80, 15, 0, 0, 0]) + bytes(8)
    with pytest.raises(ValidationError):
        B.encode_decimal(Decimal(2**96))


@pytest.mark.parametrize("raw", [b"", b"\x07", b"\x00\x09", b"\x00\x01\x00", b"\x00\x03" + (9).to_bytes(8, "big") + b"x"])
def test_garbage(raw):
    with pytest.raises(ConsistencyError):
        B.decode_row(raw)


def schema():
    return T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("amount", T.DecimalType(20, 4))])


def test_scan_offsets_torn_tails_and_unused_entries(spark, tmp_path):
    B.write_segment(str(tmp_path), 1, [([1, "a", Decimal("1.5")], False), None, ([2, None], False), ([1, "b", None], False)])
    B.write_segment(str(tmp_path), 2, [([2, None, None], True), ([3, "c", Decimal("7")], False)])
    with open(tmp_path / "metadata.2", "ab") as f:
        f.write(b"\x01\x02\x03")
    log = B.read_log(spark, tmp_path, schema(), entries_per_task=2)
    assert rows(log.select("_seg", "_idx", "_tombstone", "id", "name")) == [(1, 0, False, 1, "a"), (1, 2, False, 2, None), (1, 3, False, 1, "b"), (2, 0, True, 2, None), (2, 1, False, 3, "c")]
    assert rows(B.read_log(spark, tmp_path, schema(), from_seg=1, from_idx=3).select("_seg", "_idx")) == [(1, 3), (2, 0), (2, 1)]
    t = LogTable.open(spark, TableConfig(str(tmp_path / "new"), schema(), "id", ("name",)))
    B.load_table(spark, tmp_path, t)
    assert rows(t.latest()) == [(1, "b", None), (3, "c", Decimal("7.0000"))]


def test_wrong_version_and_type(spark, tmp_path):
    B.write_segment(str(tmp_path), 1, [([1, 2], False)])
    with pytest.raises(Exception, match="holds INT"):
        B.read_log(spark, tmp_path, schema()).collect()
    (tmp_path / "metadata.1").write_bytes(bytes([9]) + bytes(23))
    with pytest.raises(ValidationError):
        B.read_header(str(tmp_path / "metadata.1"))
    (tmp_path / "metadata.1").write_bytes(b"")
    with pytest.raises(ConsistencyError):
        B.read_header(str(tmp_path / "metadata.1"))
