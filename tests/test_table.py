import json
import os
import threading
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import Bound, ConsistencyError, LockError, LogTable, ReadConsistency, TableConfig, TransactionError, ValidationError, WriteDurability
from tests.conftest import rows

INST = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("data", T.BinaryType())])


def make(spark, tmp_path, **kw):
    return LogTable.open(spark, TableConfig(str(tmp_path / "t"), kw.pop("schema", INST), "id", kw.pop("sks", ("name",)), **kw))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_last_write_wins_and_missing_key(spark, tmp_path):
    t = make(spark, tmp_path)
    assert t.get(0) is None and t.latest().count() == 0
    t.upsert((0, None, b"\x03\x04\x05"), (1, "Alice", b"a"), (1, "Bob", b"b"), (2, "George", b""))
    assert t.get(0).name is None and t.get(1).name == "Bob" and t.get(7) is None
    assert ids(t.find_by("name", None)) == [0]


def test_changed_secondary_key_no_longer_matches(spark, tmp_path):
    t = make(spark, tmp_path)
    t.upsert((1, "old", b""))
    t.upsert((1, "new", b""))
    assert ids(t.find_by("name", "old")) == [] and ids(t.find_by("name", "new")) == [1]


def test_deletes(spark, tmp_path):
    t = make(spark, tmp_path)
    t.upsert((0, "John", b""), (1, "John", b""), (2, "Bob", b""))
    assert t.delete(0).name == "John" and t.delete(0) is None
    assert ids(t.find_by("name", "John")) == [1]
    back = t.delete_by("name", "John")
    assert ids(back) == [1] and ids(t.latest()) == [2]
    assert t.delete_by("name", "nobody").count() == 0


def test_repeated_upserts_then_delete_by_secondary_key(spark, tmp_path):
    t = make(spark, tmp_path)
    t.upsert(*[(0, "foo", b"")] * 10)
    t.delete_by("name", "foo")
    assert t.find_by("name", "foo").count() == 0 and t.find_by("id", 0).count() == 0


def test_ranges_batches_and_paging(spark, tmp_path):
    t = make(spark, tmp_path)
    t.upsert(*[(i, "foo", b"") for i in range(10)])
    r = lambda lo, hi, **kw: [x.id for x in t.range_by("id", lo, hi, **kw).collect()]
    assert sorted(r(Bound.included(3), Bound.excluded(7))) == [3, 4, 5, 6]
    assert sorted(r(Bound.unbounded(), Bound.included(7))) == list(range(8))
    assert r(Bound.included(2), Bound.excluded(8), offset=1, limit=3) == [3, 4, 5]
    assert r(Bound.included(2), Bound.excluded(8), offset=1, limit=3, sort_asc=False) == [6, 5, 4]
    assert r(Bound.unbounded(), Bound.unbounded(), offset=50, limit=3) == [] and len(r(Bound.unbounded(), Bound.unbounded(), offset=4)) == 6
    assert [x.id for x in t.find_by("name", "foo", offset=2, limit=3).collect()] == [2, 3, 4]
    assert [(x.tag, x.id) for x in t.batch_find_by("id", [2, 3, 4], offset=1, limit=2).collect()] == [(1, 3), (2, 4)]
    assert sorted((x.tag, x.id) for x in t.batch_find_by("id", [2, 2, 99]).collect()) == [(0, 2), (1, 2)]
    with pytest.raises(ValidationError):
        r(Bound.included(7), Bound.included(3))
    with pytest.raises(ValidationError):
        t.find_by("name", "foo", offset=-1)


def test_presentation_in_log_order(spark, tmp_path):
    t = make(spark, tmp_path)
    t.upsert((3, "x", b""), (1, "x", b""), (2, "x", b""))
    assert [r.id for r in t.find_by("name", "x", limit=2, order="log", with_position=True).collect()] == [1, 2]
    assert [r.id for r in t.find_by("name", "x", order="log", with_position=True).collect()] == [3, 1, 2]


def test_rejections(spark, tmp_path):
    t = make(spark, tmp_path)
    t.upsert((1, "a", b"x"))
    with pytest.raises(ValidationError):
        t.find_by("data", "x")
    with pytest.raises(ValidationError):
        t.find_by("id", b"x")
    with pytest.raises(ValidationError):
        t.find_by("nothing", 1)
    assert ids(t.find_by("id", "1")) == []
    with pytest.raises(ValidationError):
        t.upsert(("1", "a", b""))
    with pytest.raises(ValidationError):
        t.upsert((1, "a"))
    with pytest.raises(ValidationError):
        t.upsert({"id": 1, "nam": "x"})
    with pytest.raises(ValidationError):
        t.upsert_df(spark.createDataFrame([(1, "a", b""), (1, "b", b"")], INST))
    assert t.latest().count() == 1  # nothing of the above was written
    for bad in (dict(primary_key=None), dict(primary_key="x"), dict(primary_key="data"), dict(secondary_keys=("zz",)), dict(schema=None)):
        with pytest.raises(ValidationError):
            replace(t.config, **bad).validate()


def test_scan_of_an_unindexed_field_must_be_asked_for(spark, tmp_path):
    t = make(spark, tmp_path, sks=())
    t.upsert((1, "a", b""))
    with pytest.raises(ValidationError):
        t.find_by("name", "a")
    assert ids(t.find_by("name", "a", allow_scan=True)) == [1]


def test_decimal_keys(spark, tmp_path):
    t = make(spark, tmp_path, schema=T.StructType.fromDDL("id decimal(10,2), name string"))
    t.upsert((Decimal("1.50"), "a"), (Decimal("2.25"), "b"), (None, "n"))
    assert t.get(Decimal("1.5")).name == "a" and t.get(None).name == "n" and t.get(Decimal("1.505")) is None
    assert ids(t.range_by("id", Bound.included(Decimal("1.6")), Bound.unbounded())) == [Decimal("2.25")]
    assert [r.name for r in t.batch_find_by("id", [Decimal("2.25"), None, Decimal("1.234")], sort=True).collect()] == ["b", "n"]
    with pytest.raises(ValidationError):
        t.upsert((Decimal("1.234"), "x"))


def test_transactions(spark, tmp_path):
    t = make(spark, tmp_path)
    t.tx_begin()
    with pytest.raises(TransactionError):
        t.tx_begin()
    t.upsert((0, "John", b""), (1, "John", b""))
    assert t.latest().count() == 0  # no reads of own writes
    assert t.delete_by("name", "John").count() == 0
    t.tx_commit()
    assert ids(t.find_by("name", "John")) == [0, 1]
    t.tx_begin()
    t.delete_by("name", "John")
    t.tx_rollback()
    assert ids(t.find_by("name", "John")) == [0, 1]
    for call in (t.tx_commit, t.tx_rollback):
        with pytest.raises(TransactionError):
            call()
    with pytest.raises(RuntimeError), t.transaction():
        t.upsert((9, "x", b""))
        raise RuntimeError
    assert t.get(9) is None and not t._lock.held


def test_crash_before_the_swap_leaves_the_old_version(spark, tmp_path, monkeypatch):
    t = make(spark, tmp_path)
    t.upsert((1, "a", b""))
    monkeypatch.setattr(t._store, "publish", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        t.upsert((2, "b", b""))
    monkeypatch.undo()
    again = LogTable.open(spark, t.config)
    assert ids(again.latest()) == [1]
    again.upsert((3, "c", b""))
    assert ids(t.latest()) == [1, 3]


def test_consistency_modes(spark, tmp_path):
    w = make(spark, tmp_path)
    strong = LogTable.open(spark, w.config)
    pinned = LogTable.open(spark, replace(w.config, read_consistency=ReadConsistency.EVENTUAL))
    w.upsert((1, "a", b""))
    assert ids(strong.latest()) == [1] and ids(pinned.latest()) == []
    pinned.refresh()
    assert ids(pinned.latest()) == [1]
    pinned.upsert((2, "b", b""))  # own commits are visible
    assert ids(pinned.latest()) == [1, 2]


def test_rotation_compaction_and_vacuum(spark, tmp_path):
    t = make(spark, tmp_path, segment_rows=5, write_durability=WriteDurability.FLUSH_SYNC)
    t.upsert(*[(0, f"v{i}", b"") for i in range(4)])
    assert not t.maintain()
    t.upsert((1, "x", b""))
    assert t.maintain()
    m = t._manifest()
    assert [s.number for s in m.segments] == [1, 2] and m.segments[0].rows == 2
    t.upsert((2, "y", b""))
    t.delete(0)
    before = t.latest()
    t.rotate_and_compact()  # segment 2 alone: its tombstone must go on hiding segment 1
    assert ids(t.latest()) == [1, 2] and ids(before) == [1, 2]
    assert t.log().where("_tombstone").count() == 1
    t.compact_all()
    assert t.log().count() == 2 and ids(t.latest()) == [1, 2]
    assert t.vacuum() and ids(LogTable.open(spark, t.config).latest()) == [1, 2]
    t.upsert((1, "z", b""))
    assert t.get(1).name == "z"


def test_offset_scan_reads_later_segments_only(spark, tmp_path):
    t = make(spark, tmp_path, segment_rows=1)
    t.upsert((1, "a", b""))
    t.maintain()
    t.upsert((2, "b", b""))
    assert ids(t.log(from_seg=2)) == [2] and ids(t.log()) == [1, 2]
    assert len(t.log(from_seg=2).inputFiles()) < len(t.log().inputFiles())


def test_trailing_nullable_field(spark, tmp_path):
    t = make(spark, tmp_path)
    t.upsert((0, "John", b""))
    wide = replace(t.config, schema=T.StructType.fromDDL("id bigint, name string, data binary, maybe_str string"))
    u = LogTable.open(spark, wide)
    u.upsert((1, "John", b"", "new"))
    assert rows(u.find_by("name", "John").select("id", "maybe_str")) == [(0, None), (1, "new")]
    t.rotate_and_compact()  # a narrow client must not lose the field
    assert u.get(1).maybe_str == "new"
    with pytest.raises(ValidationError):
        LogTable.open(spark, replace(t.config, schema=T.StructType.fromDDL("id string, name string")))


def test_foreign_directories_are_refused(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "precious.txt").write_text("x")
    with pytest.raises(ValidationError):
        make(spark, tmp_path)
    assert (tmp_path / "t" / "precious.txt").exists()


def test_unknown_format_version(spark, tmp_path):
    t = make(spark, tmp_path)
    p = os.path.join(t.config.data_dir, "manifest", "v00000000.json")
    m = json.load(open(p))
    json.dump({**m, "format_version": 9}, open(p, "w"))
    with pytest.raises(ValidationError):
        LogTable.open(spark, t.config)
    open(os.path.join(t.config.data_dir, "CURRENT"), "w").write("junk")
    with pytest.raises(ConsistencyError):
        LogTable.open(spark, t.config)


def test_concurrent_writers(spark, tmp_path):
    t = make(spark, tmp_path, lock_timeout_s=60.0)
    errors = []

    def write(i):
        try:
            LogTable.open(spark, t.config).upsert((i, "w", b""))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not errors and ids(t.latest()) == list(range(6))


def test_lock_misuse_and_timeout(spark, tmp_path):
    t = make(spark, tmp_path, lock_timeout_s=0.05)
    other = LogTable.open(spark, t.config)
    t.tx_begin()
    with pytest.raises(LockError):
        other.upsert((1, "a", b""))
    with pytest.raises(LockError):
        t._lock.acquire()
    t.tx_rollback()
    with pytest.raises(LockError):
        t._lock.release()


def test_bulk_upserts_keep_their_order(spark, tmp_path):
    t = make(spark, tmp_path)
    df = spark.range(2000).select((F.col("id") % 50).alias("id"), F.col("id").cast("string").alias("name"), F.lit(b"").alias("data"), F.col("id").alias("at"))
    t.upsert_df(df.repartition(7), order_by=["at"])
    assert rows(t.latest().select("id", "name")) == sorted([(i, str(1950 + i)) for i in range(50)], key=lambda r: tuple((False, str(x)) for x in r))


def test_pushdown_of_key_predicates(spark, tmp_path):
    t = make(spark, tmp_path)
    t.upsert((1, "a", b""))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,1)" in plan(t.find_by("id", 1)) and "In(id" in plan(t.batch_find_by("id", [1, 2]))
    assert "EqualTo(name" not in plan(t.find_by("name", "a"))
    assert "WindowGroupLimit" in plan(t.latest())


def test_builder_and_record_hooks(spark, tmp_path):
    t = (
        LogTable.configure(spark).data_dir(tmp_path / "b").fields("id bigint, name string").primary_key("id").secondary_keys("name").segment_rows(10).lock_timeout(1.0)
        .read_consistency(ReadConsistency.STRONG).write_durability(WriteDurability.FLUSH).records(lambda o: (o["key"], o["label"]), lambda r: {"key": r.id, "label": r.name}).initialize()
    )
    t.upsert({"key": 1, "label": "a"})
    assert t.get(1) == {"key": 1, "label": "a"} == t.delete(1) and t.get(1) is None


def test_a_compacted_table_is_read_without_a_window(spark, tmp_path):
    t = LogTable.configure(spark).data_dir(str(tmp_path / "t")).fields("id bigint, name string").primary_key("id").secondary_keys("name").initialize()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    t.upsert_df(spark.range(1000).selectExpr("id", "cast(id % 7 AS string) AS name"))
    t.upsert((3, "new"))
    t.delete(4)
    assert "Window" in plan(t.find_by("id", 3))
    t.compact_all()
    p = plan(t.find_by("id", 3))
    assert "Window" not in p and "Exchange" not in p and "EqualTo(id,3)" in p
    assert t.get(3).name == "new" and t.get(4) is None and t.latest().count() == 999
    t.upsert((3, "newer"))
    assert t.get(3).name == "newer"


def test_fetch_by_position(spark, tmp_path):
    t = LogTable.configure(spark).data_dir(str(tmp_path / "t")).fields("id bigint, name string").primary_key("id").initialize()
    t.upsert((1, "a"), (1, "b"), (2, "c"))
    t.delete(2)
    at = [(r[0], r[1]) for r in t.log().orderBy("_seg", "_idx").collect()]
    got = t.fetch([at[0], at[3], (9, 9), at[0]]).orderBy("tag").collect()
    assert [(r.tag, r.id, r.name, r._tombstone) for r in got] == [(0, 1, "a", False), (1, 2, "c", True), (3, 1, "a", False)]
    assert t.fetch([]).count() == 0


def test_too_many_rows_in_a_task_are_refused(spark, tmp_path, monkeypatch):
    from ledgerloom import table as table_module
    from ledgerloom.errors import StorageError

    t = LogTable.configure(spark).data_dir(str(tmp_path / "t")).fields("id bigint").primary_key("id").initialize()
    monkeypatch.setattr(table_module, "TASK_BITS", 3)
    with pytest.raises(StorageError):
        t.upsert_df(spark.range(100).coalesce(1))
    assert t.latest().count() == 0
    monkeypatch.setattr(table_module, "TASK_BITS", 46)
    with pytest.raises(StorageError):
        t.upsert_df(spark.range(100).repartition(8))


def test_an_offset_without_a_limit_keeps_its_partitions(spark):
    from ledgerloom.operators import state

    df = spark.range(500).selectExpr("nullif(id, 0) AS id", "id % 3 AS g").repartition(4)
    v = state.LogView(df, "id", ("g",), unique=True)
    for asc in (True, False):
        got = state.find_by(v, "g", 0, offset=20, sort_asc=asc)
        assert "CollectLimit" not in got._jdf.queryExecution().executedPlan().toString()
        want = sorted((i for i in range(0, 500, 3)), reverse=not asc)[20:]
        assert [r.id or 0 for r in got.collect()] == want
    assert state.find_by(v, "g", 0, offset=999).count() == 0


def test_a_delete_and_an_upsert_at_once(spark, tmp_path):
    """The row written while a delete is under way survives it or is deleted as seen; it is never killed unseen."""
    import threading

    make = lambda: LogTable.configure(spark).data_dir(str(tmp_path / "t")).fields("id bigint, name string").primary_key("id").secondary_keys("name").initialize()
    a, b = make(), make()
    a._lock.timeout_s = b._lock.timeout_s = 60
    a.upsert((1, "old"))
    looked = threading.Event()
    find = a.find_by

    def slow(*args, **kw):
        out = find(*args, **kw)
        looked.set()
        threading.Event().wait(1.0)
        return out

    a.find_by = slow
    deleting = threading.Thread(target=lambda: a.delete_by("name", "old"))
    deleting.start()
    looked.wait()
    b.upsert((1, "new"))  # waits for the lock
    deleting.join()
    assert make().get(1).name == "new"


def test_the_example_posts_and_shows(spark, tmp_path):
    import importlib.util
    import os

    spec = importlib.util.spec_from_file_location("chat_log", os.path.join(os.path.dirname(os.path.dirname(__file__)), "examples", "chat_log.py"))
    chat = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(chat)
    log = chat.open_log(spark, str(tmp_path / "chat"))
    chat.post(log, "ada", "hello", "there")
    assert {r.msg for r in chat.newest(log)} == {"hello", "there"} and len(chat.newest(log, 1)) == 1
