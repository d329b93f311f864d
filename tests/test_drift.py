import datetime as dt
import itertools
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.functions.assignment import assign
from ledgerloom.operators import drift
from tests.conftest import rows

DDL = "feed_id bigint, file_id bigint, written_at timestamp_ntz, arrived_at timestamp_ntz, layout string, line_no int, payload string, field string, type string"


@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_assignment_is_optimal(n, m, rng):
    s = [[rng.choice([0.0, rng.random()]) for _ in range(m)] for _ in range(n)]
    got = assign(s)
    assert len({j for j in got if j >= 0}) == sum(j >= 0 for j in got)
    best = max(sum(s[i][j] for i, j in zip(p, q)) for k in range(min(n, m) + 1) for p in itertools.combinations(range(n), k) for q in itertools.permutations(range(m), k))
    assert abs(sum(s[i][j] for i, j in enumerate(got) if j >= 0) - best) < 1e-9


def test_assignment_edges():
    assert assign([]) == [] and assign([[]]) == [-1] and assign([[0.0]]) == [-1]


def lines(file_id, day, records, layout="object", feed=1, shuffle=None):
    w = dt.datetime(2021, 1, day)
    if layout == "object":
        body = [json.dumps(r) for r in records]
    else:
        head = list(records[0])
        body = [json.dumps(head), *[json.dumps([r.get(h) for h in head]) for r in records]]
    return [(feed, file_id, w, w, layout, i, p, "clash", "clash") for i, p in enumerate(body)]


def recs(n, seed=1, **fields):
    rng = random.Random(seed)
    return [{k: f(i, rng) for k, f in fields.items()} for i in range(n)]


ID, NAME, WEIGHT = (lambda i, r: 1000 + i), (lambda i, r: f"Birch-{i}"), (lambda i, r: i + 0.25)


def report(spark, data):
    return rows(drift.drift_report(spark.createDataFrame(data, DDL)).select("file_id", "drift", "field_before", "field_after"))


def test_every_kind_of_change(spark):
    d = lines(30, 1, recs(20, id=ID, name=NAME, weight=WEIGHT))
    d += lines(10, 2, recs(20, ID=ID, name=NAME, weight=WEIGHT), "values")  # renamed, other layout
    d += lines(20, 3, recs(20, name=NAME, ID=lambda i, r: str(1000 + i), weight=lambda i, r: i))  # two retyped, other order
    d += lines(40, 4, recs(20, name=NAME, ID=lambda i, r: str(1000 + i), note=lambda i, r: f"see log, bay {i}"))
    assert report(spark, d) == [(10, "renamed", "id", "ID"), (20, "retyped", "ID", "ID"), (20, "retyped", "weight", "weight"), (40, "added", "", "note"), (40, "removed", "weight", "")]
    # delivered again, in another order: the same
    assert report(spark, d[::-1] + d) == report(spark, d)


def test_dirty_lines(spark):
    d = lines(1, 1, recs(10, id=ID, name=NAME)) + lines(2, 2, recs(10, id=ID, name=NAME))
    w = dt.datetime(2021, 1, 2)
    for i, p in enumerate(['{"id": 5, "na', None, "", "[1, 2]", "7", "null", '{"id": 1, "id": 2}'], 50):
        d.append((1, 2, w, w, "object", i, p, "", ""))
    d += [(None, 2, w, w, "object", 1, "{}", "", ""), (1, None, w, w, "object", 1, "{}", "", "")]
    assert report(spark, d) == []
    # a file of which nothing can be read has no fields
    d.append((1, 3, dt.datetime(2021, 1, 3), w, "object", 0, "{", "", ""))
    assert report(spark, d) == [(3, "removed", "id", ""), (3, "removed", "name", "")]


def test_missing_tail_nulls_and_stray_values(spark):
    w = dt.datetime(2021, 1, 2)
    d = lines(1, 1, recs(6, id=ID, name=NAME, weight=WEIGHT), "values")
    d += [(1, 2, w, w, "values", 0, '["id", "name", "weight"]', "", ""), (1, 2, w, w, "values", 1, '[1]', "", ""), (1, 2, w, w, "values", 2, '[2, "Birch-1", null, 9]', "", ""), (1, 2, w, w, "values", 3, '["?", "Birch-2"]', "", "")]
    assert report(spark, d) == []


def test_json_types(spark):
    cells = drift.parse_lines(spark.createDataFrame(lines(1, 1, [{"a": 1, "b": 1.5, "c": "x", "d": True, "e": [1], "f": None, "g": {"h": 1}, "i": 2.0, "j": 12345678901234567890123}]), DDL))[1]
    assert {r.field: r.type for r in cells.collect()} == {"a": "whole", "b": "decimal", "c": "string", "d": "boolean", "e": "array", "f": None, "g": "object", "i": "decimal", "j": "whole"}


def test_unify_follows_renames(spark):
    d = lines(1, 1, recs(12, id=ID, name=NAME)) + lines(2, 2, recs(12, key=ID, name=NAME), "values") + lines(3, 3, recs(12, ident=ID, name=NAME))
    out = drift.unify(spark.createDataFrame(d, DDL)).collect()
    assert len(out) == 36 and all(set(r.fields) == {"id", "name"} for r in out)


def test_empty(spark):
    df = spark.createDataFrame([], DDL)
    assert drift.drift_report(df).count() == 0 and drift.unify(df).count() == 0
