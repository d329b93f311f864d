"""Schema drift between the files of a feed.

Every file gets a profile per field: JSON type counts, a theta sketch of its values
and a few shape statistics.  Profiles of a file and the file written before it are
compared: equal names are paired, what is left on either side is matched as a
bipartite graph whose weights combine value overlap, shape and name similarity.
Sketches and counts are ordinary aggregates with a map-side combine, so the size of
a file or feed does not matter; only profiles, one row per (file, field), meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_letters

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.assignment import assign
from ledgerloom.sources.shared import written

TYPES = ("whole", "decimal", "string", "boolean", "array", "object")
FILE = ("feed_id", "file_id")
#: A pair of fields below this score is not a rename.
MIN_SCORE = 0.55
_MAX_WHOLE_DIGITS = 18
#: Parts into which the lines of a file are dealt.
DEALT = 32


def _type_of(schema: Column) -> Column:
    """Name in TYPES of a variant's schema string; NULL for JSON null."""
    digits = F.regexp_extract(schema, r"^DECIMAL\((\d+),0\)$", 1)
    return (
        F.when(schema == "BIGINT", "whole")
        .when((digits != "") & (digits.try_cast("int") > _MAX_WHOLE_DIGITS), "whole")
        .when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "decimal")
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
    )


def parse_lines(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, cells) of raw lines (feed_id, file_id, written_at, layout, line_no, payload).

    files: one row per (feed_id, file_id), read or not.  cells: feed_id, file_id,
    line_no, field, type, value (text); one row per field that a readable line holds,
    and for layout ``values`` one row with line_no 0 per field that the header names.
    Lines delivered again count once.  Unreadable lines, lines of the wrong JSON kind
    and values beyond the header hold nothing; a missing tail is NULL, which has no
    type.  Rows without feed_id or file_id are left out.  A field name given twice in
    one object makes the line unreadable.
    """
    base = files.select(*FILE, "written_at", "layout", F.col("line_no").cast("bigint").alias("line_no"), "payload").dropna(subset=[*FILE])
    versions = base.groupBy(*FILE).agg(F.min("written_at").alias("written_at"), F.min("layout").alias("layout"))
    lines = base.groupBy(*FILE, "line_no").agg(F.min_by("payload", F.xxhash64("payload")).alias("payload"), F.min("layout").alias("layout"))
    # the header of a file: one short array, joined to its lines before they are taken apart;
    # the lines of a file are dealt out, so that those of a hot one do not meet
    deal = F.pmod(F.coalesce("line_no", F.lit(0)), F.lit(DEALT)).cast("int")
    names = F.from_json("payload", "array<string>")
    names = F.transform(names, lambda x, i: F.when(F.array_position(names, x) == i + 1, x)).alias("__names")
    header = lines.where("layout = 'values' AND line_no = 0").select(*FILE, names, F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("__deal"))
    lines = lines.withColumn("__deal", deal).join(header, [*FILE, "__deal"], "left")
    cell = "pos, key, schema_of_variant(value) AS s, CAST(try_variant_get(value, '$', 'string') AS string) AS value"
    exploded = files.sparkSession.sql(f"SELECT feed_id, file_id, line_no, layout, __names, {cell} FROM {{lines}}, LATERAL variant_explode(__v)", lines=lines.withColumn("__v", F.try_parse_json("payload")))
    # an object names its fields; positions are named by the header, which stands for itself without a value
    of_object = (F.col("layout") == "object") & F.col("key").isNotNull()
    of_header = (F.col("layout") == "values") & F.col("key").isNull()
    field = F.when(of_object, F.col("key")).when(of_header, F.get("__names", F.col("pos")))
    cells = exploded.withColumn("field", field).where("field IS NOT NULL")
    said = F.when((F.col("layout") == "object") | (F.col("line_no") > 0), True)
    return versions, cells.select(*FILE, "line_no", "field", F.when(said, _type_of(F.col("s"))).alias("type"), F.when(said, F.col("value")).alias("value"))


def profiles(cells: DataFrame) -> DataFrame:
    """One row per (feed_id, file_id, field): type, n, sketch and shape statistics.

    type is that of most non-NULL values (ties: the order of TYPES), NULL if there
    are none; sketch and shape cover the values of that type and of every other.
    """
    v = F.col("value")
    size = lambda chars: F.length(v) - F.length(F.translate(v, chars, ""))
    g = cells.groupBy(*FILE, "field").agg(
        *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in TYPES],
        F.count("type").alias("n"),
        F.theta_sketch_agg(F.when(F.col("type").isNotNull(), v)).alias("sketch"),
        F.avg(F.length(v)).alias("f_len"),
        F.avg(size("0123456789") / F.greatest(F.length(v), F.lit(1))).alias("f_digit"),
        F.avg(size(ascii_letters) / F.greatest(F.length(v), F.lit(1))).alias("f_alpha"),
        F.avg(size(" ,.#-") / F.greatest(F.length(v), F.lit(1))).alias("f_punct"),
        F.avg(F.when(F.col("type").isin("whole", "decimal"), F.log1p(F.abs(v.try_cast("double"))))).alias("f_size"),
    )
    top = F.greatest(*[F.col(f"n_{t}") for t in TYPES])
    kind = F.coalesce(*[F.when((F.col(f"n_{t}") == top) & (top > 0), F.lit(t)) for t in TYPES])
    return g.withColumn("type", kind).drop(*[f"n_{t}" for t in TYPES])


def consecutive(versions: DataFrame) -> DataFrame:
    """(feed_id, file_id, prev_id): each file and the one written just before it (ties by file_id)."""
    w = Window.partitionBy("feed_id").orderBy("written_at", "file_id")
    return versions.withColumn("prev_id", F.lag("file_id").over(w)).where("prev_id IS NOT NULL").select(*FILE, "prev_id")


def similarity(x: Column, y: Column) -> Column:
    """Score in [0, 1] of two profiles (structs); 0 across types.

    Value overlap counts most: it is the share of the smaller value set that both hold.
    Without overlap, agreeing shapes and names alone stay below MIN_SCORE.  The two
    values of a boolean say nothing, so there shape (the share of true) and name decide.
    """
    both = F.theta_sketch_estimate(F.theta_intersection(x["sketch"], y["sketch"])).cast("double")
    least = F.least(F.theta_sketch_estimate(x["sketch"]), F.theta_sketch_estimate(y["sketch"])).cast("double")
    overlap = both / F.greatest(least, F.lit(1.0))
    gap = lambda n, scale: F.least(F.lit(1.0), F.abs(x[n] - y[n]) / scale)
    far = (gap("f_len", 10.0) + gap("f_digit", 0.5) + gap("f_alpha", 0.5) + gap("f_punct", 0.2)) / 4
    shape = 1 - F.coalesce(F.greatest(far, gap("f_size", 3.0)), far)
    a, b = (F.lower(F.regexp_replace(z["field"], "[^A-Za-z0-9]", "")) for z in (x, y))
    name = F.when(a.contains(b) | b.contains(a), 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))
    # a tenth of shared values may be chance, most of all among whole numbers; two fifths are as good as all
    score = F.when(x["type"] == "boolean", 0.45 + 0.35 * shape + 0.2 * name).otherwise(0.75 * F.least(F.lit(1.0), overlap / 0.4) + 0.15 * shape + 0.1 * name)
    return F.when(x["type"] == y["type"], F.coalesce(score, F.lit(0.0))).otherwise(0.0)


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Solve the matching of each file pair and list its changes."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            left, right = sorted({p["before"] for p in r["scored"]}), sorted({p["after"] for p in r["scored"]})
            scores = [[0.0] * len(right) for _ in left]
            for p in r["scored"]:
                scores[left.index(p["before"])][right.index(p["after"])] = p["score"]
            renamed = {left[i]: right[j] for i, j in enumerate(assign(scores)) if j >= 0}
            taken = set(renamed.values())
            rows = [("renamed", x, y) for x, y in renamed.items()] + [("retyped", x, x) for x in r["retyped"]]
            rows += [("removed", x, "") for x in r["gone"] if x not in renamed] + [("added", "", y) for y in r["come"] if y not in taken]
            out += [(r["feed_id"], r["file_id"], r["prev_id"], *row) for row in rows]
        if out:
            names = [*FILE, "prev_id", "drift", "field_before", "field_after"]
            types = [b.schema.field(c).type for c in (*FILE, "prev_id")] + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def changes(versions: DataFrame, profile: DataFrame) -> DataFrame:
    """(feed_id, file_id, prev_id, drift, field_before, field_after), one row per change.

    drift is added, removed, renamed or retyped; the missing side is ''.  The first
    file of a feed has no changes.  A field whose type is unknown on one side (all
    NULL) is neither renamed nor retyped.
    """
    # one row per file: as many profiles as the file has fields
    fields = profile.groupBy(*FILE).agg(F.collect_list(F.struct(*[c for c in profile.columns if c not in FILE])).alias("fields"))
    none = F.slice(F.array(F.lit(None).cast(fields.schema["fields"].dataType.elementType)), 1, 0)
    side = lambda key, name: fields.select("feed_id", F.col("file_id").alias(key), F.col("fields").alias(name))
    pairs = consecutive(versions).join(side("prev_id", "before"), ["feed_id", "prev_id"], "left").join(side("file_id", "after"), ["feed_id", "file_id"], "left")
    pairs = pairs.withColumns({"before": F.coalesce("before", none), "after": F.coalesce("after", none)})
    has = lambda fs, x: F.exists(fs, lambda y: y["field"] == x["field"])
    pairs = pairs.withColumns(
        {
            "gone": F.filter("before", lambda x: ~has(F.col("after"), x)),
            "come": F.filter("after", lambda x: ~has(F.col("before"), x)),
            "retyped": F.filter("before", lambda x: F.exists("after", lambda y: (y["field"] == x["field"]) & (y["type"] != x["type"]))),
        }
    ).drop("before", "after")
    scored = F.transform("gone", lambda x: F.transform(F.filter("come", lambda y: y["type"] == x["type"]), lambda y: F.struct(x["field"].alias("before"), y["field"].alias("after"), similarity(x, y).alias("score"))))
    names = lambda fs: F.transform(fs, lambda x: x["field"]).alias(fs)
    pairs = pairs.withColumn("scored", F.filter(F.flatten(scored), lambda p: p["score"] >= MIN_SCORE))
    pairs = pairs.select(*FILE, "prev_id", names("gone"), names("come"), names("retyped"), "scored")
    ids = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in (*FILE, "prev_id"))
    return pairs.where("size(gone) + size(come) + size(retyped) > 0").mapInArrow(_changes, f"{ids}, drift string, field_before string, field_after string")


def drift_report(files: DataFrame) -> DataFrame:
    """Every change of every file against the file of its feed written just before it."""
    versions, cells = parse_lines(files)
    # the profiles are read twice, as a file's own and as the next one's: written, not computed, twice
    return changes(versions, written(profiles(cells), "profiles"))


def lifetimes(versions: DataFrame, cells: DataFrame, report: DataFrame) -> DataFrame:
    """(feed_id, file_id, field, canonical): the oldest name of each field along its renames."""
    w = Window.partitionBy("feed_id").orderBy("written_at", "file_id")
    ordinal = versions.select(*FILE, F.row_number().over(w).alias("ord"))
    present = cells.select(*FILE, "field").distinct().join(ordinal, list(FILE))
    starts = report.where("drift = 'renamed'").select(*FILE, F.col("field_after").alias("field"), F.col("field_before").alias("came_from"))
    along = Window.partitionBy("feed_id", "field").orderBy("ord")
    # a lifetime: files in a row that hold a field under one name
    life = present.join(starts, [*FILE, "field"], "left")
    life = life.withColumn("new", F.coalesce(F.col("ord") - F.lag("ord").over(along) != 1, F.lit(True)) | F.col("came_from").isNotNull())
    life = life.withColumn("start", F.max(F.when(F.col("new"), F.col("ord"))).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    edges = life.where("came_from IS NOT NULL").select("feed_id", F.col("field").alias("f"), F.col("start").alias("s"), "came_from", (F.col("ord") - 1).alias("at"))
    parents = edges.join(life.select("feed_id", F.col("field").alias("came_from"), F.col("ord").alias("at"), F.col("start").alias("ps")), ["feed_id", "came_from", "at"]).select("feed_id", "f", "s", F.col("came_from").alias("pf"), "ps")
    roots = life.groupBy("feed_id", F.col("field").alias("f"), F.col("start").alias("s")).agg(F.lit(1).alias("one")).drop("one").join(parents, ["feed_id", "f", "s"], "left")
    roots = roots.select("feed_id", "f", "s", F.coalesce("pf", "f").alias("rf"), F.coalesce("ps", "s").alias("rs"))
    roots = written(roots, "roots")
    while True:  # pointer doubling: the number of rounds is the log of the longest chain of renames
        up = roots.select("feed_id", F.col("f").alias("rf"), F.col("s").alias("rs"), F.col("rf").alias("rf2"), F.col("rs").alias("rs2"))
        step = roots.join(up, ["feed_id", "rf", "rs"]).select("feed_id", "f", "s", "rf", "rs", "rf2", "rs2")
        step = written(step, "roots")
        moved = not step.where("rf <> rf2 OR rs <> rs2").isEmpty()
        roots = step.select("feed_id", "f", "s", F.col("rf2").alias("rf"), F.col("rs2").alias("rs"))
        if not moved:
            break
    return life.select(*FILE, "field", F.col("start").alias("s")).join(roots.withColumnRenamed("f", "field"), ["feed_id", "field", "s"]).select(*FILE, "field", F.col("rf").alias("canonical"))


def unify(files: DataFrame) -> DataFrame:
    """All readable records in one table: feed_id, file_id, line_no, fields.

    fields maps the canonical name (the oldest along the renames of the feed) to the
    value as JSON text; NULL values and missing fields are absent.
    """
    versions, cells = parse_lines(files)
    cells = written(cells, "cells")
    report = written(changes(versions, written(profiles(cells), "profiles")), "report")
    names = lifetimes(versions, cells, report)
    body = cells.join(versions.select(*FILE, "layout"), list(FILE)).where("layout = 'object' OR line_no > 0")
    body = body.join(names, [*FILE, "field"])
    present = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("canonical", "value")))))
    return body.groupBy(*FILE, "line_no").agg(present.alias("fields"))
