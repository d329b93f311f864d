"""Incremental processing by Merkle trees over key-range hashes.

A tree covers the records of a partition (a database).  A leaf is a range of
``2**LEAF_BITS`` neighbouring keys; each level above groups ranges, the root covers
the partition.  The digest of a node is the XOR of the hashes of its contents
together with their number.

:class:`MerkleTail` keeps the tree of the last successful run.  A run builds the
digests of its own snapshot, compares the two trees from the root downwards, reads
only the leaves it arrives at, and publishes its output together with its tree in one
compare-and-swap.  A run sees either one snapshot (:meth:`MerkleTail.refresh`) or, to
work off a history of runs, the snapshot at the start of each
(:meth:`MerkleTail.backfill`); both go through the same comparison.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.errors import ConsistencyError, ValidationError
from ledgerloom.sources.shared import SharedFolder

LEAF_BITS = 8
#: Bits of a key below each level, from the leaves upwards; the root is above the last.
LEVEL_BITS = (LEAF_BITS, 18, 48)
LEVELS = len(LEVEL_BITS) + 1
#: Folders into which saved contents are divided; those of unchanged key ranges are not opened.
BUCKETS = 32
#: Published versions after which the saved state is merged into one.
MERGE_AFTER = 8


def node_of(key: Column, level: int) -> Column:
    return F.shiftright(key, LEVEL_BITS[level])


def parent_of(node: Column, level: int) -> Column:
    """Node of the level above; the root is node 0 of level len(LEVEL_BITS)."""
    return F.shiftright(node, LEVEL_BITS[level + 1] - LEVEL_BITS[level]) if level + 1 < len(LEVEL_BITS) else F.lit(0).cast("bigint")


def _null_safe(left: DataFrame, right: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """Semi- or anti-join on columns of which NULL equals NULL."""
    right = right.select(*[F.col(c).alias(f"__r_{c}") for c in by])
    return left.join(right, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in by], how)


def _together(*jobs: Callable[[], object]) -> list:
    """Run independent Spark jobs side by side."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def _observed(count: Observation) -> int:
    try:
        return count.get["n"]
    except Py4JJavaError:  # nothing observed: the input was empty and planned away
        return 0


def tree(leaves: DataFrame, by: Sequence[str]) -> DataFrame:
    """All levels, (by, __level, __node, __digest, __n), of leaf rows (by, __node, __digest, __n)."""
    nodes, path = F.col("__node"), []
    for level in range(LEVELS):
        path.append(F.struct(F.lit(level).alias("level"), nodes.alias("node")))
        nodes = parent_of(nodes, level) if level + 1 < LEVELS else nodes
    spread = leaves.select(*by, F.explode(F.array(*path)).alias("__at"), "__digest", "__n")
    return spread.groupBy(*by, F.col("__at.level").alias("__level"), F.col("__at.node").alias("__node")).agg(F.bit_xor("__digest").alias("__digest"), F.sum("__n").alias("__n"))


class MerkleTail:
    """Hands each run the records added or changed since the last published run.

    State lives in ``root``, a folder all executors share.  A version holds the output
    of its run, the digests of the nodes that changed and the contents of the changed
    leaves; a numbered manifest lists the versions.  The next number can be created
    once: a run that dies earlier leaves no trace, and of two runs at the same time the
    second to finish fails with ConsistencyError and publishes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, part: Sequence[str], key: str, columns: Sequence[str], *, order: str | None = None):
        self.spark, self.part, self.key, self.columns, self.order = spark, list(part), key, list(columns), order
        if clash := [c for c in (key, *part, *columns) if c.startswith("__")]:
            raise ValidationError(f"column names clash: {clash}")
        self.folder = SharedFolder(spark, root)
        #: Nodes compared at each level by the last run, root first.
        self.compared: list[int] = []

    # -- published state -------------------------------------------------------------------

    def _published(self) -> tuple[int, list[str]]:
        """Number of the newest manifest and its versions, oldest first."""
        numbers = [n for n in self.folder.names() if n.startswith("manifest-")]
        if not numbers:
            return 0, []
        try:
            return int(numbers[-1].removeprefix("manifest-")), json.loads(self.folder.read(numbers[-1]))["versions"]
        except (ValueError, KeyError) as e:
            raise ConsistencyError(f"{numbers[-1]} is unreadable") from e

    def _publish(self, after: int, versions: Sequence[str]) -> None:
        if not self.folder.publish(f"manifest-{after + 1:010d}", json.dumps({"versions": list(versions)})):
            raise ConsistencyError("another run has published since this one began")

    def _read(self, version: str, what: str, schema: T.StructType | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read  # a given schema spares opening files
        return reader.parquet(self.folder.at(f"{version}/{what}"))

    def _write(self, df: DataFrame, version: str, what: str) -> DataFrame:
        df.write.parquet(self.folder.at(f"{version}/{what}"))
        return self._read(version, what, df.schema)

    def _stored(self, what: str, columns: str, fields: Sequence[T.StructField], versions: Sequence[str]) -> DataFrame | None:
        """One of the saved tables of all versions; __v is a version's place."""
        schema = T.StructType([*fields, *T.StructType.fromDDL(columns).fields])
        every = [self._read(v, what, schema).withColumn("__v", F.lit(i)) for i, v in enumerate(versions) if self.folder.exists(f"{v}/{what}")]
        return reduce(DataFrame.unionByName, every) if every else None

    def _write_contents(self, df: DataFrame, version: str) -> None:
        df = df.withColumn("__bucket", self._bucket()).hint("rebalance", "__bucket")
        df.write.partitionBy("__bucket").parquet(self.folder.at(f"{version}/contents"))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.part, parent_of(F.col("__node"), 0)), F.lit(BUCKETS)).cast("int")

    def _saved(self, versions: Sequence[str], level: int | None = None) -> DataFrame | None:
        """Newest state of each saved node: (part, __level, __node, __digest, __n, __v); __v is its version's place."""
        nodes = self._stored("changed", "__i int, __node bigint, __digest bigint, __n bigint, __level int", self._fields[:-1], versions)
        if nodes is None:
            return None
        if level is not None:
            nodes = nodes.where(F.col("__level") == level)
        last = F.max_by(F.struct("__digest", "__n", "__v"), F.struct("__v", "__i")).alias("__last")
        return nodes.groupBy(*self.part, "__level", "__node").agg(last).select(*self.part, "__level", "__node", "__last.*").where("__n > 0")

    def _held(self, versions: Sequence[str], leaves: DataFrame | None) -> DataFrame | None:
        """Saved contents (part, __node, key, __h) of some leaves, or of all of them.

        At most BUCKETS folder names are collected; other folders are not opened.
        """
        saved = self._saved(versions, 0)
        if saved is None:
            return None
        buckets = None
        if leaves is not None:
            buckets = [r[0] for r in leaves.select(self._bucket()).distinct().collect()]
            saved = _null_safe(saved, leaves, [*self.part, "__node"], "left_semi")
        fields = [*self._fields[:-1], T.StructField("__node", T.LongType()), self._fields[-1]]
        contents = self._stored("contents", "__h bigint, __bucket int", fields, versions)
        if buckets is not None:
            contents = contents.where(F.col("__bucket").isin(buckets))
        return _null_safe(contents, saved, [*self.part, "__node", "__v"], "left_semi").select(*self.part, "__node", self.key, "__h")

    # -- comparison ------------------------------------------------------------------------

    def _descend(self, current: DataFrame, saved: DataFrame, by: Sequence[str], version: str) -> DataFrame | None:
        """Compare two trees from the root downwards; (by, __node) of the differing leaves, None if there are none.

        A level is read only below nodes that differ.  Nodes on one side only differ.  The
        differing nodes, as they are now, are written: they are what the run saves.
        """
        frontier, self.compared = None, []
        cols = [*by, "__level", "__node", "__digest", "__n"]
        both = current.select(*cols, F.lit(True).alias("__now")).unionByName(saved.select(*cols, F.lit(False).alias("__now")))
        for level in reversed(range(LEVELS)):
            nodes = both.where(F.col("__level") == level)
            if frontier is not None:
                nodes = _null_safe(nodes.withColumn("__up", parent_of(F.col("__node"), level)), frontier, [*by, "__up"], "left_semi")
            seen, differ = Observation(), Observation()
            signed = F.when(F.col("__now"), F.col("__n")).otherwise(-F.col("__n"))
            diff = nodes.observe(seen, F.count(F.lit(1)).alias("n")).groupBy(*by, "__level", "__node").agg(
                F.bit_xor("__digest").alias("__x"), F.sum(signed).alias("__d"),
                F.coalesce(F.max(F.when(F.col("__now"), F.col("__digest"))), F.lit(0)).alias("__digest"),
                F.coalesce(F.max(F.when(F.col("__now"), F.col("__n"))), F.lit(0)).alias("__n"),
            )
            diff = diff.where("__x != 0 OR __d != 0").drop("__x", "__d").observe(differ, F.count(F.lit(1)).alias("n"))
            diff = self._write(diff.drop("__level"), version, f"changed/__level={level}")
            self.compared.append(_observed(seen))
            if not _observed(differ):
                return None
            frontier = diff.select(*by, F.col("__node").alias("__up"))
        return diff.select(*by, "__node")

    def _begin(self, rows: DataFrame | None = None) -> tuple[int, list[str], str]:
        if rows is not None:
            self._fields = [T.StructField(c, rows.schema[c].dataType) for c in (*self.part, self.key)]
        return *self._published(), uuid.uuid4().hex

    # -- one run ---------------------------------------------------------------------------

    def refresh(self, snapshot: DataFrame, *, publish: bool = True) -> DataFrame:
        """Process a snapshot: rows (part, key, columns); rows delivered again count once.

        Rows with a NULL key are left out.  If a key has several contents, as in a log that
        keeps the old row beside the changed one, all of them are its state, and those that
        the last published state of the key lacks are handed out; with ``order`` only the
        content with the greatest order (then hash) is its state.  Keys that have left the
        snapshot are listed by :meth:`removed`; one that comes back is handed out again.
        Returns the rows of this run; with ``publish=False`` (a run that fails at the end)
        they are returned but not kept.
        """
        h = F.xxhash64(*self.part, self.key, *self.columns)
        rows = snapshot.where(F.col(self.key).isNotNull()).withColumn("__h", h).withColumn("__node", node_of(F.col(self.key), 0))
        ids = [*self.part, "__node", self.key]
        if self.order:
            newest = F.max_by("__h", F.struct(self.order, "__h")).alias("__h")
            narrow = rows.groupBy(*ids).agg(newest)
        else:
            narrow = rows.select(*ids, "__h").distinct()
        after, versions, version = self._begin(snapshot)
        by = [*self.part, "__i"]
        try:
            leaves = narrow.groupBy(*self.part, "__node").agg(F.bit_xor("__h").alias("__digest"), F.count(F.lit(1)).alias("__n"))
            current = self._write(tree(leaves.withColumn("__i", F.lit(0)), by), version, "tree")
            saved = self._saved(versions)
            saved = current.limit(0) if saved is None else saved.withColumn("__i", F.lit(0))
            changed = self._descend(current, saved, by, version)
            self.folder.remove(f"{version}/tree")
            if changed is None:
                self.folder.remove(version)
                return rows.select(*self.part, self.key, *self.columns).limit(0)
            near = [*self.part, "__node"]
            now = _null_safe(rows, changed, near, "left_semi")
            values = F.struct(*self.columns, "__h") if self.columns else F.struct("__h")
            if self.order:
                now = now.groupBy(*ids).agg(F.max_by(values, F.struct(self.order, "__h")).alias("__c"))
            else:
                now = now.groupBy(*ids, "__h").agg(F.first(values).alias("__c")).drop("__h")
            now = self._write(now.select(*ids, "__c.*"), version, "now")
            held = self._held(versions, changed)
            jobs = [lambda: self._write_contents(now.select(*ids, "__h"), version)]
            if held is None:
                jobs.append(lambda: self._write(now.drop("__h", "__node"), version, "output"))
            else:
                fresh = _null_safe(now, held, [*self.part, self.key, "__h"], "left_anti").drop("__h", "__node")
                gone = _null_safe(held.select(*self.part, self.key).distinct(), now, [*self.part, self.key], "left_anti")
                jobs += [lambda: self._write(fresh, version, "output"), lambda: self._write(gone, version, "removed")]
            _together(*jobs)
            self.folder.remove(f"{version}/now")
            if publish:
                self._publish(after, [*versions, version])
        except BaseException:
            self.folder.remove(version)
            raise
        if publish and len(versions) + 1 >= MERGE_AFTER:
            self._merge()
        return self._read(version, "output", rows.select(*self.part, self.key, *self.columns).schema)

    def removed(self) -> DataFrame | None:
        """(part, key) of the records that the newest version no longer saw; None if it had no predecessor."""
        _, versions = self._published()
        if not versions or not self.folder.exists(f"{versions[-1]}/removed"):
            return None
        return self._read(versions[-1], "removed")

    def _merge(self) -> None:
        """One version instead of many.  Outputs and old versions stay readable; a run in between wins."""
        after, versions, version = self._begin()
        saved = self._saved(versions)
        for level in range(LEVELS):
            self._write(saved.where(F.col("__level") == level).select(*self.part, F.lit(0).alias("__i"), "__node", "__digest", "__n"), version, f"changed/__level={level}")
        self._write_contents(self._held(versions, None), version)
        try:
            self._publish(after, [version])
        except ConsistencyError:
            self.folder.remove(version)

    # -- a history of runs -----------------------------------------------------------------

    def backfill(self, log: DataFrame, runs: DataFrame, seen_at: str, run_id: str, started_at: str) -> DataFrame:
        """(part, run_id, key) of the log entries that each successful run has to process.

        ``log`` is append-only: rows (part, key, columns, seen_at) of entries that do not
        change once written; an entry is visible from its earliest ``seen_at`` on, and
        should deliveries of it differ, the smallest hash stands for it.  ``runs`` are
        the successful runs (part, run_id, started_at) in any order.  The tree of a run
        covers what was visible at its start; it is compared with the tree of the run before
        it (by started_at, then run_id), that of the first one with the published state.
        Entries or runs with a NULL in one of these columns take no part.  The state after
        the last run of each part is published.

        The log is read and shuffled once for all runs, and a leaf of entries holds at most
        ``2**LEAF_BITS`` of them, so neither a hot part nor many deliveries of an entry
        meet in one task.
        """
        after, versions, version = self._begin(log)
        part, by = self.part, [*self.part, "__i"]
        log = log.dropna(subset=[*part, self.key, seen_at]).withColumn("__h", F.xxhash64(*part, self.key, *self.columns))
        entries = log.groupBy(*part, self.key).agg(F.min(seen_at).alias("__at"), F.min("__h").alias("__h"))
        runs = runs.select(*part, F.col(run_id).alias("__run"), F.col(started_at).alias("__start")).dropna().distinct()
        nothing = log.join(runs, part).select(*part, F.col("__run").alias(run_id), self.key).limit(0)
        w = Window.partitionBy(*part).orderBy("__start", "__run")
        runs = runs.select("*", (F.row_number().over(w) - 1).alias("__i"), F.lag("__start").over(w).alias("__before"), F.lead("__start").over(w).isNotNull().alias("__more"))
        try:
            leaves = entries.groupBy(*part, node_of(F.col(self.key), 0).alias("__node")).agg(F.collect_list(F.struct("__at", self.key, "__h")).alias("__es"))
            leaves, runs = _together(lambda: self._write(leaves, version, "leaves"), lambda: self._write(runs, version, "runs"))

            # the tree of every run; a part's runs are dealt out so that its leaves need not meet
            lists = runs.groupBy(*part).agg(F.sort_array(F.collect_list(F.struct("__i", "__start", "__more"))).alias("__runs"))
            lists = lists.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(15))))
            dealt = leaves.withColumn("__deal", F.pmod(F.xxhash64("__node"), F.lit(16)).cast("int")).join(lists, [*part, "__deal"])
            seen = lambda start: F.filter("__es", lambda e: e["__at"] <= start)
            xor = lambda es: F.aggregate(es, F.lit(0).cast("bigint"), lambda a, e: a.bitwiseXOR(e["__h"]))
            node_at = lambda r: F.struct(r["__i"].alias("__i"), r["__more"].alias("__more"), xor(seen(r["__start"])).alias("__digest"), F.size(seen(r["__start"])).cast("bigint").alias("__n"))
            states = dealt.select(*part, "__node", F.inline(F.transform("__runs", node_at))).where("__n > 0")
            current = self._write(tree(states, [*by, "__more"]), version, "tree")

            # each run's saved tree is that of the run before it
            saved = current.where("__more").withColumn("__i", F.col("__i") + 1).drop("__more")
            if (stored := self._saved(versions)) is not None:
                stored = stored.join(runs.select(*part).distinct(), part, "left_semi")
                saved = saved.unionByName(stored.withColumn("__i", F.lit(0)).select(*saved.columns))
            changed = self._descend(current, saved, by, version)
            if changed is None:
                self.folder.remove(version)
                return nothing

            # extract from the changed leaves what the run's tree holds and the saved one does not
            steps = changed.join(runs, [*part, "__i"]).join(leaves, [*part, "__node"])
            keys = lambda es: F.transform(es, lambda e: e[self.key])
            old = F.when(F.col("__before").isNotNull(), seen(F.col("__before"))).otherwise(F.slice("__es", 1, 0))
            rows = steps.select(*part, F.col("__run").alias(run_id), F.explode(F.array_except(keys(seen(F.col("__start"))), keys(old))).alias(self.key))
            if (held := self._held(versions, changed)) is not None:  # what was published counts for all runs of this batch
                rows = _null_safe(rows, held, [*part, self.key], "left_anti")

            last = runs.where("NOT __more").select(*part, "__start")
            touched = changed.select(*part, "__node").distinct().join(last, part).join(leaves, [*part, "__node"])
            contents = touched.select(*part, "__node", F.explode(seen(F.col("__start"))).alias("__e")).select(*part, "__node", f"__e.{self.key}", "__e.__h")
            _together(lambda: self._write(rows, version, "output"), lambda: self._write_contents(contents, version))
            for what in ("leaves", "tree", "runs"):
                self.folder.remove(f"{version}/{what}")
            self._publish(after, [*versions, version])
        except BaseException:
            self.folder.remove(version)
            raise
        return self._read(version, "output", nothing.schema)
