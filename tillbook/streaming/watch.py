"""The watched folder as streams, and their batch twins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Row
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tillbook.functions.checks import is_inside
from tillbook.operators.canonical import count_where
from tillbook.operators.ingest import import_rows, inbox_of, known_sources
from tillbook.plans.scale import next_id, rank_rows
from tillbook.schemas import TABLES, Library
from tillbook.session import checkpointed

STABLE_OBSERVATIONS = 3
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OBSERVED = "path string, tick bigint, status string, streak bigint"
# Ticks whose waiting looks lie together in the state store, and what is known of a path that is not there.
SPAN = 1024
NOTHING = (None, None, None, None, None)


# --- K1/K2 ---------------------------------------------------------------------------


def stability(observations: DataFrame) -> DataFrame:
    """K1, batch twin: (path, tick, eligible, newly).

    Observations: path, tick, size, mtime_ms, one row per path and tick.  A path is eligible
    when it and its two predecessors agree on consecutive ticks; a missed tick starts over.
    Each look tells the next three ticks of its path what it saw, and a look is judged by what it
    is told: one aggregation over (path, tick, size, time), in which no path is a hot group.
    """
    told = observations.select(
        "path", "size", "mtime_ms", "tick", F.explode(F.sequence(F.lit(0), F.lit(STABLE_OBSERVATIONS))).alias("ago"))
    seen = told.groupBy("path", (F.col("tick") + F.col("ago")).alias("tick"), "size", "mtime_ms").agg(
        *[F.max(F.col("ago") == k).alias(f"_{k}") for k in range(STABLE_OBSERVATIONS + 1)])
    eligible = F.lit(True)
    for k in range(1, STABLE_OBSERVATIONS):
        eligible = eligible & F.col(f"_{k}")
    newly = eligible & ~F.col(f"_{STABLE_OBSERVATIONS}")
    return seen.filter("_0").select("path", "tick", eligible.alias("eligible"), newly.alias("newly"))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state with timers needs, for the streams started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    kept = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, kept)


def stability_stream(observations: DataFrame, late: int = 1) -> DataFrame:
    """K1/K2/U5 on a stream: a status per observation: pending, eligible or failed, and vanished for a path that has gone.

    Observations: path, tick, size, mtime_ms, failed (true = a report that the import of this file failed at that tick,
    instead of a look at the folder).  A failed path is left alone until its modification time changes or it vanishes.
    Ticks are event time, a second each: looks may come in any order, up to ``late`` ticks behind the latest of all paths,
    and are taken in tick order by a timer once the watermark has passed them; one that comes later, or again, changes
    nothing.  Waiting looks lie in the state store by spans of ``SPAN`` ticks, and one span at a time is taken from it.
    A path has one timer, for its next tick: when it is due, all ticks that the watermark has passed are judged at once,
    so that a path costs a few calls to the store per batch and span, not several per look.
    A path that is not seen at the tick after its last look has vanished: its state is gone with that timer.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    required, span_ticks = STABLE_OBSERVATIONS, SPAN

    class StabilityGate(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getMapState(
                "waiting", "span bigint", "looks array<struct<tick:bigint,report:boolean,size:bigint,mtime:bigint>>")
            self.seen = handle.getValueState("seen", "tick bigint, size bigint, mtime bigint, streak bigint, failed bigint")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            first, held, spans = None, 0, {}
            for row in rows:
                # Of a tick the last look counts, and the last report.
                spans.setdefault(row["tick"] // span_ticks, {})[row["tick"], bool(row["failed"])] = (row["size"], row["mtime_ms"])
                first = row["tick"] if first is None else min(first, row["tick"])
                held += 1
                if held == span_ticks:
                    self._add(spans)
                    held, spans = 0, {}
            self._add(spans)
            self._wake(first)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            # A look at this tick, or an earlier one, can no longer come.
            passed = timerValues.getCurrentWatermarkInMs() // 1000 - 1
            known = tuple(self.seen.get()) if self.seen.exists() else NOTHING
            before, upcoming, out = known, None, []
            for span in sorted(s for (s,) in self.waiting.keys()):
                looks = self._looks(span) if span * span_ticks <= passed else {}
                due = sorted(at for at in looks if at[0] <= passed)
                if out:
                    yield from self._rows(key, out)
                known, out = self._judged(known, [(*at, *looks.pop(at)) for at in due])
                if due and looks:
                    self._keep(span, looks)
                elif due:
                    self.waiting.removeKey((span,))
                if looks or not due:
                    upcoming = min(t for t, _ in looks) if looks else span * span_ticks
                    break
            if known[0] is not None and known[0] < passed:
                out.append((known[0] + 1, "vanished", 0))
                known = NOTHING
            if out:
                yield from self._rows(key, out)
            if known == NOTHING:
                if before != NOTHING:
                    self.seen.clear()
            elif known != before:
                self.seen.update(known)
            # At the tick after its last look it is known whether a path is still there.
            self._wake(min((t for t in (upcoming, None if known[0] is None else known[0] + 1) if t is not None), default=None))

        def _judged(self, known: tuple, due: list[tuple]) -> tuple[tuple, list[tuple]]:
            """What is known of a path after the looks and reports that are due, and the statuses told; a look comes before a report."""
            seen, size_seen, mtime_seen, streak, failed = known
            out = []
            for tick, is_report, size, mtime in due:
                if seen is not None and seen < (tick if is_report else tick - 1):
                    out.append((seen + 1, "vanished", 0))
                    seen = failed = None
                if is_report:
                    failed = mtime
                    continue
                if failed is not None and failed == mtime:
                    status, streak = "failed", 0
                else:
                    failed = None
                    streak = streak + 1 if (seen, size_seen, mtime_seen) == (tick - 1, size, mtime) else 1
                    status = "eligible" if streak >= required else "pending"
                seen, size_seen, mtime_seen = tick, size, mtime
                out.append((tick, status, streak))
            return ((seen, size_seen, mtime_seen, streak, failed) if seen is not None else (None, None, None, None, failed)), out

        def _add(self, spans: dict[int, dict]) -> None:
            for span, looks in spans.items():
                self._keep(span, self._looks(span) | looks if self.waiting.containsKey((span,)) else looks)

        def _looks(self, span: int) -> dict:
            return {(t, r): (size, mtime) for t, r, size, mtime in self.waiting.getValue((span,))[0]}

        def _keep(self, span: int, looks: dict) -> None:
            self.waiting.updateValue((span,), ([(*at, *seen) for at, seen in looks.items()],))

        def _wake(self, tick: int | None) -> None:
            if tick is not None:
                self.handle.registerTimer((tick + 1) * 1000)

        def _rows(self, key, out: list[tuple]) -> Iterator[Row]:
            return (Row(path=key[0], tick=tick, status=status, streak=streak) for tick, status, streak in out)

        def close(self) -> None:
            pass

    # Time begins at 0, and what is not later than it counts as late.
    timed = observations.withColumn("at", F.timestamp_seconds(F.col("tick") + 1)).withWatermark("at", f"{late} seconds")
    return timed.groupBy("path").transformWithState(
        statefulProcessor=StabilityGate(), outputStructType=OBSERVED, outputMode="append", timeMode="EventTime"
    )


def vanished(state_paths: DataFrame, present: DataFrame) -> DataFrame:
    """Paths whose state is dropped because the folder no longer has them."""
    return state_paths.select("path").distinct().join(present.select("path"), "path", "left_anti")


# --- K3/K4 ---------------------------------------------------------------------------


# Hash digits that a folder of known hashes stands for, and the batches after which single runs are folded into folders.
PREFIX_DIGITS, RUNS = 2, 64
KNOWN = "sha256 string, item_id bigint"
# Where each table's rows of a batch go.
WRITTEN = {"item": "items", "item_source_file": "sources", "page": "pages", "receipt_data": "receipts", "contact_data": "contacts"}


def _prefix() -> Column:
    return F.substring("sha256", 1, PREFIX_DIGITS).alias("prefix")


class KnownHashes:
    """The hashes that an ingest has seen, kept by prefix, and the numbers it goes on from.

    ``base=N`` holds what was known before batch N in one folder per prefix; each batch since adds a run of its own.  A
    batch reads the folders of the prefixes among its files and at most RUNS runs, whatever the size of the library.
    Every RUNS batches the runs are folded into a new base.  All of it is written under batch numbers, so a batch that
    is run again finds exactly what it found the first time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def seed(self, lib: Library) -> None:
        """What the library knows before the first batch; a stream that starts again keeps what it has."""
        sources = known_sources(lib).select("sha256", F.col("existing_item_id").alias("item_id"))
        # Folders are written by prefix: a hot prefix does not exist among hashes.
        sources.withColumn("prefix", _prefix()).repartition("prefix").write.mode("ignore").partitionBy("prefix").parquet(f"{self.path}/base=0")
        self._numbers(next_id(lib["item"]), next_id(lib["page"]), -1, "ignore")

    def _numbers(self, item: int, page: int, batch: int, mode: str) -> None:
        self.spark.createDataFrame([(item, page)], "item bigint, page bigint").coalesce(1).write.mode(mode).parquet(f"{self.path}/numbers={batch}")

    def numbers(self, batch: int) -> tuple[int, int]:
        """The last item and page numbers in use before a batch."""
        return tuple(self.spark.read.schema("item bigint, page bigint").parquet(f"{self.path}/numbers={batch - 1}").first())

    def _base(self, batch: int) -> int:
        return batch // RUNS * RUNS

    def _all(self, base: int, batch: int) -> DataFrame:
        rows = self.spark.read.schema(f"{KNOWN}, prefix string").parquet(f"{self.path}/base={base}")
        runs = [f"{self.path}/run={k}" for k in range(base, batch)]
        return rows.unionByName(self.spark.read.schema(KNOWN).parquet(*runs).withColumn("prefix", _prefix())) if runs else rows

    def fold(self, batch: int) -> None:
        """A new base at the batches that begin one."""
        if batch and self._base(batch) == batch:
            self._all(batch - RUNS, batch).repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{self.path}/base={batch}")

    def among(self, hashes: DataFrame, batch: int) -> DataFrame:
        """(sha256, existing_item_id) of the known hashes with a prefix that ``hashes`` have, before a batch."""
        touched = [r[0] for r in hashes.select(_prefix()).distinct().collect() if r[0] is not None]  # 256 at most
        rows = self._all(self._base(batch), batch).filter(F.col("prefix").isin(touched) if touched else F.lit(False))
        return rows.groupBy("sha256").agg(F.min("item_id").alias("existing_item_id"))

    def add(self, created: DataFrame, pages: DataFrame, batch: int) -> None:
        created.groupBy("sha256").agg(F.min("item_id").alias("item_id")).write.mode("overwrite").parquet(f"{self.path}/run={batch}")
        item, page = self.numbers(batch)
        self._numbers(max(item, next_id(created, "item_id")), max(page, next_id(pages)), batch, "overwrite")


def start_ingest(
    stream: DataFrame, lib: Library, path: str, now: int, trigger: dict | None = None,
    archive: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """K3/K4: eligible files (path, sha256, tick, and failed: reason or null) become items, micro-batch by micro-batch.

    The import hands over a batch's own rows; of the library only the inbox is read, and of the hashes only those that
    ``KnownHashes`` keeps under the prefixes of the batch.  Everything a batch yields is written under its number,
    replacing what a failed attempt left: a replay gives the same rows.  The archive list is written last, and only
    then ``archive`` gets it (path) to move the files; if it fails, the batch is run again when the stream is restarted.
    So a file is only ever archived once its item, or its duplicate, is in the library.  The last look at a path within
    a batch counts.
    """
    known = KnownHashes(stream.sparkSession, f"{path}/known")
    known.seed(lib)

    def one_batch(files: DataFrame, number: int) -> None:
        if "failed" not in files.columns:
            files = files.withColumn("failed", F.lit(None).cast("string"))
        last = F.max_by(F.struct("sha256", "failed"), F.struct("tick", "sha256")).alias("f")
        once = checkpointed(files.groupBy("path").agg(last).select("path", "f.*"))
        known.fold(number)
        got = import_rows(once, known.among(once, number), now, inbox_of(lib), *known.numbers(number))
        outputs = {WRITTEN[t]: rows for t, rows in got.tables.items()} | {"duplicates": got.duplicates, "rejected": got.rejected}
        for name, rows in outputs.items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        spark = files.sparkSession
        known.add(got.created, spark.read.schema(TABLES["page"]).parquet(f"{path}/pages/batch={number}"), number)
        moved = got.created.select("path").unionByName(got.duplicates.select("path"))
        moved.write.mode("overwrite").parquet(f"{path}/archive/batch={number}")
        if archive is not None:
            archive(spark.read.schema("path string").parquet(f"{path}/archive/batch={number}"), number)

    writer = stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", f"{path}/_checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def ingested(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of a library table that the batches of an ingest have written, with their batch."""
    return spark.read.schema(f"{TABLES[table]}, batch bigint").parquet(f"{path}/{WRITTEN[table]}")


def ingest_counts(spark: SparkSession, path: str) -> DataFrame:
    """K3: per batch: ingested, duplicates, failed, moved."""
    parts = None
    for name, label in (("sources", "ingested"), ("duplicates", "duplicates"), ("rejected", "failed"), ("archive", "moved")):
        rows = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").select("batch", F.lit(label).alias("what"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.groupBy("batch").agg(
        *[count_where(F.col("what") == w).alias(w) for w in ("ingested", "duplicates", "failed", "moved")])


# --- K5 ------------------------------------------------------------------------------


def archive_names(files: DataFrame, taken: DataFrame, new_dir: str, old_dir: str) -> DataFrame:
    """K5: destination per file, sub-folders kept, first free ``name (n).ext`` on collision.

    ``files``: path under new_dir; ``taken``: path under old_dir.  The k-th incoming file of a
    name gets its k-th free number.  With the taken numbers sorted, number e at place j leaves
    e − j free ones below it; merged with the k's, each file's number is its place in the merge.
    """
    name = r"([^/]*)$"
    numbered = r"^(.*) \((\d+)\)$"

    def split_name(df: DataFrame, root: str) -> DataFrame:
        relative = F.regexp_replace(F.substring(F.col("path"), len(root) + 1, 1 << 30), "^/+", "")
        base = F.regexp_extract(relative, name, 1)
        stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
        return df.withColumns(
            {
                "folder": F.regexp_replace(relative, r"/?[^/]*$", ""),
                "stem": stem,
                "ext": F.substring(base, F.length(stem) + 1, 1 << 30),
            }
        )

    key = ["folder", "stem", "ext"]
    safe = is_inside(F.lit(new_dir), F.col("path"))
    incoming = split_name(files.select("path").filter(safe).distinct(), new_dir)
    # A name is number 1 of itself and, if it ends in "(n)", number n of the shorter name.
    # Incoming names that look numbered are kept free for themselves.
    old = split_name(taken.select("path").distinct(), old_dir)
    own = old.select(*key, F.lit(1).cast("bigint").alias("n"))
    as_number = old.select(*key).unionByName(incoming.select(*key)).filter(F.col("stem").rlike(numbered)).select(
        "folder", F.regexp_extract("stem", numbered, 1).alias("stem"), "ext", F.regexp_extract("stem", numbered, 2).try_cast("bigint").alias("n"))
    used = own.unionByName(as_number).filter("n >= 1").distinct().join(incoming.select(*key).distinct(), key, "left_semi")
    used = rank_rows(used, key, ["n"], out="j")
    wanted = rank_rows(incoming, key, ["path"], out="k")
    merged = wanted.select(*key, F.col("k").cast("bigint").alias("v"), F.lit(0).alias("late"), "path").unionByName(
        used.select(*key, (F.col("n") - F.col("j")).alias("v"), F.lit(1).alias("late"), F.lit(None).cast("string").alias("path")))
    placed = rank_rows(merged, key, ["v", "late", "path"], out="number").filter("path IS NOT NULL")
    file_name = F.concat(
        "stem", F.when(F.col("number") > 1, F.concat(F.lit(" ("), F.col("number").cast("string"), F.lit(")"))).otherwise(""), "ext")
    return placed.select(
        "path", F.concat_ws("/", F.lit(old_dir), F.nullif(F.col("folder"), F.lit("")), file_name).alias("dest"))


# --- K6/K7/A9 ------------------------------------------------------------------------


def current_results(results: DataFrame, page: DataFrame) -> DataFrame:
    """K6: stream-static join; results of an older generation or an unknown page are dropped."""
    now = page.select(F.col("id").alias("page_id"), F.col("ocr_generation").alias("generation"))
    return results.join(now, ["page_id", "generation"])


def progress(units: DataFrame) -> DataFrame:
    """K7: running counters per job; units: job_id, outcome (done or failed).  Streams in update mode."""
    return units.groupBy("job_id").agg(
        count_where(F.col("outcome") == "done").alias("done_units"),
        count_where(F.col("outcome") == "failed").alias("failed_units"),
    )


def job_status(counters: DataFrame) -> DataFrame:
    """Done, failed, partial; cancelled wins; an interrupted run is partial or failed.

    Counters: job_id, done_units, failed_units, cancelled, interrupted.
    """
    done, failed = F.col("done_units"), F.col("failed_units")
    status = (
        F.when(F.col("cancelled"), "cancelled")
        .when(F.col("interrupted"), F.when(done > 0, "partial").otherwise("failed"))
        .when(failed == 0, "done")
        .when(done == 0, "failed")
        .otherwise("partial")
    )
    error = F.when(F.col("interrupted") & ~F.col("cancelled"), "interrupted by shutdown")
    return counters.select("job_id", "done_units", "failed_units", status.alias("status"), error.alias("error"))
