"""Watched-folder semantics: batch twins, and the streams run to completion."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tillbook.catalog import query
from tillbook.session import shared_dir
from tillbook.sources import star
from tillbook.sources.files import base_name
from tillbook.streaming import watch

TICK = 150


def _observed(events):
    """A look at a path per user and tick: size and time change now and then, ticks are missed."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        F.concat(F.lit("new/"), F.col("user_id").cast("string")).alias("path"), F.call_function("div", F.col("event_id"), F.lit(TICK)).alias("tick"),
        F.call_function("div", k, F.lit(60)).alias("size"), F.lit(0).cast("bigint").alias("mtime_ms"), F.col("event_id"))


def _looks(spark, sf):
    seen = _observed(star.read(spark, sf, "events"))
    return seen.groupBy("path", "tick").agg(F.max("size").alias("size"), F.max("mtime_ms").alias("mtime_ms"))


OBS = f"""
    with o as (select 'new/' || user_id path, event_id // {TICK} tick, max(cast(json_extract_string(props, '$.k') as int) // 60) size from events group by 1, 2),
    s as (select *, coalesce(size = lag(size) over w and tick = lag(tick) over w + 1, false) same from o window w as (partition by path order by tick)),
    e as (select *, same and coalesce(lag(same) over w, false) eligible, coalesce(lag(same, 2) over w, false) before2 from s window w as (partition by path order by tick))"""


@query("stable_files", OBS + " select path, tick, eligible, eligible and not before2 newly from e")
def stable_files(spark, sf):
    """K1, batch twin."""
    return watch.stability(_looks(spark, sf))


@query("stable_files_stream", OBS + """, top as (select max(tick) t from e), seen as (select path, tick, case when eligible then 'eligible' else 'pending' end status, lead(tick) over (partition by path order by tick) as later from e)
    select path, tick, status from seen union all select path, tick + 1, 'vanished' from seen where coalesce(later, -1) <> tick + 1""")
def stable_files_stream(spark, sf):
    """K1/U5 as a stateful stream over the same looks; a last look at another path moves the clock on."""
    path = f"{shared_dir(spark)}/stable-{uuid.uuid4().hex}"
    looks = _looks(spark, sf).withColumn("failed", F.lit(False))
    looks.write.parquet(f"{path}/in")
    return _statuses(spark, path).select("path", "tick", "status")


def _statuses(spark, path: str):
    """Statuses of the looks in ``path``/in, of all ticks but those of a clock that is written behind them."""
    schema = "path string, tick bigint, size bigint, mtime_ms bigint, failed boolean"
    last = spark.read.schema(schema).parquet(f"{path}/in").agg(F.max("tick")).first()[0] or 0
    clock = spark.createDataFrame([("clock", last + 10, 0, 0, False)], schema)
    clock.write.mode("append").parquet(f"{path}/in")
    stream = watch.stability_stream(spark.readStream.schema(schema).parquet(f"{path}/in"))
    with watch.rocksdb(spark):
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/_checkpoint").trigger(
            availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(watch.OBSERVED).parquet(f"{path}/out")


@query("failed_files_stream", """
    with d as (select doc_id, 'new/' || doc_id path, doc_id % 50 as start, doc_id % 5 kind from documents), t as (select unnest(range(8)) k)
    select path, start + k as tick, case kind
        when 0 then case when k < 2 then 'pending' else 'eligible' end
        when 1 then case when k < 2 then 'pending' when k = 2 then 'eligible' else 'failed' end
        when 2 then case when k < 2 or k in (5, 6) then 'pending' when k in (2, 7) then 'eligible' else 'failed' end
        when 3 then case when k < 2 or k in (5, 6) then 'pending' when k in (2, 7) then 'eligible' when k = 4 then 'vanished' else 'failed' end
        else case when k = 3 then 'vanished' when k in (2, 6, 7) then 'eligible' else 'pending' end end status
    from d, t union all select path, start + 8, 'vanished' from d""")
def failed_files_stream(spark, sf):
    """Files that import, that fail for good, that are mended after a failure, that come back after one, and that miss a tick."""
    path = f"{shared_dir(spark)}/failed-{uuid.uuid4().hex}"
    docs = star.read(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("new/"), F.col("doc_id").cast("string")).alias("path"), (F.col("doc_id") % 50).alias("start"), (F.col("doc_id") % 5).alias("kind"))
    k = F.col("k")
    looks = docs.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    # Kind 2 is written anew at its sixth look; kind 3 is away at the fifth; kind 4 is away at the fourth and steady before and after.
    looks = looks.filter(~((F.col("kind") == 3) & (k == 4)) & ~((F.col("kind") == 4) & (k == 3))).withColumn(
        "mtime_ms", F.when((F.col("kind") == 2) & (k > 4), 2).otherwise(1).cast("bigint"))
    looks = looks.select("path", (F.col("start") + k).alias("tick"), F.lit(7).cast("bigint").alias("size"), "mtime_ms", F.lit(False).alias("failed"))
    reports = docs.filter("kind in (1, 2, 3)").select(
        "path", (F.col("start") + 2).alias("tick"), F.lit(0).cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("mtime_ms"), F.lit(True).alias("failed"))
    looks.unionByName(reports).write.parquet(f"{path}/in")
    return _statuses(spark, path).select("path", "tick", "status")


def _scans(spark, sf, path: str):
    """All documents as scans in three loads: some cannot be read, some are of no known type, and every tenth comes twice."""
    k = F.col("doc_id")
    ext = F.when(k % 19 == 0, ".docx").when(k % 7 == 0, ".JPEG").otherwise(".jpg")
    scans = star.read(spark, sf, "documents").select(
        F.concat(F.lit("new/"), k.cast("string"), ext).alias("path"), F.sha2("text", 256).alias("sha256"), k.alias("tick"),
        F.when(k % 23 == 0, "corrupt or unreadable image").alias("failed"), (k % 3).alias("load"))
    again = scans.filter(k % 10 == 0).withColumns({"path": F.concat(F.lit("again/"), "path"), "load": F.lit(2).cast("bigint")})
    for load in range(3):  # each load is younger than the one before, which is the order in which a stream takes them
        # Hashed in parallel; a load is one file, as the stream takes a file per batch.
        scans.unionByName(again).filter(F.col("load") == load).drop("load").repartition(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema("path string, sha256 string, tick bigint, failed string").option("maxFilesPerTrigger", "1").parquet(f"{path}/in")


def _ingested(spark, sf):
    """The ingest of the scans, a fifth of them known already; the first time that files of the second batch are moved, that fails."""
    path = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    lib = star.library(spark, sf)
    lib["item_source_file"] = lib["item_source_file"].filter("item_id % 5 = 0")
    stream = _scans(spark, sf, path)
    broken = []

    def move(files, number):
        if number == 1 and not broken:
            broken.append(number)
            raise OSError("the folder is not there")

    try:
        watch.start_ingest(stream, lib, f"{path}/out", star.NOW, archive=move).awaitTermination()
    except StreamingQueryException:
        # The second batch is run again, over what its first attempt has written.
        watch.start_ingest(stream, lib, f"{path}/out", star.NOW, archive=move).awaitTermination()
    return f"{path}/out"


SCANS = """
    with d as (select doc_id, sha256(text) sha256, 'new/' || doc_id || case when doc_id % 19 = 0 then '.docx' when doc_id % 7 = 0 then '.JPEG' else '.jpg' end path from documents),
    fl as (select path, sha256, doc_id, doc_id % 3 batch from d union all select 'again/' || path, sha256, doc_id, 2 from d where doc_id % 10 = 0),
    good as (select * from fl where doc_id % 19 <> 0 and doc_id % 23 <> 0),
    known as (select sha256(text) sha256, min(20000000000000 + doc_id) existing from documents where doc_id % 5 = 0 group by 1),
    first as (select sha256, min(batch) batch, min_by(path, (batch, path)) path from good where sha256 not in (select sha256 from known) group by 1),
    fresh as (select *, (select max(id) from item) + row_number() over (order by batch, path) item_id from first)"""


@query("streamed_ingest", SCANS + """
    select batch, path, 'ingested' outcome, item_id, sha256 detail from fresh
    union all select g.batch, g.path, 'duplicate', coalesce(k.existing, f.item_id), null from good g left join known k using (sha256) left join fresh f using (sha256) where g.path is distinct from f.path
    union all select batch, path, 'rejected', null, case when doc_id % 19 = 0 then 'unsupported file type: .docx' else 'corrupt or unreadable image' end from fl where doc_id % 19 = 0 or doc_id % 23 = 0""")
def streamed_ingest(spark, sf):
    """K3/K4: what became of every file, batch by batch, through a batch that is run twice."""
    path = _ingested(spark, sf)
    read = lambda name, columns: spark.read.schema(f"{columns}, batch bigint").parquet(f"{path}/{name}")
    source = watch.ingested(spark, path, "item_source_file").select("item_id", F.col("source_sha256").alias("detail"), "original_name", "batch")
    archived = read("archive", "path string").withColumn("original_name", base_name(F.col("path")))
    duplicates = read("duplicates", "path string, existing_item_id bigint")
    new = source.join(archived.join(duplicates, ["batch", "path"], "left_anti"), ["batch", "original_name"])
    nothing = F.lit(None)
    return (
        new.select("batch", "path", F.lit("ingested").alias("outcome"), "item_id", "detail")
        .unionByName(duplicates.select("batch", "path", F.lit("duplicate").alias("outcome"), F.col("existing_item_id").alias("item_id"), nothing.cast("string").alias("detail")))
        .unionByName(read("rejected", "path string, reason string").select("batch", "path", F.lit("rejected").alias("outcome"), nothing.cast("bigint").alias("item_id"), F.col("reason").alias("detail")))
    )


@query("streamed_pages", SCANS + """
    select batch, item_id, (select max(id) from page) + row_number() over (order by item_id) id, 1 seq,
      'images/' || substr(sha256, 1, 2) || '/' || substr(sha256, 3, 2) || '/' || sha256 || '.jpg' file_relpath, 900 folder_id, 'receipt' type, 'USD' currency from fresh""")
def streamed_pages(spark, sf):
    """K3/K4: the rows of pages, items and receipts that the batches have written."""
    path = _ingested(spark, sf)
    item = watch.ingested(spark, path, "item").select(F.col("id").alias("item_id"), "folder_id", "type")
    receipt = watch.ingested(spark, path, "receipt_data").select("item_id", "currency")
    page = watch.ingested(spark, path, "page").select("batch", "item_id", "id", "seq", "file_relpath")
    return page.join(item, "item_id").join(receipt, "item_id")


@query("streamed_totals", SCANS + """
    select batch, count(*) filter (where path in (select path from fresh)) ingested, count(*) filter (where doc_id % 19 <> 0 and doc_id % 23 <> 0 and path not in (select path from fresh)) duplicates,
      count(*) filter (where doc_id % 19 = 0 or doc_id % 23 = 0) failed, count(*) filter (where doc_id % 19 <> 0 and doc_id % 23 <> 0) moved from fl group by 1""")
def streamed_totals(spark, sf):
    """K3: counts of each batch."""
    return watch.ingest_counts(spark, _ingested(spark, sf))


@query("archive_names", """
    select 'new/' || lang || '/' || doc_id || '/scan' || doc_id % 3 || '.jpg' path,
      'old/' || lang || '/' || doc_id || '/scan' || doc_id % 3 || case when doc_id % 4 = 0 then ' (2)' when doc_id % 4 = 1 then ' (3)' else '' end || '.jpg' dest from documents""")
def archive_names(spark, sf):
    """K5: names free, taken once, taken twice."""
    d = star.read(spark, sf, "documents")
    k = F.col("doc_id")
    rel = F.concat(F.col("lang"), F.lit("/"), k.cast("string"), F.lit("/scan"), (k % 3).cast("string"))
    files = d.select(F.concat(F.lit("new/"), rel, F.lit(".jpg")).alias("path"))
    taken = d.filter(k % 4 < 2).select(F.concat(F.lit("old/"), rel, F.lit(".jpg")).alias("path")).unionByName(
        d.filter(k % 4 == 1).select(F.concat(F.lit("old/"), rel, F.lit(" (2).jpg")).alias("path")))
    return watch.archive_names(files, taken, "new", "old")


@query("current_results_stream", "select e.event_id * 2 page_id, 1 generation, cast(json_extract_string(props, '$.k') as int) k from events e join page p on p.id = e.event_id * 2 where e.event_id % 3 = 1")
def current_results_stream(spark, sf):
    """K6: stream of results joined with the static page table."""
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(star.read(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
    results = stream.select((F.col("event_id") * 2).alias("page_id"), (F.col("event_id") % 3).cast("int").alias("generation"),
                            F.get_json_object("props", "$.k").cast("int").alias("k"))
    kept = watch.current_results(results, star.library(spark, sf)["page"])
    kept.writeStream.format("parquet").option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{path}/out")


@query("progress_stream", "select user_id job_id, count(*) filter (where event_type <> 'error') done_units, count(*) filter (where event_type = 'error') failed_units from events group by 1")
def progress_stream(spark, sf):
    """K7: counters in update mode; the last update of each job is kept."""
    path = f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(star.read(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
    units = stream.select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("outcome"))

    def keep(rows, number):
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/n={number}")

    watch.progress(units).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/_checkpoint").trigger(
        availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/out")
    return rows.groupBy("job_id").agg(F.max_by("done_units", "batch").alias("done_units"), F.max_by("failed_units", "batch").alias("failed_units"))


@query("job_status", """
    with c as (select user_id job_id, count(*) filter (where event_type = 'signup' and user_id % 4 > 0) done_units, count(*) filter (where event_type = 'error' and user_id % 3 > 0) failed_units from events group by 1)
    select *, case when job_id % 10 = 0 then 'cancelled' when job_id % 10 = 1 then case when done_units > 0 then 'partial' else 'failed' end when failed_units = 0 then 'done' when done_units = 0 then 'failed' else 'partial' end status,
      case when job_id % 10 = 1 then 'interrupted by shutdown' end error from c""")
def job_status(spark, sf):
    """A9"""
    units = star.read(spark, sf, "events").select(
        F.col("user_id").alias("job_id"),
        F.when((F.col("event_type") == "signup") & (F.col("user_id") % 4 > 0), "done").when((F.col("event_type") == "error") & (F.col("user_id") % 3 > 0), "failed").alias("outcome"))
    counters = watch.progress(units).withColumns({"cancelled": F.col("job_id") % 10 == 0, "interrupted": F.col("job_id") % 10 == 1})
    return watch.job_status(counters)


@query("vanished_paths", "select distinct 'new/' || user_id path from events where user_id % 3 = 0")
def vanished_paths(spark, sf):
    """U5"""
    e = star.read(spark, sf, "events").select(F.concat(F.lit("new/"), F.col("user_id").cast("string")).alias("path"), "user_id")
    return watch.vanished(e, e.filter("user_id % 3 <> 0"))
