"""Exact allocation, splits, hot groups, streams."""

import random

import pytest
from pyspark.sql import functions as F

from tillbook.operators import edits, listing, maintain, splits
from tillbook.operators.alloc import allocate
from tillbook.operators.canonical import item_pages, page_links, split_reconciliation, summable_receipts
from tillbook.operators.lists import resolve_names
from tillbook.plans import scale
from tillbook.schemas import TABLES, empty, shaped, with_tables
from tillbook.session import packed, setting
from tillbook.streaming import watch


def fresh(spark, **rows):
    lib = {t: empty(spark, t) for t in TABLES}
    for table, (columns, data) in rows.items():
        lib[table] = shaped(spark.createDataFrame(data, columns), table)
    return lib


def ledger(spark):
    return fresh(
        spark,
        folder=("id long, kind string, name string", [(1, "inbox", "Inbox"), (2, "user", "Materials"), (3, "trash", "Trash")]),
        item=("id long, folder_id long, type string, created_at long, trashed_at long",
              [(1, 2, "receipt", 1, None), (2, 2, "receipt", 1, None), (3, 2, "receipt", 1, 5), (4, 2, "document", 1, None), (5, 2, "receipt", 1, None)]),
        receipt_data=("item_id long, total_minor long, currency string, tax_total_minor long",
                      [(1, 10000, "USD", 825), (2, -1000, "EUR", None), (3, 500, "USD", None), (5, None, "USD", None)]),
        receipt_tax_line=("id long, item_id long, label string, amount_minor long", [(1, 1, "GST", 500), (2, 1, "PST", 325)]),
        page=("id long, item_id long, seq long, file_relpath string", [(1, 1, 1, "images/a.jpg")]),
    )


def test_split_three_ways(spark):
    lib = ledger(spark)
    parts = spark.createDataFrame([(1, i) for i in range(3)] + [(2, i) for i in range(3)], "item_id long, ord int")
    out, rejected = splits.split_receipts(lib, parts, 99)
    assert rejected.count() == 0
    kids = out["item"].filter("split_role = 'child'").join(out["receipt_data"], F.col("id") == F.col("item_id"))
    got = [(r["split_group_id"], r["total_minor"], r["tax_total_minor"]) for r in kids.orderBy("id").collect()]
    assert got == [(1, 3334, 276), (1, 3333, 275), (1, 3333, 274)] + [(2, -334, None), (2, -333, None), (2, -333, None)]
    recon = split_reconciliation(out).collect()
    assert all(r["drift_minor"] == 0 and r["tax_drift_minor"] == 0 for r in recon)
    total = {r["currency"]: r["t"] for r in summable_receipts(out).groupBy("currency").agg(F.sum("total_minor").alias("t")).collect()}
    assert total == {"USD": 10000, "EUR": -1000}
    back, _ = splits.dissolve_splits(out, out["split_group"].select(F.col("id").alias("split_group_id")), 100)
    assert back["item"].count() == 5 and back["receipt_tax_line"].count() == 2 and back["split_group"].count() == 0
    assert summable_receipts(back).filter("item_id = 1").first()["total_minor"] == 10000


def test_split_by_amount_and_weight(spark):
    lib = ledger(spark)
    parts = spark.createDataFrame(
        [(1, 1, "$60.00", None, "Lumber"), (1, 2, "40", None, None), (2, 1, None, 3.0, None), (2, 2, None, 0.0, None), (2, 3, None, 1.0, None)],
        "item_id long, ord int, amount_text string, weight double, category_name string")
    out, rejected = splits.split_receipts(lib, parts, 99)
    assert rejected.count() == 0
    kids = out["item"].filter("split_role = 'child'").join(out["receipt_data"], F.col("id") == F.col("item_id")).orderBy("id").collect()
    assert [(k["total_minor"], k["tax_total_minor"]) for k in kids] == [(6000, 495), (4000, 330), (-750, None), (0, None), (-250, None)]
    assert kids[0]["category_id"] == out["category"].filter("name = 'Lumber'").first()["id"] and kids[1]["category_id"] is None


def test_split_refusals(spark):
    lib = ledger(spark)
    rows = [
        (1, 1, "60", None), (1, 2, "41", None), (2, 1, None, 1.0), (3, 1, None, None), (3, 2, None, None), (4, 1, None, None), (4, 2, None, None),
        (5, 1, None, None), (5, 2, None, None), (6, 1, None, None), (6, 2, None, None)]
    parts = spark.createDataFrame(rows, "item_id long, ord int, amount_text string, weight double")
    got = {r["item_id"]: r["reason"] for r in splits.split_refusals(lib, parts).collect()}
    assert got == {
        1: "part amounts sum to 10100 but origin total is 10000", 2: "split requires at least 2 parts", 3: "cannot split a trashed item",
        4: "only receipts can be split", 5: "cannot split a receipt with no total", 6: "item not found"}


def test_allocation_is_exact(spark):
    """Sums exactly, no share a unit or more from the ideal."""
    rng = random.Random(1)
    rows = []
    for g in range(60):
        total, n = rng.choice([0, 1, 7, 100, -999, 12345]), rng.randint(1, 9)
        rows += [(g, i, total, rng.randint(0, 5) + (i == 0)) for i in range(n)]
    parts = spark.createDataFrame(rows, "g long, ord int, total long, w long")
    out = allocate(parts, ["g"], ["ord"], "total", "s", weight="w").join(parts.groupBy("g").agg(F.sum("w").alias("ws")), "g")
    for r in out.groupBy("g").agg(F.sum("s").alias("s"), F.max("total").alias("t"), F.max(F.abs(F.col("s") - F.col("total") * F.col("w") / F.col("ws"))).alias("e")).collect():
        assert r["s"] == r["t"] and r["e"] < 1
    equal = allocate(parts, ["g"], ["ord"], "total", "s")
    for r in equal.groupBy("g").agg(F.sum("s").alias("s"), F.max("total").alias("t"), (F.max("s") - F.min("s")).alias("d")).collect():
        assert r["s"] == r["t"] and r["d"] <= 1


def test_hot_groups_rank(spark):
    rows = [(0 if i % 3 else i, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, v long")
    ranked = {(r["k"], r["v"]): r["rank"] for r in scale.rank_rows(df, ["k"], ["v"]).collect()}
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    for k, vs in groups.items():
        vs.sort()
        for i, v in enumerate(vs):
            assert ranked[(k, v)] == i + 1


def test_allocation_of_large_amounts_and_odd_weights(spark):
    """Amounts of sixteen digits share exactly; weights that cannot be exact refuse their receipt alone."""
    big = 9_007_199_254_740_991
    parts = spark.createDataFrame([(1, k, big, big - k) for k in range(3)], "g long, ord int, total long, w long")
    assert sum(r["s"] for r in allocate(parts, ["g"], ["ord"], "total", "s", weight="w").collect()) == big
    lib = ledger(spark)
    lib["receipt_data"] = lib["receipt_data"].withColumn("total_minor", F.when(F.col("item_id") == 1, big).otherwise(F.col("total_minor")))
    rows = [(1, 1, "90071992547409.90", None), (1, 2, "0.01", None), (2, 1, None, 1e300), (2, 2, None, 1.0)]
    out, rejected = splits.split_receipts(lib, spark.createDataFrame(rows, "item_id long, ord int, amount_text string, weight double"), 9)
    assert {r["item_id"]: r["reason"] for r in rejected.collect()}[2] in ("a weight is too large", "cannot split a trashed item")
    kids = out["item"].filter("split_role = 'child'").join(out["receipt_data"], F.col("id") == F.col("item_id"))
    assert sorted(r["total_minor"] for r in kids.collect()) == [1, big - 1]


def test_numbers_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    rows = scale.number_rows(df.repartition(7), ["v"], start=10).orderBy("v").collect()
    assert [r["row_no"] for r in rows] == list(range(11, 1011))


def test_purge_keeps_origins_of_living_children(spark):
    lib = ledger(spark)
    out, _ = splits.split_receipts(lib, spark.createDataFrame([(1, 1), (1, 2)], "item_id long, ord int"), 9)
    out["item"] = out["item"].withColumn("trashed_at", F.when(F.col("id").isin(1, 4), 9).otherwise(F.col("trashed_at")).cast("long"))
    rest, released, blocked = maintain.empty_trash(out)
    assert [r["item_id"] for r in blocked.collect()] == [1]
    assert {r["id"] for r in rest["item"].collect()} == {1, 2, 5, 6, 7} and released.count() == 0


def test_archive_moves_whole_split_groups(spark, tmp_path):
    lib = ledger(spark)
    out, _ = splits.split_receipts(lib, spark.createDataFrame([(1, 1), (1, 2)], "item_id long, ord int"), 9)
    out["receipt_data"] = out["receipt_data"].withColumn("txn_date", F.when(F.col("item_id") == 6, "2001-01-01").otherwise("2020-01-01").cast("date"))
    rest = maintain.archive(out, "2010-01-01", str(tmp_path / "a"), 10)
    assert {r["item_id"] for r in maintain.list_archive(spark, str(tmp_path / "a")).collect()} == {1, 4, 6, 7}
    assert {r["id"] for r in rest["item"].collect()} == {2, 3, 5} and rest["split_group"].count() == 0
    assert rest["archive_log"].first()["items_moved"] == 4


def test_snapshot_finds_damage(spark, tmp_path):
    lib, path = ledger(spark), tmp_path / "s"
    maintain.snapshot(lib, str(path))
    assert all(r["ok"] for r in maintain.verify_snapshot(spark, str(path)).collect())
    victim = next((path / "tables" / "vendor").glob("*.parquet"))
    victim.write_bytes(victim.read_bytes() + b"x")
    (victim.parent / f".{victim.name}.crc").unlink()
    extra = {r["name"]: r["ok"] for r in maintain.verify_snapshot(spark, str(path)).collect()}
    assert extra["manifest hashes match"] is False and extra["manifest files present"] is True


def test_patch_keeps_all_or_nothing(spark):
    lib = ledger(spark)
    rows = [(1, 1, "totalText", "84.37"), (1, 2, "vendorName", "Staples"), (2, 1, "totalText", "abc"), (2, 1, "currency", "USD"), (4, 1, "title", "Deed"), (9, 1, "title", "x")]
    out, errors, created = edits.patch_items(lib, spark.createDataFrame(rows, "item_id long, seq int, field string, value string"), 7)
    assert {(r["item_id"], r["field"]) for r in errors.collect()} == {(2, "totalText"), (9, "id")}
    receipts = {r["item_id"]: r for r in out["receipt_data"].collect()}
    assert receipts[1]["total_minor"] == 8437 and receipts[1]["vendor_id"] == 1 and receipts[2]["currency"] == "EUR"
    assert '"pinned":true' in receipts[1]["extraction_json"] and [c["name"] for c in created.collect()] == ["Staples"]
    assert out["document_data"].first()["title"] == "Deed"


def test_page_links_and_members_of_groups(spark):
    """Links name an origin's pages once per child; members are told once, and only of groups that are asked for."""
    item = [(1, 7, "origin"), (2, 7, "child"), (3, 7, "child"), (4, 8, "origin"), (5, 8, "child"), (6, None, None)]
    lib = fresh(
        spark,
        item=("id long, split_group_id long, split_role string", item),
        split_group=("id long, origin_item_id long, origin_page_id long", [(7, 1, None), (8, 4, 41)]),
        page=("id long, item_id long, seq int", [(10 + k, 1, k) for k in range(5)] + [(40, 4, 0), (41, 4, 1), (60, 6, 0)]),
    )
    links = {tuple(r) for r in page_links(lib).collect()}
    assert links == {(i, i, None, False) for i, _, _ in item} | {(2, 1, None, True), (3, 1, None, True), (5, 4, 41, True)}
    shown = sorted((r.item_id, r.page_id, r.via_split) for r in item_pages(lib).collect())
    own = [(1, 10 + k, False) for k in range(5)] + [(4, 40, False), (4, 41, False), (6, 60, False)]
    assert shown == sorted(own + [(i, 10 + k, True) for i in (2, 3) for k in range(5)] + [(5, 41, True)])
    ids = spark.createDataFrame([(2,), (2,), (6,), (99,)], "item_id long")
    assert sorted(r.page_id for r in item_pages(lib, ids).collect()) == [10, 11, 12, 13, 14, 60]
    members = sorted(tuple(r) for r in listing.group_members(lib, ids).collect())
    assert members == [(7, 1, "origin", False), (7, 2, "child", True), (7, 3, "child", False)]
    told = [(r.item_id, r.ref_id) for r in listing.item_detail(lib, ids).filter("section = 'sibling'").collect()]
    assert sorted(told) == [(2, 1), (2, 3)]
    assert listing.item_detail(lib, ids, siblings=False).filter("section = 'sibling'").count() == 0


def test_names_of_several_lists_in_one_pass(spark):
    """Each list keeps its own numbers, spellings of one key become one entry, and no list takes another's names."""
    lib = ledger(spark)
    first = lib["category"].agg(F.max("id")).first()[0] or 0
    wanted = [("category", "Zinc"), ("category", " zinc "), ("category", "Yarn"), ("vendor", "Zinc"), ("vendor", "Z I N C"), ("vendor", "\u5e97"),
              ("project", "Zinc"), ("project", ""), ("project", None)]
    out, mapping = resolve_names(lib, spark.createDataFrame(wanted, "list string, name string"), 7, ["vendor", "category", "project"])
    got = {(r["list"], r["name"]): (r["id"], r["created"]) for r in mapping.collect()}
    assert got["category", "Yarn"] == (first + 1, True)
    assert got["category", "Zinc"] == got["category", "zinc"] == (first + 2, True)
    assert got["vendor", "Zinc"] == got["vendor", "Z I N C"] and got["vendor", "\u5e97"] != got["vendor", "Zinc"]
    assert ("project", "") not in got and got["project", "Zinc"][1]
    for table, more in (("category", 2), ("vendor", 2), ("project", 1)):
        ids = [r["id"] for r in out[table].select("id").collect()]
        assert len(ids) == len(set(ids)) == lib[table].count() + more
    again = resolve_names(out, spark.createDataFrame(wanted, "list string, name string"), 8, ["vendor", "category", "project"])[1]
    assert {(r["list"], r["name"]): (r["id"], r["created"]) for r in again.collect()} == {k: (v[0], False) for k, v in got.items()}
    nothing = resolve_names(lib, spark.createDataFrame([], "list string, name string"), 7, ["vendor", "category", "project"])
    assert nothing[1].count() == 0 and nothing[0]["project"].count() == lib["project"].count()


def test_stream_remembers_failures(spark, tmp_path):
    looks = [("a", t, 1, 1, False) for t in (1, 2, 3)] + [("a", 3, 0, 1, True)] + [("a", 4, 1, 1, False)] + [("a", t, 1, 2, False) for t in (5, 6, 7)]
    looks += [("b", 1, 1, 1, False), ("b", 2, 1, 1, False), ("b", 4, 1, 1, False), ("clock", 20, 0, 0, False)]
    schema = "path string, tick long, size long, mtime_ms long, failed boolean"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = watch.stability_stream(spark.readStream.schema(schema).parquet(source))
        with watch.rocksdb(spark):
            stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
        return {(r["path"], r["tick"]): r["status"] for r in spark.read.parquet(out).collect()}

    random.Random(5).shuffle(looks)
    spark.createDataFrame(looks, schema).repartition(5).write.parquet(source)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = run()
    assert [got[("a", t)] for t in range(1, 9)] == ["pending", "pending", "eligible", "failed", "pending", "pending", "eligible", "vanished"]
    assert [got[("b", t)] for t in (1, 2, 3, 4, 5)] == ["pending", "pending", "vanished", "pending", "vanished"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    # Paths that have gone leave no state; looks behind the watermark and of an old tick change nothing.
    state = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "seen").load()
    assert {r["key"]["path"] for r in state.collect()} <= {"clock"}
    spark.createDataFrame([("a", 6, 9, 9, False), ("clock", 40, 0, 0, False)], schema).write.mode("append").parquet(source)
    assert {k: v for k, v in run().items() if k[0] != "clock"} == {k: v for k, v in got.items() if k[0] != "clock"}


def test_known_hashes_fold_their_runs(spark, tmp_path, monkeypatch):
    """More batches than runs: folded or not, every batch finds what all before it have added."""
    monkeypatch.setattr(watch, "RUNS", 2)
    lib = {"item_source_file": spark.createDataFrame([(7, "aa00")], "item_id long, source_sha256 string"),
           "item": spark.createDataFrame([(7,)], "id long"), "page": spark.createDataFrame([(3,)], "id long")}
    known = watch.KnownHashes(spark, str(tmp_path / "k"))
    known.seed(lib)
    for number in range(5):
        for _ in range(2):  # the second time as a replay
            known.fold(number)
            asked = spark.createDataFrame([("aa00",), ("aa01",), ("bb01",), (None,)], "sha256 string")
            want = {"aa00": 7} | ({"aa01": 100} if number else {}) | ({"bb01": 101} if number > 1 else {})
            assert {r["sha256"]: r["existing_item_id"] for r in known.among(asked, number).collect() if r["sha256"] in ("aa00", "aa01", "bb01")} == want
            sha = ["aa01", "bb01", "aa02", "cc03", "aa04"][number]
            known.add(spark.createDataFrame([(sha, 100 + number)], "sha256 string, item_id long"), spark.createDataFrame([(10 + number,)], "id long"), number)
            assert known.numbers(number + 1) == (100 + number, 10 + number)
    assert known.among(spark.createDataFrame([("dd",)], "sha256 string"), 4).count() == 0


def test_grid_plan_reads_each_table_once_per_use(lib):
    from tillbook.operators.canonical import folder_totals

    plan = folder_totals(lib)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNull(trashed_at), IsNull(superseded_at)" in plan.replace("IsNotNull(type), ", "") or "IsNull(trashed_at)" in plan
    assert "extraction_json" not in plan and "CartesianProduct" not in plan


def _files(spark):
    from pathlib import Path

    from tillbook.session import shared_dir

    return sum(1 for f in Path(shared_dir(spark).removeprefix("file:")).rglob("*") if f.is_file())


def test_groups_that_fit_a_task_write_no_cut_off_points(spark):
    parts = spark.createDataFrame([(g, i, 10 + g, i + 1) for g in range(20) for i in range(5)], "g int, ord int, total int, w int")
    before = _files(spark)
    out = allocate(parts, ["g"], ["ord"], "total", "s", weight="w")
    assert {r["g"]: r["s"] for r in out.groupBy("g").agg(F.sum("s").alias("s")).collect()} == {g: 10 + g for g in range(20)}
    assert _files(spark) == before


def test_small_and_large_groups_are_shared_alike(spark, monkeypatch):
    from tillbook.plans import scale

    rows = [(g, i, 1000 + 7 * g, (i * 37 + g) % 11 + 1) for g in range(6) for i in range(9)] + [(None, 0, 5, 1)]
    parts = spark.createDataFrame(rows, "g int, ord int, total int, w int")
    small = allocate(parts, ["g"], ["ord"], "total", "s", weight="w").collect()
    ranks = scale.rank_rows(parts, ["g"], ["ord"]).collect()
    monkeypatch.setattr(scale, "LARGEST_GROUP", 3)
    assert sorted(small) == sorted(allocate(parts, ["g"], ["ord"], "total", "s", weight="w").collect())
    key = lambda r: (r["g"] is None, r["g"], r["ord"])
    assert sorted(ranks, key=key) == sorted(scale.rank_rows(parts, ["g"], ["ord"]).collect(), key=key)


def test_running_totals_of_numbered_rows(spark):
    from tillbook.plans import scale

    df = spark.range(1000).select(F.col("id").alias("v"), (F.col("id") % 7).alias("n")).repartition(9)
    got = scale.number_rows(df, ["v"], totals={"n_before": "n"}).orderBy("v").collect()
    assert [r["row_no"] for r in got] == list(range(1, 1001))
    assert [r["n_before"] for r in got] == [sum(k % 7 for k in range(v)) for v in range(1000)]


def test_stream_judges_spans_and_batches_as_one(spark, tmp_path, monkeypatch):
    """Looks that wait over several spans and arrive over several batches get the statuses of the batch twin; a path has one timer."""
    monkeypatch.setattr(watch, "SPAN", 4)
    dice = random.Random(3)
    looks = {(p, t): (dice.randrange(2), dice.randrange(3) // 2) for p in "abc" for t in range(30) if dice.random() < 0.85}
    schema = "path string, tick long, size long, mtime_ms long, failed boolean"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for until in (13, 14, 30, 60):
        part = [(*at, *looks.pop(at), None if at[0] == "a" else False) for at in sorted(looks, reverse=True) if at[1] < until] + [("clock", until, 0, 0, False)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        if until == 13:
            first = spark.read.format("parquet").schema(schema).load(source).count()
        stream = watch.stability_stream(spark.readStream.schema(schema).parquet(source))
        with watch.rocksdb(spark):
            stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
        if until == 13:
            state = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "waiting").load()
            assert first > 20 and state.count() <= 4  # of each path, what lies beyond the watermark
    got = [r for r in spark.read.parquet(out).collect() if r["path"] != "clock"]
    told = {(r["path"], r["tick"]): r["status"] for r in got}
    assert len(got) == len(told)
    seen = spark.read.parquet(source).filter("path <> 'clock'").cache()
    twin = {(r["path"], r["tick"]): "eligible" if r["eligible"] else "pending" for r in watch.stability(seen).collect()}
    twin |= {(p, t + 1): "vanished" for p, t in list(twin) if (p, t + 1) not in twin}
    assert told == twin


def test_library_writes_split_tables_once(lib):
    """Receipts and tax lines of the library are read where their parts were written, not written a second time."""
    for table in ("receipt_data", "receipt_tax_line"):
        folders = {f.rsplit("/", 2)[-2].rsplit("-", 1)[0] for f in lib[table].inputFiles()}
        assert "split-parts" in folders or "line-shares" in folders
        assert table not in folders
    assert "extraction_json" not in str(lib["item"].sparkSession.read.parquet(
        *{f.rsplit("/", 1)[0] for f in lib["split_group"].inputFiles()}).columns)


def test_line_shares_of_equal_parts_follow_their_numbers(spark):
    """Children of equal parts take the remainders in the order of their numbers, and line shares still sum to the lines."""
    lib = ledger(spark)
    lines = spark.createDataFrame([(901, 1, "GST", 500, 7, 1), (902, 1, "PST", 700, -5, None)], TABLES["receipt_tax_line"])
    lib = with_tables(lib, receipt_tax_line=lines)
    parts = spark.createDataFrame([(1, 1, 1.0), (1, 1, 1.0), (1, 2, 1.0)], "item_id long, ord int, weight double")
    out, rejected = splits.split_receipts(lib, parts, 9)
    assert rejected.count() == 0
    children = [r["item_id"] for r in out["receipt_data"].join(lib["receipt_data"].select("item_id"), "item_id", "left_anti").orderBy("item_id").collect()]
    got = {(r["label"], r["item_id"]): r["amount_minor"] for r in out["receipt_tax_line"].collect()}
    assert [got["GST", c] for c in children] == [3, 2, 2] and [got["PST", c] for c in children] == [-2, -2, -1]


def test_split_tables_stay_in_the_buckets_of_their_receipts(spark, monkeypatch):
    """Children, line shares and the children's receipts are made where the parts and receipts of an item lie, without a shuffle."""
    lib = ledger(spark)
    lines = spark.createDataFrame([(901, 1, "GST", 500, 7, 1), (902, 1, "PST", 700, -5, None)], TABLES["receipt_tax_line"])
    lib = with_tables(lib, **{t: packed(df, t, by="item_id") for t, df in (("receipt_data", lib["receipt_data"]), ("receipt_tax_line", lines))})
    parts = packed(spark.createDataFrame([(1, 1, 1.0), (1, 1, 1.0), (1, 2, 1.0)], "item_id long, ord int, weight double"), "parts", by="item_id")
    plans = {}

    def seen(df, name, by=None):
        plans[name] = (df.repartition(8, by) if by else df)._jdf.queryExecution().executedPlan().toString()
        return packed(df, name, by=by)

    monkeypatch.setattr(splits, "packed", seen)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        out, rejected = splits.split_receipts(lib, parts, 9)
    assert rejected.count() == 0 and out["receipt_tax_line"].count() == 8
    for name in ("children", "line-shares", "split-parts"):
        assert "Exchange" not in plans[name].replace("ReusedExchange", "Exchange"), plans[name]


def test_repeated_receipts_number_their_groups_parts_and_lines_without_gaps(spark):
    """Copies of a receipt are groups of their own behind those of the receipts before it."""
    lib = ledger(spark)
    lib = with_tables(lib, receipt_data=lib["receipt_data"].unionByName(lib["receipt_data"].filter("item_id = 1")))
    ids = [r["item_id"] for r in lib["receipt_data"].filter("total_minor IS NOT NULL").select("item_id").distinct().orderBy("item_id").collect()]
    parts = spark.createDataFrame([(i, n, 1.0) for i in ids for n in (1, 2)], "item_id long, ord int, weight double")
    out, _ = splits.split_receipts(lib, parts, 9)
    groups = [(r["id"], r["origin_item_id"]) for r in out["split_group"].orderBy("id").collect()]
    assert [g for g, _ in groups] == list(range(1, len(groups) + 1))
    assert [i for _, i in groups] == sorted(i for _, i in groups) and [i for _, i in groups].count(1) == 2
    last = lib["item"].agg(F.max("id")).first()[0]
    children = sorted(r["id"] for r in out["item"].filter("split_role = 'child'").select("id").distinct().collect())
    assert children == list(range(last + 1, last + 1 + 2 * len(groups)))


def test_fixed_lists_are_known_to_be_small(lib):
    """A join with a fixed list is planned as a broadcast, not left to which side is shuffled first."""
    for table in ("category", "tax_category", "payment_type", "project", "cabinet"):
        assert int(str(lib[table]._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10_000
