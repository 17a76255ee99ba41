"""Sinks: repeated runs change nothing, failed ones leave the old version."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeline.operators import context, maintain, stages, tables
from tapeline.schemas import DDL, schema
from tapeline.sources.tables import read_table

BAR = "symbol string, day date, close double"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def bars(spark, *data):
    return spark.createDataFrame([(s, dt.date(2024, 1, d), c) for s, d, c in data], BAR)


def test_upsert_merges_and_repeats(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "t"), BAR)
    assert table.is_empty()
    table.upsert(bars(spark, ("A", 1, 1.0), ("A", 2, 2.0)), ["symbol", "day"])
    change = bars(spark, ("A", 2, 9.0), ("B", 1, 5.0))
    for _ in range(2):
        table.upsert(change, ["symbol", "day"])
        assert [r[2] for r in rows(table.read())] == [1.0, 9.0, 5.0]


def test_duplicate_source_keys_are_refused(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "t"), BAR)
    table.upsert(bars(spark, ("A", 1, 1.0)), ["symbol", "day"])
    with pytest.raises(ValueError, match="duplicate"):
        table.upsert(bars(spark, ("A", 2, 1.0), ("A", 2, 2.0)), ["symbol", "day"])
    assert table.read().count() == 1


def test_failed_write_keeps_the_old_version(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "t"), BAR)
    table.replace(bars(spark, ("A", 1, 1.0)))
    version = table.manifest()
    broken = bars(spark, ("A", 1, 1.0)).withColumn("close", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception, match="no"):
        table.replace(broken)
    assert table.manifest() == version and table.read().count() == 1


def test_undeclared_columns_are_refused_and_missing_ones_are_null(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "t"), BAR)
    with pytest.raises(ValueError, match="undeclared"):
        table.replace(bars(spark, ("A", 1, 1.0)).withColumn("x", F.lit(1)))
    table.replace(bars(spark, ("A", 1, 1.0)).drop("close"))
    assert table.read().first().close is None


def test_seed_once(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "t"), BAR)
    assert table.seed_if_empty(bars(spark, ("A", 1, 1.0)))
    assert not table.seed_if_empty(bars(spark, ("B", 1, 1.0)))
    assert table.read().first().symbol == "A"


def monthly(spark, path):
    return tables.VersionedTable(spark, str(path), BAR, ["day"], ["symbol"])


def files(table):
    return {f for _, f, _ in table.files()}


def test_overwrite_touches_only_its_partitions(spark, tmp_path):
    table = monthly(spark, tmp_path / "p")
    table.overwrite_partitions(bars(spark, ("A", 1, 1.0), ("A", 2, 2.0)))
    first = {f for f in files(table) if "day=2024-01-01" in f}
    for _ in range(2):
        table.overwrite_partitions(bars(spark, ("B", 2, 7.0)))
        assert sorted((r.symbol, r.day.day, r.close) for r in table.read().collect()) == [
            ("A", 1, 1.0), ("B", 2, 7.0)]
    assert first <= files(table)
    with pytest.raises(RuntimeError, match="no rows"):
        table.overwrite_partitions(bars(spark).limit(0))
    with pytest.raises(RuntimeError, match="no rows"):
        table.overwrite_partitions(bars(spark, ("A", 1, 1.0)).filter("close > 5"))
    assert table.read().count() == 2


def test_the_frame_of_an_overwrite_is_run_once(spark, tmp_path):
    count = spark.sparkContext.accumulator(0)

    def tick(batches):
        for batch in batches:
            count.add(batch.num_rows)
            yield batch

    df = bars(spark, ("A", 1, 1.0), ("B", 2, 2.0)).mapInArrow(tick, BAR)
    monthly(spark, tmp_path / "o").overwrite_partitions(df)
    assert count.value == 2


def test_readers_prune_by_partition(spark, tmp_path):
    table = monthly(spark, tmp_path / "r")
    table.append(bars(spark, ("A", 1, 1.0), ("A", 2, 2.0), (None, 3, 3.0)))
    hit = table.read().filter(F.col("day") == F.lit("2024-01-02").cast("date"))
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert [r.close for r in hit.collect()] == [2.0]
    assert hit.inputFiles() and table.read().count() == 3


def test_upsert_leaves_other_partitions_alone(spark, tmp_path):
    table = monthly(spark, tmp_path / "u")
    table.append(bars(spark, ("A", 1, 1.0), ("A", 2, 2.0), ("B", 2, 3.0), ("A", 3, 4.0)))
    before = {f for f in files(table) if "day=2024-01-02" not in f}
    for _ in range(2):
        table.upsert(bars(spark, ("A", 2, 9.0), ("C", 4, 5.0)), ["symbol", "day"])
        assert sorted((r.symbol, r.day.day, r.close) for r in table.read().collect()) == [
            ("A", 1, 1.0), ("A", 2, 9.0), ("A", 3, 4.0), ("B", 2, 3.0), ("C", 4, 5.0)]
        assert before <= files(table)
    assert table.upsert(bars(spark).limit(0), ["symbol", "day"]) == 0
    no_day = spark.createDataFrame([("N", None, 1.0)], BAR)
    for _ in range(2):
        table.upsert(no_day, ["symbol"])
    assert table.read().filter("day is null").count() == 1


def test_a_repeated_run_replaces_its_rows(spark, tmp_path):
    table = monthly(spark, tmp_path / "a")
    table.append(bars(spark, ("A", 1, 1.0)), run="one")
    for close in (2.0, 3.0):
        table.append(bars(spark, ("B", 1, close), ("B", 2, close)), run="two", marks=lambda: {"j": "x"})
    assert sorted((r.symbol, r.close) for r in table.read().collect()) == [("A", 1.0), ("B", 3.0), ("B", 3.0)]
    table.append(bars(spark).limit(0), run="two")
    assert table.read().count() == 1 and table.mark("j") == "x"
    assert table.remove_unused(older_than_s=-60) == 3
    assert table.read().count() == 1


def test_compaction_packs_small_files_only(spark, tmp_path):
    table = monthly(spark, tmp_path / "c")
    for i in range(6):
        table.append(bars(spark, *[(f"S{i}-{k}", 1, float(k)) for k in range(300)]))
    rng = __import__("random").Random(1)
    large = [(f"L{rng.random()}", 2, rng.random()) for _ in range(4_000)]
    table.append(bars(spark, *large).coalesce(1))
    sizes = {f: s for _, f, s in table.files()}
    day1 = [s for f, s in sizes.items() if "day=2024-01-01" in f]
    target = 3 * max(day1)
    want = sorted(map(tuple, table.read().collect()))
    saved = table.compact(target)
    after = {f: s for _, f, s in table.files()}
    small = [s for f, s in after.items() if "day=2024-01-01" in f]
    assert saved == len(day1) - len(small) > 0 and len(small) <= 3
    assert max(small) <= target
    assert {f for f in sizes if "day=2024-01-02" in f} <= set(after)
    assert sorted(map(tuple, table.read().collect())) == want
    assert table.compact(target) == 0 or len(table.files()) <= len(after)
    for _, f, _ in table.files():
        got = [r.symbol for r in spark.read.parquet(f"{table.path}/data/{f}").collect()]
        assert got == sorted(got)


def test_bins():
    assert tables.pack([], 10) == [] and tables.pack([50], 10) == [0]
    sizes = [3, 9, 5, 5, 1, 7]
    bins = tables.pack(sizes, 10)
    used = {}
    for s, b in zip(sizes, bins, strict=True):
        used[b] = used.get(b, 0) + s
    assert max(used.values()) <= 10 and len(used) == 3


EVENT = ("event_id string, user_id string, symbol string, triggered_at timestamp, "
         "field_snapshot string, operator_snapshot string, threshold_snapshot double, "
         "triggered_value double")


def events(spark, *ids):
    at = dt.datetime(2024, 6, 1, 10, 30)
    return spark.createDataFrame(
        [(i, "user-A", "AAPL", at + dt.timedelta(minutes=m), "price", ">", 150.0, 155.5)
         for i, m in ids], EVENT)


def test_sync_rows(spark):
    r = maintain.sync_events(events(spark, ("uuid-1", 0)), "2024-06-02T00:00:00Z").first()
    assert tuple(r) == (
        "uuid-1", "AAPL", "2024-06-01T10:30:00Z", "price > 150.0", "INFO", 155.5, 150.0,
        "user_custom", "2024-06-02T00:00:00Z", "user-A")
    assert maintain.sync_events(events(spark).limit(0), "x").columns == r.__fields__


def test_sync_runs_commit_rows_and_watermark_together(spark, tmp_path, monkeypatch):
    history = stages.open_table(spark, str(tmp_path), "fact_alert_history")
    log = events(spark, ("e1", 0), ("e2", 5))
    assert maintain.run_sync(log, history, "job", "w") == 2
    assert history.mark("job") == "2024-06-01T10:35:00.000000Z"
    assert maintain.run_sync(log, history, "job", "w") == 0
    more = events(spark, ("e1", 0), ("e2", 5), ("e3", 9), ("e2", 11))

    def crash(manifest):
        raise OSError("lost before the commit")

    with monkeypatch.context() as broken:
        broken.setattr(history, "_commit", crash)
        with pytest.raises(OSError, match="lost"):
            maintain.run_sync(more, history, "job", "w")
    assert sorted(r.alert_id for r in history.read().collect()) == ["e1", "e2"]
    assert history.mark("job") == "2024-06-01T10:35:00.000000Z"
    assert maintain.run_sync(more, history, "job", "w") == 1  # e2 sent again later is known
    assert sorted(r.alert_id for r in history.read().collect()) == ["e1", "e2", "e3"]
    assert history.mark("job") == "2024-06-01T10:41:00.000000Z"
    assert maintain.run_sync(events(spark).limit(0), history, "other", "w") == 0
    assert history.mark("other") is None


def test_sync_reads_only_the_days_since_the_watermark(spark, tmp_path):
    history = stages.open_table(spark, str(tmp_path), "fact_alert_history")
    maintain.run_sync(events(spark, ("e1", 0), ("e2", 60 * 24 * 3)), history, "job", "w")
    known = history.read().filter(F.col("event_date") >= F.lit("2024-06-04").cast("date"))
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and known.count() == 1


def test_retained_context_reads_old_days_for_missing_symbols_only(spark, tmp_path):
    table = stages.open_table(spark, str(tmp_path), "rule_engine_context")

    def snapshot(day, *symbols):
        return spark.createDataFrame(
            [(s, dt.date(2024, 1, day), 1.0 * day) for s in symbols], "symbol string, as_of_date date, rsi_14 double"
        )

    for day in range(1, 20):
        table.overwrite_partitions(snapshot(day, "A", "b", *(["OLD"] if day < 4 else [])))
    wanted = spark.createDataFrame([("a",), ("B",)], "symbol string")
    latest = context.retained_context(table, wanted)
    assert [(r.symbol, r.as_of_date.day, r.rsi_14, r.atr_14) for r in latest.orderBy("symbol").collect()] == [
        ("A", 19, 19.0, 0.0), ("B", 19, 19.0, 0.0)]
    assert len(latest.inputFiles()) == 1
    everyone = spark.createDataFrame([("A",), ("OLD",), ("NEVER",)], "symbol string")
    assert sorted((r.symbol, r.as_of_date.day) for r in context.retained_context(table, everyone).collect()) == [
        ("A", 19), ("OLD", 3)]
    empty = stages.open_table(spark, str(tmp_path / "none"), "rule_engine_context")
    assert context.retained_context(empty, wanted).count() == 0


def test_empty_context_stops_the_job(spark):
    with pytest.raises(RuntimeError, match="context"):
        context.require_rows(bars(spark).limit(0), "context")


def test_read_table_projects(spark, tmp_path):
    path = str(tmp_path / "b")
    bars(spark, ("A", 1, 1.0)).write.parquet(path)
    df = read_table(spark, path, ["close"])
    assert df.columns == ["close"]
    assert "ReadSchema: struct<close:double>" in df._jdf.queryExecution().toString()


def test_schemas_parse():
    assert all(schema(name).names for name in DDL)


def test_layout_sorts_inside_files(spark, tmp_path):
    import random

    values = [(f"S{random.Random(i).randrange(5)}", random.Random(-i).randrange(28) + 1, float(i))
              for i in range(200)]
    df = bars(spark, *values)
    laid = tables.compact_layout(df, ["symbol"], ["symbol", "day"])
    assert "REBALANCE_PARTITIONS_BY_COL" in laid._jdf.queryExecution().executedPlan().toString()
    laid.write.parquet(str(tmp_path / "l"))
    for file in (tmp_path / "l").glob("*.parquet"):
        got = [(r.symbol, r.day) for r in spark.read.parquet(str(file)).collect()]
        assert got == sorted(got)
    assert spark.read.parquet(str(tmp_path / "l")).count() == 200


def test_upsert_runs_its_source_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        runs.add(1)
        return x

    table = monthly(spark, tmp_path / "o")
    table.append(bars(spark, ("A", 1, 1.0), ("A", 2, 2.0), ("B", 2, 3.0)))
    source = bars(spark, ("A", 2, 9.0), ("C", 2, 5.0), ("D", 3, 6.0)).withColumn("close", counted("close"))
    assert table.upsert(source, ["symbol", "day"]) == 4  # three of the source, one kept beside them
    assert runs.value == 3
    assert sorted((r.symbol, r.day.day, r.close) for r in table.read().collect()) == [
        ("A", 1, 1.0), ("A", 2, 9.0), ("B", 2, 3.0), ("C", 2, 5.0), ("D", 3, 6.0)]


def test_refused_upsert_leaves_no_files(spark, tmp_path):
    table = monthly(spark, tmp_path / "r")
    table.append(bars(spark, ("A", 1, 1.0)))
    before = sorted(p.name for p in (tmp_path / "r" / "data").iterdir())
    with pytest.raises(ValueError, match="duplicate"):
        table.upsert(bars(spark, ("A", 2, 1.0), ("A", 2, 2.0)), ["symbol", "day"])
    assert sorted(p.name for p in (tmp_path / "r" / "data").iterdir()) == before
