"""Versions, snapshots, layout, buckets, cubes and what is counted on the way."""

import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone import cli
from siltstone.operators import cube, flags, ranks, tariff, transform
from siltstone.plans import build, catalogue, trade
from siltstone.plans import workflows as w
from siltstone.plans.rules import TRIPS
from siltstone.plans.trade import TRADE, flagged_trade
from siltstone.plans.workflows import CUBE
from siltstone.sources import landing, scratch, snapshots
from siltstone.sources.buckets import bucket_count, bucketed
from siltstone.sources.layout import clustered
from siltstone.sources.versions import version

SF = "/root/testdata/sf0.001"
TABLES = (*trade.TRADE_TABLES, *trade.EVENT_TABLES)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def scanned(df) -> int:
    """Rows that the scans of a query hand on, from its own metrics."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if node.nodeName().startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return total


@pytest.fixture
def folder(tmp_path):
    for t in TABLES:
        source = f"{SF}/{t}.parquet"
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / f"{t}.parquet")
    return str(tmp_path)


def test_replaced_files_are_read_anew(spark, folder):
    asked = {n: catalogue.queries()[n] for n in ("issue_distribution", "issue_distribution_by_cube", "bench_revenue_by_borough", "tariff_fit", "browse_all_with_raw", "file_accounting")}
    before = {n: rows_of(q(spark, folder)) for n, q in asked.items()}
    assert {n: rows_of(q(spark, folder)) for n, q in asked.items()} == before
    few = spark.read.parquet(f"{SF}/lineitem.parquet").limit(700).toPandas()
    some = spark.read.parquet(f"{SF}/events.parquet").limit(300).toPandas()
    few.to_parquet(f"{folder}/lineitem.parquet", coerce_timestamps="us")
    some.to_parquet(f"{folder}/events.parquet", coerce_timestamps="us")
    after = {n: rows_of(q(spark, folder)) for n, q in asked.items()}
    assert all(before[n] != after[n] for n in asked)
    assert sum(r[1] for r in after["issue_distribution"]) == 700 and after["issue_distribution"] == after["issue_distribution_by_cube"] and after["file_accounting"][0][0] == 300


def test_distance_by_hour_is_asked_of_all_lines_and_of_all_events(spark):
    for name, table in (("bench_distance_by_hour", "lineitem"), ("bench_event_distance_by_hour", "events")):
        for of in ("", "_of_rows"):
            asked = catalogue.queries()[f"{name}{of}"](spark, SF)
            assert asked.agg(F.sum("trips")).first()[0] == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_the_trade_fact_is_dealt_once_and_never_sorted(spark, monkeypatch):
    for rows in (trade.PART_ROWS, 100):
        monkeypatch.setattr(trade, "PART_ROWS", rows)
        df = flags.apply_rules(trade.trade_fact(spark, SF), TRADE)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "ShuffledHashJoin" in plan and "Sort" not in plan
    monkeypatch.setattr(trade, "_facts", {})
    written, kept = [], trade.kept
    monkeypatch.setattr(trade, "kept", lambda rows, partition_by=(): written.append(rows) or kept(rows, partition_by))
    stored = flagged_trade(spark, SF)
    assert rows_of(stored.select(*df.columns)) == rows_of(df)
    trade.flagged_events(spark, SF)
    assert len(written) == 2 and not any(s in w._jdf.queryExecution().executedPlan().toString() for w in written for s in ("Sort", "rangepartitioning"))


def test_version_of_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x").write_text("1")
    (tmp_path / "a" / "b" / "y").write_text("2")
    first = version(spark, str(tmp_path / "a"))
    assert first == version(spark, str(tmp_path / "a"))
    (tmp_path / "a" / "b" / "y").write_text("22")
    assert version(spark, str(tmp_path / "a")) != first
    with pytest.raises(Exception, match="FileNotFound"):
        version(spark, str(tmp_path / "none"))


def test_readers_stay_with_their_version(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        snapshots.current(spark, path)
    old = snapshots.publish(spark.range(10), path)
    reader = snapshots.current(spark, path)
    new = snapshots.publish(spark.range(25), path)
    assert (old.count(), reader.count(), new.count(), snapshots.current(spark, path).count()) == (10, 10, 25, 25)
    spark.range(99).write.parquet(f"{path}/data=killed")  # a writer that died before its version was made known
    assert snapshots.current(spark, path).count() == 25
    snapshots.prune(spark, path, keep=1)
    assert len(snapshots.versions(spark, path)) == 1 and sorted(n[:5] for n in os.listdir(path) if n[0] == "d") == ["data="] * 2
    snapshots.prune(spark, path, keep=1, stale_hours=-1)
    assert sum(n[0] == "d" for n in os.listdir(path)) == 1 and snapshots.current(spark, path).count() == 25


def test_a_write_that_fails_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.publish(spark.range(10), path)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        snapshots.publish(spark.range(10).selectExpr("1 / (id - 5) AS id"), path)
    assert snapshots.current(spark, path).count() == 10 and len(snapshots.versions(spark, path)) == 1


def test_a_month_and_a_rule_read_a_fraction(spark, tmp_path):
    fact, path = flagged_trade(spark, "/root/testdata/sf0.01"), str(tmp_path / "t")
    frequent_first = [r.rule for r in flags.summary(fact, TRADE).collect()]
    clustered(fact, TRADE, frequent_first=frequent_first).write.option("parquet.page.row.count.limit", 500).option("parquet.block.row.count.limit", 1000).partitionBy("month").parquet(path)
    stored = spark.read.parquet(path)
    n = stored.count()
    assert n == fact.count() and rows_of(w.borough_summary(stored, TRADE)) == rows_of(w.borough_summary(fact, TRADE))
    month = w.activity_by_month(stored.where("month = 3"), TRADE)
    assert scanned(month) < 0.12 * n
    rule = stored.where("q_excessive_fare = 1")
    hit = rule.count()
    assert 0 < hit < 0.1 * n and scanned(rule.select("raw_id", "fare")) < 0.35 * n
    assert scanned(fact.where("q_excessive_fare = 1").select("raw_id")) <= n


def test_buckets_join_without_a_shuffle(spark):
    n = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        a = bucketed(spark.range(1000).selectExpr("id AS raw_id", "id % 7 AS x"), "raw_id", 4)
        b = bucketed(spark.range(500).selectExpr("id AS raw_id", "id % 5 AS y"), "raw_id", 4)
        joined = a.join(b, "raw_id")
        assert joined.count() == 500 and "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        raw, fact = (bucketed(d, "raw_id", 4) for d in (trade.landed_file(spark, SF).raw, trade.typed_file(spark, SF)))
        plan = transform.cast_losses(raw, fact)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange") == plan.count("Exchange SinglePartition") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", n)
    assert [bucket_count(r) for r in (0, 10, 4_000_000, 40_000_000)] == [4, 4, 4, 16]


def test_cast_losses_sorts_few_rows_and_only_what_it_compares(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(catalogue, "bucketed", lambda df, key, n: dealt.append((len(df.columns), n)) or bucketed(df, key, n))
    want = rows_of(catalogue.queries()["cast_losses"](spark, SF))
    monkeypatch.setattr(catalogue, "LOSS_ROWS", 100)
    assert rows_of(catalogue.queries()["cast_losses"](spark, SF)) == want
    compared, rows = 1 + len(transform.LOSS_COLUMNS), trade.landed_file(spark, SF).counts["read"]
    assert all(c == compared for c, _ in dealt) and dealt[2][1] > dealt[0][1] and rows / dealt[2][1] < 200


def made_cube(fact, numbers):
    return cube.build(fact, TRADE, CUBE, numbers)


def test_cubes_of_days_merge_into_that_of_all(spark):
    fact = flagged_trade(spark, SF)
    numbers = cube.numbers(fact.select(F.col("pu_zone").alias("name")))
    parts = [fact.where(F.dayofmonth("pickup_date") % 3 == k) for k in range(3)]
    merged = cube.merge([made_cube(p, numbers) for p in parts], CUBE)
    whole = made_cube(fact, numbers)
    for name in ("place", "time", "payment"):
        keys = [*CUBE.keys(), *CUBE.fixed()]
        exact = ["n", "sum_fare", "sum_total", "sum_distance", "count_mph", "greatest_distance", "least_pickup_date"]
        both = [rows_of(c.where(F.col("grain") == name).select(*keys, *exact)) for c in (merged, whole)]
        assert both[0] == both[1] and both[0]
    assert merged.where("grain = 'time'").agg(F.sum("n")).first()[0] == fact.count()
    asked = cube.Cube(merged, TRADE)
    assert rows_of(w.headline(asked, TRADE)) == rows_of(w.headline(fact, TRADE))
    assert rows_of(w.cleaning_impact(asked, TRADE)) == rows_of(w.cleaning_impact(fact, TRADE))
    assert rows_of(w.fare_per_mile(asked, TRADE, min_trips=5)) == rows_of(w.fare_per_mile(fact, TRADE, min_trips=5))
    assert rows_of(w.tipping_by_borough(asked, TRADE, min_trips=5)) == rows_of(w.tipping_by_borough(fact, TRADE, min_trips=5))


def test_numbers_of_names_stay(spark):
    known = cube.numbers(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "name string"))
    assert rows_of(known) == [("a", 1), ("b", 2)]
    assert rows_of(cube.numbers(spark.createDataFrame([("0",), ("b",), ("c",)], "name string"), known)) == [("0", 3), ("a", 1), ("b", 2), ("c", 4)]


def test_cube_of_names_beyond_one_bitmap_and_of_nothing(spark):
    fact = flagged_trade(spark, SF)
    numbers = cube.numbers(fact.select(F.col("pu_zone").alias("name"))).withColumn("number", F.col("number") * 20_000)
    assert w.headline(cube.Cube(made_cube(fact, numbers), TRADE), TRADE).first().pickup_zones == fact.select("pu_zone").distinct().count()
    none = cube.Cube(made_cube(fact.limit(0), numbers), TRADE)
    assert w.headline(none, TRADE).first()[:3] == (0, 0, 0) and w.borough_summary(none, TRADE).count() == 0
    assert rows_of(flags.measure_coverage(none, TRADE)) == rows_of(flags.measure_coverage(fact.limit(0), TRADE))


def test_null_groups_are_groups_of_their_own(spark):
    fact = flagged_trade(spark, SF).withColumn("pu_zone", F.when(F.col("pu_zone") != "FRANCE", F.col("pu_zone"))).withColumn("month", F.when(F.col("month") > 2, F.col("month")))
    asked = cube.Cube(made_cube(fact, cube.numbers(fact.select(F.col("pu_zone").alias("name")))), TRADE)
    for f in (w.busiest_zones, w.activity_by_month, w.headline, w.od_pairs):
        assert rows_of(f(asked, TRADE)) == rows_of(f(fact, TRADE))


def test_ranks_of_odd_values(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FETCHED", 100)
    rnd = np.random.default_rng(1)
    values = [float(v) for v in rnd.standard_cauchy(30_000)] + [7.5] * 9_000 + [float("inf")] * 3 + [float("-inf")] * 2 + [float("nan")] * 4
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "v double").repartition(7)
    wanted = [0, 1, 2, 20, 15_000, 25_000, 38_999, 39_001, 39_002, 39_004, 39_005, 39_008]
    ordered = sorted(v for v in values if v == v) + [float("nan")] * 4
    assert np.array_equal(ranks.at_ranks(df, {"v": (F.col("v"), wanted)})["v"], [ordered[k] for k in wanted], equal_nan=True)
    with pytest.raises(ValueError):
        ranks.at_ranks(df, {"v": (F.col("v"), [len(values)])})


def test_a_bracket_without_its_rank_is_opened(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SKETCH", 8)
    monkeypatch.setattr(ranks, "SKETCH_ERROR", 1e-6)
    df = spark.range(50_000).selectExpr("CAST((id * 7919) % 50000 AS DOUBLE) AS v")
    assert ranks.at_ranks(df, {"v": (F.col("v"), [123, 25_000, 49_000])})["v"] == [123.0, 25_000.0, 49_000.0]


def test_far_from_zero_nothing_cancels(spark):
    rnd = np.random.default_rng(4)
    x, z = 1e9 + rnd.random(5000), 3e9 + rnd.random(5000)
    y = 2.5 * (x - 1e9) + 0.5 * (z - 3e9) + 1e9 + rnd.random(5000) / 100
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, z, y)], "x double, z double, y double").repartition(9)
    n, found = tariff.moments(df, F.col("x"), F.col("z"), F.col("y"))
    base, a, b = tariff.solve(*found)
    centred = np.column_stack([x - x.mean(), z - z.mean()])
    want = np.linalg.lstsq(centred, y - y.mean(), rcond=None)[0]
    assert n == 5000 and np.allclose([a, b], want, rtol=1e-6)
    assert abs(base + a * x.mean() + b * z.mean() - y.mean()) < 1e-5
    assert np.allclose(found[3:], [np.var(x), np.cov(x, z, bias=True)[0, 1], np.var(z), np.cov(x, y, bias=True)[0, 1], np.cov(z, y, bias=True)[0, 1]], rtol=1e-6, atol=1e-9)
    assert tariff.solve(1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0) == (3.0, 0.0, 0.0)


def test_another_session_asks_the_stored_tariff(spark, tmp_path, monkeypatch):
    t = tariff.Tariff(2.0, 2.5, 0.5, {2: 70.0, 5: 12.345}, 1, 0.25, 1.5)
    tariff.publish(spark, t, str(tmp_path / "tariff"))
    monkeypatch.setattr(tariff, "calibrate", None)
    other = spark.newSession()
    again = tariff.published(other, str(tmp_path / "tariff"))
    assert again == t
    tariff.deploy_sql(other, again)
    rows = [(1, 2.0, 10.0), (2, 5.0, 1.0), (None, 1.0, 1.0), (1, None, 1.0), (3, 1.0, 1.0), (1, -9.0, 1.0), (2, None, None), (5, 1.0, 1.0), (1, 0.13, 7.77)]
    other.createDataFrame(rows, "rate_code int, distance double, minutes double").createOrReplaceTempView("asked")
    got = other.sql("SELECT tariff_fare(rate_code, distance, minutes) AS fare FROM asked")
    assert [r.fare for r in got.collect()] == [tariff.python_fare(t)(*r) for r in rows]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    tariff.deploy_sql(spark, t, "lasting_fare", lasting=True)
    assert spark.newSession().sql("SELECT lasting_fare(2, 1D, 1D) AS fare").first().fare == 70.0
    spark.sql("DROP FUNCTION lasting_fare")


def test_a_lost_row_is_noticed(spark):
    landed, zones = trade.landed_file(spark, SF), trade.nation_zones(spark, SF)
    accounting = transform.Accounting()
    fact, rejects = transform.cast_and_enrich(landed.raw, zones, accounting=accounting)
    n = fact.count()
    assert accounting.check() == {"landed": landed.counts["read"] - landed.counts["malformed"], "kept": n, "rejected": rejects.count()}
    twice = transform.Accounting()
    transform.cast_and_enrich(landed.raw, zones.unionByName(zones), check=False, accounting=twice)[0].write.format("noop").mode("overwrite").save()
    with pytest.raises(RuntimeError, match="landed"):
        twice.check()


def test_files_of_a_folder_have_one_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n2,1\n")
    with pytest.raises(Exception, match="header|HEADER"):
        landing.keep_landed(landing.land_csv(spark, str(tmp_path), {"x": "a", "y": "b"}), str(tmp_path / "raw"))


def test_rows_are_added_without_copying(spark, tmp_path):
    path = str(tmp_path / "t")
    part = lambda a, b: spark.range(a, b).selectExpr("id", "CAST(id % 3 AS INT) AS month")
    snapshots.publish(part(0, 10), path, ("month",))
    reader = snapshots.current(spark, path)
    kept_files = {f for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    assert snapshots.add(part(10, 15), path, ("month",)).count() == 5
    both = snapshots.current(spark, path)
    assert (reader.count(), both.count(), sorted(both.columns), both.where("month = 1").count()) == (10, 15, ["id", "month"], 5)
    assert kept_files < {f for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    snapshots.add(both.selectExpr("id + 100 AS id", "month"), path, ("month",))
    snapshots.prune(spark, path, keep=1)
    assert snapshots.current(spark, path).count() == 30 and len(snapshots.versions(spark, path)) == 1
    snapshots.publish(part(0, 1), path, ("month",))
    snapshots.prune(spark, path, keep=1)
    assert snapshots.current(spark, path).count() == 1 and sum(n.startswith("data=") for n in os.listdir(path)) == 1


def test_who_adds_at_once_with_another_is_told(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    snapshots.publish(spark.range(10), path)
    written = snapshots._written

    def slow(df, at, partition_by):
        monkeypatch.setattr(snapshots, "_written", written)
        snapshots.add(spark.range(3), path)
        return written(df, at, partition_by)

    monkeypatch.setattr(snapshots, "_written", slow)
    with pytest.raises(RuntimeError, match="meanwhile"):
        snapshots.add(spark.range(5), path)
    assert snapshots.current(spark, path).count() == 13


def test_a_day_added_gives_what_building_all_gives(spark, tmp_path):
    lines = trade.event_lines(spark, SF)
    trade.write_lines(lines.where("line NOT LIKE '%7,%'"), str(tmp_path / "days/one"))
    trade.write_lines(lines.where("line LIKE '%7,%'"), str(tmp_path / "days/two"))
    zones = spark.read.parquet(f"{SF}/nation.parquet").selectExpr("n_nationkey AS LocationID", "concat('B', n_regionkey) AS Borough", "n_name AS Zone", "'x' AS service_zone")
    zones.write.option("header", True).csv(str(tmp_path / "zones"))
    for d in ("one", "two"):
        shutil.copytree(tmp_path / "days" / d, tmp_path / "all", dirs_exist_ok=True)
    zones_at = str(tmp_path / "zones")
    limits = {"period_start": "2024-01-02 00:00:00", "period_end": "2024-01-29 00:00:00"}
    whole = build.build(spark, str(tmp_path / "all"), zones_at, str(tmp_path / "a"), limits)
    first = build.build(spark, str(tmp_path / "days/one"), zones_at, str(tmp_path / "b"), limits)
    day = build.append(spark, str(tmp_path / "days/two"), str(tmp_path / "b"), limits)
    assert first.count() > 0 and day.count() > 0 and first.count() + day.count() == whole.count()
    stored = snapshots.current(spark, str(tmp_path / "b/flagged"))
    assert stored.select("raw_id").distinct().count() == stored.count() == whole.count()
    for table in ("raw", "rejects", "trips"):
        assert snapshots.current(spark, str(tmp_path / "a" / table)).count() == snapshots.current(spark, str(tmp_path / "b" / table)).count()
    asked = [build.cubed(spark, str(tmp_path / x)) for x in "ab"]
    for f in (w.headline, w.cleaning_impact, w.borough_summary, w.activity_by_hour, flags.summary, flags.measure_coverage):
        assert rows_of(f(asked[1], TRIPS)) == rows_of(f(asked[0], TRIPS)) == rows_of(f(stored, TRIPS)), f.__name__
    again = build.reflag(spark, str(tmp_path / "b"), limits | {"max_fare": 10})
    assert again.agg(F.sum("q_excessive_fare")).first()[0] > stored.agg(F.sum("q_excessive_fare")).first()[0]
    assert rows_of(flags.summary(build.cubed(spark, str(tmp_path / "b")), TRIPS)) == rows_of(flags.summary(again, TRIPS))


def test_lines_of_added_files_are_made_once_dealt_to_all_tasks_and_compiled(spark, monkeypatch):
    written, write = [], trade.write_lines
    monkeypatch.setattr(trade, "_added", {})
    monkeypatch.setattr(trade, "write_lines", lambda lines, path, *by: written.append(path) or write(lines, path, *by))
    trade.added_files(spark, SF)
    assert len(written) == 1
    later, header = F.col("line").rlike("^[0-9]*[02468],"), ",".join(build.TRIP_COLUMNS.values())
    for folder, part in (("later=false", ~later), ("later=true", later)):
        assert rows_of(spark.read.text(f"{written[0]}/{folder}").where(F.col("value") != header)) == rows_of(trade.event_lines(spark, SF).where(part))
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        execution = trade.event_lines(spark, SF)._jdf.queryExecution()
        code = execution.debug().codegenToSeq()
        assert "Exchange hashpartitioning(event_id" in execution.executedPlan().toString()
        # Java compiles no method that is larger.
        assert code.size() and max(code.apply(k)._3().maxMethodCodeSize() for k in range(code.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_added_files_of_which_one_has_no_lines(spark, folder):
    some = spark.read.parquet(f"{SF}/events.parquet").where("event_id % 2 = 1").toPandas()
    some.to_parquet(f"{folder}/odd.parquet", coerce_timestamps="us")
    os.replace(f"{folder}/odd.parquet", f"{folder}/events.parquet")
    kept = trade.typed_file(spark, folder).count()
    assert 0 < kept < len(some) and w.headline(trade.added_files(spark, folder), trade.FILE).first().trips == kept


def test_what_a_settled_step_made_on_the_way_is_deleted(spark):
    other, other_at = scratch.kept(spark.range(3))
    between = []

    def step():
        for n in (5, 7):
            between.append(scratch.kept(spark.range(n)))
        return between[0][0].join(between[1][0], "id")

    out, path = scratch.settled(step)
    assert out.count() == 5 and other.count() == 3 and scratch.there(path) and scratch.there(other_at)
    assert not any(scratch.there(at) or os.path.exists(at) for _, at in between)
    scratch.discard(path, other_at)


def test_files_by_command_line(spark, tmp_path, capsys):
    lines = trade.event_lines(spark, SF)
    trade.write_lines(lines.where("line RLIKE '^[0-9]*[02468],'"), str(tmp_path / "one"))
    trade.write_lines(lines.where("line NOT RLIKE '^[0-9]*[02468],'"), str(tmp_path / "two"))
    zones = spark.read.parquet(f"{SF}/nation.parquet").selectExpr("n_nationkey AS LocationID", "concat('B', n_regionkey) AS Borough", "n_name AS Zone", "'x' AS service_zone")
    zones.write.option("header", True).csv(str(tmp_path / "zones"))
    out = ["--out", str(tmp_path / "out")]
    cli.main(["pipeline", "--trips", str(tmp_path / "one"), "--zones", str(tmp_path / "zones"), *out])
    assert "outside_period" in capsys.readouterr().out
    before = snapshots.current(spark, str(tmp_path / "out/flagged")).count()
    tariff.publish(spark, tariff.Tariff(2.0, 2.5, 0.5, {2: 70.0}, 1, 0.25, 1.5), str(tmp_path / "out/tariff"))
    cli.main(["append", "--trips", str(tmp_path / "two"), *out])
    assert " trips added" in capsys.readouterr().out and snapshots.current(spark, str(tmp_path / "out/flagged")).count() > before
    cli.main(["figures", *out])
    shown = capsys.readouterr().out
    assert "typical_miles" in shown and "off_tariff" in shown
    with pytest.raises(SystemExit):
        cli.main(["append", *out])
