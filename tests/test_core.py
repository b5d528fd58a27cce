import json
from datetime import date
from decimal import Decimal
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone import cli
from siltstone.functions.expressions import plain
from siltstone.operators import flags, ranks, tariff, transform
from siltstone.operators.registry import Registry, Rule
from siltstone.plans import build, catalogue, compare, payloads
from siltstone.plans import workflows as w
from siltstone.plans.rules import TRIPS
from siltstone.plans.trade import FILE, TRADE, flagged_trade, landed_file, trade_cube, typed_file
from siltstone.sources import landing, scratch, snapshots

SF = "/root/testdata/sf0.001"
HEADER = "ehail_fee,pickup,dropoff,store_and_fwd,vendor,rate_code,payment_type,trip_type,passengers,extra,mta_tax,tip,tolls,improvement,congestion,distance,fare,total,pu_location,do_location"
GOOD = dict(pickup="03/04/2023 12:26:10 AM", dropoff="03/04/2023 12:36:10 AM", store_and_fwd="N", vendor="1", rate_code="1", payment_type="1", trip_type="1", passengers="1", extra="0", mta_tax="0.5", tip="2", tolls="0", improvement="0", congestion="", distance="2", fare="10", total="12.5", pu_location="1", do_location="2", ehail_fee="")


def fact_of(spark, tmp_path, *changes):
    lines = [HEADER] + [",".join(f'"{v}"' if "," in (v := {**GOOD, **c}[h]) else v for h in HEADER.split(",")) for c in changes]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    raw = landing.keep_landed(landing.land_csv(spark, str(tmp_path / "t.csv"), {h: h for h in HEADER.split(",")}), str(tmp_path / "raw")).raw
    zones = spark.createDataFrame([(1, "Queens", "Astoria", ""), (2, "Bronx", "Fordham", ""), (264, "Unknown", "N/A", "")], "location_id int, borough string, zone string, service_zone string")
    return raw, *transform.cast_and_enrich(raw, zones)


def test_landing_casts_and_rejects(spark, tmp_path):
    raw, fact, rejects = fact_of(spark, tmp_path, {}, {"pickup": "03/04/2023 12:00:00 PM", "dropoff": "03/04/2023 11:59:59 PM", "distance": "2,032.67"}, {"pickup": "2023-03-04"}, {"pickup": "99/04/2023 01:00:00 AM"}, {"pickup": ""}, {"fare": "abc", "pu_location": "9999"})
    assert (raw.count(), fact.count(), rejects.count()) == (6, 3, 3)
    first, noon, odd = fact.orderBy("raw_id").collect()
    assert (first.hour, float(first.minutes), float(first.mph), float(first.tip_pct), first.congestion) == (0, 10.0, 12.0, 20.0, None)
    assert (noon.hour, float(noon.distance)) == (12, 2032.67)
    assert (odd.fare, odd.pu_borough, odd.do_zone) == (None, "Unknown", "Fordham")
    assert [r.reason for r in rejects.orderBy("raw_id").collect()] == ["timestamp of another shape", "no such time", "missing timestamp"]
    issues = {r.issue: r["rows"] for r in transform.profile_raw(raw).collect()}
    assert issues["distance: thousands separated by commas"] == 1 and issues["fare: no number even without commas"] == 1 and issues["ehail_fee missing"] == 6


def test_build_from_files_and_flag_anew(spark, tmp_path):
    rows = [{}, {"pickup": "no time"}, {"distance": "5"}, {"distance": "1,200", "pu_location": "3"}]
    lines = [",".join(build.TRIP_COLUMNS.values())] + [",".join(f'"{v}"' if "," in (v := {**GOOD, **r}[c]) else v for c in build.TRIP_COLUMNS) for r in rows]
    (tmp_path / "trips.csv").write_text("\n".join(lines))
    (tmp_path / "zones.csv").write_text("LocationID,Borough,Zone,service_zone\n1,Queens,Astoria,x\n2,Bronx,Fordham,x\nnone,x,x,x")
    flagged = build.build(spark, str(tmp_path / "trips.csv"), str(tmp_path / "zones.csv"), str(tmp_path / "out"))
    assert [(float(r.distance), r.pu_borough, r.q_excessive_distance, r.q_unknown_zone) for r in flagged.orderBy("raw_id").collect()] == [(2, "Queens", 0, 0), (5, "Queens", 0, 0), (1200, "Unknown", 1, 1)]
    assert snapshots.current(spark, str(tmp_path / "out/rejects")).count() == 1 and snapshots.current(spark, str(tmp_path / "out/zones")).count() == 2
    again = build.reflag(spark, str(tmp_path / "out"), {"max_distance": 4})
    assert again.agg(F.sum("q_excessive_distance")).first()[0] == 2


FIRES = {
    "non_positive_distance": ({"distance": "0"}, {"distance": "0.01"}),
    "non_positive_duration": ({"dropoff": GOOD["pickup"]}, {"dropoff": "03/04/2023 12:26:50 AM"}),
    "implausibly_short": ({"dropoff": "03/04/2023 12:26:20 AM"}, {"dropoff": "03/04/2023 12:26:40 AM"}),
    "excessive_duration": ({"dropoff": "03/04/2023 12:26:11 PM"}, {"dropoff": "03/04/2023 12:26:10 PM"}),
    "excessive_distance": ({"distance": "150.01"}, {"distance": "150"}),
    "negative_amount": ({"fare": "-1"}, {"fare": "0"}),
    "excessive_fare": ({"fare": "500.01"}, {"fare": "500"}),
    "implausible_speed": ({"distance": "14"}, {"distance": "13"}),
    "stalled_trip": ({"distance": "0.05"}, {"distance": "0.09"}),
    "total_mismatch": ({"total": "13.51"}, {"total": "13.50"}),
    "disproportionate_tip": ({"tip": "30.01"}, {"tip": "30"}),
    "outside_period": ({"pickup": "12/31/2022 11:59:59 PM"}, {"pickup": "01/01/2023 12:00:00 AM"}),
    "unknown_zone": ({"pu_location": "264"}, {"pu_location": "2"}),
    "missing_passengers": ({"passengers": ""}, {"passengers": "2"}),
}


def test_each_rule_fires_just_beyond_its_limit(spark, tmp_path):
    assert FIRES.keys() == {r.name for r in TRIPS.rules}
    _, fact, _ = fact_of(spark, tmp_path, *(c for pair in FIRES.values() for c in pair))
    got = flags.apply_rules(fact, TRIPS).orderBy("raw_id").collect()
    for k, name in enumerate(FIRES):
        assert (got[2 * k][f"q_{name}"], got[2 * k + 1][f"q_{name}"]) == (1, 0), name


def test_registry_refuses_what_it_cannot_use():
    rule = Rule("r", "warn", "", "true", ("nothing",), (("x", "true"),))
    with pytest.raises(KeyError):
        Registry({"m": ""}, (rule,))
    with pytest.raises(KeyError):
        TRIPS.limits({"no_such": 1})
    with pytest.raises(KeyError):
        TRIPS.affecting("no_such")
    assert {m: len(TRIPS.affecting(m)) for m in TRIPS.measures} == dict(trip_count=1, location=1, time=2, distance=4, duration=5, speed=7, fare=2, tip=2, total=3, fee_breakdown=2, passengers=1)


def test_browse_names_rules_and_cells(spark, tmp_path):
    raw, fact, _ = fact_of(spark, tmp_path, {"fare": "-1", "total": "-5", "passengers": "0", "do_location": "77"}, {})
    rows = flags.browse(flags.apply_rules(fact, TRIPS), TRIPS, "all", 5, raw).collect()
    assert rows[0].flags == "negative_amount, total_mismatch, unknown_zone, missing_passengers" and rows[0].fare_text == "-1"
    assert rows[0].tested == {"negative_amount": ["fare", "total"], "total_mismatch": ["total"], "unknown_zone": ["do_zone"], "missing_passengers": ["passengers"]}
    assert rows[1].flags == "—" and rows[1].tested == {}


def test_empty_fact(spark):
    fact = flagged_trade(spark, SF).limit(0)
    assert all(r.pct_of_trips == 0 for r in flags.summary(fact, TRADE).collect())
    assert w.borough_summary(fact, TRADE).count() == 0 and w.headline(fact, TRADE).first().trips == 0
    with pytest.raises(RuntimeError):
        tariff.calibrate(fact)
    with pytest.raises(ValueError):
        w.busiest_zones(fact, TRADE, "sideways")


def test_udf_and_expression_agree(spark):
    t = tariff.Tariff(2.0, 2.5, 0.5, {2: 70.0}, 1, 0, 0)
    rows = [(1, 2.0, 10.0), (2, 5.0, 1.0), (None, 1.0, 1.0), (1, None, 1.0), (3, 1.0, 1.0), (1, -9.0, 1.0), (2, None, None)]
    df = spark.createDataFrame(rows, "rate_code int, distance double, minutes double")
    udf = tariff.deploy(spark, t)
    got = df.select(udf("rate_code", "distance", "minutes").alias("a"), tariff.expected_fare(t).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] == [12.0, 70.0, None, None, None, 0.0, 70.0] == [tariff.python_fare(t)(*r) for r in rows]


def test_arms_agree(spark):
    fact = flagged_trade(spark, SF)
    fit = tariff.calibrate(fact, catalogue.BOUNDS)
    alone = compare.compare_aggregation(fact, 1, fit)
    assert len(alone) == 12 and alone[alone["arm"] == "pandas"]["seconds"].isna().all() and (alone[alone["arm"] != "pandas"]["rows_moved"] < 30).all()
    report = compare.compare_aggregation(fact, 1, fit, most_rows=10_000)
    assert len(report) == 12 and (report["note"] == "").all() and set(report["question"]) == set(compare.QUESTIONS)
    pulled = report[report["arm"] == "pandas"]
    assert (pulled["seconds"] == pulled["fetch"] + pulled["reduce"]).all() and (pulled["rows_moved"] > 500).all()
    assert (report[report["arm"] == "sql"]["rows_moved"] < 30).all()
    assert len(compare.compare_aggregation(fact, 1, most_rows=10_000)) == 9


def test_an_arm_that_fails_is_reported(spark, monkeypatch):
    def broken(batches):
        raise ValueError("no such arm")

    monkeypatch.setattr(compare, "_in_batches", broken)
    report = compare.compare_aggregation(flagged_trade(spark, SF), 1)
    assert len(report) == 9 and report[report["arm"] == "arrow"]["seconds"].isna().all()


def test_three_ways_to_land_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n" + "".join(f"{k},\n" if k % 3 else f"{k},x\n" for k in range(100)))
    report = compare.compare_ingest(spark, str(tmp_path / "t.csv"), str(tmp_path / "out"), 60, 25, 2).set_index("approach")
    assert report["rows"].to_dict() == {"bulk": 60, "batched": 60, "row at a time": 2}
    assert (report["projected_seconds"] > report["seconds"]).all()
    batched = spark.read.parquet(str(tmp_path / "out/batch25"))
    assert batched.count() == 60 and batched.where("b is null").count() == 40


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], list(range(10_000)), [5.0] * 6000 + [1e9], [k % 7 for k in range(9000)], [-1e300, 0.0, 1e-300, 1e300]])
def test_ranks_are_exact(spark, values, monkeypatch):
    monkeypatch.setattr(ranks, "FETCHED", 10)
    df = spark.createDataFrame([(float(v), None if k % 2 else -float(v)) for k, v in enumerate(values)], "a double, b double")
    wanted, other = sorted({0, len(values) // 3, len(values) - 1}), [0]
    got = ranks.at_ranks(df, {"a": (F.col("a"), wanted), "b": (F.col("b"), other)})
    assert got["a"] == [sorted(map(float, values))[k] for k in wanted] and got["b"] == [min(-float(v) for v in values[::2])]
    assert np.allclose(ranks.percentiles(df, F.col("a"), len(values), [0.5, 0.95]), np.percentile(np.array(values, float), [50, 95]))


def test_a_stored_fact_that_is_gone_is_built_anew(spark):
    n = flagged_trade(spark, SF).count()
    assert flagged_trade(spark, SF) is flagged_trade(spark, SF)
    scratch.release()
    assert flagged_trade(spark, SF).count() == n


def test_on_a_cluster_the_shared_folder_must_be_set():
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(unset)


def test_thresholds_of_nothing(spark):
    assert [r.value for r in flags.derive_thresholds(flagged_trade(spark, SF).limit(0)).collect()] == [None] * 3


def test_ends_without_a_zone_are_kept(spark, tmp_path):
    _, fact, _ = fact_of(spark, tmp_path, {"pu_location": "77"}, {"do_location": ""}, {"pu_location": "2", "do_location": "1"})
    got = [(r.pu_borough, r.pu_zone, r.do_borough, r.do_zone) for r in fact.orderBy("raw_id").collect()]
    assert got == [("Unknown", "Unknown", "Bronx", "Fordham"), ("Queens", "Astoria", "Unknown", "Unknown"), ("Bronx", "Fordham", "Queens", "Astoria")]


def test_a_dimension_with_an_id_twice_is_refused(spark, tmp_path):
    raw, _, _ = fact_of(spark, tmp_path, {})
    zones = spark.createDataFrame([(1, "a", "b", "")] * 2, "location_id int, borough string, zone string, service_zone string")
    with pytest.raises(RuntimeError):
        transform.cast_and_enrich(raw, zones)


def test_diagnostics_show_the_lines_of_another_length(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n3\n4,5,6\n7,8\n")
    landed = landing.keep_landed(landing.land_csv(spark, str(tmp_path / "t.csv"), {"x": "a", "y": "b"}), str(tmp_path / "raw"))
    assert [r.line for r in landing.diagnostics(landed).collect()] == ["3", "4,5,6"] and landed.counts == {"read": 4, "malformed": 2}
    assert sorted((r.x, r.y) for r in landed.raw.collect()) == [("1", "2"), ("7", "8")] and landed.raw.columns == ["x", "y", "raw_id"]
    with pytest.raises(KeyError):
        landing.land_csv(spark, str(tmp_path / "t.csv"), {"x": "c"})


def test_browse_with_raw_keeps_the_order(spark, tmp_path):
    same = {"fare": "-1", "total": "-2"}
    raw, fact, _ = fact_of(spark, tmp_path, {**same, "pu_location": "2"}, {**same, "pu_location": "1"}, {**same, "pu_location": "1", "do_location": "1"}, {})
    rows = flags.browse(flags.apply_rules(fact, TRIPS), TRIPS, "all", 4, raw).collect()
    assert [(r.pu_zone, r.do_zone) for r in rows] == [("Astoria", "Astoria"), ("Astoria", "Fordham"), ("Fordham", "Fordham"), ("Astoria", "Fordham")]


def test_payloads_are_json(spark):
    fact = flagged_trade(spark, SF)
    pages = [payloads.overview(fact, TRADE), payloads.quality(fact, TRADE, 2), payloads.sample(fact, TRADE, "excessive_fare", 1000), payloads.rows(fact, TRADE, "all", 3)]
    pages += [payloads.zones(fact, TRADE), payloads.times(fact, TRADE), payloads.pairs(fact, TRADE), payloads.tipping(fact, TRADE, min_trips=1)]
    json.dumps(pages, allow_nan=False)
    assert len(pages[0]["cleaning_impact"]) == 7 and len(pages[1]["rules"]) == 14 and len(pages[2]["rows"]) <= 100 and len(pages[3]["rows"]) == 3
    assert pages[3]["matching"] == fact.count() and len(pages[5]["heatmap"]["matrix"][0]) == 24
    assert sum(map(sum, pages[5]["heatmap"]["matrix"])) == sum(d["trips"] for d in pages[5]["day_of_week"])
    asked = trade_cube(spark, SF)
    assert [payloads.overview(asked, TRADE), payloads.quality(fact, TRADE, 2, asked), payloads.zones(asked, TRADE), payloads.times(asked, TRADE), payloads.pairs(asked, TRADE), payloads.tipping(asked, TRADE, min_trips=1)] == [pages[k] for k in (0, 1, 4, 5, 6, 7)]
    with pytest.raises(KeyError):
        payloads.rows(fact, TRADE, "no_such_rule")
    odd = {"a": [Decimal("1.50"), float("nan"), float("-inf")], 2: (date(2024, 1, 2), None, "x", True)}
    assert plain(odd) == {"a": [1.5, None, None], "2": ["2024-01-02", None, "x", True]}


# The keys of each page and of the entries of its lists, as a dashboard asks for them.
SHAPES = {
    "overview": {"headline": "trips clean_trips pickup_zones first_pickup last_pickup total_revenue typical_miles typical_minutes typical_fare", "cleaning_impact": "metric depends_on all_rows strict_clean selective", "issue_distribution": "issues trips pct", "boroughs": "borough trips avg_miles avg_fare avg_total avg_tip_pct revenue", "coverage": "measure meaning rules usable_rows pct_of_trips"},
    "quality": {"rules": "rule severity flagged description invalidates pct_of_trips", "issue_distribution": "issues trips pct", "reconciliation": "discrepancy trips avg_mta_tax avg_improvement avg_congestion congestion_null", "thresholds": None, "coverage": "measure meaning rules usable_rows pct_of_trips"},
    "sample": {"rule": None, "rows": "PickupDateTime DropoffDateTime TripMinutes TripDistance AvgMph FareAmount TipAmount TotalAmount PUZoneName DOZoneName QualityIssueCount"},
    "rows": {"rule": None, "matching": None, "rows": "PickupDateTime DropoffDateTime PUZoneName DOZoneName PassengerCount TripDistance TripMinutes AvgMph FareAmount TipAmount TotalAmount Flags Issues Tested", "rules": "name severity description"},
    "zones": {"exclude_invalid": None, "pickup": "borough zone trips avg_miles avg_minutes avg_fare avg_tip_pct", "dropoff": "borough zone trips avg_miles avg_minutes avg_fare avg_tip_pct", "boroughs": "borough trips avg_miles avg_fare avg_total avg_tip_pct revenue", "fare_per_mile": "borough zone trips fare_per_mile avg_miles avg_fare avg_mph"},
    "times": {"exclude_invalid": None, "hour": "pickup_hour trips avg_mph avg_minutes avg_fare", "day_of_week": "dow day trips avg_miles avg_fare avg_tip_pct", "month": "month_num month_name trips avg_miles avg_fare revenue", "heatmap": "days hours matrix"},
    "pairs": {"exclude_invalid": None, "cross_borough_only": None, "pairs": "from_borough from_zone to_borough to_zone trips avg_miles avg_minutes avg_total"},
    "tipping": {"tipping": "borough payment_type payment trips avg_tip_pct avg_tip avg_fare"},
}


def test_payloads_have_the_dashboards_shapes(spark):
    cube, fact, raw = trade_cube(spark, SF), typed_file(spark, SF), landed_file(spark, SF).raw
    pages = {n: getattr(payloads, n)(cube, TRADE) for n in ("overview", "zones", "times", "pairs")} | {"tipping": payloads.tipping(cube, TRADE, min_trips=1)}
    pages |= {"quality": payloads.quality(flagged_trade(spark, SF), TRADE, 2, cube), "sample": payloads.sample(flagged_trade(spark, SF), TRADE, "excessive_fare"), "rows": payloads.rows(fact, FILE, "all", 12, raw)}
    assert pages["zones"]["fare_per_mile"] == [] and len(pages["sample"]["rows"]) == 12 and len(pages["rows"]["rows"]) == 12
    pages["zones"]["fare_per_mile"] = payloads.records(w.fare_per_mile(cube, TRADE, 3, 1))
    for name, shape in SHAPES.items():
        assert set(pages[name]) == set(shape), name
        for key, names in shape.items():
            if names:
                one = pages[name][key] if isinstance(pages[name][key], dict) else pages[name][key][0]
                assert set(one) == set(names.split()), (name, key)


@pytest.mark.parametrize("command", [["info"], ["profile"], ["quality", "--derive-thresholds", "--sample", "excessive_fare"], ["analyze"]])
def test_command_line(spark, capsys, command):
    cli.main([*command, "--data", SF])
    out = capsys.readouterr().out
    assert {"info": "lineitem: ", "profile": "timestamp of another shape", "quality": "derived", "analyze": "off_tariff"}[command[0]] in out


def test_flagging_a_stream(spark, tmp_path):
    from siltstone.streaming.flagging import flag_stream

    fact = flagged_trade(spark, SF).drop("issue_count", *(r.flag for r in TRADE.rules))
    fact.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fact.schema).parquet(str(tmp_path / "in"))
    flag_stream(stream, TRADE, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("issue_count")).first()[0]
    assert got == flagged_trade(spark, SF).agg(F.sum("issue_count")).first()[0]
