"""Edge rows of the operators, by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from estuary.functions import geometry, masking, text, times
from estuary.operators import absorption, asof, models, panel, replay, sets, simulate, stats
from estuary.sources import archive, sealed
from estuary.streaming import flows

S = 1_000_000


def test_panel_edges(spark):
    trades = spark.createDataFrame(
        [(1, "a", 90 * S, 0.4, "yes"), (2, "a", 90 * S, 0.6, "yes"), (3, "a", 100 * S, 0.9, "yes"), (4, "a", 110 * S, 0.7, "yes"), (5, "b", 10 * S, 0.5, "yes"), (6, "b", 105 * S, 0.6, "yes"), (7, "c", 95 * S, 0.2, "yes"), (8, "c", 104 * S, 0.3, None)],
        "trade_id long, contract string, time long, price double, axis string",
    )
    events = spark.createDataFrame([(1, 100 * S, True, False), (2, 100 * S, False, False)], "event_id long, at long, rule_known boolean, closed_before boolean")
    grid = spark.createDataFrame([(1, c) for c in "abcd"] + [(2, "a")], "event_id long, contract string")
    settings = panel.PanelSettings(95 * S, 60 * S, 20 * S, 30 * S, (10 * S, 60 * S))
    got = {(r["event_id"], r["contract"], r["horizon"] // S): r for r in panel.trade_panel(trades, events, grid, settings).collect()}
    assert len(got) == 10
    r = got[1, "a", 10]
    assert (r["baseline"], r["endpoint"], r["baseline_ids"], r["valid"]) == (pytest.approx(0.5), 0.7, [1, 2], True)
    assert r["response"] == pytest.approx(0.2)
    assert got[1, "a", 60]["exclusion_reason"] == "endpoint_beyond_cap" and got[1, "a", 60]["response"] is None and got[1, "a", 60]["endpoint"] == 0.7
    assert got[1, "b", 10]["exclusion_reason"] == "stale_baseline"
    assert got[1, "c", 10]["exclusion_reason"] == "mixed_axis"
    assert got[1, "d", 10]["exclusion_reason"] == "missing_baseline" and got[1, "d", 10]["n_pre"] == 0
    assert got[2, "a", 10]["exclusion_reasons"] == ["rule_evidence_missing"]
    assert [r[0] for r in panel.undeclared(events, grid.where("event_id = 1")).collect()] == [2]


def test_asof_ties_and_strictness(spark):
    records = spark.createDataFrame([("a", 10, 1, 0.1), ("a", 20, 2, 0.2), ("a", 20, 3, 0.3), ("b", None, 4, 0.4)], "k string, time long, id long, v double")
    probes = spark.createDataFrame([("a", 5), ("a", 20), ("a", 25), ("b", 30)], "k string, at long")
    got = lambda strict: {(r["k"], r["at"]): r["matched_id"] for r in asof.asof_last(probes, records, ["k"], "at", "time", "id", ["v"], strict).collect()}
    assert got(False) == {("a", 5): None, ("a", 20): 3, ("a", 25): 3, ("b", 30): None}
    assert got(True) == {("a", 5): None, ("a", 20): 1, ("a", 25): 3, ("b", 30): None}


def test_masks(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, -1.0)], "id int, x double")
    got = masking.masked(df, [(F.col("x").isNull(), "unknown"), (F.col("x") < 0, "negative"), (F.col("id") == 3, "third")], ["x"])
    assert [(r["exclusion_reason"], r["valid"], r["x"]) for r in got.orderBy("id").collect()] == [(None, True, 1.0), ("unknown", False, None), ("negative", False, None)]
    back = masking.unmasked_if_only(got, ["unknown"], ["id"], {"x": F.lit(0.5)}).orderBy("id").collect()
    assert [(r["valid"], r["x"]) for r in back] == [(True, 1.0), (True, 0.5), (False, None)]


def test_union_by_precedence(spark):
    a = spark.createDataFrame([("x", 1, None), ("y", None, "p")], "id string, n int, s string")
    b = spark.createDataFrame([("x", 2, "q"), ("z", 3, "r")], "id string, n int, s string")
    got = {r["id"]: (r["n"], r["s"], r["origin"]) for r in sets.union_by_precedence([("live", a), ("archive", b)], "id", ["n", "s"]).collect()}
    assert got == {"x": (1, "q", "live_and_archive"), "y": (None, "p", "live_only"), "z": (3, "r", "archive_only")}


def test_spacing(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 60, 240, 250)], "k string, t long")
    for bucket in (100, 10_000):
        spaced = sets.spacing(df, ["k"], "t", 60, bucket)
        assert {r["t"]: (r["off_grid"], r["missing"]) for r in spaced.collect()} == {0: (False, 0), 60: (False, 0), 240: (False, 2), 250: (True, 0)}
    assert sorted(r["stamp"] for r in sets.missing_stamps(spaced, ["k"], "t", 60).collect()) == [120, 180]
    whole = sets.spacing(df.where("t < 100"), ["k"], "t", 60)
    assert [tuple(r)[1:] for r in sets.window_ends(whole, ["k"], "t", 60, 0, 60).collect()] == [(0, 0, True)]
    assert [tuple(r)[1:] for r in sets.window_ends(whole, ["k"], "t", 60, -120, 200).collect()] == [(2, 2, False)]


def book(spark, rows):
    levels = json.dumps({"bids": [[0.4, 10.0]], "asks": [[0.6, 5.0]]})
    full = [("v", "c", "s", i, m, k, q, op, side, p, z, levels if k == "snapshot" else None, i * 10, 1000 - i * 10) for i, (m, k, q, op, side, p, z) in enumerate(rows)]
    return spark.createDataFrame(full, "venue string, connection_id string, scope string, record_id long, contract string, kind string, sequence long, operation string, side string, price double, size double, levels string, source_time long, usable_time long")


STEPS = [
    ("m", "delta", 1, "replace", "bid", 0.5, 1.0), ("m", "snapshot", 2, None, None, None, None), ("m", "delta", 3, "replace", "bid", 0.45, 2.0), ("m", "delta", 4, "increment", "bid", 0.45, -2.0), ("m", "delta", 5, "delete", "ask", 0.6, 0.0),
    ("n", "snapshot", 6, None, None, None, None), ("m", "delta", 9, "replace", "ask", 0.7, 1.0), ("m", "snapshot", 10, None, None, None, None), ("m", "delta", 10, "replace", "bid", 0.65, 1.0), ("m", "delta", 8, "replace", "bid", 0.1, 1.0), ("m", "halt", None, None, None, None, None),
    ("m", "delta", 11, "replace", "bid", 0.61, 1.0), ("m", "close", None, None, None, None, None), ("m", "snapshot", 12, None, None, None, None),
]
WANT = [
    (None, None, "gap", "sequence_baseline_missing"), (0.4, 0.6, "valid", None), (0.45, 0.6, "valid", None), (0.4, 0.6, "valid", None), (0.4, None, "valid", None), (0.4, 0.6, "valid", None), (0.4, 0.7, "gap", "sequence_gap"),
    (0.4, 0.6, "valid", None), (0.4, 0.6, "valid", "duplicate_sequence"), (0.4, 0.6, "valid", "stale_sequence"), (0.4, 0.6, "halted", None), (0.61, 0.6, "halted", None), (0.61, 0.6, "closed", None), (0.4, 0.6, "closed", None),
]


def test_book_fold(spark):
    rows = replay.replay(book(spark, STEPS), "source_time").orderBy("record_id").collect()
    none = lambda x: None if x is None or x != x else x
    assert [(none(r["bid"]), none(r["ask"]), r["validity"], r["issue"]) for r in rows] == WANT
    assert replay.compare_orders(book(spark, STEPS), "source_time", "usable_time").where("not same").count() > 0
    assert [(r["before"], r["sequence"]) for r in replay.sequence_gaps(book(spark, STEPS), "source_time").collect()] == [(6, 9)]


def test_streams_equal_batches(spark, tmp_path):
    events = book(spark, STEPS)
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = flows.book_quotes(stream, "source_time").writeStream.format("memory").queryName("quotes_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select record_id, validity, issue from quotes_out").collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == [(i, w[2], w[3]) for i, w in enumerate(WANT)]
    ticks = events.select(F.timestamp_seconds(F.col("record_id") * 20).alias("at"), "contract", F.col("record_id").cast("double").alias("v"))
    ticks.coalesce(1).write.parquet(f"{tmp_path}/ticks")
    held = []
    flow = flows.candles(spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/ticks"), "at", ["contract"], "v", "1 minute", "10 seconds")
    flows.each_batch(flow, lambda df, _: held.extend(df.collect()), f"{tmp_path}/state").awaitTermination(120)
    assert held and all(r["low"] <= r["open"] <= r["high"] for r in held)


def test_sealed_round_trip(spark, tmp_path):
    from decimal import Decimal

    df = spark.createDataFrame([("c1", "r1", "yes", Decimal(0)), ("c2", "r2", "no", Decimal(1)), ("c3", None, "yes", None)], "contract_id string, rule_hash string, outcome string, payout decimal(10,2)")
    broken = spark.createDataFrame([(1,)], "x int").write.parquet(f"{tmp_path}/x/rows-of-a-writer-that-broke-off")  # blocks nothing
    assert broken is None
    first = sealed.write_sealed(df, f"{tmp_path}/x", "resolutions")
    assert sealed.write_sealed(df.orderBy(F.desc("contract_id")), f"{tmp_path}/x", "resolutions") == first
    with pytest.raises(sealed.SealError):
        sealed.write_sealed(df.limit(1), f"{tmp_path}/x", "resolutions")
    got = sealed.query_sealed(spark, f"{tmp_path}/x", "resolutions", "select count(*) n, count(payout) p from resolutions where outcome = ?", ["yes"]).first()
    assert (got["n"], got["p"]) == (2, 1)
    with pytest.raises(sealed.SealError):
        sealed.read_sealed(spark, f"{tmp_path}/x", "quotes")
    with pytest.raises(ValueError):
        sealed.write_sealed(df.withColumn("more", F.lit(1)), f"{tmp_path}/y", "resolutions")
    with pytest.raises(sealed.SealError):
        sealed.write_sealed(df.withColumn("outcome", F.lit(None).cast("string")), f"{tmp_path}/y", "resolutions")
    assert sealed.load_sealed(spark, f"{tmp_path}/x", "resolutions", "contract_id", ["c1", "c9"]).count() == 1
    assert sealed.load_sealed(spark, f"{tmp_path}/x", "resolutions", "contract_id", ["c2", *map(str, range(200))]).count() == 1
    builds = spark.createDataFrame([("b1", 1), ("b2", 2)], "build string, v int")
    assert sealed.write_build(builds, f"{tmp_path}/b", ["build"]) == 2 and sealed.write_build(builds, f"{tmp_path}/b", ["build"]) == 0


def test_archive_sources(spark, tmp_path):
    df = spark.createDataFrame([("A-1", 40, 60, 1, "yes"), ("A-2", 0, 100, 2, "maybe"), (None, 1, 99, 3, "no"), ("A-3", 55, 50, 4, "no")], "ticker string, yes_price long, no_price long, count long, taker_side string").withColumn("created_time", F.current_timestamp())
    df.coalesce(1).write.parquet(f"{tmp_path}/s")
    got = {r["ticker"]: r for r in archive.cents_trades(df).collect()}
    assert set(got) == {"A-1", "A-2", "A-3"} and got["A-1"]["flags"] == [] and got["A-2"]["taker_sign"] is None
    assert got["A-2"]["flags"] == ["zero_cent_price"] and got["A-3"]["flags"] == ["yes_no_cents_sum_not_100"]
    scan = archive.scan_shards(spark, [f"{tmp_path}/s"], {"t": ("ticker", "string"), "absent": ("nothing", "long")}, ("t",), keep=F.col("count") > 2)
    assert [(r["t"], r["absent"], r["row_position"]) for r in scan.orderBy("row_position").collect()] == [(None, None, 2), ("A-3", None, 3)]
    with pytest.raises(ValueError):
        archive.scan_shards(spark, [f"{tmp_path}/s"], {"x": ("resolution_status", "string")}, ())
    with pytest.raises(ValueError):
        archive.scan_shards(spark, [f"{tmp_path}/s"], {"x": ("nothing", "string")}, ("x",))
    df.drop("taker_side").coalesce(1).write.parquet(f"{tmp_path}/t")
    df.drop("ticker").coalesce(1).write.parquet(f"{tmp_path}/u")
    both = [f"{tmp_path}/s", f"{tmp_path}/t", f"{tmp_path}/u"]
    named = {"t": ("ticker", "string"), "side": ("taker_side", "string")}
    rows, skipped = archive.extract(spark, both, named, ("t",))
    assert rows.count() == 8 and rows.where("side is null").count() == 4 and [w for _, w in skipped] == ["missing_required:t"]
    files = archive.shard_files(spark, both[:2])
    assert [w for _, w in archive.extract(spark, both[:2], named, ("t",), bounds={files[0]: (5, 9)}, span=(1, 4))[1]] == ["outside_window"]
    with pytest.raises(ValueError, match="missing_required"):
        archive.scan_shards(spark, both, named, ("t",))
    (tmp_path / "bad.parquet").write_bytes(b"not parquet")
    assert archive.extract(spark, [f"{tmp_path}/bad.parquet"], named, ("t",))[1][0][1] == "unreadable"
    files = spark.read.format("binaryFile").load([f"{tmp_path}/s/*.parquet", f"{tmp_path}/bad.parquet"])
    rows = archive.inventory(spark, files, "created_time").collect()
    assert sorted(r["error"] is None for r in rows) == [False, True] and sum(r["rows"] or 0 for r in rows) == 4
    o = spark.createDataFrame([(1, 0.3, 0.3, 1), (2, 0.3, 0.6, None), (3, 0.3, 0.3, 5)], "outcome_seq int, price double, p_event double, taker_direction int")
    assert [r["flags"] for r in archive.outcome_trades(o).orderBy("outcome_seq").collect()] == [[], ["axis_differs_from_stored"], ["unknown_outcome", "unknown_direction"]]


def test_pages_and_tables(spark):
    pages = spark.createDataFrame([(1, "intro\n| a | b |\n|---|---|\n| 1 | $1.2B |\ntext\n| c |\n| 2 |")], "id long, t string")
    assert [(r["table"], r["row"], r["cells"]) for r in archive.table_rows(pages, "id", "t").orderBy("table", "row").collect()] == [(1, 0, ["a", "b"]), (1, 1, ["1", "$1.2B"]), (2, 0, ["c"]), (2, 1, ["2"])]
    book = {None: ([{"id": 1}, {"id": 2}], "x"), "x": ([{"id": 2}, {"id": 3}], "y"), "y": ([{"id": 4}], "x")}
    assert archive.paginate(book.get, None, ["id"], 9) == ([{"id": i} for i in (1, 2, 3, 4)], "cursor_loop")
    assert archive.paginate(book.get, None, ["id"], 1)[1] == "max_pages" and archive.paginate(lambda c: ([], "z"), None, ["id"], 3)[1] == "empty_page_with_cursor"


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(columns)]).first()


def test_text_and_times(spark):
    L = F.lit
    assert tuple(one(spark, *[text.figure(L(x)) for x in ("$1.2B", "3.4K", "-", "1,250")], text.percent(L("+0.98%")), text.percent(L("-")))) == (1.2e9, 3400.0, None, 1250.0, pytest.approx(0.0098), None)
    assert tuple(one(spark, *[text.strict_decimal(L(x)).cast("string") for x in ("1.5", "NaN", "1e5")])) == ("1.500000000000", None, None)
    texts = ("Above 4.25%", "3% or below", "No change", "Cut >25 bps", "Hike 50 bps", "who knows", "Cut 25 bps or more", "Above 4% or so", "Fed maintains rate")
    got = one(spark, *[text.payout_predicate(L(s), L("target federal funds rate")) for s in texts])
    assert [(g["subject"], g["threshold"], g["inequality"], g["orientation"], g["refusal"]) for g in got] == [
        ("target_level", 4.25, "above", 1, None), ("target_level", 3.0, "below", -1, None), ("change", 0.0, None, 1, None), ("change", -25.0, "below", 1, None), ("change", 50.0, None, 1, None),
        *[(None, None, None, None, text.TEXT_UNREADABLE)] * 3, ("change", 0.0, None, 1, None),
    ]
    assert one(spark, text.payout_predicate(L("Above 4%"), L("a rate")))[0]["refusal"] == text.SUBJECT_UNREADABLE
    calendar = F.create_map(L("2026-03"), L("2026-03-18"))
    assert [tuple(x) for x in one(spark, *[text.decision_date(L(x), calendar) for x in ("FED-26MAR", "FED-26APR", "FED-26XXX", "odd")])] == [("2026-03-18", None)] + [(None, text.MONTH_UNKNOWN)] * 3
    assert one(spark, text.sentence_at(L("One. Two here! Three."), L(8)))[0] == "Two here! Three."
    doc = L('{"a": [{"b/c": 1}]}')
    assert tuple(one(spark, text.json_pointer(doc, L("/a/0/b~1c")), text.json_pointer(doc, L("/a/1")))) == ("1", None)
    assert one(spark, times.utc_text(L("2024-01-01T00:00:00")))[0] is None and one(spark, times.utc_text(L("2024-01-01T00:00:00Z")))[0] is not None
    kind = lambda x: times.local_kind(L(x).cast("timestamp_ntz"), "America/New_York")
    assert tuple(one(spark, *map(kind, ("2024-03-10 02:30:00", "2024-11-03 01:30:00", "2024-11-03 03:30:00", "2024-03-10 03:00:00")))) == ("nonexistent", "ambiguous", "unique", "unique")


def test_geometry(spark):
    L = F.lit
    assert tuple(one(spark, *[geometry.snapped_hours(L(x)) for x in (7.5, 1.1, 2.5)])) == (8.0, 1.0, None)
    got = one(spark, geometry.funding_interval(L(0.0001), L(0.1095), L(30.0), L(90)), geometry.funding_interval(L(0.0001), L(0.1095), L(30.0), L(720)), geometry.funding_interval(L(0.0), L(0.0), L(30.0), L(0)))
    assert [(g["hours"], g["refusal"]) for g in got] == [(8.0, None), (None, "interval_disagrees"), (None, "interval_underivable")]
    levels = F.array(*[F.struct(L(p).alias("price"), L(s).alias("size")) for p, s in ((1.0, 2.0), (2.0, 2.0))])
    assert tuple(one(spark, geometry.fill_cost(levels, L(3.0)), geometry.fill_cost(levels, L(5.0)))) == (4.0, None)


def test_absorption_by_hand(spark):
    rows = [(1, h, r) for h, r in ((60, 0.1), (300, 0.3), (900, 0.5), (3600, 0.4))] + [(2, 60, 0.9), (2, 3600, 1.0), (3, 60, 0.1), (3, 3600, 0.0), (4, 60, 0.1), (5, 60, 0.1), (5, 60, 0.2), (5, 3600, 1.0)]
    got = {r["pair"]: r for r in absorption.absorption(spark.createDataFrame(rows, "pair int, h long, r double"), ["pair"], "h", "r", 3600).collect()}
    assert got[1]["h50"] == pytest.approx(60 + 0.25 / 0.5 * 240) and got[1]["overshoot"] and got[1]["steps_back"] == 1 and got[1]["drawdown"] == pytest.approx(0.25)
    assert got[2]["h50"] is None and got[2]["h50_bound"] == 60
    assert [got[i]["refusal"] for i in (3, 4, 5)] == ["no_terminal_response", "terminal_undeclared", "duplicate_horizon"]


def test_models(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    y = 0.4 + 0.3 * x[:, 0] + 0.1 * x[:, 1] + rng.normal(0, 0.01, 400)
    df = spark.createDataFrame([(int(i % 20), "f", float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "cluster long, family string, a double, b double, y double")
    cell = models.projection(df, ["a", "b"], "y", "cluster", ["family"])[0]
    assert cell["coefficients"] == pytest.approx([0.4, 0.3, 0.1], abs=0.01)
    design = np.column_stack([np.ones(400), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    e, inverse = y - design @ beta, np.linalg.inv(design.T @ design)
    scores = np.array([(design[np.arange(400) % 20 == g] * e[np.arange(400) % 20 == g][:, None]).sum(axis=0) for g in range(20)])
    cov = inverse @ scores.T @ scores @ inverse * (20 / 19) * (399 / 397)
    assert cell["errors"] == pytest.approx(np.sqrt(np.diag(cov)).tolist(), rel=1e-6)
    assert models.projection(df.withColumn("b", F.col("a") * 2), ["a", "b"], "y", "cluster", ["family"])[0]["status"] == "rank_deficient"
    fits = models.fit_ladder(df.where("cluster < 14"), df.where("cluster >= 14"), {"no_change": [], "own": ["a"], "both": ["a", "b"]}, "y")
    assert fits["both"].alpha in models.PENALTIES and fits["both"].weights[0] == pytest.approx(0.3 * x[np.arange(400) % 20 < 14, 0].std(), rel=0.05)


def test_box_distances():
    ladder = np.array([[0, 1, 1], [0, 0, 1]], float)
    assert models.box_distance(ladder, [0.5, 0.2], [0.6, 0.3]) == pytest.approx(0.0, abs=1e-9)
    assert models.box_distance(ladder, [0.2, 0.6], [0.2, 0.6]) == pytest.approx(0.2, abs=1e-9)
    assert models.box_distance(np.eye(2), [0.7, 0.7], [0.8, 0.8]) == pytest.approx(0.2, abs=1e-9)


def test_resampling(spark):
    draws = stats.draws_table(spark, ["b", "a", "c"], 50, 3)
    assert draws.collect() == stats.draws_table(spark, ["c", "a", "b"], 50, 3).collect()
    assert {r["n"] for r in draws.groupBy("replicate").agg(F.sum("times").alias("n")).collect()} == {3}
    flat = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "c string, v double")
    assert stats.percentile_interval(stats.bootstrap_mean(flat, draws, "c", "v")).first()["status"] == "degenerate"
    assert stats.permutation_p(1.0, [0.5, -1.0, 2.0]) == 3 / 4
    with pytest.raises(ValueError):
        stats.chronological_split(spark.createDataFrame([(1, 1, 1), (2, 2, 1)], "u int, t long, s long"), "u", "t", "s")


def test_simulator_is_deterministic(spark):
    order = ("event_id", "contract", "horizon")
    a = simulate.simulated(spark, "communication", 20, 9).orderBy(*order).collect()
    assert a == simulate.simulated(spark, "communication", 20, 9).repartition(7).orderBy(*order).collect() and len(a) == 180
    rates = {r["scenario"]: r["rate"] for r in simulate.detections(spark, ["shared_news_delay", "communication"], 8, 120, 1).collect()}
    assert rates["shared_news_delay"] < 0.3 and rates["communication"] > 0.7


def test_scenarios_do_what_they_declare(spark):
    import numpy as np

    many = lambda name: [simulate.Event(name, 3, i) for i in range(30)]
    end = lambda e, c: e.slow[c][-1] - e.slow[c][0]
    null, told = many("shared_news_delay"), many("communication")
    assert all(a.shock == b.shock and np.array_equal(a.fast["C0"], b.fast["C0"]) for a, b in zip(null, told, strict=True))  # they differ by the edge alone
    assert all(np.array_equal(a.slow["C0"][:400], b.slow["C0"][:400]) and not np.array_equal(a.slow["C0"], b.slow["C0"]) for a, b in zip(null, told, strict=True))
    still = many("spread_only")
    assert max(abs(end(e, "C0")) for e in still) < 0.1 and {round(a - b, 2) for e in still for _, c, at, _, b, a, *_ in e.quotes() if c != "G0" and -30 <= at <= 120} == {0.06}
    apart = many("opposing_sign")
    assert sum(np.sign(e.news["C0"]) != np.sign(e.news["C1"]) for e in apart) > 25
    turned = many("later_reversal")
    assert sum(np.sign(e.slow["C0"][440] - e.slow["C0"][140]) != np.sign(end(e, "C0")) for e in turned if abs(e.news["C0"]) > 0.05) > 5
    halted = many("resolution_pause")[0]
    assert not [q for q in halted.quotes() if q[0] == "beta" and 700 < q[2] < 1000] and {r[-1] for r in halted.rows() if r[1] == 900 and r[0] == "C0"} == {"halted_during_window"}
    assert np.mean([len(e.updates["beta"]) for e in many("dropped_messages")]) < 0.55 * 1350 / 10
    coarse = many("coarse_sampling")[0]
    assert set(np.diff(coarse.t)) == {30.0} and all(round(x / 0.05, 6) == round(x / 0.05) for x in coarse.seen["beta", "C0"])
    prints, contracts, releases = simulate.tapes(spark, "rule_mismatch", 4, 1)
    rules = {(r["venue"], r["contract"].split("-")[1]): r["operator"] for r in contracts.collect()}
    assert rules["alpha", "C1"] == "above" and rules["beta", "C1"] == "at_least" and releases.count() == 4
    grid = releases.select("event_id", F.col("release").alias("at"), F.lit(True).alias("rule_known"), F.lit(False).alias("closed_before"))
    made = panel.trade_panel(prints, grid, contracts.select("event_id", "contract"), panel.PanelSettings(150_000_000, 600_000_000, 150_000_000, 600_000_000, (300_000_000,)))
    assert made.where("valid").count() == made.count() == 4 * 5


def test_later_prints_leave_earlier_horizons_alone(spark):
    at, second = 1_000_000_000, 1_000_000
    prints = [(1, "m", at - 5 * second, 0.5, "yes"), (2, "m", at + 5 * second, 0.6, "yes"), (3, "m", at + 50 * second, 0.7, None), (4, "n", at - 5 * second, 0.5, "yes"), (5, "n", at + 5 * second, 0.6, "no")]
    trades = spark.createDataFrame(prints, "trade_id long, contract string, time long, price double, axis string")
    events = spark.createDataFrame([(1, at, True, False)], "event_id long, at long, rule_known boolean, closed_before boolean")
    declared = spark.createDataFrame([(1, "m"), (1, "n"), (1, "o")], "event_id long, contract string")
    settings = panel.PanelSettings(60 * second, 60 * second, 60 * second, 60 * second, (10 * second, 60 * second))
    got = {(r["contract"], r["horizon"] // second): (r["exclusion_reason"], r["baseline_ids"]) for r in panel.trade_panel(trades, events, declared, settings).collect()}
    assert got == {("m", 10): (None, [1]), ("m", 60): ("mixed_axis", [1]), ("n", 10): ("mixed_axis", [4]), ("n", 60): ("mixed_axis", [4]), ("o", 10): ("missing_baseline", None), ("o", 60): ("missing_baseline", None)}
    with pytest.raises(ValueError, match="without a declared"):
        panel.trade_panel(trades, events, declared.limit(0), settings)


def fold(spark, rows, trades=None):
    got = replay.replay(book(spark, rows), "source_time", trades).orderBy("record_id").collect()
    return [(r["contract"], r["bid"], r["validity"], r["issue"], r["missing"]) for r in got]


def test_a_disconnect_ends_the_scope(spark):
    snap, bid = lambda m, n: (m, "snapshot", n, None, None, None, None), lambda m, n: (m, "delta", n, "replace", "bid", 0.45, 1.0)
    assert fold(spark, [snap("m", 1), snap("n", 2), ("m", "disconnect", None, None, None, None, None), bid("n", None), bid("m", None), snap("m", 3), bid("n", 4), snap("n", 5)]) == [
        ("m", 0.4, "valid", None, 0), ("n", 0.4, "valid", None, 0), ("m", 0.4, "disconnected", None, 0), ("n", 0.4, "disconnected", None, 0), ("m", 0.4, "disconnected", None, 0), ("m", 0.4, "valid", None, 0), ("n", 0.45, "gap", None, 0), ("n", 0.4, "valid", None, 0),
    ]


def test_halts_and_closes_have_numbers(spark):
    still = lambda kind, n: ("m", kind, n, None, None, None, None)
    assert [x[2:] for x in fold(spark, [still("snapshot", 1), still("halt", 2), ("m", "delta", 3, "replace", "bid", 0.41, 1.0), still("snapshot", 4), still("close", 5), ("m", "delta", 6, "replace", "bid", 0.42, 1.0), still("halt", 9)])] == [
        ("valid", None, 0), ("halted", None, 0), ("halted", None, 0), ("valid", None, 0), ("closed", None, 0), ("closed", None, 0), ("closed", "sequence_gap", 2),
    ]


def test_trades_mark_books_and_set_no_side(spark):
    trades = spark.createDataFrame([("v", "m", 100, 5, None), ("v", "m", 101, 25, 7), ("w", "m", 102, 25, 7)], "venue string, contract string, record_id long, source_time long, usable_time long")
    rows = [("m", "snapshot", 1, None, None, None, None), ("m", "delta", 2, "replace", "bid", 0.45, 1.0), ("m", "delta", 3, "replace", "bid", 0.46, 1.0), ("m", "delta", 4, "replace", "bid", 0.47, 1.0)]
    got = replay.replay(book(spark, rows), "source_time", trades).orderBy("record_id").collect()
    assert [r["record_id"] for r in got] == [0, 1, 2, 3] and [r["last_trade"] for r in got] == [None, 5, 5, 7] and [r["last_verified"] for r in got] == [1000, 990, 980, 970]
    done = replay.coverage(replay.replay(book(spark, STEPS), "source_time"))
    r = done.first()
    assert (r["quotes"], r["contracts"], r["valid_contracts"], r["gaps"], r["missing"], r["open_gaps"]) == (14, 2, 0, 2, 2, 2) and not r["all_valid"]
    assert replay.totals(done).first()["scopes"] == 1


def test_inversions_equal_pairs(spark):
    import itertools
    import random

    rng = random.Random(4)
    rows = [(f"v{i % 3}", "c", "s", i, rng.randrange(60), rng.randrange(60) if i % 9 else None) for i in range(150)]
    df = spark.createDataFrame(rows, "venue string, connection_id string, scope string, record_id long, source_time long, usable_time long")
    got = {r["venue"]: (r["shared"], r["inversions"]) for r in replay.inversions(df, "source_time", "usable_time", bucket=7).collect()}
    for v in ("v0", "v1", "v2"):
        own = [(a, i, b) for w, _, _, i, a, b in rows if w == v and b is not None]
        crossed = sum(((x[0], x[1]) < (y[0], y[1])) != ((x[2], x[1]) < (y[2], y[1])) for x, y in itertools.combinations(own, 2))
        assert got[v] == (len(own), crossed)


def test_channel_messages(spark):
    bodies = [
        '{"event_type": "book", "asset_id": "A", "timestamp": "1700000000", "bids": [{"price": "0.4", "size": "3"}, {"price": "0.3", "size": "0"}], "asks": []}',
        '{"event_type": "price_change", "timestamp": "1700000001000", "price_changes": [{"asset_id": "A", "price": "0.41", "size": "2", "side": "BUY"}, {"asset_id": "A", "price": "0.4", "size": "0", "side": "BUY"}, {"asset_id": "A", "side": "SELL"}]}',
        '{"event_type": "price_change", "asset_id": "A", "price": "0.6", "size": "1", "side": "SELL"}', '{"event_type": "last_trade_price", "asset_id": "A", "price": "0.5", "size": "1"}',
        '{"event_type": "last_trade_price", "asset_id": "A"}', '{"event_type": "price_change", "asset_id": "A", "price": "0.6", "size": "1", "side": "UP"}', '{"event_type": "tick_size_change"}', "not json",
    ]
    messages = spark.createDataFrame([("c", i, i * 10, b) for i, b in enumerate(bodies)], "connection_id string, position long, received long, body string")
    events, counts = replay.channel_events(messages)
    got = sorted((r["record_id"], r["kind"], r["operation"], r["side"], r["price"], r["size"], r["source_time"]) for r in events.collect())
    assert got == [
        (0, "snapshot", None, None, None, None, 1_700_000_000_000_000), (1024, "delta", "replace", "bid", 0.41, 2.0, 1_700_000_001_000_000), (1025, "delta", "delete", "bid", 0.4, None, 1_700_000_001_000_000),
        (2048, "delta", "replace", "ask", 0.6, 1.0, None), (3072, "trade", None, None, 0.5, 1.0, None),
    ]
    assert {r["event_type"]: (r["messages"], r["refused"]) for r in counts.collect()} == {"book": (1, 0), "price_change": (3, 1), "last_trade_price": (2, 1), "tick_size_change": (1, 0), None: (1, 0)}
    marks = replay.disconnect_markers(events, spark.createDataFrame([("c", 500), ("d", None)], "connection_id string, ended long")).collect()
    assert [(r["contract"], r["scope"], r["kind"], r["usable_time"]) for r in marks] == [("A", "c", "disconnect", 500)]
    quotes = replay.replay(events.where("kind != 'trade'"), "usable_time", events.where("kind = 'trade'")).orderBy("record_id").collect()
    assert [(r["bid"], r["ask"], r["validity"]) for r in quotes] == [(0.4, None, "valid"), (0.41, None, "valid"), (0.41, None, "valid"), (0.41, 0.6, "valid")]


def test_quantiles_equal_numpy(spark):
    import numpy as np

    from estuary.operators import quantiles

    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.lognormal(0, 4, 9000)] + [("b", 1.0)] * 7000 + [("b", 2.0)] * 3 + [("c", float(x)) for x in rng.integers(0, 5, 50)] + [("d", None), ("d", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    ps = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r["g"]: list(r)[1:] for r in quantiles.quantiles(df, "x", ps, ["g"]).collect()}
    for g in "abc":
        assert got[g] == pytest.approx(np.quantile([x for k, x in rows if k == g], ps).tolist(), rel=1e-12)
    assert "d" not in got and list(quantiles.quantiles(df.where("g = 'a'"), "x", [0.5]).first()) == pytest.approx([np.median([x for k, x in rows if k == "a"])])
    assert quantiles.quantiles(df.where("g = 'd'"), "x", [0.5]).first() is None


def test_types_are_not_coerced(spark):
    import datetime as dt
    from decimal import Decimal

    from estuary.schemas import TABLES, conform

    row = {"venue": "v", "contract_id": "c", "record_id": "r"}
    ok = conform(spark.createDataFrame([("v", "c", "r", Decimal("0.5"))], "venue string, contract_id string, record_id string, price decimal(10,4)"), TABLES["trades"])
    assert ok.first()["price"] == Decimal("0.5") and ok.columns == list(TABLES["trades"].columns)
    for column, kind, value in (("price", "double", 0.5), ("price", "boolean", True), ("source_time", "timestamp_ntz", dt.datetime(2024, 1, 1)), ("record_id", "double", 1.5)):
        cols = {**{k: "string" for k in row}, column: kind}
        df = spark.createDataFrame([tuple({**row, column: value}[c] for c in cols)], ", ".join(f"{c} {k}" for c, k in cols.items()))
        with pytest.raises(TypeError):
            conform(df, TABLES["trades"])
    events = lambda x: spark.createDataFrame([("v", "c", "delta", "r", x)], "venue string, contract_id string, kind string, record_id string, sequence double")
    assert conform(events(3.0), TABLES["book_events"]).first()["sequence"] == 3 and conform(events(float("nan")), TABLES["book_events"]).first()["sequence"] is None
    with pytest.raises(Exception, match="fraction"):
        conform(events(3.5), TABLES["book_events"]).collect()
    nested = spark.createDataFrame([("v", "c", "snapshot", "r", [[0.4, 1.0]])], "venue string, contract_id string, kind string, record_id string, bid_levels array<array<double>>")
    assert conform(nested, TABLES["book_events"]).first()["bid_levels"] == "[[0.4,1.0]]"


def test_blobs_and_reports(spark, tmp_path):
    from decimal import Decimal

    from estuary.sources import registry

    blobs = spark.createDataFrame([("s", "1", b"x"), ("s", "2", b"x"), ("t", None, b"y"), ("t", None, b"y")], "source string, record_id string, payload binary")
    got = sealed.put_blobs(blobs, f"{tmp_path}/store").collect()
    assert len(got) == 4 and len({r["raw_hash"] for r in got}) == 2 and sealed.verified_blobs(spark, f"{tmp_path}/store").where("intact").count() == 2
    assert sealed.put_blobs(blobs.where("record_id is not null"), f"{tmp_path}/store").count() == 4
    for bad in ([("s", "1", b"z")], [("u", "1", b"a"), ("u", "1", b"b")]):
        with pytest.raises(sealed.SealError):
            sealed.put_blobs(spark.createDataFrame(bad, "source string, record_id string, payload binary"), f"{tmp_path}/store")
    notes = registry.write_report(spark, {"a": float("nan"), "b": Decimal("1.50"), "c": [1, None]}, f"file://{tmp_path}/report.json")
    assert notes == ["$.a: nan is written as null"] and (tmp_path / "report.json").read_text() == '{"a":null,"b":"1.50","c":[1,null]}'
    with pytest.raises(registry.RegistryConflict):
        registry.write_report(spark, {"a": 1}, f"file://{tmp_path}/report.json")


def test_claims_of_a_writer_that_broke_off(spark, tmp_path):
    from estuary.sources import registry

    runs = registry.RunRegistry(spark, f"file://{tmp_path}/r")
    assert runs._claim(f"claims/{registry._name('e')}.json", "gone", 600.0)  # and no commit follows
    with pytest.raises(registry.RegistryConflict):
        runs.reserve("spec", "data", ["e"])
    token = runs.reserve("spec", "data", ["e", "f"], lease=0.0)
    with pytest.raises(registry.RegistryConflict):
        runs.reserve("other", "data", ["f"], lease=0.0)  # a committed claim stands, however old
    runs.finish(token, "complete", {"x": 1})
    assert registry.export_lines(registry.RunRegistry(spark, f"file://{tmp_path}/r")) == [] if (tmp_path / "r/runs").exists() else True


def test_joint_tests_and_caller_statistics(spark):
    import numpy as np

    from estuary.operators import models

    assert models.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9) and models.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9) and models.chi_square_tail(0.1, 4) == pytest.approx(0.998791, abs=1e-6)
    rng = np.random.default_rng(8)
    rows = [("f", int(i % 25), float(s), float(q), float(0.5 * s + 0.4 * s * q + rng.normal(0, 0.1))) for i, (s, q) in enumerate(rng.normal(0, 1, (400, 2)))]
    df = spark.createDataFrame(rows, "family string, release long, s double, q double, y double")
    (cell,) = models.interacted_projection(df, "s", [], ["q"], "y", "release", ["family"])
    x = np.array([[1.0, r[2], r[3], r[2] * r[3]] for r in rows])
    beta = np.linalg.lstsq(x, np.array([r[4] for r in rows]), rcond=None)[0]
    assert cell["coefficients"] == pytest.approx(beta.tolist(), rel=1e-8) and cell["interactions"]["p"] < 1e-6
    assert cell["marginal"] == pytest.approx(beta[1] + beta[3] * np.mean([r[3] for r in rows])) and cell["interactions"]["statistic"] == pytest.approx(beta[3] ** 2 / cell["covariance"][3][3])
    got = {r["metric"]: r for r in stats.statistic_bootstrap(df, "release", lambda p: {"mean": p["y"].mean(), "n": float(len(p))}, 200, 3).collect()}
    assert got["mean"]["lower"] < got["mean"]["point"] < got["mean"]["upper"] and got["n"]["status"] == "degenerate" and got["mean"]["effective"] == 200
    assert stats.statistic_bootstrap(df.where("release = 1"), "release", lambda p: {"m": p["y"].mean()}, 10).first()["status"] == "inconclusive"
    d, pi = models.coherent_prices(np.array([[1.0, 0.0], [1.0, 1.0]]), np.array([0.6, 0.9]), np.array([0.7, 0.95]))
    assert d == pytest.approx(0.05) and (np.array([[1.0, 0.0], [1.0, 1.0]]) @ pi) == pytest.approx([0.65, 1.0], abs=0.11)


def test_penalties_whose_errors_differ_beyond_nine_decimals_are_equal(spark):
    # The slope is nearly nil, so a larger penalty betters the error by less than a billionth.
    flat = spark.range(-50, 51).select(F.col("id").cast("double").alias("x")).select("x", (F.lit(5.0) + F.when(F.col("x") > 0, 1e-10).otherwise(0.0)).alias("y"))
    level = flat.select("x", F.lit(5.0).alias("y"))
    assert models.fit_ladder(flat, level, {"own": ["x"]}, "y")["own"].alpha == models.PENALTIES[0]
