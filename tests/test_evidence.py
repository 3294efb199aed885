"""Evidence, placebos, power, the weighted ladder, the second grammar, the registry and freezes."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from estuary.functions import text
from estuary.operators import asof, evidence, models, panel, placebo, simulate, stats
from estuary.sources import registry


def test_weighted_ladder_equals_normal_equations(spark):
    rng = np.random.default_rng(5)
    n = 300
    release, a, flag = rng.integers(0, 40, n), rng.normal(5, 3, n), rng.integers(0, 2, n)
    y = 0.2 * flag + 0.1 * a + rng.normal(0, 0.2, n)
    rows = [(int(r), float(p), float(f), float(1 - f), float(v)) for r, p, f, v in zip(release, a, flag, y, strict=True)]
    df = spark.createDataFrame(rows, "release int, a double, f double, g double, y double")
    train, rest = df.where("release < 30"), df.where("release >= 30")
    got = models.fit_weighted_ladder(train, rest, {"level": ([], []), "both": (["f", "g"], ["a"])}, "y", "release", (0.5,))
    keep = release < 30
    w = 1 / np.bincount(release)[release][keep]
    mean = (w * a[keep]).sum() / w.sum()
    sd = np.sqrt((w * (a[keep] - mean) ** 2).sum() / w.sum())
    x = np.column_stack([flag[keep], 1 - flag[keep], (a[keep] - mean) / sd])
    beta = np.linalg.solve(x.T @ (x * w[:, None]) + np.diag([0, 0, 0.5]), x.T @ (w * y[keep]))
    assert got["both"].weights == pytest.approx(beta.tolist(), rel=1e-8) and got["level"].intercept == pytest.approx((w * y[keep]).sum() / w.sum())
    doubled = models.fit_weighted_ladder(train.union(train.where("release < 9")), rest, {"both": (["f", "g"], ["a"])}, "y", "release", (0.5,))
    assert doubled["both"].weights == pytest.approx(beta.tolist(), rel=1e-6)  # repeating a release's rows changes nothing


def test_expectations_of_unknown_releases_and_nulls(spark):
    schema = "event_id int, statistic string, value double, unit string, source_kind string, consensus_id string, verified_by string, published_at long, revision_status string, reference_period string, evidence binary, evidence_sha256 string"
    digest = hashlib.sha256(b"x").hexdigest()
    good = (1, "cpi_mom_pct", 0.3, "percent_change", "licensed_consensus", "s", "v", 9, "initial", "p", b"x", digest)
    rows = [good, (2, *good[1:]), (1, None, *good[2:]), (1, *good[1:7], 10, *good[8:]), (1, *[None] * 11)]
    releases = spark.createDataFrame([(1, 10, "p", ["cpi_mom_pct"], None)], "event_id int, release_time long, release_period string, statistics array<string>, revised_statistics array<string>")
    got = [(r["refusal"], r["value"]) for r in evidence.validated_expectations(spark.createDataFrame(rows, schema).coalesce(1), releases).collect()]
    assert sorted(got, key=str) == sorted([(None, 0.3), ("statistic_is_not_declared_by_the_release", None), ("statistic_is_not_declared_by_the_release", None), ("expectation_published_at_or_after_the_release", None), ("recorded_evidence_bytes_could_not_be_read", None)], key=str)


def test_attested_rules_by_hand(spark):
    def capture(contract, i, words, stated=(None, None), seen=None, body=b"b"):
        return (contract, i, body, hashlib.sha256(b"b").hexdigest(), "page", words, "cash", i, *stated, seen)

    rows = [
        capture("a", 1, "one", seen=10), capture("a", 2, "two", seen=20), capture("a", 3, "one", seen=30), capture("b", 4, "one", (5, 9), 1), capture("b", 5, "one", (5, 8), 1), capture("c", 6, "one"), capture("d", 7, "one", (5, 5)),
        capture("e", 8, "one", seen=3, body=b"other"), capture("f", 9, "one", (5, None)), capture("g", 1, None, seen=1),
    ]
    df = spark.createDataFrame(rows, "contract_id string, capture_id int, body binary, raw_hash string, source_kind string, rule_text string, settlement string, captured_at long, stated_from long, stated_to long, observed_at long")
    got = {r["contract_id"]: (r["refusal"], r["in_force_from"], r["in_force_to"]) for r in evidence.attested_rules(df).collect()}
    none = "no_dated_source_bounds_the_rule"
    assert got == {"a": (None, 10, 20), "b": ("stated_intervals_disagree", None, None), "c": (none, None, None), "d": ("stated_interval_is_empty", None, None), "e": (none, None, None), "f": (None, 5, None), "g": (none, None, None)}
    wanted = spark.createDataFrame([("a", hashlib.sha256(b"two").hexdigest()), ("f", "?")], "contract_id string, rule_digest string")
    got = {r["contract_id"]: (r["refusal"], r["in_force_from"], r["in_force_to"]) for r in evidence.attested_rules(df, wanted).collect()}
    assert got["a"] == (None, 20, 30) and got["f"] == (None, 5, None)


def test_second_grammar(spark):
    calendar = F.create_map(F.lit("2026-01"), F.lit("2026-01-28").cast("date"))
    end = " after the January 2026 meeting. The resolution source is official information from the Federal Reserve."
    bound = "upper bound of the target federal funds rate"
    rows = [
        ("No change?", f"If the {bound} is exactly the same as the level before{end}", "No change"), ("Cut by 50+ bps?", f"The {bound} is changed{end}", "50+ bps decrease"), ("Cut by 50 bps?", f"The {bound} is changed{end}", "25 bps decrease"),
        ("Will it hit ≥ 4.5%?", f"This will resolve to the {bound}{end}", "4.5%"), ("Will it be 4.5%?", f"This will resolve to the {bound}{end}", None), (None, None, None),
    ]
    df = spark.createDataFrame(rows, "q string, d string, t string")
    got = [r["v"] for r in df.coalesce(1).select(text.second_venue_predicate(F.col("q"), F.col("d"), F.col("t"), calendar).alias("v")).collect()]
    assert [(v["threshold"], v["inequality"], v["orientation"], v["refusal"]) for v in got] == [
        (0.0, None, 1, None), (-50.0, "below", 1, None), (None, None, None, "threshold_statements_disagree"), (4.5, None, 1, None), (None, None, None, "yes_side_unreadable"), (None, None, None, "settlement_subject_unreadable"),
    ]


def test_placebos_power_and_permutation(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=60)
    rows = [(i, i // 2, i, "ab"[i % 2], float(x[i]), float(0.5 * x[i] + rng.normal(0, 0.05)), float(rng.normal())) for i in range(60)]
    df = spark.createDataFrame(rows, "event int, cluster int, at int, fam string, x double, y double, before double")
    draws = stats.draws_table(spark, list(range(30)), 60, 1)
    got = {r["placebo"]: r for r in placebo.placebo_suite(df, placebo.Frame("y", "x", "event", "cluster", "at", "fam", before="before"), draws).collect()}
    assert got["reversed_direction"]["slope"] == pytest.approx(-got["baseline"]["slope"]) and got["baseline"]["lower"] > 0.2
    assert got["pre_release_lead"]["lower"] < 0 < got["pre_release_lead"]["upper"] and got["shifted_release_time"]["events"] == 58
    few = placebo.placebo_suite(df.where("event < 2"), placebo.Frame("y", "x", "event", "cluster", "at", "fam")).collect()
    assert {r["status"] for r in few} == {"inconclusive"}
    assert placebo.label_permutation(df, "fam", 39).first()["p"] == pytest.approx(1 / 40)
    assert placebo.label_permutation(df.withColumn("y", F.col("before")), "fam", 39).first()["p"] > 0.025
    rates = placebo.power(spark, repetitions=40, grid=(6, 60), sigma=0.03)
    by = {(r["hypothesis"], r["n_events"]): r["rate"] for r in rates.collect()}
    assert by["null", 24] <= 0.3 and by["relevant", 24] >= 0.7 and by["grid", 60] >= by["grid", 6] and placebo.events_for_power(rates) == 60
    assert sorted(rates.collect()) == sorted(placebo.power(spark, repetitions=40, grid=(6, 60), sigma=0.03).repartition(3).collect())


def test_registry_and_freeze(spark, tmp_path):
    runs = registry.RunRegistry(spark, f"file://{tmp_path}/registry")
    record = dict(run_id="r1", spec_hash="s", data_hash="d", source_hash="c", environment_hash="e", event_ids=["b", "a"], metrics={"mae": 0.1}, synthetic=True, created_at="2026")
    assert runs.record_run(record) == "r1" == runs.record_run(record) and runs.runs().count() == 1
    with pytest.raises(registry.RegistryConflict):
        runs.record_run(record | {"metrics": {"mae": 0.2}})
    for bad in ({"extra": 1}, {"metrics": None}, {"event_ids": []}, {"run_id": "r2", "metrics": {"mae": float("nan")}}):
        with pytest.raises(ValueError):
            runs.record_run(record | bad)
    assert runs.runs().count() == 1
    token = runs.reserve("spec", "data", ["x", "y"])
    for spec, events in (("spec", ["z"]), ("other", ["z", "y"])):
        with pytest.raises(registry.RegistryConflict):
            runs.reserve(spec, "data", events)
    runs.reserve("third", "data", ["z"])  # the failed attempts left no claim
    runs.finish(token, "complete", {"gain": 1})
    runs.finish(token, "complete", {"gain": 1})
    with pytest.raises(registry.RegistryConflict):
        runs.finish(token, "failed", {})

    (tmp_path / "a.yaml").write_text("one")
    root = f"file://{tmp_path}"
    frozen = registry.freeze(spark, root, ["a.yaml", "gone.yaml"], "2026-01-01", {"releases": 12})
    assert frozen["absent"] == ["gone.yaml"] and frozen["files"]["a.yaml"] == hashlib.sha256(b"one").hexdigest()
    assert registry.verify_freeze(spark, root, {**frozen, "stopping_rule": {}})["fields_moved"] == ["stopping_rule"]
    (tmp_path / "a.yaml").write_text("two")
    now = registry.verify_freeze(spark, root, frozen, ["a.yaml", "new.yaml"])
    assert now["drifted"] == ["a.yaml"] and now["undeclared"] == ["new.yaml"] and not now["verified"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "event int, cluster int, at int, fam string, x double, y double")
    assert placebo.placebo_suite(none, placebo.Frame("y", "x", "event", "cluster", "at", "fam")).count() == 0
    captures = spark.createDataFrame([], "contract_id string, instant long, ends long")
    contracts = spark.createDataFrame([("a", None, 5), ("b", 9, 9)], "contract_id string, opened long, closed long")
    got = evidence.release_readiness(spark.createDataFrame([(1, 9)], "event_id int, at long"), contracts, captures, 1, 1, 100).first()
    assert (got["state"], got["candidates"]) == ("no_candidates", 0)


def test_bounds_and_promotion(spark):
    assert stats.one_sided_bounds(0, 59) == pytest.approx((0.0, 1 - 0.05 ** (1 / 59))) and stats.one_sided_bounds(59, 59)[0] == pytest.approx(0.05 ** (1 / 59))
    assert stats.one_sided_bounds(5, 40) == pytest.approx((0.0506, 0.2458), abs=2e-3)
    assert [stats.promoted(*x, 0.01, 0.1) for x in ((0.02, 0.05), (0.02, 0.2), (0.005, 0.05), (None, 0.05))] == ["promoted", "not_promoted", "not_promoted", "inconclusive"]
    got = {r["scenario"]: r for r in simulate.calibrated(spark, ["shared_news_delay"], ["communication"], 30, 120, 1, ceiling=0.2).collect()}
    assert got["shared_news_delay"]["detected"] <= got["communication"]["detected"] and got["shared_news_delay"]["verdict"] in ("pass", "fail", "inconclusive")


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("bucket", [3, 10, 1000])
def test_asof_buckets_by_brute_force(spark, strict, bucket):
    rng = np.random.default_rng(bucket)
    records = [(["a", "b", None][i % 3], i, int(t) if t % 7 else None) for i, t in enumerate(rng.integers(-40, 40, 60))]
    probes = [(["a", "b", None, "none"][i % 4], i, int(t) if t % 9 else None) for i, t in enumerate(rng.integers(-45, 45, 60))]
    got = asof.asof_last(spark.createDataFrame(probes, "k string, p int, at long"), spark.createDataFrame(records, "k string, id int, time long"), ["k"], "at", "time", "id", [], strict, bucket).collect()
    want = {}
    for k, p, at in probes:
        fits = [(t, i) for key, i, t in records if key == k and t is not None and at is not None and (t < at or t == at and not strict)]
        want[p] = max(fits, default=(None, None))
    assert {r["p"]: (r["matched_time"], r["matched_id"]) for r in got} == want


def test_quote_panel_keeps_masked_rows(spark):
    quotes = spark.createDataFrame([("a", 1, 5, "valid", 5, 0.4, 0.6), ("a", 2, 12, "valid", 12, 0.6, 0.8), ("a", 3, 15, "halted", 15, 0.6, 0.8)], "contract string, record_id int, time long, state string, last_verified long, bid double, ask double")
    releases = spark.createDataFrame([(1, 10, None), (2, 3, None)], "event_id int, at long, contaminated array<struct<start:long,end:long>>")
    pairs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "x"), (2, "a")], "event_id int, contract string")
    contracts = spark.createDataFrame([("a", 0, None, 0)], "contract string, opened long, closed long, rule_from long")
    got = {(r["event_id"], r["contract"], r["horizon"]): r for r in panel.quote_panel(quotes, releases, pairs, contracts, (3, 6), 100).collect()}
    assert len(got) == 6 and got[1, "a", 3]["response"] == pytest.approx(0.2) and got[1, "a", 3]["baseline_age"] == 5
    assert got[1, "a", 6]["exclusion_reason"] == "endpoint_quote_invalid" and got[1, "x", 3]["exclusion_reason"] == "ineligible_contract" and got[2, "a", 3]["exclusion_reason"] == "missing_baseline"
