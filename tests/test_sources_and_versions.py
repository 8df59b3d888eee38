"""Feeds read by ranges, panels published in versions, and stream state, with what can go wrong in each."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattline.functions.staging import scratch, stage
from wattline.operators import folds, gaps, quality
from wattline.functions import chunks
from wattline.plans import workflow
from wattline.schema import DAY_AHEAD, DEMAND, FETCHED, KEYS, PRICE, QUALITY, RENEWABLE, TS
from wattline.sources import ranges
from wattline.sources.versions import Conflict, VersionedPanel
from wattline.streaming import flows

START = dt.datetime(2024, 1, 1)
HOUR, DAY = dt.timedelta(hours=1), dt.timedelta(days=1)
VALUES = (PRICE, DAY_AHEAD, DEMAND, RENEWABLE)


def feed(broken=None):
    """Every hour has a row; asking for the broken hour fails, whatever the range around it."""
    hour, width = HOUR, len(VALUES)

    def fetch(key, start, end):
        if broken is not None and start <= broken < end:
            raise ConnectionError("no answer")
        t = start
        while t < end:
            yield (t, *[float(t.hour)] * width)
            t += hour

    return fetch


def test_a_failing_range_is_halved_down_to_a_day():
    broken = START + dt.timedelta(days=11, hours=5)
    got = list(ranges.attempts(feed(broken), ("A",), START, START + 30 * DAY))
    failed = [r for r in got if r[0] is None]
    assert len(failed) == 1 and failed[0][1] <= broken < failed[0][2] and failed[0][2] - failed[0][1] <= DAY
    times = [r[0][0] for r in got if r[0] is not None]
    assert times == sorted(times) and len(set(times)) == len(times) == 30 * 24 - (failed[0][2] - failed[0][1]) // HOUR
    assert ranges.halves(START, START + DAY) is None and ranges.halves(START, START + DAY + HOUR / 2)[0][1].minute == 0


def test_ranges_are_partitions_of_the_source(spark):
    asked = [("A", START, START + 3 * DAY), ("B", START, START + 2 * HOUR), ("C", START, START), ("D", None, START)]
    df = spark.createDataFrame(asked, "series_id string, range_start timestamp, range_end timestamp")
    rows, failed = ranges.fetch_ranges(df, feed(START + DAY + HOUR), VALUES, per_task=1)
    assert {r["series_id"]: r["n"] for r in rows.groupBy("series_id").agg(F.count("*").alias("n")).collect()} == {"A": 54, "B": 2}
    bad = failed.collect()
    assert len(bad) == 1 and bad[0]["series_id"] == "A" and "no answer" in bad[0]["error"]
    assert bad[0]["failed_end"] - bad[0]["failed_start"] <= DAY
    rows, failed = ranges.fetch_ranges(df.limit(0), feed(), VALUES)
    assert rows.count() == 0 and failed.count() == 0


def test_refresh_survives_a_failing_range_and_counts_it(spark):
    end = START + 4 * DAY - HOUR
    old = [("A", START + i * HOUR, *[1.0] * 4) for i in range(10)]
    old = spark.createDataFrame(old, f"series_id string, {TS} timestamp, " + ", ".join(f"{c} double" for c in VALUES))
    old = quality.annotate_source(old, VALUES, "feed", F.lit(START))
    out = workflow.refresh_panel(
        old, spark.createDataFrame([("A",)], "series_id string"), str(START), str(end),
        lambda r: ranges.fetch_ranges(r, feed(START + 2 * DAY), VALUES), "feed", F.lit(START), VALUES, VALUES,
    )
    d = out.diagnostics.first()
    lost = out.failed.first()
    hours = int((lost["failed_end"] - lost["failed_start"]) / HOUR)
    assert d["fetch_failed_range_count"] == 1 and 0 < hours <= 24
    assert d["fetched_rows"] == 86 - hours and d["real_rows"] == 96 - hours
    assert out.panel.count() == 96 and out.panel.where(F.col(QUALITY) == "synthetic").count() == hours


def rows(spark, hours, value, at=START):
    data = [("A", START + h * HOUR if h is not None else None, value, "real", at) for h in hours]
    return spark.createDataFrame(data, f"series_id string, {TS} timestamp, {PRICE} double, {QUALITY} string, {FETCHED} timestamp")


def best(df):
    return quality.upsert_by_quality(df)


def values(panel, version=None):
    return {r[TS]: r[PRICE] for r in panel.read(version).collect()}


def test_versions_batches_and_months(spark):
    panel = VersionedPanel(spark, scratch(spark, "panel"))
    assert panel.read() is None
    first = panel.merge(rows(spark, range(0, 24 * 60, 24), 1.0), best, "s", 0)
    assert first.version == 1 and sorted(first.months) == ["2024-01", "2024-02"] and first.metrics["rows"] == 60
    second = panel.merge(rows(spark, [24 * 40], 2.0, START + HOUR), best, "s", 1)
    # Only February has a new folder; January is the same files as before.
    assert second.months["2024-01"] == first.months["2024-01"] and second.months["2024-02"] != first.months["2024-02"]
    assert panel.merge(rows(spark, [0], 9.0, START + 5 * DAY), best, "s", 1).version == 2
    assert panel.merge(rows(spark, [], 9.0), best, "s", 2).version == 2
    assert values(panel)[START + 40 * DAY] == 2.0 and values(panel, 1)[START + 40 * DAY] == 1.0 and len(values(panel)) == 60
    assert panel.read(months=["2024-02", "2030-01"]).count() == 29
    assert all("month=2024-02" in f for f in panel.read(months=["2024-02"]).inputFiles())
    # The first folder still holds January; once that is written anew nothing of it is left.
    assert panel.vacuum(keep=1) == [] and panel.versions() == [2]
    panel.merge(rows(spark, [0], 9.0, START + 5 * DAY), best, "s", 3)
    assert panel.vacuum(keep=1) == [first.months["2024-01"]] and len(values(panel)) == 60 and values(panel)[START] == 9.0


@pytest.mark.parametrize("bad, rule", [([0, 0], "duplicate_timestamp=1"), ([1, None], "invalid_timestamp=1")])
def test_broken_rows_are_not_published(spark, bad, rule):
    panel = VersionedPanel(spark, scratch(spark, "panel"), rules=quality.PanelRules(required=(PRICE,)))
    panel.merge(rows(spark, [5], 1.0), best)
    with pytest.raises(ValueError, match=rule):
        panel.merge(rows(spark, bad, 2.0), lambda df: df.where(F.col(PRICE) == 2.0))
    with pytest.raises(ValueError, match="null_required=1"):
        panel.merge(rows(spark, [7], None), best)
    assert list(values(panel).values()) == [1.0] and panel.versions() == [1]


def test_a_killed_write_and_a_faster_writer(spark, monkeypatch):
    panel = VersionedPanel(spark, scratch(spark, "panel"))
    panel.merge(rows(spark, [0], 1.0), best, "s", 0)
    publish = panel.files.publish
    monkeypatch.setattr(panel.files, "publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        panel.merge(rows(spark, [1], 2.0), best, "s", 1)
    monkeypatch.setattr(panel.files, "publish", publish)
    assert list(values(panel).values()) == [1.0]
    base = panel.manifest()
    panel.merge(rows(spark, [1], 2.0), best, "s", 1)
    with pytest.raises(Conflict):
        panel.replace(rows(spark, [2], 3.0), base, ["2024-01"])
    # A merge that is overtaken starts again from the newer version and loses nothing.
    other, calls = VersionedPanel(spark, panel.root), []

    def overtaken(df):
        if not calls:
            calls.append(1)
            other.merge(rows(spark, [3], 4.0), best, "other", 0)
        return best(df)

    panel.merge(rows(spark, [2], 3.0), overtaken, "s", 2)
    assert sorted(values(panel).values()) == [1.0, 2.0, 3.0, 4.0]


def run_positions(spark, batches, delay=0):
    folder, out, late = (scratch(spark, n) for n in ("in", "out", "late"))
    schema = f"series_id string, {TS} timestamp, target_position double, {PRICE} double, exposure_mwh double"
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    frame = flows.position_states(stream, flows.PositionSettings(0.35, 1.0, 10000.0, delay_seconds=delay))
    frame.writeStream.foreachBatch(flows.split_late(out, late)).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(frame.drop("late").schema).parquet(f"{out}/*").orderBy(TS).collect()
    return got, spark.read.schema(f"series_id string, {TS} timestamp").parquet(f"{late}/*").collect()


def market(n):
    return [("A", START + i * HOUR, [1.0, -1.0, None, 0.2][i % 4], 10.0 + (i * 7) % 5 if i % 6 else None, 100.0) for i in range(n)]


def test_stream_equity_is_that_of_the_batch(spark):
    data = market(48)
    got, late = run_positions(spark, [data[:20][::-1], data[20:]])
    assert not late and [r[TS] for r in got] == [r[1] for r in data]
    schema = f"series_id string, {TS} timestamp, target_position double, {PRICE} double, exposure_mwh double"
    part = stage(chunks.core(chunks.split(spark.createDataFrame(data, schema), TS), keep_chunk=True))
    ramp = part.join(folds.position_ramp(part, 0.35, 1.0), [*chunks.chunk_keys(KEYS), TS])
    path = {r[TS]: r for r in ramp.collect()}
    pnl = []
    for before, now in zip(data, data[1:]):
        move = None if before[3] is None or now[3] is None else now[3] - before[3]
        pnl.append(("A", now[1], 0.0 if move is None else path[before[1]]["_before"] * move * 100.0))
    money = spark.createDataFrame([("A", START, 0.0), *pnl], f"series_id string, {TS} timestamp, pnl0 double")
    money = chunks.core(chunks.split(money, TS), keep_chunk=True)
    equity = {r[TS]: r["equity_eur"] for r in folds.equity_curve(stage(money), "pnl0", 10000.0).collect()}
    for r in got:
        assert r["position_after"] == pytest.approx(path[r[TS]]["target_position_constrained"])
        assert r["gross_equity_eur"] == pytest.approx(equity[r[TS]])


def test_rows_wait_for_their_delay_and_late_ones_go_aside(spark):
    data = market(30)
    late_row = data[3]
    got, late = run_positions(spark, [data[:10], [data[12]], [data[10], data[11], late_row], data[13:]], delay=3 * 3600)
    assert [r[TS] for r in late] == [late_row[1]]
    # The last three hours still wait; the others are folded in order although they came out of order.
    assert [r[TS] for r in got] == [r[1] for r in data[:27]]
    straight, _ = run_positions(spark, [data])
    assert [r["gross_equity_eur"] for r in got] == [r["gross_equity_eur"] for r in straight[:27]]
