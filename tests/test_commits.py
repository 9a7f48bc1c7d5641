"""Runs that crash, break or are replaced: readers see whole runs, each once."""

from datetime import date

import pytest
from test_sources import FLIGHT, parquet

from urbanpulse.plans import normalization
from urbanpulse.plans.normalization import compact_feed, normalize_feed, sweep_feed
from urbanpulse.sources import commits, sinks, snapshots

NAMES = ("write_normalized", "write_outcome", "mark_processed", "end_run")


def flights(spark, raw, name, ids, day="2026-01-31"):
    parquet(spark, raw / f"avinor/{day}/{name}.parquet", [("OSL", f"{day}T10:00:00Z", None, i, "D") for i in ids], FLIGHT)
    return raw / f"avinor/{day}/{name}.parquet"


def broken_page(file):
    """Spoil the pages of a file and leave its footer as it is."""
    data = bytearray(file.read_bytes())
    footer = int.from_bytes(data[-8:-4], "little") + 8
    for i in range(4, len(data) - footer):
        data[i] ^= 0x5A
    file.write_bytes(bytes(data))


@pytest.fixture
def zone(spark, tmp_path):
    class Zone:
        raw, out, ledger = tmp_path / "raw", str(tmp_path / "n"), str(tmp_path / "l")
        table = f"{out}/flights"

        def run(self, **options):
            return tuple(normalize_feed(spark, str(self.raw), self.out, self.ledger, "flights", all_dates=True, **options))

        def ids(self):
            return sorted(r["uniqueID"] for r in snapshots.read_normalized_table(spark, self.out, "flights").collect())

        def reasons(self):
            return {r["key"].rpartition("/")[2]: r["reason"] for r in sinks.read_unread(spark, self.ledger).collect()}

    return Zone()


def test_a_file_with_broken_pages_is_set_aside(spark, zone):
    """Its footer is sound, so only reading tells."""
    flights(spark, zone.raw, "A_100000", ["a1", "a2"])
    broken_page(flights(spark, zone.raw, "B_110000", [f"b{i}" for i in range(50)]))
    flights(spark, zone.raw, "C_120000", ["c1"], "2026-02-01")
    assert zone.run() == (2, 1) and zone.ids() == ["a1", "a2", "c1"]
    assert list(zone.reasons()) == ["B_110000.parquet"] and "of 50 rows could be read" in zone.reasons()["B_110000.parquet"]
    flights(spark, zone.raw, "D_130000", ["d1"])
    assert zone.run() == (1, 1) and zone.ids() == ["a1", "a2", "c1", "d1"]
    flights(spark, zone.raw, "B_110000", ["b0"])  # mended
    assert zone.run() == (1, 0) and zone.ids() == ["a1", "a2", "b0", "c1", "d1"]


def test_a_file_whose_types_differ_is_cornered(spark, zone):
    for i in range(5):
        flights(spark, zone.raw, f"A_10000{i}", [f"a{i}"])
    parquet(spark, zone.raw / "avinor/2026-01-31/X_110000.parquet", [(1, 2)], "airport bigint, uniqueID bigint")
    assert zone.run() == (5, 1) and zone.ids() == [f"a{i}" for i in range(5)]
    assert list(zone.reasons()) == ["X_110000.parquet"]


def test_rerun_keeps_the_rows_of_files_it_cannot_read(spark, zone):
    flights(spark, zone.raw, "A_100000", [f"a{i}" for i in range(10)])
    second = flights(spark, zone.raw, "B_110000", [f"b{i}" for i in range(10)])
    flights(spark, zone.raw, "C_120000", ["c"], "2026-02-01")
    assert zone.run() == (3, 0)
    before = zone.ids()
    broken_page(second)
    flights(spark, zone.raw, "D_130000", ["d"], "2026-02-01")
    assert zone.run(rerun_all=True) == (2, 2)  # the second date is replaced, the first one kept
    assert zone.ids() == sorted([*before, "d"])
    assert "not replaced" in zone.reasons()["A_100000.parquet"]
    second.unlink()
    assert zone.run(rerun_all=True) == (2, 1) and zone.ids() == sorted([*before, "d"])


@pytest.mark.parametrize("rerun", (False, True))
@pytest.mark.parametrize("step", NAMES)
def test_a_crash_at_each_step(spark, zone, monkeypatch, step, rerun):
    """What is read in between is the old or the new table, and the next call ends the run."""
    flights(spark, zone.raw, "A_100000", ["a1"])
    zone.run()
    flights(spark, zone.raw, "B_110000", ["b1", "b2"])
    sound = getattr(normalization, step)

    def crash(*args, **options):
        if step == "write_normalized":
            sound(*args, **options)
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(normalization, step, crash)
        with pytest.raises(KeyboardInterrupt):
            zone.run(rerun_all=rerun)
    assert zone.ids() == (["a1"] if step in ("write_normalized", "write_outcome") else ["a1", "b1", "b2"])
    assert sum(zone.run()) == (2 if rerun else 1) and zone.ids() == ["a1", "b1", "b2"]
    assert zone.run() == (0, 0) and not sinks.open_runs(spark, zone.ledger, "flights")


def test_a_reader_keeps_its_version(spark, zone):
    flights(spark, zone.raw, "A_100000", ["a1"])
    zone.run()
    early = snapshots.read_normalized_table(spark, zone.out, "flights")
    flights(spark, zone.raw, "B_110000", ["b1"])
    zone.run(rerun_all=True)
    assert early.count() == 1 and zone.ids() == ["a1", "b1"]
    assert sweep_feed(spark, zone.out, zone.ledger, "flights", keep=1) == 1 and zone.ids() == ["a1", "b1"]
    assert len(commits.versions(spark, zone.table)) == 1


def test_compaction_and_a_run_in_between(spark, zone, monkeypatch):
    for i in range(4):
        flights(spark, zone.raw, f"A_10000{i}", [f"a{i}"])
        zone.run()
    flights(spark, zone.raw, "C_120000", ["c"], "2026-02-01")
    zone.run()
    put = commits._put

    def late(*args):
        monkeypatch.setattr(commits, "_put", put)
        flights(spark, zone.raw, "B_110000", ["b"])
        zone.run()
        return put(*args)

    monkeypatch.setattr(commits, "_put", late)
    assert compact_feed(spark, zone.out, "flights") == ["2026-01-31"]
    assert zone.ids() == ["a0", "a1", "a2", "a3", "b", "c"]
    assert compact_feed(spark, zone.out, "flights") == ["2026-01-31"] and compact_feed(spark, zone.out, "flights") == []
    sweep_feed(spark, zone.out, zone.ledger, "flights", keep=1)
    files = snapshots.read_normalized_table(spark, zone.out, "flights").inputFiles()
    assert len(files) == 2 and zone.ids() == ["a0", "a1", "a2", "a3", "b", "c"]
    zone.run(rerun_all=True)
    assert zone.ids() == ["a0", "a1", "a2", "a3", "b", "c"]


def test_runs_take_whole_dates_up_to_a_bound(spark, zone, monkeypatch):
    monkeypatch.setattr(normalization, "RUN_FILES", 2)
    for day in range(1, 5):
        flights(spark, zone.raw, "A_100000", [f"a{day}"], f"2026-01-0{day}")
    assert zone.run() == (4, 0) and zone.ids() == ["a1", "a2", "a3", "a4"]
    assert commits.parts(spark, zone.table).select("run").distinct().count() == 2


def test_only_the_interval_is_listed(spark, zone):
    for day in ("2026-01-30", "2026-01-31", "2026-02-01", "2026-02-30"):
        flights(spark, zone.raw, "A_100000", [day], day)
    flights(spark, zone.raw, "[x]_100000", ["x"], "odd [name]")
    names = snapshots.dated_folders(spark, f"{zone.raw}/avinor", ("2026-01-31", "2026-01-31"))
    assert sorted(n.rpartition("/")[2] for n in names) == ["2026-01-31", "2026-02-30", "odd \\[name\\]"]
    files = snapshots.listing(spark, f"{zone.raw}/avinor", dates=("2026-01-31", None))
    assert files.count() == 4
    assert tuple(normalize_feed(spark, str(zone.raw), zone.out, zone.ledger, "flights", "2026-01-30", "2026-01-31")) == (2, 0)
    assert tuple(normalize_feed(spark, str(zone.raw), zone.out, zone.ledger, "flights", str(date.today()))) == (2, 0)
