"""The incremental join as a stream."""

from tracklens.fixtures import fixture
from tracklens.streaming.new_files import LISTED, adopt_new_files, current_report

SF = "/root/testdata/sf0.001"


def test_new_files_are_taken_once(spark, tmp_path):
    columns = [c.split()[0] for c in LISTED.split(", ")]
    headers = fixture(spark, SF, "fx_headers").select(*columns)
    landing, report, checkpoint = (str(tmp_path / n) for n in ("landing", "report", "checkpoint"))
    headers.where("total_samples % 2 = 0").write.parquet(landing)
    adopt_new_files(spark, landing, report, checkpoint).awaitTermination()
    headers.write.mode("append").parquet(landing)
    adopt_new_files(spark, landing, report, checkpoint).awaitTermination()
    held = spark.read.parquet(report)
    assert held.count() == headers.count() == held.select("path").distinct().count()
    assert held.where("is_partial = 1").count() == headers.count()


def test_changed_files_are_taken_again_over_ten_batches_and_a_restart(spark, tmp_path):
    landing, report, checkpoint = (str(tmp_path / n) for n in ("landing", "report", "checkpoint"))
    row = lambda path, size, mtime: (path, 44100, 2, 16, 4096, 1000, size, mtime, "ab", None)
    batches = [
        [row("a", 1, 1), row("b", 1, 1)], [row("a", 1, 1)], [row("a", 2, 1)], [row("b", 1, 5), row("b", 1, 4)], [row("c", None, None)], [row("c", None, None), row("c", 3, 3)],
        [row("a", 1, 1)], [row("d", 1, 1)] * 3, [row(x, 1, 1) for x in "ad"], [row("e", 1, 1), row("b", 1, 5)],
    ]
    known, wanted = {}, []
    for number, rows in enumerate(batches):
        taken = {}
        for r in sorted(rows, key=lambda r: (r[7] or -1, r[6] or -1)):
            taken[r[0]] = (r[6], r[7])
        wanted += [(number, p, *v, "changed" if p in known else "new") for p, v in taken.items() if known.get(p) != v]
        known |= taken
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, LISTED).coalesce(1).write.mode("append").parquet(landing)
        adopt_new_files(spark, landing, report, checkpoint).awaitTermination()
    held = spark.read.parquet(report)
    assert sorted((r["batch"], r["path"], r["file_size"], r["mtime_us"], r["change"]) for r in held.collect()) == sorted(wanted, key=lambda x: x[:2])
    now = {r["path"]: (r["file_size"], r["mtime_us"], r["is_partial"]) for r in current_report(spark, report).collect()}
    assert now == {p: (*v, 1) for p, v in known.items()}


def test_a_path_with_one_row_is_not_sorted(monkeypatch):
    import pandas as pd

    from tracklens.streaming import new_files

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    def arrived(state, *parts):
        return [r for df in new_files._arrived(("a",), iter([pd.DataFrame(p, columns=["path", "file_size", "mtime_us"]) for p in parts]), state) for r in df.itertuples(index=False, name=None)]

    state, several = State(), State()
    assert arrived(several, [("a", 1, 1), ("a", 1, 5)], [("a", 3, 2)]) == [("a", 1, 5, "new")] and arrived(several, [("a", 9, 4), ("a", 1, 5)]) == []
    monkeypatch.setattr(pd.DataFrame, "sort_values", lambda *_, **__: 1 / 0)
    assert [arrived(state, [("a", *x)]) for x in ((1, 1), (1, 1), (2, 1), (1, 1))] == [[("a", 1, 1, "new")], [], [("a", 2, 1, "changed")], [("a", 1, 1, "changed")]]
