"""Scraped trip files: names come from the path."""

from tramline.sources import store


def test_path_parts_are_counted_from_the_end(spark, tmp_path):
    """A pattern tied only to the end of the path was tried at every place of every row's path."""
    for route, trip in (("R 1", "T1"), ("R2", "T=2")):
        folder = tmp_path / "a%20deep" / "tree" / route / f"{route}_2024-01-01" / trip
        folder.mkdir(parents=True)
        (folder / "part.csv").write_text("id\n1\n2\n")
    out = store.scan_trip_path_files(spark, str(tmp_path), "id long")
    assert {tuple(r) for r in out.select("route_folder", "route_date", "trip_folder", "id").collect()} == {
        (r, f"{r}_2024-01-01", t, i) for r, t in (("R 1", "T1"), ("R2", "T=2")) for i in (1, 2)}
    assert "regexp" not in out._jdf.queryExecution().executedPlan().toString()
