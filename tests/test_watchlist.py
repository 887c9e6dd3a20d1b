"""Landed watchlists: lists of a bounded length, read without going back into the file."""

import tempfile
from pathlib import Path

from feedloom.plans import catalog, catalog_landed
from feedloom.sources import parse


def test_longer_tables_give_more_lists(spark, monkeypatch):
    monkeypatch.setattr(catalog_landed, "WATCHED", 5)
    folder = tempfile.mkdtemp(prefix="spark-")
    monkeypatch.setattr(catalog_landed.jobs, "shared_path", lambda s, name: f"{folder}/{name}")
    catalog.queries()["s3_watchlist"](spark, "/root/testdata/sf0.001")
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
    assert len(list(Path(folder).glob("watchlist/part=*"))) == -(-customers // 5)


def test_links_of_any_kind(spark, tmp_path):
    (tmp_path / "w.json").write_text('[{"symbol":"a","rss_links":["u","#",null,1]},{"symbol":"b","rss_links":"x"},{"symbol":"c","rss_links":"[\\"p\\"]"},{"symbol":"d"},{"symbol":"e","rss_links":5}]')
    rows = parse.read_watchlist(spark, str(tmp_path / "w.json")).collect()
    assert sorted((r.symbol, r.feed_url or "") for r in rows) == [("A", "1"), ("A", "u"), ("B", "x"), ("C", "p"), ("D", ""), ("E", "5")]
