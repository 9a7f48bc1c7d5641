"""Queries that write their rows as feed documents and parse them back."""

from datetime import date

import pytest

from urbanpulse.catalog import normalizing


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(1, 90, 25, 1, 5.0, 0.1, "A", date(1995, 3, 1)), (2, 1, 1, 2, 7.0, 0.0, "A", date(812, 12, 31)), (3, 7, 9, 7, 1.0, 0.1, "R", date(1995, 3, 1)),
            (4, 59, 23, 6, 9.0, 0.1, "N", None), (None, None, None, None, None, None, None, None), (None, 3, 4, 1, None, 0.2, "B", date(2024, 1, 1))]
    spark.createDataFrame(rows, """l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_tax double,
        l_returnflag string, l_shipdate date""").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 2, "view", "2024-01-01 00:00:00", '{"k": 3}'), (2, 3, "view", "2024-01-01 00:00:00", '{"k": 5}')],
                          "event_id long, user_id long, event_type string, ts string, props string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("query", [normalizing.xml_journeys, normalizing.xml_flights])
def test_documents_have_no_indentation(spark, folder, monkeypatch, query):
    texts, parsed_once = [], normalizing.parsed_once
    monkeypatch.setattr(normalizing, "parsed_once", lambda parser, text: texts.append(text) or parsed_once(parser, text))
    query(spark, folder)
    documents = [r.x.strip() for r in texts[0].collect()]
    assert documents and all(x.startswith("<") and "\n" not in x for x in documents)


def test_journeys_are_combined_without_sorting(spark, folder):
    found = normalizing.xml_journeys(spark, folder)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [
        ("A", 2, 12, -1, "08121231", "01:30:00"), ("N", 1, None, None, None, None)]


def test_journeys_of_no_rows(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/lineitem.parquet").limit(0).write.parquet(f"{tmp_path}/none/lineitem.parquet")
    assert normalizing.xml_journeys(spark, f"{tmp_path}/none").count() == 0
