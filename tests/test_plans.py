"""What the plans of the registered listing queries look like, and that all of them run on small data."""

import re
import time

import pytest

import __spark_entry__
from marram.functions.constants import AREA_ALIASES
from marram.operators.search import search_places
from marram.plans import queries, views
from marram.schemas import LISTING, PLACE, names

SF = "/root/testdata/sf0.001"
NAMES = sorted(queries.queries())


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", NAMES)
def test_runs_in_the_jvm(spark, name):
    df = queries.queries()[name](spark, SF)
    text = plan(df)
    assert not re.search("Python|Pandas|MapInArrow", text), name
    assert "CartesianProduct" not in text, name
    assert len(set(map(str.lower, df.columns))) == len(df.columns) and df.limit(5).collect() is not None
    assert name in queries.oracle_sql()


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["source", "source_listing_id", "observed_on", "advertised_price", "change", "previous"]


def test_scans_read_what_they_need(spark):
    text = plan(queries.queries()["freshness"](spark, SF))
    schema = re.findall(r"ReadSchema: (struct<[^>]*>)", text)[-1]
    assert "value" not in schema and "event_type" in schema
    text = plan(views.table(spark, SF, "documents").where("n_chars > 100").select("doc_id"))
    assert "GreaterThan(n_chars,100)" in text and "text" not in re.findall(r"ReadSchema: (struct<[^>]*>)", text)[-1]


def test_search_prunes_before_it_quotes(spark):
    """Only a state's listed units meet the query, and the query is a broadcast row."""
    units = views.view(spark, SF, "fx_units").selectExpr("*", "'LISTED' AS status", "'a' AS area", "'X' AS title_document")
    from marram.operators.pricing import default_fee_policies

    text = plan(search_places(units, units.select("partner_id"), default_fee_policies(spark), state="LA", check_in="2026-05-01", check_out="2026-05-03"))
    assert "BroadcastNestedLoopJoin" in text and "CartesianProduct" not in text


def test_stream_dedupe_has_no_late_rows(spark, tmp_path, monkeypatch):
    """The latest days land first on a table that spans 400 days."""
    rows = [(day, user) for user in range(5) for day in (0, 1, 150, 300, 399)]
    events = spark.createDataFrame(rows, "day int, user_id long")
    events = events.selectExpr("user_id as seq", "'a' as source", "cast(user_id as string) as source_listing_id", "date_add(date'2024-01-01', day) as observed_on")
    monkeypatch.setattr(queries, "view", lambda *_: events)

    def stream(spark, sf_dir):
        for k, part in enumerate(("day = 399", "day = 150 or day = 300", "day < 100")):
            days = events.where(part.replace("day", "datediff(observed_on, date'2024-01-01')")).coalesce(1)
            days.write.mode("append").parquet(f"{tmp_path}/in")
            if k < 2:
                time.sleep(1.1)
        return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), str(tmp_path)

    monkeypatch.setattr(queries, "_event_stream", stream)
    assert queries.queries()["stream_dedupe"](spark, SF).count() == len(rows)


def test_schemas_and_tables():
    assert len(names(LISTING)) == 26 and len(names(PLACE)) == 28 and names(PLACE)[19] == "first_seen_at"
    assert len(AREA_ALIASES) == 38
