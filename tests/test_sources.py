from __future__ import annotations

import base64
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from roomledger import schema
from roomledger.operators import documents as T
from roomledger.operators import insights as I
from roomledger.sources import chart_files, csv_bookings, splits, stores


def test_csv_types_and_missing_values(edge):
    rows = edge.collect()
    assert len(rows) == 8
    assert dict(edge.dtypes) == {f.name: f.dataType.simpleString() for f in schema.BOOKINGS}
    assert [r.children for r in rows] == [0.0, None, 2.0, 2.0, 0.0, 1.0, 0.0, 0.0]
    assert [r.agent for r in rows] == [1.0, None, 9.0, 9.0, None, 1.0, 9.0, None]
    assert [r.country for r in rows] == ["PRT", "PRT", "GBR", "GBR", None, "GBR", "ESP", "ESP"]
    assert rows[5].market_segment is None


def test_every_spelling_of_a_missing_value(spark, tmp_path):
    lines = ["hotel,lead_time,adr,note"] + [f'"{t}","{t}","{t}","{t}"' for t in schema.NA_TOKENS]
    (tmp_path / "b.csv").write_text("\n".join(lines + ['none,7.0," 1.5 ","say ""hi"", x"', "x,1.5,abc,NA "]) + "\n")
    raw = csv_bookings.read_raw(spark, str(tmp_path / "b.csv"))
    rows = csv_bookings.typed_bookings(raw).collect()
    assert len(rows) == len(schema.NA_TOKENS) + 2
    assert all(v is None for r in rows[:-2] for v in r)
    assert tuple(rows[-2]) == ("none", 7, 1.5, 'say "hi", x')
    assert tuple(rows[-1]) == ("x", None, None, "NA ")
    rejected = {r["column"]: r["rejected"] for r in csv_bookings.rejected_values(raw).collect()}
    assert rejected == {"lead_time": 1, "adr": 1}


def test_csv_with_given_columns_and_line_breaks(spark, edge_csv, tmp_path):
    given = csv_bookings.read_bookings(spark, edge_csv, schema.BOOKINGS)
    assert given.count() == 8 and given.schema == csv_bookings.read_bookings(spark, edge_csv).schema
    (tmp_path / "m.csv").write_text('hotel,note\nA,"two\nlines"\n')
    rows = csv_bookings.read_bookings(spark, str(tmp_path / "m.csv"), multi_line=True).collect()
    assert [tuple(r) for r in rows] == [("A", "two\nlines")]


def test_columns_are_bound_by_header(spark, edge_csv, tmp_path):
    lines = [line.split(",") for line in Path(edge_csv).read_text().strip().split("\n")]
    for name, part in (("one", lines), ("two", lines)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.csv").write_text("\n".join(",".join(reversed(row)) for row in part) + "\n")
    expected = sorted(map(repr, csv_bookings.read_bookings(spark, edge_csv).select(*sorted(lines[0])).collect()))
    for columns in (None, schema.BOOKINGS):
        rows = csv_bookings.read_bookings(spark, str(tmp_path / "one"), columns)
        assert sorted(map(repr, rows.select(*sorted(lines[0])).collect())) == expected
    (tmp_path / "two" / "b.csv").write_text(Path(edge_csv).read_text())
    with pytest.raises(Exception, match="header"):
        csv_bookings.read_bookings(spark, str(tmp_path / "two")).collect()
    with pytest.raises(ValueError, match="lacks the columns"):
        csv_bookings.read_bookings(spark, edge_csv, T_.StructType([T_.StructField("elsewhere", T_.StringType())]))


@pytest.mark.parametrize("row", ["x", "x,1,2,3"])
def test_rows_with_another_number_of_fields_are_refused(spark, tmp_path, row):
    (tmp_path / "b.csv").write_text(f"hotel,lead_time,adr\nA,1,2\n{row}\n")
    with pytest.raises(Exception, match="another number of fields"):
        csv_bookings.read_bookings(spark, str(tmp_path / "b.csv")).collect()


def test_separator_and_encoding(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes("hotel;country\nMünchen;x\n".encode("latin-1"))
    rows = csv_bookings.read_bookings(spark, str(tmp_path / "b.csv"), separator=";", encoding="ISO-8859-1").collect()
    assert [tuple(r) for r in rows] == [("München", "x")]


def test_flat_documents_and_back(spark, clean):
    documents = T.insight_documents(I.insights_long(clean))
    flat = stores.flat_documents(documents)
    assert flat.columns == [f.name for f in schema.DOCUMENTS] and stores.flat_documents(flat) is flat
    back = {r.doc_id: r.metadata for r in stores.with_metadata(flat).collect()}
    assert back == {r.doc_id: r.metadata for r in documents.collect()}


def test_insights_json(spark, clean, tmp_path):
    rows = I.insights_long(clean)
    extra = spark.createDataFrame([("gap_rate", "x", None), ("gap_rate", "y", float("nan")), ("alone", None, None)], schema.INSIGHTS)
    path = str(tmp_path / "insights")
    for _ in range(2):
        stores.save_insights(rows.unionByName(extra), path)
    lines = [json.loads(line) for f in Path(path).glob("part-*") for line in f.read_text().splitlines()]
    found = {}
    for line in lines:
        assert set(line) == {"category", "subkey", "value"}
        if line["subkey"] is None:
            found[line["category"]] = line["value"]
        else:
            found.setdefault(line["category"], {})[line["subkey"]] = line["value"]
    assert set(found) == {*schema.CATEGORIES, "gap_rate", "alone"}
    assert found["revenue_by_hotel"] == {"City Hotel": 181.4375, "Resort Hotel": 334.5}
    assert found["overall_cancellation_rate"] == 42.857142857142854
    assert found["gap_rate"] == {"x": None, "y": None} and found["alone"] is None
    back = stores.load_insights(spark, path).where("category not in ('gap_rate', 'alone')")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)


def test_a_category_with_many_values(spark, tmp_path):
    many = spark.range(5000).selectExpr("'wide' as category", "concat('k', id) as subkey", "cast(id as double) as value")
    text = stores.insights_as_json(many)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Aggregate" not in text  # no category is gathered
    stores.save_insights(many, str(tmp_path / "wide"))
    assert stores.load_insights(spark, str(tmp_path / "wide")).exceptAll(many).count() == 0


def test_charts_of_a_folder(spark, tmp_path):
    images = {"monthly_revenue.png": b"\x89PNG-1", "my_own.chart.png": b"\x00" * 200, "notes.txt": b"no"}
    for name, content in images.items():
        (tmp_path / name).write_bytes(content)
    documents = T.graph_documents(chart_files.read_charts(spark, str(tmp_path))).collect()
    by_name = {d.metadata["graph_name"]: d for d in documents}
    assert set(by_name) == {"monthly_revenue", "my_own"}
    known, other = by_name["monthly_revenue"], by_name["my_own"]
    assert known.page_content == f"Graph: monthly_revenue - {schema.CHART_DESCRIPTIONS['monthly_revenue']}"
    assert other.page_content == "Graph: my_own - Graph showing data for my own."
    assert other.metadata["image_base64"] == base64.b64encode(b"\x00" * 200).decode()
    assert known.metadata["type"] == "graph" and known.metadata["description"] in known.page_content


def test_document_store_round_trip(spark, clean, tmp_path):
    vectors = T.embed(T.all_documents(I.insights_long(clean)), "page_content")
    path = str(tmp_path / "store")
    for _ in range(2):
        stores.save_documents(vectors, path)
    back = stores.load_documents(spark, path)
    assert sorted(back.select("doc_id", "page_content", "embedding").collect()) == sorted(
        vectors.select("doc_id", "page_content", "embedding").collect()
    )
    assert back.count() == back.select("doc_id").distinct().count()


def test_a_failed_write_leaves_the_store_as_it_was(spark, tmp_path):
    path = str(tmp_path / "store")
    table = lambda *ids: spark.createDataFrame([(i, "text") for i in ids], "doc_id string, page_content string")
    ids = lambda: sorted(r.doc_id for r in stores.load_documents(spark, path).collect())
    broken = table("c", "d").withColumn("page_content", F.when(F.col("doc_id") == "d", F.raise_error(F.lit("lost"))).otherwise("x"))
    with pytest.raises(Exception, match="lost"):
        stores.save_documents(broken, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|Unable to infer"):
        ids()
    stores.save_documents(table("a", "b"), path)
    reader = stores.load_documents(spark, path)
    with pytest.raises(Exception, match="lost"):
        stores.save_documents(broken, path)
    assert ids() == ["a", "b"]
    stores.save_documents(table("e"), path)
    assert ids() == ["e"] and reader.count() == 2  # a reader keeps the version it opened
    assert len(stores.unused_versions(spark, path)) == 1


def test_a_plain_folder_is_a_store(spark, tmp_path):
    spark.createDataFrame([("a", "x")], "doc_id string, page_content string").write.parquet(str(tmp_path / "plain"))
    assert stores.load_documents(spark, str(tmp_path / "plain")).count() == 1 and stores.unused_versions(spark, str(tmp_path / "plain")) == []


def test_spread_deals_rows_evenly(spark):
    one = spark.range(0, 8000, 1, 1).select(F.lit("same").alias("x"))
    sizes = [r["count"] for r in splits.spread(one).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 8000 and len(sizes) == 8 and max(sizes) < 1500
    enough = spark.range(0, 8000, 1, 8)
    assert splits.spread(enough) is enough
