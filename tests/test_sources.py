from __future__ import annotations

import hashlib
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators.splits import reservoir
from tesserae.sources import files
from tesserae.streaming.reservoir import latest, streaming_reservoir


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿name, size\n x , 3\n", encoding="utf-8")
    assert [x.asDict() for x in files.read_csv(spark, f"file://{tmp_path}/a.csv").collect()] == [{"name": "x", "size": "3"}]
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": \n')
    got = files.read_json_lines(spark, f"file://{tmp_path}/a.jsonl", "id int").cache().collect()
    assert [(x.id, x.broken is None) for x in got] == [(1, True), (None, False)]
    for name, text in (("l.json", '[{"id": 1}, {"id": 2}]'), ("s.json", '{"samples": [{"id": 1}, {"id": 2}]}')):
        (tmp_path / name).write_text(text)
        assert [x.id for x in files.read_manifest(spark, f"file://{tmp_path}/{name}", "id int").collect()] == [1, 2]


def test_xlsx(spark, tmp_path):
    sheet = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
    <row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>size</t></is></c></row><row r="2"></row>
    <row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><v>7</v></c></row></sheetData></worksheet>"""
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si><si><t>x</t></si></sst>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", sheet)
        book.writestr("xl/sharedStrings.xml", shared)
    assert [x.row for x in files.read_xlsx(spark, f"file://{tmp_path}/a.xlsx").collect()] == [{"name": "x", "size": "7"}]


def test_arrays(spark, tmp_path):
    plane, out = np.arange(30.0).reshape(5, 6), io.BytesIO()
    np.save(out, plane)
    (tmp_path / "a.npy").write_bytes(out.getvalue())
    got = np.zeros_like(plane)
    for x in files.read_arrays(spark, f"file://{tmp_path}/a.npy", tile=4).collect():
        got[x.y0 : x.y0 + x.height, x.x0 : x.x0 + x.width] = np.reshape(x["values"], (x.height, x.width))
    assert (got == plane).all()
    np.save(tmp_path / "bad.npy", np.full((2, 2), np.nan))
    with pytest.raises(Exception, match="not a finite"):
        files.read_arrays(spark, f"file://{tmp_path}/bad.npy").collect()


def test_streamed_reservoir_is_that_of_all_rows(spark, tmp_path):
    rows = spark.range(200).withColumn("v", F.col("id") * 2)
    rows.repartition(4).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"file://{tmp_path}/in")
    query = streaming_reservoir(stream, f"file://{tmp_path}/out", 20, "id", 5, checkpointLocation=f"file://{tmp_path}/state")
    query.processAllAvailable()
    last = query.lastProgress["batchId"] if query.lastProgress["numInputRows"] else query.recentProgress[-2]["batchId"]
    query.stop()
    assert {x.id for x in latest(spark, f"file://{tmp_path}/out", last).collect()} == {x.id for x in reservoir(rows, 20, 5, F.col("id")).collect()}


def test_workbooks_name_their_first_sheet_and_cells_may_lack_references(spark, tmp_path):
    sheet = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
    <row><c t="inlineStr"><is><t>name</t></is></c><c t="inlineStr"><is><t>size</t></is></c></row><row><c r="B2"><v>7</v></c></row></sheetData></worksheet>"""
    kinds = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book = f"""<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{kinds}"><sheets><sheet name="Later" sheetId="2" r:id="rId2"/></sheets></workbook>"""
    links = """<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId2" Target="worksheets/sheet9.xml"/></Relationships>"""
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as out:
        for name, text in (("xl/worksheets/sheet9.xml", sheet), ("xl/workbook.xml", book), ("xl/_rels/workbook.xml.rels", links)):
            out.writestr(name, text)
    assert [x.row for x in files.read_xlsx(spark, f"file://{tmp_path}/b.xlsx").collect()] == [{"name": "", "size": "7"}]


def test_files_below_a_folder(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    for name in ("a.npy", "d/b.npy", "d/e/c.txt"):
        np.save(tmp_path / name, np.ones((2, 2))) if name.endswith("npy") else (tmp_path / name).write_text("x")
    found = [x.path.rpartition("/")[2] for x in files.find_files(spark, f"file://{tmp_path}", "*.npy").collect()]
    assert found == ["a.npy", "b.npy"] and files.find_files(spark, f"file://{tmp_path}", "*.npy", "*.txt").count() == 3
    digests = {x.path.rpartition("/")[2]: x.sha256 for x in files.file_digests(spark, f"file://{tmp_path}").collect()}
    assert digests["c.txt"] == hashlib.sha256(b"x").hexdigest()
    sample = files.read_samples(spark, f"file://{tmp_path}/a.npy", "he").collect()[0]
    assert (sample.sample_id, sample.modality, sample.height) == ("a", "he", 2)


def test_names_of_morphology_channels(spark):
    kit = '"MorphologyKit": {"MorphologyReagents": [{"BiologicalTarget": "DNA", "Fluorophore": {"ChannelId": "U"}}]}'
    rows = [(1, '{"ChannelOrder": "BU", "ImPixelSize_nm": 120.28, %s}' % kit, 2), (2, '{"ChannelOrder": "BUG", "Channels": [{"UID": "U"}, {}], %s}' % kit, 2), (3, "{}", 2)]
    df = spark.createDataFrame(rows, "k int, j string, n int").select("k", files.morphology_channels(F.col("j"), F.col("n")).alias("m"))
    got = {x.k: x.m for x in df.collect()}
    assert got[1].names == ["B[B]", "DNA[U]"] and got[1].pixel_size_um == pytest.approx(0.12028)
    assert got[2].names == ["DNA[U]", "1[1]"] and got[3].names == ["channel_0[channel_0]", "channel_1[channel_1]"] and got[3].pixel_size_um is None
    paths = spark.createDataFrame([("x/run_s7_F1.tif",), ("x/other.ome.tif",)], "p string")
    assert [x[0] for x in paths.select(files.cohort_of_name(F.col("p"))).collect()] == ["S7", "other.ome"]


def test_strict_json(spark, tmp_path):
    for name, text in (("a", '{"b": 1, "a": [1.5, null]}'), ("b", '{"a": 1, "a": 2}'), ("c", '{"a": NaN}'), ("d", "[1]"), ("e", "{")):
        (tmp_path / f"{name}.json").write_text(text)
    got = {x.path[-6]: (x.document, x.error is None, x.sha256) for x in files.read_strict_json(spark, f"file://{tmp_path}").collect()}
    assert got["a"] == ('{"a":[1.5,null],"b":1}', True, hashlib.sha256(b'{"b": 1, "a": [1.5, null]}').hexdigest())
    assert all(got[k][0] is None and not got[k][1] for k in "bcde")


def test_sinks(spark, tmp_path):
    df = spark.sql("SELECT 1 AS k, named_struct('x', double('NaN'), 'y', named_struct('z', 2.5D)) AS s, array(1, 2) AS a UNION ALL SELECT 2, NULL, NULL")
    files.write_json(df, f"file://{tmp_path}/j")
    lines = [json.loads(x) for p in sorted((tmp_path / "j").glob("*.json")) for x in p.read_text().splitlines()]
    assert {x["k"]: x for x in lines} == {1: {"k": 1, "s": {"x": None, "y": {"z": 2.5}}, "a": [1, 2]}, 2: {"k": 2, "s": None, "a": None}}
    files.write_csv(df, f"file://{tmp_path}/c")
    back = spark.read.csv(f"file://{tmp_path}/c", header=True)
    assert back.columns == ["k", "s.x", "s.y.z", "a"] and sorted(map(tuple, back.collect()))[0] == ("1", None, "2.5", "[1,2]")
    assert files.markdown_table(files.flattened(df).select("k", "`s.y.z`"), ["k"]) == "| k | s.y.z |\n| --- | --- |\n| 1 | 2.500 |\n| 2 | n/a |"
    with pytest.raises(ValueError):
        files.markdown_table(spark.range(5), ["id"], most=3)
