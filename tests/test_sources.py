"""Sources, sinks and streams over small files of their own."""

import json
import zipfile

import pytest

from ledgerline.operators import chunking, retrieval
from ledgerline.sources import files
from ledgerline.streaming import events


def test_uploads_by_content(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.docx", "w") as z:
        z.writestr("word/document.xml", "<x/>")
    with zipfile.ZipFile(tmp_path / "sheet.docx", "w") as z:
        z.writestr("xl/workbook.xml", "<x/>")
    for name, data in {"a.pdf": b"%PDF-1.7 x", "b.docx": b"%PDF-1.7 x", "c.pdf": b"hello world"}.items():
        (tmp_path / name).write_bytes(data)
    found = {r["file_name"]: (r["kind"], r["refused"]) for r in files.uploads(spark, str(tmp_path)).collect()}
    assert found == {"good.docx": ("docx", None), "sheet.docx": ("docx", "not a text document"), "a.pdf": ("pdf", None), "b.docx": ("pdf", "content differs from name"), "c.pdf": (None, "unknown content")}


def test_units_of_texts_pages_and_requirements(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "Customs_Act.txt").write_text("one\ntwo")
    (unit,) = files.text_units(spark, str(tmp_path / "t")).collect()
    assert (unit["slug"], unit["page"], unit["unit"], unit["text"]) == ("customs-act", None, 0, "one\ntwo")
    pages = spark.createDataFrame([(1, "cotton"), (2, "Raw COTTON"), (3, "silk"), (4, "cotton")], "page int, text string")
    assert [r["page"] for r in files.page_units(pages, 2, 3, "cotton").collect()] == [2]
    doc = {"common": {"note": "n", "documents": ["invoice", "packing list"]}, "origin": {"note": "o"}, "products": [{"pct_code": "61091000", "name": "T-shirts", "licence": "false", "permit": None}]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    units = [tuple(r) for r in files.json_units(spark, str(tmp_path / "r.json")).orderBy("unit").collect()]
    assert units == [("common", None, 0, "n\nDocuments: invoice, packing list"), ("origin", None, 1, "o"), ("product-61091000", None, 2, "Product: T-shirts\nPCT code: 61091000\nLicence required: false")]


def test_catalog_and_report(spark, tmp_path):
    doc = {"pct_codes": ["61091000", "52010090", "99999999"], "products": [{"pct_code": "61091000", "simple_product_name": "shirts", "validation_status": "verified"}, {"pct_code": "52010090", "simple_product_name": "cotton", "validation_status": "verified", "textile_category": "raw_material"}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    rows = files.catalog(spark, str(tmp_path / "c.json"))
    assert [(r["code"], r["name"], r["category"]) for r in rows.collect()] == [("52010090", "cotton", "raw_material"), ("61091000", "shirts", "other"), ("99999999", None, None)]
    for _ in range(2):  # a report that is written again takes the place of the first
        files.write_report(rows, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def _drop(folder, name, rows, spark, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / name))


@pytest.mark.parametrize("again", [False, True])
def test_each_event_once_over_batches(spark, tmp_path, again):
    inbox, target = tmp_path / "in", str(tmp_path / "target")
    inbox.mkdir()
    row = lambda i: (i, None, 1, "view", 1.0, "{}")
    for n, ids in enumerate(([1, 2, 2], [2, 3], [1, 3, 4])):
        _drop(inbox, f"part{n}", [row(i) for i in ids], spark, events.SCHEMA)
        checkpoint = str(tmp_path / (f"check{n}" if again else "check"))  # a lost checkpoint offers all batches again
        events.ingest_once(events.read_events(spark, str(inbox), "*.parquet"), target, checkpoint)
    got = sorted(r["event_id"] for r in spark.read.parquet(target).collect())
    assert got == [1, 2, 3, 4]


def test_unchanged_sources_are_skipped(spark, tmp_path):
    inbox, target, schema = tmp_path / "in", str(tmp_path / "target"), "source_path string, checksum string"
    inbox.mkdir()
    for n, rows in enumerate(([("a", "1"), ("b", "1")], [("a", "1"), ("b", "2")])):
        _drop(inbox, f"part{n}", rows, spark, schema)
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(inbox))
        events.ingest_changed(stream, target, str(tmp_path / "check"))
    assert sorted((r["source_path"], r["checksum"]) for r in spark.read.parquet(target).collect()) == [("a", "1"), ("b", "1"), ("b", "2")]


def test_recency_when_a_vector_does_not_fit(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0])], "doc_id long, embedding array<float>")
    recent = spark.createDataFrame([(1, 5), (2, 9), (3, 7)], "doc_id long, updated_at int")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [r["doc_id"] for r in retrieval.similar_shipments(vectors, asked, recent, 2).collect()] == [2, 3]
    assert [r["doc_id"] for r in retrieval.similar_shipments(vectors.where("doc_id < 3"), asked, recent, 1).collect()] == [1]


def test_sections_and_windows():
    long = "x" * 1000
    assert chunking.parent_sections(f"{long}\n\n{long}\n\nshort\r\n\r\nSchedule I\n\n\n\nend") == [long, f"{long}\n\nshort", "Schedule I\n\nend"]
    assert chunking.parent_sections("  ") == [] and chunking.parent_sections("y" * 4000 + "\n\nz") == ["y" * 4000, "z"]
    assert chunking.child_windows("a\n" + "b" * 600 + "\n  c") == ["a", "b" * 600, "c"] and chunking.child_windows(" \n ") == [""]
