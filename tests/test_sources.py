"""Tolerant readers: shapes of JSON files, bad and missing files, images by suffix, class lists, pages by number."""

from __future__ import annotations

import pytest
from pyspark.sql.types import StructType

from platewise.sources import files, resources

ITEM = "id long, name string"


def test_three_shapes_of_item_files(spark, tmp_path):
    for name, text in (("a.json", '[{"id": 1, "name": "x"}, {"id": 2}]'), ("b.json", '{"items": [{"id": 3, "name": "é"}], "n": 1}'), ("c.json", '{"id": 4, "name": "z", "items": "none"}'), ("d.json", "[]")):
        (tmp_path / name).write_text(text)
    assert sorted((r.id, r.name) for r in files.read_json_items(spark, str(tmp_path), ITEM).collect()) == [(1, "x"), (2, None), (3, "é"), (4, "z")]


@pytest.mark.parametrize("text", ["3", '"x"', "[{", '[{"id": "no number"}]'])
def test_bad_item_files_raise(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match=r"(?i)json|list nor an object|malformed"):
        files.read_json_items(spark, str(tmp_path), ITEM).collect()


def test_reports_that_are_there_missing_or_bad(spark, tmp_path):
    schema = StructType.fromDDL(ITEM)
    (tmp_path / "good.json").write_text('{"id": 1, "name": "a"}\n\n')
    (tmp_path / "bad.json").write_text('{"id": {}}\n')
    assert files.read_if_present(spark, str(tmp_path / "good.json"), schema).count() == 1
    assert files.read_if_present(spark, str(tmp_path / "no.json"), schema).count() == 0
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_if_present(spark, str(tmp_path / "bad.json"), schema).collect()


def test_images_by_suffix(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("a.JPG", "deep/b.webp", "c.txt", "d"):
        (tmp_path / name).write_bytes(b"1234")
    found = files.read_images(spark, str(tmp_path)).select("path", "length").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in found) == ["a.JPG", "b.webp"] and {r.length for r in found} == {4}


@pytest.mark.parametrize(("text", "want"), [("names: [soup, 'main dish']\n", ["soup", "main dish"]), ("nc: 2\nnames:\n  1: b\n  0: a\n", ["a", "b"]), ("names:\n  - x\n  - y\nval: z\n", ["x", "y"]), ("nc: 2\n", [])])
def test_class_lists(spark, tmp_path, text, want):
    (tmp_path / "data.yaml").write_text(text)
    assert [(r.class_id, r.class_name) for r in resources.class_rows(spark, str(tmp_path / "data.yaml")).orderBy("class_id").collect()] == list(enumerate(want))


def test_pages_by_local_number(spark):
    pages = resources.numbered_pages(spark.createDataFrame([("b", 2, "two"), ("b", 1, "one"), ("c", 9, "nine")], "batch string, seen int, path string"), "batch", "seen").select("batch", "page_number", "path")
    rows = spark.createDataFrame([("b", "p1", 1), ("b", " 2 ", 2), ("b", "p3", 3), ("b", "page 1", 4), ("c", "1", 5), ("c", None, 6), ("d", "1", 7)], "batch string, page_id string, row int")
    got = resources.attach_pages(rows, pages, "batch", "page_id").collect()
    assert sorted((r.row, r.path) for r in got) == [(1, "one"), (2, "two"), (5, "nine")]
