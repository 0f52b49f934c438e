import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillframe.operators import sample, validate
from quillframe.operators.ground_truth import COLUMNS, ground_truth
from quillframe.plans import report
from quillframe.sources import files


def annotation(n):
    t = lambda s: {"bbox": [[1.0, 2.0], [3.0, 4.0]], "text": s}
    return {
        "DUE_DATE": t(f"Due Date : {n}-Oct-2016"), "PO_NUMBER": t("PO Number :35"), "SUB_TOTAL": t("SUB_TOTAL : 7.30  EUR"), "DISCOUNT": t("DISCOUNT(1%): (-)  3"),
        "TAX": "TAX:VAT (3%):  2 EUR", "TOTAL": {"text": 5}, "BUYER": t("Bill to: A\nTel: +(352)259-8443\r\nEmail:a@b.com\nsite : http://x.org/"),
        "PAYMENT_DETAILS": t("Bank Name   State Bank\nBranch Name RAF\nBank Account Number  11\nBank Swift Code X1"), "TABLE": [[{"bbox": []}]], "OTHER": {"text": " page "},
    }


def test_ground_truth(spark, tmp_path):
    for n in (2, 10, 1):
        (tmp_path / f"T_{n}.json").write_text(json.dumps(annotation(n)))
    found = files.read_annotations(spark, str(tmp_path))
    rows = ground_truth(found).orderBy("Nomor").collect()
    assert [r["Nama File"] for r in rows] == ["T_1.jpg", "T_10.jpg", "T_2.jpg"]
    want = ["1", "T_1.jpg", "1-Oct-2016", "35", "+(352)259-8443", "a@b.com", "http://x.org/", "7.30 EUR", "(-) 3", "VAT (3%): 2 EUR", "", "State Bank", "RAF", "11", "X1"]
    assert dict(zip(COLUMNS, want, strict=True)) == rows[0].asDict()
    assert {r["text"] for r in files.documents_from_annotations(found).collect()} == {"page"}
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(Exception, match="JSON object"):
        files.read_annotations(spark, str(tmp_path)).collect()
    assert files.read_annotations(spark, str(tmp_path), strict=False).filter("data is null").count() == 1
    with pytest.raises(FileNotFoundError):
        files.read_annotations(spark, str(tmp_path / "none"))


def test_report(spark, tmp_path):
    gt = spark.createDataFrame([("a", "1", "x"), ("b", "2", ""), ("c", "3", "z")], "k string, n string, t string").coalesce(1)
    ocr = spark.createDataFrame([("b", " 2 ", "y", "e"), ("a", "", "x", ""), ("d", "1", "1", "")], "k string, n string, t string, u string").coalesce(1)
    got = report.as_dict(validate.validate(gt, ocr, "k"))
    assert list(got["columns"]) == ["k", "n", "t", "u"]
    assert got["missing_in_ground_truth"] == ["d"] and got["missing_in_ocr_results"] == ["c"] and got["shared_records"] == 2
    assert (got["rows_compared"], got["rows_passing"], got["rows_missing"], got["overall_missing"], got["total_field_comparisons"]) == (2, 0, 1, 1, 8)
    assert got["overall_accuracy"] == 0.625 and got["columns"]["n"]["missing"] == 1
    assert got["columns"]["t"]["missmatch"] == [{"k": "b", "expected": "", "ocr": "y"}]
    for c in got["columns"].values():
        assert c["matches"] + c["mismatches"] == c["total_compared"] and c["missing"] <= c["mismatches"]
    assert "<td>62.50%" not in report.as_html(got) and "62.50%" in report.as_html(got)
    assert report.log_line(got, datetime(2020, 1, 2, 3, 4, 5)).startswith("2020-01-02 03:04:05 | accuracy: 0.6250 | row_pass_rate: 0.0000")
    report.append_log(spark, got, str(tmp_path / "log"))
    report.append_log(spark, got, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2


def test_nothing_shared(spark):
    one = spark.createDataFrame([("a", "1")], "k string, n string")
    two = spark.createDataFrame([("b", "1")], "k string, n string")
    got = report.as_dict(validate.validate(one, two, "k", max_samples=1))
    assert got["overall_accuracy"] is None and got["row_pass_rate"] is None and got["rows_compared"] == 0
    assert "N/A" in report.log_line(got)


def test_keyed_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('k,v\n a ,"x ""q"", \ny"\n\nb,\n', encoding="utf-8")
    rows = files.read_keyed_csv(spark, str(p), "k").orderBy("_ord").collect()
    assert [(r["k"], r["v"]) for r in rows] == [("a", 'x "q", \ny'), ("b", "")]
    assert files.write_csv(spark.createDataFrame([("1", "")], "a string, b string"), str(tmp_path / "out")) == 1
    for text, error in (("k,v\na,1\na ,2\n", "Duplicate"), ("k,v\n ,1\n", "Missing"), ("x\n1\n", "not found")):
        p.write_text(text)
        with pytest.raises(ValueError, match=error):
            files.read_keyed_csv(spark, str(p), "k")


def test_sampling(spark):
    a = spark.createDataFrame([(f"T{i}", f"x/T{i}.json") for i in range(9)] + [("T1", "a/T1.json"), ("Z", "Z")], "stem string, path string")
    b = spark.createDataFrame([(f"T{i}", f"y/T{i}.jpg") for i in range(5, 20)], "stem string, path string")
    pairs = sample.pair_candidates(a, b, prefix="T")
    assert sorted(r["stem"] for r in pairs.collect()) == ["T5", "T6", "T7", "T8"]
    one = [r["stem"] for r in sample.sample_rows(pairs, 3, 1, "stem").collect()]
    assert one == [r["stem"] for r in sample.sample_rows(pairs.repartition(7), 3, 1, "stem").collect()] and len(set(one)) == 3
    for n in (0, 99):
        with pytest.raises(ValueError):
            sample.sample_rows(pairs, n, 1, "stem")
    names = spark.createDataFrame([("a", "f.x.jpg"), ("b", "f.x.jpg"), ("c", ".env")], "path string, name string")
    assert [r["target"] for r in sample.archive_names(names).orderBy("path").collect()] == ["f.x.jpg", "f.x_1.jpg", ".env"]
    assert sample.first_per(a, "stem", "path").filter("stem = 'T1'").first()["path"] == "a/T1.json"


def test_find_images(spark, tmp_path):
    for name in ("a-b.JPG", "a/b.png", "a/c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    names = [r["path"].split(str(tmp_path))[-1] for r in files.find_images(spark, str(tmp_path), recursive=True).collect()]
    assert names == ["/a/b.png", "/a-b.JPG"]
    with pytest.raises(FileNotFoundError):
        files.find_images(spark, str(tmp_path / "a" / "none"))
    read = files.scan_files(spark, str(tmp_path), [".png"], content=True)
    assert files.ocr_text(read, lambda raw, lang: raw.decode() + lang).first()["text"] == "xeng"
    assert files.ocr_text(read, lambda raw, lang: 1 / 0).first()["text"] == ""


def test_config():
    got = files.ExtractionConfig.from_mapping({"images_dir": " d ", "recursive": "Yes", "value_columns": "Tel; Email,"})
    assert got == files.ExtractionConfig("d", "eng", True, ["Tel", "Email"])


def test_ordered_union(spark):
    assert validate.ordered_union(["b", "a"], ["a", "c"]) == ["b", "a", "c"]
    assert spark.range(3).select(F.lit(1)).count() == 3


def test_running_number_of_equal_and_missing_addresses(spark, tmp_path):
    from collections import defaultdict

    import duckdb

    from quillframe.plans import catalogue

    rows = [(i, None if i % 50 == 7 else f"http://a/{i * 7 % 30}" + "/x" * (i % 2)) for i in range(200)]
    sql = defaultdict(set)
    for n, order in enumerate((rows, rows[::-1])):
        folder = tmp_path / str(n)
        spark.createDataFrame(order, "page_id long, url string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
        for page, number in con.execute(catalogue.oracle_sql()["running_number"]).fetchall():
            sql[n, dict(rows)[page]].add(int(number))
        got = {r["page_id"]: int(r["nomor"]) for r in catalogue.running_number(spark, str(folder)).collect()}
        # what the SQL leaves open goes by page_id, however the rows are dealt
        pages = defaultdict(list)
        for page, url in rows:
            pages[url].append(page)
        for url, same in pages.items():
            assert [got[p] for p in same] == sorted(sql[n, url])
