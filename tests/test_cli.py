import json
import os

import pytest

from quillframe.cli import duration, main
from quillframe.sources import sinks


def annotation(i):
    text = lambda t: {"text": t, "bbox": [[1.0, 2.0], [3.0, 4.0]]}
    buyer = f"Bill to: Ann Lee\nTel:+(352)259-84{i:02d}\nEmail:ann{i}@example.net\nSite:http://smith{i}.org/"
    bank = f"Bank Name          State Bank of California\nBranch Name          RAF CAMP\nBank Account Number          116954{i:02d}\nBank Swift Code          SBININBB250"
    data = {
        "DUE_DATE": text("Due Date : 16-Oct-2016"), "PO_NUMBER": text(f"PO Number :{i}"), "BUYER": text(buyer), "PAYMENT_DETAILS": text(bank),
        "SUB_TOTAL": text("SUB_TOTAL : 725.30  EUR"), "DISCOUNT": text("DISCOUNT(1.85%): (-)  13.42"), "TAX": text("TAX:VAT (3.88%):  28.18 EUR"), "TOTAL": text("TOTAL : 734.33 EUR"),
    }
    data["OTHER"] = {"text": "\n".join(data[k]["text"] for k in ("DUE_DATE", "PO_NUMBER", "BUYER", "SUB_TOTAL", "DISCOUNT", "TAX", "TOTAL", "PAYMENT_DETAILS"))}
    return data


@pytest.fixture
def dataset(tmp_path):
    for d in ("src/ann", "src/img", "work/ann", "work/img"):
        (tmp_path / d).mkdir(parents=True)
    for i in range(6):
        (tmp_path / f"src/ann/Template1_Instance{i}.json").write_text(json.dumps(annotation(i)))
        (tmp_path / f"src/img/Template1_Instance{i}.jpg").write_bytes(b"image")
    (tmp_path / "src/img/Other.jpg").write_bytes(b"image")
    (tmp_path / "work/ann/old.json").write_text("{}")
    (tmp_path / "work/img/old.jpg").write_bytes(b"old")
    return tmp_path


def test_from_annotations_to_a_report(spark, dataset):
    out = lambda n: str(dataset / n)
    assert main(["convert", out("src/ann"), "--output", out("truth")], spark) == 0
    assert main(["extract", "--annotations-dir", out("src/ann"), "--output", out("rows"), "--validate-against", out("truth")], spark) == 0
    args = ["validate", "--ground-truth", out("truth"), "--ocr", out("rows"), "--json-out", out("r.json"), "--html-out", out("r.html"), "--log-file", out("log.txt")]
    assert main(args, spark) == 0 and main(args, spark) == 0
    report = json.loads((dataset / "r.json").read_text())
    assert report["shared_records"] == report["rows_compared"] == 6 and report["missing_in_ocr_results"] == []
    assert report["overall_accuracy"] > 0.9 and report["columns"]["PO Number"]["accuracy"] == 1.0 and report["columns"]["Nama File"]["matches"] == 6
    assert (dataset / "r.html").read_text().startswith("<!DOCTYPE html>")
    log = (dataset / "log.txt").read_text().splitlines()
    assert len(log) == 2 and all("accuracy: " in x for x in log)


def test_refresh(spark, dataset):
    d = str(dataset)
    args = ["refresh", "--source-annotations", f"{d}/src/ann", "--source-images", f"{d}/src/img", "--annotations-dir", f"{d}/work/ann", "--images-dir", f"{d}/work/img", "--archive-dir", f"{d}/archive", "--output", f"{d}/truth", "--pairs", "4"]
    assert main(args, spark) == 0
    names = lambda p: sorted(x for x in os.listdir(p) if not x.startswith("."))
    assert names(f"{d}/archive") == ["old.jpg", "old.json"]
    assert len(names(f"{d}/work/ann")) == 4 and [x[:-5] for x in names(f"{d}/work/ann")] == [x[:-4] for x in names(f"{d}/work/img")]
    assert main([*args[:-1], "7"], spark) == 1  # too few pairs; nothing has moved
    assert len(names(f"{d}/work/ann")) == 4 and len(names(f"{d}/src/ann")) == 6
    assert main([*args[:-1], "4", "--seed", "3"], spark) == 0
    assert len(names(f"{d}/archive")) == 10


def test_errors(spark, tmp_path):
    assert main(["convert", str(tmp_path / "none"), "--output", str(tmp_path / "o")], spark) == 1
    assert main(["validate", "--ground-truth", str(tmp_path / "a.csv"), "--ocr", str(tmp_path / "b.csv")], spark) == 1
    with pytest.raises(SystemExit) as error:
        main(["nothing"], spark)
    assert error.value.code == 2
    assert duration(None) == "N/A" and duration(1234.0) == "1234 ms (1.23s)"


def test_log_with_the_newest_first(spark, tmp_path):
    path = str(tmp_path / "run.log")
    sinks.append_line(spark, path, "one", newest_first=True, separator="---")
    sinks.append_line(spark, path, "two", newest_first=True, separator="---")
    assert open(path).read() == "two\n---\none\n"
    for k, name in enumerate(("a.txt", "a_1.txt", "a_2.txt")):
        assert sinks.unique_destination(spark, str(tmp_path), "a.txt").endswith(name)
        (tmp_path / name).write_text("x")
