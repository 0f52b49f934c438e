import pytest
from pyspark.sql import functions as F

from quillframe.operators import layout
from quillframe.sources import files, ocr
from quillframe.streaming.rows import document_stream, stream_rows


def read_tokens(raw, lang):
    """A stand-in for an engine: one token a word, one line a row of the content."""
    out = []
    for y, row in enumerate(raw.decode().split("\n")):
        for x, word in enumerate(row.split(" ")):
            out.append({"text": word, "page_num": 1, "line_num": y, "left": 50 * x, "top": 20 * y, "width": 40, "height": 15})
    if out[0]["text"] == "broken":
        raise OSError("no image")
    return out


def test_tokens_become_lines(spark):
    images = spark.createDataFrame([("a.png", b"Tel 12\nx"), ("b.png", b"broken"), ("c.png", None)], "path string, content binary")
    tokens = ocr.ocr_tokens(images, read_tokens)
    assert sorted((r["path"], r["pos"], r["text"], r["left"], r["top"]) for r in tokens.collect()) == [("a.png", 0, "Tel", 0, 0), ("a.png", 1, "12", 50, 0), ("a.png", 2, "x", 0, 20)]
    assert sorted(r["text"] for r in layout.group_lines(tokens, "path").collect()) == ["Tel 12", "x"]
    upper = ocr.ocr_tokens(images, read_tokens, prepare=lambda raw: raw.upper())
    assert upper.filter("text = 'TEL'").count() == 1
    assert ocr.ocr_tokens(images.limit(0), read_tokens).count() == 0


def test_region_is_padded_within_the_image(spark):
    rows = [(2, 2, 50, 20), (10, 10, 98, 40), (200, 10, 210, 20)]
    df = spark.createDataFrame(rows, "l int, t int, r int, b int")
    got = [r[0] and tuple(r[0]) for r in df.select(ocr.region(*[F.col(c) for c in "ltrb"], F.lit(100), F.lit(60))).collect()]
    assert got == [(0, 0, 54, 24), (6, 6, 100, 44), None]


def test_lines_are_read_again(spark):
    lines = spark.createDataFrame([(1, "Tel l2", 0, 0, 40, 15), (1, "other", 0, 20, 40, 35), (1, "out", 500, 0, 510, 9), (2, "no image", 0, 0, 1, 1)], "doc_id long, text string, left int, top int, right int, bottom int")
    images = spark.createDataFrame([(1, b"img", 100, 60)], "doc_id long, content binary, image_width int, image_height int")

    def read(content, box, lang):
        if box["top"] > 0:
            raise OSError("unreadable")
        return f" {content.decode()}  {lang} {box['bottom']} "

    got = {r["text"]: r["refined"] for r in ocr.reread_lines(lines, images, read).collect()}
    assert got == {"Tel l2": "img eng 19", "other": "", "out": "", "no image": ""}


def test_settings_and_folders(spark, tmp_path):
    settings = spark.createDataFrame([("images_dir", " in "), ("recursive", "Yes"), ("value_columns", "Tel; Email,"), ("other", "x")], "name string, value string")
    config = files.ExtractionConfig.from_table(settings)
    assert (config.images_dir, config.lang, config.recursive, config.value_columns) == ("in", "eng", True, ["Tel", "Email"])
    assert files.ExtractionConfig.from_table(settings.limit(0)).images_dir == ""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"")
    base = str(tmp_path)
    assert files.resolve_folder(spark, " in ", ["/nowhere", base], "d") == f"{base}/in"
    assert files.resolve_folder(spark, "in/a.png", [base], "d") == f"{base}/in"
    assert files.resolve_folder(spark, "", [base], "d") == "d"
    assert files.resolve_folder(spark, "new", ["/nowhere", base], "d") == "/nowhere/new"


@pytest.mark.parametrize("fails", [False, True])
def test_status_of_a_stream(spark, tmp_path, fails):
    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"{n}.txt").write_text("PO Number: 1\n")
    told = []

    def on_status(line):
        told.append(line)
        if fails:
            raise RuntimeError("ignored")

    stream_rows(document_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), on_status=on_status, value_columns=["PO Number"]).awaitTermination()
    assert [t.rpartition(" [")[2][:2] for t in told] == ["1 ", "2 "] and all(t.startswith("OCR: file:") for t in told)
