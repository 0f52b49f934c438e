"""Queries of layout overrides, labels, sites, bank names and redistribution, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..operators import fields, layout
from ..streaming.rows import elapsed


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cases(key, *shapes):
    """shapes[i] for the rows whose key leaves the remainder i."""
    found = F.when(F.lit(False), F.lit(""))
    for i, shape in enumerate(shapes):
        found = found.when(key % len(shapes) == i, shape)
    return found


# --- a page of lines per customer: a section, contacts near and far from it, a date


def _k():
    return F.col("c_custkey")


def _ks():
    return _k().cast("string")


def _line(text, top):
    return F.struct(text.alias("text"), F.lit(10).alias("left"), top.alias("top"), F.lit(400).alias("right"), (top + 10).alias("bottom"))


def _pages(spark, sf_dir):
    """lines, pages (document heights) and the fields found before."""
    c = _t(spark, sf_dir, "customer")
    number = F.lpad((_k() * 7 % 10000).cast("string"), 4, "0")
    rows = F.array(
        _line(_cases(_k(), F.concat(F.lit("Ship To: "), "c_name"), F.lit("Invoice")), F.lit(100)),
        _line(F.concat(F.lit("Tel: (111)222-"), number), F.lit(120) + _k() % 150),
        _line(F.concat(F.lit("my PHONE "), _cases(_k(), F.lit("none"), F.concat(F.lit("+(352)259-"), number), F.lit("12"))), F.lit(900)),
        _line(F.concat(F.lit("Email: a"), _ks(), F.lit("@b.com site x")), F.lit(160)),
        _line(F.concat(F.lit("Due Date : "), _cases(_k(), F.lit("3 May 2020"), F.lit("soon"), F.lit("07-June-21")), F.lit(" Terms 30")), F.lit(5)),
        _line(F.lit("Due Date 9 May 2029"), F.lit(8)),
        _line(F.concat(F.lit("Site: www.s"), (_k() % 7).cast("string"), F.lit(".org")), F.lit(1200)),
    )
    lines = c.select(_k().alias("doc_id"), F.posexplode(rows).alias("pos", "line")).select("doc_id", "line.*", "pos")
    pages = c.select(_k().alias("doc_id"), (F.lit(400) + _k() % 3 * 400).cast("int").alias("image_height"))
    old = F.create_map(
        F.lit("tel"), _cases(_k(), F.lit("+(352)259-8443"), F.lit(""), F.lit("12"), F.lit("")), F.lit("email"), _cases(_k(), F.concat(F.lit("a"), _ks(), F.lit("@b.com")), F.lit("z@z.org"), F.lit("")),
        F.lit("site"), _cases(_k(), F.lit(""), F.lit("https://old.net/")), F.lit("due date"), F.lit("x"),
    )
    return lines, pages, c.select(_k().alias("doc_id"), old.alias("fields"))


_PAGE_SQL = r"""WITH c AS (SELECT c_custkey AS k, c_name, lpad(CAST(c_custkey * 7 % 10000 AS VARCHAR), 4, '0') AS num, 400 + c_custkey % 3 * 400 AS height FROM customer),
l AS (
  SELECT k, height, unnest([{'pos': 0, 'top': 100, 'text': CASE k % 2 WHEN 0 THEN 'Ship To: ' || c_name ELSE 'Invoice' END}, {'pos': 1, 'top': 120 + k % 150, 'text': 'Tel: (111)222-' || num},
    {'pos': 2, 'top': 900, 'text': 'my PHONE ' || CASE k % 3 WHEN 0 THEN 'none' WHEN 1 THEN '+(352)259-' || num ELSE '12' END}, {'pos': 3, 'top': 160, 'text': 'Email: a' || k || '@b.com site x'},
    {'pos': 4, 'top': 5, 'text': 'Due Date : ' || CASE k % 3 WHEN 0 THEN '3 May 2020' WHEN 1 THEN 'soon' ELSE '07-June-21' END || ' Terms 30'}, {'pos': 5, 'top': 8, 'text': 'Due Date 9 May 2029'},
    {'pos': 6, 'top': 1200, 'text': 'Site: www.s' || k % 7 || '.org'}], recursive := true) FROM c
), t AS (
  SELECT *, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS words, top + 5.0 AS center FROM l
), m AS (SELECT k, center FROM t WHERE regexp_matches(words, '^(ship ?to|bill ?to|deliver ?to)')),
h AS (
  SELECT t.k, 'tel' AS key, pos, top, regexp_replace(text, '(?i)^.*?\b(?:telephone|phone|tel|tol|tal)\b[ :.-]*', '') AS v, center, height FROM t WHERE regexp_matches(words, '(^| )(tel|tol|tal|phone)')
  UNION ALL SELECT k, 'email', pos, top, trim(regexp_replace(regexp_replace(text, '(?i)^.*?\bemail\b[ :.-]*', ''), '(?i)site.*', '')), center, height FROM t WHERE starts_with(words, 'email')
  UNION ALL SELECT k, 'site', pos, top, regexp_replace(text, '(?i)^.*?\bsite\b[ :.-]*', ''), center, height FROM t WHERE starts_with(words, 'site')
  UNION ALL SELECT k, 'due date', pos, top, trim(regexp_replace(regexp_replace(text, '(?i)^.*?\bdue[ -]?date\b[ :.-]*', ''), '(?i)terms.*', '')), center, height FROM t WHERE starts_with(words, 'due date')
), n AS (
  SELECT h.*, key <> 'due date' AND EXISTS (SELECT 1 FROM m WHERE m.k = h.k AND m.center < h.center AND h.center <= m.center + greatest(120, floor(height * 0.22))) AS near,
    regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM h
), e AS (
  SELECT k, 'tel' AS key, CASE k % 4 WHEN 0 THEN '+(352)259-8443' WHEN 2 THEN '12' ELSE '' END AS old FROM c UNION ALL SELECT k, 'email', CASE k % 3 WHEN 0 THEN 'a' || k || '@b.com' WHEN 1 THEN 'z@z.org' ELSE '' END FROM c
  UNION ALL SELECT k, 'site', CASE k % 2 WHEN 0 THEN '' ELSE 'https://old.net/' END FROM c UNION ALL SELECT k, 'due date', 'x' FROM c
), o AS (
  SELECT n.k, n.key, arg_min(v, top) AS value FROM n JOIN e USING (k, key)
  WHERE NOT near AND CASE n.key WHEN 'tel' THEN length(digits) >= 7 AND length(digits) > length(regexp_replace(old, '[^0-9]', '', 'g')) WHEN 'email' THEN v <> old WHEN 'site' THEN true ELSE regexp_matches(v, '[0-9]{1,2}[ -][A-Za-z]{3,}[ -][0-9]{2,4}') END
  GROUP BY n.k, n.key
), s AS (
  SELECT k, key, max(CASE key WHEN 'tel' THEN '+(' || substr(digits, 1, 3) || ')' || substr(digits, 4, 3) || '-' || substr(digits, 7) ELSE v END) AS value FROM n WHERE near GROUP BY k, key
)"""


def line_overrides(spark, sf_dir):
    lines, pages, old = _pages(spark, sf_dir)
    return layout.line_overrides(lines, pages, old)


_OVERRIDES = _PAGE_SQL + " SELECT k AS doc_id, key, value, 'override' AS kind FROM o UNION ALL SELECT k, key, value, 'shipping' FROM s"


def fields_with_overrides(spark, sf_dir):
    lines, pages, old = _pages(spark, sf_dir)
    found = layout.apply_overrides(old, layout.line_overrides(lines, pages, old))
    return found.select("doc_id", F.explode("fields").alias("key", "value"))


_APPLIED = _PAGE_SQL + """ SELECT e.k AS doc_id, e.key,
  CASE WHEN o.value IS NOT NULL THEN CASE WHEN e.key = 'site' AND old <> '' THEN old || ' | ' || o.value ELSE o.value END WHEN s.value IS NOT NULL AND (old = '' OR e.key = 'tel' AND length(regexp_replace(old, '[^0-9]', '', 'g')) < 10) THEN s.value ELSE old END AS value
FROM e LEFT JOIN o ON o.k = e.k AND o.key = e.key LEFT JOIN s ON s.k = e.k AND s.key = e.key"""


# --- labels


def label_values(spark, sf_dir):
    """What follows a label, up to a word that ends it, in lines of several shapes."""
    o = _t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    lead = _cases(k, F.lit("Due Date : "), F.lit("the due-date. - "), F.lit("undue dateline "), F.lit("When: - "), F.lit("none "), F.lit("x DUEDATE:Due Date "))
    text = F.concat(lead, "o_orderpriority", F.lit(" : "), k.cast("string"), _cases(k, F.lit("  TERMS net"), F.lit("")))
    return o.select("o_orderkey", fields.truncate_at(fields.strip_label(text, ["due date", "due-date", "duedate"]), ["terms", "po number"]).alias("value"))


_LABEL_VALUES = r"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Due Date : ' WHEN 1 THEN 'the due-date. - ' WHEN 2 THEN 'undue dateline ' WHEN 3 THEN 'When: - ' WHEN 4 THEN 'none ' ELSE 'x DUEDATE:Due Date ' END
  || o_orderpriority || ' : ' || o_orderkey || CASE o_orderkey % 2 WHEN 0 THEN '  TERMS net' ELSE '' END AS t FROM orders),
s AS (SELECT o_orderkey, CASE WHEN regexp_matches(t, '(?i)(^|[^a-z0-9])due date($|[^a-z0-9])') THEN ltrim(regexp_replace(t, '(?i)^.*?(^|[^a-z0-9])due date', ''), ' :.-')
  WHEN regexp_matches(t, '(?i)(^|[^a-z0-9])due-?date($|[^a-z0-9])') THEN ltrim(regexp_replace(t, '(?i)^.*?(^|[^a-z0-9])due-?date', ''), ' :.-')
  ELSE ltrim(regexp_replace(t, '^[^:]*:', ''), ' -') END AS v FROM t)
SELECT o_orderkey, rtrim(regexp_replace(v, '(?i)(terms|po number).*', '')) AS value FROM s"""


def bank_names(spark, sf_dir):
    """Bank names on their line, on a later one past lines that start other fields, or nowhere."""
    s = _t(spark, sf_dir, "supplier")
    rows = _cases(
        F.col("s_suppkey"),
        F.concat(F.lit("Total 4\nBank Name\n\nBranch Name x\nSwift  code 1\n"), "s_name", F.lit(".\nlast")),
        F.concat(F.lit("x\n  BANK name: "), "s_name", F.lit(" ,\nnext")),
        F.lit("Bank name -\nTotal 5\nTAX 2"),
        F.concat(F.lit("my bank name "), "s_name"),
        F.concat(F.lit("Bank Name :\nnote\nBankName "), "s_name"),
    )
    return s.select("s_suppkey", fields.bank_name_from_lines(rows).alias("bank"))


_BANK_NAMES = r"""WITH t AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN E'Total 4\nBank Name\n\nBranch Name x\nSwift  code 1\n' || s_name || E'.\nlast' WHEN 1 THEN E'x\n  BANK name: ' || s_name || E' ,\nnext' WHEN 2 THEN E'Bank name -\nTotal 5\nTAX 2'
  WHEN 3 THEN 'my bank name ' || s_name ELSE E'Bank Name :\nnote\nBankName ' || s_name END AS t FROM supplier),
l AS (SELECT s_suppkey, trim(unnest(string_split(t, E'\n'))) AS line, unnest(range(len(string_split(t, E'\n')))) AS i FROM t),
n AS (SELECT *, trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) AS words FROM l),
a AS (SELECT *, trim(regexp_replace(line, '(?i)^bank\s*name\s*[:-]?\s*', ''), ' .,:;') AS rest FROM n WHERE regexp_matches(line, '(?i)^bank\s*name')),
v AS (SELECT a.s_suppkey, a.i, CASE WHEN rest <> '' THEN rest ELSE (SELECT trim(arg_min(n.line, n.i), ' .,:;') FROM n WHERE n.s_suppkey = a.s_suppkey AND n.i > a.i AND n.words <> ''
  AND NOT regexp_matches(n.words, '^(branch name|bank account number|bank swift ?code|swift ?code|note|sub total|discount|tax|total)')) END AS v FROM a)
SELECT s.s_suppkey, coalesce((SELECT arg_min(v.v, v.i) FROM v WHERE v.s_suppkey = s.s_suppkey AND v.v IS NOT NULL), '') AS bank FROM supplier s"""


def inline_amounts(spark, sf_dir):
    """Discount and tax that ran into bank fields, moved where these are empty."""
    o = _t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    ks = k.cast("string")
    run = _cases(k, F.concat(F.lit(" DISCOUNT(1%): (-) "), ks), F.concat(F.lit(" | VAT 5%: "), ks, F.lit(" EUR")), F.lit(""), F.lit(" Discount : none"))
    bank = F.concat(F.lit("State Bank"), run)
    branch = F.concat("o_orderpriority", _cases(k, F.lit(""), F.lit(" tax 7.50")))
    found = F.create_map(F.lit("bank name"), bank, F.lit("branch name"), branch, F.lit("discount"), _cases(k, F.lit(""), F.lit(""), F.lit("kept")), F.lit("total"), ks)
    return o.select("o_orderkey", F.explode(fields.redistribute(found)).alias("key", "value"))


_INLINE = r"""WITH f AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS total, o_orderpriority || CASE o_orderkey % 2 WHEN 0 THEN '' ELSE ' tax 7.50' END AS branch, CASE WHEN o_orderkey % 3 = 2 THEN 'kept' ELSE '' END AS discount,
  'State Bank' || CASE o_orderkey % 4 WHEN 0 THEN ' DISCOUNT(1%): (-) ' || o_orderkey WHEN 1 THEN ' | VAT 5%: ' || o_orderkey || ' EUR' WHEN 2 THEN '' ELSE ' Discount : none' END AS bank FROM orders),
x AS (SELECT *, trim(regexp_extract(bank, '(?i)\bdiscount[^:-]*[:-]\s*(.+)', 1), ' .,:;|-') AS d FROM f),
y AS (SELECT *, regexp_replace(bank, '(?i)\bdiscount[^:-]*[:-]\s*.+', '') AS bank1 FROM x),
z AS (SELECT *, trim(regexp_extract(bank1, '(?i)\b(?:tax|vat)[a-z]*[^:-]*[:-]?\s*(.+)', 1), ' .,:;|-') AS t1, trim(regexp_extract(branch, '(?i)\b(?:tax|vat)[a-z]*[^:-]*[:-]?\s*(.+)', 1), ' .,:;|-') AS t2 FROM y),
w AS (SELECT *, CASE WHEN regexp_matches(t1, '[0-9]') THEN t1 WHEN regexp_matches(t2, '[0-9]') THEN t2 ELSE '' END AS tax FROM z)
SELECT k AS o_orderkey, unnest(['bank name', 'branch name', 'discount', 'tax', 'total']) AS key,
  unnest([trim(regexp_replace(bank1, '(?i)\b(?:tax|vat).*', ''), ' ,.;|-'), trim(regexp_replace(branch, '(?i)\b(?:tax|vat).*', ''), ' ,.;|-'), CASE WHEN discount = '' AND regexp_matches(d, '[0-9]') THEN d ELSE discount END, tax, total]) AS value FROM w"""


def emails_merged(spark, sf_dir):
    """Several addresses a text, joined without repeats by the targeted pattern."""
    c = _t(spark, sf_dir, "customer")
    text = F.concat(F.lit("Email: A"), _ks(), F.lit("@b.com\nnote\nE-mail : x\nEmail : c"), (_k() % 3).cast("string"), F.lit("@d.org.\nEmail: a"), _ks(), F.lit("@b.com"))
    found = c.select("c_custkey", F.explode(fields.targeted_fields(text)).alias("f")).filter("f.key = 'Email'")
    return found.select("c_custkey", F.col("f.value").alias("emails"))


_EMAILS = r"""WITH m AS (SELECT c_custkey, list_transform(regexp_extract_all('Email: A' || c_custkey || E'@b.com\nnote\nE-mail : x\nEmail : c' || c_custkey % 3 || E'@d.org.\nEmail: a' || c_custkey || '@b.com', '[A-Za-z0-9.]+@[a-z]+\.(com|org)'), lambda x: lower(x)) AS e FROM customer)
SELECT c_custkey, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i), ' | ') AS emails FROM m"""


# --- sites


def page_sites(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", clean.clean_site(F.col("url")).alias("site"))


_HTTP_TLD = "(info|com|net|org|biz|gov|edu|int|app|dev|co|io|id|us|uk|me|ai)"
_PAGE_SITES = r"""WITH u AS (SELECT page_id, regexp_extract(url, '^(https?)://((?:[a-z0-9-]+\.)+[a-z]+)(/[a-z0-9./_-]*)?', ['scheme', 'host', 'path']) AS u FROM pages)
SELECT page_id, u.scheme || '://' || u.host || rtrim(u.path, '.,!?:;') || CASE WHEN ends_with(rtrim(u.path, '.,!?:;'), '/') THEN '' ELSE '/' END AS site FROM u"""


def broken_sites(spark, sf_dir):
    """Addresses with broken schemes, www and domains, several in a field, or none."""
    raw = _cases(
        _k(), F.concat(F.lit("www.site"), _ks(), F.lit(".org")), F.concat(F.lit("http:/wvw.site"), _ks(), F.lit(".comm/a b")), F.concat(F.lit("https://www.Site"), _ks(), F.lit(".orgx/p.")),
        F.concat(F.lit("vww.site"), _ks(), F.lit(".net , http://www.much-longer-site"), _ks(), F.lit(".net")), F.concat(F.lit("see http://////x"), _ks(), F.lit(".org/y!")), F.lit("no site here"),
        F.concat(F.lit("http://shop"), _ks(), F.lit(".net/q; www.a"), _ks(), F.lit(".com")),
    )
    return _t(spark, sf_dir, "customer").select("c_custkey", clean.clean_site(raw).alias("site"))


_BROKEN_SITES = rf"""WITH r AS (SELECT c_custkey AS k, CASE c_custkey % 7 WHEN 0 THEN 'www.site' || c_custkey || '.org' WHEN 1 THEN 'http:/wvw.site' || c_custkey || '.comm/a b' WHEN 2 THEN 'https://www.Site' || c_custkey || '.orgx/p.'
  WHEN 3 THEN 'vww.site' || c_custkey || '.net , http://www.much-longer-site' || c_custkey || '.net' WHEN 4 THEN 'see http://////x' || c_custkey || '.org/y!' WHEN 5 THEN 'no site here' ELSE 'http://shop' || c_custkey || '.net/q; www.a' || c_custkey || '.com' END AS raw FROM customer),
p AS (SELECT k, unnest(w) AS part, unnest(range(len(w))) AS i FROM (SELECT k, regexp_split_to_array(raw, '[|,;]') AS w FROM r)),
s AS (SELECT k, i, CASE WHEN regexp_matches(part, 'http|www') THEN regexp_replace(regexp_extract(part, '(http|www).*'), '\s', '', 'g') ELSE trim(part) END AS x, CASE WHEN contains(part, 'http') AND NOT contains(part, 'https') THEN 'http' ELSE 'https' END AS scheme FROM p),
h AS (SELECT k, i, scheme, regexp_extract(regexp_replace(x, '^https?:/+', ''), '^((?:[A-Za-z0-9-]+\.)+[a-z]+)(/[A-Za-z0-9./_-]*)?', ['host', 'path']) AS f FROM s),
n AS (SELECT k, i, scheme, rtrim(f.path, '.,!?:;') AS path, regexp_replace(regexp_replace(lower(f.host), '^[wv]{{3}}\.', 'www.'), '\.{_HTTP_TLD}[a-z]*$', '.\1') AS host FROM h WHERE f.host <> ''),
b AS (SELECT k, scheme || '://' || host || path || CASE WHEN ends_with(path, '/') THEN '' ELSE '/' END AS site FROM n
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY 2 * regexp_matches(host, '\.{_HTTP_TLD}$')::INT + starts_with(host, 'www.')::INT DESC, length(host), i) = 1)
SELECT c_custkey, coalesce(site, '') AS site FROM customer LEFT JOIN b ON k = c_custkey"""


# --- run times


def elapsed_times(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", elapsed(F.col("event_id") * 37 % 500000).alias("elapsed"))


_ELAPSED = """WITH s AS (SELECT event_id, event_id * 37 % 500000 AS s FROM events)
SELECT event_id, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS elapsed FROM s"""

QUERIES = {
    "line_overrides": (line_overrides, _OVERRIDES),
    "fields_with_overrides": (fields_with_overrides, _APPLIED),
    "label_values": (label_values, _LABEL_VALUES),
    "bank_names": (bank_names, _BANK_NAMES),
    "inline_amounts": (inline_amounts, _INLINE),
    "emails_merged": (emails_merged, _EMAILS),
    "site_clean": (page_sites, _PAGE_SITES),
    "broken_sites": (broken_sites, _BROKEN_SITES),
    "elapsed_times": (elapsed_times, _ELAPSED),
}
