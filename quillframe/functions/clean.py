"""Cleaners: one Column -> Column function for each kind of invoice field.

All take and give strings; null counts as empty, and what is missing is the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pytext import all_matches, ascii_letters, collapse_spaces, first_match, let, lstrip, norm_key, normalized, rstrip, strip

# The formats that the fields follow.
TLDS = ["info", "com", "net", "org", "biz", "gov", "edu", "int", "app", "dev", "co", "io", "id", "us", "uk", "me", "ai"]
CURRENCY_CODES = ["USD", "EUR", "IDR", "SGD", "AUD", "CAD", "GBP", "JPY", "CNY", "CHF", "INR"]
VENDOR_EMAILS = ["melvin40@example", "melvingo", "melvin"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
AMOUNT = r"(?U)-?\d[\d,]*(?:\.\d+)?"
EMAIL = r"(?i)[A-Za-z0-9._%+\-]+@(?:[A-Za-z0-9\-]+\.)+(?:" + "|".join(TLDS) + ")"
PHONE_LABEL = r"(?iU)(?:\b(?:tel|tol|tal|telephone|phone)\b)\s*[:\-]\s*([^\n\r|]+)"
DUE_DATE = r"(?U)(\d{1,2})[\s\-/.]+([A-Za-z]{3,})[\s\-/.]+(\d{2,4})"
VAT_PERCENT = r"(?iU)vat\s*\(\s*([0-9]+(?:\.[0-9]+)?)\s*%\s*\)"
PERCENT = r"(?U)([0-9]+(?:\.[0-9]+)?)\s*%"
DOMAIN = r"(?i)((?:[a-z0-9][a-z0-9-]*\.)+[a-z]{2,})(/[a-z0-9./_\-]*)?"
QUOTES = "\"'“”‘’"
TAX_CAP, TAX_SHARE, TAX_TOLERANCE = 5000.0, 0.3, 0.2


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def emails(plain: Column, excluded: list[str] = VENDOR_EMAILS, phones: bool = False) -> Column:
    """All addresses of known domains in an ASCII text, lower-cased, each once, in order.

    phones: what follows a phone label stays, for texts that are addresses only, such as tel-1@example.com.
    """
    rest = plain if phones else F.regexp_replace(plain, PHONE_LABEL, "")
    found = F.flatten(F.transform(F.split(rest, r"[|,;/\n]+"), lambda part: all_matches(F.replace(part, F.lit(" "), F.lit("")), EMAIL)))
    wanted = F.filter(F.transform(found, F.lower), lambda e: ~_contains_any(e, excluded))
    return F.array_join(F.array_distinct(wanted), " | ")


def clean_email(c: Column, excluded: list[str] = VENDOR_EMAILS, phones: bool = False) -> Column:
    """E-mail addresses with accents taken off; phone fragments (unless phones) and excluded addresses go."""
    return emails(ascii_letters(_text(c)), excluded, phones)


def _contains_any(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def clean_currency(c: Column, first: bool = False, normal: bool = False) -> Column:
    """The last (or first) amount with its currency; texts without an amount come back tidied.

    normal: the text has its normal form already, as it must inside a lambda.
    """
    value = _text(c)

    def read(text: Column) -> Column:
        # words are looked for before US$ is spelled out, so that US$ counts as the sign
        suffix = (
            F.when(text.rlike(r"(?iU)\bEUR(OS?)?\b"), "EUR")
            .when(text.rlike(r"(?iU)\bUSD\b"), "USD")
            .when(F.contains(value, F.lit("€")), "€")
            .when(value.rlike("[$§]"), "$")
            .otherwise("USD")
        )
        spelled = F.regexp_replace(F.replace(text, F.lit("§"), F.lit("$")), r"\$US|US\$", "USD")
        spelled = F.regexp_replace(F.replace(spelled, F.lit("€"), F.lit(" EUR ")), r"(?U)[\s\x1C-\x1F]+", " ")
        return let(
            spelled,
            lambda s: let(
                all_matches(s, AMOUNT),
                lambda found: F.when(F.size(found) == 0, s).otherwise(F.concat_ws(" ", F.replace(F.element_at(found, 1 if first else -1), F.lit(",,"), F.lit(",")), suffix)),
            ),
        )

    return let(strip(value if normal else normalized(value, "NFKC")), lambda text: F.when(text == "", "").otherwise(read(text)))


def numeric_amount(c: Column) -> Column:
    """First amount as double, null where there is none."""
    return F.replace(first_match(c, AMOUNT, 0), F.lit(","), F.lit("")).try_cast("double")


def currency_of(*hints: Column) -> Column:
    """Currency sign or known code of the first hint that has one; a hint's signs go before its codes."""
    codes = "|".join(CURRENCY_CODES)
    of = lambda h: F.when(F.contains(h, F.lit("$")), "$").when(F.contains(h, F.lit("€")), "€").otherwise(F.upper(first_match(h, rf"(?iU)\b({codes})\b")))
    return F.coalesce(*[of(_text(h)) for h in hints], F.lit(""))


def format_currency(amount: Column, *hints: Column) -> Column:
    code = currency_of(*hints)
    return F.concat_ws(" ", F.format_string("%.2f", amount), F.when(code == "", "USD").otherwise(code))


def clean_due_date(c: Column) -> Column:
    """DD-Mon-YYYY of the first day, month name and year; days are 1 to 31 in any month; other texts come back tidied."""
    punctuation = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ "
    names = [(n, m) for n, m in zip(MONTH_NAMES, MONTHS, strict=True)] + [(m.lower(), m) for m in MONTHS] + [("sept", "Sep")]
    known = F.create_map(*[F.lit(x) for pair in dict(names).items() for x in pair])

    def parsed(text: Column) -> Column:
        part = lambda g: F.regexp_extract(text, DUE_DATE, g)
        token = F.lower(part(2))
        month = F.coalesce(F.try_element_at(known, token), F.when(F.length(token) > 3, F.try_element_at(known, F.substring(token, 1, 3))), F.initcap(token))
        year = F.when(F.length(part(3)) == 2, F.concat(F.when(part(3).try_cast("int") <= 30, "20").otherwise("19"), part(3))).otherwise(part(3))
        day = part(1).try_cast("int")
        return F.when(text.rlike(DUE_DATE) & day.between(1, 31), F.concat_ws("-", F.lpad(day.cast("string"), 2, "0"), month, year)).otherwise(text)

    text = F.regexp_replace(strip(strip(normalized(_text(c), "NFKC")), punctuation), r"(?U)[\s\x1C-\x1F]+", " ")
    return let(text, parsed)


def clean_po_number(c: Column) -> Column:
    """The last run of digits, else letters, digits, # / and -, else the text without a ragged end."""
    trimmed = F.regexp_replace(strip(_text(c)), r"(?U)[\s\x1C-\x1F,.;:-]+\z", "")
    return let(
        trimmed,
        lambda t: F.coalesce(F.try_element_at(all_matches(t, r"(?U)\d+"), F.lit(-1)), F.nullif(F.regexp_replace(t, "[^A-Za-z0-9#/-]+", ""), F.lit("")), t),
    )


def clean_discount(c: Column) -> Column:
    """`(-) ` and the amount; what stands for the sign in a bad scan goes."""
    junk = r"(?U)\A[\s\x1C-\x1F\"'`~|.,;:_+()*-]+"

    def run(t: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(t, r"\((?:[.•,])?\)", " "), junk, "")
        return (
            F.when(t == "", "")
            .when(F.startswith(t, F.lit("(-)")), rstrip(t, ",.;: "))
            .otherwise(rstrip(F.concat(F.lit("(-) "), rstrip(strip(lstrip(bare, "+-")), ",.;: ")), " "))
        )

    return let(strip(_text(c)), run)


def _name(c: Column) -> Column:
    return F.regexp_replace(strip(strip(_text(c)), " .,:;!?-_"), r"(?U)[\s\x1C-\x1F]{2,}", " ")


def clean_branch_name(c: Column) -> Column:
    return _name(c)


def clean_bank_name(c: Column) -> Column:
    """Bank names with known scanning errors repaired; a swift code's label is no name."""
    name = F.regexp_replace(_name(c), r"(?iU)\bgentral\b", "Central")
    for run_together, words in (("centralbank", "Central Bank"), ("bankofeurope", "Bank of Europe"), ("bankofcalifornia", "Bank of California")):
        name = F.regexp_replace(name, f"(?i){run_together}", words)
    return let(name, lambda n: F.when(norm_key(n).rlike("^(bank )?swift ?code"), "").otherwise(n))


def clean_swift_code(c: Column) -> Column:
    return F.upper(F.regexp_replace(_text(c), "[^A-Za-z0-9]+", ""))


def clean_tel(c: Column) -> Column:
    """+(AAA)MMM-LLLL from the first ten digits of each number; shorter ones go."""

    def number(part: Column) -> Column:
        tidy = F.translate(rstrip(strip(strip(part), QUOTES), ",.;:!?"), "–—{[}]", "--(())")
        tidy = F.get(F.split(tidy, r"(?iU)\b(?:fax|email|site)\b", 2), F.lit(0))
        # from the plus sign on, or from the bracket where there is none
        sign = let(tidy, lambda t: F.when(F.contains(t, F.lit("+")), F.regexp_replace(t, r"(?s)\A[^+]*", "")).otherwise(F.regexp_replace(t, r"(?s)\A[^(]*\(", "(")))
        return F.regexp_replace(sign, r"(?U)\D", "")

    digits = F.filter(F.transform(F.split(_text(c), r"(?U)[\s\x1C-\x1F]*\|[\s\x1C-\x1F]*"), number), lambda d: F.length(d) >= 10)
    shaped = F.transform(digits, lambda d: F.regexp_replace(F.substring(d, 1, 10), r"(?U)\A(\d{3})(\d{3})(\d{4})\z", "+($1)$2-$3"))
    return F.array_join(shaped, " | ")


def _percent(c: Column) -> Column:
    return F.concat(F.format_string("%.2f", c), F.lit("%"))


def clean_tax(c: Column, subtotal: Column | None = None) -> Column:
    """`VAT (p%): amount currency`, reconciled with the subtotal.

    The stated amount counts if it is plausible: positive, at most 5000 and at
    most 30 % of the subtotal. Where a percentage is stated and the amount is
    missing, or off by more than 0.2 points, the amount follows from the percentage.
    Money is rounded half to even on two places.
    """
    sub_raw = _text(subtotal) if subtotal is not None else F.lit("")

    def from_text(x: Column) -> Column:
        t = x["t"]
        after = lambda mark: F.when(F.contains(t, F.lit(mark)) & (F.locate(mark, t) < F.length(t)), F.substr(t, F.locate(mark, t) + 1))
        segment = F.coalesce(after(":"), F.when(~(F.contains(t, F.lit(":")) & (F.locate(":", t) < F.length(t))), after("-")), t)
        base = F.struct(
            t.alias("t"),
            segment.alias("segment"),
            clean_currency(segment, first=True, normal=True).alias("amount_text"),
            x["sub_text"].alias("sub_text"),
            F.coalesce(first_match(t, VAT_PERCENT), first_match(t, PERCENT)).try_cast("double").alias("percent"),
        )
        return let(base, lambda b: let(F.struct(b.alias("b"), numeric_amount(b["amount_text"]).alias("stated"), numeric_amount(b["sub_text"]).alias("sub")), reconciled))

    def reconciled(x: Column) -> Column:
        b, sub = x["b"], F.when(x["sub"] > 0, x["sub"])
        plausible = lambda a: (a > 0) & (a <= TAX_CAP) & ((a <= sub * TAX_SHARE) | sub.isNull())
        stated = F.when(plausible(x["stated"]), x["stated"])
        derived = let(F.bround(sub * b["percent"] / 100.0, 2), lambda d: F.when(plausible(d), d))
        off = F.abs(stated / sub * 100 - b["percent"]) > TAX_TOLERANCE
        chosen = F.when(derived.isNotNull() & (stated.isNull() | off), derived).otherwise(stated)
        return let(
            chosen,
            lambda a: F.when(a.isNull(), "").otherwise(
                F.concat(
                    F.lit("VAT ("),
                    F.when(b["percent"].isNotNull(), _percent(b["percent"])).when(sub.isNotNull(), _percent(a / sub * 100)).otherwise("0.00%"),
                    F.lit("): "),
                    format_currency(a, b["amount_text"], b["segment"], sub_raw, b["sub_text"]),
                )
            ),
        )

    read = F.struct(strip(normalized(_text(c), "NFKC")).alias("t"), clean_currency(sub_raw).alias("sub_text"))
    return let(read, lambda x: F.when(x["t"] == "", "").otherwise(from_text(x)))


def _host(host: Column) -> Column:
    """A host in lower case with its www and its domain repaired."""
    tld = lambda t: let(F.regexp_replace(t, "[^a-z]", ""), lambda s: F.coalesce(F.nullif(F.regexp_extract(s, "^(" + "|".join(TLDS) + ")", 1), F.lit("")), F.nullif(s, F.lit("")), t))
    www = lambda p: F.when((F.regexp_count(p, F.lit("[wv]")) >= 3) & (F.length(p) - F.regexp_count(p, F.lit("[wv]")) <= 2), "www").otherwise(p)

    def repaired(parts: Column) -> Column:
        n = F.size(parts)
        return F.when(n < 2, F.array_join(parts, ".")).otherwise(
            F.array_join(F.concat(F.array(www(F.get(parts, F.lit(0)))), F.slice(parts, F.lit(2), n - 2), F.array(tld(F.element_at(parts, -1)))), ".")
        )

    return let(F.filter(F.split(F.lower(host), r"\."), lambda p: p != ""), repaired)


def _host_end(host: Column) -> Column:
    """What stands before www, a scheme that ran into the host and broken forms of www go."""
    from_www = F.when(F.contains(host, F.lit("www.")), F.substr(host, F.locate("www.", host))).otherwise(host)
    no_scheme = let(from_www, lambda h: F.when(F.startswith(h, F.lit("http")), F.regexp_replace(h, "^https?[./:]*", "")).otherwise(h))
    fixed = let(no_scheme, lambda h: F.when(F.startswith(h, F.lit("ww")) & ~F.startswith(h, F.lit("www.")) & h.rlike(r"^[wv]+\.*[^wv.]"), F.regexp_replace(h, r"^[wv]+\.*", "www.")).otherwise(h))
    return F.regexp_replace(fixed, r"\.{2,}", ".")


def _closed(url: Column) -> Column:
    return F.when(F.endswith(url, F.lit("/")), url).otherwise(F.concat(url, F.lit("/")))


def _site_candidate(c: Column) -> Column:
    """One candidate as scheme://host/path, empty where no host can be read."""

    def compact(x: Column) -> Column:
        at = F.coalesce(F.nullif(F.locate("http", F.lower(x)), F.lit(0)), F.nullif(F.locate("www", F.lower(x)), F.lit(0)))
        joined = F.when(at.isNull(), x).otherwise(F.concat(F.substr(x, F.lit(1), at - 1), F.regexp_replace(F.substr(x, at), r"(?U)[\s\x1C-\x1F]+", "")))
        slashed = F.regexp_replace(joined, "(?i)(https?:)/(?=[^/])", "$1//")
        return F.regexp_replace(slashed, "(?i)(https?:)//{3,}", "$1//")

    def parts(x: Column) -> Column:
        low = F.lower(x)
        scheme = F.when(F.contains(low, F.lit("http")) & ~F.contains(low, F.lit("https")), "http").otherwise("https")
        plain = F.translate(x, "\\—–…“”‘’", "/--.")
        cut = let(
            plain,
            lambda p: F.when(F.contains(F.lower(p), F.lit("http")), F.substr(p, F.locate("http", F.lower(p))))
            .when(F.contains(F.lower(p), F.lit("www")), F.concat(F.lit("http://"), F.substr(p, F.locate("www", F.lower(p)))))
            .otherwise(p),
        )
        return F.struct(scheme.alias("scheme"), cut.alias("x"))

    def url(s: Column) -> Column:
        x = s["x"]
        site = lambda host, path: F.when(F.coalesce(host, F.lit("")) == "", None).otherwise(_closed(F.concat(s["scheme"], F.lit("://"), host, path)))
        whole = F.when(x.rlike(DOMAIN), let(_host_end(_host(F.regexp_extract(x, DOMAIN, 1))), lambda h: site(h, rstrip(F.regexp_extract(x, DOMAIN, 2), ".,!?:;"))))
        # words of a host that were scanned apart, from something like www to a known domain
        words = F.transform(F.filter(F.split(x, r"(?U)[\s\x1C-\x1F/]+"), lambda w: strip(w) != ""), lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9-]", ""))
        start = lambda w: F.array_position(F.transform(w, lambda t: t.rlike("^[wv]{3,}$")), F.lit(True))
        rest = let(words, lambda w: F.when(start(w) > 0, F.slice(w, (start(w) + 1).cast("int"), F.greatest(F.size(w) - start(w).cast("int"), F.lit(0)))))
        apart = let(rest, lambda r: F.when((F.size(r) >= 1) & F.element_at(r, -1).isin(TLDS) & ~F.array_contains(r, F.lit("")), site(_host(F.concat(F.lit("www."), F.array_join(r, "."))), F.lit(""))))
        loose = r"(?i)(www[a-z0-9\-]*\.[a-z]{2,}|[a-z0-9\-]+\.(?:" + "|".join(TLDS) + "))"
        found = F.regexp_extract(x, loose, 1)
        last = F.when(x.rlike(loose), site(_host_end(F.when(found.rlike(r"^www[^.]"), F.regexp_replace(found, "^www", "www.")).otherwise(found)), F.lit("")))
        return F.coalesce(whole, F.when(F.size(words) > 0, apart), last, F.lit(""))

    tidy = F.translate(strip(c), "：／", ":/")
    return let(let(let(tidy, compact), parts), url)


def site_score(url: Column) -> Column:
    """struct of four numbers, larger is better: known shape, no spaces, few odd marks, short host."""

    def score(u: Column) -> Column:
        low = F.lower(u)
        scheme = low.rlike("^https?://")
        host = F.get(F.split(strip(F.regexp_replace(low, "^https?://", ""), "/"), "/"), F.lit(0))
        named = F.when(host == "", 0).otherwise(2 * host.rlike(r"\.(?:" + "|".join(TLDS) + ")$").cast("int") + F.startswith(host, F.lit("www.")).cast("int"))
        some = (u != "") & (host != "")
        return F.struct(
            (scheme.cast("int") + named).alias("shape"),
            F.when(some, -u.rlike(r"(?U)[\s\x1C-\x1F]").cast("int")).otherwise(0).alias("spaces"),
            F.when(some, -F.regexp_count(u, F.lit("[!|,;?]"))).otherwise(0).alias("marks"),
            F.when(some, -F.length(host)).otherwise(0).alias("length"),
        )

    return let(strip(_text(url)), score)


def _best(values: Column, score) -> Column:
    """The first of the values with the largest score; '' of none."""
    ranked = F.transform(values, lambda v, i: F.struct(score(v).alias("s"), (-i).alias("i"), v.alias("v")))
    return F.coalesce(F.array_max(ranked)["v"], F.lit(""))


def clean_site(c: Column) -> Column:
    found = F.array_distinct(F.filter(F.transform(F.split(_text(c), r"[|,;\n]+"), _site_candidate), lambda u: u != ""))
    return let(found, lambda f: _best(f, site_score))


def site_variants(url: Column) -> Column:
    """The same address under the other scheme, as an array of one or none."""
    return F.when(F.startswith(url, F.lit("http://")), F.array(F.regexp_replace(url, "^http:", "https:"))).when(F.startswith(url, F.lit("https://")), F.array(F.regexp_replace(url, "^https:", "http:"))).otherwise(F.array().cast("array<string>"))


def best_contact(label: Column, candidates: Column) -> Column:
    """The best of an array of cleaned candidates: most digits, best address shape, longest e-mail, else the smallest."""
    ordered = F.array_sort(F.array_distinct(candidates))
    digits = lambda v: F.struct(F.regexp_count(v, F.lit(r"(?U)\d")).alias("a"), (-F.length(v)).alias("b"))
    smallest = lambda keys: F.coalesce(F.array_min(keys)["v"], F.lit(""))
    longest = F.transform(ordered, lambda v: F.struct((-F.length(v)).alias("a"), F.lower(v).alias("b"), v.alias("v")))
    return (
        F.when(label == "tel", _best(ordered, digits))
        .when(label == "site", _best(ordered, site_score))
        .when(label == "email", smallest(longest))
        .otherwise(F.coalesce(F.array_min(ordered), F.lit("")))
    )


def clean_contact(label: Column, c: Column) -> Column:
    return F.when(label == "tel", clean_tel(c)).when(label == "email", clean_email(c)).when(label == "site", clean_site(c)).otherwise(strip(_text(c)))


#: Cleaners by normalised column name; columns without one stay as they are. Tax also takes the subtotal.
CLEANERS = {
    "email": clean_email,
    "site": clean_site,
    "due date": clean_due_date,
    "po number": clean_po_number,
    "sub total": clean_currency,
    "total": clean_currency,
    "tel": clean_tel,
    "discount": clean_discount,
    "branch name": clean_branch_name,
    "bank name": clean_bank_name,
    "bank swift code": clean_swift_code,
}
