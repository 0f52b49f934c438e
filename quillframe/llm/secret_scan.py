"""Secret scans: known shapes, and a battery of randomness tests. DataFrame functions only.

Known shapes are three fixed patterns. Besides them, every run of 20 or more
token characters with a digit and a letter is a candidate: its encoding is inferred from the characters it
uses, and three tests ask whether it could be a uniform draw from that alphabet:

* chi-squared: are all symbols of the alphabet equally common;
* runs: do symbols of the upper and the lower half alternate as often as chance has it;
* serial correlation: does a symbol tell the next one.

Fisher's method combines the three. Since a test on more symbols finds smaller
departures, candidates compete within bands of equal length only: in each band
the Benjamini-Hochberg procedure over all candidates of the table picks, at a
false-discovery rate of `fdr`, those that are not random. The rest, where they
carry enough bits, are reported as spans of kind `random`.

p-values are binned (`bins` per decade of the logarithm, each counted at the
bin's upper edge) so that the procedure needs counts of a bounded number of
bins and no global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, table

# Fixed values of the known shapes.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the runs of [0-9a-f] that have 32 characters or more
KINDS = ["assign", "access", "hex", "random"]
#: Whole runs of token characters with at least one digit and one letter; a run of prose has no digit.
CANDIDATE = r"(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}"

#: Name, test that a token uses only this alphabet, alphabet. The first that fits is inferred.
ENCODINGS = [
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^([a-z0-9]+|[A-Z0-9]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
]

_OPEN, _SHUT, _OTHER = "\ue000", "\ue001", "\ue002"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start int, text string>> of leftmost non-overlapping matches; starts count code points.

    Each match is put between two marks, which the text cannot hold since its own
    are replaced by a third character first; the pieces' lengths then give the starts.
    """
    # most texts hold no mark, and a search for bytes costs a small part of a translation
    marks = F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_SHUT))
    free = F.when(marks, F.translate(text, _OPEN + _SHUT, _OTHER + _OTHER)).otherwise(text)
    split = F.split(F.regexp_replace(free, pattern, f"{_OPEN}$0{_SHUT}"), _OPEN)

    def step(acc, piece):
        found = F.struct(acc["at"].alias("start"), F.substring_index(piece, _SHUT, 1).alias("text"))
        return F.struct((acc["at"] + F.length(piece) - 1).alias("at"), F.concat(acc["found"], F.array(found)).alias("found"))

    def located(pieces):
        start = F.struct(F.length(F.element_at(pieces, 1)).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("found"))
        rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1)))
        return F.aggregate(rest, start, step, lambda acc: acc["found"])

    # the transform makes the pieces a variable, found once a row
    return F.get(F.transform(F.array(split), located), F.lit(0))


def spans(found: Column, kind: str) -> Column:
    """Matches as array<struct<start, kind, stop>>; kind as its place in KINDS, so that they sort as asked."""
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (m["start"] + F.length(m["text"])).alias("stop")))


def spelled(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def normal_tail(z: Column) -> Column:
    """P(N > z) for z >= 0, by Abramowitz and Stegun 26.2.17 (error below 7.5e-8)."""
    t = 1 / (1 + F.lit(0.2316419) * z)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    return F.greatest(F.exp(-z * z / 2) / F.sqrt(2 * F.pi()) * poly, F.lit(1e-300))


def two_sided(z: Column) -> Column:
    return F.least(2 * normal_tail(F.abs(z)), F.lit(1.0))


def upper(z: Column) -> Column:
    return F.when(z >= 0, normal_tail(F.abs(z))).otherwise(1 - normal_tail(F.abs(z)))


def battery(found: Column) -> Column:
    """Of matches, array<struct<start, stop, n, bits, p>>: p is the combined p-value under uniformity.

    A statistic without variance (all symbols in one half, or all equal) is as
    far from chance as can be and counts with p = 1e-300.
    """
    which = lambda m: F.coalesce(*[F.when(m["text"].rlike(test), F.lit(i)) for i, (_, test, _) in enumerate(ENCODINGS) if test], F.lit(len(ENCODINGS) - 1))
    first = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["text"].alias("text"), which(m).alias("which")))
    alphabets = F.array(*[F.lit(a) for _, _, a in ENCODINGS])
    second = F.transform(
        first,
        lambda m: F.struct(
            m["start"].alias("start"),
            F.length(m["text"]).cast("double").alias("n"),
            F.get(alphabets, m["which"]).alias("alphabet"),
            F.when(m["which"].isin(0, 2), F.lower(m["text"])).otherwise(F.translate(m["text"], "-_", "+/")).alias("plain"),
        ),
    )
    third = F.transform(
        second,
        lambda m: F.struct(
            m["start"].alias("start"),
            m["n"].alias("n"),
            F.length(m["alphabet"]).cast("double").alias("size"),
            F.transform(F.split(m["plain"], ""), lambda c: F.call_function("instr", m["alphabet"], c).cast("double") - 1).alias("codes"),
            F.aggregate(F.split(m["alphabet"], ""), F.lit(0.0), lambda a, c: a + F.pow(m["n"] - F.length(F.replace(m["plain"], c, F.lit(""))), F.lit(2.0))).alias("squares"),
        ),
    )
    zero = F.struct(*[F.lit(v).alias(k) for k, v in (("prev", -1.0), ("flips", 0.0), ("high", 0.0), ("s", 0.0), ("ss", 0.0), ("sp", 0.0))])

    def step(size):
        half = size / 2

        def run(a, x):
            later = a["prev"] >= 0
            return F.struct(
                x.alias("prev"),
                (a["flips"] + F.when(later & ((x >= half) != (a["prev"] >= half)), 1.0).otherwise(0.0)).alias("flips"),
                (a["high"] + F.when(x >= half, 1.0).otherwise(0.0)).alias("high"),
                (a["s"] + x).alias("s"),
                (a["ss"] + x * x).alias("ss"),
                (a["sp"] + F.when(later, x * a["prev"]).otherwise(0.0)).alias("sp"),
            )

        return run

    fourth = F.transform(
        third,
        lambda m: F.struct(
            m["start"].alias("start"),
            m["n"].alias("n"),
            m["size"].alias("size"),
            m["squares"].alias("squares"),
            F.get(m["codes"], F.lit(0)).alias("head"),
            F.aggregate(m["codes"], zero, step(m["size"])).alias("a"),
        ),
    )

    def statistics(m):
        n, size, a = m["n"], m["size"], m["a"]
        chi = (m["squares"] * size / n - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        cross = 2 * a["high"] * (n - a["high"])
        runs_var = cross * (cross - n) / (n * n * (n - 1))
        runs = (a["flips"] + 1 - (cross / n + 1)) / F.sqrt(runs_var)
        spread = a["ss"] - a["s"] * a["s"] / n
        # circular lag-1 correlation, whose mean is -1/(n-1)
        serial = ((a["sp"] + a["prev"] * m["head"] - a["s"] * a["s"] / n) / spread + 1 / (n - 1)) * F.sqrt(n)
        return F.struct(
            m["start"].alias("start"),
            (m["start"] + n.cast("int")).alias("stop"),
            n.cast("int").alias("n"),
            (n * F.log2(size)).alias("bits"),
            F.when(spread > 0, upper(chi)).otherwise(1e-300).alias("p1"),
            F.when(runs_var > 0, two_sided(runs)).otherwise(1e-300).alias("p2"),
            F.when(spread > 0, two_sided(serial)).otherwise(1e-300).alias("p3"),
        )

    def combined(m):
        x = -(F.log(F.greatest(m["p1"], F.lit(1e-300))) + F.log(m["p2"]) + F.log(m["p3"]))
        p = F.exp(-x) * (1 + x + x * x / 2)
        return F.struct(*[m[c].alias(c) for c in ("start", "stop", "n", "bits")], F.greatest(p, F.lit(1e-300)).alias("p"))

    return F.transform(F.transform(fourth, statistics), combined)


def _band(n: Column) -> Column:
    return F.floor(F.log2(n)).cast("int")


def _bin(p: Column, bins: int) -> Column:
    return F.floor(-F.log10(p) * bins).cast("int")


def rejection_bins(candidates: DataFrame, *, fdr: float, bins: int) -> dict[int, int]:
    """By length band, the smallest bin that Benjamini-Hochberg rejects. At most 31 rows reach the driver."""
    counts = candidates.groupBy(_band(F.col("n")).alias("band"), _bin(F.col("p"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    whole = Window.partitionBy("band")
    beyond = whole.orderBy(F.desc("bin"))
    ranked = counts.select("band", "bin", F.sum("k").over(beyond).alias("c"), F.sum("k").over(whole).alias("m"))
    found = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / bins) <= F.lit(fdr) * F.col("c") / F.col("m"))
    return {r[0]: r[1] for r in found.groupBy("band").agg(F.min("bin")).collect()}


def scan_secrets(docs: DataFrame, *, id_col="doc_id", text_col="text", fdr=0.05, min_bits=80.0, bins=50) -> DataFrame:
    """A row per row of docs: id_col and arrays of struct<start, kind, stop>: base and all.

    kind is the place in KINDS; positions count code points, ends exclusive. A
    `random` span inside a base span is left out. Null texts count as empty;
    repeated rows and ids each have their row; an empty table gives an empty
    result. Columns of docs other than the two named are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    group2 = lambda m: F.regexp_extract(m["text"], ASSIGN, 2)
    found = docs.select(
        F.col(id_col),
        F.filter(matches(text, ASSIGN), lambda m: F.length(group2(m)) >= 8).alias("_assign"),
        F.filter(matches(text, ACCESS), lambda m: F.length(m["text"]) >= 16).alias("_access"),
        matches(text, HEX).alias("_hex"),
        matches(text, CANDIDATE).alias("_candidates"),
    )
    tested = found.select(
        id_col,
        F.concat(spans(F.col("_assign"), "assign"), spans(F.col("_access"), "access"), spans(F.col("_hex"), "hex")).alias("base"),
        battery(F.col("_candidates")).alias("_tested"),
    )
    tested = materialize(tested, "secret-spans")
    reject = rejection_bins(tested.select(F.inline("_tested")), fdr=fdr, bins=bins)
    limit = lambda m: F.coalesce(*[F.when(_band(m["n"]) == band, F.lit(b)) for band, b in reject.items()], F.lit(2**30))
    random = F.filter("_tested", lambda m: (m["bits"] >= min_bits) & (_bin(m["p"], bins) < limit(m)))
    inside = lambda m: F.exists("base", lambda b: (b["start"] <= m["start"]) & (m["stop"] <= b["stop"]))
    added = F.transform(F.filter(random, lambda m: ~inside(m)), lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), m["stop"].alias("stop")))
    return tested.select(id_col, "base", F.concat("base", added).alias("spans"))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
    )
