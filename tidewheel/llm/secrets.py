"""Secret scans in DataFrame expressions only.

Base spans: assignments to secret-like names, access keys and long hex runs. The method adds
``random`` spans: tokens of 20 characters or more whose characters look drawn at random from an
inferred encoding. The battery, per token of n characters over an alphabet of a:

* chi-squared of the characters against a uniform alphabet,
* runs above and below the middle of the alphabet,
* serial correlation of neighbouring characters.

A token that fails any of them at z = 3.3 is not random. For the others, the p-value is that of
ordinary text (identifiers, words, paths) looking so uniform and changing its character class
so often. Within strata of token length, Benjamini-Hochberg over all candidates of the corpus
sets the p-value below which a token is reported; the strata's histograms (some hundred rows) are all that leaves the executors.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import stored

#: The base kinds, in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns of the base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Name, pattern, what must occur, alphabet: the first that fits is a token's encoding.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "[0-9].*[a-f]|[a-f].*[0-9]", string.digits + "abcdef"),
    ("hex_upper", "^[0-9A-F]+$", "[0-9].*[A-F]|[A-F].*[0-9]", string.digits + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "[2-7].*[A-Z]|[A-Z].*[2-7]", string.ascii_uppercase + "234567"),
    ("base36", "^[a-z0-9]+$", "[0-9].*[a-z]|[a-z].*[0-9]", string.ascii_lowercase + string.digits),
    ("base36_upper", "^[A-Z0-9]+$", "[0-9].*[A-Z]|[A-Z].*[0-9]", string.ascii_uppercase + string.digits),
    ("base62", "^[A-Za-z0-9]+$", "^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])", string.ascii_letters + string.digits),
    ("base64", "^[A-Za-z0-9+/]+$", "^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])", string.ascii_letters + string.digits + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", "^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])", string.ascii_letters + string.digits + "-_"),
)
#: Least lengths of the strata.
STRATA = (20, 32, 48, 96)
FAILS = 3.3
#: Ordinary text: sum of squared character shares, and share of neighbours that differ in class.
TEXT_SQUARES, TEXT_CHANGES = 0.12, 0.15
#: Bins of -log10 p, four to a power of ten.
BINS, PER_TEN = 400, 4


def _matches(text: Column, pattern: str, hint: str, least: int, group: int = 2, name: str = "t") -> Column:
    """Array of (s, e, token) of leftmost matches that do not overlap; those whose group is shorter than least are dropped.

    Each match is taken with the text before it, from where the last one ended, so the
    lengths add up to code-point offsets and a text is scanned once.
    """
    whole = rf"\G([\s\S]*?)({pattern})"
    before, match, value = (F.regexp_extract_all(text, F.lit(whole), F.lit(i)) for i in (1, 2, group))
    zipped = F.arrays_zip(before.alias("b"), match.alias("m"), value.alias("v"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,t:string>>)").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["b"])
        end = begin + F.length(x["m"])
        one = F.array(F.struct(begin.alias("s"), end.alias("e"), x["m"].alias("t")))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    none = F.expr("cast(array() as array<struct<s:int,e:int,t:string>>)")
    return F.when(text.rlike(hint), F.aggregate(zipped, start, step, lambda acc: acc["found"])).otherwise(none)


def _encoding(token: Column) -> Column:
    """Index in ENCODINGS, or -1."""
    found = F.lit(-1)
    for i in range(len(ENCODINGS) - 1, -1, -1):
        _, shape, needs, _ = ENCODINGS[i]
        found = F.when(token.rlike(shape) & token.rlike(needs), i).otherwise(found)
    return found


def _of_encoding(code: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), code + 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _pairs(values: Column, n: Column, of) -> Column:
    """of(x[i], x[i + 1]) for all neighbours."""
    return F.zip_with(F.slice(values, 1, n - 1), F.slice(values, 2, n - 1), of)


def _judged(tokens: Column) -> Column:
    """(s, e, stratum, bin) of each candidate; bin 0 for tokens that fail the battery."""
    coded = F.filter(F.transform(tokens, lambda c: F.struct(c["s"], c["e"], c["t"], _encoding(c["t"]).alias("code"))), lambda c: c["code"] >= 0)

    def spelled(c: Column) -> Column:
        alphabet = _of_encoding(c["code"], [x[3] for x in ENCODINGS])
        classes = F.translate(c["t"], string.ascii_lowercase + string.ascii_uppercase + string.digits, "a" * 26 + "A" * 26 + "0" * 10)
        return F.struct(
            c["s"], c["e"], F.length(c["t"]).alias("n"),
            F.length(alphabet).cast("double").alias("a"),
            F.transform(F.split(c["t"], ""), lambda x: (F.instr(alphabet, x) - 1).cast("double")).alias("x"),
            F.split(classes, "").alias("k"),
            F.transform(F.array_distinct(F.split(c["t"], "")), lambda x: (F.length(c["t"]) - F.length(F.replace(c["t"], x, F.lit("")))).cast("double")).alias("o"),
        )

    def counted(c: Column) -> Column:
        n = c["n"].cast("double")
        squares = _sum(F.transform(c["o"], lambda o: o * o))
        mean = _sum(c["x"]) / n
        high = F.transform(c["x"], lambda x: (x >= c["a"] / 2).cast("double"))
        return F.struct(
            c["s"], c["e"], n.alias("n"), c["a"],
            (squares * c["a"] / n - n).alias("chi"),
            _sum(_pairs(c["k"], c["n"], lambda x, y: (x != y).cast("double"))).alias("changes"),
            _sum(high).alias("n1"),
            (_sum(_pairs(high, c["n"], lambda x, y: (x != y).cast("double"))) + 1).alias("runs"),
            _sum(_pairs(c["x"], c["n"], lambda x, y: (x - mean) * (y - mean))).alias("cov"),
            _sum(F.transform(c["x"], lambda x: (x - mean) * (x - mean))).alias("var"),
        )

    def scored(c: Column) -> Column:
        n, a = c["n"], c["a"]
        df = a - 1
        n2 = n - c["n1"]
        twice = c["n1"] * n2 * 2
        cube = F.lit(2.0) / (df * 9)
        uniform = (F.pow(F.greatest(c["chi"], F.lit(0.0)) / df, F.lit(1 / 3)) - (F.lit(1.0) - cube)) / F.sqrt(cube)
        spread = twice * (twice - n) / (n * n * (n - 1))
        runs = F.when(spread > 0, (c["runs"] - (twice / n + 1)) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(F.lit(99.0))
        serial = F.when(c["var"] > 0, (c["cov"] / F.greatest(c["var"], F.lit(1e-9)) + F.lit(1.0) / n) * F.sqrt(n)).otherwise(F.lit(99.0))
        extra = n * (a * TEXT_SQUARES - 1)
        even = (df + extra - c["chi"]) / F.sqrt(df * 2 + extra * 4)
        q = TEXT_CHANGES
        changing = (c["changes"] - (n - 1) * q) / F.sqrt((n - 1) * (q * (1 - q)))
        z = F.greatest((even + changing) / math.sqrt(2), F.lit(1.0))
        tail = (z * z / 2 + F.log(z * math.sqrt(2 * math.pi))) / math.log(10)
        passes = (uniform < FAILS) & (F.abs(runs) < FAILS) & (F.abs(serial) < FAILS)
        stratum = sum(((n >= x).cast("int") for x in STRATA[1:]), F.lit(0))
        return F.struct(c["s"], c["e"], stratum.alias("stratum"), F.when(passes, F.least(F.floor(tail * PER_TEN), F.lit(BINS)).cast("int")).otherwise(F.lit(0)).alias("bin"))

    return F.transform(F.transform(F.transform(coded, spelled), counted), scored)


def least_bins(histogram: list[tuple[int, int, int]], rate: float) -> list[int]:
    """Benjamini-Hochberg on (stratum, bin, tokens): the least bin that is reported in each stratum."""
    found = []
    for stratum in range(len(STRATA)):
        counts = {b: n for s, b, n in histogram if s == stratum}
        total, above, least = sum(counts.values()), 0, BINS + 1
        for b in range(BINS, 0, -1):
            above += counts.get(b, 0)
            if above and total * 10 ** (-b / PER_TEN) <= rate * above:
                least = b
        found.append(least)
    return found


def scan(docs: DataFrame, rate: float = 0.001) -> DataFrame:
    """(doc_id, spans) of every row: spans is an array of (s, kind, e), by start, then kind as in KINDS.

    s and e are code points, e exclusive; kind is an index in KINDS; assign, access and hex
    spans do not depend on other rows, random spans through the corpus-wide threshold. Null and empty texts have no
    spans. Every row is scanned by itself, also where ids repeat or are null. ``rate`` bounds
    the expected share of false random spans, under the text model above.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        _matches(F.col("text"), ASSIGN, ASSIGN, ASSIGN_LEAST, group=3).alias("assign"),
        _matches(F.col("text"), ACCESS, ACCESS, ACCESS_LEAST).alias("access"),
        _matches(F.col("text"), "[0-9a-f]{%d,}" % HEX_LEAST, "[0-9a-f]{%d,}" % HEX_LEAST, HEX_LEAST).alias("hex"),
        _matches(F.col("text"), TOKEN, TOKEN, 0).alias("tokens"),
    )
    base = [_of_kind(F.col(name), k) for k, name in enumerate(KINDS[:3])]
    held = stored(found.select("doc_id", F.array_sort(F.concat(*base)).alias("base"), _judged(F.col("tokens")).alias("tokens")), "secrets")
    histogram = held.select(F.explode("tokens").alias("t")).groupBy("t.stratum", "t.bin").count().collect()
    least = least_bins([tuple(r) for r in histogram], rate)
    random = _of_kind(F.filter("tokens", lambda t: t["bin"] >= _of_encoding(t["stratum"], least)), len(KINDS) - 1)
    return held.select("doc_id", F.array_sort(F.concat("base", random)).alias("spans"))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda c: F.struct(c["s"].alias("s"), F.lit(kind).alias("kind"), c["e"].alias("e")))


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
