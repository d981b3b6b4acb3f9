"""Secret scan: fixed patterns, and a randomness test battery on other tokens. Native: DataFrame functions only.

Each token of 20 or more key characters gets an inferred encoding (hex, base32, base36, letters and digits, base64). Three
tests ask whether it looks drawn at random from that alphabet: chi-squared uniformity (Wilson-Hilferty), Wald-Wolfowitz
runs of digits and letters, and lag-1 serial correlation of the symbols. A token that no test rejects is weighed against
the other hypothesis, that it is ordinary text: the Chernoff bound of seeing so many changes of character class in so
many places. These p-values go through a Benjamini-Hochberg step over the whole corpus, weighted by length, so a longer
token needs less evidence per character; its threshold comes from a histogram of p-values, never from a sort.

Spans are sums of the lengths of what lies between matches. Spark has no running sum over an array, so they are
summed in blocks of the square root of their number: a text with n matches costs n ** 1.5 small steps, and no row is
ever exploded. What a lambda uses more than once is bound first (``_let``), since lambdas evaluate their text anew.

Cases: null text is empty and has no spans; repeated rows get the same spans each; an empty table gives an empty table;
extra columns are ignored by ``scan`` and kept by ``without_secrets``, which judges each row by its own text: null and
shared ids do not matter. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.store import stored

#: Fixed patterns of the contract, in its order. Case is spelled out, so no engine folds beyond A-Z.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: With their least lengths these two equal "match the run, then drop short ones": runs are maximal.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="
#: Normal quantile beyond which a test rejects randomness (about one in a thousand).
REJECT_Z = 3.1
#: Rate at which the class of character changes inside ordinary tokens.
TEXT_CHANGES = 0.08
FALSE_DISCOVERIES = 0.01
#: The histogram has a bucket per tenth of a decade of p, down to 1e-100.
P_BUCKETS = 1000

SPANS = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _blocks(items: Column, body) -> Column:
    """``body`` of each of about ``sqrt(size)`` slices of an array (a bound variable or column), in order."""
    width = F.greatest(F.ceil(F.sqrt(F.size(items))), F.lit(1)).cast("int")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), width), lambda k: k <= F.size(items))
    return F.transform(starts, lambda k: _let(F.slice(items, k, F.ceil(F.sqrt(F.size(items))).cast("int")), body))


FOUND = "array<struct<start:int,kind:int,end:int,hit:string>>"


def _found(text: Column, pattern: str, kind: int, ok=None) -> Column:
    """Spans of the leftmost non-overlapping matches: text between matches and matches alternate, so lengths add up."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        new = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("hit")))
        return F.struct(end.alias("at"), F.concat(acc["out"], new).alias("out"))

    def join(acc: Column, block: Column) -> Column:
        moved = lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + acc["at"]).alias("end"), s["hit"].alias("hit"))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.transform(block["out"], moved)).alias("out"))

    none = F.array().cast(FOUND)
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
    pieces = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda hit, gap: F.struct(hit.alias("hit"), F.length(gap).alias("gap"))
    )
    matched = F.filter(pieces, lambda x: x["hit"].isNotNull())  # the last gap has no match after it
    spans = _let(matched, lambda found: F.aggregate(_blocks(found, lambda block: F.aggregate(block, zero, step)), zero, join, lambda acc: acc["out"]))
    return F.when(text.rlike(pattern), F.filter(spans, ok) if ok else spans).otherwise(none)


def _apart(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span. Both are in order, so each block of tokens meets the spans near it only."""
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])

    def block(part: Column) -> Column:
        whole = F.struct(part[0]["start"].alias("start"), F.element_at(part, -1)["end"].alias("end"))
        near = _let(whole, lambda w: F.filter(base, lambda b: meets(w, b)))
        return _let(near, lambda spans: F.filter(part, lambda t: ~F.exists(spans, lambda b: meets(t, b))))

    return F.when(F.size(tokens) > 0, F.flatten(_blocks(tokens, block))).otherwise(tokens)


def _tests(token: Column) -> Column:
    """(evidence): p-value of "ordinary text" as -10 log10 p per bucket, or null where a test rejects randomness."""
    symbols = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(BASE64), c).cast("double"))
    return _let(symbols, lambda chars: _battery(token, chars))


def _battery(token: Column, chars: Column) -> Column:
    n = F.length(token).cast("double")
    size = (
        F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16.0)
        .when(token.rlike("^([A-Z2-7]+|[a-z2-7]+)=*$"), 32.0)
        .when(token.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), 36.0)
        .when(token.rlike("^[A-Za-z0-9]+$"), 62.0)
        .otherwise(65.0)
    )
    # chi-squared uniformity over the inferred alphabet
    squares = F.aggregate(
        F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow(F.size(F.filter(chars, lambda x: x == c)).cast("double"), 2)
    )
    chi = size / n * squares - n
    freedom = size - 1
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / freedom, 1 / 3) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
    # runs of digits and other symbols
    digits = F.length(F.regexp_replace(token, "[^0-9]", "")).cast("double")
    others = n - digits
    changes_digit = F.regexp_count(token, F.lit("(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])")).cast("double")
    expected = 2 * digits * others / n
    variance = expected * (expected * n - n) / (n * (n - 1))
    z_runs = F.when(variance > 0, (changes_digit - expected) / F.sqrt(variance)).otherwise(F.lit(0.0))
    # lag-1 serial correlation: symbols minus their mean, in one pass over sums, squares and neighbours' products
    sums = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("square"), F.lit(0.0).alias("lag"), F.lit(0.0).alias("last"))
    moments = F.aggregate(
        chars, sums, lambda acc, c: F.struct((acc["sum"] + c).alias("sum"), (acc["square"] + c * c).alias("square"), (acc["lag"] + acc["last"] * c).alias("lag"), c.alias("last"))
    )

    def serial(m: Column) -> Column:
        mean = m["sum"] / n
        spread = m["square"] - m["sum"] * mean
        lagged = m["lag"] - mean * (2 * m["sum"] - F.element_at(chars, 1) - m["last"]) + (n - 1) * mean * mean
        return F.when(spread > 1e-6, lagged / spread * F.sqrt(n)).otherwise(F.lit(99.0))

    random = (z_chi < REJECT_Z) & (F.abs(z_runs) < REJECT_Z) & (F.abs(_let(moments, serial)) < REJECT_Z)
    # the other hypothesis: classes (lower, upper, digit, sign) rarely change inside ordinary tokens
    kind = "(?<=[{0}])(?=[^{0}])"
    changes = F.regexp_count(token, F.lit("|".join(kind.format(k) for k in ("a-z", "A-Z", "0-9", "+/_=-")))).cast("double")
    rate = F.least(changes / (n - 1), F.lit(1 - 1e-9))
    divergence = rate * F.log(rate / TEXT_CHANGES) + (1 - rate) * F.log((1 - rate) / (1 - TEXT_CHANGES))
    decades = F.when(rate > TEXT_CHANGES, (n - 1) * divergence / F.log(F.lit(10.0))).otherwise(0.0)
    return F.when(random, decades)


def _spanned(text: Column) -> Column:
    """Struct (base, tokens) of a text: fixed spans by start and kind, and other tokens with their evidence."""
    value = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= ASSIGN_LEAST
    whole = F.coalesce(text, F.lit(""))
    base = F.concat(_found(whole, ASSIGN, 0, value), _found(whole, ACCESS, 1), _found(whole, HEX, 2))
    plain = F.sort_array(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    tested = lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end"), _tests(t["hit"]).alias("decades"))
    both = lambda spans: F.struct(spans.alias("base"), F.transform(_let(_found(whole, TOKEN, 3), lambda tokens: _apart(tokens, spans)), tested).alias("tokens"))
    return _let(plain, both)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = FALSE_DISCOVERIES) -> DataFrame:
    """Spans of secrets per row: (doc_id, base, more) with arrays of (start, kind, end); kind indexes ``KINDS``."""
    tested = stored(docs.select(F.col(id_col).alias("doc_id"), _spanned(F.col(text_col)).alias(SECRETS)), "secret-spans")
    more = _discovered(F.col(SECRETS)["tokens"], _threshold(tested, alpha))
    return tested.select("doc_id", F.col(SECRETS)["base"].cast(SPANS).alias("base"), more.alias("more"))


#: Column of a row's spans inside the stages; no table has such a name.
SECRETS = "_secret_spans"


def _discovered(tokens: Column, limit: float) -> Column:
    """Spans of the tokens whose evidence reaches the threshold."""
    kept = F.filter(tokens, lambda t: t["decades"] + F.log10((t["end"] - t["start"]).cast("double")) >= F.lit(limit))
    return F.transform(kept, lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end"))).cast(SPANS)


def _threshold(tested: DataFrame, alpha: float) -> float:
    """Weighted Benjamini-Hochberg: the least -log10(p / length) that keeps false discoveries at ``alpha``.

    Weights are lengths over their mean, so p / weight = mean * p / length. At most ``P_BUCKETS`` sums reach the driver.
    """
    tokens = tested.select(F.explode(F.col(SECRETS)["tokens"]).alias("t")).select(
        F.coalesce("t.decades", F.lit(0.0)).alias("decades"), (F.col("t.end") - F.col("t.start")).cast("double").alias("n")
    )
    bucket = F.least(F.floor((F.col("decades") + F.log10("n")) * 10), F.lit(P_BUCKETS - 1))
    rows = tokens.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("tests"), F.sum("n").alias("length")).collect()
    tests = sum(r["tests"] for r in rows)
    if not tests:
        return float("inf")
    mean = sum(r["length"] for r in rows) / tests
    limit, passed = float("inf"), 0
    for r in sorted(rows, key=lambda r: -r["bucket"]):
        passed += r["tests"]
        p_over_weight = mean * 10 ** (-r["bucket"] / 10)
        if p_over_weight * tests / passed <= alpha:
            limit = r["bucket"] / 10
    return limit


def span_string(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, by start and then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.sort_array(spans), one), ",")


def without_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose own text no span is found; columns unchanged.

    Rows are written once with their spans and then filtered, so no join has to find them again.
    """
    tested = stored(docs.withColumn(SECRETS, _spanned(F.col(text_col))), "secret-docs")
    limit = _threshold(tested, FALSE_DISCOVERIES)
    found = F.col(SECRETS)
    clean = (F.size(found["base"]) == 0) & (F.size(_discovered(found["tokens"], limit)) == 0)
    return tested.where(clean).select(*docs.columns)
