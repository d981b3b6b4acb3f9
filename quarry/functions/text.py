"""Text functions as Column expressions: analysis, sentences, tokens, ids, escapes. All run in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The English stopwords of the word analyzer.
STOPWORDS = tuple(
    """
a about above after again against all am an and any are as at be because been before being below
between both but by can could did do does doing down during each few for from further had has have
having he her here hers herself him himself his how i if in into is it its itself just me more most
my myself no nor not now of off on once only or other our ours ourselves out over own same she
should so some such than that the their theirs them themselves then there these they this those
through to too under until up very was we were what when where which while who whom why will with
would you your yours yourself yourselves
""".split()
)

# Abbreviations after which a sentence does not end.
ABBREVIATIONS = ("e.g", "i.e", "etc", "vs", "cf", "fig", "al", "approx", "no", "dr", "mr", "mrs", "ms")

# Question words; the last three count as "what".
QUESTION_WORDS = ("what", "where", "why", "how", "when", "who", "which", "explain", "describe", "define")
AS_WHAT = ("explain", "describe", "define")

SPACES = r"[\s\p{IsWhite_Space}﻿]+"


@lru_cache(maxsize=1)
def _compatibility() -> tuple[str, str, dict[str, str]]:
    """NFKD without marks, by rule from the Unicode database: one-to-one pairs, and one-to-many ones.

    Hangul syllables stay composed; ASCII needs nothing.
    """
    ones, others, many = [], [], {}
    for code in range(0x80, 0x2FA20):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) != "Mn")
        if plain == c or not plain:
            continue
        if len(plain) == 1:
            ones.append(c)
            others.append(plain)
        else:
            many[c] = plain
    return "".join(ones), "".join(others), many


def _class_of(chars) -> str:
    """A Java character class of the given characters, as ranges."""
    codes = sorted(map(ord, chars))
    out, k = [], 0
    while k < len(codes):
        end = k
        while end + 1 < len(codes) and codes[end + 1] == codes[end] + 1:
            end += 1
        out.append(f"\\x{{{codes[k]:x}}}-\\x{{{codes[end]:x}}}")
        k = end + 1
    return "[" + "".join(out) + "]"


def plain(text: Column) -> Column:
    """Compatibility decomposition (NFKD) without combining marks."""
    ones, others, many = _compatibility()
    # one literal that the optimizer folds: thousands of them would be built and analyzed anew for every column of terms
    pairs = F.str_to_map(F.lit("\x01".join(f"{c}\x02{to}" for c, to in many.items())), F.lit("\x01"), F.lit("\x02"))
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(pairs, c), c)), "")
    wide = F.when(text.rlike(_class_of(many)), spelled).otherwise(text)
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(F.regexp_replace(F.translate(wide, ones, others), r"\p{Mn}", ""))


def words(text: Column) -> Column:
    """Normalized words: decomposed, without marks, lower case, cut at anything that is no letter or number."""
    return F.filter(F.split(F.lower(plain(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def is_english(lang: Column) -> Column:
    return F.coalesce(lang.rlike("(?i)^en(-|$)"), F.lit(False))


def s_stem(t: Column) -> Column:
    """S-stemmer: the first rule that fits, for terms of more than three characters."""
    n = F.length(t)
    ies = t.endswith("ies") & ~t.endswith("eies") & ~t.endswith("aies")
    es = t.endswith("es") & ~t.endswith("aes") & ~t.endswith("ees") & ~t.endswith("oes")
    s = t.endswith("s") & ~t.endswith("us") & ~t.endswith("ss")
    return (
        F.when(n <= 3, t)
        .when(ies, F.concat(F.substr(t, F.lit(1), n - 3), F.lit("y")))
        .when(es | s, F.substr(t, F.lit(1), n - 1))
        .otherwise(t)
    )


def is_stopword(w: Column) -> Column:
    return w.isin(*STOPWORDS)


def analyze(text: Column, lang: Column | str = "en") -> Column:
    """Terms of a text, duplicates kept. Stopwords go and terms are stemmed in English only, in this order."""
    lang = F.lit(lang) if isinstance(lang, str) else lang
    w = words(text)
    return F.when(is_english(lang), F.transform(F.filter(w, lambda x: ~is_stopword(x)), s_stem)).otherwise(w)


def terms(df: DataFrame, key: str, text: str, lang: Column | str = "en") -> DataFrame:
    """The same terms, one row each: (key, pos, term). Words are exploded first, so the rest stays in generated code."""
    lang = F.lit(lang) if isinstance(lang, str) else lang
    cut = df.select(F.col(key), is_english(lang).alias("en"), F.posexplode(words(F.col(text))).alias("pos", "w"))
    return cut.where(~(F.col("en") & is_stopword(F.col("w")))).select(key, "pos", F.when(F.col("en"), s_stem(F.col("w"))).otherwise(F.col("w")).alias("term"))


def collapse(text: Column) -> Column:
    """White space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def sentences(line: Column) -> Column:
    """Sentences of one line: cut after . ! ? and space before a capital, digit, quote or bracket, not after abbreviations."""
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    cut = rf"(?<=[.!?])(?<!\b(?i:{short})\.)\s+(?=[A-Z0-9\"“(])"
    return F.filter(F.transform(F.split(line, cut), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")


def pre_tokenize(text: Column) -> Column:
    """BERT pre-tokens: white space separates; every punctuation character and ASCII sign stands alone."""
    sign = r"\p{P}!-/:-@\[-`{-~"
    return F.regexp_extract_all(text, F.lit(rf"[{sign}]|[^{sign}\p{{IsWhite_Space}}]+"), F.lit(0))


def slug(text: Column) -> Column:
    """Id of a heading: plain lower-case letters and digits joined by hyphens, 64 at most."""
    hyphens = F.regexp_replace(plain(F.lower(collapse(text))), "[^a-z0-9]+", "-")
    trimmed = F.regexp_replace(hyphens, "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substr(trimmed, F.lit(1), F.lit(64)), F.lit("")), F.lit("section"))


HEADING_ID = r"\s*\{#([A-Za-z0-9][A-Za-z0-9_.-]*)\}\s*$"


def heading_id(title: Column) -> Column:
    """The explicit ``{#id}`` at a heading's end, else null."""
    return F.nullif(F.regexp_extract(title, HEADING_ID, 1), F.lit(""))


def heading_title(title: Column) -> Column:
    return collapse(F.regexp_replace(title, HEADING_ID, ""))


def question_word(text: Column) -> Column:
    """The first question word, or null."""
    found = F.lower(F.regexp_extract(text, r"(?i)\b(" + "|".join(QUESTION_WORDS) + r")\b", 1))
    return F.when(found.isin(*AS_WHAT), F.lit("what")).otherwise(F.nullif(found, F.lit("")))


def contains_phrase(text_terms: Column, phrase_terms: Column) -> Column:
    """Whether the phrase's terms stand next to each other in the text's; an empty phrase never does."""
    spaced = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return (F.size(phrase_terms) > 0) & spaced(text_terms).contains(spaced(phrase_terms))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def escape_html(text: Column, quotes: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if quotes else out


def escape_json(json: Column) -> Column:
    """JSON for a script element: no ``<`` that could end it."""
    return F.replace(json, F.lit("<"), F.lit("\\u003c"))


def shortened(text: Column, most: int = 220) -> Column:
    """At most ``most`` characters, with an ellipsis in place of the rest."""
    return F.when(F.length(text) > most, F.concat(F.substr(text, F.lit(1), F.lit(most - 3)), F.lit("…"))).otherwise(text)


def locate(haystack: Column, sentence: Column) -> Column:
    """1-based place of a sentence in a text, white space runs counting as one space; 0 if absent or empty."""
    return F.when(collapse(sentence) == "", 0).otherwise(F.instr(collapse(haystack), collapse(sentence)))


def base64(x: Column | str) -> Column:
    """Base64 in one line; the built-in function may cut lines after 76 characters."""
    return F.translate(F.base64(x), "\r\n", "")


def sha256_base64(x: Column) -> Column:
    return base64(F.unhex(F.sha2(x, 256)))


def csp(script_sha: Column, style_sha: Column) -> Column:
    """Content security policy of a package."""
    return F.format_string(
        "default-src 'none'; script-src 'sha256-%s'; style-src 'sha256-%s'; img-src data:; connect-src 'none'; form-action 'none'; base-uri 'none'",
        script_sha,
        style_sha,
    )


def iso_date(text: Column, default: Column | None = None) -> Column:
    """``YYYY-MM-DD`` of a date string, else the default (today)."""
    return F.date_format(F.coalesce(F.try_to_date(text), default if default is not None else F.current_date()), "yyyy-MM-dd")
