"""Column functions on names and texts; all run inside the JVM, but for the composition of texts that are not ASCII."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes in the order they are tried, refusal phrases, web-page words, common title words.
LEGAL_SUFFIXES = (
    ", inc.", ", inc", " inc.", " inc", ", corp.", ", corp",
    ", llc", " llc", ", ltd.", ", ltd", " ltd.", " ltd",
    ", co.", ", co", " co.", " co", " limited",
)
REFUSALS = (
    "i cannot assist", "i'm sorry", "i am sorry", "i can't assist", "i can not assist", "against my guidelines",
    "i'm not able to", "i am not able to", "i'm unable to", "i am unable to", "i don't feel comfortable",
    "i do not feel comfortable", "this request", "cannot fulfill", "can't fulfill", "not appropriate",
    "violates", "policy", "content policy",
)
WEB_WORDS = (
    "shopping", "best buys", "discounts", "black friday", "my profile", "logout", "share selection",
    "sign in", "subscribe", "newsletter", "follow", "topics", "cybersecurity", "celebrities",
)
COMMON_TITLE_WORDS = ("the", "and", "for", "with", "from", "that", "this", "says", "said")


def nz(value: Column) -> Column:
    """NULL for the empty string: a missing value either way."""
    return F.nullif(value, F.lit(""))


def strip(value: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def stable_id(*parts: Column) -> Column:
    """The first 12 hexadecimal digits of the SHA-256 of the parts joined by |; a NULL part reads None."""
    texts = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *texts), 256), 1, 12)


def normalize_name(name: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.regexp_replace(strip(name), r"(?U)\s+", " ")


def match_key(name: Column) -> Column:
    """Lower case without legal suffixes (each tried once, in order), separators - _ . and white space; '' for NULL."""
    key = F.aggregate(
        F.array(*[F.lit(s) for s in LEGAL_SUFFIXES]),
        F.lower(strip(F.coalesce(name, F.lit("")))),
        lambda k, s: F.when(F.endswith(k, s), strip(F.left(k, F.length(k) - F.length(s)))).otherwise(k),
    )
    return F.regexp_replace(F.regexp_replace(key, r"[-_.]", ""), r"(?U)\s+", "")


def plain_key(name: Column) -> Column:
    """Lower case without separators - _ . and white space; suffixes of companies stay."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[-_.\s]", "")


def truncate(value: Column, most: int, tail: str = "...") -> Column:
    return F.when(F.length(value) > most, F.concat(F.left(value, F.lit(most)), F.lit(tail))).otherwise(value)


def bm25_tokens(name: Column) -> Column:
    """Words of a technical name: camel case, letters and digits part; a dot stays only before a digit and after one."""
    t = F.regexp_replace(strip(F.coalesce(name, F.lit(""))), r"([a-z])([A-Z])", "$1 $2")
    t = F.replace(F.lower(t), F.lit("_"), F.lit(" "))
    t = F.regexp_replace(F.regexp_replace(t, r"\.(?!\d)", " "), r"(?<!\d)\.", " ")
    t = F.replace(t, F.lit("-"), F.lit(" "))
    t = F.regexp_replace(F.regexp_replace(t, r"([a-zA-Z])(\d)", "$1 $2"), r"(\d)([a-zA-Z])", "$1 $2")
    return F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")


def composed(value: Column) -> Column:
    """Compatibility composition (NFKC)."""

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return F.when(value.rlike(r"\A\p{ASCII}*\z"), value).otherwise(fold(value))


def fold_text(value: Column) -> Column:
    """Lower case of the composed form, without bracketed parts and all but letters, digits and underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(composed(value)), r"\[[^\]]*\]", ""), r"[^\p{L}\p{N}_]+", "")


def mention_span(content: Column, mention: Column) -> Column:
    """[start, end) of the first exact occurrence, else of the first without regard to case; NULL if there is none."""
    exact = F.nullif(F.position(mention, content), F.lit(0))
    loose = F.nullif(F.position(F.lower(mention), F.lower(content)), F.lit(0))
    start = F.coalesce(exact, loose) - 1
    return F.when(
        (F.length(mention) > 0) & start.isNotNull(),
        F.struct(F.substring(content, start + 1, F.length(mention)).alias("text"), start.alias("start"), (start + F.length(mention)).alias("end")),
    )


def strip_links(value: Column) -> Column:
    """[text](http...) becomes text."""
    return F.regexp_replace(value, r"\[([^\]]+)\]\(https?://[^)]+\)", "$1")


def is_refusal(value: Column) -> Column:
    """Short without a brace, or with any refusal phrase."""
    low = strip(F.lower(value))
    phrase = F.lit(False)
    for p in REFUSALS:
        phrase = phrase | F.contains(low, F.lit(p))
    return ((F.length(low) < 200) & ~F.contains(low, F.lit("{"))) | phrase


def is_event_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"(?U)\A[\w-]+\z"), F.lit(False))


def parse_choice(value: Column) -> Column:
    """The number before a middle dot, -1 if there is none."""
    return F.coalesce(F.try_to_number(strip(F.split_part(value, F.lit("·"), F.lit(1))), F.lit("S999999999")).cast("int"), F.lit(-1))


def safe_uri(value: Column) -> Column:
    return F.translate(value, " /", "__")


def escape_html(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def context_window(content: Column, evidence: Column, side: int = 500, short: int = 2000) -> Column:
    """A long text's part around the evidence's first 50 characters, else its first `short` characters."""
    at = F.position(F.left(evidence, F.lit(50)), content)
    begin = F.greatest(at - side, F.lit(1))
    around = F.substring(content, begin, F.least(at + 50 + side, F.length(content) + 1) - begin)
    return F.when((F.length(content) > short) & (at > 0) & (F.length(evidence) > 0), around).otherwise(F.left(content, F.lit(short)))


def source_doc_id(given: Column, evidence: Column, fallback: Column) -> Column:
    """The given document, else the one in brackets before the evidence, else the fallback."""
    own = strip(F.coalesce(given, F.lit("")))
    named = strip(F.regexp_extract(F.coalesce(evidence, F.lit("")), r"^\[([^\]]*)\]", 1))
    return F.coalesce(F.when(own != "event_level", nz(own)), nz(named), fallback)


def year_of(value: Column) -> Column:
    return nz(F.regexp_extract(value, r"^(\d{4})", 1)).cast("int")


def role_of(name: Column) -> Column:
    return F.lower(F.substring_index(name, "_", -1))


def camel(value: Column) -> Column:
    """snake_case or spaced words as camelCase."""
    words = F.replace(F.initcap(F.translate(value, "_", " ")), F.lit(" "), F.lit(""))
    return F.concat(F.lower(F.left(words, F.lit(1))), F.substring(words, F.lit(2), F.length(words)))


# What a baseline's relations are also called.
BASELINE_PREDICATES = {
    "caused": "causes", "caused by": "causes", "cause": "causes",
    "leads to": "leadsTo", "leads_to": "leadsTo", "led to": "leadsTo",
    "results in": "leadsTo", "results_in": "leadsTo", "resulted in": "leadsTo",
    "impacts": "impacts", "impact": "impacts", "impacted": "impacts",
    "affects": "affects", "affect": "affects", "affected": "affects",
}
CHAIN_PREDICATES = ("causes", "leadsTo", "impacts", "affects")


def baseline_predicate(value: Column) -> Column:
    """A chain relation as it is, one of its other names as it, any other in camel case; '' for NULL."""
    own = strip(F.coalesce(value, F.lit("")))
    low = F.lower(own)
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in BASELINE_PREDICATES.items() for x in kv]), low)
    words = F.split(low, r"(?U)[\s_]+")
    joined = F.concat(F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.array_join(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), ""))
    return F.when(own.isin(*CHAIN_PREDICATES), own).otherwise(F.coalesce(named, joined))


def clean_web_page(content: Column, title: Column, words: tuple[str, ...] = WEB_WORDS) -> Column:
    """A page's text without navigation: from the first long line about the title to the last long line.

    Pages of under 500 characters, or with fewer than 3 navigation lines among the first 40, stay as they
    are, as do those whose text begins on the first line or nowhere.  Without a line of 40 characters that
    holds two words of the title, the first line of over 200 counts.
    """
    lines = F.split(content, "\n")
    marked = F.filter(F.slice(lines, 1, 40), lambda x: F.lower(x).rlike("|".join(words)))
    own = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0))), F.array(*[F.lit(w) for w in COMMON_TITLE_WORDS]))
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    about = F.filter(numbered, lambda s: (F.length(strip(s["x"])) >= 40) & (F.size(F.filter(own, lambda w: F.contains(F.lower(s["x"]), w))) >= 2))
    long = F.filter(numbered, lambda s: F.length(strip(s["x"])) > 200)
    start = F.coalesce(F.get(about, F.lit(0))["i"], F.get(long, F.lit(0))["i"], F.lit(-1))
    last = F.array_max(F.transform(F.filter(numbered, lambda s: F.length(strip(s["x"])) >= 20), lambda s: s["i"]))
    body = F.array_join(F.slice(lines, start + 1, F.greatest(F.coalesce(last, F.lit(-1)) - start + 1, F.lit(0))), "\n")
    rest = F.slice(lines, F.coalesce(last, F.lit(-1)) + 2, F.size(lines))
    body = F.when(F.forall(rest, lambda x: strip(x) == ""), F.regexp_replace(body, r"(?U)\s+$", "")).otherwise(body)
    page = (F.length(content) >= 500) & (F.size(marked) >= 3) & (start > 0)
    return F.when(page, body).otherwise(content)
