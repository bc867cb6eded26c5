"""Secret scans in SQL expressions only: fixed patterns, and sliding-window entropy of candidate strings."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12
KINDS = ("assign", "access", "hex", "entropy")

#: Entropy candidates: maximal runs of these characters, of WINDOW or more.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least bits per character of a window by its class.  A window is mixed if somewhere a letter stands beside a
#: digit; of those, `hex` has no letter beyond F.  Others are taken for words, unless they have CASES letters of
#: either case.  With more than SIGNS characters that are neither letters nor digits, the strictest limit holds.
BITS = {"hex": 3.0, "mixed": 3.6, "cased": 3.6, "words": 4.0}
CASES, SIGNS = 5, 2
#: The allow-list: a UUID, and a part between separators that is marked as an example.  No window over one counts.
UUID = r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b"
MARKED = r"(?i)(?:example|sample|dummy|placeholder|xxxx)"
PART = r"[A-Za-z0-9+]+|[^A-Za-z0-9+]+"
#: A letter beside a digit.
TURN = "[A-Za-z][0-9]|[0-9][A-Za-z]"
#: Windows that one run of counts goes over; the next run starts afresh.
STRETCH = 4096

#: Characters of candidates by their code less FIRST; 0 is a blank, which stands for what the allow-list took out.
FIRST, CODES = 42, 81
_FIELDS = ("letter", "upper", "lower", "hexletter", "sign", "blank")


def _char(k: int) -> str:
    return chr(FIRST + k) if k else " "


def _tally(k: int) -> int:
    """One character's part of the window's tallies: five bits for each of _FIELDS."""
    c = _char(k)
    marks = (c.isalpha(), c.isupper(), c.islower(), c in "abcdefABCDEF", not c.isalnum(), c == " ")
    return sum(int(m) << (5 * i) for i, m in enumerate(marks))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is worked out once, however often (or inside whatever lambda) it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before_each(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """All values before each one, joined from `zero` on, by blocks of about the square root of their number."""
    fold = lambda x: F.aggregate(x, zero, join)

    def spread(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v["x"]) - 1) / v["side"]).cast("int")), lambda b: F.slice(v["x"], b * v["side"] + 1, v["side"]))
        return let(blocks, lambda b: let(F.struct(b.alias("b"), F.transform(b, fold).alias("total")), within))

    def within(v: Column) -> Column:
        ahead = F.transform(v["b"], lambda x, k: F.struct(x.alias("x"), fold(F.slice(v["total"], F.lit(1), k)).alias("ahead")))
        return F.flatten(F.transform(ahead, lambda s: F.transform(s["x"], lambda _, i: join(s["ahead"], fold(F.slice(s["x"], F.lit(1), i))))))

    wide = lambda x: F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))
    return let(values, lambda x: F.when(F.size(x) > 0, let(F.struct(x.alias("x"), wide(x).alias("side")), spread)).otherwise(x))


def _matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """All matches as structs (start, end, value: the match or its group), found by what lies between them."""
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group or 0)).alias("value"),
    )

    def placed(x: Column) -> Column:
        steps = F.transform(x["all"], lambda m, i: F.get(x["gap"], i) + F.length(m))
        return let(
            F.struct(x.alias("x"), before_each(steps, F.lit(0), lambda a, b: a + b).alias("at")),
            lambda y: F.transform(
                y["at"],
                lambda p, i: F.struct(
                    (p + F.get(y["x"]["gap"], i)).alias("start"),
                    (p + F.get(y["x"]["gap"], i) + F.length(F.get(y["x"]["all"], i))).alias("end"),
                    F.get(y["x"]["value"], i).alias("value"),
                ),
            ),
        )

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), let(found, placed)).otherwise(none)


def _codes(value: Column) -> Column:
    """The candidate's characters as codes, blanks in place of what the allow-list suppresses."""
    blank = lambda x: F.when(F.rlike(x, F.lit(MARKED)), F.array_repeat(F.lit(0), F.length(x))).otherwise(
        F.transform(F.split(x, ""), lambda c: F.greatest(F.lit(0), F.ascii(c) - FIRST))
    )
    return F.flatten(F.transform(F.regexp_extract_all(F.regexp_replace(value, UUID, " " * 36), F.lit(PART), F.lit(0)), blank))


def _hot(codes: Column) -> Column:
    """(start, end) of the runs of overlapping windows of a stretch that are dense enough, from counts kept up step by step."""
    micro = [round(1e6 * (n * math.log2(n) if n else 0)) for n in range(WINDOW + 2)]
    more = F.array(*[F.lit(b - a) for a, b in zip(micro, micro[1:], strict=False)])
    tallies = F.array(*[F.lit(_tally(k)) for k in range(CODES)])
    kinds = F.array(*[F.lit(1 if _char(k).isalpha() else 2 if _char(k).isdigit() else 0) for k in range(CODES)])
    limit = {k: F.lit(math.floor((math.log2(WINDOW) - b) * WINDOW * 1e6)) for k, b in BITS.items()}
    span = "struct<start:int,end:int>"

    def at(i: Column) -> Column:
        return F.when(i >= 0, F.get(codes, i)).otherwise(0)

    def turns(i: Column) -> Column:
        """Whether a letter stands beside a digit here and one before."""
        return F.when((i > 0) & (F.get(kinds, at(i)) * F.get(kinds, at(i - 1)) == 2), 1).otherwise(0)

    def held(count: Column, k: Column) -> Column:
        return F.ascii(F.substring(count, k + 1, F.lit(1))) - 48

    def shifted(count: Column, k: Column, by: int) -> Column:
        return F.overlay(count, F.chr(held(count, k) + 48 + by), k + 1, F.lit(1))

    def step(s: Column, x: Column) -> Column:
        enter, leave = x["enter"], x["leave"]
        same = enter == leave
        count = F.when(same | (leave == 0), s["count"]).otherwise(shifted(s["count"], leave, -1))
        count = let(count, lambda c: F.when(same | (enter == 0), c).otherwise(shifted(c, enter, 1)))
        total = s["total"] + F.when(same, 0).otherwise(
            F.when(enter > 0, F.get(more, held(s["count"], enter))).otherwise(0) - F.when(leave > 0, F.get(more, held(s["count"], leave) - 1)).otherwise(0)
        )
        tally = s["tally"] + F.get(tallies, enter) - F.when(x["i"] >= WINDOW, F.get(tallies, leave)).otherwise(0)
        turn = s["turn"] + x["gain"]
        return let(F.struct(count.alias("count"), total.alias("total"), tally.alias("tally"), turn.alias("turn"), s["runs"].alias("runs"), s["first"].alias("first"), s["last"].alias("last"), (x["i"] - WINDOW + 1).alias("at")), judged)

    def judged(s: Column) -> Column:
        has = lambda name: F.shiftright(s["tally"], 5 * _FIELDS.index(name)).bitwiseAND(F.lit(31))
        most = (
            F.when(has("sign") > SIGNS, F.when((s["turn"] > 0) & (has("letter") == has("hexletter")), limit["hex"]).otherwise(limit["words"]))
            .when(s["turn"] > 0, F.when(has("letter") == has("hexletter"), limit["hex"]).otherwise(limit["mixed"]))
            .when((has("upper") >= CASES) & (has("lower") >= CASES), limit["cased"])
            .otherwise(limit["words"])
        )
        hot = (s["at"] >= 0) & (has("blank") == 0) & (has("letter") > 0) & (s["total"] <= most)
        apart = (s["first"] >= 0) & (s["at"] - s["last"] > WINDOW)
        return let(
            F.struct(s.alias("s"), hot.alias("hot"), (hot & apart).alias("apart")),
            lambda y: F.struct(
                *[y["s"][k].alias(k) for k in ("count", "total", "tally", "turn")],
                F.when(y["apart"], F.concat(y["s"]["runs"], F.array(_span(y["s"]).cast(span)))).otherwise(y["s"]["runs"]).alias("runs"),
                F.when(y["hot"] & (y["apart"] | (y["s"]["first"] < 0)), y["s"]["at"]).otherwise(y["s"]["first"]).alias("first"),
                F.when(y["hot"], y["s"]["at"]).otherwise(y["s"]["last"]).alias("last"),
            ),
        )

    steps = F.transform(
        F.sequence(F.lit(0), F.size(codes) - 1),
        lambda i: F.struct(i.alias("i"), at(i).alias("enter"), at(i - WINDOW).alias("leave"), (turns(i) - turns(i - WINDOW + 1)).alias("gain")),
    )
    start = F.struct(F.lit("0" * CODES).alias("count"), F.lit(0).alias("total"), F.lit(0).alias("tally"), F.lit(0).alias("turn"), F.array().cast(f"array<{span}>").alias("runs"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    return F.aggregate(steps, start, step, lambda s: F.when(s["first"] >= 0, F.concat(s["runs"], F.array(_span(s).cast(span)))).otherwise(s["runs"]))


def _span(s: Column) -> Column:
    return F.struct(s["first"].alias("start"), (s["last"] + WINDOW).alias("end"))


def _dense(value: Column) -> Column:
    """(start, end) of the dense parts of a candidate: its stretches' runs, joined where they overlap or touch."""
    moved = lambda x, k: F.transform(x, lambda r: F.struct((r["start"] + k * STRETCH).alias("start"), (r["end"] + k * STRETCH).alias("end")))
    # no window is denser than the distinct characters of its candidate allow, and few candidates have enough of them
    kinds = lambda b: math.ceil(2 ** BITS[b])
    least = F.when(value.rlike(TURN), kinds("hex")).otherwise(min(kinds(b) for b in BITS if b != "hex"))
    stretch = lambda codes: lambda k: moved(let(F.slice(codes, k * STRETCH + 1, F.lit(STRETCH + WINDOW - 1)), _hot), k)
    runs = lambda codes: F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(codes) - WINDOW) / STRETCH).cast("int")), stretch(codes)))

    def joined(r: Column) -> Column:
        opens = F.filter(r, lambda x, i: (i == 0) | (x["start"] > F.get(r, F.greatest(i - 1, F.lit(0)))["end"]))
        closes = F.filter(r, lambda x, i: (i == F.size(r) - 1) | (F.get(r, F.least(i + 1, F.size(r) - 1))["start"] > x["end"]))
        return F.zip_with(opens, closes, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))

    none = F.array().cast("array<struct<start:int,end:int>>")
    scanned = lambda codes: F.when(F.size(F.array_distinct(codes)) >= least, let(runs(codes), joined)).otherwise(none)
    return let(_codes(value), scanned)


def spans_of(text: Column) -> Column:
    """Array of (start, kind number, end) of a text without null, sorted; code points, end exclusive."""
    spans = lambda found, kind: F.transform(found, lambda c: F.struct(c["start"].alias("start"), F.lit(kind).alias("kind"), c["end"].alias("end")))
    assign = _matches(text, ASSIGN, 2)
    dense = F.flatten(
        F.transform(_matches(text, CANDIDATE), lambda c: F.transform(_dense(c["value"]), lambda d: F.struct((c["start"] + d["start"]).alias("start"), (c["start"] + d["end"]).alias("end"))))
    )
    return F.array_sort(
        F.concat(
            spans(F.filter(assign, lambda c: F.length(c["value"]) >= ASSIGN_VALUE), 0),
            spans(_matches(text, ACCESS), 1),
            spans(_matches(text, HEX), 2),
            spans(dense, 3),
        )
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, n_entropy, spans.

    Kinds of spans: the three base ones, then `entropy`: the dense parts of each candidate that the
    allow-list does not suppress.  Null and empty texts have none.  Work grows with a text's length, and
    a row is scanned as often as it occurs; an empty table gives no rows.
    """
    df = documents.select("doc_id", spans_of(F.coalesce("text", F.lit(""))).alias("spans"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return df.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        count(3).alias("n_entropy"),
        _joined(F.col("spans")).alias("spans"),
    )


def _blocks(text: Column) -> Column:
    """(side, the text in pieces of that many code points), cut in two steps so that no long text is walked for each piece."""

    def cut(x: Column, size: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / size).cast("int")), lambda k: F.substring(x, k * size + 1, size))

    side = F.greatest(F.lit(1), F.ceil(F.cbrt(F.length(text))).cast("int"))
    return let(side, lambda n: F.struct(n.alias("side"), F.flatten(F.transform(cut(text, n * n), lambda p: cut(p, n))).alias("pieces")))


def _redacted(text: Column, spans: Column, mark: str) -> Column:
    def between(b: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / b["side"]).cast("int")
        some = F.slice(b["pieces"], first + 1, F.ceil(end / b["side"]).cast("int") - first)
        return F.when(end > start, F.substring(F.array_join(some, ""), start - first * b["side"] + 1, end - start)).otherwise(F.lit(""))

    def cut(x: Column) -> Column:
        ends = F.transform(x["spans"], lambda s: s["end"])
        return let(F.struct(x.alias("x"), before_each(ends, F.lit(0), lambda a, b: F.greatest(a, b)).alias("upto"), F.array_max(ends).alias("last")), put)

    def put(y: Column) -> Column:
        marked = F.filter(F.zip_with(y["x"]["spans"], y["upto"], lambda s, u: F.struct(u.alias("from"), s["start"].alias("to"))), lambda g: g["to"] >= g["from"])
        kept = F.transform(marked, lambda g: F.concat(between(y["x"]["blocks"], g["from"], g["to"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), between(y["x"]["blocks"], y["last"], y["x"]["size"]))

    return let(F.struct(spans.alias("spans"), _blocks(text).alias("blocks"), F.length(text).alias("size")), cut)


def redact(documents: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every span, or run of overlapping spans, in `text` replaced by `mark`.

    Other columns stay as they are, whatever their names; null and empty texts, and texts without spans, too.
    """
    columns = documents.columns
    rows = documents.select(F.struct(*[documents[c] for c in columns]).alias("row"), F.col("text").alias("text"))
    found = rows.select("row", "text", spans_of(F.coalesce("text", F.lit(""))).alias("spans"))
    clean = F.when(F.size("spans") > 0, _redacted(F.col("text"), F.col("spans"), mark)).otherwise(F.col("text"))
    return found.select(*[clean.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in columns])
