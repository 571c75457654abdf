r"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Each kind has a pattern whose leftmost non-overlapping matches are proposed, a
check that drops false ones without another try, and words that raise its score
when they stand near.  The kinds of ``BASE`` count whatever their score; those of
``ADDED`` count from ``THRESHOLD`` on.

Places come from splitting a text by the pattern: the pieces between matches and
the matches themselves add up to positions in code points.  Patterns hold no
nested repetition that Java would run by recursion, and every run is entered at
its first character only, so long runs cost no square of their length.

An account number ends where its country's does, whatever capitals or digits
follow.  One of a country without a listed length, as long as it can be, is cut
at its blanks until the checksum holds.

Defined results: a null text has no spans; an empty one neither.  Repeated rows
are judged each.  Other columns are kept, but for those that clash with ``spans``
or begin with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finframe.llm.columns import without

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "secret")
KINDS = BASE + ADDED
THRESHOLD = 0.6
NEAR = 48  # code points before a span in which context words count

#: Length of an account number with country and check digits, by country, as the IBAN registry lists them.
IBAN_LENGTH = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 33: "LC RU",
}
LISTED = "|".join(IBAN_LENGTH.values()).replace(" ", "|")
_EXACT = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in IBAN_LENGTH.items())

LOCAL = r"A-Za-z0-9._%+-"
#: The pattern of each kind; the card's runs over a text whose blanks and hyphens stand between digits only.
PATTERN = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9\x20-]{12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # the country's own length first; what is of no listed length ends before a number that is
    "iban": rf"(?<![A-Za-z0-9])(?:{_EXACT}|[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!{_EXACT}))?[A-Z0-9]){{11,30}}(?![A-Za-z0-9]))",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])",
}
#: What a text must hold for the pattern to be tried at all.
HINT = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9\x20-]{11}", "iban": r"[A-Z]{2}[0-9]{2}", "secret": r"[0-9a-fA-F]{32}"}
#: Score without context, and words that add ``CONTEXT`` to it.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "secret": 0.3}
CONTEXT = 0.4
WORDS = {
    "email": "mail|contact|write", "ip": "ip|host|server|address|login", "card": "card|visa|master|credit|debit|pay",
    "phone": "phone|tel|call|mobile|fax|contact", "iban": "iban|account|bank|konto|compte|cuenta",
    "secret": "token|secret|key|password|passwd|auth",
}


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn checksum."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)
    return (F.length(digits) > 0) & (total % 10 == 0)


def mod97(account: Column) -> Column:
    """Whether country, check digits and account leave 1 modulo 97."""
    turned = F.concat(F.substr(account, F.lit(5), F.length(account)), F.substr(account, F.lit(1), F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        return F.when(letter, (rest * 100 + F.ascii(c) - 55) % 97).otherwise((rest * 10 + F.when(~letter, c).cast("int")) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(add(r, c))) == 1


def account(m: Column) -> Column:
    """The account number at the start of a proposed span: all of it, or of unlisted countries the longest part up to a blank that fits; null if none does."""
    words = F.split(m, " ")
    shorter = F.when(m.rlike(f"^(?:{LISTED})"), F.array(m)).otherwise(
        F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, 1, n), " ")))
    bare = lambda p: F.replace(p, F.lit(" "), F.lit(""))
    return F.get(F.filter(shorter, lambda p: (F.length(bare(p)) >= 15) & mod97(bare(p))), F.lit(0))


def _confirmed(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return m.isNotNull()  # cut and checked by ``account``
    return F.lit(True)


def _searched(kind: str, text: Column) -> Column:
    """The text as the kind's pattern reads it, of the same length."""
    if kind == "card":
        return F.regexp_replace(text, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "_")
    return text


def _hinted(kind: str, text: Column) -> Column:
    if kind in ("email", "phone"):
        return F.contains(text, F.lit("@" if kind == "email" else "+"))
    return text.rlike(HINT[kind])


def _spans(kind: str, text: Column, threshold: float) -> Column:
    none = F.array().cast("array<struct<start:int,end:int,kind:string,score:double>>")
    read = _searched(kind, text)
    pattern = PATTERN[kind]
    found = F.arrays_zip(F.split(read, pattern, -1).alias("gap"), F.regexp_extract_all(read, F.lit(pattern), F.lit(0)).alias("hit"))

    def place(done: Column, p: Column) -> Column:
        start = done["at"] + F.length(p["gap"])
        end = start + F.length(p["hit"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("hit")))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(p["hit"].isNull(), done["out"]).otherwise(F.concat(done["out"], one)).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,hit:string>>").alias("out"))
    placed = F.aggregate(found, begin, place, lambda d: d["out"])
    if kind == "iban":
        placed = F.transform(placed, lambda s: F.struct(s["start"].alias("start"), account(s["hit"]).alias("hit")))
        placed = F.transform(placed, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["hit"])).alias("end"), s["hit"].alias("hit")))
    sure = F.filter(placed, lambda s: _confirmed(kind, s["hit"]))

    def scored(s: Column) -> Column:
        near = F.lower(F.substr(text, F.greatest(s["start"] - NEAR, F.lit(0)) + 1, s["start"] - F.greatest(s["start"] - NEAR, F.lit(0))))
        score = F.least(F.lit(1.0), F.lit(SCORE[kind]) + F.when(near.rlike(rf"(?:^|[^a-z0-9])(?:{WORDS[kind]})"), CONTEXT).otherwise(0.0))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

    spans = F.transform(sure, scored)
    if kind in ADDED:
        spans = F.filter(spans, lambda s: s["score"] >= threshold)
    return F.when(_hinted(kind, text), spans).otherwise(none)


def find(docs: DataFrame, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows with ``spans``: (start, end, kind, score), by kind as listed, then by start; ends are exclusive."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return without(docs, ["spans"], [text_col]).withColumn("spans", F.concat(*[_spans(kind, text, threshold) for kind in KINDS]))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by the name of its first kind."""

    def merge(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        return F.when((F.size(done) > 0) & (s["start"] < last["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(own)))

    runs = F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:int,end:int,kind:string>>"), merge)
    edge = F.struct(F.length(text).alias("start"), F.length(text).alias("end"), F.lit("").alias("kind"))

    def piece(r: Column, i: Column) -> Column:
        after = F.when(i > 0, F.get(runs, i - 1)["end"]).otherwise(0)
        mark = F.when(r["kind"] == "", "").otherwise(F.concat(F.lit("<"), F.upper(r["kind"]), F.lit(">")))
        return F.concat(F.substr(text, after + 1, r["start"] - after), mark)

    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.transform(F.concat(runs, F.array(edge)), piece), ""))
