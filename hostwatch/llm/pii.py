"""Personal data in texts: regular expressions propose spans, checks confirm them, words nearby adjust a score.

Built from column expressions only.  A kind's matches are put between marks, the text is split at the marks, and every
second part is a match whose place follows from the lengths before it.  All expressions run in linear time: runs are
taken possessively, and a match may only begin where the plain pattern's leftmost match could.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A private-use character put around matches; one in a text counts as the replacement character, which no pattern holds.
MARK, REPLACED = "\ue000", "\ufffd"
#: Code points before a span that are searched for context words, and what such a word adds to the score.
CONTEXT, BONUS = 50, 0.3
#: Spans below this score are left out.
THRESHOLD = 0.5

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Countries by the length of their account numbers.
_IBAN = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
         22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
         26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
         32: "LC", 33: "RU"}
_KNOWN = "(?:" + "|".join(" ".join(_IBAN.values()).split()) + ")"


def _iban() -> str:
    """Account numbers at their country's length; of other countries the longest run, up to where one of these begins."""
    own = [f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Z0-9])" for n, codes in _IBAN.items()]
    other = f"(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:(?! {_KNOWN}[0-9]{{2}}) ?[A-Z0-9]){{11,30}}"
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(own)}|{other})"


def digits_of(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the sum of all digits, with every second one from the right doubled (less 9 above 9), ends in zero."""
    def part(i):
        d = F.substring(digits, -i, 1).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + part(i)) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters read as 10 to 35, leaves 1."""
    text = F.regexp_replace(account, " ", "")
    moved = F.concat(F.substring(text, 5, 1000), F.substring(text, 1, 4))

    def step(acc, i):
        c = F.substring(moved, i, 1)
        return F.when(c < "A", (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.  ``holds``: a character without which a text has no match; ``valid``: the check of a match,
    from the match and the text before it; ``score`` is that of a checked match, ``words`` raise it."""

    name: str
    pattern: str
    holds: str | None
    valid: object
    score: float
    words: str


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         lambda found, before: F.lit(True), 0.7, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".",
         lambda found, before: found.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"), 0.6, r"\bip\b|address|host|server"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])", None,
         lambda found, before: luhn(digits_of(found)), 0.7, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9](?:[ ().-]*+[0-9]){7,14}+(?![ ().-]*[0-9])", "+",
         lambda found, before: F.lit(True), 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", _iban(), None,
         lambda found, before: mod97(found), 0.7, "iban|account|bank"),
    Kind("ssn", r"(?<![0-9])[0-9]++-[0-9]++-[0-9]++", "-",
         lambda found, before: ~before.rlike("[0-9-]$") & found.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), 0.3, "ssn|social security|tax id"),
)
#: Kinds that have a count of their own.
BASE = ("email", "ip", "card", "phone")
#: What all documents of the pipeline have.
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def _matches(text: Column, kind: Kind) -> Column:
    """The places of a kind's matches: an array of (start, end, found, before)."""
    marked = F.regexp_replace(text, kind.pattern, f"{MARK}$0{MARK}")
    parts = F.split(marked, MARK)
    if kind.holds:
        parts = F.when(F.contains(text, F.lit(kind.holds)), parts).otherwise(F.array(F.lit("")))
    none = F.array().cast("array<struct<start: int, end: int, found: string, before: string>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit("").alias("before"), none.alias("spans"))

    def step(acc, part):
        end = acc["at"] + F.length(part)
        span = F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("found"), acc["before"].alias("before"))
        spans = F.when(acc["i"] % 2 == 1, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), (acc["i"] + 1).alias("i"), F.substring(part, -CONTEXT, CONTEXT).alias("before"), spans.alias("spans"))

    return F.aggregate(parts, start, step, lambda acc: acc["spans"])


def _scored(kind: Kind, spans: Column) -> Column:
    """Checked matches of a kind with their score, below the threshold left out."""
    found = F.filter(spans, lambda s: kind.valid(s["found"], s["before"]))
    near = F.transform(found, lambda s: F.struct(
        F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        F.round(F.lit(kind.score) + F.when(F.lower(s["before"]).rlike(kind.words), BONUS).otherwise(0.0), 3).alias("score")))
    return F.filter(near, lambda s: s["score"] >= THRESHOLD)


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``spans`` of every row: (kind, start, end, score) by kind as listed and then by start.

    Places count code points, ends are exclusive.  Null and empty texts have no spans.  Spans of different kinds may
    overlap.  Other columns are left out, so none can clash.
    """
    out = docs.select(*[F.col(c).alias(f"kept_{c}") for c in keep], F.translate(F.coalesce("text", F.lit("")), MARK, REPLACED).alias("clean"))
    out = out.select("*", *[_matches(F.col("clean"), k).alias(f"found_{k.name}") for k in KINDS])
    spans = F.concat(*[_scored(k, F.col(f"found_{k.name}")) for k in KINDS])
    return out.select(*[F.col(f"kept_{c}").alias(c) for c in keep], spans.alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts and spans per row of ``docs`` (doc_id, text): ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores``."""
    found = find(docs)
    def of(kind: str):
        return F.filter("spans", lambda s: s["kind"] == kind)

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
                        F.transform("spans", lambda s: s["score"]).alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """The columns of documents, with every span's text put as its kind in brackets and ``n_chars`` counted anew.

    Of overlapping spans the first (of equal starts the longest) is put.  Texts without spans, null ones too, stay as they are.
    """
    found = find(docs, DOCUMENTS)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("till"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        until = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        put = F.struct((-s["till"]).alias("at"), F.concat(acc["out"], until, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))
        return F.when(s["start"] >= acc["at"], put).otherwise(acc)

    text = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    changed = F.size("spans") > 0
    out = found.select("doc_id", F.when(changed, text).otherwise(F.col("text")).alias("text"), "lang", "source", "n_chars", changed.alias("changed"))
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))
