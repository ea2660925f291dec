"""Personal data by patterns, checksums and context, in DataFrame functions only.

Patterns propose spans, checks confirm them (number ranges, digit counts, Luhn, mod-97), and words
close by move a span's score. The kinds ``email``, ``ip``, ``card`` and ``phone`` are the base: all
their confirmed matches stay, whatever their score. ``iban``, ``ssn`` and ``account`` are added where
their score reaches the threshold.

The places of matches follow from what lies between them: splitting a text by a pattern gives the
gaps, extracting gives the matches, and running sums of both lengths give each start.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import doc_columns

NEAR = 40  # characters on either side in which context words count
THRESHOLD = 0.5  # least score of an added span
BLOCK = 64  # running sums are made in blocks, so that a text with many matches costs little more a match
CUT = 4096  # code points of a piece that redaction cuts from

# Possessive quantifiers and look-behinds leave the leftmost matches as they are and keep long runs linear:
# inside a run of a pattern's first class no later start can match where the run's start could not.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# whole runs of digits with single separators, of so many digits
RUN = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){%d,%d}+(?![\x20-]?[0-9])"
CARD, ACCOUNT = RUN % (15, 18), RUN % (12, 14)
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check of a string of digits: from the right, every second digit counts twice, less 9 above 9."""
    back = F.reverse(digits)

    def add(total: Column, k: Column) -> Column:
        d = back.substr(k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """The remainder check of account numbers: first four signs to the end, letters as 10 to 35, remainder 1."""
    plain = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    turned = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(1, 4))

    def add(rest: Column, k: Column) -> Column:
        c = F.ascii(turned.substr(k, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def digits_between(low: int, high: int):
    return lambda v: F.length(digits_of(v)).between(low, high)


def card_check(low: int, high: int):
    """So many digits that pass Luhn's check."""
    return lambda v: F.when(digits_between(low, high)(v), luhn(digits_of(v))).otherwise(F.lit(False))


def ssn_check(v: Column) -> Column:
    return ~v.rlike(r"^(?:000|666|9..)|-00-|-0000$")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str  # a text without this pattern cannot match
    check: object
    score: float
    raised_by: str  # context words that add to the score
    lowered_by: str  # context words that take from it
    base: bool = False


KINDS = (
    Kind("email", EMAIL, "@", lambda v: F.lit(True), 0.95, "mail|contact|write|kontakt|correo|courriel", "example", True),
    Kind("ip", IP, r"[0-9]\.[0-9]", lambda v: v.rlike(rf"^{PART}(?:\.{PART}){{3}}$"), 0.6,
         "ip|host|address|server|adresse", "version|release|section|chapter", True),
    Kind("card", CARD, "[0-9]", card_check(16, 19), 0.8, "card|visa|credit|payment|karte|carte|tarjeta", "isbn|serial|order", True),
    Kind("phone", PHONE, r"\+[0-9]", digits_between(8, 15), 0.7, "phone|tel|call|mobile|fax|telefon|llame", "version|serial", True),
    Kind("iban", IBAN, "[A-Z]{2}[0-9]{2}", mod97, 0.8, "iban|bank|account|konto|compte|cuenta", "serial|part"),
    Kind("ssn", SSN, "[0-9]-[0-9]{2}-[0-9]", ssn_check, 0.3, "ssn|social security|taxpayer", "isbn|serial|phone"),
    Kind("account", ACCOUNT, "[0-9]", card_check(13, 15), 0.3, "card|visa|amex|credit|payment", "isbn|serial|order"),
)
SPANS = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"
BASE = tuple(k.name for k in KINDS if k.base)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often and deep in lambdas it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column) -> Column:
    """Sums of the elements up to each place, in two levels of blocks."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def in_blocks(xs: Column) -> Column:
        n_blocks = F.floor((F.size(xs) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), n_blocks), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))

    def joined(blocks: Column) -> Column:
        starts = F.aggregate(F.transform(blocks, total), F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        within = lambda block, start: F.transform(block, lambda _, k: start + total(F.slice(block, F.lit(1), k + 1)))
        return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), within))

    return let(let(values, in_blocks), joined)


def running_maxima(values: Column) -> Column:
    """Greatest of the elements up to each place, in two levels of blocks. ``values`` are at least 0, and not empty."""

    def in_blocks(xs: Column) -> Column:
        last = F.floor((F.size(xs) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))

    def joined(blocks: Column) -> Column:
        before = lambda tops: F.transform(tops, lambda _, k: F.coalesce(F.array_max(F.slice(tops, F.lit(1), k)), F.lit(0)))
        within = lambda block, least: F.transform(block, lambda _, k: F.greatest(least, F.array_max(F.slice(block, F.lit(1), k + 1))))
        return F.flatten(F.zip_with(blocks, let(F.transform(blocks, F.array_max), before), within))

    return let(let(values, in_blocks), joined)


def with_spans(df: DataFrame, text: str, kind: Kind, to: str) -> DataFrame:
    """Add the confirmed spans of one kind as an array column."""
    hits, gaps = f"{to}_hits", f"{to}_gaps"
    none = F.array().cast("array<string>")
    df = df.withColumn(hits, F.when(F.col(text).rlike(kind.gate), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.split(text, kind.pattern, -1)).otherwise(none))
    n = F.size(hits)
    before, after = F.slice(F.col(gaps), F.lit(1), n), F.slice(F.col(gaps), F.lit(2), n)
    # a match starts after the gaps up to it and the matches before it
    earlier = F.slice(F.concat(F.array(F.lit("")), F.col(hits)), F.lit(1), n)
    starts = running_sums(F.zip_with(before, earlier, lambda g, h: F.length(g) + F.length(h)))

    def span(x: Column) -> Column:
        near = F.lower(F.concat(F.right(x["before"], F.lit(NEAR)), F.lit(" "), F.left(x["after"], F.lit(NEAR))))
        word = lambda words: near.rlike(rf"(?<![a-z])(?:{words})")
        score = F.lit(kind.score) + F.when(word(kind.raised_by), 0.3).otherwise(0.0) - F.when(word(kind.lowered_by), 0.3).otherwise(0.0)
        return F.struct(
            F.lit(kind.name).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value"),
            F.when(kind.check(x["value"]), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 2)).alias("score"),
        )

    zipped = F.arrays_zip(F.col(hits).alias("value"), starts.alias("start"), before.alias("before"), after.alias("after"))
    least = F.lit(0.0 if kind.base else THRESHOLD)
    spans = F.filter(F.transform(zipped, span), lambda s: F.coalesce(s["score"], F.lit(-1.0)) >= least)
    return df.withColumn(to, F.when(n > 0, spans).otherwise(F.array().cast(SPANS))).drop(hits, gaps)


def find_pii(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every whole text: ``doc_id, text, spans``, the spans by kind in the
    order of ``KINDS`` and then by start: (kind, start, end, value, score), in code points, end exclusive.

    One row per input row. A null or empty text has no spans; a null doc_id stays null; equal rows
    give equal rows; an empty table gives an empty one; other columns of ``docs`` play no part.
    Spans of different kinds may overlap. Nothing is shuffled."""
    df = doc_columns(docs)
    for k in KINDS:
        df = with_spans(df, "text", k, f"spans_{k.name}")
    return df.select("doc_id", "text", F.concat(*[F.col(f"spans_{k.name}") for k in KINDS]).alias("spans"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``."""
    said = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("bigint").alias(f"n_{name}")
    return find_pii(docs).select(
        "doc_id", *[count(n) for n in BASE], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("bigint").alias("n_added"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data in ``text`` replaced by its kind in square brackets;
    overlapping spans become one, named after the first. All columns stay, whatever their names; a null text
    stays null, an empty one empty; rows that repeat change alike; an empty table stays empty; ``n_chars``, where
    there is such a column, becomes the new length. Texts are taken whole, and cut
    from pieces of CUT code points, so that a cut's work does not grow with its place in the text."""
    own = "__"
    while any(c.lower().startswith(own) for c in docs.columns):  # names that the table does not have
        own += "_"
    df = docs.withColumn(f"{own}text", F.coalesce(docs["text"].cast("string"), F.lit("")))
    for k in KINDS:
        df = with_spans(df, f"{own}text", k, f"{own}{k.name}")
    spans = F.array_sort(F.transform(F.concat(*[F.col(f"{own}{k.name}") for k in KINDS]), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    text, held, reach, pieces = (F.col(f"{own}{x}") for x in ("text", "spans", "reach", "pieces"))
    df = df.withColumn(f"{own}spans", spans)
    ends = F.transform(held, lambda s: s["end"])
    df = df.withColumn(f"{own}reach", F.when(F.size(held) > 0, running_maxima(ends)).otherwise(F.array().cast("array<int>")))
    df = df.withColumn(f"{own}pieces", F.when(F.size(held) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))))

    def cut(lo: Column, hi: Column) -> Column:
        at, to = F.floor(lo / CUT).cast("int"), F.ceil(hi / CUT).cast("int")
        return F.array_join(F.slice(pieces, at + 1, F.greatest(to - at, F.lit(0))), "").substr(lo - at * CUT + 1, hi - lo)

    # spans that begin before an earlier one ends add to it
    zipped = F.arrays_zip(held.alias("span"), F.slice(F.concat(F.array(F.lit(0)), reach), F.lit(1), F.size(held)).alias("at"))
    first = F.filter(zipped, lambda x: x["span"]["start"] >= x["at"])
    part = lambda x: F.concat(cut(x["at"], x["span"]["start"]), F.lit("["), F.upper(x["span"]["kind"]), F.lit("]"))
    tail = cut(F.element_at(reach, -1), F.length(text))
    new = F.when(F.size(held) > 0, F.concat(F.array_join(F.transform(first, part), ""), tail)).otherwise(F.col("text"))
    cols = [new.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    out = df.select(*cols)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
