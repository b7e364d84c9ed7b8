"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

Only DataFrame functions.  A kind's pattern is wrapped in marks by
``regexp_replace``, the marked text is split, and the lengths of the parts give
the places.  Patterns are written so that matching is linear in the text: a
match starts only where a run of its characters starts (or where the match
before ended), and runs are taken whole.  Each pattern runs only on texts that
hold a character without which it cannot match.

Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches
that pass their check.  Added kinds: ``iban``, confirmed by its remainder
modulo 97, and ``idnum``, a nine-digit number in groups of 3-2-4.  Every span
has a score: the kind's prior, more by ``CONTEXT_GAIN`` if one of the kind's
context words stands within ``CONTEXT_CHARS`` characters before it.  An added
span counts from a score of ``THRESHOLD`` on; base spans always count.

Places are code points, the end exclusive.  Running sums over the parts of a
text are made in blocks of ``BLOCK``, and texts are sliced from pieces of
``PIECE`` characters, so that a text with very many matches costs in proportion.

Defined cases: a null or empty text has no spans, and a null text stays null
when redacted; equal rows give equal results; other columns are ignored; an
empty table gives no rows.  One row's work is bounded by its text; there is no
shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "\u0001"
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.4
THRESHOLD = 0.7
BLOCK = 256
PIECE = 1000


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str
    prior: float
    context: tuple[str, ...]
    base: bool = True


_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.95, ("mail", "contact")),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]\\.[0-9]", 0.6, ("ip", "host", "server")),
    # A run of digits with single separators, taken whole if it has 12 to 19 digits.
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])", "[0-9][0-9\\x20-]{10}", 0.8, ("card", "visa", "credit")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]", 0.7, ("phone", "call", "tel")),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", 0.9, ("iban", "account", "bank"), False),
    Kind("idnum", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]", 0.4, ("ssn", "social", "passport", "id"), False),
)
BASE = tuple(k for k in KINDS if k.base)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(
        F.split(F.reverse(number), ""),
        lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")),
    )
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(number: Column) -> Column:
    """Whether an account number (letters and digits) leaves 1 modulo 97 with its head moved to the end."""
    turned = F.concat(F.substring(number, 5, 99), F.substring(number, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(value(c) > 9, a * 100 + value(c)).otherwise(a * 10 + value(c)) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    n = F.length(digits(match))
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.rpad(p, 3, "x").rlike("x") | (p <= "255")))
    if kind == "card":
        return n.between(12, 19) & luhn(digits(match))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        bare = F.replace(match, F.lit(" "), F.lit(""))
        return F.length(bare).between(15, 34) & mod97(bare)
    return F.lit(True)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though lambdas use it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks(items: Column) -> Column:
    """An array in slices of ``BLOCK``."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, BLOCK))


def running(numbers: Column) -> Column:
    """Of an array of numbers (one at least) the sums up to each."""
    sums = lambda xs: F.aggregate(xs, F.array().cast("array<int>"), lambda a, x: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x))
    inside = lambda xs: F.transform(blocks(xs), sums)

    def shifted(parts: Column) -> Column:
        ends = sums(F.transform(parts, lambda p: F.element_at(p, -1)))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, k: F.transform(p, lambda x: x + F.when(k == 0, 0).otherwise(F.get(e, k - 1))))))

    return let(numbers, lambda xs: let(inside(xs), shifted))


def proposed(kind: Kind, text: Column) -> Column:
    """Array of (start, end, match, before) of all matches of a kind."""
    # The mark stands for no character of any pattern, so another such character may take its place.
    clean = F.replace(text, F.lit(MARK), F.lit("\u0002"))
    parts = F.split(F.regexp_replace(clean, kind.pattern, MARK + "$0" + MARK), MARK, -1)

    def spans(parts: Column, ends: Column) -> Column:
        # Every second part is a match.
        one = lambda k: F.struct(
            F.get(ends, 2 * k).alias("start"),
            F.get(ends, 2 * k + 1).alias("end"),
            F.get(parts, 2 * k + 1).alias("match"),
            F.lower(F.right(F.get(parts, 2 * k), F.lit(CONTEXT_CHARS))).alias("before"),
        )
        every = F.transform(F.sequence(F.lit(0), (F.size(parts) / 2).cast("int") - 1), one)
        return F.filter(every, lambda m: confirmed(kind.name, m["match"]))

    none = F.array().cast("array<struct<start:int,end:int,match:string,before:string>>")
    told = lambda ps: F.when(F.size(ps) > 1, let(running(F.transform(ps, F.length)), lambda ends: spans(ps, ends))).otherwise(none)
    return F.when(text.rlike(kind.needs), let(parts, told)).otherwise(none)


def scored(kind: Kind, rank: int):
    near = "(?<![a-z])(?:" + "|".join(kind.context) + ")"

    def span(m: Column) -> Column:
        gain = F.when(m["before"].rlike(near), CONTEXT_GAIN).otherwise(0.0)
        return F.struct(
            m["start"].alias("start"),
            F.lit(rank).alias("rank"),
            m["end"].alias("end"),
            F.lit(kind.name).alias("kind"),
            F.least(F.lit(1.0), F.lit(kind.prior) + gain).alias("score"),
            F.lit(kind.base).alias("base"),
        )

    return span


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds=KINDS, keep: list[str] = ()) -> DataFrame:
    """The id, the text, columns to keep and ``found``: spans (start, end, kind, score, base) in order.

    Order: by start, then by the order of kinds.
    """
    given = df.select(F.col(id_col), *keep, text_col)
    each = []
    for rank, kind in enumerate(kinds):
        spans = F.transform(proposed(kind, F.coalesce(F.col(text_col), F.lit(""))), scored(kind, rank))
        each.append(spans if kind.base else F.filter(spans, lambda s: s["score"] >= THRESHOLD))
    return given.withColumn("found", F.array_sort(F.concat(*each)))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace every span of :func:`find` by its kind in brackets; of overlapping spans, the first."""
    text = F.col(text_col)
    gaps = "array<struct<from:int,to:int,kind:string>>"

    def step(a: Column, s: Column) -> Column:
        gap = F.struct(a["at"].alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))
        new = F.when(s["start"] >= a["at"], F.array_append(a["gaps"], gap)).otherwise(a["gaps"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), new.alias("gaps"))

    def block(a: Column, spans: Column) -> Column:
        own = F.aggregate(spans, F.struct(a["at"].alias("at"), F.array().cast(gaps).alias("gaps")), step)
        return let(own, lambda x: F.struct(x["at"].alias("at"), F.array_append(a["gaps"], x["gaps"]).alias("gaps")))

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        """Characters from ``a`` to ``b``."""
        first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
        head = F.substring(F.get(pieces, first), a % PIECE + 1, F.when(first == last, b - a).otherwise(PIECE))
        middle = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        tail = F.when(first < last, F.substring(F.get(pieces, last), F.lit(1), (b - 1) % PIECE + 1)).otherwise("")
        return F.when(a < b, F.concat(head, middle, tail)).otherwise("")

    def joined(pieces: Column, done: Column) -> Column:
        shown = F.transform(F.flatten(done["gaps"]), lambda g: F.concat(cut(pieces, g["from"], g["to"]), F.lit("["), g["kind"], F.lit("]")))
        return F.concat(F.array_join(shown, ""), cut(pieces, done["at"], F.length(text)))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{gaps}>").alias("gaps"))
    done = F.aggregate(blocks(F.col("found")), start, block)
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    out = let(pieces, lambda p: let(done, lambda d: joined(p, d)))
    return found.withColumn(text_col, F.when(F.size("found") > 0, out).otherwise(text))


def counts(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Numbers of base spans by kind, a digest of the base spans, and all spans written out."""
    base = F.filter("found", lambda s: s["base"])

    def number(kind: Kind) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind.name)).cast("long").alias(f"n_{kind.name}")

    return found.select(
        id_col,
        *map(number, BASE),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )
