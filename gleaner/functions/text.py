"""Text and date functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"([\p{L}\p{N}_]+)"
SNIPPET_CHARS = 400
#: Month names that make a question temporal ("may" is left out, it is mostly a verb).
MONTHS = ["january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december"]
PERIOD = (
    r"(?iU)\b(?:(?:19|20)\d\d|q[1-4]|" + "|".join(MONTHS) + r"|since|until|before|after|between|during"
    r"|(?:last|this|past|previous)\s+(?:\d+\s+)?(?:day|week|month|quarter|year)s?)\b"
)
POINTS_AT_SOURCE = r"(?iU)\b(?:this|the|that)\s+(?:article|text|passage|document|report|piece|story|excerpt)\b"


def text_of(column: Column, kind: T.DataType) -> Column:
    """The text of a record: paragraphs joined by a blank line, null as empty."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.array_join(column, "\n\n"), F.lit(""))
    return F.coalesce(column.cast("string"), F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-cased Unicode words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))


def collapse(text: Column) -> Column:
    """Blank runs to one space, trimmed, case folded; null as empty.

    Folding is lower case with sharp s as ss; a few rarer foldings (such as final sigma) stay apart.
    """
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.replace(F.lower(spaced), F.lit("ß"), F.lit("ss"))


def collapse_statement(text: Column) -> Column:
    """``collapse`` without final full stops, for comparing rationales with criteria."""
    return F.regexp_replace(collapse(text), r"\.+$", "")


def published(date: Column) -> Column:
    """The date in the first ten characters, null when there is none."""
    head = F.substring(F.trim(date.cast("string")), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def snippet(text: Column, size: int = SNIPPET_CHARS) -> Column:
    return F.substring(text, 1, size)


def clip(text: Column, size: int, *, trim: bool = True) -> Column:
    """Text cut to ``size`` characters with an ellipsis when it is longer."""
    head = F.substring(text, 1, size)
    return F.when(F.length(text) > size, F.concat(F.rtrim(head) if trim else head, F.lit(" …"))).otherwise(text)


def names_a_period(question: Column) -> Column:
    return F.coalesce(question.rlike(PERIOD), F.lit(False))


def points_at_source(question: Column) -> Column:
    return F.coalesce(question.rlike(POINTS_AT_SOURCE), F.lit(False))


def strip_reasoning(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def statement_pieces(line: Column) -> Column:
    """Sentences of a line: cut after . ! ? with or without a closing quote or bracket."""
    return F.split(line, r"(?<=[.!?])\s+|(?<=[.!?][\"'”’)\]])\s+")


def list_literal(text: Column) -> Column:
    """A cell that is a list literal (JSON or Python quoting) as an array of strings, null when it is not one."""
    body = F.trim(text)
    listed = F.from_json(body, "array<string>")
    return F.when(body.rlike(r"(?s)^\[.*\]$") & ~body.rlike(r"(?s)^\[\s*\{"), listed)


def describe_fact(subject: Column, subject_type: Column, relation: Column, object_: Column, object_type: Column, date: Column) -> Column:
    """``Subject [Type] --relation--> Object [Type] (date)`` without the parts that are blank."""
    optional = lambda before, c, after: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    return F.concat(
        subject, optional(" [", subject_type, "]"), F.lit(" --"), relation, F.lit("--> "), object_, optional(" [", object_type, "]"), optional(" (", date, ")")
    )


CITATION_GROUP = r"\[\s*[SG]\d+(?:\s*[,;]\s*[SG]\d+)*\s*\]"


def extract_citations(answer: Column) -> Column:
    """Distinct labels such as S1 and G2 in order of first appearance."""
    groups = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(f"({CITATION_GROUP})"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"([SG]\d+)"), F.lit(1)))))


def link_citations(answer: Column, urls: Column) -> Column:
    """Citation groups as Markdown links, by a map from label to URL; labels without one stay as they are."""
    pattern = f"({CITATION_GROUP})"
    groups = F.regexp_extract_all(answer, F.lit(pattern), F.lit(1))
    gaps = F.split(answer, CITATION_GROUP, -1)

    def linked(group: Column) -> Column:
        labels = F.regexp_extract_all(group, F.lit(r"([SG]\d+)"), F.lit(1))
        one = lambda s: F.concat(F.lit("["), s, F.lit("]"), F.coalesce(F.concat(F.lit("("), F.try_element_at(urls, s), F.lit(")")), F.lit("")))
        return F.array_join(F.transform(labels, one), "")

    pieces = F.zip_with(gaps, groups, lambda gap, group: F.concat(gap, F.coalesce(linked(group), F.lit(""))))
    return F.array_join(pieces, "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_totals(steps: Column) -> Column:
    """The total of the longs before each element of an array, by blocks of about the square root of its size."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def by_blocks(s: Column, w: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / w).cast("int")), lambda k: total(F.slice(s, k * w + 1, w)))
        ahead = let(sums, lambda b: F.transform(b, lambda _, k: total(F.slice(b, F.lit(1), k))))
        return let(ahead, lambda h: F.transform(s, lambda _, i: F.get(h, F.floor(i / w).cast("int")) + total(F.slice(s, F.floor(i / w).cast("int") * w + 1, i % w))))

    width = lambda s: F.greatest(F.lit(1), F.sqrt(F.size(s)).cast("int"))
    return let(steps, lambda s: F.when(F.size(s) > 0, let(width(s), lambda w: by_blocks(s, w))).otherwise(F.array().cast("array<bigint>")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers in double precision; null when either is zero or the sizes differ."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, p: s + p * p))
    return F.when(F.size(x) == F.size(y), dot / F.nullif(norm(x) * norm(y), F.lit(0.0)))
