"""Personal data in SQL functions alone: patterns propose spans, checksums confirm them, context words score them.

Per kind, matches are taken leftmost and without overlap.  Their places follow from the gaps between matches,
so positions cost no search; running sums go by blocks of about the square root of the matches, so a text with
very many of them stays cheap.  The patterns are written with possessive repeats and start conditions that do
not change what matches but keep the engine linear on long runs of letters or digits.

Base kinds: ``email``; ``ip`` with parts up to 255; ``card`` of 14 to 19 digits passing Luhn; ``phone`` of 10 to 15
digits.  A span that fails its check is dropped, without another try.  Added kinds: ``iban`` passing mod-97, of its
country's length or else of the longest that passes; and ``ssn``, which has no checksum and so counts only with a
context word beside it.  A span's score is its kind's own plus ``CONTEXT`` when one of the kind's words, as a whole
word, stands within ``REACH`` characters in the gap on either side;
added spans need ``threshold``, base spans always stay.

Defined cases: a null text is empty and has no spans; repeated rows and null ids give one row each; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REACH = 40
CONTEXT = 0.4
#: Characters of an account number by the country that it starts with.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_CODES = "|".join(LENGTHS.values()).replace(" ", "|")


def _of_length(n: int, codes: str) -> str:
    fours, rest = divmod(n - 4, 4)
    return rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{fours}}}" + (rf"\x20?[A-Z0-9]{{{rest}}}" if rest else "")


#: The length of the country if it ends there, else any; an account number of any length stops before a blank and the start of another.
IBAN = (
    r"(?=[A-Z]{2}[0-9]{2})(?:(?:" + "|".join(_of_length(n, c) for n, c in LENGTHS.items()) + r")(?![A-Z0-9])"
    rf"|[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20(?:{_CODES})[0-9]{{2}})\x20?[A-Z0-9]{{4}}){{3,7}}(?:\x20?[A-Z0-9]{{1,3}})?)"
)
#: kind, pattern, condition of a cheap first look, own score, context words
KINDS: list[tuple[str, str, str, float, str]] = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')", 0.6, "e-?mail|mail|contact|write"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "contains(t, '.')", 0.4, "ip|server|host|login"),
    ("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])", "true", 0.6, "card|cards|visa|credit|pay"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(t, '+')", 0.5, "telephone|phone|tel|call|mobile|fax"),
    ("iban", IBAN, "true", 0.6, "iban|bank|account"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "contains(t, '-')", 0.3, "ssn|social|security"),
]
BASE = ("email", "ip", "card", "phone")
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_DIGIT = "cast(substring(d, length(d) - i + 1, 1) as int)"
_LUHN = f"aggregate(sequence(1, length(d)), 0, (a, i) -> a + {_DIGIT} * (1 + (i + 1) % 2) - if(i % 2 = 0 and {_DIGIT} > 4, 9, 0)) % 10 = 0"
_CODE = "ascii(substring(d, i, 1))"
_MOD97 = f"aggregate(sequence(1, length(d)), 0, (a, i) -> if({_CODE} < 58, (a * 10 + {_CODE} - 48) % 97, (a * 100 + {_CODE} - 55) % 97)) = 1"


def _on(name: str, value: str, expression: str) -> str:
    """``expression`` with ``name`` bound to ``value``."""
    return f"element_at(transform(array({value}), {name} -> {expression}), 1)"


def confirmed(kind: str, match: str) -> str:
    """SQL condition that a match of this kind passes its check."""
    digits = f"regexp_replace({match}, '[^0-9]', '')"
    if kind == "ip":
        return f"{match} rlike '^{_PART}([.]{_PART}){{3}}$'"
    if kind == "card":
        return _on("d", digits, _LUHN)
    if kind == "phone":
        return f"length({digits}) between 10 and 15"
    if kind == "iban":
        return f"{_iban_length(match)} > 0"
    return "true"


def _iban_length(match: str) -> str:
    """SQL for the characters of the longest start of a match that ends before no letter or digit and passes mod-97, else 0."""
    passes = _on("s", "replace(left(m, n), ' ', '')", _on("d", "concat(substring(s, 5), substring(s, 1, 4))", _MOD97))
    ends = "filter(sequence(length(m), 15, -1), n -> substring(m, n, 1) <> ' ' and substring(m, n + 1, 1) in ('', ' '))"
    return _on("m", match, f"coalesce(get(filter({ends}, n -> {passes}), 0), 0)")


def whole_words(words: str) -> str:
    """Pattern for any of the words in lower-cased text, not inside another word."""
    return f"(^|[^a-z0-9])({words})([^a-z0-9]|$)"


def running_sums(steps: str) -> str:
    """SQL for the sum of the steps before each step of an array of longs, in blocks of about its square root."""
    total = "aggregate({}, 0L, (a, x) -> a + x)"
    blocks = "transform(sequence(0, cast((size(s) - 1) / w as int)), k -> " + total.format("slice(s, k * w + 1, w)") + ")"
    ahead = _on("b", blocks, "transform(b, (x, k) -> " + total.format("slice(b, 1, k)") + ")")
    each = "transform(s, (x, i) -> get(h, cast(floor(i / w) as int)) + " + total.format("slice(s, cast(floor(i / w) as int) * w + 1, i % w)") + ")"
    return _on("s", steps, f"if(size(s) = 0, cast(array() as array<bigint>), {_on('w', 'greatest(1, cast(sqrt(size(s)) as int))', _on('h', ahead, each))})")


def find_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id, found``: an array of ``(start, rank, stop, kind, score)`` in order of start and kind, in code points."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), t.alias("t"))
    none = "cast(array() as array<string>)"
    lit = lambda p: "r'" + p + "'"
    df = df.select("doc_id", "t", *[F.expr(f"if({first}, regexp_extract_all(t, {lit(p)}, 0), {none}) as m_{kind}") for kind, p, first, _, _ in KINDS])
    df = df.select("doc_id", *[F.col(f"m_{k[0]}") for k in KINDS], *[
        F.expr(f"if(size(m_{kind}) > 0, split(t, {lit(p)}, -1), {none}) as g_{kind}") for kind, p, _, _, _ in KINDS])
    df = df.select("*", *[F.expr(running_sums(f"transform(m_{k[0]}, (m, i) -> cast(length(m) + length(get(g_{k[0]}, i)) as bigint))") + f" as o_{k[0]}") for k in KINDS])
    return df.select("doc_id", F.array_sort(F.concat(*[_scored(i, k, threshold) for i, k in enumerate(KINDS)])).alias("found"))


def _scored(rank: int, of: tuple[str, str, str, float, str], threshold: float) -> Column:
    kind, _, _, own, words = of
    m, g, o = f"get(m_{kind}, i)", f"get(g_{kind}, i)", f"get(o_{kind}, i)"
    after, size = f"get(g_{kind}, i + 1)", f"length({m})"
    if kind == "iban":
        size = _iban_length(m)
        after = f"concat(substring({m}, {size} + 1), {after})"
    beside = f"lower(concat(right({g}, {REACH}), ' ', left({after}, {REACH}))) rlike '{whole_words(words)}'"
    ok = confirmed(kind, m)
    if kind == "ssn":
        ok = f"not (right({g}, 1) rlike '[0-9-]') and not (left({after}, 1) rlike '[0-9-]')"
    score = f"{own}D + if({beside}, {CONTEXT}D, 0D)"
    if kind not in BASE:
        ok = f"({ok}) and {score} >= {threshold}D"
    places = f"filter(transform(m_{kind}, (m, i) -> i), i -> {ok})"
    span = f"{o} + length({g})"
    return F.expr(f"transform({places}, i -> struct({span} as start, {rank} as rank, {span} + {size} as stop, '{kind}' as kind, {score} as score))")


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans of each document."""
    joined = lambda spans: f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.stop)), ',')"
    count = lambda kind: F.expr(f"cast(size(filter(found, x -> x.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.expr(f"sha2({joined(f'filter(found, x -> x.rank < {len(BASE)})')}, 256)").alias("base_sha256"),
        F.expr(joined("found")).alias("spans"),
        count("iban"),
        count("ssn"),
        F.expr("coalesce(array_max(transform(found, x -> x.score)), 0D)").alias("max_score"),
    )
