"""Civil dates from text (F4, F5, F6) and from instants."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tillbook.functions.let import cases, let
from tillbook.functions.money import SPACE, trimmed

# Month names, locale prefixes, confidences, year window.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
LONG_MONTHS = "january february march april may june july august september october november december".split()
MONTH_WORD = (
    "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?"
    "|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
MDY_LOCALES = r"^(en-us|en-ca|en_us|en_ca)"
YMD_LOCALES = r"^(ja|zh|ko|yue)"
DMY_LOCALES = r"^(en-gb|en-au|en-nz|en-ie|en_gb|de|fr|es|it|pt|nl|pl|sv|da|nb|fi|ru)"
FIRST_YEAR, LAST_YEAR = 1990, 2100
ISO_CONFIDENCE, NAMED_CONFIDENCE = 0.98, 0.95
NUMERIC_CONFIDENCE, AMBIGUOUS_CONFIDENCE, FORCED_CONFIDENCE = 0.9, 0.55, 0.92

EDGE_BEFORE, EDGE_AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
GAP = r"[\s ,/-]+"
ISO_SCAN = rf"{EDGE_BEFORE}(\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}){EDGE_AFTER}"
NAMED_SCAN = (
    rf"(?i){EDGE_BEFORE}(?:\d{{1,2}}(?:st|nd|rd|th)?{GAP}{MONTH_WORD}{GAP}\d{{2,4}}"
    rf"|{MONTH_WORD}{GAP}\d{{1,2}}(?:st|nd|rd|th)?{GAP}\d{{2,4}}){EDGE_AFTER}"
)
NUMERIC_SCAN = rf"{EDGE_BEFORE}(\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{2,4}}){EDGE_AFTER}"

FOUND_DATE = "struct<civil:date,confidence:double,ambiguous:boolean>"


def date_order(locale: Column) -> Column:
    """locale to field order; unknown or missing locales read month first."""
    low = F.lower(F.coalesce(locale, F.lit("")))
    return cases(
        (low.rlike(MDY_LOCALES), F.lit("MDY")),
        (low.rlike(YMD_LOCALES), F.lit("YMD")),
        (low.rlike(DMY_LOCALES), F.lit("DMY")),
        otherwise=F.lit("MDY"),
    )


def _civil(year: Column, month: Column, day: Column) -> Column:
    """A real day inside the accepted years, else null."""
    text = F.concat_ws(
        "-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")
    )
    sane = year.between(FIRST_YEAR, LAST_YEAR) & month.between(1, 12) & day.between(1, 31)
    return F.when(sane, text.try_cast("date"))


def _full_year(year: Column) -> Column:
    return F.when(year >= 100, year).when(year >= 80, year + 1900).otherwise(year + 2000)


def _found(civil: Column, confidence: Column | float, ambiguous: Column | bool = False) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(
        civil.isNotNull(),
        F.struct(
            civil.alias("civil"), as_column(confidence).alias("confidence"), as_column(ambiguous).alias("ambiguous")
        ),
    ).cast(FOUND_DATE)


def _groups(text: Column, pattern: str, n: int) -> Column:
    """All capture groups at once; numbers that do not parse are null."""
    return F.struct(*[F.regexp_extract(text, pattern, i + 1).alias(f"g{i + 1}") for i in range(n)])


def _number(text: Column) -> Column:
    return text.try_cast("int")


def _month_number(word: Column) -> Column:
    names = {**{m: i + 1 for i, m in enumerate(MONTHS)}, "sept": 9, **{m: i + 1 for i, m in enumerate(LONG_MONTHS)}}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, F.lower(word))


def _named(text: Column) -> Column:
    day_first = r"^(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]+)\s+(\d{2,4})$"
    month_first = r"^([A-Za-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?\s+(\d{2,4})$"
    spaced = trimmed(F.regexp_replace(text, r"[\s ,]+", " "))

    def read(s: Column) -> Column:
        def pick(pattern: str, day: int, month: int) -> Column:
            return let(
                _groups(s, pattern, 3),
                lambda g: _found(
                    _civil(_full_year(_number(g["g3"])), _month_number(g[f"g{month}"]), _number(g[f"g{day}"])),
                    NAMED_CONFIDENCE,
                ),
            )

        return F.when(s.rlike(day_first), pick(day_first, 1, 2)).when(s.rlike(month_first), pick(month_first, 2, 1))

    return let(spaced, read)


def _numeric(text: Column, order: Column) -> Column:
    pattern = r"^(\d{1,4})[-/.\s ]+(\d{1,2})[-/.\s ]+(\d{1,4})$"

    def read(g: Column) -> Column:
        a, b, c = (_number(g[f"g{i}"]) for i in (1, 2, 3))
        year_first = (F.length(g["g1"]) == 4) | ((order == "YMD") & (a > 31))
        ambiguous = (a <= 12) & (b <= 12) & (a != b)
        day_forced, month_forced = (a > 12) & (b <= 12), (b > 12) & (a <= 12)
        month_leads = month_forced | (~day_forced & (order == "MDY"))
        civil = _civil(_full_year(c), F.when(month_leads, a).otherwise(b), F.when(month_leads, b).otherwise(a))
        confidence = (
            F.when(ambiguous, AMBIGUOUS_CONFIDENCE)
            .when(day_forced | month_forced, FORCED_CONFIDENCE)
            .otherwise(NUMERIC_CONFIDENCE)
        )
        return F.when(year_first, _found(_civil(_full_year(a), b, c), NUMERIC_CONFIDENCE)).otherwise(
            _found(civil, confidence, ambiguous)
        )

    return F.when(text.rlike(pattern), let(_groups(text, pattern, 3), read))


def parse_date(raw: Column, order: Column | str = "MDY") -> Column:
    """a whole string as a civil date; struct(civil, confidence, ambiguous) or null."""
    order = F.lit(order) if isinstance(order, str) else order
    iso = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$"

    def read(text: Column) -> Column:
        return cases(
            (
                text.rlike(iso),
                let(
                    _groups(text, iso, 3),
                    lambda g: _found(_civil(_number(g["g1"]), _number(g["g2"]), _number(g["g3"])), ISO_CONFIDENCE),
                ),
            ),
            otherwise=F.coalesce(_named(text), _numeric(text, order)),
        )

    return let(trimmed(raw), read)


def find_date(text: Column, order: Column | str = "MDY") -> Column:
    """most certain date in free text; certain over ambiguous, ISO over named over numeric."""
    scans = [(ISO_SCAN, 1), (NAMED_SCAN, 0), (NUMERIC_SCAN, 1)]
    candidates = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in scans])

    def scored(candidate: Column, at: Column) -> Column:
        return let(
            parse_date(candidate, order),
            lambda d: F.when(
                d.isNotNull(),
                F.struct(
                    d["confidence"].alias("confidence"),
                    (~d["ambiguous"]).alias("certain"),
                    (-at).alias("earlier"),
                    d["civil"].alias("civil"),
                ),
            ),
        )

    return let(
        F.array_max(F.transform(candidates, scored)),
        lambda b: F.when(
            b.isNotNull(),
            F.struct(b["civil"].alias("civil"), b["confidence"].alias("confidence"), (~b["certain"]).alias("ambiguous")),
        ),
    ).cast(FOUND_DATE)


def civil_day(instant_ms: Column) -> Column:
    """UTC day of an epoch-millisecond instant, independent of the session zone."""
    return F.date_from_unix_date(F.floor(instant_ms / F.lit(86400000)).cast("int"))
