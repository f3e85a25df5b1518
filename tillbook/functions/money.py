"""Money text to integer minor units and back (F1, F2, F3, F14, F15).  Never floats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tillbook.functions.let import cases, let

# Patterns, symbols and confidences that decide the result.
SPACE = r"[\s ]"
US_GROUPED = r"^\d{1,3}(,\d{3})+(\.\d+)?$"
TYPED_AMOUNT = r"^\d+(\.\d{1,2})?$"
MONEY_TOKEN = (
    r"[(]?[-−–—]?[\s ]*[$€£S]?[\s ]*"
    r"(?:\d{1,3}(?:[.,]\d{3})+[.,]\d{2}|\d+[.,]\d{2}|\d{1,3}(?:[.,]\d{3})+|\d+)"
    r"[\s ]*[-−–—)]?"
)
CURRENCY_WORD = r"(?i)(?<![A-Za-z0-9_])(?:USD|CAD|EUR|GBP|AUD|NZD)(?![A-Za-z0-9_])"
CURRENCY_SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "CAD": "CA$", "AUD": "A$"}
MAX_SAFE_INTEGER = 9007199254740991

MONEY = "struct<minor:bigint,confidence:double>"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def parse_money_text(text: Column) -> Column:
    """typed money; struct(minor, error).  Blank clears the field: both parts null."""
    compact = F.regexp_replace(text, r"[\s $€£¥]", "")
    wrapped = compact.rlike(r"^\(.*\)$")
    bare = F.regexp_replace(compact, r"^\((.*)\)$", "$1")
    unsigned = F.regexp_replace(bare, r"^\+?-?", "")
    negative = wrapped != bare.rlike(r"^\+?-")
    plain = F.when(unsigned.rlike(US_GROUPED), F.replace(unsigned, F.lit(","), F.lit(""))).otherwise(unsigned)

    def read(value: Column) -> Column:
        digits = F.concat(
            F.substring_index(value, ".", 1),
            F.rpad(F.regexp_extract(value, r"\.(\d{1,2})$", 1), 2, "0"),
        )
        minor = F.when(value.rlike(TYPED_AMOUNT), digits.try_cast("bigint"))
        return F.when(minor <= MAX_SAFE_INTEGER, minor)

    blank = text.isNull() | (trimmed(text) == "")
    return let(
        read(plain),
        lambda minor: F.struct(
            F.when(~blank, F.when(negative, -minor).otherwise(minor)).alias("minor"),
            F.when(~blank & minor.isNull(), F.concat(F.lit("invalid amount: "), text)).alias("error"),
        ),
    )


def _amount(whole: Column, cents: Column | str, confidence: float) -> Column:
    cents = F.lit(cents) if isinstance(cents, str) else cents
    minor = F.concat(whole, cents).try_cast("bigint")
    return F.when(minor.isNotNull(), F.struct(minor.alias("minor"), F.lit(confidence).alias("confidence")))


def _read_separated(text: Column) -> Column:
    """Digits with one kind of separator, already unified to a dot; ``,`` or ``.`` originally."""
    t = F.translate(text, ",", ".")
    comma = text.contains(",")
    digits = F.replace(t, F.lit("."), F.lit(""))
    head, tail = F.regexp_replace(t, r"\.\d*$", ""), F.substring_index(t, ".", -1)
    pair = t.rlike(r"^\d*\.\d*$")
    head_digits = F.replace(head, F.lit("."), F.lit(""))
    return cases(
        (
            t.rlike(r"^\d*\.\d{2}$"),
            F.when(head != "", F.when(comma, _amount(head, tail, 0.85)).otherwise(_amount(head, tail, 0.95))),
        ),
        (t.rlike(r"^\d{0,3}\.\d{3}$"), _amount(digits, "00", 0.7)),
        (t.rlike(r"^\d{1,3}(\.\d{3})+$"), _amount(digits, "00", 0.75)),
        (F.length(tail) == 2, F.when(head_digits != "", _amount(head_digits, tail, 0.7))),
        (
            ~comma & pair & (F.length(tail) == 1),
            F.when(head != "", _amount(head, F.concat(tail, F.lit("0")), 0.6)),
        ),
        otherwise=_amount(digits, "00", 0.55),
    )


def _read_amount(text: Column, labelled: bool) -> Column:
    us = text.rlike(r"^[\d,.]*,[\d,.]*\.[^,]*$")
    whole_us = F.replace(F.regexp_extract(text, r"^(.*)\.", 1), F.lit(","), F.lit(""))
    whole_eu = F.replace(F.regexp_extract(text, r"^(.*),", 1), F.lit("."), F.lit(""))
    cents = F.rpad(F.regexp_extract(text, r"[.,](\d*)$", 1), 2, "0")
    both = text.contains(",") & text.contains(".")
    whole = F.when(us, whole_us).otherwise(whole_eu)
    bare = (
        _amount(text, "00", 0.6)
        if labelled
        else F.when(
            F.length(text) >= 3,
            F.struct(text.try_cast("bigint").alias("minor"), F.lit(0.5).alias("confidence")),
        ).otherwise(_amount(text, "00", 0.45))
    )
    return cases(
        (both, F.when(whole.rlike(r"^\d+$") & text.rlike(r"[.,]\d{1,2}$"), _amount(whole, cents, 0.95))),
        (text.contains(",") | text.contains("."), _read_separated(text)),
        otherwise=bare,
    )


def parse_money_ocr(raw: Column, labelled: bool = False) -> Column:
    """one OCR token or phrase; struct(minor, confidence) or null."""
    dashed = F.translate(trimmed(raw), "−–—", "---")
    words_off = F.regexp_replace(F.translate(dashed, "€£¥₹", ""), CURRENCY_WORD, "")
    # An S in front of a digit is a misread dollar sign.
    plain = trimmed(F.replace(F.regexp_replace(words_off, r"S(?=\d)", ""), F.lit("$"), F.lit("")))

    def signed(text: Column) -> Column:
        negative = text.rlike(rf"^-|-{SPACE}*$|^\(.*\)$|\(.*\d.*\)")

        def finish(digits: Column) -> Column:
            def apply_sign(found: Column) -> Column:
                minor = F.when(negative, -found["minor"]).otherwise(found["minor"])
                return F.when(
                    found["minor"].isNotNull(),
                    F.struct(minor.alias("minor"), found["confidence"].alias("confidence")),
                )

            return F.when(digits.rlike(r"\d"), let(_read_amount(digits, labelled), apply_sign))

        return let(F.regexp_replace(text, r"[^\d.,]", ""), finish)

    return let(plain, signed).cast(MONEY)


def find_money(text: Column, labelled: bool = False) -> Column:
    """best amount in free text; by confidence, then size, then position."""
    tokens = F.regexp_extract_all(text, F.lit(MONEY_TOKEN), F.lit(0))
    without_label = F.regexp_replace(text, r"^[A-Za-z\s\u00a0#:.*]+", "")

    def read(candidate: Column, at: Column) -> Column:
        return let(
            parse_money_ocr(candidate, labelled),
            lambda m: F.struct(
                m["confidence"].alias("confidence"),
                F.abs(m["minor"]).alias("size"),
                (-at).alias("earlier"),
                m["minor"].alias("minor"),
            ),
        )

    def choose(readings: Column) -> Column:
        amount = lambda r: F.struct(r["minor"].alias("minor"), r["confidence"].alias("confidence"))
        found = F.filter(F.slice(readings, F.lit(1), F.size(readings) - 1), lambda r: r["minor"].isNotNull())
        whole = F.element_at(readings, -1)

        def decide(best: Column) -> Column:
            # The whole text may override the tokens only with a sign they missed, or if it agrees.
            takes_over = (whole["confidence"] >= best["confidence"]) & (
                best["minor"].isNull() | (whole["minor"] < 0) | (whole["minor"] == best["minor"])
            )
            use_whole = best["minor"].isNull() | F.coalesce(takes_over, F.lit(False))
            return F.when(use_whole & whole["minor"].isNotNull(), amount(whole)).when(best["minor"].isNotNull(), amount(best))

        return let(F.array_max(found), decide)

    return let(F.transform(F.concat(tokens, F.array(without_label)), read), choose).cast(MONEY)


def whole_units(size: Column) -> Column:
    """Integer division by 100; no floating point on the way."""
    return F.call_function("div", size, F.lit(100))


def minor_to_text(minor: Column) -> Column:
    """``-25.00`` from integers alone."""
    size = F.abs(minor)
    return F.concat(
        F.when(minor < 0, "-").otherwise(""),
        whole_units(size).cast("string"),
        F.lit("."),
        F.lpad((size % 100).cast("string"), 2, "0"),
    )


def minor_to_decimal(minor: Column) -> Column:
    """Exact report cell: ``decimal(20,2)``."""
    return (minor.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(20,2)")


def format_money(minor: Column, currency: Column) -> Column:
    """symbol, thousands commas, em dash for a missing amount."""
    symbols = F.create_map(*[F.lit(x) for pair in CURRENCY_SYMBOLS.items() for x in pair])
    code = F.upper(F.when(F.coalesce(currency, F.lit("")) == "", "USD").otherwise(currency))
    symbol = F.coalesce(F.try_element_at(symbols, code), F.concat(code, F.lit(" ")))
    size = F.abs(minor)
    text = F.concat(
        F.when(minor < 0, "-").otherwise(""),
        symbol,
        F.format_number(whole_units(size), 0),
        F.lit("."),
        F.lpad((size % 100).cast("string"), 2, "0"),
    )
    return F.coalesce(text, F.lit("—"))
