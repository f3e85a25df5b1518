"""The text of one receipt page, read into its fields in plain Python.

``extract.parse_receipts`` hands it whole Arrow batches.  Patterns and confidences are those of ``functions``: money,
dates and names read alike there as columns and here, and a test holds the two equal.  Every pattern is asked only where
a word without which it cannot match stands in the line.
"""

from __future__ import annotations

import calendar
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from tillbook.functions.dates import (
    AMBIGUOUS_CONFIDENCE,
    FIRST_YEAR,
    FORCED_CONFIDENCE,
    ISO_CONFIDENCE,
    ISO_SCAN,
    LAST_YEAR,
    LONG_MONTHS,
    MONTHS,
    NAMED_CONFIDENCE,
    NAMED_SCAN,
    NUMERIC_CONFIDENCE,
    NUMERIC_SCAN,
)
from tillbook.functions.money import CURRENCY_WORD, MONEY_TOKEN, SPACE
from tillbook.functions.names import END, START, VAT_NAMES

# What is defined here travels to the executors by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values: labels, patterns and confidences that decide the result ------------

# Total labels on OCR-folded text, best first.
SUBTOTAL = r"\bsub\s*total\b|\bsubtotal\b"
PRE_TAX = r"\bnetto\b|\bsous\s*total\b|\bsubtotale\b|\bbase\s*imponible\b|\bzwischensumme\b"
TOTAL_LABELS = [
    (r"\bgesamtbetrag\b|\bzu\s*zahlen\b|\bendbetrag\b", 1.0),
    (r"\bsumme\b|\bgesamt\b|\btotaal\b|\btotale\b|\bimporto\b|\bmontant\b|\bte\s*betalen\b", 0.92),
    (r"\bgrand\s*total\b", 1.0),
    (r"\bamount\s*due\b|\bamt\s*due\b|\btotal\s*due\b", 0.95),
    (r"\bbalance\s*due\b", 0.75),
    (r"^\s*total\b|\btotal\s*[:$]|\btotal\s+\d", 0.92),
    (r"\btotal\b", 0.7),
]
# Some word of every label above: most lines hold none and skip the list.
TOTAL_WORD = "total|due|zahlen|betrag|summe|gesamt|totaal|importo|montant|betalen"
NOT_A_TOTAL = (
    r"^\s*(?:tax|gst|hst|pst|vat|sales\s*tax)\b|^\s*(?:cash|change|tip|gratuity)\b"
    r"|^\s*(?:visa|mc|mastercard|amex|debit)\b"
)
SUBTOTAL_LINE = r"\bsub\s*total\b|\bsubtotal\b|\bnetto\b|\bsous\s*total\b"
ADJUSTMENT = (
    rf"(?i){START}(tip|gratuity|service\s*(?:charge|fee)|delivery(?:\s*fee)?|shipping|handling|freight|surcharge"
    rf"|rounding|discount|coupon|savings|bag\s*fee|bottle\s*deposit){END}"
)
REDUCTION = rf"(?i){START}(discount|coupon|savings){END}"
TAX = (
    rf"(?i){START}((?:sales\s*)?tax|gst|hst|pst|vat|qst|tvq|tps|mwst|m\.?w\.?st|ust|tva|iva|btw|moms|alv)"
    rf"(?:{END}|\s*\d+(?:\.\d+)?\s*%(?=[A-Za-z0-9_]))"
)
AMOUNT_ALONE = r"^[\s $€£S(]*[\d.,]+-?[\s )]*$"
# Three numbers, or a month: texts without either hold no date and are not scanned.
DATE_HINT = r"\d[-/.\s\u00a0]+\d{1,2}[-/.\s\u00a0]+\d|(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
DATE_LABEL = r"(?i)(?:date|datum|fecha|dated)\s*[:#]?\s*(.+)$"
NOT_A_VENDOR = r"^\d+[-/.]\d+|^[\d\s .()-]+$|(?i:^(tel|phone|fax|www\.|http))"
DOCUMENT_WORD = r"(?i)receipt|invoice|order\s*#"
PAYMENTS = [
    (r"american\s*express|amex", "AMEX"),
    (r"master\s*card|mastercard|mc", "MASTERCARD"),
    (r"visa", "VISA"),
    (r"discover", "DISCOVER"),
    (r"interac", "INTERAC"),
    (r"girocard|ec[-\s]?karte", "GIROCARD"),
    (r"maestro", "MAESTRO"),
    (r"ideal", "IDEAL"),
    (r"bacs|faster\s*payments?", "BANK TRANSFER"),
    (r"apple\s*pay", "APPLE PAY"),
    (r"google\s*pay|g\s*pay", "GOOGLE PAY"),
    (r"paypal", "PAYPAL"),
    (r"debit", "DEBIT"),
    (r"credit\s*card", "CREDIT CARD"),
]
# Some word of every method: most lines hold none and skip the list.
PAYMENT_WORD = (
    r"(?i)express|amex|master|mc|visa|discover|interac|girocard|karte|maestro|ideal|bacs|payments?|pay|debit|card"
    r"|net|account|cash|check|cheque"
)
NET_DAYS = rf"(?i){START}net\s*\d{{1,3}}{END}"
NET_TERMS = rf"(?i){START}terms?\s*:\s*net{END}"
ON_ACCOUNT = rf"(?i){START}(?:on\s*account|charge\s*account){END}"
CASH = rf"(?i)^\s*cash{END}|{START}paid\s+cash{END}|{START}cash\s*[:$]|{START}cash\s+tend"
CHECK = rf"(?i)^\s*check{END}|{START}cheque{END}|{START}paid\s+by\s+check{END}|{START}payment\s*:\s*check{END}"
CARD_TAIL = rf"(?:\*{{2,}}|{START}x{{2,}}|{START}X{{2,}}|(?<=[A-Za-z0-9_])•{{2,}}|(?<=[A-Za-z0-9_])·+\s*)(\d{{3,5}}){END}"
CARD_TAIL_ANYWHERE = rf"(?i)(?:\*{{4,}}|{START}x{{4,}})\s*(\d{{3,5}}){END}"
REFERENCE = (
    r"(?i)(?:invoice|receipt|order|trans(?:action)?|ref(?:erence)?|ticket|auth)\s*(?:no|num|number|#|id)?"
    r"\s*[:#.]?\s*([A-Z0-9][-A-Z0-9]{2,})"
)
NOT_AN_ITEM = (
    r"(?i)^(?:total|subtotal|sub\s*total|tax|gst|hst|pst|vat|tip|cash|change|visa|mastercard|amex|debit|thank"
    r"|www\.|http|tel|phone|date|receipt|invoice)"
)
DATE_ALONE = r"^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$"

MAX_TAX_FRACTION, TAX_TOLERANCE = 0.5, 2
TOP_LINES, DESCRIPTION_CHARS = 6, 500
FIELDS = ["total", "txnDate", "vendor", "taxTotal", "paymentType", "externalRef", "description"]

# Words without one of which the patterns above match nothing, in lower case.
TOTAL_WORDS = [*TOTAL_WORD.split("|"), "netto"]
ADJUSTMENT_WORDS = [
    "tip", "gratuity", "service", "delivery", "shipping", "handling", "freight", "surcharge", "rounding", "discount", "coupon",
    "savings", "bag", "bottle",
]
TAX_WORDS = ["tax", "gst", "hst", "pst", "vat", "qst", "tvq", "tps", "wst", "w.st", "ust", "tva", "iva", "btw", "moms", "alv"]
PAYMENT_WORDS = PAYMENT_WORD.removeprefix("(?i)").replace("payments?", "payment").split("|")
REFERENCE_WORDS = ["invoice", "receipt", "order", "trans", "ref", "ticket", "auth"]
LARGEST = 2**63 - 1


def java(pattern: str) -> re.Pattern:
    """A pattern as ``rlike`` reads it: classes of ASCII, and line ends as Java knows them."""
    ends = "\n\r\x85\u2028\u2029"
    out, at, in_class = [], 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        if in_class:
            in_class = c != "]"
            out.append(c)
        elif c == "[":
            # A bracket that opens or closes nothing may stand first in a class.
            in_class = True
            first = re.match(r"\[\^?\]?", pattern[at:])[0]
            out.append(first)
            at += len(first)
            continue
        elif c == ".":
            out.append(f"[^{ends}]")
        elif c == "$":
            out.append(rf"(?=(?:\r\n|[{ends}])?\Z)(?!(?<=\r)\n)")
        else:
            out.append(c)
        at += 1
    return re.compile("".join(out), re.ASCII)


_BLANKS = " \t\n\x0b\f\r\xa0"


def trimmed(text: str) -> str:
    return text.strip(_BLANKS)


# --- money: F2 and F3, labelled ---------------------------------------------------------

_money_token, _currency, _s_dollar = java(MONEY_TOKEN), java(CURRENCY_WORD), java(r"S(?=\d)")
_no_label, _not_amount = java(r"^[A-Za-z\s\u00a0#:.*]+"), java(r"[^\d.,]")
_negative = java(rf"^-|-{SPACE}*$|^\(.*\)$|\(.*\d.*\)")
_letter = re.compile("[A-Za-z]")
_plain_amount = re.compile(r"\$?(\d{1,16})\.(\d\d)", re.ASCII)
_pair_two, _triple = re.compile(r"\d*\.\d{2}", re.ASCII), re.compile(r"\d{0,3}\.\d{3}", re.ASCII)
_grouped, _pair = re.compile(r"\d{1,3}(?:\.\d{3})+", re.ASCII), re.compile(r"\d*\.\d*", re.ASCII)
_us, _cents = re.compile(r"[\d,.]*,[\d,.]*\.[^,]*", re.ASCII), re.compile(r"[.,]\d{1,2}\Z", re.ASCII)
_DASHES = str.maketrans("\u2212\u2013\u2014", "---")
_SYMBOLS = str.maketrans("", "", "\u20ac\xa3\xa5\u20b9")


def _minor(digits: str, confidence: float) -> tuple[int, float] | None:
    value = int(digits) if digits else LARGEST + 1
    return (value, confidence) if value <= LARGEST else None


def _separated(text: str) -> tuple[int, float] | None:
    t = text.replace(",", ".")
    comma = "," in text
    digits = t.replace(".", "")
    head, _, tail = t.rpartition(".")
    if _pair_two.fullmatch(t):
        return _minor(head + tail, 0.85 if comma else 0.95) if head else None
    if _triple.fullmatch(t):
        return _minor(digits + "00", 0.7)
    if _grouped.fullmatch(t):
        return _minor(digits + "00", 0.75)
    if len(tail) == 2:
        head_digits = head.replace(".", "")
        return _minor(head_digits + tail, 0.7) if head_digits else None
    if not comma and len(tail) == 1 and _pair.fullmatch(t):
        return _minor(head + tail + "0", 0.6) if head else None
    return _minor(digits + "00", 0.55)


def _amount(text: str) -> tuple[int, float] | None:
    if text[-3:-2] == "." and text[:-3].isdecimal():
        if text[-2:].isdecimal():
            return _minor(text[:-3] + text[-2:], 0.95)
    dot, comma = "." in text, "," in text
    if dot and comma:
        cut = text.rindex(".") if _us.fullmatch(text) else text.rindex(",")
        whole = text[:cut].replace("," if _us.fullmatch(text) else ".", "")
        if not whole.isdecimal() or not _cents.search(text):
            return None
        return _minor(whole + text[max(text.rindex("."), text.rindex(",")) + 1 :].ljust(2, "0"), 0.95)
    return _separated(text) if dot or comma else _minor(text + "00", 0.6)


def parse_money(raw: str) -> tuple[int, float] | None:
    """one OCR token or phrase behind a label; (minor, confidence)."""
    text = trimmed(raw)
    if (plain := _plain_amount.fullmatch(text)) is not None:
        return int(plain[1] + plain[2]), 0.95
    if not text.isascii():
        text = text.translate(_DASHES).translate(_SYMBOLS)
    if _letter.search(text):
        text = _s_dollar.sub("", _currency.sub("", text))
    text = trimmed(text.replace("$", ""))
    digits = _not_amount.sub("", text)
    if digits.strip(".,") == "":
        return None
    found = _amount(digits)
    if found is not None and ("-" in text or "(" in text) and _negative.search(text):
        return -found[0], found[1]
    return found


def find_money(text: str) -> tuple[int, float] | None:
    """best amount behind a label; by confidence, then size, then position."""
    best = None
    for token in _money_token.findall(text):
        got = parse_money(token)
        if got is not None and (best is None or (got[1], abs(got[0])) > (best[1], abs(best[0]))):
            best = got
    whole = parse_money(_no_label.sub("", text))
    if whole is None:
        return best
    # The whole text may override the tokens only with a sign they missed, or if it agrees.
    if best is None or (whole[1] >= best[1] and (whole[0] < 0 or whole[0] == best[0])):
        return whole
    return best


# --- dates: F4 and F5 -------------------------------------------------------------------

_date_gap, _many_blanks = java(r"[\s\xa0,]+"), java(r"[\s\xa0]+")
_iso = java(r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$")
_day_first = java(r"^(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]+)\s+(\d{2,4})$")
_month_first = java(r"^([A-Za-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?\s+(\d{2,4})$")
_numbers = java(r"^(\d{1,4})[-/.\s\xa0]+(\d{1,2})[-/.\s\xa0]+(\d{1,4})$")
_scans = [java(p) for p in (ISO_SCAN, NAMED_SCAN, NUMERIC_SCAN)]
_MONTHS = {**{m: i + 1 for i, m in enumerate(MONTHS)}, "sept": 9, **{m: i + 1 for i, m in enumerate(LONG_MONTHS)}}


def _civil(year: int, month: int | None, day: int) -> str | None:
    if month is None or not (FIRST_YEAR <= year <= LAST_YEAR and 1 <= month <= 12 and 1 <= day <= 31):
        return None
    return f"{year:04d}-{month:02d}-{day:02d}" if day <= calendar.monthrange(year, month)[1] else None


def _full_year(year: int) -> int:
    return year if year >= 100 else year + 1900 if year >= 80 else year + 2000


def _named(text: str) -> tuple[str, float, bool] | None:
    spaced = trimmed(_date_gap.sub(" ", text))
    if (m := _day_first.search(spaced)) is not None:
        day, word, year = m.groups()
    elif (m := _month_first.search(spaced)) is not None:
        word, day, year = m.groups()
    else:
        return None
    civil = _civil(_full_year(int(year)), _MONTHS.get(word.lower()), int(day))
    return civil and (civil, NAMED_CONFIDENCE, False)


def _numeric(text: str, order: str | None) -> tuple[str, float, bool] | None:
    m = _numbers.search(text)
    if m is None:
        return None
    a, b, c = map(int, m.groups())
    if len(m[1]) == 4 or (order == "YMD" and a > 31):
        civil = _civil(_full_year(a), b, c)
        return civil and (civil, NUMERIC_CONFIDENCE, False)
    ambiguous = a <= 12 and b <= 12 and a != b
    day_forced, month_forced = a > 12 and b <= 12, b > 12 and a <= 12
    month_leads = month_forced or (not day_forced and order == "MDY")
    civil = _civil(_full_year(c), a if month_leads else b, b if month_leads else a)
    sure = FORCED_CONFIDENCE if day_forced or month_forced else NUMERIC_CONFIDENCE
    return civil and (civil, AMBIGUOUS_CONFIDENCE if ambiguous else sure, ambiguous)


def parse_date(raw: str, order: str | None = "MDY") -> tuple[str, float, bool] | None:
    """a whole string as a civil date; (civil, confidence, ambiguous)."""
    text = trimmed(raw)
    if (m := _iso.search(text)) is not None:
        civil = _civil(int(m[1]), int(m[2]), int(m[3]))
        return civil and (civil, ISO_CONFIDENCE, False)
    return _named(text) or _numeric(text, order)


def find_date(text: str, order: str | None = "MDY") -> tuple[str, float, bool] | None:
    """most certain date in free text; certain over ambiguous, ISO over named over numeric."""
    best = None
    for scan in _scans:
        for candidate in scan.findall(text):
            got = parse_date(candidate, order)
            if got is not None and (best is None or (got[1], not got[2]) > (best[1], not best[2])):
                best = got
    return best


# --- names: F12 and F13 ------------------------------------------------------------

_no_space = java(r"\s+")
_sales_tax, _wide_gap = java(r"SALES\s*TAX"), java(r"[\s\xa0]{2,}")


def squeezed(text: str) -> str:
    return trimmed(_many_blanks.sub(" ", text))


def _counts(text: str) -> tuple[int, int]:
    """Letters, and letters and digits of any script."""
    letters = sum(map(str.isalpha, text))
    if text.isascii():
        return letters, sum(map(str.isalnum, text))
    return letters, letters + sum(unicodedata.category(c)[0] == "N" for c in text)


def looks_like_vendor(raw: str) -> bool:
    """merchant name, or OCR noise?"""
    name = trimmed(raw)
    size = len(name)
    if not 2 <= size <= 60:
        return False
    letters, alnum = _counts(name)
    parts = [p for p in _many_blanks.split(name) if p]
    tokens, singles = len(parts), sum(_counts(p)[1] <= 1 for p in parts)
    return (
        letters >= 3
        and alnum / size >= 0.6
        and tokens <= 8
        and not (tokens >= 4 and singles / tokens > 0.35)
        and not (tokens == 1 and size > 24)
    )


def tax_label(raw: str) -> str:
    """one label per tax."""
    label = squeezed(raw).upper()
    if label == "TAX" or _sales_tax.search(label):
        return "TAX"
    if label in ("GST", "TPS"):
        return "GST"
    if label in ("TVQ", "QST"):
        return "QST"
    return "VAT" if _no_space.sub("", label) in VAT_NAMES else label


# --- lines ------------------------------------------------------------------------------

# what OCR confuses, in lower case; the rest of ``ocr_normalize`` is left to the lines that need it.
_FOLD = str.maketrans("015$", "oiss")
_not_folded = java(r"[^a-z0-9]+")
_total_word, _subtotal, _pre_tax, _not_a_total = (java(p) for p in (TOTAL_WORD, SUBTOTAL, PRE_TAX, NOT_A_TOTAL))
_total, _subtotal_line = java(r"\btotal\b"), java(SUBTOTAL_LINE)
_labels = [(java(p), score) for p, score in TOTAL_LABELS]
_adjustment, _reduction, _tax, _amount_alone = (java(p) for p in (ADJUSTMENT, REDUCTION, TAX, AMOUNT_ALONE))
_date_hint, _date_label = java(DATE_HINT), java(DATE_LABEL)
_not_a_vendor, _document_word = java(NOT_A_VENDOR), java(DOCUMENT_WORD)
_payment_word = java(PAYMENT_WORD)
_payments = [(java(rf"(?i){START}(?:{p}){END}"), name) for p, name in PAYMENTS]
_net_days, _net_terms, _on_account, _cash, _check = (java(p) for p in (NET_DAYS, NET_TERMS, ON_ACCOUNT, CASH, CHECK))
_card_tail, _card_tail_anywhere, _reference = (java(p) for p in (CARD_TAIL, CARD_TAIL_ANYWHERE, REFERENCE))
_not_an_item, _date_alone = java(NOT_AN_ITEM), java(DATE_ALONE)
_amount_line, _digit = java(r"(?i)^amount"), java(r"\d")


def total_score(folded: str) -> float:
    """How good a total label the OCR-folded line carries; 0 = none."""
    if not _total_word.search(folded) or _subtotal.search(folded) or _pre_tax.search(folded):
        return 0.0
    if not _total.search(folded) and _not_a_total.search(folded):
        return 0.0
    return next((score for pattern, score in _labels if pattern.search(folded)), 0.0)


def payment_of_line(text: str) -> str | None:
    """First matching method of a line, in the fixed order."""
    if not _payment_word.search(text):
        return None
    for pattern, name in _payments:
        if pattern.search(text):
            return name
    if (m := _net_days.search(text)) is not None:
        return squeezed(m[0]).upper()
    tests = ((_net_terms, "NET TERMS"), (_on_account, "ON ACCOUNT"), (_cash, "CASH"), (_check, "CHECK"))
    return next((name for pattern, name in tests if pattern.search(text)), None)


def clamp(value: float | None) -> float:
    """Into 0 .. 1; unknown is 0 and not a number 1, as ``least`` and ``greatest`` have it."""
    return 0.0 if value is None else 1.0 if value != value else min(max(value, 0.0), 1.0)


def _long(value: int) -> int:
    if not -LARGEST - 1 <= value <= LARGEST:
        raise OverflowError("an amount of more than 64 bits")
    return value


def _rank(value: float | None) -> tuple:
    """Unknown first, not a number last, as ``array_max`` has it."""
    return (0, 0.0) if value is None else (2, 0.0) if value != value else (1, value)


def _weighted(*parts: tuple[float | None, float]) -> float | None:
    total = None
    for value, weight in parts:
        if value is None:
            return None
        total = value * weight if total is None else total + value * weight
    return total


def union_box(boxes: list) -> tuple:
    """The smallest box around all; unknown sides are passed over."""
    low = lambda values: min((v for v in values if v is not None), key=_rank, default=None)
    high = lambda values: max((v for v in values if v is not None), key=_rank, default=None)
    plus = lambda a, b: None if a is None or b is None else a + b
    boxes = [b if b is not None else (None,) * 4 for b in boxes]
    x0, y0 = low(b[0] for b in boxes), low(b[1] for b in boxes)
    x1, y1 = high(plus(b[0], b[2]) for b in boxes), high(plus(b[1], b[3]) for b in boxes)
    return x0, y0, None if x0 is None or x1 is None else x1 - x0, None if y0 is None or y1 is None else y1 - y0


# A field: (value, confidence, box); a line has texts[i], confs[i], ys[i], boxes[i].


def _total_field(facts: list, confs: list, ys: list, boxes: list):
    """Best label, then largest amount, then lowest on the page."""
    best = None
    for i, score, _, _, _, (minor, sure) in facts:
        if score > 0:
            key = lambda: (_rank(ys[i]), minor, sure, _rank(confs[i]), tuple(map(_rank, boxes[i] or ())))  # noqa: B023,E731
            if best is None or (score, abs(minor)) > best[0] or ((score, abs(minor)) == best[0] and key() > best[1]):
                best = ((score, abs(minor)), key(), i, minor, sure)
    if best is None:
        return None
    (score, _), _, i, minor, sure = best
    return str(minor), clamp(_weighted((score, 0.55), (sure, 0.35), (confs[i], 0.1))), boxes[i]


def _date_field(texts: list, lows: list, confs: list, boxes: list, whole: str | None, months: list, order: str | None):
    """First dated line of the upper part, a labelled form first; else the whole text."""
    for i in range(min(len(texts), max(8, -(-len(texts) // 2)))):
        text = texts[i]
        if not any(m in lows[i] for m in months) and not _date_hint.search(text):
            continue
        after = _date_label.search(text)
        if after is not None and (got := parse_date(after[1], order) or find_date(after[1], order)) is not None:
            return _dated(got, 0.7, _weighted((confs[i], 0.3)), boxes[i])
        if (got := find_date(text, order)) is not None:
            return _dated(got, 0.65, _weighted((confs[i], 0.25)), boxes[i])
    got = find_date(whole, order) if whole is not None else None
    return got and _dated(got, 0.6, _weighted((confs[0] if confs else None, 0.0)), boxes[0] if boxes else None)


def _dated(got: tuple, weight: float, rest: float | None, box):
    return got[0], clamp(None if rest is None else got[1] * weight + rest), box


def _plausible_tax(entries: list, total: int | None, subtotal: int | None, adjustments: int):
    """Tax lines against total, subtotal and adjustments; (minor, confidence, lines)."""
    read, mean = _long(sum(e[1] for e in entries)), 0.0
    for e in entries:
        mean = None if mean is None or e[2] is None else mean + e[2]
    mean = None if mean is None else mean / len(entries)
    if not total:
        return read, mean, entries
    least = lambda bound: bound if mean is None or mean != mean else min(mean, bound)
    size, limit = abs(read), float(abs(total)) * MAX_TAX_FRACTION
    if subtotal is not None and float(implied := abs(_long(_long(total - subtotal) - adjustments))) <= limit:
        if abs(implied - size) <= TAX_TOLERANCE:
            return read, 0.9 if mean is None else mean if mean != mean else max(mean, 0.9), entries
        return (-implied if total < 0 else implied), least(0.55), [e for e in entries if abs(e[1]) <= implied + TAX_TOLERANCE]
    if float(size) <= limit:
        return read, mean, entries
    small = [e for e in entries if float(abs(e[1])) <= limit]
    kept = _long(sum(e[1] for e in small))
    if small and len(small) < len(entries) and float(abs(kept)) <= limit:
        return kept, least(0.4), small
    return None


def _tax_field(facts: list, confs: list, boxes: list, texts: list, total: int | None):
    """Distinct (label, amount) pairs in reading order, against the other amounts."""
    entries = {}
    for i, _, _, _, tax, (minor, sure) in facts:
        if tax:
            entries.setdefault((tax_label(tax), minor), (_weighted((confs[i], 0.4), (sure, 0.6)), boxes[i]))
    if not entries:
        return None
    listed = [(label, minor, conf) for (label, minor), (conf, _) in entries.items()]
    subtotal = next((minor for _, _, is_subtotal, _, _, (minor, _) in facts if is_subtotal), None)
    adjustments = _long(sum(
        -abs(minor) if _reduction.search(texts[i]) else abs(minor) for i, _, _, is_adjustment, _, (minor, _) in facts if is_adjustment))
    tax = _plausible_tax(listed, total, subtotal, adjustments)
    if tax is None:
        return None
    # A label is letters, dots and spaces: nothing to escape.
    lines = ",".join([f'{{"label":"{label}","amountMinor":{minor}}}' for label, minor, _ in tax[2]])
    value = f'{{"totalMinor":{tax[0]},"lines":[{lines}]}}'
    return value, clamp(tax[1]), union_box([box for _, box in entries.values()])


def _payment_field(texts: list, lows: list, confs: list, boxes: list, whole: str | None, words: list):
    """First line with a method; the card tail from that line, else from anywhere."""
    for i, text in enumerate(texts):
        if any(w in lows[i] for w in words) and (name := payment_of_line(text)) is not None:
            tail = _card_tail.search(text) or (_card_tail_anywhere.search(whole) if whole is not None else None)
            return f"{name} ****{tail[1]}" if tail else name, clamp(_weighted((0.75, 1.0), (confs[i], 0.2))), boxes[i]
    return None


def _reference_field(texts: list, lows: list, confs: list, boxes: list, whole: str | None, words: list):
    """Invoice, receipt or order number of the first line that has one."""
    for i, text in enumerate(texts):
        if any(w in lows[i] for w in words) and (m := _reference.search(text)) is not None:
            return m[1], clamp(_weighted((0.7, 1.0), (confs[i], 0.2))), boxes[i]
    m = _reference.search(whole) if whole is not None else None
    return m and (m[1], clamp(0.55), boxes[0] if boxes else None)


def _description_field(texts: list, boxes: list):
    """The middle lines that are neither labels nor dates."""
    kept = [
        t
        for t in (texts[1 : len(texts) - 4] if len(texts) > 5 else ())
        if len(t) >= 2
        and not _not_an_item.search(t)
        and not _date_alone.search(t)
        # "amount" lines are labels if they hold an amount, and any digit reads as one.
        and not (_amount_line.search(t) and _digit.search(t))
    ]
    return ("; ".join(kept)[:DESCRIPTION_CHARS], clamp(0.45), boxes[1]) if kept else None


def _vendor_field(texts: list, confs: list, boxes: list, known: str | None):
    """E5: the known name found on the page, else the first usable line of the top."""
    if known is not None:
        field = known, clamp(_weighted((0.85, 1.0), (confs[0], 0.1)) if confs else None), boxes[0] if boxes else None
        return field if looks_like_vendor(known) else None
    for i, text in enumerate(texts[:TOP_LINES]):
        if len(text) >= 2 and not _not_a_vendor.search(text) and not (len(text) < 20 and _document_word.search(text)):
            value = trimmed(_wide_gap.sub(" ", text))
            return (value, clamp(_weighted((0.55, 1.0), (confs[i], 0.25))), boxes[i]) if looks_like_vendor(value) else None
    return None


def read_page(texts: list, confs: list, ys: list, boxes: list, whole: str | None, known: str | None, order: str | None) -> list:
    """All fields of a page in the order of ``FIELDS``; None = not found."""
    lows = [t.lower() for t in texts]
    page = "\n".join(lows)
    folds = page.translate(_FOLD)
    if len(folded_lows := folds.split("\n")) != len(lows):
        folded_lows = [t.translate(_FOLD) for t in lows]
    # Words that stand somewhere on the page: only these are looked for in its lines.
    here = lambda words, text: [w for w in words if w in text]
    totals, adjusts, taxes = here(TOTAL_WORDS, folds), here(ADJUSTMENT_WORDS, page), here(TAX_WORDS, page)
    facts = []  # (line, score of the total label, is subtotal, is adjustment, tax, money) of the lines with a label and an amount
    for i, text in enumerate(texts):
        low = lows[i]
        score, is_subtotal, is_adjustment, tax = 0.0, False, False, ""
        for w in totals:
            if w in folded_lows[i]:
                folded = _not_folded.sub(" ", folded_lows[i]).strip(" ")
                score, is_subtotal = total_score(folded), _subtotal_line.search(folded) is not None
                break
        for w in adjusts:
            if w in low:
                is_adjustment = _adjustment.search(text) is not None
                break
        for w in taxes:
            if w in low:
                tax = m[1] if (m := _tax.search(text)) is not None else ""
                break
        if score > 0 or is_subtotal or is_adjustment or tax:
            amount = find_money(text)
            # The next line is read if it is little more than a number.
            if amount is None and i + 1 < len(texts) and _amount_alone.search(trimmed(texts[i + 1])):
                amount = find_money(texts[i + 1])
            if amount is not None:
                facts.append((i, score, is_subtotal, is_adjustment, tax, amount))
    total = _total_field(facts, confs, ys, boxes)
    return [
        total,
        _date_field(texts, lows, confs, boxes, whole, here(MONTHS, page), order),
        _vendor_field(texts, confs, boxes, known),
        _tax_field(facts, confs, boxes, texts, int(total[0]) if total else None),
        _payment_field(texts, lows, confs, boxes, whole, here(PAYMENT_WORDS, page)),
        _reference_field(texts, lows, confs, boxes, whole, here(REFERENCE_WORDS, page)),
        _description_field(texts, boxes),
    ]


def _read_batch(texts: pa.Array, lines: pa.Array, vendors: pa.Array, orders: pa.Array) -> pa.Array:
    """``read_page`` over an Arrow batch: a map of the found fields per page."""
    line = lines.flatten()  # the lines of these rows alone
    text, conf, y = (line.field(i).to_pylist() for i in range(3))
    box = line.field(3)
    boxes = list(zip(*[box.field(i).to_pylist() for i in range(4)]))
    if box.null_count:
        boxes = [b if known else None for b, known in zip(boxes, box.is_valid().to_pylist())]
    ends = [0, *accumulate(n or 0 for n in pc.list_value_length(lines).to_pylist())]
    counts, names, values, confidences, found_boxes = [0], [], [], [], []
    for k, (whole, vendor, order) in enumerate(zip(texts.to_pylist(), vendors.to_pylist(), orders.to_pylist())):
        at = slice(ends[k], ends[k + 1])
        for name, field in zip(FIELDS, read_page(text[at], conf[at], y[at], boxes[at], whole, vendor, order)):
            if field is not None:
                names.append(name)
                values.append(field[0])
                confidences.append(field[1])
                found_boxes.append(field[2])
        counts.append(len(names))
    sides = list(zip(*[b if b is not None else (None,) * 4 for b in found_boxes])) or [()] * 4
    box = pa.StructArray.from_arrays(
        [pa.array(side, pa.float64()) for side in sides], ["x", "y", "w", "h"], mask=pa.array([b is None for b in found_boxes], pa.bool_()))
    items = pa.StructArray.from_arrays(
        [pa.array(values, pa.string()), pa.array(confidences, pa.float64()), box], ["value", "confidence", "bbox"])
    return pa.MapArray.from_arrays(pa.array(counts, pa.int32()), pa.array(names, pa.string()), items)


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with the fields found: the last four columns are their text, lines, known vendor and order of dates."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-4], _read_batch(*batch.columns[-4:])], [*batch.schema.names[:-4], "fields"])
