"""Name normalisers and vendor-name tests (F7-F13) and text-layer cleanup."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tillbook.functions.let import cases, let
from tillbook.functions.money import trimmed

# Outlet markers, legal suffixes, regional tax names, glyph repairs.
OUTLET_WORDS = "store|str|stor|loc|location|shop|unit|branch|site|no"
LEGAL_WORDS = "inc|llc|ltd|limited|corp|corporation|co|company|plc|gmbh|bv|srl|pty"
VAT_NAMES = ["MWST", "M.W.ST", "UST", "TVA", "IVA", "BTW", "MOMS", "ALV"]
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))

START, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def squeezed(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"[\s ]+", " "))


def normalize_vendor(name: Column) -> Column:
    """comparable vendor name without outlet numbers, punctuation or legal form."""
    text = F.lower(name)
    text = F.regexp_replace(text, rf"{START}(?:{OUTLET_WORDS}){END}\.?\s*+(?:#\s*+)?\d+", " ")
    text = F.regexp_replace(text, r"#\s*+\d+", " ")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}\s ]", " ")
    text = F.regexp_replace(text, rf"{START}(?:{LEGAL_WORDS}){END}", " ")
    # A trailing number of three or more digits goes only if a letter precedes it; there is one space between words.
    number = r" \d{3,}$"
    without = lambda t: let(F.regexp_replace(t, number, ""), lambda rest: F.when(rest.rlike(r"\p{L}"), rest).otherwise(t))
    return squeezed(let(squeezed(text), without))


def vendor_match_key(name: Column) -> Column:
    """F8: looser key, spaces removed."""
    return F.replace(normalize_vendor(name), F.lit(" "), F.lit(""))


def rule_norm(name: Column) -> Column:
    """rule-side normaliser; punctuation is deleted, not spaced."""
    return squeezed(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}\s ]", ""))


def ocr_normalize(text: Column) -> Column:
    """fold the usual OCR confusions, keep ASCII letters and digits."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "015$", "oiss"), r"[^a-z0-9]+", " "))


def vendor_matches(known: Column, text: Column) -> Column:
    """literal, OCR-tolerant, or first word of four or more letters."""
    folded, hay = ocr_normalize(known), ocr_normalize(text)
    first = F.substring_index(folded, " ", 1)
    return F.lower(text).contains(F.lower(known)) | hay.contains(folded) | ((F.length(first) >= 4) & hay.contains(first))


def looks_like_vendor(raw: Column) -> Column:
    """merchant name, or OCR noise?"""
    name = trimmed(raw)
    size = F.length(name)
    letters = F.regexp_count(name, F.lit(r"\p{L}"))
    alnum = F.regexp_count(name, F.lit(r"[\p{L}\p{N}]"))
    tokens = F.regexp_count(name, F.lit(r"[^\s ]+"))
    # A single: a token that keeps at most one letter or digit.
    singles = F.size(
        F.filter(
            F.split(name, r"[\s ]+"),
            lambda t: (t != "") & (F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")) <= 1),
        )
    )
    return (
        size.between(2, 60)
        & (letters >= 3)
        & (alnum / size >= 0.6)
        & (tokens <= 8)
        & ~((tokens >= 4) & (singles / tokens > 0.35))
        & ~((tokens == 1) & (size > 24))
    )


def tax_label(raw: Column) -> Column:
    """one label per tax."""
    label = F.upper(squeezed(raw))
    tight = F.regexp_replace(label, r"\s+", "")
    return cases(
        (label.rlike(r"SALES\s*TAX") | (label == "TAX"), F.lit("TAX")),
        (label.isin("GST", "TPS"), F.lit("GST")),
        (label.isin("TVQ", "QST"), F.lit("QST")),
        (tight.isin(*VAT_NAMES), F.lit("VAT")),
        otherwise=label,
    )


def clean_pdf_text(text: Column) -> Column:
    """soft hyphens, no-break spaces, ligatures, full-width forms."""
    out = F.translate(text, FULL_WIDTH + "\u00a0\u00ad", HALF_WIDTH + " ")
    for glyph, letters in LIGATURES.items():
        out = F.replace(out, F.lit(glyph), F.lit(letters))
    return out
