"""Numbers in texts, and robust statistics."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

#: One number of a word with little around it: at most three characters before, none a letter or digit, and three after, none a digit.
NUMBER = r"(?:\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)"
CLEAN = rf"^[^A-Za-z0-9]{{0,3}}\b({NUMBER})\b[^0-9]{{0,3}}$"


def parse_number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def clean_number(word: Column) -> Column:
    """The number that a word is, or null."""
    found = F.regexp_extract(word, CLEAN, 1)
    return F.when(found != "", parse_number(found))


#: Signs and short names of currencies; words of addresses.
SIGNS, CURRENCIES = "₹$€£¥", ("rs", "inr", "usd", "eur", "gbp")
ADDRESS_WORDS = ("street", "road", "avenue", "city", "state", "country", "pin", "postal")
DIGITS, BLANKS = "0123456789", " \t\n\r\x0b\x0c"


def only_of(text: Column, characters: str) -> Column:
    """Whether a text has characters, all of them among these."""
    return (text != "") & (F.translate(text, characters, "") == "")


def currency_value(text: Column) -> Column:
    """The value of an amount without its separators, currency and signs around it, or null."""
    bare = F.translate(text, "," + BLANKS, "")
    ahead = F.regexp_replace(bare, f"(?i)^(?:{'|'.join(CURRENCIES)})", "")
    bare = F.trim(F.when(bare != ahead, F.regexp_replace(ahead, "^[.]", "")).otherwise(bare), F.lit(SIGNS + "."))
    signed = F.regexp_replace(bare, "^[-+]", "")
    number = only_of(signed, DIGITS + ".") & (F.length(F.translate(signed, DIGITS, "")) <= 1) & ~signed.endswith(".")
    return F.when(number, bare.try_cast("double"))


def texts_differ(a: Column, b: Column) -> Column:
    """Neither blank, nor equal but for white space, nor the same amount."""
    x, y = F.regexp_replace(a, r"\s+", ""), F.regexp_replace(b, r"\s+", "")
    same = F.coalesce(currency_value(a) == currency_value(b), F.lit(False))
    return (x != "") & (y != "") & (x != y) & ~same


def field_type(text: Column) -> Column:
    """amount, date, id_number, name, address or unknown: the first that fits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    ahead = F.regexp_extract(F.upper(text), "^[A-Z]{1,4}", 0)
    rest = F.substr(F.upper(text), F.length(ahead) + 1)
    parts = F.regexp_extract_all(text, F.lit("[0-9]{1,2}([-/.])[0-9]{1,2}([-/.])[0-9]{2,4}"), F.lit(0))
    kinds = {
        "amount": only_of(text, DIGITS + BLANKS + ",.₹$€£"),
        "date": F.size(parts) > 0,
        "id_number": (ahead != "") & only_of(rest, DIGITS + "/-"),
        "name": only_of(text, letters + letters.lower() + BLANKS + ".") & (F.length(text) > 3),
        "address": reduce(or_, [F.contains(F.lower(text), F.lit(w)) for w in ADDRESS_WORDS]),
    }
    return F.coalesce(*[F.when(holds, F.lit(name)) for name, holds in kinds.items()], F.lit("unknown"))
