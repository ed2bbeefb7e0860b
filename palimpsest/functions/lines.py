"""What a line of text is: a label, a header, a form field, a total, a number of something."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

#: A place between a letter, digit or underscore and something else, without look-around.
EDGE_BEFORE, EDGE_AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"

#: Words of lines that are always checked, as parts and as whole words; of lines that are never flagged; of high-value lines.
ALWAYS_CHECK = ("salary", "amount", "balance", "total", "net pay", "gross", "income", "compensation", "remuneration", "stipend", "payment", "account number", "aadhaar", "date of birth")
ALWAYS_CHECK_WORDS = ("ctc", "pan", "dob", "wage")
NEVER_FLAG = ("total days", "days paid", "lwp", "lop", "absent", "arrears days", "working days")
CRITICAL = ("salary", "ctc", "amount", "balance", "total", "net pay", "gross", "income", "compensation")
#: What address and contact lines hold (the last as whole words), marks of identity cards, of scanners, of merging tools.
ADDRESS = (r"[0-9]+[/\-][0-9]+", r"(?:^|[^\p{L}\p{N}_])[0-9]{6}(?:[^\p{L}\p{N}_]|$)", r"@[\p{L}\p{N}_]+\.[\p{L}\p{N}_]+", r"\+?[0-9][0-9\s\-]{8,}")
PLACES = ("road", "street", "nagar", "colony", "compound", "post", "village", "district", "taluk", "mandal", "state", "india", "maharashtra", "karnataka", "gujarat", "delhi", "mumbai", "bangalore", "bengaluru", "hyderabad", "chennai", "pune")
ID_CARD = ("aadhaar", "aadhar", "uid", "uidai", "unique identification", "permanent account number", "pan card", "driving licence", "driving license", "passport", "voter id", "epic no", "date of birth", "dob", "s/o", "d/o", "government of india")
#: Form fields, for spacing checks and for gaps above a line.
FORM_FIELD = (r"_{3,}", r"\t{2,}", r":\s{5,}", r"^(?:date|sign|signature|name|place|witness|designation|stamp|seal)\s*:?\s*$")
GAP_FIELD = (r"_{3,}", r"^\s*(?:date|sign|signature)\s*:?\s*$", r"\t{2,}", r"^\s*for\s+[\p{L}\p{N}_\s.,&]+,\s*$")
FORM_MOST_WORDS, FORM_LEAST_LENGTH = 2, 30
CAPS_SHARE, SHORT_WORDS, DIGIT_SHARE, LABEL_WORDS, FEW_WORDS, SEPARATOR_LENGTH, LETTERHEAD = 0.85, 3, 0.7, 8, 5, 5, 3
#: Rows that sum others up.
TOTALS = ("total", "net pay", "net salary", "gross total", "grand total", "subtotal", "sub total", "amount payable", "net payable", "net amount", "total earnings", "total deductions", "net wage", "closing balance", "opening balance", "total deposits", "total withdrawals", "carry forward", "balance c/f", "balance b/f")
#: Lines whose numbers are references: parts and whole words; address, state, currency and year words; sizes.
REFERENCE = ("account", "upi", "ifsc", "aadhaar", "gstin", "mobile", "phone", "pincode", "tran", "number", "no.", "phone", "mobile", "tel", "fax", "micr", "uan", "esi", "pf no", "employee id", "emp id", "a/c", "a/c no")
REFERENCE_WORDS = ("id", "ref", "pan", "cin", "zip")
POSTAL = ("pin", "pincode", "pin code", "postal", "address", "district", "village", "taluka", "tehsil")
STATES = ("maharashtra", "karnataka", "tamil nadu", "west bengal", "telangana", "gujarat", "rajasthan", "punjab", "haryana", "kerala", "odisha", "bihar", "jharkhand", "assam", "uttar pradesh", "madhya pradesh", "chhattisgarh", "uttarakhand", "himachal pradesh", "goa", "andhra pradesh", "delhi", "chandigarh", "puducherry")
CURRENCY = ("rs.", "rs ", "inr", "₹", "$", "amount", "total", "balance", "salary", "payable", "due", "fee")
YEAR_WORDS = ("date", "year", "fy", "dob", "born", "since", "w.e.f", "financial year")
ID_DIGITS, PIN_DIGITS, FIRST_YEAR, LAST_YEAR = 8, 6, 1950, 2099


def holds_any(text: Column, parts) -> Column:
    return reduce(or_, [F.contains(text, F.lit(p)) for p in parts])


def holds_word(text: Column, words) -> Column:
    """Whether one of the words stands alone in the text."""
    return text.rlike(f"{EDGE_BEFORE}(?:{'|'.join(words)}){EDGE_AFTER}")


def label_matches(text: Column, label: str) -> Column:
    """Labels of up to three characters as whole words, longer ones as parts; the text is in lower case."""
    return holds_word(text, [label]) if len(label) <= 3 else F.contains(text, F.lit(label))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def share_of(text: Column, other: str) -> Column:
    """Characters that are left after those of the class other are taken out, as a number."""
    return F.length(F.regexp_replace(text, other, ""))


def is_structural(text: Column, page: Column, line: Column, height: Column, repeated: Column) -> Column:
    """Whether a line is a header, footer, label, list item, separator or address, unless it holds a word that is always checked. repeated: whether another line has the same text."""
    t = F.trim(text)
    low, words = F.lower(t), F.size(words_of(t))
    letters = share_of(t, r"[^\p{L}]")
    bare = F.regexp_replace(t, "[ \\-/.]", "")
    plain = F.replace(t, F.lit(" "), F.lit(""))
    rules = [
        (letters > 0) & (share_of(t, r"[^\p{Lu}]") / F.greatest(letters, F.lit(1)) > CAPS_SHARE),
        words <= SHORT_WORDS,
        repeated,
        (bare != "") & (share_of(bare, "[^0-9]") / F.greatest(F.length(bare), F.lit(1)) > DIGIT_SHARE),
        t.rlike(r"^[A-Za-z\s]+\s*:\s*.+$") & (words <= LABEL_WORDS),
        t.rlike(r"^[-•*0-9]+[.)]\s"),
        t.rlike(r"^[*\-_=#]{5,}"),
        (words <= FEW_WORDS) & (height > 0),
        F.contains(t, F.lit(" : ")) | t.endswith(":"),
        (F.size(F.array_distinct(F.filter(F.split(plain, ""), lambda c: c != ""))) <= 2) & (F.length(t) > SEPARATOR_LENGTH),
        (line < LETTERHEAD) & (page == 0),
        reduce(or_, [t.rlike(p) for p in ADDRESS]) | holds_word(low, PLACES),
    ]
    checked = holds_any(low, ALWAYS_CHECK) | holds_word(low, ALWAYS_CHECK_WORDS)
    return ~checked & F.coalesce(reduce(or_, rules), F.lit(False))


def is_form_field(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return reduce(or_, [low.rlike(p) for p in FORM_FIELD]) | ((F.size(words_of(low)) <= FORM_MOST_WORDS) & (F.length(text) > FORM_LEAST_LENGTH))


def is_gap_field(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return reduce(or_, [low.rlike(p) for p in GAP_FIELD])


def is_id_number(value: Column, text: Column) -> Column:
    """Whether a number of a line is a reference, a postal code or a year rather than a value."""
    low = F.lower(text)
    whole = value == F.floor(value)
    digits = F.when(whole, F.floor(value).cast("long").cast("string")).otherwise("")
    capitals = F.size(F.filter(F.split(text, "[^A-Za-z]+"), lambda w: (F.length(w) >= 4) & (F.upper(w) == w)))
    last = text.rlike(r"[-,]\s*[0-9]+\s*$") & (F.regexp_extract(text, r"[-,]\s*([0-9]+)\s*$", 1) == digits)
    postal = holds_any(low, POSTAL) | holds_any(low, STATES) | (~holds_any(low, CURRENCY) & ((capitals >= 2) | last))
    # runs of digits after or before a slash or hyphen
    after = F.regexp_extract_all(text, F.lit(r"(?<=[/\-])\s*([0-9]+)(?![\p{L}\p{N}_])"), F.lit(1))
    ahead = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])([0-9]+)(?=\s*[/\-])"), F.lit(1))
    beside = F.array_contains(after, digits) | F.array_contains(ahead, digits)
    year = (F.length(digits) == 4) & value.between(FIRST_YEAR, LAST_YEAR) & (holds_any(low, YEAR_WORDS) | beside)
    return holds_any(low, REFERENCE) | holds_word(low, REFERENCE_WORDS) | (F.length(digits) > ID_DIGITS) | ((F.length(digits) == PIN_DIGITS) & postal) | year


def is_total(text: Column) -> Column:
    return holds_any(F.lower(text), TOTALS)
