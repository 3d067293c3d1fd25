"""Text repair and masking as Spark column expressions (no UDFs).

Every function maps a string Column to a string Column (or an array
Column) and runs inside whole-stage codegen; patterns are applied in a
fixed order with ``regexp_replace`` (Java regex, ``$1`` for groups).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Masking patterns and their replacements, applied in order.
# ---------------------------------------------------------------------------
MASK_PATTERNS = [
    ("api_key", r"sk-[a-zA-Z0-9]{48}", "sk-***"),
    ("bearer", r"Bearer [a-zA-Z0-9_\-\.]+", "Bearer ***"),
    ("card", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "****-****-****-****"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "***-**-****"),
]

# ---------------------------------------------------------------------------
# Glued phrases and words and their spaced forms, most specific
# first.  Applied in this order.
# ---------------------------------------------------------------------------
SPACING_PHRASES = [
    ("isalsowellabovethe", " is also well above the "),
    ("isalsowellbelowthe", " is also well below the "),
    ("iswellabovethe", " is well above the "),
    ("iswellbelowthe", " is well below the "),
    ("isalsoabovethe", " is also above the "),
    ("isalsobelowthe", " is also below the "),
    ("isabovethe", " is above the "),
    ("isbelowthe", " is below the "),
    ("typicalmonthlyrangeof", " typical monthly range of "),
    ("monthlyrangeof", " monthly range of "),
    ("typicalrange", " typical range"),
    ("rangeof", " range of "),
    ("isalso", " is also "),
    ("iswell", " is well "),
    ("wellabove", " well above "),
    ("wellbelow", " well below "),
    ("wellwithin", " well within "),
    ("welloutside", " well outside "),
]

#: found in every text that holds one of the phrases
_ANY_PHRASE = "isalso|iswell|above|below|rangeof|typicalrange|wellwithin|welloutside"

_AMOUNT = r"\d+(?:,\d{3})*(?:\.\d{2})?"
# Spacing rules after the phrase repairs, in order.
SPACING_RULES = [
    (r"(" + _AMOUNT + r")([a-zA-Z])", "$1 $2"),     # 8,500.00is -> 8,500.00 is
    (r"([a-zA-Z])(" + _AMOUNT + r")", "$1 $2"),     # above100 -> above 100
    (r"([a-z])([A-Z])", "$1 $2"),                   # camelCase -> camel Case
    (r"\$\s+(\d)", r"\$$1"),                        # $ 100 -> $100
    (r"(\d)\s+%", "$1%"),                           # 15 % -> 15%
    (r"\s+", " "),
]

# Amounts broken over lines, 35\n000.00 -> 35,000.00 and 35\n000\n00 -> 35,000.00.
SPLIT_AMOUNT_RULES = [
    (r"(\d{1,3})\n\s*(\d{3})\.(\d{2})", "$1,$2.$3"),
    (r"(\d{1,3})\n\s*(\d{3})\n\s*(\d{2})", "$1,$2.$3"),
]


def _fold(c: Column, rules) -> Column:
    return reduce(lambda acc, r: F.regexp_replace(acc, r[0], r[1]), rules, c)


def mask_sensitive(c: Column, patterns=None) -> Column:
    """Replace keys, bearer tokens, card numbers and SSNs, in that order."""
    pats = patterns if patterns is not None else [(p, r) for _, p, r in MASK_PATTERNS]
    return _fold(c, pats)


def mask_hits(c: Column) -> dict[str, Column]:
    """Matches per masking pattern, counted on the text as each step sees it."""
    out, cur = {}, c
    for name, p, r in MASK_PATTERNS:
        out[name] = F.regexp_count(cur, F.lit(p))
        cur = F.regexp_replace(cur, p, r)
    return out


def normalize_spacing(c: Column) -> Column:
    """Split glued phrases and words, space numbers from letters, split
    camelCase, keep ``$100`` and ``15%`` together, collapse whitespace, trim."""
    # The phrases are plain text, so they go through literal replace (no
    # regex engine); the rules after them are patterns.
    # One test spares texts without any of them the whole block.
    phrases = reduce(lambda acc, r: F.replace(acc, F.lit(r[0]), F.lit(r[1])), SPACING_PHRASES, c)
    phrases = F.when(c.rlike(_ANY_PHRASE), phrases).otherwise(c)
    return F.trim(_fold(phrases, SPACING_RULES))


def escape_currency(c: Column) -> Column:
    """``$`` not already preceded by a backslash becomes ``\\$``."""
    return F.regexp_replace(c, r"(?<!\\)\$", r"\\\$")


def join_split_amounts(c: Column) -> Column:
    """Rejoin amounts broken over lines, with a thousands comma."""
    return _fold(c, SPLIT_AMOUNT_RULES)


def group_thousands(c: Column, rounds: int = 6) -> Column:
    """Thousands commas in ``\\$`` amounts: ``\\$15000.00`` -> ``\\$15,000.00``.
    Each round places one comma per amount; six rounds cover 21 digits."""
    rule = (r"(\\\$\d+)(\d{3})(?!\d)", "$1,$2")
    return _fold(c, [rule] * rounds)


def merge_split_evidence(items: Column) -> Column:
    """Rejoin evidence items that a list split in the middle of an amount:
    an item ending in ``\\$`` or followed by a bare ``-digits`` item is
    joined with that next item (single ``\\$``), then thousands are grouped."""
    def is_number(x):
        return F.regexp_replace(F.trim(x), r"^-\s*", "").rlike(r"^[0-9.]+$") & F.trim(x).rlike(r"[0-9]")

    def step(acc, x):
        last = F.element_at(acc, -1)
        joinable = (F.size(acc) > 0) & is_number(x) & (
            last.endswith("\\$") | F.trim(x).startswith("-"))
        merged = F.concat(
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
            F.array(F.concat(last, F.regexp_replace(F.trim(x), r"^-\s*", ""))))
        return F.when(joinable, merged).otherwise(F.concat(acc, F.array(x)))

    merged = F.aggregate(items, F.array().cast("array<string>"), step)
    return F.transform(merged, lambda s: group_thousands(s))


# Section markers of an explanation text.
SECTIONS = {
    "root_cause": "Root Cause",
    "chain_of_thought": "Chain of Thought",
    "recommendation": "Recommendation",
    "supporting_evidence": "Supporting Evidence",
}


def section(c: Column, title: str) -> Column:
    """Text after ``**Title**:`` up to the next ``\\n**`` or the end (NULL if absent)."""
    pat = r"(?s)\*\*" + title + r"\*\*:\s*(.+?)(?=\n\*\*|$)"
    return F.when(c.rlike(pat), F.trim(F.regexp_extract(c, pat, 1)))


def split_evidence(c: Column) -> Column:
    """Evidence list: split on commas that are not between two digits, so
    ``1,000`` stays whole; ``none`` means an empty list."""
    parts = F.transform(F.split(c, r"(?<!\d),|,(?!\d)"), lambda s: F.trim(s))
    return F.when(c.isNull() | (F.lower(F.trim(c)) == "none"), F.array().cast("array<string>")).otherwise(parts)


def parse_sections(c: Column) -> Column:
    """Struct of the four sections; evidence is a list with split amounts
    rejoined and currency escaped."""
    ev = split_evidence(join_split_amounts(section(c, SECTIONS["supporting_evidence"])))
    return F.struct(
        join_split_amounts(section(c, SECTIONS["root_cause"])).alias("root_cause"),
        join_split_amounts(section(c, SECTIONS["chain_of_thought"])).alias("chain_of_thought"),
        join_split_amounts(section(c, SECTIONS["recommendation"])).alias("recommendation"),
        merge_split_evidence(F.transform(ev, lambda s: escape_currency(s))).alias("supporting_evidence"),
    )


def preview(c: Column, n: int = 100) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def token_estimate(c: Column) -> Column:
    """Rough token count: characters // 4."""
    return F.floor(F.length(c) / 4).cast("long")


def slug(c: Column, and_sign: bool = True) -> Column:
    """Lower case, spaces to underscores (``&`` to ``and`` when asked)."""
    s = F.lower(c)
    if and_sign:
        s = F.replace(s, F.lit("&"), F.lit("and"))
    return F.replace(s, F.lit(" "), F.lit("_"))
