"""Content-safety filter (F13): the first category, in order, of which a pattern occurs; one CASE, no UDF."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_G = "{0,200}"

# Categories in order of precedence, with their patterns; case is ignored and a dot covers newlines.
PATTERNS = {
    "antisemitic": [
        rf"\bJew(?:s|ish)?\b.{_G}\b(?:damn|curs|devil|dog|poison|usur|villain|treach|avar|greedy|sly|cunning|blood|kill|crucif)",
        rf"\b(?:damn|curs|devil|dog|poison|villain|treach|avar|greedy|sly|cunning)\b.{_G}\bJew(?:s|ish)?\b",
        r"\bshylock\b",
        r"\bJew(?:'s)?\s+nose\b",
        r"\bcircumcis\w*\s+(?:dog|cur|villain|rogue)",
        r"\bsynagogue\s+of\s+Satan\b",
        rf"\bJew\b.{_G}\bdevil\b",
    ],
    "racist": [
        rf"\bnegro(?:es)?\b.{_G}\b(?:slave|savage|beast|brute|inferior|ape|monkey)",
        rf"\b(?:slave|savage|beast|brute|inferior)\b.{_G}\bnegro(?:es)?\b",
        rf"\bblackamoor\b.{_G}\b(?:devil|damn|ugly|beast|lust)",
        rf"\b(?:devil|damn|ugly|beast|lust)\b.{_G}\bblackamoor\b",
        rf"\bMoor\b.{_G}\b(?:devil|damn|thick.?lip|lust|beast|jealous)\b",
        rf"\b(?:thick.?lip|lust|beast)\b.{_G}\bMoor\b",
        rf"\bsavage(?:s)?\b.{_G}\b(?:Indian|native|heathen|cannibal)",
        rf"\b(?:Indian|native|heathen)\b.{_G}\bsavage(?:s)?\b",
    ],
    "misogynist": [
        rf"\b(?:woman|wom[ae]n|wife|wives|female)\b.{_G}\b(?:frailty|weak|fickle|treach|deceit)\b",
        rf"\b(?:frailty|weak|fickle|treach|deceit)\b.{_G}\b(?:woman|wom[ae]n|wife|wives|female)\b",
        rf"\b(?:strumpet|harlot|bawd)\b.{_G}\b(?:she|her|woman|wom[ae]n|wife)\b",
        rf"\b(?:she|her|woman|wom[ae]n|wife)\b.{_G}\b(?:strumpet|harlot|bawd)\b",
    ],
    "anti-catholic": [
        rf"\bpop(?:ish|ery)\b.{_G}\b(?:idol|superstit|antichrist|whore|beast|tyran)",
        r"\bwhore\s+of\s+(?:Babylon|Rome)\b",
        rf"\bRomish\b.{_G}\b(?:idol|superstit|antichrist|tyran)",
    ],
    "anti-irish": [
        rf"\bIrish\b.{_G}\b(?:savage|wild|barbar|brute|rebel|papist)",
        rf"\b(?:savage|wild|barbar|brute)\b.{_G}\bIrish\b",
    ],
    "anti-muslim": [
        rf"\b(?:Turk|Mahometan|Saracen)\b.{_G}\b(?:infidel|barbar|savage|false|cruel|tyran|heathen)",
        rf"\b(?:infidel|barbar|savage|heathen)\b.{_G}\b(?:Turk|Mahometan|Saracen)\b",
    ],
}


# Words, in lower case, of which each match of a category holds one: texts without them need no pattern.
WORDS = {
    "antisemitic": ["jew", "shylock", "circumcis", "synagogue"],
    "racist": ["negro", "moor", "savage"],
    "misogynist": ["frailty", "weak", "fickle", "treach", "deceit", "strumpet", "harlot", "bawd"],
    "anti-catholic": ["popish", "popery", "whore", "romish"],
    "anti-irish": ["irish"],
    "anti-muslim": ["turk", "mahometan", "saracen"],
}


def safety_reason(text: Column, patterns: dict[str, list[str]] = PATTERNS, words: dict[str, list[str]] | None = None) -> Column:
    """The first category that matches, or an empty string; null text is safe. ``words``: those that a category's matches need; a category without an entry is tried on every text."""
    words = (WORDS if patterns is PATTERNS else {}) if words is None else words
    small, reason = F.lower(text), F.lit("")
    for category in reversed(patterns):
        found = text.rlike("(?is)" + "|".join(f"(?:{p})" for p in patterns[category]))
        if category in words:
            found = reduce(or_, [F.contains(small, F.lit(w)) for w in words[category]]) & found
        reason = F.when(found, F.lit(category)).otherwise(reason)
    return F.when(text.isNull(), F.lit("")).otherwise(reason)
