"""Pattern matching on text: literal patterns with ASCII word edges, and tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "A-Za-z0-9_"

# Accented Latin letters and the plain letters they count as.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

# Frequent English words left out of the search index.
STOP_WORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "but", "by",
    "can", "could", "did", "do", "does", "for", "from", "had", "has", "have", "he", "her", "his", "how", "i", "if",
    "in", "into", "is", "it", "its", "just", "more", "most", "my", "no", "not", "now", "of", "on", "only", "or",
    "other", "our", "out", "over", "she", "so", "some", "such", "than", "that", "the", "their", "them", "then",
    "there", "these", "they", "this", "those", "to", "too", "up", "very", "was", "we", "were", "what", "when",
    "where", "which", "who", "will", "with", "would", "you", "your",
)


def literal_regex(pattern: str, whole_word: bool = True, anchor: str = "edge") -> str:
    """Case-insensitive regex that matches the pattern as plain text.

    A whole-word edge is anchored where the pattern's own edge is a word
    character; ``anchor='always'`` anchors both edges like a plain ``\\b``.
    """
    body = re.sub(r"([\\.^$*+?()\[\]{}|])", r"\\\1", pattern)
    if not whole_word or not pattern:
        return f"(?iu){body}"
    word = [bool(re.match(f"[{_WORD}]", c)) for c in (pattern[0], pattern[-1])]
    before, after = f"(?<![{_WORD}])", f"(?![{_WORD}])"
    if anchor == "always":
        # beside a symbol, a word boundary asks for a word character on the far side
        before = before if word[0] else f"(?<=[{_WORD}])"
        after = after if word[1] else f"(?=[{_WORD}])"
        return f"(?iu){before}{body}{after}"
    return "(?iu)" + (before if word[0] else "") + body + (after if word[1] else "")


def literal_regex_of(pattern: Column) -> Column:
    """``literal_regex`` of whole words for a column of patterns."""
    body = F.regexp_replace(pattern, r"([\\.^$*+?()\[\]{}|])", r"\\$1")
    before = F.when(pattern.rlike(f"^[{_WORD}]"), f"(?<![{_WORD}])").otherwise("")
    after = F.when(pattern.rlike(f"[{_WORD}]$"), f"(?![{_WORD}])").otherwise("")
    return F.concat(F.lit("(?iu)"), before, body, after)


def spaced_words(text: Column) -> Column:
    """The text's runs of word characters in lower case, with one space before and after each.

    Fit to look words up only in texts without ``has_case_twins``.
    """
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), f"[^{_WORD}]+", " "), F.lit(" "))


def has_case_twins(text: Column) -> Column:
    """Whether the text holds letters outside ASCII that case-blind matching takes for plain ones."""
    return F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u0131")) | F.contains(text, F.lit("\u017f")) | F.contains(text, F.lit("\u212a"))


def is_word(pattern: str) -> bool:
    """Whether the pattern is one run of word characters."""
    return re.fullmatch(f"[{_WORD}]+", pattern) is not None


def word_runs(text: Column) -> Column:
    """Distinct lower-case runs of word characters, also of letters that case-blind matching takes for plain ones."""
    found = F.regexp_extract_all(text, F.lit(f"[{_WORD}]+"), F.lit(0))
    alike = F.when(text.rlike("[\u0130\u0131\u017f\u212a]"), F.regexp_extract_all(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk"), F.lit(f"[{_WORD}]+"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(found, alike), F.lower))


def combined(*fields: str) -> Column:
    """Text fields joined by one space, a NULL field counting as empty."""
    parts: list[Column] = []
    for f in fields:
        parts += [F.lit(" "), F.coalesce(F.col(f), F.lit(""))]
    return F.concat(*parts[1:])


def tokens(text: Column, stop_words: tuple[str, ...] | list[str] = ()) -> Column:
    """Lower-case runs of a-z after accents are dropped, without stop words."""
    plain = F.translate(F.lower(text), ACCENTED, PLAIN)
    found = F.split(F.trim(F.regexp_replace(plain, "[^a-z]+", " ")), " ")
    keep = lambda t: t != ""
    if stop_words:
        return F.filter(found, lambda t: keep(t) & ~t.isin(*stop_words))
    return F.filter(found, keep)
