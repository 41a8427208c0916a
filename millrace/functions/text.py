"""Text cleaning and text features as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns.
HTML = r"<[^>]+>"
URL = r"http[s]?://\S+|www\.\S+"
EMAIL = r"\S+@\S+"
SPECIAL = r"[^a-zA-Z0-9\s]"
DIGITS = r"\d+"
WHITE = r"\s+"
URL_MARK = r"http[s]?://|www\."
PUNCTUATION = r'[!@#$%^&*(),.?":{}|<>]'

# English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once
""".split()
# Words that speak for English.
ENGLISH = ("the", "is", "are", "and", "of", "to", "in", "a", "for")


def _u(pattern: str) -> str:
    """White space, digits and words in Unicode's sense."""
    return "(?U)" + pattern


def clean(text: Column, lowercase: bool = True, remove_urls: bool = True, remove_emails: bool = True, remove_html: bool = True, remove_special_chars: bool = False, remove_numbers: bool = False, remove_extra_spaces: bool = True) -> Column:
    """One nested expression: mark-up, addresses and so on become blanks; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for wanted, pattern in ((remove_html, HTML), (remove_urls, URL), (remove_emails, EMAIL), (remove_special_chars, SPECIAL), (remove_numbers, DIGITS)):
        if wanted:
            out = F.regexp_replace(out, _u(pattern), " ")
    if lowercase:
        out = F.lower(out)
    if remove_extra_spaces:
        out = F.trim(F.regexp_replace(out, _u(WHITE), " "))
    return out


def words(text: Column) -> Column:
    """Words between white space; none are empty."""
    return F.filter(F.split(text, _u(WHITE)), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Parts between runs of . ! and ?, with their blanks and the empty end."""
    return F.split(text, r"[.!?]+")


def without_stop_words(text: Column, stop_words: Iterable[str] | None = None) -> Column:
    """Words that are no stop words, joined by single blanks; null and empty stay."""
    stop = F.array(*[F.lit(w) for w in (STOP_WORDS if stop_words is None else stop_words)]).cast("array<string>")
    kept = F.array_join(F.filter(words(text), lambda w: ~F.array_contains(stop, F.lower(w))), " ")
    return F.when(text.isNull() | (text == ""), text).otherwise(kept)


def language(text: Column) -> Column:
    """'english' if two or more of its commonest words occur, else 'other'."""
    known = F.array(*[F.lit(w) for w in ENGLISH])
    return F.when(F.size(F.array_intersect(words(F.lower(F.coalesce(text, F.lit("")))), known)) >= 2, "english").otherwise("other")


def features(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    w = words(t)
    letters = F.aggregate(w, F.lit(0), lambda n, x: n + F.length(x))
    return {
        "length": F.length(t).cast("long"),
        "word_count": F.size(w).cast("long"),
        "upper_count": F.regexp_count(t, F.lit("[A-Z]")).cast("long"),
        "digit_count": F.regexp_count(t, F.lit(_u(r"\d"))).cast("long"),
        "special_char_count": F.regexp_count(t, F.lit(PUNCTUATION)).cast("long"),
        "avg_word_len": F.coalesce(F.try_divide(letters.cast("double"), F.size(w).cast("double")), F.lit(0.0)),
    }
