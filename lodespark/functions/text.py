"""Column functions on text: normalisers, tokens, phrases, identifiers, snippets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words that carry no meaning in a title.
TITLE_STOP_WORDS = ("and", "are", "based", "data", "dataset", "datasets", "during", "for", "from", "human", "mouse", "neural", "neuronal", "of", "the", "using", "with")

#: Patterns that deny a result.
NEGATIONS = (
    r"\bdid\s+not\b", r"\bdoes\s+not\b", r"\bdo\s+not\b", r"\bwas\s+not\b", r"\bwere\s+not\b", r"\bno\s+significant\b", r"\bno\s+effect\b", r"\bnot\s+significantly?\b", r"\bfailed\s+to\b",
    r"\babsence\s+of\b", r"\bnot\s+observed\b", r"\bnot\s+activated?\b", r"\bno\s+longer\b", r"\bbut\s+not\b", r"\bno\s+increase\b", r"\bno\s+decrease\b", r"\bunchanged\b",
)


def negated(x: Column) -> Column:
    """Whether a text denies or contradicts a result; null is no denial."""
    return F.coalesce(F.lower(x).rlike("|".join(NEGATIONS)), F.lit(False))


def normalize(x: Column) -> Column:
    """Lower case; runs of anything but letters, digits and + become one space; trimmed. Null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[/_-]+", " "), "[^a-z0-9+]+", " "))


def snake(x: Column) -> Column:
    """Lower case words joined by single underscores."""
    return F.array_join(F.filter(F.split(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "_"), lambda w: w != ""), "_")


def tokens(x: Column) -> Column:
    """Words of the normalised text; an empty array for texts without any."""
    return F.filter(F.split(normalize(F.coalesce(x, F.lit(""))), " "), lambda w: w != "")


def with_bigrams(words: Column) -> Column:
    """The words and their adjacent pairs ``a_b``; one word has no pair. ``words`` is computed once, however long its expression."""

    def both(w: Column) -> Column:
        pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))
        return F.concat(w, pairs)

    return F.get(F.transform(F.array(words), both), F.lit(0))


def counted(words: Column) -> Column:
    """The words, each as (len, term) with the number of all of them; computed once."""
    return F.get(F.transform(F.array(words), lambda w: F.transform(w, lambda t: F.struct(F.size(w).alias("len"), t.alias("term")))), F.lit(0))


def contains_phrase(normalized: Column, phrase: Column | str) -> Column:
    """Whole-phrase match in a normalised text: no word character next to it."""
    p = F.lit(phrase) if isinstance(phrase, str) else phrase
    return F.concat(F.lit(" "), normalized, F.lit(" ")).contains(F.concat(F.lit(" "), p, F.lit(" ")))


def title_tokens(x: Column) -> Column:
    """Distinct tokens of four letters or more that are no stop words."""
    return F.array_sort(F.array_distinct(F.filter(tokens(x), lambda w: (F.length(w) >= 4) & ~w.isin(*TITLE_STOP_WORDS))))


def normalize_doi(x: Column) -> Column:
    """A bare lower-case DOI: no resolver address, ``doi:`` prefix, white space or trailing punctuation; empty becomes null."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(x, r"\s+", "")), r"^(https?://)?(dx\.)?(doi\.org/)?(doi:)?", "")
    return F.nullif(F.regexp_replace(bare, r"[.,;)\]]+$", ""), F.lit(""))


def extract_dois(x: Column) -> Column:
    """All DOIs in a text, in order, distinct."""
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(r"(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)"), 1), lambda d: F.regexp_replace(F.lower(d), r"[.,;)]+$", "")))


def snippet(text: Column, term: Column | str, before: int = 48, after: int = 72) -> Column:
    """The text around the first hit of a term (case ignored), null without a hit."""
    t = F.lower(F.lit(term) if isinstance(term, str) else term)
    at = F.position(t, F.lower(text))
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substr(text, start, at + F.length(t) + after - start))


def rank_bucket(rank: Column) -> Column:
    """1, 2-3, 4-5, 6-10 or 11+; unranked for null."""
    return F.when(rank.isNull(), "unranked").when(rank <= 1, "1").when(rank <= 3, "2-3").when(rank <= 5, "4-5").when(rank <= 10, "6-10").otherwise("11+")


def strip_html(x: Column) -> Column:
    """Visible text: scripts, styles, comments and tags removed, white space collapsed."""
    no_code = F.regexp_replace(x, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(no_code, r"(?s)<[^>]*>", " "), r"\s+", " "))


def url_host(x: Column) -> Column:
    """Host in lower case without a leading ``www.``."""
    return F.regexp_replace(F.lower(F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")
