"""Text expressions: the five ways in which the engine reads words, and what is built on them.

tok_index   search index: letters, digits and private-use characters, lower case, without accents; `_` separates
tok_rank    ranking and analysis: words with accents kept, case folded; `_` separates
words       query words: `_` stays inside a word
tok_fold    typo search: words without accents, `_` kept
gram_text   n-gram similarity: words with accents, joined by one space

All are built-in expressions; each has a twin for one string on the driver.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "([\\p{L}\\p{N}_]+)"
INDEX_WORD = "([\\p{L}\\p{N}\\p{Co}]+)"
INDEX_RUN = "[\\p{L}\\p{N}\\p{Co}][\\p{L}\\p{N}\\p{Co}\\u0300-\\u036f]*"
PY_WORD = re.compile(r"\w+")


@cache
def accent_pairs() -> tuple[str, str]:
    """Accented Latin letters below U+0250 and their base letters, by canonical decomposition."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def no_accents(x: Column) -> Column:
    marked, plain = accent_pairs()
    return F.regexp_replace(F.translate(x, marked, plain), "[\\u0300-\\u036f]", "")


def casefold(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def text_of(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def tok_index(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(no_accents(text_of(x))), F.lit(INDEX_WORD), F.lit(1))


def n_tok_index(x: Column) -> Column:
    """How many tokens tok_index gives. Accented letters are letters as their bases are, and the marks that it drops stand within a run; lower case is of a newer Unicode than the pattern, which knows only the small one of some letters."""
    return F.size(F.regexp_extract_all(F.lower(text_of(x)), F.lit(INDEX_RUN), F.lit(0)))


def tok_rank(x: Column) -> Column:
    return F.regexp_extract_all(casefold(F.replace(text_of(x), F.lit("_"), F.lit(" "))), F.lit(WORD), F.lit(1))


def tok_fold(x: Column) -> Column:
    return F.regexp_extract_all(fold(text_of(x)), F.lit(WORD), F.lit(1))


def fold(x: Column) -> Column:
    return no_accents(casefold(x))


def gram_text(x: Column) -> Column:
    return F.array_join(F.regexp_extract_all(casefold(text_of(x)), F.lit(WORD), F.lit(1)), " ")


def grams(x: Column, n: int = 3) -> Column:
    """Character n-grams in order; none where the text is shorter. One pass of a look-ahead: `substring` would count from the start for each."""
    found = F.regexp_extract_all(x, F.lit(f"(?s)(?![\\uDC00-\\uDFFF])(?=(.{{{n}}}))"), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def one_no_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def one_tok_index(text: str) -> list[str]:
    plain = unicodedata.normalize("NFC", one_no_accents(text)).lower()
    return "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in plain).split()


def one_words(text: str) -> list[str]:
    return PY_WORD.findall(text)


def one_tok_fold(text: str) -> list[str]:
    return PY_WORD.findall(one_no_accents(text.casefold()))


def one_gram_text(text: str) -> str:
    return " ".join(PY_WORD.findall(text.casefold()))


def one_grams(text: str, n: int = 3) -> list[str]:
    return [text[i : i + n] for i in range(len(text) - n + 1)]


def snippet(content: Column, terms: list[str], around: int = 80) -> Column:
    """The text around the earliest term, cut marks at open ends; its start where no term occurs."""
    body = text_of(content)
    places = [F.nullif(F.locate(t, casefold(body)), F.lit(0)) for t in terms] or [F.lit(None).cast("int")]
    at = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(1))
    start, width = F.greatest(at - around, F.lit(1)), F.lit(2 * around)
    return F.concat(F.when(start > 1, F.lit("…")).otherwise(""), F.trim(F.regexp_replace(F.substring(body, start, width), "\\s+", " ")), F.when(start + width <= F.length(body), F.lit("…")).otherwise(""))


def short_snippet(content: Column, most: int = 200) -> Column:
    """White space collapsed, cut at the last space before `most` characters."""
    flat = F.trim(F.regexp_replace(text_of(content), "\\s+", " "))
    head = F.substring(flat, 1, most)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.coalesce(F.nullif(F.regexp_extract(head, "^(.*)\\s", 1), F.lit("")), head), F.lit(" ...")))


def normal_query(x: Column) -> Column:
    return F.trim(F.regexp_replace(casefold(text_of(x)), "\\s+", " "))


def from_json_or(x: Column, ddl: str, default: Column) -> Column:
    """A JSON column read by a schema; null, torn or other JSON gives the default."""
    return F.coalesce(F.from_json(x, ddl), default)


def edit_budget(token: Column) -> Column:
    """Edits that a token may be off: none below 4 letters, one below 8, else two."""
    return F.when(F.length(token) < 4, 0).when(F.length(token) < 8, 1).otherwise(2)


def nonsense(folded: Column) -> Column:
    return (F.length(folded) < 3) | folded.rlike("^(.)\\1*$") | ~folded.rlike("[aeiou]")


def identity(source: Column, path: Column) -> Column:
    """A document's id: stable while its content changes."""
    return F.sha2(F.concat(source, F.lit("\0"), path).cast("binary"), 256)
