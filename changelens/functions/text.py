"""Text normalisation as Column functions.

Everything but Unicode compatibility folding stays in the JVM. folded() is the one Arrow function,
for texts that did not come through block extraction (which folds already); the functions below
take folded texts. It stands outside of them because a Python function cannot stand inside a
lambda over lines or blocks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schema import BOILERPLATE_LOCATIONS, MAX_SNIPPET
from .patterns import DYNAMIC_GATES, DYNAMIC_TOKENS, NEEDS, SECRETS, any_case, exact_case

ZERO_WIDTH = "[\u200b-\u200f\u202a-\u202e\ufeff]"
#: Found wherever collapsing a text changes more than its ends: two spaces, or any white space or mark but the plain space. Most texts hold none, and looking costs far less than replacing.
_UNEVEN = "  |[\u0009-\u000d\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200f\u2028-\u202f\u205f\u3000\ufeff]"
#: Quotes and dashes that a canonical text has in their plain form.
STRAIGHT = {"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-"}


def _steady() -> str:
    """Runs of 16 characters or more, below U+0600, that compatibility composition never changes, as the inside of a character class."""
    kept = [not unicodedata.combining(c := chr(i)) and unicodedata.category(c)[0] != "M" and unicodedata.normalize("NFKC", c) == c for i in range(0x600)]
    runs, start = [], 0
    for i in range(len(kept) + 1):
        if i == len(kept) or not kept[i]:
            if i - start >= 16:
                runs.append(f"\\u{start:04x}-\\u{i - 1:04x}")
            start = i + 1
    return "".join(runs)


#: Texts of these characters only are folded already: the runs, and common signs between them.
_FOLDED = f"^[{_steady()}\u00a1-\u00a7\u00ab\u00ac\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf\u2010\u2012-\u2016\u2018-\u2023\u20ac]*+\\z"
#: What every pattern of DYNAMIC_TOKENS needs somewhere: a digit, a query parameter or a run of hexadecimal letters.
_MAYBE_DYNAMIC = (r"(?U)[\d?&]", "[a-fA-F]{6}")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(df: DataFrame) -> DataFrame:
    """df behind a boundary that filters are not pushed through.

    Filters on columns at the end of a long chain of expressions would otherwise be rewritten in
    terms of its start, and every column on the way be copied into them many times over.
    """
    return df.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition; ASCII texts pass through."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def folded(c: Column | str) -> Column:
    """A text in Unicode compatibility composition; only texts that may change go to Python."""
    text = _col(c)
    return F.coalesce(nfkc(F.when(~text.rlike(_FOLDED), text)), text)


def collapse_whitespace(c: Column | str) -> Column:
    """Runs of white space as one space, ends trimmed, zero-width and direction marks dropped; null as empty."""
    text = F.coalesce(_col(c), F.lit(""))
    return F.trim(F.when(text.rlike(_UNEVEN), F.regexp_replace(F.regexp_replace(text, ZERO_WIDTH, ""), r"(?U)\s+", " ")).otherwise(text))


def strip_dynamic_tokens(c: Column | str) -> Column:
    """Values that change with every page load, as placeholders."""
    # Placeholders stand in signs that no token holds, so a token of the text on the way is one of the given text, and the gates are asked there.
    step = lambda gate, token: lambda x: F.when(_col(c).rlike(gate), F.regexp_replace(x, any_case(token[0]), token[1])).otherwise(x)
    masked = reduce(lambda x, pair: let(x, step(*pair)), zip(DYNAMIC_GATES, DYNAMIC_TOKENS, strict=True), _col(c))
    return F.when(_col(c).rlike(_MAYBE_DYNAMIC[0]) | _col(c).rlike(_MAYBE_DYNAMIC[1]), masked).otherwise(_col(c))


def casefold(c: Column | str) -> Column:
    """Lower case with the foldings that lower() leaves out and that remain after NFKC."""
    return F.replace(F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def canonicalise(c: Column | str) -> Column:
    """The form in which two texts are compared: collapsed, masked, lower case, quotes and dashes straightened, ends stripped."""
    return let(collapse_whitespace(c), canonical_form)  # named several times


def canonical_form(collapsed: Column | str) -> Column:
    """canonicalise() of a text whose white space is collapsed already."""
    straight = reduce(lambda x, sign: F.replace(x, F.lit(sign[0]), F.lit(sign[1])), STRAIGHT.items(), casefold(strip_dynamic_tokens(collapsed)))
    return F.btrim(straight, F.lit(" .,;:!•|-"))  # placeholders are not empty, so no spaces meet


def content_hash(c: Column | str) -> Column:
    return F.sha2(canonicalise(c).cast("binary"), 256)


def normalize_text(c: Column | str) -> Column:
    """Lines collapsed, blank ones dropped."""
    lines = F.transform(F.split(F.coalesce(_col(c), F.lit("")), "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"), collapse_whitespace)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def word_count(c: Column | str) -> Column:
    return F.regexp_count(F.coalesce(_col(c), F.lit("")), F.lit(r"(?U)\S+"))


_ENDS = r"(?U)^\s+|\s+$"


def _cut(stripped: Column, limit: int) -> Column:
    cut = lambda t: F.concat(F.regexp_replace(F.left(t, F.lit(limit - 1)), _ENDS, ""), F.lit("…"))
    return let(stripped, lambda t: F.when(F.length(t) > limit, cut(t)).otherwise(t))


def truncate(c: Column | str, limit: int = MAX_SNIPPET) -> Column:
    """At most `limit` characters, the last an ellipsis where text was cut."""
    return _cut(F.regexp_replace(F.coalesce(_col(c), F.lit("")), _ENDS, ""), limit)


def shorten(c: Column | str, limit: int) -> Column:
    """White space joined, then truncated."""
    text = F.coalesce(_col(c), F.lit(""))
    return _cut(F.trim(F.when(text.rlike(_UNEVEN), F.regexp_replace(text, r"(?U)\s+", " ")).otherwise(text)), limit)


def redact_secrets(c: Column | str, literals: tuple[str, ...] = ()) -> Column:
    """Known secret values, then anything shaped like a credential, replaced."""
    known = reduce(lambda x, s: F.replace(x, F.lit(s), F.lit("[redacted]")), [s for s in literals if len(s) >= 8], _col(c))
    return reduce(lambda x, p: F.regexp_replace(x, any_case(p[0]) if p[2] else exact_case(p[0]), p[1]), SECRETS, known)


def is_boilerplate(location: Column | str) -> Column:
    return _col(location).isin(*BOILERPLATE_LOCATIONS)


def matches(c: Column | str, pattern: str) -> Column:
    return F.coalesce(_col(c), F.lit("")).rlike(any_case(pattern))


def words_of(c: Column | str, names: tuple[str, ...]) -> Column:
    """The words of a folded text that matches of the named patterns need: found in one pass, for all patterns."""
    needed = sorted({w for n in names for w in NEEDS[n]})
    # Of the letters beyond ASCII that patterns take for one of a-z, folded texts keep the two Turkish ones.
    plain = F.lower(F.translate(_col(c), "\u0130\u0131", "ii"))
    return F.array_intersect(F.split(plain, "[^a-z0-9]+"), F.array(*map(F.lit, needed)))


def if_words(words: Column | str, name: str, found: Column, otherwise: Column) -> Column:
    """`found`, a search for the named pattern, only where the words that it needs are there."""
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, NEEDS[name]))), found).otherwise(otherwise)


def summarise_error(error: BaseException) -> str:
    """Type, HTTP status and cause of an error, never its message."""
    status = next((v for v in (getattr(error, "status_code", None), getattr(getattr(error, "response", None), "status_code", None)) if v), None)
    cause = error.__cause__ or error.__context__
    return type(error).__name__ + (f" (HTTP {status})" if status else "") + (f" caused by {type(cause).__name__}" if cause else "")
