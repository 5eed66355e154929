"""Reading narration payloads: finding the JSON object in a text, repairing it, and coercing its fields."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schema import CATEGORIES
from .patterns import CATEGORY_ALIASES, SCORE_WORDS, TRUE_WORDS
from .text import _col

PAYLOAD = "title string, category string, summary string, before string, after string, business_impact string, recommended_action string, relevance_score string, confidence string, is_meaningful string"


class _Scan:
    """Brackets that are open at the end of a text, whether a string is open, and where the first object ends."""

    def __init__(self, text: str) -> None:
        self.open, self.in_string, self.end = [], False, -1
        skip = False
        for i, ch in enumerate(text):
            if skip:
                skip = False
            elif ch == "\\":
                skip = True
            elif ch == '"':
                self.in_string = not self.in_string
            elif not self.in_string and ch in "{[":
                self.open.append("}" if ch == "{" else "]")
            elif not self.in_string and ch in "}]" and self.open:
                self.open.pop()
                if not self.open and self.end < 0:
                    self.end = i + 1


def _load(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def _no_trailing_commas(text: str) -> str:
    return re.sub(r",\s*([}\]])", r"\1", text)


def find_object(text: str | None) -> dict | None:
    """The JSON object that a text holds: fenced, bare, after prose, with trailing commas, or cut off; None without one."""
    if not text or not text.strip():
        return None
    fenced = re.search(r"```(?:json)?\s*(.+?)\s*```", text, re.DOTALL | re.IGNORECASE)
    body = fenced[1] if fenced else text.strip()
    whole = _load(body)
    if isinstance(whole, list) and whole:
        whole = whole[0]
    if isinstance(whole, dict):
        return whole
    start = body.find("{")
    if start < 0:
        return None
    body = body[start:]
    scan = _Scan(body)
    if scan.end > 0:
        found = _load(_no_trailing_commas(body[: scan.end]))
        if isinstance(found, dict):
            return found
    # Cut off: keep the complete fields and close what is open. No value is made up.
    if scan.in_string:
        comma = body.rfind(",")
        body = body[:comma] if comma > 0 else body + '"'
    for dangling in (r",\s*\"[^\"]*\"\s*:\s*$", r",\s*$"):
        body = re.sub(dangling, "", body.rstrip())
    found = _load(_no_trailing_commas(body + "".join(reversed(scan.open))))
    return found if isinstance(found, dict) else None


@F.pandas_udf(StringType())
def extract_json(texts: pd.Series) -> pd.Series:
    """The object of each text as clean JSON, null where there is none."""
    return texts.map(lambda t: None if (found := find_object(t)) is None else json.dumps(found, ensure_ascii=False))


def coerce_category(c: Column | str) -> Column:
    text = F.lower(F.trim(F.coalesce(_col(c), F.lit(""))))
    out = F.when(text.isin(*CATEGORIES), text)
    for alias, category in CATEGORY_ALIASES.items():
        out = out.when(text == alias, category)
    return out.otherwise("other")


def _number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


def coerce_score(c: Column | str) -> Column:
    """0..100 from numbers, percentages, words and 0..1 scales; 50 where unreadable."""
    text = F.regexp_replace(F.trim(_col(c)), "%+$", "")
    word = None
    for name, value in SCORE_WORDS.items():
        hit = F.lower(text) == name
        word = F.when(hit, value) if word is None else word.when(hit, value)
    n = _number(text)
    scaled = F.when((n > 0) & (n <= 1), n * 100).otherwise(n)
    return F.coalesce(word, F.when(n.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), scaled))), F.lit(50.0))


def coerce_confidence(c: Column | str) -> Column:
    """0..1 from numbers and percentages; 0.5 where unreadable."""
    n = _number(_col(c))
    return F.when(n.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(n > 1, n / 100).otherwise(n))))


def coerce_bool(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(_col(c))).isin(*TRUE_WORDS), F.lit(True))


def coerce_text(c: Column | str) -> Column:
    """A JSON list as its items joined by spaces; null as empty."""
    items = F.from_json(_col(c), "array<string>")
    return F.coalesce(F.when(F.startswith(F.ltrim(_col(c)), F.lit("[")), F.array_join(items, " ")), _col(c), F.lit(""))


def read_payload(c: Column | str) -> Column:
    """A payload text as a struct of coerced fields; null where it holds no object."""
    raw = F.from_json(extract_json(_col(c)), PAYLOAD)
    return F.when(
        raw.isNotNull(),
        F.struct(
            coerce_text(raw["title"]).alias("title"), coerce_category(raw["category"]).alias("category"), coerce_text(raw["summary"]).alias("summary"), raw["before"].alias("before"), raw["after"].alias("after"),
            coerce_text(raw["business_impact"]).alias("business_impact"), raw["recommended_action"].alias("recommended_action"), coerce_score(raw["relevance_score"]).alias("relevance_score"),
            coerce_confidence(raw["confidence"]).alias("confidence"), coerce_bool(raw["is_meaningful"]).alias("is_meaningful"),
        ),
    )
