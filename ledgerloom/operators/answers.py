"""What a model answered: the JSON object inside its text, and fields that it wrapped although it was asked not to."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARKS = re.compile(r'["{}\\]')


def object_span(text: str | None, begin: int = 0) -> str | None:
    """The text from the first opening brace at or after `begin` to the brace that closes it; braces inside strings do not count. None if it stays open."""
    start = text.find("{", begin) if text else -1
    if start < 0:
        return None
    depth, in_string, at = 0, False, start
    while (m := _MARKS.search(text, at)) is not None:
        at = m.end()
        if m[0] == "\\":
            # What follows inside a string is not looked at.
            at += in_string
        elif m[0] == '"':
            in_string = not in_string
        elif not in_string:
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return text[start:at]
    return None


def _spans(texts: pd.Series) -> pd.Series:
    """All outermost spans of each text, in order."""
    out = []
    for text in texts:
        spans, at = [], 0
        while (span := object_span(text, at)) is not None:
            spans.append(span)
            at = text.index(span, at) + len(span)
        out.append(spans)
    return pd.Series(out)


def model_object(df: DataFrame, text: str) -> DataFrame:
    """df with `answer`, the first JSON object that stands in the text, as a VARIANT, and `error`: no_json if there is none, not_object if the whole text is another JSON value.

    Prose around the object, and braces in prose that are no JSON, do not matter. NULL text: no_json.
    """
    spans = F.pandas_udf(_spans, "array<string>")
    valid = F.filter(spans(F.col(text)), lambda s: F.try_parse_json(s).isNotNull())
    kind = F.schema_of_variant(F.try_parse_json(F.col(text)))
    held = df.withColumns({"_span": F.get(valid, F.lit(0)), "_kind": kind})
    other = F.col("_kind").isNotNull() & ~F.col("_kind").startswith("OBJECT")
    answer = F.when(~F.coalesce(other, F.lit(False)), F.try_parse_json("_span"))
    error = F.when(F.coalesce(other, F.lit(False)), "not_object").when(F.col("_span").isNull(), "no_json")
    return held.withColumns({"answer": answer, "error": error}).drop("_span", "_kind")


def unwrapped_fields(item: Column, names: list[str]) -> dict[str, Column]:
    """Columns for the fields `names` of a VARIANT object, and for its page and quote.

    A field may stand plainly or as an object with `value` and `source`. Page and quote are the item's own, else those of the first wrapped
    field, in the order of names, whose source has a whole number as page or a string as quote; a wrapped page or quote counts by its value.
    """
    part = lambda path: F.try_variant_get(item, path, "variant")
    kind = lambda path: F.schema_of_variant(part(path))
    wrapped = lambda n: F.coalesce(kind(f"$.{n}").rlike(r"^OBJECT<(.*, )?value: "), F.lit(False))
    plain = lambda n, t: F.when(wrapped(n), F.try_variant_get(item, f"$.{n}.value", t)).otherwise(F.try_variant_get(item, f"$.{n}", t))
    out = {n: plain(n, "string") for n in names}
    pages = [F.when(wrapped(n) & (kind(f"$.{n}.source.page") == "BIGINT"), F.try_variant_get(item, f"$.{n}.source.page", "long")) for n in names]
    quotes = [F.when(wrapped(n) & (kind(f"$.{n}.source.quote") == "STRING"), F.try_variant_get(item, f"$.{n}.source.quote", "string")) for n in names]
    return out | {"page": F.coalesce(plain("page", "long"), *pages), "quote": F.coalesce(plain("quote", "string"), *quotes)}
