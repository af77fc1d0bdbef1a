"""Layout of recognised tokens: rows, column marks, and repeated boxes. A page is a small group and order decides, so these run page by page."""

from __future__ import annotations

import math
import re
from bisect import insort
from collections.abc import Callable, Iterator
from operator import itemgetter
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AMOUNT = re.compile(r"\d{1,3}(?:[ .]\d{3})*[.,]\d{2}")
TOKENS = "text string, x0 double, y0 double, x1 double, y1 double"


def _page_by_page(rows: DataFrame, key: str, names: list[str], work: Callable[[list[tuple]], list[tuple]], columns: str) -> DataFrame:
    """(key, columns) of what `work` makes of each page's rows (tuples of `names`). A page is one row of an Arrow batch, so that no page costs a call of its own."""
    pages = rows.select(F.col(key).cast("string").alias(key), *names).groupBy(key).agg(F.collect_list(F.struct(*names)).alias("_rows"))  # a page's tokens
    schema = f"{key} string, {columns}"
    out = pages.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1)
            whole = held.flatten()
            # A number that is missing is NaN.
            fields = [c.to_pylist() if pa.types.is_string(c.type) else c.to_numpy(zero_copy_only=False).tolist() for c in whole.flatten()]
            each = list(zip(*fields, strict=True))
            start, made = 0, []
            for k, n in zip(batch.column(0).to_pylist(), held.value_lengths().to_pylist(), strict=True):
                made.extend((k, *r) for r in work(each[start : start + n]))
                start += n
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made, strict=True) if made else [[]] * len(out), out, strict=True)], schema=out)

    return pages.mapInArrow(run, schema)


def _middle_of(values: list[float]) -> float:
    """The median of sorted values."""
    n = len(values)
    return values[n // 2] if n % 2 else (values[n // 2 - 1] + values[n // 2]) / 2


def layout_rows(tokens: DataFrame, key: str, loose: float = 0.60, overlap: float = 0.55) -> DataFrame:
    """(key, row, line): tokens (key, text, x0, y0, x1, y1) put into rows; amounts under a debit or credit heading are marked.

    Tokens come in order of (y, x) and join the nearest of the last four rows that they overlap enough or lie close to.
    """

    def rows(page: list[tuple]) -> list[tuple]:
        limit = max(3.0, loose * median(y1 - y0 for _, _, y0, _, y1 in page))
        # Tokens of a row, their tops and bottoms in order, and the medians of these.
        open_rows: list[list] = []
        for t in sorted(page, key=lambda t: ((t[2] + t[4]) / 2, t[1])):
            y0, y1 = t[2], t[4]
            near = None
            for r in open_rows[-4:]:
                top, bottom = r[3], r[4]
                shared = max(0.0, min(bottom, y1) - max(top, y0)) / max(1e-9, min(bottom - top, y1 - y0))
                away = abs((y0 + y1) / 2 - (top + bottom) / 2)
                if (shared >= overlap or away <= limit) and (near is None or away < near[0]):
                    near = away, r
            if near:
                r = near[1]
                r[0].append(t)
                insort(r[1], y0)
                insort(r[2], y1)
                r[3:] = _middle_of(r[1]), _middle_of(r[2])
            else:
                open_rows.append([[t], [y0], [y1], y0, y1])
        middle = lambda t: (t[1] + t[3]) / 2
        debit = credit = None
        out = []
        for r, *_ in open_rows:
            r.sort(key=itemgetter(1))
            heads = {t[0].strip().upper(): t for t in r}
            if "DEBIT" in heads and "CREDIT" in heads:
                debit, credit = middle(heads["DEBIT"]), middle(heads["CREDIT"])
                out.append(" | ".join(t[0] for t in r))
                continue
            cells = []
            for t in r:
                amount = _AMOUNT.fullmatch(t[0])
                if amount and debit is not None:
                    cells.append(("CREDIT: " if middle(t) >= (debit + credit) / 2 else "DEBIT: " if middle(t) >= debit - 0.65 * (credit - debit) else "") + t[0])
                else:
                    cells.append(t[0])
            out.append(" | ".join(cells))
        return list(enumerate(out))

    return _page_by_page(tokens, key, ["text", "x0", "y0", "x1", "y1"], rows, "row int, line string")


def box_dedupe(boxes: DataFrame, key: str, share: float = 0.72) -> DataFrame:
    """Boxes (key, text, confidence, x0, y0, x1, y1) in order of confidence without those that cover the same region as a kept one."""

    def keep(page: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        # Missing confidences and texts come last.
        for b in sorted(page, key=lambda b: (math.isnan(b[1]), 0.0 if math.isnan(b[1]) else -b[1], b[0] is None, b[0] or "")):
            _, _, x0, y0, x1, y1 = b
            size = (x1 - x0) * (y1 - y0)
            for o in kept:
                both = max(0.0, min(x1, o[4]) - max(x0, o[2])) * max(0.0, min(y1, o[5]) - max(y0, o[3]))
                if both >= share * min(size, (o[4] - o[2]) * (o[5] - o[3])):
                    break
            else:
                kept.append(b)
        return kept

    names = ["text", "confidence", "x0", "y0", "x1", "y1"]
    return _page_by_page(boxes, key, names, keep, "text string, confidence double, x0 double, y0 double, x1 double, y1 double")
