"""Fill-in-the-middle examples cut at unit ranks (operator 13).

A unit is a run of ASCII letters or any other single code point. One Aho-Corasick automaton scans a text for
its events: pairs of characters where the class changes between letter and other, and the sentinels. The
gaps between events are all of one class, so a gap of letters is one unit and any other as many units as it
is long. Ranks are looked up in the prefix sums of the gaps; nothing is held for each unit.
"""

from __future__ import annotations

import string
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Hundredths of all documents that stay as they are, and of the others those with the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
SEED = "1"
#: Marks an event as a sentinel's; positions in a text are below it.
_SENTINEL = 1 << 62


@lru_cache(1)
def _automaton():
    """ASCII letter before other, other before letter, and the sentinels."""
    import ahocorasick

    letters = string.ascii_letters
    found = ahocorasick.Automaton()
    for other in map(chr, range(128)):
        if other not in letters:
            for letter in letters:
                found.add_word(letter + other, 0)
                found.add_word(other + letter, 0)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(sentinel, _SENTINEL)
    found.make_automaton()
    return found


def unit_gaps(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """Starts of the gaps (and the text's end), units before each of them, and whether the text holds a sentinel."""
    # Whatever is not ASCII is an other: `?` stands for it, one for each code point.
    shadow = text.encode("ascii", "replace").decode("ascii")
    events = np.array([at + kind for at, kind in _automaton().iter(shadow)], dtype=np.int64)
    sentinel = events >= _SENTINEL
    starts = np.concatenate([[0], events[~sentinel], [len(text)]]).astype(np.int64)
    units = np.diff(starts)
    # Classes alternate from gap to gap.
    first_of_letters = 0 if shadow[:1].isalpha() else 1
    units[first_of_letters::2] = np.minimum(units[first_of_letters::2], 1)
    return starts, np.concatenate([[0], np.cumsum(units)]), bool(sentinel.any())


def offset_of_rank(rank: int, starts: np.ndarray, before: np.ndarray) -> int:
    """Code points before the unit of that rank; the number of units: the text's length."""
    gap = int(np.searchsorted(before, rank, side="right")) - 1
    # In a gap of letters only its start is looked up.
    return int(starts[gap] + rank - before[gap])


def cuts(texts: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
    """Units of a text, the code points before the two drawn ranks in order, and whether a sentinel is in it."""
    rows = []
    for text, a, b in zip(texts, one, two, strict=True):
        starts, before, marked = unit_gaps(text)
        n = int(before[-1])
        low, high = sorted((a % (n + 1), b % (n + 1)))
        rows.append((n, offset_of_rank(low, starts, before), offset_of_rank(high, starts, before), marked))
    return pd.DataFrame(rows, columns=["n", "first", "second", "marked"])


def _drawn(key: Column, k: int) -> Column:
    """The k-th number of eight hex digits, from 0, of the digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def infilled(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as training examples: doc_id, n units, form, prefix_chars, middle_chars, output.

    Null text: empty. Empty texts and texts that hold a sentinel are plain: the output is the text. A null doc_id draws
    as an empty one; rows that share doc_id draw alike, each from its own text. Texts of any length; other columns are
    not read.
    """
    at = F.col("doc_id")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    find = F.pandas_udf(cuts, "n bigint, first bigint, second bigint, marked boolean")
    cut = rows.withColumn("cut", find("text", _drawn(at, 0), _drawn(at, 1)))
    plain = (F.col("text") == "") | F.col("cut.marked") | (_drawn(at, 2) % 100 >= 100 - PLAIN_PERCENT)
    form = F.when(plain, "plain").when(_drawn(at, 3) % 100 < SPM_PERCENT, "spm").otherwise("psm")
    formed = cut.select("doc_id", "text", F.col("cut.n").alias("n"), form.alias("form"), F.col("cut.first").cast("int").alias("first"), F.col("cut.second").cast("int").alias("second"))
    text, first, second = F.col("text"), F.col("first"), F.col("second")
    prefix, middle, suffix = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first), F.substring(text, second + 1, F.length(text))
    parts = {"psm": (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle), "spm": (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)}
    joined = {k: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in v]) for k, v in parts.items()}
    is_cut = F.col("form") != "plain"
    return formed.select(
        "doc_id", "n", "form", F.when(is_cut, first.cast("long")).alias("prefix_chars"), F.when(is_cut, (second - first).cast("long")).alias("middle_chars"),
        F.when(F.col("form") == "psm", joined["psm"]).when(F.col("form") == "spm", joined["spm"]).otherwise(text).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an example was made of, from its output and form; no sentinel is in a text that was cut."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as examples, with digests of the output and of the text rebuilt from it."""
    out = infilled(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}

ORACLE = {
    "op13_fill_in_middle": """
with t as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h,
           regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u from documents),
d as (select *, len(u) as n, [cast('0x' || substr(h, 8 * k + 1, 8) as bigint) for k in range(4)] as g from t),
f as (select *, least(g[1] % (n + 1), g[2] % (n + 1)) as a, greatest(g[1] % (n + 1), g[2] % (n + 1)) as b,
      case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or g[3] % 100 >= 90 then 'plain'
           when g[4] % 100 < 20 then 'spm' else 'psm' end as form from d),
p as (select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:], '') as suf from f)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
       sha256(case form when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid when 'spm' then '<S>' || suf || '<P>' || pre || '<M>' || mid else text end) as output_sha256,
       sha256(text) as restored_sha256 from p
""",
}
