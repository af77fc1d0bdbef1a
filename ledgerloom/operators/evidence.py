"""Where a value comes from: citations checked against their page, passages found in texts, and what may be written into a field."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import collapse, strip_white

#: Texts and passages that are searched in one group.
TEXT_BLOCK, PASSAGE_BLOCK = 2048, 1 << 16


def verified_sources(fields: DataFrame, pages: DataFrame, key: str, page: str = "page", text: str = "text") -> DataFrame:
    """fields (key, field, value, page, quote, ...) with `verified`; page and quote of what is not verified are NULL.

    A field is verified if it has a value and its quote occurs on the page that it names, without regard to case and white space. pages:
    (key, page, text), one row a page. Fields without a quote, without a page, or with a page that the document lacks, are not verified. Each field
    meets its own page alone.
    """
    shown = pages.select(F.col(key).alias("_key"), F.col(page).alias("_page"), F.col(text).alias("_text"))
    met = fields.join(shown, (F.col(key) == F.col("_key")) & (F.col("page") == F.col("_page")), "left")
    quote = collapse(F.col("quote"))
    verified = F.coalesce(F.col("value").isNotNull() & (quote != "") & collapse(F.col("_text")).contains(quote), F.lit(False))
    out = met.withColumn("verified", verified).drop("_key", "_page", "_text")
    return out.withColumns({c: F.when(F.col("verified"), F.col(c)) for c in ("page", "quote")})


def recoverable(value: Column, verified: Column) -> Column:
    """Whether a later rule may fill the field: it has no value, or no citation proves it."""
    return (F.coalesce(strip_white(value.cast("string")), F.lit("")) == "") | ~F.coalesce(verified, F.lit(False))


def released_fields(fields: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """fields with recoverable ones emptied, so that rules may fill them: no value and source, confidence 0; `released` says which had a value."""
    checked = verified_sources(fields, pages, key)
    gone = recoverable(F.col("value"), F.col("verified"))
    had = checked.withColumns({"gone": gone, "released": gone & F.col("value").isNotNull()})
    return had.withColumns({"value": F.when(~F.col("gone"), F.col("value")), "confidence": F.when(F.col("gone"), 0.0).otherwise(F.col("confidence"))}).drop("gone")


def written_fields(fields: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, field, value, confidence, page, quote, origin): what stands in each field after rules have written into it in their order.

    fields: (key, field, value, confidence, page, quote), one row a field. found: (key, field, value, confidence, page, quote, rank, replaces), what rules
    found; of a document's rules with one rank the one with the smallest value counts. The last rule that replaces wins; without one
    the field keeps its own value; an empty field takes what the first rule fills in. origin: replaced, kept, filled or empty.
    """
    parts = ("value", "confidence", "page", "quote")
    given = F.struct(*parts)
    order = F.struct(F.col("rank"), F.col("value"))
    back = F.struct(-F.col("rank"), F.col("value"))
    rules = found.where("value is not null").groupBy(key, "field").agg(
        F.min_by(F.when(F.col("replaces"), given), F.when(F.col("replaces"), back)).alias("replaced"), F.min_by(F.when(~F.col("replaces"), given), F.when(~F.col("replaces"), order)).alias("filled")
    )
    own = fields.select(key, "field", given.alias("own"))
    both = own.join(rules, [key, "field"], "full")
    has = lambda c: F.coalesce(F.col(f"{c}.value").isNotNull(), F.lit(False))
    origin = F.when(has("replaced"), "replaced").when(has("own"), "kept").when(has("filled"), "filled").otherwise("empty")
    chosen = F.when(has("replaced"), F.col("replaced")).when(has("own"), F.col("own")).otherwise(F.col("filled"))
    return both.select(key, "field", chosen.alias("chosen"), origin.alias("origin")).select(key, "field", *[F.col(f"chosen.{p}").alias(p) for p in parts], "origin")


class Passages:
    """Passages under what must stand in a text that holds them, where both are cut at blanks: of one part, a part of a word; of two, the end of a word and the start of the next; of more, their inner words whole, of which two at most are looked up."""

    def __init__(self, passages: list[str]):
        self.passages = passages
        self.single, self.pairs, self.inner, self.inner_two = {}, defaultdict(dict), defaultdict(list), defaultdict(list)
        self.seconds = set()
        for n, passage in enumerate(passages):
            parts = passage.split(" ")
            if len(parts) == 1:
                self.single[passage] = n
            elif len(parts) == 2:
                self.pairs[parts[0]][parts[1]] = n
                self.seconds.add(parts[1])
            elif len(parts) == 3:
                self.inner[parts[1]].append(n)
            else:
                self.inner_two[parts[1], parts[2]].append(n)
        self.longest = max(map(len, self.single), default=0)
        # Of each word that was met: the asked parts that it ends with, starts with and holds.
        self.ends, self.starts, self.held = {}, {}, {}

    def _ends(self, w: str) -> list[dict]:
        return [self.pairs[w[i:]] for i in range(len(w) + 1) if w[i:] in self.pairs]

    def _starts(self, w: str) -> list[str]:
        return [w[:i] for i in range(len(w) + 1) if w[:i] in self.seconds]

    def _held(self, w: str) -> list[int]:
        return list({self.single[w[i:j]] for i in range(len(w)) for j in range(i + 1, min(len(w), i + self.longest) + 1) if w[i:j] in self.single})

    def found(self, text: str) -> set[int]:
        """The numbers of the passages that stand in the text."""
        words, out = text.split(" "), set()
        if self.single:
            for w in set(words):
                if w not in self.held:
                    self.held[w] = self._held(w)
                out.update(self.held[w])
        if self.pairs:
            for w, v in set(zip(words, words[1:], strict=False)):
                if w not in self.ends:
                    self.ends[w] = self._ends(w)
                if self.ends[w]:
                    if v not in self.starts:
                        self.starts[v] = self._starts(v)
                    out.update(asked[b] for asked in self.ends[w] for b in self.starts[v] if b in asked)
        near = set()
        if self.inner:
            for w in self.inner.keys() & set(words):
                near.update(self.inner[w])
        if self.inner_two:
            for two in self.inner_two.keys() & set(zip(words, words[1:], strict=False)):
                near.update(self.inner_two[two])
        out.update(n for n in near if self.passages[n] in text)
        return out


def contained_quotes(quotes: DataFrame, texts: DataFrame, key: str, quote: Column, text: Column, columns: list[str] | None = None) -> DataFrame:
    """Rows of texts with rows of quotes whose passage occurs in the text; `quote` and `text` give both in comparable form (see collapse).

    Every block of texts meets every block of distinct passages in one group, which looks up the words of each text once, whatever the number
    of passages, and gives nothing but what is found. Quotes and texts may be of any number; empty passages occur nowhere. key: a column of
    texts, which deals them to blocks. columns: of texts, those to give back; all if not given.
    """
    given = columns or texts.columns
    parts = [max(1, -(-df.count() // size)) for df, size in ((texts, TEXT_BLOCK), (quotes, PASSAGE_BLOCK))]
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = quotes.withColumn("_quote", quote).where(F.length("_quote") > 0)
    # Dealt before any text is put into comparable form.
    dealt = texts.withColumns({"_t": own(key, parts[0]), "_p": every(parts[1])}).repartition("_t", "_p")
    left = dealt.withColumn("_text", text).where(F.col("_text").isNotNull()).select("_t", "_p", "_text", *given)
    right = asked.select("_quote").distinct().select(every(parts[0]).alias("_t"), own("_quote", parts[1]).alias("_p"), "_quote")
    kinds = dict(texts.dtypes)

    def search(held: pa.Table, wanted: pa.Table) -> pa.Table:
        passages = Passages(wanted["_quote"].to_pylist())
        rows, hits = [], []
        for i, t in enumerate(held["_text"].to_pylist() if passages.passages else []):
            found = passages.found(t)
            hits.extend(found)
            rows.extend([i] * len(found))
        return held.select(given).take(pa.array(rows, pa.int64())).append_column("_quote", wanted["_quote"].combine_chunks().take(pa.array(hits, pa.int64())))

    met = left.groupBy("_t", "_p").cogroup(right.groupBy("_t", "_p")).applyInArrow(search, ", ".join(f"`{c}` {kinds[c]}" for c in given) + ", _quote string")
    return met.join(asked, "_quote").drop("_quote")


def computed_once(df: DataFrame, key: str, content: str, compute: Callable[[DataFrame], DataFrame], kind: list[str] | None = None) -> DataFrame:
    """df with the columns that `compute` adds for its content, which each distinct content (of the same `kind` columns) goes through once.

    compute takes (digest, content, *kind) and returns digest with its results. One row stands for each digest; the results come back
    by digest, where Spark splits digests that very many rows share. Null content takes part as one content of its own.
    """
    kind = kind or []
    parts = [F.coalesce(F.sha2(content, 256), F.lit("")), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in kind]]
    named = df.withColumn("_digest", F.concat_ws("/", *parts))
    first = named.groupBy("_digest").agg(F.min(key).alias("_first"))
    stand_in = named.join(first.withColumnRenamed("_digest", "_of"), (F.col(key).eqNullSafe(F.col("_first"))) & (F.col("_digest") == F.col("_of")), "left_semi")
    results = compute(stand_in.dropDuplicates(["_digest"]).select(F.col("_digest").alias("digest"), content, *kind))
    return named.join(results.withColumnRenamed("digest", "_digest"), "_digest", "left").drop("_digest")


#: Fixed value: the confidence from which a cited field needs no model.
PROVEN = 0.70


def proven_field(value: Column, confidence: Column, page: Column, quote: Column) -> Column:
    """Whether a field stands by itself: a value, sure enough, with a page and a quote."""
    said = lambda c: F.coalesce(strip_white(c.cast("string")), F.lit("")) != ""
    return said(value) & said(quote) & F.coalesce((confidence >= PROVEN) & (page >= 1), F.lit(False))


def complete_documents(fields: DataFrame, documents: DataFrame, key: str, kind: str, required: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, complete, lost) for each of documents (key, kind): whether all required fields of its type are proven, so that no model has to read it, and which are not.

    fields: (key, field, value, confidence, page, quote). A type without required fields is never complete.
    """
    proven = fields.where(proven_field(F.col("value"), F.col("confidence"), F.col("page"), F.col("quote"))).groupBy(key).agg(F.collect_set("field").alias("_proven"))  # a document's fields
    need = F.lit(None).cast("array<string>")
    for name, names in required.items():
        need = F.when(F.col(kind) == name, F.array(*map(F.lit, names))).otherwise(need)
    met = documents.select(key, need.alias("_need")).join(proven, key, "left")
    lost = F.array_except("_need", F.coalesce("_proven", F.array().cast("array<string>")))
    return met.select(key, F.coalesce((F.size("_need") > 0) & (F.size(lost) == 0), F.lit(False)).alias("complete"), F.coalesce(F.array_join(lost, "|"), F.lit("")).alias("lost"))


def preferred_series(rows: DataFrame, key: str, series: str, first: str, second: str) -> DataFrame:
    """The rows of one of two series of each key: of the second if it has more, else of the first; what is empty yields to the other."""
    sizes = rows.groupBy(key).agg(F.count_if(F.col(series) == first).alias("_a"), F.count_if(F.col(series) == second).alias("_b"))
    chosen = sizes.select(key, F.when(F.col("_b") > F.col("_a"), second).otherwise(first).alias("_chosen"))
    return rows.join(chosen, key).where(F.col(series) == F.col("_chosen")).drop("_chosen")


def overridden_fields(fields: DataFrame, derived: DataFrame, keys: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """fields (key, field, value, confidence, page, quote, verified) in which `names` hold what was derived, never what a model said; without a derived value they are empty and unverified.

    keys: the documents. derived: (key, field, value, confidence, page, quote).
    """
    columns = [key, "field", "value", "confidence", "page", "quote", "verified"]
    wanted = keys.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, names))).alias("field"))
    made = wanted.join(derived.select(*columns[:-1]), [key, "field"], "left").withColumn("verified", F.col("value").isNotNull())
    return fields.where(~F.col("field").isin(*names)).select(*columns).unionByName(made.select(*columns))
