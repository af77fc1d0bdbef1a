"""Monthly credit charge and complementary income of bank statements, from evidence that several readings give, and zero only where operations were seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULTS
from ledgerloom.functions.numbers import strict_amount
from ledgerloom.functions.text import candidate_id, fold
from ledgerloom.operators import statements
from ledgerloom.operators.finance import cents, steady_figure
from ledgerloom.operators.texts import text_rows

#: Operations that pay back a loan, and words that rule it out.
CREDIT_CHARGE = (
    r"\b(?:mensualite|echeance|prelevement|remboursement)\w*.{0,35}\b(?:credit|pret|financement|habitat|logement|immobilier|auto|conso)\w*"
    r"|\b(?:credit|pret|financement)\w*.{0,35}\b(?:mensualite|echeance|prelevement|habitat|logement|immobilier|auto|conso)\w*"
)
NO_CHARGE = ("assurance", "remboursement anticipe", "solde du pret")
#: What shows that operations were read: a marked amount, the headings of a table, an operation under an opening balance.
MARKED = r"(?im)^.*\b(?:DEBIT|CREDIT)\s*:\s*(?:\d{1,3}(?:[ .\x{A0}]\d{3})+|\d+)[,.]\d{2}.*$"
HEADINGS = r"(?is)(date.{0,180}(?:libell[ée]|nature\s+op[ée]ration|op[ée]ration[- ]?r[ée]f[ée]rence|r[ée]f[ée]rence).{0,180}(?:montant\s+)?d[ée]bit.{0,120}(?:montant\s+)?cr[ée]dit)"
OPERATION = r"(?im)^.*\b(?:virement|virt|retrait|paiement|commission|frais|echeance|prelevement|versement)\w*\b.*$"
OPENING = ("solde depart", "ancien solde")
#: Words that say nothing about an operation, and days as they may be written.
COMMON_WORDS = ("avec", "dans", "pour", "carte")
DAY_FORMS = ("dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "dd.MM.yyyy", "dd/MM", "dd-MM", "dd.MM")
#: Confidences of a charge, of a zero, and of incomes of one month, of several, and irregular ones.
CHARGE_SURE, ZERO_SURE, ONE_MONTH, SEVERAL, IRREGULAR = 0.50, 0.35, 0.40, 0.60, 0.25
#: Evidence, as all readings give it. pos: its place in the reading.
EVIDENCE = ("page", "date", "description", "amount", "quote")


def is_charge(description: Column) -> Column:
    """Whether an operation pays back a loan."""
    folded = fold(description)
    out = folded.rlike(CREDIT_CHARGE)
    for word in NO_CHARGE:
        out = out & ~folded.contains(word)
    return F.coalesce(out, F.lit(False))


def proven_transactions(items: DataFrame, pages: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """items (key, pos, page, type, date, description, amount, quote) that their page proves, with `day`, `value`, `proof` and the `month` that its statement is proven to be of.

    The quote stands on the page; or the page has the day and the amount in one of their forms and two significant words of the
    description (all, where it has fewer). Case, accents and white space do not count. pages: (key, page, text), one row a page.
    """
    shown = pages.select(key, "page", fold(F.col(text)).alias("_page"))
    met = items.join(shown, [key, "page"]).join(statements.known_dates(docs, key, text), key)
    day, value = statements.operation_date(F.col("date"), F.col("anchors")), strict_amount(F.col("amount").cast("string"))
    met = statements.settled(met, {"day": F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("date", "yyyy-MM-dd")).otherwise(day), "value": value, "_said": fold(F.col("quote")), "_told": fold(F.col("description"))})
    words = F.filter(F.array_distinct(F.regexp_extract_all("_told", F.lit("[a-z]{3,}"), F.lit(0))), lambda w: ~w.isin(*COMMON_WORDS))
    met = statements.settled(met, {"_words": words})
    on_page = lambda c: F.col("_page").contains(c)
    plain = F.replace(F.format_number(F.abs("value"), 2), F.lit(","), F.lit(" "))
    amounts = [F.replace(plain, F.lit(" "), F.lit("")), F.replace(F.replace(plain, F.lit(" "), F.lit("")), F.lit("."), F.lit(",")), plain, F.replace(plain, F.lit("."), F.lit(","))]
    hits = F.size(F.filter("_words", on_page))
    any_of = lambda cs: F.exists(F.array(*cs), on_page)
    pieces = any_of([F.date_format("day", f) for f in DAY_FORMS]) & any_of(amounts) & (F.col("_told") != "") & (hits >= F.least(F.lit(2), F.size("_words")))
    quoted = (F.col("_said") != "") & on_page(F.col("_said"))
    proof = F.when(F.coalesce(quoted, F.lit(False)), F.trim("quote")).when(F.coalesce(pieces, F.lit(False)), F.trim(F.coalesce("quote", F.concat_ws(" | ", "date", "description", F.col("amount").cast("string")))))
    return statements.settled(met, {"proof": proof}).where("proof is not null").drop("_page", "_said", "_told", "_words", "anchors")


def statement_activity(proven: DataFrame, pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page, quote): what shows that a statement's operations were read; statements where nothing does have no row.

    The first proven transaction counts; else, on the first page that has one, a marked amount, the headings of a table of
    operations, or an operation's line where an opening balance is named.
    """
    first = proven.groupBy(key).agg(F.min(F.struct("pos", "page", F.col("proof").alias("quote"))).alias("f")).select(key, F.col("f.page").alias("t_page"), F.col("f.quote").alias("t_quote"))
    folded = fold(F.col(text))
    opened = folded.contains(OPENING[0]) | folded.contains(OPENING[1])
    found = F.coalesce(
        F.nullif(F.regexp_extract(text, MARKED, 0), F.lit("")), F.nullif(F.regexp_extract(text, HEADINGS, 1), F.lit("")), F.when(opened, F.nullif(F.regexp_extract(text, OPERATION, 0), F.lit("")))
    )
    seen = pages.select(key, "page", F.trim(F.regexp_replace(found, r"\s+", " ")).alias("quote")).where("quote is not null")
    by_page = seen.groupBy(key).agg(F.min(F.struct("page", "quote")).alias("p"))
    both = first.join(by_page, key, "full")
    return both.select(key, F.coalesce("t_page", "p.page").alias("page"), F.coalesce("t_quote", "p.quote").alias("quote"))


def _series(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.select(key, F.lit(name).alias("series"), "pos", *EVIDENCE)


def readings(docs: DataFrame, pages: DataFrame, items: DataFrame, key: str, text: str, kind: str, pattern: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Evidence of marked lines, of keywords and of misread lines, and the proven transactions of a model (with their type, and `timely` where they have a day that lies in the month their statement is proven to be of).

    docs: (key, text) of whole statements with page marks; pages: (key, page, text); items: see proven_transactions. kind: credit or debit. Evidence has the
    columns key, series, pos and EVIDENCE.
    """
    lines = text_rows(docs, key, text)
    marked = statements.column_transactions(lines, docs, key, text, "raw", kind, ("page", "line_no")).withColumnRenamed("line_no", "pos")
    keywords = statements.keyword_evidence(pages, docs, key, "page", text, pattern).where(fold(F.col("description")).rlike(pattern))
    w = Window.partitionBy(key).orderBy("page", "date", "amount", "quote")
    keywords = keywords.withColumn("pos", F.row_number().over(w))
    misread = statements.fuzzy_lines(lines, docs, key, text, "raw", ("page", "line_no")).withColumnRenamed("line_no", "pos")
    proven = proven_transactions(items, pages, docs, key, text)
    timely = F.col("day").isNotNull() & (F.col("month").isNull() | (F.date_format("day", "yyyy-MM") == F.col("month")))
    proven = statements.settled(proven, {"timely": F.coalesce(timely, F.lit(False))}).drop("month")
    return _series(marked, key, "marked"), _series(keywords, key, "keyword"), _series(misread, key, "misread"), proven


def dealt(docs: DataFrame, pages: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Statements and their pages, dealt by key once: all readings read these exchanges, where each would make the texts again and join what it found by a further exchange.

    They are twice as many as shuffles have, and are not merged by their size: reading takes long for few bytes, and would end up in a few tasks.
    """
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select(key, text).repartition(parts, key), pages.select(key, "page", text).repartition(parts, key)


def _seen(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key) of the pages that show that operations were read; see statement_activity."""
    folded = fold(F.col(text))
    opened = folded.contains(OPENING[0]) | folded.contains(OPENING[1])
    return pages.where(F.col(text).rlike(MARKED) | F.col(text).rlike(HEADINGS) | (opened & F.col(text).rlike(OPERATION))).select(key)


def _figures(rows: DataFrame, key: str) -> DataFrame:
    """(key, months, n, median, deviation) of rows (key, date, amount, eligible): figures of the monthly totals of the eligible rows, and their number; 0 where a key has others alone.

    Of a key's other rows one is kept, so that what is read once gives both the figures and whether anything was seen.
    """
    w = Window.partitionBy(key)
    ranked = rows.select(key, "eligible", F.when(F.col("eligible"), F.date_format("date", "yyyy-MM")).alias("period"), F.when(F.col("eligible"), F.col("amount")).alias("amount"), F.bool_or("eligible").over(w).alias("_any"))
    kept = ranked.where(F.col("eligible") | ~F.col("_any"))
    totals = kept.groupBy(key, "period").agg(F.round(F.sum("amount"), 2).alias("total"), F.count_if("eligible").alias("n"))
    return steady_figure(totals, key)


def _with_zero(figures: DataFrame, key: str) -> DataFrame:
    """figures (key, value, confidence, n) and, for statements without evidence whose operations were seen (n is 0), a zero that says it rests on absence."""
    absent = F.col("n") == 0
    return figures.select(
        key, F.when(absent, 0.0).otherwise(F.col("value")).alias("value"), F.when(absent, ZERO_SURE).otherwise(F.col("confidence")).alias("confidence"), F.col("n").cast("long").alias("n_evidence"), absent.alias("absence_based")
    )


def monthly_charge(docs: DataFrame, pages: DataFrame, items: DataFrame, key: str, text: str, gate: float = DEFAULTS.charge_deviation) -> DataFrame:
    """(key, value, confidence, n_evidence, absence_based): the monthly credit charge of each statement; statements where nothing was read have no row.

    Operations that pay back a loan are taken from marked lines; without any, from the model's proven debits or the keyword reading, whichever
    has more (the model's where equal). The value is the median of the months, NULL where several months differ from it by more than
    the gate. Where no such operation is found but others are, it is 0, based on absence.
    """
    docs, pages = dealt(docs, pages, key, text)
    marked, keywords, _, proven = readings(docs, pages, items, key, text, "debit", CREDIT_CHARGE)
    proven = proven.where("timely")
    kind = fold(F.coalesce("type", F.lit("")))
    debit = (kind.isin("debit", "d", "dr") | ((kind == "") & (F.col("value") < 0))) & (F.col("value") != 0)
    charges = lambda rows: rows.where(is_charge(F.col("description"))).select(key, "series", "date", "amount")
    # Proven transactions show that operations were read, charges or not.
    model = proven.select(key, F.when(debit & is_charge(F.col("description")), "model").alias("series"), F.col("day").alias("date"), F.abs("value").alias("amount"))
    every = charges(marked).unionByName(charges(keywords)).unionByName(model).unionByName(_seen(pages, key, text), allowMissingColumns=True)
    w = Window.partitionBy(key)
    n = lambda name: F.count_if(F.col("series") == name).over(w)
    sizes = every.select(key, "series", "date", "amount", n("marked").alias("n_marked"), n("keyword").alias("n_keyword"), n("model").alias("n_model"))
    chosen = F.when(F.col("n_marked") > 0, "marked").when(F.col("n_keyword") > F.col("n_model"), "keyword").otherwise("model")
    unsteady = (F.col("months") > 1) & ((F.col("median") == 0) | (F.col("deviation") > gate))
    figures = _figures(sizes.withColumn("eligible", F.col("series").eqNullSafe(chosen)), key)
    return _with_zero(figures.select(key, F.when(~unsteady, cents(F.col("median"))).alias("value"), F.when(~unsteady, CHARGE_SURE).alias("confidence"), "n"), key)


def _income_rows(docs: DataFrame, pages: DataFrame, items: DataFrame, key: str, text: str) -> DataFrame:
    """(key, status, *statements.MERGED, reason) of income_evidence(); beside it, with the status seen, what else of a model's transactions is proven."""
    marked, keywords, misread, proven = readings(docs, pages, items, key, text, "credit", statements.INCOMING)
    kind = fold(F.coalesce("type", F.lit("")))
    column = F.col("proof").rlike(r"(?i)\bcredit\s*:")
    may_be = F.col("timely") & (F.col("value") > 0) & (F.col("column") | kind.isin("credit", "c", "cr", ""))
    model = proven.withColumn("column", column).select(
        key, F.lit("model").alias("series"), "pos", "page", F.col("day").alias("date"), "description", F.col("value").alias("amount"), F.col("proof").alias("quote"), "column", F.coalesce(may_be, F.lit(False)).alias("may_be")
    )
    every = marked.unionByName(keywords).unionByName(misread).withColumns({"column": F.lit(False), "may_be": F.lit(True)}).unionByName(model)
    judged = statements.judged_operations(every, key, "description")
    kept = F.when(F.col("series") == "marked", ~F.col("outgoing")).when(F.col("series") == "model", F.col("may_be") & (F.col("column") | (F.col("incoming") & ~F.col("outgoing")))).otherwise(True)
    # Eligible and excluded evidence is merged apart, each in the order of readings.
    status = F.when(kept, F.when(F.col("reason").isNull(), "eligible").otherwise("excluded")).when(F.col("series") == "model", "seen")
    order = F.create_map(*[F.lit(x) for x in ("marked", 0, "keyword", 1, "misread", 2, "model", 3)])[F.col("series")]
    parts = judged.select(key, status.alias("status"), order.alias("priority"), F.col("pos").cast("int").alias("pos"), F.col("page").cast("int").alias("page"), F.date_format("date", "yyyy-MM-dd").alias("date"), "amount", "description", "quote", "reason")
    return parts.where("status is not null")


def _merged(rows: DataFrame, key: str) -> DataFrame:
    return statements.merge_evidence(rows, [key, "status"], ("reason",))


def income_evidence(docs: DataFrame, pages: DataFrame, items: DataFrame, key: str, text: str) -> DataFrame:
    """(key, status, reason, page, date, description, amount, quote, candidate_id) of operations that bring money in, each once.

    Readings are merged in the order marked, keyword, misread, model, and evidence of one that another has already given is dropped. status: eligible,
    or excluded with the reason why it is no complementary income. Marked lines that say money goes out are neither; of a model's, credits count that the
    quote marks, or whose words say that money comes in and not that it goes out.
    """
    merged = _merged(_income_rows(*dealt(docs, pages, key, text), items, key, text).where("status <> 'seen'"), key)
    identity = candidate_id(F.col("page"), F.col("date"), F.col("amount"), F.col("description"), F.col("quote"))
    return merged.select(key, "status", "reason", "page", F.to_date("date").alias("date"), "description", "amount", "quote", identity.alias("candidate_id"))


def complementary_income(docs: DataFrame, pages: DataFrame, items: DataFrame, key: str, text: str, gate: float = DEFAULTS.income_deviation) -> DataFrame:
    """(key, value, confidence, n_evidence, absence_based): the monthly complementary income of each statement; statements where nothing was read have no row.

    The value is the median of the months' eligible evidence, 0 where several months differ from it by more than the gate; surer with several
    months. Where no eligible operation is found but others are, it is 0, based on absence.
    """
    docs, pages = dealt(docs, pages, key, text)
    # Proven transactions show that operations were read, whatever they are, and come with the evidence, so that nothing is read for them again.
    model = (F.col("priority") == 3) & (F.col("status") == "excluded")
    rows = _income_rows(docs, pages, items, key, text).withColumn("status", F.when(model, "seen").otherwise(F.col("status"))).where("status <> 'excluded'")
    found = _merged(rows, key).select(key, F.to_date("date").alias("date"), "amount", (F.col("status") == "eligible").alias("eligible"))
    seen = _seen(pages, key, text).select(key, F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("amount"), F.lit(False).alias("eligible"))
    irregular = (F.col("median") == 0) | ((F.col("months") > 1) & (F.col("deviation") > gate))
    figures = _figures(found.unionByName(seen), key).select(
        key, F.when(irregular, 0.0).otherwise(cents(F.col("median"))).alias("value"), F.when(irregular, IRREGULAR).when(F.col("months") >= 2, SEVERAL).otherwise(ONE_MONTH).alias("confidence"), "n"
    )
    return _with_zero(figures, key)


#: Lines that are balances or totals, and what a line of an operation holds.
NO_OPERATION = ("solde depart", "solde initial", "ancien solde", "nouveau solde", "solde final", "total mouvement", "total des mouvements")
DECIMAL = r"(?:\d{1,3}(?:[ .]\d{3})+|\d+)[,.]\d{2}"


def dated_operations(docs: DataFrame, items: DataFrame, key: str, text: str) -> DataFrame:
    """(key, date, page, raw): the lines of operations with their days, each once.

    A line counts if the quote of one of items (key, page, date, quote) stands in it, with that item's day; or if it starts with a day, has three letters in
    a row and a decimal amount, and is no balance or total. A quote is looked for in the lines of its page; without a page, in all of its document's. Days
    without a year lie in the year that brings them closest to the document's complete dates.
    """
    lines = text_rows(docs, key, text).withColumn("folded", fold(F.col("raw")))
    anchors = statements.anchor_dates(docs, key, text)
    start = F.regexp_extract("raw", r"^\s*(\d{1,2}\s*[./-]\s*\d{1,2}(?:\s*[./-]\s*\d{2,4})?)", 1)
    own = (start != "") & F.col("raw").rlike(DECIMAL) & F.col("raw").rlike(r"[A-Za-zÀ-ÖØ-öø-ÿ]{3}")
    for word in NO_OPERATION:
        own = own & ~F.col("folded").contains(word)
    by_line = lines.where(own).select(key, "page", "raw", start.alias("said"))
    asked = items.select(key, F.col("page").alias("q_page"), F.col("date").alias("said"), fold(F.col("quote")).alias("wanted")).where("wanted <> ''").dropDuplicates()
    by_quote = lines.join(asked, key).where((F.col("q_page").isNull() | (F.col("q_page") == F.col("page"))) & F.col("folded").contains(F.col("wanted")))
    # The first line that holds a quote.
    by_quote = by_quote.groupBy(key, "said", "wanted", "q_page").agg(F.min(F.struct("line_no", "page", "raw")).alias("f")).select(key, "f.page", "f.raw", "said")
    dated = statements.settled(by_line.unionByName(by_quote).join(anchors, key), {"date": statements.operation_date(F.col("said"), F.col("anchors"))})
    return dated.where("date is not null").select(key, "date", "page", "raw").distinct()
