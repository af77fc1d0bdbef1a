"""Dossiers: what is proposed for each field, what is exported and logged, and small rules of the review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import csv_cell, fold, strip_white
from ledgerloom.operators.confirmation import canonical, valid_confirmation

#: Fields that are aggregated over statements, and the median that each takes.
FINANCIAL = {"revenus_complementaires": "median_low", "charge_mensuelle_credits": "median_high"}
#: States of a field.
MISSING, CONFLICT, CONFIRMED, TO_CHECK, TO_COMPLETE = "Document manquant", "Conflit", "Déjà confirmé", "À vérifier", "À compléter"


def aggregated(values: Column, field: Column) -> tuple[Column, Column]:
    """(value, regularity) of the confirmed amounts of one field: the lower median of incomes, the upper one of charges, and how far they spread relative to it."""
    ordered, n = F.sort_array(values), F.size(values)
    at = F.when(field == "revenus_complementaires", F.floor((n - 1) / 2)).otherwise(F.floor(n / 2))
    value = F.get(ordered, at.cast("int"))
    low, high = F.array_min(values), F.array_max(values)
    spread = (high - low) / F.greatest(F.abs(value), F.lit(1.0))
    several = lambda word, end="": F.concat(F.lit(f"{word} sur "), n.cast("string"), F.lit(f" relevés{end}"))
    label = F.when(n == 1, "Estimation sur 1 relevé").when(low == high, several("Stable")).when(spread <= 0.20, several("Régulier")).otherwise(several("Variable", " — à confirmer"))
    return F.round(value, 2), label


def field_proposals(documents: DataFrame, values: DataFrame, specs: list[tuple[str, str, str]], key: str) -> DataFrame:
    """(key, field, value, status, source) for each dossier and each field of specs (field, document type, kind of value).

    documents: (key, doc_id, type, status, at, filename); values: (key, doc_id, field, extracted, confirmed): what was read (NULL: illegible) and, if a valid confirmation
    exists, the confirmed value; a row means that the document has a decision on the field. Only completed documents of a field's type count, latest first. Confirmed
    amounts of statements are aggregated; else the latest confirmed value stands, else the latest that was read, with a conflict if canonical values
    differ. source: the distinct file names in that order.
    """
    spec = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("of_type"), F.lit(k).alias("kind")) for f, t, k in specs]))
    wanted = documents.select(key).distinct().select(key, spec.alias("s")).select(key, "s.*")
    done = documents.where("status = 'completed'").select(key, "doc_id", F.col("type").alias("of_type"), "at", "filename")
    said = values.select(key, "doc_id", "field", "extracted", "confirmed", F.lit(True).alias("decided"))
    met = wanted.join(done, [key, "of_type"], "left").join(said, [key, "doc_id", "field"], "left")
    item = F.struct(F.col("at").alias("at"), (-F.col("doc_id")).alias("order"), F.col("filename").alias("filename"), F.col("extracted").alias("extracted"), F.col("confirmed").alias("confirmed"), F.coalesce("decided", F.lit(False)).alias("decided"))
    grouped = met.groupBy(key, "field", "kind").agg(F.sort_array(F.collect_list(F.when(F.col("doc_id").isNotNull(), item)), False).alias("docs"))  # a dossier's documents
    confirmed, decided = F.filter("docs", lambda d: d["confirmed"].isNotNull()), F.filter("docs", lambda d: d["decided"])
    rows = grouped.withColumns({"confirmed": confirmed, "decided": decided}).withColumn("usable", F.filter("decided", lambda d: d["extracted"].isNotNull()))
    names = lambda docs, other: F.array_join(F.array_distinct(F.transform(docs, lambda d: F.coalesce(d["filename"], F.lit(other)))), ", ")
    kinds = lambda docs, part: F.size(F.array_distinct(F.transform(docs, lambda d: canonical(d[part], F.col("kind")))))
    amount, regularity = aggregated(F.transform("confirmed", lambda d: d["confirmed"].try_cast("double")), F.col("field"))
    first = lambda docs, part: F.get(docs, F.lit(0))[part]
    has = lambda c: F.size(c) > 0
    money = F.col("field").isin(*FINANCIAL) & has("confirmed")
    value = F.when(money, amount.cast("string")).when(has("confirmed"), first("confirmed", "confirmed")).when(has("usable"), first("usable", "extracted")).otherwise("")
    status = (
        F.when(~has("docs"), MISSING).when(money, regularity).when(has("confirmed"), F.when(kinds("confirmed", "confirmed") > 1, CONFLICT).otherwise(CONFIRMED))
        .when(has("usable"), F.when(kinds("usable", "extracted") > 1, CONFLICT).otherwise(TO_CHECK)).otherwise(TO_COMPLETE)
    )
    only = lambda docs: F.coalesce(first(docs, "filename"), F.lit("Document"))
    source = F.when(~has("docs"), "—").when(money, names("confirmed", "Relevé")).when(has("confirmed"), names("confirmed", "Document")).when(has("usable"), names("usable", "Document")).when(has("decided"), only("decided")).otherwise(only("docs"))
    return rows.select(key, "field", value.alias("value"), status.alias("status"), source.alias("source"))


def confirmed_document_value(documents: DataFrame, values: DataFrame, key: str, kind: str, field: str) -> DataFrame:
    """(key, value): the value of one field that was confirmed last in a document of one type, whatever its state. values: (key, doc_id, field, confirmed, confirmed_at)."""
    rows = values.where((F.col("field") == field) & F.col("confirmed").isNotNull()).join(documents.where(F.col("type") == kind).select(key, "doc_id"), [key, "doc_id"])
    return rows.groupBy(key).agg(F.max_by("confirmed", F.struct(F.coalesce("confirmed_at", F.lit("")), F.col("doc_id"))).alias("value"))


#: The columns of an export, in their order, and where each comes from.
EXPORT = {
    "Document ID": "document_id", "Type document": "document_type", "Champ": "field", "Valeur finale": "value", "Statut humain": "status", "Valeur extraite initiale": "original_value", "Utilisateur": "advisor_id", "Confirmation UTC": "confirmed_at",
    "Document source": "source_document", "SHA256": "sha256", "Page": "page", "Extrait": "quote", "Citation retrouvee": "verified",
}


def confirmed_rows(records: DataFrame) -> DataFrame:
    """The 13 columns of an export for the records (columns of EXPORT, record_document and source_checked) that count, with texts that no spreadsheet takes for a formula.

    A record counts if it is of its document, confirmed or corrected, its source was looked at, and it has a user, a time and a value.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    ok = valid_confirmation(F.col("document_id"), F.col("record_document"), F.col("status"), F.col("source_checked"), blank("advisor_id"), blank("confirmed_at"), F.col("value"))
    texts = {n for n, t in records.dtypes if t == "string"}
    shown = {n: csv_cell(F.col(c)) if c in texts else F.coalesce(F.col(c), F.lit(False)) if c == "verified" else F.col(c) for n, c in EXPORT.items()}
    return records.where(ok).select(*[c.alias(n) for n, c in shown.items()])


#: The columns of an audit event.
AUDIT = ("event_type", "advisor_id", "session_id", "document_path", "document_type", "field_name", "value", "decision", "details")


def _event(df: DataFrame, kind: str, **parts: Column) -> DataFrame:
    made = {"event_type": F.lit(kind), **{c: F.col(c) for c in ("advisor_id", "session_id", "document_path", "document_type", "field_name") if c in df.columns}, **parts}
    return df.select(*[made.get(c, F.lit(None)).cast("string").alias(c) for c in AUDIT])


def rejected_events(df: DataFrame, reason: Column) -> DataFrame:
    return _event(df, "document_rejected", decision=F.lit("rejeté"), details=F.to_json(F.struct(reason.alias("reason"))))


def security_events(df: DataFrame, patterns: Column) -> DataFrame:
    return _event(df, "security_flag", decision=F.lit("revue_prioritaire"), details=F.to_json(F.struct(patterns.alias("matched_patterns"))))


def decision_events(df: DataFrame, value: Column, status: Column, reasons: Column) -> DataFrame:
    return _event(df, "field_decision", value=value, decision=status, details=F.to_json(F.struct(reasons.alias("reasons"))))


def chat_events(df: DataFrame, question: Column, answer: Column, in_scope: Column, sources: Column) -> DataFrame:
    return _event(df, "chat_interaction", value=answer, decision=F.when(in_scope, "dans_perimetre").otherwise("hors_perimetre"), details=F.to_json(F.struct(question.alias("question"), F.sort_array(F.array_distinct(sources)).alias("sources"))))


def confirmation_events(df: DataFrame, confirmed: Column, original: Column, status: Column) -> DataFrame:
    """Human confirmations; without a status, a value that differs from the original is a correction."""
    corrected = F.when(status.isNotNull(), status == "corrige").otherwise(~confirmed.eqNullSafe(original))
    return _event(df, "human_confirmation", value=confirmed, decision=F.when(corrected, "corrigé_par_humain").otherwise("confirmé_par_humain"), details=F.to_json(F.struct(original.alias("valeur_extraite_initiale"))))


def last_logins(accounts: DataFrame, logins: DataFrame, key: str, at: str) -> DataFrame:
    """accounts with last_login moved on to the latest of their logins; logins of unknown accounts change nothing."""
    latest = logins.groupBy(key).agg(F.max(at).alias("_at"))
    return accounts.join(latest, key, "left").withColumn("last_login", F.greatest("last_login", "_at")).drop("_at").select(*accounts.columns)


def ambiguous_identity(df: DataFrame, ambiguous: Column, candidates: Column) -> DataFrame:
    """Decisions (field, value, confidence, status, reasons as an array) where names that could not be told apart are taken back: no value, confidence 0, to be chosen by hand."""
    hit = F.coalesce(ambiguous, F.lit(False)) & F.col("field").isin("nom", "prenom")
    listed = F.coalesce(F.nullif(F.array_join(candidates, ", "), F.lit("")), F.lit("textes OCR à vérifier"))
    reasons = F.array(F.lit("Nom et prénom non distinguables automatiquement sur cette carte"), F.concat(F.lit("Sélection manuelle obligatoire parmi : "), listed))
    return df.withColumns({"value": F.when(~hit, F.col("value")), "confidence": F.when(hit, 0.0).otherwise(F.col("confidence")), "status": F.when(hit, "signale").otherwise(F.col("status")), "reasons": F.when(hit, reasons).otherwise(F.col("reasons"))})


#: What encloses a document's text in a prompt.
DATA_OPEN, DATA_CLOSE = "<<<DOCUMENT_CONTENT_START>>>", "<<<DOCUMENT_CONTENT_END>>>"


def as_data(text: Column) -> Column:
    return F.concat(F.lit(f"{DATA_OPEN}\n"), text, F.lit(f"\n{DATA_CLOSE}"))


def has_column_marker(quote: Column, marker: str) -> Column:
    """Whether a quote itself says that its amount stands in the column `marker`."""
    return F.coalesce(fold(quote).rlike(rf"(?i)\b{marker}\s*:"), F.lit(False))


#: Words that let a charge be expected.
DEBT_HINT = r"\b(?:echeance|mensualite|remb\w*\s+ech|prlv\w*|prelevement)\b"


def fallback_needed(n_income: Column, n_candidates: Column, n_charge: Column, text: Column) -> Column:
    """Whether a statement must be read once more: no income and no candidates were found, or no charge although its text speaks of one."""
    none = lambda c: F.coalesce(c, F.lit(0)) == 0
    return (none(n_income) & none(n_candidates)) | (none(n_charge) & F.coalesce(fold(text).rlike(DEBT_HINT), F.lit(False)))


def review_fields(essential: list[str], others: Column, strict: Column, technical: tuple[str, ...] = ("transactions",)) -> Column:
    """The fields that a review shows: the essential ones in their order, and, unless the type is strict, the others as they come, without technical ones."""
    base = F.array(*map(F.lit, essential))
    more = F.filter(others, lambda f: ~f.isin(*technical))
    return F.when(strict, base).otherwise(F.array_distinct(F.concat(base, more)))


def first_page(pages: Column) -> Column:
    """The first page above 0 that is cited, else 1."""
    return F.coalesce(F.get(F.filter(pages, lambda p: p > 0), F.lit(0)), F.lit(1))


def shown_value(field: Column, value: Column) -> Column:
    """A profile's value as people read it: amounts in whole dirhams, a rate in percent, whole years."""
    amounts = ("revenu_mensuel_net", "autres_revenus_mensuels", "charges_mensuelles", "apport_personnel", "prix_bien", "montant_financement_souhaite")
    number = value.try_cast("double")
    rate = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", number), r"0+$", ""), r"\.$", "")
    years = F.concat(number.cast("long").cast("string"), F.lit(" ans"))
    return F.when(field.isin(*amounts), F.concat(F.replace(F.format_number(F.rint(number), 0), F.lit(","), F.lit(" ")), F.lit(" MAD"))).when(field == "taux_annuel_indicatif", F.concat(rate, F.lit(" %"))).when(field.isin("anciennete_annees", "duree_souhaitee_annees"), years).otherwise(value)


def shown_time(c: Column) -> Column:
    """A time in ISO form as dd/MM/yyyy à HH:mm; a dash for none, other texts as they are."""
    at = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})?)?$"), F.concat(F.substring(c, 9, 2), F.lit("/"), F.substring(c, 6, 2), F.lit("/"), F.substring(c, 1, 4), F.lit(" à "), F.when(F.length(c) >= 16, F.substring(c, 12, 5)).otherwise("00:00")))
    return F.when(F.coalesce(strip_white(c), F.lit("")) == "", "—").otherwise(F.coalesce(at, c))


def project_of(profile: dict[str, Column], project: dict[str, Column], changed: Column) -> dict[str, Column]:
    """A project's price, contribution, years and rate after the changed slots of a profile are taken over.

    A wish for a sum of financing makes the price: the sum and the contribution that the project had; a price that is changed too counts instead. NULL slots change nothing.
    """
    new = lambda slot: F.when(F.array_contains(changed, slot), profile[slot])
    wish = F.when(F.array_contains(changed, "montant_financement_souhaite"), profile["montant_financement_souhaite"] + F.coalesce(project["contribution"], F.lit(0.0)))
    return {
        "purchase_price": F.coalesce(new("prix_bien"), wish, project["purchase_price"]), "contribution": F.coalesce(new("apport_personnel"), project["contribution"]),
        "duration_years": F.coalesce(new("duree_souhaitee_annees"), project["duration_years"]), "annual_rate": F.coalesce(new("taux_annuel_indicatif"), project["annual_rate"]),
    }


#: Markers of identity cards and of business documents, and the words of operations.
CARD_MARKERS = ("CARTE NATIONALE", "IDMAR", "VALABLE", "ADRESSE", "NÉ", "NE A")
CARD_PROOF = ("CARTE NATIONALE", "IDMAR", "ROYAUME DU MAROC", "IDENTITE")
MARKERS = {"bulletin": ("BULLETIN", "SALAIRE", "BRUT", "NET", "RETENUES", "COMPTE", "GAINS", "DEDUCTIONS"), "releve": ("RELEVE", "COMPTE", "DEBIT", "CREDIT", "SOLDE", "MOUVEMENT", "OPERATION")}
OPERATION_WORDS = r"\b(?:virement|virt|versement|retrait|paiement|prelevement|commission|frais|echeance|remboursement|recu|emis)\w*\b"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def identity_score(text: Column) -> Column:
    """How much of a card a reading shows: its length up to a bound, markers, numbers and dates."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    score = F.least(F.length(upper), F.lit(600)) / 100
    for marker in CARD_MARKERS:
        score = score + F.when(upper.contains(marker), 3).otherwise(0)
    return score + 2 * _count(upper, r"\b[A-Z]{1,2}\d{5,8}\b") + _count(upper, r"\b\d{2}[./-]\d{2}[./-]\d{4}\b")


def identity_sufficient(text: Column) -> Column:
    """Whether a reading of a card needs no second one: long enough, with a marker, a number, a full date and a high score."""
    plain = F.upper(fold(F.coalesce(text, F.lit(""))))
    marked = F.lit(False)
    for marker in CARD_PROOF:
        marked = marked | plain.contains(marker)
    return (F.length(plain) >= 100) & marked & plain.rlike(r"\b[A-Z]{1,2}\s*\d{5,8}\b") & plain.rlike(r"\b\d{2}[./-]\d{2}[./-]\d{4}\b") & (identity_score(text) >= 9.0)


def business_score(lines: Column, kind: str) -> Column:
    """How complete a reading (an array of lines) of a payslip or statement is: markers, amounts up to 12, lines up to 30."""
    upper = F.upper(F.array_join(lines, " "))
    score = F.lit(0.0)
    for marker in MARKERS[kind]:
        score = score + F.when(upper.contains(marker), 4.0).otherwise(0.0)
    return score + F.least(_count(upper, r"\b\d[\d ]*[,.]\d{2}\b"), F.lit(12)) + F.least(F.size(lines), F.lit(30)) / 5


def detail_score(lines: Column) -> Column:
    """How many usable operations a reading of a statement shows: days, words of operations and half of the lines with two words, up to 8 each."""
    folded = F.transform(lines, fold)
    text = F.array_join(folded, "\n")
    described = F.size(F.filter(folded, lambda x: F.regexp_count(x, F.lit(r"[a-z]{3,}")) >= 2))
    return F.least(_count(text, r"(?<!\d)\d{1,2}\s*[./-]\s*\d{1,2}(?!\d)"), F.lit(8)) + F.least(_count(text, OPERATION_WORDS), F.lit(8)) + F.least(described, F.lit(8)) / 2


def best_reading(readings: DataFrame, keys: list[str], score: Column, order: str) -> DataFrame:
    """The reading of each key with the highest score; of equals the first in `order`."""
    scored = readings.withColumn("score", score)
    first = scored.groupBy(*keys).agg(F.max(F.struct(F.col("score"), (-F.col(order)).alias("o"))).alias("best"))
    return scored.join(first, keys).where((F.col("score") == F.col("best.score")) & (F.col(order) == -F.col("best.o"))).drop("best")


def correction_rates(events: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, rate): how many human confirmations there are, and what share of them are corrections."""
    confirmed = events.where("event_type = 'human_confirmation'")
    return confirmed.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg((F.col("decision") == "corrigé_par_humain").cast("double")), 4).alias("rate"))


def simulation_answer(capital: Column, years: Column, rate: Column, payment: Column) -> Column:
    """What a person reads after a simulation: the three figures as noted, and the payment."""
    whole = lambda c, digits: F.replace(F.format_number(c, digits), F.lit(","), F.lit(" "))
    noted = F.concat(F.lit("Merci, j’ai bien noté : durée du crédit : "), years.cast("string"), F.lit(" ans, montant à financer : "), whole(F.rint(capital), 0), F.lit(" MAD et taux annuel indicatif : "), F.replace(rate.cast("string"), F.lit("."), F.lit(",")), F.lit(" %.\n\n"))
    return F.concat(noted, F.lit("La mensualité estimée est d’environ "), whole(payment, 2), F.lit(" MAD par mois, hors assurance et frais. Cette estimation est indicative et non contractuelle."))


#: Extensions and types of uploads.
UPLOADS, UPLOAD_TYPES = (".pdf", ".png", ".jpg", ".jpeg", ".tiff"), ("application/pdf", "image/jpeg", "image/png", "image/tiff")


def upload_control(name: Column, size: Column, mime: Column, max_mb: int = 10) -> Column:
    """Why an upload is refused, by the first check that fails: none, too large, extension, type; NULL if it is taken. An unknown type (NULL) is not checked."""
    extension = F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))
    return F.when(name.isNull() | size.isNull(), "none").when(size > max_mb * 1024 * 1024, "too large").when(~extension.isin(*UPLOADS), "extension").when(~F.coalesce(mime.isin(*UPLOAD_TYPES), F.lit(True)), "type")
