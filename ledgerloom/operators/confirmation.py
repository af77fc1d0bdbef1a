"""Typed rules of documents, and values that a person confirms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import parse_date
from ledgerloom.functions.numbers import human_amount
from ledgerloom.functions.text import fold, strip_white

#: Fields that must not be left blank, and fields that hold dates, by document type.
REQUIRED = {"bulletin": ("employeur", "salaire_net", "date_embauche"), "releve": ("charge_mensuelle_credits",), "carte_identite": ("nom", "prenom", "date_naissance"), "compromis": ()}
DATES = ("date_embauche", "date_naissance", "date_expiration", "periode_debut", "periode_fin", "date_signature")
NOT_FUTURE = ("date_embauche", "date_naissance", "date_signature")
AMOUNTS = ("salaire_net", "charge_mensuelle_credits", "revenus_complementaires", "prix_vente", "superficie")
#: The rules of each type: rule, field, kind of test, and whether an empty field fails instead of having no row.
RULES = {
    "carte_identite": (("cin_format", "cin", "card", False), ("nom_present", "nom", "filled", True), ("prenom_present", "prenom", "filled", True), ("date_naissance", "date_naissance", "date", False), ("date_expiration", "date_expiration", "date", False)),
    "bulletin": (("date_embauche", "date_embauche", "past", False), ("salaire_brut_positif", "salaire_brut", "amount", False), ("salaire_net_positif", "salaire_net", "amount", False)),
    "releve": (("charge_mensuelle_credits", "charge_mensuelle_credits", "amount", False), ("revenus_complementaires", "revenus_complementaires", "amount", False)),
    "compromis": (("acheteur_present", "acheteur_nom", "filled", True), ("vendeur_present", "vendeur_nom", "filled", True), ("prix_vente_positif", "prix_vente", "amount", False), ("superficie_positive", "superficie", "amount", False), ("date_signature", "date_signature", "date", False)),
}


def filled(c: Column) -> Column:
    return c.isNotNull() & (strip_white(c) != "")


def passes(kind: str, c: Column, today: Column) -> Column:
    number = c.try_cast("double")
    tests = {
        "filled": filled(c), "card": F.upper(strip_white(c)).rlike(r"^[A-Z]{1,2}[0-9]{5,8}$"), "date": parse_date(strip_white(c)).isNotNull(), "past": F.coalesce(parse_date(strip_white(c)) <= today, F.lit(False)),
        "amount": F.coalesce((number >= 0) & ~F.isnan(number), F.lit(False)),
    }
    return tests[kind]


def document_rules(docs: DataFrame, key: str, kind: str, fields: str, today: str) -> DataFrame:
    """(key, rule, passed) of documents with a type column and a map of fields; tests of empty fields have no row unless presence is the rule."""
    day, value = F.lit(today).cast("date"), lambda f: F.col(fields)[f]
    each = []
    for name, rules in RULES.items():
        for rule, field, test, always in rules:
            v = value(field)
            row = F.struct(F.lit(rule).alias("rule"), F.coalesce(passes(test, v, day), F.lit(False)).alias("passed"))
            each.append(F.when((F.col(kind) == name) & (F.lit(always) | filled(v)), row))
    gross, net = value("salaire_brut").try_cast("double"), value("salaire_net").try_cast("double")
    each.append(F.when((F.col(kind) == "bulletin") & gross.isNotNull() & net.isNotNull(), F.struct(F.lit("net_inferieur_brut").alias("rule"), (net <= gross).alias("passed"))))
    return docs.select(key, F.explode(F.array_compact(F.array(*each))).alias("r")).select(key, "r.*")


def confirmed_values(df: DataFrame, kind: str, field: str, raw: str, original: str, today: str) -> DataFrame:
    """df with value, error and status: what a person typed, parsed as its field asks; status says whether it differs from the original.

    Blank is no value, which required fields do not allow; amounts are finite and at least 0; dates have one of three forms and some may not lie in the future.
    """
    text = F.nullif(strip_white(F.col(raw)), F.lit(""))
    need = F.lit(False)
    for name, fields in REQUIRED.items():
        need = need | ((F.col(kind) == name) & F.col(field).isin(*fields))
    is_date, is_amount = F.col(field).isin(*DATES), F.col(field).isin(*AMOUNTS)
    day, amount = parse_date(text), human_amount(text)
    error = (
        F.when(text.isNull() & need, "required").when(text.isNull(), None).when(is_amount & amount.isNull(), "amount").when(is_date & day.isNull(), "date").when(F.col(field).isin(*NOT_FUTURE) & (day > F.lit(today).cast("date")), "future")
    )
    plain = lambda c, d, a: F.when(is_amount, a.cast("string")).when(is_date, F.date_format(d, "yyyy-MM-dd")).otherwise(c)
    new = F.when(error.isNull(), plain(text, day, amount))
    old_text = F.nullif(strip_white(F.col(original)), F.lit(""))
    old = plain(old_text, parse_date(old_text), human_amount(old_text))
    status = F.when(error.isNull(), F.when(new.eqNullSafe(old), "confirme").otherwise("corrige"))
    return df.withColumns({"value": new, "error": error, "status": status})


def all_or_nothing(df: DataFrame, document: str) -> DataFrame:
    """The confirmations of documents none of whose fields has an error."""
    bad = df.where("error is not null").select(document).distinct()
    return df.join(bad, document, "left_anti")


def canonical(value: Column, expected: Column) -> Column:
    """A value for comparison: numbers with two digits, dates as such, texts folded; each with its kind in front."""
    number = human_amount(value)
    day = parse_date(strip_white(value))
    text = F.concat(F.lit("text:"), fold(value))
    return F.when((expected == "number") & number.isNotNull(), F.concat(F.lit("number:"), F.format_string("%.2f", number))).when((expected == "date") & day.isNotNull(), F.concat(F.lit("date:"), F.date_format(day, "yyyy-MM-dd"))).otherwise(text)


def valid_confirmation(document: Column, record_document: Column, status: Column, checked: Column, advisor: Column, at: Column, value: Column) -> Column:
    """Whether a record counts: of this document, confirmed or corrected, its source looked at, by someone, at some time, with a value."""
    return F.coalesce((document == record_document) & status.isin("confirme", "corrige") & checked & (advisor != "") & (at != "") & value.isNotNull(), F.lit(False))


def dossier_override(records: DataFrame, sources: DataFrame, key: str, field: str) -> DataFrame:
    """(key, field, value): of the records whose set of sources is the dossier's present one, the latest value.

    records: (key, field, value, confirmed_at, source_ids); sources: (key, source_id), few for a dossier.
    """
    present = sources.groupBy(key).agg(F.sort_array(F.collect_set("source_id")).alias("present"))
    same = records.join(present, key).where(F.sort_array(F.array_distinct("source_ids")) == F.col("present"))
    return same.groupBy(key, field).agg(F.max_by("value", F.struct("confirmed_at", "value")).alias("value"))
