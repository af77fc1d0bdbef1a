"""Routing, numbers and profiles of a guided conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import chat_number
from ledgerloom.functions.text import fold
from ledgerloom.operators.statements import settled

#: What asks for an estimate, what asks a question, greetings, words of documentation, and the answer's three markers.
ESTIMATE = r"\b(?:estim(?:er|ation|e)|simul(?:er|ation|e)|calcul(?:er|e) (?:ma |une |la )?mensualite|calcul(?:er|e) (?:ma |la )?capacite d emprunt)\b"
QUESTION = r"^(?:comment|quel(?:s|le|les)?|quels|pourquoi|est ce que|combien de|ou|quand)\b"
GREETING = r"^(?:bonjour|bonsoir|salut|hello|coucou|salam|merci|ca va|comment ca va|qui es tu|tu fais quoi)[ !?.]*$"
DOCUMENTATION = ("quel document", "quels documents", "justificatif", "condition", "éligib", "taux", "délai", "demarche", "démarche", "assurance", "garantie", "comment fonctionne", "est-ce que")
MARKERS = ("durée du prêt", "montant du financement", "taux d'intérêt")
#: The slots of a profile, in the order in which they are asked for.
SLOTS = ("profession", "statut_professionnel", "secteur_activite", "anciennete_annees", "revenu_mensuel_net", "autres_revenus_mensuels", "charges_mensuelles", "apport_personnel", "prix_bien", "duree_souhaitee_annees")
MONEY = {"revenu_mensuel_net": "salaire|revenu", "apport_personnel": "apport", "charges_mensuelles": "charge|cr[eé]dit", "prix_bien": "prix|bien|logement"}


def route(df: DataFrame, message: str, guided: Column) -> DataFrame:
    """df with mode (guidance, conversation or rag) and whether the message asks for documentation."""
    plain = F.regexp_replace(fold(F.col(message)), r"['’-]", " ")
    wants = plain.rlike(ESTIMATE) & ~plain.rlike(QUESTION)
    asks = F.col(message).contains("?")
    for word in DOCUMENTATION:
        asks = asks | F.lower(F.col(message)).contains(word)
    mode = F.when(wants | F.coalesce(guided, F.lit(False)), "guidance").when(plain.rlike(GREETING), "conversation").otherwise("rag")
    return df.withColumns({"mode": mode, "documentation": asks})


def follow_up(df: DataFrame, message: str, previous: str) -> DataFrame:
    """df with years, amount and rate from an answer to the three questions; NULL unless the previous answer asked them and all are in range."""
    asked = F.lit(True)
    for marker in MARKERS:
        asked = asked & F.lower(F.coalesce(F.col(previous), F.lit(""))).contains(marker)
    found = F.regexp_extract_all(F.regexp_replace(F.col(message), " ", ""), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    n = F.when((F.size(found) == 4) & F.col(message).rlike(r",\d+\s*$"), F.array(F.get(found, F.lit(0)), F.get(found, F.lit(1)), F.concat_ws(".", F.get(found, F.lit(2)), F.get(found, F.lit(3))))).otherwise(found)
    years, amount, rate = F.get(n, F.lit(0)).try_cast("double").cast("int"), F.get(n, F.lit(1)).try_cast("double"), F.get(n, F.lit(2)).try_cast("double")
    ok = asked & (F.size(n) >= 3) & years.between(5, 30) & (amount > 0) & rate.between(0, 20)
    return df.withColumns({"years": F.when(ok, years), "amount": F.when(ok, amount), "rate": F.when(ok, rate)})


def money_slots(df: DataFrame, key: str, message: str) -> DataFrame:
    """(key, field, value): amounts named in a message, times 1000 with a k; a text that is no number gives NULL."""
    text = F.lower(F.regexp_replace(F.trim(message), r"\s+", " "))
    pattern = {f: rf"(?:{w})[^\d]{{0,20}}([\d\s.,]+)\s*(k)?" for f, w in MONEY.items()}
    # What is found is held before it is read further, so that no pattern runs twice.
    plain = settled(df.select(key, message), {"_text": text}).drop(message)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.regexp_extract("_text", p, 1).alias("digits"), F.regexp_extract("_text", p, 2).alias("k")) for f, p in pattern.items()])
    found = plain.select(key, F.explode(each).alias("x")).where("x.digits <> ''").select(key, "x.*")
    return settled(found, {"digits": F.regexp_replace("digits", r"[\s.,]+$", "")}).select(key, "field", chat_number(F.col("digits"), F.col("k")).alias("value"))


def missing_slots(df: DataFrame, key: str, slots: tuple[str, ...] = SLOTS, optional: tuple[str, ...] = ("autres_revenus_mensuels",)) -> DataFrame:
    """(key, next, missing): the first slot that is open in the fixed order, and all required ones."""
    lost = F.array_compact(F.array(*[F.when(F.col(s).isNull(), s) for s in slots if s not in optional]))
    return df.select(key, F.get(lost, F.lit(0)).alias("next"), F.array_join(lost, "|").alias("missing"))


def updated_profile(df: DataFrame, updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Profiles with the valid values of updates: texts of at most 100 characters, numbers from 0 on; others leave the old value."""
    new = updates.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    types = dict(df.dtypes)
    ok = lambda f: F.when(F.trim(f"_{f}") != "", F.substring(F.trim(f"_{f}"), 1, 100)) if types[f] == "string" else F.when(F.col(f"_{f}") >= 0, F.col(f"_{f}"))
    return df.join(new, key, "left").select(key, *[F.coalesce(ok(f), F.col(f)).alias(f) for f in fields])


#: How a profession is named, what ends it, and the slots that are numbers.
PROFESSION, PROFESSION_END = r"\b(?:je suis|je travaille comme|profession)\s+(?:un |une )?([a-zà-ÿ][a-zà-ÿ -]{2,40})", r"\s+(?:avec|et|depuis|dans|pour)\b.*$"
NUMBERS = ("anciennete_annees", "revenu_mensuel_net", "autres_revenus_mensuels", "charges_mensuelles", "apport_personnel", "prix_bien", "duree_souhaitee_annees")


def slot_updates(df: DataFrame, key: str, message: str, expected: str) -> DataFrame:
    """(key, field, text, number): what a message says about the slots of a profile, without a model.

    A profession and amounts by their words; for the slot that was asked for (the column `expected`) and that these do not name, the first number of the message if
    it is a number, else the whole message if it has at most 80 characters. An amount that is no number is 0.
    """
    plain = F.lower(F.trim(F.regexp_replace(F.col(message), r"\s+", " ")))
    work = F.regexp_replace(F.regexp_extract(plain, PROFESSION, 1), PROFESSION_END, "")
    tidy = lambda c: F.regexp_replace(c, r"[\s.,]+$", "")
    number = lambda p: F.coalesce(chat_number(tidy(F.regexp_extract(plain, p, 1)), F.regexp_extract(plain, p, 2)), F.lit(0.0))
    row = lambda f, t, n: F.struct(f.alias("field"), t.cast("string").alias("text"), n.cast("double").alias("number"))
    none = F.lit(None)
    made = [F.when(work != "", row(F.lit("profession"), F.initcap(F.trim(work)), none))]
    for slot, words in MONEY.items():
        pattern = rf"(?:{words})[^\d]{{0,20}}([\d\s.,]+)\s*(k)?"
        made.append(F.when(plain.rlike(pattern), row(F.lit(slot), none, number(pattern))))
    rows = df.withColumn("_said", F.array_compact(F.array(*made)))
    asked = F.col(expected)
    open_slot = asked.isNotNull() & ~F.exists("_said", lambda x: x["field"] == asked)
    first = r"([\d\s.,]*\d[\d\s.,]*)\s*(k)?"
    answer = F.when(open_slot & asked.isin(*NUMBERS) & plain.rlike(first), row(asked, none, number(first))).when(open_slot & ~asked.isin(*NUMBERS) & (F.length(plain) <= 80), row(asked, F.trim(F.col(message)), none))
    return rows.select(key, F.explode(F.array_compact(F.concat("_said", F.array(answer)))).alias("u")).select(key, "u.*")
