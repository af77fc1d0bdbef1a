"""Payslips: fields from known layouts and from labels, totals and gross pay, and the two parts of a name."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import ACCENTED, PLAIN, strip_white
from ledgerloom.operators.evidence import written_fields
from ledgerloom.operators.statements import settled
from ledgerloom.operators.texts import text_rows

#: The fields of a payslip.
FIELDS = ("nom", "prenom", "employeur", "poste", "date_embauche", "periode", "salaire_net")
#: Labels of fields.
LABELS = {
    "date_embauche": ("date d embauche", "date embauche", "date d entree", "date entree", "date de recrutement", "debut de contrat", "date d engagement", "hire date", "employment date", "start date", "date joined"),
    "periode": ("periode de paie", "periode du", "periode", "pay period", "payroll period", "payment period"),
    "salaire_net": ("net a payer avant impot", "net a payer", "salaire net", "net paye", "net du mois", "net mensuel", "net payment", "net pay", "net salary", "take home pay", "amount payable"),
    "poste": ("emploi occupe", "intitule du poste", "job title", "occupation", "position", "fonction", "emploi", "poste"),
    "employeur": ("raison sociale", "nom de l employeur", "employer name", "employeur", "entreprise", "societe", "company"),
    "identite": ("nom et prenom", "nom prenom", "nom complet", "employee name", "nom du salarie", "salarie"),
}
#: Other headings of tables, which are no value of any field either.
OTHER_LABELS = (
    "situation familiale", "statut familial", "marital status", "departement", "service", "qualification", "matricule", "employee id", "numero cin", "cin", "date de naissance", "date naissance", "birth date", "type salaire",
    "salaire mensuel", "coefficient", "affectation", "statut",
)
#: Months by name.
MONTHS = {
    "janvier": 1, "january": 1, "fevrier": 2, "february": 2, "mars": 3, "march": 3, "avril": 4, "april": 4, "mai": 5, "may": 5, "juin": 6, "june": 6, "juillet": 7, "july": 7, "aout": 8, "august": 8, "septembre": 9, "september": 9,
    "octobre": 10, "october": 10, "novembre": 11, "november": 11, "decembre": 12, "december": 12,
}
FRENCH = r"(?:janvier|f[ée]vrier|mars|avril|mai|juin|juillet|ao[ûu]t|septembre|octobre|novembre|d[ée]cembre)"
NAMED = r"(?:janvier|f[ée]vrier|mars|avril|mai|juin|juillet|ao[ûu]t|septembre|octobre|novembre|d[ée]cembre|january|february|march|april|may|june|july|august|september|october|november|december)"
#: Shapes of dates and amounts, and legal forms of companies.
NUMERIC_DATE, SPACED_DATE = r"(?<!\d)(\d{1,2})\s*[./-]\s*(\d{1,2})\s*[./-]\s*((?:19|20)?\d{2})(?!\d)", r"(?<!\d)(\d{1,2})\s+(\d{1,2})\s+((?:19|20)\d{2})(?!\d)"
TEXT_DATE = rf"(?iU)(?<!\d)(\d{{1,2}})\s+({NAMED})\s+((?:19|20)\d{{2}})"
MONTH_YEAR = rf"(?iU)({NAMED})\s+((?:19|20)\d{{2}})"
AMOUNT = r"(?<![\d/.-])-?\s*(?:\d{1,3}(?:[ \x{A0}.]\d{3})+|\d+)(?:[,.]\d{2})(?!\d)"
LEGAL_FORM, NO_EMPLOYER = r"(?iU)\b(?:SA|SAS|SARL|SASU|EURL|SPA|LLC|LTD|LIMITED|INC|GMBH)\b", r"(?iU)\b(?:SIRET|RCS|CAPITAL|MATRICULE)\b"
#: A person named after a title, and where the name ends.
TITLED, NAME_END = r"(?:^|\|)\s*(?:M(?:me|lle)?|Mr|Monsieur|Madame)\.?\s*(?:\|\s*)?([A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ' -]{3,90})", r"(\s*\||\s+\d{1,4}\s+(?:RUE|AVENUE|BD|LOT)\b).*$"


@dataclass(frozen=True)
class Layout:
    """How one layout shows a field: a pattern over the text as one line, which may be tried where the folded text matches `anchor`.

    value: what is taken, with {n} for groups; form: how it is written; check: what it must be; replaces: it overrides what stands there.
    """

    field: str
    anchor: str
    pattern: str
    value: str = "{1}"
    confidence: float = 0.78
    replaces: bool = False
    form: str = ""
    check: str = ""


DAY = r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}"
#: The known layouts in the order in which they write; of layouts that replace the last one found counts, of the others the first.
_NAME, _WORDS = r"[A-ZÀ-ÖØ-Þ'\-]{2,35}", r"[A-ZÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ'\-]{1,35}"
_LABELLED = r"(?:Nom\s*(?:&|et)\s*Pr[ée]nom|Nom\s+complet)\s*:?[ ]*\|?[ ]*([A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'\-]{1,34})\s+([A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'\-]{1,34}(?:\s+[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'\-]{1,34})?)(?=\s*(?:\||Adresse\b|Fonction\b|D[ée]partement\b))"
_EL_TITLED = rf"\b(?:M|Mr|Monsieur)\s*\|?\s*((?:EL|AL)\s+{_NAME})\s+({_NAME}(?:\s+{_NAME})?)(?=\s*(?:\||\d{{1,4}}\s+(?:LOT|RUE|AVENUE|BD\b)|TANGER\b|RABAT\b|CASABLANCA\b|AGADIR\b|TAZA\b))"
_SIMPLE_TITLED = rf"\b(?:Madame|Monsieur|Mlle|Mme|Mr)\s*\|?\s*({_NAME})\s+([A-ZÀ-ÖØ-öø-ÿ'\-]{{2,35}})(?=\s*(?:\||\d{{1,4}}\s+(?:rue|avenue|place|route|lot|bd\b)|[A-Z]{{2,}}\s+\d{{5}}\b))"
_STREET_TITLED = rf"\b(?:Madame|Monsieur|M(?:I|L|l)le|Mme|Mr|M)\s+({_NAME})\s+({_NAME})(?=\s+\d+\s*(?:rue|avenue|av\b|place|route|lot|hay)|\s+[A-Z]{{3}}\s+\d{{5}}\b)"
_LONG_TITLED = rf"\b(?:Madame|Monsieur|Mme|Mr)\s+({_NAME}(?:\s+{_NAME}){{2,4}})(?=\s+(?:Statut\s+professionnel|Niveau\s*:|\d+\s*(?:rue|avenue|av\b|bd\b|boulevard)))"
_COMPANY_EMPLOYEE = rf"SOCI[ÉE]T[ÉE]\s*\|\s*EMPLOY[ÉE]E?\s+[^|]{{2,100}}\|\s*\d{{2,10}}[A-Z]?\s+([A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'\-]{{1,35}})\s+({_WORDS})(?=\s+(?:Fonction|Situation|N[°º]\s*CIN)\b|\s*\|)"
_CLASSED = r"\b([0-9]{3,8}[A-Z]?)\s+([A-ZÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ' -]{2,60}?)\s+Classe\b"
_COMPACT = r"\b(\d{3,8}[A-Z])\s*\|?\s*([A-ZÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ'\-]{1,30})\s+([A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'\-]{2,35})\s*\|\s*\d{2,6}\s*\|\s*([^|]{3,80})"
_NUMBERED = rf"\bEMPLOY[ÉE]E?\s*\|?\s*(\d{{2,8}}[A-Z]?)\s+([A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'\-]{{1,35}})\s+({_WORDS})(?=\s*(?:\||Fonction\b|Casablanca\b|Rabat\b|Tanger\b|Agadir\b))"
_INTERLEAVED = r"EMPLOY[ÉE]E?\s+[^|]{2,100}\|\s*(\d{2,8}[A-Z]?)\s+([A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'' -]{1,40})\s+([A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ' -]{1,40}?)(?=\s+N[°º](?:\s|$)|\s*\|)"
_NUMBER_NAME = r"(?:EMPLOY[ÉE]|Matricule)\s*:?[ ]*(\d{2,8}[A-Z]?)(?:\s+[MF])?\s+([A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ' -]{3,55}?)(?=\s+(?:Casablanca|Rabat|Tanger|Adresse|Portable|Email|\d{1,4}\s+LOT)\b|\s*\|)"
_IDENTITY_BLOCK = r"\b[MF]\s*\|\s*((?:EL\s+|AL\s+)?[A-ZÀ-ÖØ-Þ]{2,25}(?:\s+[A-ZÀ-ÖØ-Þ]{2,25}){1,3}?)\s+[A-ZÀ-ÖØ-Þ]{3,20}\s+(?=(?:Acq\w*|Reste|Repos|Cong[ée]s)\b)"
_JOINED = r"\b[MF]\s*\|\s*((?:EL\s+|AL\s+)?[A-ZÀ-ÖØ-Þ]+?)(MOHAMED|MOHAMMED|HAMZA|YOUNESS|YAHYA|AHMED|AMINE|OMAR|ALI)(?=\s+\d{1,4}\s+LOT\b)"
_JOB_GRID = r"Fonction\s*\|\s*D[ée]partement\s*\|\s*Type\s+Salaire\s*\|\s*Matricule\s+([^|]{2,60}?)\s*\|"
_HIRE_HEAD = r"Date\s+(?:de\s+)?naissance\s*\|\s*Date\s+(?:d['’]?\s*)?embauche\s*\|\s*"
_NET_LABEL = r"(?:SALAIRE\s+NET|NET\s*[ÀA]?\s*P(?:AYER|ATER|KYER)|NET\s+PAY[EÉ])"
_CELL = r"-?\s*\d[\d ]*(?:[,.]\d{1,2})"
LAYOUTS = (
    Layout("nom", "nom", _LABELLED, "{1}", 0.90, True, "upper"), Layout("prenom", "nom", _LABELLED, "{2}", 0.90, True, "title"),
    Layout("nom", r"\b(el|al) ", _EL_TITLED, "{1}", 0.88, False, "upper"), Layout("prenom", r"\b(el|al) ", _EL_TITLED, "{2}", 0.88, False, "title"),
    Layout("nom", "madame|monsieur|mlle|mme|mr", _SIMPLE_TITLED, "{1}", 0.86, False, "upper"), Layout("prenom", "madame|monsieur|mlle|mme|mr", _SIMPLE_TITLED, "{2}", 0.86, False, "title"),
    Layout("nom", r"\bm", _STREET_TITLED, "{1}", 0.88, False, "upper"), Layout("prenom", r"\bm", _STREET_TITLED, "{2}", 0.88, False, "title"),
    Layout("nom", "madame|monsieur|mme|mr", _LONG_TITLED, "{1}", 0.66, False, "last"), Layout("prenom", "madame|monsieur|mme|mr", _LONG_TITLED, "{1}", 0.66, False, "but last"),
    Layout("periode", "periode", r"P[ée]riode(?:\s+de\s+paie)?\s+du\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\s*(?:\|\s*)?au\s*:?\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", replaces=True),
    Layout("periode", "bulletin", rf"BULLETIN\s+DE\s+PAIE\s*\|?\s*P[ée]riode\s*\|?\s*({FRENCH}\s+(?:19|20)\d{{2}})", replaces=True),
    Layout("periode", "bulletin", rf"BULLETIN\s+DE\s+PAIE\s*\|?\s*({FRENCH}\s+\d{{4}})\s*\|?\s*P[ée]riode\b", replaces=True),
    Layout("periode", "bulletin|periode", rf"(?:Bulletin\s+de\s+paie\s+(?:P[ée]riode(?:\s+de\s+paie)?\s*:?\s*)?|P[ée]riode(?:\s+de\s+paie)?\s*:?\s*)((?:\d{{1,2}}\s*/\s*\d{{4}})|{FRENCH}\s+\d{{4}})", replaces=True),
    Layout("periode", "periode", r"P[ée]riode(?:\s+de\s+paie)?\s+du\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\s*(?:\|\s*)?au\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", "{1} au {2}", 0.92, True),
    Layout("periode", "bulletin", r"(?:BULLETIN\s*DE\s*PAIE.{0,30}?)\bP\s*:\s*(\d{2})(\d{2})(\d{2})\b", "{2}/20{3}", 0.58, check="month"),
    Layout("date_embauche", "date", rf"Date\s+(?:(?:d['’]?\s*)?embauche|d['’]?\s*entr[ée]e)\s*(?:\||:)?\s*({DAY})", replaces=True),
    Layout("date_embauche", "entree", rf"\bEntr[ée]e\s*:?[ ]*({DAY})"),
    Layout("date_embauche", "anciennete", rf"Date\s+naissance\s*\|\s*Date\s+(?:d['’]?\s*)?embauche\s*\|\s*Date\s+anciennet[ée].{{0,180}}?\|\s*({DAY})\s*\|\s*({DAY})\s*\|\s*({DAY})", "{2}"),
    Layout("date_embauche", "anciennete", rf"Date\s+(?:d['’]?\s*)?Entr[ée]e\s*\|\s*Date\s+Anciennet[ée].{{0,260}}?({DAY})\s*\|\s*({DAY})"),
    Layout("date_embauche", "anciennete", rf"{_HIRE_HEAD}Date\s+anciennet[ée]\s*\|?.{{0,220}}?({DAY})\s*\|\s*({DAY})\s*\|\s*({DAY})", "{2}", 0.72, True, check="hired"),
    Layout("date_embauche", "anciennete", rf"{_HIRE_HEAD}Anciennet[ée]\s*\|\s*Fonction.{{0,160}}?({DAY})\s*\|\s*({DAY})", "{2}", 0.78, check="hired"),
    Layout("nom", "societe", _COMPANY_EMPLOYEE, "{1}", 0.90, True, "upper"), Layout("prenom", "societe", _COMPANY_EMPLOYEE, "{2}", 0.90, True, "title"),
    Layout("prenom", "classe", _CLASSED, "{2}", 0.78, False, "first", "two words"), Layout("nom", "classe", _CLASSED, "{2}", 0.78, False, "rest", "two words"),
    Layout("prenom", r"\|", _COMPACT, "{2}", 0.82, False, "title"), Layout("nom", r"\|", _COMPACT, "{3}", 0.82, False, "upper"), Layout("poste", r"\|", _COMPACT, "{4}", 0.78),
    Layout("nom", "employe", _NUMBERED, "{2}", 0.84, False, "upper"), Layout("prenom", "employe", _NUMBERED, "{3}", 0.84, False, "title"),
    Layout("nom", "employe", _INTERLEAVED, "{2}", 0.78, False, "upper"), Layout("prenom", "employe", _INTERLEAVED, "{3}", 0.78, False, "title"),
    Layout("poste", "fonction", r"Fonction\s*\|\s*D[ée]partement\s*\|\s*Type\s+Salaire\s*\|\s*Matricule\s+([^|]{2,60}?)\s*\|\s*[^|]*\|\s*[^|]*\|\s*(\d{2,10}[A-Z]?)(?=\s+Date\s+(?:d['’]?\s*)?Entr[ée]e|\s*$)", "{1}", 0.82),
    Layout("poste", "emploi", r"MATRICULE\s*\|\s*SERVICE\s*\|\s*EMPLOI\s+([A-Z0-9._-]{3,20})\s*\|\s*([^|]{0,40})\|\s*([^|]{2,60})", "{3}", 0.72),
    Layout("nom", "employe|matricule", _NUMBER_NAME, "{2}", 0.78, False, "surname", "two words"), Layout("prenom", "employe|matricule", _NUMBER_NAME, "{2}", 0.78, False, "given", "two words"),
    Layout("poste", "classe", r"\b\d{3,5}\s+([A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ ]{5,70}?)\s+\d{3,8}[A-Z]?\s+[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ' -]+\s+Classe\b"),
    Layout("poste", "emploi", r"\bEMPLOI\s*:?[ ]*([^|]{2,70}?)(?=\s*\|)"),
    Layout("poste", "emploi", r"Emploi\s+occup[ée]\s*(?:\||:)?\s*([A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ /&'\-]{2,60})(?=\s*\|\s*(?:D[ée]partement|Qualification|N\s*[°º]?\s*SIRET)|\s+(?:D[ée]partement|Qualification|N\s*[°º]?\s*SIRET)\b)"),
    Layout("poste", "fonction", _JOB_GRID),
    Layout("poste", "fonction", rf"Date\s+(?:de\s+)?Naissance\s*\|\s*Date\s+(?:d['’]?\s*)?embauche.*?\|\s*Fonction\s+{DAY}\s*\|\s*{DAY}\s*\|(?:\s*\|)?\s*([^|]{{3,60}}?)(?=\s+\d{{1,5}}\s*\|)"),
    Layout("poste", "emploi", r"Emploi\s+occup[ée]\s*\|\s*D[ée]partement\s*\|\s*([A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ /&'\-]{2,60})(?=\s*\|\s*Qualification\b)"),
    Layout("poste", "fonction", r"Fonction\s+(.{3,55}?)(?=\s+N[°º]\s*CIN|\s+Balaire\s+Horaire)", "{1}", 0.48, False, "last cell", "job"),
    Layout("employeur", "direction|di rection", r"\[PAGE\s+1\]\s+([A-Z][A-Z0-9&.-]{2,20})\s+(?:Di\s*rection|Direction)"),
    Layout("employeur", r"\bs", r"\b((?:SAS|SA|SARL|S\.A\.|S\.A\.R\.L\.)\s+[A-ZÀ-ÖØ-öø-ÿ0-9&.' -]{2,70}?)(?=\s*\||\s+\d{1,4}\s*(?:rue|avenue|av\b))"),
    Layout("employeur", "bulletin", r"(?s)^(?=.{0,850}BULLETIN).*?(?:\[PAGE\s+1\]\s*)?([A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ0-9.&'\- ]{2,50}?)\s*\|?\s*BULLETIN\s+DE\s+(?:PAIE|SALAIRE)\b", "{1}", 0.72, False, "name", "company"),
    Layout("employeur", "societe", r"SOCI[ÉE]T[ÉE]\s*\|\s*EMPLOY[ÉE]\s+([^|]{2,80}?)\s*\|\s*\d{2,10}[A-Z]?\s+[A-ZÀ-ÖØ-öø-ÿ]"),
    Layout("employeur", "contact center|budget general", r"\b([A-ZÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ&.' -]{2,70}(?:Contact\s+Center|Budget\s+g[ée]n[ée]ral))\b"),
    Layout("salaire_net", "total retenue", rf"SALAIRE\s+BRUT(?:\s*\|\s*|\s+)BRUT\s+IMPOSABLE(?:\s*\|\s*|\s+)TOTAL\s+RETENUES?(?:\s*\|\s*|\s+)SALAIRE\s+NET\s+(?:{_CELL}(?:\s*\|\s*|\s+)){{3}}({_CELL})", "{1}", 0.74, False, "amount"),
    Layout("salaire_net", "net", rf"{_NET_LABEL}\s*(?:\||:|-)?\s*(-?\s*\d[\d .]*(?:[,.]\d{{1,2}}))", "{1}", 0.78, False, "amount"),
    Layout("salaire_net", "net", r"NET\s*[ÀA]?\s*P(?:AYER|ATER|KYER)(?=.{0,500}$).*(?<!\d)((?:\d{1,3}(?:[ .]\d{3})+|\d+)[,.]\d{2})(?!\d)", "{1}", 0.62, False, "amount"),
    Layout("nom", "acq|reste|repos|conge", _IDENTITY_BLOCK, "{1}", 0.66, False, "block surname"), Layout("prenom", "acq|reste|repos|conge", _IDENTITY_BLOCK, "{1}", 0.66, False, "block given"),
    Layout("nom", "lot", _JOINED, "{1}", 0.50, False, "", "two letters"), Layout("prenom", "lot", _JOINED, "{2}", 0.50, False, "title"),
)


def folded(c: Column) -> Column:
    """Lower case without accents; everything but letters, digits and cell marks is a single blank."""
    # A text of as many bytes as characters has no accents, and translating is dear.
    plain = F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.translate(c, ACCENTED, PLAIN))
    return F.trim(F.regexp_replace(F.lower(plain), r"[^a-z0-9|]+", " "))


def titled(c: Column) -> Column:
    """Each part of a name with a capital, after blanks, hyphens and apostrophes."""
    return F.regexp_replace(F.initcap(F.regexp_replace(F.lower(c), r"(['’\-])", "$1 ")), r"(['’\-]) ", "$1")


def absolute_amount(c: Column) -> Column:
    """An amount without its sign: of comma and point the last one is the decimal sign, and either is it alone."""

    def plain(text: Column) -> Column:
        comma_last = F.instr(F.reverse(text), ",") < F.instr(F.reverse(text), ".")
        both = text.contains(",") & text.contains(".")
        return F.when(both & comma_last, F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(both, F.replace(text, F.lit(","), F.lit(""))).otherwise(F.replace(text, F.lit(","), F.lit(".")))

    # The amount is mostly cut out by a pattern, which each use of it would run again.
    read = lambda t: F.abs(F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), t.try_cast("double")))
    return _once(F.regexp_replace(c, r"[\s\x{A0}]", ""), lambda t: _once(plain(t), read))


def signed_amount(c: Column) -> Column:
    """absolute_amount with the sign that the text starts with."""
    text = strip_white(c)
    value = absolute_amount(F.regexp_replace(text, r"^[- ]+", ""))
    return F.when(text.startswith("-"), -value).otherwise(value)


def _once(c: Column, use) -> Column:
    """use(c), with c computed once however often it is used."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _year(c: Column, pivot: int) -> Column:
    """Four digits of a year; two digits below the pivot are of the 2000s, others of the 1900s."""
    return _once(c, lambda y: F.when(F.length(y) == 2, F.concat(F.when(y.try_cast("int") < pivot, "20").otherwise("19"), y)).otherwise(y))


def _day(parts: list[Column], month: Column | None = None) -> Column:
    """dd/MM/yyyy of day, month and year as text; two digits of a year from 50 on lie in the 1900s. NULL where there is no such day."""
    year = _year(parts[2], 50)
    number = F.lpad((month if month is not None else parts[1]).cast("string"), 2, "0")
    return F.date_format(F.try_to_date(F.concat_ws("-", year, number, F.lpad(parts[0], 2, "0")), "yyyy-MM-dd"), "dd/MM/yyyy")


def month_number(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])[folded(name)]


def dates_on_line(raw: Column) -> Column:
    """The dates of a line as dd/MM/yyyy: those with marks, then those with a month's name, then those with blanks."""
    found = lambda pattern, named: F.transform(
        F.regexp_extract_all(raw, F.lit(pattern), F.lit(0)), lambda m: (lambda g: _day(g, month_number(g[1]) if named else None))([F.regexp_extract(m, pattern, i) for i in (1, 2, 3)])
    )
    return F.filter(F.concat(found(NUMERIC_DATE, False), found(TEXT_DATE, True), found(SPACED_DATE, False)), lambda d: d.isNotNull())


def valid_employment_date(c: Column, today: Column) -> Column:
    """Whether the text is a day from 1940 to today, with slashes, hyphens or points, the year in two or four digits, or as yyyy-MM-dd."""
    def read(text: Column) -> Column:
        parts = [F.regexp_extract(text, r"^(\d{1,2})([./-])(\d{1,2})\2(\d{4}|\d{2})$", i) for i in (1, 3, 4)]
        # Two digits are of 1969 to 2068.
        date = F.when(parts[0] != "", F.try_to_date(F.concat_ws("-", _year(parts[2], 69), F.lpad(parts[1], 2, "0"), F.lpad(parts[0], 2, "0")), "yyyy-MM-dd"))
        return F.coalesce(date, F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d")))

    return _once(_once(strip_white(c), read), lambda day: F.coalesce((day >= F.lit("1940-01-01").cast("date")) & (day <= today), F.lit(False)))


def valid_pay_period(c: Column) -> Column:
    """Whether the text is a month and year in digits, a French month's name and a year, or two days with `au` between them."""
    text = strip_white(F.regexp_replace(c, r"\s+", " "))
    shapes = (r"(?:0?[1-9]|1[0-2])\s*/\s*(?:19|20)\d{2}", rf"{FRENCH}\s+(?:19|20)\d{{2}}", r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\s+au\s+\d{1,2}[/-]\d{1,2}[/-]\d{2,4}")
    return F.coalesce(text.rlike("(?iU)^(?:" + "|".join(shapes) + ")$"), F.lit(False))


def _words(c: Column) -> Column:
    return F.filter(F.split(strip_white(c), r"\s+"), lambda w: w != "")


def _joined(words: Column, start: int, stop: int | None = None) -> Column:
    """Words from `start` on, counted from 0, without the last -stop."""
    return F.array_join(F.slice(words, F.lit(start + 1), F.greatest(F.size(words) - start + (stop or 0), F.lit(0))), " ")


def _formed(c: Column, form: str) -> Column:
    words = _words(c)
    # EL and AL belong to the surname.
    article = F.upper(F.get(words, F.lit(0))).isin("EL", "AL") & (F.size(words) >= 3)
    forms = {
        "": lambda: c, "upper": lambda: F.upper(c), "title": lambda: titled(c), "last": lambda: F.upper(F.try_element_at(words, F.lit(-1))), "but last": lambda: titled(_joined(words, 0, -1)), "first": lambda: titled(F.get(words, F.lit(0))),
        "rest": lambda: F.upper(_joined(words, 1)), "surname": lambda: F.upper(F.when(article, F.array_join(F.slice(words, 1, 2), " ")).otherwise(F.get(words, F.lit(0)))), "given": lambda: titled(F.when(article, _joined(words, 2)).otherwise(_joined(words, 1))),
        "block surname": lambda: F.when(article, F.array_join(F.slice(words, 1, 2), " ")).otherwise(_joined(words, 0, -1)), "block given": lambda: titled(F.when(article, _joined(words, 2)).otherwise(F.try_element_at(words, F.lit(-1)))),
        "last cell": lambda: F.regexp_replace(c, r"^.*\|\s*", ""), "name": lambda: F.regexp_replace(c, r"^[ |:\-]+|[ |:\-]+$", ""), "amount": lambda: absolute_amount(c).cast("string"),
    }
    return forms[form]()


def _holds(value: Column, raw: Column, groups: list[Column], check: str, today: Column) -> Column:
    checks = {
        "": lambda: F.lit(True), "hired": lambda: valid_employment_date(value, today), "two words": lambda: F.size(_words(raw)) >= 2, "job": lambda: F.length(value).between(3, 55), "company": lambda: (value != "") & ~F.upper(value).isin("LE", "UN", "MON"),
        "month": lambda: groups[0].cast("int").between(1, 31) & groups[1].cast("int").between(1, 12), "two letters": lambda: F.length(raw) >= 2,
    }
    return checks[check]()


def page_of(text: Column, quote: Column) -> Column:
    """The number of the page that a quote starts on, by the last page mark before it; 1 without a mark."""
    before = F.substring(text, F.lit(1), F.instr(text, quote) - 1)
    return F.coalesce(F.nullif(F.regexp_extract(before, r"(?is)^.*\[PAGE\s+(\d+)\]", 1), F.lit("")).try_cast("int"), F.lit(1))


def layout_values(docs: DataFrame, key: str, text: str, today: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, field, value, confidence, page, quote, rank, replaces): what each layout finds in each document, its text as one line.

    A layout's pattern runs only on texts that match its anchor. NULL text: nothing. rank: the layout's place in the table.
    """
    day = F.lit(today).cast("date")
    flat = strip_white(F.regexp_replace(F.col(text), r"[\s\x{A0}]+", " "))
    rows = docs.select(key, flat.alias("_text")).withColumn("_folded", folded(F.col("_text")))
    shapes: dict[tuple[str, str], list[int]] = {}
    for rank, layout in enumerate(layouts):
        shapes.setdefault((layout.anchor, layout.pattern), []).append(rank)
    # Each pattern looks for its quote once; groups are read where there is one, and shared by the layouts with that pattern.
    tried = [F.when(F.col("_folded").rlike(anchor), F.struct(F.lit(i).alias("shape"), F.regexp_extract("_text", "(?iU)" + pattern, 0).alias("quote"))) for i, (anchor, pattern) in enumerate(shapes)]
    quoted = rows.select(key, "_text", F.explode(F.array(*tried)).alias("q")).select(key, "_text", "q.*").where("quote <> ''")
    groups = None
    for i, ((_, pattern), ranks) in enumerate(shapes.items()):
        used = {n for r in ranks for n in range(1, 5) if f"{{{n}}}" in layouts[r].value or (layouts[r].check == "month" and n == 1)}
        read = F.array(*[F.regexp_extract("_text", "(?iU)" + pattern, n) if n in used else F.lit("") for n in range(1, max(used) + 1)])
        groups = F.when(F.col("shape") == i, read) if groups is None else groups.when(F.col("shape") == i, read)
    of_shape = F.get(F.array(*[F.array(*map(F.lit, ranks)) for ranks in shapes.values()]), F.col("shape"))
    each = quoted.withColumn("_groups", groups).select(key, "_text", "quote", "_groups", F.explode(of_shape).alias("rank"))

    def by_layout(attribute: str, made) -> Column:
        """made(value of the attribute) for the layouts that have that value."""
        out = None
        for value in dict.fromkeys(getattr(layout, attribute) for layout in layouts):
            own = F.col("rank").isin([r for r, layout in enumerate(layouts) if getattr(layout, attribute) == value])
            out = F.when(own, made(value)) if out is None else out.when(own, made(value))
        return out

    def filled(template: str) -> Column:
        parts, rest = [], template
        while "{" in rest:
            head, _, rest = rest.partition("{")
            parts += [F.lit(head), F.get("_groups", F.lit(int(rest[0]) - 1))]
            rest = rest[2:]
        return strip_white(F.regexp_replace(F.concat(*parts, F.lit(rest)), r"\s+", " "))

    hits = settled(settled(each, {"raw": by_layout("value", filled)}), {"value": by_layout("form", lambda form: _formed(F.col("raw"), form))}).where("value is not null and value <> ''")
    first_two = [F.get("_groups", F.lit(i)) for i in (0, 1)]
    hits = hits.where(by_layout("check", lambda check: _holds(F.col("value"), F.col("raw"), first_two, check, day)))
    fixed = lambda attribute: F.get(F.array(*[F.lit(getattr(layout, attribute)) for layout in layouts]), F.col("rank"))
    return hits.select(key, fixed("field").alias("field"), "value", fixed("confidence").alias("confidence"), page_of(F.col("_text"), F.col("quote")).alias("page"), "quote", "rank", fixed("replaces").alias("replaces"))


def _held(c: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the labels stands in a text without blanks; of labels that hold one another the shortest says so."""
    bare = {w.replace(" ", "") for w in words}
    return reduce(or_, [c.contains(w) for w in sorted(bare) if not any(v != w and v in w for v in bare)])


def _labelled(c: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the labels stands in the text, with or without the blanks inside it."""
    return _once(F.replace(folded(c), F.lit(" "), F.lit("")), lambda bare: _held(bare, words))


def _cleaned(c: Column) -> Column:
    return strip_white(F.regexp_replace(F.regexp_replace(c, r"^[ |:\-\t]+|[ |:\-\t]+$", ""), r"\s+", " "))


def _after_label(cell: Column, words: tuple[str, ...]) -> Column:
    """What follows the longest label that a cell holds; empty if there is none."""
    plain = F.translate(cell, ACCENTED, PLAIN)

    def after(said: Column) -> Column:
        out = None
        for word in sorted(words, key=len, reverse=True):
            head = F.regexp_extract(plain, r"(?i)^.*?" + r"\W*".join(word.split()), 0)
            found = F.when(said.contains(word), _cleaned(F.substring(cell, F.length(head) + 1, F.length(cell))))
            out = found if out is None else F.coalesce(out, found)
        return F.coalesce(out, F.lit(""))

    return _once(folded(cell), after)


def labelled_values(docs: DataFrame, key: str, text: str, today: str) -> DataFrame:
    """(key, field, value, confidence, page, quote, rank, replaces): values that stand after their labels, in the next cell or below in the same column.

    A document's lines are read in order. Of a field's labelled lines the last one with a plausible value counts, of an employer's the
    first. Values below a label are looked for in the next three lines; other labels are no values. An employer may also be a
    line among the first 15 with a legal form. Net pay is the last amount above 0 and below ten million, not of lines on taxable or cumulated pay.
    """
    labels = tuple(w for group in LABELS.values() for w in group)
    day = F.lit(today).cast("date")
    compact = lambda c: F.replace(folded(c), F.lit(" "), F.lit(""))
    no_label = lambda c: _once(compact(c), lambda bare: ~_held(bare, labels + OTHER_LABELS))
    w = Window.partitionBy(key).orderBy("line_no")
    lines = text_rows(docs, key, text).withColumn("cells", F.transform(F.split("raw", r"\|"), strip_white))
    ahead = {f"next{i}": F.lead(F.struct("cells", "raw", "page"), i).over(w) for i in (1, 2, 3)}
    # What conditions read is computed once a line, before they are put anywhere; lines that hold none of the labels go.
    legal = (F.col("line_no") < 15) & F.col("raw").rlike(LEGAL_FORM) & ~F.col("raw").rlike(NO_EMPLOYER)
    lines = settled(lines.withColumns(ahead), {"_folded": folded(F.col("raw")), "legal": legal})
    lines = settled(lines, {"_compact": F.replace("_folded", F.lit(" "), F.lit(""))})
    lines = settled(lines, {f"is_{n}": _held(F.col("_compact"), words) for n, words in LABELS.items()}).where(reduce(or_, [F.col(f"is_{n}") for n in LABELS]) | F.col("legal"))
    lines = lines.withColumns({"below": F.filter(F.array(*[F.col(n) for n in ahead]), lambda x: x.isNotNull()), "bare": F.transform("cells", compact)}).drop(*ahead)

    def column_value(words: tuple[str, ...]) -> Column:
        """(value, raw, page) of the first cell with text, but no label, below the first cell that is labelled."""
        at = F.array_position(F.transform("bare", lambda c: _held(c, words)), True)
        cells = _once((at - 1).cast("int"), lambda i: F.transform("below", lambda x: F.struct(_cleaned(F.get(x["cells"], i)).alias("value"), x["raw"].alias("raw"), x["page"].alias("page"))))
        return F.get(F.filter(cells, lambda x: x["value"].isNotNull() & (x["value"] != "") & no_label(x["value"])), F.lit(0))

    def beside(words: tuple[str, ...]) -> Column:
        """What stands after a label in its cell, else in the next one."""
        next_cell = lambda c: _once(_cleaned(c), lambda n: F.when((n != "") & no_label(n), n))
        tries = F.transform("bare", lambda c, i: F.when(_held(c, words), F.coalesce(_once(_after_label(F.get("cells", i), words), lambda v: F.when(v != "", v)), next_cell(F.get("cells", i + 1)))))
        return F.get(F.filter(tries, lambda v: v.isNotNull()), F.lit(0))

    amounts = lambda c: F.filter(F.transform(F.regexp_extract_all(c, F.lit(AMOUNT), F.lit(0)), absolute_amount), lambda a: a.isNotNull())
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    of = lambda field: F.col(f"is_{field}")
    # Each field's own evidence on the line, and what stands below where the line has none; NULL on lines without its label.
    paid_line = of("salaire_net") & ~F.col("_folded").contains("net imposable") & ~F.col("_folded").contains("cumul")
    # Plain columns: a generator with a function of arrays in it would run uncompiled as a whole.
    lines = lines.withColumns(
        {
            "d_own": F.when(of("date_embauche"), dates_on_line(F.col("raw"))), "p_own": F.when(of("periode"), dates_on_line(F.col("raw"))), "n_own": F.when(paid_line, amounts(F.col("raw"))),
            "j_own": F.when(of("poste"), beside(LABELS["poste"])), "e_own": F.when(of("employeur"), beside(LABELS["employeur"])),
        }
    )
    lines = lines.withColumns(
        {
            "d_down": F.when(F.size("d_own") == 0, column_value(LABELS["date_embauche"])), "p_down": F.when(F.size("p_own") == 0, column_value(LABELS["periode"])), "n_down": F.when(F.size("n_own") == 0, column_value(LABELS["salaire_net"])),
            "j_down": F.when(of("poste") & F.col("j_own").isNull(), column_value(LABELS["poste"])), "e_down": F.when(of("employeur") & F.col("e_own").isNull(), column_value(LABELS["employeur"])),
        }
    )
    lines = lines.withColumns(
        {
            "d": F.get(F.when(F.size("d_own") > 0, F.col("d_own")).otherwise(dates_on_line(F.col("d_down.value"))), F.lit(0)), "days": F.when(F.size("p_own") > 0, F.col("p_own")).otherwise(F.coalesce(dates_on_line(F.col("p_down.value")), empty("string"))),
            "said": F.when(F.size("p_own") >= 0, F.coalesce("p_down.value", "raw")), "n": F.try_element_at(F.filter(F.when(F.size("n_own") > 0, F.col("n_own")).otherwise(F.coalesce(amounts(F.col("n_down.value")), empty("double"))), lambda a: (a > 0) & (a < 10_000_000)), F.lit(-1)),
            "j": F.coalesce("j_own", "j_down.value"), "e": F.coalesce("e_own", "e_down.value"),
        }
    )

    def hit(field: str, value: Column, confidence: Column, down: str | None, replaces: bool = True, rank: int = 1000) -> Column:
        here = F.struct("raw", "page")
        source = F.when(F.col(down).isNotNull(), F.struct(F.col(f"{down}.raw").alias("raw"), F.col(f"{down}.page").alias("page"))).otherwise(here) if down else here
        made = F.struct(F.lit(field).alias("field"), value.alias("value"), confidence.cast("double").alias("confidence"), source["page"].alias("page"), F.regexp_replace(source["raw"], r"\s+", " ").alias("quote"), F.lit(replaces).alias("replaces"), F.lit(rank).alias("rank"))
        return F.when(value.isNotNull(), made)

    named = month_number(F.regexp_extract("said", MONTH_YEAR, 1))
    period = F.when(F.size("days") >= 2, F.concat(F.get("days", F.lit(0)), F.lit(" au "), F.get("days", F.lit(1)))).when(F.size("days") == 1, F.substring(F.get("days", F.lit(0)), 4, 7)).otherwise(F.concat(F.lpad(named.cast("string"), 2, "0"), F.lit("/"), F.regexp_extract("said", MONTH_YEAR, 2)))
    letters = lambda c: F.col(c).rlike(r"[A-Za-zÀ-ÖØ-öø-ÿ]{2}")
    values = {
        "v_date": F.when(F.col("d").isNotNull() & valid_employment_date(F.col("d"), day), F.col("d")), "v_period": F.when(F.col("said").isNotNull(), period),
        "v_job": F.when(letters("j") & ~_labelled(F.col("j"), ("departement", "service", "qualification")), F.substring("j", 1, 100)), "v_legal": F.when(F.col("legal"), F.substring(_cleaned(F.get("cells", F.lit(0))), 1, 120)),
    }
    kept = [key, "line_no", "page", "raw", "days", "n", "e", "d_down", "p_down", "n_down", "j_down", "e_down"]
    lines = lines.withColumns(values).select(*kept, *values)
    found = F.array(
        hit("date_embauche", F.col("v_date"), F.lit(0.91), "d_down"),
        hit("periode", F.col("v_period"), F.when(F.size("days") >= 2, 0.92).when(F.size("days") == 1, 0.84).otherwise(0.88), "p_down"),
        hit("salaire_net", F.col("n").cast("string"), F.lit(0.93), "n_down"),
        hit("poste", F.col("v_job"), F.lit(0.84), "j_down"),
        hit("employeur", F.when(letters("e"), F.substring("e", 1, 120)), F.lit(0.86), "e_down", False),
        hit("employeur", F.col("v_legal"), F.lit(0.88), None, False, 1001),
    )
    each = lines.select(key, "line_no", F.explode(found).alias("f")).where("f is not null").select(key, "line_no", "f.*")
    # One line counts for each field: the last, or the first for an employer.
    by = F.struct(F.when(F.col("replaces"), F.col("line_no")).otherwise(-F.col("line_no")), F.col("value"))
    best = each.groupBy(key, "field", "rank").agg(F.max_by(F.struct("value", "confidence", "page", "quote", "replaces"), by).alias("b"))
    return best.select(key, "field", "b.value", "b.confidence", "b.page", "b.quote", "rank", "b.replaces")


def titled_names(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, identity, page, quote): the first name of two to five words after a title, in the upper half or the first 12 lines of a document."""
    lines = text_rows(docs, key, text, "n").where(F.col("line_no") < F.greatest(F.lit(12), F.floor(F.col("n") / 2)))
    name = strip_white(F.regexp_replace(F.regexp_replace(F.regexp_extract("raw", TITLED, 1), NAME_END, ""), r"\s+", " "))
    named = lines.withColumn("identity", name).where(F.size(_words(F.col("identity"))).between(2, 5) & (F.col("identity") != ""))
    first = named.groupBy(key).agg(F.min(F.struct("line_no", "identity", "page", "raw")).alias("f"))
    return first.select(key, "f.identity", "f.page", F.regexp_replace("f.raw", r"\s+", " ").alias("quote"))


def reconciled_names(nom: Column, prenom: Column, identity: Column) -> tuple[Column, Column, Column]:
    """(nom, prenom, confidence of what was changed or NULL) from two fields and the name after a title.

    A surname that ends with the given name loses it. Else, where the titled name ends with the given name, the rest of it is the surname. Without both, its
    first word is the surname. Case does not matter in comparisons; NULL and blank fields are missing.
    """
    own, given, said = _words(F.lower(F.coalesce(nom, F.lit("")))), _words(F.lower(F.coalesce(prenom, F.lit("")))), _words(F.lower(F.coalesce(identity, F.lit(""))))
    shown = lambda c: _words(F.coalesce(c, F.lit("")))
    ends = lambda long: (F.size(given) > 0) & (F.size(long) > F.size(given)) & (F.slice(long, F.greatest(F.size(long) - F.size(given) + 1, F.lit(1)), F.size(given)) == given)
    head = lambda c: F.upper(F.array_join(F.slice(shown(c), F.lit(1), F.greatest(F.size(shown(c)) - F.size(given), F.lit(0))), " "))
    doubled, shared, fresh = ends(own), ends(said), (F.size(own) == 0) & (F.size(given) == 0) & (F.size(said) >= 2)
    new_nom = F.when(doubled, head(nom)).when(shared, head(identity)).when(fresh, F.upper(F.get(shown(identity), F.lit(0)))).otherwise(nom)
    new_prenom = F.when(fresh, titled(_joined(shown(identity), 1))).otherwise(prenom)
    return new_nom, new_prenom, F.when(doubled, 0.88).when(shared, 0.86).when(fresh, 0.68)


def payslip_values(docs: DataFrame, fields: DataFrame, key: str, text: str, today: str) -> DataFrame:
    """(key, field, value, confidence, page, quote, origin) of the payslip fields of docs (key, text).

    fields: (key, field, value, confidence, page, quote), what a model gave and citations proved; others are empty. Layouts write in their order, labels after
    them, and names are reconciled last. A layout is not held back by what the fields beside its own hold.
    """
    # Texts are dealt by document once, however few files they come from.
    # Their parts are twice as many as shuffles have, and are not merged by their size: reading takes long for few bytes, and would end up in a few tasks.
    docs = docs.select(key, text).repartition(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    found = layout_values(docs, key, text, today).unionByName(labelled_values(docs, key, text, today))
    # The line with a company's legal form also counts apart from its field.
    names = F.when(F.col("rank") == 1001, F.array("field", F.lit("_legal"))).otherwise(F.array("field"))
    found = found.select(key, F.explode(names).alias("field"), "value", "confidence", "page", "quote", "rank", "replaces")
    written = written_fields(fields.where(F.col("field").isin(*FIELDS)), found, key)
    parts = ("value", "confidence", "page", "quote", "origin")
    whole = written.groupBy(key).agg(F.collect_list(F.struct("field", *parts)).alias("_fields"))  # at most one of each field
    met = whole.join(titled_names(docs, key, text), key, "full")
    item = lambda n: F.get(F.filter("_fields", lambda x: x["field"] == n), F.lit(0))
    met = settled(met, {n: item(n) for n in ("nom", "prenom", "employeur", "_legal")})
    nom, prenom, sure = reconciled_names(F.col("nom.value"), F.col("prenom.value"), F.col("identity"))
    # A company's line with its legal form completes a name that is a part of it.
    fuller = F.coalesce(F.col("_legal.value").isNotNull() & (F.col("employeur.value") != F.col("_legal.value")) & folded(F.col("_legal.value")).contains(folded(F.col("employeur.value"))), F.lit(False))
    met = settled(met, {"new_nom": nom, "new_prenom": prenom, "sure": sure, "fuller": fuller})
    one = lambda n: (lambda changed: F.struct(
        F.lit(n).alias("field"), F.col(f"new_{n}").alias("value"), F.when(changed, F.col("sure")).otherwise(F.col(f"{n}.confidence")).alias("confidence"), F.when(changed, F.coalesce("page", f"{n}.page")).otherwise(F.col(f"{n}.page")).alias("page"),
        F.when(changed, F.coalesce("quote", f"{n}.quote")).otherwise(F.col(f"{n}.quote")).alias("quote"), F.when(changed, "replaced").otherwise(F.col(f"{n}.origin")).alias("origin"),
    ))(~F.col(f"new_{n}").eqNullSafe(F.col(f"{n}.value")))
    completed = lambda x: F.struct(x["field"].alias("field"), *[F.when(F.col("fuller") & (x["field"] == "employeur"), F.lit("replaced") if p == "origin" else F.col(f"_legal.{p}")).otherwise(x[p]).alias(p) for p in parts])
    others = F.transform(F.filter("_fields", lambda x: ~x["field"].isin("nom", "prenom", "_legal")), completed)
    every = F.concat(F.coalesce(others, F.array().cast("array<struct<field:string,value:string,confidence:double,page:int,quote:string,origin:string>>")), F.array(one("nom"), one("prenom")))
    return met.select(key, F.explode(every).alias("n")).select(key, "n.*").where("value is not null")


#: Labels of the totals, of the deductible parts and of earning rows.
TOTALS = {
    "salaire_brut": r"(?:TOTAL\s+BRUT|SALAIRE\s+BRUT(?!\s+IMPOSABLE))", "brut_imposable": r"(?:SALAIRE\s+BRUT\s+IMPOSABLE|BRUT\s+IMPOSABLE)",
    "total_retenues": r"(?:TOTAL\s+(?:DES\s+)?RETENUES?|TOTAL\s+(?:DES\s+)?COT(?:ISATIONS?|EETONS)(?:\s+ET\s+CONTR[IÍ]BUTIONS)?)", "salaire_net": _NET_LABEL,
}
TOTALS_HELD = {"salaire_brut": "brut", "brut_imposable": "brut", "total_retenues": "total", "salaire_net": "net"}
TOTALS_BLOCK = rf"SALAIRE\s+BRUT(?:\s*\|\s*|\s+)BRUT\s+IMPOSABLE(?:\s*\|\s*|\s+)TOTAL\s+RETENUES?(?:\s*\|\s*|\s+)SALAIRE\s+NET\s+((?:{_CELL}(?:\s*\|\s*|\s+)){{3}}{_CELL})"
SPLIT_WITHHELD = r"Total\s+des\s+retenues\s+d[ée]ductibles\s*(?:\||:)?\s*(-?\s*\d[\d .]*(?:[,.]\d{1,2})).{0,120}?Total\s+des\s+retenues\s+non\s+d[ée]ductibles\s*(?:\||:)?\s*(-?\s*\d[\d .]*(?:[,.]\d{1,2}))"
EARNING = r"(?iU)(?:Salaire\s+de\s+Base|Prime(?:\s+d['’]Anciennet[ée]|\s+Permanence)?\b|Majoration\b|Heures?\s+suppl[ée]mentaires?\b|Cplt\b|Compl[ée]ment\b|Contr\s+Patr\s+Sant[ée]|Ret\s+Cong[ée]\s+Pay[ée]|Paiem?t\s+Cong[ée]\s+Pay[ée])"
EARNINGS_BLOCK = r"(?isU)Salaire\s+de\s+Base\b.*?SALAIRE\s+BRUT(?:\s+MENS)?\b"
ROW_AMOUNT = r"-?\s*\d+(?:[ \x{A0}]\d{3})*(?:[,.]\d{1,2})"
BASE_LABEL = r"(?:(?:SALA(?:IRE|INE)|BALAIRE)\s+(?:PRINCIPAL|DE\s+BASE|BASE\s+HORAIRE|HORAIRE(?:\s+ANAPEC)?)|TRAITEMENT\s+DE\s+BASE(?:\s+INDICIAIRE)?)"


def nearest_identity(gross: Column, withheld: Column, net: Column) -> Column:
    """(distance, gross, withheld, net) of the candidates, one of each array, for which gross less withheld comes closest to net; of equals the first by place."""
    tries = F.flatten(F.transform(gross, lambda g, i: F.flatten(F.transform(withheld, lambda r, j: F.transform(net, lambda n, k: F.struct(F.abs(F.round(g - r - n, 6)).alias("distance"), i.alias("i"), j.alias("j"), k.alias("k"), g.alias("gross"), r.alias("withheld"), n.alias("net")))))))
    best = F.array_min(tries)
    return F.struct(best["distance"].alias("distance"), best["gross"].alias("gross"), best["withheld"].alias("withheld"), best["net"].alias("net"))


def earning_rows(text: Column) -> Column:
    """The signed amounts at the ends of the earning rows between base salary and gross pay."""
    block = F.regexp_extract(text, EARNINGS_BLOCK, 0)
    # Each label opens a row, so the labels part the block.
    rows = F.slice(F.split(F.regexp_replace(block, f"({EARNING})", "\x01$1"), "\x01"), 2, 1 << 20)
    last = F.transform(rows, lambda r: signed_amount(F.try_element_at(F.regexp_extract_all(r, F.lit(ROW_AMOUNT), F.lit(0)), F.lit(-1))))
    return F.filter(last, lambda a: a.isNotNull())


def pay_totals(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, salaire_brut, brut_imposable, total_retenues, salaire_net, salaire_base): totals by their labels.

    Four labels before four amounts are settled by gross less withheld being net. Deductible and other withholdings are added up. A gross pay that
    is not printed is the sum of three earning rows or more, if it is above 0. Base salary is the last amount of its line.
    """
    flat = {"_low": F.lower("_raw"), "_text": strip_white(F.regexp_replace("_raw", r"[\s\x{A0}]+", " "))}
    # Letters that a pattern cannot do without, and that no other than theirs are folded to, say whether it is tried.
    held = lambda words, found: F.when(reduce(or_, (F.col("_low").contains(w) for w in words)), found)
    block = held(("brut",), F.regexp_extract_all(F.regexp_extract("_text", "(?iU)" + TOTALS_BLOCK, 1), F.lit(_CELL), F.lit(0)))
    labelled = {f"l_{n}": held((TOTALS_HELD[n],), F.regexp_extract("_text", rf"(?iU){p}\s*(?:\||:|-)?\s*(-?\s*\d[\d .]*(?:[,.]\d{{1,2}}))", 1)) for n, p in TOTALS.items()}
    split = held(("retenue",), F.regexp_extract("_text", "(?iU)" + SPLIT_WITHHELD, 0))
    line = held(("ala", "tra"), F.get(F.regexp_extract_all("_raw", F.lit(rf"(?imU)^\s*{BASE_LABEL}\b[^\r\n]*$"), F.lit(0)), F.lit(0)))
    base = F.try_element_at(F.regexp_extract_all(line, F.lit(r"-?\s*\d+(?:[ \x{A0}]\d{3})*(?:[,.]\d{1,4})"), F.lit(0)), F.lit(-1))
    # Texts are dealt, as a few files may hold all, and each pattern runs once a text: first what it cuts out, then the amounts.
    rows = settled(docs.select(key, F.col(text).alias("_raw")).repartition(key), flat)
    rows = settled(rows, {"four": block, "split": split, "earned": held(("brut",), earning_rows(F.col("_raw"))), "base": base, **labelled}).drop("_raw", "_text", "_low")
    parts = {f"s{i}": absolute_amount(F.regexp_extract("split", "(?iU)" + SPLIT_WITHHELD, i)) for i in (1, 2)}
    rows = settled(rows, {"four": F.transform("four", absolute_amount), **{c: absolute_amount(F.col(c)) for c in ("base", *labelled)}, **parts})
    place = lambda i: F.get("four", F.lit(i))
    rows = settled(rows, {"block": F.when(F.size("four") == 4, nearest_identity(F.slice("four", 1, 2), F.array(place(2)), F.array(place(3))))})
    gross = F.coalesce("block.gross", "l_salaire_brut")
    summed = F.round(F.aggregate("earned", F.lit(0.0), lambda a, x: a + x), 2)
    gross = F.coalesce(gross, F.when((F.size("earned") >= 3) & (summed > 0), summed))
    taxable = F.coalesce(F.when(F.col("block").isNotNull(), F.when(F.col("block.gross") == place(0), place(1)).otherwise(place(0))), F.col("l_brut_imposable"))
    both = F.round(F.col("s1") + F.col("s2"), 2)
    withheld = F.coalesce("block.withheld", "l_total_retenues")
    withheld = F.when(both.isNotNull() & (withheld.isNull() | (withheld == F.col("s1")) | (withheld == F.col("s2"))), both).otherwise(withheld)
    return rows.select(key, gross.alias("salaire_brut"), taxable.alias("brut_imposable"), withheld.alias("total_retenues"), F.coalesce("block.net", "l_salaire_net").alias("salaire_net"), F.col("base").alias("salaire_base"))
