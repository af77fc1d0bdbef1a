"""Identity cards and payslips: machine-readable zones, labelled values, and what may stand in a field."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import fold
from ledgerloom.operators.statements import settled

#: Words that are no person's name.
NO_NAMES = ("PERSONNE", "HOMME", "FEMME", "CARTE", "IDENTITE", "ROYAUME DU MAROC", "MAROC")
SEXES = {"M": "M", "MASCULIN": "M", "H": "M", "F": "F", "FEMININ": "F"}
CARD = r"^[A-Z]{1,2}[0-9]{5,8}$"


def mrz_fields(df: DataFrame, key: str, text: str, today: str) -> DataFrame:
    """(key, cin, birth, sex, expiry, surname, given) from the machine-readable zone of a card; pages without one have no row.

    Years of birth above today's two digits lie in the 1900s. The longest filler at the end of the names parts them.
    """
    compact = F.translate(F.regexp_replace(F.upper(F.col(text)), r"[^A-Z0-9<\\]", ""), "\\", "<")
    zone = df.select(key, F.when(F.instr(compact, "IDMAR") > 0, F.substring(compact, F.instr(compact, "IDMAR"), F.length(compact))).alias("z")).where("z is not null")
    line = r"^(.*?)(\d{6})\d?([MF])(\d{6})\d?MAR(.*)$"
    g = lambda i: F.regexp_extract("z", line, i)
    day = lambda c, century: F.try_to_date(F.concat(century, c), "yyyyMMdd")
    pivot = int(today[2:4])
    birth = day(g(2), F.when(F.substring(g(2), 1, 2).try_cast("int") > pivot, "19").otherwise("20"))
    tail = F.regexp_replace(F.regexp_replace(g(5), r"^[<C]*\d?", ""), r"\d.*$", "")
    names = F.regexp_replace(F.regexp_replace(tail, r"[<C]+$", ""), r"^<+", "")
    parted = F.when(~names.contains("<<") & names.contains("CC"), F.regexp_replace(names, "^(.*?)CC", "$1<<")).otherwise(names)
    part = lambda i: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(parted, r"^(.*[^<])<{2,}(.*)$", i), "<+", " ")), F.lit(""))
    return zone.where(g(3) != "").select(
        key, F.element_at(F.regexp_extract_all(g(1), F.lit(r"[A-Z]{1,2}\d{5,8}"), F.lit(0)), -1).alias("cin"), F.date_format(birth, "dd/MM/yyyy").alias("birth"), g(3).alias("sex"),
        F.date_format(day(g(4), F.lit("20")), "dd/MM/yyyy").alias("expiry"), part(1).alias("surname"), part(2).alias("given"),
    )


def merged_identity(visible: DataFrame, zone: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields as printed where they could be read, else from the machine-readable zone."""
    v, z = visible.select(key, *[F.col(f).alias(f"v_{f}") for f in fields]), zone.select(key, *[F.col(f).alias(f"z_{f}") for f in fields])
    return v.join(z, key, "full").select(key, *[F.coalesce(f"v_{f}", f"z_{f}").alias(f) for f in fields])


def identity_safety(df: DataFrame) -> DataFrame:
    """df (sex, cin, surname, address) with values that cannot stand in their field set to NULL, and the fields rejected."""
    plain = lambda c: F.upper(fold(F.col(c)))
    sex = F.create_map(*[F.lit(x) for kv in SEXES.items() for x in kv])[plain("sex")]
    cin = F.when(F.regexp_replace(plain("cin"), " ", "").rlike(CARD), F.regexp_replace(plain("cin"), " ", ""))
    name = F.when(~plain("surname").isin(*NO_NAMES), F.col("surname"))
    bare = F.regexp_replace(plain("address"), " ", "")
    address = F.when(~(bare.rlike(CARD) | F.coalesce(bare == F.regexp_replace(plain("cin"), " ", ""), F.lit(False)) | (F.length(plain("address")) < 8)), F.col("address"))
    new = {"sex": sex, "cin": cin, "surname": name, "address": address}
    lost = F.array_compact(F.array(*[F.when(F.col(n).isNotNull() & c.isNull(), n) for n, c in new.items()]))
    return df.select(*[c for c in df.columns if c not in new], *[c.alias(n) for n, c in new.items()], F.array_join(lost, "|").alias("rejected"))


def label_values(lines: DataFrame, key: str, line_no: str, raw: str, labels: dict[str, str]) -> DataFrame:
    """(key, field, value): what follows a label in its cell, in the next cell, or in the same column of the next three rows.

    labels: field to a pattern over folded text; the surveyed vocabulary, its bounds of amounts and its exclusions are not here. The last
    labelled line of a document wins.
    """
    w = Window.partitionBy(key).orderBy("_line_no")
    cells = lambda c: F.transform(F.split(c, r"\|"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    below = [f"n{i}" for i in (1, 2, 3)]
    rows = lines.select(key, F.col(line_no).alias("_line_no"), F.col(raw).alias("_raw")).withColumns({n: F.lead("_raw", i + 1).over(w) for i, n in enumerate(below)})
    each = rows.select(key, "_line_no", *below, cells(F.col("_raw")).alias("cells")).select(key, "_line_no", *below, "cells", F.posexplode("cells").alias("at", "cell"))
    # A cell is folded once for all labels; the rows below are cut into cells only where a label was found.
    plain = settled(each, {"plain": fold(F.col("cell"))})
    own = lambda p: F.nullif(F.regexp_replace(F.regexp_replace(F.col("plain"), f"^.*?(?:{p})", ""), r"^[\s:=\-]+", ""), F.lit(""))
    hits = F.array_compact(F.array(*[F.when(F.col("plain").rlike(p), F.struct(F.lit(f).alias("field"), own(p).alias("own"))) for f, p in labels.items()]))
    hit = plain.select(key, "_line_no", "at", "cells", *below, F.explode(hits).alias("h"))
    value = F.coalesce("h.own", F.nullif(F.get("cells", F.col("at") + 1), F.lit("")), *[F.nullif(F.get(cells(F.col(n)), F.col("at")), F.lit("")) for n in below])
    found = hit.select(key, F.col("h.field").alias("field"), F.struct("_line_no", "at").alias("place"), value.alias("value")).where("value is not null")
    return found.groupBy(key, "field").agg(F.max_by("value", "place").alias("value"))


def payslip_fields(lines: DataFrame, key: str, line_no: str, raw: str, layouts: list[tuple[str, str, float]]) -> DataFrame:
    """(key, field, value, confidence) from a table of layouts (field, pattern with one group, confidence): the surest rule wins, then the first line.

    The surveyed project's own layouts are not here; the caller brings the table.
    """
    rules = F.array(*[F.struct(F.lit(f).alias("field"), F.regexp_extract(F.col(raw), p, 1).alias("value"), F.lit(c).alias("confidence")) for f, p, c in layouts])
    found = lines.select(key, line_no, F.explode(rules).alias("r")).select(key, line_no, "r.*").where("value <> ''")
    w = Window.partitionBy(key, "field").orderBy(F.col("confidence").desc(), line_no, "value")
    best = found.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return best.select(key, "field", "value", "confidence")



#: Numbers, addresses, places of birth and names as they are printed on a card, and their confidences.
PRINTED = {
    "cin": (r"(?:\bCIN\b|\bCNIE\b|N\s*[°ºO]?)[\s:.\-]*([A-Z]{1,2}\s*\d{5,8})", 0.86), "adresse": (r"\bADRES{1,2}E?\b[\s:|.\-]+(.+?)(?=\s+IDMAR|$)", 0.74),
    "lieu_naissance": (r"(?:N[ÉE]E?\s+À|N[ÉE]E?\s+A|LIEU\s+DE\s+NAISSANCE|\bÀ)[\s:.\-]+([A-Z][A-Z '\\\-]{2,30})", 0.72),
}
ON_PAGE = {
    "cin": (r"(?:\bCIN\b|\bCNIE\b|N\s*[°ºO])\s*([A-Z]{1,2}\d{5,8})", 1, 0.82), "adresse": (r"(\d{1,4}(?:\s+[A-Z]+){0,8}\s+(?:APPT|APT)\s+\d+(?:\s+[A-Z]+){1,4})\s+IDMAR", 1, 0.58),
}
NAMES = r"(?:^|\s)(?:\d{1,4}\s+)?([A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'\-]{1,30})\s+((?:EL\s+)?[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'\-]{1,40})\s+N[ÉEÈ]E?\s+LE\b"
NAMES_SURE = 0.82
NO_PLACES = ("MAROC", "CARTE NATIONALE D IDENTITE")


def visible_identity(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """(key, field, value, confidence, page, quote) of what a card shows: cin, adresse, lieu_naissance by lines, the last labelled line counts; prenom and nom by page, the last page counts.

    Number and address are looked for on the whole page where no line up to it has them. Addresses of under eight characters and the country are no values.
    """
    lines = F.filter(F.transform(F.split(F.col(text), r"\r\n|[\r\n]"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    each = pages.select(key, F.col(page).alias("page"), F.posexplode(lines).alias("line_no", "raw")).withColumn("upper", F.upper("raw"))
    tidy = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[ \-:.,]+|[ \-:.,]+$", "")
    part = lambda n, c: F.nullif(F.regexp_extract(c, ("(?i)" if n == "adresse" else "") + PRINTED[n][0], 1), F.lit(""))
    address, place = tidy(part("adresse", F.col("raw"))), tidy(part("lieu_naissance", F.col("upper")))
    values = {"cin": F.regexp_replace(part("cin", F.col("upper")), r"\s+", ""), "adresse": F.when(F.length(address) >= 8, address), "lieu_naissance": F.when(~place.isin(*NO_PLACES) & (place != ""), place)}
    made = [F.when(v.isNotNull(), F.struct(F.lit(n).alias("field"), v.alias("value"), F.lit(PRINTED[n][1]).alias("confidence"))) for n, v in values.items()]
    by_line = each.select(key, "page", "line_no", "raw", F.explode(F.array_compact(F.array(*made))).alias("f")).select(key, "page", "line_no", F.col("raw").alias("quote"), "f.*")

    whole, upper = F.trim(F.regexp_replace(F.col(text), r"^\s+|\s+$", "")), F.upper(F.col(text))
    found = {n: (F.nullif(F.regexp_extract(upper, p, g), F.lit("")), sure) for n, (p, g, sure) in ON_PAGE.items()}
    found["adresse"] = (F.trim(F.regexp_replace(found["adresse"][0], r"\s+", " ")), found["adresse"][1])
    named = {"prenom": (F.nullif(F.regexp_extract(upper, NAMES, 1), F.lit("")), NAMES_SURE), "nom": (F.nullif(F.regexp_extract(upper, NAMES, 2), F.lit("")), NAMES_SURE)}
    made = [F.when(v.isNotNull(), F.struct(F.lit(n).alias("field"), v.alias("value"), F.lit(s).alias("confidence"))) for n, (v, s) in (found | named).items()]
    by_page = pages.select(key, F.col(page).alias("page"), whole.alias("quote"), F.explode(F.array_compact(F.array(*made))).alias("f")).select(key, "page", F.lit(-1).alias("line_no"), "quote", "f.*")
    first = by_line.groupBy(key, "field").agg(F.min("page").alias("first"))
    # A page as a whole speaks only before any line has spoken.
    late = F.col("field").isin(*ON_PAGE) & (F.col("page") >= F.col("first"))
    by_page = by_page.join(first, [key, "field"], "left").where(~F.coalesce(late, F.lit(False))).drop("first")
    early = F.when(F.col("field").isin(*ON_PAGE) & (F.col("line_no") < 0), -F.col("page")).otherwise(F.col("page"))
    every = by_line.unionByName(by_page)
    best = every.groupBy(key, "field").agg(F.max_by(F.struct("value", "confidence", "page", "quote"), F.struct(F.when(F.col("line_no") >= 0, 1).otherwise(0), early, "line_no")).alias("b"))
    return best.select(key, "field", "b.*")
