"""The stream of profiles gives the slots that a plain walk over the messages gives, replays and late messages included."""

from __future__ import annotations

import datetime as dt

from ledgerloom.operators.conversation import SLOTS
from ledgerloom.streaming import slots

AT = dt.datetime(2024, 1, 1, 10)
MESSAGES = [
    (1, 1, 0, "Je suis un infirmier avec 3 enfants", None), (1, 2, 1, "cdi", "statut_professionnel"), (2, 3, 1, "mon salaire est 12 000", None), (1, 4, 2, "public", "secteur_activite"), (1, 5, 3, "12 ans", "anciennete_annees"),
    (1, 6, 4, "revenu 9000 et charges 10", None), (2, 7, 5, "avocat", "profession"), (1, 8, 6, "apport de 20 k", None), (2, 9, 7, " ", "statut_professionnel"),
]


def run(spark, tmp_path, batches: list[list[tuple]], name: str) -> list[tuple]:
    schema = "conv bigint, event_id bigint, ts timestamp, message string, expected string"
    for n, rows in enumerate(batches):
        made = [(c, e, AT + dt.timedelta(minutes=m), t, x) for c, e, m, t, x in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"part={n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(*[str(tmp_path / name / "part=*")])
    out = slots.next_slots(stream.select("conv", "event_id", "ts", "message", "expected"), "conv")
    query = out.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-ckpt")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / f"{name}-out")).collect())


def test_next_slots(spark, tmp_path):
    got = run(spark, tmp_path, [MESSAGES], "whole")
    last = {c: n for c, _, n, _ in sorted(got, key=lambda r: r[1])}
    assert last == {1: "prix_bien", 2: "statut_professionnel"}
    first = next(r for r in got if r[1] == 1)
    assert first[2] == SLOTS[1] and first[3].split("|")[0] == SLOTS[1] and "autres_revenus_mensuels" not in first[3]
    # In two batches, with a replay of the first in the second.
    assert run(spark, tmp_path, [MESSAGES[:5], [*MESSAGES[:5], *MESSAGES[5:]]], "replayed") == got


def test_values_are_checked():
    assert slots.accepted("prix_bien", None, -1.0) is None and slots.accepted("prix_bien", "x", 0.0) == 0.0 and slots.accepted("profession", "  ", None) is None and slots.accepted("profession", "z" * 200, None) == "z" * 100
