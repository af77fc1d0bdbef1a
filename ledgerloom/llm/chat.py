"""Chat formatting by token-level assembly (operator 5).

Each turn becomes ids: reserved ids mark its start, the end of its role and its end, and role and
text are encoded apart from each other, so no marker can arise from content. Content is
escaped besides, so that the printed template can be read back as well: the strings that the template
uses and the escape sign itself get an escape sign in front. The loss mask follows from prefix sums over
the markers.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

ESCAPE = "\\"
#: The strings that the printed template uses.
HEAD, MID, TAIL = "### ", ": ", "</turn>\n"
CONTROL = ("###", "</turn>")
#: Ids above the vocabulary: start of a turn, end of its role, end of a turn.
TURN, BODY, DONE = 50_257, 50_258, 50_259
LEARNED_ROLE = "assistant"
_TO_ESCAPE = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROL))))
_ESCAPED = re.compile(re.escape(ESCAPE) + "(" + "|".join(map(re.escape, (ESCAPE, *CONTROL))) + ")")


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


@lru_cache(1)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def turn_ids(role: str, text: str, encode) -> list[int]:
    """The ids of a turn: role and text are escaped and encoded apart, markers are spliced in."""
    return [TURN, *encode(escape(role)), BODY, *encode(escape(text)), DONE]


def loss_mask(ids: np.ndarray, learned: bool) -> np.ndarray:
    """1 for each id after BODY and before DONE of a learned turn: the bodies begun less those done, by prefix sums."""
    begun, done = np.cumsum(ids == BODY), np.cumsum(ids == DONE)
    return ((begun - done > 0) & (ids != BODY)).astype(np.int8) * np.int8(learned)


def formatted_turns(turns: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text) with `ids`, `loss_mask`, each turn on its own: the assembly needs no neighbours.

    Null role or text: empty. Only turns of the role `assistant` are learned. Texts of any length.
    Concatenated in the order of turn, role and text (nulls first), the arrays are the conversation.
    """
    path = vocabulary or vocabulary_file()

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            ids = [np.array(turn_ids(r or "", t or "", encode), dtype=np.int32) for r, t in zip(batch.role, batch.text, strict=True)]
            batch["ids"] = ids
            batch["loss_mask"] = [loss_mask(i, r == LEARNED_ROLE) for i, r in zip(ids, batch.role, strict=True)]
            yield batch

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    # As text, nullable integers pass pandas unchanged.
    held = rows.select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text")
    out = held.mapInPandas(assemble, "conv_id string, turn string, role string, text string, ids array<int>, loss_mask array<tinyint>")
    return out.withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")})


def read_back(ids: np.ndarray, mask: np.ndarray, decode) -> tuple[str, str, str, int]:
    """From the ids of a turn: role, text, the text under the mask and the code points of the printed turn."""
    body = int(np.flatnonzero(ids == BODY)[0])
    role, text = decode(ids[1:body].tolist()), decode(ids[body + 1 : -1].tolist())
    learned = decode(ids[mask == 1].tolist())
    return unescape(role), unescape(text), unescape(learned), len(HEAD) + len(role) + len(MID) + len(text) + len(TAIL)


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def conversation_digests(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """A row for each conversation with digests of what its ids say, read back turn after turn.

    A conversation's turns stream through one task in order; the task holds one batch, however long
    the conversation is.
    """
    path = vocabulary or vocabulary_file()

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = lambda ids: _encoding(path).decode_bytes(ids).decode()
        now, state = object(), None

        def row(key):
            n, turns, chars, loss, shown = state
            return (key, n, turns.hexdigest(), chars, loss.hexdigest(), shown)

        for batch in batches:
            rows = []
            for key, ids, mask in zip(batch.conv_key, batch.ids, batch.loss_mask, strict=True):
                if key != now:
                    if state:
                        rows.append(row(now))
                    now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, learned, shown = read_back(np.asarray(ids), np.asarray(mask), decode)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += shown
            yield frame(rows)
        if state:
            yield frame([row(now)])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conv_key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    keyed = formatted.withColumn("conv_key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    ordered = keyed.repartition("conv_key").sortWithinPartitions("conv_key", "turn", "role", "text").select("conv_key", "ids", "loss_mask")
    out = ordered.mapInPandas(digest, DIGEST.replace("conv_id bigint", "conv_key string"))
    return out.select(F.expr("try_cast(conv_key as bigint)").alias("conv_id"), *[F.col(c) for c in out.columns[1:]])


def probe_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold the template's own control strings."""
    text = "\\### Assistant: </turn> ok"
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe_conversation(spark))
    return conversation_digests(formatted_turns(turns))


QUERIES = {"op5_chat_format": op5_chat_format}
