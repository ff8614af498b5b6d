"""Extraction again, with hints, of the pages whose confidence is low: at most `ROUNDS` rounds over a shrinking frame.

Each round sends only the pages that are still below the threshold and have a hint; the others are done and are not read
again. A round's result is checkpointed, so that a lost executor repeats no model call of an earlier round, and the plan of a
round does not hold those before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..providers import Provider, generated
from .entities import cut

#: Confidence below which a page is read again, and rounds at most.
LOW, ROUNDS = 0.7, 2
PROMPT = "Re-extract all fields. CORRECTION HINT: "


def again(pages: DataFrame, provider: Provider, score: Callable[[DataFrame], DataFrame], *, low: float = LOW, rounds: int = ROUNDS) -> DataFrame:
    """`pages` scored, with `rounds` (calls made for the page).

    `score` takes the pages, with a column `answer` (the last answer, null before the first call), and gives them back with
    `confidence` and `hint`; a page without a hint is not sent. Its other columns must stay as they are.
    """
    now = cut(score(pages.withColumn("answer", F.lit(None).cast("string"))).withColumn("rounds", F.lit(0)))
    columns = now.columns
    done = []
    for _ in range(rounds):
        send = (F.coalesce("confidence", F.lit(1.0)) < low) & (F.coalesce("hint", F.lit("")) != "")
        done.append(now.where(~send).select(columns))
        asked = now.where(send).withColumn("prompt", F.concat(F.lit(PROMPT), "hint")).drop("answer")
        answered = generated(asked, provider).drop("prompt")
        now = cut(score(answered.drop("confidence", "hint")).withColumn("rounds", F.col("rounds") + 1).select(columns))
        if now.isEmpty():
            break
    for part in done:
        now = now.union(part)
    return now.drop("answer")
