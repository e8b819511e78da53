"""Fan-out of texts to a text provider, and the bookkeeping around it. Providers are pluggable; none
is reachable here, and no result is made up: a failure is a row with an error."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalars import length_range, parse_prediction

Complete = Callable[[str, str], str]
RESULT = "seed_id long, kind string, text string, words int, error string, attempts int"


def prompts(docs: DataFrame, id_col: str, strategy, template: str = "Schreibe einen Text mit {target} Wörtern ({low}–{high}).\n\n{text}") -> DataFrame:
    """The prompt of each text, with its target length and allowed range."""
    n = T.word_count(F.col("text"))
    r = length_range(n, strategy)
    body = F.lit(template)
    for name, value in (("{target}", n), ("{low}", r["min_words"]), ("{high}", r["max_words"])):
        body = F.replace(body, F.lit(name), value.cast("string"))
    return docs.select(F.col(id_col).alias("seed_id"), n.alias("target_words"), r["min_words"].alias("min_words"), r["max_words"].alias("max_words"), F.replace(body, F.lit("{text}"), F.col("text")).alias("prompt"))


def complete_all(requests: DataFrame, kind: str, connect: Callable[[], Complete], instructions: str, least_share: float = 0.5, retries: int = 5, parallel: int = 8, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Answers to (seed_id, prompt, target_words). An empty or short answer counts as a failure and is asked
    again after 2, 4, 8 ... seconds. `parallel` partitions ask at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = connect()
        for p in parts:
            rows = []
            for seed, prompt, target in zip(p["seed_id"], p["prompt"], p["target_words"], strict=True):
                text, error, k = None, None, 0
                for k in range(1, retries + 1):
                    try:
                        text = ask(instructions, prompt)
                        if not (text or "").strip():
                            raise ValueError("empty answer")
                        if len(text.split()) < int(target * least_share):
                            raise ValueError(f"answer too short ({len(text.split())} words)")
                        error = None
                        break
                    except Exception as e:  # noqa: BLE001  whatever a provider raises is this row's error
                        text, error = None, str(e)
                        if k < retries:
                            wait(2**k)
                rows.append((seed, kind, text, None if text is None else len(text.split()), error, k))
            yield pd.DataFrame(rows, columns=["seed_id", "kind", "text", "words", "error", "attempts"])

    return requests.select("seed_id", "prompt", "target_words").repartition(parallel).mapInPandas(run, RESULT)


def classify_all(docs: DataFrame, id_col: str, connect: Callable[[], Complete], instructions: str, parallel: int = 8) -> DataFrame:
    """Zero-shot answers, parsed: failures keep their row, with nulls and the error."""
    asked = complete_all(docs.select(F.col(id_col).alias("seed_id"), F.concat(F.lit("<text>\n"), F.col("text"), F.lit("\n</text>")).alias("prompt"), F.lit(0).alias("target_words")), "label", connect, instructions, retries=1, parallel=parallel)
    p = parse_prediction(F.col("text"))
    return asked.withColumn("_p", p).select(F.col("seed_id").alias(id_col), F.col("_p.label").alias("pred"), *[F.col(f"_p.{n}").alias(c) for c, n in (("p0", "p_human"), ("p1", "p_ai_generated"), ("p2", "p_ai_assisted"))], F.coalesce("error", F.when(F.col("text").isNotNull(), F.col("_p.error"))).alias("error"))


def find_missing(wanted: DataFrame, log: DataFrame, kinds: tuple[str, ...] = ("assisted", "generated")) -> DataFrame:
    """(seed_id, kind) without an output."""
    need = wanted.select("seed_id", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    return need.join(log.where("text is not null").select("seed_id", "kind").distinct(), ["seed_id", "kind"], "left_anti")


def show_example(human: DataFrame, assisted: DataFrame, generated: DataFrame, seed_id: int, chars: int = 700) -> DataFrame:
    """The three texts of an id side by side, their first characters."""
    part = lambda df, name: df.where(F.col("seed_id") == seed_id).select("seed_id", F.substring("text", 1, chars).alias(name))
    return part(human, "human").join(part(assisted, "assisted"), "seed_id", "left").join(part(generated, "generated"), "seed_id", "left")
