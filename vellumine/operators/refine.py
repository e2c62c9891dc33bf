"""Refiners: models that may overwrite fields of entries. A refiner is a function registered by name; it gets batches of
block texts and gives spans (field, start, end, confidence) for each."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST_BLOCK, BATCH = 600, 8
SPANS = "array<struct<field:string,start:int,end:int,confidence:double>>"
Refiner = Callable[[list[str]], list[list[tuple[str, int, int, float]]]]
REGISTRY: dict[str, Callable[[], Refiner]] = {}


def register(name: str, make: Callable[[], Refiner]) -> None:
    """``make`` loads the model; it is called once in each Python worker that needs it."""
    REGISTRY[name] = make


def blocks(lines: DataFrame, *keys: str, longest: int = LONGEST_BLOCK) -> DataFrame:
    """``keys, block, offsets``: the texts of an entry's lines, one below the other, up to ``longest`` characters, and where
    each line begins (line_no, at)."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    grouped = lines.groupBy(*keys).agg(rows.alias("rows"))
    placed = F.aggregate(
        "rows", F.struct(F.array().cast("array<struct<line_no:int,at:int>>").alias("o"), F.lit(0).alias("n")),
        lambda s, r: F.struct(F.concat(s["o"], F.array(F.struct(r["line_no"].cast("int").alias("line_no"), s["n"].alias("at")))).alias("o"), (s["n"] + F.length(r["text"]) + 1).alias("n")),
    )
    whole = F.array_join(F.transform("rows", lambda r: r["text"]), "\n")
    return grouped.select(*keys, F.substring(whole, 1, longest).alias("block"), F.filter(placed["o"], lambda o: o["at"] < longest).alias("offsets"))


def predicted(found: DataFrame, make: Callable[[], Refiner], text: str = "block", batch: int = BATCH) -> DataFrame:
    """``found`` with ``spans``. Each distinct text (by SHA-1) is predicted once; a batch that fails is tried text by text, and
    a text that fails alone gets no spans."""
    keyed = found.withColumn("_sha", F.sha1(F.col(text)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()

        def spans(texts: list[str]) -> list:
            try:
                return model(texts)
            except Exception:  # a model may fail on odd input; the rules' values then stay
                return [] if len(texts) == 1 else [x for t in texts for x in (spans([t]) or [[]])]

        for part in parts:
            texts = part[text].tolist()
            got = [x for k in range(0, len(texts), batch) for x in (spans(texts[k : k + batch]) or [[]])]
            yield pd.DataFrame({"_sha": part["_sha"], "spans": [[dict(zip(("field", "start", "end", "confidence"), s, strict=True)) for s in g] for g in got]})

    once = keyed.dropDuplicates(["_sha"]).select("_sha", text).mapInPandas(run, f"_sha string, spans {SPANS}")
    return keyed.join(once, "_sha", "left").drop("_sha")


def grounded_spans(found: DataFrame, text: str = "block") -> DataFrame:
    """Spans as rows ``field, value, line_nos, confidence``: the value is cut out of the text, never typed anew."""
    cols = [c for c in found.columns if c not in ("spans", "offsets", text)]
    s = found.select(*cols, text, "offsets", F.explode("spans").alias("s"))
    ends = F.transform("offsets", lambda o, i: F.struct(o["line_no"].alias("line_no"), o["at"].alias("at"), F.coalesce(F.try_element_at("offsets", i + 2)["at"], F.length(text) + 1).alias("to")))
    nos = F.transform(F.filter(ends, lambda o: (o["at"] < F.col("s.end")) & (o["to"] > F.col("s.start"))), lambda o: o["line_no"])
    return s.select(*cols, F.col("s.field").alias("field"), F.expr(f"substring({text}, s.start + 1, s.end - s.start)").alias("value"), nos.alias("line_nos"), F.col("s.confidence").alias("confidence"))


def merged(rule: Column, model: Column, confidence: Column, policy: str, cut: float = 0.5) -> Column:
    """The value of a field by policy: rules, model, hybrid (the model's where it is sure), or combined (where rules have none)."""
    has = F.coalesce(model, F.lit("")) != ""
    if policy == "rules":
        return rule
    if policy == "model":
        return F.when(has, model).otherwise(rule)
    if policy == "hybrid":
        return F.when(has & (confidence >= cut), model).otherwise(rule)
    return F.when(F.coalesce(rule, F.lit("")) != "", rule).otherwise(F.coalesce(model, F.lit("")))


def pointed(answers: DataFrame) -> DataFrame:
    """Answers (value, line_text) of a generative model that stand in the line they point to."""
    return answers.filter((F.trim("value") != "") & (F.instr(F.lower("line_text"), F.lower(F.trim("value"))) > 0))
