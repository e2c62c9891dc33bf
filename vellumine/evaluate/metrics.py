"""Precision, recall, accuracy, calibration and agreement as aggregates."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import jaro_winkler_udf, token_set_udf
from ..functions.text import metric_form

CORRECT, FUZZY_TEXT, SUPPORTED = 0.9, 0.9, 0.9


def rate(part: Column, whole: Column, empty: float = 1.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


# --- A2: single values


def scalar_scores(predicted: DataFrame, gold: DataFrame, fields: dict[str, str], key: str = "doc_id", compat: bool = True) -> DataFrame:
    """``key, field, applicable, correct``; kinds: exact, phone (last ten digits), fuzzy. Empty gold is not applicable (correct null)."""
    both = gold.select(key, *[F.col(f).alias(f"g_{f}") for f in fields]).join(predicted.select(key, *[F.col(f).alias(f"p_{f}") for f in fields]), key, "left")

    def test(f: str, kind: str) -> Column:
        p, g = F.col(f"p_{f}"), F.col(f"g_{f}")
        if kind == "phone":
            a, b = (F.regexp_replace(F.coalesce(x, F.lit("")), r"\D", "") for x in (p, g))
            return F.substring(a, -10, 10) == F.substring(b, -10, 10)
        if kind == "fuzzy":
            return jaro_winkler_udf(metric_form(p, compat), metric_form(g, compat)) >= FUZZY_TEXT
        return metric_form(p, compat) == metric_form(g, compat)

    each = F.array(*[F.struct(F.lit(f).alias("field"), (F.coalesce(F.col(f"g_{f}"), F.lit("")) != "").alias("applicable"), test(f, k).alias("correct")) for f, k in fields.items()])
    out = both.select(key, F.explode(each).alias("x")).select(key, "x.*")
    return out.withColumn("correct", F.when(F.col("applicable"), F.col("correct")))


# --- A6 to A8: lists


def entity_scores(predicted: DataFrame, gold: DataFrame, matched: DataFrame, *keys: str, correct: float = CORRECT) -> DataFrame:
    """``keys, n_predicted, n_gold, n_matched, n_correct, precision, recall, f1, omission``: a document and section a row."""
    n_p = predicted.groupBy(*keys).agg(F.count("*").alias("n_predicted"))
    n_g = gold.groupBy(*keys).agg(F.count("*").alias("n_gold"))
    n_m = matched.groupBy(*keys).agg(F.count("*").alias("n_matched"), F.count_if(F.col("similarity") >= correct).alias("n_correct"))
    out = n_p.join(n_g, list(keys), "full").join(n_m, list(keys), "left").na.fill(0, ["n_predicted", "n_gold", "n_matched", "n_correct"])
    p, r = rate(F.col("n_correct"), F.col("n_predicted")), rate(F.col("n_correct"), F.col("n_gold"))
    return out.withColumns({"precision": p, "recall": r, "f1": f1(p, r), "omission": rate(F.col("n_gold") - F.col("n_correct"), F.col("n_gold"), 0.0)})


def subfield_correct(predicted: Column, gold: Column, kind: str, least: float = 0.85, compat: bool = True) -> Column:
    """Whether a field of a matched pair is right; null if the gold value is empty. Kinds: exact, fuzzy, month."""
    empty = F.coalesce(gold, F.lit("")) == ""
    if kind == "month":
        ok = F.substring(gold, 1, 7) == F.substring(F.coalesce(predicted, F.lit("")), 1, 7)
    elif kind == "fuzzy":
        ok = jaro_winkler_udf(metric_form(predicted, compat), metric_form(gold, compat)) >= least
    else:
        ok = metric_form(predicted, compat) == metric_form(gold, compat)
    return F.when(~empty, ok)


def set_prf(predicted: Column, gold: Column) -> Column:
    """Struct(precision, recall, f1) of two arrays as sets; two empty sets are right, one empty set is wrong."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    n = F.size(F.array_intersect(p, g))
    both = (F.size(p) == 0) & (F.size(g) == 0)
    pr = F.when(both, 1.0).when(F.size(p) > 0, n / F.size(p)).otherwise(0.0)
    rc = F.when(both, 1.0).when(F.size(g) > 0, n / F.size(g)).otherwise(0.0)
    return F.struct(pr.alias("precision"), rc.alias("recall"), f1(pr, rc).alias("f1"))


def tokens(texts: Column, compat: bool = True) -> Column:
    return F.filter(F.array_distinct(F.split(metric_form(F.array_join(texts, " "), compat), " ")), lambda w: w != "")


def token_f1(predicted: Column, gold: Column, compat: bool = True) -> Column:
    return set_prf(tokens(predicted, compat), tokens(gold, compat))["f1"]


def same_count(predicted: Column, gold: Column) -> Column:
    return F.size(predicted) == F.size(gold)


# --- A9, A10: support by the source, determinism


def unsupported(strings: DataFrame, source: DataFrame, key: str = "doc_id", compat: bool = True) -> DataFrame:
    """``strings`` (key, value) with ``supported``: contained in the source text, or its word set like the source's."""
    s = strings.withColumn("_v", metric_form("value", compat)).join(source.select(key, metric_form("text", compat).alias("_t")), key, "left")
    inside = (F.col("_v") == "") | (F.instr(F.coalesce("_t", F.lit("")), F.col("_v")) > 0)
    sure = s.filter(inside).withColumn("supported", F.lit(True))
    rest = s.filter(~inside).withColumn("supported", F.coalesce(token_set_udf("_v", "_t") >= 100 * SUPPORTED, F.lit(False)))
    return sure.unionByName(rest).drop("_v", "_t")


def hallucination_rate(checked: DataFrame, *keys: str) -> DataFrame:
    return checked.groupBy(*keys).agg(F.count("*").alias("n_strings"), F.count_if(~F.col("supported")).alias("n_unsupported"), F.avg((~F.col("supported")).cast("double")).alias("rate"))


def digest(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """SHA-256 of each row's JSON: equal for equal results, however they were partitioned."""
    return df.select(key, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("digest"))


# --- A11 to A14: summaries, multisets, confusion


def macro_micro(scores: DataFrame, *keys: str) -> DataFrame:
    """From (keys, n_predicted, n_gold, n_correct, precision, recall, f1) of documents: means, and pooled rates."""
    p, r = rate(F.sum("n_correct"), F.sum("n_predicted")), rate(F.sum("n_correct"), F.sum("n_gold"))
    return scores.groupBy(*keys).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), p.alias("micro_precision"), r.alias("micro_recall"), f1(p, r).alias("micro_f1"))


def worst(scores: DataFrame, measure: str, key: str, n: int = 10) -> DataFrame:
    return scores.orderBy(measure, key).limit(n)


def multiset_counts(predicted: DataFrame, gold: DataFrame, *keys: str) -> DataFrame:
    """``keys[0], n_predicted, n_gold, n_both``: equal rows are paired one to one by their count."""
    a, b = (df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((predicted, "p"), (gold, "g")))
    both = a.join(b, list(keys), "full").na.fill(0, ["p", "g"])
    return both.groupBy(keys[0]).agg(F.sum("p").alias("n_predicted"), F.sum("g").alias("n_gold"), F.sum(F.least("p", "g")).alias("n_both"))


def confusion(pairs: DataFrame, gold: str, predicted: str) -> DataFrame:
    return pairs.groupBy(gold, predicted).agg(F.count("*").alias("n"))


# --- A16, A19: cut-offs


def at_cutoffs(scored: DataFrame, cutoffs: DataFrame, *keys: str) -> DataFrame:
    """``keys, cutoff, tp, fp, fn, precision, recall, f1``. ``scored``: keys, score, correct; ``cutoffs``: a few rows."""
    grid = scored.crossJoin(F.broadcast(cutoffs))  # a stated list of cut-offs
    hit = F.col("score") >= F.col("cutoff")
    out = grid.groupBy(*keys, "cutoff").agg(F.count_if(hit & F.col("correct")).alias("tp"), F.count_if(hit & ~F.col("correct")).alias("fp"), F.count_if(~hit & F.col("correct")).alias("fn"))
    p, r = rate(F.col("tp"), F.col("tp") + F.col("fp")), rate(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": p, "recall": r, "f1": f1(p, r)})


def best_strategy(grid: DataFrame, measure: str, *keys: str) -> DataFrame:
    """The configuration of the best measure for each key; of equal ones the first by name."""
    order = Window.partitionBy(*keys).orderBy(F.desc(measure), "config")
    return grid.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def pivoted(grid: DataFrame, row: str, column: str, measure: str, values: list[str] | None = None) -> DataFrame:
    return grid.groupBy(row).pivot(column, values).agg(F.first(measure))


# --- A17: lines


def whole_bullets(gold: DataFrame, lines: DataFrame, similarity, key: str = "doc_id") -> DataFrame:
    """``gold`` bullets (key, bullet) with ``one_line``: exactly like one line (ratio 95 and four fifths of its length)."""
    pairs = gold.join(lines.select(key, F.col("text").alias("_l")), key)
    lengths = F.least(F.length("bullet"), F.length("_l")) / F.greatest(F.length("bullet"), F.length("_l"))
    near = pairs.filter(lengths >= 0.8).withColumn("_s", similarity("bullet", "_l")).filter("_s >= 95").select(key, "bullet").distinct().withColumn("one_line", F.lit(True))
    return gold.join(near, [key, "bullet"], "left").withColumn("one_line", F.coalesce("one_line", F.lit(False)))


# --- A18: calibration


def calibration_table(seen: DataFrame) -> DataFrame:
    """``field, bucket, n, acc``: accuracy (k + 1) / (n + 2) of observations (field, bucket, correct)."""
    return seen.groupBy("field", "bucket").agg(F.count("*").alias("n"), ((F.count_if("correct") + 1) / (F.count("*") + 2)).alias("acc"))


def calibration_error(held_out: DataFrame, table: DataFrame) -> DataFrame:
    """``field, n, mean_confidence, accuracy, ece`` of held-out observations under a calibration table."""
    x = held_out.join(table.select("field", "bucket", "acc"), ["field", "bucket"], "left").withColumn("acc", F.coalesce("acc", F.lit(0.5)))
    by = x.groupBy("field", "bucket").agg(F.count("*").alias("n"), F.avg("acc").alias("conf"), F.avg(F.col("correct").cast("double")).alias("hit"))
    w = F.sum("n")
    return by.groupBy("field").agg(w.alias("n"), (F.sum(F.col("n") * F.col("conf")) / w).alias("mean_confidence"), (F.sum(F.col("n") * F.col("hit")) / w).alias("accuracy"), (F.sum(F.col("n") * F.abs(F.col("conf") - F.col("hit"))) / w).alias("ece"))


# --- A21, A22: timing, recognition errors


def percentiles(df: DataFrame, value: str, points: dict[str, float], *keys: str) -> DataFrame:
    """Percentiles with linear interpolation."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.percentile(value, p).alias(name) for name, p in points.items()])


@F.pandas_udf(T.IntegerType())
def word_errors(read: pd.Series, truth: pd.Series) -> pd.Series:
    """Least number of words changed, added or left out."""

    def count(a: str | None, b: str | None) -> int:
        x, y = (a or "").split(), (b or "").split()
        row = list(range(len(y) + 1))
        for i, w in enumerate(x, 1):
            corner, row[0] = row[0], i
            for j, v in enumerate(y, 1):
                corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (w != v))
        return row[-1]

    return pd.Series([count(a, b) for a, b in zip(read, truth, strict=True)], dtype="int32")


def character_errors(pairs: DataFrame) -> DataFrame:
    """``pairs`` (read, truth) with the shares of wrong characters and words, ``cer`` and ``wer``."""
    chars, n_words = F.greatest(F.length("truth"), F.lit(1)), F.greatest(F.size(F.split("truth", r"\s+")), F.lit(1))
    return pairs.withColumn("cer", F.levenshtein("read", "truth") / chars).withColumn("wer", word_errors("read", "truth") / n_words)


def agreement(one: DataFrame, other: DataFrame, fields: dict[str, str], key: str = "doc_id", compat: bool = True) -> DataFrame:
    """Shares of equal values of two extractors over the documents of both; the second stands for gold."""
    both = scalar_scores(one, other.join(one.select(key), key, "left_semi"), fields, key, compat)
    return both.filter("applicable").groupBy("field").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("agreement"))
