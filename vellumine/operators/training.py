"""Training data: alignment of labelled values to lines, blocks, splits, lexicons."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import partial_ratio
from ..functions.text import align_form

LIKE = 90.0
ALIGNED = "doc_id string, ord int, value string, line_no int, sim double"


def forward_aligned(values: DataFrame, lines: DataFrame, least: float = LIKE) -> DataFrame:
    """Labelled values (doc_id, ord, value, section) in their order on lines (doc_id, line_no, text, section): a value is
    looked for from the line of the one before on; a new section starts at its first line. A fold over a document."""

    def run(v: pd.DataFrame, l: pd.DataFrame) -> pd.DataFrame:
        v, l = v.sort_values("ord"), l.sort_values("line_no")
        floor, section, out = -1, None, []
        rows = list(zip(l["line_no"], l["_t"], l["section"], strict=True))
        for r in v.itertuples():
            if r.section != section:
                section = r.section
                floor = min((n for n, _, s in rows if s == section), default=floor)
            best = (0.0, None)
            for n, t, _ in rows:
                if n < floor or not t:
                    continue
                score = 100.0 if getattr(r, "_5") in t else partial_ratio(getattr(r, "_5"), t) if min(len(t), len(getattr(r, "_5"))) > 3 else 0.0
                if score > best[0]:
                    best = (score, n)
                if score == 100.0:
                    break
            hit = best[1] if best[0] >= least else None
            floor = hit if hit is not None else floor
            out.append((r.doc_id, r.ord, r.value, hit, best[0]))
        return pd.DataFrame(out, columns=["doc_id", "ord", "value", "line_no", "sim"]).astype({"line_no": "Int32"})

    left = values.select("doc_id", "ord", "value", "section", align_form("value").alias("_t")).groupBy("doc_id")
    right = lines.select("doc_id", "line_no", align_form("text").alias("_t"), "section").groupBy("doc_id")
    return left.cogroup(right).applyInPandas(run, ALIGNED)


def located(value: Column, text: Column) -> Column:
    """The value as the text writes it, white space and case aside; empty if it is not there."""
    pattern = F.concat(F.lit("(?i)"), F.array_join(F.transform(F.split(F.trim(value), r"\s+"), lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), r"\s+"))
    return F.when(F.trim(value) == "", "").otherwise(F.coalesce(F.regexp_substr(text, pattern), F.lit("")))


def assigned_truth(scored: DataFrame, block: str = "block_id", truth: str = "truth_id") -> DataFrame:
    """Blocks with the truth entry of most matching key fields (block, truth, n_match); blocks with a tie are dropped."""
    top = F.rank().over(Window.partitionBy(block).orderBy(F.desc("n_match")))
    first = scored.filter("n_match > 0").withColumn("_r", top).filter("_r = 1")
    return first.withColumn("_n", F.count("*").over(Window.partitionBy(block))).filter("_n = 1").drop("_r", "_n")


def labelled_blocks(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks (doc_id, block_id, line_ids) with the labels (doc_id, label_id, line_ids) that share lines: ``n_shared``."""
    a = blocks.select("doc_id", "block_id", F.explode("line_ids").alias("line_no"))
    b = labels.select("doc_id", "label_id", F.explode("line_ids").alias("line_no"))
    return a.join(b, ["doc_id", "line_no"]).groupBy("doc_id", "block_id", "label_id").agg(F.count("*").alias("n_shared"))


def split_parts(records: DataFrame, order: list, test_families: list[str], every: int = 20, family: str = "family") -> DataFrame:
    """``part``: test for whole families; of the others every 20th is dev, the rest train."""
    rest = F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64(*order), F.lit(64))).orderBy(*order))
    return records.withColumn("_k", rest).withColumn("part", F.when(F.col(family).isin(test_families), "test").when(F.col("_k") % every == 0, "dev").otherwise("train")).drop("_k")


def unused(records: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return records.join(used.select(key), key, "left_anti")


def without_placeholders(text: Column) -> Column:
    return F.when(F.lower(F.trim(text)).isin("", "n/a", "na", "none", "null", "unknown", "not specified", "-"), None).otherwise(F.trim(text))


def title_lexicon(titles: DataFrame, text: str = "title", least: int = 4) -> DataFrame:
    """``word, n``: last words of titles seen at least four times."""
    word = F.element_at(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), -1)
    worded = titles.filter(F.col(text).rlike("[A-Za-z]")).select(word.alias("word"))
    return worded.groupBy("word").agg(F.count("*").alias("n")).filter((F.col("n") >= least) & (F.length("word") > 2))


def skill_lexicon(names: DataFrame, text: str = "skill_name") -> DataFrame:
    t = F.trim(text)
    return names.filter(F.length(t).between(2, 40) & (F.size(F.split(t, r"\s+")) <= 4)).select(F.lower(t).alias("name_lc"), t.alias("name")).groupBy("name_lc").agg(F.min("name").alias("name"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
