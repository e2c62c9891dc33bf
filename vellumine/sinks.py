"""Results as JSON, training lines, reports and schemas."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import json_schema, typescript


def as_json(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, json``: a record each, without private columns (names that begin with an underscore)."""
    shown = [c for c in records.columns if not c.startswith("_") and c != key]
    return records.select(key, F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("json"))


def write_json(records: DataFrame, path: str) -> None:
    records.select(*[c for c in records.columns if not c.startswith("_")]).write.option("ignoreNullFields", "false").json(path)


def legacy_meta(meta: Column) -> Column:
    """Contact data in the older flat shape."""
    return F.struct(meta["name"].alias("name"), meta["email"].alias("email"), meta["phone_no"].alias("phone"), meta["linkedin"].alias("linkedin"), meta["github_profile"].alias("github"), F.transform(meta["extra_links"], lambda x: x["link"]).alias("links"))


def training_lines(blocks: DataFrame, text: str = "text", fields: str = "fields") -> DataFrame:
    """``value``: one JSON line for each labelled block."""
    return blocks.select(F.to_json(F.struct(F.col(text).alias("input"), F.struct(F.col(fields).alias("json_structures")).alias("output"))).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


def draft(new: DataFrame, kept: DataFrame, key: str = "id") -> DataFrame:
    """Drafts over an older table, of which verified rows are never replaced."""
    verified = kept.filter("status = 'verified'")
    return verified.unionByName(new.join(verified.select(key), key, "left_anti"), allowMissingColumns=True)


def report(now: DataFrame, before: DataFrame | None = None, label: str = "label", value: str = "value") -> str:
    """A Markdown table of a few labelled figures (a collected summary), with the change against an earlier one."""
    rows = now.select(label, value)
    if before is not None:
        rows = rows.join(before.select(label, F.col(value).alias("was")), label, "left").withColumn("change", F.round(F.col(value) - F.col("was"), 4))
    rows = rows.orderBy(label)
    lines = [f"| {' | '.join(rows.columns)} |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.collect())]) + "\n"


def schemas(df: DataFrame) -> tuple[dict, str]:
    """JSON Schema and TypeScript type of a table's rows."""
    return json_schema(df.schema), "export type Row = " + typescript(df.schema)
