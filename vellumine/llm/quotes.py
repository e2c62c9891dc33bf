"""Quotation linking: messages that quote one another become reply-ordered conversations without quotes.

A line's quote level is the number of ``>`` before it. Runs of lines of one level are passages; a line that announces a
quotation ("... wrote:") right before a deeper run belongs to the quotation. A passage's normal form (lower case, white
space folded) is hashed and joined to the normal forms of what messages say themselves: whole messages, what they say
between two quotations, and single lines of ``LEAST_WORDS`` words or more. A message replies to the first message of its thread that said what it
quotes, the shallowest level first, whole passages before lines; only what no earlier message of the thread said is
looked up in other threads, among messages before it in (thread, order). Threads so linked are one conversation.

DataFrame functions only. Every join meets at most one row for a key (what was said first), so common passages are not
multiplied; positions come from a range sort, so a thread of any length is no single task's work.

Cases: a null text is a message that says nothing; messages with a null thread or order are kept, are linked to nothing
and have no position. Rows equal in thread, order and text get equal results; repeated rows stay rows. Equal lines
or messages within a thread count as said by the first. Very long texts are split within their row. An empty table
gives an empty result. Extra columns are kept, unless their names are the result's.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .components import components

LEAST_WORDS = 5
# How mail programs announce a quotation, in four languages.
ANNOUNCES = r"(?i)\b(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"
MARKER = r"^(?:[ \t]{0,3}>)+ ?"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _passages(messages: DataFrame) -> DataFrame:
    """Adds ``_runs``: array of (depth, body lines) of consecutive lines with one quote level."""
    lines = F.transform(F.split(F.coalesce("_t", F.lit("")), "\r\n|\n|\r"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKER, 0), "[^>]", "")).alias("depth"), F.regexp_replace(x, MARKER, "").alias("body")))
    out = messages.withColumn("_lines", lines)
    # An announcement right before a quotation counts as part of it, one level deeper than it stands.
    announced = F.transform(
        "_lines",
        lambda x, i: F.struct(
            F.when((F.try_element_at("_lines", i + 2)["depth"] > x["depth"]) & x["body"].rlike(ANNOUNCES), F.lit(-1)).otherwise(x["depth"]).alias("depth"), x["body"].alias("body")
        ),
    )
    out = out.withColumn("_lines", F.filter(announced, lambda x: x["depth"] >= 0))
    out = out.withColumn("_starts", F.filter(F.sequence(F.lit(1), F.greatest(F.size("_lines"), F.lit(1))), lambda i: (i == 1) | (F.try_element_at("_lines", i)["depth"] != F.try_element_at("_lines", F.greatest(i - 1, F.lit(1)))["depth"])))
    runs = F.transform(
        "_starts",
        lambda at, k: F.struct(
            F.try_element_at("_lines", at)["depth"].alias("depth"),
            F.transform(F.slice("_lines", at, F.coalesce(F.try_element_at("_starts", k + 2), F.size("_lines") + 1) - at), lambda x: x["body"]).alias("body"),
        ),
    )
    return out.withColumn("_runs", F.when(F.size("_lines") > 0, runs).otherwise(F.array().cast("array<struct<depth:int,body:array<string>>>"))).drop("_lines", "_starts")


def _units(said: DataFrame, body: str, *keys: str, runs: str | None = None) -> DataFrame:
    """Hashes (``u``) of the normal forms of a text and of its ``runs`` (kind 0), and of its longer lines (kind 1)."""
    whole = normal(F.array_join(body, " "))
    long = F.filter(F.transform(body, normal), lambda x: F.size(F.split(x, " ")) >= LEAST_WORDS)
    each = F.concat(F.array(F.struct(F.lit(0).alias("kind"), whole.alias("form"))), F.transform(long, lambda x: F.struct(F.lit(1).alias("kind"), x.alias("form"))))
    if runs:
        each = F.concat(each, F.transform(runs, lambda x: F.struct(F.lit(0).alias("kind"), normal(x).alias("form"))))
    out = said.select(*keys, F.explode(each).alias("x")).filter(F.col("x.form") != "")
    return out.select(*keys, F.col("x.kind").alias("kind"), F.sha2(F.col("x.form"), 256).alias("u"))


def conversations(messages: DataFrame, thread: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """``messages`` with the text freed of quotes, and ``conversation_id`` (the smallest thread linked), ``position``
    (from 0 in reply order), ``parent_thread, parent_order`` (null if it replies to none), ``n_quoted``, ``n_linked``
    (passages quoted, and those found)."""
    kept = [c for c in messages.columns if c.lower() not in (text.lower(), "text", "conversation_id", "position", "parent_thread", "parent_order", "n_quoted", "n_linked")]
    keyed = messages.select(F.struct(*kept).alias("_row"), F.col(text).cast("string").alias("_t"), F.col(thread).cast("long").alias("_c"), F.col(order).cast("long").alias("_o"), F.xxhash64(text).alias("_h"))
    parsed = _passages(keyed).withColumn("_own", F.flatten(F.transform(F.filter("_runs", lambda r: r["depth"] == 0), lambda r: r["body"])))
    own_runs = F.transform(F.filter("_runs", lambda r: r["depth"] == 0), lambda r: F.array_join(r["body"], " "))
    parsed = parsed.withColumn("_said", F.when(F.size(own_runs) > 1, own_runs).otherwise(F.array().cast("array<string>")))  # one run is the whole
    parsed = parsed.withColumn("_quotes", F.filter("_runs", lambda r: (r["depth"] > 0) & (F.trim(F.array_join(r["body"], "")) != "")))
    parsed = written(parsed.withColumn("text", F.regexp_replace(F.regexp_replace(F.array_join("_own", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")).drop("_t", "_runs"), "parsed")

    firm = parsed.filter("_c is not null and _o is not null")
    quotes = firm.filter(F.size("_quotes") > 0).select("_c", "_o", "_h", F.posexplode("_quotes").alias("p", "q")).select("_c", "_o", "_h", "p", "q.depth", "q.body")
    quoted = written(_units(quotes, "body", "_c", "_o", "_h", "p", "depth").distinct(), "quoted")
    said = _units(firm, "_own", "_c", "_o", runs="_said")
    wanted = quoted.select("u").distinct()  # only what is quoted somewhere is kept of what was said
    first = written(said.join(wanted, "u", "left_semi").groupBy("u", "_c").agg(F.min("_o").alias("po")), "first")

    near = quoted.join(first, ["u", "_c"], "left").withColumn("po", F.when(F.col("po") < F.col("_o"), F.col("po")))
    near = written(near, "near")
    found = near.filter("po is not null").withColumn("pc", F.col("_c"))
    left = near.filter("po is null").drop("po")
    origin = first.groupBy("u").agg(F.min(F.struct(F.col("_c").alias("pc"), F.col("po"))).alias("at")).select("u", "at.pc", "at.po")
    far = left.join(origin, "u").filter("pc < _c")
    links = found.select("_c", "_o", "_h", "p", "depth", "kind", "pc", "po").unionByName(far.select("_c", "_o", "_h", "p", "depth", "kind", "pc", "po"))
    best = F.min(F.struct("depth", (F.col("pc") != F.col("_c")).alias("away"), "kind", "p", "pc", "po"))
    parents = links.groupBy("_c", "_o", "_h").agg(best.alias("b"), F.count_distinct("p").cast("int").alias("n_linked"))
    parents = written(parents.select("_c", "_o", "_h", F.col("b.pc").alias("parent_thread"), F.col("b.po").alias("parent_order"), "n_linked"), "parents")

    across = written(parents.filter("parent_thread <> _c").select(F.col("_c").alias("u"), F.col("parent_thread").alias("v")).distinct(), "across")
    out = parsed.join(parents, ["_c", "_o", "_h"], "left").withColumn("n_linked", F.coalesce("n_linked", F.lit(0)))
    if across.isEmpty():
        out = out.withColumn("conversation_id", F.col("_c"))
    else:
        joined = components(across).withColumnRenamed("node", "_c")
        out = out.join(joined, "_c", "left").withColumn("conversation_id", F.coalesce("component_id", "_c")).drop("component_id")
    placed = _positions(out.withColumn("n_quoted", F.size("_quotes")))
    return placed.select(*[F.col("_row")[c].alias(c) for c in kept], "text", "conversation_id", "position", "parent_thread", "parent_order", "n_quoted", "n_linked")


def _positions(rows: DataFrame) -> DataFrame:
    """Place of each row in its conversation, by thread and order: after all that it replies to."""
    ranged = rows.repartitionByRange("conversation_id", "_c", "_o", "_h").sortWithinPartitions("conversation_id", "_c", "_o", "_h")
    ranged = written(ranged.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)), "ranged")
    runs = ranged.groupBy("conversation_id", "_part").agg(F.count("*").alias("n"), F.min("_id").alias("_first"))
    before = F.sum("n").over(Window.partitionBy("conversation_id").orderBy("_part")) - F.col("n")  # a row for each partition it spans
    runs = runs.withColumn("_before", before).drop("n")
    firm = F.col("_c").isNotNull() & F.col("_o").isNotNull()
    return ranged.join(runs, ["conversation_id", "_part"], "left").withColumn("position", F.when(firm, F.col("_id") - F.col("_first") + F.col("_before")))


def as_mail(turns: DataFrame, levels: int = 2) -> DataFrame:
    """Turns (conv_id, turn, role, text) as mails: each reply quotes the turn before it, which quotes the one before."""
    said = turns.groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t")).agg(F.min("text").alias("s"))
    out = turns.withColumn("_quote", F.lit(None).cast("string"))
    for level in range(levels, 0, -1):
        prior = said.select(F.col("c").alias("conv_id"), (F.col("t") + level).alias("turn"), F.col("s").alias("_s"))
        mark = "> " * level
        lines = F.concat(F.lit(mark), F.regexp_replace("_s", "\n", "\n" + mark))
        out = out.join(prior, ["conv_id", "turn"], "left").withColumn("_quote", F.coalesce(F.concat(F.col("_quote"), F.lit("\n"), lines), F.col("_quote"), lines)).drop("_s")
    return out.withColumn("text", F.concat_ws("\n", "_quote", "text")).drop("_quote")
