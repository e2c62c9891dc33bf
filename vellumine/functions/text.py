"""Text functions: Column in, Column out. Java regular expressions; ``(?U)`` makes classes Unicode where it matters."""

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bullet glyphs, the mark between cells of a line, e-mail addresses.
BULLETS = "•●○◦▪▫■□–—\\-*➢➤►✓✔·"
GLYPHS = r"^[\s•◦▪●■□◆▶►○·*\-–—>]+"
NESTED_BULLET = r"^\s*o\s+(?=[A-Z0-9(])"
CELL = "\t"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
YEARS = r"(?i)(?:19|20)\d{2}\s*[-–—/]\s*(?:(?:19|20)?\d{2}|present)"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark lacks."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def clean_span(text: pd.Series) -> pd.Series:
    """NFKC without private-use glyphs (icon fonts)."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c) != "Co"))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, where an expression uses it often."""
    return F.transform(F.array(value), body)[0]


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def bare(text: Column, chars: str) -> Column:
    """Without ``chars`` (a regex class body) at both ends."""
    return F.regexp_replace(text, f"^[{chars}]+|[{chars}]+$", "")


#: Characters that Windows-1252 has in place of the control characters 128 to 159, and those.
WINDOWS = {bytes([b]).decode("cp1252", "ignore"): chr(b) for b in range(128, 160) if bytes([b]).decode("cp1252", "ignore")}


def repaired(text: Column | str) -> Column:
    """UTF-8 that was read as Latin-1 or Windows-1252 ("cafÃ©"), read again; a text that is no such bytes stays."""
    plain = F.translate(col(text), "".join(WINDOWS), "".join(WINDOWS.values()))
    again = F.when(plain.rlike(r"^[\x00-\xFF]*$") & plain.rlike(r"[\xC2-\xF4][\x80-\xBF]"), F.encode(plain, "ISO-8859-1").cast("string"))
    return F.coalesce(F.when(F.is_valid_utf8(again), again), col(text))


# --- normal forms; they differ on purpose


def heading_form(text: Column | str) -> Column:
    """Letters only, ``&`` read as "and", a last word "section" dropped."""
    t = F.regexp_replace(F.regexp_replace(F.lower(col(text)), "&", " and "), "[^a-z]", " ")
    return F.regexp_replace(squeezed(t), r"\s+section$", "")


def ground_form(text: Column | str, compat: bool = True) -> Column:
    """Lower-case ASCII letters and digits with single spaces."""
    t = nfkc(col(text)) if compat else col(text)
    return F.trim(F.regexp_replace(F.lower(t), "[^0-9a-z]+", " "))


def metric_form(text: Column | str, compat: bool = True) -> Column:
    """Lower case without punctuation marks; null as empty."""
    t = F.coalesce(col(text), F.lit(""))
    t = F.lower(F.trim(nfkc(t) if compat else t))
    return F.regexp_replace(F.regexp_replace(t, "[.,;:!?'\"()\\[\\]‘’“”«»„]", ""), r"\s+", " ")


def zone_form(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(col(text), "\t", " ")), "[^a-z ]", ""))


def align_form(text: Column | str) -> Column:
    return squeezed(F.lower(col(text)))


def label_form(text: Column | str) -> Column:
    return bare(align_form(text), r"\s.,;:")


# --- lines, cells, bullets


def is_bullet(text: Column | str) -> Column:
    return col(text).rlike(rf"^\s*[{BULLETS}]\s*\S")


def bulletish(text: Column | str) -> Column:
    return is_bullet(text) | col(text).rlike(NESTED_BULLET)


def strip_bullet(text: Column | str) -> Column:
    return F.regexp_replace(F.ltrim(col(text)), rf"^[{BULLETS}]+\s*", "")


def strip_glyph(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(col(text), NESTED_BULLET, ""), GLYPHS, ""))


def cells(text: Column | str) -> Column:
    """Cells of a line without glyphs; those with nothing readable are dropped."""
    return F.filter(F.transform(F.split(col(text), CELL), strip_glyph), lambda c: c.rlike(r"(?U)[\p{L}\p{N}]"))


def label_and_rest(text: Column | str) -> Column:
    """Struct(label, rest): split at the first cell, else at the first colon."""
    t = col(text)
    mark = F.when(t.contains(CELL), F.lit(CELL)).otherwise(F.lit(":"))
    at = F.instr(t, CELL)
    at = F.when(at > 0, at).otherwise(F.instr(t, ":"))
    label = F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(t)
    rest = F.when(at > 0, F.substring(t, at + 1, F.length(t))).otherwise(F.lit(""))
    return F.struct(bare(label, r"\s:•·\-–—|").alias("label"), F.trim(rest).alias("rest"), (F.when(at > 0, mark == ":").otherwise(F.lit(False))).alias("colon"))


def contact_text(text: Column | str) -> Column:
    return F.regexp_replace(col(text), CELL, " | ")


def all_caps(text: Column | str) -> Column:
    letters = F.regexp_replace(col(text), r"(?U)[^\p{L}]", "")
    return (F.length(letters) >= 2) & (letters == F.upper(letters)) & (F.lower(letters) != letters)


def words(text: Column | str) -> Column:
    return F.filter(F.split(col(text), r"\s+"), lambda w: w != "")


def is_rule(text: Column | str) -> Column:
    """A line drawn with characters."""
    return F.trim(col(text)).rlike(r"^[_\-=–—.*]{5,}$")


def fix_small_caps(text: Column | str) -> Column:
    """"J OHN" from small capitals, whose first letter is larger."""
    return F.regexp_replace(col(text), r"\b([A-Z])\s([A-Z]{2,}|[a-z]{2,})\b", "$1$2")


def dehyphenated(first: Column, second: Column) -> Column:
    """Two parts of a wrapped line as one."""
    a, b = F.rtrim(first), F.ltrim(second)
    glued = a.rlike(r"(?U)\p{L}-$") & b.rlike(r"(?U)^\p{Ll}")
    return F.when(glued, F.concat(F.regexp_replace(a, "-$", ""), b)).otherwise(F.concat(a, F.lit(" "), b))


def redacted(text: Column | str) -> Column:
    """Without passwords in URIs, API keys and bearer tokens."""
    t = F.regexp_replace(col(text), r"(?i)(mongodb(?:\+srv)?://)([^:@/\s]+):([^@\s]+)@", "$1$2:***@")
    t = F.regexp_replace(t, r"\b(gsk_|sk-|AIza|ghp_|hf_)[A-Za-z0-9_-]{8,}", "$1***")
    return F.regexp_replace(t, r"(?i)(bearer\s+)[A-Za-z0-9._-]{8,}", "$1***")
