"""HTML with coded spans, CSV with list cells, JSON files, samples, generated documents."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lexicons import lookup
from ..functions.text import squeezed

# Codes of sections and fields in labelled HTML.
SECTION_CODES = {"SECTION_EXPR": "workHistory", "SECTION_EDUC": "education", "SECTION_HILT": "skills", "SECTION_SUMM": "summary", "SECTION_CERT": "certifications", "SECTION_ACCM": "awards", "SECTION_AFIL": "affiliations"}
FIELD_CODES = {"JTIT": "title", "COMP": "company", "JCIT": "city", "JSTA": "state", "JSTD": "start", "EDDT": "end", "SCHO": "institution", "DGRE": "degree", "STUY": "course", "GRYR": "end", "FRFM": "text"}
PLACEHOLDER = r"(?i)^(company name|city|state|school name|\W*)$"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": "\"", "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def plain(html: Column) -> Column:
    """Text of a piece of HTML."""
    t = F.regexp_replace(html, r"<[^>]*>", " ")
    for code, char in ENTITIES.items():
        t = F.replace(t, F.lit(code), F.lit(char))
    return squeezed(t)


def section_titles(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """``id, n, title``: texts of elements whose class says section title."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<(?:div|span|h\d)[^>]*class=\"[^\"]*sectiontitle[^\"]*\"[^>]*>(.*?)</"), F.lit(1))
    return pages.select(id_col, F.posexplode(found).alias("n", "t")).select(id_col, "n", plain(F.col("t")).alias("title"))


def coded_entries(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """``id, section, chunk, fields`` (map field -> text), ``bullets`` of labelled HTML: sections by their mark, then
    paragraphs, then coded spans; placeholders are skipped."""
    parts = F.filter(F.split(html, r"(?=id=\"SECTION_)"), lambda p: p.rlike(r"^id=\"SECTION_"))
    s = pages.select(id_col, F.posexplode(parts).alias("n", "part"))
    s = s.withColumn("section", lookup(SECTION_CODES, F.regexp_extract("part", r"^id=\"(SECTION_[A-Z]{4})", 1))).filter("section is not null")
    chunks = F.filter(F.split("part", r"(?=<div[^>]*class=\"[^\"]*paragraph)"), lambda c: c.rlike(r"^<div[^>]*class=\"[^\"]*paragraph"))
    c = s.select(id_col, "n", "section", F.posexplode(chunks).alias("chunk", "c"))
    spans = F.regexp_extract_all("c", F.lit(r"(?is)<span[^>]*itemprop=\"?([A-Z]{4})\"?[^>]*>(.*?)</span>"), F.lit(0))
    each = F.transform(spans, lambda x: F.struct(lookup(FIELD_CODES, F.regexp_extract(x, r"itemprop=\"?([A-Z]{4})", 1)).alias("key"), plain(F.regexp_extract(x, r"(?is)^<span[^>]*>(.*)</span>$", 1)).alias("value")))
    good = F.filter(each, lambda e: e["key"].isNotNull() & ~e["value"].rlike(PLACEHOLDER))
    first = F.filter(good, lambda e, i: ~F.exists(F.slice(good, 1, i), lambda o: o["key"] == e["key"]))
    bullets = F.filter(F.transform(F.regexp_extract_all("c", F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1)), plain), lambda b: b != "")
    return c.select(id_col, "section", "n", "chunk", F.map_from_entries(first).alias("fields"), bullets.alias("bullets"))


def list_cells(text: Column | str) -> Column:
    """A cell with a list literal (['a', 'b']) as an array; placeholders become null."""
    t = F.trim(text)
    json = F.regexp_replace(F.regexp_replace(t, r"\\?\"", "'"), r"(?<=[\[,]\s{0,3})'|'(?=\s*[,\]])", "\"")
    values = F.from_json(F.regexp_replace(json, r"\bNone\b", "null"), "array<string>")
    return F.transform(values, lambda v: F.when(F.lower(F.trim(v)).isin("", "n/a", "none", "null", "unknown"), None).otherwise(F.trim(v)))


def csv_pools(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV whose ``columns`` hold parallel lists, one row for each place of the lists."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", "\"").csv(path)
    lists = raw.withColumn("_row", F.monotonically_increasing_id()).select("_row", F.posexplode(F.arrays_zip(*[list_cells(c).alias(c) for c in columns])).alias("k", "x"))
    return lists.select("_row", "k", *[F.col("x")[c].alias(c) for c in columns])


def json_table(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def stratified(df: DataFrame, n: int, order: list, *strata: str) -> DataFrame:
    """At most ``n`` rows of each stratum, the first by ``order``; the same whatever the partitions."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).filter(F.col("_k") <= n).drop("_k")


def seeded(df: DataFrame, n: int, seed: int, *keys: str, strata: tuple[str, ...] = ()) -> DataFrame:
    """A reproducible sample: the smallest hashes of key and seed."""
    return stratified(df, n, [F.xxhash64(F.lit(seed), *keys), *keys], *strata) if strata else df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


# --- generated documents: truth and text of invented people

FAMILIES = tuple(f"{layout}-{dates}" for layout in ("plain", "caps", "colon", "dashed", "spaced", "bulleted", "compact") for dates in ("month", "year"))
FIRST, LAST = "Avel Brin Cato Dara Elko Fenn Gita Hale".split(), "Marrow Norse Oake Pell Quill Rowe Sable Tarn".split()
TITLES, FIRMS = ["Software Engineer", "Data Analyst", "Project Manager", "Research Intern", "Web Developer"], ["Norvale Labs", "Ketter Systems", "Ilmo Technologies", "Brask Industries Ltd", "Tavin Bank"]
DEGREE_NAMES, SCHOOLS = ["B.Tech in Information Technology", "M.Sc in Physics", "Bachelor of Arts in History", "MBA"], ["Ferrin University", "Oswin Institute of Science", "Calder College"]
SKILLS = ["Python, SQL, Docker", "Java, Spring Boot, Git", "React, Node.js, MongoDB", "Pandas, NumPy, Tableau"]
HEADS = ("SUMMARY", "EXPERIENCE", "EDUCATION", "SKILLS")


def _pick(values: list[str] | tuple[str, ...], salt: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(len(values))) + 1).cast("int"))


def synthetic(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """``doc_id, family, text, truth`` of ``n`` invented records in ``FAMILIES`` of layouts; no rows leave the executors."""
    base = spark.range(n).withColumn("id", F.xxhash64("id", F.lit(seed)))
    year = (F.pmod(F.xxhash64("id", F.lit("y")), F.lit(12)) + 2006).cast("int")
    d = base.select("id", _pick(FAMILIES, "f").alias("family"), F.concat_ws(" ", _pick(FIRST, "a"), _pick(LAST, "b")).alias("name"), _pick(TITLES, "t").alias("title"), _pick(FIRMS, "c").alias("company"), _pick(DEGREE_NAMES, "d").alias("degree"), _pick(SCHOOLS, "s").alias("school"), _pick(SKILLS, "k").alias("tools"), year.alias("y"))
    monthly = F.col("family").endswith("month")
    start = F.when(monthly, F.concat(F.lit("Mar "), "y")).otherwise(F.col("y").cast("string"))
    end = F.when(monthly, F.concat(F.lit("Aug "), F.col("y") + 2)).otherwise((F.col("y") + 2).cast("string"))
    mark = F.when(F.col("family").startswith("dashed"), "- ").otherwise("• ")
    email = F.concat(F.lower(F.replace("name", F.lit(" "), F.lit("."))), F.lit("@example.org"))
    colon = F.when(F.col("family").startswith("colon"), ":").otherwise("")
    text = F.concat_ws("\n", "name", email, F.concat(F.lit(HEADS[1]), colon), F.concat("title", F.lit("\t"), start, F.lit(" - "), end), "company", F.concat(mark, F.lit("Reduced the run time of reports by 30% for 200 users.")),
                       F.concat(F.lit(HEADS[2]), colon), F.concat("degree", F.lit("\t"), F.col("y") - 4, F.lit(" - "), F.col("y")), "school", F.concat(F.lit(HEADS[3]), colon), "tools")
    first = F.concat("y", F.when(monthly, "-03-01").otherwise("-01-01"))
    last = F.concat(F.col("y") + 2, F.when(monthly, "-08-01").otherwise("-01-01"))
    truth = F.struct("name", email.alias("email"), "title", "company", first.alias("start"), last.alias("end"), "degree", "school", "tools")
    return d.select(F.concat(F.lit("syn-"), F.abs("id")).alias("doc_id"), "family", text.alias("text"), truth.alias("truth"))
