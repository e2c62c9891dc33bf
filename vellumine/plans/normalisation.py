"""Queries on dates, periods, skills and records."""

from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import squeezed
from ..operators import entries, header, normalise, sections
from ..operators.clean import dedupe
from ..scratch import written
from ..tables import table
from .registry import pick, picked, query, values

AS_OF = "2024-06-01"


def _each(spark, sf_dir, items: list[str]):
    """Every order with one of the items."""
    return table(spark, sf_dir, "orders").select("o_orderkey", pick(items, F.col("o_orderkey")).alias("item"))


def _truth(truth: list[tuple], names: str) -> str:
    return f"select o_orderkey, v.* exclude (n) from orders join ({values([(i, *t) for i, t in enumerate(truth)])}) as v(n, {names}) on v.n = o_orderkey % {len(truth)}"


@query("""select o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as start, strftime(date_trunc('month', o_orderdate + interval 1 month * (o_orderkey % 30)), '%Y-%m-%d') as "end", false as current from orders""")
def period_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    first = F.date_trunc("month", "o_orderdate")
    last = F.add_months(first, (F.col("o_orderkey") % 30).cast("int"))
    text = F.concat(F.date_format(first, "MMM yyyy"), F.lit(" - "), F.date_format(last, "MMMM yyyy"))
    found = dates.find_range(text)
    return o.select("o_orderkey", found["start"].alias("start"), found["end"].alias("end"), found["current"].alias("current"))


MONTHS = ["January", "Feb", "Mar.", "April", "May", "Jun", "July", "Aug", "Sept", "October", "Nov", "Dec"]
WHEN = "select o_orderkey as k, cast(year(o_orderdate) as int) as y, cast(month(o_orderdate) as int) as m from orders"


@query(f"""select k as o_orderkey, case k % 7 when 0 then format('{{:d}}-{{:02d}}-01', y, m) when 1 then y || '-06-01' when 2 then format('{{:d}}-{{:02d}}-01', y, (m - 1) // 3 * 3 + 1) when 3 then y || '-01-01' when 4 then format('{{:d}}-{{:02d}}-01', y, m)
  when 5 then format('{{:d}}-{{:02d}}-01', y, m) else '' end as start, case k % 7 when 1 then (y + 1) || '-09-01' when 3 then (y + 3) || '-01-01' when 4 then format('{{:d}}-{{:02d}}-01', y + 1, 13 - m) else '' end as "end", k % 7 = 0 as current from ({WHEN})""")
def period_kinds(spark, sf_dir):
    """Periods in words of seven kinds, written from the date of every order."""
    o = table(spark, sf_dir, "orders")
    y, m = F.year("o_orderdate"), F.month("o_orderdate")
    number = lambda c: F.lpad(c.cast("string"), 2, "0")
    kinds = [F.concat(pick(MONTHS, m - 1), F.lit(" "), y, F.lit(" - Present")), F.concat(F.lit("Summer "), y, F.lit(" – Fall "), y + 1), F.concat(F.lit("Q"), F.quarter("o_orderdate"), F.lit(" "), y), F.concat(y, F.lit(" - "), y + 3),
             F.concat(number(m), F.lit("/"), y, F.lit(" to "), number(13 - m), F.lit("/"), y + 1), F.concat(pick(MONTHS, m - 1), F.lit(" "), y), F.concat(F.lit("nothing of "), F.col("o_orderstatus"))]
    p = dates.parse_period(F.element_at(F.array(*kinds), (F.col("o_orderkey") % 7 + 1).cast("int")), AS_OF)
    return o.select("o_orderkey", p["start"].alias("start"), F.coalesce(p["end"], F.lit("")).alias("end"), p["isCurrent"].alias("current"))


@query("""select o_orderkey, trim(regexp_replace('Engineer, ' || strftime(o_orderdate, '%Y') || ' at work', '\\s+', ' ', 'g')) as whole, 'Engineer, at work' as stripped from orders""")
def range_stripped(spark, sf_dir):
    t = F.concat(F.lit("Engineer, "), F.date_format("o_orderdate", "yyyy"), F.lit(" at work"))
    return table(spark, sf_dir, "orders").select("o_orderkey", squeezed(t).alias("whole"), dates.strip_range(t).alias("stripped"))


JOBS = """select o_custkey as k, year(o_orderdate) * 12 + month(o_orderdate) as a, case when o_orderkey % 97 = 0 then 2024 * 12 + 6 else year(o_orderdate) * 12 + month(o_orderdate) + o_orderkey % 24 end as b, o_orderkey % 97 = 0 as cur from orders"""


@query(f"""with j as ({JOBS}), g as (select *, case when a <= max(b) over (partition by k order by a, b rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from j where b >= a),
i as (select *, sum(new) over (partition by k order by a, b rows unbounded preceding) as isl from g), u as (select k, isl, min(a) as a, max(b) as b from i group by all)
select k as o_custkey, coalesce(y, 0.0) as years, last from (select k, case when bool_or(cur) then 'Present' else max(lpad(cast((b - 1) // 12 as varchar), 4, '0') || '-' || lpad(cast((b - 1) % 12 + 1 as varchar), 2, '0')) filter (where not cur) end as last from j group by k)
left join (select k, round_even(sum(b - a)::double / 12, 1) as y from u group by k) using (k)""")
def month_union_years(spark, sf_dir):
    """Orders of a customer as jobs of up to two years: the union of their spans, and the last month."""
    o = table(spark, sf_dir, "orders")
    first = F.date_trunc("month", "o_orderdate")
    now = F.col("o_orderkey") % 97 == 0
    end = F.date_format(F.add_months(first, (F.col("o_orderkey") % 24).cast("int")), "yyyy-MM-dd")
    p = F.struct(F.date_format(first, "yyyy-MM-dd").alias("start"), F.when(~now, end).alias("end"), now.alias("isCurrent"))
    got = normalise.years_and_last(o.select("o_custkey", p.alias("period")), AS_OF, "o_custkey")
    return got.withColumn("last", F.nullif("last", F.lit("")))


ALIAS_TRUTH = [("python3", "Python", "Programming Languages"), ("golang", "Go", "Programming Languages"), ("JS", "JavaScript", "Programming Languages"), ("k8s", "Kubernetes", "Cloud"), ("postgres", "PostgreSQL", "Databases"), ("Excel", "Excel", "Data"),
               ("c", "c", ""), ("zig", "zig", ""), ("Go", "Go", "Programming Languages"), ("(React.js)", "React", "Web"), ("spark", "Spark", "Data")]


@query(_truth(ALIAS_TRUTH, "item, name, grp"))
def alias_canonical(spark, sf_dir):
    return normalise.canonical_skill(_each(spark, sf_dir, [x[0] for x in ALIAS_TRUTH]), "item").select("o_orderkey", "item", "name", "grp")


@query("""select p_partkey, case p_partkey % 3 when 0 then 'Python, PostgreSQL, Kubernetes' when 1 then 'JavaScript, Spark' else '' end as names from part""")
def tech_mentions(spark, sf_dir):
    said = F.element_at(F.array(F.lit("Ran python3 on k8s with postgres, not pythonic "), F.lit("Wrote js and Spark jobs, no spark of go "), F.lit("Nothing of note: rubyist ")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(normalise.technologies(F.concat(said, "p_name")), ", ").alias("names"))


DEGREE_TRUTH = [("B.Tech", "Bachelor of Technology"), ("MBA", "Master of Business Administration"), ("m.sc", "Master of Science"), ("Bachelor of Arts", "Bachelor of Arts"), ("ph.d", "Doctor of Philosophy"), ("Diploma", "Diploma"), ("Bachelors Degree", "Bachelor's Degree"), ("10th", "SSC")]


@query(f"""with d as (select p_partkey, p_name, p_partkey % 3 as r, {picked([t for t, _ in DEGREE_TRUTH], 'p_partkey')} as said, {picked([t for _, t in DEGREE_TRUTH], 'p_partkey')} as known from part)
select p_partkey, case when r > 0 and said = known then said || (case r when 1 then ' in ' else ' - ' end) || p_name else known end as kind, case when r > 0 and said <> known then p_name else '' end as course from d""")
def degrees(spark, sf_dir):
    """Degrees with the part's name as their subject, in two spellings, or without; only what is no full name yet is cut."""
    k = F.col("p_partkey")
    subject = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit(" in "), "p_name")).otherwise(F.concat(F.lit(" - "), "p_name"))
    d = normalise.split_degree(F.concat(pick([t for t, _ in DEGREE_TRUTH], k), subject), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", d["type"].alias("kind"), d["course"].alias("course"))


@query("""select o_orderkey, case o_orderkey % 5 when 0 then 'CGPA: ' || o_orderkey % 10 || '.' || (10 + o_orderkey % 83) || '/10' when 1 then 'Percentage: ' || (10 + o_orderkey % 90) || '.5%' when 2 then 'GPA: 3.' || o_orderkey % 10 when 3 then 'Grade: ' || o_orderkey % 10 || '/10' else '' end as score from orders""")
def grade_scores(spark, sf_dir):
    k = F.col("o_orderkey")
    said = [F.concat(F.lit("cgpa "), k % 10, F.lit("."), 10 + k % 83, F.lit(" /10")), F.concat(F.lit("scored "), 10 + k % 90, F.lit(".5%")), F.concat(F.lit("GPA: 3."), k % 10), F.concat(F.lit("grade "), k % 10, F.lit(" out of 10")), F.concat(F.lit("order "), k)]
    return table(spark, sf_dir, "orders").select("o_orderkey", normalise.score_output(F.element_at(F.array(*said), (k % 5 + 1).cast("int"))).alias("score"))


@query("select o_orderkey, o_orderkey % 5 in (0, 2, 4) as achieved from orders")
def achievements(spark, sf_dir):
    k = F.col("o_orderkey")
    said = [F.concat(F.lit("Reduced cost by "), 1 + k % 99, F.lit("%")), F.concat(F.lit("Maintained servers of status "), "o_orderstatus"), F.concat(F.lit("Winner of the contest of "), F.date_format("o_orderdate", "MMMM")),
            F.concat(F.lit("Wrote reports in "), F.year("o_orderdate")), F.concat(F.lit("Improved speed from 4s to 2s for "), 100 + k % 900, F.lit(" users"))]
    return table(spark, sf_dir, "orders").select("o_orderkey", normalise.is_achievement(F.element_at(F.array(*said), (k % 5 + 1).cast("int"))).alias("achieved"))


AWARD_TRUTH = [("Winner, state hackathon of ", "award"), ("AWS Certified Developer ", "certification"), ("Certified champion ", "none"), ("Blue ribbon of ", "none")]


@query(f"select c_custkey, {picked([t for _, t in AWARD_TRUTH], 'c_custkey')} as kind from customer")
def award_kinds(spark, sf_dir):
    text = F.concat(pick([t for t, _ in AWARD_TRUTH], F.col("c_custkey")), F.lower("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(normalise.award_or_certification(text, F.lit("")), F.lit("none")).alias("kind"))


SPELT = "case o_orderkey % 3 when 0 then repeat(letter, 8) when 1 then upper(repeat(letter, 8)) else ' ' || repeat(letter, 8) || '.' end"


@query(f"""with o as (select o_custkey, o_orderkey, chr(cast(97 + o_orderkey % 26 as int)) as letter from orders),
g as (select o_custkey, letter, min(o_orderkey) as first, arg_min({SPELT}, o_orderkey) as name, cast(count(*) - 1 as int) as n_merged from o group by all)
select o_custkey as doc_id, cast(row_number() over (partition by o_custkey order by first) - 1 as int) as ord, name, n_merged from g""")
def dedupe_entries(spark, sf_dir):
    """Orders of each customer as awards named by one of 26 letters, in three spellings: those of one name are one award."""
    none, line = F.lit(""), F.col("o_orderkey").cast("int")
    name = F.expr(SPELT)
    o = table(spark, sf_dir, "orders").withColumn("letter", F.char(F.lit(97) + F.col("o_orderkey") % 26))
    e = o.select(F.col("o_custkey").alias("doc_id"), F.lit(0).alias("section_no"), line.alias("entry_no"), F.array(line).alias("line_ids"), F.struct(name.alias("name"), none.alias("issuingBody"), none.alias("date"), none.alias("justification")).alias("entry"))
    return dedupe(e, "awards").select("doc_id", "ord", "entry.name", "n_merged")


FIRST, LAST, PLACES = ["Elko", "Mara", "Tilda", "Bren"], ["Quill", "Tarn", "Hosker"], ["Pune", "Mumbai", "Chennai"]
TITLES = ["Software Engineer", "Data Analyst", "Project Manager", "Research Intern", "Product Designer"]
FIRMS = ["Ketter Systems", "Brask Industries Ltd", "Norvik Technologies", "Alder Solutions"]
SCHOOLS = ["Calder College", "Ferrin University", "Ostrel Institute of Technology"]
COURSES = [("B.Tech in Information Technology", "Bachelor of Technology", "Information Technology"), ("M.Sc in History", "Master of Science", "History")]
CUSTOMER = f"""select c_custkey as k, {picked(TITLES, 'c_custkey')} as title, {picked(FIRMS, 'c_custkey')} as company, {picked(SCHOOLS, 'c_custkey')} as school, {picked([t for _, t, _ in COURSES], 'c_custkey')} as degree, {picked([c for _, _, c in COURSES], 'c_custkey')} as course, 2005 + c_custkey % 12 as y, c_custkey % 2 = 1 as monthly from customer"""


def _written_records(spark, sf_dir):
    """``doc_id, text``: a record of every customer, in eight layouts."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    y, monthly = (F.lit(2005) + k % 12).cast("int"), k % 2 == 1
    since = F.when(monthly, F.concat(F.lit("Mar "), y)).otherwise(y.cast("string"))
    until = F.when(monthly, F.concat(F.lit("Aug "), y + 2)).otherwise((y + 2).cast("string"))
    colon, mark = F.when(k % 4 >= 2, ":").otherwise(""), F.when(k % 8 >= 4, "- ").otherwise("• ")
    said = F.concat(F.lit("Reduced the run time of report "), k, F.lit(" by "), 10 + k % 80, F.lit("%."))
    lines = [F.concat(pick(FIRST, k), F.lit(" "), pick(LAST, k)), F.concat(F.lit("c"), k, F.lit("@mail.example.org | +91 98765 "), F.lpad((k % 100_000).cast("string"), 5, "0"), F.lit(" | "), pick(PLACES, k), F.lit(", India")), F.concat(F.lit("EXPERIENCE"), colon), F.concat(pick(TITLES, k), F.lit("\t"), since, F.lit(" - "), until), pick(FIRMS, k), F.concat(mark, said),
             F.concat(F.lit("EDUCATION"), colon), F.concat(pick([t for t, _, _ in COURSES], k), F.lit("\t"), y - 4, F.lit(" - "), y), pick(SCHOOLS, k), F.concat(F.lit("SKILLS"), colon), F.lit("React, Node.js, MongoDB")]
    return c.select(k.cast("string").alias("doc_id"), F.concat_ws("\n", *lines).alias("text"))


#: Sections and heads of the lines of a written record.
LINES = [("header", False)] * 2 + [("workHistory", True)] + [("workHistory", False)] * 3 + [("education", True)] + [("education", False)] * 2 + [("skills", True), ("skills", False)]


@query(f"select cast(c_custkey as varchar) as doc_id, v.n as line_no, v.section, v.is_heading = 'True' as is_heading from customer cross join ({values([(i, s, h) for i, (s, h) in enumerate(LINES)])}) as v(n, section, is_heading)")
def record_lines(spark, sf_dir):
    """Headings and sections of the lines of every customer's record."""
    from ..records import from_texts

    lines = sections.segment(written(from_texts(_written_records(spark, sf_dir)), "lines"))
    return lines.select("doc_id", "line_no", "section", "is_heading")


ENTRIES = [("workHistory", 2, 1, 3, 5), ("education", 2, 0, 7, 8), ("skills", 1, 0, 10, 10)]


@query(f"select cast(c_custkey as varchar) as doc_id, 0 as entry_no, v.* from customer cross join ({values(ENTRIES)}) as v(section, n_head, n_body, first, last)")
def record_entries(spark, sf_dir):
    """Entries of the sections of every customer's record: lines of their heads and bodies."""
    from ..records import from_texts

    lines = written(sections.segment(written(from_texts(_written_records(spark, sf_dir)), "lines")), "sections")
    found = entries.entries(lines)
    return found.select("doc_id", "entry_no", "section", F.size("head").alias("n_head"), F.size("body").alias("n_body"), F.array_min("line_ids").alias("first"), F.array_max("line_ids").alias("last"))


@query(f"""select cast(k as varchar) as doc_id, first || ' ' || last as name, '+9198765' || lpad(cast(k % 100000 as varchar), 5, '0') as phone, 'c' || k || '@mail.example.org' as email, city, 'India' as country
from (select c_custkey as k, {picked(['Elko', 'Mara', 'Tilda', 'Bren'], 'c_custkey')} as first, {picked(['Quill', 'Tarn', 'Hosker'], 'c_custkey')} as last, {picked(['Pune', 'Mumbai', 'Chennai'], 'c_custkey')} as city from customer)""")
def record_contacts(spark, sf_dir):
    """Contact data of every customer's record."""
    from ..records import from_texts

    m = header.header(written(from_texts(_written_records(spark, sf_dir)), "lines")).select("doc_id", "metaDetails.*")
    return m.select("doc_id", "name", F.col("phone_no").alias("phone"), "email", F.col("address.city").alias("city"), F.col("address.country").alias("country"))


FIELDS = [("workHistory", "title", 3), ("workHistory", "company", 4), ("education", "institution", 8)]


@query(f"select cast(c_custkey as varchar) as doc_id, v.* from customer cross join ({values(FIELDS)}) as v(section, field, line_no)")
def record_provenance(spark, sf_dir):
    """The lines that the fields of every customer's record are grounded in."""
    from ..records import Options, extract, from_texts

    found = extract(from_texts(_written_records(spark, sf_dir)), Options(AS_OF)).provenance
    named = found.select("doc_id", F.regexp_extract("path", r"^(\w+)\[", 1).alias("section"), F.regexp_extract("path", r"\.(\w+)$", 1).alias("field"), F.explode("line_ids").alias("line_no"))
    return named.filter(F.concat_ws(".", "section", "field").isin([f"{a}.{b}" for a, b, _ in FIELDS]))


@query(f"""select cast(k as varchar) as doc_id, 'c' || k || '@mail.example.org' as email, title, company, 'Web: React, Node.js; Databases: MongoDB' as skills, y || case when monthly then '-03-01' else '-01-01' end as start, (y + 2) || case when monthly then '-08-01' else '-01-01' end as "end", school, degree, course,
  1 as n_jobs, 1 as n_schools, 'Reduced the run time of report ' || k || ' by ' || (10 + k % 80) || '%.' as achievement from ({CUSTOMER})""")
def extracted_records(spark, sf_dir):
    """A document written for every customer, in eight layouts, through the whole chain: records with the fields put in."""
    from ..records import Options, extract, from_texts

    docs = _written_records(spark, sf_dir)
    found = extract(from_texts(docs), Options(AS_OF)).records
    job, school = F.try_element_at("workHistory", F.lit(1)), F.try_element_at("education", F.lit(1))
    return found.select("doc_id", F.col("metaDetails.email").alias("email"), job["title"].alias("title"), job["company"].alias("company"), job["period"]["start"].alias("start"), job["period"]["end"].alias("end"), school["institution"].alias("school"),
                        school["field"]["type"].alias("degree"), school["field"]["course"].alias("course"), F.array_join(F.transform("skills", lambda g: F.concat(g["field"], F.lit(": "), F.array_join(F.transform(g["tools"], lambda x: x["name"]), ", "))), "; ").alias("skills"), F.size("workHistory").alias("n_jobs"), F.size("education").alias("n_schools"), F.try_element_at(job["achievements"], F.lit(1)).alias("achievement"))
