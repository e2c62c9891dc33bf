"""Queries on documents, pages and their lines: sources, contacts, links, sections."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.links import classify, clean_url, host, hrefs, norm_url
from ..functions.text import EMAIL, ground_form, metric_form, redacted, repaired
from ..operators import entries, header, sections
from ..operators.layout import text_features
from ..scratch import written
from ..sources.lines import page_gate, text_lines
from ..sources.structured import plain, stratified
from ..tables import table
from .registry import pick, query, values

MOST_BROADCAST = 8 << 20  # bytes of benchmark texts
LINES = "select doc_id, cast(unnest(range(len(l))) as int) as line_no, unnest(l) as text from (select doc_id, string_split(text, chr(10)) as l from documents)"
MAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
#: Labels with the section that they are the heading of, and the one that their last keyword names.
LABELS = [
    ("Work Experience", "workHistory", "workHistory"), ("Education", "education", "education"), ("Technical Skills", "skills", "skills"), ("Certifications", "certifications", "certifications"), ("Awards & Honors", "awards", "awards"), ("Proj ects", "projects", ""),
    ("Hobbies", "interests", "interests"), ("Lorem Ipsum", "", ""), ("Volunteering Events", "", "affiliations"), ("Summary of Skills", "", "skills"), ("University Project", "", "projects"), ("Teaching Experience", "", "workHistory"), ("Languages Known", "languages", "languages"),
]


def doc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(LINES)
def doc_lines(spark, sf_dir):
    return text_lines(doc_table(spark, sf_dir))


@query(f"select doc_id, count(*) as n_lines, cast(sum(length(text)) as bigint) as n_chars, max(length(text)) as longest, count(*) filter (where trim(text) = '') as n_blank from ({LINES}) group by doc_id")
def line_stats(spark, sf_dir):
    n = F.length("text").cast("long")
    return text_lines(doc_table(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(n).alias("n_chars"), F.max(n).alias("longest"), F.count_if(F.trim("text") == "").alias("n_blank"))


@query(f"""select doc_id, arg_min(email, line_no) as email, min(line_no) as line_no from (
  select doc_id, line_no, regexp_extract(replace(text, chr(9), ' | '), '{MAIL}') as email from ({LINES})) where email <> '' group by doc_id""")
def first_email(spark, sf_dir):
    return header.first_email(text_lines(doc_table(spark, sf_dir)))


@query(f"""select lower(split_part(email, '@', 2)) as domain, count(*) as n, count(distinct doc_id) as n_docs from (
  select doc_id, unnest(regexp_extract_all(text, '{MAIL}')) as email from documents) group by 1""")
def email_domains(spark, sf_dir):
    found = doc_table(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).alias("email"))
    return found.groupBy(F.lower(F.split("email", "@")[1]).alias("domain")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(rf"""with t as (select doc_id, line_no, regexp_replace(regexp_replace(replace(text, chr(9), ' | '), '{MAIL}', ' ', 'g'), '(?i)(?:19|20)\d{{2}}\s*[-–—/]\s*(?:(?:19|20)?\d{{2}}|present)', ' ', 'g') as t from ({LINES})),
p as (select doc_id, line_no, regexp_replace(regexp_extract(t, '\+\d{{1,3}}[\s\-.]?\(?\d[\d\s\-.()]{{7,}}\d'), '\D', '', 'g') as coded,
  regexp_replace(regexp_extract(t, '(?:^|[^\d+])((?:0|91[\s-]?)?[6-9]\d{{4}}[\s-]?\d{{5}})(?:\D|$)', 1), '\D', '', 'g') as plain from t)
select doc_id, line_no, case when length(coded) >= 10 then '+' || coded else '+91' || right(plain, 10) end as phone from p where length(coded) >= 10 or plain <> ''""")
def phone_candidates(spark, sf_dir):
    return text_lines(doc_table(spark, sf_dir)).select("doc_id", "line_no", header.phone_of("text").alias("phone")).filter("phone is not null")


@query(r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)(mongodb(?:\+srv)?://)([^:@/\s]+):([^@\s]+)@', '\1\2:***@', 'g'), '\b(gsk_|sk-|AIza|ghp_|hf_)[A-Za-z0-9_-]{8,}', '\1***', 'g'),
  '(?i)(bearer\s+)[A-Za-z0-9._-]{8,}', '\1***', 'g') as shown
from (select doc_id, 'mongodb://u' || doc_id || ':pw' || doc_id || '@h/db key sk-' || md5(cast(doc_id as varchar)) || ' Authorization: Bearer ' || md5(lang) || ' ' || text as t from documents)""")
def secret_redaction(spark, sf_dir):
    d = doc_table(spark, sf_dir)
    i = F.col("doc_id").cast("string")
    t = F.concat(F.lit("mongodb://u"), i, F.lit(":pw"), i, F.lit("@h/db key sk-"), F.md5(i), F.lit(" Authorization: Bearer "), F.md5("lang"), F.lit(" "), "text")
    return d.select("doc_id", redacted(t).alias("shown"))


@query("select doc_id, sha256(text) as digest from documents")
def mojibake_repair(spark, sf_dir):
    """Texts whose bytes were read as Latin-1, read again."""
    spoilt = F.when(F.col("doc_id") % 3 > 0, F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).otherwise(F.col("text"))
    return doc_table(spark, sf_dir).select("doc_id", spoilt.alias("text")).select("doc_id", F.sha2(F.encode(repaired("text"), "UTF-8"), 256).alias("digest"))


@query(f"""select doc_id, 0 as page_no, cast(n_chars as bigint) as n_chars, case when n_chars > 0 then n_cid * 1.0::double / n_chars else 0.0 end as cid_ratio, n_chars < 200 or (n_chars > 0 and n_cid * 1.0::double / n_chars > 0.05) as needs_ocr
from (select doc_id, sum(length(regexp_replace(text, '\\s', '', 'g'))) as n_chars, sum(len(regexp_extract_all(text, '\\(cid:\\d+\\)'))) as n_cid from ({LINES}) group by doc_id)""")
def quality_gate(spark, sf_dir):
    return page_gate(text_lines(doc_table(spark, sf_dir)).withColumn("page_no", F.lit(0)), least_chars=200)


@query(r"""select page_id, cast(unnest(range(len(l))) as int) as n, unnest(l) as href from (select page_id, regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"'']*)["'']', 1) as l from pages)""")
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(hrefs("html")).alias("n", "href"))


@query(r"""with h as (select page_id, url, regexp_replace(lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.\-]*://([^/?#]*)', 1)), '^www\.', '') as host,
  list_filter(string_split(regexp_extract(url, '(?i)^[a-z][a-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as parts from pages)
select page_id, host, case when host like '%linkedin.com' then 'skip' when host = 'github.com' then 'github_repo' else 'other' end as kind, host || '/' || array_to_string(parts, '/') as norm from h""")
def url_classify(spark, sf_dir):
    u = clean_url("url")
    return table(spark, sf_dir, "pages").select("page_id", host(u).alias("host"), classify(u)["kind"].alias("kind"), norm_url("url").alias("norm"))


@query(r"""select page_id, title, h1, trim(lower(title)) = trim(lower(h1)) as same from (
  select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) as title,
   trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) as h1 from pages)""")
def page_titles(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    title, h1 = (plain(F.regexp_extract("html", rf"(?is)<{t}>(.*?)</{t}>", 1)) for t in ("title", "h1"))
    return p.select("page_id", title.alias("title"), h1.alias("h1")).withColumn("same", F.trim(F.lower("title")) == F.trim(F.lower("h1")))


@query(f"""select c_custkey, v.exact as section from customer join ({values([(i, e) for i, (_, e, _) in enumerate(LABELS)])}) as v(n, exact) on v.n = c_custkey % {len(LABELS)}""".replace("v.exact as", "nullif(v.exact, '') as"))
def heading_exact(spark, sf_dir):
    """A label in one of four spellings for every customer."""
    return _labels(spark, sf_dir).select("c_custkey", sections.exact_heading("label").alias("section"))


@query(f"""select c_custkey, nullif(v.word, '') as section from customer join ({values([(i, w) for i, (_, _, w) in enumerate(LABELS)])}) as v(n, word) on v.n = c_custkey % {len(LABELS)}""")
def heading_keyword(spark, sf_dir):
    return _labels(spark, sf_dir).select("c_custkey", sections.keyword_section("label").alias("section"))


def _labels(spark, sf_dir):
    k = F.col("c_custkey")
    label = pick([x for x, _, _ in LABELS], k)
    shown = F.when(k % 4 == 0, F.upper(label)).when(k % 4 == 1, F.concat(label, F.lit(":"))).when(k % 4 == 2, F.concat(F.lit("  "), F.lower(label), F.lit(" section "))).otherwise(label)
    return table(spark, sf_dir, "customer").select("c_custkey", shown.alias("label"))


@query("""with c as (select conv_id, turn, role, case when role is distinct from lag(role) over (partition by conv_id order by turn) then turn end as starts from conversations)
select conv_id, turn, role, max(starts) over (partition by conv_id order by turn rows unbounded preceding) as opened from c""")
def section_fill_forward(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    marked = c.withColumn("starts", F.when(~F.col("role").eqNullSafe(before), F.col("turn")))
    return sections.fill_forward(marked, F.col("starts"), "turn", "conv_id", name="opened").drop("starts")


@query("""with n as (select doc_id, trim(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g')) as form from documents)
select md5(form) as digest, min(doc_id) as kept, count(*) as n from n group by form having count(*) > 1""")
def exact_dedupe(spark, sf_dir):
    forms = doc_table(spark, sf_dir).select("doc_id", F.md5(ground_form("text", compat=False)).alias("digest"))
    return forms.groupBy("digest").agg(F.min("doc_id").alias("kept"), F.count("*").alias("n")).filter("n > 1")


def _norm(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^0-9a-z]+', ' ', 'g'))"


@query(f"""with b as (select item_id, {_norm('text')} as f from benchmark), d as (select doc_id, {_norm('text')} as t from documents)
select doc_id, item_id, cast(instr(t, f) - 1 as int) as at from d join b on contains(' ' || t || ' ', ' ' || f || ' ') where len(string_split(f, ' ')) >= 5""")
def bench_overlap(spark, sf_dir):
    """Benchmark texts grounded in documents: candidates share the first five words, so no pair is compared in vain."""

    def grams(words: str):
        return F.transform(F.sequence(F.lit(1), F.size(words) - 4), lambda i: F.xxhash64(F.array_join(F.slice(words, i, 5), " ")))

    def worded(df):
        return df.withColumn("w", F.split("t", " ")).filter(F.size("w") >= 5)

    b = worded(table(spark, sf_dir, "benchmark").select("item_id", ground_form("text", compat=False).alias("t"))).select("item_id", F.col("t").alias("f"), F.xxhash64(F.array_join(F.slice("w", 1, 5), " ")).alias("g"))
    b = written(b, "items")
    if b.agg(F.coalesce(F.sum(F.octet_length("f")), F.lit(0))).first()[0] <= MOST_BROADCAST:  # else it is shuffled
        b = F.broadcast(b)
    d = written(doc_table(spark, sf_dir).select("doc_id", ground_form("text", compat=False).alias("t")), "forms")
    found = worded(d).select("doc_id", F.explode(F.array_distinct(grams("w"))).alias("g")).join(b, "g").drop("g")
    whole = found.join(d, "doc_id").filter(F.instr(F.concat(F.lit(" "), "t", F.lit(" ")), F.concat(F.lit(" "), "f", F.lit(" "))) > 0)
    return whole.select("doc_id", "item_id", (F.instr("t", F.col("f")) - 1).cast("int").alias("at"))


@query("select lang, doc_id, n_chars from (select *, row_number() over (partition by lang order by n_chars desc, doc_id) as k from documents) where k <= 5")
def stratified_sample(spark, sf_dir):
    return stratified(doc_table(spark, sf_dir), 5, [F.desc("n_chars"), "doc_id"], "lang").select("lang", "doc_id", "n_chars")


@query(f"""select word, count(*) as n from (select regexp_extract(lower(text), '([a-z]+)[^a-z]*$', 1) as word from ({LINES}) where regexp_matches(text, '[A-Za-z]')) where length(word) > 2 group by word having count(*) >= 4""")
def last_word_lexicon(spark, sf_dir):
    from ..operators.training import title_lexicon

    return title_lexicon(text_lines(doc_table(spark, sf_dir)), "text")


@query("select doc_id, trim(lower(regexp_replace(regexp_replace(coalesce(text, ''), '[.,;:!?''\"()\\[\\]‘’“”«»„]', '', 'g'), '\\s+', ' ', 'g'))) as form from (select doc_id, trim(text) as text from documents)")
def metric_forms(spark, sf_dir):
    return doc_table(spark, sf_dir).select("doc_id", F.trim(metric_form("text", compat=False)).alias("form"))


@query()
def entries_fold(spark, sf_dir):
    """Conversations as lines of one section; the fold splits them into entries."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("line_no"), "text")
    lines = text_features(c).withColumns({"section": F.lit("projects"), "section_no": F.lit(1), "heading": F.lit(""), "is_heading": F.lit(False), "spans": F.lit(None).cast("string")})
    return entries.entries(lines).select("doc_id", "entry_no", F.size("head").alias("n_head"), F.size("body").alias("n_body"), "line_ids")


@query()
def document_contacts(spark, sf_dir):
    """Contact data of every document."""
    docs = doc_table(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return header.header(written(text_features(text_lines(docs)), "lines"))


