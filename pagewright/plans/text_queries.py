"""Queries of the text, statistics and date functions, each with the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import dates as D
from pagewright.functions import rules
from pagewright.functions import text as T
from pagewright.sources.tables import table

QUERIES, ORACLES = {}, {}
_I = "::INTEGER"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(F.col("html").isNotNull())


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _quoted(words) -> str:
    return "|".join(w.replace("'", "''") for w in words)


# Pages ----------------------------------------------------------------------------------------------------------------
_P = "FROM pages WHERE html IS NOT NULL"


@query(f"SELECT page_id, trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)) AS title {_P}")
def page_title_raw(spark, d):
    return _pages(spark, d).select("page_id", F.trim(F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1)).alias("title"))


@query(f"SELECT page_id, strlen(html)::BIGINT AS bytes {_P}")
def page_bytes(spark, d):
    return _pages(spark, d).select("page_id", T.byte_length("html").cast("bigint").alias("bytes"))


@query(f"SELECT page_id, sha256(html) AS digest {_P}")
def page_digest(spark, d):
    return _pages(spark, d).select("page_id", F.sha2("html", 256).alias("digest"))


@query(f"SELECT page_id, md5(html) AS digest {_P}")
def page_string_digest(spark, d):
    return _pages(spark, d).select("page_id", T.string_digest("html").alias("digest"))


@query(f"SELECT page_id, len(regexp_extract_all(html, '<[a-zA-Z]')){_I} AS elements {_P}")
def page_elements(spark, d):
    return _pages(spark, d).select("page_id", F.size(F.regexp_extract_all("html", F.lit("<[a-zA-Z]"), F.lit(0))).alias("elements"))


@query(f"SELECT page_id, len(regexp_extract_all(html, '<a[ >]')){_I} AS anchors {_P}")
def anchor_count(spark, d):
    return _pages(spark, d).select("page_id", F.size(F.regexp_extract_all("html", F.lit("<a[ >]"), F.lit(0))).alias("anchors"))


@query(f"SELECT tag, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag {_P}) GROUP BY tag")
def tag_histogram(spark, d):
    return _pages(spark, d).select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


_PARAGRAPHS = r"(?s)<p[^>]*>(.*?)</p>"
_P_SQL = f"SELECT page_id, fetched_at, unnest(x) AS text, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT page_id, fetched_at, regexp_extract_all(html, '{_PARAGRAPHS}', 1) AS x {_P})"


def _paragraphs(spark, d):
    return _pages(spark, d).select("page_id", "fetched_at", F.posexplode(F.regexp_extract_all("html", F.lit(_PARAGRAPHS), F.lit(1))).alias("pos", "text"))


@query(f"SELECT page_id, pos{_I} AS pos, text FROM ({_P_SQL})")
def paragraphs(spark, d):
    return _paragraphs(spark, d).select("page_id", "pos", "text")


@query(f"SELECT page_id, pos{_I} AS pos, sha256(text) AS digest FROM ({_P_SQL})")
def paragraph_digest(spark, d):
    return _paragraphs(spark, d).select("page_id", "pos", F.sha2("text", 256).alias("digest"))


@query(
    f"SELECT page_id, pos{_I} AS pos, bytes FROM (SELECT page_id, pos, strlen(text)::BIGINT AS bytes, row_number() OVER (PARTITION BY page_id, fetched_at ORDER BY strlen(text) DESC, pos, text) AS rn FROM ({_P_SQL})) WHERE rn = 1"
)
def top_paragraph_per_page(spark, d):
    w = Window.partitionBy("page_id", "fetched_at").orderBy(F.octet_length("text").desc(), "pos", "text")
    return _paragraphs(spark, d).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("page_id", "pos", F.octet_length("text").cast("bigint").alias("bytes"))


_LINKS = r'(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>'


@query(
    f"""SELECT page_id, href, text, (regexp_matches(lower(text), '{_quoted(rules.IMPORTANT_LINKS)}') OR (contains(lower(text), '...') AND strlen(lower(text)) < 30) OR lower(text) = 'more' OR lower(text) LIKE '% more') AS important
    FROM (SELECT page_id, regexp_extract(m, '{_LINKS}', 1) AS href, regexp_extract(m, '{_LINKS}', 2) AS text FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_LINKS}')) AS m {_P}))"""
)
def page_links(spark, d):
    m = _pages(spark, d).select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_LINKS), F.lit(0))).alias("m"))
    x = m.select("page_id", F.regexp_extract("m", _LINKS, 1).alias("href"), F.regexp_extract("m", _LINKS, 2).alias("text"))
    return x.select("page_id", "href", "text", T.is_important_link("text").alias("important"))


_NAV = r"(?s)<nav[^>]*>(.*?)</nav>"


@query(f"""SELECT DISTINCT page_id, unnest(regexp_extract_all(regexp_extract(html, '{_NAV}', 1), 'href="([^"]*)"', 1)) AS href {_P}""")
def nav_links(spark, d):
    return _pages(spark, d).select("page_id", F.explode(F.regexp_extract_all(F.regexp_extract("html", _NAV, 1), F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).distinct()


@query(
    f"""SELECT page_id, bytes, CASE WHEN bytes = 0 THEN 0 ELSE round(links / bytes, 6) END AS density FROM (SELECT page_id, strlen(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<[^>]*>', '', 'g'))::BIGINT AS bytes,
    coalesce(list_sum(list_transform(regexp_extract_all(html, '(?s)<a [^>]*>([^<]*)</a>', 1), lambda x: strlen(x))), 0)::DOUBLE AS links {_P})"""
)
def page_link_density(spark, d):
    plain = F.octet_length(F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", "")).cast("bigint")
    links = F.aggregate(F.regexp_extract_all("html", F.lit(r"(?s)<a [^>]*>([^<]*)</a>"), F.lit(1)), F.lit(0), lambda a, x: a + F.octet_length(x)).cast("double")
    x = _pages(spark, d).select("page_id", plain.alias("bytes"), links.alias("links"))
    return x.select("page_id", "bytes", F.when(F.col("bytes") == 0, 0.0).otherwise(F.round(F.col("links") / F.col("bytes"), 6)).alias("density"))


@query(f"""SELECT page_id, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang, lower(regexp_extract(html, '<meta[^>]*charset="([^"]*)"', 1)) AS charset {_P}""")
def page_language(spark, d):
    return _pages(spark, d).select("page_id", F.regexp_extract("html", '<html[^>]*lang="([^"]*)"', 1).alias("lang"), F.lower(F.regexp_extract("html", '<meta[^>]*charset="([^"]*)"', 1)).alias("charset"))


@query(
    f"""SELECT page_id, regexp_extract(m, 'name="([^"]*)"|property="([^"]*)"', CASE WHEN m LIKE '%property=%' THEN 2 ELSE 1 END) AS name, regexp_extract(m, 'content="([^"]*)"', 1) AS content
    FROM (SELECT page_id, unnest(regexp_extract_all(html, '<meta[^>]*>')) AS m {_P}) WHERE m LIKE '%content=%'""".replace(
        """regexp_extract(m, 'name="([^"]*)"|property="([^"]*)"', CASE WHEN m LIKE '%property=%' THEN 2 ELSE 1 END)""", """CASE WHEN m LIKE '%property=%' THEN regexp_extract(m, 'property="([^"]*)"', 1) ELSE regexp_extract(m, 'name="([^"]*)"', 1) END"""
    )
)
def page_metas(spark, d):
    m = _pages(spark, d).select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<meta[^>]*>"), F.lit(0))).alias("m")).where(F.col("m").contains("content="))
    name = F.when(F.col("m").contains("property="), F.regexp_extract("m", 'property="([^"]*)"', 1)).otherwise(F.regexp_extract("m", 'name="([^"]*)"', 1))
    return m.select("page_id", name.alias("name"), F.regexp_extract("m", 'content="([^"]*)"', 1).alias("content"))


@query(f"SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS html {_P}")
def strip_comments(spark, d):
    return _pages(spark, d).select("page_id", F.regexp_replace("html", r"(?s)<!--.*?-->", "").alias("html"))


@query(f"SELECT page_id, regexp_replace(html, '(?s)<script.*?</script>', '', 'g') AS html {_P}")
def remove_scripts(spark, d):
    return _pages(spark, d).select("page_id", F.regexp_replace("html", r"(?s)<script.*?</script>", "").alias("html"))


@query(f"SELECT page_id, trim(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS text {_P}")
def plain_text(spark, d):
    t = F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", " ")
    return _pages(spark, d).select("page_id", F.trim(F.regexp_replace(t, r"[ \t\n\r]+", " ")).alias("text"))


@query(f"SELECT page_id, regexp_replace(html, '[ \\t\\n\\r\\f]*<[ \\t\\n\\r\\f]*(/?[a-zA-Z][^>]*?)[ \\t\\n\\r\\f]*>', '<\\1>', 'g') AS html {_P}")
def tight_tags(spark, d):
    return _pages(spark, d).select("page_id", T.tighten_tags("html").alias("html"))


@query(f"SELECT page_id, html AS html_first FROM (SELECT *, row_number() OVER (PARTITION BY sha256(html) ORDER BY page_id, fetched_at) AS rn {_P}) WHERE rn = 1")
def pages_once(spark, d):
    w = Window.partitionBy(F.sha2("html", 256)).orderBy("page_id", "fetched_at")
    return _pages(spark, d).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("page_id", F.col("html").alias("html_first"))


@query(f"SELECT digest, n FROM (SELECT sha256(html) AS digest, count(*)::BIGINT AS n {_P} GROUP BY 1) WHERE n > 1")
def repeated_pages(spark, d):
    return _pages(spark, d).groupBy(F.sha2("html", 256).alias("digest")).agg(F.count("*").alias("n")).where("n > 1")


@query(f"SELECT page_id, bytes FROM (SELECT page_id, max(strlen(html))::BIGINT AS bytes {_P} GROUP BY page_id) ORDER BY bytes DESC, page_id LIMIT 10")
def largest_pages(spark, d):
    return _pages(spark, d).groupBy("page_id").agg(F.max(F.octet_length("html")).cast("bigint").alias("bytes")).orderBy(F.desc("bytes"), "page_id").limit(10)


@query(
    f"""SELECT page_id, class, (CASE WHEN regexp_matches(class, '{rules.POSITIVE}') THEN 25 ELSE 0 END - CASE WHEN regexp_matches(class, '{rules.NEGATIVE}') THEN 25 ELSE 0 END){_I} AS weight,
    (regexp_matches(class || ' ', '{rules.UNLIKELY}') AND NOT regexp_matches(class || ' ', '{rules.MAYBE}')) AS unlikely FROM (SELECT page_id, unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS class {_P})"""
)
def class_weights(spark, d):
    x = _pages(spark, d).select("page_id", F.explode(F.regexp_extract_all("html", F.lit('class="([^"]*)"'), F.lit(1))).alias("class"))
    return x.select("page_id", "class", T.class_weight("class", F.lit("")).alias("weight"), T.is_unlikely("class", F.lit("")).alias("unlikely"))


@query(
    f"""SELECT page_id, 'title' AS part, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS text {_P} UNION ALL SELECT page_id, 'h1', regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) {_P}"""
)
def page_sections(spark, d):
    p = _pages(spark, d)
    part = lambda n: p.select("page_id", F.lit(n).alias("part"), F.regexp_extract("html", rf"(?s)<{n}[^>]*>(.*?)</{n}>", 1).alias("text"))
    return part("title").unionByName(part("h1"))


_TOK = "list_filter(string_split_regex(lower({}), '[^0-9A-Za-z_]+'), lambda t: t <> '')"


@query(
    f"""SELECT page_id, CASE WHEN lower(a) = lower(b) THEN 1.0 WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0 ELSE round(m / (len(ta) + len(tb) - m), 6) END AS similarity
    FROM (SELECT *, len(list_filter(ta, lambda t: list_contains(tb, t)))::DOUBLE AS m FROM (SELECT page_id, a, b, {_TOK.format('a')} AS ta, {_TOK.format('b')} AS tb
    FROM (SELECT page_id, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS a, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS b {_P})))"""
)
def heading_title_similarity(spark, d):
    x = _pages(spark, d).select("page_id", F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1).alias("a"), F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1).alias("b"))
    return x.select("page_id", F.round(T.text_similarity("a", "b"), 6).alias("similarity"))


@query(
    f"""SELECT page_id, (contains(t, 'not found') OR contains(t, 'error page') OR contains(b, 'page not found') OR contains(b, '404 error') OR contains(b, 'error 404')) AS is_error
    FROM (SELECT page_id, lower(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)) AS t, lower(html) AS b {_P})"""
)
def error_pages(spark, d):
    return _pages(spark, d).select("page_id", T.is_error_page(F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1), F.col("html")).alias("is_error"))


# Documents ------------------------------------------------------------------------------------------------------------
_WORDS = "list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')"
_ABBR = "text"
for _a in rules.ABBREVIATIONS:
    _ABBR = f"replace({_ABBR}, '{_a}', '{_a.replace('.', '')}')"
_SENT = f"len(regexp_extract_all({_ABBR}, '[\\p{{L}}\\p{{N}}][^.!?]*([.!?]|$)'))"
_SYL = "list_sum(list_transform({w}, lambda w: CASE WHEN lower(w) = 'rhythm' THEN 2 ELSE greatest(greatest(len(regexp_extract_all(lower(w), '[aeiouy]+')), 1) - CASE WHEN strlen(lower(w)) > 2 AND regexp_matches(lower(w), '[^aeiouy]e$') THEN 1 ELSE 0 END, 1) END))"
_SYLLABLES = f"coalesce({_SYL.format(w=_WORDS)}, 0)"


@query(f"SELECT doc_id, len({_WORDS}){_I} AS words FROM documents WHERE text IS NOT NULL")
def doc_words(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", T.count_words("text").alias("words"))


@query(f"SELECT doc_id, {_SENT}{_I} AS sentences FROM documents WHERE text IS NOT NULL")
def doc_sentences(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", T.count_sentences("text").alias("sentences"))


@query(f"SELECT doc_id, {_SYLLABLES}{_I} AS syllables FROM documents WHERE text IS NOT NULL")
def doc_syllables(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", T.count_syllables("text").alias("syllables"))


@query(
    f"SELECT doc_id, round(CASE WHEN w = 0 OR s = 0 THEN 0 ELSE 0.39 * (w / s) + 11.8 * (y / w) - 15.59 END, 6)::DOUBLE AS grade FROM (SELECT doc_id, len({_WORDS})::DOUBLE AS w, {_SENT}::DOUBLE AS s, {_SYLLABLES}::DOUBLE AS y FROM documents WHERE text IS NOT NULL)"
)
def doc_grade_level(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", F.round(T.reading_level("text"), 6).alias("grade"))


@query(f"SELECT doc_id, greatest(len({_WORDS}) // 225, 1){_I} AS minutes FROM documents WHERE text IS NOT NULL")
def doc_reading_time(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", T.reading_time("text").alias("minutes"))


@query("SELECT doc_id, round(1 + (length(text) - length(replace(text, ',', ''))) + least(strlen(text) / 100, 3), 6)::DOUBLE AS score FROM documents WHERE text IS NOT NULL")
def doc_comma_score(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", F.round(T.content_score("text"), 6).alias("score"))


@query(
    "SELECT doc_id, CASE WHEN contains(text, '  ') OR text LIKE ' %' OR regexp_matches(text, '[ \\t\\n\\r\\f\\x0B]$') THEN trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) ELSE text END AS text FROM documents WHERE text IS NOT NULL"
)
def doc_normalized_whitespace(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", T.normalize_whitespace("text").alias("text"))


@query("SELECT doc_id, regexp_replace(text, '[^\\p{L}\\p{M}\\p{N}\\p{P}\\p{S} \\n\\t\\r\\f]', '', 'g') AS text FROM documents WHERE text IS NOT NULL")
def doc_printable(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", T.strip_control_chars("text").alias("text"))


@query()
def doc_normalized_text(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize_text("text").alias("text"))


@query()
def doc_content_digest(spark, d):
    return _docs(spark, d).select("doc_id", T.content_digest("text").alias("digest"))


@query(
    "SELECT source, count(*)::BIGINT AS docs, sum(strlen(text))::BIGINT AS bytes, round(avg(length(text)), 6) AS mean_chars FROM documents GROUP BY source"
)
def source_totals(spark, d):
    g = _docs(spark, d).groupBy("source")
    return g.agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


# Articles -------------------------------------------------------------------------------------------------------------
_CASES = "CASE content_type " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(rules.CONTENT_TYPES)) + " ELSE 'Unknown' END"


@query(f"SELECT {_CASES} AS kind, count(*)::BIGINT AS n FROM (SELECT DISTINCT article_id, content_type FROM article) GROUP BY 1")
def article_types(spark, d):
    a = table(spark, d, "article").select("article_id", "content_type").distinct()
    return a.groupBy(T.content_type_name("content_type").alias("kind")).agg(F.count("*").alias("n"))


_B_SQL = "SELECT article_id, block_no, b.text AS text, b.node_index AS node_index FROM (SELECT article_id, unnest(plain_text) AS b, generate_subscripts(plain_text, 1) - 1 AS block_no FROM article)"


def _blocks(spark, d):
    return table(spark, d, "article").select("article_id", F.posexplode("plain_text").alias("block_no", "b")).select("article_id", "block_no", "b.text", "b.node_index")


@query(f"SELECT DISTINCT article_id, block_no{_I} AS block_no, text, node_index FROM ({_B_SQL})")
def article_blocks(spark, d):
    return _blocks(spark, d).distinct()


@query(f"SELECT DISTINCT article_id, block_no{_I} AS block_no, sha256(text) AS digest FROM ({_B_SQL})")
def block_digests(spark, d):
    return _blocks(spark, d).select("article_id", "block_no", F.sha2("text", 256).alias("digest")).distinct()


@query("SELECT article_id, array_to_string(list_transform(plain_text, lambda b: b.text), chr(10) || chr(10)) || chr(10) || chr(10) AS text FROM article WHERE len(plain_text) > 0")
def text_output(spark, d):
    from pagewright.sources.files import text_column

    return table(spark, d, "article").where(F.size("plain_text") > 0).select("article_id", text_column().alias("text"))


@query(
    "SELECT site_id, article_id, bytes FROM (SELECT site_id, article_id, bytes, row_number() OVER (PARTITION BY site_id ORDER BY bytes DESC, article_id) AS rn FROM (SELECT site_id, article_id, max(strlen(content))::BIGINT AS bytes FROM article WHERE content IS NOT NULL GROUP BY 1, 2)) WHERE rn <= 3"
)
def longest_articles_per_site(spark, d):
    a = table(spark, d, "article").where("content IS NOT NULL").groupBy("site_id", "article_id").agg(F.max(F.octet_length("content")).cast("bigint").alias("bytes"))
    w = Window.partitionBy("site_id").orderBy(F.desc("bytes"), "article_id")
    return a.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("site_id", "article_id", "bytes")


@query(
    "SELECT article_id, (strlen(trim(byline)) BETWEEN 1 AND 100 AND (NOT regexp_matches(trim(byline), '[/•·|—-]') OR length(regexp_replace(trim(byline), '[^0-9]', '', 'g')) <= 0.3 * strlen(trim(byline)))) AS valid FROM (SELECT DISTINCT article_id, byline FROM article WHERE byline IS NOT NULL)"
)
def valid_bylines(spark, d):
    a = table(spark, d, "article").where("byline IS NOT NULL").select("article_id", "byline").distinct()
    return a.select("article_id", T.is_valid_byline("byline").alias("valid"))


@query("SELECT a.article_id, s.host, s.lang FROM (SELECT DISTINCT article_id, site_id FROM article) a JOIN site s USING (site_id)")
def article_sites(spark, d):
    a = table(spark, d, "article").select("article_id", "site_id").distinct()
    return a.join(table(spark, d, "site").select("site_id", "host", "lang"), "site_id").select("article_id", "host", "lang")


@query("SELECT page_id FROM pages WHERE html IS NOT NULL EXCEPT SELECT page_id FROM article WHERE content IS NOT NULL")
def pages_without_content(spark, d):
    return _pages(spark, d).select("page_id").subtract(table(spark, d, "article").where("content IS NOT NULL").select("page_id"))


_TITLE = "trim(regexp_replace(title, '[ \\t\\n\\r\\f\\x0B]{2,}', ' ', 'g'))"
_CLEAN = "t"
for _s in (" » ", " / ", " :: ", " - ", " | "):
    _p = f"string_split(t, '{_s}')"
    _CLEAN = f"CASE WHEN len({_p}) > 1 AND strlen({_p}[-1]) < 10 THEN trim(array_to_string({_p}[1:-2], '{_s}')) WHEN len({_p}) > 1 AND strlen({_p}[1]) < 10 THEN trim(array_to_string({_p}[2:], '{_s}')) ELSE {_CLEAN} END"


@query(f"SELECT article_id, {_CLEAN} AS title FROM (SELECT DISTINCT article_id, {_TITLE} AS t FROM article WHERE title IS NOT NULL)")
def article_clean_titles(spark, d):
    a = table(spark, d, "article").where("title IS NOT NULL").select("article_id", "title").distinct()
    return a.select("article_id", T.clean_title("title").alias("title"))


# Dates ----------------------------------------------------------------------------------------------------------------
_TS = "strftime(expected, '%Y-%m-%dT%H:%M:%SZ')"


@query(f"SELECT parser, date_str, {_TS} AS utc FROM (SELECT parser, date_str, expected AT TIME ZONE 'UTC' AS expected FROM date_case)")
def date_cases(spark, d):
    """The parsers' results on the reference vectors; the SQL gives the expected ones."""
    c = table(spark, d, "date_case")
    own = {"iso": D.parse_iso, "regional": D.parse_regional, "natural": D.parse_natural, "components": D.parse_components}
    parts = [c.where(F.col("parser") == k).withColumn("instant", f("date_str")) for k, f in own.items()]
    parts.append(D.with_dates(c.where(~F.col("parser").isin(*own)), "date_str"))
    out = reduce(DataFrame.unionByName, parts)
    return out.select("parser", "date_str", F.date_format("instant", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"))


@query("SELECT op, input, expected AS result FROM text_case")
def text_cases(spark, d):
    """The text functions' results on the reference vectors; the SQL gives the expected ones."""
    c = table(spark, d, "text_case")
    out = (
        F.when(F.col("op") == "whitespace", T.normalize_whitespace("input"))
        .when(F.col("op") == "control", T.strip_control_chars("input"))
        .when(F.col("op") == "combined", T.normalize_whitespace(T.strip_control_chars("input")))
        .otherwise(T.tighten_tags("input"))
    )
    return c.select("op", "input", out.alias("result"))


@query("SELECT op, text, expected AS result FROM stat_case")
def stat_cases(spark, d):
    """The statistics' results on the reference vectors; the SQL gives the expected ones."""
    c = table(spark, d, "stat_case")
    out = F.when(F.col("op") == "words", T.count_words("text")).otherwise(T.count_sentences("text"))
    return c.select("op", "text", out.cast("double").alias("result"))


@query("SELECT html, expected AS byline FROM byline_case")
def byline_cases(spark, d):
    """The byline extractor's results on the reference vectors; the SQL gives the expected ones."""
    from pagewright.operators.pages import page_byline_column

    return table(spark, d, "byline_case").select("html", page_byline_column("html").alias("byline"))


@query(
    """SELECT event_id, strftime(date_trunc('second', ts AT TIME ZONE 'UTC') - to_hours(event_id % 40), '%Y-%m-%dT%H:%M:%SZ') AS utc FROM events"""
)
def relative_dates(spark, d):
    e = table(spark, d, "events")
    phrase = F.concat((F.col("event_id") % 40).cast("string"), F.lit(" hours ago"))
    return e.select("event_id", F.date_format(D.parse_relative(phrase, F.col("ts")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"))
