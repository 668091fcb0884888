"""Text transforms, sources and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.functions import text as T
from tarnweave.operators import chunking, keywords
from tarnweave.queries import query
from tarnweave.sources import filings as S
from tarnweave.sources import standin
from tarnweave.sources.standin import table

_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_NOISE = r"(?i)^(ix:\w+|contextRef=|Loading\.\.\.|XBRL\s+Viewer\s*$|This page uses Javascript\.|Your browser either doesn''t support Javascript or you have it turned off\.|Please enable JavaScript to use the EDGAR Inline XBRL Viewer\.)"
_START = r"\bQUARTERLY\s+REPORT\b|\bANNUAL\s+REPORT\b|\bFORM\s+10[\-\x{2011}\x{2013}]?\s*[KQ]\b|UNITED\s+STATES\s+SECURITIES\s+AND\s+EXCHANGE\s+COMMISSION"

#: The corpus has no filings' residue; every document gets some, by its id.
_DRESSED = """dressed AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'XBRL Viewer' WHEN 1 THEN '  ix:header x' WHEN 2 THEN 'Loading...' ELSE 'kept line' END
  || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'cover' || chr(10) || 'Form 10-K' ELSE '' END || chr(10) || 'ITEM 1a.' || chr(10) || 'RISK ' || text || '   ' || chr(10)
  || chr(10) || chr(10) || '[TABLE]' || chr(10) || 'item ' || (doc_id % 9) || ' Other' || chr(10) || 'Item 7 Foo' || chr(10) || 'item 9b  ' AS t FROM documents)"""


def dressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    noise = F.when(i % 4 == 0, "XBRL Viewer").when(i % 4 == 1, "  ix:header x").when(i % 4 == 2, "Loading...").otherwise("kept line")
    cover = F.when(i % 3 == 0, "cover\nForm 10-K").otherwise("")
    parts = [noise, F.lit("\n"), cover, F.lit("\nITEM 1a.\nRISK "), F.col("text"), F.lit("   \n\n\n[TABLE]\nitem "), (i % 9).cast("string"), F.lit(" Other\nItem 7 Foo\nitem 9b  ")]
    return d.select("doc_id", F.concat(*parts).alias("t"))


_DIGEST = "SELECT doc_id, length(x) AS n_chars_out, md5(x) AS digest FROM"


def _digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.length("x").cast("long").alias("n_chars_out"), F.md5("x").alias("digest"))


def _noise_sql(t: str) -> str:
    return rf"array_to_string(list_filter(string_split_regex(regexp_replace({t}, '({_BREAK})\z', ''), '{_BREAK}'), lambda l: NOT regexp_matches(regexp_replace(l, '^{_BLANK}+|{_BLANK}+$', '', 'g'), '{_NOISE}')), chr(10))"


def _start_sql(t: str) -> str:
    return rf"length(regexp_extract({t}, '(?is)^(.*?)(?:{_START})', 1))"


def _items_sql(t: str) -> str:
    marked = rf"regexp_replace({t}, '(?m)^[ \t]*(?:ITEM|item)[\s\x0b]+(\d+)([A-Za-z]?)\.?[\s\x0b]+', chr(10) || 'Item \1' || chr(57344) || '\2. ', 'g')"
    return f"array_to_string(list_transform(string_split({marked}, chr(57344)), lambda p, i: CASE WHEN i = 1 THEN p ELSE upper(p[1]) || p[2:] END), '')"


def _space_sql(t: str) -> str:
    x = rf"regexp_replace({t}, '(?i)\[/?TABLE\]', '', 'g')"
    x = rf"regexp_replace({x}, '(?m)[ \t]+$', '', 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


@query(f"WITH {_DRESSED} {_DIGEST} (SELECT doc_id, {_noise_sql('t')} AS x FROM dressed)")
def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(dressed(spark, sf_dir).select("doc_id", T.strip_noise_lines(F.col("t")).alias("x")))


@query(f"WITH {_DRESSED} SELECT doc_id, {_start_sql('t')}::INT AS start FROM dressed")
def doc_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dressed(spark, sf_dir).select("doc_id", T.document_start(F.col("t")).alias("start"))


@query(f"WITH {_DRESSED} {_DIGEST} (SELECT doc_id, {_items_sql('t')} AS x FROM dressed)")
def item_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(dressed(spark, sf_dir).select("doc_id", T.normalize_items(F.col("t")).alias("x")))


@query(f"WITH {_DRESSED} {_DIGEST} (SELECT doc_id, {_space_sql('t')} AS x FROM dressed)")
def whitespace_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(dressed(spark, sf_dir).select("doc_id", T.normalize_whitespace(F.col("t")).alias("x")))


_CLEAN = f"""{_DRESSED}, a AS (SELECT doc_id, {_noise_sql('t')} AS t FROM dressed),
b AS (SELECT doc_id, t[{_start_sql('t')} + 1:] AS t FROM a), c AS (SELECT doc_id, {_items_sql('t')} AS t FROM b),
cleaned AS (SELECT doc_id, {_space_sql('t')} AS x FROM c)"""


@query(f"WITH {_CLEAN} {_DIGEST} cleaned")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(dressed(spark, sf_dir).select("doc_id", T.clean_text(F.col("t")).alias("x")))


@query(
    f"""WITH {_CLEAN}, parts AS (SELECT doc_id, unnest(regexp_extract_all(x, '(?im)(?:^Item\\s+\\d+[A-Z]?\\.)(?:[^\\n]*)(?:\\n|$)|[^\\n]*\\n?')) AS line, generate_subscripts(regexp_extract_all(x, '(?im)(?:^Item\\s+\\d+[A-Z]?\\.)(?:[^\\n]*)(?:\\n|$)|[^\\n]*\\n?'), 1) AS pos FROM cleaned),
marked AS (SELECT *, regexp_matches(line, '(?i)^Item\\s+\\d+[A-Z]?\\.') AS head FROM parts WHERE line <> ''),
numbered AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM marked),
bodies AS (SELECT doc_id, k, trim(min(line) FILTER (head), ' ' || chr(9) || chr(10)) AS title, string_agg(CASE WHEN head THEN '' ELSE line END, '' ORDER BY pos) AS body FROM numbered WHERE k > 0 GROUP BY doc_id, k),
kept AS (SELECT *, len(list_filter(string_split_regex(body, '\\s+'), lambda w: w <> '')) AS n FROM bodies),
final AS (SELECT doc_id, title, n, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i FROM kept WHERE n >= 50)
SELECT doc_id, i::INT AS section_index, title, n::INT AS n_tokens, doc_id || '__' || i || '__' || regexp_replace(left(regexp_replace(title, '[^A-Za-z0-9]+', '_', 'g'), 50), '^_+|_+$', '', 'g') AS section_id FROM final"""
)
def item_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dressed(spark, sf_dir).select("doc_id", T.clean_text(F.col("t")).alias("x"))
    rows = chunking.item_sections(cleaned, "doc_id", "x")
    return rows.select("doc_id", "section_index", "title", F.size(T.tokens(F.col("body"))).alias("n_tokens"), "section_id")


@query(
    r"""SELECT page_id, md5(x) AS digest, length(x) - length(replace(x, chr(10), '')) + 1 AS n_lines FROM (SELECT page_id, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '[ \t]+\n', chr(10), 'g') AS x FROM (
SELECT page_id, pos, trim(regexp_replace(line, '[\s\x{a0}]+$|^[\s\x{a0}]+', '', 'g')) AS line FROM (SELECT page_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (
SELECT page_id, string_split(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', chr(1), 'g'), '(?s)<h([1-4])[^>]*>([^<]*)</h[1-4]>', chr(1) || '## \2' || chr(1) || '\2' || chr(1), 'g'), '(?s)<[^>]*>', chr(1), 'g'), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(1)) AS l FROM pages)) ) WHERE line <> '' GROUP BY page_id)"""
)
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", T.html_to_text("html").alias("x"))
    return rows.select("page_id", F.md5("x").alias("digest"), F.size(F.split("x", "\n")).cast("long").alias("n_lines"))


_NAMES = """names AS (SELECT doc_id, CASE doc_id % 6 WHEN 5 THEN source ELSE source || '_' || (['10K', '10Q', 'DEF14A', '8K', 'X'])[doc_id % 5 + 1] || '_' || CASE WHEN doc_id % 2 = 0 THEN '2023' ELSE '2024-10_24' END END || '.clean.txt' AS name FROM documents)"""


@query(
    f"""WITH {_NAMES}, p AS (SELECT doc_id, replace(name, '.clean.txt', '') AS b FROM names),
q AS (SELECT doc_id, b, string_split(b, '_') AS s FROM p)
SELECT doc_id, s[1] AS ticker, CASE WHEN len(s) >= 3 THEN replace(replace(replace(replace(s[2], '10K', '10-K'), '10Q', '10-Q'), 'DEF14A', 'DEF 14A'), '8K', '8-K') ELSE coalesce(s[2], '?') END AS form_type,
CASE WHEN len(s) >= 3 THEN array_to_string(s[3:], '_') ELSE 'unknown' END AS period, b AS name FROM q"""
)
def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    form = F.element_at(F.array(*map(F.lit, ("10K", "10Q", "DEF14A", "8K", "X"))), (i % 5 + 1).cast("int"))
    name = F.when(i % 6 == 5, F.col("source")).otherwise(F.concat("source", F.lit("_"), form, F.lit("_"), F.when(i % 2 == 0, "2023").otherwise("2024-10_24")))
    p = table(spark, sf_dir, "documents").select("doc_id", T.parse_filename(F.concat(name, F.lit(".clean.txt"))).alias("p"))
    return p.select("doc_id", "p.ticker", "p.form_type", "p.period", F.col("p.doc_id").alias("name"))


@query("SELECT doc_id, regexp_replace(left(regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g'), 50), '^_+|_+$', '', 'g') AS slug FROM documents")
def slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


#: Filings, sections and chunks of the stand-in corpus.
GRAPH = r"""docs AS (SELECT doc_id AS num, 'D' || doc_id AS doc_id, source AS ticker, (['10-K', '10-Q', '8-K', 'DEF 14A'])[doc_id % 4 + 1] AS form_type, (2020 + doc_id % 7)::VARCHAR AS period, text,
  list_filter(string_split_regex(coalesce(text, ''), '[\s\x0b]+'), lambda w: w <> '') AS t FROM documents),
secs AS (SELECT num, doc_id, ticker, form_type, period, i AS section_index, doc_id || '_sec_' || (i + 1) AS section_id, 'Section ' || (i + 1) AS title, list_slice(t, i * 400 + 1, i * 400 + 400) AS t
  FROM (SELECT *, unnest(range(0, ceil(len(t) / 400.0)::BIGINT)) AS i FROM docs)),
shds AS (SELECT num, doc_id, ticker, form_type, period, section_index, section_id, title, j AS chunk_index, section_id || '_shd_' || (j + 1) AS shadow_id, list_slice(t, j * 160 + 1, j * 160 + 200) AS t
  FROM (SELECT *, unnest(range(0, ceil(len(t) / 160.0)::BIGINT)) AS j FROM secs)),
tree AS (SELECT s.*, array_to_string(s.t, ' ') AS text, e.vec_id, e.embedding::DOUBLE[] AS vec, e.label::BIGINT AS cluster_id
  FROM shds s JOIN embeddings e ON e.vec_id = (s.num * 7 + s.section_index * 5 + s.chunk_index) % (SELECT max(vec_id) + 1 FROM embeddings))"""


@query(f"WITH {GRAPH} SELECT doc_id, section_index::INT AS section_index, section_id, title, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM secs")
def upload_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.sections(standin.filings(spark, sf_dir))
    return rows.select("doc_id", "section_index", "section_id", "title", F.size(T.tokens(F.col("text"))).alias("n_tokens"), F.md5("text").alias("digest"))


@query(f"WITH {GRAPH} SELECT doc_id, section_id, shadow_id, chunk_index::INT AS chunk_index, len(t)::INT AS token_count, md5(array_to_string(t, ' ')) AS digest FROM shds")
def sliding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.chunk_rows(standin.filings(spark, sf_dir))
    return rows.select("doc_id", "section_id", "shadow_id", "chunk_index", "token_count", F.md5("text").alias("digest"))


@query()
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their lines as paragraphs."""
    docs = standin.filings(spark, sf_dir).select("doc_id", F.col("doc_id").alias("section_id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    rows = chunking.paragraph_chunks(docs, 100, 20)
    return rows.select("doc_id", "shadow_id", "chunk_index", "token_count", F.md5("text").alias("digest"))


@query(f"WITH {GRAPH} SELECT doc_id, array_to_string(t[1:64], ' ') AS head FROM docs")
def truncate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin.filings(spark, sf_dir).select("doc_id", T.truncate_tokens(F.col("text"), 64).alias("head"))


@query(
    """WITH f AS (SELECT o_orderkey, o_custkey, o_orderpriority AS form, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS pos FROM orders),
annual AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY pos) AS r FROM f WHERE form = '1-URGENT' AND year(o_orderdate) - 1 BETWEEN 1992 AND 1996),
rest AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, form ORDER BY pos) AS r FROM f WHERE form IN ('2-HIGH', '3-MEDIUM', '5-LOW'))
SELECT o_custkey, form, o_orderkey, (year(o_orderdate) - 1)::INT AS fiscal_year FROM annual WHERE r = 1
UNION ALL SELECT o_custkey, form, o_orderkey, NULL FROM rest WHERE r <= CASE form WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 1 ELSE 2 END"""
)
def filing_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 with orders as filings: customers are companies, priorities forms."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("form"), F.to_date("o_orderdate").alias("filed"), F.col("o_orderkey").alias("accession"))
    out = S.select_filings(rows, annual="1-URGENT", years=range(1992, 1997), first={"2-HIGH": 3, "3-MEDIUM": 1, "5-LOW": 2})
    return out.select(F.col("company").alias("o_custkey"), "form", F.col("accession").alias("o_orderkey"), "fiscal_year")


@query(
    """SELECT o_custkey, (o_orderkey::VARCHAR || '-' || '07') AS accession, 'https://files.example/Archives/edgar/data/' || o_custkey || '/' || o_orderkey || '07/doc.htm' AS url FROM orders"""
)
def filing_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays of each customer's orders back to rows, with their addresses."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.col("o_orderkey").cast("string"), F.lit("-07")).alias("accession"))
    hist = o.groupBy("o_custkey").agg(F.collect_list("accession").alias("accession"))
    hist = hist.withColumn("document", F.transform("accession", lambda x: F.lit("doc.htm")))
    rows = S.zip_history(hist, ["accession", "document"], ["o_custkey"])
    cik = F.lpad(F.col("o_custkey").cast("string"), 10, "0")
    return rows.select("o_custkey", "accession", S.document_url("https://files.example", cik, F.col("accession"), F.col("document")).alias("url"))


@query(
    f"""WITH {GRAPH},
k AS (SELECT shadow_id, regexp_extract_all(lower(x), '\\b[a-z]{{3,}}\\b') AS x, raw FROM (SELECT shadow_id, regexp_replace(regexp_replace(array_to_string(t, ' '), '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', ' ', 'g'), '[^\\x00-\\x7F]', '0', 'g') AS x, array_to_string(t, ' ') AS raw FROM shds)),
w AS (SELECT shadow_id, unnest(x) AS v FROM k),
g AS (SELECT shadow_id, v, count(*) AS n FROM w WHERE v NOT IN ({', '.join(f"'{s}'" for s in sorted(keywords._STOP))}) GROUP BY shadow_id, v),
a AS (SELECT shadow_id, sum(n) AS kept, count(*) AS uniq, max(n) AS top FROM g GROUP BY shadow_id)
SELECT k.shadow_id, len(k.x) = 0 OR coalesce(kept, 0) < 0.30 * len(k.x) OR coalesce(uniq, 0) < 20 OR len(regexp_extract_all(raw, '(?i)https?://|www\\.|\\.com|\\.gov|\\.org')) > 3 OR coalesce(top, 0) > 0.10 * len(k.x) AS boilerplate FROM k LEFT JOIN a USING (shadow_id)"""
)
def boilerplate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.chunk_rows(standin.filings(spark, sf_dir))
    return rows.select("shadow_id", keywords.is_boilerplate(F.col("text")).alias("boilerplate"))
