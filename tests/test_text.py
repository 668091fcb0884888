from pyspark.sql import functions as F

from tarnweave.functions import text as T
from tarnweave.operators import chunking, keywords


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_item_headers(spark):
    assert one(spark, "ITEM 1a.\nRISK", T.normalize_items) == "\nItem 1A. RISK"
    assert one(spark, "Item 7 Foo", T.normalize_items) == "Item 7 Foo"
    assert one(spark, "ITEM 1a\nITEM 2b.\nx", T.normalize_items) == "\nItem 1A. \nItem 2B. x"


def test_cleaning(spark):
    raw = "XBRL Viewer\n  ix:foo\r\nLoading...\nUNITED STATES\x0bx\nForm 10-K  \n\n\n\n[TABLE]\nbody\n"
    assert one(spark, raw, T.clean_text) == "Form 10-K\n\nbody"
    assert one(spark, "no anchor", T.document_start) == 0
    assert one(spark, None, T.clean_text) is None


def test_html():
    page = "<html><style>p{}</style><h1>Title</h1><table><tr><th>a</th><td>b c</td></tr><tr></tr></table><p>x &amp; y</p><script>z</script></html>"
    assert T.html_text(page) == "## Title\nTitle\n[TABLE]\na | b c\n[/TABLE]\nx & y"
    assert T.html_text("<title>a &amp;&amp</title><p>b&lt;c & d &copy e</p>") == "a &&amp\nb<c & d &copy e"
    assert T.html_text(None) is None and T.html_text("") == ""


def test_file_names(spark):
    got = one(spark, "TSLA_DEF14A_2024-10_24.clean.txt", T.parse_filename)
    assert (got.ticker, got.form_type, got.period, got.doc_id) == ("TSLA", "DEF 14A", "2024-10_24", "TSLA_DEF14A_2024-10_24")
    assert one(spark, "X.clean.txt", T.parse_filename).asDict() == {"ticker": "X", "form_type": "?", "period": "unknown", "doc_id": "X"}
    assert one(spark, "Item 1A. Risk -- Factors!", T.slug) == "Item_1A_Risk_Factors"


def test_filters(spark):
    got = one(spark, "Does a segment afford 2023 or 2023, 2030?", T.detect_filters)
    assert got.tickers == ["F", "GM"] and got.years == ["2023", "2023"] and got.form_type is None
    assert one(spark, "results for F annually", T.detect_filters).asDict() == {"tickers": ["F"], "years": [], "form_type": "10-K"}
    assert one(spark, "for", T.detect_filters).tickers == []


def test_sections(spark):
    body = " ".join(["w"] * 50)
    text = f"toc\nItem 1. Stub\n{' '.join(['w'] * 49)}\nItem 1A. Risk\n{body}\nItem 2. End"
    rows = chunking.item_sections(spark.createDataFrame([("D", text), ("E", "plain"), ("F", "Item 1. a\nItem 2. b")], "id string, t string"), "id", "t").collect()
    assert {(r.doc_id, r.section_index, r.section_id, r.title) for r in rows} == {("D", 0, "D__0__Item_1A_Risk", "Item 1A. Risk"), ("E", 0, "E__0__Full_Document", "Full Document")}


def test_packing():
    size = lambda chunks: [sum(b - a for a, b in c) for c in chunks]
    assert size(chunking.pack_paragraphs([10, 1001])) == [10, 1000, 201]
    assert size(chunking.pack_paragraphs([900, 900])) == [900, 1100]
    assert chunking.pack_paragraphs([]) == []


def test_windows(spark):
    rows = spark.createDataFrame([("D", "D_sec_1", " ".join(map(str, range(1000)))), ("E", "E_sec_1", None)], "doc_id string, section_id string, text string")
    got = chunking.sliding_chunks(rows).orderBy("chunk_index").collect()
    assert [(r.shadow_id, r.token_count) for r in got] == [("D_sec_1_shd_1", 1000), ("D_sec_1_shd_2", 200)]


def test_phrases(spark):
    assert sorted(one(spark, "beta alpha, Alpha beta the gamma", keywords.candidates)) == ["alpha", "alpha alpha", "alpha beta", "beta", "gamma"]
    assert one(spark, "", keywords.candidates) == []
    words = [a + b + c for a in "bcdfg" for b in "aeiou" for c in "klmnp"]
    assert one(spark, " ".join(words), keywords.is_boilerplate) is False
    assert one(spark, " ".join(words) + " https://www.x.com https://www.x.com", keywords.is_boilerplate) is True
    assert one(spark, " ".join([*words, *["zzz"] * 30]), keywords.is_boilerplate) is True
    assert one(spark, None, keywords.is_boilerplate) is True


def test_summaries_of_empty_texts(spark, tmp_path):
    from tarnweave.queries.build import summaries

    rows = [(0, "held one"), (1, ""), (2, " \n\x0b"), (4, None), (5, " a  b ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.summary for r in summaries(spark, str(tmp_path)).collect()} == {0: "held", 1: "", 2: "", 4: "", 5: "a b"}


def test_clean_text_is_its_steps(spark):
    import random

    rnd = random.Random(7)
    parts = ["XBRL Viewer", "ix:foo bar", "Loading...", "ITEM 1a.", "item 9b", "Item 7 Foo", "RISK", "[TABLE]", "[/table]", " \t", "\n", "\n\n\n", "\r\n", "\x0b", "\x85", " ", "\xa0", "FORM 10-K", "form 10‑q", "Annual  Report", "UNITED STATES SECURITIES AND EXCHANGE COMMISSION", "größe", "text", "please enable JavaScript to use the EDGAR Inline XBRL Viewer."]
    rows = spark.createDataFrame([(i, "".join(rnd.choice(parts) + rnd.choice([" ", "\n", ""]) for _ in range(25))) for i in range(300)] + [(300, ""), (301, None)], "id long, x string")
    kept = rows.select("id", "x", T.strip_noise_lines(F.col("x")).alias("k"))
    steps = kept.select("id", "x", T.normalize_whitespace(T.normalize_items(F.substr("k", T.document_start(F.col("k")) + 1))).alias("steps"))
    assert steps.where(~F.col("steps").eqNullSafe(T.clean_text(F.col("x")))).select("id", "x", "steps").take(3) == []
    plan = rows.select(T.clean_text(F.col("x")).alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("XBRL") == 0  # the noise pattern isn't repeated for each use of its result
