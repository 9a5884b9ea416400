import random
import zipfile

from pyspark.sql import functions as F

from foliant.functions.constants import UNNAMED_PAGE
from foliant.operators import html, markup, pages
from foliant.operators.chunking import chunk_counts, chunk_pages, split_text
from foliant.operators.windows import context_windows
from foliant.plans.jobs import prepare_books, prepare_texts
from foliant.sources import files
from foliant.streaming.ingest import stream_chunks, write_stream


def _pages(spark, text):
    out = pages.split_pages(spark.createDataFrame([("d", text)], "doc_name string, text string"))
    return [(r.page_ord, r.page_number, r.page_label, r.text) for r in out.orderBy("page_ord").collect()]


def test_pages_without_marker(spark):
    assert _pages(spark, " one\n") == [(0, 1, "1", "one")]


def test_pages_with_markers(spark):
    text = "pre≦ 1 ≧　first　≦≧ still≦ ≧blank≦Part A/1≧named≦2≧  ≦+5≧plus"
    assert _pages(spark, text) == [(0, 0, "0", "pre"), (1, 1, "1", "first　≦≧ still"), (2, None, UNNAMED_PAGE, "blank"), (3, None, "Part A/1", "named"), (5, 5, "+5", "plus")]


def test_pages_of_null_and_empty(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "≦1≧")], "doc_name string, text string")
    assert pages.split_pages(df).count() == 0


def test_chunk_id(spark):
    df = spark.createDataFrame([("d", None, "Part A/1", 2), ("d", 7, "7", 1)], "doc_name string, page_number int, page_label string, chunk_no int")
    assert [r.chunk_id for r in pages.with_chunk_id(df).orderBy("chunk_no").collect()] == ["d_p7_c1", "d_pPart_A_1_c2"]


def _slow_split(text, size, overlap, separators):
    """The same rules, written by recursion over whole strings."""
    sep = next((s for s in separators if s == "" or s in text), separators[-1])
    rest = separators[separators.index(sep) + 1 :]
    if sep:
        raw = text.split(sep)
        parts = [raw[0]] + [sep + x for x in raw[1:]]
    else:
        parts = list(text)
    parts = [p for p in parts if p]
    chunks, held = [], []

    def flush(force=True):
        nonlocal held
        if not held:
            return
        x = "".join(held).strip()
        if x:
            chunks.append(x)

    def pack(p):
        nonlocal held
        if held and sum(map(len, held)) + len(p) > size:
            flush()
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(p) > size):
                held = held[1:]
        held.append(p)

    for p in parts:
        if len(p) < size:
            pack(p)
        else:
            flush()
            held = []
            chunks += _slow_split(p, size, overlap, rest) if rest else [p]
    flush()
    return chunks


def test_split_text_against_plain_rules():
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(["a", "bc", "。", "，", ". ", ", ", " ", "\n\n", "word"]) for _ in range(rng.randint(0, 60)))
        size, overlap = rng.randint(3, 20), rng.choice([0, 0, 2])
        seps = ["\n\n", "。", "，", ". ", ", ", " ", ""]
        got = split_text(text, size, overlap, seps) if text else []
        assert got == (_slow_split(text, size, overlap, seps) if text else [])
        assert all(len(c) <= size for c in got)
        if not overlap:
            assert "".join("".join(got).split()) == "".join(text.split())


def test_chunk_pages_counts_before_the_length_filter(spark):
    df = spark.createDataFrame([("d", 0, 1, "1", "x" * 30 + " ab " + "y" * 30), ("d", 1, 2, "2", None)], "doc_name string, page_ord int, page_number int, page_label string, text string")
    out = chunk_pages(df, size=31, least=10)
    assert [(r.chunk_no, r.chunk_id, len(r.text)) for r in out.orderBy("chunk_no").collect()] == [(1, "d_p1_c1", 30), (3, "d_p1_c3", 30)]
    assert {(r.doc_name, r.n_chunks) for r in chunk_counts(out).collect()} == {("d", 2), (None, 2)}


def test_chunks_do_not_depend_on_partitions(spark, rows):
    df = spark.createDataFrame([(f"d{k}", "word " * (k * 40)) for k in range(12)], "doc_name string, text string")
    assert rows(chunk_pages(pages.split_pages(df.repartition(1)))) == rows(chunk_pages(pages.split_pages(df.repartition(7))))


def test_chapters(spark):
    data = [
        ("b", 0, "<h1>One &amp; two</h1><p>a<b>b</b></p><p>c<p>d<div>out</div>"),
        ("b", 1, "<h3>Third</h3><h2> </h2><p>x</p>"),
        ("b", 2, "<p>no title</p>"),
        ("b", 3, "<h2>T</h2><!-- <p>hidden</p> --><script>'<p>s</p>'</script><p>　y　</p>"),
        ("c", 0, None),
    ]
    df = spark.createDataFrame(data, "doc_name string, item_no long, html string")
    text = html.chapters_to_text(df)
    assert [(r.item_no, r.text) for r in text.orderBy("item_no").collect()] == [(0, "≦One & two≧\n\nab\nc\nd\n"), (3, "≦T≧\n\ny\n")]
    books = html.assemble_books(text)
    assert books.first().text == "≦One & two≧\n\nab\nc\nd\n≦T≧\n\ny\n"
    assert {tuple(r) for r in html.conversion_report(df, books).collect()} == {("b", "converted"), ("c", "failed")}


def test_context_windows(spark):
    data = [("one", 1, 0, 1, "a"), ("three", None, 9, 1, "z"), ("three", 2, 1, 1, "y"), ("three", 1, 0, 1, "x"), ("two", 1, 0, 1, "p"), ("two", 2, 1, 1, "q")]
    df = spark.createDataFrame(data, "doc_name string, page_number int, page_ord int, chunk_no int, text string")
    assert [(r.text_a, r.text, r.text_c) for r in context_windows(df).collect()] == [("x", "y", "z")]


def test_context_windows_of_long_documents(spark):
    """Runs of a few rows, with pages without a number, null texts and documents of null name, against lists."""
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, k // 3]), k, 1, None if k % 9 == 0 else f"t{k}") for k in range(200)]
    df = spark.createDataFrame(data, "doc_name string, page_number int, page_ord int, chunk_no int, text string")
    want = set()
    for name in ("a", "b", None):
        rows = sorted((x for x in data if x[0] == name), key=lambda x: (x[1] is None, x[1] or 0, x[2]))
        want |= {(x[2], rows[k - 1][4] if k else None, rows[k + 1][4] if k + 1 < len(rows) else None) for k, x in enumerate(rows)}
    for span in (4, 1000):
        assert {(r.page_ord, r.text_a, r.text_c) for r in context_windows(df.repartition(5), middle_only=False, span=span).collect()} == want


def test_context_windows_of_one_page(spark):
    """100,000 chunks of one page: sixteen tasks or more, and every neighbour right."""
    n = 100_000
    df = spark.range(n).select(F.lit("d").alias("doc_name"), F.lit(1).alias("page_number"), F.lit(0).alias("page_ord"), F.col("id").alias("chunk_no"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    out = context_windows(df, middle_only=False, span=5000)
    wrong = out.where("not (text_a <=> if(chunk_no = 0, null, concat('t', chunk_no - 1)) and text_c <=> if(chunk_no = 99999, null, concat('t', chunk_no + 1)))")
    assert out.count() == n and wrong.isEmpty()
    runs = spark.read.parquet(*[f.rsplit("/", 1)[0] for f in out.inputFiles()[:1]]).groupBy("_run").count().collect()
    assert len(runs) >= 16 and max(r["count"] for r in runs) < 3 * 5000


def test_sources_and_jobs(spark, tmp_path):
    (tmp_path / "a b+.txt").write_text("≦1≧" + "hello world. " * 3, encoding="utf-8")
    (tmp_path / "blank.txt").write_text(" 　\n")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "other.TXT").write_text("not read")
    assert [r.doc_name for r in files.read_text_corpus(spark, str(tmp_path)).collect()] == ["a b+.txt"]
    assert [r.doc_name for r in files.unreadable_files(spark, str(tmp_path)).collect()] == ["bad.txt"]
    chunks = prepare_texts(spark, str(tmp_path))
    assert [r.chunk_id for r in chunks.collect()] == ["a b+.txt_p1_c1"]
    files.write_chunks(chunks, str(tmp_path / "out"))
    (tmp_path / "array.json").write_text('[{"doc_name": "d", "page_number": 3, "chunk_id": "x", "text": "a"}, {"doc_name": "d", "page_number": "iv", "chunk_id": "y", "text": "b"}]')
    assert [(r.page_number, r.page_label, r.chunk_id) for r in files.read_chunks(spark, str(tmp_path / "array.json")).orderBy("chunk_id").collect()] == [(3, "3", "x"), (None, "iv", "y")]
    many = spark.range(20).selectExpr("'d' doc_name", "cast(id as string) page_number", "cast(id as string) chunk_id", "'t' text").coalesce(1)
    files.write_chunks(many, str(tmp_path / "many"))
    assert files.read_chunks(spark, str(tmp_path / "many")).count() == 20
    back = files.read_chunks(spark, str(tmp_path / "out")).first()
    assert (back.chunk_id, back.page_number) == ("a b+.txt_p1_c1", 1)


def test_epub(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.EPUB", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item href="1.xhtml" media-type="application/xhtml+xml"/><item href="x.css" media-type="text/css"/><item href="2.xhtml" media-type="application/xhtml+xml"/></manifest></package>')
        z.writestr("o/1.xhtml", "<html><body><h1>A</h1><p>first paragraph here</p></body></html>")
        z.writestr("o/2.xhtml", "<html><body><h1>7</h1><p>second paragraph here</p></body></html>")
    (tmp_path / "broken.epub").write_bytes(b"no zip")
    items = files.read_epub(spark, str(tmp_path))
    assert items.where("html is null").count() == 1 and items.count() == 3
    out = prepare_books(spark, str(tmp_path)).orderBy("page_ord").collect()
    assert [(r.doc_name, r.page_number, r.chunk_id, r.text) for r in out] == [("b.EPUB", None, "b.EPUB_pA_c1", "first paragraph here"), ("b.EPUB", 7, "b.EPUB_p7_c1", "second paragraph here")]
    report = html.conversion_report(items, html.assemble_books(html.chapters_to_text(items)))
    assert {tuple(r) for r in report.collect()} == {("b.EPUB", "converted"), ("broken.epub", "failed")}
    assert files.html_text("a&eacute;<b>c</b>") == "aéc"


def test_references():
    """Character references as browsers read them: without a semicolon, of the table for 128 to 159, of no character."""
    cases = {
        "It&#8217;s caf&eacute; &mdash; ok": "It’s café — ok", "&amp;lt; &#38;lt;": "&lt; &lt;", "&#x1F600; &#X41;": "😀 A", "&nosuch; &": "&nosuch; &", "x&notin;y": "x∉y", "plain": "plain",
        "a &amp b &copy 2020 &lt3": "a & b © 2020 <3", "&#150;&#x80;&#151 x&#146;s": "–€— x’s", "&#0;&#55555;&#x110000;": "\ufffd\ufffd\ufffd", "&notit; &ampx": "¬it; &x", "&#65&#66": "AB",
    }
    for text, want in cases.items():
        assert markup.read_chapter(f"<h1>t</h1><p>{text}</p>") == ("t", [want])


def test_open_elements():
    """A fixture made by hand: end tags that are missing, misplaced or match nothing."""
    cases = [
        ("<h1>T</h1><p>a<p>b<b>c<p>d</b>e", "T", ["a", "bc", "de"]),
        ("<h1>T</h1><div><p>a<div>out<p>b</div>out<p>c</div>", "T", ["a", "b", "c"]),
        ("<h1>T</h1><ul><li><p>one<li>two<p>three<ul><li>in<p>four</ul>out</ul>out", "T", ["one", "three", "four"]),
        ("<h1>T</h1><table><tr><td><p>a<td>b<p>c<tr><td>d</table>out<p>e", "T", ["a", "c", "e"]),
        ("<h1>T</h1><p>a<button>x<p>inner</button>b</p>out", "T", ["axb", "inner"]),
        ("<h1>T</h1><p>a</div>b</p></p>out", "T", ["ab"]),
        ("<h1>T</h1><p>a<span>b</p>out</span>out<p>c", "T", ["ab", "c"]),
        ("<h2>No</h2><h1>A<em>b</em> c<h1>Second</h1><p>x", "Ab c", ["x"]),
        ("<h1>A</h3>out<p>x", "A", ["x"]),
        ("<h1>A<p>inside</p>b</h1><h2>B<p>stays</h2><p>x", "Ainsideb", ["stays", "x"]),
        ("<p>a<script>if (a<b) '<p>no</p>'</script>b<style>p{}</style>c<!-- <p>no -->d<h1>T</h1>", "T", ["abcd"]),
        ("<html><head><title><p>no</title></head><body><h1>T</h1><P CLASS='a>b'>x<br/>y<img alt='<p>'>z</P>", "T", ["xyz"]),
        ("<dl><dt><p>a<dd><p>b<dt>c</dl><h3>T</h3><p>d<hr>out", "T", ["a", "b", "d"]),
        ("<h1> </h1><h2>T</h2><p>x", "", ["x"]),
        ("no heading<p>x", None, ["x"]),
        ("", None, []),
        ("<p>\u3000 y \xa0</p><h6>\u3000T </h6><p></p><p/><p>unfinished &am", "T", ["y", "", "", "unfinished &am"]),
    ]
    for html_, title, lines in cases:
        assert markup.read_chapter(html_) == (title, lines), html_
    deep = "<div>" * 50_000 + "<p>x" + "</div>" * 50_000 + "<h1>T"
    assert markup.read_chapter(deep) == ("T", ["x"])


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("some text that is long enough")
    for _ in range(2):  # the second run finds nothing new
        write_stream(stream_chunks(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select(F.count("*")).first()[0] == 1
