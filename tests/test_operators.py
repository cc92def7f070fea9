"""Literal cases for the document operators."""

import io
import zipfile

import pytest

from leafspine.operators import code, docx, epub, html, markdown, markup, pdf, prompt, render, tabular, txt
from leafspine.plans import model, reading
from leafspine.sources import containers, parse
from leafspine.sources import html as sources_html
from leafspine.streaming import ingest


def lines_of(spark, *texts):
    return txt.split_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def chapters_of(spark, text):
    return [(r.title, r.word_count, r.paragraph_count) for r in txt.chapters(txt.blocks(lines_of(spark, text))).orderBy("chapter_index").collect()]


def blocks_of(spark, text):
    return [(r.type, r.text) for r in txt.blocks(lines_of(spark, text)).orderBy("pos").collect()]


def test_txt_preamble_is_kept(spark):
    assert chapters_of(spark, "intro\n# A\nbody") == [("章节 1", 5, 1), ("A", 4, 1)]


def test_txt_dropped_lines(spark):
    assert blocks_of(spark, "**b**\n---\n#tag") == []


def test_txt_paragraph_swallows_numbers(spark):
    assert blocks_of(spark, "text\n1. one") == [("paragraph", "text 1. one")]


def test_txt_list_over_blanks(spark):
    rows = txt.blocks(lines_of(spark, "- a\n\n2. b")).collect()
    assert [(r.type, r.text, r.list_items, r.list_ordered) for r in rows] == [("list", "1. a\n1. b", ["a", "b"], True)]


def test_txt_fence(spark):
    rows = txt.blocks(lines_of(spark, "```py\n# x\n```py\n```\ny")).orderBy("pos").collect()
    assert [(r.type, r.text, r.language) for r in rows] == [("code", "# x\n```py", "py"), ("paragraph", "y", None)]


def test_txt_unclosed_fence_and_chapter_prefix(spark):
    assert blocks_of(spark, "Chapter 3 describes\n```\na\n\nb") == [("heading", "Chapter 3 describes"), ("code", "a\n\nb")]


def test_txt_quotes(spark):
    assert blocks_of(spark, "> a\n\n>b\nc") == [("quote", "a\nb"), ("paragraph", "c")]


@pytest.mark.parametrize(("text", "want"), [("intro\n# A\nbody", [("A", 5, 1)]), ("# A\n### x", [("A", 6, 1)])])
def test_markdown(spark, text, want):
    rows = markdown.chapters(markdown.blocks(lines_of(spark, text))).collect()
    assert [(r.title, r.word_count, r.paragraph_count) for r in rows] == want


def test_markdown_without_heading(spark):
    docs = spark.createDataFrame([(0, "## x\n\ny")], "doc_id long, text string")
    row = markdown.whole(docs, lines_of(spark, "## x\n\ny")).first()
    assert (row.title, row.word_count, row.paragraph_count) == ("全文", 7, 2)


def pdf_lines(spark, rows):
    full = [(0, i, 1, t, float(s), float(x), 3000.0 + 8 * i, x + 100.0, 3002.0 + 8 * i, 600.0, 10000.0) for i, (t, s, x) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, pos int, page_num int, text string, font_size double, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double")


def test_pdf_base_size_tie(spark):
    assert pdf.base_size(pdf_lines(spark, [("a", 12, 0), ("b", 10, 0), ("c", 10, 0), ("d", 12, 0)])).first().base == 12


def test_pdf_thresholds(spark):
    rows = [("body text of the document", 12, 72)] * 1 + [("ab", s, 72) for s, n in ((18, 12), (15, 45), (13.5, 8), (12.5, 120)) for _ in range(n)]
    rows += [("body text of the document", 12, 72)] * 300
    row = pdf.thresholds(pdf.with_base(pdf_lines(spark, rows))).first()
    assert (round(row.level1, 6), round(row.level2, 6)) == (round(999 / 65, 6), 13.2)


def test_pdf_same_level_heading_does_not_decide(spark):
    rows = [("序言", 20, 72), ("导言", 20, 72), ("long body text here", 12, 72), ("and more body text", 12, 72), ("and more body text", 12, 72)]
    assert [(r.title, r.level, r.paragraph_count) for r in pdf.chapters(pdf_lines(spark, rows)).orderBy("chapter_index").collect()] == [("序言", 1, 0), ("导言", 1, 3)]


@pytest.mark.parametrize(("rows", "want"), [
    ([("A", 1, False), ("B", 1, False), ("C", 2, True)], [("A - B", True), ("C", True)]),
    ([("A", 1, False), ("B", 1, False), ("C", 1, False), ("D", 3, True)], [("A - B", True), ("C - D", True)]),
    ([("A", 1, True), ("B", 1, False)], [("A", True), ("B", False)]),
])
def test_pdf_merge(spark, rows, want):
    full = [(0, i * 3, t, t, level, ind, level > 1) for i, (t, level, ind) in enumerate(rows)]
    df = spark.createDataFrame(full, "doc_id long, pos int, s string, text string, level int, independent boolean, as_body boolean")
    assert [(r.title, r.independent) for r in pdf.merge_headings(df).orderBy("pos").collect()] == want


def test_html(spark):
    page = "<html><body><p>x<h1>T</h1><p>one two three four five</p><h2></h2><p>lost</p><h2 title='U'></h2><p>六七八九</p></body></html>"
    nodes = sources_html.nodes(spark.createDataFrame([(1, "f", page)], "doc_id long, file_path string, html string"))
    assert [(r.chapter_index, r.title) for r in html.chapters(nodes).orderBy("chapter_index").collect()] == [(0, "T"), (1, "U")]
    assert html.chapters(nodes, dedup=True).count() == 2


@pytest.mark.parametrize(("text", "ok"), [("标题一二三", False), ("标题一二三四", True)])
def test_html_substance(spark, text, ok):
    df = spark.createDataFrame([(text, "标题")], "t string, h string")
    assert df.select(html.has_substance("t", "h")).first()[0] is ok


def test_epub_validate_and_ranges(spark):
    rows = [(1, 0, 5, "heading", "f", i, i, t, 1, 1) for i, t in enumerate(["第9章 x", "abc", "def"])]
    cand = spark.createDataFrame(rows, "doc_id long, prio int, confidence int, source string, file_path string, position int, enc_pos int, title string, level int, tag_level int")
    assert [r.title for r in epub.validate(cand).collect()] == ["第9章 x"]
    files = spark.createDataFrame([(1, "f", "long text")], "doc_id long, file_path string, text string")
    assert [r.title for r in epub.build(cand.filter("enc_pos < 2"), files).collect()] == ["abc"]


def test_csv_chunks(spark):
    text = "a,b\n" + "\n".join(f"{i},x" for i in range(12))
    docs = spark.createDataFrame([(1, "csv", text), (2, "csv", text + "\n")], "doc_id long, ext string, content string")
    got = {(r.doc_id, r.title, r.paragraph_count) for r in tabular.csv_chunks(parse.csv_rows(docs)).collect()}
    assert got == {(1, "数据行 1-10", 10), (1, "数据行 11-12", 2), (2, "数据行 1-10", 10), (2, "数据行 11-13", 3)}


def test_json(spark):
    assert [(t, x) for _, t, x, _ in parse.chapters_of_json('{"z": 1, "a": true, "b": null}')] == [("z", "1"), ("a", "True"), ("b", "None")]
    assert [t for _, t, _, _ in parse.chapters_of_json('{"name": "n"}\n{"x": 1}')] == ["n", "第2项"]
    assert parse.chapters_of_json("7")[0][3] == parse.chapters_of_json("{")[0][3] == "code"


def test_markup(spark):
    docs = spark.createDataFrame([(1, "<a>no <b>tags</b></a>"), (2, "<item>x<item>y</item></item>")], "doc_id long, content string")
    assert {(r.doc_id, r.chapter_index, r.title) for r in markup.xml_chapters(docs).collect()} == {(1, 1, "XML内容"), (2, 1, "ITEM: x y")}
    rtf = spark.createDataFrame([(1, r"{\rtf1\ansi }\b caf\'e9\par {x}")], "doc_id long, content string")
    assert rtf.select(markup.rtf_text("content")).first()[0] == "café x"


def test_code_comments(spark):
    got = [r.comment for r in code.slash_comments(lines_of(spark, "/* x */\ny")).collect()]
    assert got == ["x */ y"]
    assert [r.comment for r in code.hash_comments(lines_of(spark, "# a\n# ===\n# b\nx\n#c")).orderBy("pos").collect()] == ["a b", "c"]


def test_names_and_prompts(spark):
    from leafspine.functions.text import safe_filename

    df = spark.createDataFrame([("a/b:c?", "h\n---\nm\n---\nbody\n---\nrest")], "n string, c string")
    assert df.select(safe_filename("n"), prompt.body("c")).first() == ("a_b_c_", "body")
    rows = spark.createDataFrame([(1, "a", None, 1), (1, "b", "a", 2), (1, "c", "b", 3)], "doc_id int, chapter_id string, parent_id string, chapter_index int")
    assert {r.hierarchy_path for r in render.hierarchy(rows).collect()} == {"1", "1.2", "1.2.3"}


def test_docx_levels(spark):
    df = spark.createDataFrame([("Heading 3",), ("标题",), ("Normal",), (None,)], "s string")
    assert [r[0] for r in df.select(docx.style_level("s")).collect()] == [3, 1, 0, 0]


def test_decoding():
    assert parse.decode("第一章".encode("gbk")) == "第一章"
    assert parse.decode(b"\xff\xfe\xfd") == "ÿþý"
    assert parse.repair_mojibake("目录内容".encode("gbk").decode("latin-1")) == "目录内容"
    assert parse.repair_mojibake("plain") == "plain"


def word_file():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = '<w:p><w:pPr><w:pStyle w:val="H1"/><w:jc w:val="center"/></w:pPr><w:r><w:rPr><w:b/><w:sz w:val="36"/></w:rPr><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>body </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{para}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def book_file():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        items = "".join(f'<item href="{i}.xhtml" media-type="application/xhtml+xml"/>' for i in (1, 2))
        z.writestr("O/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><metadata><title xmlns="http://purl.org/dc/elements/1.1/">B</title></metadata><manifest>{items}</manifest></package>')
        for i in (1, 2):
            z.writestr(f"O/{i}.xhtml", f"<html><body><h1>Chapter {i}</h1><p>text</p></body></html>")
    return out.getvalue()


def test_reading_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = {"a.txt": "x\n# A\ny".encode(), "b.md": b"# M\nz", "c.json": b'{"k": "v"}', "d.csv": b"a,b\n1,2", "e.py": b"# c\nx", "f.docx": word_file(), "g.epub": book_file(), "h.rtf": rb"{\rtf1 }abc", "i.xml": b"<item>q</item>", "j.html": b"<body><h1>T</h1><p>a b c d e f</p></body>", "k.docx": b"broken", "l.png": b"?", "m.md": "# 第一章".encode("gbk")}
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    df = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    got = {(r.path.rsplit("/", 1)[1], r.chapter_index, r.title) for r in reading.read_chapters(df).collect()}
    assert {("a.txt", 1, "章节 1"), ("a.txt", 2, "A"), ("b.md", 1, "M"), ("m.md", 1, "全文"), ("c.json", 1, "k"), ("d.csv", 1, "表头信息"), ("d.csv", 2, "数据行 1-1"), ("e.py", 1, "代码: e.py"), ("f.docx", 1, "Title"), ("g.epub", 1, "Chapter 1"), ("g.epub", 2, "Chapter 2"), ("h.rtf", 1, "全文"), ("i.xml", 1, "ITEM: q"), ("j.html", 0, "T")} == got
    blocks = {(r.path.rsplit("/", 1)[1], r.chapter_index, r.type, r.text) for r in reading.Reading(df).blocks().collect()}
    assert {("a.txt", 2, "paragraph", "y"), ("b.md", 1, "heading", "M"), ("c.json", 1, "paragraph", "v"), ("d.csv", 2, "table", "表格数据 (1 行)"), ("d.csv", 2, "paragraph", "a=1; b=2"), ("e.py", 1, "quote", "c"), ("e.py", 1, "code", "# c\nx"), ("f.docx", 1, "paragraph", "body text"), ("g.epub", 2, "heading", "Chapter 2"), ("h.rtf", 1, "paragraph", "abc"), ("i.xml", 1, "paragraph", "q"), ("j.html", 0, "paragraph", "a b c d e f"), ("m.md", 1, "paragraph", "# 第一章")} <= blocks
    made = {r.path.rsplit("/", 1)[1]: r for r in reading.Reading(df).markdown("2025-01-01 00:00").filter("chapter_index = 1").collect()}
    assert made["f.docx"].file_name == "1_Title.md" and "body text" in made["f.docx"].markdown
    assert {r.error is None for r in containers.readable(df.filter("path like '%k.docx'"), "docx").collect()} == {False}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("# A\nbody")
    q = ingest.chapter_stream(ingest.file_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [(r.title, r.word_count) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("A", 4)]


def test_json_form(spark):
    block = '{"type": "list", "text": "t", "level": 0, "list_items": [], "page_number": 0, "language": "py"}'
    doc = '{"file_name": "f", "chapters": [{"index": 1, "title": "T", "content_blocks": [' + block + "]}]}"
    df = spark.createDataFrame([(doc,)], "j string").select(model.from_json("j").alias("d"))
    text = df.select(model.to_json("d")).first()[0]
    assert '"language":"py"' in text and "page_number" not in text and "list_items" not in text


def test_files_are_written(spark, tmp_path):
    chapters = spark.createDataFrame([(7, 1, "A/b", 1, "text", None)], "doc_id long, chapter_index int, title string, level int, body string, hierarchy_path string")
    out = render.write_markdown(render.render(chapters, "2025-01-01 00:00"), str(tmp_path)).collect()
    assert out[0].file.endswith("7/1_A_b.md") and "text" in open(out[0].file, encoding="utf-8").read()
