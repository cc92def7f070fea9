"""The registered queries: each applies an operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import code, dispatch, docx, epub, html, markdown, markup, ocr, pdf, prompt, render, tabular, txt
from ..sources import html as sources_html
from ..sources import parse
from .fixtures import (
    BOOK, BOOK_HEAD, CLASS, CODE_C, CODE_HASH, DOCX_COLUMNS, DOCX_HEAD, EXT, EXTENSION_LIST, FONT_HEAD, FONT_STYLE, MD, NAME, OCR_COLUMNS, OCR_HEAD, PDF_HEAD, PROMPT_CONTENT,
    RTF_HEAD, RTF_PIECE, STYLE, TAGS, TXT, XML_PIECE, doc_lines, headed, marked, pdf_lines, table, toc_lines, with_columns,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(doc_lines(spark, sf_dir), TXT)


@query
def txt_fence_state(spark, sf_dir):
    return txt.fence_state(_txt(spark, sf_dir)).select("doc_id", "pos", "before", "after")


@query
def txt_line_class(spark, sf_dir):
    return txt.classify_lines(_txt(spark, sf_dir)).select("doc_id", "pos", "s", "cls")


@query
def txt_blocks(spark, sf_dir):
    return txt.blocks(_txt(spark, sf_dir)).select("doc_id", "pos", "type", "text", "level", "language")


@query
def txt_lists(spark, sf_dir):
    return txt.blocks(_txt(spark, sf_dir)).filter("type = 'list'").select("doc_id", "pos", "text", "list_ordered", F.size("list_items").alias("n_items"))


@query
def txt_quotes(spark, sf_dir):
    return txt.blocks(_txt(spark, sf_dir)).filter("type = 'quote'").select("doc_id", "pos", "text")


@query
def txt_paragraphs(spark, sf_dir):
    return txt.blocks(_txt(spark, sf_dir)).filter("type = 'paragraph'").select("doc_id", "pos", "text")


@query
def txt_chapters(spark, sf_dir):
    return txt.chapters(txt.blocks(_txt(spark, sf_dir)))


@query
def txt_doc_totals(spark, sf_dir):
    return txt.doc_totals(txt.chapters(txt.blocks(_txt(spark, sf_dir))))


# Markdown


def _md(spark, sf_dir):
    """Every seventh document stays without a chapter heading."""
    lines = doc_lines(spark, sf_dir)
    return marked(lines.filter("doc_id % 7 <> 0"), MD).unionByName(lines.filter("doc_id % 7 = 0"))


@query
def md_blocks(spark, sf_dir):
    return markdown.blocks(_md(spark, sf_dir))


@query
def md_chapters(spark, sf_dir):
    return markdown.chapters(markdown.blocks(_md(spark, sf_dir)))


@query
def md_whole(spark, sf_dir):
    return markdown.whole(table(spark, sf_dir, "documents").select("doc_id", "text"), _md(spark, sf_dir))


# CSV, JSON


def _csv(spark, sf_dir):
    """A file of parts for each size; the second name column is repeated and every thirteenth row is short."""
    from pyspark.sql import Window

    part = table(spark, sf_dir, "part")
    n = F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey"))
    cells = F.array(F.col("p_partkey").cast("string"), "p_name", "p_brand", "p_type")
    rows = part.select(F.col("p_size").cast("long").alias("doc_id"), n.alias("row_no"), F.when(F.col("p_partkey") % 13 == 0, F.slice(cells, 1, 2)).when(F.col("p_partkey") % 29 == 0, F.array().cast("array<string>")).otherwise(cells).alias("cells"))
    head = part.select(F.col("p_size").cast("long").alias("doc_id")).distinct().select("doc_id", F.lit(0).alias("row_no"), F.array(F.lit("key"), F.lit("name"), F.lit("brand"), F.lit("name")).alias("cells"))
    return rows.unionByName(head)


@query
def csv_header(spark, sf_dir):
    return tabular.csv_header(_csv(spark, sf_dir))


@query
def csv_chunks(spark, sf_dir):
    return tabular.csv_chunks(_csv(spark, sf_dir))


@query
def json_keys(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "props")
    return tabular.json_object_chapters(events, "props")


@query
def json_chapters(spark, sf_dir):
    """Objects, arrays, JSON lines and broken JSON made from nations and regions."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    obj = F.concat(F.lit('{"name": "'), "n_name", F.lit('", "ok": true, "none": null, "tags": ["a", '), F.col("n_nationkey").cast("string"), F.lit('], "deep": {"x": 1.5, "y": "z"}}'))
    one = nation.select(F.col("n_nationkey").cast("long").alias("doc_id"), obj.alias("content"))
    arr = F.concat(F.lit('[{"title": "'), "r_name", F.lit('"}, {"a": 1}, 7]'))
    two = region.select((F.col("r_regionkey") + 100).cast("long").alias("doc_id"), arr.alias("content"))
    jsonl = F.concat(F.lit('{"topic": "'), "r_name", F.lit('"}\n{"b": '), F.col("r_regionkey").cast("string"), F.lit("}"))
    three = region.select((F.col("r_regionkey") + 200).cast("long").alias("doc_id"), jsonl.alias("content"))
    four = region.select((F.col("r_regionkey") + 300).cast("long").alias("doc_id"), F.concat(F.lit("{broken "), "r_name").alias("content"))
    return parse.json_chapters(one.unionByName(two).unionByName(three).unionByName(four))


# XML, RTF


def _glued(lines, piece, before, after):
    from .segment import joined

    return lines.withColumn("piece", F.expr(piece)).groupBy("doc_id").agg(F.concat(F.lit(before), joined(F.col("piece"), "\n"), F.lit(after)).alias("content"))


@query
def xml_tags(spark, sf_dir):
    return markup.xml_chapters(_glued(doc_lines(spark, sf_dir), XML_PIECE, '<?xml version="1.0"?>', ""))


@query
def rtf_strip(spark, sf_dir):
    return _glued(doc_lines(spark, sf_dir), RTF_PIECE, RTF_HEAD, "}").select("doc_id", markup.rtf_text("content").alias("text"))


@query
def rtf_chapters(spark, sf_dir):
    return markup.rtf_chapters(_glued(doc_lines(spark, sf_dir), RTF_PIECE, RTF_HEAD, "}"))


# Source code


@query
def code_comments_hash(spark, sf_dir):
    return code.hash_comments(marked(doc_lines(spark, sf_dir), CODE_HASH))


@query
def code_comments_c(spark, sf_dir):
    return code.slash_comments(marked(doc_lines(spark, sf_dir), CODE_C))


@query
def code_comments_markup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return code.markup_comments(txt.split_lines(pages, "html", "page_id"))


@query
def code_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(f"concat('f', doc_id, '.', {EXT})").alias("name"), F.expr(EXT).alias("ext"), F.col("text").alias("content"))
    return code.code_documents(docs)


# Laid-out lines


def _pdf(spark, sf_dir):
    return pdf_lines(headed(doc_lines(spark, sf_dir), PDF_HEAD))


@query
def pdf_base_size(spark, sf_dir):
    return pdf.base_size(_pdf(spark, sf_dir))


@query
def pdf_candidates(spark, sf_dir):
    return pdf.candidates(pdf.with_base(_pdf(spark, sf_dir))).select("doc_id", "pos", "text", F.round("ratio", 6).alias("ratio"))


@query
def pdf_thresholds(spark, sf_dir):
    return pdf.thresholds(pdf.with_base(_pdf(spark, sf_dir))).select("doc_id", F.round("level1", 6).alias("level1"), F.round("level2", 6).alias("level2"))


@query
def pdf_body_x0(spark, sf_dir):
    return pdf.with_base(_pdf(spark, sf_dir)).select("doc_id", "pos", pdf.body_x0().alias("body_x0"))


@query
def pdf_header_footer(spark, sf_dir):
    return pdf.measured(_pdf(spark, sf_dir)).select("doc_id", "pos", "margin", "label", "note", pdf.is_imprint(F.col("s")).alias("imprint"), "loose", "apart")


@query
def pdf_classify(spark, sf_dir):
    return pdf.classify(pdf.with_base(_pdf(spark, sf_dir))).select("doc_id", "pos", "level", "as_body")


@query
def pdf_independence(spark, sf_dir):
    return pdf.independence(pdf.classify(pdf.with_base(_pdf(spark, sf_dir)))).filter("level > 0").select("doc_id", "pos", "level", "independent")


@query
def pdf_merge(spark, sf_dir):
    return pdf.merge_headings(pdf.independence(pdf.classify(pdf.with_base(_pdf(spark, sf_dir)))))


@query
def pdf_notes(spark, sf_dir):
    return pdf.in_notes(pdf.with_base(_pdf(spark, sf_dir))).select("doc_id", "pos", "in_note")


@query
def pdf_chapters(spark, sf_dir):
    return pdf.chapters(_pdf(spark, sf_dir))


@query
def pdf_lines_from_spans(spark, sf_dir):
    """Words of every line as spans."""
    words = doc_lines(spark, sf_dir).select("doc_id", "pos", F.posexplode(F.split("line", " ", -1)).alias("span_no", "text"))
    spans = words.select(
        "doc_id", F.floor(F.col("pos") / 20).cast("int").alias("page_num"), F.lit(0).alias("block_no"), F.col("pos").alias("line_no"), "span_no", "text", (F.lit(10.0) + F.col("span_no") % 4).alias("size"),
        F.concat(F.lit("f"), (F.col("span_no") % 3).cast("string")).alias("font"), (F.col("span_no") * 10.0).alias("x0"), F.lit(5.0).alias("y0"), (F.col("span_no") * 10.0 + F.length("text")).alias("x1"), (F.lit(20.0) + F.col("span_no") % 2).alias("y1"),
    )
    return pdf.lines_from_spans(spans).select("doc_id", "pos", "text", F.round("font_size", 6).alias("font_size"), "font_name", "x0", "x1", "y1", "ends_with_period")


def _toc(spark, sf_dir):
    return toc_lines(doc_lines(spark, sf_dir))


@query
def pdf_toc(spark, sf_dir):
    return pdf.toc(_toc(spark, sf_dir)).drop("from_page")


@query
def pdf_toc_match(spark, sf_dir):
    lines = _toc(spark, sf_dir)
    return pdf.toc_match(lines, pdf.toc(lines)).select("doc_id", "toc_pos", "title", "type", "index")


@query
def pdf_toc_chapters(spark, sf_dir):
    lines = _toc(spark, sf_dir)
    return pdf.toc_chapters(lines, pdf.toc_match(lines, pdf.toc(lines)))


@query
def pdf_document_chapters(spark, sf_dir):
    """By contents pages where they are found, by sizes elsewhere."""
    return pdf.document_chapters(_toc(spark, sf_dir))


# Word paragraphs


def _docx(spark, sf_dir):
    return with_columns(headed(doc_lines(spark, sf_dir).filter("line <> ''"), DOCX_HEAD), DOCX_COLUMNS)


@query
def docx_style_level(spark, sf_dir):
    return _docx(spark, sf_dir).select("doc_id", "pos", docx.style_level("style_name").alias("style_level"))


@query
def docx_stats(spark, sf_dir):
    return docx.font_stats(_docx(spark, sf_dir)).withColumn("mean_size", F.round("mean_size", 6))


@query
def docx_classify(spark, sf_dir):
    return docx.classify(_docx(spark, sf_dir)).select("doc_id", "pos", "is_chapter_title", "subheading_level")


@query
def docx_chapters(spark, sf_dir):
    return docx.chapters(docx.classify(_docx(spark, sf_dir)))


@query
def docx_totals(spark, sf_dir):
    return docx.doc_words(_docx(spark, sf_dir))


@query
def docx_paragraphs(spark, sf_dir):
    """Words of every line as runs."""
    runs = doc_lines(spark, sf_dir).select("doc_id", "pos", F.posexplode(F.split("line", " ", -1)).alias("run_no", "w"))
    runs = runs.select(
        "doc_id", "pos", "run_no", F.concat("w", F.lit(" ")).alias("text"), F.when(F.col("run_no") % 3 > 0, 10.0 + F.col("run_no") % 4).alias("size"), (F.col("run_no") == 4).alias("bold"), F.lit(None).cast("boolean").alias("italic"),
        F.when(F.col("run_no") % 2 == 0, F.concat(F.lit("f"), F.col("run_no").cast("string"))).alias("font"), F.lit("Normal").alias("style_name"), F.when(F.col("pos") % 2 == 0, "center").alias("alignment"),
    )
    return docx.paragraphs_from_runs(runs).select("doc_id", "pos", "text", F.round("font_size", 6).alias("font_size"), "is_bold", "is_italic", "font_name", "alignment", "is_centered")


# Recognised lines


def _ocr(spark, sf_dir):
    return with_columns(headed(doc_lines(spark, sf_dir), OCR_HEAD), OCR_COLUMNS)


@query
def ocr_filter(spark, sf_dir):
    return ocr.confident(_ocr(spark, sf_dir)).select("doc_id", "pos", "text")


@query
def ocr_classify(spark, sf_dir):
    return ocr.blocks(_ocr(spark, sf_dir)).select("doc_id", "pos", "type", "level")


@query
def ocr_chapters(spark, sf_dir):
    return ocr.chapters(ocr.blocks(_ocr(spark, sf_dir)))


@query
def ocr_results(spark, sf_dir):
    """Boxes as the recogniser gives them, two pages a document."""
    rows = _ocr(spark, sf_dir).withColumn("page_num", F.when(F.col("pos") < 3, 0).otherwise(1))
    corner = lambda x, y: F.array((F.col("pos") * 10.0) + x, F.lit(100.0) + y)
    line = F.struct(F.array(corner(0, 0), corner(9, 0), corner(9, 5), corner(0, 5)).alias("corners"), "text", "confidence")
    results = rows.groupBy("doc_id", "page_num").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda s: s["l"]).alias("lines"))
    return ocr.recognised(results)


# Rendering, prompts, dispatch


@query
def render_markdown(spark, sf_dir):
    """Each plain-text document as one chapter file, its first line as the title."""
    b = txt.blocks(_txt(spark, sf_dir)).withColumn("chapter_index", F.col("doc_id").cast("int") % 5 + 1)
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id").cast("int") % 5 + 1).alias("chapter_index"), F.get(F.split("text", "\n", -1), F.lit(0)).alias("title"), (F.col("doc_id").cast("int") % 4 + 1).alias("level"), F.when(F.col("doc_id") % 2 == 0, "2.1").alias("hierarchy_path"))
    rows = docs.join(render.bodies(b), ["doc_id", "chapter_index"], "left")
    return render.render(rows, "2025-01-01 00:00", "*leafspine*").select("doc_id", "markdown", "word_count", "display_count", "file_name")


@query
def safe_filename(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(NAME).alias("name"))
    return docs.select("doc_id", text.safe_filename("name").alias("file_name"))


@query
def hierarchy_path(spark, sf_dir):
    """Nations under regions, suppliers under nations."""
    region = table(spark, sf_dir, "region").select(F.lit(1).alias("doc_id"), F.concat(F.lit("r"), "r_regionkey").alias("chapter_id"), F.lit(None).cast("string").alias("parent_id"), (F.col("r_regionkey") + 1).alias("chapter_index"))
    nation = table(spark, sf_dir, "nation").select(F.lit(1).alias("doc_id"), F.concat(F.lit("n"), "n_nationkey").alias("chapter_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), (F.col("n_nationkey") + 1).alias("chapter_index"))
    supplier = table(spark, sf_dir, "supplier").select(F.lit(1).alias("doc_id"), F.concat(F.lit("s"), "s_suppkey").alias("chapter_id"), F.concat(F.lit("n"), "s_nationkey").alias("parent_id"), F.col("s_suppkey").cast("int").alias("chapter_index"))
    return render.hierarchy(region.unionByName(nation).unionByName(supplier)).select("chapter_id", "hierarchy_path")


def _prompt_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("_"), "source").alias("folder"), F.expr(PROMPT_CONTENT).alias("content"))


@query
def prompt_folders(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = F.array(F.lit("0_x.md"), F.lit("AI.md"), F.lit("b.txt"), F.concat(F.col("lang"), F.lit(".md")), F.concat("source", F.lit(".md")))
    folder = F.when(F.col("doc_id") % 7 == 0, F.col("source")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit("_"), "source"))
    return prompt.chapter_files(docs.select(folder.alias("folder"), F.explode(names).alias("file_name")))


@query
def prompt_body(spark, sf_dir):
    return _prompt_files(spark, sf_dir).select("folder", prompt.body("content").alias("body"), prompt.title("content", "folder").alias("title"), text.cjk_count(prompt.body("content")).alias("n_cjk"))


@query
def prompt_headers(spark, sf_dir):
    files = _prompt_files(spark, sf_dir).withColumn("body", prompt.body("content"))
    return prompt.headers(files)


@query
def prompt_outline(spark, sf_dir):
    files = _prompt_files(spark, sf_dir).withColumn("body", prompt.body("content"))
    return prompt.outlines(files)


@query
def prompt_files(spark, sf_dir):
    return prompt.prompts(_prompt_files(spark, sf_dir))


@query
def route_format(spark, sf_dir):
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSION_LIST]), (F.col("doc_id") % len(EXTENSION_LIST)).cast("int"))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("/in/"), "source", F.lit("/f.x"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.col("n_chars").alias("length"))
    return dispatch.file_info(files)


@query
def ocr_fallback(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "pdf").otherwise("txt").alias("file_format"), F.col("n_chars").alias("total_words"), F.col("lang").alias("title"))
    seen = docs.filter("doc_id % 3 <> 0").select("doc_id", (F.col("total_words") * 2).alias("total_words"), F.concat(F.lit("ocr "), "title").alias("title"))
    return dispatch.with_ocr_fallback(docs, seen)


@query
def supported_formats(spark, sf_dir):
    return dispatch.supported_formats(spark)


# HTML


def _page_nodes(spark, sf_dir):
    return sources_html.nodes(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("file_path"), "html"))


@query
def html_nodes(spark, sf_dir):
    return _page_nodes(spark, sf_dir).drop("lines")


@query
def html_chapters(spark, sf_dir):
    return html.chapters(_page_nodes(spark, sf_dir))


@query
def html_blocks(spark, sf_dir):
    return html.blocks(_page_nodes(spark, sf_dir))


@query
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.doc_title("html").alias("title"), F.length(html.without_scripts("html")).alias("n_chars"))


@query
def html_word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.mixed_word_count(F.concat("text", F.lit("中文"))).alias("word_count"))


@query
def html_substance(spark, sf_dir):
    first = F.get(F.split("text", "\n", -1), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", html.has_substance("text", first).alias("substance"))


@query
def html_block_types(spark, sf_dir):
    """Tags by the lengths of the texts."""
    tag = F.get(F.array(*map(F.lit, TAGS)), F.length("text") % len(TAGS))
    return table(spark, sf_dir, "documents").select("doc_id", html.block_type(tag).alias("type"))


@query
def html_style(spark, sf_dir):
    """Whole texts in the attributes."""
    tag = F.when(F.col("doc_id") % 5 == 0, "b").when(F.col("doc_id") % 5 == 1, "em").otherwise("p")
    nodes = table(spark, sf_dir, "documents").select("doc_id", tag.alias("tag"), F.expr(STYLE).alias("attr_style"), F.expr(CLASS).alias("attr_class"))
    return html.style(nodes).select("doc_id", "bold", "italic", "alignment")


# Books


def _book_nodes(spark, sf_dir):
    return sources_html.nodes(_book_files(spark, sf_dir))


def _book_files(spark, sf_dir):
    """Twenty pages a book, so that books grow in number and not in size. Class names as books have them."""
    return table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 20).alias("doc_id"), F.concat(F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit(".html")).alias("file_path"), F.replace("html", F.lit("<p>"), F.lit('<p class="Chapter_title">')).alias("html"))


@query
def epub_headings(spark, sf_dir):
    return epub.by_headings(_book_nodes(spark, sf_dir))


@query
def epub_classes(spark, sf_dir):
    return epub.by_class(_book_nodes(spark, sf_dir))


@query
def epub_font_size(spark, sf_dir):
    """Sizes in all units, on whole lines and headings."""
    lines = headed(doc_lines(spark, sf_dir), FONT_HEAD)
    nodes = lines.select("doc_id", F.lit("f").alias("file_path"), "pos", F.lit("p").alias("tag"), F.expr(FONT_STYLE).alias("attr_style"), F.col("line").alias("text"))
    return epub.by_font_size(nodes)


@query
def epub_paragraph_score(spark, sf_dir):
    return epub.paragraph_scores(_book_nodes(spark, sf_dir)).select("doc_id", "file_path", "pos", "text", "score")


@query
def epub_file_structure(spark, sf_dir):
    return epub.by_file_structure(_book_nodes(spark, sf_dir)).withColumn("number", epub.chapter_number(F.col("file_path")))


@query
def epub_pattern(spark, sf_dir):
    from .segment import joined

    lines = marked(doc_lines(spark, sf_dir), BOOK)
    texts = lines.groupBy("doc_id").agg(joined(F.col("line"), "\n").alias("text")).withColumn("file_path", F.lit("f"))
    return epub.by_pattern(texts).select("doc_id", F.shiftright("enc_pos", epub.SHIFT).cast("int").alias("pattern"), (F.col("enc_pos") % (1 << epub.SHIFT)).cast("int").alias("nth"), "position", "title", "level")


@query
def epub_stopwords(spark, sf_dir):
    return headed(doc_lines(spark, sf_dir), BOOK_HEAD).withColumnRenamed("line", "title").select("doc_id", "pos", epub.is_stop(F.col("title")).alias("stop"), text.title_ok("title", epub.STOP).alias("ok"))


def _candidates(spark, sf_dir):
    rows = with_columns(headed(doc_lines(spark, sf_dir), BOOK_HEAD), [("title", "line"), ("prio", "cast(pos % 3 as int)"), ("tag_level", "cast(pos % 4 as int)"), ("file_path", "concat('f', pos % 2)")])
    return rows.select("doc_id", "prio", (5 - F.col("prio")).alias("confidence"), F.concat(F.lit("way"), F.col("prio").cast("string")).alias("source"), "file_path", (F.col("pos") % 7).alias("position"), F.col("pos").alias("enc_pos"), "title", F.lit(1).alias("level"), "tag_level")


@query
def epub_validate(spark, sf_dir):
    return epub.validate(_candidates(spark, sf_dir)).select("doc_id", "prio", "enc_pos", "title")


@query
def epub_choose(spark, sf_dir):
    return epub.choose(epub.validate(_candidates(spark, sf_dir)))


def _book_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 50).alias("doc_id"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("file_path"), "text")


def _book_chapters(spark, sf_dir):
    starts = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0")
    two = starts.withColumn("position", F.explode(F.array(F.lit(0), F.lit(5))))
    return two.filter("position = 0 or doc_id % 2 = 0").select(F.floor(F.col("doc_id") / 50).alias("doc_id"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("file_path"), "position", F.lit(0).alias("enc_pos"), F.concat(F.lit("c"), F.col("position").cast("string"), "lang").alias("title"), F.lit(1).alias("level"))


@query
def epub_content_range(spark, sf_dir):
    return epub.content_ranges(_book_chapters(spark, sf_dir), _book_texts(spark, sf_dir)).select("doc_id", "file_path", "position", "file_idx", "until")


@query
def epub_build(spark, sf_dir):
    return epub.build(_book_chapters(spark, sf_dir), _book_texts(spark, sf_dir))


@query
def epub_blocks(spark, sf_dir):
    return epub.blocks(_book_nodes(spark, sf_dir))


@query
def epub_cascade(spark, sf_dir):
    nodes, files = _book_nodes(spark, sf_dir), _book_files(spark, sf_dir)
    return epub.cascade(nodes, epub.plain_texts(nodes), files.select("doc_id", "file_path"))


@query
def epub_mojibake_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.mojibake_ratio("text"), 9).alias("ratio"))
