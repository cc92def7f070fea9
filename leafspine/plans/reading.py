"""Reading files: the rows of the binaryFile source (path, content, length) to chapters and blocks, each format by its
operators.

Files are split by reader once; each branch is a plan of its own and all are united. What needs a native parser enters as
a relation beside the files: ``spans`` of laid-out pages (path and what ``operators.pdf.lines_from_spans`` asks for, with
page_width and page_height) and ``recognised`` lines (path and what ``operators.ocr.recognised`` asks for). Without spans a
laid-out file has no chapters; one with fewer than LEAST_WORDS words takes what was recognised, if that is given.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import code, dispatch, docx, epub, html, markdown, markup, ocr, pdf, render, tabular, txt
from ..sources import containers, parse
from ..sources import html as sources_html

Parts = list[DataFrame]
#: Fixed value: the words below which a laid-out file is taken for images.
LEAST_WORDS = 1000


def _chapters(df: DataFrame) -> DataFrame:
    path = "path" if "path" in df.columns else "doc_id"
    return df.select(F.col(path).cast("string").alias("path"), F.col("chapter_index").cast("int").alias("chapter_index"), "title", F.col("word_count").cast("long").alias("word_count"))


def _blocks(df: DataFrame) -> DataFrame:
    path = "path" if "path" in df.columns else "doc_id"
    level = F.col("level").cast("int") if "level" in df.columns else F.lit(0)
    pos = F.col("pos").cast("int") if "pos" in df.columns else F.lit(0)
    kind = F.col("type") if "type" in df.columns else F.lit("paragraph")
    return df.select(F.col(path).cast("string").alias("path"), F.col("chapter_index").cast("int").alias("chapter_index"), pos.alias("pos"), kind.alias("type"), "text", level.alias("level"))


class Reading:
    """The plans for a set of files; nothing runs before a result is asked for."""

    def __init__(self, files: DataFrame, spans: DataFrame | None = None, recognised: DataFrame | None = None, readers: Iterable[str] | None = None):
        """readers: the names of those that the files need (``dispatch.READERS``), so that no others are planned."""
        self.spans, self.recognised, self.readers = spans, recognised, None if readers is None else set(readers)
        self.files = files.withColumns({"reader": dispatch.reader("path"), "ext": dispatch.extension("path")})

    def _texts(self, name: str, encodings=parse.UTF8_FIRST, lenient: bool = False) -> DataFrame:
        return parse.decoded(self.files.filter(F.col("reader") == name), encodings, lenient).filter("text is not null")

    def _txt(self) -> tuple[Parts, Parts]:
        b = txt.blocks(txt.split_lines(self._texts("txt"), "text", "path"))
        return [txt.chapters(b)], [txt.chapter_blocks(b)]

    def _markdown(self) -> tuple[Parts, Parts]:
        """A file that is no UTF-8 isn't looked into: it is one chapter."""
        md = self._texts("markdown")
        lines = txt.split_lines(md.filter("encoding = 'utf-8'"), "text", "path")
        b = markdown.blocks(lines)
        rest = markdown.whole(md.select(F.col("path").alias("doc_id"), "text"), lines)
        whole = rest.select("doc_id", "chapter_index").join(md.select(F.col("path").alias("doc_id"), "text"), "doc_id")
        return [markdown.chapters(b), rest], [b.filter("seg >= 1").withColumnRenamed("seg", "chapter_index"), whole]

    def _html(self) -> tuple[Parts, Parts]:
        pages = self._texts("html", ("utf-8",))
        nodes = sources_html.nodes(pages.select(F.col("path").alias("doc_id"), F.col("path").alias("file_path"), html.without_scripts("text").alias("html")))
        chapters = html.chapter_segments(nodes)
        return [chapters], [html.blocks(nodes).join(chapters.select("doc_id", "seg", "chapter_index"), ["doc_id", "seg"])]

    def _json(self) -> tuple[Parts, Parts]:
        chapters = parse.json_chapters(self._texts("json").select(F.col("path").alias("doc_id"), F.col("text").alias("content")))
        return [chapters], [chapters]

    def _csv(self) -> tuple[Parts, Parts]:
        rows = parse.csv_rows(self._texts("csv").select(F.col("path").alias("doc_id"), dispatch.extension("path").alias("ext"), F.col("text").alias("content")))
        head, chunks = tabular.csv_header(rows), tabular.csv_chunks(rows)
        captions = chunks.select("doc_id", "chapter_index", F.lit(0).alias("pos"), F.lit("table").alias("type"), F.col("caption").alias("text"))
        return [head, chunks], [head, captions, chunks.withColumn("pos", F.lit(1))]

    def _markup(self) -> tuple[Parts, Parts]:
        xml = markup.xml_chapters(self._texts("xml").select(F.col("path").alias("doc_id"), F.col("text").alias("content")))
        source = self._texts("rtf", ("utf-8",), True).select(F.col("path").alias("doc_id"), F.col("text").alias("content"))
        rtf = markup.rtf_chapters(source)
        lines = source.select("doc_id", markup.rtf_text("content").alias("text"))
        return [xml, rtf], [xml, rtf.filter("paragraph_count > 0").select("doc_id", "chapter_index").join(lines, "doc_id")]

    def _code(self) -> tuple[Parts, Parts]:
        source = self._texts("code", parse.CODE_ENCODINGS)
        source = source.select(F.col("path").alias("doc_id"), dispatch.file_name("path").alias("name"), dispatch.extension("path").alias("ext"), F.col("text").alias("content"))
        docs = code.code_documents(source).withColumn("chapter_index", F.lit(1))
        lines = source.select("doc_id", "ext", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line"))
        quotes = code.comments(lines).select("doc_id", F.lit(1).alias("chapter_index"), (F.col("pos") + 1).alias("pos"), F.lit("quote").alias("type"), F.col("comment").alias("text"))
        info = docs.select("doc_id", "chapter_index", F.lit(0).alias("pos"), F.col("info").alias("text"))
        full = source.select("doc_id", F.lit(1).alias("chapter_index"), F.lit(2**31 - 1).alias("pos"), F.lit("code").alias("type"), F.col("content").alias("text"))
        return [docs], [info, quotes, full]

    def _docx(self) -> tuple[Parts, Parts]:
        s = docx.classify(docx.paragraphs_from_runs(containers.word_runs(self.files.filter("reader = 'docx'"))))
        return [docx.chapters(s)], [docx.chapter_blocks(s)]

    def _epub(self) -> tuple[Parts, Parts]:
        books = containers.book_files(self.files.filter("reader = 'epub'"))
        nodes = sources_html.nodes(books.select(F.col("path").alias("doc_id"), "file_path", "html"))
        plain = epub.plain_texts(nodes)
        built = epub.build_ranges(epub.cascade(nodes, plain), plain)
        return [built], [epub.chapter_blocks(built, nodes, plain)]

    def _pdf(self) -> tuple[Parts, Parts]:
        paths = self.files.filter("reader = 'pdf'").select(F.col("path").alias("doc_id"))
        made: tuple[Parts, Parts] = ([], [])
        if self.spans is not None:
            lines = pdf.lines_from_spans(self.spans.withColumnRenamed("path", "doc_id").join(paths, "doc_id", "left_semi"))
            matched = pdf.contents(lines)
            made = [pdf.document_chapters(lines, matched)], [pdf.document_blocks(lines, matched)]
        if self.recognised is not None:
            total = made[0][0].groupBy("doc_id").agg(F.sum("word_count").alias("n")) if made[0] else paths.select("doc_id", F.lit(0).alias("n"))
            thin = paths.join(total, "doc_id", "left").filter(F.coalesce("n", F.lit(0)) < LEAST_WORDS).select("doc_id")
            seen = ocr.recognised(self.recognised.withColumnRenamed("path", "doc_id").join(thin, "doc_id", "left_semi")).withColumn("confidence", F.lit(1.0))
            b = ocr.blocks(seen)
            made = tuple([p.join(thin, "doc_id", "left_anti") for p in parts] + [own] for parts, own in zip(made, (ocr.chapters(b), ocr.chapter_blocks(b)), strict=True))
        return made

    def _all(self) -> list[tuple[Parts, Parts]]:
        branches = {
            "txt": self._txt, "markdown": self._markdown, "html": self._html, "json": self._json, "csv": self._csv, "xml rtf": self._markup, "code": self._code, "docx": self._docx,
            "epub": self._epub, "pdf": self._pdf,
        }
        return [branch() for names, branch in branches.items() if self.readers is None or self.readers & set(names.split())]

    def chapters(self) -> DataFrame:
        """path, chapter_index, title, word_count of every file that has a reader and text."""
        return reduce(DataFrame.unionByName, [_chapters(c) for cs, _ in self._all() for c in cs])

    def blocks(self) -> DataFrame:
        """path, chapter_index, pos, type, text, level of what the chapters hold."""
        return reduce(DataFrame.unionByName, [_blocks(b) for _, bs in self._all() for b in bs])

    def markdown(self, made_at: str, footer: str = "") -> DataFrame:
        """path, chapter_index, title, file_name, markdown, display_count: a Markdown file for each chapter."""
        bodies = render.bodies(self.blocks().withColumnRenamed("path", "doc_id"))
        chapters = self.chapters().select(F.col("path").alias("doc_id"), "chapter_index", "title", F.lit(1).alias("level"), F.lit(None).cast("string").alias("hierarchy_path"))
        made = render.render(chapters.join(bodies, ["doc_id", "chapter_index"], "left"), made_at, footer)
        return made.select(F.col("doc_id").alias("path"), "chapter_index", "title", "file_name", "markdown", "display_count")


def read_chapters(files: DataFrame) -> DataFrame:
    return Reading(files).chapters()
