"""The data model as schemas, and its JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_TYPES = ["title", "heading", "paragraph", "list", "code", "quote", "table", "image", "formula", "footnote", "page_break"]
MODULE_TYPES = ["definition", "case", "argument", "quote", "conclusion", "unknown"]
STYLE = "struct<bold:boolean,italic:boolean,underline:boolean,font_size:double,font_name:string,color:string,alignment:string>"
BLOCK = f"struct<type:string,text:string,level:int,style:{STYLE},module_type:string,list_items:array<string>,list_ordered:boolean,language:string,table_data:array<array<string>>,image_path:string,image_caption:string,page_number:int,bbox:array<double>>"
CHAPTER = f"struct<index:int,title:string,level:int,content_blocks:array<{BLOCK}>,word_count:bigint,paragraph_count:bigint>"
DOCUMENT = f"struct<file_path:string,file_name:string,file_format:string,title:string,author:string,publisher:string,publish_date:string,isbn:string,language:string,total_pages:int,total_words:bigint,total_chapters:int,chapters:array<{CHAPTER}>>"
#: Optional fields of a block; they are written only if they hold something (0, false and '' are nothing).
OPTIONAL = ["module_type", "list_items", "list_ordered", "language", "table_data", "image_path", "image_caption", "page_number", "bbox"]


def _something(c: Column, name: str) -> Column:
    if name in ("list_items", "table_data", "bbox"):
        return F.when(F.size(c) > 0, c)
    if name == "list_ordered":
        return F.when(c, c)
    return F.when(c != (F.lit(0) if name == "page_number" else F.lit("")), c)


def to_json(document: str | Column) -> Column:
    """A document struct as JSON; metadata and raw content aren't part of it."""
    d = F.col(document) if isinstance(document, str) else document

    def block(b: Column) -> Column:
        for name in OPTIONAL:
            b = b.withField(name, _something(b[name], name))
        return b

    chapters = F.transform(d["chapters"], lambda c: c.withField("content_blocks", F.transform(c["content_blocks"], block)))
    return F.to_json(d.withField("chapters", chapters))


def from_json(text: str | Column) -> Column:
    return F.from_json(text, DOCUMENT)


def assemble(blocks: DataFrame, chapters: DataFrame) -> DataFrame:
    """doc_id and ``chapters`` (array of structs) from blocks (doc_id, chapter_index, pos, type, text, level) and
    chapters (doc_id, chapter_index, title, level, word_count, paragraph_count)."""
    own = blocks.groupBy("doc_id", "chapter_index").agg(F.array_sort(F.collect_list(F.struct("pos", "type", "text", "level"))).alias("b"))
    full = chapters.join(own, ["doc_id", "chapter_index"], "left")
    made = F.struct(F.col("chapter_index").alias("index"), "title", "level", F.coalesce(F.transform("b", lambda x: F.struct(x["type"].alias("type"), x["text"].alias("text"), x["level"].alias("level"))), F.array()).alias("content_blocks"), "word_count", "paragraph_count")
    return full.groupBy("doc_id").agg(F.array_sort(F.collect_list(made)).alias("chapters"))
