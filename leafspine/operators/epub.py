"""Books of several HTML files: six ways to find headings, the first that works is taken.

nodes are ``sources.html.nodes`` of (doc_id, file_path, html); candidates are (doc_id, prio, confidence, source,
file_path, position, enc_pos, title, level, tag_level).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import SPACE, TITLE_END, title_ok
from ..plans.segment import joined

#: Words that no chapter's title holds.
STOP_WORDS = [
    "版权", "目录", "contents", "赞誉", "推荐序", "译者序", "前言", "序言", "致谢", "简介", "介绍",
    "导言", "引言", "后记", "附录", "参考文献", "索引", "关于作者", "关于本书", "献词", "扉页", "封面",
]
STOP = "|".join(STOP_WORDS)
#: Class names of titles.
CLASS_PATTERNS = [
    "chapter[_-]?title", "chapter[_-]?name", "chaptitle", "title[_-]?1", "title[_-]?2", "head[_-]?1", "head[_-]?2",
    "part[_-]?title", "section[_-]?title", "book[_-]?title", "h1", "h2", "chapter",
]
_DIGITS = "一二三四五六七八九十百千0-9"
#: Patterns of heading lines with their kind and level.
TEXT_PATTERNS = [
    (rf"第[{_DIGITS}]+章[{SPACE}]*[:：]?[{SPACE}]*([^\n]+)", "chapter", 1),
    (r"第[一二三四五六七八九十0-9]+[章节篇卷集部]", "chapter", 1),
    (rf"Chapter[{SPACE}]*[0-9IVX]+[:：]?[{SPACE}]*([^\n]+)", "chapter", 1),
    (rf"Part[{SPACE}]*[0-9]+|Volume[{SPACE}]*[0-9IVX]+|Book[{SPACE}]*[0-9]+", "part", 1),
    (rf"^([0-9]{{1,2}})[.{SPACE}]+([^\n]+)", "section", 2),
    (rf"^[（(]?([0-9]{{1,2}})[)）]?[、.{SPACE}]+([^\n]+)", "section", 2),
    (rf"^[（(]?[一二三四五六七八九十百千]+[)）]?[、.{SPACE}]+([^\n]+)", "section", 2),
]
REAL = rf"(?i)第[{_DIGITS}]+[章讲]|Chapter[{SPACE}]*[0-9]+|^[0-9]+[{SPACE}]+|^[0-9]+[.{SPACE}]"
#: Candidates of a way are ordered by pattern, then by position: the pattern's number stands above these bits.
SHIFT = 32
#: Confidence of the ways, in their order.
WAYS = [("heading", 5), ("class", 4), ("pattern", 5), ("font_size", 3), ("paragraph", 3), ("file_structure", 4)]
COLUMNS = ["doc_id", "prio", "confidence", "source", "file_path", "position", "enc_pos", "title", "level", "tag_level"]


def ends_a_sentence(text: Column) -> Column:
    return F.lit(TITLE_END).contains(F.right(text, F.lit(1)))


def is_stop(text: Column) -> Column:
    return F.lower(text).rlike(STOP)


def tag_level(tag: Column) -> Column:
    return F.when(tag.rlike("^h[1-6]$"), F.substr(tag, F.lit(2), F.lit(1)).cast("int")).otherwise(0)


def _way(name: str, ok: Column, title: Column, level: Column, tag: Column, enc_pos: Column, position: Column | None = None) -> Column:
    """A candidate of a way where ok holds, else null."""
    position = F.lit(0) if position is None else position
    names = [n for n, _ in WAYS]
    values = {
        "prio": F.lit(names.index(name) if name in names else len(names)), "confidence": F.lit(dict(WAYS).get(name, 0)), "source": F.lit(name), "position": position.cast("int"),
        "enc_pos": enc_pos.cast("long"), "title": title, "level": level.cast("int"), "tag_level": tag.cast("int"),
    }
    return F.when(ok, F.struct(*[v.alias(k) for k, v in values.items()]))


def _found(rows: DataFrame, *ways: Column) -> DataFrame:
    """The candidates that the ways (arrays) see in rows."""
    every = F.filter(F.concat(*ways), lambda c: c.isNotNull())
    return rows.select("doc_id", "file_path", F.explode(every).alias("c")).select("doc_id", "file_path", "c.*").select(*COLUMNS)


def unique(found: DataFrame) -> DataFrame:
    """Of the ways by class and by size the first of each title in a file, in the order of files and titles."""
    by = Window.partitionBy("doc_id", "file_path", "prio", "title").orderBy("enc_pos")
    return found.withColumn("rn", F.row_number().over(by)).filter(~F.col("source").isin("class", "font_size") | (F.col("rn") == 1)).drop("rn")


def _headings() -> Column:
    t, tag = F.col("text"), F.col("tag")
    ok = tag.rlike("^h[1-6]$") & (t != "") & (F.length(t) < 50) & ~is_stop(t) & ~t.endswith("。")
    return F.array(_way("heading", ok, t, F.when(tag.isin("h1", "h2"), 1).otherwise(2), tag_level(tag), F.col("pos"), F.col("source_line")))


def by_headings(nodes: DataFrame) -> DataFrame:
    return _found(nodes, _headings())


def _classes() -> Column:
    c, t = F.col("attr_class"), F.col("text")
    ok = c.rlike("(?i)" + "|".join(CLASS_PATTERNS)) & F.length(t).between(3, 99) & ~is_stop(t)
    each = [_way("class", c.rlike(f"(?i){p}"), t, F.lit(1 if "1" in p or "chapter" in p else 2), tag_level(F.col("tag")), F.lit(i << SHIFT) + F.col("pos")) for i, p in enumerate(CLASS_PATTERNS)]
    return F.when(ok, F.array(*each)).otherwise(F.filter(F.array(each[0]), lambda c: F.lit(False)))


def by_class(nodes: DataFrame) -> DataFrame:
    return unique(_found(nodes, _classes()))


def by_pattern(texts: DataFrame) -> DataFrame:
    """Heading lines in plain texts (doc_id, file_path, text); one line can match several patterns. ``position`` is where
    the match begins, counted from 0: the lengths of the matches of a pattern and of what stands between add up to it."""
    each = []
    for k, (pattern, _, level) in enumerate(TEXT_PATTERNS):
        regex = F.lit(f"(?imd){pattern}")
        gaps = F.transform(F.split("text", regex, -1), F.length)
        each.append(F.struct(F.lit(k).alias("k"), F.lit(level).alias("level"), F.regexp_extract_all("text", regex, F.lit(0)).alias("matches"), gaps.alias("gaps")))
    found = texts.select("doc_id", "file_path", F.explode(F.array(*each)).alias("p")).select("doc_id", "file_path", "p.*")
    found = found.select("doc_id", "file_path", "k", "level", F.posexplode(F.arrays_zip("matches", "gaps")).alias("m", "at")).filter("at.matches is not null")
    before = Window.partitionBy("doc_id", "file_path", "k").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("at.gaps") + F.length("at.matches")).over(before), F.lit(0)) + F.col("at.gaps")
    title = F.btrim(F.regexp_replace("at.matches", rf"^[{SPACE}]+|[{SPACE}]+$", ""))
    found = found.select("doc_id", "file_path", "k", "level", "m", start.alias("start"), title.alias("title"))
    return _found(found, F.array(_way("pattern", title_ok("title", STOP), F.col("title"), F.col("level"), F.lit(0), F.shiftleft(F.col("k").cast("long"), SHIFT) + F.col("m"), F.col("start"))))


def css_size(style: Column) -> Column:
    """The font size of an inline style in pixels; null without one."""
    number, unit = (F.regexp_extract(style, r"(?i)font-size:\s*([0-9.]+)(px|pt|em|rem)", g) for g in (1, 2))
    size = F.when(number.rlike(r"^[0-9]+(\.[0-9]*)?$|^\.[0-9]+$"), number).cast("double")
    return F.when(F.lower(unit) == "pt", size * 1.33).when(F.lower(unit).isin("em", "rem"), size * 16).otherwise(size)


def _file() -> WindowSpec:
    return Window.partitionBy("doc_id", "file_path")


def _after() -> WindowSpec:
    """The nodes behind one, from the end of the file: a running frame, which costs one step a row."""
    return _file().orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)


def with_sizes(nodes: DataFrame) -> DataFrame:
    """nodes with ``size`` (null without one or without text) and ``most``, the largest in the file."""
    sized = nodes.withColumn("size", F.when(F.col("text") != "", css_size(F.col("attr_style"))))
    return sized.withColumn("most", F.max("size").over(_file()))


def _sizes() -> Column:
    t = F.col("text")
    ok = (F.col("size") >= F.col("most") * 0.75) & F.length(t).between(6, 99) & ~ends_a_sentence(t)
    return F.array(_way("font_size", ok, t, F.when(F.col("size") == F.col("most"), 1).otherwise(2), tag_level(F.col("tag")), F.col("pos")))


def by_font_size(nodes: DataFrame) -> DataFrame:
    return unique(_found(with_sizes(nodes), _sizes()))


def with_bold(nodes: DataFrame, mark: Column) -> DataFrame:
    """nodes with ``has_bold``: whether a node that is a mark lies inside. The nearest mark behind a node decides."""
    near = F.last(F.when(mark, F.col("pos")), ignorenulls=True).over(_after())
    return nodes.withColumn("has_bold", F.coalesce(near <= F.col("end_pos"), F.lit(False)))


def with_scores(nodes: DataFrame) -> DataFrame:
    """nodes with ``score`` as a title: of p elements of 10 to 50 characters that end no sentence; null for others."""
    t, tag = F.col("text"), F.col("tag")
    s = with_bold(nodes, tag.isin("b", "strong")).withColumn("next_length", F.last(F.when(tag == "p", F.length(t)), ignorenulls=True).over(_after()))
    score = (
        F.when(t.rlike("[章节篇卷部集]"), 3).otherwise(0) + F.when(t.rlike(f"[{_DIGITS}]"), 2).otherwise(0) + F.when(F.col("next_length") > 100, 2).otherwise(0)
        + F.when(F.col("has_bold") | F.coalesce("attr_style", F.lit("")).contains("font-weight"), 1).otherwise(0)
    )
    return s.withColumn("score", F.when((tag == "p") & F.length(t).between(10, 50) & ~ends_a_sentence(t), score))


def paragraph_scores(nodes: DataFrame) -> DataFrame:
    return with_scores(nodes).filter("score is not null")


def _paragraphs() -> Column:
    return F.array(_way("paragraph", F.col("score") >= 5, F.col("text"), F.when(F.col("score") >= 7, 1).otherwise(2), F.lit(0), F.col("pos")))


def by_paragraph(nodes: DataFrame) -> DataFrame:
    return _found(with_scores(nodes), _paragraphs())


def with_first_title(nodes: DataFrame) -> DataFrame:
    """nodes with ``first_title``: whether it is the first of the first five short texts of the body that looks like a
    title."""
    t = F.col("text")
    so_far = _file().orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    s = nodes.withColumn("body", F.min(F.when(F.col("tag") == "body", F.struct("pos", "end_pos"))).over(_file()))
    inside = (F.col("pos") > F.col("body.pos")) & (F.col("pos") <= F.col("body.end_pos"))
    short = F.coalesce(inside & F.col("tag").isin("p", "h1", "h2", "h3", "div") & (t != "") & (F.length(t) < 200), F.lit(False))
    s = s.withColumn("short", short).withColumn("nth", F.count_if("short").over(so_far))
    likely = F.col("short") & (F.col("nth") <= 5) & F.length(t).between(10, 80) & ~F.lit("。，！？").contains(F.right(t, F.lit(1)))
    s = s.withColumn("likely", likely)
    return s.withColumn("first_title", F.col("likely") & (F.count_if("likely").over(so_far) == 1)).drop("body", "short", "nth", "likely")


def _first_titles() -> Column:
    return F.array(_way("file_structure", F.col("first_title"), F.col("text"), F.lit(1), tag_level(F.col("tag")), F.col("pos")))


def by_file_structure(nodes: DataFrame) -> DataFrame:
    """In each file the first of the first five short texts that looks like a title."""
    return _found(with_first_title(nodes), _first_titles())


def chapter_number(file_path: Column) -> Column:
    return F.nullif(F.regexp_extract(file_path, r"(?i)(?:chapter|section|part|chap)?[_-]?([0-9]+)", 1), F.lit("")).cast("int")


def validate(candidates: DataFrame) -> DataFrame:
    """Real chapters (not in h3 or deeper), long titles, and the first of each book's candidates."""
    order = Window.partitionBy("doc_id", "prio").orderBy("file_path", "position", "enc_pos")
    return candidates.withColumn("rn", F.row_number().over(order)).filter(_is_valid()).drop("rn")


def _is_valid() -> Column:
    real = F.col("title").rlike(REAL) & (F.col("tag_level") < 3)
    return real | (F.length("title") >= 50) | (F.col("rn") == 1)


def choose(validated: DataFrame) -> DataFrame:
    """doc_id, prio, label: the first way with two chapters, else the best by confidence and number."""
    counts = validated.groupBy("doc_id", "prio", "confidence", "source").agg(F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.when(F.col("n") >= 2, 0).otherwise(1), F.when(F.col("n") >= 2, F.col("prio")).otherwise(-F.col("confidence")), F.desc("n"), "prio"))
    first = counts.withColumn("r", best).filter("r = 1")
    return first.select("doc_id", "prio", "n", F.when(F.col("n") >= 2, F.col("source")).otherwise(F.concat("source", F.lit(" (备选)"))).alias("label"))


def _each_file(ok: Column) -> Column:
    """A chapter for a whole file, behind all candidates."""
    return F.array(_way("files", ok, F.lit(None).cast("string"), F.lit(1), F.lit(0), F.lit(0)))


def cascade(nodes: DataFrame, texts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The chapters of each book: validated candidates of its chosen way; one for each file (of files, by default those
    that have nodes) where nothing was found.

    nodes are read once for all ways that look at elements, texts once; what a book has decides in windows over the
    book, so that no candidate is made twice.
    """
    seen = with_first_title(with_scores(with_sizes(nodes)))
    ways = [_headings(), _classes(), _sizes(), _paragraphs(), _first_titles()]
    if files is None:
        seen, ways = seen.withColumn("top", F.min("pos").over(_file())), [*ways, _each_file(F.col("pos") == F.col("top"))]
    s = unique(_found(seen, *ways)).unionByName(by_pattern(texts))
    if files is not None:
        s = s.unionByName(_found(files, _each_file(F.lit(True))))
    way, book = Window.partitionBy("doc_id", "prio"), Window.partitionBy("doc_id")
    s = s.withColumn("rn", F.row_number().over(way.orderBy("file_path", "position", "enc_pos")))
    spare = F.col("source") == "files"
    s = s.filter(spare | _is_valid()).withColumn("n", F.count(F.lit(1)).over(way))
    many = F.col("n") >= 2
    rank = F.struct(F.when(spare, 2).when(many, 0).otherwise(1).alias("a"), F.when(many, F.col("prio")).otherwise(-F.col("confidence")).alias("b"), (-F.col("n")).alias("c"), F.col("prio").alias("d"))
    s = s.withColumn("rank", rank).withColumn("best", F.min("rank").over(book)).filter("rank = best")
    named = F.when(F.lower("file_path").rlike("[.]x?html$"), F.concat(F.lit("章节 "), F.col("rn").cast("string"))).otherwise(F.regexp_extract("file_path", "([^/]*)$", 1))
    label = F.when(spare | many, F.col("source")).otherwise(F.concat("source", F.lit(" (备选)")))
    return s.select("doc_id", "file_path", "position", "enc_pos", F.when(spare, named).otherwise(F.col("title")).alias("title"), "level", label.alias("label"))


def content_ranges(chapters: DataFrame, files: DataFrame) -> DataFrame:
    """chapters with the files they cover: from their own up to that of the next chapter. Of several in one file only
    the last covers anything."""
    numbered = files.select("doc_id", "file_path", (F.row_number().over(Window.partitionBy("doc_id").orderBy("file_path")) - 1).alias("file_idx"))
    order = Window.partitionBy("doc_id").orderBy("file_path", "position", "enc_pos")
    s = chapters.join(numbered, ["doc_id", "file_path"]).withColumn("until", F.lead("file_idx").over(order))
    return s.withColumn("until", F.coalesce("until", F.lit(1 << 30)))


def build(chapters: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, chapter_index, title (100 characters at most), level, n_files, word_count of chapters that have text;
    files are (doc_id, file_path, text)."""
    return build_ranges(chapters, files).drop("file_idx", "until")


def build_ranges(chapters: DataFrame, files: DataFrame) -> DataFrame:
    """The built chapters with the range of files that each covers."""
    spans = content_ranges(chapters, files)
    numbered = files.select("doc_id", F.col("text"), (F.row_number().over(Window.partitionBy("doc_id").orderBy("file_path")) - 1).alias("idx"))
    inside = spans.join(numbered, "doc_id").filter("idx >= file_idx and idx < until")
    made = inside.groupBy("doc_id", "file_idx", "until", "position", "enc_pos", "title", "level").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.length("text")).cast("long").alias("word_count")).filter("word_count > 0")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("file_idx", "position", "enc_pos"))
    return made.select("doc_id", n.alias("chapter_index"), F.substr("title", F.lit(1), F.lit(100)).alias("title"), "level", "n_files", "word_count", "file_idx", "until")


def chapter_blocks(built: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, chapter_index, pos, type, text, level of the elements in the files of each chapter."""
    idx = files.select("doc_id", "file_path", (F.row_number().over(Window.partitionBy("doc_id").orderBy("file_path")) - 1).alias("idx"))
    own = blocks(nodes).join(idx, ["doc_id", "file_path"])
    inside = own.join(built.select("doc_id", "chapter_index", "file_idx", "until"), "doc_id").filter("idx >= file_idx and idx < until")
    pos = F.row_number().over(Window.partitionBy("doc_id", "chapter_index").orderBy("idx", "pos")) - 1
    return inside.withColumn("pos", pos).select("doc_id", "chapter_index", "pos", "type", "text", "level")


def blocks(nodes: DataFrame) -> DataFrame:
    """doc_id, file_path, pos, type, text, level of the elements that hold two characters or more: h1 to h6 are headings
    of level 2 to 6, class names raise paragraphs to headings of level 2 to 4."""
    c, tag = F.lower(F.coalesce("attr_class", F.lit(""))), F.col("tag")
    n = with_bold(nodes, tag.isin("b", "strong") | ((tag == "span") & c.rlike("(^| )bold( |$)")))
    n = n.filter(tag.isin("p", "div", "span", "h1", "h2", "h3", "h4", "h5", "h6") & (F.length("text") >= 2))
    level = (
        F.when(tag.rlike("^h[1-6]$"), F.least(F.lit(6), tag_level(tag) + 1))
        .when(c.rlike("firsttitle|chapter-title|section-title"), 2)
        .when(c.rlike("content_4|subtitle"), F.when(F.col("has_bold"), 3).otherwise(0))
        .when(c.contains("content_5"), 4)
        .otherwise(0)
    )
    return n.select("doc_id", "file_path", "pos", F.when(level > 0, "heading").otherwise("paragraph").alias("type"), "text", level.alias("level"))


def plain_texts(nodes: DataFrame) -> DataFrame:
    """doc_id, file_path, text: the texts of each file's outermost elements."""
    top = nodes.filter("parent = -1")
    return top.groupBy("doc_id", "file_path").agg(joined(F.col("lines"), "\n").alias("text"))
