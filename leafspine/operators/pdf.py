"""The layout engine: laid-out lines to headings to chapters, without collecting a document.

Input: lines (doc_id, pos from 0, page_num, text, font_size, x0, y0, x1, y1, page_width, page_height). Everything is
windows over the document, numbers for whole documents (base size, thresholds) too, so lines are read and dealt once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, strip
from ..plans.segment import earlier, first_known, joined, last_known, later, ordered, running_segment
from ..plans.storage import stored

#: Labels, note headings, words of imprint lines.
LABEL = r"^(【[章节篇卷部]】|\[[章节篇卷部]\]|[（(][章节篇卷部][)）])$"
NOTE = rf"(?i)^(注释[{SPACE}]*[-—–:：]|Notes?$|注释$|注[{SPACE}]*[0-9]+|[0-9]+[{SPACE}]*注释)"
IMPRINT = "http://|https://|www[.]|版权所有|仅供学习|严禁商业|不得转载|翻版必究"
PAGE_NUMBER = rf"^[0-9]+$|^[-{SPACE}]*[0-9]+[-{SPACE}/]*$"
MARGIN_ZONE = 0.06


def lines_from_spans(spans: DataFrame) -> DataFrame:
    """Lines from spans (doc_id, page_num, block_no, line_no, span_no, text, size, font, x0, y0, x1, y1): stripped texts
    without separator, mean size, first font, union of the boxes, the size of the page if spans have it; empty lines are
    left out."""
    s = spans.withColumn("t", strip("text")).filter("t <> ''")
    made = s.groupBy("doc_id", "page_num", "block_no", "line_no").agg(
        joined(F.col("t"), "", "span_no").alias("text"), F.avg("size").alias("font_size"), F.min_by("font", "span_no").alias("font_name"), *[F.min(c).alias(c) for c in ("x0", "y0")],
        *[F.max(c).alias(c) for c in ("x1", "y1", "page_width", "page_height") if c in spans.columns])
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "block_no", "line_no")) - 1
    return made.withColumn("pos", n).withColumn("ends_with_period", F.col("text").endswith("。"))


def in_margin() -> Column:
    """The middle of the line lies in the top or bottom 6 % of the page."""
    middle = (F.col("y0") + F.col("y1")) / 2
    return (middle < F.col("page_height") * MARGIN_ZONE) | (middle > F.col("page_height") * (1 - MARGIN_ZONE))


def is_imprint(text: Column) -> Column:
    """A line that is made for the page: an address, a copyright line or a page number."""
    return text.rlike(IMPRINT) | text.rlike(PAGE_NUMBER)


def measured(lines: DataFrame) -> DataFrame:
    """lines with what their neighbours say: gaps, margins, flags."""
    gap_before = F.when(F.lag("page_num").over(ordered()) == F.col("page_num"), F.col("y0") - F.lag("y1").over(ordered())).otherwise(0.0)
    gap_after = F.when(F.lead("page_num").over(ordered()) == F.col("page_num"), F.lead("y0").over(ordered()) - F.col("y1")).otherwise(0.0)
    s = lines.withColumns({"s": strip("text"), "gap_before": gap_before, "gap_after": gap_after, "height": F.col("y1") - F.col("y0"), "period": F.col("text").endswith("。"), "margin": in_margin()})
    gap = F.greatest("gap_before", "gap_after")
    wide = (F.col("page_width") - (F.col("x1") - F.col("x0"))) > F.col("page_width") * 0.5
    return s.withColumns({
        "loose": gap > F.col("height") * 0.5, "apart": wide & (gap > F.col("height")), "label": F.col("s").rlike(LABEL), "note": F.col("s").rlike(NOTE),
        "short_margin": (F.length("s") < 30) & F.col("margin"),
    })


def _sized(lines: DataFrame) -> DataFrame:
    """lines with ``base``, the most frequent rounded size of the document; of equally frequent ones the first that occurs."""
    alike = Window.partitionBy("doc_id", "size")
    s = lines.withColumn("size", F.bround("font_size"))
    s = s.withColumn("often", F.struct((-F.count(F.lit(1)).over(alike)).alias("n"), F.min("pos").over(alike).alias("first"), F.col("size")))
    return s.withColumn("base", F.min("often").over(Window.partitionBy("doc_id"))["size"]).drop("size", "often")


def base_size(lines: DataFrame) -> DataFrame:
    """doc_id and ``base``."""
    return _sized(lines).groupBy("doc_id").agg(F.first("base").alias("base"))


def with_base(lines: DataFrame) -> DataFrame:
    s = _sized(measured(lines))
    s = s.withColumn("ratio", F.when(F.col("base") > 0, F.col("font_size") / F.col("base")).otherwise(1.0))
    return s.withColumn("body_sized", F.col("ratio").between(0.9, 1.1))


def _may_head() -> Column:
    roomy = F.when(F.col("ratio") >= 1.39, F.col("loose")).otherwise(F.col("apart"))
    return (F.length("s") >= 2) & ~F.col("short_margin") & ~F.col("label") & ~F.col("period") & (F.col("ratio") > 1.0) & roomy


def candidates(based: DataFrame) -> DataFrame:
    """Lines that may be headings, by size and the room around them."""
    return based.filter(_may_head())


def with_thresholds(based: DataFrame) -> DataFrame:
    """based with ``level1`` and ``level2``: the mean size of the candidates without those of the most frequent size, and
    0.8 of it or 1.1 of the base size."""
    doc, alike = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "may_head", "font_size")
    s = based.withColumn("may_head", F.coalesce(_may_head(), F.lit(False)))
    s = s.withColumns({"n_alike": F.count(F.lit(1)).over(alike), "first": F.min("pos").over(alike)})
    often = F.struct(F.col("n_alike"), -F.col("first"))
    s = s.withColumn("top", F.max(F.when(F.col("may_head"), often)).over(doc))
    counted = F.col("may_head") & (F.col("pos") == F.col("first")) & (often != F.col("top"))  # one line for each other size
    mean = F.sum(F.when(counted, F.col("font_size") * F.col("n_alike"))).over(doc) / F.sum(F.when(counted, F.col("n_alike"))).over(doc)
    s = s.withColumn("mean", mean).withColumns({
        "level1": F.coalesce("mean", F.col("base") * 1.4),
        "level2": F.when(F.col("mean").isNull(), F.col("base") * 1.1).otherwise(F.greatest(F.col("mean") * 0.8, F.col("base") * 1.1)),
    })
    return s.drop("may_head", "n_alike", "first", "top", "mean")


def thresholds(based: DataFrame) -> DataFrame:
    """doc_id, ``level1`` and ``level2``."""
    return with_thresholds(based).groupBy("doc_id").agg(F.first("level1").alias("level1"), F.first("level2").alias("level2"))


def body_x0() -> Column:
    """Where the first body line among the next 19 starts."""
    return first_known(F.when(F.col("body_sized") & (F.length("text") > 10), F.col("x0")), later(1, 19))


def classify(based: DataFrame, level2_as_body: bool = True, level3_as_body: bool = True) -> DataFrame:
    """based with ``level`` (0 body, 1 to 3) and ``as_body``."""
    s = with_thresholds(based).withColumn("body_x0", body_x0())
    cut = F.col("level1") - F.least(F.lit(0.2), F.col("level1") * 0.01)
    near = F.coalesce(F.abs(F.col("x0") - F.nullif("body_x0", F.lit(0.0))) <= 10, F.lit(False))
    barred = (F.length("s") < 2) | F.col("short_margin") | F.col("label") | F.col("note") | F.col("period")
    middle = (F.col("font_size") > F.col("base")) & (F.col("font_size") < cut) & F.col("apart")
    level = F.when(barred, 0).when((F.col("font_size") >= cut) & F.col("loose"), 1).when(middle & ~near, 2).when(middle & (F.length("s") < 50), 3).otherwise(0)
    s = s.withColumn("level", level)
    return s.withColumn("as_body", ((F.col("level") == 2) & F.lit(level2_as_body)) | ((F.col("level") == 3) & F.lit(level3_as_body)))


def independence(classified: DataFrame) -> DataFrame:
    """classified with ``independent``: for headings, whether body text follows. The first deciding line among the
    next 29 counts: a body line says yes; a heading of a deeper level says no, but one of level 3 under level 1 or 2
    says yes if a body line stands among its next 9 before another heading, and nothing otherwise."""
    heading = F.col("level") > 0
    body = F.col("body_sized") & (F.length("text") > 10)
    soon = first_known(F.when(body, F.lit(True)).when(heading, F.lit(False)), later(1, 9))
    s = classified.withColumn("soon", F.coalesce(soon, F.lit(False)))
    says = ~heading & (body | (F.col("period") & (F.length("text") > 5)))
    events = {}
    for own in (1, 2):
        third = F.when((F.col("level") == 3) & F.col("soon"), True)
        deeper = F.when((F.col("level") == 2) & F.lit(own == 1), False)
        events[f"e{own}"] = F.when(says, True).otherwise(F.coalesce(third, deeper))
    events["e3"] = F.when(says, True)
    s = s.withColumns(events).withColumns({f"f{i}": first_known(F.col(f"e{i}"), later(1, 29)) for i in (1, 2, 3)})
    decided = F.when(F.col("level") == 1, F.col("f1")).when(F.col("level") == 2, F.col("f2")).when(F.col("level") == 3, F.col("f3"))
    return s.withColumn("independent", F.when(heading, F.coalesce(decided, F.lit(False)))).drop("soon", "e1", "e2", "e3", "f1", "f2", "f3")


def with_merged(lines: DataFrame) -> DataFrame:
    """lines of any level with ``head`` (a heading after merging), its ``title``, ``m_ind`` and ``m_body``: a heading of
    level 1 without body text takes in the next heading. In a run of such headings every other one leads, if a heading
    follows it."""
    own = Window.partitionBy("doc_id", "heading").orderBy("pos")
    s = lines.withColumn("heading", F.col("level") > 0).withColumn("hungry", (F.col("level") == 1) & ~F.col("independent"))
    s = s.withColumn("breaks", F.coalesce(F.sum((~F.col("hungry")).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = Window.partitionBy("doc_id", "heading", "breaks", "hungry").orderBy("pos")
    s = s.withColumns({"nth": F.row_number().over(run), "next_text": F.lead("text").over(own)})
    s = s.withColumn("leads", F.col("hungry") & (F.col("nth") % 2 == 1) & F.col("next_text").isNotNull())
    s = s.withColumn("head", F.col("heading") & ~F.coalesce(F.lag("leads").over(own), F.lit(False)))
    s = s.withColumns({
        "title": F.when(F.col("head"), F.when(F.col("leads"), F.concat("text", F.lit(" - "), "next_text")).otherwise(F.col("text"))),
        "m_ind": F.col("head") & (F.col("independent") | F.col("leads")), "m_body": F.col("head") & F.col("as_body") & ~F.col("leads"),
    })
    return s.drop("heading", "hungry", "breaks", "nth", "next_text", "leads")


def merge_headings(lines: DataFrame) -> DataFrame:
    """The headings after merging."""
    return with_merged(lines).filter("head").select("doc_id", "pos", "level", "title", F.col("m_ind").alias("independent"), F.col("m_body").alias("as_body"))


def in_notes(based: DataFrame) -> DataFrame:
    """based with ``in_note``: from a heading of notes to the next large short line that is none."""
    ends = (F.col("ratio") >= 1.4) & (F.length("s") < 50) & ~F.col("s").rlike("[.。!！?？]$") & ~F.col("note")
    state = last_known(F.when(F.col("note"), True).when(ends, False), later(Window.unboundedPreceding, 0))
    return based.withColumn("in_note", F.coalesce(state, F.lit(False)))


def estimated_level(ratio: Column) -> Column:
    return F.when(ratio >= 1.4, 1).when(ratio >= 1.25, 2).when(ratio >= 1.15, 3).otherwise(0)


def _letters(text: Column) -> Column:
    return F.length(F.translate(text, " \n", ""))


def _segments(lines: DataFrame, level2_as_body: bool, level3_as_body: bool) -> DataFrame:
    """lines with ``seg``, whether they open a chapter, are shown in one, and are plain text."""
    s = with_merged(in_notes(independence(classify(with_base(lines), level2_as_body, level3_as_body))))
    bound = (F.col("head") & ~F.col("m_body")) | F.col("note")
    s = s.withColumn("seg", running_segment(bound))
    opens = bound & ~F.col("note") & F.col("m_ind") & ~F.col("in_note") & ~F.col("title").rlike(NOTE)
    shown = ~F.col("in_note") & ~F.col("short_margin") & ~is_imprint(F.col("s"))
    plain = F.when(F.col("head"), False).otherwise(F.col("body_sized") | F.col("period") | (estimated_level(F.col("ratio")) == 0))
    s = s.withColumn("opens", F.coalesce(opens, F.lit(False)))
    return s.withColumns({"shown": shown, "plain": plain & ~F.col("opens")})


def chapters(lines: DataFrame, level2_as_body: bool = True, level3_as_body: bool = True) -> DataFrame:
    """doc_id, chapter_index, title, level, word_count, paragraph_count by the sizes of headings. A chapter runs to the
    next heading that isn't body, independent or not, or to the next heading of notes."""
    made = _segments(lines, level2_as_body, level3_as_body).groupBy("doc_id", "seg").agg(
        F.max("opens").alias("opens"), F.max(F.when(F.col("opens"), F.col("title"))).alias("title"), F.max(F.when(F.col("opens"), F.col("level"))).alias("level"),
        F.coalesce(F.sum(F.when(F.col("shown"), _letters(F.col("text")))), F.lit(0)).cast("long").alias("word_count"), F.count_if(F.col("shown") & F.col("plain")).alias("paragraph_count"),
    ).filter("opens")
    return made.withColumn("chapter_index", F.row_number().over(ordered(pos="seg"))).select("doc_id", "chapter_index", "title", "level", "word_count", "paragraph_count")


def _as_blocks(lines: DataFrame) -> DataFrame:
    kind = F.when(F.col("plain"), "paragraph").otherwise("heading")
    return lines.select("doc_id", F.col("chapter_index").cast("int").alias("chapter_index"), "pos", kind.alias("type"), "text", F.when(F.col("plain"), 0).otherwise(estimated_level(F.col("ratio"))).alias("level"))


def chapter_blocks(lines: DataFrame, level2_as_body: bool = True, level3_as_body: bool = True) -> DataFrame:
    """doc_id, chapter_index, pos, type, text, level of the lines that the chapters by sizes hold."""
    s = _segments(lines, level2_as_body, level3_as_body)
    s = s.withColumn("opened", F.max("opens").over(Window.partitionBy("doc_id", "seg"))).filter("opened")
    return _as_blocks(s.withColumn("chapter_index", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("seg"))).filter("shown"))


def toc(lines: DataFrame) -> DataFrame:
    """Entries of the contents pages: doc_id, toc_pos, title, level, type, parent. The contents start at a line 目录 of
    20 points or more and run over two pages."""
    s = lines.withColumn("s", strip("text"))
    start = F.min(F.when((F.col("s") == "目录") & (F.col("font_size") >= 20), F.struct("pos", "page_num"))).over(Window.partitionBy("doc_id"))
    s = s.withColumn("start", start).filter("start is not null and pos > start.pos")
    left = F.max((F.col("page_num") > F.col("start.page_num") + 1).cast("int")).over(later(Window.unboundedPreceding, 0))
    s = s.withColumn("left", left).filter("left = 0")
    s = s.filter((F.length("s") > 0) & (F.col("s") != "目录") & (F.length("s") < 50) & (F.col("font_size") >= 14))
    part = (F.col("font_size") >= 19) & F.col("s").contains("第") & F.col("s").contains("篇")
    s = s.withColumn("type", F.when(part, "part").when(F.col("font_size") >= 19, "chapter").otherwise("section"))
    parent = last_known(F.when(F.col("type") == "part", F.col("s")), later(Window.unboundedPreceding, 0))
    return s.select("doc_id", (F.row_number().over(ordered()) - 1).alias("toc_pos"), F.col("s").alias("title"), F.when(F.col("type") == "section", 2).otherwise(1).alias("level"), "type", F.when(F.col("type") != "part", parent).alias("parent"), (F.col("start.page_num") + 2).alias("from_page"))


def toc_match(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """entries with ``index`` (position of the first line, or run of two to five lines of a page, that is the title);
    null if it isn't found, as parts never are."""
    s = lines.withColumns({"s": strip("text"), "n": F.count(F.lit(1)).over(Window.partitionBy("doc_id"))})
    glued, same = F.col("s"), F.lit(True)
    runs = []
    for k in range(1, 5):
        same = same & (F.coalesce(F.lead("page_num", k).over(ordered()), F.lit(-1)) == F.col("page_num"))
        glued = F.concat(glued, F.coalesce(F.lead("s", k).over(ordered()), F.lit("")))
        runs.append(F.when(same, F.translate(glued, " 　", "")))
    s = s.withColumn("runs", F.array_compact(F.array(*runs))).select(F.col("doc_id").alias("of"), "pos", "page_num", "s", "n", "runs")
    wanted = entries.withColumn("flat", F.translate("title", " 　", ""))
    alike = (F.col("of") == F.col("doc_id")) & (F.substr("s", F.lit(1), F.lit(3)) == F.substr("title", F.lit(1), F.lit(3)))  # holds for each hit
    hit = (F.col("s") == F.col("title")) | (F.col("title").startswith(F.col("s")) & (F.length("s") >= 3) & F.exists("runs", lambda r: F.contains(r, F.col("flat"))))
    late = (F.col("type") == "section") & (F.col("pos") / F.col("n") >= 0.95)
    found = wanted.join(s, alike & (F.col("type") != "part") & (F.col("page_num") >= F.col("from_page")) & hit & ~late, "left")
    return found.groupBy(*entries.columns).agg(F.min("pos").alias("index"))


def _enough(matched: DataFrame) -> DataFrame:
    """The entries found, of documents with three or more."""
    found = matched.withColumn("n_found", F.count("index").over(Window.partitionBy("doc_id")))
    return found.filter("n_found >= 3 and index is not null")


def toc_chapters(lines: DataFrame, matched: DataFrame) -> DataFrame:
    """Chapters of documents with three entries found or more: each runs to where the next entry starts. Counts are
    differences of running sums, looked up where the entries start."""
    plain = F.col("body_sized") | F.col("period") | (estimated_level(F.col("ratio")) == 0)
    whole = Window.partitionBy("doc_id")
    s = with_base(lines).withColumns({"letters": _letters(F.col("text")), "plain": F.coalesce(plain, F.lit(False)).cast("long")})
    s = s.withColumns({"letters_to": F.sum("letters").over(earlier()), "plain_to": F.sum("plain").over(earlier()), "letters_of": F.sum("letters").over(whole), "plain_of": F.sum("plain").over(whole)})
    s = s.select("doc_id", F.col("pos").alias("index"), F.coalesce("letters_to", F.lit(0)).alias("letters_to"), F.coalesce("plain_to", F.lit(0)).alias("plain_to"), "plain", "letters_of", "plain_of")
    by_toc = whole.orderBy("toc_pos")
    found = _enough(matched).join(s, ["doc_id", "index"]).withColumn("end", F.lead("index").over(by_toc))
    span = lambda part: F.coalesce(F.lead(f"{part}_to").over(by_toc), F.col(f"{part}_of")) - F.col(f"{part}_to")
    forward = F.col("end").isNull() | (F.col("end") > F.col("index"))
    counts = {"word_count": span("letters"), "paragraph_count": span("plain") - F.col("plain")}
    return found.select("doc_id", F.row_number().over(by_toc).alias("chapter_index"), "title", "level", *[F.when(forward, v).otherwise(0).cast("long").alias(k) for k, v in counts.items()])


def toc_blocks(lines: DataFrame, matched: DataFrame) -> DataFrame:
    """doc_id, chapter_index, pos, type, text, level of the lines that the chapters by contents hold."""
    by_toc = Window.partitionBy("doc_id").orderBy("toc_pos")
    found = _enough(matched).select("doc_id", "index", F.row_number().over(by_toc).alias("chapter_index"), F.lead("index").over(by_toc).alias("end"))
    inside = (F.col("pos") >= F.col("index")) & (F.col("end").isNull() | (F.col("pos") < F.col("end")))
    plain = (F.col("pos") > F.col("index")) & (F.col("body_sized") | F.col("period") | (estimated_level(F.col("ratio")) == 0))
    return _as_blocks(with_base(lines).join(found, "doc_id").filter(inside).withColumn("plain", plain))


def contents(lines: DataFrame) -> DataFrame:
    """The entries of the contents pages with their lines, stored: all that is made of a document asks for them, and they
    are a small part of the lines."""
    return stored(toc_match(lines, toc(lines)), "contents")


def _by_sizes(lines: DataFrame, matched: DataFrame) -> DataFrame:
    return lines.join(_enough(matched).select("doc_id").distinct(), "doc_id", "left_anti")


def document_chapters(lines: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """By the table of contents where three entries or more are found, by sizes elsewhere."""
    matched = contents(lines) if matched is None else matched
    return toc_chapters(lines, matched).unionByName(chapters(_by_sizes(lines, matched)))


def document_blocks(lines: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """The lines in the chapters of :func:`document_chapters`."""
    matched = contents(lines) if matched is None else matched
    return toc_blocks(lines, matched).unionByName(chapter_blocks(_by_sizes(lines, matched)))
