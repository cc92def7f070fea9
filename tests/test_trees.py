"""Operators on HTML and books against plain Python on random trees."""

import random
import re
from collections import Counter, defaultdict

import pytest

from leafspine.operators import epub, html
from leafspine.sources import html as sources_html

TAGS = ["p", "p", "p", "div", "span", "h1", "h2", "h3", "b", "strong", "ul", "li", "em", "blockquote", "pre", "script"]
CLASSES = [None, None, "Chapter_title", "part-title x", "h2", "bold", "content_4", "content_5 y", "firsttitle", "section-title", "plain"]
STYLES = [None, None, "font-size: 12px", "FONT-SIZE:9pt", "font-size: 2em; font-weight: 700", "text-align: center", "font-style: italic;text-align:right"]
TEXTS = [
    "第三章 开始", "Chapter 4: The end", "第2节", "12. twelve words of it", "short", "附录 more", "contents", "ends here。", "a sentence of more than ten", "Part 7 and then a bit",
    "  spaced  ", "x", "（3）、three", "三、 drei", "a much longer paragraph that goes on for far more than one hundred characters so that what stands before it looks like a title of it", "中文字符四个", "题目！",
    "CHAPTER IX", "第三章 开始",
]


def tree(r, depth=0):
    tag = r.choice(TAGS)
    inside = [r.choice(TEXTS)] if r.random() < 0.7 else []
    if depth < 4 and tag != "script":
        inside += [tree(r, depth + 1) if r.random() < 0.7 else r.choice(TEXTS) for _ in range(r.randrange(4))]
        inside = [x for i, x in enumerate(inside) if not (i and isinstance(x, str) and isinstance(inside[i - 1], str))]  # neighbours would be one text
    return tag, {"class": r.choice(CLASSES), "style": r.choice(STYLES), "title": r.choice([None, None, None, "named"])}, inside


def page(r):
    return "html", {}, [("body", {}, [tree(r) for _ in range(r.randrange(1, 12))])] if r.random() < 0.95 else []


def source(x):
    if isinstance(x, str):
        return x
    tag, attrs, inside = x
    return f"<{tag}{''.join(f' {k}="{v}"' for k, v in attrs.items() if v is not None)}>{''.join(map(source, inside))}</{tag}>"


def expected(x):
    """The nodes of a tree, from the tree itself."""
    out, at = [], [0]

    def walk(x, parent, depth, silent):
        if isinstance(x, str):
            at[0] += 1
            return [] if silent or not x.strip() else [x.strip()]
        tag, attrs, inside = x
        node = {"pos": at[0], "parent": parent, "tag": tag, "depth": depth, "source_line": 1, **{f"attr_{k}": attrs.get(k) for k in ("title", "class", "style")}}
        at[0] += 1
        out.append(node)
        own = [s for c in inside for s in walk(c, node["pos"], depth + 1, tag == "script")]
        node |= {"end_pos": at[0] - 1, "text": "".join(own), "lines": "\n".join(own), "n_strings": len(own)}
        return own

    walk(x, -1, 0, False)
    return out


R = random.Random(11)
BOOKS = {b: {f"{f}.html": page(R) for f in range(R.randrange(1, 6))} for b in range(30)}
NODES = {(b, f): expected(t) for b, fs in BOOKS.items() for f, t in fs.items()}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(b, f, source(t)) for b, fs in BOOKS.items() for f, t in fs.items()], "doc_id long, file_path string, html string").repartition(4)


@pytest.fixture(scope="module")
def nodes(files):
    return sources_html.nodes(files).cache()


def test_nodes(nodes):
    got = defaultdict(list)
    for r in nodes.orderBy("pos").collect():
        got[r.doc_id, r.file_path].append({k: v for k, v in r.asDict().items() if k not in ("doc_id", "file_path")})
    assert got == NODES


def stop(t):
    return any(w in t.lower() for w in epub.STOP_WORDS)


def ends(t):
    return t != "" and t[-1] in '。，！？；："（）'


def level_of(tag):
    return int(tag[1]) if re.fullmatch("h[1-6]", tag) else 0


def bold_inside(own, n, marks):
    return any(n["pos"] < m["pos"] <= n["end_pos"] for m in own if marks(m))


def headings(own):
    for n in own:
        t = n["text"]
        if level_of(n["tag"]) and t and len(t) < 50 and not stop(t) and not t.endswith("。"):
            yield t, n["source_line"], n["pos"], 1 if n["tag"] in ("h1", "h2") else 2, level_of(n["tag"])


def classes(own):
    seen = set()
    for i, p in enumerate(epub.CLASS_PATTERNS):
        for n in own:
            t = n["text"]
            if n["attr_class"] and re.search(p, n["attr_class"], re.I) and 3 <= len(t) <= 99 and not stop(t) and t not in seen:
                seen.add(t)
                yield t, 0, (i << 32) + n["pos"], 1 if "1" in p or "chapter" in p else 2, level_of(n["tag"])


def size(n):
    m = re.search(r"font-size:\s*([0-9.]+)(px|pt|em|rem)", n["attr_style"] or "", re.I)
    return None if not m or not n["text"] else float(m[1]) * {"px": 1, "pt": 1.33, "em": 16, "rem": 16}[m[2].lower()]


def sizes(own):
    most, seen = max((s for n in own if (s := size(n)) is not None), default=0), set()
    for n in own:
        t, s = n["text"], size(n)
        if s is not None and s >= most * 0.75 and 6 <= len(t) <= 99 and not ends(t) and t not in seen:
            seen.add(t)
            yield t, 0, n["pos"], 1 if s == most else 2, level_of(n["tag"])


def scores(own):
    ps = [n for n in own if n["tag"] == "p"]
    for i, n in enumerate(ps):
        t = n["text"]
        if 10 <= len(t) <= 50 and not ends(t):
            bold = bold_inside(own, n, lambda m: m["tag"] in ("b", "strong")) or "font-weight" in (n["attr_style"] or "")
            yield n, 3 * bool(re.search("[章节篇卷部集]", t)) + 2 * bool(re.search("[一二三四五六七八九十百千0-9]", t)) + 2 * (i + 1 < len(ps) and len(ps[i + 1]["text"]) > 100) + bold


def paragraphs(own):
    for n, s in scores(own):
        if s >= 5:
            yield n["text"], 0, n["pos"], 1 if s >= 7 else 2, 0


def first_titles(own):
    body = next((n for n in own if n["tag"] == "body"), None)
    inside = [n for n in own if body and body["pos"] < n["pos"] <= body["end_pos"] and n["tag"] in ("p", "h1", "h2", "h3", "div") and 0 < len(n["text"]) < 200][:5]
    for n in inside:
        if 10 <= len(n["text"]) <= 80 and n["text"][-1] not in "。，！？":
            yield n["text"], 0, n["pos"], 1, level_of(n["tag"])
            return


def plain(own):
    return "\n".join(n["lines"] for n in own if n["parent"] == -1)


PATTERNS = [
    (r"第[一二三四五六七八九十百千\d]+章[\s]*[:：]?\s*([^\n]+)", 1), (r"第[一二三四五六七八九十\d]+[章节篇卷集部]", 1), (r"Chapter\s*[\dIVX]+[:：]?\s*([^\n]+)", 1), (r"Part\s*\d+|Volume\s*[\dIVX]+|Book\s*\d+", 1),
    (r"^(\d{1,2})[\.\s]+([^\n]+)", 2), (r"^[（(]?(\d{1,2})[)）]?[、\.\s]+([^\n]+)", 2), (r"^[（(]?[一二三四五六七八九十百千]+[)）]?[、\.\s]+([^\n]+)", 2),
]


def patterns(text):
    for k, (p, level) in enumerate(PATTERNS):
        for m, found in enumerate(re.finditer(p, text, re.M | re.I)):
            t = found.group().strip()
            if 3 <= len(t) <= 100 and not ends(t) and not stop(t):
                yield t, found.start(), (k << 32) + m, level, 0


def every(way, by=None):
    return Counter((*key, *c) for key, own in NODES.items() for c in way(own))


def rows_of(df):
    return Counter((r.doc_id, r.file_path, r.title, r.position, r.enc_pos, r.level, r.tag_level) for r in df.collect())


@pytest.mark.parametrize(("operator", "way"), [(epub.by_headings, headings), (epub.by_class, classes), (epub.by_font_size, sizes), (epub.by_paragraph, paragraphs), (epub.by_file_structure, first_titles)])
def test_ways(nodes, operator, way):
    want = every(way)
    assert sum(want.values()) > 10 and rows_of(operator(nodes)) == want


def test_scores(nodes):
    got = Counter((r.doc_id, r.file_path, r.pos, r.score) for r in epub.paragraph_scores(nodes).collect())
    assert got == Counter((*key, n["pos"], s) for key, own in NODES.items() for n, s in scores(own))


def test_patterns_give_offsets(nodes, spark):
    want = Counter((*key, *c) for key, own in NODES.items() for c in patterns(plain(own)))
    assert sum(want.values()) > 50 and rows_of(epub.by_pattern(epub.plain_texts(nodes))) == want
    text = "Chapter 1 here\nsee Chapter 2 there\nChapter 2 there\n12. x\na 12. x\n12. x\r\n第三章 一\n第三章 一\n"
    got = rows_of(epub.by_pattern(spark.createDataFrame([(1, "f", text)], "doc_id long, file_path string, text string")))
    assert got == Counter((1, "f", *c) for c in patterns(text)) and len({r[3] for r in got}) > 6


REAL = re.compile(r"第[一二三四五六七八九十百千\d]+[章讲]|Chapter\s*\d+|^\d+\s+|^\d+[\.\s]", re.I)
CONFIDENCE = {"heading": 5, "class": 4, "pattern": 5, "font_size": 3, "paragraph": 3, "file_structure": 4}


def brute_cascade(book):
    ways = []
    for name, way in [("heading", headings), ("class", classes), ("pattern", lambda own: patterns(plain(own))), ("font_size", sizes), ("paragraph", paragraphs), ("file_structure", first_titles)]:
        found = sorted(((f, c[1], c[2], *c) for f in BOOKS[book] for c in way(NODES[book, f])), key=lambda x: x[:3])
        ways.append((name, [x for i, x in enumerate(found) if i == 0 or (REAL.search(x[3]) and x[7] < 3) or len(x[3]) >= 50]))
    for name, found in ways:
        if len(found) >= 2:
            return [(book, x[0], x[1], x[2], x[3], x[6], name) for x in found]
    left = [(CONFIDENCE[n], -i, n, found) for i, (n, found) in enumerate(ways) if found]
    if left:
        _, _, name, found = max(left, key=lambda x: x[:2])
        return [(book, x[0], x[1], x[2], x[3], x[6], f"{name} (备选)") for x in found]
    return [(book, f, 0, 0, f"章节 {i}", 1, "files") for i, f in enumerate(sorted(BOOKS[book]), 1)]


def test_cascade(nodes):
    got = epub.cascade(nodes, epub.plain_texts(nodes))
    rows = Counter((r.doc_id, r.file_path, r.position, r.enc_pos, r.title, r.level, r.label) for r in got.collect())
    assert rows == Counter(x for b in BOOKS for x in brute_cascade(b))
    assert len({x[-1] for x in rows}) >= 3


def test_cascade_reads_pages_once_for_elements_and_once_for_texts(files):
    own = sources_html.nodes(files.filter("doc_id >= 0"))  # not what is cached
    plan = epub.cascade(own, epub.plain_texts(own))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"[+:]- MapInArrow", plan)) == 2, plan


def test_book_blocks(nodes):
    want = Counter()
    for (book, f), own in NODES.items():
        for n in own:
            c, tag = (n["attr_class"] or "").lower(), n["tag"]
            if tag not in ("p", "div", "span", "h1", "h2", "h3", "h4", "h5", "h6") or len(n["text"]) < 2:
                continue
            bold = bold_inside(own, n, lambda m: m["tag"] in ("b", "strong") or (m["tag"] == "span" and "bold" in (m["attr_class"] or "").lower().split(" ")))
            if level_of(tag):
                level = min(6, level_of(tag) + 1)
            elif re.search("firsttitle|chapter-title|section-title", c):
                level = 2
            elif re.search("content_4|subtitle", c):
                level = 3 if bold else 0
            else:
                level = 4 if "content_5" in c else 0
            want[book, f, n["pos"], "heading" if level else "paragraph", n["text"], level] += 1
    assert Counter((r.doc_id, r.file_path, r.pos, r.type, r.text, r.level) for r in epub.blocks(nodes).collect()) == want


def words(t):
    return len(re.findall("[一-鿿]", t)) + len(re.findall("[a-zA-Z]+", t))


@pytest.fixture(scope="module")
def pages(spark):
    """One file a document."""
    rows = [(100 * b + int(f[0]), f, source(t)) for b, fs in BOOKS.items() for f, t in fs.items()]
    return sources_html.nodes(spark.createDataFrame(rows, "doc_id long, file_path string, html string")).cache()


def brute_pages():
    for (b, f), own in NODES.items():
        yield 100 * b + int(f[0]), own


@pytest.mark.parametrize("dedup", [False, True])
def test_html_chapters(pages, dedup):
    want = Counter()
    for doc, own in brute_pages():
        marks = [n for n in own if n["tag"] in ("h1", "h2")]
        index = 0
        for i, m in enumerate(marks):
            upto = marks[i + 1]["pos"] if i + 1 < len(marks) else 1 << 30
            title = m["text"] or (m["attr_title"] or "").strip()
            inside = [n for n in own if m["pos"] <= n["pos"] < upto and n["n_strings"] and (not dedup or n["parent"] < m["pos"])]
            flat, text = "".join(n["text"] for n in inside), "\n".join(n["lines"] for n in inside)
            rest = flat.replace(title, "", 1) if title else flat
            if title and (len(re.findall("[一-鿿]", rest)) > 3 or len(re.findall("[a-zA-Z]+", rest)) >= 5) and words(text):
                want[doc, index, title, words(text), text] += 1
                index += 1
        if not marks and (body := next((n for n in own if n["tag"] == "body"), None)) and words(body["lines"]):
            want[doc, 0, "正文", words(body["lines"]), body["lines"]] += 1
    assert Counter((r.doc_id, r.chapter_index, r.title, r.word_count, r.text) for r in html.chapters(pages, dedup).collect()) == want


def test_html_blocks(pages):
    kinds = {"h3": "heading", "ul": "list", "blockquote": "quote", "pre": "code"}
    want = Counter()
    for doc, own in brute_pages():
        seg = 0
        for n in own:
            seg += n["tag"] in ("h1", "h2")
            s, c = (n["attr_style"] or "").lower(), (n["attr_class"] or "").lower()
            if n["tag"] not in ("h1", "h2", "script") and n["text"]:
                bold = n["tag"] in ("b", "strong") or ("font-weight" in s and ("bold" in s or "700" in s)) or "bold" in c or "strong" in c
                italic = n["tag"] in ("i", "em") or ("font-style" in s and "italic" in s) or "italic" in c or "em" in c
                where = next((w for w in ("center", "right", "left") if "text-align" in s and w in s), None)
                want[doc, n["pos"], seg, kinds.get(n["tag"], "paragraph"), n["text"], bold, italic, where] += 1
    assert Counter((r.doc_id, r.pos, r.seg, r.type, r.text, r.bold, r.italic, r.alignment) for r in html.blocks(pages).collect()) == want
