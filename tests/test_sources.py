"""Files that can't be read fail alone, ids are paths, and results are written to one folder a file."""

import io
import struct
import zipfile

import pytest

from leafspine import __main__ as command
from leafspine.operators import prompt, render, tabular
from leafspine.plans import reading
from leafspine.sources import containers, parse
from leafspine.sources import html as sources_html

WORD = "word/document.xml"


def archive(name=WORD, text="<x/>", compression=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compression) as z:
        z.writestr(name, text)
    return out.getvalue()


def damaged():
    data = bytearray(archive(text="<x>" + "abc" * 500 + "</x>"))
    data[40:60] = b"\xff" * 20
    return bytes(data)


def encrypted():
    data = bytearray(archive())
    for magic, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        i = data.index(magic) + at
        data[i : i + 2] = struct.pack("<H", struct.unpack("<H", data[i : i + 2])[0] | 1)
    return bytes(data)


BROKEN = {"empty": b"", "no zip": b"PK nothing", "cut": archive()[:40], "deflate": damaged(), "encrypted": encrypted(), "no part": archive("other.xml"), "no xml": archive(text="<a"), "no body": archive(text="<a/>"), "method": archive().replace(b"\x08\x00", b"\x63\x00")}


@pytest.mark.parametrize("kind", ["docx", "epub"])
def test_damaged_containers(spark, kind):
    files = spark.createDataFrame([(n, bytearray(d)) for n, d in BROKEN.items()], "path string, content binary")
    assert {r.path for r in containers.readable(files, kind).filter("error is not null").collect()} == set(BROKEN)
    assert {"docx": containers.word_runs, "epub": containers.book_files}[kind](files).count() == 0


def test_csv_that_cannot_be_read(spark):
    rows = [(1, "csv", "a,b\rc,d\n1,2"), (2, "csv", "a,b\n" + "x" * 200_000 + ",2"), (3, "csv", None), (4, "tsv", "a\tb"), (5, "csv", "")]
    got = parse.csv_rows(spark.createDataFrame(rows, "doc_id long, ext string, content string"))
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, {})[r.row_no] = [len(c) for c in r.cells]
    assert by == {2: {0: [1, 1], 1: [200_000, 1]}, 3: {0: []}, 4: {0: [1, 1]}, 5: {0: []}}
    assert {r.doc_id for r in tabular.csv_header(got).collect()} >= {2, 4}


@pytest.mark.parametrize("content", ["[" * 100_000 + "]" * 100_000, '["' + chr(92) + 'ud800"]', '{"' + chr(92) + 'udc00": 1}', "1" * 6000, '{"a": 1} x', ""])
def test_json_that_cannot_be_read(content):
    assert parse.chapters_of_json(content) == [(1, "JSON内容", content, "code")]


def test_nested_json(spark):
    deep = "[" * 700 + "1" + "]" * 700
    rows = [(1, deep), (2, '{"k": "v"}'), (3, '["' + chr(92) + 'ud800"]'), (4, None)]
    got = {r.doc_id: (r.title, r.type) for r in parse.json_chapters(spark.createDataFrame(rows, "doc_id long, content string")).collect()}
    assert got[2] == ("k", "paragraph") and got[3] == got[4] == ("JSON内容", "code") and got[1][0] in ("第1项", "JSON内容")


def test_pages_that_cannot_be_parsed(spark):
    rows = [("a", "f", "<p>x<![foo bar><p>y"), ("b", "f", "<p>sound</p>"), ("c", "f", None), ("d", "f", "")]
    assert [(r.doc_id, r.text) for r in sources_html.nodes(spark.createDataFrame(rows, "doc_id string, file_path string, html string")).collect()] == [("b", "sound")]


def test_a_broken_file_of_each_format_beside_a_sound_one(spark, tmp_path):
    (tmp_path / "in").mkdir()
    bad = {"a.csv": b"a\rb", "b.json": b"[" * 50_000, "c.html": b"<![foo bar>", "d.docx": damaged(), "e.epub": encrypted(), "f.txt": b"sound", "g.htm": b"<h1>T</h1><p>one two three four five six</p>"}
    for name, data in bad.items():
        (tmp_path / "in" / name).write_bytes(data)
    df = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    got = {(r.path.rsplit("/", 1)[1], r.title) for r in reading.Reading(df, readers=["csv", "json", "html", "docx", "epub", "txt"]).chapters().collect()}
    assert got == {("b.json", "JSON内容"), ("f.txt", "章节 1"), ("g.htm", "T")}


def test_depth_has_no_bound(spark):
    chain = [(1, f"c{i}", f"c{i - 1}" if i else None, i + 1) for i in range(40)]
    circle, lost = [(1, "x", "y", 1), (1, "y", "x", 2), (1, "below", "x", 3)], [(1, "lost", "nowhere", 1), (1, "under", "lost", 2)]
    other = [(2, "c0", None, 9), (2, "c1", "c0", 8)]
    rows = spark.createDataFrame([*chain, *circle, *lost, *other], "doc_id int, chapter_id string, parent_id string, chapter_index int")
    out = render.hierarchy(rows)
    got = {(r.doc_id, r.chapter_id): r.hierarchy_path for r in out.collect()}
    want = {(1, f"c{i}"): ".".join(str(k + 1) for k in range(i + 1)) for i in range(40)} | {(2, "c0"): "9", (2, "c1"): "9.8"}
    assert got == want and out.columns == [*rows.columns, "hierarchy_path"]
    assert render.hierarchy(rows.limit(0)).count() == 0


def test_files_of_one_name_have_folders_of_their_own(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "x.txt").write_text(f"from {folder}")
    (tmp_path / "in" / "x.md").write_text("# M")
    (tmp_path / "in" / "alone.txt").write_text("alone")
    assert command.main([str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    made = sorted((tmp_path / "out").glob("*/*.md"))
    assert len(made) == 4 and len({m.parent for m in made}) == 4 and (tmp_path / "out" / "alone").is_dir()
    assert {w for m in made for w in ("from a", "from b", "# M", "alone") if w in m.read_text()} == {"from a", "from b", "# M", "alone"}
    assert command.main([]) == 2


def test_prompt_files(spark, tmp_path):
    for name, files in {"1_one": {"b.md": "# Title\nbody", "a.md": "# First\nx", "0.md": "no", "AI.md": "no"}, "2_two": {"c.md": "## only\ntext"}, "none": {"a.md": "x"}, "deep/3_three": {"d.md": "# D"}}.items():
        (tmp_path / name).mkdir(parents=True)
        for f, text in files.items():
            (tmp_path / name / f).write_text(text)
    assert command.main(["--prompts", str(tmp_path)]) == 0
    made = {str(p.parent.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob(prompt.FILE_NAME)}
    assert made.keys() == {"1_one", "2_two", "deep/3_three"}
    assert "章节：First" in made["1_one"] and "章节：2_two" in made["2_two"] and "章节：D" in made["deep/3_three"]


def test_files_go_to_a_store_by_uri(spark, tmp_path):
    rows = spark.createDataFrame([("f", "a.md", "old"), ("g", "b.md", "x")], "folder string, file_name string, text string")
    render.write_files(rows, tmp_path.as_uri()).collect()
    render.write_files(rows.replace("old", "new"), tmp_path.as_uri()).collect()
    assert (tmp_path / "f" / "a.md").read_text() == "new" and sorted(p.name for p in tmp_path.rglob("*.md")) == ["a.md", "b.md"] and not list(tmp_path.rglob(".??*"))


def test_laid_out_and_recognised_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.pdf", "b.pdf", "c.pdf", "d.txt"):
        (tmp_path / "in" / name).write_bytes(b"%PDF")
    files = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    path = {r.path.rsplit("/", 1)[1]: r.path for r in files.select("path").collect()}

    def page(name, lines):
        """Lines in a column in the middle of a tall page, each as one span."""
        return [(path[name], 0, 0, i, 0, t, size, "f", 100.0, 3000.0 + 40 * i, 260.0, 3000.0 + 40 * i + size, 600.0, 10000.0) for i, (t, size) in enumerate(lines)]

    body = [("body text of a line that is long enough to count", 12.0)] * 20
    spans = [*page("a.pdf", [("First", 20.0), *body, ("Second", 20.0), *body]), *page("b.pdf", [("Scan", 20.0), ("thin body text of it", 12.0), ("and no more of it", 12.0)]), ("/not/there.pdf", *page("b.pdf", [("x", 1.0)])[0][1:])]
    spans = spark.createDataFrame(spans, "path string, page_num int, block_no int, line_no int, span_no int, text string, size double, font string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double")
    box = [[1.0, 2.0], [9.0, 2.0], [9.0, 5.0], [1.0, 5.0]]
    seen = [(path[n], 0, [(box, "第1章 seen", 0.9), (box, f"text of {n}", 0.8), (box, "doubtful", 0.3)]) for n in ("a.pdf", "b.pdf", "c.pdf")]
    seen = spark.createDataFrame(seen, "path string, page_num int, lines array<struct<corners: array<array<double>>, text: string, confidence: double>>")

    def titles(reader):
        return {(r.path.rsplit("/", 1)[1], r.chapter_index, r.title) for r in reader.chapters().collect() if r.path.endswith("pdf")}

    laid = {("a.pdf", 1, "First"), ("a.pdf", 2, "Second"), ("b.pdf", 1, "Scan")}
    assert titles(reading.Reading(files, readers=["pdf", "txt"])) == set()
    assert titles(reading.Reading(files, spans, readers=["pdf"])) == laid
    assert titles(reading.Reading(files, None, seen, ["pdf"])) == {(f"{n}.pdf", 1, "第1章 seen") for n in "abc"}
    both = reading.Reading(files, spans, seen, ["pdf"])
    assert titles(both) == {("a.pdf", 1, "First"), ("a.pdf", 2, "Second"), ("b.pdf", 1, "第1章 seen"), ("c.pdf", 1, "第1章 seen")}
    blocks = {(r.path.rsplit("/", 1)[1], r.chapter_index, r.type, r.text) for r in both.blocks().collect()}
    assert {("a.pdf", 1, "heading", "First"), ("a.pdf", 2, "paragraph", body[0][0]), ("b.pdf", 1, "paragraph", "text of b.pdf")} <= blocks
    made = {(r.path.rsplit("/", 1)[1], r.chapter_index): r.markdown for r in both.markdown("2025-01-01 00:00").collect()}
    assert body[0][0] in made["a.pdf", 1] and "text of c.pdf" in made["c.pdf", 1] and "doubtful" not in made["c.pdf", 1]
