"""The window folds against sequential restatements of the same rules, on random documents."""

import random

from leafspine.operators import code, pdf, txt
from leafspine.plans import fixtures, oracle, registered

PIECES = ["", "text", "# h", "## h", "- a", "* b", "+ c", "1. d", "2) e", "> q", ">", "```", "```py", "```py x", "第3章 x", "Chapter 3", "**b**", "---", "#tag", "  - in"]


def is_chapter(s):
    return s.startswith("第3章") or s.lower().startswith("chapter 3")


def sequential_blocks(lines):
    """Reads lines one after the other; (type, text) of each block."""
    import re

    out, i = [], 0
    item = re.compile(r"([-*+]|\d+[.)])\s+(.+)$")
    while i < len(lines):
        s = lines[i].strip()
        if not s:
            i += 1
        elif s.startswith("```"):
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip() == "```"), len(lines))
            out.append(("code", "\n".join(lines[i + 1 : end])))
            i = end + 1
        elif m := re.match(r"#{1,6}\s+(.+)$", s):
            out.append(("heading", m.group(1)))
            i += 1
        elif item.match(s):
            items, ordered = [], False
            while i < len(lines) and (not lines[i].strip() or item.match(lines[i].strip())):
                if m := item.match(lines[i].strip()):
                    items.append(m.group(2))
                    ordered = m.group(1)[0].isdigit()
                i += 1
            out.append(("list", "\n".join(("1. " if ordered else "- ") + x for x in items)))
        elif s.startswith(">"):
            quoted = []
            while i < len(lines) and (not lines[i].strip() or lines[i].strip().startswith(">")):
                if t := lines[i].strip():
                    quoted.append(t[1:].strip())
                i += 1
            out.append(("quote", "\n".join(quoted)))
        elif is_chapter(s):
            out.append(("heading", s))
            i += 1
        elif s[0] in "#-*":
            i += 1
        else:
            para = []
            while i < len(lines) and (t := lines[i].strip()) and t[0] not in "#>-*" and not t.startswith("```") and not is_chapter(t):
                para.append(t)
                i += 1
            out.append(("paragraph", " ".join(para)))
    return out


def random_lines(n, pieces, seed):
    r = random.Random(seed)
    return [[r.choice(pieces) for _ in range(r.randint(1, 14))] for _ in range(n)]


def frame(spark, docs):
    rows = [(d, i, line) for d, lines in enumerate(docs) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "doc_id long, pos int, line string")


def by_doc(rows, value, order="pos"):
    out = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r[order])):
        out.setdefault(r.doc_id, []).append(value(r))
    return out


def test_text_blocks(spark):
    docs = random_lines(1500, PIECES, 1)
    got = by_doc(txt.blocks(frame(spark, docs)).collect(), lambda r: (r.type, r.text))
    for d, lines in enumerate(docs):
        assert got.get(d, []) == sequential_blocks(lines), lines


def test_every_line_is_in_one_block(spark):
    docs = random_lines(300, PIECES, 2)
    classified = txt.classify_lines(frame(spark, docs))
    numbered = txt.number_blocks(classified)
    assert numbered.count() == classified.filter("cls not in ('B', 'D')").count()


def sequential_comments(lines):
    out, now, inside = [], [], False

    def flush():
        if now:
            out.append(" ".join(now))
            now.clear()

    for line in lines:
        s = line.strip()
        if s.startswith("//"):
            now += [x for x in [s[2:].strip()] if x]
        elif s.startswith("/*"):
            inside = True
            now += [x for x in [s[2:].strip()] if x and not x.startswith("*")]
        elif s.endswith("*/"):
            inside = False
            flush()
        elif inside:
            now += [x for x in [s.lstrip("*").strip()] if x]
        else:
            flush()
    flush()
    return out


def test_comments(spark):
    docs = random_lines(800, ["// a", "//", "/* b", "/** c", "* d", "e */", "*/", "code", "", "/* f */", "** g"], 3)
    got = by_doc(code.slash_comments(frame(spark, docs)).collect(), lambda r: r.comment)
    for d, lines in enumerate(docs):
        assert got.get(d, []) == sequential_comments(lines), lines


def sequential_independence(rows):
    """rows: (level, body sized and long, ends with a period and longer than 5)."""
    out = []
    for i, (own, _, _) in enumerate(rows):
        if own == 0:
            continue
        answer = False
        for j in range(i + 1, min(i + 30, len(rows))):
            level, body, period = rows[j]
            if level:
                if level == 3 and own in (1, 2):
                    found = False
                    for k in range(j + 1, min(j + 10, len(rows))):
                        if rows[k][1]:
                            found = True
                            break
                        if rows[k][0]:
                            break
                    if found:
                        answer = True
                        break
                elif level > own:
                    break
                continue
            if body or period:
                answer = True
                break
        out.append(answer)
    return out


def test_independence(spark):
    r = random.Random(4)
    docs = [[(r.choice([0, 0, 1, 2, 3]), r.random() < 0.15, r.random() < 0.1) for _ in range(r.randint(1, 40))] for _ in range(800)]
    rows = [(d, i, level, body, period, "long enough text" if body else "medium" if period else "x") for d, own in enumerate(docs) for i, (level, body, period) in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, level int, body_sized boolean, period boolean, text string")
    got = by_doc(pdf.independence(df).filter("level > 0").collect(), lambda x: x.independent)
    for d, own in enumerate(docs):
        assert got.get(d, []) == sequential_independence(own), own


def sequential_notes(rows):
    out, inside = [], False
    for note, ends in rows:
        inside = True if note else False if ends else inside
        out.append(inside)
    return out


def test_notes(spark):
    r = random.Random(5)
    docs = [[r.choice([(True, False), (False, True), (False, False), (False, False)]) for _ in range(r.randint(1, 15))] for _ in range(300)]
    rows = [(d, i, note, "x", 1.5 if ends else 1.0) for d, own in enumerate(docs) for i, (note, ends) in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, note boolean, s string, ratio double")
    got = by_doc(pdf.in_notes(df).collect(), lambda x: x.in_note)
    assert got == {d: sequential_notes(own) for d, own in enumerate(docs)}


def test_one_exchange(spark):
    """Lines to chapters cost one exchange on the document's id."""
    df = txt.chapters(txt.blocks(frame(spark, [["# a", "b"]])))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in plan and "MapInArrow" not in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        physical = txt.chapters(txt.blocks(frame(spark, [["# a", "b"]])))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert physical.count("Exchange hashpartitioning") == 1


def test_registered_names():
    assert set(oracle.ORACLE_SQL) <= set(registered.QUERIES)
    assert fixtures.case_of((3, {0: "'x'"})) == "CASE WHEN pos % 3 = 0 THEN 'x' ELSE line END"
