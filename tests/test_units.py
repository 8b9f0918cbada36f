"""Atoms and units against a plain walk over the lines of each text."""

import random
import re

import pytest

from factloom.operators import units

TABLE, HEADING, LIST = re.compile(units.TABLE), re.compile(units.HEADING.replace(r"\z", r"\Z")), re.compile(units.LIST_LINE)
T = "<table><tr><td>1</td></tr></table>"


def plain_atoms(text):
    """(kind, path, segment, start, end) of each atom, and the places of tables."""
    tables = [m.span() for m in TABLE.finditer(text)]
    out, path, segment, begin = [], [], 0, 0
    for k, (stop, after) in enumerate([*tables, (len(text), None)]):
        previous, at = None, begin
        for line in text[begin:stop].split("\n"):
            m = HEADING.match(line)
            kind = None if not line.strip() else "heading" if m else "list" if LIST.match(line) else "paragraph"
            if kind == "heading":
                path, segment = [x for x in path if x[0] < len(m[1])] + [(len(m[1]), m[2].strip())], segment + 1
            if kind and kind == previous and kind != "heading":
                out[-1][4] = at + len(line)
            elif kind:
                out.append([kind, [t for _, t in path], segment, at, at + len(line)])
            previous, at = kind, at + len(line) + 1
        begin, segment = after, segment + 1
    return out, tables


def plain_units(text, target, most):
    out, open_ = [], False
    for kind, path, segment, start, end in plain_atoms(text)[0]:
        if kind == "heading":
            open_ = False
            continue
        if open_ and out[-1][0] == segment and end - out[-1][2] <= most:
            out[-1][3] = end
        else:
            out.append([segment, path, start, end])
        open_ = end - out[-1][2] < target
    return out


def beside(atoms, tables):
    found = []
    for kind, _, _, start, end in atoms:
        own = []
        for n, (a, b) in enumerate(tables):
            between = lambda lo, hi: any(lo <= x[3] and x[4] <= hi for x in atoms) or any(lo <= c and d <= hi for c, d in tables)  # noqa: B023, E731
            if kind != "heading" and b <= start and not between(b, start):
                own.append((n, "after", start - b))
            if kind != "heading" and end <= a and not between(end, a):
                own.append((n, "before", a - end))
        found.append(sorted(own))
    return found


def texts():
    rng = random.Random(5)
    pieces = ["# A", "## B #", "### C", "", "  ", "- x y", "1. one", "一、项", "words " * 4, "long " * 30, T, f"a{T}b", f"{T}{T}", "<TABLE>\n\n# no\n</ table >", "#no heading", "\tindented", "é\U0001f600 signs"]
    return [None, "", "\n\n", T, f"x{T}", f"{T}\nx", *["\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(60)]]


@pytest.mark.parametrize("target, most", [(40, 90), (1, 1), (900, 1800)])
def test_units_of_all_texts(spark, target, most):
    given = texts()
    rows = spark.createDataFrame(list(enumerate(given)), "id int, text string")
    got = {}
    for r in units.packed_units(rows, "id", "text", target, most).collect():
        got.setdefault(r.id, []).append(r)
    for i, text in enumerate(given):
        own = sorted(got.get(i, []), key=lambda r: r.unit)
        assert [[r.segment, r.heading_path, r.start, r.end] for r in own] == plain_units(text or "", target, most), i
        assert all(r.content == text[r.start : r.end] and r.oversize == (len(r.atoms) == 1 and r.end - r.start > most) for r in own)
        kept, tables = plain_atoms(text or "")
        marks = beside(kept, tables)
        for r in own:
            inside = [(x, m) for x, m in zip(kept, marks) if r.start <= x[3] and x[4] <= r.end and x[0] != "heading"]
            assert r.kinds == sorted({x[0] for x, _ in inside}) and len(r.atoms) == len(inside)
            assert r.tables == sorted({n for _, m in inside for n, _, _ in m})


def test_atoms_of_all_texts(spark):
    given = texts()
    rows = spark.createDataFrame(list(enumerate(given)), "id int, text string")
    got = {}
    for r in units.atoms_of(units.marked_lines(rows, "id", "text"), "id").collect():
        got.setdefault(r.id, []).append(r)
    for i, text in enumerate(given):
        want, tables = plain_atoms(text or "")
        own = sorted(got.get(i, []), key=lambda r: r.atom)
        assert [[r.kind, r.heading_path, r.segment, r.start, r.end] for r in own] == want, i
        assert [r.content for r in own] == [text[x[3] : x[4]] for x in want]
        assert [sorted(tuple(t) for t in r.tables) for r in own] == beside(want, tables), i


def test_no_documents_and_a_bad_target(spark):
    rows = spark.createDataFrame([], "id int, text string")
    assert units.packed_units(rows, "id", "text").count() == 0
    with pytest.raises(ValueError):
        units.packed_units(rows, "id", "text", 10, 5)
