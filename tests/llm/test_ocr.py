import random

import pytest

from tidegraph.llm import ocr as O

SCHEMA = "page_key long, file_id string, page_no int, text_list string, loaded_at string"
WORDS = "management county basin water level pumping agency measured model groundwater district storage plan board yield sustainable recharge river monitoring permit".split()


def corpus():
    """(pages, lines with noise): clean files, and a scanned one with noise planted."""
    rng, rows, want = random.Random(11), [], set()

    def line():
        return "the " + " ".join(rng.choice(WORDS) for _ in range(8)) + "."

    for f in range(4):
        rows += [(100 * f + p, f"clean_{f}", p, "\n".join(line() for _ in range(12)) + "\nthe year-round H2O level of Zone 1l was 2014 or 2011 at most.") for p in range(1, 9)]
    for p in range(1, 11):
        lines = ["Marlow Ridge Basin Plan", *[line() for _ in range(10)], "", f"p. {p}"]
        key = 1000 + p
        want |= {(key, 1, "header"), (key, 13, "page_number")}
        lines[3] = lines[3].replace(lines[3].split()[2], {"management": "rnanagement"}.get(lines[3].split()[2], lines[3].split()[2][:2] + "~" + lines[3].split()[2][2:]), 1)
        want.add((key, 4, "ocr"))
        lines[5], lines[6] = "the plan of the sustain-", "able yield was measured."
        want.add((key, 6, "hyphen"))
        lines[7], lines[8] = "the level of the year-", "round storage was modeled since 2O14 and 201l."
        want.add((key, 9, "ocr"))
        rows.append((key, "scan_marlow_ridge", p, "\n".join(lines)))
    return [(*r, "x") for r in rows], want


def test_planted_noise_is_found(spark):
    rows, want = corpus()
    rows += [rows[-1], (5000, "clean_0", 99, None, "x"), (5001, "clean_0", 98, "", "x"), (5002, None, None, "the water level.", "x"), (5003, "clean_1", 97, "Q" * 9000, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in O.noise(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert O.noise(df.limit(0)).count() == 0 and O.repair(df.limit(0)).count() == 0


def test_repair(spark):
    rows, _ = corpus()
    text = "\n".join(r.paragraph for r in O.repair(spark.createDataFrame(rows, SCHEMA)).where("page_key = 1003").orderBy("paragraph_no").collect())
    assert "sustainable yield was measured." in text and "year-round storage" in text and "2014 and 2011" in text
    assert "Marlow" not in text and "p. 3" not in text and "~" not in text and "\n" not in text.strip().split("  ")[0][:60]


def test_splits_merges_and_first_words(spark):
    """A stray blank, a lost line-end hyphen, two words run together, one of them misread, and a misreading that begins a page."""
    rows, want = corpus()
    lines = ["rnonitoring of the plan.", "the manage ment of the basin.", "the waterlevel of the plan.", "the plan of the ground", "water was measured.", "the agency measu", "red the basin.", "the rnanage ment of it.", "the basinmodcl of it.", "the moni-", "tormg of it."]
    rows.append((2000, "clean_0", 50, "the ground of the plan.\nthe ground of the basin.", "x"))
    rows.append((1050, "scan_marlow_ridge", 50, "\n".join(lines), "x"))
    df = spark.createDataFrame(rows, SCHEMA)
    extra = {(1050, n, "ocr") for n in (1, 2, 3, 6, 8, 9, 11)} | {(1050, 10, "hyphen")}
    assert {tuple(r) for r in O.noise(df).collect()} == want | extra
    text = " ".join(r.paragraph for r in O.repair(df).where("page_key = 1050").orderBy("paragraph_no").collect())
    assert text == "monitoring of the plan. the management of the basin. the water level of the plan. the plan of the ground water was measured. the agency measured the basin. the management of it. the basin model of it. the monitoring of it."


def test_strokes_bring_confusions_together():
    for a, b in [("rnodel", "model"), ("rcdiice", "reduce"), ("bounclary", "boundary"), ("recurrmg", "recurring"), ("smce", "since"), ("Coahtion", "coalition"), ("armually", "annually"), ("he~adgate", "headgate"), ("ſiscal", "fiscal"), ("Coun†y", "county"), ("wäter", "water"), ("5teeper", "steeper"), ("be|ow", "below")]:
        assert O.strokes(a) == O.strokes(b)


@pytest.mark.parametrize(
    ("line", "page", "is_number"),
    [("p. 12", 12, True), ("- 7 -", 7, True), ("Page 3 of 40", 3, True), ("C-5", 5, True), ("ix", 9, True), ("12 | P a g e", 12, True), ("l2", 12, True), ("p. l2", 12, True), ("2014", 12, False), ("", 1, False), ("5 wells", 5, False), ("1O", 10, True)],
)
def test_page_numbers(line, page, is_number):
    assert O.is_page_number(line, page) is is_number


def test_heads():
    assert O.head_forms("   Some Basin Plan     33", 33) == [("some basin plan", True, True)]
    assert ("adopted 2003", True, False) in O.head_forms("Well Inventory       Adopted 2003", 8)
    assert [f[1:] for f in O.head_forms(":ome Basin Plan", 8)] == [(False, False)]  # damaged: no head by itself
    assert O.head_forms("a line of prose that goes on", 1) == [] and O.head_forms("4.2 Well Inventory", 1) == [] and O.head_forms("12", 3) == []
    assert not any(f == "well 12-b" for f, *_ in O.head_forms("Well 12-B       canal      2,743   46.3", 3))


def test_paragraphs_by_dynamic_programming():
    lines = [["One line of the first paragraph that is wide", ""], ["goes on here and ends.", ""], ["A second one begins and is as wide as it", ""], ["can be.", ""], ["- a bullet", ""]]
    assert O.paragraphs(lines, [False, False, True, False, False]) == ["One line of the first paragraph that is wide goes on here and ends.", "A second one begins and is as wide as it can be.", "- a bullet"]
    assert O.paragraphs([["sus-", "join"], ["tain it.", ""]], [False, True]) == ["sustain it."] and O.paragraphs([], []) == []


def test_a_lone_fragment_joins_a_neighbour():
    """Boundaries depend on each other: a line that can't stand alone keeps only one of the two blank lines around it."""
    whole = [["The board of the county met on Monday and set the rate of the wells.", ""], ["Pumping in Rivers and Lakes of the county and in every basin of the valley", ""], ["Rose to nine feet in the year before, as the hydrologist had said to them.", ""]]
    assert len(O.paragraphs(whole, [False, True, True])) == 2
    title = [["The board of the county met on Monday and set the rate of the wells.", ""], ["Rivers and Lakes", ""], ["Pumping rose to nine feet in the year before, as the hydrologist had said.", ""]]
    assert len(O.paragraphs(title, [False, True, True])) == 3


def test_only_what_may_be_wrong_leaves_the_page_functions(spark, monkeypatch):
    """Words and pairs are counted by batch, and only pages, words and runs that may be wrong are asked for; repeats count once."""
    made = {}

    def noted(df):
        made[tuple(df.columns)] = out = cut(df)
        return out

    cut = O.cut
    monkeypatch.setattr(O, "cut", noted)
    rows, want = corpus()
    df = spark.createDataFrame(rows + rows[:5] + rows[-5:], SCHEMA)
    assert {tuple(r) for r in O.noise(df).collect()} == want
    looked = made["page_key", "keys", "other", "words", "size", "strokes", "m"]
    asked = looked.where("words is null")
    assert asked.select("page_key").distinct().count() == 10  # the scanned pages
    words = {k[2:] for r in asked.collect() for k in r["keys"] if k[:2] == "t:"}
    assert "2o14" in words and not words & {"the", "water", "level"}
    assert looked.where("words is not null").count() < 100  # hundreds of pairs stand side by side


def test_counts_by_batch():
    """Counting by token gives what ``countable`` gives by line, with every kind of line end."""
    text = "The ground-\nwater of the year-round plan¬\n-\n ning – and\r\nwell/head-\xa0\nworks — a-\nb-\n\ncut~\n  end"
    import pyarrow as pa

    for lead in (False, True):
        for skip in (None, [2], [1, 9]):
            row = {"text": text, "skip": skip, "scanned": True, "lead": lead}
            batch = pa.RecordBatch.from_pylist([row] * 3, pa.schema([("text", pa.string()), ("skip", pa.list_(pa.int32())), ("scanned", pa.bool_()), ("lead", pa.bool_())]))
            got = {(w, c): n for w, c, _, clean, n in O._count_batches(iter([batch])) if n and not clean}
            lines = text.split("\n")
            want = O.Counter(O.countable(lines, O.content_lines(lines, set(skip or ())), lead))
            assert got == {k: 3 * n for k, n in want.items()}


def test_page_number_is_taken_off_a_head():
    for line, page, form in [("12 Basin Plan", 12, "basin plan"), ("Basin Plan page 7 -", 7, "basin plan"), ("Basin Plan 17", 7, "basin plan 17"), ("Basin Plan_7", 7, "basin plan_7"), ("p. 3 | Basin Plan", 3, "basin plan"), ("Basin Planp. 3", 3, "basin plan"), ("3 Basin Plan 3", 3, "basin plan"), ("## Basin Plan 3_", 3, "basin plan 3_")]:
        assert O._head_form(line, page)[0] == form, line


def test_lines_near_a_doubtful_word():
    assert O.near([2, 3, 5, 8, 9, 12, 14], {3}) == [[2, 3, 5]]
    assert O.near([2, 3, 5, 8, 9, 12, 14], {2, 9}) == [[2, 3], [8, 9, 12]]
    assert O.near([2, 3, 5, 8, 9, 12, 14], {2, 8, 14}) == [[2, 3, 5, 8, 9, 12, 14]]
