"""Pages, names, acronyms, rules, suggestions and the annotator."""

import warnings

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_crawl import SCHEMA, sentence
from tidegraph.functions.entities import clean_entities
from tidegraph.operators import acronyms as A
from tidegraph.operators import disambiguate as D
from tidegraph.operators import entities as E
from tidegraph.operators.annotate import RuleAnnotator, concatenate_phrases, keep_hyphens, parse_files, parse_text, save_tokens, should_parse
from tidegraph.operators.extract import extract_network, read_extract, write_extract
from tidegraph.plans.text import QUERIES
from tidegraph.sources import lexicon as L
from tidegraph.sources import pages as P

PROSE = "The board of the water agency held that the draft plan for the lower basin was not yet complete and sent it back."


def test_head_and_foot_trimming():
    body = [PROSE, PROSE, PROSE]
    page = ["A Title", "Draft 3", "", *body, "", "© Some Group", "  12"]
    assert P.trim_page("\n".join(page)) == "\n".join(["", *body])
    assert P.trim_page("\n".join(body)) == "\n".join(body)  # no blank line: nothing is a foot
    assert P.trim_page("A\nB") is None and P.trim_page(None) is None and P.trim_page("") is None
    assert P.trim_page("\n".join([*body, "", PROSE])) == "\n".join([*body, "", PROSE])  # prose below protects all
    assert P.trim_page(PROSE + "    C-28") == PROSE and P.trim_page(PROSE + " Page 9 ") == PROSE + " "
    many = [*body, "", *["foot"] * 6]
    assert P.trim_page("\n".join(many)) == "\n".join(many)  # more than four lines aren't a foot


def test_page_selection_and_guard(spark):
    pages = spark.createDataFrame([("f", i, "x" * i * 10) for i in (1, 2, 3)] + [("f", 4, None)], "file_id string, page_no int, text string")
    assert [r.page_no for r in P.keep_pages(pages, [2, 2, 1]).orderBy("page_no").collect()] == [1, 2]
    assert P.keep_pages(pages, [True, False, False, True]).count() == 2 and P.keep_pages(pages, [True]).count() == 4
    for bad in ([5], [0], [1.5], [True, False]):
        with pytest.raises(ValueError):
            P.keep_pages(pages, bad)
    assert [r.text is None for r in P.page_guard(pages, max_chars=20).orderBy("page_no").collect()] == [False, False, True, True]
    assert P.clean_pages(pages.limit(0)).count() == 0
    assert P.ocr_fallback(pages, lambda f, n: f"read {n}").where("text = 'read 1'").count() == 1


def test_page_selection_over_files_of_all_lengths(spark, tmp_path):
    """Pages 1 to 3 of a corpus in which a file has two pages; by default a number beyond a file's last page stays an error."""
    rows = [(i, "long", i, "x") for i in (1, 2, 3, 4)] + [(10 + i, "short", i, "x") for i in (1, 2)]
    spark.createDataFrame(rows, "page_key long, file_id string, page_no int, text_list string").write.parquet(str(tmp_path / "text_list.parquet"))
    assert sorted(r.page_key for r in QUERIES["page_selection"](spark, str(tmp_path)).collect()) == [1, 2, 3, 11, 12]
    pages = spark.read.parquet(str(tmp_path / "text_list.parquet"))
    with pytest.raises(ValueError):
        P.keep_pages(pages, [1, 2, 3])
    with pytest.raises(ValueError):
        P.keep_pages(pages, [0, 1], beyond="none")
    assert P.keep_pages(pages, [], beyond="none").count() == 0


def test_tokens_leave_the_annotator_in_bounded_parts(spark, monkeypatch):
    """What a task holds doesn't grow with the pages of a batch."""
    taken, frames = [], type(spark.range(1))
    for name in ("mapInPandas", "mapInArrow"):
        monkeypatch.setattr(frames, name, lambda df, f, schema, *a, kept=getattr(frames, name), **k: taken.append(f) or kept(df, f, schema, *a, **k))
    pages = [("f", n, f"The Board met the Agency on page {n}. It met again.") for n in range(1, 3001)]
    parsed = parse_text(spark.createDataFrame(pages, "file_id string, page_no int, text string"), RuleAnnotator(["met"]))
    frame = pd.DataFrame(pages, columns=["file_id", "page_no", "text"])
    try:
        parts = [len(x) for x in taken[-1](iter([frame]))]
    except AttributeError:
        parts = [x.num_rows for x in taken[-1](iter([pa.RecordBatch.from_pandas(frame)]))]
    assert sum(parts) == parsed.count() == 3000 * 13 and max(parts) < 10_100
    words = "Board met " * 3 + "the plan " * 2
    heads = [t[4] for t in next(iter(RuleAnnotator(["met"])(words)))]
    assert heads == [2, 2, 2, 2, 4, 2, 8, 6, 10, 6]


def test_page_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo")
    assert sorted((r.file_id, r.page_no, r.text) for r in P.read_text_pages(spark, str(tmp_path)).collect()) == [("a.txt", 1, "one"), ("a.txt", 2, "two")]
    got = P.read_binary_pages(spark, str(tmp_path), lambda b: [b.decode()], "*.txt").collect()
    assert [(r.file_id, r.page_no, r.text) for r in got] == [("a.txt", 1, "one\ftwo")]


def test_name_cleaning(spark):
    names = ["Agency's", "Agency_s", "𝐴𝑏ℎ_x", "San_José!", "__a__b_", "1234", None, "", "A&B"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(clean_entities(F.col("n"))).collect()] == ["Agency", "Agency", "Abh_x", "San_José", "a_b", "", "", "", "AB"]
    assert df.select(clean_entities(F.col("n"), remove_nums=False)).collect()[5][0] == "1234"


def test_acronyms(spark):
    texts = [
        "The Great Basin Authority (GBA) met.", "See WQO (Water Quality Office).", "The Big Dog (BD) and the Bad Day (BD).", None, "", "(X) no", "x (A)",
        "Sub-basin Plan (SP) again",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {(r.name, r.acronym) for r in A.find_acronyms(df).collect()}
    assert ("Great_Basin_Authority", "GBA") in got and ("Water_Quality_Office", "WQO") in got and not any(a == "BD" for _, a in got)
    tables = spark.createDataFrame([("GBA      Green Bay Area\nDWP      Dry Well Program\none   two   three",)], "text string")
    both = {r.acronym: r.name for r in A.find_acronyms(df, tables=tables).collect()}
    assert both["GBA"] == "Great_Basin_Authority" and both["DWP"] == "Dry_Well_Program"
    assert A.find_acronyms(df.limit(0)).count() == 0


def test_rule_checks():
    with pytest.raises(ValueError):
        D.compile_rules(["a", "a"], ["b", "c"])
    with pytest.raises(ValueError):
        D.compile_rules(["a"], ["b", "c"])
    with pytest.raises(ValueError):
        D.compile_rules([["a", "b"]], ["c"])
    with pytest.raises(ValueError):
        D.compile_rules(["a"], [["b", "c"]], True)
    with pytest.warns(UserWarning):
        assert D.compile_rules(["a"], ["a_b"], True).exact == {"a": "a_b"}
    with pytest.warns(UserWarning):
        r = D.compile_rules(["a", "b"], ["b", "a"])
    assert len(r.exact) == 1
    assert D.compile_rules(["a", "b"], ["b", "c"]).exact == {"a": "c", "b": "c"}
    assert D.compile_rules(["a", "b"], ["b", "c"], recursive=False).exact == {"a": "b", "b": "c"}


def rewritten(spark, names, rules, **options):
    df = spark.createDataFrame([(n,) for n in names], "n string")
    return sorted((r.n for r in D.rewrite(df, "n", rules, **options).collect()), key=str)


def test_rewriting(spark):
    assert rewritten(spark, ["the_MA", "Mass", None], D.compile_rules(["MA", "Mass"], ["Mass", "Massachusetts"])) == ["Massachusetts", "Massachusetts", None]
    assert rewritten(spark, ["MA"], D.compile_rules(["MA", "Mass"], ["Mass", "Massachusetts"], recursive=False)) == ["Mass"]
    assert rewritten(spark, ["both"], D.compile_rules(["both"], [["x", "y"]])) == ["x", "y"]
    r = D.compile_rules(["WD"], ["Water_District"], True)
    assert rewritten(spark, ["WD", "Big_WD", "WD_Two", "AWD"], r) == ["AWD", "Big_Water_District", "Water_District", "Water_District_Two"]
    assert rewritten(spark, ["x"], D.compile_rules(["x"], ["a$1\\b"])) == ["a$1\\b"]
    assert rewritten(spark, ["Upper_MA", "Upper_Z"], D.compile_rules(["MA"], ["Mass"]), try_drop="^Upper_") == ["Mass", "Upper_Z"]


def test_disambiguation_of_a_network(spark):
    nodes = spark.createDataFrame([("g", "DWR", "ORG", 5), ("g", "Dept_W", "GPE", 2), ("g", "X", None, 1), ("g", "Old_X", "ORG", 3)], "graph_id string, entity_name string, entity_type string, num_appearances long")
    edges = spark.createDataFrame([("g", "v1", "Dept_W", "X"), ("g", "v1", None, "X"), ("g", "v2", "DWR", None), ("g", "v3", "Old_X", "")], "graph_id string, doc_sent_verb string, source string, target string")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        n, e = D.disambiguate(nodes, edges, D.compile_rules(["Dept_W"], ["DWR"]), try_drop="^Old_")
    assert {(r.entity_name, r.entity_type, r.num_appearances) for r in n.collect()} == {("dwr", "ORG", 7), ("x", "ORG", 4)}
    assert {(r.doc_sent_verb, r.source, r.target, r.edgeiscomplete) for r in e.collect()} == {("v1", "dwr", "x", True), ("v2", "dwr", None, False), ("v3", "x", None, False)}
    again = D.disambiguate(n, e, D.compile_rules(["Dept_W"], ["DWR"]))[0]
    assert sorted(again.collect()) == sorted(n.collect())


TOKENS = sentence(1, ("Central", "PROPN", 3, "nsubj"), ("Valley", "PROPN", 3, "nsubj"), ("Board", "PROPN", 3, "nsubj"), ("met", "VERB", 4, "ROOT"), ("it", "PRON", 4, "dobj"))


def test_entity_lists(spark, tmp_path):
    spec = E.specify_names(spark, ["Central Valley", "x"], ["GPE", "Y"], aliases=["CV;the Valley", ""])
    assert sorted(" ".join(r.tokens) for r in spec.collect()) == ["central valley", "cv", "the valley", "x"]
    review = spark.createDataFrame([("Big Dam", "yes", "LOC", " "), ("No", "", "LOC", "FAC"), ("Old Mill", "1", "LOC", "FAC")], "phrase string, keep string, suggested_label string, final_label string")
    assert {(" ".join(r.tokens), r.label) for r in E.entity_specify(review).collect()} == {("big dam", "LOC"), ("old mill", "FAC")}
    with pytest.raises(ValueError):
        E.entity_specify(spark.createDataFrame([("a",)], "entity_names string"))
    (tmp_path / "e.tsv").write_text("entity_names\tentity_label\tcase_sensitive\twhole_word_only\taliases\nA B\tORG\ttrue\tfalse\t\n")
    row = E.entity_specify(E.read_entity_file(spark, f"{tmp_path}/e.tsv")).first()
    assert row.text == "A B" and row.tokens is None and row.case_sensitive
    with pytest.raises(ValueError):
        E.read_entity_file(spark, "x.xlsx")


def test_ruler_and_custom_entities(spark):
    t = spark.createDataFrame(TOKENS, SCHEMA)
    spec = E.specify_names(spark, ["Central Valley Board", "valley board", "Board met"], ["ORG", "LOC", "X"])
    assert [(r.start, r.n, r.label) for r in E.ruler_matches(t, spec).collect()] == [(1, 3, "ORG")]
    assert [r.entity for r in E.apply_ruler(t, spec).orderBy("token_id").collect()] == ["ORG_B", "ORG_I", "ORG_I", "", ""]
    tagged = t.withColumn("entity", F.when(F.col("token_id") == 2, "GPE_B").otherwise(""))
    assert [r.entity for r in E.apply_ruler(tagged, spec, False).orderBy("token_id").collect()] == ["", "GPE_B", "", "", ""]
    custom = E.custom_entities(tagged, {"A": ["Valley", "Board"], "B": ["Board"]})
    assert [r.entity for r in custom.orderBy("token_id").collect()] == ["", "GPE_B", "A_B", "", ""]


def test_sentence_and_language_filter(spark):
    t = spark.createDataFrame(TOKENS + sentence(2, ("zz", "NOUN", 1, "ROOT"), ("it", "PRON", 1, "dobj")), SCHEMA)
    words = spark.createDataFrame([("central",), ("met",), ("it",)], "word string")
    assert {r.sentence_id for r in E.filter_sentences(t, words, 60).collect()} == {1}
    assert E.language_share(t, words).first().share == pytest.approx(4 / 7)


def test_suggestions(spark, tmp_path):
    t = spark.createDataFrame(TOKENS + [(*r[:2], 2, *r[3:]) for r in TOKENS], SCHEMA)
    got = {r.phrase: r for r in E.suggest_entities(t).collect()}
    assert got["Central Valley Board"].frequency == 4 and got["Central Valley Board"].suggested_label == "ORG" and got["Valley"].suggested_label == "LOC"
    assert got["Central"].context_examples == "Central Valley Board met it | Central Valley Board met it"
    assert E.suggest_entities(t.limit(0)).count() == 0
    E.write_suggestions(E.suggest_entities(t, include_context=False), f"{tmp_path}/s")
    assert spark.read.csv(f"{tmp_path}/s", header=True).columns[-2:] == ["keep", "final_label"]


def test_annotator_and_saving(spark, tmp_path):
    pages = spark.createDataFrame([("f", 1, "The Water Agency manages the Lower Basin. It is well-known."), ("f", 2, None), ("g", 1, "")], "file_id string, page_no int, text string")
    parsed = parse_text(pages, RuleAnnotator(["manage"]), keep_hyph_together=True, phrases=["Water Agency"], custom={"RIVER": ["well_known"]})
    rows = {r.token: r for r in parsed.collect()}
    assert rows["Water_Agency"].dep_rel == "nsubj" and rows["well_known"].entity == "RIVER_B" and {r.doc_id for r in rows.values()} == {"text1"}
    lexicon = spark.createDataFrame([], "verb string, classes array<string>, type_name array<string>, type_id array<string>")
    e = extract_network(parsed, lexicon, ("ORG",))
    assert [(r.source, r.target, r.head_verb_lemma) for r in e.edges.collect()] == [("Water_Agency", "Lower_Basin", "manage")]
    write_extract(e, f"{tmp_path}/x")
    assert read_extract(spark, f"{tmp_path}/x").edges.count() == 1
    save_tokens(parsed, f"{tmp_path}/t", overwrite=False)
    save_tokens(parsed, f"{tmp_path}/t", overwrite=False)
    assert spark.read.parquet(f"{tmp_path}/t").count() == parsed.count()
    assert [should_parse(*x) for x in ((True, False, False), (True, False, True), (False, False, False), (True, True, False))] == [(False, False), (True, False), (True, True), (True, True)]
    df = spark.createDataFrame([("a b c-d e–f",)], "t string")
    assert df.select(concatenate_phrases(F.col("t"), ["a b", "c"]), keep_hyphens(F.col("t"))).first()[:] == ("a_b c-d e–f", "a b c_d e_f")


def test_lexicon(spark, tmp_path):
    xml = '<VNCLASS ID="put-9.1"><MEMBERS><MEMBER name="put"/></MEMBERS><SUBCLASSES><VNSUBCLASS ID="x"><MEMBERS><MEMBER name="be"/></MEMBERS><SUBCLASSES><VNSUBCLASS ID="y"><MEMBERS><MEMBER name="deep"/></MEMBERS></VNSUBCLASS></SUBCLASSES></VNSUBCLASS></SUBCLASSES></VNCLASS>'
    (tmp_path / "put-9.1.xml").write_text(xml)
    (tmp_path / "bad-10.xml").write_text("<VNCLASS>")
    got = {r.verb: r for r in L.build_lexicon(L.read_class_files(spark, str(tmp_path))).collect()}
    assert got["put"].classes == ["put"] and got["put"].type_name == ["verbs_of_putting"] and got["put"].type_id == ["9"]
    assert got["be"].classes == ["helping_verbs", "put"] and "deep" not in got and len(got) == 17
    words = tmp_path / "w"
    words.mkdir()
    (words / "english-words.10").write_bytes("caf\xe9\nfar\n".encode("latin1"))
    (words / "english-words.95").write_text("rare\n")
    assert {r.word for r in L.read_dictionary(spark, str(words)).collect()} == {"café", "far"}


def test_patterns_within_words(spark):
    t = spark.createDataFrame(TOKENS, SCHEMA)
    sub = lambda names, **o: sorted((r.start, r.n, r.label) for r in E.ruler_matches(t, E.specify_names(spark, names, "X", whole_word_only=False, **o)).collect())
    assert sub(["ENTRA"]) == [(1, 1, "X")] and sub(["ENTRA"], case_sensitive=True) == [] and sub(["y Boa"], case_sensitive=True) == [(2, 2, "X")]
    assert sub(["val", "ral valley b"]) == [(1, 3, "X")] and sub(["nothing"]) == []
    both = E.specify_names(spark, ["met"], "W").unionByName(E.specify_names(spark, ["oar"], "S", whole_word_only=False))
    assert sorted((r.start, r.label) for r in E.ruler_matches(t, both).collect()) == [(3, "S"), (4, "W")]


def test_files_are_parsed_once(spark, tmp_path):
    pages = spark.createDataFrame([("a", 1, "Central Board met."), ("b", 1, "Valley Board met.")], "file_id string, page_no int, text string")
    path, files = str(tmp_path / "parsed"), lambda df: sorted({r.file_id for r in df.collect()})
    assert files(parse_files(pages.where("file_id = 'a'"), RuleAnnotator(["met"]), path)) == ["a"]
    assert files(parse_files(pages, RuleAnnotator(["met"]), path, overwrite=False)) == ["b"]
    assert parse_files(pages, RuleAnnotator(["met"]), path, overwrite=False).count() == 0
    assert files(parse_files(pages, RuleAnnotator(["met"]), path, overwrite=False, test=True)) == ["a", "b"]
    assert spark.read.parquet(path).count() == 8
    spec = E.specify_names(spark, ["Board"], "BODY")
    tags = lambda where: {r.entity for r in parse_text(pages, RuleAnnotator(["met"]), patterns=spec, ruler_position=where).collect()}
    assert "BODY_B" in tags("after") and "BODY_B" not in tags("before")
    with pytest.raises(ValueError):
        parse_text(pages, RuleAnnotator(), ruler_position="within")


def test_rules_of_both_kinds(spark):
    mixed = D.compile_rules(["A", "A_B"], ["Q", "X"], [True, False])
    assert rewritten(spark, ["A_B", "A", "B_A"], mixed) == ["B_Q", "Q", "Q_B"]
    own = D.compile_rules(["Upper_MA", "MA"], ["North", "Mass"])
    assert rewritten(spark, ["Upper_MA", "MA", "Upper_Mass", "Upper_"], own, try_drop="^Upper_") == ["Mass", "Mass", "North", "Upper_"]
    assert rewritten(spark, ["Upper_DW"], D.compile_rules(["DW"], [["a", "b"]]), try_drop="^Upper_") == ["a", "b"]
    with pytest.warns(UserWarning, match="partial"):
        r = D.compile_rules(["aa", "cc"], ["x_cc", "y_aa"], True)
    assert r.partial == [] and set(r.exact) == {"aa", "cc"}
