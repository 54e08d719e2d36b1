"""Sentences with one behaviour each, and a model in plain Python on random trees."""

import random

import pytest

from tidegraph import schemas as S
from tidegraph.operators import extract as X
from tidegraph.operators.crawl import crawled_tokens

SCHEMA = "file_id string, doc_id string, sentence_id int, token_id int, token string, lemma string, pos string, tag string, head_token_id int, dep_rel string, entity string"


def sentence(number, *words):
    """words: (token, pos, head, dep, entity, lemma)"""
    out = []
    for i, w in enumerate(words, 1):
        token, pos, head, dep, entity, lemma = (*w, *[None] * (6 - len(w)))
        out.append(("f", "text1", number, i, token, lemma or token, pos, "VB" if pos == "VERB" else "NN", head, dep, entity or ""))
    return out


def extract(spark, rows, **options):
    lexicon = spark.createDataFrame([("manage", ["c"], ["t"], ["1"])], "verb string, classes array<string>, type_name array<string>, type_id array<string>")
    return X.extract_network(spark.createDataFrame(rows, SCHEMA), lexicon, ("ORG", "WATER"), **options)


def ends(e):
    return sorted((r.source, r.target, r.head_verb_lemma) for r in e.edges.collect())


SIMPLE = sentence(1, ("Agency", "PROPN", 2, "nsubj", "ORG_B"), ("manages", "VERB", 2, "ROOT", "", "manage"), ("Basin", "PROPN", 2, "dobj", "WATER_B"))


def test_one_edge_and_all_tables(spark):
    e = extract(spark, SIMPLE)
    assert ends(e) == [("Agency", "Basin", "manage")]
    assert sorted((r.entity_name, r.entity_type, r.num_appearances) for r in e.nodes.collect()) == [("Agency", "ORG", 1), ("Basin", "WATER", 1)]
    assert [(r.head_verb_lemma, r.classes) for r in e.verbs.collect()] == [("manage", ["c"])]
    assert e.appositives.count() == 0
    assert e.edges.columns == ["file_id", *X.EDGE_COLUMNS]


def test_cross_of_sources_and_targets(spark):
    rows = sentence(
        1,
        ("Agency", "PROPN", 4, "nsubj", "ORG_B"), ("and", "CCONJ", 1, "cc"), ("Board", "PROPN", 1, "conj", "ORG_B"), ("manage", "VERB", 4, "ROOT"),
        ("Basin", "PROPN", 4, "dobj", "WATER_B"), ("and", "CCONJ", 5, "cc"), ("River", "PROPN", 5, "conj", "WATER_B"),
    )
    assert len(ends(extract(spark, rows))) == 4


def test_future_hedge_and_complements(spark):
    rows = sentence(1, ("Agency", "PROPN", 3, "nsubj", "ORG_B"), ("will", "AUX", 3, "aux"), ("monitor", "VERB", 3, "ROOT"), ("Basin", "PROPN", 3, "dobj", "WATER_B"))
    rows += sentence(
        2,
        ("Agency", "PROPN", 3, "nsubj", "ORG_B"), ("may", "AUX", 3, "aux"), ("appear", "VERB", 3, "ROOT"), ("to", "AUX", 5, "aux"),
        ("support", "VERB", 3, "xcomp"), ("County", "PROPN", 5, "dobj", "ORG_B"),
    )
    got = {r.doc_sent_verb: r for r in extract(spark, rows).edges.collect()}
    will, may = got["text1_1_3"], got["text1_2_3"]
    assert will.is_future and not will.has_hedge and will.helper_lemma == ["will"]
    assert may.has_hedge and not may.is_future and may.xcomp_verb == ["support"] and may.xcomp_helper_lemma == ["to"]
    assert (may.source, may.target) == ("Agency", "County")


def test_negation(spark):
    rows = sentence(1, ("Agency", "PROPN", 4, "nsubj", "ORG_B"), ("does", "AUX", 4, "aux"), ("not", "PART", 4, "neg"), ("regulate", "VERB", 4, "ROOT"), ("Basin", "PROPN", 4, "dobj", "WATER_B"))
    assert ends(extract(spark, rows)) == []
    kept = extract(spark, rows, remove_neg=False).edges.collect()
    assert [r.neg for r in kept] == [True]


def test_apposition_makes_no_edge(spark):
    rows = sentence(
        1,
        ("Agency", "PROPN", 5, "nsubj", "ORG_B"), (",", "PUNCT", 1, "punct"), ("Board", "PROPN", 1, "appos", "ORG_B"), (",", "PUNCT", 1, "punct"),
        ("manages", "VERB", 5, "ROOT", "", "manage"), ("Basin", "PROPN", 5, "dobj", "WATER_B"),
    )
    e = extract(spark, rows)
    assert ends(e) == [("Agency", "Basin", "manage")]
    assert [(r.abbrev, r.fullname) for r in e.appositives.collect()] == [("Board", "Agency")]


def test_pronoun_blocks_adoption_and_incomplete_edges(spark):
    rows = sentence(1, ("It", "PRON", 2, "nsubj"), ("manages", "VERB", 2, "ROOT", "", "manage"), ("Basin", "PROPN", 2, "dobj", "WATER_B"))
    assert ends(extract(spark, rows)) == []
    assert ends(extract(spark, rows, incomplete=True)) == [(None, "Basin", "manage")]


def test_adoption_one_level_and_by_equality(spark):
    rows = sentence(1, ("Agency", "PROPN", 2, "nsubj", "ORG_B"), ("said", "VERB", 2, "ROOT", "", "say"), ("affects", "VERB", 2, "ccomp", "", "affect"), ("Basin", "PROPN", 3, "dobj", "WATER_B"))
    assert ends(extract(spark, rows)) == [("Agency", "Basin", "affect")]
    with pytest.raises(ValueError):
        extract(spark, rows, adoption="no")


def test_roles_of_broken_trees(spark):
    rows = sentence(1, ("x", "NOUN", 1, "dep"), ("a", "NOUN", 3, "dep"), ("b", "NOUN", 2, "dep"), ("r", "NOUN", 4, "ROOT"), ("o", "NOUN", 99, "dep"), ("n", "NOUN", None, None))
    rows += sentence(2, *[("c", "NOUN", i + 2, "dep") for i in range(16)], ("v", "VERB", 17, "ROOT"))
    t = crawled_tokens(spark.createDataFrame(rows, SCHEMA), filtered=False)
    got = {(r.sentence_id, r.token_id): r.role for r in t.collect()}
    assert [got[1, i] for i in range(1, 7)] == ["broken_dep_rel", "inf_loop", "inf_loop", "root_not_verb", None, None]
    assert got[2, 1] is None and got[2, 3] == "target"


def test_sentence_filter_repeats_nulls_and_empty(spark):
    assert ends(extract(spark, SIMPLE + SIMPLE)) == [("Agency", "Basin", "manage")]
    odd = [("f", "text1", 9, None, "a", "a", "NOUN", "NN", 1, "nsubj", None)]
    no_object = sentence(3, ("Agency", "PROPN", 2, "nsubj", "ORG_B"), ("manages", "VERB", 2, "ROOT"))
    assert ends(extract(spark, SIMPLE + odd + no_object)) == [("Agency", "Basin", "manage")]
    e = extract(spark, [])
    assert e.edges.count() == e.nodes.count() == e.verbs.count() == e.appositives.count() == 0


def test_consolidation(spark):
    rows = sentence(
        1,
        ("Water", "PROPN", 3, "nsubj", "ORG_B"), ("Board", "PROPN", 3, "nsubj", "ORG_I"), ("met", "VERB", 3, "ROOT"), ("x", "NOUN", 3, "dobj", ""),
        ("River", "PROPN", 3, "dobj", "ORG_I"), ("Guide", "PROPN", 3, "dobj", "WORK_OF_ART_B"),
    )
    t = X.consolidate(crawled_tokens(spark.createDataFrame(rows, SCHEMA)))
    got = {r.token_id: (r.entity_type, r.iob, r.entity_name) for r in t.collect()}
    assert got[1] == ("ORG", "B", "Water_Board") and got[2] == ("ORG", "I", "Water_Board")
    assert got[4][2] == "" and got[5] == ("ORG", "I", "x_River") and got[6][:2] == ("WORK", "B")


def model(tokens):
    """Role and verb of each token, written from the description."""
    by = {t["id"]: t for t in tokens}
    out = {}
    for t in tokens:
        cur, role = t, None
        for _ in range(S.ROLE_STEPS):
            if cur["dep"] == "appos":
                role = "appos"
            elif cur["pos"] in S.VERBS:
                role = "target"
            elif cur["dep"] in S.SUBJECTS:
                role = "source"
            elif cur["dep"] == "ROOT":
                role = "root_not_verb"
            elif cur["head"] == cur["id"]:
                role = "broken_dep_rel"
            elif cur["head"] == t["id"]:
                role = "inf_loop"
            if role or cur["head"] not in by:
                break
            cur = by[cur["head"]]
        verb = cur["id"] if role == "target" else None
        if role == "source":
            for _ in range(S.VERB_STEPS):
                if cur["pos"] in S.VERBS:
                    verb = cur["id"]
                    break
                if cur["head"] not in by:
                    break
                cur = by[cur["head"]]
        out[t["id"]] = (role, verb)
    return out


def test_random_trees_against_the_model(spark):
    rng, rows, want = random.Random(5), [], {}
    for s in range(120):
        n = rng.randint(1, 24)
        tokens = [
            {"id": i, "head": rng.choice([rng.randint(1, n), i, None, 77]) if rng.random() < 0.2 else rng.randint(1, n),
             "pos": rng.choice(["VERB", "NOUN", "NOUN", "NOUN", "AUX", "PROPN"]), "dep": rng.choice(["nsubj", "dobj", "amod", "amod", "prep", "ROOT", "appos"])}
            for i in range(1, n + 1) if rng.random() > 0.1
        ]
        rows += [("f", "d", s, t["id"], "w", "w", t["pos"], "X", t["head"], t["dep"], "") for t in tokens]
        want |= {(s, i): r for i, r in model(tokens).items()}
    t = crawled_tokens(spark.createDataFrame(rows, SCHEMA), filtered=False).collect()
    assert {(r.sentence_id, r.token_id): (r.role, r.verb_id) for r in t} == want
