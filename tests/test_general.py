"""The general operators: uneven keys, nested records, hierarchies."""

import json
import random
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from tidegraph.functions.xmljson import xml_to_json
from tidegraph import session
from tidegraph.operators.hierarchy import hierarchies
from tidegraph.operators.keys import hot_keys, key_profile
from tidegraph.operators.nested import depth, flatten, infer_shape, parse_shape
from tidegraph.plans import nested as plan

SIDES = {"source": ("source", "target"), "target": ("target", "source")}
SCHEMA = "source string, target string, verb string, side string, n long"


def test_key_profile_counts_nulls_repeats_and_clashing_columns(spark):
    rows = [("a", "b", "v", "x", 1), ("a", "b", "v", "x", 1), ("a", None, "w", "x", 2), ("a", "", None, "x", 2), (None, "b", "v", "x", 3), ("", "b", "v", "x", 3)]
    got = {(r.side, r.entity): (r.n_rows, r.n_partners, r.n_values) for r in key_profile(spark.createDataFrame(rows, SCHEMA), SIDES, "verb").collect()}
    assert got["source", "a"] == (4, 1, 2)
    assert got["source", None] == (1, 1, 1) and got["source", ""] == (1, 1, 1)
    assert got["target", "b"] == (4, 1, 1)
    profile = key_profile(spark.createDataFrame(rows, SCHEMA), SIDES, "verb")
    assert {(r.side, r.entity) for r in hot_keys(profile, F.lit(6), 2).collect()} == {("source", "a"), ("target", "b")}
    assert key_profile(spark.createDataFrame([], SCHEMA), SIDES, "verb").count() == 0


def test_a_hot_key_is_spread_over_partitions(spark):
    rows = spark.range(20000).select(F.lit("hot").alias("source"), (F.col("id") % 5000).cast("string").alias("target"), F.lit("v").alias("verb"))
    got = {(r.side, r.entity): r for r in key_profile(rows, SIDES, "verb").where("entity = 'hot'").collect()}
    assert got["source", "hot"].n_rows == 20000 and got["source", "hot"].n_partners == 5000


def test_shape_parser():
    s = parse_shape("OBJECT<a: ARRAY<OBJECT<`@x``y`: STRING, b: ARRAY<OBJECT<>>>>, n: DECIMAL(10,2), t: ARRAY<STRING>>")
    assert s.scalars == {"n": "DECIMAL(10,2)", "t": "array<STRING>"} and s.arrays["a"].scalars == {"@x`y": "STRING"} and depth(s) == 3


def test_flatten_keeps_links_and_order(spark):
    records = [(1, {"a": [{"k": "x", "b": [{"v": "1"}, {"v": "2"}]}, {"b": []}]}), (2, {"a": [{"k": "y", "b": [{"v": "3", "b": [{"v": "4"}]}]}]}), (3, None)]
    df = spark.createDataFrame([(i, None if r is None else json.dumps(r)) for i, r in records], "id long, json string")
    flat = flatten(df, "id", "json")
    a = {(r.id, r.node): r for r in flat["a"].collect()}
    b = [r for r in flat["b"].collect()]
    assert [a[k].k for k in sorted(a)] == ["x", None, "y"] and all(r.parent is None for r in a.values())
    assert sorted((r.id, r.v, r.ordinal, r.parent_table) for r in b) == [(1, "1", 0, "a"), (1, "2", 1, "a"), (2, "3", 0, "a"), (2, "4", 0, "b")]
    nodes = {(r.id, r.node) for r in b} | set(a)
    assert all((r.id, r.parent) in nodes for r in b)
    assert flatten(df.where("id = 3"), "id", "json") == {} and flatten(df.limit(0), "id", "json") == {}


def reference(records):
    out = set()
    for key, text in records:
        try:
            root = ET.fromstring(text)
        except Exception:
            continue

        def walk(e, around):
            if e.tag in plan.CLASSES:
                own = e.get("ID") or ""
                out.update((key, own, "" if e.tag == "VNCLASS" else around, m.get("name")) for ms in e.findall("MEMBERS") for m in ms.findall("MEMBER") if m.get("name") is not None)
                around = own
            for child in e:
                walk(child, around)

        walk(root, "")
    return out


def deep(n):
    inner = ""
    for i in range(n, 0, -1):
        inner = f'<SUBCLASSES><VNSUBCLASS ID="c-{i}"><MEMBERS><MEMBER name="m{i}"/></MEMBERS>{inner}</VNSUBCLASS></SUBCLASSES>'
    return f'<VNCLASS ID="c"><MEMBERS/>{inner}</VNCLASS>'


def test_class_records_against_a_tree(spark, tmp_path):
    records = [
        (1, '<VNCLASS ID="a-1"><MEMBERS><MEMBER name="x&amp;y"/><!-- <MEMBER name="no"/> --></MEMBERS><FRAMES><X><![CDATA[<MEMBER name="no"/>]]></X></FRAMES></VNCLASS>'),
        (2, deep(7)),
        (3, "<VNCLASS><MEMBERS>"),
        (4, None),
        (5, ""),
        (6, '<?xml version="1.0" encoding="UTF-16"?>\n<!DOCTYPE VNCLASS SYSTEM "x.dtd"><VNCLASS ID="é"><MEMBERS><MEMBER name = \'q&#45;r\'/><MEMBER wn="1"/></MEMBERS></VNCLASS>'),
        (7, '<VNCLASS ID="b"><SUBCLASSES/></VNCLASS>'),
    ]
    rows = [(*r, "f.xml") for r in records] + [(*records[0], "f.xml")]
    spark.createDataFrame(rows, "record_id long, record_xml string, file_name string").write.parquet(f"{tmp_path}/vnclass.parquet")
    got = plan.p6_found(spark, str(tmp_path)).collect()
    want = reference([r for r in records if r[1] and not r[1].startswith("<?xml")]) | {(6, "é", "", "q-r")}
    assert {(r.record_id, r.class_id, r.parent_id, r.name) for r in got} == want and len(got) == len(want)
    assert plan.p6_classes(spark, str(tmp_path)).count() == 1 + 8 + 1 + 1
    spark.createDataFrame([], "record_id long, record_xml string").write.parquet(f"{tmp_path}/e/vnclass.parquet")
    assert plan.p6_found(spark, f"{tmp_path}/e").count() == 0 and plan.p6_elements(spark, f"{tmp_path}/e").count() == 0


def test_xml_text():
    assert xml_to_json("<a>x<b/>y</a>") == '{"a": [{"#text": "xy", "b": [{}]}]}'
    assert xml_to_json("<a><c><b/></c></a>", frozenset("a")) == '{"a": [{}]}'


def brute(rows):
    """kind, depth, top, path and descendants of (id, up, root) rows by plain climbing."""
    by = {}
    for i, up, root in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0, not r[2])):
        by.setdefault(i, (up, root))
    own = {i: "root" if root else "self" if up == i else "orphan" if up is None or up not in by else None for i, (up, root) in by.items()}
    out = {}
    for i in by:
        seen, x = [i], i
        while own[x] is None and by[x][0] not in seen:
            x = by[x][0]
            seen.append(x)
        if own[x] is None:  # a cycle: the part of the walk from its first member on
            cycle = seen[seen.index(by[x][0]) :]
            top = next(s for s in seen if s in cycle)
            seen = seen[: seen.index(top) + 1]
            kind = "cycle" if top == i else "below"
        else:
            top = x
            kind = own[i] or ("ok" if own[x] == "root" else "below")
        out[i] = (kind, len(seen) - 1, top, seen[::-1])
    below = {i: sorted(j for j, v in out.items() if j != i and i in v[3]) for i in out}
    return {i: (*v, below[i]) for i, v in out.items()}


def test_hierarchies_against_climbing(spark):
    rng, rows, want = random.Random(3), [], {}
    for g in [*range(30), None]:
        n = rng.randint(1, 30)
        rs = [(i, rng.choice([None, 0, 99]) if rng.random() < 0.1 else rng.randint(1, n), False) for i in range(1, n + 1)]
        rs = [(i, i if rng.random() < 0.15 else up, rng.random() < 0.5) for i, up, _ in rs]
        rs = [(i, up, root and (up == i or up == 0)) for i, up, root in rs]
        rows += [(g, i, up, root, "x") for i, up, root in rs] + [(g, *rs[0], "x")]
        want |= {(g, i): v for i, v in brute(rs).items()}
    rows += [(1, None, 1, False, "x")]
    df = spark.createDataFrame(rows, "g int, id int, up int, root boolean, kind string")
    for large_rows in (10**6, 12):  # all in blocks, some groups by joins, all by joins
        check_all(df, large_rows, want)
    assert hierarchies(df.limit(0), ["g"], "id", "up", F.col("root")).count() == 0


def check_all(df, large_rows, want):
    got = hierarchies(df, ["g"], "id", "up", F.col("root"), large_rows=large_rows).collect()
    assert len(got) == len(want)
    assert {(r.g, r.id): (r.kind, r.depth, r.top, r.path, r.descendants) for r in got} == want
    assert all(r.n_below == len(r.descendants) for r in got)


def test_a_long_chain_and_batches_that_cut_groups(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(1, 3001).select(F.lit("g").alias("g"), F.col("id").cast("int").alias("id"), (F.col("id") - 1).cast("int").alias("up"), (F.col("id") == 1).alias("root"))
        got = hierarchies(df, ["g"], "id", "up", F.col("root"), False)
        short = df.where("id <= 150")
        assert hierarchies(short, ["g"], "id", "up", F.col("root"), True, 100).where("size(path) = depth + 1 and n_below = 150 - id").count() == 150
        assert got.agg(F.max("depth")).first()[0] == 2999 and got.where("kind = 'ok'").count() == 2999
        many = spark.range(500).select((F.col("id") / 3).cast("int").alias("g"), (F.col("id") % 3 + 1).cast("int").alias("id"), F.lit(1).alias("up"), (F.col("id") % 3 == 0).alias("root"))
        assert hierarchies(many, ["g"], "id", "up", F.col("root")).where("size(path) <> depth + 1 or kind not in ('root', 'ok')").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shape_of_no_rows(spark):
    assert infer_shape(spark.createDataFrame([], "json string"), "json").arrays == {}


def test_depth_adds_no_explosions(spark):
    """A table is one explosion, however deep its type nests, and holds the rows of every level."""
    deep = '{"S": [' * 9 + '{"n": "x"}' + "]}" * 9
    flat = flatten(spark.createDataFrame([(1, deep), (2, '{"S": [{"n": "a"}, {"n": "b", "S": [{"n": "c"}]}]}'), (3, None)], "k long, j string"), "k", "j")
    assert flat["S"].where("k = 1").count() == 9 and flat["S"].where("k = 1 and n = 'x'").first().node == ".".join(["S.0"] * 9)
    assert sorted((r.node, r.parent, r.ordinal, r.n) for r in flat["S"].where("k = 2").collect()) == [("S.0", None, 0, "a"), ("S.1", None, 1, "b"), ("S.1.S.0", "S.1", 0, "c")]
    plan = flat["S"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1


def test_rows_that_many_point_to_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(session, "SMALL_SIDE", 0)
    monkeypatch.setattr(session, "HEAVY_KEY", 10)
    star = [(1, i, 2 if i > 2 else 1, i == 1, "x") for i in range(1, 61)]
    df = spark.createDataFrame(star, "g int, id int, up int, root boolean, kind string")
    check_all(df, 12, {(1, i): v for i, v in brute([r[1:4] for r in star]).items()})
