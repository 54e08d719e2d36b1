"""Queries of the extraction from parsed tokens, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph import schemas as S
from tidegraph.operators import extract as X
from tidegraph.operators.crawl import crawled_tokens, sentence_filter, sentences
from tidegraph.session import cut, table

KEEP = ("ORG", "GPE", "PERSON", "WATER")


def _list(*names: str):
    """List columns as text, so that both engines compare them alike."""
    return [F.array_join(n, "|").alias(n) for n in names]


def q_sentence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sentence_filter(sentences(table(spark, sf_dir, "tokens")))
    return kept.select(*S.SENTENCE, F.size("s").alias("n_tokens"))


def q_crawl_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawled_tokens(table(spark, sf_dir, "tokens")).select(*S.SENTENCE, "token_id", "role")


def q_crawl_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = crawled_tokens(table(spark, sf_dir, "tokens"))
    return t.select(*S.SENTENCE, "token_id", "verb_id", "verb_name", "verb_lemma", "verb_tense", "parent_id")


def q_helper_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = crawled_tokens(table(spark, sf_dir, "tokens")).where(F.col("verb_id") == F.col("token_id"))
    return t.where(F.col("helper_lemma").isNotNull()).select(*S.SENTENCE, "token_id", *_list("helper_lemma", "helper_token"))


def q_xcomp_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = crawled_tokens(table(spark, sf_dir, "tokens"))
    return t.where(F.col("xcomp_verb").isNotNull()).select(*S.SENTENCE, "token_id", *_list("xcomp_verb"))


def q_xcomp_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = crawled_tokens(table(spark, sf_dir, "tokens")).where(F.col("xcomp_verb").isNotNull() & (F.col("verb_id") == F.col("token_id")))
    return t.where(F.col("xcomp_helper_lemma").isNotNull()).select(*S.SENTENCE, "token_id", *_list("xcomp_helper_lemma", "xcomp_helper_token"))


def q_entity_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.consolidate(crawled_tokens(table(spark, sf_dir, "tokens")))
    return t.where(F.col("entity") != "").select(*S.SENTENCE, "token_id", "entity_type", "iob", "entity_id", "entity_name")


def q_entity_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.entity_tokens(table(spark, sf_dir, "tokens"), KEEP)
    return t.where(F.col("entity") != "").groupBy("entity_name").agg(F.count("*").alias("n_tokens"))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.prune(X.entity_tokens(table(spark, sf_dir, "tokens"), KEEP))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.with_verb_flags(_kept(spark, sf_dir))


def q_source_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.adopt_sources(cut(_flagged(spark, sf_dir)))
    a = a.where((F.col("entity_name") != "") & F.col("entity_type").isin(*KEEP) & (F.col("role") == "source"))
    return a.select(*S.SENTENCE, "verb_id", "entity_name").distinct()


def _edges(incomplete: bool, remove_neg: bool = True):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = X.edges_of(_kept(spark, sf_dir), KEEP, incomplete, remove_neg)
        return e.select("file_id", *[c for c in X.EDGE_COLUMNS if c not in X.LISTS], *_list(*X.LISTS))

    return run


def q_nodelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.nodes_of(X.prune(X.entity_tokens(table(spark, sf_dir, "tokens"), KEEP)), KEEP)


def q_verblist(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = X.edges_of(_kept(spark, sf_dir), KEEP)
    return X.verbs_of(edges, table(spark, sf_dir, "lexicon")).select("head_verb_lemma", *_list("classes", "type_name", "type_id"))


def q_appositives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.appositives(X.entity_tokens(table(spark, sf_dir, "tokens"), KEEP), KEEP)


def q_extract_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four tables of the extraction at once: rows of each per file."""
    e = X.extract_network(table(spark, sf_dir, "tokens"), table(spark, sf_dir, "lexicon"), KEEP, incomplete=True, remove_neg=False)
    parts = [
        df.groupBy("file_id").agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("part"), "file_id", "n_rows")
        for name, df in (("nodes", e.nodes), ("edges", cut(e.edges)), ("appositives", e.appositives))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_appositives_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no appositions, so conjoined entities are made ones."""
    t = table(spark, sf_dir, "tokens")
    made = t.withColumn("dep_rel", F.when((F.col("dep_rel") == "conj") & (F.col("entity") != ""), "appos").otherwise(F.col("dep_rel")))
    return X.appositives(X.entity_tokens(made, KEEP), KEEP)


QUERIES = {
    "appositives_made": q_appositives_made,
    "sentence_filter": q_sentence_filter,
    "crawl_roles": q_crawl_roles,
    "crawl_verbs": q_crawl_verbs,
    "helper_lists": q_helper_lists,
    "xcomp_lists": q_xcomp_lists,
    "xcomp_helpers": q_xcomp_helpers,
    "entity_consolidate": q_entity_consolidate,
    "entity_clean": q_entity_clean,
    "source_adoption": q_source_adoption,
    "edges_complete": _edges(False),
    "edges_incomplete": _edges(True),
    "edges_with_negation": _edges(False, False),
    "nodelist": q_nodelist,
    "verblist": q_verblist,
    "appositives": q_appositives,
    "extract_sizes": q_extract_sizes,
}


def _words(xs: tuple[str, ...]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


_KEEP = _words(KEEP)
_ROLE = f"""case when t.dep = 'appos' then 'appos' when t.pos in ({_words(S.VERBS)}) then 'target'
    when t.dep in ({_words(S.SUBJECTS)}) then 'source' when upper(t.dep) = 'ROOT' then 'root_not_verb'
    when t.h = t.id then 'broken_dep_rel' when t.h = {{start}} then 'inf_loop' end"""

CRAWL_SQL = f"""
with recursive t0 as (
  select distinct file_id, doc_id, sentence_id, concat_ws('|', file_id, doc_id, sentence_id) as sk, token_id as id, head_token_id as h,
    token, lemma, pos, tag, dep_rel as dep, coalesce(entity, '') as entity
  from tokens where token_id is not null),
keep as (
  select sk from t0 group by sk having bool_or(dep in ({_words(S.SUBJECTS)})) and bool_or(dep in ({_words(S.OBJECTS)}))
    and bool_or(pos in ({_words(S.VERBS)}))),
t as (select t0.*, pos in ({_words(S.VERBS)}) as isv, coalesce(pos = 'AUX' and dep in ({_words(S.AUXILIARY)}), false) as aux,
    coalesce(pos = 'VERB' and dep = 'xcomp', false) as x from t0 semi join keep using (sk)),
climb as (
  select t.sk, t.id as start, t.id as cur, t.h as nxt, 1 as k, {_ROLE.format(start='t.id')} as role from t
  union all
  select c.sk, c.start, t.id, t.h, c.k + 1, {_ROLE.format(start='c.start')}
  from climb c join t on t.sk = c.sk and t.id = c.nxt where c.role is null and c.k < {S.ROLE_STEPS}),
role as (select sk, start as id, cur, role from climb where role is not null),
vclimb as (
  select r.sk, r.id, t.id as cur, t.h as nxt, t.isv, 1 as k from role r join t on t.sk = r.sk and t.id = r.cur where r.role = 'source'
  union all
  select v.sk, v.id, t.id, t.h, t.isv, v.k + 1 from vclimb v join t on t.sk = v.sk and t.id = v.nxt where not coalesce(v.isv, false) and v.k < {S.VERB_STEPS}),
own as (
  select sk, id, cur as v from role where role = 'target'
  union all select sk, id, cur from vclimb where isv),
xclimb as (
  select sk, id, id as p, h, 0 as k from t where x
  union all
  select c.sk, c.id, t.id, t.h, c.k + 1 from xclimb c join t on t.sk = c.sk and t.id = c.h and t.x where c.k < {S.XCOMP_STEPS}),
anchor as (
  select c.sk, c.id, t.id as a from (select * from xclimb qualify row_number() over (partition by sk, id order by k desc) = 1) c
  join t on t.sk = c.sk and t.id = c.h),
helpers as (
  select sk, h as id, string_agg(lemma, '|' order by id) as helper_lemma, string_agg(token, '|' order by id) as helper_token,
    list(lemma) as hl, list(token) as ht
  from t where aux and h is not null group by sk, h),
comps as (
  select a.sk, a.a as id, string_agg(t.lemma, '|' order by t.id) as xcomp_verb, list(t.lemma) as xl, max(a.id) as last
  from anchor a join t on t.sk = a.sk and t.id = a.id group by a.sk, a.a),
rowof as (
  select t.sk, t.id, own.v, case when vt.dep = 'xcomp' then coalesce(a.a, own.v) else t.id end as src
  from t left join own on own.sk = t.sk and own.id = t.id left join t vt on vt.sk = t.sk and vt.id = own.v
  left join anchor a on a.sk = t.sk and a.id = own.v),
c as (
  select t.*, role.role, fv.id as verb_id, fv.token as verb_name, fv.lemma as verb_lemma, fv.tag as verb_tense, fv.h as parent_id,
    helpers.helper_lemma, helpers.helper_token, helpers.hl, cm.xcomp_verb, cm.xl,
    xh.helper_lemma as xcomp_helper_lemma, xh.helper_token as xcomp_helper_token, xh.hl as xhl
  from t left join role on role.sk = t.sk and role.id = t.id
  join rowof r on r.sk = t.sk and r.id = t.id
  left join own fo on fo.sk = t.sk and fo.id = r.src
  left join t fv on fv.sk = t.sk and fv.id = fo.v
  left join helpers on helpers.sk = t.sk and helpers.id = r.src
  left join comps cm on cm.sk = t.sk and cm.id = t.id
  left join comps cs on cs.sk = t.sk and cs.id = r.src
  left join helpers xh on xh.sk = t.sk and xh.id = cs.last)
"""
_IDS = "file_id, doc_id, sentence_id"
_MATH_SQL = "translate(n, '" + "".join("ℎ" if i == 7 else chr(0x1D44E + i) for i in range(26)) + "".join(chr(0x1D434 + i) for i in range(26)) + "', 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_NET = (
    CRAWL_SQL
    + f""",
e1 as (
  select *, regexp_replace(entity, '_.+', '') as entity_type, regexp_replace(entity, '.+_', '') as iob from c),
e2 as (
  select *, sum(case when iob in ('B', '') then 1 else 0 end) over (partition by sk order by id rows unbounded preceding) as run from e1),
e3 as (
  select *, string_agg(token, '_' order by id) over (partition by sk, run, role rows between unbounded preceding and unbounded following) as joined from e2),
e4 as (
  select * exclude (joined), case when entity <> '' then joined else '' end as n, case when entity <> '' then run else -1 end as entity_id from e3),
e5 as (select *, regexp_replace(regexp_replace({_MATH_SQL}, '''s$', ''), '_s$', '') as n1 from e4),
e6 as (select *, regexp_replace(regexp_replace(regexp_replace(n1, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') as n2 from e5),
e as (select *, case when regexp_matches(n2, '[a-zA-Z]') then n2 else '' end as entity_name from e6),
kept as (
  select * from e where not ((pos = 'AUX' and dep in ({_words(S.AUXILIARY)})) or role = 'appos' or (pos = 'VERB' and dep = 'xcomp'))),
fl as (
  select *, bool_or(coalesce(dep = 'neg', false)) over (partition by sk, verb_id) as neg,
    bool_or(role = 'source') over (partition by sk, verb_id) as has_sources from kept),
st as (select distinct file_id, doc_id, sentence_id, sk, verb_id, parent_id, role, entity_id, entity_type, entity_name, has_sources from fl),
ends as (
  select * exclude (parent_id, has_sources) from st
  union all
  select s.file_id, s.doc_id, s.sentence_id, s.sk, u.verb_id, s.role, s.entity_id, s.entity_type, s.entity_name
  from st s join (select distinct sk, verb_id, parent_id from st where not has_sources) u on u.sk = s.sk and u.parent_id = s.verb_id
  where s.has_sources and s.role = 'source'),
src as (select distinct {_IDS}, sk, verb_id, entity_name as source from ends where role = 'source' and entity_name <> '' and entity_type in ({_KEEP}) and verb_id is not null),
trg as (select distinct {_IDS}, sk, verb_id, entity_name as target from ends where role = 'target' and entity_name <> '' and entity_type in ({_KEEP}) and verb_id is not null),
vb as (select * from fl where pos in ({_words(S.VERBS)}) and verb_id is not null),
pairs as (select coalesce(src.sk, trg.sk) as sk, coalesce(src.verb_id, trg.verb_id) as verb_id, source, target
  from src full join trg on src.sk = trg.sk and src.verb_id = trg.verb_id),
edges as (
  select v.file_id, p.source, p.target, v.verb_name as head_verb_name, v.verb_lemma as head_verb_lemma, v.verb_tense as head_verb_tense,
    v.helper_lemma, v.helper_token, v.xcomp_verb, v.xcomp_helper_lemma, v.xcomp_helper_token, v.neg,
    p.source is not null and p.target is not null as edgeiscomplete,
    coalesce(v.verb_lemma in ({_words(S.HEDGE_VERBS)}), false) or coalesce(list_has_any(v.xl, [{_words(S.HEDGE_VERBS)}]), false)
      or coalesce(list_has_any(v.hl, [{_words(S.HEDGE_HELPERS)}]), false) or coalesce(list_has_any(v.xhl, [{_words(S.HEDGE_HELPERS)}]), false) as has_hedge,
    coalesce(list_has_any(v.hl, [{_words(S.FUTURE_HELPERS)}]), false) or coalesce(list_has_any(v.xhl, [{_words(S.FUTURE_HELPERS)}]), false)
      or coalesce(v.xcomp_verb is not null and v.verb_name = 'going' and list_has_any(v.hl, [{_words(S.BE_FORMS)}]), false) as is_future,
    concat_ws('_', v.doc_id, v.sentence_id, v.verb_id) as doc_sent_verb
  from pairs p join vb v on v.sk = p.sk and v.verb_id = p.verb_id)
"""
)

ORACLE = {
    "sentence_filter": CRAWL_SQL + f"select {_IDS}, count(*) as n_tokens from t group by all",
    "crawl_roles": CRAWL_SQL + f"select {_IDS}, id as token_id, role from c",
    "crawl_verbs": CRAWL_SQL + f"select {_IDS}, id as token_id, verb_id, verb_name, verb_lemma, verb_tense, parent_id from c",
    "helper_lists": CRAWL_SQL + f"select {_IDS}, id as token_id, helper_lemma, helper_token from c where verb_id = id and helper_lemma is not null",
    "xcomp_lists": CRAWL_SQL + f"select {_IDS}, id as token_id, xcomp_verb from c where xcomp_verb is not null",
    "xcomp_helpers": CRAWL_SQL
    + f"select {_IDS}, id as token_id, xcomp_helper_lemma, xcomp_helper_token from c where xcomp_verb is not null and verb_id = id and xcomp_helper_lemma is not null",
    "entity_consolidate": _NET + f"select {_IDS}, id as token_id, entity_type, iob, entity_id, n as entity_name from e where entity <> ''",
    "entity_clean": _NET + "select entity_name, count(*) as n_tokens from e where entity <> '' group by entity_name",
    "source_adoption": _NET
    + f"select distinct {_IDS}, verb_id, entity_name from ends where role = 'source' and entity_name <> '' and entity_type in ({_KEEP})",
    "edges_complete": _NET + "select * from edges where edgeiscomplete and not neg",
    "edges_incomplete": _NET + "select * from edges where not neg",
    "edges_with_negation": _NET + "select * from edges where edgeiscomplete",
    "nodelist": _NET
    + f""", m as (select distinct sk, verb_id, file_id, entity_id, entity_name, entity_type from kept where entity_name <> '' and entity_type in ({_KEEP})),
b as (select file_id, entity_name, entity_type, count(*) as n from m group by all)
select file_id, entity_name, arg_min(entity_type, (-n, entity_type)) as entity_type, sum(n)::bigint as num_appearances from b group by file_id, entity_name""",
    "verblist": _NET
    + """select l.head_verb_lemma, array_to_string(x.classes, '|') as classes, array_to_string(x.type_name, '|') as type_name, array_to_string(x.type_id, '|') as type_id
from (select distinct head_verb_lemma from edges where edgeiscomplete and not neg) l left join lexicon x on x.verb = l.head_verb_lemma""",
    "appositives": _NET
    + f""", a as (select * from e where role = 'appos' and entity_name <> '' and entity_type in ({_KEEP})),
an as (
  select a.sk, a.entity_id, arg_min(a.h, a.id) as h, any_value(f.abbrev) as abbrev
  from a join (select sk, entity_id, arg_min(entity_name, id) as abbrev, list(id) as ids from a group by all) f on f.sk = a.sk and f.entity_id = a.entity_id
  where not coalesce(list_contains(f.ids, a.h), false) group by a.sk, a.entity_id)
select distinct e.file_id, an.abbrev, e.entity_name as fullname from an join e on e.sk = an.sk and e.id = an.h
where e.entity_type in ({_KEEP}) and e.entity_name <> ''""",
    "extract_sizes": _NET
    + f""", m as (select distinct file_id, entity_name from kept where entity_name <> '' and entity_type in ({_KEEP})),
a as (select * from e where role = 'appos' and entity_name <> '' and entity_type in ({_KEEP})),
an as (
  select a.sk, a.entity_id, arg_min(a.h, a.id) as h, any_value(f.abbrev) as abbrev
  from a join (select sk, entity_id, arg_min(entity_name, id) as abbrev, list(id) as ids from a group by all) f on f.sk = a.sk and f.entity_id = a.entity_id
  where not coalesce(list_contains(f.ids, a.h), false) group by a.sk, a.entity_id),
ap as (select distinct e.file_id, an.abbrev, e.entity_name as fullname from an join e on e.sk = an.sk and e.id = an.h
  where e.entity_type in ({_KEEP}) and e.entity_name <> '')
select 'nodes' as part, file_id, count(*) as n_rows from m group by file_id
union all select 'edges', file_id, count(*) from edges group by file_id
union all select 'appositives', file_id, count(*) from ap group by file_id""",
}
ORACLE["appositives_made"] = ORACLE["appositives"].replace(
    "from tokens where", "from (select * replace (case when dep_rel = 'conj' and entity <> '' then 'appos' else dep_rel end as dep_rel) from tokens) where"
)
