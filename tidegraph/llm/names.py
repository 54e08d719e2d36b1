"""Linking the spellings of one name, by a pigeonhole segment join.

Each distinct spelling is brought to a canonical form: what kind of body it names (type words,
abbreviations written out, order and small words dropped), its numbers, and the proper name. Only
forms of one kind and one set of numbers can be the same entity. Within a kind, a proper name is cut
into k+1 segments and put into an inverted index by segment; other names look up their own
substrings there, shifted by up to k places, and what meets is verified with a banded edit distance
that counts a swap of neighbours as one error. With at most k errors one segment stays whole; a swap
over a segment's edge breaks two, so substrings with that swap undone are looked up as well.

Each form then points to its nearest form with more rows behind it, which can't make a cycle, and
the pointers are followed to their ends by doubling. No group's pairs are all made: only pairs that
share a segment at one place are compared.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.session import cut, cut_in_loop, table

#: Most errors between two proper names, and the shortest names that may have one and two.
ERRORS, ONE_FROM, TWO_FROM = 2, 5, 9

#: Words that tell kinds of bodies apart.
TYPES = frozenset(
    "agency association authority basin board bureau city coalition college commission committee council county department "
    "district farm groundwater institute irrigation lower municipal planning reclamation resources river service "
    "society state subbasin supervisors sustainability town university upper utility valley village water watershed".split()
)
#: Usual abbreviations of them.
SHORT = {
    "agcy": "agency", "agy": "agency", "assn": "association", "assoc": "association", "auth": "authority", "bd": "board",
    "bsn": "basin", "bur": "bureau", "cty": "county", "co": "county", "cnty": "county", "coal": "coalition", "comm": "commission",
    "commn": "commission", "cmte": "committee", "dept": "department", "dpt": "department", "dep": "department", "dist": "district",
    "dst": "district", "farmers": "farm", "gndwtr": "groundwater", "gw": "groundwater", "grndwtr": "groundwater", "irr": "irrigation",
    "irrig": "irrigation", "lwr": "lower", "mun": "municipal", "muni": "municipal", "plng": "planning", "plan": "planning",
    "recl": "reclamation", "reclam": "reclamation", "res": "resources", "rsrcs": "resources", "resource": "resources", "riv": "river", "rvr": "river",
    "subbsn": "subbasin", "sbbsn": "subbasin", "supv": "supervisors", "sups": "supervisors", "supvrs": "supervisors", "sust": "sustainability", "sustain": "sustainability",
    "u": "university", "univ": "university", "upr": "upper", "util": "utility", "utils": "utility", "utilities": "utility",
    "wtr": "water", "wtrshd": "watershed", "wshd": "watershed", "coaltn": "coalition", "districts": "district",
}
#: Initialisms of whole kinds.
INITIALS = {
    "gsa": "groundwater sustainability agency", "rd": "reclamation district", "dwr": "department water resources", "id": "irrigation district",
    "bos": "board supervisors", "cbos": "county board supervisors", "wc": "watershed coalition", "pc": "planning commission",
    "mu": "municipal utility", "fb": "farm bureau",
}
SMALL = frozenset("of the and for in no nr num number".split())
HONORIFICS = frozenset("dr mr mrs ms miss prof sir hon jr sr phd md".split())
#: Short forms of given names.
NICKNAMES = {
    "abby": "abigail", "al": "albert alan alfred", "alex": "alexander alexandra", "andy": "andrew", "angie": "angela", "barb": "barbara",
    "ben": "benjamin", "bert": "albert robert", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william",
    "bob": "robert", "bobby": "robert", "cathy": "catherine", "charlie": "charles", "chris": "christopher christine", "chuck": "charles",
    "cindy": "cynthia", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard",
    "don": "donald", "ed": "edward", "eddie": "edward", "fran": "francesca frances", "frank": "francis", "fred": "frederick", "freddy": "frederick",
    "greg": "gregory", "jack": "john", "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald", "jim": "james",
    "jimmy": "james", "joe": "joseph", "jon": "jonathan", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "ken": "kenneth",
    "larry": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard", "liz": "elizabeth", "lizzie": "elizabeth", "maggie": "margaret",
    "marge": "margaret", "matt": "matthew", "meg": "margaret", "mike": "michael", "nat": "nathaniel", "nate": "nathaniel", "ned": "edward",
    "nick": "nicholas", "pat": "patricia patrick", "patty": "patricia", "peg": "margaret", "peggy": "margaret", "pete": "peter", "phil": "philip",
    "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert", "ron": "ronald", "sam": "samuel samantha", "steve": "stephen",
    "sue": "susan", "susie": "susan", "susy": "susan", "suzy": "susan", "suzie": "susan", "ted": "theodore edward", "teddy": "theodore edward", "theo": "theodore", "tim": "timothy", "tom": "thomas",
    "tony": "anthony", "tricia": "patricia", "vic": "victor victoria", "vicki": "victoria", "vicky": "victoria", "will": "william", "liza": "elizabeth",
    "trish": "patricia", "jamie": "james", "debby": "deborah", "kit": "katherine", "fredo": "frederick", "franny": "francesca", "rita": "margaret", "dot": "dorothy",
}
#: Further given names without a short form above.
GIVEN = frozenset(" ".join(NICKNAMES.values()).split()) | frozenset("anna carol dorothy george helen karen laura linda maria mark mary nancy paul ruth sandra sarah sharon".split())

#: What the canonical form of a name is made of.
FORM = T.StructType([*[T.StructField(n, T.StringType()) for n in ("kind", "name", "given")], T.StructField("full", T.BooleanType())])


def plain(s: str) -> str:
    """Without accents and with one kind of blank."""
    s = unicodedata.normalize("NFKD", s)
    return "".join(c for c in s if not unicodedata.combining(c)).replace("’", "'")


def words(spelling: str) -> list[str]:
    s = plain(spelling)
    s = re.sub(r"\(([^)]*)\)", lambda m: " " if m[1].strip().lower() in INITIALS else f" {m[1]} ", s)
    s = re.sub(r"'s(?![^\W_])", " ", s, flags=re.I)
    s = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[^\W\d_])(?=\d)|(?<=\d)(?=[^\W\d_])", " ", s)
    out: list[str] = []
    for w in re.findall(r"\d+|[^\W\d_]+", s.replace("'", "").lower()):
        out += _parts(w)
    return out


def _parts(w: str) -> list[str]:
    """A word, or the two that a lost blank has run together."""
    if w in TYPES or w in SHORT or w in GIVEN:
        return [w]
    for n in range(len(w) - 2, 3, -1):
        a, b = w[:n], w[n:]
        if a in TYPES and (b == "of" or b in TYPES or len(b) >= 4):
            return [a, b]
    for t in ("district", "county", "river", "university", "subbasin", "agency", "coalition", "commission", "utility", "bureau"):
        if w.endswith(t) and len(w) - len(t) >= 4:
            return [w[: -len(t)], t]
    return [w]


def canonical(spelling: str) -> tuple[str, str, str, bool]:
    """kind with numbers, proper name, given names (for persons: the possible ones, or an initial
    with ``*``), and whether the form by itself names one entity."""
    ws = [w for w in words(spelling) if w not in SMALL]
    kinds: set[str] = set()
    numbers, rest = [], []
    i = 0
    while i < len(ws):
        w = ws[i]
        if w == "sub" and ws[i + 1 : i + 2] == ["basin"]:
            kinds.add("subbasin")
            i += 1
        elif w.isdigit():
            numbers.append(w.lstrip("0") or "0")
        elif w in TYPES:
            kinds.add(w)
        elif w in SHORT:
            kinds.add(SHORT[w])
        elif w in INITIALS and len(ws) > 1:
            kinds |= set(INITIALS[w].split())
        else:
            rest.append(w)
        i += 1
    if "supervisors" in kinds:
        kinds.discard("board")
    if not kinds and not numbers:
        return _person(rest, "," in spelling)
    if not kinds:
        return "# " + " ".join(sorted(rest)) + " " + " ".join(numbers), "", "", True
    return " ".join([*sorted(kinds), *sorted(numbers)]), "".join(x for x in rest if len(x) > 1), "", True


def _person(ws: list[str], comma: bool) -> tuple[str, str, str, bool]:
    ws = [w for w in ws if w not in HONORIFICS]
    long = [w for w in ws if len(w) > 1]
    known = [w for w in long if w in GIVEN or w in NICKNAMES]
    if not known and long:  # a lost blank between given and family name
        for w in long:
            a = next((g for g in sorted(GIVEN, key=len, reverse=True) if w.startswith(g) and len(w) - len(g) >= 4), None)
            if a:
                long[long.index(w) : long.index(w) + 1] = [a, w[len(a) :]]
                known = [a]
                break
    if known and len(long) > 1:
        g = known[-1] if comma and long[0] in known else known[0]
        rest = list(long)
        rest.remove(g)
        options = NICKNAMES.get(g, g).split()
        return "person", "".join(rest), "|".join(sorted(options)), len(options) == 1
    single = [w for w in ws if len(w) == 1]
    if long and single and len(long) == 1:
        return "person", long[0], single[0] + "*", False
    if len(long) < 2:
        return "", "".join(long), "", True
    return "", "".join(long), "", True


def distance(a: str, b: str, most: int) -> int:
    """Damerau's edit distance within a band of ``most``; ``most`` + 1 beyond. Letters may be put
    between two that are swapped, so that a swap with an insertion counts as two errors."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    rows = [[far] * (len(b) + 1) for _ in range(len(a) + 1)]
    rows[0][: most + 1] = range(min(most, len(b)) + 1)
    seen: dict[str, int] = {}
    for i in range(1, len(a) + 1):
        row, before, match = rows[i], rows[i - 1], 0
        if i <= most:
            row[0] = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            last, m = seen.get(b[j - 1], 0), match
            if a[i - 1] == b[j - 1]:
                cost, match = before[j - 1], j
            else:
                cost = before[j - 1] + 1
            cost = min(cost, before[j] + 1, row[j - 1] + 1)
            if last and m:
                cost = min(cost, rows[last - 1][m - 1] + (i - last - 1) + 1 + (j - m - 1))
            row[j] = min(cost, far)
        seen[a[i - 1]] = i
    return rows[-1][-1]


def allowed(n: int) -> int:
    return 0 if n < ONE_FROM else 1 if n < TWO_FROM else ERRORS


def edges_of(n: int, k: int) -> list[int]:
    """Where the k+1 segments of a name of n letters begin and end."""
    return [n * i // (k + 1) for i in range(k + 2)]


def index_keys(name: str) -> list[str]:
    """The segments of a name, one more than errors are allowed: names at the limit of a length are cut both ways."""
    out = []
    for k in range(allowed(len(name) - 1) or 1, allowed(len(name)) + 1):
        at = edges_of(len(name), k)
        out += [f"{k}.{len(name)}.{s}.{name[at[s] : at[s + 1]]}" for s in range(k + 1)]
    return out


def probe_keys(name: str) -> list[str]:
    """The segments that a name within the errors could have at each place."""
    out = set()
    for n in range(max(1, len(name) - ERRORS), len(name) + ERRORS + 1):
        k = allowed(min(n, len(name)))
        if not k or abs(n - len(name)) > k:
            continue
        at = edges_of(n, k)
        for s in range(k + 1):
            for shift in range(-k, k + 1):
                a, b = at[s] + shift, at[s + 1] + shift
                if a < 0 or b > len(name) or a >= b:
                    continue
                part = name[a:b]
                heads = {part[0]} | ({name[a - 1]} if a else set())
                tails = {part[-1]} | ({name[b]} if b < len(name) else set())
                if len(part) == 1:
                    out |= {f"{k}.{n}.{s}.{c}" for c in heads | tails}
                else:
                    out |= {f"{k}.{n}.{s}.{h}{part[1:-1]}{t}" for h in heads for t in tails}
    return sorted(out)


def compatible(a: str, b: str) -> bool:
    """Whether two given names can be the same."""
    if a == b:
        return True
    for x, y in ((a, b), (b, a)):
        if x.endswith("*"):
            return any(o.startswith(x[0]) for o in y.split("|"))
    return bool(set(a.split("|")) & set(b.split("|")))


@F.pandas_udf(FORM)
def _form(spellings: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([canonical(s) for s in spellings], columns=["kind", "name", "given", "full"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _index(names: pd.Series) -> pd.Series:
    return names.map(index_keys)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _probe(names: pd.Series) -> pd.Series:
    return names.map(probe_keys)


@F.pandas_udf(T.IntegerType())
def _errors(a: pd.Series, b: pd.Series, ga: pd.Series, gb: pd.Series) -> pd.Series:
    out = []
    for x, y, g, h in zip(a, b, ga, gb, strict=True):
        most = allowed(min(len(x), len(y)))
        d = distance(x, y, most) if compatible(g, h) else most + 1
        out.append(d if d <= most else None)
    return pd.Series(out, dtype="Int32")


def spellings(*columns: DataFrame) -> DataFrame:
    """(name, n): the distinct non-empty values of one-column tables and their rows."""
    parts = [c.toDF("name").where(F.col("name") != "").groupBy("name").agg(F.count("*").alias("n")) for c in columns]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("name").agg(F.sum("n").alias("n"))


def link(names: DataFrame) -> DataFrame:
    """(name, entity): every spelling of (name, n) with the class it belongs to.

    Names must be distinct, non-null and non-empty, as ``spellings`` gives them. Any difference in
    the string makes another spelling. An empty table gives no rows. An initial or a short form that
    fits more than one person of the nearest surname stays by itself.
    """
    formed = cut(names.select("name", "n", _form("name").alias("f")).select(F.col("name").alias("spelling"), "n", "f.*"))
    # A form's id is its text; forms are as many as spellings at most.
    key = F.concat_ws("\t", "kind", "name", "given")
    forms = cut(
        formed.groupBy("kind", "name", "given", "full").agg(F.sum("n").alias("n"), F.count("*").alias("spellings")).withColumn("id", key)
    )
    # A proper name that three kinds of bodies or more bear is no slip of the pen.
    body = F.regexp_replace("kind", r" ?\d+", "")
    borne = forms.where(F.col("name") != "").groupBy("name").agg((F.count_distinct(body) > 2).alias("borne"))
    forms = forms.join(borne, "name", "left")
    whole = forms.where((F.length("name") >= ONE_FROM))
    index = whole.where("full").select(
        "kind", F.explode(_index("name")).alias("k"), F.col("id").alias("to"), F.col("name").alias("to_name"), F.col("given").alias("to_given"), F.col("n").alias("to_n"), F.col("borne").alias("to_borne")
    )
    probe = whole.select("kind", F.explode(_probe("name")).alias("k"), "id", "name", "given", "n", "full", "borne")
    heavier = ~F.col("full") | (F.col("to_n") > F.col("n")) | ((F.col("to_n") == F.col("n")) & (F.col("to") < F.col("id")))
    near = (
        probe.join(index, ["kind", "k"])
        .where((F.col("id") != F.col("to")) & heavier & ~(F.col("full") & F.col("borne") & F.col("to_borne") & (F.col("name") != F.col("to_name"))))
        .select("id", "to", "name", "to_name", "given", "to_given", "to_n", "full")
        .distinct()
        .withColumn("errors", _errors("name", "to_name", "given", "to_given"))
        .where(F.col("errors").isNotNull())
    )
    # Short forms go to the one person they fit best. If another full person fits as well, to none.
    best = near.groupBy("id", "full").agg(
        F.min_by("to", F.struct("errors", -F.col("to_n"), "to")).alias("to"),
        F.min_by("to_given", F.struct("errors", -F.col("to_n"), "to")).alias("to_given"),
        F.min("errors").alias("least"),
    )
    rivals = near.where(~F.col("full")).groupBy("id", "errors").agg(F.count_distinct("to_given").alias("rivals"))
    chosen = (
        best.join(rivals.select("id", F.col("errors").alias("least"), "rivals"), ["id", "least"], "left")
        .where(F.col("full") | (F.coalesce("rivals", F.lit(1)) == 1))
        .select("id", "to")
    )
    roots = follow(forms.select("id").join(chosen, "id", "left").select("id", F.coalesce("to", "id").alias("to")))
    return formed.select("spelling", key.alias("id")).join(roots, "id").select(F.col("spelling").alias("name"), F.col("to").alias("entity"))


def follow(pointers: DataFrame) -> DataFrame:
    """(id, to): where each pointer's chain ends, by doubling. Ends point to themselves; there must
    be no other cycles."""
    pointers = cut(pointers)
    while True:
        ahead = pointers.select(F.col("id").alias("to"), F.col("to").alias("next"))
        further = cut_in_loop(pointers.join(ahead, "to").select("id", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        if further.where("moved").isEmpty():
            return further.select("id", "to")
        pointers = further.select("id", "to")


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = table(spark, sf_dir, "edgelist"), table(spark, sf_dir, "nodelist")
    return link(spellings(nodes.select("entity_name"), edges.select("source"), edges.select("target")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of spellings of one entity. The pairs are asked for; a class holds the spellings of
    one name, which don't grow with the number of rows that bear it."""
    linked = cut(_linked(spark, sf_dir))
    a, b = linked.select(F.col("name").alias("name_a"), "entity"), linked.select(F.col("name").alias("name_b"), "entity")
    return a.join(b, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with its class and the number of spellings in it."""
    linked = cut(_linked(spark, sf_dir))
    return linked.join(linked.groupBy("entity").agg(F.count("*").alias("n_spellings")), "entity").select("name", "entity", "n_spellings")


QUERIES = {"p5_found": p5_found, "p5_entities": p5_entities}
#: Edit distances over canonical forms aren't SQL; the tests have a brute-force version.
ORACLE: dict[str, str] = {}
