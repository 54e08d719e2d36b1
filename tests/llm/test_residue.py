import random

import numpy as np
import pytest

from tidegraph.llm import residue as R

CASES = [
    "Dear {{agency_name}},\nyour permit is ready.", "Total came to {% amount %} this year.", "See ${permitNo} for more.", "<%= chair %>", "By «county» order", "<<PLAN TITLE>> of 2020",
    "the [[contact_email]] address", "@@basin@@ plan", "in %COUNTY% now", "__BASIN__ map", "moved {0} feet", "a %s b", "[INSERT COUNTY] water", "<insert chair here>", "due [DATE TO BE ADDED].",
    "(name of agency) met", "_______ [enter number] wells", "on XX/XX/20XX", "the [Plan Title] text", "Lorem ipsum dolor sit amet consectetur.", "Land Use\n\nSample text goes here.",
    "la;f sjlsj; slsl ;l;j ssdj", "aadff jjsdf skkalk jks lfla djdffjff", "Please enable JavaScript to view this page.", "HTTP 504 - Gateway Timeout. Please try again later.", "Menu\n\nSeite nicht gefunden.",
    "Some Library\nHome | Plans | Contact\n\nThis document failed to load.", "Error 429\nToo Many Requests\nReference: be0b", "Unable to show your file at this time. Request 817922bd was logged.",
    'Traceback (most recent call last):\n  File "render.py", line 28\nKeyError: \'x\'',
    "Oops! Something went wrong. Our engineers have been notified.", "Sorry, the document you are looking for could not be displayed. It might have been renamed.", "Plan Area\n\nWarning: Undefined index chair in view on line 7",
    "The board met on Monday.\n\ntest test test test test test test\n\nIt adjourned.", "blah blah blah blah blah blah blah", "foo bar foo bar foo bar foo bar foo bar foo bar foo bar",
    "Menu\n\nVestibulum tellus praesent, mattis ornare felis eros. Nunc placerat morbi.", "An unexpected error occurred.", "Página não encontrada", "word " * 4000,
]
OTHERS = [
    "Let the wells be {A, B, C} and the set {1, ..., 4}; f(x) = {x | x > 0}.", 'The call x[["edgelist"]] returns rows where <source> is known.', "A map [sic] and a note [12].",
    "The first draft still had lorem ipsum in its appendix, which was replaced.", "The schedule is to be determined (TBD); the sample text of the ordinance is in Appendix C.",
    "Values of 100% and 57%s-curves are shown; well __2__ is underlined.", "In the template, the blank after 'Dear' is filled by the clerk.",
    "A page not found in the binder was the signed map, and the clerk put it back.", "The new dashboard needs JavaScript, so the county also prints the tables.",
    "On 14 May the data portal answered error 500 for an hour, and staff told growers by mail.", "Best viewed with scripts enabled.\n\nThe board met and agreed on the plan for the basin.",
    "Error: image 3 not found.\n\nTotal yield came to 508 acre-feet, of which 63 were sold.", "Access was denied to the surveyors at two gates, and permission came a week later.",
    "", " \n\t", None, "Approved 5-0", "n/a", " ".join(f"word{i}" for i in range(4000)),
    "Sorry, said the clerk, the page you are looking for is in the other binder, and the board moved on.", "No, no, no, said the chair.", "The staff was very, very, very tired.",
    "Something went wrong with pump 4, and the district bought another one in May.", "El distrito consulta la portada del plan temporal y la comisión vela por el acuífero.", "Magna Carta was quoted in the hearing.",
    "Our team has been told of the change. The board then set the rate at 9 dollars.",
]


def test_cases_and_others(spark):
    rows = [(i, t, "x") for i, t in enumerate(CASES + OTHERS)] + [(0, CASES[0], "x"), (None, CASES[0], "x")]
    df = spark.createDataFrame(rows, "k long, text string, h string")
    got = R.residue(df, "k", "text").collect()
    assert {r.k for r in got} == {None, *range(len(CASES))}
    assert len(got) == len(CASES) + 1
    assert R.residue(df.limit(0), "k", "text").count() == 0


def test_labels_run_through_near_copies(spark):
    """Chains of pages, each like the one before, take the label over; pages with more of their own don't."""
    base = [f"w{i}" for i in range(80)]
    known = "Please enable JavaScript to view this page."
    texts = [" ".join(base), " ".join(base[1:]), known, " ".join([*base[:40], "Extra", "sentence.", *base[40:]])]
    assert R.similarity(R_normal(texts[0]), R_normal(texts[1])) >= R.SIMILAR
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    assert {(r.k, r.reason) for r in R.residue(df, "k", "text").collect()} == {(2, "notice")}


def test_pages_that_only_propagation_finds(spark):
    """A notice with a sentence the grammar lacks, and a placeholder in a notation it lacks; not content, and not a filled letter."""
    known = ["Please enable JavaScript to view this page.", "JavaScript is required.", "Unable to show your file at this time.", "Cookies must be enabled.", "The page you requested is gone from the archive of the county.",
             "Please try again later with one of the modern programs that the help pages list.", "Please contact the help desk of the county library if the trouble stays.",
             "Please return to the start of the library and look for the plan there by name.", "Please check the address of the plan for slips in the name of the basin."]
    assert R.is_notice("\n".join(known)) and R.sentence_kind("Kindly use a browser with scripts.") == "content"
    letter = lambda who: " ".join([*letter_lines[:4], f"We thank {who} for the report.", *letter_lines[4:]])
    letter_lines = [f"The clerk of district {w} has put the map of parcel {w} on file." for w in "ab cd ef gh ij kl mn op".split()]
    texts = ["\n".join(known), "\n".join([*known, "Kindly use a browser with scripts."]), "\n".join([*known, "Pumping rose to nine feet."]), letter("{{agency}}"), letter("~agency~"), letter("Marlow")]
    got = R.residue(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k", "text")
    assert {(r.k, r.reason) for r in got.collect()} == {(0, "notice"), (1, "near"), (3, "marked"), (4, "near")}


def R_normal(t):
    return " ".join(t.lower().split())


def test_simhash_tables_find_near_texts():
    rng = random.Random(9)
    found = total = 0
    for _ in range(150):
        a = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        b = list(a)
        b[rng.randrange(5, 115)] = "new"
        x, y = " ".join(a), " ".join(b)
        if R.similarity(x, y) < R.SIMILAR:
            continue
        total += 1
        k = R.keys_of(R.simhash([x, y]))
        found += bool((k[0] == k[1]).any())
    assert total > 100 and found / total >= 0.9
    far = R.keys_of(R.simhash([" ".join(f"a{i}" for i in range(200)), " ".join(f"b{i}" for i in range(200))]))
    assert (far[0] == far[1]).sum() <= 1


def test_listed_notices_pass_the_prefilter():
    """One text for each notice and wording of the expressions."""
    texts = [
        "La página solicitada no se encuentra", "Diese Seite wurde nicht gefunden", "Diese Seite wurde nicht geladen", "Die Seite existiert nicht", "The document you requested is elsewhere",
        "The file you are looking for is elsewhere", "The record you were looking for is elsewhere", "We could not open the file", "We cannot show this page", "Failed to load the map", "Our server was not able to load the map",
        "The site was not here", "This view is not on this server", "This record has been moved", "The page could not be displayed", "Not Found", "Conflict", "Gone", "Payload too large", "Forbidden", "Payment required", "Server error", "Unsupported media type", "Request time-out",
        "Access denied", "Connection refused", "Connection reset", "You do not have access to view this page", "Your session has expired", "The site is down for planned maintenance", "The site is temporarily down", "This site is currently down for short maintenance",
        "Checking your browser before you continue", "Please wait", "Loading...", "Please enable scripting", "Turn on JS", "Use a newer browser", "Scripts are off", "The portal cannot run without it", "The map needs cookies", "We use cookies", "Cookies must be on",
        "Página no encontrada", "La página no existe", "Acceso denegado", "Active el JavaScript", "Seite nicht gefunden", "Zugriff verweigert", "Page introuvable", "Page non trouvée", "La page demandée n'existe plus", "Accès refusé", "System error: 5", "KeyError: 'x'", "Error 503", 'File "a.py", line 28',
    ]
    assert [t for t in texts if not R.is_notice(t)] == []
    assert [t for t in texts if not R.hinted(t)] == []


def limit_pairs():
    """Pairs of a similarity just above the least one, at which sampled bits miss many."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=7))
    out = []
    while len(out) < 200:
        a = [word() for _ in range(200)]
        b = list(a)
        for k in (20, 70, 120, 170):
            b[k] = word()
        out.append((" ".join(a), " ".join(b)))
    return out


def test_all_pairs_at_the_limit_meet():
    for x, y in limit_pairs():
        assert R.SIMILAR <= R.similarity(x, y) < 0.85
        (k, j), _ = R.prefixes([x, y])
        s = R.simhash([x, y])
        assert len(np.intersect1d(k, j)) and int(s[0] ^ s[1]).bit_count() <= R.MOST_BITS
        (k, j), _ = R.prefixes([x, y], np.random.default_rng(3).integers(0, 9, R.BUCKETS))
        assert len(np.intersect1d(k, j))


def test_near_pages_at_the_limit_are_found(spark):
    """Every text 0.8 like one with a placeholder, with the placeholder spoilt, takes the label over."""
    pairs = [(a.replace(a.split()[100], "{{" + a.split()[100] + "}}"), b.replace(b.split()[100], "~" + b.split()[100] + "~")) for a, b in limit_pairs()[:60]]
    rows = [(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    got = R.residue(spark.createDataFrame(rows, "k long, text string"), "k", "text").collect()
    assert {r.k for r in got} == set(range(120))


def test_simhash_of_a_batch_equals_single_ones():
    texts = ["", "one", "a b c d e f g", "x " * 500, "long " * 70000]
    assert (R.simhash(texts) == np.concatenate([R.simhash([t]) for t in texts])).all()


@pytest.mark.parametrize(("text", "kind"), [("Menu", "chrome"), ("Home | Plans", "chrome"), ("Please try again later.", "tail"), ("Not found", "notice"), ("The board met.", "content")])
def test_kinds_of_sentences(text, kind):
    assert R.sentence_kind(text) == kind
