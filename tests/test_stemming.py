"""The stemmer against published pairs, and as a column."""

import pytest

from sparkloom.functions import stemming
from pyspark.sql import functions as F

# Words and stems of the published sample.
PAIRS = {
    "caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "sky": "sky", "consign": "consign", "consigned": "consign",
    "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist", "consistency": "consist", "consistent": "consist",
    "consistently": "consist", "consisting": "consist", "consists": "consist", "consolation": "consol", "consolations": "consol", "consolatory": "consolatori",
    "console": "consol", "consoled": "consol", "consoles": "consol", "consolidate": "consolid", "consolidated": "consolid", "consolidating": "consolid",
    "consoling": "consol", "consolingly": "consol", "consols": "consol", "consonant": "conson", "consort": "consort", "consorted": "consort",
    "consorting": "consort", "conspicuous": "conspicu", "conspicuously": "conspicu", "conspiracy": "conspiraci", "conspirator": "conspir",
    "conspirators": "conspir", "conspire": "conspir", "conspired": "conspir", "conspiring": "conspir", "constable": "constabl", "constables": "constabl",
    "constance": "constanc", "constancy": "constanc", "constant": "constant", "knack": "knack", "knackeries": "knackeri", "knacks": "knack",
    "knag": "knag", "knave": "knave", "knaves": "knave", "knavish": "knavish", "kneaded": "knead", "kneading": "knead", "knee": "knee", "kneel": "kneel",
    "kneeled": "kneel", "kneeling": "kneel", "kneels": "kneel", "knees": "knee", "knell": "knell", "knelt": "knelt", "knew": "knew", "knick": "knick",
    "knif": "knif", "knife": "knife", "knight": "knight", "knightly": "knight", "knights": "knight", "knit": "knit", "knits": "knit", "knitted": "knit",
    "knitting": "knit", "knives": "knive", "knob": "knob", "knobs": "knob", "knock": "knock", "knocked": "knock", "knocker": "knocker",
    "knockers": "knocker", "knocking": "knock", "knocks": "knock", "knopp": "knopp", "knot": "knot", "knots": "knot",
    "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "luxuriated": "luxuri", "hoped": "hope", "cry": "cri",
    "by": "by", "say": "say", "generate": "generat", "generally": "general", "communism": "communism", "skies": "sky", "news": "news", "inning": "inning",
    "proceed": "proceed", "yelling": "yell", "enjoying": "enjoy", "geology": "geolog", "happily": "happili", "adoption": "adopt", "rolled": "roll",
    "sensibilities": "sensibl", "troubled": "troubl", "agreed": "agre", "feed": "feed", "o'clock's": "o'clock",
}


@pytest.mark.parametrize("word, want", sorted(PAIRS.items()))
def test_published_stems(word, want):
    assert stemming.stem(word) == want


def test_sql_has_the_same_rules():
    """The DuckDB rules and the Python ones on the sample and on many made-up words."""
    import itertools

    import duckdb

    made = ["".join(p) for p in itertools.product(("", "y", "tr", "gener", "é"), ("a", "ay", "ee", "oo"), ("t", "bb", "ck", "w", "y"), ("ing", "edly", "ational", "ies", "fulness", "ogi", "ll", "li", "s", "e", "ment", "ative", "izer"))]
    words = sorted({w for w in [*PAIRS, *made] if "'" not in w})
    con = duckdb.connect()
    con.execute("CREATE TABLE v AS SELECT unnest(?) AS w", [words])
    got = dict(con.sql(f"WITH {stemming.stem_sql('v')} SELECT w, stem FROM stemmed").fetchall())
    assert got == {w: stemming.stem(w) for w in words}


def test_stems_as_a_column(spark):
    rows = spark.createDataFrame([(1, "The relational PONIES' hopping"), (2, None), (3, ""), (4, "the and of")], "id int, t string").repartition(1)
    got = {r.id: r.s for r in rows.select("id", stemming.stemmed_tokens(F.col("t"), ("the", "and", "of")).alias("s")).collect()}
    assert got == {1: ["relat", "poni", "hop"], 2: None, 3: [], 4: []}
