"""Golden tables of the scalar operators, one job per table."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from streetloom.functions import lookups as look
from streetloom.functions import patterns as pat
from streetloom.functions import text as tx
from streetloom.operators.fuzzy import damerau, nearest, region_fuzzy, suffix_short_fuzzy
from streetloom.operators.parse import split_road
from streetloom.vocab import tables as v

TABLES = {
    "collapse_space": (tx.collapse_space, [("a \t\n\r  b", "a b"), (" x ", "x"), ("", ""), (None, None)]),
    "strip": (tx.strip_punctuation, [("APT. #4, BLDG*2", "APT #4 BLDG2"), ("O’Neil-Smith/1", "ONeilSmith1")]),
    "strip_keep": (lambda x: tx.strip_punctuation(x, True, True), [("a-b/c.", "a-b/c")]),
    "unknown": (tx.normalize_unknown, [("UnKnOwN", ""), ("UNKNOWN CITY", "UNKNOWN CITY"), (None, None)]),
    "base_field": (tx.base_field, [("  unknown ", ""), (" salt  lake ", "SALT LAKE")]),
    "substitute": (tx.diacritics_substitute, [("José Ÿ Š", "jose y s"), ("ÆÐØÞßŒ", "aeopso"), ("é", "e"), ("Ǽ", "a")]),
    "transliterate": (tx.diacritics_transliterate, [("Æ", "ae"), ("Þór", "thor"), ("Straße", "strasse"), ("Œuvre", "oeuvre"), ("Ð", "d"), ("Йошка Щукин", "yoshka shchukin"), ("Ηλίας", "ilias"), ("山", "山")]),
    "region_alternates": (look.region_alternates, [("rhode island", "RHODE IS|RHODE ISL|RHODE ISLAND|RHODE ISLD|RI"), ("zz", None)]),
    "suffix_alternates": (look.suffix_alternates, [("Ave", "AV|AVE|AVEN|AVENU|AVENUE|AVN|AVNUE"), ("x1", None)]),
    "region": (look.region_short, [("N. Carolina", "NC"), ("2ND", None), ("puerto rico", "PR"), ("Nunavut", None), ("nunavat terr", "NU"), ("zz", None), (None, None)]),
    "suffix_primary": (look.suffix_primary, [("PRAIRIE", "PRAIRIE"), ("ave.", "AVENUE"), ("1ST", None), ("FORESTS", "FOREST"), ("RIVR", "RIVER")]),
    "suffix_short": (look.suffix_short, [("PRAIRIE", "PR"), ("Avenue", "AVE"), ("Bypas", "BYP")]),
    "directional": (look.directional_abbrev, [("NORTHEAST", "NE"), ("n", "N"), ("N.", None)]),
    "directional_full": (look.directional_full, [("ne", "NORTHEAST"), ("West", "WEST"), ("x", None)]),
    "unit": (look.unit_normalize, [("Apartment", "APT"), ("#", "#"), ("hngr", "HNGR"), ("Flat", None)]),
    "pr_type": (look.pr_street_type_full, [(" Ave ", "AVENIDA"), ("calle", "CALLE"), ("street", None)]),
    "pr_abbrev": (look.pr_street_type_abbrev, [(" avenida", "AVE"), ("CLL", "CLL")]),
    "pr_second": (look.pr_secondary, [("entrega  general", "GEN DEL"), ("URB", "URB"), ("x", None)]),
    "postal": (pat.postal_normalize, [("627011234", "62701-1234"), ("k1a0b1", "K1A 0B1"), ("62701", "62701"), ("unknown", ""), ("m5-x.", "M5X"), ("62701 - 1234", "62701-1234")]),
    "country": (pat.country_normalize, [("U.S.A.", ""), ("M5X", "M5X"), ("mx", "MEXICO"), ("Trinidad & Tobago", "TRINIDAD AND TOBAGO"), ("2US", "2US")]),
    "pobox": (pat.pobox_normalize, [("POB#11890", "PO BOX 11890"), ("Firm Caller 8", "PO BOX 8"), ("lockbox 3a", "PO BOX 3A"), ("PO BOX", None), ("PO BOX 1 2", None)]),
    "rural": (pat.rural_route_normalize, [("RFD Route 4 #87a", "RR 4 BOX 87A"), ("RR 2 BOX 18 Bryan Dairy Rd", "RR 2 BOX 18"), ("Rural Route 03 box 04", "RR 3 BOX 4"), ("Main St", None)]),
    "military": (pat.military_street, [("unit 2050 box 4190", "UNIT 2050 BOX 4190"), ("psc 0003 box 0010", "PSC 0003 BOX 0010"), ("unit a box 1", None)]),
    "highway": (pat.highway_normalize, [
        ("KY ST HWY 1", "KY STATE HIGHWAY 1"), ("I10", "INTERSTATE 10"), ("IH280 BYPASS", "INTERSTATE 280 BYP"), ("KENTUCKY 440", "KY HIGHWAY 440"), ("US 41 SW", "US HIGHWAY 41 SW"), ("ST HWY 303", "STATE HIGHWAY 303"), ("SR MM", "STATE ROUTE MM"), ("SR 220", "STATE ROAD 220"),
        ("HIGHWAY 64 BYPASS ROAD", "HIGHWAY 64 BYPASS RD"), ("INTERSTATE HWY 55", "INTERSTATE 55"), ("HWY FM 1320", "FM 1320"), ("FARM TO MARKET 1200", "FM 1200"), ("CR 441", "COUNTY ROAD 441"), ("CNTY HWY 140", "COUNTY HIGHWAY 140"), ("TSR 45", "TOWNSHIP ROAD 45"), ("RANCH RD 620", "RANCH ROAD 620"),
        ("WEST VIRGINIA 10 FRONTAGE ROAD", "WV HIGHWAY 10 FRONTAGE RD"), ("RD 39.4", "ROAD 39.4"), ("EXPRESSWAY 55", "EXPRESSWAY 55"), ("MAIN STREET", None), ("OKLAHOMA AVE", None), ("NORTH CAROLINA", None), ("I STREET", None), ("US GRANT", None), ("", None), ("  ", None)]),
    "region_fuzzy": (region_fuzzy, [("ILLNIOIS", "IL"), ("Calfornia", "CA"), ("ZZQQXX", None), ("XY", None), ("tx", "TX"), (None, None)]),
    "suffix_fuzzy": (suffix_short_fuzzy, [("AVENEU", "AVE"), ("Bolevard", "BLVD"), ("qqqqqq", None)]),
}


@pytest.mark.parametrize("name", TABLES)
def test_golden(spark, name):
    f, rows = TABLES[name]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, x string")
    got = [r[0] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]
    assert got == [b for _, b in rows]


def test_structs(spark):
    df = spark.createDataFrame([("apo ae 09021-0002",), ("apo ae",), ("k1a 0b1",), ("84088",)], "x string")
    rows = df.select(pat.military_last_line(F.col("x")).alias("m"), pat.postal_classify(F.col("x")).alias("p")).collect()
    assert tuple(rows[0]["m"]) == ("APO", "AE", "09021-0002") and rows[1]["m"] is None
    assert tuple(rows[2]["p"]) == ("K1A 0B1", 90) and tuple(rows[3]["p"]) == ("84088", 50) and rows[0]["p"] is None


def test_pr_dialect(spark):
    df = spark.createDataFrame([("", "00926", True), ("pr ", None, True), ("", "00801", False), (None, None, False)], "r string, p string, e boolean")
    assert all(r[0] == r[1] for r in df.select(look.pr_dialect(F.col("r"), F.col("p")), "e").collect())


def test_vocabulary_sizes():
    s, r = v.suffixes(), v.regions()
    assert len(s) == 551 and len({x[1] for x in s.values()}) == 204
    assert all(p in s and short in s for p, short in s.values())
    assert len(r) == 209 and len({x[1] for x in r.values()}) == 75 and max(len(k.split()) for k in r) == 8
    assert sorted(set(s) & set(r)) == ["CT", "KY", "MT", "PR", "VIS", "WY"]


def test_decomposition_table_matches_unicode(spark):
    chars = [chr(i) for i in range(0xC0, 0x2000) if unicodedata.category(chr(i))[0] == "L" and len(d := unicodedata.normalize("NFD", chr(i))) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:])][:600]
    df = spark.createDataFrame([(x,) for x in chars], "x string")
    for r in df.select("x", tx.diacritics_substitute(F.col("x")).alias("y")).collect():
        base = unicodedata.normalize("NFD", r["x"])[0]
        assert r["y"] == tx._BASE.get(base, base).lower()


def test_damerau():
    assert damerau("CA", "ABC") == 2 and damerau("AVENEU", "AVENUE") == 1 and damerau("", "AB") == 2
    assert nearest("STRET", ("STREET", "STREETS")) == "STREET"


def test_split_road(spark):
    df = spark.createDataFrame([("N MAIN ST W",), ("SOUTH CAROLINA AVE",), ("BROADWAY",), ("NORTH EAST OAK HILL AVE",)], "x string")
    got = [tuple(r[0]) for r in df.select(split_road(F.col("x"))).collect()]
    assert got[0] == ("N", "MAIN ST", "W") and got[1] == ("", "SOUTH CAROLINA AVE", "") and got[2] == ("", "BROADWAY", "") and got[3] == ("NE", "OAK HILL AVE", "")
