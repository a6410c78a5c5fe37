"""The training-data operators against brute force, round trips and planted cases; nulls, empties and clashing names."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streetloom.llm import abuse, addressparts, copies, encodings, leaks, linkage, lookalikes, names, packing, sites, vocabmap

A13 = copies.FIXED + copies.SWAPPABLE
VOCAB = [("region", "OH", "OHIO"), ("region", "AL", "ALABAMA"), ("region", "AK", "ALASKA"), ("region", "VA", "VIRGINIA"), ("region", "WV", "WEST VIRGINIA"), ("street_suffix", "ST", "STREET"), ("street_suffix", "AVE", "AVENUE"), ("street_suffix", "BLVD", "BOULEVARD"), ("street_suffix", "RD", "ROAD"),
         ("secondary_designator", "APT", "APARTMENT"), ("secondary_designator", "STE", "SUITE"), ("secondary_designator", "BSMT", "BASEMENT"), ("predirectional", "N", "NORTH"), ("predirectional", "NE", "NORTHEAST"), ("predirectional", "SW", "SOUTHWEST"), ("predirectional", "S", "SOUTH"), ("predirectional", "E", "EAST"), ("predirectional", "W", "WEST")]


def table(spark, rows, id_col="addr_id", more=""):
    cols = [id_col, *A13]
    df = spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], f"{id_col} long, " + ", ".join(f"{c} string" for c in A13))
    # names that operators use inside must not matter
    return df.withColumns({"received_at": F.lit("2024-01-01").cast("timestamp"), "id": F.lit("x"), "k1": F.lit(1), "value": F.lit("y"), "kind": F.lit("z"), "n": F.lit(0), "field": F.lit("f"), "_n": F.lit(1), "rank": F.lit(1), "bucket": F.lit(9)})


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame(VOCAB, "field string, code string, label string")


# --- p2 ---

def test_copies_against_brute_force(spark):
    rng = random.Random(1)
    base = [dict(street_name=f"Main {i}", primary_number=str(i), city="Éast", postal="1", business_name="A & B") for i in range(20)]
    rows = []
    for i in range(200):
        r = dict(rng.choice(base), addr_id=1000 - i)
        if rng.random() < 0.5:
            r["city"], r["street_name"] = r["street_name"].upper() + " .", " " + r["city"].lower()
        if rng.random() < 0.2:
            r["type"] = rng.choice(["", None, "--"])
        rows.append(r)
    rows += [dict(addr_id=5000), dict(addr_id=5001, city="  "), dict(addr_id=5002, city="East"), dict(addr_id=5003, city="Éast")]
    clean = lambda x: "".join(c for c in (x or "").upper() if c.isalnum())
    groups = defaultdict(list)
    for r in rows:
        groups[tuple(clean(r.get(c)) for c in copies.FIXED), tuple(sorted(clean(r.get(c)) for c in copies.SWAPPABLE))].append(r["addr_id"])
    want = sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    assert sorted(map(tuple, copies.p2_found(table(spark, rows)).collect())) == want
    assert (5000, 5001) in want and (5002, 5003) not in want
    assert sorted(map(tuple, copies.p2_ledger(table(spark, rows)).collect())) == sorted((min(g), len(g)) for g in groups.values())
    assert copies.p2_found(table(spark, []).limit(0)).count() == 0


def test_ledger_grows_by_batches_and_keeps_untouched_buckets(spark, tmp_path):
    schema, at = "k1 long, k2 long, i long", str(tmp_path / "l")
    ledger = copies.CopyLedger(spark, at, buckets=4)
    assert ledger.update(spark.createDataFrame([(k, 0, 10 + k) for k in range(8)] * 2, schema), "i", "first")
    before = dict(ledger.where)
    ledger = copies.CopyLedger(spark, at, buckets=99)  # read again from the folder; the buckets are the ledger's
    assert ledger.buckets == 4
    second = spark.createDataFrame([(1, 0, 3), (5, 0, 99)], schema)
    assert ledger.update(second, "i", "second") and {k for k in before if ledger.where[k] != before[k]} == {1}
    state = lambda x: {r["k1"]: (r["n"], r["first_id"]) for r in x.state().collect()}
    want = state(ledger)
    assert want[1] == (3, 3) and want[5] == (3, 15) and want[0] == (2, 10) and len(want) == 8
    again = copies.CopyLedger(spark, at)
    assert not again.update(second, "i", "second") and state(again) == want  # a batch tried again changes nothing
    assert again.update(second.limit(0), "i", "empty") and state(again) == want
    files = {f for f in again.state([1]).inputFiles()}
    assert files and all("bucket=1/" in f for f in files)


def test_ledger_survives_a_batch_that_fails(spark, tmp_path):
    schema, at = "k1 long, k2 long, i long", str(tmp_path / "l")
    ledger = copies.CopyLedger(spark, at, buckets=2)
    ledger.update(spark.createDataFrame([(1, 0, 1), (2, 0, 2)], schema), "i", "a")
    ledger._switch = lambda: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        ledger.update(spark.createDataFrame([(1, 0, 0)], schema), "i", "b")
    back = copies.CopyLedger(spark, at)
    assert back.batches == ["a"] and {r["k1"]: r["n"] for r in back.state().collect()} == {1: 1, 2: 1}
    other = copies.CopyLedger(spark, at)
    back.update(spark.createDataFrame([(1, 0, 0)], schema), "i", "b")
    with pytest.raises(RuntimeError):  # two writers: the second one must begin again
        other.update(spark.createDataFrame([(2, 0, 0)], schema), "i", "c")
    assert {r["k1"]: (r["n"], r["first_id"]) for r in copies.CopyLedger(spark, at).state().collect()} == {1: (2, 0), 2: (1, 2)}


def test_a_kept_ledger_skips_the_batches_it_holds(spark, tmp_path):
    rows = table(spark, [dict(addr_id=i, city=f"c{i % 5}") for i in range(20)])
    for _ in range(2):
        state, _ = copies.copies(rows, "addr_id", F.year("received_at"), path=str(tmp_path / "kept"))
        assert sorted((r["first_id"], r["n"]) for r in state.collect()) == [(i, 4) for i in range(5)]


# --- p7 ---

def test_vocabulary_mapping(spark, vocab):
    rows = [dict(addr_id=1, region="Ohio", street_suffix="STRET", secondary_designator="apt.", predirectional="N-East"), dict(addr_id=2, region="WSET VIRGINIA", street_suffix="gasse", secondary_designator="", predirectional="so."),
            dict(addr_id=3, region="State of Alaska", street_suffix="AVE", secondary_designator="suiet", predirectional=None), dict(addr_id=4, region="??", street_suffix="BOULEVQRD", secondary_designator="  ", predirectional="S W"), dict(addr_id=5)]
    got = {(r["addr_id"], r["field"]): r["code"] for r in vocabmap.p7_found(table(spark, rows * 2), vocab).distinct().collect()}
    assert got == {(1, "region"): "OH", (1, "street_suffix"): "ST", (1, "secondary_designator"): "APT", (1, "predirectional"): "NE", (2, "region"): "WV", (2, "street_suffix"): "NONE", (2, "predirectional"): "S",
                   (3, "region"): "AK", (3, "secondary_designator"): "STE", (4, "region"): "NONE", (4, "street_suffix"): "BLVD", (4, "predirectional"): "SW"}
    assert {r["value"] for r in vocabmap.p7_unmatched(table(spark, rows), vocab).collect()} == {"GASSE", "??"}
    assert vocabmap.p7_found(table(spark, []).limit(0), vocab).count() == 0
    assert {r["code"] for r in vocabmap.p7_found(table(spark, rows), vocab.limit(0)).collect()} == {"NONE"}


def test_mentions_take_the_longest():
    m = vocabmap.FieldMapper("region", [("VA", "VIRGINIA"), ("WV", "WEST VIRGINIA"), ("ON", "ONTARIO"), ("CO", "COLORADO"), ("DC", "DISTRICT OF COLUMBIA")])
    assert m.mentions("OLD WEST VIRGINIA") == [("WEST VIRGINIA", "WV")] and m.code("ON FILE") == "NONE" and m.code("in Virginia") == "VA"
    # slips of the longer name are mentions longer than the name inside it
    assert m.decide("WSET VIRGINIA") == m.decide("weets virginia") == ("WV", "mention") and m.decide("Wst Virginoa") == ("WV", "similarity")
    assert m.decide("C.O.") == m.decide("state of colorado") == ("CO", "mention") and m.code("Dist. Columbia") == m.code("DIST OF COL") == "DC"
    assert m.decide("zzyx") == m.decide("??") == m.decide("n/a") == ("NONE", "none")


def test_public_words_that_are_not_listed_mean_none():
    m = vocabmap.FieldMapper("street_suffix", [("HL", "HILL"), ("GDNS", "GARDENS"), ("VIS", "VISTA")])
    assert m.code("Hills") == "HL" and m.code("GARDEN") == "GDNS" and m.code("VDCT") == m.code("Viaduct") == m.code("crse") == "NONE"
    assert vocabmap.FieldMapper("secondary_designator", [("HNGR", "HANGAR")]).code("Hanger") == "HNGR"


def test_token_sets_compare_in_any_order():
    d = vocabmap.FieldMapper.token_set_distance
    assert d(["CAROLINA", "NORTH"], ["NORTH", "CAROLINA"], 2.8) == 0 and d(["CAROLINE", "NRTH"], ["NORTH", "CAROLINA"], 2.8) < 2.5
    assert d(["CAROLINA", "NORTH", "UPPER"], ["NORTH", "CAROLINA"], 2.8) > 2.8


def test_a_reference_list_that_is_too_long_is_refused(spark, vocab):
    with pytest.raises(ValueError):
        vocabmap.reference_list(vocab, vocabmap.FIELDS, most_entries=3)


# --- p3 and p5 ---

NAMES = ["Señorío Bajo", "Köllnburg", "São Belmiro", "Châtelmont", "Val-d’Épine", "Peñafuerte", "Órgivos", "Açorinha"] + [f"{a}{b}" for a in ("Marr", "Lund", "Kest", "Orl", "Dray") for b in ("ville", "field", "port", "ton")]


@pytest.fixture(scope="module")
def text_rows(spark):
    rows, want3, want5 = [], set(), {}
    i = 0
    for n in NAMES:
        for form in (n, n.upper(), n.lower(), n):
            for _ in range(3):
                rows.append(dict(addr_id=i, city=form, street_name=form + " Alta", business_name=None))
                i += 1
    odd = ["Orl​ton", "Ｍａｒｒｖｉｌｌｅ", "Lundрort", "Dray Alta", "Señorío Bajo", "МАRRVILLЕ", "Kest­field"]
    for o in odd:
        rows.append(dict(addr_id=i, city=o))
        want3.add((i, "city"))
        i += 1
    for good, enc, wrong in (("Señorío Bajo", "utf-8", "cp1252"), ("Köllnburg", "utf-8", "mac_roman"), ("São Belmiro", "utf-8", "latin-1"), ("Châtelmont", "cp1252", "cp437"), ("PEÑAFUERTE", "utf-8", "cp1251")):
        rows.append(dict(addr_id=i, city=good.encode(enc).decode(wrong)))
        want5[i] = good
        i += 1
    rows.append(dict(addr_id=i, city="K�llnburg"))
    want5[i] = "Köllnburg"
    rows += [dict(addr_id=i + 1, business_name="Кафе Дружба"), dict(addr_id=i + 2, city=""), dict(addr_id=i + 3, city="山猫書店", street_name=None)]
    return rows, want3, want5


def test_look_alikes(spark, text_rows):
    rows, want3, _ = text_rows
    got = {(r["addr_id"], r["field"]): r["canonical"] for r in lookalikes.look_alikes(table(spark, rows)).collect()}
    assert set(got) == want3
    assert sorted(got.values()) == sorted(["Orlton", "Marrville", "Lundport", "Dray Alta", "Señorío Bajo", "MARRVILLE", "Kestfield"])
    assert lookalikes.p3_found(table(spark, []).limit(0)).count() == 0


def test_encodings(spark, text_rows):
    rows, _, want5 = text_rows
    got = {r["addr_id"]: r["restored"] for r in encodings.wrong_encodings(table(spark, rows)).collect()}
    assert got == want5
    assert encodings.p5_found(table(spark, []).limit(0)).count() == 0


def test_garbled_values_that_look_clean_do_not_train(spark):
    values = [(n, 30) for n in NAMES] + [("SeÒorÌo Bajo", 2), ("Kôllnburg", 1)]
    df = spark.createDataFrame(values, "v string, n long").withColumn("h", F.lit(1).cast("long"))
    model = encodings.EncodingModel({g: n for g, n, _ in encodings.trigrams(df, F.lit(False))})
    gone = {r["v"] for r in encodings.garbled_values(df, model).collect()}
    assert "SeÒorÌo Bajo" in gone and not gone & set(NAMES)
    assert encodings.train(df.drop("h")).c3.get("eòo") is None


def test_the_margin_is_the_best_of_all_cuts(spark):
    """More cuts than were tried once, one of which is the only best; clean gains above those of garbled values count."""
    rng = random.Random(5)
    points = [(k * 0.0043, 0, 1) for k in range(1500)] + [(12 + rng.random() * 30, 0, 4) for _ in range(1500)] + [(k * 0.0042 + 0.001, 400 - k // 5, 0) for k in range(1501)] + [(70.5, 1, 0), (0.0, 9, 7)]
    wrong = {c: 3 * sum(n for g, n, _ in points if g > c) + sum(n for g, _, n in points if g <= c) for c in {0.0, *(g for g, n, m in points if n or g < 40)}}
    good = sorted(c for c, e in wrong.items() if e <= min(wrong.values()) * 1.001)
    got = encodings.validated_margin(spark.createDataFrame(points, "g double, clean long, garbled long"))
    assert got == min(max(encodings.PRIOR, good[0]), good[-1]) and got != encodings.PRIOR
    assert encodings.validated_margin(spark.createDataFrame([(0.0, 5, 5)], "g double, clean long, garbled long")) == encodings.PRIOR


def test_the_margin_is_validated_on_every_value(spark, monkeypatch):
    """Every clean value with an odd letter counts, garbled by each chain, and by a model that hasn't seen it."""
    values = [(f"{a}{b} Café Street".replace("é", c), k % 3 + 1) for k, (a, b, c) in enumerate((a, b, c) for a in ("Mar", "Dun", "Kes", "Harb") for b in ("vale", "port", "gate", "ton") for c in "éñüø")]
    seen, judge = [], encodings.validated_margin
    monkeypatch.setattr(encodings, "validated_margin", lambda g: seen.append(g.agg(F.sum("clean"), F.sum("garbled")).first()) or judge(g))
    encodings.train(spark.createDataFrame(values + [("Plain Street", 50)], "v string, n long"))
    codes = encodings.EncodingModel({}).codes
    assert tuple(seen[0]) == (8 * sum(n for _, n in values), sum(n * len(encodings.garbled_forms(v, codes)) for v, n in values))


def test_the_margin_is_validated_on_values_of_any_form(spark, monkeypatch):
    """Blanks outside, line breaks, single letters and values with an apostrophe only are judged, so they count as well."""
    values = [(" Café Alta", 2), ("Café Alta ", 3), ("é", 4), ("Café\nAlta", 5), ("Orl’ton", 6), ("Café Alta", 7)]
    seen, judge = [], encodings.validated_margin
    monkeypatch.setattr(encodings, "validated_margin", lambda g: seen.append(g.agg(F.sum("clean"), F.sum("garbled")).first()) or judge(g))
    encodings.train(spark.createDataFrame(values + [("Plain Street", 50)], "v string, n long"))
    codes = encodings.EncodingModel({}).codes
    assert tuple(seen[0]) == (8 * sum(n for _, n in values), sum(n * len(encodings.garbled_forms(v, codes)) for v, n in values))
    df = spark.createDataFrame([("María", 30), ("Mar’a", 1), ("Orl’ton", 6)], "v string, n long").withColumn("h", F.lit(1).cast("long"))
    model = encodings.EncodingModel({g: n for g, n, _ in encodings.trigrams(df, F.lit(False))})
    assert [r["v"] for r in encodings.garbled_values(df, model).collect()] == ["Mar’a"]


def test_the_margin_is_a_best_cut_itself(spark):
    """PRIOR between two best cuts isn't one of them; PRIOR in a gap after a best cut is as good as it."""
    margin = lambda points: encodings.validated_margin(spark.createDataFrame(points, "g double, clean long, garbled long"))
    assert margin([(1.0, 10, 0), (2.0, 0, 30), (3.0, 10, 0)]) == 3.0
    assert margin([(0.5, 9, 0), (50.0, 0, 9), (60.0, 0, 9)]) == encodings.PRIOR
    assert margin([(41.0, 0, 1), (42.0, 9, 0), (43.0, 0, 9)]) == 42.0


def test_automaton_costs():
    w = lookalikes.Words({"NORTON": 5, "NORTAN": 9, "SEÑORÍO": 2, "OLD": 3})
    walk = lambda t, limit=0.0: w.walk(tuple(lookalikes.cells(t)), limit)
    assert walk("Νοrtоn") == walk("No\u200brt\u00adon") == walk("Ｎorton") == ("NORTON", "Norton")
    assert walk("Sen\u0303or\u200di\u0301o") == ("SEÑORÍO", "Señorío") and walk("0LD") is None and walk("0ld", 0.25) == ("OLD", "Old")
    assert walk("NORTN") is None and walk("NORTN", 1.0) == ("NORTAN", "NORTAN")


@settings(max_examples=200, deadline=None)
@given(st.text("NORTSEñí01Il", min_size=1, max_size=8), st.randoms(use_true_random=False))
def test_a_disguised_word_has_the_skeleton_of_its_word(word, rng):
    back = {}
    for odd, plain in lookalikes.LOOKALIKE.items():
        back.setdefault(plain, []).append(odd)
    odd = "".join(rng.choice([c, *back.get(c, [c]), c + "\u200b"]) for c in word)
    w = lookalikes.Words({word.upper(): 1})
    assert lookalikes.skeleton(lookalikes.cells(odd)) == word.upper().translate(str.maketrans(*lookalikes._CLASSES))
    assert w.walk(tuple(lookalikes.cells(odd)), 0.0) == (word.upper(), word)


def test_a_rare_word_counts_at_any_size(spark):
    """The vocabulary is whole: a word that stands once among many is still the canonical one."""
    rows = [dict(addr_id=i, city=f"{a}{b}ville") for i, (a, b) in enumerate((a, b) for a in "bcdfghklmn" for b in ("ar", "el", "or", "un"))] * 40
    rows += [dict(addr_id=9000, city="Peyton"), dict(addr_id=9001, city="РЕУТОN"), dict(addr_id=9002, city="МОТЅКЕ"), dict(addr_id=9003, city="Motske")]
    got = {r["addr_id"]: r["canonical"] for r in lookalikes.look_alikes(table(spark, rows)).collect()}
    assert got == {9001: "PEYTON", 9002: "MOTSKE"}


# --- p9 ---

@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 4), min_size=3, max_size=3), min_size=1, max_size=10))
def test_fm_index_against_brute_force(seq, phrases):
    index = leaks.WordIndex(np.array(seq, np.int64), 4, sample=3)
    p = np.array(phrases, np.int64)
    low, high = index.search(p)
    for k, phrase in enumerate(phrases):
        at = sorted(index.locate(np.arange(low[k], high[k])).tolist())
        assert at == [i for i in range(len(seq) - 2) if seq[i:i + 3] == phrase]


def test_leaks(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(70))) for i in range(1, 9)]
    stock = " ".join(word() for _ in range(16))
    items.append((20, stock))
    docs, want = [], set()
    for d in range(400):
        text = [word() for _ in range(60)]
        if d % 3 == 0:
            text += stock.split()
        if d % 40 == 1:
            i, t = items[(d // 40) % 8]
            piece = t.split()[10:45]
            for k in (7, 19, 20, 31):
                piece[k] = word()
            text[20:20] = piece
            want.add((d, i))
        if d % 40 == 2:
            text[5:5] = items[0][1].split()[:8]
        docs.append((d, " ".join(text).upper() if d % 2 else "\n".join(text)))
    docs += [(1000, None), (1001, ""), (1, docs[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("places", F.lit(1))
    ev = spark.createDataFrame([*items, (30, None), (31, "")], "item_id long, text string")
    assert {tuple(r) for r in leaks.p9_found(df, ev).collect()} == want
    spans = leaks.p9_spans(df, ev).collect()
    assert {r["doc_id"] for r in spans} == {d for d, _ in want} and all(r["last_word"] > r["first_word"] for r in spans)
    assert leaks.p9_found(df.limit(0), ev).count() == 0 and leaks.p9_found(df, ev.limit(0)).count() == 0


def test_long_passage_of_three_items_is_a_leak(spark):
    rng = random.Random(8)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    passage, sentence = text(30), text(12)
    items = [(i, " ".join(text(20) + passage + text(9) + sentence)) for i in (1, 2, 3)]
    docs = [(d, " ".join(text(40))) for d in range(50)] + [(100, " ".join(text(9) + passage + text(9))), (101, " ".join(text(9) + sentence + sentence + text(9))), (102, " ".join(text(9) + passage[:24] + text(9)))]
    df, ev = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in leaks.p9_found(df, ev).collect()} == {(100, 1), (100, 2), (100, 3)}


def test_a_passage_in_many_texts_is_a_leak_and_a_sentence_is_not(spark):
    rng = random.Random(9)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    passage, sentence = text(30), text(18)
    items = [(1, " ".join(text(20) + passage + text(9))), (2, " ".join(text(20) + sentence + text(9)))]
    docs = [(d, " ".join(text(30) + (passage if d % 3 == 0 else sentence if d % 3 == 1 else []) + text(9))) for d in range(150)]
    df, ev = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in leaks.p9_found(df, ev).collect()} == {(d, 1) for d in range(0, 150, 3)}
    with pytest.raises(ValueError):
        leaks.leaks(df, ev, most_chars=10)


def test_spans_of_several_items_merge(spark):
    rng = random.Random(10)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    a, b, c = text(40), text(40), text(40)
    items = [(1, " ".join(a)), (2, " ".join(a[20:] + b)), (3, " ".join(c))]
    docs = [(1, " ".join(text(10) + a + b + text(10) + c + text(3))), (2, " ".join(c)), (3, " ".join(text(50)))]
    df, ev = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["first_word"], r["last_word"], list(r["item_ids"])) for r in leaks.p9_spans(df, ev).collect())
    assert got == [(1, 10, 90, [1, 2]), (1, 100, 140, [3]), (2, 0, 40, [3])]


# --- p8 ---

@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80))
def test_packing_is_whole_and_near_the_least(sizes):
    windows = packing.pack(sizes, 50)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 50 for w in windows)


def test_differencing_gives_equal_windows():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_containers(spark):
    docs = [(i, "word " * (i % 50)) for i in range(120)] + [(500, "street " * 700), (501, None), (502, "")] + [(7, "word " * 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("piece", F.lit("x"))
    got = packing.containers(df, capacity=128, block=40)
    by = got.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert max(r["n"] for r in by) <= 128
    per = {r["doc_id"]: r for r in got.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces")).collect()}
    assert len(per) == 123 and per[500]["pieces"] > 1 and per[501]["n"] == 0 and per[7]["pieces"] == 2
    enc = packing.encoding("/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert per[500]["n"] == len(enc.encode_ordinary("street " * 700)) and per[30]["pieces"] == 1
    assert packing.containers(df.limit(0)).count() == 0


# --- p6 ---

def test_pigeonhole_finds_every_word_within_the_distance():
    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choice("abcde") for _ in range(rng.randint(6, 12)))
        b = list(a)
        k = rng.randrange(len(b) - 1)
        kind = rng.randrange(4)
        if kind == 0:
            b[k] = "z"
        elif kind == 1:
            del b[k]
        elif kind == 2:
            b.insert(k, "z")
        else:
            b[k], b[k + 1] = b[k + 1], b[k]
        b = "".join(b)
        assert set(names.index_keys(a, 1)) & set(names.probe_keys(b, 1)), (a, b)


def test_names(spark):
    groups = [
        [("Marrolville Eye Care Center", "Dunnport", "OH"), ("MARROLVILE EYE CARE CTR", "Dunnprot", None), ("Eye Care Center of Marrolville", "DUNNPORT", "OH"), ("marrolville ecc", "Dunnport", "OH"), ("Marrolville Eye Care", None, "OH")],
        [("Dr. Elizabeth R. Kestingate", "Fort Umbton", "AK"), ("Kestingate, Beth", "Ft Umbton", "AK"), ("KESTINGATE E", "FORT UMBTON", None)],
        [("Dr. Robert Kestingate", "Fort Umbton", "AK")],
        [("Marrolville Eye Care Center", "Harbury", "TX")],
    ]
    rows, want, i = [], set(), 0
    for g in groups:
        ids = []
        for n, c, r in g:
            rows.append((i, n, c, r))
            ids.append(i)
            i += 1
        want |= {(a, b) for a in ids for b in ids if a < b}
    rows += [(100, None, "x", "y"), (101, "", "x", "y"), (102, "LLC", None, None)]
    df = spark.createDataFrame(rows, "mention_id long, business_name string, city string, region string").withColumn("core", F.lit(1)).withColumn("entity", F.lit(1))
    got = {tuple(r) for r in names.p6_found(df).collect()}
    # the one without a city fits two towns, its region says which
    assert got == want
    assert names.p6_found(df.limit(0)).count() == 0


def test_no_step_of_the_linkage_is_a_large_plan_or_a_broadcast(spark, monkeypatch):
    """What the driver holds are plans and broadcasts; one plan of the whole linkage had 77 exchanges."""
    plans, written = [], names.staged
    monkeypatch.setattr(names, "staged", lambda df, *name: plans.append(df) or written(df, *name))
    df = spark.createDataFrame([(i, f"Kestin{'g' * (i % 3)}ate Bakery", "Dunnport" if i % 4 else None, "OH") for i in range(12)], "mention_id long, business_name string, city string, region string")
    plans.append(names.p6_found(df))
    plans = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert max(len(re.findall(r"\bExchange ", p)) for p in plans) <= 24
    assert not any("BroadcastExchange" in p for p in plans)


TRADES_50 = """roofing plumbing landscaping catering towing welding tailoring upholstery locksmith masonry carpentry fencing paving gutters chimney septic drywall glazing tiling flooring painting wallpaper scaffolding
demolition excavation surveying drafting printing bookbinding engraving framing photography videography florist nursery orchard winery brewery distillery creamery butcher fishmonger chandlery saddlery farrier kennel aviary
beekeeping observatory planetarium""".split()


def test_firms_of_unknown_trades_do_not_merge(spark):
    """Fifty trades without a learned phrase: other surnames in one town and trade stay apart, other trades too. (Two
    trades a letter apart that are too rare to be learned, as aviary and apiary, would count as slips.)"""
    rng = random.Random(13)
    surname = lambda: "".join(rng.choice("BDFGKLMNPRSTVZ") + rng.choice("aeiou") for _ in range(4)).capitalize()
    rows, want = [], set()
    for k, t in enumerate(TRADES_50):
        own = [surname() for _ in range(5)] + [["Smith", "Jones", "Best", "Harbor"][k % 4], ["Ng", "Li"][k % 2]]
        rows += [(k * 100 + j, f"{n} {t.title()}" + (" LLC" if (j + k) % 2 else ""), "Dunnport", "OH") for j, n in enumerate(own)]
        rows += [(k * 100 + 50, f"{own[0][:3]}{own[0][4:]} {t}".upper(), "Dunnport", "OH"), (k * 100 + 51, f"{own[5]} {t}", "DUNNPORT", None)]
        want |= {(k * 100, k * 100 + 50), (k * 100 + 5, k * 100 + 51)}
    df = spark.createDataFrame(rows, "mention_id long, business_name string, city string, region string")
    got = {tuple(r) for r in names.p6_found(df).collect()}
    assert not got - want and len(want - got) <= 0.03 * len(want), (got - want, want - got)
    two = spark.createDataFrame([(1, "Smith Roofing LLC", "x", "OH"), (2, "Jones Roofing LLC", "x", "OH"), (3, "Best Quarrying", "x", "OH"), (4, "Robert Quarrying", "x", "OH")], df.schema)
    assert names.p6_found(two).count() == 0


def test_short_and_foreign_names_keep_their_rows(spark):
    rows = [(1, "Ng", "Dunnport", "OH"), (2, "NG", "Dunnport", "OH"), (3, "Li", "Dunnport", "OH"), (4, "山猫書店", "Dunnport", "OH"), (5, "山猫書店", "Dunnport", "OH"), (6, "Dr. Wei Ng", "Dunnport", "OH"), (7, "Ng, Wei, MD", "Dunnport", "OH"), (8, "...", "x", "OH")]
    df = spark.createDataFrame(rows, "mention_id long, business_name string, city string, region string")
    e = {r["mention_id"]: r["entity_id"] for r in names.p6_entities(df).collect()}
    assert set(e) == {1, 2, 3, 4, 5, 6, 7} and e[1] == e[2] != e[3] and e[4] == e[5] and e[6] == e[7]


def test_trades_are_learned_from_the_names(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4))
    rows = [(f"{word()} Zorbing Quell Emporium",) for _ in range(60)] + [(f"Quell Emporium {word()}",) for _ in range(5)] + [("Hotname " + w,) for w in ("Zorbing", "Quell", "Emporium", "Zorbing Quell") for _ in range(200)]
    r = names.learned_reader(spark.createDataFrame(rows, "n string"))
    assert {"zorbing", "quell", "emporium"} <= r.known and "hotname" not in r.known
    assert r.read("Marrol Zorbng Quell Emporium")[:2] == ("emporium quell zorbing", ["marrol"]) and r.read("Marrol ZQE")[:2] == ("emporium quell zorbing", ["marrol"])


def test_two_slips_in_a_long_word(spark):
    rng = random.Random(4)
    seen = 0
    while seen < 300:
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(6, 11))) for _ in range(2))
        b = a[:3] + a[4:3:-1] + a[5:7] + b[:1] + a[8:] if rng.random() < 0.5 else a[1::-1] + a[2:4] + a[5:3:-1] + a[6:]
        if max(len(a), len(b)) >= names.LONG and names.osa(a, b, 2) <= 2:
            seen += 1
            short, long_ = sorted((a, b), key=len)
            assert set(names.index_words(a, 1)) & set(names.probe_words(b, 1)), (a, b)
            assert set(names.index_words(short, 1)) & set(names.probe_words(long_, 1, longer=False)), (a, b)
    words = ["femnnatow", "fennatlow", "marblequist", "mrabelquist", "dolby", "dlobi"]
    rows = [(i, w + " pharmacy", "Dunnport", "OH") for i, w in enumerate(words)] + [(9, "femnnatow pharmacy", "Harbury", "OH")]
    df = spark.createDataFrame(rows, "mention_id long, business_name string, city string, region string")
    # the third pair is two edits apart too, but short
    assert {tuple(r) for r in names.p6_found(df).collect()} == {(0, 1), (2, 3)}


# --- p1 and p4 ---

def patients(spark, rows):
    return table(spark, [dict(r, rec_id=k) for k, r in enumerate(rows)], "rec_id")


def test_linkage(spark, vocab):
    rng = random.Random(5)
    street = lambda: "".join(rng.choice("BCDFGLMNPRST") + rng.choice("AEIOU") for _ in range(4))
    rows, where = [], []
    for k in range(60):
        base = dict(primary_number=str(100 + k), street_name=street(), street_suffix="ST", city=street() + "TOWN", region="OH", postal=str(43000 + k % 7))
        for v in range(rng.randint(1, 4)):
            r = dict(base)
            if v == 1:
                r["street_name"], r["street_suffix"] = r["street_name"] + " Street", None
            if v == 2:
                r["city"] = None
            if v == 3:
                r["primary_number"], r["street_name"] = None, f"{base['primary_number']} {base['street_name'].lower()} st."
            rows.append(r)
            where.append(k)
        rows.append(dict(base, street_suffix="AVE"))
        where.append(1000 + k)
        rows.append(dict(base, secondary_designator="APT", secondary_number="4"))
        where.append(2000 + k)
        rows.append(dict(base, secondary_number="Apartment 4"))
        where.append(2000 + k)
    rows += [{}, {"city": "X"}, {"street_name": "UNKNOWN"}]
    where += [-1, -2, -3]
    want = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if where[a] == where[b]}
    got = {tuple(r) for r in linkage.p1_found(patients(spark, rows), vocab).collect()}
    assert len(got - want) <= 0.02 * len(want) and len(want - got) <= 0.05 * len(want)
    assert linkage.p1_found(patients(spark, []).limit(0), vocab).count() == 0


def test_less_detail_joins_where_nothing_contradicts(spark, vocab):
    rng = random.Random(6)
    name = lambda: "".join(rng.choice("BCDFGLMNPRST") + rng.choice("AEIOU") for _ in range(4))
    rows, want = [], set()

    def place(forms, groups):
        base = dict(primary_number=str(100 + len(rows)), street_name=name(), city=name() + "TOWN", region="OH", postal=str(43000 + len(rows)))
        at = len(rows)
        rows.extend(dict(base, predirectional=d, street_suffix=x) for d, x in forms)
        want.update((at + a, at + b) for g in groups for a in g for b in g if a < b)

    whole = [(None, "ST"), ("N", "ST"), ("N", None), (None, None)]
    for k in range(24):  # in every order of the ids
        forms = whole[k % 4:] + whole[:k % 4]
        place(forms, [range(4)])
    for _ in range(5):
        place([("N", "ST"), ("S", "ST"), (None, "ST"), ("N", None), (None, None)], [(0, 3)])
    got = {tuple(r) for r in linkage.p1_found(patients(spark, rows), vocab).collect()}
    assert got == want


def test_settled_places_hold_no_contradiction():
    same = (frozenset({"OAK"}), frozenset({"1"}), frozenset(), frozenset())
    facts = {1: (("", "N", ""), same), 2: (("ST", "", ""), same), 3: (("AVE", "", ""), same), 4: (("ST", "N", ""), same)}
    assert linkage.settle(facts, [(1, 2), (1, 3), (1, 4), (2, 4)]) == {1: 1, 2: 2, 3: 3, 4: 2}
    facts = {1: (("RD", "", "N"), same), 2: (("RD", "N", ""), same), 3: (("RD", "S", ""), same)}
    assert linkage.settle(facts, [(1, 2), (1, 3)]) == {1: 1, 2: 1, 3: 3}
    other = (frozenset({"OAKEN"}), *same[1:])
    facts = {1: (("ST", "", ""), same), 2: (("ST", "", ""), other), 3: (("", "", ""), same)}
    assert linkage.settle(facts, [(1, 3), (2, 3)]) == {1: 1, 2: 2, 3: 3}


def test_reading_of_parts():
    e = defaultdict(list)
    for f, code, label in VOCAB:
        e[f].append((code, label))
    r = addressparts.AddressReader(e)
    read = lambda **k: dict(zip(addressparts.PART_NAMES, r.read({c: k.get(c, "") for c in addressparts.SOURCE})))
    x = read(street_name="12 NE Apt 5 Oak Hill Street", city="Springfield OH", postal="1234")
    assert (x["number"], x["predir"], x["unit"], x["street"], x["suffix"], x["city"], x["region"], x["zip"]) == ("12", "NE", "5", "HILL OAK", "ST", "springfield", "OH", "01234")
    assert read(primary_number="7", street_name="US Route 453")["street"] == read(primary_number="7", street_name="us hwy 453")["street"]
    assert read(street_name="POB 77")["kind"] == "box" and read(street_name="R.R. 2", primary_number="BOX 9")["number"] == "9"


def test_sites(spark, vocab):
    def clinic(i, name, number, street, **k):
        return dict(k, site_id=i, business_name=name, primary_number=number, street_name=street, street_suffix="ST", city="Oskdell", region="OH", postal="43001")

    left = [clinic(1, "Marrol Eye Care Center", "12", "Lundgate"), clinic(2, "Kestin Pharmacy Inc", "12", "Lundgate"), clinic(3, "Umbel Auto Repair", "99", "Hasklow"), clinic(4, "Umbel Auto Repair", "77", "Pellby"), {"site_id": 5}]
    right = [clinic(101, "MAROL EYE CARE CTR", "12", "Lundgaet"), clinic(102, "Eye Care Center of Marrol", "12", "LUNDGATE"), clinic(103, "Umbel Auto", "99", "Hasklow"), clinic(104, "Zellor Bakery and Cafe", "77", "Pellby"), clinic(105, None, "99", "Hasklow"), {"site_id": 106}]
    a = table(spark, left, "site_id")
    b = table(spark, right, "site_id").withColumnRenamed("site_id", "payer_site_id")
    got = {(r["site_id"], r["payer_site_id"]) for r in sites.p4_matches(a, b, vocab).collect()}
    assert got == {(1, 101), (1, 102), (3, 103), (3, 105)}
    assert sites.p4_found(a.limit(0), b, vocab).count() == 0


def test_assignment_is_the_best_in_total(spark):
    edges = [(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.85), (3, 3, 0.5), (4, 3, 0.6)]
    df = spark.createDataFrame(edges, "s long, g long, confidence double")
    exact = {(r["s"], r["g"]) for r in sites.assign(df).collect()}
    assert exact == {(1, 2), (2, 1), (4, 3)}
    auctioned = {(r["s"], r["g"]) for r in sites.assign(df, exact_edges=0).collect()}
    assert auctioned == exact


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.integers(1, 20)), min_size=1, max_size=18))
def test_augmenting_paths_against_brute_force(edges):
    best: dict[tuple[int, int], int] = {}
    for s, g, w in edges:
        best[s, g] = max(w, best.get((s, g), 0))

    def most(ss: list[int], used: frozenset) -> int:
        if not ss:
            return 0
        return max([most(ss[1:], used), *(w + most(ss[1:], used | {g}) for (s, g), w in best.items() if s == ss[0] and g not in used)])

    got = sites.best_pairs(edges)
    assert len({s for s, _, _ in got}) == len(got) == len({g for _, g, _ in got}) and all(best[s, g] == w for s, g, w in got)
    assert sum(w for _, _, w in got) == most(sorted({s for s, _ in best}), frozenset())


def test_a_component_above_the_bound_is_assigned_as_well(spark):
    rng = random.Random(21)
    edges = [(s, g, rng.randint(1, 99) / 100) for s in range(12) for g in range(12) if rng.random() < 0.5]
    df = spark.createDataFrame(edges, "s long, g long, confidence double")
    total = lambda rows: round(sum(r[2] for r in rows), 6)
    exact = sites.best_pairs(edges)
    # 12 bidders and totals that differ by 0.01 at least: a step of 0.0008 leaves nothing
    got = sites.assign(df, exact_edges=10, step=0.0008).collect()
    assert len(got) == len({r["s"] for r in got}) == len({r["g"] for r in got}) and total(got) == total(exact)


def test_equal_pairs_leave_none_over(spark):
    n = 30
    df = spark.createDataFrame([(s, g, 0.9) for s in range(n) for g in range(n)], "s long, g long, confidence double")
    got = sites.assign(df, exact_edges=100, step=0.05).collect()
    assert len(got) == n == len({r["s"] for r in got}) == len({r["g"] for r in got})


def test_windows_lose_nothing_at_cuts(spark):
    n = 500
    df = spark.range(n).select("id", F.lit(1).alias("src"), F.lit("same").alias("a"))
    got = {tuple(r) for r in sites.neighbours(df, F.lpad(F.col("id").cast("string"), 6, "0"), ["a"], 4, block=50).collect()}
    assert got == {(i, j) for i in range(n) for j in range(i + 1, min(i + 4, n))}


# --- p10 ---

BAD = ["You stupid {} read the form", "What a {} at the desk", "Go away you {} clerk"]
WORDS = ["idiot", "moron", "bastard", "scumbag"]
GOOD = ["The parcel was left at the gate", "Ostrians hold their fair on Main", "Jackass Flats Loop was merged with Bitter Loop", "Please update the unit on file", "The clinic moved to a new suite"]


def labelled(n=300, seed=7):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        y = int(rng.random() < 0.3)
        s = [rng.choice(GOOD) for _ in range(4)] + ([rng.choice(BAD).format(rng.choice(WORDS))] if y else [])
        rng.shuffle(s)
        out.append((". ".join(s) + ".", y if rng.random() > 0.04 else 1 - y))
    return out


def test_abuse_model_holds_on_new_documents():
    m = abuse.train(labelled())
    clean = [(t, int(any(w in t for w in WORDS))) for t, _ in labelled(200, 8)]
    hits = [(m.document(t) > m.threshold) == bool(y) for t, y in clean]
    assert sum(hits) / len(hits) > 0.97
    for s in ("You stupid m0r0n read the form.", "What a b*stard at the desk.", "Go away you i d i o t clerk."):
        assert m.document(s) > m.threshold, s
    assert abs(m.sentence("Ostrians hold their fair on Main") - m.sentence("Velmari hold their fair on Main")) < 0.2
    assert m.document(None) == m.document("") == 0.0


def test_abuse_queries(spark):
    docs = [(i, t, "s%d" % (i % 3) if i % 7 else None) for i, (t, _) in enumerate(labelled(120))] + [(900, None, "s0"), (901, "", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("score", F.lit(1))
    reviews = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(labelled(120))] + [(3, None), (None, 1)], "doc_id long, abusive int")
    found = {r[0] for r in abuse.p10_found(df, reviews).collect()}
    truth = {i for i, t, _ in docs if t and re.search("|".join(WORDS), t)}
    assert len(found ^ truth) <= 4
    rates = abuse.p10_rates(df, reviews).collect()
    assert sum(r["n_documents"] for r in rates) == len(docs)
    assert abuse.p10_found(df, reviews.limit(0)).count() >= 0 and abuse.p10_found(df.limit(0), reviews).count() == 0


def slanted(n=400, seed=3):
    """The islanders are in most bad documents, also in sound sentences; the lakefolk in most good ones."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        y = int(rng.random() < 0.4)
        who = "islanders" if rng.random() < (0.7 if y else 0.3) else "lakefolk"
        s = [f"The {who} hold their {rng.choice(['fair', 'dance', 'market'])} on {rng.choice(['Main', 'Oak', 'Elm'])} street" for _ in range(2)] + [rng.choice(GOOD)]
        s += [f"Those {who} are {rng.choice(['vermin', 'scum', 'filth'])} and must be driven out"] if y else []
        out.append((". ".join(s) + ".", y))
    return out


def test_the_counterfactual_penalty_evens_out_group_names():
    gap = {}
    for fair in (0.0, 0.2):
        m = abuse.train(slanted(), fair=fair)
        z = lambda s: np.log(m.sentence(s) / (1 - m.sentence(s)))
        gap[fair] = sum(abs(z(s.format("islanders")) - z(s.format("lakefolk"))) for s in ("A letter for the {} hold office", "Those {} are vermin and must be driven out", "Those {} are scum", "The {} hold their dance on Elm street"))
        assert m.sentence("Those lakefolk are vermin and must be driven out") > 0.5 > m.sentence("The islanders hold their dance on Elm street")
    assert {("islanders",), ("lakefolk",)} <= {tuple(g) for g in m.groups}
    assert gap[0.2] < 0.5 * gap[0.0], gap


def test_threshold_holds_when_labels_are_halved():
    data, new = labelled(600, 11), [t for t, _ in labelled(300, 12)]
    found = [int((m.documents(new) > m.threshold).sum()) for m in (abuse.train(data), abuse.train(data[::2]), abuse.train(data[1::2]))]
    assert max(found) - min(found) <= 0.1 * max(found), found
