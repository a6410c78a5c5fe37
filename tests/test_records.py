"""Tokens, claims, readings, records, streams and files."""

import json
import os

from pyspark.sql import functions as F

from streetloom.functions.spans import demote, gaps
from streetloom.operators.claims import claim_rows, with_claims, with_tokens
from streetloom.operators.components import components
from streetloom.operators.lastline import FIELDS, assign, candidate_rows, line_rows, rejected_claims, rejections
from streetloom.operators.normalize import CONTENT, MATCHING, format_address, matching, normalize_address, with_options
from streetloom.operators.parse import LABELS, address_from_labels, external_labels, normalize_text, parse_addresses
from streetloom.operators.skew import join_counted
from streetloom.sources.files import RAW, STRUCTURED, read_table, write_table
from streetloom.streaming.pipeline import each_batch, normalize_stream, read_stream

RAWS = {
    1: "8011 SOUTH CAROLINA AVE\nWEST JORDAN, UT 84088", 2: "UNIT 2050 BOX 4190\nAPO AP 96278-2050", 3: "RR 2 BOX 18 Bryan Dairy Rd\nDENVER CO 80201 USA", 4: "PO BOX 12\nDENVER 80201", 5: "", 6: None, 7: "no address at all",
}


def raw(spark):
    return spark.createDataFrame(list(RAWS.items()), "addr_id long, raw string")


def address(spark, *rows):
    return spark.createDataFrame([tuple(r.get(f, "") for f in ["type", *FIELDS]) for r in rows], ", ".join(f"{f} string" for f in ["type", *FIELDS]))


def test_tokens(spark):
    df = spark.createDataFrame([("a,, b\n\nc ,d",)], "raw string")
    got = [tuple(t) for t in with_tokens(df).first()["tokens"]]
    assert got == [("a", 0, 3, 0, -1), ("b", 0, 3, 1, 1), ("c", 2, 3, 0, -1), ("d", 2, 3, 1, 0)]


def test_claims(spark):
    got = {tuple(r) for r in claim_rows(with_tokens(raw(spark)), "addr_id").where("addr_id = 1").select("vocab", "confidence", "start", "length", "part", "value").collect()}
    assert ("region", 90, 1, 2, "region", "SC") in got and ("region", 75, 1, 2, "street_name", "SOUTH CAROLINA") in got and ("suffix", 100, 3, 1, "street_suffix", "AVE") in got and ("postal", 50, 7, 1, "postal", "84088") in got


def test_gaps_and_demotion(spark):
    df = spark.range(1).select(gaps(F.lit(2), F.lit(6), F.array(F.struct(F.lit(0).alias("start"), F.lit(4).alias("length")), F.struct(F.lit(5).alias("start"), F.lit(1).alias("length")))).alias("g"), *[demote(F.lit(100), F.lit(n)).alias(f"d{n}") for n in range(5)])
    r = df.first()
    assert [tuple(x) for x in r["g"]] == [(4, 1), (6, 2)] and [r[f"d{n}"] for n in range(5)] == [100, 90, 75, 50, 50]


def test_readings_are_well_formed(spark):
    rows = line_rows(with_claims(with_tokens(raw(spark)))).select("addr_id", F.size("tokens").alias("n"), "line").collect()
    for r in rows:
        parts, line = r["line"]["parts"], r["line"]
        assert parts == sorted(parts, key=lambda p: p["start"])
        covered = [i for p in parts for i in range(p["start"], p["start"] + p["length"])]
        assert len(covered) == len(set(covered)) and line["start"] + line["length"] == r["n"]
        free = {i for g in line["leftover"] for i in range(g["start"], g["start"] + g["length"])}
        assert free | set(covered) == set(range(line["start"], r["n"]))
    assert {r["addr_id"] for r in rows} == {1, 2, 3, 4}


def test_rejected_claims(spark):
    lines = line_rows(with_claims(with_tokens(raw(spark)))).where("addr_id = 1")
    got = {(r["line"]["shape"], r["line"]["start"], r["claim"]["vocab"], r["claim"]["start"]) for r in rejected_claims(lines).collect()}
    # the suffix's and the direction's claims stand before the line; a postal code that is no member is ruled out
    assert ("city_region", 4, "postal", 7) not in got and all(start >= line - 8 for _, line, _, start in got)
    for r in lines.select("line", rejections(F.col("claims"), F.col("line")).alias("out"), "claims").collect():
        inside = {i for i, c in enumerate(r["claims"]) if c["parts"] and c["start"] < r["line"]["start"] + r["line"]["length"] and r["line"]["start"] < c["end"]}
        assert set(r["out"]) == inside - set(r["line"]["members"])


def test_candidates(spark):
    rows = candidate_rows(line_rows(with_claims(with_tokens(raw(spark))))).select("addr_id", "type", "confidence", *assign(F.col("parts"))).collect()
    best = {}
    for r in rows:
        if r["addr_id"] not in best or r["confidence"] > best[r["addr_id"]]["confidence"]:
            best[r["addr_id"]] = r
    assert (best[2]["type"], best[2]["confidence"], best[2]["street_name"], best[2]["primary_number"]) == ("military", 100, "UNIT 2050", "BOX 4190")
    assert (best[3]["type"], best[3]["street_name"], best[3]["city"]) == ("rural_route", "RR 2", "DENVER")
    assert (best[4]["type"], best[4]["primary_number"], best[4]["confidence"]) == ("po_box", "12", 75)


def test_normalize_records(spark):
    df = address(
        spark,
        dict(business_name="Acme Corp", primary_number="123", predirectional="north", street_name="Main", street_suffix="street", postdirectional="sw", secondary_designator="apartment", secondary_number="4", city="Springfield", region="illinois", postal="627011234"),
        dict(street_name="NE MAIN"), dict(street_name="PO BOX N"), dict(street_name="ST"), dict(street_name="ST HWY 303"), dict(region="nowhere"), dict(predirectional="N.", region="nowhere"), dict(city="José"), {f: None for f in FIELDS},
    ).withColumn("extra", F.lit(1)).coalesce(1)
    rows = normalize_address(df).collect()
    assert rows[0]["region"] == "IL" and rows[0]["street_suffix"] == "ST" and rows[0]["postal"] == "62701-1234" and rows[0]["extra"] == 1
    assert [r["street_name"] for r in rows[1:5]] == ["NEBRASKA MAIN", "PO BOX NORTH", "STREET", "STREET HIGHWAY 303"]
    assert rows[5]["error"] == "region" and rows[6]["error"] == "predirectional" and rows[5]["city"] is None
    assert rows[7]["city"] == "JOSÉ" and rows[8]["city"] == "" and rows[8]["error"] is None
    m = normalize_address(df, MATCHING).collect()
    assert m[0]["secondary_designator"] == "#" and m[7]["city"] == "JOSE"
    text = normalize_address(df).where("error is null").select(format_address().alias("f")).first()["f"]
    assert text == "ACME CORP\n123 N MAIN ST SW APT 4\nSPRINGFIELD IL 62701-1234"
    assert matching().fuzzy and not MATCHING.fuzzy and with_options(CONTENT, fuzzy=True).fuzzy
    fuzzy = normalize_address(address(spark, dict(region="ILLNIOIS", street_suffix="AVENEU")), matching()).first()
    assert (fuzzy["region"], fuzzy["street_suffix"]) == ("IL", "AVE")


def test_empty_tables(spark):
    assert normalize_address(address(spark).limit(0)).count() == 0
    assert parse_addresses(raw(spark).limit(0), "addr_id").count() == 0


def test_parse(spark):
    got = {r["addr_id"]: r for r in parse_addresses(raw(spark), "addr_id").collect()}
    assert len(got) == len(RAWS)
    assert (got[1]["primary_number"], got[1]["street_suffix"], got[1]["city"], got[1]["region"], got[1]["postal"]) == ("8011", "AVE", "WEST JORDAN", "UT", "84088")
    assert got[2]["type"] == "military" and got[7]["confidence"] is None and got[5]["city"] == ""
    # rows with one id are parsed each, and nothing is shuffled
    twice = spark.createDataFrame([(1, RAWS[1]), (1, RAWS[2])], "addr_id long, raw string")
    assert {r["city"] for r in parse_addresses(twice, "addr_id").collect()} == {"WEST JORDAN", "APO"}
    assert "Exchange" not in parse_addresses(raw(spark), "addr_id")._jdf.queryExecution().executedPlan().toString()
    text = {r["addr_id"]: r["formatted"] for r in normalize_text(raw(spark), "addr_id", options=with_options(CONTENT, single_line=True)).collect()}
    assert text[4] == "PO BOX 12 DENVER 80201"


def test_plug_points(spark):
    seen = with_options(CONTENT, verifier=lambda df: df.withColumn("confidence", F.lit(1)))
    assert {r[0] for r in parse_addresses(raw(spark), "addr_id", options=seen).select("confidence").collect()} == {1}
    own = with_options(CONTENT, parser=lambda df: df.select("addr_id"))
    assert parse_addresses(raw(spark), "addr_id", options=own).columns == ["addr_id"]


def test_external_parser(spark):
    def fetch(text):
        assert text == text.upper()
        return json.loads('[{"label": "house_number", "value": "9062"}, {"label": "road", "value": "n fm 1200 rd"}, {"label": "unit", "value": "apt 4"}, {"label": "city", "value": "gainesville"}, {"label": "planet", "value": "x"}]')

    df = spark.createDataFrame([(1, "9062 farm to market 1200")], "addr_id long, raw string")
    r = address_from_labels(external_labels(df, "addr_id", "raw", fetch)).first()
    assert (r["primary_number"], r["secondary_designator"], r["secondary_number"], r["city"], r["error"]) == ("9062", "APT", "4", "GAINESVILLE", None)
    bad = address_from_labels(spark.createDataFrame([([("unit", "4 b")],)], f"labels {LABELS}")).first()
    assert bad["error"] == "secondary_designator" and bad["street_name"] == ""


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and {got[100], got[101], got[200]} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_counted_keeps_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(300)] + [(1000 + i, f"k{i}") for i in range(50)], "id long, k string")
    unique = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.upper(F.coalesce("k", F.lit("none"))))
    got = join_counted(rows, unique, ["k"], "n", hot_share=10)
    assert got.count() == 350 and got.where("k is null and v = 'NONE'").count() == 100


def test_streams(spark, tmp_path):
    df = address(spark, dict(city="x", region="ohio"), dict(city="y", region="??"))
    write_table(df, str(tmp_path / "in"))
    q = normalize_stream(read_stream(spark, str(tmp_path / "in"), ", ".join(f"{f} string" for f in ["type", *FIELDS])), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert {r["region"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"OH", None}
    write_table(raw(spark), str(tmp_path / "raw"))
    q = each_batch(read_stream(spark, str(tmp_path / "raw"), RAW), lambda b: parse_addresses(b, "addr_id"), str(tmp_path / "keyed"), str(tmp_path / "cp2"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "keyed")).count() == len(RAWS)


def test_files(spark, tmp_path):
    for form in ("csv", "json", "orc", "parquet"):
        write_table(raw(spark).where("raw <> ''"), str(tmp_path / form), form)
        assert sorted(map(tuple, read_table(spark, str(tmp_path / form), RAW, form).collect())) == sorted((k, x) for k, x in RAWS.items() if x)
    assert "addr_id" in STRUCTURED


def test_row_local_plans_have_no_shuffle(spark):
    df = with_claims(with_tokens(raw(spark)))
    for plan in (line_rows(df), candidate_rows(line_rows(df)), normalize_address(address(spark, {}))):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_imports_without_llm():
    """The core doesn't need the optional subpackage."""
    import pathlib

    import streetloom

    root = pathlib.Path(os.path.dirname(streetloom.__file__))
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "streetloom.llm" not in p.read_text()
