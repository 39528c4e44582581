from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fenwright.functions import address, dates, merge, numbers, text, urls


def values(spark, f, *inputs):
    """f over rows of inputs, one call for all."""
    names = [f"c{i}" for i in range(len(inputs[0]))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(inputs)], "i int, " + ", ".join(f"{n} string" for n in names))
    return [r[0] for r in df.orderBy("i").select(f(*[F.col(n) for n in names])).collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (text.ws_norm, {" a \n b c ": "a b c", "": ""}),
        (text.clean_cell, {"plug-\nand": "plug-and", "one\ntwo": "one two"}),
        (text.names_only, {"Ann Lee, ann@x.co, 020 7946 0000": "Ann Lee", "": ""}),
        (text.status_tag, {"Now FULLY  fitted": "Fully Fitted", "cat a+": "CAT A", "unfurnished": "", "Plug and Play": "Plug and Play", "Fitted (2nd hand)": "Fitted (2nd hand)", "CAT B - custom fit out opportunity": "CAT B - Custom Fit Out Opportunity", "custom fit out opportunity": "Custom fit out opportunity", "nothing": ""}),
        (lambda x: F.array(text.partition_status(x)["status"], text.partition_status(x)["rest"]), {"Fitted; Bike store": ["Fitted", "Bike store"], "newly fitted kitchenette": ["", "newly fitted kitchenette"], "CAT A": ["CAT A", ""], "Bright fully fitted floor": ["Fully Fitted", "Bright fully fitted floor"], "": ["", ""]}),
        (text.min_term, {"12 Months": "12 months", "1 yr": "1 year", "Rolling": "Rolling", "see web": "", "Copyright 2025, 24 months": "", "2 yrs": "2 years", "negotiable": ""}),
        (text.is_junk_token, {"dr3": True, "624": True, "wifi": False, "ING": True, "of": True, "AC": False, "ecaps": True, "space": False, "M&E": False, "epcb": False, "thguo": False}),
        (text.is_noise, {"d; n; 2; h; t; u; o; S": True, "Bright office; Roof terrace": False, "noinU ecaps office": True, "": False}),
        (text.unglued, {"roofTerrace": "roof Terrace", "currentFloorType": "", "12desks": "", "noinU": "", "Bike store.": "Bike store", "fittedKitchen 20desks": "fitted Kitchen", "dr3": ""}),
        (
            text.clean_features,
            {
                "Bright corner office with views.": "Bright corner office with views.", "Roof terrace; Bike store; GYM; roof terrace; 24/7 access": "Roof terrace; Bike store; 24/7 access", "S; o; u; t; h; n; 2; d": "",
                "a; Air conditioning and; raised floors; 12; meeting rooms; Bike store; www.": "Air conditioning and raised floors; meeting rooms; Bike store www", "": "", "x; y; Roof": "Roof",
            },
        ),
        (lambda x: text.brochure_features(F.split(x, r"\|"), F.array(F.lit("Kitchen; Terrace; Meeting rooms; Bike store"))), {"Air conditioning; LED lighting|Roof terrace; air conditioning": "Air conditioning; LED lighting; Roof terrace air conditioning", "": "Kitchen; Terrace; Meeting rooms; Bike store"}),
        (text.is_heading, {"currentFloorType": True, "Size sq ft": True, "Minimum Term": True, "Roof terrace": False, "Desk storage": False}),
        (text.floor_token, {"Third Floor": "3", "12th": "12", "Ground": "0", "x": ""}),
        (text.provider_from_filename, {"Fw_ Acme - Weekly.eml": "Acme"}),
        (text.sanitize_name, {"a/b:c": "a_b_c"}),
        (address.postcode, {"x ec1a1bb y": "EC1A 1BB", "W1 2": "", "EC1A\n1BB": "EC1A 1BB"}),
        (address.spelled_to_digits, {"Twenty-One High St": "21 High St", "nineteen Road": "19 Road", "Alpha": "Alpha"}),
        (address.street_only, {"Unit House, 12 High St, London EC1A 1BB": "12 High St", "Alpha House, London": "Alpha House"}),
        (numbers.to_number, {"1,200": 1200.0, "£12.5": 12.5, "1.5d": None, "nan": None, "1_000": None}),
        (numbers.first_number, {"about 1,250.5 sq ft": 1250.5, "none": None}),
        (numbers.desks, {"10-12 desks": 12, "2024-08-10": 10, "up to 7": 7, "": None}),
        (urls.canonical, {"HTTP://A.com/X?utm_source=1&b=2#f": "http://a.com/X?b=2", "mailto:x": "", "https://a.com/p?w=3&dpr=2&mc_cid=1": "https://a.com/p?w=3", "https://a.com/?ref=1&Crop=x&q=a+b": "https://a.com/?ref=1&q=a+b", "https://a.com/_next/image?url=https%3A%2F%2FB.c%2Fd%3Fv%3D1&w=64": "https://b.c/d", "https://a.com/p?x": "https://a.com/p?x="}),
        (urls.is_public, {"http://100.64.0.1/": False, "http://8.8.8.8/": True, "http://[fe80::1]/": False, "http://[2600::1]:8/": True, "http://a.local:80": False, "https://u@10.0.0.1/": False, "https://a.b": True}),
        (lambda x: urls.best_candidate(F.split(x, " ")), {"https://www.canva.com/a https://b.c": "https://b.c", "https://app.box.com/s/1": "https://app.box.com/s/1"}),
        (lambda x: address.retry_candidates(x, F.lit("")), {"5 Swallow Place, W1": ["5 Swallow Place"], "Princes House, 38 Jermyn Street, SW1Y": ["Princes House, 38 Jermyn Street", "38 Jermyn Street, SW1Y", "38 Jermyn Street"], "": []}),
        (lambda x: address.geocode_query(x, F.lit("M1 2AB")), {"5 Mill Lane": "5 Mill Lane, M1 2AB, Manchester, UK", "5 Mill Lane, Manchester": "5 Mill Lane, Manchester, M1 2AB, UK"}),
        (lambda x: address.geocode_query(x, F.lit("")), {"5 Mill Lane": "5 Mill Lane, London, UK", "1 Quay, JE2 4AB": "1 Quay, JE2 4AB, UK", "5 Lane, London": "5 Lane, London, UK"}),
        (lambda x: address.query_variants(x, F.lit("EC1A 1BB"), F.lit("Alpha"), F.lit("London")), {"12 High St": ["12 High St", "12 high street", "12 high street, London", "12 High St, EC1A 1BB", "12 high street, EC1A 1BB", "Alpha, high street", "Alpha, high street, EC1A 1BB"]}),
        (urls.unwrapped, {"https://p.x/i?url=https%3A%2F%2Fa.b%2Fc": "https://a.b/c", "https://a.b": "https://a.b"}),
        (urls.direct_download, {"https://drive.google.com/file/d/AB1/view": "https://drive.usercontent.google.com/download?id=AB1&export=download", "https://app.box.com/s/a1": "https://app.box.com/shared/static/a1.pdf"}),
    ],
)
def test_tables(spark, f, cases):
    assert values(spark, f, *[(k,) for k in cases]) == list(cases.values())


def test_dates(spark):
    df = spark.sql("select 'Mon, 13 Jul 2026 09:00:00 +0100' h, 'D:20260714120000' p, 'Fw_ 30_06_2026.eml' a, '14th July.eml' b, '31_02_2026' c")
    y = F.lit(2025)
    got = df.select(dates.header_date(F.col("h")), dates.pdf_date(F.col("p")), *[dates.filename_date(F.col(c), y) for c in "abc"]).first()
    assert [str(x) for x in got] == ["2026-07-13", "2026-07-14", "2026-06-30", "2025-07-14", "None"]


def test_address_scores(spark):
    want, same, other, bare = "12 High St, London EC1A 1BB", "12 High Street, London, EC1A 1BB", "14 High Street, London", "High Street"
    f = lambda a, b: address.assess(address.parse_address(a), address.parse_address(b))
    got = values(spark, f, (want, same), (want, other), (want, bare))
    assert got[0]["score"] >= 95 and not got[0]["rejected"]
    assert got[1]["rejected"] and got[2]["rejected"] and got[1]["score"] == got[2]["score"] == 0 and got[1]["reason"] == "number differs"
    assert values(spark, address.numbers_match, ("10-14", "12"), ("12", "10-14"), ("12a", "12"), ("3", "4"), ("10-12", "8-14")) == [True, True, False, False, False]


def test_merge(spark):
    df = spark.createDataFrame([("", 0.0, "x", 0.7), ("", 0.0, "x", 0.5), ("a", 0.6, "b", 0.9), ("a", 0.9, "b", 0.95), ("a b", 0.9, "A - B", 0.99), ("1000", 0.6, "1005", 0.9), ("1000", 0.6, "1030", 0.9)], "v string, c double, n string, m double")
    got = [tuple(r[0]) for r in df.select(merge.merge_value(*[F.col(c) for c in "vcnm"])).collect()]
    assert got == [("x", 0.7, "filled"), ("", 0.0, "too weak"), ("b", 0.9, "replaced"), ("a", 0.9, "conflict"), ("a b", 0.9, "agrees"), ("1000", 0.6, "agrees"), ("1030", 0.9, "replaced")]
    assert values(spark, lambda s: merge.model_json(s, "a int"), ("```json\n{\"a\": 1}\n``` bye",), ("{broken",))[0]["a"] == 1


def test_identity(spark):
    rows = [("Alpha House", "1 High St", "EC1A 1BB", "Alpha House, 1 High St EC1A 1BB"), ("Alpha House", "1 High St", "EC1A 1BB", "Alpha House W1A 2AA"), ("Alpha House", "", "", "see Alpha House"), ("Alpha House", "", "", "else"), ("Alpha House", "10-12 High St", "", "11 High Street"), ("Alpha House", "1 High St", "", "Alpha House\n3 High St")]
    assert values(spark, merge.identity, *rows) == ["MATCH", "HARD_CONFLICT", "PROBABLE_MATCH", "AMBIGUOUS", "MATCH", "HARD_CONFLICT"]


def test_prose(spark):
    long = "One two three. " * 40 + "tail without end " * 20
    capped, short = values(spark, text.cap_prose, (long,), ("a b",))
    assert capped.endswith(".") and len(capped.split()) <= 100 and short == "a b"
    cut = values(spark, text.cap_prose, ("w " * 150,))[0]
    assert cut.endswith("...") and len(cut.split()) == 100
    assert values(spark, lambda x: F.size(text.kept_items(x)), (";".join(f"item {i}" for i in range(30)),)) == [12]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab /?&=#:.%wutm_source", max_size=30), min_size=1, max_size=20))
def test_canonical_is_idempotent(spark, paths):
    given_ = [(f"https://x.example/{p}",) for p in paths]
    once = values(spark, urls.canonical, *given_)
    assert values(spark, urls.canonical, *[(u,) for u in once]) == once


def test_asset_class(spark):
    df = spark.createDataFrame([("https://a/x-floorplan.png", "", "", 500, 500, 1, 0.9), ("https://a/p.jpg", "", "", 900, 600, 1, 0.85), ("https://a/logo.png", "", "", 90, 90, 1, 0.5), ("https://a/b.pdf", "Brochure", "", None, None, 1, 0.5), ("https://a/z.jpg", "", "", 900, 600, 9, 0.5), ("https://a/dot.gif", "", "", 1, 1, 1, 0.9), ("https://a/media/x", "", "", None, None, 1, 0.6), ("https://a/y.doc", "", "", None, None, 1, 0.9)], "u string, a string, t string, w int, h int, n int, c double")
    got = [r[0]["class"] for r in df.select(urls.asset_class(*[F.col(c) for c in "uatwhnc"])).collect()]
    assert got == ["floorplan", "photo", "logo", "brochure", "decorative", "tracking", "photo", "unknown"]
