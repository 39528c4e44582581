"""Merging of values with confidences, and JSON of language models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .address import numbers_match, parse_address, postcode
from .numbers import tolerant_equal
from .text import let, words_only, ws_norm


def merge_value(value: Column, confidence: Column, new: Column, new_confidence: Column, locked: Column | bool = False, fill: float = 0.7, weak: float = 0.8) -> Column:
    """struct(value, confidence, outcome). A blank is filled by evidence of at least `fill`; an equal value stays as it is, and numbers within 2 %
    (at least 1) of each other are equal; a value below `weak` gives way to stronger evidence; anything else stays and is a conflict. A
    locked field only takes what fills a blank."""
    lock = F.lit(locked) if isinstance(locked, bool) else locked
    blank, none = F.coalesce(value, F.lit("")) == "", F.coalesce(new, F.lit("")) == ""
    same = equivalent(value, new)
    outcome = (
        F.when(none, F.lit("no evidence"))
        .when(blank, F.when(new_confidence >= fill, F.lit("filled")).otherwise(F.lit("too weak")))
        .when(same, F.lit("agrees"))
        .when(~lock & (confidence < weak) & (new_confidence > confidence), F.lit("replaced"))
        .otherwise(F.lit("conflict"))
    )
    take = outcome.isin("filled", "replaced")
    return F.struct(F.when(take, new).otherwise(F.coalesce(value, F.lit(""))).alias("value"), F.when(take, new_confidence).otherwise(confidence).alias("confidence"), outcome.alias("outcome"))


def equivalent(a: Column, b: Column) -> Column:
    """Two values as numbers within 2 % of the first, at least 1, of each other; else as texts without regard to case and punctuation."""
    x, y = a.try_cast("double"), b.try_cast("double")
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))
    return F.when(x.isNotNull() & y.isNotNull(), tolerant_equal(x, y)).otherwise(plain(a) == plain(b))


def model_json(raw: Column, schema: str) -> Column:
    """The JSON in a model's answer: fences and text around it are dropped; malformed JSON is null."""
    body = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)([\[{].*[\]}])", 1)
    return F.when(body != "", F.from_json(body, schema))


#: A house number with a street's name (fixed value).
NUMBERED_STREET = r"(?i)\b([0-9]+[A-Z]?(?:\s*-\s*[0-9]+[A-Z]?)?\s+[A-Z][A-Z'?.-]*(?:\s+[A-Z][A-Z'?.-]*){0,4}\s+(?:STREET|ST|ROAD|RD|LANE|LN|SQUARE|SQ|AVENUE|AVE|PLACE|PL|COURT|CT|WAY|YARD|GARDENS|TERRACE|MEWS|CIRCUS))\b"


def identity(building: Column, street: Column, code: Column, text: Column, association: Column | float = 0.0) -> Column:
    """Whether a linked text is about a property: MATCH, PROBABLE_MATCH, AMBIGUOUS or HARD_CONFLICT. A postcode, or a numbered street, that the
    text names and that is another one is a conflict; the same one is a match; else the property's name, or a link from its midst to a text that
    names no place, makes it probable."""

    def judge(s: Column) -> Column:
        own, codes, streets, words = s["own"], s["codes"], s["streets"], s["words"]
        known = (own["number"] != "") & (own["street"] != "") & (F.size(streets) > 0)
        same_street = F.exists(streets, lambda t: (t["street"] == own["street"]) & numbers_match(own["number"], t["number"]))
        same_code = (own["postcode"] != "") & F.array_contains(codes, own["postcode"])
        other_code = (own["postcode"] != "") & (F.size(codes) > 0) & ~same_code
        name = F.when(own["name"] != "", own["name"]).otherwise(s["primary"])
        telling = F.filter(F.split(name, " "), lambda w: (F.length(w) > 3) & ~w.isin("london", "floor"))
        found = F.size(F.filter(telling, lambda w: F.contains(words, w)))
        named = (F.size(telling) > 0) & (found >= F.least(F.lit(2), F.size(telling)))
        near = (s["near"] >= 0.8) & (F.size(codes) == 0) & (F.size(streets) == 0)
        return F.when(other_code | (known & ~same_street), "HARD_CONFLICT").when(known | same_code, "MATCH").when(named | near, "PROBABLE_MATCH").otherwise("AMBIGUOUS")

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), ws_norm)
    flat = F.array_join(lines, "\n")
    primary = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (building, street, code)])
    streets = F.filter(F.transform(F.regexp_extract_all(flat, F.lit(NUMBERED_STREET), F.lit(1)), parse_address), lambda t: (t["number"] != "") & (t["street"] != ""))
    near = F.lit(association) if isinstance(association, float) else F.coalesce(association, F.lit(0.0))
    facts = F.struct(
        parse_address(primary).alias("own"), F.array_distinct(F.filter(F.transform(lines, postcode), lambda c: c != "")).alias("codes"), streets.alias("streets"), words_only(flat).alias("words"),
        words_only(primary).alias("primary"), near.alias("near"),
    )
    return let(facts, judge)
