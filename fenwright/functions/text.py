"""Text functions. All are column expressions; a missing value is an empty string, as in the source data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space for all functions here, with the no-break space that regular expressions otherwise leave out.
WS = r"[ \t\n\x0B\f\r ]"

#: What a status looks like in a text, the longer wordings first (fixed values).
STATUS_WORDINGS = [
    r"fully\s+fitted", r"partially\s+fitted", r"fit[\s\-]*outs?\s+underway", r"fitouts?\s+underway",
    r"cat\s*[ab]\s*[-–—]\s*custom\s+fit\s*outs?\s+opportunity", r"cat\s*[ab]\s*[-–—]?\s*(?:custom\s+)?fit\s*outs?(?:\s+opportunity)?",
    r"cat\s*[ab]\s*(?:fit\s*out|fitted)", r"custom\s+fit\s*out\s+opportunity", r"cat\s*[ab]\b", r"fitted", r"plug\s*(?:and|&)\s*play",
    r"available\s+(?:now|immediately)", r"immediate(?:\s+availability)?", r"vacant\s+possession", r"coming\s+soon", r"under\s+offer",
]
#: What a wording is called (fixed values): pattern, name; the first that fits wins.
STATUS = [
    (r"fully\s+fitted", "Fully Fitted"), (r"partially\s+fitted", "Partially Fitted"), (r"underway", "Fitout Underway"),
    (r"cat\s*a.*(?:custom|opportunity)", "CAT A - Custom Fit Out Opportunity"), (r"cat\s*a", "CAT A"),
    (r"cat\s*b.*(?:custom|opportunity)", "CAT B - Custom Fit Out Opportunity"), (r"cat\s*b", "CAT B"),
    (r"\bfitted\b", "Fitted"), (r"plug\s*(?:and|&)\s*play", "Plug and Play"), (r"available\s+now", "Available now"),
    (r"available\s+immediately|immediate(?:\s+availability)?", "Immediate"), (r"vacant\s+possession", "Vacant possession"),
    (r"coming\s+soon", "Coming soon"), (r"under\s+offer", "Under offer"),
]
#: Short words that are no junk, common words that turn up reversed, words and headings of sheets, and words of amenities (fixed values).
SHORT_WORDS = "ac av cat epc hr hvac it led m&e mr wc wifi".split()
COMMON_WORDS = (
    "space union from south north east west floor office kitchen fitted furnished available building street square house suite desk desks meeting rooms storage shower showers terrace "
    "reception lighting air conditioning raised floors bike cycle fibre fiber connectivity modern refurbishment natural light efficient floorplate agile work stations fully and the with for "
    "this that area unit ground first second third fourth fifth sixth seventh eighth ninth tenth london city spec type current footage size term rate price brochure contact features amenities "
    "description specification"
).split()
HEADINGS = "currentfloortype currentspec squarefootage floorsize sizesqft minimumterm monthlyrate pricepsqft pricepsqf desksmax marketingprice floorunit".split()
HEADING_PATTERN = (
    r"^(current\s*floor\s*type|current\s*spec|square\s*footage|floor\s*size|size\s*sq\.?\s*ft|minimum\s*term|monthly\s*rate|price\s*p/?sq\.?\s*ft|"
    r"desks?\s*\(?max\)?|marketing\s*price|floor\s*/?\s*unit)$"
)
HEADING_WORDS = "current floor type spec square footage size minimum term monthly rate price desks desk marketing unit".split()
AMENITY_WORDS = (
    "fitted furnished agile workstations stations kitchen kitchenette terrace shower showers bike cycle storage meeting reception conditioning lighting fibre fiber wifi hvac collab breakout lounge"
).split()
#: Ordinal words of floors (fixed values).
FLOOR_WORDS = {"basement": "-1", "lower ground": "-1", "ground": "0", "first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6", "seventh": "7", "eighth": "8", "ninth": "9", "tenth": "10"}
FILLER = ("", "n/a", "na", "-", "none", "tbc", "0")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty_as_null(x: Column) -> Column:
    return F.when(x != "", x)


def ws_norm(x: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), f"{WS}+", " "))


def match_norm(x: Column) -> Column:
    return F.lower(ws_norm(x))


def words_only(x: Column) -> Column:
    """Lower-case letters and digits; anything else is one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))


def has_value(x: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(x, F.lit("")))).isin(*FILLER)


def clean_cell(x: Column) -> Column:
    """Wrapped lines of a cell joined: a hyphen after a letter takes the next line as it is, else a space is put between."""
    lines = F.transform(F.split(F.coalesce(x, F.lit("")), "\n"), lambda s: F.trim(s))
    joined = lambda a, s: F.when(a == "", s).when(s == "", a).when(a.rlike("[A-Za-z]-$"), F.concat(a, s)).otherwise(F.concat_ws(" ", a, s))
    return F.aggregate(lines, F.lit(""), joined)


def titlecase(x: Column) -> Column:
    return F.initcap(x)


def word_count(x: Column) -> Column:
    t = ws_norm(x)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def first_words(x: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(ws_norm(x), " "), 1, n), " ")


def cap_prose(x: Column, max_words: int = 100) -> Column:
    """At most max_words words: whole if short enough, else up to the last full sentence or item within them (the longer
    one), else cut with `...`."""
    def cut(w: Column) -> Column:
        def best_of(head: Column) -> Column:
            sentence = F.regexp_extract(head, r"^(.*[.!?])(?: .*)?$", 1)
            item = F.trim(F.regexp_extract(head, r"^(.*);[^;]*$", 1))
            size = lambda c: F.struct(F.size(F.split(c, " ")).alias("w"), F.length(c).alias("n"), c.alias("t"))
            best = F.greatest(size(sentence), size(item))["t"]
            return F.when(best != "", best).otherwise(F.concat(F.regexp_replace(head, "[.,;:!? ]+$", ""), F.lit("...")))

        return F.when(F.size(w) <= max_words, F.array_join(w, " ")).otherwise(let(F.array_join(F.slice(w, 1, max_words), " "), best_of))

    return let(F.split(ws_norm(x), " "), cut)


def kept_items(x: Column, max_words: int = 100, max_items: int = 12, sep: str = ";") -> Column:
    """Leading items of a list while their words stay within max_words in all, at most max_items of them."""
    items = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), sep), ws_norm), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("words"), F.lit(False).alias("full"))

    def step(a: Column, s: Column) -> Column:
        total = a["words"] + F.size(F.split(s, " "))
        over = a["full"] | (total > max_words) | (F.size(a["kept"]) >= max_items)
        return F.struct(F.when(over, a["kept"]).otherwise(F.array_append(a["kept"], s)).alias("kept"), F.when(over, a["words"]).otherwise(total).alias("words"), over.alias("full"))

    return F.aggregate(items, start, step, lambda a: a["kept"])


def parts_of(x: Column) -> Column:
    """The parts of a list: cut at semicolons, bullets and line ends."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"[;\n•·]+"), lambda s: F.trim(s)), lambda s: s != "")


def _tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("([A-Za-z0-9&]+)"), F.lit(1))


def is_noise(x: Column) -> Column:
    """Layout noise of a page read across its columns: four or more one-letter parts, several reversed words, or junk among at least 45 of 100
    tokens."""

    def judge(s: Column) -> Column:
        parts, found = F.get(s["parts"], F.lit(0)), s["tokens"]
        count = lambda items, test: F.size(F.filter(items, test))
        single = count(parts, lambda t: F.regexp_replace(t, r"[,.;:!?·•]+$", "").rlike(r"^[A-Za-z0-9]?$"))
        back, odd = count(found, is_reversed_word), count(found, is_consonant_junk)
        heads, codes = count(parts, is_heading), count(found, lambda t: is_code(t) & ~t.rlike("^[0-9]+$"))
        signal = back + odd + heads + F.when(single >= 2, 1).otherwise(0)
        noisy = (single >= 4) | (back >= 2) | ((back >= 1) & (single >= 2)) | ((signal >= 3) & (F.size(parts) >= 5))
        return (F.size(parts) > 0) & (noisy | ((F.size(found) >= 6) & ((back + odd + heads + codes + single) * 100 >= F.size(found) * 45)))

    return let(F.struct(F.array(parts_of(x)).alias("parts"), _tokens(F.coalesce(x, F.lit(""))).alias("tokens")), judge)


def _letters(t: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), "[^a-z]", "")


def is_reversed_word(t: Column) -> Column:
    """A common word of at least four letters, spelled backwards."""
    w = _letters(t)
    return (F.length(w) >= 4) & ~w.isin(*COMMON_WORDS) & F.reverse(w).isin(*COMMON_WORDS)


def is_consonant_junk(t: Column) -> Column:
    """A reversed word, or four letters or more with hardly a vowel among them."""
    w = _letters(t)
    vowels = F.length(F.regexp_replace(w, "[^aeiou]", ""))
    hardly = (vowels == 0) | ((F.length(w) >= 5) & (vowels * 10 <= F.length(w) * 2)) | (w.rlike("[bcdfghjklmnpqrstvwxyz]{4,}") & (vowels * 100 < F.length(w) * 35))
    return (F.length(w) >= 4) & ~w.isin(*SHORT_WORDS, *COMMON_WORDS) & (F.reverse(w).isin(*COMMON_WORDS) | hardly)


def is_code(t: Column) -> Column:
    """Digits, or one to three of them with one or two letters before or behind, unless an energy rating."""
    w = F.lower(F.trim(F.coalesce(t, F.lit(""))))
    return ~w.isin(*SHORT_WORDS) & ~w.rlike("^epc[a-g]$") & w.rlike("^([0-9]+|[a-z]{1,2}[0-9]{1,3}|[0-9]{1,3}[a-z]{1,2})$")


def is_junk_token(t: Column) -> Column:
    """A code, a reversed or garbled word, up to two letters, or three capitals; but for the known short words."""
    return ~F.lower(t).isin(*SHORT_WORDS) & (is_code(t) | is_consonant_junk(t) | is_reversed_word(t) | t.rlike("^[A-Za-z]{1,2}$") | t.rlike("^[A-Z]{3}$"))


def is_amenity_phrase(x: Column) -> Column:
    """Three words or more, or a word of an amenity."""
    return let(F.regexp_extract_all(F.lower(x), F.lit("([a-z]+)"), F.lit(1)), lambda w: (F.size(w) >= 3) | F.exists(w, lambda t: t.isin(*AMENITY_WORDS) | F.regexp_replace(t, "s+$", "").isin(*AMENITY_WORDS)))


def is_heading(x: Column) -> Column:
    """The heading of a sheet's column, however it is glued together."""
    s = ws_norm(x)
    apart = ws_norm(F.regexp_replace(s, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[^0-9])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " "))
    run = let(F.regexp_extract_all(F.lower(apart), F.lit("([a-z]+)"), F.lit(1)), lambda w: (F.size(w) >= 2) & F.forall(w, lambda t: t.isin(*HEADING_WORDS)))
    return (s != "") & (F.regexp_replace(F.lower(s), "[^a-z0-9]+", "").isin(*HEADINGS) | F.lower(s).rlike(HEADING_PATTERN) | F.lower(apart).rlike(HEADING_PATTERN) | (run & ~is_amenity_phrase(apart)))


def without_single_chars(items: Column) -> Column:
    """Items of more than one character: letters of a word that stands upright on a page go."""
    return F.filter(items, lambda s: F.length(F.trim(s)) > 1)


#: Words before a semicolon that a list's item goes on after, and lines of a page that are no item (fixed values).
OPEN_ENDED = r"(?i)\b(and|or|with|to|for|of|in|on|at|by|from|into|over|under|the)\s*;\s*"
PAGE_LINES = r"(?i)^(page\s*[0-9]+|continued|cont\.?|see over|www\.|http\S+)$"
#: Where glued words come apart (fixed value).
CAMEL = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[^0-9])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
#: Below so many words a cleaned text is hardly one; from so many real words on the source was one (fixed values).
FEW_WORDS, REAL_WORDS = 4, 8


def split_camel(x: Column) -> Column:
    """Glued words apart: at a capital behind a small letter, and between letters and digits."""
    return ws_norm(F.regexp_replace(x, CAMEL, " "))


def _unpunctuated(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(x), r"[,.;:!?·•]+$", ""))


def _is_garbage(t: Column) -> Column:
    return is_reversed_word(t) | is_consonant_junk(t)


def is_junk_item(x: Column) -> Column:
    """An item that says nothing: a page's line, a heading, digits, junk tokens only, or garbled words for the greater part."""

    def judge(w: Column) -> Column:
        garbled = F.size(F.filter(w, _is_garbage))
        return (F.size(w) == 0) | F.forall(w, is_junk_token) | ((garbled > 0) & (garbled >= F.floor((F.size(w) + 1) / 2)))

    s = _unpunctuated(x)
    return (s == "") | s.rlike(PAGE_LINES) | s.rlike(r"^[0-9\s./-]+$") | is_heading(s) | let(_tokens(s), judge)


def unglued(x: Column) -> Column:
    """An item with glued words apart and headings and desk counts left out; empty if it is junk as a whole."""
    s = _unpunctuated(x)
    words = F.split(s, " +")
    glued = F.exists(words, lambda w: w.rlike(r"[a-z][A-Z]|[0-9][A-Za-z]|[A-Za-z][0-9]") | F.regexp_replace(F.lower(w), "[^a-z0-9]+", "").isin(*HEADINGS))
    kept = F.filter(words, lambda w: ~w.rlike(r"(?i)^[0-9]+desks?$") & ~is_reversed_word(w) & ~is_heading(w))
    apart = F.array_join(F.transform(kept, split_camel), " ")
    alone = ~s.contains(" ") & is_junk_token(s) & ~is_amenity_phrase(s)
    return F.when(is_reversed_word(s) | alone, F.lit("")).when(glued, F.when(is_heading(apart), F.lit("")).otherwise(apart)).when(is_heading(s), F.lit("")).otherwise(s)


def _spoken(x: Column) -> Column:
    """An item in capitals as a word with one."""
    letters = F.regexp_replace(x, "[^A-Za-z]", "")
    return F.when((F.length(letters) >= 4) & letters.rlike("^[A-Z]+$"), F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 100_000)))).otherwise(x)


def _clean_items(x: Column) -> Column:
    """The items of a list, mended and without junk, each once."""
    mended = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), OPEN_ENDED, "$1 "), r"(?<=[a-z]{3})\s*;\s*(?=[a-z]{3})", " ")
    said = F.transform(F.filter(parts_of(mended), lambda p: F.length(_unpunctuated(p)) > 1), lambda p: _spoken(ws_norm(_unpunctuated(unglued(p)))))
    key = lambda p: words_only(p)
    once = lambda items: F.filter(items, lambda p, i: (key(p) != "") & (F.array_position(F.transform(items, key), key(p)) == i + 1))
    return let(F.filter(said, lambda p: (p != "") & ~is_junk_item(p)), once)


def amenities(x: Column, max_words: int = 100, max_items: int = 12) -> Column:
    """A list of amenities from a dump of them: empty if it is layout noise; else its clean items while their words stay within max_words."""
    return F.when(is_noise(x), F.lit("")).otherwise(F.array_join(kept_items(F.array_join(_clean_items(x), ";"), max_words, max_items), "; "))


def is_dump(x: Column) -> Column:
    """A list of three items or more of which two are junk, or of four or more short ones."""
    items = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ";"), lambda s: F.trim(s)), lambda s: s != "")

    def judge(p: Column) -> Column:
        words = F.aggregate(p, F.lit(0), lambda n, s: n + F.size(F.split(s, " +")))
        return (F.size(p) >= 3) & ((F.size(F.filter(p, is_junk_item)) >= 2) | ((F.size(p) >= 4) & (words <= 15 * F.size(p))))

    return let(items, judge)


def has_substance(x: Column) -> Column:
    """Enough real words for a description."""
    return F.size(F.filter(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("([A-Za-z]{3,})"), F.lit(1)), lambda w: ~_is_garbage(w))) >= REAL_WORDS


def clean_features(x: Column, max_words: int = 100, force: bool = False) -> Column:
    """A feature text: prose is capped; a dump of amenities becomes a clean list; if hardly anything is left of one that has substance, its items or
    sentences stay as a description; layout noise without substance is empty."""

    def judge(t: Column) -> Column:
        facts = F.struct(is_noise(t).alias("noise"), (F.lit(force) | is_dump(t)).alias("dump"), has_substance(t).alias("substance"), F.array(_clean_items(t)).alias("items"))
        return let(facts, lambda f: F.when(f["noise"] | f["dump"], let(F.get(f["items"], F.lit(0)), lambda p: mended(f, p))).otherwise(t))

    def mended(f: Column, p: Column) -> Column:
        listed = F.when(f["noise"], F.lit("")).otherwise(F.array_join(kept_items(F.array_join(p, ";"), max_words), "; "))
        short = (F.size(p) >= 2) & F.forall(p, lambda i: F.size(F.split(i, " ")) <= 15)
        tale = F.when(f["substance"], F.when(short, F.array_join(p, "; ")).otherwise(F.array_join(p, " "))).otherwise("")
        few = lambda x: word_count(x) < FEW_WORDS
        return let(F.struct(listed.alias("l"), tale.alias("t")), lambda s: F.when(~few(s["l"]), s["l"]).when(f["noise"] & ~f["substance"], F.lit("")).when(~few(s["t"]), s["t"]).otherwise(s["l"]))

    return cap_prose(let(ws_norm(x), judge), max_words)


def brochure_features(preferred: Column, fallback: Column) -> Column:
    """The features of a brochure from the parts of its sections on amenities, or else of other sections if these are lists or short."""
    joined = lambda parts: join_distinct(F.filter(parts, lambda p: ws_norm(p) != ""), "; ")
    items = lambda t: let(parts_of(t), lambda p: F.when(F.size(p) >= 2, F.aggregate(p, F.lit(0), lambda n, s: n + F.size(F.split(s, " +"))) <= 12 * F.size(p)).otherwise(word_count(t).between(2, 40)))
    first, second = let(joined(preferred), lambda t: clean_features(F.when(~is_noise(t), t), force=True)), let(joined(fallback), lambda t: clean_features(F.when(~is_noise(t) & items(t), t), force=True))
    return F.when(first != "", first).otherwise(second)


def useful_primary(x: Column, max_words: int = 40) -> Column:
    return (ws_norm(x) != "") & (word_count(x) <= max_words) & ~is_noise(x)


_ANY_STATUS = rf"(?i)\b({'|'.join(STATUS_WORDINGS)})\b"
_ONLY_STATUS = rf"(?i)^(?:{'|'.join(STATUS_WORDINGS)})$"


def _status_name(found: Column) -> Column:
    """What a wording is called."""
    t = F.lower(found)
    out = F.concat(F.upper(F.substring(found, 1, 1)), F.substring(found, 2, 1000))
    for pattern, name in reversed(STATUS):
        out = F.when(t.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(found == "", F.lit("")).otherwise(out)


def _bare(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_]+", "")


def status(x: Column) -> Column:
    """struct(tag, pure): the status that a text names first, with a short note in brackets if the text is nothing else; and whether it is."""

    def judge(t: Column) -> Column:
        note = F.regexp_extract(t, r"^(.*\S)\s*(\([^)]{1,40}\))$", 2)
        core = F.when(note != "", F.regexp_extract(t, r"^(.*\S)\s*(\([^)]{1,40}\))$", 1)).otherwise(t)
        found, inner = F.regexp_extract(t, _ANY_STATUS, 1), F.regexp_extract(core, _ANY_STATUS, 1)
        only = lambda c, f: c.rlike(_ONLY_STATUS) | ((f != "") & (_bare(c) == _bare(_status_name(f))))
        noted = (note != "") & only(core, inner)
        tag = F.when(noted, F.concat(_status_name(inner), F.lit(" "), note)).otherwise(_status_name(found))
        return F.struct(tag.alias("tag"), (noted | only(t, found)).alias("pure"), found.alias("found"))

    return let(ws_norm(x), judge)


def status_tag(x: Column) -> Column:
    """The name of the first status in a text, else empty."""
    return status(x)["tag"]


def partition_status(x: Column) -> Column:
    """struct(status, rest): a list's first item that is nothing but a status, and the others; or the status of a text, with the whole text as the
    rest unless it is nothing else. A text's bare `fitted` is no status."""
    items = F.filter(F.transform(F.split(ws_norm(x), ";"), lambda s: F.trim(s)), lambda s: s != "")
    judged = F.transform(items, lambda s: F.struct(s.alias("s"), status(s).alias("j")))
    pure = lambda i: i["j"]["pure"] & (i["j"]["tag"] != "")
    made = lambda tag, rest: F.struct(tag.alias("status"), rest.alias("rest"))

    def listed(j: Column) -> Column:
        tags = F.filter(j, pure)
        return made(F.coalesce(F.get(tags, F.lit(0))["j"]["tag"], F.lit("")), F.array_join(F.transform(F.filter(j, lambda i: ~pure(i)), lambda i: i["s"]), "; "))

    def whole(t: Column) -> Column:
        named = lambda j: F.when(j["pure"] & (j["tag"] != ""), made(j["tag"], F.lit(""))).when((j["tag"] == "") | (F.lower(j["found"]) == "fitted"), made(F.lit(""), t)).otherwise(made(j["tag"], t))
        return let(status(t), named)

    return F.when(F.contains(F.coalesce(x, F.lit("")), F.lit(";")), let(judged, listed)).otherwise(let(ws_norm(x), whole))


def clean_status(x: Column) -> Column:
    """The status of the field for it, else empty; layout noise has none."""
    return F.when(is_noise(ws_norm(x)), F.lit("")).otherwise(partition_status(x)["status"])


def reclassify(features: Column, state: Column) -> Column:
    """struct(features, status): a status among the features moves to the status field if that has none, and what else stood in that goes to the
    features if these had a status."""
    join = lambda *x: F.array_join(F.filter(F.array(*x), lambda s: s != ""), "; ")

    made = lambda a, b: F.struct(a.alias("features"), b.alias("status"))

    def judge(s: Column) -> Column:
        f, t, p, q = s["f"], s["t"], s["p"], s["q"]
        clean = F.when(s["noise"], F.lit("")).otherwise(q["status"])
        unclear = (clean == "") & (t != "")
        rest = (
            F.when(unclear & (q["status"] != "") & (q["rest"] != "") & (q["rest"] != t), join(p["rest"], q["rest"]))
            .when(unclear & (q["status"] != "") & (q["rest"] == t) & (f == ""), q["rest"])
            .when(unclear & (q["status"] == "") & (s["named"] == ""), join(p["rest"], t))
            .otherwise(p["rest"])
        )
        state_ = F.when(clean != "", clean).when(q["status"] != "", q["status"]).otherwise(p["status"])
        return F.struct(F.when(p["status"] == "", f).otherwise(rest).alias("features"), state_.alias("state"))

    def finish(k: Column) -> Column:
        peeled = lambda j: F.when(j["pure"] & (j["tag"] != ""), made(F.lit(""), F.when(k["state"] == "", j["tag"]).otherwise(k["state"]))).otherwise(made(k["features"], k["state"]))
        return let(status(k["features"]), peeled)

    f, t = ws_norm(features), ws_norm(state)
    known = F.struct(f.alias("f"), t.alias("t"), partition_status(f).alias("p"), partition_status(t).alias("q"), is_noise(t).alias("noise"), status_tag(t).alias("named"))
    return let(let(let(known, judge), lambda k: F.struct(clean_features(k["features"]).alias("features"), k["state"].alias("state"))), finish)


#: Lines of page footers that are no term, and what a term looks like (fixed values).
TERM_JUNK = r"\b(copyright|all\s+rights\s+reserved|terms?\s+of\s+use|privacy\s+policy|cookie\s+policy|unit\s+details|cookie\s+settings|legal\s+notice)\b"
TERM = r"\b([0-9]+)\s*(months?|years?|yrs?)\b|\b(rolling|flexible|monthly|quarterly)\b"


def min_term(x: Column) -> Column:
    """The first term as it is given, `N months` or `N years` or a word for it; empty if there is none or the text is a page's footer."""

    def judge(t: Column) -> Column:
        n, unit, word = (F.regexp_extract(t, TERM, i) for i in (1, 2, 3))
        return F.when(t.rlike(TERM_JUNK), F.lit("")).when(n != "", F.concat(n, F.lit(" "), F.regexp_replace(unit, "^yr", "year"))).otherwise(F.initcap(word))

    return let(F.lower(ws_norm(x)), judge)


def looks_like_phone(x: Column) -> Column:
    return ~x.rlike("[A-Za-z]") & (F.length(F.regexp_replace(x, "[^0-9]", "")) >= 7)


def names_only(x: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda s: F.trim(s))
    return F.array_join(F.filter(parts, lambda s: (s != "") & ~s.contains("@") & ~looks_like_phone(s)), ", ")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ()-]{7,}[0-9]"


def contact_text(x: Column) -> Column:
    """Up to two names, e-mails and phones; empty if more than three e-mails are named."""
    t = F.coalesce(x, F.lit(""))
    mails = F.regexp_extract_all(t, F.lit(f"({EMAIL})"), F.lit(1))
    phones = F.regexp_extract_all(t, F.lit(f"({PHONE})"), F.lit(1))
    names = F.filter(F.split(names_only(t), ", "), lambda s: s != "")
    joined = F.array_join(F.concat(F.slice(names, 1, 2), F.slice(mails, 1, 2), F.slice(phones, 1, 2)), ", ")
    return F.when(F.size(mails) > 3, F.lit("")).otherwise(joined)


def combine_name_address(name: Column, address: Column) -> Column:
    n, a = ws_norm(name), ws_norm(address)
    return F.when(n == "", a).when((a == "") | F.contains(F.lower(n), F.lower(a)), n).when(F.contains(F.lower(a), F.lower(n)), a).otherwise(F.concat_ws(", ", n, a))


def floor_token(x: Column) -> Column:
    """The floor that a text names, as a number in text; else empty."""
    t = F.lower(ws_norm(x))
    number = F.regexp_extract(t, r"\b([0-9]{1,2})(?:st|nd|rd|th)\b", 1)
    out = F.lit("")
    for word, n in reversed(FLOOR_WORDS.items()):
        out = F.when(t.rlike(rf"\b{word}\b"), F.lit(n)).otherwise(out)
    return F.when(number != "", number).otherwise(out)


#: The letters with which a building's name begins (fixed value).
LEADING_NAME = r"^([A-Za-z][A-Za-z\s'-]*)"


def name_tiers(building: Column) -> Column:
    """Ways to name a building on a page, the most exact first: whole, before the first comma, the leading run of letters; in small letters, each once."""
    b = F.coalesce(building, F.lit(""))
    forms = F.array(b, F.regexp_extract(b, "(?s)^([^,]*),", 1), F.regexp_extract(b, LEADING_NAME, 1))
    return F.array_distinct(F.filter(F.transform(forms, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def sanitize_name(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r'[\\/:*?"<>|]+', "_"))


def provider_from_filename(x: Column) -> Column:
    """The part of a file name before its first ` - `, without a forwarding prefix and the extension."""
    t = F.regexp_replace(F.regexp_replace(x, r"\.[A-Za-z0-9]+$", ""), r"(?i)^(fw|fwd|re)[_: ]+", "")
    return F.trim(F.get(F.split(t, " - "), F.lit(0)))


def wrapped_lines(x: Column, width: int) -> Column:
    """Lines that a text takes at a width, at least one for each of its own."""
    per = F.transform(F.split(F.coalesce(x, F.lit("")), "\n"), lambda s: F.greatest(F.lit(1), F.ceil(F.length(s) / width)).cast("long"))
    return F.aggregate(per, F.lit(0).cast("long"), lambda a, n: a + n)


def join_distinct(items: Column, sep: str = ", ") -> Column:
    """Items joined, each once; case and spacing do not count, the first form stays."""
    def pick(keyed: Column) -> Column:
        return F.transform(F.filter(F.array_distinct(keyed), lambda k: k != ""), lambda k: ws_norm(F.get(items, F.array_position(keyed, k).cast("int") - 1)))

    return F.array_join(let(F.transform(items, match_norm), pick), sep)


def area_hint(filename: Column, provider: Column) -> Column:
    """The last ` - ` segment of a file name that is neither the provider nor a date nor a word for a list."""
    stem = F.regexp_replace(F.regexp_replace(filename, r"\.[A-Za-z0-9]+$", ""), r"(?i)^(fw|fwd|re)[_: ]+", "")
    parts = F.reverse(F.transform(F.split(stem, " - "), lambda s: F.trim(s)))
    plain = F.filter(parts, lambda s: (s != "") & (F.lower(s) != F.lower(provider)) & ~s.rlike("[0-9]") & ~F.lower(s).rlike("availab|list|update|schedule"))
    return F.coalesce(F.get(plain, F.lit(0)), F.lit(""))


def area_of_sheet(name: Column) -> Column:
    """A sheet's name as an area, unless it is a default or a general one."""
    t = ws_norm(name)
    return F.when(F.lower(t).rlike("^(sheet ?[0-9]*|availability|listings?|data)$"), F.lit("")).otherwise(F.initcap(t))


def desk_extras(x: Column) -> Column:
    """What a desks cell says beyond a number: `30 + 3 MR` gives `3 MR`."""
    return F.trim(F.regexp_extract(ws_norm(x), r"^[0-9]+(?:-[0-9]+)? *\+ *(.+)$", 1))


def contact_block(lines: Column) -> Column:
    """Names, e-mails and phones of a block of lines; a phone that is wrapped over two lines is put together."""
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"(\+?[0-9][0-9 ]{3,})\n([0-9 ]{3,})(?=\n|$)", "$1$2")
    names = F.filter(F.split(joined, "\n"), lambda s: s.rlike(r"^[A-Z][a-zA-Z'.-]+(?: [A-Z][a-zA-Z'.-]+)+$"))
    mails, phones = F.regexp_extract_all(joined, F.lit(f"({EMAIL})"), F.lit(1)), F.regexp_extract_all(joined, F.lit(f"({PHONE})"), F.lit(1))
    return F.array_join(F.concat(F.slice(names, 1, 2), F.slice(mails, 1, 2), F.slice(phones, 1, 2)), ", ")
