"""URL functions: canonical form, resolution, predicates, classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, match_norm

#: Query keys that do not name another document (fixed values).
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "mc_cid", "mc_eid"]
RENDITION = ["width", "height", "format", "quality", "fit", "crop", "dpr", "v"]
#: Signatures of payloads (fixed values): leading bytes in hex, type.
MAGIC = [("25504446", "pdf"), ("FFD8FF", "image"), ("89504E47", "image"), ("47494638", "image"), ("504B0304", "office")]
#: Endings of image and document paths, and parts of paths that lead to images without an ending (fixed values).
IMAGE_ENDINGS = ["jpg", "jpeg", "png", "webp", "gif"]
DOCUMENT_ENDINGS = ["pdf", "doc", "docx"]
IMAGE_PATHS = r"/assets?/|/media/|/digitalassets?/|/static/(?:img|images|media)/|/img/|/photos?/|/gallery/"
#: Words that tell what an address or its label is about (fixed values).
ABOUT = {
    "decorative": r"pixel|tracking|spacer|social|icon|divider|transparent",
    "logo": r"logo|brandmark|signature|avatar|headshot",
    "preview": r"preview|thumbnail|thumb|document[-_ ]?(?:cover|page)|og[-_ ]?image",
    "map": r"map|location[\s_-]*plan|streetview",
    "floorplan": r"floor[\s_-]*plan|floorplan|layout",
    "brochure": r"brochure|particulars|marketing[\s_-]*details|download\s*(?:pdf|details|document)",
    "property": r"reception|office|workspace|interior|exterior|terrace|meeting|boardroom|breakout|kitchen|building|facade|fa.ade|gallery|hero|desk|lounge|property",
}
#: Labels of links to a brochure, and addresses that are documents whatever their label (fixed values).
BROCHURE_LABELS = (
    r"brochure|view\s*propert|property\s*details|particulars|click\s*here|view\s*listing|website|download|more\s*info|landlord|full\s*details|"
    r"learn\s*more|see\s*(?:more|details)|explore\s*(?:property|listing)|find\s*out\s*more|read\s*more"
)
DOCUMENT_PLACES = r"drive\.google\.com|docs\.google\.com|dropbox\.com|/file/d/|\.pdf(?:[?#]|$)|list-manage\.com|usercontent\.google\.com|box\.com/(?:s|shared/static)/|dl\.dropboxusercontent\.com"
FOOTER_PARTS = r"unsubscribe|/profile\?|update%20your%20preferences|preferences"
NOT_CONTENT = r"wisestamp\.com|cdn-images\.mailchimp\.com"


def matches(x: Column, pattern: str) -> Column:
    return F.coalesce(x, F.lit("")).rlike(f"(?i)(?:{pattern})")


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(u: Column) -> Column:
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def _decoded(x: Column) -> Column:
    """A query's name or value as text; what is not well encoded stays as it is."""
    return F.coalesce(F.try_url_decode(x), F.regexp_replace(x, r"\+", " "))


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _name(pair: Column) -> Column:
    return _decoded(F.regexp_extract(pair, "(?s)^([^=]*)", 1))


def _value(pair: Column) -> Column:
    return _decoded(F.regexp_extract(pair, "(?s)^[^=]*=(.*)$", 1))


def canonical(u: Column, drop: list[str] | None = None) -> Column:
    """http(s) only: lower scheme and host, no fragment, no tracking or rendition keys, other keys and values encoded alike; an image
    optimiser's address is the one inside it. Anything else is empty."""
    return let(F.trim(F.coalesce(u, F.lit(""))), lambda x: let(_plain_canonical(x, drop), lambda plain: let(_inner(x), lambda i: F.when(F.coalesce(i, F.lit("")) == "", plain).otherwise(F.coalesce(F.nullif(_plain_canonical(i, drop), F.lit("")), plain)))))


def is_address(u: Column) -> Column:
    """Whether it has a canonical form."""
    x = F.trim(F.coalesce(u, F.lit("")))
    return scheme(x).isin("http", "https") & (host(x) != "") & (host(x).contains("[") == host(x).contains("]"))


def _inner(u: Column) -> Column:
    """The address inside an image optimiser's `url=`, else null."""
    inside = F.filter(F.split(query(u), "&"), lambda kv: _name(kv) == "url")
    return F.when(F.contains(F.lower(path(u)), F.lit("/_next/image")), _decoded(_value(F.try_element_at(inside, F.lit(-1)))))


def _plain_canonical(u: Column, drop: list[str] | None) -> Column:
    keep = F.filter(F.split(query(u), "&"), lambda kv: (kv != "") & ~F.lower(_name(kv)).isin(drop or TRACKING + RENDITION))
    q = F.array_join(F.transform(keep, lambda kv: F.concat(_encoded(_name(kv)), F.lit("="), _encoded(_value(kv)))), "&")
    return F.when(is_address(u), F.concat(scheme(u), F.lit("://"), host(u), path(u), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))).otherwise(F.lit(""))


def unwrapped(u: Column) -> Column:
    """The address inside an image proxy's or tracker's `url=` value, decoded, else the address itself."""
    inner = F.regexp_extract(query(u), "(?:^|&)(?:url|u|target)=([^&]*)", 1)
    decoded = F.try_url_decode(inner)
    return F.when((inner != "") & decoded.rlike("^https?://"), decoded).otherwise(u)


def resolve(base: Column, href: Column) -> Column:
    """An absolute address for a rooted, protocol-relative or absolute link."""
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href)).when(href.startswith("/"), F.concat(scheme(base), F.lit("://"), host(base), href)).otherwise(F.lit(""))


def hostname(u: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host(u), r"^.*@", ""), r":[0-9]*$", "")


def is_image_like(u: Column) -> Column:
    """By an image's ending anywhere before a query or the end, or by a path that leads to images."""
    return matches(u, rf"\.(?:{'|'.join(IMAGE_ENDINGS)})(?:[?#]|$)") | matches(path(u), IMAGE_PATHS)


def is_document_like(u: Column) -> Column:
    return F.lower(path(u)).rlike(r"\.(pdf|docx?|pptx?)$")


def is_content_image(alt: Column, u: Column) -> Column:
    """A photo or plan rather than a logo, an icon or a mail tool's picture."""
    return (F.coalesce(u, F.lit("")) != "") & ~matches(alt, "logo|icon|social") & ~matches(u, "logo") & ~matches(u, NOT_CONTENT) & is_image_like(u)


def is_floorplan_label(label: Column) -> Column:
    return matches(label, r"floor\s*plan")


def is_brochure_link(label: Column, u: Column) -> Column:
    """By its label, or by its address unless that is one of a mail's footer."""
    return matches(label, BROCHURE_LABELS) | (~F.lower(F.coalesce(u, F.lit(""))).rlike(FOOTER_PARTS) & matches(u, DOCUMENT_PLACES))


def is_seed_link(label: Column, u: Column, building: Column) -> Column:
    """A link from which a listing's evidence can be looked up: a plan, a brochure, or a page whose label and the building name each other."""
    b, t = match_norm(building), match_norm(label)
    named = (b != "") & (t != "") & (F.contains(t, b) | F.contains(b, t))
    page = scheme(F.coalesce(u, F.lit(""))).isin("http", "https") & ~F.lower(u).rlike(r"unsubscribe|/profile\?|mailto:|tel:|javascript:") & ~is_image_like(u)
    return is_floorplan_label(label) | is_brochure_link(label, u) | F.coalesce(page & named, F.lit(False))


def is_low_trust(u: Column) -> Column:
    """Of a host that shows documents only by script."""
    return matches(host(u), r"(?:^|\.)canva\.(?:com|link)$|(?:^|\.)pitch\.com$|(?:^|\.)box\.com$")


def best_candidate(addresses: Column) -> Column:
    """The first address of an array that is not of a low-trust host, else the first."""
    return F.coalesce(F.get(F.filter(addresses, lambda u: ~is_low_trust(u)), F.lit(0)), F.get(addresses, F.lit(0)))


def _is_box(h: Column) -> Column:
    return ~h.contains("dropbox") & ((h == "box.com") | h.endswith(".box.com"))


def is_hosted_document(u: Column) -> Column:
    """Of a file share or a mail tool's tracker, whose pages stand for documents."""
    h = hostname(u)
    return _is_box(h) | h.isin("drive.google.com", "docs.google.com") | h.endswith("drive.usercontent.google.com") | h.contains("dropbox.com") | h.endswith("dropboxusercontent.com") | h.contains("list-manage.com")


def is_plan_page(u: Column) -> Column:
    """A page or fragment about a floor plan that is not yet a file."""
    p = F.lower(path(u))
    named = matches(F.concat_ws(" ", p, F.lower(query(u))), r"floor[\s_-]*plan|floorplan")
    return ~u.contains("/api/download/") & named & ~p.rlike(r"\.(pdf|png|jpg|jpeg|webp|gif|jpx)$")


def is_script_viewer(u: Column) -> Column:
    return hostname(u).rlike(r"canva\.com|canva\.link|pitch\.com")


def is_viewer(u: Column) -> Column:
    """A document or viewer where a plan's picture should be."""
    shell = is_hosted_document(u) | F.lower(path(u)).endswith(".pdf") | F.lower(query(u)).contains("export=download") | is_script_viewer(u)
    return (F.coalesce(u, F.lit("")) != "") & ~u.contains("/api/download/") & (is_plan_page(u) | shell)


def is_document_seed(u: Column) -> Column:
    """A document or page that a photo field may link to, but that is no photo."""
    page = scheme(u).isin("http", "https") & ~is_image_like(u)
    return (F.coalesce(u, F.lit("")) != "") & ~u.contains("/api/download/") & (is_hosted_document(u) | F.lower(path(u)).endswith(".pdf") | page)


def must_leave_photos(u: Column) -> Column:
    """Document seeds, but for finished gallery pages."""
    return is_document_seed(u) & ~F.lower(path(u)).endswith(".html")


def direct_document(u: Column) -> Column:
    """Whether the address itself gives a document."""
    h, q = hostname(u), F.lower(query(u))
    shared = (h.endswith("drive.usercontent.google.com") & q.contains("export=download")) | ((h.contains("dropbox.com") | h.endswith("dropboxusercontent.com")) & q.contains("dl=1"))
    return scheme(u).isin("http", "https") & ~is_script_viewer(u) & (F.lower(path(u)).endswith(".pdf") | shared)


#: Address blocks that are not public (fixed values).
PRIVATE_BLOCKS = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4".split()


def is_public(u: Column) -> Column:
    """Neither a local name nor a literal address outside the public blocks."""

    def in_blocks(n: Column) -> Column:
        inside = F.lit(False)
        for block in PRIVATE_BLOCKS:
            base, bits = block.split("/")
            first = sum(int(x) << 8 * (3 - i) for i, x in enumerate(base.split(".")))
            inside = inside | n.between(first, first + (1 << 32 - int(bits)) - 1)
        return F.coalesce(inside, F.lit(False))

    def judge(h: Column) -> Column:
        four = [F.regexp_extract(h, r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$", i).try_cast("long") for i in (1, 2, 3, 4)]
        n = four[0] * (1 << 24) + four[1] * (1 << 16) + four[2] * 256 + four[3]
        return (h != "") & (h != "localhost") & ~h.endswith(".local") & ~let(n, in_blocks)

    def outer(h: Column) -> Column:
        six = F.regexp_extract(h, r"^\[([^\]]*)\]", 1)
        local_six = six.rlike(r"^(::1?$|f[cd]|fe[89ab]|2001:db8:|::ffff:)")
        return let(F.regexp_replace(h, r":[0-9]*$", ""), judge) & ~((six != "") & local_six)

    return let(F.regexp_replace(host(u), r"^.*@", ""), outer)


def url_problem(u: Column, forbid_images: bool = False) -> Column:
    """What is wrong with an address in a field, else null; an empty field has no problem."""
    out = F.when(u == "", F.lit(None).cast("string")).when(~is_address(u), F.lit("not an address")).when(~is_public(u), F.lit("not public"))
    return out.when(is_image_like(u), F.lit("image in a document field")) if forbid_images else out


def direct_download(u: Column) -> Column:
    """Links to viewers of file shares as links to the files."""
    drive = F.regexp_extract(path(u), r"/file/d/([\w-]+)", 1)
    box = F.regexp_extract(path(u), r"/s/([A-Za-z0-9]+)", 1)
    others = F.filter(F.split(query(u), "&"), lambda kv: (kv != "") & (_name(kv) != "dl"))
    dropbox = F.concat(scheme(u), F.lit("://"), host(u), path(u), F.lit("?"), F.array_join(F.concat(others, F.array(F.lit("dl=1"))), "&"))
    return (
        F.when(hostname(u).isin("drive.google.com", "docs.google.com") & (drive != ""), F.concat(F.lit("https://drive.usercontent.google.com/download?id="), drive, F.lit("&export=download")))
        .when(_is_box(hostname(u)) & (box != ""), F.concat(F.lit("https://app.box.com/shared/static/"), box, F.lit(".pdf")))
        .when(hostname(u).contains("dropbox.com") | hostname(u).endswith("dropboxusercontent.com"), dropbox)
        .otherwise(u)
    )


def tour_link(u: Column) -> Column:
    """A tour behind a viewer that asks for a login as the same tour where it is public."""
    shown = F.regexp_extract(F.trim(u), r"(?i)^https?://viewings\.ehouse\.co\.uk/#/matterport/show/([A-Za-z0-9]+)/?$", 1)
    return F.when(shown != "", F.concat(F.lit("https://my.matterport.com/show/?m="), shown)).otherwise(u)


def document_rank(u: Column) -> Column:
    """3 a document itself, 2 a viewer that leads to one, 1 another page, 0 none or a viewer by script."""
    x = F.trim(F.coalesce(u, F.lit("")))
    return F.when(~scheme(x).isin("http", "https") | is_script_viewer(x), 0).when(direct_document(x), 3).when(direct_document(direct_download(x)), 2).otherwise(1)


def resource_type(payload: Column, content_type: Column) -> Column:
    """By leading bytes, then by the stated type."""
    head = F.hex(F.substring(payload, 1, 4))
    out = F.lit("unknown")
    for word, kind in (("html", "html"), ("image/", "image"), ("pdf", "pdf")):
        out = F.when(F.lower(F.coalesce(content_type, F.lit(""))).contains(word), F.lit(kind)).otherwise(out)
    for magic, kind in MAGIC:
        out = F.when(head.startswith(magic), F.lit(kind)).otherwise(out)
    return out


def asset_class(url: Column, anchor: Column, alt: Column, width: Column, height: Column, occurrences: Column, association: Column, mime: Column | None = None, around: Column | None = None) -> Column:
    """struct(class, confidence): a cascade of branches over names, sizes, repetition and place; the first that fits wins. A side that is not
    known is null."""
    mime, around = F.lower(F.coalesce(F.lit("") if mime is None else mime, F.lit(""))), F.lit("") if around is None else around
    p, near = path(url), F.coalesce(association, F.lit(0.0))
    file = F.regexp_extract(p, "([^/]*)$", 1)
    t = F.concat_ws(" ", file, anchor, alt, around)
    is_ = lambda kind: matches(t, ABOUT[kind])
    ends = lambda endings: F.lower(file).rlike(rf"\.({'|'.join(endings)})$")
    image = ends(IMAGE_ENDINGS) | mime.startswith("image/") | matches(p, IMAGE_PATHS)
    sides = lambda least: F.coalesce((width < least[0]) | (height < least[1]), F.lit(False))
    document = ends(DOCUMENT_ENDINGS) | (mime == "application/pdf")
    named = matches(F.concat_ws(" ", alt, anchor, file), ABOUT["property"])
    branches = [
        (sides((9, 9)) & width.isNotNull() & height.isNotNull(), "tracking", 1.0),
        (is_("decorative"), "decorative", 0.98),
        (is_("logo"), "logo", 0.98),
        (is_("preview"), "preview", 0.94),
        (is_("map"), "map", 0.92),
        (is_("floorplan"), "floorplan", 0.95),
        (is_("brochure") & ~ends(IMAGE_ENDINGS), "brochure", 0.95),
        (document & is_("brochure"), "brochure", 0.84),
        (document, "unknown", 0.2),
        (~image, "unknown", 0.0),
        (F.coalesce(occurrences > 1, F.lit(False)) & (near < 0.8) & ~named, "decorative", 0.9),
        (sides((320, 200)) & width.isNotNull() & height.isNotNull(), "decorative", 0.86),
        (is_("property") | (near >= 0.8), "photo", 0.82),
        ((near >= 0.55) & matches(p, IMAGE_PATHS), "photo", 0.75),
    ]
    out = F.struct(F.lit("unknown").alias("class"), F.lit(0.25).alias("confidence"))
    for cond, name, confidence in reversed(branches):
        out = F.when(cond, F.struct(F.lit(name).alias("class"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out


def tracker_target(u: Column) -> Column:
    """The address that a click tracker's query hides, encoded up to four times, as a plain value or in JSON under `url` or `href`; else empty."""
    q = query(u)
    for _ in range(4):
        q = F.coalesce(F.try_url_decode(q), q)
    plain = F.regexp_extract(q, r"(?i)(?:^|[=&])(https?://[^\s\"'&<>\\]+)", 1)
    inside = F.coalesce(*[F.get_json_object(F.regexp_extract(q, r"(\{.*\})", 1), f"$.{k}") for k in ("url", "href")], F.lit(""))
    return F.when(inside.rlike("^https?://"), inside).otherwise(plain)


def promoted(current: Column, new: Column) -> Column:
    """The better of two addresses for a document field; the present one on ties."""
    return F.when(document_rank(new) > document_rank(F.coalesce(current, F.lit(""))), new).otherwise(F.coalesce(current, F.lit("")))
