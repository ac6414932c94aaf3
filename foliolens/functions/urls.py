"""Scalar functions over links, file names and listing pages."""

from pyspark.sql import Column, functions as F

from foliolens.functions.html import hrefs as html_hrefs

# Extensions that may be served.
ALLOWED_EXTENSIONS = [".html", ".json", ".pdf", ".css", ".js", ".png", ".jpg", ".ico"]

# Link patterns, each used only where the ones before found nothing.
# Group 1 is the link.
LINK_PATTERNS = [
    r'href="([^"]*\.pdf[^"]*)"',
    r'<a[^>]+href="([^"]*\.pdf[^"]*)"',
    r'(https?://[^"\s]+\.pdf)',
    r'(/sites/[^"\s]+\.pdf)',
]


def drop_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; '' for none and for leading-dot names."""
    return F.lower(F.regexp_extract(drop_query(path), r"[^./][^/]*?(\.[^./]*)\z", 1))


def allowed_ext(path: Column, allowed: list[str] = ALLOWED_EXTENSIONS) -> Column:
    ext = extension(path)
    return (ext == "") | ext.isin(list(allowed))


def hrefs(html: str, contains: str = ".pdf", ignore_case: bool = False) -> Column:
    """Targets of the anchors of a column of pages whose href contains a text."""
    found = F.expr(html_hrefs(html))
    if ignore_case:
        return F.filter(found, lambda h: F.lower(h).contains(contains.lower()))
    return F.filter(found, lambda h: h.contains(contains))


def links_by_patterns(html: Column, patterns: list[str] = LINK_PATTERNS) -> Column:
    """Links of the first pattern that finds any."""
    none = F.array().cast("array<string>")
    tries = [F.nullif(F.regexp_extract_all(html, F.lit(p), F.lit(1)), none) for p in patterns]
    return F.coalesce(*tries, none)


def resolve_url(link: Column, base: Column) -> Column:
    """Absolute form of a link found on page ``base`` (dot segments stay as they are)."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*/(?:.*/)?)", 1)
    folder = F.when(folder == "", F.concat(host, F.lit("/"))).otherwise(folder)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link == "", base)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(host, link))
        .when(link.startswith("?"), F.concat(page, link))
        .when(link.startswith("#"), F.concat(F.substring_index(base, "#", 1), link))
        .otherwise(F.concat(folder, link))
    )


def url_filename(url: Column) -> Column:
    return F.substring_index(drop_query(url), "/", -1)


def decode_filename(name: Column) -> Column:
    """Undo the percent forms of space and parentheses, and no others."""
    for code, char in (("%20", " "), ("%28", "("), ("%29", ")")):
        name = F.replace(name, F.lit(code), F.lit(char))
    return name


def page_number(url: Column) -> Column:
    """The number of a ``page=`` parameter; null where there is none."""
    return F.nullif(F.regexp_extract(url, r"[?&]page=(\d+)", 1), F.lit("")).try_cast("int")


def listing_url(base: Column, page_num: Column) -> Column:
    """URL of one listing page; page 0 is the base itself."""
    return F.when(page_num > 0, F.concat(base, F.lit("?page="), page_num.cast("string"))).otherwise(base)


def dataset_name(dataset: Column) -> Column:
    return F.concat(F.lit("data-set-"), dataset.cast("string"))


def dataset_url(dataset: Column, source: str) -> Column:
    return F.concat(F.lit(source + "/data-set-"), dataset.cast("string"), F.lit("-files"))
