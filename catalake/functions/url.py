"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound


def drop_query(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", "")


def normalize_base(url: Column) -> Column:
    """Without hash, page parameter and trailing /page/N/; the path ends in a slash. Anything but an http URL stays as it is."""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike("^page(=|$)")), "&")
    path = F.regexp_replace(F.regexp_replace(u, r"\?.*$", ""), "/page/[0-9]+/?$", "/")
    slashed = F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))
    return F.when(u.rlike("^https?://[^/]"), F.concat(slashed, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))).otherwise(url)


def page_by_path(base: Column, page: Column) -> Column:
    return F.when(page <= 1, base).otherwise(F.concat(F.regexp_replace(base, "/*$", "/"), F.lit("page/"), page.cast("string"), F.lit("/")))


def page_by_query(base: Column, page: Column, name: str = "page") -> Column:
    return F.when(page <= 1, base).otherwise(F.concat(base, F.when(F.contains(base, F.lit("?")), "&").otherwise("?"), F.lit(f"{name}="), page.cast("string")))


def page_by_parameter(base: Column, page: Column, name: str = "page") -> Column:
    """The base with the page as a parameter, the first page too: in the place of one of that name, else at the end."""
    url = normalize_base(base)
    entry = F.concat(F.lit(f"{name}="), F.greatest(page, F.lit(1)).cast("string"))
    given = F.filter(F.split(F.regexp_extract(url, r"\?(.*)$", 1), "&"), lambda q: q != "")

    def put(params: Column) -> Column:
        place = F.array_position(F.transform(params, lambda q: F.substring_index(q, "=", 1)), name)
        new = F.transform(params, lambda q, i: F.when(i + 1 == place, entry).when(F.substring_index(q, "=", 1) != name, q))
        return F.array_join(F.when(place > 0, F.filter(new, lambda q: q.isNotNull())).otherwise(F.array_append(params, entry)), "&")

    return F.concat(drop_query(url), F.lit("?"), bound(given, put))


def store_api(url: Column) -> Column:
    """The product API of a category page's host, newest first, with the page's stock and price filters. Fixed parts of the API's address."""
    def parameter(name: str) -> Column:
        return F.try_url_decode(F.regexp_extract(F.coalesce(url, F.lit("")), rf"[?&]{name}=([^&#]*)", 1))

    span = parameter("_sfm__regular_price")
    bounds = r"^\s*([0-9]+)\s*\+\s*([0-9]+)\s*$"
    prices = F.concat(F.lit("&min_price="), F.regexp_extract(span, bounds, 1), F.lit("&max_price="), F.regexp_extract(span, bounds, 2))
    stock = F.when(parameter("_sfm__stock_status").rlike("(?i)instock"), "&stock_status=instock").otherwise("")
    return F.concat(F.lit("https://"), F.regexp_replace(F.lower(host(url)), ":[0-9]+$", ""), F.lit("/wp-json/wc/store/v1/products?order=desc&orderby=date"), stock, F.when(span.rlike(bounds), prices).otherwise(""))  # a plain + is a space by now, and no span


def page_number(url: Column) -> Column:
    """The page parameter of a URL as a number, else 1."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"[?&]page=([0-9]{1,9})", 1), F.lit("")).try_cast("int"), F.lit(1))


def host(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def resolve(url: Column, base: Column) -> Column:
    """A relative URL against its page: by scheme, by host, or by folder."""
    return bound(F.trim(F.coalesce(url, F.lit(""))), lambda u: _resolve(u, F.coalesce(base, F.lit(""))))


def _resolve(url: Column, base: Column) -> Column:
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(drop_query(base), r"^(.*/)[^/]*$", 1)
    rest = F.regexp_replace(url, r"^\./", "")
    return (
        F.when(url == "", "").when(url.rlike("(?i)^https?://"), url).when(url.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z]+:)", 1), url))
        .when(url.startswith("/"), F.concat(origin, url)).when(folder.rlike("://[^/]+/"), F.concat(folder, rest)).otherwise(F.concat(origin, F.lit("/"), rest))
    )


def encode(text: Column) -> Column:
    """Percent encoding with %20 for a space."""
    return F.replace(F.url_encode(F.coalesce(text, F.lit(""))), F.lit("+"), F.lit("%20"))
