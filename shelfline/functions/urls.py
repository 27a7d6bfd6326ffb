"""URL predicates and page-body classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path parts of product pages, and of pages to pass over.
PRODUCT_PARTS = ["/producto/", "/product/"]
SKIPPED_PARTS = [
    "/categoria/", "/category/", "/tag/", "/etiqueta/",
    "/page/", "/cart/", "/checkout/", "/my-account/",
    "/shop/", "/tienda/", "/wp-", "/feed", ".xml",
    "/author/", "/autor/", "/blog/", "/noticias/",
]
# Texts that only appear on bot-challenge pages.
CHALLENGE_MARKERS = [
    "challenges.cloudflare.com",
    "cf-browser-verification",
    "__cf_chl_f_tk",
    "jschl-answer",
]


def contains_any(text: Column, parts: list[str]) -> Column:
    """Any literal part occurs in the text (an OR of plain substring tests)."""
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def is_product_url(
    url: Column, allow: list[str] | None = None, deny: list[str] | None = None
) -> Column:
    """Lower-cased URL has an allowed part and no denied part; the deny list wins."""
    lowered = F.lower(url)
    allowed = contains_any(lowered, PRODUCT_PARTS if allow is None else allow)
    denied = contains_any(lowered, SKIPPED_PARTS if deny is None else deny)
    return ~denied & allowed


def is_challenge_page(html: Column) -> Column:
    return contains_any(html, CHALLENGE_MARKERS)


def is_disambiguated(url: Column) -> Column:
    """The slug ends in a number that tells apart products of the same name."""
    return url.rlike("-[0-9]+/$")


def comparable_url(url: Column) -> Column:
    """Lower case without one trailing slash."""
    return F.regexp_replace(F.lower(url), "/$", "")


# Status codes with a meaning of their own, and texts that tell a kind of body.
STATUS_OUTCOMES = {0: "no_response", 403: "forbidden", 429: "throttled", 503: "unavailable"}
BODY_MARKERS = {
    "challenge": ["Just a moment", "cf-browser-verification"],
    "script_wall": ["Enable JavaScript", "enable javascript"],
    "denied": ["Access denied", "access denied"],
    "product": ["product_title", "woocommerce", "add to cart"],
}


def body_markers(body: Column) -> Column:
    """Struct of booleans: which kinds of marker text a body holds."""
    return F.struct(*[contains_any(body, texts).alias(kind) for kind, texts in BODY_MARKERS.items()])


def fetch_outcome(status: Column, body: Column) -> Column:
    """Outcome code of a fetch: the status where that says it, else the kind of body, else known or unknown status."""
    by_status = F.create_map(*[F.lit(x) for pair in STATUS_OUTCOMES.items() for x in pair])
    found = body_markers(body)
    by_body = F.coalesce(*[F.when(found[kind], F.lit(kind)) for kind in BODY_MARKERS])
    plain = F.when(status == 200, "unrecognized").otherwise(F.concat(F.lit("status_"), status))
    return F.coalesce(F.try_element_at(by_status, status), by_body, plain)
