import json

import datetime as dt

import pytest

from shelfline.operators.extract import extract_products, page_text
from shelfline.schemas import PAGES

NOW = dt.datetime(2024, 1, 1)


def page(body, head="", body_class="single-product"):
    return f'<!DOCTYPE html><html><head>{head}</head><body class="{body_class}">{body}</body></html>'


def summary(price, extra=""):
    return f'<div class="product"><div class="summary entry-summary"><h1 class="product_title">Ryzen 5</h1>{price}{extra}</div></div>'


REGULAR = '<p class="price"><span class="woocommerce-Price-amount amount"><bdi>₡&nbsp;39.900</bdi></span></p>'
SALE = (
    '<p class="price"><del><span class="amount">$ 50.00</span></del> '
    '<ins><span class="woocommerce-Price-amount amount">$ 45.50</span></ins></p>'
)


@pytest.fixture(scope="module")
def read(spark):
    def go(html, status=200):
        rows = [("u", html, status, NOW, 0, "run-1")]
        return extract_products(spark.createDataFrame(rows, PAGES)).first()

    return go


def test_standard_page(read):
    related = '<section class="related"><ul><li class="product"><span class="price"><span class="amount">$ 1</span></span></li></ul></section>'
    meta = '<span class="sku"> CPU1 </span><span class="posted_in">Cat: <a>CPU</a>, <a>x</a></span>'
    gallery = '<div class="woocommerce-product-gallery__image"><a><img data-src="b.jpg"></a></div>'
    short = '<div class="woocommerce-product-details__short-description"><p>Uno<p>dos</div>'
    row = read(page(gallery + summary(REGULAR, meta + short) + related))
    assert row["is_product"] and row["name"] == "Ryzen 5" and row["price"] == 39900.0
    assert row["currency"] == "CRC" and row["original_price"] is None and row["price_debug"] is None
    assert row["sku"] == "CPU1" and row["category"] == "CPU" and row["image_url"] == "b.jpg"
    assert row["description"] == "Unodos" and row["html_debug"] is None and not row["is_available"]


def test_sale_and_badge(read):
    row = read(page('<span class="onsale">-9%</span>' + summary(SALE, "<button class='single_add_to_cart_button'>x</button>")))
    assert (row["price"], row["original_price"], row["currency"]) == (45.5, 50.0, "USD")
    assert row["discount_percentage"] == 9 and row["is_available"]


def test_theme_price_widget_and_unrelated_prices(read):
    other = '<div class="related"><p class="price"><ins><span class="amount">$ 1</span></ins></p></div>'
    widget = '<div class="wd-single-price"><p class="price"><span class="amount">€ 7,50</span></p></div>'
    row = read(page('<div class="product">' + other + widget + "</div>"))
    assert (row["price"], row["currency"]) == (7.5, "EUR")


def test_no_price_is_diagnosed(read):
    row = read(page(summary('<p class="price">Consultar\n  ya</p>'), "<title> T </title>"))
    assert row["is_product"] and row["price"] is None and row["price_debug"] == "no price element on the page"
    assert json.loads(row["html_debug"]) == {
        "title": "T",
        "has_summary": True,
        "price_markup": "Consultar ya",
        "body_excerpt": "Ryzen 5Consultar ya",
    }
    unreadable = read(page(summary('<p class="price"><span class="amount">Gratis</span></p>')))
    assert "Gratis" in unreadable["price_debug"]


def test_empty_records(read):
    challenge = read('<html><script src="https://challenges.cloudflare.com/x"></script></html>')
    assert challenge["is_challenge"] and not challenge["is_product"] and challenge["name"] is None
    missing = read(page(summary(REGULAR)), 404)
    assert not missing["is_product"] and missing["status_code"] == 404 and missing["price"] is None
    failed = read(None, 0)
    assert not failed["is_product"] and not failed["is_challenge"]
    assert not read("<html><body><h1>Hola</h1></body></html>")["is_product"]


def test_kinds_of_product_pages(read):
    for html in (
        page("", body_class="woocommerce-page"),
        '<div itemtype="https://schema.org/Product">x</div>',
        '<p class="pro&#100;uct">x</p>',
    ):
        assert read(html)["is_product"]
    assert not read(page('<a href="/producto/x" class="product-link">product</a>', body_class="home"))["is_product"]


def stock(row):
    return [tuple(s) for s in row["stock_locations"]]


def test_stock_boxes(read):
    def box(name, status, words):
        return f'<div class="store-item"><b class="store-name">{name}</b><span class="status {status}"><i class="status-text">{words}</i></span></div>'

    html = box(" Alajuela ", "status-limited", "Quedan 2") + box("Heredia", "status-out", "") + box("", "status-available", "") + box("X", "", "?")
    row = read(page(summary(REGULAR, html)))
    assert stock(row) == [("Alajuela", 2), ("Heredia", 0)] and row["is_available"]


def test_stock_tables_and_lists(read):
    table = '<table class="wc-stock-locations"><tr><th>Tienda<th>Hay<tr><td>Central<td>3 unidades<tr><td>Norte<td>no</table>'
    listed = '<ul class="stock-locations"><li>Sur: 0 en stock<li>Este: 4</ul>'
    assert stock(read(page(summary(REGULAR, listed + table)))) == [("Central", 3)]
    row = read(page(summary(REGULAR, listed)))
    assert stock(row) == [("Sur", 0), ("Este", 4)]
    shop_table = '<table class="shop_table stock"><tr><td>A</td><td>1</td></tr></table>'
    assert stock(read(page(summary(REGULAR, shop_table)))) == [("A", 1)]
    assert stock(read(page(summary(REGULAR, '<p class="stock in-stock">Hay</p>')))) == []


def test_availability_markers(read):
    assert read(page(summary(REGULAR, '<p class="stock in-stock">Hay</p>')))["is_available"]
    both = '<p class="stock out-of-stock">No</p><button class="single_add_to_cart_button">x</button>'
    assert not read(page(summary(REGULAR, both)))["is_available"]


def test_published_date_sources(read):
    day, other = dt.date(2023, 6, 15), dt.date(2022, 1, 2)
    meta = '<meta property="article:published_time" content="2023-06-15T10:30:00+00:00">'
    bad_meta = '<meta property="article:published_time" content="soon">'
    linked = '<script type="application/ld+json">{"datePublished":"2022-01-02"}</script>'
    micro = '<meta itemprop="datePublished" content="2022-01-02">'
    stamp = '<time class="entry-date" datetime="2023-06-15">x</time>'
    heads = [
        (meta + linked, "", day), (bad_meta + linked, "", None), (linked + micro, stamp, other),
        (micro, stamp, other), ("", stamp, day), ("", "", None),
    ]
    for head, body, expected in heads:
        assert read(page(summary(REGULAR, body), head))["published_date"] == expected


def test_text_of_any_page(spark):
    rows = spark.createDataFrame([(1, "<title>A &amp; B</title><h1> x <b>y</b></h1>"), (2, "plain")], "i int, html string")
    got = page_text(rows, {"title": "title", "heading": "h1"}).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, "A & B", "x y"), (2, None, None)]
