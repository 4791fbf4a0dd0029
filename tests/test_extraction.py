"""Facts of hand-made pages."""

from pyspark.sql import functions as F

from marram.operators import extraction as X
from marram.operators.extraction import extract_listings
from marram.plans import queries

LISTING = """<html><head><link rel="canonical" href="https://www.nigeriapropertycentre.com/for-rent/short-let/lagos/ikeja/bright-3-bedroom-flat-1043552">
<meta property="og:title" content="Bright 3 Bedroom Flat &amp; Terrace"><title>Other | Site</title><script src="https://app.smoobu.com/w.js"></script>
<script type="application/ld+json">{broken</script><script type="application/ld+json">[{"@type":"Apartment","seller":{"name":"Bright Homes Ltd"}},{"@type":"House"}]</script></head>
<body><video src="a.mp4">x</video><h1>H1</h1><p>₦220,000 /day</p><p>3 Bedrooms, 2 Bathrooms</p><p>Certificate of Occupancy</p>
<a href="tel:+234 803 000 0000">call</a><a href="tel:+234 803 000 0000">again</a><a href="mailto:Stay@Brighthomes.ng?subject=x">mail</a>
<a href="https://facebook.com/x">fb</a><a href="https://brighthomes.ng/style.css">css</a><a href="https://brighthomes.ng/availability">free?</a><a href="https://instagram.com/brighthomes">ig</a>
<img src="/thumbs/1.jpg"><img src="https://cdn.example.com/1043552/a.jpg" srcset="https://cdn.example.com/1043552/s.jpg 320w, https://cdn.example.com/1043552/l.jpg 1280w">
<img data-src="//cdn.example.com/b.webp" width="800"><img src="p.gif" width="1" height="1"><img src="https://cdn.example.com/9999999/c.jpg"><img src="https://cdn.example.com/watermark/d.jpg"></body></html>"""
URL = "https://www.nigeriapropertycentre.com/for-rent/short-let/lagos/ikeja/other-name-7654321?x=1"


def test_whole_listing(spark):
    pages = [(1, URL, LISTING), (2, "https://www.nigeriapropertycentre.com/for-rent/short-let/lagos", LISTING.replace("1043552", "none")), (3, "https://elsewhere.com/x", LISTING), (4, URL, "<p>nameless</p>"), (5, URL, None), (6, None, LISTING)]
    rows = extract_listings(spark.createDataFrame(pages, "seq long, url string, html string")).collect()
    assert [r.seq for r in rows] == [1]
    r = rows[0]
    assert r.source_listing_id == "1043552" and r.source_url.endswith("-1043552")
    assert (r.property_name, r.property_type) == ("Bright 3 Bedroom Flat & Terrace", "APARTMENT")
    assert (r.bedrooms, r.bathrooms, r.advertised_price, r.price_basis) == (3, 2, 22_000_000, "PER_NIGHT")
    assert (r.state, r.city, r.area, r.title_document) == ("LA", "Lagos", "Ikeja", "C_OF_O")
    assert (r.operator_name, r.operator_hint) == ("Bright Homes Ltd", None)
    assert (r.phone, r.email, r.website, r.instagram) == ("+234 803 000 0000", "stay@brighthomes.ng", "https://brighthomes.ng/availability", "brighthomes")
    assert (r.pms_detected, r.availability_hint_url) == ("smoobu", "https://brighthomes.ng/availability")
    assert r.media == ["https://cdn.example.com/1043552/l.jpg", "https://cdn.example.com/b.webp"] and r.cover_image_url == r.media[0]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_no_python_in_the_plan(spark):
    plan = extract_listings(spark.createDataFrame([(1, URL, LISTING)], "seq long, url string, html string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_text_and_references(spark):
    assert value(spark, X.strip_tags(F.lit("<p>a &lt;b&gt; &#8358;5 &#x20AC; &amp;lt; caf&eacute;</p> &bogus;"))) == "a <b> ₦5 € &lt; café  &bogus;"
    assert value(spark, X.strip_media(F.lit('<picture><img src="a"></picture><VIDEO x>y</video><img src="data:image/png;base64,AAAA=">'))) == f'<img src="a"><img src="{X.MEDIA_MARK}">'


def test_prices(spark):
    for raw, want in (("₦220,000", 22_000_000), ("N999", None), ("NGN 20,000,001", None), ("none", None), (None, None)):
        assert value(spark, X.parse_price_to_kobo(F.lit(raw).cast("string"))) == want
    for text, want in (("per person per night", "PER_PERSON_NIGHT"), ("nightly", "PER_NIGHT"), ("/ day", "PER_NIGHT"), ("p.c.m.", "PER_MONTH"), ("per annum", "PER_YEAR"), ("for the stay", "PER_STAY"), ("later", None)):
        assert value(spark, X.price_basis(F.lit(text))) == want
    best = value(spark, X.best_price(F.lit("was ₦90,000 now ₦80,000 /night or ₦400,000 per week"), F.array().cast("array<string>")))
    assert (best.kobo, best.basis) == (8_000_000, "PER_NIGHT")
    offer = value(spark, X.best_price(F.lit("ask"), F.array(F.lit('{"price": 50000}'))))
    assert (offer.kobo, offer.basis) == (5_000_000, None)


def test_contacts(spark):
    assert value(spark, X.find_phones(F.lit('<a href="https://wa.me/2348030000000">'))) == ["2348030000000"]
    assert value(spark, X.find_instagram(F.lit("instagram.com/reel/1"))) is None
    assert value(spark, X.is_business_email(F.lit("a@own.ng"))) and not value(spark, X.is_business_email(F.lit("a@mail.gmail.com")))
    assert value(spark, X.operator_website(F.lit('<a href="https://www.propertypro.ng/x"><a href="https://own.ng/i.pdf">'))) is None
    assert value(spark, X.name_from_domain(F.lit("https://www.lekkihomes.com.ng/x"))) == "Lekkihomes"
    hint = value(spark, X.extract_operator(F.lit("<p>x</p>"), F.array().cast("array<string>"), F.lit("https://lekkihomes.com")))
    assert (hint.name, hint.confidence) == ("Lekkihomes", "low")
    block = value(spark, X.extract_operator(F.lit('<span class="agent-name">Agent</span><span class="agent-name">Prime &amp; Co</span>'), F.array().cast("array<string>"), F.lit(None).cast("string")))
    assert (block.name, block.confidence) == ("Prime & Co", "medium")


def test_images(spark):
    assert value(spark, X.srcset_largest(F.lit("a.jpg 1x, b.jpg 2x, c.jpg 1500w"))) == "b.jpg"
    assert value(spark, X.has_watermark(F.lit("https://x.com/jiji/a.jpg"))) and not value(spark, X.has_watermark(F.lit("https://x.com/jijia/a.jpg")))
    assert value(spark, X.is_hotlinkable(F.lit("https://x.com/p?url=a.jpg"))) and not value(spark, X.is_hotlinkable(F.lit("https://a.cloudinary.com/p?url=a.jpg")))
    assert value(spark, X.is_other_listing(F.lit("https://x.com/99999/a.jpg"), F.lit("12345"))) and not value(spark, X.is_other_listing(F.lit("https://x.com/99999/a.jpg"), F.lit("99999")))
    for url, want in (("//c.d/x.jpg", "https://c.d/x.jpg"), ("/r.jpg", "https://a.b/r.jpg"), ("./s.jpg", "https://a.b/p/s.jpg"), ("data:x", None), ("", None), ("?q", "https://a.b/p/q?q")):
        assert value(spark, X.absolute(F.lit(url), F.lit("https://a.b/p/q?z=1"))) == want


def test_places(spark):
    at = value(spark, X.location_from_address(F.array(F.lit('{"address": {"addressRegion": "Lekki", "addressLocality": "Lagos State"}}'))))
    assert (at.state, at.area) == ("LA", "Lekki")
    crumb = value(spark, X.location_from_breadcrumb(F.lit('<a href="/region,1">Lagos</a><a href="/region,2">Lekki</a><a href="/region,3">Lekki Phase 1</a>')))
    assert (crumb.city, crumb.area) == ("Lagos", "Lekki Phase 1")
    assert value(spark, X.clean_title(F.lit("Nice flat in Lekki (AB12CD) | Portal"))) == "Nice flat"


def _pages_of_headings(spark, monkeypatch, headings):
    rows = [(n, f"https://www.example.com/en/{n}", f"<html><title>x</title><h1>{h}</h1></html>") for n, h in enumerate(headings)]
    monkeypatch.setattr(queries, "table", lambda *_: spark.createDataFrame(rows, "page_id long, url string, html string"))


HEADINGS = ["a&amp;&amp", "a &amp;lt; b", "&lt;b&gt;&quot;", "&amp &lt x", "plain & all"]
NAMES = ["a&&amp", "a &lt; b", "<b>\"", "&amp &lt x", "plain & all"]


def test_page_names_leave_references_without_an_end(spark, monkeypatch):
    _pages_of_headings(spark, monkeypatch, HEADINGS)
    got = {r.page_id: r.name for r in queries.queries()["page_names"](spark, "").collect()}
    assert [got[n] for n in range(len(HEADINGS))] == NAMES
    assert [value(spark, X.unescape(F.lit(t), unclosed=False)) for t in ("&#65;&#65", "&#x41;&#x41", "&copy;&copy")] == ["A&#65", "A&#x41", "©&copy"]


def test_listings_of_the_query_leave_references_without_an_end(spark, monkeypatch):
    _pages_of_headings(spark, monkeypatch, HEADINGS)
    got = {r.seq: r.property_name for r in queries.queries()["extract_listings"](spark, "").collect()}
    assert [got[n] for n in range(len(HEADINGS))] == NAMES
