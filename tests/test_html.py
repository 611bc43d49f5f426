from pyspark.sql import functions as F

from siteweave.functions import html as H

LONG = "a sentence that is certainly longer than forty characters"


def test_title(values):
    def run(page):
        return values(lambda h: H.page_title(H.visible(h), F.lit("Listed")), page)[0]

    assert run("<body><h1 class='x'> Karnak <b>Temple</b>&amp; more </h1><h1>b</h1>") == "Karnak Temple& more"
    assert run('<div class="big pageTitle x">First</div><h1>Second</h1>') == "First"
    assert run("<h2>no heading</h2>") == "Listed"
    assert run("<h1></h1>") == ""
    assert run("<script>'<h1>no</h1>'</script><!-- <h1>no</h1> --><h1>yes</h1>") == "yes"


def test_paragraphs(values):
    page = (
        f"<style>p{{}}</style><p>short</p><P class='x'>{LONG}&nbsp;<br/>next &lt;line&gt;</p>text outside<p>{LONG} Read More</p>"
        f"<p><b>{LONG}<br><p>{LONG} 2<div>block</div><pre>no</pre><p>{LONG} &copy;pyright"
    )
    got = values(lambda h: H.content_paragraphs(H.visible(h)), page)[0]
    assert got == [f"{LONG} \nnext <line>", LONG, f"{LONG} 2", f"{LONG} ©pyright"]
    assert values(lambda h: H.description(H.visible(h)), "<p>none</p>") == [""]


def test_extended_filter(values):
    page = f"<p>{LONG} ministry of</p><p>{LONG} back to</p><p>{LONG}</p>"
    assert values(lambda h: H.extended_paragraphs(H.visible(h)), page) == [[LONG]]


def test_arabic_heading(values):
    assert values(lambda h: H.arabic_heading(h), "<h1> معبد الكرنك </h1>", "<h1>Temple</h1>", "<p>معبد</p>") == ["معبد الكرنك", "", ""]


def test_images(values):
    page = (
        '<img src="outside.png"><article><img src="a.jpg"><img alt="x" src=\'b.jpg\'><img src="LOGO.png"><img src="a.jpg"></article>'
        '<img src="after.png"><section><div class="photo gallery"><img src="c.jpg"></div></section><div class="slider"><img src="d.jpg"><img src="e.jpg">'
    )
    def run(first):
        return values(lambda h: H.images(h, F.lit(first)), page)[0]

    assert run("logo-first.png") == ["logo-first.png", "a.jpg", "b.jpg", "c.jpg", "d.jpg"]
    assert run("b.jpg") == ["b.jpg", "a.jpg", "c.jpg", "d.jpg", "e.jpg"]
    assert run("") == ["a.jpg", "b.jpg", "c.jpg", "d.jpg", "e.jpg"]


def test_cards(values):
    page = (
        '<a href="/menu">m</a><a class="x listItem" title="Karnak &amp; co" href="https://s/en/monuments/1"><div class="location"><span></span><p> Luxor </p></div>'
        '<div class="details"><p>Big <i>site</i></p><p>second</p></div><img src="k.jpg"></a><a class="listItem" title="no address"></a>'
        "<a class=\"listItem\" href='https://s/en/museums/2'>bare</a><a class=\"listItems\" href=\"z\">other class</a>"
    )
    got = values(H.listing_cards, page)[0]
    assert got == [
        {"href": "https://s/en/monuments/1", "title": "Karnak & co", "location": "Luxor", "description": "Big site", "image": "k.jpg"},
        {"href": "https://s/en/museums/2", "title": "", "location": "", "description": "", "image": ""},
    ]
