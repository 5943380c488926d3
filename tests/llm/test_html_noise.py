"""Words for noise on or around the main text, or on its sections, do not lose it."""
from chronorank.llm import html_extract

LONG = "This is the story of the page, told at some length so that it is most of the text."
PAGES = {
    1: f"<body><form><nav><a href='/'>Home</a></nav><article><p>{LONG}</p></article></form><footer>Imprint</footer></body>",
    2: f"<body><nav><a href='/'>Home</a></nav><article class='post category-navigation'><p>{LONG}</p></article></body>",
    3: f"<body><div class='entry social'><p>{LONG}</p><div class='share'>Send it</div></div><div class='ad'>Buy</div></body>",
    4: f"<body><article><p>{LONG}</p><h2 id='share-price'>Price</h2><section id='related-work'><p>Others</p></section><div class='navy'>Blue</div><div class='related'>More</div></article></body>",
    5: "<body><form><p>Only this</p></form></body>",
    6: f"<body><div class='box'><p>{LONG}</p></div><div class='sidebar'>Aside</div></body>",
}
WANT = {1: LONG, 2: LONG, 3: LONG, 4: f"{LONG}\nPrice\nOthers\nBlue", 5: "Only this", 6: LONG}


def test_noise(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.org/x", h) for i, h in PAGES.items()], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == WANT


def test_host(spark):
    """The host's path finds a text that its own page marks as noise and that is not the bulk of it."""
    page = lambda c: f"<body><div class='main{c}'><p>{LONG}</p></div></body>"
    odd = f"<body><div class='promo'><div class='main'><p>Short text</p></div></div><div><p>{LONG}</p></div></body>"
    rows = [(i, "http://h.org/x", page("").replace("<div class='main'>", "<div class='promo'><div class='main'>").replace("</div></body>", "</div></div></body>")) for i in range(3)] + [(3, "http://h.org/y", odd)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: LONG, 1: LONG, 2: LONG, 3: "Short text"}
