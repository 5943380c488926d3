"""Every page against a direct cut of its article."""
import html
import re

from chronorank.llm import html_extract

SF = "/root/testdata/sf0.001"


def brute(h):
    a = re.search(r"(?s)<article>(.*?)</article>", h)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", a)]
    return "\n".join(x for x in parts if x)


def test_html(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: brute(r.html) for r in pages.collect()}
    got = html_extract.extract(pages).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None), (2, "http://a.b/c", "<div class='ad'>x</div><p>A &lt; b<script>q</script>  c")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(odd).collect()} == {1: "", 2: "A < b c"}
    assert html_extract.extract(odd.limit(0)).count() == 0
