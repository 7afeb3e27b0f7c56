"""Deep paths in the tree of URL templates."""

from quern.llm import url_filter


def test_branches_below_six_segments(spark):
    up = "http://h.org/one/two/three/four/five/six/seven"
    pages = [(i, f"{up}/{('spam', 'news', 'blog', 'shop')[i % 4]}/{i * 7}.html") for i in range(400)]
    pages += [(1000 + i, f"http://deep.org/{'ab'[i % 2]}/" + "x/" * 300) for i in range(4)]
    labels = [(i, 0 if i % 4 == 0 else 1, 0) for i in range(400)]
    pages, labels = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {x.page_id: x for x in url_filter.url_filter(pages, labels, rules=()).collect()}
    path = up.split("h.org")[1]
    assert {(out[i].template, out[i].verdict) for i in range(0, 400, 4)} == {(f"{path}/spam/*.html", "block")}
    assert {(out[i].template, out[i].verdict) for i in range(400) if i % 4} == {(f"{path}/*/*.html", "allow")}
    assert {out[1000 + i].template for i in range(4)} == {"/*/" + "x/" * 300}
