"""Link targets of pages in every form."""

from hazardframe.llm import urls


def test_forms_of_link_targets(spark):
    page = "http://H.org/d/e/p.html?old=1#f"
    canon = '<link rel="canonical" href="{}">'
    forms = {
        canon.format("//Other.org/x"): ["http://other.org/x"], canon.format("q.html"): ["http://h.org/d/e/q.html"],
        canon.format("../x?a=../b"): ["http://h.org/d/x?a=../b"], canon.format("../../../x/./y/.."): ["http://h.org/x/"],
        canon.format("?id=1"): ["http://h.org/d/e/p.html?id=1"], canon.format("#top"): [], canon.format("mailto:x@y"): [],
        canon.format("/r?u=http://z.org/"): ["http://h.org/r?u=http://z.org/"], canon.format(""): [], canon.format("."): ["http://h.org/d/e/"],
        canon.format("/a") + canon.format("/b"): ["http://h.org/a", "http://h.org/b"],
        "<LINK data-rel=x href='/n?a=1&amp;b=&#x32;&#51;&eacute;&sol;&no;' REL='nofollow Canonical'>": ["http://h.org/n?a=1&b=23\u00e9/&no;"],
        '<link title="a>b" rel=canonical href=/t>': ["http://h.org/t"], '<link rel="canonicals" href="/t">': [],
        '<link rel=stylesheet href="canonical.css">': [], '<base href="/c/d"><link rel=canonical href=e>': ["http://h.org/c/e"],
        """<meta content="0; URL='next.html'" http-equiv="Refresh"><meta http-equiv=refresh content=5;url=/last>""":
            ["http://h.org/d/e/next.html", "http://h.org/last"],
        '<meta http-equiv="refresh" content="30">': [], '<meta http-equiv="refresh" content="3; two">': ["http://h.org/d/e/two"],
    }
    rows = [(f"{page}#{i}".replace("old=1", f"old={i}"), h) for i, h in enumerate(forms)]
    found = urls.edges(spark.createDataFrame(rows, "url string, html string")).collect()
    got = {h: sorted(r.b for r in found if r.a == f"http://h.org/d/e/p.html?old={i}") for i, h in enumerate(forms)}
    assert got == forms
    bare = spark.createDataFrame([("http://h.org", canon.format("x")), ("nothing", canon.format("x")), (None, canon.format("x"))], "url string, html string")
    assert [tuple(r) for r in urls.edges(bare).collect()] == [("http://h.org", "http://h.org/x")]
