"""Links decide where no rule and no tie does; public suffixes tie nothing."""

from versemill.llm import url_filter

def judged(spark, rows, **options):
    return {r.host: r for r in url_filter.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), **options).collect()}


def verdicts(spark, rows, **options):
    return {host: r.verdict for host, r in judged(spark, rows, **options).items()}


def link(*urls):
    return "".join(f'<a href="{u}">x</a>' for u in urls)


def test_hosts_under_a_public_suffix_are_not_tied(spark):
    hosts = spark.createDataFrame([("a.co.uk",), ("b.co.uk",), ("me.github.io",), ("you.github.io",), ("w.shop.co.uk",), ("x.y.example.com",), ("10.0.0.1",)], "host string")
    ties = {(r.src, r.dst) for r in url_filter.domain_ties(hosts).collect()}
    assert ties == {("w.shop.co.uk", "shop.co.uk"), ("x.y.example.com", "y.example.com"), ("y.example.com", "example.com")}
    assert ("a.co.uk", "co.uk") in {(r.src, r.dst) for r in url_filter.domain_ties(hosts, ()).collect()}
    rows = [(1, "http://a.co.uk/x", ""), (2, "http://b.co.uk/", "")]
    assert verdicts(spark, rows, rules=(("block", "a.co.uk", "/x"),)) == {"a.co.uk": "block", "b.co.uk": "allow"}


def test_links_alone_decide(spark):
    """A host that links to what is blocked is blocked, one that what is allowed links to is not; without the link both are allowed."""
    rows = lambda html: [(1, "http://bad.net/", ""), (2, "http://sly.test.io/", html), (3, "http://fine.test.de/", ""), (4, "http://python.org/fr/", link("http://fine.test.de/"))]
    with_link = verdicts(spark, rows(link("http://bad.net/", "http://bad.net/2")), tie_weight=0)
    assert with_link["bad.net"] == "block" and with_link["sly.test.io"] == "block" and with_link["fine.test.de"] == "allow"
    assert verdicts(spark, rows(""), tie_weight=0)["sly.test.io"] == "allow"


def test_ties_weigh_what_is_asked(spark):
    rows = [(1, "http://sub.shop.net/x", ""), (2, "http://shop.info/", link("http://sub.shop.net/x")), (3, "http://www.shop.info/", "")]
    apart, tied, strong = (judged(spark, rows, tie_weight=w) for w in (0, 1, 9))
    assert apart["shop.info"].verdict == "block" and apart["www.shop.info"].host_distrust == 0
    spread = [x["www.shop.info"].host_distrust for x in (tied, strong)]
    assert min(spread) > 0 and spread[0] != spread[1]
