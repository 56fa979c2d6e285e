import duckdb
from tests.llm.conftest import clashing

from curata.llm import sql
from curata.llm.queries import URL_RULES, op2_url_filters
from curata.llm.url_graph import filter_urls, host_edges

A = '<a href="{}">x</a>'


def page(i, url, *links):
    return i, url, "<html>" + "".join(A.format(x) for x in links) + "</html>"


PAGES = [
    page(1, "http://good.com/a", "http://friend.org/x", "/local", "#top"),
    page(2, "https://friend.org/p?q", "//second.org/z"),
    page(3, "http://second.org/"),
    page(4, "http://bad.net/es/1"), page(5, "http://bad.net/fr/1?x"),
    page(6, "http://farm.org/1", "http://bad.net/es/1", "HTTP://BAD.net/en/2"),
    page(7, "http://linker.org/1", "http://farm.org/1"),
    page(8, "http://bad.net/en/2"),
    page(9, "http://nowhere.org/1"),
    page(10, None), page(11, "no scheme"), (12, "http://NullHtml.COM/x", None), page(13, "http://x.com"), page(14, "://a.example.com/en/q#f"),
    page(15, "http://www.example.com/en/1"), page(16, "http://b.www.example.com/en"), page(17, "http://notexample.com/en/"), page(18, "http://example.com:80/en/"),
    page(1, "http://good.com/a", "http://friend.org/x"),
]


def test_verdicts(spark):
    df = clashing(spark.createDataFrame(PAGES, "page_id long, url string, html string"), "host", "path", "rule", "verdict", "blocked", "src", "kind")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(df, URL_RULES).collect()}
    assert got[1] == ("good.com", "/a", "com/", "allow")
    assert got[2][2:] == (None, "allow") and got[3][3] == "allow"
    assert got[4][2:] == ("net/es/", "block") and got[8][2:] == (None, "block")
    assert got[6][3] == "allow"  # its own page outweighs distrust that came over a link
    assert got[10] == ("", "", None, "allow") and got[11] == ("", "", None, "allow")
    assert got[12][:3] == ("nullhtml.com", "/x", "com/") and got[13] == ("x.com", "", None, "allow")
    assert got[14] == ("a.example.com", "/en/q", "example.com/en/", "block")
    assert got[15][2:] == ("www.example.com/en/", "allow") and got[16][2] == "com/" and got[17][2] == "com/" and got[18][2] is None


def test_distrust_reaches_who_links_to_blocked_hosts(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in filter_urls(df, URL_RULES, threshold=0.2).collect()}
    assert got[6] == got[7] == "block" and got[2] == got[9] == "allow"


def test_what_the_registered_threshold_blocks(spark):
    """Who alone links to two blocked hosts is blocked; who links to one, or
    shares its targets with others, is not (README, link graph)."""
    bad = [page(i, f"http://bad{i}.net/es/1") for i in range(4)]
    pages = [*bad, page(10, "http://both.org/1", bad[0][1], bad[1][1]), page(11, "http://one.org/1", bad[2][1]),
             *(page(20 + i, f"http://farm{i}.org/1", bad[3][1]) for i in range(5))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in filter_urls(df, URL_RULES).collect()}
    assert got[10] == "block" and got[11] == "allow" and {got[20 + i] for i in range(5)} == {"allow"}


def test_edges(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {(r["src"], r["dst"]): r["links"] for r in host_edges(df).collect()}
    assert got == {("good.com", "friend.org"): 2, ("friend.org", "second.org"): 1, ("farm.org", "bad.net"): 2, ("linker.org", "farm.org"): 1}


def test_same_as_sql(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = op2_url_filters(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(sql.url_filters(URL_RULES)).df()[list(got.columns)]
    key = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(want)


def test_empty_table(spark):
    assert filter_urls(spark.createDataFrame([], "page_id long, url string, html string"), URL_RULES).collect() == []


def test_native(spark):
    plan = filter_urls(spark.createDataFrame(PAGES, "page_id long, url string, html string"), URL_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
