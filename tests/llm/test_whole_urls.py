"""Far hosts, large tables and links without a scheme."""

from tomolake.llm import urlfilter

RULES = [("block", "bad.com/"), ("block", "seed.com/")]


def page(k, host, *links):
    return (k, f"http://{host}/", "".join(f"<a href='{x}'>x</a>" for x in links))


def verdicts(spark, pages, **walk):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r.host: r.verdict for r in urlfilter.judge(df, RULES, urlfilter.Walk(**walk)).collect()}


def test_a_chain_of_hosts_is_walked_to_its_end(spark):
    chain = [page(k, f"h{k}.net", f"http://h{k - 1}.net/" if k else "http://bad.com/") for k in range(20)]
    got = verdicts(spark, [*chain, page(99, "bad.com")])
    assert all(got[f"h{k}.net"] == "block" for k in range(20))


def test_the_floor_does_not_depend_on_the_table(spark):
    near = [page(1, "bad.com"), page(2, "near.net", "http://bad.com/")]
    assert verdicts(spark, near, floor=1e-2)["near.net"] == "block"
    assert verdicts(spark, near + [page(10 + k, "seed.com") for k in range(500)], floor=1e-2)["near.net"] == "block"


def test_links_without_a_scheme(spark):
    got = verdicts(spark, [page(1, "bad.com"), page(2, "near.net", "//BAD.com/x"), page(3, "far.net", "/a//bad.com")])
    assert (got["near.net"], got["far.net"]) == ("block", "allow")
