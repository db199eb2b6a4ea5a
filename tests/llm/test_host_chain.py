"""Trust and distrust reach hosts at any distance."""

from vellumine.llm import url_filter


def test_distrust_passes_a_chain_of_more_than_20_hosts(spark):
    edges = spark.createDataFrame([(f"h{i + 1}", f"h{i}", 1) for i in range(24)], "src string, dst string, links bigint")
    seeds = spark.createDataFrame([("h0", 0, 1)], "host string, allowed bigint, blocked bigint")
    got = {x.host: x.distrust for x in url_filter.host_scores(edges, seeds).collect()}
    assert len(got) == 25 and all(abs(got[f"h{i}"] - 0.15 * 0.85**i) < 1e-12 for i in range(25))


def test_little_distrust_blocks_nobody(spark):
    """A chain of links to a blocked host: 0.85 ** 28 is the last power of at least 0.01."""
    link = lambda i: f'<a href="https://h{i}.example.org/x">y</a>' if i >= 0 else ""
    pages = [(i, f"http://h{i}.example.org/{'es/' if i == 0 else ''}", link(i - 1)) for i in range(36)]
    judged = {x.page_id: x for x in url_filter.judge_urls(spark.createDataFrame(pages, "page_id bigint, url string, html string"), [("block", "org", "/es/")]).collect()}
    assert {i: x.verdict for i, x in judged.items()} == {i: "block" if i <= 28 else "allow" for i in range(36)}
    assert judged[35].distrust > 0
    every = url_filter.judge_urls(spark.createDataFrame(pages, "page_id bigint, url string, html string"), [("block", "org", "/es/")], least=0.0).collect()
    assert {x.verdict for x in every} == {"block"}
