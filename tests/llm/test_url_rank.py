import pytest

from eventframe.llm import url_filter


def test_rank_goes_on_until_it_is_close(spark):
    chain = [(f"h{i}", f"h{i + 1}", 1) for i in range(30)]
    edges = spark.createDataFrame(chain, "src string, dst string, n long")
    seeds = spark.createDataFrame([("h0", 1.0)], "host string, weight double")
    got = {r.host: r.score for r in url_filter.pagerank(edges, seeds, close=1e-3).collect()}
    assert got["h25"] == pytest.approx(got["h24"] * 0.85, rel=1e-6) and got["h25"] > 0
    with pytest.raises(ValueError):
        url_filter.pagerank(edges, seeds, close=0.0)  # never reached
