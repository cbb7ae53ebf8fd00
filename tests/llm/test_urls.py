"""URL filters against brute force."""

import itertools
import re

import pytest
from pyspark.sql import functions as F
from test_operators import LOWER

from tidewatch.llm import urls


@pytest.mark.parametrize("limit, lengths", [(32 << 20, urls.LENGTHS), (0, urls.LENGTHS), (0, 2), (32 << 20, 0)])
def test_urls(spark, limit, lengths):
    rules = [*urls.RULES, ("a.b", "/x", "block"), ("a.b", "/x", "allow"), ("b", "/", "allow"), (None, "/", "block")]
    hosts = ["example.com", "www.example.com", "EXAMPLE.com", "badexample.com", "x.net", "net", "a.b", "q.a.b", "b", "", "com."]
    all_urls = [f"http://{h}{p}" for h, p in itertools.product(hosts, ["", "/", "/en/", "/en", "/es/1?q", "/fr/#a", "/x", "/xyz", "?a=://b", "/en/?://x"])] + [None, "", "no scheme", "://", "x://y://z/"]
    df = spark.createDataFrame(list(enumerate(all_urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urls.judge_urls(df, urls.rule_table(spark, rules), broadcast_limit=limit, lengths_limit=lengths).collect()}
    assert len(got) == len(all_urls)
    for i, u in enumerate(all_urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fit = [(len(h) + len(p), len(h), h, p, v == "block") for h, p, v in rules if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        want = (host, path, best and best[2] + best[3], "allow" if not best or not best[4] else "block")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == want, u
    assert urls.judge_urls(df.limit(0), urls.rule_table(spark)).count() == 0
    assert urls.judge_urls(df, urls.rule_table(spark).limit(0)).filter("verdict = 'allow'").count() == len(all_urls)
