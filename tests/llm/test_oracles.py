"""The oracles on tables with nulls, repeats, ties, links and very long rows, where the given tables have none."""

import duckdb
import numpy as np
import pytest

from factorspark.llm import catalog, url_filter
from test_operators import words

LINK, REFRESH = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{at}/{name}.parquet")

    put("pages", [
        (1, "http://x.net/p", LINK.format("https://c.com/de/9")), (2, "http://x.net/q", REFRESH.format("/p") + LINK.format("http://x.net/elsewhere")),
        (3, "http://x.net/elsewhere#top", ""), (4, "HTTP://Y.net/a/b?c=1", LINK.format("r")), (5, "http://y.net/a/r", LINK.format("//ok.org/z")), (6, "http://y.net/blocked", LINK.format("http://b.com/de/1")),
        (7, "http://y.net/blocked", None), (8, None, LINK.format("http://b.com/de/1")), (9, "no url", REFRESH.format("http://b.com/de/1")), (10, "://?", ""), (11, "http://example.org/en/1/2", ""),
        (11, "http://example.org/en/1/2", ""), (12, "http://sub.example.org/es/1", LINK.format("http://x.net/p")), (None, "http://com/fr/", ""), (13, "http://z.net/&", "<p>canonical</p>"),
    ], "page_id long, url string, html string")
    leak, short = words(900, 20), "vier kurze Worte hier"
    docs = [(k, words(k, 40)) for k in range(20)] + [(20, words(50, 10) + " " + leak + " x"), (21, "a " + short.upper() + " b"), (22, "vier kurze Worte"), (None, None), (None, leak), (None, leak + " z"), (23, ""),
                                                     (24, "ü€😀 " * 5000), (25, leak.replace(leak.split()[3], "zz")), (-7, "t"), (-7, "u"), (2**62, "t"), (20, words(50, 10) + " " + leak + " x")]
    put("documents", [(i, t, "en", "a", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    put("benchmark", [(1, leak), (2, short), (3, None), (4, "?!"), (5, words(901, 9))], "item_id long, text string")
    r = np.random.default_rng(1)
    put("embeddings", [(k, [float(np.float32(x)) for x in r.standard_normal(6)]) for k in range(60)] + [(20, [1.0] * 6), (3, [1.0] * 6), (100, None), (120, [0.0] * 6), (140, [1.0, None]), (160, [2.0])], "vec_id long, embedding array<float>")
    return at


@pytest.mark.parametrize("name", ["op2_url_filter", "op4_substrings", "op5_decontaminate", "op6_nearest", "op8_sharding"])
def test_query_equals_oracle(spark, folder, name):
    got = catalog.queries()[name](spark, folder)
    cols = sorted(got.columns)
    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())


def test_long_rule_lists(spark, folder):
    """A table of rules does what testing rule by rule does, ties included."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    r = np.random.default_rng(2)
    hosts, heads = ["net", "x.net", "org", "example.org", "com", "b.com", "y.net", "NET"], ["/", "/p", "/a", "/a/b", "/en/1", "/es/", "", "/de/", "/q"]
    rules = [(str(r.choice(["allow", "block"])), str(r.choice(hosts) + r.choice(heads))) for _ in range(url_filter.FEW_RULES + 60)]
    rows = pages.select("url", url_filter.host(pages["url"]).alias("host"), url_filter.path(pages["url"]).alias("path")).distinct()
    by_table = {x["url"]: x["_m"] for x in url_filter.with_rules(rows, rules).collect()}
    one_by_one = rows.select("url", url_filter.matched_rule(rows["host"], rows["path"], rules).alias("_m")).collect()
    assert {x["url"]: x["_m"] for x in one_by_one} == by_table and any(by_table.values())
    tie = [("allow", "com/xyq"), ("block", "b.com/x")]
    both = rows.selectExpr("'u' AS url", "'b.com' AS host", "'/xyq' AS path").limit(1)
    assert both.select(url_filter.matched_rule(both["host"], both["path"], tie)["verdict"]).first()[0] == "allow"
    assert url_filter.with_rules(both, tie * 40).select("_m.verdict").first()[0] == "allow"
