"""URL filters against SQL, a plain loop, colliding digests and the join for large rule tables."""

import pytest

from quireloom.llm import queries, url_filter

URLS = [
    "https://www.example.com/en/7/x?q#f", "http://EXAMPLE.com/en/8", "https://a.example.net/de/8", "https://example.net/de/9", "https://x.org/es/", "https://x.org/es",
    "https://notexample.com/en/7", "ftp://com/en/", "no scheme", "", None, "://", "https://", "https://h?x=://y/en/", "https://com.", "https://.com/en/", "a://b://com/en/1", "https://example.com/en/7" + "x" * 100_000,
]


def by_loop(url, rules, otherwise="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, otherwise))
    return host, path, best[2], best[3]


def frame(spark, urls=URLS):
    return spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")


def rows(df):
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()}


def test_query_against_sql(same):
    same("op4_url_filter", queries.QUERIES["op4_url_filter"], queries.ORACLE["op4_url_filter"])


@pytest.mark.parametrize("rules", [queries.URL_RULES, [("com", "", "block"), ("example.com", "", "allow"), ("example.com", "/en/7", "block")], []])
def test_against_a_loop(spark, rules):
    table = spark.createDataFrame(rules, url_filter.RULE_SCHEMA)
    want = {i: by_loop(u, rules) for i, u in enumerate(URLS)}
    assert rows(url_filter.judge(frame(spark), table)) == want


def test_large_rule_tables_go_by_join(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_RULES", 2)
    table = spark.createDataFrame(queries.URL_RULES, url_filter.RULE_SCHEMA)
    got = url_filter.judge(frame(spark).union(frame(spark)), table)
    assert got.count() == 2 * len(URLS)
    assert rows(got) == {i: by_loop(u, queries.URL_RULES) for i, u in enumerate(URLS)}


def test_contradicting_rules_on_both_ways(spark, monkeypatch):
    rules = [("com", "/en/", "block"), ("com", "/en/", "allow"), ("org", "/es/", "allow"), ("org", "/es/", "block")]
    want = {i: by_loop(u, rules) for i, u in enumerate(URLS)}
    for most in (url_filter.MOST_RULES, 1):
        monkeypatch.setattr(url_filter, "MOST_RULES", most)
        for given in (rules, rules[::-1]):
            assert rows(url_filter.judge(frame(spark), spark.createDataFrame(given, url_filter.RULE_SCHEMA))) == want


def test_rules_without_a_verdict_on_both_ways(spark, monkeypatch):
    rules = [("com", "/en/", None), ("com", "/en/", "block"), ("org", "/es/", None), ("net", "", None)]
    known = [("com", "/en/", "block"), ("org", "/es/", "allow"), ("net", "", "allow")]
    want = {i: by_loop(u, known) for i, u in enumerate(URLS)}
    for most in (url_filter.MOST_RULES, 1):
        monkeypatch.setattr(url_filter, "MOST_RULES", most)
        for given in (rules, rules[::-1]):
            assert rows(url_filter.judge(frame(spark), spark.createDataFrame(given, url_filter.RULE_SCHEMA))) == want


def test_colliding_digests(monkeypatch, tmp_path):
    """With one digest for everything the stored strings decide."""
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda *a: 7)
    (tmp_path / "i").write_bytes(url_filter.pack(queries.URL_RULES))
    index = url_filter.DigestArray(str(tmp_path / "i"))
    for u in URLS:
        host, path, rule, verdict = by_loop(u, queries.URL_RULES)
        assert index.match([host], [path]) == [(rule, verdict) if rule else None]


def test_equal_strings_of_different_rules(spark):
    """``a/`` + ``b`` and ``a`` + ``/b`` are one string but not one rule."""
    rules = [("a", "/b", "block"), ("a/", "b", "allow")]
    table = spark.createDataFrame(rules, url_filter.RULE_SCHEMA)
    assert rows(url_filter.judge(frame(spark, ["x://a/b"]), table)) == {0: ("a", "/b", "a/b", "block")}


def test_edges(spark):
    df = spark.createDataFrame([(1, "https://x.com/en/", "mine"), (1, "https://x.com/en/", "mine"), (None, None, None)], "page_id long, url string, Rule string")
    rules = spark.createDataFrame([*queries.URL_RULES, (None, "/", "block"), ("com", None, None)], url_filter.RULE_SCHEMA)
    got = url_filter.judge(df, rules)
    assert sorted(c.lower() for c in got.columns) == ["host", "page_id", "path", "rule", "url", "verdict"]
    assert sorted((r["page_id"] or 0, r["rule"]) for r in got.collect()) == [(0, None), (1, "com/en/"), (1, "com/en/")]
    assert url_filter.judge(df.limit(0), rules).count() == 0
