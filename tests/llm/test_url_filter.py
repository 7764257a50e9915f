from itertools import combinations

from hoploom.llm import url_filter as u


def brute(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]
    fit = [(len(r), r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


URLS = [
    None, "", "example.com/en/7", "http://A.Example.COM/en/7x?q=1#f", "https://com/en/", "https://xcom/en/", "http://example.com/en/8", "ftp://example.net/de/8", "http://www.example.net/de/7",
    "http://a.org/es/", "http://a.org/es", "http://a.org?x=/es/", "http://a.org#/es/", "http://É.org/ES/", "://h/p", "a://b://c/d", "http://host\n/p\nq?z", "http://example.com/en/7" + "x" * 5000,
]


def test_fixed_rules_against_brute_force(spark):
    pages = spark.createDataFrame([(i, x, "h") for i, x in enumerate(URLS)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r.page_id: r for r in u.judge_urls(pages, labels).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, rule, verdict = brute(url, u.RULES)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), url


def test_mined_rules_against_brute_force(spark):
    urls = [f"http://{h}.example.com/{p}/{k}" for k in range(12) for h in ("good", "pills") for p in ("a", "buy")]
    rows = [(i, url) for i, url in enumerate(urls)]
    bad = {i: ("pills" in url and "buy" in url) for i, url in rows}
    pages = spark.createDataFrame([*rows, (900, "http://pills.example.com/buy/77"), (901, "http://pills.example.com/a/77"), (902, None)], "page_id long, url string")
    labels = spark.createDataFrame([*bad.items(), (0, False), (None, True), (3, None)], "page_id long, bad boolean")
    got = {r.page_id: r for r in u.judge_urls(pages, labels, min_support=0.05, min_rows=2, min_confidence=0.7, min_lift=1.2, min_z=0).collect()}
    assert all(got[i].verdict == ("block" if bad[i] else "allow") for i in bad)
    assert got[900].verdict == "block" and got[901].verdict == "allow" and got[902].verdict == "allow"
    # The minimal rules by trying all token sets.
    token = {r.page_id: r.tokens for r in pages.select("page_id", u.tokens_of(pages.url).alias("tokens")).collect()}
    kept = {}
    for n in range(1, 6):
        for combo in {c for i in bad for c in combinations(token[i], n)}:
            holds = [i for i in bad if set(combo) <= set(token[i])]
            hits = sum(bad[i] for i in holds)
            confidence = hits / len(holds)
            if hits / len(bad) >= 0.05 and confidence >= 0.7 and confidence / (sum(bad.values()) / len(bad)) >= 1.2:
                if not any(set(k) < set(combo) and c >= confidence for k, c in kept.items()):
                    kept[combo] = confidence
    labelled = spark.createDataFrame([(token[i], b) for i, b in bad.items()], "tokens array<string>, bad boolean")
    mined = u.mine_rules(labelled, min_support=0.05, min_rows=2, min_confidence=0.7, min_lift=1.2, min_z=0)
    assert {tuple(r.tokens) for r in mined.collect()} == set(kept)
    assert u.judge_urls(pages.limit(0), labels).count() == 0


def test_rules_of_long_urls_against_brute_force(spark):
    """The path decides and comes after more than twelve host labels and query keys; key1 and key2 always occur together."""
    keys = "&".join(f"key{j}=1" for j in range(1, 12))
    urls = [f"http://{h}.example.com/{p}/x{'?' + keys if k % 2 else '?key1=1&key2=1' if k % 3 else ''}" for k in range(12) for h in ("one", "two") for p in ("read", "spam")]
    bad = ["spam" in url and ("key1" in url or "one" in url) for url in urls]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    token = {r.page_id: r.tokens for r in pages.select("page_id", u.tokens_of(pages.url).alias("tokens")).collect()}
    assert max(map(len, token.values())) > 12
    kept, rows = {}, [(set(token[i]), bad[i]) for i in range(len(urls))]
    for n in range(1, 5):  # all supersets of four tokens hold a smaller rule of confidence 1
        for combo in {c for i in token for c in combinations(token[i], n)}:
            holds = [b for t, b in rows if t.issuperset(combo)]
            confidence = sum(holds) / len(holds)
            if sum(holds) / len(rows) >= 0.05 and confidence >= 0.6 and confidence / (sum(bad) / len(bad)) >= 1.2:
                if not any(set(k) < set(combo) and c >= confidence for k, c in kept.items()):
                    kept[combo] = confidence
    labelled = spark.createDataFrame([(token[i], b) for i, b in enumerate(bad)], "tokens array<string>, bad boolean")
    mined = {tuple(r.tokens): r.confidence for r in u.mine_rules(labelled, min_support=0.05, min_rows=2, min_confidence=0.6, min_lift=1.2, min_z=0).collect()}
    assert mined.keys() == kept.keys() and all(abs(mined[k] - kept[k]) < 1e-9 for k in kept)
    assert ("key:key1", "path:spam") in mined and ("key:key2", "path:spam") in mined
    labels = spark.createDataFrame(list(enumerate(bad)), "page_id long, bad boolean")
    got = u.judge_urls(pages, labels, rules=(), min_support=0.05, min_rows=2, min_confidence=0.95, min_lift=1.2, min_z=0)
    assert {r.page_id: r.verdict == "block" for r in got.collect()} == dict(enumerate(bad))


def test_mined_rules_decide_with_the_production_parameters(spark):
    """Labels that depend on the URL: pages without a fixed rule are blocked by the mined ones, new URLs too."""
    urls = [f"https://{h}.example.com/{lang}/{k}?{q}=1" for k in range(12) for h in ("www", "cheap-pills", "blog", "m", "shop", "news") for lang in ("en", "fr", "it", "pt") for q in ("page", "ref")]
    bad = ["cheap-pills" in url and "/fr/" in url or k % 41 == 0 for k, url in enumerate(urls)]
    pages = spark.createDataFrame([*enumerate(urls), (5000, "http://cheap-pills.example.org/fr/99"), (5001, "http://cheap-pills.example.org/en/99"), (5002, "http://x.com/en/cheap-pills/fr")], "page_id long, url string")
    labels = spark.createDataFrame([(k, b) for k, b in enumerate(bad) if k % 2], "page_id long, bad boolean")
    got = {r.page_id: r for r in u.judge_urls(pages, labels).collect()}
    pills = [k for k, url in enumerate(urls) if "cheap-pills" in url and "/fr/" in url]
    assert all(got[k].verdict == "block" and got[k].rule is None and got[k].mined_rule for k in [*pills, 5000])
    assert [got[k].verdict for k in (5001, 5002)] == ["allow", "block"] and got[5002].rule == "com/en/"
    others = [k for k, url in enumerate(urls) if "cheap-pills" not in url]
    assert not any(got[k].mined_rule for k in others)
