from molspark.llm import url_filter
from molspark.llm.url_filter import Rule
from pyspark.sql import functions as F

RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]


def expected_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    after = rest[cut:]
    end = min((after.find(c) for c in "?#" if c in after), default=len(after))
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    return lowered, after[:end]


def expected_rule(host, path):
    fitting = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fitting, key=lambda r: len(r.text), default=None)


URLS = [
    "http://a.example.net/en/1", "https://example.net/en/", "http://example.net/en", "http://EXAMPLE.NET/de/x", "http://notexample.net/en/",
    "http://x.example.com/de/9?page=1", "http://example.com/en/9", "http://org/fr/1", "http://a.org/fr/2#top", "http://a.org/FR/2", "http://net",
    "http://net?x=1", "http://myorg/fr/1", "ftp://a.b.net/?q", "no scheme/net/", "", None, "://", "http://", "http://a://b.net/x", "http://É.net/ü",
    "http://a.example.net:80/en/", "http://" + "long." * 3000 + "net/en/",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, verdict string")
    rows = {r["page_id"]: r for r in url_filter.judge(pages, RULES).collect()}
    assert len(rows) == len(URLS) + 3
    for i, url in enumerate(URLS + URLS[:3]):
        host, path = expected_split(url)
        rule = expected_rule(host, path)
        assert (rows[i]["host"], rows[i]["path"]) == (host, path), url
        assert rows[i]["rule"] == (rule.text if rule else None), url
        assert rows[i]["verdict"] == rule.verdict if rule else rows[i]["verdict"] in ("allow", "block")


def test_empty_table_and_no_decided_urls(spark):
    schema = "page_id long, url string"
    assert url_filter.judge(spark.createDataFrame([], schema), RULES).count() == 0
    rows = url_filter.judge(spark.createDataFrame([(1, "http://a.com/x"), (2, None)], schema), RULES).collect()
    assert [(r["rule"], r["verdict"], r["score"]) for r in rows] == [(None, "allow", 0.0)] * 2


def test_model_equals_plain_python(spark):
    """Counts, back-off, smoothing and score worked out again without Spark."""
    size, order = url_filter.SIZE, url_filter.ORDER
    accepted, rejected = ["http://good.org/fr/12", "http://nice.org/fr/7"], ["http://bad.net/casino", "http://bad.net/bets/99"]
    codes = lambda u: [url_filter.SYMBOLS.find("0" if c in "0123456789" else c) + 1 for c in u.lower()]

    def counts(urls):
        tables = [{} for _ in range(order + 1)]
        for u in urls:
            padded = [0] * (order - 1) + codes(u)
            for end in range(order, len(padded) + 1):
                for n in range(1, order + 1):
                    gram = tuple(padded[end - n : end])
                    tables[n][gram] = tables[n].get(gram, 0) + 1
        return tables

    both = counts(accepted), counts(rejected)

    def probability(table, gram):
        if not gram:
            return 1.0 / size
        n = len(gram)
        seen = {g: c for g, c in table[n].items() if g[:-1] == gram[:-1]}
        total, kinds = sum(seen.values()), len(seen)
        weight = kinds if total else 1
        return (seen.get(gram, 0) + weight * probability(table, gram[1:])) / (total + weight)

    import math

    def score(url):
        padded, total = [0] * (order - 1) + codes(url), 0.0
        for end in range(order, len(padded) + 1):
            for n in range(order, 0, -1):
                gram = tuple(padded[end - n : end])
                if any(gram in t[n] for t in both):
                    total += math.log(probability(both[0], gram)) - math.log(probability(both[1], gram))
                    break
        return total / len(codes(url))

    labelled = spark.createDataFrame([(u, True) for u in accepted] + [(u, False) for u in rejected], "url string, accepted boolean")
    scorer = url_filter.fit_scorer(labelled.select(url_filter.symbols(F.col("url")).alias("codes"), "accepted"))
    asked = ["http://good.org/x", "http://bad.net/9", "ftp://%%/É"]
    frame = spark.createDataFrame([(u,) for u in asked], "url string").select("url", url_filter.symbols(F.col("url")).alias("codes"))
    got = {r["url"]: r["s"] for r in frame.select("url", scorer(F.col("codes")).alias("s")).collect()}
    for url in asked:
        assert abs(got[url] - score(url)) < 1e-3


def test_calibration_takes_the_best_cut(spark):
    rows = [(s / 10, s >= 3) for s in range(-10, 11)]
    threshold = url_filter.calibrate(spark.createDataFrame(rows, "score double, accepted boolean"))
    assert 0.2 < threshold <= 0.3
