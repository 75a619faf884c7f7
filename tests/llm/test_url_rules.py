import random

from compare import connect, difference

from tiermill.llm.queries import CHECKS, URL_RULES, op4_url_rules
from tiermill.llm.url_rules import judge, rule_table


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), path


def plain(url, rules):
    host, path = parts(url)
    fits = [
        (len(h + p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def test_whole_table(spark, folder):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = op4_url_rules(spark, folder).collect()
    assert len(got) == len(pages)
    assert {r.page_id: tuple(r)[1:] for r in got} == {k: plain(u, URL_RULES) for k, u in pages.items()}


def test_whole_table_against_sql(spark, folder):
    assert difference(op4_url_rules(spark, folder), connect(folder), CHECKS["op4_url_rules"]) == ""


def test_random_nested_rules_over_many_ranges(spark):
    draw = random.Random(3)
    labels, tops = ["a", "b", "ab", "a-b", "c"], ["com", "net", "co"]
    host = lambda most: ".".join([draw.choice(labels) for _ in range(draw.randrange(most))] + [draw.choice(tops)])
    path = lambda: "/" + "".join(draw.choice(["x/", "y", "xy/", ""]) for _ in range(draw.randrange(4)))
    rules = [("", "/y", "block")] + [(host(4), path(), draw.choice(["allow", "block"])) for _ in range(150)]
    urls = [f"http://{host(5).upper()}{path()}{draw.choice(['', '?q=/x', '#y'])}" for _ in range(1500)]
    urls += ["http://a.com/x/"] * 700 + [None, "", "no scheme", "http://", "x://?a", "http://A.com", "http://a..com/y"] * 2
    rows = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(rows, rule_table(spark, rules)).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_repeated_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([("http://a.com/", 1)] * 3 + [(None, None)], "url string, rule int")
    rules = rule_table(spark, [("com", "/", "block")])
    assert sorted(r.verdict for r in judge(rows, rules).collect()) == ["allow", "block", "block", "block"]
    assert judge(rows.where("false"), rules).collect() == []
    assert {r.verdict for r in judge(rows, rules.where("false")).collect()} == {"allow"}
