"""URL rules against a plain version; trees against their own columns and held-out labels."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lumenfold.llm import trees, url_filter
from lumenfold.llm.common import table

URLS = [None, "", "no scheme", "http://NET", "http://net/", "http://a.NET/x?y#z", "https://example.net/en/1", "http://www.example.net/en", "http://xexample.net/en/", "http://b.example.com/de/?q=1", "http://example.com/DE/", "http://q.org/fr/x", "http://q.org/fr", "http://q.org?/fr/", "http://q.org#/fr/", "a://b://net/", "http://É.org/fr/é", "x\nhttp://a.org/fr/\nz", "http://cheap-pills.example.org/en/1", "http://" + "a" * 5000 + "/fr/" + "b" * 90_000]


def plain(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] or [len(rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([i for i in (rest.find(c) for c in "?#") if i >= 0] or [len(rest)])]
    best = None
    for verdict, rule in url_filter.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best


def test_rules(spark):
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS)] + [(0, None, "h", "r")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string, rule string")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, best = plain(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
        assert r["verdict"] == best[0] if best else r["verdict"] in ("allow", "block")


def test_whole_table_and_hosts_not_seen(spark, sf):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = url_filter.judge(pages).collect()
    assert Counter(r["page_id"] for r in got) == Counter(r["page_id"] for r in pages.select("page_id").collect())
    # Trees that saw the rules' verdicts on three quarters of the hosts give those of the rest.
    ruled = url_filter.with_parts(table(spark, "/root/testdata/sf0.1", "pages")).withColumn("r", url_filter.rule_column()).where("r is not null").withColumn("label", F.expr("int(r.verdict = 'block')"))
    seen = F.crc32(F.encode("host", "utf-8")) % 4 != 0
    judged = url_filter.judge(ruled.where(~seen).select("page_id", "url"), labelled=ruled.where(seen).select("url", "label"), rules=[])
    rows = judged.join(ruled.select("page_id", "label"), "page_id").collect()
    right = np.mean([(r["verdict"] == "block") == r["label"] for r in rows])
    most = max(np.mean([r["label"] for r in rows]), 1 - np.mean([r["label"] for r in rows]))
    assert len(rows) > 100 and right > 0.95 > most, (right, most, len(rows))


def plain_folder(path):
    m = re.match("/([^/]*)/", path)
    return m[1] if m else ""


def plain_features(url, suffix_share, folder_share):
    host, path, _ = plain(url)
    url = url or ""
    query = re.search(r"\?([^#]*)", url)
    query = query[1] if query else ""
    n, labels = max(len(host), 1), host.split(".")
    bits = -sum(k / len(host) * math.log2(k / len(host)) for k in Counter(host).values()) if host else 0.0
    count = lambda chars, text: sum(c in chars for c in text)
    digits, upper = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return dict(
        f_len=len(url), f_host_len=len(host), f_path_len=len(path), f_depth=len(re.findall("/[^/]", path)), f_labels=len(labels), f_digits=count(digits, url) / max(len(url), 1), f_host_digits=count(digits, host) / n,
        f_hyphens=host.count("-"), f_entropy=bits, f_params=count("&;", query) + 1 if query else 0, f_query_len=len(query), f_upper=count(upper, url), f_longest_label=max(map(len, labels)), f_suffix_len=len(labels[-1]),
        f_suffix_rate=math.log(suffix_share[labels[-1]]), f_folder_len=len(plain_folder(path)), f_folder_rate=math.log(folder_share[plain_folder(path)]), f_https=url.startswith("https:"), f_vowels=count("aeiou", host) / n,
    )


def test_score_equals_the_trees_on_plain_features(spark, monkeypatch):
    """Every verdict that no rule gives is the trees', worked out plainly from the text of the url."""
    fitted = []
    monkeypatch.setattr(url_filter, "boost", lambda x, y: fitted.append(trees.boost(x, y)) or fitted[-1])
    pages = table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url").unionByName(spark.createDataFrame([(10**6 + i, u) for i, u in enumerate(URLS)], "page_id long, url string"))
    got, rows = {r["page_id"]: r for r in url_filter.judge(pages).collect()}, pages.collect()
    suffixes = Counter(plain(r["url"])[0].split(".")[-1] for r in rows)
    folders = Counter(plain_folder(plain(r["url"])[1]) for r in rows)
    share = lambda c: {k: v / len(rows) for k, v in c.items()}
    made = [plain_features(r["url"], share(suffixes), share(folders)) for r in rows]
    margin = fitted[0].margin(np.array([[f[k] for k in url_filter.FEATURES] for f in made], float))
    assert fitted[0].trees
    for r, m in zip(rows, margin):
        mine = got[r["page_id"]]
        assert abs(mine["score"] - 1 / (1 + math.exp(-m))) < 1e-9
        if mine["rule"] is None:
            assert mine["verdict"] == ("block" if mine["score"] >= 0.5 else "allow")


def test_plan_has_no_python(spark, sf, capsys):
    url_filter.judge(table(spark, sf, "pages")).explain()
    assert not any(w in capsys.readouterr().out for w in ("Python", "Pandas", "Arrow"))


def test_entropy(spark):
    got = spark.createDataFrame([("aabb",), ("abcd",), ("",), ("aaa",)], "s string").select(url_filter._entropy(url_filter.F.col("s")).alias("e")).collect()
    assert [round(r["e"], 9) for r in got] == [1.0, 2.0, 0.0, 0.0]


def test_trees_learn_and_compile(spark):
    rng = np.random.default_rng(3)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = trees.boost(x[:1500], y[:1500])
    assert np.mean((model.margin(x[1500:]) > 0) == (y[1500:] > 0.5)) > 0.95
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], "a double, b double, c double")
    got = [r["m"] for r in df.select(trees.margin_column(model, ["a", "b", "c"]).alias("m")).collect()]
    assert np.allclose(got, model.margin(x[:50]))
    assert not trees.boost(x, np.ones(2000)).trees and math.isfinite(trees.boost(x[:0], y[:0]).bias)


def test_no_rows(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
