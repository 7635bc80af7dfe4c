"""URL rules and host reputation against a plain version."""

import re
from collections import defaultdict

from conftest import SMALL

from hostwatch.llm import queries
from hostwatch.llm import url_reputation as U

RULES = [("com", "/", "allow"), ("b.com", "/x", "block"), ("b.com", "/x/y", "allow"), ("w.b.com", "/x", "allow"), ("w.b.com", "/x", "block"), ("org", "", "block")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):])[0]


def rule_of(host, path, rules):
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


def above(host):
    if re.fullmatch(r"[0-9.]*", host):
        return host, ""
    parts = host.split(".")
    n = 2 if ".".join(parts[-2:]) in U.TWO_LABEL_SUFFIXES else 1
    return ".".join(parts[-n - 1:]), ".".join(parts[-n:])


def strength(groups):
    groups = [g for g in groups if g[0]]
    more = sum(m * (1 - m) * (n - 1) for n, _, m in groups)
    c = (sum(n * (b / n - m) ** 2 for n, b, m in groups) - sum(m * (1 - m) for _, _, m in groups)) / more if more else 0
    return 1 / min(max(c, U.LEAST_CORRELATION), U.MOST_CORRELATION) - 1


def bounds(counts):
    """Lower bound by host from ``{host: (n, bad)}``."""
    domains, suffixes, over = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), {}
    for host, (n, b) in counts.items():
        domain, suffix = above(host)
        over[domain] = suffix
        for of in (domains[domain], suffixes[suffix]):
            of[0] += n
            of[1] += b
    total = sum(n for n, _ in counts.values())
    if not total:
        return {h: 0.0 for h in counts}
    root = sum(b for _, b in counts.values()) / total
    s = strength([(n, b, root) for n, b in suffixes.values()])
    suffix_share = {k: (b + s * root) / (n + s) for k, (n, b) in suffixes.items()}
    s = strength([(n, b, suffix_share[over[k]]) for k, (n, b) in domains.items()])
    domain_share = {k: (b + s * suffix_share[over[k]]) / (n + s) for k, (n, b) in domains.items()}
    s = strength([(n, b, domain_share[above(h)[0]]) for h, (n, b) in counts.items()])
    out = {}
    for h, (n, b) in counts.items():
        m = (b + s * domain_share[above(h)[0]]) / (n + s)
        out[h] = max(0.0, m - U.DEVIATIONS * (m * (1 - m) / (n + s + 1)) ** 0.5)
    return out


def plain(pages, labels, rules):
    quality = defaultdict(list)
    for d, q in labels:
        if q is not None:
            quality[d].append(q)
    counts = {split(url)[0]: [0, 0] for _, url in pages}
    for _, url in pages:
        host, path = split(url)
        number = re.search("/([0-9]{1,18})", path)
        for q in quality[int(number[1])] if number else []:
            counts[host][0] += 1
            counts[host][1] += q == 0
    bound, out = bounds(counts), []
    for i, url in pages:
        host, path = split(url)
        rule, verdict = rule_of(host, path, rules)
        out.append((i, host, path, rule, verdict or ("block" if bound[host] > U.LIMIT else "allow"), *counts[host], round(bound[host], 6)))
    return sorted(out, key=str)


def judged(spark, pages, labels, rules):
    pages = spark.createDataFrame([(*r, "", "", 1) for r in pages], "page_id long, url string, host string, rule string, n int").repartition(3)
    labels = spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, bad int")
    rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    return sorted(map(tuple, U.judge(pages, U.page_outcomes(pages, labels), rules).collect()), key=str)


def test_table(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality").collect()]
    got = sorted(map(tuple, queries.op11_url_filter(spark, SMALL).collect()), key=str)
    assert got == plain(pages, labels, queries.URL_RULES)


def test_bad_hosts_are_blocked_and_unknown_ones_stay(spark):
    """A host of bad pages, one of good pages beside it, a new host of a bad domain, and one that nothing is known of."""
    pages, labels, n = [], [], 0
    for host, good, bad, rest in (("a.bad.net", 0, 40, 3), ("ok.bad.net", 40, 0, 3), ("b.bad.net", 1, 30, 3), ("new.bad.net", 0, 0, 2), ("x.fine.net", 60, 1, 3),
                                  ("y.fine.net", 50, 2, 3), ("z.elsewhere.io", 0, 0, 2), ("few.fine.net", 0, 1, 1)):
        for k in range(good + bad + rest):
            pages.append((n, f"https://{host}/p/{n}?q=1"))
            if k < good + bad:
                labels.append((n, int(k < good)))
            n += 1
    got = judged(spark, pages, labels, RULES)
    assert got == plain(pages, labels, RULES)
    verdicts = {r[1]: r[4] for r in got}
    assert [h for h, v in verdicts.items() if v == "block"] and all(verdicts[h] == "block" for h in ("a.bad.net", "b.bad.net"))
    assert all(verdicts[h] == "allow" for h in ("ok.bad.net", "x.fine.net", "y.fine.net", "z.elsewhere.io"))


def test_odd_urls_rules_and_a_hot_host(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://A.B.COM/X", "x://b.com/x/y/z?a#b", "x://w.b.com/x", "x://b.com", "x://b.com?x=/x", "x://notb.com/x", "x://c.org",
            "x://c.org/5", "x://1.2.3.4/7", "x://a.co.uk/9", "x://co.uk/8", "x://h.net/12345678901234567890123", "x://h.net/é/10://c.com/1", "x://ÀB.net/", "x://h.net/" + "a" * 50000,
            "x://y..net/3", "a\nb://n.net/4"]
    pages = [(i, u) for i, u in enumerate(urls)] + [(None, "x://b.com/x"), (3, "x://b.com/x"), (3, "x://b.com/x")] + [(100 + i, f"x://hot.net/{i % 7}") for i in range(3000)]
    labels = [(i, i % 2) for i in range(12)] + [(5, 0), (5, None), (None, 1)]
    got = judged(spark, pages, labels, RULES)
    assert got == plain(pages, labels, RULES)
    assert judged(spark, pages, [], [])  == plain(pages, [], [])
    assert judged(spark, [], labels, RULES) == []
