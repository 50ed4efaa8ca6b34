import random
import re
import time

from tidemark.llm import urlfilter
from tidemark.llm.scratch import Scratch

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
SCHEMA = "page_id long, url string"
URLS = [
    None, "", "nothing", "http://A.Example.ORG/es/x", "https://example.org/en/12?q#f", "http://xexample.org/es/1", "http://a.com/fr/", "http://a.com", "http://a.com?x=/de/",
    "http://a.com#/de/", "ftp://B.COM/de/1/2/", "http://org/", "http://notorg/", "x://y://com/fr/", "http://É.com/fr/ü", "http://a.example.org/en/", "http://h.net/a\nb?c",
]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def judge(spark, rows, labels, **kw):
    pages = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels, "key long, good int")
    return urlfilter.judge(pages, known, RULES, Scratch(spark, "t"), key=pages.page_id, **kw)


def test_hosts_paths_and_rules_against_brute_force(spark):
    found = {r.page_id: r for r in judge(spark, list(enumerate(URLS)), []).collect()}
    assert len(found) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, rule = brute(url)
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule), url
        assert found[i].verdict == (RULES[rule] if rule else "allow")


def test_impure_templates_are_rejected_and_wildcards_found(spark):
    rows, labels = [], []
    for i in range(300):
        rows.append((i, f"http://good.net/news/{i}"))
        rows.append((1000 + i, f"http://mixed.net/tag/word{chr(97 + i % 26)}{chr(97 + i // 26)}"))
        rows.append((2000 + i, f"http://mixed.net/post/{i}.html"))
        labels += [(i, 1), (1000 + i, int(i % 10 == 0)), (2000 + i, int(i % 10 != 0))]
    found = judge(spark, rows, [x for x in labels if x[0] % 3]).collect()
    assert {(r.host, r.template, r.verdict) for r in found} == {("good.net", "/news/*", "allow"), ("mixed.net", "/tag/*", "block"), ("mixed.net", "/post/*", "allow")}
    by = {r.template: r.purity for r in found}
    assert by["/tag/*"] < 0.2 and by["/post/*"] > 0.8


def brute_tree(rows, labels):
    """page_id to (template, purity, verdict) by a tree of nodes in plain Python."""
    looks = lambda x: bool(re.match(r"^(?:[0-9]+|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27})(?:\.[A-Za-z0-9]{1,5})?$", x) or re.search("[0-9]{4,}", x))
    pages = {}
    for i, url in rows:
        host, path, _ = brute(url)
        path = re.sub("^/+", "", re.sub("/+$", "", path))
        pages[i] = [host, path.split("/") if path else [], ()]
    for d in range(max((len(p[1]) for p in pages.values()), default=0)):
        children = {}
        for host, parts, node in pages.values():
            if d < len(parts):
                children.setdefault((host, node, looks(parts[d])), []).append(parts[d])
        wide = {k for k, v in children.items() if len(set(v)) >= (3 if k[2] else 12) and len(v) <= 4 * len(set(v))}
        for p in pages.values():
            if d < len(p[1]):
                p[2] += ("*" if (p[0], p[2], looks(p[1][d])) in wide else p[1][d],)
    known = {}
    for i, x in labels:
        known.setdefault(i, []).append(x)
    n, g = {}, {}
    for i, (host, _, node) in pages.items():
        for k in range(len(node) + 1):
            key = (host, node[:k])
            n[key] = n.get(key, 0) + (i in known)
            g[key] = g.get(key, 0) + (sum(known[i]) / len(known[i]) if i in known else 0)
    all_n, all_g = sum(n[h, t] for h, t in n if not t), sum(g[h, t] for h, t in g if not t)
    base = (all_g + 1) / (all_n + 2) if all_n else 1.0
    siblings = {}
    for host, node in n:
        if node:
            siblings.setdefault((host, node[:-1]), []).append((host, node))
    merged = {}
    for own in siblings.values():
        ns, gs = sum(n[k] for k in own), sum(g[k] for k in own)
        for k in own:
            others, rest = ns - n[k], gs - g[k]
            pooled = gs / ns if ns else 0
            merged[k] = not (n[k] and others and (g[k] / n[k] - rest / others) ** 2 > 1.96**2 * pooled * (1 - pooled) * (1 / n[k] + 1 / others))
    purity = {}
    for host, node in sorted(n, key=lambda k: len(k[1])):
        key = (host, node)
        if not node:
            purity[key] = (g[key] + 5 * base) / (n[key] + 5)
            continue
        pool = [k for k in siblings[host, node[:-1]] if merged[k]] if merged[key] else [key]
        purity[key] = (sum(g[k] for k in pool) + 5 * purity[host, node[:-1]]) / (sum(n[k] for k in pool) + 5)
    out = {}
    for i, url in rows:
        host, _, node = pages[i]
        rule, p = brute(url)[2], purity[host, node]
        out[i] = ("/" + "/".join(node) if node else "", round(p, 9), RULES[rule] if rule else "block" if p < 0.5 else "allow")
    return out


def test_templates_purities_and_verdicts_against_brute_force(spark):
    rng = random.Random(9)
    rows, labels = list(enumerate(URLS)), []
    for i in range(100, 700):
        host = rng.choice(["a.net", "b.a.net", "c.org", "d.example.org", "e.com"])
        part = [rng.choice(["news", "tag", "x", "2024"]) for _ in range(rng.randint(0, 3))]
        leaf = rng.choice([str(rng.randint(1, 300)), f"{rng.randint(1, 40)}.html", "about", f"word{rng.choice('abcdefghijklmnopqrst')}", "deadbeef01", ""])
        rows.append((i, f"http://{host}/" + "/".join([*part, leaf])))
        if rng.random() < 0.6:
            labels.append((i, int(rng.random() < (0.1 if "tag" in part else 0.8))))
    rows.append((900, "http://deep.net/" + "/".join("abcdefghijklmnop")))
    found = {r.page_id: (r.template, round(r.purity, 9), r.verdict) for r in judge(spark, rows, labels).collect()}
    wanted = brute_tree(rows, labels)
    assert found == wanted
    assert {v for _, _, v in found.values()} == {"allow", "block"} and any("*" in t for t, _, _ in found.values())


def test_deep_paths_take_a_step_for_each_branching(spark):
    """Paths of hundreds of segments, two of which part only at the end, and one of thousands."""
    long = "/".join(f"s{k}" for k in range(300))
    rows = [(1, f"http://h.net/{long}/x"), (2, f"http://h.net/{long}/y/z"), (3, f"http://h.net/{long}"), (4, "http://h.net/" + "//".join("abc"))]
    rows += [(10 + i, f"http://h.net/{long}/{i}") for i in range(8)]
    labels = [(1, 1), (2, 0), (10, 0), (11, 0)]
    found = {r.page_id: (r.template, round(r.purity, 9), r.verdict) for r in judge(spark, rows, labels).collect()}
    assert found == brute_tree(rows, labels) and found[10][0] == f"/{long}/*"
    began = time.perf_counter()
    deep = "/".join(str(k) for k in range(5000))
    found = judge(spark, [(1, f"http://h.net/{deep}"), (2, "http://h.net/a")], []).collect()
    assert {r.template for r in found} == {f"/{deep}", "/a"} and time.perf_counter() - began < 60


def test_similar_branches_are_merged(spark):
    """Branches above the leaves: c and d differ from a and b, whose labels are pooled."""
    rows = [(i, f"http://h.net/{'abcd'[i % 4]}/{i // 8}/p{i}") for i in range(160)]
    labels = [(i, int(i % 4 < 2)) for i in range(0, 160)]
    found = judge(spark, rows, labels).collect()
    assert {i: (r.template, round(r.purity, 9), r.verdict) for r in found for i in (r.page_id,)} == brute_tree(rows, labels)
    assert {(r.template[:2], r.verdict) for r in found} == {("/a", "allow"), ("/b", "allow"), ("/c", "block"), ("/d", "block")}


def test_repeats_clashing_columns_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x")], SCHEMA).selectExpr("*", "'q' as host", "'w' as typed", "1 as n")
    known = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "key long, good int")
    found = urlfilter.judge(pages, known, RULES, Scratch(spark, "t"), key=pages.page_id)
    assert found.columns == ["page_id", "url", "typed", "n", "host", "path", "template", "purity", "rule", "verdict"]
    assert [r.host for r in found.collect()] == ["a.net", "a.net"]
    assert urlfilter.judge(pages.limit(0), known, RULES, Scratch(spark, "t"), key=pages.page_id).count() == 0
