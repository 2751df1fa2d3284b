"""Decontamination and URL filters against brute force."""

import re

import pytest

from isobar.llm.decontaminate import contamination, drop_contaminated
from isobar.llm.urls import judge_urls

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(len(v), 10)
        for j in range(len(v) - n + 1 if item is not None and n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[j : j + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


SPAN = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi".split()
ITEMS = [
    (1, " ".join(SPAN)), (2, "Five words make, this item"), (10, "one"), (3, None), (4, "..."), (None, "never counted " * 8), (5, "é è ê É one two three four five six seven"),
    (6, " ".join(SPAN[:10])), (6, "two versions"), (7, "a a a a a a a a a a a a"),
]
TEXTS = [
    None, "", " ,.", "ALPHA-beta (gamma) Delta epsilon zeta eta theta iota kappa!", " ".join(SPAN[:9]), " ".join(["x"] * 50 + SPAN + ["y"] * 50 + SPAN[2:13]), "five words make this item five words make this item",
    "five words make this", "é è ê é one two three four five six", "é è ê É one two three four five six", "a " * 400, "never counted " * 8, "two versions", "b " * 30_000 + " ".join(SPAN[3:]), "three", "three",
]


@pytest.mark.parametrize("items", [ITEMS, ITEMS[:1], [], [(9, "solo")]])
def test_contamination(spark, items):
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], None, None)], "doc_id long, text string, key string, size int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, tuple(r.items), r.n_items, r.contaminated) for r in contamination(docs, bench).collect()}
    want = set()
    for i, t in [*enumerate(TEXTS), (None, TEXTS[3])]:
        n, hit, found = brute(t, items)
        want.add((i, n, hit, tuple(found), len(found), hit > 0))
    assert got == want




def test_clean_rows_stay(spark):
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, key string, size int")
    kept = drop_contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(TEXTS) if not brute(t, ITEMS)[1]}


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert contamination(none, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


RULES = [("com", "/", "allow"), ("Example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "", "allow"), ("twice.org", "/", "allow"), ("twice.org", "/", "block"), ("org", "/longer", "block"), (None, "/", "block")]
URLS = [
    None, "", "no scheme", "http://", "https://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://example.com/en", "http://a.example.com/en/1", "http://com", "http://com/", "http://xcom/", "ftp://b.net/es/://q", "http://b.net/fr",
    "http://twice.org/a", "http://a.b.twice.org?x://y/", "http://q.org/longest", "http://q.org/LONGER", "http://é.org/longer\n2#", "http://" + "a." * 3000 + "com/" + "p/" * 3000, "http://com/", "http://.com/", "http://com./",
]


def judged(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = host.translate(LOWER)
    fits = [(len(h + p), len(h), h + p, v == "block", v) for h, p, v in ((h.translate(LOWER), p, v) for h, p, v in RULES if h) if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[4] if best else "allow"


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rules).collect()}
    assert got == {i: judged(u) for i, u in enumerate(URLS)}


def test_no_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, URLS[4])], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in judge_urls(pages, rules).collect()] == [(1, "www.example.com", "/en/x", None, "allow")]
    assert judge_urls(pages.limit(0), spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0
