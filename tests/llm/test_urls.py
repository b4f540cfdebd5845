import random
from itertools import combinations

import pytest

from paperloom.llm import urls

RULES = (("one.org/", "block"), ("two.org/", "allow"))


def plain_tokens(url):
    import re

    rest = url.split("://", 1)[1]
    host, path, query = re.match("([^/?#]*)([^?#]*)[?]?([^#]*)", rest).groups()
    labels = [x for x in reversed(host.lower().split(".")) if x]
    made = [f"tld={x}" for x in labels[:1]] + [f"host={x}" for x in labels[1:]]
    made += [f"path={x}" for x in path.split("/") if x] + [f"query={x.split('=')[0]}" for x in query.split("&") if x.split("=")[0]]
    return {re.sub("[0-9]+", "0", x) for x in made}


def plain_verdict(url, labelled, support=urls.SUPPORT, confidence=urls.CONFIDENCE):
    """Best rule among all subsets of a URL's tokens, counted one by one; (confidence, verdict)."""
    have = [t for t in sorted(plain_tokens(url)) if sum(t in x for x, _ in labelled) >= support * len(labelled)]
    best = (-1.0, 0.0, 0, [], "allow")
    for k in range(1, len(have) + 1):
        for names in combinations(have, k):
            of = [v for x, v in labelled if x >= set(names)]
            for v in set(of):
                both = of.count(v)
                if both >= support * len(labelled) and both >= confidence * len(of):
                    best = max(best, (both / len(of), both / len(labelled), -k, list(names), v))
    return (None if best[0] < 0 else pytest.approx(best[0])), best[4]


@pytest.mark.parametrize("most", [urls.MOST_RULES, 0])
def test_late_tokens_decide(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "MOST_RULES", most)
    rng = random.Random(5)
    made = []
    for i in range(300):
        bad = i % 2 == 0
        host = "one.org" if bad else "two.org"
        deep = "/a/b/c/" + ("ads" if bad and i % 6 == 0 else rng.choice(["x", "y"]))
        query = "?p=1&q=2&" + ("track=3" if bad and i % 6 == 2 else rng.choice(["r=1", "s=1"]))
        front = "spam.e.d.c.b." if bad and i % 6 == 4 else rng.choice(["", "z.e.d.c.b."])
        made.append((i, f"http://{front}{host}{deep}{query}"))
    probes = ["http://n.net/a/b/c/ads?p=1&q=2&r=1", "http://n.net/a/b/c/x?p=1&q=2&track=3", "http://spam.e.d.c.b.n.net/a/b/c/x?p=1&q=2&s=1", "http://n.net/a/b/c/x?p=1&q=2&r=5", "http://n.net/", "http://q.b.c.d.e.net/c/b/a/ads"]
    rows = made + [(1000 + i, u) for i, u in enumerate(probes)]
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()}
    assert len(got) == len(rows)
    labelled = [(plain_tokens(u), "block" if i % 2 == 0 else "allow") for i, u in made]
    for i, u in rows:
        assert set(got[i]["tokens"]) == plain_tokens(u)
    for i, u in enumerate(probes):
        want, verdict = plain_verdict(u, labelled)
        assert (got[1000 + i]["confidence"], got[1000 + i]["verdict"]) == (want, verdict), u
    assert [got[1000 + i]["verdict"] for i in range(3)] == ["block"] * 3


def test_many_tokens_that_stand_together(spark):
    names = "&".join(f"k{chr(97 + i // 26)}{chr(97 + i % 26)}=1" for i in range(60))
    rows = [(i, f"http://{'one' if i % 10 else 'two'}.org/deep/{'/'.join('abcdefghijklmnopqrstuvwxyz')}?{names}") for i in range(200)]
    rows += [(500, "http://n.net/?kab=7"), (501, "http://n.net/q/r"), (502, "http://n.net/none")]
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()}
    assert [(got[i]["verdict"], got[i]["confidence"]) for i in (500, 501, 502)] == [("block", 0.9), ("block", 0.9), ("allow", None)]
