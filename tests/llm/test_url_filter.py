import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillgraph.llm.url_filter import RULES, filter_urls


def by_hand(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else None


@pytest.fixture(scope="module")
def pages(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM", "x://example.com/en/7?q#f", "http://notexample.com/en/7", "http://a.com?x://b.net/de/", "ftp://u.net/de/8", "http://q.example.net/de/81", "http://com/en/", "http://é.org/es/ñ"]
    urls += [f"http://{w}.example.{t}/{g}/{i}" for i, (w, t, g) in enumerate((w, t, g) for w in ("blog", "www", "shop", "m") for t in ("com", "net", "org") for g in ("en", "de", "es", "fr") for _ in range(4))]
    rows = [(i, u, "clash") for i, u in enumerate([*urls, urls[5]])] + [(None, "http://x.fr/fr/1", "clash")]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def test_hosts_paths_rules(pages):
    df, rows = pages
    got = sorted(((r.page_id, r.host, r.path, r.rule) for r in filter_urls(df).collect()), key=str)
    assert got == sorted(((i, *by_hand(u)[:3]) for i, u, _ in rows), key=str)
    for r in filter_urls(df).collect():
        assert r.verdict in ("allow", "block")
    ruled = {i: by_hand(u)[3] for i, u, _ in rows}
    assert all(r.verdict == ruled[r.page_id] for r in filter_urls(df).collect() if ruled[r.page_id])


def test_likeness_to_rejected_urls(spark):
    good = [f"http://site{i}.net/de/artikel/{i}" for i in range(100)]
    bad = [f"http://win{i}.org/es/casino/{i}" for i in range(100)]
    df = spark.createDataFrame(list(enumerate([*good, *bad, "http://win7.info/xx/casino/9", "http://site7.info/xx/artikel/9"])), "page_id long, url string")
    verdicts = {r.page_id: r.verdict for r in filter_urls(df).collect()}
    assert verdicts[200] == "block" and verdicts[201] == "allow"


def test_empty_and_one_sided(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(empty).count() == 0
    one = spark.createDataFrame([(1, "http://a.fr/x"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in filter_urls(one).collect()} == {"allow"}


def model_by_hand(urls, order=3):
    """score(s) of the two models, from (s, accepted) of the URLs they learn from; counts in dicts of n-grams."""
    seen = {True: defaultdict(Counter), False: defaultdict(Counter)}
    grams = lambda s: (("\x01" * order + s)[i : i + order + 1] for i in range(len(s)))
    for s, accepted in urls:
        for g in grams(s):
            for k in range(order + 1):
                seen[accepted][g[order - k : order]][g[order]] += 1

    def likelihood(g, side):
        p = 1 / 64
        for k in range(order + 1):
            c = seen[side].get(g[order - k : order], {})
            p = (c.get(g[order], 0) + len(c) * p) / (sum(c.values()) + len(c)) if c else p
        return math.log(p)

    return lambda s: sum(likelihood(g, True) - likelihood(g, False) for g in grams(s)) / len(s) if s else 0.0


def test_scores_of_many_different_ngrams(spark):
    rng = random.Random(9)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(12, 30)))
    urls = [None, "http://"]
    for i in range(3_000):
        ruled, letters = rng.choice([("net/de", "abcdefghijklmnopqrstuv"), ("org/es", "klmnopqrstuvwxyzéß"), ("info/xx", "abcdefghijklmnopqrstuvwxyzéßж")])
        urls.append(f"http://{word(letters)}.{ruled}/{word(letters)}/{rng.randint(0, 99)}")
    urls += urls[-50:]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = filter_urls(df).select("*", F.expr("pmod(xxhash64('fold', host, path), 5) = 0").alias("held")).collect()
    spell = lambda r: re.sub("[1-9]", "0", (r.host + r.path).lower())
    labelled = {(r.host, r.path): (spell(r), r.verdict == "allow", r.held) for r in got if r.rule and spell(r)}
    learn = [(s, accepted) for s, accepted, held in labelled.values() if not held]
    assert len({s[i : i + 4] for s, _ in learn for i in range(len(s) - 3)}) > 20_000
    score = model_by_hand(learn)
    assert len(got) == len(urls) and all(abs(r.score - score(spell(r))) < 1e-9 for r in got)
    cut = got[0].threshold
    assert all(r.threshold == cut and (r.rule or r.verdict == ("allow" if r.score >= cut else "block")) for r in got)
    kept, lost = ([score(s) for s, accepted, held in labelled.values() if held and accepted == side] for side in (True, False))
    assert abs(sum(x < cut for x in kept) / len(kept) - sum(x >= cut for x in lost) / len(lost)) < 0.02
