"""Rules against plain parsing, scores against a plain model of the same smoothing."""

import math
import random
from collections import Counter, defaultdict

from flowmill.llm import url_filter as uf


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    path = rest[end:]
    cut = min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path[:cut]


def ruled(host, path):
    fit = [(len(d + p), d + p, v) for d, p, v in uf.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def model(texts, order=uf.ORDER):
    counts, followers = Counter(), defaultdict(set)
    for text, n in texts.items():
        padded = uf.START * (order - 1) + text
        for i in range(len(text)):
            for size in range(1, order + 1):
                gram = padded[i + order - size : i + order]
                counts[gram] += n
    totals = Counter()
    for gram, n in counts.items():
        totals[gram[:-1], len(gram)] += n
        followers[gram[:-1], len(gram)].add(gram[-1])

    def p(gram):
        below = p(gram[1:]) if len(gram) > 1 else 1 / uf.ALPHABET
        key = gram[:-1], len(gram)
        return (counts[gram] + len(followers[key]) * below) / (totals[key] + len(followers[key])) if totals[key] else below

    return lambda text: [p((uf.START * (order - 1) + text)[i : i + order]) for i in range(len(text))]


def test_judged(spark):
    rng = random.Random(1)
    urls = [f"https://{rng.choice(['www.', 'm.', ''])}{rng.choice(['river', 'stone', 'house'])}.example.{rng.choice(['org', 'net', 'com'])}/"
            f"{rng.choice(['en', 'fr', 'de', 'es'])}/{rng.randrange(300)}{rng.choice(['', '?a=/b', '#x', '/'])}" for _ in range(400)]
    urls += [f"http://cheap-pills.example.net/en/{i}" for i in range(40)] + [
        None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG", "http://example.org/en/1", "x://Example.org/es/?q#f", "http://éÀ.org/", "a://b://c.org/d",
        "http://org/", "http://xorg/fr/", "http://line\nbreak.com/fr/\nq"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in uf.judge_urls(df, seed_terms=("pills",)).collect()}
    assert len(got) == len(urls)
    yes, no = Counter(), Counter()
    for i, url in enumerate(urls):
        host, path = parsed(url)
        rule, verdict = ruled(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        if rule:
            assert got[i].verdict == verdict
        if host + path:
            rejected = "pills" in host or verdict == "block"
            (no if rejected else yes)[host + path] += 1
    accepted, refused = model(yes), model(no)
    for i, url in enumerate(urls):
        text = "".join(parsed(url))
        if got[i].rule is None and text:
            want = sum(math.log(a) - math.log(b) for a, b in zip(accepted(text), refused(text))) / len(text)
            assert abs(got[i].score - want) < 1e-6
    assert all(got[i].verdict == "block" for i in range(400, 440))
    fair = [r for r in got.values() if r.rule is None and r.page_id < 400]
    assert sum(r.verdict == "block" for r in fair) <= 0.02 * len(fair)
    assert all(got[i].verdict == "allow" for i in range(440, 444))


def test_nothing_to_learn(spark):
    one = spark.createDataFrame([(1, "http://a.net/x"), (None, None)], "page_id long, url string")
    assert [r.verdict for r in uf.judge_urls(one).collect()] == ["allow", "allow"]
    assert uf.judge_urls(one.limit(0)).count() == 0


def test_urls_do_not_train_their_own_acceptance(spark):
    """An undecided host that is like rejected ones is blocked, however many urls it has."""
    rng = random.Random(3)
    name = lambda: "".join(rng.choice(["ri", "ver", "sto", "ne", "hou", "se", "li", "ght"]) for _ in range(3))
    hosts = [f"{name()}.example.{rng.choice(['org', 'net', 'com'])}" for _ in range(40)]
    urls = [f"https://{rng.choice(hosts)}/{rng.choice(['en', 'fr', 'de', 'es'])}/{rng.randrange(300)}" for _ in range(400)]
    urls += [f"http://cheap-pills.example.net/en/{i}" for i in range(40)] + [f"http://cheap-pillz.example.net/en/{i}" for i in range(100)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in uf.judge_urls(df, seed_terms=("pills",), folds=2).collect()}
    assert len(got) == len(urls)
    assert all(got[i].verdict == "block" for i in range(400, 540))
    fair = [r for r in got.values() if r.rule is None and r.page_id < 400]
    assert sum(r.verdict == "block" for r in fair) <= 0.05 * len(fair)  # 8 of 247: few hosts to learn from
    before = uf.judge_urls(df, seed_terms=("pills",)).filter("page_id >= 440 and verdict = 'block'").count()
    assert before < 50
