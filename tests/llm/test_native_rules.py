"""Operators 2 and 7 against plain Python."""

import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.helpers import frame, noisy
from wardline.llm import quality_rules as qr
from wardline.llm import url_filters as uf

RULES = uf.RULES


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.Com/en/7?x#y", "http://a.b.example.com/en/6", "x://com/en/", "x://com/EN/", "http://com./en/", "http://xcom/en/a", "http://.com/en/1", "https://example.net/de/8/://x", "http://example.net/de/9#f", "http://a.org?q=/es/", "http://a.org/es/", "http://É.org/es/ü", "http://u@x.net:80/de/", "http://x.net/de", "://net/de/1", "http://a.org/es/\nx", "http://a.org/es/1", "http://a.org/es/1"]
    pages = spark.createDataFrame([(i, u, "<p>", "h", "p", "r") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, path string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge_urls(pages, uf.rule_table(spark)).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(urls)}
    assert uf.judge_urls(pages.limit(0), uf.rule_table(spark)).collect() == []
    assert {r.verdict for r in uf.judge_urls(pages, uf.rule_table(spark, []) if False else uf.rule_table(spark).limit(0)).collect()} == {"allow"}


def test_very_long_urls(spark):
    urls = ["http://" + "a." * 50_000 + "com/en/" + "x" * 500_000, "http://" + "b" * 300_000 + "/en/", "https://x.net/de/" + "y/" * 200_000 + "?" + "q" * 100_000, "://" * 10_000]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), uf.rule_table(spark)).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(urls)}


def test_shuffled_rules_give_the_same(spark, monkeypatch):
    urls = [None, "http://a.b.example.com/en/7", "http://example.com/en/6", "https://x.net/de/8", "http://example.net/de/8/a", "http://o.org/es/", "http://o.org/e"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls * 3)], "page_id long, url string")
    want = sorted(uf.judge_urls(pages, uf.rule_table(spark)).collect(), key=str)
    monkeypatch.setattr(uf, "BROADCAST_RULES", 2)
    assert sorted(uf.judge_urls(pages, uf.rule_table(spark)).collect(), key=str) == want


def test_filters_stay_above_the_measures(spark):
    """A filter on a measure evaluates it once, one on the key reaches the scan's side."""
    rows = qr.ledger(frame(spark, noisy(1)))
    plan = rows.where("n_repeat_words > 3 and doc_id = 5")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") == rows._jdf.queryExecution().optimizedPlan().toString().count("xxhash64")
    assert plan.index("Generate") < plan.index("= 5)")


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = Counter(grams)
    hit = {j for i, g in enumerate(grams) if twice[g] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(re.findall("[A-Z]", text)), sum(a == b for a, b in zip(w, w[1:]))


def test_quality_measures(spark):
    texts = [*noisy(1, vocabulary=40), *noisy(2, vocabulary=2), None, "", "a\na\n b\n b\n \n \n", "x " * 8, "x " * 9, "#*$%&|<> é", "\u00a0 a\u2003b", "a b c d e f g h " * 2, "1 2 3 4 5 6 7 8 9 " * 3, "a\r\nb\x0b\x0c" * 40, "LOUD words ÄÖ loud loud loud", " ".join(f"w{i % 9000}" for i in range(60_000))]
    rows = qr.apply_policy(qr.ledger(frame(spark, texts)))
    for r in rows.collect():
        want = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_capitals, r.n_stutter) == want, texts[r.doc_id]
        assert (r.fail_bits & qr.mask("base") != 0) == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.fail_bits & qr.mask("base"))
    assert qr.ledger(frame(spark, [])).collect() == []


def test_ablations_count_bits(spark):
    rows = spark.createDataFrame([(b,) for b in (0, 0, 1, 2, 3, 4, 6, 64)], "fail_bits long")
    got = {r.rule: (r.n_fail, r.n_only, r.n_kept_without) for r in qr.ablations(rows, "v1").collect()}
    assert got["too_few_words"] == (2, 1, 4)
    assert got["repeated_windows"] == (3, 1, 4)
    assert got["symbols"] == (2, 1, 4)
    assert qr.ablations(rows.where(F.lit(False)), "v1").first().n_fail == 0
