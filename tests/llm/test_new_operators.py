"""Ranked search, URL filters and collocations against brute-force versions, SQL, and odd rows."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from oracle import as_rows, sql_rows
from pyspark.sql import functions as F

from quillspark.llm import collocations, ranked, urlfilter
from quillspark.llm.common import keep_table


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_op12_equals_sql(spark, small):
    rows = urlfilter.op12_url_filter(spark, small).toPandas()
    assert as_rows(rows) == as_rows(sql_rows(urlfilter.oracle(), small))


def _judged_plainly(url, listed, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (_lower(m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), h + p, act) for act, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fit)[2:] if fit else (None, "block" if host in listed else "allow")
    return host, path, rule, verdict


def test_op12_odd_urls_against_brute_force(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://A.Com", "http://a.com?x=://b.net/fr/", "http://example.com/en/", "https://www.Example.com/en/1#a/b", "x://sub.www.example.com/en/", "http://notexample.com/en/", "http://net/es/", "http://a.net/es", "http://a.net/fr/?q", "ü://Ünï.net/fr/é", "http://free-bets.org/", "http://bets.free.org", "http://alphabets.org", "http://com/", "http://com", "http://com:80/", "http://a\nb.org/x", "http://" + "a." * 5000 + "net/es/" + "y" * 50_000, "http://casino.net/fr/", "http://casino.net/en/"]
    pages = spark.createDataFrame([(i % 20, u, "clash", 1, "b") for i, u in enumerate(urls + urls[5:9])], "page_id long, url string, host string, key long, verdict string")
    pattern = urlfilter.listed_pattern()
    got = urlfilter.judged(pages, F.col("key").rlike(pattern)).collect()
    wanted = []
    for i, u in enumerate(urls + urls[5:9]):
        m = re.search(r"://([^/?#]*)", u or "")
        host = _lower(m[1]) if m else ""
        wanted.append((i % 20, *_judged_plainly(u, {host} if re.search(pattern, host) else set(), urlfilter.RULES)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))


@pytest.mark.parametrize("keys,most_keys", [(0, 100), (1, 100), (3000, 10_000), (3000, 1200)])
def test_op12_cascade_is_exact_on_its_universe(spark, keys, most_keys):
    pages = spark.range(keys).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".org/")).alias("url"))
    for every in (2, 97) if keys > 1 else (1,):
        got = urlfilter.judged(pages, F.regexp_extract("key", r"h(\d+)", 1).cast("long") % every == 0, most_keys=most_keys)
        assert {(r["page_id"], r["verdict"]) for r in got.collect()} == {(i, "allow" if i % every else "block") for i in range(keys)}


def test_op12_levels_alternate_until_nothing_passes(spark):
    universe = keep_table(spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 3 == 0).alias("listed")))
    found = urlfilter.cascade(universe)
    assert len(found.levels) > 1 and sum(words for _, words in found.levels[1:]) < found.levels[0][1]
    assert universe.where(found.holds(F.col("key")) != F.col("listed")).count() == 0
    assert not urlfilter.cascade(universe.where("not listed")).levels


def test_op12_longer_rules_win(spark):
    rules = (("allow", "a.org", "/"), ("block", "org", "/x"), ("block", "b.a.org", "/"), ("allow", "org", "/xyz/long"))
    urls = ["http://a.org/x", "http://b.a.org/xyz/longer", "http://c.org/xyz", "http://c.org/y", "http://b.a.org/q"]
    got = urlfilter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), F.lit(None).cast("boolean"), rules).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == [_judged_plainly(u, set(), rules) for u in urls]


def test_op13_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    rows = collocations.op13_collocations(spark, folder).toPandas()
    assert len(rows) and as_rows(rows) == as_rows(sql_rows(collocations.oracle(), folder))


def _collocations_plainly(rows, least, most):
    out, by_lang = [], {}
    for lang, text in rows:
        pieces = [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", _lower(text))]
        by_lang.setdefault(lang or "und", []).extend(pieces)
    for lang, pieces in by_lang.items():
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in (1, 2, 3, 4) for i in range(len(p) - k + 1))
        n = sum(map(len, pieces))
        known = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        over = Counter()
        for g, a in known.items():
            for i in range(len(g)):
                for j in range(i + 2, len(g) + 1):
                    if j - i < len(g):
                        over[g[i:j]] = max(over[g[i:j]], a)
        found = []
        for g, a in known.items():
            if 100 * over[g] < 80 * a:
                score, _, left, right = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i + 1, g.decode(), -a, left, right, n, -score) for i, (score, a, g, left, right) in enumerate(sorted(found)[:most])]
    return sorted(out)


@pytest.mark.parametrize("shard_words,shard_bytes", [(1 << 20, 1 << 20), (7, 100), (1, 1)])
def test_op13_against_brute_force(spark, shard_words, shard_bytes):
    random = np.random.default_rng(4)
    vocabulary = ["a", "b", "B", "été", "Été", "x-y", "日本", "the", "\x00q", "q\x01"]
    texts = [" ".join(random.choice(vocabulary, size, p=[0.3, 0.2, *[0.5 / 8] * 8])) for size in (1, 2, 3, 4, 50, 400)]
    texts += [None, "", " \t ", "...", "a a a a a a a a a a", "a,b;a:b!a?b\na\rb\x0bc\x0cd", "one.two", "The the\tTHE  the "] + texts[:3]
    rows = [(("en", "de", None)[i % 3], t) for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame([(i, t, lang, 1, "p", 0) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, f long, phrase string, words int")
    got = collocations.collocations(docs, 3, 25, shard_words, shard_bytes).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == _collocations_plainly(rows, 3, 25)


def test_op13_empty_tables(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(docs).collect() == []


def test_op13_suffix_order():
    random = np.random.default_rng(5)
    ids, pieces = random.integers(0, 3, 200), np.sort(random.integers(0, 30, 200))
    last = {p: i for i, p in enumerate(pieces)}
    room = np.array([last[p] - i + 1 for i, p in enumerate(pieces)])
    order, shared = collocations.suffix_order(ids, room, 4)
    heads = [tuple(ids[i : i + min(4, room[i])]) for i in order]
    assert heads == sorted(heads)
    for a, b, k in zip(heads, heads[1:], shared[1:], strict=False):
        assert k == next((i for i in range(4) if i >= min(len(a), len(b)) or a[i] != b[i]), 4)


def test_op11_equals_sql(spark, small):
    rows = ranked.op11_ranked_search(spark, small).toPandas()
    assert as_rows(rows) == as_rows(sql_rows(ranked.oracle(), small))


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", _lower(text))


def _ranked_plainly(docs, items, top):
    counts = [(i, Counter(_terms(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in counts:
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * c.total() * n_docs // length))) for t in set(_terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_docs,wave", [(1 << 16, 256), (1, 256), (5, 1), (64, 3)])
def test_op11_against_brute_force(spark, shard_docs, wave, monkeypatch):
    monkeypatch.setattr(ranked, "WAVE", wave)
    random = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "日本", "ONE", "one"]
    texts = [" ".join(random.choice(vocabulary[: int(random.integers(2, 44))], int(random.integers(1, 60)))) for _ in range(80)]
    texts += [None, "", " .,- ", "one", "One one", " ".join(f"x{i} one" for i in range(20_000))] + texts[:6] * 3
    docs = [(int(i) if i else None, t) for i, t in zip(random.permutation(len(texts)), texts, strict=True)]
    docs += docs[:9] + [(None, "w1 w2"), (-5, "w1 w2"), (2**63 - 2, "w1 w2")]
    items = [(i, " ".join(random.choice(vocabulary, 8))) for i in range(8)] + [(0, "w1"), (8, None), (9, "absent"), (10, "one ONE"), (10, "one ONE"), (11, " ".join(vocabulary))]
    frame = spark.createDataFrame([(*d, 1, "t") for d in docs], "doc_id long, text string, score long, terms string")
    asked = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, rank int")
    for top, query_bytes in ((10, 1 << 20), (3, 60)):
        got = ranked.ranked(frame, asked, top, shard_docs=shard_docs, query_bytes=query_bytes).collect()
        assert sorted(map(tuple, got), key=str) == _ranked_plainly(docs, items, top)


def test_op11_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id > 5"), items.limit(0))):
        assert ranked.ranked(d, i).collect() == []
