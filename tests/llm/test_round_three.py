"""Phrases, URL verdicts and whitening against plain restatements, on odd rows and on whole tables."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.llm import collocations, url_filter, whitening
from casewright.llm.registry import QUERIES
from tests.conftest import SF
from tests.llm.brute import ascii_lower


# --- phrases -------------------------------------------------------------------------------------------------------------


def mined(rows, least, words, share, top):
    counts = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, words + 1):
                for i in range(len(w) - k + 1):
                    counts[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        n, kept = sum(a for p, a in f.items() if len(p) == 1), []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= share * a for b in longer):
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def phrases(df, **options):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.collocations(df, **options).collect())


def sentences(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "c", "New", "york", "é", "ab", "zz", "😀", "x-y", "'s"]
    ends = [" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "! ", ";", "\x0b", "\x1c"]
    return [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [200, 12 << 20])
@pytest.mark.parametrize(("least", "words", "top"), [(3, 4, 2000), (2, 3, 5), (4, 5, 7)])
def test_phrases_equal_a_full_count(spark, monkeypatch, chunk, least, words, top):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "SLICE", 300)
    rows = [*sentences(3, 120), ("en", None), ("en", ""), ("fr", " .. \t"), (None, "lone")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = phrases(df, least=least, words=words, top=top)
    assert got == mined(rows, least, words, 80, top) and got


def test_phrases_of_odd_rows(odd, nothing):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert phrases(odd, least=2) == mined(rows, 2, 4, 80, 2000)
    assert phrases(nothing) == []


# --- URLs ----------------------------------------------------------------------------------------------------------------

ODD_URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.NET/EN/a?b", "http://sub.example.net/en/x#y", "http://example.net", "http://example.net/en", "https://a.org/fr/",
    "https://a.org/fr", "ftp://x.com/a://b.net/", "http://net/", "http://anet/", "http://example.com/de/1", "http://www.example.com/de/", "http://notexample.com/de/",
    "http://example.com?/de/", "http://h.net#/en/", "http://é.net/ä/\n/z", "x://" + "a" * 3000 + ".org/fr/" + "b" * 3000, "http://example.net:80/en/", "http://a..net/", "http://.net/x",
]


def plain(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (ascii_lower(m.group(1)), m.group(2)) if m else ("", "")
    best = max((r for r in url_filter.RULES if (host == (h := r[1].split("/")[0]) or host.endswith("." + h)) and path.startswith(r[1][len(h) :])), key=lambda r: len(r[1]), default=None)
    return host, path, best


def test_rules_and_parts_of_odd_urls(spark):
    df = spark.createDataFrame([(i if i % 5 else None, u, "<p>" + (u or "") + "</p>") for i, u in enumerate(ODD_URLS * 2)], "page_id long, url string, html string").withColumn("host", F.lit("taken"))
    got = sorted(((r.page_id or -1, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.judge(df).collect()))
    assert len(got) == 2 * len(ODD_URLS)
    want = []
    for i, u in enumerate(ODD_URLS * 2):
        host, path, best = plain(u)
        want.append((i if i % 5 else -1, host, path, best[1] if best else "", best[0] if best else None))
    assert [(a[:4], a[4] if a[3] else None) for a in got] == [(b[:4], b[4]) for b in sorted(want, key=lambda x: x[:4])]
    assert {v for *_, v in got} <= {"allow", "block"}
    assert url_filter.judge(df.limit(0)).count() == 0


def test_viterbi_equals_all_splits():
    rng = random.Random(8)
    for _ in range(200):
        name = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        known = {}
        for a in range(len(name)):
            for b in range(a + 1, min(len(name), a + 4) + 1):
                if rng.random() < 0.4:
                    known[a, b] = -rng.uniform(1, 6)
        best = -math.inf
        for mask in range(1 << (len(name) - 1)):
            cuts = [0, *[i + 1 for i in range(len(name) - 1) if mask >> i & 1], len(name)]
            parts = list(zip(cuts, cuts[1:], strict=False))
            if all(p in known or p[1] - p[0] == 1 for p in parts):
                best = max(best, sum(max(known.get(p, -math.inf), -5.0 if p[1] - p[0] == 1 else -math.inf) for p in parts))
        words = url_filter.viterbi(name, known, -5.0)
        assert "".join(words) == name
        # The walk's own weight, over its cuts, is the best of all splits.
        again = [0.0] + [-math.inf] * len(name)
        for end in range(1, len(name) + 1):
            again[end] = max([again[end - 1] - 5.0] + [again[a] + w for (a, b), w in known.items() if b == end])
        assert again[-1] == pytest.approx(best)


def test_words_written_together_are_found(spark):
    """Names without any seed word are blocked by what they share with seeded ones; other hosts stay."""
    pages = [(f"http://casino-win{k}.example.com/en/{k}", "casino win money") for k in range(30)]
    pages += [(f"http://garden-news{k}.example.com/en/{k}", "garden news today winter casinos") for k in range(60)]
    pages += [("http://moneywincasino.example.com/en/1", ""), ("http://winmoneywin.example.com/en/2", ""), ("http://gardennewstoday.example.com/en/3", "")]
    df = spark.createDataFrame([(i, u, f"<p>{t}</p>") for i, (u, t) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(df, rules=[("block", "net/")]).collect()}
    assert {got[i] for i in range(30)} == {"block"} and {got[i] for i in range(30, 90)} == {"allow"}
    assert (got[90], got[91], got[92]) == ("block", "block", "allow")


def test_url_query_over_the_whole_table(spark):
    urls = dict(duckdb.sql(f"SELECT page_id, url FROM '{SF}/pages.parquet'").fetchall())
    rows = QUERIES["op12_url_filter"](spark, SF).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, best = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best[1] if best else None) and r.verdict in ("allow", "block")
        assert best is None or r.verdict == best[0]


# --- whitening -----------------------------------------------------------------------------------------------------------


def whitened(rows, k=4):
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in kept), default=0)
    x = np.array([[math.floor(256 * c) for c in [*v, *[0.0] * (width - len(v))]] for _, v in kept], np.int64).reshape(len(kept), width)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    deviation = ((n * x - total) ** 2).sum(axis=1)
    centred = fit - total / max(1, n)
    values, vectors = np.linalg.eigh(centred.T @ centred / max(1, n))
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    k = int((values[:k] > 1e-9 * max(values.max(initial=0), 1e-300)).sum())
    return kept, n, deviation, (x - total / max(1, n)) @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def compared(rows, got):
    kept, n, deviation, parts, explained = whitened(rows)
    k = parts.shape[1]
    assert len(got) == len(kept) * k
    have = collections.defaultdict(dict)
    for r in got:
        assert r.n == n and r.identity_error <= 1e-10 and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        have[r.vec_id].setdefault(r.component, []).append((r.deviation, r.whitened))
    for c in range(1, k + 1):
        sign = 0.0
        for (i, _), d, row in zip(kept, deviation, parts, strict=True):
            options = [w for dev, w in have[i][c] if dev == d]
            assert options
            if not sign and abs(row[c - 1]) > 1e-3 and len(have[i][c]) == 1:
                sign = math.copysign(1.0, options[0] * row[c - 1])
            assert min(abs(w - (sign or 1.0) * row[c - 1]) for w in options) < 1e-8 or not sign


VECTORS = "vec_id long, embedding array<double>, x string, n int"


def test_whitening_equals_an_eigendecomposition(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 9)) * [9, 7, 5, 3, 2, 1, 0.5, 0.1, 0.02]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)] + [(1000 + i, [float(c) for c in base[7]]) for i in range(200)]
    rows += [(2000, None), (2001, [1.0, None]), (2002, [math.nan] * 9), (2003, [math.inf] * 9)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(5)
    compared(rows, whitening.whiten(df).collect())


def test_dependent_and_constant_dimensions(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(-40, 40, size=(60, 2))
    x = np.column_stack([a[:, 0], a[:, 1], a[:, 0] + 2 * a[:, 1], np.full(60, 7), np.zeros(60), -a[:, 0]]) / 256
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    got = whitening.whiten(df).collect()
    assert {r.component for r in got} == {1, 2}
    compared(rows, got)


def test_a_condition_that_squares_beyond_precision(spark):
    """Two dimensions that differ by little: an eigendecomposition of the covariance alone would lose the small one's digits."""
    rng = np.random.default_rng(7)
    big = rng.integers(-(10**6), 10**6, size=500)
    x = np.column_stack([big, big + rng.integers(-1, 2, size=500), rng.integers(-5, 5, size=500)]) / 256
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = whitening.whiten(spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)).collect()
    assert {r.component for r in got} == {1, 2, 3} and max(r.identity_error for r in got) < 1e-6


def test_whitening_of_few_and_odd_rows(spark):
    none = spark.createDataFrame([], VECTORS)
    assert whitening.whiten(none).collect() == []
    alike = spark.createDataFrame([(1, [0.5, 0.25], "x", 1), (None, [0.5, 0.25], "x", 1), (3, [], "x", 1)], VECTORS)
    assert whitening.whiten(alike.where("vec_id = 1")).collect() == [] and whitening.whiten(alike.where("vec_id = 3")).collect() == []
    # A shorter vector counts as filled with zeros, so two vectors differ here.
    got = whitening.whiten(alike).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, r.deviation) for r in got) == [(0, 1, 2, 128**2 + 64**2), (1, 1, 2, 128**2 + 64**2), (3, 1, 2, 128**2 + 64**2)]
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e300], "x", 1)], VECTORS)).collect()


def test_whitening_query_over_the_whole_table(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    compared(rows, QUERIES["op13_whitening"](spark, SF).collect())
