import itertools
import random

from lodestone.llm import url_rules as U

URLS = [None, "", "no scheme", "http://", "HTTP://A.NET/x", "http://a.net", "http://net/", "http://x.example.net/en/1?u=a://b", "http://example.net/en", "https://m.example.com/de/9#top", "https://example.com/DE/9", "http://notexample.com/de/1",
        "a://b.org/fr/?q", "a://b.org?x/fr/", "x://y.org#a", "http://u:p@h.net:80/", "http://sub.fr.org/fr/x.HTML"]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    n = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
    path = rest[: min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [r for _, r in U.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def test_fixed_rules(spark):
    df = spark.createDataFrame([(i, u, 3) for i, u in enumerate(URLS)], "page_id long, url string, Host int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = sorted(U.judged(df, none).collect(), key=lambda r: r.page_id)
    said = dict((b, a) for a, b in U.RULES)
    assert [(r.host, r.path, r.rule) for r in rows] == [plain_rule(u) for u in URLS]
    assert all(r.verdict == said.get(r.rule, "allow") for r in rows)
    assert U.judged(df.limit(0), none).count() == 0


def test_mined_rules(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        host, part = rng.choice(["good.io", "odd.io", "other.io"]), rng.choice(["a", "b", "c"])
        rows.append((i, f"http://{host}/{part}/{rng.randrange(50)}.html?id=3"))
        labels.append((i, int(not (host == "odd.io" and part in "ab" and rng.random() < 0.95))))
    rows += [(None, "http://odd.io/a/1"), (7, rows[7][1])]
    labels += [(None, 0), (5, None), (99999, 0)]
    pages, marks = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {frozenset(r.rule): (r.confidence, r.support) for r in U.mine(pages, marks).collect()}
    # brute force over all token combinations
    tokens = {r.page_id: r.t for r in pages.where("page_id is not null").select("page_id", U.tokens_of(U.F.col("url")).alias("t")).distinct().collect()}
    bad = {i for i, q in labels if q == 0}
    baskets = [tokens[i] for i, _ in rows if i is not None and any(j == i and q is not None for j, q in labels)]
    is_bad = [i in bad for i, _ in rows if i is not None and any(j == i and q is not None for j, q in labels)]
    want, n = {}, len(baskets)
    for size in range(1, 8):
        for combo in {c for t in baskets for c in itertools.combinations(sorted(t), size)}:
            hit = [b for t, b in zip(baskets, is_bad, strict=True) if set(combo) <= set(t)]
            shorter = any(x < set(combo) for x in want)
            if not shorter and sum(hit) >= max(U.PAGES, U.SUPPORT * n) and sum(hit) / len(hit) >= U.CONFIDENCE:
                want[frozenset(combo)] = (sum(hit) / len(hit), sum(hit) / n)
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-9 and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    judged = U.judged(pages, marks).collect()
    assert len(judged) == len(rows)
    for r in judged:
        own = {x for x in want if x <= set(tokens.get(r.page_id) or ["h:odd", "h:io", "p:a", "p:#"])}
        assert (r.verdict == "block") == bool(own)


def test_long_urls_and_few_labels(spark):
    """URLs of more tokens than combinations are proposed from: figures are counted over all tokens; and a label or two is no rule."""
    rows = [(i, "http://h.io/" + "/".join(f"{'bad' if i % 2 else 'fine'}{chr(97 + (i + k) % 26)}" for k in range(22)) + ("/bad/worse" if i % 2 else "")) for i in range(200)]
    marks = spark.createDataFrame([(i, int(i % 2 == 0 or i % 20 == 1)) for i in range(200)], "doc_id long, quality int")
    pages = spark.createDataFrame(rows, "page_id long, url string")
    tokens = {r.page_id: set(r.t) for r in pages.select("page_id", U.tokens_of(U.F.col("url")).alias("t")).collect()}
    assert max(map(len, tokens.values())) > U.ITEMS + 4
    got = U.mine(pages, marks, items=6).collect()
    assert got
    for r in got:
        hit = [i for i in tokens if set(r.rule) <= tokens[i]]
        bad = sum(i % 2 == 1 and i % 20 != 1 for i in hit)
        assert abs(r.confidence - bad / len(hit)) < 1e-9 and abs(r.support - bad / 200) < 1e-9 and bad >= U.PAGES and r.rarest in r.rule
    few = spark.createDataFrame([(i, 0) for i in range(19)], "doc_id long, quality int")
    assert U.mine(pages, few).count() == 0


def plain_rules(baskets, is_bad, least, most):
    """Rules of up to most tokens by counting combinations of all tokens."""
    want, n = {}, len(baskets)
    every = sorted(set().union(*baskets))
    frequent = [t for t in every if sum(b for x, b in zip(baskets, is_bad, strict=True) if t in x) >= least]
    for size in range(1, most + 1):
        for combo in itertools.combinations(frequent, size):
            if any(x <= set(combo) for x in want):
                continue
            hit = [b for t, b in zip(baskets, is_bad, strict=True) if t.issuperset(combo)]
            if sum(hit) >= least and sum(hit) >= U.CONFIDENCE * len(hit):
                want[frozenset(combo)] = (sum(hit) / len(hit), sum(hit) / n)
    return want


def mined(spark, rows, bad, **args):
    pages = spark.createDataFrame(rows, "page_id long, url string")
    marks = spark.createDataFrame([(i, int(i not in bad)) for i, _ in rows], "doc_id long, quality int")
    tokens = {r.page_id: set(r.t) for r in pages.select("page_id", U.tokens_of(U.F.col("url")).alias("t")).collect()}
    got = {frozenset(r.rule): (round(r.confidence, 9), round(r.support, 9)) for r in U.mine(pages, marks, **args).collect()}
    return [tokens[i] for i, _ in rows], [i in bad for i, _ in rows], got


def test_rules_of_tokens_that_tell_little(spark):
    """A page's combinations are found whole, however many tokens it has and however little each of them tells."""
    rng = random.Random(3)
    for names, share, pages, least, items in ((9, 0.6, 300, 20, 3), (30, 0.7, 400, 50, U.ITEMS)):
        rows, bad = [], set()
        for i in range(pages):
            parts = [f"t{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(names) if rng.random() < share]
            u, v = rng.random() < 0.4, rng.random() < 0.4
            parts += ["uu"] * u + ["vv"] * v + ["twin", "double"] * (i % 3 > 0)
            rng.shuffle(parts)
            rows.append((i, "http://h.io/" + "/".join(parts)))
            # with uu and vv always, with neither often: each alone is as bad as any page
            if u and v or not (u or v) and rng.random() < 0.6:
                bad.add(i)
        baskets, is_bad, got = mined(spark, rows, bad, pages_at_least=least, items=items)
        want = {k: (round(a, 9), round(b, 9)) for k, (a, b) in plain_rules(baskets, is_bad, least, names if names < 10 else 4).items()}
        assert max(map(len, baskets)) > items + 4
        assert frozenset({"p:uu", "p:vv"}) in want
        assert got == want
