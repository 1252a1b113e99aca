"""The url filter, the conversation trie and the periodic runs: hand-made edge
cases and brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from dendra.llm import common, periodic, prefix_trie, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- urls ---------------------------------------------------------------------

PAGES = "page_id long, url string, html string, rule int, _host string, verdict double"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "x", 1, "h", 2.0) for i, u in rows], PAGES).repartition(3)


def judge_one(url, rules=urls.RULES, strict=urls.STRICT, soft=urls.SOFT, limit=urls.LIMIT):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m.group(1).translate(str.maketrans(urls.UPPER, urls.LOWER)), m.group(2)) if m else ("", "")
    fit = [(len(h) + len(p), h + p, v) for h, p, v in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return (host, path, *max(fit)[1:])
    low = (url or "").translate(str.maketrans(urls.UPPER, urls.LOWER))

    def held(t):
        return any(low.startswith(t, i) and not (low[max(i - 1, 0):i].isalnum() or low[i + len(t):i + len(t) + 1].isalnum())
                   for i in range(len(low) if t in low else 0))
    weight = limit * sum(map(held, strict)) + sum(map(held, soft))
    return host, path, None, "block" if weight >= limit else "allow"


URLS = ["http://a.com/x", "http://com/", "http://com", "http://xcom/", "https://EXAMPLE.com/en/1", "http://www.Example.COM/en/1",
        "http://b.www.example.com/en/", "http://example.com/EN/1", "http://x.net/es/1", "http://x.net/fr", "http://x.net/de/casino",
        "http://x.net/de/casinoland", "http://free-bets.net/de/", "http://free.net/free?free", "http://freebets.net/de/",
        "http://win.org/?q=1#Poker", "ftp://u@h.org:80/p?x", "no scheme casino", "no scheme", "", None, "://", "http://", "http:///p",
        "http://x.org/écasino", "http://x.org/é-casino-é", "a://b://c/d", "http://x.org/a\nb?c", "x" * 50000 + "://casino.org/",
        "http://" + "a." * 20000 + "com/", "http://x.com?y", "http://x.com#/y"]


def test_urls_equal_plain_python(spark):
    rows = list(enumerate(URLS)) + [(0, URLS[0]), (None, URLS[10]), (None, None)]
    got = urls.judge_urls(pages(spark, rows), urls.rules_table(spark)).collect()
    want = sorted(((i, u, *judge_one(u)) for i, u in rows), key=repr)
    assert sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in got), key=repr) == want


def test_urls_same_result_with_many_shuffled_rules(spark):
    rng = random.Random(3)
    rules = {(".".join(rng.choices("ab", k=rng.randint(1, 4))), "/" + "".join(rng.choices("xy/", k=rng.randint(0, 4)))):
             rng.choice(["allow", "block"]) for _ in range(300)}
    rules = [(*k, v) for k, v in rules.items()] + [(None, "/", "block"), ("", "/", "block"), ("q", "/", None)]
    rows = [(i, "http://" + ".".join(rng.choices("ab", k=rng.randint(1, 6))) + "/" + "".join(rng.choices("xy/", k=6)))
            for i in range(400)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = urls.judge_urls(pages(spark, rows), urls.rules_table(spark, rules)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    kept = [r for r in rules if r[0] and r[2]]
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {i: judge_one(u, kept)[2:] for i, u in rows}


def test_urls_empty_tables(spark):
    assert urls.judge_urls(pages(spark, []), urls.rules_table(spark)).count() == 0
    none = urls.judge_urls(pages(spark, [(1, "http://a.com/"), (2, "http://casino.com/")]),
                           urls.rules_table(spark, []), soft=()).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in none) == [(1, None, "allow"), (2, None, "block")]


# -- conversations --------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth long, k1 string, mid int, rep double"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, 3.0) for r in rows], TURNS).repartition(5)


def trie_brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    return sorted((m[0], len(k), members[k[:-1]][0] if k else -1, len(m), len(kids[k]), leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items())


def some_turns(seed=2, convs=160):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(700), convs):
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, t if rng.random() < .95 else None, rng.choice(["u", "a", None]),
                         rng.choice(["hi", "hé", "", None, "x y", f"{rng.random()}"])))
    long = [(1, t, "u", f"w{t % 7}") for t in range(300)]
    copy = [(c, t, "u", f"same {t}") for c in range(100, 180) for t in range(8)]
    return rows + long + [(2, *r[1:]) for r in long] + copy + rows[:5] + [(None, 1, "u", "no id"), (5, None, None, None)]


@pytest.mark.parametrize("most", [prefix_trie.MOST_CELLS, 1 << 12])
def test_trie_equals_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 16)
    monkeypatch.setattr(prefix_trie, "JOINED", 50)
    monkeypatch.setattr(prefix_trie, "LEAST_CELLS", 64 if most < 1 << 20 else 1 << 12)
    rows = some_turns()
    got = prefix_trie.conversation_trie(turns(spark, rows), most_cells=64 if most < 1 << 20 else most).collect()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got) == trie_brute(rows)


def test_trie_empty_and_turnless(spark):
    assert prefix_trie.conversation_trie(turns(spark, [])).count() == 0
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(c, 0, "u", "gone")]
    assert [tuple(-1 if v is None else v for v in r) for r in
            prefix_trie.conversation_trie(turns(spark, rows)).collect()] == trie_brute(rows)


# -- periodic runs ---------------------------------------------------------------

DOCS = "doc_id long, text string, key int, start string, period double, kind string"


def runs_brute(words):
    code = {}
    w = np.array([code.setdefault(x, len(code)) for x in words], np.int64)
    n, best = len(w), {}
    for p in range(1, n // 2 + 1):
        eq = np.concatenate([[False], w[:-p] == w[p:], [False]]).astype(np.int8)
        step = np.diff(eq)
        for x, y in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
            if y - x + p >= max(12, 2 * p):
                best.setdefault((int(x), int(y - x + p)), p)
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def document_brute(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = runs_brute(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (-1, -1, -1)
    return (-1 if doc_id is None else doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else -1,
            hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def run_rows(seed=4):
    rng = random.Random(seed)
    texts = ["", None, " \t", "one", "a " * 11, "a " * 12, "a " * 2000, "a b " * 700, "\u00a0 a\x1cb " * 9]
    for _ in range(120):
        kind = rng.choice("abc")
        if kind == "a":                                   # few words: many short runs
            w = rng.choices("ab", k=rng.randint(0, 200))
        elif kind == "b":                                 # plain words with a repeat inside
            w = [str(rng.random()) for _ in range(rng.randint(0, 60))]
            w += w[len(w) // 2:] * rng.randint(1, 9) + [str(rng.random()) for _ in range(20)]
        else:                                             # repeats of repeats
            w = rng.choices("abcdef", k=rng.randint(1, 9)) * rng.randint(1, 5)
            w = (w + rng.choices("xyz", k=rng.randint(0, 3))) * rng.randint(1, 8)
        texts.append(" ".join(w))
    f = ["a", "ab"]
    while len(f[-1]) < 1500:
        f.append(f[-1] + f[-2])
    texts.append(" ".join(f[-1]))                          # a Fibonacci word
    rows = list(enumerate(texts))
    return rows + [rows[5], (rows[6][0], "another text"), (None, "a b c " * 30), (None, None), (1 << 60, "x y " * 40)]


def test_runs_equal_brute_force(spark):
    rows = run_rows()
    df = spark.createDataFrame([(*r, 1, "s", 2.0, "k") for r in rows], DOCS).repartition(4)
    got = sorted(tuple(-1 if v is None else v for v in r) for r in periodic.periodic_runs(df).collect())
    assert got == sorted(document_brute(*r) for r in rows)


def test_runs_of_a_table_equal_brute_force(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents")
    want = sorted(document_brute(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()
                  if len((r.text or "").split()) < 3000)
    got = {tuple(-1 if v is None else v for v in r) for r in periodic.periodic_runs(docs).collect()}
    assert set(want) <= got and len(got) == docs.count()


def test_runs_of_slabs_and_batches_of_any_size(spark, monkeypatch):
    rows = run_rows(9)
    monkeypatch.setattr(periodic, "SLAB", 40)
    monkeypatch.setattr(periodic, "TOGETHER", 300)
    for doc_id, text in rows[:70]:                        # the kernels alone, as the tasks call them
        words = WORD.findall(text or "")
        code = {}
        ids = np.array([code.setdefault(x, len(code)) for x in words] + [-2], np.int64)
        found = defaultdict(list)
        if words:
            for _, step, first, bounds, part in periodic.slabs(ids, np.array([0]), np.array([len(words)])):
                for p, ivs in periodic.stretches(step, bounds.tolist(), part.tolist()).items():
                    found[p] += [(x + first, y + first) for x, y in ivs]
        best = {}
        for p in sorted(found):
            merged = []
            for x, y in sorted(found[p]):
                if merged and x <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], y)
                else:
                    merged.append([x, y])
            for x, y in merged:
                if y - x + p >= max(12, 2 * p):
                    best.setdefault((x, y - x + p), p)
        assert sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2])) == runs_brute(words)


def test_runs_empty_table(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
