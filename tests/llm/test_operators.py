"""Each operator on hand-made edge cases and against brute force."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendra.llm import (ann, common, decontam, jaccard, langid, licenses, mixing, secrets,
                        substrings, suffix, tokens, toxicity)

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
# extra columns whose names clash with those the operators use inside
EXTRA = "{}, size long, cls long, n int, gram long, start int, v int, hash long, target double"


def make(spark, rows, extra=True):
    schema = EXTRA.format(DOCS) if extra else DOCS
    pad = (1, 2, 3, 4, 5, 6, 7, 8.0) if extra else ()
    return spark.createDataFrame([(*r, *pad) for r in rows], schema).repartition(3)


def sample(seed=1, n=30):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, 160))) for _ in range(n)]
    for _ in range(n // 2):                                   # near copies
        ws = rng.choice(texts).split()
        ws[rng.randrange(len(ws))] = "edited"
        texts.append(" ".join(ws))
    texts += [texts[0], texts[0], "", None, "  \t\n", "one two", "One\ttwo", "x" * 5000,
              "été café " * 200, "long " * 20000]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}" if i % 5 else None, len(t or ""))
            for i, t in enumerate(texts)]
    return rows + [rows[2], (rows[3][0], "another text under a used id", "en", "s1", 5),
                   (None, "a row without an id", None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return sample()


def test_every_operator_takes_an_empty_table(spark):
    e = make(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vecs = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    import public_tokenizers
    for df in (mixing.mix_sources(e), decontam.contaminated_pairs(e, bench),
               decontam.decontaminate(e, bench), jaccard.jaccard_components(e),
               jaccard.keep_one_of_each(e), licenses.find_licenses(e, licenses.templates(spark)),
               toxicity.toxicity(e, labels), toxicity.drop_toxic(e, labels),
               secrets.secret_spans(e), secrets.redact(e), substrings.remove_repeats(e),
               tokens.token_counts(e, public_tokenizers.path("byte_bpe_50k.json")),
               ann.nearest(vecs), langid.identify(e)):
        assert df.count() == 0


def test_mix(spark, rows):
    got = mixing.mix_sources(make(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(common.WORD, r[1] or ""))
    total = sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:                                              # reshare until none is above
        left = 1.5 * total - sum(2 * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and left * weight[s] / w > 2 * sizes[s]}
        if not new:
            break
        capped |= new
    target = {s: 2 * sizes[s] if s in capped else left * weight[s] / w for s in order}
    biggest = max(r["size"] for r in got)
    for s in order:
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and math.isclose(r["target"], target[s])
                   for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= biggest
    assert all(r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
               for r in got)
    again = mixing.mix_sources(make(spark, rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_decontamination(spark):
    rng = random.Random(2)
    item = [f"w{rng.randrange(900)}" for _ in range(40)]
    subst = item[:]
    subst[7] = subst[21] = "other"
    noise = " ".join(f"n{k}" for k in range(60))
    rows = [(1, f"{noise} {' '.join(item)} {noise}"), (2, "x " + " ".join(subst).upper()),
            (3, noise), (4, None), (5, ""), (6, " ".join(item[:11])), (7, "short item of six words"),
            (8, " ".join(item[5:30])), (8, " ".join(item[5:30])), (9, "; ".join(item))]
    docs = make(spark, [(i, t, None, None, 0) for i, t in rows])
    bench = spark.createDataFrame([(0, " ".join(item)), (1, "a short item of six words"), (2, None),
                                   (3, "tiny"), (0, " ".join(item))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in
           decontam.contaminated_pairs(docs, bench).collect()}
    assert set(got) == {(1, 0), (2, 0), (8, 0), (9, 0)}
    assert got[1, 0]["overlap"] == 1.0 and 0.75 <= got[2, 0]["overlap"] <= 1
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 7]


def test_decontamination_of_changed_items(spark):
    rng = random.Random(12)
    items, rows, want = [], [], set()
    for n in range(5, 19):
        item = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        most = min(2, n // 4)                                # what 0.75 allows, up to two
        for at in [(), *((a,) for a in range(n)),
                   *((a, b) for b in range(n) for a in range(b) if most == 2)]:
            ws = ["other" if k in at else w for k, w in enumerate(item)]
            fill = [[f"n{rng.randrange(900)}" for _ in range(rng.randrange(8, 40))] for _ in "ab"]
            want.add((len(rows), n))
            rows.append((len(rows), " ".join(fill[0] + ws + fill[1]), None, None, 0))
        ws = ["other" if k % 2 else w for k, w in enumerate(item)]  # half of it
        rows.append((len(rows), " ".join(["x"] * 20 + ws + ["y"] * 20), None, None, 0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated_pairs(make(spark, rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


def contaminated_brute(text, item):
    """Is there an alignment with a stretch of 16 words (all compared ones, if
    fewer) that agree in three quarters?"""
    def split(t):
        return [w for w in re.split(r"[\W_]+", t.lower()) if w]
    ws, iws = split(text), split(item)
    for shift in range(-len(iws) + 1, len(ws)):
        eq = [ws[shift + j] == iws[j] for j in range(max(0, -shift), min(len(iws), len(ws) - shift))]
        n = min(16, len(eq))
        if len(eq) >= min(len(iws), 12) and any(4 * sum(eq[k:k + n]) >= 3 * n for k in range(len(eq) - n + 1)):
            return True
    return False


def test_decontamination_loses_no_changed_item(spark):
    rng = random.Random(14)
    items, rows, want = [], [], set()
    for n in range(5, 24):
        item = [f"i{n}w{k % 9 if n % 3 else k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for _ in range(40):
            at = set(rng.sample(range(n), min(n, rng.randint(1, 6))))
            ws = ["other" if k in at else w for k, w in enumerate(item)]
            cut = rng.choice([0, 0, 0, 1, 4])                 # some at the very end of a text
            text = " ".join([f"n{rng.randrange(900)}" for _ in range(rng.randrange(0, 30))] + ws[:n - cut])
            rows.append((len(rows), text, None, None, 0))
    for r in rows:
        want |= {(r[0], n) for n, t in items if contaminated_brute(r[1], t)}
    docs = make(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated_pairs(docs, bench).collect()}
    assert got == want and 200 < len(want) < len(rows)
    # the SQL of the query says the same
    import duckdb
    import pandas as pd
    from dendra.llm import oracles
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    assert {r[:2] for r in con.sql("SELECT doc_id, item_id FROM (" + oracles.ORACLES["op2_decontaminate"] + ")").fetchall()} == want


def test_decontamination_of_clashing_and_map_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n", {"k": 1}, 2, 3), (2, "clean", None, 4, 5)],
                                 "doc_id long, text string, m map<string, int>, _mark0 int, _k1 int")
    bench = spark.createDataFrame([(0, "a b c d e f g h i j k l m n")], "item_id long, text string")
    assert [tuple(r) for r in decontam.decontaminate(docs, bench).collect()] == [(2, "clean", None, 4, 5)]


def jaccard_brute(rows):
    def grams(t):
        ws = (t or "").translate({c: c + 32 for c in range(65, 91)})
        ws = re.findall(common.WORD, ws)
        return ({tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5
                else {tuple(ws)} if ws else set())
    sets = [grams(r[1]) for r in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                comp[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return sorted(((r[0], len(s), low.get(root(i))) for i, (r, s) in enumerate(zip(rows, sets))),
                  key=str)


def test_jaccard_equals_brute_force(spark, rows):
    got = [tuple(r) for r in jaccard.jaccard_components(make(spark, rows)).collect()]
    assert sorted(got, key=str) == jaccard_brute(rows)


def test_jaccard_hot_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(150):
        ws = base[:]
        for _ in range(rng.randrange(4)):
            ws[rng.randrange(60)] = f"e{rng.randrange(5000)}"
        rows.append((i, " ".join(ws), None, None, 0))
    got = [tuple(r) for r in jaccard.jaccard_components(make(spark, rows)).collect()]
    assert sorted(got, key=str) == jaccard_brute(rows)


def test_stages_tell_rows_apart_by_id_and_text(spark):
    ws = [f"b{k}" for k in range(60)]
    near = ws[:]
    near[30] = "edited"
    far = [" ".join(f"{c}{k}" for k in range(60)) for c in "pqrst"]
    rows = [(1, " ".join(ws)), (2, " ".join(near)), (2, far[0]),           # a used id
            (3, far[1]), (3, far[1]), (3, far[1]),                          # repeated rows
            (None, " ".join(ws)), (None, far[2]), (None, far[2]),           # null ids
            (None, far[3] + " x"), (None, far[3] + " y"), (9, far[4]), (8, ""), (8, ""), (7, None)]
    docs = make(spark, [(*r, None, None, 0) for r in rows])
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    last = [r for r in got if (r[1] or "").startswith("s0 ")]
    assert len(last) == 1
    assert got == sorted([rows[0], rows[2], rows[3], rows[7], last[0], *rows[11:]], key=str)
    # without any id, classes still link
    nulls = make(spark, [(None, " ".join(ws), None, None, 0), (None, " ".join(near), None, None, 0),
                         (None, far[0], None, None, 0)])
    assert jaccard.keep_one_of_each(nulls).count() == 2
    # a class without an id bridges two others
    bridge = [ws[:k] + ["new"] * (k < 60) + ws[k + 1:] for k in (60, 53)]
    chain = ws[:6] + ["other"] + ws[7:53] + ["new"] + ws[54:]
    got = jaccard.jaccard_components(make(spark, [
        (i, " ".join(x), None, None, 0) for i, x in ((1, bridge[0]), (None, bridge[1]), (2, chain))]))
    assert {r["component_id"] for r in got.collect()} == {1}

    bench = spark.createDataFrame([(0, " ".join(ws[:30]))], "item_id long, text string")
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str)
    assert got == sorted([r for r in rows if not (r[1] or "").startswith("b0 ")], key=str)


def test_trie_links_equal_pairwise():
    rng = random.Random(3)
    for _ in range(200):
        pool = sorted(rng.sample(range(40), 24))
        sets = [np.array(sorted(rng.sample(pool, rng.randint(1, 20))), np.uint64) for _ in range(9)]
        x, ys = sets[0], list(enumerate(sets[1:]))
        want = [k for k, y in ys if jaccard.linked(len(np.intersect1d(x, y)), len(x), len(y))]
        assert sorted(jaccard.trie_links(x, ys)) == want


def test_licenses_equal_brute_force(spark):
    rng = random.Random(4)
    fill = lambda n: " ".join(f"f{rng.randrange(500)}" for _ in range(n))
    rows = [(i, f"{fill(rng.randrange(80))}\n{licenses.TEMPLATES[i % 10][2]}\n{fill(40)}")
            for i in range(60)] + [(60, None), (61, ""), (62, fill(300)),
                                   (63, "Released under the MIT License."), (63, fill(9)),
                                   (64, "licensed under the apache licence version 2 0")]
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    want = {(i, k) for i, t in rows for k, _, x in licenses.TEMPLATES
            if len(grams(words(t)) & grams(words(x))) >= 0.75 * len(grams(words(x)))}
    got = licenses.find_licenses(make(spark, [(i, t, None, None, 0) for i, t in rows]),
                                 licenses.templates(spark)).collect()
    assert {(r["doc_id"], r["template_id"]) for r in got} == want and len(got) == len(want)


def test_toxicity_grammar():
    g = toxicity.Grammar({})
    plain, aimed = g.clauses("an idiot here"), g.clauses("you idiot here")
    assert aimed[0] > plain[0]
    assert g.clauses("not an idiot here")[0] < plain[0]
    assert g.clauses("she wrote idiot here")[0] < aimed[0]
    assert g.clauses("burn the wood") == [] and g.clauses("i will burn you") == []
    assert len(g.clauses("you will burn")) == 1
    assert g.clauses("") == []


def test_toxicity_held_out(spark, sf_dir):
    read = lambda t: common.read(spark, "/root/testdata/sf0.01", t)
    got = toxicity.toxicity(read("documents"), read("labels")).join(read("labels"), "doc_id")
    rows = [r for r in got.collect() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    odd = make(spark, [(1, None, None, None, 0), (2, "", None, None, 0), (2, "", None, None, 0),
                       (None, "you idiot", None, None, 0)])
    assert len(toxicity.toxicity(odd, read("labels")).collect()) == 4


def test_secrets(spark, rows):
    hexes = "0123456789abcdef" * 3
    texts = [f'api_key = "{hexes}" end', "token: short", "Password:abcdefgh AKIAABCDEFGHIJKL12",
             f"é {hexes[:32]} AKIA12", "passwd='abcdefg' secret=abc/def+12", None, "",
             "ToKeN=xxxxxxxxx;apikey:yyyyyyyy", "toſen=abcdefghijk toKen=abcdefghijkl",
             "ghp_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----"] + [r[1] for r in rows]
    docs = make(spark, [(i, t, None, None, len(t or "")) for i, t in enumerate(texts)])
    base = secrets.RULES[:3]
    got = {r["doc_id"]: r for r in secrets.secret_spans(docs).collect()}
    for i, t in enumerate(texts):
        spans = [(m.start(), k, m.end(), kind) for k, (kind, p, g, least) in enumerate(base)
                 for m in re.finditer(p, t or "") if len(m.group(g)) >= least]
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k, *_ in base] == [sum(s[3] == k for s in spans)
                                                        for k, *_ in base]
    assert got[9]["spans"].startswith("github:0:") and got[10]["spans"].startswith("private_key")
    clean = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert clean[0]["text"] == '[assign]" end' and clean[0]["n_chars"] == 13
    assert clean[5]["text"] is None and clean[1]["text"] == texts[1]


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]+") is None
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == ("and", ["aki", "kia"])
    assert secrets.trigram_query(r"(abc|x)d") is None
    assert secrets.trigram_query(r"ab?cde") == "cde"


def test_suffix_array_and_plcp():
    rng = random.Random(6)
    for _ in range(150):
        n, k = rng.randint(1, 70), rng.choice([2, 3, 26])
        t = [rng.randint(1, k) for _ in range(n)] + [0]
        sa = suffix.suffix_array(np.array(t))
        want = sorted(range(n + 1), key=lambda i: t[i:])
        assert sa.tolist() == want
        plcp, phi = suffix.permuted_lcp(np.array(t), sa)
        for r in range(1, n + 1):
            i, j, m = want[r], want[r - 1], 0
            while t[i + m:i + m + 1] == t[j + m:j + m + 1] and i + m <= n and j + m <= n:
                m += 1
            assert phi[i] == j and plcp[i] == m


@pytest.mark.parametrize("rounds", [1, 2, 16])
def test_suffix_array_of_runs_and_periods(monkeypatch, rounds):
    monkeypatch.setattr(suffix, "ROUNDS", rounds)
    monkeypatch.setattr(suffix, "STRETCH", 1 << rounds)
    rng = random.Random(rounds)
    for _ in range(120):
        unit = [rng.randint(1, 3) for _ in range(rng.randint(1, 7))]
        t = unit * rng.randint(1, 12)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(t))
            t[at:at + 1] = [rng.randint(1, 3)] * rng.randint(1, 40)
        sa = suffix.suffix_array(np.array(t + [0]))
        assert sa.tolist() == sorted(range(len(t) + 1), key=lambda i: (t + [0])[i:])
        starts = suffix.repeated_starts([bytes(t), bytes(unit)], 4)
        grams = [bytes(x[i:i + 4]) for x in (t, unit) for i in range(len(x) - 3)]
        want = [[i for i in range(len(x) - 3) if grams.count(bytes(x[i:i + 4])) > 1]
                for x in (t, unit)]
        assert [x.tolist() for x in starts] == want


@pytest.mark.parametrize("unit", [b"a", b"long ", b"ab" * 500 + b"c"])
def test_a_megabyte_of_one_period(unit):
    data = unit * (1_000_000 // len(unit))
    begun = time.process_time()
    starts, = suffix.repeated_starts([data], 400)
    assert time.process_time() - begun < 30          # about a second; quadratic sorting takes hours
    assert starts.tolist() == list(range(len(data) - 399))


@pytest.mark.parametrize("anchor_bytes", [8 << 20, 1])     # suffix arrays; string hashes
def test_repeats_equal_brute_force(spark, rows, anchor_bytes):
    length, texts = 60, rows
    got = substrings.remove_repeats(make(spark, texts), length=length, gram=8,
                                    shard_bytes=4096, anchor_bytes=anchor_bytes).collect()
    count = {}
    for r in texts:
        b = (r[1] or "").encode()
        for i in range(len(b) - length + 1):
            count[b[i:i + length]] = count.get(b[i:i + length], 0) + 1
    want = []
    for r in texts:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want.append((r[0], len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()),
                     hashlib.sha256(kept).hexdigest()))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)


def test_token_counts(spark, rows):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = tokens.load_tokenizer(path)
    special = "see <|endoftext|> and  it's   spaced \n\n out " * 80
    texts = [r[1] for r in rows] + [special, "a" * 3000, " " * 3000, "äö" * 900]
    docs = make(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    whole = [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for chunk, overlap in ((1 << 16, 1 << 10), (700, 150)):
        got = {r["doc_id"]: r for r in
               tokens.token_counts(docs, path, chunk=chunk, overlap=overlap).collect()}
        assert [got[i]["n_tokens"] for i in range(len(texts))] == whole
    assert all(got[i]["n_bytes"] == len((t or "").encode()) and
               got[i]["over_limit"] == (whole[i] > 512) for i, t in enumerate(texts))


def test_nearest(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((20, 16))
    v = centres[rng.integers(0, 20, 1500)] + 0.4 * rng.standard_normal((1500, 16))
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(1500)]
    rows += [(1500, None, 0), (1501, [0.0] * 16, 0), (1502, [float("nan")] * 16, 0),
             (1503, [None] * 16, 0), (1504, [float("inf")] * 16, 0), (1600, [1.0, 2.0], 0),
             (1601, rows[0][1], 0), (1602, rows[0][1], 0), (None, rows[1][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v int")
    got = ann.nearest(df, query_every=50).collect()
    ids = np.array([r[0] for r in rows[:1500]] + [1601, 1602])
    vecs = np.vstack([v, v[0], v[0]])
    hit = total = 0
    for q in range(0, 1500, 50):
        d = np.sqrt(((vecs - v[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted(
            (r["score"], r["vec_id"]) for r in mine)
        hit += len(set(ids[best]) & {r["vec_id"] for r in mine})
        total += 10
    assert hit / total >= 0.9
    first = [r["vec_id"] for r in got if r["query_id"] == 0][:2]
    assert first == [1601, 1602]
    assert not any(r["query_id"] == 1600 for r in got)       # nothing of its length


def test_nearest_with_repeated_rows(spark):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((300, 16))
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(300)]
    schema = "vec_id long, embedding array<double>, v int"

    def run(rows):
        return sorted(map(tuple, ann.nearest(spark.createDataFrame(rows, schema),
                                             query_every=50).collect()))
    once = run(rows)
    assert len(once) == 60
    assert run(rows * 2) == once and run(rows + rows[1:2] * 30) == once
    # an id with many vectors takes one place
    near = [(7, [x + 1e-6 * k for x in rows[0][1]], 0) for k in range(1, 31)]
    got = [r for r in run(rows + near) if r[0] == 0]
    assert [r[1] for r in got] == list(range(1, 11)) and [r[2] for r in got].count(7) == 1
    # a query id with several vectors: the best of each candidate
    got = [r for r in run(rows + [(0, rows[1][1], 0)]) if r[0] == 0]
    assert [r[1] for r in got] == list(range(1, 11)) and len({r[2] for r in got}) == 10


def test_language(spark):
    docs = common.read(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    odd = make(spark, [(1, None, "en", None, 0), (2, "12 34 !?", "en", None, 0),
                       (3, "", None, None, 0), (3, "", None, None, 0)])
    learned = langid.profiles(docs)
    assert {(r["lang_pred"], r["score"]) for r in
            langid.predict_language(odd, learned).collect()} == {("und", 0.0)}
    assert {r["lang_pred"] for r in langid.identify(odd).collect()} == {"und"}


def test_gram_ranks_by_hand():
    g = langid.grams("ab a")
    assert len(g) == 3 + 3 + 2 + 3                          # letters, pairs before / at ends, triples
    assert len(langid.grams("1 2")) == 0


def test_components(spark):
    from dendra.operators.components import components
    chain = [(i, i + 1) for i in range(50)] + [(100, 99), (99, 101), (101, 100)]
    random.Random(1).shuffle(chain)
    got = {r["v"]: r["comp"] for r in
           components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 99: 99, 100: 99, 101: 99}


def test_training_fold(spark):
    ids = spark.range(200).select(F.col("id"), common.is_training(F.col("id")).alias("t"))
    assert all(r["t"] == (zlib.crc32(str(r["id"]).encode()) % 3 != 1) for r in ids.collect())
