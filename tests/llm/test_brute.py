"""Operators against the plainest way to work out the same, on small inputs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import decontaminate, graph, html, media, neardup, oracles, pii, quality, secrets, suffixes, toxicity

WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "se", "ra") for b in ("ben", "dor", "fin", "gal", "hum", "jek")]


def values(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_same_as_sql(spark, duck, sf, name):
    from inkwell.llm import queries

    df = queries.queries()[name](spark, sf)
    found = duck.execute(oracles.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert values(df.select(*names).collect()) == values(found.fetchall())


# op1


def test_summed_equations_and_isotonic_curve(spark):
    rng = random.Random(1)
    rows = [(" ".join(rng.choices(WORDS, k=rng.randrange(1, 40))) + ("!!" * rng.randrange(9)), rng.randrange(2), i % 4) for i in range(300)]
    model = quality.fit(spark.createDataFrame(rows, "text string, y int, part int").repartition(5))
    learn = [r for r in rows if r[2] > 0]
    x, y = quality._matrix([r[0] for r in learn]), np.array([r[1] for r in learn], float)
    whole = quality.Model(x.mean(0), np.maximum(np.sqrt(np.maximum((x**2).mean(0) - x.mean(0) ** 2, 1e-8)), 1e-3))
    phi = whole.features(x)
    weights = np.linalg.solve(phi.T @ phi + quality.RIDGE * np.eye(phi.shape[1]), phi.T @ y)
    assert np.allclose(phi @ weights, model.raw(x), atol=1e-6)


def test_pools_of_equal_scores():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 40):
        raw, y = rng.integers(0, 12, n) / 4, rng.integers(0, 2, n).astype(float)
        xs, ys = quality.isotonic(raw, y)
        scores = np.unique(raw)
        for i, r in enumerate(scores):
            best = max(min(y[(raw >= scores[j]) & (raw <= scores[k])].mean() for k in range(i, len(scores))) for j in range(i + 1))
            assert np.isclose(np.interp(r, xs, ys), best)


# op4


def copies(seed, n, words=120):
    """Texts around one text, each with a few words changed."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(words)] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def sets_of(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components_of(texts, percent=85):
    sets, label = [sets_of(t) for t in texts], list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_groups_of_many_blocks(spark, monkeypatch, broadcast):
    monkeypatch.setattr(neardup, "BLOCK_NODES", 4)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", broadcast)
    monkeypatch.setattr(graph, "LINKS", 3)
    monkeypatch.setattr(graph, "BROADCAST_LINKS", broadcast)
    texts = copies(1, 40) + copies(2, 25) + [" ".join([*copies(3, 1)[0].split()[:60], *copies(1, 1)[0].split()[60:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == dict(enumerate(components_of(texts)))


def test_blocks_that_the_first_does_not_connect(spark):
    """Two families in one group: the second meets no node of the first block."""
    rng = random.Random(9)
    rows, expected = [], {}
    for family in range(2):
        base = [f"f{family}w{i}" for i in range(60)]
        for i in range(6):
            w = list(base)
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            rows.append((family * 10 + i, " ".join(w)))
            expected[family * 10 + i] = family * 10
    shingler, (x, a) = neardup.Shingler(), neardup._permutations()
    members = [(i, 7, i // 3 % 4, 4, len(s), neardup.signature(s, x, a), s.tobytes()) for i, t in rows for s in [shingler(t)]]
    df = spark.createDataFrame(members, "nid bigint, comp bigint, block int, blocks int, n int, sig binary, set binary")
    got = {r["u"]: r["label"] for r in graph.components(neardup.group_links(df, 80)).collect()}
    sets = {i: sets_of(t) for i, t in rows}
    texts = [t for _, t in rows]
    by_id = dict(zip([i for i, _ in rows], components_of(texts, 80), strict=True))
    want = {i: rows[c][0] for i, c in by_id.items() if sum(v == c for v in by_id.values()) > 1}
    assert got == want and sets and set(expected)


def test_measured_recall(spark):
    """Pairs made to share 85 to 90 percent of their shingles: all links are found."""
    rng = random.Random(4)
    rows, linked = [], 0
    for i in range(1500):
        n = rng.randrange(80, 400)
        base = [f"p{i}w{k}" for k in range(n)]
        other = list(base)
        other[n - max(1, int(n * rng.uniform(0.05, 0.081))) :] = [f"q{i}w{k}" for k in range(max(1, int(n * 0.065)))]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        a, b = sets_of(rows[-2][1]), sets_of(rows[-1][1])
        linked += 100 * len(a & b) >= 85 * len(a | b)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).where("not kept").count()
    assert linked > 500 and got == linked


# op2, op3, op8, op10: the ways beyond what may be broadcast


def test_joins_without_broadcasts(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))

    def all_of():
        return [
            values(secrets.find(docs, secrets.repository(), "source").select("doc_id", secrets.written("spans"), "n_live", "n_copied").collect()),
            values(secrets.redact(docs).select("doc_id", F.md5("text")).collect()),
            values(decontaminate.keep(docs, items).select("doc_id").collect()),
            values(decontaminate.pairs(docs, items).collect()),
            values(suffixes.dedup(docs).collect()),
            values(pii.find(docs, min_texts=2).collect()),
        ]

    before = all_of()
    for module, name in ((secrets, "BROADCAST_ROWS"), (decontaminate, "BROADCAST_HASHES"), (suffixes, "BROADCAST_KEYS"), (pii, "CANDIDATES")):
        monkeypatch.setattr(module, name, 0)
    assert all_of() == before


def test_column_form_of_containment(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    column = docs.select("doc_id", F.explode(decontaminate.contained(items)).alias("x")).select("doc_id", "x.item_id", "x.shared", "x.n")
    assert values(column.collect()) == values(decontaminate.pairs(docs, items).select("doc_id", "item_id", "shared", "n").collect())


# op5


def test_disclosing_terms_by_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(160):
        w = rng.choices(WORDS, k=25)
        k = rng.randrange(8)
        if k < 4:
            w += [f"user{k}{rng.randrange(3)}@host{k % 2}.example.org", f"marker{k}"] + (["Telling" if i % 2 else "TELLING"] if k == 1 else [])
        if k == 5:
            w += ["+1 234 555 0100", "marker1"]
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
    texts = dict(rows)
    spans = {i: pii.base_spans(t) for i, t in rows}
    held = {i: {x for k, s, e in spans[i] for x in pii.entities(k, texts[i][s:e])} for i in texts}
    words = {i: {t for t, _, _ in pii.terms(texts[i], spans[i])} for i in texts}
    n_c, n_t = Counter(c for x in held.values() for c in x), Counter(t for x in words.values() for t in x)
    n_ct = Counter((c, t) for i in texts for c in held[i] for t in words[i])
    telling = set()
    for (c, t), n in n_ct.items():
        prior = n_c[c] / len(texts)
        p = (n + prior) / (n_t[t] + 1)
        if n_c[c] >= 3 and n >= 3 and -np.log2(p) <= pii.MAX_RESIDUAL_BITS and np.log2(p / prior) >= pii.MIN_PMI_BITS:
            telling.add((c, t))
    expected = {i: ",".join(f"term:{s}:{e}" for t, s, e in pii.terms(texts[i], spans[i]) if any((c, t) in telling for c in held[i])) for i in texts}
    got = {r["doc_id"]: r["term_spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    assert got == expected and any(expected.values())


# op7


def test_media_values(spark, tmp_path):
    texts = ["", "abc", "é" * 400, "x" * 576, "x" * 577, "\x00\xff", "longer " * 5000]
    folder = f"file://{tmp_path}/m"
    media.store(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3), folder).collect()
    got = {r["doc_id"]: r for r in media.features(media.read(spark, folder, range_bytes=700)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        data = t.encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        stored = media.to_png(payload)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload))
        assert media.from_png(stored) == payload


# op8


def by_brute_force(docs, n=100):
    seen, out = set(), {}
    for i, t in sorted(docs.items()):
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - n + 1):
            w = data[p : p + n]
            if w in seen:
                gone[p : p + n] = True
            seen.add(w)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_cover_has_every_difference():
    met = Counter((a - b) % suffixes.MODULUS for a in suffixes.COVER for b in suffixes.COVER)
    assert all(met[d] == 1 for d in range(1, suffixes.MODULUS)) and suffixes.UNIT_BYTES % suffixes.MODULUS == 0


@pytest.mark.parametrize("small", [False, True])
def test_texts_longer_than_a_unit(spark, monkeypatch, small):
    rng = random.Random(8)
    if small:
        # Units, runs and windows so small that all of them are cut, and joins without broadcasts.
        for name, value in (("RUN", 64), ("WINDOW_RANKS", 2), ("DEALT", 50), ("GATHERED", 40), ("BROADCAST_KEYS", 0), ("LEAST_BUCKETS", 2)):
            monkeypatch.setattr(suffixes, name, value)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (20, 40, 90)]
    head = passages[0]
    docs = {i: " ".join(rng.choice([rng.choice(passages), " ".join(word() for _ in range(30))]) for _ in range(6)) for i in range(30)}
    docs |= {40 + i: f"{word()} {head} {word()}{i}" for i in range(20)}
    if not small:
        long = " ".join(word() for _ in range(420_000))
        assert len(long.encode()) > suffixes.UNIT_BYTES
        at = len(long) * 9 // 10
        docs |= {100: long, 101: "z " + long[at - 700 : at + 700], 102: long[100:400]}
    got = {r[0]: tuple(r)[1:] for r in suffixes.dedup(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(5)).collect()}
    assert got == by_brute_force(docs)


# op9


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_edit_distance():
    rng = random.Random(12)
    make = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    words = {make(rng.randrange(3, 12)): rng.uniform(2, 6) for _ in range(60)}
    stems = {make(rng.randrange(3, 6)): rng.uniform(2, 6) for _ in range(10)}
    automaton = toxicity.Automaton(words, stems)
    for _ in range(3000):
        w = make(rng.randrange(1, 13)) if rng.random() < 0.4 else rng.choice(list(words))
        if rng.random() < 0.6:
            i = rng.randrange(len(w) + 1)
            w = w[:i] + rng.choice(["", make(1)]) + w[i + rng.randrange(2) :]
        found = [weight * 0.8**e for t, weight in words.items() if (e := edits(t, w)) <= toxicity.allowed(t)]
        found += [weight for t, weight in stems.items() if w.startswith(t)]
        assert automaton.weight(w) == pytest.approx(max(found, default=0.0))


def test_quotation_tells_abuse(spark):
    """Documents that quote the terms aren't toxic: with context nearly all are told apart, without it hardly any."""
    rng = random.Random(3)
    bad = ["scumbagger", "idiotish", "wretchling", "dimwitted"]

    def made(kind):
        t = rng.choices(WORDS, k=30)
        w = rng.choice(bad)
        t[15:15] = {"abuse": ["you", w], "plain": [w], "quoted": ["they", "said", f"“{w}”", "there"], "clean": []}[kind]
        return " ".join(t)

    kinds = ["abuse", "plain", "quoted", "clean", "clean", "clean"] * 120
    rows = [(made(k), int(k in ("abuse", "plain")), i % 4) for i, k in enumerate(kinds)]
    scorer = toxicity.fit(spark.createDataFrame(rows, "text string, y int, part int"))

    def right():
        test = [(made(k), k in ("abuse", "plain")) for k in kinds]
        return float(np.mean((scorer.score([t for t, _ in test]) >= 0.5) == [y for _, y in test]))

    with_context = right()
    blind = toxicity.Scorer.context
    try:
        toxicity.Scorer.context = staticmethod(lambda split, i: "plain")
        without = right()
    finally:
        toxicity.Scorer.context = blind
    assert with_context > 0.95 and without < 0.9


# op10


def site(host, n, seed, block):
    """Pages without an article element or telling names."""
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choices(WORDS, k=k))
    pages = []
    for i in range(n):
        title, paragraphs = text(5), [text(rng.randrange(20, 60)) for _ in range(rng.randrange(2, 6))]
        links = "".join(f"<li><a href=/{k}>{text(2)}</a>" for k in range(5))
        body = block(title, paragraphs)
        page = f"<html><body><div class=q1><ul>{links}</ul></div><div class=q2>{text(6)}</div>{body}<div class=q7>{text(8)}</div></body></html>"
        pages.append((f"http://{host}/{i}", page, "\n".join([title, *paragraphs])))
    return pages


def test_slots_of_a_template(spark):
    flat = site("a.example", 9, 1, lambda t, ps: f"<div class=q3><h2>{t}</h2>{''.join(f'<p>{p}</p>' for p in ps)}</div>")
    deep = site("b.example", 7, 2, lambda t, ps: f"<div class=q3><h2>{t}</h2><div class=q5>{''.join(f'<p>{p}</p>' for p in ps)}</div></div>")
    rows = [(i, *x) for i, x in enumerate(flat + deep)]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["text"], r["by_slot"]) for r in html.extract(df).collect()}
    assert got == {r[0]: (r[3], True) for r in rows}


def test_classes_by_brute_force(spark):
    pages = site("a.example", 9, 1, lambda t, ps: f"<div class=q3><h2>{t}</h2>{''.join(f'<p>{p}</p>' for p in ps)}</div>") + site("b.example", 4, 5, lambda t, ps: f"<section>{''.join(f'<p>{p}</p>' for p in ps)}</section>")
    vectors = {}
    for k, (url, page, _) in enumerate(pages):
        for path, n in Counter(e.path for e in html.blocks(page)[1]).items():
            vectors.setdefault((re.search("//([^/]+)", url)[1], path), [0] * len(pages))[k] = n
    together = Counter((host, tuple(v)) for (host, _), v in vectors.items())
    expected = {(host, path) for (host, path), v in vectors.items() if sum(map(bool, v)) > 1 and together[host, tuple(v)] > 1}
    df = spark.createDataFrame([(re.search("//([^/]+)", u)[1], p) for u, p, _ in pages], "host string, html string").repartition(4)
    found = html.classes(df).collect()
    assert {(r["host"], r["token"]) for r in found} == expected
    by_class = Counter((r["host"], r["vector"], r["pages"]) for r in found)
    assert sorted(by_class.values()) == sorted(n for (host, v), n in together.items() if n > 1 and sum(map(bool, v)) > 1)


def test_deep_pages_take_linear_room():
    import time
    import tracemalloc

    def cost(n):
        tracemalloc.start()
        began = time.process_time()
        text = html.main_text("<div>" * n + "x" + "<i>y</div>" * n)
        took, peak = time.process_time() - began, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert text.startswith("xy") and text.count("y") == n
        return took, peak

    (_, small), (took, large) = cost(4_000), cost(40_000)
    assert large < 15 * small and took < 60


def test_slots_beyond_broadcasts(spark, monkeypatch):
    pages = site("a.example", 12, 3, lambda t, ps: f"<div class=q3><h2>{t}</h2>{''.join(f'<p>{p}</p>' for p in ps)}</div>")
    df = spark.createDataFrame([(i, u, p) for i, (u, p, _) in enumerate(pages)], "page_id bigint, url string, html string")
    before = values(html.extract(df).collect())
    monkeypatch.setattr(html, "BROADCAST_TOKENS", 0)
    assert values(html.extract(df).collect()) == before
