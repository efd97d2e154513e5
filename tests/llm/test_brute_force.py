"""The text operators against brute force on small tables that hold nulls, empty texts, repeats and clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def _words(text, lower=False):
    raw = (text or "").encode()
    if lower:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    return WORD.findall(raw)


def _texts(n=120, seed=4):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    out = []
    for _ in range(n):
        kind = r.random()
        if out and kind < 0.15:
            out.append(out[r.randrange(len(out))])
        elif out and kind < 0.45:
            words = (out[r.randrange(len(out))] or "").split(" ")
            for _ in range(r.randint(1, 4)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            out.append(" ".join(words))
        else:
            out.append(" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 30, 90, 200]))))
    shared = " ".join(r.choice(vocabulary) for _ in range(45))
    for i in range(0, n, 9):
        out[i] = f"{out[i]} {shared} {r.choice(vocabulary)}"
    return [*out, None, "", " \t\n", "One", "one", "A\x0bb  C\r\nd", None]


def _docs(spark, texts=None):
    texts = _texts() if texts is None else texts
    langs = ["en", "fr", None]
    rows = [(i, t, langs[i % 3], ["s1", "s2", None, "s3"][min(3, i % 7)], len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string")


def _empty(spark):
    return _docs(spark).limit(0)


# ---- 1


def _shingles(text, k):
    w = _words(text, True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    from quadrille.llm.minhash import near_duplicates

    texts = _texts()
    sets = [_shingles(t, k) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.doc_id: r for r in near_duplicates(_docs(spark), k, percent).collect()}
    assert {i: got[i].component_id for i in got} == {i: find(i) for i in range(len(texts))}
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (find(i) == i) for i in got)


def test_near_duplicates_of_nulls_and_nothing(spark):
    from quadrille.llm.minhash import near_duplicates

    assert near_duplicates(_empty(spark)).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (7, "a b c d e f")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(3, 3, True), (3, 3, True), (7, 3, False)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, False)]


def test_near_duplicates_of_repeated_ids_ties_and_long_texts(spark):
    from quadrille.llm.minhash import near_duplicates

    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    long = words(0, 60_000)
    rows = [(1, words(0, 50)), (2, words(100, 150)), (5, words(0, 50)), (5, words(100, 150)), (7, long), (8, long + " more"), (9, words(0, 50).upper())]
    for _ in range(2):
        got = sorted((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect())
        assert [x[:3] for x in got] == [(1, 1, True), (2, 1, False), (5, 1, False), (5, 1, False), (7, 7, True), (8, 7, False), (9, 1, False)]
        assert got[4][3] == 59_998
        rows.reverse()
    alike = near_duplicates(spark.createDataFrame([(i, "all of one text here") for i in range(300)], "doc_id long, text string")).collect()
    assert {r.component_id for r in alike} == {0} and sum(r.kept for r in alike) == 1


def test_recall_of_links_on_the_test_table(spark):
    """All pairs of the documents whose ids are divisible by 20 with all documents."""
    from quadrille.llm.minhash import near_duplicates

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: _shingles(r.text, 3) for r in docs.collect()}
    component = {r.doc_id: r.component_id for r in near_duplicates(docs, 3, 85).collect()}
    links = 0
    for i in (i for i in sets if i % 20 == 0):
        for j, other in sets.items():
            if i != j and sets[i] and other and 100 * len(sets[i] & other) >= 85 * len(sets[i] | other):
                links += 1
                assert component[i] == component[j]
    assert links > 5


def test_a_chain_of_copies_is_one_component(spark):
    from quadrille.llm.minhash import near_duplicates

    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words)))
        words = words[:6 * i] + [f"n{i}_{j}" for j in range(6)] + words[6 * i + 6 :]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.component_id for r in got} == {0}


# ---- 2


def test_language(spark, sf):
    from quadrille.llm.language_id import accepted, fit, predict

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = fit(docs.where(~held))
    rows = predict(docs, model).join(docs, "doc_id").where(held & F.col("lang").isNotNull() & (F.length("text") > 40)).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.93
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the end of it")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] != "und" and 0 < got[4][1] <= 1
    again = {r.doc_id: r.score for r in predict(odd, fit(docs.where(~held))).collect()}
    assert again[4] == got[4][1]
    wide = docs.withColumn("c0", F.lit(1)).withColumn("id", F.lit("q"))
    assert accepted(wide, model).columns == wide.columns
    assert fit(docs.limit(0)).langs == [] and predict(docs.limit(0), model).count() == 0


def test_texts_of_unlearned_languages_are_rejected(spark, sf):
    from quadrille.llm.language_id import accepted, fit

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    foreign = ["Быстрая коричневая лиса прыгает через ленивую собаку и бежит домой", "素早い茶色の狐がのろまな犬を飛び越える", "Nopea ruskea kettu hyppää laiskan koiran yli ja juoksee kotiin metsään", "Szybki brązowy lis przeskakuje nad leniwym psem i biegnie do domu", "xq zvbk wrtp qqjx kzzw pfgh bnmk xcvb qwrt zxcv"]
    odd = spark.createDataFrame(list(enumerate(foreign)), "doc_id long, text string")
    for langs in (("de", "en", "es", "fr"), ("en", "de")):
        known = docs.where(F.col("lang").isin(*langs) & (F.length("text") > 40))
        model = fit(known)
        assert accepted(odd, model).count() <= (0 if len(langs) == 4 else 3)
        assert accepted(known, model).count() >= 0.98 * known.count()


def test_a_long_text_scores_as_its_grams_do(monkeypatch):
    import pyarrow as pa

    from quadrille.llm import language_id as li

    model = li.train(["the cat sat on the mat with a hat"] * 20 + ["der hund lief durch den wald und bellte"] * 20, ["en"] * 20 + ["de"] * 20)
    text = pa.array([" ".join(["the dog, runs", "der hund", "99 x"] * 300)])
    whole = model.scores(text)
    for stretch in (7, 100, 1001):
        monkeypatch.setattr(li, "STRETCH", stretch)
        got = model.scores(text)
        assert got[0][0] == whole[0][0] and got[1][0] == pytest.approx(whole[1][0], abs=1e-9)


# ---- 3


def _removed(texts, window):
    seen, gone = set(), []
    for t in texts:
        w = _words(t)
        cut = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                cut[i : i + window] = [True] * window
            seen.add(key)
        gone.append(cut)
    return gone


def test_passages(spark, monkeypatch):
    from quadrille.llm import chunks, substring_dedup

    texts = [*_texts(), " ".join(["spin"] * 60), " ".join(["a", "b"] * 40)]
    gone = _removed(texts, 20)
    for size in (1 << 30, 4000):
        monkeypatch.setattr(chunks.chunk_count, "__defaults__", (size,))
        got = {r.doc_id: r for r in substring_dedup.passages(_docs(spark, texts)).collect()}
        for i, t in enumerate(texts):
            w = _words(t)
            kept = b" ".join(x for x, g in zip(w, gone[i], strict=True) if not g)
            assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone[i]), hashlib.sha256(kept).hexdigest())
    assert sum(map(sum, gone)) > 500
    assert substring_dedup.passages(_empty(spark)).count() == 0
    cut = {r.doc_id: r.text for r in substring_dedup.remove_repeats(_docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert (cut[i] is None) == (t is None)
        assert _words(cut[i]) == [x for x, g in zip(_words(t), gone[i], strict=True) if not g]
        assert any(gone[i]) or cut[i] == t


def test_passages_of_odd_rows(spark):
    from quadrille.llm.substring_dedup import passages, remove_repeats

    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    long = words(0, 40_000)
    rows = [(None, words(0, 30), 1), (None, words(0, 30), 2), (3, words(5, 40), 3), (4, long, 4), (4, words(100, 130), 5), (4, words(500, 519), 6), (9, None, 7), (9, "", 8)]
    for _ in range(2):
        docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed) for r in passages(docs).collect())
        by_hash = {r.n: r.h for r in spark.createDataFrame([(len(t.split()), t) for t in (long, words(100, 130))], "n int, t string").select("n", F.xxhash64("t").alias("h")).collect()}
        short_first = by_hash[30] < by_hash[40_000]  # rows of one id are in the order of hashes of their texts
        cut = 40 + 30 * short_first  # w0 to w39 stand before
        assert got == sorted([(-1, 30, 0), (-1, 30, 0), (3, 35, 25), (4, 40_000, cut), (4, 30, 0 if short_first else 30), (4, 19, 0), (9, 0, 0), (9, 0, 0)])
        rows.reverse()
    clash = docs.withColumn("id", F.lit(1)).withColumn("th", F.lit("x")).withColumn("c0", F.array(F.lit(2)))
    assert remove_repeats(clash).columns == [*clash.columns, "n_words", "n_removed"] and remove_repeats(clash).count() == len(rows)


def test_a_span_is_cut_only_if_its_source_has_its_words():
    from quadrille.llm.substring_dedup import _digest, _gone

    words = [f"w{i}".encode() for i in range(50)]
    right, wrong = {"at": 5, "words": 25, "digest": _digest(words[5:30])}, {"at": 20, "words": 25, "digest": _digest(words[21:46])}
    assert _gone(b" ".join(words), [right, wrong]).tolist() == [5 <= i < 30 for i in range(50)]


# ---- 4


def test_mixing(spark):
    from quadrille.llm.mixing import mix, mix_counts

    texts = _texts()
    docs = _docs(spark, texts)
    got = mix_counts(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes = {i: len(_words(t)) for i, t in enumerate(texts)}
    assert {r.doc_id: r.size for r in got} == sizes
    per = Counter()
    for i, n in sizes.items():
        per[source[i]] += n
    order = sorted((s for s in per if s is not None)) + [s for s in per if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, budget = set(), sum(per.values())
    while True:
        rest = [s for s in order if s not in full]
        level = (budget - sum(3 * per[s] for s in full)) / sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * level > 3 * per[s]]
        if not over:
            break
        full |= set(over)
    target = {s: 3.0 * per[s] if s in full else weight[s] * level for s in order}
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == per[source[r.doc_id]]
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(sizes.values())
    copies = mix(docs)
    assert copies.columns == [*docs.columns, "mix_copy", "mix_finish"]
    assert Counter(r.doc_id for r in copies.collect()) == Counter({r.doc_id: r.taken // r.size for r in got if r.taken})
    assert mix_counts(_empty(spark)).count() == 0 and mix(_empty(spark)).count() == 0
    assert sorted(map(tuple, mix_counts(docs).collect())) == sorted(map(tuple, got))


def test_mixing_sql(spark, sf, duck):
    from quadrille.llm.queries import op4_mixing, oracle_sql

    got = {r.doc_id: (r.size, r.source_size, round(r.target, 6), r.taken) for r in op4_mixing(spark, sf).collect()}
    want = {r[0]: (r[1], r[2], round(r[3], 6), r[4]) for r in duck.execute(oracle_sql()["op4_mixing"]).fetchall()}
    assert got == want


# ---- 5


def _ctw(texts, train, depth):
    """Scores by recursion over dictionaries, one decision at a time."""
    counts = defaultdict(lambda: [0, 0])

    def decisions(text):
        data = b" ".join(_words(text, True)) + b"\n"
        for i, c in enumerate(data):
            context = (b"\0" * depth + data[:i])[-depth:]
            for b in range(8):
                yield context, (1 << b) | (c >> (8 - b)), c >> (7 - b) & 1

    for t, use in zip(texts, train, strict=True):
        if use:
            for context, node, bit in decisions(t):
                for d in range(depth + 1):
                    counts[context[depth - d :], node][bit] += 1
    children = defaultdict(list)
    for context, node in counts:
        if context:
            children[context[1:], node].append(context)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    weight, pw = {}, {}
    for context, node in sorted(counts, key=lambda x: -len(x[0])):
        pe = kt(*counts[context, node])
        if len(context) == depth:
            pw[context, node] = pe
            continue
        below = sum(pw[c, node] for c in children[context, node])
        most = max(pe, below)
        pw[context, node] = most + math.log(0.5 * math.exp(pe - most) + 0.5 * math.exp(below - most))
        weight[context, node] = 0.5 * math.exp(pe - pw[context, node])
    out = []
    for t in texts:
        total = 0.0
        for context, node, bit in decisions(t):
            p = None
            for d in range(depth, -1, -1):
                key = context[depth - d :], node
                if key in counts:
                    n = counts[key]
                    q = (n[bit] + 0.5) / (sum(n) + 1)
                    p = q if p is None else weight[key] * q + (1 - weight[key]) * p
            total += math.log10(0.5 if p is None else p)
        out.append(total)
    return out


def test_context_tree(spark):
    from quadrille.llm.context_tree import scores

    texts = [t and t[:400] for t in _texts(40)]
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(texts))]
    c = Counter()
    for t, use in zip(texts, train, strict=True):
        if use:
            c.update(_words(t, True))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    learns = lambda i: F.crc32(i.cast("string").cast("binary")) % 5 != 1
    for depth in (3, 4):
        want = _ctw(texts, train, depth)
        for size in (1 << 30, 3000):
            got = {r.doc_id: r for r in scores(_docs(spark, texts), learns, depth=depth, chunk_bytes=size).collect()}
            for i, t in enumerate(texts):
                tokens = [*_words(t, True), None]
                r = got[i]
                assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train[i], len(tokens), sum(c[w] > 0 for w in tokens), n)
                assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), abs=1e-6)
                assert r.score == pytest.approx(want[i], rel=1e-4, abs=1e-3)
    assert scores(_empty(spark), learns).count() == 0
    blind = scores(_docs(spark, ["ab", None]), lambda i: F.lit(False)).orderBy("doc_id").collect()
    assert [round(r.score / math.log10(2)) for r in blind] == [-24, -8] and blind[0].train_tokens == 0


# ---- 6


def test_audio_round_trip(spark):
    from quadrille.llm.mpeg_audio import carry, digest, padded, parse, recover

    texts = [*_texts(30), "x" * 192, "é" * 5000]
    got = {r.doc_id: r for r in digest(_docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = padded(raw)
        assert len(payload) % 192 == 0 and len(payload) > 0 and payload.rstrip(b" ") == raw.rstrip(b" ")
        media = carry(payload, len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
    media = carry(padded(b"q" * 1000), 1000)
    s = parse(b"junk" + media + b"\xff\xfb garbage")
    assert len(s.offsets) == 6 and s.vbr["frames"] == 6 and s.samples == 6 * 1152 and s.bad_checks == 0 and s.seconds == 6 * 1152 / 32000
    broken = bytearray(media)
    broken[-216 + 10] ^= 1  # side information of the last frame
    assert parse(bytes(broken)).bad_checks == 1
    with pytest.raises(ValueError):
        recover(bytes(broken))
    assert parse(None).samples == parse(b"").samples == parse(b"no audio at all").samples == 0
    assert digest(_empty(spark)).count() == 0


# ---- 7


def test_urls(spark):
    from quadrille.llm.url_rules import RULES, judge

    urls = [None, "", "nothing", "http://", "HTTP://A.NET/es/1", "http://a.net/es", "http://net/fr/x?y#z", "http://ornet/fr/", "x://Example.COM/en/9", "x://www.example.com/en/9", "x://b.www.example.com/en/", "x://badexample.com/en/", "x://example.com?q=/en/", "x://org.org/en/://net/es/", "x://net/es/", "x://net/es/"]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for r in judge(rows).collect():
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in host)
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2])
    labels = spark.createDataFrame([(i, "spam" in u) for i, u in enumerate(["x://spam.org/a/1"] * 20 + ["x://fine.org/a/1"] * 30)], "id long, blocked boolean")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["x://spam.org/a/1"] * 20 + ["x://fine.org/a/1"] * 30 + ["x://sub.spam.org/z", "x://else.org/a/1"])], "page_id long, url string")
    got = {r.page_id: r.verdict for r in judge(pages, labels).collect()}
    assert got[0] == got[50] == "block" and got[20] == got[51] == "allow"
    assert judge(pages.limit(0), labels).count() == 0 and judge(pages, labels.limit(0)).where("verdict = 'block'").count() == 0


# ---- 8


def test_url_rules_need_no_share_of_the_corpus(spark):
    from quadrille.llm.url_rules import judge, mine

    # 12 of 4000 labelled pages are on a host that is blocked throughout, 12 under a path that is blocked on one host only
    urls = [(f"x://h{i % 40}.org/{'a' if i % 2 else 'b'}/{i}", i // 40 % 10 == 0) for i in range(4000)] + [(f"x://bad.org/p/{i}", True) for i in range(12)]
    urls += [(f"x://half.org/good/{i}", False) for i in range(60)] + [(f"x://half.org/spam/{i}", True) for i in range(12)] + [(f"x://other.org/spam/{i}", False) for i in range(60)]
    urls += [(f"x://few.org/{i}", True) for i in range(3)]
    new = ["x://bad.org/new", "x://half.org/spam/new", "x://half.org/new", "x://other.org/spam/new", "x://few.org/new", "x://h0.org/b/new"]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)] + [(10_000 + i, u) for i, u in enumerate(new)], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(urls)], "id long, blocked boolean")
    got = {r.page_id: r.verdict for r in judge(pages, labels, rules=()).collect()}
    assert [got[10_000 + i] for i in range(len(new))] == ["block", "block", "allow", "allow", "allow", "allow"]
    rules = {tuple(sorted(r.antecedent)): (r.n, r.confidence) for r in mine(spark.createDataFrame(urls, "url string, blocked boolean")).collect()}
    assert rules[("h:bad.org",)] == (12, 1.0) and rules[("h:half.org", "p:spam")] == (12, 1.0)


def test_mined_rules_are_all_that_the_evidence_proves(spark):
    """Against all combinations of tokens, with the same proof by Chernoff's bound."""
    from itertools import combinations

    from quadrille.llm.url_rules import CHANCE, MIN_CONFIDENCE, mine, tokens_of

    r = random.Random(5)
    urls = [f"x://h{r.randrange(4)}.org/{r.choice('abc')}/{r.choice('de')}" for _ in range(600)]
    blocked = [(u, "h1.org/a/" in u or (u.endswith("/b/d") and "h2" in u) or r.random() < 0.02) for u in urls]
    frame = spark.createDataFrame(blocked, "url string, blocked boolean")
    sets = [(set(x.t), x.blocked) for x in frame.select(tokens_of(F.col("url")).alias("t"), "blocked").collect()]
    base = sum(b for _, b in sets) / len(sets)

    def proven(n, bad):
        p = bad / n
        rest = (1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0
        return p >= MIN_CONFIDENCE and p > base and n * (p * math.log(p / base) + rest) >= -math.log(CHANCE)

    every = sorted(set().union(*(t for t, _ in sets)))
    rules = [set(c) for size in (1, 2, 3, 4) for c in combinations(every, size) for held in [[b for t, b in sets if set(c) <= t]] if held and proven(len(held), sum(held))]
    mined = [set(x.antecedent) for x in mine(frame).collect()]
    assert mined and all(m in rules for m in mined)
    fits = lambda t, found: any(x <= t for x in found)
    assert [fits(t, mined) for t, _ in sets] == [fits(t, rules) for t, _ in sets]


def test_long_urls_end(spark):
    from quadrille.llm.url_rules import judge

    r = random.Random(1)
    path = lambda n: "/".join(f"p{i}" for i in range(60) if r.random() < n)
    urls = [(f"x://spam.org/{path(0.9)}", True) for _ in range(40)] + [(f"x://spam.org/{path(0.5)}", False) for _ in range(60)] + [(f"x://h{i}.org/{path(0.3)}", False) for i in range(300)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(urls)], "id long, blocked boolean")
    got = {x.page_id: x.verdict for x in judge(pages, labels, rules=()).collect()}
    assert len(got) == len(urls) and sum(got[i] == "block" for i in range(40)) >= 36


def _proven(tokens, blocked):
    """All proven combinations of tokens, as {combination: (n, confidence)}, one token after the other."""
    from quadrille.llm.url_rules import CHANCE, MIN_CONFIDENCE

    base = sum(blocked) / len(blocked)
    bits = {x: sum(1 << i for i, t in enumerate(tokens) if x in t) for x in sorted(set().union(*tokens))}
    bad_bits = sum(1 << i for i, b in enumerate(blocked) if b)
    found, todo = {}, [((), (1 << len(tokens)) - 1)]
    while todo:
        head, rows = todo.pop()
        for x, own in bits.items():
            if head and x <= head[-1]:
                continue
            n, bad = (rows & own).bit_count(), (rows & own & bad_bits).bit_count()
            if bad * -math.log(base) < -math.log(CHANCE):
                continue
            p = bad / n
            rest = (1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0
            if p >= MIN_CONFIDENCE and p > base and n * (p * math.log(p / base) + rest) >= -math.log(CHANCE):
                found[frozenset((*head, x))] = n, p
            todo.append(((*head, x), rows & own))
    return found


def test_rules_of_common_tokens_in_long_urls(spark):
    """Three common tokens are proven together only, in urls of more rare tokens than FP-growth is given."""
    from quadrille.llm.url_rules import MOST_ITEMS, judge, mine, tokens_of

    r = random.Random(3)
    path = lambda: "/".join([x for x in "abc" if r.random() < 0.45] + [f"n{i}" for i in range(60) if r.random() < 0.3])
    # half of the urls are as short as FP-growth takes them
    paths = [path() if i % 2 else "/".join(path().split("/")[:9]) for i in range(400)]
    urls = [(f"x://h.org/{p}", {"a", "b", "c"} <= set(p.split("/"))) for p in paths]
    new = [f"x://h.org/{path()}" for _ in range(150)] + [f"x://h.org/{x}/n1" for x in ("a/b", "c/b/a", "b/c")]
    frame = spark.createDataFrame(urls, "url string, blocked boolean")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([u for u, _ in urls] + new)], "page_id long, url string")
    tokens = {x.url: set(x.t) for x in pages.select("url", tokens_of(F.col("url")).alias("t")).collect()}
    assert sum(b and len(tokens[u]) - 2 > MOST_ITEMS for u, b in urls) >= 10
    rules = _proven([tokens[u] for u, _ in urls], [b for _, b in urls])
    assert frozenset(("p:a", "p:b", "p:c")) in rules and not any(len(x) == 1 for x in rules)
    mined = {frozenset(x.antecedent): (x.n, x.confidence) for x in mine(frame).collect()}
    assert mined and all(rules[k][0] == n and abs(rules[k][1] - p) < 1e-12 for k, (n, p) in mined.items())
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(urls)], "id long, blocked boolean")
    got = {x.page_id: x.verdict for x in judge(pages, labels, rules=()).collect()}
    every = [u for u, _ in urls] + new
    assert [got[i] == "block" for i in range(len(every))] == [any(k <= tokens[u] for k in rules) for u in every]


@pytest.mark.parametrize("most", [0, 3, 100])
def test_rules_do_not_depend_on_what_fp_growth_is_given(spark, monkeypatch, most):
    from quadrille.llm import url_rules

    monkeypatch.setattr(url_rules, "MOST_ITEMS", most)
    r = random.Random(8)
    urls = [f"x://h{r.randrange(4)}.org/{r.choice('abc')}/{r.choice('dexy')}/{r.choice('fgvw')}" for _ in range(800)]
    blocked = ["h1.org/a/" in u or "/b/d/f" in u or r.random() < 0.02 for u in urls]
    frame = spark.createDataFrame(list(zip(urls, blocked)), "url string, blocked boolean")
    tokens = [set(x.t) for x in frame.select(url_rules.tokens_of(F.col("url")).alias("t")).collect()]
    rules = _proven(tokens, blocked)
    mined = {frozenset(x.antecedent): x.n for x in url_rules.mine(frame).collect()}
    assert {frozenset(("h:h1.org", "p:a")), frozenset(("p:b", "p:d", "p:f"))} <= set(mined) and all(rules[k][0] == n for k, n in mined.items())
    fits = lambda found: [any(k <= t for k in found) for t in tokens]
    assert fits(mined) == fits(rules)


def test_tokens_of_the_same_urls_stand_for_each_other(spark):
    from quadrille.llm.url_rules import judge

    urls = [(f"x://half.org/spam/extra/{i}", True) for i in range(12)] + [(f"x://half.org/good/{i}", False) for i in range(60)] + [(f"x://other.org/spam/extra/{i}", False) for i in range(60)]
    new = ["x://half.org/spam/new", "x://half.org/extra/new", "x://half.org/new", "x://other.org/spam/new", "x://new.org/extra/spam"]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)] + [(1000 + i, u) for i, u in enumerate(new)], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(urls)], "id long, blocked boolean")
    got = {x.page_id: x.verdict for x in judge(pages, labels, rules=()).collect()}
    assert [got[1000 + i] for i in range(len(new))] == ["block", "block", "allow", "allow", "allow"]
    assert [got[i] == "block" for i in range(len(urls))] == [b for _, b in urls]


def test_main_text(spark):
    from quadrille.llm.html_text import extract, main_text

    page = lambda body: f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a>Home</a></nav>{body}<footer>foot</footer><script>var a='<p>no</p>'</script></body></html>"
    assert main_text(page("<article><h1>A &amp; B</h1><p>one\n  <b>two</b> &eacute;</p><aside>ad</aside><div class='comments'>hi</div></article>")) == "A & B\none two é"
    assert main_text(None) == main_text("") == "" and main_text("<p>a < b") == "a < b" and main_text("<p>x<p>y<br>z") == "x\ny\nz"
    rows = [(i, f"http://one.org/{i}", page(f"<div class=top>Same words</div><div class=body><p>text {i}</p></div>")) for i in range(8)]
    rows += [(90, None, None), (91, "http://alone.org/", page("<p>only</p>")), (92, "http://one.org/1", rows[1][2])]
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].text for i in range(8)] == [f"text {i}" for i in range(8)] and got[92].text == "text 1"
    assert got[90].text == "" and got[91].text == "only" and all(r.n_chars == len(r.text) for r in got.values())


# ---- 9


def test_template_inside_articles(spark):
    from quadrille.llm.html_text import extract

    page = lambda *own: f"<html><body><article>{''.join(f'<p>{x}</p>' for x in own)}<div class=tools>Tell a friend</div><p>Write to us</p></article></body></html>"
    rows = [(i, f"http://one.org/{i}", page(f"words of text {i} and of no other page", "a line of two pages" if i < 2 else "")) for i in range(12)]
    copies = [("copied words of one article", "that stand on every page", f"but for its number {i}") for i in range(12)]
    rows += [(100 + i, f"http://two.org/{i}", f"<article>{''.join(f'<p>{x}</p>' for x in c)}</article>") for i, c in enumerate(copies)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(12)] == [f"words of text {i} and of no other page" + "\na line of two pages" * (i < 2) for i in range(12)]
    assert [got[100 + i] for i in range(12)] == ["\n".join(c) for c in copies]


def test_pages_of_labelled_content(spark):
    """120 pages of three hosts whose templates differ; what each page's article says is known. Another template gives another text."""
    from quadrille.llm.html_text import _mark, block_key, extract, framed, text_of

    r = random.Random(9)
    vocabulary = [f"{a}{b}" for a in ("lo", "ma", "ti", "ke", "su", "ra") for b in ("n", "ra", "vel", "mit", "so")]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows, want = [], {}
    for i in range(120):
        host, own = i % 3, [line(r.randint(4, 40)) for _ in range(r.randint(1, 6))]
        want[i] = "\n".join(own)
        if host == 0:
            body = f"<nav><a>Home</a></nav><article><div class=x>Posted by the desk</div>{''.join(f'<p>{x}</p>' for x in own)}<p>Tell your friends</p></article>"
        elif host == 1:
            body = f"<div class=top>One of our pages</div><div class=text>{''.join(f'<p>{x}</p>' for x in own)}</div><div class=end>All rights kept</div>"
        else:
            body = f"<table><tr><td>Menu of it</td></tr></table><div class=c{'<b>' * 0}>{''.join(f'<p>{x}' for x in own)}</div><footer>end</footer>"
        rows.append((i, f"http://host{host}.org/{i}", f"<html><body>{body}</body></html>"))
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in extract(docs).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want), [(got[i], want[i]) for i in want if got[i] != want[i]][:3]
    held = framed(rows[0][2])[1]
    bare = text_of(held)
    assert bare != got[0] and text_of(held, frozenset({block_key(held[1][1][0], _mark(held[1][1][1]))})) != bare
    odd = docs.limit(0)
    assert extract(odd).count() == 0
    wide = docs.withColumn("kind", F.lit("q")).withColumn("host", F.lit(1)).withColumn("id", F.lit(2))
    assert {x.page_id: x.text for x in extract(wide).collect()} == got
    long = spark.createDataFrame([(1, "http://l.org/", "<p>" + "</p><p>".join(f"word {i}" for i in range(50_000)))], "page_id long, url string, html string")
    assert extract(long).first().text.count("\n") == 49_999


def test_every_kind_of_page_has_pilots(spark):
    from quadrille.llm.html_text import extract

    kinds = [lambda i, k=k: f"<html><body><div class=top{'abcdefgh'[k]}><p>Menu of kind {k}</p></div><div class=body{'abcdefgh'[k]}><p>text {i}</p></div></body></html>" for k in range(8)]
    rows = [(i, f"http://one.org/{i}", kinds[i % 8](i)) for i in range(64)]
    rows += [(100 + i, "http://two.org/", "<div class=top>Menu</div><div class=body>copied</div>") for i in range(40)] + [(200 + i, "http://two.org/", f"<div class=top>Menu</div><div class=body>own {i}</div>") for i in range(3)]
    rows += [(300 + i, "http://three.org/", f"<div class=top>Menu</div><div class={'xyz'[i]}>alone {i}</div>") for i in range(3)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(64)] == [f"text {i}" for i in range(64)]
    assert {got[100 + i] for i in range(40)} == {"copied"} and [got[200 + i] for i in range(3)] == [f"own {i}" for i in range(3)]
    assert [got[300 + i] for i in range(3)] == [f"alone {i}" for i in range(3)]


def test_tree_matching_is_the_heaviest(monkeypatch):
    from quadrille.llm import html_text

    def weight(x, y):
        if isinstance(x, str) or isinstance(y, str):
            return 0 if isinstance(x, list) or isinstance(y, list) else 1 + (x == y)
        if x[0] != y[0]:
            return 0
        table = [[0] * (len(y[1]) + 1) for _ in range(len(x[1]) + 1)]
        for i, u in enumerate(x[1]):
            for j, v in enumerate(y[1]):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + weight(u, v))
        return 1 + table[-1][-1]

    def tree(r, depth):
        return [r.choice("ab"), [r.choice("stuvw") if not depth or r.random() < 0.5 else tree(r, depth - 1) for _ in range(r.randrange(6))]]

    r = random.Random(3)
    for table, few in ((250_000, 400), (250_000, 0), (4, 0)):
        monkeypatch.setattr(html_text, "TABLE", table)
        monkeypatch.setattr(html_text, "FEW", few)
        for _ in range(150):
            x, y = ["r", tree(r, 3)[1]], ["r", tree(r, 3)[1]]
            w = html_text._Weights()
            pairs, stack = 0, [(x, y)]
            while stack:
                u, v = stack.pop()
                pairs += 1 if isinstance(u, list) else 1 + (u == v)
                stack += html_text._pairs(u[1], v[1], w) if isinstance(u, list) else []
            assert w.of(x, y) == pairs == weight(x, y)


def test_tree_matching_of_long_rows():
    from quadrille.llm.html_text import matched

    rows = lambda texts: ["#root", [["ul", [["li", [x]] for x in texts]]]]
    same = [f"s{i}" for i in range(900)]
    got = list(matched(rows(["x", *same, "y"]), rows([*same, "z", "end"])))
    assert sum(x[1] for x in got) == 900


def test_decontamination(spark):
    from quadrille.llm.decontaminate import clean, contaminated

    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in (5, 12, 30, 60)] + ["Too short", None, "", "w1"]
    texts = [*_texts(30), "one is too short.", "what is TOO  short is", "too", "w11 w2"]
    for i, item in enumerate(items[:4]):
        w = item.split()
        noisy = [x if k % 29 else "zz" for k, x in enumerate(w, 1)]
        pad = lambda: " ".join(r.choice(vocabulary) for _ in range(20))
        texts += [f"{pad()} {item.upper()} {pad()}", f"{pad()} {' '.join(noisy)} {pad()}", item, " ".join(w[: len(w) // 2]), f"{item} {item}"]
    k = 5

    def similarity(a, b):
        x, y = Counter(a), Counter(b)
        return sum((x & y).values()) / max(1, sum((x | y).values()))

    want = {}
    for d, t in enumerate(texts):
        w = _words(t, True)
        for j, item in enumerate(items):
            v = _words(item, True)
            if not v or not w:
                continue
            if len(v) < k:
                if any(w[s : s + len(v)] == v for s in range(len(w))):
                    want[d, j] = 1.0
                continue
            sh = lambda u: [tuple(u[i : i + k]) for i in range(len(u) - k + 1)]
            best = max(similarity(sh(w[s : s + len(v)]), sh(v)) for s in range(max(1, len(w) - len(v) + 1)))
            if best >= 0.8:
                want[d, j] = best
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in contaminated(_docs(spark, texts), bench).collect()}
    assert set(got) == set(want) and all(got[p] == pytest.approx(want[p]) for p in got)
    left = {x.doc_id for x in clean(_docs(spark, texts), bench).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in want}
    assert contaminated(_empty(spark), bench).count() == 0 and contaminated(_docs(spark), bench.limit(0)).count() == 0


def test_recall_of_decontamination_on_the_test_table(spark):
    from quadrille.llm.decontaminate import contaminated

    path = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    sh = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    items = {r.item_id: _words(r.text, True) for r in bench.collect()}
    holders = defaultdict(set)
    for j, v in items.items():
        for x in sh(v):
            holders[x].add(j)
    want = set()
    for r in docs.where("doc_id % 2 = 0").collect():
        w = _words(r.text, True)
        for j in set().union(*(holders.get(x, set()) for x in sh(w))):
            v = items[j]
            own = Counter(sh(v))
            for s in range(max(1, len(w) - len(v) + 1)):
                x = Counter(sh(w[s : s + len(v)]))
                if 5 * sum((x & own).values()) >= 4 * sum((x | own).values()):
                    want.add((r.doc_id, j))
                    break
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert {x for x in got if x[0] % 2 == 0} == want and len(want) > 2


def test_clean_drops_only_the_rows_that_hold_an_item(spark):
    from quadrille.llm.decontaminate import clean, contaminated

    item = "one two three four five six seven eight"
    rows = [(None, f"so {item} it is", 1), (None, "nothing of the kind at all here", 2), (3, item, 3), (3, "another text of this id", 4), (4, None, 5), (5, "", 6), (6, "x " * 50_000 + item, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _bad int").withColumn("doc", F.lit(1)).withColumn("mark", F.lit("m"))
    bench = spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")
    left = clean(docs, bench)
    assert left.columns == docs.columns and sorted(r._bad for r in left.collect()) == [2, 4, 5, 6]
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == {(i, j) for i in (None, 3, 6) for j in (1, 2)}


# ---- 10


def test_token_counts(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quadrille.llm import token_counts as tc

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*_texts(60), "a  b \n c\t d", " lead", "trail ", "<|endoftext|> x<|endoftext|>", "x\u00a0y \u3000 z", "it's we'll 12 345", "\n\n a", "word " * 3000, "é" * 3000]
    want = [len(library.encode(t or "", add_special_tokens=False)) for t in texts]
    got = {r.doc_id: r for r in tc.count_tokens(_docs(spark, texts), path, limit=100).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert all(got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (want[i] > 100) for i, t in enumerate(texts))
    monkeypatch.setattr(tc, "TEXT_CHARS", 50)
    assert tc.count_texts(path, texts) == want
    solid = ["漢字かな交じり文。句点、" * 40, "var a=1;b=a+2;it's(c)" * 60, "ab12cd345" * 50, "x<|endoftext|>y." * 40, "a" * 400, "é1" * 200 + "  end"]
    assert tc.count_texts(path, solid) == [len(library.encode(t, add_special_tokens=False)) for t in solid]
    assert max(len(x) for _, x in tc._stretches(solid[0])) < 200 and max(len(x) for _, x in tc._stretches(solid[1])) < 200
    piece = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece)
    assert tc.count_texts(piece, texts[:20]) == [len(model.encode(t or "")) for t in texts[:20]]
    assert tc.count_tokens(_empty(spark), path).count() == 0


# ---- the pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[: len(names)] == names
        if name != "mixing":
            assert out.columns == names and out.count() <= docs.count() and out.select("doc_id").distinct().count() == out.count()
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() > 0


def test_pipeline_with_odd_rows(spark, sf):
    import corpus_pipeline as cp

    rows = [(None, "the same old words again and again for good", "en", "s", 11), (7, "another text of one id that stands twice here", "en", "s", 12), (7, "one more text of one id, not the same", "en", "s", 13), (None, "the same old words again and again for good", "en", "s", 10), (None, None, None, None, 0), (1, "", "en", "s", 0), (2, "the same old words again and again for good", "en", None, 3), (2, "the same old words again and again for good", "en", None, 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in cp.STAGES:
            out = stage(spark, docs, sf)
            if name == "near_dedup" and data:
                assert sorted(r.doc_id for r in out.where("doc_id is not null").collect()) == sorted({r.doc_id for r in docs.where("doc_id is not null").collect()})
                assert out.where("doc_id is null and text is not null").count() <= docs.where("doc_id is null and text is not null").distinct().count()
            docs = spark.createDataFrame(out.collect(), out.schema)
