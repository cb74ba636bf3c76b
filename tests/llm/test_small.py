"""Operators on small frames: brute force, round trips, and the odd cases (nulls, empties, repeats, clashes)."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from verisect.llm import ann, common, langid, mixing, neardup, pii, sentencepiece, sharding, simhash, token_counts, topk, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, fp string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows, clashing columns."""
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randrange(3, 120)), "en", f"s{i % 4}", 1, 7, "x") for i in range(60)]
    rows += [rows[3], rows[3], (200, rows[4][1], "en", "s0", 1, 1, "y"), (None, rows[5][1], None, None, None, None, None), (None, None, None, None, None, None, None), (201, None, "en", None, 0, 1, "z"), (202, "", "en", "s1", 0, 1, "z"), (203, "\n\t ", "en", "s1", 0, 1, "z"), (204, sentence(rng, 60_000), "en", "s2", 1, 1, "z"), (205, "x" * 300_000, "en", "s2", 1, 1, "z")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# -- SimHash -------------------------------------------------------------------------------------------------


def plain_fingerprint(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius):
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    order = sorted(parent)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if bin(a ^ b).count("1") <= radius:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in parent}


def test_simhash_fingerprints(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " \n", "one", "Ein zwei DREI", "É é A", sentence(rng, 40), "a b c d e f"]
    monkeypatch.setattr(simhash, "CHUNK_BYTES", 17)  # pieces of a text meet
    for t in texts:
        for n in (1, 4, 5):
            assert simhash.fingerprint(t, n) % (1 << 64) == plain_fingerprint(t, n), (t, n)


def test_simhash_components(spark, odd):
    got = simhash.near_duplicates(odd, 4, 4).collect()
    assert len(got) == odd.count()
    fps = {r.fp % (1 << 64) for r in got}
    label = plain_components(fps, 4)
    for r in got:
        ids = [x.doc_id for x in got if label[x.fp % (1 << 64)] == label[r.fp % (1 << 64)] and x.doc_id is not None]
        assert r.component_id == (min(ids) if ids else None)


@pytest.mark.parametrize("radius, options", [(4, {"leaf_rows": 20, "sample_rows": 200}), (9, {"leaf_rows": 20, "sample_rows": 200}), (4, {"leaf_rows": 20, "sample_rows": 200, "cell_rows": 30}), (0, {"leaf_rows": 50})])
def test_simhash_links_find_every_pair(spark, radius, options):
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 12))) for c in centres for _ in range(12)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = simhash.links(df, radius, **options)
    got = {r.fp % (1 << 64): r.label % (1 << 64) for r in simhash.components(edges).collect()}
    want = plain_components(fps, radius)
    groups = lambda m: sorted(sorted(f for f in fps if m.get(f, f) == k) for k in {m.get(f, f) for f in fps})
    assert groups(got) == groups(want)


def test_hot_keys_are_split(spark, monkeypatch):
    """A key of a third of all rows is dealt to several parts; the rows of the join are the same."""
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    found = spark.range(0, 900, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y")).unionByName(spark.createDataFrame([(7, 14)], "k long, y long"))
    hot = common.hot_keys(rows, "k")
    assert [r.k for r in hot.collect()] == [7]
    key = lambda df: sorted((r.k, r.x, r.y) for r in df.collect())
    split = common.salted(rows, found, "k", "x", hot)
    assert key(split) == key(rows.join(found, "k")) and split.columns == ["k", "x", "y"]
    assert common.hot_keys(rows.filter("x % 3 > 0"), "k") is None
    assert common.hot_keys(rows.limit(0), "k") is None


def test_no_frames_of_local_rows(spark, monkeypatch):
    """Hot keys and the grid of full shards stay tables; frames of local rows run Python workers of their own."""
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    plan = lambda df: df._jdf.queryExecution().toString()
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    assert "ExistingRDD" not in plan(common.hot_keys(rows, "k"))
    fps = spark.range(200).select((F.col("id") * 31).alias("fp"))
    links = simhash.links(fps, 4, leaf_rows=20, sample_rows=200, cell_rows=30)
    assert "ExistingRDD" not in plan(links) and "BroadcastHashJoin" in plan(links)


def test_encode_with_a_small_memo(spark, odd):
    """A memo of few words changes no ids; the pipeline's is smaller than that of encoding alone."""
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.ids or [], r.n_tokens) for r in df.collect())
    assert ids(sentencepiece.encode(odd, memo_words=8)) == ids(sentencepiece.encode(odd))
    assert corpus_pipeline.MEMO_WORDS < sentencepiece.MEMO_WORDS


def test_components_of_stars_and_chains(spark, monkeypatch):
    """A star of a third of all nodes, whose hub is in the middle of their numbers, and a chain."""
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    star = [(500, i) for i in range(300, 700) if i != 500]
    chain = [(i, i + 1) for i in range(1000, 1200)]
    edges = spark.createDataFrame([*star, *chain, (5, 5)], "u long, v long")
    got = {r.fp: r.label for r in simhash.components(edges).collect()}
    assert got == {**dict.fromkeys(range(300, 700), 300), **dict.fromkeys(range(1000, 1201), 1000)}


def test_near_duplicates_with_hot_bands(spark, monkeypatch):
    """Half of the texts are near copies of one, so its bands, pairs and label are hot."""
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    copies = [" ".join([*base[:-1], f"end{i}"]) for i in range(60)]
    others = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(80)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate([*copies, *others])), "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.keep_one(docs, 5, 4, 0.8).collect()) == [0, *range(60, 120)]


def test_keep_one(spark, odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    found = simhash.near_duplicates(odd)
    assert len(rows) == found.select("component_fp").distinct().count()
    assert len({r.text for r in rows if r.text}) == len([r for r in rows if r.text])
    assert simhash.keep_one(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_near_duplicates_are_those_of_brute_force(spark):
    rng = random.Random(14)
    rows = [(i, sentence(rng, 6)) for i in range(400)]  # unrelated texts of two shingles
    for k in range(60):  # one word changed of each: similarities from below 0.8 to 0.95
        words = sentence(rng, rng.randrange(40, 160)).split()
        rows.append((1000 + 2 * k, " ".join(words)))
        words[rng.randrange(5, len(words) - 5)] = f"changed{k}"
        rows.append((1001 + 2 * k, " ".join(words)))
    base = sentence(rng, 90).split()
    rows += [(2000 + k, " ".join([*base[:40], f"copy{k}", *base[41:]])) for k in range(30)]
    docs = spark.createDataFrame([*rows, (None, None), (3000, " "), (3001, ""), rows[0], (None, rows[1][1])], "doc_id long, text string")
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = []
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                near.append((i, j))
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert 30 < sum(i < 2000 and j == i + 1 for i, j in near) < 60
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == sorted([*{find(i) for i in sets}, 3000])


# -- SentencePiece -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return sentencepiece.Codec(sentencepiece.Vocabulary.load(), memo_words=8)


def slow_best(codec, text, scores):
    """Best score over all segmentations, by plain dynamic programming."""
    best = [0.0] + [float("-inf")] * len(text)
    for e in range(1, len(text) + 1):
        best[e] = best[e - 1] + codec.unknown
        for s in range(max(0, e - 20), e):
            if text[s:e] in scores:
                best[e] = max(best[e], best[s] + scores[text[s:e]])
    return best[-1]


def test_viterbi_is_best_and_round_trips(codec):
    vocabulary = sentencepiece.Vocabulary.load()
    scores, by_id = {p: s for p, _, s in vocabulary.pieces}, {i: (p, s) for p, i, s in vocabulary.pieces}
    rng = random.Random(2)
    texts = ["", " ", "  two  spaces ", "line\nend\n\n", "▁mark ▁▁", "日本語 text 🎉", "\x00\x01", "don't stop", sentence(rng, 80), "é" * 300] + ["".join(rng.choice("ab \n▁é🎉xyz.") for _ in range(40)) for _ in range(40)]
    for t in texts:
        ids = codec.encode(t)
        assert codec.decode(ids) == t
        if t and "▁" not in t:
            marked = "▁" + t.replace(" ", "▁")
            uncovered = [c for c in marked if c not in scores]
            got = sum(by_id[i][1] for i in ids if i in by_id) + codec.unknown * len(uncovered)
            assert got == slow_best(codec, marked, scores)
            assert ids == codec.viterbi(marked)


def test_encode_frame(spark, odd, none):
    rows = sentencepiece.encode(odd).collect()
    texts = {(r.doc_id, r.text and zlib.crc32(r.text.encode())) for r in odd.collect()}
    assert len(rows) == odd.count() and all((r.doc_id, r.text_crc32 if r.ids else (None if r.ids is None else "")) in texts for r in rows)
    back = sentencepiece.decode(sentencepiece.encode(odd)).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in back) == sorted((str(r.doc_id), r.text or "") for r in odd.collect())
    assert sentencepiece.encode(none).count() == 0


# -- sharding ------------------------------------------------------------------------------------------------


def check_shards(rows, shards):
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_sharding(spark, odd, none):
    rows = sharding.assign(odd, shards=3, ranges_per_shard=8).collect()
    assert len(rows) == odd.count()
    check_shards(rows, 3)
    assert sorted(r["size"] for r in rows) == sorted(len((r.text or "").encode()) + 8 for r in odd.collect())
    assert sharding.assign(none).count() == 0


def test_sharding_splits_hot_keys(spark):
    docs = spark.range(3000).select(F.when(F.col("id") < 1500, 1).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 1500, "same text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    rows = sharding.assign(docs, shards=4, ranges_per_shard=16).collect()
    check_shards(rows, 4)
    sizes = [sum(r["size"] for r in rows if r.shard == s) for s in range(4)]
    assert max(sizes) < 1.1 * min(sizes)


# -- personal data -------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def slow_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and slow_luhn(d or "0"), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_are_the_patterns():
    rng = random.Random(3)
    fixed = [None, "", "a@b.c_d@e.f", "x@y", "1.2.3.4.5.6.7.8", "300.1.1.1 0255.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (469) 555-8958 +12", "é@b.co a..@c.d.", "1" * 40, "@" * 30 + "a@b.c"]
    for t in fixed + ["".join(rng.choice("a@.-_ 0123456789+()é") for _ in range(60)) for _ in range(400)]:
        assert pii.base_spans(t) == slow_spans(t), t


def test_terms_that_reveal(spark, none):
    rng = random.Random(4)
    rows = [(i, sentence(rng, 60)) for i in range(300)]
    rows += [(1000 + i, f"{sentence(rng, 20)} Quixotic {WORDS[i]} me@corp.example.com {WORDS[i + 1]} {sentence(rng, 20)}") for i in range(6)]
    rows += [rows[-1], (None, None), (2000, ""), (2001, "Quixotic alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.detect(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        hit = r.doc_id is not None and 1000 <= r.doc_id < 2000
        assert r.n_email == int(hit) and (r.terms is not None) == hit
        if hit:
            text = dict(rows)[r.doc_id]
            assert "Quixotic" in [text[t.s : t.e] for t in r.terms]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs.withColumn("n_chars", F.lit(0)).withColumn("terms", F.lit(1))).collect()}
    assert "me@corp" not in clean[1000] and "Quixotic" not in clean[1000] and "<EMAIL>" in clean[1000]
    assert clean[2001] == "Quixotic alone" and clean[0] == rows[0][1]
    assert pii.detect(none).count() == 0 and pii.sanitise(none).count() == 0


def marked_terms(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: [dict(rows)[r.doc_id][t.s : t.e] for t in r.terms or ()] for r in pii.detect(docs).collect()}


def test_terms_of_entities_that_occur_once_or_twice(spark):
    rng = random.Random(11)
    rows = [(i, sentence(rng, 60)) for i in range(300)]
    rows += [(400, f"{sentence(rng, 8)} zephyrine alpha7 one@corp.example.com {sentence(rng, 8)}")]
    rows += [(401 + i, f"{sentence(rng, 8)} two@corp.example.com beta{i} Obelisk {sentence(rng, 8)}") for i in range(2)]
    got = marked_terms(spark, rows)
    assert "zephyrine" in got[400] and "alpha7" not in got[400]
    assert "Obelisk" in got[401] and "Obelisk" in got[402]
    assert not any(got[i] for i in range(300))


def test_terms_are_marked_in_the_whole_text(spark):
    rng = random.Random(12)
    rows = [(i, sentence(rng, 60)) for i in range(300)]
    rows += [(400, f"Zephyrine wrote.\n\n{sentence(rng, 40)} Zephyrine alpha1 one@corp.example.com beta1 {sentence(rng, 40)}\n\nzephyrine")]
    rows += [(401, f"{sentence(rng, 8)} Obelisk {'- ' * 900} two@corp.example.com"), (402, "Obelisks"), (403, f"three@corp.example.com {'4.3.2.1, ' * 200} Quagmire {sentence(rng, 20)}")]
    got = marked_terms(spark, rows)
    assert [t for t in got[400] if t.lower() == "zephyrine"] == ["Zephyrine", "Zephyrine", "zephyrine"]
    assert "Obelisk" in got[401] and got[402] == [] and "Quagmire" in got[403]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert not any("zephyrine" in r.text.lower() for r in pii.sanitise(docs).collect())


def test_copies_hide_no_terms(spark):
    rng = random.Random(13)
    rows = [(i, sentence(rng, 60)) for i in range(300)]
    rows += [(400 + i, f"{sentence(rng, 8)} Quixotic {WORDS[i]} me@corp.example.com {sentence(rng, 8)}") for i in range(3)]
    rows += [(500 + i, rows[-1][1]) for i in range(400)]
    got = marked_terms(spark, rows)
    assert all("Quixotic" in got[i] for i in (400, 401, 402, 500, 899))
    docs = spark.createDataFrame([*rows, (None, None), (None, "")], "doc_id long, text string")
    counts, n = pii.term_documents(docs)
    assert n == 304 and counts.filter("term = 'quixotic'").first()["term_docs"] == 3


@pytest.mark.parametrize("seed", range(4))
def test_cells_link_what_is_similar(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(1 << 40, size=60)
    sets = [np.unique(np.concatenate([base[rng.random(60) > cut], rng.integers(1 << 40, size=int(60 * cut))])) for cut in rng.choice([0.02, 0.05, 0.2, 0.3], 40)]
    sets += [np.unique(rng.integers(1 << 40, size=rng.integers(1, 400))) for _ in range(60 * (seed % 2))]
    label = np.array([i % 3 if i < 9 else i for i in range(len(sets))])
    chunk = np.zeros(len(sets), int) if seed < 2 else rng.integers(2, size=len(sets))
    u, v = neardup.linked(np.concatenate(sets), np.array([len(x) for x in sets]), label, chunk, 0.8)
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))

    def groups(pairs):
        parent = {int(x): int(x) for x in label}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(int(label[a]))] = find(int(label[b]))
        return sorted(sorted(x for x in parent if find(x) == r) for r in {find(x) for x in parent})

    every = [(i, j) for i in range(len(sets)) for j in range(i) if (seed < 2 or chunk[i] != chunk[j]) and jaccard(sets[i], sets[j]) >= 0.8]
    assert groups(zip(u, v)) == groups(every) and len(u) < len(set(label.tolist()))
    assert all(jaccard(sets[i], sets[j]) >= 0.8 for i, j in zip(u, v))


def test_texts_with_entities_may_hold_them(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("0123456789.- +@ab") for _ in range(rng.randrange(5, 60))) for _ in range(3000)] + ["1.2.3.4", "+1 (2)345.678", "a@b.c", "4111 1111-11111111"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    may = {r.text for r in df.filter(pii.may_hold(F.col("text"))).collect()}
    held = {t for t in texts if pii.base_spans(t)}
    assert {"1.2.3.4", "a@b.c", "4111 1111-11111111"} <= held <= may


def test_rewrite_overlaps():
    assert pii.rewrite("ab 1.2.3.4 cd", [(1, 3, 10)], [(0, 2, 0.8), (11, 13, 0.99)], 0.95) == "<TERM> <IP> "


# -- vectors -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)]
    rows += [(400, rows[1][1]), (401, rows[1][1]), (402, None), (403, [1.0, None]), (404, [float("nan")] * 8), (405, [float("inf")] * 8), (None, rows[2][1]), (500, [0.0] * 8), (406, [1.0, 2.0]), (7, rows[7][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows


def padded(v):
    return np.array(list(v) + [0.0] * (8 - len(v)))


def test_topk_is_exact(spark, vectors):
    df, rows = vectors
    ok = [(i, np.floor(1024 * padded(v)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q in {i for i, _ in ok if i % 100 == 0}:
        y = next(v for i, v in ok if i == q)
        best = sorted((-int(v @ y), i) for i, v in ok if i != q)[:10]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    for options in ({}, {"query_block": 2, "row_block": 50, "pivots": 3}, {"sample": 0}):
        got = [tuple(r) for r in topk.search(df, **options).collect()]
        assert set(got) == want and len(got) == len(want)
    assert topk.search(df.limit(0)).count() == 0


def test_topk_prunes():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-50, 50, (4000, 4)), rng.integers(900, 1000, (40, 4))])
    pivots = topk.choose_pivots(x.astype(float), 6)
    d = np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
    best, seen = topk.best_of(x[4001], d[4001], 4001, x, np.arange(len(x)), d.T, (x.astype(float) ** 2).sum(axis=1), 10, True)
    assert [s for s, _ in best] == sorted((int(s) for i, s in enumerate(x @ x[4001]) if i != 4001), reverse=True)[:10]
    assert seen < len(x)


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """20,000 vectors of length 1 around 200 centres."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(200, 16))[rng.integers(0, 200, 20_000)] + rng.normal(scale=0.15, size=(20_000, 16))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    path = str(tmp_path_factory.mktemp("vectors") / "v.parquet")
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float64())), "score": np.arange(len(x))}), path)
    return spark.read.parquet(path), x


def test_topk_eliminates_on_clusters(clustered):
    df, x = clustered
    whole = np.floor(1024 * x).astype(np.int64)
    got: dict = {}
    for r in topk.search(df, every=2000, row_block=500).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, len(x), 2000))
    for q, found in got.items():
        score = whole @ whole[q]
        score[q] = -(1 << 62)
        order = np.lexsort((np.arange(len(x)), -score))[:10]
        assert sorted(found) == [(n + 1, int(i), int(score[i])) for n, i in enumerate(order)]
    assert topk.evaluated_share(df, every=2000, row_block=500, pivots=64) < 0.1


def test_ann_visits_few_leaves_of_clusters(clustered):
    df, x = clustered
    index = ann.Index(df, 200, 0.94, 20, 2000, 16, 100, 8, None)
    assert index.leaves > 100 and index.visits < index.leaves / 2
    got: dict = {}
    for r in ann.search(df, every=200, sample=2000, calibration_queries=100, query_block=30, block_rows=700).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q in range(0, len(x), 200):
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(set(np.argsort(-score)[:20]) & {i for _, i, _ in got[q]})
        assert [n for n, _, _ in sorted(got[q])] == list(range(1, 21))
        assert all(abs(s - score[i]) < 1e-9 for _, i, s in got[q])
    assert hit / (20 * len(got)) >= 0.9


def test_ann_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(i, [0.5, 0.1]) for i in range(60, 100)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, recall=1.0, block_rows=7, query_block=2).collect()
    assert sorted((r["rank"], r.vec_id) for r in got if r.query_id == 40) == [(n + 1, n) for n in range(5)]
    assert sorted((r["rank"], r.vec_id) for r in got if r.query_id == 0) == [(n, n) for n in range(1, 6)]


def test_ann_recall(spark, vectors):
    df, rows = vectors
    ok = [(i, padded(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    got = ann.search(df, k=5, leaves=20, block_rows=90, branches=4).collect()
    hit = total = 0
    for q in {i for i, _ in ok if i % 20 == 0}:
        y = next(v for i, v in ok if i == q)
        best = sorted((-(v @ y), i) for i, v in ok if i != q)[:5]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 6))
        assert all(abs(s - next(v for i, v in ok if i == vec) @ y) < 1e-9 for _, vec, s in mine)
        hit, total = hit + len({i for _, i in best} & {i for _, i, _ in mine}), total + 5
    assert hit / total >= 0.9
    assert ann.search(df.limit(0)).count() == 0


# -- mixing --------------------------------------------------------------------------------------------------


def slow_targets(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left, w = total - sum(cap * sizes[s] for s in full), sum(weight[s] for s in sizes if s not in full)
        target = {s: cap * sizes[s] if s in full else left * weight[s] / w for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_targets_are_the_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice((1, 10, 1000, 0)) for i in range(8)} | {None: 77}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(mixing.cycle_weights(df)).collect()}
    want = slow_targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


def test_mix(spark, odd, none):
    rows = mixing.repeats(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.copies <= 3 for r in rows)
    taken = mixing.mix(odd)
    assert taken.columns == odd.columns and taken.count() == sum(r.copies for r in rows)
    assert sorted(map(str, taken.collect())) == sorted(map(str, mixing.mix(odd).collect()))
    assert mixing.repeats(none).count() == 0 and mixing.mix(none).count() == 0


# -- URLs ----------------------------------------------------------------------------------------------------


def test_url_filter(spark):
    cases = {
        "http://a.com/x": ("a.com", "/x", "com/", "allow"), "https://EXAMPLE.com/en/1?q": ("example.com", "/en/1", "example.com/en/", "block"), "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"), "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"), "http://x.net/ES/": ("x.net", "/ES/", None, "allow"),
        "http://a.com": ("a.com", "", None, "allow"), "http://porn.org/": ("porn.org", "/", None, "block"), "http://popcorn.org/": ("popcorn.org", "/", None, "allow"), "http://free-bets.org/": ("free-bets.org", "/", None, "block"), "http://free-free.org/": ("free-free.org", "/", None, "allow"), "http://free.org/bet\nwin": ("free.org", "/bet\nwin", None, "block"), "nothing": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id long, url string, host string")
    for r in urls.filter_urls(df).collect():
        assert (r.host, r.path, r.rule, r.verdict) == list(cases.values())[r.page_id]
    assert urls.filter_urls(df.limit(0)).count() == 0


# -- language ------------------------------------------------------------------------------------------------


def test_language(spark, odd, none):
    rng = random.Random(8)
    parts = {"aa": "kalo miru tana".split(), "bb": "schun grot weir".split()}
    rows = [(i, " ".join(rng.choice(parts[x]) for _ in range(30)), x) for i in range(400) for x in [rng.choice("ab") * 2]]
    docs = spark.createDataFrame(rows + [(900, None, "aa"), (901, "123 !?", "bb"), (902, "", None)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    held = [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == x for i, x in held) / len(held) > 0.98
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.keep_identified(docs, model).count() == 400
    empty = langid.learn(none)
    assert langid.predict(odd, empty).filter("lang_pred <> 'und'").count() == 0


def test_symbols_beyond_the_basic_plane_are_no_letters(spark):
    assert langid.counts("\U0001f600 12 \U0001f389!? \U0001d7d8") is None
    assert (langid.counts("kalo \U0001f600 miru") == langid.counts("kalo 1 miru")).all()
    assert langid.counts("\U00020000") is not None and langid.counts("\U0001d51e") is not None
    learnt = spark.createDataFrame([(i, w, x) for i in range(40) for w, x in (("kalo miru", "aa"), ("schun grot", "bb"))], "doc_id long, text string, lang string")
    said = langid.predict(spark.createDataFrame([(1, "\U0001f600 7!")], "doc_id long, text string"), langid.learn(learnt)).first()
    assert said.lang_pred == "und" and said.score == 0


def test_counts_by_pieces(monkeypatch):
    text = sentence(random.Random(9), 50) + "  Ärger\n\n" + sentence(random.Random(9), 50)
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert (langid.counts(text) == whole).all()


# -- token counts --------------------------------------------------------------------------------------------


def test_rollup(spark, odd, tmp_path):
    import tiktoken

    ranks = token_counts.load_ranks()
    counted = token_counts.count_tokens(odd, ranks).collect()
    enc = tiktoken.Encoding("t", pat_str=ranks[0], mergeable_ranks=ranks[1], special_tokens={})
    assert sum(r.tokens for r in counted) == sum(len(enc.encode_ordinary(r.text or "")) for r in odd.collect())
    rows = spark.createDataFrame([(1, "a", "x", 5), (2, "a", None, 7), (3, None, "x", 0)], "doc_id long, source string, lang string, tokens long")
    roll = token_counts.Rollup(spark, f"file://{tmp_path}/roll")
    assert roll.totals().count() == 0
    assert roll.commit("1", token_counts.inserts(rows, "v1"))
    assert not roll.commit("1", token_counts.inserts(rows, "v1"))
    roll.commit("2", token_counts.deletes(rows.filter("doc_id = 1"), "v1"))
    roll.commit("3", token_counts.revisions(rows.filter("doc_id = 2"), rows.filter("doc_id = 2").withColumn("tokens", F.lit(9)), "v1", "v2"))
    (tmp_path / "roll" / "batch=4").mkdir()  # a batch that failed midway
    want = {("a", None, "v2", 1, 9), (None, "x", "v1", 1, 0)}
    assert {tuple(r) for r in roll.totals().collect()} == want
    roll.compact()
    (tmp_path / "roll" / "base=2").mkdir()  # a compaction that failed midway
    assert {tuple(r) for r in roll.totals().collect()} == want
    assert not roll.commit("3", token_counts.inserts(rows, "v1"))  # a replay of what is in the base
    assert roll.commit("4", token_counts.deletes(rows.filter("doc_id = 3"), "v1"))
    for _ in range(2):
        assert {tuple(r) for r in roll.totals().collect()} == {("a", None, "v2", 1, 9)}
        roll.compact()
    with pytest.raises(ValueError):
        roll.commit("../x", token_counts.inserts(rows, "v1"))


# -- pipeline ------------------------------------------------------------------------------------------------


def test_pipeline(spark, odd, tmp_path):
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        if name == "language":
            assert docs.count() == before.filter("text rlike '[a-z]'").count()
        if name == "near_duplicates":
            assert docs.groupBy("text").count().filter("count > 1").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


# -- clashing names, files, and what the parts of operators compute ------------------------------------------

CLASHES = "key terms row rate copies goal __key __terms __copies kept_id kept_hash again_id shard slot rid fp label n component_fp".split()


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(21)
    texts = [sentence(rng, 30) for _ in range(20)]
    rows = [(i, f"{t} me{i % 3}@corp.example.com", "en", f"s{i % 3}", *[f"{c}{i}" for c in CLASHES]) for i, t in enumerate(texts + texts[:5])]
    return spark.createDataFrame([*rows, rows[2], (None, None, None, None, *CLASHES)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHES))


def test_columns_of_any_name_stay(clashing):
    own = {(r.doc_id, *[r[c] for c in CLASHES]) for r in clashing.collect()}
    same = lambda df: df.columns == clashing.columns and {(r.doc_id, *[r[c] for c in CLASHES]) for r in df.collect()}
    assert same(pii.sanitise(clashing)) == own
    assert same(mixing.mix(clashing)) <= own and mixing.mix(clashing).count() > 0
    assert same(simhash.keep_one(clashing)) <= own
    kept = neardup.keep_one(clashing, 5, 4, 0.8)
    assert same(kept) <= own and kept.count() == 21
    assert same(langid.keep_identified(clashing, langid.learn(clashing))) < own


def test_write_shards(spark, odd, clashing, none, tmp_path):
    for name, docs in (("odd", odd), ("clash", clashing)):
        path = str(tmp_path / name)
        folder = sharding.write_shards(docs, path, shards=5)
        assert folder == "_shard"
        back = spark.read.parquet(path)
        assert set(back.columns) == {*docs.columns, folder}
        key = lambda r: tuple(str(r[c]) for c in docs.columns)
        assert sorted(map(key, back.collect())) == sorted(map(key, docs.collect()))
        places = sharding.assign(docs, shards=5)
        assert {(r[folder], r["count"]) for r in back.groupBy(folder).count().collect()} == {(r.shard, r["count"]) for r in places.groupBy("shard").count().collect()}
    sharding.write_shards(none, str(tmp_path / "none"))


def test_sharding_by_bytes(spark):
    """The law at 24 shards, sizes and checksums, from scratch."""
    rng = random.Random(4)
    rows = [(i, "ä" * rng.randrange(1, 400)) for i in range(6000)] + [(7000 + i, "same") for i in range(3000)] + [(None, None), (1, "")]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    size = lambda t: 8 + len((t or "").encode())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    total, largest = sum(size(t) for _, t in rows), max(size(t) for _, t in rows)
    for shard in range(24):
        mine = [r for r in got if r.shard == shard]
        assert abs(sum(r["size"] for r in mine) - total / 24) <= 0.05 * total / 24 + largest
        assert sorted(r.slot for r in mine) == list(range(len(mine)))


def test_counts_are_those_of_plain_ngrams():
    """Hashed counts against n-grams that are cut one by one."""
    text = "Straße, 42 Äpfel und Birnen; IM Haus!  ok"
    letters = " " + re.sub(r"[^a-zäöüß]+", " ", text.lower())
    grams: dict = {}
    for k in (2, 3):
        for i in range(len(letters) - k + 1):
            grams[letters[i : i + k]] = grams.get(letters[i : i + k], 0) + 1
    mask = (1 << 32) - 1

    def bucket(g):
        h = (ord(g[0]) * 0x9E3779B1 + ord(g[1]) * 0x85EBCA6B) & mask
        if len(g) == 3:
            h = (h * 0xC2B2AE35 + ord(g[2]) * 0x27D4EB2F) & mask
        return (((h ^ (h >> 13)) * 0x9E3779B1) & mask) >> (32 - langid.BITS)

    want = np.zeros(1 << langid.BITS, int)
    for g, n in grams.items():
        want[bucket(g)] += n
    assert (langid.counts(text) == want).all()


def test_ftrl_is_the_plain_rule():
    """FTRL-proximal weight by weight; and the elastic net leaves zeros."""
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(30, 6, replace=False)), rng.random(6), int(rng.integers(3))) for _ in range(40)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.05, 0.1
    got = langid.ftrl(rows, 3, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2, seed=7)
    z, n, bias = {}, {}, 1 << langid.BITS

    def weight(j, c):
        zz = z.get((j, c), 0.0)
        return 0.0 if abs(zz) <= l1 else -(zz - np.sign(zz) * l1) / ((beta + n.get((j, c), 0.0) ** 0.5) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(len(rows)):
            x = {**dict(zip(map(int, rows[i][0]), rows[i][1])), bias: 1.0}
            w = {(j, c): weight(j, c) for j in x for c in range(3)}
            e = np.exp([sum(x[j] * w[j, c] for j in x) for c in range(3)])
            p = e / e.sum()
            for j, v in x.items():
                for c in range(3):
                    g = v * (p[c] - (c == rows[i][2]))
                    was = n.get((j, c), 0.0)
                    n[j, c] = was + g * g
                    z[j, c] = z.get((j, c), 0.0) + g - (n[j, c] ** 0.5 - was**0.5) / alpha * w[j, c]
    for j in [*range(30), bias]:
        assert np.allclose(got[j], [weight(j, c) for c in range(3)])
    used = got[:30]
    assert (used == 0).any() and (used != 0).any() and (got[30:bias] == 0).all()


def test_temperature_lowers_the_loss(spark):
    rng = random.Random(3)
    parts = {"aa": "kalo miru tana".split(), "bb": "kalo miru weir".split()}
    rows = [(i, " ".join(rng.choice(parts[x]) for _ in range(4)), x) for i in range(800) for x in [rng.choice("ab") * 2]]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.temperature != 1.0

    def loss(t):
        z = [(model.logits(text), model.languages.index(x)) for i, text, x in rows if zlib.crc32(str(i).encode()) % 4 == 2]
        return -sum(np.log(langid.softmax(a / t)[k]) for a, k in z)

    assert loss(model.temperature) < loss(1.0)


def test_nothing_to_learn_from_keeps_texts(spark, none):
    docs = spark.createDataFrame([(1, "words here", None, None), (2, None, None, None), (3, "12 34", None, None)], "doc_id long, text string, lang string, source string")
    assert [r.doc_id for r in langid.keep_identified(docs, langid.learn(none)).collect()] == [1]


def test_disclosures_by_brute_force(spark):
    """The table of revealing terms against counting documents one by one."""
    rng = random.Random(17)
    names = [f"me{k}@corp.example.com" for k in range(6)]
    rows = [(i, f"{sentence(rng, 12)} {rng.choice(['Quix', 'Zeph', 'plain'])} {rng.choice(names)} {sentence(rng, 12)}" if i % 3 else sentence(rng, 25)) for i in range(90)]
    rows += [(200 + k, rows[4][1]) for k in range(30)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    got = {(r.entity, r.term): r.disclosure for r in pii.disclosures(spark.createDataFrame(rows, "doc_id long, text string"), pii.entity_texts(found), 1.0, 0.3).collect()}
    texts = sorted({t for _, t in rows})
    term_sets = [{w for w in re.split(pii.NOT_TERM, t.lower()) if w} for t in texts]
    held, near = {}, {}
    for t in texts:
        around, _ = pii.windows(t, pii.base_spans(t), 5)
        for w in around:
            held.setdefault(w["entity"], set()).add(t)
            near.setdefault(w["entity"], set()).update(w["terms"])
    want, total = {}, len(texts)
    for entity, those in held.items():
        base = len(those) / total
        for term in near[entity]:
            with_term = {t for t, s in zip(texts, term_sets) if term in s}
            given = (len(with_term & those) + base) / (len(with_term) + 1)
            shown = min(1.0, 1 - np.log2(given) / np.log2(base))
            if shown >= 0.3:
                want[entity, term] = shown
    assert want and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_soft_terms_add_up():
    terms = urls.automaton(urls.STRICT, urls.SOFT, urls.SOFT_LIMIT)
    weigh = lambda u: urls.weight_of(u, terms)
    assert all(w < urls.SOFT_LIMIT for w in urls.SOFT.values())
    assert weigh("http://a.com/casino/casino") == 2 and weigh("http://casino.com/free") == 3
    assert weigh("http://freecasino.com/") == 0 and weigh("http://porn.com") >= urls.SOFT_LIMIT
