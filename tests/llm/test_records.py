"""Archives, manifests and filter audits on small frames: brute force, round trips and odd rows."""

import gzip
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from verisect.llm import filter_audit, merkle, pii, urls, warc

PAGES = "page_id long, url string, html string, digest string, hot string, n long"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree string, idx long"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# -- archives ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(["<p>", "é€😀", "WARC/1.1\r\n", "\r\n\r\n", "0\r\n\r\n", "Content-Length: 3"]) + str(rng.randrange(9)) for _ in range(n))
    rows = [(i, f"http://x/{i}", words(rng.randrange(1, 200)), "d", "h", 1) for i in range(40)]
    hot = words(90)
    rows += [(1000 + i, "http://hot/", hot, None, None, None) for i in range(30)]  # copies: one response
    rows += [(2000, "u", "short", "d", "h", 1), (1999, "u", "short", "d", "h", 1)]  # too short for a revisit
    rows += [rows[5], rows[5], (7000, rows[5][1], rows[5][2], "", "", 0), (None, None, rows[6][2], None, None, None), (None, None, None, None, None, None), (3000, "a b\r\nc", None, "", "", 0), (3001, "", "", "", "", 0), (3002, "http://long/", words(60_000), "", "", 0)]
    return spark.createDataFrame(rows, PAGES).repartition(5), rows


def want_pages(rows):
    first = {}
    for page, _, html, *_ in rows:
        b = (html or "").encode()
        if len(b) >= 100 and page is not None:
            first[b] = min(page, first.get(b, page))
    out = []
    for page, _, html, *_ in rows:
        b = (html or "").encode()
        of = first.get(b) if len(b) >= 100 else None
        revisit = of is not None and of != page
        out.append((page, len(b), sha(b), "revisit" if revisit else "response", of if revisit else None))
    return out


def key(rows):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("options", [{}, {"segment": 700, "chunk": 50}])
def test_archives_round_trip(spark, pages, tmp_path, options):
    df, rows = pages
    path = f"file://{tmp_path}/warc"
    warc.write_archives(df, path, **options)
    read = warc.read_archives(spark, path)
    got = warc.resolved(read)
    assert got.filter("fault is not null").count() == 0
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert key(tuple(r[n] for n in names) for r in got.collect()) == key(want_pages(rows))
    texts = sorted(r.payload.decode() for r in read.filter("type = 'response'").collect())
    assert texts == sorted((r[2] or "") for r, w in zip(rows, want_pages(rows), strict=True) if w[3] == "response")


def test_an_archive_is_a_warc_file(spark, pages, tmp_path):
    """Read by hand, by lengths alone."""
    warc.write_archives(pages[0], f"file://{tmp_path}/warc", segment=700, chunk=50)
    kinds = {}
    for file in (tmp_path / "warc").glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            size = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert rest[size : size + 4] == b"\r\n\r\n"
            kind = re.search(rb"WARC-Type: (\w+)", head)[1]
            kinds[kind] = kinds.get(kind, 0) + 1
            data = rest[size + 4 :]
    assert kinds[b"continuation"] > 100 and kinds[b"revisit"] == sum(w[3] == "revisit" for w in want_pages(pages[1]))


def record(kind, id_, block, **more):
    fields = {"WARC-Type": kind, "WARC-Record-ID": id_, **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": len(block)}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def test_damaged_archives_are_told(spark, tmp_path):
    ok = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3;x=y\r\nabc\r\n0\r\n\r\n"
    parts = [ok[:20], ok[20:40], ok[40:]]
    cut = lambda name, keep, total: b"".join(record("response" if k == 0 else "continuation", f"<{name}>" if k == 0 else f"<{name}-{k}>", parts[k], WARC_Segment_Number=k + 1, **({} if k == 0 else {"WARC_Segment_Origin_ID": f"<{name}>"}), **({"WARC_Segment_Total_Length": total} if k == 2 else {})) for k in keep)
    files = {
        "a": record("response", "<ok>", ok) + cut("whole", (0, 1, 2), len(ok)) + cut("gap", (0, 2), len(ok)) + cut("total", (0, 1, 2), 9) + cut("headless", (1, 2), len(ok)) + cut("unended", (0, 1), 0),
        "b": record("response", "<plain>", b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi") + record("response", "<short>", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nhi") + record("response", "<chunk>", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nabc") + record("response", "<digest>", ok, WARC_Payload_Digest="sha256:00") + record("revisit", "<lost>", b"x", WARC_Refers_To="<nowhere>"),
        "c": cut("apart", (2, 0), len(ok)) + record("response", "<cut>", ok)[:-30],
        "d": cut("apart", (1,), len(ok)),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(gzip.compress(data[: len(data) // 2]) + gzip.compress(data[len(data) // 2 :]))  # members of one file
    read = warc.read_archives(spark, f"file://{tmp_path}")
    got = {r.id: (r.payload, r.fault) for r in read.collect()}
    assert {k: v[0] for k, v in got.items() if v[1] is None} == {"<ok>": b"abc", "<whole>": b"abc", "<plain>": b"hi", "<apart>": b"abc", "<lost>": None}
    assert {k: v[1] for k, v in got.items() if v[1]} == {"<gap>": "segments are missing", "<total>": "other than the total length", "<headless>": "no first segment", "<unended>": "other than the total length", "<short>": "body shorter than its length", "<chunk>": "chunk without its end", "<digest>": "another digest", "<cut>": "cut off"}
    assert [r.fault for r in warc.resolved(read).filter("record_type = 'revisit'").collect()] == ["its response isn't there"]


def test_no_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], PAGES), f"file://{tmp_path}/none")
    assert warc.resolved(warc.read_archives(spark, f"file://{tmp_path}/none")).count() == 0


# -- manifests -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice(["word ", "Ähre\n", "X", "# ", "b\t"]) + str(rng.randrange(30)) + " " for _ in range(n))
    rows = [(i, text(rng.randrange(0, 200)), rng.choice(["en", "de"]), "s-big" if i % 3 else f"s{i % 7}", 5, "d", "t", 1) for i in range(150)]
    rows += [(500 + i, rows[7][1], rng.choice(["en", None]), "s-big", 5, None, None, None) for i in range(40)]  # copies
    rows += [rows[3], rows[3], (None, rows[4][1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (400, None, "en", None, 0, "", "", 0), (401, "", "", "", 0, "", "", 0), (402, " \n", "en", "é", 0, "", "", 0), (403, text(40_000), "en", "lone", 1, "", "", 0), (7, rows[9][1], "en", "s-big", 1, "", "", 0)]
    return spark.createDataFrame(rows, DOCS).repartition(4), rows


def frame(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(digests):
    """The root, and each leaf's siblings level by level."""
    paths, level, ids = [[] for _ in digests], list(digests), [[i] for i in range(len(digests))]
    while len(level) > 1:
        up, up_ids = [], []
        for k in range(0, len(level), 3):
            run = level[k : k + 3]
            for j, leaves in enumerate(ids[k : k + 3]):
                for leaf in leaves:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(sha("".join(run)))
            up_ids.append([x for leaves in ids[k : k + 3] for x in leaves])
        level, ids = up, up_ids
    return level[0], paths


def plain_manifest(rows):
    trees = {}
    for d, text, lang, source, n, *_ in rows:
        leaf = lambda t: sha("".join(map(frame, (d, source, lang, n, t))))  # noqa: B023, E731
        even = d is not None and zlib.crc32(str(d).encode()) % 2 == 0
        trees.setdefault(source, []).append((d, leaf(text), leaf(text.replace("\n", "") if even and text is not None else text)))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    below = {s: plain_tree([r[1] for r in trees[s]]) for s in names}
    root, above = plain_tree([below[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for (d, leaf, changed), path in zip(trees[s], below[s][1], strict=True):
            path, fold = path + above[k], changed
            for before, after in path:
                fold = sha(before + fold + after)
            out.append((d, leaf, below[s][0], root, sha("".join(a + b for a, b in path)), fold, fold == root))
    return out


def test_manifest_is_the_plain_tree(spark, docs, monkeypatch):
    df, rows = docs
    monkeypatch.setattr(merkle, "table", lambda *a: df)
    got = merkle.op12_merkle(spark, "")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain_manifest(rows)
    assert key(got.collect()) == key(want)
    assert 0 < sum(w[6] for w in want) < len(want)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 28])
def test_manifests_of_few_rows(spark, docs, n):
    df = spark.createDataFrame(docs[1][:n], DOCS)
    got = merkle.manifest(df).select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256), "folded_root", "verified").collect()
    assert all(r.verified for r in got)
    want = {w[1]: w[:5] for w in plain_manifest(docs[1][:n])}
    assert sorted(tuple(r)[:5] for r in got) == sorted(want.values())


def test_an_empty_manifest(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_other_fanouts(spark, docs):
    got = merkle.manifest(docs[0], fanout=4).select("verified", "root").distinct().collect()
    assert len(got) == 1 and got[0].verified


# -- audits --------------------------------------------------------------------------------------------------


def plain_audit(rows, labels):
    good, toxic = ({d for d, q, t in labels if (q if k == 0 else t) == 1} for k in (0, 1))
    docs = []
    for d, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any(o is not None and d is not None and o < d and (t or "") == text for o, t, *_ in rows)
        fails = {c for c, bad in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), smaller), strict=True) if bad}
        docs.append((lang or "", fails, d is not None and d in good, d is not None and d in toxic))
    out, shapley = {}, {}
    for part in {x[0] for x in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [x for x in docs if x[0] == part]
            for step, letter in enumerate(order, 1):
                failing = [x for x in docs if x[0] == part and letter in x[1]]
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                out[part, order, step] = (len(left), len(gone), len(failing) - len(gone), sum(x[1] == {letter} for x in failing), sum(x[2] for x in gone), sum(x[3] for x in gone))
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit_is_every_order_played_through(spark, docs):
    df, rows = docs
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 600, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (6, None, None)]
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()} == plain_audit(rows, labels)


def test_an_empty_audit(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], DOCS), labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, None, None, None, None, None, None, None)], DOCS), labels)
    assert one.count() == 600 and one.filter("part = ''").agg(F.sum("removed")).first()[0] == 120


# -- evidence and vocabularies -------------------------------------------------------------------------------


def test_a_coincidence_is_no_evidence(spark):
    """A word of 100 texts that stands once beside an entity isn't marked in a large corpus; a name of the entity's
    own is, and so is one that stands with it in two texts of three."""
    rng = random.Random(20)
    filler = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(6))
    rows = [(i, f"{filler()} {'common' if i < 100 else ''} {'Triple' if i == 150 else ''} {filler()}") for i in range(6000)]
    rows += [(9000, f"{filler()} Common zephyrine one@corp.example.com {filler()}")]
    rows += [(9001 + i, f"{filler()} Triple two@corp.example.com {filler()}") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    loose = {r.doc_id: [dict(rows)[r.doc_id][t.s : t.e] for t in r.terms or ()] for r in pii.detect(docs, generalise_at=0.3, certain=0.0).collect()}
    tight = {r.doc_id: [dict(rows)[r.doc_id][t.s : t.e] for t in r.terms or ()] for r in pii.detect(docs, generalise_at=0.3).collect()}
    assert "Common" in loose[9000] and "Common" not in tight[9000]
    assert "zephyrine" in tight[9000] and "Triple" in tight[9001] and "Triple" in tight[9002]
    assert tight[150] == []  # a text without the entity keeps the term


def test_certainty_does_not_depend_on_the_corpus(spark):
    ask = lambda k, n: spark.range(1).select(pii.certainty(F.lit(k), F.lit(n))).first()[0]
    assert ask(1, 1) == pytest.approx(0.5) and ask(2, 2) == pytest.approx(2 / 3)
    assert ask(1, 2) > pii.CERTAIN > ask(1, 3) and ask(1, 100) < 0.01 and ask(50, 100) > 0.4


def test_copies_of_texts_with_entities(spark):
    """Many copies of one text, with an entity or only with what may be one, get what their text gets."""
    rng = random.Random(21)
    body = " ".join(f"w{rng.randrange(50)}" for _ in range(30))
    rows = [(i, f"Zephyrine one@corp.example.com {body}") for i in range(400)] + [(1000 + i, f"no 12-34-56-78 {body}") for i in range(400)] + [(2000 + i, f"plain {i} {body}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [dict(rows)[r.doc_id][t.s : t.e] for t in r.terms or ()] for r in pii.detect(docs).collect()}
    assert len(found) == len(rows) and all(("Zephyrine" in v) == (k < 1000) for k, v in found.items())
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert len(clean) == len(rows) and len({clean[i] for i in range(400)}) == 1 and "Zephyrine" not in clean[0]
    assert all(clean[i] == t for i, t in rows if i >= 1000)


def test_a_table_of_terms(spark, monkeypatch):
    rng = random.Random(22)
    terms = sorted({"".join(rng.choice("abcdefgh-") for _ in range(rng.randrange(3, 9))).strip("-") or "x" for _ in range(4000)})
    rows = [(t, float(rng.randrange(1, 3)), rng.random() < 0.1) for t in terms] + [(terms[0].upper(), 9.0, True), (None, 1.0, True), ("", 1.0, True), (terms[1], None, None)]
    table = spark.createDataFrame(rows, "term string, weight double, strict boolean")
    pages = [(i, "http://h/" + rng.choice("/.- ").join(rng.choice(terms).upper() if rng.random() < 0.1 else rng.choice(terms + ["zz", "a1", "zzz"]) for _ in range(rng.randrange(1, 5)))) for i in range(300)] + [(900, None), (901, ""), (902, "no://" + "q" * 50_000), (1, "http://h/")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    strict = {t.lower() for t, _, s in rows if t and s}
    weight = {}
    for t, w, _ in rows:
        if t:
            weight[t.lower()] = max(w or 0, weight.get(t.lower(), 0))

    def plain(url):
        low, hits = (url or "").lower(), 0.0
        for t in weight:
            at = low.find(t)
            while at >= 0:
                if not re.match("[a-z0-9]", low[at - 1 : at] if at else "") and not re.match("[a-z0-9]", low[at + len(t) : at + len(t) + 1]):
                    hits += urls.SOFT_LIMIT if t in strict else weight[t]
                    break
                at = low.find(t, at + 1)
        return hits

    got = urls.filter_urls(df, rules=(), vocabulary=table).collect()
    assert sorted((r.page_id, r.weight, r.verdict) for r in got) == sorted((i, plain(u), "block" if plain(u) >= urls.SOFT_LIMIT else "allow") for i, u in pages)
    monkeypatch.setattr(urls, "MOST_TERMS", 100)
    with pytest.raises(ValueError, match="100 terms"):
        urls.filter_urls(df, vocabulary=table)
