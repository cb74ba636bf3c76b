"""Information-theoretic removal of personal data.

Patterns find the protected entities (e-mail addresses, IP addresses, card and phone numbers). Terms that
stand near an entity can reveal it even when it is gone. How much a term t reveals of an entity e is
measured over the corpus, by the documents that hold both, where documents with the same text count once in
all numbers, so that copies add nothing. Of N documents n_e hold e, df_t hold t, and n_et
hold both; with ``prior`` documents added that hold t and have e at its base rate p(e) = n_e / N,

    p(e | t) = (n_et + prior * p(e)) / (df_t + prior),    disclosure(e, t) = log2(p(e | t) / p(e)) / -log2(p(e))

which is pointwise mutual information as a share of what there is to know of e, shrunk towards 0: the fewer
documents speak for a term, the less it counts, but entities that occur once or twice are judged as well.
That share nears 1 for any fixed rate as the corpus grows, since ever more is there to know of an entity. So the
rate itself must be high too: the lower end of Wilson's interval of n_et of df_t documents (at CERTAIN_Z standard
errors) must reach ``certain``, whatever N is. A word of 100 texts, one of which holds the entity, reveals nothing
at any N; a name of one or two texts, all of which hold it, does. A revealing term stays in texts without the
entity: there it stands for nobody, and which texts are about the same person isn't known.
Candidates are the terms that stand within ``window`` words of an entity anywhere. Terms at or above
``generalise_at`` are generalised to their class; those at or above ``remove_at`` are removed, at every
place in the documents that hold e.

Pairs that can't reach ``generalise_at`` and ``certain`` even if all documents of the rarer of the two hold both
are left out before documents are joined; this changes no result, and bounds the pairs of a frequent term.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisect.llm.common import HOT_KEYS, if_small, over_texts, stored, table

KINDS = ("email", "ip", "card", "phone")
WINDOW, PRIOR, GENERALISE_AT, REMOVE_AT = 5, 1.0, 0.75, 0.95
#: The least share of a term's documents that hold the entity, by the lower end of an interval of so many errors.
CERTAIN, CERTAIN_Z = 0.2, 1.0
#: Terms are maximal runs of other characters, in both engines.
NOT_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # an attempt inside a run of digits can't succeed if that from its start fails
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_WORDLIKE = re.compile(r"[^\W\d_]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        if found := _DOMAIN.match(text, at):
            start = at
            while start > free and _LOCAL.match(text, start - 1):
                start -= 1
            if start < at:
                yield start, found.end()
                free = found.end()
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start; code points, end exclusive."""
    if not text:
        return []
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        # a part of more than 3 digits can only be at most 255 if zeros lead
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def may_hold(text: Column) -> Column:
    """Whether some pattern may match: true for every text with a base span, false for most others."""
    # an address of 7 or a card of 16 characters or more, or a phone
    return text.contains("@") | text.rlike(r"[0-9][\x20.0-9-]{5,}[0-9]|\+[0-9]")


def _entity(kind: int, value: str) -> str:
    plain = value.lower() if kind == 0 else value if kind == 1 else _NOT_DIGIT.sub("", value)
    return hashlib.md5(f"{KINDS[kind]}:{plain}".encode()).hexdigest()


def windows(text: str, spans: list[tuple[int, int, int]], window: int) -> tuple[list[dict], list[dict]]:
    """For each span its entity and the terms among the window words next to it on each side, however far
    away they are; and each term of the text with all its places (start, end, start, end, ...)."""
    taken = sorted((s, e) for _, s, e in spans)
    starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    free = lambda s, e: not (k := bisect_left(starts, e)) or ends[k - 1] <= s
    places = np.fromiter((x for m in _TERM.finditer(text) if free(*m.span()) for x in m.span()), np.int32).reshape(-1, 2)
    first, last = places[:, 0], places[:, 1]
    is_term = lambda t: len(t) >= 3 and _WORDLIKE.search(t)
    near = []
    for kind, start, end in spans:
        before, after = int(np.searchsorted(last, start, "right")), int(np.searchsorted(first, end))
        at = [i for i in (*range(max(0, before - window), before), *range(after, min(len(places), after + window)))]
        terms = {t for i in at if is_term(t := text[first[i] : last[i]].lower())}
        near.append({"entity": _entity(kind, text[start:end]), "terms": sorted(terms)})
    every: dict[str, list[int]] = {}
    for s, e in places.tolist():
        if is_term(t := text[s:e].lower()):
            every.setdefault(t, []).extend((s, e))
    return near, [{"term": t, "at": at} for t, at in every.items()]


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


_WINDOWS = pa.list_(pa.struct([("entity", pa.string()), ("terms", pa.list_(pa.string()))]))
_TERMS = pa.list_(pa.struct([("term", pa.string()), ("at", pa.list_(pa.int32()))]))
_FOUND = "doc_id long, key string, n_email long, n_ip long, n_card long, n_phone long, base string, windows array<struct<entity:string,terms:array<string>>>, terms array<struct<term:string,at:array<int>>>"
#: Characters of texts with entities whose terms a worker holds at once.
HELD = 1 << 18


def find(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs (doc_id, text): counts, base spans, and for a text with entities its windows
    and terms; key (an MD5 of the text) tells texts with entities apart, else it is null.

    Null and empty texts have no entities; long texts are read whole; repeated rows stay, null ids keep their
    rows, other columns are dropped; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [p.split(" ")[0] for p in _FOUND.split(", ")]
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string(), _WINDOWS, _TERMS]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for b in batches:
            rows, held = [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py()
                spans = base_spans(t)
                near, terms = windows(t, spans, window) if spans else ([], [])
                counts = [sum(k == i for k, _, _ in spans) for i in range(len(KINDS))]
                rows.append((i, hashlib.md5(t.encode()).hexdigest() if spans else None, *counts, _named(spans), near, terms))
                held += len(t) if spans else 0
                if held > HELD:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return over_texts(slim, run, _FOUND)


def certainty(both: Column, term_docs: Column, z: float = CERTAIN_Z) -> Column:
    """The lower end of Wilson's interval of the share of a term's documents that hold the entity."""
    n, share = term_docs.cast("double"), both / term_docs
    spread = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return (share + z * z / (2 * n) - spread) / (1 + z * z / n)


def entity_texts(found: DataFrame) -> DataFrame:
    """(key, windows, terms) of every different text with entities."""
    return found.filter("key is not null").select("key", "windows", "terms").dropDuplicates(["key"])


def term_documents(docs: DataFrame) -> tuple[DataFrame, int]:
    """(term, term_docs): in how many different texts of docs each term is; and how many texts there are.

    Every row counts 1; of a text that n rows hold, the row of its smallest id counts 1 - n more (if several
    have that id, each its part of that). So texts with copies count once; if they are few no text is moved.
    """
    text, own_id = F.col("text").cast("string"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.filter("text is not null").select(F.xxhash64(text).alias("hash"), own_id.alias("id"), text.alias("text"))
    alike = rows.groupBy("hash", "id").agg(F.count("hash").alias("m"))
    sizes = stored(alike.groupBy("hash").agg(F.sum("m").alias("n"), F.min(F.struct("id", "m")).alias("first")))
    again = if_small(stored(sizes.filter("n > 1").select("hash", F.col("first.id").alias("id"), ((1 - F.col("n")) / F.col("first.m")).alias("times"))))
    parts = rows.select("text", F.lit(1.0).alias("times")).unionByName(rows.join(again, ["hash", "id"]).select("text", "times"))
    words = parts.select("times", F.explode(F.array_distinct(F.split(F.lower("text"), NOT_TERM))).alias("term"))
    return words.groupBy("term").agg(F.round(F.sum("times")).cast("long").alias("term_docs")), max(1, sizes.count())


def _disclosure(both: Column, entity_docs: Column, term_docs: Column, all_docs: int, prior: float) -> Column:
    base = entity_docs / F.lit(float(all_docs))
    given = (both + F.lit(prior) * base) / (term_docs + F.lit(prior))
    return F.when(base < 1, F.least(1 - F.log2(given) / F.log2(base), F.lit(1.0)))


def disclosures(docs: DataFrame, texts: DataFrame, prior: float = PRIOR, at_least: float = GENERALISE_AT, certain: float = 0.0) -> DataFrame:
    """(key, entity, term, at, disclosure): the pairs at or above at_least, whose certainty is at least ``certain``,
    in each text that holds both."""
    inside = texts.select("key", F.explode("windows").alias("w"))
    holds = stored(inside.select("key", "w.entity").distinct())
    entities = holds.groupBy("entity").agg(F.count("key").alias("entity_docs"))
    near = stored(inside.select("key", "w.entity", F.explode("w.terms").alias("term")).distinct().groupBy("entity", "term").agg(F.count("key").alias("beside")))
    # counted before the join (an inner one: Spark would move a semi join below the count), so that a
    # frequent word is one row of each task
    counts, all_docs = term_documents(docs)
    counts = counts.join(near.select("term").distinct(), "term")
    rates = near.join(entities, "entity").join(counts, "term", "left").withColumn("term_docs", F.greatest(F.coalesce("term_docs", F.lit(0)), F.col("beside")))
    at_most = _disclosure(F.least("entity_docs", "term_docs"), F.col("entity_docs"), F.col("term_docs"), all_docs, prior)
    at_best = certainty(F.least("entity_docs", "term_docs"), F.col("term_docs"))
    pairs = stored(rates.filter((at_most >= at_least) & (at_best >= certain)).select("entity", "term", "entity_docs", "term_docs"))
    occurs = texts.select("key", F.explode("terms").alias("t")).select("key", "t.term", "t.at")
    # most terms of a text are of no pair: they are left out by a hash before anything moves, if that is small
    hashes = stored(pairs.select(F.xxhash64("term").alias("hash")).distinct())
    if if_small(hashes) is not hashes:
        occurs = occurs.join(F.broadcast(hashes), F.xxhash64("term") == F.col("hash"), "left_semi")
    together = stored(occurs.join(pairs.select("entity", "term"), "term").join(holds, ["key", "entity"]).select("key", "entity", "term", "at"))
    both = together.groupBy("entity", "term").agg(F.count("key").alias("both")).join(pairs, ["entity", "term"])
    shown = _disclosure(F.col("both"), F.col("entity_docs"), F.greatest("term_docs", "both"), all_docs, prior)
    sure = certainty(F.col("both"), F.greatest("term_docs", "both"))
    told = both.select("entity", "term", shown.alias("disclosure"), sure.alias("sure")).filter((F.col("disclosure") >= at_least) & (F.col("sure") >= certain))
    return together.join(told.drop("sure"), ["entity", "term"])


def term_spans(revealed: DataFrame) -> DataFrame:
    """(key, terms): for each text with revealing terms, array<struct<s, e, disclosure>> in order."""
    pairs = F.sequence(F.lit(0), F.size("at") - 2, F.lit(2))
    places = F.transform(pairs, lambda i: F.struct(F.get("at", i).alias("s"), F.get("at", i + 1).alias("e")))
    hits = revealed.groupBy("key", "term").agg(F.first("at").alias("at"), F.max("disclosure").alias("disclosure"))
    hits = hits.select("key", "disclosure", F.explode(places).alias("p"))
    return hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("p.s", "p.e", "disclosure"))).alias("terms"))


def with_terms(rows: DataFrame, spans: DataFrame, counts: DataFrame) -> DataFrame:
    """rows (with ``key``) and the terms of their text, null if it has none; spans: (key, terms), counts: (key, n) of
    all rows. Copies of a text that many rows hold stay where they are; there are HOT_KEYS such texts at most."""
    counts = stored(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = stored(counts.filter(F.col("n") * HOT_KEYS > total).select("key").join(spans, "key", "left"))
    rest = rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(spans, "key", "left")
    return rest.unionByName(rows.join(F.broadcast(hot), "key"))


def detect(docs: DataFrame, window: int = WINDOW, prior: float = PRIOR, generalise_at: float = GENERALISE_AT, certain: float = CERTAIN) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base, terms.

    base: the patterns' spans as kind:start:end; terms: the revealing terms (null if none). Null and
    empty texts have none. Rows are judged by their text alone, given the corpus: repeats get the same
    result, null ids keep their rows, other columns are dropped, an empty table gives an empty result.
    """
    found = stored(find(docs, window))
    revealed = disclosures(docs, stored(entity_texts(found)), prior, generalise_at, certain)
    slim = found.drop("windows", "terms")
    plain = slim.filter("key is null").withColumn("terms", F.lit(None).cast("array<struct<s:int,e:int,disclosure:double>>"))
    held = slim.filter("key is not null")
    counts = held.groupBy("key").agg(F.count("*").alias("n"))
    return with_terms(held, stored(term_spans(revealed)), counts).unionByName(plain).drop("key")


#: What stands for an entity of each kind in a sanitised text.
PLACEHOLDERS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}


def _general(word: str) -> str:
    return "<CODE>" if any(c.isdigit() for c in word) else "<NAME>" if word[:1].isupper() else "<TERM>"


def rewrite(text: str, spans: list[tuple[int, int, int]], terms: list[tuple[int, int, float]], remove_at: float) -> str:
    """The text with entities replaced, and terms generalised or removed; overlaps go to the first."""
    marks = [(s, e, PLACEHOLDERS[KINDS[k]]) for k, s, e in spans]
    marks += [(s, e, "" if d >= remove_at else _general(text[s:e])) for s, e, d in terms]
    out, at = [], 0
    for s, e, new in sorted(marks, key=lambda m: (m[0], -m[1])):
        if s < at < e:
            s = at  # the rest of an entity that overlaps the one before goes with it
            new = ""
        if s >= at:
            out += [text[at:s], new]
            at = e
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, window: int = WINDOW, prior: float = PRIOR, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT, certain: float = CERTAIN) -> DataFrame:
    """docs with its own columns, and personal data in ``text`` replaced; a null text stays null.

    If there is a column n_chars it is the new text's length (as it was for a null text). Other columns stay
    as they are, whatever their names; repeated rows stay and change alike; long texts change at every
    place; an empty table gives an empty result.
    """
    revealed = disclosures(docs, stored(entity_texts(find(docs, window))), prior, generalise_at, certain)
    per_text = stored(term_spans(revealed))
    names, kinds = docs.columns, docs.schema
    # only texts that may hold an entity are moved to meet their terms
    packed = docs.select(F.struct(*names).alias("row"), F.coalesce(may_hold(F.col("text").cast("string")), F.lit(False)).alias("may"))
    key = lambda text: F.md5(text.cast("string").cast("binary")).alias("key")
    counts = docs.filter(may_hold(F.col("text").cast("string"))).groupBy(key(F.col("text"))).agg(F.count("*").alias("n"))
    meets = with_terms(packed.filter("may").select("row", key(F.col("row.text"))), per_text, counts).select("row", "terms")
    packed = meets.unionByName(packed.filter("not may").select("row", F.lit(None).cast(meets.schema["terms"].dataType).alias("terms")))
    at = names.index("text")
    size = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new, cols = [], b.column(0).flatten()
            for t, terms in zip(cols[at].to_pylist(), b.column(1).to_pylist(), strict=True):
                spans = base_spans(t)
                new.append(rewrite(t, spans, [(x["s"], x["e"], x["disclosure"]) for x in terms or ()], remove_at) if spans else t)
            cols[at] = pa.array(new, pa.string())
            if size is not None:
                lengths = [was if t is None else len(t) for t, was in zip(new, cols[size].to_pylist(), strict=True)]
                cols[size] = pa.array(lengths, cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return over_texts(packed, run, kinds)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Query: the personal data in every document."""
    found = detect(table(spark, sf_dir, "documents"))
    terms = F.transform(F.coalesce("terms", F.expr("array()")), lambda t: F.concat(F.lit("term:"), t["s"].cast("string"), F.lit(":"), t["e"].cast("string")))
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("terms") > 0, F.array_join(terms, ",")))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))
