"""Lexical search, filter audit and web archive against brute force."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from frostline.llm import filter_audit, lexical_search, warc_store
from frostline.sources.shared import scratch_dir

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ITEMS = "item_id long, text string"


# Lexical search


def plain_search(docs, items, best=20):
    """Score every document for every item; (doc_id, text) and (item_id, text)."""
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, bag) for i, bag in bags if bag]
    documents, words = len(bags), sum(bag.total() for _, bag in bags)
    df = Counter(term for _, bag in bags for term in bag)
    out = []
    for item_id, text in dict.fromkeys(items):
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for doc_id, bag in bags:
            m = 100 - 25 + (25 * bag.total() * documents) // words
            score = sum(q * math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t, q in asked.items() if bag[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(scored[:best], 1)]
    return sorted(out, key=repr)


def found(documents, items, **settings):
    return sorted(map(tuple, lexical_search.search(documents, items, lexical_search.Settings(**settings)).collect()), key=repr)


@pytest.mark.parametrize("settings", [
    {}, {"block_docs": 7}, {"block_postings": 40}, {"block_docs": 150, "least_short": 3, "short_share": 0.0},
    {"block_docs": 200, "least_short": 20, "short_share": 0.05, "ranges": 9}, {"round_bytes": 100, "best": 3},
])
def test_search_as_by_scoring_everything(spark, settings):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    share = 1 / np.arange(1, 61)
    text = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    docs = [(int(i), text(int(rng.integers(1, 40)))) for i in rng.permutation(300)]
    docs += [(500 + i, docs[0][1]) for i in range(25)]  # ties
    items = [(i, text(int(rng.integers(1, 12)))) for i in range(12)]
    got = found(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, ITEMS), **settings)
    assert got == plain_search(docs, items, settings.get("best", 20))


def test_search_of_messy_rows(messy, empty, spark):
    rows = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    items = [(1, "One TWO ten"), (1, "One TWO ten"), (2, "é x b"), (3, None), (4, "?!"), (5, "w7x7 ß w1x1 w1x1"), (None, "a"), (1, "A b")]
    asked = spark.createDataFrame(items, ITEMS)
    assert found(messy, asked) == plain_search(rows, items)
    assert found(empty, asked) == [] and found(messy, asked.limit(0)) == []


def test_large_ids_stay_exact_beside_unknown_ones(spark):
    docs = [((1 << 60) + 1, "a b"), (None, "a"), (-(1 << 60) - 1, "a c d")]
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    items = [((1 << 59) + 1, "a a b")]
    assert found(table, spark.createDataFrame(items, ITEMS)) == plain_search(docs, items)


def test_long_texts_are_taken_apart_whole(monkeypatch):
    text = "Ab,c4é \x00x" * 500
    whole = lexical_search.term_counts(text)
    monkeypatch.setattr(lexical_search, "_PIECE", 7)
    assert lexical_search.term_counts(text) == whole
    assert whole == Counter(w.encode() for w in TERM.findall(text.translate(LOWER)))


# Filter audit


def plain_audit(docs, labels):
    """Apply the filters one after the other, in every order; (doc_id, text, source) and (doc_id, quality, toxic)."""
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, bad in labels if bad == 1 and i is not None}
    parts = defaultdict(list)
    for doc_id, text, source in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and doc_id > first[text],
        }
        parts[source or ""].append((doc_id, {f for f, bad in fails.items() if bad}))
    rows = []
    for part, members in parts.items():
        own, shapley = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                shapley[f] += len(gone)
                own.append((f, (part, "".join(order), step, len(left), len(gone),
                                sum(f in m[1] for m in members) - len(gone), sum(m[1] == {f} for m in members),
                                sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone))))
        rows += [(*row, shapley[f]) for f, row in own]
    return sorted(rows)


def test_audit_as_by_applying_every_order(spark, messy, empty):
    rng = np.random.default_rng(3)
    texts = ["a b", "A " * 60, "w # " * 30, " ".join(map(str, range(80))), " ".join(f"w{i}" for i in range(70)) + " |", None, ""]
    docs = [(r.doc_id, r.text, r.source) for r in messy.select("doc_id", "text", "source").collect()]
    docs += [(int(i), texts[int(rng.integers(len(texts)))], "abc"[int(rng.integers(3))]) for i in rng.integers(20, 200, 150)]
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in rng.integers(1, 200, 120)]
    labels += [(None, 1, 1), (1, None, 1), (2, 1, None)]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string")
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    got = filter_audit.audit(filter_audit.masked(documents, labelled))
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, labels)
    kept = [d for d in docs[:13]]
    again = filter_audit.audit(filter_audit.masked(messy, labelled))
    assert sorted(map(tuple, again.collect())) == plain_audit(kept, labels)
    assert filter_audit.audit(filter_audit.masked(empty, labelled)).count() == 0
    assert filter_audit.audit(filter_audit.masked(documents, labelled.limit(0))).count() == len(plain_audit(docs, []))


@pytest.mark.parametrize("width", [1, 2, 3, 5])
def test_swaps_meet_every_order_once(width):
    order, seen = list(range(width)), [tuple(range(width))]
    for at in filter_audit.adjacent_swaps(width):
        order[at], order[at + 1] = order[at + 1], order[at]
        seen.append(tuple(order))
    assert len(seen) == len(set(seen)) == math.factorial(width)


def test_diagram_shares_nodes_and_keeps_counts():
    counts = {0: (5,), 3: (2,), 12: (2,), 31: (1,)}
    diagram = filter_audit.Diagram(counts, 5)
    assert sum(map(len, diagram.levels)) < 31
    for at in filter_audit.adjacent_swaps(5):
        diagram.swap(at)
        assert diagram.totals[diagram.root] == (10,)
        passing = [stay for _, stay, _ in diagram.all_pass()]
        assert passing[-1] == (5,)


# Archive


def read_warc(raw):
    """Records of a WARC file: fields and block, by their Content-Length."""
    at, records = 0, []
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:end].decode().split("\r\n")
        assert first == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        records.append((fields, raw[end + 4 : end + 4 + size]))
        assert raw[end + 4 + size : end + 8 + size] == b"\r\n\r\n"
        at = end + 8 + size
    return records


BIG = "<p>é" * 60 + "\r\n\r\nWARC/1.1\r\n"
PAGES = [
    (5, "http://a/x", BIG), (2, "http://a/y\r\nWARC-Type: fake", BIG), (9, None, BIG), (None, "", BIG),
    (3, "http://b", "short"), (4, "http://b", "short"), (6, "u", None), (7, "u", ""), (8, "v", "x" * 99), (1, "v", "x" * 99),
    (10, "w", "y" * 100), (11, "w", "y" * 100), (11, "w", "y" * 100), (12, "long", "z" * 3_000_000), (None, None, None),
]


@pytest.fixture
def archive(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for name in ("digest", "record_id", "payload", "first", "size", "row", "head"):
        pages = pages.withColumn(name, F.lit("clash"))
    folder = scratch_dir(spark, "archive")
    warc_store.deposit(pages.repartition(3), folder)
    return folder


def test_archive_keeps_each_payload_once_and_gives_back_all(spark, archive):
    stored = spark.read.parquet(f"{archive}/payloads").collect()
    assert len(stored) == len({html or "" for _, _, html in PAGES})
    assert all(hashlib.sha256(r.payload).digest() == bytes(r.digest) for r in stored)
    got = warc_store.restored(spark, archive).collect()
    assert sorted((str(r.page_id), bytes(r.payload).decode()) for r in got) == sorted((str(i), h or "") for i, _, h in PAGES)
    for r in got:
        assert r.payload_bytes == len(r.payload) and r.payload_digest == hashlib.sha256(r.payload).hexdigest()
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got if r.payload_bytes >= 100)
    assert kinds == sorted([
        ("2", "response", None), ("5", "revisit", 2), ("9", "revisit", 2), ("None", "revisit", 2),
        ("10", "response", None), ("11", "revisit", 10), ("11", "revisit", 10), ("12", "response", None),
    ])
    assert {r.record_type for r in got if r.payload_bytes < 100} == {"response"}


def test_archive_as_warc_files(spark, archive, tmp_path):
    warc_store.export(spark, archive, str(tmp_path / "out"))
    records = [r for f in (tmp_path / "out").glob("part-*") for r in read_warc(f.read_bytes())]
    assert len(records) == len(PAGES)
    by_id = {fields["WARC-Record-ID"]: (fields, block) for fields, block in records}
    assert len(by_id) == len(PAGES)
    bodies = Counter()
    for fields, block in by_id.values():
        answer, _, body = block.partition(b"\r\n\r\n")
        if fields["WARC-Type"] == "revisit":
            assert body == b"" and "WARC-Profile" in fields
            original, whole = by_id[fields["WARC-Refers-To"]]
            assert original["WARC-Type"] == "response" and original["Page-Id"] == fields["Refers-To-Page-Id"]
            body = whole.partition(b"\r\n\r\n")[2]
        assert f"sha256:{hashlib.sha256(body).hexdigest()}" == fields["WARC-Payload-Digest"]
        assert f"Content-Length: {len(body)}".encode() in answer
        bodies[fields.get("Page-Id"), body] += 1
    assert bodies == Counter((None if i is None else str(i), (h or "").encode()) for i, _, h in PAGES)
    odd = next(f for f, _ in records if f.get("Page-Id") == "2")
    assert odd["WARC-Target-URI"] == "http://a/y%0D%0AWARC-Type:%20fake"


def test_damaged_archive_is_noticed(spark, archive):
    payloads = spark.read.parquet(f"{archive}/payloads")
    damaged = scratch_dir(spark, "archive")
    spark.read.parquet(f"{archive}/heads").write.parquet(f"{damaged}/heads")
    payloads.withColumn("payload", F.when(F.length("payload") == 100, F.lit(b"other")).otherwise(F.col("payload"))).write.parquet(
        f"{damaged}/payloads")
    with pytest.raises(PySparkException, match="missing or changed"):
        warc_store.restored(spark, damaged).select("payload_digest").collect()


def test_empty_archive(spark):
    folder = scratch_dir(spark, "archive")
    warc_store.deposit(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc_store.restored(spark, folder).collect() == []
